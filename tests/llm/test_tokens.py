"""The pipeline's last stage gives the tokens themselves."""

import hashlib

import corpus_pipeline as cp
from reqweave.llm import bpe, queries


def test_last_stage_keeps_ids(spark, sf_dir):
    docs = queries.documents(spark, sf_dir).limit(20).cache()
    want = {r.doc_id: r.ids for r in bpe.encode(docs, queries.tokenizer()).collect()}
    got = cp.encode(spark, docs, sf_dir).collect()
    assert {r.doc_id: r.ids for r in got} == want and any(want.values())
    assert all(r.n_tokens == len(r.ids) and r.ids_sha256 == hashlib.sha256(" ".join(map(str, r.ids)).encode()).hexdigest() for r in got)
