"""The pipeline's stages, each on its own input."""

import pytest

import corpus_pipeline as cp
from reqweave.llm import queries
from tests.llm.test_near_duplicates import near_brute
from tests.llm.test_operators import SCHEMA, hard_docs, lines_brute


@pytest.fixture(scope="module")
def stages(spark, sf_dir, tmp_path_factory):
    """Each stage's input and output, as the stages are run: written and read again."""
    at, docs, out = tmp_path_factory.mktemp("stages"), queries.documents(spark, sf_dir), []
    for name, stage in cp.STAGES:
        stage(spark, docs, sf_dir).write.parquet(str(at / name))
        after = spark.read.parquet(str(at / name))
        out.append((docs, after))
        docs = after
    return out


def test_names():
    assert [f.__name__ for _, f in cp.STAGES] == ["language_id", "line_filter", "near_dedup", "mix", "encode"]


def test_columns_stay(stages):
    for docs, after in stages[:-1]:
        assert after.columns == ["doc_id", "text", "lang", "source", "n_chars"] == docs.columns


def test_language_stage_keeps_texts(stages):
    docs, after = stages[0]
    lost = {r.doc_id for r in docs.collect()} - {r.doc_id for r in after.collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert len(lost) <= 0.02 * len(texts) and all(len(texts[i]) < 200 for i in lost)


def test_other_scripts_are_rejected(spark):
    docs = queries.documents(spark, "/root/testdata/sf0.01")
    foreign = ["Съешь же ещё этих мягких французских булок, да выпей чаю.", "いろはにほへと ちりぬるを わかよたれそ つねならむ", "Ξεσκεπάζω την ψυχοφθόρα βδελυγμία", "12 34 56", ""]
    more = spark.createDataFrame([(-1 - i, t * 3, None, "s", 1) for i, t in enumerate(foreign)], docs.schema)
    kept = {r.doc_id for r in cp.language_id(spark, docs.unionByName(more), "").collect()}
    assert not [i for i in kept if i < 0]
    assert len(kept) >= 0.995 * docs.count()


def test_line_stage(stages):
    docs, after = stages[1]
    want = lines_brute([(r.doc_id, r.text, r.source) for r in docs.collect()], 0.05, 4)
    assert sorted(((r.doc_id, r.text) for r in after.collect()), key=repr) == want
    assert all(r.n_chars == len(r.text) for r in after.collect())


def test_near_stage(stages):
    docs, after = stages[2]
    want = near_brute([(r.doc_id, r.text) for r in docs.collect()])
    assert {r.doc_id for r in after.collect()} == {i for i, c in want if i == c}
    assert after.count() < docs.count()


def test_mix_stage(stages, spark):
    docs, after = stages[3]
    mixed = queries.mixed(docs)[0].collect()
    assert {r.doc_id for r in after.collect()} == {r.doc_id for r in mixed if r.mix_sampled}
    total = sum(r.mix_tokens for r in mixed)
    expected = sum(r.mix_tokens * r.mix_probability for r in mixed) / total
    share = sum(r.mix_tokens for r in mixed if r.mix_sampled) / total
    assert 0.1 < expected <= queries.MIX.keep + 1e-9 and abs(share - expected) < 0.15


def test_last_stage_and_run(stages, spark, sf_dir):
    docs, after = stages[4]
    assert docs.count() == after.count()
    assert sorted(map(tuple, cp.run(spark, sf_dir).collect())) == sorted(map(tuple, after.collect()))


def test_hard_tables(spark, sf_dir):
    empty = spark.createDataFrame([], SCHEMA)
    hard = spark.createDataFrame(hard_docs(), SCHEMA)
    for name, stage in cp.STAGES:
        assert stage(spark, empty, sf_dir).count() == 0, name
        out = stage(spark, hard, sf_dir)
        assert out.count() <= hard.count(), name
        if name != "bpe":
            assert out.columns == hard.columns, name


def test_near_copies_go_and_clean_documents_stay(spark, sf_dir):
    import random

    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghijklm") for _ in range(rng.randrange(2, 9)))
    docs, copies = [], []
    for k in range(60):
        words = [word() for _ in range(200)]
        docs.append((k, " ".join(words), "en", "s", 1))
        words[rng.randrange(200)] = "other"
        copies.append((1000 + k, " ".join(words), "en", "s", 1))
    got = {r.doc_id for r in cp.near_dedup(spark, spark.createDataFrame(docs + copies, "doc_id long, text string, lang string, source string, n_chars long"), sf_dir).collect()}
    assert got == set(range(60))
