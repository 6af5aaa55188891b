"""Near copies by shingle sets, against brute force, and in the pipeline's stage."""

import random

import numpy as np
import pytest

import corpus_pipeline as cp
from reqweave.llm import near_duplicates as nd
from reqweave.llm import queries
from tests.llm.test_operators import SCHEMA, hard_docs

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n):
    return ["".join(rng.choice("abcdefghijklm") for _ in range(rng.randrange(4, 9))) for _ in range(n)]


def near_brute(rows):
    """Of rows (id, text): the pairs of id and component's least id, sorted."""
    sets, up = [], list(range(len(rows)))
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + cp.WORDS]) for i in range(max(1, len(w) - cp.WORDS + 1))} if w else set())

    def root(a):
        while up[a] != a:
            a = up[a]
        return a

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if 5 * both >= 4 * (len(sets[a]) + len(sets[b]) - both):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    least = {}
    for a, (i, _) in enumerate(rows):
        least[root(a)] = min((x for x in (i, least.get(root(a))) if x is not None), default=None)
    return sorted(((i, least[root(a)]) for a, (i, _) in enumerate(rows)), key=repr)


def test_stage_groups_every_pair_from_the_limit_on(spark, sf_dir):
    rng = random.Random(8)
    docs, copies, want = [], [], set()
    for k in range(140):
        if k < 20:  # 9 shingles, 8 of them shared: 0.8 exactly
            n, tail = 13, 1
        else:  # 196 shingles: 0.90 to 0.806 with up to 21 words of the end changed; 0.798 to 0.72 with 22 and more
            n, tail = 200, 10 + k % 12 if k < 100 else 22 + k % 10
        w = words(rng, n)
        docs.append((k, " ".join(w), "en", "s", 1))
        copies.append((1000 + k, " ".join(w[:-tail] + words(rng, tail)), "en", "s", 1))
        want |= {k} if k < 100 else {k, 1000 + k}
    assert {r.doc_id for r in cp.near_dedup(spark, spark.createDataFrame(docs + copies, DOCS), sf_dir).collect()} == want


def test_recall_at_the_limit():
    """Of pairs at 0.8 exactly, of 5 to 400 shingles, how many fall under a mask together and within the radius (0.94 to 1)."""
    rng = np.random.default_rng(3)
    for n in (1 << 18, 1 << 24):
        masks = np.array(nd.masks(n), np.int64).view(np.uint64)
        for size in (5, 9, 18, 45, 400):
            own = size // 9 if size % 9 == 0 else 0
            shared = size - own if own else size * 4 // 5
            met = []
            for _ in range(300):
                h = rng.integers(0, 1 << 64, (size + max(own, size - shared - own), 2), dtype=np.uint64)
                a, b = (h[:size], np.r_[h[:shared], h[size:][:own]]) if own else (h[:size], h[:shared])
                x = nd.fingerprint(a) ^ nd.fingerprint(b)
                met.append(np.bitwise_count(x).sum() <= nd.RADIUS and bool(((x & masks) == 0).all(axis=1).any()))
            assert np.mean(met) >= (0.9 if size < 9 else 0.97), (n, size, np.mean(met))


@pytest.mark.parametrize("cap, block", [(nd.CAP, nd.BLOCK), (6, 300)])
def test_components_are_exact(spark, cap, block):
    rng = random.Random(5)
    passage, rows = words(rng, 40), [(r[0], r[1]) for r in hard_docs()]
    for k in range(6):  # clouds of copies of copies, chains among them, and a passage that many texts hold
        at = words(rng, 120) + passage
        for i in range(12):
            rows.append((1000 + 100 * k + i, " ".join(at)))
            for _ in range(rng.randrange(1, 4)):
                at[rng.randrange(len(at))] = "x" + str(rng.random())
    got = nd.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words=cp.WORDS, cap=cap, block=block)
    assert sorted(map(tuple, got.collect()), key=repr) == near_brute(rows)


def test_supplied_documents_and_nothing(spark, sf_dir):
    docs = queries.documents(spark, sf_dir)
    got = nd.near_duplicates(docs, words=cp.WORDS, limit=cp.SIMILARITY)
    assert sorted(map(tuple, got.collect()), key=repr) == near_brute(sorted((r.doc_id, r.text) for r in docs.collect()))
    assert nd.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    with pytest.raises(ValueError):
        nd.near_duplicates(docs, limit=0.5)


def test_bitmaps_count_what_sets_share():
    rng = np.random.default_rng(6)
    sets = [np.unique(rng.integers(0, 300, rng.integers(0, 120), dtype=np.uint64)) for _ in range(40)] + [np.zeros(0, np.uint64)]
    bits = nd.bitmaps(sets)
    for a in range(41):
        for b in range(a):
            assert np.bitwise_count(bits[a] & bits[b]).sum() == len(np.intersect1d(sets[a], sets[b]))
