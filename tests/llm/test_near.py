"""Near duplicates of the given documents: the index and the min-hash search against all pairs."""

import collections
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from chainloom.llm import jaccard, simhash

DOCUMENTS = "/root/testdata/sf0.01/documents.parquet"
pytestmark = pytest.mark.skipif(not os.path.exists(DOCUMENTS), reason="needs the given tables")


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(DOCUMENTS).select("doc_id", "text").cache()


def joined(n, pairs):
    """For each of n rows, the smallest that the pairs reach."""
    root = list(range(n))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in pairs:
        a, b = top(a), top(b)
        root[max(a, b)] = min(a, b)
    return [top(i) for i in range(n)]


@pytest.mark.parametrize(("most", "crowd"), [(3, 4), (9, 16)])
def test_index_finds_what_all_pairs_do(spark, documents, most, crowd):
    """Also at a radius where there are links between most families of near copies, and where nearly all buckets are crowded."""
    rows = sorted((r.doc_id, r.text) for r in documents.collect())
    fp = np.array([simhash.fingerprint(t) for _, t in rows], np.uint64)
    pairs = [(i, int(j)) for i in range(len(fp)) for j in np.flatnonzero(np.bitwise_count(fp[:i] ^ fp[i]) <= most)]
    want = {rows[i][0]: rows[r][0] for i, r in enumerate(joined(len(rows), pairs))}
    got = simhash.near_dedup(documents, most=most, crowd=crowd).collect()
    assert {r.doc_id: r.component_id for r in got} == want
    assert {r.doc_id: r.fingerprint for r in got} == {d: f"{int(x):016x}" for (d, _), x in zip(rows, fp, strict=True)}


@pytest.mark.parametrize("most", [3, 12, jaccard.MOST])
def test_index_of_a_bucket(most):
    rng = np.random.default_rng(5)
    fp = rng.integers(0, 2**64, 60, dtype=np.uint64)[rng.integers(0, 60, 400)]  # many of them equal
    for _ in range(6):
        fp ^= np.uint64(1) << rng.integers(0, 64, 400, dtype=np.uint64) * (rng.random(400) < 0.5)
    which, close = simhash.near(fp, most)
    assert (close[which][:, which] == (np.bitwise_count(fp[:, None] ^ fp) <= most)).all()


def test_links_come_from_the_index(spark, monkeypatch):
    """Of a bucket's rows the index's candidates alone are checked, and of its smallest text's only those within as many bits."""
    words = [f"w{i}" for i in range(100)]
    texts = [" ".join(words), " ".join([*words, "a"]), " ".join(["b", *words])]
    sets = [jaccard.shingles(t) for t in texts]
    fp, label = np.array([simhash.majority(s) for s in sets], np.uint64), np.arange(3)
    assert 0 < max(np.bitwise_count(fp ^ fp[0])) <= jaccard.MOST
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert len(jaccard.bucket_links(sets, fp, label)) == 2 and {r.root for r in jaccard.roots(docs).collect()} == {0}
    monkeypatch.setattr(jaccard, "MOST", -1)
    assert {r.id: r.root for r in jaccard.roots(docs.where("doc_id < 2")).collect()} == {0: 0, 1: 1}
    monkeypatch.setattr(jaccard, "near", lambda fp, most: (label, np.eye(3, dtype=bool)))
    assert jaccard.bucket_links(sets, fp, label) == []


def test_similar_texts_are_what_all_pairs_say(spark, documents):
    rows = sorted((r.doc_id, r.text) for r in documents.collect())
    words = [(t or "").encode().lower().split() for _, t in rows]
    sets = [set(zip(*(w[i:] for i in range(5)), strict=False)) if len(w) > 4 else {tuple(w)} for w in words]
    holders = collections.defaultdict(list)
    for i, s in enumerate(sets):
        for g in s:
            holders[g].append(i)
    pairs = []
    for i, s in enumerate(sets):
        shared = collections.Counter(j for g in s for j in holders[g] if j < i)
        pairs += [(i, j) for j, n in shared.items() if 10 * n >= 8 * (len(s) + len(sets[j]) - n)]
    fp = [simhash.majority(jaccard.shingles(t)) for _, t in rows]
    assert max((fp[i] ^ fp[j]).bit_count() for i, j in pairs) <= jaccard.MOST
    want = {rows[i][0]: rows[r][0] for i, r in enumerate(joined(len(rows), pairs))}
    assert {r.id: r.root for r in jaccard.roots(documents, crowd=4).collect()} == want
    kept = jaccard.keep_representatives(documents).agg(F.count(F.lit(1))).first()[0]
    assert kept == len(set(want.values()))
