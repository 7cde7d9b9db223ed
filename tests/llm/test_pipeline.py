"""The pipeline against a plain-Python run of its stages on a small corpus."""

import collections
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from chainloom.llm import decontaminate, jaccard, packing, quality, simhash
from chainloom.llm.common import fold, table


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice(["ra", "to", "mi", "el", "us"]) for _ in range(rng.randrange(1, 5)))
    text = lambda n: " ".join(word() for _ in range(n)) + "."
    bench = [(i, text(25)) for i in range(3)]
    docs = [text(rng.randrange(30, 120)) for _ in range(120)]
    docs += [" ".join(rng.choice(["$$$", "###!!", "WIN|"]) for _ in range(50)) + str(i) for i in range(40)]
    docs += [docs[3], docs[3].upper(), docs[5], docs[7] + " extra", text(40) + " " + bench[1][1] + " " + text(30)]
    path = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(docs)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, int(not 120 <= i < 160), 0) for i in range(len(docs)) if i % 2], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, docs, bench


def test_stages(spark, corpus):
    path, docs, bench = corpus
    model = quality.train(table(spark, path, "documents"), table(spark, path, "labels"), learn=fold(F.col("doc_id"), 5) != 0)
    left = {i: t for i, t in enumerate(docs) if model.score(__import__("numpy").array([quality.features(t)]))[0] >= 0.3}
    assert set(range(120)) <= set(left) and not set(range(120, 160)) & set(left)
    by = collections.defaultdict(list)
    for i, t in left.items():
        by[t.lower()].append(i)
    left = {max(v): left[max(v)] for v in by.values()}
    fps = {i: simhash.fingerprint(t) for i, t in left.items()}
    comp = {i: i for i in left}
    for _ in fps:
        for i in fps:
            comp[i] = min(comp[j] for j in fps if (fps[i] ^ fps[j]).bit_count() <= 3)
    left = {i: t for i, t in left.items() if comp[i] == i}
    matcher = decontaminate.Matcher(bench, decontaminate.ERROR_RATE)
    left = {i: t for i, t in left.items() if not matcher.find(t)}
    assert 164 not in left and 0 in left
    out = docs_out = table(spark, path, "documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs_out = stage(spark, docs_out, path)
        assert docs_out.columns == out.columns, name
    assert {r.doc_id for r in docs_out.collect()} == set(left)
    rows = corpus_pipeline.run(spark, path).collect()
    assert {r.doc_id for r in rows} == set(left) and all(r.n_tokens <= packing.MAX_LEN for r in rows)


@pytest.mark.parametrize("crowd", [4, 1024])
def test_near_stage_is_jaccard(spark, crowd):
    rng = random.Random(12)
    vocab = [f"w{i}" for i in range(300)]
    docs = []
    for _ in range(12):  # families of copies with more and more words changed, about the threshold
        now = rng.choices(vocab, k=rng.randrange(60, 160))
        for _ in range(8):
            docs.append(" ".join(now))
            now = list(now)
            for _ in range(rng.randrange(1, 4)):
                now[rng.randrange(len(now))] = rng.choice(vocab)
    docs += ["", None, "a b", "A  b", "a b c"]
    sets = [set(zip(*(w[i:] for i in range(5)))) if len(w) > 4 else {tuple(w)} for w in ((t or "").lower().split() for t in docs)]
    root = list(range(len(docs)))
    for i in range(len(docs)):
        for j in range(i):
            if 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j]) and root[i] != root[j]:
                a, b = max(root[i], root[j]), min(root[i], root[j])
                root = [b if r == a else r for r in root]
    df = spark.createDataFrame([*enumerate(docs), (None, docs[0])], "doc_id long, text string")
    assert {r.id: r.root for r in jaccard.roots(df, crowd=crowd).collect()} == dict(enumerate(root))
    kept = [r.doc_id for r in corpus_pipeline.near_stage(spark, df, "").collect()]
    assert sorted(kept, key=str) == sorted([*{*root}, None], key=str) and len(kept) < 0.8 * len(docs)


def test_batches_for_python_are_bounded_in_bytes(spark, corpus):
    path, _, _ = corpus
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key, None)

    @F.pandas_udf("long")
    def batch(s):
        return __import__("pandas").Series([int(s.str.len().sum())] * len(s))

    long = spark.range(400, numPartitions=1).select(F.concat(F.expr("repeat('word and ', 6000)"), F.col("id").cast("string")).alias("text"))
    try:
        for _, stage in corpus_pipeline.STAGES:
            spark.conf.unset(key)
            if stage is not corpus_pipeline.exact_stage:  # has no Python
                stage(spark, table(spark, path, "documents"), path)
                assert long.select(F.max(batch("text"))).first()[0] <= (4 << 20) + 60_000, stage.__name__
        spark.conf.set(key, "1m")
        corpus_pipeline.near_stage(spark, table(spark, path, "documents"), path)
        assert spark.conf.get(key) == "1m"  # what a session was given stays
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def test_few_links_make_few_files(spark):
    wide, coalesce = "spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled"
    n, was = spark.conf.get(wide), spark.conf.get(coalesce)
    spark.conf.set(wide, "40")
    spark.conf.set(coalesce, "false")
    try:
        out = simhash.components(spark.range(300).select((F.col("id") + 1).alias("u"), F.expr("id - id % 10").alias("v")))
        assert out.rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism
        assert {(r.node, r.root) for r in out.collect()} == {(i, 0) for i in range(1, 301)}
    finally:
        spark.conf.set(wide, n)
        spark.conf.set(coalesce, was)


def test_packing_starts_no_workers_for_its_offsets(spark):
    rows = spark.range(50).select(F.col("id").alias("doc_id"), F.lit(None).cast("string").alias("text"))
    plan = packing.pack(rows, length=F.col("doc_id") % 7)._jdf.queryExecution().optimizedPlan().toString()
    assert "LogicalRDD [bucket_len" not in plan and "applySchemaToPythonRDD" not in plan
    assert packing.pack(rows.where("false"), length=F.col("doc_id")).count() == 0
