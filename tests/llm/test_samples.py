"""Training samples: bounded, never empty, the same at any layout, and not to be flooded by repeated rows or ids."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from chainloom.llm import language_id, quality
from chainloom.llm.common import bounded_sample, within_quota


def picked(rows, *args):
    return sorted((r.h, r.id, r.kind) for r in within_quota(bounded_sample(rows, *args).collect(), args[0]))


def test_sample_is_exact_and_bounded(spark):
    rows = spark.range(60_000).select("id", F.concat(F.lit("t"), "id").alias("text"), (F.col("id") % 3 == 0).cast("int").alias("kind"))
    for most in (1, 50, 3000):
        got = picked(rows, "kind", most)
        assert most <= len(got) <= most + 2 and got == picked(rows.repartition(7), "kind", most)
    assert len(picked(rows, "kind", 10**6)) == 60_000


def test_a_share_below_one_in_a_million_is_not_nothing(spark):
    chosen = spark.range(3_000_000).where(F.xxhash64("id") / F.lit(2.0**64) + 0.5 <= F.lit(2e-6)).count()
    assert 0 < chosen < 30


def test_repeats_and_missing_ids(spark):
    hot = spark.range(100_000).select(F.lit(7).cast("long").alias("id"), F.lit("the same row").alias("text"), F.lit("a").alias("kind"))
    own = spark.range(3000).select(F.lit(None).cast("long").alias("id"), F.concat(F.lit("row "), "id").alias("text"), F.when(F.col("id") < 40, "rare").otherwise("a").alias("kind"))
    got = picked(hot.union(own), "kind", 200, 30)
    assert sum(k == "rare" for *_, k in got) == 30 and 150 <= len(got) <= 232


def test_models_are_the_same_at_any_layout(spark):
    rng = random.Random(3)
    vocab = {"en": "the and of house water with".split(), "de": "der und das haus wasser mit".split()}
    rows = [(rng.choice([None, 5, *range(50)]), lang := rng.choice(list(vocab)), " ".join(rng.choices(vocab[lang], k=12))) for _ in range(600)]
    df = spark.createDataFrame([(i, t, lang) for i, lang, t in rows], "doc_id long, text string, lang string")
    a, b = (language_id.train(x, max_train_rows=120) for x in (df, df.repartition(5).union(df.limit(0))))
    assert a.langs == b.langs and (a.weights == b.weights).all() and a.temperature == b.temperature
    labels = spark.createDataFrame([(i, int(i > 20)) for i in range(50)], "doc_id long, quality int")
    a, b = (quality.train(x, y, max_train_rows=80, rounds=5) for x, y in ((df, labels), (df.repartition(5), labels.repartition(3))))
    assert a.base == b.base and all((s == t).all() for s, t in zip(a.tables, b.tables, strict=True))


def test_one_id_repeated(spark):
    df = spark.range(20_000).select(F.lit(3).cast("long").alias("doc_id"), F.concat(F.lit("words and "), F.col("id") % 5000).alias("text"), F.lit("en").alias("lang"))
    model = quality.train(df, spark.createDataFrame([(3, 1)], "doc_id long, quality int"), max_train_rows=100)
    assert model.base == pytest.approx(np.log(102), abs=0.02)  # a hundred rows of label 1 and none of 0
    assert language_id.train(df, max_train_rows=100).langs == ["en"]
