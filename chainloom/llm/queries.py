"""The operators' queries: production parameters, whole tables, results as the contracts name them."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, exact_dedup, html_text, language_id, line_dedup, lm_scoring, packing, quality, simhash, warc_zip
from .common import fold, ship, spread, table


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = spread(table(spark, sf_dir, "documents")), fold(F.col("doc_id"), 5) == 0
    model = quality.train(docs, table(spark, sf_dir, "labels"), learn=fold(F.col("doc_id"), 5) != 0)
    rows = docs.select("doc_id", held_out.alias("held_out"), quality.scorer(model, spark)("text").alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= quality.THRESHOLD).cast("int"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(spread(table(spark, sf_dir, "documents")))


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents"))
    model = language_id.train(docs, learn=fold(F.col("doc_id"), 4) != 2)
    rows = docs.select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), language_id.predictor(model, spark)("text").alias("p"))
    return rows.select("doc_id", "held_out", "p.lang_pred", "p.score")


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(spread(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))


def op5_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_text(spread(table(spark, sf_dir, "pages")))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_dropped", "kept_sha256")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_dedup(spread(table(spark, sf_dir, "documents")))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_zip.round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.lm_score(spread(table(spark, sf_dir, "documents")), learn=fold(F.col("doc_id"), 7) != 2)


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def _shipped(f):
    @functools.wraps(f)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return f(spark, sf_dir)

    return run


QUERIES = {f.__name__: _shipped(f) for f in (op1_quality, op2_packing, op3_language, op4_decontaminate, op5_html, op6_line_dedup, op7_simhash, op8_warc, op9_lm, op10_exact_dedup, pipeline)}
SQL = {"op6_line_dedup": line_dedup.SQL, "op8_warc": warc_zip.SQL, "op10_exact_dedup": exact_dedup.SQL}
