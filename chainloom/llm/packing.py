"""Packing into optimal length buckets.

A text's length is its token count plus one end token; longer texts are cut into segments of `max_len`
tokens, so nothing is dropped. A histogram of all segment lengths (at most max_len rows) goes to the
driver, where dynamic programming places the bucket boundaries that minimise padding over all segments.
Inside a bucket, segments are numbered and every budget // boundary of them form a batch, so a padded
batch never exceeds the token budget.

Numbering without a single task per bucket: segments are dealt by hash over shards of a bucket, numbered
inside each shard, and the shards' counts (at most `most_shards` + buckets rows, a fixed bound) give offsets.
So all batches of a bucket are full except one, and the result depends on the rows only. Rows of the same id and length
travel as one row with their number, in lots of COPIES at most, and are told apart at the end: a repeated or missing
id floods no shard.

Defined results: null and empty texts are one end token; repeated rows and null ids are packed each; an empty table
gives an empty result; very long texts are encoded in parts that end where the split pattern always ends a piece, so their
counts are those of the whole text (only white space of over MOST_SPACES characters in a row is cut in between).
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: A fixed value: the public split pattern that goes with this vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
MAX_LEN, BUCKETS, BUDGET = 2048, 16, 65536
SHARD_ROWS, MOST_SHARDS = 2000, 4096
#: Longer texts are encoded in parts of about so many characters; their token counts add up.
PART_CHARS = 100_000
#: The pattern's engine fails at about a million of them in a row.
MOST_SPACES = 500_000
#: Rows of one id and length that are numbered together.
COPIES = 1000
#: Where the split pattern always ends a piece, whatever follows: before white space, and behind a run of letters or digits.
_ENDS = regex.compile(r"(?<=\S)(?=[ \t\n\r])|(?<=\p{L})(?=[\p{P}\p{N}])|(?<=\p{N})(?=[\p{P}\p{L}])")
_SPACES = regex.compile(rf"\s{{{MOST_SPACES}}}")


def parts(text: str, most: int = PART_CHARS) -> Iterator[str]:
    """The text in parts, whose tokens are those of the whole."""
    at = 0
    while at < len(text):
        end = _ENDS.search(text, at + most) if len(text) - at > most else None
        part = text[at : end.start()] if end else text[at:]
        at += len(part)
        if len(part) > MOST_SPACES:
            inner = 0
            for m in _SPACES.finditer(part):
                yield part[inner : m.end()]
                inner = m.end()
            part = part[inner:]
        yield part


def token_counter(spark, vocabulary: str = VOCABULARY):
    """A column function: tokens of a text by a public byte-level vocabulary (read on the driver, sent to all)."""
    with open(vocabulary if os.path.isfile(vocabulary) else f"{vocabulary}/byte_bpe_50k.tiktoken", "rb") as f:
        shared = spark.sparkContext.broadcast(f.read())

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, shared.value.splitlines())}
        coder = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        for s in batches:
            yield pd.Series([sum(len(coder.encode_ordinary(x)) for x in parts(t)) if t else 0 for t in s], dtype="int64")

    return count


def boundaries(lengths: list[int], counts: list[int], buckets: int) -> list[int]:
    """Ascending bucket boundaries, the last the largest length, with the least padding over all segments."""
    order = np.argsort(lengths)
    size = np.asarray(lengths, np.float64)[order]
    n = len(size)
    if not n:
        return []
    rows = np.append(0.0, np.cumsum(np.asarray(counts, np.float64)[order]))
    k = min(buckets, n)
    best = np.full((k + 1, n + 1), np.inf)  # best[b, j]: least padded tokens of the j shortest lengths in b buckets
    best[0, 0] = 0
    came = np.zeros((k + 1, n + 1), np.int64)
    for j in range(1, n + 1):
        cost = best[:k, :j] + size[j - 1] * (rows[j] - rows[:j])
        i = cost.argmin(1)
        best[1:, j], came[1:, j] = cost[np.arange(k), i], i
    b, j, out = int(best[1:, n].argmin()) + 1, n, []
    while j:
        out.append(int(size[j - 1]))
        j, b = int(came[b, j]), b - 1
    return out[::-1]


def segments(df: DataFrame, id_col: str, length: Column, max_len: int) -> DataFrame:
    """id, segment (from 0), n_tokens, lot, copies."""
    rows = df.select(F.col(id_col).alias("id"), "lot", "copies", (F.coalesce(length, F.lit(0)) + 1).cast("long").alias("all"))
    rows = rows.withColumn("segment", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("all") / max_len) - 1)))
    return rows.select("id", "segment", F.least(F.lit(max_len), F.col("all") - F.col("segment") * max_len).cast("int").alias("n_tokens"), "lot", "copies")


def pack(df: DataFrame, id_col: str = "doc_id", length: Column | None = None, text_col: str = "text", max_len: int = MAX_LEN, buckets: int = BUCKETS, budget: int = BUDGET, shard_rows: int = SHARD_ROWS, most_shards: int = MOST_SHARDS) -> DataFrame:
    """One row per segment: id_col, segment, n_tokens, bucket_len, batch (from 0 in each bucket), slot in the batch.

    length: tokens of a row without the end token; by default counted from text_col with the public vocabulary."""
    if budget < max_len:
        raise ValueError("a batch must hold a segment: budget >= max_len")
    if length is None:
        length = token_counter(df.sparkSession)(F.col(text_col))
    counted = df.select(F.col(id_col).alias("id"), length.alias("n")).groupBy("id", "n").agg(F.count(F.lit(1)).alias("copies"))
    counted = cut(counted)  # texts are encoded once
    lots = counted.withColumn("lot", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1, F.lit(COPIES).cast("long"))))
    lots = lots.withColumn("copies", F.least(F.col("copies") - F.col("lot"), F.lit(COPIES)))
    rows = segments(lots, "id", F.col("n"), max_len)
    histogram = rows.groupBy("n_tokens").agg(F.sum("copies").alias("n")).collect()  # max_len rows at most
    edges = boundaries([r["n_tokens"] for r in histogram], [r["n"] for r in histogram], buckets)
    total = max(1, sum(r["n"] for r in histogram))
    bucket, shards, low = F.lit(None).cast("int"), F.lit(1), 0
    for e in edges:
        n = sum(r["n"] for r in histogram if low < r["n_tokens"] <= e)
        share = max(1, min(-(-n // shard_rows), most_shards * n // total))
        inside = F.col("n_tokens").between(low + 1, e)
        bucket, shards, low = F.when(inside, F.lit(e)).otherwise(bucket), F.when(inside, F.lit(share)).otherwise(shards), e
    dealt = rows.select("*", bucket.alias("bucket_len"), shards.alias("shards")).withColumn("shard", F.pmod(F.xxhash64("id", "segment", "lot"), "shards").cast("int")).drop("shards")
    sizes = dealt.groupBy("bucket_len", "shard").agg(F.sum("copies").alias("n")).collect()  # most_shards + buckets rows at most
    offsets, at = [], {}
    for r in sorted(sizes, key=lambda r: (r["bucket_len"], r["shard"])):
        offsets.append((r["bucket_len"], r["shard"], at.get(r["bucket_len"], 0)))
        at[r["bucket_len"]] = offsets[-1][2] + r["n"]
    kinds = pa.schema([("bucket_len", pa.int32()), ("shard", pa.int32()), ("first", pa.int64())])
    small = df.sparkSession.createDataFrame(pa.table(list(zip(*offsets, strict=True)) or [[], [], []], schema=kinds))  # a list would go through Python workers
    so_far = Window.partitionBy("bucket_len", "shard").orderBy("id", "segment", "n_tokens", "lot").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = dealt.withColumn("i", F.sum("copies").over(so_far) - F.col("copies")).join(F.broadcast(small), ["bucket_len", "shard"])
    out = out.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    place, room = F.col("first") + F.col("i") + F.col("copy"), F.floor(F.lit(budget) / F.col("bucket_len"))
    return out.select(F.col("id").alias(id_col), "segment", "n_tokens", "bucket_len", F.floor(place / room).alias("batch"), F.pmod(place, room).cast("int").alias("slot"))
