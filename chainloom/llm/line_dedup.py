"""Line dedup: range-partitioned line hashes, streamed in order, answered with keep bitmaps.

A line's key (stripped of ASCII white space, A-Z lower-cased) becomes a 128-bit hash. The texts are split
once, into a stored table of (hash, document, row, line number), from which the bounds of the ranges are
sampled too. To find the lines that go, only this table moves: range-partitioned by hash and document and
sorted inside each partition by hash, then document (largest first), then line number. Because the document
is part of the range, a hash that a third of all lines share is spread over many partitions; a running
number, stored with the table, does that for the lines of a row that is repeated over and over.

One pass over a partition streams each hash's documents: the first is its largest, later ones lose the
line if there are enough of them. Only the hashes at a partition's two edges can go on in another: a
first pass writes a summary of these (at most two rows a partition, so its size is bounded by the number
of partitions), and the streaming pass reads the neighbours' part of them.

The result is one zlib-compressed bitmap per document with a lost line, bit i telling whether line i
stays, and never text (`keep_bitmaps`). `kept_lines` applies a bitmap to a text; `line_dedup` does so for
all rows, for which each text moves once, to where its bitmap is.

Defined results: a null or empty text is one empty line; a null id is a document smaller than all
others; rows that repeat an id are one document, each row with its own bitmap; rows that repeat id and text
share one. A text's length is bounded by memory only; an empty table gives an empty result; other columns
don't matter, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, ascii_lower, cut, join_back, partitions, store

LEAST_CHARS, LEAST_DOCS = 20, 3
NULL_ID = -(2**63)
#: Running numbers that deal the equal lines of repeated rows.
DEAL = 4096


def _rows(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return df.select(F.coalesce(F.col(id_col), F.lit(NULL_ID)).alias("doc"), F.col(id_col).alias("id"), F.xxhash64(id_col, text).alias("row"), text.alias("text"))


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(SPACES)))


def line_hashes(df: DataFrame, id_col: str, text_col: str, least_chars: int) -> DataFrame:
    lines = _rows(df, id_col, text_col).select("doc", "row", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    key = lines.select("doc", "row", "pos", line_key(F.col("line")).alias("k")).where(F.char_length("k") >= least_chars)
    return key.select(F.xxhash64("k").alias("a"), F.xxhash64(F.lit("~"), "k").alias("b"), "doc", "row", "pos")


class _Runs:
    """Streams the runs of equal hashes of a sorted partition; `docs` counts a run's documents so far."""

    def __init__(self) -> None:
        self.key, self.doc, self.docs = None, None, 0

    def feed(self, a: np.ndarray, b: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where a new hash begins; where a new document of a hash begins; which document of its hash a row is, from 0."""
        new, fresh = np.ones(len(a), bool), np.ones(len(a), bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        fresh[1:] = new[1:] | (d[1:] != d[:-1])
        carried = self.docs if self.key == (int(a[0]), int(b[0])) else 0
        if carried:
            new[0], fresh[0] = False, int(d[0]) != self.doc
        order = np.cumsum(fresh)
        starts = np.flatnonzero(new)
        base = np.zeros(len(a), np.int64)
        base[starts] = order[starts]
        base = np.maximum.accumulate(base)  # the count at which the row's hash began
        order = np.where(base > 0, order - base, order - 1 + carried)
        self.key, self.doc, self.docs = (int(a[-1]), int(b[-1])), int(d[-1]), int(order[-1]) + 1
        return new, fresh, order


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a sorted partition, its first and its last hash: largest and smallest document, number of documents."""
    from pyspark import TaskContext

    runs, found = _Runs(), []  # found: [a, b, top, low, docs] of the first and the last hash
    for batch in batches:
        if not batch.num_rows:
            continue
        a, b, d = (batch.column(i).to_numpy() for i in range(3))
        new, _, order = runs.feed(a, b, d)
        starts = np.flatnonzero(new)
        if not new[0]:  # goes on with the last hash of the batch before
            end = (starts[0] if len(starts) else len(a)) - 1
            found[-1][3:] = [int(d[end]), int(order[end]) + 1]
        if len(starts):
            ends = np.append(starts[1:], len(a)) - 1
            some = [0] if not found else []
            for i in dict.fromkeys([*some, len(starts) - 1]):
                found.append([int(a[starts[i]]), int(b[starts[i]]), int(d[starts[i]]), int(d[ends[i]]), int(order[ends[i]]) + 1])
            found = [found[0], found[-1]] if len(found) > 1 else found
    part = TaskContext.get().partitionId()
    names = ["part", "a", "b", "top", "low", "docs"]
    yield pa.RecordBatch.from_pylist([dict(zip(names, [part, *r], strict=True)) for r in found], schema=pa.schema([(x, pa.int64()) for x in names]))


def _spanning(edges: list) -> dict[tuple[int, int], list[tuple[int, int, int, int]]]:
    """Hashes that several partitions hold: (part, top, low, docs) of each, in order."""
    found: dict = {}
    for r in sorted(edges, key=lambda r: r["part"]):
        found.setdefault((r["a"], r["b"]), []).append((r["part"], r["top"], r["low"], r["docs"]))
    return {k: v for k, v in found.items() if len(v) > 1}


def _drops(least_docs: int, spanning):
    """The streaming pass: (doc, row, pos) of the lines that go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, spans, runs = TaskContext.get().partitionId(), spanning.value, _Runs()
        held: list[tuple[np.ndarray, ...]] = []  # rows of the hash at hand that wait for its least_docs-th document

        def out(d, r, p):
            return pa.RecordBatch.from_arrays([pa.array(x) for x in (d, r, p)], names=["doc", "row", "pos"])

        def outside(key) -> tuple[int, int, int | None]:
            """Documents of a hash in earlier partitions, in all later ones, and the largest document if an earlier one has it."""
            before = after = 0
            top = last = None
            for at, high, low, docs in spans.get(key, ()):
                same = last is not None and high == last
                if at < part:
                    before += docs - same
                    top = high if top is None else top
                elif at == part:
                    before -= same
                else:
                    after += docs - same
                last = low
            return before, after, top

        for batch in batches:
            if not batch.num_rows:
                continue
            a, b, d, r, p = (batch.column(i).to_numpy() for i in range(5))
            new, _, order = runs.feed(a, b, d)
            starts = np.flatnonzero(new)
            if len(starts) == 0 or starts[0] != 0:
                starts = np.append(0, starts)
            ends = np.append(starts[1:], len(a))
            total = order[ends - 1] + 1  # documents of the run so far
            drop = order > 0
            enough = total >= least_docs
            for i in {0, len(starts) - 1}:  # only these can reach into other partitions
                s, e = starts[i], ends[i]
                key = (int(a[s]), int(b[s]))
                if key in spans:
                    before, after, top = outside(key)
                    enough[i] = total[i] + before + after >= least_docs
                    if top is not None:
                        drop[s:e] = d[s:e] != top
            if new[0]:
                held = []
            go = np.repeat(enough, ends - starts) & drop
            if held and enough[0]:
                yield from (out(*x) for x in held)
                held = []
            if go.any():
                yield out(d[go], r[go], p[go])
            if not enough[-1]:
                s = starts[-1]
                wait = drop[s:]
                if len(starts) > 1:
                    held = []
                if wait.any():
                    held.append((d[s:][wait], r[s:][wait], p[s:][wait]))
            else:
                held = []

    return run


def bitmap(n_lines: int, dropped: np.ndarray) -> bytes:
    bits = np.ones(-(-n_lines // 8) * 8, bool)
    bits[dropped] = False
    return zlib.compress(np.packbits(bits, bitorder="little").tobytes(), 6)


def kept_lines(text: str | None, packed: bytes | None) -> list[str]:
    lines = (text or "").split("\n")
    if packed is None:
        return lines
    bits = np.unpackbits(np.frombuffer(zlib.decompress(packed), np.uint8), bitorder="little").tolist()
    return [x for x, keep in zip(lines, bits + [1] * (len(lines) - len(bits)), strict=False) if keep]


def keep_bitmaps(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS) -> DataFrame:
    """doc, row, dropped (count), last (highest line number that goes), keep_bitmap, for rows that lose a line.

    Bits beyond the bitmap's end are lines that stay."""
    spark = df.sparkSession
    rows = line_hashes(df, id_col, text_col, least_chars)
    rows = store(rows.withColumn("deal", F.pmod(F.monotonically_increasing_id(), F.lit(DEAL)).cast("short")))
    order = ["a", "b", F.col("doc").desc()]
    rows = rows.repartitionByRange(partitions(spark), *order, "row", "pos", "deal").sortWithinPartitions(*order, "row", "pos")
    rows = cut(rows.drop("deal"))  # both passes must see the same partitions
    edges = rows.mapInArrow(_edges, "part long, a long, b long, top long, low long, docs long").collect()  # two rows a partition at most
    spanning = spark.sparkContext.broadcast(_spanning(edges))
    drops = rows.mapInArrow(_drops(least_docs, spanning), "doc long, row long, pos int")
    lost = drops.groupBy("doc", "row").agg(F.collect_set("pos").alias("lost"))

    @F.pandas_udf("binary")
    def pack(lost: pd.Series) -> pd.Series:
        return lost.map(lambda x: bitmap(int(max(x)) + 1, np.asarray(x)))

    return lost.select("doc", "row", F.size("lost").cast("long").alias("dropped"), pack("lost").alias("keep_bitmap"))


def line_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS) -> DataFrame:
    """One row per input row: id_col, n_lines, n_dropped, keep_bitmap (null: all stay), text (what is left), kept_sha256."""
    lost = keep_bitmaps(df, id_col, text_col, least_chars, least_docs)
    rows = join_back(_rows(df, id_col, text_col), lost, ["doc", "row"], "left")

    @F.pandas_udf("string")
    def kept(text: pd.Series, packed: pd.Series) -> pd.Series:
        return pd.Series(["\n".join(kept_lines(t, b)) for t, b in zip(text, packed, strict=True)], dtype=object)

    given = F.when(F.col("keep_bitmap").isNotNull(), F.col("text"))  # Python gets no text that stays as it is
    n_lines = F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit(""))) + 1
    rows = rows.select("id", n_lines.cast("long").alias("n_lines"), F.coalesce("dropped", F.lit(0)).cast("long").alias("n_dropped"), "keep_bitmap", F.when(F.col("keep_bitmap").isNull(), F.col("text")).otherwise(kept(given, "keep_bitmap")).alias("kept"))
    return rows.select(F.col("id").alias(id_col), "n_lines", "n_dropped", "keep_bitmap", F.col("kept").alias("text"), F.sha2("kept", 256).alias("kept_sha256"))


SQL = """
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
k AS (SELECT doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
g AS (SELECT key, max(doc_id) AS top FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
j AS (SELECT k.*, g.top IS NOT NULL AND k.doc_id <> g.top AS gone FROM k LEFT JOIN g ON k.key = g.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM j GROUP BY doc_id
"""
