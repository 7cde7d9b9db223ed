"""Benchmark decontamination by pigeonhole edit matching.

Texts and items are lower-cased and their white space is collapsed. An item of m characters may occur
with up to k = floor(m * error_rate) edits; cut into k+1 pieces, at least one piece must then occur
unchanged. One Aho-Corasick pass over a text finds all pieces of all items; windows around the hits are
verified with Myers' bit-parallel edit distance (an item's column is one arbitrarily long integer). The pieces are
the leaves of a binary tree: n neighbouring pieces may have n-1 edits together, since n in each half would exceed
that. So a hit is first verified on two pieces, then on four, and few hits get as far as the whole item.

Only the items travel: in blocks of at most `block_chars` characters, one scan of the documents for TOGETHER of them,
so what is broadcast is bounded whatever the benchmark's size. Texts are never shuffled.

Defined results: null or blank texts and items match nothing; repeated items and rows each give their matches;
matches of one item in one text don't overlap; very long texts are searched whole.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ERROR_RATE, BLOCK_CHARS = 0.1, 4_000_000
#: Blocks that one scan of the documents looks for.
TOGETHER = 8
MATCH = "array<struct<item_id:bigint,distance:int,start:int,end:int>>"


def normal(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def pieces(item: str, k: int) -> list[tuple[int, str]]:
    """k+1 pieces of about equal length, with their offsets."""
    edges = [len(item) * i // (k + 1) for i in range(k + 2)]
    return [(a, item[a:b]) for a, b in zip(edges, edges[1:], strict=False)]


def _columns(pattern: str) -> dict[str, int]:
    eq: dict[str, int] = {}
    for i, c in enumerate(pattern):
        eq[c] = eq.get(c, 0) | 1 << i
    return eq


def myers(eq: dict[str, int], m: int, text: str, free_start: bool = True, enough: int = -1) -> tuple[int, int]:
    """Least edit distance of the pattern to a part of text, and where the first such part ends (exclusive);
    reads no further than a part within `enough` edits."""
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score, best, end = full, 0, m, m, 0
    for j, c in enumerate(text):
        e = eq.get(c, 0)
        x = e | down
        h = (((e & up) + up) ^ up) | e
        plus, minus = down | (full & ~(h | up)), up & h
        if plus & top:
            score += 1
        elif minus & top:
            score -= 1
            if score < best:
                best, end = score, j + 1
                if best <= enough:
                    break
        plus = plus << 1 if free_start else plus << 1 | 1
        up, down = ((minus << 1) | ~(x | plus)) & full, plus & x & full
    return best, end


class _Item:
    """An item, its pieces' edges, and for each piece the path of piece ranges from it up to (not including) the whole."""

    def __init__(self, item_id: int, text: str, k: int) -> None:
        self.id, self.text, self.k = item_id, text, k
        cut = pieces(text, k)
        self.edges = [o for o, _ in cut] + [len(text)]
        self.columns: dict[tuple[int, int], dict[str, int]] = {}
        self.paths: list[list[tuple[int, int]]] = [[] for _ in cut]
        self._split(0, k + 1)
        self.paths = [p[::-1] for p in self.paths]

    def _split(self, a: int, b: int) -> None:
        if b - a > 1:
            for x, y in ((a, (a + b) // 2), ((a + b) // 2, b)):
                if y - x > 1:
                    for i in range(x, y):
                        self.paths[i].append((x, y))
                self._split(x, y)

    def likely(self, piece: int, text: str, start: int) -> bool:
        """Whether the ranges around a piece found at text[start:] all keep to their edits."""
        for a, b in self.paths[piece]:
            lo, hi, most = self.edges[a], self.edges[b], b - a - 1
            at = start - (self.edges[piece] - lo)
            window = text[max(0, at - most) : at + hi - lo + most]
            if self.text[lo:hi] in window:
                continue
            if (a, b) not in self.columns:
                self.columns[a, b] = _columns(self.text[lo:hi])
            if myers(self.columns[a, b], hi - lo, window)[0] > most:
                return False
        return True

    def occurrences(self, text: str, lo: int, hi: int) -> Iterator[tuple[int, int, int]]:
        """(distance, start, end) of all matches in text[lo:hi] that don't overlap: the unchanged ones, and between them the
        edited ones from left to right."""
        m = len(self.text)
        while True:
            exact = text.find(self.text, lo, hi)
            yield from self._edited(text, lo, hi if exact < 0 else exact)
            if exact < 0:
                return
            yield 0, exact, exact + m
            lo = exact + m

    def _edited(self, text: str, lo: int, hi: int) -> Iterator[tuple[int, int, int]]:
        m, k = len(self.text), self.k
        while k and hi - lo >= m - k:
            if (0, k + 1) not in self.columns:
                self.columns[0, k + 1] = _columns(self.text)
            eq = self.columns[0, k + 1]
            distance, end = myers(eq, m, text[lo:hi], enough=k)
            if distance > k:
                return
            # ends of one match that keep to k edits lie at most 2k apart: the best of them
            distance, end = myers(eq, m, text[lo : min(hi, lo + end + 2 * k)])
            end += lo
            back = myers(_columns(self.text[::-1]), m, text[max(lo, end - m - k) : end][::-1], free_start=False)[1]
            yield distance, end - back, end
            lo = end


class Matcher:
    """Finds the items of a block in texts."""

    def __init__(self, items: list[tuple[int, str]], error_rate: float) -> None:
        import ahocorasick

        self.items, self.auto = [], ahocorasick.Automaton()
        for item_id, raw in items:
            text = normal(raw)
            if not text:
                continue
            k = int(len(text) * error_rate)
            at = len(self.items)
            self.items.append(_Item(item_id, text, k))
            for i, (_, piece) in enumerate(pieces(text, k)):
                if piece in self.auto:
                    self.auto.get(piece)[1].append((at, i))
                else:
                    self.auto.add_word(piece, (len(piece), [(at, i)]))
        if self.items:
            self.auto.make_automaton()

    def find(self, raw: str | None) -> list[tuple[int, int, int, int]]:
        text = normal(raw)
        if not text or not self.items:
            return []
        starts: dict[int, list[int]] = {}  # item: where it would start, for each hit that may be one
        for end, (size, hits) in self.auto.iter(text):
            start = end + 1 - size
            for at, piece in hits:
                item = self.items[at]
                where = start - item.edges[piece]
                known = starts.get(at)
                if known and where == known[-1]:
                    continue
                if item.likely(piece, text, start):
                    starts.setdefault(at, []).append(where)
        found = []
        for at, where in starts.items():
            item = self.items[at]
            m, k, windows = len(item.text), item.k, []
            for s in sorted(set(where)):
                lo, hi = max(0, s - k), min(len(text), s + m + k)
                if windows and lo <= windows[-1][1]:
                    windows[-1][1] = max(hi, windows[-1][1])
                else:
                    windows.append([lo, hi])
            for lo, hi in windows:
                found.extend((item.id, *x) for x in item.occurrences(text, lo, hi))
        return sorted(found)


def _blocks(items: DataFrame, id_col: str, text_col: str, block_chars: int) -> Iterator[list[tuple[int, str]]]:
    block, size = [], 0
    rows = items.select(F.col(id_col).cast("long"), F.col(text_col)).where(F.col(text_col).isNotNull())
    for item_id, text in rows.toLocalIterator():
        if block and size + len(text) > block_chars:
            yield block
            block, size = [], 0
        block.append((item_id, text))
        size += len(text)
    if block:
        yield block


def _finder(block: list[tuple[int, str]], error_rate: float, spark):
    shared = spark.sparkContext.broadcast(block)

    @F.pandas_udf(MATCH)
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        matcher = Matcher(shared.value, error_rate)
        for s in batches:
            yield pd.Series([[dict(zip(("item_id", "distance", "start", "end"), x, strict=True)) for x in matcher.find(t)] for t in s], dtype=object)

    return find


def matches(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", error_rate: float = ERROR_RATE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row per occurrence: id_col, item_id, distance, start, end (offsets in the normalised text)."""
    out = None
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    for blocks in itertools.batched(_blocks(items, item_id_col, item_text_col, block_chars), TOGETHER):
        finders = [_finder(block, error_rate, docs.sparkSession)("text") for block in blocks]  # in one pass over the texts
        found = rows.select("id", F.explode(F.flatten(F.array(*finders))).alias("m")).select(F.col("id").alias(id_col), "m.*")
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = rows.where("false").select(F.col("id").alias(id_col), *[F.lit(0).cast(t).alias(c) for c, t in (("item_id", "long"), ("distance", "int"), ("start", "int"), ("end", "int"))])
    return out


def keep_clean(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", error_rate: float = ERROR_RATE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of docs in which no item occurs, with all their columns."""
    for block in _blocks(items, item_id_col, item_text_col, block_chars):
        docs = docs.where(F.size(_finder(block, error_rate, docs.sparkSession)(F.col(text_col))) == 0)
    return docs
