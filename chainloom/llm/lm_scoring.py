"""LM scoring with a probabilistic suffix tree over the bytes of normalised texts.

A text is its words (A-Z lower-cased, split at ASCII white space), joined by one space, and one end symbol; the model
gives each byte a probability, so a text's score is a proper log-probability. Contexts are the 1 to `depth`
bytes before a byte. Contexts of fewer than SHARED bytes are always retained; a longer one that occurs at least `least`
times is retained if its next-symbol distribution diverges from its suffix's by at least `bits` in all (count x
Kullback-Leibler), or if a retained context needs it. So the tree grows with the corpus. Distributions are smoothed with the suffix's
(Witten-Bell), down to uniform; the longest retained suffix scores.

Counting covers all training texts, and the tree stays distributed:

1. Each task packs its rows, as they come, into blocks of some `block_bytes` and writes, once, a block's normalised texts, its
   distinct words by a hash range of the word, and its distinct n-grams by a hash range of the last SHARED bytes of their context, each
   with the count in training texts. Repeated rows and ids are nothing special to a block.
2. A task a range gathers all blocks' counts of it. All contexts that share a suffix of SHARED bytes are in one range, so
   it grows its part of the tree alone, on top of the shorter contexts (256**3 counts at most, broadcast). It answers
   each block: corpus counts of its words, log-probabilities of its n-grams, in the block's order.
3. Blocks meet their answers and score their own texts.

There are about two ranges a block, so neither blocks nor ranges grow with the corpus while those share it evenly; a range's least unit is
one suffix of SHARED bytes. Nothing that grows is broadcast or collected.

Defined results: a null text is empty (one end token); null ids are scored and learned from (fold 0); repeated rows are
each learned from and scored; an empty training fold gives uniform bytes and base_score of log10(1) per token; a very long text is a
block of its own.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import partitions, store

DEPTH, LEAST, DIVERGENCE_BITS, BLOCK_BYTES, LEAST_RANGES = 6, 2, 12.0, 12 << 20, 64
#: Bytes of context that contexts of one range have in common.
SHARED = 3
#: Bytes of text whose n-grams are sorted at once.
PART_BYTES = 1 << 20
END = 10
LONG_TOKEN = 40


def normal(text: str | None) -> bytes:
    """The words of a text, A-Z lower-cased, joined by one space."""
    return b" ".join((text or "").encode("utf-8", "surrogatepass").lower().split())


def words(line: bytes) -> list[bytes]:
    return line.split(b" ") if line else []


def token_key(word: bytes) -> bytes:
    """A word as a key: itself, or for long ones a digest that no word can be equal to."""
    return word if len(word) <= LONG_TOKEN else b" " + hashlib.sha256(word).hexdigest().encode()


def stream(parts: list[bytes], depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams (depth bytes of context, then the symbol; in one uint64) of all symbols, and each text's symbols."""
    pad = bytes([END]) * depth
    s = np.frombuffer(b"".join(pad + p + bytes([END]) for p in parts), np.uint8)
    size = np.array([len(p) + 1 for p in parts], np.int64)
    if not len(s):
        return np.zeros(0, np.uint64), size
    g = np.zeros(len(s) - depth, np.uint64)
    for i in range(depth + 1):
        g = (g << np.uint64(8)) | s[i : len(s) - depth + i]
    real = np.ones(len(g), bool)  # symbols only, not the padding
    starts = np.cumsum(size + depth) - (size + depth)
    for i in range(depth):
        at = starts + i - depth
        real[at[at >= 0]] = False
    return g[real], size


def text_scores(keys: np.ndarray, value: np.ndarray, parts: list[bytes], depth: int) -> np.ndarray:
    """log10 probability of each text: the sum of its n-grams' values (keys are sorted and hold them all)."""
    grams, size = stream(parts, depth)
    order = np.argsort(grams)
    grams = grams[order]
    first = np.flatnonzero(np.append(True, grams[1:] != grams[:-1]))
    found = np.empty(len(grams))
    found[order] = np.repeat(value[np.searchsorted(keys, grams[first])], np.diff(np.append(first, len(grams))))
    return np.add.reduceat(found, np.cumsum(size) - size)


def count(keys: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and their total counts."""
    if n is None:
        return np.unique(keys, return_counts=True)
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[starts], np.add.reduceat(n, starts) if len(starts) else n


def lower_orders(keys: np.ndarray, n: np.ndarray, depth: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Counts of n-grams of each context length 0..depth from those of the longest."""
    out = {depth: (keys, n)}
    for k in range(depth - 1, -1, -1):
        out[k] = count(out[k + 1][0] & np.uint64((1 << 8 * (k + 1)) - 1), out[k + 1][1])
    return out


def gram_ranges(keys: np.ndarray, ranges: int, shared: int = SHARED) -> np.ndarray:
    h = ((keys >> np.uint64(8)) & np.uint64((1 << 8 * shared) - 1)) * np.uint64(0x9E3779B97F4A7C15)
    return (((h ^ (h >> np.uint64(31))) * np.uint64(0xC2B2AE3D27D4EB4F) >> np.uint64(40)) % np.uint64(ranges)).astype(np.int64)


def word_ranges(tokens: list[bytes], ranges: int) -> np.ndarray:
    return (np.fromiter(map(xxhash.xxh3_64_intdigest, tokens), np.uint64, len(tokens)) % np.uint64(ranges)).astype(np.int64)


def squeeze(data: bytes) -> bytes:
    return len(data).to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True)


def expand(blob: bytes) -> bytes:
    return pa.decompress(memoryview(blob)[8:], decompressed_size=int.from_bytes(blob[:8], "little"), codec="zstd", asbytes=True)


def planes(x: np.ndarray) -> bytes:
    """Numbers byte plane by byte plane, which compresses better."""
    return np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()


def unplanes(data: bytes, kind: str) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(width, -1).T).view(kind).ravel()


def pack_run(keys: np.ndarray, n: np.ndarray) -> bytes:
    return squeeze(planes(np.diff(keys, prepend=np.uint64(0)).astype("<u8")) + planes(n.astype("<u4")))


def unpack_run(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = expand(blob)
    n = len(raw) // 12
    return np.cumsum(unplanes(raw[: 8 * n], "<u8"), dtype=np.uint64), unplanes(raw[8 * n :], "<u4").astype(np.int64)


def pack_words(tokens: list[bytes], n: np.ndarray) -> bytes:
    return squeeze(planes(n.astype("<u4")) + b"\n".join(tokens))


def unpack_words(blob: bytes, size: int) -> tuple[list[bytes], np.ndarray]:
    raw = expand(blob)
    return raw[4 * size :].split(b"\n"), unplanes(raw[: 4 * size], "<u4").astype(np.int64)


@dataclass
class Tree:
    """For each order: sorted retained contexts with their weight for the suffix, sorted n-grams with their probability."""

    zero: np.ndarray = field(default_factory=lambda: np.full(256, 1 / 256))
    orders: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    def log10(self, grams: np.ndarray) -> np.ndarray:
        """log10 P(symbol | longest retained suffix of its context) of n-grams."""
        p = np.ones(len(grams))
        left = np.arange(len(grams))  # from the longest context down: found symbols are done, others pay the context's weight
        for k in range(len(self.orders), 0, -1):
            ctx, weight, keys, prob = self.orders[k - 1]
            if not len(left):
                break
            if not len(ctx):
                continue
            g = grams[left] & np.uint64((1 << 8 * (k + 1)) - 1)
            j = np.minimum(np.searchsorted(keys, g), len(keys) - 1)
            on = keys[j] == g
            p[left[on]] *= prob[j[on]]
            left, c = left[~on], g[~on] >> np.uint64(8)
            i = np.minimum(np.searchsorted(ctx, c), len(ctx) - 1)
            on = ctx[i] == c
            p[left[on]] *= weight[i[on]]
        p[left] *= self.zero[(grams[left] & np.uint64(255)).astype(np.int64)]
        return np.log10(p)


def frequent(keys: np.ndarray, n: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of contexts that occur at least so often."""
    c = keys >> np.uint64(8)
    starts = np.flatnonzero(np.append(True, c[1:] != c[:-1])) if len(c) else np.zeros(0, np.int64)
    if not len(starts):
        return keys, n
    keep = np.repeat(np.add.reduceat(n, starts) >= least, np.diff(np.append(starts, len(keys))))
    return keys[keep], n[keep]


def grow(candidates: dict[int, tuple[np.ndarray, np.ndarray]], bits: float = DIVERGENCE_BITS, always: int = 0) -> Tree:
    """The tree of the candidates' n-gram counts, by order; orders above 0 hold whole distributions of candidate contexts,
    and those of up to `always` are all retained."""
    tree = Tree()
    keys, n = candidates.get(0, (np.zeros(0, np.uint64), np.zeros(0, np.int64)))
    zero = np.bincount(keys.astype(np.int64), n, 256) if len(keys) else np.zeros(256)
    kinds = max(1, int((zero > 0).sum()))
    tree.zero = (zero + kinds / 256) / (zero.sum() + kinds)
    full = []  # every candidate, smoothed: (ctx, weight, keys, prob, gain of the context)
    made = Tree(tree.zero)
    for k in sorted(x for x in candidates if x):
        keys, n = candidates[k]
        if not len(keys):
            break
        c = keys >> np.uint64(8)
        starts = np.flatnonzero(np.append(True, c[1:] != c[:-1]))
        kinds = np.diff(np.append(starts, len(keys)))
        total = np.add.reduceat(n, starts)
        below = 10 ** made.log10(keys)
        own = n / np.repeat(total, kinds)
        gain = np.add.reduceat(n * np.log2(own / below), starts)
        prob = (n + np.repeat(kinds, kinds) * below) / np.repeat(total + kinds, kinds)
        full.append((c[starts], kinds / (total + kinds), keys, prob, gain))
        made.orders.append(full[-1][:4])
    needed = np.zeros(0, np.uint64)
    for k in range(len(full), 0, -1):
        ctx, weight, keys, prob, gain = full[k - 1]
        keep = (gain >= bits) | np.isin(ctx, needed) | (k <= always)
        needed = np.unique(ctx[keep] & np.uint64((1 << 8 * (k - 1)) - 1))
        stay = np.isin(keys >> np.uint64(8), ctx[keep])
        tree.orders.insert(0, (ctx[keep], weight[keep], keys[stay], prob[stay]))
    return tree


_TEXTS = pa.schema([("id", pa.int64()), ("learn", pa.bool_()), ("line", pa.binary())])
#: Rows of the counting pass: kind of data (below), block, range, number of entries, data.
_ROWS = "kind int, block long, part int, n long, data binary"
TEXTS, WORDS, GRAMS, LOW = range(4)


def _by_range(where: np.ndarray, ranges: int) -> Iterator[tuple[int, np.ndarray]]:
    """Each range that occurs, and the places where it does, ascending."""
    order = np.argsort(where, kind="stable")
    cuts = np.searchsorted(where[order], np.arange(ranges + 1))
    for r, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
        if b > a:
            yield r, order[a:b]


def _tokens(lines: list[bytes]) -> dict[bytes, int]:
    """The distinct words of a block (b"" is the end), numbered as they come."""
    seen = {b"": 0}
    for line in lines:
        for w in words(line):
            seen.setdefault(w, len(seen))
    return seen


def _grams(lines: list[bytes], depth: int) -> np.ndarray:
    """All n-grams of some texts, sorted."""
    g = np.empty(sum(map(len, lines)) + len(lines), np.uint64)
    at, held, size = 0, [], 0
    for line in [*lines, None]:
        if held and (line is None or size >= PART_BYTES):
            made = stream(held, depth)[0]
            g[at : at + len(made)] = made
            at, held, size = at + len(made), [], 0
        if line is not None:
            held.append(line)
            size += len(line)
    g.sort()
    return g


def _runs(g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of a sorted array, and their numbers."""
    first = np.flatnonzero(np.append(True, g[1:] != g[:-1])) if len(g) else np.zeros(0, np.int64)
    return g[first], np.diff(np.append(first, len(g)))


def count_block(ids: list, learn: list, lines: list[bytes], depth: int, ranges: int) -> Iterator[tuple[int, int, int, bytes]]:
    """(kind, range, entries, data) of a block."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, _TEXTS, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_batch(pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip((ids, learn, lines), _TEXTS, strict=True)], schema=_TEXTS))
    yield TEXTS, 0, len(ids), sink.getvalue().to_pybytes()
    seen: Counter = Counter()
    for line, on in zip(lines, learn, strict=True):
        if on:
            seen.update(words(line))
    seen[b""] = sum(learn)
    tokens = list(_tokens(lines))
    n = np.fromiter(map(seen.__getitem__, tokens), np.int64, len(tokens))
    tokens = [token_key(t) for t in tokens]
    for r, at in _by_range(word_ranges(tokens, ranges), ranges):
        yield WORDS, r, len(at), pack_words([tokens[i] for i in at.tolist()], n[at])
    del seen, tokens
    keys, n = _runs(_grams([x for x, on in zip(lines, learn, strict=True) if on], depth))
    low = count(keys & np.uint64((1 << 8 * SHARED) - 1), n)
    yield LOW, 0, len(low[0]), pack_run(*low)
    rest = _runs(_grams([x for x, on in zip(lines, learn, strict=True) if not on], depth))[0]
    if len(rest):  # held-out n-grams are asked for, with a count of 0
        keys, n = count(np.concatenate([keys, rest]), np.concatenate([n, np.zeros(len(rest), np.int64)]))
    for r, at in _by_range(gram_ranges(keys, ranges), ranges):
        yield GRAMS, r, len(at), pack_run(keys[at], n[at])


def _count(depth: int, ranges: int, block_bytes: int):
    """Rows (id, learn, text) to rows of _ROWS, block by block as rows come."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 32
        ids, learn, lines, size = [], [], [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            for kind, part, n, data in count_block(ids, learn, lines, depth, ranges):
                yield pa.RecordBatch.from_arrays([pa.array([kind], pa.int32()), pa.array([block], pa.int64()), pa.array([part], pa.int32()), pa.array([n], pa.int64()), pa.array([data], pa.binary())], names=["kind", "block", "part", "n", "data"])

        for batch in batches:
            for i in range(batch.num_rows):
                ids.append(batch.column(0)[i].as_py())
                learn.append(batch.column(1)[i].as_py())
                lines.append(normal(batch.column(2)[i].as_py()))
                size += len(lines[-1]) + 100
                if size >= block_bytes:
                    yield from flush()
                    block += 1
                    ids, learn, lines, size = [], [], [], 0
        if ids:
            yield from flush()

    return run


def merge_words(d: pd.DataFrame) -> pd.DataFrame:
    """Of a range of words: what each block asked for, and the corpus' numbers (tokens and distinct tokens of training texts)."""
    known: dict[bytes, int] = {}
    get = known.get
    for data, size in zip(d["data"], d["n"].tolist(), strict=True):
        tokens, n = unpack_words(data, size)
        for w, k in zip(tokens, n.tolist(), strict=True):
            known[w] = get(w, 0) + k
    out = [(-1, sum(known.values()), sum(k > 0 for k in known.values()), b"")]
    for block, data, size in zip(d["block"].tolist(), d["data"], d["n"].tolist(), strict=True):
        found = np.fromiter(map(known.__getitem__, unpack_words(data, size)[0]), np.int64, size)
        out.append((block, 0, 0, squeeze(planes(found.astype("<u8")))))
    made = pd.DataFrame(out, columns=["block", "total", "kinds", "data"])
    made["part"] = d["part"].iloc[0]
    return made[["block", "part", "total", "kinds", "data"]]


def merge_grams(low, depth: int, least: int, bits: float):
    """Of a range of n-grams: the log-probabilities that each block asked for."""

    def run(d: pd.DataFrame) -> pd.DataFrame:
        asked = [unpack_run(x) for x in d["data"]]
        keys, n = count(np.concatenate([x for x, _ in asked]), np.concatenate([x for _, x in asked]))
        on = n > 0
        orders = lower_orders(keys[on], n[on], depth)
        tree = grow(low.value | {k: frequent(*v, least) for k, v in orders.items() if k >= SHARED}, bits, SHARED - 1)
        value = tree.log10(keys).astype("<f4")
        made = [(block, squeeze(planes(value[np.searchsorted(keys, x)]))) for block, (x, _) in zip(d["block"].tolist(), asked, strict=True)]
        made = pd.DataFrame(made, columns=["block", "data"])
        made["part"] = d["part"].iloc[0]
        return made[["block", "part", "data"]]

    return run


def _score_block(n_tokens: int, kinds: int, depth: int, ranges: int):
    def run(d: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        with pa.ipc.open_stream(d["data"].iloc[0]) as r:
            ids, learn, lines = (c.to_pylist() for c in r.read_all().columns)
        mine = {(kind, part): data for kind, part, data in zip(answers["kind"].tolist(), answers["part"].tolist(), answers["data"], strict=True)}
        number = _tokens(lines)
        tokens = [token_key(t) for t in number]
        c = np.zeros(len(tokens), np.int64)
        for part, at in _by_range(word_ranges(tokens, ranges), ranges):
            c[at] = unplanes(expand(mine[WORDS, part]), "<u8").astype(np.int64)
        del tokens
        low = math.log10(n_tokens + kinds + 1)
        sizes = np.fromiter((line.count(b" ") + 2 if line else 1 for line in lines), np.int64, len(lines))
        at = np.fromiter((number[w] for line in lines for w in (*words(line), b"")), np.int64, int(sizes.sum()))
        del number
        starts = np.cumsum(sizes) - sizes
        out = {"id": pd.array(ids, dtype="Int64"), "learn": learn, "n_tokens": sizes}
        out["n_known"] = np.add.reduceat((c > 0)[at].astype(np.int64), starts)
        out["base_score"] = np.add.reduceat((np.log10(c + 1.0) - low)[at], starts)
        del at
        keys = _runs(_grams(lines, depth))[0]
        value = np.zeros(len(keys))
        for part, at in _by_range(gram_ranges(keys, ranges), ranges):
            value[at] = unplanes(expand(mine[GRAMS, part]), "<f4")
        scores, held, size = [], [], 0
        for line in lines:
            held.append(line)
            size += len(line)
            if size >= PART_BYTES:
                scores.append(text_scores(keys, value, held, depth))
                held, size = [], 0
        if held:
            scores.append(text_scores(keys, value, held, depth))
        out["score"] = np.concatenate(scores)
        return pd.DataFrame(out)

    return run


def lm_score(df: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", depth: int = DEPTH, least: int = LEAST, bits: float = DIVERGENCE_BITS, block_bytes: int = BLOCK_BYTES, least_ranges: int = LEAST_RANGES) -> DataFrame:
    """One row per input row: id_col, held_out, n_tokens, n_known, train_tokens, base_score, score (log10 each).

    learn: which rows are learned from; depth: bytes of context, SHARED to 7; least: how often a context must occur."""
    spark = df.sparkSession
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(learn, F.lit(False)).alias("learn"), F.col(text_col).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = max(least_ranges, 2 * math.ceil(total / block_bytes))
    counted = store(rows.mapInArrow(_count(depth, ranges, block_bytes), _ROWS), "kind")
    texts = counted.where(F.col("kind") == TEXTS)

    def unpacked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in batches:
            for x in d["data"]:
                keys, n = unpack_run(x)
                yield pd.DataFrame({"k": keys.view(np.int64), "n": n})

    few = counted.where(F.col("kind") == LOW).select("data").mapInPandas(unpacked, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).toPandas().sort_values("k")  # 256**SHARED rows at most
    few = (few["k"].to_numpy(np.int64).view(np.uint64), few["n"].to_numpy(np.int64))
    shared = spark.sparkContext.broadcast(lower_orders(*few, SHARED - 1))
    tasks = partitions(spark, ranges // 4)
    by_range = lambda kind: counted.where(F.col("kind") == kind).select("block", "part", "n", "data").repartition(tasks, "part").groupBy("part")
    counts = store(by_range(WORDS).applyInPandas(merge_words, "block long, part int, total long, kinds long, data binary"))
    n, kinds = counts.where("block = -1").agg(F.sum("total"), F.sum("kinds")).first()
    n, kinds = n or 0, kinds or 0
    probabilities = by_range(GRAMS).applyInPandas(merge_grams(shared, depth, least, bits), "block long, part int, data binary")
    blocks = partitions(spark, texts.count())
    answers = counts.where("block >= 0").select(F.lit(WORDS).alias("kind"), "block", "part", "data").unionByName(probabilities.select(F.lit(GRAMS).alias("kind"), "block", "part", "data"))
    answers = answers.repartition(blocks, "block").groupBy("block")
    scored = texts.select("block", "data").repartition(blocks, "block").groupBy("block").cogroup(answers)
    scored = scored.applyInPandas(_score_block(n, kinds, depth, ranges), "id long, learn boolean, n_tokens long, n_known long, base_score double, score double")
    return scored.select(F.col("id").alias(id_col), (~F.col("learn")).alias("held_out"), "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")
