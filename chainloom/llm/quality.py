"""Quality classifier: a generalised additive model with pairwise interactions.

A text becomes some twenty plain features (shape of words and lines, shares of character classes,
repetition). Features are cut into quantile bins. Cyclic boosting visits one feature after the other with a
small learning rate and fits a shallow tree on it alone; all trees of a feature add up to one
lookup table. Then the pairs with most left to explain get two-dimensional tables the same way. A score is the
sigmoid of the sum of table entries: pure vectorised additions of bins, and each part can be read and plotted.

Training is on a bounded sample of labelled rows (`max_train_rows` different ones at most, chosen by hashes of id and
text, so the same rows at any layout and size); scoring is one narrow pass over whole texts, nothing is shuffled.

Defined results: null and empty texts have all-zero features and are scored like any text; null labels and labels of
unknown ids are not learned from; of several labels of an id the larger one counts; rows that repeat id and text are learned
from once and each scored; without any label every score is 0.5.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, spread_rows, within_quota

MAX_TRAIN_ROWS, ROUNDS, RATE, BINS, PAIRS, PAIR_BINS = 20_000, 150, 0.1, 32, 8, 8
THRESHOLD = 0.3
FEATURES = (
    "log_chars", "log_words", "word_len", "long_words", "short_words", "unique_words", "top_word", "upper", "digits", "space",
    "bars", "bangs", "marks", "other_punct", "commas", "non_ascii", "ends", "words_marked", "lines", "unique_lines", "line_len", "deflated", "mixed_words", "caps_words",
)

_ASCII = bytes(range(128))
_CLASSES = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digits": b"0123456789", "space": b" \t\n\r\x0b\x0c", "bars": b"|", "bangs": b"!",
    "marks": b"*#%$&@~^=<>{}[]\\/_+", "other_punct": b"\"'`()-;:?", "commas": b",", "non_ascii": _ASCII, "ends": b".",
}
_PUNCT = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def features(text: str | None) -> list[float]:
    b = (text or "").encode("utf-8", "surrogatepass")
    words = b.split()
    if not words:
        return [0.0] * len(FEATURES)
    n, w = len(b), len(words)
    share = {k: (n - len(b.translate(None, v))) / n for k, v in _CLASSES.items()}
    share["non_ascii"] = 1 - share["non_ascii"]
    size = np.fromiter(map(len, words), np.int64, w)
    counts = Counter(words)
    bare = b" ".join(words).translate(None, _PUNCT).split(b" ")
    marked = sum(len(x) + 1 < len(y) for x, y in zip(bare, words, strict=True))
    lines = b.split(b"\n")
    caps = sum(x.isupper() and len(x) > 1 for x in words)
    squeezed = zlib.compressobj(1)
    packed = len(squeezed.compress(b)) + len(squeezed.flush())
    return [
        np.log1p(n), np.log1p(w), size.mean(), (size > 12).mean(), (size < 4).mean(), len(counts) / w, max(counts.values()) / w, share["upper"], share["digits"], share["space"],
        share["bars"], share["bangs"], share["marks"], share["other_punct"], share["commas"], share["non_ascii"], share["ends"], marked / w, np.log1p(len(lines)), len(set(lines)) / len(lines), np.log1p(n / len(lines)), packed / (n + 50), size.std(), caps / w,
    ]


@dataclass
class Model:
    """Bin edges and tables; `pairs` are (i, j) with their edges and 2-d tables."""

    base: float = 0.0
    edges: list[np.ndarray] = field(default_factory=lambda: [np.zeros(0) for _ in FEATURES])
    tables: list[np.ndarray] = field(default_factory=lambda: [np.zeros(1) for _ in FEATURES])
    pairs: list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.base)
        for i, (e, t) in enumerate(zip(self.edges, self.tables, strict=True)):
            z += t[np.searchsorted(e, x[:, i], side="right")]
        for i, j, e, f, t in self.pairs:
            z += t[np.searchsorted(e, x[:, i], side="right"), np.searchsorted(f, x[:, j], side="right")]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _quantiles(v: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(v, np.arange(1, bins) / bins, method="higher"))


def _gain(g, h, ridge):
    return g * g / (h + ridge)


def _tree(g: np.ndarray, h: np.ndarray, depth: int, ridge: float) -> np.ndarray:
    """A tree of one feature: sums of gradients and hessians by bin in, value by bin out."""
    out = np.full(len(g), g.sum() / (h.sum() + ridge))
    if depth and len(g) > 1:
        a, b = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
        gains = _gain(a, b, ridge) + _gain(g.sum() - a, h.sum() - b, ridge)
        at = int(gains.argmax()) + 1
        if gains[at - 1] > _gain(g.sum(), h.sum(), ridge) + 1e-9:
            out[:at], out[at:] = _tree(g[:at], h[:at], depth - 1, ridge), _tree(g[at:], h[at:], depth - 1, ridge)
    return out


def _pair_tree(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[np.ndarray, float]:
    """A cut of the first feature, then one of the second on either side; the values, and what they gain."""
    best, value = -1.0, np.zeros_like(g)
    for at in range(1, len(g)):
        made = np.zeros_like(g)
        total = 0.0
        for rows in (slice(0, at), slice(at, None)):
            gs, hs = g[rows].sum(0), h[rows].sum(0)
            t = _tree(gs, hs, 1, ridge)
            total += float((2 * t * gs - t * t * (hs + ridge / len(t))).sum())
            made[rows] = t
        if total > best:
            best, value = total, made
    return value, best


def fit(x: np.ndarray, y: np.ndarray, rounds: int = ROUNDS, rate: float = RATE, bins: int = BINS, pairs: int = PAIRS, pair_bins: int = PAIR_BINS, ridge: float = 1.0) -> Model:
    n, m = x.shape if len(x) else (0, len(FEATURES))
    model = Model()
    if not n or y.min() == y.max():
        model.base = 0.0 if not n else float(np.log((y.sum() + 1) / (n - y.sum() + 1)))
        return model
    rare = min(y.mean(), 1 - y.mean())
    model.base = float(np.log(y.mean() / (1 - y.mean())))
    model.edges = [_quantiles(x[:, i], bins) for i in range(m)]
    at = [np.searchsorted(e, x[:, i], side="right") for i, e in enumerate(model.edges)]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    z = np.full(n, model.base)
    ridge = ridge + 10 * rare  # steadier leaves where one class is common
    for _ in range(rounds):
        for i in range(m):
            p = 1 / (1 + np.exp(-z))
            g, h = np.bincount(at[i], y - p, len(model.tables[i])), np.bincount(at[i], p * (1 - p), len(model.tables[i]))
            step = rate * _tree(g, h, 2, ridge)
            model.tables[i] += step
            z += step[at[i]]
    coarse = [_quantiles(x[:, i], pair_bins) for i in range(m)]
    cell = [np.searchsorted(e, x[:, i], side="right") for i, e in enumerate(coarse)]

    def sums(i, j, v):
        shape = (len(coarse[i]) + 1, len(coarse[j]) + 1)
        return np.bincount(cell[i] * shape[1] + cell[j], v, shape[0] * shape[1]).reshape(shape)

    p = 1 / (1 + np.exp(-z))
    found = sorted(((_pair_tree(sums(i, j, y - p), sums(i, j, p * (1 - p)), ridge)[1], i, j) for i in range(m) for j in range(i + 1, m)), reverse=True)[:pairs]
    tables = [[i, j, coarse[i], coarse[j], np.zeros((len(coarse[i]) + 1, len(coarse[j]) + 1))] for _, i, j in found]
    for _ in range(rounds // 2):
        for t in tables:
            p = 1 / (1 + np.exp(-z))
            step = rate * _pair_tree(sums(t[0], t[1], y - p), sums(t[0], t[1], p * (1 - p)), ridge)[0]
            t[4] += step
            z += step[cell[t[0]], cell[t[1]]]
    model.pairs = [tuple(t) for t in tables]
    return model


def _feature_column():
    @F.pandas_udf("array<double>")
    def f(s: pd.Series) -> pd.Series:
        return pd.Series([features(t) for t in s], dtype=object)

    return f


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", learn: Column | None = None, max_train_rows: int = MAX_TRAIN_ROWS, **options) -> Model:
    """Learns from labelled rows for which `learn` (a condition on id_col) holds; max_train_rows of them at most."""
    known = labels.select(F.col(id_col), F.col(label_col).cast("int").alias("__y")).where(F.col(id_col).isNotNull() & F.col("__y").isin(0, 1))
    rows = docs.select(F.col(id_col), F.col(text_col))
    if learn is not None:
        rows, known = rows.where(learn), known.where(learn)
    rows = rows.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    known = known.groupBy(F.col(id_col).alias("id")).agg(F.max("__y").alias("y"))
    total = known.count()
    if total > 2 * max_train_rows:  # ids first, so that no text is read that isn't likely to be learned from
        known = known.where(F.xxhash64(F.lit("train"), "id") / F.lit(2.0**64) + 0.5 <= F.lit(2 * max_train_rows / total))
    known = known.select("id", F.col("y").alias("kind"))
    rows = rows.join(F.broadcast(known), "id")  # some 2 * max_train_rows ids at most
    sample = spread_rows(bounded_sample(rows, "kind", max_train_rows), "h").select("h", "id", "kind", "quota", _feature_column()("text").alias("x"))
    found = within_quota(sample.collect(), "kind")
    x = np.array([r["x"] for r in found], dtype=np.float64).reshape(len(found), len(FEATURES))
    return fit(x, np.array([r["kind"] for r in found], np.float64), **options)


def scorer(model: Model, spark):
    """A column function: the score of a text."""
    shared = spark.sparkContext.broadcast(model)  # a few thousand numbers, whatever the data

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            x = np.array([features(t) for t in s], dtype=np.float64).reshape(len(s), len(FEATURES))
            yield pd.Series(shared.value.score(x))

    return score


def keep_good(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that the model accepts, with all their columns."""
    return docs.where(scorer(model, docs.sparkSession)(F.col(text_col)) >= threshold)
