"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Character 1- to 3-grams of the lower-cased text are hashed to 2**BITS features with sublinear term counts;
document frequencies are counted over all learning documents (one bounded vector a partition). Weights are learned
by follow-the-regularised-leader (per-coordinate rates, L1 and L2 penalties: most weights are exactly zero) on a
bounded sample of `max_train_rows` different rows, with LEAST_ROWS of each language at least (all, if it has no more), chosen
by hashes of id and text, then one
temperature is fitted on a held-back fifth of each language's sample (rounded down) so that scores are probabilities. Prediction is one narrow pass over whole texts.

Defined results: texts that are null or have no letter get `und` with score 0; with nothing to learn from all get `und`;
rows that repeat id and text are learned from once, and each predicted; very long texts are counted part by part, whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, spread_rows, within_quota

BITS, MOST_N, MAX_TRAIN_ROWS, EPOCHS = 15, 3, 4000, 3
#: Rows of each language in the sample at least, four fifths of them for training.
LEAST_ROWS = 50
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.02
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]
#: Characters hashed at a time.
PART = 1 << 18


def counts(text: str, most_n: int = MOST_N, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-gram features of a text and how often each occurs; white space and digits collapse to one space."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    total = np.zeros(1 << bits, np.int64)
    for at in range(0, len(c), PART):
        part = c[max(0, at - most_n + 1) : at + PART].astype(np.uint64)
        old = min(at, most_n - 1)  # characters seen before: only n-grams that end behind them are new
        part[part < 65] = 32  # digits, punctuation and controls
        h = np.zeros(len(part), np.uint64)
        for n in range(1, most_n + 1):
            h = (part if n == 1 else (h[:-1] ^ (part[n - 1 :] * _MIX[1]))) * _MIX[0]
            h ^= h >> np.uint64(29)
            k = ((h * _MIX[2]) >> np.uint64(64 - bits)).astype(np.int64)
            total += np.bincount(k[max(0, old - n + 1) :], minlength=1 << bits)
    on = np.flatnonzero(total)
    return on, total[on]


def has_letter(text: str | None) -> bool:
    return bool(text) and any(ch.isalpha() for ch in text)


def vector(text: str, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    on, n = counts(text)
    v = (1 + np.log(n)) * idf[on]
    return on, v / (np.sqrt((v * v).sum()) or 1.0)


@dataclass
class Model:
    langs: list[str]
    idf: np.ndarray
    weights: np.ndarray  # classes x (features + bias)
    temperature: float = 1.0

    def logits(self, on: np.ndarray, v: np.ndarray) -> np.ndarray:
        return self.weights[:, on] @ v + self.weights[:, -1]

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.langs or not has_letter(text):
            return "und", 0.0
        p = _softmax(self.logits(*vector(text, self.idf)) / self.temperature)
        return self.langs[int(p.argmax())], float(p.max())


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], classes: int, width: int, epochs: int = EPOCHS, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2) -> np.ndarray:
    """FTRL-proximal with elastic-net penalties, one row at a time, in a fixed shuffled order."""
    z, n, w = (np.zeros((classes, width + 1)) for _ in range(3))
    order = np.random.default_rng(7).permutation(len(rows))
    for _ in range(epochs):
        for r in order:
            on, v, y = rows[r]
            on, v = np.append(on, width), np.append(v, 1.0)
            zs, ns = z[:, on], n[:, on]
            ws = np.where(np.abs(zs) <= l1, 0.0, -(zs - np.sign(zs) * l1) / ((beta + np.sqrt(ns)) / alpha + l2))
            p = _softmax(ws @ v)
            p[y] -= 1
            g = p[:, None] * v
            s = (np.sqrt(ns + g * g) - np.sqrt(ns)) / alpha
            z[:, on] = zs + g - s * ws
            n[:, on] = ns + g * g
    w = np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2))
    return w


def calibrate(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature with the least log loss, by golden-section search over its logarithm."""
    if not len(y):
        return 1.0

    def loss(t: float) -> float:
        return -np.log(_softmax(logits / np.exp(t))[np.arange(len(y)), y] + 1e-12).mean()

    lo, hi, r = np.log(0.02), np.log(50.0), (5**0.5 - 1) / 2
    for _ in range(60):
        a, b = hi - r * (hi - lo), lo + r * (hi - lo)
        lo, hi = (lo, b) if loss(a) < loss(b) else (a, hi)
    return float(np.exp((lo + hi) / 2))


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", learn: Column | None = None, max_train_rows: int = MAX_TRAIN_ROWS) -> Model:
    """Learns from the rows with text and language for which `learn` holds; document frequencies are of all of them."""
    rows = docs if learn is None else docs.where(learn)
    rows = rows.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("text IS NOT NULL AND lang IS NOT NULL")
    width = 1 << BITS

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(width, np.int64), 0
        for b in batches:
            for t in b.column(0).to_pylist():
                total[counts(t)[0]] += 1
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array(np.append(np.arange(width), -1)), pa.array(np.append(total, n))], names=["k", "n"])

    found = rows.select("text").mapInArrow(frequencies, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).collect()  # 2**BITS + 1 rows
    df = np.zeros(width + 1)
    for r in found:
        df[r["k"]] = r["n"]
    total = df[-1]
    idf = np.log((1 + total) / (1 + df[:-1])) + 1

    @F.pandas_udf("struct<k:array<int>,n:array<int>>")
    def sparse(s: pd.Series) -> pd.DataFrame:
        both = [counts(t) for t in s]
        return pd.DataFrame({"k": [k.astype(np.int32) for k, _ in both], "n": [n.astype(np.int32) for _, n in both]})

    few = spread_rows(bounded_sample(rows, "lang", max_train_rows, LEAST_ROWS), "h")
    sample = within_quota(few.select("h", "id", "lang", "quota", sparse("text").alias("s")).select("h", "id", "lang", "quota", "s.k", "s.n").collect(), "lang")
    langs = sorted({r["lang"] for r in sample})
    if not langs:
        return Model([], idf, np.zeros((0, width + 1)))
    data = []
    for r in sample:
        on = np.array(r["k"], np.int64)
        v = (1 + np.log(np.array(r["n"], np.float64))) * idf[on]
        data.append((on, v / (np.sqrt((v * v).sum()) or 1.0), langs.index(r["lang"])))
    seen, train_rows, back = [0] * len(langs), [], []
    for x in data:
        seen[x[2]] += 1
        (back if len(data) >= 50 and seen[x[2]] % 5 == 0 else train_rows).append(x)
    model = Model(langs, idf, ftrl(train_rows, len(langs), width))
    if back:
        model.temperature = calibrate(np.array([model.logits(on, v) for on, v, _ in back]), np.array([y for *_, y in back]))
    return model


def predictor(model: Model, spark):
    """A column function: struct of lang_pred and score."""
    shared = spark.sparkContext.broadcast(model)  # (classes + 1) x 2**BITS numbers, whatever the data

    @F.pandas_udf("struct<lang_pred:string,score:double>")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            found = [shared.value.predict(t) for t in s]
            yield pd.DataFrame({"lang_pred": [x for x, _ in found], "score": [x for _, x in found]})

    return predict
