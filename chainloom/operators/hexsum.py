"""Exact sums of hexadecimal payloads as unsigned big-endian integers of any length, as base-10 text.

Payloads of up to 35 bytes are split into 56-bit limbs that are plain columns, summed with map-side combination, all in
generated code. Longer ones are first added up by group within each Arrow batch. Then limbs are summed per group and
position, and each group's few limb sums are put together once. No payload is ever shuffled.
"""

from __future__ import annotations

import functools
import operator
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Hex digits of a limb, and the payload bytes up to which limbs are plain columns.
DIGITS, SHORT_BYTES = 14, 35


def _combine():
    @F.pandas_udf("string")
    def combine(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for limbs, values, n in batches:
            yield pd.Series([None if not k else str(sum(int(v) << (4 * DIGITS * int(i)) for i, v in zip(a, b, strict=True))) for a, b, k in zip(limbs, values, n, strict=True)], dtype=object)

    return combine


def _batch_sums(n_keys: int, n_values: int):
    """Sums of an Arrow batch by group, as 0x texts: long payloads are added here rather than limb by limb."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [c.to_pylist() for c in batch.columns]
            keys = list(zip(*columns[:n_keys], strict=True)) if n_keys else [()] * batch.num_rows
            totals: dict[tuple, int] = {}
            for v in range(n_values):
                for k, p in zip(keys, columns[n_keys + v], strict=True):
                    if p is not None and len(p) > 2:
                        totals[*k, v] = totals.get((*k, v), 0) + int(p, 16)
            if totals:
                made = list(zip(*totals, strict=True))
                arrays = [pa.array(x, batch.column(i).type) for i, x in enumerate(made[:-1])] + [pa.array(made[-1], pa.int32()), pa.array([hex(t) for t in totals.values()], pa.string())]
                yield pa.RecordBatch.from_arrays(arrays, names=[f"k{i}" for i in range(n_keys)] + ["v", "total"])

    return run


def _parts_of(parts: Column, which: int) -> Column:
    return F.filter(parts, lambda p: p["v"] == which)


def hex_limbs(value: Column) -> Column:
    """Limbs of a 0x payload, the lowest first."""
    digits = F.substring(value, 3, 2**31 - 1)
    count = F.ceil(F.length(digits) / DIGITS).cast("int")
    padded = F.lpad(digits, count * DIGITS, "0")
    one = lambda i: F.conv(F.substr(padded, (count - 1 - i) * DIGITS + 1, F.lit(DIGITS)), 16, 10).cast("decimal(20,0)")
    return F.when(count > 0, F.transform(F.sequence(F.lit(0), count - 1), one)).otherwise(F.array().cast("array<decimal(20,0)>"))


def sums(df: DataFrame, keys: list[str], values: dict[str, tuple[Column, Column]], most_bytes: int | None = None) -> DataFrame:
    """One row per group: the keys and, for each name, the exact sum as text (NULL without a non-null input).

    values: name -> (payload column or NULL, signed integer column or NULL); a row adds what isn't null.
    Payloads of up to SHORT_BYTES are added limb by limb inside the one aggregate; only longer ones take a second branch.
    most_bytes: an upper bound of the payload lengths, if known (a longer one is an error): up to SHORT_BYTES there is no such branch."""
    short = most_bytes is not None and most_bytes <= SHORT_BYTES
    aggregates, named = [], {}
    rows = df
    for i, (name, (payload, number)) in enumerate(values.items()):
        rows = rows.withColumn(f"__p{i}", payload).withColumn(f"__n{i}", number.cast("decimal(38,0)"))
        named[name] = i
        aggregates += [F.count(f"__p{i}").alias(f"__c{i}"), F.count(f"__n{i}").alias(f"__d{i}"), F.sum(f"__n{i}").alias(f"__s{i}")]
        long = F.length(f"__p{i}") > 2 + 2 * SHORT_BYTES
        few = F.when(long, F.raise_error(F.lit(f"a payload is longer than {most_bytes} bytes")).cast("string") if short else F.lit("0x")).otherwise(F.col(f"__p{i}"))
        padded = F.lpad(F.substring(few, 3, 2 * SHORT_BYTES), 2 * SHORT_BYTES, "0")
        for k in range(2 * SHORT_BYTES // DIGITS):
            limb = F.conv(F.substring(padded, 2 * SHORT_BYTES - DIGITS * (k + 1) + 1, DIGITS), 16, 10).cast("decimal(20,0)")
            aggregates.append(F.sum(limb).alias(f"__l{i}_{k}"))
    combine = _combine()
    out = rows.groupBy(*keys).agg(*aggregates)
    limbs = {i: (F.array(*[F.lit(k) for k in range(2 * SHORT_BYTES // DIGITS)]), F.array(*[F.coalesce(f"__l{i}_{k}", F.lit(0)).cast("string") for k in range(2 * SHORT_BYTES // DIGITS)])) for i in named.values()}
    if not short:
        is_long = {i: F.length(f"__p{i}") > 2 + 2 * SHORT_BYTES for i in named.values()}
        payloads = rows.where(functools.reduce(operator.or_, is_long.values())).select(*keys, *[F.when(x, F.col(f"__p{i}")).cast("string").alias(f"__p{i}") for i, x in is_long.items()])
        fields = [T.StructField(f"k{n}", payloads.schema[k].dataType) for n, k in enumerate(keys)]
        kinds = T.StructType([*fields, T.StructField("v", T.IntegerType()), T.StructField("total", T.StringType())])
        sums_ = payloads.toDF(*[f"k{n}" for n in range(len(keys))], *[f"p{i}" for i in named.values()]).mapInArrow(_batch_sums(len(keys), len(named)), kinds).toDF(*keys, "v", "total")
        parts = sums_.select(*keys, "v", F.posexplode(hex_limbs(F.col("total"))).alias("limb", "value")).groupBy(*keys, "v", "limb").agg(F.sum("value").alias("value"))
        per = parts.groupBy(*keys).agg(F.collect_list(F.struct("v", "limb", F.col("value").cast("string").alias("value"))).alias("__parts"))
        if keys:
            mark = [F.col(k).isNull().alias(f"__z{n}") for n, k in enumerate(keys)] + [F.coalesce(F.col(k), F.lit("")).alias(f"__k{n}") for n, k in enumerate(keys)]
            names = [f"__z{n}" for n in range(len(keys))] + [f"__k{n}" for n in range(len(keys))]
            out = out.select("*", *mark).join(per.select(*mark, "__parts"), names, "left").drop(*names)
        else:
            out = out.withColumn("__one", F.lit(1)).join(per.withColumn("__one", F.lit(1)), "__one", "left").drop("__one")  # a row and a row
        found = F.coalesce("__parts", F.array().cast("array<struct<v:int,limb:int,value:string>>"))
        own = {i: _parts_of(found, i) for i in named.values()}
        limbs = {i: (F.concat(limbs[i][0], F.transform(x, lambda p: p["limb"])), F.concat(limbs[i][1], F.transform(x, lambda p: p["value"]))) for i, x in own.items()}
    picked = []
    for name, i in named.items():
        a, b = limbs[i]
        a = F.concat(a, F.array(F.lit(0)))
        b = F.concat(b, F.array(F.coalesce(f"__s{i}", F.lit(0)).cast("string")))
        picked.append(combine(a, b, (F.col(f"__c{i}") + F.col(f"__d{i}")).cast("long")).alias(name))
    return out.select(*keys, *picked)


def order_key(total: Column, descending: bool = False) -> list[Column]:
    """Sort keys that put base-10 texts in numeric order, NULL as the largest."""
    negative = total.startswith("-")
    size = F.when(negative, -F.length(total)).otherwise(F.length(total))
    digits = F.when(negative, F.translate(total, "0123456789", "9876543210")).otherwise(total)
    keys = [F.when(negative, 0).otherwise(1), size, digits]
    return [k.desc_nulls_first() if descending else k.asc_nulls_last() for k in (total.isNull(), *keys)]
