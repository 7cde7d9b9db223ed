"""Rows as JSON values."""

from __future__ import annotations

import datetime as dt
import math
from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .errors import EngineError

MAX_PAGE = 10_000


def check_columns(df: DataFrame) -> None:
    """Output names, and field names of structs, must be unique."""

    def visit(kind) -> None:
        if isinstance(kind, T.StructType):
            names = kind.fieldNames()
            if len(set(names)) < len(names):
                raise EngineError("two outputs have one name")
            for f in kind.fields:
                visit(f.dataType)
        elif isinstance(kind, T.ArrayType):
            visit(kind.elementType)
        elif isinstance(kind, T.MapType):
            if not isinstance(kind.keyType, T.StringType):
                raise EngineError("map keys must be text")
            visit(kind.valueType)
        elif not isinstance(kind, (T.NullType, T.BooleanType, T.NumericType, T.StringType, T.BinaryType, T.DateType, T.TimeType, T.TimestampType, T.TimestampNTZType, T.DayTimeIntervalType, T.YearMonthIntervalType)):
            raise EngineError(f"{kind.simpleString()} has no JSON form")

    visit(df.schema)


def json_value(value, kind: T.DataType):
    if value is None:
        return None
    if isinstance(kind, T.StructType):
        return {f.name: json_value(v, f.dataType) for f, v in zip(kind.fields, value, strict=True)}
    if isinstance(kind, T.ArrayType):
        return [json_value(v, kind.elementType) for v in value]
    if isinstance(kind, T.MapType):
        return {k: json_value(v, kind.valueType) for k, v in value.items()}
    if isinstance(value, float):
        return value if math.isfinite(value) else None
    if isinstance(value, Decimal):
        if isinstance(kind, T.DecimalType) and kind.precision == 20 and kind.scale == 0:
            return int(value)  # stands for an unsigned 64-bit number
        return format(value, "f")
    if isinstance(value, (bytes, bytearray)):
        return bytes(value).hex()
    if isinstance(value, (dt.datetime, dt.date, dt.time)):
        return value.isoformat()
    if isinstance(value, dt.timedelta):
        return f"PT{value.total_seconds():g}S"
    return value


def json_rows(df: DataFrame) -> list[dict]:
    check_columns(df)
    return [json_value(row, df.schema) for row in df.collect()]


def page(df: DataFrame, limit: int | None, offset: int = 0) -> DataFrame:
    """Pages the result of a query, after its own LIMIT and OFFSET."""
    df = df.offset(offset) if offset else df
    return df if limit is None else df.limit(limit)
