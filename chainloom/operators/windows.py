"""Window frames that Spark SQL can't spell."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def groups_frame(df: DataFrame, value: Column, name: str, partition: list[str], order: list[Column], start: int, end: int) -> DataFrame:
    """value (an aggregate) over GROUPS BETWEEN start AND end peer groups (negative: preceding), as column `name`."""
    ranked = df.withColumn("__peer", F.dense_rank().over(Window.partitionBy(*partition).orderBy(*order)))
    return ranked.withColumn(name, value.over(Window.partitionBy(*partition).orderBy("__peer").rangeBetween(start, end))).drop("__peer")
