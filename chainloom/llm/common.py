"""What the operators share: the shared folder, checkpoints, folds and ASCII lower-casing."""

from __future__ import annotations

import math
import os
import string
import tempfile
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of the text contracts: [\x20\x09-\x0D].
SPACES = " \t\n\x0b\x0c\r"
#: What a batch of rows on its way to Python takes at most (but for one long row), and a file of few rows at least.
BATCH_BYTES, FILE_BYTES = 4 << 20, 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own in local mode."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
            spark.sparkContext.setCheckpointDir(found)
        return found
    now = spark.sparkContext._jsc.sc().getCheckpointDir()
    if now.isDefined():
        return now.get()
    if not (spark.sparkContext.master + "[").startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    own = os.path.join(tempfile.gettempdir(), f"chainloom-checkpoints-{os.getuid()}")
    spark.sparkContext.setCheckpointDir(own)
    return own


def small_batches(spark: SparkSession) -> None:
    """Batches for Python by bytes, so that a worker's memory doesn't follow the texts' lengths; a size that the session was
    given is left. A plan takes the size when it is run, so it is set for the session."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, str(BATCH_BYTES))


def gathered(df: DataFrame, n_bytes: int) -> DataFrame:
    """Rows of some n_bytes in as few partitions as fit, one a core at least, without a move: where Hadoop has no native library,
    executors start processes for each local file that they write, however small."""
    return df.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, math.ceil(n_bytes / FILE_BYTES)))


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared folder: lost executors don't lose it, and lineage ends here."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else. For pure ASCII text (bytes == characters), lower() does just that, faster."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    )


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, mod n; null ids are in fold 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % n, F.lit(0)).cast("int")


def spread(df: DataFrame) -> DataFrame:
    """A scan of fewer splits than cores (a small table, or one of a single row group), dealt over all cores before heavy
    work on its rows; any other is left as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def spread_rows(df: DataFrame, by: str) -> DataFrame:
    """Few rows that much is to be done with, dealt over the cores rather than gathered in one small partition."""
    return df.repartition(max(partitions(df.sparkSession), df.sparkSession.sparkContext.defaultParallelism), by)


def bounded_sample(rows: DataFrame, kind: str, most: int, least: int = 0) -> DataFrame:
    """Some more different rows (id, text) than `most` of all, shared over the values of `kind` as these occur, with `least` of
    each (all, if it has no more): columns h, id, text, kind and quota. `within_quota` makes these numbers exact, on the driver.

    Rows are chosen by a 64-bit hash of id and text, whatever their layout, also where the share is under one in 2**32.
    Rows that repeat id and text count once, so neither a repeated row nor a repeated or missing id can flood the sample."""
    rows = rows.withColumn("h", F.xxhash64(F.lit("sample"), "id", "text"))
    n = rows.groupBy(kind).agg(F.approx_count_distinct("h").alias("n"))
    total = n.agg(F.sum("n")).first()[0] or 1
    quota = F.greatest(F.ceil(F.lit(float(most)) * F.col("n") / F.lit(float(total))), F.lit(least))
    n = n.select(kind, quota.cast("int").alias("quota"), F.least(F.lit(1.0), (quota * 1.3 + F.sqrt(quota) * 6) / F.col("n")).alias("share"))
    rows = rows.join(F.broadcast(n), kind).where(F.col("h") / F.lit(2.0**64) + 0.5 <= F.col("share"))
    return rows.groupBy(kind, "h", "id").agg(F.max("text").alias("text"), F.max("quota").alias("quota"))


def within_quota(sample: list, kind: str) -> list:
    """The rows of a collected sample up to the quota of each kind, in the order of their hashes."""
    seen: Counter = Counter()
    out = []
    for r in sorted(sample, key=lambda r: (r["h"], str(r["id"]), r[kind])):
        if seen[r[kind]] < r["quota"]:
            seen[r[kind]] += 1
            out.append(r)
    return out


def join_back(rows: DataFrame, groups: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Rows with what was aggregated of their group (one row a group). A hash as one more key makes both sides of the join
    exchanges of their own, also where the aggregate is dealt by the keys already: only then can adaptive execution split
    the partitions of a hot group."""
    mark = F.hash(*keys)
    return rows.withColumn("__deal", mark).join(groups.withColumn("__deal", mark), ["__deal", *keys], how).drop("__deal")


def partitions(spark: SparkSession, least: int = 1) -> int:
    """Shuffle partitions as configured, read when a plan is made."""
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))


def store(df: DataFrame, by: str | None = None) -> DataFrame:
    """A Parquet table in the shared folder, removed when the driver ends: as `cut`, for wide or columnar results. With `by`,
    rows of each value of that column are files of their own, so that a condition on it reads no others."""
    import uuid

    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/chainloom-{uuid.uuid4().hex}"
    writer = df.write if by is None else df.write.partitionBy(by)
    writer.parquet(path)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, unless they find it on their own path (installed, or PYTHONPATH)."""
    import zipfile
    from pathlib import Path

    here = Path(__file__).resolve().parents[1]
    known = [p for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    if "site-packages" in str(here) or str(here.parent) in map(os.path.realpath, known) or getattr(spark.sparkContext, "_chainloom", False):
        return
    path = os.path.join(tempfile.mkdtemp(prefix="chainloom-"), "chainloom.zip")
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(here.rglob("*.py")):
            z.write(f, f.relative_to(here.parent))
    spark.sparkContext.addPyFile(path)
    spark.sparkContext._chainloom = True
