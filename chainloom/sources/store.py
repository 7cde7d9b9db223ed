"""Log storage on Parquet: appended batches, snapshots, compaction, and reorganisations.

A store is a folder: `data/` has one folder per batch (batch=...), partitioned by block bucket and sorted inside, with bloom
filters on address and topics; `manifests/` has one small JSON file per version, written by the one
writer that claimed the version. A version names its
batches; each batch has a block from which its rows are no longer canonical (none by default), so a reorganisation
rewrites nothing: it lowers that limit and adds replacement batches in one commit. Readers capture a version; the
files it names are never changed.
"""

from __future__ import annotations

import json
import tempfile
import time
import uuid
from dataclasses import dataclass, field, replace

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import SnapshotChanged
from ..plans.coverage import Verified
from .schema import KEY, STORED, public_view

BUCKET_BLOCKS = 10_000
CLAIM_SECONDS = 3600


@dataclass(frozen=True)
class Batch:
    path: str
    from_block: int
    to_block: int
    rows: int
    retired_from: int | None = None


@dataclass(frozen=True)
class Manifest:
    version: int = 0
    epoch: int = 0  # counts reorganisations
    batches: tuple[Batch, ...] = ()
    verified: Verified | None = None

    @property
    def head(self) -> int | None:
        live = [min(b.to_block, b.retired_from - 1) if b.retired_from is not None else b.to_block for b in self.batches]
        return max(live, default=None)


@dataclass
class LogStore:
    spark: SparkSession
    path: str
    bucket_blocks: int = BUCKET_BLOCKS
    _fs: object = field(default=None, repr=False)

    def __post_init__(self) -> None:
        self._fs = self._path("").getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.path.rstrip("/"), *[p for p in parts if p]]))

    # versions

    def manifest(self) -> Manifest:
        folder = self._path("manifests")
        if not self._fs.exists(folder):
            return Manifest()
        names = sorted(f.getPath().getName() for f in self._fs.listStatus(folder) if f.getPath().getName().endswith(".json"))
        if not names:
            return Manifest()
        stream = self._fs.open(self._path("manifests", names[-1]))
        try:
            raw = json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()
        verified = raw["verified"] and Verified(raw["verified"]["from_block"], raw["verified"]["to_block"], tuple(raw["verified"]["hashes"]))
        return Manifest(raw["version"], raw["epoch"], tuple(Batch(**b) for b in raw["batches"]), verified)

    def _commit(self, old: Manifest, new: Manifest) -> Manifest:
        new = replace(new, version=old.version + 1)
        raw = {"version": new.version, "epoch": new.epoch, "batches": [vars(b) for b in new.batches], "verified": new.verified and vars(new.verified)}
        draft, final = self._path("manifests", f".{uuid.uuid4().hex}"), self._path("manifests", f"{new.version:012d}.json")
        self._claim(new.version, final)
        stream = self._fs.create(draft, False)
        stream.write(json.dumps(raw).encode())
        stream.close()
        if self._fs.exists(final) or not self._fs.rename(draft, final):
            self._fs.delete(draft, False)
            raise SnapshotChanged("another writer committed first")
        return new

    def _claim(self, version: int, final) -> None:
        """Makes this the only writer of a version: of all that create its claim, one can. A claim that led to nothing for
        CLAIM_SECONDS is that of a writer that was lost, and is taken over."""
        claim = self._path("manifests", f"{version:012d}.claim")
        try:
            if self._fs.exists(claim) and not self._fs.exists(final) and time.time() - self._fs.getFileStatus(claim).getModificationTime() / 1000 > CLAIM_SECONDS:
                self._fs.delete(claim, False)
            self._fs.create(claim, False).close()
        except Py4JJavaError as e:
            raise SnapshotChanged("another writer committed first") from e

    # writing

    def _write(self, rows: DataFrame, extra: list[str] | None = None) -> Batch | None:
        path = "/".join([self.path.rstrip("/"), "data", f"batch={uuid.uuid4().hex}"])
        out = rows.select(*STORED.fieldNames()).withColumn("block_bucket", F.expr(f"block_number div {self.bucket_blocks}"))
        out = out.repartitionByRange("block_bucket", *(extra or KEY[:1])).sortWithinPartitions("block_bucket", *(extra or KEY))
        writer = out.write.partitionBy("block_bucket")
        for c in ("address", "topic0", "topic1", "topic2", "topic3"):
            writer = writer.option(f"parquet.bloom.filter.enabled#{c}", "true")
        writer.parquet(path)
        seen = self.spark.read.schema(STORED).parquet(path)  # read back what was written
        n, low, high = seen.agg(F.count(F.lit(1)), F.min("block_number"), F.max("block_number")).first()
        return Batch(path, low, high, n) if n else None

    def append(self, rows: DataFrame, verified: Verified | None = None) -> Manifest:
        """Adds rows; `verified` is the range that is certified from now on."""
        old = self.manifest()
        batch = self._write(rows)
        return self._commit(old, replace(old, batches=old.batches + ((batch,) if batch else ()), verified=verified or old.verified))

    def reorganise(self, from_block: int, rows: DataFrame | None = None, verified: Verified | None = None) -> Manifest:
        """Retires all rows of blocks from `from_block` on, and adds their replacements in the same commit."""
        old = self.manifest()
        kept = tuple(replace(b, retired_from=min(x for x in (b.retired_from, from_block) if x is not None)) if b.to_block >= from_block else b for b in old.batches)
        batch = self._write(rows) if rows is not None else None
        if verified is None and old.verified is not None:
            verified = replace(old.verified, to_block=min(old.verified.to_block, from_block - 1))
        return self._commit(old, replace(old, epoch=old.epoch + 1, batches=kept + ((batch,) if batch else ()), verified=verified))

    def compact(self, order: list[str] | None = None) -> Manifest:
        """Rewrites the canonical rows as one batch, sorted in each bucket by key, or by `order` for other access paths."""
        old = self.manifest()
        if not old.batches:
            return old
        batch = self._write(Snapshot(self, old).stored(), order)
        return self._commit(old, replace(old, batches=(batch,) if batch else ()))

    def snapshot(self) -> Snapshot:
        return Snapshot(self, self.manifest())


@dataclass
class Snapshot:
    """A captured version: later appends aren't seen, and a reorganisation makes `check` fail."""

    store: LogStore
    version: Manifest

    def stored(self, canonical_only: bool = True, low: int | None = None, high: int | None = None) -> DataFrame:
        """The rows, or those of blocks low to high: batches that the manifest bounds elsewhere aren't listed, and of others only the
        folders of these blocks are read."""
        spark, n = self.store.spark, self.store.bucket_blocks
        groups: dict[int | None, list[str]] = {}
        for b in self.version.batches:
            if (low is not None and b.to_block < low) or (high is not None and b.from_block > high):
                continue
            if not (canonical_only and b.retired_from is not None and b.retired_from <= b.from_block):
                groups.setdefault(b.retired_from if canonical_only else None, []).append(b.path)
        out = None
        for limit, paths in groups.items():  # one scan for all batches without a limit
            rows = spark.read.schema(STORED).option("basePath", f"{self.store.path.rstrip('/')}/data").parquet(*paths)
            if low is not None:
                rows = rows.where((F.col("block_bucket") >= low // n) & (F.col("block_number") >= low))
            if high is not None:
                rows = rows.where((F.col("block_bucket") <= high // n) & (F.col("block_number") <= high))
            rows = rows.select(*STORED.fieldNames())
            rows = rows if limit is None else rows.where(F.col("block_number") < limit)
            out = rows if out is None else out.unionByName(rows)
        return spark.createDataFrame([], STORED) if out is None else out

    def logs(self, low: int | None = None, high: int | None = None) -> DataFrame:
        return public_view(self.stored(low=low, high=high))

    @property
    def head(self) -> int | None:
        return self.version.head

    @property
    def verified(self) -> Verified | None:
        return self.version.verified

    def check(self) -> None:
        if self.store.manifest().epoch != self.version.epoch:
            raise SnapshotChanged("the data was reorganised")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share (below spark.checkpoint.dir), removed when the driver ends."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not (spark.sparkContext.master + "[").startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.gettempdir()
    path = f"{base.rstrip('/')}/chainloom-{name}-{uuid.uuid4().hex}"
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(where)
    fs.deleteOnExit(where)
    return path
