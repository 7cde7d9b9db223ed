"""Live subscriptions over a stream of changes, with retractions.

The change stream is a Parquet folder of micro-batches (log columns, `removed`, `seq`): a reorganisation publishes the
rows that it retires with removed = true before their replacements. Structured Streaming reads it with checkpointed
offsets, so a slow subscriber gets every change once instead of losing some.
"""

from __future__ import annotations

import re
import time
from collections import OrderedDict
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..errors import FilterError
from ..operators.filters import EthFilter, LogFilter
from ..operators.transfers import TransferFilter, is_transfer, notifications, raw_amount
from ..sources.schema import KEY, STORED

CHANGES = T.StructType([*STORED.fields, T.StructField("removed", T.BooleanType(), False), T.StructField("seq", T.LongType(), False)])

#: What a retained session holds, when an idle dashboard session ends, what its name may be.
RETAINED, IDLE_SECONDS = 10_000, 60
_NAME = re.compile(r"[A-Za-z0-9\-_.:]{1,128}")


def publish(rows: DataFrame, path: str, seq: int, removed: bool = False) -> None:
    """Appends a change batch; batches are delivered by seq, removals of one seq first."""
    rows.select(*STORED.fieldNames()).withColumn("removed", F.lit(removed)).withColumn("seq", F.lit(seq).cast("long")).write.mode("append").parquet(path)


def changes(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(CHANGES).parquet(path)


def _deliver(stream: DataFrame, shape: Callable[[DataFrame], DataFrame], sink: Callable[[list], None] | str, checkpoint: str, once: bool) -> StreamingQuery:
    """Rows go to a function on the driver, one after the other in order, or, if `sink` is a path, to a Parquet table there:
    written by the executors, each change once, its order in `seq` and `removed`."""
    if isinstance(sink, str):
        writer = shape(stream).writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if once else writer).start()

    def batch(rows: DataFrame, _: int) -> None:
        ordered = shape(rows.orderBy("seq", F.col("removed").desc(), *KEY))
        for row in ordered.toLocalIterator():  # a subscriber's own rows, a partition at a time
            sink([row])

    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def subscribe_logs(stream: DataFrame, request: str | dict, sink: Callable[[list], None], checkpoint: str, once: bool = False) -> StreamingQuery:
    """Rows that match an Ethereum-style filter, as they come. Bounds named `latest` have no meaning here; paging is ignored."""
    parsed = EthFilter.parse(request)
    if "latest" in (parsed.raw.get("fromBlock"), parsed.raw.get("toBlock")):
        raise FilterError("a live filter has no latest bound")
    found: LogFilter = parsed.to_log_filter(0)
    return _deliver(stream.where(found.predicate()), lambda rows: rows, sink, checkpoint, once)


def transfer_stream(stream: DataFrame, wanted: TransferFilter) -> DataFrame:
    """Transfers that match; retractions of any transfer pass unfiltered."""
    return stream.where(wanted.predicate() | (F.col("removed") & is_transfer()))


def subscribe_transfers(stream: DataFrame, request: dict, sink: Callable[[list], None], checkpoint: str, once: bool = False) -> StreamingQuery:
    return _deliver(transfer_stream(stream, TransferFilter.parse(request)), notifications, sink, checkpoint, once)


def as_notification(row) -> dict:
    out = row.asDict()
    limbs = out.pop("rawAmountLimbs")
    items = list(out.items())
    return dict([*items[:4], ("rawAmount", raw_amount(limbs)), *items[4:]])


@dataclass
class Session:
    """Notifications of one subscriber, newest first, at most `RETAINED`; a retraction deletes what it retracts."""

    name: str
    scope: str = "service"  # ephemeral, dashboard (ends when idle), service
    dropped: int = 0
    seen: float = field(default_factory=time.monotonic)
    held: OrderedDict = field(default_factory=OrderedDict)

    def add(self, note: dict) -> None:
        key = (note["blockHash"], note["logIndex"])
        self.held.pop(key, None)
        if note["removed"]:
            return
        self.held[key] = note
        while len(self.held) > RETAINED:
            self.held.popitem(last=False)
            self.dropped += 1

    def snapshot(self) -> dict:
        self.seen = time.monotonic()
        return {"id": self.name, "scope": self.scope, "dropped": self.dropped, "notifications": list(reversed(self.held.values()))}

    def clear(self) -> None:
        self.held.clear()
        self.dropped = 0


class Sessions:
    """The registry of retained sessions and their streams."""

    def __init__(self, stream: DataFrame, checkpoints: str) -> None:
        self.stream, self.checkpoints = stream, checkpoints
        self.open: dict[str, tuple[Session, StreamingQuery]] = {}

    def create(self, name: str, request: dict, scope: str = "service", once: bool = False) -> Session:
        if not _NAME.fullmatch(name):
            raise FilterError("a session's name has 1 to 128 of A-Z a-z 0-9 - _ . :")
        if scope not in ("ephemeral", "dashboard", "service"):
            raise FilterError(f"no scope {scope!r}")
        if name in self.open:
            raise FilterError("there is such a session")
        session = Session(name, scope)
        query = subscribe_transfers(self.stream, request, lambda rows: [session.add(as_notification(r)) for r in rows], f"{self.checkpoints}/{name}", once)
        self.open[name] = (session, query)
        return session

    def get(self, name: str) -> dict:
        return self._session(name).snapshot()

    def clear(self, name: str) -> None:
        self._session(name).clear()

    def delete(self, name: str) -> None:
        self._session(name)
        self.open.pop(name)[1].stop()

    def expire(self) -> None:
        """Ends dashboard sessions that nobody has looked at for a while."""
        for name, (session, query) in list(self.open.items()):
            if session.scope == "dashboard" and time.monotonic() - session.seen > IDLE_SECONDS:
                query.stop()
                del self.open[name]

    def _session(self, name: str) -> Session:
        self.expire()
        if name not in self.open:
            raise FilterError(f"no session {name!r}")
        return self.open[name][0]
