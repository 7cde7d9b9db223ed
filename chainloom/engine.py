"""The engine: read-only SQL, log filters and pages over a logs relation."""

from __future__ import annotations

import threading
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from .errors import EngineError
from .operators.filters import EthFilter, LogFilter, rpc_log
from .plans import coverage, division, exact_sum, metadata
from .plans.dialect import to_spark
from .plans.rewrite import asks_for_head, rewrite
from .plans.tokens import Token, text
from .plans.validate import check_size, validate
from .results import MAX_PAGE, check_columns, json_rows, json_value, page
from .sources.schema import public_view
from .sources.store import LogStore, Snapshot

#: How this engine's own session reads SQL.
SETTINGS = {
    "spark.sql.ansi.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.doubleQuotedIdentifiers": "true",
    "spark.sql.caseSensitive": "true",
    "spark.sql.cteRecursionLevelLimit": "100000",
    "spark.sql.timestampType": "TIMESTAMP_NTZ",
}


@dataclass
class QueryResult:
    rows: list[dict]
    row_count: int
    limit: int | None
    offset: int
    next_offset: int | None


class Engine:
    """Queries over a store's snapshot (admitted against its verified range), or over any logs DataFrame, unverified; `tables`
    are other relations that queries may name."""

    def __init__(self, source: LogStore | Snapshot | DataFrame, head: int | None = None, unverified: bool = False, most_bytes: int | None = None, tables: dict[str, DataFrame] | None = None) -> None:
        self.snapshot = source.snapshot() if isinstance(source, LogStore) else source if isinstance(source, Snapshot) else None
        self.unverified = unverified or self.snapshot is None
        self._rows = source if self.snapshot is None else None
        base = source.sparkSession if self.snapshot is None else self.snapshot.store.spark
        self.spark: SparkSession = base.newSession()
        for k, v in SETTINGS.items():
            self.spark.conf.set(k, v)
        self.spark.conf.set("spark.sql.shuffle.partitions", base.conf.get("spark.sql.shuffle.partitions"))
        self._head, self._most_bytes, self._tag = head, most_bytes, f"chainloom-{uuid.uuid4().hex}"
        self._slots = threading.BoundedSemaphore(8)
        metadata.register(self.spark)
        self._planning = threading.RLock()
        self._logs().createOrReplaceTempView("logs")
        self._tables = frozenset(tables or ())
        for name, rows in (tables or {}).items():
            DataFrame(self._adopt(rows), self.spark).createOrReplaceTempView(name)

    def _logs(self, low: int | None = None, high: int | None = None) -> DataFrame:
        if self.snapshot is not None:
            own = Snapshot(LogStore(self.spark, self.snapshot.store.path, self.snapshot.store.bucket_blocks), self.snapshot.version)
            return own.logs(low, high)
        rows = self._rows if "topics" in self._rows.columns else public_view(self._rows)
        return DataFrame(rows._jdf.sparkSession() and self._adopt(rows), self.spark)

    def _adopt(self, rows: DataFrame):
        """The same logical plan in the engine's own session."""
        return self.spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(self.spark._jsparkSession, rows._jdf.queryExecution().logical())

    # queries

    def head_block(self) -> int | None:
        if self._head is None:
            self._head = self.snapshot.head if self.snapshot is not None else self.spark.sql("SELECT max(block_number) FROM logs").first()[0]
        return self._head

    def sql(self, query: str, limit: int | None = None, offset: int = 0) -> DataFrame:
        """The result of a read-only query, paged after its own LIMIT. Everything that can be refused is refused here."""
        check_size(query)
        query = rewrite(query, self.head_block() if asks_for_head(query) else None)
        check_size(query)
        tokens = validate(query, self._tables)
        if metadata.is_metadata(tokens):
            df = metadata.run(self.spark, tokens)
            check_columns(df)
            return page(df, limit, offset)
        with self._planning:
            df = self._pruned(tokens, self._plan(tokens))
        check_columns(df)
        if not self.unverified:  # LIMIT 0 is optimised away, but is admitted or refused by its scans like any other
            some = [Token("number", "1") if t.text == "0" and i and tokens[i - 1].is_("LIMIT") else t for i, t in enumerate(tokens)]
            coverage.check(df if some == tokens else self._plan(some), self.snapshot.verified)
        return page(df, limit, offset)

    def _pruned(self, tokens: list[Token], df: DataFrame) -> DataFrame:
        """The query over those blocks of the store only that its scans ask for, together, after Catalyst's pushdown."""
        if self.snapshot is None:
            return df
        found = coverage.scans(df)
        lows, highs = [low for low, _, _ in found], [high for _, high, _ in found]
        low, high = (f(x) if x and None not in x else None for f, x in ((min, lows), (max, highs)))
        if low is None and high is None:
            return df
        self._logs(low, high).createOrReplaceTempView("logs")
        try:
            return self._plan(tokens)
        finally:
            self._logs().createOrReplaceTempView("logs")

    def _plan(self, tokens: list[Token]) -> DataFrame:
        plan = exact_sum.recognise(tokens)
        if plan is not None:
            return exact_sum.run(plan, self.spark.table("logs"), self._most_bytes)
        exact_sum.check_text_sums(tokens)
        df = division.run(self.spark, to_spark(text(tokens)))
        return df.select() if tokens[0].is_("FROM") and "__none" in df.columns else df

    def query(self, query: str, limit: int | None = None, offset: int = 0) -> QueryResult:
        """Rows in JSON form, with the place of the next page."""
        if limit is not None and limit > MAX_PAGE:
            raise EngineError(f"a page has at most {MAX_PAGE} rows")
        with self._slots:
            self.spark.addTag(self._tag)
            try:
                df = self.sql(query, limit, offset)
                rows = json_rows(df)
            finally:
                self.spark.removeTag(self._tag)
        if self.snapshot is not None:
            self.snapshot.check()
        n = len(rows)
        return QueryResult(rows, n, limit, offset, offset + n if limit and n == limit else None)

    def cancel(self) -> bool:
        """Stops queries that run; whether there were any."""
        return bool(self.spark.interruptTag(self._tag))

    # log requests

    def get_logs(self, request: LogFilter) -> DataFrame:
        rows = self.spark.table("logs") if self.snapshot is None else self._logs(request.from_block, request.to_block)
        df = request.apply(rows)
        if not self.unverified:
            coverage.admit(self.snapshot.verified, request.from_block, request.to_block, request.block_hash)
        return df

    def eth_get_logs(self, request: str | dict) -> list[dict]:
        found = self.get_logs(EthFilter.parse(request).to_log_filter(self.head_block() or 0))
        return [rpc_log(r) for r in found.collect()]

    def stream_logs(self, request: LogFilter):
        """Matching rows one after the other, a partition at a time."""
        df = self.get_logs(request)
        with self._slots:
            self.spark.addTag(self._tag)
            try:
                for row in df.toLocalIterator():
                    yield json_value(row, df.schema)
            finally:
                self.spark.removeTag(self._tag)

    def status(self) -> dict:
        verified = self.snapshot.verified if self.snapshot is not None else None
        return {"head": self.head_block(), "verified": verified and {"from": verified.from_block, "to": verified.to_block}, "healthy": True}
