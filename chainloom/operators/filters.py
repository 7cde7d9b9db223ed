"""Log filters: a typed record, the Ethereum-style request, and the predicate that both become."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import FilterError
from ..sources.schema import KEY, TOPICS

#: Paging of log requests.
DEFAULT_LIMIT, MAX_LIMIT = 50, 10_000


@dataclass(frozen=True)
class LogFilter:
    """All constraints hold together; ranges are inclusive; None means anything. `topics`: for each position a tuple of values
    or None; `min_topics`: how many topics a log must have."""

    from_block: int | None = None
    to_block: int | None = None
    from_time: int | None = None
    to_time: int | None = None
    block_hash: str | None = None
    addresses: tuple[str, ...] | None = None
    topics: tuple[tuple[str, ...] | None, ...] = ()
    min_topics: int = 0
    data_len: int | None = None
    data: str | None = None
    data_from: str | None = None
    data_to: str | None = None
    descending: bool = False
    limit: int | None = None
    offset: int = 0

    def __post_init__(self) -> None:
        if len(self.topics) > len(TOPICS) or not 0 <= self.min_topics <= len(TOPICS):
            raise FilterError(f"a log has at most {len(TOPICS)} topics")
        if self.offset < 0 or (self.limit is not None and self.limit < 0):
            raise FilterError("limit and offset can't be negative")

    def predicate(self) -> Column:
        c, out = F.col, F.lit(True)
        for column, low, high in (("block_number", self.from_block, self.to_block), ("timestamp", self.from_time, self.to_time), ("data", self.data_from, self.data_to)):
            if low is not None:
                out &= c(column) >= F.lit(low)
            if high is not None:
                out &= c(column) <= F.lit(high)
        for column, value in (("block_hash", self.block_hash), ("data", self.data), ("data_len", self.data_len)):
            if value is not None:
                out &= c(column) == F.lit(value)
        if self.addresses is not None:
            out &= c("address").isin(*self.addresses)
        for name, values in zip(TOPICS, self.topics, strict=False):
            if values is not None:
                out &= c(name).isin(*values)
        for name in TOPICS[: self.min_topics]:
            out &= c(name).isNotNull()
        return out

    def apply(self, logs: DataFrame) -> DataFrame:
        """Matching rows in key order, paged."""
        order = [c.desc() if self.descending else c.asc() for c in map(F.col, (*KEY, "block_hash"))]
        out = logs.where(self.predicate()).orderBy(*order)
        out = out.offset(self.offset) if self.offset else out
        return out if self.limit is None else out.limit(self.limit)


def _unique(pairs: list) -> dict:
    if len({k for k, _ in pairs}) < len(pairs):
        raise FilterError("a key occurs twice")
    return dict(pairs)


def _hex(value: object, size: int, what: str) -> str:
    digits = value[2:] if isinstance(value, str) and value[:2] in ("0x", "0X") else value
    if not isinstance(digits, str) or not re.fullmatch(f"[0-9a-fA-F]{{{2 * size}}}", digits):
        raise FilterError(f"{what} must be {size} bytes in hex")
    return "0x" + digits.lower()


def block_number(value: object, head: int) -> int | None:
    if value is None:
        return None
    if value == "latest":
        return head
    if value == "earliest":
        return 0
    if isinstance(value, str) and re.fullmatch(r"(0[xX])?[0-9a-fA-F]+", value):
        number = int(value, 16)
        if number < 2**64:
            return number
    raise FilterError(f"block {value!r} is not supported")


@dataclass
class EthFilter:
    """A request of the eth_getLogs kind."""

    raw: dict = field(default_factory=dict)

    @classmethod
    def parse(cls, request: str | dict) -> EthFilter:
        raw = json.loads(request, object_pairs_hook=_unique) if isinstance(request, str) else dict(request)
        if not isinstance(raw, dict):
            raise FilterError("a filter is an object")
        out = cls(raw)
        if raw.get("blockHash") is not None and (raw.get("fromBlock") is not None or raw.get("toBlock") is not None):
            raise FilterError("blockHash excludes fromBlock and toBlock")
        if len(raw.get("topics") or []) > 4:
            raise FilterError("there are at most four topics")
        return out

    def to_log_filter(self, head: int) -> LogFilter:
        raw = self.raw
        address = raw.get("address")
        if isinstance(address, str):
            address = [address]
        if address is not None and not isinstance(address, list):
            raise FilterError("address is text or a list")
        topics = []
        given = raw.get("topics")
        if given is not None and not isinstance(given, list):
            raise FilterError("topics is a list")
        for t in given or []:
            if t is None:
                topics.append(None)
            elif isinstance(t, list):
                values = tuple(_hex(x, 32, "a topic") for x in t if x is not None)
                topics.append(None if not t or None in t else values)
            else:
                topics.append((_hex(t, 32, "a topic"),))
        limit, offset = raw.get("limit"), raw.get("offset") or 0
        limit = DEFAULT_LIMIT if limit is None else limit
        for x in (limit, offset):
            if not isinstance(x, int) or isinstance(x, bool) or x < 0:
                raise FilterError("limit and offset are whole numbers")
        if limit > MAX_LIMIT or offset >= MAX_LIMIT or limit + offset > MAX_LIMIT:
            raise FilterError(f"limit and offset stay within {MAX_LIMIT}")
        block_hash = raw.get("blockHash")
        return LogFilter(
            from_block=block_number(raw.get("fromBlock"), head),
            to_block=block_number(raw.get("toBlock"), head),
            block_hash=None if block_hash is None else _hex(block_hash, 32, "blockHash"),
            addresses=tuple(_hex(a, 20, "an address") for a in address) if address else None,
            topics=tuple(topics),
            min_topics=len(topics),
            limit=limit,
            offset=offset,
        )


def rpc_log(row, removed: bool = False) -> dict:
    """A row in the form of the JSON-RPC log object."""
    return {
        "address": row["address"],
        "topics": [row[t] for t in TOPICS if row[t] is not None],
        "data": row["data"],
        "blockNumber": hex(row["block_number"]),
        "blockHash": row["block_hash"],
        "blockTimestamp": hex(row["timestamp"]),
        "transactionHash": row["tx_hash"],
        "transactionIndex": hex(row["tx_index"]),
        "logIndex": hex(row["log_index"]),
        "removed": removed,
    }
