"""The logs relation: columns, types, and the virtual topics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TOPICS = ("topic0", "topic1", "topic2", "topic3")
INTEGERS = ("block_number", "timestamp", "tx_index", "log_index", "data_len", "source")
TEXTS = ("block_hash", "tx_hash", "address", *TOPICS, "data")
KEY = ("block_number", "tx_index", "log_index")

#: What is stored; `topics` is made in the view.
STORED = T.StructType(
    [
        T.StructField("block_number", T.LongType(), False),
        T.StructField("block_hash", T.StringType(), False),
        T.StructField("timestamp", T.LongType(), False),
        T.StructField("tx_hash", T.StringType(), False),
        T.StructField("tx_index", T.LongType(), False),
        T.StructField("log_index", T.LongType(), False),
        T.StructField("address", T.StringType(), False),
        *[T.StructField(t, T.StringType(), True) for t in TOPICS],
        T.StructField("data", T.StringType(), False),
        T.StructField("data_len", T.LongType(), False),
        T.StructField("source", T.LongType(), False),
    ]
)
COLUMNS = ("block_number", "block_hash", "timestamp", "tx_hash", "tx_index", "log_index", "address", *TOPICS, "topics", "data", "data_len", "source")


def public_view(stored: DataFrame) -> DataFrame:
    """The 15 public columns; canonical rows only where the storage marks them."""
    if "canonical" in stored.columns:
        stored = stored.where("canonical")
    topics = F.filter(F.array(*TOPICS), lambda t: t.isNotNull()).alias("topics")
    return stored.select(*[topics if c == "topics" else F.col(c) for c in COLUMNS])


def from_events(events: DataFrame) -> DataFrame:
    """A deterministic logs relation derived from an events table (event_id, ts, user_id, event_type, value)."""
    token = "substr(sha2(concat('token:', CAST(user_id % 7 AS STRING)), 256), 1, 40)"
    wallet = "lpad(substr(sha2(concat('w:', CAST({} AS STRING)), 256), 1, 40), 64, '0')"
    topic0 = {"purchase": TRANSFER, "click": APPROVAL, "view": DEPOSIT, "signup": WITHDRAWAL}
    odd = "event_type = 'purchase' AND event_id % 11 = 0"
    rows = events.selectExpr(
        "18000000 + event_id div 4 AS block_number",
        "'0x' || sha2(concat('block:', CAST(event_id div 4 AS STRING)), 256) AS block_hash",
        "unix_timestamp(ts) AS timestamp",
        "'0x' || sha2(concat('tx:', CAST(event_id div 2 AS STRING)), 256) AS tx_hash",
        "(event_id % 4) div 2 AS tx_index",
        "event_id % 4 AS log_index",
        f"'0x' || {token} AS address",
        "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in topic0.items()) + " END AS topic0",
        f"CASE WHEN event_type <> 'error' THEN '0x' || {wallet.format('user_id')} END AS topic1",
        f"CASE WHEN event_type IN ('purchase', 'click') THEN '0x' || {wallet.format('(user_id * 7 + event_id) % 150')} END AS topic2",
        f"CASE WHEN {odd} THEN '0x' || lpad(lower(hex(event_id)), 64, '0') END AS topic3",
        f"CASE WHEN event_type = 'error' THEN '0x' || repeat('ab', CAST(event_id % 4 AS INT)) WHEN {odd} THEN '0x' "
        "ELSE '0x' || lpad(lower(hex(event_id)), 48, '0') || lpad(lower(hex(CAST(floor(value * 100) AS BIGINT))), 16, '0') END AS data",
        "CASE WHEN event_id % 10 = 0 THEN 1L ELSE 0L END AS source",
    )
    return rows.withColumn("data_len", F.expr("CAST((length(data) - 2) div 2 AS BIGINT)")).select(*STORED.fieldNames())


#: The topic0 of four well-known events.
TRANSFER = "0xddf252ad1be2c89b69c2b068fc378daa952ba7f163c4a11628f55a4df523b3ef"
APPROVAL = "0x8c5be1e5ebec7d5bd14f71427d1e84f3dd0314c0f7b2291e5b200ac8c7c3b925"
DEPOSIT = "0xe1fffcc4923d04b559f4d29a8bfc6cda04eb5b0d3c460751c2402c5c5cc9109c"
WITHDRAWAL = "0x7fcf532c15f0a6db0bd6d0e038bea71d30d808c7d98cb3bf7268a95bf5081b65"


def from_receipts(blocks: DataFrame) -> DataFrame:
    """Logs of blocks (block_number, block_hash, timestamp, transactions array<struct<hash, logs array<struct<address, topics, data>>>>).

    Transactions are numbered in their block; logs are numbered through the whole block."""
    tx = blocks.select("block_number", "block_hash", "timestamp", F.expr("transform(transactions, (t, i) -> named_struct('tx_hash', t.hash, 'tx_index', CAST(i AS BIGINT), 'logs', t.logs))").alias("t"))
    flat = tx.select("block_number", "block_hash", "timestamp", F.posexplode(F.expr("flatten(transform(t, x -> transform(x.logs, l -> named_struct('tx_hash', x.tx_hash, 'tx_index', x.tx_index, 'log', l))))")).alias("log_index", "x"))
    topics = [F.expr(f"try_element_at(x.log.topics, {i + 1})").alias(t) for i, t in enumerate(TOPICS)]
    rows = flat.where(F.expr("CASE WHEN size(x.log.topics) > 4 THEN raise_error('a log has over four topics') ELSE true END"))
    data = F.lower("x.log.data")
    return rows.select("block_number", "block_hash", "timestamp", F.col("x.tx_hash").alias("tx_hash"), F.col("x.tx_index").alias("tx_index"), F.col("log_index").cast("long").alias("log_index"), F.lower("x.log.address").alias("address"), *topics, data.alias("data"), F.expr("CAST((length(x.log.data) - 2) div 2 AS BIGINT)").alias("data_len"), F.lit(0).cast("long").alias("source")).select(*STORED.fieldNames())


def generated(spark, rows: int, profile: str = "dense", first_block: int = 18_000_000) -> DataFrame:
    """A synthetic relation for benchmarks: one hot emitter (6 of 7 rows), transfers (4 of 5 rows)."""
    block = "id div 128" if profile == "dense" else "id * 3"
    index = "id % 128" if profile == "dense" else "0L"
    rows_ = spark.range(rows).selectExpr("id", f"{block} AS b", f"{index} AS i")
    topic = "CASE WHEN id % 5 <> 0 THEN '0x' || lpad(lower(hex({})), 64, '0') END"
    size = "CASE WHEN id % 5 <> 0 THEN 32 ELSE element_at(array(0, 64, 256, 1024), CAST(id % 4 AS INT) + 1) END"
    return rows_.selectExpr(
        f"{first_block} + b AS block_number",
        "'0x' || sha2(concat('b', CAST(b AS STRING)), 256) AS block_hash",
        "1700000000L + b * 12 AS timestamp",
        "'0x' || sha2(concat('t', CAST(id div 2 AS STRING)), 256) AS tx_hash",
        "i div 2 AS tx_index",
        "i AS log_index",
        "CASE WHEN id % 7 <> 0 THEN '0x' || repeat('aa', 20) ELSE '0x' || repeat('bb', 20) END AS address",
        f"CASE WHEN id % 5 <> 0 THEN '{TRANSFER}' END AS topic0",
        topic.format("id % 251") + " AS topic1",
        topic.format("(id + 17) % 251") + " AS topic2",
        "CAST(NULL AS STRING) AS topic3",
        f"'0x' || substr(repeat(sha2(CAST(id AS STRING), 256), 32), 1, 2 * ({size})) AS data",
        f"CAST({size} AS BIGINT) AS data_len",
        "0L AS source",
    )
