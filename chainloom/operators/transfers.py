"""Token transfers: which logs are one, and which of them a subscriber asks for."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import FilterError
from ..sources.schema import TRANSFER

_PAD = "0x" + "0" * 24


def is_transfer() -> Column:
    """A transfer of fungible tokens: the event's topic, two padded addresses, one 32-byte amount."""
    c = F.col
    return (c("topic0") == TRANSFER) & c("topic1").startswith(_PAD) & c("topic2").startswith(_PAD) & c("topic3").isNull() & (c("data_len") == 32)


def addresses(value: object) -> tuple[str, ...]:
    """A list, or text with commas or white space between addresses."""
    if value is None:
        return ()
    parts = re.split(r"[,\s]+", value) if isinstance(value, str) else value
    if not isinstance(parts, (list, tuple)):
        raise FilterError("addresses are a list or text")
    out = []
    for p in parts:
        if isinstance(p, str) and not p.strip():
            continue
        digits = p.strip() if isinstance(p, str) else ""
        digits = digits[2:] if digits[:2].lower() == "0x" else digits
        if not re.fullmatch(r"[0-9a-fA-F]{40}", digits):
            raise FilterError(f"not an address: {p!r}")
        out.append("0x" + digits.lower())
    return tuple(dict.fromkeys(out))


def amount(value: object) -> int | None:
    """A bound: decimal text, 0x hex text, or a whole JSON number, below 2**256."""
    if value is None:
        return None
    if isinstance(value, bool) or not isinstance(value, (int, str)):
        raise FilterError("an amount is a whole number or text")
    if isinstance(value, str):
        text = value.strip()
        if re.fullmatch(r"0[xX][0-9a-fA-F]+", text):
            value = int(text, 16)
        elif re.fullmatch(r"\d+", text):
            value = int(text)
        else:
            raise FilterError(f"not an amount: {value!r}")
    elif value >= 2**64:
        raise FilterError("larger amounts are given as text")
    if not 0 <= value < 2**256:
        raise FilterError("an amount lies between 0 and 2**256")
    return value


@dataclass(frozen=True)
class TransferFilter:
    wallets: tuple[str, ...] = ()
    tokens: tuple[str, ...] = ()
    least: int | None = None
    most: int | None = None

    @classmethod
    def parse(cls, request: dict) -> TransferFilter:
        out = cls(addresses(request.get("wallets")), addresses(request.get("tokens")), amount(request.get("min")), amount(request.get("max")))
        if not out.wallets and not out.tokens:
            raise FilterError("name a wallet or a token")
        if out.least is not None and out.most is not None and out.least > out.most:
            raise FilterError("min is over max")
        return out

    def predicate(self) -> Column:
        out = is_transfer()
        if self.tokens:
            out &= F.col("address").isin(*self.tokens)
        if self.wallets:
            topics = [_PAD + w[2:] for w in self.wallets]
            out &= F.col("topic1").isin(*topics) | F.col("topic2").isin(*topics)
        if self.least is not None:  # 32-byte hex texts compare as their numbers
            out &= F.col("data") >= f"0x{self.least:064x}"
        if self.most is not None:
            out &= F.col("data") <= f"0x{self.most:064x}"
        return out


def notifications(rows: DataFrame) -> DataFrame:
    """Transfer rows with a `removed` flag in the form that subscribers get."""
    from .hexsum import hex_limbs

    c = F.col
    amount_ = F.concat_ws(",", F.transform(hex_limbs(c("data")), lambda x: x.cast("string"))).alias("rawAmountLimbs")
    return rows.select(
        F.lit("erc20Transfer").alias("type"), c("address").alias("tokenAddress"), F.concat(F.lit("0x"), F.substring("topic1", 27, 40)).alias("from"), F.concat(F.lit("0x"), F.substring("topic2", 27, 40)).alias("to"), amount_,
        c("block_number").alias("blockNumber"), c("block_hash").alias("blockHash"), "timestamp", c("tx_hash").alias("transactionHash"), c("tx_index").alias("transactionIndex"), c("log_index").alias("logIndex"), "removed",
    )


def raw_amount(limbs: str) -> str:
    return str(sum(int(v) << (56 * i) for i, v in enumerate(limbs.split(",")) if v))


def net_flow(logs: DataFrame, wallet: str) -> DataFrame:
    """Per token: what a wallet received, sent, and the difference, as exact base-10 text; one scan, one aggregation.

    For amounts that fit 35 bytes (every transfer's do)."""
    from .hexsum import sums

    topic = _PAD + addresses([wallet])[0][2:]
    mine = logs.where(is_transfer() & ((F.col("topic1") == topic) | (F.col("topic2") == topic)))
    none = F.lit(None).cast("decimal(38,0)")
    received = F.when(F.col("topic2") == topic, F.col("data")).otherwise("0x")
    sent = F.when(F.col("topic1") == topic, F.col("data")).otherwise("0x")
    out = sums(mine, ["address"], {"received": (received, none), "sent": (sent, none)}, most_bytes=32)

    @F.pandas_udf("string")
    def minus(a, b):
        import pandas as pd

        return pd.Series([str(int(x) - int(y)) for x, y in zip(a, b, strict=True)], dtype=object)

    return out.withColumn("net", minus("received", "sent"))
