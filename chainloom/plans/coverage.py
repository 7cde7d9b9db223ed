"""Admission against the verified block range: a scan that may leave it is an error, never a shorter answer."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame

from ..errors import CoverageError


@dataclass(frozen=True)
class Verified:
    """The inclusive verified range, and hashes of blocks known to be in it."""

    from_block: int
    to_block: int
    hashes: tuple[str, ...] = ()


def admit(verified: Verified | None, low: int | None, high: int | None, block_hash: str | None = None) -> None:
    if verified is None:
        raise CoverageError("no block range is verified")
    if block_hash is not None:
        if block_hash in verified.hashes:
            return
        if verified.from_block > 0 and low is None:
            raise CoverageError("the block isn't known and history doesn't start at 0")
    low = 0 if low is None else low
    high = verified.to_block if high is None else high
    if low < verified.from_block or high > verified.to_block:
        raise CoverageError(f"blocks {low} to {high} aren't all verified: {verified.from_block} to {verified.to_block} are")


def _iterate(seq):
    for i in range(seq.size()):
        yield seq.apply(i)


def _conjuncts(expression):
    if expression.getClass().getSimpleName() == "And":
        for side in (expression.left(), expression.right()):
            yield from _conjuncts(side)
    else:
        yield expression


_COMPARE = re.compile(r"^\(?(?:\w+\.)?`?block_number`?\s*(>=|<=|>|<|=)\s*(-?\d+)L?\)?$|^\(?(-?\d+)L?\s*(>=|<=|>|<|=)\s*(?:\w+\.)?`?block_number`?\)?$")
_HASH = re.compile(r"^\(?(?:\w+\.)?`?block_hash`?\s*=\s*'(0x[0-9a-f]{64})'\)?$")


def bounds(conditions: list[str]) -> tuple[int | None, int | None, str | None]:
    """The range of blocks that conjuncts (as SQL) leave, and a block hash."""
    low = high = block = None
    for c in conditions:
        if m := _HASH.match(c):
            block = m[1]
        if not (m := _COMPARE.match(c)):
            continue
        op, value = (m[1], int(m[2])) if m[1] else ({">=": "<=", "<=": ">=", ">": "<", "<": ">", "=": "="}[m[4]], int(m[3]))
        if op in (">=", ">", "="):
            low = max(x for x in (low, value + (op == ">")) if x is not None)
        if op in ("<=", "<", "="):
            high = min(x for x in (high, value - (op == "<")) if x is not None)
    return low, high, block


def scans(df: DataFrame) -> list[tuple[int | None, int | None, str | None]]:
    """Block bounds of every scan of stored logs in the optimized plan, subqueries included."""
    found: list = []

    def visit(plan, conditions: list[str]) -> None:
        kind = plan.getClass().getSimpleName()
        subqueries = plan.subqueries()
        for s in _iterate(subqueries):
            visit(s, [])
        if kind == "Filter":
            own = [c.sql() for c in _conjuncts(plan.condition())]
            visit(plan.child(), conditions + own)
        elif kind == "Project":
            visit(plan.child(), conditions)
        elif kind == "LogicalRelation":
            names = {a.name() for a in _iterate(plan.output())}
            if {"block_number", "log_index", "topic0"} <= names:
                found.append(bounds(conditions))
        else:
            for child in _iterate(plan.children()):
                visit(child, [])

    visit(df._jdf.queryExecution().optimizedPlan(), [])
    return found


def check(df: DataFrame, verified: Verified | None) -> None:
    for low, high, block in scans(df):
        if low is not None and high is not None and low > high:
            continue  # reads nothing
        admit(verified, low, high, block)
