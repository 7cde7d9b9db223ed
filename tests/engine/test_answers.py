"""Answers of the dialect that Spark alone gives otherwise, and what a store's scans read."""

import datetime

import pytest

from chainloom.engine import Engine
from chainloom.errors import FilterError, SyntaxRejected
from chainloom.operators.filters import LogFilter
from chainloom.sources.schema import STORED
from chainloom.sources.store import LogStore, SnapshotChanged

from .test_sql import A, B, log


@pytest.fixture(scope="module")
def engine(spark):
    rows = [log(b, i, A if b % 2 else B) for b in range(1, 31) for i in range(3)]
    return Engine(spark.createDataFrame(rows, STORED).repartition(5), tables={"own": spark.createDataFrame([(1, None), (2, 5.0)], "a int, b double")})


def rows(engine, sql):
    return [tuple(r) for r in engine.sql(sql).collect()]


def test_distinct_on_keeps_the_order(engine):
    sql = "SELECT DISTINCT ON (block_number) block_number, log_index FROM logs ORDER BY block_number, log_index{} LIMIT 5"
    assert rows(engine, sql.format("")) == [(b, 0) for b in range(1, 6)]
    assert rows(engine, sql.format(" DESC")) == [(b, 2) for b in range(1, 6)]
    assert rows(engine, "SELECT DISTINCT ON (address) block_number AS b FROM logs ORDER BY address, b DESC, log_index") == [(29,), (30,)]
    assert rows(engine, "SELECT DISTINCT ON (address) block_number FROM logs ORDER BY address DESC, timestamp DESC LIMIT 1") == [(30,)]


def test_qualify_orders_by_what_is_not_shown(engine):
    sql = "SELECT log_index FROM logs QUALIFY ROW_NUMBER() OVER (PARTITION BY log_index ORDER BY block_number) <= 2 ORDER BY block_number DESC, log_index DESC LIMIT 4"
    assert rows(engine, sql) == [(2,), (1,), (0,), (2,)]
    assert rows(engine, "SELECT block_number AS b, log_index AS i FROM logs QUALIFY ROW_NUMBER() OVER (PARTITION BY block_number ORDER BY log_index DESC) = 1 ORDER BY 1 DESC LIMIT 2") == [(30, 2), (29, 2)]


@pytest.mark.parametrize(
    ("sql", "want"),
    [
        ("SELECT n / 2 FROM (SELECT 3 AS n) t", 1), ("SELECT LENGTH(address) / 5 FROM logs LIMIT 1", 8), ("SELECT 7 / 2 / 2.0", 1.5), ("SELECT 7 / 2 / 2", 1), ("SELECT -7 / 2", -3), ("SELECT CAST(7 AS DOUBLE) / 2", 3.5),
        ("SELECT (SELECT MAX(block_number) FROM logs) / 4", 7), ("SELECT CASE WHEN 3 / 2 = 1 THEN 9 / 2 END / 3", 1), ("SELECT SUM(n) / COUNT(*) FROM (VALUES (1), (2)) t(n)", 1), ("SELECT AVG(n) / 1 FROM (VALUES (1), (2)) t(n)", 1.5),
        ("SELECT '1 / 2'", "1 / 2"), ("SELECT x.y / 2 FROM (SELECT 5 AS y) x", 2), ("WITH c AS (SELECT 9 / 2 AS v) SELECT v / 3 FROM c", 1), ("SELECT COUNT(*) FROM logs WHERE block_number / 10 = 2", 30),
        ("SELECT regexp_match('abc', 'b')", ["b"]), ("SELECT regexp_match('a1b2', '([a-z])([0-9])')", ["a", "1"]), ("SELECT regexp_match('abc', 'x')", None), (r"SELECT regexp_match('f(x)', '\((.)[(]?(?:\))')", ["x"]), ("SELECT regexp_match('ABC', 'b', 'i')", ["B"]),
    ],
)
def test_values(engine, sql, want):
    assert rows(engine, sql)[0][0] == want


def test_patterns_are_written_out(engine):
    with pytest.raises(SyntaxRejected):
        engine.sql("SELECT regexp_match(data, address) FROM logs")


def test_date_bin(engine):
    at = "TIMESTAMP '2021-03-31 10:11:12.789'"
    for width, want in (("500 milliseconds", "2021-03-31 10:11:12.500"), ("15 minutes", "2021-03-31 10:00:00"), ("2 days", "2021-03-30 00:00:00"), ("1 month", "2021-03-01 00:00:00"), ("5 months", "2020-11-01 00:00:00"), ("1 year", "2021-01-01 00:00:00")):
        assert rows(engine, f"SELECT date_bin(INTERVAL '{width}', {at})")[0][0] == datetime.datetime.fromisoformat(want), width
    assert rows(engine, "SELECT date_bin(INTERVAL '1 month', TIMESTAMP '1969-12-15 00:00:00')")[0][0] == datetime.datetime(1969, 12, 1)


def test_other_tables_follow_the_dialect(engine):
    assert rows(engine, "SELECT a, a / 2 FROM own ORDER BY b DESC") == [(1, 0), (2, 1)]
    with pytest.raises(SyntaxRejected):
        engine.sql("SELECT * FROM others")


def test_log_filter_is_validated():
    for bad in ({"topics": (None,) * 5}, {"min_topics": 5}, {"limit": -1}, {"offset": -1}):
        with pytest.raises(FilterError):
            LogFilter(**bad)


def test_latest_in_a_string_asks_for_no_head(engine):
    assert rows(engine, "SELECT 'latest' AS latest_name") == [("latest",)] and engine._head is None


def test_scans_of_a_store_are_pruned(spark, tmp_path):
    store = LogStore(spark, str(tmp_path), bucket_blocks=10)
    for low in (0, 100, 200):
        store.append(spark.createDataFrame([log(b, 0, A) for b in range(low, low + 100)], STORED))
    engine = Engine(store, unverified=True)
    df = engine.sql("SELECT block_number FROM logs WHERE block_number BETWEEN 150 AND 155")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "block_bucket" in plan.split("PartitionFilters: [")[1].split("]")[0] and sorted(r[0] for r in df.collect()) == list(range(150, 156))
    assert len(df.inputFiles()) == 10  # of one batch; of these the plan reads a folder
    both = engine.sql("SELECT a.block_number FROM logs a JOIN logs b ON a.block_number = b.block_number + 1 WHERE a.block_number > 290 AND b.block_number > 280")
    assert both.count() == 9 and engine.sql("SELECT COUNT(*) FROM logs").first()[0] == 300
    assert len(engine.get_logs(LogFilter(from_block=40, to_block=49)).inputFiles()) == 10


def test_one_of_two_writers_wins(spark, tmp_path):
    a, b = (LogStore(spark, str(tmp_path)) for _ in range(2))
    old = a.manifest()
    a.append(spark.createDataFrame([log(1, 0, A)], STORED))
    with pytest.raises(SnapshotChanged):
        b._commit(old, old)
    assert b.manifest().version == 1


def test_members_of_subqueries(engine):
    assert rows(engine, "SELECT v FROM (VALUES (1), (2), (3)) t(v) WHERE v = ANY (SELECT x FROM (VALUES (2), (9)) u(x))") == [(2,)]
    assert rows(engine, "SELECT v FROM (VALUES (1), (2), (3)) t(v) WHERE v <> ALL (SELECT x FROM (VALUES (2), (3)) u(x))") == [(1,)]
    with pytest.raises(SyntaxRejected):
        engine.sql("SELECT v FROM (VALUES (1)) t(v) WHERE v < ANY (SELECT 1)")


def test_exclude_and_replace(engine):
    df = engine.sql("SELECT * EXCLUDE (a) REPLACE (b + 1 AS b) FROM (VALUES (1, 2, 3)) t(a, b, c)")
    assert sorted(df.columns) == ["b", "c"] and df.first().asDict() == {"b": 3, "c": 3}


def test_dollar_strings(engine):
    assert rows(engine, "SELECT $$it's \\ $$ AS s") == [("it's \\ ",)]


@pytest.mark.parametrize(
    ("text", "pattern", "like"),
    [("abc", "a%", True), ("abc", "a_c", True), ("abc", "a.c", False), ("a.c", "a.c", True), ("abc", "b", False), ("abab", "(ab)+", True), ("a$", "a$", True), ("b", "[^a]", True), ("a%", r"a\%", True), ("ab", r"a\%", False), ("x", "x|y", True)],
)
def test_similar_to(engine, text, pattern, like):
    assert rows(engine, f"SELECT '{text}' SIMILAR TO '{pattern}' AS r") == [(like,)]
