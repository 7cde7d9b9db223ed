"""Storage, snapshots, coverage, log requests and live subscriptions."""

import itertools
import json
import random

import pytest
from pyspark.sql import functions as F

from chainloom.engine import Engine
from chainloom.errors import CoverageError, FilterError, SnapshotChanged
from chainloom.operators.filters import EthFilter, LogFilter
from chainloom.operators.transfers import TransferFilter, addresses, amount, net_flow
from chainloom.plans.coverage import Verified, admit
from chainloom.sources.schema import STORED, TRANSFER, public_view
from chainloom.sources.store import LogStore
from chainloom.streaming import subscriptions as live

from .test_sql import A, B, log, topic

PAD = "0x" + "0" * 24
W1, W2, W3 = ("0x" + c * 40 for c in "123")


def frame(spark, rows):
    return spark.createDataFrame(rows, STORED)


@pytest.fixture(scope="module")
def chain(spark, tmp_path_factory):
    """Blocks 10 (two logs), 11 (none), 12 (one) are verified; block 13 isn't."""
    store = LogStore(spark, str(tmp_path_factory.mktemp("store")), bucket_blocks=5)
    store.append(frame(spark, [log(10, 0, A, (TRANSFER, topic(1))), log(10, 1, B), log(12, 0, A)]), Verified(10, 12, (f"0x{10:064x}", f"0x{12:064x}")))
    store.append(frame(spark, [log(13, 0, A)]))
    return store


@pytest.mark.parametrize(
    ("where", "ok"),
    [
        ("block_number >= 10 AND block_number <= 12", True), ("block_number BETWEEN 11 AND 11", True), ("block_number = 10", True), ("12 >= block_number AND 10 <= block_number", True), ("block_number >= 10", True), (f"block_hash = '0x{12:064x}'", True),
        ("block_number > 9 AND block_number < 13", True), ("block_number BETWEEN 12 AND 10", True),
        ("TRUE", False), ("block_number >= 9 AND block_number <= 12", False), ("block_number >= 10 AND block_number <= 13", False), ("block_number = 13", False), ("block_number <= 12", False), ("address = '0x'", False), ("block_number >= 9 OR block_number = 10", False),
        (f"block_hash = '0x{99:064x}'", False),
    ],
)
def test_coverage(chain, where, ok):
    engine = Engine(chain)
    for tail in ("", " LIMIT 0"):
        sql = f"SELECT block_number, log_index FROM logs WHERE {where}{tail}"
        if ok:
            engine.sql(sql).collect()
        else:
            with pytest.raises(CoverageError):
                engine.sql(sql)


def test_coverage_of_each_scan(chain):
    engine = Engine(chain)
    inside = "SELECT * FROM logs WHERE block_number BETWEEN 10 AND 12"
    assert engine.sql(f"SELECT a.log_index FROM ({inside}) a JOIN ({inside}) b ON a.block_hash = b.block_hash").count() == 5
    assert engine.sql("SELECT 1 AS x").count() == 1 and engine.sql("SELECT * FROM information_schema.tables").count() == 1
    for sql in (f"SELECT COUNT(*) AS n FROM ({inside}) a, logs b", f"SELECT (SELECT COUNT(*) FROM logs) AS n FROM ({inside}) q", f"{inside} UNION ALL SELECT * FROM logs", f"SELECT * FROM ({inside}) q WHERE block_hash IN (SELECT block_hash FROM logs)", "SELECT SUM(data) FROM logs"):
        with pytest.raises(CoverageError):
            engine.sql(sql)
    assert engine.sql("SELECT SUM(data) FROM logs WHERE block_number >= 10").first()[0] == "0"
    assert Engine(chain, unverified=True).sql("SELECT COUNT(*) AS n FROM logs").first().n == 4
    with pytest.raises(CoverageError):
        engine.get_logs(LogFilter())
    assert engine.get_logs(LogFilter(from_block=10, to_block=12)).count() == 3
    with pytest.raises(CoverageError):
        admit(None, 1, 2)


def test_snapshots_compaction_and_reorganisation(spark, tmp_path):
    store = LogStore(spark, str(tmp_path / "s"), bucket_blocks=2)
    assert store.manifest().version == 0 and store.snapshot().logs().count() == 0
    store.append(frame(spark, [log(b, i) for b in range(1, 7) for i in range(2)]), Verified(1, 6))
    old = store.snapshot()
    store.append(frame(spark, [log(7, 0)]), Verified(1, 7))
    assert old.logs().count() == 12 and store.snapshot().logs().count() == 13 and store.snapshot().head == 7
    old.check()
    store.compact()
    assert store.snapshot().logs().count() == 13 and len(store.manifest().batches) == 1 and old.logs().count() == 12
    engine = Engine(store, unverified=True)
    store.reorganise(6, frame(spark, [log(6, 0, B)]), Verified(1, 6))
    with pytest.raises(SnapshotChanged):
        old.check()
    with pytest.raises(SnapshotChanged):
        engine.query("SELECT COUNT(*) AS n FROM logs")
    now = store.snapshot()
    assert now.head == 6 and sorted((r.block_number, r.address) for r in now.logs().collect())[-1] == (6, B) and now.logs().count() == 11
    assert now.stored(canonical_only=False).count() == 14
    store.compact(["address", "topic0", "block_number"])
    assert store.snapshot().logs().count() == 11 and store.snapshot().stored(canonical_only=False).count() == 11
    stale = store.manifest()
    store._commit(stale, stale)
    with pytest.raises(SnapshotChanged):
        store._commit(stale, stale)


def test_layouts_answer_alike(spark, tmp_path):
    rng = random.Random(1)
    data = [log(rng.randrange(50), i, rng.choice([A, B]), (TRANSFER, topic(rng.randrange(5)))[: rng.randrange(3)], "0x" + "ab" * rng.randrange(4), rng.randrange(2)) for i in range(200)]
    store = LogStore(spark, str(tmp_path / "s"), 10)
    for i in range(0, 200, 50):
        store.append(frame(spark, data[i : i + 50]))
    raw = Engine(store, unverified=True)
    memory = Engine(frame(spark, data))
    store.compact()
    packed = Engine(store, unverified=True)
    atoms = [f"address = '{A}'", "block_number BETWEEN 10 AND 30", "topic0 IS NULL", f"topic1 IN ('{topic(1)}', '{topic(2)}')", "data >= '0xab'", "data_len = 2", "source <> 1", "NOT (topic1 < topic0)"]
    for _ in range(12):
        parts = rng.sample(atoms, 3)
        where = f"{parts[0]} {rng.choice(['AND', 'OR'])} ({parts[1]} {rng.choice(['AND', 'OR'])} {parts[2]})"
        sql = f"SELECT block_number, log_index, data FROM logs WHERE {where} ORDER BY block_number, log_index"
        first, *others = (e.sql(sql).collect() for e in (memory, raw, packed))
        assert all(o == first for o in others)


def test_eth_filter(spark):
    rows = [log(1, 0, A, (topic(1), topic(2)), "0x01"), log(1, 1, B, (topic(1),)), log(2, 0, A, (topic(3), topic(2), topic(4)), "0x", 0, 1)]
    engine = Engine(frame(spark, rows))

    def found(**request):
        return [(int(r["blockNumber"], 16), int(r["logIndex"], 16)) for r in engine.eth_get_logs(request)]

    assert found() == [(1, 0), (1, 1), (2, 0)] and found(fromBlock="latest") == [(2, 0)] and found(fromBlock="earliest", toBlock="0x1") == [(1, 0), (1, 1)]
    assert found(address=B) == [(1, 1)] and found(address=[A, B.upper().replace("0X", "0x")]) == [(1, 0), (1, 1), (2, 0)] and found(address=[]) == found()
    assert found(topics=[None, topic(2)]) == [(1, 0), (2, 0)] and found(topics=[[topic(1), topic(3)], []]) == [(1, 0), (2, 0)] and found(topics=[None, None, None]) == [(2, 0)]
    assert found(topics=[[topic(1), None]]) == found() and found(blockHash=f"0x{1:064x}") == [(1, 0), (1, 1)] and found(limit=1, offset=1) == [(1, 1)] and found(unknown=1) == found()
    assert engine.eth_get_logs("{}")[0] == {"address": A, "topics": [topic(1), topic(2)], "data": "0x01", "blockNumber": "0x1", "blockHash": f"0x{1:064x}", "blockTimestamp": hex(1001), "transactionHash": f"0x{100:064x}", "transactionIndex": "0x0", "logIndex": "0x0", "removed": False}
    assert len(list(engine.stream_logs(LogFilter(descending=True)))) == 3
    for bad in ({"fromBlock": "pending"}, {"fromBlock": 1}, {"address": "0x12"}, {"topics": ["0x"]}, {"topics": [None] * 5}, {"blockHash": topic(1), "fromBlock": "0x1"}, {"limit": 10_001}, {"offset": 10_000}, {"limit": -1}, {"topics": [[None, "0x1"]]}):
        with pytest.raises(FilterError):
            EthFilter.parse(bad).to_log_filter(5)
    with pytest.raises(FilterError):
        EthFilter.parse('{"limit": 1, "limit": 2}')


def transfer(block, index, token, src, dst, value):
    return log(block, index, token, (TRANSFER, PAD + src[2:], PAD + dst[2:]), f"0x{value:064x}")


def test_net_flow(spark):
    rows = [transfer(1, 0, A, W1, W2, 2**200), transfer(1, 1, A, W2, W1, 7), transfer(2, 0, A, W1, W1, 5), transfer(2, 1, B, W2, W3, 9), log(2, 2, A, (TRANSFER, PAD + W1[2:], PAD + W2[2:], topic(4)), "0x")]
    got = net_flow(public_view(frame(spark, rows)), W1).collect()
    assert [tuple(r) for r in got] == [(A, "12", str(2**200 + 5), str(7 - 2**200))]


def test_transfer_requests():
    assert addresses(f"{W1}, {W2}\n{W1}") == (W1, W2) and addresses([W1.upper().replace("0X", "")]) == (W1,) and addresses(None) == ()
    assert [amount(x) for x in (None, 5, "12", "0xff")] == [None, 5, 12, 255]
    for bad in (1.5, True, -1, "x", str(2**256), 2**64, "-1"):
        with pytest.raises(FilterError):
            amount(bad)
    for bad in ({}, {"wallets": "zz"}, {"tokens": A, "min": 5, "max": 4}):
        with pytest.raises(FilterError):
            TransferFilter.parse(bad)


def test_subscriptions(spark, tmp_path):
    path, marks = str(tmp_path / "changes"), itertools.count()
    first = [transfer(1, 0, A, W1, W2, 10), transfer(1, 1, A, W3, W3, 10), transfer(2, 0, B, W2, W1, 3), log(2, 1, A)]
    live.publish(frame(spark, first), path, 1)
    stream = live.changes(spark, path)
    sessions = live.Sessions(stream, str(tmp_path / "marks"))
    session = sessions.create("mine", {"wallets": [W1], "min": 5}, once=True)
    sessions.open["mine"][1].awaitTermination(60)
    notes = sessions.get("mine")["notifications"]
    assert [(n["blockNumber"], n["from"], n["to"], n["rawAmount"], n["tokenAddress"]) for n in notes] == [(1, W1, W2, "10", A)]
    assert list(notes[0]) == ["type", "tokenAddress", "from", "to", "rawAmount", "blockNumber", "blockHash", "timestamp", "transactionHash", "transactionIndex", "logIndex", "removed"]
    live.publish(frame(spark, first[:1]), path, 2, removed=True)
    live.publish(frame(spark, [transfer(3, 0, A, W2, W1, 99)]), path, 2)
    query = live.subscribe_transfers(stream, {"wallets": [W1], "min": 5}, lambda rows: [session.add(live.as_notification(r)) for r in rows], str(tmp_path / "marks/mine"), once=True)
    query.awaitTermination(60)
    assert [n["blockNumber"] for n in sessions.get("mine")["notifications"]] == [3]
    sessions.clear("mine")
    assert sessions.get("mine") == {"id": "mine", "scope": "service", "dropped": 0, "notifications": []}
    sessions.delete("mine")
    for bad in (lambda: sessions.get("mine"), lambda: sessions.create("no name", {"wallets": [W1]}), lambda: sessions.create("x", {"wallets": [W1]}, scope="other"), lambda: live.subscribe_logs(stream, {"fromBlock": "latest"}, print, str(tmp_path / "m2"))):
        with pytest.raises(FilterError):
            bad()
    got = []
    live.subscribe_logs(stream, json.dumps({"address": B, "limit": 1}), got.extend, str(tmp_path / "m3"), once=True).awaitTermination(60)
    assert [(r.block_number, r.removed) for r in got] == [(2, False)] and next(marks) == 0


def test_subscription_to_a_table(spark, tmp_path):
    """Rows of a live filter as a table: each change once, also over a restart."""
    path, out, marks = (str(tmp_path / x) for x in ("changes", "out", "marks"))
    for seq in (1, 2):
        live.publish(frame(spark, [log(10 * seq, 0, address=A), log(10 * seq, 1, address=B)]), path, seq)
        live.subscribe_logs(live.changes(spark, path), {"address": A}, out, marks, once=True).awaitTermination()
    live.publish(frame(spark, [log(20, 0, address=A)]), path, 3, removed=True)
    live.subscribe_logs(live.changes(spark, path), {"address": A}, out, marks, once=True).awaitTermination()
    found = spark.read.parquet(out).orderBy("seq")
    assert [(r.seq, r.block_number, r.removed) for r in found.collect()] == [(1, 10, False), (2, 20, False), (3, 20, True)]


def test_session_bounds(monkeypatch):
    monkeypatch.setattr(live, "RETAINED", 3)
    s = live.Session("s", "dashboard")
    for i in range(5):
        s.add({"blockHash": "h", "logIndex": i, "removed": False})
    s.add({"blockHash": "h", "logIndex": 3, "removed": True})
    assert [n["logIndex"] for n in s.snapshot()["notifications"]] == [4, 2] and s.dropped == 2


def test_pruning_reaches_the_scan(chain):
    plan = Engine(chain).sql("SELECT log_index FROM logs WHERE block_number = 10 AND address = '0x'")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(block_number)" in plan and "EqualTo(address,0x)" in plan and "data" not in plan.split("ReadSchema")[1]
    assert F is not None
