"""States of sessions: served, idle, tried again, forgotten; a moved session goes on, what was uncounted stays so."""

import time

from tallyloom.streaming import sessions
from tallyloom.streaming.sessions import Record, observed, struck

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def test_tries_are_counted_and_end():
    r = Record()
    for n in range(1, sessions.MOST_TRIES + 1):
        r = observed(r, "p", n, False, False)
        assert (r.state, r.tries, r.pending) == ("retrying", n, True)
        assert observed(r, "p", n, False, False) == r  # one is pending already
        r = struck(r, n, 100, 100)
        assert not r.pending
    r = observed(r, "p", 9, False, False)
    assert (r.state, r.tries) == ("given-up", 0)
    r = observed(r, "p", 10, True, False)
    assert (r.state, r.since_ms) == ("served", 10)


def test_idle_forgotten_and_moved():
    r = observed(Record(), "old", 5, True, True)
    assert struck(r, 50, 100, 1000) == r
    idle = struck(r, 105, 100, 1000)
    assert (idle.state, idle.since_ms) == ("idle", 5)
    assert struck(idle, 1104, 100, 1000) == idle and struck(idle, 1105, 100, 1000) is None
    moved = observed(idle, "new", 200, True, False)
    assert (moved.path, moved.state, moved.uncounted, moved.since_ms) == ("new", "served", True, 200)
    assert observed(moved, "new", 300, True, False).since_ms == 200


def test_states_of_a_stream(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    schema = "session_id string, path string, seen_ms long, readable boolean, uncounted boolean"
    now = int(time.time() * 1000)
    rows = [("a", "p1", now, True, True), ("a", "p2", now + 1, True, False), ("b", "q", now, False, False)]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    out = sessions.session_states(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), idle_ms=2000, forget_ms=1000, retry_ms=500)
    put = lambda b, n: b.write.mode("overwrite").parquet(f"{tmp_path}/out/batch={n}")
    query = out.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", str(tmp_path / "ck")).trigger(processingTime="1 second").start()
    try:
        end = time.time() + 90
        seen: dict = {}
        while time.time() < end and ("forgotten" not in seen.get("a", []) or "forgotten" not in seen.get("b", [])):
            time.sleep(2)
            try:
                found = spark.read.parquet(str(tmp_path / "out")).orderBy("batch").collect()
            except Exception:  # noqa: BLE001  nothing is written yet
                continue
            seen = {k: [r.state for r in found if r.session_id == k] for k in "ab"}
    finally:
        query.stop()
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    assert seen["a"] == ["served", "idle", "forgotten"] and seen["b"][0] == "retrying" and seen["b"][-1] == "forgotten"
    first = [r for r in found if r.session_id == "a"][0]
    assert first.path == "p2" and first.uncounted
