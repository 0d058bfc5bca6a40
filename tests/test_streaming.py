import json
import os
import time

import pytest
from pyspark.sql import functions as F

from tallyloom.operators import turns as turn_ops
from tallyloom.sources import transcripts
from tallyloom.streaming import ingest, tail

T0 = "2026-09-20T10:00:00Z"


def test_stream_equals_batch(spark, tmp_path):
    src = spark.sql("select cast(id % 3 as string) model, id in_tok, 1L cr_tok, id % 2 session_id, timestamp'2026-01-01' + make_interval(0,0,0,0,0,0,id) ts from range(40)")
    src.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(src.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    ingest.write_facts(stream, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(120)
    facts = spark.read.parquet(str(tmp_path / "out"))
    assert facts.count() == 40 and facts.selectExpr("sum(in_tok)").first()[0] == 780
    rate = ingest.token_rate(src, "10 seconds", "10 seconds").selectExpr("sum(tokens)").first()[0]
    assert rate == 820
    assert ingest.spawn_windows(src, "5 seconds").count() == 2


def lines_of_sessions():
    """Two sessions whose turns, interrupts, compactions and model changes fall on all sides of a micro-batch's border."""
    say = lambda mid, n, **more: {"type": "assistant", "timestamp": T0, **more, "message": {"role": "assistant", "id": mid, "model": "claude-sonnet-4-6", "content": [], "usage": {"input_tokens": n, "output_tokens": 1}}}
    stop = {"type": "user", "timestamp": T0, "message": {"role": "user", "content": "[Request interrupted by user]"}}
    compact = {"type": "user", "isCompactSummary": True, "timestamp": T0, "message": {"role": "user", "content": "s"}}
    other = lambda mid: {"type": "message", "timestamp": T0, "message": {"role": "assistant", "id": mid, "content": [], "usage": {"input": 4, "output": 1}}}
    model = {"type": "model_change", "modelId": "claude-haiku-4-5"}
    think = {"type": "thinking_level_change", "thinkingLevel": "high"}
    freed = {"type": "compaction", "tokensBefore": 900}
    return {"a": [stop, compact, say("a1", 10), say("a2", 20, isSidechain=True), stop, stop, say("a3", 30), compact, say("a3", 31), stop], "b": [model, other("b1"), think, other("b2"), stop, freed, other("b3")]}


COLUMNS = ["session_id", "seq", "ts_ms", "message_id", "model", "is_sidechain", "in_tok", "out_tok", "cr_tok", "cw_tok", "rs_tok", "interrupted", "after_compaction", "compaction_before", "thinking_level", "prev_ctx",
           "cost_ticks", "category", "cache_miss"]
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@pytest.fixture(autouse=True)
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


@pytest.mark.parametrize("size", [3, 100])
def test_turns_of_a_stream_equal_the_batch(spark, tmp_path, size):
    rows = [(s, i, json.dumps(e)) for s, es in lines_of_sessions().items() for i, e in enumerate(es)]
    schema = "file string, line_no int, line string"
    whole = spark.createDataFrame(rows, schema)
    want = turn_ops.previous_context(transcripts.turns(whole)).select(*COLUMNS).collect()
    # every second micro-batch repeats the line before it
    for n, a in enumerate(range(0, 11, size)):
        part = [r for r in rows if a - n % 2 <= r[1] < a + size]
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = tail.session_turns(tail.flat_entries(stream), idle_ms=None)
    query = out.writeStream.outputMode("update").foreachBatch(lambda b, n: b.write.mode("overwrite").parquet(f"{tmp_path}/out/batch={n}"))
    query = query.option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    assert query.awaitTermination(100)
    facts = spark.read.parquet(str(tmp_path / "out"))
    got = transcripts.finished(tail.newest(facts))
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, got.select(*COLUMNS).collect()), key=key) == sorted(map(tuple, want), key=key)
    assert [r["seq"] for r in got.where("not settled").orderBy("session_id").collect()] == [8, 6]
    # what was taken back cancels what was said, row by row
    said = facts.drop("batch", "settled")
    held = said.groupBy(*[c for c in said.columns if c != "delta"]).agg(F.sum("delta").alias("n"))
    assert {r["n"] for r in held.where("seq >= 0").collect()} <= {0, 1} and held.where("n = 1").count() == len(want)


def test_polls_retract_what_a_file_no_longer_says(spark, tmp_path):
    logs, table = tmp_path / "logs", str(tmp_path / "table")
    logs.mkdir()
    sessions = lines_of_sessions()
    put = lambda name, es, at: ((logs / f"{name}.jsonl").write_text("\n".join(map(json.dumps, es)) + "\n"), os.utime(logs / f"{name}.jsonl", (at, at)))
    told = lambda: sorted(r["message_id"] for r in tail.polled(spark, table).collect())
    put("a", sessions["a"][:4], 1_700_000_000)
    put("b", sessions["b"][:2], 1_700_000_000)
    tail.poll(spark, str(logs), table, 1)
    assert told() == ["a1", "a2", "b1"]
    put("a", sessions["a"], 1_700_001_000)
    tail.poll(spark, str(logs), table, 2, "2023-11-14T22:20:00")
    assert told() == ["a1", "a2", "a3", "a3", "b1"]
    assert {r["session_id"][-7:] for r in spark.read.parquet(f"{table}/turns/generation=2").collect()} == {"a.jsonl"}
    put("a", sessions["a"][:2], 1_700_002_000)
    tail.poll(spark, str(logs), table, 3, "2023-11-14T22:40:00")
    tail.poll(spark, str(logs), table, 4, "2023-11-14T23:40:00")
    assert told() == ["b1"]


def test_polls_by_listing_see_deleted_moved_and_same_second_files(spark, tmp_path):
    logs, table = tmp_path / "logs", str(tmp_path / "table")
    logs.mkdir()
    sessions = lines_of_sessions()
    put = lambda name, es, at: ((logs / f"{name}.jsonl").write_text("\n".join(map(json.dumps, es)) + "\n"), os.utime(logs / f"{name}.jsonl", (at, at)))
    told = lambda: sorted(r["message_id"] for r in tail.polled(spark, table).collect())
    at = 1_700_000_000
    put("a", sessions["a"][:4], at)
    put("b", sessions["b"][:2], at)
    tail.poll_changes(spark, str(logs), table, 1)
    assert told() == ["a1", "a2", "b1"]
    put("a", sessions["a"], at)  # within the second: the size alone tells
    tail.poll_changes(spark, str(logs), table, 2)
    assert told() == ["a1", "a2", "a3", "a3", "b1"]
    assert {os.path.basename(r.file) for r in spark.read.parquet(f"{table}/files/generation=2").collect()} == {"a.jsonl"}
    (logs / "b.jsonl").rename(logs / "c.jsonl")
    (logs / "a.jsonl").unlink()
    tail.poll_changes(spark, str(logs), table, 3)
    assert told() == ["b1"] and {os.path.basename(r.session_id) for r in tail.polled(spark, table).collect()} == {"c.jsonl"}
    tail.poll_changes(spark, str(logs), table, 4)
    assert told() == ["b1"]


def test_late_rows_fall_behind_the_watermark(spark, tmp_path):
    schema = "model string, in_tok long, cr_tok long, session_id long, ts timestamp"
    batches = [("m", 1, 0, 1, "2026-01-01 00:00:05"), ("m", 2, 0, 1, "2026-01-01 00:01:00"), ("m", 4, 0, 1, "2026-01-01 00:00:50"), ("m", 8, 0, 1, "2026-01-01 00:00:06"), ("m", 16, 0, 1, "2026-01-01 00:05:00")]
    for r in batches:
        spark.createDataFrame([r], "model string, in_tok long, cr_tok long, session_id long, ts string").withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    for name, build, want in (
            ("rate", lambda s: ingest.token_rate(s, "10 seconds", "10 seconds").select(F.date_format("window.start", "mm:ss").alias("at"), "tokens"), [("00:00", 1), ("00:50", 4), ("01:00", 2)]),
            ("spawn", lambda s: ingest.spawn_windows(s, "20 seconds").select(F.date_format("session_window.start", "mm:ss").alias("at"), "turns"), [("00:05", 1), ("00:50", 2)])):
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        query = build(stream).writeStream.outputMode("append").format("parquet").option("checkpointLocation", str(tmp_path / name / "ck")).trigger(availableNow=True)
        assert query.start(str(tmp_path / name / "out")).awaitTermination(100)
        assert sorted(map(tuple, spark.read.parquet(str(tmp_path / name / "out")).collect())) == want


def test_a_silent_session_gives_up_its_state(spark, tmp_path):
    schema = "file string, line_no int, line string"
    spark.createDataFrame([("a", i, json.dumps(e)) for i, e in enumerate(lines_of_sessions()["a"])], schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    out = tail.session_turns(tail.flat_entries(stream), idle_ms=1)
    query = out.writeStream.outputMode("update").format("noop").option("checkpointLocation", str(tmp_path / "ck")).trigger(processingTime="1 second").start()
    try:
        held = lambda: [(p["stateOperators"][0]["numRowsUpdated"], p["stateOperators"][0]["numRowsRemoved"], p["stateOperators"][0]["numRowsTotal"]) for p in query.recentProgress if p["stateOperators"]]
        end = time.time() + 60
        while time.time() < end and not any(removed for _, removed, _ in held()):
            time.sleep(1)
        seen = held()
        assert seen[0][2] == 1 and (1, 0) in [s[1:] for s in seen]
    finally:
        query.stop()


def test_children_meet_turns_as_both_streams_run(spark, tmp_path):
    at = lambda s: f"2026-01-01 00:{s // 60:02d}:{s % 60:02d}"
    turns_in = [[("a", 1, "s", at(100)), ("b", 1, "s", at(110)), ("a", 2, "t", at(130))], [("a", 3, "s", at(400))], [("a", 4, "t", at(800))]]
    # c1 is before its turn by 15 s, c2 after it by 15, c3 by 16; c4 comes a micro-batch after its turn
    children_in = [[("c1", "s", at(85)), ("c2", "s", at(115)), ("c3", "t", at(146))], [("c4", "s", at(401))], [("c5", "u", at(800))]]
    sides = {}
    for name, batches, schema in (("turns", turns_in, "session_id string, seq long, slug string, ts string"), ("children", children_in, "child string, child_slug string, first_ts string")):
        when = schema.split()[-2]
        for batch in batches:
            spark.createDataFrame(batch, schema).withColumn(when, F.to_timestamp(when)).coalesce(1).write.mode("append").parquet(str(tmp_path / name))
        sides[name] = spark.readStream.schema(schema[: -len("string")] + "timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / name))
    found = ingest.spawned_children(sides["turns"], sides["children"])
    query = found.writeStream.outputMode("append").format("parquet").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start(str(tmp_path / "out"))
    assert query.awaitTermination(100)
    facts = spark.read.parquet(str(tmp_path / "out"))
    assert sorted((r["session_id"], r["seq"], r["child"] or "") for r in facts.collect()) == [("a", 1, "c1"), ("a", 1, "c2"), ("a", 2, ""), ("a", 3, "c4"), ("b", 1, "c2")]
    assert sorted((r["child"], r["session_id"], r["seq"]) for r in ingest.first_claims(facts.union(facts)).collect()) == [("c1", "a", 1), ("c2", "a", 1), ("c4", "a", 3)]


def test_ceilings(spark):
    rates = spark.createDataFrame([("deepseek-v4-pro", 10**9), ("claude-sonnet-4-6", 10**9), ("claude-sonnet-4-6", 5)], "model string, tokens long")
    assert [(r["over"], r["waits"]) for r in ingest.over_ceiling(rates).collect()] == [(True, False), (True, True), (False, False)]
