"""Segmented scans against plain windows; flags and carried state of parsed turns; one session with half of all lines."""

import json
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyloom.operators import scan
from tallyloom.operators import turns as ops
from tallyloom.sources import transcripts

T0 = "2026-09-20T10:00:00Z"


@pytest.mark.parametrize("segment", [1, 8, 1 << 16])
def test_scan_equals_windows(spark, segment):
    rng = random.Random(segment)
    rows = [(rng.choice(["a", "b", None]), i, rng.random() < 0.4, rng.choice([None, None, "x", "y", "z"])) for i in range(200)]
    df = spark.createDataFrame(rows, "k string, seq long, hit boolean, v string")
    got = scan.scan(df, ("k",), "seq", {"nth": F.col("hit")}, {"last": F.col("v")}, segment=segment)
    w = Window.partitionBy("k").orderBy("seq")
    want = df.withColumn("nth", F.count_if("hit").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("last", F.last("v", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert not scan.scan(df.limit(0), ("k",), "seq", {"nth": F.col("hit")}, {}).collect()


def test_stamps_look_at_their_stretch_and_the_one_before(spark):
    rows = [("a", 0, True, False), ("a", 1, False, True), ("a", 1, False, False), ("a", 2, True, False), ("b", 1, None, True)]
    got = scan.stamps(spark.createDataFrame(rows, "k string, n long, stop boolean, shut boolean"), ("k",), "n", {"stopped": F.col("stop")}, {"after": F.col("shut")})
    assert {(r.k, r.n): (r.stopped, r.after) for r in got.collect()} == {("a", 0): (True, None), ("a", 1): (False, False), ("a", 2): (True, True), ("a", 3): (None, False), ("b", 1): (None, None), ("b", 2): (None, True)}


def test_a_hot_session_is_spread_over_its_segments(spark, monkeypatch):
    """Half of all turns in one session: no task of the scan holds more than twice the median."""
    df = spark.range(20_000).selectExpr("if(id < 10000, 'hot', concat('s', id % 40)) session_id", "if(id < 10000, id, id - 10000) seq", "id % 7 = 0 hit")
    monkeypatch.setattr(scan, "SEGMENT", 256)
    cut = df.withColumn("segment", F.floor(F.col("seq") / 256)).groupBy("session_id", "segment").count()
    assert cut.agg(F.max("count")).first()[0] <= 256
    out = scan.scan(df, ("session_id",), "seq", {"nth": F.col("hit")}, {}, segment=256)
    sizes = sorted(r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect())
    assert out.agg(F.sum("nth")).first()[0] == df.withColumn("n", F.count_if("hit").over(Window.partitionBy("session_id").orderBy("seq"))).agg(F.sum("n")).first()[0]
    parts = out.repartition(16, "session_id", F.floor(F.col("seq") / 256)).groupBy(F.spark_partition_id().alias("p")).count().collect()
    sizes = sorted(r["count"] for r in parts)
    assert sizes[-1] <= 2 * sizes[len(sizes) // 2]


def turn(mid, *, side=False, model="claude-sonnet-4-6", ts=T0, **usage):
    return {"type": "assistant", "timestamp": ts, "requestId": f"r-{mid}", "isSidechain": side, "message": {"role": "assistant", "id": mid, "model": model, "content": [], "usage": usage}}


def test_flags_of_parsed_turns(spark, tmp_path):
    a = [turn("hour", input_tokens=1, cache_creation_input_tokens=9, cache_creation={"ephemeral_1h_input_tokens": 4, "ephemeral_5m_input_tokens": 5}),
         turn("five", input_tokens=1, cache_read_input_tokens=3, cache_creation_input_tokens=9, cache_creation={"ephemeral_5m_input_tokens": 9}),
         turn("side", side=True, input_tokens=1, cache_creation_input_tokens=9), turn("web", output_tokens=1, server_tool_use={"web_search_requests": 2, "web_fetch_requests": 1}),
         turn("peak", model="deepseek-v4-pro", ts="2026-09-21T02:00:00Z", output_tokens=1), turn("calm", model="deepseek-v4-pro", ts="2026-09-21T05:00:00Z", output_tokens=1)]
    b = [{"type": "session", "version": 1, "id": "b", "timestamp": T0}, {"type": "thinking_level_change", "thinkingLevel": "low"}, {"type": "model_change", "modelId": "claude-haiku-4-5"},
         {"type": "message", "timestamp": T0, "message": {"role": "assistant", "id": "b1", "content": [], "usage": {"input": 5}}},
         {"type": "compaction", "tokensBefore": 700}, {"type": "compaction", "tokensBefore": 800}, {"type": "thinking_level_change", "thinkingLevel": "high"},
         {"type": "message", "timestamp": T0, "message": {"role": "assistant", "id": "b2", "content": [], "usage": {"input": 5}}},
         {"type": "message", "timestamp": T0, "message": {"role": "assistant", "id": "b3", "content": [], "usage": {"input": 5}}}]
    for name, lines in (("a", a), ("b", b)):
        (tmp_path / f"{name}.jsonl").write_text("\n".join(map(json.dumps, lines)) + "\n")
    got = {r.message_id: r for r in transcripts.turns(transcripts.read_lines(spark, str(tmp_path))).collect()}
    assert [(got[m].cache_ttl, got[m].cache_miss) for m in ("hour", "five", "side", "web")] == [("1h", True), ("5m", False), (None, False), (None, False)]
    assert (got["web"].web_searches, got["web"].web_fetches, got["web"].request_id) == (2, 1, "r-web")
    assert [got[m].peak_priced for m in ("peak", "calm", "web")] == [True, False, None]
    assert [(got[m].thinking_level, got[m].model, got[m].after_compaction, got[m].compaction_before) for m in ("b1", "b2", "b3")] == [
        ("low", "claude-haiku-4-5", False, None), ("high", "claude-haiku-4-5", True, 800), ("high", "claude-haiku-4-5", False, None)]


def test_turns_over_many_segments(spark, tmp_path, monkeypatch):
    """The same turns whatever the width of a segment."""
    rng, lines = random.Random(4), []
    for i in range(300):
        lines.append(rng.choice([turn(f"m{i}", input_tokens=i), turn(f"m{i}", input_tokens=i), {"type": "user", "timestamp": T0, "message": {"role": "user", "content": "[Request interrupted by user]"}},
                                 {"type": "user", "isCompactSummary": True, "timestamp": T0, "message": {"role": "user", "content": "s"}}, {"type": "user", "timestamp": T0, "message": {"role": "user", "content": "go"}}]))
    rows = spark.createDataFrame([(f, i, json.dumps(x)) for f in "ab" for i, x in enumerate(lines)], "file string, line_no long, line string")
    columns = ("session_id", "seq", "interrupted", "after_compaction")
    found = []
    for width in (17, 1 << 16):
        monkeypatch.setattr(scan.scan, "__defaults__", (None, None, width))
        found.append(sorted(map(str, ops.previous_context(transcripts.turns(rows)).select(*columns, "prev_ctx").collect())))
    assert found[0] == found[1] and len(found[0]) > 100
