"""Transcripts of both schemas: control lines, pricing, categories, splits."""

import json

from pyspark.sql import functions as F

from tallyloom.operators import turns as ops
from tallyloom.sources import transcripts

T0 = "2026-09-20T10:00:00Z"


def answer(mid, content, **usage):
    return {"type": "assistant", "timestamp": T0, "message": {"role": "assistant", "id": mid, "model": "claude-sonnet-4-6", "content": content, "usage": usage}}


def tool(name, **args):
    return {"type": "tool_use", "name": name, "input": args}


LINES = [
    {"type": "user", "timestamp": T0, "message": {"role": "user", "content": "go"}},
    answer("p1", [tool("Write", file_path="docs/x.md")], input_tokens=2, output_tokens=300, cache_creation_input_tokens=48278, cache_creation={"ephemeral_1h_input_tokens": 48278, "ephemeral_5m_input_tokens": 0}),
    answer("p2", [tool("Edit", file_path="src/a.ts")], input_tokens=2, output_tokens=500, cache_read_input_tokens=50000),
    {"type": "user", "timestamp": T0, "message": {"role": "user", "content": [{"type": "text", "text": "[Request interrupted by user]"}]}},
    answer("p3", [tool("Bash", command="pytest -x")], input_tokens=2, output_tokens=5),
    answer("p3", [tool("Bash", command="pytest -x")], input_tokens=2, output_tokens=120),
    {"type": "system", "subtype": "compact_boundary", "timestamp": T0},
    {"type": "user", "isCompactSummary": True, "timestamp": T0, "message": {"role": "user", "content": "summary"}},
    answer("p4", [{"type": "text", "text": "ok"}], input_tokens=2, output_tokens=50, cache_creation_input_tokens=40000, cache_creation={"ephemeral_1h_input_tokens": 40000, "ephemeral_5m_input_tokens": 0}),
    answer("p6", [tool("WebSearch")], input_tokens=2, output_tokens=10, server_tool_use={"web_search_requests": 2, "web_fetch_requests": 0}),
]


def test_both_schemas(spark, tmp_path):
    other = [
        {"type": "session", "version": 1, "id": "b", "timestamp": T0},
        {"type": "model_change", "modelId": "claude-haiku-4-5"},
        {"type": "message", "timestamp": T0, "message": {"role": "assistant", "id": "q1", "content": [{"type": "toolCall", "name": "read", "arguments": {"path": "tests/t.py"}}], "usage": {"input": 10, "output": 20, "cacheRead": 0, "cacheWrite": 0, "cost": {"total": 0.0049}}}},
        {"type": "message", "timestamp": T0, "message": {"role": "assistant", "id": "q2", "content": [], "usage": {"input": 1000, "output": 0, "cost": {"total": 0}}}},
    ]
    (tmp_path / "a.jsonl").write_text("\n".join(map(json.dumps, LINES)) + "\nnot json\n")
    (tmp_path / "b.jsonl").write_text("\n".join(map(json.dumps, other)) + "\n")
    rows = transcripts.turns(transcripts.read_lines(spark, str(tmp_path)))
    one = ops.dedup_max_cost(rows.select("session_id", "message_id", "seq", "model", "is_sidechain", "after_compaction", "iterations", "in_tok", "out_tok", "cr_tok", "cw_tok", "cost_ticks", "write_ticks", "category", "server_ticks"))
    split = {r["message_id"]: r for r in ops.split_overhead(ops.previous_context(one)).collect()}
    usd = {k: r["cost_ticks"] / 1e10 for k, r in split.items()}
    assert usd["p1"] == 0.294174
    assert {k: r["category"] for k, r in split.items()} == {
        "p1": "spec", "p2": "interrupted", "p3": "tests", "p4": "prompt", "p4#oh": "compaction", "p6": "web", "q1": "tests", "q2": "other"}
    assert usd["p4#oh"] == 0.24 and usd["p4"] == 0.000756 and usd["p3"] == (2 * 3 + 120 * 15) / 1e6
    assert split["p6"]["server_ticks"] == 600_000_000
    assert usd["q1"] == 0.0049 and split["q2"]["model"] == "claude-haiku-4-5" and usd["q2"] == 0.001


def test_uncounted(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text("\n".join(map(json.dumps, LINES)))
    found = transcripts.entries(transcripts.read_lines(spark, str(tmp_path))).groupBy("uncounted").count().where(F.col("uncounted").isNotNull()).collect()
    assert [tuple(r) for r in found] == [("compaction", 1)]


def test_iterations_are_counted(spark, tmp_path):
    again = dict(input_tokens=2, output_tokens=50, cache_creation_input_tokens=40000, cache_creation={"ephemeral_1h_input_tokens": 40000, "ephemeral_5m_input_tokens": 0})
    kinds = {"none": {}, "one": {"iterations": [{"type": "message"}]}, "two": {"iterations": [{"type": "message"}, {"type": "message"}]}, "empty": {"iterations": []}, "odd": {"iterations": {"a": 1}}}
    lines = [answer("first", [tool("Edit", file_path="src/a.ts")], **again)] + [answer(k, [tool("Edit", file_path="src/a.ts")], **again, **v) for k, v in kinds.items()]
    (tmp_path / "a.jsonl").write_text("\n".join(map(json.dumps, lines)))
    rows = transcripts.turns(transcripts.read_lines(spark, str(tmp_path)))
    assert {r["message_id"]: r["iterations"] for r in rows.collect()} == {"first": None, "none": None, "one": 1, "two": 2, "empty": 0, "odd": None}
    split = {r["message_id"] for r in ops.split_overhead(ops.previous_context(rows)).collect()}
    assert {x for x in split if x.endswith("#oh")} == {"none#oh", "one#oh", "empty#oh", "odd#oh"} and "two" in split


def test_lines_keep_their_order_over_splits(spark, tmp_path):
    lines = [json.dumps({"type": "x", "timestamp": T0, "n": i, "pad": "p" * (i % 700)}) for i in range(3000)]
    (tmp_path / "a.jsonl").write_text("\n".join(lines[:10] + ["", "  "] + lines[10:]))
    (tmp_path / "b.jsonl").write_text("\n".join(lines[:50]) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        rows = transcripts.read_lines(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    for name, n in (("a", 3000), ("b", 50)):
        own = sorted((r["line_no"], r["line"]) for r in rows if r["file"].endswith(f"{name}.jsonl"))
        assert [x for _, x in own] == lines[:n]
        assert [i for i, _ in own] == ([*range(10), *range(12, 3002)] if name == "a" else list(range(50)))


def test_commands_decide_files_and_category(spark, tmp_path):
    lines = [answer("a", [tool("Bash", command="cd x && sed -i 's/a/b/' src/main.ts")]), answer("b", [tool("Bash", command="FOO=1 gh issue view 3")]), answer("c", [tool("mcp__box__web_search")]),
             answer("d", [{"type": "text", "text": "hi"}, tool("Bash", command="cd /somewhere")]), answer("e", [tool("Bash", command="echo hi")])]
    (tmp_path / "a.jsonl").write_text("\n".join(map(json.dumps, lines)))
    got = {r["message_id"]: (r["category"], [tuple(f) for f in r["files"]]) for r in transcripts.turns(transcripts.read_lines(spark, str(tmp_path))).collect()}
    assert got == {"a": ("code", [("src/main.ts", "write")]), "b": ("spec", []), "c": ("web", []), "d": ("prompt", []), "e": ("other", [])}
