"""Listings and their differences, ends of files, outside schemas, audits, and functions that only reports call."""

import json
import os
import random
import time

import pytest
from pyspark.sql import functions as F

from tallyloom.functions import names
from tallyloom.operators import audit, children, trees
from tallyloom.sources import catalog, facts, transcripts

T0 = "2026-09-20T10:00:00Z"


def test_last_directories_read_ends_only(spark, tmp_path):
    line = lambda cwd, pad=0: json.dumps({"type": "user", "cwd": cwd, "pad": "p" * pad}) + "\n"
    fill = json.dumps({"type": "assistant", "pad": "p" * 900}) + "\n"
    texts = {"near": line("/old") + fill * 2000 + line("/near"), "middle": fill * 2000 + line("/middle") + fill * 40, "far": fill * 2000 + line("/far") + fill * 300, "beyond": line("/lost") + fill * 2000,
             "small": line("/small"), "whole": line("/whole") + fill * 20, "torn": fill * 100 + line("/ok") + '{"cwd": "/torn', "odd": line("/ok") + '{"cwd": 7}\n["cwd"]\n', "empty": ""}
    for name, text in texts.items():
        (tmp_path / f"{name}.jsonl").write_text(text)
    files = spark.createDataFrame([(str(tmp_path / f"{n}.jsonl"),) for n in [*texts, "missing"]], "path string")
    got = {os.path.basename(r.path)[:-6]: (r.last_cwd, r.bytes_read) for r in catalog.last_directories(files).collect()}
    assert {k: v[0] for k, v in got.items()} == {"near": "/near", "middle": "/middle", "far": "/far", "beyond": None, "small": "/small", "whole": "/whole", "torn": "/ok", "odd": "/ok", "empty": None, "missing": None}
    assert [got[n][1] for n in ("near", "middle", "far", "beyond")] == [8 << 10, 64 << 10, 512 << 10, 512 << 10] and got["small"][1] == len(texts["small"]) and max(v[1] for v in got.values()) <= 512 << 10


def test_listings_differ_by_stamp(spark):
    schema = "path string, size long, mtime_ms long, inode long"
    before = [("same", 1, 1, 1), ("grew", 1, 1, 2), ("inplace", 5, 5, 3), ("gone", 1, 1, 4), ("from", 9, 9, 5), ("noinode", 1, 1, None), ("lost", 2, 2, None)]
    now = [("same", 1, 1, 1), ("grew", 2, 1, 2), ("inplace", 5, 6, 3), ("to", 9, 9, 5), ("noinode", 1, 1, None), ("fresh", 2, 2, None), ("twin", 9, 9, 5)]
    got = {r.path: (r.change, r.was) for r in catalog.changes(spark.createDataFrame(before, schema), spark.createDataFrame(now, schema)).collect()}
    assert got == {"grew": ("changed", None), "inplace": ("changed", None), "gone": ("gone", None), "to": ("moved", "from"), "twin": ("new", None), "lost": ("gone", None), "fresh": ("new", None)}
    assert not catalog.changes(spark.createDataFrame(now, schema), spark.createDataFrame(now, schema)).collect()


def third_schema():
    """A log of its own making, told in the words of schema a."""
    def as_line(line):
        get = lambda p: F.get_json_object(line, p)
        usage = F.struct(get("$.spent.prompt").cast("bigint").alias("input_tokens"), get("$.spent.reply").cast("bigint").alias("output_tokens"))
        return F.from_json(F.to_json(F.struct(F.lit("assistant").alias("type"), get("$.when").alias("timestamp"), F.struct(
            F.lit("assistant").alias("role"), get("$.nr").alias("id"), get("$.engine").alias("model"), F.lit("[]").alias("content"), usage.alias("usage")).alias("message"))), transcripts.LINE)

    return transcripts.Outside("third", lambda line: F.get_json_object(line, "$.kind") == "reply", as_line)


def test_an_outside_schema_is_read_beside_the_others(spark):
    mine = {"kind": "reply", "when": T0, "nr": "t1", "engine": "claude-sonnet-4-6", "spent": {"prompt": 10, "reply": 20}}
    own = {"type": "assistant", "timestamp": T0, "message": {"role": "assistant", "id": "a1", "model": "claude-sonnet-4-6", "content": [], "usage": {"input_tokens": 10, "output_tokens": 20}}}
    lines = spark.createDataFrame([("f", i, json.dumps(x)) for i, x in enumerate([own, mine, {"kind": "noise"}])], "file string, line_no long, line string")
    before = transcripts.turns(lines).count()
    transcripts.register(third_schema())
    try:
        got = {r.message_id: (r.cost_ticks, r.in_tok, r.out_tok) for r in transcripts.turns(lines).collect()}
        assert {r.harness for r in transcripts.entries(lines).where("harness is not null").collect()} == {"a", "third"}
    finally:
        transcripts.forget("third")
    assert before == 1 and got["t1"] == got["a1"] and set(got) == {"a1", "t1"}
    with pytest.raises(ValueError):
        transcripts.register(transcripts.Outside("a", None, None))
    failed = transcripts.load(["no.such:thing", "json:dumps", "json:nothing", "nocolon"])
    assert len(failed) == 4


def test_alignment_of_a_million_rows_takes_seconds():
    rng = random.Random(1)
    records, turns = [rng.randint(0, 50) for _ in range(300_000)] + [-1] * 700_000, [rng.randint(0, 50) for _ in range(1_000_000)]
    began = time.time()
    found = audit.next_free(records, turns)
    assert time.time() - began < 20 and found[-1] is None
    assert all(turns[j] == r for r, j in zip(records[:1000], found[:1000]) if j is not None)
    taken = [j for j in found if j is not None]
    assert taken == sorted(set(taken))


def test_directories_of_turns(spark):
    lines = [{"type": "user", "cwd": "/a"}, {"type": "assistant", "n": 1}, {"type": "assistant", "n": 2, "cwd": "/b"}, {"type": "user", "cwd": ""}, {"type": "assistant", "n": 3}]
    rows = spark.createDataFrame([(f, i, json.dumps(x)) for f in ("f", "g") for i, x in enumerate(lines if f == "f" else lines[1:2])], "file string, line_no long, line string")
    turns = rows.where(F.get_json_object("line", "$.n").isNotNull()).select(F.col("file").alias("session_id"), F.col("line_no").alias("seq"))
    assert {(r.session_id, r.seq): r.cwd for r in audit.directories_of_turns(rows, turns).collect()} == {("f", 1): "/a", ("f", 2): "/b", ("f", 4): "/b", ("g", 0): None}


def test_reviews_and_runs(spark):
    log = lambda **x: json.dumps({"branch": "feat", "status": "reviewed", "utc": "2026-01-01T00:00:00Z", "findings": [], **x})
    name = lambda n, branch="feat": f"/logs/{branch}-2026-01-0{n}T00-00-00Z-7.json"
    logs = [(name(1), log(utc="2026-01-02T00:00:00Z", findings=[1, 2])), (name(2), log(findings=[1])), (name(3), log(status="failed")), (name(4), "torn {"), (name(5), log(findings=3)), (name(6), log(utc=5)),
            (name(7, "feat-2"), log()), (name(8), log(branch="other")), ("/logs/feat-notes.json", "torn")]
    r = audit.reviews(spark.createDataFrame(logs, "path string, text string"), "feat").first()
    assert (r.rounds, r.findings, r.unreadable) == (2, [1, 2], 3)
    runs = [('{"branch": "feat"}',), ('{"branch": "x"}',), ("torn",), ('{"branch": 4}',), ("  ",), ("[]",)]
    assert tuple(audit.suite_runs(spark.createDataFrame(runs, "line string"), "feat").first()) == (1, 3)


def test_catalog_predicates(spark):
    now = 10_000_000
    seen = spark.createDataFrame([("a", "w1", now - 5), ("a", "w2", now - 50_000), ("b", "w1", now - 500_000)], "path string, writer string, mtime_ms long")
    assert [tuple(r) for r in catalog.recent_writers(seen, now).collect()] == [("a", now - 5)]
    idle = spark.createDataFrame([("x", now - 100), ("y", now - 1000)], "k string, since long")
    assert [r.k for r in catalog.idle_since(idle, "since", now, 1000).collect()] == ["y"]
    big = spark.createDataFrame([(f"p{i}", 50_000 + i, now * 1000) for i in range(9)] + [("small", 10, now * 1000), ("old", 90_000, 0)], "path string, size long, mtime_ms long")
    assert [r.path for r in catalog.picked(big, 3, now * 1000).collect()] == ["p0", "p1", "p2"]
    drawn = {r.path for r in catalog.picked(big, 4, now * 1000, seed=1).collect()}
    assert len(drawn) == 4 and drawn <= {f"p{i}" for i in range(9)}
    health = spark.createDataFrame([("beats", 100, 95, 10, 5, 0), ("large", 100, 1, 2 << 20, 5, 0), ("empty", 3, 0, 10, 0, 0), ("fine", 5, 5, 10, 1, 0), ("young", 3, 0, 10, 0, now)], "path string, lines long, heartbeats long, size long, turns long, mtime_ms long")
    assert {r.path: r.why for r in catalog.writer_health(health, now).collect()} == {"beats": "heartbeats", "large": "large", "empty": "empty"}
    states = [{"message": {"model": "m1"}}, {"thinkingLevel": "low"}, {"message": {"model": "m2"}}]
    lines = spark.createDataFrame([("f", i, json.dumps(x)) for i, x in enumerate(states)], "file string, line_no long, line string")
    assert [tuple(r) for r in catalog.last_state(lines).collect()] == [("f", "m2", "low")]
    heads = spark.createDataFrame([("f", 5), ("g", 50)], "file string, started_ms long")
    assert [r.file for r in catalog.started_between(heads, 0, 5).collect()] == ["f"]
    edge = spark.createDataFrame([("p", "c", "fork", T0, None, "l", None)], "parent string, child string, mechanism string, ts string, cwd string, label string, model string")
    assert json.loads(catalog.edge_line(edge).first().line) == {"parent": "p", "child": "c", "mechanism": "fork", "ts": T0, "label": "l"}


def test_children_and_facts(spark):
    one = spark.createDataFrame([("/x/Alpha.jsonl", None, 5), ("/x/b.jsonl", "My ALPHA", 9), ("/x/c.jsonl", "other", 7)], "path string, name string, mtime_ms long")
    assert {r.path for r in one.where(children.matches("alpha")).collect()} == {"/x/Alpha.jsonl", "/x/b.jsonl"}
    every = children.discover_all({"a": one, "b": one.limit(1)}, since_ms=6).collect()
    assert [(r.path, r.harness) for r in every] == [("/x/b.jsonl", "a"), ("/x/c.jsonl", "a")]
    basis = spark.createDataFrame([("inferred", "tmp", 5), ("inferred", "tmp", None), ("named", "x", 3)], "tier string, basis string, ticks long")
    assert [tuple(r) for r in children.basis_totals(basis).collect()] == [("tmp", 2, 5, 1)]
    tables = spark.createDataFrame([("s", "2", False, 9, "b"), ("s", "2", True, 1, "a"), ("t", "1", True, 5, "c"), ("t", "0", True, 7, "d")], "session_id string, version string, own_project boolean, mtime_ms long, path string")
    assert {r.session_id: r.path for r in facts.latest_version(tables, "2").collect()} == {"s": "a", "t": "d"}
    assert spark.range(1).select(facts.generation_line(F.lit("src")).alias("l")).first().l == '{"_gen":{"s":"src"}}'
    assert spark.range(1).select(names.file_stamp(F.lit(3), F.lit(4), F.lit(5)).alias("l")).first().l == "3:4:5"
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id string")
    assert sorted(r.session_id for r in trees.self_attributed(ids("a", "b"), ids("b", "c")).collect()) == ["a", "b", "c"]
    held = spark.createDataFrame([("p", "a", 5), ("p", "b", None), ("p", "c", 9), ("q", "d", 1)], "parent string, child string, ticks0 long")
    rows = children.child_rows(held.select("parent", "child"), held.select("child", F.col("ticks0").alias("ticks")), "child", shown=2, by=("parent",)).collect()
    assert {(r.parent, r.child, r.place, r.more) for r in rows} == {("p", "c", 1, 1), ("p", "a", 2, 1), ("q", "d", 1, 0)}


def test_sessions_of_all_checkouts(spark):
    rows = [("a", "p1", "-w-repo", "/elsewhere", 1), ("a", "p2", "-w-other", "/w/repo", 5), ("b", "p3", "-w-repo-wt-1", None, 2), ("c", "p4", "-w-none", "/w/none", 3), ("d", "p5", "-w-none", "/w/repo", 4), ("e", "p6", None, None, 9)]
    catalog_ = spark.createDataFrame(rows, "session_id string, path string, slug string, last_cwd string, mtime_ms long")
    dirs = spark.createDataFrame([("/w/repo",)], "cwd string")
    assert {r.session_id: r.path for r in children.discover_everywhere(catalog_, dirs, ("-w-repo-",)).collect()} == {"a": "p2", "b": "p3", "d": "p5"}
    assert {r.session_id for r in children.discover_everywhere(catalog_, dirs).collect()} == {"a", "d"}
    assert {r.session_id for r in children.discover_everywhere(catalog_).collect()} == set("abcde")
    listed = spark.createDataFrame([("2026-01-02", "b"), ("2026-01-01", "z"), ("2026-01-02", "a")], "started string, path string")
    assert [r.path for r in children.by_start(listed).collect()] == ["z", "a", "b"]


def test_counter_logs(spark):
    log = [{"_epoch_ms": 5, "cost": {"total_cost_usd": 1.5}, "current_usage": {"input_tokens": 3}}, {"other": 1}]
    rows = audit.status_log(spark.createDataFrame([("f", i, json.dumps(x)) for i, x in enumerate(log)] + [("f", 9, "torn")], "file string, line_no long, line string")).collect()
    assert [(r.ts_ms, r.total_usd, r.input_tokens) for r in rows] == [(5, 1.5, 3)]
    said = [{"type": "system", "subtype": "away_summary", "timestamp": T0}, {"type": "user", "isCompactSummary": True, "timestamp": T0, "message": {"role": "user", "content": "s"}}, {"type": "user", "timestamp": T0, "message": {"role": "user", "content": "go"}}, {"type": "assistant", "timestamp": T0}]
    kinds = audit.markers(spark.createDataFrame([("f", i, json.dumps(x)) for i, x in enumerate(said)], "file string, line_no long, line string")).collect()
    assert len(kinds) == 3
    steps = spark.createDataFrame([(["recap"], 5), (["prompt"], 7), ([], 1)], "kinds array<string>, moved long")
    assert tuple(audit.attribution(steps, "moved", "recap").first()) == (5, 8, 1)
