"""Operators without SQL, or whose odd cases the tables do not hold: matching, sidecars, documents, listings, fact lines, intervals."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyloom.functions import names, pricing, shell
from tallyloom.operators import audit, children, reports, trees
from tallyloom.sources import catalog, facts


def test_alignment_is_greedy_and_forward(spark):
    r = random.Random(1)
    left = [(s, i, r.randint(0, 2), r.randint(0, 1)) for s in range(5) for i in range(30)]
    right = [(s, i, r.randint(0, 2), r.randint(0, 1)) for s in range(1, 6) for i in range(25)]
    schema = "session_id long, seq long, a long, b long"
    got = {(x[0], x[1]): x[2] for x in audit.aligned(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema), ["a", "b"]).collect()}
    want = {}
    for s in range(5):
        at = 0
        own = [x for x in right if x[0] == s]
        for _, i, a, b in (x for x in left if x[0] == s):
            hit = next((k for k in range(at, len(own)) if own[k][2:] == (a, b)), None)
            want[s, i] = None if hit is None else own[hit][1]
            at = at if hit is None else hit + 1
    assert got == want


def test_sidecars_are_whole_or_nothing(spark):
    rows = [("a", json.dumps({"agentType": "x", "spawnDepth": 1, "isFork": True})), ("b", json.dumps({"agentType": "x", "spawnDepth": "1"})), ("c", "torn {"), ("d", None), ("e", "[1]"), ("f", json.dumps({"spawnDepth": 2}))]
    got = {r["path"]: (r["status"], r["agentType"], r["spawnDepth"]) for r in catalog.sidecars(spark.createDataFrame(rows, "path string, text string")).collect()}
    assert got == {"a": ("ok", "x", 1.0), "b": ("invalid", None, None), "c": ("invalid", None, None), "d": ("unreadable", None, None), "e": ("invalid", None, None), "f": ("invalid", None, None)}


def test_document_and_manifest(spark):
    base = dict(session_id="s", message_id="m", ts_ms=1, server_ticks=0, peak_priced=False)
    turn = lambda seq, model, cat, ticks, server=0: dict(base, seq=seq, model=model, category=cat, cost_ticks=ticks, server_ticks=server, in_tok=1, out_tok=2, cr_tok=3, cw_tok=4, rs_tok=0, compaction_before=50 if seq == 2 else None)
    rows = spark.createDataFrame([turn(1, "m1", "code", 100), turn(2, "m2", "nonsense", 300, 7), turn(3, None, "git", 11)],
                                 "session_id string, seq long, message_id string, ts_ms long, model string, category string, cost_ticks long, server_ticks long, in_tok long, out_tok long, cr_tok long, cw_tok long, rs_tok long, compaction_before long, peak_priced boolean")
    doc = json.loads(reports.document("s", reports.session_summary(rows), reports.compactions(rows)).first()["document"])
    assert doc["total"]["cost_ticks"] == 407 and doc["untagged"]["cost_ticks"] == 11 and doc["compaction"] == {"events": 1, "tokens_freed": 50}
    assert [m["name"] for m in doc["models"]] == ["m2", "m1"] and len(doc["categories"]) == 14
    assert {c["name"]: c["cost_ticks"] for c in doc["categories"] if c["cost_ticks"]} == {"code": 100, "other": 300, "web": 7}
    card = json.loads(reports.rate_manifest(pricing.rate_cards(spark)).first()["manifest"])
    assert [m["model"] for m in card] == sorted(pricing.CARDS)


def test_users_cards_replace_built_in_ones(spark):
    own = spark.createDataFrame([("gpt-5.4", 1.0, 2.0, 0.5, 0.0), ("mine", 3.0, 4.0, 0.1, 0.0), ("bad", float("nan"), 1.0, 1.0, 1.0), ("worse", 1.0, -1.0, 1.0, 1.0), ("deepseek-v4-pro", 1.0, 1.0, 1.0, 1.0)], "card string, i double, o double, r double, w double")
    got = {r["card"]: r for r in pricing.cards_with(pricing.rate_cards(spark), own).collect()}
    assert got["gpt-5.4"]["base"]["i"] == pricing.ticks(1.0) and got["gpt-5.4"]["sizes"] == [] and got["mine"]["base"]["o"] == pricing.ticks(4.0)
    assert "bad" not in got and "worse" not in got and got["deepseek-v4-pro"]["peak"] and len(got) == len(pricing.CARDS) + 1


def test_listing_reads_no_contents_and_skips_derived_folders(spark, tmp_path):
    for p in ("-a-b/one.jsonl", "-a-b/one/subagents/agent-x.jsonl", "-c/two.jsonl", "-c/memory/three.jsonl", "-c/note.txt"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text("{}\n")
    got = {(r["session_id"], r["slug"]) for r in catalog.listing(spark, str(tmp_path)).collect()}
    assert got == {("one", "-a-b"), ("two", "-c")}
    every = catalog.listing(spark, str(tmp_path), skip=())
    assert [r["parent"] for r in children.children_by_path(every).collect()] == ["one"]


def test_strict_and_harness(spark):
    rows = [("a", 0, "not json"), ("a", 1, "nor this"), ("b", 0, "torn {"), ("c", 0, '{"type":"session"}'), ("c", 1, "torn"), ("d", 0, '{"type":"other"}'), ("d", 1, '{"type":"user"}')]
    lines = spark.createDataFrame(rows, "file string, line_no long, line string")
    assert {r["file"]: r["readable"] for r in catalog.strict(lines).collect()} == {"a": False, "b": True, "c": True, "d": True}
    assert {r["file"]: r["harness"] for r in catalog.harness_of(lines).collect()} == {"a": None, "b": None, "c": "b", "d": "a"}


def test_fact_log_lookups_and_folds(spark):
    lines = ['{"_meta":{"spawnPending":{"key":"k","at":1,"commands":["x"]}}}', '{"_meta":{"spawnSettled":"k","children":[]}}', '{"_meta":{"spawnPending":{"key":"l","at":1,"commands":[]}}}',
             '{"_fold":{"parent":"p","child":"c1.jsonl","s":"a"}}', '{"_gen":{"s":"a"}}', '{"_fold":{"child":"c2"}}', '{"_fold":{"child":""}}']
    found = facts.records(spark.createDataFrame([("f", i, x) for i, x in enumerate(lines)], "source_file string, pos long, line string"))
    assert [r["spawn_key"] for r in facts.pending_lookups(found).collect()] == ["l"]
    assert [r["session_id"] for r in facts.folded_ids(found).collect()] == ["c2"]
    assert json.loads(spark.range(1).select(facts.fold_line(F.lit("p"), F.lit("c"), F.lit("s"))).first()[0]) == {"_fold": {"parent": "p", "child": "c", "s": "s"}}


def test_tree_of_cycles_and_diamonds(spark):
    edges = spark.createDataFrame([("r", "a", 0), ("r", "b", 1), ("a", "c", 2), ("b", "c", 3), ("c", "a", 4), ("c", "r", 5), ("b", "gone", 6), ("gone", "d", 7)], "parent string, child string, pos long")
    roots, inside = spark.createDataFrame([("r",)], "node string"), spark.createDataFrame([], "root string, node string")
    sessions = spark.createDataFrame([(x, True, 10, 0, 0, 0) for x in "abcd"], "session_id string, readable boolean, ticks long, mtime_ms long, untagged int, untagged_ticks long")
    judged = trees.outcomes(edges, trees.reach(edges, roots, None), sessions, inside)
    got = {(r["parent"], r["child"]): (r["depth"], r["skip"]) for r in judged.collect()}
    assert got == {("r", "a"): (1, None), ("r", "b"): (1, None), ("a", "c"): (2, None), ("b", "c"): (2, "already-counted"), ("c", "a"): (3, "already-counted"), ("c", "r"): (3, "in-self-total"),
                   ("b", "gone"): (2, "not-found"), ("gone", "d"): (3, None)}
    folds = spark.createDataFrame([("a", "b", 4), ("c", "gone", 1)], "holder string, child string, ticks long")
    one = trees.tree_totals(judged, folds).first()
    assert (one["ticks"], one["descendants"], one["unattributed"], one["is_floor"]) == (36, 4, 0, False)


def test_small_expressions(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first()[0]
    assert one(reports.file_counts(F.array(*map(F.lit, ["bun.lock", "tests/a.ts", "docs/x.png", "README.md", "src/a.ts", "a/b.md"])))) == (2, 1, 2)
    nothing = F.array().cast("array<string>")
    files = lambda p: F.array(F.struct(F.lit(p).alias("path"), F.lit("read").alias("action")))
    assert one(reports.reaches(files("/w/t/a"), nothing, F.lit(None).cast("string"), "/w/t")) and not one(reports.reaches(files("/w/tt"), F.array(F.lit("ls /w/tt")), F.lit("/w"), "/w/t"))
    assert one(reports.reaches(files("x"), F.array(F.lit("cd /w/t && ls")), F.lit("/"), "/w/t"))
    assert one(reports.with_block(F.lit("a\n<b>\nold\n<e>\nz"), "<b>", "<e>", F.lit("new"))) == "a\n<b>\nnew\n<e>\nz" and one(reports.with_block(F.lit("a"), "<b>", "<e>", F.lit("new"))) == "a\n<b>\nnew\n<e>"
    assert (names.interval_ms("500ms"), names.interval_ms("2s"), names.interval_ms("3"), names.interval_ms("x")) == (500, 2000, 3000, 1000)
    assert one(names.short_model(F.lit("claude-opus-5-20260101"))) == "opus-5" and one(names.budget_share(F.lit(50), F.lit("high"), {"high": 200})) == 25.0
    assert one(shell.spawns_agent(F.lit("cat <<'E'\nclaude -p x\nE"))) is False and one(shell.spawns_agent(F.lit("timeout 5 claude -p x"))) is True
    assert one(reports.command_group(F.lit("$(x"))) == reports.PARSE_MISS and one(reports.shown_token(F.lit("x" * 60))) == "x" * 47 + "…"
    assert [r["id"] for r in reports.page_of(spark.range(30), ["id"], 29, 30).collect()] == list(range(19, 30))
    with pytest.raises(ValueError):
        reports.newest_bins(spark.range(1), 0)


def test_cells_of_running_totals():
    costs = lambda *rows: np.array(rows, dtype=object)
    # 10 cells for 100: a floor each, then what is missing to the category furthest below its share
    assert reports.stacked_cells(costs((33, 33, 34)), 100, 10).tolist() == [[3, 3, 4]]
    # a category never loses a cell to the bar before; what is too much leaves the one that grew most
    assert reports.stacked_cells(costs((10, 9, 9), (10, 9, 31), (10, 40, 50)), 100, 10).tolist() == [[1, 1, 1], [1, 1, 3], [1, 4, 5]]
    assert reports.stacked_cells(costs((0, 0), (0, 0)), 0, 10).tolist() == [[0, 0], [0, 0]]
    r = random.Random(4)
    for _ in range(200):
        steps = np.cumsum([[r.choice((0, 0, 1, 7, 300)) for _ in range(5)] for _ in range(8)], axis=0).astype(object)
        top = int(steps[-1].sum())
        cells = reports.stacked_cells(steps, top, 37)
        assert (np.diff(cells, axis=0) >= 0).all() and (cells >= 0).all()
        assert cells.sum(axis=1).tolist() == [(2 * int(s.sum()) * 37 + top) // (2 * top) if top else 0 for s in steps]


def test_cells_by_chart(spark):
    rows = spark.createDataFrame([("x", "b1", "a", 10), ("x", "b2", "c", 30), ("y", "b1", "c", 2**60), ("y", "b1", "c", 1)], "chart string, bin string, category string, cost_ticks long")
    got = {tuple(r)[:3]: (r["run_ticks"], r["cells"]) for r in reports.cumulative_cells(rows, "chart", ["a", "b", "c"], 4).collect()}
    assert got == {("x", "b1", "a"): (10, 1), ("x", "b1", "b"): (0, 0), ("x", "b1", "c"): (0, 0), ("x", "b2", "a"): (10, 1), ("x", "b2", "b"): (0, 0), ("x", "b2", "c"): (30, 3),
                   ("y", "b1", "a"): (0, 0), ("y", "b1", "b"): (0, 0), ("y", "b1", "c"): (2**60 + 1, 4)}
    assert reports.cumulative_cells(rows.where("false"), "chart", ["a"], 4).count() == 0
