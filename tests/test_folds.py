"""Folds of spawned sessions and the ordered walk of their tree, against a plain walk from edge to edge."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tallyloom.functions import names
from tallyloom.operators import children, folds, scratch, trees
from tallyloom.operators import turns as ops
from tallyloom.plans import growth_queries
from tallyloom.sources import catalog, transcripts

T0 = 1_789_898_400_000


def iso(ms):
    import datetime

    return datetime.datetime.fromtimestamp(ms / 1000, datetime.UTC).strftime("%Y-%m-%dT%H:%M:%S.%f")[:-3] + "Z"


def uid(n):
    return f"{n:08d}-0000-4000-8000-{n:012d}"


def said(ms, cwd):
    return {"type": "user", "timestamp": iso(ms), "cwd": cwd, "message": {"role": "user", "content": "go"}}


def turn(mid, ms, out, cr=0, cw=0, command=None, tool=None, side=False):
    blocks = [{"type": "tool_use", "name": "Bash", "input": {"command": command}}] if command else [tool] if tool else [{"type": "text", "text": mid}]
    usage = {"input_tokens": 2, "output_tokens": out, "cache_read_input_tokens": cr, "cache_creation_input_tokens": cw}
    return {"type": "assistant", "timestamp": iso(ms), **({"isSidechain": True} if side else {}), "message": {"role": "assistant", "id": mid, "model": "claude-sonnet-4-6", "content": blocks, "usage": usage}}


def put(path, lines):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("".join(json.dumps(x) + "\n" for x in lines))


def parsed(spark, root):
    lines = transcripts.read_lines(spark, str(root), skip=())
    return lines, transcripts.turns(lines).withColumn("path", F.col("session_id")).withColumn("session_id", names.session_id(F.col("session_id")))


def test_a_spawned_session_and_what_it_spawned_are_folded_once(spark, tmp_path):
    """The root starts an agent elsewhere, which starts another beside itself; the root's own turn meets both."""
    here, there = "/w/spawner-project", "/w/target-project"
    put(tmp_path / "-w-spawner-project" / f"{uid(5)}.jsonl", [said(T0, here), turn("s1", T0 + 1000, 80, 0, 5000, f"cd {there} && claude -p 'go'"), turn("s2", T0 + 60_000, 30, 5000, 100)])
    put(tmp_path / "-w-target-project" / f"{uid(6)}.jsonl", [said(T0 + 2000, there), turn("k1", T0 + 3000, 500, 0, 8000, "claude -p 'deeper'"), turn("k2", T0 + 30_000, 20, 8000, 50)])
    put(tmp_path / "-w-target-project" / f"{uid(7)}.jsonl", [said(T0 + 4000, there), turn("g1", T0 + 5000, 700, 0, 2000)])
    lines, turns = parsed(spark, tmp_path)
    heads = catalog.heads(lines).select(names.session_id(F.col("file")).alias("session_id"), names.file_name(F.regexp_replace("file", "/[^/]*$", "")).alias("slug"), F.col("started_ms").alias("first_ms"))
    last = catalog.last_directory(lines).select(names.session_id(F.col("file")).alias("session_id"), F.col("last_cwd").alias("cwd"))
    claims = folds.met(folds.spawns(turns, last), heads)
    assert {(r.parent, r.child) for r in claims.collect()} == {(uid(5), uid(6)), (uid(5), uid(7)), (uid(6), uid(7)), (uid(7), uid(6))} - {(uid(7), uid(6))}
    inside = folds.folded(claims)
    own = folds.own_shares(turns)
    whole = {r.message_id: r for r in folds.inclusive(turns, inside, own).collect()}
    usd = {k: round(r.cost_ticks / 1e10, 6) for k, r in whole.items()}
    # the golden rows: a child's turn holds its child; the root's holds both once
    assert usd["k1"] == 0.055512 and whole["k2"].cost_ticks == 28_935_000 and usd["s2"] == 0.002331
    assert (whole["k1"].in_tok, whole["k1"].out_tok, whole["k1"].cw_tok) == (4, 1200, 10_000)
    assert whole["s1"].cost_ticks + whole["s2"].cost_ticks == 806_925_000 and whole["s1"].folds == [uid(6), uid(7)] and whole["k1"].folds == [uid(7)] and not whole["s2"].folds
    shares = {(r.holder, r.child): r.ticks for r in folds.held_shares(inside, own).collect()}
    assert shares[uid(5), uid(7)] == shares[uid(6), uid(7)] == whole["g1"].cost_ticks


def test_children_in_a_session_s_own_folder_stand_beside_it(spark, tmp_path):
    task = {"type": "tool_use", "name": "Task", "input": {"description": "look"}}
    put(tmp_path / "p" / f"{uid(2)}.jsonl", [said(T0, "/w/p"), turn("r1", T0 + 60_000, 100, 0, 20_000, tool=task), turn("r2", T0 + 540_000, 60, 20_000, 300)])
    put(tmp_path / "p" / uid(2) / "subagents" / "agent-a0001.jsonl", [turn("a1", T0 + 120_000, 400, 0, 30_000, "rg TODO", side=True), turn("a2", T0 + 180_000, 150, 30_000, 200, side=True)])
    put(tmp_path / "p" / uid(2) / "subagents" / "agent-b0002.jsonl", [turn("b1", T0 + 240_000, 70, 0, 10_000, side=True)])
    lines, turns = parsed(spark, tmp_path)
    files = lines.select(F.col("file").alias("path")).distinct().withColumn("real_path", F.col("path"))
    heads = catalog.heads(lines).select(F.col("file").alias("path"), "header_id", "parent_session")
    sub = children.children_of(files, heads).select(F.col("parent").alias("root"), "path")
    together = children.with_children(turns, sub)
    rows = together.where(F.col("root") == uid(2)).orderBy("ts_ms").collect()
    assert [r.message_id for r in rows] == ["r1", "a1", "a2", "b1", "r2"]
    assert round(sum(r.cost_ticks for r in rows) / 1e10, 6) == 0.253605 and sum(r.out_tok for r in rows) == 780
    assert [r.category for r in rows] == ["agents", "grep", "prompt", "prompt", "prompt"] and [r.cache_miss for r in rows] == [True, False, False, False, False]


def reachable(claims, root):
    """Each session that ways from root lead to without passing root, with the first turn."""
    best, work = {}, [(seq, c) for p, seq, c in claims if p == root and c != root]
    while work:
        seq, x = work.pop()
        if x in best and best[x] <= seq:
            continue
        best[x] = seq
        work += [(seq, c) for p, _, c in claims if p == x and c not in (root, x)]
    return best


@pytest.mark.parametrize("seed", [1])
def test_folded_equals_brute_force(spark, seed):
    rng = random.Random(seed)
    claims = [(rng.randint(0, 14), rng.randint(0, 5), rng.randint(0, 14)) for _ in range(22)]
    got = {(r.root, r.child): r.seq for r in folds.folded(spark.createDataFrame(claims, "parent long, seq long, child long")).collect()}
    assert got == {(root, x): s for root in range(15) for x, s in reachable(claims, root).items()}


def test_folded_on_odd_claims(spark):
    schema = "parent string, seq long, child string"
    assert not folds.folded(spark.createDataFrame([], schema)).collect()
    rows = [("a", 1, "a"), (None, 1, "b"), ("a", 2, None), ("a", 3, "b"), ("a", 3, "b"), ("b", 1, "a")]
    assert {tuple(r) for r in folds.folded(spark.createDataFrame(rows, schema)).collect()} == {("a", "b", 3), ("b", "a", 1)}


def plain_walk(edges, root, in_self, sessions, shares, max_depth):
    """From edge to edge, one after the other."""
    kids = {}
    for parent, child, pos in sorted(edges, key=lambda e: e[2]):
        kids.setdefault(parent, []).append((child, pos))
    state = {root: "in-self"} | dict.fromkeys(in_self, "in-self")
    at, queue, out = {}, {}, []

    def enqueue(x, depth):
        if at.get(x, 99) > depth:
            at[x] = depth
            queue.setdefault(depth, []).append(x)

    enqueue(root, 1)
    for x in in_self:
        enqueue(x, 2)
    depth = 1
    while depth <= max(queue):
        for parent in queue.get(depth, []):
            if at[parent] != depth:
                continue
            for child, pos in kids.get(parent, []):
                prior = state.get(child)
                if prior:
                    skip = {"counted": "already-counted", "folded": "already-counted", "in-self": "in-self-total", "unresolved": "already-seen-unresolved"}[prior]
                    out.append((parent, child, pos, depth, skip, None))
                    enqueue(child, depth + 1)
                elif depth > max_depth:
                    out.append((parent, child, pos, depth, "depth-capped", None))
                elif child not in sessions or not sessions[child][0]:
                    state[child] = "unresolved"
                    out.append((parent, child, pos, depth, "unreadable" if child in sessions else "not-found", None))
                    enqueue(child, depth + 1)
                else:
                    ticks = sessions[child][1]
                    for x, share in shares.get(child, {}).items():
                        if x == child:
                            continue
                        if state.get(x) in ("in-self", "counted", "folded"):
                            ticks -= share
                        else:
                            state[x] = "folded"
                            enqueue(x, depth + 2)
                    state[child] = "counted"
                    out.append((parent, child, pos, depth, None, ticks))
                    enqueue(child, depth + 1)
        depth += 1
    return out, state


def walk_of(spark, edges, roots, inside, sessions, shares, max_depth=5):
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    return trees.walk(
        frame([(p, c, n) for p, c, n in edges], "parent string, child string, pos long"), frame([(r,) for r in roots], "node string"),
        frame([(k, r, t) for k, (r, t) in sessions.items()], "session_id string, readable boolean, ticks long"), frame(inside, "root string, node string"),
        frame([(h, c, t, n) for h, own in shares.items() for n, (c, t) in enumerate(own.items())], "holder string, child string, ticks long, pos long"), max_depth)


@pytest.mark.parametrize("seed", [3])
def test_walk_equals_a_plain_walk(spark, seed):
    rng = random.Random(seed)
    ids = [f"s{i:02d}" for i in range(16)]
    edges, pos = [], 0
    for _ in range(34):
        edges.append((rng.choice(ids), rng.choice(ids), pos))
        pos += 1
    sessions = {x: (rng.random() < 0.85, rng.randint(100, 200)) for x in ids if rng.random() < 0.85}
    shares = {h: {c: rng.randint(1, 9) for c in rng.sample(ids, 3) if c != h} for h in rng.sample(ids, 9)}
    roots = ids[:5]
    inside = [(r, rng.choice(ids[5:])) for r in roots[:3]]
    judged, outcomes = walk_of(spark, edges, roots, inside, sessions, shares, max_depth=3)
    got, states = {}, {}
    for r in judged.collect():
        got.setdefault(r.root, set()).add((r.parent, r.child, r.pos, r.depth, r.skip, r.ticks))
    for r in outcomes.collect():
        states.setdefault(r.root, {})[r.session_id] = r.outcome
    for root in roots:
        want, state = plain_walk(edges, root, [n for r, n in inside if r == root], sessions, shares, 3)
        assert got.get(root, set()) == set(want), root
        assert states[root] == state, root
    gaps = {(r.root, r.child) for r in trees.walked_gaps(judged, outcomes).collect()}
    assert gaps == {(root, x) for root in roots for x, s in states[root].items() if s == "unresolved"}


def test_a_sibling_s_fold_settles_the_edge_that_follows(spark):
    """Within one level: b is folded by a before its own edge, c is counted before d folds it, e was missing until f held it."""
    edges = [("r", x, i) for i, x in enumerate("abcdefe")]
    sessions = {x: (True, 100) for x in "abcdf"}
    judged, outcomes = walk_of(spark, edges, ["r"], [], sessions, {"a": {"b": 30}, "d": {"c": 20}, "f": {"e": 5}})
    rows = {r.pos: (r.child, r.skip, r.ticks) for r in judged.collect()}
    assert rows == {0: ("a", None, 100), 1: ("b", "already-counted", None), 2: ("c", None, 100), 3: ("d", None, 80), 4: ("e", "not-found", None), 5: ("f", None, 100), 6: ("e", "already-counted", None)}
    assert {r.session_id: r.outcome for r in outcomes.collect()} == {"r": "in-self", "a": "counted", "b": "folded", "c": "counted", "d": "counted", "e": "folded", "f": "counted"}
    assert not trees.walked_gaps(judged, outcomes).collect()


def test_cycles_diamonds_and_depth(spark):
    """Each of these trees beside the others: a loop, two that spawn each other, a diamond, a chain deeper than the walk."""
    edges = [("loop", "loop", 0), ("pair", "a", 1), ("a", "pair", 2), ("a", "b", 3), ("b", "a", 4), ("top", "l", 5), ("top", "r", 6), ("l", "foot", 7), ("r", "foot", 8), *[(f"n{i}", f"n{i + 1}", 9 + i) for i in range(8)]]
    roots = ["loop", "pair", "top", "n0", "alone"]
    sessions = {x: (True, 10) for e in edges for x in e[:2]}
    judged, outcomes = walk_of(spark, edges, roots, [], sessions, {})
    got, states = {}, {}
    for r in judged.collect():
        got.setdefault(r.root, set()).add((r.parent, r.child, r.pos, r.depth, r.skip, r.ticks))
    for r in outcomes.collect():
        states.setdefault(r.root, {})[r.session_id] = r.outcome
    for root in roots:
        want, state = plain_walk(edges, root, [], sessions, {}, 5)
        assert got.get(root, set()) == set(want) and states[root] == state
    empty, found = walk_of(spark, [], ["r"], [], sessions, {})
    assert not empty.collect() and [tuple(r) for r in found.collect()] == [("r", "r", "in-self")]


@pytest.mark.parametrize("name", ["fold_forest", "inclusive_turns"])
def test_rounds_send_no_tables_through_the_driver(spark, monkeypatch, name):
    """Nothing is broadcast, neither in a round nor in what is returned; a round writes what it found, not what was known."""
    plans, sizes = [], []

    def written(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        table = scratch.written(df)
        sizes.append(table.count())
        return table

    monkeypatch.setattr(folds, "written", written)
    out = growth_queries.__dict__[name](spark, "/root/testdata/sf0.001")
    plans.append(out._jdf.queryExecution().executedPlan().toString())
    assert len(plans) > 5 and not any("Broadcast" in p for p in plans)
    assert "collect_set" not in plans[-1] and sizes[-1] == 0 and sizes[-2] < sizes[0]


def test_many_rounds_are_read_as_one(spark, monkeypatch):
    monkeypatch.setattr(folds, "MOST_TABLES", 2)
    rng = random.Random(3)
    claims = [(rng.randint(0, 14), rng.randint(0, 5), rng.randint(0, 14)) for _ in range(22)]
    got = {(r.root, r.child): r.seq for r in folds.folded(spark.createDataFrame(claims, "parent long, seq long, child long")).collect()}
    assert got == {(root, x): s for root in range(15) for x, s in reachable(claims, root).items()}
