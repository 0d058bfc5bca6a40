"""Queries of operators on trees, children, catalogs, reports, audits and fact logs; with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import bins, classify, names
from ..operators import audit, children, reports, trees
from ..operators import turns as ops
from ..sources import catalog, facts
from .function_queries import SHELL, pick, sql_pick, sql_text
from .queries import T, priced, query, table, turns

# A spawn ledger and its sessions from events and customers: node 0 to 96 spawn users; every third customer left no transcript, every fifth is unreadable.
DEPTH = 3
_TREE = f"""WITH RECURSIVE e AS (SELECT event_id % 97 AS parent, user_id AS child, event_id AS pos FROM events), inside AS (SELECT 1 AS root, 5 AS node UNION ALL SELECT 2, 7),
 s AS (SELECT c_custkey AS child, c_custkey % 5 <> 0 AS readable, c_custkey * 11 AS ticks, c_custkey * 1000 AS mtime_ms, (c_custkey % 4 = 0)::INT AS untagged FROM customer WHERE c_custkey % 3 <> 0),
 d(root, node, depth) AS (SELECT r, r, 1 FROM (VALUES (1), (2)) AS t(r) UNION SELECT root, node, 2 FROM inside UNION SELECT root, child, depth + 1 FROM d JOIN (SELECT DISTINCT parent, child FROM e) ON node = parent WHERE depth <= {DEPTH}),
 m AS (SELECT root, node, min(depth) AS depth FROM d GROUP BY 1, 2),
 j AS (SELECT m.root, e.parent, e.child, e.pos, m.depth, s.readable, s.ticks, s.mtime_ms, s.untagged, (e.child = m.root OR EXISTS (SELECT 1 FROM inside i WHERE i.root = m.root AND i.node = e.child)) AS own,
   row_number() OVER (PARTITION BY m.root, e.child ORDER BY m.depth > {DEPTH}, m.depth, e.pos) AS nth FROM e JOIN m ON m.node = e.parent LEFT JOIN s ON s.child = e.child),
 k AS (SELECT *, first_value(CASE WHEN own THEN 'in-self-total' WHEN depth > {DEPTH} THEN 'depth-capped' WHEN readable IS NULL THEN 'not-found' WHEN NOT readable THEN 'unreadable' ELSE 'counted' END)
   OVER (PARTITION BY root, child ORDER BY nth) AS f FROM j),
 o AS (SELECT *, CASE WHEN nth > 1 THEN CASE f WHEN 'in-self-total' THEN f WHEN 'counted' THEN 'already-counted' WHEN 'depth-capped' THEN f ELSE 'already-seen-unresolved' END WHEN f <> 'counted' THEN f END AS skip FROM k),
 folds AS (SELECT DISTINCT user_id AS holder, event_id % 1000 AS child, 3 AS ticks FROM events WHERE event_id % 50 = 7) """


def _tree(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    edges = e.select((F.col("event_id") % 97).alias("parent"), F.col("user_id").alias("child"), F.col("event_id").alias("pos"))
    roots = spark.createDataFrame([(1,), (2,)], "node long")
    inside = spark.createDataFrame([(1, 5), (2, 7)], "root long, node long")
    key = F.col("c_custkey")
    sessions = table(spark, sf_dir, "customer").where(key % 3 != 0).select(
        key.alias("session_id"), (key % 5 != 0).alias("readable"), (key * 11).alias("ticks"), (key * 1000).alias("mtime_ms"), (key % 4 == 0).cast("int").alias("untagged"), F.lit(0).alias("untagged_ticks"))
    folds = e.where("event_id % 50 = 7").select(F.col("user_id").alias("holder"), (F.col("event_id") % 1000).alias("child"), F.lit(3).alias("ticks")).distinct()
    return trees.outcomes(edges, trees.reach(edges, roots, inside, DEPTH), sessions, inside, DEPTH), folds


@query(_TREE + "SELECT root, parent, child, pos, depth, skip, CASE WHEN skip IS NULL THEN ticks END AS ticks FROM o")
def tree_outcomes(spark, sf_dir):
    return _tree(spark, sf_dir)[0].select("root", "parent", "child", "pos", "depth", "skip", "ticks")


@query(_TREE + """, g AS (SELECT root, child, skip AS reason FROM o WHERE skip IN ('not-found', 'unreadable') AND NOT EXISTS (
  SELECT 1 FROM folds JOIN o AS h ON h.child = folds.holder AND h.skip IS NULL AND h.root = o.root WHERE folds.child = o.child)),
 l AS (SELECT h.root, sum(folds.ticks) AS less FROM folds JOIN o AS h ON h.child = folds.holder AND h.skip IS NULL JOIN o AS c ON c.child = folds.child AND c.skip IS NULL AND c.root = h.root WHERE folds.holder <> folds.child GROUP BY 1)
 SELECT o.root, count(*) AS edges, count(*) FILTER (skip IS NULL) AS descendants, count(*) FILTER (skip = 'depth-capped') AS depth_capped, (sum(untagged) FILTER (skip IS NULL))::BIGINT AS untagged,
  (SELECT count(*) FROM g WHERE g.root = o.root) AS unattributed, (coalesce(sum(CASE WHEN skip IS NULL THEN ticks END), 0) - coalesce((SELECT less FROM l WHERE l.root = o.root), 0))::BIGINT AS ticks, TRUE AS is_floor
 FROM o GROUP BY 1""")
def tree_totals(spark, sf_dir):
    return trees.tree_totals(*_tree(spark, sf_dir))


@query(_TREE + """SELECT root, child, skip AS reason FROM o WHERE skip IN ('not-found', 'unreadable') AND NOT EXISTS (
  SELECT 1 FROM folds JOIN o AS h ON h.child = folds.holder AND h.skip IS NULL AND h.root = o.root WHERE folds.child = o.child)""")
def tree_gaps(spark, sf_dir):
    return trees.gaps(*_tree(spark, sf_dir))


@query(_TREE + "SELECT root, child, mtime_ms FROM o WHERE skip IS NULL AND abs(200000 - mtime_ms) < 122000")
def tree_live(spark, sf_dir):
    return trees.live(_tree(spark, sf_dir)[0], 200_000).select("root", "child", "mtime_ms")


@query("WITH x AS (SELECT c_custkey, (SELECT sum(round(o_totalprice * 100))::BIGINT FROM orders WHERE o_custkey = c_custkey) AS ticks FROM customer) SELECT *, row_number() OVER (ORDER BY ticks DESC NULLS LAST, c_custkey)::INT AS place, greatest((SELECT count(*) FROM x) - 20, 0) AS more FROM x ORDER BY ticks DESC NULLS LAST, c_custkey LIMIT 20")
def subagent_rows(spark, sf_dir):
    total = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.sum(F.round(F.col("o_totalprice") * 100)).cast("long").alias("ticks"))
    return children.child_rows(table(spark, sf_dir, "customer").select("c_custkey"), total, "c_custkey")


@query("""WITH h AS (SELECT DISTINCT event_id % 50 AS child, user_id % 40 AS holder FROM events WHERE event_id % 3 = 0)
 SELECT child, min(holder) AS holder FROM h WHERE holder < child OR NOT EXISTS (SELECT 1 FROM h AS b WHERE b.child = h.holder AND b.holder = h.child) GROUP BY 1""")
def one_holder(spark, sf_dir):
    held = table(spark, sf_dir, "events").where("event_id % 3 = 0").select((F.col("event_id") % 50).alias("child"), (F.col("user_id") % 40).alias("holder")).distinct()
    return children.one_holder(held)


@query("""WITH c AS (SELECT o_orderkey % 5000 AS session_id, '/p/' || o_orderkey AS path, o_orderkey * 37 % 1000 AS mtime_ms, CASE WHEN o_orderkey % 3 = 0 THEN 'b' ELSE 'a' END AS harness FROM orders)
 SELECT session_id, path, harness FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY harness DESC, mtime_ms DESC, path) AS n FROM c) WHERE n = 1""")
def catalog_first_harness(spark, sf_dir):
    return children.first_harness(_catalog(spark, sf_dir), {"b": 0, "a": 1}).select("session_id", "path", "harness")


def _catalog(spark, sf_dir):
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select((k % 5000).alias("session_id"), F.concat(F.lit("/p/"), k.cast("string")).alias("path"), (k * 37 % 1000).alias("mtime_ms"), F.when(k % 3 == 0, "b").otherwise("a").alias("harness"),
                                                 F.concat(F.lit("-home-u"), (k % 60).cast("string"), F.lit("-x-y")).alias("slug"), F.concat(F.lit("/home/u"), (k % 45).cast("string"), F.lit("/x.y")).alias("last_cwd"))


@query("""WITH c AS (SELECT o_orderkey % 5000 AS session_id, '/p/' || o_orderkey AS path, o_orderkey * 37 % 1000 AS mtime_ms, o_orderkey % 60 AS u, o_orderkey % 45 AS v FROM orders)
 SELECT session_id, path, mtime_ms FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY mtime_ms DESC, path) AS n FROM c WHERE mtime_ms >= 100 AND (u IN (3, 44, 59) OR v IN (3, 44, 59))) WHERE n = 1""")
def discover_scopes(spark, sf_dir):
    scope = spark.createDataFrame([("/home/u3/x.y",), ("/home/u44/x.y",), ("/home/u59/x.y",)], "cwd string")
    return children.discover(_catalog(spark, sf_dir), scope, 100, by_last_cwd=True).select("session_id", "path", "mtime_ms")


@query(r"""WITH f AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN '/r/s' || user_id || '/subagents/agent-' || event_id || '.jsonl' WHEN 1 THEN '/r/s' || user_id || '/subagents/workflows/w/agent-' || event_id || '.jsonl'
   WHEN 2 THEN '/r/s' || user_id || '/subagents/other.jsonl' ELSE '/r/s' || user_id || '.jsonl' END AS path, user_id FROM events)
 SELECT path, 's' || user_id AS parent FROM f WHERE event_id % 4 < 2""")
def children_by_path(spark, sf_dir):
    u, e = F.col("user_id").cast("string"), F.col("event_id")
    top = F.concat(F.lit("/r/s"), u)
    path = (F.when(e % 4 == 0, F.concat(top, F.lit("/subagents/agent-"), e.cast("string"), F.lit(".jsonl"))).when(e % 4 == 1, F.concat(top, F.lit("/subagents/workflows/w/agent-"), e.cast("string"), F.lit(".jsonl")))
            .when(e % 4 == 2, F.concat(top, F.lit("/subagents/other.jsonl"))).otherwise(F.concat(top, F.lit(".jsonl"))))
    return children.children_by_path(table(spark, sf_dir, "events").select(path.alias("path"))).select("path", "parent")


@query("""WITH h AS (SELECT event_id, event_id + 1 AS header_id, CASE WHEN event_id % 3 > 0 THEN event_id // 3 END AS parent_session FROM events)
 SELECT 'p' || b.event_id AS parent_path, 'p' || a.event_id AS path FROM h AS a JOIN h AS b ON a.parent_session = b.header_id WHERE a.event_id <> b.event_id""")
def children_by_header(spark, sf_dir):
    e = F.col("event_id")
    heads = table(spark, sf_dir, "events").select((e + 1).alias("header_id"), F.when(e % 3 > 0, F.floor(e / 3)).alias("parent_session"), F.concat(F.lit("p"), e.cast("string")).alias("path"))
    return children.children_by_header(heads)


_START = "(epoch_us((SELECT min(ts) FROM events)) // 1000 + o_orderkey * 7919 % 720 * 3600000)"
_CWD = "(CASE o_orderkey % 5 WHEN 0 THEN '/tmp/x' WHEN 1 THEN '/repo/w' || o_orderkey % 10 || '/sub' WHEN 2 THEN '/home/' || o_orderkey % 300 || '/a' WHEN 3 THEN '/repo/w' || o_orderkey % 10 ELSE '/srv' END)"


@query(f""", w AS (SELECT session_id AS root, min(ts_ms) AS lo, max(ts_ms) + 3600000 AS hi FROM (
   SELECT *, sum(s) OVER (PARTITION BY session_id ORDER BY ts_ms, seq ROWS UNBOUNDED PRECEDING) AS island FROM (SELECT *, CASE WHEN ts_ms <= lag(ts_ms) OVER (PARTITION BY session_id ORDER BY ts_ms, seq) + 3600000 THEN 0 ELSE 1 END AS s FROM t0 WHERE session_id < 300)) GROUP BY session_id, island),
 c0 AS (SELECT o_orderkey % 2000 AS session_id, '/p/' || lpad(o_orderkey::VARCHAR, 9, '0') AS path, {_CWD} AS cwd, {_START} AS started_ms, CASE WHEN o_orderkey % 2 = 0 THEN 'program' ELSE 'person' END AS launched_by, o_orderkey AS mtime_ms FROM orders),
 c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY mtime_ms DESC, path) AS n FROM c0) WHERE n = 1),
 j AS (SELECT w.root, c.session_id, c.path, c.started_ms, CASE WHEN contains(c.cwd || '/', '/' || w.root || '/') THEN 0 WHEN launched_by = 'program' AND started_ms BETWEEN lo AND hi AND (cwd = '/repo/w' || w.root % 10 OR starts_with(cwd, '/repo/w' || w.root % 10 || '/')) THEN 1
   WHEN launched_by = 'program' AND started_ms BETWEEN lo AND hi AND starts_with(cwd, '/tmp/') THEN 2 END AS b FROM w, c),
 l AS (SELECT root, session_id, any_value(path) AS path, any_value(started_ms) AS started_ms, min(b) AS b FROM j WHERE b IS NOT NULL AND root <> session_id AND session_id % 11 > 0 GROUP BY 1, 2),
 f AS (SELECT DISTINCT o_orderkey % 2000 AS holder, o_custkey % 2000 AS child FROM orders)
 SELECT root, session_id, path, started_ms, CASE b WHEN 0 THEN 'named' ELSE 'inferred' END AS tier, CASE b WHEN 0 THEN 'cwd-names-parent' WHEN 1 THEN 'worktree' ELSE 'tmp' END AS basis FROM l
 WHERE NOT EXISTS (SELECT 1 FROM f JOIN l AS h ON h.session_id = f.holder AND h.root = l.root WHERE f.child = l.session_id AND f.holder <> f.child
   AND (h.path < l.path OR NOT EXISTS (SELECT 1 FROM f AS g WHERE g.holder = f.child AND g.child = f.holder)))""")
def unrecorded_range_join(spark, sf_dir):
    own = turns(spark, sf_dir).where("session_id < 300")
    windows = ops.merged_windows(own, 3_600_000).select(F.col("session_id").cast("string").alias("root"), "lo", "hi")
    k = F.col("o_orderkey")
    begin = turns(spark, sf_dir).agg(F.min("ts_ms").alias("begin"))
    cwd = F.get(F.array(F.lit("/tmp/x"), F.concat(F.lit("/repo/w"), (k % 10).cast("string"), F.lit("/sub")), F.concat(F.lit("/home/"), (k % 300).cast("string"), F.lit("/a")), F.concat(F.lit("/repo/w"), (k % 10).cast("string")), F.lit("/srv")), (k % 5).cast("int"))
    found = table(spark, sf_dir, "orders").crossJoin(F.broadcast(begin)).select(  # one row: when the events begin
        (k % 2000).cast("string").alias("session_id"), F.concat(F.lit("/p/"), F.lpad(k.cast("string"), 9, "0")).alias("path"), cwd.alias("cwd"), (F.col("begin") + k * 7919 % 720 * 3_600_000).alias("started_ms"),
        F.when(k % 2 == 0, "program").otherwise("person").alias("launched_by"), k.alias("mtime_ms"))
    fan_out = own.select(F.col("session_id").cast("string").alias("root"), F.concat(F.lit("/repo/w"), (F.col("session_id") % 10).cast("string")).alias("dir")).distinct()
    gone = own.select(F.col("session_id").cast("string").alias("root")).distinct().join(found.where("cast(session_id as int) % 11 = 0").select("session_id").distinct())
    folds = table(spark, sf_dir, "orders").select((k % 2000).cast("string").alias("holder"), (F.col("o_custkey") % 2000).cast("string").alias("child"))
    rows = children.unrecorded(found, windows, fan_out, gone, folds)
    return rows.select(F.col("root").cast("long").alias("root"), F.col("session_id").cast("long").alias("session_id"), "path", "started_ms", "tier", "basis")


_GROUP = "CASE " + " ".join(f"WHEN command IN ({', '.join(map(sql_text, tools))}) THEN {sql_text(g)}" for g, tools in reports.GROUPS.items()) + " ELSE 'Unclassified' END"
_HEADS = [s[1].split("|")[0].split(" ")[0].split("\n")[0] or None for s in SHELL]


@query(f""", c AS (SELECT cost_ticks, {sql_pick(_HEADS)} AS command FROM t WHERE category = 'other'), g AS (SELECT *, {_GROUP} AS "group" FROM c WHERE command IS NOT NULL),
 r AS (SELECT "group", command, count(*) AS calls, sum(cost_ticks)::BIGINT AS cost_ticks FROM g GROUP BY GROUPING SETS (("group", command), ("group")))
 SELECT *, CASE "group" {' '.join(f'WHEN {sql_text(g)} THEN {i}' for i, g in enumerate([*reports.GROUPS, reports.PARSE_MISS]))} ELSE {len(reports.GROUPS) + 1} END AS place FROM r""")
def other_histogram(spark, sf_dir):
    return reports.other_histogram(priced(spark, sf_dir).withColumn("commands", F.array(pick([s[0] for s in SHELL], F.col("event_id")))))


@query("""SELECT session_id, sum(CASE WHEN category = 'other' THEN cost_ticks ELSE 0 END)::BIGINT AS other_ticks, sum(cost_ticks)::BIGINT AS cost_ticks FROM t GROUP BY 1
 HAVING sum(CASE WHEN category = 'other' THEN cost_ticks ELSE 0 END) > 100000000 AND sum(CASE WHEN category = 'other' THEN cost_ticks ELSE 0 END) > 0.2 * sum(cost_ticks)""")
def other_warning(spark, sf_dir):
    return reports.other_warning(priced(spark, sf_dir), least_ticks=100_000_000)


_M = "coalesce(sum({c}), 0)::BIGINT AS {c}"
_SUMS = "sum(n)::BIGINT AS turns, " + ", ".join(_M.format(c=c) for c in reports.MEASURES)
_CATS = ", ".join(f"({i}, {sql_text(c)})" for i, c in enumerate(reports.classify.CATEGORIES))


@query(f""", r AS (SELECT model, CASE WHEN category = 'plan' THEN 'unheard' ELSE category END AS category, 1 AS n, cost_ticks, in_tok, out_tok, cr_tok, cw_tok, 0 AS rs_tok FROM t
  UNION ALL SELECT model, 'web', 0, event_id % 4 * 300000000, 0, 0, 0, 0, 0 FROM t WHERE event_id % 4 > 0),
 x AS (SELECT * REPLACE (CASE WHEN category = 'unheard' THEN 'other' ELSE category END AS category), model <> '<synthetic>' AS ok FROM r), k(ord, name) AS (VALUES {_CATS}),
 bm AS (SELECT model AS name, {_SUMS} FROM x WHERE ok GROUP BY 1), bc AS (SELECT category AS name, {_SUMS} FROM x WHERE ok GROUP BY 1)
 SELECT 'total' AS level, 'total' AS name, 0 AS place, {_SUMS} FROM x WHERE ok UNION ALL SELECT 'untagged', 'untagged', 0, {_SUMS} FROM x WHERE NOT ok
 UNION ALL SELECT 'model', name, row_number() OVER (ORDER BY cost_ticks DESC, name) - 1, turns, {', '.join(reports.MEASURES)} FROM bm
 UNION ALL SELECT 'category', k.name, ord, coalesce(turns, 0), {', '.join(f'coalesce({c}, 0)' for c in reports.MEASURES)} FROM k LEFT JOIN bc USING (name)""")
def session_report(spark, sf_dir):
    rows = priced(spark, sf_dir).withColumn("server_ticks", F.col("event_id") % 4 * 300_000_000).withColumn("category", F.when(F.col("category") == "plan", "unheard").otherwise(F.col("category")))
    return reports.session_summary(rows)


@query("SELECT count(*) FILTER (event_id % 9 = 0 AND event_id > 0) AS events, (sum(event_id) FILTER (event_id % 9 = 0))::BIGINT AS tokens_freed FROM t0")
def compactions(spark, sf_dir):
    return reports.compactions(turns(spark, sf_dir).withColumn("compaction_before", F.when(F.col("event_id") % 9 == 0, F.col("event_id"))))


@query("SELECT DISTINCT CASE WHEN event_id % 2 = 0 THEN 'mystery-1' ELSE 'deepseek-r9' END AS model FROM t0")
def unpriced_models(spark, sf_dir):
    from ..functions import pricing

    rows = turns(spark, sf_dir)
    odd = pricing.price(rows.withColumn("model", F.when(F.col("event_id") % 2 == 0, "mystery-1").otherwise("deepseek-r9")))
    return reports.unpriced_models(pricing.price(rows), odd)


_ALL = "in_tok + out_tok + cr_tok + cw_tok"


@query(f"""SELECT strftime(ts, '%Y-%m-%d') AS bin, category, sum(cost_ticks)::BIGINT AS cost_ticks, sum({_ALL})::BIGINT AS tok, sum(out_tok)::BIGINT AS written_tok, bool_or(peak_priced) AS peak,
 count(*) FILTER (NOT is_sidechain AND cr_tok < 4000 AND cw_tok > 0) AS misses FROM t GROUP BY 1, 2""")
def bins_full(spark, sf_dir):
    rows = priced(spark, sf_dir)
    return reports.bin_cells(rows.withColumn("cache_miss", reports.cache_missed(F.col("is_sidechain"), F.floor(F.col("cr_tok") / 4000), F.col("cw_tok"))), bins.bin_key(F.col("ts"), "1d"))


@query(f"SELECT strftime(ts, '%Y-%m-%d') AS bin, sum(cost_ticks)::BIGINT AS cost_ticks, sum({_ALL})::BIGINT AS tok, bool_or(peak_priced) AS peak FROM t GROUP BY 1 ORDER BY bin DESC LIMIT 17")
def topk_bins(spark, sf_dir):
    rows = priced(spark, sf_dir).withColumn("cache_miss", F.lit(False))
    return reports.newest_bins(reports.bin_cells(rows, bins.bin_key(F.col("ts"), "1d")))


@query("SELECT model, sum(cost_ticks)::BIGINT AS cost_ticks, count(*) AS turns FROM t GROUP BY 1 ORDER BY cost_ticks DESC, model LIMIT 3")
def topk_models(spark, sf_dir):
    return reports.dearest_models(priced(spark, sf_dir), 3)


@query("SELECT category, sum(cost_ticks)::BIGINT AS cost_ticks, count(*) AS turns, round(100.0 * sum(cost_ticks) / (SELECT sum(cost_ticks) FROM t), 6) AS percent FROM t GROUP BY 1")
def spend_shares(spark, sf_dir):
    return reports.spend_shares(priced(spark, sf_dir), "category")


@query(", x AS (SELECT cost_ticks, unnest(list_distinct([event_id % 3, event_id % 5])) AS tool FROM t) SELECT tool, count(*) AS turns, sum(cost_ticks)::BIGINT AS cost_ticks FROM x GROUP BY 1")
def each_tool_once(spark, sf_dir):
    return reports.each_once(priced(spark, sf_dir).withColumn("tools", F.array(F.col("event_id") % 3, F.col("event_id") % 5)), "tools", "tool")


@query(""", x AS (SELECT *, row_number() OVER (PARTITION BY message_id ORDER BY session_id, seq) AS n FROM t WHERE session_id % 7 > 0)
 SELECT count(DISTINCT session_id) AS transcripts, count(*) AS turns, sum(cost_ticks)::BIGINT AS cost_ticks, sum(in_tok)::BIGINT AS in_tok, sum(out_tok)::BIGINT AS out_tok, sum(cr_tok)::BIGINT AS cr_tok, sum(cw_tok)::BIGINT AS cw_tok FROM x WHERE n = 1""")
def pr_cost_first_wins(spark, sf_dir):
    rows = priced(spark, sf_dir).withColumn("place", F.col("session_id"))
    folded = rows.where("session_id % 7 = 0").select("session_id").distinct()
    return reports.change_cost(rows, folded)


@query("SELECT strftime(ts, '%Y-%m-%d') AS bin, arg_max(category, c) AS category FROM (SELECT ts, category, c * 100 - ascii(category) % 100 AS c FROM (SELECT date_trunc('day', ts) AS ts, category, sum(cost_ticks)::HUGEINT AS c FROM t GROUP BY 1, 2)) GROUP BY 1")
def cell_owners(spark, sf_dir):
    cells = priced(spark, sf_dir).groupBy(bins.bin_key(F.col("ts"), "1d").alias("bin"), "category").agg(F.sum("cost_ticks").alias("cost_ticks"))
    return reports.cell_owner(cells, "bin")


@query("""WITH c AS (SELECT *, count(*) FILTER (role = 'assistant') OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS nth FROM conversations),
 g AS (SELECT conv_id, nth, bool_or(role = 'user' AND length(text) % 5 = 0) AS interrupted FROM c GROUP BY 1, 2) SELECT c.conv_id, c.turn, g.interrupted FROM c JOIN g USING (conv_id, nth) WHERE role = 'assistant'""")
def interrupt_backstamp(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").withColumn("is_turn", F.col("role") == "assistant").withColumn("stops", (F.col("role") == "user") & (F.char_length("text") % 5 == 0))
    return ops.stamped_back(rows, ("conv_id",), "turn", "is_turn", "stops", "interrupted").select("conv_id", "turn", "interrupted")


@query("SELECT l_orderkey, l_linenumber, l_partkey, row_number() OVER (PARTITION BY l_suppkey, l_partkey ORDER BY l_orderkey * 100000000 + l_linenumber * 10000000 + l_extendedprice) > 1 AS rerun FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice FROM lineitem)")
def reruns(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").distinct()
    order = F.col("l_orderkey") * 100_000_000 + F.col("l_linenumber") * 10_000_000 + F.col("l_extendedprice")
    return reports.reruns(rows.withColumn("o", order), "l_partkey", "o", "l_suppkey").select("l_orderkey", "l_linenumber", "l_partkey", "rerun")


_MARKS = "SELECT session_id, ts_ms + 1 AS ts_ms, category AS kind FROM t0 WHERE event_id % 4 = 1"
_RECORDS = "SELECT session_id, ts_ms, seq, cost_ticks FROM t WHERE event_id % 4 = 0"


@query(f""", m AS ({_MARKS}), r AS (SELECT *, lag(ts_ms) OVER (PARTITION BY session_id ORDER BY ts_ms, seq) AS since_ms FROM ({_RECORDS}))
 SELECT session_id, seq, since_ms, coalesce(array_to_string((SELECT list(DISTINCT kind ORDER BY kind) FROM m WHERE m.session_id = r.session_id AND m.ts_ms <= r.ts_ms AND (since_ms IS NULL OR m.ts_ms > since_ms)), ','), '') AS kinds FROM r""")
def marked_steps(spark, sf_dir):
    rows = priced(spark, sf_dir)
    marks = rows.where("event_id % 4 = 1").select("session_id", (F.col("ts_ms") + 1).alias("ts_ms"), F.col("category").alias("kind"))
    out = audit.marked_steps(rows.where("event_id % 4 = 0").select("session_id", "ts_ms", "seq", "cost_ticks"), marks)
    return out.select("session_id", "seq", "since_ms", F.array_join("kinds", ",").alias("kinds"))


@query(f""", r AS (SELECT *, lag(ts_ms) OVER (PARTITION BY session_id ORDER BY ts_ms, seq) AS since_ms FROM ({_RECORDS})), u AS (SELECT session_id, ts_ms, in_tok FROM t WHERE event_id % 4 > 1)
 SELECT r.session_id, r.seq, coalesce(sum(in_tok), 0)::BIGINT AS total FROM r LEFT JOIN u ON u.session_id = r.session_id AND u.ts_ms <= r.ts_ms AND (since_ms IS NULL OR u.ts_ms > since_ms) GROUP BY 1, 2""")
def window_sums(spark, sf_dir):
    rows = priced(spark, sf_dir)
    return audit.window_sums(rows.where("event_id % 4 = 0"), rows.where("event_id % 4 > 1"), "in_tok")


@query(""", b AS (SELECT session_id, count(*) AS old FROM t0 WHERE event_id % 3 > 0 GROUP BY 1), a AS (SELECT session_id, count(*) AS new FROM t0 WHERE event_id % 4 > 0 GROUP BY 1)
 SELECT session_id, old, new, CASE WHEN old IS NULL THEN 'added' WHEN new IS NULL THEN 'removed' WHEN old <> new THEN 'changed' ELSE 'same' END AS change FROM b FULL JOIN a USING (session_id)""")
def corpus_compare(spark, sf_dir):
    count = lambda where: turns(spark, sf_dir).where(where).groupBy("session_id").agg(F.count(F.lit(1)).alias("n"))
    return audit.compared(count("event_id % 3 > 0"), count("event_id % 4 > 0"), ["session_id"], "n")


# The fact log: a line per event, by its number a turn or a marker
_LINES = ("", '{"_gen":{"s":"k"}}', '{"_fold":{"child":"c.jsonl","s":"k"}}', '{"_meta":{"swept":5,"offset":9}}', '{"_meta":{"unswept":6}}', '{"_hb":"stop"}', '{"t":1,"c":0,"f":{}}', "torn {", '{"_meta":{"spawnPending":{"key":"z","at":1,"commands":[]}}}', '{"_hb":{"first":1}}')
_KINDS = ("turn", "generation", "fold", "swept", "unswept", "stop", "unknown", None, "spawn-pending", "heartbeat")


def _log(spark, sf_dir):
    rows = priced(spark, sf_dir).withColumns({
        "files": F.array(F.struct(F.lit("a").alias("path"), F.lit("write").alias("action"))), "commands": F.array(F.lit("ls")), "tool_cats": F.array().cast("array<string>"), "server_ticks": F.lit(0).cast("bigint"),
        "unknown_tool": F.lit(False), "cache_ttl": F.lit("5m"), "cache_miss": F.lit(False), "interrupted": F.col("is_sidechain")})
    marker = pick(_LINES, F.col("event_id"))
    return rows.select(F.col("session_id").alias("source_file"), F.col("seq").alias("pos"), "event_id", F.when(marker == "", facts.line_of(F.when(F.col("event_id") % 20 == 0, "k"))).otherwise(marker).alias("line"))


@query(f"SELECT session_id AS source_file, seq AS pos, {sql_pick(_KINDS)} AS kind FROM t0 WHERE event_id % 10 <> 7")
def fact_kinds(spark, sf_dir):
    return facts.records(_log(spark, sf_dir).drop("event_id")).select("source_file", "pos", "kind")


@query("""SELECT session_id, seq, ts_ms, message_id, model, in_tok, out_tok, cr_tok, cw_tok, (cost_ticks + 5000) // 10000 * 10000 AS cost_ticks, is_sidechain AS interrupted, peak_priced, category FROM t
 WHERE event_id % 10 = 0 AND NOT (event_id % 20 = 0 AND EXISTS (SELECT 1 FROM t0 AS g WHERE g.session_id = t.session_id AND g.event_id % 10 = 1 AND g.seq > t.seq))""")
def fact_turns(spark, sf_dir):
    found = facts.turns(facts.records(_log(spark, sf_dir).drop("event_id")))
    return found.select("session_id", "seq", "ts_ms", "message_id", "model", "in_tok", "out_tok", "cr_tok", "cw_tok", "cost_ticks", "interrupted", "peak_priced", "category")


@query(f""", k AS (SELECT session_id, seq, {sql_pick(_KINDS)} AS kind FROM t0 WHERE event_id % 10 <> 7)
 SELECT session_id AS source_file, coalesce(arg_max(kind, seq) FILTER (kind IN ('swept', 'unswept', 'turn', 'fold', 'generation', 'unknown')) = 'swept', FALSE) AS swept, (max(CASE WHEN kind = 'swept' THEN 9 END))::BIGINT AS "offset",
  count(*) FILTER (kind = 'turn') AS turns, CASE WHEN session_id % 5 = 0 THEN 'stale-version' WHEN count(*) FILTER (kind = 'turn') > 0 AND NOT coalesce(arg_max(kind, seq) FILTER (kind IN ('swept', 'unswept', 'turn', 'fold', 'generation', 'unknown')) = 'swept', FALSE) THEN 'unswept' END AS reason FROM k GROUP BY 1""")
def fact_verdicts(spark, sf_dir):
    states = facts.sweep_state(facts.records(_log(spark, sf_dir).drop("event_id")))
    return facts.verdict(states, F.when(F.col("source_file") % 5 == 0, "1.0").otherwise("2.0"), "2.0").select("source_file", "swept", "offset", "turns", "reason")


@query("""SELECT event_id AS pos, event_id % 6 = 0 AS valid FROM t0""")
def ledger_edges(spark, sf_dir):
    e = F.col("event_id")
    uuid = F.concat(F.lpad(e.cast("string"), 8, "0"), F.lit("-1234-4abc-8def-0123456789ab"))
    parent = F.when(e % 6 == 1, F.lit("plain")).otherwise(uuid)
    ts = F.when(e % 6 == 2, F.lit("yesterday")).otherwise(F.lit("2026-01-02T03:04:05Z"))
    mechanism = F.when(e % 6 == 3, F.lit("")).otherwise(F.lit("shell"))
    label = F.when(e % 6 == 4, F.concat(F.lit("a"), F.lit("\x1b"), F.lit("b"))).when(e % 6 == 5, F.repeat(F.lit("x"), 513)).otherwise(F.lit("fine"))
    line = F.to_json(F.struct(parent.alias("parent"), uuid.alias("child"), mechanism.alias("mechanism"), ts.alias("ts"), label.alias("label")))
    return catalog.edges(turns(spark, sf_dir).select(e.alias("pos"), line.alias("line"))).select("pos", "valid")


@query("""WITH p AS (SELECT page_id % 50 AS file, row_number() OVER (PARTITION BY page_id % 50 ORDER BY page_id) - 1 AS line_no, page_id FROM pages)
 SELECT file, arg_max('/d' || page_id % 13, line_no) FILTER (page_id % 3 = 0) AS last_cwd FROM p WHERE page_id % 3 = 0 GROUP BY 1""")
def last_directories(spark, sf_dir):
    return catalog.last_directory(_lines(spark, sf_dir))


def _lines(spark, sf_dir):
    from pyspark.sql import Window

    i = F.col("page_id")
    rows = table(spark, sf_dir, "pages").select("page_id", (i % 50).alias("file"), (F.row_number().over(Window.partitionBy(i % 50).orderBy("page_id")) - 1).alias("line_no"))
    cwd = F.when(i % 3 == 0, F.concat(F.lit("/d"), (i % 13).cast("string")))
    stamp = F.when(i % 2 == 0, F.lit("2026-01-02T03:04:05Z"))
    return rows.select("file", "line_no", F.to_json(F.struct(cwd.alias("cwd"), stamp.alias("timestamp"))).alias("line"))


@query("""WITH p AS (SELECT page_id % 50 AS file, row_number() OVER (PARTITION BY page_id % 50 ORDER BY page_id) - 1 AS line_no, page_id FROM pages)
 SELECT file, arg_min('/d' || page_id % 13, line_no) FILTER (page_id % 3 = 0) AS cwd, 1767323045000 AS started_ms FROM p WHERE line_no < 20 GROUP BY 1 HAVING count(*) FILTER (page_id % 3 = 0) > 0 AND count(*) FILTER (page_id % 2 = 0) > 0""")
def head_facts(spark, sf_dir):
    return catalog.heads(_lines(spark, sf_dir)).select("file", "cwd", "started_ms")


@query(f"""WITH RECURSIVE {T}, x AS (SELECT session_id, seq, event_id, (in_tok % 3) * 2 + out_tok % 2 AS key FROM t),
 l AS (SELECT session_id, seq, key, row_number() OVER (PARTITION BY session_id ORDER BY seq) AS n FROM x WHERE event_id % 3 = 0), r AS (SELECT session_id, seq, key FROM x WHERE event_id % 2 = 0),
 w(session_id, n, seq, turn_seq, last) AS (SELECT DISTINCT session_id, 0::BIGINT, 0::BIGINT, NULL::BIGINT, -1::BIGINT FROM l UNION ALL
  SELECT g.session_id, g.n, g.seq, g.hit, coalesce(g.hit, g.last) FROM (SELECT l.session_id, l.n, l.seq, w.last, min(r.seq) AS hit FROM w JOIN l ON l.session_id = w.session_id AND l.n = w.n + 1
   LEFT JOIN r ON r.session_id = l.session_id AND r.key = l.key AND r.seq > w.last GROUP BY 1, 2, 3, 4) AS g)
 SELECT session_id, seq, turn_seq FROM w WHERE n > 0""")
def usage_alignment(spark, sf_dir):
    rows = priced(spark, sf_dir).withColumns({"in_tok": F.col("in_tok") % 3, "out_tok": F.col("out_tok") % 2})
    return audit.aligned(rows.where("event_id % 3 = 0"), rows.where("event_id % 2 = 0"), ["in_tok", "out_tok"])


@query("""SELECT session_id, message_id, min(seq) AS seq, arg_max(event_id, cost_ticks * 1000000 - seq) AS event_id, bool_or(after_compaction) AS after_compaction, bool_or(peak_priced) AS peak_priced, bool_or(event_id % 7 = 0) AS interrupted,
  arg_max(event_id % 5 < 2, cost_ticks * 1000000 - seq) AND NOT (count(*) > 1 AND bool_or(is_sidechain)) AS cache_miss,
  CASE WHEN count(*) > 1 AND bool_or(event_id % 7 = 0) THEN 'interrupted' ELSE arg_max(category, cost_ticks * 1000000 - seq) END AS category FROM t GROUP BY 1, 2""")
def copies_merge_flags(spark, sf_dir):
    rows = priced(spark, sf_dir).withColumns({"interrupted": F.col("event_id") % 7 == 0, "cache_miss": F.col("event_id") % 5 < 2})
    return ops.dedup_max_cost(rows, flags=("after_compaction", "peak_priced", "interrupted")).select("session_id", "message_id", "seq", "event_id", "after_compaction", "peak_priced", "interrupted", "cache_miss", "category")


@query(""", q AS (SELECT o_orderkey AS request_id, (SELECT min(ts_ms) FROM t) + o_orderkey * 104729 % 2592000 * 1000 AS ts_ms, o_orderkey % 3 AS k FROM orders WHERE o_orderkey % 4 = 0),
 m AS (SELECT * FROM (VALUES (0, 'vendor/claude-haiku-4-5-x'), (1, 'claude-sonnet-4-6'), (2, 'deepseek-v4-pro')) AS v(k, model)),
 r AS (SELECT request_id, q.ts_ms, (coalesce((SELECT sum(in_tok + cr_tok) FROM t WHERE t.model = m.model AND t.ts_ms BETWEEN q.ts_ms - 3600000 AND q.ts_ms), 0))::BIGINT AS tpm, q.k FROM q JOIN m USING (k))
 SELECT request_id, ts_ms, tpm, tpm > 1000 AS over, ts_ms + CASE WHEN tpm > 1000 AND k <> 2 THEN 40000 ELSE 0 END AS resume_ms FROM r""")
def request_gate(spark, sf_dir):
    rows, k = turns(spark, sf_dir), F.col("o_orderkey")
    begin = rows.agg(F.min("ts_ms").alias("begin"))
    model = F.get(F.array(F.lit("vendor/claude-haiku-4-5-x"), F.lit("claude-sonnet-4-6"), F.lit("deepseek-v4-pro")), (k % 3).cast("int"))
    asked = table(spark, sf_dir, "orders").where(k % 4 == 0).crossJoin(F.broadcast(begin)).select(  # one row: when the events begin
        k.alias("request_id"), (F.col("begin") + k * 104729 % 2592000 * 1000).alias("ts_ms"), model.alias("model"))
    return ops.request_gate(asked, rows, span_ms=3_600_000, ceilings=F.lit(1000)).select("request_id", "ts_ms", "tpm", "over", "resume_ms")


@query(""", n AS (SELECT min(ts_ms) + 86400000 AS now FROM t)
 SELECT model, (sum(CASE WHEN now - ts_ms <= 21600000 THEN in_tok + cr_tok ELSE 0 END))::BIGINT AS tpm, (least(min(now - ts_ms), 43200000))::BIGINT AS last_age_ms,
  (sum(CASE WHEN now - ts_ms <= 21600000 AND session_id = 7 THEN in_tok + cr_tok ELSE 0 END))::BIGINT AS session_tpm FROM t, n WHERE now - ts_ms <= 43200000 GROUP BY 1""")
def active_rates(spark, sf_dir):
    rows = turns(spark, sf_dir)
    now = rows.agg(F.min("ts_ms")).first()[0] + 86_400_000
    names_of = rows.select("model").distinct().select("model", names.model_code(F.col("model")).alias("code"))
    return ops.active_rates(rows, now, "7", 21_600_000, 43_200_000).join(names_of, "code").select("model", "tpm", "last_age_ms", "session_tpm")


@query("""WITH s AS (SELECT c_custkey AS session_id, CASE WHEN c_custkey % 9 > 0 THEN c_custkey * 3 END AS raw_lines FROM customer),
 v AS (SELECT c_custkey AS session_id, x.version, x.place, c_custkey % 7 <> x.place AS readable FROM customer, (VALUES ('0.9.12', 0), ('0.10.1', 1), ('0.2.0', 2)) AS x(version, place) WHERE (c_custkey // (x.place + 1)) % 3 > 0),
 b AS (SELECT session_id, version FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY version = '0.2.0' DESC, place = 1 DESC, place = 0 DESC) AS n FROM v) WHERE n = 1 AND readable),
 u AS (SELECT o_custkey AS session_id, CASE o_orderkey % 3 WHEN 0 THEN '0.9.12' WHEN 1 THEN '0.10.1' ELSE '0.2.0' END AS version, o_orderkey AS cost_ticks FROM orders)
 SELECT s.session_id, count(u.cost_ticks) AS turns, (coalesce(sum(u.cost_ticks), 0))::BIGINT AS cost_ticks, b.version, CASE WHEN b.version IS NULL THEN any_value(raw_lines) END AS raw_lines
 FROM s LEFT JOIN b USING (session_id) LEFT JOIN u ON u.session_id = s.session_id AND u.version = b.version GROUP BY s.session_id, b.version""")
def session_overview(spark, sf_dir):
    c, o = F.col("c_custkey"), F.col("o_orderkey")
    people = table(spark, sf_dir, "customer")
    sessions = people.select(c.alias("session_id"), F.when(c % 9 > 0, c * 3).alias("raw_lines"))
    versions = ("0.9.12", "0.10.1", "0.2.0")
    tables = people.select("c_custkey", F.explode(F.array(*[F.struct(F.lit(v).alias("version"), F.lit(i).alias("place")) for i, v in enumerate(versions)])).alias("x"))
    tables = tables.where(F.floor(c / (F.col("x.place") + 1)) % 3 > 0).select(c.alias("session_id"), "x.version", (c % 7 != F.col("x.place")).alias("readable"))
    spent = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("session_id"), F.get(F.array(*map(F.lit, versions)), (o % 3).cast("int")).alias("version"), o.alias("cost_ticks"))
    return facts.session_overview(sessions, tables, spent, "0.2.0")


@query(None)
def cumulative_cells(spark, sf_dir):
    """Each bar's cells depend on the bar before: no SQL form; tests hold it against worked charts and the rules."""
    day = bins.bin_key(F.col("ts"), "1d").alias("bin")
    cost = priced(spark, sf_dir).groupBy((F.col("session_id") % 50).alias("chart"), day, "category").agg(F.sum("cost_ticks").alias("cost_ticks"))
    return reports.cumulative_cells(cost, "chart", list(classify.CATEGORIES), 60)
