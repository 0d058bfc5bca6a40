"""Queries of transcripts that are parsed, folded, walked and kept up to date; with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import names
from ..operators import audit, children, folds, scratch, trees
from ..operators import turns as ops
from ..sources import catalog, transcripts
from ..streaming import views
from .queries import priced, query, table
from .relation_queries import _tree

# Conversations as transcripts of schema a: an answer a line with its text, every fifth user's line stops the answer before it, others follow a compaction.
STOP = "[Request interrupted by user]"


def conversation_lines(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    conv, turn, text = F.col("conv_id"), F.col("turn"), F.coalesce("text", F.lit(""))
    time = F.lit("2026-09-20T10:00:00Z")
    usage = F.struct(F.char_length(text).alias("input_tokens"), turn.alias("output_tokens"), (conv * 7 % 50 * (turn % 3)).alias("cache_read_input_tokens"), (conv % 40).alias("cache_creation_input_tokens"))
    answer = F.to_json(F.struct(F.lit("assistant").alias("type"), time.alias("timestamp"), (turn % 4 == 3).alias("isSidechain"), F.struct(
        F.lit("assistant").alias("role"), F.concat(F.lit("c"), conv, F.lit("t"), turn).alias("id"), F.lit("claude-sonnet-4-6").alias("model"),
        F.array(F.struct(F.lit("text").alias("type"), text.alias("text"))).alias("content"), usage.alias("usage")).alias("message")))
    said = F.to_json(F.struct(F.lit("user").alias("type"), time.alias("timestamp"), ((conv + turn) % 7 == 0).alias("isCompactSummary"), F.when(turn % 2 == 0, F.concat(F.lit("/w/"), conv % 9, F.lit("/"), turn)).alias("cwd"), F.struct(
        F.lit("user").alias("role"), F.concat(F.when((conv + turn) % 5 == 0, STOP).otherwise(""), text).alias("content")).alias("message")))
    return c.select(conv.cast("string").alias("file"), turn.cast("long").alias("line_no"), F.when(F.col("role") == "assistant", answer).otherwise(said).alias("line"))


_PARSED = f"""WITH x AS (SELECT *, role = 'assistant' AS is_turn, (conv_id + turn) % 5 = 0 AS stop, (conv_id + turn) % 7 = 0 AS shut FROM conversations),
 n AS (SELECT *, count(*) FILTER (is_turn) OVER (PARTITION BY conv_id ORDER BY turn) AS nth FROM x),
 g AS (SELECT conv_id, nth, coalesce(bool_or(stop) FILTER (NOT is_turn), false) AS stopped, coalesce(bool_or(shut) FILTER (NOT is_turn), false) AS shut FROM n GROUP BY 1, 2),
 a AS (SELECT n.conv_id, n.turn, length(coalesce(n.text, '')) AS i, n.turn AS o, n.conv_id * 7 % 50 * (n.turn % 3) AS r, n.conv_id % 40 AS w, n.turn % 4 = 3 AS side, g.stopped, coalesce(p.shut, false) AS after_compaction
  FROM n JOIN g USING (conv_id, nth) LEFT JOIN g AS p ON p.conv_id = n.conv_id AND p.nth = n.nth - 1 WHERE n.is_turn),
 q AS (SELECT *, coalesce(last_value(CASE WHEN NOT side THEN i + r + w END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prev_ctx FROM a) """


@query(_PARSED + """SELECT conv_id::VARCHAR AS session_id, turn::BIGINT AS seq, i::BIGINT AS in_tok, (i * 30000 + o * 150000 + r * 3000 + w * 37500)::BIGINT AS cost_ticks, stopped AS interrupted, after_compaction,
 (NOT side AND r = 0 AND w > 0) AS cache_miss, CASE WHEN stopped THEN 'interrupted' ELSE 'prompt' END AS category, prev_ctx::BIGINT AS prev_ctx FROM q""")
def parsed_turns(spark, sf_dir):
    rows = ops.previous_context(transcripts.turns(conversation_lines(spark, sf_dir)))
    return rows.select("session_id", "seq", F.col("in_tok").cast("bigint").alias("in_tok"), "cost_ticks", "interrupted", "after_compaction", "cache_miss", "category", F.col("prev_ctx").cast("bigint").alias("prev_ctx"))


@query("""SELECT a.conv_id::VARCHAR AS session_id, a.turn::BIGINT AS seq, (SELECT '/w/' || (u.conv_id % 9) || '/' || max(u.turn) FROM conversations AS u WHERE u.conv_id = a.conv_id AND u.turn < a.turn AND u.turn % 2 = 0 AND u.role <> 'assistant' GROUP BY u.conv_id) AS cwd
 FROM conversations AS a WHERE a.role = 'assistant'""")
def directories_of_turns(spark, sf_dir):
    lines = conversation_lines(spark, sf_dir)
    turns = table(spark, sf_dir, "conversations").where("role = 'assistant'").select(F.col("conv_id").cast("string").alias("session_id"), F.col("turn").cast("long").alias("seq"))
    return audit.directories_of_turns(lines, turns).select("session_id", "seq", "cwd")


# Customers claim the two whose numbers are twice theirs, and every 97th the one a quarter of its own, so that ways come back.
_CLAIMS = """WITH RECURSIVE c AS (SELECT c_custkey AS parent, c_custkey % 3 AS seq, 2 * c_custkey + k AS child FROM customer, (VALUES (0), (1)) AS v(k) UNION ALL SELECT c_custkey, 5, c_custkey // 4 FROM customer WHERE c_custkey % 97 = 0),
 l AS (SELECT parent, child, min(seq) AS seq FROM c WHERE parent <> child AND child IN (SELECT c_custkey FROM customer) GROUP BY 1, 2),
 w(root, child, seq) AS (SELECT parent, child, seq FROM l UNION SELECT w.root, l.child, w.seq FROM w JOIN l ON l.parent = w.child WHERE l.child <> w.root),
 f AS (SELECT root, child, min(seq) AS seq FROM w GROUP BY 1, 2) """


def _claims(spark, sf_dir):
    key = F.col("c_custkey")
    every = table(spark, sf_dir, "customer").select(key)
    twice = every.select(key.alias("parent"), (key % 3).alias("seq"), F.explode(F.array(2 * key, 2 * key + 1)).alias("child"))
    back = every.where(key % 97 == 0).select(key.alias("parent"), F.lit(5).cast("long").alias("seq"), F.floor(key / 4).alias("child"))
    return twice.unionByName(back).join(every.withColumnRenamed("c_custkey", "child").hint("merge"), "child", "left_semi")


@query(_CLAIMS + "SELECT root, child, seq FROM f")
def fold_forest(spark, sf_dir):
    return folds.folded(_claims(spark, sf_dir)).select("root", "child", "seq")


@query(_CLAIMS + """, o AS (SELECT o_custkey AS session_id, 0 AS seq, sum(round(o_totalprice * 100))::BIGINT AS ticks, count(*) AS n FROM orders GROUP BY 1),
 s AS (SELECT f.root, f.seq, sum(o.ticks)::BIGINT AS ticks, sum(o.n)::BIGINT AS n, count(*) AS folds FROM f LEFT JOIN o ON o.session_id = f.child GROUP BY 1, 2)
 SELECT c_custkey AS session_id, k AS seq, (coalesce(CASE WHEN k = 0 THEN o.ticks END, 0) + coalesce(s.ticks, 0))::BIGINT AS cost_ticks, (coalesce(CASE WHEN k = 0 THEN o.n END, 0) + coalesce(s.n, 0))::BIGINT AS in_tok, coalesce(s.folds, 0) AS n_folds
 FROM customer CROSS JOIN (VALUES (0), (1), (2), (5)) AS v(k) LEFT JOIN o ON o.session_id = c_custkey LEFT JOIN s ON s.root = c_custkey AND s.seq = k""")
def inclusive_turns(spark, sf_dir):
    """A turn's cost with that of all sessions folded into it: customers as sessions of four turns, their orders spent in the first."""
    spent = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("session_id")).agg(F.sum(F.round(F.col("o_totalprice") * 100)).cast("long").alias("t"), F.count("*").alias("n"))
    every = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("session_id"), F.explode(F.array(*[F.lit(k).cast("long") for k in (0, 1, 2, 5)])).alias("seq"))
    mine = lambda c: F.when(F.col("seq") == 0, F.coalesce(c, F.lit(0))).otherwise(0).cast("long")
    zero = {c: F.lit(0).cast("long") for c in folds.SHARES}
    turns = every.join(spent.hint("merge"), "session_id", "left").withColumns({**zero, "cost_ticks": mine("t"), "in_tok": mine("n")}).drop("t", "n")
    out = folds.inclusive(turns, folds.folded(_claims(spark, sf_dir)), folds.own_shares(turns))
    return out.select("session_id", "seq", "cost_ticks", "in_tok", "n_folds")


@query(None)
def walked_edges(spark, sf_dir):
    """Judged from edge to edge in the order of the walk, each with the state the ones before left: tests hold it against a plain walk."""
    e = table(spark, sf_dir, "events")
    edges = e.select((F.col("event_id") % 97).cast("string").alias("parent"), F.col("user_id").cast("string").alias("child"), F.col("event_id").alias("pos"))
    key = F.col("c_custkey")
    sessions = table(spark, sf_dir, "customer").where(key % 3 != 0).select(key.cast("string").alias("session_id"), (key % 5 != 0).alias("readable"), (key * 11).alias("ticks"))
    roots, inside = spark.createDataFrame([("1",), ("2",)], "node string"), spark.createDataFrame([("1", "5"), ("2", "7")], "root string, node string")
    return trees.walk(edges, roots, sessions, inside, _tree(spark, sf_dir)[1].withColumns({"holder": F.col("holder").cast("string"), "child": F.col("child").cast("string")}), 3)[0]


@query("""WITH b AS (SELECT o_orderkey AS k, o_orderkey % 1000 AS size, o_custkey AS mtime_ms, CASE WHEN o_orderkey % 3 > 0 THEN o_orderkey END AS inode FROM orders),
 o AS (SELECT 'p/' || k AS path, size, mtime_ms, inode FROM b WHERE k % 10 < 8),
 n AS (SELECT CASE WHEN k % 10 = 2 THEN 'q/' || k ELSE 'p/' || k END AS path, CASE WHEN k % 10 = 4 THEN size + 1 ELSE size END AS size, mtime_ms, inode FROM b WHERE k % 10 > 0)
 SELECT coalesce(n.path, o.path) AS path, CASE WHEN n.path IS NULL THEN 'gone' WHEN o.path IS NOT NULL THEN 'changed' WHEN n.inode IS NOT NULL AND n.path LIKE 'q/%' THEN 'moved' ELSE 'new' END AS change,
  CASE WHEN o.path IS NULL AND n.inode IS NOT NULL AND n.path LIKE 'q/%' THEN 'p/' || n.path[3:] END AS was
 FROM n FULL JOIN o ON n.path = o.path WHERE (n.path IS NULL AND NOT (o.inode IS NOT NULL AND o.inode % 10 = 2)) OR o.path IS NULL OR n.size <> o.size""")
def changed_files(spark, sf_dir):
    k = F.col("o_orderkey")
    b = table(spark, sf_dir, "orders").select(k, (k % 1000).alias("size"), F.col("o_custkey").alias("mtime_ms"), F.when(k % 3 > 0, k).alias("inode"))
    before = b.where(k % 10 < 8).select(F.concat(F.lit("p/"), k).alias("path"), "size", "mtime_ms", "inode")
    now = b.where(k % 10 > 0).select(F.concat(F.when(k % 10 == 2, "q/").otherwise("p/"), k).alias("path"), F.when(k % 10 == 4, F.col("size") + 1).otherwise(F.col("size")).alias("size"), "mtime_ms", "inode")
    return catalog.changes(before, now)


@query("""SELECT session_id, model, category, count(*) AS turns, sum(in_tok)::BIGINT AS in_tok, sum(cost_ticks)::BIGINT AS cost_ticks FROM t WHERE session_id % 10 <> 0 OR event_id % 3 = 2 GROUP BY 1, 2, 3""")
def kept_sums(spark, sf_dir):
    """Three batches of changes to sums; the third opens a generation of every tenth session, which takes back what it had."""
    rows = priced(spark, sf_dir).withColumns({"batch": F.col("event_id") % 3, "delta": F.lit(1)})
    rows = scratch.written(rows.withColumn("generation", F.when((F.col("session_id") % 10 == 0) & (F.col("batch") == 2), 1).otherwise(0)))
    v = views.Views(spark, f"{scratch.folder(spark)}/sums-{scratch.fresh()}", sums=("in_tok", "cost_ticks"), finish=lambda df: df)
    for n in range(3):
        part = rows.where(F.col("batch") == n).drop("batch")
        # a session that is rewritten to nothing still says so
        opened = rows.where("session_id % 10 = 0").select("session_id").distinct().withColumns({"generation": F.lit(1), "delta": F.lit(0), "seq": F.lit(-1).cast("long")})
        v.put(part.unionByName(opened, allowMissingColumns=True) if n == 2 else part, n)
    return v.totals()


@query("""WITH s AS (SELECT c_nationkey, c_custkey, (SELECT sum(round(o_totalprice * 100))::BIGINT FROM orders WHERE o_custkey = c_custkey) AS ticks FROM customer)
 SELECT c_nationkey, c_custkey, ticks, (row_number() OVER w)::INT AS place, greatest(count(*) OVER (PARTITION BY c_nationkey) - 20, 0) AS more FROM s WINDOW w AS (PARTITION BY c_nationkey ORDER BY ticks DESC NULLS LAST, c_custkey) QUALIFY row_number() OVER w <= 20""")
def children_of_each_parent(spark, sf_dir):
    total = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.sum(F.round(F.col("o_totalprice") * 100)).cast("long").alias("ticks"))
    return children.child_rows(table(spark, sf_dir, "customer").select("c_nationkey", "c_custkey"), total, "c_custkey", by=("c_nationkey",)).select("c_nationkey", "c_custkey", "ticks", "place", "more")


@query(r"""SELECT page_id, regexp_replace(p, '^.*/', '') AS name, regexp_extract(regexp_replace(p, '^.*/', ''), '^.+(\.[^.]*)$', 1) AS extension, regexp_replace(p, '[^a-zA-Z0-9]', '-', 'g') AS slug,
 p = '/www' OR starts_with(p, '/www/') AS inside FROM (SELECT page_id, regexp_replace(url, '^[a-z]+:/', '') AS p FROM pages)""")
def page_paths(spark, sf_dir):
    """Path functions over the addresses of all pages."""
    p = F.regexp_replace("url", "^[a-z]+:/", "")
    rows = table(spark, sf_dir, "pages").select("page_id", p.alias("p"))
    path = F.col("p")
    return rows.select("page_id", names.file_name(path).alias("name"), names.extension(path).alias("extension"), F.element_at(names.slugs(path), 1).alias("slug"), names.inside(path, F.lit("/www")).alias("inside"))
