"""The registered queries and their SQL.

The driver's tables hold no transcripts, so ``turns`` derives turns from the events: the
user is the session, three neighbouring events are copies of one message, and models and
token counts follow from the event's type and number.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import bins, classify, pricing
from ..operators import scan
from ..operators import turns as ops

MODELS = {"click": "claude-sonnet-4-6", "purchase": "gpt-5.4", "signup": "deepseek-v4-pro", "view": "vendor/claude-haiku-4-5-x", "error": "<synthetic>"}
KINDS = {"click": "code", "purchase": "web", "signup": "plan", "view": "spec", "error": "other"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _case(mapping):
    out = F  # F.when begins a chain, Column.when continues it
    for k, v in mapping.items():
        out = out.when(F.col("event_type") == k, F.lit(v))
    return out


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    rows = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("session_id"), e.alias("event_id"), "ts",
        F.expr("timestampdiff(MILLISECOND, timestamp_ntz'1970-01-01 00:00:00', ts)").alias("ts_ms"),
        F.concat(F.lit("m"), F.floor(e / 3).cast("string")).alias("message_id"),
        _case(MODELS).alias("model"), _case(KINDS).alias("category"), (F.col("event_type") == "error").alias("is_sidechain"),
        (e % 24).alias("in_tok"), (e * 7 % 500).alias("out_tok"), (e * 13 % 9000).alias("cr_tok"),
        F.when(e % 3 == 0, e * 17 % 60000).otherwise(0).alias("cw_tok"), F.when(e % 6 == 0, e * 17 % 60000).otherwise(0).alias("cw1h_tok"),
        F.lit(0).cast("long").alias("rs_tok"), (e % 50 == 0).alias("after_compaction"), F.lit(1).alias("iterations"))
    return rows.withColumn("seq", F.row_number().over(Window.partitionBy("session_id").orderBy("ts", "event_id")).cast("long"))


def priced(spark, sf_dir):
    return pricing.price(turns(spark, sf_dir))


def _sql_case(mapping):
    return "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in mapping.items()) + " END"


def _t(x):
    return pricing.ticks(x)


_HAIKU, _SONNET, _GPT, _DEEP, _OLD = (pricing.CARDS[k] for k in ("claude-haiku-4-5", "claude-sonnet-4-6", "gpt-5.4", "deepseek-v4-pro", "deepseek-v4-pro"))
_OLD = pricing.DATE_TIERS["deepseek-v4-pro"][0][1:]
_SYN = (3, 15, 0.3, 3.75)


def _rate(i):
    return (f"CASE event_type WHEN 'click' THEN {_t(_SONNET[i])} WHEN 'view' THEN {_t(_HAIKU[i])} WHEN 'purchase' THEN {_t(_GPT[i])} "
            f"WHEN 'signup' THEN (CASE WHEN ts_ms < {pricing.RATE_CARD_FROM} THEN {_t(_OLD[i])} ELSE {_t(_DEEP[i])} END) ELSE {_t(_SYN[i])} END")


T = f"""
t0 AS (
  SELECT user_id AS session_id, event_id, ts, event_type, epoch_us(ts) // 1000 AS ts_ms, 'm' || (event_id // 3) AS message_id,
    {_sql_case(MODELS)} AS model, {_sql_case(KINDS)} AS category, event_type = 'error' AS is_sidechain,
    event_id % 24 AS in_tok, event_id * 7 % 500 AS out_tok, event_id * 13 % 9000 AS cr_tok,
    CASE WHEN event_id % 3 = 0 THEN event_id * 17 % 60000 ELSE 0 END AS cw_tok, CASE WHEN event_id % 6 = 0 THEN event_id * 17 % 60000 ELSE 0 END AS cw1h_tok,
    event_id % 50 = 0 AS after_compaction, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq
  FROM events
), t1 AS (
  SELECT *, {_rate(0)} AS ri, {_rate(1)} AS ro, {_rate(2)} AS rr, {_rate(3)} AS rw,
    CASE WHEN event_type = 'signup' AND NOT (ts_ms >= {pricing.WEEKEND_OFF_PEAK_FROM} AND isodow(ts) >= 6)
      AND ((hour(ts) * 60 + minute(ts) >= 60 AND hour(ts) * 60 + minute(ts) < 240) OR (hour(ts) * 60 + minute(ts) >= 360 AND hour(ts) * 60 + minute(ts) < 600)) THEN 2 ELSE 1 END AS factor
  FROM t0
), t AS (
  SELECT *, (cw_tok - cw1h_tok) * rw + cw1h_tok * (CASE WHEN rw = 0 THEN 0 ELSE 2 * ri END) AS write_ticks,
    (cw_tok - cw1h_tok) * rw + cw1h_tok * (CASE WHEN rw = 0 THEN 0 ELSE 2 * ri END) + factor * (in_tok * ri + out_tok * ro + cr_tok * rr) AS cost_ticks, factor > 1 AS peak_priced
  FROM t1
)"""

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str | None):
    """Registers a query with its SQL; None where SQL cannot express it."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is None:
            return f
        ORACLE_SQL[f.__name__] = sql if sql.lstrip().startswith("WITH") else f"WITH {T} {sql}"
        return f
    return add


@query("""SELECT CASE WHEN grouping(model) = 0 THEN 'model' WHEN grouping(category) = 0 THEN 'category' ELSE 'total' END AS level, model, category,
  count(*) AS turns, sum(cost_ticks)::BIGINT AS cost_ticks, sum(in_tok)::BIGINT AS in_tok, sum(out_tok)::BIGINT AS out_tok, sum(cr_tok)::BIGINT AS cr_tok, sum(cw_tok)::BIGINT AS cw_tok
  FROM t GROUP BY GROUPING SETS ((model), (category), ())""")
def summary_by_model_category(spark, sf_dir):
    return ops.summary(priced(spark, sf_dir))


@query("SELECT session_id, event_id, model, cost_ticks, write_ticks, peak_priced FROM t")
def price_turns(spark, sf_dir):
    return priced(spark, sf_dir).select("session_id", "event_id", "model", "cost_ticks", "write_ticks", "peak_priced")


@query("SELECT peak_priced, count(*) AS turns, sum(cost_ticks)::BIGINT AS cost_ticks FROM t WHERE event_type = 'signup' GROUP BY 1")
def price_peak(spark, sf_dir):
    return priced(spark, sf_dir).where("model = 'deepseek-v4-pro'").groupBy("peak_priced").agg(F.count(F.lit(1)).alias("turns"), F.sum("cost_ticks").alias("cost_ticks"))


_BIG = "(event_id * 131 % 400000)"


@query(f"SELECT event_id, CASE WHEN {_BIG} > 272000 THEN {_BIG} * {_t(5)} ELSE {_BIG} * {_t(2.5)} END AS cost_ticks FROM t WHERE event_type = 'purchase'")
def price_size_tier(spark, sf_dir):
    rows = turns(spark, sf_dir).where("model = 'gpt-5.4'").withColumns({"in_tok": F.expr(_BIG), "out_tok": F.lit(0), "cr_tok": F.lit(0), "cw_tok": F.lit(0), "cw1h_tok": F.lit(0)})
    return pricing.price(rows).select("event_id", "cost_ticks")


_NAMES = ", ".join(f"({i}, '{k}')" for i, k in enumerate(pricing.CARDS))


@query(f"""WITH c(ord, card) AS (VALUES {_NAMES}), m AS (SELECT p_partkey, p_brand || '/' || (SELECT card FROM c WHERE ord = p_partkey % {len(pricing.CARDS)}) || '-' || p_size AS model FROM part)
SELECT p_partkey, model, arg_max(card, length(card) * 1000 - ord) AS card FROM m JOIN c ON contains(lower(model), card) GROUP BY 1, 2""")
def price_longest_key(spark, sf_dir):
    names = F.array(*[F.lit(k) for k in pricing.CARDS])
    part = table(spark, sf_dir, "part").select("p_partkey", F.concat("p_brand", F.lit("/"), F.get(names, (F.col("p_partkey") % len(pricing.CARDS)).cast("int")), F.lit("-"), F.col("p_size").cast("string")).alias("model"))
    found = pricing.resolve_models(part, pricing.rate_cards(spark))
    return part.join(found.select("model", "card"), "model").select("p_partkey", "model", "card")


@query("""SELECT session_id, message_id, min(seq) AS seq, arg_max(event_id, cost_ticks * 1000000 - seq) AS event_id, max(cost_ticks) AS cost_ticks,
  array_to_string(list_distinct_ordered, ',') AS models FROM (
  SELECT *, (SELECT list(m ORDER BY s) FROM (SELECT model AS m, min(seq) AS s FROM t AS u WHERE u.session_id = t.session_id AND u.message_id = t.message_id GROUP BY model)) AS list_distinct_ordered FROM t)
  GROUP BY session_id, message_id, models""")
def dedup_max_cost(spark, sf_dir):
    rows = priced(spark, sf_dir).withColumn("models", F.array("model"))
    return ops.dedup_max_cost(rows, ("models",)).select("session_id", "message_id", "seq", "event_id", "cost_ticks", F.array_join("models", ",").alias("models"))


def _bins(name, interval, zone, key_sql):
    def run(spark, sf_dir):
        rows = priced(spark, sf_dir)
        key = bins.bin_key(F.col("ts"), interval, zone, F.col("seq"))
        return rows.groupBy(key.alias("bin"), "category").agg(F.count(F.lit(1)).alias("turns"), F.sum("cost_ticks").alias("cost_ticks"))
    run.__name__ = name
    query(f"SELECT {key_sql} AS bin, category, count(*) AS turns, sum(cost_ticks)::BIGINT AS cost_ticks FROM (SELECT *, (ts AT TIME ZONE 'UTC') AT TIME ZONE '{zone}' AS w FROM t) GROUP BY 1, 2")(run)


_bins("bins_minute", "15m", "UTC", "strftime(w, '%Y-%m-%d %H:') || lpad((minute(w) // 15 * 15)::VARCHAR, 2, '0')")
_bins("bins_hour_tz", "6h", "America/Los_Angeles", "strftime(w, '%Y-%m-%d ') || lpad((hour(w) // 6 * 6)::VARCHAR, 2, '0') || ':00'")
_bins("bins_nday", "3d", "Australia/Lord_Howe", "strftime(w, '%Y-%m-') || lpad(((day(w) - 1) // 3 * 3 + 1)::VARCHAR, 2, '0')")
_bins("bins_iso_week", "1w", "Europe/Berlin", "strftime(date_trunc('week', w), '%Y-%m-%d')")
_bins("bins_turns", "10t", "UTC", "lpad(((seq + 9) // 10 * 10)::VARCHAR, 6, '0')")

_DAY = "SELECT strftime(ts, '%Y-%m-%d') AS bin, sum(cost_ticks)::BIGINT AS cost_ticks, sum(in_tok + out_tok)::BIGINT AS tok FROM t GROUP BY 1"


@query(f"SELECT *, (sum(cost_ticks) OVER w)::BIGINT AS run_cost_ticks, (sum(tok) OVER w)::BIGINT AS run_tok FROM ({_DAY}) WINDOW w AS (ORDER BY bin ROWS UNBOUNDED PRECEDING)")
def bins_running_total(spark, sf_dir):
    day = priced(spark, sf_dir).groupBy(bins.bin_key(F.col("ts"), "1d").alias("bin")).agg(F.sum("cost_ticks").alias("cost_ticks"), F.sum(F.col("in_tok") + F.col("out_tok")).alias("tok"))
    return ops.running(day, "bin", ("cost_ticks", "tok"))


@query("""SELECT bin, category, coalesce(c, 0)::BIGINT AS cost_ticks, (sum(coalesce(c, 0)) OVER (PARTITION BY category ORDER BY bin ROWS UNBOUNDED PRECEDING))::BIGINT AS run_cost_ticks
  FROM (SELECT DISTINCT strftime(ts, '%Y-%m-%d') AS bin FROM t) CROSS JOIN (SELECT DISTINCT category FROM t)
  LEFT JOIN (SELECT strftime(ts, '%Y-%m-%d') AS bin, category, sum(cost_ticks) AS c FROM t GROUP BY 1, 2) USING (bin, category)""")
def bins_running_by_category(spark, sf_dir):
    cell = priced(spark, sf_dir).groupBy(bins.bin_key(F.col("ts"), "1d").alias("bin"), "category").agg(F.sum("cost_ticks").alias("cost_ticks"))
    # the fixed categories fill the grid: a few rows a bin
    known = F.array(*[F.lit(c) for c in sorted(set(KINDS.values()))])
    grid = cell.select("bin").distinct().select("bin", F.explode(known).alias("category"))
    return ops.running(grid.join(cell, ["bin", "category"], "left").withColumn("cost_ticks", F.coalesce("cost_ticks", F.lit(0))), "bin", ("cost_ticks",), ("category",))


@query("SELECT model, round(sum(cr_tok) / nullif(sum(cr_tok + cw_tok + in_tok), 0), 9) AS hit FROM t GROUP BY model")
def cache_metrics(spark, sf_dir):
    return turns(spark, sf_dir).groupBy("model").agg(F.round(F.sum("cr_tok") / F.nullif(F.sum(F.col("cr_tok") + F.col("cw_tok") + F.col("in_tok")), F.lit(0)), 9).alias("hit"))


@query("SELECT session_id, seq, last_value(CASE WHEN event_type = 'signup' THEN model END IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS carried FROM t")
def control_carry(spark, sf_dir):
    rows = turns(spark, sf_dir).withColumn("control", F.when(F.col("category") == "plan", F.col("model")))
    return ops.carry(rows, "control", "carried").select("session_id", "seq", "carried")


_PREV = "SELECT *, coalesce(last_value(CASE WHEN NOT is_sidechain THEN in_tok + cr_tok + cw_tok END IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prev_ctx FROM t"


@query(f"SELECT session_id, seq, prev_ctx FROM ({_PREV})")
def prev_ctx(spark, sf_dir):
    return ops.previous_context(turns(spark, sf_dir)).select("session_id", "seq", F.col("prev_ctx").cast("long").alias("prev_ctx"))


@query(f""", s AS (SELECT *, CASE WHEN write_ticks > 0 THEN CASE WHEN after_compaction THEN 'compaction'
    WHEN NOT is_sidechain AND cw_tok > 30000 AND in_tok <= 16 AND 5 * cr_tok < cr_tok + cw_tok AND prev_ctx > 0 AND 100 * abs(in_tok + cr_tok + cw_tok - prev_ctx) < 15 * prev_ctx THEN 'overhead' END END AS kind FROM ({_PREV}))
  SELECT event_id, message_id, category, cost_ticks - CASE WHEN kind IS NULL THEN 0 ELSE write_ticks END AS cost_ticks FROM s
  UNION ALL SELECT event_id, message_id || '#oh', kind, write_ticks FROM s WHERE kind IS NOT NULL""")
def overhead_split(spark, sf_dir):
    return ops.split_overhead(ops.previous_context(priced(spark, sf_dir))).select("event_id", "message_id", "category", "cost_ticks")


_GAP = 12 * 3_600_000


@query(f"""SELECT session_id, min(ts_ms) AS lo, max(ts_ms) + {_GAP} AS hi, count(*) AS turns FROM (
  SELECT *, sum(s) OVER (PARTITION BY session_id ORDER BY ts_ms, seq ROWS UNBOUNDED PRECEDING) AS island FROM (
    SELECT *, CASE WHEN ts_ms <= lag(ts_ms) OVER (PARTITION BY session_id ORDER BY ts_ms, seq) + {_GAP} THEN 0 ELSE 1 END AS s FROM t)) GROUP BY session_id, island""")
def spawn_windows(spark, sf_dir):
    return ops.merged_windows(turns(spark, sf_dir), _GAP)


@query("""SELECT session_id, seq, (sum(in_tok + cr_tok) OVER (PARTITION BY session_id, model ORDER BY ts_ms RANGE BETWEEN 3600000 PRECEDING AND CURRENT ROW))::BIGINT AS tpm FROM t""")
def tpm_rolling(spark, sf_dir):
    return ops.rolling_tokens(turns(spark, sf_dir), 3_600_000).select("session_id", "seq", "tpm")


@query("""SELECT session_id, event_id, seq FROM (SELECT *, max(CASE WHEN event_id % 40 = 0 THEN seq END) OVER (PARTITION BY session_id) AS g FROM t) WHERE event_id % 40 <> 0 AND (g IS NULL OR seq > g)""")
def generation_filter(spark, sf_dir):
    rows = turns(spark, sf_dir).withColumn("pos", F.col("seq")).withColumn("marker", F.col("event_id") % 40 == 0)
    return ops.current_generation(rows, "marker", "session_id").select("session_id", "event_id", "seq")


@query(""", k AS (SELECT event_id AS child, session_id % 10 AS slug, ts_ms + (event_id % 40000) - 20000 AS first_ms, cost_ticks AS ticks FROM t WHERE event_type = 'signup'),
  p AS (SELECT *, session_id % 10 AS slug FROM t WHERE event_type = 'click')
  SELECT child, session_id, seq, ticks FROM (SELECT k.child, p.session_id, p.seq, k.ticks, row_number() OVER (PARTITION BY child ORDER BY p.ts_ms, p.session_id, p.seq) AS n
    FROM p JOIN k ON p.slug = k.slug AND k.first_ms BETWEEN p.ts_ms - 1500000 AND p.ts_ms + 1500000) WHERE n = 1""")
def fold_interval_join(spark, sf_dir):
    rows = priced(spark, sf_dir).withColumn("slug", F.col("session_id") % 10)
    children = rows.where("category = 'plan'").select(F.col("event_id").alias("child"), "slug", (F.col("ts_ms") + F.col("event_id") % 40000 - 20000).alias("first_ms"), F.col("cost_ticks").alias("ticks"))
    return ops.claimed_children(rows.where("category = 'code'"), children, 1_500_000).select("child", "session_id", "seq", "ticks")


@query("""WITH RECURSIVE e AS (SELECT DISTINCT event_id % 97 AS parent, user_id AS child FROM events), d(root, node, depth) AS (
  SELECT s_suppkey % 97, s_suppkey % 97, 0 FROM supplier WHERE s_suppkey <= 5 UNION SELECT root, child, depth + 1 FROM d JOIN e ON node = parent WHERE depth < 3)
  SELECT root, node, min(depth) AS depth FROM d GROUP BY 1, 2""")
def tree_min_depth(spark, sf_dir):
    edges = table(spark, sf_dir, "events").select((F.col("event_id") % 97).alias("parent"), F.col("user_id").alias("child")).distinct()
    roots = table(spark, sf_dir, "supplier").where("s_suppkey <= 5").select((F.col("s_suppkey") % 97).alias("node")).distinct()
    return ops.tree_depths(edges, roots, 3)


@query("SELECT regexp_extract(lower(text), '^[a-z]+') AS head, count(*) AS n FROM documents GROUP BY 1 ORDER BY n DESC, head LIMIT 45".join(["WITH x AS (", ") SELECT * FROM x"]))
def topk_heads(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy(F.regexp_extract(F.lower("text"), "^[a-z]+", 0).alias("head")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "head").limit(45)


@query("WITH x AS (SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k FROM events) SELECT * FROM x")
def json_props_extract(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("WITH x AS (SELECT o_custkey, arg_max(o_orderkey, epoch_ms(o_orderdate) // 1000 * 1000000 + o_orderkey) AS newest FROM orders GROUP BY 1) SELECT * FROM x")
def catalog_newest_per_id(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("newest"))


@query("WITH x AS (SELECT c_custkey, sum(o_totalprice * 100)::DECIMAL(20, 0)::BIGINT AS cents FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1) SELECT * FROM x")
def children_keep_nulls(spark, sf_dir):
    total = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.round(F.sum(F.col("o_totalprice") * 100)).cast("long").alias("cents"))
    return table(spark, sf_dir, "customer").join(total, F.col("o_custkey") == F.col("c_custkey"), "left").select("c_custkey", "cents")


@query("WITH x AS (SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')) SELECT * FROM x")
def tree_anti_attributed(spark, sf_dir):
    gone = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, sf_dir, "orders").select("o_orderkey").join(gone, "o_orderkey", "left_anti")


@query("WITH x AS (SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)) SELECT * FROM x")
def semi_slug_scope(spark, sf_dir):
    scope = table(spark, sf_dir, "nation").where("n_regionkey = 1").select(F.col("n_nationkey").alias("c_nationkey"))
    return table(spark, sf_dir, "customer").join(scope, "c_nationkey", "left_semi").select("c_custkey")


@query("""SELECT session_id, count(*) FILTER (event_type = 'error') AS compaction, count(*) FILTER (event_type = 'signup') AS recap, arg_max(event_type, seq) = 'view' AS provisional FROM t GROUP BY 1""")
def uncounted_and_verdict(spark, sf_dir):
    return turns(spark, sf_dir).groupBy("session_id").agg(
        F.count_if(F.col("is_sidechain")).alias("compaction"), F.count_if(F.col("category") == "plan").alias("recap"), (F.max_by("category", "seq") == "spec").alias("provisional"))


@query("""SELECT category, cost, whole + CASE WHEN row_number() OVER (ORDER BY rest DESC, category) <= 60 - sum(whole) OVER () THEN 1 ELSE 0 END AS cells FROM (
  SELECT category, cost, floor(cost * 60 / sum(cost) OVER ())::BIGINT AS whole, cost * 60 / sum(cost) OVER () - floor(cost * 60 / sum(cost) OVER ()) AS rest FROM (
    SELECT category, sum(in_tok)::BIGINT AS cost FROM t GROUP BY 1))""")
def apportion_largest_remainder(spark, sf_dir):
    cost = turns(spark, sf_dir).groupBy("category").agg(F.sum("in_tok").alias("cost"))
    return ops.apportion(cost, "cost", 60, "category")


@query("""SELECT session_id, seq, total, total - lag(total) OVER (PARTITION BY session_id ORDER BY seq) > 100000000 AS step FROM (
  SELECT session_id, seq, (sum(write_ticks) OVER (PARTITION BY session_id ORDER BY seq ROWS UNBOUNDED PRECEDING))::BIGINT AS total FROM t)""")
def residual_staircase(spark, sf_dir):
    rows = ops.running(priced(spark, sf_dir), "seq", ("write_ticks",), ("session_id",)).withColumnRenamed("run_write_ticks", "total")
    rows = scan.scan(rows, ("session_id",), "seq", lasts={"before": F.col("total")})
    return rows.select("session_id", "seq", "total", (F.col("total") - F.col("before") > 100_000_000).alias("step"))


@query("SELECT session_id, event_id, cost_ticks FROM t UNION ALL SELECT -session_id, event_id, cost_ticks FROM t WHERE is_sidechain")
def union_self_tree(spark, sf_dir):
    rows = priced(spark, sf_dir)
    cols = ["session_id", "event_id", "cost_ticks"]
    return rows.select(cols).unionByName(rows.where("is_sidechain").withColumn("session_id", -F.col("session_id")).select(cols))


_COMMAND = "CASE event_id % 9 WHEN 0 THEN 'git status' WHEN 1 THEN 'gh issue view 3' WHEN 2 THEN 'pytest -x' WHEN 3 THEN 'rg foo' WHEN 4 THEN 'npm run build' WHEN 5 THEN 'claude -p x' WHEN 6 THEN 'gh search y' WHEN 7 THEN 'cargo test' ELSE 'ls' END"


@query(f"""SELECT event_id, CASE event_id % 9 WHEN 0 THEN 'git' WHEN 1 THEN 'spec' WHEN 2 THEN 'tests' WHEN 3 THEN 'grep' WHEN 4 THEN 'code' WHEN 5 THEN 'agents' WHEN 6 THEN 'grep' WHEN 7 THEN 'tests' END AS class FROM t""")
def command_first_match_class(spark, sf_dir):
    return turns(spark, sf_dir).select("event_id", classify.command_class(F.expr(_COMMAND)).alias("class"))
