"""Operators on turns: columns session_id, seq, ts_ms, message_id, model, token counts, cost_ticks, category."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import names
from . import scan, trees


def dedup_max_cost(turns: DataFrame, lists: tuple[str, ...] = (), flags: tuple[str, ...] = ()) -> DataFrame:
    """One row per (session, message): the copy of greatest cost, of equals the first; ``lists`` are merged over
    the copies in order of appearance; a flag is set if any copy sets it (null counts as not set).
    Rows without a message stay as they are. ``seq`` is that of the first copy.

    With several copies, a sidechain one clears ``cache_miss``, and an interrupted message is of category interrupted, where there are such columns.
    """
    named, bare = turns.where("message_id is not null"), turns.where("message_id is null")
    rest = [c for c in turns.columns if c not in ("session_id", "message_id", "seq", *lists, *flags)]
    best = F.max_by(F.struct(*rest), F.struct("cost_ticks", -F.col("seq")))
    in_order = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("seq", F.col(c).alias("v")))), lambda s: s["v"])
    merged = [F.array_distinct(F.flatten(in_order(c))).alias(c) for c in lists]
    merged += [F.coalesce(F.bool_or(c), F.lit(False)).alias(c) for c in flags]
    merged += [F.bool_or("is_sidechain").alias("_side")] if {"cache_miss", "is_sidechain"} <= set(turns.columns) else []
    one = named.groupBy("session_id", "message_id").agg(F.min("seq").alias("seq"), F.count(F.lit(1)).alias("_copies"), best.alias("b"), *merged)
    one = one.select("session_id", "message_id", "seq", "_copies", "b.*", *[c for c in one.columns if c not in ("session_id", "message_id", "seq", "_copies", "b")])
    several = F.col("_copies") > 1
    if "_side" in one.columns:
        one = one.withColumn("cache_miss", F.col("cache_miss") & ~(several & F.coalesce("_side", F.lit(False))))
    if "category" in rest and "interrupted" in flags:
        one = one.withColumn("category", F.when(several & F.col("interrupted") & F.col("category").isNotNull(), "interrupted").otherwise(F.col("category")))
    return one.select(*turns.columns).unionByName(bare)


def previous_context(turns: DataFrame) -> DataFrame:
    """prev_ctx: input and cache tokens of the last earlier turn of the main chain, 0 without one."""
    size = F.when(~F.col("is_sidechain"), F.col("in_tok") + F.col("cr_tok") + F.col("cw_tok"))
    return scan.scan(turns, ("session_id",), "seq", lasts={"prev_ctx": size}).withColumn("prev_ctx", F.coalesce("prev_ctx", F.lit(0)))


def carry(rows: DataFrame, value: str, out: str) -> DataFrame:
    """The last value set before each row of its session."""
    return scan.scan(rows, ("session_id",), "seq", lasts={out: F.col(value)})


def stamped_back(rows: DataFrame, by: tuple[str, ...], order: str, is_turn: str, signal: str, out: str) -> DataFrame:
    """Turns, marked where a signal stands between them and the next turn; signals before the first turn mark nothing."""
    numbered = scan.scan(rows, by, order, counts={"_nth": F.coalesce(F.col(is_turn), F.lit(False))})
    marks = scan.stamps(numbered, by, "_nth", {out: F.col(signal)}, {})
    return scan.null_safe(numbered.where(is_turn), marks, [*by, "_nth"]).withColumn(out, F.coalesce(out, F.lit(False))).drop("_nth")


def split_overhead(turns: DataFrame) -> DataFrame:
    """Rows that re-cache their context become two: the work, and its cache writes as compaction or overhead."""
    context = F.col("in_tok") + F.col("cr_tok") + F.col("cw_tok")
    again = (
        ~F.col("is_sidechain") & (F.col("cw_tok") > 30_000) & (F.col("in_tok") <= 16)
        & (5 * F.col("cr_tok") < F.col("cr_tok") + F.col("cw_tok")) & (F.col("prev_ctx") > 0)
        & (100 * F.abs(context - F.col("prev_ctx")) < 15 * F.col("prev_ctx")) & (F.coalesce("iterations", F.lit(0)) <= 1)
    )
    kind = F.when(F.col("write_ticks") > 0, F.when(F.col("after_compaction"), F.lit("compaction")).when(again, F.lit("overhead")))
    work = F.struct(F.col("message_id").alias("id"), F.col("category").alias("category"), (F.col("cost_ticks") - F.when(kind.isNotNull(), F.col("write_ticks")).otherwise(0)).alias("ticks"))
    extra = F.struct(F.concat("message_id", F.lit("#oh")).alias("id"), kind.alias("category"), F.col("write_ticks").alias("ticks"))
    return turns.withColumn("part", F.explode(F.when(kind.isNotNull(), F.array(work, extra)).otherwise(F.array(work)))).withColumns(
        {"message_id": F.col("part.id"), "category": F.col("part.category"), "cost_ticks": F.col("part.ticks")}).drop("part")


def summary(turns: DataFrame) -> DataFrame:
    """Totals by model, by category and over all, in one pass."""
    return turns.groupingSets([["model"], ["category"], []], "model", "category").agg(
        F.when(F.grouping("model") == 0, "model").when(F.grouping("category") == 0, "category").otherwise("total").alias("level"),
        F.count(F.lit(1)).alias("turns"), F.sum("cost_ticks").alias("cost_ticks"),
        *[F.sum(c).alias(c) for c in ("in_tok", "out_tok", "cr_tok", "cw_tok")])


def running(rows: DataFrame, key: str, values: tuple[str, ...], by: tuple[str, ...] = ()) -> DataFrame:
    """Running totals over an aggregated table, in order of ``key``."""
    w = Window.partitionBy(*by).orderBy(key).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumns({f"run_{v}": F.sum(v).over(w) for v in values})


def current_generation(rows: DataFrame, is_marker: str, source: str) -> DataFrame:
    """Rows after the last generation marker of their source. The markers are few: their last places meet the rows in a join, so that no source is gathered in one task."""
    last = rows.where(is_marker).groupBy(source).agg(F.max("pos").alias("_last"))
    kept = rows.where(~F.coalesce(F.col(is_marker), F.lit(False))).join(last.withColumnRenamed(source, "_source"), F.col(source).eqNullSafe(F.col("_source")), "left")
    return kept.where("_last is null or pos > _last").drop("_last", "_source")


def merged_windows(turns: DataFrame, gap_ms: int) -> DataFrame:
    """Windows [ts, ts + gap] of a session, merged where they touch: session_id, lo, hi, turns."""
    w = Window.partitionBy("session_id").orderBy("ts_ms", "seq")
    starts = F.coalesce((F.col("ts_ms") > F.lag("ts_ms").over(w) + gap_ms).cast("int"), F.lit(1))
    island = turns.withColumn("start", starts).withColumn("island", F.sum("start").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return island.groupBy("session_id", "island").agg(F.min("ts_ms").alias("lo"), (F.max("ts_ms") + gap_ms).alias("hi"), F.count(F.lit(1)).alias("turns")).drop("island")


def rolling_tokens(turns: DataFrame, span_ms: int = 60_000) -> DataFrame:
    """Tokens read per model and session in the ``span_ms`` up to each turn."""
    return rolling_sum(turns, ("session_id", "model"), F.col("in_tok") + F.col("cr_tok"), "tpm", span_ms)


def rolling_sum(rows: DataFrame, by: tuple[str, ...], value: Column, out: str, span_ms: int) -> DataFrame:
    """``out``: the sum of ``value`` over the rows of the same ``by`` in the ``span_ms`` up to each row (both ends count).

    Time is cut into buckets as wide as the span; a row stands in its own bucket, where it
    is added at its time, and in the next, where it counts from the start and is taken off
    once the span behind it ends. So a key with a third of all rows is spread over its
    buckets, and a running total serves for each: a frame that slides would be summed anew
    for every row. A row without a time sums over nothing.
    """
    own = F.floor(F.col("ts_ms") / span_ms)
    both = rows.withColumn("_value", value).withColumn("_ahead", F.explode(F.array(F.lit(0), F.lit(1)))).withColumns({"_bucket": own + F.col("_ahead"), "_at": F.col("ts_ms") + F.col("_ahead") * span_ms})
    whole = Window.partitionBy(*by, "_bucket")
    until = whole.orderBy("_at", "_ahead").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    before = F.coalesce(F.sum(F.when(F.col("_ahead") == 1, F.col("_value"))).over(whole), F.lit(0))
    since = F.coalesce(F.sum(F.when(F.col("_ahead") == 1, -F.col("_value")).otherwise(F.col("_value"))).over(until), F.lit(0))
    return both.withColumn(out, F.when(F.col("ts_ms").isNotNull(), before + since).otherwise(0)).where("_ahead = 0").drop("_value", "_ahead", "_bucket", "_at")


def request_gate(requests: DataFrame, turns: DataFrame, span_ms: int = 60_000, pause_ms: int = 40_000, ceilings: Column | None = None) -> DataFrame:
    """Requests (request_id, ts_ms, model) with code, tpm, ceiling, over and resume_ms.

    tpm: what the code's collapsed turns of all sessions read in the ``span_ms`` up to the
    request. A request over its code's ceiling waits ``pause_ms``; codes that begin with d
    are shown as over but never wait. ``ceilings`` (of ``code``) replaces the built-in ones. Turns without a model count for nobody.
    """
    code = names.model_code(F.col("model")).alias("code")
    asked = requests.select("request_id", "ts_ms", code, F.lit(0).cast("bigint").alias("tokens"))
    spent = turns.where("model is not null and model <> ''").select(F.lit(None).cast(requests.schema["request_id"].dataType).alias("request_id"), F.lit(False).alias("asks"), "ts_ms", code, (F.col("in_tok") + F.col("cr_tok")).alias("tokens"))
    seen = rolling_sum(asked.withColumn("asks", F.lit(True)).unionByName(spent), ("code",), F.col("tokens"), "tpm", span_ms).where("asks").drop("asks", "tokens")
    seen = seen.withColumn("ceiling", (names.ceiling(F.col("code")) if ceilings is None else ceilings).cast("bigint")).withColumn("over", F.col("tpm") > F.col("ceiling"))
    return seen.withColumn("resume_ms", F.col("ts_ms") + F.when(F.col("over") & ~F.startswith("code", F.lit("d")), F.lit(pause_ms)).otherwise(0))


def active_rates(turns: DataFrame, now_ms: int, session: str | None = None, span_ms: int = 60_000, active_ms: int = 120_000) -> DataFrame:
    """At ``now_ms`` by code: tpm, what its turns of the last ``span_ms`` read; last_age_ms, the age of the newest of the last ``active_ms``; session_tpm, the part of one session.

    Turns from the future count, with a negative age; those without a model or a time do not.
    """
    age = F.lit(now_ms) - F.col("ts_ms")
    read = F.when(age <= span_ms, F.col("in_tok") + F.col("cr_tok")).otherwise(0)
    own = F.when(F.col("session_id").cast("string") == F.lit(session), read).otherwise(0)
    live = turns.where((age <= active_ms) & (F.coalesce("model", F.lit("")) != ""))
    return live.groupBy(names.model_code(F.col("model")).alias("code")).agg(
        F.sum(read).cast("bigint").alias("tpm"), F.least(F.min(age), F.lit(active_ms)).cast("bigint").alias("last_age_ms"), F.sum(own).cast("bigint").alias("session_tpm"))


def claimed_children(turns: DataFrame, children: DataFrame, reach_ms: int = 15_000) -> DataFrame:
    """Each child (child, slug, first_ms, ticks) goes to the first turn of its slug that began within ``reach_ms`` of it.

    The interval becomes equality on buckets as wide as the reach: a child meets its own and the two next to it."""
    near = children.withColumn("bucket", F.explode(F.array(*[F.floor(F.col("first_ms") / reach_ms) + d for d in (-1, 0, 1)])))
    met = turns.withColumn("bucket", F.floor(F.col("ts_ms") / reach_ms)).join(near, ["slug", "bucket"]).where(F.abs(F.col("first_ms") - F.col("ts_ms")) <= reach_ms)
    return met.groupBy("child").agg(F.min_by(F.struct("session_id", "seq", F.col("ticks").alias("ticks")), F.struct("ts_ms", "session_id", "seq")).alias("b")).select("child", "b.*")


def tree_depths(edges: DataFrame, roots: DataFrame, max_depth: int = 5) -> DataFrame:
    """Smallest depth of every node reachable from each root (root, node, depth), cycles and all, to ``max_depth``."""
    return trees.reach(edges, roots, None, max_depth).withColumn("depth", F.col("depth") - 1)


def apportion(rows: DataFrame, value: str, cells: int, order: str) -> DataFrame:
    """Whole cells by largest remainder; ties go to the lower ``order``."""
    every = Window.partitionBy()
    exact = F.col(value) * cells / F.sum(value).over(every)
    part = rows.withColumn("whole", F.floor(exact)).withColumn("rest", exact - F.floor(exact))
    place = F.row_number().over(Window.orderBy(F.desc("rest"), order))
    return part.withColumn("cells", F.col("whole") + F.when(place <= cells - F.sum("whole").over(every), 1).otherwise(0)).drop("whole", "rest")
