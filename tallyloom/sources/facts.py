"""The line-oriented fact log: turns as compact JSON lines among markers of generations, folds and completeness.

Read as Spark lines (source_file, pos, line), pos being the order in the file. The main
store of facts is Parquet; this form is exchanged with tools that read lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import names, pricing

# Keys of a turn's line.
KEYS = "t double, c double, cat string, id string, m string, in bigint, out bigint, cr bigint, cw bigint, rs bigint, sc double, tl string, cb bigint, ut int, ttl string, miss int, ir int, sp int, s string"
LINE = f"{KEYS}, f string, cmd string, tc string, _hb string, _meta string, _fold string, _gen string"
REASONS = ("stale-version", "unswept", "subagent-unreadable", "descendant-live")


def records(lines: DataFrame) -> DataFrame:
    """kind, source and the fields of every readable line; lists of the wrong shape make a line unknown.

    Kinds: turn, fold, generation, swept, unswept, offset, spawn-pending, spawn-settled, heartbeat, stop, meta-other, unknown.
    """
    e = F.from_json("line", LINE)
    rows = lines.withColumn("e", e).where(F.trim("line").startswith("{") & F.try_parse_json("line").isNotNull())
    get = lambda c, p: F.get_json_object(F.col(f"e.{c}"), p)
    number = lambda c: c.rlike(r"^-?\d")
    meta = (F.when(number(get("_meta", "$.unswept")), "unswept").when(number(get("_meta", "$.swept")), "swept").when(number(get("_meta", "$.offset")), "offset")
            .when(get("_meta", "$.spawnPending.key").isNotNull() & F.startswith(get("_meta", "$.spawnPending.commands"), F.lit("[")), "spawn-pending")
            .when(get("_meta", "$.spawnSettled").isNotNull(), "spawn-settled").otherwise("meta-other"))
    beat = F.when(F.col("e._hb") == "stop", "stop").when(F.startswith("e._hb", F.lit("{")), "heartbeat").otherwise("unknown")
    lists = F.lit(True)
    for c in ("f", "cmd", "tc"):
        lists = lists & F.coalesce(F.startswith(F.col(f"e.{c}"), F.lit("[")), F.lit(True))
    turn = F.when(F.col("e.t").isNotNull() & F.col("e.c").isNotNull() & lists, "turn").otherwise("unknown")
    kind = (F.when(F.col("e._hb").isNotNull(), beat).when(F.col("e._meta").isNotNull(), meta)
            .when(F.col("e._fold").isNotNull(), F.when(F.coalesce(get("_fold", "$.child"), F.lit("")) != "", "fold").otherwise("unknown"))
            .when(F.col("e._gen").isNotNull(), F.when(get("_gen", "$.s").isNotNull(), "generation").otherwise("unknown")).otherwise(turn))
    source = F.when(kind == "generation", get("_gen", "$.s")).when(kind == "fold", F.coalesce(get("_fold", "$.s"), F.lit(""))).when(kind == "turn", F.coalesce("e.s", F.lit("")))
    return rows.select(
        "source_file", "pos", kind.alias("kind"), source.alias("source"), "e", get("_fold", "$.parent").alias("fold_parent"), get("_fold", "$.child").alias("fold_child"),
        F.coalesce(get("_meta", "$.spawnPending.key"), get("_meta", "$.spawnSettled")).alias("spawn_key"), get("_meta", "$.offset").cast("bigint").alias("offset"))


def current(found: DataFrame) -> DataFrame:
    """Records without the turns and folds that a later generation of their source replaces."""
    last = found.where("kind = 'generation'").groupBy("source_file", "source").agg(F.max("pos").alias("last"))
    rows = found.join(last, ["source_file", "source"], "left")
    return rows.where("kind not in ('turn', 'fold') or last is null or pos > last").select(*found.columns)


def sweep_state(found: DataFrame) -> DataFrame:
    """Per file whether its last deciding record says that all was read, and the last offset."""
    decides = F.col("kind").isin("swept", "unswept", "turn", "fold", "generation", "unknown")
    has_offset = (F.col("kind").isin("offset", "swept", "unswept")) & F.col("offset").isNotNull()
    return found.groupBy("source_file").agg(
        (F.coalesce(F.max_by(F.when(decides, F.col("kind")), F.when(decides, F.col("pos"))), F.lit("unswept")) == "swept").alias("swept"),
        F.max_by(F.when(has_offset, F.col("offset")), F.when(has_offset, F.col("pos"))).alias("offset"), F.count_if(F.col("kind") == "turn").alias("turns"))


def verdict(states: DataFrame, version: Column, now_version: str) -> DataFrame:
    """``provisional`` and why: another version first, then, where there is data, an unfinished read."""
    reason = F.when(version != now_version, "stale-version").when((F.col("turns") > 0) & ~F.col("swept"), "unswept")
    return states.withColumn("reason", reason).withColumn("provisional", reason.isNotNull())


def pending_lookups(found: DataFrame) -> DataFrame:
    """Spawns whose children are still being looked for: the last record of their key says so."""
    last = found.where("kind in ('spawn-pending', 'spawn-settled')").groupBy("source_file", "spawn_key").agg(F.max_by("kind", "pos").alias("kind"))
    return last.where("kind = 'spawn-pending'").select("source_file", "spawn_key")


def folded_ids(found: DataFrame) -> DataFrame:
    return current(found).where("kind = 'fold'").select(F.regexp_replace("fold_child", r"(?i)\.jsonl$", "").alias("session_id")).distinct()


def turns(found: DataFrame) -> DataFrame:
    """The turns of the current generations as fact rows."""
    e = lambda c: F.coalesce(F.col(f"e.{c}"), F.lit(0))
    yes = lambda c: F.coalesce(F.col(f"e.{c}") != 0, F.lit(False))
    ticks = lambda c: F.round(F.coalesce(F.col(f"e.{c}"), F.lit(0.0)) * pricing.TICKS).cast("bigint")
    files = F.transform(F.from_json("e.f", "array<struct<p:string,a:string>>"), lambda f: F.struct(F.coalesce(f["p"], F.lit("")).alias("path"), F.when(f["a"] == "w", "write").otherwise("read").alias("action")))
    strings = lambda c: F.coalesce(F.from_json(F.col(f"e.{c}"), "array<string>"), F.array())
    return current(found).where("kind = 'turn'").select(
        F.col("source_file").alias("session_id"), "source", F.col("pos").alias("seq"), F.col("e.t").cast("bigint").alias("ts_ms"), F.col("e.id").alias("message_id"), F.col("e.m").alias("model"),
        *[e(k).alias(n) for k, n in (("in", "in_tok"), ("out", "out_tok"), ("cr", "cr_tok"), ("cw", "cw_tok"), ("rs", "rs_tok"))],
        ticks("c").alias("cost_ticks"), ticks("sc").alias("server_ticks"), F.coalesce(files, F.array()).alias("files"), strings("cmd").alias("commands"), strings("tc").alias("tool_cats"),
        yes("ir").alias("interrupted"), yes("ut").alias("unknown_tool"), yes("miss").alias("cache_miss"), yes("sp").alias("peak_priced"),
        F.when(F.col("e.ttl").isin("5m", "1h"), F.col("e.ttl")).alias("cache_ttl"), F.col("e.tl").alias("thinking_level"), F.col("e.cb").alias("compaction_before"), F.col("e.cat").alias("category"))


def line_of(source: Column | None = None) -> Column:
    """A fact row as a compact JSON line: six decimals of dollars, zeros and false left out."""
    usd = lambda c: F.round(F.col(c) / pricing.TICKS, 6)
    some = lambda c: F.nullif(F.col(c), F.lit(0))
    flag = lambda c: F.when(F.col(c), F.lit(1))
    files = F.transform("files", lambda f: F.struct(f["path"].alias("p"), F.when(f["action"] == "write", "w").otherwise("r").alias("a")))
    return F.to_json(F.struct(
        F.col("ts_ms").alias("t"), usd("cost_ticks").alias("c"), F.col("category").alias("cat"), files.alias("f"), F.col("commands").alias("cmd"), F.col("message_id").alias("id"), F.col("model").alias("m"),
        *[some(n).alias(k) for k, n in (("in", "in_tok"), ("out", "out_tok"), ("cr", "cr_tok"), ("cw", "cw_tok"), ("rs", "rs_tok"))],
        F.nullif(usd("server_ticks"), F.lit(0.0)).alias("sc"), F.when(F.size("tool_cats") > 0, F.col("tool_cats")).alias("tc"),
        flag("unknown_tool").alias("ut"), F.col("cache_ttl").alias("ttl"), flag("cache_miss").alias("miss"), flag("interrupted").alias("ir"), flag("peak_priced").alias("sp"),
        (F.lit(None).cast("string") if source is None else source).alias("s")))


def fold_line(parent: Column, child: Column, source: Column) -> Column:
    return F.to_json(F.struct(F.struct(parent.alias("parent"), child.alias("child"), source.alias("s")).alias("_fold")))


def generation_line(source: Column) -> Column:
    return F.to_json(F.struct(F.struct(source.alias("s")).alias("_gen")))


def latest_version(tables: DataFrame, now_version: str) -> DataFrame:
    """Which of a session's fact files to read: this version's in its own project, else in another, else the newest other version."""
    order = [F.when((F.col("version") == now_version) & F.col("own_project"), 0).when(F.col("version") == now_version, 1).otherwise(2), F.desc("mtime_ms"), "path"]
    return tables.withColumn("_n", F.row_number().over(Window.partitionBy("session_id").orderBy(*order))).where("_n = 1").drop("_n")


def session_overview(sessions: DataFrame, tables: DataFrame, turns: DataFrame, now_version: str) -> DataFrame:
    """What a list of sessions shows of each: (session_id, turns, cost_ticks, version, raw_lines).

    From its fact table of ``now_version``, else of the highest version; without one, the
    lines of the transcript, null if it could not be read. sessions: (session_id,
    raw_lines); tables: (session_id, version, readable), several a session; turns:
    collapsed (session_id, version, cost_ticks). A table that cannot be read gives lines too.
    """
    rank = F.struct((F.col("version") == now_version).alias("now"), names.version_key(F.col("version")).alias("key"))
    chosen = tables.groupBy("session_id").agg(F.max_by(F.struct("version", "readable"), rank).alias("t")).where("t.readable").select("session_id", "t.version")
    spent = chosen.join(turns, ["session_id", "version"]).groupBy("session_id").agg(F.count(F.lit(1)).alias("turns"), F.sum("cost_ticks").alias("cost_ticks"))
    rows = sessions.join(chosen, "session_id", "left").join(spent, "session_id", "left")
    return rows.select("session_id", F.coalesce("turns", F.lit(0)).cast("bigint").alias("turns"), F.coalesce("cost_ticks", F.lit(0)).cast("bigint").alias("cost_ticks"), "version",
                       F.when(F.col("version").isNull(), F.col("raw_lines")).alias("raw_lines"))
