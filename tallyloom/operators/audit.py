"""Comparing a counter's log with turns: markers, steps, windows and greedy matching."""

from __future__ import annotations

from bisect import bisect_left

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import names
from . import scan

LINE = "type string, subtype string, isCompactSummary boolean, timestamp string, message struct<role:string,content:string>"


def status_log(lines: DataFrame) -> DataFrame:
    """Readable lines of a counter's log, with their time and running cost; torn lines go."""
    parsed = lines.select("file", "line_no", F.from_json("line", "_epoch_ms bigint, cost struct<total_cost_usd:double>, current_usage struct<input_tokens:bigint,output_tokens:bigint,cache_read_input_tokens:bigint,cache_creation_input_tokens:bigint>").alias("e"))
    return parsed.where("e._epoch_ms is not null").select("file", "line_no", F.col("e._epoch_ms").alias("ts_ms"), F.col("e.cost.total_cost_usd").alias("total_usd"), "e.current_usage.*")


def markers(lines: DataFrame) -> DataFrame:
    """Lines of a transcript that are no answers but say something: system subtypes, compact summaries, people's prompts."""
    e = F.from_json("line", LINE)
    blocks = F.from_json(F.col("e.message.content"), "array<struct<type:string>>")
    prompt = (F.col("e.type") == "user") & ~F.exists(F.coalesce(blocks, F.array()), lambda b: b["type"] == "tool_result")
    kind = (F.when(F.col("e.type") == "system", F.concat(F.lit("system:"), F.coalesce("e.subtype", F.lit(""))))
            .when(F.col("e.isCompactSummary"), "compact-summary").when(prompt, "prompt"))
    return lines.withColumn("e", e).select("file", "line_no", F.unix_millis(F.try_to_timestamp("e.timestamp")).alias("ts_ms"), kind.alias("kind")).where("kind is not null")


def steps(records: DataFrame, value: str, least) -> DataFrame:
    """Running totals with the change to the one before and whether it is a step (``least`` or more) or a dip."""
    change = F.col(value) - F.lag(value).over(Window.partitionBy("session_id").orderBy("seq"))
    return records.withColumn("change", change).withColumn("kind", F.when(change >= least, "step").when(change < 0, "dip").otherwise("flat"))


def marked_steps(records: DataFrame, found: DataFrame) -> DataFrame:
    """The markers (session_id, ts_ms, kind) in each record's window, after the record before it and up to it."""
    w = Window.partitionBy("session_id").orderBy("ts_ms", "seq")
    # markers and records in one order: a marker belongs to the next record at or after it
    rows = records.select("session_id", "ts_ms", F.lit(1).alias("is_record"), "seq", F.lit(None).cast("string").alias("kind"))
    rows = rows.unionByName(found.select("session_id", "ts_ms", F.lit(0).alias("is_record"), F.lit(None).cast("bigint").alias("seq"), "kind"))
    ahead = F.first(F.when(F.col("is_record") == 1, F.col("seq")), ignorenulls=True).over(Window.partitionBy("session_id").orderBy("ts_ms", "is_record", "seq").rowsBetween(Window.currentRow, Window.unboundedFollowing))
    kinds = rows.withColumn("to", ahead).where("is_record = 0 and to is not null").groupBy("session_id", F.col("to").alias("seq")).agg(F.array_sort(F.collect_set("kind")).alias("kinds"))
    return records.join(kinds, ["session_id", "seq"], "left").withColumn("kinds", F.coalesce("kinds", F.array())).withColumn("since_ms", F.lag("ts_ms").over(w))


def window_sums(records: DataFrame, turns: DataFrame, value: str) -> DataFrame:
    """What the turns between two records sum to: each turn belongs to the next record of its session."""
    rows = records.select("session_id", "ts_ms", F.lit(1).alias("is_record"), "seq", F.lit(0).cast("bigint").alias("v"))
    rows = rows.unionByName(turns.select("session_id", "ts_ms", F.lit(0).alias("is_record"), F.lit(None).cast("bigint").alias("seq"), F.col(value).cast("bigint").alias("v")))
    ahead = F.first(F.when(F.col("is_record") == 1, F.col("seq")), ignorenulls=True).over(Window.partitionBy("session_id").orderBy("ts_ms", "is_record", "seq").rowsBetween(Window.currentRow, Window.unboundedFollowing))
    return rows.withColumn("to", ahead).where("to is not null").groupBy("session_id", F.col("to").alias("seq")).agg(F.sum("v").alias("total"))


def attribution(marked: DataFrame, change: str, kind: str) -> DataFrame:
    """How much of all change falls in windows with a marker of ``kind``."""
    inside = F.array_contains("kinds", kind)
    return marked.agg(F.sum(F.when(inside, F.col(change)).otherwise(0)).alias("inside"), F.sum(F.when(~inside, F.col(change)).otherwise(0)).alias("outside"), F.count_if(inside).alias("windows"))


def next_free(records: list, turns: list) -> list[int | None]:
    """For each record, in order, the place of the next turn equal to it behind the last one taken; None where there is none.

    The places of equal turns are one ascending list, in which the next is found by bisection: n log n, matched or not.
    """
    places: dict = {}
    for i, key in enumerate(turns):
        places.setdefault(key, []).append(i)
    at, out = 0, []
    for key in records:
        own = places.get(key, ())
        k = bisect_left(own, at)
        out.append(own[k] if k < len(own) else None)
        at = own[k] + 1 if k < len(own) else at
    return out


def aligned(records: DataFrame, turns: DataFrame, usage: list[str]) -> DataFrame:
    """Each record (session_id, seq, usage) with the next unused turn of equal usage, looking forward only: session_id, seq, turn_seq.

    The pointer of one record depends on all before it, so a session is one group; its
    rows are a few numbers each, and the work for a million of them takes seconds.
    """

    def match(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        left, right = left.sort_values("seq"), right.sort_values("seq")
        rows = lambda x: list(x[usage].itertuples(index=False, name=None))
        found = next_free(rows(left), rows(right))
        own = right["seq"].tolist()
        return pd.DataFrame({"session_id": left["session_id"], "seq": left["seq"], "turn_seq": pd.array([None if i is None else own[i] for i in found], dtype="Int64")})

    kind = records.schema["session_id"].dataType.simpleString()
    cols = ["session_id", "seq", *usage]
    other = turns.select(*[F.col(c).alias(c) for c in cols])  # columns of its own, should both come from one table
    return records.select(*cols).groupBy("session_id").cogroup(other.groupBy("session_id")).applyInPandas(match, f"session_id {kind}, seq long, turn_seq long")


def directories_of_turns(lines: DataFrame, turns: DataFrame) -> DataFrame:
    """``turns`` (session_id, seq) with ``cwd``: the directory that the turn's line names, else the last one named before it in its file.

    Lines and turns are one table in the order of the file; the last directory set is
    carried over it in segments, so a long session is spread over tasks.
    """
    named = lines.where(F.contains("line", F.lit('"cwd"'))).select(F.col("file").alias("session_id"), F.col("line_no").cast("long").alias("seq"), F.nullif(F.get_json_object("line", "$.cwd"), F.lit("")).alias("_named"))
    # a turn asks just behind its own line
    both = named.where("_named is not null").select("session_id", (2 * F.col("seq")).alias("_at"), "_named").unionByName(
        turns.select("session_id", (2 * F.col("seq") + 1).alias("_at")), allowMissingColumns=True)
    told = scan.scan(both, ("session_id",), "_at", lasts={"cwd": F.col("_named")}).where(F.col("_at") % 2 == 1)
    return turns.join(told.select("session_id", F.expr("(_at - 1) div 2").alias("seq"), "cwd"), ["session_id", "seq"], "left")


def reviews(logs: DataFrame, branch: str) -> DataFrame:
    """One row: rounds, findings (per round, by time) and unreadable of a branch's review logs (path, text).

    A log's file name is the branch, a time and a number. A log that does not parse, or
    that was reviewed but lacks findings or a time, is unreadable; one of another branch
    or another status does not count.
    """
    name = names.file_name(F.col("path"))
    ours = logs.where(F.startswith(name, F.lit(f"{branch}-")) & F.substr(name, F.lit(len(branch) + 2)).rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}-\d{2}-\d{2}Z-\d+\.json$"))
    v = F.try_parse_json("text")
    read = ours.select(v.isNull().alias("broken"), F.try_variant_get(v, "$.branch", "string").alias("branch"), F.try_variant_get(v, "$.status", "string").alias("status"),
                       F.try_variant_get(v, "$.utc", "string").alias("utc"), F.size(F.try_variant_get(v, "$.findings", "array<variant>")).alias("n"),
                       F.startswith(F.schema_of_variant(F.try_variant_get(v, "$.utc", "variant")), F.lit("STRING")).alias("timed"))
    judged = (F.col("branch") == branch) & (F.col("status") == "reviewed")
    whole = judged & F.coalesce("timed", F.lit(False)) & F.col("n").isNotNull() & (F.col("n") >= 0)
    rounds = F.array_sort(F.collect_list(F.when(whole, F.struct("utc", "n"))))
    return read.agg(F.count_if(whole).alias("rounds"), F.transform(rounds, lambda r: r["n"]).alias("findings"), F.count_if(F.col("broken") | (F.coalesce(judged, F.lit(False)) & ~F.coalesce(whole, F.lit(False)))).alias("unreadable"))


def suite_runs(lines: DataFrame, branch: str) -> DataFrame:
    """One row: runs of a branch in a log of test runs (line), and the lines that name no branch or do not parse."""
    v = F.try_parse_json("line")
    named = F.startswith(F.schema_of_variant(F.try_variant_get(v, "$.branch", "variant")), F.lit("STRING"))
    rows = lines.where(F.trim("line") != "").select(F.try_variant_get(v, "$.branch", "string").alias("branch"), F.coalesce(named, F.lit(False)).alias("named"))
    return rows.agg(F.count_if(F.col("named") & (F.col("branch") == branch)).alias("runs"), F.count_if(~F.col("named")).alias("unreadable"))


def compared(before: DataFrame, after: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Two builds of a result side by side: rows of either, their values and what became of them."""
    both = before.withColumnRenamed(value, "old").join(after.withColumnRenamed(value, "new"), keys, "full")
    return both.withColumn("change", F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old") != F.col("new"), "changed").otherwise("same"))
