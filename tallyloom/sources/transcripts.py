"""Transcripts: JSON lines of two log schemas, normalised to turns.

A schema is an adapter, a set of column expressions over the parsed line; the first that
matches a line wins. Further schemas are registered as translations of their lines
into one of these. Order is file and line number, never time: several lines of one
response share their time.
"""

from __future__ import annotations

import importlib
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import classify, pricing, shell
from ..operators import reports, scan
from ..operators.scratch import written

# How an interrupt is marked in a user's line; dollars a web search or fetch.
INTERRUPT = "[Request interrupted by user"
SERVER_TOOL = 0.03
# Folders of derived data beside transcripts. Children's folders are read where they are asked for.
DERIVED = ("tool-results", "memory")

_ARGS = "command:string,file_path:string,path:string,directory:string,target:string,notebook_path:string"
_USAGE = (
    "input_tokens:bigint,output_tokens:bigint,cache_read_input_tokens:bigint,cache_creation_input_tokens:bigint,reasoning_tokens:bigint,"
    "cache_creation:struct<ephemeral_5m_input_tokens:bigint,ephemeral_1h_input_tokens:bigint>,server_tool_use:struct<web_search_requests:bigint,web_fetch_requests:bigint>,"
    "iterations:string,input:bigint,output:bigint,cacheRead:bigint,cacheWrite:bigint,reasoning:bigint,cost:struct<total:double>")
_BLOCKS = f"array<struct<type:string,text:string,thinking:string,name:string,input:struct<{_ARGS}>,arguments:struct<{_ARGS}>>>"
LINE = (
    "type string, subtype string, timestamp string, cwd string, isSidechain boolean, isCompactSummary boolean, requestId string, modelId string, thinkingLevel string, "
    f"tokensBefore bigint, message struct<role:string,id:string,model:string,timestamp:string,content:string,usage:struct<{_USAGE}>>")


@dataclass(frozen=True)
class Adapter:
    """What a schema says about a parsed line ``e``; expressions are null where they do not apply."""

    name: str
    is_turn: Column
    native_usd: Column
    tokens: tuple[Column, Column, Column, Column, Column]  # input, output, cache read, cache write, reasoning
    tool_type: str
    tool_args: str
    compaction: Column
    recap: Column


def _usage(*names: str) -> tuple[Column, ...]:
    return tuple(F.coalesce(F.col(f"e.message.usage.{n}"), F.lit(0)) for n in names)


def adapters() -> tuple[Adapter, ...]:
    assistant = F.col("e.message.role") == "assistant"
    return (
        Adapter("a", (F.col("e.type") == "assistant") & assistant, F.lit(None).cast("double"),
                _usage("input_tokens", "output_tokens", "cache_read_input_tokens", "cache_creation_input_tokens", "reasoning_tokens"),
                "tool_use", "input", F.col("e.subtype") == "compact_boundary", F.col("e.subtype") == "away_summary"),
        Adapter("b", (F.col("e.type") == "message") & assistant, F.col("e.message.usage.cost.total"),
                _usage("input", "output", "cacheRead", "cacheWrite", "reasoning"),
                "toolCall", "arguments", F.col("e.type") == "compaction", F.lit(False)),
    )


@dataclass(frozen=True)
class Outside:
    """A schema of somebody else's: which lines are its own, and these as a struct of type ``LINE``, in the words of schema a or b. Both take the line's text as a column."""

    name: str
    fits: Callable[[Column], Column]
    as_line: Callable[[Column], Column]


#: Schemas taken in beside the two built in, in the order in which they are asked.
_outside: dict[str, Outside] = {}


def register(*schemas: Outside) -> None:
    """Take in schemas; one of a name that is known replaces it."""
    for schema in schemas:
        if schema.name in ("a", "b"):
            raise ValueError(f"schema {schema.name} is built in")
        _outside[schema.name] = schema


def forget(*names: str) -> None:
    for name in names:
        _outside.pop(name, None)


def load(names: list[str]) -> list[str]:
    """Register the schemas that a configuration names as module:attribute; what cannot be loaded is returned with its reason, and the rest goes on."""
    failed = []
    for name in names:
        module, _, attribute = name.partition(":")
        try:
            found = getattr(importlib.import_module(module), attribute)
            if not isinstance(found, Outside):
                raise TypeError("no schema")
            register(found)
        except (ImportError, AttributeError, TypeError, ValueError) as e:
            failed.append(f"{name}: {e}")
    return failed


def _text(spark: SparkSession, path: str, skip: tuple[str, ...], modified_after: str | None, only: DataFrame | None = None) -> DataFrame:
    reader = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jsonl").option("lineSep", "\n")
    text = (reader.option("modifiedAfter", modified_after) if modified_after else reader).text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    text = text.where(~F.col("file").rlike("/(?:" + "|".join(skip) + ")/")) if skip else text
    return text if only is None else text.join(only.select("file"), "file", "left_semi")


def read_lines(spark: SparkSession, path: str, skip: tuple[str, ...] = DERIVED, modified_after: str | None = None, only: DataFrame | None = None) -> DataFrame:
    """file, line_no, line of every non-blank line below ``path``, numbered in the order of the files.

    Files are read in splits, a line a row. A line's number is the count of lines in the
    splits before its own, and its rank in its own: no task holds more of a file than a
    split. Folders of derived data are skipped, and files not changed after ``modified_after`` or not in ``only`` (file).
    """
    text = _text(spark, path, skip, modified_after, only)
    rows = text.select("file", "block", F.monotonically_increasing_id().alias("at"), F.col("value").alias("line"))
    rank = F.row_number().over(Window.partitionBy("file", "block").orderBy("at")) - 1
    sizes = text.select("file", "block").groupBy("file", "block").agg(F.count(F.lit(1)).alias("n"))
    ahead = F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    placed = rows.withColumn("rank", rank).join(sizes.select("file", "block", F.coalesce(ahead, F.lit(0)).alias("ahead")), ["file", "block"])
    return placed.select("file", (F.col("ahead") + F.col("rank")).alias("line_no"), "line").where(F.trim("line") != "")


def read_files(spark: SparkSession, path: str, skip: tuple[str, ...] = DERIVED, modified_after: str | None = None) -> DataFrame:
    """file: the transcripts that hold a line."""
    return _text(spark, path, skip, modified_after).select("file").distinct()


def _ms(c: Column) -> Column:
    number = c.try_cast("bigint")
    return F.coalesce(number, F.unix_millis(F.try_to_timestamp(c)), F.lit(0))


def entries(lines: DataFrame) -> DataFrame:
    """Parsed lines with what the adapters read in them, and their further columns; lines that are no JSON go."""
    known = adapters()
    first = lambda pick: F.coalesce(*[F.when(a.is_turn, pick(a)) for a in known])
    line, plain = F.col("line"), F.from_json("line", LINE)
    fits = {n: F.coalesce(o.fits(line), F.lit(False)) for n, o in _outside.items()}
    e = reduce(lambda rest, n: F.when(fits[n], _outside[n].as_line(line).cast(StructType.fromDDL(LINE))).otherwise(rest), reversed(_outside), plain)
    own = reduce(lambda rest, n: F.when(fits[n], F.lit(n)).otherwise(rest), reversed(_outside), F.lit(None).cast("string"))
    parsed = lines.withColumn("e", e).withColumn("outside", own).where(F.coalesce(F.col("e.type"), F.col("e.timestamp")).isNotNull() | (F.col("e.isCompactSummary")))
    text = F.col("e.message.content")
    user_texts = F.from_json(text, "array<struct<type:string,text:string>>")
    interrupted = (F.col("e.type") == "user") & F.when(
        F.startswith(F.ltrim(text), F.lit("[{")), F.exists(F.coalesce(user_texts, F.array()), lambda b: (b["type"] == "text") & F.contains(b["text"], F.lit(INTERRUPT)))
    ).otherwise(F.contains(text, F.lit(INTERRUPT)))
    yes = lambda c: F.coalesce(c, F.lit(False))
    names = ("in_tok", "out_tok", "cr_tok", "cw_tok", "rs_tok")
    out = parsed.select(
        "file", "line_no", "e", F.when(first(lambda a: F.lit(a.name)).isNotNull(), F.coalesce("outside", first(lambda a: F.lit(a.name)))).alias("harness"),
        first(lambda a: a.native_usd).alias("native_usd"), *[first(lambda a, i=i: a.tokens[i]).alias(n) for i, n in enumerate(names)],
        yes(interrupted).alias("interrupt"), (yes(F.col("e.isCompactSummary")) | yes(F.col("e.type") == "compaction")).alias("compacted"),
        F.when(F.col("e.type") == "model_change", F.nullif("e.modelId", F.lit(""))).alias("model_set"),
        F.when(F.col("e.type") == "thinking_level_change", F.nullif("e.thinkingLevel", F.lit(""))).alias("thinking_set"),
        F.when(F.col("e.type") == "compaction", F.col("e.tokensBefore")).alias("freed"),
        yes(F.col("e.type") == "system").alias("system"),
        F.from_json(text, _BLOCKS).alias("blocks"), *[c for c in lines.columns if c not in ("file", "line_no", "line")])
    uncounted = F.when(yes(known[0].compaction) | yes(known[1].compaction), F.lit("compaction")).when(yes(known[0].recap), F.lit("recap"))
    return out.withColumn("uncounted", uncounted)


def states(rows: DataFrame) -> DataFrame:
    """What the lines around a turn say of it, by (file, line_no): the model and thinking level in force, interrupted, after_compaction, compaction_before (tokens).

    Only the few columns that carry are scanned, segment by segment; texts and tools of lines stay where they are.
    """
    slim = rows.select("file", "line_no", F.col("harness").isNotNull().alias("is_turn"), "interrupt", "compacted", "model_set", "thinking_set", "freed")
    slim = slim.where("is_turn or interrupt or compacted or model_set is not null or thinking_set is not null")
    found = written(scan.scan(slim, ("file",), "line_no", {"nth": F.col("is_turn")}, {"model_before": F.col("model_set"), "thinking_level": F.col("thinking_set")}))
    freed = F.when(F.col("freed").isNotNull(), F.struct("line_no", "freed"))
    marks = scan.stamps(found, ("file",), "nth", {"interrupted": F.col("interrupt")}, {"after_compaction": F.col("compacted"), "last_freed": freed})
    return found.where("is_turn").join(marks, ["file", "nth"]).select(
        "file", "line_no", "model_before", "thinking_level", "interrupted", F.coalesce("after_compaction", F.lit(False)).alias("after_compaction"), F.col("last_freed.freed").alias("compaction_before"))


def described(rows: DataFrame) -> DataFrame:
    """What a turn's own line says of it (rows of ``entries`` that are turns), with further columns kept: tokens, tools, and ``kind``, its category unless it is interrupted."""
    tool = lambda b: F.lower(b["name"])
    args = lambda b: F.coalesce(b["input"], b["arguments"])
    tools = F.filter(F.coalesce("blocks", F.array()), lambda b: b["type"].isin("tool_use", "toolCall"))
    path = lambda b: F.coalesce(args(b)["file_path"], args(b)["path"], args(b)["directory"], args(b)["target"], args(b)["notebook_path"])
    action = lambda b: F.when(tool(b).isin("read", "view", "glob", "ls"), "read").when(tool(b).isin("edit", "write", "replace", "notebookedit"), "write")
    files = F.filter(F.transform(tools, lambda b: F.struct(path(b).alias("path"), action(b).alias("action"))), lambda f: f["path"].isNotNull() & f["action"].isNotNull())
    commands = F.filter(F.transform(tools, lambda b: F.when(tool(b).isin("bash", "run"), args(b)["command"])), lambda c: c.isNotNull())
    handled = ("read", "view", "glob", "ls", "edit", "write", "replace", "notebookedit", "bash", "run")
    others = F.filter(tools, lambda b: ~tool(b).isin(*handled))
    cats = F.filter(F.transform(others, lambda b: classify.tool_class(tool(b))), lambda c: c.isNotNull())
    use = F.col("e.message.usage")
    hour = F.coalesce(use["cache_creation"]["ephemeral_1h_input_tokens"], F.lit(0))
    side = F.coalesce("e.isSidechain", F.lit(False))
    read_here = ("e", "blocks", "harness", "system", "uncounted", "interrupt", "compacted", "model_set", "thinking_set", "freed", "file", "line_no", "native_usd", "in_tok", "out_tok", "cr_tok", "cw_tok", "rs_tok")
    out = rows.select(
        F.col("file").alias("session_id"), F.col("line_no").cast("long").alias("seq"), _ms(F.coalesce("e.message.timestamp", "e.timestamp")).alias("ts_ms"),
        F.col("e.message.id").alias("message_id"), F.col("e.requestId").alias("request_id"), F.nullif("e.message.model", F.lit("")).alias("own_model"), "in_tok", "out_tok", "cr_tok", "cw_tok", "rs_tok",
        hour.alias("cw1h_tok"), F.when(hour > 0, "1h").when(F.coalesce(use["cache_creation"]["ephemeral_5m_input_tokens"], F.lit(0)) > 0, "5m").alias("cache_ttl"),
        reports.cache_missed(side, F.col("cr_tok"), F.col("cw_tok")).alias("cache_miss"), side.alias("is_sidechain"),
        F.coalesce(use["server_tool_use"]["web_search_requests"], F.lit(0)).alias("web_searches"), F.coalesce(use["server_tool_use"]["web_fetch_requests"], F.lit(0)).alias("web_fetches"),
        F.size(F.when(F.startswith(F.ltrim(use["iterations"]), F.lit("[")), F.from_json(use["iterations"], "array<string>"))).alias("iterations"), "native_usd",
        F.concat(files, shell.all_files(commands)).alias("files"), commands.alias("commands"), cats.alias("tool_cats"),
        F.exists(F.coalesce("blocks", F.array()), lambda b: b["type"].isin("text", "thinking")).alias("has_text"),
        F.exists(others, lambda b: ~classify.tool_known(tool(b))).alias("unknown_tool"), *[c for c in rows.columns if c not in read_here])
    kind = classify.turn_class(F.lit(False), F.col("files"), F.col("tool_cats"), F.col("commands"), F.col("has_text"), F.col("unknown_tool"))
    return out.withColumn("kind", kind)


def finished(rows: DataFrame) -> DataFrame:
    """Described turns, once their model and interrupts are known: priced, with their category. ``rows`` has model and interrupted beside what ``described`` gives; lists are not needed."""
    charged = rows.withColumn("server_ticks", pricing.server_tool_ticks(F.col("model"), F.col("web_searches") + F.col("web_fetches")))
    tokens = F.col("in_tok") + F.col("out_tok") + F.col("cr_tok") + F.col("cw_tok") + F.col("rs_tok")
    own = F.col("native_usd").isNotNull() & ~((F.col("native_usd") == 0) & (tokens > 0))
    priced = pricing.price(charged, peaks="has_peaks")
    return priced.withColumns({
        "peak_priced": F.when(F.col("has_peaks"), F.col("peak_priced")), "cost_ticks": F.when(own, F.round(F.col("native_usd") * pricing.TICKS).cast("bigint")).otherwise(F.col("cost_ticks")),
        "category": F.when(F.col("interrupted"), "interrupted").otherwise(F.col("kind"))}).drop("native_usd", "has_peaks", "kind", "own_model")


def turns(lines: DataFrame) -> DataFrame:
    """Turns of all files, priced and classified, one row a line that is an answer.

    A turn is interrupted by an interrupt between it and the next; a compaction before it
    marks it; the model and thinking level last set apply where the line names none. Costs
    are in ticks; a native cost wins unless it is 0 beside tokens. ``cache_ttl`` is the
    longest tier written to, ``cache_miss`` a turn of the main chain that wrote to the
    cache and read nothing, ``peak_priced`` null for models without peak hours.
    """
    parsed = entries(lines)
    rows = described(parsed.where("harness is not null").join(states(parsed), ["file", "line_no"]))
    return finished(rows.withColumn("model", F.coalesce("own_model", "model_before")).drop("model_before"))
