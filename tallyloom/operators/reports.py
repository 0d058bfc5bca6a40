"""Reports over priced turns: session summaries, bins, histograms of commands, top lists, one JSON document."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import classify, names, pricing, shell

MEASURES = ("cost_ticks", "in_tok", "out_tok", "cr_tok", "cw_tok", "rs_tok")
# Groups of commands by the tool they run, in the order of the report, and how long a token may be shown.
GROUPS = {
    "Build & Bundling": ("npm", "npx", "esbuild", "webpack", "vite", "tsc", "make", "gcc", "cargo", "go", "pnpm", "yarn", "bun", "node", "tsx", "ts-node", "cmake", "ninja", "g++"),
    "Dependency Management": ("pip", "pip3", "gem", "brew", "apt-get", "apt", "dnf", "pacman", "zypper", "apk"),
    "Linting & Formatting": ("eslint", "prettier", "black", "rustfmt", "shfmt", "biome", "stylelint", "shellcheck", "ruff", "flake8", "pylint", "clippy"),
    "Testing": ("jest", "vitest", "pytest", "cypress", "playwright", "mocha", "ava", "tap", "karma"),
    "Database & Infrastructure": ("sqlite3", "psql", "mysql", "docker", "kubectl", "aws", "terraform", "fly", "railway", "mongo", "redis-cli", "pg_dump", "pg_restore"),
    "Text & File Processing": ("sed", "awk", "cut", "tr", "sort", "uniq", "paste", "join", "comm", "diff", "patch", "jq", "yq", "xmllint", "column", "fold", "rev", "strings", "od", "xxd", "iconv", "base64"),
    "System & File Utilities": ("ls", "mkdir", "cp", "rm", "mv", "chmod", "chown", "touch", "wc", "du", "df", "which", "echo", "pwd", "cd", "ln", "stat", "file", "realpath", "readlink", "dirname",
                                "basename", "tar", "gzip", "gunzip", "zip", "unzip", "curl", "wget", "ssh", "scp", "rsync"),
    "Git Operations": ("git",),
    "Session & Agent": ("pi", "claude", "herdr", "ax", "clear", "exit", "source", ".", "alias", "unalias", "tmux", "screen"),
}
PARSE_MISS, UNCLASSIFIED = "Parse miss", "Unclassified"
TOKEN_CHARS = 48
PLAUSIBLE = r"^[A-Za-z0-9_.~@/][A-Za-z0-9_.~@/+-]*$"


def with_server_rows(turns: DataFrame) -> DataFrame:
    """Turns, and for each that used server tools a row of category web that holds their charge alone (``counts`` is 0)."""
    zero = {c: F.lit(0).cast(turns.schema[c].dataType) for c in MEASURES if c != "cost_ticks"}
    extra = turns.where("server_ticks > 0").withColumns({**zero, "cost_ticks": F.col("server_ticks"), "category": F.lit("web"), "counts": F.lit(0)})
    return turns.withColumn("counts", F.lit(1)).unionByName(extra)


def session_summary(turns: DataFrame) -> DataFrame:
    """level (total, model, category), name, place, turns and the measures, of deduplicated turns.

    Turns without a model's name count as untagged alone (level untagged). Models come dearest
    first, all categories in their order, unknown ones as other; server tools are charged to
    their model and to web.
    """
    rows = with_server_rows(turns).withColumn("model", F.coalesce(F.nullif("model", F.lit("")), F.lit("(unknown)")))
    rows = rows.withColumn("category", F.when(F.col("category").isin(*classify.CATEGORIES), F.col("category")).otherwise("other")).withColumn("is_tagged", pricing.tagged(F.col("model")))
    sums = [F.sum("counts").cast("bigint").alias("turns"), *[F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c) for c in MEASURES]]
    cells = rows.groupBy("is_tagged", "model", "category").agg(*sums)  # a few rows: all below is about these
    again = [F.sum(c).alias(c) for c in ("turns", *MEASURES)]
    part = lambda df, level, name: df.groupBy(name.alias("name")).agg(*again).withColumn("level", F.lit(level))
    tagged, bare = cells.where("is_tagged"), cells.where("not is_tagged")
    known = F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.lit(i).alias("ord")) for i, c in enumerate(classify.CATEGORIES)])).alias("c")
    order = turns.sparkSession.range(1).select(known).select("c.*")
    by_category = order.join(part(tagged, "category", F.col("category")), "name", "left").na.fill(0, ["turns", *MEASURES]).withColumn("level", F.lit("category"))
    by_model = part(tagged, "model", F.col("model")).withColumn("ord", (F.row_number().over(Window.orderBy(F.desc("cost_ticks"), "name")) - 1).cast("int"))
    one = lambda df, level: part(df, level, F.lit(level)).withColumn("ord", F.lit(0))
    cols = ["level", "name", F.col("ord").alias("place"), "turns", *MEASURES]
    return reduce(DataFrame.unionByName, [d.select(*cols) for d in (one(tagged, "total"), by_model, by_category, one(bare, "untagged"))])


def compactions(turns: DataFrame) -> DataFrame:
    """How many turns followed a compaction and the tokens it freed, over tagged and untagged turns."""
    freed = F.coalesce("compaction_before", F.lit(0))
    return turns.agg(F.count_if(freed > 0).alias("events"), F.coalesce(F.sum(freed), F.lit(0)).cast("bigint").alias("tokens_freed"))


def unpriced_models(*turns: DataFrame) -> DataFrame:
    """Distinct named models, over all given turns, whose rates are not known."""
    every = reduce(DataFrame.union, [t.select("model", "known_rates") for t in turns])
    return every.where(pricing.tagged(F.col("model")) & ~F.col("known_rates")).select("model").distinct()


def bin_cells(turns: DataFrame, key: Column) -> DataFrame:
    """Per bin and category: cost, all tokens, output tokens, whether any turn was priced at peak rates, and turns that missed the cache."""
    tokens = F.col("in_tok") + F.col("out_tok") + F.col("cr_tok") + F.col("cw_tok") + F.coalesce("rs_tok", F.lit(0))
    return turns.groupBy(key.alias("bin"), "category").agg(
        F.sum("cost_ticks").alias("cost_ticks"), F.sum(tokens).alias("tok"), F.sum(F.col("out_tok") + F.coalesce("rs_tok", F.lit(0))).alias("written_tok"),
        F.max("peak_priced").alias("peak"), F.count_if(F.col("cache_miss")).alias("misses"))


def newest_bins(cells: DataFrame, limit: int = 17) -> DataFrame:
    """The latest bins: bin, cost_ticks, tok, peak."""
    if limit < 1:
        raise ValueError("the number of bins is one or more")
    return cells.groupBy("bin").agg(F.sum("cost_ticks").alias("cost_ticks"), F.sum("tok").alias("tok"), F.max("peak").alias("peak")).orderBy(F.desc("bin")).limit(limit)


def dearest_models(turns: DataFrame, limit: int) -> DataFrame:
    return turns.groupBy("model").agg(F.sum("cost_ticks").alias("cost_ticks"), F.count(F.lit(1)).alias("turns")).orderBy(F.desc("cost_ticks"), "model").limit(limit)


def cache_hits(turns: DataFrame, *by: str) -> DataFrame:
    """Share of what was read that came from the cache, null where nothing was read."""
    read = F.sum(F.col("cr_tok") + F.col("cw_tok") + F.col("in_tok"))
    return turns.groupBy(*by).agg(F.round(F.sum("cr_tok") / F.nullif(read, F.lit(0)), 9).alias("hit"))


def cache_missed(is_sidechain: Column, read: Column, written: Column) -> Column:
    """A turn of the main chain that wrote to the cache and read nothing from it."""
    return ~is_sidechain & (read == 0) & (written > 0)


def page_of(rows: DataFrame, order: list, selected: int, total: int, shown: int = 11) -> DataFrame:
    """The ``shown`` rows around the selected one, as a picker shows them."""
    return rows.orderBy(*order).offset(max(0, min(selected - shown // 2, total - shown))).limit(shown)


def shown_token(token: Column) -> Column:
    clean = F.regexp_replace(token, names.CONTROL, "")
    return F.when(F.char_length(clean) > TOKEN_CHARS, F.concat(F.left(clean, F.lit(TOKEN_CHARS - 1)), F.lit("…"))).otherwise(clean)


def plausible(token: Column) -> Column:
    return F.regexp_replace(token, "…$", "").rlike(PLAUSIBLE)


def command_group(token: Column) -> Column:
    """The group of a command by its first token."""
    tool = F.substring_index(token, "/", -1)
    known = F.create_map(*[F.lit(x) for g, tools in GROUPS.items() for t in tools for x in (t, g)])
    return F.when(~plausible(token), F.lit(PARSE_MISS)).otherwise(F.coalesce(F.try_element_at(known, tool), F.lit(UNCLASSIFIED)))


def other_histogram(turns: DataFrame) -> DataFrame:
    """The commands of turns of category other: group, command (null: all of the group), calls, cost_ticks, place of the group.

    A turn's whole cost goes to each of its commands, so sums exceed what was spent.
    """
    each = turns.where("category = 'other'").select("cost_ticks", F.explode("commands").alias("raw"))
    token = F.regexp_extract(shell.primary_command(F.col("raw")), r"^\S+", 0)
    rows = each.select("cost_ticks", token.alias("token")).where("token <> ''").select("cost_ticks", command_group(F.col("token")).alias("group"), shown_token(F.col("token")).alias("command"))
    order = F.create_map(*[F.lit(x) for i, g in enumerate([*GROUPS, PARSE_MISS]) for x in (g, i)])
    out = rows.groupingSets([["group", "command"], ["group"]], "group", "command").agg(F.count(F.lit(1)).alias("calls"), F.sum("cost_ticks").alias("cost_ticks"))
    return out.withColumn("place", F.coalesce(F.try_element_at(order, F.col("group")), F.lit(len(GROUPS) + 1)))


def other_warning(turns: DataFrame, share: float = 0.2, least_ticks: int = 6 * pricing.TICKS) -> DataFrame:
    """Sessions of which category other holds more than ``share`` and ``least_ticks``."""
    other = F.sum(F.when(F.col("category") == "other", F.col("cost_ticks")).otherwise(0))
    return turns.groupBy("session_id").agg(other.alias("other_ticks"), F.sum("cost_ticks").alias("cost_ticks")).where((F.col("other_ticks") > least_ticks) & (F.col("other_ticks") > share * F.col("cost_ticks")))


def spend_shares(turns: DataFrame, by: str, limit: int | None = None) -> DataFrame:
    """Spend and turns per value of ``by`` with the percent of all, dearest first."""
    cells = turns.groupBy(by).agg(F.sum("cost_ticks").alias("cost_ticks"), F.count(F.lit(1)).alias("turns"))
    whole = cells.withColumn("percent", F.round(100 * F.col("cost_ticks") / F.nullif(F.sum("cost_ticks").over(Window.partitionBy()), F.lit(0)), 6))
    rows = whole.orderBy(F.desc("cost_ticks"), by)
    return rows if limit is None else rows.limit(limit)


def shape_census(texts: DataFrame, text: str, shapes: dict[str, str]) -> DataFrame:
    """How many texts have each shape (a pattern), and how many in ten thousand; shapes overlap."""
    hits = texts.agg(F.count(F.lit(1)).alias("n"), *[F.coalesce(F.count_if(F.col(text).rlike(p)), F.lit(0)).alias(k) for k, p in shapes.items()])
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("shape"), F.col(k).alias("hits")) for k in shapes])).alias("s")
    return hits.select("n", each).select("s.shape", "s.hits", F.round(10_000 * F.col("s.hits") / F.nullif("n", F.lit(0)), 6).alias("per_10k"))


def first_rule(text: Column, rules: dict[str, str], rest: str) -> Column:
    """Name of the first rule (a pattern) that a text fits."""
    return F.coalesce(*[F.when(text.rlike(p), F.lit(k)) for k, p in rules.items()], F.lit(rest))


def each_once(turns: DataFrame, values: str, out: str) -> DataFrame:
    """Spend per distinct value of a list column: a turn counts under each of its values."""
    return turns.select("cost_ticks", F.explode(F.array_distinct(values)).alias(out)).groupBy(out).agg(F.count(F.lit(1)).alias("turns"), F.sum("cost_ticks").alias("cost_ticks"))


def first_wins(turns: DataFrame, folded: DataFrame, place: str = "place") -> DataFrame:
    """One row per message, that of the first transcript by ``place``; transcripts that another folded (session_id) are out; turns without a message all stay."""
    rows = turns.join(folded, "session_id", "left_anti")
    one = F.min_by(F.struct(*[c for c in rows.columns if c != "message_id"]), F.struct(place, "seq"))
    named = rows.where("message_id is not null").groupBy("message_id").agg(one.alias("_b")).select("message_id", "_b.*")
    return named.select(*rows.columns).unionByName(rows.where("message_id is null"))


def change_cost(turns: DataFrame, folded: DataFrame, place: str = "place") -> DataFrame:
    """What a change cost: transcripts, turns and measures, each message once; no row without a turn."""
    sums = first_wins(turns, folded, place).agg(F.count_distinct("session_id").alias("transcripts"), F.count(F.lit(1)).alias("turns"), *[F.sum(c).cast("bigint").alias(c) for c in MEASURES[:5]])
    return sums.where("turns > 0")


def reaches(files: Column, commands: Column, cwd: Column, tree: str) -> Column:
    """Whether a turn worked in the folder ``tree``: ran there, touched a file below it, or named it in a command."""
    quoted = "".join("\\" + c if not c.isalnum() and c not in "/_" else c for c in tree)
    under = lambda p: (p == tree) | F.startswith(p, F.lit(tree + "/"))
    return F.coalesce(under(cwd), F.lit(False)) | F.exists(files, lambda f: under(f["path"])) | F.exists(commands, lambda c: c.rlike(quoted + r"""(?=$|[/\s'";&|)<>])"""))


def file_counts(paths: Column) -> Column:
    """(source, tests, docs) of a change's paths; the lock file counts nowhere."""
    kept = F.filter(paths, lambda p: p != "bun.lock")
    tests = lambda p: F.startswith(p, F.lit("tests/"))
    docs = lambda p: ~tests(p) & (F.startswith(p, F.lit("docs/")) | (~F.contains(p, F.lit("/")) & F.endswith(p, F.lit(".md"))))
    n = lambda f: F.size(F.filter(kept, f))
    return F.struct(n(lambda p: ~tests(p) & ~docs(p)).alias("source"), n(tests).alias("tests"), n(docs).alias("docs"))


def reruns(runs: DataFrame, suite: str, order: str, *by: str) -> DataFrame:
    """Runs marked as reruns where the suite ran before."""
    return runs.withColumn("rerun", F.row_number().over(Window.partitionBy(*by, suite).orderBy(order)) > 1)


def with_block(text: Column, begin: str, end: str, block: Column) -> Column:
    """A text whose block between the lines ``begin`` and ``end`` is replaced, or appended."""
    whole = F.concat(F.lit(begin + "\n"), block, F.lit("\n" + end))
    before, after = F.substring_index(text, begin, 1), F.substring_index(text, end, -1)
    has = F.contains(text, F.lit(begin)) & F.contains(text, F.lit(end))
    return F.when(has, F.concat(before, whole, after)).otherwise(F.concat(text, F.lit("\n"), whole))


def document(session: str, summary: DataFrame, compaction: DataFrame, schema: int = 9) -> DataFrame:
    """One row, one JSON document of a session's summary: total, models, categories, compaction, untagged."""
    entry = lambda *own: F.struct(*own, *[F.col(c) for c in ("turns", *MEASURES)])
    named = lambda level: F.transform(F.array_sort(F.collect_list(F.when(F.col("level") == level, F.struct("place", entry(F.col("name").alias("name")).alias("e"))))), lambda s: s["e"])
    one = lambda level: F.max(F.when(F.col("level") == level, entry()))
    parts = summary.agg(one("total").alias("total"), named("model").alias("models"), named("category").alias("categories"), one("untagged").alias("untagged"))
    return parts.crossJoin(compaction.select(F.struct("events", "tokens_freed").alias("compaction"))).select(  # one row by one row
        F.to_json(F.struct(F.lit(schema).alias("schema"), F.lit(session).alias("session"), "total", "models", "categories", "compaction", "untagged")).alias("document"))


def rate_manifest(cards: DataFrame) -> DataFrame:
    """One row: the rate card as JSON, models in order of name, each with its base, dated and sized rates."""
    return cards.agg(F.to_json(F.array_sort(F.collect_list(F.struct(F.col("card").alias("model"), "base", F.array_sort("dates").alias("dates"), F.array_sort("sizes").alias("sizes"), "peak")))).alias("manifest"))


def cell_owner(parts: DataFrame, cell: str) -> DataFrame:
    """The dearest category of each cell, ties to the first by name."""
    return parts.groupBy(cell).agg(F.min_by("category", F.struct(-F.col("cost_ticks"), "category")).alias("category"))


def stacked_cells(costs: np.ndarray, scale: int, width: int) -> np.ndarray:
    """Whole cells of each category (columns) in bars of running totals (rows, oldest first).

    A bar has round(total * width / scale) cells. Each category has its floor at least, and
    never fewer than in the bar before; what is too much then leaves the categories that
    grew most, and what is missing goes to those furthest below their share. Ties go to the
    first category. Counts of ticks are integers of any size.
    """
    out, before = np.zeros(costs.shape, dtype=np.int64), np.zeros(costs.shape[1], dtype=np.int64)
    for row, own in enumerate(costs):
        own = [int(c) for c in own]
        total = sum(own)
        bar = (2 * total * width + scale) // (2 * scale) if scale > 0 else 0
        cells = np.maximum([c * bar // scale if scale > 0 else 0 for c in own], before)
        while cells.sum() > bar and (cells > 0).any():
            cells[int(np.where(cells > 0, cells - before, -width - 1).argmax())] -= 1
        while cells.sum() < bar and total > 0:
            short = [c * bar - int(n) * total for c, n in zip(own, cells)]
            cells[short.index(max(short))] += 1
        out[row] = before = cells
    return out


def cumulative_cells(rows: DataFrame, by: str, order: list[str], width: int, scale: Column | None = None) -> DataFrame:
    """The cells of charts of running totals: rows (``by``, bin, category, cost_ticks), the totals of each bin alone; out: also running ticks and cells.

    Bars follow each other, so a chart is made in one task; it has as many rows as a report
    shows bins (``newest_bins``) times categories. ``scale`` (a column of ``rows``, the same
    in a chart) is the cost of a full bar, else the dearest bar's. Categories absent from a bin have a row with what they had before.
    """
    schema = f"{by} {rows.schema[by].dataType.simpleString()}, bin {rows.schema['bin'].dataType.simpleString()}, category string, run_ticks long, cells long"

    def draw(key: tuple, chart: pd.DataFrame) -> pd.DataFrame:
        grid = chart.groupby(["bin", "category"])["cost_ticks"].sum().unstack(fill_value=0).reindex(columns=order, fill_value=0).sort_index().cumsum()
        full = int(chart["_scale"].iloc[0]) if scale is not None else int(grid.sum(axis=1).max())
        cells = stacked_cells(grid.to_numpy(), full, width)
        long = grid.stack().rename("run_ticks").reset_index()
        long.columns = ["bin", "category", "run_ticks"]
        return long.assign(cells=cells.ravel(), **{by: key[0]})[[by, "bin", "category", "run_ticks", "cells"]]

    slim = rows.select(by, "bin", "category", F.col("cost_ticks").cast("bigint").alias("cost_ticks"), (F.lit(0) if scale is None else scale).cast("bigint").alias("_scale"))
    return slim.groupBy(by).applyInPandas(draw, schema)
