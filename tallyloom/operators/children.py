"""Children of sessions: by path, by header, by time and place; catalogs of transcripts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import names
from .scan import null_safe


def newest_per_id(catalog: DataFrame, key: str = "session_id", when: str = "mtime_ms", path: str = "path") -> DataFrame:
    """One row an id, that of the newest copy; of equal times the smallest path."""
    best = F.min_by(F.struct(*[c for c in catalog.columns if c != key]), F.struct(-F.col(when), F.col(path)))
    return catalog.groupBy(key).agg(best.alias("_b")).select(key, "_b.*")


def first_harness(catalog: DataFrame, ranks: dict[str, int]) -> DataFrame:
    """One row an id: of the newest copies in each harness, that of the harness ranked first."""
    known = F.create_map(*[F.lit(x) for kv in ranks.items() for x in kv])
    copies = catalog.withColumn("_rank", F.coalesce(F.try_element_at(known, F.col("harness")), F.lit(len(ranks))))
    best = F.min_by(F.struct(*[c for c in catalog.columns if c != "session_id"]), F.struct("_rank", -F.col("mtime_ms"), F.col("path")))
    return copies.groupBy("session_id").agg(best.alias("_b")).select("session_id", "_b.*")


def in_scope(catalog: DataFrame, scope: DataFrame, since_ms: int | None = None, by: str = "slug") -> DataFrame:
    """Rows whose slug is one of ``scope``'s (null scope rows count for nothing) and that changed since."""
    rows = catalog if since_ms is None else catalog.where(F.col("mtime_ms") >= since_ms)
    return rows.join(scope.select(by).distinct(), by, "left_semi")


def discover(catalog: DataFrame, directories: DataFrame, since_ms: int | None = None, by_last_cwd: bool = False) -> DataFrame:
    """Sessions of the given directories (cwd), newest copy each: by the folder that a directory's slug names, and if asked by the directory they were last in."""
    wanted = directories.select("cwd", F.explode(names.slugs(F.col("cwd"))).alias("slug"))
    rows = catalog if since_ms is None else catalog.where(F.col("mtime_ms") >= since_ms)
    found = rows.join(wanted.select("slug").distinct(), "slug", "left_semi")
    if by_last_cwd:
        found = found.unionByName(rows.join(wanted.select(F.col("cwd").alias("last_cwd")).distinct(), "last_cwd", "left_semi").select(*rows.columns)).distinct()
    return newest_per_id(found)


def discover_everywhere(catalog: DataFrame, directories: DataFrame | None = None, prefixes: tuple[str, ...] = ()) -> DataFrame:
    """Sessions of all checkouts of a repository, whatever their age, newest copy each: those whose folder is named by a directory (cwd) or begins with one of ``prefixes``, and those last in such a directory.

    Without ``directories`` every session of the catalog counts.
    """
    if directories is None:
        return newest_per_id(catalog)
    slugs = directories.select(F.explode(names.slugs(F.col("cwd"))).alias("slug")).distinct().withColumn("_by_slug", F.lit(True))
    last = directories.select(F.col("cwd").alias("last_cwd")).distinct().withColumn("_by_cwd", F.lit(True))
    rows = catalog.join(slugs, "slug", "left").join(last, "last_cwd", "left")
    named = reduce(lambda a, b: a | b, [F.startswith("slug", F.lit(p)) for p in prefixes], F.lit(False))
    return newest_per_id(rows.where(F.coalesce("_by_slug", "_by_cwd", named)).select(*catalog.columns))


def by_start(rows: DataFrame) -> DataFrame:
    """Unrecorded children in the order in which they started, as ISO text orders; those of one time by path."""
    return rows.orderBy("started", "path")


def discover_all(catalogs: dict[str, DataFrame], since_ms: int | None = None) -> DataFrame:
    """The catalogs of all harnesses as one, newest first."""
    every = reduce(DataFrame.unionByName, [c.withColumn("harness", F.lit(h)) for h, c in catalogs.items()])
    return (every if since_ms is None else every.where(F.col("mtime_ms") >= since_ms)).orderBy(F.desc("mtime_ms"), "path")


def matches(text: str) -> Column:
    """Whether a session's path or name holds ``text``, whatever its case."""
    return F.contains(F.lower("path"), F.lit(text.lower())) | F.contains(F.lower(F.coalesce("name", F.lit(""))), F.lit(text.lower()))


def children_by_path(files: DataFrame) -> DataFrame:
    """(parent, child path) of transcripts that lie in a session's own folder of children."""
    parts = F.regexp_extract("path", r"^.*/([^/]+)/subagents/(?:.*/)?agent-[^/]*\.jsonl$", 1)
    return files.withColumn("parent", parts).where("parent <> ''")


def children_by_header(heads: DataFrame) -> DataFrame:
    """Transcripts whose header names another's id: (parent_path, path)."""
    parents = heads.select(F.col("header_id").alias("parent_session"), F.col("path").alias("parent_path"))
    return heads.where("parent_session is not null").join(parents, "parent_session").where("path <> parent_path").select("parent_path", "path")


def children_of(files: DataFrame, heads: DataFrame) -> DataFrame:
    """(parent, path) by path or header, a real path once a parent."""
    by_path = children_by_path(files).select("parent", "path", "real_path")
    by_header = children_by_header(heads).join(files.select("path", "real_path"), "path").select(names.session_id(F.col("parent_path")).alias("parent"), "path", "real_path")
    return by_path.unionByName(by_header).groupBy("parent", "real_path").agg(F.min("path").alias("path"))


def with_children(turns: DataFrame, held: DataFrame) -> DataFrame:
    """``root`` and its turns, and those of the children whose transcripts it holds (root, path), in one table ordered by time wherever it is sorted by (ts_ms, path, seq).

    ``turns`` has session_id and path. What children read from an empty cache is how they begin, not something they lost: their ``cache_miss`` is cleared.
    """
    ids = held.select("root").distinct()
    own = turns.join(ids, turns["session_id"] == ids["root"], "left_semi").withColumn("root", F.col("session_id"))
    theirs = turns.join(held.select("root", F.col("path").alias("_held")), F.col("path") == F.col("_held")).drop("_held")
    return own.unionByName(theirs.withColumn("cache_miss", F.lit(False)))


def child_rows(children: DataFrame, totals: DataFrame, key: str, shown: int = 20, by: tuple[str, ...] = ()) -> DataFrame:
    """Children with their totals, dearest first and unknown ones last: ``place``, and ``more``, how many are not shown.

    ``by`` names the columns of ``children`` that make up a parent; without any all are
    one parent's. A parent's first rows are found within tasks before they meet.
    """
    rows = children.join(totals, key, "left")
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.col("ticks").desc_nulls_last(), key))
    first = rows.withColumn("place", place).where(F.col("place") <= shown)
    counts = rows.groupBy(*by).agg(F.greatest(F.count(F.lit(1)) - shown, F.lit(0)).alias("more"))
    return null_safe(first, counts, list(by)) if by else first.crossJoin(F.broadcast(counts))  # one row


def one_holder(held: DataFrame) -> DataFrame:
    """(child, holder): of all that hold a child the first by name; of two that hold each other only the first holds."""
    other = held.select(F.col("child").alias("holder"), F.col("holder").alias("child"), F.lit(True).alias("mutual")).distinct()
    rows = held.join(other, ["child", "holder"], "left").where("mutual is null or holder < child")
    return rows.groupBy("child").agg(F.min("holder").alias("holder"))


def unrecorded(candidates: DataFrame, windows: DataFrame, fan_out: DataFrame, excluded: DataFrame, folds: DataFrame, temporary: tuple[str, ...] = ("/tmp",), hour_ms: int = 3_600_000) -> DataFrame:
    """Sessions that look like a session's children though no ledger edge names them: root, session_id, path, started_ms, tier, basis.

    Candidates: (session_id, path, cwd, started_ms, launched_by, mtime_ms), newest copy judged.
    Windows: (root, lo, hi) in which the root ran commands. A directory that names the root
    makes a child ``named``; a program's start inside a window, below one of the root's
    directories (root, dir) or a temporary one, ``inferred``. Excluded: (root, session_id). A child
    that another listed row folds (holder, child) goes; of two that fold each other the first path stays.
    """
    newest = newest_per_id(candidates)
    # a candidate in a temporary folder meets the windows that touch its hour
    hours = windows.withColumn("hour", F.explode(F.sequence(F.floor(F.col("lo") / hour_ms), F.floor(F.col("hi") / hour_ms))))
    temp = reduce(lambda a, b: a | b, [names.inside(F.col("cwd"), F.lit(t)) for t in temporary])
    by_time = newest.where(F.col("launched_by") == "program").where(temp).withColumn("hour", F.floor(F.col("started_ms") / hour_ms)).join(hours, "hour").where("started_ms between lo and hi")
    # the folders above a candidate meet the root's directories by equality
    segments = F.regexp_extract_all("cwd", F.lit("[^/]+"), F.lit(0))
    above = F.transform(F.sequence(F.lit(1), F.greatest(F.size(segments), F.lit(1))), lambda i: F.concat(F.lit("/"), F.array_join(F.slice(segments, 1, i), "/")))
    below = newest.where("launched_by = 'program'").select("session_id", "started_ms", F.explode(above).alias("dir")).join(fan_out, "dir")
    below = below.join(windows, "root").where("started_ms between lo and hi").select("root", "session_id", F.lit("worktree").alias("basis")).distinct()
    in_temp = by_time.select("root", "session_id", F.lit("tmp").alias("basis")).distinct()
    # a root that a directory names is one of its parts, so that the match is an equality
    parts = newest.select("session_id", F.explode(F.array_distinct(F.regexp_extract_all("cwd", F.lit("[^/]+"), F.lit(0)))).alias("root"))
    named = parts.join(windows.select("root").distinct(), "root", "left_semi").select("root", "session_id", F.lit("cwd-names-parent").alias("basis"))
    order = F.when(F.col("basis") == "cwd-names-parent", 0).when(F.col("basis") == "worktree", 1).otherwise(2)
    judged = named.unionByName(below).unionByName(in_temp).where("root <> session_id").groupBy("root", "session_id").agg(F.min_by("basis", order).alias("basis"))
    listed = judged.join(excluded, ["root", "session_id"], "left_anti").join(newest, "session_id")
    listed = listed.select("root", "session_id", "path", "started_ms", F.when(F.col("basis") == "cwd-names-parent", "named").otherwise("inferred").alias("tier"), "basis")
    a, b = listed.select("root", F.col("session_id").alias("child"), F.col("path").alias("child_path")), listed.select("root", F.col("session_id").alias("holder"), F.col("path").alias("holder_path"))
    back = folds.select(F.col("holder").alias("child"), F.col("child").alias("holder"), F.lit(True).alias("mutual")).distinct()
    inner = folds.distinct().join(a, "child").join(b, ["root", "holder"]).where("holder <> child").join(back, ["child", "holder"], "left").where("mutual is null or holder_path < child_path")
    return listed.join(inner.select("root", F.col("child").alias("session_id")).distinct(), ["root", "session_id"], "left_anti")


def basis_totals(rows: DataFrame) -> DataFrame:
    """Per basis of inferred rows: how many, their ticks as far as readable, and how many are not."""
    return rows.where("tier = 'inferred'").groupBy("basis").agg(F.count(F.lit(1)).alias("sessions"), F.sum("ticks").alias("ticks"), F.count_if(F.col("ticks").isNull()).alias("unreadable"))
