"""Catalogs of transcripts from listings and lines: heads, last directories, spawn ledgers, sidecars."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names
from . import ranges

# Folders of derived data; lines and bytes of a head; how far from the end a directory is looked for; limits of a ledger.
DERIVED = ("subagents", "tool-results", "memory")
HEAD_LINES, TAIL_WINDOWS = 20, (8 << 10, 64 << 10, 512 << 10)
LEDGER_BYTES, FIELD_BYTES, RECORD_BYTES = 8 << 20, 512, 4096


def listing(spark: SparkSession, root: str, pattern: str = "*.jsonl", skip: tuple[str, ...] = DERIVED) -> DataFrame:
    """path, mtime_ms, size, session_id, slug of the transcripts below ``root``, from the listing alone; no contents are read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root).select("path", "modificationTime", "length")
    below = F.substring_index("path", root.rstrip("/") + "/", -1)
    rows = files.select("path", F.unix_millis("modificationTime").alias("mtime_ms"), F.col("length").alias("size"), names.session_id(F.col("path")).alias("session_id"), F.substring_index(below, "/", 1).alias("slug"))
    return rows.where(~F.concat(F.lit("/"), below).rlike("/(?:" + "|".join(skip) + ")/")) if skip else rows


def head_lines(lines: DataFrame, n: int = HEAD_LINES) -> DataFrame:
    return lines.where(F.col("line_no") < n)


_HEAD = "timestamp string, createdAt string, startTime string, cwd string, entrypoint string, type string, id string, parentSession string"


def heads(lines: DataFrame, n: int = HEAD_LINES) -> DataFrame:
    """First time, directory and entry point, and the header's ids, in a transcript's first lines; no row without a time and a directory."""
    e = head_lines(lines, n).withColumn("e", F.from_json("line", _HEAD))
    first = lambda c: F.min_by(c, F.when(c.isNotNull(), F.col("line_no")))
    time = F.coalesce("e.timestamp", "e.createdAt", "e.startTime")
    out = e.groupBy("file").agg(first(time).alias("started"), first(F.col("e.cwd")).alias("cwd"), first(F.col("e.entrypoint")).alias("entrypoint"),
                                first(F.when(F.col("e.type") == "session", F.col("e.id"))).alias("header_id"), first(F.col("e.parentSession")).alias("parent_session"))
    return out.where("started is not null and cwd is not null").withColumn("started_ms", F.unix_millis(F.try_to_timestamp("started")))


def started_between(found: DataFrame, low_ms: int, high_ms: int) -> DataFrame:
    return found.where(F.col("started_ms").between(low_ms, high_ms))


def last_directory(lines: DataFrame) -> DataFrame:
    """The last directory that each transcript names."""
    cwd = F.get_json_object("line", "$.cwd")
    return lines.where(F.contains("line", F.lit('"cwd"'))).groupBy("file").agg(F.max_by(cwd, F.when(cwd.isNotNull(), F.col("line_no"))).alias("last_cwd"))


def last_directories(files: DataFrame, windows: tuple[int, ...] = TAIL_WINDOWS) -> DataFrame:
    """path, last_cwd, bytes_read: the directory named last within the end of each file (path), by range reads.

    The end is read backwards, a window at a time, each only as far as the one before did
    not reach, until a whole line in it names a directory: at most the largest window of
    a file. Beyond it, or where a file is gone, last_cwd is null.
    """

    def read(batches):
        for batch in batches:
            out = [_last_cwd(path, windows) for path in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([c for c, _ in out], pa.string()), pa.array([n for _, n in out], pa.int64())], ["path", "last_cwd", "bytes_read"])

    return files.select("path").mapInArrow(read, "path string, last_cwd string, bytes_read long")


def _last_cwd(path: str, windows: tuple[int, ...]) -> tuple[str | None, int]:
    fs, place = ranges.store(path)
    try:
        file = fs.open_input_file(place)
    except (FileNotFoundError, OSError):
        return None, 0
    with file:
        size, data, low = file.size(), b"", file.size()
        for window in windows:
            start = max(0, size - window)
            data, low = ranges.read_range(file, start, low) + data, start
            # the first line may have begun before the window
            lines = data.split(b"\n")[0 if start == 0 else 1:]
            for line in reversed(lines):
                if b'"cwd"' in line and (cwd := _cwd_of(line)):
                    return cwd, size - low
            if start == 0:
                break
        return None, size - low


def _cwd_of(line: bytes) -> str | None:
    try:
        entry = json.loads(line)
    except ValueError:
        return None
    cwd = entry.get("cwd") if isinstance(entry, dict) else None
    return cwd if isinstance(cwd, str) and cwd else None


def changes(before: DataFrame, now: DataFrame) -> DataFrame:
    """What became of files between two listings (path, size, mtime_ms, inode; a null inode where the store has none): path, change, was.

    ``new``, ``changed`` (any part of the stamp differs, so that a file rewritten within a
    second is seen), ``gone``, and ``moved`` where a new path has the stamp of one that is gone
    (``was``). Of several such the first path by name is the one that moved.
    """
    stamp = F.struct("size", "mtime_ms", "inode")
    old = before.select("path", stamp.alias("old"), F.lit(True).alias("had"))
    both = now.select("path", stamp.alias("new"), F.lit(True).alias("has")).join(old, "path", "full")
    state = F.when(F.col("had").isNull(), "new").when(F.col("has").isNull(), "gone").when(~F.col("old").eqNullSafe(F.col("new")), "changed")
    rows = both.select("path", state.alias("change"), F.coalesce("new", "old").alias("stamp")).where("change is not null")
    known = rows.where("stamp.inode is not null")
    pairs = known.where("change = 'gone'").groupBy("stamp").agg(F.min("path").alias("was")).join(known.where("change = 'new'").groupBy("stamp").agg(F.min("path").alias("path")), "stamp").select("path", "was")
    moved = rows.where("change = 'new'").join(pairs, "path", "left").select("path", F.when(F.col("was").isNotNull(), "moved").otherwise("new").alias("change"), "was")
    rest = rows.where("change <> 'new'").join(pairs.select(F.col("was").alias("path"), F.lit(True).alias("taken")), "path", "left").where("taken is null").select("path", "change", F.lit(None).cast("string").alias("was"))
    return moved.unionByName(rest)


def harness_of(lines: DataFrame) -> DataFrame:
    """Which schema wrote a transcript: that of the first line that fits one."""
    kind = F.get_json_object("line", "$.type")
    harness = F.when(kind.isin("assistant", "user", "system", "summary"), "a").when(kind.isin("session", "message", "model_change", "compaction"), "b")
    return lines.groupBy("file").agg(F.min_by(harness, F.when(harness.isNotNull(), F.col("line_no"))).alias("harness"))


def strict(lines: DataFrame) -> DataFrame:
    """Per file whether it can be trusted: a file of several lines of which none is JSON is no transcript."""
    good = F.try_parse_json("line").isNotNull() & F.ltrim("line").startswith("{")
    return lines.groupBy("file").agg(F.count(F.lit(1)).alias("lines"), F.count_if(good).alias("parsed")).withColumn("readable", (F.col("parsed") > 0) | (F.col("lines") <= 1))


_EDGE = "parent string, child string, mechanism string, ts string, cwd string, label string, model string"


def _fits(c, required: bool):
    fine = (F.octet_length(c) <= FIELD_BYTES) & ~names.has_control(c)
    return F.coalesce((c != "") & fine, F.lit(False)) if required else F.coalesce(fine, F.lit(True))


def edges(lines: DataFrame) -> DataFrame:
    """The ledger's lines (pos, line) as edges with ``valid``: both ids are session ids, the time is ISO, no field is long or moves a cursor."""
    e = lines.withColumn("e", F.from_json("line", _EDGE)).select("pos", "e.*", F.octet_length("line").alias("bytes"))
    valid = names.is_session_id(F.col("parent")) & names.is_session_id(F.col("child")) & _fits(F.col("mechanism"), True) & names.is_iso_time(F.col("ts"))
    for c in ("cwd", "label", "model"):
        valid = valid & _fits(F.col(c), False)
    return e.withColumn("valid", valid & (F.col("bytes") <= RECORD_BYTES)).drop("bytes")


def edge_line(rows: DataFrame) -> DataFrame:
    """Edges as the ledger's lines; only valid ones may be appended."""
    return rows.select(F.to_json(F.struct("parent", "child", "mechanism", "ts", "cwd", "label", "model")).alias("line"))


_SIDECAR = "agentType string, spawnDepth double, description string, toolUseId string, model string, parentAgentId string, isFork boolean"


def sidecars(files: DataFrame) -> DataFrame:
    """A child's sidecar (path, text; null text if it could not be read): its fields, and a status: ok, invalid or unreadable.

    A missing or wrongly typed required field makes the whole sidecar invalid.
    """
    v = F.try_parse_json("text")
    typed = lambda p, kind: F.startswith(F.schema_of_variant(F.try_variant_get(v, p, "variant")), F.lit(kind))
    number = typed("$.spawnDepth", "BIGINT") | typed("$.spawnDepth", "DECIMAL") | typed("$.spawnDepth", "DOUBLE")
    ok = F.coalesce(typed("$.agentType", "STRING") & number, F.lit(False))
    status = F.when(F.col("text").isNull(), "unreadable").when(ok, "ok").otherwise("invalid")
    rows = files.withColumn("status", status).withColumn("m", F.when(F.col("status") == "ok", F.from_json("text", _SIDECAR)))
    return rows.select("path", "status", "m.*")


def recent_writers(files: DataFrame, now_ms: int, idle_ms: int = 120_000) -> DataFrame:
    """Files that any registered writer (path, writer, mtime_ms) wrote within ``idle_ms``, each once."""
    return files.where(F.lit(now_ms) - F.col("mtime_ms") < idle_ms).groupBy("path").agg(F.max("mtime_ms").alias("mtime_ms"))


def idle_since(rows: DataFrame, since: str, now_ms: int, idle_ms: int) -> DataFrame:
    return rows.where(F.lit(now_ms) - F.col(since) >= idle_ms)


def picked(files: DataFrame, n: int, now_ms: int, least_bytes: int = 40_000, days: int = 60, seed: int | None = None) -> DataFrame:
    """A sample of large recent transcripts: the first ``n`` by path, or ``n`` drawn with ``seed``."""
    some = files.where((F.col("size") > least_bytes) & (F.col("mtime_ms") >= now_ms - days * 86_400_000))
    return some.orderBy("path" if seed is None else F.xxhash64("path", F.lit(seed))).limit(n)


def writer_health(rows: DataFrame, now_ms: int) -> DataFrame:
    """Fact files (path, lines, heartbeats, size, turns, mtime_ms) that are nearly all heartbeats, or large, or empty and old."""
    mostly = (F.col("lines") > 10) & (F.col("heartbeats") >= 0.9 * F.col("lines"))
    why = F.when(mostly, "heartbeats").when(F.col("size") > 1 << 20, "large").when((F.col("turns") == 0) & (F.lit(now_ms) - F.col("mtime_ms") > 3_600_000), "empty")
    return rows.withColumn("why", why).where("why is not null")


def last_state(lines: DataFrame, by: str = "file") -> DataFrame:
    """The last state that lines of a transcript's end name: (file, model, thinking), the last value of each."""
    e = lines.withColumn("m", F.get_json_object("line", "$.message.model")).withColumn("k", F.get_json_object("line", "$.thinkingLevel"))
    last = lambda c: F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col("line_no")))
    return e.groupBy(by).agg(last("m").alias("model"), last("k").alias("thinking_level"))


