"""A stream source of lines that are appended to files: each trigger reads the new bytes alone."""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from ..sources import ranges

SCHEMA = "file string, generation int, pos long, line string"
#: Bytes at a file's start and before the place reached that tell a file from one put in its place.
HEAD, MARK = 256, 64
#: Bytes that a task reads, and a trigger, about.
SPLIT, TRIGGER = 64 << 20, 8 << 30


@dataclass
class Range(InputPartition):
    """(file, generation, begin, end, whether a line may start before begin) to read; opened: generations to announce."""

    parts: list[tuple[str, int, int, int, bool]] = field(default_factory=list)
    opened: list[tuple[str, int]] = field(default_factory=list)


class TailSource(DataSource):
    """Lines of the ``*.jsonl`` files below a folder, as they grow: file, generation, pos (of its first byte), line.

    ``spark.readStream.format("grown_lines").option("path", ...).option("state", ...)``.
    The offset is, by file, its generation, the place reached, its inode and checksums of
    its first bytes and of those before that place. A last line without its newline waits;
    if two triggers see it unchanged and it is JSON, it counts as whole. A file that
    shrank, was replaced, or whose checksums changed is read anew from its start under the
    next generation; one that is gone opens a generation without lines. A generation
    beyond the first is announced by a row of pos -1 and a null line: what was said
    before is void.

    ``state`` is a folder that outlives the query, beside its checkpoint: the end of the last
    planned micro-batch, from which the next one is found after a restart (a replayed
    micro-batch has its ends from Spark's own log). Options: ``maxBytes`` a trigger,
    ``splitBytes`` a task, ``suffix``; ``shards`` and ``shard`` spread very many files over
    several streams, since a stream's offset holds an entry for each of its files.
    """

    @classmethod
    def name(cls) -> str:
        return "grown_lines"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> TailReader:
        return TailReader(dict(self.options))


class TailReader(DataSourceStreamReader):
    def __init__(self, options: dict) -> None:
        self.root, self.state = options["path"].rstrip("/"), options["state"].rstrip("/")
        self.most, self.split = int(options.get("maxbytes", TRIGGER)), int(options.get("splitbytes", SPLIT))
        self.suffix = options.get("suffix", ".jsonl")
        self.shards, self.shard = int(options.get("shards", 1)), int(options.get("shard", 0))
        self.seen: dict[str, tuple] = {}  # stamp and unfinished bytes of each file at the last trigger
        self.turn = ""  # the file after which the next trigger begins, so that none waits for ever
        self.known = self._planned()

    # --- what was planned last

    def _planned(self) -> dict:
        fs, path = ranges.store(f"{self.state}/planned.json")
        try:
            with fs.open_input_file(path) as f:
                return json.loads(f.read())
        except FileNotFoundError:
            return {}

    def _plan(self, end: dict) -> None:
        fs, path = ranges.store(f"{self.state}/planned.json")
        fs.create_dir(path.rpartition("/")[0], recursive=True)
        with fs.open_output_stream(path + ".new") as f:
            f.write(json.dumps(end).encode())
        fs.move(path + ".new", path)
        self.known = end

    # --- offsets

    def initialOffset(self) -> dict:
        return {}

    def _listing(self) -> dict[str, tuple[int, int, int]]:
        """Size, time and inode (0 where the store has none) of each file of this stream's shard."""
        import os

        from pyarrow import fs as pafs

        fs, path = ranges.store(self.root)
        local = isinstance(fs, pafs.LocalFileSystem)
        head = "" if local or "://" not in self.root else self.root.partition("://")[0] + "://"
        out = {}
        for info in fs.get_file_info(pafs.FileSelector(path, recursive=True, allow_not_found=True)):
            name = head + info.path
            if info.type != pafs.FileType.File or not name.endswith(self.suffix) or zlib.crc32(name.encode()) % self.shards != self.shard:
                continue
            try:
                out[name] = (info.size, info.mtime_ns, os.stat(info.path).st_ino if local else 0)
            except FileNotFoundError:
                pass  # gone since it was listed
        return out

    @staticmethod
    def _checks(file, offset: int) -> tuple[int, int]:
        return zlib.crc32(ranges.read_range(file, 0, min(HEAD, offset))), zlib.crc32(ranges.read_range(file, max(0, offset - MARK), offset))

    def _step(self, name: str, stamp: tuple[int, int, int], was: dict | None, budget: int) -> dict:
        """Where ``name`` is to be read to now."""
        size, _, inode = stamp
        fs, path = ranges.store(name)
        with fs.open_input_file(path) as file:
            generation, offset = (was["generation"], was["offset"]) if was else (0, 0)
            if was and offset and (size < offset or inode != was["inode"] or self._checks(file, offset) != (was["head"], was["mark"])):
                generation, offset = generation + 1, 0
            limit = min(size, offset + max(budget, 1))
            end = ranges.last_newline(file, offset, limit)
            if end == offset and limit < size:
                end = ranges.next_newline(file, limit, size)
                end = offset if end == limit else end  # one line is longer than the budget
            rest = ranges.read_range(file, end, size) if limit == size and end < size else b""
            settled = (stamp, zlib.crc32(rest)) if rest else None
            if rest and self.seen.get(name) == settled and _is_json(rest):
                end, settled = size, None
            self.seen[name] = settled if rest else (stamp, None)
            head, mark = self._checks(file, end)
        return {"generation": generation, "offset": end, "inode": inode, "head": head, "mark": mark}

    def latestOffset(self) -> dict:
        listed, out, left = self._listing(), dict(self.known), self.most
        names = sorted(listed)
        names = [n for n in names if n > self.turn] + [n for n in names if n <= self.turn]
        for name in names:
            was, stamp = self.known.get(name), listed[name]
            if was and self.seen.get(name) == (stamp, None) and was["offset"] == stamp[0]:
                continue
            if left <= 0:
                break
            try:
                now = self._step(name, stamp, was, left)
            except FileNotFoundError:
                continue
            if now["offset"] or was:
                out[name] = now
            left -= now["offset"] - (was["offset"] if was and was["generation"] == now["generation"] else 0)
            self.turn = name
        for name in self.known.keys() - listed.keys():
            if self.known[name]["inode"] >= 0:
                out[name] = {"generation": self.known[name]["generation"] + 1, "offset": 0, "inode": -1, "head": 0, "mark": 0}
        return out

    # --- batches

    def partitions(self, start: dict, end: dict) -> list[Range]:
        self._plan(end)
        out, room = [Range()], self.split
        for name in sorted(end):
            was, now = start.get(name), end[name]
            if was == now:
                continue
            same = was is not None and was["generation"] == now["generation"]
            if now["generation"] and not same:
                out[-1].opened.append((name, now["generation"]))
            begin = was["offset"] if same else 0
            for low in range(begin, now["offset"], self.split):
                high = min(low + self.split, now["offset"])
                if room < high - low:
                    out.append(Range())
                    room = self.split
                out[-1].parts.append((name, now["generation"], low, high, low > begin))
                room -= high - low
        return [r for r in out if r.parts or r.opened]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        kinds = pa.schema([("file", pa.string()), ("generation", pa.int32()), ("pos", pa.int64()), ("line", pa.string())])
        rows, size = [(name, generation, -1, None) for name, generation in partition.opened], 0

        def batch():
            columns = list(zip(*rows)) or [[]] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, kinds)], schema=kinds)

        for name, generation, begin, end, inside in partition.parts:
            fs, path = ranges.store(name)
            try:
                file = fs.open_input_file(path)
            except FileNotFoundError:
                continue  # gone since: the next trigger voids what was said of it
            with file:
                for pos, line in ranges.lines_between(file, begin, end, inside):
                    if line.strip():
                        rows.append((name, generation, pos, line.decode("utf-8", "replace")))
                        size += len(line) + 64
                    if size >= ranges.PIECE:
                        yield batch()
                        rows, size = [], 0
        yield batch()


def _is_json(data: bytes) -> bool:
    try:
        json.loads(data)
    except ValueError:
        return False
    return True


def grown_lines(spark: SparkSession, path: str, state: str, **options):
    """The stream of ``TailSource``."""
    spark.dataSource.register(TailSource)
    return spark.readStream.format("grown_lines").option("path", path).option("state", state).options(**options).load()
