"""What several operators share: scratch tables in the cluster's shared folder,
Arrow batches cut to a bounded size, word hashes, and connected components."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a task takes up at once; a longer text is a block of its own.
BLOCK_BYTES = 1 << 18
#: Bytes, or words, that a vectorised step works on at once, whatever the length of a text.
STEP = 1 << 16


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below ``spark.checkpoint.dir``, which all executors share.

    Where the setting is absent and Spark runs in one process (tests), a temporary folder is set once.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("tallyloom.scratch", None)
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="tallyloom-")
        spark.conf.set("tallyloom.scratch", base)
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


#: Spark's own setting to remove a query's shuffle files when the query ends.
_CLEAN_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage, survives lost executors.

    The shuffle files behind it go once it is written: nothing reads them again.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    before = spark.conf.get(_CLEAN_SHUFFLES, "false")
    spark.conf.set(_CLEAN_SHUFFLES, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEAN_SHUFFLES, before)
    table = spark.read.schema(df.schema).parquet(path)
    table.scratch = path
    return table


def discard(*tables: DataFrame | None) -> None:
    """Delete materialised tables; whatever was derived from them must be written by then."""
    for table in tables:
        if table is None:
            continue
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table.scratch)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Rows of ids up to which a side of a join is broadcast, about 64 MB in memory.
BROADCAST_ROWS = 2_000_000


def small_side(ids: DataFrame, label: str) -> DataFrame:
    """``ids`` written, counted, and marked for broadcast if the count allows it; else it is joined by shuffling."""
    ids = materialise(ids, label)
    side = F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids
    side.scratch = ids.scratch
    return side


def held_out(id_col: str = "doc_id"):
    """True for rows that no model may learn from: crc32 of the id as text, mod 4, is 2."""
    crc = F.crc32(F.col(id_col).cast("string").cast("binary"))
    return F.coalesce(crc % 4 == 2, F.lit(False))


def blocks(batches, column: int = 1, limit: int = BLOCK_BYTES):
    """Slices of the Arrow batches holding about ``limit`` bytes of ``column`` each, one row at least."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        part = np.cumsum(size.astype(np.int64)) // limit
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            if b > a:
                yield batch.slice(a, b - a)


def strings(column) -> list[str]:
    """Python strings, null as empty; bytes that are no UTF-8 become U+FFFD."""
    try:
        return [s or "" for s in column.to_pylist()]
    except UnicodeDecodeError:
        return [(b or b"").decode("utf-8", "replace") for b in column.cast(pa.binary()).to_pylist()]


def text_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all rows joined, with a space after each, and the offsets where rows start (one more than rows)."""
    rows = [b or b"" for b in column.cast(pa.binary()).to_pylist()]
    data = np.frombuffer(b" ".join(rows) + b" ", dtype=np.uint8)
    size = np.fromiter((len(r) + 1 for r in rows), dtype=np.int64, count=len(rows))
    return data, np.concatenate([[0], np.cumsum(size)])


_rng = np.random.Generator(np.random.PCG64(20240607))
_BYTE = _rng.integers(1, 2**63, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix64(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of unsigned 64-bit numbers."""
    h = (h ^ (h >> np.uint64(30))) * _MIX[0]
    h = (h ^ (h >> np.uint64(27))) * _MIX[1]
    return h ^ (h >> np.uint64(31))


def _words(data: np.ndarray, separator: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    gap = separator[data]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], gap]).astype(np.int8)))
    start, end = edge[0::2], edge[1::2]
    if not len(start):
        return start, np.zeros(0, dtype=np.uint64)
    length = end - start
    power = np.cumprod(np.full(int(length.max()), _BASE, dtype=np.uint64))
    keep = np.flatnonzero(~gap)
    first = np.concatenate([[0], np.cumsum(length)[:-1]])
    place = np.arange(len(keep)) - np.repeat(first, length)
    value = _BYTE[_LOWER[data[keep]] if lower else data[keep]] * power[place]
    return start, mix64(np.add.reduceat(value, first) + length.astype(np.uint64))


def stretches(data: np.ndarray, separator: np.ndarray = _SPACE, step: int = STEP):
    """Places (a, b) that cut ``data``, which ends in a separator, into stretches of about ``step`` bytes, each ending in one."""
    a = 0
    while a < len(data):
        b = min(a + step, len(data))
        while not separator[data[b - 1]]:
            ahead = separator[data[b : b + step]]
            b += int(ahead.argmax()) + 1 if ahead.any() else len(ahead)
        yield a, b
        a = b


def word_hashes(data: np.ndarray, separator: np.ndarray = _SPACE, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Start offset and 64-bit hash of each word: a run of bytes outside ``separator``, with A-Z lower-cased or not.

    ``data`` must end in a separator. It is read in stretches, so that what a word needs
    beside its hash is held for STEP bytes, or for one word, at a time.
    """
    starts, hashes = [], []
    for a, b in stretches(data, separator):
        start, own = _words(data[a:b], separator, lower)
        starts.append(start + a)
        hashes.append(own)
    if not starts:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    return np.concatenate(starts), np.concatenate(hashes)


def shingle_weights(k: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(k)).integers(1, 2**63, size=k, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of every window of ``k`` words; with fewer words, one hash of the whole sequence; without words, none."""
    n = len(words)
    if not n:
        return words
    width = min(k, n)
    out = np.full(n - width + 1, np.uint64(width))
    for j, w in enumerate(shingle_weights(k)[:width]):
        out += words[j : n - width + 1 + j] * w
    return mix64(out)


def shingle_set(words: np.ndarray, k: int) -> np.ndarray:
    """The distinct shingle hashes, sorted; made STEP words at a time."""
    last = max(len(words) - k + 1, 1)
    found = [np.unique(shingle_hashes(words[a : a + STEP + k - 1], k)) for a in range(0, last, STEP)]
    return found[0] if len(found) == 1 else np.unique(np.concatenate(found))


def connected_components(edges: DataFrame, label: str = "cc") -> DataFrame:
    """Smallest reachable vertex of each vertex of ``edges`` (columns u, v), as rows (x, l).

    Each round takes the smallest label among the neighbours, then follows it once
    (l(x) becomes l(l(x))), until nothing changes. Every round is a written table, so a
    round that loses an executor is repeated alone; joins read plain tables, so that
    adaptive execution can split a vertex with very many edges. Edges that are null,
    loops and repeats change nothing; without edges there are no rows.
    """
    both = edges.select(F.col("u").alias("x"), F.col("v").alias("y")).where("x is not null and y is not null and x <> y")
    both = materialise(both.union(both.select("y", "x")).distinct(), label)
    labels = materialise(both.groupBy("x").agg(F.least("x", F.min("y")).alias("l")), label)
    while True:
        heard = both.join(labels.select(F.col("x").alias("y"), "l"), "y").select("x", "l")
        step = materialise(
            heard.select("x", "l", F.lit(None).cast(labels.schema["l"].dataType).alias("old"))
            .unionByName(labels.select("x", "l", F.col("l").alias("old")))
            .groupBy("x").agg(F.min("l").alias("l"), F.min("old").alias("old")),
            label,
        )
        far = step.select(F.col("x").alias("l"), F.col("l").alias("ll"))
        done = materialise(step.join(far, "l").select("x", F.least("l", "ll").alias("l"), "old"), label)
        discard(step, labels)
        labels = done.select("x", "l")
        labels.scratch = done.scratch
        if not done.where("l <> old").limit(1).count():
            discard(both)
            return labels
