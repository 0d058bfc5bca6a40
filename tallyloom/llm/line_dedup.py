"""Lines that many documents repeat, found with two Bloom filters.

Tasks hash the lines of their documents; the hashes are dealt to shards, and each shard
fills one filter with the hashes met once and a second one with those met again. A
line is a suspect if the second filter knows it. Only suspects are shuffled, as whole
text, to confirm them exactly and to choose the document that keeps them. All other
lines stay where they are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, blocks, materialise, mix64

#: What is stripped from a line's ends: U+0020 and U+0009 to U+000D.
BLANKS = b" \t\n\x0b\x0c\r"
#: Bits of filter for each line that a corpus of its size could hold at most, and bits set a line.
BITS_A_LINE, PROBES = 10, 4
#: Hashes that a task gathers before it deals them out.
FLUSH = 1 << 20
#: Bytes of the second filter that are broadcast; a larger one is asked by shuffled requests.
BROADCAST_BYTES = 64 << 20
#: The second filter is folded in half while at most this share of its bits is set.
DENSITY = 0.25


def key_of(line: bytes) -> bytes:
    """The line without blanks at its ends, A-Z lower-cased."""
    return line.strip(BLANKS).lower()


def long_enough(key: bytes, least_chars: int) -> bool:
    """Whether ``key`` has ``least_chars`` code points."""
    return len(key) >= least_chars and (len(key) >= 4 * least_chars or len(key.decode("utf-8", "replace")) >= least_chars)


def keys_of(text: bytes | None, least_chars: int) -> list[tuple[int, bytes]]:
    """Number and key of each line of a text that is long enough to count."""
    found = ((i, key_of(line)) for i, line in enumerate((text or b"").split(b"\n")))
    return [(i, k) for i, k in found if long_enough(k, least_chars)]


def hashes_of(keys: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, keys), dtype=np.uint64, count=len(keys))


class Layout:
    """Where a hash's bits lie: one of ``shards`` filters of ``bits`` bits each, ``bits`` a power of two."""

    def __init__(self, lines: int, most_shards: int = 4096, least_bits: int = 1 << 20, most_bits: int = 1 << 27) -> None:
        self.bits = least_bits
        while self.bits < most_bits and lines * BITS_A_LINE > self.bits * most_shards:
            self.bits *= 2
        self.shards = -(-lines * BITS_A_LINE // self.bits) or 1

    def shard(self, hashes: np.ndarray) -> np.ndarray:
        return (hashes % np.uint64(self.shards)).astype(np.int64)

    def places(self, hashes: np.ndarray) -> np.ndarray:
        """Bits of each hash within its shard, a row a hash."""
        mixed = mix64(hashes)
        step = (mixed >> np.uint64(32)) | np.uint64(1)
        return ((mixed[:, None] + np.arange(PROBES, dtype=np.uint64) * step[:, None]) & np.uint64(self.bits - 1)).astype(np.int64)


def sightings(docs: DataFrame, layout: Layout, least_chars: int) -> DataFrame:
    """Rows shard, again, hashes: what the tasks met, each hash once a flush; ``again`` where two documents of one flush hold it."""

    def deal(gathered):
        hashes, n = np.unique(np.concatenate(gathered), return_counts=True)
        own, again = layout.shard(hashes), n > 1
        order = np.lexsort((own, again))
        hashes, own, again = hashes[order], own[order], again[order]
        cut = np.flatnonzero(np.diff(own) | np.diff(again.astype(np.int8))) + 1
        starts = np.concatenate([[0], cut]).astype(np.int64)
        parts = [x.tobytes() for x in np.split(hashes, cut)]
        return pa.RecordBatch.from_arrays([pa.array(own[starts], pa.int32()), pa.array(again[starts]), pa.array(parts, pa.binary())], ["shard", "again", "hashes"])

    def run(batches):
        gathered, held = [], 0
        for part in blocks(batches, 0):
            for text in part.column(0).cast(pa.binary()).to_pylist():
                own = np.unique(hashes_of([k for _, k in keys_of(text, least_chars)]))
                if len(own):
                    gathered.append(own)
                    held += len(own)
                if held >= FLUSH:
                    yield deal(gathered)
                    gathered, held = [], 0
        if gathered:
            yield deal(gathered)

    return docs.select("text").mapInArrow(run, "shard int, again boolean, hashes binary")


def seen_twice(seen: DataFrame, layout: Layout) -> DataFrame:
    """Rows shard, bits, ones: the second filter of every shard. A task holds the two filters of one shard at a time."""

    def run(batches):
        shard, once, twice = None, np.zeros(layout.bits, dtype=bool), np.zeros(layout.bits, dtype=bool)

        def filled():
            packed = np.packbits(twice, bitorder="little").tobytes()
            return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([packed], pa.binary()), pa.array([int(twice.sum())], pa.int64())], ["shard", "bits", "ones"])

        for batch in batches:
            for own, again, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                if own != shard:
                    if shard is not None:
                        yield filled()
                    shard = own
                    once[:] = twice[:] = False
                at = layout.places(np.frombuffer(raw.as_buffer(), dtype=np.uint64))
                twice[at if again else at[once[at].all(axis=1)]] = True
                once[at] = True
        if shard is not None:
            yield filled()

    return seen.repartition("shard").sortWithinPartitions("shard").mapInArrow(run, "shard int, bits binary, ones long")


SUSPECT = "no int, key binary"


def suspects_by_broadcast(docs: DataFrame, filters: DataFrame, layout: Layout, least_chars: int, folds: int) -> DataFrame:
    """Rows doc_id, h, no, key of the lines that the second filter knows; the folded filter is broadcast."""
    width = layout.bits >> folds

    def fold(batches):
        for batch in batches:
            small = [np.bitwise_or.reduce(np.frombuffer(b.as_buffer(), dtype=np.uint8).reshape(-1, width // 8)).tobytes() for b in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(small, pa.binary())], ["shard", "bits"])

    table = np.zeros((layout.shards, width // 8), dtype=np.uint8)
    for batch in filters.select("shard", "bits").mapInArrow(fold, "shard int, bits binary").toArrow().to_batches():
        for shard, bits in zip(batch.column(0).to_pylist(), batch.column(1)):
            table[shard] = np.frombuffer(bits.as_buffer(), dtype=np.uint8)
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def run(batches):
        known = shared.value
        for part in blocks(batches, 2):
            rows, numbers, keys = [], [], []
            for i, text in enumerate(part.column(2).cast(pa.binary()).to_pylist()):
                for no, key in keys_of(text, least_chars):
                    rows.append(i)
                    numbers.append(no)
                    keys.append(key)
            hashes = hashes_of(keys)
            at = layout.places(hashes) & (width - 1)
            hit = np.flatnonzero(((known[layout.shard(hashes)[:, None], at >> 3] >> (at & 7).astype(np.uint8)) & 1).all(axis=1))
            take = pa.array(np.asarray(rows, dtype=np.int64)[hit])
            yield pa.RecordBatch.from_arrays(
                [part.column(0).take(take), part.column(1).take(take), pa.array(np.asarray(numbers, dtype=np.int32)[hit]), pa.array([keys[i] for i in hit.tolist()], pa.binary())],
                ["doc_id", "h", "no", "key"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "h", "text").mapInArrow(run, f"doc_id {kind}, h long, {SUSPECT}")


def suspects_by_requests(docs: DataFrame, filters: DataFrame, layout: Layout, least_chars: int) -> DataFrame:
    """The same rows where the filter is too large to broadcast.

    Each document asks the shards of its lines; a shard's filter sorts before its
    requests, so a task holds one filter and streams the requests by. Answers go back to
    their documents by a join.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def ask(batches):
        for part in blocks(batches, 2):
            rows, shards, hashes, numbers = [], [], [], []
            for i, text in enumerate(part.column(2).cast(pa.binary()).to_pylist()):
                found = keys_of(text, least_chars)
                own = hashes_of([k for _, k in found])
                at, no = layout.shard(own), np.array([n for n, _ in found], dtype=np.int32)
                for shard in np.unique(at).tolist():
                    rows.append(i)
                    shards.append(shard)
                    hashes.append(own[at == shard].tobytes())
                    numbers.append(no[at == shard])
            take = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(shards, pa.int32()), part.column(0).take(take), part.column(1).take(take), pa.array(hashes, pa.binary()), pa.array(numbers, pa.list_(pa.int32()))],
                ["shard", "doc_id", "h", "bits", "numbers"])

    def answer(batches):
        shard, known = None, None
        for batch in batches:
            hits, out = [], []
            for i, (own, ask_, raw, no) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("shard", "request", "bits", "numbers")))):
                if not ask_:
                    shard, known = own, np.frombuffer(raw, dtype=np.uint8)
                elif own == shard:
                    at = layout.places(np.frombuffer(raw, dtype=np.uint64))
                    hit = ((known[at >> 3] >> (at & 7).astype(np.uint8)) & 1).all(axis=1)
                    if hit.any():
                        hits.append(i)
                        out.append(np.array(no, dtype=np.int32)[hit])
            take = pa.array(hits, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(take), batch.column("h").take(take), pa.array(out, pa.list_(pa.int32()))], ["doc_id", "h", "numbers"])

    def keys(batches):
        for part in blocks(batches, 2):
            rows, numbers, found = [], [], []
            for i, (text, asked) in enumerate(zip(part.column(2).cast(pa.binary()).to_pylist(), part.column(3).to_pylist())):
                asked = set(asked)
                for no, key in keys_of(text, least_chars):
                    if no in asked:
                        rows.append(i)
                        numbers.append(no)
                        found.append(key)
            take = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([part.column(0).take(take), part.column(1).take(take), pa.array(numbers, pa.int32()), pa.array(found, pa.binary())], ["doc_id", "h", "no", "key"])

    asked = docs.select("doc_id", "h", "text").mapInArrow(ask, f"shard int, doc_id {kind}, h long, bits binary, numbers array<int>").withColumn("request", F.lit(True))
    held = filters.select("shard", "bits", F.lit(False).alias("request"))
    met = (held.unionByName(asked, allowMissingColumns=True).repartition("shard").sortWithinPartitions("shard", "request")
           .mapInArrow(answer, f"doc_id {kind}, h long, numbers array<int>"))
    # equal texts under one id ask alike: their answers are one set
    back = met.groupBy(F.col("doc_id").alias("at"), F.col("h").alias("hh")).agg(F.array_distinct(F.flatten(F.collect_set("numbers"))).alias("numbers"))
    return docs.join(back, F.col("doc_id").eqNullSafe(F.col("at")) & (F.col("h") == F.col("hh"))).select("doc_id", "h", "text", "numbers").mapInArrow(keys, f"doc_id {kind}, h long, {SUSPECT}")


def line_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = 20, least_docs: int = 3, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """One row per input row: id, text (what is left of it), n_lines (before), n_dropped.

    A line's key is the line stripped of blanks at its ends, A-Z lower-cased. Keys of
    ``least_chars`` code points or more that ``least_docs`` documents or more hold lose
    their lines in all documents but the one with the largest id, where every occurrence
    stays. Rows of one id are one document. Null text is empty text, which is one empty
    line; a null id is a document of its own, smaller than all others; an empty table gives
    no rows; further columns are ignored. The filters only choose what is compared: their
    size changes how many lines are shuffled, never the result.
    """
    spark = df.sparkSession
    docs = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).withColumn("h", F.xxhash64("text"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    layout = Layout(size // least_chars + 1)
    filters = materialise(seen_twice(sightings(docs, layout, least_chars), layout), "seen-twice")
    ones, folds = filters.agg(F.sum("ones")).first()[0] or 0, 0
    while (ones << (folds + 1)) <= DENSITY * layout.shards * layout.bits and layout.bits >> (folds + 1) >= 64:
        folds += 1
    if layout.shards * layout.bits >> (folds + 3) <= broadcast_bytes:
        suspects = suspects_by_broadcast(docs, filters, layout, least_chars, folds)
    else:
        suspects = suspects_by_requests(docs, filters, layout, least_chars)
    confirmed = suspects.groupBy("key", "doc_id").agg(F.lit(1).alias("one")).groupBy("key").agg(F.count("one").alias("n"), F.max("doc_id").alias("last")).where(F.col("n") >= least_docs)
    lost = suspects.join(confirmed, "key").where("doc_id is null or doc_id < last").groupBy("doc_id", "h").agg(F.collect_set("no").alias("lost"))
    lost = materialise(lost.withColumnsRenamed({"doc_id": "at", "h": "hh"}), "lines-lost")
    rows, numbers = lost.agg(F.count("*"), F.sum(F.size("lost"))).first()
    if rows + (numbers or 0) // 4 <= BROADCAST_ROWS:
        lost = F.broadcast(lost)

    def apply(batches):
        for part in blocks(batches, 1):
            texts, before, dropped = [], [], []
            for text, gone in zip(part.column(1).cast(pa.binary()).to_pylist(), part.column(2).to_pylist()):
                lines, gone = (text or b"").split(b"\n"), set(gone or ())
                texts.append(b"\n".join(x for i, x in enumerate(lines) if i not in gone) if gone else text or b"")
                before.append(len(lines))
                dropped.append(len(gone))
            kept = pa.array(texts, pa.binary())
            yield pa.RecordBatch.from_arrays([part.column(0), kept.cast(pa.string(), safe=False) if part.column(1).type == pa.string() else kept.cast(pa.large_string(), safe=False), pa.array(before, pa.int64()), pa.array(dropped, pa.int64())], [id_col, "text", "n_lines", "n_dropped"])

    kind = df.schema[id_col].dataType.simpleString()
    joined = docs.join(lost, F.col("doc_id").eqNullSafe(F.col("at")) & (F.col("h") == F.col("hh")), "left")
    return joined.select("doc_id", "text", "lost").mapInArrow(apply, f"`{id_col}` {kind}, text string, n_lines long, n_dropped long")


ORACLE = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS no FROM documents
), k AS (
  SELECT doc_id, no, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l
), r AS (
  SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), m AS (
  SELECT k.doc_id, k.no, k.line, coalesce(k.doc_id < r.last, false) AS gone FROM k LEFT JOIN r ON k.key = r.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY no) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
