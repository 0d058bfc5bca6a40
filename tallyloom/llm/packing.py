"""Best-fit packing planned over the histogram of lengths.

Documents are tokenised once into pieces of at most a sequence's length. Best fit runs
over the counts of each length, on the driver, in a table no larger than lengths; it
yields slots: for each length, ranges of ranks with the sequences and the offset they
take. Pieces then find their slot by their rank within their length.
"""

from __future__ import annotations

import base64
import zlib
from bisect import bisect_left, insort
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import blocks, materialise, strings

SEQUENCE = 1024
#: Id that closes each document.
END = 2


@cache
def encoding(ranks_file: str, pattern: str):
    """The byte-level vocabulary as ranks: the same ids as its .json form gives, several times faster."""
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(ranks_file, "rb"))}
    return tiktoken.Encoding("byte_bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={"<|endoftext|>": len(ranks)})


def default_vocabulary() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def cuts(n: int, sequence: int) -> list[tuple[int, int]]:
    """Start and length of the pieces of ``n`` tokens: whole sequences, the first piece takes what is over."""
    first = n % sequence or sequence
    starts = [0, *range(first, n, sequence)]
    return [(a, b - a) for a, b in zip(starts, [*starts[1:], n])]


def pieces(docs: DataFrame, sequence: int = SEQUENCE, vocabulary: tuple[str, str] | None = None, with_ids: bool = False) -> DataFrame:
    """Rows doc_id, piece, start, length, ids_crc32 (and ids) of every document: its tokens, then END."""
    vocabulary = vocabulary or default_vocabulary()

    def run(batches):
        for part in blocks(batches):
            encode = encoding(*vocabulary)
            out = {k: [] for k in ("row", "piece", "start", "length", "crc", "ids")}
            for i, text in enumerate(strings(part.column(1))):
                ids = np.array([*encode.encode(text, allowed_special="all"), END], dtype="<u4")
                for k, (start, length) in enumerate(cuts(len(ids), sequence)):
                    own = ids[start : start + length]
                    for name, x in zip(out, (i, k, start, length, zlib.crc32(own.tobytes()), own.astype(np.int32) if with_ids else None)):
                        out[name].append(x)
            ids = [pa.array(out["ids"], pa.list_(pa.int32()))] if with_ids else []
            yield pa.RecordBatch.from_arrays(
                [part.column(0).take(pa.array(out["row"])), pa.array(out["piece"], pa.int32()), pa.array(out["start"], pa.int64()),
                 pa.array(out["length"], pa.int64()), pa.array(out["crc"], pa.int64()), *ids],
                ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids)


def plan_slots(histogram: dict[int, int], sequence: int = SEQUENCE) -> list[tuple[int, int, int, int, int]]:
    """Best fit, longest first, over counts: (length, first rank, count, first sequence, offset).

    Equal sequences are one entry (first sequence, count) under their free room, so the
    work follows the number of different lengths, not of pieces.
    """
    room: dict[int, list[tuple[int, int]]] = {}
    sizes: list[int] = []  # of free room, ascending
    slots, following = [], 0

    def put(free: int, first: int, count: int) -> None:
        if free:
            if free not in room:
                insort(sizes, free)
            room.setdefault(free, []).append((first, count))

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            at = bisect_left(sizes, length)
            if at < len(sizes):
                free = sizes[at]
                first, count = room[free].pop()
                if not room[free]:
                    del room[free], sizes[at]
                taken = min(left, count)
                slots.append((length, rank, taken, first, sequence - free))
                if count > taken:
                    put(free, first + taken, count - taken)
                put(free - length, first, taken)
                rank, left = rank + taken, left - taken
                continue
            each = min(sequence // length, left)
            fresh = left // each
            for j in range(each):
                slots.append((length, rank, fresh, following, j * length))
                rank += fresh
            put(sequence - each * length, following, fresh)
            following, left = following + fresh, left - fresh * each
    return slots


def pack(docs: DataFrame, sequence: int = SEQUENCE, vocabulary: tuple[str, str] | None = None, rows_per_rank_task: int = 2_000_000) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null text is empty: one piece, the closing id alone. Repeated rows are pieces of their
    own; a null id is kept; an empty table gives no rows; further columns are ignored.
    Ranks are counted within (length, part), with parts enough for ``rows_per_rank_task``
    pieces of one length in a task at all sizes up to 1024 times that.
    """
    spark = docs.sparkSession
    cut = materialise(pieces(docs, sequence, vocabulary), "pieces")
    parts, rows = 16, cut.count()
    while parts < 1024 and parts * rows_per_rank_task < rows:
        parts *= 2
    cut = cut.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(parts)).cast("int"))
    counts = cut.groupBy("length", "part").count().toPandas().sort_values(["length", "part"])  # sequence * parts rows at most
    before = counts.groupby("length")["count"].cumsum() - counts["count"]
    slots = pd.DataFrame(plan_slots({int(k): int(v) for k, v in counts.groupby("length")["count"].sum().items()}, sequence),
                         columns=["length", "first_rank", "n", "first_sequence", "offset"], dtype="int64")
    # both tables are bounded by the sequence length, whatever the number of documents
    offsets = spark.createDataFrame(counts.assign(before=before)[["length", "part", "before"]].astype("int64"), "length long, part long, before long")
    plan = spark.createDataFrame(slots, "length long, first_rank long, n long, first_sequence long, offset long")
    ranked = cut.withColumn("own", F.row_number().over(Window.partitionBy("length", "part").orderBy("doc_id", "piece", "start")) - 1)
    ranked = ranked.join(F.broadcast(offsets), ["length", "part"]).withColumn("rank", F.col("own") + F.col("before"))
    inside = (ranked["length"] == plan["length"]) & (F.col("rank") >= F.col("first_rank")) & (F.col("rank") < F.col("first_rank") + F.col("n"))
    return ranked.join(F.broadcast(plan), inside).select(
        "doc_id", "piece", "start", ranked["length"], "ids_crc32",
        (F.col("first_sequence") + F.col("rank") - F.col("first_rank")).alias("sequence_id"), "offset")


def sequences(docs: DataFrame, packed: DataFrame, sequence: int = SEQUENCE, vocabulary: tuple[str, str] | None = None) -> DataFrame:
    """The packed sequences themselves: sequence_id, ids. At most ``sequence`` ids a group.

    Needs unique ids of documents.
    """
    own = pieces(docs, sequence, vocabulary, with_ids=True).select("doc_id", "piece", "ids")
    return own.join(packed, ["doc_id", "piece"]).groupBy("sequence_id").agg(
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("offset", "ids"))), lambda x: x["ids"])).alias("ids"))
