"""How the tokens of two tokenizers line up on the same bytes.

The texts of a whole Arrow batch are one run of bytes. Ends of A's and of B's tokens are
counted by bincount once for the batch; where both end, a group ends. Prefix sums over
these places, read off at the offsets of the documents, give each document's numbers.
A first pass writes them with the distinct linked id pairs of each document; the
documents of a pair are counted over the corpus, and a second pass over what was
written looks the counts up.
"""

from __future__ import annotations

import base64
import hashlib
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BLOCK_BYTES, blocks, materialise

#: Bytes over which ends are counted at once.
WINDOW = 1 << 20
#: Distinct segments whose ids a task remembers, and id pairs up to which their counts are broadcast (20 bytes each).
REMEMBERED, BROADCAST_PAIRS = 1 << 19, 2_000_000


class Vocabularies:
    """Both tokenizers, the bytes of their tokens, and what they made of segments met before."""

    def __init__(self, ranks_file: str, pattern: str, model_file: str) -> None:
        import sentencepiece
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(ranks_file, "rb"))}
        self.a = tiktoken.Encoding("a", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_file=model_file)
        by_id = {i: t for t, i in ranks.items()}
        self.tokens_a = [by_id.get(i, b"") for i in range(max(by_id) + 1)]
        names = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.tokens_b = [bytes([int(x[3:5], 16)]) if self.b.is_byte(i) else x.replace("▁", " ").encode() for i, x in enumerate(names)]
        self.size_a, self.size_b = (np.array([len(t) for t in x], dtype=np.int64) for x in (self.tokens_a, self.tokens_b))
        # a piece with a space behind a letter could join what a cut before a space sets apart
        self.cuttable = not any("▁" in x.lstrip("▁") for x in names)
        # ids in decimal, with what follows them: , or | behind A's ids, , or ; behind B's
        n_a, n_b = len(self.tokens_a), len(self.tokens_b)
        self.written = pa.array([b"%d%s" % (i, end) for n, ends in ((n_a, (b",", b"|")), (n_b, (b",", b";"))) for end in ends for i in range(n)], pa.large_binary())
        self.forget()

    def forget(self) -> None:
        self.known: dict[bytes, int] = {}
        none = np.zeros(0, dtype=np.int32)
        self.ids, self.sizes = [none, none], [none, none]  # of all segments remembered, one behind the other, and how many each has
        self.same = np.zeros(0, dtype=bool)  # whether both tokenizers give back its bytes

    def encode(self, segments: list[bytes]) -> np.ndarray:
        """Numbers under which the ids of the distinct ``segments`` are remembered; each of these begins with a space."""
        new = [s for s in segments if s not in self.known]
        if len(self.known) + len(new) > REMEMBERED:
            self.forget()
            new = segments
        if new:
            texts = [s.decode("utf-8", "replace") for s in new]
            lists = [self.a.encode_ordinary(t) for t in texts], self.b.encode([t[1:] for t in texts], num_threads=1)
            size = np.fromiter(map(len, new), dtype=np.int64, count=len(new))
            whole, same = b"".join(new), np.ones(len(new), dtype=bool)
            for k, (found, tokens, sizes) in enumerate(zip(lists, (self.tokens_a, self.tokens_b), (self.size_a, self.size_b))):
                n = np.fromiter(map(len, found), dtype=np.int32, count=len(found))
                ids = np.fromiter(chain.from_iterable(found), dtype=np.int32, count=int(n.sum()))
                told = np.bincount(np.repeat(np.arange(len(new)), n), weights=sizes[ids], minlength=len(new)).astype(np.int64)
                if not np.array_equal(told, size) or b"".join(map(tokens.__getitem__, ids.tolist())) != whole:
                    same &= np.fromiter((b"".join(map(tokens.__getitem__, f)) == s for f, s in zip(found, new)), dtype=bool, count=len(new))
                self.ids[k], self.sizes[k] = np.concatenate([self.ids[k], ids]), np.concatenate([self.sizes[k], n])
            self.same = np.concatenate([self.same, same])
            first = len(self.known)
            self.known.update(zip(new, range(first, first + len(new))))
        return np.fromiter(map(self.known.__getitem__, segments), dtype=np.int64, count=len(segments))


@cache
def vocabularies(ranks_file: str, pattern: str, model_file: str) -> Vocabularies:
    return Vocabularies(ranks_file, pattern, model_file)


def default_files() -> tuple[str, str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, public_tokenizers.path("piece_bpe_32k.model")


def cut_places(data: np.ndarray, cuttable: bool) -> np.ndarray:
    """Places inside ``data`` before a lone space between two letters or marks, of which one is ASCII: neither tokenizer joins across them."""
    if not cuttable or len(data) < 3:
        return np.zeros(0, dtype=np.int64)
    before, here, after = data[:-2], data[1:-1], data[2:]
    return np.flatnonzero((here == 32) & (before > 32) & (after > 32) & ((before < 127) | (after < 127))) + 1


def gathered(ids: np.ndarray, sizes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lists numbered ``at`` of those that stand in ``ids`` behind one another, and the length of each."""
    start, n = np.cumsum(sizes, dtype=np.int64) - sizes, sizes[at]
    inside = np.arange(int(n.sum())) - np.repeat(np.cumsum(n, dtype=np.int64) - n, n)
    return ids[np.repeat(start[at], n) + inside], n


def encoded(texts: list[bytes], v: Vocabularies) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ids of A and of B over all texts, how many each text has of them, and the bytes of each text (0 where bytes are not given back).

    The texts are cut into segments, most of them words; each distinct one is encoded once.
    """
    data = b"".join(b" " + t for t in texts if t)
    flat, size = np.frombuffer(data, dtype=np.uint8), np.array([len(t) + 1 if t else 0 for t in texts], dtype=np.int64)
    offset = np.concatenate([[0], np.cumsum(size)])
    cut = np.unique(np.concatenate([offset, cut_places(flat, v.cuttable)]))
    # a text's first byte is a space of ours: no cut is made across two texts but there
    segments = pa.Array.from_buffers(pa.large_binary(), len(cut) - 1, [None, pa.py_buffer(cut.astype(np.int64).tobytes()), pa.py_buffer(data)])
    coded = segments.dictionary_encode()
    place = coded.indices.to_numpy().astype(np.int64)
    numbers = v.encode(coded.dictionary.to_pylist())
    at = numbers[place]
    ids, fine = [gathered(own, sizes, at) for own, sizes in zip(v.ids, v.sizes)], v.same[at]
    row = np.searchsorted(offset, cut[:-1], side="right") - 1
    good = np.bincount(row[~fine], minlength=len(texts)) == 0
    out = []
    kept = good[row]
    for flat_ids, n in ids:
        out.append((flat_ids[np.repeat(kept, n)], np.bincount(row[kept], weights=n[kept], minlength=len(texts)).astype(np.int64)))
    return out[0][0], out[1][0], out[0][1], out[1][1], np.where(good, size, 0)


def end_places(ends_a: np.ndarray, ends_b: np.ndarray, total: int) -> tuple[np.ndarray, np.ndarray]:
    """Places where a token of A or of B ends, and those where both end, counted WINDOW bytes at a time."""
    some, both = [], []
    for w in range(0, total + 1, WINDOW):
        count = [np.bincount(e[np.searchsorted(e, w) : np.searchsorted(e, w + WINDOW)] - w, minlength=WINDOW) for e in (ends_a, ends_b)]
        some.append(np.flatnonzero(count[0] + count[1]) + w)
        both.append(np.flatnonzero(count[0] * count[1]) + w)
    return np.concatenate(some), np.concatenate(both)


def align(texts: list[bytes], v: Vocabularies) -> dict:
    """Of a batch of texts: arrays n_a, n_b, n_groups, n_links and lists groups (hash), pairs, times (distinct links and how often each occurs)."""
    ids_a, ids_b, n_a, n_b, size = encoded(texts, v)
    offset = np.concatenate([[0], np.cumsum(size)])
    ends_a, ends_b = np.cumsum(v.size_a[ids_a]), np.cumsum(v.size_b[ids_b])
    some, both = end_places(ends_a, ends_b, int(offset[-1]))
    # a place where some token ends closes the overlap of one token of A with one of B
    of = lambda places: np.diff(np.searchsorted(places, offset, side="right"))
    n_links, n_groups = of(some), of(both)
    link_a, link_b = ids_a[np.searchsorted(ends_a, some)], ids_b[np.searchsorted(ends_b, some)]
    base = len(v.tokens_b)
    row = np.repeat(np.arange(len(texts)), n_links)
    pairs, times = np.unique((row * len(v.tokens_a) + link_a) * base + link_b, return_counts=True)
    cut = np.searchsorted(pairs, np.arange(len(texts) + 1) * (len(v.tokens_a) * base)).tolist()
    pairs %= len(v.tokens_a) * base
    # a token is written behind all tokens of earlier groups, and B's behind A's of its own group
    group_a, group_b = np.searchsorted(both, ends_a), np.searchsorted(both, ends_b)
    place = np.empty(len(ids_a) + len(ids_b), dtype=np.int64)
    count_a, count_b = np.bincount(group_a, minlength=len(both)), np.bincount(group_b, minlength=len(both))
    until_a, until_b = np.cumsum(count_a), np.cumsum(count_b)
    last_a, last_b = np.isin(np.arange(len(ids_a)), until_a - 1), np.isin(np.arange(len(ids_b)), until_b - 1)
    place[np.arange(len(ids_a)) + (until_b - count_b)[group_a]] = ids_a + np.where(last_a, len(v.tokens_a), 0)
    place[np.arange(len(ids_b)) + until_a[group_b]] = 2 * len(v.tokens_a) + ids_b + np.where(last_b, base, 0)
    token = np.concatenate([[0], np.cumsum(n_a + n_b)]).tolist()
    groups = []
    for p, q in zip(token, token[1:]):
        digest = hashlib.sha256()
        for s in range(p, q, WINDOW):
            part = v.written.take(pa.array(place[s : min(s + WINDOW, q)]))
            text = memoryview(part.buffers()[2])[: part.nbytes and int(np.frombuffer(part.buffers()[1], dtype=np.int64, count=len(part) + 1)[-1])]
            digest.update(text[:-1] if s + WINDOW >= q else text)
        groups.append(digest.hexdigest() if q > p else "")
    return {"n_a": n_a, "n_b": n_b, "n_groups": n_groups, "n_links": n_links, "groups": groups, "pairs": pairs, "times": times, "cut": cut}


def aligned(docs: DataFrame, files: tuple[str, str, str]) -> DataFrame:
    """Rows doc_id, n_a, n_b, n_groups, n_links, groups_sha256, pairs (A id * size of B + B id, ascending), times."""

    def run(batches):
        v = vocabularies(*files)
        for part in blocks(batches, 1, 4 * BLOCK_BYTES):
            x = align([t or b"" for t in part.column(1).cast(pa.binary()).to_pylist()], v)
            lists = lambda values, kind: pa.ListArray.from_arrays(pa.array(x["cut"], pa.int32()), pa.array(values, kind))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), *(pa.array(x[c], pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")), pa.array(x["groups"], pa.string()), lists(x["pairs"], pa.int64()), lists(x["times"], pa.int32())],
                ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<int>")


def pair_counts(per_document: DataFrame, base: int) -> DataFrame:
    """Rows pair, count, best: documents that hold the pair linked, and whether no pair of its A id has more."""
    counts = per_document.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("count"))
    most = counts.groupBy(F.expr(f"pair div {base}").alias("a")).agg(F.max("count").alias("most"))
    return counts.withColumn("a", F.expr(f"pair div {base}")).join(most, "a").select("pair", "count", (F.col("count") == F.col("most")).alias("best"))


def alignment(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", files: tuple[str, str, str] | None = None, broadcast_pairs: int = BROADCAST_PAIRS) -> DataFrame:
    """One row per input row: id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    ``files``: ranks and pattern of A, model of B. Texts that are null or empty, or whose
    tokens do not give back their bytes, have no tokens: zeros and an empty digest. Each
    row is a document, repeated rows and null ids included; among the partners of an A id
    ties are all best; an empty table gives no rows; further columns are ignored. The
    counts of pairs are broadcast while there are at most ``broadcast_pairs`` (their
    number is bounded by the vocabularies, not by the corpus), else joined by shuffling.
    """
    spark = df.sparkSession
    files = files or default_files()
    base = len(vocabularies(*files).tokens_b)
    per = materialise(aligned(df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), files).withColumn("row", F.monotonically_increasing_id()), "aligned")
    counts = materialise(pair_counts(per, base), "pair-counts")
    if counts.count() <= broadcast_pairs:
        table = counts.orderBy("pair").toArrow()
        shared = spark.sparkContext.broadcast(tuple(table.column(c).to_numpy() for c in ("pair", "count", "best")))

        def run(batches):
            known, count, best = shared.value
            for batch in batches:
                pairs, times = batch.column(1), batch.column(2)
                row = pc.list_parent_indices(pairs).to_numpy()
                at = np.searchsorted(known, pc.list_flatten(pairs).to_numpy())
                n = pc.list_flatten(times).to_numpy().astype(np.int64)
                sums = []
                for value in (n * best[at], n * count[at]):
                    out = np.zeros(batch.num_rows, dtype=np.int64)
                    np.add.at(out, row, value)
                    sums.append(pa.array(out))
                yield pa.RecordBatch.from_arrays([batch.column(0), *sums], ["row", "n_best", "count_sum"])

        slim = per.drop("pairs", "times").columns

        def looked_up(batches):
            for batch in batches:
                own = next(run([batch.select(["row", "pairs", "times"])]))
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in slim), own.column(1), own.column(2)], [*slim, "n_best", "count_sum"])

        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in per.schema.fields if f.name in slim)
        out = per.mapInArrow(looked_up, f"{fields}, n_best long, count_sum long")
    else:
        sums = (per.select("row", F.inline(F.arrays_zip(F.col("pairs").alias("pair"), F.col("times").alias("n")))).join(counts, "pair").groupBy("row")
                .agg(F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("count")).alias("count_sum")))
        out = per.join(sums, "row", "left").fillna(0, ["n_best", "count_sum"])
    return out.select(F.col("doc_id").alias(id_col), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def groups(text: str | None, files: tuple[str, str, str] | None = None) -> list[tuple[list[int], list[int]]]:
    """The groups of one text: A's ids and B's ids of each."""
    v = vocabularies(*(files or default_files()))
    ids_a, ids_b, *_ = encoded([(text or "").encode()], v)
    ends_a, ends_b = np.cumsum(v.size_a[ids_a]), np.cumsum(v.size_b[ids_b])
    _, both = end_places(ends_a, ends_b, int(ends_a[-1]) if len(ends_a) else 0)
    a, b = ([0, *np.searchsorted(e, both, side="right").tolist()] for e in (ends_a, ends_b))
    return [(ids_a[p:q].tolist(), ids_b[r:s].tolist()) for p, q, r, s in zip(a, a[1:], b, b[1:])]
