"""Benchmark decontamination by spaced seeds.

Fixed masks choose some words of a window and ignore the others. Windows of benchmark
items and of documents meet on the hash of the chosen words. Meetings with enough equal
words nearby are then compared word by word, allowing substitutions.

No overlap that counts is without a meeting. One of 26 words or more has a part of 13 to
25 words that counts too, and in a stretch of n words with n // 5 substitutions the
longest equal run has four words at least, except where 10, 11 or 15 words are cut into
runs of three (and one of two), which the second mask finds.
"""

from __future__ import annotations

import re
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, mix64, shingle_weights, strings, word_hashes

#: Words chosen (1) and ignored (0) in a window.
MASKS = ("1111", "111011")
#: An overlap counts from so many words on (a shorter item: all of it), with so large a share equal.
OVERLAP_WORDS, EQUAL_SHARE = 13, 0.8
#: Items of fewer words are no evidence and never match.
LEAST_WORDS = 8
#: Bytes of benchmark text in one pass; a larger benchmark takes more passes, each with a bounded broadcast.
PASS_BYTES = 8 << 20
#: An overlap that counts has a part of so many words at most that counts too.
PART_WORDS = 2 * OVERLAP_WORDS - 1
#: Meetings that are looked at together.
MEETINGS = 1 << 13

#: Words are runs of ASCII letters and digits and of non-ASCII characters that are no punctuation or blanks.
_SEPARATOR = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
_MARKS = re.compile("[\u0080-©«-´¶-¹»-¿ -⁯　-〃〈-〠]")


def words_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts, and where each text's words start (one more than texts)."""
    rows = [(t.lower() if t.isascii() else _MARKS.sub(" ", t.lower())).encode("utf-8", "replace") for t in texts]
    data = np.frombuffer(b" ".join(rows) + b" ", dtype=np.uint8)
    start, words = word_hashes(data, _SEPARATOR)
    begins = np.cumsum([0, *(len(r) + 1 for r in rows)])
    return words, np.searchsorted(start, begins)


def seeds(words: np.ndarray, mask: list[int]) -> np.ndarray:
    n = max(len(words) - mask[-1], 0)  # texts shorter than the window have no seed
    out = np.full(n, np.uint64(hash(tuple(mask)) & 0x7FFFFFFF))
    for w, j in zip(shingle_weights(len(mask)), mask):
        out += words[j : n + j] * w
    return mix64(out)


def longest_overlap(item: np.ndarray, words: np.ndarray, shift: int, share: float, least: int) -> tuple[int, int, int] | None:
    """First item word, length and equal words of the longest stretch with item word i beside document word i + shift.

    It has ``least`` words or more, of which ``share`` or more are equal; of equally long
    ones it is that with the most equal words, then the first. None if there is none.
    """
    low, high = max(0, -shift), min(len(item), len(words) - shift)
    if high - low < least:
        return None
    count = np.concatenate([[0], np.cumsum(item[low:high] == words[low + shift : high + shift])])
    gain = count - share * np.arange(len(count))
    # the stretch up to j begins at the first place whose gain is no larger; a slack of 1e-9 covers rounding
    first = np.searchsorted(-np.minimum.accumulate(gain), -gain - 1e-9)
    n = int((np.arange(len(count)) - first).max())
    if n < least:
        return None
    equal = np.where(gain[n:] >= gain[:-n] - 1e-9, count[n:] - count[:-n], -1)
    a = int(equal.argmax())
    return low + a, n, int(equal[a])


class Benchmark:
    """The seeds of some items, sorted, and their words."""

    def __init__(self, ids: list, texts: list[str]):
        words, cut = words_of(texts)
        self.ids = ids
        self.items = [words[a:b] for a, b in zip(cut, cut[1:])]
        self.masks = [[i for i, x in enumerate(m) if x == "1"] for m in MASKS]
        self.words, self.cut = words, cut
        #: Words that an overlap has at least, and how many of them are equal.
        self.least = np.minimum(np.diff(cut), OVERLAP_WORDS)
        self.need = np.ceil(EQUAL_SHARE * self.least - 1e-9).astype(np.int64)
        hashes, of, at = [], [], []
        for i, own in enumerate(self.items):
            if len(own) >= LEAST_WORDS:
                for mask in self.masks:
                    found = seeds(own, mask)
                    hashes.append(found)
                    of.append(np.full(len(found), i))
                    at.append(np.arange(len(found)))
        self.hashes = np.concatenate(hashes) if hashes else np.zeros(0, dtype=np.uint64)
        order = np.argsort(self.hashes, kind="stable")
        self.hashes = self.hashes[order]
        self.of = np.concatenate(of)[order] if of else order
        self.at = np.concatenate(at)[order] if at else order
        self.bits = np.zeros(1 << 22, dtype=bool)
        self.bits[self.hashes >> np.uint64(42)] = True

    def meetings(self, words: np.ndarray, cut: np.ndarray):
        """Arrays (row, item, shift) of meetings that have enough equal words around them for an overlap, MEETINGS at most at once."""
        around = np.arange(len(MASKS[0]) - PART_WORDS, PART_WORDS)  # wherever in a part of an overlap the meeting is
        for mask in self.masks:
            found = seeds(words, mask)
            at = np.flatnonzero(self.bits[found >> np.uint64(42)])
            low, high = np.searchsorted(self.hashes, found[at], "left"), np.searchsorted(self.hashes, found[at], "right")
            row = np.searchsorted(cut, at, "right") - 1
            hit = (low < high) & (at + mask[-1] < cut[row + 1])  # no window that runs into the next text
            at, low, high, row = at[hit], low[hit], high[hit], row[hit]
            ends = np.cumsum(high - low)
            for a in range(0, int(ends[-1]) if len(ends) else 0, MEETINGS):
                every = np.arange(a, min(a + MEETINGS, int(ends[-1])))
                of = np.searchsorted(ends, every, "right")
                k = high[of] - (ends[of] - every)
                item, own, p, r = self.of[k], self.at[k], at[of], row[of]
                i, j = (self.cut[item] + own)[:, None] + around, p[:, None] + around
                inside = (i >= self.cut[item][:, None]) & (i < self.cut[item + 1][:, None]) & (j >= cut[r][:, None]) & (j < cut[r + 1][:, None])
                equal = self.words[np.clip(i, 0, len(self.words) - 1)] == words[np.clip(j, 0, len(words) - 1)]
                enough = (equal & inside).sum(axis=1) >= self.need[item]
                yield r[enough], item[enough], (p - cut[r] - own)[enough]

    def leaks(self, texts: list[str]):
        """(row, item, document word, item word, overlap, equal words), the longest for each row and item."""
        words, cut = words_of(texts)
        tried = set()
        best: dict[tuple[int, int], tuple] = {}
        for met in self.meetings(words, cut):
            for row, item, shift in set(zip(*(x.tolist() for x in met))) - tried:
                tried.add((row, item, shift))
                found = longest_overlap(self.items[item], words[cut[row] : cut[row + 1]], shift, EQUAL_SHARE, int(self.least[item]))
                if found:
                    a, n, equal = found
                    best[row, item] = max(best.get((row, item), (0,)), (n, equal, -(a + shift), -a))
        for (row, item), (n, equal, d, a) in sorted(best.items()):
            yield row, item, -d, -a, n, equal


def passes(benchmark: DataFrame):
    """The benchmark in parts of about PASS_BYTES, each collected and broadcast alone."""
    size = benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = 1 + size // PASS_BYTES
    part = benchmark.where("text is not null").select("item_id", "text", F.pmod(F.xxhash64("item_id", "text"), F.lit(n)).alias("part"))
    for i in range(n):
        rows = part.where(F.col("part") == i).collect()  # about PASS_BYTES of text
        if rows:
            yield benchmark.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, [r["item_id"] for r in rows], [r["text"] for r in rows]))


_built: dict[str, Benchmark] = {}


def _benchmark(shared) -> Benchmark:
    """Seeds are computed once in each worker; the part's name keeps two benchmarks apart."""
    name, ids, texts = shared.value
    if name not in _built:
        _built.clear()
        _built[name] = Benchmark(ids, texts)
    return _built[name]


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per leak: doc_id, item_id, doc_word, item_word, overlap_words, equal_words.

    The longest overlap of a document and an item, which may end in substitutions; word
    numbers count from 0. Documents without a leak have no row. Null and empty texts never
    match; an item of fewer than LEAST_WORDS words neither; repeated rows give repeated
    leaks, equally long overlaps that with the most equal words, then the earliest; empty tables give no rows; further columns are ignored. No shuffle.
    """
    kinds = docs.schema["doc_id"].dataType.simpleString(), benchmark.schema["item_id"].dataType.simpleString()
    schema = f"doc_id {kinds[0]}, item_id {kinds[1]}, doc_word int, item_word int, overlap_words int, equal_words int"
    out = None
    for shared in passes(benchmark):

        def run(batches, shared=shared):
            known = _benchmark(shared)
            for part in blocks(batches):
                if found := list(known.leaks(strings(part.column(1)))):
                    rows, items, *rest = zip(*found)
                    item_type = pa.array(known.ids).type
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0).take(pa.array(rows)), pa.array([known.ids[i] for i in items], item_type), *(pa.array(x, pa.int32()) for x in rest)],
                        ["doc_id", "item_id", "doc_word", "item_word", "overlap_words", "equal_words"])

        found = docs.select("doc_id", "text").mapInArrow(run, schema)
        out = found if out is None else out.unionByName(found)
    return docs.sparkSession.createDataFrame([], schema) if out is None else out


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the rows that hold a leak. Narrow: each part of the benchmark filters in its own pass over the tasks' rows."""
    at = docs.columns.index("text")
    schema = docs.schema
    for shared in passes(benchmark):

        def run(batches, shared=shared):
            known = _benchmark(shared)
            for part in blocks(batches, at):
                keep = np.ones(part.num_rows, dtype=bool)
                for row, *_ in known.leaks(strings(part.column(at))):
                    keep[row] = False
                yield part.filter(pa.array(keep))

        docs = docs.mapInArrow(run, schema)
    return docs
