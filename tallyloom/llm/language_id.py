"""Language identification by rank-order profiles.

A language's profile is its most frequent character n-grams in rank order; a document
gets the language whose profile its own ranking is least out of place with.
"""

from __future__ import annotations

import re
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import STEP, blocks, discard, held_out, materialise, strings

#: n-grams in a profile and in a document's ranking.
PROFILE_SIZE = 300
#: Documents per language that profiles are learned from, about (hash-sampled when there are more).
TRAIN_ROWS = 2000
_BLANK = re.compile(r"\s")


@cache
def letters() -> np.ndarray:
    """Which code points are letters."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)


def parts_of(text: str, limit: int = STEP):
    """The text in parts of about ``limit`` characters, cut before blanks, where no n-gram crosses and lower-casing needs no context."""
    at = 0
    while len(text) - at > limit:
        cut = _BLANK.search(text, at + limit)
        if cut is None:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:] if at else text


def gram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct 1- to 3-grams of the lower-cased words (each packed into 63 bits) and their counts.

    Letters only; words are padded by one blank on either side; no n-gram spans two words.
    """
    grams, counts = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    for part in parts_of(text):
        found, n = _grams(part)
        if not len(grams):
            grams, counts = found, n
            continue
        grams, at = np.unique(np.concatenate([grams, found]), return_inverse=True)
        counts = np.bincount(at, weights=np.concatenate([counts, n]), minlength=len(grams)).astype(np.int64)
    return grams, counts


def _grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), dtype="<u4")
    letter = letters()[points]
    c = np.concatenate([[32], np.where(letter, points, 32), [32]]).astype(np.int64)
    blank = c == 32
    c = c[np.concatenate([[True], ~(blank[1:] & blank[:-1])])]
    inner = c != 32
    two = (c[:-1] << 21) | c[1:]
    three = ((c[:-2] << 42) | (c[1:-1] << 21) | c[2:])[inner[1:-1]]
    # a text without letters is a lone blank, which has no n-gram
    return np.unique(np.concatenate([c[inner], two[inner[:-1] | inner[1:]], three]), return_counts=True)


def ranking(grams: np.ndarray, counts: np.ndarray, size: int = PROFILE_SIZE) -> np.ndarray:
    """The ``size`` most frequent n-grams, most frequent first, ties by value."""
    if len(counts) > size:
        near = np.flatnonzero(counts >= np.partition(counts, -size)[-size])
        grams, counts = grams[near], counts[near]
    return grams[np.argsort(-counts, kind="stable")[:size]]


def learn_profiles(docs: DataFrame, size: int = PROFILE_SIZE, train_rows: int = TRAIN_ROWS) -> dict[str, list[int]]:
    """Profiles by language of the rows with a language that are not held out.

    n-grams are counted in tasks and summed by Spark; what reaches the driver is
    ``size`` n-grams a language.
    """
    rows = docs.where(F.col("lang").isNotNull() & ~held_out())
    per = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}  # one row a language
    if not per:
        return {}
    share = F.create_map(*[x for k, n in per.items() for x in (F.lit(k), F.lit(min(1.0, train_rows / n)))])
    chosen = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) < share[F.col("lang")] * 1_000_003)

    def count(batches):
        total: dict[str, dict[int, int]] = {}
        for part in blocks(batches):
            for lang, text in zip(part.column(0).to_pylist(), strings(part.column(1))):
                mine = total.setdefault(lang, {})
                for g, n in zip(*(x.tolist() for x in gram_counts(text))):
                    mine[g] = mine.get(g, 0) + n
        for lang, mine in total.items():
            yield pa.RecordBatch.from_pydict({"lang": [lang] * len(mine), "gram": list(mine), "n": list(mine.values())},
                                             schema=pa.schema([("lang", pa.string()), ("gram", pa.int64()), ("n", pa.int64())]))

    counted = materialise(
        chosen.select("lang", "text").mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")),
        "grams")
    profiles = {
        lang: [r["gram"] for r in counted.where(F.col("lang") == lang).orderBy(F.desc("n"), "gram").limit(size).collect()]
        for lang in sorted(per)
    }
    discard(counted)
    return profiles


def language_id(docs: DataFrame, profiles: dict[str, list[int]] | None = None, size: int = PROFILE_SIZE, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score.

    Profiles not given are learned from about ``train_rows`` rows a language, chosen by hash.

    ``score`` is 1 less the out-of-place distance as a share of the largest possible.
    Ties between languages go to the first in order of name. Null and empty texts, texts
    without a letter, and all texts if nothing could be learned, are ``und`` with score
    0; a null id is not held out; repeated rows are judged alike; an empty table gives
    no rows; further columns are ignored.
    """
    profiles = learn_profiles(docs, size, train_rows) if profiles is None else profiles
    names = sorted(profiles)
    known = np.unique(np.concatenate([np.asarray(profiles[n], dtype=np.int64) for n in names])) if names else np.zeros(0, dtype=np.int64)
    place = np.full((len(known), len(names)), -1, dtype=np.int32)
    for j, n in enumerate(names):
        place[np.searchsorted(known, profiles[n]), j] = np.arange(len(profiles[n]))

    def judge(text: str) -> tuple[str, float]:
        grams, counts = gram_counts(text)
        top = ranking(grams, counts, size)
        if not len(grams) or not len(known):
            return "und", 0.0
        at = np.minimum(np.searchsorted(known, top), len(known) - 1)
        ranks = np.where((known[at] == top)[:, None], place[at], -1)
        away = np.where(ranks < 0, size, np.abs(ranks - np.arange(len(top))[:, None])).sum(axis=0)
        best = int(away.argmin())
        return names[best], float(1 - away[best] / (size * len(top)))

    def run(batches):
        for part in blocks(batches):
            found = [judge(t) for t in strings(part.column(1))]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64()), part.column(2)],
                ["doc_id", "lang_pred", "score", "held_out"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", held_out().alias("held_out")).mapInArrow(
        run, f"doc_id {kind}, lang_pred string, score double, held_out boolean"
    ).select("doc_id", "held_out", "lang_pred", "score")
