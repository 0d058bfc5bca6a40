"""Quality classifier: supervised subword embeddings.

A document is the mean of learned vectors of its hashed words, character n-grams and
word pairs; a softmax over it gives the label. Trained by stochastic gradient descent
in numpy on a bounded sample of labelled rows, applied to every row in tasks.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, held_out, mix64, stretches, text_bytes, word_hashes, _SPACE

#: Labelled rows a class that the model is fitted on, about (hash-sampled when there are more).
TRAIN_ROWS = 1500
BUCKETS, WIDTH, RATE = 1 << 17, 8, 0.15
#: Steps of gradient descent, about: few examples are seen more often, at most MOST_EPOCHS times.
STEPS, MOST_EPOCHS = 18_000, 40
THRESHOLD = 0.7


def features(data: np.ndarray, offsets: np.ndarray):
    """Arrays (feature numbers, row of each), one pair for each stretch of the joined rows.

    Words; 3- and 4-grams of the characters' bytes, blanks included; pairs of neighbouring
    words; and one feature for every word that stands twice in a row. No feature spans two rows.
    """
    odd, shift = np.uint64(0x9E3779B97F4A7C15), np.uint64(64 - 17)
    last_word, last_row = np.zeros(0, dtype=np.uint64), -1
    for at, to in stretches(data):
        start, words = word_hashes(data[at:to], lower=False)
        row_of_word = np.searchsorted(offsets, start + at, side="right") - 1
        w = np.concatenate([last_word, words])
        r = np.concatenate([[last_row] * len(last_word), row_of_word]).astype(np.int64)
        beside = r[1:] == r[:-1]
        pairs = mix64(w[:-1] * odd + w[1:])[beside] >> shift
        same = beside & (w[1:] == w[:-1])
        last_word, last_row = w[-1:], int(r[-1]) if len(r) else -1
        b = np.where(_SPACE[data[at : to + 3]], 32, data[at : to + 3]).astype(np.uint64)
        row_of_byte = np.searchsorted(offsets, np.arange(at, at + len(b)), side="right") - 1
        n3, n4 = min(to - at, len(b) - 2), min(to - at, len(b) - 3)
        grams, owners = [], []
        for n, k in ((n3, 3), (n4, 4)):
            if n > 0:
                g = np.full(n, np.uint64(1 << (37 + k)))
                for j in range(k):
                    g |= b[j : n + j] << np.uint64(8 * j)
                inside = row_of_byte[:n] == row_of_byte[k - 1 : n + k - 1]
                grams.append(((g * odd) >> shift)[inside])
                owners.append(row_of_byte[:n][inside])
        ids = np.concatenate([mix64(words) >> shift, pairs, np.full(int(same.sum()), 1, dtype=np.uint64), *grams]).astype(np.int64)
        yield ids, np.concatenate([row_of_word, r[1:][beside], r[1:][same], *owners])


def counted(found) -> tuple[np.ndarray, np.ndarray]:
    """Distinct row * BUCKETS + feature, ascending, and how often each occurs."""
    keys, counts = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    for ids, rows in found:
        more, n = np.unique(rows * BUCKETS + ids, return_counts=True)
        keys, at = np.unique(np.concatenate([keys, more]), return_inverse=True)
        counts = np.bincount(at, weights=np.concatenate([counts, n]), minlength=len(keys)).astype(np.int64)
    return keys, counts


@dataclass
class Model:
    vectors: np.ndarray  # a vector a bucket
    out: np.ndarray  # softmax weights by class
    bias: np.ndarray

    def slopes(self) -> np.ndarray:
        """What a bucket adds to the log odds of label 1: the mean of vectors is linear, so scoring needs one number a bucket."""
        return (self.vectors @ (self.out[1] - self.out[0])).astype(np.float32)


def fit(examples: list[tuple[np.ndarray, np.ndarray, int]], priors: tuple[float, float], seed: int = 11) -> Model:
    """``examples``: distinct features, counts and label; ``priors``: how often each label occurs among all labelled rows."""
    rng = np.random.default_rng(seed)
    vectors = rng.normal(0, 0.1, (BUCKETS, WIDTH))
    out = rng.normal(0, 0.1, (2, WIDTH))
    bias = np.zeros(2)
    seen = np.full(BUCKETS, 1e-6)
    seen_out = 1e-6
    share = np.bincount([y for *_, y in examples], minlength=2) / max(len(examples), 1)
    epochs = min(MOST_EPOCHS, max(1, round(STEPS / max(len(examples), 1))))
    for epoch in range(epochs):
        rate = RATE * (1 - epoch / epochs)
        for i in rng.permutation(len(examples)):
            ids, counts, y = examples[i]
            if not len(ids):
                continue
            w = counts / counts.sum()
            mean = w @ vectors[ids]
            z = out @ mean + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y] -= 1
            down = p @ out
            seen[ids] += (w * np.abs(down).max()) ** 2
            vectors[ids] -= (rate * w / np.sqrt(seen[ids]))[:, None] * down
            grad = np.outer(p, mean)
            seen_out += float((grad**2).sum() + (p**2).sum())
            out -= rate * grad / np.sqrt(seen_out)
            bias -= rate * p / np.sqrt(seen_out)
    # classes were sampled evenly; the bias goes back to how often they occur
    with np.errstate(divide="ignore"):
        shift = np.log(np.maximum(priors, 1e-3)) - np.log(np.maximum(share, 1e-3))
    return Model(vectors, out, bias + shift)


def learn(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> Model | None:
    """Fit on rows that are not held out; None without examples of both labels.

    The driver receives the features of 2 * ``train_rows`` documents, about. A document
    labelled more than once counts as its lowest label.
    """
    marked = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    per = {r["quality"]: r["count"] for r in marked.groupBy("quality").count().collect()}
    if len(per) < 2:
        return None
    share = F.when(F.col("quality") == 0, min(1.0, train_rows / per[0])).otherwise(min(1.0, train_rows / per[1]))
    chosen = marked.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) < share * 1_000_003)

    # chosen holds 2 * train_rows ids and labels, about, whatever the input

    def describe(batches):
        for part in blocks(batches):
            keys, counts = counted(features(*text_bytes(part.column(1))))
            cut = np.searchsorted(keys // BUCKETS, np.arange(part.num_rows + 1))
            lists = lambda x: pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(x, pa.int32()))
            yield pa.RecordBatch.from_arrays([part.column(0), lists(keys % BUCKETS), lists(counts), part.column(2)], ["doc_id", "ids", "counts", "quality"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    found = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").mapInArrow(describe, f"doc_id {kind}, ids array<int>, counts array<int>, quality int").toArrow()
    order = sorted(range(found.num_rows), key=lambda i: (str(found.column("doc_id")[i].as_py()), found.column("quality")[i].as_py()))
    labels = found.column("quality").to_numpy()
    if len(set(labels.tolist())) < 2:
        return None
    # views of what was received, not copies: features and counts of all examples are the driver's largest data
    ids, counts = ([row for chunk in found.column(c).chunks for row in views(chunk)] for c in ("ids", "counts"))
    total = per[0] + per[1]
    return fit([(ids[i], counts[i], int(labels[i])) for i in order], (per[0] / total, per[1] / total))


def views(lists: pa.ListArray) -> list[np.ndarray]:
    cut, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
    return [flat[a:b] for a, b in zip(cut, cut[1:])]


def score_rows(docs: DataFrame, model: Model | None, out: str = "quality_score") -> DataFrame:
    """``docs`` with a last column ``out``, the chance of label 1; 0.5 without a model. Narrow: no shuffle.

    ``out`` must not be a column of ``docs``.
    """
    if out in docs.columns:
        raise ValueError(f"documents have a column {out} already")
    spark = docs.sparkSession
    names = docs.columns
    at = names.index("text")
    shared = spark.sparkContext.broadcast((model.slopes(), float(model.bias[1] - model.bias[0])) if model else None)

    def run(batches):
        for part in blocks(batches, at):
            score = np.full(part.num_rows, 0.5)
            if shared.value is not None:
                slopes, bias = shared.value
                n, z = np.zeros(part.num_rows, dtype=np.int64), np.zeros(part.num_rows)
                for ids, rows in features(*text_bytes(part.column(at))):
                    n += np.bincount(rows, minlength=part.num_rows)
                    z += np.bincount(rows, weights=slopes[ids], minlength=part.num_rows)
                z = z / np.maximum(n, 1) + bias
                score = 1 / (1 + np.exp(-np.clip(z, -60, 60)))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(score)], [*names, out])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, f"{schema}, `{out}` double")


def quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted (1 if score >= threshold).

    Labels only teach; scores read the text alone. Null and empty texts score the
    label's overall rate; without examples of both labels every score is 0.5; a null id
    is not held out; repeated rows score alike; an empty table gives no rows; further
    columns are ignored.
    """
    model = learn(docs, labels)
    scored = score_rows(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", held_out().alias("held_out"), F.col("quality_score").alias("score"),
                         (F.col("quality_score") >= threshold).cast("int").alias("predicted"))
