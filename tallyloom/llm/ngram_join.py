"""Exact Jaccard self-join on word shingles: size-aware, heavy and light.

Every pair of sets at the threshold shares at least one element among the rarest few
elements of each (its prefix), and at least two when the prefixes are one longer. Small
(light) sets enumerate all two-element subsets of that longer prefix and meet on equal
subsets; large (heavy) sets, and the light ones that could reach a heavy one, meet on
inverted lists of their prefix elements. The size that divides them is the one at which
subsets and expected list scans together cost least, on sizes and frequencies seen in a
sixteenth of the documents. Rare first is an order by sampled frequency and hash: any
order gives the same pairs, a good one gives short lists.

Sets that are equal are one vertex. In a list of many sets the pairs are not all formed:
each round compares the sets with one pivot, the set with the fewest rarer elements,
which in a family of copies is the original. Where a set stands in a list bounds what it
can still share, so only sets that could link there are compared. Sets linked with the
pivot are connected, and, Jaccard distance being a metric, such a set needs comparing
with another only if that one may be near enough, judged from both distances to the
pivot. What can still hold an unseen connection goes to the next round, its lists divided
by the size class of the larger set of a pair, until nothing is left.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, connected_components, discard, materialise, mix64, shingle_set, small_side, text_bytes, word_hashes

#: One document in so many is counted for the order and the boundary.
SAMPLE = 16
#: Shingles seen so often in the sample are ordered by frequency; of the most frequent so many, at most.
OFTEN, RANKED = 2, 1 << 19
#: Lists of up to so many undecided sets are joined with themselves, under conditions that let through what could
#: link two components; longer ones go by pivots.
SHORT_LIST = 4096
#: Size classes in the range of sizes that can link.
STEPS = 4
_LIGHT = (np.uint64(0x8CB92BA72F3D8DD7), np.uint64(0xD6E8FEB86659FD93))


def sets(column, k: int):
    """The set of each row: sorted distinct shingle hashes."""
    data, offsets = text_bytes(column)
    start, words = word_hashes(data)
    cut = np.searchsorted(start, offsets)
    for a, b in zip(cut, cut[1:]):
        yield shingle_set(words[a:b], k)


def least_overlap(n: int, num: int, den: int) -> int:
    """Elements that a set of ``n`` shares with any set it links with, at least."""
    return -(-num * n // den)


def boundary(sizes: dict[int, int], list_length: float, num: int, den: int) -> int:
    """Largest light size: the one of least cost, in rows emitted and sets scanned in lists."""
    known = sorted(sizes)
    if not known:
        return 0
    n, count = np.array(known), np.array([sizes[i] for i in known])
    prefix = n - np.array([least_overlap(i, num, den) for i in known]) + 1
    light, heavy = count * (prefix + 1) * prefix / 2, count * prefix * (1 + list_length)
    costs = [(float(heavy.sum()), 0)]
    for x in known:
        costs.append((float(light[n <= x].sum() + heavy[n * den >= num * x].sum()), x))
    return min(costs)[1]


class Order:
    """Elements by (sampled frequency, hash)."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray):
        at = np.argsort(hashes)
        self.hashes, self.counts = hashes[at], counts[at].astype(np.int64)
        self.bits = np.zeros(1 << 22, dtype=bool)
        self.bits[self.hashes >> np.uint64(42)] = True

    def rare_first(self, own: np.ndarray) -> np.ndarray:
        near = np.flatnonzero(self.bits[own >> np.uint64(42)])
        if not len(near):
            return own
        at = np.minimum(np.searchsorted(self.hashes, own[near]), len(self.hashes) - 1)
        frequency = np.zeros(len(own), dtype=np.int64)
        frequency[near] = np.where(self.hashes[at] == own[near], self.counts[at], 0)
        return own[np.argsort(frequency, kind="stable")]


def signatures(own: np.ndarray, order: Order, light_up_to: int, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Lists that a set stands in, and for each how many elements at most it cannot share with a set that it first meets there."""
    n = len(own)
    if n < 2:
        return own[:0], np.zeros(0, dtype=np.int32)  # one element: links with its equals only
    prefix = n - least_overlap(n, num, den) + 1
    first = order.rare_first(own)[: prefix + 1]
    out, lost = [], []
    if n <= light_up_to:
        i, j = np.triu_indices(len(first), 1)
        a, b = np.minimum(first[i], first[j]), np.maximum(first[i], first[j])
        out.append(mix64(a * _LIGHT[0] + b * _LIGHT[1]))
        lost.append(j - 1)
    if n > light_up_to or n * den >= num * light_up_to:
        out.append(first[:prefix])
        lost.append(np.arange(prefix))
    return np.concatenate(out), np.concatenate(lost).astype(np.int32)


def parity(own: np.ndarray) -> np.ndarray:
    """1,024 bits, each the parity of the elements that fall on it: bits that differ between two sets bound their difference from below."""
    return np.packbits(np.bincount((own & np.uint64(1023)).astype(np.int64), minlength=1024) & 1).view(np.int64)


def digests(rows: list[np.ndarray]) -> np.ndarray:
    """Size and two 64-bit sums of each set, by which equal sets are known."""
    return np.array([[len(s), mix64(s).sum(), mix64(s * _LIGHT[0]).sum()] for s in rows], dtype=np.uint64).view(np.int64)


def _lists(rows: list[np.ndarray]) -> pa.ListArray:
    cut = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
    flat = np.concatenate(rows).view(np.int64) if rows else np.zeros(0, dtype=np.int64)
    return pa.ListArray.from_arrays(pa.array(cut), pa.array(flat))


def _sampled(docs: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray, dict[int, int], float]:
    """Frequent shingles and their counts, sizes, and the mean length of the lists of the others."""

    def count(batches):
        hashes, sizes = [], []
        for part in blocks(batches):
            for own in sets(part.column(1), k):
                hashes.append(own)
                sizes.append(len(own))
        keys, n = np.unique(np.concatenate(hashes), return_counts=True) if hashes else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        size, m = np.unique(np.array(sizes, dtype=np.int64), return_counts=True)
        for kind, a, b in ((0, keys.view(np.int64), n), (1, size, m)):
            for at in range(0, len(a), 100_000):
                own = slice(at, at + 100_000)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(a[own]), kind, np.int32)), pa.array(a[own]), pa.array(b[own])], ["kind", "key", "n"])

    some = docs.where(F.pmod(F.xxhash64("x"), F.lit(SAMPLE)) == 0)
    counted = some.mapInArrow(count, "kind int, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n"))
    # shingles seen less often matter to the mean alone: one row a count stands for them
    rare = (F.col("kind") == 0) & (F.col("n") < OFTEN)
    counted = counted.groupBy(F.when(rare, 2).otherwise(F.col("kind")).alias("kind"), F.when(rare, F.col("n")).otherwise(F.col("key")).alias("key")).agg(F.sum("n").alias("n"))
    counted = materialise(counted, "shingle-sample")
    often = counted.where("kind = 0").orderBy(F.desc("n"), "key").limit(RANKED).select("key", "n").toArrow()
    sizes = {r["key"]: r["n"] for r in counted.where("kind = 1 and key > 0").collect()}  # one row a size
    rest = counted.where("kind = 2").agg(F.sum(F.expr("n * (key - 1)")), F.sum("n")).first()
    discard(counted)
    return (often.column("key").to_numpy().view(np.uint64), often.column("n").to_numpy(), sizes, SAMPLE * (rest[0] or 0) / (rest[1] or 1))


class Join:
    """One run of the join. Every step is a written table in the shared folder."""

    def __init__(self, docs: DataFrame, k: int, num: int, den: int):
        self.k, self.num, self.den = k, num, den
        self.docs = docs
        spark = docs.sparkSession
        kind = docs.schema["x"].dataType.simpleString()
        hashes, counts, sizes, length = _sampled(docs, k)
        self.light_up_to = light_up_to = boundary(sizes, length, num, den)
        shared = spark.sparkContext.broadcast((hashes, counts))  # RANKED entries at most

        def describe(batches):
            order = Order(*shared.value)
            for part in blocks(batches):
                own = list(sets(part.column(1), k))
                sigs, lost = zip(*(signatures(s, order, light_up_to, num, den) for s in own))
                digest = digests(own)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *(pa.array(digest[:, i].copy()) for i in range(3)),
                     _lists([parity(s) for s in own]), _lists(sigs),
                     pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(x) for x in lost])]).astype(np.int32)), pa.array(np.concatenate(lost)))],
                    ["x", "n", "d1", "d2", "bits", "sigs", "lost"])

        self.described = materialise(docs.mapInArrow(describe, f"x {kind}, n long, d1 long, d2 long, bits array<long>, sigs array<long>, lost array<int>"), "sets-described")
        some = self.described.where("n > 0 and x is not null")
        classes = materialise(some.groupBy("n", "d1", "d2").agg(F.min("x").alias("rep")), "set-classes")
        # equal sets are one vertex, named by their smallest id
        self.members = materialise(some.select("x", "n", "d1", "d2").join(classes, ["n", "d1", "d2"]).select("x", "n", "rep"), "set-members")
        discard(classes)
        copies = small_side(self.members.where("x <> rep").select("x"), "set-copies")
        self.vertices = some.join(copies, "x", "left_anti")

    def bound(self):
        """What sets with columns n, bits and m, bits_p can share at most, and whether that is enough to link."""
        differ = F.aggregate(F.zip_with("bits", "bits_p", lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda s, v: s + v)
        most = F.least("n", "m", F.floor((F.col("n") + F.col("m") - differ) / 2))
        return most, self.den * most >= self.num * (F.col("n") + F.col("m") - most)

    def compare(self, pairs: DataFrame) -> DataFrame:
        """Rows (p, x, linked, away) of the pairs: ``away`` is the distance, or a bound below it where sizes and bits already exclude a link."""
        num, den = self.num, self.den
        slim = self.vertices.select("x", "n", "bits")
        both = pairs.join(slim, "x").join(slim.select(F.col("x").alias("p"), F.col("n").alias("m"), F.col("bits").alias("bits_p")), "p")
        bounded = materialise(both.select("p", "x", "n", "m", self.bound()[0].alias("most")), "pairs-bounded")
        reaches = den * F.col("most") >= num * (F.col("n") + F.col("m") - F.col("most"))
        near = bounded.where(reaches).select("p", "x", "n", "m")
        wanted = small_side(near.select("x").union(near.select("p")).distinct(), "pair-ids")
        k = self.k

        def read(batches):
            for part in blocks(batches):
                own = list(sets(part.column(1), k))
                yield pa.RecordBatch.from_arrays([part.column(0), _lists(own)], ["x", "own"])

        kind = self.docs.schema["x"].dataType.simpleString()
        whole = self.docs.join(wanted, "x", "left_semi").mapInArrow(read, f"x {kind}, own array<long>")
        whole = materialise(whole, "pair-sets")
        met = near.join(whole, "x").join(whole.select(F.col("x").alias("p"), F.col("own").alias("own_p")), "p")
        shared = F.size(F.array_intersect("own", "own_p"))
        exact = met.select("p", "x", shared.alias("both"), (F.col("n") + F.col("m") - shared).alias("either"))
        judged = exact.select("p", "x", (den * F.col("both") >= num * F.col("either")).alias("linked"), (1 - F.col("both") / F.col("either")).alias("away"))
        apart = bounded.where(~reaches).select("p", "x", F.lit(False).alias("linked"), (1 - F.col("most") / (F.col("n") + F.col("m") - F.col("most"))).alias("away"))
        compared = materialise(judged.unionByName(apart), "pairs-compared")
        discard(bounded, wanted, whole)
        return compared

    def needed(self, n, m):
        """Elements that sets of these sizes must share to link."""
        return F.floor((self.num * (n + m) + (self.num + self.den - 1)) / (self.num + self.den))

    def possible(self, n, lost, m, lost_m):
        """Whether two sets can share enough if they first meet here."""
        return (n - lost >= self.needed(n, m)) & (m - lost_m >= self.needed(n, m))

    def by_size(self, rows: DataFrame) -> DataFrame:
        """Rows (g, x, n, lost, l) once for each size class in which a larger partner may be, as the smaller set
        of a pair, and once in their own class as the larger one; rows that no partner's size can make possible go."""
        width = float(np.log(self.den / self.num) / STEPS * (1 + 1e-6))
        own = F.floor(F.log("n") / width)
        steps = F.sequence(F.lit(0), F.lit(STEPS))
        each = rows.withColumn("own", own).select("*", F.explode(steps).alias("step"))
        larger = F.greatest(F.col("n"), F.floor(F.exp((F.col("own") + F.col("step")) * width) * (1 - 1e-9)))
        each = each.withColumns({
            "small": F.col("n") - F.col("lost") >= self.needed(F.col("n"), larger),
            "large": F.col("step") == 0,
            # sizes of smaller partners with which the set can still share enough
            "partner": F.floor((F.col("n") - F.col("lost")) * (self.num + self.den) / self.num) - F.col("n"),
        }).where("small or large")
        each = materialise(each.select(F.xxhash64("g", F.col("own") + F.col("step")).alias("g"), "x", "n", "lost", "l", "small", "large", "partner"), "open-classes")
        least = each.where("small").groupBy("g").agg(F.min("n").alias("least"))
        least = materialise(least, "least-sizes")
        kept = each.join(least, "g").where("small or partner >= least").select("g", "x", "n", "lost", "l", "small", "large")
        kept = materialise(kept, "open-sets")
        discard(each, least)
        return kept

    def run(self) -> tuple[DataFrame, DataFrame]:
        """Links (u, v) that connect whatever is connected, and labels (x, l) of the linked vertices."""
        reach = 1 - self.num / self.den
        compared, pairs, short = None, None, None
        stars = self.vertices.select("x", "n", F.explode(F.arrays_zip("sigs", "lost")).alias("s")).select(F.col("s.sigs").alias("g"), "x", "n", F.col("s.lost").alias("lost"))
        # most lists hold one set: the others are found on slim rows, before anything else is carried along
        several = small_side(stars.groupBy("g").count().where("count > 1").select("g"), "lists-of-several")
        stars = left = materialise(stars.join(several, "g", "left_semi"), "stars")
        discard(several)
        while True:
            pivots = stars.groupBy("g").agg(F.min(F.struct("lost", "x", "n")).alias("p"), F.min("x").alias("a"), F.max("x").alias("b"))
            pivots = pivots.where("a < b").select("g", F.col("p.x").alias("p"), F.col("p.n").alias("m"), F.col("p.lost").alias("lost_p"))
            pivots = materialise(pivots, "pivots")
            meets = self.possible(F.col("n"), F.col("lost"), F.col("m"), F.col("lost_p"))
            lists = materialise(stars.join(pivots, "g").where("x <> p").withColumn("meets", meets), "lists")
            discard(left, pivots)
            asked = lists.where("meets").select(F.least("p", "x").alias("p"), F.greatest("p", "x").alias("x"))
            if pairs is not None:
                asked = asked.unionByName(pairs)
            asked = asked.distinct()
            if compared is not None:
                asked = asked.join(compared, ["p", "x"], "left_anti")
            found = self.compare(asked)
            discard(short)
            if compared is None:
                compared = found
            else:
                known, compared = compared, materialise(compared.unionByName(found), "compared")
                discard(known, found)
            links = compared.where("linked").select(F.col("p").alias("u"), F.col("x").alias("v"))
            labels = connected_components(links, "ngram-cc")
            # lists that still hold sets of two components, one of them not linked with the pivot
            judged = compared.select(F.col("p").alias("low"), F.col("x").alias("high"), "linked", "away")
            apart = 1 - F.least("n", "m") / F.greatest("n", "m")
            known = (
                lists.withColumns({"low": F.least("p", "x"), "high": F.greatest("p", "x")}).join(judged, ["low", "high"], "left")
                .select("g", "x", "n", "lost", F.coalesce("linked", F.lit(False)).alias("linked"), F.coalesce("away", apart).alias("away"))
                .join(labels, "x", "left").withColumn("l", F.coalesce("l", "x"))
            )
            state = materialise(known, "list-state")
            discard(lists)
            open_lists = materialise(state.groupBy("g").agg(
                F.min(F.when(~F.col("linked"), F.col("away"))).alias("nearest"), F.min("l").alias("a"), F.max("l").alias("b"),
            ).where("nearest is not null and a <> b").select("g", "nearest"), "open-lists")
            # a slack of 1e-9 covers rounding in the differences of distances
            rest = state.join(open_lists, "g").where(~F.col("linked") | (F.col("away") >= F.col("nearest") - reach - 1e-9)).select("g", "x", "n", "lost", "l")
            rest = self.by_size(rest)
            discard(state, open_lists)
            sizes = rest.groupBy("g").agg(F.count(F.lit(1)).alias("size"), F.min("l").alias("a"), F.max("l").alias("b"), F.max("small").alias("s"), F.max("large").alias("t"))
            sizes = materialise(sizes.where("a <> b and s and t").select("g", "size"), "open-sizes")
            left = active = materialise(rest.join(sizes, "g"), "active")
            discard(rest, sizes)
            if not active.limit(1).count():
                return links, labels
            discard(labels)
            short = active.where(F.col("size") <= SHORT_LIST).join(self.vertices.select("x", "bits"), "x")
            short = materialise(short, "short-lists")
            one = short.where("small").select("g", F.col("x").alias("y"), F.col("n").alias("m"), F.col("lost").alias("lost_y"), F.col("l").alias("ly"), F.col("bits").alias("bits_p"))
            two = short.where("large").select(F.col("g").alias("h"), "x", "n", "lost", "l", "bits")
            _, reaches = self.bound()
            meets = self.possible(F.col("n"), F.col("lost"), F.col("m"), F.col("lost_y"))
            both = one.join(two, (F.col("g") == F.col("h")) & (F.col("l") != F.col("ly")) & (F.col("n") >= F.col("m")) & meets & reaches)
            pairs = both.select(F.least("x", "y").alias("p"), F.greatest("x", "y").alias("x")).distinct()
            stars = active.where(F.col("size") > SHORT_LIST).select("g", "x", "n", "lost")


def ngram_join(docs: DataFrame, k: int = 4, num: int = 85, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_shingles, component_id.

    Documents link when the Jaccard similarity of their sets of ``k``-word shingles is
    ``num / den`` or more; component_id is the smallest id reachable over links. Words are
    runs of characters other than blanks, A-Z lower-cased; fewer than ``k`` words are one
    shingle; null, empty and blank texts have none and link with nothing. Rows that repeat
    an id are documents each, with a row each; rows without an id come back as they are,
    linked with nothing (component null); an empty table gives no rows; further columns
    are ignored. Elements are compared by their 64-bit hashes.
    """
    rows = docs.select(F.col(id_col).alias("x"), F.col(text_col).alias("text"))
    repeated = bool(rows.groupBy("x").count().where("count > 1 and x is not null").limit(1).count())
    if repeated:  # the join needs a name a row: the id and a number, so that the smallest name has the smallest id
        number = F.monotonically_increasing_id().alias("row")
        rows = materialise(rows.select(F.when(F.col("x").isNotNull(), F.struct(F.col("x").alias("id"), number)).alias("x"), "text"), "ngram-rows")
    join = Join(rows, k, num, den)
    _, labels = join.run()
    labelled = join.members.join(labels.withColumnRenamed("x", "rep"), "rep", "left").select("x", F.col("n"), F.coalesce("l", "rep").alias("component_id"))
    alone = join.described.where("n = 0 or x is null").select("x", "n", F.col("x").alias("component_id"))
    name = (lambda c: F.col(f"{c}.id")) if repeated else F.col
    return labelled.unionByName(alone).select(name("x").alias(id_col), F.col("n").alias("n_shingles"), name("component_id").alias("component_id"))
