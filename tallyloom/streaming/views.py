"""Sums over the turns of a stream of changes, kept up to date batch by batch, with retraction.

A batch's changes become the differences of its keys' sums. A session that opens a
generation takes back what its earlier ones had added. What a batch adds is written
under its number, then a mark, last; readers go by the last mark, so a batch that died
half-way counts for nothing and replaces itself when it runs again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.errors import AnalysisException

from ..sources import transcripts

KEYS = ("session_id", "model", "category")
SUMS = ("in_tok", "out_tok", "cr_tok", "cw_tok", "rs_tok", "cost_ticks", "server_ticks")


class Views:
    """Sums by ``keys`` (session_id among them) below the folder ``root``: turns and each of ``sums``.

    Every ``fold_every`` batches the differences so far are folded into one base, so that a
    reader's work does not grow with the number of batches.
    """

    def __init__(self, spark: SparkSession, root: str, keys: tuple[str, ...] = KEYS, sums: tuple[str, ...] = SUMS, fold_every: int = 20, finish: Callable[[DataFrame], DataFrame] = transcripts.finished) -> None:
        if "session_id" not in keys:
            raise ValueError("session_id is one of the keys: what a generation takes back is found by it")
        self.spark, self.root, self.keys, self.sums, self.fold_every, self.finish = spark, root.rstrip("/"), keys, sums, fold_every, finish

    # --- marks: two places in turn, so that one is always whole

    def mark(self) -> tuple[int, int]:
        """Number of the last whole batch and of the base under it; -1 where there is none."""
        best = (-1, -1)
        for slot in (0, 1):
            try:
                row = self.spark.read.schema("batch long, base long").parquet(f"{self.root}/marks/{slot}").first()
            except AnalysisException:
                continue
            best = max(best, (row["batch"], row["base"])) if row else best
        return best

    def _set_mark(self, batch: int, base: int) -> None:
        self.spark.createDataFrame([(batch, base)], "batch long, base long").coalesce(1).write.mode("overwrite").parquet(f"{self.root}/marks/{batch % 2}")

    # --- reading

    def _told(self, name: str, upto: int, base: int) -> DataFrame | None:
        """Base and batches (base, upto] of a table."""
        paths = [f"{self.root}/{name}/base={base}"] if base >= 0 else []
        paths += [f"{self.root}/{name}/batch={n}" for n in range(base + 1, upto + 1)]
        return self.spark.read.parquet(*paths) if paths else None

    def _added(self, rows: DataFrame) -> DataFrame:
        return rows.groupBy(*self.keys).agg(*[F.sum(c).cast("bigint").alias(c) for c in ("turns", *self.sums)])

    def totals(self, upto: tuple[int, int] | None = None) -> DataFrame:
        """The sums as of the last mark; keys without turns are gone."""
        batch, base = upto or self.mark()
        rows = self._told("sums", batch, base)
        if rows is None:
            raise ValueError("no batch is whole yet")
        return self._added(rows).where(F.col("turns") != 0)

    def generations(self, upto: tuple[int, int] | None = None) -> DataFrame | None:
        rows = self._told("generations", *(upto or self.mark()))
        return None if rows is None else rows.groupBy("session_id").agg(F.max("generation").alias("generation"))

    # --- writing

    def put(self, changes: DataFrame, number: int) -> None:
        """Take in a batch of ``tail.session_turns`` (for ``foreachBatch``). A number that is whole already is passed over; numbers follow one another."""
        last, base = self.mark()
        if number <= last:
            return
        if number != last + 1:
            raise ValueError(f"batch {number} follows {last}")
        # written first: the stream's batch is computed once, and a replay reads what it computes anew
        at = f"{self.root}/changes/batch={number}"
        changes.write.mode("overwrite").parquet(at)
        rows = self.spark.read.schema(changes.schema).parquet(at)
        newest = rows.groupBy("session_id").agg(F.max("generation").alias("generation"))
        known = self.generations((last, base))
        valid = newest
        if known is not None:
            # a batch that repeats lines of a generation that is void already adds nothing
            before = known.withColumnRenamed("generation", "before")
            valid = newest.join(before, "session_id", "left").where(F.col("before").isNull() | (F.col("generation") >= F.col("before")))
        live = self.finish(rows.where("delta <> 0").join(valid.select("session_id", "generation"), ["session_id", "generation"]))
        signed: Callable[[str], Column] = lambda c: F.sum(F.col("delta") * F.col(c)).cast("bigint").alias(c)
        added = live.groupBy(*self.keys).agg(F.sum("delta").cast("bigint").alias("turns"), *[signed(c) for c in self.sums])
        if known is not None:
            opened = valid.where("before is not null and generation > before").select("session_id")
            taken = self.totals((last, base)).join(opened, "session_id", "left_semi")
            added = added.unionByName(taken.select(*self.keys, *[(-F.col(c)).alias(c) for c in ("turns", *self.sums)]))
        self._added(added).write.mode("overwrite").parquet(f"{self.root}/sums/batch={number}")
        valid.select("session_id", "generation").write.mode("overwrite").parquet(f"{self.root}/generations/batch={number}")
        if (number + 1) % self.fold_every == 0:
            self.totals((number, base)).write.mode("overwrite").parquet(f"{self.root}/sums/base={number}")
            self.generations((number, base)).write.mode("overwrite").parquet(f"{self.root}/generations/base={number}")
            base = number
        self._set_mark(number, base)
