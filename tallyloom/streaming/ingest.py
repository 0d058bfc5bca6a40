"""Streams of turns: sliding token rates and their ceilings, spawn windows, children met within an interval, and an idempotent fact table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import names


def token_rate(turns: DataFrame, span: str = "60 seconds", slide: str = "1 second", late: str = "17 seconds") -> DataFrame:
    """Tokens read per model in sliding windows; turns later than ``late`` are dropped with their window."""
    return turns.withWatermark("ts", late).groupBy(F.window("ts", span, slide), "model").agg(F.sum(F.col("in_tok") + F.col("cr_tok")).alias("tokens"))


def spawn_windows(turns: DataFrame, gap: str = "30 minutes", late: str = "17 seconds") -> DataFrame:
    """Windows of a session that close when no turn follows within ``gap``."""
    return turns.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "session_id").agg(F.count(F.lit(1)).alias("turns"))


def over_ceiling(rates: DataFrame) -> DataFrame:
    """Windows of ``token_rate`` with the model's code, its ceiling, and whether the window is over it and makes requests wait; codes that begin with d never wait."""
    out = rates.withColumn("code", names.model_code(F.col("model"))).withColumn("ceiling", names.ceiling(F.col("code")).cast("bigint"))
    return out.withColumn("over", F.col("tokens") > F.col("ceiling")).withColumn("waits", F.col("over") & ~F.startswith("code", F.lit("d")))


def spawned_children(turns: DataFrame, children: DataFrame, reach: str = "15 seconds", settle: str = "2 seconds") -> DataFrame:
    """The children of each spawning turn: turns (session_id, seq, slug, ts) and child sessions (child, child_slug, first_ts), both streams, either of which may come first.

    A child belongs to a turn of its slug whose time is within ``reach`` of the child's
    first. A turn's lookup stays open until the watermark, ``reach`` and ``settle`` behind
    the newest row of the slower stream, has passed all times a child could have; a turn
    without a child is then put out once, with a null child: its lookup is settled. Several
    turns may claim a child: ``first_claims`` decides.
    """
    late = f"interval {reach} + interval {settle}"
    delay = turns.sparkSession.sql(f"select cast(unix_micros(timestamp'1970-01-02' + {late}) - unix_micros(timestamp'1970-01-02') as bigint) as d").first()["d"]
    left, right = turns.withWatermark("ts", f"{delay} microseconds"), children.withWatermark("first_ts", f"{delay} microseconds")
    near = F.expr(f"slug = child_slug and first_ts >= ts - interval {reach} and first_ts <= ts + interval {reach}")
    return left.join(right, near, "leftOuter").select("session_id", "seq", "slug", "ts", "child", "first_ts")


def first_claims(found: DataFrame) -> DataFrame:
    """Each child with the first turn that claims it, and when: (child, session_id, seq, ts). Repeated claims change nothing."""
    claims = found.where("child is not null").groupBy("child").agg(F.min(F.struct("ts", "session_id", "seq")).alias("b"))
    return claims.select("child", "b.session_id", "b.seq", "b.ts")


def write_facts(turns: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append each micro-batch under its number, so that a repeated batch replaces itself; readers collapse copies of a message."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return turns.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
