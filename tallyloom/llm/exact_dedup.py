"""Exact duplicates by content sort (DataFrame functions only).

Sampled splitters range-partition the rows by their normalised text, each partition is
sorted externally, and neighbouring equal texts form a group. The splitter key is the
text's first characters and its hash, so that long shared openings still divide. Texts
of which a row sample shows very many copies get a segment number in their key: their
copies are sorted and compared in many tasks, and the few segment leaders of such a text
meet through its SHA-256.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

#: What normalisation deletes: U+0020 and U+0009 to U+000D.
BLANKS = (" ", "\t", "\n", "\x0b", "\x0c", "\r")


def normalised(text):
    """The text without blanks; null counts as empty."""
    out = F.coalesce(text, F.lit(""))
    for blank in BLANKS:
        out = F.replace(out, F.lit(blank), F.lit(""))
    return out


def exact_dedup(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    sample_rows: int = 50_000,
    hot_share: float = 0.0005,
    segments: int = 1024,
) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Of equal normalised texts the row with the most code points in its original text
    stays, then the one with the smallest id. ``sample_rows`` and ``hot_share`` only
    decide which texts are sorted in ``segments`` parts (1 / hot_share texts at most);
    they never change the result. Null text is empty text; a null id is the smallest;
    rows repeated whole are copies like others, of which one stays; an empty table gives
    no rows; further columns are ignored.
    """
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).select(
        "id", F.char_length(F.coalesce("t", F.lit(""))).alias("chars"), normalised(F.col("t")).alias("norm")
    )
    total = df.count()
    share = min(1.0, sample_rows / max(total, 1))
    least = max(8, int(hot_share * sample_rows))
    sampled = df.select(F.col(text_col).alias("t")).sample(fraction=share, seed=7) if share < 1 else df.select(F.col(text_col).alias("t"))
    hot = [
        r["h"]
        for r in sampled.select(F.xxhash64(normalised(F.col("t"))).alias("h")).groupBy("h").count()
        .where(F.col("count") >= least).orderBy(F.desc("count")).limit(int(1 / hot_share)).collect()
    ]
    h = F.xxhash64("norm")
    segment = F.when(F.col("h").isin(hot), F.pmod(F.monotonically_increasing_id(), F.lit(segments)).cast("int")).otherwise(F.lit(-1)) if hot else F.lit(-1)
    keyed = rows.withColumn("h", h).withColumn("segment", segment).withColumn("head", F.substring("norm", 1, 16))
    dealt = keyed.repartitionByRange("head", "h", "segment")
    key = ["head", "h", "segment", "norm"]
    order = Window.partitionBy(*key).orderBy(F.desc("chars"), F.asc("id"))
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    local = dealt.select(
        "id", "segment",
        F.sha2("norm", 256).alias("text_sha256"),
        F.row_number().over(order).alias("place"),
        F.first("id").over(order).alias("leader"),
        F.first("chars").over(order).alias("leader_chars"),
        F.count(F.lit(1)).over(whole).alias("n"),
    )
    if not hot:
        return local.select(
            F.col("id").alias(id_col), F.col("leader").alias("keep_id"), F.col("n").alias("group_size"),
            (F.col("place") == 1).alias("kept"), "text_sha256",
        )
    local = materialise(local, "exact-dedup")
    # one row for each segment of a hot text, one for each hot text after it: 1 / hot_share texts at most
    joined = local.where("segment >= 0 and place = 1").groupBy("text_sha256").agg(
        F.min(F.struct((-F.col("leader_chars")).alias("c"), F.col("leader").alias("id"), F.col("segment").alias("segment"))).alias("best"),
        F.sum("n").alias("total"),
    )
    out = local.join(F.broadcast(joined), "text_sha256", "left")
    split = F.col("segment") >= 0
    return out.select(
        F.col("id").alias(id_col),
        F.when(split, F.col("best.id")).otherwise(F.col("leader")).alias("keep_id"),
        F.when(split, F.col("total")).otherwise(F.col("n")).cast("long").alias("group_size"),
        ((F.col("place") == 1) & (~split | (F.col("segment") == F.col("best.segment")))).alias("kept"),
        "text_sha256",
    )


ORACLE = r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
  FROM documents
), g AS (
  SELECT doc_id, sha256(norm) AS text_sha256,
         first_value(doc_id) OVER w AS keep_id,
         count(*) OVER (PARTITION BY norm) AS group_size,
         row_number() OVER w AS place
  FROM n WINDOW w AS (PARTITION BY norm ORDER BY chars DESC, doc_id)
)
SELECT doc_id, keep_id, group_size, place = 1 AS kept, text_sha256 FROM g
"""
