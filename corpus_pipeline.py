"""A corpus pipeline of five stages: quality, exact copies, near copies, benchmark leaks, packing.

Each stage takes the documents that its predecessor kept, written as Parquet and read
again, and judges all of them.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm.common import materialise, small_side
from tallyloom.llm.decontaminate import without_leaks
from tallyloom.llm.exact_dedup import exact_dedup
from tallyloom.llm.ngram_join import ngram_join
from tallyloom.llm.packing import pack
from tallyloom.llm.quality import THRESHOLD, learn, score_rows


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(docs: DataFrame, wanted: str) -> str:
    """``wanted``, with underscores before it while ``docs`` has such a column."""
    while wanted.lower() in {c.lower() for c in docs.columns}:
        wanted = "_" + wanted
    return wanted


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject.

    Null and empty texts score the label's overall rate and stay or go by it; rows
    repeated, or with null or shared ids, are judged each by its text; without examples of
    both labels all documents stay; an empty table stays empty; a column of documents that
    is named like the score is kept as it is.
    """
    model = learn(docs, _table(spark, sf_dir, "labels"))
    if model is None:
        return docs
    score = free_name(docs, "quality_score")
    return score_rows(docs, model, score).where(F.col(score) >= THRESHOLD).drop(score)


#: Column that names a row of a stage's input: the ordinal of its file and its place in the file.
ROW = "__row"
#: Rows that one file can hold, as a power of two.
FILE_BITS = 33


def numbered(docs: DataFrame, row: str) -> DataFrame:
    """``docs`` with the column ``row``, a number that no two rows share, whatever their ids.

    It is read from the files' own metadata, so that every reading gives a row the same
    number and no copy of the texts is made; what is not read from Parquet is written first.
    """
    file, at, first = (free_name(docs, f"{row}_{part}") for part in ("file", "at", "first"))
    place = [F.col("_metadata.file_path").alias(file), F.col("_metadata.row_index").alias(at)]
    try:
        placed = docs.select("*", *place)
    except AnalysisException:
        docs = materialise(docs, "rows")
        placed = docs.select("*", *place)
    # one name a file: the driver holds them for any scan
    names = sorted(r[0] for r in placed.select(file).distinct().collect())
    files = docs.sparkSession.createDataFrame([(n, i << FILE_BITS) for i, n in enumerate(names)], f"`{file}` string, `{first}` long")
    found = placed.join(F.broadcast(files), file)
    return found.select(*[F.col(f"`{c}`") for c in docs.columns], (F.col(first) + F.col(at)).alias(row))


def without_rows(docs: DataFrame, dropped: DataFrame, row: str) -> DataFrame:
    return docs.join(small_side(dropped, "dropped"), row, "left_anti").drop(row)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts.

    Of equally long texts that with the smallest doc_id stays (null is smallest), then the
    first row: rows that are repeated, share an id or have none are judged each by itself.
    Null and empty texts are one group; an empty table stays empty; further columns are kept.
    """
    row = free_name(docs, ROW)
    docs = numbered(docs, row)
    named = docs.select(F.struct(F.col("doc_id").alias("doc_id"), F.col(row).alias("row")).alias("id"), "text")
    return without_rows(docs, exact_dedup(named, id_col="id").where(~F.col("kept")).select(F.col("id.row").alias(row)), row)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row, that with the smallest id (null is smallest), of each group linked by five-word shingles at a similarity of 0.8.

    Rows that are repeated, share an id or have none are documents of their own. Null,
    empty and blank texts link with nothing and stay; an empty table stays empty; further
    columns are kept.
    """
    row = free_name(docs, ROW)
    docs = numbered(docs, row)
    judged = ngram_join(docs.select(row, "text"), k=5, num=80, den=100, id_col=row)
    others = materialise(judged.where(F.col(row) != F.col("component_id")).select(row, "component_id"), "near-rows")
    members = small_side(others.union(others.select("component_id", "component_id").distinct()), "near-members")
    named = materialise(docs.select(row, "doc_id").join(members, row), "near-named")
    stays = named.groupBy("component_id").agg(F.min(F.struct("doc_id", row)).alias("best")).select(F.col(f"best.{row}").alias(row))
    return without_rows(docs, named.select(row).join(small_side(stays, "near-stays"), row, "left_anti"), row)


def leak_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage.

    Each row is judged by its text alone, whatever its id; null and empty texts stay;
    without benchmark items all stay; an empty table stays empty; further columns are kept.
    """
    return without_leaks(docs, _table(spark, sf_dir, "benchmark"))


def pack_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences.

    Null and empty texts are a piece of the closing id alone; repeated rows and rows
    without an id are packed each; an empty table gives no pieces; further columns are
    not carried along.
    """
    return pack(docs)


STAGES = [
    ("quality", quality_stage),
    ("exact_dedup", exact_stage),
    ("ngram_join", near_stage),
    ("decontaminate", leak_stage),
    ("packing", pack_stage),
]

#: Classifier, components over links and packing have no SQL form; the test compares with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
