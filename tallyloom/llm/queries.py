"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, collocations, decontaminate, exact_dedup, language_id, line_dedup, ngram_join, packing, quality, secrets, token_counts, url_filter, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark, sf_dir):
    return token_counts.token_counts(table(spark, sf_dir, "documents"))


def op2_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op3_language_id(spark, sf_dir):
    return language_id.language_id(table(spark, sf_dir, "documents"))


def op4_quality(spark, sf_dir):
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_secrets(spark, sf_dir):
    return secrets.secrets(table(spark, sf_dir, "documents"))


def op6_decontaminate(spark, sf_dir):
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_ngram_join(spark, sf_dir):
    return ngram_join.ngram_join(table(spark, sf_dir, "documents"), k=4, num=85, den=100)


def op8_warc(spark, sf_dir):
    return warc.warc(table(spark, sf_dir, "pages"))


def op9_url_filter(spark, sf_dir):
    return url_filter.url_filter(table(spark, sf_dir, "pages"))


def op10_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"))


def op11_alignment(spark, sf_dir):
    return alignment.alignment(table(spark, sf_dir, "documents"))


def op12_line_dedup(spark, sf_dir):
    return line_dedup.line_dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op13_collocations(spark, sf_dir):
    return collocations.collocations(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (
    op1_token_counts, op2_exact_dedup, op3_language_id, op4_quality, op5_secrets, op6_decontaminate, op7_ngram_join, op8_warc, op9_url_filter, op10_packing, op11_alignment, op12_line_dedup, op13_collocations)}
ORACLE_SQL = {"op2_exact_dedup": exact_dedup.ORACLE, "op8_warc": warc.ORACLE, "op9_url_filter": url_filter.ORACLE, "op12_line_dedup": line_dedup.ORACLE, "op13_collocations": collocations.ORACLE}
