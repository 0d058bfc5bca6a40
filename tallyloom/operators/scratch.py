"""Tables that a loop writes down between its rounds."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The folder that the session's cluster shares: Spark's checkpoint folder, or the setting ``spark.checkpoint.dir``.

    A local master without either gets a temporary one; any other raises.
    """
    context = spark.sparkContext
    found = context.getCheckpointDir() or context.getConf().get("spark.checkpoint.dir")
    if not found:
        if context.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="tallyloom-")
        context.setCheckpointDir(found)
    return found.rstrip("/")


def fresh() -> str:
    return uuid.uuid4().hex


def written(df: DataFrame) -> DataFrame:
    """``df`` written below the shared folder and read back: a round is computed once, and a lost executor costs no more than a round.

    Not a checkpoint: its plan keeps all constraints of the rounds before, which grow from round to round.
    """
    path = f"{folder(df.sparkSession)}/round-{fresh()}"
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table.scratch = path
    return table


def together(tables: list[DataFrame]) -> DataFrame:
    """Written tables of one schema as one: a scan of all their files, where a union would plan and compile a scan for each."""
    return tables[0].sparkSession.read.schema(tables[0].schema).parquet(*[t.scratch for t in tables])
