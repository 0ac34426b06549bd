"""Cutting lineage in the folder that driver and executors share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's own. Where none is set, a new one on one machine, and an error on a cluster."""
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        import tempfile

        folder = context.getConf().get("spark.checkpoint.dir")
        if not folder and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="quillon-checkpoint-"))
    return context._jsc.sc().getCheckpointDir().get()


def cut(spark: SparkSession, df: DataFrame) -> DataFrame:
    """df with its lineage cut, kept in the folder that all executors share."""
    shared_folder(spark)
    return df.checkpoint(eager=True)
