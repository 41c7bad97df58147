"""Cutting lineage in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def _folder(spark: SparkSession) -> None:
    """Only a local session may do without a checkpoint folder: a temporary one is then made. Elsewhere executors wouldn't share it."""
    if spark.sparkContext.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(folder or tempfile.mkdtemp(prefix="meshlens-"))


def checkpointed(df: DataFrame) -> DataFrame:
    """df written to the session's checkpoint folder."""
    _folder(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the session's checkpoint folder: smaller than a checkpoint where rows are wide, and read by column."""
    spark = df.sparkSession
    _folder(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/written-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
