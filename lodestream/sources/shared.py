"""Results that are kept for the rest of a query, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def _place(spark: SparkSession) -> None:
    """Sets the folder that `spark.checkpoint.dir` names; where that is unset, a local one, on one machine only."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not sc.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir is not set: driver and executors need a folder that they share")
            folder = tempfile.mkdtemp(prefix="spark-shared-")
        sc.setCheckpointDir(folder)


def once(df: DataFrame) -> DataFrame:
    """`df`, computed once and read again wherever it is used.

    It stands as Parquet, which takes a fraction of what a checkpoint's rows do, in the folder that `spark.checkpoint.dir`
    names. Only on one machine, where that is unset, a local folder is made; a cluster without the setting is refused.
    """
    spark = df.sparkSession
    path = folder(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def folder(spark: SparkSession) -> str:
    """A new folder's path, in the place where `once` keeps its results."""
    _place(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/kept-{uuid.uuid4().hex}"
