"""What the operators of this subpackage share: scratch tables, checkpoints, batches."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The words of a text: runs of anything but space and the control characters 9-13.
WORD = r"[^\x20\x09-\x0D]+"
#: Ids (up to 32 bytes a row with what goes with them) up to which a table of them is broadcast.
SMALL_IDS = 1_000_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is what `spark.checkpoint.dir` names. Only on one machine, where that is unset, a local folder is made; a
    cluster without the setting is refused.
    """
    sc = spark.sparkContext
    known = sc.getCheckpointDir()
    if known is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not sc.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir is not set: driver and executors need a folder that they share")
            folder = tempfile.mkdtemp(prefix="spark-shared-")
        sc.setCheckpointDir(folder)
        known = sc.getCheckpointDir()
    return known


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the shared file system, if it is there."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def cut(df: DataFrame) -> DataFrame:
    """`df`, computed once and kept in the checkpoint folder: its lineage ends there."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def text_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Sends at most so many rows to Python at a time, since texts may be long.

    It is a setting of the session, as results are computed after an operator has returned. A session that has
    a figure of its own other than Spark's default keeps it.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, str(rows))


_caches: dict[str, dict] = {}


def cache_of(operator: str) -> dict:
    """What this worker remembers for an operator; what it remembers for others goes, as workers outlive a stage."""
    for other in [name for name in _caches if name != operator]:
        del _caches[other]
    return _caches.setdefault(operator, {})


class Scratch:
    """Parquet tables in the shared folder, for as long as one operator runs.

    `table` writes a DataFrame and reads it back; the folder goes when the block ends, so what leaves the
    block passes through `result`, a checkpoint.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def __enter__(self) -> Scratch:
        self.root = f"{shared_dir(self.spark)}/tables-{uuid.uuid4().hex}"
        text_batches(self.spark)
        return self

    def __exit__(self, *_) -> None:
        remove(self.spark, self.root)

    def table(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        remove(self.spark, f"{self.root}/{name}")

    def result(self, df: DataFrame) -> DataFrame:
        return cut(df)


def fresh(df: DataFrame, name: str) -> str:
    """`name`, with as many _ before it as it takes to differ from the columns of `df`."""
    known = {c.lower() for c in df.columns}
    while name.lower() in known:
        name = "_" + name
    return name


def broadcast_if_small(df: DataFrame, rows: int, limit: int) -> DataFrame:
    """A broadcast hint only where the counted rows stay under the limit."""
    return F.broadcast(df) if rows <= limit else df
