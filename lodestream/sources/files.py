"""Files as sources and sinks: event lines, exported sets, versioned tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENT = (
    "event_id string, user_id string, item_id string, domain string, event_type string, value double, event_ts timestamp, received_ts timestamp, "
    "session_id string, recommendation_id string, position int, context struct<device:string,country:string,autoplay:boolean>, "
    "media struct<position_ms:bigint,duration_ms:bigint,seek_from_ms:bigint,seek_to_ms:bigint>"
)


def event_lines(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Events of JSON lines (column value), flat, and the lines that are none."""
    parsed = lines.withColumn("e", F.from_json("value", EVENT + ", _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    bad = F.col("e").isNull() | F.col("e._bad").isNotNull() | F.col("e.event_id").isNull()
    good = parsed.where(~bad).select("e.*").drop("_bad")
    flat = good.select("*", "context.country", "context.autoplay", "media.*").drop("context", "media")
    flat = flat.withColumn("domain", F.lower("domain")).withColumn("event_id", F.lower("event_id"))
    return flat, parsed.where(bad).select("value")


def read_set(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All Parquet files below a folder; no rows if it doesn't exist."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("recursiveFileLookup", True).parquet(path)


def export(df: DataFrame, path: str, ts: str) -> None:
    """Appends the rows in folders dt=<UTC date of a time in milliseconds>."""
    day = F.to_date(F.timestamp_millis(F.col(ts)))
    df.withColumn("dt", day).write.mode("append").partitionBy("dt").parquet(path)


class Versions:
    """A table as folders v=N and a pointer file: readers see a version whole, writers never overwrite one."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def current(self) -> int:
        """The newest version that was written whole, or -1."""
        if not self._fs.exists(self._path(self.root)):
            return -1
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(self.root))]
        done = [n for n in names if n.startswith("v=") and self._fs.exists(self._path(f"{self.root}/{n}/_SUCCESS"))]
        return max((int(n[2:]) for n in done), default=-1)

    def read(self, schema: str) -> DataFrame:
        at = self.current()
        return self.spark.createDataFrame([], schema) if at < 0 else self.spark.read.schema(schema).parquet(f"{self.root}/v={at}")

    def write(self, df: DataFrame, version: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.root}/v={version}")
