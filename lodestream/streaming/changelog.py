"""Logs of keyed changes, read from a first to a last offset, and the views that are built from them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import state
from ..sources.files import Versions
from ..sources.folders import Folder


class Changelog:
    """Changes as folders offset=N of Parquet, each put in its place at once and never written again.

    `schema` names the columns, with seq and deleted (true for a tombstone) among them. A log that has no folder yet is empty.
    """

    def __init__(self, spark: SparkSession, root: str, schema: str):
        self.spark, self.root, self.schema = spark, root, schema
        self._folder = Folder(spark, root)

    def end(self) -> int:
        """The offset that the next batch will have."""
        return max((int(n[7:]) + 1 for n in self._folder.names() if n.startswith("offset=")), default=0)

    def append(self, rows: DataFrame) -> int:
        """Writes a batch and gives its offset. Of two writers at a time one takes the next offset, the other the one after."""
        hidden = f"_{uuid.uuid4().hex}"
        names = [f.name for f in self.read(0, 0).schema if f.name != "offset"]
        rows.select(*names).write.parquet(f"{self.root}/{hidden}")
        at = self.end()
        while not self._folder.move(hidden, f"offset={at}"):
            at += 1
        return at

    def read(self, first: int = 0, end: int | None = None) -> DataFrame:
        """The changes from `first` up to `end`, that one left out; without it up to the log's end as it is now.

        Adds `offset`. What is appended later is no part of the result, however late that is computed.
        """
        end = self.end() if end is None else end
        schema = f"{self.schema}, offset int"
        if first >= end:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", self.root).parquet(*(f"{self.root}/offset={n}" for n in range(first, end)))

    def stream(self, batches: int = 1) -> DataFrame:
        """The changes as a stream, some batches' files at a time; the log must have a first batch."""
        return self.spark.readStream.schema(f"{self.schema}, offset int").option("maxFilesPerTrigger", batches).parquet(self.root)


def newest(changes: DataFrame, key: str) -> DataFrame:
    """One change a key: the highest seq, of equal ones the earliest offset, then the greatest of the other columns.

    Tombstones stay; changes without a key or a seq are left out. The columns are those of `changes` less offset.
    """
    rest = [c for c in changes.columns if c not in (key, "seq", "offset")]
    best = changes.where(F.col(key).isNotNull() & F.col("seq").isNotNull()).withColumn("_early", -F.col("offset"))
    best = best.groupBy(key).agg(F.max(F.struct("seq", "_early", *rest)).alias("x"))
    return best.select(key, "x.*").select([c for c in changes.columns if c != "offset"])


def follow(log: Changelog, root: str, key: str) -> int:
    """Brings the view at `root` up to the log's end as it is at the call; gives the last offset in it, -1 without any.

    A view that is there takes what came since; one that is lost, or was never built, is built from the whole log, with the
    same rows. It keeps tombstones, so that an older change that comes late revives nothing. A run that fails leaves the view
    before it, and one that runs again gives the same version.
    """
    view = Versions(log.spark, root)
    at, last = view.current(), log.end() - 1
    if last <= at:
        return at
    new = newest(log.read(at + 1, last + 1), key)
    view.write(new if at < 0 else state.cas_upsert(view.read(log.schema), new, key), last)
    return last


def live(log: Changelog, root: str) -> DataFrame:
    """The view's rows without tombstones."""
    return Versions(log.spark, root).read(log.schema).where(~F.coalesce("deleted", F.lit(False)))
