"""Versions of the vector index: backfill, parity with the catalog, and the switch of an alias."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..streaming.changelog import Changelog
from .folders import Folder


class Progress(NamedTuple):
    live: int
    embedded: int
    missing: int


class VectorIndexes:
    """Versions of an index below one folder, each a log of runs, and aliases that name the version to be read.

    The catalog comes as item_id, hash (of what is embedded) and what else embedding needs. Rows without an id take no part;
    of several with one id the greatest counts.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root
        self._folder = Folder(spark, root)

    def _log(self, version: str) -> Changelog:
        return Changelog(self.spark, f"{self.root}/{version}", "item_id string, hash string, vector array<float>, deleted boolean")

    @staticmethod
    def _unique(catalog: DataFrame) -> DataFrame:
        rest = [c for c in catalog.columns if c != "item_id"]
        return catalog.where("item_id is not null").groupBy("item_id").agg(F.max(F.struct(*rest)).alias("x")).select(F.col("item_id").cast("string"), "x.*")

    def rows(self, version: str) -> DataFrame:
        """item_id, hash, vector, run: what a version has, each item as the last run left it."""
        last = self._log(version).read().groupBy("item_id").agg(F.max_by(F.struct("hash", "vector", "deleted"), "offset").alias("x"), F.max("offset").alias("run"))
        return last.where("not x.deleted").select("item_id", "x.hash", "x.vector", "run")

    def missing(self, version: str, catalog: DataFrame) -> DataFrame:
        """The items of the catalog that a version lacks, or has for another hash."""
        return self._unique(catalog).join(self.rows(version).select("item_id", "hash"), ["item_id", "hash"], "left_anti")

    def backfill(self, version: str, catalog: DataFrame, embed: Callable[[DataFrame], DataFrame]) -> Progress:
        """Embeds what a version lacks, as one run, and takes out what the catalog no longer has.

        embed: adds `vector` to rows of the catalog; those it gives null for stay missing. A run that fails leaves nothing, and
        what earlier ones embedded isn't embedded again.
        """
        added = embed(self.missing(version, catalog)).where("vector is not null")
        added = added.select("item_id", "hash", F.col("vector").cast("array<float>").alias("vector"), F.lit(False).alias("deleted"))
        gone = self.rows(version).join(self._unique(catalog), "item_id", "left_anti").select("item_id", "hash", F.lit(None).cast("array<float>").alias("vector"), F.lit(True).alias("deleted"))
        log = self._log(version)
        at = log.append(added.unionByName(gone))
        embedded = log.read(at, at + 1).where("not deleted").count()
        return Progress(self._unique(catalog).count(), embedded, self.missing(version, catalog).count())

    def switch(self, alias: str, version: str, catalog: DataFrame) -> bool:
        """Points the alias at a version at once; refused, and False, as long as one item of the catalog is missing."""
        if not self.missing(version, catalog).isEmpty():
            return False
        self._folder.put(f"{alias}.alias", version)
        return True

    def version(self, alias: str) -> str | None:
        return self._folder.text(f"{alias}.alias")

    def read(self, alias: str) -> DataFrame:
        """The rows of the version that the alias names; an alias that was never switched is an error."""
        version = self.version(alias)
        if version is None:
            raise LookupError(f"no alias {alias}")
        return self.rows(version)
