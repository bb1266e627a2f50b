"""Tables of a database: reads by ranges of a key, and a queue whose rows are claimed by one run each."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


class Database:
    """A database that the driver and the executors reach under one URL. Names of tables and columns are taken as they are."""

    def __init__(self, spark: SparkSession, url: str, driver: str, **options: str):
        self.spark, self.url, self.driver, self.options = spark, url, driver, options

    def query(self, sql: str) -> DataFrame:
        return self.spark.read.format("jdbc").options(url=self.url, driver=self.driver, query=sql, **self.options).load()

    def read(self, table: str, key: str, parts: int = 1) -> DataFrame:
        """A table in `parts` ranges of a whole-number key, a task and a connection each; rows without a key come with the first.

        The ranges are of equal width between the least and the greatest key, as they are now; columns and filters are pushed down.
        """
        low, high = self.query(f"SELECT MIN({key}) AS LOW, MAX({key}) AS HIGH FROM {table}").first()
        reader = self.spark.read.format("jdbc").options(url=self.url, driver=self.driver, dbtable=table, **self.options)
        if low is not None and parts > 1:
            reader = reader.options(partitionColumn=key, lowerBound=int(low), upperBound=int(high) + 1, numPartitions=parts)
        return reader.load()

    @contextmanager
    def _connection(self) -> Iterator:
        jvm = self.spark.sparkContext._jvm
        loader = jvm.java.lang.Thread.currentThread().getContextClassLoader()
        about = jvm.java.util.Properties()
        for name, value in self.options.items():
            about.setProperty(name, value)
        connection = jvm.java.lang.Class.forName(self.driver, True, loader).getDeclaredConstructor(None).newInstance(None).connect(self.url, about)
        try:
            yield connection
        finally:
            connection.close()

    def execute(self, sql: str, *values: int | str) -> int:
        """Runs a statement with its values as one transaction; gives the number of rows it changed."""
        with self._connection() as c:
            statement = c.prepareStatement(sql)
            for i, value in enumerate(values, 1):
                statement.setString(i, value) if isinstance(value, str) else statement.setLong(i, value)
            return statement.executeUpdate()


class Queue:
    """A table whose rows are worked off oldest first: a whole-number key, and the columns owner (text) and claimed_at (ms)."""

    def __init__(self, database: Database, table: str, key: str):
        self.database, self.table, self.key = database, table, key

    def claim(self, owner: str, limit: int, now: int, lease_ms: int) -> DataFrame:
        """Marks the oldest `limit` rows that are free and gives them; no two runs get a row.

        A row is free without an owner, and again when its claim is older than the lease, as its run is then taken for lost. An
        owner is the id of one run; one that claims again gets its rows again and more.
        """
        free = f"(owner IS NULL OR claimed_at < {int(now) - int(lease_ms)})"
        oldest = f"SELECT {self.key} FROM {self.table} WHERE {free} ORDER BY {self.key} FETCH FIRST {int(limit)} ROWS ONLY"
        self.database.execute(f"UPDATE {self.table} SET owner = ?, claimed_at = ? WHERE {self.key} IN ({oldest}) AND {free}", owner, now)
        return self.owned(owner)

    def owned(self, owner: str, parts: int = 1) -> DataFrame:
        rows = self.database.read(self.table, self.key, parts)
        name = next(c for c in rows.columns if c.lower() == "owner")
        return rows.where(rows[name] == owner)

    def done(self, owner: str) -> int:
        """Takes the run's rows off, once what they ask for is published; gives their number."""
        return self.database.execute(f"DELETE FROM {self.table} WHERE owner = ?", owner)
