"""Folders of any file system that Spark knows, for pointers and for data that must appear whole."""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class Folder:
    """A folder in which a text replaces another at once, and a folder takes its place at once or not at all."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm, self._gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
        hadoop, conf = self._jvm.org.apache.hadoop.fs, spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = hadoop.Path(self.root).getFileSystem(conf)
        self._context = hadoop.FileContext.getFileContext(self._fs.makeQualified(hadoop.Path(self.root)).toUri(), conf)

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def has(self, name: str) -> bool:
        return self._fs.exists(self._at(name))

    def names(self, name: str = "") -> list[str]:
        """What stands in a folder; nothing if it doesn't exist."""
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._at(name))) if self.has(name) else []

    def text(self, name: str) -> str | None:
        if not self.has(name):
            return None
        source = self._fs.open(self._at(name))
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(source)).decode()
        finally:
            source.close()

    def put(self, name: str, text: str) -> None:
        """Writes a small file; who reads it sees the old text or the new one."""
        folder, _, last = name.rpartition("/")
        new = f"{folder}/_new-{last}" if folder else f"_new-{last}"
        sink = self._fs.create(self._at(new), True)
        try:
            sink.write(bytearray(text.encode()))
        finally:
            sink.close()
        self._rename(new, name, overwrite=True)

    def move(self, source: str, target: str) -> bool:
        """Gives a folder its name; False, and nothing done, if the name is taken."""
        self._fs.mkdirs(self._at(target).getParent())
        try:
            self._rename(source, target, overwrite=False)
        except Py4JJavaError as e:
            if "FileAlreadyExistsException" in e.java_exception.getClass().getName():
                return False
            raise
        return True

    def _rename(self, source: str, target: str, overwrite: bool) -> None:
        rename = self._jvm.org.apache.hadoop.fs.Options.Rename
        options = self._gateway.new_array(rename, int(overwrite))
        if overwrite:
            options[0] = rename.OVERWRITE
        self._context.rename(self._at(source), self._at(target), options)
