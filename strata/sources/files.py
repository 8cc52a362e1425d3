"""Small files of metadata on any Hadoop file system: whole reads, and writes that one of several writers wins."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


class Folder:
    """A folder on the file system that its path names."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _at(self, name: str = ""):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    @property
    def _fs(self):
        return self._at().getFileSystem(self._conf)

    def names(self) -> list[str]:
        return sorted(x.getPath().getName() for x in self._fs.listStatus(self._at())) if self._fs.exists(self._at()) else []

    def read(self, name: str) -> str:
        stream = self._fs.open(self._at(name))
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def claim(self, name: str, text: str) -> bool:
        """Write a file that nobody has written yet, whole at once: to a hidden name, then a rename that fails where the name is taken."""
        fs, hidden = self._fs, f".{name}.{uuid.uuid4().hex}"
        out = fs.create(self._at(hidden), True)
        out.write(bytearray(text.encode()))
        out.close()
        if fs.exists(self._at(name)):
            fs.delete(self._at(hidden), False)
            return False
        fc = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self._conf)
        none = self._jvm.java.lang.reflect.Array.newInstance(self._jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), 0)
        try:
            fc.rename(self._at(hidden), self._at(name), none)  # no overwriting
        except Exception:
            fs.delete(self._at(hidden), False)
            if fs.exists(self._at(name)):
                return False
            raise
        return True

    def delete(self, name: str = "") -> None:
        if self._fs.exists(self._at(name)):
            self._fs.delete(self._at(name), True)
