"""Small files on whatever file system Spark can reach: pointers, metadata, version folders."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


class Files:
    """Reads, lists, deletes and atomically replaces files through the session's Hadoop configuration."""

    def __init__(self, spark: SparkSession):
        self._gateway, self._jvm = spark.sparkContext._gateway, spark._jvm
        self._conf = spark._jsparkSession.sessionState().newHadoopConf()

    def _at(self, path: str):
        p = self._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self._conf), p

    def read(self, path: str) -> str | None:
        """The text of a small file, None if there is none."""
        fs, p = self._at(path)
        if not fs.exists(p) or fs.getFileStatus(p).isDirectory():
            return None
        stream = fs.open(p)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def write(self, path: str, text: str) -> None:
        """Writes a file aside and renames it over the old one."""
        aside = f"{path}.{uuid.uuid4().hex[:8]}.tmp"
        fs, p = self._at(aside)
        fs.setWriteChecksum(False)
        stream = fs.create(p, True)
        try:
            stream.write(text.encode())
        finally:
            stream.close()
        rename = self._jvm.org.apache.hadoop.fs.Options.Rename
        options = self._gateway.new_array(rename, 1)
        options[0] = rename.OVERWRITE
        to = fs.makeQualified(self._jvm.org.apache.hadoop.fs.Path(path))
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self._conf)
        context.rename(fs.makeQualified(p), to, options)

    def names(self, path: str) -> list[str]:
        """Names in a folder, [] if there is none."""
        fs, p = self._at(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def make(self, path: str) -> None:
        fs, p = self._at(path)
        fs.mkdirs(p)

    def delete(self, path: str) -> None:
        fs, p = self._at(path)
        fs.delete(p, True)
