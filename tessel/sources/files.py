"""Small files on whatever file system the warehouse is on, through Spark's own access to it.

Commits need a file system on which one of several writers of a name wins: a hard
link on a local one, a rename on those whose rename refuses an existing name.
Object stores that overwrite are refused.
"""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession

from ..errors import TableError

# Schemes whose rename fails if the new name exists.
STRICT_RENAME = ("hdfs", "viewfs", "abfs", "abfss")


class Files:
    def __init__(self, spark: SparkSession) -> None:
        self.jvm = spark._jvm
        self.conf = spark._jsc.hadoopConfiguration()

    def _path(self, path: str):  # noqa: ANN202
        p = self.jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.conf), p

    def read(self, path: str) -> str:
        fs, p = self._path(path)
        stream = fs.open(p)
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def create(self, path: str, text: str) -> bool:
        """Write a file that doesn't exist yet: whole, or not at all.  False if someone else was first."""
        fs, p = self._path(path)
        scheme = fs.getUri().getScheme()
        if scheme != "file" and scheme not in STRICT_RENAME:
            raise TableError(f"a warehouse on {scheme}: would let two commits overwrite each other")
        _, temp = self._path(f"{path}.{uuid.uuid4().hex}")
        stream = fs.create(temp, False)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        if scheme == "file":
            made = self._linked(temp, p)
            fs.delete(temp, False)
            return made
        if not fs.rename(temp, p):
            fs.delete(temp, False)
            return False
        return True

    def _linked(self, temp, path) -> bool:  # noqa: ANN001
        """A second name for a local file, which the system makes only if nothing has it."""
        place = lambda p: self.jvm.java.io.File(p.toUri().getPath()).toPath()
        try:
            self.jvm.java.nio.file.Files.createLink(place(path), place(temp))
        except Exception as e:
            if "FileAlreadyExistsException" in str(e):
                return False
            raise
        return True

    def ages(self, folder: str) -> dict[str, float]:
        """Names in a folder and the seconds since each was changed, by the clock of the file system's host where that's this one."""
        fs, p = self._path(folder)
        now = self.jvm.java.lang.System.currentTimeMillis()
        return {x.getPath().getName(): (now - x.getModificationTime()) / 1000 for x in fs.listStatus(p)} if fs.exists(p) else {}

    def exists(self, path: str) -> bool:
        fs, p = self._path(path)
        return fs.exists(p)

    def bytes(self, path: str) -> int:
        fs, p = self._path(path)
        return fs.getContentSummary(p).getLength()

    def names(self, folder: str) -> list[str]:
        fs, p = self._path(folder)
        return [x.getPath().getName() for x in fs.listStatus(p)] if fs.exists(p) else []

    def delete(self, path: str) -> None:
        fs, p = self._path(path)
        fs.delete(p, True)

    def make(self, folder: str) -> None:
        fs, p = self._path(folder)
        fs.mkdirs(p)
