"""The shared folder of a session, and files in it through Hadoop's file systems."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors see, from spark.checkpoint.dir; a new local one only where that is unset and all runs on this machine."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="millrace-")
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


class Files:
    """Small files on any file system that Spark reaches: whole reads, whole writes, exclusive creation."""

    def __init__(self, spark: SparkSession):
        self.jvm, self.conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def _at(self, path: str):
        p = self.jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.conf), p

    def exists(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.exists(p)

    def names(self, path: str) -> list[str]:
        fs, p = self._at(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def tree(self, path: str) -> list[tuple[str, int]]:
        """(path, bytes) of every file below."""
        fs, p = self._at(path)
        out = []
        if fs.exists(p):
            found = fs.listFiles(p, True)
            while found.hasNext():
                s = found.next()
                out.append((s.getPath().toString(), s.getLen()))
        return sorted(out)

    def modified(self, path: str) -> int:
        """When the newest of the files below changed, in milliseconds; of a folder without files, when it did."""
        fs, p = self._at(path)
        newest, found = fs.getFileStatus(p).getModificationTime(), fs.listFiles(p, True)
        while found.hasNext():
            newest = max(newest, found.next().getModificationTime())
        return newest

    def read(self, path: str) -> bytes:
        fs, p = self._at(path)
        stream = fs.open(p)
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()

    def create(self, path: str, data: bytes) -> bool:
        """Writes a new file; False, and nothing written, if there is one already. The creation itself decides between rivals."""
        fs, p = self._at(path)
        if fs.getUri().getScheme() == "file":
            local = p.toUri().getPath()
            os.makedirs(os.path.dirname(local), exist_ok=True)
            draft = f"{local}.{uuid.uuid4().hex}.draft"
            with open(draft, "wb") as f:
                f.write(data)
            try:
                os.link(draft, local)
                return True
            except FileExistsError:
                return False
            finally:
                os.unlink(draft)
        try:
            stream = fs.create(p, False)
        except Exception as e:
            if "AlreadyExists" in str(e) or "already exists" in str(e):
                return False
            raise
        stream.write(bytearray(data))
        stream.close()
        return True

    def delete(self, path: str) -> None:
        fs, p = self._at(path)
        fs.delete(p, True)
