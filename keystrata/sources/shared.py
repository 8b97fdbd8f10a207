"""Folders that all executors share."""

from __future__ import annotations

import tempfile
import time
import uuid

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession, label: str) -> str:
    """A fresh folder below ``spark.checkpoint.dir``, which goes when the session ends.

    The cluster names that folder.  Only where it is unset, as in local tests, a local folder is taken.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        set_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = set_dir.get() if set_dir.isDefined() else None
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="keystrata-")
        spark.sparkContext.setCheckpointDir(base)
    folder = f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"
    # what is read lazily must stay as long as the session; then its file system deletes it
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.mkdirs(path)
    files.deleteOnExit(path)
    # with its scheme, so that tasks find it outside the JVM too
    return f"{files.makeQualified(path).toString()}/{label}"


class SharedFiles:
    """The few file operations that commit protocols need, on whatever file system the path names."""

    def __init__(self, spark: SparkSession, root: str):
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.root = root.rstrip("/")
        self._fs = self._path("").getFileSystem(self._conf)

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def list(self, name: str) -> list[str]:
        path = self._path(name)
        if not self._fs.exists(path):
            return []
        return sorted(s.getPath().getName() for s in self._fs.listStatus(path))

    def is_file(self) -> bool:
        """Whether the root itself is a file."""
        path = self._path("")
        return self._fs.exists(path) and self._fs.getFileStatus(path).isFile()

    def read(self, name: str) -> str:
        stream = self._fs.open(self._path(name))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, name: str, text: str) -> bool:
        """Write the file whole or not at all; False if it is there already.

        The text goes to a hidden file first.  The rename to the final name is the commit, and it does not
        replace a file that another writer put there.
        """
        final = self._path(name)
        self._fs.mkdirs(final.getParent())
        if self._fs.exists(final):
            return False
        hidden = self._jvm.org.apache.hadoop.fs.Path(final.getParent(), f".{final.getName()}.{uuid.uuid4().hex}")
        stream = self._fs.create(hidden, True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        options = self._jvm.org.apache.hadoop.fs.Options.Rename
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), self._conf)
        array = self._jvm.java.lang.reflect.Array.newInstance(options.NONE.getClass(), 1)
        array[0] = options.NONE
        try:
            context.rename(hidden, final, array)
        except Exception:
            self._fs.delete(hidden, False)
            if self._fs.exists(final):
                return False
            raise
        return True

    def rename(self, name: str, final: str) -> None:
        """Give a file or folder a name that nothing has."""
        if not self._fs.rename(self._path(name), self._path(final)):
            raise OSError(f"cannot rename {name} to {final}")

    def age(self, name: str) -> float:
        """Seconds since something directly in a folder, or the file itself, was last changed."""
        path = self._path(name)
        status = self._fs.getFileStatus(path)
        times = [status.getModificationTime()]
        if status.isDirectory():
            times += [s.getModificationTime() for s in self._fs.listStatus(path)]
        return time.time() - max(times) / 1000

    def delete(self, name: str) -> None:
        self._fs.delete(self._path(name), True)
