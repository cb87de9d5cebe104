"""Small files and folders in whatever file system a path is in, by the JVM's own client."""

from __future__ import annotations

import tempfile
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class Files:
    def __init__(self, spark: SparkSession, root: str):
        self.jvm = spark.sparkContext._jvm
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.fs = self._path(root).getFileSystem(self.conf)

    def _path(self, path: str):
        return self.jvm.org.apache.hadoop.fs.Path(path)

    def exists(self, path: str) -> bool:
        return self.fs.exists(self._path(path))

    def delete(self, path: str) -> bool:
        return self.fs.delete(self._path(path), True)

    def children(self, path: str) -> list[str]:
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self._path(path))) if self.exists(path) else []

    def read(self, path: str) -> str:
        stream = self.fs.open(self._path(path))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write_new(self, path: str, text: str) -> bool:
        """Publishes a file that wasn't there; False if another writer was first. Readers see all of it or nothing.

        On a local disk the name is a link to the finished file, elsewhere it is renamed. Both fail if the name is there,
        where renaming does so at once, as on HDFS; on an object store without that, writers must take turns.
        """
        part = f"{path}.{uuid.uuid4().hex}.tmp"
        self.fs.mkdirs(self._path(path).getParent())
        stream = self.fs.create(self._path(part), False)
        stream.write(bytearray(text.encode()))
        stream.close()
        if self.fs.getUri().getScheme() == "file":
            done = self._link(self._path(part).toUri().getPath(), self._path(path).toUri().getPath())
            self.delete(part)
            return done
        if not self.exists(path) and self.fs.rename(self._path(part), self._path(path)):
            return True
        self.delete(part)
        return False

    def _link(self, of: str, name: str) -> bool:
        at = lambda p: self.jvm.java.io.File(p).toPath()
        try:
            self.jvm.java.nio.file.Files.createLink(at(name), at(of))
        except Py4JJavaError as e:
            if "FileAlreadyExists" in e.java_exception.getClass().getName():
                return False
            raise
        return True


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder that all executors see, gone when the driver's JVM ends."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        base = f"file://{tempfile.gettempdir()}" if spark.sparkContext.master.startswith("local") and "cluster" not in spark.sparkContext.master else spark.conf.get("spark.sql.warehouse.dir")
    path = f"{base if ':/' in base else 'file://' + base}/corvex-{name}-{uuid.uuid4().hex}"
    files = Files(spark, path)
    files.fs.deleteOnExit(files._path(path))
    return path
