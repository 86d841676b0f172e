"""Objects in any file system that Hadoop reaches, under one root."""

from __future__ import annotations

from pyspark.sql import SparkSession


class ObjectStore:
    """put, get, exists, delete and delete_prefix of keys below a root path. For single objects, on the driver."""

    def __init__(self, spark: SparkSession, root: str):
        self._jvm, self._conf, self.root = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), root.rstrip("/")

    def _at(self, key: str):
        path = self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{key}")
        return path.getFileSystem(self._conf), path

    def put(self, key: str, content: bytes) -> None:
        fs, path = self._at(key)
        out = fs.create(path, True)
        try:
            out.write(bytearray(content))
        finally:
            out.close()

    def get(self, key: str) -> bytes:
        fs, path = self._at(key)
        stream = fs.open(path)
        try:
            return bytes(stream.readAllBytes())
        finally:
            stream.close()

    def exists(self, key: str) -> bool:
        fs, path = self._at(key)
        return bool(fs.exists(path))

    def delete(self, key: str) -> bool:
        fs, path = self._at(key)
        return bool(fs.delete(path, False))

    def delete_prefix(self, prefix: str) -> int:
        """Objects below a prefix that ends a folder; how many went."""
        fs, path = self._at(prefix)
        if not fs.exists(path):
            return 0
        n = int(fs.getContentSummary(path).getFileCount())
        fs.delete(path, True)
        return n
