"""Versioned Parquet snapshots: a commit writes a new version, then moves the pointer; readers keep the version they began with."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class Catalog:
    """Tables under a root folder in any store that Spark writes to. A commit is one new pointer file, named by its number, so the last number wins."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _files(self):
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.root)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path

    def pointer(self, name: str) -> tuple[int, dict] | None:
        """Number and content of the newest pointer."""
        fs, path = self._files()
        at = path(f"{self.root}/{name}/_pointers")
        if not fs.exists(at):
            return None
        last = max(((int(s.getPath().getName().split(".")[0]), str(s.getPath())) for s in fs.listStatus(at) if s.getPath().getName().endswith(".json")), default=None)
        if last is None:
            return None
        stream = fs.open(path(last[1]))
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return last[0], json.loads(text)

    def point(self, name: str, number: int, content: dict) -> int:
        """Commits pointer `number`; fails if another writer took it meanwhile."""
        fs, path = self._files()
        out = fs.create(path(f"{self.root}/{name}/_pointers/{number:010d}.json"), False)  # no overwriting: the loser of a race gets an error
        out.write(bytearray(json.dumps(content).encode()))
        out.close()
        return number

    def version(self, name: str) -> tuple[int, str] | None:
        now = self.pointer(name)
        return now and (now[0], now[1]["data"])

    def read(self, name: str, schema: StructType | None = None) -> DataFrame:
        """The current version; columns that the schema has and the data lack come as NULL."""
        now = self.version(name)
        if now is None:
            if schema is None:
                raise KeyError(name)
            return self.spark.createDataFrame([], schema)
        df = self.spark.read.parquet(f"{self.root}/{name}/{now[1]}")
        if schema is not None:
            df = df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])
        return df

    def commit(self, name: str, df: DataFrame) -> int:
        """Writes a new version; fails if another writer took the same number meanwhile."""
        now = self.version(name)
        number, data = (now[0] + 1 if now else 1), f"v-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.root}/{name}/{data}")
        return self.point(name, number, {"data": data})
