"""Uploads exactly once: a stream whose batches are decided by a manifest, then carried out.

A batch is done in two phases.  First its files are routed, get free names and are written under
attempt names into a staging folder; the rows of the attempts that succeeded, with the names they are to
have, become the batch's manifest in one commit.  Then files are renamed to these names and the library is
upserted, both from the manifest alone.  A batch that runs again before its manifest is committed makes new
attempts, which the old ones do not disturb; one that runs again after it does not choose anew, and what is renamed or upserted already stays.
Roots that are no library yet become one with the first batch that names them.
"""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from medialoom.functions import scalar as S
from medialoom.operators import library
from medialoom.session import dropped, materialised, ship
from medialoom.sources.buckets import Buckets
from medialoom.sources.catalog import Catalog
from medialoom.sources.ranges import opened
from medialoom.streaming.ingest import routed

_STAGED = "id long, staged string, bytes long"


def _local(path: str):
    from pyarrow import fs

    return (fs.LocalFileSystem(), path) if "://" not in path and not path.startswith("file:") else fs.FileSystem.from_uri(path)


def _written(folder: str):
    """Writes contents under names of the attempt."""

    def run(batches):
        at, top = _local(folder)
        for batch in batches:
            rows = []
            for i, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                name = uuid.uuid4().hex
                at.create_dir(top, recursive=True)
                with at.open_output_stream(f"{top}/{name}") as f:
                    f.write(content or b"")
                rows.append((i, f"{folder}/{name}", len(content or b"")))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 3, (pa.int64(), pa.string(), pa.int64()))], ["id", "staged", "bytes"])

    return run


def _renamed(batches):
    """Moves staged files to their paths; what is there already with its size has been moved before."""
    for batch in batches:
        paths = batch.column(1).to_pylist()
        for staged, path, size in zip(batch.column(0).to_pylist(), paths, batch.column(2).to_pylist()):
            at, source = _local(staged)
            _, target = _local(path)
            at.create_dir(target.rpartition("/")[0], recursive=True)
            try:
                at.move(source, target)
            except OSError:
                with opened(path) as f:
                    if f.size() != size:
                        raise
        yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string())], ["path"])


class Uploads:
    """Takes uploads (id, root, name, content, taken), id unique in a batch, into a bucketed media table and a table `libraries` of the same catalog."""

    def __init__(self, spark: SparkSession, catalog: Catalog, media: Buckets, libraries: StructType, staging: str):
        self.spark, self.catalog, self.media, self.libraries, self.staging = spark, catalog, media, libraries, staging.rstrip("/")
        ship(spark)

    def take(self, df: DataFrame, number: int, now: int) -> None:
        """One batch, as often as need be."""
        name = f"uploads-{number}"
        if self.catalog.version(name) is None:
            self.catalog.commit(name, self._decided(df, now))
        self._carried_out(self.catalog.read(name), now)

    def _decided(self, df: DataFrame, now: int) -> DataFrame:
        df = materialised(df, "uploads")
        self._registered(df.select("root").distinct(), now)
        libs = self.catalog.read("libraries").select(F.col("id").alias("lib"), F.col("path").alias("root"))
        rows = routed(df, now).join(F.broadcast(libs) if libs.count() <= 10_000 else libs, "root")
        taken = self.media.read().join(rows.select("lib", "sub").distinct(), ["lib", "sub"], "left_semi").select("lib", "sub", "name")
        named = library.free_names(rows.select("id", "lib", "root", "sub", "name", "taken"), taken, ["lib", "sub"])
        staged = materialised(df.select("id", "content").mapInArrow(_written(f"{self.staging}/{uuid.uuid4().hex}"), _STAGED), "staged")
        rel = F.concat_ws("/", F.when(F.col("sub") != "", F.col("sub")), "name")
        out = named.join(staged, "id").withColumn("rel", rel).withColumn("path", F.concat_ws("/", "root", "rel"))
        return out.select("staged", "path", "lib", "rel", "sub", "name", "bytes", "taken")

    def _registered(self, roots: DataFrame, now: int) -> None:
        have = self.catalog.read("libraries", self.libraries)
        new = roots.join(have.select(F.col("path").alias("root")), "root", "left_anti")
        if not new.isEmpty() or self.catalog.version("libraries") is None:
            self.catalog.commit("libraries", library.add_libraries(have, new.select(F.col("root").alias("path"), F.lit("").alias("name")), now))

    def _carried_out(self, manifest: DataFrame, now: int) -> None:
        done = materialised(manifest.select("staged", "path", "bytes").mapInArrow(_renamed, "path string"), "renamed")
        ext = S.extension_of(F.col("name"))
        seen = manifest.join(done, "path").select("path", "lib", "rel", "sub", "name", ext.alias("ext"), S.kind_of_extension(ext).alias("kind"), "bytes", F.coalesce("taken", F.lit(now)).cast("long").alias("mtime"))
        self.media.upsert(seen.filter("kind IS NOT NULL"), now)
        dropped(done)

    def run(self, inbox: str, schema: StructType, checkpoint: str, now: int) -> None:
        """All that lies in an inbox of Parquet files, by micro-batches."""
        stream = self.spark.readStream.schema(schema).option("maxFilesPerTrigger", 16).parquet(inbox)
        stream.writeStream.foreachBatch(lambda df, n: self.take(df, n, now)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
