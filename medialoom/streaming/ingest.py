"""Ingest as micro-batches: what lies in an inbox is upserted into the media table, once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from medialoom.functions import images as I
from medialoom.functions import scalar as S
from medialoom.operators import library
from medialoom.sources import files
from medialoom.sources.buckets import Buckets


def ingest(spark: SparkSession, inbox: str, schema: StructType, table: Buckets, checkpoint: str, now: int) -> None:
    """Reads walk rows (path, lib, rel, sub, name, ext, bytes, mtime) from Parquet files in an inbox and commits each batch as one version of a bucketed table; a batch writes the buckets of its paths alone. An upsert by path gives the same table if a batch runs again."""

    def batch(df: DataFrame, number: int) -> None:
        latest = df.groupBy("path").agg(F.max_by(F.struct(*[c for c in df.columns if c != "path"]), F.col("mtime")).alias("r")).select("path", "r.*")
        table.upsert(latest.withColumn("kind", S.kind_of_extension(F.col("ext"))).filter(F.col("kind").isNotNull()), now)

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 64).parquet(inbox)
    stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def routed(uploads: DataFrame, now: int, organize: bool = True) -> DataFrame:
    """Uploads (name, content, taken) with the folder and safe name they go to; taken is what the upload says, else its EXIF, else the first date in its header, else its name's."""
    uploads = uploads.withColumn("_exif", I.exif(S.capped(F.col("content"), 131072))["taken"])
    taken = F.coalesce(F.col("taken"), S.parse_capture_date(F.col("_exif")), S.header_date(F.col("content")), S.date_from_name(F.col("name")))
    folder = S.dated_folder(taken, F.lit(now)) if organize else F.lit("")
    return uploads.withColumn("name", S.safe_file_name(F.col("name"))).withColumn("taken", taken).withColumn("sub", folder).drop("_exif")


def take_uploads(uploads: DataFrame, taken: DataFrame, root: str, now: int, organize: bool = True) -> DataFrame:
    """Uploads (id, name, content, taken) routed, given names that are free among `taken` (sub, name) and written below the root: path and bytes, which the next walk meets."""
    return files.stored(library.free_names(routed(uploads, now, organize), taken, ["sub"]), root)
