"""Ordered collections of media."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from medialoom.functions import scalar as S
from medialoom.operators.library import numbered


def collection_stats(collections: DataFrame, items: DataFrame, media: DataFrame) -> DataFrame:
    """Items (all), bytes (of items that are in the media table, also deleted ones), cover: the explicit one, else the first by (ord, added)."""
    n = items.join(media.select(F.col("id").alias("media"), "bytes"), "media", "left").groupBy("coll").agg(
        F.count("*").alias("items"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"), F.min(F.struct("ord", "added", "media"))["media"].alias("first"))
    out = collections.join(n, collections["id"] == n["coll"], "left")
    return out.select("id", "name", F.coalesce("items", F.lit(0)).cast("long").alias("items"), F.coalesce("bytes", F.lit(0)).cast("long").alias("bytes"), F.coalesce("cover", "first").alias("cover"))


def create(collections: DataFrame, names: DataFrame, now: int) -> DataFrame:
    """New names get ids after the largest; blank and known names are ignored."""
    new = names.select(F.trim("name").alias("name")).filter("name <> ''").distinct().join(collections, "name", "left_anti")
    top = collections.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top")).first()["top"]
    rows = numbered(new, [F.col("name")], top).select(F.col("number").cast("long").alias("id"), "name", F.lit(None).cast("string").alias("note"), F.lit(now).cast("long").alias("created"), F.lit(None).cast("long").alias("cover"))
    return collections.unionByName(rows.select(*collections.columns))


def rename(collections: DataFrame, coll: int, name: str, note: str | None = None) -> DataFrame:
    mine, name = F.col("id") == coll, name.strip()
    df = collections.withColumn("name", F.when(mine, F.lit(name)).otherwise(F.col("name"))) if name else collections
    return df if note is None else df.withColumn("note", F.when(mine, F.lit(note)).otherwise(F.col("note")))


def delete(collections: DataFrame, items: DataFrame, coll: int) -> tuple[DataFrame, DataFrame]:
    return collections.filter(F.col("id") != coll), items.filter(F.col("coll") != coll)


def add_items(items: DataFrame, new: DataFrame, now: int) -> DataFrame:
    """new: coll, media, position (from 0). ord goes on from the collection's largest; a member met again keeps its place, and its position stays unused."""
    top = items.groupBy("coll").agg(F.max("ord").alias("top"))
    first = Window.partitionBy("coll", "media").orderBy("position")
    rows = new.withColumn("n", F.row_number().over(first)).filter("n = 1").join(items.select("coll", "media"), ["coll", "media"], "left_anti").join(top, "coll", "left")
    rows = rows.select("coll", "media", (F.coalesce("top", F.lit(-1)) + 1 + F.col("position")).cast("long").alias("ord"), F.lit(now).cast("long").alias("added"))
    return items.unionByName(rows.select(*items.columns))


def remove_items(items: DataFrame, gone: DataFrame) -> DataFrame:
    return items.join(gone.select("coll", "media"), ["coll", "media"], "left_anti").select(*items.columns)


def export_manifest(items: DataFrame, media: DataFrame) -> DataFrame:
    """Names in the archive of each collection, in order; a name met before gets its id. With paths and bytes beside them `zips.written` makes the archives."""
    df = items.join(media.filter(F.col("deleted").isNull()).select(F.col("id").alias("media"), "name"), "media")
    order = [F.col("ord"), F.col("added"), F.col("media")]
    again = F.row_number().over(Window.partitionBy("coll", "name").orderBy(*order)) > 1
    stem, ext = S.stem_of(F.col("name")), S.suffix_of(F.col("name"))
    df = df.withColumn("entry", F.when(again, F.concat(stem, F.lit(" ("), F.col("media").cast("string"), F.lit(")"), ext)).otherwise(F.col("name")))
    return df.select("coll", "media", "entry", F.row_number().over(Window.partitionBy("coll").orderBy(*order)).alias("position"))


def archive_bytes(items: DataFrame, media: DataFrame) -> DataFrame:
    """Entries and bytes of each collection's archive (stored, not deflated)."""
    df = items.join(media.filter(F.col("deleted").isNull()).select(F.col("id").alias("media"), "bytes"), "media")
    return df.groupBy("coll").agg(F.count("*").alias("entries"), F.coalesce(F.sum("bytes"), F.lit(0)).cast("long").alias("bytes"))


def stale_exports(files: DataFrame, now: int, age: int = 3600) -> DataFrame:
    """Of files (path, name, mtime), the exports older than `age` seconds: what a sweep deletes."""
    return files.filter(F.startswith("name", F.lit("export-")) & F.endswith("name", F.lit(".zip")) & (F.col("mtime") < now - age))


def archive_name(name):
    return F.concat(S.safe_export_name(name), F.lit(".zip"))
