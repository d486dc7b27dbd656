"""Folder hierarchy held in text paths: roll-ups by exploding each path into its prefixes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from medialoom.functions import scalar as S
from medialoom.operators import scan


def prefixes(sub: Column) -> Column:
    """a/b/c -> [a, a/b, a/b/c]; none for the root."""
    parts = F.split(sub, "/")
    return F.when(sub != "", F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/")))


def folder_counts(media: DataFrame) -> DataFrame:
    return media.filter(F.col("sub") != "").groupBy("lib", "sub").agg(F.count("*").alias("items"))


def rollup(counts: DataFrame, keys: list[str] = ["lib"]) -> DataFrame:
    """Own and total count of each folder, folders in between included. Counts are aggregated first, so the explode sees one row a folder."""
    own = counts.groupBy(*keys, "sub").agg(F.sum("items").alias("own"))
    exploded = own.select(*keys, "sub", "own", F.explode(prefixes(F.col("sub"))).alias("folder"))
    total = exploded.groupBy(*keys, "folder").agg(F.sum(F.when(F.col("folder") == F.col("sub"), F.col("own")).otherwise(0)).alias("own"), F.sum("own").alias("total"))
    return total.withColumn("depth", F.size(F.split("folder", "/")))


def children(folders: DataFrame, keys: list[str] = ["lib"]) -> DataFrame:
    """Each folder of a roll-up with its parent, its name and its place among the parent's children, by name without regard to case (then by name)."""
    name, parent = S.name_of(F.col("folder")), S.parent_of(F.col("folder"))
    df = folders.withColumn("parent", parent).withColumn("name", name)
    order = Window.partitionBy(*keys, "parent").orderBy(F.lower("name"), "name")
    return df.withColumn("place", F.row_number().over(order))


def listed_folders(folders: DataFrame, media: DataFrame, excludes: list[str], depth: int = 3, limit: int | None = None) -> DataFrame:
    """Folders of up to `depth` levels with the items in each subtree and whether it is excluded: one prefix aggregate in place of a query a folder. limit: none, or how many folders of each library there are at most, the first by path."""
    totals = rollup(folder_counts(media), ["lib"]).select("lib", F.col("folder").alias("rel"), "total")
    out = False
    for x in excludes:
        out = (F.col("rel") == x) | F.startswith("rel", F.lit(x + "/")) | out
    near = folders.filter(F.size(F.split("rel", "/")) <= depth)
    if limit is not None:
        near = scan.places(near, ["lib"], [F.col("rel")], "_place").filter(F.col("_place") <= limit).drop("_place")
    return near.join(totals, ["lib", "rel"], "left").select("lib", "rel", F.coalesce("total", F.lit(0)).alias("items"), (out if excludes else F.lit(False)).alias("excluded"))
