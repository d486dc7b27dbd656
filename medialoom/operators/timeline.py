"""Ordered runs: day groups, grid layout, neighbours. `part`, where given, is a column within which each is counted (a library, a user); a part of any size is spread over tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from medialoom.functions import scalar as S
from medialoom.operators import scan


def _keys(part: str | None) -> list[str]:
    return [part] if part else []


def day_runs(listing: DataFrame, order: list[Column], part: str | None = None) -> DataFrame:
    """Gaps and islands: a new run where the day changes along the order."""
    df = listing.withColumn("day", S.day_key(F.col("ts")))
    return scan.runs(df, _keys(part), order, "day", "ts").withColumnsRenamed({"least": "first_ts", "most": "last_ts"})


def grid_layout(runs: DataFrame, columns: int, row_height: int, head_height: int, part: str | None = None, gap: int = 6) -> DataFrame:
    """y of each run: the heights of all runs before it."""
    height = F.lit(head_height) + F.ceil(F.col("items") / columns) * row_height + gap
    return scan.running(runs.withColumn("height", height.cast("long")), _keys(part), [F.col("run")], F.col("height"), "y")


def neighbours(listing: DataFrame, order: list[Column], part: str | None = None, reach: int = 3) -> DataFrame:
    """Each id with the one before and after, and how many stand within reach on either side."""
    return scan.beside(listing, _keys(part), order, "id", reach).withColumnsRenamed({"prev": "prev_id", "next": "next_id"})
