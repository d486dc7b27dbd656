"""Counters kept up to date by retractions: a commit's old rows count -1, its new rows +1.

The table of counts has a row for each library and folder (sub) and is as large as the folders,
not as the media.  A commit adds the signed differences of the rows it wrote; readers add these
up, and never look at media.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from medialoom.functions import scalar as S
from medialoom.operators import folders
from medialoom.operators.media import active

#: What the measures look at.
COLUMNS = ("lib", "sub", "bytes", "fav", "kind", "deleted", "missing", "state", "ext")


def measures() -> dict[str, Column]:
    """Each measure of a row, as a number."""
    ok, one = active(), lambda c: F.coalesce(c, F.lit(False)).cast("long")
    failed = F.col("state") == 2
    return {
        "total": one(ok), "bytes": F.when(ok, F.coalesce(F.col("bytes").cast("long"), F.lit(0))).otherwise(0), "fav": one(ok & (F.col("fav") == 1)), "video": one(ok & (F.col("kind") == S.VIDEO)),
        "raw": one(ok & F.col("kind").isin(S.RAW, S.LAYERED)), "bin": one(F.col("deleted").isNotNull()), "missing": one(F.col("missing") == 1), "errors": one(failed), "heic_failed": one(failed & F.col("ext").isin(*S.HEIC_EXTENSIONS)),
    }


def differences(old: DataFrame, new: DataFrame) -> DataFrame:
    """lib, sub and by how much each measure changed from the old rows to the new; folders without a change are left out."""
    made = measures()
    signed = lambda df, sign: df.select("lib", "sub", *[(sign * c).cast("long").alias(k) for k, c in made.items()])
    return added(signed(old, -1).unionByName(signed(new, 1)))


def added(counts: DataFrame) -> DataFrame:
    """Counts and differences added up by library and folder; what has come to nothing goes."""
    names = [c for c in counts.columns if c not in ("lib", "sub")]
    some = F.lit(False)
    for c in names:
        some = some | (F.col(c) != 0)
    return counts.groupBy("lib", "sub").agg(*[F.sum(c).alias(c) for c in names]).filter(some)


def state_counters(counts: DataFrame) -> DataFrame:
    """As media.state_counters."""
    return counts.agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in measures()])


def library_counts(libraries: DataFrame, counts: DataFrame) -> DataFrame:
    """As media.library_counts."""
    n = counts.groupBy("lib").agg(F.sum("total").alias("n"), F.sum("bytes").alias("b"))
    out = libraries.join(n, libraries["id"] == n["lib"], "left")
    return out.select(libraries["id"], libraries["name"], F.coalesce("n", F.lit(0)).cast("long").alias("items"), F.coalesce("b", F.lit(0)).cast("long").alias("bytes"))


def folder_rollup(counts: DataFrame) -> DataFrame:
    """As folders.rollup over the folder counts of active items."""
    own = counts.filter("sub <> '' and total <> 0").groupBy("lib", "sub").agg(F.sum("total").alias("items"))
    return folders.rollup(own)
