"""A stored index of vectors by pivots: searches that skip whole groups of vectors, exactly.

Pivots are spread over the directions of a bounded sample (each the farthest from those before).  Every vector joins
its nearest pivot's group; groups are partitions of the stored table, and a small table has for each the
least and greatest angle to the pivot and the least and greatest length.  The angle between a
query and a vector of a group is at least what the triangle inequality leaves, so the group's products have
an upper bound.  A search reads the group with the highest bound first; its best score fixes
what counts as near, and only groups that can hold such vectors are read then.  The others' files are never opened.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from medialoom.operators import vectors as V
from medialoom.session import ship

#: Vectors that pivots are chosen among: those with the smallest hash of id.
SAMPLE = 20_000
#: Vectors that a group should have, and how many groups there are at least and at most.
GROUP, LEAST, MOST = 8192, 16, 4096
#: Files of a group while it is written.
SALTS = 8
#: Products are rounded.
SLACK = 1e-9


def _unit(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    length = np.sqrt((m * m).sum(axis=1))
    return m / np.where(length > 0, length, 1)[:, None], length


def spread_pivots(sample: np.ndarray, k: int) -> np.ndarray:
    """Up to k directions of the sample, each the farthest from those before it."""
    unit, length = _unit(sample)
    unit = unit[length > 0]
    if not len(unit):
        return np.zeros((1, sample.shape[1]))
    chosen, near = [0], unit @ unit[0]
    while len(chosen) < k and near.min() < 1 - 1e-12:
        chosen.append(int(near.argmin()))
        near = np.maximum(near, unit @ unit[chosen[-1]])
    return unit[chosen]


class PivotIndex:
    """An index stored below a path. `told` has what the last search read: groups, vectors, and how many there are of each."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.told = spark, path, {}
        head = spark.read.parquet(f"{path}/pivots").first()
        self.pivots = np.array(json.loads(head["pivots"]))
        self.groups = spark.read.parquet(f"{path}/groups").orderBy("grp").toPandas()  # a row for each pivot
        self.rows = spark.read.schema("id long, vec array<double>, grp int").parquet(f"{path}/vectors")

    @staticmethod
    def build(vectors: DataFrame, path: str, groups: int | None = None) -> PivotIndex:
        """vectors: id, vec. Those that are null or hold a null have no score, so they are left out."""
        spark = vectors.sparkSession
        ship(spark)
        ok = vectors.select(F.col("id").cast("long").alias("id"), F.col("vec").cast("array<double>").alias("vec")).filter(F.col("vec").isNotNull() & ~F.exists("vec", lambda x: x.isNull()))
        n = ok.agg(F.count("*"), F.max(F.size("vec"))).first()
        width = n[1] or 1
        k = groups or int(np.clip(n[0] // GROUP, LEAST, MOST))
        sample = [r["vec"] for r in ok.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("vec").collect()]
        pivots = spread_pivots(V._padded(sample, width) if sample else np.zeros((1, width)), k)

        def run(batches):
            for batch in batches:
                m = V._rows(batch.column(1)).astype(float)
                m = np.pad(m, ((0, 0), (0, len(pivots[0]) - m.shape[1])))
                unit, length = _unit(m)
                cosine = unit @ pivots.T
                grp = cosine.argmax(axis=1)
                angle = np.arccos(np.clip(cosine[np.arange(len(grp)), grp], -1, 1))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.where(length > 0, grp, -1).astype(np.int32)), pa.array(angle), pa.array(length)], ["id", "vec", "grp", "angle", "length"])

        placed = ok.mapInArrow(run, "id long, vec array<double>, grp int, angle double, length double")
        placed.repartition("grp", F.pmod(F.xxhash64("id"), F.lit(SALTS))).write.partitionBy("grp").parquet(f"{path}/vectors")
        stored = spark.read.schema("id long, vec array<double>, angle double, length double, grp int").parquet(f"{path}/vectors")
        stats = stored.groupBy("grp").agg(F.count("*").alias("n"), F.min("angle").alias("inner"), F.max("angle").alias("outer"), F.min("length").alias("short"), F.max("length").alias("long"))
        stats.coalesce(1).write.parquet(f"{path}/groups")
        spark.createDataFrame([(json.dumps(pivots.tolist()),)], "pivots string").coalesce(1).write.parquet(f"{path}/pivots")
        return PivotIndex(spark, path)

    def bounds(self, query: np.ndarray) -> np.ndarray:
        """For each group what no product of the query with its vectors exceeds."""
        g, width = self.groups, max(len(query), self.pivots.shape[1])
        q = np.pad(query, (0, width - len(query)))
        size = np.sqrt(q @ q)
        if not size:
            return np.zeros(len(g))
        p = np.pad(self.pivots, ((0, 0), (0, width - self.pivots.shape[1])))
        to = np.where(g["grp"] >= 0, np.arccos(np.clip(p[np.maximum(g["grp"], 0)] @ q / size, -1, 1)), 0)
        apart = np.clip(np.maximum(to - g["outer"], np.where(g["grp"] >= 0, g["inner"], 0) - to), 0, np.pi)
        cosine = np.cos(apart)
        return np.asarray(size * np.where(cosine >= 0, g["long"], g["short"]) * cosine + SLACK * (1 + size * g["long"]))

    def search(self, query: list[float], ok: DataFrame | None = None, floor: float = V.SEARCH_FLOOR, low: float = V.SEARCH_LOW, band: float = V.SEARCH_BAND, limit: int = V.SEARCH_LIMIT) -> DataFrame:
        """vectors.search over the stored vectors, of those whose id is in `ok` (column id) if given."""
        q = np.array(query, float)
        bounds = self.bounds(q)
        groups = self.groups["grp"].to_numpy()

        def scored(which: np.ndarray) -> DataFrame:
            rows = self.rows.filter(F.col("grp").isin(*[int(x) for x in groups[which]])).select("id", "vec")
            rows = rows if ok is None else rows.join(ok.select("id"), "id", "left_semi")
            return V.scores(rows, q)

        # The group with the highest bound; more, twice as many each time, while `ok` leaves nothing of those read.
        best, order, at, take = None, np.argsort(-bounds, kind="stable"), 0, 1
        while best is None and at < len(order) and bounds[order[at]] >= low:
            best = scored(order[at : at + take]).agg(F.max("score")).first()[0]
            at, take = at + take, 2 * take
        needed = np.flatnonzero(bounds >= max(low, (best if best is not None else -np.inf) - band))
        n = self.groups["n"].to_numpy()
        self.told = {"groups_read": len(needed), "groups": len(groups), "vectors_read": int(n[needed].sum()), "vectors": int(n.sum())}
        found = scored(needed) if len(needed) else self.spark.createDataFrame([], "id long, score double")
        return V.within(found, floor, low, band, limit)
