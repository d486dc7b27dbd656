"""Greedy clustering in the order of ids, exact and in parallel: speculation over batches.

The rule: a vector joins the centre with the largest product over the threshold, which moves to
the running mean; else it begins a centre.  Each choice depends on all before, but only on
centres that these have moved.  So in a round the next BATCH vectors of every block are scored against
the centres as they stand, in shards on all executors (almost all of the work), and each keeps
its CANDIDATES best over the threshold.  Then the choices of a block's batch are made in order:
a centre that the batch has not moved still has its score, one that it has moved, or
begun, is multiplied again.  If all of a vector's candidates have moved, and its list was cut, and no
moved centre beats the last on the list, its best centre is not known: the choices before it are kept, and it
begins the next round.  The first vector of a batch is always decided.

No task holds a block: a batch, its candidates and the centres among these are what the deciding
task gets.  Vectors, centres and choices are written tables; of each round only the number of blocks still at
work comes to the driver.
"""

from __future__ import annotations

import logging

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from medialoom.operators import scan
from medialoom.session import dropped, materialised

BATCH, CANDIDATES = 4096, 8
#: Centres of a shard.
SHARD = 4096


def matrix(vecs: pa.ChunkedArray) -> np.ndarray:
    """Vectors as rows; shorter ones are filled with zeros."""
    rows = vecs.combine_chunks() if isinstance(vecs, pa.ChunkedArray) else vecs
    sizes = np.diff(rows.offsets.to_numpy()) if len(rows) else np.zeros(0, int)
    if len(rows) and (sizes == sizes[0]).all():
        return rows.flatten().to_numpy().astype(float).reshape(len(rows), -1)
    out = np.zeros((len(rows), int(sizes.max(initial=0))))
    for i, r in enumerate(rows.to_pylist()):
        out[i, : len(r)] = r
    return out


def _same_width(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    d = max(a.shape[1], b.shape[1])
    return tuple(x if x.shape[1] == d else np.pad(x, ((0, 0), (0, d - x.shape[1]))) for x in (a, b))


_LISTED = pa.list_(pa.struct([("score", pa.float64()), ("fresh", pa.bool_()), ("key", pa.int64())]))


def _candidates(threshold: float, k: int):
    """The k best centres over the threshold of a shard, for each vector of a batch; ties to the known ones, then to the smaller key."""

    def run(vecs: pa.Table, centres: pa.Table) -> pa.Table:
        lists = [[] for _ in range(vecs.num_rows)]
        if centres.num_rows and vecs.num_rows:
            centres = centres.sort_by([("fresh", "ascending"), ("key", "ascending")])
            a, b = _same_width(matrix(vecs.column("vec")), matrix(centres.column("vec")))
            scores = a @ b.T
            fresh, keys = centres.column("fresh").to_pylist(), centres.column("key").to_pylist()
            row, col = np.nonzero(scores > threshold)
            order = np.lexsort((col, -scores[row, col], row))
            row, col = row[order], col[order]
            place = np.arange(len(row)) - np.searchsorted(row, row)
            for i, j in zip(row[place < k].tolist(), col[place < k].tolist()):
                lists[i].append({"score": float(scores[i, j]), "fresh": fresh[j], "key": keys[j]})
        return pa.table({"block": vecs.column("block"), "place": vecs.column("place"), "near": pa.array(lists, _LISTED)})

    return run


class _Moved:
    """The centres that a batch has moved or begun, in the order of their keys of comparison."""

    def __init__(self, width: int):
        self.rows, self.at, self.names, self.counts = np.zeros((16, width)), {}, [], []

    def put(self, name: tuple, vec: np.ndarray, n: int) -> None:
        i = self.at.setdefault(name, len(self.names))
        if i == len(self.names):
            self.names.append(name)
            self.counts.append(0)
            if i == len(self.rows):
                self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        self.rows[i], self.counts[i] = vec, n

    def best(self, v: np.ndarray):
        """(score, name) of the nearest; ties to the least name."""
        if not self.names:
            return -np.inf, None
        scores = self.rows[: len(self.names)] @ v
        top = scores.max()
        return float(top), min(self.names[i] for i in np.flatnonzero(scores == top))


def _decided(threshold: float, k: int):
    """The choices of a block's batch that are certain, the centres that they move, and where the next batch begins."""

    def run(faces: pa.Table, centres: pa.Table) -> pa.Table:
        faces = faces.sort_by("place")
        block = faces.column("block")[0].as_py() if faces.num_rows else None
        vecs, frozen = matrix(faces.column("vec")), {}
        if centres.num_rows:
            vecs, rows = _same_width(vecs, matrix(centres.column("vec")))
            frozen = {x: (row, n) for *x, row, n in zip(centres.column("fresh").to_pylist(), centres.column("key").to_pylist(), rows, centres.column("n").to_pylist()) for x in [tuple(x)]}
        moved, chosen = _Moved(vecs.shape[1] if len(vecs) else 0), []
        for v, face, place, near in zip(vecs, faces.column("id").to_pylist(), faces.column("place").to_pylist(), faces.column("near").to_pylist()):
            score, name = moved.best(v)
            still = next((c for c in near if (c["fresh"], c["key"]) not in moved.at), None)
            if still is not None:
                other = (still["score"], (still["fresh"], still["key"]))
                if other[0] > score or (other[0] == score and other[1] < name):
                    score, name = other
            elif len(near) == k and score <= near[-1]["score"]:
                break
            if name is None or score <= threshold:
                name = (True, place)
                moved.put(name, v, 1)
            else:
                c, n = (moved.rows[moved.at[name]], moved.counts[moved.at[name]]) if name in moved.at else frozen[name]
                mean = (c * n + v) / (n + 1)
                moved.put(name, mean / max(float(np.sqrt(mean @ mean)), 1e-8), n + 1)
            chosen.append((place, face, *name))
        m, c = len(moved.names), len(chosen)
        return pa.table(
            {
                "block": pa.array([block] * (m + c), pa.int64()),
                "place": pa.array([x[0] for x in chosen] + [None] * m, pa.int64()),
                "id": pa.array([x[1] for x in chosen] + [None] * m, pa.int64()),
                "fresh": pa.array([x[2] for x in chosen] + [x[0] for x in moved.names], pa.bool_()),
                "key": pa.array([x[3] for x in chosen] + [x[1] for x in moved.names], pa.int64()),
                "vec": pa.array([None] * c + list(moved.rows[:m]), pa.list_(pa.float64())),
                "n": pa.array([None] * c + moved.counts, pa.int64()),
            }
        )

    return run


_STEP = "block long, place long, id long, fresh boolean, key long, vec array<double>, n long"


def _best(k: int):
    """The k best of all shards' candidates."""
    better = lambda a, b: F.when(a["score"] > b["score"], -1).when(a["score"] < b["score"], 1).when(F.struct(a["fresh"], a["key"]) < F.struct(b["fresh"], b["key"]), -1).otherwise(1)
    return F.slice(F.array_sort(F.flatten(F.collect_list("near")), better), 1, k)


def greedy(faces: DataFrame, known: DataFrame, threshold: float, batch: int = BATCH, candidates: int = CANDIDATES) -> tuple[DataFrame, int]:
    """faces: block, id, vec; known: block, key, vec, n, the centres there are; none has nulls. Returns block, id, fresh and key of each face's centre (one that begins has the place of its first face as key), and the number of rounds. The caller drops the frame when it has read it."""
    spark = faces.sparkSession
    faces = materialised(scan.places(faces, ["block"], [F.col("id")]), "greedy-faces")
    centres = materialised(known.select("block", F.lit(False).alias("fresh"), "key", "vec", F.col("n").cast("long").alias("n")), "greedy-centres")
    todo = materialised(faces.groupBy("block").agg(F.max("place").alias("last"), F.lit(1).cast("long").alias("next")), "greedy-todo")
    steps = []
    while True:
        low, high, left = todo.agg(F.min("next"), F.max("next"), F.count("*")).first()
        if not left:
            break
        held = centres.groupBy("block").agg(F.count("*").alias("held"))
        now = todo.join(held, "block", "left").select("block", "next", F.ceil(F.coalesce("held", F.lit(1)) / SHARD).alias("shards"))
        own = faces.filter(F.col("place").between(low, high + batch - 1)).join(now, "block").filter((F.col("place") >= F.col("next")) & (F.col("place") < F.col("next") + batch))
        mine = own.select("block", "place", "vec", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shards") - 1)).alias("shard"))
        theirs = centres.join(now, "block").withColumn("shard", F.pmod(F.xxhash64("fresh", "key"), "shards"))
        near = mine.groupBy("block", "shard").cogroup(theirs.groupBy("block", "shard")).applyInArrow(_candidates(threshold, candidates), "block long, place long, near array<struct<score double, fresh boolean, key long>>")
        near = materialised(near.groupBy("block", "place").agg(_best(candidates).alias("near")), "greedy-near")
        wanted = near.select("block", F.explode("near").alias("c")).select("block", "c.fresh", "c.key").distinct()
        asked = own.select("block", "place", "id", "vec").join(near, ["block", "place"])
        some = centres.join(wanted, ["block", "fresh", "key"], "left_semi")
        steps.append(materialised(asked.groupBy("block").cogroup(some.groupBy("block")).applyInArrow(_decided(threshold, candidates), _STEP), "greedy-step"))
        chosen, moved = steps[-1].filter("n IS NULL"), steps[-1].filter("n IS NOT NULL").select("block", "fresh", "key", "vec", "n")
        done = chosen.groupBy("block").agg((F.max("place") + 1).alias("next"))
        before = [near, todo, centres]
        todo = materialised(todo.drop("next").join(done, "block").filter("next <= last").select("block", "last", "next"), "greedy-todo")
        centres = materialised(centres.join(moved.select("block", "fresh", "key"), ["block", "fresh", "key"], "left_anti").unionByName(moved), "greedy-centres")
        dropped(*before)
    logging.getLogger(__name__).info("greedy clustering: %d rounds", len(steps))
    every = spark.read.schema(_STEP).parquet(*[x.saved_at for x in steps]) if steps else spark.createDataFrame([], _STEP)
    out = materialised(every.filter("n IS NULL").select("block", "id", "fresh", "key"), "greedy")
    dropped(faces, centres, todo, *steps)
    return out, len(steps)
