"""Vector search, zero-shot tags, centroids, and incremental clustering of people."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from medialoom.functions import scalar as S
from medialoom.operators import clustering
from medialoom.operators import media as M
from medialoom.operators.library import numbered, reset_models
from medialoom.session import dropped, materialised, ship

# The floors and bands of a search and of tags, and how many hits and tags there are.
SEARCH_FLOOR, SEARCH_LOW, SEARCH_BAND, SEARCH_LIMIT = 0.20, 0.195, 0.030, 800
TAG_FLOOR, TAG_BAND, TAGS = 0.21, 0.035, 6
#: Bytes of a matrix that is sent to every executor at once; more goes in blocks.
MATRIX_BYTES = 64 * 2**20


def search(vectors: DataFrame, query: list[float], floor: float = SEARCH_FLOOR, low: float = SEARCH_LOW, band: float = SEARCH_BAND, limit: int = SEARCH_LIMIT) -> DataFrame:
    """id, score, rank: nothing if the best is below floor; else what is within band of the best and not below low, the best `limit` of it, best first. vectors: id, vec. All vectors are read; a stored index (see `pivots`) reads those that can be near."""
    return within(scores(vectors, np.array(query, float)), floor, low, band, limit)


def scores(vectors: DataFrame, query: np.ndarray) -> DataFrame:
    """id and score: the product of each vector (the shorter length counts) with the query; none for vectors that are null or hold a null."""

    def run(batches):
        for batch in batches:
            batch = batch.filter(batch.column(1).is_valid())
            m = _rows(batch.column(1)).astype(float)[:, : len(query)]
            score = (np.pad(m, ((0, 0), (0, len(query) - m.shape[1]))) * query).sum(axis=1)  # row by row alike, whatever stands beside it: equal vectors tie
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score)], ["id", "score"])

    ship(vectors.sparkSession)
    ok = vectors.filter(~F.exists("vec", lambda x: x.isNull()))
    return ok.select(F.col("id").cast("long").alias("id"), "vec").mapInArrow(run, "id long, score double")


def within(scored: DataFrame, floor: float, low: float, band: float, limit: int) -> DataFrame:
    """id, score, rank: the relative cut of a search."""
    top = scored.orderBy(F.desc("score"), "id").limit(limit)  # the cut can only shorten it
    best = F.max("score").over(Window.partitionBy(F.lit(0)))  # over `limit` rows
    kept = top.withColumn("best", best).filter((F.col("best") >= floor) & (F.col("score") >= F.col("best") - band) & (F.col("score") >= low))
    return kept.select("id", "score", F.row_number().over(Window.orderBy(F.desc("score"), "id")).alias("rank"))


def search_library(clip, media: DataFrame, query: list[float], **cut) -> DataFrame:
    """The listing of the active items that a query finds, with rank and score: inactive ones are out before the cut, so they take no place. clip: a table (media, vec), or a PivotIndex of one."""
    ok = media.filter(M.active())
    hits = search(clip.withColumnRenamed("media", "id").join(ok.select("id"), "id", "left_semi"), query, **cut) if isinstance(clip, DataFrame) else clip.search(query, ok, **cut)
    return hits.join(M.drawn(ok), "id").select("rank", "id", "score", "ts", "fl", "dur", "w", "h").orderBy("rank")


def _product(rows: pa.Array, matrix: np.ndarray) -> np.ndarray:
    """Products of each vector with each row of the matrix; the shorter length counts, a null vector has none (NaN)."""
    if rows.null_count == 0 and len(rows) and (np.diff(rows.offsets.to_numpy()) == matrix.shape[1]).all():
        flat = rows.flatten()
        if flat.null_count == 0:
            return flat.to_numpy().astype(float).reshape(-1, matrix.shape[1]) @ matrix.T
    out = np.full((len(rows), len(matrix)), np.nan)
    for i, r in enumerate(rows.to_pylist()):
        if r is not None and None not in r:
            n = min(len(r), matrix.shape[1])
            out[i] = matrix[:, :n] @ np.array(r[:n], float)
    return out


def zero_shot_tags(vectors: DataFrame, vocabulary: list[tuple[str, list[float]]], k: int = TAGS, floor: float = TAG_FLOOR, band: float = TAG_BAND) -> DataFrame:
    """id, tag, score, rank: of the k best terms (ties to the earlier one) those over floor and within band of the best. The vocabulary, which the caller holds, goes to the executors as one matrix of MATRIX_BYTES at most; no join and no shuffle."""
    names, matrix = [n for n, _ in vocabulary], np.array([v for _, v in vocabulary], float)
    if matrix.nbytes > MATRIX_BYTES:
        raise ValueError(f"a vocabulary of more than {MATRIX_BYTES} bytes")
    shared = vectors.sparkSession.sparkContext.broadcast((names, matrix))

    def run(batches):
        names, matrix = shared.value
        for batch in batches:
            scores = np.nan_to_num(_product(batch.column(1), matrix), nan=-np.inf) if len(matrix) else np.empty((batch.num_rows, 0))
            order = np.argsort(-scores, axis=1, kind="stable")[:, :k]
            best = np.take_along_axis(scores, order, axis=1)
            ok = (best > floor) & (best > best[:, :1] - band)
            row, place = np.nonzero(ok)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array([names[t] for t in order[ok]], pa.string()), pa.array(best[ok]), pa.array(place.astype(np.int32) + 1)], ["id", "tag", "score", "rank"])

    return vectors.select("id", "vec").mapInArrow(run, "id long, tag string, score double, rank int")


def sums(vectors: DataFrame, keys: list[str]) -> DataFrame:
    """keys (longs), v (the sum of their vectors) and n, exact to 2**-40, so any order of rows gives the same: components are scaled to whole numbers, of which the low 32 bits and the rest are added up apart. A batch gives one row a key, and these are added up by key. Null vectors are left out, null components count as 0, shorter vectors as filled with zeros."""

    def partial(batches):
        for batch in batches:
            batch = batch.filter(batch.column("vec").is_valid())
            if not batch.num_rows:
                continue
            scaled = np.rint(np.nan_to_num(_rows(batch.column("vec"))) * 2.0**40)
            high = np.floor(scaled / 2.0**32)
            at: dict[tuple, int] = {}
            place = np.array([at.setdefault(k, len(at)) for k in zip(*(batch.column(c).to_pylist() for c in keys))])
            total = np.zeros((len(at), 2, scaled.shape[1]), np.int64)
            np.add.at(total, place, np.stack([high, scaled - high * 2.0**32], axis=1).astype(np.int64))
            longest = np.zeros(len(at), np.int64)
            np.maximum.at(longest, place, np.diff(batch.column("vec").offsets.to_numpy()))
            named = [pa.array(c, pa.int64()) for c in zip(*at)]
            both = (pa.array([x[j, :n] for x, n in zip(total, longest)], pa.list_(pa.int64())) for j in (0, 1))
            yield pa.RecordBatch.from_arrays([*named, *both, pa.array(np.bincount(place))], [*keys, "high", "low", "n"])

    def whole(t: pa.Table) -> pa.Table:
        high, low = (_rows(t.column(c)).sum(axis=0) for c in ("high", "low"))
        return pa.table([*(t.column(k).slice(0, 1) for k in keys), pa.array([(high * 2.0**32 + low) / 2.0**40]), pa.array([pc.sum(t.column("n")).as_py()])], [*keys, "v", "n"])

    named = ", ".join(f"{k} long" for k in keys)
    parts = vectors.select(*[F.col(k).cast("long").alias(k) for k in keys], "vec").mapInArrow(partial, f"{named}, high array<long>, low array<long>, n long")
    return parts.groupBy(*keys).applyInArrow(whole, f"{named}, v array<double>, n long")


def _rows(vecs) -> np.ndarray:
    """Vectors as rows, filled with zeros to the longest; whole numbers stay so."""
    vecs = vecs.combine_chunks() if isinstance(vecs, pa.ChunkedArray) else vecs
    sizes = np.diff(vecs.offsets.to_numpy())
    if len(sizes) and (sizes == sizes[0]).all():
        return vecs.flatten().to_numpy(zero_copy_only=False).reshape(len(sizes), -1)
    out = np.zeros((len(vecs), int(sizes.max(initial=0))), np.int64 if pa.types.is_integer(vecs.type.value_type) else float)
    for i, r in enumerate(vecs.to_pylist()):
        out[i, : len(r)] = [0 if x is None else x for x in r]
    return out


def centroids(vectors: DataFrame, key: str) -> DataFrame:
    """Normalised sum of the vectors of each key."""
    return sums(vectors, [key]).select(key, S.l2_normalise(F.col("v")).alias("centroid"))


def nearest(vectors: DataFrame, centres: DataFrame) -> DataFrame:
    """id, centre and score: the nearest of any number of centres (id, vec), ties to the smaller id; a vector that is null or holds a null has none.

    Centres go in blocks of MATRIX_BYTES: every vector meets every block, and the best of the blocks
    counts. One block, the usual case, is sent to the executors and costs no shuffle.
    """
    centres = materialised(centres.select("id", "vec"), "centres")  # read twice or more
    width = centres.agg(F.count("*").alias("n"), F.max(F.size("vec")).alias("d")).first()
    blocks = max(1, -(-width["n"] * max(width["d"] or 0, 1) * 8 // MATRIX_BYTES))
    out = "id long, centre long, score double"

    def best(ids: pa.Array, vecs: pa.Array, keys: np.ndarray, matrix: np.ndarray):
        scores = _product(vecs, matrix)
        at = np.argmax(np.nan_to_num(scores, nan=-np.inf), axis=1)
        score = scores[np.arange(len(at)), at]
        ok = ~np.isnan(score)
        return [ids.filter(pa.array(ok)), pa.array(keys[at[ok]], pa.int64()), pa.array(score[ok])]

    if blocks == 1:
        rows = centres.orderBy("id").collect()  # MATRIX_BYTES at most
        dropped(centres)
        keys, d = np.array([r["id"] for r in rows], np.int64), width["d"] or 0
        shared = vectors.sparkSession.sparkContext.broadcast((keys, _padded([r["vec"] for r in rows], d)))

        def run(batches):
            keys, matrix = shared.value
            for batch in batches:
                if len(keys):
                    yield pa.RecordBatch.from_arrays(best(batch.column(0), batch.column(1), keys, matrix), ["id", "centre", "score"])

        return vectors.select("id", "vec").mapInArrow(run, out)

    def met(vecs: pa.Table, block: pa.Table) -> pa.Table:
        block = block.sort_by("id")
        if not vecs.num_rows or not block.num_rows:
            return pa.schema([("id", pa.int64()), ("centre", pa.int64()), ("score", pa.float64())]).empty_table()
        lists = block.column("vec").to_pylist()
        cols = best(vecs.column("id").combine_chunks(), vecs.column("vec").combine_chunks(), block.column("id").to_numpy(), _padded(lists, max(map(len, lists))))
        return pa.Table.from_arrays(cols, ["id", "centre", "score"])

    shards = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    mine = vectors.select("id", "vec", F.pmod(F.xxhash64("id"), F.lit(shards)).alias("shard"), every(blocks).alias("block"))
    theirs = centres.select("id", "vec", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("shard"), F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"))
    near = mine.groupBy("shard", "block").cogroup(theirs.groupBy("shard", "block")).applyInArrow(met, out)
    first = near.groupBy("id").agg(F.max(F.struct("score", (-F.col("centre")).alias("minus"))).alias("b"))
    return first.select("id", (-F.col("b.minus")).alias("centre"), F.col("b.score").alias("score"))


def _padded(vectors: list, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def encoder(fn):
    """A model's hook: fn maps a list of texts, or of image bytes, to a matrix, one row each; the vectors come normalised, NULL for NULL. A batch is one call."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def encode(values: pd.Series) -> pd.Series:
        out, some = pd.Series([None] * len(values), dtype=object), np.flatnonzero(values.notna().to_numpy())
        if len(some):
            m = np.asarray(fn([values.iloc[i] for i in some]), np.float32)
            m = m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-8)
            for i, v in zip(some, m):
                out.iloc[i] = v
        return out

    return encode


# ---------------------------------------------------------------- people

def cluster(faces: DataFrame, people: DataFrame, threshold: float = 0.42, block: str | None = None, batch: int = clustering.BATCH) -> DataFrame:
    """id and cluster of every face: loose ones join people or each other, in id order; groups of two or more get new ids after the largest, singletons stay NULL; assigned faces never change. Faces whose vector is null or holds a null join nothing.

    block: a column within which people are told apart, such as a library; by default all faces are one block. A block of any size is spread over tasks (see `clustering`). The frame's `rounds` tells how many it took.
    """
    own = F.coalesce(F.col(block).cast("long"), F.lit(-(2**63))) if block else F.lit(0).cast("long")
    faces = faces.select("id", F.col("cluster").cast("long").alias("cluster"), "vec", own.alias("block"))
    usable = F.col("vec").isNotNull() & ~F.exists("vec", lambda x: x.isNull())
    known = sums(faces.filter("cluster IS NOT NULL").filter(usable), ["block", "cluster"]).select("block", F.col("cluster").alias("key"), S.l2_normalise(F.col("v")).alias("vec"), "n")
    loose = faces.filter("cluster IS NULL")
    found, rounds = clustering.greedy(loose.filter(usable).select("block", "id", "vec"), known, threshold, batch)
    large = found.filter("fresh").groupBy("block", "key").count().filter("count > 1").select("block", "key")
    top = people.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top")).first()["top"]
    new = numbered(large, [F.col("block"), F.col("key")], top).withColumn("fresh", F.lit(True))
    joined = found.join(new, ["block", "key", "fresh"], "left").select("id", F.when(F.col("fresh"), F.col("number")).otherwise(F.col("key")).alias("cluster"))
    rest = faces.filter(F.col("cluster").isNotNull() | ~usable).select("id", "cluster")
    out = rest.unionByName(joined)
    out.rounds = rounds
    return out


def recluster(t: dict[str, DataFrame], threshold: float = 0.42, block: str | None = None) -> dict[str, DataFrame]:
    """People found anew from all faces: old groups, names and merges are lost; each new person has a row, without a name, and a cover."""
    t = reset_models(t, "people")
    found = cluster(t["faces"], t["people"], threshold, block).withColumnRenamed("cluster", "n_cluster")
    faces = t["faces"].join(found, "id").withColumn("cluster", F.col("n_cluster")).select(*t["faces"].columns)
    faces = materialised(faces, "faces")
    made = covers(faces).select(F.col("cluster").alias("id"), F.lit("").alias("name"), "cover", F.lit(0).alias("hidden"))
    return t | {"faces": faces, "people": made}


def rename_person(people: DataFrame, person: int, name: str) -> DataFrame:
    return people.withColumn("name", F.when(F.col("id") == person, F.lit(name.strip())).otherwise(F.col("name")))


def large_enough(faces: DataFrame, pixels: float = 32) -> DataFrame:
    """Faces whose box (x, y, w, h as parts of the image, image_w in pixels) is wide enough to be told apart."""
    return faces.filter(F.col("w") * F.col("image_w") >= pixels)


def refreshed_covers(people: DataFrame, faces: DataFrame) -> DataFrame:
    """people with the best face as cover where they have none, or one that is no longer theirs."""
    own = faces.filter("cluster IS NOT NULL").select(F.col("cluster").alias("id"), F.col("id").alias("cover"), F.lit(True).alias("_valid")).distinct()
    out = people.join(own, ["id", "cover"], "left").join(covers(faces).select(F.col("cluster").alias("id"), F.col("cover").alias("_best")), "id", "left")
    return out.withColumn("cover", F.when(F.col("_valid"), F.col("cover")).otherwise(F.col("_best"))).select(*people.columns)


def covers(faces: DataFrame) -> DataFrame:
    """Each person's best face."""
    return faces.filter("cluster IS NOT NULL").groupBy("cluster").agg(F.max_by("id", F.struct("score", (-F.col("id")).alias("i"))).alias("cover"))


def merge_people(faces: DataFrame, people: DataFrame, ids: list[int], into: int) -> tuple[DataFrame, DataFrame]:
    """Faces move to `into`; it takes the first name in the order of ids if it has none; its centroid is the mean of all its faces."""
    if len(ids) < 2 or into not in ids:
        raise ValueError("two people or more, the one that stays among them")
    moved = faces.withColumn("cluster", F.when(F.col("cluster").isin(*ids), F.lit(into)).otherwise(F.col("cluster")))
    rank = F.array_position(F.array(*[F.lit(i) for i in ids]), F.col("id"))
    heir = people.filter(F.col("id").isin(*ids) & (F.trim("name") != "")).agg(F.min_by("name", rank).alias("heir")).withColumn("one", F.lit(1))
    out = people.filter(~F.col("id").isin(*[i for i in ids if i != into])).withColumn("one", F.lit(1)).join(heir, "one", "left")
    name = F.when((F.col("id") == into) & (F.trim("name") == ""), F.coalesce("heir", "name")).otherwise(F.col("name"))
    kept = out.withColumn("name", name).drop("one", "heir", "centroid")
    return moved, kept.join(centroids(moved.filter(F.col("cluster") == into), "cluster").withColumnRenamed("cluster", "id"), "id", "left")


def merge_target(people: DataFrame) -> DataFrame:
    """Of the people picked (id, name, items): the only named one, else the one with most items."""
    named = F.count_if(F.col("name") != "")
    only = F.max(F.when(F.col("name") != "", F.col("id")))
    return people.agg(F.when(named == 1, only).otherwise(F.max_by("id", F.struct("items", (-F.col("id")).alias("i")))).alias("into"))
