"""Exact top-k search by inner product, with norm-bucketed pruning.

Vectors are dealt into shards by hash, so every shard has long and short ones.  In a shard
they are sorted by length and cut into buckets.  From a query's k-th best score so far and a
bucket's greatest length follows the least cosine that a vector of the bucket needs; above 1
the query skips the bucket and, as lengths fall, all later ones.  If it is high, coordinate
pruning is chosen: the query's largest coordinates give a partial product, the rest is
bounded by the lengths of the remainders, and only vectors whose bound reaches the score are
multiplied out.  Otherwise length pruning: the bucket's vectors that are long enough.  All
scores that count are exact integer products, in doubles where these hold them.

Queries go in blocks of QUERIES to every shard, shards to every block: the exact search of a
stated query set, in blocks of bounded size.  Each task returns its own k best of a query,
and these are ranked.

Defined results: vectors that are null, or hold a null or a component that is not finite, take
no part; shorter vectors count as filled with zeros; a query's candidates are all rows but
its own; rows that repeat a vec_id are separate candidates and separate queries, each with
its own k ranks, repeated rows too; very long vectors are taken whole; columns other than
vec_id and embedding are not looked at, whatever their names; ties go to the smaller vec_id; null vec_ids take no part; an empty table gives an
empty one; scores are exact (those that a double might not hold come from Python's integers),
and count as the ends of a long's range beyond it.
"""

from __future__ import annotations

import heapq
import operator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from medialoom.llm.common import shuffle_partitions
from medialoom.session import ship

SHARD, QUERIES, BUCKET = 8192, 2048, 512
#: From this least cosine on, coordinate pruning; FOCUS coordinates are multiplied first.
HIGH_COSINE, FOCUS = 0.7, 8


def whole_vectors(vectors: DataFrame, scale: float = 256.0) -> DataFrame:
    """vec_id and v: floor(scale * x) of each component, of the vectors that take part."""
    v = F.transform("embedding", lambda x: x.cast("double"))

    def usable(x: Column) -> Column:
        return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))

    df = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).filter("vec_id IS NOT NULL AND v IS NOT NULL").filter(F.forall("v", usable))
    return df.select("vec_id", F.transform("v", lambda x: F.floor(x * scale).cast("double")).alias("v"))


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    rows = column.combine_chunks()
    out = np.zeros((len(rows), width))
    sizes = np.diff(rows.offsets.to_numpy())
    if len(rows) and (sizes == width).all():
        return rows.flatten().to_numpy().reshape(-1, width)
    for i, r in enumerate(rows.to_pylist()):
        out[i, : len(r)] = r
    return out


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of a row of scores, ties to the smaller id."""
    if len(scores) > k:
        near = np.flatnonzero(scores >= np.partition(scores, -k)[-k])
        scores, ids = scores[near], ids[near]
    order = np.lexsort((ids, -scores))[:k]
    return scores[order], ids[order]


def search_shard(q: np.ndarray, c: np.ndarray, c_ids: np.ndarray, k: int):
    """For each query its k best rows, its own one too: lists of (scores, ids)."""
    c_len, q_len = np.sqrt((c * c).sum(axis=1)), np.sqrt((q * q).sum(axis=1))
    order = np.argsort(-c_len, kind="stable")
    c, c_ids, c_len = c[order], c_ids[order], c_len[order]
    found = [(np.empty(0), np.empty(0, np.int64))] * len(q)
    least = np.full(len(q), -np.inf)  # a new score must reach it
    focus = np.argsort(-np.abs(q), axis=1)[:, : min(FOCUS, q.shape[1])]
    for lo in range(0, len(c), BUCKET):
        own, own_ids, own_len = c[lo : lo + BUCKET], c_ids[lo : lo + BUCKET], c_len[lo : lo + BUCKET]
        slack = 1 + 1e-9  # lengths are rounded
        active = np.flatnonzero(least <= q_len * own_len[0] * slack)
        if not len(active):
            break
        with np.errstate(divide="ignore", invalid="ignore"):
            cosine = np.where(q_len[active] * own_len[0] > 0, least[active] / (q_len[active] * own_len[0]), -1)
        by_length, by_coordinate = active[cosine < HIGH_COSINE], active[cosine >= HIGH_COSINE]
        parts = []
        if len(by_length):
            with np.errstate(divide="ignore", invalid="ignore"):
                need = np.where(q_len[by_length] > 0, least[by_length] / q_len[by_length], -np.inf).min()
            n = int(np.searchsorted(-own_len, -need / slack, "right")) if need > 0 else len(own)
            scores = q[by_length] @ own[:n].T
            parts = [(i, s, own_ids[:n]) for i, s in zip(by_length.tolist(), scores)]
        for i in by_coordinate.tolist():
            f = focus[i]
            head = own[:, f] @ q[i, f]
            c_rest = np.sqrt(np.maximum(own_len**2 - (own[:, f] ** 2).sum(axis=1), 0))
            q_rest = np.sqrt(max(q_len[i] ** 2 - (q[i, f] ** 2).sum(), 0))
            near = np.flatnonzero(head + c_rest * q_rest * slack + 1e-6 * q_len[i] * own_len >= least[i])
            parts.append((i, own[near] @ q[i], own_ids[near]))
        for i, scores, ids in parts:
            keep = scores >= least[i]
            if keep.any():
                found[i] = _best(np.concatenate([found[i][0], scores[keep]]), np.concatenate([found[i][1], ids[keep]]), k)
                if len(found[i][0]) == k:
                    least[i] = found[i][0][-1]
    return found


def _exact(a: list[int], b: list[int]) -> int:
    return max(-(2**63), min(2**63 - 1, sum(map(operator.mul, a, b))))


def search_exactly(q: np.ndarray, c: np.ndarray, c_ids: np.ndarray, k: int):
    """The same by Python's integers, where a product need not be exact as a double; scores beyond a long's range count as its ends."""
    rows, found = [list(map(int, v)) for v in c], []
    for v in q:
        own = list(map(int, v))
        scores = ((_exact(own, r), j) for r, j in zip(rows, c_ids.tolist()))
        best = heapq.nsmallest(k, ((-s, j) for s, j in scores))
        found.append(([-s for s, _ in best], np.array([j for _, j in best], np.int64)))
    return found


_OUT = pa.schema([("query", pa.int64()), ("query_id", pa.int64()), ("own", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def _task(k: int):
    def run(candidates: pa.Table, queries: pa.Table) -> pa.Table:
        empty = _OUT.empty_table()
        if not candidates.num_rows or not queries.num_rows:
            return empty
        width = max(int(pc.max(pc.list_value_length(x)).as_py()) for x in (candidates.column("v"), queries.column("w")))
        c, q = _matrix(candidates.column("v"), width), _matrix(queries.column("w"), width)
        exactly = float(np.abs(q).sum(axis=1).max()) * max(float(np.abs(c).max(initial=0)), float(np.abs(q).max(initial=0))) >= 2**53
        own = np.array([_exact(v, v) for v in (list(map(int, x)) for x in q)], np.int64) if exactly else (q * q).sum(axis=1).astype(np.int64)
        # one more than k: the query's own row is taken out when all shards' lists are together
        found = (search_exactly if exactly else search_shard)(q, c, candidates.column("vec_id").to_numpy(), k + 1)
        n = [len(ids) for _, ids in found]
        if not sum(n):
            return empty
        mine = [np.repeat(x, n) for x in (queries.column("query").to_numpy(), queries.column("query_id").to_numpy(), own)]
        return pa.Table.from_arrays([*map(pa.array, mine), pa.array(np.concatenate([ids for _, ids in found])), pa.array(np.concatenate([np.asarray(s, np.int64) for s, _ in found]))], schema=_OUT)

    return run


def search(vectors: DataFrame, queries: Column, k: int = 5) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k best of every query (rows of `vectors` where the condition holds) among all other rows."""
    spark = vectors.sparkSession
    ship(spark)
    vecs = whole_vectors(vectors)
    size = vecs.agg(F.count("*").alias("n"), F.count_if(queries).alias("q")).first()
    shards, blocks = max(shuffle_partitions(spark), -(-size["n"] // SHARD)), max(1, -(-size["q"] // QUERIES))
    # The row's number spreads rows that are equal too.
    mine = lambda n: F.pmod(F.xxhash64("vec_id", "v", F.monotonically_increasing_id()), F.lit(n)).cast("int")
    numbers = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    c = vecs.select("vec_id", "v", mine(shards).alias("shard")).withColumn("block", numbers(blocks))
    q = vecs.filter(queries).select(F.col("vec_id").alias("query_id"), F.col("v").alias("w"), mine(blocks).alias("block"), F.monotonically_increasing_id().alias("query")).withColumn("shard", numbers(shards))
    near = c.groupBy("shard", "block").cogroup(q.groupBy("shard", "block")).applyInArrow(_task(k), "query long, query_id long, own long, vec_id long, score long")
    # Of the rows that score as the query with itself and share its id, one is the query; which does not show.
    same = (F.col("vec_id") == F.col("query_id")) & (F.col("score") == F.col("own"))
    near = near.withColumn("same", same).withColumn("turn", F.row_number().over(Window.partitionBy("query", "same").orderBy(F.desc("score"), "vec_id")))
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))
    return near.filter("not same or turn > 1").withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
