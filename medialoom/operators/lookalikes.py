"""Items whose perceptual hashes differ in a few bits: exact, by multi-index hashing.

Equal hashes are one node from the start.  A hash is cut into radius + 2 slices; two hashes within
the radius differ in at most `radius` slices, so they agree in two or more.  Hashes meet by
(slice, value).  Where more than BLOCK meet, they meet by pairs of slices instead, which any
two hashes within the radius that share the hot slice do as well.  Where even these are more, they are cut
into blocks of BLOCK, and every two blocks meet in a task.  A meeting compares all its hashes by
popcount and gives a spanning forest of what is near, never all pairs.  Groups are the
connected components.

A null hash and 0 (no picture) are near nothing, themselves included.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from medialoom.operators import storage
from medialoom.operators.components import components
from medialoom.session import materialised, ship

#: Hashes that a meeting compares.
BLOCK = 1024


def slices(h: Column, n: int) -> list[Column]:
    """A 64-bit hash cut into n slices of about equal length."""
    cuts = [64 * k // n for k in range(n + 1)]
    return [F.shiftrightunsigned(h, lo).bitwiseAND((1 << (hi - lo)) - 1) for lo, hi in zip(cuts, cuts[1:])]


def _forest(radius: int):
    """Edges (a, b) of a spanning forest of the hashes of a meeting that are within the radius."""

    def run(t: pa.Table) -> pa.Table:
        h = np.unique(t.column("h").to_numpy())
        bits, rest = h.view(np.uint64), np.arange(len(h))
        a, b = [], []
        while len(rest):
            todo, rest = [int(rest[0])], rest[1:]
            while todo and len(rest):
                i = todo.pop()
                near = np.bitwise_count(bits[rest] ^ bits[i]) <= radius
                found = rest[near].tolist()
                a += [i] * len(found)
                b += found
                todo += found
                rest = rest[~near]
        return pa.table({"a": h[a] if a else np.empty(0, np.int64), "b": h[b] if b else np.empty(0, np.int64)})

    return run


def _met(rows: DataFrame, radius: int) -> DataFrame:
    """rows: key (a struct), h: the edges of each key's meeting."""
    return rows.groupBy("key").applyInArrow(_forest(radius), "a long, b long")


def _counted(rows: DataFrame) -> DataFrame:
    """rows with n, how many share the key; counts are written before they are joined, so a hot key can be split."""
    n = materialised(rows.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"), "slice-counts")
    return materialised(rows.join(n.hint("merge"), "key"), "slices")


def near_hashes(hashes: DataFrame, radius: int) -> DataFrame:
    """(node, component) of the distinct hashes (column h) that have another one within `radius` bits, directly or over others; component is the smallest of them."""
    ship(hashes.sparkSession)
    if not 0 <= radius <= 30:
        raise ValueError("a radius from 0 to 30")
    parts = slices(F.col("h"), radius + 2)
    key = lambda k, x, m, y: F.struct(F.lit(k).alias("i"), x.alias("x"), F.lit(m).alias("j"), y.alias("y"), F.lit(0).alias("block"), F.lit(0).alias("other"))
    none = F.lit(-1).cast("long")
    single = F.explode(F.array(*[key(k, x, -1, none) for k, x in enumerate(parts)])).alias("key")
    one = _counted(hashes.select("h", single))
    hot = one.filter(F.col("n") > BLOCK)
    # the hot slice with each other one, in the order of the slices
    pair = lambda k, m: key(min(k, m), parts[min(k, m)], max(k, m), parts[max(k, m)])
    with_others = F.explode(F.when(F.lit(True), F.array(*[F.when((F.col("key.i") == k), pair(k, m)) for k in range(len(parts)) for m in range(len(parts)) if m != k]))).alias("key")
    two = _counted(hot.select("h", with_others).filter("key IS NOT NULL").distinct())
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("h"), blocks).cast("int")
    dense = two.filter(F.col("n") > BLOCK).select("h", "key", own.alias("own"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("with"))
    spread = dense.select("h", F.struct("key.i", "key.x", "key.j", "key.y", F.least("own", "with").alias("block"), F.greatest("own", "with").alias("other")).alias("key"))
    met = one.filter(F.col("n") <= BLOCK).select("h", "key").unionByName(two.filter(F.col("n") <= BLOCK).select("h", "key")).unionByName(spread)
    return components(_met(met, radius))


def look_groups(media: DataFrame, radius: int, key: str = "dhash") -> DataFrame:
    """media with `look`: of active items with a hash, the smallest hash reachable over steps of `radius` bits or less, their own if there is no other; null for other items."""
    ok = storage.candidates(media, key)
    found = materialised(near_hashes(ok.select(F.col(key).cast("long").alias("h")).distinct(), radius), "looks").withColumnRenamed("node", key)
    return ok.join(found.hint("merge"), key, "left").withColumn("look", F.coalesce("component", key)).drop("component")


def look_alikes(media: DataFrame, radius: int, key: str = "dhash") -> DataFrame:
    """Items that look alike within `radius` bits: id, bytes, look, keep (the largest, then the newest, then the smallest id), n and freed of their group, as storage.duplicates has them for equal hashes."""
    return storage.duplicates(look_groups(media, radius, key), "look")
