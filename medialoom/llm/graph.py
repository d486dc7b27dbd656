"""Connected components of an edge table, by contraction in random order."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from medialoom.llm.common import dropped, saved

#: Edges that one task takes.
FINISH = 1 << 18


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for each end of an edge (a, b); component is the smallest node reachable.

    In each round every node moves to the one of its neighbourhood, itself included, whose hash
    under the round's seed is smallest; edges follow, and edges within a node go.  As the order
    is random, a constant part of the nodes is left from round to round whatever the graph, a
    path in the order of its ids too, so there are O(log n) rounds.  When FINISH edges or fewer are
    left (4 MB), one task finishes them: rounds over next to nothing would cost more than all
    before. Frames are written to the shared folder, so lineage stays short and nothing is collected.  The moves are put together
    from the last round, the smallest, back to the first.  Joins are merge joins: small files of
    well-compressed ids would be taken for small tables and broadcast, whatever their number of
    rows.  A node with very many edges is pre-aggregated by groupBy; every join reads written
    tables or other joins, never an aggregate, so adaptive execution can split a node's rows.
    """
    edges = saved(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct(), "cc-edges")
    moves = []
    while left := edges.count():
        if left <= FINISH:
            moves.append(saved(edges.coalesce(1).mapInArrow(_finished, "node long, to long"), "cc-moves"))
            break
        seed = F.lit(len(moves))
        ranked = lambda c: F.struct(F.xxhash64(c, seed), F.col(c).alias("node"))  # noqa: B023, E731
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        best = both.groupBy("a").agg(F.min(ranked("b")).alias("best"))
        moves.append(saved(best.select(F.col("a").alias("node"), _least(ranked("a"), F.col("best"))["node"].alias("to")), "cc-moves"))
        ma, mb = moves[-1].toDF("a", "ma"), moves[-1].toDF("b", "mb")
        after = edges.join(ma.hint("merge"), "a").join(mb.hint("merge"), "b").filter("ma <> mb")
        after = saved(after.select(F.least("ma", "mb").alias("a"), F.greatest("ma", "mb").alias("b")).distinct(), "cc-edges")
        dropped(edges)
        edges = after
    if not moves:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    if len(moves) == 1 and left:  # the last step alone moves to the smallest
        return moves[0].toDF("node", "component")
    root = moves[-1]
    for move in reversed(moves[:-1]):
        root = move.join(root.toDF("to", "next").hint("merge"), "to", "left").select("node", F.coalesce("next", "to").alias("to"))
    root = saved(root, "cc-roots")
    lowest = saved(root.groupBy("to").agg(F.min("node").alias("component")), "cc-lowest")
    dropped(edges, *moves)
    return root.join(lowest.hint("merge"), "to").select("node", "component")


def _finished(batches):
    """node, to: the smallest node of the component of each, for the whole of a few edges."""
    parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
    if not parts:
        return
    nodes, ends = np.unique(np.concatenate([np.concatenate(x) for x in zip(*parts)]), return_inverse=True)
    u, v = ends[: len(ends) // 2], ends[len(ends) // 2 :]
    label = np.arange(len(nodes))
    while True:  # labels hook to the smaller one across every edge, then go to the end of their chain
        new = label.copy()
        np.minimum.at(new, label[u], label[v])
        np.minimum.at(new, label[v], label[u])
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[label])], ["node", "to"])


def _least(x: Column, y: Column) -> Column:
    return F.when(x < y, x).otherwise(y)
