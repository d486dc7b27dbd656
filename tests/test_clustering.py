"""Parallel greedy clustering against the plain loop, and exact sums."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from medialoom.operators import clustering, vectors


def loop(vecs, known, threshold):
    """Index of each vector's centre, known ones (vec, n) first."""
    rows = np.zeros((len(known) + len(vecs), vecs.shape[1]))
    counts, n, out = np.zeros(len(rows)), len(known), []
    for i, (c, k) in enumerate(known):
        rows[i], counts[i] = c, k
    for v in vecs:
        scores = rows[:n] @ v
        at = int(scores.argmax()) if n else -1
        if n and scores[at] > threshold:
            mean = (rows[at] * counts[at] + v) / (counts[at] + 1)
            rows[at] = mean / max(float(np.sqrt(mean @ mean)), 1e-8)
            counts[at] += 1
        else:
            at, n = n, n + 1
            rows[at], counts[at] = v, 1
        out.append(at)
    return out


def unit(v):
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def around(rng, people, n, dim, spread):
    return unit(unit(rng.normal(size=(people, dim)))[rng.integers(0, people, n)] + spread * rng.normal(size=(n, dim)))


def as_labels(chosen, n_known):
    """Equal centres get equal labels, in the order of their first faces."""
    seen = {}
    return [("k", c) if c < n_known else ("f", seen.setdefault(c, len(seen))) for c in chosen]


def frame(spark, blocks):
    rows = [(b, 10 * i + b, v.tolist()) for b, vecs in blocks.items() for i, v in enumerate(vecs)]
    return spark.createDataFrame(rows, "block long, id long, vec array<double>").repartition(5)


@pytest.mark.parametrize("batch, candidates, shard, spread", [(20, 1, 3, 0.5)])
def test_speculation_is_the_loop(spark, monkeypatch, batch, candidates, shard, spread):
    monkeypatch.setattr(clustering, "SHARD", shard)
    rng = np.random.default_rng(batch)
    sizes = {0: 60, 1: 3, 2: 25} if batch > 1 else {0: 4, 1: 2}
    blocks = {b: around(rng, 9, n, 6, spread) for b, n in sizes.items()}
    known = {0: [(v, k + 1) for k, v in enumerate(unit(rng.normal(size=(3, 6))))], 1: []} | ({2: [(blocks[2][0], 2)]} if 2 in blocks else {})
    df = spark.createDataFrame([(b, 100 + j, v.tolist(), n) for b, rows in known.items() for j, (v, n) in enumerate(rows)], "block long, key long, vec array<double>, n long")
    out, rounds = clustering.greedy(frame(spark, blocks), df, 0.55, batch, candidates)
    got = {}
    for r in out.collect():
        got[r["block"], r["id"]] = (r["fresh"], r["key"])
    assert len(got) == sum(sizes.values()) and rounds >= -(-max(sizes.values()) // batch)
    for b, vecs in blocks.items():
        mine = [got[b, 10 * i + b] for i in range(len(vecs))]
        names = {}
        labels = [("k", k - 100) if not fresh else ("f", names.setdefault(k, len(names))) for fresh, k in mine]
        assert labels == as_labels(loop(vecs, known[b], 0.55), len(known[b]))


def test_one_block_of_100_000(spark):
    """Equal to the loop, in few rounds, and no task holds the block."""
    rng = np.random.default_rng(5)
    vecs = around(rng, 300, 100_000, 16, 0.12).astype(np.float32).astype(float)
    path = "greedy-" + "block"
    import tempfile

    import pyarrow as pa
    import pyarrow.parquet as pq

    with tempfile.TemporaryDirectory() as d:
        pq.write_table(pa.table({"block": np.zeros(len(vecs), np.int64), "id": np.arange(len(vecs)), "vec": list(vecs)}), f"{d}/{path}.parquet")
        df = spark.read.parquet(f"{d}/{path}.parquet")
        none = spark.createDataFrame([], "block long, key long, vec array<double>, n long")
        sizes = []
        real = clustering._decided
        clustering._decided = lambda *a: sizes.append(a) or real(*a)
        try:
            out, rounds = clustering.greedy(df, none, 0.6, batch=20_000)
        finally:
            clustering._decided = real
        got = {r["id"]: r["key"] for r in out.collect()}
    want = loop(vecs, [], 0.6)
    first = {}
    for i, c in enumerate(want):
        first.setdefault(c, i + 1)
    assert [got[i] for i in range(len(vecs))] == [first[c] for c in want]
    assert rounds <= 8 and len(sizes) == rounds


def test_a_cut_list_of_moved_candidates_ends_the_batch():
    """With one candidate a face, a face whose candidate has moved cannot be decided unless what moved beats it."""
    import pyarrow as pa

    vecs = unit(np.array([[1, 0, 0.2], [1, 0.5, 0.0], [0, 0, 1.0]]))
    near = [[{"score": 0.9, "fresh": False, "key": 1}], [{"score": 0.99, "fresh": False, "key": 1}], []]
    faces = pa.table({"block": [0] * 3, "place": [1, 2, 3], "id": [5, 6, 7], "vec": list(vecs), "near": near})
    centres = pa.table({"block": [0], "fresh": [False], "key": [1], "vec": [[0.0, 1.0, 0.0]], "n": [50]})
    out = clustering._decided(0.5, 1)(faces, centres).to_pylist()
    assert [r["place"] for r in out if r["n"] is None] == [1] and [r["n"] for r in out if r["n"] is not None] == [51]
    assert [r["place"] for r in clustering._decided(0.5, 2)(faces, centres).to_pylist() if r["n"] is None] == [1, 2, 3]


def test_clusters_of_odd_faces(spark):
    rows = [(1, None, [1.0, 0.0], None), (2, None, [1.0, 0.1], None), (3, None, None, 1), (4, None, [None, 1.0], 1), (5, 9, None, 1), (6, None, [1.0, 0.0], 1)]
    f = spark.createDataFrame(rows, "id long, cluster long, vec array<float>, lib long")
    people = spark.createDataFrame([(9,)], "id long")
    got = {r["id"]: r["cluster"] for r in vectors.cluster(f, people, block="lib").collect()}
    assert got == {1: 10, 2: 10, 3: None, 4: None, 5: 9, 6: None}
    assert {r["id"]: r["cluster"] for r in vectors.cluster(f, people).collect()} == {1: 10, 2: 10, 3: None, 4: None, 5: 9, 6: 10}
    assert vectors.cluster(f.limit(0), people).count() == 0


def test_sums_are_exact(spark):
    from fractions import Fraction

    rng = np.random.default_rng(2)
    vecs = rng.normal(size=(5000, 3)).astype(np.float32) * np.float32(1e3)
    rows = [(int(i % 3), float(i), v.tolist()) for i, v in enumerate(vecs)] + [(7, 0.0, None), (8, 0.0, [1.0, None]), (None, 0.0, [2.0])]
    df = spark.createDataFrame(rows, "k long, x double, vec array<float>")
    got = {r["k"]: (r["v"], r["n"]) for r in vectors.sums(df.repartition(7), ["k"]).collect()}
    assert got == {r["k"]: (r["v"], r["n"]) for r in vectors.sums(df.repartition(3, F.rand(1)), ["k"]).collect()}
    for k in range(3):
        want = [float(sum(Fraction(round(Fraction(float(x)) * 2**40), 2**40) for x in vecs[k::3, j])) for j in range(3)]
        assert got[k][0] == pytest.approx(want, rel=1e-15) and got[k][1] == len(vecs[k::3])
    assert got[8] == ([1.0, 0.0], 1) and got[None] == ([2.0], 1) and 7 not in got
