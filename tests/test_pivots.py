"""The pivot index against a plain scan of all vectors."""

import numpy as np
import pytest

from medialoom.operators import pivots, vectors

from .test_clustering import around, unit


def frame(spark, rows):
    return spark.createDataFrame([(int(i), None if v is None else list(map(float, v))) for i, v in rows], "id long, vec array<double>").repartition(3)


def found(df):
    return [(r["id"], round(r["score"], 9), r["rank"]) for r in df.orderBy("rank").collect()]


@pytest.mark.parametrize("kind", ["clusters", "odd"])
def test_search_is_the_scan(spark, tmp_path, kind):
    rng = np.random.default_rng(3)
    m = around(rng, 20, 1200, 8, 0.15) if kind == "clusters" else rng.normal(size=(300, 8))
    if kind == "lengths":
        m *= rng.lognormal(0, 1.5, size=(300, 1))
    rows = list(enumerate(unit(m) if kind == "noise" else m))
    if kind == "odd":
        rows += [(400, None), (401, [0.0] * 8), (402, [1.0, 2.0]), (403, [1.0, 0, 0, 0, 0, 0, 0, 0, 5.0]), (404, []), (405, m[0]), (406, m[0])]
    df = frame(spark, rows)
    index = pivots.PivotIndex.build(df, f"file://{tmp_path}/index", groups=20)
    for q in (m[0], -m[3], m[0][:5]):
        for cut in ({"band": 0.5, "limit": 50}, {"floor": -9.0, "low": -9.0, "band": 99.0, "limit": 40}):
            assert found(index.search(q.tolist(), **cut)) == found(vectors.search(df, q.tolist(), **cut)), (kind, cut)
    some = df.filter("id % 7 = 3").select("id")
    assert found(index.search(m[0].tolist(), some)) == found(vectors.search(df.join(some, "id", "left_semi"), m[0].tolist()))
    assert found(index.search(m[0].tolist(), some.limit(0))) == []
    if kind == "clusters":
        index.search(m[5].tolist())
        assert index.told["vectors_read"] < index.told["vectors"] / 2 and index.told["groups_read"] < index.told["groups"]
        plan = index.rows.filter("grp IN (1, 2)")._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: [grp" in plan


def test_index_of_nothing(spark, tmp_path):
    index = pivots.PivotIndex.build(frame(spark, []), f"file://{tmp_path}/index")
    assert found(index.search([1.0, 0.0])) == [] and index.told["vectors"] == 0


def test_bounds_hold():
    rng = np.random.default_rng(1)
    m = rng.normal(size=(500, 6)) * rng.lognormal(0, 1, size=(500, 1))
    p = pivots.spread_pivots(m, 12)
    assert len(p) == 12 and np.allclose((p * p).sum(axis=1), 1)
    same = pivots.spread_pivots(np.tile(m[:2], (5, 1)), 12)
    assert len(same) == 2
