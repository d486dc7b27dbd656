"""What the corpus operators share: spreading small inputs, and the folder of intermediate tables."""

import os

import pytest
from pyspark.sql import functions as F

from medialoom import session
from medialoom.llm import common


def test_small_inputs_are_spread(spark, tmp_path, monkeypatch):
    spark.range(100).coalesce(1).write.parquet(f"{tmp_path}/one")
    spark.range(100).repartition(9).write.parquet(f"{tmp_path}/nine")
    one, nine = spark.read.parquet(f"{tmp_path}/one"), spark.read.parquet(f"{tmp_path}/nine")
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert "Repartition" in plan(common.spread(one)) and common.spread(one).agg(F.sum("id")).first()[0] == 4950
    assert "Repartition" not in plan(common.spread(nine)) and "Repartition" not in plan(common.spread(spark.range(5)))
    monkeypatch.setattr(common, "SPLIT_BYTES", 1)
    assert "Repartition" not in plan(common.spread(one))


def local(path: str) -> str:
    return path.removeprefix("file://").removeprefix("file:")


def test_scratch_goes_at_its_end(spark):
    kept = common.saved(spark.range(3), "kept")
    with pytest.raises(RuntimeError):
        with common.scratch(spark):
            inner = common.saved(spark.range(4), "inner")
            with common.scratch(spark):
                innermost = common.saved(spark.range(5), "innermost")
            assert inner.count() == 4 and not os.path.exists(local(innermost.saved_at))
            raise RuntimeError
    assert not os.path.exists(local(inner.saved_at)) and kept.count() == 3
    common.dropped(kept, spark.range(1))
    assert not os.path.exists(local(kept.saved_at))


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    class Conf:
        def get(self, key, default=None):
            return default

    class Context:
        applicationId, master = "app-other", "spark://somewhere"

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(RuntimeError, match="checkpoint"):
        session.shared_dir(Session())
