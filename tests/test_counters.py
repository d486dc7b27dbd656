"""Counters that follow commits, against counts from scratch."""

import random

from pyspark.sql import functions as F

from medialoom.operators import counters, folders
from medialoom.operators import media as M
from medialoom.sources import buckets
from medialoom.sources.catalog import Catalog

from .test_library import frame, item, walked


def test_ten_commits(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(buckets, "COMPACT", 3)  # added up anew now and then
    r = random.Random(8)
    schema = frame(spark, item(1)).schema
    media = buckets.Buckets(Catalog(spark, f"file://{tmp_path}/index"), "media", schema, 32)
    assert media.counted and counters.state_counters(media.counts()).first()[:] == (0,) * 9
    libs = spark.createDataFrame([(k, f"L{k}") for k in range(4)], "id long, name string")

    def check():
        rows, counts = media.read(), media.counts()
        assert counters.state_counters(counts).collect() == M.state_counters(rows).select(*counters.measures()).collect()
        assert sorted(counters.library_counts(libs, counts).collect()) == sorted(M.library_counts(libs, rows).collect())
        whole = folders.rollup(folders.folder_counts(rows.filter(M.active())))
        assert sorted(map(tuple, counters.folder_rollup(counts).select(*whole.columns).collect())) == sorted(map(tuple, whole.collect()))

    for step in range(10):
        ids = spark.createDataFrame([(r.randint(1, 60),) for _ in range(6)], "id long")
        some = [x["id"] for x in ids.collect()]
        hit = F.col("id").isin(*some)
        kind = step % 5
        if kind == 0:
            media.upsert(walked(spark, [(f"{r.choice(['a', 'a/b', 'c', 'c/d/e'])}/{r.randint(0, 90)}.jpg", r.randint(1, 999), r.randint(0, 9)) for _ in range(40)]), step)
        elif kind == 1:
            media.change(ids, lambda df: df.withColumn("deleted", F.when(hit, F.lit(5)).otherwise(F.col("deleted")).cast(schema["deleted"].dataType)))
        elif kind == 2:
            media.change(ids, lambda df: df.withColumn("fav", F.when(hit, 1).otherwise(F.col("fav")).cast(schema["fav"].dataType)).withColumn("state", F.when(hit, 2).otherwise(F.col("state")).cast(schema["state"].dataType)))
        elif kind == 3:
            media.change(ids, lambda df: df.filter(~hit))
        else:
            media.mark_missing(media.read().filter(F.col("id") % 9 != step).select("path"), media.read().first()["lib"])
        if step == 9:
            check()
    media.replace(media.read().filter("id < 20"))
    check()
