"""Segmented scans against plain loops, and against windows; groups that fill many partitions."""

import itertools
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from medialoom.operators import folders, library, scan, timeline
from medialoom.operators import media as M


@pytest.fixture(params=[3])
def partitions(request, spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(request.param))
    yield request.param
    spark.conf.set("spark.sql.shuffle.partitions", before)


def rows_of(kind, seed=3):
    r = random.Random(seed)
    lib = {"one": lambda i: 5, "few": lambda i: r.choice([1, 2, None]), "many": lambda i: r.randint(0, 80), "hot": lambda i: 7 if r.random() < 0.7 else r.randint(0, 20)}[kind]
    return [(lib(i), i, r.choice([None, *[86400 * d + r.randint(0, 9) for d in range(6)]])) for i in range(300 if kind != "few" else 7)]


def expected(rows):
    """Of each (lib, id): place, previous and next id, near; and the runs."""
    per, runs = {}, {}
    key = lambda r: (r[2] is not None, -(r[2] or 0), -r[1])
    for lib in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == lib), key=lambda r: (r[2] is None, -(r[2] or 0), -r[1]))
        for k, r in enumerate(own):
            near = sum(1 for j in range(max(0, k - 3), min(len(own), k + 4)) if j != k)
            per[lib, r[1]] = (k + 1, own[k - 1][1] if k else None, own[k + 1][1] if k + 1 < len(own) else None, near)
        for n, (day, items) in enumerate(itertools.groupby(own, key=lambda r: None if r[2] is None else r[2] // 86400)):
            items = list(items)
            ts = [r[2] for r in items]
            runs[lib, n + 1] = (len(items), None if day is None else min(ts), None if day is None else max(ts))
    return per, runs


@pytest.mark.parametrize("kind", ["few", "hot"])
def test_scans(spark, partitions, kind):
    rows = rows_of(kind)
    df = spark.createDataFrame(rows, "lib long, id long, ts long").repartition(4)
    order = [F.desc_nulls_last("ts"), F.desc("id")]
    per, runs = expected(rows)
    placed = {(r["lib"], r["id"]): r["place"] for r in scan.places(df, ["lib"], order).collect()}
    assert placed == {k: v[0] for k, v in per.items()}
    beside = {(r["lib"], r["id"]): (r["prev_id"], r["next_id"], r["near"]) for r in timeline.neighbours(df, order, "lib").collect()}
    assert beside == {k: v[1:] for k, v in per.items()}
    got = timeline.day_runs(df, order, "lib")
    assert {(r["lib"], r["run"]): (r["items"], r["first_ts"], r["last_ts"]) for r in got.collect()} == runs
    laid = {(r["lib"], r["run"]): r["y"] for r in timeline.grid_layout(got, 6, 120, 40, "lib").collect()}
    for (lib, run), y in laid.items():
        assert y == sum(40 + -(-runs[lib, k][0] // 6) * 120 + 6 for k in range(1, run))


def test_scans_without_groups_and_rows(spark, partitions):
    df = spark.range(100).select("id", (F.col("id") * 3600).alias("ts"))
    assert [r["day"] for r in timeline.day_runs(df, [F.col("ts")]).orderBy("run").collect()] == [19700101 + k for k in range(5)]
    assert timeline.neighbours(df, [F.col("ts")]).filter("prev_id = id - 1 or id = 0").count() == 100
    none = df.filter("id < 0")
    assert timeline.day_runs(none, [F.col("ts")]).count() == timeline.neighbours(none, [F.col("ts")]).count() == scan.places(none, [], [F.col("id")]).count() == 0


def test_sums_with_several_keys(spark, partitions):
    df = spark.createDataFrame([(i % 3, "x" if i % 2 else None, i, i % 7) for i in range(200)], "a int, b string, id long, v int").repartition(5)
    w = Window.partitionBy("a", "b").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    want = sorted(map(tuple, df.withColumn("s", F.coalesce(F.sum("v").over(w), F.lit(0)).cast("long")).collect()), key=repr)
    assert sorted(map(tuple, scan.running(df, ["a", "b"], [F.col("id")], F.col("v"), "s").collect()), key=repr) == want


def test_one_library_is_many_tasks(spark):
    """200,000 items of one library: no partition holds more than twice the mean, and no plan has a window over it."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    try:
        df = spark.range(200_000).select(F.lit(1).alias("lib"), "id", ((F.col("id") * 7919) % 1_000_003 * 60).alias("ts"))
        order = [F.desc("ts"), F.desc("id")]
        seen = []
        real = scan.materialised

        def watched(frame, what):
            out = real(frame, what)
            if what != "runs":
                seen.append([r["count"] for r in out.groupBy("_part").count().collect()])
            assert "Window" not in frame._jdf.queryExecution().executedPlan().toString()
            return out

        scan.materialised = watched
        try:
            near = timeline.neighbours(df, order, "lib")
            places = scan.places(df, ["lib"], order)
            runs = timeline.day_runs(df, order, "lib")
        finally:
            scan.materialised = real
        assert all(sum(x) == 200_000 and max(x) <= 2 * 200_000 / 8 for x in seen) and len(seen) == 2
        assert near.filter("near < 6").count() == 6 and places.agg(F.countDistinct("place"), F.max("place")).first()[:] == (200_000, 200_000)
        assert runs.agg(F.sum("items")).first()[0] == 200_000 and runs.agg(F.max("run")).first()[0] == runs.count() == df.select((F.col("ts") / 86400).cast("long")).distinct().count()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


# ---------------------------------------------------------------- free names

def plain_loop(new, taken):
    import re

    used = {}
    for sub, name in taken:
        used.setdefault((sub, name), set()).add(0)
    for sub, name in [*taken, *[(s, n) for _, s, n in new]]:
        m = re.search(r" \(([1-9]\d*)\)(\.[^.]*)?$", name)
        if m:
            used.setdefault((sub, name[: m.start()] + (m[2] or "")), set()).add(int(m[1]))
    out = {}
    for i, sub, name in sorted(new):
        have, n = used.setdefault((sub, name), set()), 0
        while n in have:
            n += 1
        have.add(n)
        stem, dot, ext = name.rpartition(".")
        out[i] = name if n == 0 else f"{stem} ({n}).{ext}" if dot else f"{name} ({n})"
    return out


@pytest.mark.parametrize("seed", [1])
def test_free_names(spark, partitions, seed):
    r = random.Random(seed)
    some = lambda: r.choice(["p.jpg", "q", "p (1).jpg", "p (3).jpg", "p (12).jpg", "q (2)", "p (0).jpg", "p (01).jpg", "p (4) (1).jpg"])
    taken = [(r.choice("ab"), some()) for _ in range(r.randint(0, 25))]
    new = [(i, r.choice("ab"), some()) for i in range(40)]
    got = library.free_names(spark.createDataFrame([(*x, "more") for x in new], "id long, sub string, name string, _t string").withColumnRenamed("_t", "other"), spark.createDataFrame(taken, "sub string, name string"), ["sub"])
    assert {x["id"]: x["name"] for x in got.collect()} == plain_loop(new, taken) and got.columns == ["id", "sub", "name", "other"]


def test_very_many_equal_names(spark):
    """100,000 new files of one name in a folder that holds as many already."""
    import time

    n = 100_000
    taken = spark.range(n).select(F.lit("f").alias("sub"), F.when(F.col("id") == 0, "p.jpg").otherwise(F.concat(F.lit("p ("), (2 * F.col("id")).cast("string"), F.lit(").jpg"))).alias("name"))
    new = spark.range(n).select("id", F.lit("f").alias("sub"), F.lit("p.jpg").alias("name"))
    library.free_names(new.limit(5), taken.limit(5), ["sub"]).count()
    began = time.time()
    got = library.free_names(new, taken, ["sub"])
    odd = F.concat(F.lit("p ("), (2 * F.col("id") + 1).cast("string"), F.lit(").jpg"))
    assert got.filter(F.col("name") == odd).count() == n
    assert time.time() - began < 20


def test_folder_listing_has_no_silent_limit(spark):
    dirs = spark.range(3000).select((F.col("id") % 2).alias("lib"), F.format_string("d%05d", (F.col("id") / 2).cast("int")).alias("rel"))
    m = spark.createDataFrame([(0, "d00001", 0)], "lib long, sub string, missing int")
    assert folders.listed_folders(dirs, m, []).count() == 3000
    few = folders.listed_folders(dirs, m, [], limit=10)
    assert sorted((r["lib"], r["rel"]) for r in few.collect()) == [(lib, f"d{k:05d}") for lib in (0, 1) for k in range(10)]


def test_orders_read_only_what_they_need():
    assert set(M.SORT_COLUMNS) == {"name", "name_desc", "size", "size_asc", "rating", "added", "shuffle"}
