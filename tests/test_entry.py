"""The registered queries against their SQL, on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from medialoom.plans import catalog

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def sql():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return c


def rows(records, columns):
    at = [columns.index(c) for c in sorted(columns)]
    return sorted((tuple(round(r[i], 6) if isinstance(r[i], float) else r[i] for i in at) for r in records), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, sql, name):
    df = catalog.queries()[name](spark, DIR)
    got = rows(map(tuple, df.collect()), df.columns)
    assert got
    if name in catalog.oracle_sql():
        want = sql.sql(catalog.oracle_sql()[name])
        assert sorted(df.columns) == sorted(want.columns) and got == rows(want.fetchall(), want.columns)


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["lib", "day", "id", "ts", "fl", "in_run"] and df.count() > 0


def test_oracles_have_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("hidden, core_alone", [("medialoom.llm", True), ("corpus_pipeline", True), ("xxhash", True), ("medialoom.functions.scalar", False)])
def test_entry_without_what_the_corpus_queries_need(hidden, core_alone):
    import subprocess
    import sys

    code = f"import sys; sys.modules['{hidden}'] = None; import __spark_entry__ as e; print(len(e.queries()))"
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=entry.__file__.rpartition("/")[0])
    assert (done.stdout.strip() == str(len(catalog.queries()))) == core_alone, done.stderr


def test_listing_is_a_top_k_over_pruned_columns(spark):
    from medialoom.operators.media import MediaQuery
    from medialoom.plans import adapters

    plan = MediaQuery(limit=400_000).listing(adapters.media(spark, DIR))._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "o_orderstatus" in plan and "c_acctbal" not in plan


@pytest.mark.parametrize("bound", [1, 2000, 64 << 20])
def test_nearest_person_has_no_bound(spark, sql, monkeypatch, bound):
    """Centres that do not fit in one matrix go in blocks; nothing changes."""
    from medialoom.operators import vectors

    monkeypatch.setattr(vectors, "MATRIX_BYTES", bound)
    df = entry.queries()["nearest_person"](spark, DIR)
    want = sql.sql(entry.oracle_sql()["nearest_person"])
    assert rows(map(tuple, df.collect()), df.columns) == rows(want.fetchall(), want.columns)


def test_hot_duplicates_can_be_split(spark):
    """A key with a third of the rows: the join back to the groups is split."""
    from pyspark.sql import functions as F

    from medialoom.operators import storage

    conf = {"spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "100KB", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "100KB", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        n = 300_000
        m = spark.range(n).select("id", F.when(F.col("id") % 3 == 0, "hot").otherwise((F.col("id") % 100_000).cast("string")).alias("hash"), F.col("id").alias("bytes"), F.col("id").alias("mtime"), F.lit(None).cast("long").alias("deleted"), F.lit(0).alias("missing")).repartition(8)
        df = storage.duplicates(m)
        assert df.filter("hash = 'hot' and keep").collect()[0]["id"] == n - 3
        df.write.format("noop").mode("overwrite").save()
        got = df.groupBy("hash").agg(F.count("*").alias("n"), F.count_if("keep").alias("k"), F.max("n").alias("m"))
        assert got.filter("n <> m or k <> 1").isEmpty()
        rows_ = df.collect()
        assert len(rows_) == sum(1 for i in range(n) if i % 3 == 0) + sum(1 for r in rows_ if r["hash"] != "hot")
        assert "skew=true" in df._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
