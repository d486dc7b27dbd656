"""Archives in parts against Python's zipfile."""

import functools
import zipfile

import duckdb
import pytest

from medialoom.operators import zips
from medialoom.plans import catalog
from medialoom.session import materialised


@pytest.mark.parametrize("limit, many, part", [(0xFFFFFFFF, 0xFFFF, 200), (100, 3, 500)])
def test_archives_open_and_equal_the_manifest(spark, tmp_path, limit, many, part):
    """Small limits make zip64 records of sizes, places and counts."""
    rows, want = [], {}
    for k in range(60):
        data = bytes([k]) * (k * 7 if k != 3 else 0) + b"end" * (k % 2)
        (tmp_path / f"f{k}").write_bytes(data)
        rows.append((k % 3, f"é {k}.jpg", k, f"file:{tmp_path}/f{k}", len(data)))
        want.setdefault(k % 3, []).append((f"é {k}.jpg", data))
    manifest = spark.createDataFrame(rows, "coll long, entry string, position int, path string, bytes long").repartition(5)
    parts = zips.written(manifest, f"{tmp_path}/out", part, zips.Format(limit, many))
    held = parts.collect()
    assert len({r["file"] for r in held}) == len(held) and (part > 1000 or len(held) > 8)
    for r in held:
        assert sum(x["bytes"] for x in held if x["coll"] == r["coll"] and x["part"] < r["part"]) == r["offset"]
    done = zips.put_together(spark, parts, f"{tmp_path}/out").collect()
    for r in done:
        with zipfile.ZipFile(r["path"].removeprefix("file://")) as z:
            assert z.testzip() is None and [(n, z.read(n)) for n in z.namelist()] == want[r["coll"]]
    assert len(done) == 3


def test_members_of_eight_tasks(spark, tmp_path):
    n = 400
    for k in range(n):
        (tmp_path / f"{k}").write_bytes(b"%d" % k * 50)
    rows = [(1, f"{k}.txt", k, f"{tmp_path}/{k}", len(b"%d" % k * 50)) for k in range(n)]
    with open(tmp_path / "large", "wb") as f:  # of more than one piece
        f.write(b"x" * 9_000_000)
    rows.append((1, "large", n, f"{tmp_path}/large", 9_000_000))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        parts = materialised(zips.written(spark.createDataFrame(rows, "coll long, entry string, position int, path string, bytes long"), f"{tmp_path}/out", 2000), "parts")
        assert parts.count() > 8 and sorted(r["bytes"] for r in parts.collect())[-2] < 60_000
        path = zips.put_together(spark, parts, f"{tmp_path}/out").first()["path"]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    with zipfile.ZipFile(path.removeprefix("file://")) as z:
        assert z.testzip() is None and len(z.namelist()) == n + 1


def test_a_changed_member_is_an_error(spark, tmp_path):
    (tmp_path / "a").write_bytes(b"123")
    df = spark.createDataFrame([(1, "a", 1, f"{tmp_path}/a", 2)], "coll long, entry string, position int, path string, bytes long")
    with pytest.raises(Exception, match="not 2"):
        zips.written(df, f"{tmp_path}/out").count()
    assert zips.written(df.limit(0), f"{tmp_path}/none").count() == 0


@pytest.mark.parametrize("limit, many", [(0xFFFFFFFF, 3), (300, 3)])
def test_the_query_counts_no_zip64_records(spark, tmp_path, monkeypatch, limit, many):
    """Its SQL has one formula for any number of entries; the archives have the records and open."""
    docs = spark.createDataFrame([(k, "é" * (k * 11 % 400 + 1)) for k in range(40)], "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    paths, real = [], zips.put_together
    monkeypatch.setattr(zips, "written", functools.partial(zips.written, form=zips.Format(limit, many)))
    monkeypatch.setattr(zips, "put_together", lambda *a: paths.append(real(*a)) or paths[-1])
    got = sorted(tuple(r) for r in catalog.queries()["archives_written"](spark, str(tmp_path)).collect())
    db = duckdb.connect()
    db.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert got == sorted(db.sql(catalog.oracle_sql()["archives_written"]).fetchall())
    for r, (_, entries, size) in zip(sorted(paths[0].collect()), got):
        with zipfile.ZipFile(r["path"].removeprefix("file://")) as z:
            assert z.testzip() is None and len(z.namelist()) == entries and r["bytes"] >= size + 76
