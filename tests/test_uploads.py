"""Uploads exactly once."""

import pytest

from medialoom.sources.buckets import Buckets
from medialoom.sources.catalog import Catalog
from medialoom.streaming import uploads

from .test_library import frame, item

LIBS = "id long, path string, name string, color string, added_at long, excludes string"
UP = "id long, root string, name string, content binary, taken long"


@pytest.fixture
def place(spark, tmp_path):
    catalog = Catalog(spark, f"file://{tmp_path}/index")
    media = Buckets(catalog, "media", frame(spark, item(1)).schema, 8)
    return uploads.Uploads(spark, catalog, media, spark.createDataFrame([], LIBS).schema, f"{tmp_path}/staging"), catalog, media


def batch(spark, tmp_path, start=0, n=6):
    roots = [f"{tmp_path}/one", f"{tmp_path}/two"]
    return spark.createDataFrame([(i, roots[i % 2], "p.jpg", b"%d" % i * (i + 1), 86400 * 40 * (i // 4)) for i in range(start, start + n)], UP)


def state(tmp_path, media):
    held = sorted(p.read_bytes() for r in ("one", "two") for p in (tmp_path / r).rglob("*") if p.is_file())
    rows = media.read().select("path", "bytes", "lib", "id").collect()
    assert sorted(len(open(r["path"], "rb").read()) for r in rows) == sorted(r["bytes"] for r in rows) == sorted(map(len, held))
    return held, sorted((r["path"], r["lib"], r["id"]) for r in rows)


def test_a_batch_run_twice(spark, tmp_path, place):
    up, catalog, media = place
    up.take(batch(spark, tmp_path), 0, 5)
    first = state(tmp_path, media)
    up.take(batch(spark, tmp_path), 0, 5)
    assert state(tmp_path, media) == first and len(first[0]) == 6
    up.take(batch(spark, tmp_path, 6), 1, 5)
    assert len(state(tmp_path, media)[0]) == 12
    libs = catalog.read("libraries").collect()
    assert sorted((r["id"], r["path"].rpartition("/")[2], r["name"]) for r in libs) == [(1, "one", "one"), (2, "two", "two")]


@pytest.mark.parametrize("where", ["staging", "renaming"])
def test_a_batch_that_fails_half_way(spark, tmp_path, place, monkeypatch, where):
    """Whatever step fails, the next run leaves one file and one row each."""
    up, catalog, media = place
    flag = tmp_path / "failed"

    def failing(real):
        def run(batches):
            import os

            for k, x in enumerate(real(batches)):
                if not os.path.exists(flag):
                    open(flag, "w").close()
                    raise RuntimeError("half-way")  # after its files were written or renamed
                yield x

        return run

    with monkeypatch.context() as m:
        if where == "staging":
            real = uploads._written
            m.setattr(uploads, "_written", lambda folder: failing(real(folder)))
        elif where == "manifest":
            m.setattr(catalog, "commit", lambda name, df, real=catalog.commit: (df.count(), 1 / 0) if name.startswith("uploads") else real(name, df))
        elif where == "renaming":
            m.setattr(uploads, "_renamed", failing(uploads._renamed))
        else:
            m.setattr(media, "upsert", lambda *a: 1 / 0)
        with pytest.raises(Exception):
            up.take(batch(spark, tmp_path), 0, 5)
    up.take(batch(spark, tmp_path), 0, 5)
    held, rows = state(tmp_path, media)
    assert held == sorted(b"%d" % i * (i + 1) for i in range(6)) and len(rows) == 6 and len({r[0] for r in rows}) == 6


def test_a_stream(spark, tmp_path, place):
    up, catalog, media = place
    batch(spark, tmp_path).repartition(2).write.parquet(f"{tmp_path}/inbox")
    for _ in range(2):
        up.run(f"{tmp_path}/inbox", spark.createDataFrame([], UP).schema, f"{tmp_path}/progress", 5)
    assert len(state(tmp_path, media)[0]) == 6
