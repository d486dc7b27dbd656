"""Text search through trigrams against the scan."""

import random

import pytest

from medialoom.operators import textindex
from medialoom.operators.media import MediaQuery
from medialoom.sources.catalog import Catalog

from .test_library import frame, item

TEXTS = ["é sky", "ab%cd", "sunset%b"]


def test_patterns():
    assert textindex.of_pattern("ABcd%ef_ghi") == ["abc", "bcd", "ghi"] and textindex.of_pattern("ab%cd") == [] and textindex.of_pattern("É12") == ["É12"]


def test_search_is_the_scan(spark, tmp_path, monkeypatch):
    r = random.Random(2)
    names = [r.choice(["IMG_", "img-", "é sky", "x\\y", "Sunset ab", "ab", "q"]) + str(k) + r.choice([".jpg", ".JPG", "", " cd.png"]) for k in range(200)]
    media = frame(spark, *[item(k, name=n, rel=f"d{k % 3}/{n}", path=f"d{k % 3}/{n}", deleted=1 if k % 17 == 0 else None) for k, n in enumerate(names)])
    tags = spark.createDataFrame([(1, "Sunset beach"), (2, "sky"), (3, None)], "id long, name string")
    links = spark.createDataFrame([(k, k % 3 + 1, 0.5) for k in range(0, 200, 5)], "media_id long, tag_id long, score double")
    index = textindex.TextIndex(Catalog(spark, f"file://{tmp_path}/index"), "texts")
    assert index.candidates("img").count() == 0
    index.add(media.filter("id < 120"), tags, links)
    index.add(media.filter("id >= 120"), tags, links)
    changed = frame(spark, *[item(k, name=f"renamed {k}.jpg", rel=f"r/{k}", path=f"r/{k}") for k in (3, 4)])
    index.add(changed, tags, links)
    after = media.filter("id not in (3, 4)").unionByName(changed)
    t = {"tags": tags, "media_tags": links}
    for text in [*TEXTS, "renamed", names[3]]:
        want = sorted(x["id"] for x in MediaQuery(text=text, tables=t).rows(after).collect())
        assert sorted(x["id"] for x in MediaQuery(text=text, tables=t, index=index).rows(after).collect()) == want, text
    assert index.candidates("ab%cd") is None
    index.candidates("renamed")
    assert 1 <= len(index.told["buckets"]) <= textindex.CHOSEN and index.told["postings"] < 30
    plan = index._read("postings", "gram string, id long", ["sky"])._jdf.queryExecution().executedPlan().toString()
    assert "isnotnull(bucket" in plan or "(bucket" in plan.split("PartitionFilters")[1]


@pytest.mark.parametrize("text", ["sun"])
def test_without_tags(spark, tmp_path, text):
    media = frame(spark, item(1, name="Sun.jpg"), item(2, name="moon.jpg"))
    index = textindex.TextIndex(Catalog(spark, f"file://{tmp_path}/index"), "texts")
    index.add(media)
    assert [r["id"] for r in MediaQuery(text=text, index=index).rows(media).collect()] == [1]


def test_tags_are_stored_once(spark, tmp_path):
    """Two tags on all items: a link for each, and no item has their trigrams."""
    media = frame(spark, *[item(k, name=f"n{k:03d}", rel=f"n{k:03d}", path=f"n{k:03d}") for k in range(50)])
    tags = spark.createDataFrame([(1, "Sunset beach"), (2, "sky"), (3, "of no item")], "id long, name string")
    links = spark.createDataFrame([(k, t, 0.5) for k in range(60) for t in (1, 2)], "media_id long, tag_id long, score double")
    catalog = Catalog(spark, f"file://{tmp_path}/index")
    index = textindex.TextIndex(catalog, "texts")
    index.add(media, tags, links)
    (at,) = [p for p in (tmp_path / "index" / "texts").iterdir() if p.name.startswith("v-")]
    rows = {p.name: spark.read.parquet(f"file://{p}").count() for p in at.iterdir()}
    assert rows["postings"] == 50 * 2 and rows["links"] == 50 * 2 and rows["names"] == 10 + 1
    assert index.candidates("sunset b").distinct().count() == 50 and index.candidates("sunset c").count() == 0
