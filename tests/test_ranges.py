"""Files read by ranges."""

import hashlib
import os
import time

import pytest

from medialoom.functions import images as I
from medialoom.operators import library
from medialoom.sources import files, ranges


def table(spark, paths):
    return spark.createDataFrame([(str(p), os.path.getsize(p) if os.path.exists(p) else 3) for p in paths], "path string, bytes long")


def brute(data, block):
    parts = [hashlib.sha256(data[i : i + block]).digest() for i in range(0, max(len(data), 1), block)]
    return parts[0].hex() if len(parts) == 1 else hashlib.sha256(b"".join(parts)).hexdigest()


@pytest.mark.parametrize("block", [7])
def test_digests(spark, tmp_path, block):
    data = {"empty": b"", "one": b"x", "seven": b"1234567", "hundred": bytes(range(100)), "copy": bytes(range(100)), "more": b"ab" * 77}
    for name, x in data.items():
        (tmp_path / name).write_bytes(x)
    t = table(spark, [tmp_path / n for n in data] + [tmp_path / "gone"])
    uri = t.selectExpr("concat('file:', path) as path", "bytes")
    got = {r["path"].rpartition("/")[2]: r["hash"] for r in ranges.digests(uri, block).collect()}
    assert got == {n: brute(x, block) for n, x in data.items()} | {"gone": None}
    grown = t.withColumn("bytes", t["bytes"] + 1)
    assert {r["hash"] for r in ranges.digests(grown, block).collect()} == {None}
    got = {r["path"].rpartition("/")[2]: r["head"] for r in ranges.heads(t, 10).collect()}
    assert {n: None if x is None else bytes(x) for n, x in got.items()} == {n: x[:10] for n, x in data.items()} | {"gone": None}


def test_a_sparse_file_of_three_gigabytes(spark, tmp_path):
    """Heads cost their own length; digests are made block by block, and equal files get equal ones."""
    size = 3 << 30
    for name in ("a.mp4", "b.mp4"):
        with open(tmp_path / name, "wb") as f:
            f.write(b"head" + bytes(1000))
            f.truncate(size)
    began = time.time()
    rows = files.decoded(spark, str(tmp_path)).collect()
    assert [r["bytes"] for r in rows] == [size] * 2 and all(r["data"] is None for r in rows) and time.time() - began < 30
    got = {r["hash"] for r in ranges.digests(table(spark, [tmp_path / "a.mp4", tmp_path / "b.mp4"])).collect()}
    zeros = hashlib.sha256(bytes(ranges.BLOCK)).digest()
    first = hashlib.sha256(b"head" + bytes(ranges.BLOCK - 4)).digest()
    assert got == {hashlib.sha256(first + zeros * (size // ranges.BLOCK - 1)).hexdigest()}


def test_only_decodable_files_are_read_whole(spark, tmp_path):
    import numpy as np

    (tmp_path / "p.PNG").write_bytes(I.encode_png(np.zeros((4, 6, 3), np.uint8)))
    (tmp_path / "p.dat").write_bytes(I.encode_png(np.zeros((4, 6, 3), np.uint8)))
    got = {r["path"].rpartition("/")[2]: r["width"] for r in files.decoded(spark, str(tmp_path)).collect()}
    assert got == {"p.PNG": 6, "p.dat": None}


def test_hashes_are_filled_in(spark, tmp_path):
    (tmp_path / "x.jpg").write_bytes(b"abc"), (tmp_path / "y.jpg").write_bytes(b"y"), (tmp_path / "z.jpg").write_bytes(b"z")
    rows = [(1, f"{tmp_path}/x.jpg", 3, None, None, 0), (2, f"{tmp_path}/gone.jpg", 3, None, None, 0), (3, f"{tmp_path}/y.jpg", 1, "old", None, 0), (4, f"{tmp_path}/z.jpg", 1, None, 5, 0)]
    m = spark.createDataFrame(rows, "id long, path string, bytes long, hash string, deleted long, missing int")
    got = {r["id"]: r["hash"] for r in library.backfill_hashes(m, ranges.digests).collect()}
    assert got == {1: hashlib.sha256(b"abc").hexdigest(), 2: None, 3: "old", 4: None}
