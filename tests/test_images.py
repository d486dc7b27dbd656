"""Pixel functions on small rasters."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from medialoom.functions import images as I
from medialoom.functions import scalar as S
from medialoom.functions.jpeg import encode_jpeg
from medialoom.sources import files


def ramp(w=32, h=24):
    y, x = np.mgrid[0:h, 0:w]
    return np.stack([x * 255 // (w - 1), y * 255 // (h - 1), (x + y) % 256], axis=2).astype(np.uint8)


def test_png_round_trip_with_every_filter():
    img = ramp()
    assert (I.decode(I.encode_png(img)) == img).all()
    assert (I.decode(b"P6 # c\n"[:3] + b"32 24 255\n" + img.tobytes()) == img).all()
    with pytest.raises(ValueError):
        I.decode(b"none of these")


@pytest.mark.parametrize("n", range(0, 10))
def test_orientation(n):
    img = ramp(3, 2)
    out = I.oriented(img, n)
    assert out.shape[:2] == ((3, 2) if n in (5, 6, 7, 8) else (2, 3))
    corner = {2: (0, 2), 3: (1, 2), 4: (1, 0), 5: (0, 0), 6: (1, 0), 7: (1, 2), 8: (0, 2)}.get(n, (0, 0))
    assert (out[0, 0] == img[corner]).all()


def test_thumbs():
    img = ramp(64, 32)
    assert I.square_thumb(img, 16).shape == (16, 16, 3) and I.fit_thumb(img, 16).shape == (8, 16, 3) and I.fit_thumb(img, 999) is img
    flat = np.full((20, 30, 3), 77, np.uint8)
    assert (I.resized(flat, 7, 9) == 77).all()


def test_difference_hash():
    x = np.tile(np.linspace(0, 255, 90).astype(np.uint8)[None, :, None], (80, 1, 3))
    assert I.difference_hash(x) == 0 and I.difference_hash(x[:, ::-1]) == -1
    assert I.difference_hash(I.resized(x, 45, 40)) == I.difference_hash(x)


def test_faces():
    a, b, tx, ty = I.similarity_transform(I.FACE_TEMPLATE, I.FACE_TEMPLATE)
    assert np.allclose((a, b, tx, ty), (1, 0, 0, 0), atol=1e-9)
    assert np.allclose(I.similarity_transform(I.FACE_TEMPLATE + 5, I.FACE_TEMPLATE), (1, 0, -5, -5))
    img = ramp(112, 112)
    assert np.abs(I.aligned_face(img, I.FACE_TEMPLATE) - img).max() < 1e-6
    with pytest.raises(ValueError):
        I.aligned_face(img, np.zeros((5, 2)))
    scores, boxes, points = [np.zeros((640 // s) ** 2 * 2) for s in (8, 16, 32)], [np.ones(((640 // s) ** 2 * 2, 4)) for s in (8, 16, 32)], [np.zeros(((640 // s) ** 2 * 2, 10)) for s in (8, 16, 32)]
    scores[0][2 * 81], scores[0][2 * 81 + 1] = 0.9, 0.8
    found = I.detections(scores, boxes, points, 0.5)
    assert [d["score"] for d in found] == [0.9, 0.8] and found[0]["box"] == [0, 0, 32, 32] and len(I.suppressed(found)) == 1
    assert I.face_crop(img, (20, 20, 60, 60)).shape == (192, 192, 3) and I.letterbox(img)[0].shape == (3, 640, 640) and I.encoder_input(img).shape == (3, 224, 224)


def test_colour():
    img = ramp()
    assert (I.adjusted(img) == img).all()
    grey = I.adjusted(img, mono=1)
    assert (grey[..., 0] == grey[..., 1]).all() and (grey[..., 1] == grey[..., 2]).all()
    assert (I.adjusted(np.full((2, 2, 3), 60, np.uint8), exposure=1) == 120).all()
    for p in I.PRESETS.values():
        assert I.adjusted(img, sharpen=0.3, **p).shape == img.shape


def test_columns_and_raster_agree(spark):
    a = dict(exposure=0.3, highlights=-0.2, shadows=0.4, brilliance=0.2, brightness=0.1, black=0.2, contrast=0.3, warmth=0.3, tint=-0.2, saturation=0.3, vibrance=0.4, mono=0.2, fade=0.4)
    img = ramp(6, 4)
    px = img.reshape(-1, 3)
    df = spark.createDataFrame([(i, *map(float, c / 255)) for i, c in enumerate(px)], "k int, r double, g double, b double")
    for step in S.adjust_colour(None, None, None, **a):
        r, g, b = step(F.col("r"), F.col("g"), F.col("b"))
        df = df.select("k", r.alias("r"), g.alias("g"), b.alias("b"))
    got = np.array([[x["r"], x["g"], x["b"]] for x in df.orderBy("k").collect()]) * 255
    assert np.abs(got - I.adjusted(img, **a).reshape(-1, 3)).max() <= 0.51


def test_crop_and_turn():
    img = ramp(8, 6)
    assert (I.transformed(img) == img).all() and (I.transformed(img, quarter_turns=1) == np.rot90(img, -1)).all()
    assert (I.transformed(img, crop=(0.25, 0.5, 0.5, 0.5)) == img[3:, 2:6]).all()
    assert I.straighten_zoom(0, 3, 2) == 1 and I.straighten_zoom(0.1, 3, 2) > 1
    assert np.allclose(I.ratio_crop(400, 300, 1), (0.125, 0, 0.75, 1)) and np.allclose(I.ratio_crop(300, 400, 1), (0, 0.125, 1, 0.75)) and I.ratio_crop(3, 4, 0) == (0, 0, 1, 1)


def exif_block():
    text = b"Canon\0Canon R5\0" + b"2026:06:05 20:24:17\0"
    entries = [(0x010F, 2, 6, 100), (0x0110, 2, 9, 106), (0x0112, 3, 1, 6), (0x0132, 2, 20, 115), (0x8827, 3, 1, 400), (0x829D, 5, 1, 140)]
    head = b"II*\0" + struct.pack("<I", 8) + struct.pack("<H", len(entries)) + b"".join(struct.pack("<HHII", *e) for e in entries) + b"\0\0\0\0"
    return (head.ljust(100, b"\0") + text).ljust(140, b"\0") + struct.pack("<II", 28, 10)


def test_exif(spark):
    got = I.read_exif(b"\xff\xd8\xff\xe1\0\0Exif\0\0" + exif_block())
    assert got == {"make": "Canon", "model": "Canon R5", "orient": 6, "written": "2026:06:05 20:24:17", "iso": 400, "fnum": 2.8}
    assert I.read_exif(b"") == {} and I.read_exif(b"II*\0\xff\xff\xff\xff") == {}
    row = spark.createDataFrame([(exif_block(),), (None,)], "c binary").select(I.exif("c").alias("e")).select("e.*").collect()
    assert row[0]["orient"] == 6 and row[0]["taken"] == "2026:06:05 20:24:17" and row[1]["make"] is None


def test_embedded_jpegs():
    a, b = b"\xff\xd8\xff" + b"1" * 2000 + b"\xff\xd9", b"\xff\xd8\xff" + b"2" * 5000 + b"\xff\xd9"
    data = b"head" + a + b"gap" + b + b"tail" + b"\xff\xd8\xffsmall\xff\xd9"
    assert [data[x:y] for x, y in I.embedded_jpegs(data)] == [b, a]


def test_bad_bytes_are_error_rows(spark):
    df = spark.createDataFrame([(I.encode_png(ramp()),), (b"junk",), (None,)], "c binary")
    rows = df.select(I.thumbnail("c", F.lit(8)).alias("t")).select("t.*").collect()
    assert rows[0]["w"] == 32 and rows[0]["err"] is None and rows[1]["err"] and rows[2]["err"]
    blob = df.select(I.vector_of_bytes(F.lit(struct.pack("<2f", 1, 2) + b"x")).alias("v")).select("v", I.bytes_of_vector("v").alias("b")).first()
    assert blob["v"] == [1.0, 2.0] and bytes(blob["b"]) == struct.pack("<2f", 1, 2)


def png_with(img, kinds):
    """A PNG whose lines have the filters given."""
    import zlib

    h, w, n = img.shape
    out, above = b"", np.zeros((w, n), int)
    for y, k in zip(range(h), kinds):
        line = img[y].astype(int)
        left, corner = np.vstack([np.zeros((1, n), int), line[:-1]]), np.vstack([np.zeros((1, n), int), above[:-1]])
        p = left + above - corner
        d = [np.abs(p - v) for v in (left, above, corner)]
        paeth = np.where((d[0] <= d[1]) & (d[0] <= d[2]), left, np.where(d[1] <= d[2], above, corner))
        out += bytes([k]) + ((line - [0, left, above, (left + above) // 2, paeth][k]) % 256).astype(np.uint8).tobytes()
        above = line
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    colour = {1: 0, 2: 4, 3: 2, 4: 6}[n]
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, colour, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(out)) + chunk(b"IEND", b"")


@pytest.mark.parametrize("kinds", [(0,), (1,), (2,), (1, 2, 0), (3,), (4,), (0, 1, 2, 3, 4)])
@pytest.mark.parametrize("n", [1, 3, 4])
def test_png_filters(kinds, n):
    img = np.random.default_rng(n).integers(0, 256, (11, 17, n), dtype=np.uint8)
    img[3:7] = 200  # even parts too
    got = I.decode(png_with(img, [kinds[y % len(kinds)] for y in range(11)]))
    assert (got == (np.repeat(img, 3, axis=2) if n == 1 else img[..., :3])).all()


def turned(png: bytes, orientation: int) -> bytes:
    """The PNG with an EXIF chunk."""
    block = b"II*\0\x08\0\0\0\x01\0" + struct.pack("<HHIHH", 0x0112, 3, 1, orientation, 0) + b"\0\0\0\0"
    return png[:-12] + struct.pack(">I", len(block)) + b"eXIf" + block + b"\0\0\0\0" + png[-12:]


def test_thumbnails_are_upright_and_previews_found(spark):
    img = ramp(200, 170)
    plain, lying = I.encode_png(img), turned(I.encode_png(np.rot90(img, 1).copy()), 6)
    rows = [(1, plain), (2, lying), (3, b"RAW!" + b"\xff\xd8\xff" + b"0" * 2000 + b"\xff\xd9"), (4, None), (5, b"")]
    df = spark.createDataFrame(rows, "id int, content binary")
    got = {r["id"]: r["t"] for r in df.select("id", I.thumbnail("content", F.lit(16)).alias("t")).collect()}
    assert (got[1]["w"], got[1]["h"], got[1]["dhash"], got[1]["thumb"]) == (got[2]["w"], got[2]["h"], got[2]["dhash"], got[2]["thumb"]) and got[1]["w"] == 200
    assert all(got[i]["err"] and got[i]["w"] is None for i in (3, 4, 5))
    spans = {r["id"]: r["e"] for r in df.select("id", I.embedded("content").alias("e")).collect()}
    assert [tuple(s) for s in spans[3]] == [(4, 2009)] and spans[1] == [] and spans[4] is None


def test_raster_functions(spark):
    img = ramp(64, 48)
    df = spark.createDataFrame([(I.encode_png(img),), (b"junk",)], "content binary")
    row, junk = df.select(I.preview("content", F.lit(32)).alias("p"), I.encoder_tensor("content", F.lit(8)).alias("e"), I.detector_tensor("content", F.lit(16)).alias("d"), I.face_png("content", F.array(*map(F.lit, (10.0, 10.0, 30.0, 30.0)))).alias("f"),
        I.aligned_png("content", F.array(*map(F.lit, (I.FACE_TEMPLATE / 3).ravel().tolist()))).alias("a"), I.edited(mono=1, quarter_turns=1)("content", F.lit(0)).alias("x")).collect()
    assert I.decode(bytes(row["p"])).shape == (24, 32, 3) and len(row["e"]) == 3 * 8 * 8 and len(row["d"]) == 3 * 16 * 16
    assert np.allclose(np.reshape(row["e"], (3, 8, 8)), I.encoder_input(img, 8), atol=1e-6)
    assert I.decode(bytes(row["f"])).shape == (192, 192, 3) and I.decode(bytes(row["a"])).shape == (112, 112, 3)
    edited = I.decode(bytes(row["x"]))
    assert edited.shape == (64, 48, 3) and (edited[..., 0] == edited[..., 1]).all()
    assert all(v is None for v in junk)


def test_pictures_of_other_formats(spark, tmp_path):
    """JPEG, GIF and BMP, written by the JVM, as the listing of a folder; a broken file is an error row."""
    jvm, img = spark._jvm, ramp(64, 48)
    for kind in ("jpg", "gif", "bmp", "png"):
        picture = jvm.java.awt.image.BufferedImage(64, 48, 1)
        for y in range(48):
            for x in range(64):
                picture.setRGB(x, y, int(img[y, x, 0]) << 16 | int(img[y, x, 1]) << 8 | 40)
        assert jvm.javax.imageio.ImageIO.write(picture, kind, jvm.java.io.File(f"{tmp_path}/a.{kind}"))
    (tmp_path / "broken.jpg").write_bytes(b"\xff\xd8\xff junk")
    data = (tmp_path / "a.jpg").read_bytes()
    block = b"Exif\0\0MM\0*\0\0\0\x08\0\x01" + struct.pack(">HHIHH", 0x0112, 3, 1, 6, 0) + b"\0\0\0\0"
    (tmp_path / "turned.jpg").write_bytes(data[:2] + b"\xff\xe1" + struct.pack(">H", len(block) + 2) + block + data[2:])
    got = {r["path"].rpartition("/")[2]: r for r in files.pictures(spark, str(tmp_path), 16).collect()}
    assert len(got) == 6 and all((got[f"a.{k}"]["w"], got[f"a.{k}"]["h"], got[f"a.{k}"]["err"]) == (64, 48, None) for k in ("jpg", "gif", "bmp", "png"))
    assert (got["turned.jpg"]["w"], got["turned.jpg"]["h"], got["turned.jpg"]["orient"]) == (48, 64, 6) and got["broken.jpg"]["err"]
    small = I.decode(bytes(got["a.png"]["thumb"])).astype(int)
    assert np.abs(I.decode(bytes(got["a.jpg"]["thumb"])).astype(int) - small).mean() < 6 and got["a.bmp"]["thumb"] == got["a.png"]["thumb"]


def jvm_decoded(spark, data: bytes) -> np.ndarray:
    jvm = spark._jvm
    picture = jvm.javax.imageio.ImageIO.read(jvm.java.io.ByteArrayInputStream(bytearray(data)))
    w, h = picture.getWidth(), picture.getHeight()
    px = np.array(list(picture.getRGB(0, 0, w, h, None, 0, w)), np.int64).reshape(h, w)
    return np.stack([px >> 16 & 255, px >> 8 & 255, px & 255], axis=2)


@pytest.mark.parametrize("quality, most", [(30, 4.0), (82, 1.5), (95, 1.0)])
def test_jpeg(spark, quality, most):
    """What another decoder makes of it is close, for sizes that blocks do not fit, and better with quality."""
    for img in (ramp(67, 51), ramp(64, 64), ramp(67, 51)[:2, :9], np.full((8, 8, 3), 77, np.uint8), np.full((1, 1, 3), 200, np.uint8)):
        got = jvm_decoded(spark, encode_jpeg(img, quality))
        assert got.shape == img.shape and np.abs(got - img).mean() < most
    noise = np.random.default_rng(2).integers(0, 256, (40, 33, 3), dtype=np.uint8)
    assert np.abs(jvm_decoded(spark, encode_jpeg(noise, 100)) - noise).mean() < 1.5
    assert len(encode_jpeg(noise, 95)) > len(encode_jpeg(noise, 30))
    with pytest.raises(ValueError):
        encode_jpeg(np.zeros((0, 5, 3), np.uint8))


def test_recompression_is_taken_if_smaller(spark, tmp_path):
    img = np.kron(np.random.default_rng(3).integers(0, 256, (20, 30, 3), dtype=np.uint8), np.ones((8, 8, 1), np.uint8)) + ramp(240, 160) // 16
    (tmp_path / "a.png").write_bytes(I.encode_png(img))
    (tmp_path / "small.jpg").write_bytes(encode_jpeg(img, 20))
    (tmp_path / "broken.gif").write_bytes(b"GIF8 junk")
    got = {r["path"].rpartition("/")[2]: r for r in files.recompressed(spark, str(tmp_path), edge=120).collect()}
    assert jvm_decoded(spark, bytes(got["a.png"]["jpeg"])).shape == (80, 120, 3) and len(got["a.png"]["jpeg"]) < got["a.png"]["bytes"]
    assert got["broken.gif"]["jpeg"] is None
    assert {r["path"].rpartition("/")[2]: r["jpeg"] for r in files.recompressed(spark, str(tmp_path), quality=95).collect()}["small.jpg"] is None
    row = spark.createDataFrame([(I.encode_png(img),)], "content binary").select(I.grid_jpeg("content", F.lit(32)).alias("g"), I.preview_jpeg("content", F.lit(60)).alias("p"), I.edited(quality=90, mono=1)("content", F.lit(0)).alias("e")).first()
    assert jvm_decoded(spark, bytes(row["g"])).shape == (32, 32, 3) and jvm_decoded(spark, bytes(row["p"])).shape == (40, 60, 3)
    grey = jvm_decoded(spark, bytes(row["e"]))
    assert np.abs(grey[..., 0] - grey[..., 2]).mean() < 3


def test_thumbnails_hold_few_images_of_a_batch(spark):
    """A batch of any number of images costs Python objects for HELD of them; rows keep their order from piece to piece."""
    import tracemalloc

    import pyarrow as pa

    content = pa.array([I.encode_png(ramp()), *[b"junk" * 10_000] * 1500, I.encode_png(ramp(40))])
    tracemalloc.start()
    try:
        made = I.thumbnail.func(content, pa.array([8] * len(content)))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 20e6 < content.nbytes and len(made) == len(content) and made.field("w").null_count == 1500
    assert made[0].as_py()["w"] == 32 and made[1501].as_py()["w"] == 40 and made[700].as_py()["err"]
    df = spark.createDataFrame([(k, I.encode_png(ramp(20 + k % 150))) for k in range(300)], "id int, c binary").coalesce(1)
    assert all(r["w"] == 20 + r["id"] % 150 for r in df.select("id", I.thumbnail("c", F.lit(8))["w"].alias("w")).collect())
