"""Scalar functions against plain Python, row by row."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from medialoom.functions import scalar as S


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first()["x"]


def epoch(*a):
    return int(dt.datetime(*a, tzinfo=dt.timezone.utc).timestamp())


@pytest.mark.parametrize("name, want", [
    ("PXL_20260607_164721605.jpg", epoch(2026, 6, 7, 16, 47, 21)), ("20260605_202417.jpg", epoch(2026, 6, 5, 20, 24, 17)), ("IMG_1234.jpg", None),
    ("x19891231y20240229-999999.png", epoch(2024, 2, 29, 12)), ("20230229_101010.jpg", None), ("120240101_010203.jpg", epoch(2024, 1, 1, 1, 2, 3)),
    ("12002024010112.jpg", epoch(2024, 1, 1, 12)), ("short", None), ("", None), ("20240101", epoch(2024, 1, 1, 12)), ("20240101T235959", epoch(2024, 1, 1, 23, 59, 59)),
])
def test_date_from_name(spark, name, want):
    assert one(spark, S.date_from_name(F.lit(name))) == want


@pytest.mark.parametrize("text, want", [
    ("2026:06:05 20:24:17", epoch(2026, 6, 5, 20, 24, 17)), ("2026-06-05 20:24:17", epoch(2026, 6, 5, 20, 24, 17)), ("2026-06-05T20:24:17", epoch(2026, 6, 5, 20, 24, 17)),
    ('"2026:06:05"', epoch(2026, 6, 5, 12)), ("2026-13-05", None), ("garbage", None), ("", None),
])
def test_capture_date(spark, text, want):
    assert one(spark, S.parse_capture_date(F.lit(text))) == want


def test_header_date_takes_the_first_that_parses(spark):
    data = b"\xff\xd8Exif 2026:99:05 20:24:172026:06:05 20:24:17 2020:01:01 00:00:00"
    assert one(spark, S.header_date(F.lit(data))) == epoch(2026, 6, 5, 20, 24, 17)
    assert one(spark, S.header_date(F.lit(b"nothing"))) is None


@pytest.mark.parametrize("b, w, h, want", [(12_000_001, None, None, True), (12_000_000, None, None, False), (9_000_000, 600, 800, False), (2_500_001, 1000, 1000, True), (2_500_000, 1000, 1000, False)])
def test_oversized(spark, b, w, h, want):
    assert one(spark, S.oversized(F.lit(b), F.lit(w).cast("int"), F.lit(h).cast("int"))) is want


@pytest.mark.parametrize("codec, want", [("mjpeg", 8_000_000), ("h264", 4_200_000), ("hevc", 0), (None, 0)])
def test_video_saving(spark, codec, want):
    assert one(spark, S.video_saving(F.lit(codec).cast("string"), F.lit(10_000_000))) == want


@pytest.mark.parametrize("args, want", [(("mp4", "h264", "aac"), True), (("mov", "hevc", "aac"), False), (("mp4", "h264", None), True), (("mp4", None, "aac"), False), (("MP4", "av1", "opus"), True), (("avi", "h264", "aac"), False)])
def test_plays_natively(spark, args, want):
    assert one(spark, S.plays_natively(*[F.lit(a).cast("string") for a in args])) is want


def test_flags_round_trip(spark):
    lit = lambda *a: [F.lit(x) for x in a]
    assert one(spark, S.pack_flags(*lit(3, 1, 5, 2, False))) == 111
    for v in ((0, 0, 0, 0, True), (1, 1, 4, 2, False), (2, 0, 5, 1, True)):
        back = S.unpack_flags(S.pack_flags(*lit(*v)))
        row = spark.range(1).select(*[c.alias(k) for k, c in back.items()]).first()
        assert tuple(row) == (v[0], v[1], v[2], int(v[3] == 2), int(v[4]))


@pytest.mark.parametrize("make, model, want", [("Canon", "Canon EOS R5", "Canon EOS R5"), ("SONY", "ILCE-7M3", "SONY ILCE-7M3"), (None, "X", "X"), ("X", None, "X"), (None, None, None)])
def test_camera(spark, make, model, want):
    assert one(spark, S.camera_label(F.lit(make).cast("string"), F.lit(model).cast("string"))) == want


@pytest.mark.parametrize("data, want", [(b"\xff\xd8\xff\xe0", "jpeg"), (b"\x89PNG\r\n\x1a\n", "png"), (b"GIF89a", "gif"), (b"BM12", "bmp"), (b"RIFF1234WEBP", "webp"), (b"II*\0", "tiff"), (b"MM\0*", "tiff"), (b"BM", None), (b"RIFF1234WAVE", None)])
def test_sniff(spark, data, want):
    assert one(spark, S.sniff(F.lit(data))) == want
    assert one(spark, S.browser_mime(F.lit(data))) == (f"image/{want}" if want not in (None, "tiff") else None)


def test_kinds(spark):
    for ext, want in (("JPG", 0), ("heic", 0), ("cr3", 2), ("psd", 3), ("mkv", 1), ("txt", None), ("", None)):
        assert one(spark, S.kind_of_extension(F.lit(ext))) == want


def test_paths(spark):
    rel = S.relative_path(F.lit(r"C:\pics\a\b.c\x.JPG"), F.lit("C:/pics/"))
    assert one(spark, rel) == "a/b.c/x.JPG" and one(spark, S.parent_of(rel)) == "a/b.c" and one(spark, S.name_of(rel)) == "x.JPG" and one(spark, S.extension_of(S.name_of(rel))) == "jpg"
    assert one(spark, S.parent_of(F.lit("x"))) == "" and one(spark, S.extension_of(F.lit(".hidden"))) == ""
    assert one(spark, S.safe_file_name(F.lit('a/b\\c:d*e?f"g<h>i|j'))) == "a_b_c_d_e_f_g_h_i_j" and one(spark, S.safe_export_name(F.lit("Été 1/2!"))) == "Été 1_2_"


def test_like_folds_ascii_only(spark):
    assert one(spark, S.like_ci(F.lit("ABC É"), "bc")) and not one(spark, S.like_ci(F.lit("É"), "é")) and one(spark, S.like_ci(F.lit("a1b"), "A_B")) and one(spark, S.like_ci(F.lit("a\\b"), "\\"))


def test_subtree(spark):
    for sub, want in (("a", True), ("a/b", True), ("ab", False), ("A", False), ("", False)):
        assert one(spark, S.in_subtree(F.lit(sub), "a")) is want


def test_sizes_and_times(spark):
    assert [one(spark, S.human_bytes(F.lit(b))) for b in (512, 2048, 1 << 20, 1 << 30)] == ["0 KB", "2 KB", "1.0 MB", "1.00 GB"]
    assert [one(spark, S.display_bytes(F.lit(b).cast("long"))) for b in (None, 5, 1500, 2_500_000, 3 * 10**12)] == ["—", "5 B", "2 KB", "2.5 MB", "3.00 TB"]
    assert [one(spark, S.display_duration(F.lit(s).cast("double"))) for s in (None, 5.4, 65, 3661, -3)] == ["0:00", "0:05", "1:05", "1:01:01", "0:00"]
    now = F.lit(epoch(2024, 3, 10, 15))
    assert [one(spark, S.day_label(F.lit(t), now)) for t in (epoch(2024, 3, 10), epoch(2024, 3, 9, 23), epoch(2024, 3, 6), epoch(2024, 1, 2), epoch(2023, 1, 2))] == ["Today", "Yesterday", "Wednesday", "2 January", "2 January 2023"]
    assert [one(spark, S.bin_expiry(F.lit(0), d, F.lit(86400 * n))) for d, n in ((0, 1), (30, 1), (30, 29), (30, 31))] == ["", "29 days left", "1 day left", "expiring"]
    assert [one(spark, S.crf_of_quality(F.lit(q))) for q in (95, 84, 80, 10)] == [20, 24, 27, 30]


def test_rfc3339_and_ranges(spark):
    assert one(spark, S.parse_rfc3339(F.lit("2024-01-02T03:04:05.000000Z"))) == epoch(2024, 1, 2, 3, 4, 5) and one(spark, S.parse_rfc3339(F.lit("2024-01-02"))) is None
    got = [one(spark, S.byte_range(F.lit(h), F.lit(100).cast("long"))) for h in ("bytes=0-9", "bytes=90-", "bytes=-5", "bytes=95-500", "bytes=100-", "bytes=-", "x")]
    assert [tuple(r) if r else None for r in got] == [(0, 9), (90, 99), (95, 99), (95, 99), None, None, None]


def test_vectors_and_bits(spark):
    arr = lambda *x: F.array(*[F.lit(float(v)) for v in x])
    assert one(spark, S.dot(arr(1, 2, 3), arr(4, 5))) == 14.0 and one(spark, S.l2_normalise(arr(3, 4))) == [0.6, 0.8] and one(spark, S.l2_normalise(arr(0, 0))) == [0.0, 0.0]
    assert one(spark, S.hamming(F.lit(-1).cast("long"), F.lit(0).cast("long"))) == 64
    up = F.array(*[F.lit(c) for _ in range(8) for c in range(9)])
    down = F.array(*[F.lit(9 - c) for _ in range(8) for c in range(9)])
    assert one(spark, S.difference_hash(up)) == 0 and one(spark, S.difference_hash(down)) == -1


def test_boxes(spark):
    box = lambda *x: F.array(*[F.lit(float(v)) for v in x])
    assert one(spark, S.iou(box(0, 0, 2, 2), box(0, 0, 2, 2))) == 1.0 and one(spark, S.iou(box(0, 0, 1, 1), box(2, 2, 3, 3))) == 0.0
    boxes = F.array(*[F.struct(F.lit(s).alias("score"), box(*b).alias("box")) for s, b in ((0.5, (0, 0, 10, 10)), (0.9, (1, 1, 11, 11)), (0.7, (50, 50, 60, 60)))])
    assert [r["score"] for r in one(spark, S.non_maximum_suppression(boxes))] == [0.9, 0.7]


def test_local_hours_that_come_twice_or_never(spark):
    """Where clocks are set back the earlier offset counts, where they are set on the hour moves on."""
    import datetime as dt

    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        rows = spark.createDataFrame([("2024:11:03 01:30:00",), ("2024:03:10 02:30:00",), ("2024-07-01",)], "t string")
        got = [r["x"] for r in rows.coalesce(1).select(S.parse_capture_date(F.col("t")).alias("x")).collect()]
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    utc = lambda *a: int(dt.datetime(*a, tzinfo=dt.timezone.utc).timestamp())
    assert got == [utc(2024, 11, 3, 5, 30), utc(2024, 3, 10, 7, 30), utc(2024, 7, 1, 16)]


def test_folders_of_years_of_five_digits(spark):
    taken = spark.createDataFrame([(599_999 * 432_000,), (epoch(9999, 12, 31, 23),), (epoch(800, 2, 1),), (None,)], "t long")
    got = [r["x"] for r in taken.coalesce(1).select(S.dated_folder(F.col("t"), F.lit(0)).alias("x")).collect()]
    assert got == ["10183-09", "9999-12", "0800-02", "1970-01"]
