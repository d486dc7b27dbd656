"""Scalar functions as Column expressions: classification, flags, dates, sizes, strings, vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PHOTO, VIDEO, RAW, LAYERED = 0, 1, 2, 3

# The extensions of each kind of file.
PHOTO_EXTENSIONS = ["jpg", "jpeg", "jpe", "png", "webp", "bmp", "gif", "tif", "tiff", "avif", "jfif", "ico"]
HEIC_EXTENSIONS = ["heic", "heif", "hif"]
RAW_EXTENSIONS = ["cr2", "cr3", "nef", "nrw", "arw", "srf", "sr2", "dng", "raf", "orf", "rw2", "pef", "srw", "erf", "kdc", "dcr", "mrw", "3fr", "iiq", "x3f"]
LAYERED_EXTENSIONS = ["psd", "psb", "xcf"]
VIDEO_EXTENSIONS = ["mp4", "mov", "m4v", "avi", "mkv", "webm", "wmv", "flv", "3gp", "3g2", "mts", "m2ts", "mpg", "mpeg", "vob", "ogv", "mxf", "ts"]
BROWSER_IMAGES = ["jpg", "jpeg", "jfif", "png", "webp", "gif", "bmp", "avif"]
LEGACY_CODECS = ["mjpeg", "rawvideo", "msmpeg4v3", "msmpeg4v2", "mpeg4", "wmv3", "wmv2", "mpeg2video", "mpeg1video"]

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(c: Column) -> Column:
    """A-Z folded, other letters kept: the case rule of LIKE and NOCASE here."""
    return F.translate(c, _UPPER, _LOWER)


def like_ci(c: Column, text: str) -> Column:
    """Contains `text`, ASCII case ignored; % and _ in it stay wildcards, a backslash is an ordinary character."""
    pattern = "%" + text.translate(str.maketrans(_UPPER, _LOWER)).replace("\\", "\\\\") + "%"
    return ascii_lower(c).like(pattern)


def in_subtree(sub: Column, folder: Column | str) -> Column:
    """The folder itself or anything below it (exact case)."""
    folder = F.lit(folder) if isinstance(folder, str) else folder
    return (sub == folder) | F.startswith(sub, F.concat(folder, F.lit("/")))


# ---------------------------------------------------------------- files

def kind_of_extension(ext: Column) -> Column:
    e = ascii_lower(ext)
    return (
        F.when(e.isin(*PHOTO_EXTENSIONS, *HEIC_EXTENSIONS), PHOTO)
        .when(e.isin(*RAW_EXTENSIONS), RAW)
        .when(e.isin(*LAYERED_EXTENSIONS), LAYERED)
        .when(e.isin(*VIDEO_EXTENSIONS), VIDEO)
    )


def sniff(content: Column) -> Column:
    """Image type by the first bytes; NULL if unknown or under four bytes."""
    h = F.hex(F.substring(content, 1, 16))
    return F.when(F.octet_length(content) >= 4, F.when(h.startswith("FFD8FF"), "jpeg")
        .when(h.startswith("89504E470D0A1A0A"), "png")
        .when(h.startswith("47494638"), "gif")
        .when(h.startswith("424D"), "bmp")
        .when(h.startswith("52494646") & (F.substring(h, 17, 8) == "57454250"), "webp")
        .when(h.startswith("49492A00") | h.startswith("4D4D002A"), "tiff"))


def browser_mime(content: Column) -> Column:
    s = sniff(content)
    return F.when(s != "tiff", F.concat(F.lit("image/"), s))


def relative_path(path: Column, root: Column) -> Column:
    """Path below the root, with forward slashes."""
    p, r = F.translate(path, "\\", "/"), F.rtrim(F.translate(root, "\\", "/"), F.lit("/"))
    return F.when(F.startswith(p, F.concat(r, F.lit("/"))), F.substr(p, F.length(r) + 2)).otherwise(p)


def parent_of(rel: Column) -> Column:
    """Everything before the last slash, else the empty string."""
    return F.regexp_extract(rel, "^(.*)/[^/]*$", 1)


def name_of(rel: Column) -> Column:
    return F.substring_index(rel, "/", -1)


def extension_of(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"[^.]\.([^.]*)$", 1))


def stem_of(name: Column) -> Column:
    """The name without its last dot and what follows; a leading dot is no extension's."""
    return F.regexp_extract(name, r"^(.+?)(\.[^.]*)?$", 1)


def suffix_of(name: Column) -> Column:
    """The extension with its dot, or the empty string."""
    return F.regexp_extract(name, r"^(.+?)(\.[^.]*)?$", 2)


def plays_natively(ext: Column, vcodec: Column, acodec: Column) -> Column:
    v = F.coalesce(vcodec.isin("h264", "vp8", "vp9", "av1"), F.lit(False))
    a = F.coalesce(acodec.isin("aac", "mp3", "opus", "vorbis"), F.lit(True))
    return F.coalesce(ascii_lower(ext).isin("mp4", "m4v", "webm", "mov"), F.lit(False)) & v & a


def shown_by_browser(ext: Column) -> Column:
    return F.coalesce(ascii_lower(ext).isin(*BROWSER_IMAGES), F.lit(False))


def camera_label(make: Column, model: Column) -> Column:
    return F.when(F.startswith(F.lower(model), F.lower(make)), model).otherwise(F.when(make.isNotNull() & model.isNotNull(), F.concat_ws(" ", make, model)).otherwise(F.coalesce(model, make)))


def safe_file_name(name: Column) -> Column:
    return F.translate(name, '/\\:*?"<>|', "_________")


def safe_export_name(name: Column) -> Column:
    return F.regexp_replace(name, r"[^\p{L}\p{N} _-]", "_")


def dated_folder(taken: Column, now: Column) -> Column:
    """Year and month; years of five digits get no sign."""
    return F.ltrim(F.date_format(F.timestamp_seconds(F.coalesce(taken, now)), "yyyy-MM"), F.lit("+"))


def excludes_list(text: Column) -> Column:
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.trim(F.regexp_replace(x, r"^\s+|\s+$", ""), F.lit("/")))
    return F.filter(lines, lambda x: x != "")


def capped(content: Column, cap: int) -> Column:
    """At most the first `cap` bytes."""
    return F.substring(content, 1, cap)


def escape_html(text: Column) -> Column:
    """The four characters that markup gives a meaning to."""
    for c, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(c), F.lit(name))
    return text


def program_version(text: Column) -> Column:
    """What a program's first line tells of its version: without its name before and the copyright after."""
    line = F.substring_index(F.substring_index(text, "\n", 1), " Copyright", 1)
    return F.trim(F.regexp_replace(line, "^(ffmpeg version )+", ""))


# ---------------------------------------------------------------- flags

def pack_flags(kind: Column, fav: Column, rating: Column, state: Column, native: Column) -> Column:
    """kind in bits 0-1, fav 2, rating 3-5, failed 6, native 7."""
    bit = lambda c, n: F.shiftleft(c.cast("int"), n)
    return kind.bitwiseAND(3).bitwiseOR(bit(fav.bitwiseAND(1), 2)).bitwiseOR(bit(rating.bitwiseAND(7), 3)).bitwiseOR(bit(state == 2, 6)).bitwiseOR(bit(native, 7))


def unpack_flags(fl: Column) -> dict[str, Column]:
    at = lambda n, mask: F.shiftright(fl, n).bitwiseAND(mask)
    return {"kind": at(0, 3), "fav": at(2, 1), "rating": at(3, 7), "failed": at(6, 1), "native": at(7, 1)}


# ---------------------------------------------------------------- dates

def parse_capture_date(text: Column) -> Column:
    """Epoch seconds of a date-time in one of three spellings, or of a date at noon; NULL otherwise. The zone is the session's."""
    s = F.trim(F.trim(F.trim(text), F.lit('"')))
    stamps = [F.try_to_timestamp(s, F.lit(f)) for f in ("yyyy-MM-dd HH:mm:ss", "yyyy:MM:dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss")]
    noon = F.concat(F.translate(s, ":", "-"), F.lit(" 12:00:00"))
    days = F.when(s.rlike(r"^\d{4}([:-])\d{2}\1\d{2}$"), F.try_to_timestamp(noon, F.lit("yyyy-MM-dd HH:mm:ss")))
    return F.unix_timestamp(F.coalesce(*stamps, days))


def header_date(content: Column) -> Column:
    """The first date-time that parses in the first 128 KB, at any offset."""
    text = F.decode(F.substring(content, 1, 131072), "ISO-8859-1")
    found = F.regexp_extract_all(text, F.lit(r"(?=(\d{4}[:-]\d{2}[:-]\d{2}[ T]\d{2}:\d{2}:\d{2}))"), F.lit(1))
    return F.get(F.filter(F.transform(found, parse_capture_date), lambda t: t.isNotNull()), F.lit(0))


def date_from_name(name: Column) -> Column:
    """Epoch seconds from eight digits that are a date of 1990-2099, and six digits of time after an optional separator (else noon)."""
    at = F.filter(
        F.sequence(F.lit(1), F.greatest(F.length(name) - 7, F.lit(1))),
        lambda i: F.substr(name, i, F.lit(8)).rlike(r"^(199|20\d)\d{5}$") & F.try_to_timestamp(F.substr(name, i, F.lit(8)), F.lit("yyyyMMdd")).isNotNull(),
    )
    i = F.get(at, F.lit(0))
    day = F.substr(name, i, F.lit(8))
    rest = F.regexp_extract(F.substr(name, i + 8), r"^[_\- T]?(\d{6})", 1)
    stamp = F.try_to_timestamp(F.concat(day, rest), F.lit("yyyyMMddHHmmss"))
    return F.unix_timestamp(F.coalesce(stamp, F.try_to_timestamp(F.concat(day, F.lit("120000")), F.lit("yyyyMMddHHmmss"))))


def parse_rfc3339(text: Column) -> Column:
    return F.unix_timestamp(F.when(text.rlike(r"^\d{4}-\d\d-\d\d[Tt ]\d\d:\d\d:\d\d(\.\d+)?([Zz]|[+-]\d\d:\d\d)$"), F.try_to_timestamp(text)))


def day_key(ts: Column) -> Column:
    return F.date_format(F.timestamp_seconds(ts), "yyyyMMdd").cast("int")


def day_label(ts: Column, now: Column) -> Column:
    """Today, Yesterday, a weekday within six days, else day and month, with the year if it is another."""
    d, n = F.to_date(F.timestamp_seconds(ts)), F.to_date(F.timestamp_seconds(now))
    ago = F.datediff(n, d)
    return (
        F.when(ago == 0, "Today").when(ago == 1, "Yesterday").when((ago > 1) & (ago < 6), F.date_format(d, "EEEE"))
        .when(F.year(d) == F.year(n), F.date_format(d, "d MMMM")).otherwise(F.date_format(d, "d MMMM yyyy"))
    )


def bin_expiry(deleted: Column, days: int, now: Column) -> Column:
    """How long a binned item has left; counted from its deletion."""
    if days <= 0:
        return F.lit("")
    left = F.ceil((deleted + days * 86400 - now) / 86400)
    return F.when(left <= 0, "expiring").otherwise(F.concat(left.cast("string"), F.when(left == 1, " day left").otherwise(" days left")))


# ---------------------------------------------------------------- sizes

def human_bytes(b: Column) -> Column:
    return (
        F.when(b >= 2**30, F.format_string("%.2f GB", b / 2.0**30)).when(b >= 2**20, F.format_string("%.1f MB", b / 2.0**20))
        .otherwise(F.concat(F.bround(b / 1024.0, 0).cast("long").cast("string"), F.lit(" KB")))
    )


def display_bytes(b: Column) -> Column:
    return (
        F.when(b.isNull(), "—").when(b >= 1e12, F.format_string("%.2f TB", b / 1e12)).when(b >= 1e9, F.format_string("%.1f GB", b / 1e9))
        .when(b >= 1e6, F.format_string("%.1f MB", b / 1e6)).when(b >= 1e3, F.format_string("%d KB", F.round(b / 1e3).cast("long"))).otherwise(F.format_string("%d B", b))
    )


def display_duration(seconds: Column) -> Column:
    s = F.greatest(F.round(F.coalesce(seconds, F.lit(0.0))), F.lit(0)).cast("long")
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    h, m = F.floor(s / 3600), F.floor(s / 60) % 60
    return F.when(h > 0, F.concat_ws(":", h.cast("string"), two(m), two(s % 60))).otherwise(F.concat_ws(":", m.cast("string"), two(s % 60)))


def megapixels(w: Column, h: Column) -> Column:
    return w.cast("double") * h.cast("double") / 1e6


def oversized(b: Column, w: Column, h: Column) -> Column:
    mp = megapixels(w, h)
    return F.when(w.isNull() | h.isNull(), b > 12_000_000).when(mp < 0.5, False).otherwise(b.cast("double") > F.greatest(mp * 1_100_000.0, F.lit(2_500_000.0)))


def photo_saving(b: Column, w: Column, h: Column) -> Column:
    mp = megapixels(F.coalesce(w, F.lit(4000)), F.coalesce(h, F.lit(3000)))
    return F.greatest(b - (mp * 420_000.0).cast("long"), F.lit(0).cast("long"))


def video_saving(vcodec: Column, b: Column) -> Column:
    share = F.when(vcodec.isin(*LEGACY_CODECS), 0.80).when(vcodec.isin("h264", "vp8"), 0.42).otherwise(0.0)
    return (b.cast("double") * share).cast("long")


def crf_of_quality(q: Column) -> Column:
    return F.when(q >= 92, 20).when(q >= 84, 24).when(q >= 74, 27).otherwise(30)


def fit_scale(w: Column, h: Column, to_w: Column, to_h: Column) -> Column:
    return F.least(to_w / w, to_h / h)


def byte_range(header: Column, size: Column) -> Column:
    """(first, last) of one HTTP byte range; NULL if there is none or it cannot be met."""
    a, b = F.regexp_extract(header, r"^bytes=(\d*)-(\d*)$", 1), F.regexp_extract(header, r"^bytes=(\d*)-(\d*)$", 2)
    x, y = F.try_to_number(a, F.lit("999999999999999999")).cast("long"), F.try_to_number(b, F.lit("999999999999999999")).cast("long")
    first = F.when(a != "", x).when(b != "", F.greatest(size - y, F.lit(0)))
    last = F.when((a != "") & (b != ""), F.least(y, size - 1)).otherwise(size - 1)
    return F.when(first.isNotNull() & (first <= last) & (size > 0), F.struct(first.alias("first"), last.alias("last")))


# ---------------------------------------------------------------- vectors and bits

def dot(a: Column, b: Column) -> Column:
    """Sum of products in double, left to right; the shorter length counts."""
    n = F.least(F.size(a), F.size(b))
    return F.aggregate(F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def l2_normalise(v: Column) -> Column:
    norm = F.greatest(F.sqrt(dot(v, v)), F.lit(1e-8))
    return F.transform(v, lambda x: x.cast("double") / norm)


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def difference_hash(values: Column, rows: int = 8, cols: int = 9) -> Column:
    """Bit n set iff a value exceeds its right neighbour; row by row, lowest bit first. values: rows * cols in row order."""
    bits = [F.when(F.get(values, F.lit(r * cols + c)) > F.get(values, F.lit(r * cols + c + 1)), F.lit(_signed(1 << (r * (cols - 1) + c)))).otherwise(F.lit(0).cast("long")) for r in range(rows) for c in range(cols - 1)]
    out = bits[0].cast("long")
    for b in bits[1:]:
        out = out.bitwiseOR(b.cast("long"))
    return out


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


# ---------------------------------------------------------------- boxes and colour

def iou(a: Column, b: Column) -> Column:
    """Overlap of two boxes (x1, y1, x2, y2)."""
    g = lambda c, i: F.get(c, F.lit(i)).cast("double")
    side = lambda lo, hi: F.greatest(hi - lo, F.lit(0.0))
    inter = side(F.greatest(g(a, 0), g(b, 0)), F.least(g(a, 2), g(b, 2))) * side(F.greatest(g(a, 1), g(b, 1)), F.least(g(a, 3), g(b, 3)))
    area = lambda c: side(g(c, 0), g(c, 2)) * side(g(c, 1), g(c, 3))
    return inter / F.greatest(area(a) + area(b) - inter, F.lit(1e-6))


def non_maximum_suppression(boxes: Column, threshold: float = 0.4) -> Column:
    """Of an array of structs (score, box), those kept when taken by falling score: none overlaps a kept one by more than the threshold."""
    ordered = F.array_sort(boxes, lambda x, y: F.when(x["score"] > y["score"], -1).when(x["score"] < y["score"], 1).otherwise(0))
    return F.aggregate(ordered, F.slice(ordered, 1, 0), lambda kept, d: F.when(F.exists(kept, lambda k: iou(k["box"], d["box"]) > threshold), kept).otherwise(F.array_append(kept, d)))


def luma(r: Column, g: Column, b: Column) -> Column:
    return r * 0.2126 + g * 0.7152 + b * 0.0722


def hex_to_hsl(text: Column) -> Column:
    """Hue in degrees, saturation and lightness of #rrggbb; 224, 0.6, 0.5 for anything else."""
    ok = F.coalesce(text.rlike("^#?[0-9A-Fa-f]{6}$"), F.lit(False))
    digits = F.when(ok, F.right(text, F.lit(6))).otherwise("000000")
    r, g, b = (F.conv(F.substring(digits, i, 2), 16, 10).cast("double") / 255 for i in (1, 3, 5))
    top, low = F.greatest(r, g, b), F.least(r, g, b)
    d, light = top - low, (top + low) / 2
    sixth = F.when(d == 0, 0.0).when(top == r, ((g - b) / d) % 6).when(top == g, (b - r) / d + 2).otherwise((r - g) / d + 4) * 60
    hue = F.when(sixth < 0, sixth + 360).otherwise(sixth)
    sat = F.when(d == 0, 0.0).otherwise(d / (1 - F.abs(light * 2 - 1)))
    return F.struct(*[F.when(ok, x).otherwise(F.lit(y)).alias(k) for k, x, y in (("h", hue, 224.0), ("s", sat, 0.6), ("l", light, 0.5))])


def _smooth(lo: float, hi: float, x: Column) -> Column:
    t = F.least(F.greatest((x - lo) / (hi - lo), F.lit(0.0)), F.lit(1.0))
    return t * t * (3.0 - t * 2.0)


def adjust_colour(r: Column, g: Column, b: Column, **a: float):
    """The colour pipeline for one pixel in 0..1: a list of steps, each giving (r, g, b) from the one before.

    Steps are returned apart so that a caller can put each in a projection of its own; chained in one
    expression, every step would repeat the ones before it.
    """
    v = lambda k: float(a.get(k, 0.0))
    each = lambda f: lambda r, g, b: (f(r), f(g), f(b))
    mix = lambda x, y, t: x * (1.0 - t) + y * t

    def light(r, g, b):
        lum = luma(r, g, b)
        hi, lo = _smooth(0.5, 1.0, lum), 1.0 - _smooth(0.0, 0.5, lum)
        lift = (lo * 0.35 - hi * 0.22) * v("brilliance") + v("brightness") * 0.4
        return tuple(c + v("highlights") * 0.9 * hi * (1.0 - c) + v("shadows") * 0.55 * lo + lift for c in (r, g, b))

    def levels(c):
        black = v("black") * 0.25
        return ((c - black) / max(1.0 - black, 0.05) - 0.5) * (1.0 + v("contrast")) + 0.5

    def balance(r, g, b):
        warm, tint = v("warmth") * 0.12, v("tint")
        return r + (warm - tint * 0.04), g + tint * 0.10, b - (warm + tint * 0.04)

    def saturate(r, g, b):
        lum = luma(r, g, b)
        return tuple(mix(lum, c, 1.0 + v("saturation")) for c in (r, g, b))

    def vibrance(r, g, b):
        lum, spread = luma(r, g, b), F.greatest(r, g, b) - F.least(r, g, b)
        t = (1.0 - spread) * (v("vibrance") * 1.4) + 1.0
        return tuple(mix(lum, c, t) for c in (r, g, b))

    def mono(r, g, b):
        lum = luma(r, g, b)
        return tuple(mix(c, lum, v("mono")) for c in (r, g, b))

    fade = each(lambda c: mix(c, c * 0.86 + 0.14, v("fade")))
    clamp = each(lambda c: F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0)))
    steps = [each(lambda c: c * 2.0 ** v("exposure")), light, each(levels), balance, saturate, vibrance]
    return [*steps, *([mono] if v("mono") > 0.001 else []), *([fade] if v("fade") > 0.001 else []), clamp]
