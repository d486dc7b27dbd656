"""Pixel functions on numpy rasters, and pandas UDFs over image bytes.

A raster is height x width x 3, RGB, uint8.  Decoders here: PNG (8-bit, not interlaced) and
binary PPM; JPEG, GIF and BMP come through Spark's image source (see sources.files.pictures);
anything else is an error row, never a failed job.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from medialoom.functions.jpeg import encode_jpeg

# Where the five landmarks of a face lie in the 112 x 112 crop.
FACE_TEMPLATE = np.array([[38.2946, 51.6963], [73.5318, 51.5014], [56.0252, 71.7366], [41.5493, 92.3655], [70.7299, 92.2041]])
# Mean and deviation of each channel for the image encoder.
ENCODER_MEAN, ENCODER_STD = np.array([0.48145466, 0.4578275, 0.40821073]), np.array([0.26862954, 0.26130258, 0.27577711])

# Named looks, as adjustments of the colour pipeline.
PRESETS = {
    "Original": {},
    "Vivid": dict(saturation=0.22, contrast=0.16, vibrance=0.3),
    "Vivid Warm": dict(saturation=0.2, contrast=0.14, warmth=0.22, vibrance=0.26),
    "Vivid Cool": dict(saturation=0.2, contrast=0.14, warmth=-0.22, vibrance=0.26),
    "Dramatic": dict(contrast=0.4, shadows=-0.22, highlights=-0.18, saturation=-0.08, black=0.12),
    "Dramatic Warm": dict(contrast=0.38, warmth=0.26, shadows=-0.2, black=0.1),
    "Dramatic Cool": dict(contrast=0.38, warmth=-0.26, shadows=-0.2, black=0.1),
    "Mono": dict(mono=1, contrast=0.16),
    "Silvertone": dict(mono=1, contrast=0.3, brightness=0.06, black=0.1),
    "Noir": dict(mono=1, contrast=0.55, black=0.3, vignette=0.3),
    "Faded": dict(fade=0.7, contrast=-0.12, saturation=-0.18),
    "Warm Film": dict(warmth=0.3, fade=0.35, grain=0.22, contrast=0.1, saturation=-0.06),
}
# Crop ratios; 0 is free, -1 the original's.
RATIOS = {"Free": 0, "Original": -1, "1:1": 1, "4:3": 4 / 3, "3:2": 3 / 2, "16:9": 16 / 9, "3:4": 3 / 4, "2:3": 2 / 3, "9:16": 9 / 16}


# ---------------------------------------------------------------- formats

def encode_png(img: np.ndarray) -> bytes:
    h, w = img.shape[:2]
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    rows = np.concatenate([np.zeros((h, 1), np.uint8), img.reshape(h, w * 3)], axis=1).tobytes()
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def decode(data: bytes) -> np.ndarray:
    if data[:8] == b"\x89PNG\r\n\x1a\n":
        return _decode_png(data)
    if data[:2] == b"P6":
        head, at = [], 2
        while len(head) < 3:
            while data[at : at + 1].isspace():
                at += 1
            end = at
            while not data[end : end + 1].isspace():
                end += 1
            head.append(int(data[at:end]))
            at = end
        w, h, _ = head
        return np.frombuffer(data, np.uint8, w * h * 3, at + 1).reshape(h, w, 3)
    raise ValueError("no decoder for these bytes")


def _decode_png(data: bytes) -> np.ndarray:
    at, idat, palette = 8, b"", None
    while at < len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + n]
        if kind == b"IHDR":
            w, h, depth, colour, _, _, lace = struct.unpack(">IIBBBBB", body)
            if depth != 8 or lace:
                raise ValueError("PNG of another depth, or interlaced")
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            idat += body
        at += 12 + n
    n = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[colour]
    raw = np.frombuffer(zlib.decompress(idat), np.uint8).reshape(h, 1 + w * n)
    px = _unfiltered(raw[:, 0], raw[:, 1:].reshape(h, w, n))
    return palette[px[..., 0]] if colour == 3 else np.repeat(px[..., :1], 3, axis=2) if n < 3 else px[..., :3]


def _unfiltered(kinds: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """PNG's line filters undone. Lines that look up or left alone are sums; where others occur, pixels are taken by diagonals, as none needs another of its own diagonal."""
    h, w, n = raw.shape
    out = np.zeros((h + 1, w + 1, n), np.uint8)  # a border of zeros above and on the left
    if not np.isin(kinds, (3, 4)).any():
        for y in range(h):
            line = np.cumsum(raw[y], axis=0, dtype=np.uint8) if kinds[y] == 1 else raw[y]
            out[y + 1, 1:] = line + out[y, 1:] if kinds[y] == 2 else line
        return out[1:, 1:]
    for d in range(h + w - 1):
        y = np.arange(max(0, d - w + 1), min(h, d + 1))
        x = d - y
        a, b, c = (out[y + i, x + j].astype(np.int16) for i, j in ((1, 0), (0, 1), (0, 0)))  # left, above, above left
        p = a + b - c
        pa, pb, pc = abs(p - a), abs(p - b), abs(p - c)
        paeth = np.where((pa <= pb) & (pa <= pc), a, np.where(pb <= pc, b, c))
        out[y + 1, x + 1] = raw[y, x] + np.choose(kinds[y][:, None], [np.zeros_like(a), a, b, (a + b) // 2, paeth]).astype(np.uint8)
    return out[1:, 1:]


def raster_of(data: bytes, h: int, w: int, channels: int) -> np.ndarray:
    """A raster from the fields of Spark's image type (lines of B, G, R, or grey, or with alpha)."""
    px = np.frombuffer(data, np.uint8).reshape(h, w, channels)
    return np.repeat(px, 3, axis=2) if channels == 1 else px[..., 2::-1]


# ---------------------------------------------------------------- geometry and resizing

def oriented(img: np.ndarray, orientation: int) -> np.ndarray:
    """EXIF orientation 1-8 applied; others as they are."""
    turn = {2: lambda i: i[:, ::-1], 3: lambda i: i[::-1, ::-1], 4: lambda i: i[::-1], 5: lambda i: i.transpose(1, 0, 2), 6: lambda i: np.rot90(i, -1), 7: lambda i: np.rot90(i, 2).transpose(1, 0, 2), 8: lambda i: np.rot90(i, 1)}
    return turn.get(orientation, lambda i: i)(img)


def _triangle(n_in: int, n_out: int) -> np.ndarray:
    """Weights of a triangle filter, n_out x n_in; wider than a pixel when shrinking."""
    scale = n_in / n_out
    radius = max(scale, 1.0)
    centre = (np.arange(n_out) + 0.5) * scale - 0.5
    w = np.maximum(1 - np.abs(np.arange(n_in)[None, :] - centre[:, None]) / radius, 0)
    return w / w.sum(axis=1, keepdims=True)


def resized(img: np.ndarray, w: int, h: int) -> np.ndarray:
    rows, cols = _triangle(img.shape[0], h), _triangle(img.shape[1], w)
    out = np.einsum("yi,ijc,xj->yxc", rows, img.astype(float).reshape(img.shape[0], img.shape[1], -1), cols, optimize=True)
    return np.clip(np.rint(out), 0, 255).astype(np.uint8)


def square_thumb(img: np.ndarray, edge: int = 320) -> np.ndarray:
    side = min(img.shape[:2])
    y, x = (img.shape[0] - side) // 2, (img.shape[1] - side) // 2
    return resized(img[y : y + side, x : x + side], edge, edge)


def fit_thumb(img: np.ndarray, max_edge: int = 1600) -> np.ndarray:
    """Shrunk so that no edge is longer; never enlarged."""
    h, w = img.shape[:2]
    s = max_edge / max(h, w)
    return img if s >= 1 else resized(img, max(1, round(w * s)), max(1, round(h * s)))


def difference_hash(img: np.ndarray) -> int:
    """64 bits of a 9 x 8 luma raster as a signed integer: bit n set iff left > right, row by row, lowest bit first."""
    grey = np.rint(img.astype(float) @ [0.2126, 0.7152, 0.0722]).astype(np.uint8)
    g = resized(grey[..., None], 9, 8)[..., 0]
    bits = (g[:, :-1] > g[:, 1:]).ravel()
    return int(np.packbits(bits, bitorder="little").view("<i8")[0])


def encoder_input(img: np.ndarray, edge: int = 224) -> np.ndarray:
    """Short side to edge, centre crop, normalised, channels first."""
    return ((square_thumb(img, edge) / 255.0 - ENCODER_MEAN) / ENCODER_STD).transpose(2, 0, 1)


def letterbox(img: np.ndarray, edge: int = 640) -> tuple[np.ndarray, float]:
    """Fitted into the top left of a square, (x - 127.5) / 128, channels first; and the scale."""
    h, w = img.shape[:2]
    s = edge / max(h, w)
    out = np.zeros((edge, edge, 3))
    small = resized(img, max(1, int(w * s)), max(1, int(h * s)))
    out[: small.shape[0], : small.shape[1]] = small
    return ((out - 127.5) / 128).transpose(2, 0, 1), s


# ---------------------------------------------------------------- faces

def detections(scores, boxes, points, scale: float, edge: int = 640, anchors: int = 2, least: float = 0.5) -> list[dict]:
    """Boxes and landmarks of a detector with three strides, by falling score; distances are in strides from the anchor."""
    out = []
    for stride, s, b, k in zip((8, 16, 32), scores, boxes, points):
        s, b, k = np.ravel(s), np.reshape(b, (-1, 4)), np.reshape(k, (-1, 5, 2))
        side = edge // stride
        at = np.flatnonzero(s >= least)
        at = at[at // anchors < side * side]
        centre = np.stack([(at // anchors) % side, (at // anchors) // side], axis=1) * stride
        box = np.concatenate([centre - b[at, :2] * stride, centre + b[at, 2:] * stride], axis=1) / scale
        kps = (centre[:, None] + k[at] * stride) / scale
        out += [{"score": float(s[i]), "box": x.tolist(), "kps": y.tolist()} for i, x, y in zip(at, box, kps)]
    return sorted(out, key=lambda d: -d["score"])


def iou(a, b) -> float:
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    inter = max(w, 0) * max(h, 0)
    area = lambda c: max(c[2] - c[0], 0) * max(c[3] - c[1], 0)
    return inter / max(area(a) + area(b) - inter, 1e-6)


def suppressed(found: list[dict], threshold: float = 0.4) -> list[dict]:
    kept: list[dict] = []
    for d in sorted(found, key=lambda d: -d["score"]):
        if all(iou(k["box"], d["box"]) <= threshold for k in kept):
            kept.append(d)
    return kept


def similarity_transform(src: np.ndarray, dst: np.ndarray) -> tuple[float, float, float, float]:
    """(a, b, tx, ty) of the least-squares map x -> [[a, -b], [b, a]] x + t, by complex numbers."""
    p, q = src[:, 0] + 1j * src[:, 1], dst[:, 0] + 1j * dst[:, 1]
    dp, dq = p - p.mean(), q - q.mean()
    z = (np.conj(dp) * dq).sum() / max(float((np.abs(dp) ** 2).sum()), 1e-9)
    t = q.mean() - z * p.mean()
    return float(z.real), float(z.imag), float(t.real), float(t.imag)


def aligned_face(img: np.ndarray, landmarks: np.ndarray, edge: int = 112) -> np.ndarray:
    """The face warped to the template, bilinear."""
    a, b, tx, ty = similarity_transform(np.asarray(landmarks, float), FACE_TEMPLATE)
    z = complex(a, b)
    if abs(z) ** 2 < 1e-9:
        raise ValueError("landmarks in one point")
    x, y = np.meshgrid(np.arange(edge), np.arange(edge))
    w = ((x - tx) + 1j * (y - ty)) / z
    return sampled(img, w.real, w.imag)


def sampled(img: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Bilinear samples; places outside take the border's pixel."""
    h, w = img.shape[:2]
    x, y = np.clip(x, 0, w - 1), np.clip(y, 0, h - 1)
    x0, y0 = np.floor(x).astype(int), np.floor(y).astype(int)
    fx, fy, i = (x - x0)[..., None], (y - y0)[..., None], img.astype(float)
    x1, y1 = np.minimum(x0 + 1, w - 1), np.minimum(y0 + 1, h - 1)
    return (i[y0, x0] * (1 - fx) + i[y0, x1] * fx) * (1 - fy) + (i[y1, x0] * (1 - fx) + i[y1, x1] * fx) * fy


def face_crop(img: np.ndarray, box, edge: int = 192, pad: float = 0.32) -> np.ndarray:
    """A square around the box with room on each side, within the image."""
    side = max(box[2] - box[0], box[3] - box[1]) * (1 + 2 * pad)
    cx, cy, h, w = (box[0] + box[2]) / 2, (box[1] + box[3]) / 2, *img.shape[:2]
    x0, y0 = int(max(cx - side / 2, 0)), int(max(cy - side / 2, 0))
    x1, y1 = int(min(cx + side / 2, w)), int(min(cy + side / 2, h))
    return resized(img[y0 : max(y1, y0 + 1), x0 : max(x1, x0 + 1)], edge, edge)


# ---------------------------------------------------------------- colour and crop

def adjusted(img: np.ndarray, **a: float) -> np.ndarray:
    """The colour pipeline over a raster, 14 adjustments with mono and fade, in its fixed order."""
    v = lambda k: float(a.get(k, 0.0))
    c = img.astype(float) / 255
    h, w = c.shape[:2]
    luma = lambda c: (c @ [0.2126, 0.7152, 0.0722])[..., None]
    smooth = lambda lo, hi, x: (t := np.clip((x - lo) / (hi - lo), 0, 1)) * t * (3 - 2 * t)
    if v("sharpen") > 0.001:
        p = np.pad(c, ((1, 1), (1, 1), (0, 0)), mode="edge")
        c = c + (c - (p[1:-1, 2:] + p[1:-1, :-2] + p[2:, 1:-1] + p[:-2, 1:-1]) / 4) * v("sharpen") * 1.6
    c = c * 2 ** v("exposure")
    l = luma(c)  # noqa: E741
    hi, lo = smooth(0.5, 1.0, l), 1 - smooth(0.0, 0.5, l)
    c = c + v("highlights") * hi * (1 - c) * 0.9
    c = c + v("shadows") * lo * 0.55 + v("brilliance") * (lo * 0.35 - hi * 0.22) + v("brightness") * 0.4
    black = v("black") * 0.25
    c = ((c - black) / max(1 - black, 0.05) - 0.5) * (1 + v("contrast")) + 0.5
    c = c + np.array([v("warmth") * 0.12 - v("tint") * 0.04, v("tint") * 0.10, -v("warmth") * 0.12 - v("tint") * 0.04])
    mix = lambda x, y, t: x + (y - x) * t
    c = mix(luma(c), c, 1 + v("saturation"))
    spread = (c.max(axis=2) - c.min(axis=2))[..., None]
    c = mix(luma(c), c, 1 + v("vibrance") * (1 - spread) * 1.4)
    c = mix(c, luma(c), v("mono")) if v("mono") > 0.001 else c
    c = mix(c, c * 0.86 + 0.14, v("fade")) if v("fade") > 0.001 else c
    x, y = np.meshgrid((np.arange(w) + 0.5) / w, (np.arange(h) + 0.5) / h)
    if v("vignette") > 0.001:
        c = c * (1 - v("vignette") * smooth(0.25, 0.85, ((x - 0.5) ** 2 + (y - 0.5) ** 2) * 2))[..., None]
    if v("grain") > 0.001:
        noise = np.sin(x * w * 12.9898 + y * h * 78.233) * 43758.5453
        c = c + ((noise - np.floor(noise) - 0.5) * v("grain") * 0.14)[..., None]
    return np.rint(np.clip(c, 0, 1) * 255).astype(np.uint8)


def straighten_zoom(angle: float, w: float, h: float) -> float:
    """How far a w x h crop must be enlarged so that a turn by the angle leaves no empty corner."""
    if abs(angle) < 1e-4:
        return 1.0
    c, s = np.cos(abs(angle)), np.sin(abs(angle))
    return float(max(c + s * h / w, c + s * w / h))


def ratio_crop(w: float, h: float, ratio: float) -> tuple[float, float, float, float]:
    """The largest centred rectangle (x, y, w, h in shares) of a ratio."""
    if ratio <= 0:
        return 0.0, 0.0, 1.0, 1.0
    cw, ch = min(1.0, ratio / (w / h)), min(1.0, (w / h) / ratio)
    return (1 - cw) / 2, (1 - ch) / 2, cw, ch


def transformed(img: np.ndarray, crop=(0.0, 0.0, 1.0, 1.0), quarter_turns: int = 0, flip=(False, False), angle: float = 0.0) -> np.ndarray:
    """Crop, quarter turns (clockwise), flips and straightening, sampled in one pass."""
    turned = np.rot90(img[:, ::-1] if flip[0] else img, -quarter_turns)
    turned = turned[::-1] if flip[1] else turned
    h, w = turned.shape[:2]
    cx, cy, cw, ch = crop
    ow, oh = max(1, round(cw * w)), max(1, round(ch * h))
    x, y = np.meshgrid((np.arange(ow) + 0.5) / ow * cw * w, (np.arange(oh) + 0.5) / oh * ch * h)
    z = ((x - cw * w / 2) + 1j * (y - ch * h / 2)) * np.exp(1j * angle) / straighten_zoom(angle, cw * w, ch * h)
    return np.rint(sampled(turned, z.real + (cx + cw / 2) * w - 0.5, z.imag + (cy + ch / 2) * h - 0.5)).astype(np.uint8)


# ---------------------------------------------------------------- bytes

_EXIF_TEXT = {0x010F: "make", 0x0110: "model", 0x0132: "written", 0x9003: "original", 0x9004: "digitized", 0xA434: "lens"}
_EXIF_NUMBER = {0x0112: "orient", 0x8827: "iso", 0x829A: "expo", 0x829D: "fnum", 0x920A: "focal"}


def read_exif(data: bytes) -> dict:
    """Tags of the TIFF block in a JPEG (or of bare TIFF bytes); a broken entry is skipped, the others count."""
    at, png = data.find(b"Exif\0\0", 0, 131072), data.find(b"eXIf", 0, 131072) if data[:4] == b"\x89PNG" else -1
    block = data[at + 6 :] if at >= 0 else data[png + 4 :] if png >= 0 else data
    end = {b"II": "<", b"MM": ">"}.get(block[:2])
    out: dict = {}
    if end is None:
        return out
    size = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 7: 1, 9: 4, 10: 8}

    def directory(offset: int) -> None:
        if offset + 2 > len(block):
            return
        (n,) = struct.unpack_from(end + "H", block, offset)
        for i in range(n):
            try:
                tag, kind, count = struct.unpack_from(end + "HHI", block, offset + 2 + 12 * i)
                where = offset + 10 + 12 * i
                if size[kind] * count > 4:
                    (where,) = struct.unpack_from(end + "I", block, where)
                if tag == 0x8769:
                    directory(struct.unpack_from(end + "I", block, where)[0])
                elif tag in _EXIF_TEXT and kind == 2:
                    out[_EXIF_TEXT[tag]] = block[where : where + count].split(b"\0")[0].decode("utf-8", "replace").strip()
                elif tag in _EXIF_NUMBER:
                    if kind in (5, 10):
                        a, b = struct.unpack_from(end + ("II" if kind == 5 else "ii"), block, where)
                        out[_EXIF_NUMBER[tag]] = f"{a}/{b}" if tag == 0x829A else a / b if b else None
                    else:
                        out[_EXIF_NUMBER[tag]] = struct.unpack_from(end + {1: "B", 3: "H", 4: "I", 7: "B", 9: "i"}[kind], block, where)[0]
            except (struct.error, KeyError):
                continue

    if len(block) >= 8:
        directory(struct.unpack_from(end + "I", block, 4)[0])
    return out


def embedded_jpegs(data: bytes, least: int = 1024, tries: int = 4) -> list[tuple[int, int]]:
    """(start, end) of JPEG spans over `least` bytes, from a start marker to the last end marker before the next start; longest first."""
    starts, at = [], data.find(b"\xff\xd8\xff")
    while at >= 0:
        starts.append(at)
        at = data.find(b"\xff\xd8\xff", at + 3)
    spans = []
    for a, b in zip(starts, [*starts[1:], len(data)]):
        end = data.rfind(b"\xff\xd9", a, b)
        if end >= 0 and end + 2 - a > least:
            spans.append((a, end + 2))
    return sorted(spans, key=lambda s: s[0] - s[1])[:tries]


# ---------------------------------------------------------------- UDFs

def _fields(**kinds) -> T.StructType:
    """As an object: text would be parsed by a session, which workers that import this module lack."""
    return T.StructType([T.StructField(k, v) for k, v in kinds.items()])


_THUMB = _fields(w=T.IntegerType(), h=T.IntegerType(), dhash=T.LongType(), thumb=T.BinaryType(), err=T.StringType())


def _thumbs(makers, edges) -> pd.DataFrame:
    rows = []
    for make, e in zip(makers, edges):
        try:
            img = make()
            rows.append((img.shape[1], img.shape[0], difference_hash(img), encode_png(square_thumb(img, int(e))), None))
        except Exception as x:
            rows.append((None, None, None, None, f"{type(x).__name__}: {x}"[:200]))
    out = pd.DataFrame(rows, columns=["w", "h", "dhash", "thumb", "err"])
    return out.astype({"w": "Int32", "h": "Int32", "dhash": "Int64"})


def upright(data: bytes) -> np.ndarray:
    """The raster of image bytes, turned as its EXIF orientation says; where the file itself has no decoder, its largest embedded preview of 160 pixels a side or more."""
    turn = read_exif(data).get("orient", 1)
    try:
        return oriented(decode(data), turn)
    except ValueError as first:
        for a, b in embedded_jpegs(data):
            try:
                img = decode(data[a:b])
            except ValueError:
                continue
            if min(img.shape[:2]) >= 160:
                return oriented(img, turn)
        raise first


#: Images of a batch that Python holds as objects at a time; the rest of it stays in Arrow's buffers.
HELD = 128
_THUMB_ARROW = pa.schema([("w", pa.int32()), ("h", pa.int32()), ("dhash", pa.int64()), ("thumb", pa.binary()), ("err", pa.string())])


def _by_pieces(maker, edge: pa.Array, *columns: pa.Array) -> pa.Array:
    """Thumbnails of the rasters that maker(*values) gives, HELD rows after HELD."""
    done = []
    for k in range(0, len(edge), HELD):
        rows = zip(*(c.slice(k, HELD).to_pylist() for c in columns))
        made = _thumbs([lambda r=r: maker(*r) for r in rows], edge.slice(k, HELD).to_pylist())
        done.append(pa.RecordBatch.from_pandas(made, _THUMB_ARROW, preserve_index=False).to_struct_array())
    return pa.concat_arrays(done) if done else pa.array([], pa.struct(list(_THUMB_ARROW)))


@F.arrow_udf(_THUMB)
def thumbnail(content: pa.Array, edge: pa.Array) -> pa.Array:
    """Size, difference hash and square PNG thumbnail of image bytes, turned upright; err for what cannot be read."""
    return _by_pieces(lambda d: upright(bytes(d)), edge, content)


@F.arrow_udf(_THUMB)
def thumbnail_of_raster(data: pa.Array, h: pa.Array, w: pa.Array, channels: pa.Array, orient: pa.Array, edge: pa.Array) -> pa.Array:
    """The same of an image that Spark has decoded."""

    def img(d, y, x, n, o):
        if y is None or y <= 0:
            raise ValueError("no decoder for these bytes")
        return oriented(raster_of(bytes(d), y, x, n), 1 if o is None else o)

    return _by_pieces(img, edge, data, h, w, channels, orient)


def raster_function(fn, returns: T.DataType):
    """A pandas UDF over image bytes and one more column: fn(upright raster, value); NULL for what cannot be read."""

    @F.pandas_udf(returns)
    def run(content: pd.Series, value: pd.Series) -> pd.Series:
        out = []
        for data, v in zip(content, value):
            try:
                out.append(fn(upright(bytes(data)), v))
            except Exception:
                out.append(None)
        return pd.Series(out, dtype=object)

    return run


_FLOATS = T.ArrayType(T.FloatType())
#: PNG of the image with no edge longer than the value; the encoder's input of that edge; the detector's, fitted in a square; the face in a box.
preview = raster_function(lambda img, edge: encode_png(fit_thumb(img, int(edge))), T.BinaryType())
encoder_tensor = raster_function(lambda img, edge: encoder_input(img, int(edge)).ravel().astype(np.float32), _FLOATS)
detector_tensor = raster_function(lambda img, edge: letterbox(img, int(edge))[0].ravel().astype(np.float32), _FLOATS)
face_png = raster_function(lambda img, box: encode_png(face_crop(img, list(box))), T.BinaryType())
aligned_png = raster_function(lambda img, marks: encode_png(np.rint(aligned_face(img, np.reshape(list(marks), (5, 2)))).astype(np.uint8)), T.BinaryType())


# JPEG qualities of grid thumbnails, previews, recompressed originals and saved edits.
THUMB_QUALITY, PREVIEW_QUALITY, RECOMPRESS_QUALITY, EDIT_QUALITY = 78, 84, 82, 90
grid_jpeg = raster_function(lambda img, edge: encode_jpeg(square_thumb(img, int(edge)), THUMB_QUALITY), T.BinaryType())
preview_jpeg = raster_function(lambda img, edge: encode_jpeg(fit_thumb(img, int(edge)), PREVIEW_QUALITY), T.BinaryType())


def edited(quality: int | None = None, **adjustments):
    """A pandas UDF: the image after crop, turns and colour, as PNG, or JPEG of a quality; adjustments as in `adjusted` and `transformed`. The value column is not looked at."""
    moves = {k: adjustments.pop(k) for k in ("crop", "quarter_turns", "flip", "angle") if k in adjustments}
    coded = encode_png if quality is None else lambda img: encode_jpeg(img, quality)
    return raster_function(lambda img, _: coded(adjusted(transformed(img, **moves), **adjustments)), T.BinaryType())


@F.pandas_udf(T.BinaryType())
def recompressed_raster(data: pd.Series, h: pd.Series, w: pd.Series, channels: pd.Series, orient: pd.Series, size: pd.Series, quality: pd.Series, edge: pd.Series) -> pd.Series:
    """JPEG of an image that Spark has decoded, upright, with no edge longer; NULL if it is not smaller than the file was, or cannot be made."""
    out = []
    for d, y, x, n, o, most, q, e in zip(data, h, w, channels, orient, size, quality, edge):
        try:
            made = encode_jpeg(fit_thumb(oriented(raster_of(bytes(d), int(y), int(x), int(n)), 1 if o is None or pd.isna(o) else int(o)), int(e)), int(q))
        except Exception:
            made = None
        out.append(made if made is not None and len(made) < most else None)
    return pd.Series(out, dtype=object)


@F.pandas_udf(T.ArrayType(_fields(start=T.IntegerType(), end=T.IntegerType())))
def embedded(content: pd.Series) -> pd.Series:
    """Where JPEG previews lie in file bytes, longest first."""
    return content.map(lambda d: None if d is None else [{"start": a, "end": b} for a, b in embedded_jpegs(bytes(d))])


@F.pandas_udf(_fields(**dict.fromkeys(("make", "model", "lens", "expo", "taken"), T.StringType()), **dict.fromkeys(("orient", "iso"), T.IntegerType()), **dict.fromkeys(("fnum", "focal"), T.DoubleType())))
def exif(content: pd.Series) -> pd.DataFrame:
    """EXIF fields of image bytes; the capture time as text, the moment of the shot before that of the file."""
    rows = []
    for data in content:
        m = read_exif(bytes(data)) if data is not None else {}
        taken = next((m[k] for k in ("original", "digitized", "written") if m.get(k)), None)
        rows.append((m.get("make"), m.get("model"), m.get("lens"), m.get("expo"), taken, m.get("orient"), m.get("iso"), m.get("fnum"), m.get("focal")))
    out = pd.DataFrame(rows, columns=["make", "model", "lens", "expo", "taken", "orient", "iso", "fnum", "focal"])
    return out.astype({"orient": "Int32", "iso": "Int32", "fnum": "float64", "focal": "float64"})


@F.pandas_udf(T.ArrayType(T.FloatType()))
def vector_of_bytes(blob: pd.Series) -> pd.Series:
    """Little-endian float32 bytes to a vector; bytes after the last whole number are dropped."""
    return blob.map(lambda b: None if b is None else np.frombuffer(bytes(b)[: len(b) // 4 * 4], "<f4"))


@F.pandas_udf(T.BinaryType())
def bytes_of_vector(vec: pd.Series) -> pd.Series:
    return vec.map(lambda v: None if v is None else np.asarray(v, "<f4").tobytes())
