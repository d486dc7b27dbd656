"""Baseline JPEG encoding of numpy rasters (ITU-T T.81), a whole image at a time: no step a pixel or a block."""

from __future__ import annotations

import struct

import numpy as np

# Fixed values of the standard (Annex K): quantisation for luminance and chrominance, in raster order.
_LUMINANCE = [16, 11, 10, 16, 24, 40, 51, 61, 12, 12, 14, 19, 26, 58, 60, 55, 14, 13, 16, 24, 40, 57, 69, 56, 14, 17, 22, 29, 51, 87, 80, 62, 18, 22, 37, 56, 68, 109, 103, 77, 24, 35, 55, 64, 81, 104, 113, 92, 49, 64, 78, 87, 103, 121, 120, 101, 72, 92, 95, 98, 112, 100, 103, 99]
_CHROMINANCE = [17, 18, 24, 47, 99, 99, 99, 99, 18, 21, 26, 66, 99, 99, 99, 99, 24, 26, 56, 99, 99, 99, 99, 99, 47, 66, 99, 99, 99, 99, 99, 99, *[99] * 32]
_ZIGZAG = sorted(range(64), key=lambda i: (i // 8 + i % 8, (i // 8 if (i // 8 + i % 8) % 2 else i % 8)))
_DCT = np.array([[(np.sqrt(1 / 8) if k == 0 else 0.5) * np.cos((2 * n + 1) * k * np.pi / 16) for n in range(8)] for k in range(8)])


def _lengths(counts: np.ndarray) -> np.ndarray:
    """Lengths of a prefix code for symbols of these counts: 16 bits at most, and no code of ones alone (a symbol that never occurs takes it)."""
    w = np.append(counts, 1e-9)
    while True:
        used = [(float(c), [i]) for i, c in enumerate(w) if c > 0]
        out = np.zeros(len(w), int)
        while len(used) > 1:
            used.sort(key=lambda x: -x[0])
            (a, x), (b, y) = used.pop(), used.pop()
            out[x + y] += 1
            used.append((a + b, x + y))
        if out.max() <= 16:
            return out
        w = np.where(w > 0, np.sqrt(w) + 1, 0)  # flatter counts give shorter longest codes


class _Code:
    """The prefix code of one table: the bits and their number for each symbol, and the table's bytes."""

    def __init__(self, symbols: np.ndarray, number: int):
        counts = np.bincount(symbols, minlength=256).astype(float)
        size = _lengths(counts)
        size[-1] = max(size[-1], size[:-1].max())  # the reserved code is a longest one
        order = [i for i in np.lexsort((np.arange(257), size)) if size[i]]
        order.remove(256)
        self.size, self.bits = np.zeros(256, np.int64), np.zeros(256, np.int64)
        code = last = 0
        for i in order:
            code <<= int(size[i]) - last
            last = int(size[i])
            self.size[i], self.bits[i] = last, code
            code += 1
        per = np.bincount(size[order], minlength=17)[1:17]
        body = bytes([number]) + bytes(per.tolist()) + bytes(order)
        self.segment = b"\xff\xc4" + struct.pack(">H", 2 + len(body)) + body


def _quantiser(base: list[int], quality: int) -> np.ndarray:
    scale = 5000 // quality if quality < 50 else 200 - 2 * quality
    return np.clip((np.array(base) * scale + 50) // 100, 1, 255)


def _blocks(plane: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Quantised coefficients of the 8 x 8 blocks, in zigzag order."""
    h, w = plane.shape
    padded = np.pad(plane, ((0, -h % 8), (0, -w % 8)), mode="edge") - 128
    cut = padded.reshape(padded.shape[0] // 8, 8, -1, 8).transpose(0, 2, 1, 3).reshape(-1, 8, 8)
    return np.rint((_DCT @ cut @ _DCT.T).reshape(-1, 64) / table)[:, _ZIGZAG].astype(np.int64)


def _category(v: np.ndarray) -> np.ndarray:
    """How many bits the magnitude has."""
    return np.frexp(np.abs(v).astype(float))[1]


def _symbols(c: np.ndarray):
    """The stream of a plane: block, place in the block, symbol, value bits and their number. The first symbol of a block is its DC's."""
    n = len(c)
    dc = np.diff(c[:, 0], prepend=0)
    block, at = np.nonzero(c[:, 1:])
    at = at + 1
    value = c[block, at]
    first = np.ones(len(block), bool)
    first[1:] = block[1:] != block[:-1]
    before = np.where(first, 0, np.concatenate([[0], at[:-1]]))
    run = at - before - 1
    size = _category(value)
    long = run // 16  # runs of sixteen zeros have a symbol of their own
    fill = np.repeat(np.arange(len(block)), long)
    last = np.zeros(n, int)
    np.maximum.at(last, block, at)
    short = np.flatnonzero(last < 63)
    parts = [
        (np.arange(n), np.zeros(n, int), np.zeros(n, int), _category(dc), dc, _category(dc)),
        (block[fill], at[fill], np.zeros(len(fill), int), np.full(len(fill), 0xF0), np.zeros(len(fill), int), np.zeros(len(fill), int)),
        (block, at, np.ones(len(block), int), (run % 16) << 4 | size, value, size),
        (short, np.full(len(short), 64), np.ones(len(short), int), np.zeros(len(short), int), np.zeros(len(short), int), np.zeros(len(short), int)),
    ]
    block, at, turn, symbol, value, size = (np.concatenate(x) for x in zip(*parts))
    order = np.lexsort((turn, at, block))
    extra = np.where(value < 0, value + (1 << size) - 1, value)
    return block[order], at[order], symbol[order], extra[order], size[order]


def encode_jpeg(img: np.ndarray, quality: int = 82) -> bytes:
    """A baseline JPEG of an RGB raster, with tables made for this image."""
    h, w = img.shape[:2]
    if not (0 < h < 65536 and 0 < w < 65536):
        raise ValueError("no JPEG has this size")
    r, g, b = (img[..., i].astype(float) for i in range(3))
    y = 0.299 * r + 0.587 * g + 0.114 * b
    tables = [_quantiser(_LUMINANCE, quality), _quantiser(_CHROMINANCE, quality)]
    planes = [_symbols(_blocks(p, tables[min(i, 1)])) for i, p in enumerate((y, (b - y) / 1.772 + 128, (r - y) / 1.402 + 128))]
    codes = []
    for kind in (0, 1):
        mine = planes[:1] if kind == 0 else planes[1:]
        for ac in (False, True):
            chosen = np.concatenate([s[(at > 0) == ac] for _, at, s, _, _ in mine])
            codes.append(_Code(chosen if len(chosen) else np.array([0]), ac << 4 | kind))
    # Blocks of the three planes take turns.
    block = np.concatenate([p[0] for p in planes])
    plane = np.repeat(np.arange(3), [len(p[0]) for p in planes])
    order = np.lexsort((np.arange(len(block)), plane, block))
    bits, sizes = [], []
    for i, (_, at, symbol, extra, size) in enumerate(planes):
        dc, ac = codes[2 * min(i, 1)], codes[2 * min(i, 1) + 1]
        own = np.where(at > 0, ac.bits[symbol], dc.bits[symbol])
        bits.append(own << size | extra)
        sizes.append(np.where(at > 0, ac.size[symbol], dc.size[symbol]) + size)
    bits, sizes = np.concatenate(bits)[order], np.concatenate(sizes)[order]
    ends = np.cumsum(sizes)
    shift = np.repeat(ends, sizes) - 1 - np.arange(int(ends[-1]))
    stream = (np.repeat(bits, sizes) >> shift & 1).astype(np.uint8)
    data = np.packbits(np.concatenate([stream, np.ones(-len(stream) % 8, np.uint8)])).tobytes().replace(b"\xff", b"\xff\x00")
    out = b"\xff\xd8\xff\xe0\x00\x10JFIF\x00\x01\x01\x00\x00\x01\x00\x01\x00\x00"
    for i, t in enumerate(tables):
        out += b"\xff\xdb\x00\x43" + bytes([i]) + bytes(t[_ZIGZAG].tolist())
    out += b"\xff\xc0\x00\x11\x08" + struct.pack(">HH", h, w) + b"\x03\x01\x11\x00\x02\x11\x01\x03\x11\x01"
    out += b"".join(c.segment for c in codes)
    return out + b"\xff\xda\x00\x0c\x03\x01\x00\x02\x11\x03\x11\x00\x3f\x00" + data + b"\xff\xd9"
