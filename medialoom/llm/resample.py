"""Importance resampling towards a target distribution, by exact distributed selection.

Features are runs of 1 to 3 words; a feature's bucket is the CRC-32 of its text modulo BUCKETS.
The CRCs of all words of many texts are computed together, and those of longer runs follow from
them: appending a word moves the CRC so far over the word's bytes (a linear map, looked up by
the word's length) and adds the word's own.  Bucket counts of the raw and of the target texts
give a gain a bucket; a document's weight is the sum of its features' gains, taken from that
array for all documents of a batch at once.

With Gumbel noise that a hash of the doc_id fixes, the k largest scores are a sample without
replacement in proportion to exp(weight / 1000).  The k-th key is found by radix selection: the composite key
(score, doc_id, number of features, row number) is cut into digits of DIGIT bits, one pass
counts the rows of each value of a digit, and only rows that share the k-th key's digits so far
are counted again; leading bits that all rows share are skipped.  At most 2**DIGIT counts come
to the driver, however many rows tie.  Rows up to the k-th key, and no others, are then sorted
by ranges and numbered.

Defined results: a null or empty text has no features, weight 0 and is never drawn, as are all
texts under `least_words` words; a null doc_id comes back null, counts as the smallest in ties
and has the noise of an empty id; rows repeated in the input are scored and drawn one by one (they share
score and id, so which of equal rows is drawn makes no difference); an empty table gives an
empty one, an empty target counts nothing (T = 0); a fraction that gives no row draws none;
texts and words of any length are taken whole; columns other than doc_id and text are not
looked at by `report`, and pass through `drawn` whatever their names.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from medialoom.llm.bpe import chunks
from medialoom.llm.common import ascii_lower, documents_of, dropped, saved, spread
from medialoom.operators.library import numbered

BUCKETS, RUN = 10_000, 3
#: Bits of a digit of the radix selection.
DIGIT = 12
#: Texts whose words are hashed together.
CHUNK_CHARS = 1_000_000
_SHORT = 64
_MIN = -(2**63)

# ---------------------------------------------------------------- CRC-32 of many words at once

#: The bytes of words: digits, a-z (texts are in lower case by then) and all bytes of characters beyond ASCII.
_IN_WORD = np.array([48 <= b <= 57 or 97 <= b <= 122 or b >= 128 for b in range(256)])


def _table() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> 1) ^ np.uint32(0xEDB88320), c >> 1)
    return c


_CRC = _table()


def _moved(maps: np.ndarray, x: np.ndarray) -> np.ndarray:
    """A linear map, given by its values on each byte of a 32-bit number (4 x 256), of x."""
    return maps[0][x & 255] ^ maps[1][(x >> 8) & 255] ^ maps[2][(x >> 16) & 255] ^ maps[3][x >> 24]


def _over_one(x: np.ndarray) -> np.ndarray:
    return _CRC[x & 255] ^ (x >> 8)


def _zeros() -> tuple[np.ndarray, list[np.ndarray]]:
    """What appending 0.._SHORT zero bytes does to a CRC, and appending 2**k of them from _SHORT on."""
    maps = [np.arange(256, dtype=np.uint32)[None, :] << np.array([[0], [8], [16], [24]], np.uint32)]
    for _ in range(_SHORT):
        maps.append(_over_one(maps[-1]))
    powers = [maps[_SHORT]]
    while len(powers) < 26:
        powers.append(_moved(powers[-1], powers[-1]))
    return np.stack(maps), powers


_ZEROS, _POWERS = _zeros()
_FLAT = _ZEROS.reshape(-1)


def appended(crc: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The CRCs after n zero bytes each: what is added to the CRC of a following part of n bytes."""
    short = n & (_SHORT - 1)
    at = short * 1024
    out = _FLAT[at + (crc & 255)] ^ _FLAT[at + 256 + ((crc >> 8) & 255)] ^ _FLAT[at + 512 + ((crc >> 16) & 255)] ^ _FLAT[at + 768 + (crc >> 24)]
    long = np.flatnonzero(n >= _SHORT)
    for k, maps in enumerate(_POWERS):
        if not len(long):
            break
        some = long[(n[long] >> (6 + k)) & 1 == 1]
        out[some] = _moved(maps, out[some])
        long = long[n[long] >> (7 + k) > 0]
    return out


def _words(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and CRC of each word of lower-case bytes that end with a byte outside words."""
    x = np.frombuffer(data, np.uint8)
    edge = np.diff(_IN_WORD[x].view(np.int8), prepend=np.int8(0))
    start = np.flatnonzero(edge == 1)
    n = np.flatnonzero(edge == -1) - start
    crc = np.full(len(start), 0xFFFFFFFF, np.uint32)
    left = np.flatnonzero(n <= _SHORT)
    for k in range(_SHORT):
        left = left[n[left] > k]
        if not len(left):
            break
        c = crc[left]
        crc[left] = _CRC[(c ^ x[start[left] + k]) & 255] ^ (c >> 8)
    crc ^= np.uint32(0xFFFFFFFF)
    for i in np.flatnonzero(n > _SHORT).tolist():
        crc[i] = zlib.crc32(data[start[i] : start[i] + n[i]])
    return start, n, crc


def features(texts: list[str | None]) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """How many words each text has, and for runs of 1, 2 and 3 words: their buckets, and where each text's begin (one more number than texts)."""
    raw = [ascii_lower(t.encode()) if t else b"" for t in texts]
    start, n, crc = _words(b"\n".join(raw) + b"\n")
    cuts = np.searchsorted(start, np.concatenate([[0], np.cumsum([len(x) + 1 for x in raw])]))
    own = np.diff(cuts)
    joined = appended(np.full(len(n), zlib.crc32(b" "), np.uint32), n) ^ crc  # of " word"
    out, run = [], crc
    for k in range(RUN):
        if k:  # run[i] is of k words from i on; one more word follows
            run = appended(run[:-1], n[k:] + 1) ^ joined[k:] if len(run) else run
        bounds = np.concatenate([[0], np.cumsum(np.maximum(own - k, 0))])
        first = np.repeat(cuts[:-1] - bounds[:-1], np.diff(bounds))
        out.append(((run[first + np.arange(bounds[-1])] % np.uint32(BUCKETS)).astype(np.int64), bounds))
    return own, out


def _featured(texts: list[str | None]) -> Iterator[tuple[int, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]]:
    for lo, hi in chunks(texts, CHUNK_CHARS):
        yield (hi - lo, *features(texts[lo:hi]))


# ---------------------------------------------------------------- weights

def bucket_counts(docs: DataFrame) -> np.ndarray:
    """How many features of all texts fall in each bucket: added up in each task, and by bucket over the tasks."""

    def run(batches):
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for _, _, runs in _featured(batch.column(0).to_pylist()):
                for bucket, _ in runs:
                    total += np.bincount(bucket, minlength=BUCKETS)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["bucket", "n"])

    rows = docs.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()  # BUCKETS rows at most
    out = np.zeros(BUCKETS, np.int64)
    for bucket, n in rows:
        out[bucket] = n
    return out


def bucket_gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """For each bucket floor(1000 * ln of how much likelier it is in the target than in the raw texts), counts plus one."""
    s_all, t_all = float(raw.sum()) + BUCKETS, float(target.sum()) + BUCKETS
    ratios = ((target + 1.0) * s_all) / ((raw + 1.0) * t_all)
    return np.array([math.floor(1000 * math.log(x)) for x in ratios.tolist()], np.int64)


def weighed(docs: DataFrame, gains: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features and weight of each row, and its other columns but for text."""
    others = [c for c in docs.columns if c not in ("doc_id", "text")]

    def run(batches):
        for batch in batches:
            words, counts, weights = [], [], []
            for rows, own, runs in _featured(batch.column("text").to_pylist()):
                n, w = np.zeros(rows, np.int64), np.zeros(rows, np.int64)
                for bucket, bounds in runs:
                    total = np.concatenate([[0], np.cumsum(gains[bucket])])
                    n += np.diff(bounds)
                    w += np.diff(total[bounds])
                words.append(own), counts.append(n), weights.append(w)
            made = [pa.array(np.concatenate(x).astype(np.int64) if x else np.empty(0, np.int64)) for x in (words, counts, weights)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *made, *(batch.column(c) for c in others)], ["doc_id", "n_words", "n_features", "weight", *others])

    kinds = "".join(f", {c} {docs.schema[c].dataType.simpleString()}" for c in others)
    return docs.mapInArrow(run, f"doc_id long, n_words long, n_features long, weight long{kinds}")


def noise(seed: int = 42) -> Column:
    """floor(1000 * a standard Gumbel variate) that a hash of the seed and the doc_id fixes."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0)))


# ---------------------------------------------------------------- selection

def up_to(df: DataFrame, keys: list[str], k: int) -> Column:
    """The condition that holds for exactly the k first rows in the order of some long columns, the last of them without ties."""
    if k <= 0:
        return F.lit(False)
    inside, need, done = df.select(*keys), k, []
    for key in keys:
        low, high, n = inside.agg(F.min(key), F.max(key), F.count("*")).first()
        if n <= need:
            break
        low, high = low - _MIN, high - _MIN  # from 0 on, in the same order
        bits = (low ^ high).bit_length()
        while bits:
            shift = max(0, bits - DIGIT)
            digit = F.shiftrightunsigned(F.col(key).bitwiseXOR(F.lit(_MIN)), shift).bitwiseAND((1 << (bits - shift)) - 1)
            before = 0
            for d, n in sorted(inside.groupBy(digit.alias("digit")).count().collect()):
                if before + n >= need:
                    break
                before += n
            need -= before
            low = (low >> bits << bits) | (d << shift)
            high, bits = low + (1 << shift) - 1, shift
            inside = inside.filter(F.col(key).between(low + _MIN, high + _MIN))
            if n == need:
                break
        done.append((key, high + _MIN))
        if n == need:
            break
    if not done:
        return F.lit(True)
    key, most = done.pop()
    out = F.col(key) <= F.lit(most)
    for key, value in reversed(done):
        out = (F.col(key) < F.lit(value)) | ((F.col(key) == F.lit(value)) & out)
    return out


def _scored(docs: DataFrame, target: DataFrame, seed: int) -> DataFrame:
    """weighed(), the scores and the columns of the composite key, written: `last` rises as scores fall, `id` has a number for null ids, `row` is unique."""
    gains = bucket_gains(bucket_counts(docs), bucket_counts(target.select(F.col("text").cast("string").alias("text"))))
    df = weighed(docs, gains).withColumn("score", F.col("weight") + noise(seed))
    df = df.withColumn("last", F.bitwise_not("score")).withColumn("id", F.coalesce("doc_id", F.lit(_MIN)))
    return saved(df if "row" in df.columns else df.withColumn("row", F.monotonically_increasing_id()), "scores")


def _ranked(scored: DataFrame, percent: int, least_words: int) -> DataFrame:
    keys = ["last", "id", "n_features", "row"]
    fit = scored.filter(F.col("n_words") >= least_words)
    taken = (F.col("n_words") >= least_words) & up_to(fit, keys, percent * fit.count() // 100)
    drawn = numbered(scored.filter(taken), [F.col(c) for c in keys]).withColumnRenamed("number", "rank")
    return scored.filter(~taken).withColumn("rank", F.lit(None).cast("long")).unionByName(drawn)


def report(docs: DataFrame, target: DataFrame, percent: int = 5, least_words: int = 20, seed: int = 42) -> DataFrame:
    """doc_id, n_features, weight, score and rank (from 1; null where not drawn) of every document; `percent` of those with `least_words` words are drawn towards the texts of target (column text)."""
    out = _ranked(_scored(spread(documents_of(docs)), target, seed), percent, least_words)
    return out.select("doc_id", "n_features", "weight", "score", F.col("rank").cast("long").alias("rank"))


def drawn(docs: DataFrame, target: DataFrame, percent: int = 5, least_words: int = 20, seed: int = 42) -> DataFrame:
    """The documents drawn, with their own columns alone."""
    own = [f"c{i}" for i in range(len(docs.columns))]
    whole = saved(docs.toDF(*own).withColumn("row", F.monotonically_increasing_id()), "numbered-docs")
    named = whole.select(F.col(own[docs.columns.index("doc_id")]).cast("long").alias("doc_id"), F.col(own[docs.columns.index("text")]).cast("string").alias("text"), "row")
    scored = _scored(named, target, seed)
    rows = _ranked(scored, percent, least_words).filter("rank IS NOT NULL").select("row")
    out = saved(whole.join(rows.hint("merge"), "row").select(*own), "drawn")
    dropped(whole, scored)
    return out.toDF(*docs.columns)
