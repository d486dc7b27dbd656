"""Encoders, token files and token counts against the tokenizers library."""

import struct
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from medialoom.llm import bpe, dac, queries, tokencount
from medialoom.llm.common import fresh_path


def key(r):
    return (r[0] is None, r[0] or 0, *map(str, r[1:]))


@pytest.fixture(scope="module")
def word():
    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


@pytest.fixture(scope="module")
def byte():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_speculative_bpe_is_the_library(word):
    enc = bpe.encoder(bpe.vocabulary("word_bpe_49k.json"))
    rng = np.random.default_rng(1)
    texts = ["".join(map(chr, rng.integers(1, 0x180, 40))) for _ in range(300)] + ["".join(map(chr, rng.integers(0x20, 0xD7FF, 30))) for _ in range(100)]
    names = [t.replace("</w>", "") for t in word.get_vocab()]
    texts += [" ".join(names[i] + names[j] for i, j in rng.integers(0, len(names), (8, 2))) for _ in range(300)]
    texts += ["", "x" * 3000, "ab" * 2000, "\0", "a\0b", "İstanbul", "Σας", "<|startoftext|>a<|endoftext|>", "it's we'll I'D"]
    ids, decoded = enc.encode_texts(texts)
    for t, i, d in zip(texts, ids, decoded):
        e = word.encode(t, add_special_tokens=False).ids
        assert i == " ".join(map(str, e)), t
        assert d == word.decode(e, skip_special_tokens=False), t


def test_failing_pairs_are_merged_exactly():
    enc = bpe.encoder(bpe.vocabulary("word_bpe_49k.json"))
    words = [w[:9] for w in "tothether aninging erreding thathes untion ofthe ingand".split()]
    assert [enc.merged(enc.symbols(w)) for w in words] == enc.encode_words(words)
    rng = np.random.default_rng(9)
    many = ["".join(rng.choice(list("aeinrstho"), n)) for n in rng.integers(1, 70, 500)]
    assert enc.merged_many([enc.symbols(w) for w in many]) == [enc.merged(enc.symbols(w)) for w in many]
    long = "anthinger" * 40
    assert enc._merged_long(enc.symbols(long)) == enc.encode_words([long])[0]


def test_encode_rows(spark, odd, odd_rows, empty, word):
    got = sorted(map(tuple, bpe.encode(odd).collect()), key=key)
    want = []
    for i, t in odd_rows:
        e = word.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(e), " ".join(map(str, e)), word.decode(e, skip_special_tokens=False)))
    assert got == sorted(want, key=key)
    assert bpe.encode(empty).count() == 0


def test_cached_words_are_bounded(word, monkeypatch):
    """Words over the bound are forgotten, and the encodings stay the same; a change of texts starts anew."""
    monkeypatch.setattr(bpe, "CACHE", 50)
    monkeypatch.setattr(bpe, "PAIRS", 60)
    enc = bpe.SpeculativeBPE(bpe.vocabulary("word_bpe_49k.json"))
    rng = np.random.default_rng(3)
    names = sorted(t.replace("</w>", "") for t in word.get_vocab() if t.isascii())
    for k in range(12):
        texts = [" ".join(names[i] for i in rng.integers(k * 500, k * 500 + 400, 12)) + (" <|endoftext|>" if j % 3 == 0 else "") for j in range(6)] + [None, ""]
        n, ids, decoded = enc.encoded(texts)
        want = [word.encode(t or "", add_special_tokens=False).ids for t in texts]
        assert ids.to_pylist() == [" ".join(map(str, e)) for e in want] and n.tolist() == list(map(len, want))
        assert decoded.to_pylist() == [word.decode(e, skip_special_tokens=False) for e in want]
        assert len(enc.words) <= 50 and len(enc.words) == len(enc.sizes) == len(enc.id_text)
        assert (np.diff(enc.pairs) > 0).all()


@pytest.mark.parametrize("ids", [[], [2], [0, 255, 256, 65535, 65536, 2**32 - 1], list(range(0, 70000, 7))])
def test_dac_round_trip(tmp_path, ids):
    ids = np.array(ids, np.uint32)
    path = f"file://{tmp_path}/x.dac"
    counts = np.array([0, len(ids) // 2, len(ids) - len(ids) // 2])
    dac.write_file(path, np.array([5, 6, 9]), counts, ids)
    r = dac.Reader(path)
    assert r.documents()[0].tolist() == [5, 6, 9] and r.documents()[1].tolist() == [0, 0, len(ids) // 2, len(ids)]
    assert (r.ids(0, len(ids)) == ids).all()
    rng = np.random.default_rng(0)
    for a, b in np.sort(rng.integers(0, len(ids) + 1, (40, 2)), axis=1):
        assert (r.ids(a, b) == ids[a:b]).all()
    for i in rng.integers(0, max(len(ids), 1), 40) if len(ids) else []:
        assert r[i] == ids[i]


def brute_files(rows, byte):
    start, out = 0, []
    for i, t in rows:
        ids = byte.encode(t or "", add_special_tokens=False).ids + [2]
        out.append((i, start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        start += len(ids)
    return out


def test_stored_corpus(spark, odd, odd_rows, empty, byte, monkeypatch):
    monkeypatch.setattr(dac, "PART_BYTES", 50_000)
    got = dac.stored(odd).select("doc_id", "start", "n_tokens", F.crc32("ids")).collect()
    unique = [r for r in odd_rows if r[0] not in (13, 14)]
    first = brute_files([(None, next(t for i, t in odd_rows if i is None))], byte)[0]
    assert tuple(got[[r[0] for r in got].index(None)]) == first  # null ids come first
    order = sorted((r for r in map(tuple, got)), key=lambda r: r[1])
    assert [r[1] for r in order] == [sum(x[2] for x in order[:k]) for k in range(len(order))]
    assert [r[0] for r in order[1:]] == sorted(i for i, _ in odd_rows if i is not None)
    want = {i: (n, crc) for i, _, n, crc in brute_files(unique, byte)}
    assert all(want[r[0]] == r[2:] for r in order if r[0] in want)
    assert dac.stored(empty).count() == 0


def test_op7_on_a_fixture(spark, tmp_path, byte):
    rows = [(i * 3, f"text number {i} of <|endoftext|> " + "x" * i) for i in range(50)]
    spark.createDataFrame(rows[::-1], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op7_token_files(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == brute_files(rows, byte)


def test_token_counts(odd, odd_rows, empty):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    got = sorted(((r["doc_id"], r["n_tokens"]) for r in tokencount.token_counts(odd).collect()), key=key)
    assert got == sorted(((i, len(t.encode(x or "", add_special_tokens=False).ids)) for i, x in odd_rows), key=key)
    assert tokencount.token_counts(empty).count() == 0


@pytest.mark.parametrize("block", [1, 2, 3, 7, 1000])
def test_separator_scan_stitches_blocks(spark, tmp_path, block):
    files = {"a": [9, 9, 1, 2, 3, 9, 4], "b": [1, 9], "c": [1, 2, 3, 4, 5, 6, 7, 8, 10, 11, 9, 9], "d": [], "e": [5, 5]}
    for n, ids in files.items():
        (tmp_path / n).write_bytes(np.array(ids, "<u2").tobytes())
    df = spark.createDataFrame([(f"file://{tmp_path}/{n}",) for n in files], "file string")
    got = sorted((r["file"][-1], r["doc_no"], r["start"], r["n_tokens"], r["ended"]) for r in tokencount.scan_flat(spark, df, 9, block=block).collect())
    want = []
    for n, ids in files.items():
        start = no = 0
        for k, x in enumerate(ids):
            if x == 9:
                want.append((n, no, start, k - start, True))
                start, no = k + 1, no + 1
        if start < len(ids):
            want.append((n, no, start, len(ids) - start, False))
    assert got == sorted(want)


def test_half_an_id_is_an_error(spark, tmp_path):
    (tmp_path / "f").write_bytes(b"123")
    with pytest.raises(Exception, match="within an id"):
        tokencount.scan_flat(spark, spark.createDataFrame([(f"file://{tmp_path}/f",)], "file string"), 9).collect()
