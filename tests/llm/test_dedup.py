"""Substring and near-duplicate removal against brute force."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from medialoom.llm import common, graph, neardup, repeats


def brute_repeats(rows, n=repeats.WINDOW):
    seen, out = set(), []
    for i, t in rows:
        w = (t or "").encode().split()
        gone = bytearray(len(w))
        for s in range(len(w) - n + 1):
            k = tuple(w[s : s + n])
            if k in seen:
                gone[s : s + n] = b"\1" * n
            seen.add(k)
        out.append((i, len(w), sum(gone), b" ".join(x for x, g in zip(w, gone) if not g).decode()))
    return out


def unique_ids(rows):
    """Null first, as the operator orders; ids that repeat have texts of no window."""
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))


def key(r):
    return (r[0] is None, r[0] or 0, r[3])


def test_repeats(odd, odd_rows, empty):
    got = repeats.remove_repeats(odd).collect()
    assert sorted((tuple(r[:4]) for r in got), key=key) == sorted(brute_repeats(unique_ids(odd_rows)), key=key)
    for r in got:
        assert sum(s["end"] - s["start"] for s in r["spans"]) == r["n_removed"]
    assert repeats.remove_repeats(empty).count() == 0


@pytest.mark.parametrize("fan", [4096, 4])
def test_repeats_at_random(spark, fan, monkeypatch):
    """Straight to the buckets, and through relays."""
    monkeypatch.setattr(repeats, "FAN", fan)
    monkeypatch.setattr(repeats, "BUCKET_BYTES", 20_000)
    monkeypatch.setattr(repeats, "SHARD_BYTES", 12_000)
    r = random.Random(7)
    words = [f"w{i}" for i in range(300)]
    passages = [" ".join(r.choices(words, k=k)) for k in (19, 20, 21, 35, 60, 200)]
    rows = []
    for i in range(300):
        parts = [" ".join(r.choices(words, k=r.randint(0, 40))) for _ in range(3)]
        parts += r.choices(passages, k=r.randint(0, 3))
        r.shuffle(parts)
        rows.append((i * 5, r.choice([" ", "\n", "\t\x0b "]).join(parts)))
    rows += [(5000 + i, "a b a b " * r.randint(1, 20)) for i in range(10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    how = repeats.layout(docs)
    assert how.relayed == (fan == 4) and how.shards > fan or fan > 4
    got = repeats.remove_repeats(docs).collect()
    assert sorted(tuple(x[:4]) for x in got) == brute_repeats(rows)


def test_a_shard_sends_no_more_rows_than_slots():
    """However many buckets there are; and the packs hold every window once."""
    import pyarrow as pa

    text = " ".join(f"w{random.Random(1).randint(0, 9)}x{i}" for i in range(30_000))
    shard = pa.table({"shard": pa.array([3], pa.int32()), "doc_id": [1], "text": [text]})
    for slots, per_slot in ((64, 1), (64, 64), (64, 1 << 20)):
        how = repeats.Layout(1 << 20, slots, per_slot)
        sent = repeats._index(how)(shard)
        assert sent.num_rows <= slots
        assert sum(len(x) for x in sent.column("hashes").to_pylist()) == np.dtype(how.kind).itemsize * (30_000 - repeats.BLOCK + 1)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "ab", "é", "漢字", "x" * 8, "y" * 64, "z" * 65, "y" * 200 + "b", "b" + "y" * 90, " ", "\n", "\t\x0b", "\x0c\r", "\u00a0", "\x1c"]), max_size=30))
def test_words_of_a_text(parts):
    text = "".join(parts).encode()
    at, to, h = common.words_of(text)
    assert [text[a:b] for a, b in zip(at, to)] == text.split()
    assert len(set(h.tolist())) == len(set(text.split()))
    at, to, h = common.words_of(text, b"ay\xe9")
    bare = [w.strip(b"ay\xe9") for w in text.split()]
    assert [text[a:b] for a, b in zip(at, to)] == bare and len(set(h.tolist())) == len(set(bare))
    assert (np.diff(at) >= 0).all()


def shingle_set(t, n):
    w = (t or "").encode().lower().split() if (t or "").isascii() else neardup.ascii_lower((t or "").encode()).split()
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def brute_components(rows, n, percent=80):
    ids = [-(2**63) if i is None else i for i, _ in rows]
    s = [shingle_set(t, n) for _, t in rows]
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(s[a] & s[b])
            if both and 100 * both >= percent * (len(s[a]) + len(s[b]) - both):
                x, y = sorted((find(ids[a]), find(ids[b])))
                parent[y] = x
    none = lambda x: None if x == -(2**63) else x
    return [(i, len(s[k]), none(find(ids[k])), find(ids[k]) == ids[k]) for k, (i, _) in enumerate(rows)]


def order(r):
    return tuple((x is None, x or 0) for x in r)


@pytest.mark.parametrize("n", [4, 5])
def test_components(odd, odd_rows, empty, n):
    got = neardup.components(odd, shingle=n).collect()
    assert sorted(map(tuple, got), key=order) == sorted(brute_components(odd_rows, n), key=order)
    assert neardup.components(empty, shingle=n).count() == 0


def family(r, size, length, change):
    """A drifting family: each text edits an earlier one."""
    texts = [[f"v{r.randint(0, 10**6)}" for _ in range(length)]]
    for _ in range(size - 1):
        t = list(r.choice(texts))
        for _ in range(change):
            t[r.randrange(len(t))] = f"v{r.randint(0, 10**6)}"
        texts.append(t)
    return [" ".join(t) for t in texts]


def test_large_and_small_groups(spark, monkeypatch):
    monkeypatch.setattr(neardup, "HOT", 20)  # the paths of large bands and of clusters of several blocks
    monkeypatch.setattr(neardup, "BLOCK", 16)
    monkeypatch.setattr(neardup, "MEMBERS", 24)
    r = random.Random(3)
    texts = [t for size, length, change in ((90, 60, 2), (6, 5, 1), (40, 30, 1), (3, 400, 10), (25, 12, 1)) for t in family(r, size, length, change)] + ["copy of a text"] * 30
    r.shuffle(texts)
    rows = [(k * 2 + 1, t) for k, t in enumerate(texts)]
    got = neardup.components(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), shingle=4).collect()
    assert sorted(map(tuple, got)) == sorted(brute_components(rows, 4))


def test_a_loose_cluster_takes_several_rounds(spark, monkeypatch):
    """Families of a few documents each around shared text under the threshold: one cluster, many components."""
    monkeypatch.setattr(neardup, "HOT", 3)
    monkeypatch.setattr(neardup, "BLOCK", 4)
    monkeypatch.setattr(neardup, "MEMBERS", 8)
    taken = []
    rounds = neardup._against_pivots
    monkeypatch.setattr(neardup, "_against_pivots", lambda percent: taken.append(1) or rounds(percent))
    r = random.Random(11)
    common = [f"c{i}" for i in range(60)]
    texts = []
    for _ in range(14):
        own = common + [f"v{r.randint(0, 10**6)}" for _ in range(25)]
        texts += [" ".join(own), " ".join(own[:-1]), " ".join(own[:-2])][: r.randint(1, 3)]
    rows = list(enumerate(texts))
    got = neardup.components(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), shingle=4).collect()
    assert sorted(map(tuple, got)) == sorted(brute_components(rows, 4))
    assert 1 < len(taken) < 6


def test_shared_ids_are_linked(spark):
    """Rows that share a doc_id, or have none, are one document, also over the documents that their texts are near to."""
    r = random.Random(9)
    text = lambda: " ".join(f"t{r.randint(0, 10**6)}" for _ in range(30))
    a, b, c, d = text(), text(), text(), text()
    rows = [(5, a), (5, b), (3, a + " end"), (9, b), (9, c), (12, c), (20, d), (20, d), (21, text()), (21, text())]
    rows += [(None, text()) for _ in range(40)] + [(None, a[:-1] + "x")] * 30
    got = neardup.components(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), shingle=4).collect()
    assert sorted(map(tuple, got), key=order) == sorted(brute_components(rows, 4), key=order)


@pytest.mark.parametrize("doc_id", [None, 7])
def test_one_row_very_often(spark, doc_id, monkeypatch):
    """One row 20,000 times, beside a near copy: its texts meet as one."""
    met = []
    verified = neardup._verified
    monkeypatch.setattr(neardup, "_verified", lambda *a: met.append(a) or verified(*a))
    base = " ".join(f"u{k}" for k in range(40))
    many = spark.range(20_000).selectExpr(f"cast({'null' if doc_id is None else doc_id} as long) as doc_id", f"'{base}' as text")
    near = spark.createDataFrame([(1, base + " more")], "doc_id long, text string")
    got = neardup.components(many.unionByName(near), shingle=4)
    low = 1 if doc_id else None
    assert got.count() == 20_001 and got.filter(f"not (component_id <=> {low if low else 'null'})").count() == 0 and len(met) == 1
    out = repeats.remove_repeats(many.unionByName(near))
    left = out.filter("n_removed < n_words")
    assert out.count() == 20_001 and out.agg({"n_removed": "sum"}).first()[0] == 20_000 * 40 and left.count() == (2 if doc_id is None else 1)


def test_repeated_rows_leave_one(spark):
    base = "one two three four five six seven"
    rows = [(1, base, 0), (1, base, 0), (2, "eight nine ten eleven twelve", 1), (3, "", 2), (3, "", 2), (4, base, 3), (None, "some other words of a null id", 4), (None, "some other words of a null id", 4), (5, "a", 5), (5, None, 5)]
    got = neardup.deduplicated(spark.createDataFrame(rows, "doc_id long, text string, times int")).collect()
    assert sorted(((r["doc_id"], r["text"]) for r in got), key=str) == sorted({(i, t) for i, t, _ in rows if i != 4}, key=str)


def test_deduplicated_keeps_columns_and_first(spark):
    rows = [(1, "a b c d e f", "x"), (2, "a b c d e f", "y"), (3, "other text of six words here", "z"), (4, None, "w")]
    got = neardup.deduplicated(spark.createDataFrame(rows, "doc_id long, text string, kept_id string"))
    assert got.columns == ["doc_id", "text", "kept_id"] and sorted(r["doc_id"] for r in got.collect()) == [1, 3, 4]


@settings(max_examples=40, deadline=None)
@given(st.integers(5, 400), st.integers(0, 100), st.integers(0, 2**32))
def test_estimate_follows_similarity(n, percent, seed):
    rng = np.random.default_rng(seed)
    both = rng.integers(0, 2**63, n, dtype=np.uint64)
    k = n * percent // 100
    a, b = np.unique(both), np.unique(np.concatenate([both[k:], rng.integers(0, 2**63, k, dtype=np.uint64)]))
    true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    got = neardup.estimates(neardup.registers(a), neardup.registers(b)[None])[0]
    assert abs(got - true) < 0.3 and (true < 1 or got == 1)


def test_small_sets_are_verified_whatever_the_estimate(spark):
    """Near copies of few words that share a band, though their registers agree too seldom."""
    rows = []
    for i in range(40_000):
        words = [f"w{i}x{j}" for j in range(5)]
        a, b = (neardup.registers(neardup.shingles(" ".join(w), 1)) for w in (words[:4], words))
        if (a == b).mean() < 0.64 and (a == b).reshape(neardup.BANDS, -1).all(axis=1).any():
            rows += [(2 * i, " ".join(words[:4])), (2 * i + 1, " ".join(words))]
            if len(rows) == 6:
                break
    assert len(rows) == 6
    got = neardup.components(spark.createDataFrame(rows, "doc_id long, text string"), shingle=1).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == {i: i - i % 2 for i, _ in rows}


def test_registers_hold_zeros_and_mantissa():
    low = np.uint64(0b1011 << 20)
    reg = int(neardup.registers(np.array([low], np.uint64))[0])
    assert reg >> neardup.MANTISSA == 57 - 24 and reg & 1023 == 0b0110000000


@pytest.mark.parametrize("edges", [[(i, i + 1) for i in range(1000)], [(i, i + 1) for i in range(1000, 0, -1)] + [(5000, i) for i in range(5001, 5400)]])
def test_long_paths_take_few_rounds(spark, edges, monkeypatch):
    """A path in the order of its ids, and a star beside it."""
    monkeypatch.setattr(graph, "FINISH", 0)
    rounds = []
    keep = graph.saved
    monkeypatch.setattr(graph, "saved", lambda df, what: rounds.append(what) or keep(df, what))
    got = {x["node"]: x["component"] for x in graph.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    low = min(min(e) for e in edges)
    assert got == {x: 5000 if x >= 5000 else low for e in edges for x in e}
    assert rounds.count("cc-moves") < 15


@pytest.mark.parametrize("finish", [0, 30, 1 << 18])
def test_connected_components(spark, finish, monkeypatch):
    """By rounds alone, by rounds and a last task, and by that alone."""
    monkeypatch.setattr(graph, "FINISH", finish)
    r = random.Random(5)
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 130)] + [(r.randint(200, 300), r.randint(200, 300)) for _ in range(60)] + [(7, 7)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    got = {x["node"]: x["component"] for x in graph.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for a, b in edges if a != b for x in (a, b)}
