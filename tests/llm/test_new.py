"""Sharding, conversation repair and importance resampling against brute force."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from medialoom.llm import dialogue, oracles, queries, resample, shards

DIR = "/root/testdata/sf0.001"

# ---------------------------------------------------------------- sharding

def check_shards(rows, docs, k):
    assert sorted((r["doc_id"], r["size"], r["text_crc32"]) for r in rows if r["doc_id"] is not None) == sorted((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in docs if i is not None)
    assert len(rows) == len(docs) and all(r["law"] == "rows" and r["grown_shard"] is None for r in rows)
    sizes = Counter(r["shard"] for r in rows)
    assert [sizes[j] for j in range(k)] == [len(docs) // k + (j < len(docs) % k) for j in range(k)]
    for j in range(k):
        assert sorted(r["slot"] for r in rows if r["shard"] == j) == list(range(sizes[j]))


def test_shards_of_odd_rows(odd, odd_rows):
    docs = [(i, t) for i, t in odd_rows]
    rows = shards.report(odd, 8).collect()
    check_shards(rows, docs, 8)
    assert sorted(map(repr, rows)) == sorted(map(repr, shards.report(odd, 8).collect()))  # the seed decides
    assert shards.shuffled(odd, 3).select("doc.*").columns == odd.columns
    check_shards(shards.report(odd.filter("doc_id <= 3"), 8).collect(), docs[:3], 8)


def test_shards_of_nothing(empty, spark):
    assert shards.report(empty, 8).collect() == []


def test_shards_of_a_table(spark):
    rows = queries.op11_uniform_shards(spark, DIR).collect()
    docs = [tuple(r) for r in spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text").collect()]
    check_shards(rows, docs, 8)


def test_shards_move_rows_once(spark):
    """One exchange, and no task that orders more than a cell."""
    plan = shards.shuffled(spark.range(1000).withColumn("text", F.lit("x")), 8)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


def test_shards_written(spark, tmp_path):
    shards.write_shards(spark.range(100).toDF("shard"), f"{tmp_path}/out", 4)
    back = spark.read.parquet(f"{tmp_path}/out")
    assert sorted(r["doc"]["shard"] for r in back.collect()) == list(range(100)) and {r["shard"]: r["n"] for r in back.groupBy("shard").agg(F.count("*").alias("n")).collect()} == dict.fromkeys(range(4), 25)


def test_matrix_margins_and_law():
    counts = np.array([3, 0, 2, 1])
    seen = Counter()
    for seed in range(20_000):
        m = shards.communication_matrix(counts, 2, np.random.default_rng(seed))
        assert m.sum(axis=1).tolist() == counts.tolist() and m.sum(axis=0).tolist() == [3, 3] and m.min() >= 0
        seen[tuple(m[:, 0])] += 1
    law = {(a, 0, b, c): math.comb(3, a) * math.comb(2, b) * math.comb(1, c) / math.comb(6, 3) for a in range(4) for b in range(3) for c in range(2) if a + b + c == 3}
    assert set(seen) == set(law)
    chi2 = sum((seen[x] - 20_000 * p) ** 2 / (20_000 * p) for x, p in law.items())
    assert chi2 < 25, chi2  # 5 degrees of freedom: p < 1e-4


def test_matrix_of_very_many_rows():
    counts = np.full(1000, 10**9)
    m = shards.communication_matrix(counts, 8, np.random.default_rng(1))
    assert (m.sum(axis=1) == counts).all() and (m.sum(axis=0) == 125 * 10**9).all()


# ---------------------------------------------------------------- conversations

def brute_repair(turns):
    """cost, audit and repaired turns of (role, text, fault) by trying all states forward, strings compared whole."""
    state = {"": (0, "", ())}
    step = lambda x, cost, letter, more: (x[0] + cost, x[1] + letter, x[2] + more)

    def better(into, key, x):
        into[key] = min(into.get(key, (10**9, "", ())), x)

    def nxt(key):
        return "u" if key in ("", "s", "a") else "a"

    def inserted(into):
        for _ in range(3):
            for key, x in list(into.items()):
                to = nxt(key)
                better(into, to, step(x, 2, "I", (("user" if to == "u" else "assistant") + ":",)))

    inserted(state)
    for role, text, fault in turns:
        new = {}
        for key, x in state.items():
            better(new, key, step(x, 3, "D", ()))
            if fault in (0, 3):
                extra, to = int(fault == 3), nxt(key)
                if role[:1] == to or (key == "" and role[:1] == "s"):
                    better(new, role[:1], step(x, extra, "K", (f"{role}:{text}",)))
                better(new, to, step(x, 2 + extra, "R", (("user" if to == "u" else "assistant") + f":{text}",)))
        inserted(new)
        state = new
    return min(x for key, x in state.items() if key in ("", "a"))


def brute_conversations(rows, damage):
    convs = {}
    for conv, turn, role, text in rows:
        own = convs.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(key.encode()) % 20 if damage else 9
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        own += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    out = []
    for conv, own in convs.items():
        own.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode(), hashlib.sha256(x[2].encode()).digest()))
        seen, turns = set(), []
        for _, role, text in own:
            ink = re.findall(r"[^\x20\x09-\x0D]", text)
            turns.append((role, text, 1 if not ink else 2 if (role, text) in seen else 3 if ink[-1] not in ".!?" else 0))
            seen.add((role, text))
        at = [t for t, _, _ in own if t is not None]
        cost, audit, lines = brute_repair(turns)
        illegal = sum(x[0][:1] + y[0][:1] not in ("su", "ua", "au") for x, y in itertools.pairwise(turns))
        fault = Counter(f for _, _, f in turns)
        out.append((conv, max(at) - min(at) + 1 - len(set(at)) if at else 0, fault[1], fault[2], fault[3], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=repr), {r[0]: r[7] for r in out}


def random_rows(n, seed):
    r, rows = random.Random(seed), []
    for conv in [None, *range(n)]:
        for turn in range(r.randint(0, 9) if conv != 7 else 300):
            rows.append((conv, r.choice([turn, turn, turn, None, turn + 3]), r.choice(["system", "user", "assistant", "user", "assistant", None, "", "tool", "Sam", "sue"]), r.choice(["a.", "b!", "c", None, "", " \t\n", "d.\n ", "é?", f"{turn}."])))
    return rows


def conversations(spark, rows):
    return spark.createDataFrame([(t, c, x, r, "g", 1) for c, t, r, x in rows], "turn long, conv_id long, text string, role string, gone string, kind int").repartition(3)


@pytest.mark.parametrize("damage", [False, True])
def test_repair(spark, damage, monkeypatch):
    rows = random_rows(150, 5) + [(500, 1, "user", "x" * 300_000 + "."), (500, 2, "assistant", "y." * 100_000)]
    df = dialogue.report(conversations(spark, rows), damage)
    want, _ = brute_conversations(rows, damage)
    assert sorted(map(tuple, df.collect()), key=repr) == want


def test_repair_gives_what_needs_no_repair(spark):
    rows = random_rows(60, 6)
    once = dialogue.repaired(conversations(spark, rows))
    assert once.columns == ["conv_id", "turn", "role", "text"]
    left = dialogue.report(once.filter("text <> ''")).filter("illegal > 0 and conv_id is not null")
    roles = {}
    for r in once.orderBy("conv_id", "turn").collect():
        roles.setdefault(r["conv_id"], []).append(r["role"][0])
    assert all(re.fullmatch("s?(ua)+", "".join(x)) for x in roles.values()) and left.columns[0] == "conv_id"


def test_buckets_and_batches_change_nothing(monkeypatch):
    import pyarrow as pa

    rng = np.random.default_rng(3)
    n = rng.integers(0, 40, 300)
    kind, fault = rng.integers(0, 4, n.sum()).astype(np.int8), rng.choice([0, 0, 0, 1, 2, 3], n.sum()).astype(np.int8)
    want = dialogue.cheapest(kind, fault, n)
    monkeypatch.setattr(dialogue, "CELLS", 50)
    got = dialogue.cheapest(kind, fault, n)
    assert got[0].tolist() == want[0].tolist() and got[1] == want[1]
    monkeypatch.setattr(dialogue, "ROWS", 10)
    conv = np.repeat(np.arange(300), n)
    table = pa.table({"conv_id": conv})
    parts = list(dialogue._whole(table.to_batches(max_chunksize=7)))
    assert pa.concat_tables(parts).equals(table.combine_chunks()) and len(parts) > 20
    ids = [set(p.column(0).to_pylist()) for p in parts]
    assert sum(map(len, ids)) == len(set(conv.tolist()))


def test_repair_of_nothing(spark):
    assert dialogue.report(conversations(spark, []), True).collect() == [] and dialogue.repaired(conversations(spark, [])).collect() == []


def test_repair_of_a_long_conversation():
    n = 300_000
    cost, audits = dialogue.cheapest(np.tile(np.array([2, 2, 3], np.int8), n // 3), np.zeros(n, np.int8), np.array([n]))
    assert cost[0] == 2 * (n // 3) and len(audits[0]) >= n


# ---------------------------------------------------------------- resampling

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute_buckets(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (text or ""))
    w = WORD.findall(low)
    return len(w), [zlib.crc32(" ".join(w[i : i + k]).encode()) % 10000 for k in (1, 2, 3) for i in range(len(w) - k + 1)]


def brute_resample(docs, target, percent=5):
    raw, goal = Counter(), Counter()
    made = [(i, *brute_buckets(t)) for i, t in docs]
    for _, _, b in made:
        raw.update(b)
    for t in target:
        goal.update(brute_buckets(t)[1])
    s_all, t_all = sum(raw.values()), sum(goal.values())
    gain = {b: math.floor(1000 * math.log((goal[b] + 1) * (s_all + 10000) / ((raw[b] + 1) * (t_all + 10000)))) for b in raw}
    rows = []
    for i, n, b in made:
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        w = sum(gain[x] for x in b)
        rows.append([i, len(b), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    fit = sorted((r for r in rows if r[5] >= 20), key=lambda r: (-r[3], r[0] is not None, r[0] or 0, r[1]))
    for k, r in enumerate(fit[: percent * len(fit) // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in rows), key=repr)


@pytest.mark.parametrize("percent, digit", [(5, 12), (40, 3), (100, 12), (0, 12)])
def test_resample_odd_rows(spark, odd, odd_rows, percent, digit, monkeypatch):
    monkeypatch.setattr(resample, "DIGIT", digit)
    target = [None, "the Cat sat on a mat", "extra words at the end " * 3]
    rows = resample.report(odd, spark.createDataFrame([(t, 1) for t in target], "text string, doc_id int"), percent)
    assert sorted(map(tuple, rows.collect()), key=repr) == brute_resample(odd_rows, target, percent)


def test_resample_of_nothing(spark, empty, odd, odd_rows):
    none = empty.select("text")
    assert resample.report(empty, none).collect() == [] and resample.drawn(empty, none).collect() == []
    assert sorted(map(tuple, resample.report(odd, none).collect()), key=repr) == brute_resample(odd_rows, [])


def test_resample_equal_rows(spark):
    """A third of the rows are one row: as many of it as needed are drawn."""
    rows = [(7, "one two three " * 10)] * 100 + [(i, "one two three " * 10 + f"w{i}") for i in range(100, 300)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for percent in (5, 37, 60):
        got = sorted(map(tuple, resample.report(df, df.limit(3), percent).collect()), key=repr)
        assert sorted(r[4] for r in got if r[4] is not None) == list(range(1, 3 * percent + 1))
        assert [r[:4] for r in got] == [r[:4] for r in brute_resample(rows, [r["text"] for r in df.limit(3).collect()], percent)] or len(got) == 300


def test_drawn_documents(odd, odd_rows, spark):
    target = spark.createDataFrame([("the cat sat on a mat",)], "text string")
    got = resample.drawn(odd, target, 40)
    want = [r["doc_id"] for r in resample.report(odd, target, 40).filter("rank is not null").collect()]
    assert got.columns == odd.columns and sorted(map(repr, (r["doc_id"] for r in got.collect()))) == sorted(map(repr, want))


@pytest.mark.parametrize("values", [[5, 3, 3, 3, 9], [-(2**63), 2**63 - 1, 0, -1, 1, 2**62], list(range(200)), [4] * 50])
def test_radix_selection(spark, values):
    df = spark.createDataFrame([(v, k) for k, v in enumerate(values)], "v long, row long")
    order = sorted((v, k) for k, v in enumerate(values))
    for k in {0, 1, 2, len(values) // 2, len(values) - 1, len(values), len(values) + 5}:
        assert sorted(map(tuple, df.filter(resample.up_to(df, ["v", "row"], k)).collect())) == order[:k]


def test_features():
    r = random.Random(1)
    texts = [None, "", "a", "Hello World foo", "x" * 200 + " y " + "é" * 7000 + " zZ9", "- -"] + [" ".join("".join(r.choice("abcé1-Z ") for _ in range(r.randint(0, 9))) for _ in range(50)) for _ in range(50)]
    own, runs = resample.features(texts)
    for i, t in enumerate(texts):
        n, buckets = brute_buckets(t)
        assert own[i] == n and [x for b, cut in runs for x in b[cut[i] : cut[i + 1]].tolist()] == buckets


def test_crc_in_sql():
    for text in (b"", b"a", b"3:17", bytes(range(256))):
        assert duckdb.sql(f"SELECT {oracles._crc(f"'{text.hex().upper()}'")}").fetchall()[0][0] == zlib.crc32(text)


# ---------------------------------------------------------------- rows that repeat

@pytest.mark.parametrize("doc_id", [None, 7])
def test_token_files_of_equal_rows(spark, tmp_path, doc_id):
    """One row 20,000 times: no file holds more than twice the mean, and the corpus reads back whole."""
    from medialoom.llm import dac

    docs = spark.range(20_000).select(F.lit(doc_id).cast("long").alias("doc_id"), F.lit("one two").alias("text")).repartition(4)
    manifest = dac.write_corpus(docs, f"file://{tmp_path}")
    n = [r["n_docs"] for r in manifest.collect()]
    assert sum(n) == 20_000 and len(n) > 1 and max(n) <= 2 * sum(n) / 4
    back = dac.read_corpus(spark, manifest)
    each = back.agg(F.max("n_tokens")).first()[0]
    assert back.agg(F.countDistinct("start"), F.max("start")).first()[:] == (20_000, 19_999 * each)
