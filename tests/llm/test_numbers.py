"""Top-k search, mixing and the pipeline."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from medialoom.llm import mixing, quality, queries, topk

from .conftest import prose
from .test_dedup import brute_components
from .test_rules import brute_pii, brute_quality


def brute_top(rows, k, every):
    ok = [(i, np.array([int(math.floor(256 * x)) for x in v], object)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    width = max((len(v) for _, v in ok), default=0)
    pad = lambda v: np.concatenate([v, np.array([0] * (width - len(v)), object)])
    out = []
    for n, (q, v) in enumerate(ok):
        if q % every == 0:
            best = sorted(((-max(-(2**63), min(2**63 - 1, int(pad(v) @ pad(c)))), i) for m, (i, c) in enumerate(ok) if m != n))[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<float>, score int").repartition(3)


@pytest.mark.parametrize("kind", ["unit", "lengths", "ties", "odd", "few", "huge", "repeated", "repeated huge"])
def test_topk(spark, kind, monkeypatch):
    monkeypatch.setattr(topk, "BUCKET", 16)
    rng = np.random.default_rng(4)
    v = rng.normal(size=(300, 12))
    if kind in ("unit", "ties"):
        v /= np.linalg.norm(v, axis=1, keepdims=True)
    if kind == "lengths":
        v *= rng.lognormal(0, 2, size=(300, 1))
        v[:40] = v[0] + rng.normal(size=(40, 12)) * 0.01 * np.abs(v[0])  # near-parallel: coordinate pruning
    if kind == "ties":
        v[50:150] = v[50]
    rows = [(int(i), x) for i, x in enumerate(v.astype(np.float32).tolist())]
    if kind == "odd":
        rows += [(1000, None), (1010, [1.0, None]), (1020, [float("nan")] * 12), (1030, [float("inf")] * 12), (1040, []), (1050, [0.5, -0.25]), (None, [1.0] * 12)]
    if kind == "few":
        rows = rows[:3]
    if kind.startswith("repeated"):  # ids that come again, with the same vector or another
        rows = [(i // 3, v) for i, v in rows[:60]] + rows[:20] + [(10, rows[0][1])] * 9
    if kind.endswith("huge"):  # products beyond what doubles hold, and two beyond a long
        rows = [(i, [x * 2.0**20 for x in v]) for i, v in rows] + [(2000, [3e38] * 12), (2001, [-3e38] * 12)]
    got = topk.search(frame(spark, rows), F.col("vec_id") % 10 == 0, k=5).collect()
    assert sorted(map(tuple, got)) == brute_top(rows, 5, 10)


def test_topk_empty(spark):
    assert topk.search(frame(spark, []), F.col("vec_id") % 50 == 0).count() == 0


# ---------------------------------------------------------------- mixing

@pytest.fixture(scope="module")
def corpus(spark):
    bad = ["vile", "grim", "foul"]
    docs, labels = [], []
    for i in range(1500):
        kind = (0, 0, 0, 1, 2)[i % 5]
        text = prose(60, i)
        if kind == 1:
            text = " ".join(w + "###junk" for w in text.split())
        if kind == 2:
            text += f" {bad[i % 3]} {bad[(i + 1) % 3]}"
        docs.append((i, text, "c", 1))
        if i < 1200:
            labels.append((i, int(kind != 1), int(kind == 2)))
    labels += [(9999, 1, 0), (None, 1, 0), (5, None, None)]
    return spark.createDataFrame(docs, "doc_id long, text string, copies string, again int"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_mixing(corpus):
    got = mixing.mixed(*corpus).collect()
    assert len(got) == 1500 and all(r["rate"] >= 0 and abs(sum(r["p"]) - 1) < 1e-9 for r in got)
    held_out = [r for r in got if r["doc_id"] >= 1200]
    right = sum(int(np.argmax(r["p"])) == (0, 0, 0, 1, 2)[r["doc_id"] % 5] for r in held_out)
    assert right >= 0.85 * len(held_out)
    n, p, rate = (np.array([r[c] for r in got], float) for c in ("n_tokens", "p", "rate"))
    totals = p.T @ (n * rate)
    shares = np.array([mixing.WEIGHTS[d] for d in mixing.DOMAINS])
    assert np.abs(totals / totals.sum() - shares).max() < 0.01
    clean = [r for r in got if r["doc_id"] % 5 < 3]
    assert sum(r["copies"] > 0 for r in clean) >= 0.95 * len(clean)


def test_mixing_totals_are_the_targets(corpus, spark):
    """The whole query against its rows, one by one: tokens, posteriors, totals, copies."""
    docs, labels = corpus
    small = docs.filter("doc_id % 5 > 0 or doc_id % 2 = 0")
    for size in (None, 30_000.0):
        got = mixing.mixed(small, labels, size=size).collect()
        text = {r["doc_id"]: r["text"] for r in small.collect()}
        domain = {r["doc_id"]: 2 if r["toxic"] else 1 - r["quality"] for r in labels.filter("quality IS NOT NULL AND doc_id < 9999").collect()}
        domain[5] = 0
        fitted = mixing.fit(sorted((mixing.packed(mixing.features(text[i])[0]), d) for i, d in domain.items() if i in text))
        n, p, rate = (np.array([r[c] for r in got], float) for c in ("n_tokens", "p", "rate"))
        assert all(r["n_tokens"] == len(text[r["doc_id"]].split()) for r in got)
        assert all(np.abs(np.array(r["p"]) - fitted.posterior(mixing.features(text[r["doc_id"]])[0])).max() <= 1 / mixing.GRID + 1e-9 for r in got)
        totals, targets = p.T @ (n * rate), np.array(got[0]["targets"])
        assert np.allclose(totals, targets, rtol=0.01) and np.allclose(totals, got[0]["reached"], rtol=1e-6)
        assert np.allclose(targets / targets.sum(), [mixing.WEIGHTS[d] for d in mixing.DOMAINS])
        if size is not None:
            assert abs(totals.sum() - size) < 0.01 * size
        r = np.full(len(n), targets[0] / (n @ p[:, 0]))
        for _ in range(3000):  # plain projected gradient misses the targets no less
            r = np.maximum(0, r - p @ (p.T @ (n * r) - targets) / n.sum())
        assert np.square(totals - targets).sum() <= np.square(p.T @ (n * r) - targets).sum() + (2e-4 * targets.sum()) ** 2
        assert all(x["copies"] in (int(x["rate"]), int(x["rate"]) + 1) for x in got)
        assert abs(sum(x["copies"] for x in got) - rate.sum()) < 4 * len(got) ** 0.5 / 2


def test_fit_in_parts_is_the_same():
    rng = np.random.default_rng(8)
    rows = sorted((mixing.packed(np.unique(rng.integers(0, 900, 60) + 300 * d)), int(d)) for d in rng.integers(0, 3, 90))
    one, many = mixing.fit(rows, steps=15), mixing.fit(rows, steps=15, at_once=500)
    assert np.allclose(one.weights, many.weights, atol=1e-6) and np.allclose(one.bias, many.bias)
    for f in (np.arange(10), np.arange(4095), np.arange(0, 65536, 3), np.arange(65536)):
        b = mixing.packed(f)
        assert len(b) <= 8192 and (mixing.unpacked(b) == f).all()


def test_labelled_documents_count_once(corpus, spark):
    docs, labels = corpus
    again = docs.unionByName(docs.filter("doc_id < 40")).unionByName(docs.filter("doc_id < 40"))
    one, many = mixing.train(docs, labels), mixing.train(again, labels)
    assert np.allclose(one.weights, many.weights) and np.allclose(one.bias, many.bias)
    assert (mixing.train(docs, labels, sample=300).weights != one.weights).any()


def test_projected_gradient_is_least_squares(spark):
    rng = np.random.default_rng(2)
    p = rng.dirichlet([0.3, 0.3, 0.3], 200)
    cells = [([int(x) for x in (a * mixing.GRID).round()], int(n)) for a, n in zip(p, rng.integers(1, 100, 200))]
    q, n = np.array([c[0] for c in cells]) / mixing.GRID, np.array([c[1] for c in cells], float)
    target = n.sum() * np.array([0.5, 0.1, 0.0])
    df = spark.createDataFrame(cells, "p array<int>, n_tokens long")
    path, reached = mixing.fitted(df, target, float(n.sum()))
    rate = path.replay(q)[0]
    r = np.ones(len(n))
    for _ in range(4000):  # plain projected gradient, long enough
        r = np.maximum(0, r - q @ ((q.T @ (n * r) - target) / n.sum()))
    miss = lambda r: np.square((q.T @ (n * r) - target) / n.sum()).sum()
    assert (rate >= 0).all() and miss(rate) <= miss(r) + 1e-4 and np.allclose(reached, q.T @ (n * rate))


@pytest.mark.parametrize("have", [(0.88, 0.0005, 0.1195), (0.989, 0.01, 0.001), (0.001, 0.5, 0.499), (0.98, 1e-6, 0.02)])
def test_rates_reach_what_can_be_reached(spark, have):
    """Domains that hold little of the tokens get their shares all the same."""
    rng = np.random.default_rng(6)
    p = rng.dirichlet([0.1] * 3, 300)
    q = np.round(np.concatenate([p, np.eye(3)]) * mixing.GRID)
    q[:, 0] += mixing.GRID - q.sum(axis=1)
    q = q[(q >= 0).all(axis=1)] / mixing.GRID
    n = np.ones(len(q)) * 1e8
    for k in range(3):
        n[q.argmax(axis=1) == k] *= have[k] / (q.argmax(axis=1) == k).sum()
    n = np.maximum(n.round(), 1)
    df = spark.createDataFrame([([int(round(x * mixing.GRID)) for x in a], int(m)) for a, m in zip(q, n)], "p array<int>, n_tokens long")
    shares = np.array([0.94, 0.05, 0.01])
    path, reached = mixing.fitted(df, shares * (n @ q[:, 0]) / shares[0], float(n.sum()))
    rate = path.replay(q)[0]
    assert (rate >= 0).all() and np.allclose(reached, q.T @ (n * rate), rtol=1e-4)
    assert np.abs(reached / reached.sum() - shares).max() < 3e-4


def test_what_no_rates_reach_is_told(spark, corpus):
    cells = [([450, 50, 0], 100), ([475, 20, 5], 1000), ([400, 80, 20], 50)]
    q, n = np.array([c[0] for c in cells]) / mixing.GRID, np.array([c[1] for c in cells], float)
    want = n.sum() * np.array([0.2, 0.5, 0.3])
    path, reached = mixing.fitted(spark.createDataFrame(cells, "p array<int>, n_tokens long"), want, float(n.sum()))
    one = q[2] * (q[2] @ want) / (q[2] @ q[2])  # the nearest point of the cone is on its outermost ray
    assert np.abs(reached - one).max() < 2e-4 * want.sum() and np.allclose(reached, q.T @ (n * path.replay(q)[0]), rtol=1e-4)
    docs = corpus[0].filter("doc_id % 5 < 3")  # nothing poor or toxic is left to draw
    got = mixing.mixed(docs, corpus[1]).collect()
    p, m = np.array([r["p"] for r in got]), np.array([r["n_tokens"] * r["rate"] for r in got])
    off = np.abs(p.T @ m / m.sum() - np.array([0.94, 0.05, 0.01])).max()
    assert {r["missed"] for r in got} == {got[0]["missed"]} and abs(off - got[0]["missed"]) < 1e-4


def test_mixing_odd_rows(odd, odd_rows, empty, spark, corpus):
    labels = corpus[1]
    got = mixing.mixed(odd, labels).collect()
    assert len(got) == len(odd_rows) and {r["n_tokens"] for r in got if r["doc_id"] in (6, 7, 8)} == {0}
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert all(max(r["p"]) < 0.35 and r["rate"] == 1 and r["targets"] is None for r in mixing.mixed(odd, none).collect())
    assert mixing.mixed(empty, labels).count() == 0


def test_growth_is_told(corpus, caplog):
    free = mixing.mixed(*corpus, growth=1e9).collect()
    r = free[0]
    assert r["growth_wanted"] == r["growth_taken"] and r["largest_rate"] == pytest.approx(max(x["rate"] for x in free if x["n_tokens"]), abs=1e-8)
    if r["growth_wanted"] > 1:
        cut = mixing.mixed(*corpus, growth=1.0).collect()[0]
        assert cut["growth_taken"] == 1 and cut["growth_wanted"] == r["growth_wanted"] and "have to grow" in caplog.text
    sized = mixing.mixed(*corpus, size=1e4).collect()[0]
    assert sized["growth_wanted"] is None and sized["growth_taken"] > 0


def test_wanted_growth():
    p, n = np.array([[0.9, 0.1, 0], [0.8, 0.1, 0.1], [0.1, 0.9, 0]]), np.array([10.0, 90.0, 50.0])
    assert mixing._wanted(p, n, np.array([0.1, 0.5, 0.01]), 0.95) == 10 and mixing._wanted(p, n, np.array([0.1, 0.5, 0.01]), 0.8) == 2
    assert mixing._wanted(p, n, np.array([0.0, 2.0, 0.01]), 1.0) == math.inf and mixing._wanted(p[2:], n[2:], np.array([0.1]), 0.9) == 1


def test_grids_are_bounded():
    assert [mixing.grid(d) for d in (2, 3, 4)] == [500, 500, 89]
    assert all(math.comb(mixing.grid(d) + d - 1, d - 1) <= mixing.CELLS for d in range(2, 60))


def test_resampled_keeps_columns(corpus):
    got = mixing.resampled(*corpus)
    assert got.columns == corpus[0].columns and 0 < got.count() < 1500


# ---------------------------------------------------------------- the pipeline

def test_pipeline(spark, tmp_path):
    rows = [(i, prose(80, i).replace("on", "on the and") + (" mail me at a@b.com" if i == 3 else ""), "en", "s", 1) for i in range(60)]
    rows += [(100, rows[0][1], "en", "s", 1), (101, "short", "en", "s", 1), (102, None, "en", "s", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    ids = {r["doc_id"] for r in got}
    assert not ids & {100, 101, 102} and len(ids) >= 57
    assert all("email" in r["decoded"] for r in got if r["doc_id"] == 3)


def brute_kept(text):
    """The threshold table, word by word."""
    i, n, chars, symbols, dup_lines, repeat, _ = brute_quality(0, text)
    words = (text or "").encode().split()
    lines = sum(bool(x.split()) for x in (text or "").encode().split(b"\n"))
    stops = {w.decode().lower() for w in words} & set(quality.STOP_WORDS)
    capitals = sum("A" <= c <= "Z" for c in text or "")
    m = max(n, 1)
    return n >= 50 and repeat <= 0.5 * m and 2 <= chars / m <= 15 and symbols <= 0.1 * m and len(stops) >= 2 and dup_lines <= 0.6 * max(lines, 1) and capitals <= 0.5 * max(chars, 1)


def test_pipeline_by_brute_force(spark, tmp_path):
    """Every stage again, document by document; the classifier and the rates alone come from the operator."""
    import collections

    import public_tokenizers
    from tokenizers import Tokenizer

    rows = []
    for i in range(120):
        words = prose(70, i % 100).split()  # 100 to 119 repeat 0 to 19
        if i >= 110:
            words[3] = "changed"  # near copies
        text = " ".join(w if k % 9 else "the and" for k, w in enumerate(words))
        text += ["", " mail a.b@example.com now", " from 10.0.0.7:", " pay 4111 1111 1111 1111", " call +1 (509) 555-6973"][i % 5]
        if i % 13 == 5:
            text = text.replace(" ", " ### ")
        if i % 17 == 3:
            text = text.upper()
        if i % 19 == 4:
            text = text[:100]
        rows.append((i, text, "en", "s", len(text)))
    rows += [(200, None, "en", "s", None), (201, "", "en", "s", 0), rows[7]]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    labels = spark.createDataFrame([(i, int(i % 4 > 0), int(i % 11 == 0)) for i in range(90)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")

    left = list({(i, t) for i, t, *_ in rows if brute_kept(t)})
    first = {i: c == i for i, _, c, _ in brute_components(left, 5)}
    left = sorted((i, t) for i, t in left if first[i])
    assert 40 < len(left) < 100

    def hidden(text):
        spans = sorted((int(a), int(b), k) for k, a, b in (x.split(":") for x in brute_pii(text)))
        out, at = "", 0
        for a, b, k in spans:
            assert a >= at
            out, at = out + text[at:a] + f"<{k.upper()}>", b
        return out + text[at:]

    left = [(i, hidden(t)) for i, t in left]
    mix = mixing.mixed(spark.createDataFrame(left, "doc_id long, text string").coalesce(1), labels)
    times = {r["doc_id"]: r["copies"] for r in mix.collect()}
    word = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = collections.Counter()
    for i, t in left:
        e = word.encode(t, add_special_tokens=False).ids
        want[i, len(e), " ".join(map(str, e)), word.decode(e, skip_special_tokens=False)] += times[i]
    got = collections.Counter(map(tuple, corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "n_tokens", "ids", "decoded").collect()))
    assert got == +want and sum(got.values()) > 30


def test_pipeline_of_nothing(spark, tmp_path, empty):
    empty.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_every_operator_is_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.queries()) == list(range(1, 11))
