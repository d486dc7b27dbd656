"""Mixing sources to target weights with soft domain membership.

Domains are the classes of a labelled table.  A softmax classifier over hashed words, fitted on
a bounded sample of labelled documents (SAMPLE rows, those with the smallest hash of doc_id),
gives each document a posterior over domains.  A document's nonnegative rate is how often it
should be drawn; the expected tokens of domain d are the sum of rate * tokens * posterior[d].
Rates come from projected-gradient least squares on the domain totals, from rate 1 on, so that
among the best fits they stay near 1.  Steps are implicit (the gradient is that of the point
reached, found by Newton's method on its D numbers), so a domain with few tokens does not slow
them.  They end when a duality gap shows the totals to be within TOLERANCE of the least-squares
ones; there is no limit on their number.  What nonnegative rates cannot reach is in `missed`.
The size of the mix (the sum of the targets) is a parameter.  Unless it is given, it grows, by
`growth` at most, until the documents most likely of the first domain keep rate 1 or more (but for
1 - `kept` of their tokens); targets and rates grow alike, so totals match targets at any size.
What growth that needs, what was taken, and the largest rate of any document are in the result;
where it needs more than `growth`, some of these documents are drawn less than once, and a warning says so.

Distribution.  With tokens as the metric, a rate's path depends on the posterior alone.
Posteriors are rounded to 1/GRID, so documents fall into a bounded number of cells of the
simplex, CELLS at most however many documents there are; more domains get a coarser grid (500
units for three, 89 for four).  The cells' tokens are a
distributed sum; they, and once the sample's features, are all that meets at the driver.  A rate
is replayed from the D-vectors of all steps wherever it is needed; nothing is iterated over
documents.  The classifier is fitted at the driver on SAMPLE documents of 8 KB at most.

Defined results: tokens are words unless a column is named; a null or empty text has no tokens,
the classifier's prior as posterior, and a rate like any other; repeated rows get equal rates;
labels without a document, and null labels, are not used; labelled documents that share a doc_id
count once (the one with the largest features), as the less clean of their labels; without labelled documents every
posterior is uniform; without these, or without tokens, all rates are 1, and targets, reached
and `missed` null; very long texts count with all their tokens and words; an empty table
gives an empty one; columns other than doc_id, text and the one named for tokens are not looked
at, whatever their names (resampled keeps them).
"""

from __future__ import annotations

import logging
import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from medialoom.llm.bpe import chunks
from medialoom.llm.common import ascii_lower, documents_of, saved, spread, words_of

DOMAINS = ("clean", "poor", "toxic")
#: Shares of tokens in the mix.
WEIGHTS = {"clean": 0.94, "poor": 0.05, "toxic": 0.01}
SAMPLE, FEATURES = 6000, 1 << 16
#: Cells of the simplex that the driver takes: 4 MB.
CELLS = 125_751


def grid(d: int) -> int:
    """Into how many units a posterior of d domains is rounded: 500 at most, and no more than make CELLS cells."""
    return max(g for g in range(1, 501) if g == 1 or math.comb(g + d - 1, d - 1) <= CELLS)


GRID = grid(len(DOMAINS))
#: Of the sum of the targets.
TOLERANCE = 1e-4
#: The part of the first domain's tokens that keeps rate 1 or more, if the mix need not grow by more than GROWTH for it.
KEPT, GROWTH = 0.95, 2.0
#: Squared deviations at which a word counts half: below, its part in a domain can be chance.
NOISE = 64.0


def domain_of(labels: DataFrame) -> DataFrame:
    """doc_id and domain number of each labelled document."""
    domain = F.when(F.col("toxic") == 1, 2).when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 0)
    return labels.select(F.col("doc_id").cast("long").alias("doc_id"), domain.alias("domain")).filter("doc_id IS NOT NULL AND domain IS NOT NULL")


# ---------------------------------------------------------------- the classifier

_OUTER = b".,;:!?\"'()#*$%&|<>"


def features(text: str | None) -> tuple[np.ndarray, int]:
    """Distinct hashed words of a text (ASCII lower case, outer punctuation off), and its word count."""
    return next(feature_sets([text]))


def feature_sets(texts: list[str | None]) -> Iterator[tuple[np.ndarray, int]]:
    """The features of each text; the words of many texts are found and hashed together."""
    for lo, hi in chunks(texts):
        raw = [x.encode() if x else b"" for x in texts[lo:hi]]
        at, _, h = words_of(ascii_lower(b"\n".join(raw) + b"\n"), _OUTER)
        f = (h >> np.uint64(48)).astype(np.uint16)
        # A word of outer characters alone is empty, but lies where it did.
        starts = np.searchsorted(at, np.concatenate([[0], np.cumsum([len(x) + 1 for x in raw])])).tolist()
        for x, y in zip(starts, starts[1:]):
            yield np.unique(f[x:y]).astype(np.int64), y - x


def packed(f: np.ndarray) -> bytes:
    """Features as two bytes each, or as a bitmap where that is shorter: 8 KB at most, however long the text."""
    if len(f) < FEATURES // 16:
        return f.astype("<u2").tobytes()
    bits = np.zeros(FEATURES, bool)
    bits[f] = True
    return np.packbits(bits).tobytes()


def unpacked(b: bytes) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(np.frombuffer(b, np.uint8))) if len(b) == FEATURES // 8 else np.frombuffer(b, "<u2").astype(np.int64)


@dataclass
class Classifier:
    """Softmax over the weights of a document's distinct words, each as strong as it tells domains apart; a document's strengths have length 1 at most."""

    weights: np.ndarray = field(default_factory=lambda: np.zeros((FEATURES, len(DOMAINS)), np.float32))  # times strength
    strength: np.ndarray = field(default_factory=lambda: np.zeros(FEATURES, np.float32))
    bias: np.ndarray = field(default_factory=lambda: np.zeros(len(DOMAINS)))
    learned: bool = False  # from any labelled document

    def posterior(self, f: np.ndarray) -> np.ndarray:
        return self.posteriors([f])[0]

    def posteriors(self, sets: list[np.ndarray]) -> np.ndarray:
        """A row for each set of features."""
        n, flat = len(sets), np.concatenate([np.empty(0, np.int64), *sets])
        owner = np.repeat(np.arange(n), [len(f) for f in sets])
        scale = np.sqrt(np.maximum(1.0, np.bincount(owner, np.square(self.strength[flat].astype(np.float64)), n)))
        z = self.bias + np.stack([np.bincount(owner, self.weights[flat, d], n) for d in range(len(DOMAINS))], axis=1) / scale[:, None]
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)


def on_grid(p: np.ndarray) -> np.ndarray:
    """Posteriors in whole units of 1/GRID that sum to GRID: rounded down, what is left to the largest remainders."""
    whole = np.floor(p * GRID).astype(np.int32)
    rank = np.argsort(np.argsort(whole - p * GRID, axis=1, kind="stable"), axis=1, kind="stable")
    return whole + (rank < (GRID - whole.sum(axis=1))[:, None])


def strengths(counts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """z^2 / (z^2 + NOISE) of each word, and 0 below z = 2: z is by how many standard deviations the number of a domain's documents that hold it differs most from chance. counts: words x domains."""
    q, total = sizes / sizes.sum(), counts.sum(axis=1, keepdims=True)
    rest = 1 - np.minimum(total / sizes.sum(), 1 - 1 / sizes.sum())
    z2 = (np.square(counts - total * q) / np.maximum(total * q * (1 - q) * rest, 1e-9)).max(axis=1)
    return np.where(z2 < 4, 0.0, z2 / (z2 + NOISE))


def fit(rows: list[tuple[bytes, int]], steps: int = 300, rate: float = 0.05, at_once: int = 4_000_000) -> Classifier:
    """Adam on the sample's cross entropy; rows are (packed features, domain), unpacked `at_once` features at a time. The words' strengths keep it from learning chance; weights have no decay, so the posteriors of what the words do tell apart are sharp, and little of a rare domain's share goes to documents that are not of it."""
    c, k = Classifier(), len(DOMAINS)
    lengths = np.array([len(unpacked(b)) for b, _ in rows], np.int64)
    rows, lengths = [r for r, n in zip(rows, lengths) if n], lengths[lengths > 0]
    if not rows:
        return c
    domain = np.array([d for _, d in rows])
    parts = [np.flatnonzero(np.cumsum(lengths) // at_once == i) for i in range(int(lengths.sum() // at_once) + 1)]
    parts = [x for x in parts if len(x)]

    def laid(part, keep=None):
        flat, owner = np.concatenate([unpacked(rows[i][0]) for i in part]), np.repeat(np.arange(len(part)), lengths[part])
        return (flat, owner) if keep is None else (flat[keep[flat]], owner[keep[flat]])

    def each(keep=None):
        return zip(parts, whole) if whole else ((x, laid(x, keep)) for x in parts)

    counts, scale, whole = np.zeros((FEATURES, k)), np.zeros(len(rows)), None
    for part, (flat, owner) in each():
        counts += np.bincount(flat * k + domain[part][owner], minlength=FEATURES * k).reshape(FEATURES, k)
    c.strength = strengths(counts, np.bincount(domain, minlength=k).astype(float)).astype(np.float32)
    telling = c.strength > 0
    whole = [laid(parts[0], telling)] if len(parts) == 1 else None
    for part, (flat, owner) in each(telling):
        scale[part] = 1 / np.maximum(1.0, np.sqrt(np.bincount(owner, np.square(c.strength[flat].astype(float)), len(part))))
    used = np.flatnonzero(telling)
    at = np.zeros(FEATURES, np.int64)
    at[used] = np.arange(len(used))
    s, y = c.strength[used].astype(float)[:, None], np.eye(k)[domain]
    w, b = np.zeros((len(used), k)), np.log(y.mean(axis=0) + 1e-3)
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), np.zeros_like(b), np.zeros_like(b)
    for t in range(1, steps + 1):
        gw, gb, ws = np.zeros_like(w), np.zeros(k), w * s
        for part, (flat, owner) in each(telling):
            local, own = at[flat], scale[part][:, None]
            z = b + np.stack([np.bincount(owner, ws[local, d], len(part)) for d in range(k)], axis=1) * own
            p = np.exp(z - z.max(axis=1, keepdims=True))
            g = (p / p.sum(axis=1, keepdims=True) - y[part]) / len(rows)
            gb += g.sum(axis=0)
            g *= own
            gw += s * np.stack([np.bincount(local, g[owner, d], len(used)) for d in range(k)], axis=1)
        for x, dx, mx, vx in ((w, gw, m, v), (b, gb, mb, vb)):
            mx += 0.1 * (dx - mx)
            vx += 0.001 * (dx * dx - vx)
            x -= rate * (mx / (1 - 0.9**t)) / (np.sqrt(vx / (1 - 0.999**t)) + 1e-8)
    c.weights[used], c.bias, c.learned = w * s, b, True
    return c


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Classifier:
    """Fits on at most `sample` labelled documents, 8 KB each at most; of rows that share a doc_id, one."""
    chosen = domain_of(labels).groupBy("doc_id").agg(F.max("domain").alias("domain")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([packed(f) for f, _ in feature_sets(batch.column(1).to_pylist())], pa.binary()), batch.column(2)], ["doc_id", "f", "domain"])

    joined = docs.join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "domain")  # `sample` rows of two numbers at most
    one = joined.mapInArrow(run, "doc_id long, f binary, domain int").groupBy("doc_id").agg(F.max(F.struct("f", "domain")).alias("r")).select("r.*")
    return fit(sorted((r["f"], r["domain"]) for r in one.collect()))


def posteriors(docs: DataFrame, classifier: Classifier, tokens: str | None = None) -> DataFrame:
    """doc_id, n_tokens, and p: the posterior in units of 1/GRID (they sum to GRID)."""
    shared = docs.sparkSession.sparkContext.broadcast((classifier.weights, classifier.strength, classifier.bias))  # FEATURES x domains numbers

    def run(batches):
        c = Classifier(*shared.value)
        for batch in batches:
            texts, ps, ns = batch.column(1).to_pylist(), [np.empty((0, len(DOMAINS)), np.int32)], []
            for lo, hi in chunks(texts):
                found = list(feature_sets(texts[lo:hi]))
                ps.append(on_grid(c.posteriors([f for f, _ in found])))
                ns += [n for _, n in found]
            p = np.concatenate(ps)
            grid = pa.ListArray.from_arrays(pa.array(np.arange(len(p) + 1) * len(DOMAINS), pa.int32()), pa.array(p.ravel().astype(np.int32)))
            n_tokens = pa.array(ns, pa.int64()) if tokens is None else batch.column(2).cast(pa.int64()).fill_null(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), n_tokens, grid], ["doc_id", "n_tokens", "p"])

    return docs.mapInArrow(run, "doc_id long, n_tokens long, p array<int>")


# ---------------------------------------------------------------- the fit

@dataclass
class Path:
    """The steps so far: for each, how much a rate falls by unit of posterior."""

    moves: list[list[float]] = field(default_factory=list)

    def replay(self, p: np.ndarray) -> tuple[np.ndarray]:
        """The rates of posteriors p (rows)."""
        r = np.ones(len(p))
        for move in self.moves:
            r = np.maximum(0.0, r - p @ np.array(move))
        return (r,)


def _held(cells: DataFrame, d: int) -> tuple[np.ndarray, np.ndarray]:
    """The posteriors and tokens of all cells: one row a point of the grid, whatever the number of documents."""
    table = cells.filter("n_tokens > 0").select("p", "n_tokens").toArrow().combine_chunks()
    return np.asarray(table.column(0).combine_chunks().flatten()).reshape(-1, d) / GRID, np.asarray(table.column(1)).astype(float)


def fitted(cells: DataFrame, targets: np.ndarray, total: float) -> tuple[Path, np.ndarray]:
    """Projected-gradient least squares over cells (p, n_tokens); the domain totals reached with it."""
    unit = float(targets.sum())
    p, w = _held(cells, len(targets))
    w, t = w / unit, targets / unit
    path, r, damp, least = Path(), np.ones(len(p)), 1e-6, np.inf
    while True:
        error = p.T @ (w * r) - t
        gap = _gap(p, error, t)
        if gap <= TOLERANCE**2 / 2:
            break
        if damp <= 1e-12 and gap >= least:  # floating point gives no more; `missed` tells
            logging.getLogger(__name__).warning("mixing: the fit stands at a gap of %.3g", gap)
            break
        least = min(gap, least)
        path.moves.append(_step(p, w, t, r, damp).tolist())
        r = np.maximum(0.0, r - p @ np.array(path.moves[-1]))
        damp = max(damp / 10, 1e-12)
    return path, (error + t) * unit


def _gap(p: np.ndarray, error: np.ndarray, t: np.ndarray) -> float:
    """Bounds how far half the squared error is above the least one: r >= 0 has none under (v t)^2 / 2 v^2 where p v >= 0 for all cells and v t < 0."""
    v = error + max(0.0, -float((p @ error).min()))  # posteriors sum to 1
    under = float(v @ t) ** 2 / (2 * float(v @ v)) if v @ t < 0 else 0.0
    return float(error @ error) / 2 - under


def _step(p: np.ndarray, w: np.ndarray, t: np.ndarray, r: np.ndarray, damp: float) -> np.ndarray:
    """The m for which damp * m is the error of the rates max(0, r - p m): the minimum of a convex, piecewise quadratic function."""

    def value(m):
        return damp / 2 * m @ m + t @ m + (w * np.square(np.maximum(0.0, r - p @ m))).sum() / 2

    m = np.zeros(len(t))
    now = value(m)
    while True:
        left = r - p @ m
        on = left > 0
        slope = damp * m + t - p[on].T @ (w[on] * left[on])
        way = np.linalg.solve(damp * np.eye(len(t)) + (p[on].T * w[on]) @ p[on], -slope)
        size = 1.0
        while size > 1e-9 and value(m + size * way) > now + 1e-4 * size * (slope @ way):
            size /= 2
        new = value(m + size * way)
        if not new < now:  # the minimum, as far as floating point tells
            return m
        m, now = m + size * way, new


def _wanted(p: np.ndarray, n: np.ndarray, rate: np.ndarray, kept: float) -> float:
    """By how much the mix must grow for documents that are most likely of the first domain to have rate 1 or more, but for 1 - kept of their tokens; infinite if it cannot."""
    first = np.flatnonzero(p.argmax(axis=1) == 0)
    if not len(first):
        return 1.0
    order = first[np.argsort(rate[first])]
    low = rate[order][np.searchsorted(np.cumsum(n[order]), (1 - kept) * n[order].sum(), "right")]
    return max(1.0, 1 / float(low)) if low > 0 else math.inf


def mixed(docs: DataFrame, labels: DataFrame, weights: dict[str, float] | None = None, tokens: str | None = None, size: float | None = None, kept: float = KEPT, growth: float = GROWTH) -> DataFrame:
    """doc_id, n_tokens, p (posterior of DOMAINS), rate, copies (the rate rounded up or down by a hash of doc_id), and, the same on all rows: targets and reached (the domains' expected token totals, wanted and with these rates), missed (by how much the domain farthest from its share of the tokens misses it), growth_wanted and growth_taken (see _wanted; wanted is null where a size is given) and largest_rate (of any document with tokens).

    size: the expected tokens of the mix. If not given, the first domain keeps its expected tokens, and the mix grows from there until its documents stay, `growth`-fold at most.
    """
    docs = documents_of(docs, *([tokens] if tokens else []))
    weights = weights or WEIGHTS
    shares = np.array([weights.get(x, 0.0) for x in DOMAINS])
    classifier = train(docs.select("doc_id", "text"), labels)
    known = saved(posteriors(spread(docs), classifier, tokens), "posteriors")
    cells = saved(known.filter("n_tokens > 0").groupBy("p").agg(F.sum("n_tokens").alias("n_tokens")), "cells")
    p, n = _held(cells, len(DOMAINS))
    path, grow, wanted, largest, missed, targets, reached = Path(), 1.0, None, 1.0, None, None, None
    if len(n) and classifier.learned:
        have, want = n @ p, shares / shares.sum()
        natural = have[0] / want[0] if have[0] > 0 and want[0] > 0 else n.sum()
        path, reached = fitted(cells, want * natural, float(n.sum()))
        # Targets, first rates and so all rates grow alike.
        rates = path.replay(p)[0]
        wanted = None if size is not None else _wanted(p, n, rates, kept)
        grow = size / natural if wanted is None else min(wanted, growth)
        largest = grow * float(rates.max())
        if wanted is not None and wanted > growth:
            logging.getLogger(__name__).warning("mixing: the mix would have to grow %.4g-fold for documents of %s to stay, and grows %.4g-fold: some are drawn less than once", wanted, DOMAINS[0], growth)
        targets, reached = want * natural * grow, reached * grow
        got = reached / reached.sum() if reached.sum() > 0 else reached
        missed = round(float(np.abs(got - want).max()), 9)
        if missed > 2 * TOLERANCE:
            logging.getLogger(__name__).warning("mixing: shares of tokens %s reached, %s wanted", dict(zip(DOMAINS, got.round(5).tolist())), dict(zip(DOMAINS, want.tolist())))

    def run(batches):
        for batch in batches:
            p = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(DOMAINS)) / GRID
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(p.tolist(), pa.list_(pa.float64())), pa.array((grow * path.replay(p)[0]).round(9))], ["doc_id", "n_tokens", "p", "rate"])

    rated = known.mapInArrow(run, "doc_id long, n_tokens long, p array<double>, rate double")
    told = {k: (F.lit(None) if x is None else F.array(*[F.lit(float(y)) for y in x])).cast("array<double>") for k, x in (("targets", targets), ("reached", reached))}
    one = {"missed": missed, "growth_wanted": wanted, "growth_taken": grow, "largest_rate": largest}
    return rated.withColumns({"copies": copies(F.col("rate"), F.col("doc_id"))} | told | {k: F.lit(x).cast("double") for k, x in one.items()})


def copies(rate: Column, doc_id: Column) -> Column:
    """A whole number whose expectation over documents is the rate."""
    u = F.pmod(F.xxhash64(F.coalesce(doc_id, F.lit(-1)), F.lit("mix")), F.lit(1 << 20)) / F.lit(float(1 << 20))
    return F.floor(rate + u).cast("int")


def resampled(docs: DataFrame, labels: DataFrame, weights: dict[str, float] | None = None, **how) -> DataFrame:
    """The documents, each as often as `copies` says, with their own columns. how: as in `mixed`."""
    n = saved(mixed(docs, labels, weights, **how).filter("copies > 0").groupBy("doc_id").agg(F.max("copies").alias("copies")), "copies")
    own = [f"c{i}" for i in range(len(docs.columns))]  # the documents' columns can be called anything
    named = docs.toDF(*own)
    joined = named.join(n.hint("merge"), named[own[docs.columns.index("doc_id")]].eqNullSafe(n["doc_id"]))
    return joined.select(*own, F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("again")).select(*own).toDF(*docs.columns)
