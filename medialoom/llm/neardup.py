"""Near-duplicate detection with HyperMinHash sketches.

Sketch: a document's distinct shingle hashes are spread over M buckets by their top bits; of
the smallest hash in a bucket, the count of leading zeros and the next MANTISSA bits are kept
(16 bits a register).  Empty buckets borrow the register of the first bucket in a probing
order of their own.  Banding the registers (BANDS bands of ROWS) makes candidates: documents at
similarity 0.8 share no band with probability below 1e-7.  The estimate from equal registers,
corrected for chance collisions, must reach a cut that lies DEVIATIONS binomial standard
deviations under 0.8, which loses fewer than the bands do.  Where a set is so small (up to SMALL
shingles) that borrowed registers depend on few hashes, the estimate is not asked: the pair goes
on if the sets' sizes alone do not rule the similarity out.  What is left is verified on full
shingle sets.

Large groups.  Documents with the same set are one node from the start; rows that share a doc_id
are a node a set, linked in a star.  Candidates of a band
are not emitted as pairs: in bands of up to HOT documents, those whose estimates link them
become a star; larger bands become a star without estimates (a looser grouping loses nothing).
Stars join to clusters, each cluster's sets are brought together in blocks of BLOCK documents,
two blocks to a task, and a task emits a spanning forest of the links it verified; every two
documents of a cluster meet in a task, so no link between components is lost.  Work in a
cluster is quadratic in its blocks (see README for what this means for huge clusters).

Defined results: a null or wordless text has no shingles, is linked with nothing and keeps its
own id; null doc_ids count as the smallest id and come back null; rows that share a doc_id, or
have none, are linked with each other (those with words), however different; repeated rows count once in any comparison; very long texts are
shingled whole; an empty table gives an empty one; columns other than doc_id and text are not
looked at, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from medialoom.llm.bpe import chunks
from medialoom.llm.common import ascii_lower, documents_of, dropped, gram_hashes, saved, spread, words_of
from medialoom.llm.graph import connected_components

M, BANDS, ROWS, MANTISSA = 128, 32, 4, 10
HOT, BLOCK, MEMBERS = 256, 128, 512
SMALL, DEVIATIONS = 128, 6
#: Texts whose words are hashed together.
CHUNK_CHARS = 1_000_000
_NULL_ID = -(2**63)
_REST = 64 - 7  # bits of a hash below the bucket's
_PROBES = np.stack([np.random.default_rng(i).permutation(M) for i in range(M)])


def shingles(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct hashes of the n-word shingles of a text in ASCII lower case; of the whole sequence if it is shorter."""
    return next(shingle_sets([text], n))


def shingle_sets(texts: list[str | None], n: int) -> Iterator[np.ndarray]:
    """The shingles of each text; the words of many texts are found and hashed together."""
    for lo, hi in chunks(texts, CHUNK_CHARS):
        raw = [x.encode() if x else b"" for x in texts[lo:hi]]
        at, _, h = words_of(ascii_lower(b"\n".join(raw) + b"\n"))
        starts = np.searchsorted(at, np.concatenate([[0], np.cumsum([len(x) + 1 for x in raw])])).tolist()
        grams = gram_hashes(h, n)
        for x, y in zip(starts, starts[1:]):
            yield np.unique(grams[x : y - n + 1]) if y - x >= n else gram_hashes(h[x:y], y - x, seed=2 + y - x) if y > x else np.empty(0, np.uint64)


def registers(s: np.ndarray) -> np.ndarray:
    """The HyperMinHash registers of sorted distinct hashes."""
    return sketched([s])[0]


def sketched(sets: list[np.ndarray]) -> np.ndarray:
    """The registers of each of some sets that are not empty: a row of M."""
    s = np.concatenate(sets)
    cell = np.repeat(np.arange(len(sets)) * M, [len(x) for x in sets]) + (s >> np.uint64(_REST)).astype(np.int64)
    first = np.flatnonzero(np.diff(cell, prepend=-1))  # hashes rise, so the first of a bucket is its smallest
    low = s[first] & np.uint64((1 << _REST) - 1)
    length = np.frexp((low >> np.uint64(5)).astype(np.float64))[1] + 5  # bits from the leading one on; below 32, exact bits do not matter
    length = np.where(low < 32, np.frexp(low.astype(np.float64))[1], length)
    zeros = np.minimum(_REST - length, 63)
    mantissa = (low << np.minimum(zeros + 1, 63).astype(np.uint64)) & np.uint64((1 << _REST) - 1)
    reg, filled = np.zeros(len(sets) * M, "<u2"), np.zeros(len(sets) * M, bool)
    reg[cell[first]] = (zeros.astype(np.uint16) << MANTISSA) | (mantissa >> np.uint64(_REST - MANTISSA)).astype(np.uint16)
    filled[cell[first]] = True
    reg, filled = reg.reshape(-1, M), filled.reshape(-1, M)
    short = np.flatnonzero(~filled.all(axis=1))
    for k in range(0, len(short), 256):
        rows = short[k : k + 256]
        lender = _PROBES[np.arange(M), np.argmax(filled[rows][:, _PROBES], axis=2)]
        reg[rows] = np.where(filled[rows], reg[rows], np.take_along_axis(reg[rows], lender, axis=1))
    return reg


def chance(n1: float, n2: float) -> float:
    """How often registers of sets without a common shingle agree."""
    k = np.arange(0, 64)
    p = [np.diff(np.append((1 - 2.0 ** -k) ** max(n / M, 1.0), 1.0)) for n in (n1, n2)]
    return float((p[0] * p[1]).sum() / 2**MANTISSA)


_CHANCE = chance(M, M)  # largest for small sets; it differs by less than 1e-3 from any other


def estimates(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Collision-corrected similarity of one sketch with many, or of many with as many."""
    return ((many == one).mean(axis=1) - _CHANCE) / (1 - _CHANCE)


def sketches(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, n_shingles, digest of the set (16 bytes), registers and text_hash, for each row (doc_id, text, text_hash)."""

    def run(batches):
        for batch in batches:
            texts, sizes, digests, regs = batch.column(1).to_pylist(), [], [], []
            for lo, hi in chunks(texts, CHUNK_CHARS):
                sets = list(shingle_sets(texts[lo:hi], n))
                some = [x for x in sets if len(x)]
                rows = iter(sketched(some) if some else ())
                sizes += map(len, sets)
                digests += [xxhash.xxh3_128_digest(x.tobytes()) if len(x) else None for x in sets]
                regs += [next(rows).tobytes() if len(x) else None for x in sets]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(regs, pa.binary()), batch.column(2)], ["doc_id", "n_shingles", "digest", "regs", "text_hash"])

    return docs.mapInArrow(run, "doc_id long, n_shingles long, digest binary, regs binary, text_hash long")


def _groups(batches, keys: list[str]):
    """Whole groups of equal consecutive keys as tables; a group is never split over two."""
    rest = None
    for batch in batches:
        t = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
        if not t.num_rows:
            continue
        change = np.zeros(t.num_rows, bool)
        for k in keys:
            v = t.column(k).to_numpy()
            change[1:] |= v[1:] != v[:-1]
        last = int(np.flatnonzero(change)[-1]) if change.any() else 0
        if last:
            yield t.slice(0, last), np.concatenate([[0], np.flatnonzero(change)])
        rest = t.slice(last).combine_chunks()
    if rest is not None and rest.num_rows:
        change = np.zeros(rest.num_rows, bool)
        for k in keys:
            v = rest.column(k).to_numpy()
            change[1:] |= v[1:] != v[:-1]
        n = rest.num_rows
        yield rest, np.concatenate([[0], np.flatnonzero(change), [n]])


def _stars(parts: list[list[int]], nodes: np.ndarray):
    """Edges from the smallest node of each part to its others."""
    a, b = [], []
    for part in parts:
        ids = np.unique(nodes[part])
        if len(ids) > 1:
            a += [int(ids[0])] * (len(ids) - 1)
            b += ids[1:].tolist()
    return a, b


def _parts(n: int, linked):
    """Connected parts of 0..n-1; linked(x, rest) gives which of the indexes `rest` x is linked to. Each index is asked once, against what no part has yet."""
    rest, out = np.arange(n), []
    while len(rest):
        part, todo, rest = [int(rest[0])], [int(rest[0])], rest[1:]
        while todo and len(rest):
            hit = linked(todo.pop(), rest)
            found = rest[hit]
            part += found.tolist()
            todo += found.tolist()
            rest = rest[~hit]
        out.append(part)
    return out


_EDGES = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _likely(cut: float, percent: int):
    def passes(n1, regs1, n2, regs2):
        """Which pairs go on to verification; sets of sizes too different cannot be similar."""
        small, large = np.minimum(n1, n2), np.maximum(n1, n2)
        estimate = estimates(regs1, regs2)
        return (100 * small >= percent * large) & ((small <= SMALL) | (estimate >= cut))

    def run(batches):
        for t, cuts in _groups(batches, ["key"]):
            if cuts[-1] != t.num_rows:
                cuts = np.append(cuts, t.num_rows)
            nodes, n = t.column("node").to_numpy(), t.column("n_shingles").to_numpy()
            regs = np.frombuffer(b"".join(t.column("regs").to_pylist()), "<u2").reshape(-1, M)
            size = np.diff(cuts)
            two = cuts[:-1][size == 2]
            ok = passes(n[two], regs[two], n[two + 1], regs[two + 1])
            a, b = nodes[two[ok]].tolist(), nodes[two[ok] + 1].tolist()
            for lo, hi in zip(cuts[:-1][size > 2], cuts[1:][size > 2]):
                own, m = regs[lo:hi], n[lo:hi]
                x, y = _stars(_parts(hi - lo, lambda i, rest: passes(m[i], own[i], m[rest], own[rest])), nodes[lo:hi])
                a += x
                b += y
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=_EDGES)

    return run


def _inverted(sets: list[np.ndarray]):
    """Distinct shingles of the sets, and for each which sets hold it (holders, begin)."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    distinct, token = np.unique(np.concatenate(sets), return_inverse=True)
    order = np.argsort(token, kind="stable")
    return distinct, owner[order], np.searchsorted(token[order], np.arange(len(distinct) + 1))


def _common(tokens: np.ndarray, holders: np.ndarray, begin: np.ndarray, n: int) -> np.ndarray:
    """How many of the tokens each of n sets holds."""
    lo, count = begin[tokens], begin[tokens + 1] - begin[tokens]
    at = np.repeat(lo - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
    return np.bincount(holders[at], minlength=n)


def _verified(n: int, percent: int):
    """All pairs of a small cluster: a spanning forest of the links."""

    def links(sets: list[np.ndarray], nodes: np.ndarray):
        sizes = np.array([len(s) for s in sets])
        if len(sets) == 2:
            s, t = sets if len(sets[0]) <= len(sets[1]) else sets[::-1]
            at = np.minimum(np.searchsorted(t, s), len(t) - 1)
            both = int((t[at] == s).sum())
            return _stars([[0, 1]], nodes) if 100 * both >= percent * (len(s) + len(t) - both) else ([], [])
        distinct, holders, begin = _inverted(sets)

        def linked(i: int, rest: np.ndarray) -> np.ndarray:
            both = _common(np.searchsorted(distinct, sets[i]), holders, begin, len(sets))[rest]
            return 100 * both >= percent * (sizes[i] + sizes[rest] - both)

        return _stars(_parts(len(sets), linked), nodes)

    def run(batches):
        for t, cuts in _groups(batches, ["cluster"]):
            if cuts[-1] != t.num_rows:
                cuts = np.append(cuts, t.num_rows)
            nodes, texts = t.column("node").to_numpy(), t.column("text").to_pylist()
            a, b = [], []
            for lo, hi in zip(cuts, cuts[1:]):
                sets = list(shingle_sets(texts[lo:hi], n)) if hi - lo > 1 else []
                some = [k for k, x in enumerate(sets) if len(x)]  # another row of the doc_id can be without words
                if len(some) > 1:
                    x, y = links([sets[k] for k in some], nodes[lo:hi][some])
                    a += x
                    b += y
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=_EDGES)

    return run


def _against_pivots(percent: int):
    """Rows of (cluster, pivots, members): every member against every pivot of the group: a spanning forest of the links that involve a pivot."""

    def forest(sets: list[np.ndarray], nodes: np.ndarray, n_pivots: int):
        distinct, holders, begin = _inverted(sets[:n_pivots])
        sizes, root, a, b = np.array([len(s) for s in sets[:n_pivots]]), np.arange(n_pivots), [], []
        for i, s in enumerate(sets):
            at = np.minimum(np.searchsorted(distinct, s), len(distinct) - 1)
            both = _common(at[distinct[at] == s], holders, begin, n_pivots)
            hits = np.flatnonzero(100 * both >= percent * (sizes + len(s) - both))
            hits = hits[hits != i]
            if i < n_pivots:
                hits = hits[root[hits] != root[i]]
            roots, first = np.unique(root[hits], return_index=True)
            a += nodes[hits[first]].tolist()
            b += [int(nodes[i])] * len(first)
            if len(roots):
                root[np.isin(root, roots) | ((root == root[i]) if i < n_pivots else False)] = roots[0]
        return a, b

    def run(batches):
        for t, cuts in _groups(batches, ["cluster", "pivots", "members"]):
            if cuts[-1] != t.num_rows:
                cuts = np.append(cuts, t.num_rows)
            nodes, n_pivots = t.column("node").to_numpy(), np.add.reduceat(t.column("pivot").to_numpy().astype(int), cuts[:-1])
            sets = [np.frombuffer(x, "<u8") for x in t.column("set").to_pylist()]
            a, b = [], []
            for lo, hi, k in zip(cuts, cuts[1:], n_pivots):
                if k:
                    x, y = forest(sets[lo:hi], nodes[lo:hi], int(k))
                    a += x
                    b += y
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=_EDGES)

    return run


def _linked_by_pivots(big: DataFrame, percent: int) -> DataFrame | None:
    """(a, b): a spanning forest of the links in large clusters; big: cluster, node, set.

    In a round, each cluster that is not settled takes pivots among the documents that are in
    question, and every document in question is verified against all of them.  A pivot then knows all
    its links and is out of question.  A cluster is settled when the documents still in question
    are in one component: pairs left could only link what is linked.  Components but the largest
    give the next pivots, four times as many in each round.  So a cluster of near copies of one text is
    settled in a round or two, linear in its documents.
    """
    open_ = saved(big.select("cluster", "node", F.col("node").alias("component")).distinct(), "in-question")
    links, pivots = [], BLOCK
    while True:
        counts = open_.groupBy("cluster", "component").agg(F.count("*").alias("n"))
        active = counts.groupBy("cluster").agg(F.count("*").alias("parts"), F.sum("n").alias("size"), F.max(F.struct("n", "component")).alias("main")).filter("parts > 1")
        giving = F.col("size") - (F.col("main.n") if links else F.lit(0))
        active = active.select("cluster", "size", F.col("main.component").alias("main"), giving.alias("giving"), F.ceil(F.least(giving, F.lit(pivots)) / BLOCK).cast("int").alias("spans"))
        active = saved(active.withColumn("blocks", F.ceil(F.col("size") / MEMBERS).cast("int")), "active")
        if active.isEmpty():
            return union(links)
        # At first all documents can give pivots, then those outside the largest part. About `pivots` do, by hash, so nothing is ranked.
        dealt = lambda n, what: F.pmod(F.xxhash64("node", F.lit(what), F.lit(pivots)), n).cast("int")  # noqa: B023, E731
        gives = (dealt(F.col("giving"), "pivot") < pivots) & (F.lit(not links) | (F.col("component") != F.col("main")))
        rows = open_.join(active.hint("merge"), "cluster").select("cluster", "node", "spans", "blocks", dealt(F.col("blocks"), "members").alias("members"), F.when(gives, dealt(F.col("spans"), "block")).alias("own"))
        mine = saved(rows.join(big.select("node", "set").hint("merge"), "node"), "sets")
        # Each document goes once to every block of pivots but its own, each pivot to every block of members.
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        as_member = mine.select("cluster", every("spans").alias("pivots"), "members", F.lit(False).alias("pivot"), "node", "set", "own").filter("own IS NULL OR own <> pivots")
        as_pivot = mine.filter("own IS NOT NULL").select("cluster", F.col("own").alias("pivots"), every("blocks").alias("members"), F.lit(True).alias("pivot"), "node", "set", "own")
        keys = ["cluster", "pivots", "members"]
        met = as_member.unionByName(as_pivot).drop("own").repartition(*keys).sortWithinPartitions(*keys, F.desc("pivot"))
        found = saved(met.mapInArrow(_against_pivots(percent), "a long, b long"), "links")
        links.append(found)
        # What is linked now joins the components there were; no link of an earlier round is looked at again.
        part = open_.select("node", "component")
        ends = found.join(part.toDF("a", "pa").hint("merge"), "a").join(part.toDF("b", "pb").hint("merge"), "b").select(F.col("pa").alias("a"), F.col("pb").alias("b"))
        joined = connected_components(ends).toDF("component", "new")
        left = open_.join(mine.filter("own IS NULL").select("node").distinct().hint("merge"), "node", "left_semi")
        after = saved(left.join(joined.hint("merge"), "component", "left").select("cluster", "node", F.coalesce("new", "component").alias("component")), "in-question")
        dropped(open_, active, mine)
        open_, pivots = after, 4 * pivots


def union(frames: list[DataFrame]) -> DataFrame | None:
    out = None
    for df in frames:
        out = df if out is None else out.unionByName(df)
    return out


def _sets(n: int):
    def run(batches):
        for batch in batches:
            sets = [x.astype("<u8").tobytes() for x in shingle_sets(batch.column(2).to_pylist(), n)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sets, pa.binary())], ["cluster", "node", "set"])

    return run


def _same_documents(sigs: DataFrame, nodes: DataFrame) -> DataFrame | None:
    """(a, b): links between the nodes of rows that share a doc_id, a star for each id; None if no id has two sets."""
    own = sigs.filter("n_shingles > 0").select("doc_id", "digest", F.xxhash64("digest").alias("h"))
    multi = saved(own.groupBy("doc_id").agg(F.min("h").alias("first"), F.max("h").alias("last")).filter("first <> last").select("doc_id", "first"), "shared-ids")
    if multi.isEmpty():
        return None
    rows = own.join(multi.hint("merge"), "doc_id").select("doc_id", "digest", (F.col("h") == F.col("first")).alias("centre")).distinct()
    placed = saved(rows.join(nodes.select("digest", "node").hint("merge"), "digest").select("doc_id", "node", "centre"), "rows-of-shared-ids")
    centres = placed.filter("centre").groupBy("doc_id").agg(F.min("node").alias("a"))
    return saved(placed.join(centres.hint("merge"), "doc_id").select("a", F.col("node").alias("b")).filter("a <> b").distinct(), "links-of-shared-ids")


def components(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable over links of percent/100 or more) and kept, for each row."""
    docs = documents_of(docs).withColumn("doc_id", F.coalesce("doc_id", F.lit(_NULL_ID))).withColumn("text_hash", F.xxhash64("text"))
    cut = percent / 100 - DEVIATIONS * (percent / 100 * (1 - percent / 100) / M) ** 0.5
    sigs = saved(sketches(spread(docs), shingle), "sketches")
    # One node a set. Its text is that of its smallest doc_id; of rows that share this too, of the smallest hash.
    own = sigs.filter("n_shingles > 0").groupBy("digest").agg(F.min(F.struct("doc_id", "text_hash")).alias("of"), F.any_value("regs").alias("regs"), F.any_value("n_shingles").alias("n_shingles"))
    nodes = saved(own.select("digest", "of.*", "regs", "n_shingles", F.monotonically_increasing_id().alias("node")), "nodes")

    width = 2 * ROWS
    keys = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.xxhash64(i, F.col("regs").substr(i * width + 1, F.lit(width))))
    bands = nodes.select("node", F.explode(keys).alias("key"))
    # Counts are written before they are joined: a join straight above an aggregate of the same key could not be split where a key is hot.
    shared = saved(bands.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("first")).filter("n > 1"), "shared")
    members = saved(bands.join(shared.hint("merge"), "key"), "bands")
    sparse = members.filter(F.col("n") <= HOT).select("key", "node").join(nodes.select("node", "regs", "n_shingles").hint("merge"), "node")
    likely = sparse.repartition("key").sortWithinPartitions("key").select("key", "node", "regs", "n_shingles").mapInArrow(_likely(cut, percent), "a long, b long")
    dense = members.filter(F.col("n") > HOT).select(F.col("first").alias("a"), F.col("node").alias("b"))
    clusters = saved(connected_components(likely.unionByName(dense)), "clusters")
    dropped(shared, members)

    sizes = saved(clusters.groupBy("component").agg(F.count("*").alias("size")), "sizes")
    again = saved(sigs.groupBy("doc_id", "text_hash").agg(F.count("*").alias("rows")).filter("rows > 1").select("doc_id", "text_hash", F.lit(True).alias("again")), "repeated-rows")
    placed = clusters.join(sizes.hint("merge"), "component").select("node", F.col("component").alias("cluster"), (F.col("size") <= BLOCK).alias("small"))
    placed = placed.join(nodes.select("node", "doc_id", "text_hash").hint("merge"), "node").join(again.hint("merge"), ["doc_id", "text_hash"], "left")
    texts = saved(docs.join(placed.hint("merge"), ["doc_id", "text_hash"]).select("cluster", "small", "node", "text", F.coalesce("again", F.lit(False)).alias("again")), "texts")
    # One row a node: those of rows that are repeated are put together before any shuffle.
    repeated = texts.filter("again").groupBy("cluster", "small", "node").agg(F.any_value("text").alias("text"))
    each = texts.filter("not again").drop("again").unionByName(repeated)
    found = each.filter("small").select("cluster", "node", "text").repartition("cluster").sortWithinPartitions("cluster").mapInArrow(_verified(shingle, percent), "a long, b long")
    large = each.filter("not small").select("cluster", "node", "text")
    if not texts.filter("not small").isEmpty():
        big = saved(large.mapInArrow(_sets(shingle), "cluster long, node long, set binary").filter("octet_length(set) > 0"), "large")
        found = union([found, *filter(None, [_linked_by_pivots(big, percent)])])
    linked = connected_components(union([found, *filter(None, [_same_documents(sigs, nodes)])]))

    # The smallest doc_id of a component's nodes is its id.
    firsts = saved(linked.join(nodes.select("node", "doc_id").hint("merge"), "node"), "firsts")
    lowest = saved(firsts.groupBy("component").agg(F.min("doc_id").alias("lowest")), "lowest")
    reached = firsts.join(lowest.hint("merge"), "component").select("node", "lowest")
    own = nodes.select("digest", "node", "doc_id").join(reached.hint("merge"), "node", "left").select("digest", F.coalesce("lowest", "doc_id").alias("component_id"))
    out = sigs.select("doc_id", "n_shingles", "digest").join(saved(own, "components").hint("merge"), "digest", "left")
    component = F.coalesce("component_id", "doc_id")
    dropped(nodes, clusters, sizes, texts, again, firsts, lowest)
    return out.select(F.nullif("doc_id", F.lit(_NULL_ID)).alias("doc_id"), "n_shingles", F.nullif(component, F.lit(_NULL_ID)).alias("component_id"), (F.col("doc_id") == component).alias("kept"))


def deduplicated(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """The documents that are the first of their component, with their own columns; of rows that repeat a doc_id and a text, one."""
    kept = components(docs, shingle, percent).filter("kept").groupBy(F.col("doc_id").alias("kept_id")).agg(F.count("*").alias("times"))
    kept = saved(kept, "kept")
    own = [f"c{i}" for i in range(len(docs.columns))]  # the documents' columns can be called anything
    at = {c: own[docs.columns.index(c)] for c in ("doc_id", "text")}
    named = docs.toDF(*own)

    def rows(times: str) -> DataFrame:
        return named.join(kept.filter(times).hint("merge"), named[at["doc_id"]].cast("long").eqNullSafe(kept["kept_id"])).select(*own)

    return rows("times = 1").unionByName(rows("times > 1").dropDuplicates([at["doc_id"], at["text"]])).toDF(*docs.columns)
