"""Substring dedup with fixed-block anchors.

Each document is cut into non-overlapping blocks of BLOCK words, and these are indexed.
Every rolling window of BLOCK words of every document is a probe.  A repeat of 2*BLOCK words
or more holds a whole block of the place it repeats, wherever it starts, so probes that hit
the index mark all places where a repeat can be.  Hits are extended: the stretches of WINDOW
words around them are the candidates, their word sequences are compared (96-bit hashes of the
words' own 64-bit hashes), the earliest keeps its words, and the windows found earlier
elsewhere join to maximal exact repeats, which are removed.

Distribution.  Rows are dealt into shards by a hash that includes the row's number, so equal rows spread (one shuffle of the text, which the
three passes over it share).  A shard sends its distinct window hashes once, sorted, in packs:
one binary row for each slot of the hash space that it has any in, FAN slots at most, 4 bytes
a window and one of flags (is a block; occurs twice here).  While the corpus needs no more
than FAN buckets, a slot is a bucket.  Beyond that, packs of the same slot from FAN shards at a
time meet in a relay, which merges them and sends on to the buckets of the slot; replies come
back the same way.  So nobody sends more than FAN rows, however large the corpus, and a
passage that millions of documents share arrives at its bucket once from each shard or relay.
The reply is one bit a window.  Candidates go to buckets and come back as one bit each in the
same manner.  No pairs are made anywhere: work and traffic are linear in the words.

Defined results: words are split at space, \\t, \\n, \\v, \\f, \\r; a null text has no words;
documents with fewer than WINDOW words lose nothing; null doc_ids count as smallest; rows that
share a doc_id are ordered by shard, then text, so of repeated rows one keeps its words; very
long texts are taken whole; an empty table gives an empty one; columns other than doc_id and
text are not looked at, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from medialoom.llm.common import documents_of, gram_hashes, mixed, parts_for, shuffle_partitions, text_bytes, words_of

WINDOW, BLOCK = 20, 10
SHARD_BYTES = 8_000_000
#: Windows that one bucket should see: bytes of text for each bucket.
BUCKET_BYTES = 12_000_000
#: Rows that a shard, a relay or a bucket's sender sends at most.
FAN = 4096
_LOW = np.uint64(0xFFFFFFFF)
_NULL_ID = -(2**63)


@dataclass(frozen=True)
class Layout:
    """How many shards, slots of the hash space, and buckets in a slot there are (powers of two, but the shards)."""

    shards: int
    slots: int
    per_slot: int

    @property
    def relayed(self) -> bool:
        return self.per_slot > 1

    @property
    def kind(self) -> str:
        """The number type of a hash on its way: 32 bits below the slot's, or all 64 where they are needed."""
        return "<u8" if self.relayed else "<u4"

    def slot_of(self, h: np.ndarray) -> np.ndarray:
        bits = self.slots.bit_length() - 1
        return (h >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(h), np.int64)

    def sent(self, h: np.ndarray) -> np.ndarray:
        return h.astype("<u8") if self.relayed else ((h >> np.uint64(32 - (self.slots.bit_length() - 1))) & _LOW).astype("<u4")

    def bucket_of(self, h: np.ndarray) -> np.ndarray:
        """Within the slot."""
        skip, bits = self.slots.bit_length() - 1, self.per_slot.bit_length() - 1
        return ((h >> np.uint64(64 - skip - bits)) & np.uint64(self.per_slot - 1)).astype(np.int64)


def layout(docs: DataFrame) -> Layout:
    spark = docs.sparkSession
    total = text_bytes(docs)
    buckets = 1 << (max(2 * shuffle_partitions(spark), parts_for(spark, total, BUCKET_BYTES)) - 1).bit_length()
    slots = min(buckets, FAN)
    return Layout(parts_for(spark, total, SHARD_BYTES, least=2), slots, buckets // slots)


class _Shard:
    """The documents of a shard in their order, and the hashes of their words one after another."""

    def __init__(self, t: pa.Table):
        t = t.select(["shard", "doc_id", "text"])
        t = t.take(pc.sort_indices(t, [("doc_id", "ascending"), ("text", "ascending")], null_placement="at_start"))
        self.shard = t.column("shard")[0].as_py() if t.num_rows else 0
        self.doc_ids = t.column("doc_id").fill_null(_NULL_ID).to_numpy().astype("<i8")
        texts = [x or b"" for x in t.column("text").cast(pa.binary()).to_pylist()]
        self.text = b"\n".join(texts) + b"\n"
        first = np.concatenate([[0], np.cumsum([len(x) + 1 for x in texts])]).astype(np.int64)  # byte of each document
        del texts, t
        self.at, self.to, self.h = words_of(self.text)
        self.first = first
        self.starts = np.searchsorted(self.at, first)  # word of each document
        counts = np.diff(self.starts)
        self.begin = np.repeat(self.starts[:-1], counts)  # of each word's document
        self.end = np.repeat(self.starts[1:], counts)

    def places(self, n: int) -> np.ndarray:
        """Where windows of n words start that lie in one document."""
        return np.flatnonzero(np.arange(len(self.h)) + n <= self.end)


def _grouped(h: np.ndarray, exact: bool) -> tuple[np.ndarray, np.ndarray]:
    """An order of h, and which places of it begin another value. Unless `exact`, values count as equal that agree in all bits but those that number the places: the sort is then one of plain numbers."""
    if not len(h):
        return np.empty(0, np.int64), np.empty(0, bool)
    bits = np.uint64(max(1, (len(h) - 1).bit_length()))
    if exact or bits > 24:
        order = np.argsort(h, kind="stable")
        value = h[order]
    else:
        packed = np.sort(((h >> bits) << bits) | np.arange(len(h), dtype=np.uint64))
        order, value = (packed & np.uint64((1 << int(bits)) - 1)).astype(np.int64), packed >> bits
    fresh = np.ones(len(h), bool)
    fresh[1:] = value[1:] != value[:-1]
    return order, fresh


def _anchors(s: _Shard, exact: bool):
    """Rolling windows: their places in the order of the hashes, the distinct hashes, the flags of each, and for each place in that order which one it is."""
    at = s.places(BLOCK)
    h = gram_hashes(s.h, BLOCK)[at] if len(at) else np.empty(0, np.uint64)
    order, fresh = _grouped(h, exact)
    which = np.cumsum(fresh) - 1
    at = at[order]
    first = np.flatnonzero(fresh)
    flags = (np.diff(np.append(first, len(h))) > 1).astype(np.uint8) << 1
    flags[which[(at - s.begin[at]) % BLOCK == 0]] |= 1
    return at, h[order][first], flags, which


_PACK = "slot int, shard int, kind int, hashes binary, more binary, ids binary, starts binary"
_PACKS = pa.schema([("slot", pa.int32()), ("shard", pa.int32()), ("kind", pa.int32()), ("hashes", pa.binary()), ("more", pa.binary()), ("ids", pa.binary()), ("starts", pa.binary())])
_REPLY = "shard int, slot int, bits binary"
_REPLIES = pa.schema([("shard", pa.int32()), ("slot", pa.int32()), ("bits", pa.binary())])


def _table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * len(schema), schema)], schema=schema)


def _runs(part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values of a rising array and where each begins (and, last, where all end): no step for values it has not."""
    cut = np.flatnonzero(np.diff(part, prepend=-1))
    return part[cut], np.append(cut, len(part))


def _packs(sender: int, part: np.ndarray, *columns: np.ndarray) -> list[tuple]:
    """A row (part, sender, kind, ...) for each value of `part`, which rises."""
    values, cuts = _runs(part)
    rest = [b""] * (4 - len(columns))
    return [(int(v), sender, 0, *(c[x:y].tobytes() for c in columns), *rest) for v, x, y in zip(values, cuts, cuts[1:])]


def _read(replies: pa.Table, part: np.ndarray) -> np.ndarray:
    """Bits of all packs, one after another as their values were."""
    out = np.zeros(len(part), bool)
    values, cuts = _runs(part)
    slots = replies.column("slot").to_numpy()
    at = np.searchsorted(values, slots)
    for k, bits in zip(at.tolist(), replies.column("bits").to_pylist()):
        x, y = cuts[k], cuts[k + 1]
        out[x:y] = np.unpackbits(np.frombuffer(bits, np.uint8), count=y - x).astype(bool)
    return out


def _joined(t: pa.Table, column: str, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all packs, one after another, and how many each has."""
    parts = t.column(column).to_pylist()
    return np.frombuffer(b"".join(parts), kind), np.array([len(x) // np.dtype(kind).itemsize for x in parts], np.int64)


def _answers(t: pa.Table, bits: np.ndarray, sizes: np.ndarray) -> pa.Table:
    cuts = np.concatenate([[0], np.cumsum(sizes)])
    packed = [np.packbits(bits[a:b]).tobytes() for a, b in zip(cuts, cuts[1:])]
    return pa.Table.from_arrays([t.column("shard").combine_chunks(), t.column("slot").combine_chunks(), pa.array(packed, pa.binary())], schema=_REPLIES)


# ---------------------------------------------------------------- blocks and probes

def _index(how: Layout):
    def run(t: pa.Table) -> pa.Table:
        s = _Shard(t)
        _, unique, flags, _ = _anchors(s, how.relayed)
        return _table(_packs(s.shard, how.slot_of(unique), how.sent(unique), flags), _PACKS)

    return run


def _merged(t: pa.Table, kind: str):
    """The distinct hashes of some packs, their flags, which one each sent hash is, and the packs' sizes."""
    h, sizes = _joined(t, "hashes", kind)
    flags, _ = _joined(t, "more", "u1")
    unique, place, counts = np.unique(h, return_inverse=True, return_counts=True)
    out = (counts > 1).astype(np.uint8) << 1
    for bit in (1, 2):
        out[place[flags & bit > 0]] |= bit
    return unique, out, place, sizes


def _probe(kind: str):
    def run(t: pa.Table) -> pa.Table:
        """In a bucket: which of the windows sent hit a block elsewhere, or a block that occurs again where it is."""
        _, flags, place, sizes = _merged(t, kind)
        return _answers(t, (flags == 3)[place], sizes)

    return run


def _relay_windows(how: Layout):
    def run(t: pa.Table) -> pa.Table:
        unique, flags, _, _ = _merged(t, how.kind)
        sender = t.column("relay")[0].as_py() if t.num_rows else 0
        return _table(_packs(sender, how.bucket_of(unique), unique, flags), _PACKS)

    return run


def _relay_hits(how: Layout):
    def run(t: pa.Table, replies: pa.Table) -> pa.Table:
        unique, _, place, sizes = _merged(t, how.kind)
        return _answers(t, _read(replies, how.bucket_of(unique))[place], sizes)

    return run


# ---------------------------------------------------------------- candidates

def _candidates(s: _Shard, near: np.ndarray):
    """Sequences at the places `near`: hashes sorted, the places in that order, and which are the first in this shard."""
    a = b = np.zeros(len(near), np.uint64)
    with np.errstate(over="ignore"):
        for j in range(WINDOW):
            w = s.h[near + j]
            a = (a ^ (a >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + w
            b = (b ^ (b >> np.uint64(29))) * np.uint64(0xD1342543DE82EF95) + w
    a, b = mixed(a), mixed(b) & _LOW
    order = np.lexsort((b, a))  # stable: the earlier place comes first
    a, b, near = a[order], b[order], near[order]
    first = np.ones(len(a), bool)
    first[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return a, b, near, first


def _extend(how: Layout):
    def run(t: pa.Table, replies: pa.Table) -> pa.Table:
        s = _Shard(t)
        at, unique, _, which = _anchors(s, how.relayed)
        marks = np.zeros(len(s.h) + 1, np.int32)
        marks[at[_read(replies, how.slot_of(unique))[which]] + 1] = 1
        marks = np.cumsum(marks)
        del at, unique, which
        windows = s.places(WINDOW)
        near = windows[marks[windows + WINDOW - BLOCK + 1] > marks[windows]]  # a hit lies within the window
        here = np.zeros(len(s.h), bool)
        here[near] = True
        # Where the candidates are goes through a slot and back, beside them.
        rows = [(s.shard % how.slots, s.shard, 1, np.packbits(here).tobytes(), b"", b"", b"")] if len(near) else []
        a, b, near, first = _candidates(s, near)
        a, b, near = a[first], b[first], near[first]
        doc = np.searchsorted(s.starts, near, "right") - 1
        rows += _packs(s.shard, how.slot_of(a), a.astype("<u8"), b.astype("<u4"), s.doc_ids[doc], (near - s.starts[doc]).astype("<u4"))
        return _table(rows, _PACKS)

    return run


def _sequences(t: pa.Table):
    """The sequences of some packs: their columns, their senders, the order by sequence and then place, and which in that order begin another."""
    cols = [_joined(t, c, k)[0] for c, k in (("hashes", "<u8"), ("more", "<u4"), ("ids", "<i8"), ("starts", "<u4"))]
    sizes = _joined(t, "hashes", "<u8")[1]
    sender = np.repeat(t.column("shard").to_numpy().astype(np.int64), sizes)
    order = np.lexsort((cols[3], sender, cols[2], cols[1], cols[0]))
    fresh = np.ones(len(order), bool)
    for k, x in enumerate(cols[:2]):
        y = x[order]
        fresh[1:] = (fresh[1:] if k else False) | (y[1:] != y[:-1])
    return cols, sizes, order, fresh


def _split(t: pa.Table) -> tuple[pa.Table, list[tuple]]:
    """The packs, and the replies to rows that only pass through."""
    kind = t.column("kind")
    through = t.filter(pc.equal(kind, 1))
    return t.filter(pc.equal(kind, 0)), [(x, -1, y) for x, y in zip(through.column("shard").to_pylist(), through.column("hashes").to_pylist())]


def _earliest(t: pa.Table) -> pa.Table:
    """In a bucket: which of the sequences sent start earlier elsewhere."""
    t, through = _split(t)
    _, sizes, order, fresh = _sequences(t)
    later = np.zeros(len(order), bool)
    later[order] = ~fresh
    return pa.concat_tables([_answers(t, later, sizes), _table(through, _REPLIES)])


def _relay_sequences(how: Layout):
    def run(t: pa.Table) -> pa.Table:
        sender = t.column("relay")[0].as_py() if t.num_rows else 0
        t, _ = _split(t)
        cols, _, order, fresh = _sequences(t)
        own = order[fresh]
        return _table(_packs(sender, how.bucket_of(cols[0][own]), *(c[own] for c in cols)), _PACKS)

    return run


def _relay_later(how: Layout):
    def run(t: pa.Table, replies: pa.Table) -> pa.Table:
        t, through = _split(t)
        cols, sizes, order, fresh = _sequences(t)
        later = np.zeros(len(order), bool)
        later[order] = ~fresh
        own = order[fresh]
        later[own] = _read(replies, how.bucket_of(cols[0][own]))
        return pa.concat_tables([_answers(t, later, sizes), _table(through, _REPLIES)])

    return run


# ---------------------------------------------------------------- what is left

_RESULT = "doc_id long, n_words long, n_removed long, kept string, spans array<struct<start:int,end:int>>"
_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
_RESULTS = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string()), ("spans", _SPANS)])


def _kept(s: _Shard, removed: np.ndarray) -> pa.Array:
    """The words that stay, joined by a space, for each document: the bytes of the words and of one space before each but a document's first."""
    stay = np.flatnonzero(~removed)
    doc = np.searchsorted(s.starts, stay, "right") - 1
    inner = np.ones(len(stay), bool)
    inner[1:] = doc[1:] == doc[:-1]
    inner[:1] = False
    size = s.to[stay] - s.at[stay] + inner
    ends = np.cumsum(size)
    # from byte to byte the source goes on by one; at a word's first byte it jumps to the word (and to the byte before it, for the space)
    step = np.ones(int(ends[-1]) if len(ends) else 0, np.int64)
    begins = ends - size
    source = s.at[stay] - inner
    step[begins] = np.diff(source, prepend=0) - np.concatenate([[0], size[:-1] - 1])
    out = np.frombuffer(s.text, np.uint8)[np.cumsum(step)] if len(step) else np.empty(0, np.uint8)
    out[begins[inner]] = 0x20
    cuts = np.concatenate([[0], ends])[np.searchsorted(doc, np.arange(len(s.doc_ids) + 1))]
    return pa.Array.from_buffers(pa.large_string(), len(s.doc_ids), [None, pa.py_buffer(cuts.astype("<i8")), pa.py_buffer(out)]).cast(pa.string())


def _remove(how: Layout):
    def run(t: pa.Table, replies: pa.Table) -> pa.Table:
        s = _Shard(t)
        slots, here = replies.column("slot").to_numpy(), np.zeros(len(s.h), bool)
        for k in np.flatnonzero(slots == -1).tolist():
            here = np.unpackbits(np.frombuffer(replies.column("bits")[k].as_py(), np.uint8), count=len(s.h)).astype(bool)
        a, _, near, first = _candidates(s, np.flatnonzero(here))
        later = ~first
        later[first] = _read(replies.filter(pa.array(slots >= 0)), how.slot_of(a[first]))
        gone = np.zeros(len(s.h) + 1, np.int32)
        gone[near[later]] += 1  # places differ, so no index repeats; starts and ends are summed apart
        gone[near[later] + WINDOW] -= 1
        removed = np.cumsum(gone)[:-1] > 0
        # A run of removed words ends at its document's end too.
        doc = np.repeat(np.arange(len(s.doc_ids)), np.diff(s.starts))
        edge = np.ones(len(removed), bool)
        edge[1:] = doc[1:] != doc[:-1]
        begins = np.flatnonzero(removed & (edge | ~np.concatenate([[False], removed[:-1]])))
        ends = np.flatnonzero(removed & (np.append(edge[1:], True) | ~np.append(removed[1:], False))) + 1
        base = s.starts[doc[begins]]
        spans = pa.StructArray.from_arrays([pa.array((begins - base).astype(np.int32)), pa.array((ends - base).astype(np.int32))], ["start", "end"])
        cuts = pa.array(np.searchsorted(begins, s.starts).astype(np.int32))
        n_removed = np.diff(np.concatenate([[0], np.cumsum(removed)])[s.starts])
        ids = pa.array(s.doc_ids, mask=s.doc_ids == _NULL_ID)
        return pa.Table.from_arrays([ids, pa.array(np.diff(s.starts)), pa.array(n_removed), _kept(s, removed), pa.ListArray.from_arrays(cuts, spans)], schema=_RESULTS)

    return run


def _exchange(packs: DataFrame, how: Layout, bucket, relay_out, relay_back) -> DataFrame:
    """The replies of the buckets to the shards' packs, through relays where a slot has several buckets."""
    if not how.relayed:
        return packs.groupBy("slot").applyInArrow(bucket, _REPLY)
    groups = -(-how.shards // FAN)
    # A relay serves one slot and FAN shards.
    at: Column = (F.pmod("shard", F.lit(groups)) * how.slots + F.col("slot")).cast("int")
    met = packs.withColumn("relay", at).groupBy("relay")
    sent = met.applyInArrow(relay_out(how), _PACK)
    # What a relay sends to is a bucket of its slot.
    placed = sent.withColumn("bucket", F.pmod("shard", F.lit(how.slots)).cast("long") * how.per_slot + F.col("slot"))
    answers = placed.groupBy("bucket").applyInArrow(bucket, _REPLY)
    return met.cogroup(answers.withColumnRenamed("shard", "relay").groupBy("relay")).applyInArrow(relay_back(how), _REPLY)


def remove_repeats(docs: DataFrame) -> DataFrame:
    """For each document: n_words, n_removed, the kept words joined by a space, and the maximal repeats removed (word positions)."""
    docs = documents_of(docs)
    how = layout(docs)
    # the row's number spreads rows that are equal
    dealt = docs.withColumn("shard", F.pmod(F.xxhash64("doc_id", "text", F.monotonically_increasing_id()), F.lit(how.shards)).cast("int"))
    index = dealt.groupBy("shard").applyInArrow(_index(how), _PACK)
    hits = _exchange(index, how, _probe(how.kind), _relay_windows, _relay_hits)
    near = dealt.groupBy("shard").cogroup(hits.groupBy("shard")).applyInArrow(_extend(how), _PACK)
    later = _exchange(near, how, _earliest, _relay_sequences, _relay_later)
    return dealt.groupBy("shard").cogroup(later.groupBy("shard")).applyInArrow(_remove(how), _RESULT)
