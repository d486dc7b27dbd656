"""Secret scans through a trigram index.

From each rule's pattern a Boolean query over trigrams is derived (what a match must contain).
Each segment of texts gets an inverted index of the trigrams that the queries name: one
vectorised pass over the bytes finds them, and their postings are the segment's documents.
Postings are intersected and united as the query says, and only the documents left are
verified with the pattern.  A rule without mandatory trigrams scans every document; if its
match is a long run of one character class, the scan is vectorised too.

Segments are built and used within a task, so the index never moves; there is no shuffle.

Defined results: a null text is an empty one and has no spans; matches of one kind never
overlap, those of different kinds can; repeated rows are scanned one by one; very long texts
are searched whole; an empty table gives an empty one; columns other than doc_id and text are
not looked at, whatever their names.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import cached_property

try:  # where Python keeps the parser of its patterns
    from re import _constants as C
    from re import _parser
except ImportError:
    import sre_constants as C
    import sre_parse as _parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from medialoom.llm.bpe import chunks
from medialoom.llm.common import documents_of

# ---------------------------------------------------------------- queries from patterns
# A query is True (anything can match), a trigram, or (and|or, [queries]).

LIMIT = 64  # strings that a piece of a pattern may stand for before it counts as open


def _all(parts):
    parts = [p for p in dict.fromkeys(_key(p) for p in parts) if p is not True]
    return True if not parts else parts[0] if len(parts) == 1 else ("and", tuple(parts))


def _any(parts):
    parts = list(dict.fromkeys(_key(p) for p in parts))
    return True if True in parts or not parts else parts[0] if len(parts) == 1 else ("or", tuple(parts))


def _key(q):
    return q if isinstance(q, (str, bool)) else (q[0], tuple(q[1]))


def _grams(strings: set[str]):
    """What a text must have to contain one of the strings."""
    return _any([True if len(s.encode()) < 3 else _all([s.encode()[i : i + 3].decode("latin-1") for i in range(len(s.encode()) - 2)]) for s in sorted(strings)])


def _strings(item) -> set[str] | None:
    """All strings that an item of a pattern can match, in lower case, if they are few."""
    op, arg = item
    if op is C.LITERAL:
        return {chr(arg).lower()} if arg < 128 else None
    if op is C.IN:
        out = set()
        for kind, x in arg:
            if kind is C.LITERAL and x < 128:
                out.add(chr(x).lower())
            elif kind is C.RANGE and x[1] < 128:
                out |= {chr(i).lower() for i in range(x[0], x[1] + 1)}
            else:
                return None
        return out if len(out) <= 4 else None
    if op is C.SUBPATTERN:
        return _sequence_strings(arg[-1])
    if op is C.BRANCH:
        parts = [_sequence_strings(p) for p in arg[1]]
        return None if None in parts else set().union(*parts)
    if op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT):
        lo, hi, sub = arg
        one = _sequence_strings(sub)
        if one is None or hi is C.MAXREPEAT or hi > 8:
            return None
        out, run = set(), {""}
        for k in range(hi + 1):
            if k >= lo:
                out |= run
            run = {a + b for a in run for b in one}
            if len(run) > LIMIT:
                return None
        return out
    if op is C.AT or op in (C.ASSERT, C.ASSERT_NOT):
        return {""}
    return None


def _sequence_strings(items) -> set[str] | None:
    out = {""}
    for item in items:
        s = _strings(item)
        if s is None or len(out) * len(s) > LIMIT:
            return None
        out = {a + b for a in out for b in s}
    return out


def _item_query(item):
    op, arg = item
    if op is C.SUBPATTERN:
        return _sequence_query(arg[-1])
    if op is C.BRANCH:
        return _any([_sequence_query(p) for p in arg[1]])
    if op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT) and arg[0] > 0:
        return _sequence_query(arg[2])
    return True


def _sequence_query(items):
    parts, run = [], {""}
    for item in items:
        s = _strings(item)
        if s is not None and len(run) * len(s) <= LIMIT:
            run = {a + b for a in run for b in s}
            continue
        parts += [_grams(run), _item_query(item) if s is None else _grams(s)]
        run = {""}
    return _all([*parts, _grams(run)])


def trigram_query(pattern: str):
    """The Boolean trigram query of a pattern, over text in ASCII lower case; True if nothing is mandatory."""
    return _sequence_query(_parser.parse(pattern, re.ASCII))


def trigrams_of(query) -> set[str]:
    return set() if query is True else {query} if isinstance(query, str) else set().union(*map(trigrams_of, query[1]))


# ---------------------------------------------------------------- rules

@dataclass(frozen=True)
class Rule:
    """pattern; least: characters that `group` of a match must have; run: (characters, least) if a match is a run of one class."""

    name: str
    pattern: str
    least: int = 0
    group: int = 0
    run: tuple[str, int] | None = None

    @cached_property
    def regex(self):
        return re.compile(self.pattern, re.ASCII)

    @cached_property
    def query(self):
        return trigram_query(self.pattern)

    def spans(self, text: str) -> list[tuple[int, int]]:
        return [m.span() for m in self.regex.finditer(text) if len(m[self.group]) >= self.least]


RULES = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2),
    Rule("access", r"AKIA[A-Z0-9]+", 20),
    Rule("hex", r"[0-9a-f]+", 24, run=("0123456789abcdef", 24)),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("code_host_token", r"gh[opsu]_[A-Za-z0-9]{36,}"),
    Rule("chat_token", r"xox[bpas]-[A-Za-z0-9-]{10,}"),
    Rule("map_key", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]+"),
)


# ---------------------------------------------------------------- the index of a segment

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


class Segment:
    """Texts as bytes one after another, each followed by a NUL, and the postings of the wanted trigrams."""

    def __init__(self, texts: list[str | None], table: np.ndarray, n_trigrams: int):
        raw = [t.encode() if t else b"" for t in texts]
        self.n = len(raw)
        self.bytes = np.frombuffer(b"\0".join([*raw, b""]), np.uint8)
        self.ends = np.cumsum([len(r) + 1 for r in raw])
        b = _FOLD[self.bytes]
        self.postings: list[np.ndarray] = [np.empty(0, np.int64)] * n_trigrams
        if len(b) >= 3:
            code = (b[:-2].astype(np.uint32) << np.uint32(16)) | (b[1:-1].astype(np.uint32) << np.uint32(8)) | b[2:]
            which = table[code]
            at = np.flatnonzero(which)
            pairs = np.unique((which[at].astype(np.int64) - 1) * self.n + self.doc_of(at))
            cuts = np.searchsorted(pairs, np.arange(n_trigrams + 1) * self.n)
            self.postings = [pairs[x:y] - i * self.n for i, (x, y) in enumerate(zip(cuts, cuts[1:]))]

    def doc_of(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.ends, at, "right")

    def matching(self, query, ids: dict[str, int]) -> np.ndarray:
        """Documents that satisfy a query: postings intersected and united."""
        if query is True:
            return np.arange(self.n)
        if isinstance(query, str):
            return self.postings[ids[query]]
        out = None
        for q in query[1]:
            m = self.matching(q, ids)
            out = m if out is None else np.intersect1d(out, m, assume_unique=True) if query[0] == "and" else np.union1d(out, m)
            if query[0] == "and" and not len(out):
                break
        return out

    def with_run(self, characters: str, least: int) -> np.ndarray:
        """Documents with a run of `least` of the characters: a full scan, vectorised."""
        inside = np.zeros(256, bool)
        inside[[ord(c) for c in characters]] = True
        outside = np.flatnonzero(~inside[self.bytes])  # the NULs at the ends among them
        long = np.diff(outside, prepend=-1) > least
        return np.unique(self.doc_of(outside[long]))


class Scanner:
    def __init__(self, rules: tuple[Rule, ...] = RULES):
        self.rules = rules
        grams = sorted(set().union(*(trigrams_of(r.query) for r in rules)))
        self.ids = {g: i for i, g in enumerate(grams)}
        self.table = np.zeros(1 << 24, np.uint8 if len(grams) < 255 else np.uint16)
        for g, i in self.ids.items():
            a, b, c = g.encode("latin-1")
            self.table[(a << 16) | (b << 8) | c] = i + 1

    def scan(self, texts: list[str | None]) -> list[list[dict]]:
        """Spans of each text, by start, then by the rules' order."""
        out: list[list[tuple]] = [[] for _ in texts]
        seg = Segment(texts, self.table, len(self.ids))
        for rank, rule in enumerate(self.rules):
            for i in (seg.with_run(*rule.run) if rule.run and rule.query is True else seg.matching(rule.query, self.ids)).tolist():
                if texts[i]:
                    out[i] += [(a, rank, b) for a, b in rule.spans(texts[i])]
        return [[{"kind": self.rules[r].name, "rank": r, "start": a, "end": b} for a, r, b in sorted(spans)] for spans in out]


_SCANNER: list[Scanner] = []
_SPAN = pa.list_(pa.struct([("kind", pa.string()), ("rank", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))


def find(docs: DataFrame) -> DataFrame:
    """doc_id and spans (kind, rank of the kind in RULES, start, end: code points, end exclusive), for each row."""

    def run(batches):
        if not _SCANNER:
            _SCANNER.append(Scanner())
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in chunks(texts, 4_000_000):
                spans = _SCANNER[0].scan(texts[a:b])
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], pa.array(spans, _SPAN)], ["doc_id", "spans"])

    return documents_of(docs).mapInArrow(run, "doc_id long, spans array<struct<kind:string,rank:int,start:int,end:int>>")
