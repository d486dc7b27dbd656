"""BPE encoding and decoding by speculation and verification.

A word is first cut greedily into the longest vocabulary entries.  That proposal is the BPE
encoding of the word if, and only if, each of its tokens is what the merges make of that
token's own text, and each adjacent pair is what they make of the pair's text; so all pairs
of all new words of a batch are checked at once, as integer codes against a table of pairs
already judged, and only words with a failing pair go through the exact merges.

Words repeat, so a worker numbers the words it meets and keeps the encodings of the first CACHE;
a text is then one look-up a word, and its ids and its decoded text are gathered and joined
by Arrow.

Defined results: a null text is an empty one (no ids, empty decoded text); empty texts give
no ids; repeated rows are encoded one by one; very long texts are encoded whole; an empty table
gives an empty one; columns other than doc_id and text are not looked at, whatever their names.
"""

from __future__ import annotations

import heapq
import itertools
import json
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from medialoom.llm.common import claim, documents_of, keeps

CACHE, PAIRS = 400_000, 400_000
CHUNK_CHARS = 1_000_000
#: Words of this many symbols at most are merged many at a time.
MATRIX = 48
_NO_RANK = 1 << 40

#: Letters, numbers and white space below U+0180, as the tokenizers' patterns see them.
LETTERS, NUMBERS, SPACES = "A-Za-zªµºÀ-ÖØ-öø-ſ", "0-9²³¹¼-¾", "\t-\r \x85\xa0"
#: Texts with other characters (or the one letter below that changes its length in lower case) are split by the library.
_RARE = re.compile("[^\x00-įı-ſ]")
_PIECES = re.compile(f"'(?:[stmd]|re|ve|ll)|[{LETTERS}]+|[{NUMBERS}]|[^{SPACES}{LETTERS}{NUMBERS}]+")


def byte_alphabet() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies: itself if printable Latin-1, else the next code from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class SpeculativeBPE:
    """Encoder for a vocabulary file of the tokenizers library whose words end in a suffix."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names = {i: t for t, i in (self.vocab | self.special).items()}
        self.ranks = {}
        for rank, (a, b) in enumerate(model["merges"]):
            self.ranks.setdefault((self.vocab[a], self.vocab[b]), (rank, self.vocab[a + b]))
        self.width = len(self.names) + 1
        codes = np.array([a * self.width + b for a, b in self.ranks], np.int64)
        order = np.argsort(codes)
        self.merge_codes, (self.merge_ranks, self.merge_new) = codes[order], np.array(list(self.ranks.values()), np.int64).reshape(-1, 2)[order].T
        self.longest = max(map(len, self.vocab))
        self.alphabet = byte_alphabet()
        self.pairs, self.ok = np.empty(0, np.int64), np.empty(0, bool)  # pairs judged so far, in order, and the verdicts
        self.ok_token: dict[int, bool] = {}
        self.forget()
        self.library = Tokenizer.from_file(path)
        self.split_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    # ---- one word

    def symbols(self, word: str, ends: bool = True) -> list[int]:
        v = self.vocab
        out = [v[c] for c in word[:-1]]
        out.append(v[word[-1] + self.suffix] if ends else v[word[-1]])
        return out

    def merged(self, ids: list[int]) -> list[int]:
        """The exact merges: lowest rank first, then leftmost."""
        ranks = self.ranks
        if len(ids) > MATRIX:
            return self._merged_long(ids)
        while len(ids) > 1:
            best, at = None, -1
            for i, pair in enumerate(zip(ids, ids[1:])):
                r = ranks.get(pair)
                if r is not None and (best is None or r[0] < best[0]):
                    best, at = r, i
            if best is None:
                break
            ids = [*ids[:at], best[1], *ids[at + 2 :]]
        return ids

    def merged_many(self, words: list[list[int]]) -> list[list[int]]:
        """The exact merges of many words at once: in a step each word that has a pair to merge merges its first one of the lowest rank."""
        out: list = [None] * len(words)
        short = []
        for i, ids in enumerate(words):
            if len(ids) > MATRIX:
                out[i] = self._merged_long(ids)
            elif len(ids) > 1:
                short.append(i)
            else:
                out[i] = list(ids)
        short.sort(key=lambda i: len(words[i]))
        for lo in range(0, len(short), 4096):  # of about equal lengths
            rows = np.array(short[lo : lo + 4096], np.int64)
            x = np.full((len(rows), len(words[rows[-1]])), -1, np.int64)
            for k, i in enumerate(rows.tolist()):
                x[k, : len(words[i])] = words[i]
            while len(rows):
                codes = np.where(x[:, 1:] >= 0, x[:, :-1] * self.width + x[:, 1:], -1)
                at = np.minimum(np.searchsorted(self.merge_codes, codes), len(self.merge_codes) - 1)
                rank = np.where(self.merge_codes[at] == codes, self.merge_ranks[at], _NO_RANK)
                best = np.argmin(rank, axis=1) if rank.shape[1] else np.zeros(len(rows), np.int64)
                some = rank[np.arange(len(rows)), best] < _NO_RANK if rank.shape[1] else np.zeros(len(rows), bool)
                for i, ids in zip(rows[~some].tolist(), x[~some].tolist()):
                    out[i] = [t for t in ids if t >= 0]
                rows, x, best, at = rows[some], x[some], best[some], at[some]
                if len(rows):
                    every = np.arange(len(rows))
                    x[every, best] = self.merge_new[at[every, best]]
                    x = np.take_along_axis(x, np.arange(x.shape[1] - 1) + (np.arange(x.shape[1] - 1) > best[:, None]), axis=1)
        return out

    def _merged_long(self, ids: list[int]) -> list[int]:
        """The same with a heap over a linked list, for long words."""
        n, ranks = len(ids), self.ranks
        ids, left, right = list(ids), list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(*r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := ranks.get((ids[i], ids[i + 1])))]
        heap = [(rank, i, a, b, new) for rank, new, i, a, b in heap]
        heapq.heapify(heap)
        while heap:
            _, i, a, b, new = heapq.heappop(heap)
            j = right[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j], right[i] = new, -1, right[j]
            if right[j] >= 0:
                left[right[j]] = i
            for x, y in ((left[i], i), (i, right[i])):
                if x >= 0 and y >= 0 and (r := ranks.get((ids[x], ids[y]))):
                    heapq.heappush(heap, (r[0], x, ids[x], ids[y], r[1]))
        return [x for x in ids if x >= 0]

    def proposal(self, word: str) -> list[int]:
        """Greedy longest match."""
        v, suffix, longest, n, p, out = self.vocab, self.suffix, self.longest, len(word), 0, []
        while p < n:
            q = min(n, p + longest)
            if q == n:
                t = v.get(word[p:] + suffix)
                if t is not None:
                    out.append(t)
                    break
                q = n - 1 if suffix else n
            while (t := v.get(word[p:q])) is None:
                q -= 1
                if q == p:  # a lone last character
                    raise KeyError(word[p])
            out.append(t)
            p = q
        return out

    # ---- many words

    def _own(self, tokens: list[int]) -> None:
        """Judges tokens not met before: whether the merges of a token's own text give that token."""
        new = [t for t in dict.fromkeys(tokens) if t not in self.ok_token]
        self.ok_token.update((t, ids == [t]) for t, ids in zip(new, self.merged_many([self._of_tokens(t) for t in new])))

    def _judge_pairs(self, codes: np.ndarray) -> np.ndarray:
        a, b = (x.tolist() for x in np.divmod(codes, self.width))
        self._own(a + b)
        out = np.array([self.ok_token[x] and self.ok_token[y] for x, y in zip(a, b)], bool)
        at = np.flatnonzero(out).tolist()
        merged = self.merged_many([[*self._of_tokens(a[i]), *self._of_tokens(b[i])] for i in at])
        out[at] = [ids == [a[i], b[i]] for i, ids in zip(at, merged)]
        return out

    def _judged(self, codes: np.ndarray) -> np.ndarray:
        """Which of some distinct pairs, in order, are what the merges make of them: all are looked up at once, the new ones judged and kept."""
        if len(self.pairs) > PAIRS:
            self.pairs, self.ok = np.empty(0, np.int64), np.empty(0, bool)
        at = np.searchsorted(self.pairs, codes)
        known = np.zeros(len(codes), bool)
        inner = at < len(self.pairs)
        known[inner] = self.pairs[at[inner]] == codes[inner]
        out = np.empty(len(codes), bool)
        out[known] = self.ok[at[known]]
        new = codes[~known]
        out[~known] = self._judge_pairs(new)
        self.pairs, self.ok = np.insert(self.pairs, at[~known], new), np.insert(self.ok, at[~known], out[~known])
        return out

    def _of_tokens(self, t: int) -> list[int]:
        name = self.names[t]
        ends = bool(self.suffix) and name.endswith(self.suffix) and len(name) > len(self.suffix)
        return self.symbols(name[: -len(self.suffix)], True) if ends else self.symbols(name, False)

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """Ids of each word, given in the byte alphabet."""
        out = [self.proposal(w) for w in words]
        counts = np.fromiter(map(len, out), np.int64, len(out))
        if not len(out):
            return out
        flat = np.fromiter((t for ids in out for t in ids), np.int64, int(counts.sum()))
        word = np.repeat(np.arange(len(out)), counts)
        inside = word[1:] == word[:-1]
        codes = (flat[:-1] * self.width + flat[1:])[inside]
        unique, place = np.unique(codes, return_inverse=True)
        failing = set(word[1:][inside][~self._judged(unique)[place]].tolist())
        lone = np.flatnonzero(counts == 1).tolist()  # a lone token has no pair to judge it by
        self._own([out[i][0] for i in lone])
        failing.update(i for i in lone if not self.ok_token[out[i][0]])
        at = sorted(failing)
        for i, ids in zip(at, self.merged_many([self.symbols(words[i]) for i in at])):
            out[i] = ids
        return out

    # ---- texts

    def _mapped(self, piece: str) -> str:
        return piece if piece.isascii() and piece.isprintable() else "".join(map(self.alphabet.__getitem__, piece.encode()))

    def pieces(self, text: str) -> list[str | bytes]:
        """The words of a text without special tokens; those that the library split are in the byte alphabet, and bytes."""
        if text.isascii() or not _RARE.search(text):
            return _PIECES.findall(text.lower())
        normal = self.library.normalizer.normalize_str(text)
        return [p.encode() for p, _ in self.library.pre_tokenizer.pre_tokenize_str(normal)]

    def forget(self) -> None:
        self.words = _Numbers()
        self.id_text, self.token_text, self.sizes, self.passed = pa.array([], pa.string()), pa.array([], pa.string()), np.empty(0, np.int64), 0

    def _learn(self) -> None:
        """Encodes the words that have a number and no entry yet."""
        new = [p for p in itertools.islice(self.words, len(self.sizes), None)]
        plain = [p for p in new if not isinstance(p, tuple)]
        coded = iter(self.encode_words([p.decode() if isinstance(p, bytes) else self._mapped(p) for p in plain]))
        ids = [[self.special[p[0]]] if isinstance(p, tuple) else next(coded) for p in new]
        names = self.names
        self.id_text = pa.concat_arrays([self.id_text, pa.array([" ".join(map(str, x)) for x in ids], pa.string())])
        self.token_text = pa.concat_arrays([self.token_text, pa.array([" ".join(map(names.__getitem__, x)) for x in ids], pa.string())])
        self.sizes = np.append(self.sizes, np.fromiter(map(len, ids), np.int64, len(ids)))

    def encoded(self, texts: list[str | None]) -> tuple[np.ndarray, pa.Array, pa.Array]:
        """For each text the number of its ids, the ids, and the decoded text (this vocabulary's decoder joins token strings by a space)."""
        lists: list[list] = []
        for t in texts:
            if not t:
                lists.append([])
            elif self.split_special and "<|" in t:
                lists.append([w for i, x in enumerate(self.split_special.split(t)) for w in ([(x,)] if i % 2 else self.pieces(x))])
            else:
                lists.append(self.pieces(t))
        kept = len(self.sizes)
        ends = np.cumsum([0, *map(len, lists)])
        at = np.fromiter(map(self.words.__getitem__, itertools.chain.from_iterable(lists)), np.int64, int(ends[-1]))
        if len(self.words) > kept:
            self._learn()
        n = np.diff(np.concatenate([[0], np.cumsum(self.sizes[at])])[ends])
        offsets, take = pa.array(ends, pa.int32()), pa.array(at)
        joined = [pc.binary_join(pa.ListArray.from_arrays(offsets, x.take(take)), " ") for x in (self.id_text, self.token_text)]
        if len(self.words) > CACHE:  # what was met first is what is frequent; if ever more does not fit, the texts have changed
            self.passed += len(self.words) - kept
            if kept == 0 or self.passed > 4 * CACHE:
                self.forget()
            else:
                for _ in range(len(self.words) - kept):
                    self.words.popitem()
                self.id_text, self.token_text, self.sizes = self.id_text[:kept], self.token_text[:kept], self.sizes[:kept]
        return n, *joined

    def encode_texts(self, texts: list[str | None]) -> tuple[list[str], list[str]]:
        _, ids, decoded = self.encoded(texts)
        return ids.to_pylist(), decoded.to_pylist()


class _Numbers(dict):
    """0, 1, 2, ... for words in the order in which they are met."""

    def __missing__(self, word) -> int:
        n = self[word] = len(self)
        return n


_ENCODERS: dict[str, SpeculativeBPE] = {}
keeps("bpe", _ENCODERS.clear)


def encoder(path: str) -> SpeculativeBPE:
    """This process's encoder for a vocabulary file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = SpeculativeBPE(path)
    return _ENCODERS[path]


def vocabulary(name: str) -> str:
    """Where this machine has a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def chunks(texts: list, limit: int = CHUNK_CHARS):
    """Ranges of consecutive texts of about `limit` characters; a longer text is a range of its own."""
    start = size = 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if i > start and size + n > limit:
            yield start, i
            start, size = i, 0
        size += n
    if len(texts) > start:
        yield start, len(texts)


def encode(docs: DataFrame, name: str = "word_bpe_49k.json") -> DataFrame:
    """doc_id, n_tokens, ids (decimal, joined by a space) and the text decoded from them, for each row of docs."""

    def run(batches):
        claim("bpe")
        enc = encoder(vocabulary(name))
        for batch in batches:
            doc_ids, texts = batch.column(0), batch.column(1).to_pylist()
            for a, b in chunks(texts):
                n, ids, decoded = enc.encoded(texts[a:b])
                yield pa.RecordBatch.from_arrays([doc_ids[a:b], pa.array(n), ids, decoded], ["doc_id", "n_tokens", "ids", "decoded"])

    return documents_of(docs).mapInArrow(run, "doc_id long, n_tokens long, ids string, decoded string")
