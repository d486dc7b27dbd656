"""Conversation structure repair: cheapest edits by a time-major dynamic program on NumPy tensors.

A conversation's roles should read system (at most once, first), then user and assistant in
turn, ending with the assistant, or it should have no turns.  Edits: Keep (K, 0), Rerole (R, 2,
to user or assistant), Delete (D, 3), Insert (I, 2, an empty user or assistant turn); blank and
duplicate turns must be deleted, truncated ones that stay add 1.

Conversations are bucketed by length and stacked, one column each, aligned at their ends.  From
the last turn to the first, one step updates the costs of all four states (nothing yet, after
system, after user, after assistant) of all conversations of a bucket at once, and all backward
costs are stored.  The trace goes from the first turn on, again for all conversations at once: at each
step a conversation takes the edit of the least letter (D, I, K, R in ASCII order) that the stored
costs allow, which gives the least audit string among the cheapest.

Two exchanges by conv_id.  In the first go a turn's place, role, digest and faults, without text;
a task holds 1 byte of faults, 16 of costs and a digest for each turn of the conversations
in hand.  In the second each conversation's audit comes before its turns, whose
texts are streamed past it: hashed, or emitted as repaired turns, and never held.  A
conversation's turns meet in one task at both: a sha256 of all its text can only be taken in order.

Order: by turn, nulls first; turns of one number by role and then the text's SHA-256.
Defined results: a null role or text is one space (the first has no known initial, the second is
blank); a null conv_id is a conversation of its own; an empty role has no initial and cannot be kept;
initials are case-sensitive; turns that are repeated are duplicates, the first of them is none;
texts and conversations of any length are taken whole; an
empty table gives an empty one; columns other than the four are not looked at.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from medialoom.llm.common import shuffle_partitions
from medialoom.session import ship

START, SYSTEM, USER, ASSISTANT = range(4)
#: Where a user's or assistant's turn leads; which of them it must be.
NEXT = np.array([USER, USER, ASSISTANT, USER])
SYSTEM_ROLE, USER_ROLE, ASSISTANT_ROLE = 1, 2, 3  # classes of initials; 0 is any other
BLANK, DUPLICATE, TRUNCATED = 1, 2, 3
REROLE, DELETE, INSERT = 2, 3, 2
#: Turns that a task takes in hand at once, and cells of a bucket's tensor.
ROWS, CELLS = 200_000, 1_000_000
_NEVER = 1 << 29
_SPACE = " \t\n\x0b\f\r"

# ---------------------------------------------------------------- rows

def conversations_of(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role and text alone; a null role or text is one space."""
    ship(rows.sparkSession)
    own = lambda c, kind: F.col(c).cast(kind)
    return rows.select(own("conv_id", "long").alias("conv_id"), own("turn", "long").alias("turn"), *[F.coalesce(own(c, "string"), F.lit(" ")).alias(c) for c in ("role", "text")])


def damaged(rows: DataFrame) -> DataFrame:
    """The rows after damage that the CRC-32 of `conv_id:turn` decides; `gone` marks dropped ones, which stay so that every conversation is still there."""
    key = F.concat(*[F.coalesce(F.col(c).cast("string"), F.lit(" ")) if c != ":" else F.lit(":") for c in ("conv_id", ":", "turn")])
    df = conversations_of(rows).withColumn("kind", F.crc32(key.cast("binary")) % 20)
    kind = F.col("kind")
    text = F.when(kind == 1, "").when(kind == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    df = df.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (kind == 0).alias("gone"), "kind")
    return df.withColumn("copy", F.explode(F.sequence(F.lit(0), F.when(kind == 3, 1).otherwise(0)))).drop("kind", "copy")


def _faults(rows: DataFrame) -> DataFrame:
    """Adds digest (of the text) and code: the class of the initial, 4 if blank, 8 if the last character is no end of a sentence."""
    initial = F.substring("role", 1, 1)
    rest = F.rtrim("text", F.lit(_SPACE))
    code = F.when(initial == "s", SYSTEM_ROLE).when(initial == "u", USER_ROLE).when(initial == "a", ASSISTANT_ROLE).otherwise(0)
    ended = F.substring(rest, -1, 1).isin(".", "!", "?")
    return rows.withColumn("digest", F.unhex(F.sha2(F.col("text").cast("binary"), 256))).withColumn("code", (code + F.when(rest == "", 4).otherwise(0) + F.when(ended, 0).otherwise(8)).cast("byte"))


# ---------------------------------------------------------------- the program

def backward(kind: np.ndarray, fault: np.ndarray) -> np.ndarray:
    """Costs (T+1, 4, N) from each place and state to the end, of N conversations whose T turns have these classes and faults (T, N)."""
    t_max, n = kind.shape
    out = np.empty((t_max + 1, 4, n), np.int32)
    out[t_max] = np.array([0, 2 * INSERT, INSERT, 0], np.int32)[:, None]
    for t in range(t_max - 1, -1, -1):
        after, k = out[t + 1], kind[t]
        stays = np.where((fault[t] == 0) | (fault[t] == TRUNCATED), (fault[t] == TRUNCATED).astype(np.int32), _NEVER)
        now = after + DELETE
        user, assistant = after[USER] + stays, after[ASSISTANT] + stays
        for q in range(4):
            to, wanted = (assistant, ASSISTANT_ROLE) if q == USER else (user, USER_ROLE)
            np.minimum(now[q], to + np.where(k == wanted, 0, REROLE), out=now[q])
        np.minimum(now[START], np.where(k == SYSTEM_ROLE, after[SYSTEM] + stays, _NEVER), out=now[START])
        np.minimum(now[USER], now[ASSISTANT] + INSERT, out=now[USER])
        np.minimum(now[ASSISTANT], now[USER] + INSERT, out=now[ASSISTANT])
        for q in (START, SYSTEM):
            np.minimum(now[q], now[USER] + INSERT, out=now[q])
        out[t] = now
    return out


def traced(costs: np.ndarray, kind: np.ndarray, fault: np.ndarray, lengths: np.ndarray) -> list[bytes]:
    """The least audit string of each conversation, from the stored costs."""
    t_max, n = kind.shape
    t, q, who, steps = t_max - lengths, np.zeros(n, np.int64), np.arange(n), []
    while True:
        going = (t < t_max) | (costs[t, q, who] > 0)
        t, q, who = t[going], q[going], who[going]
        if not len(who):
            break
        cost, rows = costs[t, q, who], t < t_max
        at = np.minimum(t, t_max - 1)
        k, f = kind[at, who], fault[at, who]
        delete = rows & (costs[np.minimum(t + 1, t_max), q, who] + DELETE == cost)
        insert = ~delete & (costs[t, NEXT[q], who] + INSERT == cost)
        stays = rows & ~delete & ~insert
        opens = (q == START) & (k == SYSTEM_ROLE)
        to = np.where(opens, SYSTEM, NEXT[q])
        fits = opens | (k == np.where(q == USER, ASSISTANT_ROLE, USER_ROLE))
        keep = stays & fits & (costs[np.minimum(t + 1, t_max), to, who] + (f == TRUNCATED) == cost)
        step = np.zeros(n, np.uint8)
        step[who] = np.where(delete, ord("D"), np.where(insert, ord("I"), np.where(keep, ord("K"), ord("R"))))
        steps.append(step)
        q = np.where(delete, q, np.where(keep, to, NEXT[q]))
        t = t + ~insert
    letters = np.stack(steps, axis=1) if steps else np.zeros((n, 0), np.uint8)
    flat, ends = letters[letters > 0].tobytes(), np.cumsum((letters > 0).sum(axis=1)).tolist()
    return [flat[a:b] for a, b in zip([0, *ends], ends)]


def cheapest(kind: np.ndarray, fault: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """Cost and audit of each conversation; the turns of one follow those of the other. Bucketed by length."""
    starts = np.cumsum(lengths) - lengths
    order = np.argsort(lengths, kind="stable")
    cost, audits, lo = np.zeros(len(lengths), np.int64), [b""] * len(lengths), 0
    while lo < len(order):
        least = int(lengths[order[lo]])
        hi = int(np.searchsorted(lengths[order], least + least // 4, "right"))
        hi = max(lo + 1, min(hi, lo + CELLS // max(1, least)))
        who = order[lo:hi]
        n = lengths[who]
        t_max = int(n[-1])
        if t_max:
            column = np.repeat(np.arange(len(who)), n)
            inside = np.arange(len(column)) - np.repeat(np.cumsum(n) - n, n)
            row, source = inside + np.repeat(t_max - n, n), inside + np.repeat(starts[who], n)
            k, f = np.zeros((t_max, len(who)), np.int8), np.zeros((t_max, len(who)), np.int8)
            k[row, column], f[row, column] = kind[source], fault[source]
            costs = backward(k, f)
            cost[who] = costs[t_max - n, START, np.arange(len(who))]
            for i, audit in zip(who.tolist(), traced(costs, k, f, n)):
                audits[i] = audit
        lo = hi
    return cost, audits


# ---------------------------------------------------------------- tasks

_NUMBERS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def _changes(conv: pa.ChunkedArray) -> np.ndarray:
    """Where another conv_id begins, in sorted rows."""
    v, null = conv.fill_null(0).to_numpy(), conv.is_null().to_numpy()
    return np.concatenate([[True], (v[1:] != v[:-1]) | (null[1:] != null[:-1])]) if len(v) else np.zeros(0, bool)


def _whole(batches):
    """Tables of whole conversations, of about ROWS turns, from sorted rows."""
    held, n = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        n += batch.num_rows
        if n < ROWS:
            continue
        edge = pa.Table.from_batches([*([held[-2].slice(held[-2].num_rows - 1)] if len(held) > 1 else []), batch]).column("conv_id")
        cuts = np.flatnonzero(_changes(edge)[1:]) + 1 - (len(edge) - batch.num_rows)  # in the last batch; 0: before it
        if len(cuts):
            cut = int(cuts[-1])
            yield pa.Table.from_batches([*held[:-1], batch.slice(0, cut)])
            held, n = [batch.slice(cut)], batch.num_rows - cut
    if held:
        yield pa.Table.from_batches(held)


def _planned(batches):
    """For each conversation its counts, cost and audit."""
    for t in _whole(batches):
        change = _changes(t.column("conv_id"))
        conv = np.cumsum(change) - 1
        n = int(conv[-1]) + 1
        live = ~t.column("gone").to_numpy()
        codes = lambda c: t.column(c).combine_chunks().dictionary_encode().indices.to_numpy().astype(np.int64)  # noqa: B023, E731
        digest = codes("digest")
        key = codes("role") * (int(digest.max()) + 1) + digest
        at = np.flatnonzero(live)
        conv, key, code = conv[at], key[at], t.column("code").to_numpy()[at]
        order = np.lexsort((key, conv))
        again = np.zeros(len(at), bool)
        again[order[1:]] = (conv[order[1:]] == conv[order[:-1]]) & (key[order[1:]] == key[order[:-1]])  # lexsort is stable: the first one is first
        kind = code & 3
        fault = np.where(code & 4, BLANK, np.where(again, DUPLICATE, np.where(code & 8, TRUNCATED, 0))).astype(np.int8)
        count = lambda which: np.bincount(conv[which], minlength=n)  # noqa: B023, E731
        same = conv[1:] == conv[:-1]
        x, y = kind[:-1], kind[1:]
        fine = ((y == USER_ROLE) & ((x == SYSTEM_ROLE) | (x == ASSISTANT_ROLE))) | ((x == USER_ROLE) & (y == ASSISTANT_ROLE))
        illegal = np.bincount(conv[1:][same & ~fine], minlength=n)
        cost, audits = cheapest(kind, fault, np.bincount(conv, minlength=n))
        first = np.flatnonzero(change)
        numbers = [_gaps(t.column("turn"), at, conv, n), count(fault == BLANK), count(fault == DUPLICATE), count(fault == TRUNCATED), illegal, cost]
        yield pa.RecordBatch.from_arrays([t.column("conv_id").combine_chunks().take(pa.array(first)), *[pa.array(x.astype(np.int64)) for x in numbers], pa.array([a.decode() for a in audits], pa.string())], ["conv_id", *_NUMBERS, "audit"])


def _gaps(turn: pa.ChunkedArray, at: np.ndarray, conv: np.ndarray, n: int) -> np.ndarray:
    """Of each conversation, how many numbers between its least and its greatest turn are missing; turns rise, nulls come first."""
    some = ~turn.is_null().to_numpy()[at]
    v, conv = turn.fill_null(0).to_numpy()[at][some], conv[some]
    steps = np.where(conv[1:] == conv[:-1], np.maximum(v[1:] - v[:-1] - 1, 0), 0)
    out = np.zeros(n, np.int64)
    np.add.at(out, conv[1:], steps)
    return out


class Replay:
    """Applies an audit to the turns of a conversation as they come."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state = audit, 0, START

    def _next(self) -> str:
        self.state = int(NEXT[self.state])
        return "user" if self.state == USER else "assistant"

    def _inserted(self) -> list[tuple[str, str]]:
        out = []
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            out.append((self._next(), ""))
            self.at += 1
        return out

    def turn(self, role: str, text: str) -> list[tuple[str, str]]:
        """What this turn, and insertions before it, become."""
        out = self._inserted()
        letter = self.audit[self.at]
        self.at += 1
        if letter == "R":
            out.append((self._next(), text))
        elif letter == "K":
            self.state = SYSTEM if self.state == START and role[0] == "s" else int(NEXT[self.state])
            out.append((role, text))
        return out

    def end(self) -> list[tuple[str, str]]:
        """What is inserted at the end."""
        return self._inserted()


class _Hashed:
    schema = "conv_id long, " + "".join(f"{c} long, " for c in _NUMBERS) + "audit string, repaired_sha256 string"

    def __init__(self):
        self.rows = []

    def begin(self, row: dict) -> None:
        self.row, self.hash, self.some = row, hashlib.sha256(), False

    def take(self, turns: list[tuple[str, str]]) -> None:
        for role, text in turns:
            self.hash.update(f"{chr(10) if self.some else ''}{role}:{text}".encode())
            self.some = True

    def end(self) -> None:
        self.rows.append([self.row["conv_id"], *(self.row[c] for c in _NUMBERS), self.row["audit"], self.hash.hexdigest()])


class _Turns:
    schema = "conv_id long, turn long, role string, text string"

    def __init__(self):
        self.rows = []

    def begin(self, row: dict) -> None:
        self.row, self.n = row, 0

    def take(self, turns: list[tuple[str, str]]) -> None:
        for role, text in turns:
            self.rows.append([self.row["conv_id"], self.n, role, text])
            self.n += 1

    def end(self) -> None:
        pass


def _replayed(kind: type):
    def run(batches):
        out, replay = kind(), None
        types = [pa.int64() if c.split()[1] == "long" else pa.string() for c in kind.schema.split(", ")]
        names = [c.split()[0] for c in kind.schema.split(", ")]

        def flushed():
            made = [pa.array(x, t) for x, t in zip(zip(*out.rows), types)]
            out.rows = []
            return pa.RecordBatch.from_arrays(made, names)

        for batch in batches:
            for row in batch.to_pylist():
                if row["audit"] is None:
                    out.take(replay.turn(row["role"], row["text"]))
                    continue
                if replay is not None:
                    out.take(replay.end())
                    out.end()
                out.begin(row)
                replay = Replay(row["audit"])
            if out.rows:
                yield flushed()
        if replay is not None:
            out.take(replay.end())
            out.end()
            if out.rows:
                yield flushed()

    return run


# ---------------------------------------------------------------- the operator

def _repair(rows: DataFrame, kind: type) -> DataFrame:
    """rows: conv_id, turn, role, text and gone."""
    n = shuffle_partitions(rows.sparkSession)
    rows = _faults(rows)
    place = ["conv_id", F.asc_nulls_first("turn"), "role", "digest"]
    narrow = rows.drop("text").repartition(n, "conv_id").sortWithinPartitions(*place)
    plans = narrow.mapInArrow(_planned, "conv_id long, " + "".join(f"{c} long, " for c in _NUMBERS) + "audit string")
    both = rows.filter(~F.col("gone")).select("conv_id", "turn", "role", "digest", "text").unionByName(plans, allowMissingColumns=True)
    together = both.repartition(n, "conv_id").sortWithinPartitions("conv_id", F.asc(F.col("audit").isNull()), *place[1:])
    return together.select("conv_id", "role", "text", *_NUMBERS, "audit").mapInArrow(_replayed(kind), kind.schema)


def repaired(rows: DataFrame) -> DataFrame:
    """conv_id, turn (from 0), role and text of the repaired conversations; one that is left without turns has no row."""
    return _repair(conversations_of(rows).withColumn("gone", F.lit(False)), _Turns)


def report(rows: DataFrame, damage: bool = False) -> DataFrame:
    """A row for each conversation: gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256 (of `role:text` lines), after `damaged` if asked for."""
    return _repair(damaged(rows) if damage else conversations_of(rows).withColumn("gone", F.lit(False)), _Hashed)
