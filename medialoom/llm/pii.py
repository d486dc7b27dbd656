"""Personal data: patterns propose spans, checksums confirm them, context words adjust the score.

All of it is built-in expressions in one projection: no user function, no shuffle.  Positions
come from the lengths of the pieces between matches (code points, end exclusive).  Patterns are
possessive and start only at the border of their class, so a long run of letters or digits is
scanned once.

Kinds: email, ip, card, phone (base); iban (mod-97) and ssn (accepted by its context words
alone) are added by the method.  A span's score is its kind's base score, plus CONTEXT_BONUS if
a context word of its kind stands within CONTEXT code points before it or after; spans under
MIN_SCORE go, but base spans start at it, so they stay.

Defined results: a null text is an empty one and has no spans; the same place can hold spans of
several kinds; repeated rows are judged one by one; very long texts are searched whole; an empty
table gives an empty one; columns other than doc_id and text are not looked at, whatever their
names (redacted keeps them).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CONTEXT, CONTEXT_BONUS, MIN_SCORE = 40, 0.4, 0.5
_USER = "[A-Za-z0-9._%+-]"


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    score: float
    words: str  # a pattern of context words, over lower-case text
    base: bool = True


KINDS = (
    Kind("email", rf"(?:\G|(?<!{_USER})){_USER}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", 0.8, r"mail|contact|kontakt|correo|courriel"),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", 0.5, r"\bip\b|address|host|server|adresse"),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", 0.6, r"card|visa|credit|karte|carte|tarjeta"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", 0.6, r"phone|call|tel|mobile|fax"),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", 0.6, r"iban|account|konto|compte|cuenta", False),
    Kind("ssn", r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])", 0.2, r"\bssn\b|social security", False),
)
_OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"


def _mod97(code: Column) -> Column:
    """An IBAN without spaces, read as a number with its first four characters last, modulo 97."""
    turned = F.concat(F.substring(code, 5, 64), F.substring(code, 1, 4))
    values = F.transform(F.split(turned, ""), lambda c: F.when(c.rlike("^[0-9]$"), F.ascii(c) - 48).when(c.rlike("^[A-Z]$"), F.ascii(c) - 55))
    return F.aggregate(
        F.filter(values, lambda v: v.isNotNull()),
        F.lit(0),
        lambda acc, v: F.when(v > 9, (acc * 100 + v) % 97).otherwise((acc * 10 + v) % 97),
    )


def _valid(kind: str, m: Column) -> Column:
    digits = F.regexp_replace(m, "[^0-9]", "")
    if kind == "ip":
        return m.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")
    if kind == "card":
        return F.length(digits).between(14, 19) & F.coalesce(F.call_function("luhn_check", digits), F.lit(False))
    if kind == "phone":
        return F.length(digits).between(10, 15)
    if kind == "iban":
        code = F.replace(m, F.lit(" "), F.lit(""))
        return F.length(code).between(15, 34) & (_mod97(code) == 1)
    return F.lit(True)


def _validator(kind: str):
    return lambda m: _valid(kind, m)


def _wanted(kind: str, t: Column) -> Column | None:
    """A cheap test that every text with a span of the kind passes."""
    if kind == "email":
        return F.contains(t, F.lit("@"))
    if kind == "phone":
        return F.contains(t, F.lit("+"))
    if kind == "ssn":  # only its context words lift it over MIN_SCORE; they can stand on either side of the match, so one of them must do here
        return F.contains(F.lower(t), F.lit("ssn")) | F.contains(F.lower(t), F.lit("social"))
    return None


_SPAN = "struct<start:int,rank:int,end:int,kind:string,match:string,score:double>"


def _placed(rank: int, kind: Kind, t: Column, matches: Column, pieces: Column) -> Column:
    """The valid matches of a kind with their places and scores."""

    def step(acc: Column, i: Column) -> Column:
        m = F.get(matches, i)
        start = acc["at"] + F.length(F.get(pieces, i))
        end = start + F.length(m)
        span = F.struct(start.alias("start"), F.lit(rank).alias("rank"), end.alias("end"), F.lit(kind.name).alias("kind"), m.alias("match"), F.lit(kind.score).alias("score"))
        return F.struct(end.alias("at"), F.when(_valid(kind.name, m), F.array_append(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    zero = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{_SPAN}>").alias("spans"))
    spans = F.aggregate(F.sequence(F.lit(0), F.size(matches) - 1), zero, step)["spans"]

    def scored(s: Column) -> Column:
        first = F.greatest(s["start"] - CONTEXT, F.lit(0))
        near = F.lower(F.concat(t.substr(first + 1, s["start"] - first), F.lit(" "), t.substr(s["end"] + 1, F.lit(CONTEXT))))
        return s.withField("score", s["score"] + F.when(near.rlike(kind.words), F.lit(CONTEXT_BONUS)).otherwise(F.lit(0.0)))

    return F.filter(F.transform(spans, scored), lambda s: s["score"] >= MIN_SCORE)


def with_spans(docs: DataFrame, text: str = "text", out: str = "spans") -> DataFrame:
    """Adds `out`: the spans of all kinds, by start and then kind. Columns p_* are taken while it works."""
    t = F.col("p_text")
    df = docs.withColumn("p_text", F.coalesce(F.col(text).cast("string"), F.lit("")))
    for k in KINDS:
        found = F.regexp_extract_all(t, F.lit(k.pattern), F.lit(0))
        wanted = _wanted(k.name, t)
        df = df.withColumn(f"p_m_{k.name}", found if wanted is None else F.when(wanted, found).otherwise(F.array().cast("array<string>")))
    for k in KINDS:  # the second pass is for texts with a valid match alone
        some = F.exists(f"p_m_{k.name}", _validator(k.name))
        df = df.withColumn(f"p_p_{k.name}", F.when(some, F.split(t, k.pattern, -1)))
    none = F.array().cast(f"array<{_SPAN}>")
    spans = [F.when(F.col(f"p_p_{k.name}").isNotNull(), _placed(r, k, t, F.col(f"p_m_{k.name}"), F.col(f"p_p_{k.name}"))).otherwise(none) for r, k in enumerate(KINDS)]
    df = df.withColumn(out, F.array_sort(F.concat(*spans)))
    return df.select(*docs.columns, out)


def _named(docs: DataFrame) -> tuple[DataFrame, str]:
    """The frame with columns c0, c1, ...: its own names cannot clash with the ones used here."""
    own = [f"c{i}" for i in range(len(docs.columns))]
    return docs.toDF(*own), own[docs.columns.index("text")]


def listed(spans: Column) -> Column:
    """kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def find(docs: DataFrame) -> DataFrame:
    """doc_id and spans (start, rank of the kind, end, kind, match, score)."""
    return with_spans(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).select("doc_id", "spans")


def redacted(docs: DataFrame) -> DataFrame:
    """The documents with <KIND> in place of each span (overlapping spans go together, under the first one's kind); n_chars follows where there is one."""
    df, text = _named(docs)
    df = with_spans(df, text, "p_spans")
    t = F.col(text)

    def step(acc: Column, s: Column) -> Column:
        cut = F.concat(acc["out"], t.substr(acc["at"] + 1, s["start"] - acc["at"]), F.lit("<"), F.upper(s["kind"]), F.lit(">"))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(s["start"] >= acc["at"], cut).otherwise(acc["out"]).alias("out"))

    folded = F.aggregate("p_spans", F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step)
    df = df.withColumn("p_cut", F.when(F.size("p_spans") > 0, folded))
    cut = F.col("p_cut")
    new = F.when(cut.isNotNull(), F.concat(cut["out"], t.substr(cut["at"] + 1, F.length(t)))).otherwise(t)
    cols = {c: F.col(f"c{i}") for i, c in enumerate(docs.columns)}
    cols["text"] = new
    if "n_chars" in cols:
        cols["n_chars"] = F.when(cut.isNotNull(), F.length(new)).otherwise(cols["n_chars"]).cast(docs.schema["n_chars"].dataType)
    return df.select(*[c.alias(name) for name, c in cols.items()])
