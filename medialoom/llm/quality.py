"""Quality rules: a threshold table compiled into one Spark projection.

Every metric is a built-in expression over the whole text and every rule a comparison
with a row of RULES, so a document is judged inside one projection: no shuffle, no user
function, no state between rows.  The cost of a row is O(n log n) in its words (a sort of
its 3-word windows), also when most windows repeat.

Defined results: a null text is a text without words (n_words 0, base_failed, not kept);
rows repeated in the input are judged one by one; an empty table gives an empty table;
very long texts are judged whole; columns other than doc_id and text pass through `filtered`
untouched, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Frequent function words of English, French, German and Spanish.
STOP_WORDS = (
    "the and of to in is was that it for on with as at this from by be are or an not "
    "le la les de des du et en un une est que dans pour qui au sur pas avec "
    "der die das und ist mit den von zu ein eine für auf dem im nicht sich als auch "
    "el los las del y que es por una con para al su se no lo como más"
).split()


@dataclass(frozen=True)
class Rule:
    """A document passes if low <= metric <= high (None: no bound)."""

    name: str
    metric: str
    low: float | None
    high: float | None


#: The threshold table. Ratios are by word unless they say otherwise.
RULES = (
    Rule("too_few_words", "n_words", 50, None),
    Rule("repeated_windows", "repeat_ratio", None, 0.5),
    Rule("mean_word_length", "mean_word_chars", 2, 15),
    Rule("symbols", "symbol_ratio", None, 0.1),
    Rule("stop_words", "n_stop_words", 2, None),
    Rule("duplicate_lines", "dup_line_ratio", None, 0.6),
    Rule("capitals_by_char", "capital_ratio", None, 0.5),
)
BASE = ("too_few_words", "repeated_windows")


def _repeat_words(words: Column) -> Column:
    """How many words lie in 3-word windows that the text holds twice or more.

    Windows are 64-bit hashes; where any repeats, (hash, position) pairs are sorted, the
    positions whose neighbour has the same hash are kept and sorted again, and each adds
    its three words less the overlap with the one before.
    """
    n = F.size(words)
    windows = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))
    return F.when(n >= 3, windows)


def metrics(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds q_* columns: counts and ratios of each whole text."""
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    words = F.array_remove(F.split(t, r"[ \t\n\x0B\f\r]+", -1), "")
    df = docs.withColumn("q_words", words)
    df = df.withColumn("q_windows", _repeat_words(F.col("q_words")))
    # (hash, position) pairs only where the distinct windows are fewer than the windows
    pairs = F.array_sort(F.transform(F.col("q_windows"), lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    repeats = F.size(F.array_distinct("q_windows")) < F.size("q_windows")
    df = df.withColumn("q_pairs", F.when(repeats, pairs))
    p = F.col("q_pairs")
    again = F.transform(
        F.filter(p, lambda x, k: (x["h"] == F.get(p, k + 1)["h"]) | (x["h"] == F.get(p, k - 1)["h"])),
        lambda x: x["i"],
    )
    df = df.withColumn("q_at", F.sort_array(F.filter(again, lambda i: i.isNotNull())))
    at = F.col("q_at")
    gaps = F.transform(at, lambda i, k: F.least(F.lit(3), F.coalesce(F.get(at, k + 1) - i, F.lit(3))))
    n_repeat = F.when(at.isNull(), F.lit(0)).otherwise(F.aggregate(gaps, F.lit(0), lambda a, x: a + x))
    df = df.withColumn("q_lines", F.filter(F.split(t, "\n", -1), _has_word))
    return df.select(
        *[F.col(c) for c in docs.columns],
        F.size("q_words").cast("long").alias("q_n_words"),
        F.length(F.array_join("q_words", "")).cast("long").alias("q_word_chars"),
        (F.length(t) - F.length(F.regexp_replace(t, r"[#*$%&|<>]+", ""))).cast("long").alias("q_n_symbols"),
        n_repeat.cast("long").alias("q_n_repeat_words"),
        F.size("q_lines").cast("long").alias("q_n_lines"),
        F.size(F.array_distinct("q_lines")).cast("long").alias("q_n_own_lines"),
        F.size(F.array_intersect(F.transform("q_words", F.lower), F.array(*[F.lit(w) for w in dict.fromkeys(STOP_WORDS)]))).cast("long").alias("q_n_stop_words"),
        (F.length(t) - F.length(F.regexp_replace(t, r"[A-Z]+", ""))).cast("long").alias("q_n_capitals"),
    )


def _has_word(line: Column) -> Column:
    return line.rlike(r"[^ \t\x0B\f\r]")


def _value(metric: str) -> Column:
    n = F.greatest(F.col("q_n_words"), F.lit(1)).cast("double")
    return {
        "n_words": F.col("q_n_words").cast("double"),
        "repeat_ratio": F.col("q_n_repeat_words") / n,
        "mean_word_chars": F.col("q_word_chars") / n,
        "symbol_ratio": F.col("q_n_symbols") / n,
        "n_stop_words": F.col("q_n_stop_words").cast("double"),
        "dup_line_ratio": (F.col("q_n_lines") - F.col("q_n_own_lines")) / F.greatest(F.col("q_n_lines"), F.lit(1)).cast("double"),
        "capital_ratio": F.col("q_n_capitals") / F.greatest(F.col("q_word_chars"), F.lit(1)).cast("double"),
    }[metric]


def compile_rules(rules: tuple[Rule, ...] = RULES) -> dict[str, Column]:
    """For each rule of the table, the column that is true where a document breaks it."""
    out = {}
    for r in rules:
        v, broken = _value(r.metric), F.lit(False)
        if r.low is not None:
            broken = broken | (v < F.lit(float(r.low)))
        if r.high is not None:
            broken = broken | (v > F.lit(float(r.high)))
        out[r.name] = broken
    return out


def judged(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """The input's columns, the q_* metrics, q_broken (names of broken rules) and q_kept."""
    cols = compile_rules(rules)
    df = metrics(docs, text)
    broken = F.filter(F.array(*[F.when(c, F.lit(name)) for name, c in cols.items()]), lambda x: x.isNotNull())
    return df.withColumn("q_broken", broken).withColumn("q_kept", F.size("q_broken") == 0)


def quality_report(docs: DataFrame) -> DataFrame:
    """One row per document: counts, base verdict, the method's verdict and the rules it breaks."""
    df = judged(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    n, rep = F.col("q_n_words"), F.col("q_n_repeat_words")
    base = (n < 50) | (100 * rep > 50 * n)
    return df.select(
        "doc_id",
        n.alias("n_words"),
        F.col("q_word_chars").alias("word_chars"),
        F.col("q_n_symbols").alias("n_symbols"),
        (F.col("q_n_lines") - F.col("q_n_own_lines")).alias("n_dup_lines"),
        rep.alias("n_repeat_words"),
        base.alias("base_failed"),
        (~base & F.col("q_kept")).alias("kept"),
        F.array_join("q_broken", ",").alias("broken"),
    )


def filtered(docs: DataFrame) -> DataFrame:
    """The documents that pass all rules, with their own columns alone."""
    own = [f"c{i}" for i in range(len(docs.columns))]  # other columns can be called anything, q_kept included
    named = docs.toDF(*own)
    text = own[docs.columns.index("text")]
    # The row number is always >= 0.  As it is not deterministic, the filter stays above the projection;
    # pushed below, it would hold every metric's expression again, nested, for each use of it.
    df = judged(named, text=text).withColumn("q_row", F.monotonically_increasing_id())
    return df.filter(F.col("q_kept") & (F.col("q_row") >= 0)).select(*own).toDF(*docs.columns)
