import random

import pytest

PROSE = "the cat sat on a mat and the dog of the house ran to it with that is was for one two three".split()


def prose(n: int, seed: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(PROSE) + str(r.randint(0, 40)) for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty, very long and repeated texts, exact and near copies, repeated and null ids."""
    long = prose(30_000, 1)
    base = prose(120, 2)
    rows = [
        (1, base), (2, base), (3, base.replace("cat", "CAT", 1)), (4, base + " extra words at the end"), (5, prose(120, 3)), (6, None), (7, ""), (8, " \t\n "), (9, "word"), (10, "one two three"),
        (11, long), (12, "start " + long), (None, "null id " + base), (13, "same row"), (13, "same row"), (14, "one id"), (14, "two texts of one id"), (15, "\n".join([base, base, prose(60, 4), base])),
        (16, "Ünïcödé ñandú 漢字 😀 ﬁ <|endoftext|> x y"), (17, prose(19, 5)), (18, prose(19, 5)), (19, prose(20, 6)), (20, prose(20, 6)), (21, "A B C D " * 30),
    ]
    return rows


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    """The rows as a frame, with columns of clashing names."""
    rows = [(text, i, "x", 0, b"k", ["s"]) for i, text in odd_rows]
    return spark.createDataFrame(rows, "text string, doc_id long, shard string, n_words int, digest binary, spans array<string>").repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
