"""Look-alikes within a Hamming radius against all pairs; connected components against a loop."""

import random

import pytest

from medialoom.operators import lookalikes
from medialoom.operators.components import components


def brute_components(nodes, linked):
    label = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in linked:
            m = min(label[a], label[b])
            if label[a] != m or label[b] != m:
                label[a] = label[b] = m
                changed = True
    return label


@pytest.mark.parametrize("kind", ["random", "star"])
def test_components(spark, kind):
    r = random.Random(4)
    edges = {"random": [(r.randint(-50, 200), r.randint(-50, 200)) for _ in range(130)], "path": [(i, i + 1) for i in range(60)], "star": [(1000, i) for i in range(300)] + [(1, 1)], "none": [(5, 5)]}[kind]
    got = {x["node"]: x["component"] for x in components(spark.createDataFrame(edges + edges[:3], "a long, b long")).collect()}
    real = [e for e in edges if e[0] != e[1]]
    assert got == brute_components({n for e in real for n in e}, real)


def hashes(seed, n):
    r = random.Random(seed)
    base = [r.getrandbits(64) for _ in range(12)]
    out = [0, 1, 2**63, 2**64 - 1, 3]
    for _ in range(n):
        h = r.choice(base)
        for _ in range(r.randint(0, 5)):
            h ^= 1 << r.randrange(64)
        out.append(h)
    return [h - 2**64 if h >= 2**63 else h for h in out]


@pytest.mark.parametrize("radius, block", [(2, 3), (4, 8)])
def test_near_hashes(spark, monkeypatch, radius, block):
    """Small blocks make slices, and pairs of slices, hot."""
    monkeypatch.setattr(lookalikes, "BLOCK", block)
    own = sorted(set(hashes(radius + block, 150)))
    near = [(a, b) for i, a in enumerate(own) for b in own[:i] if bin((a ^ b) & (2**64 - 1)).count("1") <= radius]
    want = brute_components({n for e in near for n in e}, near)
    got = {x["node"]: x["component"] for x in lookalikes.near_hashes(spark.createDataFrame([(h,) for h in own], "h long").repartition(3), radius).collect()}
    assert got == want


def test_look_alikes_keep_one(spark):
    rows = [(1, 0b0111, 10, 5, None, 0), (2, 0b0101, 30, 5, None, 0), (3, 0b1101, 30, 6, None, 0), (4, 1 << 40, 9, 1, None, 0), (5, 0, 9, 1, None, 0), (6, None, 9, 1, None, 0), (7, 0b0101, 99, 9, 1, 0), (8, 0b0101, 99, 9, None, 1), (9, 0, 9, 1, None, 0)]
    m = spark.createDataFrame(rows, "id long, dhash long, bytes long, mtime long, deleted long, missing int")
    got = {r["id"]: (r["look"], r["keep"], r["n"], r["freed"]) for r in lookalikes.look_alikes(m, 1).collect()}
    assert got == {1: (5, False, 3, 40), 2: (5, False, 3, 40), 3: (5, True, 3, 40)}
    assert lookalikes.look_alikes(m.limit(0), 1).count() == 0
    with pytest.raises(ValueError):
        lookalikes.near_hashes(m.withColumnRenamed("dhash", "h"), 40)
