"""Exact scores in residues, and hard negatives against plain loops and SQL."""

import math
import random

import numpy as np
import pytest

from oracle import DATA, compare, connect
from tidemark.llm import negatives, queries


@pytest.mark.parametrize("width, top", [(1, 3), (64, 200), (64, 2**26), (700, 2**24), (2500, 2**23), (3, 2**28)])
def test_products_are_exact(width, top):
    rng = np.random.default_rng(width)
    a, b = (rng.integers(-top, top, (n, width)) for n in (7, 9))
    a[0], b[0], b[1] = top, top, -top  # the extremes of the bound
    bound = int(max((x.astype(object) ** 2).sum(axis=1).max() for x in (a, b)))
    primes = negatives.primes_for(width, bound)
    assert len(set(primes)) == len(primes) and math.prod(primes) > 2 * bound
    assert all((p // 2) ** 2 * min(width, negatives.SPAN) <= negatives.EXACT for p in primes)
    got = negatives.products([negatives.residues(a, p) for p in primes], [negatives.residues(b, p) for p in primes], primes)
    assert (got.astype(object) == a.astype(object) @ b.T.astype(object)).all()


def brute(rows, every=7, anchors=100):
    v = []
    for vec_id, label, x in rows:
        if label is None or x is None or any(y is None or not math.isfinite(y) for y in x):
            continue
        q = [math.floor(256 * y) for y in x]
        if sum(y * y for y in q) < 2**60:
            v.append((vec_id, (label + 1) % 10 if vec_id is not None and vec_id % every == 0 else label, q))
    out = []
    last = lambda s: (-s[1], s[0] is None, s[0] or 0)
    for vec_id, label, q in v:
        if vec_id is None or vec_id % anchors:
            continue
        score = [(i, sum(a * b for a, b in zip(q, r)), same == label) for i, same, r in v if i != vec_id]
        for positive, p, _ in sorted((s for s in score if s[2]), key=last)[:5]:
            found = sorted((s for s in score if not s[2] and 80 * p <= 100 * s[1] <= 100 * p), key=last)[:5]
            out += [(vec_id, positive, k + 1, i, p, n) for k, (i, n, _) in enumerate(found)]
    return sorted(map(str, out))


def rows(rng, n, width, copies=0):
    out = [(i, rng.randrange(10), [rng.uniform(-1, 1) + 0.3 for _ in range(width)]) for i in range(n)]
    same = [0.25] * width
    out += [(n + i, rng.randrange(10), same) for i in range(copies)]
    return out


SCHEMA = "vec_id long, label int, embedding array<float>, q string, row string"


def mined(spark, rows):
    d = spark.createDataFrame([(i, y, [None if z is None else float(np.float32(z)) for z in x] if x is not None else None, "x", "y") for i, y, x in rows], SCHEMA)
    return sorted(str(tuple(r)) for r in negatives.hard_negatives(negatives.relabelled(negatives.prepared(d))).collect())


def narrow(rows):
    return [(i, y, None if x is None else [None if z is None else float(np.float32(z)) for z in x]) for i, y, x in rows]


@pytest.mark.parametrize("case", ["plain", "copies", "odd", "wide", "huge", "blocks"])
def test_hard_negatives_equal_brute_force(spark, monkeypatch, case):
    """Ties, groups of copies, odd rows, long vectors, large numbers, many blocks; clashing column names in all."""
    rng = random.Random(case)
    r = rows(rng, 300, 8)
    if case == "copies":
        r = rows(rng, 150, 4, copies=260)
    if case == "odd":
        r += [(None, 1, [0.5] * 8), (400, None, [0.5] * 8), (500, 2, None), (600, 3, [0.1, None] * 4), (700, 3, [float("nan")] * 8), (800, 3, [float("inf")] * 8)]
        r += [(900, 4, []), (1000, 4, [0.5] * 3), (None, 4, [0.5] * 8), (1100, 4, [1e30] * 8), (1100, 5, [0.4] * 8), (1100, 5, [0.4] * 8), (100, 5, [0.4] * 8)]
    if case == "wide":
        r = rows(rng, 210, 1500)
    if case == "huge":
        r = [(i, y, [z * 2.0**17 for z in x]) for i, y, x in r]
    if case == "blocks":
        for name, value in (("ANCHOR_BYTES", 4 * 8), ("ROW_BYTES", 4 * 8 * 40)):
            monkeypatch.setattr(negatives, name, value)
    want = brute(narrow(r))
    assert mined(spark, r) == want and want


def test_no_rows_and_one_label(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(100, 1, [1.0])]) == []
    assert mined(spark, [(100, 1, [1.0]), (101, 1, [1.0]), (102, 1, [2.0])]) == []


def test_query_equals_sql(spark):
    sf = f"{DATA}/sf0.001"
    got = queries.QUERIES["op13_rns_hard_negatives"](spark, sf).toPandas()
    assert compare(got, connect(sf).sql(queries.SQL["op13_rns_hard_negatives"]).df()) is None and len(got)
