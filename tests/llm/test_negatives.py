"""Hard negatives against brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cutgraph.llm import negatives

SCHEMA = "vec_id long, label int, embedding array<float>"


def plainly(rows, step=50, positives=5, most=3, low=50, high=95):
    known = {}
    for i, label, v in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        if i not in known or (label, v) < known[i]:
            known[i] = (label, v)
    whole = {i: (label, [math.floor(256 * x) for x in v]) for i, (label, v) in known.items()}
    out = []
    for a, (label, v) in whole.items():
        if a % step:
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w, strict=False)), i) for i, (_, w) in whole.items() if i != a)
        for s, p in [(s, i) for s, i in scored if whole[i][0] == label][:positives]:
            hard = [(i, -t) for t, i in scored if whole[i][0] != label and low * -s <= 100 * -t <= high * -s][:most]
            out += [(a, p, r, i, -s, t) for r, (i, t) in enumerate(hard, 1)]
    return sorted(out)


def made(seed, n, dim=6, labels=4, coarse=4):
    """Few different components, so that ties are many."""
    r = random.Random(seed)
    return [(i, r.randrange(labels), [r.randrange(-coarse, coarse + 1) / 8 for _ in range(dim)]) for i in range(n)]


def mined(spark, rows, step=50, schema=SCHEMA, **more):
    df = spark.createDataFrame(rows, schema)
    return sorted(tuple(r) for r in negatives.mine_hard_negatives(spark, df, F.col("vec_id") % step == 0, **more).collect())


def test_against_brute_force_with_ties(spark):
    rows = made(1, 400)
    got = mined(spark, rows, 20)
    assert got == plainly(rows, 20) and len(got) > 100


def test_tiles_agree_with_one(spark, monkeypatch):
    rows = made(2, 300)
    monkeypatch.setattr(negatives, "ROWS", 37)
    monkeypatch.setattr(negatives, "ANCHORS", 11)
    monkeypatch.setattr(negatives, "AT_ONCE", 4)
    assert mined(spark, rows, 5) == plainly(rows, 5)


def test_a_hot_label_and_few_of_another(spark):
    rows = [(i, 1 if i % 9 else 2, v) for i, _, v in made(3, 200)] + [(1000, 3, [0.5] * 6)]
    got = mined(spark, rows, 10)
    assert got == plainly(rows, 10) and not any(r[0] == 1000 for r in got)


def test_rows_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = made(4, 120) + [(None, 1, [0.5] * 6), (200, None, [0.5] * 6), (201, 1, None), (202, 1, [0.5, None] + [0.5] * 4), (203, 1, [nan] * 6), (204, 2, [inf] * 6), (205, 2, [-inf] * 6)]
    assert mined(spark, rows, 10) == plainly(rows, 10)


def test_repeated_ids_other_columns_and_lengths(spark):
    base = made(5, 150)
    r = random.Random(5)
    rows = base + base[:30] + [(i, 0, v) for i, _, v in base[40:60]] + [(i, label, v[: r.randrange(7)]) for i, label, v in made(6, 80)[70:]]
    df = spark.createDataFrame([(*x, 1, 2) for x in rows], SCHEMA + ", rank int, anchor_id int")
    got = sorted(tuple(x) for x in negatives.mine_hard_negatives(spark, df, F.col("vec_id") % 10 == 0).collect())
    assert got == plainly(rows, 10)


def test_a_third_of_the_rows_are_one_id(spark):
    rows = made(7, 100) + [(50, 1, [0.25] * 6)] * 60
    assert mined(spark, rows, 10) == plainly(rows, 10)


def test_empty_tables(spark):
    assert mined(spark, []) == []
    assert mined(spark, made(8, 40)[1:]) == []  # no anchor
    assert mined(spark, [(0, 1, [1.0])]) == []
    assert mined(spark, [(0, 1, []), (1, 1, []), (2, 2, [])]) == plainly([(0, 1, []), (1, 1, []), (2, 2, [])])


def test_large_components_are_exact(spark):
    rows = [(0, 1, [1e6, 1e6]), (1, 1, [1e6, 1e6]), (2, 2, [1e6, 0.7e6]), (3, 2, [1e6, 0.7e6 + 1 / 256]), (4, 2, [1e6, 0.9e6 - 1 / 256]), (50, 1, [1.0, 2.0])]
    got = mined(spark, rows, schema="vec_id long, label int, embedding array<double>")
    assert got == plainly(rows) and max(r[4] for r in got) > 2**53
    beyond = mined(spark, [(0, 1, [3e30, 1.0]), (1, 1, [3e30, 2.0]), (2, 2, [1.0, 1.0])], schema="vec_id long, label int, embedding array<double>", low=0)
    assert beyond == []  # the negative has 7e33, held at the end of a long like the positive
    assert negatives.scores(np.array([[3e30, 1.0]]), np.array([[2.0, 1.0]])).tolist() == [[2 * int(3e30) + 1]]


@pytest.mark.parametrize("score", [-7, 0, 1, 99, 100, 10**17])
def test_limits(score):
    least, largest = negatives.limits(score, 50, 95)
    for s in (least - 1, least, largest, largest + 1):
        assert (least <= s <= largest) == (50 * score <= 100 * s <= 95 * score)
