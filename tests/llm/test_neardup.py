import random
from collections import Counter, defaultdict

import pytest

from cutgraph.llm import neardup

SCHEMA = "doc_id long, text string, n_shingles string"


def brute(rows, width):
    """Components by counting shared shingles of every pair that shares any."""
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        if w:
            sets[i] = frozenset(zip(*(w[k:] for k in range(width)), strict=False)) if len(w) >= width else frozenset([tuple(w)])
    root = {i: i for i, _ in rows}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    seen = defaultdict(list)
    for i, s in sets.items():
        shared = Counter(j for x in s for j in seen[x])
        for j, n in shared.items():
            if 100 * n >= 80 * (len(s) + len(sets[j]) - n):
                a, b = top(i), top(j)
                root[max(a, b)] = min(a, b)
        for x in s:
            seen[x].append(i)
    return {i: (len(sets.get(i, ())), top(i)) for i, _ in rows}


def run(spark, rows, width=2):
    out = neardup.near_duplicates(spark, spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA), width).collect()
    assert all(r.kept == (r.doc_id is None or r.doc_id == r.component_id) for r in out)
    return out


@pytest.mark.parametrize(("seed", "width"), [(0, 2), (1, 5)])
def test_families_against_brute_force(spark, seed, width):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = []
    for family in range(12):
        n = r.choice([3, 8, 25, 60, 150])
        base = [r.choice(vocabulary if family % 3 else vocabulary[:25]) for _ in range(n)]
        for _ in range(r.choice([1, 5, 40])):
            words = [w if r.random() > r.choice([0, 0.02, 0.05, 0.1]) else r.choice(vocabulary) for w in base]
            rows.append((len(rows), " ".join(words)))
    r.shuffle(rows)
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in run(spark, rows, width)}
    assert got == brute(rows, width)


def test_blocks_smaller_than_a_group(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 500)
    monkeypatch.setattr(neardup, "CROWD", 7)
    r = random.Random(3)
    base = [f"b{i}" for i in range(80)]
    rows = [(i, " ".join(w if r.random() > 0.07 else f"x{r.randint(0, 10**6)}" for w in base)) for i in range(80)]
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in run(spark, rows)}
    assert got == brute(rows, 2)
    assert 1 < len({c for _, c in got.values()}) < 80


def test_common_passage_does_not_link(spark):
    r = random.Random(4)
    passage = [f"p{i}" for i in range(60)]
    rows = [(i, " ".join([*passage, *(f"u{i}x{j}" for j in range(r.randint(20, 60)))])) for i in range(150)]
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in run(spark, rows)}
    assert got == brute(rows, 2)


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, "One"), (4, "one"), (5, "ÉCOLE a"), (6, "école A"), (7, "a b a b a b"), (8, "a b a"), (9, "x " * 40_000), (10, "x x"), (11, "p q r s t u"), (11, "k l m n o"), (12, "P Q R S T U"), (13, "k l m n o"), (None, "one"), (14, "zz"), (14, "zz")]
    out = run(spark, rows)
    assert len(out) == len(rows)
    by = {x.doc_id: x.component_id for x in out}
    assert (by[3], by[4]) == (3, 3) and (by[5], by[6]) == (5, 6) and (by[7], by[8]) == (7, 7) and (by[9], by[10]) == (9, 9)
    assert (by[11], by[12], by[13]) == (11, 11, 11) and by[None] is None and (by[1], by[2], by[14]) == (1, 2, 14)
    assert {(x.doc_id, x.n_shingles) for x in out} >= {(1, 0), (2, 0), (3, 1), (7, 2), (9, 1)}


def test_empty(spark):
    assert run(spark, []) == []


def test_stage_keeps_one_of_each_group(spark):
    rows = [(1, "a b c d e f g h i j", "x"), (2, "a b c d e f g h i j", "y"), (3, "other text that stands alone here", "z"), (None, "a b c d e f g h i j", None)]
    kept = neardup.deduplicated(spark, spark.createDataFrame(rows, "doc_id long, text string, component_id string")).collect()
    assert sorted(str(r.doc_id) for r in kept) == ["1", "3", "None"] and {r.component_id for r in kept} == {"x", "z", None}
