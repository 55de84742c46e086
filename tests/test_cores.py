"""Order-dependent cores against plain or brute-force versions."""

import itertools
import math
import random
import time

import numpy as np
import pytest

from cutgraph.operators import clusters, tracking
from cutgraph.operators import sequential as seq

S = 1_000_000


def test_tracks_begin_go_on_and_end():
    box = (0.0, 0.0, 10.0, 10.0, 0.9)
    assert tracking.tracks([[box], [box], [(1.0, 0.0, 11.0, 10.0, 0.3)]]) == [(0, 0, 0), (1, 0, 0), (2, 0, 0)]
    assert tracking.tracks([[box], [box]]) == [] == tracking.tracks([])
    faint = (0.0, 0.0, 10.0, 10.0, 0.5)
    assert tracking.tracks([[faint]] * 5) == []  # a faint box begins no track
    gone = [[box]] * 4 + [[]] * 31 + [[box]] * 3
    assert {t for *_, t in tracking.tracks(gone)} == {0, 1} and {t for *_, t in tracking.tracks(gone[:4] + gone[5:])} == {0}  # 30 frames without a box are survived, 31 aren't
    far = [[box]] * 5 + [[(40.0, 0.0, 50.0, 10.0, 0.9)]] * 3
    assert {t for *_, t in tracking.tracks(far)} == {0, 1}


def test_crossing_boxes_keep_their_ids_through_an_occlusion():
    frames, who = [], []
    for f in range(60):
        a, b = (3.0 * f, 50.0, 3.0 * f + 20, 80.0, 0.9), (181 - 3.0 * f, 56.0, 201 - 3.0 * f, 86.0, 0.3 if 24 <= f < 28 else 0.8)
        pair = [("a", a), ("b", b)] if f % 2 else [("b", b), ("a", a)]
        pair = [p for p in pair if not (p[0] == "b" and 28 <= f < 33)]  # hidden as they cross
        frames.append([box for _, box in pair])
        who.append([name for name, _ in pair])
    ids = {}
    for f, i, t in tracking.tracks(frames):
        ids.setdefault(who[f][i], set()).add(t)
    assert len(ids["a"]) == len(ids["b"]) == 1 and ids["a"] != ids["b"]
    assert len(tracking.tracks(frames)) == sum(map(len, frames))


def test_kalman_filter_against_scalar_sums():
    """Mean and covariance after steps, by sums over indices."""
    r = random.Random(1)
    k = tracking.Kalman(np.array([5.0, 5.0, 1.0, 10.0]))
    mean, cov = [5.0, 5.0, 1.0, 10.0, 0, 0, 0, 0], [[0.0] * 8 for _ in range(8)]
    for i, x in enumerate((1, 1, 1e-2, 1, 0.625, 0.625, 1e-5, 0.625)):
        cov[i][i] = x * x
    mul = lambda a, b: [[sum(x * y for x, y in zip(row, col, strict=True)) for col in zip(*b, strict=True)] for row in a]
    move = [[float(i == j or j == i + 4) for j in range(8)] for i in range(8)]
    for _ in range(5):
        h = mean[3]
        noise = [h / 20, h / 20, 1e-2, h / 20, h / 160, h / 160, 1e-5, h / 160]
        mean = [sum(m * x for m, x in zip(row, mean, strict=True)) for row in move]
        cov = mul(mul(move, cov), [list(c) for c in zip(*move, strict=True)])
        for i in range(8):
            cov[i][i] += noise[i] ** 2
        k.predict()
        z = [r.uniform(4, 8), r.uniform(4, 8), r.uniform(0.8, 1.2), r.uniform(9, 11)]
        seen = [[cov[i][j] + (i == j) * [mean[3] / 20, mean[3] / 20, 1e-1, mean[3] / 20][i] ** 2 for j in range(4)] for i in range(4)]
        inverse = np.linalg.inv(np.array(seen)).tolist()
        d = [a - b for a, b in zip(z, mean[:4], strict=True)]
        assert k.distance(np.array(z)) == pytest.approx(sum(d[i] * inverse[i][j] * d[j] for i in range(4) for j in range(4)))
        gain = mul([row[:4] for row in cov], inverse)
        mean = [m + sum(g * x for g, x in zip(row, d, strict=True)) for m, row in zip(mean, gain, strict=True)]
        less = mul(gain, [row[:] for row in cov[:4]])
        cov = [[a - b for a, b in zip(x, y, strict=True)] for x, y in zip(cov, less, strict=True)]
        k.update(np.array(z))
        assert np.allclose(k.mean, mean) and np.allclose(k.cov, cov)


def test_kalman_filter_is_cheap():
    """Three times as fast at least as steps with matrices of 8 x 8, which it was."""
    move, seen, z = np.eye(8) + np.eye(8, k=4), np.eye(4, 8), (5.0, 5.0, 1.0, 10.0)

    def by_matrices():
        mean, cov = np.concatenate([z, np.zeros(4)]), np.eye(8)
        for _ in range(500):
            mean, cov = move @ mean, move @ cov @ move.T + np.diag(np.square([0.5] * 8))
            some = cov[:4, :4] + np.diag(np.square([0.5] * 4))
            gain = np.linalg.solve(some, seen @ cov).T
            mean, cov = mean + gain @ (np.array(z) - mean[:4]), cov - gain @ some @ gain.T

    def by_filter():
        k = tracking.Kalman(z)
        for _ in range(500):
            k.predict()
            k.update(z)

    def least(f):
        took = []
        for _ in range(3):
            begun = time.thread_time()
            f()
            took.append(time.thread_time() - begun)
        return min(took)

    assert 3 * least(by_filter) < least(by_matrices)


def average(vectors, stop):
    groups = [[i] for i in range(len(vectors))]
    unit = [[x / math.sqrt(sum(y * y for y in v)) for x in v] for v in vectors]
    d = [[1 - sum(x * y for x, y in zip(a, b, strict=True)) for b in unit] for a in unit]
    while len(groups) > 1:
        best, i, j = min((sum(d[x][y] for x in a for y in b) / (len(a) * len(b)), i, j) for i, a in enumerate(groups) for j, b in enumerate(groups) if i < j)
        if best >= stop:
            break
        groups[i] += groups.pop(j)
    return {frozenset(g) for g in groups}


def ward(vectors, k):
    groups = [[i] for i in range(len(vectors))]
    spread = lambda g: sum(sum((vectors[i][t] - sum(vectors[j][t] for j in g) / len(g)) ** 2 for t in range(len(vectors[0]))) for i in g)
    while len(groups) > k:
        _, i, j = min((spread(a + b) - spread(a) - spread(b), i, j) for i, a in enumerate(groups) for j, b in enumerate(groups) if i < j)
        groups[i] += groups.pop(j)
    return {frozenset(g) for g in groups}


def as_sets(labels):
    return {frozenset(i for i, x in enumerate(labels) if x == c) for c in set(labels)}


@pytest.mark.parametrize("seed", range(12))
def test_clusters_against_brute_force(seed):
    r = random.Random(seed)
    centres = [[r.gauss(0, 1) for _ in range(4)] for _ in range(3)]
    vectors = [[x + r.gauss(0, 0.4) for x in r.choice(centres)] for _ in range(r.randint(1, 22))]
    for stop in (0.05, 0.3, 0.5, 1.2):
        assert as_sets(clusters.agglomerated(vectors, stop)) == average(vectors, stop)
    tree = clusters.merges(vectors, "ward")
    for k in range(1, min(5, len(vectors)) + 1):
        assert as_sets(clusters.cut_tree(len(vectors), tree, clusters=k)) == ward(vectors, k)


def plain_silhouette(vectors, labels):
    dist = lambda a, b: math.sqrt(sum((x - y) ** 2 for x, y in zip(vectors[a], vectors[b], strict=True)))
    total = 0.0
    for i, c in enumerate(labels):
        own = [j for j, x in enumerate(labels) if x == c and j != i]
        if own:
            a = sum(dist(i, j) for j in own) / len(own)
            b = min(sum(dist(i, j) for j in o) / len(o) for o in ([j for j, x in enumerate(labels) if x == k] for k in set(labels) - {c}))
            total += (b - a) / max(a, b)
    return total / len(labels)


def test_speakers_by_silhouette():
    r = random.Random(3)
    for true in (2, 3, 4):
        vectors = [[10.0 * (c == t) + r.gauss(0, 0.3) for t in range(4)] for c in range(true) for _ in range(6)]
        labels, s = clusters.speakers(vectors)
        assert labels == [c for c in range(true) for _ in range(6)] and s == pytest.approx(plain_silhouette(vectors, labels))
        for k in (2, 3, 4):
            other = clusters.cut_tree(len(vectors), clusters.merges(vectors, "ward"), clusters=k)
            assert plain_silhouette(vectors, other) <= s + 1e-6
    assert clusters.speakers([]) is None and clusters.speakers([[1.0], [2.0]]) is None
    assert clusters.speakers([[1.0]] * 5)[0] is not None and clusters.agglomerated([]) == [] and clusters.agglomerated([[1, 0], [0, 1], [1, 0], [0.8, 0.6]]) == [0, 1, 0, 0]


def plain_peaks(v, distance, prominence):
    found = []
    for i, j in itertools.combinations_with_replacement(range(1, len(v) - 1), 2):
        if len(set(v[i : j + 1])) == 1 and v[i - 1] < v[i] > v[j + 1]:
            found.append((i + j) // 2)
    left = sorted(found, key=lambda p: (v[p], p), reverse=True)
    kept = []
    while left:
        best = left.pop(0)
        kept.append(best)
        left = [p for p in left if abs(p - best) >= distance]
    out = []
    for p in sorted(kept):
        a = next((k for k in range(p - 1, -1, -1) if v[k] > v[p]), -1)
        b = next((k for k in range(p + 1, len(v)) if v[k] > v[p]), len(v))
        if v[p] - max(min(v[a + 1 : p + 1]), min(v[p:b])) >= prominence:
            out.append(p)
    return out


@pytest.mark.parametrize("seed", range(60))
def test_peaks_against_plain_search(seed):
    r = random.Random(seed)
    v = [r.randrange(8) for _ in range(r.randrange(40))]
    for distance, prominence in ((1, 0), (1, 2), (4, 1), (10, 3)):
        assert seq.peaks(v, distance, prominence) == plain_peaks(v, distance, prominence)
    assert seq.smoothed([2.0] * 5) == pytest.approx([2.0] * 5) and seq.smoothed([]) == [] and seq.smoothed([3.0]) == pytest.approx([3.0])


def test_distinct_frames():
    frames = [{"id": i, "quality": q, "vector": v} for i, (q, v) in enumerate([(0.9, (1, 0)), (0.8, (0.99, 0.14)), (0.7, (0, 1)), (0.7, (0.6, 0.8)), (0.1, (-1, 0))])]
    assert [f["id"] for f in seq.distinct_frames(frames, 3)] == [0, 2, 3]
    assert [f["id"] for f in seq.distinct_frames(frames, 9)] == [0, 2, 3, 4] and seq.distinct_frames([], 3) == []


def plain_snap(t, silences, words, curve, window=400_000):
    near = [(s, -abs(u - t), -u) for u, s in curve if abs(u - t) <= window]
    if near and max(near)[0] >= 0 and abs(-max(near)[2] - t) > 50_000:
        return -max(near)[2]
    mids = [(a + b) // 2 for a, b in silences if b - a >= 300_000]
    mids = [m for m in mids if not any(a + 15_000 < m < b - 15_000 for a, b in words)]
    w = sorted(words)
    gaps = [(b + c) // 2 for (_, b), (c, _) in zip(w, w[1:], strict=False) if c - b >= 120_000]
    for targets in (mids, gaps, [x for p in words for x in p]):
        close = [(abs(x - t), x) for x in targets if abs(x - t) <= window]
        if close:
            return min(close)[1]
    return t


@pytest.mark.parametrize("seed", range(40))
def test_fixed_point_against_plain_ladder(seed):
    r = random.Random(seed)
    span = lambda most, longest: (a := r.randrange(0, most, 10_000), a + r.randrange(10_000, longest, 10_000))
    silences, words = [span(20 * S, 2 * S) for _ in range(6)], [span(20 * S, S) for _ in range(15)]
    curve = [(t, r.randrange(-3, 3)) for t in range(0, 20 * S, 500_000) if r.random() < 0.3]
    ladder = seq.Ladder(silences, words, curve)
    for t in range(0, 21 * S, 130_000):
        assert ladder.snap(t) == plain_snap(t, silences, words, curve)
    keeps = sorted(span(20 * S, 4 * S) for _ in range(5))
    for _ in range(5):
        merged = []
        for a, b in sorted(keeps):
            if merged and a - merged[-1][1] < 300_000:
                merged[-1] = (merged[-1][0], max(merged[-1][1], b))
            else:
                merged.append((a, b))
        long = [k for k in merged if k[1] - k[0] >= S] or [max(merged, key=lambda k: (k[1] - k[0], -k[0]))]
        new = [(plain_snap(a, silences, words, curve), plain_snap(b, silences, words, curve)) for a, b in long]
        new = [k for k in new if k[0] < k[1]]
        if new == keeps:
            break
        keeps = new
        if not keeps:
            break
    assert seq.settled(sorted(set(map(tuple, keeps))), ladder.snap) == seq.settled(keeps, ladder.snap)


def test_collapsed_clips_go():
    ladder = seq.Ladder([], [(0, 10 * S)], [])
    assert seq.settled([(4_900_000, 5_100_000)], lambda t: 5 * S) == []
    assert seq.settled([(0, 2 * S), (9_800_000, 12 * S)], ladder.snap) == [(0, 2 * S), (10 * S, 12 * S)]


def item(i, a, b):
    return {"id": i, "start_us": a * S, "end_us": b * S}


def spans(items):
    return [(x["id"], x["start_us"] / S, x["end_us"] / S) for x in items]


def test_setups_of_kept_payoffs_come_in_cut_to_the_budget():
    kept, dropped = [item(5, 50, 60)], [item(1, 0, 20), item(2, 20, 24), item(3, 30, 31)]
    assert spans(seq.closed(kept, dropped, [(2, 5)], None)[0]) == [(2, 20, 24), (5, 50, 60)]
    assert spans(seq.closed(kept, dropped, [(1, 5)], 18 * S)[0]) == [(1, 6, 14), (5, 50, 60)]  # 8 s are left, in the middle
    assert spans(seq.closed(kept, dropped, [(1, 5)], 5 * S)[0]) == [(1, 8.5, 11.5), (5, 50, 60)]  # three seconds at least
    assert spans(seq.closed(kept, dropped, [(1, 2), (2, 5), (3, 2)], None)[0]) == [(2, 20, 24), (3, 30, 31), (5, 50, 60)]  # one pass, in order
    assert seq.closed([], dropped, [(1, 5)], None)[0] == []


def test_swaps_are_applied_or_all_taken_back():
    kept, dropped = [item(1, 0, 10), item(2, 10, 20)], [item(3, 30, 40), item(4, 40, 70)]
    assert [x["id"] for x in seq.swapped(kept, dropped, [(1, 3)], [], 20 * S)] == [2, 3]
    assert [x["id"] for x in seq.swapped(kept, dropped, [(1, 4)], [], 20 * S)] == [1, 2]  # 40 s are more than 23
    assert [x["id"] for x in seq.swapped(kept, dropped, [(1, 4)], [], None)] == [2, 4]
    assert [x["id"] for x in seq.swapped(kept, dropped, [(1, 3)], [(1, 2)], None)] == [1, 2]  # 2 needs 1
    assert [x["id"] for x in seq.swapped(kept, dropped, [(9, 3), (1, 9)], [], None)] == [1, 2]
    assert [x["id"] for x in seq.swapped(kept, dropped, [(1, 3), (3, 1)] * 3, [], None)] == [2, 3]  # the sixth isn't made


def test_retakes_of_a_table_against_plain_loops(spark, sf_dir):
    import difflib

    from cutgraph.queries import QUERIES

    rows = sorted(spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_nationkey", "c_custkey", "c_mktsegment", "c_name", "c_acctbal").collect())
    told = set()
    for nation in {r.c_nationkey for r in rows}:
        mine = [r for r in rows if r.c_nationkey == nation]
        used = set()
        for i, a in enumerate(mine):
            if i in used:
                continue
            take = [i]
            for j in range(i + 1, min(len(mine), i + 13)):  # ten seconds apart, 120 s at most
                b = mine[j]
                if j not in used and a.c_mktsegment == b.c_mktsegment and (a.c_acctbal < 0) == (b.c_acctbal < 0) and difflib.SequenceMatcher(None, a.c_name, b.c_name, autojunk=False).ratio() > 0.93:
                    take.append(j)
            if len(take) > 1:
                used.update(take)
                told |= {(nation, i, mine[k].c_custkey, t) for t, k in enumerate(take)}
    got = {(r.media_id, r.cluster_id, r.id, r.take_index) for r in QUERIES["retakes_of_names"](spark, sf_dir).collect()}
    assert got == told and len(got) > 10
