"""Algorithms whose every step depends on the one before: pure Python cores, run per media item.

Each core takes and returns plain lists; ``per_media`` runs it for one item after the other as sorted rows stream through a
task. An item's rows are bounded by its length in time, not by the corpus.
"""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

S = 1_000_000
#: Rows that leave a task in one batch.
BATCH = 4096


def per_media(df: DataFrame, key: str, order: list[str], core: Callable[[list[dict]], list[dict]], schema: str) -> DataFrame:
    """Rows of each key, sorted, through ``core``; ``schema`` starts with the key, which is filled in.

    Many items share a batch, so that small ones cost no call each; memory holds one item and one batch. Rows are dealt by a hash of the key,
    as Spark drops a repartition by the key itself over a union that claims it, and adaptive execution then breaks that claim.
    """
    out = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: list[dict] = []
        for value, rows in groupby((row for batch in batches for row in batch.to_pylist()), lambda r: r[key]):
            made += [{key: value} | x for x in core(list(rows))]
            while len(made) >= BATCH:
                yield pa.RecordBatch.from_pylist(made[:BATCH], out)
                made = made[BATCH:]
        if made:
            yield pa.RecordBatch.from_pylist(made, out)

    return df.repartition(F.xxhash64(key)).sortWithinPartitions(key, *order).mapInArrow(run, schema)


def retake_clusters(utts: list[dict], similar: Callable[[dict, dict], float], least: float = 0.87, near: int = 5 * S, far: int = 120 * S) -> list[dict]:
    """Greedy clusters: each utterance not yet used seeds one with the later ones that are alike; takes go by time."""
    used: set[int] = set()
    out = []
    for i, a in enumerate(utts):
        if i in used:
            continue
        members = [i]
        for j in range(i + 1, len(utts)):
            b = utts[j]
            gap = b["start_us"] - a["start_us"]
            if gap > far:
                break
            da, db = a["end_us"] - a["start_us"], b["end_us"] - b["start_us"]
            if j not in used and gap >= near and (a.get("speaker") is None or b.get("speaker") is None or a["speaker"] == b["speaker"]) and min(da, db) >= 0.5 * max(da, db, 1) and similar(a, b) > least:
                members.append(j)
        if len(members) > 1:
            used.update(members)
            out += [{"cluster_id": i, "id": utts[k]["id"], "take_index": t} for t, k in enumerate(members)]
    return out


def scene_chunks(boundaries: list[int], duration: int, target: int = 180 * S, slack: int = 60 * S, longest_whole: int = 900 * S, tail: int = 10 * S) -> list[tuple[int, int]]:
    """Chunks of about ``target`` that end at the nearest boundary within ``slack``; a short tail joins the last."""
    if duration <= longest_whole:
        return [(0, duration)]
    out, at = [], 0
    while at < duration:
        want = at + target
        if want + tail >= duration:
            out.append((at, duration))
            break
        close = [b for b in boundaries if abs(b - want) <= slack and b > at]
        end = min(close, key=lambda b: (abs(b - want), b)) if close else want
        if duration - end <= tail:
            end = duration
        out.append((at, end))
        at = end
    return out


def pseudo_shots(silences: list[tuple[int, int]], duration: int, every: int = 20 * S, slack: int = 5 * S, least: int = 2 * S) -> list[tuple[int, int]]:
    """Cuts every ``every``, moved to the nearest silence's middle within ``slack``; pieces shorter than ``least`` join."""
    middles = [(a + b) // 2 for a, b in silences]
    cuts, want = [0], every
    while want < duration:
        close = [m for m in middles if abs(m - want) <= slack]
        cut = min(close, key=lambda m: (abs(m - want), m)) if close else want
        if cut - cuts[-1] >= least and duration - cut >= least:
            cuts.append(cut)
        want += every
    return list(zip(cuts, [*cuts[1:], duration], strict=True))


def grouped_shots(shots: list[dict], correlate: Callable[[list[float], list[float]], float], alike: float = 0.65, same_speaker: float = 0.40, longest: int = 60 * S) -> list[int]:
    """Scene number of each shot: it joins the scene before if alike, or somewhat alike and of the same speaker."""
    out, scene, mean, n, begun = [], -1, [], 0, 0
    for i, s in enumerate(shots):
        r = correlate(mean, s["hist"]) if n else -1.0
        speaker = i > 0 and s.get("speaker") is not None and s["speaker"] == shots[i - 1].get("speaker")
        if n and s["end_us"] - begun <= longest and (r > alike or (speaker and r > same_speaker)):
            mean = [(m * n + h) / (n + 1) for m, h in zip(mean, s["hist"], strict=True)]
            n += 1
        else:
            scene, mean, n, begun = scene + 1, list(s["hist"]), 1, s["start_us"]
        out.append(scene)
    return out


def match_chain(tails: list[list[float]], heads: list[list[float]], annotate: float = 0.72) -> list[tuple[int, float | None, bool]]:
    """Greedy order by the last frame of one clip against the first of the next: (clip, similarity, matched)."""
    if len(tails) < 3:
        return [(i, None, False) for i in range(len(tails))]
    left, now, out = list(range(1, len(tails))), 0, [(0, None, False)]
    while left:
        scores = [(sum(x * y for x, y in zip(tails[now], heads[j], strict=True)), -j) for j in left]
        best, j = max(scores)
        now = -j
        left.remove(now)
        out.append((now, best, best >= annotate))
    return out


def budget_selection(items: list[dict], budget: int, floor: int = 3 * S) -> list[dict]:
    """Items (start_us, end_us, score, importance, t_us) that fit a budget, in time order.

    Where the strong ones alone are too long they share it by value, each around its evidence and never under
    ``floor``; else items go by value density, the last one is cut, and swaps that gain value follow.
    """

    def value(x: dict) -> float:
        return 100 * x["score"] + (0.5 if x.get("importance") is None else x["importance"])

    def length(x: dict) -> int:
        return x["end_us"] - x["start_us"]

    strong = [x for x in items if x["score"] >= 0.5]
    if sum(map(length, strong)) > budget:
        total = sum(map(value, strong))
        out = []
        for x in strong:
            share = max(int(value(x) / total * budget), floor)
            if share < length(x):
                middle = x.get("t_us") if x.get("t_us") is not None else (x["start_us"] + x["end_us"]) // 2
                a = min(max(x["start_us"], middle - share // 2), x["end_us"] - share)
                x = x | {"start_us": a, "end_us": a + share}
            out.append(x)
        return sorted(out, key=lambda x: (x["start_us"], x["id"]))
    order = sorted(items, key=lambda x: (-value(x) / max(length(x), 10_000), x["start_us"], x["id"]))
    kept, left, spent = [], [], 0
    for i, x in enumerate(order):
        if spent + length(x) <= budget:
            kept.append(x)
            spent += length(x)
        else:
            rest = max(budget - spent, floor)
            if spent < budget and rest < length(x):
                kept.append(x | {"end_us": x["start_us"] + rest})
                spent += rest
                left += order[i + 1 :]
                break
            left.append(x)
    for _ in range(5):
        gains = [(value(b) - value(a), -a["id"], -b["id"], a, b) for a in kept for b in left if spent - length(a) + length(b) <= budget and value(b) > value(a)]
        if not gains:
            break
        *_, a, b = max(gains, key=lambda g: g[:3])
        kept[kept.index(a)] = b
        left[left.index(b)] = a
        spent += length(b) - length(a)
    if not kept and items:
        kept = [min(items, key=lambda x: (length(x), x["start_us"]))]
    return sorted(kept, key=lambda x: (x["start_us"], x["id"]))


def claimed_order(keeps: list[tuple[int, int]], wanted: list[tuple[int, int]], slack: int = S // 2) -> list[int]:
    """Positions of kept clips in the wanted order: each segment claims the first unused clip that holds it; the rest follow."""
    used: list[int] = []
    for a, b in wanted:
        hit = next((i for i, (s, e) in enumerate(keeps) if i not in used and s - slack <= a and b <= e + slack), None)
        if hit is not None:
            used.append(hit)
    return used + [i for i in range(len(keeps)) if i not in used]


def merged_identities(people: list[dict], similar: Callable[[dict, dict], float], least: float = 0.8, bonus: float = 0.1, near: int = 2) -> list[int]:
    """Group of each person (scene): greedy, each joins the first group whose seed is alike; close scenes help."""
    seeds: list[int] = []
    out: list[int] = []
    for i, p in enumerate(people):
        for g, s in enumerate(seeds):
            close = abs(people[s]["scene"] - p["scene"]) <= near
            if similar(people[s], p) + (bonus if close else 0.0) > least:
                out.append(g)
                break
        else:
            out.append(len(seeds))
            seeds.append(i)
    return out


def assigned(cost: list[list[float]], most: float = float("inf")) -> list[tuple[int, int]]:
    """Pairs (row, column) of the least total cost, by shortest augmenting paths; pairs dearer than ``most`` go."""
    if not cost or not cost[0]:
        return []
    turned = len(cost) > len(cost[0])
    c = [list(x) for x in zip(*cost, strict=True)] if turned else cost
    n, m = len(c), len(c[0])
    u, v, owner, way = [0.0] * (n + 1), [0.0] * (m + 1), [0] * (m + 1), [0] * (m + 1)
    for i in range(1, n + 1):
        owner[0], j0 = i, 0
        least, used = [float("inf")] * (m + 1), [False] * (m + 1)
        while owner[j0]:
            used[j0] = True
            step, j1 = float("inf"), 0
            for j in range(1, m + 1):
                if not used[j]:
                    now = c[owner[j0] - 1][j - 1] - u[owner[j0]] - v[j]
                    if now < least[j]:
                        least[j], way[j] = now, j0
                    if least[j] < step:
                        step, j1 = least[j], j
            for j in range(m + 1):
                if used[j]:
                    u[owner[j]] += step
                    v[j] -= step
                else:
                    least[j] -= step
            j0 = j1
        while j0:
            owner[j0], j0 = owner[way[j0]], way[j0]
    pairs = [(owner[j] - 1, j - 1) for j in range(1, m + 1) if owner[j]]
    return sorted((b, a) if turned else (a, b) for a, b in pairs if c[a][b] <= most)


class Ladder:
    """Where cuts of a media item should move, by binary search in sorted targets.

    In turn: the best sample (t, score) of the affinity curve within ``window``, if not negative and more than 50 ms away; the middle of the nearest
    silence of 300 ms or more that lies in no word; the middle of the nearest gap of 120 ms or more between words; the nearest word edge; the cut as it is.
    """

    def __init__(self, silences: list[tuple[int, int]], words: list[tuple[int, int]], affinity: list[tuple[int, float]] = (), window: int = 400_000):
        self.window, words = window, sorted(words)
        starts, reach = [a + 15_000 for a, _ in words], []
        for _, b in words:
            reach.append(max(b - 15_000, reach[-1] if reach else b - 15_000))
        inside = lambda t: (i := bisect_left(starts, t)) > 0 and reach[i - 1] > t
        quiet = {(a + b) // 2 for a, b in silences if b - a >= 300_000}
        self.quiet = sorted(t for t in quiet if not inside(t))
        self.gaps = sorted({(b + c) // 2 for (_, b), (c, _) in zip(words, words[1:], strict=False) if c - b >= 120_000})
        self.edges = sorted({t for w in words for t in w})
        self.curve = sorted(affinity)
        self.at = [t for t, _ in self.curve]

    def _nearest(self, targets: list[int], t: int) -> int | None:
        i = bisect_left(targets, t)
        close = [x for x in targets[max(0, i - 1) : i + 1] if abs(x - t) <= self.window]
        return min(close, key=lambda x: (abs(x - t), x)) if close else None

    def snap(self, t: int) -> int:
        near = self.curve[bisect_left(self.at, t - self.window) : bisect_right(self.at, t + self.window)]
        if near:
            u, score = max(near, key=lambda x: (x[1], -abs(x[0] - t), -x[0]))
            if score >= 0 and abs(u - t) > 50_000:
                return u
        return next((u for targets in (self.quiet, self.gaps, self.edges) if (u := self._nearest(targets, t)) is not None), t)


def settled(keeps: list[tuple[int, int]], snap: Callable[[int], int], micro: int = 300_000, least: int = S, rounds: int = 5) -> list[tuple[int, int]]:
    """Merge of micro gaps, drop of short clips (never all) and snapping, until nothing changes; clips whose snapped ends collapse go."""
    for _ in range(rounds):
        merged: list[tuple[int, int]] = []
        for a, b in sorted(keeps):
            if merged and a - merged[-1][1] < micro:
                merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
            else:
                merged.append((a, b))
        long = [k for k in merged if k[1] - k[0] >= least] or ([max(merged, key=lambda k: (k[1] - k[0], -k[0]))] if merged else [])
        new = [(x, y) for a, b in long if (x := snap(a)) < (y := snap(b))]
        if new == keeps:
            break
        keeps = new
    return keeps


def smoothed(values: list[float], half: int = 2, sigma: float = 1.1) -> list[float]:
    """Gaussian average over 2 * half + 1 samples; beyond its ends the series is mirrored."""
    weights = [math.exp(-k * k / (2 * sigma * sigma)) for k in range(-half, half + 1)]
    n, total = len(values), sum(weights)

    def at(i: int) -> float:
        while n > 1 and not 0 <= i < n:
            i = -i if i < 0 else 2 * (n - 1) - i
        return values[i if n > 1 else 0]

    return [sum(w * at(i + k) for w, k in zip(weights, range(-half, half + 1), strict=True)) / total for i in range(n)]


def peaks(values: list[float], distance: int = 10, prominence: float = 0.5) -> list[int]:
    """Places of the peaks of a series: the middles of stretches that are higher than what is on both sides.

    Of peaks nearer than ``distance`` the higher stays (of equal ones the later), from the highest on. What stays must stand out by ``prominence``: over the higher of the
    two least values on the ways to something higher on either side, or to the end.
    """
    n, found, i = len(values), [], 1
    while i < n - 1:
        if values[i - 1] < values[i]:
            j = i
            while j + 1 < n and values[j + 1] == values[i]:
                j += 1
            if j + 1 < n and values[j + 1] < values[i]:
                found.append((i + j) // 2)
            i = j
        i += 1
    kept = [True] * len(found)
    for k in sorted(range(len(found)), key=lambda k: (values[found[k]], k), reverse=True):
        if kept[k]:
            for step in (-1, 1):
                m = k + step
                while 0 <= m < len(found) and abs(found[m] - found[k]) < distance:
                    kept[m] = False
                    m += step

    def lows(order: list[int]) -> dict[int, float]:
        """Least value on the way back from each place to a higher one: a stack of falling values, each with the least of what it has covered."""
        stack: list[tuple[float, float]] = []
        out = {}
        for p in order:
            low = values[p]
            while stack and stack[-1][0] <= values[p]:
                low = min(low, stack.pop()[1])
            out[p] = low
            stack.append((values[p], low))
        return out

    left, right = lows(list(range(n))), lows(list(range(n - 1, -1, -1)))
    return [p for p, k in zip(found, kept, strict=True) if k and values[p] - max(left[p], right[p]) >= prominence]


def distinct_frames(frames: list[dict], most: int, alike: float = 0.90) -> list[dict]:
    """The ``most`` best frames (quality, vector), none of which is more than ``alike`` (inner product) one that is better."""
    kept: list[dict] = []
    for f in sorted(frames, key=lambda f: (-f["quality"], f["id"])):
        if len(kept) == most:
            break
        if not any(sum(x * y for x, y in zip(f["vector"], k["vector"], strict=True)) > alike for k in kept):
            kept.append(f)
    return kept


def closed(kept: list[dict], dropped: list[dict], needs: list[tuple[object, object]], target: int | None, floor: int = 3 * S) -> tuple[list[dict], list[dict]]:
    """(kept, dropped) after the dropped setup (setup, payoff) of each kept payoff is pulled in, by the order of ``needs``.

    Where it doesn't fit the target any more, its middle of what is left, or of ``floor`` at least, is taken.
    """
    kept, dropped = list(kept), list(dropped)
    have = {x["id"] for x in kept}
    for setup, payoff in needs:
        if payoff in have and setup not in have and (x := next((d for d in dropped if d["id"] == setup), None)) is not None:
            length, spent = x["end_us"] - x["start_us"], sum(k["end_us"] - k["start_us"] for k in kept)
            dropped.remove(x)
            if target is not None and spent + length > target:
                allowed = max(target - spent, floor)
                middle = (x["start_us"] + x["end_us"]) // 2
                x = x | {"start_us": max(x["start_us"], middle - allowed // 2), "end_us": min(x["end_us"], middle + allowed // 2)}
            kept.append(x)
            have.add(setup)
    return sorted(kept, key=lambda x: (x["start_us"], x["id"])), dropped


def swapped(kept: list[dict], dropped: list[dict], swaps: list[tuple[object, object]], needs: list[tuple[object, object]], target: int | None, most: int = 5) -> list[dict]:
    """``kept`` after up to ``most`` swaps (out, in) of items by id; all are taken back if the result is longer than 1.15 targets or a kept payoff lacks its setup."""
    new, out = list(kept), list(dropped)
    for gone, come in swaps[:most]:
        a, b = next((x for x in new if x["id"] == gone), None), next((x for x in out if x["id"] == come), None)
        if a is not None and b is not None:
            new.remove(a)
            out.remove(b)
            new.append(b)
            out.append(a)
    have = {x["id"] for x in new}
    too_long = target is not None and 100 * sum(x["end_us"] - x["start_us"] for x in new) > 115 * target
    if too_long or any(payoff in have and setup not in have for setup, payoff in needs):
        new = kept
    return sorted(new, key=lambda x: (x["start_us"], x["id"]))
