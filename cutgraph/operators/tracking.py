"""Tracking of boxes over frames: a Kalman filter a track, gated assignment in stages, per media item.

A box is measured as centre, ratio of width to height, and height; the filter's state has these four and their velocities, with noise in
proportion to the height. A track may take a box that overlaps its predicted one and lies within the gate of the Mahalanobis
distance; of all such pairs, those of least total cost are chosen. Confident boxes go first, then faint ones, and tracks that
are not confirmed yet come after those that are. Tracks unseen for too long are closed.
"""

from __future__ import annotations

from .sequential import assigned

Box = tuple[float, float, float, float, float]
#: 95 % of the chi-square distribution with 4 degrees of freedom.
GATE = 9.4877
POSITION, VELOCITY = 1 / 20, 1 / 160


def measured(box: Box) -> tuple[float, float, float, float]:
    w, h = max(box[2] - box[0], 1e-6), max(box[3] - box[1], 1e-6)
    return box[0] + w / 2, box[1] + h / 2, w / h, h


class Kalman:
    """Constant velocity; ``mean`` and ``cov`` of the eight state variables."""

    __slots__ = ("at", "speed", "of_place", "of_ratio")

    def __init__(self, z):
        h = float(z[3])
        self.at, self.speed = tuple(map(float, z)), (0.0, 0.0, 0.0, 0.0)
        # variance, covariance with the velocity, and the velocity's variance
        self.of_place = ((2 * POSITION * h) ** 2, 0.0, (10 * VELOCITY * h) ** 2)
        self.of_ratio = (1e-2**2, 0.0, 1e-5**2)

    def predict(self) -> None:
        (x, y, r, h), (dx, dy, dr, dh) = self.at, self.speed
        p, c, v = self.of_place
        self.of_place = p + c + (c + v) + (POSITION * h) ** 2, c + v, v + (VELOCITY * h) ** 2
        p, c, v = self.of_ratio
        self.of_ratio = p + c + (c + v) + 1e-2**2, c + v, v + 1e-5**2
        self.at = x + dx, y + dy, r + dr, h + dh

    def distance(self, z) -> float:
        """Squared Mahalanobis distance of a measurement from what is expected."""
        x, y, r, h = self.at
        place, ratio = self.of_place[0] + (POSITION * h) ** 2, self.of_ratio[0] + 1e-1**2
        return float(((z[0] - x) ** 2 + (z[1] - y) ** 2 + (z[3] - h) ** 2) / place + (z[2] - r) ** 2 / ratio)

    def update(self, z) -> None:
        (x, y, r, h), (dx, dy, dr, dh) = self.at, self.speed
        (p, c, v), (rp, rc, rv) = self.of_place, self.of_ratio
        s, rs = p + (POSITION * h) ** 2, rp + 1e-1**2
        g, f, rg, rf = p / s, c / s, rp / rs, rc / rs
        ex, ey, er, eh = float(z[0]) - x, float(z[1]) - y, float(z[2]) - r, float(z[3]) - h
        self.at = x + g * ex, y + g * ey, r + rg * er, h + g * eh
        self.speed = dx + f * ex, dy + f * ey, dr + rf * er, dh + f * eh
        self.of_place = p - g * s * g, c - g * s * f, v - f * s * f
        self.of_ratio = rp - rg * rs * rg, rc - rg * rs * rf, rv - rf * rs * rf

    @property
    def mean(self) -> tuple[float, ...]:
        return self.at + self.speed

    @property
    def cov(self) -> list[list[float]]:
        out = [[0.0] * 8 for _ in range(8)]
        for i, (p, c, v) in enumerate((self.of_place, self.of_place, self.of_ratio, self.of_place)):
            out[i][i], out[i][i + 4], out[i + 4][i], out[i + 4][i + 4] = p, c, c, v
        return out

    @property
    def box(self) -> tuple[float, float, float, float]:
        x, y, ratio, h = self.at
        h = max(h, 1e-6)
        w = max(ratio, 1e-6) * h
        return x - w / 2, y - h / 2, x + w / 2, y + h / 2


def iou(a, b) -> float:
    w = (a[2] if a[2] < b[2] else b[2]) - (a[0] if a[0] > b[0] else b[0])
    h = (a[3] if a[3] < b[3] else b[3]) - (a[1] if a[1] > b[1] else b[1])
    both = w * h if w > 0 and h > 0 else 0.0
    return both / ((a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - both or 1.0)


#: The cost of a pair that may not be; dearer than any number of pairs that may.
NEVER = 1e6


def tracks(frames: list[list[Box]], high: float = 0.6, low: float = 0.1, overlap: float = 0.5, age: int = 30, hits: int = 3) -> list[tuple[int, int, int]]:
    """(frame, box, track) of the tracks that have ``hits`` boxes or more; boxes are (x0, y0, x1, y1, score).

    Only a confident box (``high``) begins a track; a faint one (``low``) can go on with one. A track is closed after more than ``age`` frames without a box.
    """
    live: list[dict] = []
    out: list[tuple[int, int, int]] = []
    count = 0

    def close(t: dict) -> None:
        if len(t["path"]) >= hits:
            out.extend((f, i, t["id"]) for f, i in t["path"])

    def match(f: int, some: list[dict], rest: list[int], boxes: list[Box], seen: list) -> None:
        cost, pairs = [], []
        for a, t in enumerate(some):
            expected, row = t["filter"].box, [NEVER] * len(rest)
            for b, i in enumerate(rest):
                if (o := iou(expected, boxes[i])) >= overlap and t["filter"].distance(seen[i]) <= GATE:
                    row[b] = 1 - o
                    pairs.append((a, b))
            cost.append(row)
        # pairs that share nothing need no choice
        apart = len({a for a, _ in pairs}) == len(pairs) == len({b for _, b in pairs})
        for a, b in pairs if apart else assigned(cost, NEVER / 2):
            t, i = some[a], rest[b]
            t["filter"].update(seen[i])
            t["seen"] = f
            t["path"].append((f, i))

    for f, boxes in enumerate(frames):
        if any(f - t["seen"] > age + 1 for t in live):
            for t in live:
                if f - t["seen"] > age + 1:
                    close(t)
            live = [t for t in live if f - t["seen"] <= age + 1]
        seen, bands = [measured(b) for b in boxes], [[i for i, b in enumerate(boxes) if least <= b[4] < most] for least, most in ((high, float("inf")), (low, high))]
        for t in live:
            t["filter"].predict()
        left, taken = ([t for t in live if len(t["path"]) >= hits], [t for t in live if len(t["path"]) < hits]), set()
        for some in left:
            for band in bands:
                rest = [i for i in band if i not in taken]
                if some and rest:
                    match(f, some, rest, boxes, seen)
                    taken.update(t["path"][-1][1] for t in some if t["seen"] == f)
                    some = [t for t in some if t["seen"] < f]
        for i in bands[0]:
            if i not in taken:
                live.append({"id": count, "filter": Kalman(seen[i]), "seen": f, "path": [(f, i)]})
                count += 1
    for t in live:
        close(t)
    return sorted(out)
