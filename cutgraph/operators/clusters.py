"""Hierarchical clustering by chains of nearest neighbours, and the number of clusters by silhouette, per media item.

A chain goes from a cluster to its nearest, and on, until two are each other's nearest; these merge. Distances to the merged one follow from
those to its parts, so a tree of n vectors takes n * n steps and numbers; a cut of the tree gives the clusters.
"""

from __future__ import annotations

import numpy as np


def _distances(x: np.ndarray, linkage: str) -> np.ndarray:
    if linkage == "average":  # by cosine
        length = np.linalg.norm(x, axis=1, keepdims=True)
        u = x / np.maximum(length, 1e-10)
        return 1 - u @ u.T
    square = (x * x).sum(1)
    return np.maximum(square[:, None] + square[None] - 2 * x @ x.T, 0)  # squared, for Ward's


def merges(vectors: list[list[float]], linkage: str = "average") -> list[tuple[float, int, int]]:
    """(distance, a, b) of each merge of the tree by rising distance; a and b are members of what is merged."""
    n = len(vectors)
    if n < 2:
        return []
    d = _distances(np.asarray(vectors, float), linkage)
    np.fill_diagonal(d, np.inf)
    size, open_, chain, out = np.ones(n), np.ones(n, bool), [], []
    while len(out) < n - 1:
        if not chain:
            chain.append(int(np.argmax(open_)))
        a = chain[-1]
        row = np.where(open_, d[a], np.inf)
        row[a] = np.inf
        b = int(np.argmin(row))
        if len(chain) > 1 and row[chain[-2]] <= row[b]:
            b = chain[-2]
        if len(chain) < 2 or b != chain[-2]:
            chain.append(b)
            continue
        del chain[-2:]
        out.append((float(d[a, b]), a, b))
        if linkage == "average":
            new = (size[a] * d[a] + size[b] * d[b]) / (size[a] + size[b])
        else:
            new = ((size[a] + size) * d[a] + (size[b] + size) * d[b] - size * d[a, b]) / (size[a] + size[b] + size)
        size[a] += size[b]
        open_[b] = False
        d[a], d[:, a] = new, new
        d[a, a] = np.inf
    # equal distances stay in the order of the merges, in which parts come before wholes
    return sorted(out, key=lambda m: m[0])


def cut_tree(n: int, tree: list[tuple[float, int, int]], distance: float | None = None, clusters: int | None = None) -> list[int]:
    """Cluster of each vector: merges under ``distance``, or until ``clusters`` are left; numbered by their first member."""
    parent = list(range(n))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    used = [m for m in tree if m[0] < distance] if distance is not None else tree[: max(0, n - (clusters or 1))]
    for _, a, b in used:
        parent[root(b)] = root(a)
    names: dict[int, int] = {}
    return [names.setdefault(root(i), len(names)) for i in range(n)]


def agglomerated(vectors: list[list[float]], distance: float = 0.5) -> list[int]:
    """Clusters by average linkage of cosine distances, merged while under ``distance``."""
    return cut_tree(len(vectors), merges(vectors), distance=distance)


def silhouette(d: np.ndarray, labels: list[int]) -> float:
    """Mean of (b - a) / max(a, b): a is the mean distance to the own cluster, b that to the nearest other; 0 for single members."""
    of = np.asarray(labels)
    k = of.max() + 1
    sums = np.stack([d[:, of == c].sum(1) for c in range(k)], 1)
    counts = np.bincount(of, minlength=k)
    i = np.arange(len(of))
    a = sums[i, of] / np.maximum(counts[of] - 1, 1)
    means = sums / counts
    means[i, of] = np.inf
    b = means.min(1)
    s = np.where(counts[of] > 1, (b - a) / np.maximum(np.maximum(a, b), 1e-300), 0.0)
    return float(s.mean())


def speakers(vectors: list[list[float]], least: int = 1, most: int = 4) -> tuple[list[int], float] | None:
    """The best of ``least`` to ``most`` clusters by Ward's linkage and their silhouette; None where fewer than three vectors allow no comparison."""
    n = len(vectors)
    if n < 3:
        return None
    x = np.asarray(vectors, float)
    d, tree = np.sqrt(_distances(x, "ward")), merges(vectors, "ward")
    best = None
    for k in range(max(2, least), min(most, n - 1) + 1):
        labels = cut_tree(n, tree, clusters=k)
        s = silhouette(d, labels)
        if best is None or s > best[1]:
            best = (labels, s)
    return best
