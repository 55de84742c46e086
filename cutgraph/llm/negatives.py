"""Hard-negative mining: for each anchor and each of its positives, the hardest rows of other labels within limits.

Rows and anchors are dealt by hash to blocks of bounded size, and every pair of a block of rows and one of
anchors is a tile. In a tile the integer scores of an anchor with all rows are sorted by score and id; each positive's upper limit is
found by binary search, and from there the rows of other labels are read as long as they reach the lower limit. As the
best of a block are a superset of its share of the best of all, tiles leave only a few rows for each anchor, and those are ranked. A first
round of tiles ranks the rows of the anchor's own label, which gives the positives; the second one finds the negatives.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch

POSITIVES, NEGATIVES = 5, 3
#: Per cent of the positive's score that a negative's must reach and may have.
LOW, HIGH = 50, 95
SCALE = 256
#: Rows and anchors in a block, and anchors whose scores are in memory at once.
ROWS, ANCHORS, AT_ONCE = 4096, 2048, 256
_LONG = (1 << 63) - 1


class Side:
    """The members of a block in order of id: ids, labels, whole-numbered vectors and what else a struct of them has."""

    def __init__(self, table: pa.Table, column: str):
        members = pa.concat_arrays(c.flatten() for c in table.column(column).chunks) if table.num_rows else None
        named = dict(zip((f.name for f in members.type), members.flatten(), strict=True)) if members is not None else {}
        ids = np.array(named.get("vec_id", []), np.int64)
        order = np.argsort(ids, kind="stable")
        self.ids, self.labels = ids[order], np.array(named.get("label", []), np.int64)[order]
        vectors = named.get("embedding", pa.array([], pa.list_(pa.float64())))
        lengths = np.array(vectors.value_lengths(), np.int64)
        values = np.floor(SCALE * np.array(vectors.flatten(), np.float64))
        at = np.arange(lengths.max(initial=0)) < lengths[:, None]
        self.vectors = np.zeros(at.shape)
        self.vectors[at] = values
        self.vectors = self.vectors[order]
        self.more = {k: v.take(pa.array(order)).to_pylist() for k, v in named.items() if k not in ("vec_id", "label", "embedding")}


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of whole-numbered vectors; the shorter ones count as if followed by zeros."""
    width = max(a.shape[1], b.shape[1])
    a, b = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (a, b))
    most = np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * width
    if most < 1 << 53:
        return (a @ b.T).astype(np.int64)
    whole = np.vectorize(int, otypes=[object])
    return whole(a) @ whole(b).T if a.size and b.size else np.zeros((len(a), len(b)), np.int64)


def limits(positive: int, low: int, high: int) -> tuple[int, int]:
    """Least and largest score that a negative may have: low * positive <= 100 * score <= high * positive."""
    return -((-low * positive) // 100), (high * positive) // 100


def _each(rows: Side, anchors: Side) -> Iterator[tuple[int, np.ndarray]]:
    """(index, scores with all rows) of each anchor."""
    for at in range(0, len(anchors.ids), AT_ONCE):
        for i, own in enumerate(scores(anchors.vectors[at : at + AT_ONCE], rows.vectors), at):
            yield i, own


def _by_score(own: np.ndarray, among: np.ndarray) -> np.ndarray:
    """``among`` by falling score, equal ones by id: rows are in order of id, and the sort is stable."""
    return among[np.argsort(-own[among], kind="stable")]


def _held(values: list) -> pa.Array:
    return pa.array([max(-_LONG, min(_LONG, int(v))) for v in values], pa.int64())


def _positives(most: int):
    def tile(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        rows, anchors = Side(rows, "rows"), Side(anchors, "anchors")
        of_label = {int(v): np.flatnonzero(rows.labels == v) for v in np.unique(rows.labels)}
        out: list[tuple[int, int, int]] = []
        for i, own in _each(rows, anchors):
            same = of_label.get(int(anchors.labels[i]), np.zeros(0, np.int64))
            best = _by_score(own, same[rows.ids[same] != anchors.ids[i]])[:most]
            out += [(int(anchors.ids[i]), int(rows.ids[j]), own[j]) for j in best]
        a, p, s = zip(*out, strict=True) if out else ((), (), ())
        return pa.table({"anchor_id": pa.array(a, pa.int64()), "positive_id": pa.array(p, pa.int64()), "positive_score": _held(s)})

    return tile


def _negatives(most: int, low: int, high: int):
    def tile(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        rows, anchors = Side(rows, "rows"), Side(anchors, "anchors")
        not_of_label = {int(v): np.flatnonzero(rows.labels != v) for v in np.unique(anchors.labels)}
        out: list[tuple[int, int, int, int, int]] = []
        for i, own in _each(rows, anchors):
            order = _by_score(own, not_of_label[int(anchors.labels[i])])
            falling = -own[order]
            for p in anchors.more["positives"][i]:
                least, largest = limits(p["positive_score"], low, high)
                at = int(np.searchsorted(falling, -largest, "left"))
                out += [(int(anchors.ids[i]), p["positive_id"], p["positive_score"], int(rows.ids[j]), own[j]) for j in order[at : at + most] if own[j] >= least]
        a, p, ps, n, ns = zip(*out, strict=True) if out else ((), (), (), (), ())
        return pa.table({"anchor_id": pa.array(a, pa.int64()), "positive_id": pa.array(p, pa.int64()), "positive_score": _held(ps), "negative_id": pa.array(n, pa.int64()), "negative_score": _held(ns)})

    return tile


def _tiles(rows: DataFrame, anchors: DataFrame, n_rows: int, n_anchors: int):
    """Each block of rows with each block of anchors; a block is one record here."""
    left = rows.select("rb", "rows", F.explode(F.sequence(F.lit(0), F.lit(n_anchors - 1))).alias("ab"))
    right = anchors.select("ab", "anchors", F.explode(F.sequence(F.lit(0), F.lit(n_rows - 1))).alias("rb"))
    return left.groupBy("rb", "ab").cogroup(right.groupBy("rb", "ab"))


def mine_hard_negatives(spark: SparkSession, rows: DataFrame, anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) from (vec_id, label, embedding).

    ``anchor`` tells by vec_id which rows are anchors. Components become floor(256 * x), a score is the exact inner product of two such vectors; where lengths
    differ the shorter one counts as if followed by zeros. The first ``positives`` other rows of its label are an anchor's
    positives, all if they are fewer; for each, the first ``negatives`` rows of another label with low * positive_score <= 100 * negative_score <= high *
    positive_score are returned. Higher scores come first, ties by smaller vec_id. Rows with a null vec_id, label or vector, or
    with a null or non-finite component, take no part. Rows that repeat a vec_id are one row: that of the smallest label, then vector. Scores beyond a
    long are held at its ends. Other columns are not read. No rows or no anchors: an empty result.

    Every anchor is scored with every row, which the method asks for: work grows as anchors times rows, in tiles of ROWS
    by ANCHORS. What a task holds is a tile; what is shuffled are the blocks, once for each block of the other side, and for each anchor
    and tile ``positives`` rows in the first round and up to positives * negatives in the second.
    """
    scratch = Scratch(spark, "negatives")
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    known = rows.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull()).filter(~bad)
    one = F.min(F.struct(F.col("label").cast("long").alias("label"), "embedding")).alias("r")
    known = scratch.save(known.select("vec_id", "label", "embedding").groupBy("vec_id").agg(one).select("vec_id", "r.label", "r.embedding", F.coalesce(anchor, F.lit(False)).alias("is_anchor")))
    n, m = known.agg(F.count("*"), F.count_if("is_anchor")).first()
    n_rows, n_anchors = max(1, -(-n // ROWS)), max(1, -(-m // ANCHORS))
    block = lambda k, seed: F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(k)).cast("int")
    blocks = scratch.save(known.groupBy(block(n_rows, 1).alias("rb")).agg(F.collect_list(F.struct("vec_id", "label", "embedding")).alias("rows")))
    chosen = known.filter("is_anchor").select("vec_id", "label", "embedding")

    packed = chosen.groupBy(block(n_anchors, 2).alias("ab")).agg(F.collect_list(F.struct("vec_id", "label", "embedding")).alias("anchors"))
    first = _tiles(blocks, packed, n_rows, n_anchors).applyInArrow(_positives(positives), "anchor_id long, positive_id long, positive_score long")
    best = Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    first = first.withColumn("r", F.row_number().over(best)).filter(F.col("r") <= positives)
    of_anchor = scratch.save(first.groupBy("anchor_id").agg(F.collect_list(F.struct("positive_id", "positive_score")).alias("positives")))

    with_them = chosen.join(of_anchor, F.col("vec_id") == F.col("anchor_id"))
    packed = with_them.groupBy(block(n_anchors, 2).alias("ab")).agg(F.collect_list(F.struct("vec_id", "label", "embedding", "positives")).alias("anchors"))
    second = _tiles(blocks, packed, n_rows, n_anchors).applyInArrow(_negatives(negatives, low, high), "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long")
    hardest = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
    ranked = second.withColumn("rank", F.row_number().over(hardest)).filter(F.col("rank") <= negatives)
    return ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def query_negatives(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """Anchors are the rows whose vec_id is divisible by 50; where it is divisible by 7, the label is another first."""
    label = F.col("label").cast("long")
    label = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    return mine_hard_negatives(spark, rows.select("vec_id", label.alias("label"), "embedding"), F.col("vec_id") % 50 == 0)
