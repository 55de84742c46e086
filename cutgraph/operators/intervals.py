"""Interval algebra as window chains and bucketed equi-joins.

Running maxima and sums are windows over a media item: every operator of a chain has the same partitioning, so that a plan has
one exchange and no join of a table with itself. Items grow in number with the data and each is bounded by its length in
time; windows from the first row on run as streams over sorted rows that can spill. Overlap joins meet in time buckets,
so that no inequality becomes a nested loop.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running_max(df: DataFrame, keys: list[str], order: list[str], value: str, out: str, before: bool = True) -> DataFrame:
    """``out``: the greatest ``value`` of the rows before each (up to it, if not ``before``), by the total ``order`` within ``keys``."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1 if before else 0)
    return df.withColumn(out, F.max(value).over(w))


def running_sum(df: DataFrame, keys: list[str], order: str, value: str, out: str) -> DataFrame:
    """``out``: the sum of ``value`` up to each row, by ``order`` within ``keys``."""
    return df.withColumn(out, F.sum(value).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))


def with_next(df: DataFrame, keys: list[str], start: str, tie: str, last: int, out: str = "next_us") -> DataFrame:
    """``out``: the next row's start within ``keys``, ``last`` after the end."""
    return df.withColumn(out, F.lead(start, 1, last).over(Window.partitionBy(*keys).orderBy(start, tie)))


def gaps(df: DataFrame, keys: list[str], duration: int, least: int, items: DataFrame | None = None) -> DataFrame:
    """(keys, start_us, end_us) of the parts of [0, duration] that no interval covers, of ``least`` or more.

    ``items`` has the keys of all media items: those without any interval are a gap as a whole. Without it they don't show.
    """
    spans = df.select(*keys, "start_us", "end_us", F.col("id").cast("long").alias("id"))
    end = F.lit(duration).cast("long")
    if items is not None:
        spans = spans.unionByName(items.select(*keys).distinct().select(*keys, end.alias("start_us"), end.alias("end_us"), F.lit(None).cast("long").alias("id")))
    seen = running_max(spans, keys, ["start_us", "id"], "end_us", "_seen")
    last = F.lead("start_us").over(Window.partitionBy(*keys).orderBy("start_us", "id")).isNull()
    gap = lambda a, b: F.struct(a.alias("start_us"), b.alias("end_us"))
    before = gap(F.coalesce("_seen", F.lit(0).cast("long")), F.col("start_us"))
    both = F.when(last, F.array(before, gap(F.greatest("_seen", "end_us"), end))).otherwise(F.array(before))
    return seen.select(*keys, both.alias("_gaps")).select(*keys, F.inline("_gaps")).filter(f"end_us - start_us >= {least}")


def merge(df: DataFrame, keys: list[str], gap: int, aggs: list[Column] | None = None, tie: str = "id", strict: bool = False) -> DataFrame:
    """Islands of intervals that overlap or lie at most ``gap`` apart (less than, if ``strict``).

    Rows go by (start_us, end_us, tie), which must be distinct within ``keys``; ``aggs`` are further aggregates of an island's rows.
    """
    order = ["start_us", "end_us", tie]
    seen = running_max(df, keys, order, "end_us", "_seen")
    apart = F.col("start_us") - F.col("_seen")
    first = F.col("_seen").isNull() | ((apart >= gap) if strict else (apart > gap))
    so_far = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    island = seen.withColumn("_island", F.sum(F.when(first, 1).otherwise(0)).over(so_far))
    return island.groupBy(*keys, "_island").agg(F.min("start_us").alias("start_us"), F.max("end_us").alias("end_us"), *(aggs or [])).drop("_island")


def complement(df: DataFrame, keys: list[str], duration: int, least: int = 1, items: DataFrame | None = None) -> DataFrame:
    """What the intervals leave of [0, duration]; the whole of those ``items`` that have none."""
    return gaps(df, keys, duration, least, items)


def kept_between(df: DataFrame, keys: list[str], duration: int, gap: int, least: int) -> DataFrame:
    """(keys, start_us, end_us) of what is left of [0, duration] when the gaps between intervals that are longer than ``gap`` go.

    Parts of ``least`` or less go too, unless they are at an end. Keys without such a gap don't show. All windows have one order, so rows are sorted
    once; only a row after such a gap, and the last, tells of a part.
    """
    w = Window.partitionBy(*keys).orderBy("start_us", "id")
    long = lambda a, b: F.coalesce(b - a > gap, F.lit(False))
    end, start = F.lit(duration).cast("long"), F.col("start_us")
    spans = df.filter("start_us is not null").select(*keys, "start_us", "end_us", F.col("id").cast("long").alias("id"))
    seen = spans.withColumn("_seen", F.max("end_us").over(w.rowsBetween(Window.unboundedPreceding, -1))).withColumn("_last", F.lead("start_us").over(w).isNull())
    seen = seen.withColumn("_from", F.coalesce("_seen", F.lit(0).cast("long"))).withColumn("_gap", long(F.col("_from"), start)).filter("_gap or _last")
    told = seen.withColumn("_back", F.lag("start_us").over(w)).withColumn("_until", F.greatest("_seen", "end_us"))
    after = F.coalesce(F.when(F.col("_gap"), start), F.col("_back"), F.lit(0).cast("long"))
    ends = long(F.col("_until"), end)
    part = lambda a, b: F.struct(a.alias("start_us"), b.alias("end_us"))
    parts = F.array(
        F.when(F.col("_gap"), part(F.coalesce("_back", F.lit(0).cast("long")), F.col("_from"))),
        F.when(F.col("_last") & (F.col("_gap") | F.col("_back").isNotNull() | ends), part(after, F.when(ends, F.col("_until")).otherwise(end))),
    )
    return told.select(*keys, F.inline(F.array_compact(parts))).filter(f"end_us > start_us and (end_us - start_us > {least} or start_us = 0 or end_us = {duration})")


def held(points: DataFrame, spans: DataFrame, keys: list[str], at: str) -> DataFrame:
    """(keys, ``at``) of the points that any interval (start_us, end_us) holds, [start, end): both lie in one order, in which the ends so far tell."""
    both = points.select(*keys, F.col(at).alias("_t"), F.lit(1).alias("_p"), F.lit(None).cast("long").alias("_end"))
    both = both.unionByName(spans.select(*keys, F.col("start_us").alias("_t"), F.lit(0).alias("_p"), F.col("end_us").alias("_end")))
    ends = running_max(both, keys, ["_t", "_p"], "_end", "_ends", before=False)
    return ends.filter("_p = 1 and _ends > _t").select(*keys, F.col("_t").alias(at))


def _buckets(df: DataFrame, start: str, end: str, width: int) -> DataFrame:
    last = F.greatest(F.col(start), F.col(end) - 1)
    return df.withColumn("_bucket", F.explode(F.sequence(F.floor(F.col(start) / width).cast("long"), F.floor(last / width).cast("long"))))


def overlap_join(a: DataFrame, b: DataFrame, keys: list[str], width: int, closed: bool = False) -> DataFrame:
    """Pairs of overlapping intervals (strictly, or touching ones too if ``closed``).

    Columns of ``b`` other than ``keys`` must differ from those of ``a`` and have the names b_start_us and b_end_us.
    Each pair is kept in the first bucket that both reach.
    """
    shift = 1 if closed else 0
    left = _buckets(a.withColumn("_e", F.col("end_us") + shift), "start_us", "_e", width).drop("_e")
    right = _buckets(b.withColumn("_e", F.col("b_end_us") + shift), "b_start_us", "_e", width).drop("_e")
    met = left.join(right, [*keys, "_bucket"])
    touch = (F.col("start_us") <= F.col("b_end_us")) & (F.col("end_us") >= F.col("b_start_us")) if closed else (F.col("start_us") < F.col("b_end_us")) & (F.col("end_us") > F.col("b_start_us"))
    first = F.col("_bucket") == F.greatest(F.floor(F.col("start_us") / width), F.floor(F.col("b_start_us") / width))
    return met.filter(touch & first).drop("_bucket")


def point_join(points: DataFrame, spans: DataFrame, keys: list[str], at: str, width: int, closed: bool = False) -> DataFrame:
    """Points with the intervals (start_us, end_us) that hold them: [start, end), or [start, end] if ``closed``."""
    left = points.withColumn("_bucket", F.floor(F.col(at) / width).cast("long"))
    right = _buckets(spans.withColumn("_e", F.col("end_us") + (1 if closed else 0)), "start_us", "_e", width).drop("_e")
    inside = (F.col(at) >= F.col("start_us")) & ((F.col(at) <= F.col("end_us")) if closed else (F.col(at) < F.col("end_us")))
    return left.join(right, [*keys, "_bucket"]).filter(inside).drop("_bucket")


def contain_join(inner: DataFrame, outer: DataFrame, keys: list[str], width: int) -> DataFrame:
    """``inner`` rows (b_start_us, b_end_us) with the ``outer`` intervals (start_us, end_us) that hold them whole."""
    return point_join(inner, outer, keys, "b_start_us", width, closed=True).filter("b_end_us <= end_us")


def nearest(points: DataFrame, targets: DataFrame, keys: list[str], at: str, target: str, tolerance: int) -> DataFrame:
    """Each point with the nearest ``target`` within ``tolerance`` as ``nearest_us``, the earlier of two; null if none.

    ``points`` must be distinct on (keys, at).
    """
    left = points.withColumn("_bucket", F.explode(F.array(*(F.floor(F.col(at) / tolerance) + i for i in (-1, 0, 1)))))
    right = targets.select(*keys, target).withColumn("_bucket", F.floor(F.col(target) / tolerance)).distinct()
    close = left.join(right, [*keys, "_bucket"]).filter(F.abs(F.col(at) - F.col(target)) <= tolerance)
    best = close.groupBy(*keys, at).agg(F.min_by(target, F.struct(F.abs(F.col(at) - F.col(target)), F.col(target))).alias("nearest_us"))
    return points.join(best, [*keys, at], "left")


def neighbours(points: DataFrame, targets: DataFrame, keys: list[str], at: str, target: str) -> DataFrame:
    """Each point with the last target at or before it (``prev_us``) and the first after it (``next_us``), at any distance."""
    both = points.select(*keys, F.col(at).alias("_t"), F.lit(1).alias("_p"), F.struct(*points.columns).alias("_row"), F.lit(None).cast("long").alias("_target"))
    both = both.unionByName(targets.select(*keys, F.col(target).alias("_t"), F.lit(0).alias("_p"), F.col(target).alias("_target")).distinct(), allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy("_t", "_p")
    back, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(1, Window.unboundedFollowing)
    both = both.withColumn("prev_us", F.max("_target").over(back)).withColumn("next_us", F.first("_target", ignorenulls=True).over(ahead))
    return both.filter("_p = 1").select("_row.*", "prev_us", "next_us")
