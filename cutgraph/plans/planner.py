"""The deterministic planner: removals to kept clips, snapping, repair, fades and metrics.

Clips are rows (media_id, start_us, end_us); everything is set-based but the fixed point and the repair of selections, which are
cores of operators.sequential run per media item.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators import intervals as iv
from ..operators import sequential

M = ["media_id"]
#: Clips shorter than this aren't kept after clamping.
LEAST = 10_000
# Aspect ratios of platforms.
ASPECTS = {"tiktok": "9:16", "reels": "9:16", "youtube": "16:9", "youtube_shorts": "9:16"}


def clamped(df: DataFrame, duration: int) -> DataFrame:
    """Within [0, duration]; clips of LEAST or less go."""
    c = df.withColumn("start_us", F.greatest("start_us", F.lit(0))).withColumn("end_us", F.least("end_us", F.lit(duration).cast("long")))
    return c.filter(F.col("end_us") - F.col("start_us") > LEAST)


def removals(remove: DataFrame, keep_only: DataFrame | None, duration: int, items: DataFrame | None = None) -> DataFrame:
    """What goes: the hits of 'remove', and what a positive filter doesn't hit; merged at LEAST.

    With a filter, ``items`` are all media items: one without a hit goes as a whole.
    """
    parts = remove.select("media_id", "start_us", "end_us")
    if keep_only is not None:
        kept = iv.merge(keep_only.select("media_id", "start_us", "end_us").distinct().withColumn("id", F.lit(0)), M, 100_000)
        parts = parts.unionByName(iv.complement(kept.withColumn("id", F.lit(0)), M, duration, items=items))
    return iv.merge(clamped(parts, duration).distinct().withColumn("id", F.lit(0)), M, LEAST)


def min_clip(clips: DataFrame, least: int) -> DataFrame:
    """Clips of ``least`` or more; of an item with none, its longest (the first of equal ones)."""
    d = F.col("end_us") - F.col("start_us")
    longest = clips.groupBy(*M).agg(F.max_by("start_us", F.struct(d, -F.col("start_us"))).alias("_s"), F.max(d).alias("_d"))
    return clips.join(longest, M).filter((d >= least) | ((F.col("_d") < least) & (F.col("start_us") == F.col("_s")))).drop("_s", "_d")


def repaired(clips: DataFrame, duration: int) -> DataFrame:
    """Sorted and clamped clips whose starts are moved to the end of what came before."""
    seen = iv.running_max(clamped(clips.select("media_id", "start_us", "end_us"), duration).distinct(), M, ["start_us", "end_us"], "end_us", "_seen")
    moved = seen.withColumn("start_us", F.greatest("start_us", F.coalesce("_seen", "start_us"))).drop("_seen")
    return moved.filter(F.col("end_us") - F.col("start_us") > LEAST)


def fade_filter(start: Column, end: Column, fade_in: Column, fade_out: Column) -> Column:
    """A renderer's text that cuts a clip's sound and fades it: fades are half the clip at most, those of a millisecond or less are left out; whole milliseconds."""
    seconds = lambda us: F.concat(F.floor(us / 1_000_000).cast("string"), F.lit("."), F.lpad((F.floor(us / 1000) % 1000).cast("string"), 3, "0"))
    length = F.greatest(end - start, F.lit(0))
    half = F.floor(length / 2)
    fade = lambda us: F.least(us, half)
    into, out = fade(fade_in), fade(fade_out)
    return F.concat(
        F.lit("atrim="), seconds(start), F.lit(":"), seconds(end), F.lit(",asetpts=PTS-STARTPTS"),
        F.when(into > 1000, F.concat(F.lit(",afade=t=in:d="), seconds(into))).otherwise(""),
        F.when(out > 1000, F.concat(F.lit(",afade=t=out:st="), seconds(length - out), F.lit(":d="), seconds(out))).otherwise(""),
    )


def render_issue(actual_us: Column, expected_us: Column, sound_us: Column) -> Column:
    """What is wrong with a rendered file: drift (its length is over 2 % and over 250 ms off), sync (sound and picture begin over 100 ms apart), or null."""
    off = F.abs(actual_us - expected_us)
    drift = (off * 50 > F.greatest(expected_us, F.lit(100_000))) & (off > 250_000)
    return F.when(drift, "drift").when(F.abs(sound_us) > 100_000, "sync")


def kept_story(clips: DataFrame, words: DataFrame, scenes: DataFrame, caption: str, width: int = 10_000_000) -> DataFrame:
    """(media_id, start_us, end_us, scenes, words): for each kept clip the captions of the scenes that it shows for over .5 s, and the words whole within it, in order.

    A clip that has neither is left out. ``scenes`` have (media_id, id, start_us, end_us) and the column ``caption``.
    """
    keep = clips.select("media_id", "start_us", "end_us").distinct()
    shown = scenes.select("media_id", F.col("id").alias("scene_id"), F.coalesce(caption, F.lit("")).alias("caption"), F.col("start_us").alias("b_start_us"), F.col("end_us").alias("b_end_us"))
    met = iv.overlap_join(keep, shown, M, width).filter(F.least("end_us", "b_end_us") - F.greatest("start_us", "b_start_us") > 500_000)
    text = lambda rows, field, by: F.array_join(F.transform(F.array_sort(rows), lambda s: s[field]), by)
    seen = met.groupBy("media_id", "start_us", "end_us").agg(text(F.collect_list(F.struct("b_start_us", "scene_id", "caption")), "caption", " | ").alias("scenes"))
    said = iv.point_join(words.select("media_id", F.col("start_us").alias("t"), F.col("end_us").alias("until"), "utt_id", "idx", "word"), keep, M, "t", width).filter("until <= end_us")
    said = said.groupBy("media_id", "start_us", "end_us").agg(text(F.collect_list(F.struct("t", "utt_id", "idx", "word")), "word", " ").alias("words"))
    return seen.join(said, ["media_id", "start_us", "end_us"], "full").select("media_id", "start_us", "end_us", F.coalesce("scenes", F.lit("")).alias("scenes"), F.coalesce("words", F.lit("")).alias("words"))


def crossfades(clips: DataFrame, inner: int = 80_000, outer: int = 120_000) -> DataFrame:
    """fade_in_us and fade_out_us by position: ``outer`` at the playlist's ends, ``inner`` between, half the clip at most."""
    w = Window.partitionBy(*M).orderBy("start_us")
    half = F.expr("(end_us - start_us) div 2")
    fade = lambda edge: F.least(F.when(edge, outer).otherwise(inner).cast("long"), half)
    c = clips.withColumn("_first", F.lag("start_us").over(w).isNull()).withColumn("_last", F.lead("start_us").over(w).isNull())
    return c.withColumn("fade_in_us", fade(F.col("_first"))).withColumn("fade_out_us", fade(F.col("_last"))).drop("_first", "_last")


def metrics(clips: DataFrame, duration: int | DataFrame) -> DataFrame:
    """(media_id, kept_us, removal_ratio, clip_count); ``duration`` is that of all items, or a table (media_id, duration_us)."""
    kept = F.sum(F.col("end_us") - F.col("start_us"))
    g = clips.groupBy(*M).agg(kept.alias("kept_us"), F.count("*").alias("clip_count"))
    g = g.join(duration, "media_id") if isinstance(duration, DataFrame) else g.withColumn("duration_us", F.lit(duration).cast("long"))
    return g.withColumn("removal_ratio", F.floor((1 - F.col("kept_us") / F.col("duration_us")) * 1e4 + 0.5) / 1e4).drop("duration_us")


def jl_offsets(clips: DataFrame, scenes: DataFrame, words: DataFrame, near: int = 500_000, most: int = 80_000, lead: int = 120_000) -> DataFrame:
    """``audio_start_us`` of each clip (media_id, start_us, end_us) in the order of the source.

    Near a scene boundary the sound's cut moves towards it, ``most`` at the farthest. Else the sound leads by ``lead``, but not into the clip before nor over a word. An item's first
    clip has its sound cut where its picture is.
    """
    w = Window.partitionBy(*M).orderBy("start_us")
    c = clips.select("media_id", F.col("start_us").alias("t"), F.lag("end_us").over(w).alias("before"))
    bounds = scenes.select("media_id", F.col("start_us").alias("u")).union(scenes.select("media_id", "end_us"))
    at = iv.nearest(c.select("media_id", "t").distinct(), bounds, M, "t", "u", near)
    lap = c.filter("before is not null").select("media_id", "t", F.greatest("before", F.col("t") - lead).alias("start_us"), F.col("t").alias("end_us")).filter("start_us < end_us")
    heard = words.select("media_id", F.col("start_us").alias("b_start_us"), F.col("end_us").alias("b_end_us"))
    free = lap.join(iv.overlap_join(lap, heard, M, 2_000_000).select("media_id", "t").distinct(), [*M, "t"], "left_anti").select("media_id", "t", F.col("start_us").alias("lap"))
    d = F.col("nearest_us") - F.col("t")
    audio = F.when(F.col("before").isNull(), F.col("t")).when(d != 0, F.col("t") + F.signum(d).cast("long") * F.least(F.abs(d), F.lit(most))).otherwise(F.coalesce("lap", "t"))
    found = c.join(at, [*M, "t"]).join(free, [*M, "t"], "left").select("media_id", F.col("t").alias("start_us"), audio.cast("long").alias("audio_start_us"))
    return clips.join(found, [*M, "start_us"])


def within(clips: DataFrame, lengths: DataFrame) -> DataFrame:
    """Clips of items (media_id, duration_us), none beyond its item's end."""
    held = clips.join(lengths, "media_id").withColumn("end_us", F.least("end_us", "duration_us"))
    return held.filter(F.col("end_us") - F.col("start_us") > LEAST).drop("duration_us")


def leftovers(clips: DataFrame, gone: DataFrame, least: int = 500_000) -> DataFrame:
    """media_id of the items whose clips still have more than ``least`` of something that was to go."""
    hits = gone.select("media_id", F.col("start_us").alias("b_start_us"), F.col("end_us").alias("b_end_us"))
    met = iv.overlap_join(clips.select("media_id", "start_us", "end_us"), hits, M, 10_000_000)
    return met.filter(F.least("end_us", "b_end_us") - F.greatest("start_us", "b_start_us") > least).select("media_id").distinct()


def midword(clips: DataFrame, words: DataFrame, lengths: DataFrame, edge: int = 40_000) -> DataFrame:
    """media_id of the items with a cut more than ``edge`` within a word; the item's own ends are no cuts."""
    ends = clips.join(lengths, "media_id").select("media_id", F.explode(F.array_compact(F.array(F.when(F.col("start_us") > 0, F.col("start_us")), F.when(F.col("end_us") < F.col("duration_us"), F.col("end_us"))))).alias("t"))
    inside = words.select("media_id", (F.col("start_us") + edge + 1).alias("start_us"), (F.col("end_us") - edge).alias("end_us")).filter("end_us > start_us")
    return iv.point_join(ends, inside, M, "t", 2_000_000).select("media_id").distinct()


def target_failures(clips: DataFrame, asked: DataFrame, duration: int) -> DataFrame:
    """(media_id, issue, route) of what is wrong with plans (media_id, pos, start_us, end_us) for requests (media_id, mode, target_us, compressive, shape).

    A target is a maximum, exact to 2 s, or approximate, which a plan may exceed by 15 %; one second must stay; more than 98 % may only go if compression is asked for; and a
    hook-first or trailer cut of several clips must not be in the order of its source.
    """
    w = Window.partitionBy(*M).orderBy("pos")
    rising = clips.withColumn("_back", F.col("start_us") < F.lag("start_us").over(w))
    plan = rising.groupBy(*M).agg(F.sum(F.col("end_us") - F.col("start_us")).alias("kept"), F.count("*").alias("n"), F.coalesce(F.bool_or("_back"), F.lit(False)).alias("moved")).join(asked, "media_id")
    kept, target = F.col("kept"), F.col("target_us")
    over = F.when(F.col("mode") == "max", kept > target).when(F.col("mode") == "exact", F.abs(kept - target) > 2_000_000).otherwise(100 * kept > 115 * target)
    issue = lambda cond, name, route: F.when(cond, F.struct(F.lit(name).alias("issue"), F.lit(route).alias("route")))
    found = F.array(
        issue(over, "duration", "story"), issue(kept < 1_000_000, "floor", "planner"), issue((1 - kept / duration > 0.98) & ~F.coalesce("compressive", F.lit(False)), "ratio", "story"),
        issue(F.col("shape").isin("hook_first", "trailer") & (F.col("n") > 1) & ~F.col("moved"), "order", "story"),
    )
    return plan.select("media_id", F.inline(F.array_compact(found)))


def snap_ladder(points: DataFrame, affinity: DataFrame, silences: DataFrame, words: DataFrame, window: int = 400_000) -> DataFrame:
    """``snapped_us`` of each point (media_id, t, soft): where a cut should move.

    In turn: the best sample of the affinity curve within ``window``, if not negative and more than 50 ms away;
    unless the point is ``soft`` (already from a pause) the middle of the nearest silence of 300 ms or more that lies
    in the window and in no word; the middle of the nearest gap of 120 ms or more between words; the nearest word edge; the point.
    """
    at = points.select(*M, "t").distinct()
    near = at.withColumn("_b", F.explode(F.array(*(F.floor(F.col("t") / window) + i for i in (-1, 0, 1)))))
    curve = affinity.withColumn("_b", F.floor(F.col("t_us") / window))
    best = near.join(curve, [*M, "_b"]).filter(F.abs(F.col("t_us") - F.col("t")) <= window).groupBy(*M, "t").agg(F.max_by(F.struct("t_us", "score"), F.struct("score", -F.abs(F.col("t_us") - F.col("t")), -F.col("t_us"))).alias("a"))
    best = best.filter((F.col("a.score") >= 0) & (F.abs(F.col("a.t_us") - F.col("t")) > 50_000)).select(*M, "t", F.col("a.t_us").alias("by_affinity"))
    quiet = silences.filter("end_us - start_us >= 300000").select(*M, F.expr("(start_us + end_us) div 2").alias("u")).distinct()
    inside = words.select(*M, (F.col("start_us") + 15_001).alias("start_us"), (F.col("end_us") - 15_000).alias("end_us")).filter("end_us > start_us")
    quiet = quiet.join(iv.point_join(quiet, inside, M, "u", 2_000_000).select(*M, "u").distinct(), [*M, "u"], "left_anti")
    w = Window.partitionBy(*M).orderBy("start_us", "end_us")
    between = words.select(*M, F.col("end_us").alias("a"), F.lead("start_us").over(w).alias("b")).filter("b - a >= 120000").select(*M, F.expr("(a + b) div 2").alias("u"))
    edges = words.select(*M, F.col("start_us").alias("u")).union(words.select(*M, "end_us"))
    out = points.join(best, [*M, "t"], "left")
    for name, targets in (("by_silence", quiet), ("by_gap", between), ("by_edge", edges)):
        out = out.join(iv.nearest(at, targets, M, "t", "u", window).withColumnRenamed("nearest_us", name), [*M, "t"], "left")
    silence: Column = F.when(~F.col("soft"), F.col("by_silence"))
    return out.withColumn("snapped_us", F.coalesce("by_affinity", silence, "by_gap", "by_edge", "t")).drop("by_affinity", "by_silence", "by_gap", "by_edge")


def settled(clips: DataFrame, silences: DataFrame, words: DataFrame, affinity: DataFrame | None = None, micro: int = 300_000, least: int = 1_000_000) -> DataFrame:
    """Clips after merging micro gaps, dropping short ones and snapping edges by the ladder until nothing changes, five rounds at most.

    The targets of a media item come with its clips, so each item is one pass over sorted rows.
    """
    part = lambda df, kind, a, b: df.select("media_id", F.lit(kind).alias("kind"), F.col(a).alias("a"), F.col(b).cast("double").alias("b"))
    rows = part(clips, 0, "start_us", "end_us").unionByName(part(silences, 1, "start_us", "end_us")).unionByName(part(words, 2, "start_us", "end_us"))
    if affinity is not None:
        rows = rows.unionByName(part(affinity, 3, "t_us", "score"))
    # items without clips have nothing to settle
    rows = rows.join(clips.select("media_id").distinct(), "media_id", "left_semi")

    def core(rows: list[dict]) -> list[dict]:
        of = lambda k: [(r["a"], int(r["b"])) for r in rows if r["kind"] == k]
        ladder = sequential.Ladder(of(1), of(2), [(r["a"], r["b"]) for r in rows if r["kind"] == 3])
        return [{"start_us": a, "end_us": b} for a, b in sequential.settled(of(0), ladder.snap, micro, least)]

    return sequential.per_media(rows, "media_id", ["kind", "a", "b"], core, "media_id long, start_us long, end_us long")


def repaired_selection(items: DataFrame, needs: DataFrame, target: int | None, swaps: DataFrame | None = None) -> DataFrame:
    """(media_id, id, start_us, end_us) of the items to keep, from (media_id, id, start_us, end_us, kept).

    ``swaps`` (media_id, pos, gone, come), if any, are applied first, all or none; then ``needs`` (media_id, pos, setup, payoff) pull the setups of
    kept payoffs in, cut to what the target leaves.
    """
    none = F.lit(None).cast("long")
    item = items.select("media_id", F.lit(0).alias("kind"), F.col("id").cast("long").alias("x"), none.alias("y"), "start_us", "end_us", "kept")
    link = lambda df, kind, a, b: df.select("media_id", F.lit(kind).alias("kind"), F.col(a).cast("long").alias("x"), F.col(b).cast("long").alias("y"), F.col("pos").cast("long").alias("start_us"), none.alias("end_us"), F.lit(None).cast("boolean").alias("kept"))
    rows = item.unionByName(link(needs, 1, "setup", "payoff"))
    if swaps is not None:
        rows = rows.unionByName(link(swaps, 2, "gone", "come"))

    def core(rows: list[dict]) -> list[dict]:
        of = lambda k: [r for r in rows if r["kind"] == k]
        every = [{"id": r["x"], "start_us": r["start_us"], "end_us": r["end_us"], "kept": r["kept"]} for r in of(0)]
        kept, dropped = [x for x in every if x["kept"]], [x for x in every if not x["kept"]]
        links = [(r["x"], r["y"]) for r in of(1)]
        kept = sequential.swapped(kept, dropped, [(r["x"], r["y"]) for r in of(2)], links, target)
        have = {x["id"] for x in kept}
        kept, _ = sequential.closed(kept, [x for x in every if x["id"] not in have], links, target)
        return [{k: x[k] for k in ("id", "start_us", "end_us")} for x in kept]

    return sequential.per_media(rows, "media_id", ["kind", "start_us", "x"], core, "media_id long, id long, start_us long, end_us long")


def ordered(segments: DataFrame, template: str) -> DataFrame:
    """``pos`` of each segment (media_id, id, start_us, score, role) by a narrative template.

    chronological; hook_first; trailer (hooks and climaxes, the body by score, outros); highlight; build_tension.
    """
    role, start, score = F.col("role"), F.col("start_us"), F.col("score")
    keys = {
        "chronological": [start],
        "hook_first": [F.when(role == "hook", 0).otherwise(1), start],
        "trailer": [F.when(role == "hook", 0).when(role == "climax", 1).when(role == "outro", 3).otherwise(2), F.when(role.isin("hook", "climax", "outro"), F.lit(0.0)).otherwise(-score), start],
        "highlight": [-score, start],
        "build_tension": [score, start],
    }[template]
    filled = segments.withColumn("role", F.coalesce("role", F.lit("")))
    return filled.withColumn("pos", F.row_number().over(Window.partitionBy(*M).orderBy(*keys, "id")) - 1)
