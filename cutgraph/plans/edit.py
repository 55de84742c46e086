"""Entry points: edit, ask, revise, status and suite over a knowledge base."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import intervals as iv
from ..operators import sequential
from ..session import cut
from ..sources.kb import DURATION, KB
from . import intent as intents
from . import planner, requests, retrieve, revisions

M = ["media_id"]


@dataclass(frozen=True)
class Edit:
    intent: intents.Intent
    clips: DataFrame
    metrics: DataFrame
    failures: DataFrame


PAUSE_WORDS = ("silence", "silences", "pause", "pauses", "dead time", "dead air", "gap", "gaps")
FILLER_WORDS = ("filler", "fillers", "um", "ums", "uh", "uhs", "hesitations")


def channels(kb: KB, query: str) -> DataFrame:
    """Segments (media_id, start_us, end_us, score, source) of every channel that the query calls, over all media items."""
    if retrieve.times_of(query.lower(), DURATION) is not None:
        return retrieve.time_channel(kb, query.lower(), DURATION)
    known = requests.ways(kb, requests.complete(requests.of_every_item(kb, [query])))
    return requests.hits_of(kb, known).select("media_id", "start_us", "end_us", "score", "source")


def fused(kb: KB, query: str) -> DataFrame:
    """(media_id, start_us, end_us, score, evidence): the query's segments in every media item, by plans.requests; a stretch of time that it names is the whole answer."""
    if retrieve.times_of(query.lower(), DURATION) is not None:
        return retrieve.time_channel(kb, query.lower(), DURATION).withColumn("evidence", F.array("source")).drop("source")
    found = requests.retrieve_segments(kb, requests.of_every_item(kb, [query]))
    return cut(found.select("media_id", "start_us", "end_us", "score", F.col("sources").alias("evidence")))


def hits(kb: KB, op: intents.Operation) -> DataFrame:
    """Merged intervals that an operation is about; a negated one is about all the rest."""
    spans = fused(kb, op.query).select("media_id", "start_us", "end_us").distinct().withColumn("id", F.lit(0))
    merged = iv.merge(spans, M, 1_000_000)
    return iv.complement(merged.withColumn("id", F.lit(0)), M, DURATION, items=kb.media) if op.negation else merged


def selected(kb: KB, clips: DataFrame, target: int) -> DataFrame:
    """What of the clips fits ``target``: the parts of scenes within them, chosen by value within each media item."""
    scenes = kb.scenes.select("media_id", "id", F.col("start_us").alias("b_start_us"), F.col("end_us").alias("b_end_us"), F.col("intensity").alias("score"), "importance")
    parts = iv.overlap_join(clips.select("media_id", "start_us", "end_us"), scenes, M, 60_000_000)
    parts = parts.select("media_id", "id", F.greatest("start_us", "b_start_us").alias("start_us"), F.least("end_us", "b_end_us").alias("end_us"), "score", "importance").filter(F.col("end_us") - F.col("start_us") > planner.LEAST)
    parts = cut(parts)
    core = lambda rows: [{k: x[k] for k in ("id", "start_us", "end_us")} for x in sequential.budget_selection(rows, target)]
    chosen = cut(sequential.per_media(parts, "media_id", ["start_us", "id"], core, "media_id long, id long, start_us long, end_us long"))
    # the setups that chosen payoffs need come in, cut to what is left
    rest = parts.join(chosen.select("media_id", "id").distinct(), ["media_id", "id"], "left_anti").select("media_id", "id", "start_us", "end_us", F.lit(False).alias("kept"))
    return planner.repaired_selection(chosen.withColumn("kept", F.lit(True)).unionByName(rest), kb.story_needs, target).drop("id")


def snapped(kb: KB, clips: DataFrame) -> DataFrame:
    """Clips settled by the ladder of pauses and word edges; the item's own ends stay where they are."""
    ends = lambda c: F.when(F.col(c) <= 0, F.lit(0).cast("long")).when(F.col(c) >= DURATION, F.lit(DURATION).cast("long"))
    before = clips.groupBy("media_id").agg(F.min("start_us").alias("first"), F.max("end_us").alias("last"))
    out = planner.settled(clips.select("media_id", "start_us", "end_us"), kb.silences, kb.words)
    w = Window.partitionBy("media_id")
    out = out.withColumn("f", F.min("start_us").over(w)).withColumn("l", F.max("end_us").over(w)).join(before, "media_id")
    start = F.when(F.col("start_us") == F.col("f"), F.coalesce(ends("first"), "start_us")).otherwise(F.col("start_us"))
    end = F.when(F.col("end_us") == F.col("l"), F.coalesce(ends("last"), "end_us")).otherwise(F.col("end_us"))
    return out.select("media_id", start.alias("start_us"), end.alias("end_us"))


def with_floor(kb: KB, clips: DataFrame) -> DataFrame:
    """The clips; of a media item that has none left, a second or 5 % of it from the start."""
    bare = kb.lengths.join(clips.select("media_id").distinct(), M, "left_anti")
    end = F.least("duration_us", F.greatest(F.lit(1_000_000).cast("long"), F.expr("duration_us div 20")))
    return clips.unionByName(bare.select("media_id", F.lit(0).cast("long").alias("start_us"), end.alias("end_us")))


def edit(kb: KB, prompt: str) -> Edit:
    """Plan of a prompt for every media item: what stays in its order, its metrics and what the checks find wrong.

    Removals and filters leave clips; a target length selects among them; edges snap to pauses and words unless pauses or
    times decided them; clips are repaired, short ones dropped, fades and the sound's cuts set. Failures have the route that mends them. ``restructure`` only orders, ``stylize`` only sets the
    style. A question or an empty prompt leaves everything.
    """
    i = intents.parse(prompt)
    every = kb.media
    nothing = every.limit(0).select("media_id", F.lit(0).cast("long").alias("start_us"), F.lit(0).cast("long").alias("end_us"))
    remove, keep, exact, template = nothing, None, True, "chronological"
    for op in i.operations:
        exact = exact and (retrieve.says(op.query, (*PAUSE_WORDS, *FILLER_WORDS)) or retrieve.times_of(op.query, DURATION) is not None)
        if op.action == "remove":
            # as they are: removals aren't widened over what lies between
            found = fused(kb, op.query) if not op.negation else hits(kb, op)
            remove = remove.unionByName(found.select("media_id", "start_us", "end_us"))
        elif op.action in ("keep_only", "highlight"):
            found = hits(kb, op).select("media_id", "start_us", "end_us")
            keep = found if keep is None else keep.unionByName(found)
        elif op.action == "restructure":
            template = next((t for w, t in (("trailer", "trailer"), ("hook", "hook_first"), ("highlight", "highlight"), ("setup", "build_tension")) if w in op.query), template)
    gone = cut(planner.removals(remove, keep, DURATION, every))
    left = planner.within(iv.complement(gone.withColumn("id", F.lit(0)), M, DURATION, items=every), kb.lengths)
    target = i.target_us if i.target_us is not None else DURATION // 2 if any(op.action == "compress" for op in i.operations) else None
    if target is not None:
        left = selected(kb, left, target)
    elif not exact:
        left = snapped(kb, cut(left))
    left = cut(left)
    clips = planner.min_clip(planner.within(planner.repaired(with_floor(kb, left), DURATION), kb.lengths), 1_000_000)
    clips = planner.crossfades(clips)
    if template != "chronological":
        role = kb.scenes.select("media_id", F.col("start_us").alias("b_start_us"), F.col("end_us").alias("b_end_us"), "story_role", "intensity")
        first = iv.overlap_join(clips, role, M, 60_000_000).groupBy("media_id", "start_us").agg(F.min_by("story_role", "b_start_us").alias("role"), F.max("intensity").alias("score"))
        clips = planner.ordered(clips.join(first, ["media_id", "start_us"], "left").withColumn("score", F.coalesce("score", F.lit(0.0))).withColumn("id", F.col("start_us")), template)
    else:
        clips = planner.jl_offsets(clips, kb.scenes, kb.words)
    clips = cut(clips)
    m = planner.metrics(clips, kb.lengths)
    failed = lambda df, name, route: df.select("media_id", F.lit(name).alias("issue"), F.lit(route).alias("route"))
    shape = {"trailer": "trailer", "hook_first": "hook_first"}.get(template, "chronological")
    mode = "max" if retrieve.says(prompt, ("under", "less than")) else "approx"
    asked = every.select("media_id", F.lit(mode).alias("mode"), F.lit(i.target_us).cast("long").alias("target_us"), F.lit(any(op.action in ("compress", "keep_only") for op in i.operations)).alias("compressive"), F.lit(shape).alias("shape"))
    placed = clips if "pos" in clips.columns else clips.withColumn("pos", F.col("start_us"))
    failures = planner.target_failures(placed.select("media_id", "pos", "start_us", "end_us"), asked, DURATION)
    if template == "chronological":
        failures = failures.unionByName(failed(planner.midword(clips, kb.words, kb.lengths), "midword", "planner"))
    failures = failures.unionByName(failed(planner.leftovers(clips, remove), "leftover", "retrieval"))
    return Edit(i, clips, m, failures)


def ask(kb: KB, question: str, k: int = 10) -> DataFrame:
    """The best segments of all channels, fused; each with the sources that found it."""
    return fused(kb, question).orderBy(F.desc("score"), "media_id", "start_us", "end_us").limit(k)


def revise(kb: KB, clips: DataFrame, prompt: str) -> DataFrame:
    """The timelines (media_id, pos, start_us, end_us) after the delta that the prompt asks for, in every media item; see plans.revisions."""
    requests_ = clips.select("media_id").distinct().withColumn("prompt", F.lit(prompt))
    return revisions.revised(clips, requests_, kb.lengths)


def status(kb: KB) -> DataFrame:
    """Counts of a knowledge base."""
    s = kb.scenes.agg(F.count("*").alias("scenes"))
    return s.crossJoin(kb.utterances.agg(F.count("*").alias("utterances"))).crossJoin(kb.appearances.agg(F.count("*").alias("relations")))


def suite(kb: KB, prompts: list[str]) -> dict[str, Edit]:
    """An edit per prompt, one after the other. Each runs its retrieval and cuts its lineage as it is planned; the metrics and failures are lazy."""
    return {p: edit(kb, p) for p in prompts}
