"""Revisions of many timelines at once: one delta a media item, as the prompt says, and which clips it makes new.

A timeline is rows (media_id, pos, start_us, end_us), clips in the order of ``pos``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .planner import LEAST

S = 1_000_000
# Words of deltas; what a clip loses or wins without a number, its least length, and the restored intro.
DROP, RESTORE = ("remove", "delete", "drop"), ("restore", "keep", "put back", "bring back", "add back")
TOPICS = ("pricing", "cost", "rates")
SWAP, SHORTER, LONGER = ("swap", "reorder"), ("shorter", "shrink"), ("longer", "extend")
STEP, KEPT, INTRO, BEGUN = 2 * S, S, 5 * S, S // 10


def _any(words: tuple[str, ...]) -> str:
    return rf"\b(?:{'|'.join(w.replace(' ', r'\s+') for w in words)})\b"


def delta(prompt: Column) -> Column:
    """drop, restore, content, swap, shorter or longer: the first of these that a prompt asks for; else none. ``content`` is what only a new edit can do."""
    p = F.lower(F.trim(prompt))
    says = lambda pattern: F.coalesce(F.regexp_like(p, F.lit(pattern)), F.lit(False))
    return (
        F.when(says(rf"{_any(DROP)}\s+(?:the\s+)?first\s+clip\b"), "drop")
        .when(says(rf"{_any(RESTORE)}.*{_any(('first clip', 'intro'))}"), "restore")
        .when(says(rf"{_any((*DROP[:2], 'cut'))}.*{_any(TOPICS)}"), "content")
        .when(says(_any(SWAP)), "swap")
        .when(says(_any(SHORTER)), "shorter")
        .when(says(_any(LONGER)), "longer")
        .otherwise("none")
    )


def longer_by(prompt: Column) -> Column:
    """Microseconds of the last number of seconds after "longer" or "extend"; two seconds without one."""
    told = F.regexp_extract(F.lower(prompt), rf"{_any(LONGER)}.*\b(\d+)\s*s", 1).try_cast("long")
    return F.coalesce(told * S, F.lit(STEP))


def revised(clips: DataFrame, requests: DataFrame, lengths: DataFrame) -> DataFrame:
    """(media_id, pos, start_us, end_us, dirty): the timelines after ``requests`` (media_id, prompt), one an item at most.

    drop: without the first clip. restore: what comes before the first clip in the source, or where that begins within .1 s the least of 5 s and a tenth of the
    item; a second at least; also for an item without clips. swap: the first two change places. shorter: the first clip loses 2 s, a second of it stays.
    longer: it wins the seconds named. Clips then end within the item (``lengths``: media_id, duration_us), and ones of LEAST or less go unless all are such.
    ``dirty`` marks what must be rendered: all clips after drop and restore, both after a swap, else the first. Items without a request keep their clips as they are, also
    beyond the item's end; null prompts ask for nothing. Places are numbered from 0 again. Everything is by media item, in one exchange.
    """
    w = Window.partitionBy("media_id").orderBy("pos", "start_us", "end_us")
    asked = requests.select("media_id", delta(F.col("prompt")).alias("delta"), longer_by(F.col("prompt")).alias("more")).join(lengths.select("media_id", "duration_us"), "media_id")
    placed = clips.select("media_id", "pos", "start_us", "end_us").withColumn("at", F.row_number().over(w) - 1).withColumn("last", F.lead("pos").over(w).isNull())
    c = placed.join(asked, "media_id", "left")
    is_ = lambda name: F.coalesce(F.col("delta") == name, F.lit(False))
    first = F.col("at") == 0
    alone = first & F.col("last")
    end = F.when(is_("shorter") & first, F.greatest(F.col("start_us") + KEPT, F.col("end_us") - STEP)).when(is_("longer") & first, F.col("end_us") + F.col("more")).otherwise(F.col("end_us"))
    at = F.when(is_("swap") & first & ~alone, 1).when(is_("swap") & (F.col("at") == 1), 0).otherwise(F.col("at"))
    dirty = is_("drop") | is_("restore") | (is_("swap") & (F.col("at") < 2) & ~alone) | ((is_("shorter") | is_("longer")) & first)
    kept = c.filter(~(is_("drop") & first)).select("media_id", at.alias("at"), "start_us", end.alias("end_us"), dirty.alias("dirty"), "duration_us")
    begin = placed.filter("at = 0").select("media_id", F.col("start_us").alias("begin"))
    before = F.when(F.col("begin") > BEGUN, F.col("begin")).otherwise(F.least(F.lit(INTRO), F.expr("duration_us div 10")))
    intro = asked.filter("delta = 'restore'").join(begin, "media_id", "left").select("media_id", F.lit(-1).alias("at"), F.lit(0).cast("long").alias("start_us"), F.greatest(before, F.lit(KEPT)).cast("long").alias("end_us"), F.lit(True).alias("dirty"), "duration_us")
    bound = lambda low, x: F.when(F.col("duration_us").isNull(), x).otherwise(F.greatest(low, F.least(x, F.col("duration_us"))))
    new = kept.unionByName(intro).withColumn("start_us", bound(F.lit(0), F.col("start_us"))).withColumn("end_us", bound(F.col("start_us"), F.col("end_us")))
    good = F.col("duration_us").isNull() | (F.col("end_us") - F.col("start_us") > LEAST)
    new = new.withColumn("good", good).withColumn("some", F.max("good").over(Window.partitionBy("media_id"))).filter("good or not some")
    again = F.row_number().over(Window.partitionBy("media_id").orderBy("at")) - 1
    return new.select("media_id", again.alias("pos"), "start_us", "end_us", "dirty")
