"""The knowledge base: tables of time intervals, series, graph edges and texts over many media items.

Times are integer microseconds; ``media_id`` comes first in every table. ``from_tables`` derives one from the
generic test tables; ``read`` and ``write`` keep one as Parquet, partitioned by nothing and sorted by media and
start, so that row groups can be skipped.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import intervals
from ..operators.sequences import interpolated_words

#: Length of every media item of the test tables, in microseconds; no item of another knowledge base may be longer.
DURATION = 2_600_000_000
SOUNDS = {"click": "laughter", "view": "music", "purchase": "applause", "signup": "gasp", "error": "cough"}
EMOTIONS = ("happy", "joy", "sad", "angry", "amused", "excited", "neutral", "tense")
ROLES = ("hook", "setup", "development", "climax", "payoff", "outro", "intro", "transition", None)
OBJECTS = ("phone", "laptop", "whiteboard", "cup", "book", "camera", "screen", "microphone")
TOPICS = ("pricing", "travel", "family", "sport", "music", "other things")
SOURCES = {"click": "faces", "view": "vision", "purchase": "graph", "signup": "vision", "error": None}


def chosen(column: F.Column, cases: dict) -> F.Column:
    """CASE over literal cases."""
    out = F.lit(None).cast("string")
    for k, v in cases.items():
        out = F.when(column == k, F.lit(v)).otherwise(out)
    return out


class KB:
    """A knowledge base derived from the test tables of ``sf_dir``; every table is a lazy DataFrame."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def signals(self) -> DataFrame:
        """Every event as an interval."""
        start = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'2024-01-01 00:00:00', ts) div 1000")
        return self.table("events").select(
            F.col("user_id").alias("media_id"), F.col("event_id").alias("id"), "user_id", "event_type", "value", "props",
            start.alias("start_us"), (start + F.floor(F.col("value") * 100 + 0.5).cast("long") * 200).alias("end_us"),
        )

    @cached_property
    def items(self) -> DataFrame:
        """The media items that have signals."""
        return self.signals.select("media_id").distinct()

    @cached_property
    def media(self) -> DataFrame:
        """All media items, those with words alone too."""
        return self.items.union(self.table("conversations").select(F.col("conv_id").alias("media_id"))).distinct()

    @cached_property
    def lengths(self) -> DataFrame:
        """(media_id, duration_us) of all media items; those of the test tables are as long as each other."""
        return self.media.select("media_id", F.lit(DURATION).cast("long").alias("duration_us"))

    @cached_property
    def silences(self) -> DataFrame:
        return intervals.gaps(self.signals, ["media_id"], DURATION, 300_000)

    @cached_property
    def audio_events(self) -> DataFrame:
        return self.signals.select("media_id", "id", chosen(F.col("event_type"), SOUNDS).alias("type"), "start_us", "end_us", F.least(F.col("value") / 100, F.lit(1.0)).alias("confidence"))

    @cached_property
    def scenes(self) -> DataFrame:
        """Scenes begin at signups and last until the next."""
        s = intervals.with_next(self.signals.filter("event_type = 'signup'"), ["media_id"], "start_us", "id", DURATION)
        i = F.col("id")
        return s.select(
            "media_id", "id", "start_us", F.col("next_us").alias("end_us"), (F.col("value") > 80).alias("is_broll"), F.when(i % 3 != 2, i % 3 == 1).alias("indoor"),
            F.concat(F.lit("loc"), (i % 6).cast("string")).alias("location"), chosen(i % 8, dict(enumerate(EMOTIONS))).alias("emotion"), F.least(F.col("value") / 100, F.lit(1.0)).alias("intensity"),
            (F.col("value") / 500).alias("importance"), chosen(i % 9, dict(enumerate(ROLES))).alias("story_role"), ((i % 97) / 97).alias("motion"), chosen(i % 3, {0: "wide", 1: "close", 2: "medium"}).alias("shot_type"),
        )

    @cached_property
    def appearances(self) -> DataFrame:
        """Relations: each event's person appears in the scene that its start falls in."""
        point = self.signals.select("media_id", F.col("id").alias("event_id"), "user_id", "event_type", "value", F.col("start_us").alias("t_us"))
        inside = intervals.point_join(point, self.scenes.select("media_id", F.col("id").alias("scene_id"), "start_us", "end_us"), ["media_id"], "t_us", 32_000_000)
        return inside.select("media_id", F.concat(F.lit("person:"), F.col("user_id").cast("string")).alias("src"), F.lit("appears_in").alias("rel"), F.concat(F.lit("scene:"), F.col("scene_id").cast("string")).alias("dst"), "scene_id", "t_us", F.least(F.col("value") / 100, F.lit(1.0)).alias("confidence"), chosen(F.col("event_type"), SOURCES).alias("source"))

    @cached_property
    def utterances(self) -> DataFrame:
        """Turns of conversations, each as long as its text, with a gap before."""
        u = self.table("conversations").select(F.col("conv_id").alias("media_id"), F.col("turn").alias("id"), F.col("role").alias("speaker"), "text", (F.length("text") * F.lit(66667)).cast("long").alias("dur_us"), (((F.col("conv_id") * 7 + F.col("turn") * 13) % 5) * 700_000).alias("gap_us"))
        u = intervals.running_sum(u.withColumn("step_us", F.col("dur_us") + F.col("gap_us")), ["media_id"], "id", "step_us", "end_us")
        act = chosen(F.col("id") % 3, {0: "question", 1: "answer", 2: "statement"})
        return u.select("media_id", "id", "speaker", "text", (F.col("end_us") - F.col("dur_us")).alias("start_us"), "end_us", act.alias("dialogue_act"))

    @cached_property
    def words(self) -> DataFrame:
        return interpolated_words(self.utterances)

    @cached_property
    def vectors(self) -> DataFrame:
        return self.table("embeddings").select("vec_id", "label", "embedding")

    @cached_property
    def people(self) -> DataFrame:
        """(media_id, entity_id, label, is_owner): those who appear; the owner does most often."""
        n = self.appearances.groupBy("media_id", F.col("src").alias("entity_id")).agg(F.count("*").alias("n"))
        first = F.row_number().over(Window.partitionBy("media_id").orderBy(F.desc("n"), "entity_id"))
        return n.select("media_id", "entity_id", F.concat(F.lit("guest "), F.regexp_extract("entity_id", "[0-9]+", 0)).alias("label"), (first == 1).alias("is_owner"))

    @cached_property
    def objects(self) -> DataFrame:
        """(media_id, label, scene_id, confidence): what was seen in scenes."""
        seen = self.signals.filter("event_type in ('view', 'signup')").select("media_id", "id", "value", F.col("start_us").alias("t_us"))
        inside = intervals.point_join(seen, self.scenes.select("media_id", F.col("id").alias("scene_id"), "start_us", "end_us"), ["media_id"], "t_us", 32_000_000)
        return inside.select("media_id", F.element_at(F.array(*map(F.lit, OBJECTS)), (F.col("id") % len(OBJECTS) + 1).cast("int")).alias("label"), "scene_id", F.least(F.col("value") / 100, F.lit(1.0)).alias("confidence"))

    @cached_property
    def unsure(self) -> DataFrame:
        """(media_id, scene_id) of the sightings that need verification: of objects that an item shows once."""
        n = self.objects.groupBy("media_id", "label").agg(F.count("*").alias("n"), F.min("scene_id").alias("scene_id"))
        return n.filter("n = 1").select("media_id", "scene_id").distinct()

    @cached_property
    def topics(self) -> DataFrame:
        """(media_id, label, class, start_us, end_us), one a scene."""
        i = F.col("id")
        pick = lambda xs: F.element_at(F.array(*map(F.lit, xs)), (i % len(xs) + 1).cast("int"))
        return self.scenes.select("media_id", "id", pick(TOPICS).alias("label"), pick(("demo", "other", "sponsor", "review")).alias("class"), "start_us", "end_us")

    @cached_property
    def story_needs(self) -> DataFrame:
        """(media_id, pos, setup, payoff): scenes of setups and payoffs, each with the one before it."""
        w = Window.partitionBy("media_id").orderBy("start_us", "id")
        d = self.scenes.filter("story_role in ('setup', 'payoff')").select("media_id", "start_us", "id", F.lag("id").over(w).alias("setup"))
        return d.filter("setup is not null").select("media_id", F.col("start_us").alias("pos"), "setup", F.col("id").alias("payoff"))

    @cached_property
    def scene_vectors(self) -> DataFrame:
        """(media_id, scene_id, embedding): a vector of the table for each scene."""
        return self.scenes.select("media_id", F.col("id").alias("scene_id"), (F.col("id") % 500).alias("vec_id")).join(self.vectors.select("vec_id", "embedding"), "vec_id").drop("vec_id")


def write(tables: dict[str, DataFrame], path: str) -> None:
    """Each table as Parquet, sorted within files by media and start."""
    for name, df in tables.items():
        order = [c for c in ("media_id", "start_us", "t_us", "id") if c in df.columns]
        (df.sortWithinPartitions(*order) if order else df).write.mode("overwrite").parquet(f"{path}/{name}")


def read(spark: SparkSession, path: str, names: list[str]) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{path}/{n}") for n in names}


def upsert(old: DataFrame, new: DataFrame, keys: list[str], version: str) -> DataFrame:
    """Last write wins: per key the row with the greatest ``version``; new rows win ties."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    rest = [c for c in old.columns if c not in keys]
    best = both.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(F.col(version), F.col("_new"))).alias("r"))
    return best.select(*keys, *(F.col(f"r.{c}").alias(c) for c in rest)).select(*old.columns)


def update(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Partial update: per key the values of ``new`` that aren't null, else the old ones; ``new`` has some of the columns and each key once."""
    changed = [c for c in new.columns if c not in keys]
    both = old.alias("old").join(new.alias("new"), keys, "left")
    return both.select(*(F.col(c) if c in keys else (F.coalesce(f"new.{c}", f"old.{c}") if c in changed else F.col(f"old.{c}")).alias(c) for c in old.columns))


def delete(df: DataFrame, gone: DataFrame | None = None, keys: list[str] | None = None, like: dict[str, str] | None = None, dim: tuple[str, int] | None = None) -> DataFrame:
    """Without the rows whose ``keys`` are in ``gone``, whose column is LIKE a pattern, or whose vector hasn't so many dimensions; nulls stay."""
    if gone is not None:
        df = df.join(gone.select(*keys).distinct(), keys, "left_anti")
    for column, pattern in (like or {}).items():
        df = df.filter(~F.coalesce(F.col(column).like(pattern), F.lit(False)))
    return df if dim is None else df.filter(F.coalesce(F.size(dim[0]) == dim[1], F.lit(True)))
