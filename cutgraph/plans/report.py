"""Text sinks: captions as SRT and VTT, and an edit's report in Markdown, a row per media item."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def srt(cues: DataFrame) -> DataFrame:
    """(media_id, text) of SubRip files from cues (media_id, cue, start, end, text)."""
    one = F.concat_ws("\n", (F.col("cue") + 1).cast("string"), F.concat("start", F.lit(" --> "), "end"), "text", F.lit(""))
    return _joined(cues.withColumn("_b", one), "")


def vtt(cues: DataFrame) -> DataFrame:
    """(media_id, text) of WebVTT files."""
    dotted = lambda c: F.replace(F.col(c), F.lit(","), F.lit("."))
    one = F.concat_ws("\n", F.concat(dotted("start"), F.lit(" --> "), dotted("end")), "text", F.lit(""))
    return _joined(cues.withColumn("_b", one), "WEBVTT\n\n")


def _joined(blocks: DataFrame, head: str) -> DataFrame:
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("cue", "_b"))), lambda s: s["_b"]), "\n")
    return blocks.groupBy("media_id").agg(F.concat(F.lit(head), text).alias("text"))


def markdown(metrics: DataFrame, failures: DataFrame, duration: int) -> DataFrame:
    """(media_id, text): lengths, reduction and what the checks found."""
    wrong = failures.groupBy("media_id").agg(F.array_join(F.array_sort(F.collect_set("issue")), ", ").alias("issues"))
    seconds = lambda c: F.format_string("%.2f s", c / 1e6)
    lines = F.concat_ws(
        "\n", F.concat(F.lit("# Edit of "), F.col("media_id").cast("string")), F.lit(""), F.concat(F.lit("- before: "), seconds(F.lit(duration))), F.concat(F.lit("- after: "), seconds(F.col("kept_us"))),
        F.concat(F.lit("- clips: "), F.col("clip_count").cast("string")), F.concat(F.lit("- removed: "), F.format_string("%.1f %%", F.col("removal_ratio") * 100)), F.concat(F.lit("- checks: "), F.coalesce("issues", F.lit("passed"))),
    )
    return metrics.join(wrong, "media_id", "left").select("media_id", lines.alias("text"))


def as_json(metrics: DataFrame, failures: DataFrame, duration: int) -> DataFrame:
    """(media_id, text): the report as a JSON object, lengths in microseconds."""
    wrong = failures.groupBy("media_id").agg(F.array_sort(F.collect_set("issue")).alias("issues"))
    none = F.expr("cast(array() as array<string>)")
    one = F.struct("media_id", F.lit(duration).cast("long").alias("before_us"), F.col("kept_us").alias("after_us"), F.col("clip_count").alias("clips"), F.coalesce("issues", none).alias("issues"))
    return metrics.join(wrong, "media_id", "left").select("media_id", F.to_json(one).alias("text"))


def shot_index(shots: DataFrame) -> DataFrame:
    """(media_id, text): the shots of an item as a JSON list, in order of time and numbered from 0, times in microseconds."""
    w = F.array_sort(F.collect_list(F.struct("start_us", "end_us")))
    numbered = F.transform(w, lambda s, i: F.struct(i.alias("shot_id"), s["start_us"].alias("start_us"), s["end_us"].alias("end_us")))
    return shots.groupBy("media_id").agg(F.to_json(numbered).alias("text"))


def write_text(files: DataFrame, path: str) -> None:
    """A folder of text per media item."""
    files.write.mode("overwrite").partitionBy("media_id").text(path)


def breath_labels(rows: DataFrame) -> DataFrame:
    """(path, start_us, end_us) of labelled intervals from (path, breath), breath a JSON list of pairs of seconds."""
    spans = rows.select("path", F.explode(F.from_json("breath", "array<array<double>>")).alias("b"))
    us = lambda i: F.floor(F.get("b", F.lit(i)) * 1e6 + 0.5).cast("long")
    return spans.filter("size(b) = 2").select("path", us(0).alias("start_us"), us(1).alias("end_us"))
