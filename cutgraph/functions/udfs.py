"""Functions that columns can't express: vectorised Python, off the hot paths."""

from __future__ import annotations

import difflib
import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def balanced_json(text: str | None) -> str | None:
    """The first JSON object in a text: fenced, bare or embedded; commas before a closing bracket go. None if none parses."""
    if not text:
        return None
    at = text.find("{")
    while at >= 0:
        depth, quoted, skip = 0, False, False
        for i in range(at, len(text)):
            c = text[i]
            if skip:
                skip = False
            elif c == "\\" and quoted:
                skip = True
            elif c == '"':
                quoted = not quoted
            elif not quoted and c == "{":
                depth += 1
            elif not quoted and c == "}":
                depth -= 1
                if depth == 0:
                    try:
                        return json.dumps(json.loads(without_trailing_commas(text[at : i + 1])), sort_keys=True)
                    except ValueError:
                        break
        at = text.find("{", at + 1)
    return None


def without_trailing_commas(text: str) -> str:
    """JSON text without commas that a closing bracket follows, outside of strings."""
    out: list[str] = []
    quoted = skip = False
    for c in text:
        if skip:
            skip = False
        elif quoted and c == "\\":
            skip = True
        elif c == '"':
            quoted = not quoted
        elif not quoted and c in "}]":
            k = len(out) - 1
            while k >= 0 and out[k].isspace():
                k -= 1
            if k >= 0 and out[k] == ",":
                del out[k]
        out.append(c)
    return "".join(out)


def extract_json(column: Column) -> Column:
    """balanced_json over a column."""

    @F.pandas_udf("string")
    def extracted(texts: pd.Series) -> pd.Series:
        return texts.map(balanced_json, na_action="ignore")

    return extracted(column)


def close_matches(column: Column, vocabulary: list[str], n: int = 3, cutoff: float = 0.7) -> Column:
    """The words of a small vocabulary that are most alike by the ratio of matching blocks."""

    @F.pandas_udf("array<string>")
    def matched(words: pd.Series) -> pd.Series:
        known = {w: difflib.get_close_matches(w, vocabulary, n, cutoff) for w in words.dropna().unique()}
        return pd.Series([known.get(w) for w in words], dtype=object)

    return matched(column)


def ratio(a: Column, b: Column) -> Column:
    """Likeness of two texts by their matching blocks (difflib's ratio); null where either is null."""

    @F.pandas_udf("double")
    def alike(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if p is None or q is None else difflib.SequenceMatcher(None, p, q).ratio() for p, q in zip(x, y, strict=True)], dtype="float64")

    return alike(a, b)


def probe(column: Column) -> Column:
    """Metadata of a media probe (JSON): fps, variable rate, offset of sound in ms, rotation; null where absent."""
    schema = "r_frame_rate string, avg_frame_rate string, video_start string, audio_start string, rotation string, width int, height int"
    p = F.from_json(column, schema)
    rate = lambda c: F.try_divide(F.split_part(c, F.lit("/"), F.lit(1)).try_cast("double"), F.coalesce(F.split_part(c, F.lit("/"), F.lit(2)).try_cast("double"), F.lit(1.0)))
    r, avg = rate(p["r_frame_rate"]), rate(p["avg_frame_rate"])
    offset = (p["audio_start"].try_cast("double") - p["video_start"].try_cast("double")) * 1000
    return F.struct(r.alias("fps"), (F.abs(r - avg) > 1).alias("is_vfr"), offset.alias("av_offset_ms"), F.coalesce(p["rotation"].try_cast("int"), F.lit(0)).alias("rotation"), p["width"].alias("width"), p["height"].alias("height"))


# Marks of errors that pass.
TRANSIENT = ("throttl", "rate limit", "too many requests", "429", "500", "502", "503", "504", "overloaded", "timeout", "timed out", "connection", "reset by peer", "service unavailable", "internalservererror", "modelnotready")


def is_transient(message: Column) -> Column:
    out = F.lit(False)
    for mark in TRANSIENT:
        out |= F.contains(F.lower(message), F.lit(mark))
    return out


def trimmed_by_tempo(clips, pacing: str | None):
    """Clips cut to the length that a pacing allows (2, 5 or 8 s); off without one."""
    most = {"fast": 2_000_000, "neutral": 5_000_000, "cinematic": 8_000_000}.get(pacing or "")
    return clips if most is None else clips.withColumn("end_us", F.least("end_us", F.col("start_us") + most))
