"""Operators over ordered rows: words in time, filters, runs and segmentation of series."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def tokens(text: Column) -> Column:
    """Lower-case words split at white space; none for an empty text."""
    return F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")


def interpolated_words(utterances: DataFrame) -> DataFrame:
    """Words of each utterance, timed by their share of its characters.

    The array holds running sums, so that no window over all words is needed. Times are rounded down.
    """
    words = F.filter(F.split("text", r"\s+"), lambda w: w != "")
    start = F.array(F.lit(0).cast("long"))
    ends = F.aggregate(F.transform("ws", lambda w: F.length(w).cast("long")), start, lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n)))
    u = utterances.select("media_id", F.col("id").alias("utt_id"), "speaker", F.col("start_us").alias("_s"), F.col("end_us").alias("_e"), words.alias("ws")).filter("size(ws) > 0")
    u = u.withColumn("cum", ends).withColumn("total", F.element_at("cum", -1))
    one = u.select("media_id", "utt_id", "speaker", "_s", "_e", "cum", "total", F.posexplode("ws").alias("idx", "word"))
    whole = lambda c: F.expr(f"_s + ((_e - _s) * {c}) div total")
    return one.select("media_id", "utt_id", "speaker", "idx", "word", whole("get(cum, idx)").alias("start_us"), whole("get(cum, idx + 1)").alias("end_us"))


def phrases(utterances: DataFrame, wanted: tuple[str, ...], clean: Callable[[Column], Column] = F.lower) -> DataFrame:
    """(media_id, phrase, start_us, end_us) of the ``wanted`` phrases over an item's ``clean`` words in order, across utterances.

    Utterances that follow each other in time are sorted, not their words: each takes along the few first words of what comes next, and
    its words are only made where they are looked through.
    """
    lengths = sorted({len(p.split()) for p in wanted})
    more = max(lengths[-1] - 1, 1)
    words = F.filter(F.split("text", r"\s+"), lambda w: w != "")
    u = utterances.select("media_id", "id", "text", F.col("start_us").alias("s"), F.col("end_us").alias("e"), F.slice(words, 1, more).alias("head"), F.aggregate(words, F.lit(0).cast("long"), lambda n, w: n + F.length(w)).alias("total")).filter("total > 0")
    sums = F.aggregate("head", F.array(F.lit(0).cast("long")), lambda acc, w: F.concat(acc, F.array(F.element_at(acc, -1) + F.length(w))))
    timed = lambda ws, cum: F.transform(ws, lambda w, i: F.struct(clean(w).alias("w"), F.call_function("div", (F.col("e") - F.col("s")) * F.get(cum, i), F.col("total")).alias("a"), F.call_function("div", (F.col("e") - F.col("s")) * F.get(cum, i + 1), F.col("total")).alias("b")))
    moved = lambda xs: F.transform(xs, lambda x: F.struct(x["w"].alias("w"), (F.col("s") + x["a"]).alias("a"), (F.col("s") + x["b"]).alias("b")))
    u = u.withColumn("cum", sums).withColumn("head", moved(timed("head", "cum"))).drop("cum")
    w = Window.partitionBy("media_id").orderBy("s", "id")
    none = F.slice("head", 1, 0)
    ahead = [F.coalesce(F.lead("head", i).over(w), none) for i in range(1, more + 1)]
    u = u.withColumns({f"h{i}": h for i, h in enumerate(ahead)}).withColumn("next", F.slice(F.concat(*(f"h{i}" for i in range(more))), 1, more))
    own = u.select("media_id", "s", "e", "total", "next", words.alias("ws"))
    own = own.withColumn("cum", F.aggregate("ws", F.array(F.lit(0).cast("long")), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + F.length(x)))))
    line = own.select("media_id", F.size("ws").alias("n"), F.concat(moved(timed("ws", "cum")), "next").alias("x"))
    at = lambda i: F.get("x", i)
    said = lambda i, k: F.when(at(i + (k - 1)).isNotNull(), F.struct(F.concat_ws(" ", *(at(i + j)["w"] for j in range(k))).alias("phrase"), at(i)["a"].alias("start_us"), at(i + (k - 1))["b"].alias("end_us")))
    found = lambda k: F.filter(F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: said(i, k)), lambda p: p["phrase"].isin(*(x for x in wanted if len(x.split()) == k)))
    return line.select("media_id", F.inline(F.concat(*map(found, lengths))))


def median_filter(df: DataFrame, keys: list[str], order: list[str], value: str, out: str, half: int = 1) -> DataFrame:
    """Moving median over 2 * half + 1 rows, of what there is at the edges; items shorter than that stay as they are."""
    w = Window.partitionBy(*keys).orderBy(*order)
    seen = F.array_sort(F.collect_list(value).over(w.rowsBetween(-half, half)))
    n = F.size("_w")
    middle = (F.get("_w", ((n - 1) / 2).cast("int")) + F.get("_w", (n / 2).cast("int"))) / 2
    short = F.col("_n") < 2 * half + 1
    counted = df.join(df.groupBy(*keys).agg(F.count("*").alias("_n")), keys)
    return counted.withColumn("_w", seen).withColumn(out, F.when(short, F.col(value)).otherwise(middle)).drop("_w", "_n")


def hysteresis(df: DataFrame, keys: list[str], at: str, value: str, enter: float, leave: float, hop: int) -> DataFrame:
    """Events that begin where ``value`` exceeds ``enter`` and end where it falls under ``leave``.

    (keys, start_us, end_us, confidence, n): an event ends ``hop`` after the row that leaves it, which isn't
    counted, or after the last row.
    """
    w = Window.partitionBy(*keys).orderBy(at)
    edge = F.when(F.col(value) > enter, 1).when(F.col(value) < leave, 0)
    state = F.coalesce(F.last("_edge", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0))
    s = df.withColumn("_edge", edge).withColumn("_on", state)
    s = s.withColumn("_was", F.lag("_on", 1, 0).over(w)).withColumn("_next", F.lead(at).over(w))
    s = s.withColumn("_island", F.sum(F.when((F.col("_on") == 1) & (F.col("_was") == 0), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    inside = s.filter("_on = 1")
    return inside.groupBy(*keys, "_island").agg(F.min(at).alias("start_us"), (F.max(F.coalesce("_next", at)) + hop).alias("end_us"), F.avg(value).alias("confidence"), F.count("*").alias("n")).drop("_island")


def windowed_events(scores: DataFrame, keys: list[str], at: str, value: str, last: int, enter: float = 0.5, leave: float = 0.3, hop: int = 1_000_000, length: int = 2_000_000) -> DataFrame:
    """Events of each key (an item's label) from the scores of sliding windows: median over three windows, then hysteresis.

    ``at`` numbers windows from 0 to ``last``, each begun ``hop`` after the one before; a window without a row scores 0, of several rows the greatest counts. Only
    medians of ``leave`` (above 0) or more are made rows: they lie next to a window that has a row, and elsewhere events have ended and none begins, so an
    item's silence costs nothing. Rows are sorted by windows, and medians once more, in one shuffle. Times are the windows' middles.
    """
    w = Window.partitionBy(*keys).orderBy(at, value)
    here = F.col(at)
    rows = scores.filter(here.between(0, last)).select(*keys, here.cast("long").alias(at), F.col(value).cast("double").alias(value)).dropna(subset=keys)
    # of a window's rows the last in order has its greatest score
    rows = rows.withColumn("_n", F.lead(at).over(w)).filter(F.col("_n").isNull() | (F.col("_n") != here)).drop("_n")
    near = {i: (F.lag if i < 0 else F.lead)(F.struct(at, value), abs(i)).over(w) for i in (-2, -1, 1, 2)}
    rows = rows.withColumns({f"_r{i}": r for i, r in near.items()})

    def score(d: int) -> Column:
        own = [F.when(F.col(f"_r{i}")[at] == here + d, F.col(f"_r{i}")[value]) for i in near if i * d > 0 and abs(i) <= abs(d)]
        return F.coalesce(*own, *([F.col(value)] if d == 0 else []), F.lit(0.0))

    rows = rows.select(*keys, at, F.col("_r-1")[at].alias("_before"), *(score(d).alias(f"_v{d}") for d in range(-2, 3)))

    def median(d: int) -> Column:
        a, b, c = (F.col(f"_v{i}") if abs(i) < 3 else F.lit(0.0) for i in (d - 1, d, d + 1))
        if last < 2:
            return b
        middle = F.greatest(F.least(a, b), F.least(F.greatest(a, b), c))
        return F.when(here + d == 0, (b + c) / 2).when(here + d == last, (a + b) / 2).otherwise(middle)

    # a row has the windows beside it that the row before it hasn't
    mine = lambda d: (here + d).between(0, last) & (F.col("_before").isNull() | (here + d > F.col("_before") + 1)) & ~(median(d) < leave)
    made = F.array_compact(F.array(*(F.when(mine(d), F.struct((here + d).alias("_w"), median(d).alias("_m"))) for d in (-1, 0, 1))))
    live = rows.select(*keys, F.inline(made))
    w = Window.partitionBy(*keys).orderBy("_w")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    live = live.withColumn("_new", F.coalesce(F.lag("_w").over(w) != F.col("_w") - 1, F.lit(True)))
    live = live.withColumn("_on", F.last(F.when(F.col("_m") > enter, 1).when(F.col("_new"), 0), ignorenulls=True).over(so_far))
    live = live.withColumn("_first", F.col("_new") | (F.lag("_on").over(w) == 0)).filter("_on = 1")
    live = live.withColumn("_begun", F.last(F.when(F.col("_first"), F.col("_w")), ignorenulls=True).over(so_far))
    middle = lambda c: c * hop + length // 2
    ended = F.least(F.max("_w") + 1, F.lit(last).cast("long"))
    found = live.groupBy(*keys, "_begun").agg(ended.alias("_ended"), F.avg("_m").alias("confidence"), F.count("*").alias("n"))
    return found.select(*keys, middle(F.col("_begun")).alias("start_us"), (middle(F.col("_ended")) + hop).alias("end_us"), "confidence", "n")


def runs(df: DataFrame, keys: list[str], at: str, flag: Column) -> DataFrame:
    """Maximal runs of consecutive rows with ``flag``: (keys, start_us, last_us, next_us, n); next_us is null at the end."""
    w = Window.partitionBy(*keys).orderBy(at)
    s = df.withColumn("_f", flag).withColumn("_all", F.row_number().over(w)).withColumn("_next", F.lead(at).over(w))
    s = s.filter("_f").withColumn("_island", F.col("_all") - F.row_number().over(w))
    return s.groupBy(*keys, "_island").agg(F.min(at).alias("start_us"), F.max(at).alias("last_us"), F.max_by("_next", at).alias("next_us"), F.count("*").alias("n")).drop("_island")


def local_extrema(df: DataFrame, keys: list[str], at: str, value: str) -> DataFrame:
    """Rows strictly above (1) or below (-1) both neighbours, as ``kind``."""
    w = Window.partitionBy(*keys).orderBy(at)
    p, n = F.lag(value).over(w), F.lead(value).over(w)
    s = df.withColumn("_p", p).withColumn("_n", n)
    kind = F.when((F.col(value) > F.col("_p")) & (F.col(value) > F.col("_n")), 1).when((F.col(value) < F.col("_p")) & (F.col(value) < F.col("_n")), -1)
    return s.withColumn("kind", kind).filter("kind is not null").drop("_p", "_n")


#: Phrases that a transcriber makes up where nobody speaks.
MADE_UP = r"(?i)(thanks?\s+for\s+watching|please\s+subscribe|like\s+and\s+subscribe|don'?t\s+forget\s+to\s+subscribe|see\s+you\s+next\s+time|thank\s+you\s+for\s+listening)"


def guarded(utterances: DataFrame, speech: DataFrame, repeats: int = 4, least: float = 0.7) -> DataFrame:
    """Utterances (media_id, id, text, start_us, end_us, no_speech_prob) with why each is not to be trusted.

    ``repeated``: a text of six words or more has a trigram ``repeats`` times. ``gratitude``: it has a phrase of MADE_UP, and ``no_speech``: a probability over
    ``least``, outside of every interval of ``speech``.
    """
    from . import intervals as iv

    key = ["media_id", "id"]
    spans = speech.select("media_id", F.col("start_us").alias("b_start_us"), F.col("end_us").alias("b_end_us"))
    spoken = iv.overlap_join(utterances.select(*key, "start_us", "end_us"), spans, ["media_id"], 20_000_000).select(*key).distinct().withColumn("_spoken", F.lit(True))
    w = tokens(F.col("text"))
    grams = utterances.select(*key, w.alias("w")).filter("size(w) >= 6").select(*key, F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - 2), lambda i: F.concat_ws(" ", F.slice("w", i, 3)))).alias("g"))
    most = grams.groupBy(*key, "g").agg(F.count("*").alias("k")).groupBy(*key).agg((F.max("k") >= repeats).alias("repeated"))
    out = utterances.join(spoken, key, "left").join(most, key, "left")
    silent = F.col("_spoken").isNull()
    return out.withColumns({"repeated": F.coalesce("repeated", F.lit(False)), "gratitude": F.coalesce(F.regexp_like("text", F.lit(MADE_UP)), F.lit(False)) & silent, "no_speech": F.coalesce(F.col("no_speech_prob") > least, F.lit(False)) & silent}).drop("_spoken")
