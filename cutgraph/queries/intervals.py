"""Interval algebra, joins in time, and sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import intervals as iv
from ..operators import sequences as sq
from ..sources.kb import DURATION, KB
from .base import query, r6

M = ["media_id"]
_MERGED = """s AS (SELECT *, max(end_us) OVER (PARTITION BY media_id ORDER BY start_us, end_us, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM {t}),
    i AS (SELECT *, sum(CASE WHEN p IS NULL OR start_us - p {op} {gap} THEN 1 ELSE 0 END) OVER (PARTITION BY media_id ORDER BY start_us, end_us, id ROWS UNBOUNDED PRECEDING) AS g FROM s)"""


@query("SELECT media_id, start_us, end_us FROM silences")
def silences(kb: KB) -> DataFrame:
    return kb.silences


@query(f"WITH {_MERGED.format(t='sig', op='>', gap=1000000)} SELECT media_id, min(start_us) AS start_us, max(end_us) AS end_us, max(value) AS score, count(*) AS n, list_aggregate(list_sort(list(id)), 'string_agg', ',') AS ids FROM i GROUP BY media_id, g")
def merge_adjacent(kb: KB) -> DataFrame:
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("id")), lambda x: x.cast("string")), ",")
    return iv.merge(kb.signals, M, 1_000_000, [F.max("value").alias("score"), F.count("*").alias("n"), ids.alias("ids")])


@query(f"WITH r AS (SELECT * FROM sig WHERE event_type IN ('click', 'view')), {_MERGED.format(t='r', op='>', gap=10000)} SELECT media_id, min(start_us) AS start_us, max(end_us) AS end_us, string_agg(event_type, '; ' ORDER BY start_us, id) AS reasons FROM i GROUP BY media_id, g")
def merge_removals(kb: KB) -> DataFrame:
    reasons = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start_us", "id", "event_type"))), lambda s: s["event_type"]), "; ")
    return iv.merge(kb.signals.filter("event_type in ('click', 'view')"), M, 10_000, [reasons.alias("reasons")])


@query(f"WITH {_MERGED.format(t='sig', op='>=', gap=300000)} SELECT media_id, min(start_us) AS start_us, max(end_us) AS end_us FROM i GROUP BY media_id, g")
def micro_gap(kb: KB) -> DataFrame:
    return iv.merge(kb.signals, M, 300_000, strict=True)


@query("""WITH g AS (SELECT media_id, coalesce(max(end_us) OVER (PARTITION BY media_id ORDER BY start_us, end_us ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a, start_us AS b FROM silences
    UNION ALL SELECT media_id, max(end_us), 2600000000 FROM silences GROUP BY 1) SELECT media_id, a AS start_us, b AS end_us FROM g WHERE b > a""")
def complement(kb: KB) -> DataFrame:
    """What is kept when silences are removed."""
    return iv.complement(kb.silences.withColumn("id", F.lit(0).cast("long")), M, DURATION)


@query("""WITH g AS (SELECT media_id, coalesce(max(end_us) OVER (PARTITION BY media_id ORDER BY start_us, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a, start_us AS b FROM scenes WHERE emotion = 'sad'
    UNION ALL SELECT media_id, max(end_us), 2600000000 FROM scenes WHERE emotion = 'sad' GROUP BY 1) SELECT media_id, a AS start_us, b AS end_us FROM g WHERE b > a""")
def negation(kb: KB) -> DataFrame:
    """A negated target: all but the sad scenes."""
    return iv.complement(kb.scenes.filter("emotion = 'sad'"), M, DURATION)


@query("SELECT media_id, id, e AS start_us, n AS end_us, 0.7::DOUBLE AS confidence FROM (SELECT media_id, id, end_us AS e, lead(start_us) OVER (PARTITION BY media_id ORDER BY start_us, id) AS n FROM utts) WHERE n - e > 2000000")
def awkward(kb: KB) -> DataFrame:
    w = Window.partitionBy(*M).orderBy("start_us", "id")
    return kb.utterances.withColumn("n", F.lead("start_us").over(w)).filter("n - end_us > 2000000").select("media_id", "id", F.col("end_us").alias("start_us"), F.col("n").alias("end_us"), F.lit(0.7).alias("confidence"))


@query("SELECT media_id, 'scene:' || id AS src, 'scene:' || n AS dst FROM (SELECT media_id, id, lead(id) OVER (PARTITION BY media_id ORDER BY start_us, id) AS n FROM scenes) WHERE n IS NOT NULL")
def followed_by(kb: KB) -> DataFrame:
    w = Window.partitionBy(*M).orderBy("start_us", "id")
    ref = lambda c: F.concat(F.lit("scene:"), F.col(c).cast("string"))
    return kb.scenes.withColumn("n", F.lead("id").over(w)).filter("n is not null").select("media_id", ref("id").alias("src"), ref("n").alias("dst"))


def _pair(kb: KB, a: str, b: str) -> tuple[DataFrame, DataFrame]:
    left = kb.signals.filter(F.col("event_type") == a).select("media_id", "id", "start_us", "end_us", F.col("value").alias("score"))
    right = kb.signals.filter(F.col("event_type") == b).select("media_id", F.col("id").alias("b_id"), F.col("start_us").alias("b_start_us"), F.col("end_us").alias("b_end_us"), F.col("value").alias("b_score"))
    return left, right


@query("SELECT a.media_id, a.id AS a, b.id AS b FROM sig a JOIN sig b ON a.media_id = b.media_id AND a.event_type = 'view' AND b.event_type = 'purchase' AND a.start_us < b.end_us AND a.end_us > b.start_us")
def overlap_join(kb: KB) -> DataFrame:
    return iv.overlap_join(*_pair(kb, "view", "purchase"), M, 2_000_000).select("media_id", F.col("id").alias("a"), F.col("b_id").alias("b"))


@query("SELECT DISTINCT s.media_id, s.id, s.start_us, s.end_us FROM scenes s JOIN audio a ON s.media_id = a.media_id AND a.type = 'music' AND s.start_us < a.end_us AND s.end_us > a.start_us WHERE s.is_broll")
def montage(kb: KB) -> DataFrame:
    music = kb.audio_events.filter("type = 'music'").select("media_id", F.col("start_us").alias("b_start_us"), F.col("end_us").alias("b_end_us"))
    return iv.overlap_join(kb.scenes.filter("is_broll").select("media_id", "id", "start_us", "end_us"), music, M, 20_000_000).select("media_id", "id", "start_us", "end_us").distinct()


@query("""SELECT a.media_id, greatest(a.start_us, b.start_us) AS start_us, least(a.end_us, b.end_us) AS end_us, floor((a.value + b.value) / 2 * 1e6 + 0.5) / 1e6 AS score, 'view ' || a.id || ' while purchase ' || b.id AS evidence
    FROM sig a JOIN sig b ON a.media_id = b.media_id AND a.event_type = 'view' AND b.event_type = 'purchase' AND least(a.end_us, b.end_us) - greatest(a.start_us, b.start_us) > 200000""")
def compound_while(kb: KB) -> DataFrame:
    met = iv.overlap_join(*_pair(kb, "view", "purchase"), M, 2_000_000)
    both = met.select("media_id", F.greatest("start_us", "b_start_us").alias("start_us"), F.least("end_us", "b_end_us").alias("end_us"), r6((F.col("score") + F.col("b_score")) / 2).alias("score"), F.format_string("view %d while purchase %d", "id", "b_id").alias("evidence"))
    return both.filter("end_us - start_us > 200000")


@query("SELECT u.media_id, u.id, string_agg(w.word, ' ' ORDER BY w.start_us, w.utt_id, w.idx) AS text, count(*) AS n FROM utts u JOIN words w ON u.media_id = w.media_id AND w.start_us >= u.start_us AND w.end_us <= u.end_us GROUP BY 1, 2")
def scene_text(kb: KB) -> DataFrame:
    """Words that lie whole within an interval, in order."""
    outer = kb.utterances.select("media_id", "id", "start_us", "end_us")
    inner = kb.words.select("media_id", "utt_id", "idx", "word", F.col("start_us").alias("b_start_us"), F.col("end_us").alias("b_end_us"))
    held = iv.contain_join(inner, outer, M, 30_000_000)
    words = F.transform(F.array_sort(F.collect_list(F.struct("b_start_us", "utt_id", "idx", "word"))), lambda s: s["word"])
    return held.groupBy("media_id", "id").agg(F.array_join(words, " ").alias("text"), F.count("*").alias("n"))


@query("SELECT media_id, id, array_to_string(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')[1:20], ' ') || '...' AS quote FROM utts")
def evidence_quote(kb: KB) -> DataFrame:
    words = F.filter(F.split("text", r"\s+"), lambda w: w != "")
    return kb.utterances.select("media_id", "id", F.concat(F.array_join(F.slice(words, 1, 20), " "), F.lit("...")).alias("quote"))


@query("""WITH c AS (SELECT DISTINCT media_id, start_us AS t FROM scenes), b AS (SELECT DISTINCT media_id, start_us AS u FROM sig WHERE event_type = 'click')
    SELECT c.media_id, c.t, arg_min(u, abs(u - c.t)::HUGEINT * 10000000000 + u) AS beat_us, coalesce(arg_min(u, abs(u - c.t)::HUGEINT * 10000000000 + u), c.t) AS snapped_us FROM c LEFT JOIN b ON c.media_id = b.media_id AND abs(u - c.t) <= 400000 GROUP BY 1, 2""")
def beat_snap(kb: KB) -> DataFrame:
    """Cuts moved to the nearest beat within a tolerance; the production value of 40 ms is ten times closer than the test data's beats."""
    cuts = kb.scenes.select("media_id", F.col("start_us").alias("t")).distinct()
    beats = kb.signals.filter("event_type = 'click'").select("media_id", F.col("start_us").alias("u"))
    return iv.nearest(cuts, beats, M, "t", "u", 400_000).select("media_id", "t", F.col("nearest_us").alias("beat_us"), F.coalesce("nearest_us", "t").alias("snapped_us"))


@query("""WITH p AS (SELECT DISTINCT media_id, start_us AS t FROM sig WHERE event_type = 'error'), s AS (SELECT DISTINCT media_id, start_us AS u FROM scenes)
    SELECT p.media_id, t, (SELECT max(u) FROM s WHERE s.media_id = p.media_id AND u <= t) AS prev_us, (SELECT min(u) FROM s WHERE s.media_id = p.media_id AND u > t) AS next_us FROM p""")
def nearest_boundary(kb: KB) -> DataFrame:
    points = kb.signals.filter("event_type = 'error'").select("media_id", F.col("start_us").alias("t")).distinct()
    return iv.neighbours(points, kb.scenes.select("media_id", F.col("start_us").alias("u")), M, "t", "u")


@query("""WITH l AS (SELECT media_id, id, start_us, end_us, row_number() OVER (PARTITION BY media_id ORDER BY start_us, id) AS r FROM sig), f AS (SELECT DISTINCT media_id, start_us AS pts FROM sig WHERE event_type = 'view')
    SELECT g.media_id, g.t, arg_min(pts, abs(pts - g.t)::HUGEINT * 10000000000 + pts) AS pts_us FROM (SELECT DISTINCT media_id, start_us AS t FROM sig WHERE event_type = 'signup') g LEFT JOIN f ON f.media_id = g.media_id GROUP BY 1, 2""")
def quantize_lut(kb: KB) -> DataFrame:
    """The nearest frame of a table of times, the earlier of two."""
    points = kb.signals.filter("event_type = 'signup'").select("media_id", F.col("start_us").alias("t")).distinct()
    n = iv.neighbours(points, kb.signals.filter("event_type = 'view'").select("media_id", F.col("start_us").alias("u")), M, "t", "u")
    back, ahead = F.col("t") - F.col("prev_us"), F.col("next_us") - F.col("t")
    return n.select("media_id", "t", F.when(F.col("next_us").isNull() | (back <= ahead), F.col("prev_us")).otherwise(F.col("next_us")).alias("pts_us"))


_ANCHOR = "a AS (SELECT media_id, min(start_us) AS first, max(end_us) AS last FROM audio WHERE type = 'applause' AND confidence > 0.9 GROUP BY 1)"


@query(f"WITH {_ANCHOR} SELECT s.media_id, s.id, s.start_us, s.end_us FROM scenes s JOIN a ON s.media_id = a.media_id WHERE s.end_us <= a.first")
def anchor_before(kb: KB) -> DataFrame:
    a = kb.audio_events.filter("type = 'applause' and confidence > 0.9").groupBy("media_id").agg(F.min("start_us").alias("first"))
    return kb.scenes.join(a, "media_id").filter("end_us <= first").select("media_id", "id", "start_us", "end_us")


@query(f"WITH {_ANCHOR} SELECT s.media_id, s.id, s.start_us, s.end_us FROM scenes s JOIN a ON s.media_id = a.media_id WHERE s.start_us >= a.last")
def anchor_after(kb: KB) -> DataFrame:
    a = kb.audio_events.filter("type = 'applause' and confidence > 0.9").groupBy("media_id").agg(F.max("end_us").alias("last"))
    return kb.scenes.join(a, "media_id").filter("start_us >= last").select("media_id", "id", "start_us", "end_us")


@query("SELECT DISTINCT c.media_id, c.t FROM (SELECT media_id, (start_us + end_us) // 2 AS t FROM utts) c JOIN words w ON c.media_id = w.media_id AND c.t > w.start_us + 40000 AND c.t < w.end_us - 40000")
def midword_cuts(kb: KB) -> DataFrame:
    """Cuts strictly inside a word, 40 ms from its ends."""
    cuts = kb.utterances.select("media_id", F.expr("(start_us + end_us) div 2").alias("t"))
    inside = kb.words.select("media_id", (F.col("start_us") + 40_001).alias("start_us"), (F.col("end_us") - 40_000).alias("end_us")).filter("end_us > start_us")
    return iv.point_join(cuts, inside, M, "t", 2_000_000).select("media_id", "t").distinct()


@query("SELECT s.media_id, s.id FROM scenes s WHERE NOT EXISTS (FROM sig g WHERE g.media_id = s.media_id AND g.event_type = 'click' AND g.start_us < s.end_us AND g.end_us > s.start_us)")
def vad_disagreement(kb: KB) -> DataFrame:
    """Intervals that no speech overlaps."""
    speech = kb.signals.filter("event_type = 'click'").select("media_id", F.col("start_us").alias("b_start_us"), F.col("end_us").alias("b_end_us"))
    s = kb.scenes.select("media_id", "id", "start_us", "end_us")
    return s.join(iv.overlap_join(s, speech, M, 20_000_000).select("media_id", "id").distinct(), ["media_id", "id"], "left_anti").select("media_id", "id")


@query("SELECT p.media_id, p.t, arg_min(u.speaker, u.start_us * 1000 + u.id) AS speaker FROM (SELECT media_id, start_us + (end_us - start_us) // 3 AS t FROM utts) p JOIN utts u ON p.media_id = u.media_id AND p.t >= u.start_us AND p.t <= u.end_us GROUP BY 1, 2")
def speaker_at(kb: KB) -> DataFrame:
    points = kb.utterances.select("media_id", F.expr("start_us + (end_us - start_us) div 3").alias("t"))
    spans = kb.utterances.select("media_id", "id", "speaker", "start_us", "end_us")
    return iv.point_join(points, spans, M, "t", 30_000_000, closed=True).groupBy("media_id", "t").agg(F.min_by("speaker", F.struct("start_us", "id")).alias("speaker"))


@query("""WITH v AS (SELECT a.media_id, a.src, s.emotion FROM appears a JOIN scenes s ON a.media_id = s.media_id AND a.scene_id = s.id), n AS (SELECT media_id, emotion, src, count(*) AS n FROM v GROUP BY 1, 2, 3)
    SELECT media_id, emotion, arg_max(src, n * 1000000 + (999999 - CAST(src[8:] AS BIGINT))) AS person, max(n) AS votes FROM n GROUP BY 1, 2""")
def speaker_vote(kb: KB) -> DataFrame:
    """Per class the person with the most votes, the lowest number of equal ones."""
    v = kb.appearances.join(kb.scenes.select("media_id", F.col("id").alias("scene_id"), "emotion"), ["media_id", "scene_id"])
    n = v.groupBy("media_id", "emotion", "src").agg(F.count("*").alias("n"))
    return n.groupBy("media_id", "emotion").agg(F.max_by("src", F.struct("n", -F.substring("src", 8, 20).cast("long"))).alias("person"), F.max("n").alias("votes"))


@query("""SELECT media_id, start_us, CASE WHEN n < 3 THEN value ELSE list_median END AS value FROM (SELECT media_id, start_us, value, count(*) OVER (PARTITION BY media_id) AS n,
    median(value) OVER (PARTITION BY media_id ORDER BY start_us, id ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS list_median FROM sig)""")
def median_filter(kb: KB) -> DataFrame:
    return sq.median_filter(kb.signals.select("media_id", "id", "start_us", "value"), M, ["start_us", "id"], "value", "m").select("media_id", "start_us", F.col("m").alias("value"))


_ONE = "(SELECT media_id, start_us AS t, max(value) / 100 AS v FROM sig GROUP BY 1, 2)"


@query(f"""WITH e AS (SELECT media_id, t, v, CASE WHEN v > 0.5 THEN 1 WHEN v < 0.3 THEN 0 END AS edge, lead(t) OVER w AS n FROM {_ONE} WINDOW w AS (PARTITION BY media_id ORDER BY t)),
    s AS (SELECT *, coalesce(last_value(edge IGNORE NULLS) OVER (PARTITION BY media_id ORDER BY t ROWS UNBOUNDED PRECEDING), 0) AS is_on FROM e),
    i AS (SELECT *, sum(CASE WHEN is_on = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY media_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS g FROM s)
    SELECT media_id, min(t) AS start_us, max(coalesce(n, t)) + 1000000 AS end_us, floor(avg(v) * 1e6 + 0.5) / 1e6 AS confidence, count(*) AS n FROM i WHERE is_on = 1 GROUP BY media_id, g""")
def hysteresis(kb: KB) -> DataFrame:
    series = kb.signals.groupBy("media_id", F.col("start_us").alias("t")).agg((F.max("value") / 100).alias("v"))
    return sq.hysteresis(series, M, "t", "v", 0.5, 0.3, 1_000_000).withColumn("confidence", r6("confidence"))


_RUNS = """r AS (SELECT media_id, t, v, lead(t) OVER (PARTITION BY media_id ORDER BY t) AS n, row_number() OVER (PARTITION BY media_id ORDER BY t) - row_number() OVER (PARTITION BY media_id, f ORDER BY t) AS g, f FROM (SELECT *, v {c} AS f FROM {one}))"""


@query(f"WITH {_RUNS.format(c='< 0.15', one=_ONE)} SELECT media_id, min(t) AS start_us, max(n) AS end_us FROM r WHERE f GROUP BY media_id, g HAVING bool_and(n IS NOT NULL) AND max(n) - min(t) > 2000000")
def music_runs(kb: KB) -> DataFrame:
    """Runs under a threshold of more than two seconds; one that is open at the end is dropped."""
    series = kb.signals.groupBy("media_id", F.col("start_us").alias("t")).agg((F.max("value") / 100).alias("v"))
    return sq.runs(series, M, "t", F.col("v") < 0.15).filter("next_us - start_us > 2000000").select("media_id", "start_us", F.col("next_us").alias("end_us"))


@query(f"WITH {_RUNS.format(c='> 0.064', one=_ONE)} SELECT media_id, min(t) AS start_us, max(t) AS last_us, count(*) AS n FROM r WHERE f GROUP BY media_id, g HAVING count(*) > 20")
def breath_runs(kb: KB) -> DataFrame:
    series = kb.signals.groupBy("media_id", F.col("start_us").alias("t")).agg((F.max("value") / 100).alias("v"))
    return sq.runs(series, M, "t", F.col("v") > 0.064).filter("n > 20").select("media_id", "start_us", "last_us", "n")


@query("SELECT media_id, utt_id, idx, word, start_us, end_us FROM words")
def interpolate_words(kb: KB) -> DataFrame:
    return kb.words.select("media_id", "utt_id", "idx", "word", "start_us", "end_us")


@query(f"SELECT media_id, t, kind FROM (SELECT media_id, t, CASE WHEN v > lag(v) OVER w AND v > lead(v) OVER w THEN 1 WHEN v < lag(v) OVER w AND v < lead(v) OVER w THEN -1 END AS kind FROM {_ONE} WINDOW w AS (PARTITION BY media_id ORDER BY t)) WHERE kind IS NOT NULL")
def local_extrema(kb: KB) -> DataFrame:
    series = kb.signals.groupBy("media_id", F.col("start_us").alias("t")).agg((F.max("value") / 100).alias("v"))
    return sq.local_extrema(series, M, "t", "v").select("media_id", "t", "kind")


@query("""WITH b AS (SELECT DISTINCT media_id, start_us AS t FROM sig WHERE event_type IN ('signup', 'purchase')), l AS (SELECT *, lag(t) OVER (PARTITION BY media_id ORDER BY t) AS p FROM b)
    SELECT media_id, t FROM l WHERE p IS NULL OR t - p > 300000""")
def shot_boundaries(kb: KB) -> DataFrame:
    """The union of two detectors' boundaries; one at most 0.3 s after another goes."""
    b = kb.signals.filter("event_type = 'signup'").select("media_id", F.col("start_us").alias("t")).union(kb.signals.filter("event_type = 'purchase'").select("media_id", F.col("start_us").alias("t"))).distinct()
    w = Window.partitionBy(*M).orderBy("t")
    return b.withColumn("p", F.lag("t").over(w)).filter("p is null or t - p > 300000").select("media_id", "t")


@query("""SELECT s.media_id, s.id, 0.1::DOUBLE AS score FROM scenes s WHERE NOT EXISTS (FROM sig g WHERE g.media_id = s.media_id AND g.event_type = 'purchase' AND g.value > 60 AND g.start_us < s.end_us AND g.end_us > s.start_us)""")
def compress_fill(kb: KB) -> DataFrame:
    """Scenes that no hit covers, added with a low score."""
    hits = kb.signals.filter("event_type = 'purchase' and value > 60").select("media_id", F.col("start_us").alias("b_start_us"), F.col("end_us").alias("b_end_us"))
    s = kb.scenes.select("media_id", "id", "start_us", "end_us")
    return s.join(iv.overlap_join(s, hits, M, 20_000_000).select("media_id", "id").distinct(), ["media_id", "id"], "left_anti").select("media_id", "id", F.lit(0.1).alias("score"))


@query("SELECT media_id, id, CAST(coalesce(sum(end_us - start_us) OVER (PARTITION BY media_id ORDER BY -id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS offset_us FROM scenes WHERE importance > 0.1")
def playback_remap(kb: KB) -> DataFrame:
    """Where each clip begins in a playlist that isn't in source order (here: by falling id)."""
    clips = kb.scenes.filter("importance > 0.1").select("media_id", "id", (F.col("end_us") - F.col("start_us")).alias("d"), (-F.col("id")).alias("pos"))
    return iv.running_sum(clips, M, "pos", "d", "to").select("media_id", "id", (F.col("to") - F.col("d")).alias("offset_us"))
