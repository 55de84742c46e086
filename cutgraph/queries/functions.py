"""Scalar functions over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalar, udfs
from ..operators import sequences
from ..sources.kb import KB
from .base import query, r6


def _case(points) -> str:
    """The oracle's form of a piecewise linear map of c."""
    arms = " ".join(f"WHEN c < {x1} THEN {y0}::DOUBLE + (c - {x0}::DOUBLE) / ({x1}::DOUBLE - {x0}::DOUBLE) * ({y1}::DOUBLE - {y0}::DOUBLE)" for (x0, y0), (x1, y1) in zip(points, points[1:], strict=False))
    return f"CASE WHEN c <= {points[0][0]} THEN {points[0][1]} {arms} ELSE {points[-1][1]} END"


_MAPS = " ".join(f"WHEN '{name}' THEN {_case(points)}" for name, points in scalar.BREAKPOINTS.items())


@query("SELECT doc_id, contains(lower(text), 'the') AS holds, regexp_matches(lower(text), '(^|[^a-z0-9_])the($|[^a-z0-9_])') AS holds_word FROM documents")
def kw_filter(kb: KB) -> DataFrame:
    t = F.lower("text")
    return kb.table("documents").select("doc_id", F.contains(t, F.lit("the")).alias("holds"), F.regexp_like(t, F.lit("(^|[^a-z0-9_])the($|[^a-z0-9_])")).alias("holds_word"))


@query("""WITH q AS (SELECT event_id, 'cut ' || (event_id % 7) || ':' || lpad(CAST(event_id % 60 AS VARCHAR), 2, '0') || ' to ' || (event_id % 9) || ':' || lpad(CAST(event_id % 50 AS VARCHAR), 2, '0') AS p FROM events),
    t AS (SELECT event_id, CAST(regexp_extract(p, '([0-9]+):([0-9]+) to ([0-9]+):([0-9]+)', 1) AS BIGINT) * 60 + CAST(regexp_extract(p, '([0-9]+):([0-9]+) to ([0-9]+):([0-9]+)', 2) AS BIGINT) AS a,
        CAST(regexp_extract(p, '([0-9]+):([0-9]+) to ([0-9]+):([0-9]+)', 3) AS BIGINT) * 60 + CAST(regexp_extract(p, '([0-9]+):([0-9]+) to ([0-9]+):([0-9]+)', 4) AS BIGINT) AS b FROM q)
    SELECT event_id, a * 1000000 AS start_us, b * 1000000 AS end_us FROM t WHERE b > a""")
def parse_time_range(kb: KB) -> DataFrame:
    i = F.col("event_id")
    prompt = F.format_string("cut %d:%02d to %d:%02d", i % 7, i % 60, i % 9, i % 50)
    found = F.regexp_extract(F.col("p"), r"(?:([0-9]+):)?([0-9]+) to (?:([0-9]+):)?([0-9]+)", 0)
    part = lambda g: F.coalesce(F.expr(f"try_cast(regexp_extract(f, '(?:([0-9]+):)?([0-9]+) to (?:([0-9]+):)?([0-9]+)', {g}) as bigint)"), F.lit(0))
    t = kb.table("events").select("event_id", prompt.alias("p")).withColumn("f", found).filter("f <> ''")
    return t.select("event_id", ((part(1) * 60 + part(2)) * 1_000_000).alias("start_us"), ((part(3) * 60 + part(4)) * 1_000_000).alias("end_us")).filter("end_us > start_us")


@query(r"""SELECT conv_id, turn, regexp_replace(trim(regexp_replace('Hey,  can you please ' || text, '\s+', ' ', 'g')), '^[Hh]ey, can you please ', '') AS prompt FROM conversations""")
def normalize_prompt(kb: KB) -> DataFrame:
    return kb.table("conversations").select("conv_id", "turn", scalar.normalized_prompt(F.concat(F.lit("Hey,  can you please "), "text")).alias("prompt"))


@query(rf"""SELECT doc_id, NOT regexp_matches(trim(t), '(?i)\b(?:{"|".join(scalar.EDIT_VERBS)})\b') AND (ends_with(trim(t), '?') OR regexp_matches(trim(t), '(?i)^(?:{"|".join(scalar.ASKING)})\b')) AS is_question
    FROM (SELECT doc_id, text AS t FROM documents)""")
def is_question(kb: KB) -> DataFrame:
    return kb.table("documents").select("doc_id", scalar.is_question(F.col("text")).alias("is_question"))


PROMPTS = ("Remove filler words.", "cut silences over 2.5s", "remove all the pauses", "please remove retakes", "remove ums", "keep only speech", "remove topics about pricing", "keep only scenes with person:anna", "make it shorter", "make this under 30 seconds", "cut to the beat", "match cut", "Create a trailer-style cut.", "make it cinematic", "build tension", "focus on me", "focus on the product", "make it suitable for TikTok", "something else")
_ACTIONS = {0: ("remove", "filler words"), 1: ("remove", "silence > 2.5s"), 2: ("remove", "silence"), 3: ("remove", "retakes"), 4: ("remove", "ums and uhs"), 5: ("keep_only", "speech"), 6: ("remove", "pricing"), 7: ("keep_only", "person:anna"), 8: ("compress", "important moments"), 9: ("compress", "important moments"), 10: ("compress", "beat-aligned highlights"), 11: ("restructure", "visually similar scene joins"), 12: ("restructure", "trailer story beats"), 13: ("stylize", "cinematic pacing"), 14: ("restructure", "setup reveal payoff"), 15: ("keep_only", "owner speaking"), 16: ("keep_only", "product visible"), 17: ("compress", "short-form highlights"), 18: (None, None)}
_SQL_ARMS = lambda j: " ".join(f"WHEN {i} THEN '{v[j]}'" for i, v in _ACTIONS.items() if v[j])


@query(f"SELECT event_id, CASE event_id % {len(PROMPTS)} {_SQL_ARMS(0)} END AS action, CASE event_id % {len(PROMPTS)} {_SQL_ARMS(1)} END AS target FROM events")
def fast_path_intent(kb: KB) -> DataFrame:
    prompt = F.get(F.array(*map(F.lit, PROMPTS)), (F.col("event_id") % len(PROMPTS)).cast("int"))
    return kb.table("events").select("event_id", scalar.fast_path(prompt).alias("i")).select("event_id", "i.action", "i.target")


@query(r"SELECT doc_id, CASE WHEN length(regexp_replace(text, '[\x00-\x7F]', '', 'g')) / greatest(1, length(text)) > 0.15 THEN 'es' ELSE 'en' END AS lang FROM documents")
def nonascii_lang(kb: KB) -> DataFrame:
    return kb.table("documents").select("doc_id", scalar.fallback_language(F.col("text")).alias("lang"))


@query(f"""SELECT media_id, src, scene_id, t_us, source, CASE WHEN m IS NOT NULL AND abs(m - c) > 0.01 THEN floor(m * 1e4 + 0.5) / 1e4 ELSE floor(c * 1e6 + 0.5) / 1e6 END AS confidence
    FROM (SELECT *, CASE coalesce(source, 'graph') {_MAPS} END::DOUBLE AS m FROM (SELECT *, confidence AS c FROM appears))""")
def calibrate_confidence(kb: KB) -> DataFrame:
    c = scalar.calibrated(F.col("confidence"), F.col("source"))
    same = F.col("c") == F.col("confidence")
    return kb.appearances.withColumn("c", c).select("media_id", "src", "scene_id", "t_us", "source", F.when(same, r6("confidence")).otherwise(F.col("c")).alias("confidence"))


@query("""SELECT p_partkey, CASE WHEN s = '' THEN 'unknown' ELSE s END AS slug FROM (SELECT p_partkey, regexp_replace(regexp_replace(lower(p_name || ' / ' || p_brand || '!'), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS s FROM part)""")
def slug_ids(kb: KB) -> DataFrame:
    return kb.table("part").select("p_partkey", scalar.slug(F.concat_ws(" / ", "p_name", F.concat("p_brand", F.lit("!")))).alias("slug"))


_WORDS = ("laptop", "laptops", "dogs", "dog", "glasses", "cats", "bus", "cups")


@query("""WITH o AS (SELECT event_id, ['laptop', 'laptops', 'dogs', 'dog', 'glasses', 'cats', 'bus', 'cups'][event_id % 8 + 1] AS raw FROM events),
    l AS (SELECT event_id, raw, CASE raw WHEN 'laptops' THEN 'laptop' WHEN 'glasses' THEN 'glass' WHEN 'cups' THEN 'cup' ELSE raw END AS lemma FROM o)
    SELECT event_id, 'object:' || CASE WHEN lemma LIKE '%s' AND lemma <> 'glass' AND lemma[:-2] IN (SELECT raw FROM o) THEN lemma[:-2] ELSE lemma END AS entity FROM l""")
def resolve_objects(kb: KB) -> DataFrame:
    """Lemmas, then the singular where it is a label too."""
    o = kb.table("events").select("event_id", F.get(F.array(*map(F.lit, _WORDS)), (F.col("event_id") % 8).cast("int")).alias("raw"))
    lemma = F.coalesce(F.create_map(*(F.lit(x) for kv in scalar.LEMMAS.items() for x in kv))[F.col("raw")], F.col("raw"))
    named = o.withColumn("lemma", lemma)
    singular = F.when(F.endswith("lemma", F.lit("s")) & ~F.col("lemma").isin(*scalar.LEMMAS.values()), F.expr("substring(lemma, 1, length(lemma) - 1)"))
    known = o.select(F.col("raw").alias("singular")).distinct().withColumn("known", F.lit(True))
    return named.withColumn("singular", singular).join(known, "singular", "left").select("event_id", F.concat(F.lit("object:"), F.when(F.col("known"), F.col("singular")).otherwise(F.col("lemma"))).alias("entity"))


_LABELS = ("Singing bowl", "Baby GIGGLING", "Crowd cheering", "Doorbell", "Typing", "Ringtone", "Sneeze", "Sigh", "Wind")


@query("SELECT event_id, ['music', 'laughter', 'applause', 'door_slam', 'keyboard', 'phone_ring', 'cough', 'gasp', NULL][event_id % 9 + 1] AS label FROM events")
def classify_label(kb: KB) -> DataFrame:
    raw = F.get(F.array(*map(F.lit, _LABELS)), (F.col("event_id") % len(_LABELS)).cast("int"))
    return kb.table("events").select("event_id", scalar.canonical_sound(raw).alias("label"))


@query("""SELECT event_id, unnest(CASE event_id % 3 WHEN 0 THEN ['the pricing part', 'the price part', 'the cost part', 'the rates part', 'the subscription part', 'the charge part']
    WHEN 1 THEN ['awkward sponsor', 'pause sponsor', 'silence sponsor', 'stumble sponsor', 'repeat sponsor'] ELSE ['else'] END) AS query FROM events""")
def expand_query(kb: KB) -> DataFrame:
    q = F.get(F.array(F.lit("the pricing part"), F.lit("awkward sponsor"), F.lit("else")), (F.col("event_id") % 3).cast("int"))
    return kb.table("events").select("event_id", F.explode(scalar.expanded(q)).alias("query"))


@query(r"""SELECT w AS token, count(*) AS n, count(DISTINCT doc_id) AS docs FROM (SELECT doc_id, unnest(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '')) AS w FROM documents) GROUP BY 1 HAVING count(*) >= 20""")
def tokenize(kb: KB) -> DataFrame:
    t = kb.table("documents").select("doc_id", F.explode(sequences.tokens(F.col("text"))).alias("token"))
    return t.groupBy("token").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("docs")).filter("n >= 20")


@query("""WITH n AS (SELECT p_name AS name, count(*) AS parts FROM part GROUP BY 1) SELECT a.name AS a, b.name AS b, a.parts AS a_parts, b.parts AS b_parts, floor((1 - levenshtein(a.name, b.name) / greatest(length(a.name), length(b.name))) * 1e6 + 0.5) / 1e6 AS ratio
    FROM n a JOIN n b ON a.name < b.name WHERE levenshtein(a.name, b.name) * 10 <= greatest(length(a.name), length(b.name)) * 3""")
def fuzzy_match(kb: KB) -> DataFrame:
    """All pairs of names with a Levenshtein ratio of 0.7 or more, equal names as one, with their parts' number.

    At that ratio two names of length L or less differ by 0.3 L edits, each of which breaks two of L - 1 bigrams at most: one is left
    that both have, and there they meet.
    """
    names = kb.table("part").filter("p_name is not null").groupBy(F.col("p_name").alias("name")).agg(F.count("*").alias("parts"))
    grams = names.filter("length(name) > 1").withColumn("g", F.explode(F.expr("array_distinct(transform(sequence(1, length(name) - 1), i -> substring(name, i, 2)))")))
    b = grams.select("g", F.col("name").alias("b"), F.col("parts").alias("b_parts"))
    pairs = grams.select("g", F.col("name").alias("a"), F.col("parts").alias("a_parts")).join(b, "g").filter("a < b and 10 * abs(length(a) - length(b)) <= 3 * greatest(length(a), length(b))").drop("g").distinct()
    longest = F.greatest(F.length("a"), F.length("b"))
    near = pairs.withColumn("d", F.levenshtein("a", "b")).filter(F.col("d") * 10 <= longest * 3)
    return near.select("a", "b", "a_parts", "b_parts", r6(1 - F.col("d") / longest).alias("ratio"))


@query("SELECT id, CASE WHEN motion < 0.05 THEN 'screencast' WHEN importance * 10 > 1.2 AND motion < 0.20 THEN 'talking_head' ELSE 'standard' END AS class FROM scenes")
def content_class(kb: KB) -> DataFrame:
    return kb.scenes.select("id", scalar.content_class(F.col("motion"), F.col("importance") * 10).alias("class"))


@query("""WITH c AS (SELECT media_id, id, start_us, motion, end_us - start_us AS d, CASE WHEN motion < 0.05 THEN 'screencast' WHEN importance * 10 > 1.2 AND motion < 0.20 THEN 'talking_head' ELSE 'standard' END AS k FROM scenes),
    t AS (SELECT *, CASE WHEN (k = 'screencast' AND motion < 0.1) OR (motion < 0.05 AND d < 5000000) THEN 0 WHEN motion > 0.5 OR (d > 30000000 AND id % 2 = 1) THEN 2 ELSE 1 END AS tier FROM c)
    SELECT media_id, id, tier, CAST(max(tier) OVER (PARTITION BY media_id, start_us // 120000000) AS INTEGER) AS batch_tier FROM t""")
def effort_tier(kb: KB) -> DataFrame:
    """A scene's tier, and the highest of its batch (two minutes)."""
    s = kb.scenes
    tier = scalar.effort_tier(F.col("motion"), F.col("end_us") - F.col("start_us"), scalar.content_class(F.col("motion"), F.col("importance") * 10), F.col("id") % 2 == 0)
    t = s.select("media_id", "id", tier.alias("tier"), F.expr("start_us div 120000000").alias("batch"))
    return t.join(t.groupBy("media_id", "batch").agg(F.max("tier").alias("batch_tier")), ["media_id", "batch"]).select("media_id", "id", "tier", "batch_tier")


@query("SELECT media_id, start_us, CASE WHEN least(80000, (end_us - start_us) // 2) > 1000 THEN least(80000, (end_us - start_us) // 2) ELSE 0 END AS fade_us FROM sig")
def fade_clamp(kb: KB) -> DataFrame:
    return kb.signals.select("media_id", "start_us", scalar.clamped_fade(F.lit(80_000).cast("long"), F.col("end_us") - F.col("start_us")).cast("long").alias("fade_us"))


@query("""WITH w AS (SELECT s.media_id, s.id, count(g.id) AS n FROM scenes s LEFT JOIN sig g ON s.media_id = g.media_id AND g.start_us >= s.start_us AND g.start_us < s.end_us GROUP BY 1, 2)
    SELECT s.media_id, s.id, floor((0.70::DOUBLE * s.importance + 0.15::DOUBLE * s.motion + 0.15::DOUBLE * least(w.n / greatest(0.1::DOUBLE, (s.end_us - s.start_us) / 1e6) / 4, 1.0::DOUBLE)) * 1e3 + 0.5) / 1e3 AS importance FROM scenes s JOIN w ON s.media_id = w.media_id AND s.id = w.id""")
def importance(kb: KB) -> DataFrame:
    """The composite over each scene's score, motion and events per second."""
    n = kb.appearances.groupBy("media_id", F.col("scene_id").alias("id")).agg(F.count("*").alias("n"))
    s = kb.scenes.join(n, ["media_id", "id"], "left")
    return s.select("media_id", "id", scalar.importance(F.col("importance"), F.col("motion"), F.coalesce("n", F.lit(0)), F.col("end_us") - F.col("start_us")).alias("importance"))


@query("SELECT media_id, id, CAST(round_even(start_us * 30 / 1e6, 0) AS BIGINT) AS frame FROM sig")
def quantize_grid(kb: KB) -> DataFrame:
    """The nearest frame at 30 a second, halves to the even one."""
    return kb.signals.select("media_id", "id", F.rint(F.col("start_us") * 30 / 1e6).cast("long").alias("frame"))


_MESSAGES = ("HTTP %d from upstream", "Throttling: rate exceeded (%d)", "bad key %d", "peer: Connection reset by peer, attempt %d", "ModelNotReadyException %d")


@query("""WITH m AS (SELECT event_id, lower(printf(['HTTP %d from upstream', 'Throttling: rate exceeded (%d)', 'bad key %d', 'peer: Connection reset by peer, attempt %d', 'ModelNotReadyException %d'][event_id % 5 + 1], 400 + event_id % 200)) AS m FROM events)
    SELECT event_id, m LIKE '%throttl%' OR m LIKE '%429%' OR m LIKE '%500%' OR m LIKE '%502%' OR m LIKE '%503%' OR m LIKE '%504%' OR m LIKE '%connection%' OR m LIKE '%modelnotready%' AS transient FROM m""")
def transient_errors(kb: KB) -> DataFrame:
    """Messages of errors that pass (here: made of an event's number)."""
    i = F.col("event_id")
    message = F.get(F.array(*(F.format_string(m, 400 + i % 200) for m in _MESSAGES)), (i % len(_MESSAGES)).cast("int"))
    return kb.table("events").select("event_id", udfs.is_transient(message).alias("transient"))


@query("""WITH t AS (SELECT o_orderkey, CASE WHEN o_custkey % 5 = 0 THEN -1 ELSE CAST(floor(o_totalprice) AS BIGINT) * 1000 END AS target, (1 + o_custkey % 300)::BIGINT * 1000000 AS video FROM orders)
    SELECT o_orderkey, least(CASE WHEN target <= 0 THEN 3000000 ELSE target END, video) AS target_us FROM t""")
def target_clamp(kb: KB) -> DataFrame:
    k = F.col("o_custkey")
    target = F.when(k % 5 == 0, -1).otherwise(F.floor("o_totalprice") * 1000)
    return kb.table("orders").select("o_orderkey", scalar.target_duration(target, (1 + k % 300).cast("long") * 1_000_000).cast("long").alias("target_us"))
