"""Retrieval channels, fusion, vectors and the graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar, udfs
from ..operators import intervals as iv
from ..operators import search, vectors
from ..plans import edit, requests, retrieve
from ..sources.kb import KB
from .base import query, r6

M = ["media_id"]

def _channel(kb: KB, name: str, *queries: str) -> DataFrame:
    """What a channel of the registry finds for queries over every media item."""
    return requests.channel(kb, name, requests.of_every_item(kb, list(queries))).select("query_id", "media_id", "start_us", "end_us", r6("score").alias("score"), "source")


@query("SELECT 0 AS query_id, media_id, start_us, end_us, 1.0::DOUBLE AS score, 'vad' AS source FROM silences WHERE end_us - start_us > 2000000 UNION ALL SELECT 1, media_id, start_us, end_us, 1.0, 'vad' FROM silences")
def ch_silence(kb: KB) -> DataFrame:
    return _channel(kb, "silence", "silence > 2.0s", "all the pauses")


@query(r"""WITH w AS (SELECT *, regexp_replace(lower(word), '^[^a-z0-9]+|[^a-z0-9]+$', '', 'g') AS w FROM words), r AS (SELECT *, count(*) FILTER (w IN ('and', 'la', 'der')) OVER h / count(*) OVER h AS rate FROM w WINDOW h AS (PARTITION BY media_id, speaker)),
    n AS (SELECT *, lead(w) OVER o AS w2, lead(end_us) OVER o AS e2 FROM w WINDOW o AS (PARTITION BY media_id ORDER BY start_us, utt_id, idx))
    SELECT media_id, start_us, end_us, CASE WHEN w IN ('the', 'que') THEN 0.95::DOUBLE ELSE floor(greatest(0.3, 0.7 - rate * 2) * 1e6 + 0.5) / 1e6 END AS score, 'filler_detector' AS source FROM r WHERE w IN ('the', 'que', 'and', 'la', 'der')
    UNION ALL SELECT media_id, start_us, e2, 0.9, 'filler_phrases' FROM n WHERE w || ' ' || w2 IN ('of the', 'in the', 'de la')""")
def ch_filler(kb: KB) -> DataFrame:
    """The texts have no fillers; their commonest words stand in for sure and likely ones and for phrases."""
    out = retrieve.filler_channel(kb, "", ("the", "que"), ("and", "la", "der"), ("of the", "in the", "de la"))
    return out.select("media_id", "start_us", "end_us", r6("score").alias("score"), "source")


@query("""SELECT 0 AS query_id, s.media_id, s.start_us, s.end_us, 1.0::DOUBLE AS score, 'graph' AS source FROM scenes s WHERE EXISTS (FROM appears a WHERE a.media_id = s.media_id AND a.scene_id = s.id AND a.src = 'person:7')
    UNION ALL SELECT 1, s.media_id, s.start_us, s.end_us, 1.0, 'graph' FROM scenes s WHERE EXISTS (FROM appears a JOIN people p ON p.media_id = a.media_id AND p.entity_id = a.src WHERE is_owner AND a.media_id = s.media_id AND a.scene_id = s.id)
    UNION ALL SELECT 2, s.media_id, s.start_us, s.end_us, 1.0, 'graph' FROM scenes s WHERE EXISTS (FROM appears a JOIN people p ON p.media_id = a.media_id AND p.entity_id = a.src WHERE label = 'guest 3' AND a.media_id = s.media_id AND a.scene_id = s.id)""")
def ch_person(kb: KB) -> DataFrame:
    """By id, as the owner, and by label."""
    return _channel(kb, "person", "scenes with person:7", "what shows me", "the speaker Guest 3")


@query("SELECT 0 AS query_id, media_id, start_us, end_us, 1.0::DOUBLE AS score, 'location' AS source FROM scenes WHERE location = 'loc3'")
def ch_location(kb: KB) -> DataFrame:
    return _channel(kb, "location", "cut loc3 please", "cut loc33")


@query("SELECT i AS query_id, media_id, start_us, end_us, floor(CASE WHEN confidence IS NULL OR confidence = 0 THEN 0.8::DOUBLE ELSE confidence END * 1e6 + 0.5) / 1e6 AS score, 'audio_events' AS source FROM audio JOIN (VALUES (0, 'laughter'), (1, 'applause')) v(i, t) ON type = t")
def ch_audio_event(kb: KB) -> DataFrame:
    return _channel(kb, "sound", "keep the laughing", "the clapping and the gasping")


@query("""SELECT 0 AS query_id, media_id, start_us, end_us, floor(intensity * 1e6 + 0.5) / 1e6 AS score, 'emotion' AS source FROM scenes WHERE emotion IN ('happy', 'joy', 'amused', 'excited') AND intensity > 0.5
    UNION ALL SELECT 1, media_id, start_us, end_us, floor(intensity * 1e6 + 0.5) / 1e6, 'emotion' FROM scenes WHERE intensity > 0.6 UNION ALL SELECT 2, media_id, start_us, end_us, floor(intensity * 1e6 + 0.5) / 1e6, 'emotion' FROM scenes WHERE emotion = 'tense' AND intensity <> 0""")
def ch_emotion(kb: KB) -> DataFrame:
    return _channel(kb, "emotion", "the funniest part", "emotional parts", "nervous, tense people")


@query("""SELECT 0 AS query_id, media_id, e AS start_us, n AS end_us, 0.7::DOUBLE AS score, 'derived_moment' AS source FROM (SELECT media_id, end_us AS e, lead(start_us) OVER (PARTITION BY media_id ORDER BY start_us, id) AS n FROM utts) WHERE n - e > 2000000
    UNION ALL SELECT 1, media_id, start_us, end_us, 0.7, 'derived_moment' FROM audio WHERE type = 'applause'
    UNION ALL SELECT DISTINCT 2, a.media_id, a.start_us, a.end_us, 0.7, 'derived_moment' FROM audio a JOIN scenes s ON s.media_id = a.media_id AND s.emotion = 'joy' AND a.type = 'laughter' AND a.start_us - 2000000 < s.end_us AND a.end_us + 2000000 > s.start_us""")
def ch_moment(kb: KB) -> DataFrame:
    return _channel(kb, "moment", "awkward moments", "the applause", "something hilarious")


@query("SELECT i AS query_id, media_id, start_us, end_us, 0.9::DOUBLE AS score, 'dialogue_act' AS source FROM utts JOIN (VALUES (0, 'question'), (1, 'answer')) v(i, a) ON dialogue_act = a")
def ch_dialogue(kb: KB) -> DataFrame:
    return _channel(kb, "dialogue", "keep only questions and answers", "her answers")


@query("SELECT i AS query_id, media_id, start_us, end_us, 0.95::DOUBLE AS score, 'topic_model' AS source FROM topics JOIN (VALUES (0, 'sport', 'none'), (1, 'none', 'sponsor'), (2, 'family', 'none')) v(i, l, c) ON label = l OR class = c")
def ch_topic(kb: KB) -> DataFrame:
    """By label, by class, and by a query that is a part of the label."""
    return _channel(kb, "topic", "everything about sport", "the sponsor and the other", "famil")


@query("""SELECT 0 AS query_id, t.media_id, start_us, end_us, 0.8::DOUBLE AS score, 'off_topic' AS source FROM topics t JOIN (SELECT media_id, arg_max(label, (us, label)) AS main FROM (SELECT media_id, label, sum(end_us - start_us) AS us FROM topics GROUP BY 1, 2) GROUP BY 1) m ON m.media_id = t.media_id AND label <> main""")
def ch_off_topic(kb: KB) -> DataFrame:
    return _channel(kb, "off_topic", "cut the tangents")


@query("""SELECT i AS query_id, s.media_id, s.start_us, s.end_us, floor(CASE WHEN confidence = 0 THEN 0.7 ELSE confidence END * 1e6 + 0.5) / 1e6 AS score, 'graph_object' AS source FROM objects o JOIN scenes s ON s.media_id = o.media_id AND s.id = o.scene_id
    JOIN (VALUES (0, 'laptop'), (0, 'screen'), (1, 'phone'), (1, 'microphone'), (2, 'camera')) v(i, l) ON label = l""")
def ch_object(kb: KB) -> DataFrame:
    """By label, by a part of one, and by a word that has one."""
    return _channel(kb, "object", "the laptop or a screen", "objects like a phone", "product on cameras")


@query("SELECT i AS query_id, media_id, a * 1000000 AS start_us, b * 1000000 AS end_us, 1.0::DOUBLE AS score, 'explicit_timestamp' AS source FROM media CROSS JOIN (VALUES (0, 30, 105), (1, 10, 20)) v(i, a, b)")
def ch_time(kb: KB) -> DataFrame:
    return _channel(kb, "time", "0:30 to 1:45", "from 10 to 20 seconds", "2:00 to 1:00")


@query("""SELECT 0 AS query_id, media_id, start_us, end_us, 0.9::DOUBLE AS score, 'metadata' AS source FROM scenes WHERE is_broll UNION ALL SELECT 0, media_id, start_us, end_us, 0.95, 'metadata' FROM scenes WHERE indoor = false
    UNION ALL SELECT 0, media_id, start_us, end_us, 0.85, 'metadata' FROM scenes WHERE story_role = 'hook' OR story_role = 'intro' UNION ALL SELECT 1, media_id, start_us, end_us, 0.95, 'metadata' FROM scenes WHERE indoor""")
def ch_metadata(kb: KB) -> DataFrame:
    return _channel(kb, "metadata", "b-roll outside of the hook", "the office")


@query(r"""WITH docs AS (SELECT media_id, 'u' || id AS key, text, start_us, end_us FROM utts UNION ALL SELECT media_id, 's' || id, concat_ws(' ', location, emotion, shot_type), start_us, end_us FROM scenes),
    toks AS (SELECT media_id, key, list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '') AS w FROM docs), size AS (SELECT media_id, count(*) AS n, avg(len(w)) AS avgdl FROM toks GROUP BY 1),
    post AS (SELECT media_id, key, term, count(*) AS tf, any_value(dl) AS dl FROM (SELECT media_id, key, unnest(w) AS term, len(w) AS dl FROM toks) GROUP BY 1, 2, 3),
    raw AS (SELECT media_id, term, ln(n - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM post JOIN size USING (media_id) GROUP BY media_id, term, n), mean AS (SELECT media_id, avg(raw) AS mean FROM raw GROUP BY 1),
    idf AS (SELECT media_id, term, CASE WHEN raw < 0 THEN 0.25::DOUBLE * mean ELSE raw END AS idf FROM raw JOIN mean USING (media_id)),
    okapi AS (SELECT media_id, key, floor(sum(idf * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))) * 1e5 + 0.5) / 1e5 AS raw FROM post JOIN idf USING (media_id, term) JOIN size USING (media_id) WHERE term IN ('happy', 'wide', 'loc1', 'la', 'que', 'the') GROUP BY 1, 2)
    SELECT 0 AS query_id, o.media_id, start_us, end_us, floor(least(raw / 10, 1.0) * 1e6 + 0.5) / 1e6 AS score, 'keyword' AS source FROM okapi o JOIN docs d USING (media_id, key) WHERE raw > 0 QUALIFY row_number() OVER (PARTITION BY o.media_id ORDER BY raw DESC, key) <= 20""")
def ch_keyword(kb: KB) -> DataFrame:
    """The best twenty documents of each media item, scenes among them, by an index of its own."""
    return _channel(kb, "keyword", "happy wide loc1 la que the")


@query("""WITH q AS (SELECT vec_id AS query_id, embedding FROM embeddings WHERE vec_id < 3), v AS (SELECT s.*, embedding FROM scenes s JOIN embeddings ON vec_id = s.id % 500),
    c AS (SELECT query_id, media_id, v.id, start_us, end_us, floor(list_inner_product(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) * 1e6 + 0.5) / 1e6 AS score FROM q, v),
    t AS (SELECT *, max(score) OVER (PARTITION BY query_id, media_id) AS best FROM c QUALIFY row_number() OVER (PARTITION BY query_id, media_id ORDER BY score DESC, id) <= 20)
    SELECT query_id, media_id, start_us, end_us, score, 'vector' AS source FROM t WHERE score >= greatest(0.15, best - 0.15)""")
def ch_vector(kb: KB) -> DataFrame:
    kb.query_vectors = kb.vectors.select(F.col("vec_id").alias("query_id"), "embedding").filter("query_id < 3")
    return _channel(kb, "vector", "a", "b", "c")


@query("""SELECT s.media_id, s.id FROM scenes s WHERE location = 'loc2' AND shot_type = 'medium' AND EXISTS (FROM appears a WHERE a.media_id = s.media_id AND a.scene_id = s.id AND a.src = 'person:' || s.media_id)""")
def scenes_where(kb: KB) -> DataFrame:
    own = kb.appearances.filter(F.col("src") == F.concat(F.lit("person:"), F.col("media_id").cast("string"))).select("media_id", F.col("scene_id").alias("id"))
    return retrieve.scenes_where(kb, location="loc2", shot_type="medium").join(own, ["media_id", "id"], "left_semi").select("media_id", "id")


@query("""SELECT DISTINCT s.media_id, s.id, floor(max(a.confidence) OVER (PARTITION BY s.media_id, s.id) * 1e6 + 0.5) / 1e6 AS score FROM scenes s JOIN appears a ON a.media_id = s.media_id AND a.scene_id = s.id WHERE a.source = 'faces' AND a.confidence > 0.8""")
def object_scenes(kb: KB) -> DataFrame:
    hits = kb.appearances.filter("source = 'faces' and confidence > 0.8").groupBy("media_id", F.col("scene_id").alias("id")).agg(F.max("confidence").alias("score"))
    return kb.scenes.select("media_id", "id").join(hits, ["media_id", "id"]).withColumn("score", r6("score"))


_SEGMENTS = """SELECT media_id, 'structured' AS channel, id, start_us, end_us, intensity AS score FROM scenes WHERE intensity > 0.9
    UNION ALL SELECT media_id, 'keyword', id, start_us, end_us, importance FROM scenes WHERE location = 'loc1' UNION ALL SELECT media_id, 'vector', id, start_us, end_us, motion FROM scenes WHERE motion > 0.8
    UNION ALL SELECT media_id, 'metadata', id, start_us, end_us, 0.9 FROM scenes WHERE is_broll AND story_role = 'hook'"""
_RRF = f"""c AS ({_SEGMENTS}), k AS (SELECT *, row_number() OVER (PARTITION BY media_id, channel ORDER BY score DESC, start_us, end_us, id) - 1 AS r, CASE channel WHEN 'structured' THEN 0 WHEN 'keyword' THEN 1 WHEN 'vector' THEN 2 ELSE 3 END AS o, CASE channel WHEN 'structured' THEN 3.0::DOUBLE WHEN 'metadata' THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w FROM c),
    f AS (SELECT media_id, (start_us + 5000) // 10000 AS ks, (end_us + 5000) // 10000 AS ke, least(floor(60 * sum(w / (60 + r + 1)) * 1e6 + 0.5) / 1e6, 1.0) AS score, arg_min(start_us, o * 1000000 + r) AS start_us, arg_min(end_us, o * 1000000 + r) AS end_us, string_agg(channel || ':' || id, ',' ORDER BY o, r) AS evidence, count(DISTINCT channel) AS channels FROM k GROUP BY 1, 2, 3)"""


def _segments(kb: KB) -> DataFrame:
    s = kb.scenes
    one = lambda df, name, score: df.select(F.lit(name).alias("channel"), "media_id", "id", "start_us", "end_us", score.alias("score"), F.concat_ws(":", F.lit(name), F.col("id").cast("string")).alias("evidence"))
    parts = [one(s.filter("intensity > 0.9"), "structured", F.col("intensity")), one(s.filter("location = 'loc1'"), "keyword", F.col("importance")), one(s.filter("motion > 0.8"), "vector", F.col("motion")), one(s.filter("is_broll and story_role = 'hook'"), "metadata", F.lit(0.9))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query(f"WITH {_RRF} SELECT media_id, start_us, end_us, score, evidence, channels, score >= 0.35 AND score <= 0.55 AS needs_confirmation FROM f WHERE score >= 0.175")
def rrf(kb: KB) -> DataFrame:
    return search.fuse(_segments(kb)).withColumn("evidence", F.array_join("evidence", ","))


@query(f"SELECT channel, id, floor(score * 1e6 + 0.5) / 1e6 AS score FROM ({_SEGMENTS}) ORDER BY floor(score * 1e6 + 0.5) / 1e6 DESC, id, channel LIMIT 10")
def ask_topk(kb: KB) -> DataFrame:
    """The best ten of all channels by their own scores."""
    return _segments(kb).select("channel", "id", r6("score").alias("score")).orderBy(F.desc("score"), "id", "channel").limit(10)


@query(f"""WITH {_RRF}, t AS (SELECT * FROM f WHERE score >= 0.175 AND score >= 0.35), i AS (SELECT *, max(end_us) OVER (PARTITION BY media_id ORDER BY start_us, end_us ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM t),
    g AS (SELECT *, sum(CASE WHEN p IS NULL OR start_us - p > 1000000 THEN 1 ELSE 0 END) OVER (PARTITION BY media_id ORDER BY start_us, end_us ROWS UNBOUNDED PRECEDING) AS g FROM i)
    SELECT media_id, min(start_us) AS start_us, max(end_us) AS end_us, max(score) AS score, count(*) AS n FROM g GROUP BY media_id, g""")
def fused_merged(kb: KB) -> DataFrame:
    """Channels, fusion, the threshold, and the merge of neighbours, in each media item."""
    return retrieve.merged_hits(search.fuse(_segments(kb)), 0.35)


#: Requests of every media item that call each kind of channel.
REQUESTS = ("silence > 2.0s", "the funniest scenes", "b-roll outside of the hook", "scenes about travel", "the questions at loc3", "laughing while happy scenes", "0:30 to 1:45", "the laptop", "person:7 off-topic tangent", "who mentions la que")
_PARTS = [(q, "w0", text) for q, text in enumerate(REQUESTS) if q not in (0, 5, 6)] + [(5, f"w{i}", f"{x} while happy scenes") for i, x in enumerate(("laughing", "laugh", "laughter", "chuckle", "gasp"))] + [(5, f"a{i}", x) for i, x in enumerate(("laughing", "laugh", "laughter", "chuckle", "gasp"))] + [(5, "b0", "happy scenes")]
_HYBRID = rf"""WITH parts(query_id, part, q) AS (VALUES {", ".join(f"({q}, '{p}', '{t}')" for q, p, t in _PARTS)}),
    asked AS (SELECT p.*, media_id FROM parts p CROSS JOIN media),
    happy AS (SELECT *, emotion LIKE '%happy%' OR emotion LIKE '%joy%' AS yes FROM scenes WHERE intensity <> 0),
    docs AS (SELECT media_id, 'u' || id AS key, text, start_us, end_us, NULL::BIGINT AS scene_id FROM utts UNION ALL SELECT media_id, 's' || id, concat_ws(' ', location, emotion, shot_type), start_us, end_us, id FROM scenes),
    toks AS (SELECT media_id, key, list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '') AS w FROM docs), size AS (SELECT media_id, count(*) AS n, avg(len(w)) AS avgdl FROM toks GROUP BY 1),
    post AS (SELECT media_id, key, term, count(*) AS tf, any_value(dl) AS dl FROM (SELECT media_id, key, unnest(w) AS term, len(w) AS dl FROM toks) GROUP BY 1, 2, 3),
    raw AS (SELECT media_id, term, ln(n - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM post JOIN size USING (media_id) GROUP BY media_id, term, n), mean AS (SELECT media_id, avg(raw) AS mean FROM raw GROUP BY 1),
    idf AS (SELECT media_id, term, CASE WHEN raw < 0 THEN 0.25::DOUBLE * mean ELSE raw END AS idf FROM raw JOIN mean USING (media_id)),
    words_of AS (SELECT query_id, part, media_id, unnest(regexp_split_to_array(lower(q), '\s+')) AS term FROM asked),
    okapi AS (SELECT query_id, part, media_id, key, floor(sum(idf * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))) * 1e5 + 0.5) / 1e5 AS raw FROM words_of JOIN post USING (media_id, term) JOIN idf USING (media_id, term) JOIN size USING (media_id) GROUP BY 1, 2, 3, 4),
    kept AS (SELECT o.query_id, o.part, o.media_id, d.start_us, d.end_us, least(raw / 10, 1.0) AS score, scene_id FROM okapi o JOIN docs d USING (media_id, key) WHERE raw > 0 QUALIFY row_number() OVER (PARTITION BY o.query_id, o.part, o.media_id ORDER BY raw DESC, key) <= 20),
    vecs AS (SELECT s.*, embedding FROM scenes s JOIN embeddings ON vec_id = s.id % 500),
    sims AS (SELECT query_id, part, a.media_id, v.start_us, v.end_us, v.id, floor(list_inner_product(e.embedding::DOUBLE[], v.embedding::DOUBLE[]) * 1e6 + 0.5) / 1e6 AS score FROM asked a JOIN embeddings e ON e.vec_id = query_id JOIN vecs v ON v.media_id = a.media_id),
    tops AS (SELECT *, max(score) OVER (PARTITION BY query_id, part, media_id) AS best FROM sims QUALIFY row_number() OVER (PARTITION BY query_id, part, media_id ORDER BY score DESC, id) <= 20),
    near AS (SELECT * FROM tops WHERE score >= greatest(0.15, best - 0.15)),
    found AS (
        SELECT query_id, media_id, part, start_us, end_us, intensity AS score, 'emotion' AS source, h.id AS scene_id, 'structured' AS channel FROM asked JOIN happy h USING (media_id) WHERE query_id = 1 AND emotion IN ('happy', 'joy', 'amused', 'excited') AND intensity > 0.5 OR query_id = 5 AND part[1] IN ('w', 'b') AND yes
        UNION ALL SELECT query_id, media_id, part, start_us, end_us, CASE WHEN confidence IS NULL OR confidence = 0 THEN 0.8 ELSE confidence END, 'audio_events', NULL, 'structured' FROM asked JOIN audio USING (media_id) WHERE query_id = 5 AND part[1] IN ('w', 'a') AND type = CASE WHEN part[2] = '4' THEN 'gasp' ELSE 'laughter' END
        UNION ALL SELECT DISTINCT query_id, a.media_id, part, a.start_us, a.end_us, 0.7, 'derived_moment', CAST(NULL AS BIGINT), 'structured' FROM asked JOIN audio a USING (media_id) JOIN scenes s ON s.media_id = a.media_id AND s.emotion = 'joy' AND a.type = 'laughter' AND a.start_us - 2000000 < s.end_us AND a.end_us + 2000000 > s.start_us WHERE query_id = 1
        UNION ALL SELECT query_id, media_id, part, start_us, end_us, 0.9, 'dialogue_act', NULL, 'structured' FROM asked JOIN utts USING (media_id) WHERE query_id = 4 AND dialogue_act = 'question'
        UNION ALL SELECT query_id, media_id, part, start_us, end_us, 1.0, 'location', id, 'structured' FROM asked JOIN scenes USING (media_id) WHERE query_id = 4 AND location = 'loc3'
        UNION ALL SELECT query_id, a.media_id, part, start_us, end_us, CASE WHEN confidence IS NULL OR confidence = 0 THEN 0.7 ELSE confidence END, 'graph_object', scene_id, 'structured' FROM asked a JOIN objects o USING (media_id) JOIN scenes s ON s.media_id = a.media_id AND s.id = scene_id WHERE query_id = 7 AND label = 'laptop'
        UNION ALL SELECT query_id, media_id, part, start_us, end_us, 0.95, 'topic_model', NULL, 'structured' FROM asked JOIN topics USING (media_id) WHERE query_id = 3 AND label = 'travel'
        UNION ALL SELECT query_id, media_id, part, start_us, end_us, 0.8, 'off_topic', NULL, 'structured' FROM asked JOIN topics USING (media_id) JOIN (SELECT media_id, arg_max(label, (us, label)) AS main FROM (SELECT media_id, label, sum(end_us - start_us) AS us FROM topics GROUP BY 1, 2) GROUP BY 1) USING (media_id) WHERE query_id = 8 AND label <> main
        UNION ALL SELECT DISTINCT query_id, a.media_id, part, s.start_us, s.end_us, 1.0, 'graph', s.id, 'structured' FROM asked a JOIN appears p USING (media_id) JOIN scenes s ON s.media_id = a.media_id AND s.id = p.scene_id WHERE query_id = 8 AND src = 'person:7'
        UNION ALL SELECT query_id, media_id, part, start_us, end_us, unnest(list_filter([CASE WHEN is_broll THEN 0.9 END, CASE WHEN indoor = false THEN 0.95 END, CASE WHEN story_role IN ('hook', 'intro') THEN 0.85 END], lambda x: x IS NOT NULL)), 'metadata', id, 'metadata' FROM asked JOIN scenes USING (media_id) WHERE query_id = 2
        UNION ALL SELECT query_id, media_id, part, start_us, end_us, score, 'keyword', scene_id, 'keyword' FROM kept
        UNION ALL SELECT query_id, media_id, part, start_us, end_us, score, 'vector', id, 'vector' FROM near),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id, media_id, part, channel ORDER BY score DESC, start_us, end_us, coalesce(scene_id, -1)) - 1 AS r, CASE channel WHEN 'structured' THEN 0 WHEN 'keyword' THEN 1 WHEN 'vector' THEN 2 ELSE 3 END AS o, CASE channel WHEN 'structured' THEN 3.0::DOUBLE WHEN 'metadata' THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w FROM found),
    fused AS (SELECT query_id, media_id, part, (start_us + 5000) // 10000 AS ks, (end_us + 5000) // 10000 AS ke, least(floor(60 * sum(w / (60 + r + 1)) * 1e6 + 0.5) / 1e6, 1.0) AS score, arg_min(start_us, o * 1000000 + r) AS start_us, arg_min(end_us, o * 1000000 + r) AS end_us, list(DISTINCT source) AS sources, list(DISTINCT scene_id) FILTER (scene_id IS NOT NULL) AS scene_ids FROM ranked GROUP BY ALL HAVING least(floor(60 * sum(w / (60 + r + 1)) * 1e6 + 0.5) / 1e6, 1.0) >= 0.175),
    met AS (SELECT a.query_id, a.media_id, greatest(a.start_us, b.start_us) AS start_us, least(a.end_us, b.end_us) AS end_us, (a.score + b.score) / 2 AS score, list_concat(a.sources, b.sources) AS sources, list_concat(a.scene_ids, b.scene_ids) AS scene_ids, false AS doubt
        FROM fused a JOIN fused b ON a.part[1] = 'a' AND b.part[1] = 'b' AND a.query_id = b.query_id AND a.media_id = b.media_id AND least(a.end_us, b.end_us) - greatest(a.start_us, b.start_us) > 200000),
    last AS (SELECT * FROM found WHERE part[1] = 'w' AND (query_id <> 5 OR part = (SELECT max(f.part) FROM found f WHERE f.query_id = 5 AND f.media_id = found.media_id AND f.part[1] = 'w'))),
    sure AS (SELECT f.query_id, f.media_id, f.part, f.ks, f.ke, count(DISTINCT l.channel) AS n FROM fused f JOIN last l ON l.query_id = f.query_id AND l.media_id = f.media_id AND l.start_us <= f.end_us AND l.end_us >= f.start_us GROUP BY ALL),
    whole AS (SELECT f.query_id, f.media_id, f.start_us, f.end_us, f.score, f.sources, f.scene_ids, f.score <= 0.55 OR (coalesce(n, 0) < 2 AND EXISTS (FROM unsure u WHERE u.media_id = f.media_id AND list_contains(f.scene_ids, u.scene_id))) AS doubt
        FROM fused f LEFT JOIN sure USING (query_id, media_id, part, ks, ke) WHERE f.part[1] = 'w' AND f.score >= 0.35 AND NOT EXISTS (FROM met m WHERE m.query_id = f.query_id AND m.media_id = f.media_id)),
    every AS (SELECT *, row_number() OVER () AS tie FROM (SELECT * FROM met UNION ALL SELECT * FROM whole)),
    seen AS (SELECT *, max(end_us) OVER (PARTITION BY query_id, media_id ORDER BY start_us, end_us, tie ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM every),
    isle AS (SELECT *, sum(CASE WHEN p IS NULL OR start_us - p > 1000000 THEN 1 ELSE 0 END) OVER (PARTITION BY query_id, media_id ORDER BY start_us, end_us, tie ROWS UNBOUNDED PRECEDING) AS g FROM seen),
    joined AS (SELECT query_id, media_id, min(start_us) AS start_us, max(end_us) AS end_us, max(score) AS score, count(*) AS n, list_sort(list_distinct(flatten(list(scene_ids) FILTER (scene_ids IS NOT NULL)))) AS scene_ids, list_sort(list_distinct(flatten(list(sources)))) AS sources, bool_or(doubt) AS doubt FROM isle GROUP BY query_id, media_id, g)
    SELECT query_id, media_id, start_us, end_us, floor(score * 1e6 + 0.5) / 1e6 AS score, n, coalesce(array_to_string(scene_ids, ','), '') AS scene_ids, array_to_string(sources, ',') AS sources, doubt AS needs_confirmation FROM joined
    UNION ALL SELECT 0, s.media_id, start_us, end_us, 1.0, 1, '', 'vad', false FROM silences s WHERE end_us - start_us > 2000000 AND EXISTS (FROM words w WHERE w.media_id = s.media_id)
    UNION ALL SELECT 6, media_id, 30000000, 105000000, 1.0, 1, '', 'explicit_timestamp', false FROM media"""


@query(_HYBRID)
def hybrid_retrieve(kb: KB) -> DataFrame:
    """Ten requests of every media item in one plan: all channels, fusion, threshold, corroboration and merge; queries have vectors too."""
    kb.query_vectors = kb.vectors.select(F.col("vec_id").alias("query_id"), "embedding").filter(F.col("query_id") < len(REQUESTS))
    out = requests.retrieve_segments(kb, requests.of_every_item(kb, list(REQUESTS)))
    return out.withColumn("scene_ids", F.array_join("scene_ids", ",")).withColumn("sources", F.array_join("sources", ","))


@query("""SELECT id, channel, CASE WHEN channel IN ('vector', 'keyword') THEN p ELSE greatest(score, p) END AS score FROM (SELECT id, channel, floor(score * 1e6 + 0.5) / 1e6 AS score, floor(1 / (1 + exp(-(id % 7 - 3.0::DOUBLE))) * 1e6 + 0.5) / 1e6 AS p FROM (""" + _SEGMENTS + "))")
def rerank_combine(kb: KB) -> DataFrame:
    """A reranker's probability replaces weak evidence's score and can only raise that of the rest."""
    s = _segments(kb).select("id", "channel", r6("score").alias("score"), r6(1 / (1 + F.exp(-(F.col("id") % 7 - 3.0)))).alias("p"))
    return s.select("id", "channel", F.when(F.col("channel").isin("vector", "keyword"), F.col("p")).otherwise(F.greatest("score", "p")).alias("score"))


@query("""SELECT s.media_id, s.id, count(DISTINCT a.type) < 2 AS needs_confirmation FROM scenes s LEFT JOIN audio a ON a.media_id = s.media_id AND a.start_us <= s.end_us AND a.end_us >= s.start_us AND a.type <> 'gasp' WHERE EXISTS (FROM unsure u WHERE u.media_id = s.media_id AND u.scene_id = s.id) GROUP BY 1, 2""")
def corroborate(kb: KB) -> DataFrame:
    """Scenes that need verification and that fewer than two channels touch."""
    s = kb.scenes.select("media_id", "id", "start_us", "end_us").join(kb.unsure.withColumnRenamed("scene_id", "id"), ["media_id", "id"], "left_semi")
    a = kb.audio_events.filter("type <> 'gasp'").select("media_id", "type", F.col("start_us").alias("b_start_us"), F.col("end_us").alias("b_end_us"))
    n = iv.overlap_join(s, a, M, 20_000_000, closed=True).groupBy("media_id", "id").agg(F.countDistinct("type").alias("n"))
    return s.join(n, ["media_id", "id"], "left").select("media_id", "id", (F.coalesce("n", F.lit(0)) < 2).alias("needs_confirmation"))


_INNER = "list_inner_product({a}.embedding::DOUBLE[], {b}.embedding::DOUBLE[])"


@query(f"""SELECT query_id, vec_id, score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, max(score) OVER (PARTITION BY query_id) AS best FROM (
    SELECT q.vec_id AS query_id, v.vec_id, floor({_INNER.format(a="q", b="v")} * 1e6 + 0.5) / 1e6 AS score FROM embeddings q, embeddings v WHERE q.vec_id % 20 = 0))
    WHERE rank <= 20 AND score >= greatest(0.15, best - 0.5)""")
def vector_topk(kb: KB) -> DataFrame:
    """Exact search with an absolute and a relative cut-off."""
    v = kb.vectors
    q = v.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    hits = vectors.top_k(q, v, 20, "query_id", "vec_id", "embedding", 6)
    best = F.max("score").over(Window.partitionBy("query_id"))
    return hits.withColumn("best", best).filter(F.col("score") >= F.greatest(F.lit(0.15), F.col("best") - 0.5)).select("query_id", "vec_id", "score", "rank")


@query(f"""WITH c AS (SELECT label, list(m ORDER BY i) AS embedding FROM (SELECT label, i, avg(e) AS m FROM (SELECT label, unnest(embedding)::DOUBLE AS e, unnest(range(64)) AS i FROM embeddings) GROUP BY 1, 2) GROUP BY 1),
    s AS (SELECT v.vec_id, c.label, floor(list_cosine_similarity(v.embedding::DOUBLE[], c.embedding) * 1e5 + 0.5) / 1e5 AS score FROM embeddings v, c)
    SELECT vec_id, arg_max(label, score * 1000 - label / 1e6) AS label, max(score) AS score FROM s GROUP BY 1 HAVING max(score) > 0.3""")
def registry_match(kb: KB) -> DataFrame:
    """Each vector's best registered identity above a threshold."""
    c = vectors.centroids(kb.vectors, ["label"], "embedding").filter("centroid is not null")
    return vectors.best_match(kb.vectors, c, "vec_id", "embedding", "label", "centroid").filter("score > 0.3")


@query("""WITH c AS (SELECT label, reel, list(m ORDER BY i) AS v FROM (SELECT label, reel, i, avg(e) AS m FROM (SELECT label, vec_id // 200 AS reel, unnest(embedding)::DOUBLE AS e, unnest(range(64)) AS i FROM embeddings) GROUP BY 1, 2, 3) GROUP BY 1, 2),
    p AS (SELECT a.label AS a_label, a.reel AS a_reel, b.label AS b_label, b.reel AS b_reel, floor(list_cosine_similarity(a.v, b.v) * 1e5 + 0.5) / 1e5 AS similarity FROM c a JOIN c b ON (a.label, a.reel) < (b.label, b.reel)) SELECT * FROM p WHERE similarity > 0.3""")
def people_pairs(kb: KB) -> DataFrame:
    """Identity merges: the persons of all reels (here: a label's vectors of a reel of two hundred), every pair above a similarity."""
    people = vectors.centroids(kb.vectors.select("label", F.expr("vec_id div 200").alias("reel"), "embedding"), ["label", "reel"], "embedding")
    pairs = vectors.similar_pairs(people.filter("centroid is not null").select(F.struct("label", "reel").alias("id"), "centroid"), "id", "centroid", 0.3)
    found = pairs.select("a.*", F.col("b.label").alias("b_label"), F.col("b.reel").alias("b_reel"), (F.floor(F.col("similarity") * 1e5 + 0.5) / 1e5).alias("similarity"))
    return found.withColumnsRenamed({"label": "a_label", "reel": "a_reel"}).filter("similarity > 0.3")


@query(f"""WITH e AS (SELECT vec_id // 200 AS reel, vec_id // 10 AS scene, arg_min(embedding, vec_id) AS f, arg_max(embedding, vec_id) AS l, min(vec_id) AS head, max(vec_id) AS tail FROM embeddings GROUP BY 1, 2)
    SELECT tail, head, similarity, similarity >= 0.72 AS match FROM (SELECT x.tail, y.head, floor(list_inner_product(x.l::DOUBLE[], y.f::DOUBLE[]) * 1e5 + 0.5) / 1e5 AS similarity FROM e x JOIN e y ON x.reel = y.reel AND x.scene <> y.scene)""")
def match_matrix(kb: KB) -> DataFrame:
    """Each scene's last frame against the first frames of the other scenes of its reel (here: twenty scenes of ten vectors)."""
    e = kb.vectors.groupBy(F.expr("vec_id div 200").alias("reel"), F.expr("vec_id div 10").alias("scene")).agg(F.min_by("embedding", "vec_id").alias("f"), F.max_by("embedding", "vec_id").alias("l"), F.min("vec_id").alias("head"), F.max("vec_id").alias("tail"))
    y = e.select("reel", F.col("scene").alias("other"), "f", "head")
    s = e.select("reel", "scene", "l", "tail").join(y, "reel").filter("scene <> other").select("tail", "head", (F.floor(vectors.inner("l", "f") * 1e5 + 0.5) / 1e5).alias("similarity"))
    return s.withColumn("match", F.col("similarity") >= 0.72)


@query("""SELECT scene, floor(list_inner_product(f::DOUBLE[], l::DOUBLE[]) / sqrt(list_inner_product(f::DOUBLE[], f::DOUBLE[]) * list_inner_product(l::DOUBLE[], l::DOUBLE[])) * 1e5 + 0.5) / 1e5 AS similarity, first_id, last_id FROM (
    SELECT vec_id // 10 AS scene, arg_min(embedding, vec_id) AS f, arg_max(embedding, vec_id) AS l, min(vec_id) AS first_id, max(vec_id) AS last_id FROM embeddings GROUP BY 1)""")
def boundary_vectors(kb: KB) -> DataFrame:
    """First and last frame of each scene (here: ten vectors) and how alike they are."""
    g = kb.vectors.groupBy(F.expr("vec_id div 10").alias("scene")).agg(F.min_by("embedding", "vec_id").alias("f"), F.max_by("embedding", "vec_id").alias("l"), F.min("vec_id").alias("first_id"), F.max("vec_id").alias("last_id"))
    return g.select("scene", (F.floor(vectors.inner(vectors.unit("f"), vectors.unit("l")) * 1e5 + 0.5) / 1e5).alias("similarity"), "first_id", "last_id")


@query("SELECT media_id, src, 'appears_in' AS rel, dst, 0.9::DOUBLE AS confidence FROM appears UNION ALL SELECT media_id, 'scene:' || id, 'located_in', 'location:' || location, 0.85 FROM scenes UNION ALL SELECT media_id, 'scene:' || id, 'expresses', 'emotion:' || emotion, floor(coalesce(nullif(intensity, 0), 0.5) * 1e6 + 0.5) / 1e6 FROM scenes")
def emit_relations(kb: KB) -> DataFrame:
    scene = F.concat(F.lit("scene:"), F.col("id").cast("string")).alias("src")
    seen = kb.appearances.select("media_id", "src", F.lit("appears_in").alias("rel"), "dst", F.lit(0.9).alias("confidence"))
    located = kb.scenes.select("media_id", scene, F.lit("located_in").alias("rel"), F.concat(F.lit("location:"), "location").alias("dst"), F.lit(0.85).alias("confidence"))
    felt = kb.scenes.select("media_id", scene, F.lit("expresses").alias("rel"), F.concat(F.lit("emotion:"), "emotion").alias("dst"), r6(F.when(F.col("intensity") == 0, 0.5).otherwise(F.coalesce("intensity", F.lit(0.5)))).alias("confidence"))
    return seen.unionByName(located).unionByName(felt)


@query("""SELECT DISTINCT a.media_id, 'funny' AS kind, a.start_us, a.end_us FROM audio a JOIN scenes s ON s.media_id = a.media_id AND s.emotion = 'joy' AND a.type = 'laughter' AND a.start_us - 2000000 < s.end_us AND a.end_us + 2000000 > s.start_us
    UNION ALL SELECT media_id, 'applause', start_us, end_us FROM audio WHERE type = 'applause'
    UNION ALL SELECT media_id, 'awkward', e, n FROM (SELECT media_id, end_us AS e, lead(start_us) OVER (PARTITION BY media_id ORDER BY start_us, id) AS n FROM utts) WHERE n - e > 2000000""")
def derived_moments(kb: KB) -> DataFrame:
    return retrieve.derived_moments(kb)


@query("""SELECT s.media_id, s.id FROM scenes s WHERE EXISTS (FROM objects o WHERE o.media_id = s.media_id AND o.scene_id = s.id AND o.label = 'laptop') AND EXISTS (FROM topics t WHERE t.media_id = s.media_id AND t.label = 'travel' AND t.start_us < s.end_us AND t.end_us > s.start_us) AND NOT is_broll""")
def scenes_with(kb: KB) -> DataFrame:
    """Scenes by what they hold and what is talked about in them."""
    return retrieve.scenes_where(kb, is_broll=False, holds="laptop", topic="travel").select("media_id", "id")


@query("""WITH n AS (SELECT media_id, id, lead(id) OVER (PARTITION BY media_id ORDER BY start_us, id) AS n FROM scenes),
    t AS (SELECT DISTINCT u.media_id, u.speaker, t.label FROM utts u JOIN topics t ON t.media_id = u.media_id AND u.start_us < t.end_us AND u.end_us > t.start_us)
    SELECT media_id, 'scene:' || id AS src, 'followed_by' AS rel, 'scene:' || n AS dst, 1.0::DOUBLE AS confidence FROM n WHERE n IS NOT NULL UNION ALL SELECT media_id, 'person:' || speaker, 'speaks_about', 'topic:' || label, 0.8 FROM t""")
def emit_links(kb: KB) -> DataFrame:
    """Relations of scenes to the next, and of speakers to the topics of their time."""
    w = Window.partitionBy("media_id").orderBy("start_us", "id")
    name = lambda kind, c: F.concat(F.lit(kind), F.col(c).cast("string"))
    after = kb.scenes.select("media_id", "id", F.lead("id").over(w).alias("n")).filter("n is not null").select("media_id", name("scene:", "id").alias("src"), F.lit("followed_by").alias("rel"), name("scene:", "n").alias("dst"), F.lit(1.0).alias("confidence"))
    topics = kb.topics.select("media_id", "label", F.col("start_us").alias("b_start_us"), F.col("end_us").alias("b_end_us"))
    said = iv.overlap_join(kb.utterances.select("media_id", "speaker", "start_us", "end_us"), topics, M, 60_000_000).select("media_id", "speaker", "label").distinct()
    return after.unionByName(said.select("media_id", name("person:", "speaker").alias("src"), F.lit("speaks_about").alias("rel"), name("topic:", "label").alias("dst"), F.lit(0.8).alias("confidence")))


@query("""WITH r AS (SELECT media_id, unnest(range(3)) AS i FROM media), l AS (SELECT media_id, max(end_us) AS e FROM words GROUP BY 1), f AS (SELECT media_id, list(start_us ORDER BY start_us) AS t FROM (SELECT media_id, start_us FROM words WHERE contains(lower(word), 'the') OR contains(lower(word), 'que') QUALIFY row_number() OVER (PARTITION BY media_id ORDER BY start_us, utt_id, idx) <= 3) GROUP BY 1),
    s AS (SELECT media_id, list_sort(list(DISTINCT speaker)) AS s FROM utts GROUP BY 1)
    SELECT i AS query_id, r.media_id, CASE WHEN e IS NOT NULL THEN ['topic', 'speakers', 'end'][i + 1] END AS kind, CASE WHEN e IS NOT NULL AND i = 0 THEN coalesce(array_to_string(t, ','), '') END AS times, CASE WHEN e IS NOT NULL AND i = 1 THEN coalesce(array_to_string(s, ','), '') END AS speakers, CASE WHEN i = 2 THEN e END AS end_us
    FROM r LEFT JOIN l USING (media_id) LEFT JOIN f USING (media_id) LEFT JOIN s USING (media_id)""")
def qa_answers(kb: KB) -> DataFrame:
    """Three questions of every media item; no text has prices, so that common words stand in for the terms."""
    asked = requests.of_every_item(kb, ["what about pricing?", "who is the speaker", "how long is it"])
    a = requests.answers(kb, asked, terms=("the", "que"))
    return a.select("query_id", "media_id", "kind", F.array_join(F.transform("times_us", lambda t: t.cast("string")), ",").alias("times"), F.array_join("speakers", ",").alias("speakers"), "end_us")


@query(r"""WITH e AS (SELECT media_id, entity_id, label, regexp_extract(entity_id, '[^:]*$') AS short FROM people UNION SELECT media_id, 'object:' || label, label, label FROM objects),
    r AS (SELECT media_id, unnest([0, 1, 2]) AS query_id, unnest(['scenes with the laptop and 7', 'keep the tall man', 'guest 3 in the cups']) AS q, unnest([false, true, true]) AS person FROM media),
    m AS (SELECT query_id, r.media_id, q, person, entity_id, label, list_contains(regexp_split_to_array(q, '\W+'), label) OR list_contains(regexp_split_to_array(q, '\W+'), short) AS named FROM r LEFT JOIN e USING (media_id)),
    g AS (SELECT query_id, media_id, string_agg(DISTINCT entity_id, ',' ORDER BY entity_id) FILTER (named) AS entities, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, coalesce(bool_or(contains(q, label)), false) AS held, bool_or(person) AS person FROM m GROUP BY 1, 2)
    SELECT query_id, media_id, coalesce(entities, '') AS entities, CASE WHEN person AND entities IS NULL AND NOT held THEN coalesce(labels, '') ELSE '' END AS candidates FROM g""")
def grounded_requests(kb: KB) -> DataFrame:
    """What the words of requests name in each media item, and whom to ask back for where a person isn't found."""
    asked = requests.of_every_item(kb, ["scenes with the laptop and 7", "keep the tall man", "guest 3 in the cups"]).withColumn("person", F.col("query_id") > 0)
    g = requests.grounded(kb, asked)
    return g.select("query_id", "media_id", F.array_join("entities", ",").alias("entities"), F.array_join("candidates", ",").alias("candidates"))


@query("SELECT media_id, src, scene_id, t_us, CASE WHEN confidence >= 0.85 THEN 0.95 WHEN confidence <= 0.5 THEN 0.0 ELSE floor(confidence * 1e6 + 0.5) / 1e6 END AS confidence FROM appears")
def snapped_confidence(kb: KB) -> DataFrame:
    return kb.appearances.select("media_id", "src", "scene_id", "t_us", r6(scalar.snapped_confidence(F.col("confidence"))).alias("confidence"))


@query("""SELECT event_id, CASE event_id % 3 WHEN 0 THEN props WHEN 1 THEN '{"n": [1], "p": ' || props || '}' END AS json FROM events""")
def json_extract(kb: KB) -> DataFrame:
    """JSON in an answer's text: within a fence, after other braces with a comma too many, or none."""
    i, props = F.col("event_id"), F.col("props")
    text = F.when(i % 3 == 0, F.concat(F.lit("Sure:\n```json\n"), props, F.lit("\n```"))).when(i % 3 == 1, F.concat(F.lit('{"p": '), props, F.lit(', "n": [1,]} done'))).otherwise("no braces here")
    return kb.table("events").select("event_id", udfs.extract_json(text).alias("json"))


@query("""WITH o AS (SELECT media_id, row_number() OVER (PARTITION BY media_id ORDER BY start_us, id) AS pos, start_us, end_us FROM scenes), n AS (SELECT media_id, pos, start_us + CASE WHEN pos % 3 = 0 THEN 5 ELSE 0 END AS start_us, end_us FROM o UNION ALL SELECT media_id, max(pos) + 1, 0, 9 FROM o GROUP BY 1)
    SELECT n.media_id, n.pos FROM n LEFT JOIN o ON o.media_id = n.media_id AND o.pos = n.pos AND o.start_us = n.start_us AND o.end_us = n.end_us WHERE o.pos IS NULL""")
def dirty_clips(kb: KB) -> DataFrame:
    """Clips of a revision that must be rendered (here: every third is moved, and one more added)."""
    w = Window.partitionBy("media_id").orderBy("start_us", "id")
    old = kb.scenes.select("media_id", F.row_number().over(w).cast("long").alias("pos"), "start_us", "end_us")
    new = old.withColumn("start_us", F.col("start_us") + F.when(F.col("pos") % 3 == 0, 5).otherwise(0))
    new = new.unionByName(old.groupBy("media_id").agg((F.max("pos") + 1).alias("pos")).select("media_id", "pos", F.lit(0).cast("long").alias("start_us"), F.lit(9).cast("long").alias("end_us")))
    return new.join(old, ["media_id", "pos", "start_us", "end_us"], "left_anti").select("media_id", "pos")


@query("""WITH s AS (SELECT media_id, start_us, end_us FROM scenes WHERE is_broll) SELECT media_id, start_us, end_us FROM s UNION ALL SELECT media_id, 0, 130000000 FROM media WHERE media_id NOT IN (SELECT media_id FROM s)""")
def floor_clips(kb: KB) -> DataFrame:
    """Clips, and for items that have none left, 5 % from the start."""
    return edit.with_floor(kb, kb.scenes.filter("is_broll").select("media_id", "start_us", "end_us"))
