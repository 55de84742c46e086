"""Scans, sinks and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar
from ..operators import intervals, vectors
from ..sources import kb as kbs
from ..sources.kb import KB
from .base import query, r6


@query("SELECT media_id, id, start_us, end_us, location, emotion FROM scenes ORDER BY media_id, start_us, id")
def scan_ordered(kb: KB) -> DataFrame:
    return kb.scenes.select("media_id", "id", "start_us", "end_us", "location", "emotion").orderBy("media_id", "start_us", "id")


@query("SELECT event_id, user_id, event_type, value FROM events WHERE event_id = 42")
def point_lookup(kb: KB) -> DataFrame:
    return kb.table("events").filter("event_id = 42").select("event_id", "user_id", "event_type", "value")


@query("SELECT media_id, src, rel, dst, t_us, floor(confidence * 1e6 + 0.5) / 1e6 AS confidence FROM appears WHERE rel = 'appears_in' AND source = 'vision' AND src = 'person:7'")
def relations_filter(kb: KB) -> DataFrame:
    wanted = {"rel": "appears_in", "source": "vision", "src": "person:7", "dst": None}
    df = kb.appearances
    for column, value in wanted.items():
        df = df if value is None else df.filter(F.col(column) == value)
    return df.select("media_id", "src", "rel", "dst", "t_us", r6("confidence").alias("confidence"))


@query("SELECT media_id, utt_id, idx, word, start_us, end_us FROM words WHERE end_us >= 5000000 AND start_us <= 9000000")
def words_in_range(kb: KB) -> DataFrame:
    return kb.words.filter("end_us >= 5000000 and start_us <= 9000000").select("media_id", "utt_id", "idx", "word", "start_us", "end_us")


@query("SELECT user_id, event_type, arg_max(value, event_id) AS value, max(event_id) AS event_id FROM events GROUP BY 1, 2")
def upsert_last_wins(kb: KB) -> DataFrame:
    rows = kb.table("events").select("user_id", "event_type", "value", "event_id")
    old, new = rows.filter("event_id % 2 = 0"), rows.filter("event_id % 2 = 1")
    return kbs.upsert(old, new, ["user_id", "event_type"], "event_id")


@query("SELECT coalesce(max(o_orderkey), 0) + 1 AS version FROM orders")
def next_version(kb: KB) -> DataFrame:
    return kb.table("orders").agg((F.coalesce(F.max("o_orderkey"), F.lit(0)) + 1).alias("version"))


@query("""SELECT l_suppkey % 10 AS prompt, CAST(sum(l_partkey) AS BIGINT) AS in_tokens, CAST(sum(l_orderkey % 1000) AS BIGINT) AS out_tokens,
    CAST(coalesce(sum(30 * (l_partkey - l_partkey // 2) + 3 * (l_partkey // 2) + 150 * (l_orderkey % 1000)), 0) AS BIGINT) AS cost_1e7 FROM lineitem GROUP BY 1""")
def llm_cost_total(kb: KB) -> DataFrame:
    calls = kb.table("lineitem").select((F.col("l_suppkey") % 10).alias("prompt"), F.col("l_partkey").alias("i"), (F.col("l_orderkey") % 1000).alias("o"), F.expr("l_partkey div 2").alias("c"))
    cost = F.coalesce(F.sum(scalar.call_cost_1e7(F.col("i"), F.col("o"), F.col("c"))), F.lit(0))
    return calls.groupBy("prompt").agg(F.sum("i").alias("in_tokens"), F.sum("o").alias("out_tokens"), cost.alias("cost_1e7"))


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus NOT IN ('F', 'P')")
def active_sessions(kb: KB) -> DataFrame:
    return kb.table("orders").filter(~F.col("o_orderstatus").isin("F", "P")).select("o_orderkey", "o_orderstatus")


@query("SELECT doc_id, substring(sha256(text), 1, 16) AS content_id FROM documents")
def content_id(kb: KB) -> DataFrame:
    return kb.table("documents").select("doc_id", F.substring(F.sha2("text", 256), 1, 16).alias("content_id"))


@query("""SELECT media_id, CAST(row_number() OVER (PARTITION BY media_id ORDER BY pts_us) - 1 AS BIGINT) AS frame_idx, pts_us,
    coalesce(pts_us > lag(pts_us) OVER (PARTITION BY media_id ORDER BY pts_us), true) AS monotonic FROM (SELECT DISTINCT media_id, start_us AS pts_us FROM sig)""")
def frame_lut(kb: KB) -> DataFrame:
    w = Window.partitionBy("media_id").orderBy("pts_us")
    pts = kb.signals.select("media_id", F.col("start_us").alias("pts_us")).distinct()
    return pts.select("media_id", (F.row_number().over(w) - 1).cast("long").alias("frame_idx"), "pts_us", F.coalesce(F.col("pts_us") > F.lag("pts_us").over(w), F.lit(True)).alias("monotonic"))


@query("""SELECT conv_id, turn, octet_length(encode(text)) AS bytes, CAST(4 + 16 * count(*) OVER (PARTITION BY conv_id) +
    coalesce(sum(octet_length(encode(text))) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS at_byte FROM conversations""")
def offset_table(kb: KB) -> DataFrame:
    """Where each entry of a packed file begins: after a head of 4 + 16 n bytes and the entries before."""
    c = kb.table("conversations").select("conv_id", "turn", F.octet_length("text").cast("long").alias("bytes"))
    c = intervals.running_sum(c, ["conv_id"], "turn", "bytes", "_to").join(c.groupBy("conv_id").agg(F.count("*").alias("_n")), "conv_id")
    return c.select("conv_id", "turn", F.col("bytes").cast("int").alias("bytes"), (4 + 16 * F.col("_n") + F.col("_to") - F.col("bytes")).alias("at_byte"))


@query("SELECT media_id, utt_id AS id, min(start_us) AS start_us, max(end_us) AS end_us FROM words GROUP BY 1, 2 UNION ALL SELECT media_id, id, start_us, end_us FROM utts u WHERE NOT EXISTS (FROM words w WHERE w.media_id = u.media_id AND w.utt_id = u.id)")
def snap_turns(kb: KB) -> DataFrame:
    bounds = kb.words.groupBy("media_id", F.col("utt_id").alias("id")).agg(F.min("start_us").alias("_s"), F.max("end_us").alias("_e"))
    return kb.utterances.join(bounds, ["media_id", "id"], "left").select("media_id", "id", F.coalesce("_s", "start_us").alias("start_us"), F.coalesce("_e", "end_us").alias("end_us"))


@query("SELECT media_id, src, min(t_us) AS first_us, max(t_us) AS last_us, count(*) AS n FROM appears GROUP BY 1, 2")
def appearances(kb: KB) -> DataFrame:
    return kb.appearances.groupBy("media_id", "src").agg(F.min("t_us").alias("first_us"), F.max("t_us").alias("last_us"), F.count("*").alias("n"))


@query("""WITH t AS (SELECT media_id, location, CAST(sum(end_us - start_us) AS BIGINT) AS total, min(start_us) AS first FROM scenes GROUP BY 1, 2),
    m AS (SELECT media_id, arg_max(location, total::HUGEINT * 10000000000 - first) AS main FROM t GROUP BY 1)
    SELECT s.media_id, s.id, s.start_us, s.end_us, s.location, 0.8::DOUBLE AS score FROM scenes s JOIN m ON s.media_id = m.media_id WHERE s.location <> m.main""")
def offtopic(kb: KB) -> DataFrame:
    s = kb.scenes
    totals = s.groupBy("media_id", "location").agg(F.sum(F.col("end_us") - F.col("start_us")).alias("total"), F.min("start_us").alias("first"))
    main = totals.groupBy("media_id").agg(F.max_by("location", F.struct("total", -F.col("first"))).alias("main"))
    return s.join(main, "media_id").filter("location <> main").select("media_id", "id", "start_us", "end_us", "location", F.lit(0.8).alias("score"))


@query("SELECT media_id, arg_max(speaker, d * 1000 + (CASE speaker WHEN 'user' THEN 0 WHEN 'system' THEN 1 ELSE 2 END)) AS owner, CAST(max(d) AS BIGINT) AS spoken_us FROM (SELECT media_id, speaker, CAST(sum(end_us - start_us) AS BIGINT) AS d FROM utts GROUP BY 1, 2) GROUP BY 1")
def owner(kb: KB) -> DataFrame:
    """The speaker with the most time; ties go to the first by name."""
    spoken = kb.utterances.groupBy("media_id", "speaker").agg(F.sum(F.col("end_us") - F.col("start_us")).alias("d"))
    rank = F.when(F.col("speaker") == "user", 0).when(F.col("speaker") == "system", 1).otherwise(2)
    return spoken.groupBy("media_id").agg(F.max_by("speaker", F.struct("d", rank)).alias("owner"), F.max("d").alias("spoken_us"))


@query("SELECT media_id, src, scene_id, n = 1 AS needs_verification FROM (SELECT DISTINCT media_id, src, scene_id, count(*) OVER (PARTITION BY media_id, src) AS n FROM appears)")
def needs_verification(kb: KB) -> DataFrame:
    """People seen once only."""
    a = kb.appearances
    n = a.groupBy("media_id", "src").agg(F.count("*").alias("n"))
    return a.select("media_id", "src", "scene_id").distinct().join(n, ["media_id", "src"]).select("media_id", "src", "scene_id", (F.col("n") == 1).alias("needs_verification"))


@query("SELECT media_id, count(DISTINCT scene_id) AS tracks, count(DISTINCT src) AS persons, count(*) / greatest(1, count(DISTINCT src)) <= 5 AS passed FROM appears GROUP BY 1")
def face_fragmentation(kb: KB) -> DataFrame:
    a = kb.appearances.groupBy("media_id")
    persons = F.countDistinct("src")
    return a.agg(F.countDistinct("scene_id").alias("tracks"), persons.alias("persons"), (F.count("*") / F.greatest(F.lit(1), persons) <= 5).alias("passed"))


@query("""WITH g AS (
    SELECT 1 AS gate, 'asr' AS name, count(*) FILTER (quality = 1) * 10 >= count(*) * 7 AS passed, count(*) AS n FROM labels
    UNION ALL SELECT 2, 'vad', count(*) FILTER (value > 95) * 10 <= count(*), count(*) FROM events
    UNION ALL SELECT 3, 'faces', count(*) <= 5 * greatest(1, count(DISTINCT src)), count(*) FROM appears
    UNION ALL SELECT 4, 'captions', bool_and(location IS NOT NULL AND emotion IS NOT NULL), count(*) FROM scenes
    UNION ALL SELECT 5, 'words', count(*) FILTER (length(word) > 24) * 100 <= 15 * count(*), count(*) FROM words)
    SELECT gate, name, passed, n, CAST(sum(passed::INT) OVER () AS BIGINT) AS total_passed FROM g""")
def quality_gates(kb: KB) -> DataFrame:
    """Five gates, one conditional aggregate each."""
    hits = lambda c: F.count(F.when(c, 1))
    n = F.count("*")
    gate = lambda df, i, name, passed: df.agg(F.lit(i).alias("gate"), F.lit(name).alias("name"), passed.alias("passed"), n.alias("n"))
    rows = gate(kb.table("labels"), 1, "asr", hits(F.col("quality") == 1) * 10 >= n * 7)
    rows = rows.unionByName(gate(kb.table("events"), 2, "vad", hits(F.col("value") > 95) * 10 <= n))
    rows = rows.unionByName(gate(kb.appearances, 3, "faces", n <= 5 * F.greatest(F.lit(1), F.countDistinct("src"))))
    rows = rows.unionByName(gate(kb.scenes, 4, "captions", F.bool_and(F.col("location").isNotNull() & F.col("emotion").isNotNull())))
    rows = rows.unionByName(gate(kb.words, 5, "words", hits(F.length("word") > 24) * 100 <= n * 15))
    return rows.withColumn("total_passed", F.sum(F.col("passed").cast("long")).over(Window.partitionBy()))


@query("""SELECT media_id, CAST(sum(end_us - start_us) AS BIGINT) AS latency_us, CAST(sum(end_us - start_us) AS BIGINT) <= 2600000000 * 105 // 600 AS in_time,
    floor(2600000000.0::DOUBLE / sum(end_us - start_us) * 1e6 + 0.5) / 1e6 AS real_time_factor, CAST(sum(end_us - start_us) // 10 AS BIGINT) AS cost_1e9 FROM sig GROUP BY 1""")
def slo_dashboard(kb: KB) -> DataFrame:
    """Stage time against 105 s per 600 s of media, and its price of 0.0001 a second."""
    took = F.sum(F.col("end_us") - F.col("start_us"))
    s = kb.signals.groupBy("media_id").agg(took.alias("latency_us"))
    return s.select("media_id", "latency_us", (F.col("latency_us") <= kbs.DURATION * 105 // 600).alias("in_time"), r6(F.lit(float(kbs.DURATION)) / F.col("latency_us")).alias("real_time_factor"), F.expr("latency_us div 10").alias("cost_1e9"))


@query("""WITH d AS (SELECT label, i, avg(e) AS m FROM (SELECT label, unnest(embedding)::DOUBLE AS e, unnest(range(64)) AS i FROM embeddings) GROUP BY 1, 2),
    n AS (SELECT label, sqrt(sum(m * m)) AS norm FROM d GROUP BY 1)
    SELECT label, CAST(i AS INTEGER) AS dim, floor(m / norm * 1e5 + 0.5) / 1e5 AS value FROM d JOIN n USING (label)""")
def centroid(kb: KB) -> DataFrame:
    c = vectors.centroids(kb.vectors, ["label"], "embedding")
    return c.select("label", F.posexplode("centroid").alias("dim", "value")).withColumn("value", F.floor(F.col("value") * 1e5 + 0.5) / 1e5)


@query("""SELECT (SELECT count(*) FROM scenes) AS scenes, (SELECT count(*) FROM utts) AS utterances, (SELECT count(DISTINCT src) FROM appears) AS entities,
    (SELECT list_aggregate(list_sort(list(DISTINCT location)), 'string_agg', ',') FROM scenes) AS locations, (SELECT list_aggregate(list_sort(list(DISTINCT emotion)), 'string_agg', ',') FROM scenes) AS emotions""")
def kb_summary(kb: KB) -> DataFrame:
    several = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    scenes = kb.scenes.agg(F.count("*").alias("scenes"), several("location").alias("locations"), several("emotion").alias("emotions"))
    return scenes.crossJoin(kb.utterances.agg(F.count("*").alias("utterances"))).crossJoin(kb.appearances.agg(F.countDistinct("src").alias("entities")))


@query("SELECT event_type || ':' || CAST(floor(value / 10) AS BIGINT) AS preference, user_id, count(*) AS n FROM events GROUP BY 1, 2 HAVING count(*) >= 3")
def preference_counts(kb: KB) -> DataFrame:
    """Values that a user chose three times or more."""
    pair = F.concat("event_type", F.lit(":"), F.floor(F.col("value") / 10).cast("string"))
    return kb.table("events").groupBy(pair.alias("preference"), "user_id").agg(F.count("*").alias("n")).filter("n >= 3")


@query("SELECT media_id, max(len) AS longest_us, arg_max(start_us, len::HUGEINT * 10000000000 - start_us) AS start_us FROM (SELECT media_id, start_us, end_us - start_us AS len FROM silences WHERE end_us - start_us > 500000) GROUP BY 1")
def longest_silence(kb: KB) -> DataFrame:
    """Room tone: the longest silence over half a second, the first of equal ones."""
    s = kb.silences.withColumn("len", F.col("end_us") - F.col("start_us")).filter("len > 500000")
    return s.groupBy("media_id").agg(F.max("len").alias("longest_us"), F.max_by("start_us", F.struct("len", -F.col("start_us"))).alias("start_us"))


@query("SELECT media_id, CAST(round((max(end_us) // 1000000) / 100) AS BIGINT) AS readiness, max(end_us) >= 2000000000 AS ready FROM sig GROUP BY 1")
def readiness_gate(kb: KB) -> DataFrame:
    s = kb.signals.groupBy("media_id").agg(F.max("end_us").alias("m"))
    return s.select("media_id", F.round(F.expr("m div 1000000") / 100).cast("long").alias("readiness"), (F.col("m") >= 2_000_000_000).alias("ready"))


@query("SELECT media_id, id, CASE WHEN is_broll THEN 'b-roll' ELSE location END AS location, CASE WHEN is_broll AND id % 2 = 0 THEN 'calm' ELSE emotion END AS emotion, start_us FROM scenes")
def partial_update(kb: KB) -> DataFrame:
    """New values replace old ones, nulls don't."""
    new = kb.scenes.filter("is_broll").select("media_id", "id", F.lit("b-roll").alias("location"), F.when(F.col("id") % 2 == 0, "calm").alias("emotion"))
    return kbs.update(kb.scenes.select("media_id", "id", "location", "emotion", "start_us"), new, ["media_id", "id"])


@query("SELECT a.media_id, a.src, a.scene_id, a.t_us FROM appears a WHERE a.src NOT LIKE 'person:1%' AND NOT EXISTS (SELECT 1 FROM scenes s WHERE s.is_broll AND s.media_id = a.media_id AND s.id = a.scene_id)")
def deletes(kb: KB) -> DataFrame:
    """Relations without those of deleted scenes and of persons by a pattern."""
    gone = kb.scenes.filter("is_broll").select("media_id", F.col("id").alias("scene_id"))
    return kbs.delete(kb.appearances, gone, ["media_id", "scene_id"], {"src": "person:1%"}).select("media_id", "src", "scene_id", "t_us")


@query("SELECT vec_id, label FROM embeddings WHERE len(embedding) = 64")
def delete_by_dim(kb: KB) -> DataFrame:
    return kbs.delete(kb.vectors, dim=("embedding", 64)).select("vec_id", "label")


@query("SELECT s.media_id, s.id AS scene_id FROM scenes s WHERE NOT EXISTS (SELECT 1 FROM appears a WHERE a.media_id = s.media_id AND a.scene_id = s.id AND a.source = 'faces')")
def unmatched_scenes(kb: KB) -> DataFrame:
    """Scenes that no face was matched to: the difference of two sets of ids."""
    seen = kb.appearances.filter("source = 'faces'").select("media_id", "scene_id").distinct()
    return kb.scenes.select("media_id", F.col("id").alias("scene_id")).join(seen, ["media_id", "scene_id"], "left_anti")


@query("""SELECT media_id, chunk, id, row_number() OVER (PARTITION BY media_id ORDER BY chunk, start_us, id) - 1 AS new_id FROM (
    SELECT media_id, id, start_us, unnest([greatest(0, start_us // 180000000 - 1), start_us // 180000000]) AS chunk, (start_us + end_us) // 2 AS mid FROM (SELECT DISTINCT media_id, id, start_us, end_us FROM audio)) WHERE mid >= chunk * 180000000 AND mid < (chunk + 1) * 180000000 AND (chunk > 0 OR start_us < 180000000) GROUP BY media_id, chunk, id, start_us""")
def chunk_ownership(kb: KB) -> DataFrame:
    """Segments that overlapping chunks both heard belong to the one that has their middle; ids are given anew."""
    at = F.expr("start_us div 180000000")
    heard = kb.audio_events.select("media_id", "id", "start_us", F.expr("(start_us + end_us) div 2").alias("mid"), F.explode(F.array_distinct(F.array(F.greatest(F.lit(0), at - 1), at))).alias("chunk"))
    own = heard.filter("mid >= chunk * 180000000 and mid < (chunk + 1) * 180000000")
    order = Window.partitionBy("media_id").orderBy("chunk", "start_us", "id")
    return own.select("media_id", "chunk", "id", (F.row_number().over(order) - 1).alias("new_id"))


@query("""WITH b AS (SELECT media_id, scene_id, arg_max(CASE WHEN confidence > 0.9 THEN 'climax' ELSE 'setup' END, t_us * 1000000 + CAST(substring(src, 8) AS BIGINT)) AS role FROM appears WHERE source = 'graph' GROUP BY 1, 2)
    SELECT s.media_id, s.id, coalesce(b.role, s.story_role) AS role FROM scenes s LEFT JOIN b ON b.media_id = s.media_id AND b.scene_id = s.id""")
def role_precedence(kb: KB) -> DataFrame:
    """A scene's role: that of its last story beat (here: relations from the graph), else its own."""
    beat = kb.appearances.filter("source = 'graph'").withColumn("beat", F.when(F.col("confidence") > 0.9, "climax").otherwise("setup"))
    last = beat.groupBy("media_id", F.col("scene_id").alias("id")).agg(F.max_by("beat", F.struct("t_us", F.expr("cast(substring(src, 8) as bigint)"))).alias("beat"))
    return kb.scenes.join(last, ["media_id", "id"], "left").select("media_id", "id", F.coalesce("beat", "story_role").alias("role"))
