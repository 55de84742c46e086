"""Retrieval for a table of requests, in one plan.

A request is a query over one media item: (query_id, media_id, query), with ``retry`` and an anchor where there are any. The
registry of channels says of each which queries call it, as a column expression, and how it finds segments for the requests that
do, as joins with the media item's tables. So a thousand requests are planned like one, and each reads its own
item's rows only. The channels' segments are fused, judged, corroborated, merged and kept to the anchor's side by (query_id, media_id).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar, udfs
from ..operators import intervals as iv
from ..operators import search, vectors
from ..operators.sequences import tokens
from ..session import cut, folder
from . import retrieve

R = ["query_id", "media_id"]
#: A request is looked up in parts: as it is and with synonyms (w...), and both sides of a "while" (a..., b...).
KEYS = [*R, "part"]
FOUND = [*KEYS, "start_us", "end_us", "score", "source", "scene_id"]
K = 20
BAND = (0.35, 0.55)
# Words that call a channel.
PAUSE = ("silence", "silences", "pause", "pauses", "dead time", "dead air", "gap", "gaps")
FILLER = ("filler", "fillers", "um", "ums", "uh", "uhs", "hmm")
RETAKE = ("retake", "retakes", "mistake", "mistakes", "final take", "repeated")
PLACE = ("scene", "scenes", "shot", "shots", "topic", "topics", "part", "parts")
SPOKEN = (*FILLER, "silence", "silences", "speech", "voice", "word", "words", "sound", "sounds", "talk", "speak")
OWN = ("me", "i'm", "my", "i")
MOMENTS = (("awkward", "awkward"), ("cringe", "awkward"), ("uncomfortable", "awkward"), ("funniest", "funny"), ("funny", "funny"), ("hilarious", "funny"), ("applause", "applause"))
OFF_TOPIC = ("off-topic", "offtopic", "off topic", "tangent", "tangents", "unrelated")
CLOCK = r"(?:([0-9]+):)?([0-9]+)\s*(?:s|sec|seconds?|m|min|minutes?)?\s*(?:to|-|and)\s*(?:([0-9]+):)?([0-9]+)"


def says(q: Column, words: tuple[str, ...] | list[str]) -> Column:
    """Whether a query in lower case has any of the words, as whole words."""
    return F.regexp_like(q, F.lit(rf"(?<![a-z0-9])(?:{'|'.join(rf'\Q{w}\E' for w in words)})(?![a-z0-9])"))


def spaced(text: Column) -> Column:
    """A text in lower case between spaces, its words apart by spaces: one holds another's words if it contains it."""
    return F.concat(F.lit(" "), F.regexp_replace(text, "[^a-z0-9:_-]+", " "), F.lit(" "))


def holds(q: Column, word: Column) -> Column:
    """Whether a query has what a column says, not within a longer word or number; where many meet, both are made ``spaced`` before."""
    return F.contains(spaced(q), spaced(F.lower(word)))


def first_of(q: Column, cases: tuple[tuple[str, str], ...]) -> Column:
    """The value of the first word that a query has."""
    out = F.lit(None).cast("string")
    for word, value in reversed(cases):
        out = F.when(says(q, (word,)), value).otherwise(out)
    return out


def found(df: DataFrame, score: Column, source: Column | str, scene: str | None = None) -> DataFrame:
    return df.select(*KEYS, "start_us", "end_us", score.cast("double").alias("score"), (F.lit(source) if isinstance(source, str) else source).alias("source"), (F.lit(None) if scene is None else F.col(scene)).cast("long").alias("scene_id"))


def silences(kb, asked: DataFrame) -> DataFrame:
    """Pauses, those longer than the query's ``> N`` if it has one."""
    least = F.coalesce(F.regexp_extract("q", r">\s*([0-9]+(?:\.[0-9]+)?)", 1).try_cast("double") * 1e6, F.lit(-1.0))
    return found(asked.join(kb.silences.select("media_id", "start_us", "end_us"), "media_id").filter(F.col("end_us") - F.col("start_us") > least), F.lit(1.0), "vad")


def fillers(kb, asked: DataFrame) -> DataFrame:
    spoken = retrieve.filler_channel(kb, "").select("media_id", "start_us", "end_us", F.col("score").alias("s"), F.col("source").alias("by"))
    return found(asked.join(spoken, "media_id").withColumn("source", F.col("by")), F.col("s"), F.col("source"))


def retakes(kb, asked: DataFrame) -> DataFrame:
    """All but the last take of each cluster, or the last ones where the query asks for the final take."""
    last = F.max("take_index").over(Window.partitionBy("media_id", "cluster_id"))
    takes = retrieve.retake_takes(kb).withColumn("final", F.col("take_index") == last).join(kb.utterances.select("media_id", "id", "start_us", "end_us"), ["media_id", "id"])
    return found(asked.join(takes, "media_id").filter(F.col("final") == says(F.col("q"), ("final", "last"))), F.lit(0.9), "retake_detector")


def persons(kb, asked: DataFrame) -> DataFrame:
    """Scenes of the persons whose label or id the query has, and of the owner where it says "me"."""
    own = asked.select(*KEYS, spaced(F.col("q")).alias("qs"), says(F.col("q"), OWN).alias("me"))
    people = kb.people.select("media_id", "entity_id", "is_owner", spaced(F.lower("label")).alias("named"), spaced(F.lower("entity_id")).alias("coded"))
    called = own.join(people, "media_id").filter(F.contains("qs", F.col("named")) | F.contains("qs", F.col("coded")) | (F.col("is_owner") & F.col("me")))
    in_scenes = kb.appearances.select("media_id", F.col("src").alias("entity_id"), "scene_id").distinct()
    met = called.join(in_scenes, ["media_id", "entity_id"]).select(*KEYS, "scene_id").distinct()
    return found(met.join(_scenes(kb, "start_us", "end_us"), ["media_id", "scene_id"]), F.lit(1.0), "graph", "scene_id")


def _scenes(kb, *columns: str) -> DataFrame:
    return kb.scenes.select("media_id", F.col("id").alias("scene_id"), *columns)


def locations(kb, asked: DataFrame) -> DataFrame:
    places = _scenes(kb, "start_us", "end_us", "location").withColumn("location", spaced(F.lower("location")))
    return found(asked.select(*KEYS, spaced(F.col("q")).alias("qs")).join(places, "media_id").filter(F.contains("qs", F.col("location"))), F.lit(1.0), "location", "scene_id")


def sounds(kb, asked: DataFrame) -> DataFrame:
    """Sound events of the first kind that the query names."""
    events = kb.audio_events.select("media_id", "type", "start_us", "end_us", F.when(F.coalesce("confidence", F.lit(0.0)) == 0, 0.8).otherwise(F.col("confidence")).alias("s"))
    return found(asked.withColumn("type", first_of(F.col("q"), retrieve.SOUND_WORDS)).join(events, ["media_id", "type"]), F.col("s"), "audio_events")


def objects(kb, asked: DataFrame, cutoff: float = 0.6) -> DataFrame:
    """Scenes with an object whose label is in a word of the query of three letters or more, or has it; else of nearly such a label (difflib)."""
    words = asked.select(*KEYS, F.explode(F.array_distinct(F.filter(tokens(F.col("q")), lambda w: F.length(w) >= 3))).alias("word"))
    sure = words.join(kb.objects.select("media_id", F.lower("label").alias("label")).distinct(), "media_id").filter(F.contains("label", F.col("word")) | F.contains("word", F.col("label"))).select(*KEYS, "label").distinct()
    vocabulary = kb.objects.select(F.lower("label").alias("label")).distinct()
    left = words.join(sure.select(*KEYS).distinct(), KEYS, "left_anti")
    # each different word meets each different label once, by the pair
    pairs = left.select("word").distinct().join(vocabulary).filter(F.abs(F.length("word") - F.length("label")) * (2 + cutoff) <= 4 * F.greatest(F.length("word"), F.length("label")))
    alike = pairs.withColumn("ratio", udfs.ratio(F.col("word"), F.col("label"))).filter(F.col("ratio") >= cutoff)
    nearly = left.join(alike, "word").join(kb.objects.select("media_id", F.lower("label").alias("label")).distinct(), ["media_id", "label"])
    best = F.row_number().over(Window.partitionBy(*KEYS, "word").orderBy(F.desc("ratio"), F.desc("label")))
    nearly = nearly.withColumn("r", best).filter("r <= 2").select(*KEYS, "label").distinct()
    seen = kb.objects.select("media_id", F.lower("label").alias("label"), "scene_id", F.when(F.coalesce("confidence", F.lit(0.0)) == 0, 0.7).otherwise(F.col("confidence")).alias("s"))
    return found(sure.unionByName(nearly).join(seen, ["media_id", "label"]).join(_scenes(kb, "start_us", "end_us"), ["media_id", "scene_id"]), F.col("s"), "graph_object", "scene_id")


def emotions(kb, asked: DataFrame) -> DataFrame:
    """Scenes of the first emotion that the query names; "funny" and "emotional" are judged by intensity."""
    kind = F.lit(None).cast("string")
    match = F.lit(False)
    for name, words in reversed(retrieve.EMOTION_WORDS):
        kind = F.when(says(F.col("q"), words), name).otherwise(kind)
        like = F.lit(False)
        for w in words:
            like |= F.contains(F.lower("emotion"), F.lit(w))
        more = {"funny": F.lower("emotion").isin("happy", "joy", "amused", "excited") & (F.col("intensity") > 0.5), "emotional": F.col("intensity") > 0.6}.get(name, F.lit(False))
        match |= (F.col("kind") == name) & (like | more)
    scenes = _scenes(kb, "start_us", "end_us", "emotion", "intensity").filter("emotion is not null and intensity <> 0")
    return found(asked.withColumn("kind", kind).join(scenes, "media_id").filter(match), F.col("intensity"), "emotion", "scene_id")


def moments(kb, asked: DataFrame) -> DataFrame:
    return found(asked.withColumn("kind", first_of(F.col("q"), MOMENTS)).join(retrieve.derived_moments(kb), ["media_id", "kind"]), F.lit(0.7), "derived_moment")


def dialogue(kb, asked: DataFrame) -> DataFrame:
    """Questions, or else answers."""
    act = F.when(says(F.col("q"), ("question", "questions")), "question").when(says(F.col("q"), ("answer", "answers")), "answer")
    return found(asked.withColumn("dialogue_act", act).join(kb.utterances.select("media_id", "dialogue_act", "start_us", "end_us"), ["media_id", "dialogue_act"]), F.lit(0.9), "dialogue_act")


def off_topic(kb, asked: DataFrame) -> DataFrame:
    """Topics other than the one with the most time in its media item."""
    spent = kb.topics.groupBy("media_id", "label").agg(F.sum(F.col("end_us") - F.col("start_us")).alias("us"))
    main = spent.groupBy("media_id").agg(F.max_by("label", F.struct("us", "label")).alias("main"))
    return found(asked.join(kb.topics.join(main, "media_id").filter("label <> main"), "media_id"), F.lit(0.8), "off_topic")


def topics(kb, asked: DataFrame) -> DataFrame:
    """Topics whose label is in the query or has it, or whose class, other than "other", the query names."""
    label, kind = F.lower("label"), F.lower("class")
    told = kb.topics.select("media_id", "start_us", "end_us", F.when(F.length("label") >= 3, label).alias("label"), F.when(F.length("label") >= 3, spaced(label)).alias("labels"), F.when((kind != "other") & (F.length("class") >= 3), spaced(kind)).alias("kinds"))
    match = F.contains("qs", F.col("labels")) | F.contains("label", F.col("q")) | F.contains("qs", F.col("kinds"))
    return found(asked.select(*KEYS, "q", spaced(F.col("q")).alias("qs")).join(told, "media_id").filter(match), F.lit(0.95), "topic_model")


def _clock() -> tuple[Column, Column]:
    number = lambda g: F.coalesce(F.regexp_extract("q", CLOCK, g).try_cast("long"), F.lit(0))
    return (60 * number(1) + number(2)) * 1_000_000, (60 * number(3) + number(4)) * 1_000_000


def times(kb, asked: DataFrame) -> DataFrame:
    start, end = _clock()
    return found(asked.withColumn("start_us", start).withColumn("end_us", end).filter("end_us > start_us"), F.lit(1.0), "explicit_timestamp")


def keyword_documents(kb) -> DataFrame:
    """(media_id, key, text, start_us, end_us, scene_id) of what is searched by words: utterances, and scenes by what is known of them."""
    said = kb.utterances.select("media_id", F.concat(F.lit("u"), F.col("id").cast("string")).alias("key"), "text", "start_us", "end_us", F.lit(None).cast("long").alias("scene_id"))
    of = [c for c in ("caption", "location", "emotion", "shot_type") if c in kb.scenes.columns]
    shown = kb.scenes.select("media_id", F.concat(F.lit("s"), F.col("id").cast("string")).alias("key"), F.concat_ws(" ", *of).alias("text"), "start_us", "end_us", F.col("id").alias("scene_id"))
    return said.unionByName(shown.filter("trim(text) <> ''"))


def keywords(kb, asked: DataFrame, k: int = K, fuzzy: float = 0.7) -> DataFrame:
    """The ``k`` documents of the media item that BM25 ranks best for each query.

    Where none has a word of it and the query has a capitalised word, utterances with a word nearly like one of its words. Each media item is a
    corpus by itself, so what others say changes nothing. ``kb.keyword_index`` is the written index, if there is one.
    """
    docs = keyword_documents(kb)
    index = getattr(kb, "keyword_index", None)
    if index is None:
        index = search.write_index(docs, folder(kb.spark, "keywords"), "key", "text", "media_id")
        kb.keyword_index = index
    one = asked.withColumn("ask", F.concat_ws("|", "query_id", "part"))
    hits = search.bm25_search(index, one.select(F.col("ask").alias("query_id"), F.col("media_id").alias("item"), F.col("q").alias("query")), k)
    hits = hits.select(F.col("query_id").alias("ask"), F.col("item").alias("media_id"), F.col("id").alias("key"), "score")
    hits = cut(one.join(hits, ["ask", "media_id"]).select(*KEYS, "key", "score"))
    sure = found(hits.join(docs, ["media_id", "key"]), F.col("score"), "keyword", "scene_id")
    # a capital within the query; at its beginning it says nothing
    named = asked.filter(F.regexp_like("said", F.lit(r"\s\p{Lu}"))).join(hits.select(*KEYS).distinct(), KEYS, "left_anti")
    wanted = named.select(*KEYS, F.explode(tokens(F.col("q"))).alias("word")).distinct()
    spoken = kb.utterances.select("media_id", "start_us", "end_us", F.explode(F.array_distinct(tokens(F.col("text")))).alias("heard"))
    pairs = wanted.join(spoken.select("media_id", "heard").distinct(), "media_id").filter(F.abs(F.length("word") - F.length("heard")) * (2 + fuzzy) <= 4 * F.greatest(F.length("word"), F.length("heard")))
    alike = pairs.select("word", "heard").distinct().withColumn("ratio", udfs.ratio(F.col("word"), F.col("heard"))).filter(F.col("ratio") >= fuzzy)
    nearest = F.row_number().over(Window.partitionBy(*KEYS, "word").orderBy(F.desc("ratio"), F.desc("heard")))
    close = pairs.join(alike, ["word", "heard"]).withColumn("r", nearest).filter("r <= 3").select(*KEYS, "heard").distinct()
    return sure.unionByName(found(close.join(spoken, ["media_id", "heard"]).select(*KEYS, "start_us", "end_us").distinct(), F.lit(0.6), "keyword_fuzzy"))


def by_vector(kb, asked: DataFrame, k: int = K) -> DataFrame:
    """The ``k`` scenes of the media item nearest to the query's vector, where it has one, of which those near the best count.

    The parts of a request have one vector, so scenes are scored once a request.
    """
    given = getattr(kb, "query_vectors", None)
    if given is None:
        return found(asked.filter("false").withColumn("start_us", F.lit(0)).withColumn("end_us", F.lit(0)), F.lit(0.0), "vector")
    each = asked.select(*R).distinct().join(given.select("query_id", F.col("embedding").alias("wanted")), "query_id")
    met = each.join(kb.scene_vectors, "media_id").select(*R, "scene_id", (F.floor(vectors.inner("wanted", "embedding") * 1e6 + 0.5) / 1e6).alias("s"))
    w = Window.partitionBy(*R)
    top = met.withColumn("r", F.row_number().over(w.orderBy(F.desc("s"), "scene_id"))).filter(F.col("r") <= k)
    near = top.withColumn("best", F.max("s").over(w)).filter(F.col("s") >= F.greatest(F.lit(0.15), F.col("best") - 0.15))
    timed = near.join(_scenes(kb, "start_us", "end_us"), ["media_id", "scene_id"])
    return found(asked.select(*KEYS).join(timed, R), F.col("s"), "vector", "scene_id")


def metadata(kb, asked: DataFrame) -> DataFrame:
    q = F.col("q")
    own = asked.select(*KEYS, "q", says(q, retrieve.BROLL_WORDS).alias("cut_in"), says(q, retrieve.OUTDOOR_WORDS).alias("outside"), says(q, retrieve.INDOOR_WORDS).alias("inside"))
    met = own.join(_scenes(kb, "start_us", "end_us", "is_broll", "indoor", "story_role"), "media_id")
    role = F.contains(q, F.col("story_role")) | ((F.col("story_role") == "intro") & F.contains(q, F.lit("hook")))
    matches = F.array(
        F.when(F.col("cut_in") & F.col("is_broll"), F.lit(0.9)),
        F.when(F.col("outside") & ~F.col("indoor"), F.lit(0.95)),
        F.when(F.col("inside") & F.col("indoor"), F.lit(0.95)),
        F.when(role, F.lit(0.85)),
    )
    each = met.withColumn("m", F.explode(F.filter(matches, lambda m: m.isNotNull())))
    return found(each, F.col("m"), "metadata", "scene_id")


@dataclass(frozen=True)
class Channel:
    """``calls`` tells by the query in lower case whether it asks the channel, ``find`` what it finds."""

    name: str
    kind: str
    calls: Callable[[Column], Column]
    find: Callable[[object, DataFrame], DataFrame]


def _on(words) -> Callable[[Column], Column]:
    return lambda q: says(q, words)


def _always(q: Column) -> Column:
    return F.lit(True)


CHANNELS = (
    Channel("silence", "structured", _on(PAUSE), silences),
    Channel("filler", "structured", _on(FILLER), fillers),
    Channel("retake", "structured", _on(RETAKE), retakes),
    Channel("person", "structured", _always, persons),
    Channel("location", "structured", _always, locations),
    Channel("sound", "structured", _on([w for w, _ in retrieve.SOUND_WORDS]), sounds),
    Channel("object", "structured", _on(("object", "objects", "product", "phone", "laptop", "whiteboard", "cup", "book", "camera", "screen", "mic", "microphone")), objects),
    Channel("emotion", "structured", _on([w for _, ws in retrieve.EMOTION_WORDS for w in ws]), emotions),
    Channel("moment", "structured", _on([w for w, _ in MOMENTS]), moments),
    Channel("dialogue", "structured", _on(("question", "questions", "answer", "answers", "q&a")), dialogue),
    Channel("off_topic", "structured", _on(OFF_TOPIC), off_topic),
    Channel("topic", "structured", _always, topics),
    Channel("time", "structured", lambda q: F.regexp_like(q, F.lit(CLOCK)), times),
    Channel("keyword", "keyword", _always, keywords),
    Channel("vector", "vector", _always, by_vector),
    Channel("metadata", "metadata", _always, metadata),
)


def channel(kb, name: str, requests: DataFrame) -> DataFrame:
    """What one channel finds for the requests that call it: (query_id, media_id, start_us, end_us, score, source, scene_id)."""
    c = next(c for c in CHANNELS if c.name == name)
    asked = requests.select(*R, F.lit("w0").alias("part"), F.col("query").alias("said"), F.lower("query").alias("q"))
    return c.find(kb, asked.filter(c.calls(F.col("q")))).drop("part")


def parts_of(requests: DataFrame) -> DataFrame:
    """(KEYS, said, q): each request with the variants of its query and of both sides of a "while"; short ways take the query alone."""
    q = F.lower("query")
    sides = F.when(F.contains(q, F.lit(" while ")), F.split(q, " while ")).when(F.contains(q, F.lit(" simultaneously ")), F.split(q, " simultaneously "))
    variants = lambda text, mark: F.transform(scalar.expanded(text), lambda x, i: F.struct(F.concat(F.lit(mark), i.cast("string")).alias("part"), x.alias("said")))
    both = F.when(F.size(sides) == 2, F.concat(variants(F.get(sides, F.lit(0)), "a"), variants(F.get(sides, F.lit(1)), "b"))).otherwise(F.filter(variants(F.lit(""), "a"), lambda x: F.lit(False)))
    every = requests.select(*R, "way", F.explode(F.when(F.col("way") == "all", F.concat(variants(F.col("query"), "w"), both)).otherwise(F.slice(variants(F.col("query"), "w"), 1, 1))).alias("v"))
    return every.select(*R, "way", "v.part", "v.said", F.lower("v.said").alias("q"))


def ways(kb, requests: DataFrame) -> DataFrame:
    """The requests with their ``way``: none (speech is asked of a silent item), absolute, time, pauses, or all channels."""
    q = F.lower("query")
    spoken = kb.words.select("media_id").distinct().withColumn("speech", F.lit(True))
    start, end = _clock()
    r = requests.join(spoken, "media_id", "left").withColumn("q", q)
    clock = F.regexp_like(q, F.lit(CLOCK)) & (end > start)
    way = F.when(F.col("speech").isNull() & says(q, SPOKEN), "none").when(F.col("anchor_type") == "absolute", "absolute").when(clock, "time").when(says(q, (*PAUSE, *FILLER)) & ~says(q, PLACE), "pauses")
    return r.withColumn("way", way.otherwise("all")).drop("speech", "q")


def anchors(kb, requests: DataFrame) -> DataFrame:
    """(query_id, media_id, from_us, to_us): what a request's anchor leaves of the item: before a subject's first, or after its last appearance.

    A subject is a person by label or id; else what the structured channels other than pauses find for it. Unknown subjects set no bound.
    """
    bound = requests.filter("anchor_type in ('before', 'after') and coalesce(anchor_subject, '') <> ''")
    asked = bound.select(*R, F.lit("w0").alias("part"), F.col("anchor_subject").alias("said"), F.lower("anchor_subject").alias("q"))
    seen = kb.appearances.select("media_id", F.col("src").alias("entity_id"), "t_us")
    person = asked.join(kb.people, "media_id").filter(holds(F.col("q"), F.col("label")) | holds(F.col("q"), F.col("entity_id"))).join(seen, ["media_id", "entity_id"])
    spans = person.groupBy(*R).agg(F.min("t_us").alias("a"), F.max("t_us").alias("b"), F.lit(0).alias("o"))
    for c in (c for c in CHANNELS if c.name in ("location", "sound", "object", "emotion", "topic")):
        spans = spans.unionByName(c.find(kb, asked.filter(c.calls(F.col("q")))).groupBy(*R).agg(F.min("start_us").alias("a"), F.max("end_us").alias("b"), F.lit(1).alias("o")))
    first = F.min("o").over(Window.partitionBy(*R))
    spans = spans.withColumn("first", first).filter("o = first").groupBy(*R).agg(F.min("a").alias("a"), F.max("b").alias("b"))
    return bound.join(spans, R).select(*R, F.when(F.col("anchor_type") == "after", F.col("b")).alias("from_us"), F.when(F.col("anchor_type") == "before", F.col("a")).alias("to_us"))


def complete(requests: DataFrame) -> DataFrame:
    """The requests with all columns: no retry and no anchor where these aren't given."""
    for c, t in (("retry", "int"), ("anchor_type", "string"), ("anchor_subject", "string"), ("anchor_start_us", "long"), ("anchor_end_us", "long")):
        if c not in requests.columns:
            requests = requests.withColumn(c, F.lit(None).cast(t))
    return requests.select(*R, "query", F.coalesce("retry", F.lit(0)).alias("retry"), "anchor_type", "anchor_subject", "anchor_start_us", "anchor_end_us")


def dealt(asked: DataFrame) -> DataFrame:
    """The parts of requests in as many tasks as a shuffle has: their few bytes meet many rows, and sizes alone would put them into one."""
    return asked.repartition(int(asked.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.xxhash64("media_id"))


def hits_of(kb, known: DataFrame) -> DataFrame:
    """(query_id, media_id, part, start_us, end_us, score, source, scene_id, channel): what every channel finds for the requests with their ways."""
    asked = cut(dealt(parts_of(known.filter("way in ('all', 'time', 'pauses')"))))
    hits = None
    for c in CHANNELS:
        short = {"time": "time", "silence": "pauses", "filler": "pauses"}.get(c.name, "all")
        each = c.find(kb, asked.filter(c.calls(F.col("q")) & F.col("way").isin("all", short))).select(*FOUND, F.lit(c.kind).alias("channel"))
        hits = each if hits is None else hits.unionByName(each)
    return hits


def retrieve_segments(kb, requests: DataFrame, rerank: DataFrame | None = None) -> DataFrame:
    """(query_id, media_id, start_us, end_us, score, n, scene_ids, sources, needs_confirmation) of all requests.

    ``requests`` are distinct (query_id, media_id, query), with retry (each lowers the threshold of .35 by .05, to .15 at least), and anchor_type
    (absolute with anchor_start_us and anchor_end_us, before or after with anchor_subject) if there are any. Null queries find
    nothing. Speech that is asked of an item without words, times and pauses take short ways. Of "A while B", what both sides' segments have in common for
    more than 0.2 s, if any, is the answer. Else the channels' segments are fused for each variant. ``rerank`` (query_id, media_id, start_us, end_us, p) gives the
    probabilities of a reranker: they replace the score of keyword and vector evidence alone, and can only raise others. What falls short of the
    threshold goes; scenes that need verification and that fewer than two kinds of channels touch need confirmation; neighbours within a
    second merge; and the anchor's side is kept.
    """
    known = cut(ways(kb, complete(requests.filter("query is not null and media_id is not null"))))
    way = known.select(*R, "way", "retry", F.greatest(F.lit(0.15), F.round(0.35 - 0.05 * F.col("retry"), 6)).alias("least"))
    hits = cut(hits_of(kb, known).join(way, R))

    short = hits.filter("way <> 'all'").select(*R, "start_us", "end_us", "score", F.array("source").alias("sources"), F.array_compact(F.array("scene_id")).alias("scene_ids"), F.lit(False).alias("needs_confirmation"))
    absolute = known.filter("way = 'absolute' and anchor_end_us > coalesce(anchor_start_us, 0)").select(*R, F.coalesce("anchor_start_us", F.lit(0)).alias("start_us"), F.col("anchor_end_us").alias("end_us"), F.lit(1.0).alias("score"), F.array(F.lit("absolute_anchor")).alias("sources"), F.expr("cast(array() as array<bigint>)").alias("scene_ids"), F.lit(False).alias("needs_confirmation"))

    side = F.substring("part", 1, 1)
    of_all = hits.filter("way = 'all'").withColumn("evidence", F.col("source")).withColumn("id", F.coalesce("scene_id", F.lit(-1)))
    # a side of a "while" is judged by the plain threshold
    limit = F.when(side == "w", F.col("least")).otherwise(0.35)
    # of one request's part all rows meet in one task, to be ranked and to be fused
    fused = search.fuse(of_all.withColumn("limit", limit).repartition(*KEYS), keys=(*KEYS, "least", "limit"), limit=F.col("limit"), band=BAND)
    fused = cut(fused.withColumn("sources", F.array_distinct("evidence")).drop("evidence", "limit"))

    a, b = (fused.filter(side == x) for x in "ab")
    b = b.select(*R, F.col("start_us").alias("b_start_us"), F.col("end_us").alias("b_end_us"), F.col("score").alias("b_score"), F.col("sources").alias("b_sources"), F.col("scene_ids").alias("b_scene_ids"))
    both = iv.overlap_join(a, b, R, 60_000_000).withColumn("s", F.greatest("start_us", "b_start_us")).withColumn("e", F.least("end_us", "b_end_us")).filter("e - s > 200000")
    both = both.select(*R, F.col("s").alias("start_us"), F.col("e").alias("end_us"), ((F.col("score") + F.col("b_score")) / 2).alias("score"), F.array_union("sources", "b_sources").alias("sources"), F.array_union("scene_ids", "b_scene_ids").alias("scene_ids"), F.lit(False).alias("needs_confirmation"))
    both = cut(both)

    whole = fused.filter(side == "w").join(both.select(*R).distinct(), R, "left_anti")
    if rerank is not None:
        weak = F.size(F.array_except("sources", F.array(F.lit("vector"), F.lit("keyword")))) == 0
        p = rerank.select(*R, "start_us", "end_us", "p")
        whole = whole.join(p, [*R, "start_us", "end_us"], "left").withColumn("score", F.when(F.col("p").isNull(), F.col("score")).when(weak, F.col("p")).otherwise(F.greatest("score", "p"))).drop("p")
    whole = whole.filter(F.col("score") >= F.col("least"))
    # scenes that need verification: how many kinds of channels touch the segment, ends included
    doubtful = whole.select(*KEYS, "start_us", "end_us", F.explode("scene_ids").alias("scene_id")).join(kb.unsure, ["media_id", "scene_id"], "left_semi").select(*KEYS, "start_us", "end_us").distinct()
    # the channels of the last variant are those that are asked
    last = of_all.filter(side == "w").withColumn("last", F.max("part").over(Window.partitionBy(*R))).filter("part = last")
    touching = last.select(*R, "channel", F.col("start_us").alias("b_start_us"), F.col("end_us").alias("b_end_us"))
    n = iv.overlap_join(doubtful, touching, R, 60_000_000, closed=True).groupBy(*KEYS, "start_us", "end_us").agg(F.countDistinct("channel").alias("touched"))
    alone = doubtful.join(n, [*KEYS, "start_us", "end_us"], "left").filter("coalesce(touched, 0) < 2").select(*KEYS, "start_us", "end_us", F.lit(True).alias("alone"))
    whole = whole.join(alone, [*KEYS, "start_us", "end_us"], "left").withColumn("needs_confirmation", F.col("needs_confirmation") | F.coalesce("alone", F.lit(False)))

    columns = [*R, "start_us", "end_us", "score", "sources", "scene_ids", "needs_confirmation"]
    # pauses, fillers and times are the answer as they are; the rest is merged
    merged = both.select(*columns).unionByName(whole.select(*columns)).withColumn("tie", F.monotonically_increasing_id())
    flat = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c)
    merged = iv.merge(merged, R, 1_000_000, [F.max("score").alias("score"), F.count("*").alias("n"), flat("scene_ids"), flat("sources"), F.bool_or("needs_confirmation").alias("needs_confirmation")], tie="tie")
    side_of = anchors(kb, known.filter("way = 'all'"))
    merged = merged.join(side_of, R, "left").filter("(from_us is null or start_us >= from_us) and (to_us is null or end_us <= to_us)").drop("from_us", "to_us")
    out = merged.unionByName(short.unionByName(absolute).withColumn("n", F.lit(1).cast("long")))
    return out.select(*R, "start_us", "end_us", (F.floor(F.col("score") * 1e6 + 0.5) / 1e6).alias("score"), "n", "scene_ids", "sources", "needs_confirmation")


def answers(kb, requests: DataFrame, topic: tuple[str, ...] = ("pricing", "price"), terms: tuple[str, ...] = ("price", "pricing")) -> DataFrame:
    """(query_id, media_id, kind, times_us, speakers, end_us): what the transcript says to each question (query_id, media_id, query).

    A question about the ``topic`` gets the times of the first three words that have one of the ``terms``; one that asks who speaks, the speakers by name; any other
    the end of the transcript. An item without words answers nothing: its kind is null.
    """
    q = F.lower("query")
    about, who = F.lit(False), says(q, ("who", "speaker", "speakers"))
    for t in topic:
        about |= F.contains(q, F.lit(t))
    match = F.lit(False)
    for t in terms:
        match |= F.contains(F.lower("word"), F.lit(t))
    order = Window.partitionBy("media_id").orderBy("start_us", "utt_id", "idx")
    first = kb.words.filter(match).withColumn("r", F.row_number().over(order)).filter("r <= 3").groupBy("media_id").agg(F.array_sort(F.collect_list("start_us")).alias("times_us"))
    spoken = kb.utterances.groupBy("media_id").agg(F.array_sort(F.collect_set("speaker")).alias("speakers"))
    last = kb.words.groupBy("media_id").agg(F.max("end_us").alias("end_us"))
    each = requests.select(*R, "query").join(last, "media_id", "left").join(first, "media_id", "left").join(spoken, "media_id", "left")
    kind = F.when(F.col("end_us").isNotNull(), F.when(about, "topic").when(who, "speakers").otherwise("end"))
    of = lambda k, c, t: F.when(F.col("kind") == k, F.coalesce(c, F.expr(f"cast(array() as array<{t}>)"))).alias(c)
    return each.withColumn("kind", kind).select(*R, "kind", of("topic", "times_us", "bigint"), of("speakers", "speakers", "string"), F.when(F.col("kind") == "end", F.col("end_us")).alias("end_us"))


def grounded(kb, requests: DataFrame) -> DataFrame:
    """(query_id, media_id, entities, candidates): the persons and objects of the item that a request's words name.

    A word names a label, or a person by the part of the id behind the colon. Where a request of the modality "person" (column ``person``) names none and holds no label either,
    all labels are ``candidates`` to ask back for.
    """
    people = kb.people.select("media_id", "entity_id", F.lower("label").alias("label"), F.regexp_extract("entity_id", "[^:]*$", 0).alias("short"))
    things = kb.objects.select("media_id", F.concat(F.lit("object:"), F.lower("label")).alias("entity_id"), F.lower("label").alias("label"), F.lower("label").alias("short")).distinct()
    entities = people.unionByName(things)
    met = requests.select(*R, F.lower("query").alias("q"), "person").join(entities, "media_id", "left")
    word = lambda c: F.array_contains(F.split("q", r"\W+"), F.col(c))
    named = F.col("label").isNotNull() & (word("label") | word("short"))
    g = met.groupBy(*R).agg(F.array_sort(F.collect_set(F.when(named, F.col("entity_id")))).alias("entities"), F.array_sort(F.collect_set("label")).alias("labels"), F.coalesce(F.bool_or(F.contains("q", F.col("label"))), F.lit(False)).alias("held"), F.coalesce(F.bool_or("person"), F.lit(False)).alias("person"))
    ask = F.col("person") & (F.size("entities") == 0) & ~F.col("held")
    return g.select(*R, "entities", F.when(ask, F.col("labels")).otherwise(F.expr("cast(array() as array<string>)")).alias("candidates"))


def of_every_item(kb, queries: list[str]) -> DataFrame:
    """Requests of each query over every media item; a query's id is its place in the list."""
    asked = F.posexplode(F.array(*map(F.lit, queries))).alias("query_id", "query")
    return kb.media.select("media_id", asked).select(F.col("query_id").cast("long").alias("query_id"), "media_id", "query")
