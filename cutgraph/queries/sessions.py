"""Session logs, budgets and gates; orders stand for sessions, and their lines for the rows of a log."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans import session, sessions, stages
from ..sources.kb import KB
from .base import query, r6

_STATES = "['parsed', 'retrieving', 'planning', 'validating', 'preview_ready', 'done', 'failed']"
_LOG = f"""log AS (SELECT l_orderkey AS session_id, l_orderkey % 100 AS media_id, 'prompt ' || (l_orderkey % 40) AS prompt, CASE WHEN l_orderkey % 3 = 0 THEN 'mechanical' ELSE 'narrative' END AS kind, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS version,
    {_STATES}[(l_partkey + l_linenumber) % 7 + 1] AS state, CASE WHEN l_partkey % 2 = 0 THEN 'plan ' || (l_partkey % 4) END AS plan, CASE WHEN l_suppkey % 2 = 0 THEN 'result ' || l_suppkey END AS payload, floor(l_quantity::DOUBLE / 2 + 0.5)::BIGINT AS calls, l_linenumber::BIGINT AS retries, l_tax::DOUBLE * 100 AS seconds, floor(l_discount::DOUBLE * 100 + 0.5) / 100 AS dollars FROM lineitem),
    snap AS (SELECT * FROM log QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY version DESC) = 1)"""


def _log(kb: KB) -> DataFrame:
    states = F.array(*map(F.lit, ("parsed", "retrieving", "planning", "validating", "preview_ready", "done", "failed")))
    o = F.col("l_orderkey")
    return kb.table("lineitem").select(
        o.alias("session_id"), (o % 100).alias("media_id"), F.concat(F.lit("prompt "), (o % 40).cast("string")).alias("prompt"), F.when(o % 3 == 0, "mechanical").otherwise("narrative").alias("kind"), F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")).cast("long").alias("version"),
        F.element_at(states, ((F.col("l_partkey") + F.col("l_linenumber")) % 7 + 1).cast("int")).alias("state"), F.when(F.col("l_partkey") % 2 == 0, F.concat(F.lit("plan "), (F.col("l_partkey") % 4).cast("string"))).alias("plan"),
        F.when(F.col("l_suppkey") % 2 == 0, F.concat(F.lit("result "), F.col("l_suppkey").cast("string"))).alias("payload"), F.floor(F.col("l_quantity").cast("double") / 2 + 0.5).cast("long").alias("calls"), F.col("l_linenumber").cast("long").alias("retries"), (F.col("l_tax").cast("double") * 100).alias("seconds"), (F.floor(F.col("l_discount").cast("double") * 100 + 0.5) / 100).alias("dollars"),
    )


@query(f"WITH {_LOG} SELECT session_id, version, state, plan, payload, state NOT IN ('done', 'failed') AS open FROM snap")
def session_snapshot(kb: KB) -> DataFrame:
    """The last row of each session by version, and whether a new run takes it up."""
    return sessions.snapshot(_log(kb)).select("session_id", "version", "state", "plan", "payload", (~F.col("state").isin(*sessions.FINAL)).alias("open"))


@query(f"""WITH {_LOG}, c AS (SELECT media_id, prompt, arg_max(payload, session_id) AS payload FROM snap WHERE state = 'done' AND payload IS NOT NULL GROUP BY 1, 2)
    SELECT o_orderkey, payload FROM orders LEFT JOIN c ON c.media_id = o_custkey % 100 AND c.prompt = 'prompt ' || (o_custkey % 40)""")
def session_cache(kb: KB) -> DataFrame:
    """Each request (an order) with the result of the latest session done for the same item and prompt."""
    k = F.col("o_custkey")
    asked = kb.table("orders").select("o_orderkey", (k % 100).alias("media_id"), F.concat(F.lit("prompt "), (k % 40).cast("string")).alias("prompt"))
    return sessions.cached(_log(kb), asked).select("o_orderkey", "payload")


@query(f"""WITH {_LOG}, t AS (SELECT session_id, list(DISTINCT plan) AS tried FROM log WHERE plan IS NOT NULL GROUP BY 1),
    j AS (SELECT s.*, tried, o_orderkey % 2 = 0 AS passed, CASE o_custkey % 3 WHEN 0 THEN 'retrieval' WHEN 1 THEN 'story' ELSE 'planner' END AS route, 'plan ' || (o_custkey % 6) AS p, calls + o_orderkey % 4 AS c, seconds + o_custkey % 200 AS sec FROM snap s JOIN orders ON o_orderkey = session_id LEFT JOIN t ON t.session_id = s.session_id WHERE state NOT IN ('done', 'failed')),
    k AS (SELECT *, c < 24 AND retries <= 10 AND sec < 900 AND dollars < 1.0 AND version < 50 AS open, CASE route WHEN 'retrieval' THEN 'retrieving' WHEN 'story' THEN 'reasoning' ELSE 'planning' END AS back FROM j),
    m AS (SELECT *, (kind = 'narrative' OR back <> 'reasoning') AND retries < 10 AND NOT coalesce(list_contains(tried, p), false) AS again, state = 'validating' AND NOT passed AS no FROM k)
    SELECT session_id, version + 1 AS version, CASE WHEN NOT open THEN 'failed' WHEN no THEN CASE WHEN again THEN back ELSE 'failed' END WHEN state = 'parsed' THEN 'retrieving' WHEN state = 'retrieving' THEN CASE kind WHEN 'mechanical' THEN 'planning' ELSE 'reasoning' END WHEN state = 'planning' THEN 'validating' WHEN state = 'validating' THEN 'preview_ready' ELSE 'done' END AS state,
        c AS calls, retries + CASE WHEN open AND no AND again THEN 1 ELSE 0 END AS retries, floor(sec * 1e6 + 0.5) / 1e6 AS seconds FROM m""")
def session_advance(kb: KB) -> DataFrame:
    """Every open session a step on: budgets, routes back after a failed validation, plans that were tried before."""
    o, k = F.col("o_orderkey"), F.col("o_custkey")
    route = F.when(k % 3 == 0, "retrieval").when(k % 3 == 1, "story").otherwise("planner")
    steps = kb.table("orders").select(o.alias("session_id"), (o % 2 == 0).alias("passed"), route.alias("route"), F.concat(F.lit("plan "), (k % 6).cast("string")).alias("plan"), F.lit(None).cast("string").alias("payload"), (o % 4).alias("calls"), F.lit(0).cast("long").alias("retries"), (k % 200).cast("double").alias("seconds"), F.lit(0.0).alias("dollars"))
    return sessions.advanced(_log(kb), steps, session.Budget()).select("session_id", "version", "state", "calls", "retries", r6("seconds").alias("seconds"))


_ASKED = "['remove the silence', 'keep only the speaker', 'the person looking at us', 'just music', 'faces and voices']"


@query(f"""WITH r AS (SELECT media_id, i, {_ASKED}[i + 1] AS query FROM media CROSS JOIN (SELECT unnest(range(5)) AS i)), w AS (SELECT DISTINCT media_id FROM words)
    SELECT media_id, i AS query_id, CASE WHEN i = 0 AND media_id NOT IN (FROM w) THEN 'no speech' WHEN i IN (2, 4) AND media_id % 4 <> 1 THEN 'no faces' WHEN i IN (1, 4) AND media_id % 3 = 0 THEN 'no speakers' END AS out_of_scope FROM r""")
def coverage_gates(kb: KB) -> DataFrame:
    """Why requests can't be met: speakers are there unless the item's number is a multiple of 3, faces for every fourth."""
    i = F.col("media_id")
    status = lambda ok: F.when(ok, "available").otherwise("degraded")
    each = F.array(F.struct(F.lit("speakers").alias("capability"), status(i % 3 != 0).alias("status")), F.struct(F.lit("faces").alias("capability"), F.when(i % 4 == 0, "unavailable").otherwise(status(i % 4 == 1)).alias("status")))
    coverage = kb.media.select("media_id", F.inline(each))
    asked = F.array(*map(F.lit, ("remove the silence", "keep only the speaker", "the person looking at us", "just music", "faces and voices")))
    requests = kb.media.select("media_id", F.posexplode(asked).alias("query_id", "query")).withColumn("action", F.when(F.col("query_id") == 0, "remove").otherwise("keep_only"))
    return sessions.gated(requests, coverage, kb.words).select("media_id", F.col("query_id").cast("long").alias("query_id"), "out_of_scope")


@query("""WITH i AS (SELECT o_orderkey, ['beat_cut', 'match_cut', 'fast', NULL][o_custkey % 4 + 1] AS style, ['trailer', 'chronological', NULL][o_orderkey % 3 + 1] AS shape, CASE o_custkey % 5 WHEN 0 THEN ['remove', 'compress'] WHEN 1 THEN ['keep_only'] WHEN 2 THEN ['restructure'] ELSE ['remove'] END AS actions, o_custkey % 2 = 0 AS target FROM orders)
    SELECT o_orderkey, coalesce(style IN ('beat_cut', 'match_cut'), false) OR coalesce(shape = 'trailer', false) OR list_has_any(actions, ['restructure', 'compress']) OR (target AND list_contains(actions, 'keep_only')) AS needs FROM i""")
def need_agent(kb: KB) -> DataFrame:
    """Which intents need the story agent."""
    k, o = F.col("o_custkey"), F.col("o_orderkey")
    pick = lambda xs, at: F.element_at(F.array(*map(F.lit, xs)), (at + 1).cast("int"))
    of = lambda *xs: F.array(*map(F.lit, xs))
    actions = F.when(k % 5 == 0, of("remove", "compress")).when(k % 5 == 1, of("keep_only")).when(k % 5 == 2, of("restructure")).otherwise(of("remove"))
    needs = sessions.needs_story(pick(("beat_cut", "match_cut", "fast", None), k % 4), pick(("trailer", "chronological", None), o % 3), actions, F.when(k % 2 == 0, F.lit(60_000_000)))
    return kb.table("orders").select("o_orderkey", needs.alias("needs"))


_NAMES = list(stages.STAGES)
_FACTS = ", ".join(f"('{n}', {[*s.needs]}::VARCHAR[], {sorted(stages.above(n))}::VARCHAR[], '{s.version}', '{s.pool}', {s.lease_us}, {stages.levels()[n]})" for n, s in stages.STAGES.items())


@query(f"""WITH f(stage, needs, above, version, pool, lease, depth) AS (VALUES {_FACTS}),
    l AS (SELECT l_orderkey AS media_id, {_NAMES}[l_partkey % 11 + 1] AS stage, l_linenumber AS seq, ['done', 'done', 'done', 'running', 'failed'][l_suppkey % 5 + 1] AS status, CASE WHEN l_partkey % 11 < 4 AND l_suppkey % 7 > 0 THEN '2.0' ELSE '1.0' END AS version, l_linenumber % 4 AS attempts, CAST(l_quantity AS BIGINT) * 20000000 AS since FROM lineitem),
    j AS (SELECT media_id, stage, max(struct_pack(seq := seq, status := status, version := version, attempts := attempts, since := since)) AS r FROM l GROUP BY 1, 2),
    e AS (SELECT o_orderkey AS media_id, f.*, j.r FROM orders CROSS JOIN f LEFT JOIN j ON j.media_id = o_orderkey AND j.stage = f.stage),
    o AS (SELECT *, CASE WHEN r.status = 'done' AND r.version = version THEN 'done' WHEN r.status = 'running' AND 1000000000 - r.since <= lease THEN 'running' WHEN r.status = 'failed' AND r.attempts >= 3 THEN 'failed' WHEN r.status = 'failed' AND 1000000000 - r.since < pow(2, r.attempts - 1) * 1000000 THEN 'backoff' ELSE 'pending' END AS own FROM e),
    d AS (SELECT media_id, list(stage) FILTER (own = 'done') AS done, list(stage) FILTER (own = 'failed') AS failed FROM o GROUP BY 1),
    s AS (SELECT *, CASE WHEN own <> 'pending' THEN own WHEN list_has_any(coalesce(failed, []), above) THEN 'blocked' WHEN list_has_all(coalesce(done, []), needs) THEN 'ready' ELSE 'waiting' END AS state FROM o JOIN d USING (media_id))
    SELECT media_id, stage, state, coalesce(r.attempts, 0) AS attempts, coalesce(r.seq, 0) AS seq, state = 'ready' AND row_number() OVER (PARTITION BY media_id, pool ORDER BY state <> 'ready', depth, stage) + count(*) FILTER (state = 'running') OVER (PARTITION BY media_id, pool) <= 2 AS claimed FROM s""")
def stage_claims(kb: KB) -> DataFrame:
    """Which stages of which items run next (here: an order's lines are its log of jobs, at 1000 s)."""
    s = F.col("l_suppkey")
    version = F.when((F.col("l_partkey") % 11 < 4) & (s % 7 > 0), "2.0").otherwise("1.0")
    log = kb.table("lineitem").select(
        F.col("l_orderkey").alias("media_id"), F.get(F.array(*map(F.lit, _NAMES)), (F.col("l_partkey") % 11).cast("int")).alias("stage"), F.col("l_linenumber").cast("long").alias("seq"),
        F.get(F.array(*map(F.lit, ("done", "done", "done", "running", "failed"))), (s % 5).cast("int")).alias("status"), version.alias("version"), (F.col("l_linenumber") % 4).cast("long").alias("attempts"), (F.col("l_quantity").cast("long") * 20_000_000).alias("updated_us"),
    )
    return stages.states(log, kb.table("orders").select(F.col("o_orderkey").alias("media_id")), 1_000_000_000)


@query("""WITH p AS (SELECT user_id, event_id AS seq, CASE event_type WHEN 'click' THEN 'fast' WHEN 'view' THEN 'cinematic' END AS pacing, CASE WHEN value > 30 THEN NULL WHEN event_id % 3 = 0 THEN 'tiktok' WHEN event_id % 3 = 1 THEN 'youtube' ELSE 'reels' END AS platform FROM events),
    a AS (SELECT user_id, arg_max(pacing, seq) AS pacing FROM (SELECT *, row_number() OVER (PARTITION BY user_id, pacing ORDER BY seq) AS n FROM p WHERE pacing IS NOT NULL) WHERE n >= 3 GROUP BY 1),
    b AS (SELECT user_id, arg_min(platform, seq) AS platform FROM (SELECT *, row_number() OVER (PARTITION BY user_id, platform ORDER BY seq) AS n FROM p WHERE platform IS NOT NULL) WHERE n = 3 GROUP BY 1),
    i AS (SELECT o_orderkey, o_custkey AS user_id, CASE WHEN o_orderkey % 3 = 0 THEN 'neutral' END AS pacing, CASE WHEN o_orderkey % 2 = 0 THEN 'cinema' END AS platform FROM orders)
    SELECT o_orderkey, i.user_id, coalesce(i.pacing, a.pacing) AS pacing, coalesce(i.platform, b.platform) AS platform, concat_ws(',', CASE WHEN i.pacing IS NULL AND a.pacing IS NOT NULL THEN 'profile_pacing' END, CASE WHEN i.platform IS NULL AND b.platform IS NOT NULL THEN 'profile_platform' END) AS applied
    FROM i LEFT JOIN a ON a.user_id = i.user_id LEFT JOIN b ON b.user_id = i.user_id""")
def profile_merge(kb: KB) -> DataFrame:
    """Intents (here: orders) with what their users' earlier prompts (here: events) have taught."""
    e, kind = F.col("event_id"), F.col("event_type")
    platform = F.when(F.col("value") > 30, None).when(e % 3 == 0, "tiktok").when(e % 3 == 1, "youtube").otherwise("reels")
    prompts = kb.table("events").select("user_id", e.alias("seq"), F.when(kind == "click", "fast").when(kind == "view", "cinematic").alias("pacing"), platform.alias("platform"))
    o = F.col("o_orderkey")
    intents = kb.table("orders").select("o_orderkey", F.col("o_custkey").alias("user_id"), F.when(o % 3 == 0, "neutral").alias("pacing"), F.when(o % 2 == 0, "cinema").alias("platform"))
    return sessions.with_profile(intents, sessions.learned(prompts)).withColumn("applied", F.array_join("applied", ","))
