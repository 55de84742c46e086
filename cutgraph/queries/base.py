"""Registry of queries, and the knowledge base in the oracle's SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.kb import KB

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}

#: The knowledge base as common table expressions, each after those that it reads.
PRELUDE = {
    "sig": """SELECT user_id AS media_id, event_id AS id, user_id, event_type, value, props, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) // 1000 AS start_us,
        (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) // 1000 + CAST(floor(value * 100 + 0.5) AS BIGINT) * 200 AS end_us FROM events""",
    "silences": """SELECT media_id, a AS start_us, b AS end_us FROM (
        SELECT media_id, coalesce(max(end_us) OVER (PARTITION BY media_id ORDER BY start_us, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a, start_us AS b FROM sig
        UNION ALL SELECT media_id, max(end_us), 2600000000 FROM sig GROUP BY media_id) WHERE b - a >= 300000""",
    "audio": """SELECT media_id, id, CASE event_type WHEN 'click' THEN 'laughter' WHEN 'view' THEN 'music' WHEN 'purchase' THEN 'applause' WHEN 'signup' THEN 'gasp' WHEN 'error' THEN 'cough' END AS type,
        start_us, end_us, least(value / 100, 1.0) AS confidence FROM sig""",
    "scenes": """SELECT media_id, id, start_us, lead(start_us, 1, 2600000000) OVER (PARTITION BY media_id ORDER BY start_us, id) AS end_us, value > 80 AS is_broll, CASE WHEN id % 3 <> 2 THEN id % 3 = 1 END AS indoor,
        'loc' || (id % 6) AS location, ['happy', 'joy', 'sad', 'angry', 'amused', 'excited', 'neutral', 'tense'][id % 8 + 1] AS emotion, least(value / 100, 1.0) AS intensity, value / 500 AS importance,
        ['hook', 'setup', 'development', 'climax', 'payoff', 'outro', 'intro', 'transition', NULL][id % 9 + 1] AS story_role, (id % 97) / 97.0::DOUBLE AS motion, ['wide', 'close', 'medium'][id % 3 + 1] AS shot_type FROM sig WHERE event_type = 'signup'""",
    "appears": """SELECT g.media_id, 'person:' || g.user_id AS src, 'appears_in' AS rel, 'scene:' || s.id AS dst, s.id AS scene_id, g.start_us AS t_us, least(g.value / 100, 1.0) AS confidence,
        CASE g.event_type WHEN 'click' THEN 'faces' WHEN 'view' THEN 'vision' WHEN 'purchase' THEN 'graph' WHEN 'signup' THEN 'vision' END AS source
        FROM sig g JOIN scenes s ON g.media_id = s.media_id AND g.start_us >= s.start_us AND g.start_us < s.end_us""",
    "objects": """SELECT g.media_id, ['phone', 'laptop', 'whiteboard', 'cup', 'book', 'camera', 'screen', 'microphone'][g.id % 8 + 1] AS label, s.id AS scene_id, least(g.value / 100, 1.0) AS confidence
        FROM sig g JOIN scenes s ON g.media_id = s.media_id AND g.start_us >= s.start_us AND g.start_us < s.end_us WHERE g.event_type IN ('view', 'signup')""",
    "unsure": """SELECT DISTINCT media_id, scene_id FROM (SELECT media_id, label, count(*) AS n, min(scene_id) AS scene_id FROM objects GROUP BY 1, 2) WHERE n = 1""",
    "topics": """SELECT media_id, id, ['pricing', 'travel', 'family', 'sport', 'music', 'other things'][id % 6 + 1] AS label, ['demo', 'other', 'sponsor', 'review'][id % 4 + 1] AS class, start_us, end_us FROM scenes""",
    "media": """SELECT user_id AS media_id FROM events UNION SELECT conv_id FROM conversations""",
    "people": """SELECT media_id, src AS entity_id, 'guest ' || regexp_extract(src, '[0-9]+') AS label, row_number() OVER (PARTITION BY media_id ORDER BY count(*) DESC, src) = 1 AS is_owner FROM appears GROUP BY 1, 2""",
    "utts": """SELECT media_id, id, speaker, text, e - dur AS start_us, e AS end_us, ['question', 'answer', 'statement'][id % 3 + 1] AS dialogue_act FROM (
        SELECT conv_id AS media_id, turn AS id, role AS speaker, text, length(text) * 66667 AS dur, CAST(sum(length(text) * 66667 + ((conv_id * 7 + turn * 13) % 5) * 700000) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS e FROM conversations)""",
    "words": r"""SELECT media_id, utt_id, speaker, idx, word, s + ((e - s) * (c - length(word))) // t AS start_us, s + ((e - s) * c) // t AS end_us FROM (
        SELECT *, CAST(sum(length(word)) OVER (PARTITION BY media_id, utt_id ORDER BY idx) AS BIGINT) AS c, CAST(sum(length(word)) OVER (PARTITION BY media_id, utt_id) AS BIGINT) AS t FROM (
        SELECT media_id, id AS utt_id, speaker, start_us AS s, end_us AS e, unnest(ws) AS word, CAST(unnest(range(len(ws))) AS INTEGER) AS idx FROM (SELECT *, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS ws FROM utts)))""",
}


def oracle(sql: str) -> str:
    """The SQL with the common tables that it names before it."""
    needed: set[str] = set()
    text = sql
    for name in reversed(PRELUDE):
        if re.search(rf"\b(FROM|JOIN)\s+{name}\b", text):
            needed.add(name)
            text += PRELUDE[name]
    ctes = [f"{n} AS ({PRELUDE[n]})" for n in PRELUDE if n in needed]
    own = sql.strip()
    if own[:5].upper() == "WITH ":
        return f"WITH {'RECURSIVE ' if own[5:15].upper() == 'RECURSIVE ' else ''}" + ", ".join([*ctes, own[15:] if own[5:15].upper() == "RECURSIVE " else own[5:]])
    return f"WITH {', '.join(ctes)} {own}" if ctes else own


def query(sql: str | None = None):
    """Register a function of a KB under its own name; ``sql`` gives the same rows in DuckDB."""

    def register(f: Callable[[KB], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(KB(spark, sf_dir))
        if sql is not None:
            ORACLES[f.__name__] = oracle(sql)
        return f

    return register


def r6(x: Column | str) -> Column:
    """Six decimals by the same steps in both engines."""
    c = F.col(x) if isinstance(x, str) else x
    return F.floor(c * 1e6 + 0.5) / 1e6
