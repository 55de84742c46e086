"""Queries of the subpackage: each operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, decontamination, language, licenses, middles, neardup, negatives, packing, pii, quality, secrets, sharding, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"))


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(_table(spark, sf_dir, "documents"))


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.link_quotations(spark, _table(spark, sf_dir, "conversations"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(spark, _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.benchmark_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.query_pii(_table(spark, sf_dir, "documents"))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.query_secrets(_table(spark, sf_dir, "documents"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.warc_round_trip(spark, _table(spark, sf_dir, "pages"))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify_language(_table(spark, sf_dir, "documents"))


def op10_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(spark, _table(spark, sf_dir, "documents")).drop("set_digest")


def op11_middles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return middles.query_middles(_table(spark, sf_dir, "documents"))


def op12_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.query_negatives(spark, _table(spark, sf_dir, "embeddings"))


def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.query_sharding(spark, _table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_packing, op2_licenses, op3_chat, op4_quality, op5_decontamination, op6_pii, op7_secrets, op8_warc, op9_language, op10_neardup, op11_middles, op12_negatives, op13_sharding)
}

ORACLES: dict[str, str] = {
    "op8_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
             d AS (SELECT page_id, octet_length(encode(h)) AS n, sha256(h) AS x FROM p),
             f AS (SELECT *, min(page_id) OVER (PARTITION BY x) AS o FROM d)
        SELECT page_id, n AS payload_bytes, x AS payload_digest,
               CASE WHEN n >= 100 AND page_id <> o THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN n >= 100 AND page_id <> o THEN o END AS refers_to
        FROM f""",
    "op3_chat": r"""
        WITH RECURSIVE known AS (SELECT row_number() OVER () AS r, conv_id, turn, string_split(regexp_replace(text, '\r\n?', chr(10), 'g'), chr(10)) AS ls FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL AND text IS NOT NULL),
             line AS (SELECT r, conv_id, turn, unnest(ls) AS t, generate_subscripts(ls, 1) AS i FROM known),
             part AS (SELECT r, conv_id, turn, i, length(regexp_replace(regexp_extract(t, '^(?:[ \t]*>)+'), '[^>]', '', 'g')) AS level, lower(trim(regexp_replace(regexp_replace(t, '^(?:[ \t]*>)+', ''), '\s+', ' ', 'g'))) AS p FROM line),
             turns AS (SELECT *, coalesce(level <> lag(level) OVER (PARTITION BY r ORDER BY i), true) AS begins FROM part),
             runs AS (SELECT *, sum(CAST(begins AS INT)) OVER (PARTITION BY r ORDER BY i) AS g FROM turns),
             passage AS (SELECT conv_id, turn, level, string_agg(p, ' ' ORDER BY i) AS p FROM runs WHERE level > 0 AND p <> '' GROUP BY r, conv_id, turn, level, g
                 UNION ALL SELECT conv_id, turn, level, p FROM part WHERE level > 0 AND p <> '' AND len(string_split(p, ' ')) < 5),
             cut AS (SELECT conv_id, turn, p, min(level) AS level, string_split(p, ' ') AS w FROM passage GROUP BY conv_id, turn, p),
             quoted AS (SELECT DISTINCT conv_id, turn, p, level, unnest(CASE WHEN len(w) < 5 THEN [p] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS k FROM cut),
             said AS (SELECT r, conv_id, turn, list(p ORDER BY i) AS ls, string_split(string_agg(p, ' ' ORDER BY i), ' ') AS w FROM part WHERE level = 0 AND p <> '' GROUP BY r, conv_id, turn),
             own AS (SELECT DISTINCT conv_id, turn, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS k FROM said
                 UNION SELECT conv_id, turn, k FROM (SELECT conv_id, turn, unnest(flatten(list_transform(range(1, len(ls) + 1), lambda i: [array_to_string(ls[i:i], ' '), array_to_string(ls[i:i + 1], ' '), array_to_string(ls[i:i + 2], ' '), array_to_string(ls[i:i + 3], ' ')]))) AS k FROM said) WHERE len(string_split(k, ' ')) < 5),
             found AS (SELECT q.conv_id, q.turn, q.p, q.level, q.k, max(o.turn) AS source FROM quoted q JOIN own o ON o.conv_id = q.conv_id AND o.k = q.k AND o.turn < q.turn GROUP BY ALL),
             hits AS (SELECT conv_id, turn, p, level, source, count(*) AS hits FROM found GROUP BY ALL),
             sizes AS (SELECT conv_id, turn, p, count(*) AS n FROM quoted GROUP BY ALL),
             best AS (SELECT h.* FROM hits h JOIN sizes s ON s.conv_id = h.conv_id AND s.turn = h.turn AND s.p = h.p WHERE 2 * hits >= n QUALIFY row_number() OVER (PARTITION BY h.conv_id, h.turn, h.p ORDER BY hits DESC, source DESC) = 1),
             vote AS (SELECT conv_id, turn, source, level = 1 AS direct, sum(length(p)) AS chars FROM best GROUP BY ALL),
             link AS (SELECT conv_id, turn, source AS reply_to FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY direct DESC, chars DESC, source DESC) AS r FROM vote) WHERE r = 1),
             chain AS (SELECT conv_id, turn, reply_to AS up, 1 AS depth FROM link UNION ALL SELECT c.conv_id, c.turn, l.reply_to, c.depth + 1 FROM chain c JOIN link l ON l.conv_id = c.conv_id AND l.turn = c.up),
             top AS (SELECT conv_id, turn, min(up) AS thread, max(depth) AS depth FROM chain GROUP BY ALL)
        SELECT m.conv_id, m.turn, m.role, l.reply_to, coalesce(t.thread, m.turn) AS thread, CAST(coalesce(t.depth, 0) AS BIGINT) AS depth,
               CASE WHEN regexp_matches(m.text, '(?m)^[ \t]*>') THEN regexp_replace(array_to_string(list_filter(m.ls, lambda x, i: NOT regexp_matches(x, '^[ \t]*>') AND NOT (
                   regexp_matches(trim(x), '(?i)^(on\b.*\bwrote|le\b.*\ba écrit|am\b.*\bschrieb.*|el\b.*\bescribió)\s*:$') AND coalesce(regexp_matches(m.ls[i + 1], '^[ \t]*>'), false))), chr(10)), '^\s+|\s+$', '', 'g') ELSE m.text END AS text
        FROM (SELECT *, string_split(regexp_replace(text, '\r\n?', chr(10), 'g'), chr(10)) AS ls FROM conversations) m
        LEFT JOIN link l ON l.conv_id = m.conv_id AND l.turn = m.turn LEFT JOIN top t ON t.conv_id = m.conv_id AND t.turn = m.turn""",
    "op10_neardup": r"""
        WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
             shingles AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) > 1 THEN list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) ELSE w END) AS g FROM words),
             sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY 1),
             shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM shingles a JOIN shingles b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
             links AS (SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
             near AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
             reach AS (SELECT doc_id AS node, doc_id AS other FROM documents UNION SELECT r.node, n.b FROM reach r JOIN near n ON n.a = r.other)
        SELECT node AS doc_id, coalesce(any_value(s.n), 0) AS n_shingles, min(other) AS component_id, node = min(other) AS kept FROM reach LEFT JOIN sizes s ON s.doc_id = node GROUP BY node""",
    "op11_middles": r"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS x FROM documents),
             u AS (SELECT *, regexp_extract_all(t, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS w,
                   CAST('0x' || x[1:8] AS BIGINT) AS h1, CAST('0x' || x[9:16] AS BIGINT) AS h2, CAST('0x' || x[17:24] AS BIGINT) AS h3, CAST('0x' || x[25:32] AS BIGINT) AS h4 FROM d),
             c AS (SELECT *, len(w) AS n, least(h1 % (len(w) + 1), h2 % (len(w) + 1)) AS a, greatest(h1 % (len(w) + 1), h2 % (len(w) + 1)) AS b,
                   CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM u),
             s AS (SELECT *, array_to_string(w[1:a], '') AS p, array_to_string(w[a + 1:b], '') AS m, array_to_string(w[b + 1:n], '') AS e FROM c)
        SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
               sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || e || '<M>' || m ELSE '<S>' || e || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256
        FROM s""",
    "op12_negatives": """
        WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (CAST(label AS BIGINT) + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q FROM embeddings
                   WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
             s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score FROM e a JOIN e b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
             p AS (SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
        SELECT p.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other) AS INT) AS rank, other AS negative_id, positive_score, score AS negative_score
        FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
        QUALIFY rank <= 3""",
}
