"""Queries against their oracles on small tables that the test data has nothing like."""

import duckdb
import pytest

from cutgraph.operators import search, vectors
from cutgraph.queries import ORACLES, QUERIES
from tests.test_queries import rows


def same_as_sql(spark, path, name, **tables):
    """The query's rows, which must be those of its SQL; ``tables`` are SELECTs that DuckDB writes to ``path``."""
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t, select in tables.items():
        con.execute(f"COPY ({select}) TO '{path}/{t}.parquet' (FORMAT parquet)")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}/{t}.parquet'")
    df = QUERIES[name](spark, str(path))
    got = rows(df.columns, df.collect())
    told = con.execute(ORACLES[name])
    assert got == rows([d[0] for d in told.description], told.fetchall())
    return got


def events(*series):
    """Events of one user a series, a text with a letter a second: c for a click, v for a view."""
    told = [(u, s, {"c": "click", "v": "view"}[x], 1.0 + s * s % 7) for u, text in enumerate(series) for s, x in enumerate(text) if x != " "]
    values = ", ".join(f"({i}, {u}, '{kind}', {s}, {value}::DOUBLE)" for i, (u, s, kind, value) in enumerate(told))
    return f"SELECT i::BIGINT AS event_id, TIMESTAMP '2024-01-01' + to_seconds(s * 1000) AS ts, u::BIGINT AS user_id, kind AS event_type, value, '' AS props FROM (VALUES {values}) t(i, u, kind, s, value)"


def test_correlation_of_series_that_are_constant_or_missing(spark, tmp_path):
    got = same_as_sql(spark, tmp_path, "mouth_audio_corr", events=events("vccc", "cccc", "cvcvcvc", "cc", "c   c   vc"))
    assert len(got) == 4


def timed(*rows):
    """Events (user, kind, second, length in seconds) that need not be in order."""
    values = ", ".join(f"({i}, {u}, '{kind}', {s}, {length * 50}::DOUBLE)" for i, (u, kind, s, length) in enumerate(rows))
    return f"SELECT i::BIGINT AS event_id, TIMESTAMP '2024-01-01' + to_microseconds(CAST(s * 1e9 AS BIGINT)) AS ts, u::BIGINT AS user_id, kind AS event_type, value, '' AS props FROM (VALUES {values}) t(i, u, kind, s, value)"


@pytest.mark.parametrize("name", ["critic_tier0", "critic_leftovers", "cut_windows", "edit_report"])
def test_what_long_silences_leave(spark, tmp_path, name):
    one = [(1, "view", 0, 1), (1, "purchase", 2.5, 9), (1, "view", 4, 1), (1, "view", 20, 0), (1, "view", 30, 0.004), (1, "click", 40, 0.02), (1, "view", 40.01, 3)]
    whole = [(2, "view", 1.5 * i, 1) for i in range(1734)]  # no silence
    ends = [(3, "view", 2, 600), (3, "view", 5, 1), (3, "purchase", 604.1, 5), (4, "view", 10, 2500), (5, "view", 2599, 5), (6, "purchase", 2.1, 1), (6, "view", 2598.5, 1), (7, "view", -1, 4), (7, "view", -3, 0), (8, "view", 1000, 0.5)]
    got = same_as_sql(spark, tmp_path, name, events=timed(*one, *whole, *ends))
    assert got and (name != "critic_tier0" or {r[0] for r in got} == {"duration", "ratio", "midword", "floor"})
    plan = QUERIES[name](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert name != "critic_tier0" or plan.count("Sort [") <= 3


def test_windows_of_events_are_shuffled_once(spark, tmp_path):
    first = [(1, "click", s, n) for s, n in ((0.2, 1.2), (1.5, 0.5), (1.6, 0.9), (2, 0.8), (4, 0.7), (6.5, 1.1), (9, 0.2), (9.5, 0.6), (10.1, 0.8))]
    last = [(2, "view", s, n) for s, n in ((2595, 2), (2596.5, 1.4), (2597.2, 0.9), (2598.9, 3), (2599.5, 4))] + [(2, "error", 2598.2, 1.9), (3, "view", 1.1, 2), (3, "other", 5, 2), (4, "signup", 0, 0.4), (4, "signup", 1, 1.9), (4, "signup", 40, 1.1), (4, "signup", 42, 1.2)]
    got = same_as_sql(spark, tmp_path, "event_windows", events=timed(*first, *last))
    plan = QUERIES["event_windows"](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert len(got) == 5 and plan.count("Exchange") == 1 and plan.count("Sort [") == 2


@pytest.mark.parametrize("blank", [" ", " ", "　", "\t"])
def test_questions_by_ascii_words(spark, tmp_path, blank):
    texts = ["Doías que", "do we", "whaté?", "éadd it?", "addé it?", "you add it?", "who_is it", "Keep it?", "maKe it?", "iſ it so", "Is\nit", "cut", "", "why?"]
    values = ", ".join(f"({i}, '{blank}{t}{blank}')" for i, t in enumerate(texts))
    same_as_sql(spark, tmp_path, "is_question", documents=f"SELECT i::BIGINT AS doc_id, t AS text FROM (VALUES {values}, (99, NULL)) v(i, t)")


def test_equal_rounded_scores_rank_by_id(spark, tmp_path):
    vec = lambda x: f"[{x}, 0.0]::FLOAT[]"
    rows = ", ".join(f"({i}, {vec(x)})" for i, x in ((0, 1.0), (1, 0.5), (2, 0.5000002), (3, 0.5), (4, 0.7), (5, 0.4999998), (20, 0.1)))
    same_as_sql(spark, tmp_path, "vector_topk", embeddings=f"SELECT i::BIGINT AS vec_id, e AS embedding, 0 AS label FROM (VALUES {rows}) v(i, e)")


@pytest.mark.parametrize(("side", "extreme"), [(32768, "0.0"), (9, "0.0"), (9, "1e20"), (9, "nan")])
def test_vectors_are_scored_in_tiles(spark, tmp_path, monkeypatch, side, extreme):
    for limit, value in (("ROWS", side), ("QUERIES", 2), ("ROWS_AT_ONCE", 32)):
        monkeypatch.setattr(vectors, limit, value, raising=False)
    # many equal vectors, scores that are equal when rounded, one beyond a long or not a number
    v = [[(i * i % 7) / 7, (i % 3) / 3, 0.1] if i % 4 else [0.5, 0.5, 0.5 + i % 8 * 1e-8] for i in range(120)]
    v[33], v[60] = [extreme, 0.0, 0.0], [0.0, -1.0, 0.0]
    values = ", ".join("({}, ['{}'::DOUBLE, '{}'::DOUBLE, '{}'::DOUBLE])".format(i, *e) for i, e in enumerate(v))
    got = same_as_sql(spark, tmp_path, "vector_topk", embeddings=f"SELECT i::BIGINT AS vec_id, e AS embedding, 0 AS label FROM (VALUES {values}) v(i, e)")
    assert got
    plan = QUERIES["vector_topk"](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "CoGroup" in plan and "NestedLoop" not in plan and "Cartesian" not in plan


def test_vectors_without_a_score_are_left_out(spark):
    held = "id long, v array<float>"
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [1.0, None]), (4, [1.0]), (5, [0.5, 1.0]), (6, [])], held)
    asked = spark.createDataFrame([(7, [1.0, 0.0]), (8, None), (9, [2.0])], held).withColumnRenamed("id", "q")
    assert sorted(map(tuple, vectors.top_k(asked, rows, 3, "q", "id", "v").collect())) == [(7, 1, 1.0, 1), (7, 5, 0.5, 2), (9, 4, 2.0, 1)]
    assert vectors.top_k(asked, rows.limit(0), 3, "q", "id", "v", 6).collect() == []


@pytest.fixture
def unequal(spark):
    """Adaptive execution makes a different number of partitions of each side of a union."""
    settings = {"spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8k", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1k", "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false"}
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@pytest.mark.parametrize("name", ["dep_truncated", "plan_fixpoint", "swaps_applied"])
def test_items_come_whole_after_a_union(spark, unequal, tmp_path, name):
    table = lambda t: f"SELECT * FROM '/root/testdata/sf0.01/{t}.parquet'"
    same_as_sql(spark, tmp_path, name, events=table("events"), conversations=table("conversations"))


def test_trigrams_are_counted_where_their_text_is(spark, tmp_path):
    texts = ["a b c a b c a b c a b c", "A b\tc d e", "", "x x x x x x x", "one two three four five six", "é é é  é é é"]
    values = ", ".join(f"({i}, '{t}')" for i, t in enumerate(texts))
    same_as_sql(spark, tmp_path, "hallucination_guard", documents=f"SELECT i::BIGINT AS doc_id, t AS text FROM (VALUES {values}, (99, NULL)) v(i, t)")
    assert "Exchange" not in QUERIES["hallucination_guard"](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()


def test_a_bucket_of_the_index_is_dealt_to_several_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(search, "PER_TASK", 50, raising=False)
    docs = spark.createDataFrame([(i, f"word{i % 3} and and others {i}") for i in range(100)], "id long, text string")
    index = search.write_index(docs, str(tmp_path / "index"), "id", "text", buckets=2)
    assert all(len(list(b.glob("*.parquet"))) > 1 for b in (tmp_path / "index" / "postings").glob("bucket=*"))
    assert {r.term: r.df for r in index.terms.collect()} == {"word0": 34, "word1": 33, "word2": 33, "and": 100, "others": 100} | {str(i): 1 for i in range(100)}
    assert index.postings.count() == 400


def test_phrases_over_utterances_without_sorting_words(spark, tmp_path):
    said = ["of", "the", "x in", "the", "  de  LA ", "", "You know what", "um you", "know", "i", "mean it", "of the the"]
    values = ", ".join(f"({c}, {i}, '{t}')" for c in (1, 2) for i, t in enumerate(said[c - 1 :]))
    got = same_as_sql(spark, tmp_path, "filler_ngrams", conversations=f"SELECT c::BIGINT AS conv_id, i::BIGINT AS turn, 'user' AS role, t AS text FROM (VALUES {values}) v(c, i, t)")
    plan = QUERIES["filler_ngrams"](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert got and plan.index("Generate") < plan.index("Window")


def test_fillers_without_sorting_words(spark, tmp_path):
    said = ["of", "the, and", "x in", "(the) QUE", "  de  LA ", "", "and and la", "der of", "- the", "none"]
    values = ", ".join(f"({c}, {i}, '{r}', '{t}')" for c in (1, 2) for i, t in enumerate(said[c - 1 :]) for r in [("user", "other")[i % 2]])
    got = same_as_sql(spark, tmp_path, "ch_filler", conversations=f"SELECT c::BIGINT AS conv_id, i::BIGINT AS turn, r AS role, t AS text FROM (VALUES {values}) v(c, i, r, t)")
    plan = QUERIES["ch_filler"](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert got and not [x for x in plan.splitlines() if "Window [" in x and "speaker" in x]


@pytest.mark.parametrize("place", [0, 2_000_000])
def test_keywords_of_empty_and_equal_documents(spark, tmp_path, monkeypatch, place):
    monkeypatch.setattr(search, "IN_PLACE_FROM", place, raising=False)
    texts = ["'Red fox  the'", "''", "NULL", "'the'", "'the THE the\tdog'", "'é É cat the'"] + ["'red copy of the fox'"] * 30 + ["'blue'"]
    asked = ["'red the'", "NULL", "''", "'É cat cat'", "'unknown'", "'the'", "'blue fox'"]
    table = lambda name, xs: f"SELECT i::BIGINT AS {name}, t AS text FROM (VALUES {', '.join(f'({i}, {x})' for i, x in enumerate(xs))}) v(i, t)"
    got = same_as_sql(spark, tmp_path, "bm25_topk", documents=table("doc_id", texts), benchmark=table("item_id", asked))
    assert got
