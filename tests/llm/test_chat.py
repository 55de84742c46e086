import duckdb

from cutgraph.llm.chat import link_quotations
from cutgraph.llm.queries import ORACLES

SCHEMA = "conv_id long, turn long, role string, text string, thread string"


def linked(spark, rows):
    out = link_quotations(spark, spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA)).collect()
    return [(r.conv_id, r.turn, r.text, r.reply_to, r.thread, r.depth) for r in out]


def test_nested_quotes_give_threads(spark):
    rows = [
        (1, 0, "user", "How do I merge\nintervals?"),
        (1, 1, "user", "And what is a beat?"),
        (1, 2, "assistant", "On Monday A wrote:\n> How do I   MERGE\n> intervals?\nSort them first."),
        (1, 3, "assistant", "> And what is a beat?\nA pulse."),
        (1, 4, "user", "> > How do I merge\n> Sort them first.\nThanks."),
        (2, 0, "user", "Sort them first."),
    ]
    assert linked(spark, rows) == [
        (1, 0, "How do I merge\nintervals?", None, 0, 0),
        (1, 2, "Sort them first.", 0, 0, 1),
        (1, 4, "Thanks.", 2, 0, 2),
        (1, 1, "And what is a beat?", None, 1, 0),
        (1, 3, "A pulse.", 1, 1, 1),
        (2, 0, "Sort them first.", None, 0, 0),
    ]


def test_latest_earlier_source_and_long_chains(spark):
    rows = [(5, 0, "u", "start")] + [(5, t, "u", f"> {'start' if t == 1 else f'say {t - 1}'}\nsay {t}") for t in range(1, 12)] + [(5, 12, "u", "say 3"), (5, 13, "u", "> say 3\nok")]
    got = {r[1]: r for r in linked(spark, rows)}
    assert [got[t][5] for t in range(12)] == list(range(12))
    assert all(got[t][4] == 0 for t in range(12))
    assert got[13][3] == 12 and got[13][4] == 12


def test_edges(spark):
    assert linked(spark, []) == []
    rows = [(None, 0, "u", "> x"), (1, None, "u", "x"), (1, 0, None, None), (1, 1, "u", ""), (1, 1, "u", "> nothing known"), (1, 2, "u", "a"), (1, 2, "u", "a"), (1, 3, "u", ">a")]
    got = linked(spark, rows)
    assert len(got) == 8
    assert (1, 3, "", 2, 2, 1) in got and (None, 0, "", None, 0, 0) in got and (1, 0, None, None, 0, 0) in got


def test_against_the_oracle(spark):
    import random

    r = random.Random(8)
    rows = []
    for conv in range(20):
        said: list[str] = []
        for turn in range(12):
            lines = [f"{'> ' * r.randint(1, 3)}{r.choice(said)}" for _ in range(r.randint(0, 3)) if said]
            lines = (["On Monday A wrote:"] if lines and r.random() < 0.4 else []) + lines
            own = [f"line {r.randint(0, 9)}" for _ in range(r.randint(0, 3))]
            said += own
            rows.append((conv, turn, "user", "\n".join(lines + own)))
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    told = con.execute(f"SELECT conv_id, turn, text, reply_to, thread, depth FROM ({ORACLES['op3_chat']})").fetchall()
    got = linked(spark, rows)
    assert sorted(told) == sorted(got)
    assert sum(r[3] is not None for r in got) > 50


def test_partial_rewrapped_and_mixed_quotes(spark):
    first = "We met on the old bridge at noon. Then it began to rain and we went home by the river road."
    rows = [
        (1, 0, "u", first),
        (1, 1, "u", "Something else was said here by someone else again."),
        (1, 2, "u", "> Then it began to rain and we went home\nReally?"),
        (1, 3, "u", "> We met on\n> the old bridge\n> at noon. Then it\n> began to rain\nI saw you."),
        (1, 4, "u", ">> We met on the old bridge\n> I saw\n> you.\nWhere?"),
        (1, 5, "u", "> one two three four five six began to rain and we\nno"),
        (1, 6, "u", "> Something else was said here\n> Really?\nboth"),
    ]
    got = {t: up for _, t, _, up, _, _ in linked(spark, rows)}
    assert got == {0: None, 1: None, 2: 0, 3: 0, 4: 3, 5: None, 6: 1}


def test_random_quotes_against_the_oracle(spark):
    import random

    r = random.Random(9)
    rows, words = [], [f"w{i}" for i in range(9)]
    for conv in range(30):
        said: list[list[str]] = []
        for turn in range(10):
            quotes = []
            for _ in range(r.randint(0, 2) if said else 0):
                source = r.choice(said)
                a = r.randrange(len(source))
                piece, depth = source[a : a + r.randint(1, 14)], r.randint(1, 2)
                while piece:
                    n = r.randint(1, 6)
                    quotes.append(">" * depth + r.choice(["", " "]) + r.choice([" ", "  "]).join(piece[:n]))
                    piece = piece[n:]
            own = [r.choice(words) for _ in range(r.randint(1, 20))]
            said.append(own)
            text, rest = "", list(own)
            while rest:
                n = r.randint(1, 7)
                text, rest = text + " ".join(rest[:n]) + r.choice(["\n", "\n\n", "\r\n"]), rest[n:]
            rows.append((conv, turn, "user", "\n".join(quotes) + "\n" + text))
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    told = con.execute(f"SELECT conv_id, turn, text, reply_to, thread, depth FROM ({ORACLES['op3_chat']})").fetchall()
    got = linked(spark, rows)
    assert sorted(told) == sorted(got)
    assert sum(r[3] is not None for r in got) > 100
