"""Fill-in-the-middle against regular expressions and plain string work."""

import hashlib
import random
import re

import numpy as np
import pytest

from cutgraph.llm import middles

UNITS = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plainly(doc_id, text):
    text = text or ""
    words = UNITS.findall(text)
    n = len(words)
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[i : i + 8], 16) for i in (0, 8, 16, 24))
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(words[:a]), "".join(words[a:b]), "".join(words[b:])
    if h4 % 100 < 80:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def texts(seed, n):
    r = random.Random(seed)
    alphabet = [" ", "  ", "\n", "\t", "\x0b", "a", "word", "<", ">", "P", "<P", "<S", "<P>", "S>", "é", "漢字", "😀", " ", "\x1c", "<<M>", "\x85"]
    return ["".join(r.choices(alphabet, [3, 1, 1, 1, 1, 5, 5, 1, 1, 1, 0.3, 0.3, 0.03, 0.3, 2, 2, 2, 1, 1, 0.03, 1], k=r.randrange(60))) for _ in range(n)]


def held(rows):
    return [(n, form, p, m, out.decode()) for n, form, p, m, out in rows]


def test_against_plain_python():
    some = texts(1, 3000)
    rows = middles.transform(middles.Scanner(), list(range(3000)), [t.encode() for t in some])
    assert held(rows) == [plainly(i, t) for i, t in enumerate(some)]
    assert {r[1] for r in rows} == {"plain", "psm", "spm"}


@pytest.mark.parametrize("lanes", [1, 3, 64, 8192])
def test_stretches_agree_with_one(monkeypatch, lanes):
    data = np.frombuffer(b"\xff" + b"\xff".join(t.encode() for t in texts(2, 400)), np.uint8)
    monkeypatch.setattr(middles, "LANES", 1)
    one = middles.Scanner().scan(data)
    monkeypatch.setattr(middles, "LANES", lanes)
    monkeypatch.setattr(middles, "LEAST", 5)
    assert (middles.Scanner().scan(data) == one).all()


def test_long_text_and_hidden_sentinel():
    text = ("wörter und 漢字 \n" * 200_000) + "<M>"
    ids = [i for i in range(50) if plainly(i, "x")[1] != "plain"][:2]
    rows = held(middles.transform(middles.Scanner(), ids, [text.encode(), text[:-3].encode()]))
    assert rows == [plainly(ids[0], text), plainly(ids[1], text[:-3])] and rows[0][1] == "plain" and rows[1][1] != "plain"


def test_awkward_rows(spark):
    rows = [(1, None), (2, ""), (3, " "), (4, "\n\n"), (None, "no id here"), (5, "<P>"), (6, "a"), (6, "a"), (6, "b c"), (7, "<S" + "x" * 100_000), (8, " lead"), (9, "trail "), (10, "<<P>")]
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], "doc_id long, text string, output string, form string")
    got = middles.fill_in_middle(docs)
    assert sorted(map(repr, (tuple(r) for r in got.collect()))) == sorted(repr((i, *plainly(i, t))) for i, t in rows)
    back = got.select("doc_id", middles.restored(got.output, got.form).alias("t"))
    assert sorted(map(repr, (tuple(r) for r in back.collect()))) == sorted(repr((i, t or "")) for i, t in rows)
    assert middles.fill_in_middle(docs.limit(0)).collect() == []


def test_parts_of_a_batch(spark, monkeypatch):
    monkeypatch.setattr(middles, "PART", 300)
    some = texts(3, 300)
    docs = spark.createDataFrame(list(enumerate(some)), "doc_id long, text string").coalesce(1)
    assert [len(some[s]) > 0 for s in middles._parts([t.encode() for t in some])] and sum(len(some[s]) for s in middles._parts([t.encode() for t in some])) == 300
    assert [tuple(r) for r in middles.fill_in_middle(docs).orderBy("doc_id").collect()] == [(i, *plainly(i, t)) for i, t in enumerate(some)]


def test_every_text_is_restored_from_its_output(spark):
    some = texts(4, 500)
    docs = spark.createDataFrame(list(enumerate(some)), "doc_id long, text string")
    got = middles.fill_in_middle(docs, seed=7, rate=100, suffix_first=50)
    back = got.select("doc_id", middles.restored(got.output, got.form).alias("t")).orderBy("doc_id").collect()
    assert [r.t for r in back] == some


def test_sentinels_are_checked(spark):
    docs = spark.createDataFrame([(1, "a b c d [pre] e")], "doc_id long, text string")
    for bad in (("<P>", "<P>", "<M>"), ("<P>", "<P>>", "<M>"), ("a b", "c", "d"), ("xy", "yz", "<M>"), ("é", "<S>", "<M>")):
        with pytest.raises(ValueError):
            middles.fill_in_middle(docs, sentinels=bad)
    assert middles.fill_in_middle(docs, rate=100, sentinels=("[pre]", "[suf]", "[mid]")).first().form == "plain"
    got = middles.fill_in_middle(docs, rate=100, sentinels=("[p]", "[s]", "[m]"))
    assert got.select(middles.restored(got.output, got.form, ("[p]", "[s]", "[m]"))).first()[0] == "a b c d [pre] e"


def test_bytes_that_are_no_utf8_dont_fail(spark):
    docs = spark.range(40).selectExpr("id as doc_id", "cast(X'61FF622063E46420F09F' as string) as text")
    rows = middles.fill_in_middle(docs).collect()
    assert len(rows) == 40 and {r.form for r in rows} == {"plain", "psm", "spm"}
