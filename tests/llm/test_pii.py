import hashlib
import random
import re
import time

import pyarrow as pa
import pytest

from cutgraph.llm.pii import added_spans, find_spans, joined, plain_form, query_pii, redact_pii, redacted, traced

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def passes(digits):
    odd, even = digits[::-1][::2], digits[::-1][1::2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def brute(text):
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    out = [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [("card", *m.span()) for m in CARD.finditer(text) if 13 <= len(digits(m)) <= 19 and passes(digits(m))]
    return out + [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(digits(m)) <= 15]


@pytest.mark.parametrize("seed", range(200))
def test_base_against_brute_force(seed):
    r = random.Random(seed)
    parts = ["a", "b@", "@", ".", "-", "x.com", " ", "1", "25", "255", "256", "007", "+1", "(", ")", "4111 1111 1111 1111", "4111111111111111", "é", "\n", "+49 30 1234567"]
    text = "".join(r.choice(parts) for _ in range(60))
    assert find_spans(text) == brute(text)


@pytest.mark.parametrize(
    ("text", "kind", "source"),
    [
        ("mail john (at) example (dot) com now", "email", "john (at) example (dot) com"),
        ("mail john at example dot com now", "email", "john at example dot com"),
        ("é jоhn@exаmple.com", "email", "jоhn@exаmple.com"),
        ("ｊｏｈｎ＠ｘ．ｃｏｍ!", "email", "ｊｏｈｎ＠ｘ．ｃｏｍ"),
        ("call plus four nine three zero one two three four five six seven ok", "phone", "plus four nine three zero one two three four five six seven"),
        ("card four one one one one one one one one one one one one one one one.", "card", "four one one one one one one one one one one one one one one one"),
        ("ip １２.3.4.5 end", "ip", "１２.3.4.5"),
        ("jo​hn@x.com", "email", "jo​hn@x.com"),
    ],
)
def test_disguises_map_back_to_source(text, kind, source):
    spans = find_spans(text) + added_spans(text, find_spans(text))
    assert (kind, text.index(source), text.index(source) + len(source)) in spans


def test_plain_prose_adds_nothing():
    for text in ("we met at noon and one or two went on", "look at the dot on it", "one two three", "Привет, как дела?", "version 1.2.3.4 at home"):
        assert added_spans(text, find_spans(text)) == []


def test_query(spark):
    rows = [(1, "a@b.co and 1.2.3.4"), (2, None), (3, ""), (3, "x at y dot org"), (None, "+1 (555) 123-4567"), (4, "9" * 50_000 + " a" * 50_000 + "a@" * 20_000)]
    out = query_pii(spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, spans string")).collect()
    assert len(out) == len(rows)
    first = next(r for r in out if r.doc_id == 1)
    assert first.spans == "email:0:6,ip:11:18" and first.base_sha256 == hashlib.sha256(first.spans.encode()).hexdigest() and (first.n_email, first.n_ip, first.n_card, first.n_phone) == (1, 1, 0, 0)
    empty = hashlib.sha256(b"").hexdigest()
    assert {(r.spans, r.base_sha256) for r in out if r.doc_id == 2} == {("", empty)}
    assert {(r.n_email, r.spans) for r in out if r.doc_id == 3} == {(0, ""), (0, "email:0:14")}


def test_redaction(spark):
    assert redacted("to a@b.co, +1 555 123 4567.") == "to <email>, <phone>."
    assert redacted(None) is None and redacted("") == ""
    rows = [(1, "a@b.co", "en", "s", 6), (2, None, None, None, None)]
    out = redact_pii(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")).orderBy("doc_id").collect()
    assert [tuple(r) for r in out] == [(1, "<email>", "en", "s", 7), (2, None, None, None, None)]
    assert joined([("ip", 1, 2)]) == "ip:1:2"


@pytest.mark.parametrize(
    ("text", "kind", "source"),
    [
        ("host 192 dot 168 dot 0 dot 1 is up", "ip", "192 dot 168 dot 0 dot 1"),
        ("host one nine two dot one six eight dot zero dot one is up", "ip", "one nine two dot one six eight dot zero dot one"),
        ("mail anna at firma dot se now", "email", "anna at firma dot se"),
        ("mail ivan at mail dot ru now", "email", "ivan at mail dot ru"),
        ("mail ann dot lee at firma dot pl now", "email", "ann dot lee at firma dot pl"),
        ("mail ann (at) firma dot museumx now", "email", "ann (at) firma dot museumx"),
        ("call +1 four one five 555 1234 now", "phone", "+1 four one five 555 1234"),
        ("call +1 (four one five) 555-1234 now", "phone", "+1 (four one five) 555-1234"),
        ("call plus 49 30 1234567 now", "phone", "plus 49 30 1234567"),
        ("card four one one one 1111 1111 1111 ok", "card", "four one one one 1111 1111 1111"),
        ("card 4111 1111 1111 one one one one ok", "card", "4111 1111 1111 one one one one"),
    ],
)
def test_mixed_disguises(text, kind, source):
    spans = find_spans(text) + added_spans(text, find_spans(text))
    assert (kind, text.index(source), text.index(source) + len(source)) in spans


def test_mixed_prose_adds_nothing():
    for text in ("look at the dot in it", "at 12 one of us left, 7 two", "one@x.com and 5 one two@x.com", "4. One two, 3 one 4", "9 one " * 20_000 + "9a"):
        assert [s for s in added_spans(text, find_spans(text)) if s[0] != "card"] == []


def test_octets_of_any_length():
    assert find_spans("0" * 5000 + ".1.1.1") == [("ip", 0, 5006)] and find_spans("0" * 5000 + "256.1.1.1") == []
    assert find_spans("9" * 5000 + ".1.1.1") == []


@pytest.mark.parametrize("run", ["null drei null eins zwei drei vier fünf sechs", "zéro un deux trois quatre cinq six sept huit neuf", "cero uno dos tres cuatro cinco seis siete ocho"])
def test_digit_words_of_the_languages(run):
    text = f"tel plus vier {run} ok"
    assert added_spans(text, []) == [("phone", 4, len(text) - 3)]


@pytest.mark.parametrize("seed", range(50))
def test_planted_disguises_against_the_plain_text(seed):
    """A plain text and its disguise hold the same identifiers, and disguised spans map back to what was planted."""
    r = random.Random(seed)
    words = {"0": "zero", "1": "one", "2": "two", "3": "three", "4": "four", "5": "five", "6": "six", "7": "seven", "8": "eight", "9": "nine"}
    spell = lambda digits: " ".join(words[d] if d in words else d for d in digits)
    alike = {"a": "а", "e": "е", "o": "о", "c": "с", "p": "р"}
    text, want = "", []
    for _ in range(r.randint(1, 6)):
        kind = r.choice(["email", "phone", "ip"])
        if kind == "email":
            user, host = "".join(r.choice("aeocpmnr") for _ in range(6)), "".join(r.choice("aeocpmnr") for _ in range(6))
            hidden = r.choice([f"{user} (at) {host} (dot) com", f"{user} at {host} dot org", "".join(alike.get(c, c) for c in f"a{user}") + f"@{host}.de", f"{user}[at]{host}[dot]co[dot]uk"])
        elif kind == "phone":
            hidden = "plus " + spell([str(r.randint(1, 9)) for _ in range(r.randint(9, 12))])
        else:
            hidden = " dot ".join(str(r.randint(0, 255)) for _ in range(4))
        text += r.choice(["We said ", "Here it is, ", "Ok; "])
        want.append((kind, len(text), len(text) + len(hidden)))
        text += hidden + r.choice([" then.\n", ", yes; ", "\n\n"])
    assert sorted(added_spans(text, find_spans(text))) == sorted(want)


def test_the_quick_trace_misses_no_disguise():
    r = random.Random(12)
    parts = ["one", "ONE", "fünf", "Zéro", "un", "siete", "x", "é", " ", " ", "-", ", ", ".", "7", "12", "plus ", "Plus", "(at)", "[DOT]", " dot ", "\tDOT\t", "<@>", "{.}", "а", "Ｋ", "\u200b", "\u00ad", "ſix", "\n", "one", "@"]
    texts = ["".join(r.choice(parts[:22]) if r.random() < 0.97 else r.choice(parts) for _ in range(r.randint(1, 12))) for _ in range(20_000)]
    hidden = [plain_form(t) is not None for t in texts]
    assert not [t for t, a, b in zip(texts, hidden, traced(pa.array(texts)), strict=True) if a and not b]
    assert 2000 < sum(hidden) < 18_000


def test_many_identifiers_and_one_disguise():
    text = "".join(f"user{i}@mail{i % 97}.example.org 10.0.{i % 200}.7\n" for i in range(50_000)) + "joe (at) home (dot) com"
    began = time.monotonic()
    base = find_spans(text)
    added = added_spans(text, base)
    assert len(base) == 100_000 and [text[a:b] for _, a, b in added] == ["joe (at) home (dot) com"] and time.monotonic() - began < 30


@pytest.mark.parametrize("seed", range(60))
def test_added_spans_against_a_search_of_all_base_spans(seed):
    """Plain and disguised identifiers side by side: those that a base span of their kind holds, or that were never disguised, aren't added."""
    r = random.Random(seed)
    parts = ["joe@a.com", "joe (at) a.com", "x@b dot com", "10.0.0.1", "10.0.0 dot 1", "+1 234 567 890", "plus 1 234 567 890", "1 2 three 4", "4111 1111 1111 1111", "four 111 1111 1111 1111", " ", "\n", "word", "аdam@c.org"]
    text = " ".join(r.choice(parts) for _ in range(25))
    base, p = find_spans(text), plain_form(text)
    told = []
    for kind, a, b in find_spans(p.text) if p else []:
        start, end = p.starts[a], p.ends[b - 1]
        if text[start:end] != p.text[a:b] and not any(k == kind and s <= start and end <= e for k, s, e in base):
            told.append((kind, start, end))
    assert added_spans(text, base) == told


def test_empty_table_and_other_columns(spark):
    docs = spark.createDataFrame([(1, "a@b.com", 5, "x")], "doc_id long, text string, n_email int, spans string")
    assert query_pii(docs).first()["spans"] == "email:0:7" and query_pii(docs.limit(0)).collect() == [] and redact_pii(docs.limit(0)).collect() == []
