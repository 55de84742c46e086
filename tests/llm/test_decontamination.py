import random
import re
import time

import pytest
import regex

from cutgraph.llm import decontamination
from cutgraph.llm.decontamination import UNITS, benchmark_leaks, decontaminated

ITEM = "A farmer has 12 apples and gives 5 apples to his neighbour, then the farmer buys 12 kg of flour. How many apples are left?"


def leaks(spark, docs, items=((7, ITEM),)):
    d = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, item_id string")
    b = spark.createDataFrame(list(items), "item_id long, text string")
    return {(r.doc_id, r.item_id): r.reparameterised for r in benchmark_leaks(d, b).collect()}, d, b


def test_exact_and_reparameterised(spark):
    other = ITEM.replace("12", "30").replace("5", "9").replace("kg", "lbs")
    broken = ITEM.replace("has 12", "has 30").replace("5 apples to", "6 apples to")
    docs = [(1, "Before that. " + ITEM + " And after."), (2, "So it goes on: " + other + " End."), (3, "Nothing of it is here at all, 12 apples aside."), (4, None), (5, ""), (6, "few words"), (None, ITEM), (8, broken), (1, "Another row of one.")]
    found, d, b = leaks(spark, docs)
    assert found[1, 7] is False and found[2, 7] is True
    assert (8, 7) not in found  # 12 would stand for 30 and 12 at once
    assert {i for i, _ in found} == {1, 2}
    assert sorted(r.doc_id for r in decontaminated(d, b).collect() if r.doc_id is not None) == [3, 4, 5, 6, 8]


def test_share_of_windows(spark):
    words = [f"w{chr(97 + i)}" for i in range(24)]  # 20 windows
    found, *_ = leaks(spark, [(1, " ".join(words[:20])), (2, " ".join(words[:19])), (3, " ".join(words) + " " + " ".join(words))], [(1, " ".join(words)), (1, " ".join(words)), (2, None), (None, "a b c d e f"), (3, "a b")])
    assert set(found) == {(1, 1), (3, 1)}


def test_empty_tables(spark):
    assert leaks(spark, [])[0] == {}
    assert leaks(spark, [(1, ITEM)], [(None, None)])[0] == {}


def test_slot_dense_and_short_items(spark):
    items = [(1, "Add 12 7 33 45"), (2, "Order 3, 9, 14, 2, 8, 21, 5"), (3, "Name four primes."), (4, "3 9 14 2 8 21 5")]
    docs = [(1, "So: Add 12 7 33 45 now."), (2, "Please order 3, 9, 14, 2, 8, 21, 5 at once."), (3, "He said: name four primes, and left."), (4, "Order 1, 2, 4, 6, 9, 20, 7 of them."), (5, "Table: 1 2 3 4 5 6 7 8 9"), (6, "Name five primes."), (7, "Add 1 2 3 4")]
    found, *_ = leaks(spark, docs, items)
    assert found == {(1, 1): False, (2, 2): False, (2, 4): False, (3, 3): False, (4, 2): True, (7, 1): True}


def test_what_stands_before_an_item(spark):
    items = [(1, "What is the capital of France?"), (2, "A farmer sold seven brown cows"), (3, "Anna took the early train home")]
    docs = [(1, "Quiz night\nWhat is the capital of France?"), (2, "He asked what is the capital of France"), (3, "Problem 12\nA farmer sold seven brown cows"), (4, "Well. Ben took the early train home"), (5, "\"What is the capital of France?\"")]
    found, *_ = leaks(spark, docs, items)
    assert found == {(1, 1): False, (2, 1): False, (3, 2): False, (4, 3): True, (5, 1): False}


def _plain(text):
    return re.sub(r"[ \t-\r]+", " ", text).strip(" ")


def _bare(text):
    return regex.sub(r"""[.,;:!?"'()\[\]]+(?= |$)|(?<= |^)["'(\[]+""", "", text)


def _template(plain):
    text = regex.sub(r"\p{Lu}(?<=[^.!?:; ] .)[\p{Ll}'-]+", "<name>", plain)
    text = re.sub(r"[0-9]+(?:[.,:/][0-9]+)*", "<num>", text)
    return _bare(regex.sub(rf"(?<=<num> )(?i:{'|'.join(UNITS)})(?![\p{{L}}\p{{N}}])", "<unit>", text)).lower().split(" ")


def brute(docs, items, percent=80):
    """{(doc_id, item_id): reparameterised}, each window of each item held against each window of each text."""

    def windows(text):
        plain = _plain(text)
        raw, tokens = plain.split(" "), _template(plain)
        for i in range(len(raw) - 4):
            yield i, raw[i : i + 5], tokens[i : i + 5]

    value = lambda r: r.rstrip(".,;:!?\"'()[]").lstrip("\"'([")
    is_name = lambda r: regex.match(r"""["'(\[]*\p{Lu}[\p{Ll}'-]+""", r)
    slots = {"<num>", "<name>", "<unit>"}
    found = {}
    for d, text in docs:
        if d is None or text is None:
            continue
        of_doc = []
        for i, raw, tokens in windows(text):
            own = _bare(" ".join(raw)).lower()
            of_doc.append((i, raw, tokens, own, False))
            if is_name(raw[0]) and "<name>" not in tokens[0]:
                named = _bare(regex.sub(r"""^["'(\[]*\p{Lu}[\p{Ll}'-]+""", "<name>", raw[0])).lower()
                of_doc.append((i, raw, [named, *tokens[1:]], None, True))
        for item, question in items:
            if item is None or question is None or not _plain(question):
                continue
            few = _bare(_plain(question)).lower().split(" ")
            if len(few) < 5:
                all_tokens = _bare(_plain(text)).lower().split(" ")
                if any(all_tokens[i : i + len(few)] == few for i in range(len(all_tokens))):
                    found[d, item] = min(found.get((d, item), True), False)
                continue
            firsts = {_template(before + _plain(question))[1] for before in ("x ", "0 ")}
            by_shift, literal = {}, set()
            for j, raw, tokens in windows(question):
                for first in {tokens[0], *(firsts if j == 0 else ())}:
                    form = [first, *tokens[1:]]
                    only = set(form) <= slots
                    literal |= {j} - ({j} if only else set())
                    for i, other, theirs, own, soft in of_doc:
                        if (own == _bare(" ".join(raw)).lower() and set(theirs) <= slots) if only else (theirs == form and not (set(theirs) <= slots and not soft)):
                            pairs = [(k, value(a), value(b)) for k, a, b in zip(form, raw, other, strict=True) if k in slots]
                            by_shift.setdefault(i - j, []).append((j, soft or first != tokens[0], pairs))
            matched = {}
            for hits in by_shift.values():
                firm = {s for _, soft, pairs in hits if not soft for s in pairs}
                every = {s for _, _, pairs in hits for s in pairs}
                for j, soft, pairs in hits:
                    if not any(k == k2 and a == a2 and b != b2 for k, a, b in pairs for k2, a2, b2 in (every if soft else firm)):
                        matched[j] = min(matched.get(j, True), any(a != b for _, a, b in pairs))
            n = len(few) - 4
            if matched and (100 * len(matched) >= percent * n or literal and 100 * len(literal & set(matched)) >= percent * len(literal)):
                found[d, item] = max(matched.values())
    return found


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("broadcast", [0, 200_000])
def test_against_brute_force(spark, monkeypatch, seed, broadcast):
    monkeypatch.setattr(decontamination, "BROADCAST_WINDOWS", broadcast)
    r = random.Random(seed)
    words = ["Anna", "Ben", "has", "12", "7", "3.5", "km", "apples", "(so", "what?", "The", "left.", "buys", "kg", "and", "\"Ben", "of", "paid", "\n", "many"]
    items = [(i, " ".join(r.choice(words) for _ in range(r.randint(1, 14)))) for i in range(25)] + [(30, None), (None, "a b c d e f")]
    swap = {"12": "31", "7": "9", "Anna": "Carla", "km": "miles", "Ben": "Dan"}
    docs = []
    for i in range(120):
        parts = [r.choice(words) for _ in range(r.randint(0, 6))]
        for _, text in r.sample(items[:25], r.randint(0, 2)):
            tokens = text.split(" ")
            change = r.random()
            if change < 0.4:
                tokens = [swap.get(t, t) for t in tokens]
            elif change < 0.6 and len(tokens) > 2:
                tokens[r.randrange(len(tokens))] = r.choice(words)
            parts += tokens + [r.choice(words) for _ in range(r.randint(0, 4))]
        docs.append((i, " ".join(parts)))
    docs += [(200, None), (201, ""), (None, items[0][1])]
    found, *_ = leaks(spark, docs, items)
    assert found == brute(docs, items) and len(found) > 60 and any(found.values()) and not all(found.values())


def test_long_text_repeated_ids_and_clashing_columns(spark, monkeypatch):
    monkeypatch.setattr(decontamination, "BROADCAST_WINDOWS", 0)
    long = " ".join(f"w{i % 977}" for i in range(20_000)) + " " + ITEM
    other = ITEM.replace("12", "30")
    found, d, b = leaks(spark, [(1, long), (2, ITEM), (2, other.replace("5", "8")), (2, "12 99"), (3, other), (3, ITEM)], [(7, ITEM), (7, "seven plain words that nobody ever wrote")])
    assert found == {(1, 7): False, (2, 7): False, (3, 7): False}
    clash = d.selectExpr("*", "1 as _leak", "2 as item_text", "3 as doc_text", "4 as h", "5 as pos", "6 as leaks")
    assert decontaminated(clash, b.selectExpr("*", "1 as h", "2 as n")).count() == 0
    assert decontaminated(clash, b.limit(0)).columns == clash.columns


def test_a_long_item_that_is_dense_with_slots(spark):
    name = lambda i: "w" + "".join(chr(97 + i // 26**k % 26) for k in range(3))
    item = " ".join(name(i) if i % 2 else str(i) for i in range(10_000))
    other = " ".join(name(i) if i % 2 else str(3 * i + 1) for i in range(10_000))
    began = time.monotonic()
    found, *_ = leaks(spark, [(1, item), (2, other), (3, " ".join(item.split(" ")[:7000]))], [(7, item)])
    assert found == {(1, 7): False, (2, 7): True} and time.monotonic() - began < 60
