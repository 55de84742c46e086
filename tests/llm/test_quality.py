import random
from collections import Counter

import pytest

from cutgraph.llm.quality import COUNTS, RULES, STEPS, choose_cutoffs, quality_rules, text_counts, upper_bound

DOCS = "doc_id long, text string, lang string, n_words string"
LABELS = "doc_id long, quality int, toxic int"


def brute(text):
    text = text or ""
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", text) if w]
    lines, seen, dup = text.split("\n"), set(), 0
    for line in lines:
        if line.strip(" \t\n\x0b\x0c\r"):
            dup += line in seen
            seen.add(line)
    grams = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {i + j for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for j in range(3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


@pytest.mark.parametrize("seed", range(30))
def test_counts_against_brute_force(seed):
    r = random.Random(seed)
    text = "".join(r.choice(["a", "b", "é", "#", " ", " ", "\n", "\n", "\t", "\x85", "\xa0", "\x1c", "ñ|"]) for _ in range(r.randint(0, 400)))
    assert text_counts(text.encode()) == brute(text)


def test_counts_of_null_and_long():
    assert text_counts(None) == text_counts(b"") == (0, 0, 0, 0, 0)
    assert text_counts(b"a b c " * 100_000) == (300_000, 300_000, 0, 0, 300_000)


def test_bound_is_exact():
    assert upper_bound(0, 0, 0.05) == upper_bound(3, 3, 0.05) == 1.0
    for k, n in ((0, 100), (3, 50), (10, 400)):
        p = upper_bound(k, n, 0.05)
        tail = sum(__import__("math").comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
        assert abs(tail - 0.05) < 1e-9


def test_cutoffs_stop_at_the_first_failure():
    key = ("en", "symbols")
    lost, rising = [0] * 10 + [500] + [0] * (STEPS - 11), list(range(STEPS))
    assert choose_cutoffs({key: lost}, {key: rising}, {"en": 10_000}, 0.01, 0.05) == {key: 9}
    assert choose_cutoffs({key: [0] * STEPS}, {key: [5] * STEPS}, {"en": 10_000}, 0.01, 0.05) == {key: 0}
    assert choose_cutoffs({key: [0] * STEPS}, {key: [0] * STEPS}, {"en": 10_000}, 0.01, 0.05) == {}
    assert choose_cutoffs({key: [0] * STEPS}, {key: rising}, {"en": 20}, 0.01, 0.05) == {}
    assert choose_cutoffs({key: [0, 0, 1, 1] + [1] * (STEPS - 4)}, {key: [0, 4, 13, 14] + [15] * (STEPS - 4)}, {"en": 100_000}, 0.01, 0.05) == {key: 4}


def test_false_rejection_is_limited():
    """Whatever the labels, a fresh sample of the same kind loses no more than the risk."""
    for seed in range(20):
        r = random.Random(seed)
        draw = lambda n: Counter(min(STEPS, int(r.expovariate(0.5))) for _ in range(n))
        cells = lambda c: [sum(v for s, v in c.items() if s >= STEPS - i) for i in range(STEPS)]
        key = ("en", "symbols")
        chosen = choose_cutoffs({key: cells(draw(4000))}, {key: list(range(0, 100 * STEPS, 100))}, {"en": 4000}, 0.05, 0.05)
        assert cells(draw(20_000))[chosen[key]] <= 20_000 * 0.05 / len(RULES) * 1.1


def test_rules_reject_junk_and_keep_good(spark):
    good = " ".join(f"word{i}" for i in range(60))
    junk = " ".join(f"w{i}###$$$" for i in range(60))
    rows = [(i, good + f" x{i}", "en") for i in range(6000)] + [(10_000 + i, junk, "en") for i in range(20)]
    rows += [(20_000, None, None), (20_001, "", "xx"), (20_002, good, None), (None, good, "en"), (20_003, "a " * 60, "fr"), (1, good, "en")]
    docs = spark.createDataFrame([(*r, "clash") for r in rows], DOCS)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(6000)] + [(10_000 + i, 0, 0) for i in range(15)] + [(None, 1, 0), (20_003, None, 0), (99_999, 1, 0)], LABELS)
    out = quality_rules(spark, docs, labels).collect()
    assert len(out) == len(rows)
    kept = Counter((r.doc_id is not None and 10_000 <= r.doc_id < 10_020, r.kept) for r in out)
    assert kept[True, True] == 0 and kept[False, True] == 6000 + 3
    by = {r.doc_id: r for r in out}
    assert by[20_000].base_failed and by[20_003].base_failed and by[20_003].n_repeat_words == 60
    assert all(list(r[c] for c in COUNTS) == list(brute(t)) for r, t in ((by[10_000], junk), (by[20_002], good)))


def test_without_labels_or_rows(spark):
    docs = spark.createDataFrame([(1, "#$ " * 60 + "a b c d", "en", "")], DOCS)
    none = spark.createDataFrame([], LABELS)
    assert [r.kept for r in quality_rules(spark, docs, none).collect()] == [False]  # repeats fail the base
    assert quality_rules(spark, docs.limit(0), none).collect() == []
    assert len(RULES) == 5


def test_bound_of_large_counts_is_quick():
    import time

    began = time.time()
    for k, n in ((10**6, 10**8), (5 * 10**5, 10**6), (0, 10**9), (10**8 - 1, 10**8)):
        p = upper_bound(k, n, 1e-4)
        # normal approximation, of a relative 1e-2 at these sizes
        if 1000 < k < n - 1000:
            assert abs(p - k / n - 3.719 * (k / n * (1 - k / n) / n) ** 0.5) < 1e-2 * (p - k / n) + 1e-9
    assert time.time() - began < 5


def test_verdict_against_brute_force(spark):
    """Cutoffs looked for one by one from every labelled document's own shares, in three languages of their own strata."""
    import math

    r = random.Random(11)
    rows, labels = [], []
    for i in range(9000):
        lang = ("fi", "fi", None, "tlh" if i % 30 == 0 else "sv")[i % 4]
        good = r.random() < 0.8
        mark = ("#" * r.choice([0, 0, 0, 0, 1]) if good else "#" * r.choice([0, 1, 3, 9])) if lang != "sv" else "###"
        rows.append((i, " ".join(f"w{r.randint(0, 10**6)}{mark}{'x' * (r.choice([0, 20, 40]) if not good and lang is None else 0)}" for _ in range(r.choice([50, 60, 80]))), lang))
        if i % 10:
            labels.append((i, int(good), 0))
    out = {x.doc_id: x for x in quality_rules(spark, spark.createDataFrame([(*x, "") for x in rows], DOCS), spark.createDataFrame(labels, LABELS)).collect()}
    count = {i: brute(t) for i, t, _ in rows}
    lang = {i: k for i, _, k in rows}
    quality = {i: q for i, q, _ in labels}

    def step(i, rule):
        words, chars, symbols, dup, repeat = count[i]
        if rule == "long_words":
            return min(STEPS, max(0, 2 * chars // max(1, words) - 20))
        if rule == "short_words":
            return min(STEPS, max(0, 20 - 4 * chars // max(1, words)))
        a, b = {"symbols": (symbols, chars), "repeats": (repeat, words), "dup_lines": (dup, words)}[rule]
        return min(STEPS, STEPS * a // max(1, b))

    passed = [i for i in count if count[i][0] >= 50 and 2 * count[i][4] <= count[i][0]]
    strata = [k for k in set(lang.values()) if sum(lang[i] == k and quality.get(i) == 1 for i in passed) >= math.log(0.01) / math.log(0.99)]
    assert set(strata) == {"fi", "sv", None}
    want = dict.fromkeys(passed, True)
    for k in strata:
        good, bad = ([i for i in passed if lang[i] == k and quality.get(i) == q] for q in (1, 0))
        for rule, *_ in RULES:
            best, cut = 0, None
            for at in range(STEPS, 0, -1):
                lost = sum(step(i, rule) >= at for i in good)
                # exact tail at the risk itself: below the corrected error, or the search ends
                tail = sum(math.comb(len(good), j) * 0.01**j * 0.99 ** (len(good) - j) for j in range(lost + 1)) if lost < 200 else 1
                if tail > 0.05 / (5 * len(strata)):
                    break
                worth = sum(step(i, rule) >= at for i in bad) - 10 * lost
                if worth > best:
                    best, cut = worth, at
            for i in passed:
                if lang[i] == k and cut is not None and step(i, rule) >= cut:
                    want[i] = False
    assert {i: out[i].kept for i in passed} == want and 500 < sum(not x for x in want.values()) < 2500
    assert all(not out[i].kept for i in count if i not in want)
