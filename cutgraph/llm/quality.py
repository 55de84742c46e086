"""Quality rules with risk-controlled thresholds.

Each text gets counts over all of its words. Labelled documents that pass the base rules then set, per stratum
and rule, a cutoff whose share of wrongly rejected good documents is proven small: an exact binomial
(Clopper-Pearson) upper bound must lie under the rule's part of the risk. Cutoffs of one rule are tested
from the laxest on and the first failure ends the test (fixed sequence, no correction needed within a rule); strata
and rules share the error probability (Bonferroni). Of the proven cutoffs that one is taken that is worth most:
labelled bad documents rejected, less GOOD_WEIGHT times good ones; none, if none is worth anything.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_SYMBOLS = bytes.maketrans(b"", b""), b"#*$%&|<>"
#: Rules: name, numerator, denominator, whether large values are bad. In per mille.
RULES = (
    ("symbols", "n_symbols", "word_chars", True),
    ("repeats", "n_repeat_words", "n_words", True),
    ("dup_lines", "n_dup_lines", "n_words", True),
    ("long_words", "word_chars", "n_words", True),
    ("short_words", "word_chars", "n_words", False),
)
#: Bad documents that a good one is worth when cutoffs are compared.
GOOD_WEIGHT = 10
#: Cutoffs tried per rule: steps of the scale below, laxest first.
STEPS = 40


def text_counts(text: bytes | None) -> tuple[int, int, int, int, int]:
    """COUNTS of a UTF-8 text; zeros for null."""
    if not text:
        return 0, 0, 0, 0, 0
    words = text.split()
    n = len(words)
    symbols = len(text) - len(text.translate(None, _SYMBOLS[1]))
    joined = b"".join(words)
    chars = len(joined.decode("utf-8"))
    seen: set[bytes] = set()
    dup = 0
    for line in text.split(b"\n"):
        if line in seen:
            dup += 1
        elif line.strip():
            seen.add(line)
    repeat = 0
    if n > 3:
        ids: dict[bytes, int] = {}
        code = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, n)
        pair = code[:-1] * len(ids) + code[1:]
        if len(ids) > 2_000_000:  # three codes no longer fit 63 bits
            pair = np.unique(pair, return_inverse=True)[1]
        _, at, times = np.unique(pair[:-1] * len(ids) + code[2:], return_inverse=True, return_counts=True)
        often = times[at] > 1
        inside = np.zeros(n, bool)
        inside[:-2] |= often
        inside[1:-1] |= often
        inside[2:] |= often
        repeat = int(inside.sum())
    return n, chars, symbols, dup, repeat


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = np.array([text_counts(t.as_py()) for t in b.column(2)], np.int64).reshape(-1, len(COUNTS))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(rows[:, i]) for i in range(len(COUNTS)))], ["doc_id", "stratum", *COUNTS])


def document_counts(docs: DataFrame) -> DataFrame:
    """(doc_id, stratum, COUNTS) of every row; the stratum is lang, or '' for null."""
    return docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("stratum"), F.col("text").cast("binary").alias("text")).mapInArrow(_counted, "doc_id long, stratum string, " + ", ".join(f"{c} long" for c in COUNTS))


def _beta(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta function, by its continued fraction (modified Lentz method)."""
    if x <= 0.0 or x >= 1.0:
        return float(x >= 1.0)
    if x > (a + 1) / (a + b + 2):
        return 1.0 - _beta(1.0 - x, b, a)
    tiny = 1e-300
    c, d = 1.0, 1.0 / max(1.0 - (a + b) * x / (a + 1), tiny)
    whole, m, change = d, 0, 0.0
    while abs(change - 1.0) > 1e-15 and m < 1_000_000:
        m += 1
        for term in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 / (1.0 + term * d or tiny)
            c = 1.0 + term / c or tiny
            change = c * d
            whole *= change
    return whole * math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a


def upper_bound(failures: int, n: int, delta: float) -> float:
    """Clopper-Pearson: the largest rate at which ``failures`` or fewer of n have probability delta."""
    if n == 0 or failures >= n:
        return 1.0
    low, high = failures / n, 1.0
    for _ in range(60):
        mid = (low + high) / 2
        if _beta(1.0 - mid, n - failures, failures + 1) <= delta:
            high = mid
        else:
            low = mid
    return high


def choose_cutoffs(good: dict[tuple[str, str], list[int]], bad: dict[tuple[str, str], list[int]], total: dict[str, int], risk: float, delta: float) -> dict[tuple[str, str], int]:
    """Number of the chosen cutoff per (stratum, rule); absent where none is proven and worth anything.

    ``good[s, r][i]`` and ``bad[s, r][i]``: labelled documents of the stratum that cutoff i of the rule would
    reject; ``total[s]``: good ones of the stratum. Of cutoffs worth the same the laxest is taken.
    """
    part = delta / (len(RULES) * max(1, len(total)))
    chosen = {}
    for key, lost in good.items():
        n, best = total.get(key[0], 0), 0
        for i, k in enumerate(lost):
            if k > n * risk / len(RULES) or upper_bound(k, n, part) > risk / len(RULES):
                break
            worth = bad[key][i] - GOOD_WEIGHT * k
            if worth > best:
                best, chosen[key] = worth, i
    return chosen


def _step(num: str, den: str, high: bool) -> Column:
    """How many of the cutoffs, laxest last, reject a row: integer arithmetic, 0 to STEPS.

    Shares run from 1 down to 1/STEPS; mean word lengths from 30 characters down to 10.5 (high), or
    from a quarter up to 5 (low).
    """
    a, b = F.col(num), F.greatest(F.col(den), F.lit(1))
    if num == "word_chars":
        return F.least(F.lit(STEPS), F.greatest(F.lit(0), F.floor(2 * a / b) - STEPS // 2)) if high else F.least(F.lit(STEPS), F.greatest(F.lit(0), STEPS // 2 - F.floor(4 * a / b)))
    return F.least(F.lit(STEPS), F.floor(F.lit(STEPS) * a / b))


def quality_rules(spark: SparkSession, docs: DataFrame, labels: DataFrame, risk: float = 0.05, delta: float = 0.05) -> DataFrame:
    """Counts and verdict of every document.

    Each value of lang is a stratum, null is one. Null text counts as empty; labels of unknown documents,
    with null doc_id or null quality are ignored; a repeated label counts once, good winning. Without
    labels no rule rejects beyond the base. Repeated rows each give a row. Other columns are not read.

    A stratum in which even no failure among all of its good labels would prove anything gets no cutoff and isn't
    counted as a test. So a table of 2 x rules x (STEPS + 1) rows for each 458 good labels (at the default risk) is
    the most that reaches the driver, and that only if each language has so few.
    """
    counts = Scratch(spark, "quality").save(document_counts(docs))
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    known = labels.filter("doc_id is not null and quality is not null").groupBy(F.col("doc_id").alias("_id")).agg((F.max("quality") == 1).alias("good"))
    held = counts.filter(~base).join(known, F.col("doc_id") == F.col("_id"))
    steps = F.array(*(F.struct(F.lit(name).alias("rule"), _step(n, d, high).cast("long").alias("step")) for name, n, d, high in RULES))
    cells = held.select("stratum", "good", F.explode(steps).alias("s")).groupBy("stratum", "good", "s.rule", "s.step").count()
    least = math.log(delta / len(RULES)) / math.log1p(-risk / len(RULES))
    size = F.sum(F.when(F.col("good") & (F.col("rule") == RULES[0][0]), F.col("count")).otherwise(0)).over(Window.partitionBy("stratum"))
    table = cells.withColumn("size", size).filter(F.col("size") >= least).drop("size").collect()
    total: dict[str, int] = {}
    rejected: dict[bool, dict[tuple[str, str], list[int]]] = {True: {}, False: {}}
    for stratum, good, rule, step, n in table:
        total[stratum] = total.get(stratum, 0) + (n if good and rule == RULES[0][0] else 0)
        for kind in (True, False):
            rejected[kind].setdefault((stratum, rule), [0] * STEPS)
        # cutoff i rejects rows whose step is at least STEPS - i
        for i in range(max(0, STEPS - step), STEPS):
            rejected[good][stratum, rule][i] += n
    chosen = choose_cutoffs(rejected[True], rejected[False], total, risk, delta)
    bad = F.lit(False)
    for name, num, den, high in RULES:
        if cut := {stratum: STEPS - i for (stratum, rule), i in chosen.items() if rule == name}:
            from_step = F.create_map(*(F.lit(x) for pair in sorted(cut.items()) for x in pair))[F.col("stratum")]
            bad |= F.coalesce(_step(num, den, high) >= from_step, F.lit(False))
    return counts.select("doc_id", *COUNTS, base.alias("base_failed"), (~base & ~bad).alias("kept"))
