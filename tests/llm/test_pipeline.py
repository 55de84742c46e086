import hashlib
import math
import random
import re
import zlib
from collections import Counter

import corpus_pipeline

from .test_decontamination import brute as of_windows
from .test_language import phrases
from .test_neardup import brute as of_pairs
from .test_packing import brute as of_bins


def test_stages_take_effect(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, before = docs.columns, docs.count()
    kept = [before]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
        assert docs.columns == columns, name
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        kept.append(docs.count())
    assert kept[1] <= kept[0] and kept[2] < kept[1] and kept[3] < kept[2] and kept[4] == kept[3]
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    words = {r.doc_id: len((r.text or "").encode().split()) for r in docs.collect()}
    got: dict[int, int] = {}
    for r in packed.collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + r.n_words
    assert got == words


def test_run_gives_the_same_rows_each_time(spark, sf_dir):
    first, again = (sorted(map(tuple, corpus_pipeline.run(spark, sf_dir).collect())) for _ in range(2))
    assert first == again and first


def test_stages_on_awkward_tables(spark, sf_dir):
    """Nulls, repeated rows, empty and long texts and clashing columns go through every stage; so does an empty table."""
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    text = "Plain words of a clean document that nobody else has written so far, number {0}. " * 3
    rows = [(i, text.format(i) + " ".join(f"w{i}x{j}" for j in range(30)), "en", f"s{i % 3}", None) for i in range(30)]
    rows += [(100, None, None, None, None), (101, "", "en", None, None), (None, "Some text without an id that is read as it is.", "en", None, 7), (None, "Some text without an id that is read as it is.", "en", None, 7), (102, "mail a@b.co " + "long " * 60_000, "en", "s", 1)]
    rows += [rows[3], rows[3], (103, rows[4][1], None, "s9", None)]
    docs = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], schema + ", bin int, item_id int, component_id int")
    more = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(0), sf_dir).collect() == []
        docs = stage(spark, docs, sf_dir)
        assert docs.columns == more, name
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        ids = [r.doc_id for r in docs.collect()]
        assert 102 in ids and None in ids and set(range(3)) <= set(ids) and 100 not in ids and 101 not in ids
    assert 103 not in ids and 4 in ids
    assert next(r.text for r in docs.collect() if r.doc_id == 102).startswith("mail <email> long")
    assert sum(r.n_words for r in corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()) == sum(len(r.text.split()) for r in docs.collect())


def test_run_against_brute_force(spark, tmp_path):
    """All five stages done plainly: substring parses, all pairs, all windows, one bin search over every bin."""
    r = random.Random(7)
    letters = {"en": "abcdefghij", "fi": "fghijklmno"}
    words = {k: ["".join(r.choice(v) for _ in range(r.randint(2, 6))) for _ in range(150)] for k, v in letters.items()}
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 4 == 2]
    free = [i for i in range(400) if i not in held]
    train = {k: " ".join(r.choice(words[k]) for _ in range(1500)) for k in letters}
    items = [(j, " ".join(r.choice(words["en"]) for _ in range(12)) + f" {j} kg?") for j in range(4)]
    rows = [(free[0], train["en"], "en", "t"), (free[1], train["fi"], "fi", "t")]
    for i in range(60):
        k = r.choice(list(letters))
        body = [r.choice(words[k]) for _ in range(r.choice([8, 40, 90, 300]))]
        if i % 9 == 0:
            body[3:3] = r.choice(items)[1].replace(" kg", " cm" if i % 2 else " kg").split()
        if i % 7 == 0:
            body.insert(5, "ann (at) example dot com")
        rows.append((free[2 + i], " ".join(body), None, f"s{i % 4}"))
        if i % 4 == 0:
            copy = list(body)
            copy[-1] = "zz" if i % 8 else copy[-1]
            rows.append((free[100 + i], " ".join(copy), None, "s9"))
    rows += [(free[200], None, None, "s"), (free[201], "12 34", None, "s"), (free[202], "", "en", "s")]
    at = str(tmp_path)
    spark.createDataFrame([(*x, None) for x in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")

    def encoded(text):
        return re.sub(r"[\W\d_]+", " ", text.lower())

    symbols = 3 + len({c for t in train.values() for c in t if c.isalpha()})
    docs = []
    for i, text, _, source in rows:
        if text and re.search(r"[^\W\d_]", text):
            bits = {k: phrases(encoded(text), encoded(t)) * math.log2(len(encoded(t)) + symbols) for k, t in train.items()}
            docs.append((i, text, min(sorted(bits), key=bits.get), source))
    one = of_pairs([(i, t) for i, t, *_ in docs], 5)
    docs = [d for d in docs if one[d[0]][1] == d[0]]
    leaks = {d for d, _ in of_windows([(i, t) for i, t, *_ in docs], items)}
    docs = [d for d in docs if d[0] not in leaks]
    docs = [(i, t.replace("ann (at) example dot com", "<email>"), k, s) for i, t, k, s in docs]
    pieces = []
    for i, t, _, s in sorted(docs):
        n = len(t.split())
        cluster = hashlib.md5(" ".join(t.split()).lower().encode()).hexdigest()
        pieces += [(i, p, 2048 * p, min(2048, n - 2048 * p), s, cluster) for p in range(-(-n // 2048))]
    bins = of_bins([(n, s, c) for _, _, _, n, s, c in pieces], 2048)
    filled = Counter()
    for b, x in zip(bins, pieces, strict=True):
        filled[b] += x[3]
    want = sorted((*x, f"0-{b}", filled[b]) for b, x in zip(bins, pieces, strict=True))
    got = corpus_pipeline.run(spark, at)
    assert got.columns == ["doc_id", "piece", "first_word", "n_words", "source", "cluster", "bin", "bin_words"]
    assert sorted(map(tuple, got.collect())) == want
    assert leaks and len(want) < len(rows) - 10
