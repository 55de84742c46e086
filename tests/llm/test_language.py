import random
import zlib

from cutgraph.llm.language import Model, classify, identify_language, in_known_language, learn, suffix_automaton

SCHEMA = "doc_id long, text string, lang string, source string, score string"


def phrases(text, training):
    """Greedy parse by substring search."""
    n = i = 0
    while i < len(text):
        k = 1
        while i + k <= len(text) and text[i : i + k] in training:
            k += 1
        i += max(1, k - 1)
        n += 1
    return n


def test_automaton_holds_all_substrings_and_no_others():
    r = random.Random(1)
    for _ in range(20):
        text = [r.randint(0, 2) for _ in range(30)]
        moves = suffix_automaton(text)
        have = {tuple(text[i:j]) for i in range(30) for j in range(i, 31)}
        for _ in range(200):
            probe = tuple(r.randint(0, 2) for _ in range(r.randint(1, 6)))
            state = 0
            for c in probe:
                state = moves[state].get(c) if state is not None else None
            assert (state is not None) == (probe in have)


def test_phrases_against_brute_force():
    model = Model({"a": ["the cat sat on the mat"], "b": ["le chat est sur le tapis"]})
    r = random.Random(2)
    texts = ["".join(r.choice("thecat slipur") for _ in range(r.randint(1, 200))) for _ in range(40)]
    codes = [model.encode(t) for t in texts]
    train = {k: bytes(model.encode(v).tolist()) for k, v in (("a", "the cat sat on the mat"), ("b", "le chat est sur le tapis"))}
    got = model.phrases(codes)
    for c, row in zip(codes, got.tolist(), strict=True):
        assert row == [phrases(bytes(c.tolist()), train["a"]), phrases(bytes(c.tolist()), train["b"])]


def test_held_out_accuracy(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    lang = {r.doc_id: r.lang for r in docs.collect()}
    out = identify_language(docs).collect()
    assert len(out) == len(lang)
    for r in out:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1
    held = [r for r in out if r.held_out]
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.97 * len(held)


def test_edges(spark):
    rows = [(i, t, lang, "s", "clash") for i, (t, lang) in enumerate([("the cat and the dog " * 5, "en"), ("der hund und die katze " * 5, "de")] * 8)]
    rows += [(100, None, "en", "s", ""), (101, "", None, "s", ""), (102, "123 !!", "en", "s", ""), (103, "the dog", None, None, None), (103, "the dog", None, None, None), (None, "der hund", "en", None, None), (104, "\U00020000 the cat", None, "s", ""), (105, "die katze und " * 40_000, None, "s", "")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = [(r.doc_id, r.lang_pred) for r in identify_language(df).collect()]
    assert len(got) == len(rows)
    told = dict(got)
    assert told[100] == told[101] == told[102] == "und" and told[103] == told[104] == "en" and told[105] == told[None] == "de"
    kept = in_known_language(df).collect()
    assert len(kept) == len(rows) - 3 and {r.lang for r in kept} == {"en", "de"}
    assert [(r.lang_pred, r.score) for r in identify_language(df.filter("doc_id = 103")).collect()] == [("und", 0.0)] * 2
    assert identify_language(df.limit(0)).collect() == []


def test_classify_bounds():
    assert classify(Model({}), ["a"]) == [("und", 0.0)]
    assert classify(Model({"x": ["abc"]}), ["abc", "1"])[1] == ("und", 0.0)


def test_long_texts_are_parsed_whole_and_sparse_tables_agree():
    r = random.Random(3)
    samples = {"a": ["".join(r.choice("abcde fgh") for _ in range(3000))], "b": ["ab" * 40 + " cde" * 60], "c": ["a"]}
    texts = ["".join(r.choice("abcdefgh x") for _ in range(5000)), "abcde" * 2000, "a" * 3000 + "b" * 3000, "ab " * 1500 + "z", ""]
    for entries in (0, 1 << 14, 1 << 24):
        model = Model(samples, dense_entries=entries)
        codes = [model.encode(t) for t in texts]
        got = model.phrases(codes).tolist()
        for k, language in enumerate(model.languages):
            train = "".join(map(chr, model.encode(samples[language][0])))
            assert [row[k] for row in got] == [phrases("".join(map(chr, c)), train) for c in codes], (entries, language)


def test_scripts_and_a_small_sample():
    """Every script has letters of its own, and neither a large alphabet nor a tiny sample draws texts to it."""
    r = random.Random(4)

    def text(letters, n, seed):
        words = ["".join(random.Random(seed * 1000 + i).choice(letters) for _ in range(2 + i % 5)) for i in range(400)]
        return " ".join(r.choice(words) for _ in range(n))

    scripts = {"el": "αβγδεζηθικλμνξοπρστυφχψω", "ru": "абвгдежзийклмнопрстуфхцчшщъыьэюя", "ar": "ابتثجحخدذرزسشصضطظعغفقكلمنهوي", "hi": "अआइईउऊएऐओऔकखगघचछजझटठडढतथदधनपफबभमयरलवशषसह", "zh": "".join(chr(0x4E00 + i) for i in range(1500)), "ja": "".join(chr(0x4E00 + i) for i in range(700, 2200)), "pl": "aąbcćdeęfghijklłmnńoóprsśtuwyzźż", "cs": "aábcčdďeéěfghiíjklmnňoóprřsštťuúůvyýzž"}
    model = Model({k: [text(v, 3000, i)] for i, (k, v) in enumerate(scripts.items())} | {"xx": ["hapax"]})
    for i, (language, letters) in enumerate(scripts.items()):
        told = classify(model, [text(letters, 60, i) for _ in range(20)])
        assert sum(k == language for k, _ in told) >= 19, language


def test_samples_of_different_length():
    r = random.Random(5)
    words = {k: ["".join(r.choice("aeinrst") for _ in range(r.randint(2, 7))) for _ in range(300)] for k in "pq"}
    text = lambda k, n: " ".join(r.choice(words[k]) for _ in range(n))
    model = Model({"p": [text("p", 3000)], "q": [text("q", 400)]})
    for k in "pq":
        assert sum(x == k for x, _ in classify(model, [text(k, 80) for _ in range(50)])) >= 49


def test_a_repeated_id_with_many_texts_is_bounded(spark):
    rows = [(1, f"the text number {i} of one id", "en", None, None) for i in range(3000)] + [(3, "ein ganz anderer Satz", "de", None, None)] * 10
    held = [i for i in (1, 3) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert not held
    model = learn(spark.createDataFrame(rows, SCHEMA), sample_docs=5, sample_chars=60)
    texts = sorted({t for _, t, *_ in rows[:3000]})
    told = Model({"de": ["ein ganz anderer Satz"], "en": texts[:5]}, 60)
    for text in ("the text number 12", "ein Satz", "x"):
        assert classify(model, [text]) == classify(told, [text])
    assert learn(spark.createDataFrame([], SCHEMA)).languages == Model({}).languages
