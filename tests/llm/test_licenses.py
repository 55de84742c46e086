from cutgraph.llm.licenses import TEMPLATES, WIDTH, scan_licenses, scan_words

SCHEMA = "doc_id long, text string, license string"


def brute(text):
    words = scan_words((text or "").encode())
    have = {tuple(words[i : i + WIDTH]) for i in range(len(words) - WIDTH + 1)}
    out = {}
    for name, t in TEMPLATES.items():
        w = scan_words(t.encode())
        want = {tuple(w[i : i + WIDTH]) for i in range(len(w) - WIDTH + 1)}
        if len(want & have) >= 0.8 * len(want):
            out[name] = len(want & have) / len(want)
    return out


def found(spark, texts):
    rows = scan_licenses(spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], SCHEMA)).collect()
    out = [{} for _ in texts]
    for r in rows:
        out[r.doc_id][r.license] = r.containment
    return out


def test_against_brute_force(spark, sf_dir):
    cut = TEMPLATES["mit-text"].split()
    texts = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    texts += [f"before {t} after" for t in TEMPLATES.values()] + [t.upper() for t in TEMPLATES.values()]
    texts += [" ".join(cut[:k]) for k in range(30, len(cut))] + [" ".join([*cut[:20], "odd", *cut[21:]])]
    texts += [None, "", "four words are few", "word " * 50_000 + TEMPLATES["gpl-3.0"], TEMPLATES["mit"] * 2]
    got = found(spark, texts)
    assert got == [brute(t) for t in texts]
    assert sum(map(bool, got)) >= 2 * len(TEMPLATES)


def test_empty(spark):
    assert found(spark, []) == []
