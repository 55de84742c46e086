"""Hand-made cases, and set-based operators against plain Python on random intervals."""

import random

import pytest
from pyspark.sql import functions as F

from cutgraph.functions import scalar
from cutgraph.operators import intervals as iv
from cutgraph.operators import sequences as sq
from cutgraph.operators import sequential as seq
from cutgraph.plans import intent, planner, stages
from cutgraph.queries.texts import remapped_captions
from cutgraph.sources import kb as kbs

M = ["media_id"]
S = 1_000_000


def clips(spark, rows):
    return spark.createDataFrame([(1, int(a * S), int(b * S), i) for i, (a, b) in enumerate(rows)], "media_id long, start_us long, end_us long, id long")


def pairs(df):
    return sorted((r.start_us / S, r.end_us / S) for r in df.collect())


def test_merge_and_complement(spark):
    merged = iv.merge(clips(spark, [(0, 1), (1.005, 2), (5, 6)]), M, 10_000)
    assert pairs(merged) == [(0, 2), (5, 6)]
    assert pairs(iv.complement(merged.withColumn("id", F.lit(0)), M, 10 * S)) == [(2, 5), (6, 10)]
    assert pairs(iv.merge(clips(spark, [(1, 5), (2, 3)]), M, 10_000)) == [(1, 5)]


def test_silences_keep_a_gap_of_exactly_300_ms(spark):
    assert pairs(iv.gaps(clips(spark, [(1, 2), (2.2, 3), (3.3, 4)]), M, 5 * S, 300_000)) == [(0, 1), (3, 3.3), (4, 5)]


def test_median_and_hysteresis(spark):
    values = [0.1, 0.9, 0.2, 0.8, 0.7, 0.1]
    df = spark.createDataFrame([(1, i * S, v) for i, v in enumerate(values)], "media_id long, t long, v double")
    m = sq.median_filter(df, M, ["t"], "v", "m")
    assert [round(r.m, 9) for r in m.orderBy("t").collect()] == [0.5, 0.2, 0.8, 0.7, 0.7, 0.4]
    events = sq.hysteresis(m.select("media_id", "t", "m"), M, "t", "m", 0.5, 0.3, S).collect()
    assert [(e.start_us, e.end_us, e.n) for e in events] == [(2 * S, 6 * S, 4)]


def test_words_by_characters(spark):
    u = spark.createDataFrame([(1, 1, "a", 0, 3 * S, "ab c"), (1, 2, "a", 0, 3, ""), (1, 3, None, 0, 3, None)], "media_id long, id long, speaker string, start_us long, end_us long, text string")
    assert [(r.word, r.start_us, r.end_us) for r in sq.interpolated_words(u).orderBy("idx").collect()] == [("ab", 0, 2 * S), ("c", 2 * S, 3 * S)]


def test_captions_of_a_reordered_timeline(spark):
    words = spark.createDataFrame([(1, 0, 0, "Hello", 0, S), (1, 0, 1, "world", S, 2 * S), (1, 0, 2, "this", 5 * S, 6 * S), (1, 0, 3, "is", 6 * S, 7 * S)], "media_id long, utt_id long, idx int, word string, start_us long, end_us long")
    playlist = spark.createDataFrame([(1, 0, 5 * S, 7 * S), (1, 1, 0, 2 * S)], "media_id long, pos long, start_us long, end_us long")
    cue = remapped_captions(playlist, words).withColumn("v", F.lit(1)).collect()
    assert [(c.start, c.end, c.text) for c in cue] == [("00:00:00,000", "00:00:04,000", "this is Hello world")]


def test_calibration(spark):
    df = spark.createDataFrame([(0.6, "vision"), (0.5, None), (0.3, "other"), (1.0, "faces"), (None, "vision")], "c double, s string")
    assert [r[0] for r in df.select(scalar.calibrated(F.col("c"), F.col("s"))).collect()] == [0.475, 0.4, 0.3, 0.9, None]


@pytest.mark.parametrize("seed", range(3))
def test_intervals_against_plain_python(spark, seed):
    r = random.Random(seed)
    rows = [(a, a + r.randint(0, 60)) for a in (r.randint(0, 2000) for _ in range(120))]
    rows = sorted(set(rows))
    df = spark.createDataFrame([(1, a, b, i) for i, (a, b) in enumerate(rows)], "media_id long, start_us long, end_us long, id long")
    want, gap = [], 5
    for a, b in rows:
        if want and a - want[-1][1] <= gap:
            want[-1] = (want[-1][0], max(b, want[-1][1]))
        else:
            want.append((a, b))
    most = 0
    for row, (a, b) in zip(iv.running_max(df, M, ["start_us", "end_us", "id"], "end_us", "m").orderBy("start_us", "end_us").collect(), rows, strict=True):
        assert (row.m or 0) == most
        most = max(most, b)
    merged = iv.merge(df, M, gap)
    assert sorted((x.start_us, x.end_us) for x in merged.collect()) == want
    keeps = iv.complement(merged.withColumn("id", F.lit(0)), M, 3000)
    assert sum(x.end_us - x.start_us for x in keeps.collect()) + sum(b - a for a, b in want) == 3000
    other = [(a, a + r.randint(1, 40)) for a in (r.randint(0, 2000) for _ in range(60))]
    b = spark.createDataFrame([(1, s, e, i) for i, (s, e) in enumerate(other)], "media_id long, b_start_us long, b_end_us long, b_id long")
    for closed in (False, True):
        met = {(x.id, x.b_id) for x in iv.overlap_join(df, b, M, 17, closed).collect()}
        assert met == {(i, j) for i, (s, e) in enumerate(rows) for j, (t, f) in enumerate(other) if (s <= f and e >= t if closed else s < f and e > t)}
    points = sorted({r.randint(0, 2200) for _ in range(50)})
    p = spark.createDataFrame([(1, t) for t in points], "media_id long, t long")
    near = {x.t: x.nearest_us for x in iv.nearest(p, df.select("media_id", F.col("start_us").alias("u")), M, "t", "u", 20).collect()}
    starts = sorted({a for a, _ in rows})
    for t in points:
        close = [u for u in starts if abs(u - t) <= 20]
        assert near[t] == (min(close, key=lambda u: (abs(u - t), u)) if close else None)


def test_budget_selection():
    item = lambda i, d, score=0.1: {"id": i, "start_us": i * 100 * S, "end_us": i * 100 * S + d * S, "score": score, "importance": 0.0}
    kept = seq.budget_selection([item(i, d, 0.01 * d) for i, d in enumerate((5, 4, 3, 1))], 9 * S)
    assert [k["id"] for k in kept] == [0, 1]
    for seed in range(30):
        r = random.Random(seed)
        items = [item(i, r.randint(1, 30), r.random()) for i in range(r.randint(1, 12))]
        kept = seq.budget_selection(items, 20 * S)
        strong = [x for x in items if x["score"] >= 0.5]
        total = sum(k["end_us"] - k["start_us"] for k in kept)
        assert kept and total <= max(20 + 3 * len(strong) + 3, min((x["end_us"] - x["start_us"]) // S for x in items)) * S
        assert kept == sorted(kept, key=lambda k: k["start_us"])
    assert seq.budget_selection([], S) == []


def test_sequential_cores():
    assert seq.scene_chunks([], 800 * S) == [(0, 800 * S)]
    c = seq.scene_chunks([170 * S, 400 * S], 1000 * S)
    assert c[0] == (0, 170 * S) and c[-1][1] == 1000 * S and all(a[1] == b[0] for a, b in zip(c, c[1:], strict=False))
    assert seq.pseudo_shots([(18 * S, 20 * S)], 45 * S) == [(0, 19 * S), (19 * S, 40 * S), (40 * S, 45 * S)]
    assert seq.claimed_order([(0, 5), (10, 15), (20, 25)], [(21, 24), (1, 4)], 0) == [2, 0, 1]
    assert seq.settled([(0, 10 * S), (10 * S + 1000, 12 * S), (20 * S, 20 * S + 1000)], lambda t: t) == [(0, 12 * S)]
    assert seq.settled([(0, 1000)], lambda t: t) == [(0, 1000)] and seq.settled([], lambda t: t) == []
    assert [i for i, _, _ in seq.match_chain([[1, 0], [0, 1], [1, 0]], [[0, 1], [0, 1], [1, 0]])] == [0, 2, 1]


def test_upsert_and_repair(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "k int, v string, n int")
    new = spark.createDataFrame([(2, "c", 2), (3, None, 1), (1, "z", 1)], "k int, v string, n int")
    assert sorted(map(tuple, kbs.upsert(old, new, ["k"], "n").collect())) == [(1, "z", 1), (2, "c", 2), (3, None, 1)]
    fixed = planner.repaired(clips(spark, [(-1, 2), (1, 3), (2.5, 2.9), (9, 20)]), 10 * S)
    assert pairs(fixed) == [(0, 2), (2, 3), (9, 10)]


def test_write_and_read(spark, sf_dir, tmp_path):
    kb = kbs.KB(spark, sf_dir)
    kbs.write({"scenes": kb.scenes}, str(tmp_path))
    assert kbs.read(spark, str(tmp_path), ["scenes"])["scenes"].count() == kb.scenes.count()


def test_stages():
    assert stages.levels()["story"] == 6
    with pytest.raises(ValueError):
        stages.levels({"a": ("b",), "b": ("a",)})
    assert stages.above("vision") == {"normalize", "audio", "scenes", "faces"} and stages.above("normalize") == set()


def test_levels_of_many_graphs(spark):
    nodes = spark.createDataFrame([(1, i) for i in range(5)] + [(2, 0), (2, 1)], "g long, node long")
    edges = spark.createDataFrame([(1, 1, 0), (1, 2, 1), (1, 3, 0), (1, 3, 2)], "g long, node long, needs long")
    assert {(r.g, r.node): r.level for r in stages.levels_of(nodes, edges).collect()} == {(1, 0): 0, (1, 1): 1, (1, 2): 2, (1, 3): 3, (1, 4): 0, (2, 0): 0, (2, 1): 0}
    with pytest.raises(ValueError):
        stages.levels_of(nodes, spark.createDataFrame([(2, 0, 1), (2, 1, 0)], "g long, node long, needs long"))
    assert stages.levels_of(nodes.limit(0), edges).collect() == []


def test_levels_of_small_graphs_take_no_rounds(spark, monkeypatch):
    from cutgraph.plans import stages

    deep = [(g, i) for g, n in ((1, 40), (2, 3), (None, 1)) for i in range(n)] * 2 + [(3, None)]
    links = [(1, i, i - d) for i in range(40) for d in (1, 2, 7) if i >= d] * 2 + [(2, 2, 0), (2, 1, None)]
    nodes, edges = spark.createDataFrame(deep, "g long, node long"), spark.createDataFrame(links, "g long, node long, needs long")
    told = {(1, i): i for i in range(40)} | {(2, 0): 0, (2, 1): 0, (2, 2): 1, (None, 0): 0, (3, None): 0}
    rounds = []
    monkeypatch.setattr(stages, "cut", lambda df: rounds.append(df) or df)
    for small, most in ((100, 1), (6, 200)):
        monkeypatch.setattr(stages, "SMALL", small, raising=False)
        rows = stages.levels_of(nodes, edges.filter("g <> 1 or node < 9") if small == 6 else edges).collect()
        assert len(rows) == len(told) and len(rounds) <= most
        assert {(r.g, r.node): r.level for r in rows} == {k: 0 if small == 6 and k[0] == 1 and k[1] > 8 else v for k, v in told.items()}
    cycle = spark.createDataFrame([(2, 0, 2), (2, 2, 1), (2, 1, 0)], "g long, node long, needs long")
    with pytest.raises(ValueError):
        stages.levels_of(nodes, cycle)


def test_intents():
    for prompt, action, query in [("Cut out filler words", "remove", "filler words"), ("remove silences longer than 1.5 s", "remove", "silence > 1.5s"), ("cut the dead air", "remove", "silence"), ("please keep the final take", "remove", "retakes"), ("remove uh and um", "remove", "ums and uhs"), ("remove silences and keep speech", "keep_only", "speech"), ("keep scenes with person:bo", "keep_only", "person:bo"), ("make under 30 seconds", "compress", "important moments"), ("trailer-style cut", "restructure", "trailer story beats"), ("keep only the shots where i'm speaking", "keep_only", "owner speaking"), ("make a TikTok!", "compress", "short-form highlights")]:
        assert [(o.action, o.query) for o in intent.parse(prompt).operations] == [(action, query)], prompt
    i = intent.parse("Please remove all the pauses.")
    assert [(o.action, o.query) for o in i.operations] == [("remove", "silence")]
    assert intent.parse("make this under 30 seconds").target_us == 30 * S
    assert intent.parse("What did they say about pricing?").question
    assert intent.parse("keep only the parts with the dog").operations[0].action == "keep_only"
    assert intent.parse("cut the boring bits").operations[0].query == "the boring bits"
    assert intent.parse("").operations == []


def test_edit_ask_and_revise(spark, sf_dir):
    from cutgraph.plans import edit

    kb = kbs.KB(spark, sf_dir)
    done = edit.edit(kb, "remove silences over 2s")
    m = done.metrics.collect()
    assert m and all(0 < r.kept_us <= kbs.DURATION for r in m) and any(r.kept_us < kbs.DURATION for r in m)
    assert done.failures.filter("issue = 'floor'").count() == 0
    assert edit.ask(kb, "where is the laughter").count() == 10
    assert edit.status(kb).collect()[0].scenes > 0
    timeline = spark.createDataFrame([(m, i, x, x + 5 * S) for m in (1, 2) for i, x in enumerate((0, 10 * S))], "media_id long, pos int, start_us long, end_us long")
    assert sorted((r.media_id, r.pos, r.start_us, r.dirty) for r in edit.revise(kb, timeline, "swap the clips").collect()) == [(m, i, x, True) for m in (1, 2) for i, x in enumerate((10 * S, 0))]


def test_identity_and_assignment():
    alike = lambda a, b: a["v"] * b["v"]
    people = [{"v": 1.0, "scene": 0}, {"v": 0.75, "scene": 1}, {"v": 0.75, "scene": 9}, {"v": 0.95, "scene": 9}]
    assert seq.merged_identities(people, alike) == [0, 0, 1, 0]
    r = random.Random(1)
    import itertools

    for _ in range(40):
        n, m = r.randint(1, 5), r.randint(1, 5)
        cost = [[r.randint(0, 20) for _ in range(m)] for _ in range(n)]
        got = sum(cost[a][b] for a, b in seq.assigned(cost))
        small, wide = (cost, m) if n <= m else ([list(x) for x in zip(*cost, strict=True)], n)
        assert got == min(sum(row[j] for row, j in zip(small, p, strict=True)) for p in itertools.permutations(range(wide), len(small)))
    assert seq.assigned([[5.0]], 3) == [] == seq.assigned([])


def test_reports(spark, tmp_path):
    from cutgraph.plans import report

    cues = spark.createDataFrame([(1, 0, "00:00:00,000", "00:00:04,000", "this is Hello world")], "media_id long, cue long, start string, end string, text string")
    assert report.srt(cues).collect()[0].text == "1\n00:00:00,000 --> 00:00:04,000\nthis is Hello world\n"
    assert report.vtt(cues).collect()[0].text == "WEBVTT\n\n00:00:00.000 --> 00:00:04.000\nthis is Hello world\n"
    m = spark.createDataFrame([(1, 5 * S, 2, 0.5)], "media_id long, kept_us long, clip_count long, removal_ratio double")
    text = report.markdown(m, spark.createDataFrame([(1, "floor")], "media_id long, issue string"), 10 * S)
    assert "- after: 5.00 s" in text.collect()[0].text and "- checks: floor" in text.collect()[0].text
    report.write_text(text, str(tmp_path / "md"))
    assert "- clips: 2" in (tmp_path / "md" / "media_id=1").glob("part-*").__next__().read_text()
    labels = spark.createDataFrame([("a", "[[1.38, 1.91]]"), ("b", "[]"), ("c", None)], "path string, breath string")
    assert [tuple(r) for r in report.breath_labels(labels).collect()] == [("a", 1_380_000, 1_910_000)]


def scans(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("Relation [")


def test_chains_scan_their_tables_once(spark, sf_dir):
    from cutgraph.queries import QUERIES

    most = {"silences": 1, "merge_adjacent": 1, "merge_removals": 1, "complement": 1, "min_clip": 2, "removals": 3, "critic_tier0": 6, "snap_ladder": 15}
    found = {name: scans(QUERIES[name](spark, sf_dir)) for name in most}
    assert found == {k: min(v, found[k]) for k, v in most.items()}


def test_items_without_hits(spark):
    items = spark.createDataFrame([(1,), (2,), (3,)], "media_id long")
    keep, remove = clips(spark, [(2, 4)]), clips(spark, [(3, 3.5)])
    gone = sorted((r.media_id, r.start_us / S, r.end_us / S) for r in planner.removals(remove, keep, 10 * S, items).collect())
    assert gone == [(1, 0, 2), (1, 3, 3.5), (1, 4, 10), (2, 0, 10), (3, 0, 10)]
    assert sorted((r.media_id, r.start_us, r.end_us) for r in iv.complement(keep.limit(0), M, 10 * S, items=items).collect()) == [(i, 0, 10 * S) for i in (1, 2, 3)]


def test_fusion_keeps_media_items_apart(spark):
    from cutgraph.operators import search

    rows = [(m, "structured", 1, 0, S, 0.9, f"s{m}") for m in (1, 2)] + [(2, "keyword", 2, 0, S, 0.5, "k2")]
    out = search.fuse(spark.createDataFrame(rows, "media_id long, channel string, id long, start_us long, end_us long, score double, evidence string"))
    assert {(r.media_id, r.channels, tuple(r.evidence)) for r in out.collect()} == {(1, 1, ("s1",)), (2, 2, ("s2", "k2"))}


def test_items_stream_through_batches(spark):
    from cutgraph.operators import sequential

    df = spark.range(20_000).selectExpr("id % 700 as k", "id as v").unionAll(spark.createDataFrame([(None, 5), (None, 3)], "k long, v long"))
    out = sequential.per_media(df, "k", ["v"], lambda rows: [{"n": len(rows), "first": rows[0]["v"]}], "k long, n int, first long").collect()
    assert len(out) == 701 and {(r.k, r.n, r.first) for r in out if r.k in (None, 0, 699)} == {(None, 2, 3), (0, 29, 0), (699, 28, 699)}


def planted(spark, sf_dir):
    """A knowledge base of two items with words, pauses, scenes and sounds at known places."""
    kb = kbs.KB(spark, sf_dir)
    d = kbs.DURATION
    signals = [(m, 10 * m + i, m, "view", 50.0, "", a * S, b * S) for m in (1, 2) for i, (a, b) in enumerate([(0, 20), (30, 60), (64, 100), (110, d // S)])]
    kb.__dict__["signals"] = spark.createDataFrame(signals, "media_id long, id long, user_id long, event_type string, value double, props string, start_us long, end_us long")
    kb.__dict__["media"] = spark.createDataFrame([(1,), (2,)], "media_id long")
    said = [(1, 0, "anna", "well um we met at the old bridge", 0, 8, "statement"), (1, 1, "ben", "did you talk about pricing there", 10, 16, "question"), (1, 2, "anna", "you know uh we did not like the price", 20, 28, "answer"), (2, 0, "anna", "nothing of the kind here", 0, 5, "statement")]
    kb.__dict__["utterances"] = spark.createDataFrame([(m, i, s, t, a * S, b * S, act) for m, i, s, t, a, b, act in said], "media_id long, id long, speaker string, text string, start_us long, end_us long, dialogue_act string")
    scenes = [(m, i, i * 65 * S, (i + 1) * 65 * S if i < 39 else d, i % 5 == 0, True, f"loc{i % 2}", "happy" if i == 3 else "sad", 0.9 if i % 10 == 0 else 0.2, 0.5, "hook" if i == 7 else "development", 0.1, "wide") for m in (1, 2) for i in range(40)]
    kb.__dict__["scenes"] = spark.createDataFrame(scenes, "media_id long, id long, start_us long, end_us long, is_broll boolean, indoor boolean, location string, emotion string, intensity double, importance double, story_role string, motion double, shot_type string")
    return kb


def test_edit_prompts_end_to_end(spark, sf_dir):
    from cutgraph.plans import edit

    kb = planted(spark, sf_dir)
    kept = {}
    for prompt in ("Remove filler words.", "remove pauses and silences", "make this under 60 seconds", "keep only b-roll", "cut 0:10 to 0:20", "Create a trailer-style cut.", "remove questions", "Why is it so long?"):
        done = edit.edit(kb, prompt)
        kept[prompt] = sorted((r.media_id, r.start_us, r.end_us) for r in done.clips.collect())
        assert {m for m, *_ in kept[prompt]} == {1, 2}, prompt
        assert all(0 <= a < b <= kbs.DURATION for _, a, b in kept[prompt])
        assert all(m != n or b <= c for (m, _, b), (n, c, _) in zip(kept[prompt], kept[prompt][1:], strict=False)), prompt
        if prompt != "make this under 60 seconds":
            assert done.failures.count() == 0, prompt
    length = lambda prompt, m: sum(b - a for n, a, b in kept[prompt] if n == m)
    whole = kbs.DURATION
    assert 0 < whole - length("Remove filler words.", 1) < 5 * S and length("Remove filler words.", 2) == whole
    assert whole - length("remove pauses and silences", 1) == 24 * S
    assert abs(length("make this under 60 seconds", 1) - 60 * S) <= S
    assert (1, 5 * 65 * S, 6 * 65 * S) in [(m, round(a / S) * S, round(b / S) * S) for m, a, b in kept["keep only b-roll"]]
    assert kept["cut 0:10 to 0:20"][:2] == [(1, 0, 10 * S), (1, 20 * S, whole)]
    assert length("Create a trailer-style cut.", 1) == whole and length("remove questions", 1) < whole == length("remove questions", 2)
    order = edit.edit(kb, "Create a trailer-style cut.").clips
    assert "pos" in order.columns
    # items have lengths of their own
    kb.__dict__["lengths"] = spark.createDataFrame([(1, 40 * S), (2, whole)], "media_id long, duration_us long")
    done = edit.edit(kb, "cut 0:10 to 0:20")
    clips = sorted((r.media_id, r.start_us // S, r.end_us // S) for r in done.clips.collect())
    assert clips == [(1, 0, 10), (1, 20, 40), (2, 0, 10), (2, 20, whole // S)] and "audio_start_us" in done.clips.columns
    assert {r.media_id: r.removal_ratio for r in done.metrics.collect()} == {1: 0.25, 2: 0.0038}


def test_ask_uses_every_channel(spark, sf_dir):
    from cutgraph.plans import edit, requests

    kb = planted(spark, sf_dir)
    asked = ("remove filler words", "scenes about pricing", "where do they meet on a bridge", "somebody says Bridg", "the question", "everything at loc1", "the tangents", "happy scenes in b-roll")
    hits = requests.hits_of(kb, requests.ways(kb, requests.complete(requests.of_every_item(kb, list(asked)))))
    sources: dict = {}
    for r in hits.select("query_id", "source").distinct().collect():
        sources.setdefault(asked[r.query_id], set()).add(r.source)
    assert sources["remove filler words"] == {"filler_detector", "filler_phrases"}
    assert sources["scenes about pricing"] == {"topic_model", "keyword"} and sources["where do they meet on a bridge"] == {"keyword"}
    assert sources["somebody says Bridg"] == {"keyword_fuzzy"} and sources["the question"] == {"dialogue_act", "keyword"}
    assert sources["everything at loc1"] == {"location", "keyword"} and sources["the tangents"] == {"off_topic", "keyword"}
    assert sources["happy scenes in b-roll"] == {"emotion", "metadata", "keyword"}
    assert {r.source for r in edit.channels(kb, "last 2 minutes").select("source").distinct().collect()} == {"time"}
    best = edit.ask(kb, "where is the old bridge").collect()[0]
    assert (best.media_id, best.start_us) == (1, 0)
    takes = kb.utterances.union(spark.createDataFrame([(1, 9, "anna", "well um we met at the old bridges", 40 * S, 48 * S, "statement")], kb.utterances.schema))
    kb.__dict__["utterances"] = takes
    found = requests.channel(kb, "retake", requests.of_every_item(kb, ["remove retakes", "keep the final take"]))
    assert {(r.query_id, r.start_us) for r in found.collect()} == {(0, 0), (1, 40 * S)}


def test_similar_pairs_against_all_pairs(spark):
    from cutgraph.operators import vectors

    r = random.Random(3)
    base = [[r.gauss(0, 1) for _ in range(8)] for _ in range(12)]
    rows = [(i, [x + r.gauss(0, 0.15) for x in r.choice(base)]) for i in range(150)] + [(200, base[0]), (201, base[0])]
    df = spark.createDataFrame(rows, "id long, v array<double>").select("id", vectors.unit("v").alias("v"))
    known = {x.id: x.v for x in df.collect()}
    for least in (0.5, 0.9, 0.99):
        want = {(a, b) for a in known for b in known if a < b and sum(x * y for x, y in zip(known[a], known[b], strict=True)) >= least}
        assert {(x.a, x.b) for x in vectors.similar_pairs(df, "id", "v", least).collect()} == want and (200, 201) in want
