"""Revisions of timelines, persons, stories and event windows, against plain versions."""

import random

from cutgraph.operators import sequences as sq
from cutgraph.operators import vectors
from cutgraph.plans import people, planner, report, revisions

S = 1_000_000
CLIPS = "media_id long, pos int, start_us long, end_us long, dirty string"


def timelines(spark, prompt, clips, length=100 * S):
    rows = [(1, i, a, b, "x") for i, (a, b) in enumerate(clips)]
    asked = spark.createDataFrame([(1, prompt, 0)], "media_id long, prompt string, pos int")
    out = revisions.revised(spark.createDataFrame(rows, CLIPS), asked, spark.createDataFrame([(1, length)], "media_id long, duration_us long"))
    return [(r.start_us / S, r.end_us / S, r.dirty) for r in out.orderBy("pos").collect()]


def test_deltas(spark):
    clips = [(10 * S, 15 * S), (20 * S, 22 * S), (90 * S, 99 * S)]
    told = lambda prompt, of=clips, **k: timelines(spark, prompt, of, **k)
    same = [(10, 15, False), (20, 22, False), (90, 99, False)]
    assert told("remove the first clip") == [(20, 22, True), (90, 99, True)] == told("DELETE  first clip please")
    assert told("restore the intro") == [(0, 10, True), (10, 15, True), (20, 22, True), (90, 99, True)]
    assert told("keep the intro", [(0, S)])[0] == (0, 5, True) and told("keep the intro", [(0, S)], length=30 * S)[0] == (0, 3, True)
    assert told("keep the first clip", [(S // 2, S)])[0] == (0, 1, True)
    assert told("put back the intro", []) == [(0, 5, True)]
    assert told("swap the clips") == [(20, 22, True), (10, 15, True), (90, 99, False)] and told("swap", clips[:1]) == same[:1]
    assert told("make it shorter")[0] == (10, 13, True) and told("shrink", clips[1:])[0] == (20, 21, True)
    assert told("extend it by 7 seconds")[0] == (10, 22, True) and told("longer")[0] == (10, 17, True) and told("make it longer, by 85s or so")[0] == (10, 100, True)
    for nothing in (None, "", "cut the pricing part", "well done", "remove the first joke", "forklonger"):
        assert told(nothing) == same
    # beyond the item's end: cut, or gone unless all are
    assert told("swap", clips, length=21 * S) == [(20, 21, True), (10, 15, True)] and told("shorter", [(30 * S, 40 * S)], length=20 * S) == [(20, 20, True)]


def test_items_without_requests_and_empty_tables(spark):
    clips = spark.createDataFrame([(1, 0, 0, S, "x"), (2, 5, 0, 900 * S, "x"), (None, 0, 0, S, "x")], CLIPS)
    asked = spark.createDataFrame([(1, "drop the first clip")], "media_id long, prompt string")
    lengths = spark.createDataFrame([(1, 9 * S), (2, 9 * S)], "media_id long, duration_us long")
    rows = lambda df: sorted(map(tuple, df.collect()), key=repr)
    assert rows(revisions.revised(clips, asked, lengths)) == [(2, 0, 0, 900 * S, False), (None, 0, 0, S, False)]
    assert rows(revisions.revised(clips.limit(0), asked, lengths)) == [] and len(rows(revisions.revised(clips, asked.limit(0), lengths))) == 3


def test_people(spark):
    raw = "media_id long, id long, scene long, embedding array<double>"
    rows = [(1, 0, 0, [1.0, 0.0]), (1, 1, 9, [0.9, 0.436]), (1, 2, 5, [0.0, 1.0]), (1, 3, 6, [0.7, 0.714]), (1, 4, 7, None), (2, 0, 3, [1.0, 0.0])]
    faces = spark.createDataFrame([(1, 9, "person:A", 0), (1, 9, "person:C", 0), (1, 1, "person:D", 0)], "media_id long, scene long, person string, id int")
    found = people.resolved(spark.createDataFrame(rows, raw), faces)
    # 3 is like 2 by the bonus only; 4 has no vector; A, C and D are taken
    assert {(r.media_id, r.id): r.person for r in found.collect()} == {(1, 0): "person:A", (1, 1): "person:A", (1, 2): "person:B", (1, 3): "person:B", (1, 4): "person:E", (2, 0): "person:A"}
    many = spark.createDataFrame([(1, i, 10 * i, [1.0 if j == i else 0.0 for j in range(30)]) for i in range(30)], raw)
    names = {r.id: r.person for r in people.resolved(many, faces).collect()}
    assert names[0] == "person:B" and names[1] == "person:E" and names[22] == "person:Z" and names[23] == "person:A1" and len(set(names.values())) == 30
    assert people.resolved(many.limit(0), faces).collect() == [] and len(people.resolved(many, faces.limit(0)).collect()) == 30


def plain_events(scores):
    n = len(scores)
    smooth = [sorted(scores[max(0, i - 1) : i + 2]) for i in range(n)]
    smooth = [s[len(s) // 2] if len(s) % 2 else (s[0] + s[1]) / 2 for s in smooth]
    out, begun, seen = [], None, []
    for i, v in enumerate(smooth):
        t = (i + 1) * S
        if begun is None and v > 0.5:
            begun, seen = t, []
        elif begun is not None and v < 0.3:
            out.append((begun, t + S, len(seen)))
            begun = None
        if begun is not None:
            seen.append(v)
    return out + ([(begun, n * S + S, len(seen))] if begun is not None else [])


def test_event_windows_are_those_of_the_whole_grid(spark):
    r = random.Random(5)
    rows, told = [], {}
    for m in range(60):
        n, share = r.randint(5, 60), r.choice((0.1, 0.4, 0.8))
        scores = [round(r.random(), 2) if r.random() < share else 0.0 for _ in range(60)]
        scores[n:] = [0.0] * (60 - n) if m % 2 else scores[n:]
        rows += [(m, "x", i, v) for i, v in enumerate(scores) if v] + [(m, "x", -1, 1.0), (m, "x", 60, 1.0)]
        told[m] = plain_events(scores)
    found = sq.windowed_events(spark.createDataFrame(rows, "media_id long, type string, w long, v double"), ["media_id", "type"], "w", "v", 59)
    got = {m: [] for m in told}
    for x in found.collect():
        got[x.media_id].append((x.start_us, x.end_us, x.n))
    assert {m: sorted(v) for m, v in got.items()} == told


def test_registry_in_blocks(spark):
    r = random.Random(3)
    v = [[r.gauss(0, 1) for _ in range(4)] for _ in range(60)]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(v)] + [(90, None), (91, [0.0] * 4), (92, v[0])], "id long, v array<double>")
    known = spark.createDataFrame([(i, x) for i, x in enumerate(v[:20])] + [(50, v[3])], "label long, c array<double>").withColumn("c", vectors.unit("c"))
    one = sorted(map(tuple, vectors.best_match(rows, known, "id", "v", "label", "c").collect()))
    assert one == sorted(map(tuple, vectors.best_match(rows, known, "id", "v", "label", "c", few=5).collect()))
    assert len(one) == 61 and all(label == i and score == 1 for i, label, score in one if i < 20) and one[-1][1] == 0
    assert vectors.best_match(rows, known.limit(0), "id", "v", "label", "c").collect() == []


def test_story_issues_and_texts(spark):
    keep = spark.createDataFrame([(1, 0, 4 * S), (1, 10 * S, 20 * S), (1, 30 * S, 31 * S)], "media_id long, start_us long, end_us long")
    scenes = spark.createDataFrame([(1, 1, 0, 3 * S, "a"), (1, 2, 3_600_000, 12 * S, None), (1, 3, 12 * S, 25 * S, "c")], "media_id long, id long, start_us long, end_us long, caption string")
    words = spark.createDataFrame([(1, 0, i, w, a, b) for i, (w, a, b) in enumerate([("in", 0, S), ("cut", 3_900_000, 4_100_000), ("late", 19 * S, 20 * S)])], "media_id long, utt_id long, idx int, word string, start_us long, end_us long")
    told = sorted((r.start_us // S, r.scenes, r.words) for r in planner.kept_story(keep, words, scenes, "caption").collect())
    assert told == [(0, "a", "in"), (10, " | c", "late")]
    rendered = spark.createDataFrame([(10 * S, 10 * S, 0), (11 * S, 10 * S, 0), (10_240_000, 10 * S, 0), (10 * S, 10 * S, -100_001), (None, S, None)], "a long, e long, s long")
    from pyspark.sql import functions as F

    assert [r[0] for r in rendered.select(planner.render_issue(F.col("a"), F.col("e"), F.col("s"))).collect()] == [None, "drift", None, "sync", None]
    text = spark.range(1).select(planner.fade_filter(*(F.lit(x).cast("long") for x in (1_500_000, 1_700_000, 500_000, 900)))).collect()[0][0]
    assert text == "atrim=1.500:1.700,asetpts=PTS-STARTPTS,afade=t=in:d=0.100"
    assert [r.text for r in report.shot_index(keep.limit(0)).collect()] == []
