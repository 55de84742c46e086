import random
from collections import defaultdict

import pytest

from cutgraph.llm.packing import pack, pack_documents

SCHEMA = "doc_id long, text string, source string, bin string, n_words long"


def brute(items, capacity):
    """Tightest compatible bin by looking at every bin."""
    bins, out = [], [0] * len(items)
    for i in sorted(range(len(items)), key=lambda i: -items[i][0]):
        size, source, cluster = items[i]
        fits = [(b["left"], n) for n, b in enumerate(bins) if b["left"] >= size and not (source is not None and source in b["sources"]) and not (cluster is not None and cluster in b["clusters"])]
        n = min(fits)[1] if fits else len(bins)
        if not fits:
            bins.append({"left": capacity, "sources": set(), "clusters": set()})
        bins[n]["left"] -= size
        bins[n]["sources"].add(source)
        bins[n]["clusters"].add(cluster)
        out[i] = n
    return out


@pytest.mark.parametrize("seed", range(20))
def test_against_brute_force(seed):
    r = random.Random(seed)
    items = [(r.randint(0, 50), r.choice([None, "a", "a", "a", *"bcdef"]), r.choice([None, *range(30)])) for _ in range(r.randint(0, 120))]
    assert pack(items, 50) == brute(items, 50)


def test_documents(spark):
    rows = [(i, " ".join(["w"] * (i % 7 + 1)) + f" u{i}", f"s{i % 3}" if i % 11 else None) for i in range(60)]
    rows += [(100, "a b c " * 20, "s1"), (101, None, "s1"), (102, "", None), (103, " \t\n", "s2"), (None, "x y", "s0"), (104, "Same  words", "s4"), (105, "same words", "s5"), (105, "same words", "s5")]
    out = pack_documents(spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA), capacity=25, shard_rows=20).collect()
    words = {i: len((t or "").split()) for i, t, _ in rows}
    got = defaultdict(int)
    bins = defaultdict(list)
    for r in out:
        got[r.doc_id] += r.n_words
        bins[r.bin].append(r)
        assert r.n_words <= 25 and r.first_word == 25 * r.piece
    assert got[105] == 4 and all(got[i] == n for i, n in words.items() if i != 105)
    assert sorted(r.piece for r in out if r.doc_id == 100) == [0, 1, 2]
    for members in bins.values():
        assert sum(r.n_words for r in members) == members[0].bin_words <= 25
        for column in ("source", "cluster"):
            named = [r[column] for r in members if r[column] is not None]
            assert len(named) == len(set(named))
    assert {r.cluster for r in out if r.doc_id == 104} == {r.cluster for r in out if r.doc_id == 105}


def test_empty(spark):
    assert pack_documents(spark.createDataFrame([], SCHEMA)).collect() == []


def test_an_id_of_many_rows_is_many_shards(spark):
    rows = [(None if i % 2 else 7, "same text", "s", "", 0) for i in range(3000)] + [(100 + i, f"a b {i}", None, "", 0) for i in range(1000)]
    out = pack_documents(spark.createDataFrame(rows, SCHEMA), capacity=50, shard_rows=100).collect()
    assert len(out) == 4000 and sum(r.n_words for r in out) == 9000
    shards = defaultdict(int)
    for r in out:
        shards[r.bin.split("-")[0]] += 1
    assert len(shards) == 40 and max(shards.values()) < 200
    copies = [r.bin for r in out if r.cluster and r.doc_id in (None, 7)]
    assert len(copies) == len(set(copies))
