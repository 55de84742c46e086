"""Sharding against a plain two-pass shuffle, and its laws."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from cutgraph.llm import sharding

SCHEMA = "doc_id long, text string, source string"


def made(n, seed=1):
    r = random.Random(seed)
    return [(i, None if i % 17 == 0 else "word ü " * r.randrange(40), f"s{i % 3}") for i in range(n)]


def laws(rows, got, shards):
    assert Counter((r.doc_id, r.text, r.source) for r in got) == Counter(rows)
    counts = Counter(r.shard for r in got)
    sizes = [counts.get(s, 0) for s in range(shards)]
    assert set(counts) <= set(range(shards)) and max(sizes) - min(sizes) <= 1
    for s in range(shards):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(counts.get(s, 0)))


@pytest.mark.parametrize("n", [0, 1, 5, 24, 25, 1000])
def test_laws(spark, n):
    rows = made(n)
    docs = spark.createDataFrame(rows, SCHEMA)
    got = sharding.shuffle_into_shards(spark, docs, bucket_bytes=3000).collect()
    laws(rows, got, 24)
    again = sharding.shuffle_into_shards(spark, docs.repartition(7), bucket_bytes=3000).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again))


def test_against_a_plain_shuffle(spark):
    rows = made(300)
    docs = spark.createDataFrame(rows, SCHEMA)
    size = sum(len((t or "").encode()) + 8 for _, t, _ in rows)
    buckets = -(-size // 3000)
    hashes = docs.select("doc_id", F.xxhash64(F.lit(42), "doc_id", "text", F.lit(None)).alias("h")).select("doc_id", "h", F.pmod(F.xxhash64(F.lit(42), "h"), F.lit(buckets)).alias("b")).collect()
    order = []
    for b in range(buckets):
        bucket = [r.doc_id for r in sorted((r for r in hashes if r.b == b), key=lambda r: r.h)]
        draw = np.random.default_rng([42, b])
        partners = draw.integers(0, np.arange(len(bucket), 1, -1)) if len(bucket) > 1 else []
        for i, j in zip(range(len(bucket) - 1, 0, -1), partners, strict=True):
            bucket[i], bucket[j] = bucket[j], bucket[i]
        order += bucket
    told, slots = {}, Counter()
    for at, doc in enumerate(order):
        shard = at * 24 // 300
        told[doc] = (shard, slots[shard])
        slots[shard] += 1
    got = {r.doc_id: (r.shard, r.slot) for r in sharding.shuffle_into_shards(spark, docs, bucket_bytes=3000).collect()}
    assert got == told and len(buckets * [0]) > 3


def test_fisher_yates_is_uniform():
    seen = Counter(tuple(sharding.fisher_yates(3, [s])) for s in range(6000))
    assert len(seen) == 6 and all(850 < n < 1150 for n in seen.values())
    assert [len(sharding.fisher_yates(n, [1])) for n in (0, 1, 2)] == [0, 1, 2]


@pytest.mark.parametrize("broadcast", [0, 1000])
def test_a_third_of_the_rows_are_copies(spark, monkeypatch, broadcast):
    monkeypatch.setattr(sharding, "OFTEN", 50)
    monkeypatch.setattr(sharding, "BROADCAST_ROWS", broadcast)
    rows = made(600) + [(7, "the same text again", "s")] * 300 + [(None, "no id", "s")] * 100 + [(9, None, None)] * 3
    docs = spark.createDataFrame(rows, SCHEMA)
    got = sharding.shuffle_into_shards(spark, docs, bucket_bytes=3000).collect()
    laws(rows, got, 24)
    copies = Counter(r.shard for r in got if r.doc_id == 7 and r.source == "s")
    assert len(copies) == 24 and max(copies.values()) < 40


def test_seed_and_shards(spark):
    docs = spark.createDataFrame(made(200), SCHEMA)
    one, two = ([tuple(r) for r in sharding.shuffle_into_shards(spark, docs, 5, seed).orderBy("shard", "slot").collect()] for seed in (1, 2))
    assert one != two and len(one) == len(two) == 200
    with pytest.raises(ValueError):
        sharding.shuffle_into_shards(spark, docs, 0)


def test_clashing_columns_and_files(spark, tmp_path):
    rows = [(i, t, s, 5, 6, 7, {"a": 1}, [("x", None)]) for i, t, s in made(120)]
    docs = spark.createDataFrame(rows, SCHEMA + ", shard int, slot int, `bucket.n` int, m map<string,int>, st array<struct<a:string,b:int>>")
    got = sharding.shuffle_into_shards(spark, docs)
    assert got.columns == ["doc_id", "text", "source", "bucket.n", "m", "st", "shard", "slot"]
    sharding.write_shards(got, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(map(repr, (tuple(r) for r in back.select(*[F.col(f"`{c}`") for c in got.columns]).collect()))) == sorted(map(repr, (tuple(r) for r in got.collect())))


def test_query_columns(spark):
    rows = made(60) + [(None, "ü" * 100_000, None)]
    got = sharding.query_sharding(spark, spark.createDataFrame(rows, SCHEMA))
    assert [f.dataType.simpleString() for f in got.schema] == ["bigint", "bigint", "bigint", "string", "int", "bigint", "int"]
    told = {(i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode()), "rows", None) for i, t, _ in rows}
    assert {(r.doc_id, r["size"], r.text_crc32, r.law, r.grown_shard) for r in got.collect()} == told
