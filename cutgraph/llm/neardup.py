"""Near-duplicates by bottom-k sketches of word shingles, verified exactly.

1. Each document's shingle set is hashed by one function; a sketch keeps the SKETCH least values. Documents
   with equal sets form a class, and only its smallest document goes on.
2. Inverted lists of retained values, two neighbours of a sketch to a key. In the order of the hash, the first
   SKETCH values of two linked documents' union are each in both with probability 0.8 or more, so that 40 of 63
   neighbouring pairs are expected in both sketches, with a standard deviation of 5.2; fewer than SHARED have a
   probability under 1e-10. Sets of up to WHOLE shingles are retained whole: there each value of the one set only breaks two pairs and
   each of the other only one, which bounds what is left exactly. So a document with fewer keys in common with any
   others has no link, and linked documents still meet when each leaves out its SHARED - 1 most frequent keys. Words, lines
   and passages of a large part of the corpus drop out by that, without a cap.
3. Each list's smallest document is its pivot; every other member is paired with it. The estimate from the
   two sketches' union filters these pairs and the full sets give the exact similarity of the rest.
4. Members of different groups that are near a common pivot (similarity NEAR or more) are compared in
   blocks, as whole sets, inside one task per block; no pair leaves it but links between groups. The
   distance 1 - J is a metric: two linked documents differ by at most 0.2 in their distance from a pivot. So
   if they aren't both near the pivot, neither has 0.4 with it; these few are compared by
   their sketches, in blocks of a list, and what can be
   linked is verified, unless a pivot near both has compared them already.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, WordHashes, rolled
from .graphs import components

SKETCH = 64
SHARED = 8
#: Sets up to this size are retained whole, and so are all sets they can be linked with.
WHOLE = SKETCH * 4 // 5 - 1
NEAR = 0.2
#: The estimate may call a pair of NEAR not near (with a probability of 1e-4; of NEAR + SLACK, 1e-7), so lists keep so much more.
SLACK = 0.1
#: Least number of the union sketch's values in both sets, for a similarity of NEAR, and of the threshold, to be possible.
LEAST_NEAR, LEAST_LINK = 3, 28
#: Shingles in a block of whole sets, and documents in a block of sketches.
BLOCK = 1 << 18
CROWD = 2048


def shingle_set(text: bytes | None, width: int, hashes: WordHashes) -> np.ndarray:
    """Distinct hashes of the shingles as ascending int64, the sketch's order; empty for no words."""
    words = text.lower().split() if text else []
    return np.unique(rolled(hashes.of(words), width).view(np.int64))


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, arrays)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(arrays) if arrays else np.zeros(0, np.int64), pa.int64()))


def _sketcher(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            sets = [shingle_set(t.as_py(), width, hashes) for t in batch.column(1)]
            digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary()), _lists([s[:SKETCH] for s in sets])], ["doc_id", "n", "digest", "sketch"])

    return run


def _full_sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), _lists([shingle_set(t.as_py(), width, hashes) for t in batch.column(1)])], ["x", "s"])

    return run


def _jaccard(a: str, b: str, na: str, nb: str) -> Column:
    both = F.size(F.array_intersect(a, b))
    return both / (F.col(na) + F.col(nb) - both)


def _linked(a: str, b: str, na: str, nb: str, percent: int) -> Column:
    both = F.size(F.array_intersect(a, b))
    return 100 * both >= percent * (F.col(na) + F.col(nb) - both)


def _estimate(least: int) -> Column:
    """Whether the sketch of the union of s_a and s_b leaves the similarity possible."""
    first = lambda c: F.slice(c, 1, SKETCH)
    union = first(F.array_sort(F.array_union(first("s_a"), first("s_b"))))
    both = F.size(F.array_intersect(union, F.array_intersect(first("s_a"), first("s_b"))))
    return both >= F.least(F.lit(least), F.ceil(F.size(union) * (least / SKETCH)))


def _with(pairs: DataFrame, table: DataFrame, key: str, suffix: str) -> DataFrame:
    """``pairs`` with the columns of ``table`` (x, ...) for the document in ``key``."""
    renamed = table.select(*(F.col(c).alias(key if c == "x" else f"{c}_{suffix}") for c in table.columns))
    return pairs.join(renamed, key)


class _Block:
    """The sets of a block's rows, and an inverted index of those that aren't probes."""

    def __init__(self, rows: pa.Table, column: str = "s"):
        sets = rows.column(column).combine_chunks()
        self.x, self.probe = np.array(rows.column("x")), np.array(rows.column("probe"))
        offsets, self.values = np.array(sets.offsets), np.array(sets.flatten())
        self.offsets = offsets - offsets[0]
        self.size = np.diff(self.offsets)
        self.targets = np.flatnonzero(~self.probe)
        of_target = np.repeat(~self.probe, self.size)
        pool, owner = self.values[of_target], np.repeat(np.arange(len(self.x)), self.size)[of_target]
        order = np.argsort(pool, kind="stable")
        self.pool, self.owner = pool[order], owner[order]

    def shared(self, i: int) -> np.ndarray:
        """For each target, how many values it has in common with row i."""
        own = self.values[self.offsets[i] : self.offsets[i + 1]]
        low, high = np.searchsorted(self.pool, own, "left"), np.searchsorted(self.pool, own, "right")
        runs = high - low
        at = np.repeat(low - np.concatenate(([0], np.cumsum(runs)[:-1])), runs) + np.arange(runs.sum())
        return np.bincount(self.owner[at], minlength=len(self.x))[self.targets]


def _block_links(percent: int):
    """Within a block: for each probe, one link to each other group that it has any link with."""

    def run(rows: pa.Table) -> pa.Table:
        block, comp = _Block(rows), np.array(rows.column("c"))
        targets, size = block.targets, block.size
        a, b = [], []
        for i in np.flatnonzero(block.probe):
            both = block.shared(i)
            hit = targets[(100 * both >= percent * (size[targets] + size[i] - both)) & (comp[targets] != comp[i])]
            for j in hit[np.unique(comp[hit], return_index=True)[1]]:
                a.append(int(block.x[i]))
                b.append(int(block.x[j]))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def _sketch_pairs(share: float):
    """Within a block of sketches: the pairs that share as many retained values as linked ones must, and no pivot near both."""

    def run(rows: pa.Table) -> pa.Table:
        block, near, n = _Block(rows), _Block(rows, "ps"), np.array(rows.column("n"))
        found: list[np.ndarray] = []
        for i in np.flatnonzero(block.probe):
            least = np.minimum(LEAST_LINK, np.ceil(share * np.maximum(n[block.targets], n[i]) - 1e-9))
            hit = block.targets[(block.shared(i) >= least) & (near.shared(i) == 0)]
            if len(hit):
                first = block.x[hit] < block.x[i]
                found.append(np.stack([np.where(first, block.x[hit], block.x[i]), np.where(first, block.x[i], block.x[hit]), np.where(first, n[hit], n[i]), np.where(first, n[i], n[hit])]))
        out = np.unique(np.concatenate(found, 1), axis=1) if found else np.zeros((4, 0), np.int64)
        return pa.table({k: pa.array(v, pa.int64()) for k, v in zip(("x", "y", "n_a", "n_b"), out, strict=True)})

    return run


def near_duplicates(spark: SparkSession, docs: DataFrame, width: int = 2, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept, set_digest) of every row.

    Words are split at ASCII white space and A-Z lower-cased. Documents are linked when their sets of
    ``width``-word shingles (the whole sequence where a text has fewer words) have 100 * intersection >=
    percent * union, percent being 80 or more; links go on transitively. Null and empty texts have no set,
    stand alone and are kept; so do rows without doc_id, with a null component. Rows that repeat a doc_id are
    one document for linking: what any of them is linked with. Other columns are not read.

    Shingles are compared by 64-bit hashes; that two of a pair's thousands collide has a probability under 1e-10.
    """
    if not 80 <= percent <= 100:
        raise ValueError("the sketch bounds hold for 80 to 100 per cent")
    scratch = Scratch(spark, "neardup")
    share = percent / 100
    texts = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    every = scratch.save(texts.mapInArrow(_sketcher(width), "doc_id long, n long, digest binary, sketch array<long>"))
    known = every.filter("n > 0 and doc_id is not null")
    classes = scratch.save(known.groupBy("digest").agg(F.min("doc_id").alias("x"), F.first("n").alias("n"), F.min_by("sketch", "doc_id").alias("sk")))

    # inverted lists, without each document's most frequent keys
    neighbours = F.transform(F.arrays_zip(F.expr("slice(sk, 1, size(sk) - 1)").alias("a"), F.expr("slice(sk, 2, size(sk) - 1)").alias("b")), lambda e: F.xxhash64(e["a"], e["b"]))
    postings = classes.filter("n > 1").select("x", "n", F.explode(neighbours).alias("v"))
    often = postings.groupBy("v").agg(F.count("*").alias("df")).filter("df > 1")
    shared = postings.join(often, "v").groupBy("x").agg(F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct("df", "v"))).alias("vs"))
    least = F.when(F.col("n") <= WHOLE, F.greatest(F.lit(1), F.floor(F.col("n") * 0.6) - 1)).otherwise(SHARED).cast("int")
    rare = shared.withColumn("least", least).filter("size(vs) >= least").select("x", "n", F.explode(F.expr("slice(vs, 1, size(vs) - least + 1)")).alias("e"))
    lists = scratch.save(rare.select(F.col("e.v").alias("v"), "x", "n"))
    pivots = lists.groupBy("v").agg(F.min(F.struct("x", "n")).alias("p"), F.count("*").alias("m")).filter("m > 1")
    members = scratch.save(lists.join(pivots.select("v", F.col("p.x").alias("p"), F.col("p.n").alias("n_p")), "v").filter("x <> p").select("v", "p", "n_p", "x", "n"))

    # exact similarity of members with their pivots
    wanted = members.select("x").union(members.select("p")).distinct()
    sets = scratch.save(texts.join(wanted, F.col("doc_id") == F.col("x"), "left_semi").mapInArrow(_full_sets(width), "x long, s array<long>"))
    pairs = members.filter(f"n >= {NEAR} * n_p and n_p >= {NEAR} * n").select("p", "n_p", "x", "n").distinct()
    tried = _with(_with(pairs, sets, "x", "a"), sets, "p", "b").filter(_estimate(LEAST_NEAR))
    near = tried.select("p", "x", "n", _jaccard("s_a", "s_b", "n", "n_p").alias("j"), _linked("s_a", "s_b", "n", "n_p", percent).alias("linked"))
    near = scratch.save(near.filter(F.col("j") >= NEAR))
    stars = near.filter("linked").select(F.col("p").alias("a"), F.col("x").alias("b"))

    # near a common pivot, in different groups: whole sets in blocks. A document's group is its smallest linked pivot
    group = near.filter("linked").groupBy("x").agg(F.min("p").alias("g"))
    around = near.join(group, "x", "left").join(group.select(F.col("x").alias("p"), F.col("g").alias("gp")), "p", "left")
    around = around.withColumn("gp", F.coalesce("gp", "p")).withColumn("c", F.when(F.col("linked"), F.col("gp")).otherwise(F.coalesce("g", "x"))).withColumn("probe", F.col("c") != F.col("gp"))
    blocks = around.groupBy("p").agg(F.sum(F.when(F.col("probe"), F.col("n"))).alias("probes"), F.sum("n").alias("targets"), F.count("*").alias("m")).filter("probes > 0 and m > 1")
    blocks = blocks.select("p", F.ceil(F.col("targets") / BLOCK).cast("int").alias("nb"), F.ceil(F.col("probes") / BLOCK).cast("int").alias("nq"))
    placed = around.join(blocks, "p").select("p", "x", "c", "probe", F.pmod(F.xxhash64("x"), "nb").cast("int").alias("bt"), F.pmod(F.xxhash64("x", F.lit(1)), "nq").cast("int").alias("bq"), "nb", "nq").join(sets, "x")
    as_target = F.transform(F.expr("sequence(0, nq - 1)"), lambda i: F.struct(F.lit(False).alias("probe"), F.col("bt").alias("bt"), i.alias("bq")))
    as_probe = F.when(F.col("probe"), F.transform(F.expr("sequence(0, nb - 1)"), lambda i: F.struct(F.lit(True).alias("probe"), i.alias("bt"), F.col("bq").alias("bq")))).otherwise(F.expr("cast(array() as array<struct<probe:boolean,bt:int,bq:int>>)"))
    in_blocks = placed.select("p", "x", "c", "s", F.explode(F.concat(as_target, as_probe)).alias("e")).select("p", "x", "c", "s", "e.probe", "e.bt", "e.bq").groupBy("p", "bt", "bq").applyInArrow(_block_links(percent), "a long, b long")

    # not both near the pivot: sketches of a list in blocks, of which pairs that can be linked leave; neither has 0.4 with the pivot
    opened = members.select("v", "p", "x").join(near.select("p", "x", "j"), ["p", "x"], "left").filter(f"coalesce(j, 0) < {NEAR} + 0.2 + {SLACK}").select("v", "x", F.col("j").isNull().alias("probe"))
    opened = scratch.save(opened)
    crowd = opened.groupBy("v").agg(F.count("*").alias("m"), F.count(F.when(F.col("probe"), 1)).alias("k")).filter("m > 1 and k > 0")
    crowd = crowd.select("v", F.ceil(F.col("m") / CROWD).cast("int").alias("nb"), F.ceil(F.col("k") / CROWD).cast("int").alias("nq"))
    waiting = opened.join(crowd, "v").select("v", "x", "probe", F.pmod(F.xxhash64("x"), "nb").cast("int").alias("bt"), F.pmod(F.xxhash64("x", F.lit(1)), "nq").cast("int").alias("bq"), "nb", "nq").join(classes.select("x", "n", "sk"), "x")
    # pairs that have a pivot in common were compared there; a document is a pivot near itself
    around = near.groupBy("x").agg(F.collect_set("p").alias("ps"))
    waiting = waiting.join(around, "x", "left").withColumn("ps", F.concat(F.coalesce("ps", F.expr("cast(array() as array<bigint>)")), F.array("x")))
    far = waiting.select("v", "x", "n", F.col("sk").alias("s"), "ps", F.explode(F.concat(as_target, as_probe)).alias("e")).select("v", "x", "n", "s", "ps", "e.probe", "e.bt", "e.bq")
    far = far.groupBy("v", "bt", "bq").applyInArrow(_sketch_pairs(share), "x long, y long, n_a long, n_b long").distinct()
    far = _with(_with(far, sets, "x", "a"), sets, "y", "b").filter(_estimate(LEAST_LINK)).filter(_linked("s_a", "s_b", "n_a", "n_b", percent)).select(F.col("x").alias("a"), F.col("y").alias("b"))

    links = stars.union(in_blocks).union(far)
    twice = scratch.save(known.groupBy("doc_id").agg(F.min("digest").alias("d"), F.max("digest").alias("e")).filter("d <> e").select("doc_id"))
    if not twice.isEmpty():
        links = links.union(known.join(twice, "doc_id", "left_semi").join(classes.select("digest", "x"), "digest").select(F.col("doc_id").alias("a"), F.col("x").alias("b")))
    final = components(scratch, links)
    for table in (lists, members, sets, near, opened, twice):
        scratch.drop(table)  # the labels are written, and the result reads no other
    found = classes.select("digest", "x").join(final, F.col("x") == F.col("node"), "left").select("digest", F.coalesce("component", "x").alias("component"))
    rows = every.select("doc_id", "n", "digest").join(found, "digest", "left")
    component = F.when(F.col("doc_id").isNull(), None).otherwise(F.coalesce("component", "doc_id"))
    return rows.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), (F.col("doc_id").isNull() | (F.col("doc_id") == component)).alias("kept"), F.hex("digest").alias("set_digest"))


def deduplicated(spark: SparkSession, docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The documents that stay, one of each group, with all their columns; rows without doc_id stay, and so does each row of a doc_id that stays."""
    gone = near_duplicates(spark, docs, width, percent).filter("not kept").select("doc_id").alias("gone")
    return docs.alias("docs").join(gone, F.col("docs.doc_id") == F.col("gone.doc_id"), "left_anti")
