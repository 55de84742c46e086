"""Conflict-constrained best-fit packing of documents into bins of a fixed number of words.

Documents are dealt by hash to shards of bounded size and each shard is packed in one task. A text longer
than a bin is cut into full bins and a rest. Pieces come longest first; open bins are kept in order of
their residual, each with a bitmap of its sources and one of its duplicate clusters; from the tightest
bin that is large enough, the search goes on to the next until one holds neither the piece's source nor its
cluster. A new bin is opened if there is none.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, WORD

CAPACITY = 2048
#: Documents a shard has on average.
SHARD_ROWS = 4096

Item = tuple[int, object, object]


def pack(items: list[Item], capacity: int) -> list[int]:
    """Bin of each item (size, source, cluster); sizes are at most ``capacity``.

    Items are placed by falling size, equal ones in the given order. A null source or cluster conflicts with
    nothing.
    """
    sources: dict[object, int] = {}
    clusters: dict[object, int] = {}
    bins: list[tuple[int, int]] = []  # (residual, number), ascending
    held: list[list[int]] = []  # the two bitmaps of each bin
    out = [0] * len(items)
    for i in sorted(range(len(items)), key=lambda i: -items[i][0]):
        size, source, cluster = items[i]
        s = 0 if source is None else 1 << sources.setdefault(source, len(sources))
        c = 0 if cluster is None else 1 << clusters.setdefault(cluster, len(clusters))
        at = bisect_left(bins, (size, -1))
        while at < len(bins) and (held[bins[at][1]][0] & s or held[bins[at][1]][1] & c):
            at += 1
        if at < len(bins):
            residual, number = bins.pop(at)
        else:
            residual, number = capacity, len(held)
            held.append([0, 0])
        held[number][0] |= s
        held[number][1] |= c
        out[i] = number
        insort(bins, (residual - size, number))
    return out


def _packer(capacity: int):
    def one(pieces: pa.Table) -> pa.Table:
        pieces = pieces.sort_by([("doc_id", "ascending"), ("cluster", "ascending"), ("piece", "ascending")])
        shard, sizes, sources, clusters = (pieces.column(c).to_pylist() for c in ("shard", "n_words", "source", "cluster"))
        bins = pack(list(zip(sizes, sources, clusters, strict=True)), capacity)
        filled: dict[int, int] = {}
        for b, size in zip(bins, sizes, strict=True):
            filled[b] = filled.get(b, 0) + size
        return pa.table({
            "doc_id": pieces.column("doc_id"), "piece": pieces.column("piece"), "first_word": pieces.column("first_word"), "n_words": pieces.column("n_words"),
            "source": pieces.column("source"), "cluster": pieces.column("cluster"),
            "bin": pa.array([f"{s}-{b}" for s, b in zip(shard, bins, strict=True)], pa.string()), "bin_words": pa.array([filled[b] for b in bins], pa.int64()),
        })

    return one


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """A row for each piece: doc_id, piece, first_word, n_words, source, cluster, bin, bin_words.

    The cluster is a digest of the text in lower case with single spaces. Empty and null texts are one
    piece of no words, which fits any bin without a conflict; null sources conflict with nothing; repeated
    rows are copies and never share a bin. Pieces of one text are of one cluster. Other columns are not
    read. Memory: a shard, without texts.
    """
    if capacity < 1:
        raise ValueError("capacity must be positive")
    text = F.coalesce(F.col("text"), F.lit(""))
    plain = F.lower(F.trim(F.regexp_replace(text, f"{SPACE}+", " ")))
    rows = docs.select("doc_id", "source", F.md5(plain.cast("binary")).alias("cluster"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"), F.monotonically_increasing_id().alias("row"))
    shards = max(1, -(-docs.count() // shard_rows))
    # an id of many rows, such as null, would be one shard
    often = docs.groupBy("doc_id").agg(F.count("*").alias("n")).filter(F.col("n") > max(1, shard_rows // 4)).select(F.coalesce("doc_id", F.lit(-1)).alias("_id"), F.col("doc_id").isNull().alias("_null"))
    rows = rows.join(often, (F.coalesce("doc_id", F.lit(-1)) == F.col("_id")) & (F.col("doc_id").isNull() == F.col("_null")), "left")
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("doc_id", "cluster", F.when(F.col("_id").isNotNull(), F.col("row"))), F.lit(shards)).cast("int"))
    n = F.greatest(F.lit(1), F.ceil(F.col("words") / capacity)).cast("int")
    pieces = rows.select("shard", "doc_id", "source", F.when(F.col("words") > 0, F.col("cluster")).alias("cluster"), "words", F.explode(F.sequence(F.lit(0), n - 1)).alias("piece"))
    first = F.col("piece").cast("long") * capacity
    pieces = pieces.select("shard", "doc_id", "source", "cluster", F.col("piece").cast("long").alias("piece"), first.alias("first_word"), F.least(F.lit(capacity), F.col("words") - first).cast("long").alias("n_words"))
    return pieces.groupBy("shard").applyInArrow(_packer(capacity), "doc_id long, piece long, first_word long, n_words long, source string, cluster string, bin string, bin_words long")
