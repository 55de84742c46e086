"""Sharding by a two-pass external shuffle.

The first pass scatters the records uniformly, by a seeded hash, into buckets that fit in memory; the second one puts each bucket
in random order by a seeded Fisher-Yates shuffle and writes it. The buckets one after the other are a random order of all
records, and shards are equal stretches of it. Copies of a text are records like others, so they are scattered too.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch

SHARDS = 24
SEED = 42
#: Bytes of texts in a bucket, on average.
BUCKET_BYTES = 16 << 20
#: Rows from which a doc_id's records are scattered by their place in the table too, as they would be one bucket.
OFTEN = 1024
#: Bytes that a record has besides its text.
RECORD_BYTES = 8
#: Ids of more than OFTEN rows, and buckets, up to which their tables (16 bytes each) are broadcast; both are counted.
BROADCAST_ROWS = 1_000_000


def fisher_yates(n: int, seed: list[int]) -> np.ndarray:
    """A random order of n records: from the last to the second, each changes places with one that is not behind it."""
    order = list(range(n))
    partners = np.random.default_rng(seed).integers(0, np.arange(n, 1, -1)).tolist() if n > 1 else []
    for i, j in zip(range(n - 1, 0, -1), partners, strict=True):
        order[i], order[j] = order[j], order[i]
    return np.array(order, np.int64)


def _shuffler(seed: int):
    def run(key: tuple[pa.Scalar, ...], batches: pa.Table) -> pa.Table:
        bucket = batches.combine_chunks()
        place = np.lexsort((np.array(bucket.column("row")), np.array(bucket.column("hash"))))
        order = place[fisher_yates(bucket.num_rows, [seed, key[0].as_py()])]
        return pa.table({"bucket": bucket.column("bucket"), "place": pa.array(np.arange(bucket.num_rows)), "record": bucket.column("record").take(pa.array(order))})

    return run


def shuffle_into_shards(spark: SparkSession, docs: DataFrame, shards: int = SHARDS, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """The documents, all rows and columns, with their ``shard`` (0 to shards - 1) and their ``slot`` in it, gapless from 0.

    Numbers of rows of any two shards differ by one at most. Columns called shard or slot are replaced. The seed, doc_id and text decide the order; which of
    rows that agree in both comes first depends on their place in the table, and so does the bucket of ids
    that more than OFTEN rows have, null among them. Null texts count as empty. No rows: an empty result. A bucket holds
    ``bucket_bytes`` on average, or a longer text; nothing larger is in memory, and the driver gets three totals.
    """
    if shards < 1 or bucket_bytes < 1:
        raise ValueError("shards and bucket_bytes must be positive")
    scratch = Scratch(spark, "sharding")
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + RECORD_BYTES
    n, total = docs.agg(F.count("*"), F.coalesce(F.sum(size), F.lit(0))).first()
    buckets = max(1, -(-total // bucket_bytes))
    often = docs.groupBy("doc_id").agg(F.count("*").alias("n")).filter(F.col("n") > OFTEN).select(F.coalesce("doc_id", F.lit(-1)).alias("_id"), F.col("doc_id").isNull().alias("_null"))
    often = scratch.save(often)
    n_often = often.count()
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("record"), F.monotonically_increasing_id().alias("row"))
    doc_id, place = F.col("record.doc_id"), F.lit(None)
    if n_often:
        # beyond the bound the records are shuffled once more
        often = F.broadcast(often) if n_often <= BROADCAST_ROWS else often
        rows = rows.join(often, (F.coalesce(doc_id, F.lit(-1)) == F.col("_id")) & (doc_id.isNull() == F.col("_null")), "left")
        place = F.when(F.col("_id").isNotNull(), F.col("row"))
    rows = rows.select(F.xxhash64(F.lit(seed), doc_id, "record.text", place).alias("hash"), "row", "record")
    scattered = rows.select(F.pmod(F.xxhash64(F.lit(seed), "hash"), F.lit(buckets)).alias("bucket"), "hash", "row", "record")
    schema = T.StructType([T.StructField("bucket", T.LongType()), T.StructField("place", T.LongType()), T.StructField("record", rows.schema["record"].dataType)])
    shuffled = scratch.save(scattered.groupBy("bucket").applyInArrow(_shuffler(seed), schema))

    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = shuffled.groupBy("bucket").agg(F.count("*").alias("n")).select("bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    offsets = F.broadcast(offsets) if buckets <= BROADCAST_ROWS else offsets
    at = F.col("offset") + F.col("place")
    placed = shuffled.join(offsets, "bucket").select("record", at.alias("at"), F.expr(f"(offset + place) * {shards} div {max(1, n)}").alias("shard"))
    slot = F.col("at") - F.expr(f"(shard * {n} + {shards - 1}) div {shards}")
    kept = [F.col(f"record.`{c}`") for c in docs.columns if c.lower() not in ("shard", "slot")]
    return placed.select(*kept, F.col("shard").cast("int").alias("shard"), slot.alias("slot"))


def write_shards(sharded: DataFrame, path: str) -> None:
    """Write the result of shuffle_into_shards as Parquet, a folder for each shard; the rows of a file are in order of their slot."""
    sharded.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def query_sharding(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Where every document goes, by the law ``rows``."""
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + RECORD_BYTES
    check = F.crc32(F.coalesce("text", F.lit("")).cast("binary"))
    return shuffle_into_shards(spark, docs).select("doc_id", size.alias("size"), check.alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
