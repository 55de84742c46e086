"""Keyword search: an inverted index with Okapi BM25, and rank fusion of channels."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..session import cut
from .sequences import tokens

K1, B, FLOOR = 1.5, 0.75, 0.25


#: Files of an index's terms, at most.
BUCKETS = 32
#: Postings to look up from which it pays to leave some out.
PRUNE_FROM = 20_000_000
#: Postings to look up in one item from which its documents are scored where they are, and words of queries that may be sent to every task for it.
IN_PLACE_FROM, FEW_WORDS = 2_000_000, 200_000
#: Gains of documents, and scores, that are in memory at once.
GAINS, CELLS = 1 << 20, 1 << 20
#: Scores are rounded to 5 decimals; a bound must fall short by more to exclude a document.
SLACK = 1e-4


def _part(tf, dl, avgdl):
    """A document's share of the score per idf."""
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avgdl))


@dataclass(frozen=True)
class Index:
    """A written index: documents (item, id, dl, terms, tfs), a row with its sorted terms and their counts each, and terms (item, term, df, idf, most, avgdl).

    ``most`` is the greatest share of the score per idf that a term gives a document, ``avgdl`` the mean length of the item's documents.
    """

    documents: DataFrame
    terms: DataFrame

    @property
    def postings(self) -> DataFrame:
        """(item, id, dl, term, tf)"""
        return _unfolded(self.documents, "item", "id", "dl")


def _unfolded(documents: DataFrame, *columns: str) -> DataFrame:
    return documents.select(*columns, F.inline(F.arrays_zip("terms", "tfs")).alias("term", "tf"))


def write_index(docs: DataFrame, path: str, id: str, text: str, item: str | None = None, buckets: int = BUCKETS) -> Index:
    """Write an index of ``docs`` to ``path``; each ``item`` is a corpus by itself, or all documents are one.

    idf is ln(n - df + 0.5) - ln(df + 0.5); negative ones become FLOOR times the mean of the item's. An id is one document's within its item. Texts are
    read once: a text's words are sorted, counted and written by the task that reads it, and only counts of terms are shuffled.
    """
    spark = docs.sparkSession
    of = F.lit(0).cast("long") if item is None else F.col(item).cast("long")
    words = docs.select(of.alias("item"), F.col(id).alias("id"), F.sort_array(tokens(F.col(text))).alias("ws")).select("*", F.size("ws").alias("dl"))
    first = F.filter(F.sequence(F.lit(1), F.col("dl")), lambda i: (i == 1) | (F.get("ws", i - 1) != F.get("ws", i - 2)))
    words = words.withColumn("first", F.when(F.col("dl") > 0, first))
    tfs = F.transform("first", lambda i, p: F.coalesce(F.get("first", p + 1), F.col("dl") + 1) - i)
    kept = words.select("item", "id", "dl", F.transform("first", lambda i: F.get("ws", i - 1)).alias("terms"), tfs.alias("tfs"))
    kept.write.parquet(f"{path}/postings")
    documents = spark.read.schema(kept.schema).parquet(f"{path}/postings")
    documents.groupBy("item").agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl")).write.parquet(f"{path}/totals")
    totals = spark.read.parquet(f"{path}/totals")
    totals = F.broadcast(totals) if item is None else totals  # one row then
    parts = _unfolded(documents.join(totals, "item"), "item", "dl", "avgdl").select("item", "term", _part(F.col("tf"), F.col("dl"), F.col("avgdl")).alias("part"))
    df = parts.groupBy("item", "term").agg(F.count("*").alias("df"), F.max("part").alias("most")).join(totals, "item")
    raw = df.withColumn("raw", F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    raw.drop("n").write.parquet(f"{path}/raw")
    raw = spark.read.parquet(f"{path}/raw")
    mean = raw.groupBy("item").agg(F.avg("raw").alias("mean"))
    terms = raw.join(F.broadcast(mean) if item is None else mean, "item").select("item", "term", "df", F.when(F.col("raw") < 0, FLOOR * F.col("mean")).otherwise(F.col("raw")).alias("idf"), "most", "avgdl")
    terms.coalesce(buckets).write.parquet(f"{path}/terms")
    return Index(documents, spark.read.parquet(f"{path}/terms"))


def read_index(spark: SparkSession, path: str) -> Index:
    return Index(spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/terms"))


def _best_of(asked: pa.Table, k: int):
    """The k best documents for each query among those of a task; ``asked`` are the (query_id, term, w, avgdl) of an item."""
    queries, terms = pc.unique(asked["query_id"]), pc.unique(asked["term"])
    t, q = (pc.index_in(asked[c], value_set=x).to_numpy() for c, x in (("term", terms), ("query_id", queries)))
    order = np.argsort(t, kind="stable")
    q, w = q[order], asked["w"].to_numpy()[order]
    start = np.searchsorted(t[order], np.arange(len(terms) + 1))
    avgdl, n = asked["avgdl"][0].as_py(), len(queries)

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, least, full = None, np.zeros(n), np.zeros(n, bool)
        for batch in batches:
            term = pc.fill_null(pc.index_in(batch["terms"].flatten(), value_set=terms), -1).to_numpy(zero_copy_only=False)
            known = term >= 0
            doc = np.repeat(np.arange(batch.num_rows), batch["terms"].value_lengths().to_numpy(zero_copy_only=False))[known]
            part = _part(batch["tfs"].flatten().to_numpy()[known].astype(np.float64), batch["dl"].to_numpy()[doc], avgdl)
            term = term[known]
            each = start[term + 1] - start[term]
            gains = np.concatenate([[0], np.cumsum(np.bincount(doc, each, minlength=batch.num_rows))])
            a = 0
            while a < batch.num_rows:
                b = min(max(int(np.searchsorted(gains, gains[a] + GAINS, "right")) - 1, a + 1), a + max(1, CELLS // n), batch.num_rows)
                lo, hi = np.searchsorted(doc, (a, b))
                times = each[lo:hi]
                at = np.repeat(np.arange(lo, hi), times)
                row = np.arange(len(at)) + np.repeat(start[term[lo:hi]] - np.cumsum(times) + times, times)
                raw = np.bincount((doc[at] - a) * n + q[row], w[row] * part[at], minlength=(b - a) * n).reshape(-1, n)
                raw = np.floor(raw * 1e5 + 0.5) / 1e5
                bar = least if full.all() or b - a < k else np.maximum(least, np.partition(raw, -k, axis=0)[-k])
                i, j = np.nonzero((raw > 0) & (raw >= bar))
                new = pa.table({"q": j, "raw": raw[i, j], "id": batch["id"].take(pa.array(i + a))})
                kept = new if kept is None else pa.concat_tables([kept, new])
                kept = kept.take(pc.sort_indices(kept, sort_keys=[("q", "ascending"), ("raw", "descending"), ("id", "ascending")]))
                of = kept["q"].to_numpy()
                place = np.arange(len(of)) - np.searchsorted(of, of)
                full[of[place == k - 1]], least[of[place == k - 1]] = True, kept["raw"].to_numpy()[place == k - 1]
                kept = kept.filter(pa.array(place < k))
                a = b
        if kept is not None:
            yield from pa.table({"query_id": queries.take(kept["q"]), "id": kept["id"], "raw": kept["raw"]}).combine_chunks().to_batches()

    return best


def bm25_search(index: Index, queries: DataFrame, k: int, prune: bool | None = None) -> DataFrame:
    """(query_id, item, id, raw, score, rank): the k best documents with a positive score of each query in its item.

    ``queries`` are (query_id, item, query); repeated words of a query count again. The score is raw / 10, at most 1.

    With ``prune``, the stronger half of a query's words is looked up first. The k-th best score by these is a threshold: where the other
    words together could not reach it, they are looked up only for documents that they could still lift above it. So
    the long lists of common words are joined with few documents, and the result is the same. Unless it is given, ``prune`` is whether the
    queries' lists have more than PRUNE_FROM postings in all.

    Without ``prune``, queries of one item with up to FEW_WORDS words and more than IN_PLACE_FROM postings are sent to every task instead, which scores its documents one
    after the other and leaves the k best for each query: no gain is shuffled or written.
    """
    keys = ["query_id", "item"]
    asked = queries.select(*keys, F.explode(tokens(F.col("query"))).alias("term")).groupBy(*keys, "term").agg(F.count("*").alias("times"))
    asked = cut(asked.join(index.terms, ["item", "term"]).select(*keys, "term", "df", (F.col("times") * F.col("idf")).alias("w"), (F.col("times") * F.col("idf") * F.col("most")).alias("bound"), "avgdl"))
    best = Window.partitionBy(*keys).orderBy(F.desc("raw"), "id")
    ranked = lambda raw: raw.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select(*keys, "id", "raw", F.least(F.col("raw") / 10, F.lit(1.0)).alias("score"), "rank")
    if prune is None:
        n, most, one, other = asked.agg(F.count("*"), F.coalesce(F.sum("df"), F.lit(0)), F.min("item"), F.max("item")).first()
        if IN_PLACE_FROM < most and n <= FEW_WORDS and one == other:
            of = index.documents.filter((F.col("item") == one) & (F.col("dl") > 0)).select("id", "dl", "terms", "tfs")
            schema = StructType([asked.schema["query_id"], of.schema["id"], StructField("raw", DoubleType())])
            return ranked(of.mapInArrow(_best_of(asked.select("query_id", "term", "w", "avgdl").toArrow(), k), schema).withColumn("item", F.lit(one)))
        prune = most > PRUNE_FROM
    looked_up = lambda a: index.postings.join(a, ["item", "term"]).select(*keys, "id", (F.col("w") * _part(F.col("tf"), F.col("dl"), F.col("avgdl"))).alias("gain"))
    rounded = F.floor(F.col("raw") * 1e5 + 0.5) / 1e5
    if prune:
        w = Window.partitionBy(*keys)
        asked = cut(asked.withColumn("r", F.row_number().over(w.orderBy(F.desc("bound"), "term"))).withColumn("m", F.count("*").over(w)).withColumn("sound", F.min("w").over(w) >= 0))
        first = asked.filter("2 * r <= m + 1")
        partial = cut(looked_up(first).groupBy(*keys, "id").agg(F.sum("gain").alias("gain")))
        threshold = partial.withColumn("r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("gain")))).filter(F.col("r") == k).select(*keys, F.col("gain").alias("least"))
        rest = asked.filter("2 * r > m + 1").groupBy(*keys).agg(F.sum("bound").alias("others"), F.first("sound").alias("sound"))
        rest = rest.join(threshold, keys, "left").withColumn("closed", F.coalesce(F.col("sound") & (F.col("others") < F.col("least") - SLACK), F.lit(False)))
        weak = asked.filter("2 * r > m + 1").join(rest.select(*keys, "closed"), keys)
        # a closed query's other words only count for documents that may still be among the best
        near = partial.join(rest.filter("closed"), keys).filter(F.col("gain") + F.col("others") >= F.col("least") - SLACK).select(*keys, "id")
        more = looked_up(weak.filter("not closed").drop("closed")).unionByName(looked_up(weak.filter("closed").drop("closed")).join(near, [*keys, "id"], "left_semi"))
        gains = partial.unionByName(more)
    else:
        gains = looked_up(asked)
    raw = gains.groupBy(*keys, "id").agg(F.sum("gain").alias("raw")).withColumn("raw", rounded).filter("raw > 0")
    return ranked(raw)


WEIGHTS = {"structured": 3.0, "metadata": 2.0, "keyword": 1.0, "vector": 1.0}
CHANNELS = ("structured", "keyword", "vector", "metadata")


def channel_order(channel: Column) -> Column:
    out = F.lit(len(CHANNELS))
    for i, name in enumerate(CHANNELS):
        out = F.when(channel == name, i).otherwise(out)
    return out


def fuse(segments: DataFrame, threshold: float = 0.35, band: tuple[float, float] = (0.35, 0.55), base: int = 60, keys: tuple[str, ...] = ("media_id",), limit: Column | None = None) -> DataFrame:
    """Weighted reciprocal-rank fusion of segments (keys, channel, id, start_us, end_us, score, evidence), within ``keys``: each media item, and request.

    Segments of a channel rank by falling score, then start, end and id. Those whose times agree to 10 ms are
    one; each adds weight / (base + rank + 1). The sum times base, at most 1, is the score; under half the threshold (``limit``, if it
    depends on the keys) it is dropped, in the band it needs confirmation. Times are those seen first: by channel, then rank. A
    column scene_id gives the array of an interval's scenes.
    """
    by_score = Window.partitionBy(*keys, "channel").orderBy(F.desc("score"), "start_us", "end_us", "id")
    ranked = segments.withColumn("r", F.row_number().over(by_score) - 1)
    weight = F.lit(0.0)
    for name, w in WEIGHTS.items():
        weight = F.when(F.col("channel") == name, w).otherwise(weight)
    key = lambda c: F.expr(f"({c} + 5000) div 10000")
    seq = F.struct(channel_order(F.col("channel")).alias("c"), "r")
    scene = "scene_id" in segments.columns
    parts = ranked.select(*keys, key("start_us").alias("ks"), key("end_us").alias("ke"), "start_us", "end_us", seq.alias("seq"), (weight / (base + F.col("r") + 1)).alias("w"), "evidence", "channel", *(["scene_id"] if scene else []))
    fused = parts.groupBy(*keys, "ks", "ke").agg(
        F.sum("w").alias("sum"), F.min_by(F.struct("start_us", "end_us"), "seq").alias("first"),
        F.transform(F.array_sort(F.collect_list(F.struct("seq", "evidence"))), lambda s: s["evidence"]).alias("evidence"), F.size(F.collect_set("channel")).cast("long").alias("channels"),
        *([F.array_sort(F.collect_set("scene_id")).alias("scene_ids")] if scene else []),
    )
    score = F.least(F.floor(base * F.col("sum") * 1e6 + 0.5) / 1e6, F.lit(1.0))
    scored = fused.select(*keys, "first.start_us", "first.end_us", score.alias("score"), "evidence", "channels", *(["scene_ids"] if scene else []))
    least = F.lit(threshold / 2) if limit is None else limit / 2
    return scored.filter(F.col("score") >= least).withColumn("needs_confirmation", (F.col("score") >= band[0]) & (F.col("score") <= band[1]))
