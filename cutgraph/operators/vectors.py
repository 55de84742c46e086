"""Dense vectors as arrays: inner products, centroids, exact top-k in tiles of queries and rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType


def inner(a: Column | str, b: Column | str) -> Column:
    """Inner product in double precision; null where either is null."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column | str) -> Column:
    return F.sqrt(inner(a, a))


def unit(a: Column | str) -> Column:
    """The vector at length one; a zero vector is null."""
    c = F.col(a) if isinstance(a, str) else a
    n = norm(c)
    return F.when(n > 0, F.transform(c, lambda x: x.cast("double") / n))


def centroids(df: DataFrame, keys: list[str], vector: str) -> DataFrame:
    """(keys, centroid): the mean of each group's vectors at length one; dimensions are averaged apart."""
    mean = df.select(*keys, F.posexplode(vector).alias("_i", "_x")).groupBy(*keys, "_i").agg(F.avg(F.col("_x").cast("double")).alias("_m"))
    whole = mean.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_i", "_m"))).alias("_v"))
    return whole.select(*keys, unit(F.transform("_v", lambda s: s["_m"])).alias("centroid"))


#: Rows and queries of a tile, about, and those whose scores are in memory at once.
ROWS, QUERIES = 32768, 16384
ROWS_AT_ONCE, QUERIES_AT_ONCE = 4096, 256


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    values = np.concatenate([np.zeros(0), *(np.asarray(c.flatten(), np.float64) for c in column.chunks)])
    return values.reshape(len(column), values.size // max(1, len(column)))


def _tile(k: int, places: int | None, query_id: str, id: str):
    """The k best rows of a tile for each of its queries: products of matrices leave few pairs, whose scores are summed in order of the dimensions."""
    step = 0.0 if places is None else 10.0**-places

    def tile(rows: pa.Table, asked: pa.Table) -> pa.Table:
        rows = rows.take(pc.sort_indices(rows, sort_keys=[(id, "ascending")], null_placement="at_end"))
        x, q = _matrix(rows["_v"]), _matrix(asked["_q"])
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        with np.errstate(all="ignore"):
            # by so much may two orders of summation differ
            apart = (x.shape[1] + 8) * 2.0**-52 * np.sqrt((q**2).sum(1)) * np.sqrt((x**2).sum(1)).max(initial=0) + 1e-300
            xt = np.ascontiguousarray(x.T)
            for a in range(0, len(q), QUERIES_AT_ONCE):
                some, slack = q[a : a + QUERIES_AT_ONCE], apart[a : a + QUERIES_AT_ONCE]
                qt = np.ascontiguousarray(some.T)
                who, at, score = found[0]
                full, least = np.zeros(len(some), bool), np.full(len(some), -np.inf)
                for b in range(0, len(x), ROWS_AT_ONCE):
                    near = some @ xt[:, b : b + ROWS_AT_ONCE]
                    # rows come in order of id: once there are k, only a higher score displaces one
                    bar = least + 0.499 * step - 2 * slack
                    if not full.all():
                        first = np.partition(near, -k, axis=1)[:, -k] - 1.01 * step - 4 * slack if near.shape[1] >= k and not np.isnan(near).any() else -np.inf
                        bar = np.where(full, bar, first)
                    i, j = np.nonzero(~(near < bar[:, None]))
                    s = np.zeros(len(i))
                    for d in range(len(xt)):
                        s += xt[d, b : b + ROWS_AT_ONCE][j] * qt[d][i]
                    if places is not None:
                        s = np.floor(s * 10.0**places + 0.5) / 10.0**places
                    who, at, score = np.concatenate([who, i]), np.concatenate([at, j + b]), np.concatenate([score, s])
                    order = np.lexsort((at, -score, ~np.isnan(score), who))  # NaN is the greatest, as in SQL
                    who, at, score = who[order], at[order], score[order]
                    place = np.arange(len(who)) - np.searchsorted(who, who)
                    full[who[place == k - 1]], least[who[place == k - 1]] = True, score[place == k - 1]
                    who, at, score = who[place < k], at[place < k], score[place < k]
                found.append((who + a, at, score))
        who, at, score = map(np.concatenate, zip(*found, strict=True))
        return pa.table({query_id: asked[query_id].take(pa.array(who)), id: rows[id].take(pa.array(at)), "score": pa.array(score)})

    return tile


def top_k(queries: DataFrame, vectors: DataFrame, k: int, query_id: str, id: str, vector: str, places: int | None = None) -> DataFrame:
    """(query_id, id, score, rank) of the k best vectors of each query. With ``places``, scores are rounded before they rank; equal ones rank by id.

    Every query is scored with every vector, so work grows as their product. Both are counted and dealt by hash to blocks of about QUERIES and ROWS, and each pair of blocks is a
    tile, scored by a product of matrices. The best of a tile are scored again as ``inner`` does and ranked, so that the result doesn't depend on the
    tiles; a tile leaves k rows for each of its queries. What is shuffled are the rows, once for each block of queries, and the queries, once for each block of
    rows. Vectors that are null, have a null component or another length than the query's have no score with it.
    """
    n_rows, n_queries = max(1, -(-vectors.count() // ROWS)), max(1, -(-queries.count() // QUERIES))
    known = F.col(vector).isNotNull() & ~F.exists(vector, lambda x: x.isNull())
    block = lambda key, n: F.pmod(F.xxhash64(key, vector), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    held = lambda df: F.col(vector) if "array<float>" in df.schema[vector].dataType.simpleString() else F.col(vector).cast("array<double>")
    left = vectors.filter(known).select(id, held(vectors).alias("_v"), F.size(vector).alias("_n"), block(id, n_rows).alias("_r"), each(n_queries).alias("_b"))
    right = queries.filter(known).select(query_id, held(queries).alias("_q"), F.size(vector).alias("_n"), block(query_id, n_queries).alias("_b"), each(n_rows).alias("_r"))
    schema = StructType([queries.schema[query_id], vectors.schema[id], StructField("score", DoubleType())])
    tile = ["_n", "_r", "_b"]
    scored = left.groupBy(*tile).cogroup(right.groupBy(*tile)).applyInArrow(_tile(k, places, query_id, id), schema)
    best = Window.partitionBy(query_id).orderBy(F.desc("score"), F.asc_nulls_last(id))
    return scored.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


#: Rows of a registry that go to every task as they are.
FEW = 4096


def best_match(df: DataFrame, registry: DataFrame, id: str, vector: str, label: str, centroid: str, places: int = 5, few: int = FEW) -> DataFrame:
    """(id, label, score): for each row the registered vector with the greatest cosine, the smallest label of equal ones; null vectors match nothing.

    The registry is counted: up to ``few`` rows are broadcast, a larger one is dealt to blocks of that size, each of which every row meets; a row
    keeps one match of a block.
    """
    n = registry.count()
    own = df.select(id, unit(vector).alias("_v")).filter("_v is not null")
    known = registry.select(F.col(label).alias("_label"), F.col(centroid).alias("_c"))
    score = F.floor(inner("_v", "_c") * 10**places + 0.5) / 10**places
    if n <= few:
        met = own.join(F.broadcast(known))
    else:
        blocks = -(-n // few)
        dealt = known.withColumn("_b", F.pmod(F.xxhash64("_label"), F.lit(blocks)))
        # rows are dealt too, so that a block of the registry isn't one task
        spread = [F.lit(i) for i in range(blocks)]
        dealt = dealt.withColumn("_s", F.explode(F.array(*spread)))
        met = own.withColumn("_s", F.pmod(F.xxhash64(id), F.lit(blocks)).cast("int")).withColumn("_b", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))).join(dealt, ["_b", "_s"])
    best = met.select(id, "_label", score.alias("_score")).groupBy(id).agg(F.max("_score").alias("score"), F.min_by("_label", F.struct(-F.col("_score"), "_label")).alias(label))
    return best.select(id, label, "score")


def similar_pairs(df: DataFrame, id: str, vector: str, least: float, axes: int = 3) -> DataFrame:
    """(a, b, similarity) of all pairs a < b of unit vectors with an inner product of ``least`` or more.

    Such vectors lie at most sqrt(2 - 2 * least) apart, and so in no coordinate farther: they are in the same or in neighbouring cells
    of a grid of that width over the first ``axes`` coordinates, where they meet. Equal rows should be grouped before.
    """
    width = (2 - 2 * least) ** 0.5 + 1e-9
    cell = [F.floor(F.get(vector, F.lit(i)).cast("double") / width).cast("long") for i in range(axes)]
    right = df.select(F.col(id).alias("b"), F.col(vector).alias("_y"), *(c.alias(f"_c{i}") for i, c in enumerate(cell)))
    left = df.select(F.col(id).alias("a"), F.col(vector).alias("_x"), *(c.alias(f"_c{i}") for i, c in enumerate(cell)))
    for i in range(axes):
        left = left.withColumn(f"_c{i}", F.explode(F.array(*(F.col(f"_c{i}") + d for d in (-1, 0, 1)))))
    met = left.join(right, [f"_c{i}" for i in range(axes)]).filter("a < b")
    return met.select("a", "b", inner("_x", "_y").alias("similarity")).filter(F.col("similarity") >= least - 1e-9)
