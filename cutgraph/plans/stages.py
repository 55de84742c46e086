"""Ingestion of many media items as tables: which stages of which items are done, may run, wait or are blocked.

The log of jobs is append-only: (media_id, stage, seq, status, version, attempts, updated_us), status running, done or failed; of an item's
stage the row with the greatest ``seq`` holds. A wave takes all runnable stages of all items at once and hands each stage the items that need
it as a DataFrame, so the work is done by Spark and a stopped ingestion goes on from the log.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..session import cut, folder


@dataclass(frozen=True)
class Stage:
    needs: tuple[str, ...]
    version: str
    pool: str
    lease_us: int


S = 1_000_000
# Stages, what they need, their versions, the pool that they use and how long they may run.
STAGES = {
    "normalize": Stage((), "2.0", "cpu", 300 * S),
    "audio": Stage(("normalize",), "2.0", "cpu", 600 * S),
    "scenes": Stage(("normalize",), "2.0", "cpu", 300 * S),
    "faces": Stage(("scenes",), "3.0", "cpu", 600 * S),
    "cut_affinity": Stage(("audio",), "1.0", "cpu", 300 * S),
    "audio_separation": Stage(("normalize",), "1.0", "cpu", 1200 * S),
    "beat_grid": Stage(("audio_separation",), "1.0", "cpu", 300 * S),
    "vision": Stage(("scenes", "audio", "faces"), "2.0", "api", 600 * S),
    "graph": Stage(("audio", "vision"), "2.0", "cpu", 300 * S),
    "index": Stage(("graph",), "2.0", "cpu", 300 * S),
    "story": Stage(("index",), "2.0", "api", 600 * S),
}
# How many stages of an item may run at once in a pool, and how often a stage is tried.
POOLS = {"cpu": 2, "gpu": 1, "api": 2}
ATTEMPTS = 3
NEEDS: dict[str, tuple[str, ...]] = {name: s.needs for name, s in STAGES.items()}
LOG = "media_id long, stage string, seq long, status string, version string, attempts long, updated_us long"


def levels(needs: dict[str, tuple[str, ...]] = NEEDS) -> dict[str, int]:
    """Depth of each stage; a cycle raises ValueError."""
    done: dict[str, int] = {}
    while len(done) < len(needs):
        ready = {s: 1 + max((done[n] for n in ns), default=-1) for s, ns in needs.items() if s not in done and all(n in done for n in ns)}
        if not ready:
            raise ValueError("the stages have a cycle")
        done |= ready
    return done


#: Nodes up to which a graph is one row; it has as many edges as their square at most.
SMALL = 64


def levels_of(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(g, node, level) of many graphs at once, from (g, node) and (g, node, needs): the longest way to each node from one that needs nothing.

    Rows may be repeated, and edges are between nodes of their graph. Graphs of up to SMALL nodes (repeated rows count) are levelled by the batch, each
    within its row; larger ones by rounds of joins. A cycle raises ValueError: a node would be deeper than its graph has nodes.
    """
    big = cut(nodes.groupBy("g").agg(F.count("*").alias("n")).filter(F.col("n") > SMALL).select("g"))
    if big.isEmpty():
        return _levels_in_rows(nodes, edges)
    of = lambda how: (df.join(big, "g", how) for df in (nodes, edges))
    return _levels_in_rows(*of("left_anti")).unionByName(_levels_by_rounds(*of("left_semi")))


def _levels_in_rows(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Levels of graphs that are rows with their nodes and edges; all graphs of a batch go up together, as often as its deepest one has levels."""
    schema = StructType([nodes.schema["g"], nodes.schema["node"], StructField("level", IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, e = b.column("nodes"), b.column("edges")
            rows = np.concatenate([pc.list_parent_indices(x).to_numpy().astype("int64") for x in (n, e, e)])
            flat = [n.flatten().field("node"), e.flatten().field("node"), e.flatten().field("needs")]
            values = pa.concat_arrays(flat).dictionary_encode(null_encoding="encode")
            known, at = np.unique(rows * len(values.dictionary) + values.indices.to_numpy(), return_inverse=True)
            given, node, needs = np.split(at, [len(flat[0]), len(flat[0]) + len(flat[1])])
            graph = known // max(len(values.dictionary), 1)
            size, cyclic = np.bincount(graph, minlength=b.num_rows), np.zeros(b.num_rows, bool)
            level = np.full(len(known), -1)
            level[given] = 0
            while True:
                up = level.copy()
                reached = (level[needs] >= 0) & ~cyclic[graph[node]]
                np.maximum.at(up, node[reached], level[needs[reached]] + 1)
                if (up == level).all():
                    break
                level = up
                cyclic[graph[level >= size[graph]]] = True
            out = level >= 0
            columns = [b.column("g").take(pa.array(graph[out])), values.dictionary.take(pa.array(known[out] % max(len(values.dictionary), 1)))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(level[out], pa.int32(), mask=cyclic[graph[out]])], ["g", "node", "level"])

    # nodes are in structs so that a null is kept
    each = nodes.groupBy("g").agg(F.collect_set(F.struct("node")).alias("nodes"))
    links = edges.filter("needs is not null").groupBy("g").agg(F.collect_set(F.struct("node", "needs")).alias("edges"))
    path = folder(nodes.sparkSession, "levels")
    each.join(links, "g", "left").mapInArrow(run, schema).write.parquet(path)
    level = nodes.sparkSession.read.schema(schema).parquet(path)
    if not level.filter("level is null").isEmpty():
        raise ValueError("the stages have a cycle")
    return level


def _levels_by_rounds(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """A round takes all nodes a level up that need one of the last round's; there are as many rounds as the deepest graph has levels. Only
    whether a round has rows reaches the driver.
    """
    nodes, edges = nodes.select("g", "node").distinct(), edges.select("g", "node", "needs").distinct()
    size = nodes.groupBy("g").agg(F.count("*").alias("size"))
    level = cut(nodes.select("g", "node", F.lit(0).alias("level")))
    edges, now, depth = cut(edges.select("g", "node", "needs")), level, 0
    while not now.isEmpty():
        depth += 1
        now = cut(edges.join(now.select("g", F.col("node").alias("needs")), ["g", "needs"]).select("g", "node").distinct().withColumn("level", F.lit(depth)))
        if not now.join(size, "g").filter("level >= size").isEmpty():
            raise ValueError("the stages have a cycle")
        level = cut(level.unionByName(now).groupBy("g", "node").agg(F.max("level").alias("level")))
    return level


def above(stage: str, stages: dict[str, Stage] = STAGES) -> set[str]:
    """All stages that a stage needs, directly or not."""
    out: set[str] = set()
    left = list(stages[stage].needs)
    while left:
        s = left.pop()
        if s not in out:
            out.add(s)
            left += stages[s].needs
    return out


def _of_stage(pick: Callable[[Stage], object], stages: dict[str, Stage], kind: str) -> Column:
    out = F.lit(None).cast(kind)
    for name, s in stages.items():
        out = F.when(F.col("stage") == name, F.lit(pick(s)).cast(kind)).otherwise(out)
    return out


def states(log: DataFrame, items: DataFrame, now_us: int, stages: dict[str, Stage] = STAGES, pools: dict[str, int] = POOLS) -> DataFrame:
    """(media_id, stage, state, attempts, seq, claimed) of every stage of every item, ``claimed`` those that run next.

    done: finished by the stage's present version (another version's result is made again). failed: tried ATTEMPTS times. blocked: needs
    a failed stage. running: begun, and its lease isn't over; an expired lease is taken back. backoff: failed lately, 1, 2, ... seconds
    ago at most, by attempts. ready: all that it needs is done. waiting: else. Of the ready stages of an item as many are claimed as the
    stage's pool has places beside those that run, in the order of their depth. Rows of unknown stages or items count for nothing.

    An item's rows become one, with a column for each stage, and everything else is a function of it: nothing is sorted or counted after the
    rows of an item met, and its stages are only made rows at the end.
    """
    names = sorted(stages)
    place = {n: i for i, n in enumerate(names)}
    row = F.struct("seq", "status", "version", "attempts", "updated_us")
    # the row with the greatest seq holds, of equal ones that with the greatest status by name
    jobs = log.filter(F.col("stage").isin(*names)).groupBy("media_id").agg(*(F.max(F.when(F.col("stage") == n, row)).alias(f"j{i}") for n, i in place.items()))
    each = items.select("media_id").distinct().join(jobs, "media_id", "left")

    def own(n: str) -> Column:
        j = lambda field: F.col(f"j{place[n]}")[field]
        since = F.lit(now_us) - j("updated_us")
        return (
            F.when((j("status") == "done") & (j("version") == stages[n].version), "done")
            .when((j("status") == "running") & (since <= stages[n].lease_us), "running")
            .when((j("status") == "failed") & (j("attempts") >= ATTEMPTS), "failed")
            .when((j("status") == "failed") & (since < F.pow(F.lit(2.0), j("attempts") - 1) * S), "backoff")
            .otherwise("pending")
        )

    rest = [*(F.coalesce(F.col(f"j{i}")[field], F.lit(0).cast("long")).alias(f"{field}{i}") for i in place.values() for field in ("attempts", "seq"))]
    each = each.select("media_id", *rest, *(own(n).alias(f"own{i}") for n, i in place.items()))
    every = lambda conds: reduce(Column.__and__, conds, F.lit(True))
    some = lambda conds: reduce(Column.__or__, conds, F.lit(False))

    def state(n: str) -> Column:
        is_ = lambda m, what: F.col(f"own{place[m]}") == what
        blocked, ready = some(is_(m, "failed") for m in sorted(above(n, stages))), every(is_(m, "done") for m in sorted(set(stages[n].needs)))
        return F.when(~is_(n, "pending"), F.col(f"own{place[n]}")).when(blocked, "blocked").when(ready, "ready").otherwise("waiting")

    each = each.withColumns({f"state{i}": state(n) for n, i in place.items()})
    depth = levels({n: s.needs for n, s in stages.items()})
    is_ = lambda n, what: F.col(f"state{place[n]}") == what
    count = lambda conds: reduce(Column.__add__, (c.cast("int") for c in conds), F.lit(0))

    def made(n: str) -> Column:
        fellows = [m for m in names if stages[m].pool == stages[n].pool]
        before = [m for m in fellows if (depth[m], m) < (depth[n], n)]
        claimed = is_(n, "ready") & (count(is_(m, "ready") for m in before) + count(is_(m, "running") for m in fellows) < pools.get(stages[n].pool, 1))
        i = place[n]
        return F.struct(F.lit(n).alias("stage"), F.col(f"state{i}").alias("state"), F.col(f"attempts{i}").alias("attempts"), F.col(f"seq{i}").alias("seq"), claimed.alias("claimed"))

    return each.select("media_id", F.inline(F.array(*map(made, names))))


class JobLog:
    """The log of jobs as a Parquet folder, rows only appended."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def rows(self) -> DataFrame:
        """The log; empty before the first rows were written."""
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        if not at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at):
            return self.spark.createDataFrame([], LOG)
        return self.spark.read.schema(LOG).parquet(self.path)

    def append(self, rows: DataFrame) -> None:
        columns = [f.split(" ") for f in LOG.split(", ")]
        rows.select(*(F.col(name).cast(kind) for name, kind in columns)).write.mode("append").parquet(self.path)


def ingest(log: JobLog, items: DataFrame, work: dict[str, Callable[[DataFrame], DataFrame]], clock: Callable[[], int], stages: dict[str, Stage] = STAGES) -> DataFrame:
    """Wave after wave, until no stage of any item can be claimed; returns the last ``states``.

    ``work`` has of each stage a function from the items (media_id) that need it to (media_id, ok), false or absent where it failed; what it
    makes, it writes itself. ``clock`` gives microseconds. Stages whose items back off are claimed by a later call. A wave logs that its
    jobs run, then how they ended; a driver that stops between leaves leases that expire.
    """
    while True:
        now = cut(states(log.rows(), items, clock(), stages).filter("claimed"))
        if now.isEmpty():
            return states(log.rows(), items, clock(), stages)
        version = _of_stage(lambda s: s.version, stages, "string")
        begun = now.select("media_id", "stage", (F.col("seq") + 1).alias("seq"), F.lit("running").alias("status"), version.alias("version"), F.col("attempts").alias("attempts"), F.lit(clock()).alias("updated_us"))
        log.append(begun)
        for stage in stages:
            mine = now.filter(F.col("stage") == stage)
            if mine.isEmpty():
                continue
            told = work[stage](mine.select("media_id")).groupBy("media_id").agg(F.bool_and("ok").alias("ok"))
            ended = mine.join(told, "media_id", "left").withColumn("ok", F.coalesce("ok", F.lit(False)))
            status = F.when(F.col("ok"), "done").otherwise("failed")
            tries = F.when(F.col("ok"), F.col("attempts")).otherwise(F.col("attempts") + 1)
            log.append(ended.select("media_id", "stage", (F.col("seq") + 2).alias("seq"), status.alias("status"), version.alias("version"), tries.alias("attempts"), F.lit(clock()).alias("updated_us")))
