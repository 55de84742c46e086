"""Edit sessions as tables: an append-only log, its snapshot, resumption, cached results, budgets and gates.

A row of the log is a session after a step: (session_id, media_id, prompt, kind, version, state, plan, payload, calls, retries,
seconds, dollars), the last four spent so far. Rows are only appended; the row of a session with the greatest version is what holds.
All sessions advance in one plan, so a stopped run goes on from the log.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .session import MOST_STEPS, PATHS, ROUTES, Budget

LOG = "session_id long, media_id long, prompt string, kind string, version long, state string, plan string, payload string, calls long, retries long, seconds double, dollars double"
FINAL = ("done", "failed", "awaiting_answer", "superseded")
SPENT = ("calls", "retries", "seconds", "dollars")
#: Words of a prompt, and the capability that they need.
NEEDS = ((("speaker", "voice", "interviewer"), "speakers"), (("face", "person", "looking"), "faces"))


def snapshot(log: DataFrame) -> DataFrame:
    """The last row of each session; of rows with the same version the one with the greatest state by name, so that a row written twice counts once."""
    rest = [c for c in log.columns if c != "session_id"]
    last = log.groupBy("session_id").agg(F.max_by(F.struct(*rest), F.struct("version", "state")).alias("r"))
    return last.select("session_id", *(F.col(f"r.{c}").alias(c) for c in rest)).select(*log.columns)


def unfinished(log: DataFrame) -> DataFrame:
    """The sessions that a new run takes up again."""
    return snapshot(log).filter(~F.col("state").isin(*FINAL))


def cache_key(media_id: Column, prompt: Column) -> Column:
    return F.sha2(F.concat_ws(":", media_id.cast("string"), prompt), 256)


def plan_keys(clips: DataFrame, grid: int = 50_000) -> DataFrame:
    """(media_id, plan): a digest that an item's plans share whose clips, in order of their place, agree on a 50 ms grid."""
    cell = lambda c: F.expr(f"{c} div {grid}").cast("string")
    each = F.array_sort(F.collect_list(F.struct("pos", F.concat_ws("-", cell("start_us"), cell("end_us")).alias("c"))))
    return clips.groupBy("media_id").agg(F.sha2(F.array_join(F.transform(each, lambda e: e["c"]), ","), 256).alias("plan"))


def cached(log: DataFrame, requests: DataFrame) -> DataFrame:
    """``requests`` (media_id, prompt, ...) with the ``payload`` of the latest session done for the same item and prompt, null if there is none."""
    done = snapshot(log).filter("state = 'done' and payload is not null").select(cache_key(F.col("media_id"), F.col("prompt")).alias("_key"), "session_id", "payload")
    latest = done.groupBy("_key").agg(F.max_by("payload", "session_id").alias("payload"))
    return requests.withColumn("_key", cache_key(F.col("media_id"), F.col("prompt"))).join(latest, "_key", "left").drop("_key")


def started(log: DataFrame, new: DataFrame) -> DataFrame:
    """Rows to append that begin the sessions ``new`` (session_id, media_id, prompt, kind) and supersede the items' open ones."""
    begun = new.select("session_id", "media_id", "prompt", "kind", F.lit(0).cast("long").alias("version"), F.lit("parsed").alias("state"), F.lit(None).cast("string").alias("plan"), F.lit(None).cast("string").alias("payload"), *(F.lit(0).cast("long" if c in ("calls", "retries") else "double").alias(c) for c in SPENT))
    old = unfinished(log).join(new.select("media_id").distinct(), "media_id", "left_semi").withColumn("version", F.col("version") + 1).withColumn("state", F.lit("superseded"))
    return begun.unionByName(old.select(*begun.columns))


def _following(kind: Column, state: Column) -> Column:
    """The state after ``state`` on the path of its kind."""
    out = F.lit("failed")
    for name, path in PATHS.items():
        for now, then in zip(path, path[1:], strict=False):
            out = F.when((kind == name) & (state == now), then).otherwise(out)
    return out


def _on_path(kind: Column, state: Column) -> Column:
    out = F.lit(False)
    for name, path in PATHS.items():
        out = F.when(kind == name, state.isin(*path)).otherwise(out)
    return out


def advanced(log: DataFrame, steps: DataFrame, budget: Budget | None = None) -> DataFrame:
    """Rows to append: each open session after its step.

    ``steps`` are (session_id, passed, route, plan, payload, calls, retries, seconds, dollars), of which the last four were spent in the step;
    a session without one stays as it is. A session fails that has spent its budget or taken too many steps. A validation that failed goes back by
    its route, if its path has that, retries are left and the plan is a new one; it costs a retry.
    """
    b = budget or Budget()
    now = unfinished(log)
    tried = log.filter("plan is not null").groupBy("session_id").agg(F.collect_set("plan").alias("tried"))
    spent = {c: F.col(c) + F.coalesce(f"s_{c}", F.lit(0)) for c in SPENT}
    s = steps.select("session_id", "passed", "route", F.col("plan").alias("s_plan"), F.col("payload").alias("s_payload"), *(F.col(c).alias(f"s_{c}") for c in SPENT))
    both = now.join(s, "session_id").join(tried, "session_id", "left")
    open_ = (spent["calls"] < b.calls) & (spent["retries"] <= b.retries) & (spent["seconds"] < b.seconds) & (spent["dollars"] < b.dollars) & (F.col("version") < MOST_STEPS)
    back = F.coalesce(F.create_map(*(F.lit(x) for pair in ROUTES.items() for x in pair))[F.col("route")], F.lit(""))
    again = _on_path(F.col("kind"), back) & (spent["retries"] < b.retries) & ~F.coalesce(F.array_contains("tried", F.col("s_plan")), F.lit(False))
    rejected = (F.col("state") == "validating") & ~F.coalesce("passed", F.lit(True))
    state = F.when(~open_, "failed").when(rejected, F.when(again, back).otherwise("failed")).otherwise(_following(F.col("kind"), F.col("state")))
    out = {"version": F.col("version") + 1, "state": state, "plan": F.col("s_plan"), "payload": F.coalesce("s_payload", "payload"), **spent, "retries": spent["retries"] + F.when(open_ & rejected & again, 1).otherwise(0)}
    return both.select(*((out[c] if c in out else F.col(c)).alias(c) for c in log.columns))


@dataclass(frozen=True)
class SessionLog:
    """A log kept as Parquet in a folder that all executors share."""

    spark: SparkSession
    path: str

    def rows(self) -> DataFrame:
        """The log; empty before the first rows were written."""
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        if not at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at):
            return self.spark.createDataFrame([], LOG)
        return self.spark.read.schema(LOG).parquet(self.path)

    def append(self, rows: DataFrame) -> None:
        kept = [f.split(" ")[0] for f in LOG.split(", ")]
        rows.select(*kept).write.mode("append").parquet(self.path)

    def start(self, new: DataFrame) -> None:
        self.append(started(self.rows(), new))

    def advance(self, steps: DataFrame, budget: Budget | None = None) -> None:
        self.append(advanced(self.rows(), steps, budget))


def gated(requests: DataFrame, coverage: DataFrame, words: DataFrame) -> DataFrame:
    """``requests`` (media_id, action, query, ...) with ``out_of_scope``: why a request can't be met, or null.

    ``coverage`` (media_id, capability, status) tells what ingestion has made of an item; what isn't available, or isn't there, can't be asked for. An item
    without words is one silence, which can't be removed.
    """
    have = coverage.groupBy("media_id").agg(F.collect_set(F.when(F.col("status") == "available", F.col("capability"))).alias("_have"))
    spoken = words.select("media_id").distinct().withColumn("_spoken", F.lit(True))
    q = F.lower("query")
    reason = F.when((F.col("action") == "remove") & F.contains(q, F.lit("silence")) & F.col("_spoken").isNull(), "no speech")
    for words_, capability in reversed(NEEDS):
        named = F.lit(False)
        for w in words_:
            named |= F.contains(q, F.lit(w))
        reason = reason.when(named & ~F.coalesce(F.array_contains("_have", F.lit(capability)), F.lit(False)), f"no {capability}")
    return requests.join(have, "media_id", "left").join(spoken, "media_id", "left").withColumn("out_of_scope", reason).drop("_have", "_spoken")


def learned(prompts: DataFrame, least: int = 3) -> DataFrame:
    """(user_id, pacing, platforms): what each user has asked for ``least`` times or more, from prompts (user_id, seq, pacing, platform).

    The pacing is that of the last prompt which named one asked for so often by then; platforms are in the order in which they got there. Users without either have
    no row. A user's prompts are counted in one window for each kind; nothing but the learned values is gathered.
    """
    each = prompts.select("user_id", "seq", F.explode(F.array(F.struct(F.lit("pacing").alias("kind"), F.col("pacing").alias("value")), F.struct(F.lit("platform").alias("kind"), F.col("platform").alias("value")))).alias("p")).select("user_id", "seq", "p.*").filter("value is not null")
    n = F.row_number().over(Window.partitionBy("user_id", "kind", "value").orderBy("seq"))
    known = each.withColumn("n", n).filter(F.col("n") >= least)
    pacing = F.max_by(F.when(F.col("kind") == "pacing", F.col("value")), F.when(F.col("kind") == "pacing", F.col("seq")))
    got = F.array_sort(F.collect_list(F.when((F.col("kind") == "platform") & (F.col("n") == least), F.struct("seq", "value"))))
    return known.groupBy("user_id").agg(pacing.alias("pacing"), F.transform(got, lambda s: s["value"]).alias("platforms"))


def with_profile(intents: DataFrame, profile: DataFrame) -> DataFrame:
    """``intents`` (user_id, pacing, platform, ...) with a learned pacing and the first learned platform where they name none, and ``applied``: which of them."""
    known = profile.select("user_id", F.col("pacing").alias("_pacing"), F.get("platforms", F.lit(0)).alias("_platform"))
    i = intents.join(known, "user_id", "left")
    takes = lambda c: F.col(c).isNull() & F.col(f"_{c}").isNotNull()
    applied = F.array_compact(F.array(F.when(takes("pacing"), "profile_pacing"), F.when(takes("platform"), "profile_platform")))
    return i.select(*(F.coalesce(c, f"_{c}").alias(c) if c in ("pacing", "platform") else F.col(c) for c in intents.columns), applied.alias("applied"))


def needs_story(cut_style: Column, shape: Column, actions: Column, target_us: Column) -> Column:
    """Whether an intent needs the story agent: cuts by beat or match, a narrative shape, restructuring or compression, or a target length for what is kept."""
    no = F.lit(False)
    return (
        F.coalesce(cut_style.isin("beat_cut", "match_cut"), no)
        | F.coalesce(shape.isin("hook_first", "trailer", "highlight"), no)
        | F.coalesce(F.arrays_overlap(actions, F.array(F.lit("restructure"), F.lit("compress"))), no)
        | (target_us.isNotNull() & F.coalesce(F.array_contains(actions, F.lit("keep_only")), no))
    )
