"""Session logs: last row wins, a stopped run goes on, results are found again."""

from pyspark.sql import functions as F

from cutgraph.plans import sessions, stages
from cutgraph.plans.session import Budget

S = 1_000_000
NEW = "session_id long, media_id long, prompt string, kind string"
STEP = "session_id long, passed boolean, route string, plan string, payload string, calls long, retries long, seconds double, dollars double"


def step(i, passed=True, route=None, plan=None, payload=None, calls=1, seconds=1.0):
    return (i, passed, route, plan, payload, calls, 0, seconds, 0.0)


def states(log):
    return {r.session_id: (r.state, r.version) for r in sessions.snapshot(log.rows()).collect()}


def test_a_stopped_run_goes_on(spark, tmp_path):
    at = f"file://{tmp_path}/log"
    log = sessions.SessionLog(spark, at)
    assert log.rows().collect() == []
    log.start(spark.createDataFrame([(1, 7, "cut pauses", "mechanical"), (2, 8, "a trailer", "narrative")], NEW))
    log.advance(spark.createDataFrame([step(1), step(2)], STEP))
    log.advance(spark.createDataFrame([step(1)], STEP))
    # another process opens the same log
    log = sessions.SessionLog(spark, at)
    assert states(log) == {1: ("planning", 2), 2: ("retrieving", 1)}
    assert {r.session_id for r in sessions.unfinished(log.rows()).collect()} == {1, 2}
    for _ in range(2):
        log.advance(spark.createDataFrame([step(1, plan="p"), step(9)], STEP))
    log.advance(spark.createDataFrame([step(1, payload="clips")], STEP))
    assert states(log)[1] == ("done", 5) and states(log)[2] == ("retrieving", 1)
    found = sessions.cached(log.rows(), spark.createDataFrame([(7, "cut pauses"), (8, "a trailer"), (7, None)], "media_id long, prompt string"))
    assert {(r.media_id, r.prompt): r.payload for r in found.collect()} == {(7, "cut pauses"): "clips", (8, "a trailer"): None, (7, None): None}
    log.start(spark.createDataFrame([(3, 8, "something else", "mechanical"), (4, 7, "more", "noop")], NEW))
    assert states(log) == {1: ("done", 5), 2: ("superseded", 2), 3: ("parsed", 0), 4: ("parsed", 0)}
    log.advance(spark.createDataFrame([step(4), step(1)], STEP))
    assert states(log)[4] == ("done", 1) and states(log)[1] == ("done", 5)


def validating(spark, tmp_path, name, kind="mechanical"):
    log = sessions.SessionLog(spark, f"file://{tmp_path}/{name}")
    log.start(spark.createDataFrame([(1, 7, "p", kind)], NEW))
    for _ in range(4 if kind == "narrative" else 3):
        log.advance(spark.createDataFrame([step(1)], STEP))
    assert states(log)[1][0] == "validating"
    return log


def test_failed_validations_go_back_until_a_plan_repeats(spark, tmp_path):
    log = validating(spark, tmp_path, "a")
    log.advance(spark.createDataFrame([step(1, False, "planner", "p1")], STEP))
    assert states(log)[1][0] == "planning" and sessions.snapshot(log.rows()).first().retries == 1
    log.advance(spark.createDataFrame([step(1)], STEP))
    log.advance(spark.createDataFrame([step(1, False, "planner", "p1")], STEP))
    assert states(log)[1][0] == "failed"
    log = validating(spark, tmp_path, "b")
    log.advance(spark.createDataFrame([step(1, False, "story", "p1")], STEP))
    assert states(log)[1][0] == "failed"  # a mechanical edit has no reasoning to go back to
    log = validating(spark, tmp_path, "c", "narrative")
    log.advance(spark.createDataFrame([step(1, False, "story", "p1")], STEP))
    assert states(log)[1][0] == "reasoning"


def test_budgets(spark, tmp_path):
    log = validating(spark, tmp_path, "a")
    log.advance(spark.createDataFrame([step(1, calls=30)], STEP))
    assert states(log)[1][0] == "failed"
    log = validating(spark, tmp_path, "b")
    log.advance(spark.createDataFrame([step(1)], STEP), Budget(seconds=4.0))
    assert states(log)[1][0] == "failed"


def test_rows_written_twice_count_once(spark):
    rows = [(1, 7, "p", "noop", 0, "parsed", None, None, 0, 0, 0.0, 0.0)] * 2 + [(1, 7, "p", "noop", 1, "done", None, "x", 0, 0, 0.0, 0.0)] * 2
    log = spark.createDataFrame(rows, sessions.LOG)
    assert [r.state for r in sessions.snapshot(log).collect()] == ["done"] and sessions.unfinished(log).count() == 0


def test_ingest_goes_on_from_the_log(spark, tmp_path):
    stages_ = {"a": stages.Stage((), "1", "cpu", 10), "b": stages.Stage(("a",), "1", "cpu", 10), "c": stages.Stage(("b",), "1", "api", 10), "d": stages.Stage(("a",), "1", "cpu", 10)}
    log, items, now, ran = stages.JobLog(spark, f"file://{tmp_path}/jobs"), spark.createDataFrame([(1,), (2,), (2,)], "media_id long"), [0], []

    def work(name, bad=()):
        def run(its):
            ran.append((name, sorted(r.media_id for r in its.collect())))
            return its.select("media_id", (~F.col("media_id").isin(*bad, -1)).alias("ok"))

        return run

    told = lambda df: {(r.media_id, r.stage): (r.state, r.attempts) for r in df.collect()}
    bad = {n: work(n, (2,) if n == "b" else ()) for n in stages_}
    for tries, wait in ((1, 10**6), (2, 2 * 10**6)):
        end = told(stages.ingest(log, items, bad, lambda: now[0], stages_))
        assert end[2, "b"] == ("backoff", tries) and end[2, "c"][0] == "waiting" and end[1, "c"][0] == "done"
        now[0] += wait
    end = told(stages.ingest(log, items, bad, lambda: now[0], stages_))
    assert end[2, "b"] == ("failed", 3) and end[2, "c"][0] == "blocked" and end[2, "d"][0] == "done"
    assert ran == [("a", [1, 2]), ("b", [1, 2]), ("d", [1, 2]), ("c", [1]), ("b", [2]), ("b", [2])]
    # a new version of b is made again, and so not what is done below it; another item comes in
    ran.clear()
    newer = stages_ | {"b": stages.Stage(("a",), "2", "cpu", 10)}
    fine = {n: work(n) for n in stages_}
    end = told(stages.ingest(log, spark.createDataFrame([(1,), (3,)], "media_id long"), fine, lambda: now[0], newer))
    assert {s for s, _ in end.values()} == {"done"} and ("b", [1]) in ran and ("a", [3]) in ran and all(1 not in i for n, i in ran if n != "b")
    assert stages.states(log.rows(), items.limit(0), 0).collect() == []


def test_leases_pools_and_clashes(spark):
    rows = [(1, "normalize", 1, "done", "2.0", 0, 0), (1, "audio", 2, "running", "2.0", 0, 0), (1, "audio", 1, "done", "1.0", 0, 0), (1, "nothing", 1, "done", "1", 0, 0), (7, "normalize", 1, "done", "2.0", 0, 0), (None, "audio", 1, "done", "2.0", 0, 0)]
    log = spark.createDataFrame([(*r, "x") for r in rows], stages.LOG + ", state string")
    items = spark.createDataFrame([(1, "x")], "media_id long, stage string")
    at = lambda now: {r.stage: (r.state, r.claimed) for r in stages.states(log, items, now).collect()}
    live = at(600 * S)
    assert live["normalize"] == ("done", False) and live["audio"] == ("running", False) and len(live) == len(stages.STAGES)
    # one of the two places is taken; by depth, then name
    assert live["audio_separation"] == ("ready", True) and live["scenes"] == ("ready", False) and live["faces"] == ("waiting", False)
    late = at(600 * S + 1)
    assert late["audio"] == ("ready", True) and late["audio_separation"] == ("ready", True) and late["scenes"] == ("ready", False)


def test_plan_keys_and_profiles(spark):
    clips = "media_id long, pos int, start_us long, end_us long"
    a, b, c = (sessions.plan_keys(spark.createDataFrame(x, clips)).collect()[0].plan for x in ([(1, 0, 0, 100), (1, 1, 70_000, 90_000)], [(1, 1, 80_000, 99_999), (1, 0, 10, 49_999)], [(1, 0, 0, 100), (1, 1, 170_000, 190_000)]))
    assert a == b != c
    said = [(1, i, p, q) for i, (p, q) in enumerate([("fast", None), ("fast", "reels"), ("fast", "reels"), ("cinematic", "reels"), ("cinematic", "x"), (None, None)])] + [(2, 0, "fast", "x"), (None, 0, None, None)]
    known = sessions.learned(spark.createDataFrame(said, "user_id long, seq long, pacing string, platform string"))
    assert [tuple(r) for r in known.collect()] == [(1, "fast", ["reels"])]
    asked = spark.createDataFrame([(1, None, "x", 5), (1, "slow", None, 6), (2, None, None, 7), (None, None, None, 8)], "user_id long, pacing string, platform string, n int")
    assert {r.n: (r.pacing, r.platform, r.applied) for r in sessions.with_profile(asked, known).collect()} == {5: ("fast", "x", ["profile_pacing"]), 6: ("slow", "reels", ["profile_platform"]), 7: (None, None, []), 8: (None, None, [])}


def test_states_sort_nothing_after_items_met(spark):
    """Windows over the eleven rows that each item's stages made took most of a task's memory."""
    log, items = spark.createDataFrame([(1, "audio", 1, "failed", "2.0", 1, 0)], stages.LOG), spark.createDataFrame([(1,)], "media_id long")
    plan = stages.states(log, items, 0)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan
