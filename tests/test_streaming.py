import datetime

from pyspark.sql import functions as F

from cutgraph.streaming import events

SCHEMA = "media_id long, ts timestamp, value double"
T0 = datetime.datetime(2024, 1, 1)


def drained(spark, df, name, mode="append"):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).start()
    q.processAllAvailable()
    q.stop()
    return spark.sql(f"SELECT * FROM {name}").collect()


def source(spark, tmp_path, batches):
    for i, rows in enumerate(batches):
        spark.createDataFrame([(m, T0 + datetime.timedelta(seconds=s), v) for m, s, v in rows], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / str(i)))
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))


def test_hysteresis_over_batches(spark, tmp_path):
    s = source(spark, tmp_path, [[(1, 0, 0.2), (1, 1, 0.8), (1, 2, 0.4)], [(1, 3, 0.7), (1, 4, 0.1), (1, 5, 0.9)]])
    got = drained(spark, events.hysteresis(s), "h")
    base = int(T0.replace(tzinfo=datetime.timezone.utc).timestamp()) * 1_000_000
    assert [(r.start_us - base, r.end_us - base, round(r.confidence, 6), r.n) for r in got] == [(1_000_000, 5_000_000, round(1.9 / 3, 6), 3)]


def test_sessions_and_sliding(spark, tmp_path):
    rows = [(1, 0.0, 1.0), (1, 0.1, 2.0), (1, 5.0, 3.0), (1, 100.0, 4.0), (1, 200.0, 5.0)]
    s = source(spark, tmp_path, [rows[:3], rows[3:4], rows[4:]])
    assert sorted(r.n for r in drained(spark, events.sessions(s), "s"))[-1] == 2
    assert any(r.n == 2 and r.most == 2.0 for r in drained(spark, events.sliding(s), "w"))


def test_udfs(spark):
    from cutgraph.functions import udfs

    rows = [('```json\n{"a": [1, 2,], "b": "x,}"}\n```',), ("none",), (None,), ('say {bad} then {"k": {"z": 1}} ok',)]
    got = [r[0] for r in spark.createDataFrame(rows, "t string").select(udfs.extract_json(F.col("t"))).collect()]
    assert got == ['{"a": [1, 2], "b": "x,}"}', None, None, '{"k": {"z": 1}}']
    words = spark.createDataFrame([("laptp",), (None,), ("zzz",)], "w string").select(udfs.close_matches(F.col("w"), ["laptop", "phone"])).collect()
    assert [r[0] for r in words] == [["laptop"], None, []]
    p = spark.createDataFrame([('{"r_frame_rate": "30000/1001", "avg_frame_rate": "25/1", "video_start": "0.1", "audio_start": "0.15", "width": 640}',), ("bad",)], "j string").select(udfs.probe(F.col("j")).alias("p")).collect()
    assert p[0].p.is_vfr and round(p[0].p.av_offset_ms) == 50 and p[1].p.fps is None
    assert [r[0] for r in spark.createDataFrame([("Rate limit hit",), ("bad key",)], "m string").select(udfs.is_transient(F.col("m"))).collect()] == [True, False]


def timed(spark, tmp_path, batches, at="ckpt", out="out", **more):
    """All events that the batches so far give, with the query stopped after them and its checkpoint kept."""
    for i, rows in enumerate(batches):
        folder = tmp_path / "in" / f"{i:03}"
        if not folder.exists():
            spark.createDataFrame([(m, T0 + datetime.timedelta(seconds=s), v) for m, s, v in rows], SCHEMA).coalesce(1).write.parquet(str(folder))
    for k, v in events.STORE.items():
        spark.conf.set(k, v)
    try:
        s = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
        q = events.hysteresis_with_timers(s, **more).writeStream.option("checkpointLocation", str(tmp_path / at)).format("parquet").option("path", str(tmp_path / out)).start()
        q.processAllAvailable()
        q.stop()
    finally:
        for k in events.STORE:
            spark.conf.unset(k)
    base = int(T0.replace(tzinfo=datetime.timezone.utc).timestamp()) * 1_000_000
    return sorted((r.media_id, (r.start_us - base) / 1e6, (r.end_us - base) / 1e6, r.n, r.cut_short) for r in spark.read.parquet(str(tmp_path / out)).collect())


def test_quiet_items_emit_their_open_event(spark, tmp_path):
    far = [(9, 200, 0.0)], [(9, 300, 0.0)]  # other items move the watermark on
    got = timed(spark, tmp_path, [[(1, 0, 0.9), (1, 1, 0.8), (2, 0, 0.9), (2, 2, 0.1)], *far])
    assert got == [(1, 0.0, 2.0, 2, True), (2, 0.0, 3.0, 1, False)]


def test_rows_out_of_order_count_and_late_ones_dont(spark, tmp_path):
    batches = [[(1, 5, 0.4)], [(1, 3, 0.9), (1, 4, 0.8)], [(1, 6, 0.2), (1, 40, 0.0)], [(1, 7, 0.9), (9, 80, 0.0)], [(9, 120, 0.0)]]
    got = timed(spark, tmp_path, batches)
    assert got == [(1, 3.0, 7.0, 3, False)]  # the row at 7 s comes after the watermark had passed 30 s


def test_a_restart_goes_on_from_the_checkpoint(spark, tmp_path):
    first = [[(1, 0, 0.9), (1, 1, 0.7)], [(9, 20, 0.0)]]
    assert timed(spark, tmp_path, first) == []
    more = [*first, [(1, 21, 0.8), (1, 22, 0.1)], [(9, 60, 0.0)], [(9, 100, 0.0)]]
    assert timed(spark, tmp_path, more) == [(1, 0.0, 23.0, 3, False)]
