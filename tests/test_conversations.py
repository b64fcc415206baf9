import datetime as dt

import pytest
from pyspark.sql import functions as F

from parlance.operators import conversations as c
from parlance.operators import progress, segments

T0 = dt.datetime(2026, 2, 17, 14, 30)


def at(ms):
    return T0 + dt.timedelta(milliseconds=ms)


def chunks(spark, arrivals, session="s"):
    return spark.createDataFrame([(session, i, at(ms), n) for i, (ms, n) in enumerate(arrivals)], "session_id string, chunk_no long, received_at timestamp, n_samples int")


@pytest.mark.parametrize("block_seconds", [60, 1])
def test_pause_of_exactly_the_threshold_splits(spark, rows, block_seconds):
    df = chunks(spark, [(0, 10), (300, 10), (1100, 10), (1899, 10), (2000, 10), (2100, 0)])
    closed = segments.segment_on_pause(df, 800, block_seconds=block_seconds)
    assert rows(closed, "chunk_no", "segment", "offered_before") == [(0, 0, 0), (1, 0, 10)]
    tail = segments.segment_on_pause(df, 800, emit_tail=True, block_seconds=block_seconds)
    assert rows(tail, "chunk_no", "segment", "offered_before", "is_closed") == [
        (0, 0, 0, True), (1, 0, 10, True), (2, 1, 0, False), (3, 1, 10, False), (4, 1, 20, False)]


def test_many_blocks_equal_one(spark):
    arrivals, now = [], 0
    for i in range(400):
        now += [100, 250, 799, 800, 3000][(i * 7 + i // 5) % 5]
        arrivals.append((now, i % 6))
    df = chunks(spark, arrivals)
    fine, coarse = (segments.segment_on_pause(df, 800, True, block_seconds=s) for s in (1, 100_000))
    assert fine.count() == sum(1 for _, n in arrivals if n) and fine.exceptAll(coarse).count() == 0
    last, seg, want = None, 0, []
    for i, (ms, n) in enumerate(arrivals):
        if n:
            seg += last is not None and ms - last >= 800
            last = ms
            want.append((i, seg))
    assert [(r.chunk_no, r.segment) for r in fine.orderBy("chunk_no").collect()] == want


def test_capacity(spark, rows):
    segmented = segments.segment_on_pause(chunks(spark, [(0, 300_000), (100, 300_000), (200, 5)]), emit_tail=True)
    assert rows(segments.bounded_segments(segmented), "chunk_no", "accepted", "dropped") == [(0, 300_000, 0), (1, 212_000, 88_000), (2, 0, 5)]
    assert rows(segments.buffer_status(segmented), "chunk_no", "held", "fill_percent") == [(0, 300_000, 58.59375), (1, 512_000, 100.0), (2, 512_000, 100.0)]


def test_flush(spark, rows):
    df = chunks(spark, [(0, 2), (100, 3), (200, 2), (2000, 1)]).withColumn("samples", F.transform(F.sequence(F.lit(1), "n_samples"), lambda i: F.col("chunk_no") * 10 + i))
    flushed = segments.flush_segments(segments.bounded_segments(segments.segment_on_pause(df), 6))
    assert [list(r.samples) for r in flushed.collect()] == [[1, 2, 11, 12, 13, 21]]


@pytest.mark.parametrize("per_block", [65_536, 1])
def test_fragments(spark, rows, monkeypatch, per_block):
    monkeypatch.setattr(segments, "FRAGMENTS_PER_BLOCK", per_block)
    df = spark.createDataFrame([("a", 0, "ab", False), ("a", 1, "c", True), ("a", 2, "d", True), ("a", 3, "lost", False), ("b", 0, "x", False)], "connection string, seq long, part string, is_end boolean")
    assert rows(segments.reassemble_fragments(df), "connection", "message_no", "text", "fragments") == [("a", 0, "abc", 2), ("a", 1, "d", 1)]


def test_fanout_is_half_open(spark, rows):
    logs = spark.createDataFrame([(i, at(ms), "info", "m") for i, ms in enumerate([0, 999, 1000, 400_000])], "log_id long, ts timestamp, level string, message string")
    subs = spark.createDataFrame([("u", at(0), at(1000)), ("v", at(999), at(500_000)), ("w", at(5), at(5))], "subscriber string, start_at timestamp, end_at timestamp")
    assert rows(segments.log_fanout(logs, subs), "subscriber", "log_id") == [("u", 0), ("u", 1), ("v", 1), ("v", 2), ("v", 3)]


def test_fanout_is_dealt_to_all_tasks(spark):
    """A small input has a large result: its repeated side isn't broadcast, its parts aren't merged into one task."""
    logs = spark.range(200).select(F.col("id").alias("log_id"), F.timestamp_seconds(F.col("id") * 3).alias("ts"), F.lit("info").alias("level"))
    subs = spark.range(50).select(F.col("id").alias("subscriber"), F.timestamp_seconds("id").alias("start_at"), F.timestamp_seconds(F.col("id") + 400).alias("end_at"))
    out = segments.log_fanout(logs, subs)
    assert out.count() == sum(i <= 3 * t < i + 400 for i in range(50) for t in range(200))
    assert out.select(F.spark_partition_id().alias("p")).distinct().count() > 1
    assert "Broadcast" not in out._jdf.queryExecution().toString()


def test_fanout_repeats_few_rows(spark, rows, monkeypatch):
    """Subscriptions of a bucket are packed before they are repeated for each part; packs are bounded."""
    monkeypatch.setattr(segments, "PACK_MOST", 3, raising=False)
    entries = [(i if i else None, at(i * 7_000)) for i in range(150)] + [(3, at(21_000)), (200, None)]
    spans = [(i if i else None, at(i * 1000), at(i * 1000 + 400_000) if i % 5 else None) for i in range(30)] + [(7, at(7000), at(407_000)), (40, None, at(5))]
    logs = spark.createDataFrame(entries, "log_id long, ts timestamp")
    subs = spark.createDataFrame(spans, "subscriber long, start_at timestamp, end_at timestamp")
    out = segments.log_fanout(logs, subs)
    want = sorted(((s, n, t) for s, b, e in spans for n, t in entries if None not in (b, e, t) and b <= t < e), key=repr)
    assert out.columns == ["log_id", "ts", "subscriber", "start_at", "end_at"] and rows(out, "subscriber", "log_id", "ts") == want
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.index("SortMergeJoin") < plan.index("collect_list")


def test_throttle(spark, rows):
    df = spark.createDataFrame([("m", i, p) for i, p in enumerate([0, 3, 5, 9, 10, 100, 100])] + [("n", 0, 4), ("n", 1, 8), ("n", 2, 140), ("n", 3, 99)], "name string, seq long, pct int")
    assert rows(progress.throttle_progress(df)) == [("m", 2, 5), ("m", 4, 10), ("m", 5, 100), ("m", 6, 100), ("n", 0, 4), ("n", 2, 100)]


def test_percent(spark):
    df = spark.createDataFrame([(50, 100), (50, -1), (0, 100), (100, 100), (3 * 1048576, 4 * 1048576)], "bytes long, total_bytes long")
    got = progress.progress_percent(df).collect()
    assert [r.percent for r in got] == [50.0, -1.0, 0.0, 100.0, 75.0]
    assert (got[4].done_text, got[4].total_text, got[1].total_text) == ("3.0 MB", "4.0 MB", None)


def test_pairs(spark, rows, monkeypatch):
    monkeypatch.setattr(c, "MESSAGES_PER_BLOCK", 1)
    df = spark.createDataFrame([(1, 0, "system", "s"), (1, 1, "user", "a"), (1, 2, "assistant", "b"), (1, 3, "user", "c"), (1, 4, "user", "d")], "session_id int, seq long, role string, text string")
    assert rows(c.pair_turns(df)) == [(1, 1, "a", "b"), (1, 3, "c", None), (1, 4, "d", None)]


def control_rows(spark, entries):
    return spark.createDataFrame([("s", i, at(ms), *rest) for i, (ms, *rest) in enumerate(entries)], "session_id string, event_id long, ts timestamp, type string, smart_mode boolean, smart_model string")


@pytest.mark.parametrize("block_seconds", [60, 1])
def test_settings_as_of(spark, rows, block_seconds):
    turns = spark.createDataFrame([("s", 100 + i, at(ms), i) for i, ms in enumerate([0, 1500, 5000, 9000])], "session_id string, event_id long, ts timestamp, n int")
    control = control_rows(spark, [(1000, "config", True, None), (4000, "config", None, "big"), (4500, "clear_history", False, "x"), (8000, "config", False, "")])
    got = c.config_as_of(turns, control, block_seconds)
    assert rows(got, "n", "smart_mode", "smart_model") == [(0, False, "phi3"), (1, True, "phi3"), (2, True, "big"), (3, False, "big")]


@pytest.mark.parametrize("block_seconds", [60, 1])
def test_history(spark, rows, block_seconds):
    kinds = [False, False, True, False, False, False, True, True, False]
    events = spark.createDataFrame([("s", i, at(i * 700), k) for i, k in enumerate(kinds)], "session_id string, event_id long, ts timestamp, is_clear boolean")
    placed = c.history_since_clear(events, block_seconds)
    assert rows(placed, "event_id", "epoch", "position") == [(0, 0, 1), (1, 0, 2), (3, 1, 1), (4, 1, 2), (5, 1, 3), (8, 3, 1)]
    assert rows(c.history_ranges(placed), "event_id", "history_size") == [(0, 0), (1, 2), (3, 0), (4, 2), (5, 4), (8, 0)]
    turns = placed.withColumns({"transcript": F.concat(F.lit("q"), "event_id"), "reply": F.concat(F.lit("a"), "event_id")})
    history = {(r.epoch, r.position): [m.content for m in r.history] for r in c.chat_history(turns, 3).collect()}
    assert history == {(0, 1): [], (0, 2): ["q0", "a0"], (1, 1): [], (1, 2): ["q3", "a3"], (1, 3): ["a3", "q4", "a4"], (3, 1): []}


def test_failed_transcripts(spark, rows):
    df = spark.createDataFrame([(1, "[Transcription error] x"), (2, "[Transcription error: boom]"), (3, "fine"), (4, "[Error processing chunk]"), (5, None)], "id int, text string")
    assert rows(c.drop_failed_transcripts(df), "id", "chunk_failed") == [(2, False), (3, False), (4, True), (5, False)]
    assert rows(c.drop_failed_transcripts(df, strict=True), "id") == [(3,), (5,)]


def test_routing(spark):
    df = spark.createDataFrame(
        [(1, "hi", "yo", .5, True, True), (2, "hi", "yo", .5, False, False), (3, "[Transcription error] x", "yo", .5, True, True)],
        "id int, transcript string, reply string, confidence double, smart_mode boolean, realtime_mode boolean")
    got = [(r.id, r.type, r.response, r.confidence, r.is_partial) for r in c.route_turns(df).orderBy("id", "step").collect()]
    assert got == [
        (1, "partial_transcript", None, .5, True), (1, "thinking", None, None, None), (1, "partial_llm", "yo", None, None),
        (1, "audio_chunk", None, None, None), (2, "transcript", None, None, None), (2, "response", "hi", None, None),
        (3, "partial_transcript", None, 0.0, False)]


def test_durations(spark, rows):
    turns = spark.createDataFrame([("s", 1, "a", "b"), ("s", 2, None, "gone"), ("s", 3, "bad", None)], "session_id string, turn_number int, user_audio_file string, assistant_audio_file string")
    headers = spark.createDataFrame([("a", 1.5), ("b", 2.5), ("bad", None)], "path string, duration double")
    assert rows(c.attach_durations(turns, headers), "turn_number", "user_audio_duration", "assistant_audio_duration") == [(1, 1.5, 2.5), (2, None, None), (3, 0.0, None)]


def test_retention(spark, rows):
    df = spark.createDataFrame([("old", at(0)), ("new", at(36 * 3600 * 1000))], "session_id string, created_at timestamp")
    now = F.lit(at(48 * 3600 * 1000))
    assert rows(c.expire_sessions(df, 1, now), "session_id", "expired") == [("new", False), ("old", True)]
    assert rows(c.expire_sessions(df, 0, now), "session_id", "expired") == [("new", False), ("old", False)]


def test_latency(spark):
    df = spark.createDataFrame([(10.0, 1.0), (30.0, 3.0)], "audio_s double, wall_s double")
    r = c.latency_report(df).first()
    assert (r.calls, r.real_time_factor, r.throughput, r.mean_wall_s, r.stddev_wall_s) == (2, .1, 10.0, 2.0, 1.0)
    assert r.wall_s_per_audio_minute == pytest.approx(6.0)


def test_latency_percentiles(spark):
    """Exact where a group is smaller than the sketch, and within its stated error of the rank beyond."""
    from parlance.operators import conversations

    calls = spark.range(40_000).selectExpr("1.0D AS audio_s", "CAST((id * 7919) % 40000 AS DOUBLE) AS wall_s", "id < 100 AS few")
    rows = {r.few: r for r in conversations.latency_report(calls, ["few"], accuracy=500).collect()}
    small = sorted((i * 7919) % 40_000 for i in range(100))
    assert (rows[True].p50_wall_s, rows[True].p95_wall_s, rows[True].p99_wall_s) == (small[49], small[94], small[98])
    large = sorted((i * 7919) % 40_000 for i in range(100, 40_000))
    for p in (50, 95, 99):
        rank = large.index(rows[False][f"p{p}_wall_s"]) + 1
        assert abs(rank - len(large) * p / 100) <= len(large) / 500 + 1
    assert conversations.latency_report(calls, percentiles=()).columns == [c for c in rows[True].__fields__ if c != "few" and not c.startswith("p")]
