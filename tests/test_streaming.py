import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from parlance.operators import progress, segments
from parlance.sources import text_sources
from parlance.streaming import live

T0 = dt.datetime(2026, 2, 17)


@pytest.fixture
def stream(spark, tmp_path):
    """Feed batches of rows one micro-batch each and return what came out."""
    def run(batches, schema, compute):
        src = tmp_path / "in"
        for i, batch in enumerate(batches):
            spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(str(src))
            for f in src.glob("*.parquet"):
                if f.stat().st_mtime > 1_000_000_100:
                    os.utime(f, (1_000_000_000 + i, 1_000_000_000 + i))
        source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(src))
        live.drain(compute(source), str(tmp_path / "out"), str(tmp_path / "checkpoint"))
        return spark.read.parquet(str(tmp_path / "out"))

    return run


FRAGMENTS = "connection string, seq long, part string, is_end boolean"
BATCHES = [[("a", 1, "b", False), ("a", 0, "a", False), ("b", 0, "x", True)], [("a", 2, "c", True), ("a", 3, "d", True), ("a", 4, "open", False)],
           [("b", 1, "y", True), ("a", 5, "z", False)]]
WANT = [("a", 0, "abc", 3), ("a", 1, "d", 1), ("b", 0, "x", 1), ("b", 1, "y", 1)]


@pytest.mark.parametrize("per_block", [65_536, 1])
def test_fragments_in_batches(spark, tmp_path, rows, monkeypatch, per_block):
    monkeypatch.setattr(segments, "FRAGMENTS_PER_BLOCK", per_block)
    src = tmp_path / "in"
    for i, batch in enumerate(BATCHES):
        spark.createDataFrame(batch, FRAGMENTS).coalesce(1).write.mode("append").parquet(str(src))
        source = spark.readStream.schema(FRAGMENTS).parquet(str(src))
        live.reassemble_fragments_in_batches(source, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert rows(spark.read.parquet(str(tmp_path / "out/messages")), "connection", "message_no", "text", "fragments") == WANT


def test_fragments_across_batches(stream, rows):
    schema, batches = FRAGMENTS, BATCHES
    got = stream(batches, schema, live.reassemble_fragments_stream)
    assert rows(got, "connection", "message_no", "text", "fragments") == WANT


def test_throttle_across_batches(spark, stream, rows):
    schema = "name string, seq long, pct int"
    reports = [("m", i, p) for i, p in enumerate([0, 3, 5, 9, 10, 100, 100, 20])]
    got = stream([reports[:3], reports[3:]], schema, live.throttle_progress_stream)
    assert rows(got, "name", "seq", "pct") == rows(progress.throttle_progress(spark.createDataFrame(reports, schema)), "name", "seq", "pct")


def test_pause_segments_equal_the_batch_rule(spark, stream, rows):
    schema = "session_id string, received_at timestamp, n_samples int"
    ms = [0, 300, 1100, 1899, 2000, 9000]
    data = [("s", T0 + dt.timedelta(milliseconds=m), 10) for m in ms]
    got = stream([data[:3], data[3:], [("end", T0 + dt.timedelta(days=1), 1)]], schema, lambda s: live.segment_on_pause_stream(s, 800))
    batch = segments.segment_on_pause(spark.createDataFrame([(*d, i) for i, d in enumerate(data)], schema + ", chunk_no long"), 800, emit_tail=True)
    want = batch.groupBy("segment").agg(F.min("received_at"), F.max("received_at"), F.count("*"), F.sum("n_samples")).drop("segment")
    assert rows(got.filter("session_id = 's'"), "first_at", "last_at", "chunks", "offered") == rows(want)


def test_log_sink(spark, tmp_path):
    schema = "ts timestamp, level string, message string"
    spark.createDataFrame([(T0, None, "Connected"), (T0, "warn", "x")], schema).write.parquet(str(tmp_path / "logs"))
    seen = []
    logs = spark.readStream.schema(schema).parquet(str(tmp_path / "logs"))
    text_sources.log_stream_sink(logs, lambda batch, i: seen.extend(r.payload for r in batch.collect()), str(tmp_path / "cp")).awaitTermination()
    assert sorted(seen) == ['{"timestamp":"2026-02-17T00:00:00.000000Z","level":"info","message":"Connected"}',
                            '{"timestamp":"2026-02-17T00:00:00.000000Z","level":"warn","message":"x"}']


def test_fanout_of_a_log_stream(spark, stream, rows):
    subs = spark.createDataFrame([("u", T0, T0 + dt.timedelta(seconds=1))], "subscriber string, start_at timestamp, end_at timestamp")
    data = [(i, T0 + dt.timedelta(milliseconds=m), "info", "m") for i, m in enumerate([0, 999, 1000])]
    got = stream([data], "log_id long, ts timestamp, level string, message string", lambda logs: segments.log_fanout(logs, subs))
    assert rows(got, "subscriber", "log_id") == [("u", 0), ("u", 1)]
