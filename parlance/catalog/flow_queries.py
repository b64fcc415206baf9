"""Flows and streaming queries. A streaming query drains files that Spark wrote from the given tables."""

import numpy as np
from pyspark.sql import functions as F

from parlance import proxies
from parlance.catalog.conversation_queries import CAPACITY, CONTROL, GAP_MS, SEGMENTS, SHORT, fragments, short_chunks, subscriptions
from parlance.catalog.registry import ORACLE, register
from parlance.catalog.source_queries import CHUNKED, RECORDINGS, damaged
from parlance.catalog.transcript_queries import merge_sql
from parlance.functions.text import FAILED_CHUNK
from parlance.operators import conversations, transcripts
from parlance.plans import flows
from parlance.session import new_shared_path
from parlance.sources import text_sources
from parlance.streaming import keyed, live


@register("live_session_turns", f"""WITH {SEGMENTS}, {CONTROL}, turns AS (SELECT session_id, segment, max(received_at) AS ts,
    arg_max(chunk_no, (received_at, chunk_no)) AS event_id, sum(accepted) AS n FROM bounded GROUP BY session_id, segment),
numbered_turns AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY ts, event_id) AS turn_number FROM turns),
merged AS (SELECT session_id, ts, event_id, turn_number, n, NULL AS smart_mode, NULL AS smart_model FROM numbered_turns
  UNION ALL SELECT session_id, ts, event_id, NULL, NULL, smart_mode, smart_model FROM px_control WHERE type = 'config'),
known AS (SELECT *, coalesce(last_value(smart_mode IGNORE NULLS) OVER w, false) AS smart, coalesce(last_value(smart_model IGNORE NULLS) OVER w, 'phi3') AS model
  FROM merged WINDOW w AS (PARTITION BY session_id ORDER BY ts, event_id, turn_number NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
said AS (SELECT *, CASE WHEN n % 9 = 0 THEN '' ELSE 'heard ' || n || ' samples' END AS text FROM known WHERE turn_number IS NOT NULL),
m AS (SELECT session_id, turn_number, 0 AS o, 'transcript' AS type, text AS transcript, NULL AS response FROM said
  UNION ALL SELECT session_id, turn_number, 1, 'thinking', NULL, NULL FROM said WHERE smart
  UNION ALL SELECT session_id, turn_number, 2, 'response', text, CASE WHEN smart THEN model || ': ' || text ELSE text END FROM said)
SELECT session_id, turn_number, CAST(row_number() OVER (PARTITION BY session_id, turn_number ORDER BY o) - 1 AS INTEGER) AS step, type, transcript, response,
  CAST(NULL AS DOUBLE) AS confidence, CAST(NULL AS BOOLEAN) AS is_partial FROM m""")
def live_session_turns(spark, sf):
    def say(turns):
        n = F.col("n_samples")
        return turns.withColumn("transcript", F.when(n % 9 == 0, "").otherwise(F.concat(F.lit("heard "), n.cast("string"), F.lit(" samples"))))

    # Chunks and control rows of one event share its time: even ids stand for the control message first.
    return flows.live_session_turns(
        proxies.live_chunks(spark, sf).withColumn("chunk_no", F.col("chunk_no") * 2 + 1),
        proxies.control(spark, sf).withColumn("event_id", F.col("event_id") * 2), say, GAP_MS, 10_000)


ORACLE["live_session_turns"] = ORACLE["live_session_turns"].replace(
    "user_id AS session_id, event_id AS chunk_no", "user_id AS session_id, event_id * 2 + 1 AS chunk_no").replace(
    "AS setting FROM events)", "AS setting FROM (SELECT user_id, event_id * 2 AS event_id, ts, event_type, props FROM events) e)")


@register("transcribe_recordings", f"""WITH RECURSIVE {RECORDINGS}, {CHUNKED.replace("WHERE n > 0", "WHERE n > 0 AND session_id % 8 IN (0, 5, 6)")},
q AS (SELECT session_id, turn_number, pos, CAST(round(amp * 32768) AS INTEGER) AS q FROM recs),
heard AS (SELECT p.session_id, p.turn_number, p.chunk_idx, p.n, string_agg('w' || q, ' ' ORDER BY pos) AS said, arg_min(q, pos) AS first
  FROM planned p JOIN q ON q.session_id = p.session_id AND q.turn_number = p.turn_number AND q.pos >= p.start_frame AND q.pos < p.end_frame
  GROUP BY p.session_id, p.turn_number, p.chunk_idx, p.n),
{merge_sql(f"""SELECT session_id * 100000 + turn_number AS clip_id, chunk_idx, CASE WHEN first % 5 <> 0 THEN said
  WHEN n <= 256 THEN '[Transcription error: no speech]' ELSE '{FAILED_CHUNK}' END AS cur FROM heard""", transcripts.FLOW_FRACTION)}
SELECT session_id, turn_number, CASE session_id % 8 WHEN 1 THEN 'too_short' WHEN 2 THEN 'no_riff' WHEN 3 THEN 'no_wave' WHEN 4 THEN 'no_data'
  WHEN 7 THEN 'bad_format' END AS reject_reason, coalesce(chunks, 0) AS chunks, coalesce(text, '') AS text
FROM rec_list LEFT JOIN merged ON clip_id = session_id * 100000 + turn_number""")
def transcribe_recordings(spark, sf):
    """Damaged and whole recordings, cut into overlapping chunks; the model spells every sample and fails on some chunks."""
    def load():
        def model(samples):
            values = np.rint(np.asarray(samples, dtype=np.float64) * 32768).astype(int)
            if len(values) and values[0] % 5 == 0:
                raise ValueError("no speech")
            return " ".join(f"w{v}" for v in values)

        return model

    return flows.transcribe_recordings(damaged(spark, sf), load, whole_up_to=0, gate=False, chunk_s=0.016, overlap_s=0.002).drop("confidence")


def _stream(spark, batch, label, compute, once=False):
    """Write ``batch`` as files, stream them through ``compute`` into files, and return those."""
    root = new_shared_path(spark, label)
    batch.write.parquet(f"{root}/in")
    live.drain(compute(spark.readStream.schema(batch.schema).parquet(f"{root}/in")), f"{root}/out", f"{root}/checkpoint", once)
    return spark.read.parquet(f"{root}/out")


@register("segment_on_pause_stream", f"""WITH {SEGMENTS} SELECT session_id, epoch_us(min(received_at)) AS first_us, epoch_us(max(received_at)) AS last_us,
  count(*) AS chunks, CAST(sum(n_samples) AS BIGINT) AS offered FROM segs GROUP BY session_id, segment""")
def segment_on_pause_stream(spark, sf):
    chunks = proxies.live_chunks(spark, sf).select("session_id", "received_at", "n_samples")
    # One row far ahead moves the watermark past every real segment.
    ahead = chunks.agg(F.max("received_at").alias("at")).select(
        F.lit(-1).cast("long").alias("session_id"), (F.col("at") + F.make_dt_interval(days=F.lit(30))).alias("received_at"),
        F.lit(1).alias("n_samples"))
    out = _stream(spark, chunks.unionByName(ahead), "segments", lambda s: live.segment_on_pause_stream(s, GAP_MS))
    return out.filter("session_id >= 0").select(
        "session_id", F.unix_micros("first_at").alias("first_us"), F.unix_micros("last_at").alias("last_us"), "chunks", "offered")


@register("reassemble_fragments_stream", ORACLE["reassemble_fragments"])
def reassemble_fragments_stream(spark, sf):
    return _stream(spark, fragments(spark, sf), "fragments", live.reassemble_fragments_stream)


@register("reassemble_fragments_in_batches", ORACLE["reassemble_fragments"])
def reassemble_fragments_in_batches(spark, sf):
    parts = fragments(spark, sf)
    root = new_shared_path(spark, "fragments")
    parts.write.parquet(f"{root}/in")
    source = spark.readStream.schema(parts.schema).parquet(f"{root}/in")
    live.reassemble_fragments_in_batches(source, f"{root}/out", f"{root}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{root}/out/messages").drop("batch")


@register("log_stream_sink", ORACLE["log_payloads"])
def log_stream_sink(spark, sf):
    """Entries as a stream delivers them: each micro-batch under its id, so that a repeated batch replaces itself."""
    logs = proxies.logs(spark, sf).withColumn("level", F.nullif("level", F.lit("info")))
    root = new_shared_path(spark, "log-stream")
    logs.write.parquet(f"{root}/in")
    source = spark.readStream.schema(logs.schema).parquet(f"{root}/in")
    text_sources.log_stream_sink(
        source, lambda batch, i: batch.write.mode("overwrite").parquet(f"{root}/out/batch={i}"), f"{root}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{root}/out").drop("batch")


@register("throttle_progress_stream", ORACLE["throttle_progress"])
def throttle_progress_stream(spark, sf):
    return _stream(spark, _progress(spark, sf), "progress", live.throttle_progress_stream)


@register("throttle_progress_keyed", ORACLE["throttle_progress"])
def throttle_progress_keyed(spark, sf):
    return _stream(spark, _progress(spark, sf), "progress", keyed.throttle_progress, once=True)


@register("reassemble_fragments_keyed", ORACLE["reassemble_fragments"])
def reassemble_fragments_keyed(spark, sf):
    return _stream(spark, fragments(spark, sf), "fragments", keyed.reassemble_fragments, once=True)


def _progress(spark, sf):
    raw = proxies.table(spark, sf, "events").select(
        F.col("user_id").alias("session_id"), "event_id", F.col("ts").cast("timestamp").alias("ts"), (F.col("value").cast("int") - 3).alias("pct"))
    return conversations.number_turns(raw).select(F.col("session_id").alias("name"), F.col("turn_number").alias("seq"), "pct")


def _ahead(chunks):
    """One chunk of another session far ahead moves the watermark past every real segment."""
    last = chunks.agg(F.max("received_at").alias("at"))
    others = {"session_id": F.lit(-1).cast("long"), "received_at": F.col("at") + F.make_dt_interval(days=F.lit(30)), "n_samples": F.lit(1), "chunk_no": F.lit(-1)}
    return chunks.unionByName(last.select(*[others.get(c, F.lit(None)).cast(t).alias(c) for c, t in chunks.dtypes]))


@register("flush_segments_stream", f"""WITH {SHORT}, firsts AS (SELECT session_id, segment, epoch_us(min(received_at)) AS first_us FROM segs WHERE n_samples > 0 GROUP BY session_id, segment),
spread AS (SELECT session_id, segment, chunk_no, i, row_number() OVER (PARTITION BY session_id, segment ORDER BY received_at, chunk_no, i) AS p
  FROM (SELECT *, greatest(0, least(n_samples, 100 - offered_before)) AS taken FROM segs), LATERAL (SELECT unnest(range(taken)) AS i))
SELECT s.session_id, f.first_us, count(*) AS n_samples, CAST(sum(((chunk_no * 31 + i) % 97) * (p % 89)) AS BIGINT) AS checksum
FROM spread s JOIN firsts f ON f.session_id = s.session_id AND f.segment = s.segment GROUP BY s.session_id, f.first_us""")
def flush_segments_stream(spark, sf):
    chunks = _ahead(short_chunks(spark, sf))
    out = _stream(spark, chunks, "segments", lambda s: keyed.flush_segments(s, GAP_MS, 100)).filter("session_id >= 0 AND samples IS NOT NULL")
    weighted = F.transform("samples", lambda v, i: v.cast("long") * ((i + 1) % 89))
    checksum = F.aggregate(weighted, F.lit(0).cast("long"), lambda acc, v: acc + v)
    return out.select("session_id", F.col("segment_us").alias("first_us"), F.size("samples").cast("long").alias("n_samples"), checksum.alias("checksum"))


@register("buffer_status_stream", ORACLE["buffer_status"])
def buffer_status_stream(spark, sf):
    chunks = _ahead(proxies.live_chunks(spark, sf).select("session_id", "received_at", "chunk_no", "n_samples", F.lit(None).cast("array<float>").alias("samples")))
    out = _stream(spark, chunks, "status", lambda s: keyed.flush_segments(s, GAP_MS, CAPACITY)).filter("session_id >= 0")
    return out.select("session_id", "chunk_no", "held", F.round("fill_percent", 6).alias("fill_percent"))


@register("log_fanout_stream", ORACLE["log_fanout"])
def log_fanout_stream(spark, sf):
    """Entries and subscriptions as two streams. The files hold entries and subscribers that stay together as lists, not every pair."""
    subs, root = subscriptions(spark, sf), new_shared_path(spark, "subscriptions")
    subs.write.parquet(f"{root}/in")
    arriving = spark.readStream.schema(subs.schema).parquet(f"{root}/in")
    out = _stream(spark, proxies.logs(spark, sf), "fanout", lambda logs: keyed.log_fanout(logs, arriving, listed=["subscriber"]))
    return out.select(F.inline("entries"), "subscriber").select(F.explode("subscriber").alias("subscriber"), "log_id", "level", "message")
