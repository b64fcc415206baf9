"""Conversation, control and live-stream queries over ``conversations`` and ``events``."""

from pyspark.sql import functions as F

from parlance import proxies
from parlance.catalog.registry import register
from parlance.functions import audio
from parlance.operators import conversations, progress, segments

GAP_MS = 1_800_000
CAPACITY = 10_000

_TYPES = """CASE event_type WHEN 'signup' THEN 'config' WHEN 'error' THEN 'clear_history' ELSE 'audio' END"""
EVENTS = f"""px_events AS (SELECT user_id AS session_id, event_id, ts, {_TYPES} AS type,
  CAST(json_extract_string(props, '$.k') AS INTEGER) AS setting FROM events)"""
CONTROL = f"""{EVENTS}, px_control AS (SELECT session_id, event_id, ts, type,
  CASE WHEN type = 'config' AND setting % 3 <> 0 THEN setting % 2 = 1 END AS smart_mode,
  CASE WHEN type = 'config' AND setting % 2 = 0 THEN 'm' || setting END AS smart_model
  FROM px_events WHERE type <> 'audio')"""
CHUNKS = """px_chunks AS (SELECT user_id AS session_id, event_id AS chunk_no, ts AS received_at,
  CAST(trunc(value * 100) AS INTEGER) AS n_samples FROM events)"""
SEGMENTS = f"""{CHUNKS}, broken AS (SELECT *, CASE WHEN epoch_us(received_at) - lag(epoch_us(received_at))
    OVER (PARTITION BY session_id ORDER BY received_at, chunk_no) >= {GAP_MS} * 1000 THEN 1 ELSE 0 END AS brk
  FROM px_chunks WHERE n_samples > 0),
numbered AS (SELECT *, CAST(sum(brk) OVER (PARTITION BY session_id ORDER BY received_at, chunk_no) AS BIGINT) AS segment FROM broken),
segs AS (SELECT *, CAST(coalesce(sum(n_samples) OVER (PARTITION BY session_id, segment ORDER BY received_at, chunk_no
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS offered_before,
    segment < max(segment) OVER (PARTITION BY session_id) AS is_closed FROM numbered),
bounded AS (SELECT *, greatest(0, least(n_samples, {CAPACITY} - offered_before)) AS accepted FROM segs WHERE is_closed)"""


def micros(df, *names):
    return df.withColumns({n: F.unix_micros(n) for n in names})


def _segmented(spark, sf, emit_tail=False):
    return segments.segment_on_pause(proxies.live_chunks(spark, sf), GAP_MS, emit_tail)


@register("segment_on_pause", f"""WITH {SEGMENTS} SELECT session_id, chunk_no, segment, offered_before, is_closed FROM segs WHERE is_closed""")
def segment_on_pause(spark, sf):
    return _segmented(spark, sf).select("session_id", "chunk_no", "segment", "offered_before", "is_closed")


@register("segment_on_pause_with_tail", f"""WITH {SEGMENTS} SELECT session_id, chunk_no, segment, offered_before, is_closed FROM segs""")
def segment_on_pause_with_tail(spark, sf):
    return _segmented(spark, sf, True).select("session_id", "chunk_no", "segment", "offered_before", "is_closed")


@register("bounded_segments", f"""WITH {SEGMENTS} SELECT session_id, segment, chunk_no, n_samples, accepted,
  n_samples - accepted AS dropped FROM bounded""")
def bounded_segments(spark, sf):
    return segments.bounded_segments(_segmented(spark, sf), CAPACITY).select(
        "session_id", "segment", "chunk_no", "n_samples", "accepted", "dropped")


@register("buffer_status", f"""WITH {SEGMENTS} SELECT session_id, chunk_no, least({CAPACITY}, offered_before + n_samples) AS held,
  round(least({CAPACITY}, offered_before + n_samples) / {CAPACITY}.0 * 100, 6) AS fill_percent FROM segs""")
def buffer_status(spark, sf):
    status = segments.buffer_status(_segmented(spark, sf, True), CAPACITY)
    return status.select("session_id", "chunk_no", "held", F.round("fill_percent", 6).alias("fill_percent"))


@register("segments_per_session", f"""WITH {SEGMENTS}, per_segment AS (SELECT session_id, segment, count(*) AS chunks,
  sum(accepted) AS accepted, sum(n_samples - accepted) AS dropped, min(received_at) AS first_at, max(received_at) AS last_at
  FROM bounded GROUP BY session_id, segment)
SELECT session_id, count(*) AS segments, CAST(sum(chunks) AS BIGINT) AS chunks, CAST(sum(accepted) AS BIGINT) AS accepted,
  CAST(sum(dropped) AS BIGINT) AS dropped, CAST(max(accepted) AS BIGINT) AS largest_segment,
  epoch_us(min(first_at)) AS first_us, epoch_us(max(last_at)) AS last_us FROM per_segment GROUP BY session_id""")
def segments_per_session(spark, sf):
    return segments.segment_rollup(segments.bounded_segments(_segmented(spark, sf), CAPACITY))


SHORT = SEGMENTS.replace("trunc(value * 100)", "trunc(value)").replace(f"{CAPACITY} - offered", "100 - offered")


def short_chunks(spark, sf):
    n = audio.div(F.col("n_samples").cast("long"), 100)
    return proxies.live_chunks(spark, sf).withColumn("n_samples", n).filter(F.col("n_samples") > 0).withColumn(
        "samples", F.transform(F.sequence(F.lit(0).cast("long"), F.col("n_samples") - 1),
                               lambda i: ((F.col("chunk_no") * 31 + i) % 97).cast("float")))


@register("flush_segments", f"""WITH {SHORT}, spread AS (
  SELECT session_id, segment, chunk_no, i, row_number() OVER (PARTITION BY session_id, segment ORDER BY received_at, chunk_no, i) AS p
  FROM bounded, LATERAL (SELECT unnest(range(accepted)) AS i))
SELECT session_id, segment, count(*) AS n_samples, CAST(sum(((chunk_no * 31 + i) % 97) * (p % 89)) AS BIGINT) AS checksum
FROM spread GROUP BY session_id, segment""")
def flush_segments(spark, sf):
    segmented = segments.segment_on_pause(short_chunks(spark, sf), GAP_MS)
    flushed = segments.flush_segments(segments.bounded_segments(segmented, 100))
    weighted = F.transform("samples", lambda v, i: v.cast("long") * ((i + 1) % 89))
    checksum = F.aggregate(weighted, F.lit(0).cast("long"), lambda acc, v: acc + v)
    return flushed.select("session_id", "segment", F.size("samples").cast("long").alias("n_samples"), checksum.alias("checksum"))


@register("reassemble_fragments", """WITH f AS (SELECT user_id AS connection, event_id AS seq, event_type || ';' AS part,
  event_type = 'purchase' AS is_end FROM events),
n AS (SELECT *, CAST(coalesce(sum(CASE WHEN is_end THEN 1 ELSE 0 END) OVER (PARTITION BY connection ORDER BY seq
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS message_no FROM f)
SELECT connection, message_no, count(*) AS fragments, string_agg(part, '' ORDER BY seq) AS text
FROM n GROUP BY connection, message_no HAVING bool_or(is_end)""")
def reassemble_fragments(spark, sf, **blocks):
    return segments.reassemble_fragments(fragments(spark, sf), **blocks)


def fragments(spark, sf):
    return proxies.table(spark, sf, "events").select(
        F.col("user_id").alias("connection"), F.col("event_id").alias("seq"),
        F.concat("event_type", F.lit(";")).alias("part"), (F.col("event_type") == "purchase").alias("is_end"))


_LOGS = """px_logs AS (SELECT event_id AS log_id, ts, CASE event_type WHEN 'error' THEN 'error' WHEN 'signup' THEN 'warn' ELSE 'info' END AS level,
  event_type || ' ' || props AS message FROM events)"""


@register("log_fanout", f"""WITH {_LOGS}, subs AS (SELECT event_id AS subscriber, ts AS start_at,
  ts + to_seconds(60 * CAST(1 + value % 20 AS INTEGER)) AS end_at FROM events WHERE event_type = 'signup')
SELECT s.subscriber, l.log_id, l.level, l.message FROM px_logs l JOIN subs s ON l.ts >= s.start_at AND l.ts < s.end_at""")
def log_fanout(spark, sf):
    return segments.log_fanout(proxies.logs(spark, sf), subscriptions(spark, sf)).select("subscriber", "log_id", "level", "message")


def subscriptions(spark, sf):
    minutes = F.rint(1 + F.col("value") % 20).cast("int")
    return proxies.table(spark, sf, "events").filter("event_type = 'signup'").select(
        F.col("event_id").alias("subscriber"), F.col("ts").cast("timestamp").alias("start_at"), minutes.alias("m")
    ).withColumn("end_at", F.col("start_at") + F.make_dt_interval(mins=F.col("m"))).drop("m")


@register("throttle_progress", """WITH RECURSIVE p AS (SELECT user_id AS name,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq,
  CAST(greatest(0, least(100, CAST(trunc(value) AS INTEGER) - 3)) AS INTEGER) AS pct FROM events),
fold AS (
  SELECT name, seq, pct, pct >= 4 OR pct = 100 AS kept, CASE WHEN pct >= 4 OR pct = 100 THEN pct ELSE -1 END AS last FROM p WHERE seq = 1
  UNION ALL
  SELECT p.name, p.seq, p.pct, p.pct >= f.last + 5 OR p.pct = 100,
         CASE WHEN p.pct >= f.last + 5 OR p.pct = 100 THEN p.pct ELSE f.last END
  FROM fold f JOIN p ON p.name = f.name AND p.seq = f.seq + 1)
SELECT name, seq, pct FROM fold WHERE kept""")
def throttle_progress(spark, sf):
    raw = proxies.table(spark, sf, "events").select(
        F.col("user_id").alias("session_id"), "event_id", F.col("ts").cast("timestamp").alias("ts"),
        (F.col("value").cast("int") - 3).alias("pct"))
    numbered = conversations.number_turns(raw).select(
        F.col("session_id").alias("name"), F.col("turn_number").alias("seq"), "pct")
    return progress.throttle_progress(numbered)


@register("progress_percent", """SELECT l_orderkey AS name, l_linenumber AS seq, l_partkey AS bytes_key, round(CASE WHEN total > 0 THEN bytes / total * 100.0 ELSE -1 END, 6) AS percent,
  printf('%.1f MB', bytes / 1048576.0) AS done_text, CASE WHEN total > 0 THEN printf('%.1f MB', total / 1048576.0) END AS total_text
FROM (SELECT *, CAST(trunc(l_extendedprice * 1000) AS BIGINT) AS bytes,
  CASE WHEN l_linenumber % 3 = 0 THEN -1 ELSE CAST(trunc(l_extendedprice * 2000) AS BIGINT) + 1 END AS total FROM lineitem)""")
def progress_percent(spark, sf):
    price = F.col("l_extendedprice")
    reports = proxies.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("name"), F.col("l_linenumber").alias("seq"), F.col("l_partkey").alias("bytes_key"),
        (price * 1000).cast("long").alias("bytes"),
        F.when(F.col("l_linenumber") % 3 == 0, F.lit(-1).cast("long")).otherwise((price * 2000).cast("long") + 1).alias("total_bytes"))
    return progress.progress_percent(reports).select(
        "name", "seq", "bytes_key", F.round("percent", 6).alias("percent"), "done_text", "total_text")


@register("number_turns", f"""WITH {EVENTS} SELECT session_id, event_id,
  row_number() OVER (PARTITION BY session_id ORDER BY ts, event_id) AS turn_number FROM px_events WHERE type = 'audio'""")
def number_turns(spark, sf):
    return conversations.number_turns(proxies.audio_turns(spark, sf)).select("session_id", "event_id", "turn_number")


@register("pair_turns", """WITH n AS (SELECT conv_id AS session_id, turn AS seq, role, text,
  lead(role) OVER w AS next_role, lead(text) OVER w AS next_text FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT session_id, seq, text AS user_transcript, CASE WHEN next_role = 'assistant' THEN next_text END AS assistant_response
FROM n WHERE role = 'user'""")
def pair_turns(spark, sf, **blocks):
    return conversations.pair_turns(proxies.messages(spark, sf), **blocks)


_SPOKEN = """spoken AS (SELECT conv_id AS session_id, turn AS seq, CASE
  WHEN turn % 5 = 3 THEN '[Transcription error: ' || left(text, 10) || ']' WHEN turn % 7 = 4 THEN '[transcription ERROR] lost'
  WHEN turn % 6 = 5 THEN text || ' [Error processing chunk]' ELSE text END AS text FROM conversations)"""


def _spoken(spark, sf):
    t, text = F.col("seq"), F.col("text")
    return proxies.messages(spark, sf).select(
        "session_id", "seq",
        F.when(t % 5 == 3, F.concat(F.lit("[Transcription error: "), F.left(text, F.lit(10)), F.lit("]")))
        .when(t % 7 == 4, "[transcription ERROR] lost")
        .when(t % 6 == 5, F.concat(text, F.lit(" [Error processing chunk]"))).otherwise(text).alias("text"))


@register("drop_failed_transcripts", f"""WITH {_SPOKEN} SELECT session_id, seq, text, contains(text, '[Error processing chunk]') AS chunk_failed
FROM spoken WHERE NOT starts_with(lower(text), '[transcription error]')""")
def drop_failed_transcripts(spark, sf):
    return conversations.drop_failed_transcripts(_spoken(spark, sf))


@register("drop_failed_transcripts_strict", f"""WITH {_SPOKEN} SELECT session_id, seq, text, contains(text, '[Error processing chunk]') AS chunk_failed
FROM spoken WHERE NOT starts_with(lower(text), '[transcription error') AND text <> '[Error processing chunk]'""")
def drop_failed_transcripts_strict(spark, sf):
    return conversations.drop_failed_transcripts(_spoken(spark, sf), strict=True)


@register("route_turns", f"""WITH {_SPOKEN}, t AS (SELECT session_id, seq, text AS transcript, 're: ' || text AS reply, (seq % 10) / 10.0 AS confidence,
    session_id % 2 = 0 AS smart, session_id % 3 = 0 AS realtime, starts_with(lower(text), '[transcription error]') AS failed FROM spoken),
m AS (
  SELECT session_id, seq, 0 AS o, CASE WHEN realtime THEN 'partial_transcript' ELSE 'transcript' END AS type, transcript,
    NULL AS response, CASE WHEN realtime THEN CASE WHEN failed THEN 0.0 ELSE confidence END END AS confidence,
    CASE WHEN realtime THEN NOT failed END AS is_partial FROM t
  UNION ALL SELECT session_id, seq, 1, 'thinking', NULL, NULL, NULL, NULL FROM t WHERE smart AND NOT failed
  UNION ALL SELECT session_id, seq, 2, CASE WHEN realtime THEN 'partial_llm' ELSE 'response' END,
    CASE WHEN NOT realtime THEN transcript END, CASE WHEN smart THEN reply ELSE transcript END, NULL, NULL FROM t WHERE NOT failed
  UNION ALL SELECT session_id, seq, 3, 'audio_chunk', NULL, NULL, NULL, NULL FROM t WHERE realtime AND NOT failed)
SELECT session_id, seq, CAST(row_number() OVER (PARTITION BY session_id, seq ORDER BY o) - 1 AS INTEGER) AS step, type, transcript, response,
  CAST(confidence AS DOUBLE) AS confidence, is_partial FROM m""")
def route_turns(spark, sf):
    turns = _spoken(spark, sf).select(
        "session_id", "seq", F.col("text").alias("transcript"), F.concat(F.lit("re: "), "text").alias("reply"),
        ((F.col("seq") % 10) / 10.0).alias("confidence"), (F.col("session_id") % 2 == 0).alias("smart_mode"),
        (F.col("session_id") % 3 == 0).alias("realtime_mode"))
    return conversations.route_turns(turns)


@register("session_rollup", f"""WITH {EVENTS}, t AS (SELECT *, CASE WHEN setting % 4 <> 0 THEN setting / 10.0 END AS user_s,
    CASE WHEN setting % 5 <> 0 THEN setting / 20.0 END AS assistant_s, setting % 2 = 0 AS smart FROM px_events WHERE type = 'audio')
SELECT session_id, epoch_us(min(ts)) AS start_time, epoch_us(max(ts)) AS end_time, count(*) AS turns,
  round(sum(coalesce(user_s, 0) + coalesce(assistant_s, 0)), 4) AS speaking_seconds,
  round(count(*) FILTER (WHERE smart) / count(*), 6) AS smart_share FROM t GROUP BY session_id""")
def session_rollup(spark, sf):
    k = F.col("setting")
    turns = proxies.audio_turns(spark, sf).withColumns({
        "user_audio_duration": F.when(k % 4 != 0, k / 10.0), "assistant_audio_duration": F.when(k % 5 != 0, k / 20.0),
        "smart_mode": k % 2 == 0})
    out = micros(conversations.session_rollup(turns), "start_time", "end_time")
    return out.withColumns({"speaking_seconds": F.round("speaking_seconds", 4), "smart_share": F.round("smart_share", 6)})


@register("attach_durations", """WITH h AS (SELECT 'o' || o_orderkey AS path, CASE WHEN o_orderkey % 11 <> 0 THEN o_totalprice / 1000 END AS d
  FROM orders WHERE o_orderkey % 13 <> 0),
t AS (SELECT l_suppkey AS session_id, l_orderkey * 8 + l_linenumber AS turn_number, l_partkey,
  CASE WHEN l_linenumber % 3 <> 0 THEN 'o' || l_orderkey END AS user_audio_file, 'o' || (l_orderkey + 7) AS assistant_audio_file FROM lineitem)
SELECT session_id, turn_number, l_partkey, user_audio_file, assistant_audio_file,
  CASE WHEN u.path IS NOT NULL THEN coalesce(u.d, 0) END AS user_audio_duration,
  CASE WHEN a.path IS NOT NULL THEN coalesce(a.d, 0) END AS assistant_audio_duration
FROM t LEFT JOIN h u ON u.path = t.user_audio_file LEFT JOIN h a ON a.path = t.assistant_audio_file""")
def attach_durations(spark, sf):
    key = F.col("o_orderkey")
    headers = proxies.table(spark, sf, "orders").filter(key % 13 != 0).select(
        F.concat(F.lit("o"), key.cast("string")).alias("path"),
        F.when(key % 11 != 0, F.col("o_totalprice") / 1000).alias("duration"))
    order, line = F.col("l_orderkey"), F.col("l_linenumber")
    turns = proxies.table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("session_id"), (order * 8 + line).alias("turn_number"), "l_partkey",
        F.when(line % 3 != 0, F.concat(F.lit("o"), order.cast("string"))).alias("user_audio_file"),
        F.concat(F.lit("o"), (order + 7).cast("string")).alias("assistant_audio_file"))
    return conversations.attach_durations(turns, headers)


_AS_OF = f"""{CONTROL}, merged AS (
  SELECT session_id, event_id, ts, setting, true AS is_turn, NULL AS smart_mode, NULL AS smart_model, NULL AS pause_ms FROM px_events WHERE type = 'audio'
  UNION ALL SELECT session_id, event_id, ts, NULL, false, smart_mode, smart_model, CASE WHEN event_id % 3 = 0 THEN CAST(500 + event_id % 7 * 100 AS INTEGER) END FROM px_control WHERE type = 'config'),
as_of AS (SELECT session_id, event_id, ts, setting, is_turn,
  coalesce(last_value(smart_mode IGNORE NULLS) OVER w, false) AS smart_mode,
  coalesce(last_value(smart_model IGNORE NULLS) OVER w, 'phi3') AS smart_model,
  coalesce(last_value(pause_ms IGNORE NULLS) OVER w, 800) AS pause_ms FROM merged
  WINDOW w AS (PARTITION BY session_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""


@register("config_as_of", f"WITH {_AS_OF} SELECT session_id, event_id, setting, smart_mode, smart_model, pause_ms FROM as_of WHERE is_turn")
def config_as_of(spark, sf):
    number = F.col("event_id")
    control = proxies.control(spark, sf).withColumn("pause_ms", F.when(number % 3 == 0, (500 + number % 7 * 100).cast("int")))
    turns = conversations.config_as_of(proxies.audio_turns(spark, sf), control)
    return turns.select("session_id", "event_id", "setting", "smart_mode", "smart_model", "pause_ms")


_EPOCHS = f"""{EVENTS}, counted AS (SELECT *, CAST(sum(CASE WHEN type = 'clear_history' THEN 1 ELSE 0 END)
    OVER (PARTITION BY session_id ORDER BY ts, event_id) AS BIGINT) AS epoch FROM px_events WHERE type <> 'config'),
placed AS (SELECT session_id, event_id, epoch, row_number() OVER (PARTITION BY session_id, epoch ORDER BY ts, event_id) AS position
  FROM counted WHERE type = 'audio')"""


def _placed(spark, sf):
    events = proxies.session_events(spark, sf).filter("type != 'config'").select(
        "session_id", "event_id", "ts", (F.col("type") == "clear_history").alias("is_clear"))
    return conversations.history_since_clear(events)


@register("history_since_clear", f"WITH {_EPOCHS} SELECT session_id, event_id, epoch, position FROM placed")
def history_since_clear(spark, sf):
    return _placed(spark, sf).select("session_id", "event_id", "epoch", "position")


@register("history_ranges", f"""WITH {_EPOCHS} SELECT session_id, event_id, epoch, position, CAST(1 AS BIGINT) AS first_message,
  (position - 1) * 2 AS last_message, (position - 1) * 2 AS history_size FROM placed""")
def history_ranges(spark, sf):
    return conversations.history_ranges(_placed(spark, sf)).drop("ts")


@register("chat_history", f"""WITH {_EPOCHS}, said AS (SELECT session_id, epoch, position, o, CASE o WHEN 0 THEN 'user:t' || event_id
    ELSE 'assistant:r' || event_id END AS message FROM placed, range(2) r(o)),
seen AS (SELECT t.session_id, t.epoch, t.position, m.position AS mp, m.o, m.message
  FROM placed t LEFT JOIN said m ON m.session_id = t.session_id AND m.epoch = t.epoch AND m.position < t.position
   AND (t.position - m.position - 1) * 2 + 2 - m.o <= 5)
SELECT session_id, epoch, position, coalesce(string_agg(message, '|' ORDER BY mp, o), '') AS history FROM seen GROUP BY ALL""")
def chat_history(spark, sf):
    turns = _placed(spark, sf).withColumns({
        "transcript": F.concat(F.lit("t"), F.col("event_id").cast("string")),
        "reply": F.concat(F.lit("r"), F.col("event_id").cast("string"))})
    out = conversations.chat_history(turns, max_messages=5)
    text = F.array_join(F.transform("history", lambda m: F.concat(m["role"], F.lit(":"), m["content"])), "|")
    return out.select("session_id", "epoch", "position", text.alias("history"))


@register("expire_sessions", """WITH s AS (SELECT user_id AS session_id, max(ts) AS created_at FROM events GROUP BY user_id)
SELECT session_id, epoch_us(created_at) AS created_at, created_at < TIMESTAMP '2024-01-31 12:00:00' - INTERVAL 1 DAY AS expired FROM s""")
def expire_sessions(spark, sf):
    sessions = proxies.session_events(spark, sf).groupBy("session_id").agg(F.max("ts").alias("created_at"))
    now = F.lit("2024-01-31 12:00:00").cast("timestamp")
    return micros(conversations.expire_sessions(sessions, 1, now), "created_at")


@register("latency_report", """SELECT event_type, count(*) AS calls, round(sum(value), 4) AS audio_s, round(sum(w), 4) AS wall_s,
  round(sum(w) / nullif(sum(value), 0), 6) AS real_time_factor, round(sum(value) / nullif(sum(w), 0), 6) AS throughput, round(avg(w), 6) AS mean_wall_s,
  round(stddev_pop(w), 6) AS stddev_wall_s, round(sum(w) / nullif(sum(value) / 60, 0), 6) AS wall_s_per_audio_minute,
  round(quantile_disc(w, 0.5), 6) AS p50_wall_s, round(quantile_disc(w, 0.95), 6) AS p95_wall_s, round(quantile_disc(w, 0.99), 6) AS p99_wall_s
FROM (SELECT event_type, CASE event_type WHEN 'error' THEN 0.0 ELSE value END AS value, CASE event_type WHEN 'view' THEN 0.0 ELSE value * 0.3 + 1 END AS w FROM events) GROUP BY event_type""")
def latency_report(spark, sf):
    calls = proxies.table(spark, sf, "events").select(
        "event_type", F.when(F.col("event_type") == "error", 0.0).otherwise(F.col("value")).alias("audio_s"),
        F.when(F.col("event_type") == "view", 0.0).otherwise(F.col("value") * 0.3 + 1).alias("wall_s"))
    out = conversations.latency_report(calls, ["event_type"])
    return out.withColumns({c: F.round(c, 4 if c in ("audio_s", "wall_s") else 6) for c in out.columns[2:]})
