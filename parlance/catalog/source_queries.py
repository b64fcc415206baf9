"""Source and sink queries. Files they scan are first written, by Spark, from the given tables to the shared folder."""

import struct

from pyspark.sql import functions as F

from parlance import proxies
from parlance.catalog.conversation_queries import micros
from parlance.catalog.registry import register
from parlance.catalog.signal_queries import SAMPLES, rounded
from parlance.functions import audio
from parlance.operators import conversations
from parlance.ordered import sequence_block
from parlance.session import new_shared_path
from parlance.sources import ranges, recordings, sessions, text_sources

RECORDINGS = f"""{SAMPLES}, recs AS (SELECT clip_id AS session_id, CAST(idx // 8192 AS INTEGER) + 1 AS turn_number, idx % 8192 AS pos,
  trunc(greatest(least(amp, 1.0), -1.0) * 32767.0) / 32768.0 AS amp FROM px_samples),
rec_list AS (SELECT session_id, turn_number, count(*) AS n FROM recs GROUP BY session_id, turn_number)"""


def _encoded(spark, sf, rate=audio.SAMPLE_RATE):
    return recordings.encode_wav(proxies.recordings(spark, sf), rate)


@register("scan_recordings", f"""WITH {RECORDINGS} SELECT CAST(session_id AS VARCHAR) AS session_id, turn_number, 'user' AS role, 44 + 2 * n AS length FROM rec_list""")
def scan_recordings(spark, sf):
    root = new_shared_path(spark, "recordings")
    recordings.export_wav(_encoded(spark, sf), root)
    return recordings.scan_recordings(spark, root).select("session_id", "turn_number", "role", "length")


def damaged(spark, sf):
    """Kinds of files by session: intact, cut short, wrong magic twice, no data chunk, an extra odd-sized chunk, an
    unsupported format, a sample rate of zero."""
    w, kind = F.col("content"), F.col("session_id") % 8

    def raw(data: bytes):
        return F.lit(bytearray(data))

    rest = F.length("content")
    return _encoded(spark, sf).withColumn(
        "content",
        F.when(kind == 1, F.substring(w, 1, 20))
        .when(kind == 2, F.concat(raw(b"RIFX"), F.substring(w, F.lit(5), rest)))
        .when(kind == 3, F.concat(F.substring(w, 1, 8), raw(b"WAVX"), F.substring(w, F.lit(13), rest)))
        .when(kind == 4, F.concat(F.substring(w, 1, 36), raw(b"junk"), F.substring(w, F.lit(41), rest)))
        .when(kind == 5, F.concat(F.substring(w, 1, 36), raw(b"LIST" + struct.pack("<i", 3) + b"abc\0"), F.substring(w, F.lit(37), rest)))
        .when(kind == 6, F.concat(F.substring(w, 1, 20), raw(b"\3\0"), F.substring(w, F.lit(23), rest)))
        .when(kind == 7, F.concat(F.substring(w, 1, 24), raw(bytes(4)), F.substring(w, F.lit(29), rest)))
        .otherwise(w))


@register("wav_header", f"""WITH {RECORDINGS} SELECT session_id, turn_number, CASE session_id % 8 WHEN 6 THEN 3 ELSE 1 END AS audio_format,
  1 AS channels, CASE WHEN session_id % 8 = 7 THEN 0 ELSE 16000 END AS sample_rate, 16 AS bits,
  CAST(CASE WHEN session_id % 8 IN (0, 6) THEN 44 WHEN session_id % 8 = 5 THEN 56 END AS BIGINT) AS data_offset,
  CASE WHEN session_id % 8 IN (0, 5, 6) THEN 2 * n END AS data_len,
  CASE session_id % 8 WHEN 1 THEN 'too_short' WHEN 2 THEN 'no_riff' WHEN 3 THEN 'no_wave' WHEN 4 THEN 'no_data' WHEN 7 THEN 'bad_format' END AS reject_reason,
  CASE WHEN session_id % 8 = 6 THEN 'unsupported_format' END AS warning FROM rec_list""")
def wav_header(spark, sf):
    return recordings.wav_header(damaged(spark, sf)).drop("content", "role")


@register("header_duration", f"""WITH {RECORDINGS} SELECT session_id, turn_number,
  round(CASE WHEN session_id % 8 = 1 THEN 0.0 WHEN session_id % 8 = 5 THEN 3 / 32000.0 WHEN session_id % 8 = 7 THEN NULL ELSE 2 * n / 32000.0 END, 6) AS header_duration,
  round(CASE WHEN session_id % 8 IN (0, 5, 6) THEN 2 * n / 32000.0 END, 6) AS exact_duration FROM rec_list""")
def header_duration(spark, sf):
    both = recordings.fixed_offset_duration(recordings.wav_header(damaged(spark, sf)))
    exact = F.when(F.col("reject_reason").isNull(), audio.exact_duration(
        F.col("data_len"), F.col("sample_rate"), F.col("channels"), F.col("bits")))
    return rounded(both.withColumn("exact_duration", exact).select(
        "session_id", "turn_number", "header_duration", "exact_duration"), "header_duration", "exact_duration")


CHUNKED = """planned AS (SELECT session_id, turn_number, n, CAST(c AS INTEGER) AS chunk_idx, c * 224 AS start_frame, least(c * 224 + 256, n) AS end_frame
  FROM rec_list, LATERAL (SELECT unnest(range(CASE WHEN n <= 256 THEN 1 ELSE (n - 256 + 223) // 224 + 1 END)) AS c) WHERE n > 0)"""


def _exploded(chunks):
    return chunks.select(
        "session_id", "turn_number", "chunk_idx", "start_frame", "end_frame",
        F.posexplode("samples").alias("pos", "amp")).withColumns({"pos": F.col("pos").cast("long"), "amp": F.round(F.col("amp").cast("double"), 5)})


@register("decode_pcm", f"""WITH {RECORDINGS}, {CHUNKED} SELECT p.session_id, p.turn_number, chunk_idx, start_frame, end_frame, r.pos - start_frame AS pos,
  round(r.amp, 5) AS amp FROM planned p JOIN recs r ON r.session_id = p.session_id AND r.turn_number = p.turn_number
  AND r.pos >= start_frame AND r.pos < end_frame""")
def decode_pcm(spark, sf):
    return _exploded(recordings.decode_pcm(recordings.wav_header(_encoded(spark, sf)), chunk_s=0.016, overlap_s=0.002))


@register("decode_ranges", f"""WITH {RECORDINGS}, {CHUNKED} SELECT CAST(p.session_id AS VARCHAR) AS session_id, p.turn_number, chunk_idx, start_frame, end_frame,
  r.pos - start_frame AS pos, round(r.amp, 5) AS amp FROM planned p JOIN recs r ON r.session_id = p.session_id AND r.turn_number = p.turn_number
  AND r.pos >= start_frame AND r.pos < end_frame""")
def decode_ranges(spark, sf):
    """The files of ``scan_recordings``, each read in pieces of a few chunks."""
    root = new_shared_path(spark, "recordings")
    recordings.export_wav(_encoded(spark, sf), root)
    return _exploded(ranges.read_chunks(spark, root, chunk_s=0.016, overlap_s=0.002, split_bytes=1_000))


@register("decode_pcm_resampled", f"""WITH {RECORDINGS.replace("rec_list AS (SELECT session_id, turn_number, count(*) AS n", "rec_list AS (SELECT session_id, turn_number, CAST(trunc(count(*) / (44100.0 / 16000)) AS BIGINT) AS n")}, {CHUNKED},
outs AS (SELECT *, unnest(range(start_frame, end_frame)) AS i FROM planned), placed AS (SELECT *, i * (CAST(44100 AS DOUBLE) / 16000) AS x FROM outs)
SELECT p.session_id, p.turn_number, chunk_idx, start_frame, end_frame, i - start_frame AS pos,
  round(CAST(CAST(CASE WHEN b.amp IS NULL THEN a.amp ELSE a.amp * (1 - (x - floor(x))) + b.amp * (x - floor(x)) END AS FLOAT) AS DOUBLE), 5) AS amp
FROM placed p JOIN recs a ON a.session_id = p.session_id AND a.turn_number = p.turn_number AND a.pos = CAST(floor(x) AS BIGINT)
LEFT JOIN recs b ON b.session_id = p.session_id AND b.turn_number = p.turn_number AND b.pos = CAST(floor(x) AS BIGINT) + 1""")
def decode_pcm_resampled(spark, sf):
    return _exploded(recordings.decode_pcm(recordings.wav_header(_encoded(spark, sf, 44100)), chunk_s=0.016, overlap_s=0.002))


_TURNS = """linked AS (SELECT conv_id, turn, role, text, lead(role) OVER w AS next_role, lead(text) OVER w AS next_text FROM conversations
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
turns AS (SELECT CAST(conv_id AS VARCHAR) AS session_id, CAST(turn + 1 AS INTEGER) AS turn_number, text AS user_transcript,
  coalesce(CASE WHEN next_role = 'assistant' THEN next_text END, '') AS assistant_response FROM linked WHERE role = 'user')"""


def _turns(spark, sf):
    paired = conversations.pair_turns(proxies.messages(spark, sf))
    start = F.lit("2024-01-01").cast("timestamp")
    return paired.select(
        F.col("session_id").cast("string").alias("session_id"), (F.col("seq") + 1).cast("int").alias("turn_number"),
        (start + F.make_dt_interval(secs=F.col("seq").cast("decimal(18,6)"))).alias("ts"), "user_transcript",
        F.coalesce("assistant_response", F.lit("")).alias("assistant_response"))


@register("session_documents", f"""WITH {_TURNS} SELECT session_id, min(turn_number) - 1 AS first_second, count(*) AS turns,
  CAST(to_json(list({{'turnNumber': turn_number, 'userTranscript': user_transcript, 'assistantResponse': assistant_response}} ORDER BY turn_number)) AS VARCHAR) AS doc
FROM turns GROUP BY session_id""")
def session_documents(spark, sf):
    docs = sessions.session_documents(_turns(spark, sf))
    short = F.transform("doc.turns", lambda t: F.struct(
        t["turnNumber"].alias("turnNumber"), t["userTranscript"].alias("userTranscript"), t["assistantResponse"].alias("assistantResponse")))
    return docs.select(
        "session_id", (F.unix_seconds("doc.startTime") - 1704067200).cast("int").alias("first_second"),
        F.size("doc.turns").cast("long").alias("turns"), F.to_json(short).alias("doc"))


@register("scan_sessions", f"WITH {_TURNS} SELECT session_id, turn_number, (turn_number - 1) * 1000000 AS us, user_transcript, assistant_response FROM turns")
def scan_sessions(spark, sf):
    root = new_shared_path(spark, "sessions")
    sessions.write_sessions(_turns(spark, sf), root)
    turns = sessions.explode_turns(sessions.scan_sessions(spark, root))
    return turns.select("session_id", "turn_number", (F.unix_micros("ts") - 1704067200000000).cast("int").alias("us"),
                        "user_transcript", "assistant_response")


@register("scan_session_logs", """WITH l AS (SELECT user_id % 50 AS user_id, event_id, ts, event_type || ' ' || props AS message,
  CASE event_type WHEN 'error' THEN 'error' WHEN 'signup' THEN 'warn' ELSE 'info' END AS level FROM events)
SELECT CAST(user_id AS VARCHAR) AS session_id, CASE WHEN event_id % 50 = 0 THEN 'no_match' WHEN event_id % 50 = 1 THEN 'bad_timestamp' END AS reject_reason,
  CASE WHEN event_id % 50 > 1 THEN epoch_us(ts) END AS ts, CASE WHEN event_id % 50 > 0 THEN level END AS level,
  CASE WHEN event_id % 50 > 0 THEN message END AS message FROM l""")
def scan_session_logs(spark, sf):
    root = new_shared_path(spark, "logs")
    entries = proxies.logs(spark, sf).join(
        proxies.table(spark, sf, "events").select(F.col("event_id").alias("log_id"), (F.col("user_id") % 50).alias("session")), "log_id")
    tail = F.concat(F.lit(" ["), "level", F.lit("] "), "message")
    line = F.when(F.col("log_id") % 50 == 0, F.concat("level", F.lit(": "), "message")).when(
        F.col("log_id") % 50 == 1, F.concat(F.lit("yesterday"), tail)).otherwise(
        F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'0+00:00'"), tail))
    # A session's lines may fill several files, so that no task writes a whole hot session.
    entries.select("session", line.alias("value"), sequence_block("log_id").alias("b")).repartition("session", "b").drop(
        "b").write.partitionBy("session").text(root)
    return micros(text_sources.scan_session_logs(spark, root), "ts").select("session_id", "reject_reason", "ts", "level", "message")


_PAYLOADS = """payloads AS (SELECT event_id, CASE event_id % 8
  WHEN 0 THEN '{"type":"config","smart_mode":true,"smart_model":"' || event_type || '"}' WHEN 1 THEN '{"Type":"CONFIG","SMART_MODE":false}'
  WHEN 2 THEN '{"type":"Clear_History"}' WHEN 3 THEN '{"type":"' || event_type || '","x":[1,2]}' WHEN 4 THEN '{bad'
  WHEN 5 THEN '{"type":"config","smart_mode":"yes"}' WHEN 6 THEN 'null'
  ELSE '{"type":"config","smart_mode":null,"smart_model":"","realtimeMode":true}' END AS payload FROM events)"""


@register("parse_control", f"""WITH {_PAYLOADS}, j AS (SELECT event_id, payload, json_valid(payload) AS valid,
    CASE WHEN json_valid(payload) THEN CAST(payload AS JSON) END AS d FROM payloads),
f AS (SELECT event_id, valid, json_type(d) AS root, coalesce(json_extract(d, '$.type'), json_extract(d, '$.Type')) AS t,
    coalesce(json_extract(d, '$.smart_mode'), json_extract(d, '$.SMART_MODE')) AS m, json_extract(d, '$.smart_model') AS n FROM j),
k AS (SELECT *, CASE WHEN root = 'NULL' THEN 'ignored' WHEN NOT valid OR json_type(m) NOT IN ('BOOLEAN', 'NULL') THEN 'malformed'
    WHEN lower(t ->> '$') IN ('config', 'clear_history') THEN lower(t ->> '$') ELSE 'unknown' END AS status FROM f)
SELECT event_id, status, CASE WHEN status <> 'malformed' THEN lower(t ->> '$') END AS type,
  CASE WHEN status = 'config' AND json_type(m) = 'BOOLEAN' THEN CAST(m AS BOOLEAN) END AS smart_mode,
  CASE WHEN status = 'config' THEN nullif(n ->> '$', '') END AS smart_model FROM k""")
def parse_control(spark, sf):
    kind, name = F.col("event_id") % 8, F.col("event_type")
    payload = (
        F.when(kind == 0, F.concat(F.lit('{"type":"config","smart_mode":true,"smart_model":"'), name, F.lit('"}')))
        .when(kind == 1, '{"Type":"CONFIG","SMART_MODE":false}').when(kind == 2, '{"type":"Clear_History"}')
        .when(kind == 3, F.concat(F.lit('{"type":"'), name, F.lit('","x":[1,2]}'))).when(kind == 4, "{bad")
        .when(kind == 5, '{"type":"config","smart_mode":"yes"}').when(kind == 6, "null")
        .otherwise('{"type":"config","smart_mode":null,"smart_model":"","realtimeMode":true}'))
    raw = proxies.table(spark, sf, "events").select("event_id", payload.alias("payload"))
    return text_sources.parse_control(raw).drop("payload")


@register("scan_vocab", """SELECT CAST(p_partkey // 1000 AS VARCHAR) AS vocab_id,
  CAST(row_number() OVER (PARTITION BY p_partkey // 1000 ORDER BY p_partkey) - 1 AS INTEGER) AS token_id, p_name AS piece FROM part""")
def scan_vocab(spark, sf):
    root = new_shared_path(spark, "vocab")
    lines = proxies.table(spark, sf, "part").select(
        audio.div(F.col("p_partkey"), 1000).alias("vocab_id"), "p_partkey", F.col("p_name").alias("value"))
    lines.repartition("vocab_id").sortWithinPartitions("vocab_id", "p_partkey").drop("p_partkey").write.partitionBy("vocab_id").text(root)
    return text_sources.scan_vocab(spark, root)


@register("response_payloads", """WITH r AS (SELECT conv_id, turn, text, 'sound ' || turn AS a, (turn % 10) / 10.0 AS c FROM conversations)
SELECT conv_id, turn, CASE turn % 6
  WHEN 0 THEN CAST(to_json({'type': 'transcript', 'transcript': text}) AS VARCHAR)
  WHEN 1 THEN CAST(to_json({'type': 'response', 'transcript': text, 'response': text, 'audio': base64(encode(a))}) AS VARCHAR)
  WHEN 2 THEN CAST(to_json({'Type': 'partial_transcript', 'Transcript': text, 'Confidence': CAST(c AS DOUBLE), 'IsPartial': true}) AS VARCHAR)
  WHEN 3 THEN CAST(to_json({'Type': 'partial_llm', 'Text': text, 'IsComplete': true}) AS VARCHAR)
  WHEN 4 THEN CAST(to_json({'Type': 'audio_chunk', 'AudioBase64': base64(encode(a)), 'IsFinal': true}) AS VARCHAR)
  ELSE '{"type":"thinking"}' END AS payload FROM r""")
def response_payloads(spark, sf):
    kinds = ["transcript", "response", "partial_transcript", "partial_llm", "audio_chunk", "thinking"]
    turn = F.col("turn")
    rows = proxies.table(spark, sf, "conversations").select(
        "conv_id", "turn", F.element_at(F.array(*map(F.lit, kinds)), (turn % 6 + 1).cast("int")).alias("type"),
        F.col("text").alias("transcript"), F.col("text").alias("response"),
        F.concat(F.lit("sound "), turn.cast("string")).cast("binary").alias("audio"), ((turn % 10) / 10.0).alias("confidence"),
        F.lit(True).alias("is_partial"), F.lit(True).alias("is_complete"), F.lit(True).alias("is_final"))
    return text_sources.response_payloads(rows).select("conv_id", "turn", "payload")


@register("log_payloads", """SELECT event_id AS log_id, '{"timestamp":"' || strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') || '","level":"' ||
  CASE event_type WHEN 'error' THEN 'error' WHEN 'signup' THEN 'warn' ELSE 'info' END || '","message":' ||
  CAST(to_json(event_type || ' ' || props) AS VARCHAR) || '}' AS payload FROM events""")
def log_payloads(spark, sf):
    logs = proxies.logs(spark, sf)
    return text_sources.log_payloads(logs.withColumn("level", F.nullif("level", F.lit("info"))))
