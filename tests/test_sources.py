import datetime as dt
import json
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from parlance.functions import audio
from parlance.plans import flows
from parlance.sources import recordings as rec
from parlance.sources import sessions, text_sources


def wav(data, rate=16000, channels=1, bits=16, fmt=1, extra=b""):
    block = channels * bits // 8
    head = b"WAVEfmt " + struct.pack("<ihhiihh", 16, fmt, channels, rate, rate * block, block, bits) + extra + b"data" + struct.pack("<i", len(data))
    return b"RIFF" + struct.pack("<i", 4 + len(head) + len(data)) + head + data


def clips(spark, contents):
    return spark.createDataFrame([(k, bytearray(v)) for k, v in contents.items()], "clip_id string, content binary")


def decoded(spark, contents, **plan):
    out = {}
    for r in rec.decode_pcm(rec.wav_header(clips(spark, contents)), **plan).orderBy("clip_id", "chunk_idx").collect():
        out.setdefault(r.clip_id, []).append((r.start_frame, r.end_frame, list(r.samples)))
    return out


def test_bad_files_have_reasons_and_no_samples(spark):
    good = wav(b"\1\0\2\0")
    contents = {
        "tiny": bytes(4), "empty": b"", "riff": b"RIFX" + good[4:], "wave": good[:8] + b"WAVX" + good[12:],
        "nodata": good[:36] + b"junk" + good[40:], "bits": wav(b"\1\0", bits=4), "size": good[:16] + struct.pack("<i", -8) + good[20:],
        "good": good, "float": wav(b"\1\0", fmt=3), "odd": wav(b"\1\0\2\0", extra=b"LIST" + struct.pack("<i", 3) + b"abc\0"),
        "clamped": good[:40] + struct.pack("<i", 99) + good[44:]}
    got = {r.clip_id: r for r in rec.wav_header(clips(spark, contents)).collect()}
    assert {k: r.reject_reason for k, r in got.items()} == {
        "tiny": "too_short", "empty": "too_short", "riff": "no_riff", "wave": "no_wave", "nodata": "no_data", "bits": "bad_format",
        "size": "bad_chunk_size", "good": None, "float": None, "odd": None, "clamped": None}
    assert got["float"].warning == "unsupported_format" and got["good"].warning is None
    assert (got["odd"].data_offset, got["odd"].data_len, got["clamped"].data_len) == (56, 4, 4)
    assert set(decoded(spark, contents)) == {"good", "float", "odd", "clamped"}


def test_depths_and_channels(spark):
    pcm = np.array([16384, -16384, 8192, -32768], dtype="<i2")
    contents = {
        "16": wav(pcm.tobytes()), "8": wav(bytes([128, 0, 255]), bits=8), "24": wav(b"\0\0\x40\0\0\xc0", bits=24),
        "32": wav(np.array([2 ** 30, -2 ** 31], dtype="<i4").tobytes(), bits=32), "stereo": wav(pcm.tobytes(), channels=2),
        "three": wav(np.array([100, 1, 1, 200, 1, 1], dtype="<i2").tobytes(), channels=3), "12": wav(b"\1\2", bits=12)}
    got = {k: v[0][2] for k, v in decoded(spark, contents).items()}
    assert got["16"] == [.5, -.5, .25, -1.0] and got["8"] == [0.0, -1.0, 127 / 128] and got["24"] == [.5, -.5]
    assert got["32"] == [.5, -1.0] and got["stereo"] == [0.0, -.375] and got["12"] == [0.0, 0.0]
    assert got["three"] == pytest.approx([100 / 32768, 200 / 32768])


def test_round_trip(spark):
    df = spark.createDataFrame([("c", [.5, -.5, .25, -.25])], "clip_id string, samples array<double>")
    header = rec.wav_header(rec.encode_wav(df))
    values = rec.decode_pcm(header).first().samples
    assert values == pytest.approx([.5, -.5, .25, -.25], abs=1e-3)
    assert header.first().data_len == 8


@pytest.mark.parametrize("rate", [16000, 44100, 8000])
def test_chunks_are_slices_of_the_whole(spark, rate):
    pcm = (np.random.default_rng(1).normal(size=5000) * 9000).astype("<i2")
    content = {"c": wav(pcm.tobytes(), rate=rate)}
    whole = decoded(spark, content, chunk_s=50, overlap_s=2)["c"]
    parts = decoded(spark, content, chunk_s=.03, overlap_s=.01)["c"]
    assert len(whole) == 1 and len(parts) > 3
    assert len(whole[0][2]) == int(5000 / (rate / 16000)) == parts[-1][1]
    for start, end, values in parts:
        assert values == whole[0][2][start:end]


def test_fixed_offset_duration(spark):
    contents = {"a": wav(bytes(98304)), "short": b"RIFF"}
    got = {r.clip_id: r.header_duration for r in rec.fixed_offset_duration(clips(spark, contents)).collect()}
    assert got == {"a": 3.072, "short": 0.0}


def test_export_scan_and_transcribe(spark, tmp_path, rows):
    df = spark.createDataFrame([("s1", 1, "user", [.5] * 900), ("s1", 2, "assistant", [.25] * 30), ("s2", 12, "user", [0.0] * 1300)],
                               "session_id string, turn_number int, role string, samples array<double>")
    root = f"file://{tmp_path}/rec"
    rec.export_wav(rec.encode_wav(df), root)
    scanned = rec.scan_recordings(spark, root)
    assert rows(scanned, "session_id", "turn_number", "role", "length") == [("s1", 1, "user", 1844), ("s1", 2, "assistant", 104), ("s2", 12, "user", 2644)]
    assert (tmp_path / "rec/s1/turn_001_user.wav").exists() and not list(tmp_path.rglob("*.part"))
    pruned = scanned.select("path", "length")._jdf.queryExecution().executedPlan().toString()
    assert "content" not in pruned

    def load():
        return lambda samples: f"got {len(samples)} of {samples[0]:.1f}"

    out = flows.scan_and_transcribe(spark, root, load, chunk_s=.0625, overlap_s=0, whole_up_to=0, fraction=.1)
    assert rows(out, "session_id", "turn_number", "reject_reason", "chunks", "text") == [
        ("s1", 1, None, 1, "[Audio too short for transcription]"), ("s1", 2, None, 1, ""),
        ("s2", 12, None, 2, "[Audio too short for transcription] [Audio too short for transcription]")]
    long = flows.transcribe_recordings(scanned.filter("length > 2000"), load)
    assert rows(long, "text") == [("got 1300 of 0.0",)]


def test_every_recording_keeps_a_row(spark, rows):
    df = spark.createDataFrame([("s", 1, [.5] * 900), ("s", 2, [.5] * 300), ("s", 3, [.5] * 40), ("s", 4, []), ("s", 5, [.5] * 40)],
                               "session_id string, turn_number int, samples array<double>")
    files = rec.encode_wav(df)
    content, rest = F.col("content"), F.length("content")
    files = files.withColumn("content", F.when(F.col("turn_number") == 3, F.concat(F.substring(content, 1, 24), F.lit(bytearray(4)), F.substring(content, F.lit(29), rest)))
                             .when(F.col("turn_number") == 5, F.lit(bytearray(b"RIFF"))).otherwise(content))

    def load():
        def model(samples):
            raise RuntimeError("out of order")

        return model

    out = flows.transcribe_recordings(files, load, chunk_s=.025, overlap_s=0, whole_up_to=0, gate=False)
    marker = "[Error processing chunk]"
    out = out.withColumn("text", F.when(F.col("text").startswith(marker), marker).otherwise(F.col("text")))
    assert rows(out, "turn_number", "reject_reason", "chunks", "text") == [
        (1, None, 3, marker), (2, None, 1, "[Transcription error: out of order]"), (3, "bad_format", 0, ""), (4, "no_data", 0, ""), (5, "too_short", 0, "")]
    dealt = rec.decode_pcm(rec.wav_header(files.select("session_id", "turn_number", "content")), spread=True)
    assert "REPARTITION" in dealt._jdf.queryExecution().executedPlan().toString().upper()


def test_malformed_session_documents(spark, tmp_path, rows):
    (tmp_path / "a.json").write_text('{"sessionId": "a", "turns": [{"turnNumber": 1}]}\n{"sessionId": "b", "turns": [\n{"turns": []}\nnot json\n')
    docs = sessions.scan_sessions(spark, str(tmp_path))
    assert rows(docs, "session_id", "reject_reason") == [("a", None), (None, "malformed"), (None, "malformed"), (None, "no_session_id")]
    assert rows(sessions.explode_turns(docs), "session_id", "turn_number") == [("a", 1)]


def test_ratios_of_nothing(spark, rows):
    from parlance.functions import audio
    from parlance.operators import conversations

    calls = spark.createDataFrame([("a", 0.0, 0.0), ("b", 2.0, 1.0)], "kind string, audio_s double, wall_s double")
    assert rows(conversations.latency_report(calls, ["kind"]), "kind", "real_time_factor", "throughput") == [("a", None, None), ("b", 0.5, 2.0)]
    arrays = spark.createDataFrame([([],), ([2.0, 0.0],)], "s array<double>")
    assert rows(arrays.select(audio.mean_square_array(F.col("s")))) == [(2.0,), (None,)]


def test_session_documents(spark, tmp_path, rows):
    start = dt.datetime(2026, 2, 17, 14, 30)
    turns = spark.createDataFrame([("a", n, start + dt.timedelta(seconds=n), f"q{n}", f"r{n}", 1.5) for n in (3, 1, 2)] + [("b", 1, start, "x", "y", None)],
                                  "session_id string, turn_number int, ts timestamp, user_transcript string, assistant_response string, user_audio_duration double")
    path = f"{tmp_path}/docs"
    sessions.write_sessions(turns, path, turns_per_document=2)
    docs = [json.loads(line) for f in (tmp_path / "docs").glob("*.json") for line in f.read_text().splitlines()]
    assert sorted((d["sessionId"], [t["turnNumber"] for t in d["turns"]]) for d in docs) == [("a", [1, 2]), ("a", [3]), ("b", [1])]
    back = sessions.explode_turns(sessions.scan_sessions(spark, path))
    same = back.select(*turns.columns)
    assert same.count() == 4 and same.exceptAll(turns).count() == 0
    indented = tmp_path / "one"
    indented.mkdir()
    (indented / "session_metadata.json").write_text(json.dumps(
        {"sessionId": "z", "startTime": "2026-02-17T14:30:00Z", "endTime": None, "turns": [], "configuration": {"smartMode": True, "smartModel": "m", "realtimeMode": False}}, indent=2))
    doc = sessions.scan_sessions(spark, str(indented), one_per_line=False).first()
    assert doc.session_id == "z" and doc.end_time is None and doc.configuration.smart_mode and doc.turns == []
    assert sessions.explode_turns(sessions.scan_sessions(spark, str(indented), one_per_line=False)).first().turn_number is None


def test_log_lines(spark, rows, tmp_path):
    folder = tmp_path / "logs" / "s1"
    folder.mkdir(parents=True)
    (folder / "session.log").write_text("2026-02-17T14:30:00.0000000+00:00 [info] Voice connection established\nnoise\nwhen [warn] x\n")
    got = text_sources.scan_session_logs(spark, str(tmp_path / "logs"))
    assert rows(got.select("session_id", F.unix_seconds("ts").alias("s"), "level", "message", "reject_reason")) == sorted([
        ("s1", 1771338600, "info", "Voice connection established", None), ("s1", None, None, None, "no_match"),
        ("s1", None, "warn", "x", "bad_timestamp")], key=repr)


def test_control(spark):
    payloads = ['{"type":"config","smart_mode":true,"smart_model":"m1"}', '{"type":"CLEAR_HISTORY"}', '{"type":"other"}', "{bad", "[1]", '"text"', "null", None,
                '{"SMART_MODE":false,"Type":"Config"}', '{"type":"config","smart_mode":1}', '{"type":7}', '{"type":null}', "{}"]
    df = spark.createDataFrame([(i, p) for i, p in enumerate(payloads)], "id int, payload string")
    got = [(r.status, r.smart_mode, r.smart_model) for r in text_sources.parse_control(df).orderBy("id").collect()]
    assert got == [("config", True, "m1"), ("clear_history", None, None), ("unknown", None, None), ("malformed", None, None), ("malformed", None, None),
                   ("malformed", None, None), ("ignored", None, None), ("ignored", None, None), ("config", False, None), ("malformed", None, None),
                   ("malformed", None, None), ("unknown", None, None), ("unknown", None, None)]


def test_vocab(spark, tmp_path, rows):
    (tmp_path / "v1").mkdir()
    (tmp_path / "v1" / "vocab.txt").write_text("<unk>\n▁the\n\ns\n", encoding="utf-8")
    assert rows(text_sources.scan_vocab(spark, str(tmp_path))) == [("v1", 0, "<unk>"), ("v1", 1, "▁the"), ("v1", 2, ""), ("v1", 3, "s")]


def test_payloads(spark):
    df = spark.createDataFrame([("audio_chunk", None, None, bytearray(b"ab"), None, None, None, True), ("partial_transcript", "hi", None, None, .5, True, None, None),
                                ("response", "q", "r", bytearray(b"x"), None, None, None, None), ("thinking", None, None, None, None, None, None, None)],
                               "type string, transcript string, response string, audio binary, confidence double, is_partial boolean, is_complete boolean, is_final boolean")
    got = [json.loads(r.payload) for r in text_sources.response_payloads(df).collect()]
    assert got == [{"Type": "audio_chunk", "AudioBase64": "YWI=", "IsFinal": True}, {"Type": "partial_transcript", "Transcript": "hi", "Confidence": .5, "IsPartial": True},
                   {"type": "response", "transcript": "q", "response": "r", "audio": "eA=="}, {"type": "thinking"}]


def test_exact_duration(spark):
    df = spark.createDataFrame([(96000, 16000, 2, 24)], "n long, r int, c int, b int")
    assert df.select(audio.exact_duration(F.col("n"), F.col("r"), F.col("c"), F.col("b"))).first()[0] == 1.0
