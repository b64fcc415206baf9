import struct

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_sources import wav

from parlance.functions import audio
from parlance.operators import transcribe
from parlance.plans import flows
from parlance.sources import ranges
from parlance.sources import recordings as rec

COLUMNS = ["name", "reject_reason", "data_offset", "data_len", "chunk_idx", "start_frame", "end_frame", "clip_frames", "samples"]


def named(df):
    return df.withColumn("name", F.regexp_extract("path", r"[^/]+$", 0)).select(*COLUMNS)


def same(spark, folder, **options):
    """Rows of the byte-range source and of whole files, in order."""
    got = named(ranges.read_chunks(spark, str(folder), **options))
    options.pop("split_bytes", None)
    files = rec.wav_header(rec.scan_recordings(spark, str(folder)))
    # decode_pcm leaves the header's columns out; they come back by path.
    whole = rec.decode_pcm(files, **options).join(files.select("path", "reject_reason", "data_offset", "data_len"), "path")
    order = ["name", "chunk_idx"]
    return [r.asDict() for r in got.orderBy(*order).collect()], [r.asDict() for r in named(whole).orderBy(*order).collect()]


@pytest.mark.parametrize("split", [150, 1_000, 10**9])
def test_pieces_of_any_size_give_the_same_chunks(spark, tmp_path, split):
    rng = np.random.default_rng(2)
    pcm = (rng.normal(size=4_000) * 9_000).astype("<i2").tobytes()
    good = wav(pcm[:400])
    contents = {
        "a": wav(pcm), "rate": wav(pcm, rate=44_100), "slow": wav(pcm[:1_999], rate=8_000), "stereo": wav(pcm, channels=2), "24": wav(pcm[:3_000], bits=24),
        "8": wav(pcm[:1_000], bits=8), "12": wav(pcm[:64], bits=12), "odd": wav(pcm, extra=b"LIST" + struct.pack("<i", 3) + b"abc\0"), "empty": b"", "none": wav(b""), "tiny": b"RIFF",
        "riff": b"RIFX" + good[4:], "nodata": good[:36] + b"junk" + good[40:], "size": good[:16] + struct.pack("<i", -8) + good[20:], "bits": wav(b"\1\0", bits=4),
        "clamped": good[:40] + struct.pack("<i", 9_999) + good[44:], "rf64": b"RF64" + good[4:]}
    (tmp_path / "s1").mkdir()
    for name, data in contents.items():
        (tmp_path / "s1" / f"{name}.wav").write_bytes(data)
    for options in ({}, {"keep_rejected": True, "whole_up_to": 300}):
        got, want = same(spark, tmp_path, chunk_s=.01, overlap_s=.002, split_bytes=split, **options)
        # Files without a byte are left out by Spark's own reader; here they are rejected.
        empty = [r for r in got if r["name"] == "empty.wav"]
        assert [r["reject_reason"] for r in empty] == ["too_short"] * options.get("keep_rejected", False)
        assert [r for r in got if r not in empty] == want and len({r["name"] for r in got}) >= 9


def test_paths_plan_and_arguments(spark, tmp_path):
    folder = tmp_path / "s9"
    folder.mkdir()
    (folder / "turn_007_user.wav").write_bytes(wav(bytes(3_200)))
    (folder / "notes.txt").write_text("x")
    df = ranges.read_chunks(spark, f"file://{tmp_path}", chunk_s=.05, overlap_s=0, split_bytes=500)
    rows = df.orderBy("chunk_idx").collect()
    assert [(r.session_id, r.turn_number, r.role, r.length, r.start_frame, r.end_frame) for r in rows] == [("s9", 7, "user", 3_244, 0, 800), ("s9", 7, "user", 3_244, 800, 1_600)]
    assert df.rdd.getNumPartitions() == 7
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan and "Exchange" not in plan
    one = ranges.read_chunks(spark, str(folder / "turn_007_user.wav"))
    assert [len(r.samples) for r in one.collect()] == [1_600]
    (tmp_path / "none").mkdir()
    assert ranges.read_chunks(spark, str(tmp_path / "none")).count() == 0
    with pytest.raises(Exception, match="overlap"):
        ranges.read_chunks(spark, str(tmp_path), chunk_s=1, overlap_s=1).count()


@pytest.mark.parametrize("form", ["unsigned", "rf64"])
def test_recording_of_more_than_two_gigabytes(spark, tmp_path, form):
    """A sparse file of 2.2 GB: 32-bit stereo at 192 kHz, silent but for its last second; decoded in pieces by many tasks."""
    size = 2_200_000_000 // 8 * 8
    ds64 = b"ds64" + struct.pack("<iqqqi", 28, size + 72, size, size // 8, 0) if form == "rf64" else b""
    head = b"WAVE" + ds64 + b"fmt " + struct.pack("<ihhiihh", 16, 1, 2, 192_000, 192_000 * 8, 8, 32) + b"data" + struct.pack("<I", 0xFFFFFFFF if ds64 else size)
    last = np.full((192_000, 2), 1 << 30, "<i4").tobytes()
    path = tmp_path / "long.wav"
    with path.open("wb") as out:
        out.write((b"RF64" if ds64 else b"RIFF") + struct.pack("<I", 0xFFFFFFFF) + head)
        start = out.tell()
        out.seek(start + size - len(last))
        out.write(last)
    chunks = ranges.read_chunks(spark, str(path), chunk_s=60, overlap_s=1, split_bytes=256 << 20)
    assert chunks.rdd.getNumPartitions() == 9
    told = chunks.select("chunk_idx", "start_frame", "end_frame", "clip_frames", "data_len", F.size("samples").alias("n"), F.element_at("samples", 1).alias("first"), F.element_at("samples", -1).alias("last"))
    rows = told.orderBy("chunk_idx").collect()
    n = int(size // 8 / 12)
    assert rows[0].clip_frames == n and rows[0].data_len == size
    assert [r.start_frame for r in rows] == list(range(0, n - 16_000, 59 * 16_000))
    assert all(r.n == r.end_frame - r.start_frame for r in rows) and rows[-1].end_frame == n
    assert {r["first"] for r in rows} == {0.0} and rows[-1]["last"] == 0.5


def test_transcription_by_byte_range_equals_that_of_whole_files(spark, tmp_path, rows):
    rng = np.random.default_rng(5)
    for k, n in enumerate((900, 5_000, 30, 0)):
        folder = tmp_path / f"s{k}"
        folder.mkdir()
        (folder / "turn_001_user.wav").write_bytes(wav((rng.normal(size=n) * 5_000).astype("<i2").tobytes()))

    def load():
        return lambda values: (" ".join(f"w{int(v * 100)}" for v in values[::50]), 0.5 + len(values) / 10_000)

    options = dict(chunk_s=.0625, overlap_s=.0125, whole_up_to=0, gate=False)
    got = flows.scan_and_transcribe(spark, str(tmp_path), load, split_bytes=1_000, **options)
    want = flows.transcribe_recordings(rec.scan_recordings(spark, str(tmp_path)), load, **options)
    columns = ["session_id", "turn_number", "reject_reason", "chunks", "text", F.round("confidence", 9)]
    assert rows(got, *columns) == rows(want, *columns)
    sure = {r.session_id: r.confidence for r in got.collect()}
    assert sure["s0"] == pytest.approx(0.59) and sure["s3"] is None


def counting():
    """A class made here travels to the workers by value."""
    class Counting:
        """Says what it was called with; refuses batches with a chunk of ones."""

        def __init__(self):
            self.calls = []

        def __call__(self, values):
            self.calls.append(("one", len(values)))
            if len(values) and values[0] == 1:
                raise ValueError("ones")
            return f"{len(values)}", 0.75

        def batch(self, padded, lengths):
            self.calls.append(("batch", padded.shape))
            if (padded[:, 0] == 1).any():
                raise RuntimeError("batch")
            assert all((row[n:] == 0).all() for row, n in zip(padded, lengths))
            return [(f"{n}", 0.75) for n in lengths]

    return Counting


def test_number_of_model_calls():
    model = counting()()
    scorer = transcribe._Scorer(model, 1_000, audio.SAMPLE_RATE)
    chunks = [np.full(n, 0.5, np.float32) for n in (100, 90, 10, 95, 80, 5, 700, 1_500, 85, 99)]
    assert [a[0] for a in scorer.many(chunks)] == [str(len(c)) for c in chunks]
    assert model.calls == [("batch", (1, 1_500)), ("batch", (1, 700)), ("batch", (8, 100))]
    model.calls.clear()
    bad = chunks[:3] + [np.ones(4, np.float32)]
    assert scorer.many(bad)[3] == ("[Transcription error: ones]", True, 0.0)
    assert [c[0] for c in model.calls] == ["batch", "one", "one", "one", "one"]
    assert scorer.many([]) == []
    short = counting()()
    short.batch = lambda padded, lengths: ["x"]
    assert [a[0] for a in transcribe._Scorer(short, 1_000, 16_000).many(chunks[:2])] == ["100", "90"]


def test_batches_in_the_job_and_the_gate(spark, rows):
    data = [(i, [0.25] * n) for i, n in enumerate([0, 300, 900, 1_040, 2_000, 1_000, 1_999])]
    df = spark.createDataFrame(data, "id int, samples array<float>")
    got = rows(transcribe.transcribe(df, flows.gated(counting()), batch_samples=5_000), "id", "text", "failed", "confidence")
    small = "[Audio too short for transcription]"
    assert got == [(0, "", False, 0.3), (1, "", False, 0.3), (2, small, False, 0.3), (3, "1040", False, 0.75), (4, "2000", False, 0.75),
                   (5, small, False, 0.3), (6, "1999", False, 0.75)]


@pytest.mark.parametrize("n,level", [(10, .5), (1_600, .02), (8_000, .05), (90_000, .09), (90_000, .5)])
def test_energy_confidence_in_a_task(spark, n, level):
    want = spark.range(1).select(audio.energy_confidence(F.lit(n), F.lit(level * level))).first()[0]
    assert transcribe.energy_confidence(np.full(n, level, np.float64)) == pytest.approx(want, abs=1e-9)


def test_very_many_small_pieces_share_tasks(tmp_path):
    for i in range(30):
        (tmp_path / f"{i:02d}.wav").write_bytes(bytes(1_000 * (i + 1)))
    reader = ranges.ChunkReader({"path": str(tmp_path), "split_bytes": "20"})
    tasks = reader.partitions()
    assert len(tasks) <= 1.1 * ranges.TASKS
    # Every byte is in one piece, and a file's pieces in one task are one.
    pieces = sorted(p for t in tasks for p in t.pieces)
    for path in {p[0] for p in pieces}:
        own = [p for p in pieces if p[0] == path]
        assert [p[2] for p in own] == [0, *(p[3] for p in own[:-1])] and own[-1][3] == own[0][1]
    assert all(len({p[0] for p in t.pieces}) == len(t.pieces) for t in tasks)
