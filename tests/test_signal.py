import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from parlance.functions import audio
from parlance.operators import chunks, signal, spectrum, transcribe


def long(spark, clips):
    return spark.createDataFrame([(c, i, float(v)) for c, vs in clips.items() for i, v in enumerate(vs)], "clip_id string, idx long, amp double")


@pytest.fixture(params=[65_536, 5], ids=["one block", "many blocks"])
def block_size(request, monkeypatch):
    monkeypatch.setattr(signal, "SAMPLES_PER_BLOCK", request.param)
    monkeypatch.setattr(spectrum, "FRAMES_PER_BLOCK", request.param)


def test_quantise(spark):
    df = spark.createDataFrame([(v,) for v in (.5, -.5, .25, 1.5, -1.0)], "amp double")
    assert [r.pcm for r in signal.quantize(df).collect()] == [16383, -16383, 8191, 32767, -32767]


def test_resample(spark, block_size):
    def run(values, src, dst):
        out = signal.resample_linear(long(spark, {"c": values}), src, dst).orderBy("idx").collect()
        assert [r.idx for r in out] == list(range(len(out)))
        return [round(r.amp, 6) for r in out]

    assert run([.1, .2, .3, .4, .5, .6, .7, .8], 32000, 16000) == [.1, .3, .5, .7]
    assert run([.1, .2, .3, .4], 8000, 16000) == [.1, .15, .2, .25, .3, .35, .4, .4]
    assert run([.1, .2], 16000, 16000) == [.1, .2]
    values = [math.sin(i) for i in range(441)]
    want = [values[int(i * 2.75625)] * (1 - (i * 2.75625) % 1) + values[min(int(i * 2.75625) + 1, 440)] * ((i * 2.75625) % 1) for i in range(160)]
    assert run(values, 44100, 16000) == [round(w, 6) for w in want]


def test_downmix(spark, rows):
    df = spark.createDataFrame([("s", 0, 0, .5), ("s", 1, 0, .1), ("m", 0, 0, .7), ("q", 2, 0, .3), ("q", 0, 0, .9), ("q", 1, 0, .1)], "clip_id string, channel int, idx long, amp double")
    assert rows(signal.downmix(df)) == [("m", 0, .7), ("q", 0, .9), ("s", 0, .3)]


def test_voice_activity(spark, block_size):
    clips = {"silence": [0.0] * 1024, "constant": [.05] * 1024, "alternating": [.1, -.1] * 512, "short": [.05] * 100}
    got = {r.clip_id: r for r in signal.voice_activity(long(spark, clips)).collect()}
    assert {k: round(r.score, 6) for k, r in got.items()} == {"silence": 0.0, "constant": .4, "alternating": 1.0, "short": .25}
    assert not got["silence"].is_speech and got["constant"].is_speech
    alone = {r.clip_id: r.frame_energy for r in signal.mean_frame_energy(long(spark, clips)).collect()}
    zcr = {r.clip_id: r.zcr for r in signal.zero_crossing_rate(long(spark, clips)).collect()}
    for k, r in got.items():
        assert alone[k] == pytest.approx(r.frame_energy) and zcr[k] == pytest.approx(r.zcr)


def test_confidence(spark):
    clips = {"tiny": [.5] * 1000, "silent": [0.0] * 16000, "a": [.05] * 4000, "b": [.05] * 16000, "c": [.05] * 96000}
    df = spark.createDataFrame([(k, len(v), v[0]) for k, v in clips.items()], "clip_id string, n int, v double").select(
        "clip_id", F.explode(F.sequence(F.lit(1), "n")).alias("idx"), F.col("v").alias("amp"))
    got = {r.clip_id: round(r.confidence, 6) for r in signal.energy_confidence(df).collect()}
    assert got == {"tiny": .3, "silent": .1, "a": .35, "b": .5, "c": .475}


def test_frames(spark, block_size):
    values = [random.random() for _ in range(57)]
    got = signal.frame_signal(long(spark, {"c": values, "d": [1.0] * 9}), 10, 4).orderBy("frame", "pos").collect()
    want = [(f, p, values[f * 4 + p]) for f in range(12) for p in range(10)]
    assert [(r.frame, r.pos, r.amp) for r in got] == want
    rms = signal.frame_rms(long(spark, {"c": values}), 10, 4).orderBy("frame").collect()
    assert [round(r.rms, 9) for r in rms] == [round(math.sqrt(sum(v * v for v in values[f * 4:f * 4 + 10]) / 10), 9) for f in range(12)]
    arrays = spark.createDataFrame([(values,)], "s array<double>").select(audio.frame_arrays(F.col("s"), 10, 4).alias("f")).first().f
    assert [list(a) for a in arrays] == [values[f * 4:f * 4 + 10] for f in range(12)]


def test_frame_counts_and_gate(spark):
    df = spark.createDataFrame([(n,) for n in (399, 400, 559, 560, 49152, 0)], "n_samples long")
    got = chunks.length_gate(df).collect()
    assert [r.frames for r in got] == [0, 1, 1, 2, 305, 0]
    assert got[4].padded_frames == 312
    sizes = spark.createDataFrame([((f - 1) * 160 + 400,) for f in (4, 5, 6000, 6001)], "n_samples long")
    assert [r.length_class for r in chunks.length_gate(sizes).collect()] == ["too_short", "ok", "ok", "too_long"]


def test_filterbank():
    edges = spectrum.mel_edges()
    assert list(edges[:8]) == [0, 0, 0, 1, 1, 2, 2, 3] and list(edges[-4:]) == [240, 245, 251, 256]
    bank = spectrum.mel_bank()
    assert bank.shape == (128, 257) and int((bank.sum(axis=1) == 0).sum()) == 13


def test_log_mel_forms_agree(spark, block_size):
    rng = np.random.default_rng(3)
    clips = {"c": rng.normal(size=900) * .1, "d": rng.normal(size=399), "e": rng.normal(size=400)}
    packed = signal.pack_chunks(long(spark, clips), frames=2)
    fused = spectrum.spectrum_rows(spectrum.log_mel(packed), "mel", "mel")
    bank = spectrum.mel_bank_table(spark)
    stepwise = spectrum.log_floor(spectrum.mel_project(spectrum.spectrum_rows(spectrum.power_spectrum(packed)), bank))
    a = {(r.clip_id, r.frame, r.mel): r.val for r in fused.collect()}
    b = {(r.clip_id, r.frame, r.mel): r.val for r in stepwise.collect()}
    assert len(a) == (4 + 1) * 128 and a.keys() == b.keys()
    assert all(abs(a[k] - b[k]) < 1e-8 for k in a)
    window = .5 * (1 - np.cos(2 * np.pi * np.arange(400) / 399))
    power = np.abs(np.fft.fft(np.pad(clips["c"][160:560] * window, (0, 112))))[:257] ** 2
    assert a[("c", 1, 60)] == pytest.approx(float(np.log(max(power @ spectrum.mel_bank()[60], 1e-10))))
    normal = spectrum.normalize_per_feature(fused.filter("clip_id != 'd'"))
    got = {(r.clip_id, r.frame, r.mel): r.val for r in normal.collect()}
    column = np.array([a[("c", f, 60)] for f in range(4)])
    assert got[("c", 2, 60)] == pytest.approx((column[2] - column.mean()) / (column.std() + 1e-5))
    assert got[("e", 0, 5)] == 0.0
    padded = spectrum.pad_frames(fused)
    assert padded.count() == (8 + 8) * 128
    tensors = {r.clip_id: r for r in spectrum.to_tensor(padded, "mel_major").collect()}
    assert len(tensors["c"].tensor) == 8 * 128 and tensors["c"].tensor[60 * 8 + 1] == a[("c", 1, 60)]
    flat = {r.clip_id: r.tensor for r in spectrum.to_tensor(padded, "time_major").collect()}
    assert flat["c"][128 + 60] == a[("c", 1, 60)] and flat["c"][5 * 128] == 0.0
    runs = sorted((r.clip_id, r.first_frame, r.n_frames, r.n_mels, len(r.tensor)) for r in spectrum.to_tensor(padded, frames_per_row=5).collect())
    assert runs == [(c, first, 8, 128, n * 128) for c in "ce" for first, n in ((0, 5), (5, 3))]
    parts = sorted((r.first_frame, r.tensor) for r in spectrum.to_tensor(padded, "time_major", 5).collect() if r.clip_id == "c")
    assert parts[0][1] + parts[1][1] == flat["c"]


PLANS = {0: (0, None), 30: (1, (0, 480000)), 50: (1, (0, 800000)), 60: (2, (768000, 960000)), 100: (3, (1536000, 1600000)),
         125: (3, (1536000, 2000000)), 152: (4, (2304000, 2432000)), 600: (13, (9216000, 9600000)), 1800: (38, (28416000, 28800000)), 3600: (75, (56832000, 57600000))}


def test_chunk_plans(spark):
    df = spark.createDataFrame([(s, s * 16000) for s in PLANS], "clip_id long, n_samples long")
    got = {}
    for r in chunks.plan_chunks(df).orderBy("clip_id", "chunk_idx").collect():
        got.setdefault(r.clip_id, []).append((r.start_frame, r.end_frame))
    assert {s: (len(got.get(s, [])), got.get(s, [None])[-1]) for s in PLANS} == PLANS
    for s, parts in got.items():
        assert parts[0][0] == 0 and parts[-1][1] == s * 16000
        assert all(b[0] == a[1] - 32000 for a, b in zip(parts, parts[1:]))
    audit = chunks.audit_chunk_coverage(chunks.plan_chunks(df)).collect()
    assert all(r.gaps == 0 and r.order_errors == 0 and r.starts_at_zero and r.covers_end for r in audit)
    whole = {r.clip_id: r["count"] for r in chunks.model_chunks(df).groupBy("clip_id").count().collect()}
    assert whole[60] == 1 and whole[100] == 3 and 0 not in whole


@pytest.mark.parametrize("size,overlap", [(0, 0), (-1, 0), (10, -1), (10, 10), (10, 11)])
def test_chunk_arguments(spark, size, overlap):
    with pytest.raises(ValueError):
        chunks.plan_chunks(spark.range(1).withColumnRenamed("id", "n_samples"), size, overlap)


def test_stub_and_model(spark):
    df = spark.createDataFrame([(n,) for n in (1600, 7999, 8000, 16000, 49152)], "n_samples long")
    texts = [r.text for r in transcribe.stub_transcribe(df).collect()]
    assert texts == ["", "", transcribe.STUB_REPLIES[0], transcribe.STUB_REPLIES[0], transcribe.STUB_REPLIES[0]]

    def load():
        def model(values):
            if len(values) == 2:
                raise RuntimeError("no speech")
            return f"{len(values)} samples"

        return model

    calls = spark.createDataFrame([(1, [.1]), (2, [.1, .2])], "id int, samples array<float>")
    assert [(r.text, r.failed) for r in transcribe.transcribe(calls, load).orderBy("id").collect()] == [
        ("1 samples", False), ("[Transcription error: no speech]", True)]
    assert calls.columns == ["id", "samples"]
