"""Power spectra, mel projection, normalisation, padding and model tensors.

Only the FFT needs Python: numpy over Arrow batches of bounded sample rows (``signal.pack_chunks`` or decoded
chunks). Everything after it has a long form made of joins and aggregations; ``log_mel`` is the fused batch form.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parlance.functions import audio
from parlance.ordered import BLOCK, sequence_block

FRAMES_PER_BLOCK = 4_096


def hann(length: int) -> np.ndarray:
    """Symmetric form, denominator ``length - 1``."""
    return 0.5 * (1.0 - np.cos(2.0 * np.pi * np.arange(length) / (length - 1)))


def mel_edges(n_fft: int = audio.N_FFT, rate: int = audio.SAMPLE_RATE, n_mels: int = audio.N_MELS,
              f_min: float = audio.F_MIN, f_max: float = audio.F_MAX) -> np.ndarray:
    """FFT bins of the n_mels + 2 equally spaced mel points."""
    low, high = (2595.0 * np.log10(1.0 + f / 700.0) for f in (f_min, f_max))
    mels = low + np.arange(n_mels + 2) * (high - low) / (n_mels + 1)
    hz = 700.0 * (10.0 ** (mels / 2595.0) - 1.0)
    return np.floor((n_fft + 1) * hz / rate).astype(int)


def mel_bank(n_fft: int = audio.N_FFT, rate: int = audio.SAMPLE_RATE, n_mels: int = audio.N_MELS,
             f_min: float = audio.F_MIN, f_max: float = audio.F_MAX) -> np.ndarray:
    """Un-normalised triangles ``[n_mels, n_fft/2+1]``: 0 at the outer edges, 1 at the centre. Narrow low filters
    may hold no bin at all."""
    edges = mel_edges(n_fft, rate, n_mels, f_min, f_max)
    bins = np.arange(n_fft // 2 + 1)
    left, centre, right = (edges[i:i + n_mels, None] for i in range(3))
    up = (bins - left) / np.maximum(centre - left, 1)
    down = (right - bins) / np.maximum(right - centre, 1)
    return np.where((bins >= left) & (bins < centre), up, 0.0) + np.where((bins >= centre) & (bins < right), down, 0.0)


def mel_bank_table(spark: SparkSession, **config) -> DataFrame:
    """The non-zero weights as ``(mel, bin, weight)``; its size is set by the configuration, not by data."""
    bank = mel_bank(**config)
    mel, bins = np.nonzero(bank)
    return spark.createDataFrame(
        pd.DataFrame({"mel": mel.astype("int32"), "bin": bins.astype("int32"), "weight": bank[mel, bins]}),
        "mel int, bin int, weight double",
    )


def _frames(samples: np.ndarray, win: int, hop: int) -> np.ndarray:
    if len(samples) < win:
        return np.empty((0, win))
    return np.lib.stride_tricks.sliding_window_view(samples, win)[::hop]


def _power(samples: np.ndarray, window: np.ndarray, hop: int, n_fft: int) -> np.ndarray:
    spectrum = np.fft.rfft(_frames(samples, len(window), hop) * window, n=n_fft, axis=1)
    return spectrum.real ** 2 + spectrum.imag ** 2


def _per_frame(chunks: DataFrame, compute, column: str) -> DataFrame:
    """Run ``compute(samples) -> [frames, values]`` over chunk rows; one output row per frame.

    Arrow in and out: sample arrays are views of the batch, results leave as one list column per batch.
    """
    key_type = dict(chunks.dtypes)["clip_id"]

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            clips, firsts, lists = (part.column(c) for c in ("clip_id", "first_frame", "samples"))
            ends, values = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
            results = [compute(np.asarray(values[a:b], dtype=np.float64)) for a, b in zip(ends[:-1], ends[1:])]
            counts = np.array([len(r) for r in results], dtype=np.int64)
            if not counts.sum():
                continue
            rows = np.repeat(np.arange(len(counts)), counts)
            within = np.arange(len(rows)) - np.repeat(np.cumsum(counts) - counts, counts)
            flat = np.concatenate([r for r in results if len(r)])
            offsets = pa.array(np.arange(len(flat) + 1) * flat.shape[1], pa.int32())
            yield pa.RecordBatch.from_arrays(
                [clips.take(pa.array(rows)), pa.array(firsts.to_numpy()[rows] + within, pa.int64()),
                 pa.ListArray.from_arrays(offsets, pa.array(flat.ravel()))],
                names=["clip_id", "frame", column])

    return chunks.select("clip_id", F.col("first_frame").cast("long").alias("first_frame"), "samples").mapInArrow(
        batches, f"clip_id {key_type}, frame long, {column} array<double>"
    )


def power_spectrum(chunks: DataFrame, n_fft: int = audio.N_FFT, win: int = audio.WINDOW,
                   hop: int = audio.HOP) -> DataFrame:
    """``(clip_id, first_frame, samples)`` -> ``(clip_id, frame, power ARRAY)``: windowed, zero-padded FFT."""
    window = hann(win)
    return _per_frame(chunks, lambda x: _power(x, window, hop, n_fft), "power")


def log_mel(chunks: DataFrame, n_fft: int = audio.N_FFT, win: int = audio.WINDOW, hop: int = audio.HOP,
            rate: int = audio.SAMPLE_RATE, n_mels: int = audio.N_MELS, f_min: float = audio.F_MIN,
            f_max: float = audio.F_MAX) -> DataFrame:
    """Fused spectrum, filterbank and log per chunk row: ``(clip_id, frame, mel ARRAY)``."""
    window, bank = hann(win), mel_bank(n_fft, rate, n_mels, f_min, f_max).T

    def compute(samples):
        return np.log(np.maximum(_power(samples, window, hop, n_fft) @ bank, audio.LOG_FLOOR))

    return _per_frame(chunks, compute, "mel")


def spectrum_rows(power: DataFrame, column: str = "power", name: str = "bin") -> DataFrame:
    return power.select("clip_id", "frame", F.posexplode(column).alias(name, "val"))


def mel_project(power: DataFrame, bank: DataFrame, n_mels: int = audio.N_MELS) -> DataFrame:
    """Long form: ``(clip_id, frame, bin, val)`` x ``(mel, bin, weight)`` -> ``(clip_id, frame, mel, val)``.

    The bank is a table of the configuration (a few hundred rows), so it is broadcast. A filter without any bin
    yields 0 for every frame: each frame emits one zero per filter, which also makes the sum total.
    """
    projected = power.join(F.broadcast(bank), "bin").select(
        "clip_id", "frame", "mel", (F.col("val") * F.col("weight")).alias("val")
    )
    zeros = power.filter(F.col("bin") == 0).select(
        "clip_id", "frame", F.explode(F.sequence(F.lit(0), F.lit(n_mels - 1))).alias("mel"), F.lit(0.0).alias("val")
    )
    return projected.unionByName(zeros).groupBy("clip_id", "frame", "mel").agg(F.sum("val").alias("val"))


def log_floor(features: DataFrame, eps: float = audio.LOG_FLOOR) -> DataFrame:
    return features.withColumn("val", audio.log_floor(F.col("val"), eps))


def normalize_per_feature(features: DataFrame, per_block: int = FRAMES_PER_BLOCK) -> DataFrame:
    """Zero mean and unit deviation per ``(clip, mel)`` over time; population deviation plus 1e-5.

    Count, mean and squared deviations are aggregated map-side per ``(clip, mel, run of frames)`` and combined over the
    runs of a feature, so a long clip is never gathered and nothing is lost to sums of large squares.
    """
    unit = ["clip_id", "mel", BLOCK]
    rows = features.withColumn(BLOCK, sequence_block("frame", per_block))
    runs = rows.groupBy(*unit).agg(
        F.count(F.lit(1)).alias("__k"), F.avg("val").alias("__m"), (F.var_pop("val") * F.count(F.lit(1))).alias("__sq"))
    whole = Window.partitionBy("clip_id", "mel")
    mean = runs.withColumns({
        "__n": F.sum("__k").over(whole), "__mean": F.sum(F.col("__k") * F.col("__m")).over(whole) / F.sum("__k").over(whole)})
    shift = F.col("__m") - F.col("__mean")
    spread = F.sum(F.col("__sq") + F.col("__k") * shift * shift).over(whole)
    stats = mean.select(*unit, "__mean", (F.sqrt(spread / F.col("__n")) + F.lit(audio.STD_FLOOR)).alias("__std"))
    return rows.join(stats, unit).select(
        "clip_id", "frame", "mel", ((F.col("val") - F.col("__mean")) / F.col("__std")).alias("val"))


def pad_frames(features: DataFrame, multiple: int = audio.PAD_MULTIPLE, value: float = 0.0) -> DataFrame:
    """Add rows up to the next multiple of frames: at most ``multiple - 1`` frames per clip."""
    ends = features.groupBy("clip_id").agg((F.max("frame") + 1).cast("long").alias("n"), F.max("mel").alias("top"))
    padded = audio.padded_frames(F.col("n"), multiple)
    rows = ends.filter(padded > F.col("n")).select(
        "clip_id", "top", F.explode(F.sequence(F.col("n"), padded - 1)).alias("frame")
    ).select("clip_id", "frame", F.explode(F.sequence(F.lit(0).cast(dict(features.dtypes)["mel"]), F.col("top"))).alias("mel"),
             F.lit(float(value)).alias("val"))
    return features.select("clip_id", "frame", "mel", "val").unionByName(rows)


def to_tensor(features: DataFrame, layout: str = "mel_major", frames_per_row: int = audio.MAX_FRAMES) -> DataFrame:
    """Flat arrays for a model call: ``clip_id, n_frames, n_mels, first_frame, tensor``.

    A row holds a run of ``frames_per_row`` frames, from ``first_frame`` on, so no row grows with the clip; up to that
    length a clip is one row. ``time_major`` orders a run by (frame, mel), so the runs of a clip follow each other;
    ``mel_major`` orders it by (mel, frame). Whether a model takes a clip of that length is the gate's business.
    """
    if layout not in ("mel_major", "time_major"):
        raise ValueError(f"unknown layout: {layout}")
    order = ["mel", "frame"] if layout == "mel_major" else ["frame", "mel"]
    first = (F.col("frame") - F.pmod(F.col("frame"), F.lit(frames_per_row))).cast("long")
    values = F.sort_array(F.collect_list(F.struct(*order, "val")))
    runs = features.groupBy("clip_id", first.alias("first_frame")).agg(
        (F.max("frame") + 1).cast("long").alias("upto"), (F.max("mel") + 1).cast("int").alias("mels"),
        F.transform(values, lambda v: v["val"]).alias("tensor"))
    # One row per run: a clip's size comes from its runs.
    whole = Window.partitionBy("clip_id")
    return runs.select("clip_id", F.max("upto").over(whole).alias("n_frames"), F.max("mels").over(whole).alias("n_mels"), "first_frame", "tensor")
