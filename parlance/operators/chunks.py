"""Chunk plans (from lengths only, no audio is read), their audit, and the length gate."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.functions import audio
from parlance.ordered import sequence_block, with_previous

CHUNKS_PER_BLOCK = 4_096


def chunk_frames(chunk_s: float, overlap_s: float, rate: int) -> tuple[int, int]:
    """Chunk and overlap length in samples, with the single-precision product of seconds and rate."""
    if chunk_s <= 0:
        raise ValueError("chunk size must be positive")
    if overlap_s < 0 or overlap_s >= chunk_s:
        raise ValueError("overlap must be at least 0 and below the chunk size")
    return int(np.float32(rate) * np.float32(chunk_s)), int(np.float32(rate) * np.float32(overlap_s))


def plan_chunks(df: DataFrame, chunk_s: float = audio.CHUNK_SECONDS, overlap_s: float = audio.OVERLAP_SECONDS,
                rate: int = audio.SAMPLE_RATE, length: str = "n_samples") -> DataFrame:
    """Explode clips into overlapping half-open ranges ``[start_frame, end_frame)``; none for empty clips.

    Every input column but ``length`` is kept. Map-side: no shuffle whatever the clip length.
    """
    size, overlap = chunk_frames(chunk_s, overlap_s, rate)
    stride = size - overlap
    n = F.col(length).cast("long")
    count = F.when(n <= size, F.lit(1).cast("long")).otherwise(audio.div(n - size + (stride - 1), stride) + 1)
    rest = [c for c in df.columns if c != length]
    planned = df.filter(n > 0).select(
        *rest, n.alias("__n"), F.explode(F.sequence(F.lit(0).cast("long"), count - 1)).alias("__i")
    )
    start = F.col("__i") * stride
    return planned.select(
        *rest, F.col("__i").cast("int").alias("chunk_idx"), start.alias("start_frame"),
        F.least(start + size, F.col("__n")).alias("end_frame"), start.alias("overlap_start_frame"),
        F.col("__n").alias("clip_frames"),
    )


def model_chunks(df: DataFrame, length: str = "n_samples", whole_up_to: int = 960_000, **plan) -> DataFrame:
    """Plan for the model: clips of at most 60 s go through whole, longer ones are chunked."""
    n = F.col(length).cast("long")
    whole = df.filter((n > 0) & (n <= whole_up_to))
    rest = [c for c in df.columns if c != length]
    zero = F.lit(0).cast("long")
    single = whole.select(
        *rest, F.lit(0).cast("int").alias("chunk_idx"), zero.alias("start_frame"), n.alias("end_frame"),
        zero.alias("overlap_start_frame"), n.alias("clip_frames"),
    )
    return single.unionByName(plan_chunks(df.filter(n > whole_up_to), length=length, **plan))


def audit_chunk_coverage(plan: DataFrame, key: str = "clip_id", per_block: int = CHUNKS_PER_BLOCK) -> DataFrame:
    """One row per clip: number of chunks, gaps, order errors, whether the last chunk ends at the clip's end,
    and the narrowest and widest overlap."""
    with_prev = with_previous(
        plan, [key], ["chunk_idx"], sequence_block("chunk_idx", per_block),
        {"prev_end": "end_frame", "prev_start": "start_frame"},
    )
    overlap = F.col("prev_end") - F.col("start_frame")
    return with_prev.groupBy(key).agg(
        F.count(F.lit(1)).alias("chunks"),
        F.count_if(overlap < 0).alias("gaps"),
        F.count_if(F.col("start_frame") <= F.col("prev_start")).alias("order_errors"),
        (F.min("start_frame") == 0).alias("starts_at_zero"),
        (F.max("end_frame") == F.max("clip_frames")).alias("covers_end"),
        F.min(overlap).alias("min_overlap"),
        F.max(overlap).alias("max_overlap"),
    )


def clip_lengths(samples: DataFrame, key: str = "clip_id") -> DataFrame:
    return samples.groupBy(key).agg(F.count(F.lit(1)).alias("n_samples"))


def length_gate(df: DataFrame, n: str = "n_samples", win: int = audio.WINDOW, hop: int = audio.HOP) -> DataFrame:
    """Frame count, padded frame count and class; classes other than ``ok`` carry the reply text instead of
    being errors."""
    frames = audio.frame_count(F.col(n), win, hop)
    return df.withColumns({"frames": frames, "padded_frames": audio.padded_frames(frames)}).withColumns({
        "length_class": audio.length_class(F.col("frames")),
        "gate_text": F.when(F.col("frames") == 0, "")
        .when(F.col("frames") < audio.MIN_FRAMES, audio.TOO_SHORT)
        .when(F.col("frames") > audio.MAX_FRAMES, audio.TOO_LONG),
    })


