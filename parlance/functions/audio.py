"""Audio expressions over sample columns, sample arrays and lengths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Analysis settings whose results must match recordings already processed.
SAMPLE_RATE = 16_000
WINDOW = 400
HOP = 160
N_FFT = 512
N_MELS = 128
F_MIN = 0.0
F_MAX = 8000.0
LOG_FLOOR = 1e-10
STD_FLOOR = 1e-5
MIN_FRAMES = 5
MAX_FRAMES = 6_000
PAD_MULTIPLE = 8
ACTIVITY_FRAME = 512
ACTIVITY_HOP = 256
ACTIVITY_WEIGHTS = (0.5, 0.3, 0.2)
ACTIVITY_THRESHOLD = 0.02
FULL_RMS = 0.1
TOO_SHORT = "[Audio too short for transcription]"
TOO_LONG = f"[Audio too long for transcription (max {MAX_FRAMES} frames).]"
CHUNK_SECONDS = 50.0
OVERLAP_SECONDS = 2.0


def div(a: Column, b: Column | int) -> Column:
    """Integer division of two non-negative integers (no trip through DOUBLE)."""
    b = F.lit(b) if isinstance(b, int) else b
    return F.call_function("div", a, b)


def quantize_pcm16(amp: Column) -> Column:
    """Clamp to [-1, 1], scale by 32767, truncate toward zero."""
    return (F.greatest(F.least(amp, F.lit(1.0)), F.lit(-1.0)) * F.lit(32767.0)).cast("int")


def log_floor(value: Column, eps: float = LOG_FLOOR) -> Column:
    return F.ln(F.greatest(value, F.lit(eps)))


def capped_rms(mean_square: Column) -> Column:
    """RMS over the level counted as full (0.1), at most 1."""
    return F.least(F.lit(1.0), F.sqrt(mean_square) / F.lit(FULL_RMS))


def frame_count(n: Column, win: int = WINDOW, hop: int = HOP) -> Column:
    """Complete frames in ``n`` samples; 0 when not even one fits."""
    n = n.cast("long")
    return F.when(n >= win, div(n - win, hop) + 1).otherwise(F.lit(0)).cast("long")


def padded_frames(frames: Column, multiple: int = PAD_MULTIPLE) -> Column:
    return div(frames + (multiple - 1), multiple) * multiple


def length_class(frames: Column) -> Column:
    return (
        F.when(frames == 0, "empty")
        .when(frames < MIN_FRAMES, "too_short")
        .when(frames > MAX_FRAMES, "too_long")
        .otherwise("ok")
    )


def energy_confidence(n: Column, mean_square: Column, rate: int = SAMPLE_RATE) -> Column:
    """Confidence guessed from level and duration: short clips count less, long ones slightly less."""
    level = F.least(F.lit(1.0), F.sqrt(mean_square) / F.lit(FULL_RMS))
    seconds = n / F.lit(float(rate))
    weighted = level * F.when(seconds < 0.5, 0.7).when(seconds > 5.0, 0.95).otherwise(1.0)
    return F.when(n < 1600, F.lit(0.3)).otherwise(F.greatest(F.lit(0.1), F.least(F.lit(1.0), weighted)))


def activity_score(rms: Column, frame_energy: Column, zcr: Column, threshold: float = ACTIVITY_THRESHOLD) -> Column:
    a, b, c = ACTIVITY_WEIGHTS
    score = rms * F.lit(a) + frame_energy * F.lit(b) + zcr * F.lit(c)
    return F.when(score < threshold, F.lit(0.0)).otherwise(F.least(F.lit(1.0), score))


def crosses_zero(previous: Column, current: Column) -> Column:
    """True where the sign changes; zero counts as positive. NULL ``previous`` (first sample) is no crossing."""
    return F.coalesce((previous >= 0) != (current >= 0), F.lit(False))


def crossing_ratio(crossings: Column, n: Column) -> Column:
    return F.when(n < 2, F.lit(0.0)).otherwise(F.least(F.lit(1.0), crossings / (n / F.lit(2.0))))


def exact_duration(data_len: Column, sample_rate: Column, channels: Column, bits: Column) -> Column:
    """Seconds of sample data; NULL where the header leaves nothing to divide by."""
    return F.try_divide(data_len, sample_rate * channels * (bits / 8))


# Array forms: one row is one chunk or vector, work stays inside the row.

def mean_square_array(samples: Column) -> Column:
    total = F.aggregate(samples, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double"))
    return F.try_divide(total, F.size(samples))


def crossings_array(samples: Column) -> Column:
    shifted = F.slice(samples, F.lit(2), F.greatest(F.size(samples) - 1, F.lit(0)))
    pairs = F.zip_with(F.slice(samples, F.lit(1), F.size(shifted)), shifted, crosses_zero)
    return F.size(F.filter(pairs, lambda hit: hit))


def downmix_arrays(left: Column, right: Column) -> Column:
    return F.zip_with(left, right, lambda a, b: (a + b) / F.lit(2.0))


def frame_arrays(samples: Column, win: int, hop: int) -> Column:
    """Array of complete frames of one chunk."""
    n = frame_count(F.size(samples), win, hop).cast("int")
    starts = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda f: F.slice(samples, f * hop + 1, F.lit(win)))
