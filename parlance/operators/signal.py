"""Sample-level operators on the long layout ``(clip_id, idx, amp)``.

``idx`` is dense per clip, so ``(clip_id, run of 65,536 samples)`` is an exact bound on any unit of work.
Framed statistics never multiply samples by the number of frames that hold them: samples fold map-side into
bins of gcd(window, hop) samples first, and only bins are repeated.
"""

from __future__ import annotations

from math import gcd

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.functions import audio
from parlance.ordered import block_scan, sequence_block, with_previous, with_totals

SAMPLES_PER_BLOCK = 65_536
KEY = ["clip_id"]


def downmix(df: DataFrame) -> DataFrame:
    """``(clip_id, channel, idx, amp)`` -> mono: mean of two channels, else the first channel only."""
    first = F.min_by("amp", "channel")
    return df.groupBy("clip_id", "idx").agg(
        F.when(F.count(F.lit(1)) == 2, F.avg("amp")).otherwise(first).alias("amp")
    )


def quantize(df: DataFrame) -> DataFrame:
    return df.withColumn("pcm", audio.quantize_pcm16(F.col("amp")))


def resample_linear(df: DataFrame, src: int, dst: int, per_block: int = SAMPLES_PER_BLOCK) -> DataFrame:
    """Linear interpolation to ``dst`` Hz. Each source sample produces, map-side, the outputs that fall between
    it and its successor; the last sample is held."""
    if src == dst:
        return df.select("clip_id", "idx", "amp")
    ratio = src / dst
    joined = block_scan(
        df, KEY, ["idx"], sequence_block("idx", per_block),
        local=[{"__next": lambda s: F.lead("amp").over(s.step)}],
        summary={"__first": F.min_by("amp", "idx"), "__rows": F.count(F.lit(1))},
        carry=[{
            "__next_first": lambda s: F.lead("__first").over(s.step),
            "__n": lambda s: F.sum("__rows").over(s.whole),
        }],
        keep=["__next_first", "__n"],
    )
    # Candidates one wider than the exact range on both sides; the floor test below keeps the right ones.
    low = F.greatest(F.lit(0), F.floor(F.col("idx") / F.lit(ratio)) - 1)
    high = F.least(F.floor((F.col("idx") + 1) / F.lit(ratio)) + 1, (F.col("__n") / F.lit(ratio)).cast("long") - 1)
    position = F.col("out") * F.lit(ratio)
    frac = position - F.floor(position)
    nxt = F.coalesce(F.col("__next"), F.col("__next_first"))
    return (
        joined.filter(high >= low)
        .withColumn("out", F.explode(F.sequence(low, high)))
        .filter(F.floor(position) == F.col("idx"))
        .select(
            "clip_id", F.col("out").alias("idx"),
            F.when(nxt.isNull(), F.col("amp")).otherwise(F.col("amp") * (1 - frac) + nxt * frac).alias("amp"),
        )
    )


def frame_signal(df: DataFrame, win: int = audio.WINDOW, hop: int = audio.HOP, per_block: int = SAMPLES_PER_BLOCK) -> DataFrame:
    """``(clip_id, frame, pos, amp)`` for complete frames. Every sample finds its frames map-side; the clip length
    that tells complete frames arrives per ``(clip, run of samples)``, before samples are repeated."""
    sized = with_totals(df, KEY, sequence_block("idx", per_block), {"__n": F.lit(1)})
    framed = _to_frames(sized, "idx", 1, win, hop).filter(F.col("frame") * hop + win <= F.col("__n"))
    return framed.select("clip_id", "frame", (F.col("idx") - F.col("frame") * hop).alias("pos"), "amp")


def _to_frames(df: DataFrame, position: str, unit: int, win: int, hop: int) -> DataFrame:
    """Repeat rows that start at ``position * unit`` and span ``unit`` samples for each frame holding them."""
    if hop > win:
        raise ValueError("frames must not leave gaps: hop must be at most the window")
    at = F.col(position) * unit
    first = F.when(at >= win, audio.div(at - win + unit + hop - 1, hop)).otherwise(F.lit(0).cast("long"))
    last = audio.div(at, hop)
    return df.filter(last >= first).withColumn("frame", F.explode(F.sequence(first, last)))


def _bins(df: DataFrame, win: int, hop: int, sums: dict) -> DataFrame:
    unit = gcd(win, hop)
    return df.groupBy("clip_id", audio.div(F.col("idx"), unit).alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(name) for name, c in sums.items()]
    )


def _bins_to_frames(bins: DataFrame, win: int, hop: int, sums: dict) -> DataFrame:
    """Sum bins into frames, complete frames only."""
    framed = _to_frames(bins, "bin", gcd(win, hop), win, hop)
    return framed.groupBy("clip_id", "frame").agg(
        F.sum("n").alias("n"), *[F.sum(name).alias(name) for name in sums]
    ).filter(F.col("n") == win)


def rms(df: DataFrame) -> DataFrame:
    """Per clip: sample count, raw RMS and RMS over the full level, at most 1."""
    mean_square = F.avg(F.col("amp") * F.col("amp"))
    return df.groupBy("clip_id").agg(
        F.count(F.lit(1)).alias("n_samples"), F.sqrt(mean_square).alias("rms"),
        audio.capped_rms(mean_square).alias("rms_capped"),
    )


def frame_rms(df: DataFrame, win: int = audio.WINDOW, hop: int = audio.HOP) -> DataFrame:
    bins = _bins(df, win, hop, {"sq": F.col("amp") * F.col("amp")})
    framed = _bins_to_frames(bins, win, hop, {"sq": None})
    return framed.select(
        "clip_id", "frame", F.sqrt(F.col("sq") / F.col("n")).alias("rms"),
        audio.capped_rms(F.col("sq") / F.col("n")).alias("rms_capped"),
    )


def _frame_energy(bins: DataFrame, win: int, hop: int) -> DataFrame:
    """Mean capped RMS over complete frames, 0 for clips shorter than one frame (incomplete frames are kept as
    rows until here so that such clips stay in the result)."""
    framed = _to_frames(bins, "bin", gcd(win, hop), win, hop).groupBy("clip_id", "frame").agg(
        F.sum("n").alias("n"), F.sum("sq").alias("sq")
    )
    energy = F.when(F.col("n") == win, audio.capped_rms(F.col("sq") / F.col("n")))
    return framed.groupBy("clip_id").agg(F.coalesce(F.avg(energy), F.lit(0.0)).alias("frame_energy"))


def mean_frame_energy(df: DataFrame, win: int = audio.ACTIVITY_FRAME, hop: int = audio.ACTIVITY_HOP) -> DataFrame:
    return _frame_energy(_bins(df, win, hop, {"sq": F.col("amp") * F.col("amp")}), win, hop)


def _with_crossings(df: DataFrame, per_block: int = SAMPLES_PER_BLOCK) -> DataFrame:
    prev = with_previous(df, KEY, ["idx"], sequence_block("idx", per_block), {"__prev": "amp"})
    return prev.withColumn("crossing", audio.crosses_zero(F.col("__prev"), F.col("amp")).cast("long")).drop("__prev")


def zero_crossing_rate(df: DataFrame, per_block: int = SAMPLES_PER_BLOCK) -> DataFrame:
    return _with_crossings(df, per_block).groupBy("clip_id").agg(
        F.count(F.lit(1)).alias("n_samples"), F.sum("crossing").alias("crossings")
    ).withColumn("zcr", audio.crossing_ratio(F.col("crossings"), F.col("n_samples")))


def voice_activity(df: DataFrame, threshold: float = audio.ACTIVITY_THRESHOLD, win: int = audio.ACTIVITY_FRAME,
                   hop: int = audio.ACTIVITY_HOP) -> DataFrame:
    """Speech score per clip from level, mean frame level and zero crossings.

    One pass over the samples: they fold into bins that carry count, energy and crossings; clip sums and frame
    sums both come from the bins (1/256 of the rows), so no clip is ever gathered.
    """
    unit = gcd(win, hop)
    bins = _bins(_with_crossings(df), win, hop, {"sq": F.col("amp") * F.col("amp"), "crossing": F.col("crossing")})
    # The frame that a bin opens carries the bin's own sums once (``own``), for the clip totals.
    framed = _to_frames(bins, "bin", unit, win, hop)
    opens = F.col("frame") == audio.div(F.col("bin") * unit, hop)
    per_frame = framed.groupBy("clip_id", "frame").agg(
        F.sum("n").alias("n"), F.sum("sq").alias("sq"),
        F.sum(F.when(opens, F.col("n"))).alias("own_n"), F.sum(F.when(opens, F.col("sq"))).alias("own_sq"),
        F.sum(F.when(opens, F.col("crossing"))).alias("own_crossing"),
    )
    energy = F.when(F.col("n") == win, audio.capped_rms(F.col("sq") / F.col("n")))
    clips = per_frame.groupBy("clip_id").agg(
        F.sum("own_n").alias("n_samples"), F.sum("own_sq").alias("sq"), F.sum("own_crossing").alias("crossings"),
        F.coalesce(F.avg(energy), F.lit(0.0)).alias("frame_energy"),
    )
    scored = clips.withColumns({
        "rms_capped": audio.capped_rms(F.col("sq") / F.col("n_samples")),
        "zcr": audio.crossing_ratio(F.col("crossings"), F.col("n_samples")),
    }).withColumn("score", audio.activity_score(F.col("rms_capped"), F.col("frame_energy"), F.col("zcr"), threshold))
    return scored.select("clip_id", "n_samples", "rms_capped", "frame_energy", "zcr", "score",
                         (F.col("score") > 0).alias("is_speech"))


def energy_confidence(df: DataFrame, rate: int = audio.SAMPLE_RATE) -> DataFrame:
    stats = df.groupBy("clip_id").agg(
        F.count(F.lit(1)).alias("n_samples"), F.avg(F.col("amp") * F.col("amp")).alias("ms")
    )
    return stats.select(
        "clip_id", "n_samples", audio.energy_confidence(F.col("n_samples"), F.col("ms"), rate).alias("confidence")
    )


def pack_chunks(df: DataFrame, win: int = audio.WINDOW, hop: int = audio.HOP, frames: int = 256) -> DataFrame:
    """Long samples -> rows of at most ``frames`` frames' worth of samples, each overlapping the next so that
    frames never straddle rows: ``(clip_id, first_frame, samples)``. A row holds (frames-1)*hop+win samples."""
    span = frames * hop
    last = audio.div(F.col("idx"), span)
    first = F.when(F.col("idx") >= span - hop + win, audio.div(F.col("idx") - (span - hop + win), span) + 1).otherwise(
        F.lit(0).cast("long"))
    spread = df.filter(last >= first).withColumn("group", F.explode(F.sequence(first, last)))
    ordered = F.sort_array(F.collect_list(F.struct("idx", "amp")))
    return spread.groupBy("clip_id", "group").agg(F.transform(ordered, lambda s: s["amp"]).alias("samples")).select(
        "clip_id", (F.col("group") * frames).alias("first_frame"), "samples"
    )


