"""Live-session buffering: pause segments, bounded buffers, fragments, log fan-out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parlance.ordered import block_scan, concat_ordered, sequence_block, time_block, with_running_sum

GAP_MS = 800
CAPACITY = 512_000
BLOCK_SECONDS = 60
FRAGMENTS_PER_BLOCK = 65_536
PACK_MOST = 1_024    # subscriptions of one row of the fan-out at most


def segment_on_pause(df: DataFrame, gap_ms: int = GAP_MS, emit_tail: bool = False, order: Sequence[str] = ("received_at", "chunk_no"),
                     key: str = "session_id", block_seconds: int = BLOCK_SECONDS) -> DataFrame:
    """Number the pause segments of each session (from 0) and count what each chunk finds in the buffer.

    A chunk that arrives ``gap_ms`` or more after its predecessor opens a segment. Empty chunks are ignored: they
    neither fill the buffer nor reset its clock. A segment is closed by the chunk after it, so the last one of a
    session stays open and is discarded unless ``emit_tail``. Adds ``segment``, ``offered_before`` (samples offered
    earlier in the segment) and ``is_closed``.

    One scan gives all three: blocks carry their last arrival, their breaks, their total and the running total at
    their last break.
    """
    at, n = order[0], F.col("n_samples").cast("long")
    gap_us = gap_ms * 1000
    micros = F.unix_micros(F.col(at))
    out = block_scan(
        df.filter(n > 0).withColumn("__us", micros), [key], list(order), time_block(at, block_seconds),
        local=[
            {"__prev": lambda s: F.lag("__us").over(s.step), "__cum": lambda s: F.coalesce(F.sum(n).over(s.before), F.lit(0))},
            {"__break": lambda s: F.coalesce(F.col("__us") - F.col("__prev") >= gap_us, F.lit(False))},
            {"__breaks": lambda s: F.count_if("__break").over(s.upto),
             "__base": lambda s: F.max(F.when(F.col("__break"), F.col("__cum"))).over(s.upto)},
        ],
        summary={
            "__first_us": F.min("__us"), "__last_us": F.max("__us"), "__total": F.sum(n),
            "__block_breaks": F.count_if("__break"), "__block_base": F.max("__base"),
        },
        carry=[
            {"__opens": lambda s: F.coalesce(
                F.col("__first_us") - F.lag("__last_us").over(s.step) >= gap_us, F.lit(False)).cast("long"),
             "__cum_before": lambda s: F.coalesce(F.sum("__total").over(s.before), F.lit(0))},
            {"__seg_before": lambda s: F.sum(F.col("__opens")).over(s.upto)
             + F.coalesce(F.sum("__block_breaks").over(s.before), F.lit(0)),
             "__own_open": lambda s: F.when(F.col("__opens") == 1, F.col("__cum_before")),
             "__base_abs": lambda s: F.coalesce(F.col("__block_base") + F.col("__cum_before"),
                                                F.when(F.col("__opens") == 1, F.col("__cum_before")))},
            {"__base_before": lambda s: F.coalesce(F.col("__own_open"), F.max("__base_abs").over(s.before), F.lit(0)),
             "__last_seg": lambda s: F.sum(F.col("__opens") + F.col("__block_breaks")).over(s.whole)},
        ],
        keep=["__seg_before", "__cum_before", "__base_before", "__last_seg"],
    )
    cum = F.col("__cum") + F.col("__cum_before")
    base = F.coalesce(F.col("__base") + F.col("__cum_before"), F.col("__base_before"))
    segment = F.col("__breaks") + F.col("__seg_before")
    result = out.select(
        *df.columns, segment.alias("segment"), (cum - base).alias("offered_before"),
        (segment < F.col("__last_seg")).alias("is_closed"),
    )
    return result if emit_tail else result.filter("is_closed")


def bounded_segments(segmented: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Samples of each chunk that still fit into the segment's buffer, and those that do not."""
    n = F.col("n_samples").cast("long")
    accepted = F.greatest(F.lit(0), F.least(n, F.lit(capacity) - F.col("offered_before")))
    return segmented.withColumn("accepted", accepted).withColumn("dropped", n - F.col("accepted"))


def buffer_status(segmented: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Samples held after each chunk and the fill percentage."""
    held = F.least(F.lit(capacity), F.col("offered_before") + F.col("n_samples").cast("long"))
    return segmented.withColumn("held", held).withColumn("fill_percent", F.col("held") / F.lit(float(capacity)) * 100)


def segment_rollup(bounded: DataFrame) -> DataFrame:
    """Segments per session with totals: partial sums per segment, then per session."""
    per_segment = bounded.groupBy("session_id", "segment").agg(
        F.count(F.lit(1)).alias("chunks"), F.sum("accepted").alias("accepted"), F.sum("dropped").alias("dropped"),
        F.min("received_at").alias("first_at"), F.max("received_at").alias("last_at"),
    )
    return per_segment.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("segments"), F.sum("chunks").alias("chunks"), F.sum("accepted").alias("accepted"),
        F.sum("dropped").alias("dropped"), F.max("accepted").alias("largest_segment"),
        F.unix_micros(F.min("first_at")).alias("first_us"), F.unix_micros(F.max("last_at")).alias("last_us"),
    )


def flush_segments(bounded: DataFrame, order: Sequence[str] = ("received_at", "chunk_no"), samples: str = "samples") -> DataFrame:
    """Audio of each segment in arrival order. What exceeds the capacity was cut before, so a result row holds at
    most ``capacity`` samples; chunks without accepted samples are not shuffled at all."""
    kept = bounded.filter(F.col("accepted") > 0)
    part = F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)],
                    F.slice(samples, F.lit(1), F.col("accepted").cast("int")).alias("part"))
    return kept.groupBy("session_id", "segment").agg(
        F.flatten(F.transform(F.sort_array(F.collect_list(part)), lambda p: p["part"])).alias("samples")
    )


def reassemble_fragments(df: DataFrame, key: str = "connection", order: str = "seq", text: str = "part",
                         end: str = "is_end", per_block: int = FRAGMENTS_PER_BLOCK) -> DataFrame:
    """``(connection, message_no, text, fragments)`` for complete messages. A message number is the count of end
    flags before the fragment; fragments after the last end flag belong to no message yet."""
    numbered = with_running_sum(
        df, [key], [order], sequence_block(order, per_block), F.col(end).cast("long"), "message_no", inclusive=False
    )
    sizes = numbered.groupBy(key, "message_no").agg(F.count(F.lit(1)).alias("fragments"), F.bool_or(end).alias("complete"))
    whole = numbered.join(sizes.filter("complete").drop("complete"), [key, "message_no"])
    return concat_ordered(
        whole, [key, "message_no", "fragments"], [order], sequence_block(order, per_block), text, "", "text"
    )


def log_fanout(logs: DataFrame, subscriptions: DataFrame, bucket_seconds: int = 300, salts: int = 8) -> DataFrame:
    """Every log entry to every subscriber connected at that instant (``start <= ts < end``).

    Interval join as an equi-join: a subscription is repeated for the time buckets it touches, a log lies in one. Busy
    buckets are cut into ``salts`` parts by log id. The subscriptions of a bucket are packed into arrays of at most
    ``PACK_MOST``, and only those few rows are repeated for each part; a log goes through the arrays of its part.

    The result can be hundreds of times its input, so Spark's sizes of the input say little about the work: the repeated side
    is never broadcast, and the parts are dealt to all shuffle partitions, which aren't merged into a few tasks.
    """
    width = bucket_seconds * 1_000_000
    dealt = (int(logs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "__bucket", "__salt")
    start, end = F.unix_micros("start_at"), F.unix_micros("end_at")
    touched = subscriptions.filter(end > start).select(
        F.struct("*").alias("__sub"), F.explode(F.sequence(start - F.pmod(start, F.lit(width)), end - 1, F.lit(width).cast("long"))).alias("__bucket"))
    nth = F.row_number().over(Window.partitionBy("__bucket").orderBy("__sub.start_at")) - 1
    packs = touched.withColumn("__pack", F.floor(nth / PACK_MOST)).groupBy("__bucket", "__pack").agg(F.collect_list("__sub").alias("__subs")).select(
        "__bucket", "__subs", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("__salt"))
    entries = logs.withColumns({
        "__bucket": time_block("ts", bucket_seconds), "__salt": F.pmod(F.xxhash64("log_id"), F.lit(salts)).cast("int"),
    })
    joined = entries.repartition(*dealt).join(packs.repartition(*dealt).hint("merge"), ["__bucket", "__salt"])
    pairs = joined.select(*logs.columns, F.inline("__subs"))
    return pairs.filter((F.col("ts") >= F.col("start_at")) & (F.col("ts") < F.col("end_at")))
