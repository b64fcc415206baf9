"""Sessions, turns, settings and history as tables.

Orderings inside a session use ``ordered`` block scans: a session that holds a third of all rows is worked on by as
many tasks as it has blocks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.functions import text as tx
from parlance.ordered import (
    block_scan, sequence_block, time_block, with_last_known, with_row_number, with_following,
)

# What a session uses until a control message says otherwise.
DEFAULT_SMART_MODE = False
DEFAULT_SMART_MODEL = "phi3"
DEFAULT_PAUSE_MS = 800

BLOCK_SECONDS = 60
MESSAGES_PER_BLOCK = 4_096
SESSION = ["session_id"]


def number_turns(df: DataFrame, order: Sequence[str] = ("ts", "event_id"), block_seconds: int = BLOCK_SECONDS) -> DataFrame:
    """1-based attempt number per session. Failed attempts consume a number too, so number before filtering."""
    return with_row_number(df, SESSION, list(order), time_block(order[0], block_seconds), "turn_number")


def pair_turns(messages: DataFrame, per_block: int = MESSAGES_PER_BLOCK) -> DataFrame:
    """Each user message with the assistant message right after it, if there is one."""
    linked = with_following(
        messages, SESSION, ["seq"], sequence_block("seq", per_block),
        {"next_role": "role", "next_text": "text"},
    )
    return linked.filter(F.col("role") == "user").select(
        "session_id", "seq", F.col("text").alias("user_transcript"),
        F.when(F.col("next_role") == "assistant", F.col("next_text")).alias("assistant_response"),
    )


def drop_failed_transcripts(df: DataFrame, strict: bool = False, text: str = "text") -> DataFrame:
    """Rows whose transcript is usable, with a marker for chunks that failed on their own."""
    return df.filter(~tx.is_failed(F.col(text), strict)).withColumn(
        "chunk_failed", F.coalesce(F.contains(F.col(text), F.lit(tx.FAILED_CHUNK)), F.lit(False))
    )


def route_turns(df: DataFrame, strict: bool = False) -> DataFrame:
    """Output messages of each turn, in sending order.

    Input: ``transcript, reply, confidence, smart_mode, realtime_mode`` and key columns. Echo turns reply with their
    transcript. A failed transcript is reported and ends the turn.
    """
    failed = tx.is_failed(F.col("transcript"), strict)
    answer = F.when(F.col("smart_mode"), F.col("reply")).otherwise(F.col("transcript"))
    real = F.col("realtime_mode")
    none = F.lit(None).cast("string")

    def message(kind: str, body: Column, answer: Column = none, confidence: Column | None = None,
                partial: Column | None = None) -> Column:
        return F.struct(
            F.lit(kind).alias("type"), body.alias("transcript"), answer.alias("response"),
            (F.lit(None).cast("double") if confidence is None else confidence).alias("confidence"),
            (F.lit(None).cast("boolean") if partial is None else partial).alias("is_partial"),
        )

    said = F.col("transcript")
    heard = F.when(
        real, message("partial_transcript", said, none, F.when(failed, F.lit(0.0)).otherwise(F.col("confidence")), ~failed)
    ).otherwise(message("transcript", said))
    thinking = F.when(F.col("smart_mode") & ~failed, message("thinking", none))
    last = F.when(~failed & real, message("partial_llm", none, answer)).when(~failed, message("response", said, answer))
    audio = F.when(~failed & real, message("audio_chunk", none))
    out = F.filter(F.array(heard, thinking, last, audio), lambda m: m.isNotNull())
    rest = [c for c in df.columns if c not in ("transcript", "reply", "confidence", "smart_mode", "realtime_mode")]
    return df.select(*rest, F.posexplode(out).alias("step", "m")).select(*rest, "step", "m.*")


def session_rollup(turns: DataFrame) -> DataFrame:
    """Per session: first and last time, turns, speaking seconds, share of smart turns (partial sums map-side)."""
    seconds = F.coalesce(F.col("user_audio_duration"), F.lit(0.0)) + F.coalesce(
        F.col("assistant_audio_duration"), F.lit(0.0))
    return turns.groupBy("session_id").agg(
        F.min("ts").alias("start_time"), F.max("ts").alias("end_time"), F.count(F.lit(1)).alias("turns"),
        F.sum(seconds).alias("speaking_seconds"),
        (F.count_if("smart_mode") / F.count(F.lit(1))).alias("smart_share"),
    )


def attach_durations(turns: DataFrame, headers: DataFrame) -> DataFrame:
    """Durations of both recordings of a turn: NULL without a file, 0 for a file that cannot be read.

    ``headers(path, duration)`` has one row per file, so neither join multiplies rows; which way each join goes is
    left to Spark, which knows the sizes.
    """
    known = headers.select(F.col("path"), F.coalesce(F.col("duration"), F.lit(0.0)).alias("duration"))

    def side(df: DataFrame, role: str) -> DataFrame:
        # Turns without a file get a key that matches nothing and spreads them over all tasks.
        nowhere = F.concat(F.lit("\u0001"), F.xxhash64("session_id", "turn_number").cast("string"))
        keyed = df.withColumn("__path", F.coalesce(F.col(f"{role}_audio_file"), nowhere))
        named = known.select(F.col("path").alias("__path"), F.col("duration").alias(f"{role}_audio_duration"))
        return keyed.join(named, "__path", "left").drop("__path")

    return side(side(turns, "user"), "assistant")


def config_as_of(turns: DataFrame, control: DataFrame, block_seconds: int = BLOCK_SECONDS) -> DataFrame:
    """Settings in force at each turn - ``smart_mode, smart_model, pause_ms`` - the last value set before it, else the
    default. Control messages without a ``pause_ms`` column leave the pause threshold as it is.

    As-of join without a join: both tables in one ordering per session, last known value carried forward.
    """
    order = ["ts", "event_id"]
    null_mode, null_model = F.lit(None).cast("boolean"), F.lit(None).cast("string")
    rest = [c for c in turns.columns if c not in ("session_id", *order)]
    asked = turns.select("session_id", *order, F.struct(*rest).alias("turn") if rest else F.lit(True).alias("turn"),
                         null_mode.alias("set_mode"), null_model.alias("set_model"), F.lit(None).cast("int").alias("set_pause"))
    pause = F.col("pause_ms") if "pause_ms" in control.columns else F.lit(None)
    config = control.filter(F.col("type") == "config")
    given = config.select("session_id", *order, F.lit(None).cast(asked.schema["turn"].dataType).alias("turn"),
                          F.col("smart_mode").alias("set_mode"),
                          F.when(F.col("smart_model") != "", F.col("smart_model")).alias("set_model"), pause.cast("int").alias("set_pause"))
    known = with_last_known(
        asked.unionByName(given), SESSION, order, time_block("ts", block_seconds),
        {"smart_mode": "set_mode", "smart_model": "set_model", "pause_ms": "set_pause"},
    )
    return known.filter(F.col("turn").isNotNull()).select(
        "session_id", *order, *([f"turn.{c}" for c in rest]),
        F.coalesce("smart_mode", F.lit(DEFAULT_SMART_MODE)).alias("smart_mode"),
        F.coalesce("smart_model", F.lit(DEFAULT_SMART_MODEL)).alias("smart_model"),
        F.coalesce("pause_ms", F.lit(DEFAULT_PAUSE_MS)).alias("pause_ms"),
    )


def history_since_clear(events: DataFrame, block_seconds: int = BLOCK_SECONDS) -> DataFrame:
    """``epoch`` = clears before the row, ``position`` = 1-based place among the session's messages since the last
    clear. ``events(session_id, ts, event_id, is_clear, ...)``; clear rows are consumed.

    One scan: a message's position is the session's message count so far minus the count at the last clear.
    """
    clear = F.col("is_clear")
    out = block_scan(
        events, SESSION, ["ts", "event_id"], time_block("ts", block_seconds),
        local=[
            {"__clears": lambda s: F.count_if(clear).over(s.upto), "__said": lambda s: F.count_if(~clear).over(s.upto)},
            {"__base": lambda s: F.max(F.when(clear, F.col("__said"))).over(s.upto)},
        ],
        summary={"__block_clears": F.count_if(clear), "__block_said": F.count_if(~clear), "__block_base": F.max("__base")},
        carry=[
            {"__clears_before": lambda s: F.coalesce(F.sum("__block_clears").over(s.before), F.lit(0)),
             "__said_before": lambda s: F.coalesce(F.sum("__block_said").over(s.before), F.lit(0))},
            {"__base_abs": lambda s: F.col("__block_base") + F.col("__said_before")},
            {"__base_before": lambda s: F.coalesce(F.max("__base_abs").over(s.before), F.lit(0))},
        ],
        keep=["__clears_before", "__said_before", "__base_before"],
    )
    said = F.col("__said") + F.col("__said_before")
    base = F.coalesce(F.col("__base") + F.col("__said_before"), F.col("__base_before"))
    return out.filter(~clear).select(
        *[c for c in events.columns if c != "is_clear"],
        (F.col("__clears") + F.col("__clears_before")).alias("epoch"), (said - base).alias("position"),
    )


def history_ranges(turns: DataFrame) -> DataFrame:
    """The history each smart turn sees, as a range of message numbers within ``(session, epoch)``.

    A turn at position p sees messages 1 .. 2(p-1): a user and an assistant message per earlier smart turn. The
    ranges state the unbounded history exactly, in space linear in the number of turns.
    """
    return turns.withColumns({
        "first_message": F.lit(1).cast("long"), "last_message": (F.col("position") - 1) * 2,
        "history_size": (F.col("position") - 1) * 2,
    })


def chat_history(turns: DataFrame, max_messages: int) -> DataFrame:
    """The last ``max_messages`` messages (role, content) visible at each smart turn, as an array.

    Each turn is sent, map-side, to the later turns that can see it; groups are ``(session, epoch, position)`` and
    hold at most ``max_messages`` messages, so no session is gathered. Input: ``session_id, epoch, position,
    transcript, reply``.
    """
    if max_messages < 1:
        raise ValueError("max_messages must be positive; history_ranges states the unbounded history")
    reach = (max_messages + 1) // 2
    key = ["session_id", "epoch", "position"]
    pair = F.array(
        F.struct(F.lit("user").alias("role"), F.col("transcript").alias("content")),
        F.struct(F.lit("assistant").alias("role"), F.col("reply").alias("content")),
    )
    empty = F.array().cast("array<struct<role:string,content:string>>")
    offsets = F.sequence(F.lit(0), F.lit(reach))
    seen = turns.select("session_id", "epoch", "position", pair.alias("pair"), F.explode(offsets).alias("offset")).select(
        "session_id", "epoch", (F.col("position") + F.col("offset")).alias("position"),
        F.struct(F.col("position").alias("p"),
                 F.when(F.col("offset") > 0, F.col("pair")).otherwise(empty).alias("pair")).alias("m"),
        (F.col("offset") == 0).alias("own"),
    )
    grouped = seen.groupBy(*key).agg(F.bool_or("own").alias("own"), F.sort_array(F.collect_list("m")).alias("ms"))
    flat = F.flatten(F.transform("ms", lambda m: m["pair"]))
    tail = F.slice(flat, F.greatest(F.size(flat) - max_messages + 1, F.lit(1)), F.lit(max_messages))
    return grouped.filter("own").select(*key, tail.alias("history"))


def expire_sessions(sessions: DataFrame, max_age_days: int, now: Column) -> DataFrame:
    """Retention plan: ``expired`` for sessions older than the limit; a limit of 0 or less disables it."""
    if max_age_days <= 0:
        return sessions.withColumn("expired", F.lit(False))
    cutoff = now - F.make_dt_interval(days=F.lit(max_age_days))
    return sessions.withColumn("expired", F.col("created_at") < cutoff)


def latency_report(calls: DataFrame, by: Sequence[str] = (), percentiles: Sequence[int] = (50, 95, 99), accuracy: int = 10_000) -> DataFrame:
    """Real-time factor, throughput, spread and percentiles of processing times. ``calls(audio_s, wall_s, ...)``. Ratios of a
    group without audio or without processing time are NULL.

    ``p50_wall_s`` and so on are values of the group from a mergeable sketch of bounded size: the rank of such a value is wrong by
    1 / ``accuracy`` of the group's rows at most, so it is exact in groups of fewer rows.
    """
    at = F.percentile_approx("wall_s", [p / 100 for p in percentiles], accuracy)
    report = [
        F.count(F.lit(1)).alias("calls"), F.sum("audio_s").alias("audio_s"), F.sum("wall_s").alias("wall_s"),
        F.try_divide(F.sum("wall_s"), F.sum("audio_s")).alias("real_time_factor"),
        F.try_divide(F.sum("audio_s"), F.sum("wall_s")).alias("throughput"),
        F.avg("wall_s").alias("mean_wall_s"), F.stddev_pop("wall_s").alias("stddev_wall_s"),
        F.try_divide(F.sum("wall_s"), F.sum("audio_s") / 60).alias("wall_s_per_audio_minute"),
        *([at.alias("__at")] if percentiles else []),
    ]
    out = calls.groupBy(*by).agg(*report) if by else calls.agg(*report)
    return out.withColumns({f"p{p}_wall_s": F.get("__at", F.lit(i)) for i, p in enumerate(percentiles)}).drop("__at") if percentiles else out
