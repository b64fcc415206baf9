"""Session documents: nested JSON per session on disk, flat sessions and turns in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F, types as T

from parlance import schemas

TURNS_PER_DOCUMENT = 10_000


def scan_sessions(spark: SparkSession, root: str, one_per_line: bool = True) -> DataFrame:
    """Session documents below ``root`` with the fixed schema; ``one_per_line=False`` reads indented files.

    What isn't a session document becomes a row with ``reject_reason`` ('malformed' or 'no_session_id') and its text. A
    session that was written in parts has a row for each, with the times of the whole session.
    """
    schema = T.StructType([*schemas.SESSION_DOCUMENT.fields, T.StructField("__malformed", T.StringType())])
    reader = spark.read.schema(schema).option("columnNameOfCorruptRecord", "__malformed").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json")
    docs = reader.option("multiLine", str(not one_per_line).lower()).json(root)
    return docs.select(
        F.col("sessionId").alias("session_id"), F.col("startTime").alias("start_time"), F.col("endTime").alias("end_time"),
        F.struct(F.col("configuration.smartMode").alias("smart_mode"), F.col("configuration.smartModel").alias("smart_model"),
                 F.col("configuration.realtimeMode").alias("realtime_mode")).alias("configuration"), "turns",
        F.when(F.col("__malformed").isNotNull(), "malformed").when(F.col("sessionId").isNull(), "no_session_id").alias("reject_reason"),
        F.col("__malformed").alias("malformed_text"))


def explode_turns(sessions: DataFrame) -> DataFrame:
    """One row per turn; a session without turns keeps one row with NULL turn columns. Rejected documents have none."""
    if "reject_reason" in sessions.columns:
        sessions = sessions.filter(F.col("reject_reason").isNull())
    return sessions.select("session_id", F.explode_outer("turns").alias("t")).select(
        "session_id", F.col("t.turnNumber").alias("turn_number"), F.col("t.timestamp").alias("ts"),
        F.col("t.userTranscript").alias("user_transcript"), F.col("t.assistantResponse").alias("assistant_response"),
        F.col("t.userAudioFile").alias("user_audio_file"), F.col("t.assistantAudioFile").alias("assistant_audio_file"),
        F.col("t.userAudioDuration").alias("user_audio_duration"), F.col("t.assistantAudioDuration").alias("assistant_audio_duration"))


def session_documents(turns: DataFrame, sessions: DataFrame | None = None, closed: bool = True,
                      turns_per_document: int = TURNS_PER_DOCUMENT) -> DataFrame:
    """Fold turns into documents: ``session_id, part, doc(sessionId, startTime, endTime, turns, configuration)``.

    A session is one document, unless it has more than ``turns_per_document`` turn numbers: then it continues in
    further parts that a scan explodes to the same turns. No document gathers an unbounded session. ``sessions``
    (session_id, start_time, end_time, configuration) supplies the head; without it, times come from all turns of the
    session (the same in all its parts) and ``closed`` says whether an end time is written.
    """
    def column(name: str, kind: str):
        return (F.col(name) if name in turns.columns else F.lit(None)).cast(kind)

    turn = F.struct(
        F.col("turn_number").cast("int").alias("turnNumber"), F.col("ts").alias("timestamp"),
        column("user_transcript", "string").alias("userTranscript"),
        column("assistant_response", "string").alias("assistantResponse"),
        column("user_audio_file", "string").alias("userAudioFile"),
        column("assistant_audio_file", "string").alias("assistantAudioFile"),
        column("user_audio_duration", "double").alias("userAudioDuration"),
        column("assistant_audio_duration", "double").alias("assistantAudioDuration"),
    )
    part = F.floor((F.col("turn_number") - 1) / F.lit(turns_per_document)).cast("long")
    folded = turns.groupBy("session_id", part.alias("part")).agg(
        F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.sort_array(F.collect_list(turn)).alias("turns"))
    if sessions is None:
        # One row per part, so the window gathers (turns / turns_per_document) rows of a session.
        whole = Window.partitionBy("session_id")
        folded = folded.withColumns({"first_ts": F.min("first_ts").over(whole), "last_ts": F.max("last_ts").over(whole)})
        end = F.col("last_ts") if closed else F.lit(None).cast("timestamp")
        none = F.lit(None).cast(schemas.SESSION_CONFIGURATION)
        head = folded.withColumns({"start_time": F.col("first_ts"), "end_time": end, "configuration": none})
    else:
        head = folded.join(sessions.select("session_id", "start_time", "end_time", "configuration"), "session_id")
    return head.select(
        "session_id", "part",
        F.struct(F.col("session_id").cast("string").alias("sessionId"), F.col("start_time").alias("startTime"),
                 F.col("end_time").alias("endTime"), "turns", "configuration").alias("doc"))


def write_sessions(turns: DataFrame, path: str, sessions: DataFrame | None = None, **options) -> None:
    """Write the documents as JSON lines. Rows are hash-distributed by session, many sessions to a file."""
    session_documents(turns, sessions, **options).select("doc.*").write.mode("errorifexists").json(path)
