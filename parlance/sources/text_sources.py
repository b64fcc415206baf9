"""Text sources: session logs, control messages, vocabularies; response payloads and the log sink."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Form of a log line (offset timestamp, level in brackets, message).
LOG_LINE = r"^(\S+) \[([^\]]*)\] (.*)$"
DEFAULT_LEVEL = "info"


def parse_log_lines(df: DataFrame, line: str = "line") -> DataFrame:
    """``ts, level, message`` and ``reject_reason`` for lines of another form or with an unreadable time."""
    text = F.col(line)
    matched = text.rlike(LOG_LINE)
    out = df.withColumns({
        "ts": F.when(matched, F.regexp_extract(text, LOG_LINE, 1).try_cast("timestamp")),
        "level": F.when(matched, F.regexp_extract(text, LOG_LINE, 2)),
        "message": F.when(matched, F.regexp_extract(text, LOG_LINE, 3)),
    })
    reason = F.when(~F.coalesce(matched, F.lit(False)), "no_match").when(F.col("ts").isNull(), "bad_timestamp")
    return out.withColumn("reject_reason", reason)


def scan_session_logs(spark: SparkSession, path: str) -> DataFrame:
    """Log files below ``path``: ``session_id`` is the name of the folder that holds the file (the value, for
    folders named ``key=value``)."""
    lines = spark.read.option("recursiveFileLookup", "true").text(path).select(
        F.col("value").alias("line"), F.col("_metadata.file_path").alias("path"))
    session = F.regexp_extract("path", r"([^/=]+)/[^/]*$", 1)
    return parse_log_lines(lines.withColumn("session_id", session)).drop("path")


def parse_control(df: DataFrame, payload: str = "payload") -> DataFrame:
    """Control messages: ``status`` (config, clear_history, unknown, malformed, ignored), ``type``, ``smart_mode``,
    ``smart_model``.

    Property names and the type match in any case. A value of another JSON type makes the message malformed, like
    text that is no JSON object; a bare ``null`` is ignored. Other properties, realtime ones included, have no effect.
    """
    doc = F.try_parse_json(payload)
    fields = F.map_entries(F.try_variant_get(doc, "$", "map<string,variant>"))

    def field(name: str):
        return F.try_element_at(F.filter("__fields", lambda e: F.lower(e["key"]) == name), F.lit(-1))["value"]

    parsed = df.withColumns({"__doc": doc, "__fields": fields}).withColumns({
        "__fields": F.coalesce("__fields", F.array().cast("array<struct<key:string,value:variant>>"))
    }).withColumns({
        "__type": field("type"),
        "__mode": field("smart_mode"),
        "__model": field("smart_model"),
    })

    def is_kind(name: str, kind: str):
        return F.coalesce(F.schema_of_variant(name).isin(kind, "VOID"), F.lit(True))

    root = F.schema_of_variant("__doc")
    well_formed = F.startswith(root, F.lit("OBJECT")) & is_kind("__type", "STRING") & is_kind("__mode", "BOOLEAN") & is_kind(
        "__model", "STRING")
    kind = F.lower(F.try_variant_get("__type", "$", "string"))
    status = (
        F.when(F.col(payload).isNull() | (root == "VOID"), "ignored").when(~F.coalesce(well_formed, F.lit(False)), "malformed")
        .when(kind.isin("config", "clear_history"), kind).otherwise("unknown")
    )
    config = F.col("status") == "config"
    return parsed.withColumn("status", status).withColumns({
        "type": F.when(F.col("status") != "malformed", kind),
        "smart_mode": F.when(config, F.try_variant_get("__mode", "$", "boolean")),
        "smart_model": F.when(config, F.nullif(F.try_variant_get("__model", "$", "string"), F.lit(""))),
    }).drop("__doc", "__fields", "__type", "__mode", "__model")


def scan_vocab(spark: SparkSession, path: str) -> DataFrame:
    """``vocab_id, token_id, piece``: one piece per line, the line number is the id. ``vocab_id`` is the folder or file
    name without extension. A vocabulary is one text file of about a thousand lines; files are read in parallel."""
    files = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True).select(
        F.col("value"), F.col("_metadata.file_path").alias("path"))
    body = F.regexp_replace("value", r"\r?\n$", "")
    return files.filter(F.length("value") > 0).select(
        F.regexp_extract("path", r"([^/=]+)/[^/]*$", 1).alias("vocab_id"), F.posexplode(F.split(body, r"\r?\n")).alias("token_id", "piece"))


def response_payloads(df: DataFrame) -> DataFrame:
    """Append ``payload``, the JSON text sent for each response row.

    Input: ``type``, ``transcript``, ``response``, ``audio`` (BINARY), ``confidence``, ``is_partial``, ``is_complete``,
    ``is_final``. Standard messages use lower-case property names, realtime ones capitalised names.
    """
    sound = F.base64("audio")

    def message(**fields):
        return F.to_json(F.struct(*[v.alias(k) for k, v in fields.items()]))

    t = F.col("type")
    payload = (
        F.when(t == "transcript", message(type=t, transcript=F.col("transcript")))
        .when(t == "thinking", message(type=t))
        .when(t == "response", message(type=t, transcript=F.col("transcript"), response=F.col("response"), audio=sound))
        .when(t == "partial_transcript", message(Type=t, Transcript=F.col("transcript"), Confidence=F.col("confidence"), IsPartial=F.col("is_partial")))
        .when(t == "partial_llm", message(Type=t, Text=F.col("response"), IsComplete=F.col("is_complete")))
        .when(t == "audio_chunk", message(Type=t, AudioBase64=sound, IsFinal=F.col("is_final")))
    )
    return df.withColumn("payload", payload)


def log_payloads(logs: DataFrame) -> DataFrame:
    """Log entries as JSON text; a missing level is ``info``."""
    entry = F.struct(
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("timestamp"),
        F.coalesce("level", F.lit(DEFAULT_LEVEL)).alias("level"), F.col("message"))
    return logs.select(*[c for c in logs.columns if c not in ("ts", "level", "message")], F.to_json(entry).alias("payload"))


def log_stream_sink(logs: DataFrame, deliver: Callable[[DataFrame, int], None], checkpoint: str):
    """Start a stream that hands each micro-batch of JSON entries to ``deliver(batch, batch_id)``. A batch may be
    repeated after a failure with the same id, so ``deliver`` should be idempotent per id."""
    return (
        log_payloads(logs).writeStream.foreachBatch(deliver).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
