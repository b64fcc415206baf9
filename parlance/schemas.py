"""Explicit schemas of the tables the operators exchange (nothing is inferred on the hot path)."""

from pyspark.sql import types as T

WAV_HEADER = T.StructType([
    T.StructField("audio_format", T.IntegerType()),
    T.StructField("channels", T.IntegerType()),
    T.StructField("sample_rate", T.IntegerType()),
    T.StructField("bits", T.IntegerType()),
    T.StructField("data_offset", T.LongType()),
    T.StructField("data_len", T.LongType()),
    T.StructField("reject_reason", T.StringType()),
])

TURN = T.StructType([
    T.StructField("turnNumber", T.IntegerType()),
    T.StructField("timestamp", T.TimestampType()),
    T.StructField("userTranscript", T.StringType()),
    T.StructField("assistantResponse", T.StringType()),
    T.StructField("userAudioFile", T.StringType()),
    T.StructField("assistantAudioFile", T.StringType()),
    T.StructField("userAudioDuration", T.DoubleType()),
    T.StructField("assistantAudioDuration", T.DoubleType()),
])

SESSION_CONFIGURATION = T.StructType([
    T.StructField("smartMode", T.BooleanType()),
    T.StructField("smartModel", T.StringType()),
    T.StructField("realtimeMode", T.BooleanType()),
])

# The session document as stored on disk: camelCase names, endTime NULL while the session is open.
SESSION_DOCUMENT = T.StructType([
    T.StructField("sessionId", T.StringType()),
    T.StructField("startTime", T.TimestampType()),
    T.StructField("endTime", T.TimestampType()),
    T.StructField("turns", T.ArrayType(TURN)),
    T.StructField("configuration", SESSION_CONFIGURATION),
])
