"""Views of the given tables as the tables of a speech corpus (samples, chunks, turns, control, files...)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.ordered import sequence_block, with_row_number

ORDERS_PER_BLOCK = 65_536
WORDS_PER_CHUNK = 40
WORDS_OVERLAP = 8


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _numbered_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``clip_id, idx``: line items of one supplier numbered densely from 0."""
    items = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("clip_id"), "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity"
    )
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity"]
    numbered = with_row_number(items, ["clip_id"], order, sequence_block("l_orderkey", ORDERS_PER_BLOCK), "n")
    return numbered.withColumn("idx", F.col("n") - 1)


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``clip_id, idx, amp``: quantities of one supplier in order, scaled to [-1, 1]."""
    return _numbered_items(spark, sf_dir).select("clip_id", "idx", ((F.col("l_quantity") - 25.5) / 25.5).alias("amp"))


def token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``clip_id, seq, token_id``: part keys of one supplier in order."""
    return _numbered_items(spark, sf_dir).select("clip_id", F.col("idx").alias("seq"), F.col("l_partkey").alias("token_id"))


SAMPLES_PER_RECORDING = 8_192


def recordings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``session_id, turn_number, role, samples``: each clip cut into recordings of at most 8,192 samples."""
    turn = F.floor(F.col("idx") / F.lit(SAMPLES_PER_RECORDING)).cast("int") + 1
    ordered = F.sort_array(F.collect_list(F.struct("idx", "amp")))
    return samples(spark, sf_dir).groupBy(F.col("clip_id").alias("session_id"), turn.alias("turn_number")).agg(
        F.transform(ordered, lambda s: s["amp"]).alias("samples")).withColumn("role", F.lit("user"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("clip_id"), F.col("embedding").alias("samples"), "label"
    )


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``session_id, seq, role, text``"""
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("session_id"), F.col("turn").alias("seq"), "role", "text"
    )


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def live_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``session_id, chunk_no, received_at, n_samples``"""
    return _events(spark, sf_dir).select(
        F.col("user_id").alias("session_id"), F.col("event_id").alias("chunk_no"), F.col("ts").alias("received_at"),
        (F.col("value") * 100).cast("int").alias("n_samples"),
    )


def session_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``session_id, event_id, ts, type, setting``: signup is a config message, error clears, others are turns."""
    return _events(spark, sf_dir).select(
        F.col("user_id").alias("session_id"), "event_id", "ts", F.col("event_type"),
        F.when(F.col("event_type") == "signup", "config")
        .when(F.col("event_type") == "error", "clear_history")
        .otherwise("audio").alias("type"),
        F.get_json_object("props", "$.k").cast("int").alias("setting"),
    )


def control(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Control messages with the settings they carry: each names the mode, every other one also the model."""
    k = F.col("setting")
    return session_events(spark, sf_dir).filter(F.col("type") != "audio").select(
        "session_id", "event_id", "ts", "type",
        F.when((F.col("type") == "config") & (k % 3 != 0), k % 2 == 1).alias("smart_mode"),
        F.when((F.col("type") == "config") & (k % 2 == 0), F.concat(F.lit("m"), k.cast("string"))).alias("smart_model"),
    )


def audio_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return session_events(spark, sf_dir).filter(F.col("type") == "audio").select("session_id", "event_id", "ts", "setting")


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``log_id, ts, level, message``"""
    return _events(spark, sf_dir).select(
        F.col("event_id").alias("log_id"), "ts",
        F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "signup", "warn")
        .otherwise("info").alias("level"),
        F.concat(F.col("event_type"), F.lit(" "), F.col("props")).alias("message"),
    )


def chunk_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``clip_id, chunk_idx, text``: whole documents cut into overlapping runs of words (map-side)."""
    stride = WORDS_PER_CHUNK - WORDS_OVERLAP
    docs = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("clip_id"), F.array_remove(F.split("text", r"\s+"), "").alias("words")
    )
    n = F.size("words")
    last = F.greatest(F.lit(0), F.ceil((n - WORDS_PER_CHUNK) / F.lit(stride))).cast("int")
    # Cut before they are exploded, so that no chunk's row is made with all words of its document.
    chunks = F.transform(F.sequence(F.lit(0), last), lambda i: F.array_join(
        F.slice("words", i * stride + 1, F.lit(WORDS_PER_CHUNK)), " "))
    return docs.select("clip_id", F.posexplode(chunks).alias("chunk_idx", "text"))


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One artifact per part; names repeat, so ``artifact_id`` is the key."""
    p = F.col("p_partkey")

    def file(n):
        return F.concat(F.lit("f"), (1 + n % 100).cast("string"), F.lit(".bin"))

    return table(spark, sf_dir, "part").select(
        p.alias("artifact_id"), F.col("p_type").alias("artifact_type"), F.col("p_name").alias("name"),
        F.concat(F.when(p % 5 == 0, "vendor/").otherwise("hub/"), F.col("p_brand")).alias("repo"),
        file(p).alias("primary_file"), (F.col("p_retailprice") * 1_000_000).cast("long").alias("expected_bytes"),
        p.alias("dir"), (F.col("p_size") >= 25).alias("is_required"),
        F.array(file(p * 13)).alias("additional_files"), F.array(file(p * 7)).alias("alternates"),
        F.array(F.concat((p % 10).cast("string"), F.lit(".BIN"))).alias("include_patterns"),
        (F.col("p_size") % 2 == 0).alias("is_available"),
    )


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("dir"),
        F.concat(F.lit("f"), F.col("l_suppkey").cast("string"), F.lit(".bin")).alias("rel_path"),
    ).distinct()
