"""Recordings: scan, header audit, decode per chunk, encode and export."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F, types as T

from parlance import schemas
from parlance.functions import audio
from parlance.operators.chunks import chunk_frames
from parlance.sources.sinks import write_files

# Layout of the canonical 44-byte header and of recording paths.
CANONICAL_BYTES = 44
RECORDING_PATH = r"([^/]+)/turn_(\d{3,})_(user|assistant)\.wav$"


def scan_recordings(spark: SparkSession, root: str) -> DataFrame:
    """``path, session_id, turn_number, role, length, modificationTime, content`` of all WAV files below ``root``.

    Files named otherwise keep NULL session, turn and role. ``content`` is read only by queries that use it.
    """
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.wav").load(root)
    )

    def part(i):
        return F.nullif(F.regexp_extract("path", RECORDING_PATH, i), F.lit(""))

    return files.select(
        "path", part(1).alias("session_id"), part(2).cast("int").alias("turn_number"), part(3).alias("role"),
        "length", "modificationTime", "content",
    )


def _walk(data: bytes, total: int) -> tuple:
    """Header fields of one file; ``data`` may be a prefix that ends inside the sample data."""
    fmt, channels, rate, bits = 1, 1, audio.SAMPLE_RATE, 16

    def reject(reason):
        return fmt, channels, rate, bits, None, None, reason

    if total < CANONICAL_BYTES:
        return reject("too_short")
    if data[0:4] != b"RIFF":
        return reject("no_riff")
    if data[8:12] != b"WAVE":
        return reject("no_wave")
    at = 12
    while at < total - 8:
        name, size = data[at:at + 4], struct.unpack_from("<i", data, at + 4)[0]
        if size < 0:
            return reject("bad_chunk_size")
        if name == b"fmt ":
            if at + 24 > total:
                return reject("bad_format")
            fmt, channels, rate = struct.unpack_from("<hhi", data, at + 8)
            bits = struct.unpack_from("<h", data, at + 22)[0]
        elif name == b"data":
            if bits // 8 <= 0 or channels <= 0 or rate <= 0:
                return reject("bad_format")
            return fmt, channels, rate, bits, at + 8, min(size, total - at - 8), None
        at += 8 + size + size % 2
    return reject("no_data")


def wav_header(df: DataFrame, content: str = "content") -> DataFrame:
    """Append the header columns, with ``reject_reason`` where a decoder yields no samples, and a ``warning`` for
    formats that are decoded although not supported. Never fails on bad bytes.

    Python sees 44 bytes of a canonical file; only files with other chunks hand over their bytes.
    """
    body = F.col(content)
    canonical = (F.substring(body, 13, 4) == F.lit(bytearray(b"fmt "))) & (
        F.substring(body, 17, 4) == F.lit(bytearray(struct.pack("<i", 16)))) & (
        F.substring(body, 37, 4) == F.lit(bytearray(b"data")))
    walk_type = T.StructType(list(schemas.WAV_HEADER.fields))

    @F.pandas_udf(walk_type)
    def walk(head: pd.Series, total: pd.Series) -> pd.DataFrame:
        rows = [_walk(bytes(h), int(n)) if h is not None else (1, 1, audio.SAMPLE_RATE, 16, None, None, "too_short")
                for h, n in zip(head, total.fillna(0))]
        out = pd.DataFrame(rows, columns=[f.name for f in walk_type.fields])
        return out.astype({"data_offset": "Int64", "data_len": "Int64"})

    # Marked so that Spark does not copy the call into every expression that uses one of its fields.
    walk = walk.asNondeterministic()
    head = F.when(canonical, F.substring(body, 1, CANONICAL_BYTES)).otherwise(body)
    warning = F.when(F.col("reject_reason").isNotNull(), F.lit(None).cast("string")).when(
        F.col("audio_format") != 1, "unsupported_format").when(
        ~F.col("channels").between(1, 2), "unsupported_channels").when(
        ~F.col("bits").isin(8, 16, 24, 32), "unsupported_bits")
    return df.withColumn("__h", walk(head, F.length(body))).select(*df.columns, "__h.*").withColumn("warning", warning)


def fixed_offset_duration(df: DataFrame, content: str = "content") -> DataFrame:
    """Duration read from the fixed offsets 24 (rate) and 40 (data size), assuming 16-bit mono; 0 for files too short to
    have them. Built-in byte functions only."""
    def int32(at: int):
        """Little-endian signed 32-bit integer at a byte offset."""
        flipped = F.reverse(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.hex(F.substring(F.col(content), i + at + 1, F.lit(1)))))
        unsigned = F.conv(F.array_join(flipped, ""), 16, 10).cast("long")
        return F.when(unsigned >= 2 ** 31, unsigned - 2 ** 32).otherwise(unsigned)

    size, rate = int32(40), int32(24)
    value = F.when(rate * 2 != 0, size / (rate * 2).cast("double"))
    return df.withColumn("header_duration", F.when(F.length(content) < CANONICAL_BYTES, F.lit(0.0)).otherwise(value))


def _pcm(data: bytes, bits: int, channels: int) -> np.ndarray:
    """Interleaved bytes -> mono float64: mean of two channels, else the first channel."""
    width = bits // 8
    n = len(data) // (width * channels)
    raw = np.frombuffer(data, dtype=np.uint8, count=n * width * channels).reshape(n, channels, width)
    if bits == 8:
        values = (raw[:, :, 0].astype(np.float64) - 128.0) / 128.0
    elif bits in (16, 24, 32):
        wide = np.zeros((n, channels, 4), dtype=np.uint8)
        wide[:, :, 4 - width:] = raw
        # Left-aligned in 32 bits: one scale for all three depths, sign included.
        values = wide.reshape(n, channels * 4).view("<i4").astype(np.float64) / 2147483648.0
    else:
        values = np.zeros((n, channels))
    return values.mean(axis=1) if channels == 2 else values[:, 0]


def _resample(values: np.ndarray, first: int, start: int, end: int, ratio: float) -> np.ndarray:
    """Outputs ``start..end`` of the whole clip from its source samples ``first..``."""
    position = np.arange(start, end) * ratio
    floor = position.astype(np.int64)
    frac = position - floor
    at = floor - first
    nxt = np.minimum(at + 1, len(values) - 1)
    return np.where(at + 1 < len(values), values[at] * (1 - frac) + values[nxt] * frac, values[at])


def decode_pcm(headers: DataFrame, chunk_s: float = audio.CHUNK_SECONDS, overlap_s: float = audio.OVERLAP_SECONDS,
               rate: int = audio.SAMPLE_RATE, content: str = "content", whole_up_to: int = 0, keep_rejected: bool = False,
               spread: bool = False) -> DataFrame:
    """Header rows with their bytes -> one row per planned chunk: ``chunk_idx, start_frame, end_frame, samples``.

    The plan follows from the header alone, in frames of the target rate. Each chunk takes only its own byte range out of
    the file, natively, before anything reaches Python: a chunk row is a few MB however long the recording. With another
    source rate, a chunk reads one source sample more on the right, so that chunks equal slices of the resampled whole.
    Clips of at most ``whole_up_to`` frames stay whole. Rejected and empty files have no chunks or, with
    ``keep_rejected``, one chunk 0 without samples and with NULL frames. ``spread`` deals the byte ranges out by clip and
    chunk, so that the chunks of one long file are decoded (and scored, by what follows) by many tasks.
    """
    size, overlap = chunk_frames(chunk_s, overlap_s, rate)
    stride = size - overlap
    block = (audio.div(F.col("bits"), 8) * F.col("channels")).cast("long")
    fine = F.col("reject_reason").isNull()
    ok = headers.withColumn("__block", F.when(fine, block)).withColumn(
        "__source", F.when(F.col("__block") > 0, audio.div(F.col("data_len"), F.col("__block")))
    ).withColumn("__ratio", F.when(fine, F.col("sample_rate") / F.lit(float(rate)))).withColumn(
        "clip_frames", F.when(F.col("sample_rate") == rate, F.col("__source")).otherwise(
            F.try_divide("__source", "__ratio").cast("long"))
    ).withColumn("clip_frames", F.when(F.col("clip_frames") > 0, F.col("clip_frames")))
    if not keep_rejected:
        ok = ok.filter(F.col("clip_frames").isNotNull())
    n = F.col("clip_frames")
    whole = n <= max(size, whole_up_to)
    count = F.when(whole, F.lit(1).cast("long")).otherwise(audio.div(n - size + (stride - 1), stride) + 1)
    key = [c for c in headers.columns if c not in (content, *[f.name for f in schemas.WAV_HEADER.fields], "warning")]
    planned = ok.withColumn("__i", F.explode(F.coalesce(F.sequence(F.lit(0).cast("long"), count - 1), F.array(F.lit(0).cast("long"))))).withColumn(
        "start_frame", F.when(n.isNotNull(), F.col("__i") * stride)
    ).withColumn("chunk_idx", F.col("__i").cast("int")).withColumn("end_frame", F.when(whole, n).otherwise(F.least(F.col("start_frame") + size, n)))
    first = F.floor(F.col("start_frame") * F.col("__ratio")).cast("long")
    last = F.least(F.floor((F.col("end_frame") - 1) * F.col("__ratio")).cast("long") + 2, F.col("__source"))
    cut = planned.select(
        *key, "chunk_idx", "start_frame", "end_frame", "clip_frames", "bits", "channels", "__ratio", first.alias("__first"),
        F.substring(content, (F.col("data_offset") + first * F.col("__block") + 1).cast("int"),
                    ((last - first) * F.col("__block")).cast("int")).alias("__bytes"),
    )
    if spread:
        cut = cut.repartition(F.xxhash64(*key), F.col("chunk_idx"))
    keep = [*key, "chunk_idx", "start_frame", "end_frame", "clip_frames"]
    schema = T.StructType([*[cut.schema[c] for c in keep], T.StructField("samples", T.ArrayType(T.FloatType()))])

    def decode(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            samples = []
            for row in part.itertuples(index=False, name=None):
                at = dict(zip(part.columns, row))
                if at["__bytes"] is None:
                    samples.append(np.zeros(0, dtype=np.float32))
                    continue
                values = _pcm(bytes(at["__bytes"]), at["bits"], at["channels"])
                start, end = int(at["start_frame"]), int(at["end_frame"])
                if at["__ratio"] != 1.0:
                    values = _resample(values, int(at["__first"]), start, end, at["__ratio"])
                samples.append(values[: end - start].astype(np.float32))
            if samples:
                frames = {c: part[c].astype("Int64") for c in ("start_frame", "end_frame", "clip_frames")}
                yield part[keep].assign(**frames, samples=samples)

    return cut.mapInPandas(decode, schema)


def encode_wav(df: DataFrame, rate: int = audio.SAMPLE_RATE, samples: str = "samples") -> DataFrame:
    """Replace a bounded sample array by the bytes of a 16-bit mono file (clamp, scale by 32767, truncate)."""
    @F.pandas_udf(T.BinaryType())
    def encode(column: pd.Series) -> pd.Series:
        def one(values):
            pcm = np.trunc(np.clip(np.asarray(values, dtype=np.float64), -1.0, 1.0) * 32767.0).astype("<i2").tobytes()
            header = struct.pack("<4si4s4sihhiihh4si", b"RIFF", 36 + len(pcm), b"WAVE", b"fmt ", 16, 1, 1, rate, rate * 2,
                                 2, 16, b"data", len(pcm))
            return header + pcm

        return column.map(one)

    # Marked so that Spark does not repeat the call for every later use of the bytes.
    return df.withColumn("content", encode.asNondeterministic()(F.col(samples))).drop(samples)


def export_wav(df: DataFrame, root: str) -> DataFrame:
    """Write ``content`` to ``root/session_id/turn_NNN_role.wav``, one file per row, from the executors; all files appear
    once the job has succeeded, or none. Returns the manifest of the write (``path``, ``bytes``)."""
    name = F.format_string("%s/turn_%03d_%s.wav", F.col("session_id").cast("string"), "turn_number", "role")
    return write_files(df.select(name.alias("path"), "content"), root)
