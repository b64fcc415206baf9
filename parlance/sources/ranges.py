"""Recordings read by byte range: a data source whose partitions are pieces of files, so that no task and no row holds a file.

Planning needs only the paths and lengths of the files. A file longer than ``split_bytes`` is several pieces; short files share a
partition, and so do small pieces where there are very many. A task reads the header of its file (the chunk headers, not the bodies between them), derives the chunk plan from it
and decodes those planned chunks whose first byte lies in its piece, each from its own byte range. Every chunk is in exactly one
piece, whatever the piece size.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from parlance import schemas
from parlance.functions import audio
from parlance.operators.chunks import chunk_frames
from parlance.sources.recordings import CANONICAL_BYTES, RECORDING_PATH, _pcm, _resample

LARGE = (1 << 31) - 1   # files beyond this have sizes that don't fit 31 bits: they are read as unsigned, or from a 64-bit chunk
# Beyond so many tasks, those with little to read take more pieces, up to so many bytes: a task costs more than a small piece.
TASKS, SMALL_TASK = 1_000, 8 << 20
BATCH_ROWS, BATCH_SAMPLES = 1_024, 1 << 18   # chunks go to Spark together up to these sizes
KEY = "path string, session_id string, turn_number int, role string, length long"
PLAN = "chunk_idx int, start_frame long, end_frame long, clip_frames long"


def read_header(file, total: int) -> tuple:
    """Header fields as in ``recordings.wav_header``, from the few bytes that hold them, for files of any length.

    A file of more than 2 GiB may have a data size of 32 bits without sign, or of 64 bits in a ``ds64`` chunk (then the file
    starts with RF64 and the data chunk says 0xFFFFFFFF). In shorter files a negative size is bad, as it is for all readers.
    """
    fmt, channels, rate, bits = 1, 1, audio.SAMPLE_RATE, 16
    large, wide = total > LARGE, None

    def reject(reason):
        return fmt, channels, rate, bits, None, None, reason

    if total < CANONICAL_BYTES:
        return reject("too_short")
    start = file.read_at(12, 0)
    if start[0:4] != b"RIFF" and not (large and start[0:4] == b"RF64"):
        return reject("no_riff")
    if start[8:12] != b"WAVE":
        return reject("no_wave")
    at = 12
    while at < total - 8:
        head = file.read_at(8, at)
        name, size = head[:4], struct.unpack("<I" if large else "<i", head[4:])[0]
        if size < 0:
            return reject("bad_chunk_size")
        if name == b"ds64" and large:
            wide = struct.unpack("<q", file.read_at(8, at + 16))[0]
        elif name == b"fmt ":
            if at + 24 > total:
                return reject("bad_format")
            fmt, channels, rate, _, _, bits = struct.unpack("<hhiihh", file.read_at(16, at + 8))
        elif name == b"data":
            if bits // 8 <= 0 or channels <= 0 or rate <= 0:
                return reject("bad_format")
            size = wide if wide is not None and size == 0xFFFFFFFF else size
            return fmt, channels, rate, bits, at + 8, min(size, total - at - 8), None
        at += 8 + size + size % 2
    return reject("no_data")


@dataclass(frozen=True)
class ChunkPlan:
    chunk_s: float = audio.CHUNK_SECONDS
    overlap_s: float = audio.OVERLAP_SECONDS
    rate: int = audio.SAMPLE_RATE
    whole_up_to: int = 0

    @property
    def size(self) -> int:
        return chunk_frames(self.chunk_s, self.overlap_s, self.rate)[0]

    @property
    def stride(self) -> int:
        return self.size - chunk_frames(self.chunk_s, self.overlap_s, self.rate)[1]

    def chunk(self, i: int, n: int) -> tuple[int, int]:
        """Frames of chunk i of a clip of n frames."""
        start = i * self.stride
        return (0, n) if n <= max(self.size, self.whole_up_to) else (start, min(start + self.size, n))

    def count(self, n: int) -> int:
        return 1 if n <= max(self.size, self.whole_up_to) else (n - self.size + self.stride - 1) // self.stride + 1


@dataclass
class Pieces(InputPartition):
    """``path, length, low, high``: the chunks that begin in the bytes from low to high (of a short file: all)."""

    pieces: list[tuple[str, int, int, int]]


class RecordingChunks(DataSource):
    """``spark.read.format("recording_chunks")``. Options: ``path`` (a folder, searched below; or one file), ``chunk_s``, ``overlap_s``,
    ``rate``, ``whole_up_to``, ``keep_rejected`` and ``split_bytes``; see ``read_chunks``."""

    @classmethod
    def name(cls) -> str:
        return "recording_chunks"

    def schema(self) -> str:
        header = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schemas.WAV_HEADER.fields)
        return f"{KEY}, {header}, {PLAN}, samples array<float>"

    def reader(self, schema) -> DataSourceReader:
        return ChunkReader(self.options)


class ChunkReader(DataSourceReader):
    def __init__(self, options) -> None:
        self.path = options["path"]
        self.plan = ChunkPlan(float(options.get("chunk_s", audio.CHUNK_SECONDS)), float(options.get("overlap_s", audio.OVERLAP_SECONDS)),
                              int(options.get("rate", audio.SAMPLE_RATE)), int(options.get("whole_up_to", 0)))
        self.keep_rejected = options.get("keep_rejected", "false").lower() == "true"
        self.split = int(options.get("split_bytes", 128 << 20))
        if self.plan.stride <= 0 or self.split <= 0:
            raise ValueError("pieces must not be empty and chunks must move on")

    def _system(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.path) if "://" in self.path else (fs.LocalFileSystem(), self.path.removeprefix("file:"))

    def _shown(self, path: str) -> str:
        return f"{self.path.partition('://')[0]}://{path}" if "://" in self.path else path

    def partitions(self) -> list[Pieces]:
        from pyarrow import fs

        system, root = self._system()
        info = system.get_file_info(root)
        files = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(root, recursive=True))
        found = sorted((f.path, f.size) for f in files if f.type == fs.FileType.File and f.path.lower().endswith(".wav"))
        out, lot, held = [], [], 0
        task = max(self.split, min(SMALL_TASK, sum(max(length, 1) for _, length in found) // TASKS))
        for path, length in found:
            for low in range(0, max(length, 1), self.split):
                high = min(low + self.split, max(length, 1))
                if lot and held + high - low > task:
                    out.append(Pieces(lot))
                    lot, held = [], 0
                if lot and low and lot[-1][0] == path:
                    lot[-1] = (path, length, lot[-1][2], high)  # the piece after the last one: both are read as one
                else:
                    lot.append((path, length, low, high))
                held += high - low
        return [*out, *([Pieces(lot)] if lot else [])]

    def read(self, partition: Pieces | None) -> Iterator[pa.RecordBatch]:
        system, _ = self._system()
        rows, size = [], 0
        for path, length, low, high in partition.pieces if partition is not None else ():  # no file, no partition
            with system.open_input_file(path) as file:
                for row in self._chunks(file, path, length, low, high):
                    rows.append(row)
                    size += len(row[-1])
                    if len(rows) >= BATCH_ROWS or size >= BATCH_SAMPLES:
                        yield _batch(rows)
                        rows, size = [], 0
        if rows:
            yield _batch(rows)

    def _chunks(self, file, path: str, length: int, low: int, high: int) -> Iterator[tuple]:
        header = read_header(file, length)
        _, channels, rate, bits, offset, size, reason = header
        named = re.search(RECORDING_PATH, path)
        key = (self._shown(path), *((named[1], int(named[2]), named[3]) if named else (None, None, None)), length)
        block = bits // 8 * channels if reason is None else 0
        source = size // block if block > 0 else 0
        ratio = rate / self.plan.rate
        n = source if rate == self.plan.rate else int(source / ratio)
        if n <= 0:
            if self.keep_rejected and low == 0:
                yield *key, *header, 0, None, None, None, np.zeros(0, np.float32)
            return
        first_of = lambda i: int(np.floor(self.plan.chunk(i, n)[0] * ratio))
        total, begin = self.plan.count(n), 0
        if low > 0:
            # The first chunk at or after the piece's start; a step to either side takes care of rounding.
            begin = max(0, int((low - offset) / block / ratio / self.plan.stride) - 1)
            while begin < total and offset + first_of(begin) * block < low:
                begin += 1
        for i in range(begin, total):
            first = first_of(i)
            if offset + first * block >= high:
                break
            start, end = self.plan.chunk(i, n)
            last = min(int(np.floor((end - 1) * ratio)) + 2, source)
            values = _pcm(file.read_at((last - first) * block, offset + first * block), bits, channels)
            if ratio != 1.0:
                values = _resample(values, first, start, end, ratio)
            yield *key, *header, i, start, end, n, values[:end - start].astype(np.float32)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = [c.split()[0] for c in KEY.split(", ")] + [f.name for f in schemas.WAV_HEADER.fields] + [c.split()[0] for c in PLAN.split(", ")] + ["samples"]
    kinds = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "long": pa.int64()}
    types = [kinds[c.split()[1]] for c in KEY.split(", ")] + [kinds[f.dataType.simpleString()] for f in schemas.WAV_HEADER.fields] + [kinds[c.split()[1]] for c in PLAN.split(", ")]
    *columns, samples = zip(*rows)
    arrays = [pa.array(v, t) for v, t in zip(columns, types)]
    offsets = np.cumsum([0, *(len(s) for s in samples)])
    arrays.append(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(samples))))
    return pa.RecordBatch.from_arrays(arrays, names=names)


def read_chunks(spark: SparkSession, root: str, chunk_s: float = audio.CHUNK_SECONDS, overlap_s: float = audio.OVERLAP_SECONDS,
                rate: int = audio.SAMPLE_RATE, whole_up_to: int = 0, keep_rejected: bool = False, split_bytes: int = 128 << 20) -> DataFrame:
    """The WAV files below ``root`` -> one row per planned chunk: path columns as ``recordings.scan_recordings`` has them, header
    columns, ``chunk_idx, start_frame, end_frame, clip_frames, samples`` as ``recordings.decode_pcm`` has them.

    Rejected and empty files have no rows or, with ``keep_rejected``, one chunk 0 without samples and with NULL frames. A clip that
    stays whole (``whole_up_to``) is read by one task; all others in chunks of ``chunk_s``. A long file is read by as many tasks as it
    has pieces of ``split_bytes`` (small pieces share tasks beyond 1,000 of them). No task reads more of a file than its header and its own chunks.
    """
    spark.dataSource.register(RecordingChunks)
    options = {"chunk_s": chunk_s, "overlap_s": overlap_s, "rate": rate, "whole_up_to": whole_up_to, "keep_rejected": str(keep_rejected).lower(), "split_bytes": split_bytes}
    return spark.read.format("recording_chunks").options(**options).load(root)
