"""Token files: ids of each document compressed on their own with a shared zstandard dictionary.

File layout, all numbers little-endian:

    magic (8 bytes) | header length u32 | header JSON | dictionary | frames, one per document | index | keys | their lengths, u64 each

The header holds the dictionary's SHA-256 and size. The index has one entry a document, in the order of the file: frame
offset u64, frame length u32, ids u64; the keys of the documents follow it as an Arrow stream. A reader fetches the tail, the
index and the keys, then any document by one range read and one short frame; it refuses a dictionary whose hash differs. Ids are 32-bit numbers before compression.
"""

from __future__ import annotations

import hashlib
import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from parlance.llm.base import column, new_shared_file, new_shared_path, open_shared, parts_of, written
from parlance.llm.encoding import encoder

MAGIC = b"PTOKZST1"
ENTRY = np.dtype([("offset", "<u8"), ("length", "<u4"), ("ids", "<u8")])
SAMPLE_DOCS = 1_000          # documents the dictionary is trained on, about
SAMPLE_BYTES = 16 << 10      # of the ids of each, at most
DICTIONARY_BYTES = 64 << 10
LEVEL = 3


def train_dictionary(docs: DataFrame, tokenizer: str, end_id: int, key: str = "doc_id", text: str = "text") -> bytes:
    """One dictionary from a bounded sample: about ``SAMPLE_DOCS`` rows, ``SAMPLE_BYTES`` of ids of each. Empty if the sample is too
    small to train on; files then go without.

    Rows are taken by a hash of their number, below a threshold that follows from the count; they are encoded where they are
    read, so that only the bytes to train on meet in one task.
    """
    share = min(1.0, SAMPLE_DOCS / max(docs.select(key).count(), 1))
    numbered = docs.select(F.xxhash64(F.monotonically_increasing_id()).alias("r"), F.col(text).alias("text"))
    end = np.array([end_id], "<u4").tobytes()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts_of(batches, "text"):
            ids = [(x + end)[:SAMPLE_BYTES] for x in encoder(tokenizer).encode([t or "" for t in column(batch, "text").to_pylist()])]
            yield pa.RecordBatch.from_arrays([column(batch, "r"), pa.array(ids, pa.binary())], names=["r", "ids"])

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        samples = [ids for batch in batches for ids in column(batch, "ids").to_pylist()]
        try:
            made = zstandard.train_dictionary(DICTIONARY_BYTES, samples, level=LEVEL).as_bytes() if len(samples) > 7 else b""
        except zstandard.ZstdError:
            made = b""
        yield pa.RecordBatch.from_arrays([pa.array([made], pa.binary())], names=["dictionary"])

    sample = numbered.filter(F.col("r") / 2.0**63 <= 2 * share - 1).mapInArrow(encode, "r long, ids binary")
    row = sample.repartition(1).sortWithinPartitions("r").select("ids").mapInArrow(train, "dictionary binary").first()
    return bytes(row["dictionary"]) if row else b""


class Writer:
    def __init__(self, out, dictionary: bytes):
        header = json.dumps({"dictionary_sha256": hashlib.sha256(dictionary).hexdigest(), "dictionary_bytes": len(dictionary), "id_bytes": 4}).encode()
        start = MAGIC + struct.pack("<I", len(header)) + header + dictionary
        self.out, self.at, self.entries = out, len(start), []
        shared = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        if shared:
            shared.precompute_compress(level=LEVEL)  # once, not with every frame
        self.compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=shared)
        out.write(start)

    def add(self, ids: bytes) -> None:
        frame = self.compressor.compress(ids)
        self.out.write(frame)
        self.entries.append((self.at, len(frame), len(ids) // 4))
        self.at += len(frame)

    def close(self, keys: pa.Array) -> None:
        """The offset index and the documents' keys (an Arrow stream), with their lengths at the end."""
        index, named = np.array(self.entries, ENTRY).tobytes(), pa.BufferOutputStream()
        batch = pa.RecordBatch.from_arrays([keys], names=["key"])
        with pa.ipc.new_stream(named, batch.schema) as stream:
            stream.write_batch(batch)
        named = named.getvalue().to_pybytes()
        self.out.write(index + named + struct.pack("<QQ", len(index), len(named)))


class TokenFile:
    """Random access to a file of at least one document; ``source`` reads at positions (``seek``, ``read``, ``size``)."""

    def __init__(self, source, dictionary_sha256: str | None = None):
        self.source = source
        head = source.read(12)
        if head[:8] != MAGIC:
            raise ValueError("not a token file")
        header = json.loads(source.read(struct.unpack("<I", head[8:])[0]))
        dictionary = source.read(header["dictionary_bytes"])
        found = hashlib.sha256(dictionary).hexdigest()
        if found != header["dictionary_sha256"] or dictionary_sha256 not in (None, found):
            raise ValueError("the dictionary is not the one the file was written with")
        shared = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        self.decompressor = zstandard.ZstdDecompressor(dict_data=shared)
        size = source.size()
        source.seek(size - 16)
        length, named = struct.unpack("<QQ", source.read(16))
        source.seek(size - 16 - named - length)
        self.index = np.frombuffer(source.read(length), ENTRY)
        self.keys = pa.ipc.open_stream(source.read(named)).read_all().column("key").combine_chunks()
        if len(self.keys) != len(self.index):
            raise ValueError(f"{len(self.index)} documents have {len(self.keys)} keys")

    def __len__(self) -> int:
        return len(self.index)

    def document(self, i: int) -> np.ndarray:
        entry = self.index[i]
        self.source.seek(int(entry["offset"]))
        return self._ids(self.source.read(int(entry["length"])), int(entry["ids"]))

    def __iter__(self) -> Iterator[np.ndarray]:
        """All documents in order, frames read in long runs."""
        for start in range(0, len(self.index), 256):
            run = self.index[start:start + 256]
            first = int(run[0]["offset"])
            self.source.seek(first)
            data = self.source.read(int(run[-1]["offset"] + run[-1]["length"]) - first)
            for entry in run:
                at = int(entry["offset"]) - first
                yield self._ids(data[at:at + int(entry["length"])], int(entry["ids"]))

    def _ids(self, frame: bytes, n: int) -> np.ndarray:
        ids = np.frombuffer(self.decompressor.decompress(frame, max_output_size=4 * n), "<u4")
        if len(ids) != n:
            raise ValueError("a frame is not as long as the index says")
        return ids


def write_token_files(docs: DataFrame, tokenizer: str, end_id: int = 2, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Write ids of whole texts in ascending key order; returns the files in order: ``file_no, path, docs, ids``.

    Keys are dealt by range (NULL keys first, rows of one key by the hash of their text), so each task writes one file
    and the files follow each other. A file names its documents itself: their keys are beside its offset index.
    """
    spark = docs.sparkSession
    dictionary = train_dictionary(docs, tokenizer, end_id, key, text)
    folder, end = new_shared_path(spark, "tokens"), np.array([end_id], "<u4").tobytes()
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        keys, ids, part = [], 0, TaskContext.get().partitionId()
        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        with new_shared_file(folder, f"part-{part:06d}", ".ptok") as (path, out):
            writer = Writer(out, dictionary)
            for source in ([first], batches):
                for batch in parts_of(iter(source), "text", 1 << 20):
                    for x in encoder(tokenizer).encode([t or "" for t in column(batch, "text").to_pylist()]):
                        writer.add(x + end)
                        ids += len(x) // 4 + 1
                    keys.append(column(batch, "key"))
            writer.close(pa.concat_arrays(keys))
        counts = [pa.array([n], pa.int64()) for n in (len(writer.entries), ids)]
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([path]), *counts], names=["file_no", "path", "docs", "ids"])

    ordered = rows.repartitionByRange(F.col("key").asc_nulls_first()).sortWithinPartitions(F.col("key").asc_nulls_first(), F.xxhash64("text"))
    return written(ordered.mapInArrow(write, "file_no int, path string, docs long, ids long"), "token-files")


def read_token_files(files: DataFrame, key: str = "doc_id", keep_ids: bool = False, kind: str = "bigint") -> DataFrame:
    """One row per document, read back: key, ``start`` (ids of all documents before it), ``n_tokens``, ``ids_crc32`` (and
    ``ids``). A file is read by one task, a run of frames at a time. ``kind`` is the type of the keys."""
    # One row per file: few compared with the documents.
    before = Window.orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1)
    starts = files.select("file_no", "ids").withColumn("start", F.coalesce(F.sum("ids").over(before), F.lit(0))).drop("ids")
    placed = files.drop("ids").join(starts, "file_no").select("path", "docs", "start").repartition(F.col("path"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                path, at, docs = (column(batch, c)[row].as_py() for c in ("path", "start", "docs"))
                with open_shared(path) as source:
                    file = TokenFile(source)
                    keys, done, rows = file.keys, 0, []
                    if len(file) != docs:
                        raise ValueError(f"{path} has {len(file)} documents instead of {docs}")
                    for ids in file:
                        rows.append((at, len(ids), zlib.crc32(ids), ids.tobytes() if keep_ids else None))
                        at += len(ids)
                        if len(rows) == 4_096 or done + len(rows) == len(keys):
                            start, n, crc, own = zip(*rows)
                            arrays = [keys.slice(done, len(rows)), pa.array(start, pa.int64()), pa.array(n, pa.int64()), pa.array(crc, pa.int64())]
                            if keep_ids:
                                arrays.append(pa.array(own, pa.binary()))
                            yield pa.RecordBatch.from_arrays(arrays, names=["key", "start", "n_tokens", "ids_crc32", *["ids"] * keep_ids])
                            done, rows = done + len(rows), []

    schema = f"key {kind}, start long, n_tokens long, ids_crc32 long" + ", ids binary" * keep_ids
    return placed.mapInArrow(read, schema).withColumnRenamed("key", key)


def token_files_round_trip(docs: DataFrame, tokenizer: str, end_id: int = 2, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Write and read back. A NULL or empty text is the end id alone; repeated rows are documents of their own; other
    columns are ignored; an empty table writes no file and gives an empty result."""
    return read_token_files(write_token_files(docs, tokenizer, end_id, key, text), key, kind=docs.schema[key].dataType.simpleString())
