"""Line dedup against a sharded minimal perfect hash.

1. The distinct line keys of every document are counted over all documents (added up before the shuffle).
2. Keys found in enough documents are dealt into shards by hash; each shard becomes a minimal perfect hash with an array
   of fingerprints and one of counts. Keys that can never reach the threshold take no room.
3. Documents probe the arrays: a task visits the shards its lines hash to and opens each from the shared folder, so lines
   are never joined with counts. Fingerprints are the 64 bits of the key's hash that don't choose the place.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.llm.base import column, new_shared_path, parts_of, read_shared_table, with_columns

STRIPPED = b" \t\n\r\x0b\x0c"
KEYS_PER_SHARD = 131_072
GAMMA = 2.0
MOST_LEVELS = 64
_U = np.uint64


def line_key(line: bytes) -> bytes:
    """ASCII white space stripped at both ends, A-Z in lower case."""
    return line.strip(STRIPPED).lower()


def _code_points(key: bytes) -> int:
    return len(key) if key.isascii() else len(key.decode())


def key_hash(key: bytes) -> bytes:
    return xxhash.xxh3_128_digest(key)


def _mixed(hi: np.ndarray, lo: np.ndarray, level: int) -> np.ndarray:
    x = hi ^ (lo * _U(0x9E3779B97F4A7C15)) ^ _U((level + 1) * 0xD6E8FEB86659FD93 & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> _U(29))) * _U(0xBF58476D1CE4E5B9)
    return x ^ (x >> _U(32))


class PerfectHash:
    """Minimal perfect hash in levels of bits: a key lives in the first level where no other remaining key meets it.

    Its number is the count of bits set before its own, so n keys get the numbers 0 to n - 1.
    """

    def __init__(self, sizes: list[int], bits: np.ndarray):
        self.sizes, self.bits = sizes, bits
        self.words = np.unpackbits(bits, bitorder="little")
        self.rank = np.concatenate([[0], np.cumsum(self.words, dtype=np.int64)])

    @classmethod
    def build(cls, hi: np.ndarray, lo: np.ndarray) -> PerfectHash:
        sizes, levels = [], []
        while len(hi):
            if len(sizes) == MOST_LEVELS:
                raise ValueError("keys of a perfect hash must be distinct")
            size = max(64, int(GAMMA * len(hi)) // 64 * 64 + 64)
            at = (_mixed(hi, lo, len(sizes)) % _U(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            sizes.append(size)
            levels.append(alone)
            left = ~alone[at]
            hi, lo = hi[left], lo[left]
        bits = np.packbits(np.concatenate(levels), bitorder="little") if levels else np.zeros(0, np.uint8)
        return cls(sizes, bits)

    def number(self, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        """The key's number; -1 or any number for keys outside the set."""
        out = np.full(len(hi), -1, np.int64)
        left, base = np.arange(len(hi)), 0
        for level, size in enumerate(self.sizes):
            at = base + (_mixed(hi[left], lo[left], level) % _U(size)).astype(np.int64)
            here = self.words[at] == 1
            out[left[here]] = self.rank[at[here]]
            left, base = left[~here], base + size
        return out


def _hashes(keys: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(b"".join(map(key_hash, keys)), dtype="<u8").reshape(-1, 2)
    return both[:, 0].copy(), both[:, 1].copy()


def line_counts(docs: DataFrame, text: str = "text", min_chars: int = 1) -> DataFrame:
    """``hi, lo, n``: for each line key of at least ``min_chars`` code points, the number of documents that have it."""
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts_of(batches, "text"):
            found: list[bytes] = []
            for value in column(batch, "text").to_pylist():
                keys = {line_key(x) for x in (value or "").encode().split(b"\n")}
                found += [k for k in keys if _code_points(k) >= min_chars]
            hi, lo = _hashes(found)
            yield pa.RecordBatch.from_arrays([pa.array(hi.view(np.int64)), pa.array(lo.view(np.int64))], names=["hi", "lo"])

    rows = docs.select(F.col(text).alias("text")).mapInArrow(emit, "hi long, lo long")
    return rows.groupBy("hi", "lo").agg(F.count("*").alias("n"))


def build_line_index(docs: DataFrame, text: str = "text", min_docs: int = 10, min_chars: int = 1,
                     keys_per_shard: int = KEYS_PER_SHARD) -> tuple[str, int]:
    """Write the index of all keys found in at least ``min_docs`` documents; returns its folder and number of shards.

    The number of shards follows the number of keys, so a shard stays small. Spark writes the shards as Parquet, one
    folder each, under the folder that all executors share.
    """
    spark = docs.sparkSession
    folder = new_shared_path(spark, "line-index")
    counts = line_counts(docs, text, min_chars).filter(F.col("n") >= min_docs)
    counts.write.parquet(f"{folder}/keys")
    keys = spark.read.parquet(f"{folder}/keys")
    shards = max(1, -(-keys.count() // keys_per_shard))

    def build(group: pa.Table) -> pa.Table:
        hi, lo = (np.asarray(group.column(c)).astype(np.int64).view(_U) for c in ("hi", "lo"))
        n = np.minimum(np.asarray(group.column("n")), 0xFFFFFFFF).astype("<u4")
        made = PerfectHash.build(hi, lo)
        number = made.number(hi, lo)
        prints, counts = np.zeros(len(hi), "<u8"), np.zeros(len(hi), "<u4")
        prints[number], counts[number] = lo, n
        return pa.table({
            "shard": pa.array([group.column("shard")[0].as_py()], pa.int32()), "sizes": pa.array([made.sizes], pa.list_(pa.int64())),
            "bits": pa.array([made.bits.tobytes()], pa.binary()), "prints": pa.array([prints.tobytes()], pa.binary()),
            "counts": pa.array([counts.tobytes()], pa.binary())})

    dealt = keys.withColumn("shard", F.pmod("hi", F.lit(shards)).cast("int"))
    index = dealt.groupBy("shard").applyInArrow(build, "shard int, sizes array<long>, bits binary, prints binary, counts binary")
    index.withColumn("part", F.col("shard")).write.partitionBy("part").parquet(f"{folder}/shards")
    return folder, shards


@functools.lru_cache(maxsize=32)
def _shard(folder: str, shard: int):
    """A shard as arrays; NULL if no key fell into it. Workers keep the last 32, about 4 MB each."""
    try:
        got = read_shared_table(f"{folder}/shards/part={shard}")
    except FileNotFoundError:
        return None
    row = got.to_pylist()[0]
    made = PerfectHash(row["sizes"], np.frombuffer(row["bits"], np.uint8))
    return made, np.frombuffer(row["prints"], "<u8"), np.frombuffer(row["counts"], "<u4")


def counts_of(folder: str, shards: int, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
    """Document count of each key; 0 for keys that aren't in the index. One shard at a time."""
    out = np.zeros(len(hi), np.int64)
    # Spark's pmod of the signed value.
    where = hi.view(np.int64) % shards
    for shard in np.unique(where).tolist():
        got = _shard(folder, shard)
        if got is None:
            continue
        made, prints, counts = got
        at = np.flatnonzero(where == shard)
        number = made.number(hi[at], lo[at])
        hit = (number >= 0) & (prints[np.maximum(number, 0)] == lo[at])
        out[at[hit]] = counts[number[hit]]
    return out


def drop_common_lines(docs: DataFrame, text: str = "text", min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """Rewrite ``text`` without the lines whose key is found in at least ``min_docs`` rows of ``docs``.

    Adds ``n_lines`` (before) and ``n_dropped``; columns of these names are replaced, other extra columns pass through.
    Lines end at \\n only. A NULL or empty text is one empty line: it stays, as the empty text, since its key has no code
    point (with ``min_chars`` 0 empty lines can be dropped too). Repeated rows count as documents of their own. An empty
    table gives an empty result.
    """
    folder, shards = build_line_index(docs, text, min_docs, min_chars)
    schema = docs.withColumns({"n_lines": F.lit(0).cast("long"), "n_dropped": F.lit(0).cast("long")}).schema

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts_of(batches, text):
            lines = [(x or "").encode().split(b"\n") for x in column(batch, text).to_pylist()]
            keys = [line_key(x) for doc in lines for x in doc]
            common = counts_of(folder, shards, *_hashes(keys)) >= min_docs
            if min_chars > 0:
                common &= np.fromiter((_code_points(k) >= min_chars for k in keys), bool, len(keys))
            flags, at = common.tolist(), 0
            texts, dropped = [], []
            for doc in lines:
                own = flags[at:at + len(doc)]
                at += len(doc)
                texts.append(b"\n".join(x for x, gone in zip(doc, own) if not gone) if any(own) else b"\n".join(doc))
                dropped.append(sum(own))
            yield with_columns(batch, {
                text: pa.array(texts, pa.binary()).cast(pa.string()), "n_lines": pa.array([len(x) for x in lines], pa.int64()),
                "n_dropped": pa.array(dropped, pa.int64())})

    return docs.mapInArrow(clean, schema)
