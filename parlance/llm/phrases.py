"""Document fingerprints from Lempel-Ziv phrases.

A text is parsed into phrases, each the shortest run of bytes not seen as a phrase before (the dictionary grows by it). The
set of phrases is what a compressor would learn from the text; the share of phrases two texts have in common is a
likeness in the sense of compression. The fingerprint holds, for each of ``SLOTS`` hash functions, the smallest hash over
the phrase set (16 bits of it); the share of equal slots estimates that likeness.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.llm.base import column, parts_of, written

SLOTS = 128
_U = np.uint64
_R = np.random.default_rng(20_240_229)
BYTE = _R.integers(1, 1 << 63, 256, dtype=np.uint64)                     # a random number for each byte
FACTOR = int(_R.integers(1 << 32, 1 << 62)) * 2 + 1
INVERSE = pow(FACTOR, -1, 1 << 64)
ODD = _R.integers(1, 1 << 63, SLOTS, dtype=np.uint64) * _U(2) + _U(1)
SHIFT = _R.integers(0, 1 << 63, SLOTS, dtype=np.uint64)


def parse(data: bytes, ends: list[int], phrases: set[bytes], start: int = 0, stop: int | None = None) -> int:
    """Go on parsing at ``start``: add the ends of new phrases that end within ``stop``; returns where the next begins.

    Every prefix of a phrase is a phrase, so the longest known run can be met from a guess, here the last length.
    """
    size = len(data) if stop is None else stop
    add, put, length = phrases.add, ends.append, 1
    while start < size:
        end = start + length
        if end > size:
            end = size
        if data[start:end] in phrases:
            end += 1
            while end <= size and data[start:end] in phrases:
                end += 1
            if end > size:
                return start
        else:
            end -= 1
            while end > start and data[start:end] not in phrases:
                end -= 1
            end += 1
        add(data[start:end])
        put(end)
        length = end - start
        start = end
    return start


def phrase_hashes(data: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the phrases between starts and ends: polynomials in random byte values, as differences of running sums."""
    if not len(ends):
        return np.zeros(0, _U)
    first, last = int(starts[0]), int(ends[-1])
    sums = np.zeros(last - first + 1, _U)
    np.cumsum(BYTE[np.frombuffer(data, np.uint8)[first:last]] * _geometric(FACTOR, last - first)[:last - first], out=sums[1:])
    x = (sums[ends - first] - sums[starts - first]) * _geometric(INVERSE, last - first)[starts - first] + (ends - starts).astype(_U)
    x = (x ^ (x >> _U(31))) * _U(0x9E3779B97F4A7C15)
    x = (x ^ (x >> _U(29))) * _U(0xBF58476D1CE4E5B9)
    return x ^ (x >> _U(32))


_POWERS: dict[int, np.ndarray] = {}


def _geometric(base: int, n: int) -> np.ndarray:
    """base ** 0 to base ** (n - 1) modulo 2 ** 64; tables are kept in steps of doubled size."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = 1 << max(16, (n - 1).bit_length())
        have = np.ones(1, _U)
        while len(have) < size:
            have = np.concatenate([have, have * _U(pow(base, len(have), 1 << 64))])
        if size <= 1 << 22:
            _POWERS[base] = have
    return have


def least_hashes(data: bytes, start: int, ends: list[int], rest: int) -> np.ndarray:
    """Smallest hash of each slot over the phrases from ``start`` on; bytes from ``rest`` on are a phrase of their own."""
    last = np.array([*ends, len(data)] if rest < len(data) else ends, np.int64)
    hashes = phrase_hashes(data, np.concatenate([[start], last[:-1]]).astype(np.int64), last)
    least = np.full(SLOTS, ~_U(0))
    for at in range(0, len(hashes), 4_096):
        some = hashes[at:at + 4_096]
        np.minimum(least, (some[None, :] * ODD[:, None] + SHIFT[:, None]).min(axis=1), out=least)
    return least


def signature(least: np.ndarray) -> np.ndarray:
    """16 bits of each slot's smallest hash; equal for all texts without phrases."""
    return (least >> _U(16)).astype("<u2")


def fingerprint(text: str | None) -> np.ndarray:
    data = (text or "").encode()
    ends: list[int] = []
    return signature(least_hashes(data, 0, ends, parse(data, ends, set())))


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of equal slots, 0 to 1."""
    return float(np.mean(a == b))


def edited(text: str, following: str) -> tuple[str, int]:
    """The text with its last quarter (floor of code points / 4) replaced by the start of the following text; the length
    of what is unchanged."""
    quarter = len(text) // 4
    return text[:len(text) - quarter] + following[:quarter], len(text) - quarter


def fingerprints_with_edit(text: str, following: str) -> tuple[np.ndarray, np.ndarray, bytes]:
    """Fingerprints of a text and of its edited form, and the latter's bytes. Their common start is parsed once."""
    data = text.encode()
    new, kept = edited(text, following)
    new, common = new.encode(), len(text[:kept].encode())
    ends: list[int] = []
    phrases: set[bytes] = set()
    at = parse(data, ends, phrases, 0, common)
    shared = least_hashes(data[:at], 0, ends, at)

    def whole(text: bytes, phrases: set[bytes]) -> np.ndarray:
        more: list[int] = []
        rest = parse(text, more, phrases, at)
        return signature(np.minimum(shared, least_hashes(text, at, more, rest)))

    if new == data:
        own = whole(data, phrases)
        return own, own, new
    return whole(data, set(phrases)), whole(new, phrases), new


RESULT = ["key", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]


def _row(key, text: str, following: str) -> tuple[tuple, np.ndarray]:
    """A result row without its last value, and the text's fingerprint."""
    own, changed, new = fingerprints_with_edit(text, following)
    return (key, len(text), hashlib.sha256(new).digest(), own.tobytes(), changed.tobytes(), likeness(own, changed)), own


def edit_fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprint each text and the text edited with the document that follows in key order (the first follows the last).

    Documents are dealt by key range once and read in order; a task lacks only the document after its last one. For
    that, it puts its first and last text beside its results, and these few rows (two a task) are joined. A NULL text
    is empty; an empty text has no phrases, and such texts are alike (1.0) to each other. NULL keys come first, rows of one
    key are ordered by the hash of their text. A single document follows itself. Extra columns are ignored; an empty table
    gives an empty result.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    kind = rows.schema["key"].dataType
    out_kind = f"key {kind.simpleString()}, n_chars long, edited_sha256 binary, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, first, last, last_key, kind = TaskContext.get().partitionId(), None, None, None, None
        waiting = None  # the row before, which lacks the next fingerprint, and its own
        for batch in parts_of(batches, "text", 1 << 20):
            done, kind = [], column(batch, "key").type
            for k, t in zip(column(batch, "key").to_pylist(), column(batch, "text").to_pylist()):
                if last is None:
                    first = t
                else:
                    row, own = _row(last_key, last, t)
                    if waiting:
                        done.append((*waiting[0], likeness(waiting[1], own), None, None, None))
                    waiting = row, own
                last_key, last = k, t
            if done:
                yield _batch(done, kind)
        if waiting:
            yield _batch([(*waiting[0], likeness(waiting[1], fingerprint(last)), None, None, None)], kind)
        if last is not None:
            yield _batch([(last_key, None, None, None, None, None, None, part, first, last)], kind)

    def _batch(done: list[tuple], key_type: pa.DataType) -> pa.RecordBatch:
        kinds = [key_type, pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.float64(), pa.float64(), pa.int32(), pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), kinds)], names=[*RESULT, "part", "first", "last"])

    by_key = F.col("key").asc_nulls_first()
    ordered = rows.repartitionByRange(by_key).sortWithinPartitions(by_key, F.xxhash64("text"))
    seen = written(ordered.mapInArrow(scan, f"{out_kind}, part int, first string, last string"), "phrases")
    edges = seen.filter("last IS NOT NULL")
    # Numbers of the tasks that had rows: as many as tasks.
    parts = sorted(r["part"] for r in edges.select("part").collect())
    if not parts:
        return _readable(seen, key)
    after = spark.createDataFrame(list(zip(parts, [*parts[1:], parts[0]])), "part int, after int")
    following = edges.select(F.col("part").alias("after"), F.col("first").alias("following"))
    open_rows = edges.select("key", "last", "part").join(after, "part").join(following, "after").select("key", "last", "following")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = []
            for k, t, f in zip(*(column(batch, c).to_pylist() for c in ("key", "last", "following"))):
                row, own = _row(k, t, f)
                done.append((*row, likeness(own, fingerprint(f)), None, None, None))
            if done:
                yield _batch(done, column(batch, "key").type).select(RESULT)

    closed = open_rows.mapInArrow(finish, out_kind)
    return _readable(seen.filter("last IS NULL").select(*RESULT).union(closed), key)


def _readable(rows: DataFrame, key: str) -> DataFrame:
    """Hashes and fingerprints, bytes until here, as lower-case hex."""
    hexed = {c: F.lower(F.hex(c)) for c in ("edited_sha256", "fingerprint", "edited_fingerprint")}
    return rows.select(*RESULT).withColumns(hexed).withColumnRenamed("key", key)
