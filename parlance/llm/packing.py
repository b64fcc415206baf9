"""Best-fit packing of token pieces into sequences by minimum bin slack.

All that decides a packing is how many pieces there are of each length, and there are at most ``capacity`` lengths. So:
count pieces per length (distributed), plan bins on these counts (driver, bounded by the capacity whatever the input), and
let each piece find its place from its rank among the pieces of its length (distributed). A bin takes the longest piece
left and the subset of the others that fills it best, found by subset sums in a bitset; that bin is repeated while
its lengths last.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from parlance.llm.base import column, parts_of, written
from parlance.llm.encoding import encoder

RANKED_TOGETHER = 50_000


def cut_points(n: int, capacity: int) -> list[int]:
    """Ends of the pieces of n ids: whole capacities from the end, so that only the first piece is shorter."""
    return [*range(n % capacity or capacity, n, capacity), n] if n else []


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 2, key: str = "doc_id",
                 text: str = "text", keep_ids: bool = False) -> DataFrame:
    """Whole texts as ids with the end id, cut where longer than ``capacity``: key, piece, start, length, ids_crc32."""
    end = np.array([end_id], dtype="<u4").tobytes()
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    schema = f"key {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer).encode
        for batch in parts_of(batches, "text", 1 << 20):
            ids = [x + end for x in encode([t or "" for t in column(batch, "text").to_pylist()])]
            row, piece, start, length, crc, kept = [], [], [], [], [], []
            for i, x in enumerate(ids):
                at = 0
                for j, stop in enumerate(cut_points(len(x) // 4, capacity)):
                    part = x[4 * at:4 * stop]
                    row.append(i)
                    piece.append(j)
                    start.append(at)
                    length.append(stop - at)
                    crc.append(zlib.crc32(part))
                    kept.append(part if keep_ids else None)
                    at = stop
            arrays = [column(batch, "key").take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                      pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            names = ["key", "piece", "start", "length", "ids_crc32"]
            if keep_ids:
                arrays.append(pa.array(kept, pa.binary()))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return rows.mapInArrow(emit, schema)


def fullest(left: Counter, room: int) -> list[int]:
    """A multiset of available lengths with the largest sum of at most ``room``. Long lengths are tried first."""
    reach, target = 1, 1 << room
    layers = []
    for length in sorted((x for x in left if x <= room), reverse=True):
        for _ in range(min(left[length], room // length)):
            more = reach | (reach << length) & (2 * target - 1)
            if more == reach:
                break
            layers.append((length, reach))
            reach = more
            if reach & target:
                break
        if reach & target:
            break
    total, out = reach.bit_length() - 1, []
    for length, before in reversed(layers):
        if not before >> total & 1:
            out.append(length)
            total -= length
    return out


def plan_bins(counts: dict[int, int], capacity: int) -> list[tuple[list[int], int]]:
    """``(lengths, times)`` of bins that use up the counts."""
    left, bins = Counter({x: n for x, n in counts.items() if n}), []
    while left:
        longest = max(left)
        left[longest] -= 1
        chosen = [longest, *fullest(+left, capacity - longest)]
        left[longest] += 1
        use = Counter(chosen)
        times = min(left[x] // n for x, n in use.items())
        for x, n in use.items():
            left[x] -= n * times
            if not left[x]:
                del left[x]
        bins.append((sorted(chosen, reverse=True), times))
    return bins


class Places:
    """Where the r-th piece of a length goes. Ranks of all lengths lie on one line, cut into the shares of the bins."""

    def __init__(self, counts: dict[int, int], bins: list[tuple[list[int], int]]):
        self.first, at = {}, 0
        for length in sorted(counts):
            self.first[length] = at
            at += counts[length]
        taken, shares, sequence = dict(self.first), [], 0
        for lengths, times in bins:
            offsets, at = {}, 0
            for x in lengths:
                offsets.setdefault(x, []).append(at)
                at += x
            for x, own in offsets.items():
                shares.append((taken[x], sequence, own))
                taken[x] += times * len(own)
            sequence += times
        shares.sort(key=lambda s: s[0])
        self.starts = np.array([s[0] for s in shares], dtype=np.int64)
        self.sequence = np.array([s[1] for s in shares], dtype=np.int64)
        self.per_bin = np.array([len(s[2]) for s in shares], dtype=np.int64)
        self.own = np.concatenate([[0], np.cumsum(self.per_bin)])
        self.offsets = np.array([o for s in shares for o in s[2]], dtype=np.int64)

    def find(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        lengths = np.array(sorted(self.first))
        at = np.array([self.first[x] for x in lengths.tolist()])[np.searchsorted(lengths, length)] + rank
        share = np.searchsorted(self.starts, at, "right") - 1
        inside = at - self.starts[share]
        per = self.per_bin[share]
        return self.sequence[share] + inside // per, self.offsets[self.own[share] + inside % per]


def ranked(pieces: DataFrame) -> DataFrame:
    """Add ``rank``: 0, 1, ... within each length. Pieces of one length are split by hash, so none is ranked in one task;
    what comes before a split is the sum of a few counts."""
    splits = max(1, -(-pieces.count() // RANKED_TOGETHER))
    rows = pieces.withColumn("split", F.pmod(F.xxhash64("key", "piece", "ids_crc32"), F.lit(splits)))
    counts = rows.groupBy("length", "split").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("length", "split", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("length", "split").orderBy("key", "piece", "start", "ids_crc32"))
    return rows.withColumn("rank", inside - 1).join(counts, ["length", "split"]).withColumn(
        "rank", F.col("rank") + F.col("before")).drop("split", "before")


def pack(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 2, key: str = "doc_id", text: str = "text",
         keep_ids: bool = False) -> DataFrame:
    """One row per piece: key, piece, start, length, ids_crc32, sequence_id, offset (and ``ids`` with ``keep_ids``).

    A NULL or empty text is the end id alone. Repeated rows and NULL keys are packed as documents of their own. Columns
    other than key and text are ignored; an empty table gives an empty result.
    """
    pieces = written(token_pieces(docs, tokenizer, capacity, end_id, key, text, keep_ids), "pieces")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    places = Places(counts, plan_bins(counts, capacity))
    rows = ranked(pieces)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema.fields) + ", sequence_id long, offset long"
    names = [*pieces.columns, "sequence_id", "offset"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sequence, offset = places.find(np.asarray(column(batch, "length")), np.asarray(column(batch, "rank")))
            yield pa.RecordBatch.from_arrays(
                [*[column(batch, n) for n in pieces_columns], pa.array(sequence), pa.array(offset)], names=names)

    pieces_columns = pieces.columns
    return rows.mapInArrow(place, schema).withColumnRenamed("key", key)


def assemble(packed: DataFrame) -> DataFrame:
    """``sequence_id, length, ids`` of pieces packed with ``keep_ids``: at most ``capacity`` ids a row, without gaps."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.sum("length").alias("length"), parts.alias("parts")).select(
        "sequence_id", "length", F.aggregate("parts", F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("ids"))
