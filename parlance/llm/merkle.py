"""Merkle manifest of a dataset: a tree of digests per group of rows, and a tree over the groups.

A group may hold a third of all rows, so its tree is cut into aligned subtrees ("blocks") of ``height`` levels: the lowest
blocks hold ``arity ** (height - 1)`` leaves each, their roots are the leaves of the blocks above, and so on until one block
is left. A block is one row of a table. Inside it digests lie in van Emde Boas order: a tree of h levels is split at half
height, the top tree comes first, then the bottom trees one after the other, each laid out in the same way. A node's place
follows by arithmetic from its depth and index, whatever the size of a cache line or page; the children of a node are next to
each other, so the siblings of a leaf are a few short runs.

Building goes up level by level, each written to the shared folder. Proofs come down: a block hands each of its children the
path from there to the root, so nothing but a block and one path is needed to prove all leaves of a block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from parlance.llm.base import column, written

DIGEST = 32
PATH = "path array<struct<before:string,after:string>>"


@dataclass(frozen=True)
class Shape:
    arity: int = 16
    height: int = 4   # levels of a block

    @property
    def span(self) -> int:
        """Leaves of a full block."""
        return self.arity ** (self.height - 1)

    def levels(self, n: int, whole: bool) -> int:
        """Levels of a block of n leaves: all if it is one of several, else as many as its leaves need."""
        if whole:
            return self.height
        levels = 1
        while self.arity ** (levels - 1) < n:
            levels += 1
        return levels


def _size(levels: int, arity: int) -> int:
    return (arity**levels - 1) // (arity - 1)


def address(levels: int, depth: int, index: np.ndarray, arity: int = 16) -> np.ndarray:
    """Places of the nodes ``index`` at ``depth`` (the root's is 0) in a tree of ``levels`` levels."""
    if levels == 1:
        return np.zeros_like(index)
    top = levels // 2
    if depth < top:
        return address(top, depth, index, arity)
    tree, inside = np.divmod(index, arity ** (depth - top))
    return _size(top, arity) + tree * _size(levels - top, arity) + address(levels - top, depth - top, inside, arity)


@cache
def _places(levels: int, depth: int, arity: int) -> np.ndarray:
    return address(levels, depth, np.arange(arity**depth), arity)


def _h(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def build_block(leaves: np.ndarray, levels: int, arity: int) -> np.ndarray:
    """Digests (rows of 32 bytes) of a block in their places, up to the last one that is used."""
    used = []
    n = len(leaves)
    for depth in range(levels - 1, -1, -1):
        used.append(_places(levels, depth, arity)[:n])
        n = -(-n // arity)
    nodes = np.zeros((max(int(p.max()) for p in used) + 1, DIGEST), np.uint8)
    nodes[used[0]] = leaves
    for children, parents in zip(used, used[1:]):
        text = nodes[children].tobytes().hex()
        run = 2 * DIGEST * arity
        made = b"".join(hashlib.sha256(text[i:i + run].encode()).digest() for i in range(0, len(text), run))
        nodes[parents] = np.frombuffer(made, np.uint8).reshape(-1, DIGEST)
    return nodes


def level_texts(nodes: np.ndarray, n: int, levels: int, arity: int) -> list[str]:
    """The digests of each level below the block's root as one hex text, leaves first."""
    out = []
    for depth in range(levels - 1, 0, -1):
        out.append(nodes[_places(levels, depth, arity)[:n]].tobytes().hex())
        n = -(-n // arity)
    return out


def siblings(texts: list[str], i: int, arity: int) -> Iterator[tuple[str, str]]:
    """What stands before and after the node in its run, from leaf i up to the block's root."""
    w = 2 * DIGEST
    for text in texts:
        first = i // arity * arity * w
        yield text[first:i * w], text[(i + 1) * w:first + arity * w]
        i //= arity


def encoded(columns: list[Column]) -> Column:
    """Each value as its length in bytes, a colon and the value; NULL is a hyphen. No two different rows give the same text."""
    texts = [c.cast("string") for c in columns]
    return F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts])


def ranked(df: DataFrame, group: str, order: list[str]) -> DataFrame:
    """``df`` with ``at``, the position of a row in its group, from 0; ``group`` must not be NULL.

    One range shuffle over the whole table: a large group is many partitions. What comes before a group's rows in a partition
    is a sum over the partitions it lies in. Rows that are equal in all of ``order`` keep the order of the files read.
    """
    rows = written(df.withColumn("__tie", F.monotonically_increasing_id()), "leaves")
    keys = [group, *order, "__tie"]
    dealt = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("__row", F.monotonically_increasing_id())
    dealt = written(dealt.withColumn("__part", F.shiftright("__row", 33)).drop("__tie"), "sorted-leaves")
    parts = dealt.groupBy("__part", group).agg(F.min("__row").alias("__first"), F.count("*").alias("__n"))
    earlier = Window.partitionBy(group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("__part", group, (F.coalesce(F.sum("__n").over(earlier), F.lit(0)) - F.col("__first")).alias("__add"))
    return dealt.join(parts, ["__part", group]).withColumn("at", F.col("__row") + F.col("__add")).drop("__part", "__row", "__add")


def _built(blocks: DataFrame, shape: Shape) -> DataFrame:
    """``g, b, digests`` (of the leaves in order) and other columns -> the same with ``nodes, root`` for ``digests``, and ``n``."""
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                leaves = np.frombuffer(b"".join(column(row, "digests")[0].values.to_pylist()), np.uint8).reshape(-1, DIGEST)
                whole = column(row, "b")[0].as_py() > 0 or len(leaves) == shape.span
                nodes = build_block(leaves, shape.levels(len(leaves), whole), shape.arity)
                arrays = {name: column(row, name) for name in row.schema.names if name != "digests"}
                arrays |= {"n": pa.array([len(leaves)], pa.int32()), "nodes": pa.array([nodes.tobytes()]), "root": pa.array([nodes[0].tobytes()])}
                yield pa.RecordBatch.from_arrays(list(arrays.values()), names=list(arrays))

    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in blocks.schema if f.name != "digests")
    return blocks.mapInArrow(build, f"{kept}, n int, nodes binary, root binary")


def _tree(first: DataFrame, shape: Shape) -> list[DataFrame]:
    """Levels of blocks from the lowest (``first``: ``g, b, digests, ...``) to that with one block for each group."""
    levels = [written(_built(first, shape), "merkle-level")]
    while (levels[-1].agg(F.max("b").alias("b")).first()["b"] or 0) > 0:
        rows = levels[-1].select("g", F.floor(F.col("b") / shape.span).alias("up"), F.struct("b", "root").alias("x"))
        blocks = rows.groupBy("g", F.col("up").alias("b")).agg(F.sort_array(F.collect_list("x"))["root"].alias("digests"))
        levels.append(written(_built(blocks, shape), "merkle-level"))
    return levels


def _paths_below(blocks: DataFrame, above: DataFrame, shape: Shape, carried: str) -> DataFrame:
    """``above``: ``g, b, path`` and carried columns of each block -> the same for each of its leaves, whose number is ``b``."""
    names = [c.split()[0] for c in carried.split(", ")]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                nodes = np.frombuffer(row["nodes"], np.uint8).reshape(-1, DIGEST)
                levels = shape.levels(row["n"], row["b"] > 0 or row["n"] == shape.span)
                texts, up = level_texts(nodes, row["n"], levels, shape.arity), [(p["before"], p["after"]) for p in row["path"]]
                for start in range(0, row["n"], 256):
                    found = [[*siblings(texts, i, shape.arity), *up] for i in range(start, min(row["n"], start + 256))]
                    out = [{"g": row["g"], "b": row["b"] * shape.span + start + i, "path": [{"before": x, "after": y} for x, y in path],
                            **{c: row[c] for c in names}} for i, path in enumerate(found)]
                    yield pa.RecordBatch.from_pylist(out, schema=pa.schema([
                        ("g", pa.string()), ("b", pa.int64()), ("path", pa.list_(pa.struct([("before", pa.string()), ("after", pa.string())]))),
                        *[(c, pa.binary()) for c in names]]))

    joined = blocks.select("g", "b", "n", "nodes").join(above, ["g", "b"])
    return joined.mapInArrow(walk, f"g string, b long, {PATH}, {carried}")


def manifest(docs: DataFrame, columns: list[str], group: str = "source", key: str = "doc_id", seen: dict[str, Column] | None = None,
             shape: Shape = Shape()) -> DataFrame:
    """``key, leaf, subroot, root, proof_sha256, folded_root, verified`` for each row of ``docs``.

    A leaf is the digest of the row's ``columns``; the leaves of a ``group`` ascend by ``key`` (NULL first, equal keys by digest) and
    their tree's root is ``subroot``; the subroots in the order of the group (NULL first, by bytes) are the leaves of the tree of
    ``root``. ``proof_sha256`` is the digest of all siblings on the way to the root. ``seen`` says how columns read at a later time:
    ``folded_root`` is what the row as seen and the original siblings lead to, and ``verified`` whether that is the root.

    Repeated rows are leaves of their own with different proofs; which of two equal rows comes first makes no difference to any
    digest of the trees. NULL in any column, also the group, is a value of its own. Other columns are ignored. An empty table
    gives an empty result. A task holds one block (4,096 rows' digests); texts are only read by the first, narrow step.
    """
    before = encoded([F.col(c) for c in columns])
    after = encoded([(seen or {}).get(c, F.col(c)) for c in columns])
    digest = lambda text: F.unhex(F.sha2(text.cast("binary"), 256))
    # The group as a text that isn't NULL and has the same order.
    rows = docs.select(F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("")).alias("g"), F.col(key).alias("k"),
                       digest(before).alias("leaf"), (digest(after) if seen else F.lit(None).cast("binary")).alias("seen"))
    rows = rows.withColumn("seen", F.when(F.col("seen") != F.col("leaf"), F.col("seen")))
    placed = ranked(rows, "g", ["k", "leaf"])
    entries = F.sort_array(F.collect_list(F.struct("at", "k", "leaf", "seen"))).alias("e")
    blocks = placed.groupBy("g", F.floor(F.col("at") / shape.span).alias("b")).agg(entries)
    first = blocks.select("g", "b", F.col("e.k").alias("keys"), F.col("e.seen").alias("seen"), F.col("e.leaf").alias("digests"))
    levels = _tree(first.withColumn("leaves", F.col("digests")), shape)

    roots = ranked(levels[-1].select(F.lit("").alias("all"), "g", "root"), "all", ["g"])
    roots = written(roots.select("g", "at", "root"), "subroots")
    tops = roots.groupBy(F.lit("").alias("g"), F.floor(F.col("at") / shape.span).alias("b")).agg(
        F.sort_array(F.collect_list(F.struct("at", "root")))["root"].alias("digests"))
    upper = _tree(tops, shape)

    start = F.array().cast(PATH.split(" ", 1)[1]).alias("path")
    above = upper[-1].select("g", "b", start, F.col("root").alias("top"))
    for level in reversed(upper):
        above = written(_paths_below(level, above, shape, "top binary"), "paths")
    above = roots.join(above.select(F.col("b").alias("at"), "path", "top"), "at").select("g", F.lit(0).cast("long").alias("b"), "path", F.col("root").alias("sub"), "top")
    for level in reversed(levels[1:]):
        above = written(_paths_below(level, above, shape, "sub binary, top binary"), "paths")
    return _proofs(levels[0].join(above, ["g", "b"]), docs.schema[key].dataType.simpleString(), key, shape)


def _proofs(blocks: DataFrame, kind: str, key: str, shape: Shape) -> DataFrame:
    def prove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                row = batch.slice(r, 1)
                one = {c: column(row, c)[0].as_py() for c in ("b", "n", "nodes", "path", "sub", "top")}
                leaves, seen, n = column(row, "leaves")[0].values.to_pylist(), column(row, "seen")[0].values.to_pylist(), one["n"]
                nodes = np.frombuffer(one["nodes"], np.uint8).reshape(-1, DIGEST)
                texts = level_texts(nodes, n, shape.levels(n, one["b"] > 0 or n == shape.span), shape.arity)
                up = [(p["before"], p["after"]) for p in one["path"]]
                rest, top = "".join(x + y for x, y in up), one["top"].hex()
                proofs, folded = [], []
                for i in range(n):
                    now, inside = (seen[i] or leaves[i]).hex(), list(siblings(texts, i, shape.arity))
                    proofs.append(_h("".join(x + y for x, y in inside) + rest))
                    for x, y in (*inside, *up):
                        now = _h(x + now + y)
                    folded.append(now)
                yield pa.RecordBatch.from_arrays([
                    column(row, "keys")[0].values, pa.array([x.hex() for x in leaves]), pa.array([one["sub"].hex()] * n), pa.array([top] * n),
                    pa.array(proofs), pa.array(folded), pa.array([x == top for x in folded])], names=names)

    names = [key, "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return blocks.mapInArrow(prove, f"`{key}` {kind}, " + ", ".join(f"{c} string" for c in names[1:-1]) + ", verified boolean")
