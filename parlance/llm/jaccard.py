"""N-gram Jaccard join by vertical partitioning.

Documents are sets of word shingles ("grams"). The gram order is cut into fragments; what two documents share is counted
per fragment and summed per pair, exactly. Equal sets are one class throughout, so copies never meet each other.

*Thinning.* A document that links with another shares all but floor(25 %) of its grams with it. A first pass looks at the
first ``probe`` fragments of the hash order only: a class with more than that many grams found in no other class has no
partner. Grams that are common in a bounded sample of documents are known to be shared and are never shuffled, so no gram
is hot. What is left (the near copies, a few percent) is counted in full and thinned again.

*Candidates without all pairs.* The remaining grams are ordered from rare to frequent; documents that link share a gram
of their prefixes. Within the group of a gram only one document, its leader, is compared with the others (the leader comes
first in one fixed order, the most central documents first). For two members x and y that are not both linked with
leader o (then they are in one component already), what they share inside o is at most |x & o| for an unlinked x. So
either they share a gram outside o - they meet again in the much smaller group (o, gram) - or y is smaller than o, and both
share at least 75 % of their grams with o - they meet in the group (o, rest). Groups within one component are done. Groups are cut by size, and members that have
too few grams in common with anyone to link with any size in the group leave it. What the first leaders leave is compared in
blocks of about ``BLOCK_SETS`` sets, fragment by fragment, without pairs as rows, as soon as that repeats a row ``REPEATS`` times at
most on average; until then groups get new leaders, later in the order each time, so this ends. No link between components is lost.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from parlance.llm.base import column, parts_of, written
from parlance.llm.components import connected_components
from parlance.llm.hot import join_keyed
from parlance.llm.words import shingle_set

SAMPLE_DOCS = 2_048     # documents whose grams are looked at for common ones
COMMON_GRAMS = 1 << 18  # most of them that are known beforehand
COMMON_IN_SAMPLE = 4    # distinct sets of the sample that make a gram common
HOT_CLASSES = 1_000     # a class with more than 1 / this of all rows is entered by one row only
BLOCK_SETS, BLOCK_GRAMS = 1_024, 1 << 18  # about what a block of sets that are compared in one task holds
REPEATS = 32            # how often a candidate row may be repeated on average for the last comparison


@dataclass(frozen=True)
class Plan:
    """``percent``: least Jaccard similarity in percent; ``fragments`` of an order, the first ``probe`` of them thin."""

    width: int = 5
    percent: int = 75
    fragments: int = 8
    probe: int = 3

    @property
    def limit(self) -> int:
        return (1 << 64) // self.fragments * self.probe

    def needed(self, n: str):
        """Grams of n that a partner must have: ceil(percent / 100 * n)."""
        return F.floor((F.col(n) * self.percent + 99) / 100)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _class_of(grams: np.ndarray) -> bytes | None:
    return xxhash.xxh3_128_digest(grams.tobytes()) if len(grams) else None


def _common_grams(docs: DataFrame, plan: Plan) -> np.ndarray:
    """Grams of at least ``COMMON_IN_SAMPLE`` distinct sets in a sample of about ``SAMPLE_DOCS`` rows, the ``COMMON_GRAMS`` most frequent.

    Rows are taken by a hash of their number, below a threshold that follows from the count: texts aren't shuffled for it. What
    the sample misses costs time only.
    """
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts_of(batches, "text"):
            for text in column(batch, "text").to_pylist():
                grams = shingle_set(text, plan.width)
                if len(grams):
                    key = int.from_bytes(_class_of(grams)[:8], "little", signed=True)
                    grams = grams[grams < plan.limit]
                    yield pa.RecordBatch.from_arrays([_signed(grams), pa.array(np.full(len(grams), key))], names=["h", "k"])

    total = docs.select("id").count()
    share = min(1.0, SAMPLE_DOCS / max(total, 1))
    sample = docs.select("text", F.xxhash64(F.monotonically_increasing_id()).alias("r")).filter(F.col("r") / 2.0**63 <= 2 * share - 1)
    rows = sample.select("text").mapInArrow(emit, "h long, k long").groupBy("h").agg(F.countDistinct("k").alias("n"))
    found = rows.filter(F.col("n") >= COMMON_IN_SAMPLE).orderBy(F.desc("n"), "h").limit(COMMON_GRAMS).select("h").toArrow().column("h")
    return np.sort(np.asarray(found).astype(np.int64).view(np.uint64))


def _classes(docs: DataFrame, plan: Plan, common: np.ndarray) -> DataFrame:
    """``id, t, cls, k, n, m, known``: a digest of the text and the set of each row; the set's size, its grams in the probe, and how many of
    these are common."""
    limit = np.uint64(plan.limit)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts_of(batches, "text"):
            out = []
            for text in column(batch, "text").to_pylist():
                grams = shingle_set(text, plan.width)
                cls = _class_of(grams)
                m = int(np.searchsorted(grams, limit))
                known = int(np.isin(grams[:m], common, assume_unique=True).sum())
                out.append((cls, int.from_bytes(cls[:8], "little", signed=True) if cls else None, len(grams), m, known))
            cls, k, n, m, known = zip(*out)
            yield pa.RecordBatch.from_arrays([
                column(batch, "id"), column(batch, "t"), pa.array(cls, pa.binary()), pa.array(k, pa.int64()), pa.array(n, pa.int64()),
                pa.array(m, pa.int64()), pa.array(known, pa.int64())], names=["id", "t", "cls", "k", "n", "m", "known"])

    kind = docs.schema["id"].dataType.simpleString()
    rows = docs.select("id", "text", F.md5("text").alias("t"))
    return rows.mapInArrow(emit, f"id {kind}, t string, cls binary, k long, n long, m long, known long")


def _shared_in_probe(docs: DataFrame, plan: Plan, common: np.ndarray, hot: dict[bytes, object]) -> DataFrame:
    """``k, shared``: how many probe grams of a set, common ones left out, are found in another set too."""
    limit = np.uint64(plan.limit)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts_of(batches, "text"):
            grams, keys = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
            for row, text in zip(column(batch, "id").to_pylist(), column(batch, "text").to_pylist()):
                own = shingle_set(text, plan.width)
                cls = _class_of(own)
                if cls is None or hot.get(cls, row) != row:
                    continue
                own = own[:np.searchsorted(own, limit)]
                own = own[~np.isin(own, common, assume_unique=True)]
                grams.append(own)
                keys.append(np.full(len(own), int.from_bytes(cls[:8], "little", signed=True)))
            yield pa.RecordBatch.from_arrays([_signed(np.concatenate(grams)), pa.array(np.concatenate(keys))], names=["h", "k"])

    rows = docs.select("id", "text").mapInArrow(emit, "h long, k long")
    whole = Window.partitionBy("h")
    seen = rows.withColumns({"low": F.min("k").over(whole), "high": F.max("k").over(whole)})
    # Exact copies of a class repeat its rows: count each gram of a class once.
    return seen.filter("low <> high").groupBy("k").agg(F.countDistinct("h").alias("shared"))


def _sets(docs: DataFrame, plan: Plan) -> DataFrame:
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts_of(batches, "text"):
            sets = [shingle_set(x, plan.width) for x in column(batch, "text").to_pylist()]
            ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
            grams = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), _signed(np.concatenate(sets)))
            yield pa.RecordBatch.from_arrays([
                pa.array([_class_of(s) for s in sets], pa.binary()), pa.array([len(s) for s in sets], pa.int64()), grams],
                names=["cls", "n", "grams"])

    return docs.mapInArrow(emit, "cls binary, n long, grams array<long>")


def _ordered_grams(sets: DataFrame, plan: Plan) -> DataFrame:
    """``cid, n, central, grams``: for sets that can have a partner, the grams that other sets have too, rare ones first.

    ``central`` is the mean number of sets a gram of this set is found in.
    """
    grams = sets.select("cid", "n", F.explode("grams").alias("h"))
    counts = grams.groupBy("h").agg(F.count("*").alias("df")).filter("df > 1")
    own = grams.join(counts, "h").groupBy("cid", "n").agg(
        F.sort_array(F.collect_list(F.struct("df", "h"))).alias("grams"), F.sum("df").alias("total"))
    return own.filter(F.size("grams") >= plan.needed("n")).select("cid", "n", (F.col("total") / F.col("n")).alias("central"), "grams")


def _segments(ordered: DataFrame, plan: Plan) -> DataFrame:
    """``cid, f, seg``: each set's grams cut at the fragments of the global order (frequency, then hash)."""
    key = F.col("g.df") + F.col("g.h") / F.lit(2.0**64)
    flat = ordered.select(F.explode("grams").alias("g"))
    cuts = flat.agg(F.percentile_approx(key, [i / plan.fragments for i in range(1, plan.fragments)], 1_000).alias("c")).first()["c"]
    cut_at = sorted(set(cuts or []))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cid, grams in zip(column(batch, "cid").to_pylist(), column(batch, "grams")):
                values = grams.values
                df, h = np.asarray(values.field("df")), np.asarray(values.field("h"))
                part = np.searchsorted(cut_at, df + h / 2.0**64)
                used = np.unique(part)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(used), cid)), pa.array(used.astype(np.int32)),
                    pa.array([h[part == f] for f in used], pa.list_(pa.int64()))], names=["cid", "f", "seg"])

    return ordered.select("cid", "grams").mapInArrow(emit, "cid long, f int, seg array<long>")


def _compare(pairs: DataFrame, segments: DataFrame, extra: bool) -> DataFrame:
    """``o, x, f, shared`` (and the grams of x outside o) per fragment of each pair."""
    of_x = segments.select(F.col("cid").alias("x"), "f", F.col("seg").alias("sx"))
    of_o = segments.select(F.col("cid").alias("o"), "f", F.col("seg").alias("so"))
    both = pairs.join(of_x, "x").join(of_o, ["o", "f"], "left")
    none = F.array().cast("array<long>")
    out = both.withColumn("so", F.coalesce("so", none))
    columns = {"shared": F.size(F.array_intersect("sx", "so"))}
    if extra:
        columns["extra"] = F.array_except("sx", "so")
    return out.withColumns(columns).drop("sx", "so")


def _linked(compared: DataFrame, sizes: DataFrame, plan: Plan) -> DataFrame:
    """Partial overlaps summed per pair: ``o, x, shared, no, nx, linked``."""
    sums = compared.groupBy("o", "x").agg(F.sum("shared").alias("shared"))
    both = sums.join(sizes.select(F.col("cid").alias("o"), F.col("n").alias("no")), "o").join(
        sizes.select(F.col("cid").alias("x"), F.col("n").alias("nx")), "x")
    return both.withColumn("linked", 100 * F.col("shared") >= plan.percent * (F.col("no") + F.col("nx") - F.col("shared")))


def _links(sets: DataFrame, plan: Plan) -> DataFrame:
    """``a, b``: links that join the classes of every component."""
    spark = sets.sparkSession
    ordered = written(_ordered_grams(sets, plan), "ordered")
    segments = written(_segments(ordered, plan), "segments")
    # ``most``: the largest set a set can link with, given how many of its grams (``c``) any other set has.
    c = F.size("grams").cast("long")
    most = F.floor(c * (100 + plan.percent) / plan.percent) - F.col("n")
    sizes = written(ordered.select("cid", "n", "central", most.alias("most")), "sizes")
    length = F.greatest(F.lit(0), F.size("grams") - plan.needed("n") + 1).cast("int")
    prefixes = ordered.select("cid", F.explode(F.slice("grams", F.lit(1), length)).alias("g"))
    groups = written(prefixes.select(F.col("g.h").alias("s"), F.lit(None).cast("long").alias("of"), F.col("cid").alias("x")), "groups")
    rows, found = groups.count(), spark.createDataFrame([], "a long, b long")
    labels = None
    while True:
        # A group: members that may have links among them that aren't known; `of` is the leader it comes from.
        named = _possible(groups, sizes, plan)
        if labels is None:
            named = named.withColumn("label", F.col("x"))
        else:
            named = named.join(labels.select(F.col("node").alias("x"), "label"), "x", "left").withColumn("label", F.coalesce("label", "x"))
        # Members are counted by component first: only pairs across components are of interest.
        parts = named.groupBy(F.col("of").alias("g_of"), F.col("s").alias("g_s"), "label").agg(
            F.count("*").alias("n"), *[F.expr(f"bit_xor(xxhash64(x, {i}))").alias(f"m{i}") for i in (1, 2)])
        kept = parts.groupBy("g_of", "g_s").agg(
            F.count("*").alias("labels"), F.sum("n").alias("size"),
            *[F.expr(f"bit_xor(m{i})").alias(f"members{i}") for i in (1, 2)])
        # Near copies share many grams, so many groups have the same members: one of them is enough.
        kept = kept.filter("labels > 1").dropDuplicates(["size", "members1", "members2"]).select("g_of", "g_s")
        same = F.col("of").eqNullSafe(F.col("g_of")) & F.col("s").eqNullSafe(F.col("g_s"))
        live = written(named.join(kept, same).drop("g_of", "g_s"), "live")
        if live.isEmpty():
            return found
        if labels is not None:
            units = _units(live, ordered)
            repeated = units.agg(F.sum(F.col("blocks").cast("double"))).first()[0]
            if repeated <= REPEATS * rows:
                last = _compare_blocks(units, segments, sizes, plan)
                return found.union(last)
        members = live.select("of", "s", "x").join(sizes.select(F.col("cid").alias("x"), "central"), "x")
        leader = members.groupBy("of", "s").agg(F.min(F.struct(-F.col("central"), F.col("x"))).alias("first"))
        leader = leader.select(F.col("of").alias("g_of"), F.col("s").alias("g_s"), F.col("first.x").alias("o"))
        stars = written(members.join(leader, same).filter("x <> o").select("o", "x").distinct(), "stars")
        compared = written(_compare(stars, segments, extra=True), "compared")
        result = written(_linked(compared, sizes, plan), "result")
        found = written(found.union(result.filter("linked").select(F.col("o").alias("a"), F.col("x").alias("b"))), "links")
        labels = connected_components(found)
        groups = written(_next_groups(result, compared, plan), "groups")


def _units(live: DataFrame, ordered: DataFrame) -> DataFrame:
    """``unit, x, label, blocks``: members that are compared with each other, so that all members of each group meet.

    Near copies meet in many groups of nearly the same members. A unit is a cluster of groups that have members in common, if
    its rows are fewer (``blocks``: how often its members are repeated, see ``_compare_blocks``) than those of its groups.
    """
    least = live.groupBy("of", "s").agg(F.min("x").alias("o")).select(F.col("of").alias("g_of"), F.col("s").alias("g_s"), "o")
    same = F.col("of").eqNullSafe(F.col("g_of")) & F.col("s").eqNullSafe(F.col("g_s"))
    rows = written(live.join(least, same).select("x", "label", "o", F.xxhash64("of", F.col("of").isNull(), "s").alias("g")), "unit-rows")
    cluster = connected_components(rows.select(F.col("x").alias("a"), F.col("o").alias("b")))
    known = ordered.select(F.col("cid").alias("x"), F.size("grams").alias("grams"))
    rows = rows.join(cluster.withColumnRenamed("node", "x").withColumnRenamed("label", "cluster"), "x").join(known, "x").drop("o")
    rows = written(rows, "clustered")
    blocks = F.greatest(F.ceil(F.count("*") / BLOCK_SETS), F.ceil(F.sum("grams") / BLOCK_GRAMS)).alias("blocks")
    groups = rows.groupBy("cluster", "g").agg(F.count("*").alias("size"), blocks)
    whole = rows.select("cluster", "x", "grams").distinct().groupBy("cluster").agg(F.count("*").alias("size"), blocks.alias("whole"))
    cost = groups.groupBy("cluster").agg(F.sum(F.col("size") * F.col("blocks")).alias("apart"))
    choice = whole.join(cost, "cluster").select("cluster", "whole", (F.col("size") * F.col("whole") <= F.col("apart")).alias("together"))
    chosen = rows.join(choice, "cluster").join(groups.select("cluster", "g", "blocks"), ["cluster", "g"])
    unit = F.when(F.col("together"), F.col("cluster")).otherwise(F.col("g"))
    return written(chosen.select(unit.alias("unit"), "together", "x", "label", F.when(F.col("together"), F.col("whole")).otherwise(F.col("blocks")).alias("blocks")).distinct(), "units")


def _compare_blocks(units: DataFrame, segments: DataFrame, sizes: DataFrame, plan: Plan) -> DataFrame:
    """``a, b``: links that join the members of each unit, from comparing all of them.

    The members are dealt to ``blocks`` blocks; each two blocks meet in one task, which counts what their sets share fragment by
    fragment and adds it up per pair. Pairs stay inside the task: it returns a link per set at most.
    """
    per_set = segments.groupBy(F.col("cid").alias("x")).agg(F.sort_array(F.collect_list(F.struct("f", "seg"))).alias("parts"))
    rows = units.join(sizes.select(F.col("cid").alias("x"), "n", "most"), "x").withColumn("own", F.pmod(F.xxhash64("x"), F.col("blocks")))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    rows = rows.select("unit", "together", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "x", "label", "n", "most")
    rows = rows.join(per_set, "x")

    def compare(table: pa.Table) -> pa.Table:
        x, n, most, label = (np.asarray(table.column(c)) for c in ("x", "n", "most", "label"))
        shared = np.zeros((len(x), len(x)), np.float32)
        for f in range(plan.fragments):
            owners, grams = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for row, parts in enumerate(table.column("parts")):
                at, seg = np.asarray(parts.values.field("f")), parts.values.field("seg")
                for k in np.flatnonzero(at == f):
                    grams.append(np.asarray(seg[int(k)].values))
                    owners.append(np.full(len(grams[-1]), row))
            _add_overlaps(shared, np.concatenate(owners), np.concatenate(grams))
        union = n[:, None] + n[None, :] - shared
        linked = (100 * shared >= plan.percent * union) & (label[:, None] != label[None, :])
        linked &= (n[:, None] <= most[None, :]) & (n[None, :] <= most[:, None])
        np.fill_diagonal(linked, False)
        first = np.arange(len(x))
        while True:  # the smallest row that links reach
            ahead = np.where(linked, first[None, :], len(x)).min(axis=1, initial=len(x))
            now = np.minimum(first, ahead)
            now = now[now]
            if (now == first).all():
                break
            first = now
        moved = np.flatnonzero(first != np.arange(len(x)))
        return pa.table({"a": pa.array(x[moved]), "b": pa.array(x[first[moved]])})

    return rows.groupBy("unit", "together", "i", "j").applyInArrow(compare, "a long, b long")


def _add_overlaps(shared: np.ndarray, owners: np.ndarray, grams: np.ndarray, rare: int = 16) -> None:
    """Add to ``shared`` how many grams each two owners have in common: rare grams pair by pair, frequent ones as a matrix product."""
    order = np.argsort(grams, kind="stable")
    grams, owners = grams[order], owners[order]
    starts = np.flatnonzero(np.r_[True, grams[1:] != grams[:-1]]) if len(grams) else np.zeros(0, np.int64)
    counts = np.diff(np.r_[starts, len(grams)])
    column_of = np.repeat(np.arange(len(starts)), counts)
    few = (counts >= 2) & (counts <= rare)
    keep = few[column_of] if len(grams) else np.zeros(0, bool)
    at, who = column_of[keep], owners[keep]
    size = len(shared)
    for k in range(1, min(rare, len(at))):
        met = at[k:] == at[:-k]
        if not met.any():
            break
        pairs = np.bincount(who[:-k][met] * size + who[k:][met], minlength=size * size).reshape(size, size)
        shared += pairs
        shared += pairs.T
    many = np.flatnonzero(counts > rare)
    for lot in range(0, len(many), 2_048):
        chosen = np.full(len(starts), -1)
        chosen[many[lot:lot + 2_048]] = np.arange(len(many[lot:lot + 2_048]))
        spot = chosen[column_of]
        own = np.zeros((size, min(2_048, len(many) - lot)), np.float32)
        own[owners[spot >= 0], spot[spot >= 0]] = 1
        shared += own @ own.T


def _possible(groups: DataFrame, sizes: DataFrame, plan: Plan) -> DataFrame:
    """Groups cut by size, so that sets whose sizes allow a link meet in one at least, without the members that can't link
    with any size in it."""
    step = max(math.log(100 / plan.percent), 1e-6) * (1 + 1e-9)  # sizes that allow a link are at most one step apart
    sized = groups.join(sizes.select(F.col("cid").alias("x"), "n", "most"), "x")
    bucket = F.floor(F.log(F.col("n").cast("double")) / F.lit(step))
    cut = sized.withColumn("b", F.explode(F.array(bucket, bucket + 1))).withColumn("s", F.xxhash64(F.coalesce("s", F.lit(-1)), F.col("s").isNull(), "b")).drop("b")
    least = cut.groupBy(F.col("of").alias("l_of"), F.col("s").alias("l_s")).agg(F.min("n").alias("least"))
    same = F.col("of").eqNullSafe(F.col("l_of")) & (F.col("s") == F.col("l_s"))
    return cut.join(least, same).filter("most >= least").drop("l_of", "l_s", "least")


def _next_groups(result: DataFrame, compared: DataFrame, plan: Plan) -> DataFrame:
    """Members of a leader's star that share a gram outside the leader, and those the leader's own grams can't rule out."""
    outside = compared.select(F.explode("extra").alias("s"), F.col("o").alias("of"), "x")
    # Sets that link share ``percent`` of either; what they share inside the leader can be that much only if each shares so
    # much with the leader itself.
    close = result.filter(100 * F.col("shared") >= plan.percent * F.col("nx"))
    near, small = close.filter(~F.col("linked")).select("o", "x"), close.filter("nx < no").select("o", "x")
    rest = near.union(small.join(near.select("o").distinct(), "o", "left_semi")).distinct()
    return outside.union(rest.select(F.lit(None).cast("long"), "o", "x"))


def _found(docs: DataFrame, plan: Plan) -> DataFrame:
    """``id, t, n, component, group`` per row of ``docs`` (``id, text``): ``t`` is a digest of the text, ``group`` names the component."""
    common = _common_grams(docs, plan)
    classes = written(_classes(docs, plan, common), "classes")
    full = classes.filter("n > 0")
    per_class = full.groupBy("cls", "k", "n", "m", "known").agg(F.min("id").alias("rep"), F.count("*").alias("copies"))
    reps = written(per_class, "reps")
    n = full.count()
    hot = {bytes(r["cls"]): r["rep"] for r in reps.filter(F.col("copies") > max(1_000, n // HOT_CLASSES)).collect()}
    shared = _shared_in_probe(docs, plan, common, hot)
    alone = F.col("m") - F.col("known") - F.coalesce("shared", F.lit(0))
    left = written(reps.join(shared, "k", "left").filter(alone <= F.col("n") - plan.needed("n")).select("cls", "rep"), "left")
    # The ids are a table that Spark wrote, so Spark itself checks whether it is small enough to broadcast.
    again = docs.join(left.select(F.col("rep").alias("r")), F.col("id").eqNullSafe(F.col("r")), "left_semi")
    sets = _sets(again, plan).join(left, "cls", "left_semi").dropDuplicates(["cls"])
    sets = written(sets.withColumn("cid", F.monotonically_increasing_id()), "sets")
    labels = connected_components(_links(sets, plan))
    named = sets.select("cls", "cid").join(labels, F.col("cid") == F.col("node")).select("cls", "label")
    at = reps.join(named, "cls").groupBy("label").agg(F.min("rep").alias("component"))
    merged = named.join(at, "label").select("cls", "component", F.col("label").cast("string").alias("group"))
    whole = reps.join(merged, "cls", "left").select(
        "cls", "copies", F.coalesce("component", "rep").alias("component"), F.coalesce("group", F.hex("cls")).alias("group"))
    # A class of copies may hold a third of all rows, and rows without a set have no class.
    out = join_keyed(classes, written(whole, "components"), "cls", "copies", [F.monotonically_increasing_id()], "left")
    return out.select("id", "t", "n", F.coalesce("component", "id").alias("component"), "group", "cls")


def jaccard_classes(docs: DataFrame, key: str = "doc_id", text: str = "text", plan: Plan = Plan()) -> DataFrame:
    """``id, cls, n_shingles, component`` per row of ``docs``; ``component`` is the smallest id that links reach.

    A NULL, empty or wordless text has no shingles and stays alone, also beside others of its kind. Rows of one id are
    rows of their own, and copies of a set are one class whatever their ids. A component whose ids are all NULL has a NULL
    id; otherwise NULL ids are passed over. Extra columns are ignored; an empty table gives an empty result.
    """
    found = _found(docs.select(F.col(key).alias("id"), F.col(text).alias("text")), plan)
    return found.select("id", "cls", F.col("n").alias("n_shingles"), "component")


def keep_one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", plan: Plan = Plan()) -> DataFrame:
    """One row of each component of ``jaccard_classes``: that with the smallest id (NULL is the largest), of these that with the
    smallest digest of its text, and one of those that agree in both.

    Rows without shingles all stay. Rows are told apart by id and text, so an unrelated text with the id of a copy stays. Columns
    are those of ``docs``.
    """
    found = _found(docs.select(F.col(key).alias("id"), F.col(text).alias("text")), plan).filter("n > 0")
    rows = written(found.groupBy("group", "id", "t").agg(F.count("*").alias("rows")), "rows-of-groups")
    first = F.min(F.struct(F.col("id").isNull().alias("none"), F.col("id"), F.col("t"))).alias("k")
    keepers = rows.groupBy("group").agg(first).select("group", F.col("k.id").alias("k_id"), F.col("k.t").alias("k_t"))
    marked = rows.join(keepers, "group").withColumn("stays", F.col("id").eqNullSafe(F.col("k_id")) & (F.col("t") == F.col("k_t")))
    marked = written(marked.filter("NOT stays OR rows > 1").select(F.col("id").alias("__id"), F.col("t").alias("__t"), "stays"), "marked")
    own = docs.withColumn("__digest", F.md5(text))
    same = F.col(key).eqNullSafe(F.col("__id")) & (F.col("__digest") == F.col("__t"))
    kept = own.join(marked.filter("NOT stays").drop("stays"), same, "left_anti")
    repeated = marked.filter("stays").drop("stays")
    if not repeated.isEmpty():
        single = kept.join(repeated, same, "left_semi").dropDuplicates([key, "__digest"])
        kept = kept.join(repeated, same, "left_anti").unionByName(single)
    return kept.drop("__digest")
