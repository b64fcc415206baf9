"""Balanced shards by longest-processing-time scheduling: the largest item left goes to the least loaded shard.

Rows of one group stay together. There are about as many groups as rows, so groups are not scheduled one by one on the
driver: a group that is large (at least 1 / ``LARGE`` of a shard) is an item of its own, of which there can be
``shards * LARGE`` at most; the small ones are put into bundles by hash. Bundles come in levels of halving size, so the last
items to be scheduled are tiny and fill what gaps are left. The heap sees a bounded number of items whatever the input.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from parlance.llm.base import written

LARGE = 1_024
LEVELS, PER_LEVEL = 24, 256     # bundles: level l takes 1 / 2 ** (l + 1) of the small groups
RANKED_TOGETHER = 8_192


def schedule(sizes: dict, shards: int) -> dict:
    """Longest processing time first: item -> shard. Ties go by item and by shard, so the result is always the same."""
    loads = [(0, shard) for shard in range(shards)]
    out = {}
    for item, size in sorted(sizes.items(), key=lambda x: (-x[1], x[0])):
        load, shard = heapq.heappop(loads)
        out[item] = shard
        heapq.heappush(loads, (load + size, shard))
    return out


def balanced_shards(docs: DataFrame, shards: int = 16, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, size, text_crc32, shard, slot`` per row; groups are equal texts, NULL counts as empty text.

    Size is the UTF-8 bytes of the text and one more. Slots number a shard's rows from 0 without gaps. Repeated rows and
    NULL keys are rows like others; other columns are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    rows = docs.select(F.col(key).alias("key"), (F.octet_length(body) + F.lit(1)).cast("long").alias("size"),
                       F.crc32(body).alias("text_crc32"), F.unhex(F.md5(body)).alias("group"))
    rows = written(rows, "sizes")
    groups = written(rows.groupBy("group").agg(F.sum("size").alias("size")), "groups")
    total, n = rows.agg(F.sum("size"), F.count("*")).first()
    least = (total or 0) / (shards * LARGE)
    large = {bytes(r["group"]): r["size"] for r in groups.filter(F.col("size") >= least).collect()}
    bundles = groups.filter(F.col("size") < least).groupBy(_bundle().alias("bundle")).agg(F.sum("size").alias("size"))
    small = {r["bundle"]: r["size"] for r in bundles.collect()}
    # Bundles are numbers, large groups bytes: one dictionary of both, ordered by text for equal sizes.
    items = {f"b{k:06d}": v for k, v in small.items()} | {f"g{k.hex()}": v for k, v in large.items()}
    placed = schedule(items, shards)
    of_bundle = F.array(*[F.lit(placed.get(f"b{b:06d}", 0)) for b in range(LEVELS * PER_LEVEL)])
    # At most shards * LARGE rows.
    of_group = spark.createDataFrame([(bytearray(k), placed[f"g{k.hex()}"]) for k in large], "group binary, own int")
    dealt = rows.join(F.broadcast(of_group), "group", "left").withColumn("shard", F.coalesce("own", F.get(of_bundle, _bundle())))
    return _slots(dealt.select("key", "size", "text_crc32", "shard"), n, shards).withColumnRenamed("key", key)


def _bundle():
    """Number of a small group's bundle. The level is the number of zeros a hash begins with."""
    h = F.xxhash64("group", F.lit("level"))
    level = F.least(F.lit(LEVELS - 1), F.lit(63) - F.floor(F.log2(F.greatest(F.lit(1), F.shiftrightunsigned(h, 1)).cast("double")) + 1))
    level = F.greatest(F.lit(0), level)
    return (level * PER_LEVEL + F.pmod(F.xxhash64("group", F.lit("bundle")), F.lit(PER_LEVEL))).cast("int")


def _slots(dealt: DataFrame, n: int, shards: int) -> DataFrame:
    """Number the rows of each shard: ranks inside hash blocks plus the rows of the blocks before."""
    blocks = max(1, -(-n // (shards * RANKED_TOGETHER)))
    rows = dealt.withColumn("block", F.pmod(F.xxhash64("key", "text_crc32"), F.lit(blocks)))
    counts = rows.groupBy("shard", "block").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("shard", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("shard", "block").orderBy("key", "text_crc32", "size"))
    ranked = rows.withColumn("slot", (inside - 1).cast("long")).join(counts, ["shard", "block"])
    return ranked.withColumn("slot", F.col("slot") + F.col("before")).drop("block", "before")
