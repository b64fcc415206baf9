"""Joins of many rows with a table of one row per key, where one key may hold a third of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOT_KEYS = 1_024  # a key with more than 1 / this of all rows is hot; there are fewer of them than this
PARTS = 64        # parts that a hot key's rows are dealt to


def join_keyed(rows: DataFrame, keyed: DataFrame, key: str, weight: str, spread: list, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``keyed`` (a written table, ``key`` unique and not NULL in it) on ``key``.

    ``weight`` in ``keyed`` is the number of rows that a key has in ``rows``; it says which keys are hot. The rows of a hot key
    are dealt by a hash of ``spread`` to ``PARTS`` parts and only the hot keys' own rows are repeated as often. The list of hot
    keys is broadcast: by its definition it has less than ``HOT_KEYS`` rows. Rows without a key are dealt out in the same way. ``how``:
    inner or left. ``weight`` isn't returned.
    """
    total = keyed.agg(F.coalesce(F.sum(weight), F.lit(0)).alias("n")).first()["n"]
    parts = F.when(F.col(weight) * HOT_KEYS > total, PARTS).otherwise(1)
    hot = keyed.filter(F.col(weight) * HOT_KEYS > total).select(F.col(key).alias("__hot"))
    dealt = rows.join(F.broadcast(hot), F.col(key) == F.col("__hot"), "left")
    dealt = dealt.withColumn("__part", F.when(F.col("__hot").isNull() & F.col(key).isNotNull(), 0).otherwise(F.pmod(F.xxhash64(*spread), F.lit(PARTS)).cast("int")))
    repeated = keyed.withColumn("__part", F.explode(F.sequence(F.lit(0), parts - 1))).drop(weight)
    return dealt.drop("__hot").join(repeated, [key, "__part"], how).drop("__part")
