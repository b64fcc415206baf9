"""Transfer progress: percent, throttling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STEP = 5
START = -1
MB = 1024.0 * 1024.0


def progress_percent(df: DataFrame) -> DataFrame:
    """``percent`` is -1 while the total is unknown; sizes also as text in MB."""
    total = F.col("total_bytes")
    return df.withColumns({
        "percent": F.when(total > 0, F.col("bytes") / total * 100.0).otherwise(F.lit(-1.0)),
        "done_text": F.format_string("%.1f MB", F.col("bytes") / F.lit(MB)),
        "total_text": F.when(total > 0, F.format_string("%.1f MB", total / F.lit(MB))),
    })


def throttle_progress(df: DataFrame, step: int = STEP, key: str = "name", order: str = "seq") -> DataFrame:
    """Keep a report when it is ``step`` points above the last *kept* one, or 100 (percent clamped to 0..100).

    The last kept percent only ever rises, so a report below 100 can be kept only if it is the first of its key with
    that percent. That leaves at most 100 candidates per key, found by a map-side minimum; the fold over "last kept"
    runs on those. Reports of exactly 100 are all kept and never gathered.
    """
    if step < 1:
        raise ValueError("step must be at least 1")
    pct = F.least(F.greatest(F.col("pct"), F.lit(0)), F.lit(100)).cast("int")
    rows = df.select(key, F.col(order).cast("long").alias(order), pct.alias("pct"))
    firsts = rows.groupBy(key, "pct").agg(F.min(order).alias(order))
    candidates = firsts.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(order, "pct"))).alias("reports"))
    kept_type = f"array<struct<{order}:bigint,pct:int>>"
    decided = F.aggregate(
        "reports",
        F.struct(F.lit(START).alias("last"), F.array().cast(kept_type).alias("kept")),
        lambda acc, r: F.when(
            (r["pct"] >= acc["last"] + step) | (r["pct"] == 100),
            F.struct(r["pct"].alias("last"), F.concat(acc["kept"], F.array(r)).alias("kept")),
        ).otherwise(acc),
    )
    rising = candidates.select(key, F.explode(decided["kept"]).alias("r")).select(key, f"r.{order}", "r.pct")
    return rising.filter("pct < 100").unionByName(rows.filter("pct = 100"))
