"""Ordered computations within a key that stay parallel when one key holds most of the rows.

``Window.partitionBy(session)`` sends a whole session to one task. Here the ordering column is cut into
*blocks* by a fixed rule (a minute of arrival time, 65,536 sequence numbers, ...), so the unit of work is
``(key, block)``:

1. *local*   - window expressions inside ``(key, block)``: the only pass that sorts the data;
2. *summary* - one row per ``(key, block)``, aggregated map-side before its shuffle;
3. *carry*   - window expressions over the summaries of one key: what enters each block from outside;
4. the carry joins back on ``(key, block)``, the partitioning the local pass already has.

A key has at most (span of the ordering column / block width) summaries, whatever its number of rows.
The block is a pure function of the row, so recomputed tasks always agree. Keys and ordering columns must
not be NULL, and the ordering must be total for the result to be well defined.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

BLOCK = "__block"
Stage = dict[str, Callable[["Scope"], Column]]


@dataclass(frozen=True)
class Scope:
    """Windows over one ordered group: in order, everything before the row, everything after it, all of it."""

    step: WindowSpec
    before: WindowSpec
    upto: WindowSpec
    after: WindowSpec
    whole: WindowSpec


def _scope(keys: Sequence[str], order: Sequence[str]) -> Scope:
    step = Window.partitionBy(*keys).orderBy(*order)
    return Scope(
        step=step,
        before=step.rowsBetween(Window.unboundedPreceding, -1),
        upto=step.rowsBetween(Window.unboundedPreceding, 0),
        after=step.rowsBetween(1, Window.unboundedFollowing),
        whole=Window.partitionBy(*keys),
    )


def time_block(ts: str | Column, seconds: int = 60) -> Column:
    """Start of the ``seconds``-wide interval that holds a timestamp, in microseconds."""
    micros = F.unix_micros(F.col(ts) if isinstance(ts, str) else ts)
    return micros - F.pmod(micros, F.lit(seconds * 1_000_000))


def sequence_block(position: str | Column, rows: int = 65_536) -> Column:
    """First position of the ``rows``-long run that holds an integer position."""
    pos = (F.col(position) if isinstance(position, str) else position).cast("long")
    return pos - F.pmod(pos, F.lit(rows))


def block_scan(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    block: Column,
    *,
    local: Sequence[Stage],
    summary: dict[str, Column],
    carry: Sequence[Stage],
    keep: Sequence[str],
) -> DataFrame:
    """Attach the ``local`` and the ``keep`` columns of ``carry`` to every row; see the module text."""
    unit = [*keys, BLOCK]
    rows = df.withColumn(BLOCK, block)
    inside = _scope(unit, order)
    for stage in local:
        rows = rows.withColumns({name: make(inside) for name, make in stage.items()})
    blocks = rows.groupBy(*unit).agg(*[agg.alias(name) for name, agg in summary.items()])
    across = _scope(keys, [BLOCK])
    for stage in carry:
        blocks = blocks.withColumns({name: make(across) for name, make in stage.items()})
    return rows.join(blocks.select(*unit, *keep), unit)


def _zero(col: Column) -> Column:
    return F.coalesce(col, F.lit(0))


def with_row_number(df, keys, order, block, name="row_no") -> DataFrame:
    """1-based position of each row in its key."""
    out = block_scan(
        df, keys, order, block,
        local=[{"__rn": lambda s: F.row_number().over(s.step).cast("long")}],
        summary={"__rows": F.count(F.lit(1))},
        carry=[{"__rows_before": lambda s: _zero(F.sum("__rows").over(s.before))}],
        keep=["__rows_before"],
    )
    return out.withColumn(name, F.col("__rn") + F.col("__rows_before")).drop("__rn", "__rows_before", BLOCK)


def with_running_sum(df, keys, order, block, value: Column, name: str, inclusive: bool = True) -> DataFrame:
    """Sum of ``value`` over the rows of the key up to this one (or strictly before it)."""
    out = block_scan(
        df.withColumn("__value", value), keys, order, block,
        local=[{"__in": lambda s: _zero(F.sum("__value").over(s.upto if inclusive else s.before))}],
        summary={"__total": _zero(F.sum("__value"))},
        carry=[{"__sum_before": lambda s: _zero(F.sum("__total").over(s.before))}],
        keep=["__sum_before"],
    )
    return out.withColumn(name, F.col("__in") + F.col("__sum_before")).drop("__value", "__in", "__sum_before", BLOCK)


def _edge(df, keys, order, block, values: dict[str, str], forward: bool) -> DataFrame:
    at = F.struct(*order)
    pick = F.min_by if forward else F.max_by
    shift = F.lead if forward else F.lag
    names = list(values)
    out = block_scan(
        df, keys, order, block,
        local=[{
            "__edge": lambda s: shift(F.lit(True), 1, False).over(s.step),
            **{n: (lambda s, c=values[n]: shift(c).over(s.step)) for n in names},
        }],
        summary={f"__s_{n}": pick(F.col(values[n]), at) for n in names},
        carry=[{f"__c_{n}": (lambda s, n=n: shift(f"__s_{n}").over(s.step)) for n in names}],
        keep=[f"__c_{n}" for n in names],
    )
    merged = {n: F.when(F.col("__edge"), F.col(n)).otherwise(F.col(f"__c_{n}")) for n in names}
    return out.withColumns(merged).drop("__edge", BLOCK, *[f"__c_{n}" for n in names])


def with_previous(df, keys, order, block, values: dict[str, str]) -> DataFrame:
    """``{new_column: column}`` - the value on the row just before, NULL on the first row of a key."""
    return _edge(df, keys, order, block, values, forward=False)


def with_following(df, keys, order, block, values: dict[str, str]) -> DataFrame:
    """``{new_column: column}`` - the value on the row just after, NULL on the last row of a key."""
    return _edge(df, keys, order, block, values, forward=True)


def with_last_known(df, keys, order, block, values: dict[str, str]) -> DataFrame:
    """``{new_column: column}`` - the last non-NULL value strictly before this row."""
    at = F.struct(*order)
    names = list(values)
    out = block_scan(
        df, keys, order, block,
        local=[{n: (lambda s, c=values[n]: F.last(c, ignorenulls=True).over(s.before)) for n in names}],
        summary={f"__s_{n}": F.max_by(F.col(values[n]), F.when(F.col(values[n]).isNotNull(), at)) for n in names},
        carry=[{f"__c_{n}": (lambda s, n=n: F.last(f"__s_{n}", ignorenulls=True).over(s.before)) for n in names}],
        keep=[f"__c_{n}" for n in names],
    )
    merged = {n: F.coalesce(F.col(n), F.col(f"__c_{n}")) for n in names}
    return out.withColumns(merged).drop(BLOCK, *[f"__c_{n}" for n in names])


def with_totals(df, keys, block, sums: dict[str, Column]) -> DataFrame:
    """Attach per-key sums to every row without gathering a key: partial sums per ``(key, block)``, totals
    over the (few) blocks of a key, and a join on ``(key, block)``."""
    unit = [*keys, BLOCK]
    rows = df.withColumn(BLOCK, block)
    parts = rows.groupBy(*unit).agg(*[F.sum(expr).alias(f"__p_{n}") for n, expr in sums.items()])
    whole = Window.partitionBy(*keys)
    totals = parts.select(*unit, *[F.sum(f"__p_{n}").over(whole).alias(n) for n in sums])
    return rows.join(totals, unit).drop(BLOCK)


def concat_ordered(df, keys, order, block, text: str, separator: str, name: str) -> DataFrame:
    """One string per key, its parts in order: joined per ``(key, block)`` first, so that a task never holds
    more than one block of parts, then over the blocks. The result row is the only full-size value."""
    unit = [*keys, BLOCK]
    part = F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)], F.col(text).alias("part"))
    per_block = (
        df.withColumn(BLOCK, block)
        .groupBy(*unit)
        .agg(
            # A block without any part stays NULL, so that it adds no separator.
            F.when(
                F.count(text) > 0,
                F.array_join(F.transform(F.sort_array(F.collect_list(part)), lambda x: x["part"]), separator),
            ).alias("part")
        )
    )
    joined = F.array_join(
        F.transform(F.sort_array(F.collect_list(F.struct(BLOCK, "part"))), lambda x: x["part"]), separator
    )
    return per_block.groupBy(*keys).agg(joined.alias(name))


def salted_join(big: DataFrame, small: DataFrame, on: Sequence[str], spread: Column, how: str = "inner",
                salts: int = 16) -> DataFrame:
    """Equi-join that cuts every key of ``big`` into ``salts`` parts (by ``spread``) and repeats ``small`` as
    often. For many-to-few joins where one key of ``big`` may hold most of its rows.

    Spark's size estimates know nothing of the repetition (nor of Parquet's compression), so the repeated side is never
    broadcast: it would pass through the driver ``salts`` times."""
    left = big.withColumn("__salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    right = small.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right.hint("merge"), [*on, "__salt"], how).drop("__salt")
