"""Block scans must equal plain windows, above all when one key spans many blocks."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from parlance import ordered


@pytest.fixture(scope="module")
def skewed(spark):
    random.seed(5)
    data = []
    for i in range(1500):
        key = "hot" if i % 3 else f"k{random.randrange(40)}"
        data.append((key, i, random.randrange(100), random.choice([None, "a", "b", "c"])))
    return spark.createDataFrame(data, "k string, pos long, v int, s string").cache()


def same(ours, plain):
    assert ours.exceptAll(plain).count() == 0
    assert ours.count() == plain.count()


@pytest.mark.parametrize("size", [1, 7, 100, 10_000])
def test_equals_plain_windows(skewed, size):
    step = Window.partitionBy("k").orderBy("pos")
    before = step.rowsBetween(Window.unboundedPreceding, -1)
    block = ordered.sequence_block("pos", size)
    args = (["k"], ["pos"], block)
    same(ordered.with_row_number(skewed, *args, "n").select("k", "pos", "n"),
         skewed.select("k", "pos", F.row_number().over(step).cast("long").alias("n")))
    same(ordered.with_running_sum(skewed, *args, F.col("v"), "t").select("k", "pos", "t"),
         skewed.select("k", "pos", F.sum("v").over(step).alias("t")))
    same(ordered.with_running_sum(skewed, *args, F.col("v"), "t", inclusive=False).select("k", "pos", "t"),
         skewed.select("k", "pos", F.coalesce(F.sum("v").over(before), F.lit(0)).alias("t")))
    same(ordered.with_previous(skewed, *args, {"p": "s"}).select("k", "pos", "p"), skewed.select("k", "pos", F.lag("s").over(step).alias("p")))
    same(ordered.with_following(skewed, *args, {"p": "s"}).select("k", "pos", "p"), skewed.select("k", "pos", F.lead("s").over(step).alias("p")))
    same(ordered.with_last_known(skewed, *args, {"p": "s"}).select("k", "pos", "p"),
         skewed.select("k", "pos", F.last("s", ignorenulls=True).over(before).alias("p")))
    same(ordered.with_totals(skewed, ["k"], block, {"t": F.col("v")}).select("k", "pos", "t"),
         skewed.select("k", "pos", F.sum("v").over(Window.partitionBy("k")).alias("t")))


def test_hot_key_is_spread_over_blocks(spark, skewed):
    """No window of the local pass may be partitioned by the key alone."""
    plan = ordered.with_row_number(skewed, ["k"], ["pos"], ordered.sequence_block("pos", 100))._jdf.queryExecution().toString()
    assert "row_number() windowspecdefinition(k" in plan and f"{ordered.BLOCK}" in plan


def test_concat_ordered(spark, rows):
    df = spark.createDataFrame([("a", 0, "x"), ("a", 11, "z"), ("a", 5, None), ("a", 10, "y"), ("b", 3, None)], "k string, i long, t string")
    out = ordered.concat_ordered(df, ["k"], ["i"], ordered.sequence_block("i", 5), "t", " ", "text")
    assert rows(out, "k", "text") == [("a", "x y z"), ("b", "")]


def test_salted_join(spark):
    big = spark.range(1000).select((F.col("id") % 3).alias("k"), "id")
    small = spark.createDataFrame([(0, "x"), (1, "y")], "k long, name string")
    same(ordered.salted_join(big, small, ["k"], F.col("id"), salts=4).select("k", "id", "name"), big.join(small, "k").select("k", "id", "name"))


def test_the_repeated_side_of_a_salted_join_is_never_broadcast(spark):
    big = spark.createDataFrame([(1, 10), (1, 11), (2, 12), (3, 13)], "k int, v int")
    small = spark.createDataFrame([(1, "a"), (2, "b")], "k int, name string")
    for how, want in (("inner", [(10, "a"), (11, "a"), (12, "b")]), ("left", [(10, "a"), (11, "a"), (12, "b"), (13, None)])):
        joined = ordered.salted_join(big, small, ["k"], F.col("v"), how)
        assert sorted((r.v, r.name) for r in joined.collect()) == want
        assert "Broadcast" not in joined._jdf.queryExecution().executedPlan().toString()
