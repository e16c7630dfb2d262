"""Previous-row, rank and latest operators against plain windows on skewed data."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from snapledger.operators.ordered import _cuts, global_rank, last_before, latest, latest_by_aggregate, top_k, top_per_key, unique_or_fail


@pytest.fixture(scope="module")
def skewed(spark):
    """One key holds a third of all rows; values repeat and some are NULL."""
    rng = random.Random(7)
    start = datetime(2024, 1, 1)
    rows = []
    for n in range(3000):
        key = "hot" if rng.random() < 0.34 else f"k{rng.randrange(60)}"
        at = start + timedelta(hours=rng.randrange(24 * 90))
        rows.append((key, at, n, rng.choice([None, 1, 2, 3]), rng.random() < 0.3))
    return spark.createDataFrame(rows, "k string, at timestamp, n int, v int, ok boolean").repartition(6)


def pairs(df, column="p"):
    return sorted((r["n"], r[column]) for r in df.collect())


@pytest.mark.parametrize("by_day", [True, False])
@pytest.mark.parametrize("reverse", [True, False])
def test_previous_row(skewed, by_day, reverse):
    segment = F.to_date("at") if by_day else None
    order = [F.col("at").desc(), F.col("n").desc()] if reverse else ["at", "n"]
    expected = skewed.withColumn("p", F.lag("v").over(Window.partitionBy("k").orderBy(*order)))
    found = last_before(skewed, ["k"], ["at", "n"], segment, F.col("v"), "p", reverse=reverse)
    assert pairs(found) == pairs(expected)


@pytest.mark.parametrize("by_day", [True, False])
def test_previous_matching_row(skewed, by_day):
    segment = F.to_date("at") if by_day else None
    window = Window.partitionBy("k").orderBy("at", "n").rowsBetween(Window.unboundedPreceding, -1)
    expected = skewed.withColumn("p", F.last(F.when(F.col("ok"), F.col("n")), ignorenulls=True).over(window))
    found = last_before(skewed, ["k"], ["at", "n"], segment, F.col("n"), "p", F.col("ok"))
    assert pairs(found) == pairs(expected)


@pytest.mark.parametrize("reverse", [True, False])
@pytest.mark.parametrize("where", [True, False])
def test_a_missing_hot_key_is_cut_and_carried_too(skewed, reverse, where):
    """Two hot keys, one of them NULL, whose rows are cut at the sample, against a plain window."""
    rows = skewed.withColumn("k", F.when(F.col("k") != "hot", F.col("k"))).unionByName(skewed).withColumn("n", F.monotonically_increasing_id())
    rows = rows.withColumn("e", F.when(F.col("n") % 9 == 0, F.col("v")))
    order = [F.col("at").desc(), F.col("n").desc()] if reverse else ["at", "n"]
    window = Window.partitionBy("k", "e").orderBy(*order)
    test = F.col("ok") if where else None
    value = F.last(F.when(F.col("ok"), F.col("n")), ignorenulls=True).over(window.rowsBetween(Window.unboundedPreceding, -1)) if where else F.lag("n").over(window)
    session = skewed.sparkSession
    parts = session.conf.get("spark.sql.shuffle.partitions")
    session.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        rows = rows.persist()
        found = last_before(rows, ["k", "e"], ["at", "n"], None, F.col("n"), "p", test, reverse)
        got, plan = pairs(found), found._jdf.queryExecution().analyzed().toString()
    finally:
        session.conf.set("spark.sql.shuffle.partitions", parts)
    assert "_carry" in plan
    assert got == pairs(rows.withColumn("p", value))


def test_only_keys_above_an_even_share_are_cut(spark, skewed):
    cuts, dense = _cuts(skewed, ["k"], ["at", "n"])
    parts = skewed.select("k", cuts.alias("s")).groupBy("k").agg(F.countDistinct("s").alias("c")).collect()
    assert {r["k"]: r["c"] > 1 for r in parts} == {r["k"]: r["k"] == "hot" for r in parts} and dense
    assert _cuts(spark.range(100), ["id"], ["id"]) == (None, False) == _cuts(skewed.limit(0), ["k"], ["n"])
    # Many keys that share a hot first column are dealt by the whole key.
    wide = spark.range(4000).select((F.col("id") % 1).alias("e"), "id")
    assert _cuts(wide, ["e", "id"], ["id"]) == (None, True)
    plan = last_before(wide, ["e", "id"], ["id"], None, F.col("id"), "p")._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(e#" in plan and "REPARTITION_BY_COL" in plan


def test_global_rank_is_the_window_rank(skewed):
    order = [F.col("v").asc_nulls_last(), F.col("n").asc()]
    expected = skewed.withColumn("p", F.row_number().over(Window.orderBy(*order)))
    assert pairs(global_rank(skewed, order, "p", 5)) == pairs(expected)


def test_page_of_a_sorted_result(skewed):
    order = [F.col("n").desc()]
    assert [r["n"] for r in top_k(skewed, order, 3, offset=2).orderBy("rank").collect()] == [2997, 2996, 2995]


def test_latest_both_ways(skewed):
    window = latest(skewed, ["k"], ["at", "n"])
    aggregate = latest_by_aggregate(skewed, ["k"], ["at", "n"])
    assert pairs(window, "v") == pairs(aggregate, "v")


def test_latest_reduces_before_the_shuffle(skewed):
    plan = latest(skewed, ["k"], ["at", "n"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_unique_or_fail(skewed):
    assert unique_or_fail(skewed, ["n"], "row").count() == 3000
    with pytest.raises(Exception, match="duplicate row identity"):
        unique_or_fail(skewed, ["k"], "row").collect()


def test_top_rows_per_key_take_one_shuffle_if_a_task_can_reduce_them(spark):
    rows = spark.range(5000).select((F.col("id") % 7).alias("k"), F.pmod(F.xxhash64("id"), F.lit(1000)).alias("v"), "id").repartition(5)
    order = [F.col("v").desc(), F.col("id")]
    for limit, exchanges in ((3, 1), (20, 1), (1500, 2)):
        got = top_per_key(rows, ["k"], order, limit, "rn")
        plan = got._jdf.queryExecution().executedPlan().toString()
        want = rows.withColumn("rn", F.row_number().over(Window.partitionBy("k").orderBy(*order))).filter(F.col("rn") <= limit)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
        assert plan.count("Exchange hashpartitioning") == exchanges and (exchanges == 2 or "WindowGroupLimit" in plan)
