from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from feedback_engine.operators import ranking as RK


@pytest.fixture(scope="module")
def table(spark):
    """One group with two thirds of the rows, heavy ties, nulls, extremes; texts with long common beginnings."""
    dice, data = random.Random(2), []
    for i in range(60_000):
        group = dice.choice(["big", "big", "big", "big", "mid", None])
        score = dice.choice([None, 0.0, 1.0, 1.0, 1.0, -5.0, float(dice.randrange(1000)), dice.random() * 1e-9, 1e300])
        data.append((group, score, f"common beginning {dice.randrange(9000):05d}" if i % 2 else chr(200 + i % 50) * 3, i))
    return spark.createDataFrame(data, "g string, score double, word string, i long").repartition(6)


ORDERS = [
    [("score", True), ("word", False), ("i", False)],
    [("score", False), ("i", True)],
    [("i", False)],
    [("word", True), ("i", False)],
]


@pytest.mark.parametrize("order", ORDERS)
@pytest.mark.parametrize("n", [1, 3000])
def test_equals_the_plain_window(table, order, n):
    plain = [F.desc(c) if down else F.asc(c) for c, down in order]
    want = RK.head_per_group(table, ["g"], plain, n)
    found = RK.head_per_group_large(table, ["g"], order, n)
    assert found.columns == table.columns
    assert sorted(r["i"] for r in found.collect()) == sorted(r["i"] for r in want.collect())


def test_only_survivors_are_ranked(table):
    """For n = 3,000 at most 5 n rows of a group reach the window, whatever the group's size."""
    survivors = RK.large_group_survivors(table, ["g"], ORDERS[0], 3000)
    sizes = {r["g"]: r["count"] for r in survivors.groupBy("g").count().collect()}
    assert 3000 <= sizes["big"] <= 15_000 < table.where("g = 'big'").count()
    plan = RK.head_per_group_large(table, ["g"], ORDERS[0], 3000)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Window") == 1 and plan.index("Window") < plan.index("_cut")  # the cut lies below the window


def test_small_and_empty_groups(spark, table):
    few = table.where("i < 50")
    assert RK.head_per_group_large(few, ["g"], ORDERS[0], 3000).count() == 50
    assert RK.head_per_group_large(table.where("false"), ["g"], ORDERS[0], 5).count() == 0
    both = RK.head_per_group_large(table, ["g", "score"], [("i", False)], 2)
    assert both.groupBy("g", "score").count().where("count > 2").isEmpty()


def test_each_group_is_cut_at_its_own_quantiles(spark):
    """Three groups of very different ranges and sizes, one null: no bucket holds much more than its share."""
    data = [("a", i / 20_000) for i in range(20_000)] + [("b", 1e9 + i) for i in range(2_000)] + [(None, -float(i)) for i in range(2_000)]
    df = spark.createDataFrame(data, "g string, x double")
    cut = RK.with_value_bucket(df.groupBy("g", "x").count(), "x", ["g"])
    assert cut.count() == len(data)
    sizes = cut.groupBy("g", "_vb").count()
    for r in sizes.groupBy("g").agg(F.max("count").alias("most"), F.sum("count").alias("all"), F.count("*").alias("n")).collect():
        assert r["n"] >= RK.SPLITS * 0.8 and r["most"] <= 3 * r["all"] / RK.SPLITS
    exact = {r["g"]: r["q"] for r in RK.exact_quantiles(df, ["g"], "x", {"q": 0.5}).collect()}
    assert exact["b"] == 1e9 + 999.5 and abs(exact["a"] - 9_999.5 / 20_000) < 1e-12 and exact[None] == -999.5


def test_quantiles_run_their_input_once(spark):
    """The input is evaluated for the stored counts and never again."""
    hits = spark.sparkContext.accumulator(0)

    def seen(x):
        hits.add(1)
        return float(x)

    once = F.udf(seen, "double").asNondeterministic()  # else a plan may hold it twice
    df = spark.range(500).select(F.lit("g").alias("g"), once("id").alias("x"))
    assert RK.exact_quantiles(df, ["g"], "x", {"q": 0.5}).first()["q"] == 249.5
    assert hits.value == 500
