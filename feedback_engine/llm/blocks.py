"""Pairs of similar sets within large blocks, without pairing all members.

A block's base holds the values that more than half of its members have. A member is kept as its difference D from the
base, |D| small for near copies of one text. With S percent of the union to share, two sets are linked exactly when they
differ in at most k (n_a + n_b) values, k = (100 - S) / (100 + S). With d = (100 + S) |D| - (100 - S) n:

* members with d_a + d_b <= 0 are linked for certain (the differences alone do not add up to more);
* any other linked pair shares at least (d_a + d_b) / (2 (100 + S)) values of its D, a positive number.

So certain links are contracted without a pair join. What is left posts the values of its D, rarest first, as
far as a partner of another component could need them. Values that most members share are not in D at all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedback_engine.llm.common import join_counted
from feedback_engine.session import materialize


def differences(members: DataFrame, sets: DataFrame, share: int) -> DataFrame:
    """(block, node) and (node, n, vals) -> stored (block, node, n, n_apart, d, apart)."""
    held = materialize(members.join(sets, "node").select("block", "node", "n", "vals"), "block-sets")
    sizes = held.groupBy("block").agg(F.count("*").alias("members"))
    counts = held.select("block", F.explode("vals").alias("v")).groupBy("block", "v").agg(F.count("*").alias("c"))
    counts = counts.where("c > 1")  # what one member holds alone is no base and need not meet its block
    # at most twice the mean set size of values: they are in more than half of the members
    base = counts.join(sizes, "block").where("2 * c > members").groupBy("block").agg(F.collect_list("v").alias("base"))
    bases = sizes.join(base, "block", "left").withColumn("base", F.coalesce("base", F.array().cast("array<long>")))
    bases = materialize(bases, "bases")
    joined = join_counted(held, bases, ["block"], "members", held.count(), F.col("node"))
    apart = F.concat(F.array_except("vals", "base"), F.array_except("base", "vals"))
    found = joined.select("block", "node", "n", apart.alias("apart")).withColumn("n_apart", F.size("apart").cast("long"))
    found = found.withColumn("d", F.col("n_apart") * (100 + share) - F.col("n") * (100 - share))
    return materialize(found, "differences")


def certain_links(apart: DataFrame) -> DataFrame:
    """(a, b): members whose differences from the base prove a link, each with its block's nearest member."""
    small = apart.select("block", "node", "d")
    nearest = small.groupBy("block").agg(F.count("*").alias("members"), F.min(F.struct("d", "node")).alias("near"))
    nearest = materialize(nearest.selectExpr("block", "members", "near.d near_d", "near.node near_node"), "nearest")
    joined = join_counted(small, nearest, ["block"], "members", small.count(), F.col("node"))
    return joined.where("d + near_d <= 0 and node <> near_node").selectExpr(
        "least(node, near_node) a", "greatest(node, near_node) b"
    )


def open_pairs(apart: DataFrame, labels: DataFrame, share: int) -> DataFrame:
    """(a, b): pairs of different labels that can be linked. ``labels``: (node, label) of the nodes with a link."""
    marked = apart.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    marked = materialize(marked, "labelled")
    per_label = materialize(marked.groupBy("block", "label").agg(F.min("d").alias("d"), F.count("*").alias("c")), "label-stats")
    first = per_label.groupBy("block").agg(F.sum("c").alias("members"), F.min(F.struct("d", "label")).alias("low"))
    first = materialize(first.selectExpr("block", "members", "low.d d1", "low.label label1"), "low")
    second = per_label.join(first.select("block", "label1"), "block").where("label <> label1")
    stats = materialize(first.join(second.groupBy("block").agg(F.min("d").alias("d2")), "block"), "block-stats")
    joined = join_counted(marked, stats, ["block"], "members", marked.count(), F.col("node")).where("d1 is not null")
    other = F.when(F.col("label") == F.col("label1"), F.col("d2")).otherwise(F.col("d1"))
    # a partner b has |D_b| >= |D| - k (n + n_b) and n_b <= 100 n / S
    by_size = F.ceil(F.col("n_apart") - F.col("n") * (100 - share) / share - 1e-6)
    least = F.greatest(F.lit(1), F.ceil((F.col("d") + other) / (2.0 * (100 + share)) - 1e-6), by_size).cast("long")
    alive = joined.withColumn("least", least).where(F.col("least") <= F.col("n_apart"))
    keys = ["block", "node", "label", "n", "n_apart", "d", "least"]
    rows = materialize(alive.select(*keys, F.explode("apart").alias("v")), "apart-values")
    often = rows.groupBy("block", "v").agg(F.count("*").alias("df")).where("df > 1")
    common = rows.join(often, ["block", "v"]).groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("df", "v"))).alias("by_rarity")
    )
    alone = F.col("n_apart") - F.size("by_rarity")  # values of one member come first
    posted = common.select(*keys, alone.alias("alone"), F.posexplode("by_rarity").alias("at", "p")).select(
        *keys, F.col("p.v").alias("v"), (F.col("n_apart") - F.col("alone") - F.col("at")).alias("left")
    )
    posted = materialize(posted.where("left >= least"), "apart-postings")
    a = posted.selectExpr("block", "v", "node a", "label la", "n na", "left ra", "d da")
    b = posted.selectExpr("block", "v", "node b", "label lb", "n nb", "left rb", "d db")
    enough = F.least("ra", "rb") >= (F.col("da") + F.col("db")) / (2.0 * (100 + share)) - 1e-6
    on = (a["block"] == b["block"]) & (a["v"] == b["v"]) & (F.col("a") < F.col("b")) & (F.col("la") != F.col("lb"))
    return a.join(b, on & enough & size_fits("na", "nb", share)).select("a", "b").distinct()


def size_fits(a: str, b: str, share: int) -> Column:
    return (F.col(a) * 100 >= F.col(b) * share) & (F.col(b) * 100 >= F.col(a) * share)
