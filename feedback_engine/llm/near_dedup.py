"""MinHash near-dedup with bottom-k sketches.

One hash function orders all shingles; a document keeps its ``K`` smallest values (all, if it has fewer). Equal
shingle sets are one node from the start, so groups of exact copies cost nothing further.

Inverted lists of retained values generate overlaps. Two sets with Jaccard >= 0.75 share at least ``need`` retained
values (see ``needed``), so they meet in a list even if each posts only its rarest values, all but ``need - 1`` of
them: values that many documents share (common passages) are posted only by documents that consist of little else.
A list never emits all its pairs at first: its members pair with one centre. Estimates from the union of two
sketches filter these pairs, and exact Jaccard on full shingle sets confirms them. Confirmed links are contracted to
components by hash joins. Lists that then still hold several components pair across components only, again with a
filter and an exact check, so no link between different texts is lost; large groups of copies have become
one component by then. Long lists still open (members that share much, but less than a link takes) are blocks whose full
sets are kept as differences from a common base (``blocks``): what most members share counts for nothing, and near copies
of one text with changes of their own drop out before they become pairs. This step is exact.

Documents are hashed with numpy in slices of some MB of text; whole sets lie in a stored table and are compared by Spark.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedback_engine.llm.blocks import certain_links, differences, open_pairs, size_fits
from feedback_engine.llm.common import join_counted, names
from feedback_engine.llm.sets import linked, set_rows, whole_sets
from feedback_engine.session import materialize

K = 128
WORDS = 5
SHARE = 75  # percent of the union
STARS = 1  # centres that lists try before components pair
SHORT_LIST = 16  # members of an open list that pair directly


def needed(n: Column) -> Column:
    """Retained values that a set of ``n`` shingles shares at least with any set it must be linked with.

    Up to 95 shingles the partner (at most n / 0.75) is retained whole as well: 0.75 n, certain. Beyond that
    the K smallest values of the union are shared with probability 0.75 each: 67 of 128 or more, but for 2 in ten million
    pairs exactly at the threshold, and far fewer above it.
    """
    return F.when(n <= K * 3 // 4 - 1, F.ceil(n * (SHARE / 100))).otherwise(67).cast("int")


def sketches(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(id, n, fp, fp2, vals) of (id, text): size, two fingerprints of the set, its retained values."""
    return set_rows(docs, words, lambda n: np.minimum(n, K))


def postings(nodes: DataFrame) -> DataFrame:
    """(node, n, v): the rarest retained values of each node, as many as ``needed`` leaves, but no value of one node."""
    posted = nodes.select("node", "n", F.explode("vals").alias("v"))
    often = posted.groupBy("v").agg(F.count("*").alias("df")).where("df > 1")
    common = (
        posted.join(often, "v")
        .groupBy("node", "n")
        .agg(F.array_sort(F.collect_list(F.struct("df", "v"))).alias("by_rarity"))  # at most K values
    )
    retained = F.least(F.col("n"), F.lit(K)).cast("int")
    prefix = retained - needed(F.col("n")) + 1  # rarest values to post; those of df 1 come first
    some = prefix - (retained - F.size("by_rarity"))
    return common.where(some > 0).select("node", "n", F.explode(F.slice("by_rarity", 1, some)).alias("p")).select(
        "node", "n", F.col("p.v").alias("v")
    )


def estimated(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(a, b) -> (a, b, sure): pairs whose sketches allow Jaccard >= 0.75.

    ``sure``: both sets are retained whole, so the estimate is the exact answer.
    """
    both = pairs.join(nodes.selectExpr("node a", "n na", "vals va"), "a").join(
        nodes.selectExpr("node b", "n nb", "vals vb"), "b"
    )
    whole = (F.col("na") <= K) & (F.col("nb") <= K)
    inter = F.size(F.array_intersect("va", "vb"))
    # rank of a value in the union of two sketches is at most K if fewer than K smaller values exist in it
    union = F.slice(F.array_sort(F.array_union(F.transform("va", _unsigned), F.transform("vb", _unsigned))), 1, K)
    common = F.size(F.array_intersect(union, F.array_intersect(F.transform("va", _unsigned), F.transform("vb", _unsigned))))
    exact = inter * 100 >= (F.col("na") + F.col("nb") - inter) * SHARE
    return both.where(F.when(whole, exact).otherwise(common >= 67)).select("a", "b", whole.alias("sure"))


def _unsigned(v: Column) -> Column:
    """Order of unsigned values in signed longs."""
    return v.bitwiseXOR(F.lit(-(1 << 63)))


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose whole sets have Jaccard >= 0.75. ``pairs`` is a stored table."""
    return pairs.where("sure").select("a", "b").union(linked(pairs.where("not sure").select("a", "b"), sets, SHARE))


def components(links: DataFrame) -> DataFrame:
    """(a, b) -> (node, label): the smallest node reachable, for each node with a link.

    Each round hangs every node under its smallest neighbour, halves the paths, and contracts the links; what is
    left shrinks at least by half. All steps are joins and minima combined before the shuffle.
    """
    edges = materialize(links.where("a <> b").selectExpr("least(a, b) a", "greatest(a, b) b").distinct(), "links")
    labels = None
    while not edges.isEmpty():
        both = edges.union(edges.selectExpr("b a", "a b"))
        parent = materialize(both.groupBy("a").agg(F.min("b").alias("m")).selectExpr("a node", "least(a, m) parent"), "parents")
        while True:  # pointer doubling: log of the depth
            up = parent.selectExpr("node parent", "parent grand")
            doubled = materialize(
                parent.join(up, "parent", "left").selectExpr("node", "coalesce(grand, parent) parent", "parent <> coalesce(grand, parent) moved"),
                "parents",
            )
            parent = doubled.select("node", "parent")
            if doubled.where("moved").isEmpty():
                break
        if labels is None:
            labels = parent.selectExpr("node", "parent label")
        else:
            step = parent.selectExpr("node label", "parent next")
            labels = labels.join(step, "label", "left").selectExpr("node", "coalesce(next, label) label")
        labels = materialize(labels, "labels")
        edges = materialize(
            edges.join(parent.selectExpr("node a", "parent pa"), "a").join(parent.selectExpr("node b", "parent pb"), "b")
            .where("pa <> pb").selectExpr("least(pa, pb) a", "greatest(pa, pb) b").distinct(),
            "links",
        )
    return labels if labels is not None else edges.selectExpr("a node", "b label")


def _labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    return rows.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_shingles, component_id, kept.

    Documents are linked when 100 * shared shingles >= 75 * all shingles of both; ``component_id`` is the
    smallest id reachable. Null, empty and word-less texts have no shingles and are linked with nothing. Texts with
    fewer than five words are one shingle. Rows that repeat an id with one text share a verdict; null ids are never
    the smallest unless alone. An empty table gives an empty table. Other columns are not read.
    """
    narrow = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    table = materialize(sketches(narrow).withColumn("row", F.monotonically_increasing_id()), "sketches")
    # a node is a distinct shingle set, named by one of its rows
    named = table.where("n > 0")
    groups = named.groupBy("n", "fp", "fp2").agg(F.min("id").alias("id"), F.min("row").alias("node"), F.count("*").alias("copies"))
    groups = materialize(groups, "sets")
    nodes = named.select(F.col("row").alias("node"), "n", "vals").join(groups.select("node"), "node", "left_semi")
    nodes = materialize(nodes, "nodes")

    posted = materialize(postings(nodes), "postings")
    n_posted = posted.count()
    wanted = groups.join(posted.select("node").distinct(), "node").drop("copies")
    sets = materialize(whole_sets(narrow, wanted, WORDS), "whole-sets")
    labels = links = tried = lists = None
    for turn in range(STARS):
        # a list's first centre is its smallest set; later ones differ from list to list, only components count then
        marked = posted.withColumn("label", F.col("node")) if labels is None else _labelled(posted, labels)
        first = F.struct("n", "node") if labels is None else F.struct(F.xxhash64("node", "v", F.lit(turn)).alias("h"), "n", "node")
        centred = marked.groupBy("v").agg(
            F.count("*").alias("members"), F.min(F.struct(first.alias("by"), "label")).alias("centre"),
            F.min("label").alias("low"), F.max("label").alias("high"),
        )
        centred = centred.where("low <> high").selectExpr("v", "members", "centre.by.node c", "centre.by.n nc", "centre.label lc")
        centred = materialize(centred, "lists")
        lists = lists if lists is not None else centred
        stars = (
            join_counted(marked, centred, ["v"], "members", n_posted, F.col("node"))
            .where("c is not null and label <> lc").where(size_fits("n", "nc", SHARE))
            .selectExpr("least(node, c) a", "greatest(node, c) b").distinct()
        )
        stars = materialize(stars if tried is None else stars.join(tried, ["a", "b"], "left_anti"), "pairs")
        passed = materialize(estimated(stars, nodes), "estimated")
        found = materialize(confirmed(passed, sets), "confirmed")
        tried = stars if tried is None else tried.union(stars)
        links = found if links is None else links.union(found)
        labels = components(links)

    # lists that still hold several components
    marked = _labelled(posted, labels)
    mixed = marked.groupBy("v").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("members"))
    open_lists = materialize(mixed.where("low <> high").select("v", "members"), "open-lists")
    short = marked.join(open_lists.where(F.col("members") <= SHORT_LIST), "v")
    short = materialize(short.select("v", "node", "n", "label"), "short-lists")
    left, right = short.selectExpr("v", "node a", "n na", "label la"), short.selectExpr("v", "node b", "n nb", "label lb")
    across = left.join(right, "v").where("a < b and la <> lb").where(size_fits("na", "nb", SHARE)).select("a", "b")
    rest = materialize(across.distinct().join(tried, ["a", "b"], "left_anti"), "pairs-across")
    tried = tried.union(rest)
    links = links.union(materialize(confirmed(materialize(estimated(rest, nodes), "estimated"), sets), "confirmed"))

    long = open_lists.where(F.col("members") > SHORT_LIST).join(lists.selectExpr("v", "c block"), "v").select("v", "block")
    members = materialize(posted.join(long, "v").select("block", "node").distinct(), "long-lists")
    apart = differences(members, sets, SHARE)
    links = links.union(materialize(certain_links(apart), "certain-links"))
    pairs = open_pairs(apart, components(links), SHARE).join(tried, ["a", "b"], "left_anti")
    links = links.union(materialize(linked(pairs, sets, SHARE), "confirmed"))
    labels = components(links)

    named_groups = _labelled(groups, labels)
    smallest = named_groups.groupBy("label").agg(F.min("id").alias("component"))
    of_set = named_groups.join(smallest, "label").select("n", "fp", "fp2", "copies", "component")
    rows = table.select("id", "n", "fp", "fp2", "row")
    found = join_counted(rows, materialize(of_set, "components"), ["n", "fp", "fp2"], "copies", table.count(), F.col("row"))
    component = F.coalesce("component", "id")
    return found.select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"),
        F.col("id").eqNullSafe(component).alias("kept"),
    )


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each group: the one whose id is the group's smallest.

    Rows that repeat an id stay together; drop exact duplicates first to have one of them.
    """
    gone_id = names(docs, "gone")["gone"]
    gone = near_duplicates(docs, id_col, text_col).where("not kept").select(F.col(id_col).alias(gone_id)).distinct()
    gone = materialize(gone, "near-duplicates")
    return docs.join(gone, F.col(f"`{id_col}`").cast("long") == F.col(gone_id), "left_anti")
