"""Mixing sources to target weights by pivotal dependent rounding.

Each source gets a target number of words; a document of it is wanted ``rate = target / source size`` times. The
whole part of the rate is taken at once. The fraction left is a copy probability, and documents pair up
to round it: a pair moves probability between its two members at random, in the ratio of their sizes, until one
of them is sure (0 or 1). Every document keeps its own probability, and the words a source takes stay
the same at each step. A block of about ``BLOCK`` documents is folded this way to one document that is still
open; the open ones of all blocks fold again, level by level, until a source has one, which goes to the nearer side.
So a source misses its target by at most half the size of one document; the longest documents of a block pair
first, so the one left is mostly short.

Blocks come from a hash of the id, so a source with a third of all rows is as many blocks as it needs.
Only DataFrame functions are used.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedback_engine.llm.common import names, unit
from feedback_engine.session import materialize

BLOCK = 256
WEIGHTS = (3, 1, 2)
UNIT = "struct<size:bigint,h:bigint,uid:bigint,id:bigint,p:double>"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long"), F.lit(0))


def source_targets(
    sizes: DataFrame, share: float = 1.5, most: float = 2.0, weights: Sequence[int] = WEIGHTS
) -> DataFrame:
    """(source, source_size, n_docs) -> the same with ``target``. One row per source, so windows stay small.

    Sources by code point, null last, weigh ``weights`` in turn. Targets share ``share`` of all words by weight;
    none is above ``most`` times its source's words, what would be above goes to the others by weight. The source
    with the smallest ``most * size / weight`` reaches its limit first, so with the sources in that order the
    final words per weight follow from prefix sums.
    """
    everything = Window.partitionBy(F.lit(1))
    by_name = everything.orderBy(F.col("source").asc_nulls_last())
    position = (F.row_number().over(by_name) - 1) % len(weights)
    weighed = sizes.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (position + 1).cast("int")).cast("double"))
    limit = F.col("source_size") * most
    order = everything.orderBy(limit / F.col("w"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum("source_size").over(everything) * share
    left = total - F.coalesce(F.sum(limit).over(before), F.lit(0.0))
    weight_left = F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0))
    per_weight = weighed.withColumn("level", left / weight_left).withColumn("at_limit", F.col("level") * F.col("w") > limit)
    level = F.first(F.when(~F.col("at_limit"), F.col("level")), ignorenulls=True).over(
        order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    )
    return (
        per_weight.withColumn("final", level)
        .withColumn("target", F.when(F.col("final").isNull(), limit).otherwise(F.least(F.col("final") * F.col("w"), limit)))
        .drop("w", "level", "at_limit", "final")
    )


def _fold(units: Column, seed: int) -> Column:
    """Fold sorted units pairwise: array of units, all sure (p is 0 or 1) but at most one, the last."""

    def step(state: Column, b: Column) -> Column:
        a, done = state["open"], state["done"]
        ratio = a["size"] / b["size"]  # what a gives up in probability, b gets times this
        up, down = F.least(1 - a["p"], b["p"] / ratio), F.least(a["p"], (1 - b["p"]) / ratio)
        raise_a = unit(seed, a["h"], b["h"]) * (up + down) < down
        a_sure = F.when(raise_a, (1 - a["p"]) * ratio <= b["p"]).otherwise(a["p"] * ratio <= 1 - b["p"])
        sure_p = F.when(a_sure == raise_a, 1.0).otherwise(0.0)
        open_p = (
            F.when(a_sure & raise_a, b["p"] - (1 - a["p"]) * ratio)
            .when(a_sure, b["p"] + a["p"] * ratio)
            .when(raise_a, a["p"] + b["p"] / ratio)
            .otherwise(a["p"] - (1 - b["p"]) / ratio)
        )

        def with_p(pick: Column, p: Column) -> Column:
            fields = [F.when(pick, a[f]).otherwise(b[f]).alias(f) for f in ("size", "h", "uid", "id")]
            return F.struct(*fields, F.least(F.greatest(p, F.lit(0.0)), F.lit(1.0)).alias("p")).cast(UNIT)

        a_is_sure = (a["p"] <= 1e-12) | (a["p"] >= 1 - 1e-12)
        sure = F.when(a_is_sure, F.struct(a["size"], a["h"], a["uid"], a["id"], F.round(a["p"]).alias("p")).cast(UNIT)).otherwise(
            with_p(a_sure, sure_p)
        )
        still = F.when(a_is_sure, b.cast(UNIT)).otherwise(with_p(~a_sure, open_p))
        return F.struct(still.alias("open"), F.concat(done, F.array(sure)).alias("done"))

    start = F.struct(units[0].cast(UNIT).alias("open"), F.array().cast(f"array<{UNIT}>").alias("done"))
    return F.aggregate(
        F.slice(units, 2, F.greatest(F.size(units) - 1, F.lit(0))), start, step,
        lambda s: F.concat(s["done"], F.array(s["open"])),
    )


def round_copies(open_rows: DataFrame, most_docs: int, seed: int, block: int = BLOCK) -> DataFrame:
    """(source, h, uid, id, size, p) with 0 < p < 1 -> (source, uid, id, size, extra): a copy more or not.

    ``most_docs`` is the largest source's row count; it sets the number of levels (three for 16 million rows).
    """
    decided, level, count = [], open_rows, most_docs
    row = F.struct("size", "h", "uid", "id", "p")
    while True:
        blocks = max(1, -(-count // block))
        folded = level.groupBy("source", F.pmod("h", F.lit(blocks)).alias("block")).agg(
            F.sort_array(F.collect_list(row), asc=False).alias("units")
        )
        out = folded.select("source", F.explode(_fold(F.col("units"), seed)).alias("u")).select("source", "u.*")
        out = materialize(out, "rounded")
        sure = (F.col("p") <= 1e-12) | (F.col("p") >= 1 - 1e-12)
        decided.append(out.where(sure).withColumn("extra", F.round("p").cast("long")))
        level = out.where(~sure).withColumn("h", F.xxhash64(F.col("h"), F.lit(seed + len(decided))))
        if blocks == 1:
            decided.append(level.withColumn("extra", (F.col("p") >= 0.5).cast("long")))
            break
        count = blocks
    result = decided[0]
    for part in decided[1:]:
        result = result.unionByName(part)
    return result.select("source", "uid", "id", "size", "extra")


def mix(
    sized: DataFrame, share: float = 1.5, most: float = 2.0, weights: Sequence[int] = WEIGHTS, seed: int = 7
) -> DataFrame:
    """(uid, id, source, size) -> the same rows with source_size, target, copies.

    ``sized`` must be a stored table, as it is read twice. Null or empty texts have size 0 and no copies. A null
    source is a source of its own. Rows that repeat an id are rounded one by one. An empty table gives an empty
    table.
    """
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    targets = materialize(source_targets(totals, share, most, weights), "source-targets")
    most_docs = targets.agg(F.max("n_docs")).first()[0] or 1
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rates = targets.select(
        F.col("source").alias("source_"), "source_size", "target", F.floor(rate).alias("whole"), (rate - F.floor(rate)).alias("p")
    )
    near = F.col("p") > 1 - 1e-12
    rates = rates.withColumns(
        {"whole": F.col("whole") + near.cast("long"), "p": F.when(near | (F.col("p") < 1e-12), 0.0).otherwise(F.col("p"))}
    )
    # one row per source: broadcast while small, else Spark's skew join deals a hot source's rows anew
    rated = sized.join(rates, F.col("source").eqNullSafe(F.col("source_")), "left").drop("source_")
    takes_part = (F.col("p") > 0) & (F.col("size") > 0)
    opened = rated.where(takes_part).select(
        "source", F.xxhash64(F.lit(seed), F.coalesce("id", "uid"), "size").alias("h"), "uid", "id", "size", "p"
    )
    extra = round_copies(opened, most_docs, seed)
    rounded = extra.join(rates, F.col("source").eqNullSafe(F.col("source_")), "left").drop("source_", "p")
    plain = rated.where(~takes_part).drop("p").withColumn("extra", F.lit(0).cast("long"))
    columns = ["uid", "id", "source", "size", "source_size", "target"]
    copies = F.when(F.col("size") > 0, F.col("whole") + F.col("extra")).otherwise(0).cast("long").alias("copies")
    return rounded.select(*columns, copies).unionByName(plain.select(*columns, copies))


def mixed_counts(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options
) -> DataFrame:
    """One row per document: id, size, source_size, target, taken (words the mix takes, repeats counted)."""
    sized = materialize(
        docs.select(
            F.monotonically_increasing_id().alias("uid"),
            F.col(f"`{id_col}`").cast("long").alias("id"),
            F.col(f"`{source_col}`").cast("string").alias("source"),
            n_words(F.col(f"`{text_col}`")).alias("size"),
        ),
        "sized",
    )
    return mix(sized, **options).select(
        F.col("id").alias(id_col), "size", "source_size", F.col("target").cast("double").alias("target"),
        (F.col("copies") * F.col("size")).alias("taken"),
    )


def mixed_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options
) -> DataFrame:
    """``docs`` as the mix takes them: a row for each copy, with the columns of ``docs``.

    Rows are told apart by a hash of all their columns. Rows equal in all columns share the list of their
    copies: the first of them takes the first entry, and so on.
    """
    n = names(docs, "key", "at", "copies")
    columns = [f"`{c}`" for c in docs.columns]
    keyed = docs.withColumn(n["key"], F.xxhash64(*[F.col(c) for c in columns]))
    sized = materialize(
        keyed.select(
            F.col(n["key"]).alias("uid"),
            F.col(f"`{id_col}`").cast("long").alias("id"),
            F.col(f"`{source_col}`").cast("string").alias("source"),
            n_words(F.col(f"`{text_col}`")).alias("size"),
        ),
        "sized",
    )
    taken = mix(sized, **options).where("copies > 0").groupBy("uid").agg(F.sum("copies").alias("c"), F.count("*").alias("n"))
    taken = taken.select(F.col("uid").alias(n["key"]), F.col("c").alias(n["copies"]), F.col("n").alias(n["at"]))
    joined = keyed.join(taken, n["key"])
    # rows equal in every column are interchangeable: their copies are written from the first of them
    alone = joined.where(F.col(n["at"]) == 1).withColumn(n["at"], F.explode(F.sequence(F.lit(1), F.col(n["copies"]).cast("int"))))
    repeated = joined.where(F.col(n["at"]) > 1).dropDuplicates([n["key"]]).withColumn(
        n["at"], F.explode(F.sequence(F.lit(1), F.col(n["copies"]).cast("int")))
    )
    return alone.select(*columns).unionByName(repeated.select(*columns))
