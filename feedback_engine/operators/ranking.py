"""Ordered computations that stay parallel when one group holds most of the rows.

A plain window over (group) puts a whole group in one task. Here the order is first cut into
buckets; a bucket's offset comes from per-bucket totals (a small table), and the row-level
window only ever sees one (group, bucket). Results are exact for any bucketing that follows
the order.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import WindowSpec

from feedback_engine.session import materialize

MD5_PREFIX = 3  # 4,096 buckets of equal expected size
SPLITS = 64


def whole() -> WindowSpec:
    """All rows as one window. Only for tables that grouping has already made small."""
    return Window.partitionBy(F.lit(1))


def explode_terms(df: DataFrame, keep: Sequence[str], array: Column | str, names: Sequence[str]) -> DataFrame:
    """One row per array element (struct fields side by side), empty arrays dropped.

    The outer form with a filter on the result is deliberate: for the inner form Spark adds
    ``size(array) > 0`` below the explode and repeats the array's whole computation there.
    """
    generate = F.inline_outer(array) if len(names) > 1 else F.explode_outer(array)
    rows = df.select(*keep, generate.alias(*names))
    return rows.where(F.col(names[0]).isNotNull())


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key: the first in ``order``.

    ``row_number() = 1`` lets Spark keep one row per key in each map task before the shuffle,
    so a key with a third of all rows sends only one row per task.
    """
    return head_per_group(df, keys, order, 1)


def head_per_group(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int
) -> DataFrame:
    """First ``n`` rows per key. Spark limits map-side up to an ``n`` of 1,000; beyond it take ``head_per_group_large``."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(window)).where(F.col("_rn") <= n).drop("_rn")


BINS = 1_024
TEXT_STEPS = 4  # of six bytes each


def _levels(df: DataFrame, order: Sequence[tuple[str, bool]]) -> list[Column]:
    """Doubles that rise with the order, none out of turn; equal ones are told apart by the next level."""
    levels = []
    for name, descending in order:
        value = F.col(name)
        if isinstance(df.schema[name].dataType, T.StringType):
            for step in range(TEXT_STEPS):
                part = F.rpad(F.hex(F.substring(F.encode(value, "UTF-8"), 6 * step + 1, 6)), 12, "0")
                number = F.conv(part, 16, 10).cast("double")
                levels.append(F.coalesce(-number if descending else number, F.lit(float("inf") if descending else float("-inf"))))
            break  # what follows a text only counts between equal texts
        number = F.nanvl(value.cast("double"), F.lit(float("inf")))
        levels.append(F.coalesce(-number if descending else number, F.lit(float("inf") if descending else float("-inf"))))
    return levels


def _narrowed(regions: DataFrame, rows: DataFrame, keys: Sequence[str], level: str) -> DataFrame:
    """Each region cut down to the bin of its values that holds the row it needs. ``rows``: keys, level, region's columns."""
    width = F.col("hi") - F.col("lo")
    place = F.when(width > 0, F.least(F.floor((F.col(level) - F.col("lo")) / width * BINS), F.lit(BINS - 1))).otherwise(0)
    # bounds may be infinite: such values are bins of their own
    place = F.when(F.col(level) == F.col("lo"), -1).when(F.col(level) == F.col("hi"), BINS).otherwise(F.coalesce(place, F.lit(0)))
    bins = rows.groupBy(*keys, "need", place.alias("_bin")).agg(
        F.min(level).alias("lo"), F.max(level).alias("hi"), F.count(F.lit(1)).alias("n")
    )
    upto = F.sum("n").over(Window.partitionBy(*keys).orderBy("_bin"))  # at most BINS + 2 rows a group
    return (
        bins.withColumn("_upto", upto)
        .where((F.col("_upto") >= F.col("need")) & (F.col("_upto") - F.col("n") < F.col("need")))
        .withColumn("need", F.col("need") - F.col("_upto") + F.col("n"))
        .select(*keys, "need", "lo", "hi", "n")
    )


def large_group_survivors(
    df: DataFrame, keys: Sequence[str], order: Sequence[tuple[str, bool]], n: int, slack: int = 4
) -> DataFrame:
    """Rows that can be among the first ``n`` of their group: these, and at most ``slack * n`` more of a group.

    The n-th row of each large group is found by refining histograms: a pass counts the group's rows in bins between two
    bounds and keeps the bin that holds the row, until few rows or equal ones are left in it; equal rows go on with the next
    column of the order. ``df`` is read once a pass, so hand over a stored table. Rows equal in every numeric column and
    in the first ``6 * TEXT_STEPS`` bytes of the first text column all survive.
    """
    levels = {f"_l{i}": c for i, c in enumerate(_levels(df, order))}
    names = list(levels)
    rows = df.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], *[c.alias(name) for name, c in levels.items()])
    own = [f"_k{i}" for i in range(len(keys))]
    most = n * (1 + slack)
    regions = rows.groupBy(*own).agg(F.min("_l0").alias("lo"), F.max("_l0").alias("hi"), F.count(F.lit(1)).alias("n"))
    regions = materialize(regions.withColumn("need", F.lit(n).cast("long")).where(F.col("n") > most), "regions")
    cuts = None  # of large groups: exact values of the levels passed, upper bound of the last one
    passed: list[str] = []
    for level in names:
        done = None
        while True:
            ready = (F.col("n") <= n * slack) | (F.col("lo") == F.col("hi"))
            finished = regions.where(ready)
            done = finished if done is None else done.unionByName(finished)
            regions = regions.where(~ready)
            if regions.isEmpty():
                break
            bounds = regions.select(*own, *passed, "need", "lo", "hi")
            inside = _within(rows, bounds, own, passed, level)
            narrowed = _narrowed(regions, inside, own, level)
            kept = regions.select(*own, *passed)
            regions = materialize(_joined_on(narrowed, kept, own) if passed else narrowed, "regions")
        done = materialize(done, "regions-done")
        last = level == names[-1]
        final = done if last else done.where(F.col("n") <= n * slack)
        bound = final.select(*own, *passed, F.col("hi").alias(level))
        for missing in names[len(passed) + 1 :]:
            bound = bound.withColumn(missing, F.lit(None).cast("double"))
        cuts = bound.select(*own, *names) if cuts is None else cuts.unionByName(bound.select(*own, *names))
        if last:
            break
        tied = done.where(F.col("n") > n * slack).select(*own, *passed, F.col("lo").alias(level), "need", F.lit(0.0).alias("lo"), F.lit(0.0).alias("hi"), "n")
        if tied.isEmpty():
            break
        passed = [*passed, level]
        following = names[len(passed)]
        inside = _within(rows, tied.select(*own, *passed, "need"), own, passed, None)
        regions = materialize(
            inside.groupBy(*own, *passed, "need").agg(
                F.min(following).alias("lo"), F.max(following).alias("hi"), F.count(F.lit(1)).alias("n")
            ),
            "regions",
        )
    cuts = materialize(cuts, "cuts")
    better, equal = F.lit(False), F.lit(True)
    for name in names:
        limit = F.col(f"_c{name}")
        better = better | (equal & (F.col(name) < limit))
        equal = equal & (limit.isNull() | (F.col(name) == limit))
    renamed = cuts.select(*own, F.lit(True).alias("_cut"), *[F.col(x).alias(f"_c{x}") for x in names])
    full = df.withColumns({**{f"_k{i}": F.col(k) for i, k in enumerate(keys)}, **levels})
    joined = _joined_on(full, renamed, own, "left")
    return joined.where(F.col("_cut").isNull() | better | equal).select(*df.columns)


def _joined_on(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on keys that may be null; the keys come once."""
    other = right.select(*[F.col(c).alias(f"_r{c}") if c in keys else F.col(c) for c in right.columns])
    on = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"_r{k}")) for k in keys], F.lit(True))
    return left.join(other, on, how).drop(*[f"_r{k}" for k in keys])


def _within(rows: DataFrame, regions: DataFrame, own: Sequence[str], passed: Sequence[str], level: str | None) -> DataFrame:
    """Rows inside their group's region: equal on the levels passed, between the bounds on the next one."""
    fixed = regions.select(*[F.col(c).alias(f"_p{c}") if c in passed else F.col(c) for c in regions.columns])
    joined = _joined_on(rows, fixed, own)
    for name in passed:
        joined = joined.where(F.col(name) == F.col(f"_p{name}"))
    if level is not None:
        joined = joined.where(F.col(level).between(F.col("lo"), F.col("hi")))
    return joined


def head_per_group_large(
    df: DataFrame, keys: Sequence[str], order: Sequence[tuple[str, bool]], n: int
) -> DataFrame:
    """``head_per_group`` for an ``n`` in the thousands. ``order``: (column, descending), ties in Spark's order.

    Only rows that can be among the first reach the window that ranks them, at most ``5 n`` of a group but for equal rows.
    """
    survivors = large_group_survivors(materialize(df, "ranked-rows"), keys, order, n)
    return head_per_group(survivors, keys, [F.desc(c) if down else F.asc(c) for c, down in order], n)


def _same(a: str, b: str, names: Sequence[str]) -> Column:
    """Null-safe equality on the listed columns of two aliased frames."""
    return reduce(
        lambda x, y: x & y,
        [F.col(f"{a}.{n}").eqNullSafe(F.col(f"{b}.{n}")) for n in names],
        F.lit(True),
    )


def running_totals(
    df: DataFrame,
    groups: Sequence[str],
    bucket: Column,
    order: Sequence[Column],
    values: dict[str, Column],
    bucket_descending: bool = False,
) -> DataFrame:
    """Add ``cum_<name>`` (inclusive running sum) and ``all_<name>`` (group total) per value.

    ``bucket`` must be monotone in ``order``; it never changes the result, only the parallelism.
    """
    rows = df.withColumn("_b", bucket)
    for name, value in values.items():
        rows = rows.withColumn(f"_v_{name}", value)
    totals = rows.groupBy(*groups, "_b").agg(
        *[F.sum(f"_v_{name}").alias(f"_t_{name}") for name in values]
    )
    across = Window.partitionBy(*groups)
    ordered = across.orderBy(F.desc("_b") if bucket_descending else F.asc("_b"))
    offsets = totals.select(
        *groups,
        "_b",
        *[
            (F.sum(f"_t_{name}").over(ordered) - F.col(f"_t_{name}")).alias(f"_o_{name}")
            for name in values
        ],
        *[F.sum(f"_t_{name}").over(across).alias(f"all_{name}") for name in values],
    )
    inside = Window.partitionBy(*groups, "_b").orderBy(*order).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    ranked = rows.select(
        "*", *[F.sum(f"_v_{name}").over(inside).alias(f"_c_{name}") for name in values]
    )
    joined = ranked.alias("r").join(
        offsets.alias("o"), _same("r", "o", [*groups, "_b"]), "inner"
    )
    return joined.select(
        *[F.col(f"r.{c}") for c in df.columns],
        *[(F.col(f"_c_{name}") + F.col(f"_o_{name}")).alias(f"cum_{name}") for name in values],
        *[F.col(f"all_{name}") for name in values],
    )


def md5_rank(df: DataFrame, groups: Sequence[str], key: Column, seed: int) -> DataFrame:
    """Rank rows of a group by md5(key || seed): a repeatable shuffle. Adds cum_n and all_n."""
    hashed = df.withColumn("_md5", F.md5(F.concat(key.cast("string"), F.lit(str(seed)))))
    return running_totals(
        hashed,
        groups,
        F.substring("_md5", 1, MD5_PREFIX),
        [F.col("_md5"), key],
        {"n": F.lit(1).cast("long")},
    ).drop("_md5")


def with_value_bucket(
    counted: DataFrame, column: str, groups: Sequence[str] = (), splits: int = SPLITS
) -> DataFrame:
    """Add ``_vb``, a bucket of a numeric column that rises with it, each group cut at its own quantiles.

    ``counted`` (grouped rows) is stored first, so its input runs once. A mergeable quantile sketch per group gives the
    cuts in one pass over the stored rows; they only steer the parallelism, results do not depend on them.
    """
    stored = materialize(counted, "value-counts")
    ranks = F.array(*[F.lit(i / splits) for i in range(1, splits)])
    sketch = F.kll_sketch_agg_double(F.col(column).cast("double"))
    sketched = stored.groupBy(*groups).agg(sketch.alias("_k"))
    known = F.when(F.kll_sketch_get_n_double("_k") > 0, F.kll_sketch_get_quantile_double("_k", ranks))
    cuts = sketched.select(*groups, F.coalesce(known, F.array().cast("array<double>")).alias("_cuts"))
    joined = _joined_on(stored, cuts, groups) if groups else stored.crossJoin(F.broadcast(cuts))  # one row
    below = F.size(F.filter("_cuts", lambda cut: cut < F.col(column)))
    return joined.withColumn("_vb", below).drop("_cuts")


def exact_quantiles(
    df: DataFrame, groups: Sequence[str], column: str, quantiles: dict[str, float]
) -> DataFrame:
    """Exact quantiles with linear interpolation, one row per group.

    Works on (group, value) counts, so repeated values cost one row, and finds the two
    neighbouring ranks with a bucketed running count instead of one big value map.
    """
    counts = (
        df.where(F.col(column).isNotNull())
        .groupBy(*groups, F.col(column).cast("double").alias("_x"))
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    ranked = running_totals(
        with_value_bucket(counts, "_x", groups),
        groups,
        F.col("_vb"),
        [F.col("_x")],
        {"n": F.col("_n")},
    )
    low = F.col("cum_n") - F.col("_n")  # rows before this value

    def at_rank(rank: Column) -> Column:
        return F.max(F.when((low <= rank) & (rank < F.col("cum_n")), F.col("_x")))

    out = []
    for name, q in quantiles.items():
        position = F.lit(q) * (F.col("all_n") - 1)
        left, right = at_rank(F.floor(position)), at_rank(F.ceil(position))
        weight = F.max(position - F.floor(position))
        out.append((left + (right - left) * weight).alias(name))
    return ranked.groupBy(*groups).agg(*out)


def most_frequent(
    df: DataFrame, keys: Sequence[str], value: Column, name: str
) -> DataFrame:
    """Mode per key, smallest value on ties; counts are taken before the per-key step."""
    counts = df.groupBy(*keys, value.alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    best = F.min_by("_v", F.struct(-F.col("_n"), F.col("_v")))
    return counts.where(F.col("_v").isNotNull()).groupBy(*keys).agg(best.alias(name))
