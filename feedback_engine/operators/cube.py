"""One stored cube of counts per report: the records are read once, every fact comes from the cube."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedback_engine.session import materialize


@dataclass(frozen=True)
class FactCube:
    """Sums of the measures for each grouping set; ``_set`` is Spark's grouping id."""

    rows: DataFrame
    dims: tuple[str, ...]
    sets: tuple[frozenset, ...]
    measures: tuple[str, ...]

    def by(self, *dims: str) -> DataFrame:
        """Rows of one grouping set: its dimensions and the measures. A null value is a group of its own."""
        if frozenset(dims) not in self.sets:
            raise ValueError(f"the cube has no grouping by {dims}")
        absent = sum(1 << (len(self.dims) - 1 - i) for i, d in enumerate(self.dims) if d not in dims)
        return self.rows.where(F.col("_set") == absent).select(*dims, *self.measures)


def fact_cube(
    df: DataFrame, dims: Mapping[str, Column], sets: Sequence[Sequence[str]], measures: Mapping[str, Column]
) -> FactCube:
    """Sums of integer ``measures`` over each of ``sets``, computed in one pass over ``df`` and stored.

    The records are first grouped by all dimensions; only these groups are expanded into the grouping sets. ``()`` as
    a set gives the totals, no row when ``df`` is empty.
    """
    finest = df.select(
        *[c.alias(name) for name, c in dims.items()], *[m.cast("long").alias(name) for name, m in measures.items()]
    ).groupBy(*dims).agg(*[F.sum(m).alias(m) for m in measures])
    grouped = finest.groupingSets([[F.col(d) for d in s] for s in sets], *dims).agg(
        F.grouping_id().alias("_set"), *[F.sum(m).alias(m) for m in measures]
    )
    return FactCube(materialize(grouped, "fact-cube"), tuple(dims), tuple(map(frozenset, sets)), tuple(measures))
