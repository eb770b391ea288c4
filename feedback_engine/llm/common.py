"""Small helpers that the corpus operators share."""

from __future__ import annotations

import tempfile
import zipfile
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feedback_engine.session import materialize

#: A key counts as hot from this share of all rows on, so at most ``HOT_SHARE`` keys are hot.
HOT_SHARE = 1_000


def unit(*parts: Column | int) -> Column:
    """Number in [0, 1) that depends on the parts alone."""
    hashed = F.xxhash64(*[F.lit(p) if isinstance(p, int) else p for p in parts])
    return F.shiftrightunsigned(hashed, 11).cast("double") / float(1 << 53)


def names(df: DataFrame, *taken: str) -> dict[str, str]:
    """Names for helper columns that clash with no column of ``df``, whatever its letters' case."""
    used, out = {c.lower() for c in df.columns}, {}
    for name in taken:
        free = f"__{name}"
        while free.lower() in used:
            free = f"_{free}"
        used.add(free.lower())
        out[name] = free
    return out


def join_counted(
    rows: DataFrame, groups: DataFrame, keys: Sequence[str], count: str, total: int, spread: Column
) -> DataFrame:
    """Left join of rows to one record per group, where a group may hold a third of all rows.

    ``groups`` is a stored table with the group's row count. Groups above ``total / HOT_SHARE`` rows are at
    most HOT_SHARE in number, so their keys are broadcast; their rows are dealt over as many salts as
    they have shares, and their record is repeated for each salt. All other groups join as they are.
    """
    share = max(1, -(-total // HOT_SHARE))
    n = names(rows, "salts", "salt")
    hot = groups.where(F.col(count) > share).select(
        *keys, F.ceil(F.col(count) / share).cast("int").alias(n["salts"])
    )
    salt = F.when(F.col(n["salts"]).isNull(), 0).otherwise(
        F.pmod(F.xxhash64(spread), F.col(n["salts"])).cast("int")
    )
    left = rows.join(F.broadcast(hot), list(keys), "left").withColumn(n["salt"], salt).drop(n["salts"])
    salts = F.when(F.col(count) > share, F.ceil(F.col(count) / share).cast("int")).otherwise(1)
    right = groups.withColumn(n["salt"], F.explode(F.sequence(F.lit(0), salts - 1)))
    return left.join(right, [*keys, n["salt"]], "left").drop(n["salt"])


def stored_count(df: DataFrame, name: str) -> tuple[DataFrame, int]:
    """The table, written to the shared folder, and its row count (from the files' footers)."""
    table = materialize(df, name)
    return table, table.count()


def semi_by_id(df: DataFrame, ids: DataFrame, key: str, n_ids: int, most: int = 4_000_000) -> DataFrame:
    """Rows whose key is listed. The list is broadcast up to ``most`` ids, beyond that both sides shuffle."""
    return df.join(F.broadcast(ids) if n_ids <= most else ids, key, "left_semi")


_SHIPPED: set[str] = set()


def ship_code(spark: SparkSession) -> None:
    """Send this package to the executors once per application, so that Python tasks can import it there."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    package = Path(__file__).resolve().parents[1]
    archive = Path(tempfile.mkdtemp(prefix="engine-code-")) / "feedback_engine_code.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for source in sorted(package.rglob("*.py")):
            out.write(source, source.relative_to(package.parent))
    context.addPyFile(str(archive))
    _SHIPPED.add(context.applicationId)
