"""Approximate nearest neighbours with a permutation index.

A bounded sample of the vectors serves as pivots. A vector is represented by the order of its nearest pivots; it is
posted in the inverted file of each of its ``POSTED`` nearest ones. A query visits the files of its ``PROBED`` nearest
pivots. In a file, the footrule distance between the query's and a vector's order ranks the candidates, the best
share ``RERANKED`` of them, at any size, is ranked again by cosine on the original vectors in double precision, and the few
best of each file meet in a last top-k per query.

A file is dealt over blocks of about ``BLOCK`` vectors, so no task holds a whole file and a file with most vectors is many
tasks; queries go to each block of a file. The number of pivots grows with the square root of the rows up to
``MOST_PIVOTS``. Equal vectors are one entry that carries its smallest ids, as many as a query can use, so a vector
that a third of all rows share costs one comparison.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from feedback_engine.session import materialize

POSTED = 6
ORDERED = 16  # pivots in a vector's order
PROBED = 16  # of them
RERANKED = 0.75  # share of a file's block that the footrule passes on to the cosine, for each query
BLOCK = 8_000
MOST_PIVOTS = 128


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, v) without null, zero and non-finite vectors, and only of the most frequent length."""
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vec_col}`").alias("v"))
    rows = rows.where("vec_id is not null and v is not null")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    rows = rows.where(finite).where(F.exists("v", lambda x: x != 0))
    most = rows.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    return rows.where(F.size("v") == (most["dim"] if most else 0))


def _unit(matrix: np.ndarray) -> np.ndarray:
    scaled = matrix / np.abs(matrix).max(axis=1, keepdims=True)  # keeps squares of very large and small numbers finite
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def _orders(pivots: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    """Nearest pivots of each row, nearest first, as many as ORDERED."""
    near = _unit(matrix) @ pivots.T
    return np.argsort(-near, axis=1, kind="stable")[:, : min(ORDERED, len(pivots))]


def _places(orders: np.ndarray, n_pivots: int) -> np.ndarray:
    """Place of each pivot in each order; a pivot not in it stands just after it."""
    place = np.full((len(orders), n_pivots), orders.shape[1], np.int16)
    np.put_along_axis(place, orders, np.arange(orders.shape[1], dtype=np.int16)[None, :], axis=1)
    return place


def _footrule(query: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Sum over the query's pivots of how far each is from its place."""
    return np.abs(places[:, query] - np.arange(len(query), dtype=np.int16)[None, :]).sum(axis=1)


def pivots_of(entries: DataFrame, n_entries: int) -> np.ndarray:
    """A sample of unit vectors, by hash of the id: 2 * sqrt(rows), at least 16, at most MOST_PIVOTS."""
    wanted = int(min(MOST_PIVOTS, max(16, 2 * n_entries**0.5)))
    chosen = entries.orderBy(F.xxhash64("vec_id"), "vec_id").limit(wanted).select("v").collect()
    return _unit(np.array([r["v"] for r in chosen], np.float64)) if chosen else np.zeros((0, 0))


def nearest(
    vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", every: int = 50, k: int = 5,
    reranked: float = RERANKED,
) -> DataFrame:
    """The ``k`` nearest found for each row whose id is divisible by ``every``: query_id, rank, vec_id, score.

    Nearness is the cosine; ties go to the smaller vec_id; a query's own row is no candidate. Vectors that are
    null, zero, hold null or non-finite numbers, or differ in length from most take no part; nor do rows without an
    id. Rows that repeat id and vector count once. With ``k`` or fewer candidates all are returned. No vectors give an
    empty table.
    """
    spark = vectors.sparkSession
    rows = materialize(usable(vectors, id_col, vec_col), "vectors")
    # equal vectors share an entry: a query needs k of their ids besides its own
    by_vector = Window.partitionBy("v").orderBy("vec_id")
    some = rows.distinct().withColumn("at", F.row_number().over(by_vector)).where(F.col("at") <= k + 1)
    entries = materialize(
        some.groupBy("v").agg(F.array_sort(F.collect_set("vec_id")).alias("ids")).select(F.col("ids")[0].alias("vec_id"), "ids", "v"),
        "entries",
    )
    n_entries = entries.count()
    shared = spark.sparkContext.broadcast(pivots_of(entries, n_entries))  # MOST_PIVOTS vectors at most
    n_pivots = len(shared.value)

    def order(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            orders = _orders(shared.value, np.stack(frame["v"]).astype(np.float64)) if len(frame) else []
            yield frame.assign(pivots=list(np.asarray(orders, np.int32)))

    kind, number = "array<int>", rows.schema["v"].dataType.simpleString()
    posted = entries.mapInPandas(order, f"vec_id long, ids array<long>, v {number}, pivots {kind}")
    queries = rows.where(F.col("vec_id") % every == 0).distinct()
    asked = queries.mapInPandas(order, f"vec_id long, v {number}, pivots {kind}")

    lists = posted.select("vec_id", "ids", "v", "pivots", F.explode(F.slice("pivots", 1, POSTED)).alias("pivot"))
    sizes = materialize(
        posted.select(F.explode(F.slice("pivots", 1, POSTED)).alias("pivot")).groupBy("pivot").count()
        .select("pivot", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks")),
        "files",
    )  # a row for each pivot
    lists = lists.join(F.broadcast(sizes), "pivot").withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int")).drop("blocks")
    probes = asked.select("vec_id", "v", "pivots", F.explode(F.slice("pivots", 1, PROBED)).alias("pivot"))
    probes = probes.join(F.broadcast(sizes), "pivot").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")

    def search(key: tuple, members: pd.DataFrame, probes: pd.DataFrame) -> pd.DataFrame:
        found: list[tuple[int, int, float]] = []
        if len(members) and len(probes):
            matrix = np.stack(members["v"]).astype(np.float64)
            places = _places(np.stack(members["pivots"]), n_pivots)
            units = _unit(matrix)
            passed = min(len(members), max(k + 1, int(np.ceil(reranked * len(members)))))
            for query_id, v, order in zip(probes["vec_id"], probes["v"], probes["pivots"], strict=True):
                candidates = np.argpartition(_footrule(order, places), passed - 1)[:passed]
                own = _unit(np.asarray(v, np.float64)[None, :])[0]
                score = np.clip((units[candidates] * own).sum(axis=1), -1.0, 1.0)
                best = score >= np.partition(score, -min(k + 1, len(score)))[-min(k + 1, len(score))]
                ids = members["ids"].to_numpy()
                options = sorted((-s, i) for c, s in zip(candidates[best], score[best], strict=True) for i in ids[c] if i != query_id)
                found += [(query_id, i, -s) for s, i in options[:k]]
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score"])

    found = (
        lists.groupBy("pivot", "block").cogroup(probes.groupBy("pivot", "block"))
        .applyInPandas(search, "query_id long, vec_id long, score double").distinct()
    )
    top = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        .withColumn("rank", F.row_number().over(top)).where(F.col("rank") <= k)
        .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
    )
