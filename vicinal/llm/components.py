"""Connected components of an edge table, by alternating large and small stars.

Every round is two partial aggregations and two joins on narrow rows; nothing is collected, and each round's edges
are cut from their lineage by checkpoint(). The number of rounds grows with the logarithm of the longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._session import shared_dir

MOST_ROUNDS = 60


def _large(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours move to the smallest of it and its neighbours."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return both.where(F.col("b") > F.col("a")).join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small(edges: DataFrame) -> DataFrame:
    """Each node's smaller neighbours, and the node, move to the smallest of them. Edges have a > b here."""
    low = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(low, "a").where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(low.select("a", F.col("m").alias("b")))


def components(edges: DataFrame) -> DataFrame:
    """id and component_id, the smallest id that it reaches, for every id that has an edge. edges: columns a and b of one type.

    Edges with a null end, or from an id to itself, are left out; repeated edges count once; no edges give no rows.
    """
    shared_dir(edges.sparkSession)
    known = edges.where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")))
    now = known.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct().checkpoint()
    before = None
    for _ in range(MOST_ROUNDS):
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == before or not mark[0]:
            break
        before = mark
        now = _small(_large(now).distinct()).distinct().checkpoint()
    else:
        raise RuntimeError(f"components did not settle in {MOST_ROUNDS} rounds")
    roots = now.select(F.col("b").alias("id"), F.col("b").alias("component_id")).distinct()
    return now.select(F.col("a").alias("id"), F.col("b").alias("component_id")).unionByName(roots)
