"""Ranking of hits: similarity (as float) descending, row number ascending, at most k for each query."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def ranked(hits: DataFrame, k: int) -> DataFrame:
    """qid, row_num, similarity (float), rank from 1. NaN similarities are no hits. k = 0 keeps none."""
    if k < 0:
        raise ValueError("k is negative")
    order = Window.partitionBy("qid").orderBy(F.desc("similarity"), "row_num")
    rows = hits.select("qid", "row_num", F.col("similarity").cast("float").alias("similarity"))
    rows = rows.where(F.col("similarity").isNotNull() & ~F.isnan("similarity"))
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def float_threshold(t: float) -> float:
    """A threshold is a float, widened to double before it is compared."""
    import struct

    return struct.unpack("f", struct.pack("f", t))[0]


def small(df: DataFrame, most_rows: int = 50_000) -> DataFrame:
    """df, marked for broadcasting if it is proven to have at most most_rows rows."""
    return F.broadcast(df) if df.limit(most_rows + 1).count() <= most_rows else df


def union(*structures: DataFrame) -> DataFrame:
    """Hits of several structures, which hold each row number once among them."""
    out = structures[0]
    for one in structures[1:]:
        out = out.unionByName(one)
    return out
