"""Mutation logs: inserts, updates and deletes in sequence, and the rows that are visible after them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SCHEMA = "seq bigint, op string, row_num bigint, terms array<string>, values array<float>, metadata map<string,string>"


def effective(log: DataFrame) -> DataFrame:
    """The mutations that have an effect: a row's first insert, and everything up to its first delete.

    Updates and deletes of rows that are not live have none, nor do second inserts of a row number.
    """
    by_row = Window.partitionBy("row_num").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    born = F.coalesce(F.max((F.col("op") == "I").cast("int")).over(by_row), F.lit(0))
    dead = F.coalesce(F.max(((F.col("op") == "D") & F.col("__born").cast("boolean")).cast("int")).over(by_row), F.lit(0))
    marked = log.withColumn("__born", born).withColumn("__dead", dead)
    first = (F.col("op") == "I") & (F.col("__born") == 0)
    later = (F.col("op") != "I") & (F.col("__born") == 1) & (F.col("__dead") == 0)
    return marked.where(first | later).drop("__born", "__dead")


def visible(log: DataFrame) -> DataFrame:
    """The latest version of each live row."""
    latest = Window.partitionBy("row_num").orderBy(F.desc("seq"))
    rows = effective(log).withColumn("__r", F.row_number().over(latest))
    return rows.where((F.col("__r") == 1) & (F.col("op") != "D")).drop("__r", "op")
