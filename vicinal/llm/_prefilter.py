"""A Bloom filter of ids as a table of words, so that large rows are not shuffled only to find that they have no partner.

The filter has about 16 bits an id, and MOST_BITS at most: its table is broadcast, and its size is bounded by that
parameter. Beyond it the filter lets more rows through, and the exact join that must follow still decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST_BITS, MOST_BITS = 1 << 16, 1 << 26


def _place(column: Column, bits: int) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(bits))


def marked(rows: DataFrame, key: str, ids: DataFrame, id_col: str, out_col: str = "__maybe") -> DataFrame:
    """rows with out_col: false if the key is surely not among the ids. A null key is never among them. No shuffle of rows."""
    n = ids.count()
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (16 * n).bit_length()))
    place = _place(F.col(id_col), bits)
    words = ids.where(F.col(id_col).isNotNull()).select((place / 64).cast("bigint").alias("__word"), F.expr("1L").alias("__one"), (place % 64).cast("int").alias("__at"))
    words = words.groupBy("__word").agg(F.bit_or(F.expr("shiftleft(__one, __at)")).alias("__bits"))
    spot = _place(F.col(key), bits)
    held = rows.withColumn("__word", (spot / 64).cast("bigint")).withColumn("__at", (spot % 64).cast("int")).join(F.broadcast(words), "__word", "left")
    hit = F.coalesce(F.expr("shiftright(__bits, __at) & 1") == 1, F.lit(False)) & F.col(key).isNotNull()
    return held.withColumn(out_col, hit).drop("__word", "__at", "__bits")
