"""Exact search of sparse records by the terms that they share: postings of queries and rows meet within a task, block by block (see blocks).

Only rows that share a term with the query are hits, whatever the signs. A query's prefix is its rarest terms, beyond which no new row can reach a
threshold.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.comparators import comparator, prefix_mass
from ..functions.records import gathered
from ..sources.tables import written
from . import blocks
from .popularity import popular_terms, records_without, without
from .topk import float_threshold, ranked


def prefix(q: DataFrame, df: DataFrame, comparator_name: str, bound: float) -> DataFrame:
    """The query postings by which every row within the bound is found: rarest terms first (df, then larger weight, then
    term), as long as the mass of the terms before is within the bound. Terms that no row has come first."""
    weight = comparator(comparator_name).uni(F.col("value"))
    order = Window.partitionBy("qid").orderBy("df", F.desc("weight"), "term").rowsBetween(Window.unboundedPreceding, -1)
    known = q.join(df, "term", "left").withColumn("df", F.coalesce("df", F.lit(0))).withColumn("weight", weight)
    before = F.coalesce(F.sum("weight").over(order), F.lit(0.0))
    return known.withColumn("before", before).where(F.col("before") <= prefix_mass(comparator_name, F.col("uni"), bound)).drop("before", "weight")


def filtered(q: DataFrame, r: DataFrame, n_rows: int, fraction: float, confidence: float | None = None) -> tuple[DataFrame, DataFrame]:
    """Queries and rows without the rows' popular terms. Postings, or canonical records."""
    if fraction >= 1:
        return q, r
    popular = popular_terms(r, n_rows, fraction, confidence)
    if "terms" in r.columns:
        popular = written(popular.select("term"), "popular")
        return records_without(q, popular), records_without(r, popular)
    return without(q, popular), without(r, popular)


def search(
    q: DataFrame, r: DataFrame, comparator_name: str = "jaccard", normalizer: str = "identity", k: int = 10, min_similarity: float = 0.0,
    n_rows: int | None = None, fraction: float = 1.0, confidence: float | None = None, use_prefix: bool = True,
) -> DataFrame:
    """qid, row_num, similarity, rank from canonical records, which are read as they lie, or from postings (qid or row_num, term, value), which are gathered first.

    use_prefix is no longer needed, and changes nothing: a posting costs less than its candidates would.
    """
    q, r = gathered(q, "qid"), gathered(r, "row_num")
    if fraction < 1:
        q, r = filtered(q, r, r.count() if n_rows is None else n_rows, fraction, confidence)
    return ranked(blocks.hits(q, r, comparator_name, normalizer, k, float_threshold(min_similarity)), k)
