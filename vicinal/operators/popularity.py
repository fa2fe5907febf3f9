"""Terms that too many records have: found exactly, or by a confidence bound on their share, and left out of postings."""

from __future__ import annotations

from statistics import NormalDist

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import EPSILON
from ..functions.records import UNI, bare, left_out
from ..sources.tables import batches_of, give_back, written_sets


def z_value(confidence: float) -> float:
    """One-sided standard score; 1 / EPSILON for certainty."""
    if not 0.5 <= confidence <= 1:
        raise ValueError("confidence must be in [0.5, 1]")
    return 1 / EPSILON if confidence == 1 else NormalDist().inv_cdf(confidence)


def _error(share: Column, n: Column | int, z: float) -> Column:
    return F.lit(z) * F.sqrt(share * (1 - share) / n)


def upper_bound(df: Column, n: Column | int, confidence: float) -> Column:
    share = df / n
    return F.least(F.lit(1.0), share + _error(share, n, z_value(confidence)))


def lower_bound(df: Column, n: Column | int, confidence: float) -> Column:
    share = df / n
    return F.greatest(F.lit(0.0), share - _error(share, n, z_value(confidence)))


def document_frequencies(rows: DataFrame) -> DataFrame:
    """term, df of postings or canonical records."""
    if "terms" in rows.columns:
        rows = rows.select(F.explode("terms").alias("term"))
    return rows.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def popular_terms(rows: DataFrame, n_rows: int, fraction: float, confidence: float | None = None) -> DataFrame:
    """term, df of the popular terms of postings or canonical records. Exact: df over floor(n * fraction). With a confidence: its upper bound over the fraction.

    A fraction of 1 makes no term popular under a confidence.
    """
    df = document_frequencies(rows)
    if confidence is None:
        return df.where(F.col("df") > F.floor(F.lit(n_rows) * F.lit(fraction)))
    if fraction >= 1:
        return df.where(F.lit(False))
    return df.where(upper_bound(F.col("df"), n_rows, confidence) > fraction)


def without(rows: DataFrame, terms: DataFrame) -> DataFrame:
    """Postings without these terms. What they carry of their whole record goes too."""
    id_col = next(c for c in rows.columns if c in ("qid", "row_num"))
    return bare(rows, id_col).join(terms.select("term"), "term", "left_anti")


def records_without(rows: DataFrame, terms: DataFrame) -> DataFrame:
    """Canonical records without these terms, which are a table that tasks read."""
    folder = written_sets(terms.select("term"), "popular", 1)
    id_col = next(c for c in rows.columns if c in ("qid", "row_num"))
    rows = rows.select(id_col, "terms", "values", "n_terms", *UNI.values())

    def run(batches):
        gone = pa.concat_arrays([pa.array([], pa.string()), *(b.column(0).cast(pa.string()) for b in batches_of(folder, 1 << 16))])
        for b in batches:
            yield left_out(b, gone)
        give_back()

    return rows.mapInArrow(run, rows.schema)
