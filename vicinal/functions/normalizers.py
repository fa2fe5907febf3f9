"""Comparator value to similarity in [0, 1] and back, as columns."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import NormalizerError

#: A unit-length pair may be further apart than 2 by rounding alone.
SLACK = 1e-9


@dataclass(frozen=True)
class Normalizer:
    name: str
    to_similarity: Callable[[Column], Column]
    to_value: Callable[[float], float]


def _checked(similarity: Column) -> Column:
    wrong = F.raise_error(F.concat(F.lit("similarity out of range: "), similarity.cast("string"))).cast("double")
    clipped = F.least(F.greatest(similarity, F.lit(0.0)), F.lit(1.0))
    return F.when(similarity.isNull() | F.isnan(similarity), F.lit(None)).when(similarity.between(-SLACK, 1 + SLACK), clipped).otherwise(wrong)


_ALL = {
    "identity": Normalizer("identity", lambda v: _checked(v), lambda s: s),
    "lp": Normalizer("lp", lambda v: _checked(1 - v / 2), lambda s: 2 * (1 - s)),
    "reciprocal": Normalizer("reciprocal", lambda v: F.lit(1.0) / (1 + v), lambda s: float("inf") if s == 0 else 1 / s - 1),
}


def normalizer(name: str) -> Normalizer:
    """By its name, whatever its case."""
    got = _ALL.get((name or "").strip().lower())
    if got is None:
        raise NormalizerError(f"unknown normalizer {name!r}")
    return got
