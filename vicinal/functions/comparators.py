"""Comparators as columns.

Dense records compare by position (`dense_*`, arrays of floats). Sparse records compare through their postings: a join
on the term yields the sums over shared terms, and the rest follows from each record's unilateral value (`sparse`).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import ComparatorError


def _same_length(a: Column, b: Column, value: Column) -> Column:
    ok = (F.size(a) == F.size(b)) & (F.size(a) > 0)
    return F.when(a.isNull() | b.isNull(), F.lit(None)).when(ok, value).otherwise(F.raise_error(F.lit("records of different dimension, or without values")).cast("double"))


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def compensated_sum(values: Column) -> Column:
    """The sum of an array of doubles, with the rounding error of every addition carried along (Neumaier)."""
    zero = F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("c"))

    def add(acc: Column, x: Column) -> Column:
        t = acc["s"] + x
        lost = F.when(F.abs(acc["s"]) >= F.abs(x), (acc["s"] - t) + x).otherwise((x - t) + acc["s"])
        return F.struct(t.alias("s"), (acc["c"] + lost).alias("c"))

    return F.aggregate(values, zero, add, lambda acc: acc["s"] + acc["c"])


def dense_l2(a: Column, b: Column) -> Column:
    """Distance: differences in float, squares and sums in double."""
    diff = F.zip_with(a, b, lambda x, y: (x.cast("float") - y.cast("float")).cast("double"))
    return _same_length(a, b, F.sqrt(_total(F.transform(diff, lambda d: d * d))))


def _overlap(inter: Column, union: Column) -> Column:
    return F.when(union == 0, F.lit(1.0)).otherwise(inter / F.when(union == 0, F.lit(1.0)).otherwise(union))


def _signed_overlap(a: Column, b: Column, weight: Callable[[Column], Column]) -> Column:
    inter = _total(F.zip_with(a, b, lambda x, y: F.when(F.signum(x) == F.signum(y), F.least(weight(x), weight(y))).otherwise(F.lit(0.0))))
    both = _total(F.transform(a, weight)) + _total(F.transform(b, weight))
    return _same_length(a, b, _overlap(inter, both - inter))


def presence(x: Column) -> Column:
    return F.abs(F.signum(x.cast("double")))


def magnitude(x: Column) -> Column:
    return F.abs(x.cast("double"))


def square(x: Column) -> Column:
    return x.cast("double") * x.cast("double")


def dense_jaccard(a: Column, b: Column) -> Column:
    return _signed_overlap(a, b, presence)


def dense_ruzicka(a: Column, b: Column) -> Column:
    return _signed_overlap(a, b, magnitude)


@dataclass(frozen=True)
class Comparator:
    """uni: what a value adds to its record's unilateral value. shared: what a shared term adds (of q, r), by the
    name of the sum. value: the comparator's value from the sums and both unilateral values."""

    name: str
    uni: Callable[[Column], Column]
    dense: Callable[[Column, Column], Column]
    shared: Callable[[Column, Column], dict[str, Column]]
    value: Callable[[dict[str, Column], Column, Column], Column]
    is_distance: bool


def _overlap_sums(weight):
    def shared(q: Column, r: Column) -> dict[str, Column]:
        return {"inter": F.when(F.signum(q.cast("double")) == F.signum(r.cast("double")), F.least(weight(q), weight(r))).otherwise(F.lit(0.0))}

    return shared


def _l2_sums(q: Column, r: Column) -> dict[str, Column]:
    diff = (q - r).cast("double")
    return {"diff": diff * diff, "q2": square(q), "r2": square(r)}


def _l2_value(sums: dict[str, Column], uq: Column, ur: Column) -> Column:
    return F.sqrt(F.greatest(F.lit(0.0), sums["diff"] + (uq - sums["q2"]) + (ur - sums["r2"])))


def _overlap_value(sums: dict[str, Column], uq: Column, ur: Column) -> Column:
    return _overlap(sums["inter"], uq + ur - sums["inter"])


_ALL = {
    "l2": Comparator("l2", square, dense_l2, _l2_sums, _l2_value, True),
    "jaccard": Comparator("jaccard", presence, dense_jaccard, _overlap_sums(presence), _overlap_value, False),
    "ruzicka": Comparator("ruzicka", magnitude, dense_ruzicka, _overlap_sums(magnitude), _overlap_value, False),
}


def comparator(name: str) -> Comparator:
    """By its name, whatever its case."""
    got = _ALL.get((name or "").strip().lower())
    if got is None:
        raise ComparatorError(f"unknown comparator {name!r}")
    return got


def length_filter(name: str, uq: Column, ur: Column, bound: float) -> Column:
    """A condition that every pair within the bound meets: the similarity's threshold for overlaps, the distance for l2."""
    slack = 1e-9
    if name == "l2":
        return F.abs(F.sqrt(uq) - F.sqrt(ur)) <= bound + slack
    return F.least(uq, ur) >= F.greatest(uq, ur) * bound - slack


def prefix_mass(name: str, uni: Column, bound: float) -> Column:
    """Mass before a query term, in the order of rarity, beyond which no new candidate can reach the bound."""
    return (F.lit(bound * bound) if name == "l2" else uni * (1 - bound)) + 1e-9
