"""Exhaustive search: every query against every row, block by block.

The queries are written as a table in the shared folder, which every task reads QUERY_SET at a time against the PART_VALUES values of records that it holds:
records are read once whatever the number of queries, no query passes through the driver, and memory is bounded by these two sizes. A task
scores some thousand rows at a time and keeps each query's k best rows so far; the k-th of them is the threshold that later rows must reach,
and only the best rows of a task are shuffled.

Dense rows under l2: one matrix product for all queries finds the pairs that may be among the best, and only those are scored again exactly
(float differences, double sums). Sparse rows: the postings of a batch meet the queries' postings by term, sums over shared terms and unilateral
values give every similarity, that of rows without a shared term too.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import SearchError, ShapeError
from ..functions.records import UNI, _canonical, canonical, shape
from ..sources.tables import batches_of, written_sets
from .topk import float_threshold, ranked, union

QUERY_SET = 2048
#: Records that are scored at once, and the values of records, about, that a task holds while it reads all queries.
ROWS, PART_VALUES = 4096, 1 << 22
#: Pairs of query and row, and of their postings, that are scored at once.
PAIRS = 1 << 22
_HITS = "qid bigint, row_num bigint, similarity float"


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column as float32, all of one length."""
    if column.null_count:
        raise ShapeError("a record has no values")
    size = np.asarray(column.value_lengths())
    if len(size) and (size.min() != size.max() or size[0] == 0):
        raise ShapeError("records of different dimension, or without values")
    return np.asarray(column.flatten(), dtype=np.float32).reshape(len(column), -1)


def _distance(q: np.ndarray, rows: np.ndarray) -> np.ndarray:
    d = (q - rows).astype(np.float64)
    return np.sqrt(np.cumsum(d * d, axis=-1)[..., -1])  # summed from the left, as the column form does


def _similarity(normalizer: str, value: np.ndarray) -> np.ndarray:
    if normalizer == "reciprocal":
        return 1 / (1 + value)
    got = 1 - value / 2 if normalizer == "lp" else value
    if ((got < -1e-9) | (got > 1 + 1e-9)).any():
        raise SearchError("similarity out of range")
    return np.clip(got, 0, 1)


def _overlap(name: str, q: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Signed Jaccard or Ruzicka similarity of one query with all rows."""
    a, b = np.abs(q).astype(np.float64), np.abs(rows).astype(np.float64)
    if name == "jaccard":
        a, b = (a > 0).astype(np.float64), (b > 0).astype(np.float64)
    inter = np.where(np.sign(q) == np.sign(rows), np.minimum(a, b), 0).sum(axis=1)
    union = a.sum() + b.sum(axis=1) - inter
    return np.where(union == 0, 1.0, inter / np.where(union == 0, 1, union))


class _Best:
    """Each query's k best rows so far: similarity descending, then row number."""

    def __init__(self, n: int, k: int):
        self.k, self.kth = k, np.full(n, -np.inf)
        self.sims, self.ids = [np.zeros(0, np.float32)] * n, [np.zeros(0, np.int64)] * n

    def add(self, i: int, ids: np.ndarray, sim: np.ndarray) -> None:
        """Rows of query i that reach its threshold."""
        s, d = np.concatenate([self.sims[i], sim.astype(np.float32)]), np.concatenate([self.ids[i], ids])
        if len(s) > self.k:
            pick = np.lexsort((d, -s))[: self.k]
            s, d = s[pick], d[pick]
        self.sims[i], self.ids[i] = s, d
        if len(s) == self.k:
            self.kth[i] = s.min(initial=np.inf)

    def some(self, queries: np.ndarray) -> _Best:
        """Those of the queries that are true here; see put."""
        out, at = _Best(0, self.k), np.flatnonzero(queries).tolist()
        out.kth, out.sims, out.ids = self.kth[queries], [self.sims[i] for i in at], [self.ids[i] for i in at]
        return out

    def put(self, queries: np.ndarray, found: _Best) -> None:
        """What was found for the queries that are true here replaces theirs."""
        self.kth[queries] = found.kth
        for i, s, d in zip(np.flatnonzero(queries).tolist(), found.sims, found.ids, strict=True):
            self.sims[i], self.ids[i] = s, d

    def hits(self, q_ids: np.ndarray):
        n = [len(x) for x in self.ids]
        if sum(n):
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(q_ids, n)), pa.array(np.concatenate(self.ids)), pa.array(np.concatenate(self.sims))], ["qid", "row_num", "similarity"])


def _score(best: _Best, q, ids, rows, name, normalizer, least) -> None:
    """Add the hits of each query among these rows."""
    wide, near = rows.astype(np.float64), None
    if name == "l2":
        norms = (wide**2).sum(axis=1)
        q_wide = q.astype(np.float64)
        near, q_norms = norms - 2 * q_wide @ wide.T, (q_wide**2).sum(axis=1)
    for i, one in enumerate(q):
        at = np.arange(len(ids))
        if name == "l2":
            if len(ids) > best.k:
                kth = np.partition(near[i], best.k - 1)[best.k - 1]
                at = np.flatnonzero(near[i] <= kth + 1e-6 * (1 + np.abs(kth) + q_norms[i]))
            sim = _similarity(normalizer, _distance(one, rows[at]))
        else:
            sim = _similarity(normalizer, _overlap(name, one, rows))
        with np.errstate(invalid="ignore"):
            ok = (sim >= least) & (sim.astype(np.float32) >= best.kth[i])
        if ok.any():
            best.add(i, ids[at[ok]], sim[ok])


class _Queries:
    """Sparse queries by term: the vocabulary, and for each of its terms the queries that have it and their values."""

    def __init__(self, batch: pa.RecordBatch, name: str):
        self.ids = np.asarray(batch.column(0))
        flat = batch.column(1).flatten()
        row = np.repeat(np.arange(batch.num_rows), np.asarray(batch.column(1).value_lengths()))
        coded = pc.dictionary_encode(flat)
        self.terms, code = coded.dictionary, np.asarray(coded.indices)
        order = np.argsort(code, kind="stable")
        self.row, self.value = row[order], np.asarray(batch.column(2).flatten())[order]
        self.first = np.searchsorted(code[order], np.arange(len(self.terms) + 1))
        self.uni = np.asarray(batch.column(UNI[name]))


def _shared(name: str, q: np.ndarray, r: np.ndarray) -> np.ndarray:
    """What a shared term adds: to the intersection, or to the squared distance beyond both unilateral values."""
    a, b = q.astype(np.float64), r.astype(np.float64)
    if name == "l2":
        d = (q - r).astype(np.float64)
        return d * d - a * a - b * b
    return np.where(np.sign(a) == np.sign(b), np.minimum(np.abs(a), np.abs(b)) if name == "ruzicka" else np.abs(np.sign(a)), 0.0)


def _score_sparse(best: _Best, q: _Queries, rows: pa.RecordBatch, name: str, normalizer: str, least: float) -> None:
    """Add the hits of each query among these canonical rows."""
    ids, uni, n_q = np.asarray(rows.column(0)), np.asarray(rows.column(UNI[name])), len(q.ids)
    flat = rows.column(1).flatten()
    row = np.repeat(np.arange(rows.num_rows), np.asarray(rows.column(1).value_lengths()))
    code = np.asarray(pc.fill_null(pc.index_in(flat, value_set=q.terms), -1))
    at = np.flatnonzero(code >= 0)
    row, code, value = row[at], code[at], np.asarray(rows.column(2).flatten())[at]
    n = q.first[code + 1] - q.first[code]
    # As many rows at a time as keep both the pairs and the pairs of postings bounded.
    before = np.concatenate([[0], np.cumsum(np.bincount(row, weights=n, minlength=rows.num_rows))])
    a = 0
    while a < rows.num_rows:
        z = min(max(a + 1, int(np.searchsorted(before, before[a] + PAIRS, side="right")) - 1), a + max(1, PAIRS // n_q), rows.num_rows)
        some = slice(*np.searchsorted(row, [a, z]))
        times = n[some]
        listed = np.repeat(q.first[code[some]] - (np.cumsum(times) - times), times) + np.arange(times.sum())
        spot = q.row[listed] * (z - a) + np.repeat(row[some], times) - a
        x = np.bincount(spot, weights=_shared(name, q.value[listed], np.repeat(value[some], times)), minlength=n_q * (z - a)).reshape(n_q, -1)
        both = q.uni[:, None] + uni[a:z]
        if name == "l2":
            got = np.sqrt(np.maximum(both + x, 0))
        else:
            union = both - x
            got = np.where(union == 0, 1.0, x / np.where(union == 0, 1, union))
        sim = _similarity(normalizer, got)
        ok = (sim >= least) & (sim.astype(np.float32) >= best.kth[:, None])
        for i in np.flatnonzero(ok.any(axis=1)).tolist():
            best.add(i, ids[a:z][ok[i]], sim[i, ok[i]])
        a = z


def _parts(batches: Iterator[pa.RecordBatch], make: Callable[[pa.RecordBatch], object], piece: int, most: int) -> Iterator[list]:
    """What make returns for pieces of the batches, in lists of at most so many values, one piece at least."""
    held, n = [], 0
    for b in batches:
        for start in range(0, b.num_rows, piece):
            some = b.slice(start, piece)
            size = pc.sum(some.column(1).value_lengths()).as_py() or 0
            if held and n + size > most:
                yield held
                held, n = [], 0
            held.append(make(some))
            n += size
    if held:
        yield held


def dense_search(records: DataFrame, queries: DataFrame, comparator: str = "l2", normalizer: str = "reciprocal", k: int = 10, min_similarity: float = 0.0) -> DataFrame:
    """qid, row_num, similarity, rank. records: row_num, values. queries: qid, values. All of one dimension.

    Rows of similarity below min_similarity (as a float) are left out; those of similarity 0 are hits at 0.
    """
    least = float_threshold(min_similarity)
    rows = records.select(F.col("row_num").cast("bigint").alias("row_num"), F.col("values").cast("array<float>").alias("values"))
    asked = queries.select(F.col("qid").cast("bigint").alias("qid"), F.col("values").cast("array<float>").alias("values"))
    size = F.coalesce(F.size("values"), F.lit(0))
    n, shortest, longest = asked.agg(F.count(F.lit(1)), F.min(size), F.max(size)).first()
    if shortest != longest:
        raise ShapeError("queries of different dimension")
    folder, query_set, piece, most = written_sets(asked, "queries", -(-n // QUERY_SET)), QUERY_SET, ROWS, PART_VALUES

    def run(batches):
        for held in _parts(batches, lambda b: (np.asarray(b.column(0)), _matrix(b.column(1))), piece, most):
            for some in batches_of(folder, query_set):
                q_ids, q = np.asarray(some.column(0)), _matrix(some.column(1))
                best = _Best(len(q), k)
                for ids, m in held:
                    if q.shape[1] != m.shape[1]:
                        raise ShapeError("a query's dimension differs from the records'")
                    _score(best, q, ids, m, comparator, normalizer, least)
                yield from best.hits(q_ids)

    return ranked(rows.mapInArrow(run, _HITS), k)


def sparse_search(records: DataFrame, queries: DataFrame, comparator: str = "jaccard", normalizer: str = "identity", k: int = 10, min_similarity: float = 0.0) -> DataFrame:
    """qid, row_num, similarity, rank of sparse records (row_num, terms, values) for sparse queries (qid, terms, values).

    Rows that share no term with a query take part as well. A dense record raises an error; sequences and empty records are no rows.
    """
    least = float_threshold(min_similarity)
    rows = records.select(F.col("row_num").cast("bigint").alias("row_num"), F.col("terms").cast("array<string>"), F.col("values").cast("array<float>"))
    asked = canonical(queries.withColumn("qid", F.col("qid").cast("bigint")), "qid")
    folder, query_set, piece, most = written_sets(asked, "queries", -(-queries.count() // QUERY_SET)), QUERY_SET, ROWS, PART_VALUES

    def sparse(b: pa.RecordBatch) -> pa.RecordBatch:
        n_terms, n_values = (np.asarray(pc.fill_null(b.column(i).value_lengths(), 0)) for i in (1, 2))
        if ((n_terms == 0) & (n_values > 0)).any():
            raise ShapeError("a sparse query meets a dense record")
        return _canonical(*b.columns)

    def run(batches):
        for held in _parts(batches, sparse, piece, most):
            for some in batches_of(folder, query_set):
                q = _Queries(some, comparator)
                best = _Best(len(q.ids), k)
                for part in held:
                    _score_sparse(best, q, part, comparator, normalizer, least)
                yield from best.hits(q.ids)

    return ranked(rows.mapInArrow(run, _HITS), k)


def generic_search(records: DataFrame, queries: DataFrame, comparator: str, normalizer: str, k: int = 10, min_similarity: float = 0.0) -> DataFrame:
    """dense_search for the dense queries and sparse_search for the sparse ones, over all records of any shape."""
    kind = shape(F.col("terms"), F.col("values"))
    known = [r[0] for r in queries.select(kind.alias("kind")).distinct().collect()]
    hits = []
    if "dense" in known:
        mixed = F.when(kind == "sparse", F.raise_error(F.lit("a dense query meets a sparse record")).cast("array<float>")).otherwise(F.col("values"))
        hits.append(dense_search(records.where(kind.isin("dense", "sparse")).withColumn("values", mixed), queries.where(kind == "dense"), comparator, normalizer, k, min_similarity).drop("rank"))
    if "sparse" in known:
        hits.append(sparse_search(records, queries.where(kind == "sparse"), comparator, normalizer, k, min_similarity).drop("rank"))
    return ranked(union(*hits or [records.sparkSession.createDataFrame([], _HITS)]), k)
