"""Exact top-k inner products by block-at-a-time pruning.

A term is a dimension with a sign. Vectors stand in blocks of consecutive ids; a block keeps the largest weight of
each term. For a query, the sum of the maxima of its terms bounds every score in a block. A task orders its blocks by
that bound, scores the best block through its forward index (its rows as a matrix), and goes on until the bound of the
next block falls below the query's k-th score so far. Best lists of the tasks meet in one ranking per query.

The queries are written as a table in the shared folder, in files of about QUERY_SET rows. Every task reads it, QUERY_SET rows
at a time, against the blocks of PART_ROWS rows that it holds: vectors are read once whatever the number of queries, no query
passes through the driver, and memory is bounded by these two sizes, also where one id stands in very many rows.

Defined results: vectors that are null, or hold a null or non-finite component, take no part, nor do rows with a null id; vectors of
different length are padded with zeros; ties go to the smaller id; of rows with one id all are candidates of other
ids' queries; different vectors with one query id are a query each, equal ones are one; an empty table gives an empty
table; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._held import tidy
from ._session import fresh_dir, written

BLOCK = 512
QUERY_SET = 8192
#: Rows whose blocks a task keeps together; the bound of a task's memory, with 8 bytes a component.
PART_ROWS = 65_536
SCALE = 64


def quantized(df: DataFrame, is_query: Column, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """id, vec (floor(scale * x) as double) and whether it is a query, of the rows that take part."""
    vec = F.col(vec_col)
    fine = F.forall(vec, lambda x: F.coalesce(x.cast("double").between(-1.7976931348623157e308, 1.7976931348623157e308), F.lit(False)))
    rows = df.where(F.col(id_col).isNotNull() & vec.isNotNull() & fine)
    whole = F.transform(vec, lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("double"))
    return rows.select(F.col(id_col).cast("bigint").alias("id"), whole.alias("vec"), F.coalesce(is_query, F.lit(False)).alias("is_query"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column, padded with zeros to width."""
    size = np.asarray(column.value_lengths())
    out = np.zeros((len(column), width))
    values = np.asarray(column.flatten())
    row = np.repeat(np.arange(len(column)), size)
    out[row, np.arange(len(values)) - np.repeat(np.cumsum(size) - size, size)] = values
    return out


def _integers(top: float, width: int):
    """Whether all inner products of rows with components up to top are exact in float32, float64, or only as Python integers."""
    exact = top * top * width
    return np.float32 if exact < 2**24 else np.float64 if exact < 2**53 else object


class Blocks:
    """Rows in blocks of consecutive ids, each with the maxima of its terms."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.rows = ids[order], rows[order]
        self.starts = np.arange(0, len(rows), BLOCK)
        self.high = np.stack([self.rows[s : s + BLOCK].max(axis=0) for s in self.starts])  # maxima of the positive terms
        self.low = np.stack([self.rows[s : s + BLOCK].min(axis=0) for s in self.starts])  # of the negative ones
        self.top = float(np.abs(self.rows).max(initial=0))
        self._cast = (None, self.rows)

    def of_kind(self, kind) -> np.ndarray:
        """The rows as numbers of this kind; one form is kept."""
        if self._cast[0] is not kind:
            self._cast = kind, self.rows.astype(kind, copy=False)
        return self._cast[1]


def search_blocks(blocks: Blocks, q_ids: np.ndarray, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best k of the blocks' rows for every query, by descending score and then id: query index, ids, scores."""
    kind = _integers(max(blocks.top, float(np.abs(q).max(initial=0))), q.shape[1])
    ids, rows, starts, q = blocks.ids, blocks.of_kind(kind), blocks.starts, q.astype(kind)
    high, low = blocks.high.astype(kind), blocks.low.astype(kind)
    bound = np.maximum(q, 0) @ high.T + np.minimum(q, 0) @ low.T
    if kind is not object:
        bound = bound + np.abs(bound) * 1e-5 + 1  # rounding in float32
    turn = np.argsort(-bound, axis=1, kind="stable")
    n_q = len(q)
    kth = np.full(n_q, -np.inf)
    open_q = np.arange(n_q)
    top_s = [np.zeros(0, kind) for _ in range(n_q)]
    top_i = [np.zeros(0, np.int64) for _ in range(n_q)]
    for step in range(len(starts)):
        nxt = turn[open_q, step]
        alive = bound[open_q, nxt] >= kth[open_q]  # an equal score may still win by its id
        open_q, nxt = open_q[alive], nxt[alive]
        if not len(open_q):
            break
        by_block = np.argsort(nxt, kind="stable")
        edges = np.flatnonzero(np.diff(nxt[by_block], prepend=-1, append=-1))
        for a, z in zip(edges[:-1], edges[1:], strict=True):
            qs = open_q[by_block[a:z]]
            s = starts[nxt[by_block[a]]]
            block, b_ids = rows[s : s + BLOCK], ids[s : s + BLOCK]
            scores = q[qs] @ block.T
            for j, one in enumerate(qs):
                sc = scores[j]
                ok = (sc >= kth[one]) & (b_ids != q_ids[one]) if len(top_s[one]) >= k else b_ids != q_ids[one]
                at = np.flatnonzero(ok)
                if not len(at):
                    continue
                cs, ci = np.concatenate([top_s[one], sc[at]]), np.concatenate([top_i[one], b_ids[at]])
                if len(cs) > k:
                    if kind is not object and len(cs) > 4 * k:
                        cut = np.partition(cs, len(cs) - k)[len(cs) - k]
                        keep = cs >= cut
                        cs, ci = cs[keep], ci[keep]
                    pick = np.lexsort((ci, -cs))[:k]
                    cs, ci = cs[pick], ci[pick]
                top_s[one], top_i[one] = cs, ci
                if len(cs) == k:
                    kth[one] = float(cs.min())
    counts = [len(x) for x in top_i]
    return np.repeat(np.arange(n_q), counts), np.concatenate(top_i), np.concatenate(top_s)


def top_k(df: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """query_id, rank (from 1), the candidate's id and its integer score: each query's k best rows other than its own."""
    spark = df.sparkSession
    rows = written(quantized(df, is_query, id_col, vec_col, scale), "vectors")
    n_rows, n_queries, width = rows.agg(F.count(F.lit(1)), F.count_if("is_query"), F.max(F.size("vec"))).first()
    folder = fresh_dir(spark, "queries")
    queries = rows.where("is_query").select("id", F.xxhash64("vec").alias("vec_key"), "vec").distinct()
    queries.repartition(max(1, -(-n_queries // QUERY_SET))).write.parquet(folder)
    parts = max(-(-n_rows // PART_ROWS), min(n_rows // 2048, spark.sparkContext.defaultParallelism), 1)
    blocks = rows.select("id", "vec").repartitionByRange(parts, "id", F.xxhash64("vec"))
    found = blocks.mapInArrow(_searcher(folder, k, width or 0, QUERY_SET, PART_ROWS), "query_id bigint, vec_key bigint, vec_id bigint, score bigint")
    rank = F.row_number().over(Window.partitionBy("query_id", "vec_key").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _query_sets(folder: str, width: int, most: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Ids, keys and vectors of the written queries, at most so many at a time."""
    files, base = pafs.FileSystem.from_uri(folder)
    for one in sorted(i.path for i in files.get_file_info(pafs.FileSelector(base)) if i.path.endswith(".parquet")):
        with files.open_input_file(one) as source:
            for b in pq.ParquetFile(source).iter_batches(most, columns=["id", "vec_key", "vec"]):
                if b.num_rows:
                    yield np.asarray(b.column(0)), np.asarray(b.column(1)), _matrix(b.column(2), width)


def _parts(batches: Iterator[pa.RecordBatch], width: int, most: int) -> Iterator[Blocks]:
    """The rows of the batches in blocks, at most so many rows at a time."""
    ids, rows, n = [], [], 0
    for b in batches:
        for start in range(0, b.num_rows, most):
            some = b.slice(start, most)
            if n and n + some.num_rows > most:
                yield Blocks(np.concatenate(ids), np.concatenate(rows))
                ids, rows, n = [], [], 0
            ids.append(np.asarray(some.column(0)))
            rows.append(_matrix(some.column(1), width))
            n += some.num_rows
    if n:
        yield Blocks(np.concatenate(ids), np.concatenate(rows))


def _searcher(folder: str, k: int, width: int, query_set: int, part_rows: int):
    @tidy
    def run(batches):
        for blocks in _parts(batches, width, part_rows):
            for q_ids, keys, q in _query_sets(folder, width, query_set):
                at, ids, scores = search_blocks(blocks, q_ids, q, k)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(q_ids[at]), pa.array(keys[at]), pa.array(ids), pa.array([int(s) for s in scores], pa.int64())],
                    ["query_id", "vec_key", "vec_id", "score"],
                )

    return run


def oracle_sql(k: int = 20, every: int = 20, scale: int = SCALE) -> str:
    return f"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % {every} = 0 AND c.vec_id <> q.vec_id
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
WHERE rank <= {k}
"""
