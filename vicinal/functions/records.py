"""Records and their canonical form.

A record has parallel arrays of terms (strings) and values (floats): dense without terms, sparse with both, a sequence with terms
alone, which is stored but never searched. The canonical form of a sparse record has its different terms in order, and its
postings are a row for each of them. A record is one row, so neither needs a shuffle.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import ShapeError
from ..sources.tables import give_back
from .comparators import comparator

#: Unilateral values that canonical records carry, by comparator.
UNI = {name: f"uni_{name}" for name in ("l2", "jaccard", "ruzicka")}
_BLANKS = "".join(map(chr, range(33)))


def normal_term(term: Column) -> Column:
    """Lower case, without leading and trailing characters up to U+0020."""
    return F.lower(F.regexp_replace(term, r"^[\x00-\x20]+|[\x00-\x20]+$", ""))


def shape(terms: Column, values: Column) -> Column:
    """dense, sparse, sequence or empty. Null arrays count as empty."""
    t, v = F.coalesce(F.size(terms), F.lit(0)) > 0, F.coalesce(F.size(values), F.lit(0)) > 0
    return F.when(t & v, "sparse").when(v, "dense").when(t, "sequence").otherwise("empty")


def _lengths(column: pa.Array) -> np.ndarray:
    return np.asarray(pc.fill_null(column.value_lengths(), 0)).astype(np.int64)


def _canonical(ids: pa.Array, terms: pa.Array, values: pa.Array) -> pa.RecordBatch:
    n_terms, n_values = _lengths(terms), _lengths(values)
    if ((n_terms != n_values) & (n_terms > 0) & (n_values > 0)).any():
        raise ShapeError("terms and values differ in length")
    both = n_terms == n_values
    row = np.repeat(np.arange(len(ids)), n_terms)[np.repeat(both, n_terms)]
    term = terms.filter(pa.array(both)).flatten()
    value = values.filter(pa.array(both)).flatten()
    known = np.asarray(pc.and_(pc.is_valid(term), pc.is_valid(value)))
    row, value = row[known], np.asarray(value.filter(pa.array(known))).astype(np.float64)
    coded = pc.dictionary_encode(pc.utf8_trim(pc.utf8_lower(term.filter(pa.array(known)).cast(pa.string())), characters=_BLANKS))
    order = np.asarray(pc.sort_indices(coded.dictionary))
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    size = max(1, len(order))
    key, place = np.unique(row * size + rank[np.asarray(coded.indices)], return_inverse=True)
    total = np.bincount(place, weights=value, minlength=len(key))
    row = key // size
    alive = np.bincount(row, weights=total != 0, minlength=len(ids)) > 0
    kept = (total != 0) | ~alive[row]
    row, key, total = row[kept], key[kept], total[kept].astype(np.float32)
    wide = total.astype(np.float64)
    offsets = pa.array(np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(ids)))]), pa.int32())
    n = np.diff(np.asarray(offsets))
    uni = {"l2": wide * wide, "jaccard": np.abs(np.sign(wide)), "ruzicka": np.abs(wide)}
    found = pa.RecordBatch.from_arrays(
        [
            ids, pa.ListArray.from_arrays(offsets, coded.dictionary.take(pa.array(order[key % size]))), pa.ListArray.from_arrays(offsets, pa.array(total)), pa.array(n.astype(np.int32)),
            *(pa.array(np.bincount(row, weights=uni[name], minlength=len(ids))) for name in UNI),
        ],
        ["id", "terms", "values", "n_terms", *UNI.values()],
    )
    return found.filter(pa.array(n > 0))


def canonical(records: DataFrame, id_col: str = "row_num") -> DataFrame:
    """id, terms (different, in order), values (float), n_terms and the unilateral values of sparse records.

    Duplicate terms are summed up in double; terms whose sum is zero go unless all are. A record whose arrays differ in length
    raises an error; null terms or values are left out; records without terms or without values are left out. An id names one row.
    """

    def run(batches):
        for b in batches:
            yield _canonical(*b.columns)

    kind = records.schema[id_col].dataType.simpleString()
    rows = records.select(id_col, F.col("terms").cast("array<string>"), F.col("values").cast("array<float>"))
    schema = f"id {kind}, terms array<string>, values array<float>, n_terms int, " + ", ".join(f"{u} double" for u in UNI.values())
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def _words(ids: pa.Array, texts: pa.Array, letters: bytes, weight) -> pa.RecordBatch:
    texts, n = pa.concat_arrays([pc.fill_null(texts.cast(pa.string()), ""), pa.array([], pa.string())]), len(ids)
    bounds = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[bounds[0] : bounds[-1]]
    bounds = bounds - bounds[0]
    known = np.zeros(256, bool)
    known[list(letters)] = True
    at = known[data]
    full = bounds[:-1] < bounds[1:]
    starts, ends = at.copy(), at.copy()
    starts[1:] &= ~at[:-1]
    ends[:-1] &= ~at[1:]
    starts[bounds[:-1][full]], ends[bounds[1:][full] - 1] = at[bounds[:-1][full]], at[bounds[1:][full] - 1]
    start = np.flatnonzero(starts)
    length, row = np.flatnonzero(ends) + 1 - start, np.searchsorted(bounds, start, side="right") - 1
    flat = pa.StringArray.from_buffers(len(start), pa.py_buffer(np.concatenate([[0], np.cumsum(length)]).astype(np.int32)), pa.py_buffer(data[at]))
    value = np.ones(len(row), np.float32) if weight is None else weight(ids, row, length).astype(np.float32)
    offsets = pa.array(np.concatenate([[0], np.cumsum(np.bincount(row, minlength=n))]), pa.int32())
    return _canonical(ids, pa.ListArray.from_arrays(offsets, flat), pa.ListArray.from_arrays(offsets, pa.array(value)))


def canonical_words(texts: DataFrame, letters: str, weight=None) -> DataFrame:
    """Canonical records of texts (row_num, text): the longest runs of ASCII letters given are terms. No array of all words passes through the JVM.

    weight: None for ones, or a function of the rows' ids and each word's row and bytes that gives the words' values.
    """

    def run(batches):
        for b in batches:
            yield _words(*b.columns, letters.encode("ascii"), weight)
        give_back()

    schema = f"row_num {texts.schema['row_num'].dataType.simpleString()}, terms array<string>, values array<float>, n_terms int, " + ", ".join(f"{u} double" for u in UNI.values())
    return texts.select("row_num", "text").mapInArrow(run, schema)


def gathered(rows: DataFrame, id_col: str = "row_num") -> DataFrame:
    """Canonical records of postings, with what those carry of their record, or else with what follows from them; canonical records stay as they are."""
    if "terms" in rows.columns:
        return rows
    uni = [F.first(u).alias(u) if u in rows.columns else F.sum(comparator(name).uni(F.col("value"))).alias(u) for name, u in UNI.items()]
    n = F.first("n_terms") if "n_terms" in rows.columns else F.count(F.lit(1)).cast("int")
    per = rows.groupBy(id_col).agg(F.sort_array(F.collect_list(F.struct("term", "value"))).alias("p"), n.alias("n_terms"), *uni)
    return per.select(id_col, F.col("p.term").alias("terms"), F.col("p.value").alias("values"), "n_terms", *UNI.values())


def left_out(batch: pa.RecordBatch, gone: pa.Array) -> pa.RecordBatch:
    """Canonical records without these terms, and what they carry of their record anew; records without any term left go."""
    terms, n = batch.column(1), batch.num_rows
    flat, row = terms.flatten(), np.repeat(np.arange(n), np.asarray(terms.value_lengths()))
    kept = np.asarray(pc.invert(pc.is_in(flat, value_set=gone)))
    values, row = batch.column(2).flatten().filter(pa.array(kept)), row[kept]
    size, wide = np.bincount(row, minlength=n), np.asarray(values).astype(np.float64)
    offsets = pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32())
    uni = {"l2": wide * wide, "jaccard": np.abs(np.sign(wide)), "ruzicka": np.abs(wide)}
    found = pa.RecordBatch.from_arrays(
        [
            batch.column(0), pa.ListArray.from_arrays(offsets, flat.filter(pa.array(kept))), pa.ListArray.from_arrays(offsets, values), pa.array(size.astype(np.int32)),
            *(pa.array(np.bincount(row, weights=uni[name], minlength=n)) for name in UNI),
        ],
        [batch.schema.names[0], "terms", "values", "n_terms", *UNI.values()],
    )
    return found.filter(pa.array(size > 0))


def exploded(rows: DataFrame, id_col: str = "row_num") -> DataFrame:
    """Postings of canonical records: id, term, value (float), and their record's n_terms and unilateral values."""
    pair = F.explode(F.arrays_zip("terms", "values")).alias("p")
    return rows.select(id_col, pair, "n_terms", *UNI.values()).select(id_col, F.col("p.terms").alias("term"), F.col("p.values").alias("value"), "n_terms", *UNI.values())


def full_postings(records: DataFrame, id_col: str = "row_num") -> DataFrame:
    """Postings of sparse records with what they carry of their record; see canonical and exploded."""
    return exploded(canonical(records, id_col), id_col)


def postings(records: DataFrame, id_col: str = "row_num") -> DataFrame:
    """id, term, value of sparse records; see canonical."""
    return bare(full_postings(records, id_col), id_col)


def uni_values(rows: DataFrame, comparator_name: str, id_col: str = "row_num") -> DataFrame:
    """id and uni, the unilateral value of each record's postings."""
    return rows.groupBy(id_col).agg(F.sum(comparator(comparator_name).uni(F.col("value"))).alias("uni"))


def with_uni(rows: DataFrame, comparator_name: str, id_col: str = "row_num") -> DataFrame:
    """Postings with their record's unilateral value: that which they carry, or the sum over their terms."""
    c = comparator(comparator_name)
    if UNI[c.name] in rows.columns:
        return rows.withColumn("uni", F.col(UNI[c.name]))
    return rows.withColumn("uni", F.sum(c.uni(F.col("value"))).over(Window.partitionBy(id_col)))


def with_n_terms(rows: DataFrame, id_col: str = "row_num") -> DataFrame:
    """Postings with their record's number of terms."""
    if "n_terms" in rows.columns:
        return rows
    return rows.withColumn("n_terms", F.count(F.lit(1)).over(Window.partitionBy(id_col)).cast("int"))


def bare(rows: DataFrame, id_col: str = "row_num") -> DataFrame:
    """Postings without what they carry of their record, which no longer holds once some of them are left out."""
    return rows.select(id_col, "term", "value")
