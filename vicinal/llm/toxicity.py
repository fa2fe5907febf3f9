"""Toxicity by non-negative positive-unlabelled learning, with numpy alone.

Confirmed toxic rows are the positives; every row that may be learned from, whatever its label, is unlabelled. A
logistic model over hashed words is fitted to the class-prior-corrected risk

    prior * E_P[loss(+)] + max(0, E_U[loss(-)] - prior * E_P[loss(-)]),

whose second part estimates the risk on negatives; where a step would push it below zero, the step goes the other way
on that part, so the model cannot overfit the unlabelled rows. The prior is the share of positives among all labelled
rows. Fitting uses a bounded sample (POSITIVES, UNLABELLED rows); scoring covers every row and its whole text.

Defined results: a null or wordless text scores as the bias alone says; without positives or unlabelled rows every
score is 0; rows with a null id or label are never positives; repeated rows score alike, and of rows with one id one is learned from; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _text
from ._held import tidy
from ._session import small_batches

#: Bounds of the sample that the model is fitted to, in rows.
POSITIVES, UNLABELLED = 4000, 12000
BITS = 18
EPOCHS, BATCH, RATE, DECAY = 60, 512, 0.05, 1e-4
#: A feature whose rate among positives differs from that among unlabelled rows by fewer standard errors keeps weight 0.
LEAST_Z = 5.0


@dataclass(frozen=True)
class Model:
    weights: np.ndarray  # 2**BITS of them
    bias: float

    def scores(self, ids: np.ndarray, rows: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0.0], np.cumsum(self.weights[ids], dtype=np.float64)])
        return 1 / (1 + np.exp(-np.clip(total[rows[1:]] - total[rows[:-1]] + self.bias, -30, 30)))


def features(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed words of each row, rows after one another, and where each begins. Words are letters, digits and all beyond ASCII, in lower case."""
    data = _text.lower(data)
    w = _text.words(data, bounds, _text.ALNUM)
    ids = (_text.word_hashes(data, w) >> np.uint64(64 - BITS)).astype(np.int64)
    key = np.unique(_text.row_of(w) << BITS | ids)
    return key & ((1 << BITS) - 1), np.searchsorted(key, np.arange(len(bounds)) << BITS)


def _sample(docs: DataFrame, ids: DataFrame, id_col: str, text_col: str) -> list[np.ndarray]:
    """Features of the rows of docs whose id is in ids, a bounded table; of rows with one id, one of the smallest text hash."""

    @tidy
    def run(batches):
        for b in batches:
            out = []
            for c in _text.chunks(b.column(0)):
                got, rows = features(c.data, c.bounds)
                out += [got[rows[i] : rows[i + 1]].astype("<i4").tobytes() for i in range(c.rows)]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["f"])

    chosen = docs.join(F.broadcast(ids), id_col, "left_semi").groupBy(id_col).agg(F.min_by(text_col, F.xxhash64(text_col)).alias("text"))
    rows = chosen.select("text").mapInArrow(run, "f binary").collect()
    return [np.frombuffer(r["f"], "<i4").astype(np.int64) for r in sorted(rows, key=lambda r: bytes(r["f"]))]


def train(docs: DataFrame, labels: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", seed: int = 0) -> Model:
    """The model, from the rows that `learn` allows. The sample is that of the smallest hashes of the ids."""
    small_batches(docs.sparkSession)
    zero = Model(np.zeros(1 << BITS), -30.0)
    known = labels.where(learn & F.col(label_col).isNotNull()).select(id_col, label_col).distinct()
    n, n_pos = known.agg(F.count(F.lit(1)), F.sum((F.col(label_col) == 1).cast("long"))).first()
    if not n_pos:
        return zero
    prior = min(n_pos / n, 0.9)
    by_hash = F.xxhash64(F.col(id_col))
    pos_ids = known.where(F.col(label_col) == 1).select(id_col).orderBy(by_hash, id_col).limit(POSITIVES)
    all_ids = docs.where(learn).select(id_col).distinct().orderBy(by_hash, id_col).limit(UNLABELLED)
    pos, unl = _sample(docs, pos_ids, id_col, text_col), _sample(docs, all_ids, id_col, text_col)
    if not pos or not unl:
        return zero
    return fit(pos, unl, prior, seed)


def fit(pos: list[np.ndarray], unl: list[np.ndarray], prior: float, seed: int = 0) -> Model:
    """Adam on the non-negative risk; deterministic for a seed."""
    rng = np.random.default_rng(seed)
    # Copies of one text would make its rare words look typical, so equal rows count once in the choice of features.
    once = [list({x.tobytes(): x for x in xs}.values()) for xs in (pos, unl)]
    in_pos, in_unl = (np.bincount(np.concatenate(x), minlength=1 << BITS) for x in once)
    n_pos, n_unl = map(len, once)
    rate = (in_pos + in_unl) / (n_pos + n_unl)
    error = np.sqrt(rate * (1 - rate) * (1 / n_pos + 1 / n_unl))
    used = np.abs(in_pos / n_pos - in_unl / n_unl) > LEAST_Z * np.maximum(error, 1e-12)
    dense = np.cumsum(used) - 1  # places of the used features
    n_used = int(used.sum())
    pos, unl = ([dense[x[used[x]]] for x in xs] for xs in (pos, unl))
    theta = np.zeros(n_used + 1)
    theta[-1] = np.log(prior / (1 - prior))
    m, v, t = np.zeros_like(theta), np.zeros_like(theta), 0

    def batch(xs, at):
        rows = [xs[i] for i in at]
        return np.concatenate(rows) if rows else np.zeros(0, np.int64), np.repeat(np.arange(len(rows)), [len(r) for r in rows])

    def margin(ids, row, n):
        return np.bincount(row, weights=theta[ids], minlength=n) + theta[-1]

    def pull(ids, row, slope):
        g = np.bincount(ids, weights=slope[row], minlength=n_used + 1).astype(np.float64)
        g[-1] = slope.sum()
        return g

    n_steps = max(1, len(unl) // BATCH)
    for epoch in range(EPOCHS):
        order, rate = rng.permutation(len(unl)), RATE * (1 - epoch / EPOCHS)
        for s in range(n_steps):
            u_at = order[s * BATCH : (s + 1) * BATCH]
            p_at = rng.integers(0, len(pos), min(BATCH, max(64, len(pos))))
            pi, pr = batch(pos, p_at)
            ui, ur = batch(unl, u_at)
            p_prob = 1 / (1 + np.exp(-margin(pi, pr, len(p_at))))
            u_prob = 1 / (1 + np.exp(-margin(ui, ur, len(u_at))))
            negative = np.mean(-np.log1p(-np.minimum(u_prob, 1 - 1e-9))) - prior * np.mean(-np.log1p(-np.minimum(p_prob, 1 - 1e-9)))
            as_negative = pull(ui, ur, u_prob / len(u_at)) - pull(pi, pr, prior * p_prob / len(p_at))
            as_positive = pull(pi, pr, prior * (p_prob - 1) / len(p_at))
            g = as_positive + as_negative if negative >= 0 else -as_negative
            g[:-1] += DECAY * theta[:-1]
            t += 1
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            theta -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    weights = np.zeros(1 << BITS)
    weights[used] = theta[:-1]
    return Model(weights, float(theta[-1]))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id and score of the whole text. No shuffle."""
    small_batches(docs.sparkSession)
    at = np.flatnonzero(model.weights)
    slim, bias = (at.astype(np.int32), model.weights[at].astype(np.float32)), model.bias

    @tidy
    def run(batches):
        weights = np.zeros(1 << BITS)
        weights[slim[0]] = slim[1]
        held = Model(weights, bias)
        for b in batches:
            out = np.zeros(b.num_rows)
            for c in _text.chunks(b.column(1)):
                out[c.first : c.first + c.rows] = held.scores(*features(c.data, c.bounds)) if bias > -30 else 0.0
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out)], ["id", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"id {kind}, score double").toDF(id_col, "score")
