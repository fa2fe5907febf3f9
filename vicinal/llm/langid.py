"""Language by cross-parsing entropy: suffix automata of labelled text, fewest normalised phrases wins.

`train` keeps a bounded sample of labelled text per language. Each worker builds one suffix automaton a language from
it, flattened to a dense transition table. `predict` cuts a whole text into the longest stretches that occur in a
language's sample; a phrase costs log2(sample length) bits, and the language of the lowest total wins
(ties: the smaller name). Texts are read as lower-case letters with single spaces, in segments that are parsed
side by side, one numpy step per position for thousands of segments; then the parse is carried over from each segment to the next, so
that phrases are as long as in a parse of the whole text.

Defined results: null, empty or letterless text gives `und` and score 0; without any labelled text everything is
`und`; rows with a null id are never learned from; repeated rows get equal results; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import _text
from ._held import held, tidy
from ._session import small_batches

#: Labelled rows a language whose text may be used, and bytes of it that are.
SAMPLE_ROWS, SAMPLE_BYTES = 64, 24_000
SEGMENT = 128
#: Positions of a segment at which a second parse looks whether it has met the first.
MARKS = (4, 8, 16, 32, 64, SEGMENT)
#: Bytes of text whose segments are parsed side by side.
CHUNK_BYTES = 1 << 21

_FOLD = np.full(256, 32, dtype=np.uint8)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def train(df: DataFrame, learn: Column, text_col: str = "text", lang_col: str = "lang", order_col: str = "doc_id") -> dict[str, bytes]:
    """Sample text per language: of the rows to learn from, the SAMPLE_ROWS with the smallest hash of their id, SAMPLE_BYTES together.

    Only ids are ranked; texts are fetched for at most SAMPLE_ROWS ids a language.
    """
    rows = df.where(learn & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    by = Window.partitionBy("lang").orderBy("h", "id")
    ids = rows.select(F.col(lang_col).alias("lang"), F.col(order_col).alias("id"), F.xxhash64(order_col).alias("h")).distinct()
    ids = ids.withColumn("r", F.row_number().over(by)).where(F.col("r") <= SAMPLE_ROWS)
    texts = rows.select(F.col(order_col).alias("id"), F.col(lang_col).alias("lang"), F.substring(text_col, 1, SAMPLE_BYTES).alias("text"))
    # Of rows with one id and language, one of the smallest text hash.
    one = F.min_by("text", F.xxhash64("text")).alias("text")
    chosen = texts.join(F.broadcast(ids.select("lang", "h", "id")), ["id", "lang"]).groupBy("lang", "h", "id").agg(one).collect()
    sample: dict[str, list[bytes]] = {}
    for row in sorted(set(chosen), key=lambda r: (r["lang"], r["h"], str(r["id"]))):
        text = pc.utf8_lower(pa.array([row["text"]]))
        for c in _text.chunks(text):
            sample.setdefault(row["lang"], []).append(folded(c.data, c.bounds)[0].tobytes())
    out = {lang: b" ".join(p for p in parts if p.strip())[:SAMPLE_BYTES] for lang, parts in sample.items()}
    return {lang: text for lang, text in sorted(out.items()) if text}


def folded(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes with letters lower-cased and each run of other characters as one space, and the new bounds."""
    out = _FOLD[data]
    keep = np.ones(len(out), dtype=bool)
    if len(out):
        blank = out == 32
        keep[1:] = ~(blank[1:] & blank[:-1])
        keep[bounds[:-1][np.diff(bounds) > 0]] = True
    before = np.concatenate([[0], np.cumsum(keep)])
    return out[keep], before[bounds]


def automaton(text: bytes) -> list[dict[int, int]]:
    """Transitions of the suffix automaton; state 0 is the root."""
    step: list[dict[int, int]] = [{}]
    link, length = [-1], [0]
    last = 0
    for c in text:
        new = len(step)
        step.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = new
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                twin = len(step)
                step.append(dict(step[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = twin
                    p = link[p]
                link[q] = link[new] = twin
        last = new
    return step


class Parser:
    """Tables of all languages over one common alphabet. Code 0 is any byte that no sample has, the last code is padding."""

    def __init__(self, sample: dict[str, bytes]):
        self.langs = sorted(sample)
        seen = sorted(set(b"".join(sample.values())))
        self.code = np.zeros(256, dtype=np.int32)
        self.code[seen] = np.arange(1, len(seen) + 1)
        self.pad = len(seen) + 1
        self.width = len(seen) + 2
        self.tables = [self._table(sample[x]) for x in self.langs]
        self.bits = np.array([np.log2(max(2, len(sample[x]))) for x in self.langs])

    def _table(self, text: bytes) -> np.ndarray:
        """Next state times the width. Where the phrase breaks, the state that the byte reaches from the root, as its complement."""
        states = automaton(text)
        root = np.full(self.width, -1, dtype=np.int32)
        for c, to in states[0].items():
            root[self.code[c]] = ~(to * self.width)
        table = np.tile(root, (len(states), 1))
        rows = np.repeat(np.arange(len(states)), [len(s) for s in states])
        flat = np.fromiter((x for s in states for kv in s.items() for x in kv), dtype=np.int32, count=2 * len(rows)).reshape(-1, 2)
        table[rows, self.code[flat[:, 0]]] = flat[:, 1] * self.width
        table[:, self.pad] = 0
        table[0, 0] = -1  # an unknown byte is a phrase of its own, and parsing goes on at the root
        return table.ravel()

    def phrases(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Phrases of each row in each language.

        Segments are first parsed side by side as if a phrase began with each. Then each is parsed again from the state in which
        the one before it really ends, until both parses stand in the same state, which is soon; where they never do, the next one begins anew.
        """
        lengths = np.diff(bounds)
        n_seg = -(-lengths // SEGMENT)
        total = int(n_seg.sum())
        out = np.zeros((len(lengths), len(self.langs)))
        if not total:
            return out
        owner = np.repeat(np.arange(len(lengths)), n_seg)
        first = np.concatenate([[0], np.cumsum(n_seg)])
        nth = np.arange(total) - first[owner]
        begin = bounds[owner] + nth * SEGMENT
        size = np.minimum(SEGMENT, bounds[owner + 1] - begin)
        order = np.argsort(-size, kind="stable")
        rank = np.empty(total, np.int64)
        rank[order] = np.arange(total)
        after = np.full(total, -1)  # the rank of the segment that follows in the same row
        inner = np.flatnonzero(nth[1:] > 0)
        after[rank[inner]] = rank[inner + 1]
        owner, begin, size = owner[order], begin[order], size[order]
        open_at = np.searchsorted(-size, -np.arange(1, SEGMENT + 1), side="right")  # segments of at least so many bytes
        codes = np.full((SEGMENT, total), self.pad, dtype=np.int32)
        for t, n in enumerate(open_at.tolist()):
            codes[t, :n] = self.code[data[begin[:n] + t]]
        for j, table in enumerate(self.tables):
            states = np.zeros((SEGMENT, total), dtype=np.int32)
            breaks = np.zeros((SEGMENT + 1, total), dtype=np.int16)  # before each position
            state = np.zeros(total, dtype=np.int32)
            for t in range(SEGMENT):
                n = open_at[t]
                to = table[state[:n] + codes[t, :n]]
                broke = to >> 31
                state[:n] = states[t, :n] = to ^ broke
                breaks[t + 1] = breaks[t]
                breaks[t + 1, :n] -= broke.astype(np.int16)
            count, end = breaks[SEGMENT].astype(np.int64), state
            before = np.flatnonzero(after >= 0)
            enter, todo = end[before], after[before]
            while len(todo):
                # In lockstep; lanes that stand where the first parse stood leave at the next mark.
                was, here, now, number = end[todo], todo, enter, np.zeros(len(todo), np.int64)
                t = 0
                for mark in MARKS:
                    for t in range(t, mark):
                        to = table[now + codes[t, here]]
                        broke = to >> 31
                        now = to ^ broke
                        number -= broke
                    t = mark
                    met = now == states[mark - 1, here] if mark < SEGMENT else np.zeros(len(here), bool)
                    count[here[met]] = number[met] + breaks[SEGMENT, here[met]] - breaks[mark, here[met]]
                    end[here[met]] = states[SEGMENT - 1, here[met]]
                    here, now, number = here[~met], now[~met], number[~met]
                    if not len(here):
                        break
                count[here], end[here] = number, now
                changed = (end[todo] != was) & (after[todo] >= 0)
                enter, todo = end[todo[changed]], after[todo[changed]]
            out[:, j] = np.bincount(owner, weights=count, minlength=len(lengths)) + (lengths > 0)
        return out


def _parser(sample: dict[str, bytes]) -> Parser:
    return held(("parser", tuple(sorted(sample.items()))), lambda: Parser(sample))


def classify(column: pa.Array, sample: dict[str, bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Language and score of each text. The score is the share of the runner-up's bits that the winner saves; 1 without a runner-up."""
    n = len(column)
    langs, scores = np.full(n, "und", dtype=object), np.zeros(n)
    if not sample or not n:
        return langs, scores
    parser = _parser(sample)
    column = pc.utf8_lower(column)
    letter = np.asarray(pc.fill_null(pc.match_substring_regex(column, r"\pL"), False))
    names = np.array(parser.langs, dtype=object)
    for c in _text.chunks(column, CHUNK_BYTES):
        data, bounds = folded(c.data, c.bounds)
        cost = parser.phrases(data, bounds) * parser.bits
        best = np.argmin(cost, axis=1)
        low = cost[np.arange(len(best)), best]
        cost[np.arange(len(best)), best] = np.inf
        second = cost.min(axis=1) if len(names) > 1 else np.full(len(best), np.inf)
        with np.errstate(invalid="ignore", divide="ignore"):
            gain = np.where(np.isfinite(second), 1 - low / second, 1.0)
        at = slice(c.first, c.first + c.rows)
        ok = letter[at]
        langs[at] = np.where(ok, names[best], "und")
        scores[at] = np.where(ok, np.clip(np.nan_to_num(gain), 0, 1), 0)
    return langs, scores


def predict(df: DataFrame, sample: dict[str, bytes], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the id, lang_pred, score. No shuffle."""

    @tidy
    def run(batches):
        for b in batches:
            langs, scores = classify(b.column(1), sample)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(langs, pa.string()), pa.array(scores)], ["id", "lang_pred", "score"])

    small_batches(df.sparkSession)
    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, text_col).mapInArrow(run, f"id {kind}, lang_pred string, score double").toDF(id_col, "lang_pred", "score")


def keep_known(df: DataFrame, sample: dict[str, bytes], text_col: str = "text") -> DataFrame:
    """Rows of df, all columns, whose language is not `und`. No shuffle."""
    at = df.columns.index(text_col)

    @tidy
    def run(batches):
        for b in batches:
            langs, _ = classify(b.column(at), sample)
            yield b.filter(pa.array(langs != "und"))

    small_batches(df.sparkSession)
    return df.mapInArrow(run, df.schema)
