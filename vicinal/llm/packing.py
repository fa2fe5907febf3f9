"""Best-fit-decreasing packing of token sequences, with a segment tree over remaining capacities.

1. One pass tokenizes whole texts, cuts what is longer than a sequence, and numbers the pieces of each size within
   their task. The pieces, without their tokens, are written to a table in the shared folder.
2. Best-fit decreasing only needs to know how many pieces there are of each size. The driver sums up at most
   `capacity` counts and packs them, all equal pieces and all equally full bins at a time; every placement still goes
   to the tightest open bin, which a segment tree over the capacities finds in logarithmic time.
3. A piece's rank among all of its size then says its sequence and offset: a lookup in the table of placements.

Defined results: a null or empty text is its end token alone; repeated rows are packed like any other row; an empty
table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

import unicodedata
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from . import _text
from ._held import held, tidy
from ._session import small_batches, written

CAPACITY = 4096
END_ID = 1
#: Words of which a worker keeps the tokens, at most; then it begins anew.
KEPT_WORDS = 700_000

# A text may be cut at ASCII white space, and before ASCII punctuation that follows a letter or digit: the tokenizer
# drops white space, always breaks at such places, and normalisation does not compose across them. Beyond ASCII only
# U+00C0 to U+017F count as letters here, without the two signs among them and the one whose lower case is no letter.
_PLAIN = np.zeros(256, dtype=bool)
_PLAIN[48:58] = _PLAIN[65:91] = _PLAIN[97:123] = True
_BREAK = np.zeros(256, dtype=bool)
_BREAK[list(b".,!?;:%$#&*")] = True


#: Words of letters that are tokenized in one call.
JOINED = 512


def _letters(word: str) -> bool:
    """Whether the tokenizer takes the word as a whole."""
    return word.isalpha() and (word.isascii() or unicodedata.normalize("NFC", word).lower().isalpha())


class WordTokenizer:
    """Token ids of whole texts, from the tokens of each distinct word, which are asked of the tokenizer once."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.closes = np.zeros(self.tokenizer.get_vocab_size() + 1, dtype=bool)  # tokens that end a word
        self.closes[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith("</w>")]] = True
        self.reset()

    def reset(self) -> None:
        self.keys = np.zeros(0, np.uint64)  # sorted
        self.slot = np.zeros(0, np.int64)
        self.begin, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def learn(self, keys: np.ndarray, texts: list[str]) -> None:
        """Keep the tokens of new words. Words of letters alone are one token group each, so many share one call."""
        size = np.zeros(len(texts), np.int64)
        single = np.fromiter((_letters(x) for x in texts), bool, len(texts))
        groups = []
        for at in (np.flatnonzero(single), np.flatnonzero(~single)):
            asked = [texts[i] for i in at.tolist()]
            if single[at].any():
                asked = [" ".join(asked[i : i + JOINED]) for i in range(0, len(asked), JOINED)]
            got = [np.array(e.ids, np.int64) for e in self.tokenizer.encode_batch_fast(asked, add_special_tokens=False)]
            ids = np.concatenate(got) if got else np.zeros(0, np.int64)
            size[at] = np.diff(np.flatnonzero(self.closes[ids]), prepend=-1) if single[at].any() else list(map(len, got))
            groups.append((at, ids))
        order = np.concatenate([g[0] for g in groups])
        begin = np.empty(len(texts), np.int64)
        begin[order] = len(self.ids) + np.concatenate([[0], np.cumsum(size[order])[:-1]])
        slot = np.arange(len(self.size), len(self.size) + len(keys))
        self.ids = np.concatenate([self.ids, *(g[1].astype(np.uint32) for g in groups)])
        self.begin, self.size = np.concatenate([self.begin, begin]), np.concatenate([self.size, size])
        at = np.searchsorted(self.keys, keys)
        self.keys, self.slot = np.insert(self.keys, at, keys), np.insert(self.slot, at, slot)

    def encode(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All token ids of a chunk's rows, and the bounds of the rows in them."""
        if len(self.keys) > KEPT_WORDS:
            self.reset()
        w = _split(data, bounds)
        special = b"<|" in data.tobytes()
        h = _text.word_hashes(data if special else _text.lower(data), w)
        uniq, first, inverse = np.unique(h, return_index=True, return_inverse=True)
        at = np.searchsorted(self.keys, uniq)
        new = np.ones(len(uniq), bool)
        inside = at < len(self.keys)
        new[inside] = self.keys[at[inside]] != uniq[inside]
        if new.any():
            raw = data.tobytes()
            pick = first[new]
            self.learn(uniq[new], [raw[a:b].decode() for a, b in zip(w.start[pick].tolist(), w.end[pick].tolist(), strict=True)])
        slot = self.slot[np.searchsorted(self.keys, uniq)][inverse]
        size = self.size[slot]
        before = np.concatenate([[0], np.cumsum(size)])
        flat = np.repeat(self.begin[slot] - before[:-1], size) + np.arange(before[-1])
        return self.ids[flat], before[w.rows]


def _split(data: np.ndarray, bounds: np.ndarray) -> _text.Words:
    w = _text.words(data, bounds, _text.SPACED)
    if len(data) < 2:
        return w
    cut = np.flatnonzero(_BREAK[data]) if bounds[0] == 0 else np.zeros(0, np.int64)
    cut = cut[cut > 0]
    before, lead = data[cut - 1], data[np.maximum(cut - 2, 0)]
    latin = (lead >= 0xC3) & (lead <= 0xC5) & (before >= 0x80) & (before <= 0xBF)
    latin &= ~((lead == 0xC3) & ((before == 0x97) | (before == 0xB7))) & ~((lead == 0xC4) & (before == 0xB0))
    cut = cut[_PLAIN[before] | latin]
    first = np.zeros(len(data) + 1, bool)
    first[bounds] = True
    cut = cut[~first[cut]]
    start, end = np.sort(np.concatenate([w.start, cut])), np.sort(np.concatenate([w.end, cut]))
    return _text.Words(start, end, np.searchsorted(start, bounds))


def tokenizer(path: str) -> WordTokenizer:
    return held(("tokenizer", path), lambda: WordTokenizer(path))


def pieces(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Per piece: id, piece, start, length, ids_crc32, and its task and its rank in the task among pieces of its size."""
    kind = df.schema[id_col].dataType.simpleString()

    @tidy
    def run(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        tok = tokenizer(path)
        seen = np.zeros(capacity + 1, np.int64)
        end = np.array([end_id], np.uint32)
        for b in batches:
            for c in _text.chunks(b.column(1)):
                ids, rows = tok.encode(c.data, c.bounds)
                out = []
                for r in range(c.rows):
                    whole = np.concatenate([ids[rows[r] : rows[r + 1]], end]).astype("<u4", copy=False)
                    for p, a in enumerate(range(0, len(whole), capacity)):
                        cut = whole[a : a + capacity]
                        out.append((c.first + r, p, a, len(cut), zlib.crc32(cut.tobytes()), seen[len(cut)]))
                        seen[len(cut)] += 1
                cols = [pa.array(x, pa.int64()) for x in zip(*out, strict=True)]
                at = cols[0]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(at), cols[1].cast(pa.int32()), cols[2], cols[3], cols[4], pa.array(np.full(len(at), part), pa.int64()), cols[5]],
                    ["id", "piece", "start", "length", "ids_crc32", "part", "nth"],
                )

    small_batches(df.sparkSession)
    schema = f"id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, part bigint, nth bigint"
    return df.select(id_col, text_col).mapInArrow(run, schema)


class CapacityTree:
    """Segment tree over remaining capacities 0 .. top: which of them have open bins."""

    def __init__(self, top: int):
        self.leaves = 1 << (top + 1).bit_length()
        self.any = bytearray(2 * self.leaves)

    def set(self, capacity: int, on: bool) -> None:
        i = capacity + self.leaves
        self.any[i] = on
        while i > 1:
            i //= 2
            self.any[i] = self.any[2 * i] | self.any[2 * i + 1]

    def tightest(self, size: int) -> int:
        """The smallest capacity of an open bin that is at least size, or -1."""
        i = size + self.leaves
        if self.any[i]:
            return size
        while i > 1:
            if i % 2 == 0 and self.any[i + 1]:
                i += 1
                while i < self.leaves:
                    i = 2 * i + (not self.any[2 * i])
                return i - self.leaves
            i //= 2
        return -1


def best_fit(counts: dict[int, int], capacity: int) -> tuple[np.ndarray, int]:
    """Placements and the number of bins, for counts of pieces by size.

    A placement (size, rank, bin, offset, per_bin) says: the pieces of that size from that rank on go to the bins
    from that one on, per_bin to each, first at that offset. Bins stand in runs of equally filled neighbours, so a
    step moves a whole run; the outcome is that of placing the pieces one by one, largest first, each into the
    tightest bin that has room.
    """
    tree = CapacityTree(capacity)
    runs: dict[int, list[tuple[int, int]]] = {}  # remaining capacity: runs (first bin, bins)
    bins, out = 0, []

    def put(room: int, run: tuple[int, int]) -> None:
        if room:
            held = runs.setdefault(room, [])
            held.append(run)
            if len(held) == 1:
                tree.set(room, True)

    for size in sorted(counts, reverse=True):
        left, rank = counts[size], 0
        while left:
            room = tree.tightest(size)
            if room < 0:
                room, per = capacity, capacity // size
                first, n = bins, -(-left // per)
                bins += n
            else:
                first, n = runs[room].pop()
                if not runs[room]:
                    tree.set(room, False)
                per = room // size
            full = min(n, left // per)
            if full:
                out.append((size, rank, first, capacity - room, per))
                put(room - per * size, (first, full))
                rank, left = rank + full * per, left - full * per
            if full < n and left:
                out.append((size, rank, first + full, capacity - room, per))
                put(room - left * size, (first + full, 1))
                rank, left, full = rank + left, 0, full + 1
            if full < n:
                put(room, (first + full, n - full))
    return np.array(out, dtype=np.int64).reshape(-1, 5), bins


def pack(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Per piece: id, piece, start, length, ids_crc32, sequence_id, offset."""
    cut = written(pieces(df, path, id_col, text_col, capacity, end_id), "pieces")
    # One row for each task and size, then sums before it: no window holds more rows than there are tasks.
    per_task = cut.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_task.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("from"))
    sizes = per_task.groupBy("length").agg(F.sum("n").alias("n")).collect()  # at most `capacity` rows
    plan, _ = best_fit({r["length"]: r["n"] for r in sizes}, capacity)
    key = plan[:, 0] << 44 | plan[:, 1] if len(plan) else np.zeros(0, np.int64)
    order = np.argsort(key)
    key, plan = key[order], plan[order]
    ranked = cut.join(offsets, ["length", "part"]).select("id", "piece", "start", "length", "ids_crc32", (F.col("from") + F.col("nth")).alias("rank"))

    @tidy
    def place(batches):
        for b in batches:
            size, rank = (np.asarray(b.column(i)) for i in (3, 5))
            at = np.searchsorted(key, size << 44 | rank, side="right") - 1
            p = plan[at]
            nth = rank - p[:, 1]
            seq, off = p[:, 2] + nth // p[:, 4], p[:, 3] + nth % p[:, 4] * size
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(seq), pa.array(off)], ["id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    kind = df.schema[id_col].dataType.simpleString()
    got = ranked.mapInArrow(place, f"id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint")
    return got.withColumnRenamed("id", id_col)
