"""Benchmark decontamination by latent semantic retrieval.

1. Passages of PASSAGE words of all documents and benchmark items are rows of a TF-IDF matrix over hashed words; document frequencies
   are counted over all of them. Words of very many passages keep a small weight.
2. A distributed randomised SVD finds the leading right singular vectors: each pass adds up A'(A Q) over the tasks in a tree of
   partial sums of a fixed size, the driver only decomposes the sum. The first DROPPED vectors, which tell languages and function words
   apart, are left out, as they make all texts of a language alike.
3. Windows of every document, of three widths a quarter of a width apart, are compared with the items in the latent space; the
   cosine proposes candidates. Of those, regions that hold too few of an item's words for any common subsequence to confirm
   them are passed over. Every other region that holds enough of them is a candidate too, whatever its cosine is.
4. A candidate region is confirmed word by word: by the longest common subsequence with the whole item, or by a shorter one
   together with the item's answer, its last words. So reworded, interrupted and re-punctuated copies are found too.

Items are taken in sets of ITEM_SET, each sent to the tasks once. Documents are never shuffled.

A character of a script without spaces (Chinese, Japanese, Thai, Lao, Burmese, Khmer) is a word, and counts as half of one below.

Defined results: null or wordless texts match nothing; items of fewer than LEAST_WORDS words match where all their words stand
in a row; ties between places go to the first; repeated documents and items, null ids included, are reported each, and an item id of
several texts as often as its texts are found; texts and items of any length are read whole; an empty table on either side gives no
hits; ids are of any type; extra columns are ignored by `hits` and passed through by `clean`.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from . import _text
from ._held import held, tidy
from ._session import small_batches

BITS, RANK, DROPPED, OVERSAMPLE, PASSES = 13, 64, 4, 8, 1
PASSAGE, BLOCK, WIDTHS = 64, 4, (16, 32, 64)
#: Sizes of working arrays, which bound memory and change no result: passages and words of the dense part, words and pairs of window and item.
PASSAGES_AT_ONCE, OFTEN, WORDS_AT_ONCE, PAIRS_AT_ONCE, FAN_IN = 1024, 512, 1 << 18, 1 << 20, 6
LEAST_WORDS = 5
COSINE = 0.4
#: Hashed words of a larger share of the passages have the small weight WEAK.
MOST_FREQUENT, WEAK = 0.1, 0.05
#: Share of an item's words in a common subsequence that confirms it alone (for an item of at least LONG words), and together with its answer.
LCS_ALONE, LONG, LCS_LONG, LCS_WITH_ANSWER, ANSWER_SHARE, ANSWER_FOUND = 0.75, 16, 0.65, 0.55, 4, 0.8
ITEM_SET = 4096
#: A word that a larger share of the items has counts as present everywhere when regions are passed over.
COMMON = 0.1
HIT = "cosine double, lcs double, answer double, first_word bigint"


def _unspaced(data: np.ndarray) -> np.ndarray:
    """First bytes of the characters of scripts without spaces."""
    at = np.flatnonzero(data >= 0xE0)
    at = at[at + 1 < len(data)]
    a, b = data[at], data[at + 1]
    ok = (a >= 0xE4) & (a <= 0xE9) | (a == 0xE0) & (b >= 0xB8) & (b <= 0xBB) | (a == 0xE1) & ((b == 0x80) | (b == 0x81) | (b == 0x9E) | (b == 0x9F))
    ok |= (a == 0xE3) & (b >= 0x81) | (a == 0xEF) & (b >= 0xA4) & (b <= 0xAB) | (a == 0xF0) & (b >= 0xA0)
    return at[ok]


def _cut(w: _text.Words, data: np.ndarray, bounds: np.ndarray) -> _text.Words:
    """Words, cut around each character of a script without spaces."""
    lead = _unspaced(data)
    if not len(lead):
        return w
    edges = np.unique(np.concatenate([w.start, lead, lead + np.where(data[lead] == 0xF0, 4, 3)]))
    word = np.searchsorted(w.start, edges, side="right") - 1
    inside = edges < w.end[word]
    start, word = edges[inside], word[inside]
    return _text.Words(start, np.minimum(w.end[word], np.append(start[1:], len(data))), np.searchsorted(start, bounds))


def _chunks(column: pa.Array):
    """Chunks of the texts in lower case, letters beyond ASCII too."""
    return _text.chunks(pc.utf8_lower(column))


def _words(c: _text.Chunk) -> tuple[_text.Words, np.ndarray, np.ndarray]:
    w = _cut(_text.words(c.data, c.bounds, _text.ALNUM), c.data, c.bounds)
    h = _text.word_hashes(c.data, w)
    return w, h, (h >> np.uint64(64 - BITS)).astype(np.uint16)


def _starts(rows: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """First words of the blocks of `size` words, which begin anew in every row, and the rows' first blocks. rows: bounds of the rows in words."""
    counts = np.diff(rows)
    n = -(-counts // size)
    first = np.concatenate([[0], np.cumsum(n)])
    row = np.repeat(np.arange(len(counts)), n)
    return rows[row] + (np.arange(first[-1]) - first[row]) * size, first


def _passages(chunks):
    """Hashed words, each word's passage and the number of passages, some thousand passages at a time."""
    for c in chunks:
        w, _, f = _words(c)
        if not len(f):
            continue
        at, _ = _starts(w.rows, PASSAGE)
        for a in range(0, len(at), PASSAGES_AT_ONCE):
            some = np.append(at[a : a + PASSAGES_AT_ONCE], at[a + PASSAGES_AT_ONCE] if a + PASSAGES_AT_ONCE < len(at) else len(f))
            yield f[some[0] : some[-1]].astype(np.int64), np.repeat(np.arange(len(some) - 1), np.diff(some)), len(some) - 1


def _block_sums(table: np.ndarray, f: np.ndarray, at: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Sums of the table's rows over blocks of at most BLOCK words. The table's last row is zero."""
    out = table[f[at]]
    for j in range(1, BLOCK):
        inside = at + j < end
        out += table[np.where(inside, f[np.minimum(at + j, len(f) - 1)], len(table) - 1)]
    return out


def _padded(table: np.ndarray) -> np.ndarray:
    return np.concatenate([table, np.zeros((1, table.shape[1]))]).astype(np.float32)


def _summed(texts: DataFrame, make, shape: tuple[int, ...]) -> np.ndarray:
    """The sum over all tasks of the array that make(chunks) returns, added up in rounds of partial sums of about FAN_IN arrays each."""

    @tidy
    def run(batches):
        total = make(c for b in batches for c in _chunks(b.column(0)))
        yield pa.RecordBatch.from_arrays([pa.array([total.astype("<f4").tobytes()], pa.binary())], ["z"])

    @tidy
    def add(batches):
        total = None
        for b in batches:
            for z in b.column(0):
                one = np.frombuffer(z.as_buffer(), "<f4").astype(np.float64)
                total = one if total is None else total + one
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.astype("<f4").tobytes()], pa.binary())], ["z"])

    parts = texts.mapInArrow(run, "z binary")
    width = int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    while True:
        parts = parts.repartition(width).mapInArrow(add, "z binary")
        if width == 1:
            break
        width = -(-width // FAN_IN)
    got = parts.first()
    return np.frombuffer(got[0], "<f4").astype(np.float64).reshape(shape) if got else np.zeros(shape)


def _frequencies(chunks) -> np.ndarray:
    out = np.zeros((1 << BITS) + 1)
    for f, passage, n in _passages(chunks):
        key = np.sort((passage << BITS | f).astype(np.uint32))  # each passage's words once
        once = np.append(True, key[1:] != key[:-1])
        out[:-1] += np.bincount(key[once] & ((1 << BITS) - 1), minlength=1 << BITS)
        out[-1] += n
    return out


def _pull(idf: np.ndarray, df: np.ndarray, q: np.ndarray):
    """chunks -> A'(A q), the rows of A being passages.

    The OFTEN most frequent words, most of all that occur, are counted into a small dense matrix; the others are summed up one column
    of q at a time.
    """
    often = np.sort(np.argsort(-df, kind="stable")[:OFTEN])
    place = np.full(len(idf), -1)
    place[often] = np.arange(len(often))
    scaled = idf[:, None] * q
    dense, columns = scaled[often].astype(np.float32), np.ascontiguousarray(scaled.T)

    def make(chunks):
        out, top = np.zeros(columns.shape), np.zeros(dense.shape)
        for f, passage, n in _passages(chunks):
            spot = place[f]
            known = spot >= 0
            counts = np.bincount(passage[known] * len(often) + spot[known], minlength=n * len(often)).reshape(n, -1).astype(np.float32)
            f, passage = f[~known], passage[~known]
            y = (counts @ dense).T.astype(np.float64)
            for j, column in enumerate(columns):
                y[j] += np.bincount(passage, weights=column[f], minlength=n)
                out[j] += np.bincount(f, weights=y[j][passage], minlength=len(idf))
            top += counts.T @ y.T.astype(np.float32)
        out = np.ascontiguousarray(out.T)
        out[often] += top
        return out * idf[:, None]

    return make


@dataclass(frozen=True)
class Space:
    """Latent coordinates of each hashed word, times its inverse document frequency, and a row of zeros."""

    words: np.ndarray


def fit(docs: DataFrame, items: DataFrame, text_col: str = "text", item_text: str = "text", seed: int = 0) -> Space:
    small_batches(docs.sparkSession)
    texts = docs.select(F.col(text_col).alias("t")).unionByName(items.select(F.col(item_text).alias("t")))
    df = _summed(texts, _frequencies, ((1 << BITS) + 1,))
    n, df = df[-1], df[:-1]
    idf = np.where(df <= MOST_FREQUENT * n, np.log((1 + n) / (1 + df)), WEAK)
    q = np.linalg.qr(np.random.default_rng(seed).normal(size=(1 << BITS, RANK + OVERSAMPLE)))[0]
    for _ in range(PASSES):
        z = _summed(texts, _pull(idf, df, q), q.shape)
        q = np.linalg.svd(z, full_matrices=False)[0]
    q = q[:, DROPPED:RANK]
    return Space(_padded(idf[:, None] * q))


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


#: row, item, cosine, lcs, answer, first word of the region
Hit = tuple[int, int, float, float, float, int]


class Screen:
    """One set of items, ready to be found in chunks of documents. Items are numbered by size; hits name them by their place in ids."""

    def __init__(self, space: Space, ids: list, texts: list[str | None]):
        self.words, self.ids = space.words, ids
        self.short: dict[int, list[tuple[int, int]]] = {}  # hash of the whole sequence and place, by the number of words
        found: list[tuple[int, np.ndarray, np.ndarray]] = []
        for c in _chunks(pa.array(texts, pa.string())):
            w, h, f = _words(c)
            half = np.cumsum(np.append(0, np.isin(w.start, _unspaced(c.data))))
            for r in range(c.rows):
                a, z = int(w.rows[r]), int(w.rows[r + 1])
                if z - a - (half[z] - half[a]) / 2 >= LEAST_WORDS:
                    found.append((c.first + r, h[a:z], f[a:z]))
                elif z > a:
                    self.short.setdefault(z - a, []).append((int(_text.gram_hashes(h[a:z], z - a)[0]), c.first + r))
        found.sort(key=lambda x: len(x[1]))
        self.places = np.array([x[0] for x in found], np.int64)
        self.items = [x[1] for x in found]
        self.masks = [self._mask(x) for x in self.items]
        self._index_words()
        # The vectors of each width, by item; a longer item has one for each stretch of the largest width.
        self.by_width: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for width in WIDTHS:
            parts = [(i, f[s : s + width]) for i, (_, _, f) in enumerate(found) if self.width[i] == width for s in range(0, len(f), width)]
            parts = [(i, f) for i, f in parts if len(f) >= LEAST_WORDS]
            if parts:
                self.by_width[width] = np.array([i for i, _ in parts]), _unit(np.stack([self.words[f].sum(axis=0) for _, f in parts])).astype(np.float32)

    @staticmethod
    def _mask(words: np.ndarray) -> dict[int, int]:
        mask: dict[int, int] = {}
        for i, x in enumerate(words.tolist()):
            mask[x] = mask.get(x, 0) | 1 << i
        return mask

    def _index_words(self) -> None:
        """Rare words of each item, by word, and how many of them any region must hold that a common subsequence can confirm.

        Rare are words of at most COMMON of the items; an item without enough of those takes its next rarest words too.
        """
        size = self.sizes = np.array([len(x) for x in self.items], np.int64)
        sets = [np.unique(x, return_counts=True) for x in self.items]
        known, df = np.unique(np.concatenate([*(x for x, _ in sets), np.zeros(0, np.uint64)]), return_counts=True)
        least = np.ceil(LCS_WITH_ANSWER * size - 1e-9).astype(np.int64)
        self.needed, self.distinct_needed = np.zeros(len(sets), np.int64), np.zeros(len(sets), np.int64)
        words, owners = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for i, (x, times) in enumerate(sets):
            d = df[np.searchsorted(known, x)]
            order = np.argsort(d, kind="stable")
            covered = np.cumsum(times[order])
            goal = -(-size[i] // 4) + size[i] - least[i]
            n = max(int((d <= max(1, COMMON * len(sets))).sum()), int(np.searchsorted(covered, goal)) + 1)
            self.needed[i] = least[i] - (size[i] - covered[n - 1])
            self.distinct_needed[i] = self.needed[i] - (covered[n - 1] - n)
            words.append(x[order[:n]])
            owners.append(np.full(n, i))
        word, item = np.concatenate(words), np.concatenate(owners)
        order = np.argsort(word, kind="stable")
        self.rare, n = np.unique(word, return_counts=True)
        self.rare_items = item[order]
        self.rare_first = np.concatenate([[0], np.cumsum(n)])
        self.width = np.array([next((w for w in WIDTHS if w >= n), WIDTHS[-1]) for n in size.tolist()], np.int64)

    def _rare_words(self, h: np.ndarray) -> np.ndarray:
        """Which rare word each of these words is, or -1."""
        if not len(self.rare):
            return np.full(len(h), -1)
        at = np.searchsorted(self.rare, h)
        at[at == len(self.rare)] = 0
        at[self.rare[at] != h] = -1
        return at

    def _rare_places(self, which: np.ndarray) -> np.ndarray:
        """Sorted item * number of words + position of every rare word of an item."""
        where = np.flatnonzero(which >= 0)
        at = which[where]
        n = self.rare_first[at + 1] - self.rare_first[at]
        listed = np.repeat(self.rare_first[at] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return np.sort(self.rare_items[listed] * len(which) + np.repeat(where, n))

    def _whole(self, rows: np.ndarray, h: np.ndarray) -> list[Hit]:
        """Hits of the short items, each row's first place."""
        out, row = [], np.repeat(np.arange(len(rows) - 1), np.diff(rows))
        for n, items in self.short.items():
            grams = _text.gram_hashes(h, n)
            at = np.flatnonzero(np.isin(grams, np.array([g for g, _ in items], np.uint64)))
            at = at[at + n <= rows[row[at] + 1]]
            first: dict[tuple[int, int], int] = {}
            for i in at.tolist():
                first.setdefault((int(row[i]), int(grams[i])), i)
            named: dict[int, list[int]] = {}
            for g, one in items:
                named.setdefault(g, []).append(one)
            out += [(r, one, 1.0, 1.0, 1.0, i - int(rows[r])) for (r, g), i in first.items() for one in named[g]]
        return out

    def _exact(self, places: np.ndarray, row_of_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """item, first and last word of every region that has as many of an item's rare words within a stretch as it needs."""
        n = len(row_of_word)
        item = places // n
        last = np.arange(len(places)) + self.needed[item] - 1
        at = np.flatnonzero(last < len(places))
        last = last[at]
        ok = (item[last] == item[at]) & (places[last] - places[at] < 2 * self.sizes[item[at]] + self.width[item[at]])
        at, last = at[ok], last[ok]
        lo, hi, item = places[at] - item[at] * n, places[last] - item[at] * n, item[at]
        ok = row_of_word[lo] == row_of_word[hi]
        lo, hi, item = lo[ok], hi[ok], item[ok]
        fresh = np.ones(len(lo), bool)
        fresh[1:] = (item[1:] != item[:-1]) | (row_of_word[lo[1:]] != row_of_word[lo[:-1]]) | (lo[1:] > hi[:-1])
        cuts = np.flatnonzero(fresh)
        return item[cuts], lo[cuts], hi[np.append(cuts[1:], len(lo)) - 1] if len(cuts) else hi[cuts]

    def lcs(self, item: int, words: list[int]) -> int:
        """Bits of the item's words that a longest common subsequence with these words matches (bit-parallel)."""
        mask, full = self.masks[item], (1 << len(self.items[item])) - 1
        v = full
        for x in words:
            m = mask.get(x)
            if m:
                u = v & m
                v = (v + u) | (v - u)
        return ~v & full

    def hits(self, c: _text.Chunk) -> list[Hit]:
        """The confirmed items of each row, each with its best place."""
        w, h, f = _words(c)
        if not len(f):
            return []
        found = self._whole(w.rows, h)
        if not self.items:
            return found
        if len(f) <= WORDS_AT_ONCE:
            return found + self._screened(w.rows, h, f)
        # Very long texts are cut into stretches that overlap by more than any region that one comparison confirms.
        overlap = 2 * int(self.sizes.max()) + WIDTHS[-1]
        step = max(WORDS_AT_ONCE, 2 * overlap)
        best: dict[tuple[int, int], Hit] = {}
        for r, (a, z) in enumerate(zip(w.rows[:-1].tolist(), w.rows[1:].tolist(), strict=True)):
            for s in range(a, max(a + 1, z - overlap), step):
                e = min(z, s + step + overlap)
                for _, one, cosine, share, answer, first in self._screened(np.array([0, e - s]), h[s:e], f[s:e]) if e > s else ():
                    if (r, one) not in best or share > best[r, one][3]:
                        best[r, one] = (r, one, cosine, share, answer, first + s - a)
        return found + list(best.values())

    def _windows(self, rows: np.ndarray, f: np.ndarray, at: np.ndarray, first: np.ndarray, block_end: np.ndarray, row: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each width the windows' first blocks and those after their last, a quarter of a width apart, and the sums of their words' coordinates."""
        gap = WIDTHS[-1] // BLOCK - 1  # zeros between rows
        spot, nth = np.arange(len(at)) + gap * row, np.arange(len(at)) - first[row]
        sums = np.zeros((len(at) + gap * len(rows), self.words.shape[1]), np.float32)
        sums[spot] = _block_sums(self.words, f, at, block_end)
        out, size = {}, BLOCK
        while size < WIDTHS[-1]:
            sums[: -size // BLOCK] += sums[size // BLOCK :]
            size *= 2
            if size in self.by_width:
                begin = np.flatnonzero(nth % max(1, size // BLOCK // 4) == 0)
                out[size] = begin, np.minimum(begin + size // BLOCK, first[row[begin] + 1]), sums[spot[begin]]
        return out

    def _proposed(self, width: int, windows, rows, at, first, block_end, row, places, n: int):
        """Regions of neighbouring windows whose cosine with an item is high enough and that hold enough of its rare words: item, lo, hi, cosine."""
        owner, vectors = self.by_width[width]
        begin, end, x = windows
        norm = np.maximum(np.sqrt(np.einsum("ij,ij->i", x, x)), 1e-9)
        # A cell reaches from the beginning of one window to that of the next; a window has four cells, as far as its row goes.
        cell = BLOCK * max(1, width // BLOCK // 4)
        cell_of_word, cells = np.repeat(np.arange(len(begin)), np.diff(at[begin], append=n)), np.searchsorted(begin, first)
        low, high = cells[row[begin]], cells[row[begin] + 1]
        items, opens = np.unique(owner, return_index=True)
        opens = np.append(opens, len(owner))
        most = max(1, PAIRS_AT_ONCE // max(1, len(begin)))
        out = []
        for i in range(0, len(items), most):
            some, vs = items[i : i + most], slice(opens[i], opens[min(i + most, len(items))])
            of = owner[vs]
            # Rare words of each item in the cells around a window: a region that holds too few cannot be confirmed.
            reach = width // 2 + (int(self.sizes[some].max()) if width == WIDTHS[-1] else 0)
            around, nth = -(-reach // cell), np.arange(len(begin))
            mine = places[np.searchsorted(places, some[0] * n) : np.searchsorted(places, (some[-1] + 1) * n)]
            spot = (cell_of_word[mine % n] + 1) * len(some) + mine // n - some[0]
            before = np.bincount(spot, minlength=(len(begin) + 1) * len(some)).astype(np.int32).reshape(-1, len(some))
            np.cumsum(before, axis=0, out=before)
            enough = before[np.minimum(nth + 4 + around, high)] - before[np.maximum(nth - around, low)] >= self.needed[some].astype(np.int32)
            cosine = x @ vectors[vs].T
            good = cosine >= COSINE * norm[:, None]
            good &= enough if len(of) == len(some) else enough[:, of - some[0]]
            win, col = np.divmod(np.flatnonzero(good), len(of))
            order = np.argsort(col, kind="stable")
            win, col = win[order], col[order]
            reach = width // 2 + (self.sizes[of[col]] if width == WIDTHS[-1] else 0)
            lo = np.maximum(at[begin[win]] - reach, rows[row[begin[win]]])
            hi = np.minimum(block_end[end[win] - 1] + reach, rows[row[begin[win]] + 1])
            n_rare = np.searchsorted(places, of[col] * n + hi) - np.searchsorted(places, of[col] * n + lo)
            ok = n_rare >= self.needed[of[col]]
            col, win, lo, hi = col[ok], win[ok], lo[ok], hi[ok]
            # Neighbouring windows of one item are one region.
            fresh = np.ones(len(win), bool)
            fresh[1:] = (col[1:] != col[:-1]) | (row[begin[win[1:]]] != row[begin[win[:-1]]]) | (begin[win[1:]] > end[win[:-1]])
            cuts = np.flatnonzero(fresh)
            if len(cuts):
                stops = np.append(cuts[1:], len(win))
                out.append((of[col[cuts]], lo[cuts], hi[stops - 1], np.maximum.reduceat(cosine[win, col] / norm[win], cuts)))
        return out

    def _distinct(self, which: np.ndarray, places: np.ndarray, opens: np.ndarray, shuts: np.ndarray) -> np.ndarray:
        """Number of different rare words in each run of places."""
        size = shuts - opens
        flat = np.repeat(opens - (np.cumsum(size) - size), size) + np.arange(size.sum())
        key = np.sort(np.repeat(np.arange(len(size)), size) * len(self.rare) + which[places[flat] % len(which)])
        return np.bincount(key[np.append(True, key[1:] != key[:-1])] // len(self.rare), minlength=len(size)) if len(key) else np.zeros(len(size), np.int64)

    def _screened(self, rows: np.ndarray, h: np.ndarray, f: np.ndarray) -> list[Hit]:
        n, which = len(h), self._rare_words(h)
        places = self._rare_places(which)
        if not len(places):
            return []
        at, first = _starts(rows, BLOCK)
        row = np.repeat(np.arange(len(rows) - 1), np.diff(first))
        block_end = np.minimum(at + BLOCK, rows[row + 1])
        row_of_word = np.repeat(np.arange(len(rows) - 1), np.diff(rows))
        windows = self._windows(rows, f, at, first, block_end, row)
        found = [x for width in self.by_width for x in self._proposed(width, windows[width], rows, at, first, block_end, row, places, n)]
        # Regions of enough rare words, whatever their cosine, come after those that the cosine proposes.
        items, los, his = self._exact(places, row_of_word)
        reach = self.sizes[items] + self.width[items] // 2
        of = row_of_word[los]
        found.append((items, np.maximum(los - reach, rows[of]), np.minimum(his + 1 + reach, rows[of + 1]), np.full(len(items), np.nan)))
        items, los, his, cosines = (np.concatenate(x) for x in zip(*found, strict=True))
        # Regions much longer than the item are confirmed in overlapping stretches, so that scattered words do not add up.
        stretch = 2 * self.sizes[items] + self.width[items]
        half = stretch // 2
        times = np.where(his - los > stretch, -(-np.maximum(1, his - half - los) // half), 1)
        which_region = np.repeat(np.arange(len(items)), times)
        nth = np.arange(len(which_region)) - np.repeat(np.cumsum(times) - times, times)
        items, cosines, stretch = items[which_region], cosines[which_region], stretch[which_region]
        los, his = los[which_region] + nth * half[which_region], his[which_region]
        his = np.minimum(his, los + stretch)
        opens, shuts = np.searchsorted(places, items * n + los), np.searchsorted(places, items * n + his)
        ok = self._distinct(which, places, opens, shuts) >= self.distinct_needed[items]
        best: dict[tuple[int, int], tuple[float, float, float, int]] = {}
        seen: dict[tuple[int, int], list[tuple[int, int]]] = {}
        for item, lo, hi, cosine in zip(*(x[ok].tolist() for x in (items, los, his, cosines)), strict=True):
            r, size = int(row_of_word[lo]), len(self.items[item])
            known = seen.setdefault((r, item), [])
            if any(x <= lo and hi <= y for x, y in known):
                continue
            known.append((lo, hi))
            got = self.lcs(item, h[lo:hi].tolist())
            share = got.bit_count() / size
            tail = max(2, size // ANSWER_SHARE)
            answer = (got >> (size - tail)).bit_count() / tail
            alone = LCS_LONG if size >= LONG else LCS_ALONE
            if (share >= alone or share >= LCS_WITH_ANSWER and answer >= ANSWER_FOUND) and ((r, item) not in best or share > best[r, item][0]):
                best[r, item] = (share, cosine if cosine == cosine else self._nearest(item, lo, hi, windows, at, block_end), answer, lo - int(rows[r]))
        return [(r, int(self.places[i]), cos, share, answer, s) for (r, i), (share, cos, answer, s) in sorted(best.items())]

    def _nearest(self, item: int, lo: int, hi: int, windows, at: np.ndarray, block_end: np.ndarray) -> float:
        """The best cosine of an item with the windows over these words; -1 without any."""
        width = int(self.width[item])
        owner, vectors = self.by_width[width]
        begin, end, x = windows[width]
        over = (at[begin] < hi) & (block_end[end - 1] > lo)
        return float((vectors[owner == item] @ _unit(x[over]).T).max(initial=-1.0))


def _sets(items: DataFrame, id_col: str, text_col: str):
    """Different items and how often each stands there, in sets of about ITEM_SET at most by a hash of id and text, and the type of the ids."""
    once = items.groupBy(F.col(id_col).alias("id"), F.col(text_col).alias("text")).agg(F.count(F.lit(1)).alias("n"))
    n_sets = max(1, -(-once.count() // ITEM_SET))
    for one in range(n_sets):
        rows = once.where(F.pmod(F.xxhash64("id", "text"), F.lit(n_sets)) == one).orderBy("id", "text").collect()
        yield [r["id"] for r in rows], [r["text"] for r in rows], np.array([r["n"] for r in rows], np.int64)


def _screen(shared) -> Screen:
    # The broadcast is kept with its screen, so that its identity stays its own.
    return held(("screen", id(shared)), lambda: (shared, Screen(*shared.value[:3])))[1]


def hits(docs: DataFrame, items: DataFrame, space: Space | None = None, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """Per document and confirmed item: id, item_id, cosine, lcs and answer (shares of the item's words), first_word of the region."""
    spark = docs.sparkSession
    small_batches(spark)
    space = space or fit(docs, items, text_col, item_text)
    kind, item_kind = docs.schema[id_col].dataType, items.schema[item_id].dataType
    arrow = to_arrow_type(item_kind)
    out = None
    for ids, texts, times in _sets(items, item_id, item_text):
        shared = spark.sparkContext.broadcast((space, ids, texts, times))

        @tidy
        def run(batches, shared=shared):
            screen, times = _screen(shared), shared.value[3]
            for b in batches:
                rows = [(c.first + x[0], *x[1:]) for c in _chunks(b.column(1)) for x in screen.hits(c)]
                if rows:
                    r, item, cosine, lcs, answer, first = (np.repeat(x, times[[y[1] for y in rows]]) for x in zip(*rows, strict=True))
                    yield pa.RecordBatch.from_arrays(
                        [b.column(0).take(pa.array(r)), pa.array([screen.ids[i] for i in item.tolist()], arrow), pa.array(cosine), pa.array(lcs), pa.array(answer), pa.array(first, pa.int64())],
                        ["id", "item_id", "cosine", "lcs", "answer", "first_word"],
                    )

        found = docs.select(id_col, text_col).mapInArrow(run, f"id {kind.simpleString()}, item_id {item_kind.simpleString()}, {HIT}")
        out = found if out is None else out.unionByName(found)
    return out.withColumnRenamed("id", id_col)


def clean(docs: DataFrame, items: DataFrame, space: Space | None = None, text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """Rows of docs, all columns, in which no item is confirmed. No shuffle."""
    small_batches(docs.sparkSession)
    space = space or fit(docs, items, text_col, item_text)
    at = docs.columns.index(text_col)
    out = docs
    for one in _sets(items, item_id, item_text):
        shared = docs.sparkSession.sparkContext.broadcast((space, *one))

        @tidy
        def run(batches, shared=shared):
            screen = _screen(shared)
            for b in batches:
                keep = np.ones(b.num_rows, bool)
                for c in _chunks(b.column(at)):
                    keep[[c.first + x[0] for x in screen.hits(c)]] = False
                yield b.filter(pa.array(keep))

        out = out.mapInArrow(run, docs.schema)
    return out
