"""Near duplicates by a MinHash LSH forest, with links confirmed on full shingle sets.

1. One pass makes each document's set of distinct word shingles, its 128-bit fingerprint and its minima under HASHES hash
   functions. Documents with equal sets become one node, named by the smallest id.
2. The forest has TREES sorted orders of the nodes; tree t sorts by the minima t, t + 1, ... A region is a run of nodes with a common
   prefix, and those are each other's candidates. Its depth adapts: regions have a common first minimum; those of more than REGION
   nodes are counted again at longer and longer common prefixes until they are small enough, TURNS times along different minima.
   Counting is a partial aggregate, and a region is named by a hash of its prefix, so no task ever holds a larger one.
3. Before that, the nodes of such a large region are compared with the node nearest to the region's consensus, the likely original of many
   copies. Nodes that are linked with the same one need no more links with each other.
4. A pair whose signatures agree in too few places cannot be a link. A pair is left to an earlier tree only if that tree did not part its region.
5. Only nodes with likely partners fetch their texts again and carry their full sets to their parts, where pairs are confirmed in
   descending order of agreement. A pair that confirmed links connect already needs no link of its own, so a
   part of m nodes gives at most m - 1 links, of which components are then made.

A link at the threshold of 0.75 is seen by at least one of the 8 trees with probability 1 - 0.25**8, and passes the
signature test with probability over 0.999.

Defined results: a document without words has an empty set, is linked with nothing and is its own component; one with
fewer words than a shingle has its whole sequence as its one shingle; rows with a null id take no part: component_id
null, kept true; repeated rows share a component, and all rows with the smallest id are kept; an empty table gives an
empty table; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text
from ._held import tidy
from ._prefilter import marked
from ._session import small_batches, written
from .components import components

WIDTH, THRESHOLD = 5, (75, 100)
TREES, HASHES = 8, 96
#: Places of HASHES in which a linked pair agrees at least: 3.5 standard errors below 0.75.
LEAST_AGREE = 57
#: Nodes of a region that are compared with one another, and their shingles together (of more than FEW nodes); a larger region is parted.
REGION, SHINGLES, FEW = 6000, 1 << 23, 64
#: Ways in which a larger region is parted, each along minima of its own, and how far apart those begin.
TURNS, TURN_STEP = 4, 23
#: Lengths of the common prefixes, beyond the first minimum, at which a large region is counted again.
STEPS = (1, 2, 3, 4, 6, 8, 12, 16, 24, 32, 48, 64, 95)
#: Nodes whose most frequent minima are taken for a region's consensus, about.
VOTERS = 256
#: Bits of the filter that names large regions: a false positive parts a region that need not be parted.
LEAST_BITS, MOST_BITS = 1 << 16, 1 << 26
#: Bytes of full sets that a task sends on at once.
SENT_BYTES = 1 << 23

_SEEDS = _text.mix(np.arange(1, HASHES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def shingles(data: np.ndarray, bounds: np.ndarray, width: int = WIDTH) -> list[np.ndarray]:
    """The distinct hashed shingles of each row, sorted. A row of fewer words has one, of all of them."""
    data = _text.lower(data)
    w = _text.words(data, bounds, _text.SPACED)
    h = _text.word_hashes(data, w)
    grams = _text.gram_hashes(h, width)
    out = []
    for a, z in zip(w.rows[:-1].tolist(), w.rows[1:].tolist(), strict=True):
        if z - a >= width:
            out.append(np.unique(grams[a : z - width + 1]))
        elif z > a:
            out.append(_text.gram_hashes(h[a:z], width)[:1])
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def minima(sets: np.ndarray) -> np.ndarray:
    """The smallest 32-bit hash of a set under each function."""
    out = np.empty(HASHES, np.uint32)
    for i in range(0, HASHES, 16):
        out[i : i + 16] = ((sets * _SEEDS[i : i + 16, None]) >> np.uint64(32)).min(axis=1)
    return out


def packed(sign: np.ndarray) -> bytes:
    """The minima that trees begin with in full, of the others the low byte."""
    return sign[:TREES].astype("<u4").tobytes() + sign[TREES:].astype(np.uint8).tobytes()


def _signed(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """id, n_shingles, fp_a, fp_b, sign for every row with an id."""

    @tidy
    def run(batches):
        for b in batches:
            rows = []
            for c in _text.chunks(b.column(1)):
                for s in shingles(c.data, c.bounds, width):
                    if len(s):
                        fp = _text.mix(s + np.uint64(0x51ED270B7F4A7C15))
                        rows.append((len(s), int(fp.sum(dtype=np.uint64).astype(np.int64)), int(np.bitwise_xor.reduce(_text.mix(s)).astype(np.int64)), packed(minima(s))))
                    else:
                        rows.append((0, 0, 0, b""))
            n, fp_a, fp_b, sign = zip(*rows, strict=True) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int64()), pa.array(fp_a, pa.int64()), pa.array(fp_b, pa.int64()), pa.array(sign, pa.binary())],
                ["id", "n_shingles", "fp_a", "fp_b", "sign"],
            )

    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"id {kind}, n_shingles bigint, fp_a bigint, fp_b bigint, sign binary")


def _groups(batches, n_key: int):
    """Runs of rows of equal key, from batches sorted by it: the key, and the rows as one table."""
    parts, last = [], None
    for b in batches:
        if not b.num_rows:
            continue
        t = pa.Table.from_batches([b])
        keys = [np.asarray(t.column(i)) for i in range(n_key)]
        fresh = np.zeros(t.num_rows, bool)
        fresh[0] = last is None or any(k[0] != x for k, x in zip(keys, last, strict=True))
        for k in keys:
            fresh[1:] |= k[1:] != k[:-1]
        at = np.flatnonzero(fresh)
        if not len(at):
            parts.append(t)
            continue
        if last is not None:
            yield last, pa.concat_tables([*parts, t.slice(0, at[0])]).combine_chunks()
        for a, z in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            yield [k[a] for k in keys], t.slice(a, z - a)
        parts, last = [t.slice(int(at[-1]))], [k[at[-1]] for k in keys]
    if last is not None:
        yield last, pa.concat_tables(parts).combine_chunks()


def _signs(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1 if len(column) else 4 * TREES + HASHES - TREES)
    return np.ascontiguousarray(raw[:, : 4 * TREES]).view("<u4"), raw[:, 4 * TREES :]


def _agreement(head: np.ndarray, tail: np.ndarray, other_head: np.ndarray, other_tail: np.ndarray) -> np.ndarray:
    return (head == other_head).sum(axis=1) + (tail == other_tail).sum(axis=1)


def modal(head: np.ndarray, tail: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent value of each place (ties: the smaller)."""

    def most(column):
        values, counts = np.unique(column, return_counts=True)
        return values[counts.argmax()]

    return tuple(np.array([most(m[:, i]) for i in range(m.shape[1])], m.dtype) for m in (head, tail))


def consensus(head: np.ndarray, tail: np.ndarray) -> int:
    """The node that agrees best with the most frequent value of each place."""
    return int(_agreement(head, tail, *modal(head, tail)).argmax())


@dataclass(frozen=True)
class Crowded:
    """A Bloom filter of the names of regions that are too large. What it says of a region depends on the name alone."""

    words: np.ndarray

    def holds(self, name: np.ndarray) -> np.ndarray:
        at = name & np.uint64(64 * len(self.words) - 1)
        return (self.words[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)


def first_names(head: np.ndarray) -> np.ndarray:
    """Names of the regions of a common first minimum, a column for each tree."""
    return _text.mix(head.astype(np.uint64) + (np.arange(1, TREES + 1, dtype=np.uint64) << np.uint64(40)))


def regions(head: np.ndarray, tail: np.ndarray, crowded: list[Crowded], spread: np.ndarray | None = None):
    """(tree, rows, names, open) of the regions that nodes belong to, crowded ones parted as far as crowded tells.

    Open are regions at the length of prefix that crowded does not tell about; nodes of equal minima throughout are
    dealt by `spread`.
    """
    name = first_names(head)
    value = [*head.T.astype(np.uint64), *tail.T.astype(np.uint64)]
    for tree in range(TREES):
        large = crowded[0].holds(name[:, tree]) if crowded else np.zeros(len(head), bool)
        at = np.flatnonzero(~large)
        yield tree, at, name[at, tree], not crowded
        for turn in range(TURNS) if large.any() else ():
            rows, depth = np.flatnonzero(large), 0
            path = _text.mix(name[rows, tree] ^ np.uint64(turn + 1))
            for level, to in enumerate(STEPS, 1):
                for d in range(depth, to):
                    path = _text.mix(path ^ (value[(tree + 1 + d + turn * TURN_STEP) % HASHES][rows] + np.uint64(1)))
                depth = to
                if level == len(crowded):
                    break
                more = crowded[level].holds(path)
                yield tree, rows[~more], path[~more], False
                rows, path = rows[more], path[more]
                if not len(rows):
                    break
            else:
                path = _text.mix(path + (spread[rows] if spread is not None else np.uint64(0)))
            if len(rows):
                yield tree, rows, path, level == len(crowded)


def _crowded(nodes: DataFrame) -> tuple[list[Crowded], DataFrame | None, int]:
    """Filters of the crowded regions by length of prefix; those of a common first minimum with their number of nodes; into how many
    parts those of equal minima throughout are dealt."""
    found: list[Crowded] = []
    first, deal = None, 1
    while len(found) <= len(STEPS):

        @tidy
        def names(batches, found=tuple(found)):
            for b in batches:
                n = np.asarray(b.column(0))
                got = [(rows, name) for _, rows, name, open_ in regions(*_signs(b.column(1)), list(found)) if open_]
                if got:
                    rows, name = (np.concatenate(x) for x in zip(*got, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(name.view(np.int64)), pa.array(n[rows])], ["name", "n"])

        counts = nodes.select("n_shingles", "sign").mapInArrow(names, "name bigint, n bigint").groupBy("name").agg(F.count(F.lit(1)).alias("nodes"), F.sum("n").alias("shingles"))
        large = written(counts.where((F.col("nodes") > REGION) | (F.col("nodes") > FEW) & (F.col("shingles") > SHINGLES)), "crowded")
        n, most, widest = large.agg(F.count(F.lit(1)), F.max("nodes"), F.max("shingles")).first()
        if not n:
            break
        bits = min(MOST_BITS, max(LEAST_BITS, 1 << (64 * n).bit_length()))
        spot = F.col("name").bitwiseAND(F.lit(bits - 1))
        words = large.select(F.shiftright(spot, 6).alias("word"), F.expr("1L").alias("one"), spot.bitwiseAND(F.lit(63)).cast("int").alias("at"))
        words = words.groupBy("word").agg(F.bit_or(F.expr("shiftleft(one, at)")).alias("bits")).toArrow()  # at most MOST_BITS / 64 rows
        table = np.zeros(bits // 64, np.uint64)
        table[np.asarray(words.column(0))] = np.asarray(words.column(1)).view(np.uint64)
        found.append(Crowded(table))
        first, deal = large if first is None else first, max(-(-most // REGION), -(-widest // SHINGLES))
    return found, first, deal


def likely(tree: int, n: np.ndarray, head: np.ndarray, tail: np.ndarray, parted: np.ndarray, star: np.ndarray) -> np.ndarray:
    """The nodes of a region or part that have a partner there that may be a link and that no earlier tree surely compares.

    Bit t of parted: tree t parts the node's region, so that a common minimum there does not say that it compares a pair.
    Nodes of one star (not 0) are linked with each other already.
    """
    num, den = THRESHOLD
    whole = (parted[:, None] >> np.arange(TREES)) & 1 == 0
    found = np.zeros(len(n), bool)
    for one in range(len(n) - 1):
        others = np.arange(one + 1, len(n))
        ok = np.minimum(n[others], n[one]) * den >= np.maximum(n[others], n[one]) * num
        if star[one]:
            ok &= star[others] != star[one]
        others = others[ok]
        if not len(others):
            continue
        h = head[others] == head[one]
        same = h.sum(axis=1) + (tail[others] == tail[one]).sum(axis=1)
        others = others[(same >= LEAST_AGREE) & ~(h & whole[one])[:, :tree].any(axis=1)]
        found[others] = True
        found[one] |= len(others) > 0
    return np.flatnonzero(found)


def _active(nodes: DataFrame, crowded: list[Crowded], deal: int) -> DataFrame:
    """part, id: the regions or parts of regions in which each node has a likely partner. nodes: id, n_shingles, sign, fp_a, star."""
    shared = nodes.sparkSession.sparkContext.broadcast(crowded)  # at most MOST_BITS for each length of prefix

    @tidy
    def spread(batches):
        crowded = shared.value
        for b in batches:
            if not b.num_rows:
                continue
            head, tail = _signs(b.column(2))
            parted = np.zeros(b.num_rows, np.int16)
            if crowded:
                parted = (crowded[0].holds(first_names(head)).astype(np.int16) << np.arange(TREES, dtype=np.int16)).sum(axis=1).astype(np.int16)
            dealt = np.asarray(b.column(3)).view(np.uint64) % np.uint64(deal)
            for tree, rows, name, _ in regions(head, tail, crowded, dealt):
                take = pa.array(rows)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(name.view(np.int64)), pa.array(np.full(len(rows), tree, np.int32)), *(b.column(i).take(take) for i in (0, 1, 2)), pa.array(parted[rows]), b.column(4).take(take)],
                    ["part", "tree", "id", "n", "sign", "parted", "star"],
                )

    @tidy
    def run(batches):
        out, size = [], 0
        for _, t in _groups(batches, 1):
            if t.num_rows < 2:
                continue
            at = likely(t.column(1)[0].as_py(), np.asarray(t.column(3)), *_signs(t.column(4)), np.asarray(t.column(5)), np.asarray(t.column(6)))
            if len(at):
                out.append(t.select(["part", "id"]).take(pa.array(at)))
                size += len(at)
            if size > 20_000:
                yield from pa.concat_tables(out).combine_chunks().to_batches()
                out, size = [], 0
        if out:
            yield from pa.concat_tables(out).combine_chunks().to_batches()

    kind = nodes.schema["id"].dataType.simpleString()
    rows = nodes.select("id", "n_shingles", "sign", "fp_a", "star").mapInArrow(spread, f"part bigint, tree int, id {kind}, n bigint, sign binary, parted smallint, star bigint")
    return rows.repartition("part").sortWithinPartitions("part").mapInArrow(run, f"part bigint, id {kind}")


def _stars(nodes: DataFrame, crowded: list[Crowded], first: DataFrame) -> DataFrame:
    """middle, id: nodes of large regions and the node nearest to the region's consensus, where their signatures allow a link.

    A region's middle is found by partial aggregates; rows meet their region's one row through a join that splits hot keys.
    """
    shared = nodes.sparkSession.sparkContext.broadcast(crowded[0])
    kind = nodes.schema["id"].dataType.simpleString()
    num, den = THRESHOLD

    @tidy
    def spread(batches):
        for b in batches:
            name = first_names(_signs(b.column(2))[0])
            row, tree = np.nonzero(shared.value.holds(name))
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays([pa.array(name[row, tree].view(np.int64)), *(b.column(i).take(take) for i in range(3))], ["name", "id", "n", "sign"])

    @tidy
    def vote(batches):
        for b in batches:
            got = []
            for signs in b.column(1):
                head, tail = modal(*_signs(signs.values))
                got.append(head.astype("<u4").tobytes() + tail.tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got, pa.binary())], ["name", "modal"])

    @tidy
    def agree(batches):
        for b in batches:
            same = _agreement(*_signs(b.column(3)), *_signs(b.column(4))) if b.num_rows else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(same)], ["name", "id", "n", "sign", "same"])

    @tidy
    def near(batches):
        for b in batches:
            if not b.num_rows:
                continue
            n, m = np.asarray(b.column(1)), np.asarray(b.column(4))
            ok = (_agreement(*_signs(b.column(2)), *_signs(b.column(5))) >= LEAST_AGREE) & (np.minimum(n, m) * den >= np.maximum(n, m) * num)
            yield pa.RecordBatch.from_arrays([b.column(3).filter(pa.array(ok)), b.column(0).filter(pa.array(ok))], ["middle", "id"])

    hot = nodes.select("id", "n_shingles", "sign").mapInArrow(spread, f"name bigint, id {kind}, n bigint, sign binary").join(first.select("name", "nodes"), "name")
    draw = F.xxhash64("id").bitwiseAND(F.lit((1 << 30) - 1)).cast("double")
    voters = hot.where(draw * F.col("nodes") < VOTERS * float(1 << 30)).groupBy("name").agg(F.collect_list("sign").alias("signs"))
    voted = written(voters.mapInArrow(vote, "name bigint, modal binary"), "modal")
    best = hot.join(voted, "name").select("name", "id", "n", "sign", "modal").mapInArrow(agree, f"name bigint, id {kind}, n bigint, sign binary, same bigint")
    best = best.groupBy("name").agg(F.max_by(F.struct("id", "n", "sign"), F.struct("same", "id")).alias("m"))
    middles = written(best.select("name", F.col("m.id").alias("middle"), F.col("m.n").alias("m"), F.col("m.sign").alias("m_sign")), "middles")
    pairs = hot.join(middles, "name").select("id", "n", "sign", "middle", "m", "m_sign").mapInArrow(near, f"middle {kind}, id {kind}")
    return pairs.where(F.col("middle") != F.col("id")).distinct()


def _sets_of(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """The columns of wanted (id, ...) and the full set of each id, as often as the id stands in wanted and in docs. Most texts are not wanted and stay where they are."""
    texts = marked(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "id", wanted.select("id").distinct(), "id")
    per = wanted.groupBy("id").agg(F.collect_list(F.struct(*(c for c in wanted.columns if c != "id"))).alias("for"))
    held = texts.where("__maybe").drop("__maybe").join(per, "id")
    kind = held.schema["for"].dataType.elementType
    names = [f.name for f in kind.fields]

    @tidy
    def run(batches):
        for b in batches:
            out, size = [], 0

            def sent(out=out, b=b):
                row, which, sets = zip(*out, strict=True)
                listed = b.column(2).take(pa.array(row))
                flat, at = listed.flatten(), np.concatenate([[0], np.cumsum(np.asarray(listed.value_lengths()))])[:-1] + np.array(which)
                return pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)), *(flat.field(n).take(pa.array(at)) for n in names), pa.array(sets, pa.binary())], ["id", *names, "set"])

            times = np.asarray(b.column(2).value_lengths()).tolist()
            for c in _text.chunks(b.column(1)):
                for i, one in enumerate(shingles(c.data, c.bounds, width)):
                    raw = one.tobytes()
                    for k in range(times[c.first + i]):
                        out.append((c.first + i, k, raw))
                        size += len(raw)
                        if size > SENT_BYTES:
                            yield sent()
                            out.clear()
                            size = 0
            if out:
                yield sent()

    schema = ", ".join([f"id {docs.schema[id_col].dataType.simpleString()}", *(f"{f.name} {f.dataType.simpleString()}" for f in kind.fields), "set binary"])
    return held.select("id", "text", "for").mapInArrow(run, schema)


def _is_link(x: np.ndarray, y: np.ndarray) -> bool:
    num, den = THRESHOLD
    x, y = (x, y) if len(x) <= len(y) else (y, x)
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    both = int((y[at] == x).sum())
    return both * den >= (len(x) + len(y) - both) * num


def _star_links(docs: DataFrame, pairs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """a, b: confirmed links between middles and nodes. A middle's nodes are dealt to tasks of about REGION, each of which gets the middle's set first."""
    kind = pairs.schema["id"].dataType.simpleString()
    sizes = pairs.groupBy("middle").agg(F.ceil(F.count(F.lit(1)) / REGION).alias("deals"))
    nodes = pairs.join(sizes, "middle").select("id", "middle", F.pmod(F.xxhash64("id"), F.col("deals")).alias("deal"), F.lit(1).alias("role"))
    middles = sizes.select(F.col("middle").alias("id"), "middle", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("deals") - 1)).alias("deal"), F.lit(0).alias("role"))

    @tidy
    def run(batches):
        own, middle = None, None
        for b in batches:
            a, z = [], []
            for i, m, deal, role, raw in zip(*(b.column(k).to_pylist() for k in range(5)), strict=True):
                one = np.frombuffer(raw, np.uint64)
                if role == 0:
                    own, middle = (m, deal), one
                elif own == (m, deal) and _is_link(middle, one):
                    a.append(m)
                    z.append(i)
            yield pa.RecordBatch.from_arrays([pa.array(a, b.column(0).type), pa.array(z, b.column(0).type)], ["a", "b"])

    rows = _sets_of(docs, nodes.unionByName(middles), id_col, text_col, width).select("id", "middle", "deal", "role", "set")
    return rows.repartition("middle", "deal").sortWithinPartitions("middle", "deal", "role").mapInArrow(run, f"a {kind}, b {kind}")


def confirmed(sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links that connect all of these nodes that their links connect, each confirmed on the full sets."""
    num, den = THRESHOLD
    sign = np.stack([minima(s) for s in sets])
    head, tail = sign[:, :TREES], sign[:, TREES:].astype(np.uint8)
    n = np.array([len(s) for s in sets])
    root = list(range(len(sets)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    links = []

    def test(a: int, b: int) -> None:
        ra, rb = find(a), find(b)
        if ra != rb and _is_link(sets[a], sets[b]):
            root[rb] = ra
            links.append((a, b))

    middle = consensus(head, tail)
    if len(sets) > 2:  # the likely original first: it connects most copies at once
        for b in range(len(sets)):
            if b != middle and min(n[b], n[middle]) * den >= max(n[b], n[middle]) * num:
                test(middle, b)
    for one in range(len(sets) - 1):
        others = np.arange(one + 1, len(sets))
        others = others[np.minimum(n[others], n[one]) * den >= np.maximum(n[others], n[one]) * num]
        same = (head[others] == head[one]).sum(axis=1) + (tail[others] == tail[one]).sum(axis=1)
        good = same >= LEAST_AGREE
        others, same = others[good], same[good]
        for j in np.argsort(-same, kind="stable").tolist():
            test(one, int(others[j]))
    return links


def _links(docs: DataFrame, active: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """a, b: confirmed links. A node's text is fetched once, its set goes to each of its parts: one a region, TURNS if that is parted."""
    kind = docs.schema[id_col].dataType.simpleString()

    @tidy
    def run(batches):
        for _, t in _groups(batches, 1):
            ids, raw = t.column(1).combine_chunks(), t.column(2).to_pylist()
            first = list({(i, x): n for n, (i, x) in reversed(list(enumerate(zip(ids.to_pylist(), raw, strict=True))))}.values())  # of repeated rows
            if len(first) < 2:
                continue
            ids, sets = ids.take(pa.array(first)), [np.frombuffer(raw[n], np.uint64) for n in first]
            found = confirmed(sets)
            if found:
                a, b = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(a)), ids.take(pa.array(b))], ["a", "b"])

    rows = _sets_of(docs, active, id_col, text_col, width).select("part", "id", "set")
    return rows.repartition("part").sortWithinPartitions("part").mapInArrow(run, f"a {kind}, b {kind}")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """Per row: id, n_shingles, component_id (the smallest id it reaches), kept (whether that is its own)."""
    signed = written(_signed(docs, id_col, text_col, width), "signed")
    whole = (F.col("n_shingles") > 0) & F.col("id").isNotNull()
    same_set = ["n_shingles", "fp_a", "fp_b"]
    nodes = written(signed.where(whole).groupBy(*same_set).agg(F.min("id").alias("id"), F.first("sign").alias("sign")), "nodes")
    crowded, first, deal = _crowded(nodes)
    links, starred = None, nodes.withColumn("star", F.lit(0).cast("bigint"))
    if first is not None:
        links = written(_star_links(docs, written(_stars(nodes, crowded, first), "stars"), id_col, text_col, width), "star-links")
        stars = links.select(F.col("b").alias("id"), F.col("a").alias("star")).unionByName(links.select(F.col("a").alias("id"), F.col("a").alias("star")))
        stars = stars.groupBy("id").agg(F.xxhash64(F.min("star")).alias("star"))
        starred = nodes.join(stars, "id", "left").withColumn("star", F.coalesce("star", F.lit(0).cast("bigint")))
    active = written(_active(starred, crowded, deal), "active")
    found = written(_links(docs, active, id_col, text_col, width), "links")
    groups = components(found if links is None else found.unionByName(links))
    labelled = nodes.join(groups, "id", "left").select(*same_set, F.coalesce("component_id", "id").alias("component_id"))
    # A set has one row here; its documents, however many, meet it in narrow rows, of which a hot set's are split by the skew join.
    # Documents without a set are linked with nothing and meet nothing.
    named = signed.where(whole).join(labelled, same_set, "left").select("id", "n_shingles", "component_id")
    alone = signed.where(~whole).select("id", "n_shingles", F.col("id").alias("component_id"))
    kept = F.coalesce(F.col("id") == F.col("component_id"), F.lit(True))
    return named.unionByName(alone).select(F.col("id").alias(id_col), "n_shingles", "component_id", kept.alias("kept"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """Rows of docs, all columns: one document of each group, that with the smallest id, and all without words or id."""
    found = near_duplicates(docs, id_col, text_col, width)
    gone = written(found.where(~F.col("kept")).select(F.col(id_col).alias("__gone")).distinct(), "gone")
    rows = marked(docs, id_col, gone, "__gone")
    maybe = rows.where("__maybe").drop("__maybe")
    return rows.where("NOT __maybe").drop("__maybe").unionByName(maybe.join(gone, maybe[id_col] == gone["__gone"], "left_anti"))
