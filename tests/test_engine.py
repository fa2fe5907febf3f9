"""Engine: golden values, boundaries, and search against plain Python."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from vicinal.config import NamespaceConfig
from vicinal.errors import CacheError, ConfigError, IndexCreationError, NormalizerError, SearchError, ShapeError
from vicinal.functions.comparators import compensated_sum, dense_l2, dense_ruzicka
from vicinal.functions.metadata import matches, matching_if_under, normal_metadata
from vicinal.functions.normalizers import normalizer
from vicinal.functions.records import postings, shape, with_uni
from vicinal.operators import hybrid, inverted, popularity, scan, signatures
from vicinal.plans.engine import SimilarityIndex, batch_search, post_filter_pool, resolved_strategy, validated, wanted_values
from vicinal.sources.mutations import SCHEMA, visible
from vicinal.sources.segments import SegmentStore
from vicinal.streaming.ingest import apply_batch, ingest

RECORDS = "row_num bigint, terms array<string>, values array<float>, metadata map<string,string>"
GOLDEN = [
    (0, "abc", [0.1, 0.1, 0.001], "San Diego", "USA"), (1, "bcd", [0.001, 0.5, 0.7], "Santa Barbara", "USA"), (2, "cde", [0.001, 0.5, 0.6], "Mumbai", "India"),
    (3, "def", [0.001, 0.6, 0.7], "Alexandria", "Egypt"), (4, "efg", [0.6, 0.001, 0.7], "Alexandria", "USA"),
]


@pytest.fixture(scope="module")
def golden(spark):
    return spark.createDataFrame([(i, list(t), v, {"City": c, "country": n}) for i, t, v, c, n in GOLDEN], RECORDS)


@pytest.fixture(scope="module")
def golden_query(spark):
    return spark.createDataFrame([(7, ["b", "d", "f"], [0.11, 0.11, 0.001])], "qid bigint, terms array<string>, values array<float>")


@pytest.mark.parametrize(
    "fraction, expected",
    [
        (1.0, [(0, 0.8703195), (2, 0.58004034), (1, 0.5614781), (3, 0.5170307), (4, 0.51679945)]),
        (0.5, [(0, 0.9086748), (1, 0.9017095), (3, 0.58561647), (4, 0.58527786)]),
    ],
)
def test_golden_sparse_l2(golden, golden_query, fraction, expected):
    config = NamespaceConfig(index="inverted", cache="sparse", max_num_similarities=10, params={"max_fraction_ids_per_sparse_key": fraction})
    got = [(r.row_num, r.similarity) for r in batch_search(golden, golden_query, config, 5).orderBy("rank").collect()]
    assert [g[0] for g in got] == [e[0] for e in expected]
    assert all(abs(g[1] - e[1]) < 1e-6 for g, e in zip(got, expected, strict=True))


@pytest.mark.parametrize(
    "wanted, rows",
    [(None, {0, 1, 2, 3, 4}), ({"country": ["usa"]}, {0, 1, 4}), ({"CITY": [" santa barbara "]}, {1}), ({"country": ["India"], "city": ["Mumbai"]}, {2}), ({"city": ["Alexandria"]}, {3, 4}), ({"city": []}, set())],
)
def test_golden_filters(golden, golden_query, wanted, rows):
    config = NamespaceConfig(index="inverted", max_num_similarities=10)
    assert {r.row_num for r in batch_search(golden, golden_query, config, 5, 0.0, wanted).collect()} == rows


def test_dense_golden_and_ties(spark):
    rows = spark.createDataFrame([(10, [1.0, 0.0]), (11, [0.0, 1.0]), (12, [1.0, 1.0]), (30, [1.0, 0.0])], "row_num bigint, values array<float>")
    q = spark.createDataFrame([(0, [1.0, 0.0])], "qid bigint, values array<float>")
    got = scan.dense_search(rows, q, k=4).orderBy("rank").collect()
    assert [(r.row_num, r.rank) for r in got] == [(10, 1), (30, 2), (12, 3), (11, 4)]
    assert abs(got[3].similarity - 1 / (1 + math.sqrt(2))) < 1e-6
    assert [r.row_num for r in scan.dense_search(rows, q, k=9, min_similarity=0.5).orderBy("rank").collect()] == [10, 30, 12]
    assert scan.dense_search(rows.limit(0), q, k=3).count() == 0
    assert scan.dense_search(rows, q.limit(0), k=3).count() == 0


@pytest.mark.parametrize("name", ["l2", "jaccard", "ruzicka"])
def test_dense_scan_in_sets_and_parts(spark, name, monkeypatch):
    for what, size in (("QUERY_SET", 8), ("ROWS", 16), ("PART_VALUES", 200)):
        monkeypatch.setattr(scan, what, size)
    rng = random.Random(4)
    vectors = [(i, [float(rng.randrange(-2, 3)) for _ in range(5)]) for i in range(300)]
    asked = vectors[:30]
    df = spark.createDataFrame(vectors, "row_num long, values array<float>").repartition(3)
    got = scan.dense_search(df, df.where("row_num < 30").withColumnRenamed("row_num", "qid"), name, "reciprocal" if name == "l2" else "identity", 7).collect()

    def plain(a, b):
        if name == "l2":
            return 1 / (1 + sum((x - y) ** 2 for x, y in zip(a, b, strict=True)) ** 0.5)
        size = (lambda x: float(x != 0)) if name == "jaccard" else abs
        both = sum(min(size(x), size(y)) for x, y in zip(a, b, strict=True) if x * y > 0)
        union = sum(map(size, a)) + sum(map(size, b)) - both
        return both / union if union else 1.0

    want = [(i, n, j) for i, a in asked for n, (s, j) in enumerate(sorted((-round(plain(a, b), 6), j) for j, b in vectors)[:7], 1)]
    assert sorted((r.qid, r["rank"], r.row_num) for r in got) == sorted(want)


def test_dimension_mismatch_is_told(spark):
    rows = spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "row_num bigint, values array<float>")
    q = spark.createDataFrame([(0, [1.0])], "qid bigint, values array<float>")
    with pytest.raises(PySparkException):
        scan.dense_search(rows, q).collect()


def test_comparators_and_normalizers(spark):
    row = spark.createDataFrame([([3.0, 0.0], [0.0, -4.0], [2.0, 3.0], [1.0, 5.0])], "a array<float>, b array<float>, c array<float>, d array<float>")
    got = row.select(dense_l2(F.col("a"), F.col("b")), dense_ruzicka(F.col("c"), F.col("d"))).first()
    assert abs(got[0] - 5) < 1e-9 and abs(got[1] - 4 / 7) < 1e-9
    lp = normalizer(" LP ")
    assert lp.to_value(0.75) == 0.5 and normalizer("reciprocal").to_value(0) == float("inf")
    with pytest.raises(PySparkException):
        row.select(lp.to_similarity(F.lit(2.5))).collect()
    with pytest.raises(NormalizerError):
        normalizer("cosine")


def test_canonical_form(spark):
    rows = spark.createDataFrame(
        [(1, [" A", "a", "b"], [1.0, 2.0, 0.0]), (2, ["x", "y"], [0.0, 0.0]), (3, [], [1.0]), (4, ["z", "z"], [1.0, -1.0]), (5, None, None)],
        "row_num bigint, terms array<string>, values array<float>",
    )
    assert sorted(map(tuple, postings(rows).collect())) == [(1, "a", 3.0), (2, "x", 0.0), (2, "y", 0.0), (4, "z", 0.0)]
    assert [r[0] for r in rows.orderBy("row_num").select(shape(F.col("terms"), F.col("values"))).collect()] == ["sparse", "sparse", "dense", "sparse", "empty"]
    bad = spark.createDataFrame([(1, ["a"], [1.0, 2.0])], rows.schema)
    with pytest.raises(PySparkException):
        postings(bad).collect()


def _random_records(rng, n):
    return [(i, {str(t): 0.25 * rng.randint(1, 8) * rng.choice((1, -1)) for t in rng.sample(range(24), rng.randint(1, 6))}) for i in range(n)]


def _plain(name, a, b):
    if name == "l2":
        return 1 / (1 + math.sqrt(sum((a.get(t, 0) - b.get(t, 0)) ** 2 for t in a.keys() | b.keys())))
    w = abs if name == "ruzicka" else lambda x: float(x != 0)
    inter = sum(min(w(a[t]), w(b[t])) for t in a.keys() & b.keys() if a[t] * b[t] > 0)
    union = sum(map(w, a.values())) + sum(map(w, b.values())) - inter
    return 1.0 if union == 0 else inter / union


@pytest.mark.parametrize("name, norm", [("jaccard", "identity"), ("ruzicka", "identity"), ("l2", "reciprocal")])
def test_posting_join_equals_scan(spark, name, norm):
    rng = random.Random(8128)
    rows, queries = _random_records(rng, 60), _random_records(rng, 15)

    def table(xs, id_col):
        return spark.createDataFrame([(i, t, v) for i, m in xs for t, v in m.items()], f"{id_col} bigint, term string, value float")

    for t in (0.0, 0.2, 0.5):
        for use_prefix in (True, False):
            got = {(r.qid, r.row_num): r.similarity for r in inverted.search(table(queries, "qid"), table(rows, "row_num"), name, norm, 100, t, use_prefix=use_prefix).collect()}
            full = {(i, j): _plain(name, a, b) for i, a in queries for j, b in rows if a.keys() & b.keys()}
            sure = {p for p, s in full.items() if s > t + 1e-6}
            assert sure <= got.keys() <= {p for p, s in full.items() if s >= t - 1e-6}
            assert all(abs(got[p] - full[p]) < 1e-6 for p in got)


def test_length_window(spark):
    rows = spark.createDataFrame([(n, str(i), 1.0) for n in range(1, 81) for i in range(n)], "row_num bigint, term string, value float")
    q = rows.where("row_num = 40").withColumnRenamed("row_num", "qid")
    got = {r.row_num for r in inverted.search(q, rows, "jaccard", "identity", 100, 0.8).collect()}
    assert got == set(range(33, 50))  # the float 0.8 is above 0.8


def test_popularity(spark):
    assert popularity.z_value(0.5) == 0 and popularity.z_value(1.0) == 1e12
    n = spark.range(1).select(
        popularity.lower_bound(F.lit(90), 100, 0.95), popularity.upper_bound(F.lit(90), 100, 0.95), popularity.lower_bound(F.lit(20), 40, 0.95), popularity.upper_bound(F.lit(20), 40, 0.95)
    ).first()
    assert all(abs(a - b) < 1e-9 for a, b in zip(n, (0.8506543911914559, 0.9493456088085441, 0.3699629030311107, 0.6300370969688893), strict=True))
    rows = spark.createDataFrame([(1, "1", 1.0), (1, "2", 1.0), (2, "1", 1.0), (2, "3", 1.0), (3, "1", 1.0), (3, "4", 1.0), (4, "5", 1.0)], "row_num bigint, term string, value float")
    q = spark.createDataFrame([(0, "1", 1.0)], "qid bigint, term string, value float")
    assert inverted.search(q, rows, fraction=0.5).count() == 0


@pytest.mark.parametrize("kind", ["minhash", "icws", "i2cws", "scws", "pcws"])
def test_signature_collisions(spark, kind):
    def one(terms):
        return spark.createDataFrame([(0, t, v) for t, v in terms.items()], "row_num bigint, term string, value float")

    a, b = one({"1": -10.0, "2": 20.0, "3": 30.0}), one({"1": 10.0, "2": 20.0, "4": 30.0})
    make = (lambda x: signatures.minhash(x, 1000)) if kind == "minhash" else (lambda x: signatures.weighted(x, kind, 1000))
    assert abs(signatures.collision_rate(make(a), make(b)).first()[0] / 1000 - 0.2) < 0.1
    assert sorted(map(tuple, make(a).collect())) == sorted(map(tuple, make(a).collect()))


def test_hybrid_boundary(spark):
    rows = spark.createDataFrame([(r, f"term-{i}", 1.0) for r, n in ((0, 270), (1, 271)) for i in range(n)], "row_num bigint, term string, value float")
    q = rows.where("row_num = 1").withColumnRenamed("row_num", "qid")
    got = hybrid.search(q, rows, k=2).orderBy("rank").collect()
    assert [(r.row_num, round(r.similarity, 6)) for r in got] == [(1, 1.0), (0, round(270 / 271, 6))]
    assert [r.row_num for r in hybrid.search(q, rows, k=2, min_similarity=1.0).collect()] == [1]
    assert hybrid.lengths_overlap(271, 0.5, 0, 270) and not hybrid.lengths_overlap(100, 0.9, 271, 10**6)
    assert with_uni(q, "jaccard", "qid").first()["uni"] == 271


def test_strategies(spark, golden, golden_query):
    assert resolved_strategy(NamespaceConfig(), True) == "in_filtering"
    assert resolved_strategy(NamespaceConfig(index="dense"), False) == "post_filtering"
    assert resolved_strategy(NamespaceConfig(index="inverted"), True) == "pre_filtering"
    assert post_filter_pool(2, 100, 10, 50) == 20 and post_filter_pool(2, 100, 0, 50) == 0
    config = NamespaceConfig(index="inverted", max_num_similarities=2, params={"metadata_filtering_strategy": "post_filtering"})
    assert batch_search(golden, golden_query, config, 1, 0.0, {"city": ["alexandria"]}).count() == 0  # the pool of two holds neither
    assert wanted_values({" City ": ["A", " b"]}, ["city"]) == [["a", "b"]]
    with pytest.raises(SearchError):
        batch_search(golden, golden_query, config, 0)


def test_metadata(spark):
    rows = spark.sql("SELECT 1L AS row_num, map('K', 'V ', 'k', 'w', 'x', CAST(NULL AS STRING)) AS metadata UNION ALL SELECT 2L, map() UNION ALL SELECT 3L, NULL")
    meta = rows.select("row_num", normal_metadata("metadata").alias("metadata"))
    assert [r.metadata for r in meta.orderBy("row_num").collect()] == [{"k": "w"}, {}, None]
    assert [r.row_num for r in meta.where(matches(F.col("metadata"), {"k": ["W"]})).collect()] == [1]
    assert matching_if_under(meta, {"k": ["w"]}, 0) is None and matching_if_under(meta, {"k": ["w"]}, 1).count() == 1


def test_config_tells_all_violations():
    with pytest.raises(ConfigError) as e:
        NamespaceConfig(comparator="cosine", max_cache_size=0, max_num_searchable_structures=2, min_num_terms=3, max_num_terms=1, params={"max_fraction_ids_per_sparse_key": 0})
    assert str(e.value).count(";") == 4
    assert NamespaceConfig(comparator=" L2 ").comparator == "l2"


def test_lifecycle(spark, tmp_path):
    config = NamespaceConfig(max_cache_size=2, max_num_searchable_structures=3)
    index = SimilarityIndex(spark, config, f"file://{tmp_path}/index")
    assert [index.insert(v, metadata={"city": c}) for v, c in (([1.0, 0.0], "sf"), ([0.0, 1.0], "la"))] == [0, 1]
    assert index.update(1, [1.0, 0.0], metadata={"city": "sf"}) and not index.update(9, [1.0, 0.0])
    assert [r.row_num for r in index.nearest(5, [1.0, 0.0], wanted={"city": ["SF"]}).collect()] == [0, 1]
    assert index.delete(0) and not index.delete(0)
    assert [r.row_num for r in index.similar(0.5, [1.0, 0.0]).collect()] == [1]
    for i in range(5):
        index.insert([0.0, float(i)])
    assert index.size() == 6 and index.num_structures() <= 3
    index.rotate()
    assert [r.row_num for r in index.row_nums().collect()] == [1, 2, 3, 4, 5, 6]
    again = SimilarityIndex(spark, config, f"file://{tmp_path}/index")
    assert again.insert([1.0, 1.0]) == 7 and again.size() == 7


def test_log_and_streaming_agree(spark, tmp_path):
    rows = [(1, "I", 5), (2, "U", 5), (3, "U", 6), (4, "I", 6), (5, "D", 5), (6, "U", 5), (7, "I", 7), (8, "D", 8)]
    log = spark.createDataFrame([(s, o, r, [], [float(s)], {}) for s, o, r in rows], SCHEMA)
    expected = {(6, 4.0), (7, 7.0)}
    assert {(r.row_num, r["values"][0]) for r in visible(log).collect()} == expected
    config = NamespaceConfig()
    store = SegmentStore(spark, f"file://{tmp_path}/store")
    for part in (log.where("seq <= 3"), log.where("seq > 3")):
        apply_batch(store, config, part)
    assert {(r.row_num, r["values"][0]) for r in store.visible().collect()} == expected
    log.write.parquet(f"{tmp_path}/log")
    streamed = SegmentStore(spark, f"file://{tmp_path}/streamed")
    ingest(spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/log"), streamed, config, f"{tmp_path}/checkpoint").awaitTermination()
    assert {(r.row_num, r["values"][0]) for r in streamed.visible().collect()} == expected


def _records(spark, rows):
    return spark.createDataFrame([(i, list(m), [float(v) for v in m.values()], {}) for i, m in rows], RECORDS)


@pytest.mark.parametrize("name, norm", [("jaccard", "identity"), ("ruzicka", "lp"), ("l2", "reciprocal")])
def test_generic_scan_of_sparse_records(spark, name, norm, monkeypatch):
    for what, size in (("PAIRS", 50), ("QUERY_SET", 3), ("ROWS", 8), ("PART_VALUES", 40)):
        monkeypatch.setattr(scan, what, size)
    rng = random.Random(99)
    rows, queries = [*_random_records(rng, 40), (900, {"only": 1.0}), (901, {"a": 0.0})], [*_random_records(rng, 6), (77, {"x": 1.0, "y": 2.0}), (78, {"b": 0.0})]
    config = NamespaceConfig(comparator=name, normalizer=norm)
    got = {}
    for r in batch_search(_records(spark, rows), _records(spark, queries).withColumnRenamed("row_num", "qid"), config, 7).collect():
        got.setdefault(r.qid, []).append((r["rank"], r.row_num, r.similarity))
    for i, a in queries:
        plain = sorted(((-(1 - s / 2 if norm == "lp" else s), j) for j, b in rows for s in [_plain(name, a, b)]))[:7]
        mine = sorted(got[i])
        assert all(abs(-p[0] - m[2]) < 1e-6 for p, m in zip(plain, mine, strict=True))
        assert [m[0] for m in mine] == list(range(1, 8))
    best = batch_search(_records(spark, [(1, {"a": 1, "b": 1}), (2, {"x": 1})]), _records(spark, [(0, {"a": 1, "b": 1, "c": 1})]).withColumnRenamed("row_num", "qid"), NamespaceConfig(comparator="jaccard", normalizer="identity"), 5)
    assert [(r.row_num, round(r.similarity, 5)) for r in best.orderBy("rank").collect()] == [(1, 0.66667), (2, 0.0)]


def test_mixed_shapes_are_told(spark):
    dense = spark.createDataFrame([(1, [], [1.0, 2.0], {})], RECORDS)
    sparse = _records(spark, [(2, {"a": 1})])
    for rows, queries in ((dense, sparse), (sparse, dense)):
        with pytest.raises(PySparkException):
            batch_search(rows, queries.withColumnRenamed("row_num", "qid"), NamespaceConfig(), 3).collect()
    assert batch_search(dense.unionByName(spark.createDataFrame([(3, ["t"], [], {})], RECORDS)), dense.withColumnRenamed("row_num", "qid"), NamespaceConfig(), 3).count() == 1


def test_indexes_take_only_records_that_fit(spark):
    dense, sparse = spark.createDataFrame([(1, [], [1.0, 2.0], {}), (2, [], [1.0], {})], RECORDS), _records(spark, [(3, {"a": float("nan")})])
    for rows, index, told in ((dense, "dense", "dimension"), (dense, "inverted", "not dense"), (sparse, "inverted", "finite"), (sparse, "dense", "not sparse")):
        with pytest.raises(IndexCreationError, match=told):
            validated(rows, NamespaceConfig(index=index))
    assert validated(dense, NamespaceConfig()) is dense


def test_normalizer_of_signature_and_hybrid_search(spark):
    rows = _records(spark, [(1, {"a": 1, "b": 1}), (2, {"a": 1, "b": 1, "c": 1})])
    q = _records(spark, [(0, {"a": 1, "b": 1, "c": 1})]).withColumnRenamed("row_num", "qid")
    for index in ("inverted", "signature", "sparse"):
        config = NamespaceConfig(comparator="jaccard", normalizer="lp", index=index, params={"signature_generator_type": "minhash"})
        assert [(r.row_num, round(r.similarity, 4)) for r in batch_search(rows, q, config, 5).orderBy("rank").collect()] == [(1, 0.6667), (2, 0.5)]


def test_routing_by_the_number_of_terms(spark):
    q = spark.createDataFrame([(i, str(t), 1.0) for i, n in ((1, 100), (2, 250), (3, 300)) for t in range(n)], "qid bigint, term string, value float")
    left = lambda *a: {r.qid for r in hybrid.routed(q, "jaccard", *a).select("qid").distinct().collect()}
    assert left(0.9, 0, 270) == {1, 2, 3} and left(0.95, 0, 270) == {1, 2} and left(0.9, 271, hybrid.MOST_TERMS) == {2, 3} and left(1.5, 0, 270) == set()


def test_batches_that_fail_anywhere_can_be_applied_again(spark, tmp_path, monkeypatch):
    rows = [(1, "I", 5), (2, "I", 6), (3, "U", 5), (4, "D", 6), (5, "I", 7), (6, "I", 6)]
    log = spark.createDataFrame([(s, o, r, [], [float(s)], {}) for s, o, r in rows], SCHEMA)
    expected = {(5, 3.0), (7, 5.0)}

    class Stop(Exception):
        pass

    real = {name: getattr(SegmentStore, name) for name in ("write", "publish", "compact")}
    for name in real:
        for nth in range(3):
            calls = []

            def failing(self, *a, name=name, nth=nth, calls=calls, **k):
                calls.append(1)
                if len(calls) == nth + 1:
                    raise Stop
                return real[name](self, *a, **k)

            store = SegmentStore(spark, f"file://{tmp_path}/{name}{nth}")
            with monkeypatch.context() as m:
                m.setattr(SegmentStore, name, failing)
                for number, part in enumerate((log.where("seq <= 2"), log.where("seq > 2"))):
                    for _ in range(3):
                        try:
                            apply_batch(store, NamespaceConfig(), part, number)
                            break
                        except Stop:
                            pass
            assert {(r.row_num, r["values"][0]) for r in store.visible().collect()} == expected, (name, nth)


def test_state_of_an_index(spark, tmp_path):
    index = SimilarityIndex(spark, NamespaceConfig(max_cache_size=3), f"file://{tmp_path}/state")
    index.insert_with_row_num(4, [1.0])
    with pytest.raises(CacheError):
        index.insert_with_row_num(4, [1.0])
    with pytest.raises(CacheError):
        index.insert_all(spark.createDataFrame([(4, [], [1.0], {})], RECORDS))
    with pytest.raises(ShapeError):
        index.insert([float("nan")])
    assert index.insert([2.0]) == 5 and not index.is_ready_for_graduation()
    index.close()
    with pytest.raises(CacheError):
        index.size()
    again = SimilarityIndex(spark, NamespaceConfig(max_cache_size=3), f"file://{tmp_path}/state")
    assert again.delete(4) and not again.delete(4) and again.size() == 1 and again.update(5, [9.0])
    versions = len(again.store._versions())
    again.close()
    assert len(again.store._versions()) == versions + 1  # tombstones and segment together


def test_compensated_sum(spark):
    values = [1e17, 0.1, 0.2, -1e17, 1e-9] * 5
    got = spark.createDataFrame([(values,)], "v array<double>").select(compensated_sum(F.col("v"))).first()[0]
    assert abs(got - math.fsum(values)) < 1e-9
