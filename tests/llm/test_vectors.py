import numpy as np
import pytest
from pyspark.sql import types as T

from lodestitch.llm import ann, neardup_vectors
from lodestitch.llm.common import components, min_labels

SCHEMA = T.StructType([
    T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("label", T.IntegerType()),
    T.StructField("id", T.StringType()), T.StructField("n", T.IntegerType()),
])
ODD = [
    (900, None, 1), (901, [], 1), (902, [0.0] * 8, 1), (903, [float("nan")] + [1.0] * 7, 1), (904, [float("inf")] + [1.0] * 7, 1),
    (905, [None] + [1.0] * 7, 1), (906, [1.0] * 8, None), (907, [1.0] * 3, 1), (None, [1.0] * 8, 1),
]


def vectors(spark, n=240, seed=0):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n // 6, 8))
    rows = [(i, (base[i % len(base)] + 0.12 * rng.normal(size=8) * (i % 3)).astype(np.float32).tolist(), i % 2) for i in range(n)]
    rows += [(300 + k, rows[3][1], rows[3][2]) for k in range(40)]
    return [(*r, "x", 1) for r in rows + ODD], spark.createDataFrame([(*r, "x", 1) for r in rows + ODD], SCHEMA).repartition(3)


def usable(v):
    return bool(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)


def brute(rows):
    rows = [r for r in rows if r[0] is not None]
    link = {r[0]: set() for r in rows}
    for a in rows:
        for b in rows:
            if a[0] != b[0] and a[2] is not None and a[2] == b[2] and usable(a[1]) and usable(b[1]) and len(a[1]) == len(b[1]):
                x, y = np.array(a[1], float), np.array(b[1], float)
                if x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.93:
                    link[a[0]].add(b[0])
    pairs = [(a, b) for a in link for b in link[a]]
    nodes, low = min_labels(np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs]))
    comp = dict(zip(nodes.tolist(), low.tolist()))
    return {i: (len(x), comp.get(i, i)) for i, x in link.items()}


@pytest.mark.parametrize("block", [4096, 16])
def test_links_equal_brute_force(spark, block):
    rows, df = vectors(spark)
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in neardup_vectors.near_duplicates(df, tables=12, probes=4, block=block).collect()}
    assert got == brute(rows)


@pytest.mark.parametrize("block", [4096, 50])
def test_links_near_the_threshold_by_the_querys_setting(spark, block):
    rng = np.random.default_rng(21)
    base = rng.normal(size=(120, 64))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    rows = []
    for i, x in enumerate(base):
        for k in range(4):  # cosines to the base from 0.90 to 0.99
            y = rng.normal(size=64)
            y -= (y @ x) * x
            c = rng.uniform(0.90, 0.99)
            rows.append((4 * i + k, (x if k == 0 else c * x + np.sqrt(1 - c * c) * y / np.linalg.norm(y)).tolist(), i % 2))
    rows += [(1000 + k, (base[0] + 0.02 * rng.normal(size=64)).tolist(), 0) for k in range(200)]  # a dense group
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3)
    want = brute(rows)
    assert sum(n for n, _ in want.values()) > 10_000
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in neardup_vectors.near_duplicates(df, block=block).collect()}
    assert got == want


def test_sketches_pass_pairs_at_the_threshold():
    rng = np.random.default_rng(22)
    for dim in (16, 64, 100, 768):
        x, y = rng.normal(size=(2, 3000, dim))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        y -= (x * y).sum(axis=1, keepdims=True) * x
        y /= np.linalg.norm(y, axis=1, keepdims=True)
        z = 0.93 * x + np.sqrt(1 - 0.93**2) * y
        differ = np.bitwise_count(neardup_vectors.sketches(x, 7) ^ neardup_vectors.sketches(z, 7)).sum(axis=1)
        assert (differ <= neardup_vectors.most_differ(dim, 0.93)).all()


def test_repeated_rows_and_empty_tables(spark):
    _, df = vectors(spark, 60)
    one = sorted(map(tuple, neardup_vectors.near_duplicates(df).collect()))
    assert sorted(map(tuple, neardup_vectors.near_duplicates(df.union(df)).collect())) == one
    empty = df.limit(0)
    assert neardup_vectors.near_duplicates(empty).count() == 0
    assert ann.search(empty, empty).count() == 0


def test_nearest_neighbours_recall_and_scores(spark):
    rows, df = vectors(spark, 600, 2)
    got = ann.search(df, df.where("vec_id % 100 = 0"), k=10).collect()
    own = [(r[0], np.array(r[1], float)) for r in rows if r[0] is not None and usable(r[1]) and len(r[1]) == 8]
    hit = total = 0
    for q in {r["query_id"] for r in got}:
        x = dict(own)[q]
        want = sorted((float(np.sqrt(((y - x) ** 2).sum())), i) for i, y in own if i != q)[:10]
        mine = [(r["score"], r["vec_id"]) for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == q]
        assert mine == sorted(mine) and len(mine) == 10
        hit += len({i for _, i in mine} & {i for _, i in want})
        total += 10
    assert {r["query_id"] for r in got} == {i for i, _ in own if i % 100 == 0}
    assert hit >= 0.9 * total


def test_queries_at_their_centroid_get_all_their_rows(spark):
    rng = np.random.default_rng(6)
    near = rng.normal(size=(1140, 8)) * 0.3 + 10 * np.eye(8)[rng.integers(0, 8, 1140)]
    far = 40 * rng.normal(size=(60, 8))  # outliers become centroids of their own
    groups = np.repeat(30 * rng.normal(size=(20, 8)), 6, axis=0) + 0.01 * rng.normal(size=(120, 8))
    x = np.concatenate([near, far, groups])
    df = spark.createDataFrame(list(enumerate(x.tolist())), "vec_id long, embedding array<double>").repartition(3)
    got = ann.search(df, df, k=10).groupBy("query_id").count().collect()
    assert len(got) == len(x) and all(r["count"] == 10 for r in got)
    short = ann.search(df.where("vec_id >= 1140"), df.where("vec_id >= 1140"), k=200).groupBy("query_id").count().collect()
    assert len(short) == 180 and all(r["count"] == 179 for r in short)  # all there are


def test_clustered_vectors_are_found_in_few_of_many_lists(spark, monkeypatch):
    rng = np.random.default_rng(31)
    centres = 4 * rng.normal(size=(400, 24))
    x = centres[rng.integers(0, 400, 6000)] + 0.6 * rng.normal(size=(6000, 24))
    x[5996:] = 100 + 0.01 * rng.normal(size=(4, 24))  # a far group smaller than k
    df = spark.createDataFrame(list(enumerate(x.tolist())), "vec_id long, embedding array<double>").repartition(3)
    asked = df.where("vec_id % 50 = 0 or vec_id >= 5996")
    read = []
    kept = ann._chosen

    def watched(graph, ratio, sizes, least):
        for q in [*range(0, 6000, 50)]:
            read.append(len(graph.within(x[q], ratio)[0]) / len(graph.points))
        assert len(graph.points) > 256
        return kept(graph, ratio, sizes, least)

    monkeypatch.setattr(ann, "_chosen", watched)
    got = ann.search(df, asked, k=10, n_lists=300).collect()
    assert np.mean(read) <= 0.1, np.mean(read)
    by = {}
    for r in got:
        by.setdefault(r["query_id"], []).append(r["vec_id"])
    hit = total = 0
    for q in [*range(0, 6000, 50), *range(5996, 6000)]:
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        d[q] = np.inf
        assert len(by[q]) == 10
        if q < 5996:
            hit += len(set(by[q]) & set(np.argsort(d)[:10].tolist()))
            total += 10
        else:
            assert set(range(5996, 6000)) - {q} <= set(by[q])
    assert hit >= 0.9 * total, hit / total


def test_evenly_spread_vectors_reach_the_recall(spark):
    rng = np.random.default_rng(32)
    x = rng.normal(size=(3000, 32))
    df = spark.createDataFrame(list(enumerate(x.tolist())), "vec_id long, embedding array<double>").repartition(3)
    by = {}
    for r in ann.search(df, df.where("vec_id % 60 = 0")).collect():
        by.setdefault(r["query_id"], set()).add(r["vec_id"])
    hit = 0
    for q in range(0, 3000, 60):
        d = ((x - x[q]) ** 2).sum(1)
        d[q] = np.inf
        hit += len(by[q] & set(np.argsort(d)[:10].tolist()))
    assert hit >= 0.9 * 500, hit / 500


def test_fewer_candidates_than_asked(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0], 1), (5, [2.0, 0.0], 1), (3, [0.0, 0.0], 1)], "vec_id long, embedding array<double>, label int")
    assert [tuple(r) for r in ann.search(df, df.where("vec_id = 0")).collect()] == [(0, 1, 5, 1.0)]


@pytest.mark.parametrize("bound", [10**6, 0])
def test_components_by_either_way(spark, bound):
    rng = np.random.default_rng(4)
    a, b = rng.integers(0, 400, 300), rng.integers(0, 400, 300)
    a, b = np.append(a, np.arange(1000, 1060)), np.append(b, np.arange(1001, 1061))
    on = a != b
    nodes, low = min_labels(a[on], b[on])
    df = spark.createDataFrame(list(zip(a.tolist(), b.tolist())), "a long, b long").repartition(5)
    got = {r["id"]: r["component"] for r in components(df, local_links=bound).collect()}
    assert got == dict(zip(nodes.tolist(), low.tolist()))
