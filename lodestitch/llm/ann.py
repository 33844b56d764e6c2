"""Approximate nearest neighbours: balanced posting lists around centroids, searched by an in-memory graph."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, n_partitions
from .neardup_vectors import vectors_of


def centroids(sample: np.ndarray, n: int, rounds: int = 12, seed: int = 5, balance: float = 0.5) -> np.ndarray:
    """k-means with a penalty on full clusters, so that the lists come out balanced. `sample` is bounded by the caller."""
    rng = np.random.default_rng(seed)
    sample = np.unique(sample, axis=0)
    c = sample[rng.choice(len(sample), min(n, len(sample)), replace=False)].copy()
    fill = np.zeros(len(c))
    scale = sample.var(axis=0).sum()
    for _ in range(rounds):
        d = (sample**2).sum(1)[:, None] - 2 * sample @ c.T + (c**2).sum(1)[None]
        near = (d + balance * scale * (fill / max(1.0, fill.mean()) - 1.0).clip(-1, 4)[None] * 0.1).argmin(1)
        count = np.bincount(near, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, near, sample)
        c[count > 0] = total[count > 0] / count[count > 0, None]
        if (empty := np.flatnonzero(count == 0)).size:
            c[empty] = sample[rng.choice(len(sample), len(empty))]
        fill = count.astype(float)
    return np.unique(c, axis=0)


class Graph:
    """A neighbour graph of the centroids with greedy best-first search from fixed entry points."""

    def __init__(self, points: np.ndarray, degree: int = 16, seed: int = 3) -> None:
        self.points = points
        n = len(points)
        d = (points**2).sum(1)[:, None] - 2 * points @ points.T + (points**2).sum(1)[None]
        near = np.argsort(d, axis=1, kind="stable")[:, 1 : degree + 1]
        links = [set(x.tolist()) for x in near]
        for i, x in enumerate(near.tolist()):
            for j in x:
                links[j].add(i)
        rng = np.random.default_rng(seed)
        for i in range(n):  # a ring in random order keeps the graph connected
            links[i].add(int((i + 1) % n))
            links[i].add(int(rng.integers(n)))
        self.links = [np.array(sorted(x - {i}), dtype=np.int64) for i, x in enumerate(links)]
        self.entries = rng.choice(n, min(n, 8), replace=False)

    def within(self, x: np.ndarray, ratio: float, least: int = 24) -> tuple[np.ndarray, np.ndarray]:
        """The points found within `ratio` times the distance of the nearest one, nearest first, and their distances.

        Best-first from the entries: points are expanded in order of distance until `least` are and the next one lies
        beyond the ratio, so what is visited grows with what is asked for and not with the graph.
        """
        dist = lambda at: np.sqrt(((self.points[at] - x) ** 2).sum(1))
        seen = np.zeros(len(self.points), bool)
        seen[self.entries] = True
        todo = list(zip(dist(self.entries).tolist(), self.entries.tolist(), strict=True))
        heapq.heapify(todo)
        done: list[tuple[float, int]] = []
        nearest = math.inf
        while todo:
            v, i = heapq.heappop(todo)
            if len(done) >= least and v > ratio * nearest:
                break
            done.append((v, i))
            nearest = min(nearest, v)
            new = self.links[i][~seen[self.links[i]]]
            if len(new):
                seen[new] = True
                for w, j in zip(dist(new).tolist(), new.tolist(), strict=True):
                    heapq.heappush(todo, (w, j))
        done.sort()
        done = [x for x in done if x[0] <= ratio * nearest]
        return np.array([i for _, i in done], dtype=np.int64), np.array([v for v, _ in done])


def assign(x: np.ndarray, points: np.ndarray, replicas: int, closeness: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, list): each row's nearest point and, near a boundary, further ones at most `closeness` times as far, `replicas` in
    all. A point that lies closer to one already chosen than to the row is left out."""
    d = (x**2).sum(1)[:, None] - 2 * x @ points.T + (points**2).sum(1)[None]
    m = min(3 * replicas, len(points))
    near = np.argpartition(d, m - 1, axis=1)[:, :m]
    d = ((points[near] - x[:, None]) ** 2).sum(2)
    order = np.lexsort((near, d), axis=1)
    near, d = np.take_along_axis(near, order, 1), np.take_along_axis(d, order, 1)
    own = points[near]
    apart = ((own[:, :, None] - own[:, None]) ** 2).sum(3)
    kept = np.zeros(near.shape, bool)
    kept[:, 0] = True
    for j in range(1, m):
        free = (apart[:, j] > d[:, j, None]) | ~kept
        kept[:, j] = free.all(axis=1) & (d[:, j] <= closeness**2 * d[:, 0]) & (kept.sum(axis=1) < replicas)
    row, at = np.nonzero(kept)
    return row, near[row, at]


def needed_ratio(sample: np.ndarray, points: np.ndarray, k: int, replicas: int, closeness: float, recall: float, asked: int = 256, seed: int = 5) -> float:
    """The distance ratio within which queries read a list of the share `recall` of their `k` nearest, measured on the sample.

    The sample is sparser than the table, so its neighbours lie further apart, and the table's recall is no lower.
    """
    if len(sample) < 2:
        return 1.0
    q = np.random.default_rng(seed).choice(len(sample), min(asked, len(sample)), replace=False)
    lists: list[list[int]] = [[] for _ in range(len(sample))]
    for start in range(0, len(sample), 512):
        row, at = assign(sample[start : start + 512], points, replicas, closeness)
        for i, c in zip((row + start).tolist(), at.tolist(), strict=True):
            lists[i].append(c)
    found = []
    for i in q.tolist():
        d = ((sample - sample[i]) ** 2).sum(1)
        d[i] = np.inf
        near = np.argpartition(d, min(k, len(d) - 1) - 1)[: min(k, len(d) - 1)]
        far = np.sqrt(((points - sample[i]) ** 2).sum(1))
        found += [far[lists[j]].min() / max(far.min(), 1e-300) if far[lists[j]].min() > far.min() else 1.0 for j in near.tolist()]
    return float(np.quantile(found, recall, method="higher"))


def _postings(points: np.ndarray, replicas: int, closeness: float):
    """(list, id, vec): each vector in its nearest list, and those near a boundary in further ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 512):
                b = whole.slice(start, 512)
                at, got = vectors_of(b.column("vec"))
                on = [k for k, x in enumerate(got) if len(x) == points.shape[1]]
                if not on:
                    continue
                x = np.stack([got[k] for k in on])
                ids = b.column("id").take(pa.array([at[k] for k in on]))
                row, lists = assign(x, points, replicas, closeness)
                blobs = pa.array([v.tobytes() for v in x], pa.binary())
                row = pa.array(row)
                yield pa.RecordBatch.from_arrays([pa.array(lists.astype(np.int32)), ids.take(row), blobs.take(row)], names=["list", "id", "vec"])

    return run


def _chosen(graph: Graph, ratio: float, sizes: np.ndarray, least: int):
    """(list, query, qvec): the lists to read for each query, those within `ratio` times the distance of the nearest.

    Lists that hold fewer than `least` rows together by `sizes` are followed by further ones in order of distance, until
    they do or all are read.
    """

    def read(x: np.ndarray) -> list[int]:
        out, _ = graph.within(x, ratio)
        if sizes[out].sum() < least:
            rest = np.argsort(((graph.points - x) ** 2).sum(1), kind="stable")
            rest = rest[~np.isin(rest, out)]
            before = sizes[out].sum() + np.cumsum(sizes[rest]) - sizes[rest]
            out = np.concatenate([out, rest[(before < least) & (sizes[rest] > 0)]])
        return out[sizes[out] > 0].tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, got = vectors_of(b.column("vec"))
            ids = b.column("id").to_pylist()
            rows = []
            for i, x in zip(at, got, strict=True):
                if len(x) == graph.points.shape[1]:
                    rows += [(c, ids[i], x.tobytes()) for c in read(x)]
            cols = list(zip(*rows, strict=True)) if rows else [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int64(), pa.binary()), strict=True)], names=["list", "id", "vec"])

    return run


def _scan(k: int):
    """The k nearest of each query within a part of a posting list; rows come sorted by list, part and side."""

    def nearest(queries: list[tuple], ids: list[int], blobs: list[bytes], best: dict) -> None:
        if not queries or not ids:
            return
        x = np.frombuffer(b"".join(blobs), dtype=np.float64).reshape(len(ids), -1)
        own = np.array(ids)
        for q, blob in queries:
            d = np.sqrt(((x - np.frombuffer(blob, dtype=np.float64)) ** 2).sum(1))
            on = np.flatnonzero(own != q)
            top = on[np.lexsort((own[on], d[on]))[:k]]
            best[q] = heapq.nsmallest(k, best.get(q, []) + list(zip(d[top].tolist(), own[top].tolist(), strict=True)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, queries, ids, blobs, best = None, [], [], [], {}

        def rows() -> pa.RecordBatch:
            nearest(queries, ids, blobs, best)
            got = [(q, i, d) for q, x in best.items() for d, i in x]
            cols = list(zip(*got, strict=True)) if got else [[], [], []]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.float64()), strict=True)], names=["query_id", "vec_id", "score"])

        for b in batches:
            cols = [b.column(c).to_pylist() for c in ("list", "part", "side", "id", "vec")]
            for c, p, side, i, v in zip(*cols, strict=True):
                if (c, p) != key:
                    if key is not None:
                        yield rows()
                    key, queries, ids, blobs, best = (c, p), [], [], [], {}
                if side == 0:
                    queries.append((i, v))
                else:
                    ids.append(i)
                    blobs.append(v)
                    if len(ids) == 4096:
                        nearest(queries, ids, blobs, best)
                        ids, blobs = [], []
        if key is not None:
            yield rows()

    return run


def search(
    df: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding", sample_rows: int = 40_000,
    n_lists: int | None = None, replicas: int = 4, closeness: float = 1.12, recall: float = 0.97, ratio: float | None = None, part_rows: int = 1024, seed: int = 5,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows of `df` found for each row of `queries`, itself left out.

    Centroids are fitted on the `sample_rows` rows whose hashed ids are smallest; every row is indexed. There are
    `n_lists` of them, or as many as the root of the number of rows (4,096 at most, and one for 8 sampled rows), so they
    and their graph may be sent to the tasks. A vector lies in its nearest posting list and, near a boundary, in up to
    `replicas` lists at most `closeness` times as far. A query reads all lists whose centroids the graph's search finds
    within `ratio` times the nearest one's distance, and further ones until these hold `k` other vectors. Without a `ratio`
    it is the one that gives queries of the sample the share `recall` of their neighbours (see `needed_ratio`): few lists
    where vectors lie in clusters, most where they lie evenly in many dimensions. Lists of over `part_rows` rows are split
    evenly by id and read in parts. score is the Euclidean distance of the original vectors in double precision; ties go
    to the smaller id. Vectors that are null, empty, zero or hold null or non-finite components take no part, nor do rows
    with a null id; of rows that repeat an id, one counts. Vectors of another length than most of the sample's take no
    part.
    """
    spark = df.sparkSession
    of = lambda x: x.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec")).where("id is not null")
    rows = of(df)
    got = rows.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(sample_rows).toArrow()  # bounded by sample_rows
    _, sample = vectors_of(got.column("vec").combine_chunks()) if got.num_rows else ([], [])
    empty = "query_id long, rank int, vec_id long, score double"
    if not sample:
        return spark.createDataFrame([], empty)
    lengths = [len(x) for x in sample]
    dim = max(set(lengths), key=lengths.count)
    fit = np.array([x for x in sample if len(x) == dim])
    most = n_lists or min(4096, math.isqrt(rows.count()) + 1)
    graph = Graph(centroids(fit, min(most, max(1, len(fit) // 8)), seed=seed))
    if ratio is None:
        ratio = needed_ratio(fit, graph.points, k, replicas, closeness, recall)
    postings = cut(rows.mapInArrow(_postings(graph.points, replicas, closeness), "list int, id long, vec binary").dropDuplicates(["list", "id"]), "postings")
    held = postings.groupBy("list").agg(F.count("*").alias("n"), F.ceil(F.count("*") / F.lit(part_rows)).cast("int").alias("parts"))  # one row a list
    sizes = np.zeros(len(graph.points), np.int64)
    for r in held.collect():  # n_lists rows at most
        sizes[r["list"]] = r["n"]
    parts = held.select("list", "parts")
    # a vector lies in `replicas` lists at most, so as many rows hold k vectors besides the query's own
    asked = of(queries).mapInArrow(_chosen(graph, ratio, sizes, replicas * (k + 1)), "list int, id long, vec binary").dropDuplicates(["list", "id"])
    right = postings.join(F.broadcast(parts), "list").select("list", F.pmod(F.xxhash64("id"), "parts").cast("int").alias("part"), F.lit(1).alias("side"), "id", "vec")
    left = asked.join(F.broadcast(parts), "list").select("list", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("side"), "id", "vec")
    near = left.union(right).repartition(n_partitions(spark), "list", "part").sortWithinPartitions("list", "part", "side")
    found = near.mapInArrow(_scan(k), "query_id long, vec_id long, score double").distinct()
    by = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
