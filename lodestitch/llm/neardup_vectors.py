"""Near-duplicates of vectors: cross-polytope hashing after fast Hadamard rotations, multiprobe buckets, verified pairs."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, cut, min_labels, n_partitions

#: Rows of a bucket that one task compares at once; larger buckets are split in blocks and compared block against block.
BLOCK = 4096
#: Sign bits of a vector's sketch.
SKETCH = 128


def rotations(dim: int, n: int, seed: int) -> np.ndarray:
    """n x 3 x d random signs, d being the power of two at or above `dim`."""
    d = 1 << max(1, (dim - 1).bit_length())
    return np.random.default_rng([seed, dim]).choice(np.array([-1.0, 1.0]), size=(n, 3, d))


def hadamard(x: np.ndarray) -> np.ndarray:
    """The fast Walsh-Hadamard transform of each row, scaled to keep lengths."""
    n, d = x.shape
    step = 1
    while step < d:
        y = x.reshape(n, d // (2 * step), 2, step)
        x = np.concatenate([y[:, :, :1] + y[:, :, 1:], y[:, :, :1] - y[:, :, 1:]], axis=2).reshape(n, d)
        step *= 2
    return x / np.sqrt(d)


def polytope_codes(unit: np.ndarray, tables: int, probes: int, seed: int) -> np.ndarray:
    """n x tables x probes bucket codes; the first of each table is the vector's own bucket.

    A code is a pair of nearest vertices of the cross-polytope (the coordinate of largest absolute value, with its
    sign) under two rotations. The other codes take the next-nearest vertices, those first that lose least.
    """
    n, dim = unit.shape
    signs = rotations(dim, 2 * tables, seed)
    d = signs.shape[2]
    wide = np.zeros((n, d))
    wide[:, :dim] = unit
    deep = min(probes, d)
    out = np.zeros((n, tables, probes), dtype=np.int32)
    for t in range(tables):
        best, loss = [], []
        for s in signs[2 * t : 2 * t + 2]:
            x = wide
            for sign in s:
                x = hadamard(x * sign)
            top = np.argsort(-np.abs(x), axis=1, kind="stable")[:, :deep]
            v = np.take_along_axis(x, top, axis=1)
            best.append(2 * top + (v < 0))
            loss.append((np.abs(v[:, :1]) - np.abs(v)))
        total = loss[0][:, :, None] + loss[1][:, None, :]
        code = (best[0][:, :, None] * (2 * d) + best[1][:, None, :]).reshape(n, -1)
        order = np.argsort(total.reshape(n, -1), axis=1, kind="stable")[:, :probes]
        got = np.take_along_axis(code, order, axis=1)
        out[:, t, : got.shape[1]] = got
        out[:, t, got.shape[1] :] = got[:, :1]
    return out


def vectors_of(col: pa.Array) -> tuple[list[int], list[np.ndarray]]:
    """Positions and values of the vectors that are not null, empty or zero and hold neither nulls nor non-finite numbers."""
    at, got = [], []
    for i, v in enumerate(col):
        if not v.is_valid or not len(v.values) or v.values.null_count:
            continue
        x = v.values.to_numpy().astype(np.float64)
        if np.isfinite(x).all() and x.any():
            at.append(i)
            got.append(x)
    return at, got


def _valid(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        at, got = vectors_of(b.column("vec"))
        ids = b.column("id").take(pa.array(at, pa.int64()))
        labels = b.column("label").take(pa.array(at, pa.int64()))
        yield pa.RecordBatch.from_arrays([ids, labels, pa.array([x.tobytes() for x in got], pa.binary())], names=["id", "label", "vec"])


def sketches(unit: np.ndarray, seed: int) -> np.ndarray:
    """n x 2 words of SKETCH sign bits of rotated vectors."""
    n, dim = unit.shape
    d = 1 << max(1, (dim - 1).bit_length())
    signs = rotations(dim, -(-SKETCH // d), seed + 1)
    wide = np.zeros((n, d))
    wide[:, :dim] = unit
    bits = []
    for s in signs:
        x = wide
        for sign in s:
            x = hadamard(x * sign)
        bits.append(x < 0)
    return np.packbits(np.concatenate(bits, axis=1)[:, :SKETCH], axis=1).view(np.uint64)


def most_differ(dim: int, threshold: float) -> int:
    """How many sketch bits differ at most for a pair to be compared: five standard deviations over those expected at the
    threshold, taking bits of one rotation as so many independent draws as it has dimensions."""
    p = math.acos(max(-1.0, min(1.0, threshold))) / math.pi
    d = 1 << max(1, (dim - 1).bit_length())
    return SKETCH if d < 16 else math.ceil(SKETCH * p + 5 * math.sqrt(SKETCH * p * (1 - p)))


def _hashed(tables: int, probes: int, seed: int):
    """(dim, label, h1, h2, rep, n, vec, codes, sketch, buckets) of each class: hashed once, read by all that follows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                b = whole.slice(at, 1024)
                blobs = b.column("vec").to_pylist()
                by_dim: dict[int, list[int]] = {}
                for i, x in enumerate(blobs):
                    by_dim.setdefault(len(x) // 8, []).append(i)
                for dim, rows in by_dim.items():
                    x = np.frombuffer(b"".join(blobs[i] for i in rows), dtype=np.float64).reshape(-1, dim)
                    x = x / np.abs(x).max(axis=1, keepdims=True)
                    x = x / np.linalg.norm(x, axis=1, keepdims=True)
                    codes, sketch = polytope_codes(x, tables, probes, seed), sketches(x, seed)
                    key = ((np.arange(tables, dtype=np.int64)[None, :, None] << 40) + codes).reshape(len(rows), -1)
                    part = b.take(pa.array(rows))
                    kept = [part.column(c) for c in ("label", "h1", "h2", "rep", "n", "vec")]
                    new = [pa.array([c.tobytes() for c in codes], pa.binary()), pa.array([c.tobytes() for c in sketch], pa.binary()), pa.array([np.unique(k) for k in key], pa.list_(pa.int64()))]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), dim, np.int32)), *kept, *new], names=["dim", "label", "h1", "h2", "rep", "n", "vec", "codes", "sketch", "buckets"])

    return run


KEY = ("bucket", "dim", "label", "bi", "bj")


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of whole groups (rows come sorted by KEY), of some tens of thousands of rows; no group is split."""
    rest: list[pa.RecordBatch] = []
    held = 0
    for b in batches:
        if not b.num_rows:
            continue
        rest.append(b)
        held += b.num_rows
        if held < 20_000:
            continue
        t = pa.Table.from_batches(rest).combine_chunks()
        first = _starts(t)
        if len(first) > 1:
            yield t.slice(0, int(first[-1]))
            t = t.slice(int(first[-1]))
        rest, held = t.combine_chunks().to_batches(), t.num_rows
    if rest:
        yield pa.Table.from_batches(rest).combine_chunks()


def _starts(t: pa.Table) -> np.ndarray:
    """Where groups begin."""
    new = np.zeros(t.num_rows, bool)
    new[0] = True
    for c in KEY:
        x = t.column(c).combine_chunks()
        x = x.dictionary_encode().indices.to_numpy() if c == "label" else x.to_numpy()
        new[1:] |= x[1:] != x[:-1]
    return np.flatnonzero(new)


def _words(col: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), np.uint64).reshape(len(col), -1)


def _live(threshold: float):
    """(bucket, dim, label, bi, bj, rep, side) of the rows of a block pair that have another row there whose sketch is near.

    Small groups are compared all at once, pair lists being bounded; large ones sketch block against sketch block.
    """

    def near(words: np.ndarray, i: np.ndarray, j: np.ndarray, most: np.ndarray) -> np.ndarray:
        return np.bitwise_count(words[i] ^ words[j]).sum(axis=1) <= most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(batches):
            words, side = _words(t.column("sketch")), t.column("side").combine_chunks().to_numpy()
            dims = t.column("dim").combine_chunks().to_numpy()
            most = {int(d): most_differ(int(d), threshold) for d in np.unique(dims)}
            bound = np.array([most[int(d)] for d in dims])
            split = t.column("bi").combine_chunks().to_numpy() != t.column("bj").combine_chunks().to_numpy()
            first = _starts(t)
            size = np.diff(np.append(first, t.num_rows))
            live = np.zeros(t.num_rows, bool)
            small = np.flatnonzero((size > 1) & (size <= 64))
            # rows of small groups with the 1st, 2nd, ... row after them in the group
            rank = np.arange(t.num_rows) - np.repeat(first, size)
            left = np.repeat(size, size) - rank - 1
            rows = np.flatnonzero(np.repeat((size > 1) & (size <= 64), size))
            for step in range(1, int(size[small].max(initial=1))):
                i = rows[left[rows] >= step]
                j = i + step
                on = ~split[i] | (side[i] != side[j])
                i, j = i[on], j[on]
                hit = near(words, i, j, bound[i])
                live[i[hit]] = live[j[hit]] = True
            for g in np.flatnonzero(size > 64).tolist():
                a, e = int(first[g]), int(first[g] + size[g])
                rows_l = np.arange(a, e)[side[a:e] == 0] if split[a] else np.arange(a, e)
                rows_r = np.arange(a, e)[side[a:e] == 1] if split[a] else rows_l
                for k in range(0, len(rows_l), 256):
                    x = rows_l[k : k + 256]
                    differ = sum(np.bitwise_count(words[x, w][:, None] ^ words[rows_r, w][None, :]).astype(np.int16) for w in range(words.shape[1]))
                    hit = differ <= bound[a]
                    hit &= x[:, None] != rows_r[None, :]
                    live[x[hit.any(axis=1)]] = True
                    live[rows_r[hit.any(axis=0)]] = True
            if live.any():
                yield from t.select([*KEY, "rep", "side"]).filter(pa.array(live)).to_batches()

    return run


def _compare(tables: int, probes: int, threshold: float):
    """Links inside blocks of buckets; a pair counts in the first bucket where it meets, and nowhere else."""

    def unpack(t: pa.Table, dim: int) -> tuple:
        x = np.frombuffer(b"".join(t.column("vec").to_pylist()), dtype=np.float64).reshape(-1, dim)
        x = x / np.abs(x).max(axis=1, keepdims=True)
        codes = np.frombuffer(b"".join(t.column("codes").to_pylist()), dtype=np.int32).reshape(t.num_rows, tables, probes)
        return t.column("rep").to_numpy(), t.column("n").to_numpy(), x / np.linalg.norm(x, axis=1, keepdims=True), codes

    def first_here(a: np.ndarray, b: np.ndarray, table: int, code: int) -> np.ndarray:
        meet = a[:, :, :, None] == b[:, :, None, :]  # pairs x tables x probes x probes
        earlier = meet[:, :table].any(axis=(1, 2, 3)) if table else np.zeros(len(a), bool)
        lower = (meet[:, table].any(axis=2) & (a[:, table] < code)).any(axis=1)
        return ~earlier & ~lower

    def block(left: tuple, right: tuple | None, bucket: int) -> list[pa.RecordBatch]:
        ids, n, x, codes = left
        ids2, n2, x2, codes2 = right if right is not None else left
        table, code = bucket >> 40, bucket & ((1 << 40) - 1)
        count, count2 = np.zeros(len(ids), np.int64), np.zeros(len(ids2), np.int64)
        out = []
        for at in range(0, len(ids), 512):
            i, j = np.nonzero(x[at : at + 512] @ x2.T >= threshold)
            i += at
            on = ids[i] != ids2[j] if right is not None else i < j
            i, j = i[on], j[on]
            for k in range(0, len(i), 20_000):
                a, b = i[k : k + 20_000], j[k : k + 20_000]
                here = first_here(codes[a], codes2[b], table, code)
                a, b = a[here], b[here]
                if not len(a):
                    continue
                np.add.at(count, a, n2[b])
                np.add.at(count2, b, n[a])
                # a tree of links for each part, as components need no more
                nodes, root = min_labels(ids[a], ids2[b])
                on = nodes != root
                out.append(batch(nodes[on], np.zeros(on.sum(), np.int64), root[on]))
        for who, c in ((ids, count), (ids2, count2)):
            on = c > 0
            out.append(batch(who[on], c[on], None))
        return out

    def batch(ids: np.ndarray, links: np.ndarray, root: np.ndarray | None) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(links, pa.int64()), pa.array(root, pa.int64()) if root is not None else pa.nulls(len(ids), pa.int64())], names=["id", "links", "root"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(batches):
            first = _starts(t)
            for a, e in zip(first.tolist(), [*first[1:].tolist(), t.num_rows], strict=True):
                if e - a < 2:
                    continue
                g = t.slice(a, e - a)
                dim, bucket = g.column("dim")[0].as_py(), g.column("bucket")[0].as_py()
                if g.column("bi")[0].as_py() == g.column("bj")[0].as_py():
                    yield from block(unpack(g, dim), None, bucket)
                    continue
                side = g.column("side").to_numpy()
                left, right = (g.filter(pa.array(side == k)) for k in (0, 1))
                if left.num_rows and right.num_rows:
                    yield from block(unpack(left, dim), unpack(right, dim), bucket)

    return run


def near_duplicates(
    df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", threshold: float = 0.93,
    tables: int = 8, probes: int = 3, seed: int = 7, block: int = BLOCK,
) -> DataFrame:
    """(id, n_links, component_id, kept) for every row: links are pairs with one label and a cosine of `threshold` or more.

    Equal vectors of one label form a class and travel as one row with their number; links are found between classes and
    counted with the classes' sizes. Classes go to their buckets as ids with a sketch of 128 sign bits; only members that
    have a near sketch in the bucket are sent there again with their vectors, and compared. Buckets of over `block` rows
    are dealt as pairs of blocks. A vector that is null, empty, zero or holds null or non-finite components links with
    nothing, nor does one without a label; vectors of different lengths never link. Rows with a null id are left out.
    Rows that repeat an id are one row (one of their vectors counts, by the smallest hash). Other columns are ignored.
    """
    spark = df.sparkSession
    n_parts = n_partitions(spark)
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), F.col(vec_col).cast("array<double>").alias("vec")).where("id is not null")
    usable = rows.where("label is not null").mapInArrow(_valid, "id long, label string, vec binary")
    usable = usable.select("id", "label", F.xxhash64("vec").alias("h1"), F.xxhash64(F.lit(17), "vec").alias("h2"), "vec")
    # a class is told by its label and 128 bits of hashes; ids travel without their vectors
    one = ["label", "h1", "h2"]
    members = cut(usable.groupBy("id").agg(F.min(F.struct("h1", "h2", "label")).alias("x")).select("id", "x.*"), "members")
    sizes = members.groupBy(*one).agg(F.min("id").alias("rep"), F.count("*").alias("n"))
    grouped = sizes.join(usable.groupBy(*one).agg(F.min("vec").alias("vec")), one)
    kind = "dim int, label string, h1 long, h2 long, rep long, n long, vec binary, codes binary, sketch binary, buckets array<long>"
    classes = cut(grouped.select(*one, "rep", "n", "vec").mapInArrow(_hashed(tables, probes, seed), kind), "classes")
    spread = classes.select(F.explode("buckets").alias("bucket"), "dim", "label", "rep", "sketch")
    key = ["bucket", "dim", "label"]
    # Buckets of more than `block` rows: each row goes to the pairs of its block with every block of the bucket.
    large = cut(spread.groupBy(*key).count().where(F.col("count") > block).select(*key, F.ceil(F.col("count") / block).cast("int").alias("blocks")), "large")
    own = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    if large.limit(1).count():
        spread = spread.join(large, key, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("own", own)
        spread = spread.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    else:
        spread = spread.withColumns({"own": F.lit(0), "other": F.lit(0)})
    spread = spread.select(*key, "rep", "sketch", F.least("own", "other").alias("bi"), F.greatest("own", "other").alias("bj"), F.when(F.col("own") <= F.col("other"), 0).otherwise(1).alias("side"))
    sorted_ = lambda x: x.repartition(n_parts, *KEY).sortWithinPartitions(*KEY)
    live = sorted_(spread).mapInArrow(_live(threshold), "bucket long, dim int, label string, bi int, bj int, rep long, side int")
    live = cut(live, "live")
    found = sorted_(live.join(classes.select("rep", "n", "vec", "codes"), "rep")).mapInArrow(_compare(tables, probes, threshold), "id long, links long, root long")
    found = cut(found, "links")
    comp = components(found.where("root is not null").select("id", "root"))
    counts = found.where("root is null").groupBy("id").agg(F.sum("links").alias("links"))
    by_class = (
        classes.select(*one, "rep", "n")
        .join(counts.withColumnRenamed("id", "rep"), "rep", "left")
        .join(comp.withColumnRenamed("id", "rep"), "rep", "left")
        .select(*one, (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    )
    linked = members.join(by_class, one).select("id", "n_links", "component_id")
    out = rows.select("id").distinct().join(linked, "id", "left").select(
        F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "id").alias("component_id")
    )
    return out.withColumn("kept", F.col(id_col) == F.col("component_id"))
