"""Helpers of the corpus operators: lineage cuts in the shared folder, connected components, byte-level text views."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Components of up to so many links are found in one task (16 bytes a link); more take the distributed rounds.
LOCAL_LINKS = 1_000_000
#: Text is worked on in pieces of about so many bytes, so that numpy's arrays stay small.
CHUNK_BYTES = 3_000_000


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors share. Unset: a temporary one, on a local master only."""
    if at := spark.conf.get("spark.checkpoint.dir", None):
        return at.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    at = "file://" + tempfile.mkdtemp(prefix="lodestitch-")
    spark.conf.set("spark.checkpoint.dir", at)
    return at


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """`df` written once to the shared folder and read again: later stages don't recompute it, and lost executors don't matter."""
    path = f"{shared_dir(df.sparkSession)}/lodestitch-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def drop(df: DataFrame) -> None:
    """Delete what `cut` wrote. Only for tables that no later action reads."""
    if path := getattr(df, "_cut_path", None):
        jvm = df.sparkSession._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(p, True)


def fresh(name: str, columns: list[str]) -> str:
    """`name`, with underscores before it until no column has it (upper and lower case are one)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def n_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


# --- connected components ---------------------------------------------------------------------------------------------


def min_labels(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the links (a, b) and each one's smallest reachable node, by hooking and pointer jumping."""
    nodes, inv = np.unique(np.concatenate([a, b]), return_inverse=True)
    ia, ib = inv[: len(a)], inv[len(a) :]
    label = np.arange(len(nodes))
    while True:
        la, lb = label[ia], label[ib]
        low = np.minimum(la, lb)
        new = label.copy()
        for at in (ia, ib, la, lb):
            np.minimum.at(new, at, low)
        while not np.array_equal(new, jumped := new[new]):
            new = jumped
        if np.array_equal(new, label):
            return nodes, nodes[label]
        label = new


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The task's links as stars: (node, smallest node of its part)."""
    kept = [(x.column(0).to_numpy(), x.column(1).to_numpy()) for x in batches if x.num_rows]
    if kept:
        nodes, low = min_labels(*(np.concatenate(x) for x in zip(*kept, strict=True)))
        on = nodes != low
        yield pa.RecordBatch.from_arrays([pa.array(nodes[on]), pa.array(low[on])], names=["u", "v"])


def components(edges: DataFrame, local_links: int = LOCAL_LINKS) -> DataFrame:
    """(id, component) for each node of `edges` (two long columns): component is the smallest node it reaches.

    Each task first contracts its own links to stars. Up to `local_links` stars are then joined in one task, whose
    memory that number bounds; more take rounds of large-star and small-star, each written to the shared folder, until
    nothing changes. Self links are left out; an empty input gives an empty result.
    """
    a, b = edges.columns
    edges = edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where("u <> v")
    stars = cut(edges.mapInArrow(_contract, "u long, v long"), "stars")
    if (n := stars.count()) <= local_links:
        done = cut(stars.repartition(1).mapInArrow(_contract, "u long, v long"), "stars") if n else stars
    else:
        print_, done = None, stars
        while True:
            both = done.union(done.select(F.col("v").alias("u"), F.col("u").alias("v")))
            low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
            large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
            low = large.groupBy("u").agg(F.min("v").alias("m"))
            small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            new = cut(small.union(low.select("u", F.col("m").alias("v"))).distinct(), "stars")
            seen = new.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
            drop(done)
            done = new
            if tuple(seen) == print_:
                break
            print_ = tuple(seen)
    low = done.groupBy("u").agg(F.min("v").alias("component"))
    roots = low.select(F.col("component").alias("id")).distinct().withColumn("component", F.col("id"))
    return low.select(F.col("u").alias("id"), "component").union(roots)


# --- text as bytes ----------------------------------------------------------------------------------------------------


def chunks(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in slices of about `most` bytes of text; a longer single text is a slice of its own."""
    for b in batches:
        col = b.column(text)
        size = np.frombuffer(col.buffers()[1], dtype=np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64) if len(col) else np.zeros(1, np.int64)
        at = 0
        while at < b.num_rows:
            end = max(at + 1, int(np.searchsorted(size, size[at] + most, side="right")) - 1)
            yield b.slice(at, end - at)
            at = end


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column's slice, and the offsets of each row in them (nulls are empty)."""
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(col.buffers()[1], dtype=np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    data = col.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8)[off[0] : off[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, off - off[0]


_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)  # fixed values: the splitmix64 finaliser


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser on uint64."""
    x = x ^ (x >> np.uint64(30))
    x = x * _MIX1
    x = x ^ (x >> np.uint64(27))
    x = x * _MIX2
    return x ^ (x >> np.uint64(31))


_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


def word_hashes(raw: np.ndarray, off: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words (runs of bytes other than space, \\t, \\n, \\v, \\f and \\r) of all rows, and each row's first word.

    A word's hash is a polynomial in its bytes, modulo 2**64, mixed; `lower` lower-cases A-Z first.
    """
    n = len(raw)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(off), np.int64)
    if lower:
        raw = _LOWER[raw]
    inside = ~_BLANK[raw]
    start = inside.copy()
    start[1:] &= ~inside[:-1]
    edge = off[(off > 0) & (off < n)]
    start[edge] = inside[edge]
    stop = inside.copy()
    stop[:-1] &= ~inside[1:]
    stop[edge - 1] = inside[edge - 1]
    s, e = np.flatnonzero(start), np.flatnonzero(stop) + 1
    first = np.searchsorted(s, off)
    if not len(s):
        return np.zeros(0, np.uint64), first
    # Horner's rule over the words, a byte position at a time: all words at once, the long ones on their own.
    length = e - s
    h = np.zeros(len(s), np.uint64)
    live = np.arange(len(s))
    at = 0
    data = np.concatenate([raw, np.zeros(1, np.uint8)])
    while len(live) > 256 or (len(live) and at < 64):
        h[live] = h[live] * _BASE + (data[s[live] + at].astype(np.uint64) + np.uint64(1))
        at += 1
        live = live[length[live] > at]
    for i in live.tolist():
        x = int(h[i])
        for c in data[s[i] + at : e[i]].tolist():
            x = (x * int(_BASE) + c + 1) & 0xFFFFFFFFFFFFFFFF
        h[i] = np.uint64(x)
    return mix(h + length.astype(np.uint64)), first


def window_hashes(h: np.ndarray, width: int, seed: int = 0) -> np.ndarray:
    """Hash of each run of `width` consecutive values (len(h) - width + 1 of them; none if there are fewer)."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    m = np.uint64((0xD6E8FEB86659FD93 + 2 * seed * 0x2545F4914F6CDD1D | 1) & 0xFFFFFFFFFFFFFFFF)
    out = np.zeros(n, np.uint64)
    for k in range(width):
        out = out * m + h[k : k + n]
    return mix(out)


def starts_within(first: np.ndarray, width: int, n_words: int) -> np.ndarray:
    """For each word: whether `width` words of its row start there. `first` has each row's first word, and the end."""
    row_end = np.repeat(first[1:], np.diff(first))
    return np.arange(n_words) + width <= row_end


WORD = re.compile(r"[^\x20\x09-\x0D]+")
