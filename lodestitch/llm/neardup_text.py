"""Near-duplicate documents: chosen-path set similarity join over minwise tokens of word shingles, links confirmed on full sets."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, components, cut, fresh, mix, n_partitions, text_bytes, window_hashes, word_hashes

#: Minwise tokens that paths choose from, the depth at which a tree's nodes are compared, and the share of pairs of the least
#: similarity that all trees together are to bring into one node.
TOKENS, DEPTH, RECALL = 64, 3, 0.9997
#: Sketch slots of two bits, each of a minwise token.
SLOTS = 128
WORDS = SLOTS // 64
#: Members of a node that are compared at once in the second pass; larger nodes go as pairs of blocks of about so many.
BLOCK = 1000
_ODD = np.random.default_rng(11).integers(1, 1 << 63, SLOTS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_XOR = np.random.default_rng(12).integers(1, 1 << 63, SLOTS, dtype=np.uint64)
_M = np.uint64(0xC2B2AE3D27D4EB4F)


def shingle_sets(raw: np.ndarray, off: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The rows' sets of shingle hashes, one after the other and sorted, and where each starts (with the end)."""
    h, first = word_hashes(raw, off, lower=True)
    rows = len(off) - 1
    words = np.diff(first)
    row = np.repeat(np.arange(rows), words)
    w = window_hashes(h, width)
    at = np.flatnonzero(row[: len(w)] == row[width - 1 :]) if len(w) else np.zeros(0, np.int64)
    value, who = w[at], row[at]
    few = np.flatnonzero((words > 0) & (words < width))
    if len(few):
        alone = [window_hashes(h[first[i] : first[i] + words[i]], int(words[i]), seed=int(words[i]) + 1)[0] for i in few.tolist()]
        value, who = np.concatenate([value, np.array(alone, np.uint64)]), np.concatenate([who, few])
    order = np.lexsort((value, who))
    value, who = value[order], who[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (who[1:] != who[:-1])
    value, who = value[new], who[new]
    return value, np.searchsorted(who, np.arange(rows + 1))


def minwise(value: np.ndarray, start: np.ndarray) -> np.ndarray:
    """sets x SLOTS minwise values; every set has a member."""
    out = np.empty((len(start) - 1, SLOTS), np.uint64)
    for k in range(SLOTS):
        out[:, k] = np.minimum.reduceat((value ^ _XOR[k]) * _ODD[k], start[:-1])
    return out


def trees_for(similarity: float, recall: float = RECALL, depth: int = DEPTH) -> int:
    """Independent trees that bring a pair of that similarity into one node with probability `recall`.

    A pair survives a root's coordinate with its similarity, and each further level if any of the about Poisson(1)
    children that it shares does.
    """
    alive = 1.0
    for _ in range(depth - 1):
        alive = 1 - math.exp(-alive)
    return math.ceil(math.log(1 - recall) / math.log(1 - similarity * alive))


def paths(tokens: np.ndarray, similarity: float, trees: int, depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray]:
    """(set, node) for the nodes at `depth` that each set is dealt to.

    A node chooses each of the coordinates with probability 1 / (similarity * TOKENS) by a hash of its own name, and a
    set goes on to the child named by the node, the coordinate and the set's minwise token there. So two sets of that
    similarity share one child of a shared node on average. The roots take one or two coordinates, in turn.
    """
    n = len(tokens)
    limit = np.uint64(int((1 << 64) / (similarity * TOKENS)))
    turn = np.random.default_rng(23).permutation(TOKENS)
    who, node, at = [], [], 0
    for t in range(trees):
        for _ in range(2 if t % 6 == 5 else 1):
            c = int(turn[at % TOKENS])
            at += 1
            who.append(np.arange(n))
            node.append(mix(mix(tokens[:, c] + np.uint64(c)) + np.uint64((t + 1) * int(_M) & 0xFFFFFFFFFFFFFFFF)))
    who, node = np.concatenate(who), np.concatenate(node)
    salt = mix(np.arange(1, TOKENS + 1, dtype=np.uint64))
    for _ in range(depth - 1):
        w, c = [], []
        for a in range(0, len(node), 50_000):
            i, j = np.nonzero(mix(node[a : a + 50_000, None] ^ salt) < limit)
            w.append(i + a)
            c.append(j)
        i, j = np.concatenate(w) if w else np.zeros(0, np.int64), np.concatenate(c) if c else np.zeros(0, np.int64)
        who, node = who[i], mix(mix(tokens[who[i], j] + j.astype(np.uint64)) + node[i] * _M)
    return who, node


def _described(width: int, similarity: float, trees: int):
    """(doc, h, n, print, sketch, nodes): size and fingerprint of each row's set, its sketch, and its nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches):
            value, start = shingle_sets(*text_bytes(b.column("text")), width)
            n = np.diff(start)
            full = np.flatnonzero(n)
            prints: list[bytes | None] = [None] * len(n)
            for i in full.tolist():
                prints[i] = hashlib.blake2b(value[start[i] : start[i + 1]].tobytes(), digest_size=16).digest()
            sketch: list[bytes | None] = [None] * len(n)
            nodes: list = [None] * len(n)
            if len(full):
                tokens = minwise(value, np.append(start[full], len(value)))
                bits = mix(tokens)
                rows = np.concatenate([np.packbits((bits >> np.uint64(k)).astype(np.uint8) & 1, axis=1) for k in range(2)], axis=1)
                for i, x in zip(full.tolist(), rows, strict=True):
                    sketch[i] = x.tobytes()
                who, node = paths(tokens[:, :TOKENS], similarity, trees)
                order = np.argsort(who, kind="stable")
                node = node[order].view(np.int64)
                bound = np.searchsorted(who[order], np.arange(len(full) + 1))
                for i, a, e in zip(full.tolist(), bound[:-1].tolist(), bound[1:].tolist(), strict=True):
                    nodes[i] = np.unique(node[a:e])
            cols = [b.column("doc"), b.column("h"), pa.array(n.astype(np.int64)), pa.array(prints, pa.binary()), pa.array(sketch, pa.binary()), pa.array(nodes, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(cols, names=["doc", "h", "n", "print", "sketch", "nodes"])

    return run


def _sketches(col: np.ndarray) -> np.ndarray:
    """rows x 2 x WORDS, of a column of sketches."""
    return np.frombuffer(b"".join(col.tolist()), np.uint64).reshape(-1, 2, WORDS)


def least_agreement(percent: int) -> int:
    """How many sketch slots agree at least for a pair to be confirmed: 4.5 standard deviations under those expected at
    `percent` % similarity, which about 1 such pair in 100,000 misses. Slots of different tokens agree by chance in 1 of 4."""
    p = 0.25 + 0.75 * percent / 100
    return max(0, math.floor(SLOTS * p - 4.5 * math.sqrt(SLOTS * p * (1 - p))))


def _close(n: np.ndarray, sketch: np.ndarray, i: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
    """Whether pairs of rows can be similar, by size and sketch."""
    low, high = np.minimum(n[i], n[j]), np.maximum(n[i], n[j])
    ok = np.flatnonzero(100 * low >= percent * high)
    out = np.zeros(len(i), bool)
    agree = least_agreement(percent)
    for at in range(0, len(ok), 500_000):
        k = ok[at : at + 500_000]
        differ = sketch[i[k]] ^ sketch[j[k]]
        out[k] = SLOTS - np.bitwise_count(differ[:, 0] | differ[:, 1]).sum(axis=1) >= agree
    return out


def _groups(batches: Iterator[pa.RecordBatch], names: tuple[str, ...]) -> Iterator[tuple[np.ndarray, ...]]:
    """Whole runs of nodes: tuples of columns, sorted by node as the rows come; no node is split."""
    rest: list[tuple[np.ndarray, ...]] = []
    for b in batches:
        cols = tuple(b.column(c).to_numpy(zero_copy_only=False) for c in names)
        if not len(cols[0]):
            continue
        rest.append(cols)
        last = np.searchsorted(cols[0], cols[0][-1])
        if last:
            whole = tuple(np.concatenate(x) for x in zip(*rest, strict=True))
            end = len(whole[0]) - (len(cols[0]) - last)
            yield tuple(x[:end] for x in whole)
            rest = [tuple(x[end:] for x in whole)]
    if rest:
        yield tuple(np.concatenate(x) for x in zip(*rest, strict=True))


def _first_links(percent: int):
    """Pairs to confirm first, and members that are left for the second pass.

    Rows come sorted by node and doc. In a node each member is paired with the node's first member, and with the one
    before it, where size and sketch allow. Members of nodes of three and more go on as rows (node, doc, null).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for node, doc, n, sketch in _groups(batches, ("node", "doc", "n", "sketch")):
            sketch = _sketches(sketch)
            first = np.flatnonzero(np.append(True, node[1:] != node[:-1]))
            size = np.diff(np.append(first, len(node)))
            head = np.repeat(first, size)
            i = np.arange(len(node))
            j = np.concatenate([head, np.maximum(i - 1, head)])
            i = np.concatenate([i, i])
            on = i != j
            i, j = i[on], j[on]
            on = _close(n, sketch, i, j, percent)
            pairs = np.unique(np.stack([doc[j[on]], doc[i[on]]], axis=1), axis=0)
            more = np.repeat(size > 2, size)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([pairs[:, 0], doc[more]])),
                    pa.array(np.concatenate([pairs[:, 1], np.zeros(more.sum(), np.int64)])),
                    pa.array(np.concatenate([np.zeros(len(pairs), np.int64), node[more]])),
                    pa.array(np.concatenate([np.ones(len(pairs), bool), np.zeros(more.sum(), bool)])),
                ],
                names=["a", "b", "node", "pair"],
            )

    return run


def _assigned(node: int, n, sketch, comp, nodes, i: np.ndarray, j: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Those of the pairs of a node's members that are of different components, that size and sketch allow, and whose
    smallest shared node this is: each pair is told by one node."""
    on = comp[i] != comp[j]
    i, j = i[on], j[on]
    on = _close(n, sketch, i, j, percent)
    i, j = i[on], j[on]
    if not len(i):
        return i, j
    used, at = np.unique(np.concatenate([i, j]), return_inverse=True)
    size = np.array([len(nodes[k]) for k in used.tolist()])
    every = np.concatenate([nodes[k] for k in used.tolist()])
    who = np.repeat(np.arange(len(used)), size)[every < node]
    _, column, count = np.unique(every[every < node], return_inverse=True, return_counts=True)
    dense = np.cumsum(count > 1) - 1  # smaller nodes of two members and more
    on = count[column] > 1
    holds = np.zeros((len(used), int((count > 1).sum())), np.float32)
    holds[who[on], dense[column[on]]] = 1
    on = (holds @ holds.T)[at[: len(i)], at[len(i) :]] == 0
    return i[on], j[on]


def _cross_members(percent: int):
    """The members of nodes' block pairs that have a pair to compare there; rows come sorted by node, block pair and side."""
    names = ("node", "bi", "bj", "side", "doc", "n", "sketch", "component", "nodes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for node, bi, bj, side, doc, n, blob, comp, nodes in _groups(batches, names):
            sketch = _sketches(blob)
            first = np.flatnonzero(np.append(True, (node[1:] != node[:-1]) | (bi[1:] != bi[:-1]) | (bj[1:] != bj[:-1])))
            for a, e in zip(first.tolist(), [*first[1:].tolist(), len(node)], strict=True):
                used = np.zeros(e - a, bool)
                left = np.arange(a, e) if bi[a] == bj[a] else np.arange(a, e)[side[a:e] == 0]
                right = left if bi[a] == bj[a] else np.arange(a, e)[side[a:e] == 1]
                for x in range(0, len(left), 1024):
                    for y in range(x if left is right else 0, len(right), 1024):
                        i, j = (z.ravel() for z in np.meshgrid(left[x : x + 1024], right[y : y + 1024], indexing="ij"))
                        if left is right:
                            on = i < j
                            i, j = i[on], j[on]
                        i, j = _assigned(int(node[a]), n, sketch, comp, nodes, i, j, percent)
                        used[i - a] = used[j - a] = True
                m = np.flatnonzero(used) + a
                if len(m):
                    cols = [pa.array(z) for z in (node[m], bi[m], bj[m], side[m], doc[m], n[m], blob[m], comp[m])]
                    yield pa.RecordBatch.from_arrays([*cols, pa.array([nodes[k] for k in m.tolist()], pa.list_(pa.int64()))], names=list(names))

    return run


def _cross_confirmed(width: int, percent: int):
    """Links between members of different components, compared on full sets inside each node's block pairs.

    Rows come sorted by node, block pair and side. Once links have joined two components in the task, their other pairs
    are left: they change nothing.
    """

    def compare(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(parts).combine_chunks()
        of = lambda c: t.column(c).combine_chunks().to_numpy(zero_copy_only=False)
        node, doc, n, sketch, comp, nodes, side = of("node"), of("doc"), of("n"), _sketches(of("sketch")), of("component"), of("nodes"), of("side")
        text = t.column("text").combine_chunks()
        value, start = shingle_sets(*text_bytes(text), width)
        left = np.flatnonzero(side == 0)
        right = np.flatnonzero(side == 1) if t.column("bi")[0].as_py() != t.column("bj")[0].as_py() else left
        root: dict[int, int] = {}

        def find(x: int) -> int:
            while root.get(x, x) != x:
                root[x] = x = root.get(root[x], root[x])
            return x

        links = []
        for at in range(0, len(left), 512):
            i, j = (x.ravel() for x in np.meshgrid(left[at : at + 512], right, indexing="ij"))
            if right is left:
                on = i < j
                i, j = i[on], j[on]
            for x, y in zip(*(k.tolist() for k in _assigned(int(node[0]), n, sketch, comp, nodes, i, j, percent)), strict=True):
                cx, cy = find(int(comp[x])), find(int(comp[y]))
                if cx != cy and _similar(value[start[x] : start[x + 1]], value[start[y] : start[y + 1]], percent):
                    root[max(cx, cy)] = min(cx, cy)
                    links.append((int(doc[x]), int(doc[y])))
        a, b = zip(*links, strict=True) if links else ((), ())
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, kept = None, []
        for b in batches:
            keys = np.stack([b.column(c).to_numpy().astype(np.int64) for c in ("node", "bi", "bj")], axis=1)
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            for s, e in zip([0, *cuts.tolist()], [*cuts.tolist(), len(keys)], strict=True):
                if s == e:
                    continue
                if (key := tuple(keys[s].tolist())) != now:
                    if kept:
                        yield compare(kept)
                    now, kept = key, []
                kept.append(b.slice(s, e - s))
        if kept:
            yield compare(kept)

    return run


def _similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    if not len(x) or not len(y):
        return False
    at = np.searchsorted(y, x)
    both = int((y[np.minimum(at, len(y) - 1)] == x).sum())
    return both > 0 and 100 * both >= percent * (len(x) + len(y) - both)


def _confirmed(width: int, percent: int):
    """Pairs whose full sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in chunks(iter([whole]), text="text_b", most=1_500_000):
                va, sa = shingle_sets(*text_bytes(b.column("text_a")), width)
                vb, sb = shingle_sets(*text_bytes(b.column("text_b")), width)
                at = pa.array([_similar(va[sa[i] : sa[i + 1]], vb[sb[i] : sb[i + 1]], percent) for i in range(b.num_rows)], pa.bool_())
                yield pa.RecordBatch.from_arrays([b.column("a").filter(at), b.column("b").filter(at)], names=["a", "b"])

    return run


#: Bits of the filter of wanted documents that is sent to the tasks (256 KB, whatever the input).
FILTER_BITS = 1 << 21


def _wanted(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows whose doc is in `ids` (distinct docs): a bitmap of fixed size drops most others before the join."""
    slot = f"pmod(xxhash64(doc, 29), {FILTER_BITS})"
    bitmap = np.zeros(FILTER_BITS // 8 + 8192, np.uint8)
    parts = ids.groupBy(F.expr(f"bitmap_bucket_number({slot})").alias("k")).agg(F.expr(f"bitmap_construct_agg(bitmap_bit_position({slot}))").alias("bits"))
    for r in parts.collect():  # FILTER_BITS / 32768 rows of 4 KB, and one more, at most
        bitmap[r["k"] * 4096 : r["k"] * 4096 + 4096] = np.frombuffer(r["bits"], np.uint8)
    sent = rows.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = sent.value
        for b in batches:
            k = b.column("slot").to_numpy()
            b = b.filter(pa.array((held[k >> 3] >> (k & 7)) & 1 == 1))
            yield b.select(["doc", "h", "text"])

    place = F.expr(f"bitmap_bucket_number({slot}) * 32768 + bitmap_bit_position({slot})")
    return rows.select("doc", "h", "text", place.alias("slot")).mapInArrow(run, "doc long, h long, text string").join(ids, "doc", "left_semi")


def _texts(rows: DataFrame, classes: DataFrame, ids: DataFrame) -> DataFrame:
    """(doc, text) of the ids, one row each: of rows that share a doc_id the one that the class stands for."""
    chosen = classes.select("doc", F.col("h").alias("__h")).join(ids, "doc", "left_semi")
    texts = _wanted(rows, ids).join(chosen, "doc").where(F.col("h") == F.col("__h")).select("doc", "text")
    return cut(texts.dropDuplicates(["doc"]), "texts")


def _confirm(rows: DataFrame, classes: DataFrame, pairs: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) that are links; each document's text comes in by a join."""
    texts = _texts(rows, classes, cut(pairs.select(F.col("a").alias("doc")).union(pairs.select("b")).distinct(), "wanted"))
    both = pairs.join(texts.select(F.col("doc").alias("b"), F.col("text").alias("text_b")), "b")
    both = both.join(texts.select(F.col("doc").alias("a"), F.col("text").alias("text_a")), "a").select("a", "b", "text_a", "text_b")
    return cut(both.mapInArrow(_confirmed(width, percent), "a long, b long"), "links")


def _confirm_across(rows: DataFrame, classes: DataFrame, members: DataFrame, width: int, percent: int) -> DataFrame:
    """The links between components among the members of each node."""
    texts = _texts(rows, classes, cut(members.select("doc").distinct(), "wanted"))
    key = ["node", "bi", "bj"]
    dealt = members.join(texts, "doc").repartition(n_partitions(rows.sparkSession), *key).sortWithinPartitions(*key, "side")
    return cut(dealt.mapInArrow(_cross_confirmed(width, percent), "a long, b long"), "links")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 85, doc_id: str = "doc_id", text: str = "text", block: int = BLOCK, recall: float = RECALL) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each doc_id: components of links of `percent` % similarity or more.

    Sets are the distinct runs of `width` words, A-Z lower-cased; a text of fewer words is one shingle, one without words
    (or null) an empty set that links with nothing. Equal sets form a class and go on as one. Classes are dealt to the
    nodes of as many independent trees as bring the share `recall` of the least similar pairs into a node (see `paths`
    and `trees_for`); a node's members are compared in two passes: first each with the node's
    first and the one before, then, exhaustively, those that the links found leave in different components, in blocks of
    `block` members. So no link is lost to a node's size, and none is needed inside a component. Every link is confirmed on the full sets. Of rows
    that repeat a doc_id one counts; a null doc_id is left out. Other columns are ignored.
    """
    n_parts = n_partitions(docs.sparkSession)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc"), F.xxhash64(F.col(text)).alias("h"), F.col(text).alias("text")).where("doc is not null")
    kind = "doc long, h long, n long, print binary, sketch binary, nodes array<long>"
    described = rows.mapInArrow(_described(width, percent / 100, trees_for(percent / 100, recall)), kind)
    described = cut(described.groupBy("doc").agg(F.min(F.struct("h", "n", "print", "sketch", "nodes")).alias("x")).select("doc", "x.*"), "described")
    classes = described.where("n > 0").groupBy("print").agg(F.min(F.struct("doc", "h", "n", "sketch", "nodes")).alias("x")).select("print", "x.*")
    classes = cut(classes, "classes")
    spread = classes.select(F.explode("nodes").alias("node"), "doc", "n", "sketch")
    first = spread.repartition(n_parts, "node").sortWithinPartitions("node", "doc").mapInArrow(_first_links(percent), "a long, b long, node long, pair boolean")
    first = cut(first, "first")
    links = _confirm(rows, classes, first.where("pair").select("a", "b").distinct(), width, percent)
    comp = cut(components(links), "components")
    members = first.where("not pair").select("node", F.col("a").alias("doc"))
    placed = members.join(comp.withColumnRenamed("id", "doc"), "doc", "left").select("node", "doc", F.coalesce("component", "doc").alias("component"))
    placed = cut(placed, "placed")
    # only nodes whose members lie in several components have pairs left; large ones are dealt as pairs of blocks
    mixed = placed.groupBy("node").agg(F.count("*").alias("m"), F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high")
    mixed = mixed.select("node", F.ceil(F.col("m") / F.lit(block)).cast("int").alias("blocks"))
    again = placed.join(mixed, "node").withColumn("own", F.pmod(F.xxhash64("doc", F.lit(3)), "blocks").cast("int"))
    again = again.join(classes.select("doc", "n", "sketch", "nodes"), "doc").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    again = again.select("node", F.least("own", "other").alias("bi"), F.greatest("own", "other").alias("bj"), F.when(F.col("own") <= F.col("other"), 0).otherwise(1).alias("side"), "doc", "n", "sketch", "component", "nodes")
    key = ["node", "bi", "bj"]
    kind = "node long, bi int, bj int, side int, doc long, n long, sketch binary, component long, nodes array<long>"
    across = cut(again.repartition(n_parts, *key).sortWithinPartitions(*key, "side", "doc").mapInArrow(_cross_members(percent), kind), "across")
    if across.limit(1).count():
        links = links.union(_confirm_across(rows, classes, across, width, percent))
        comp = components(links)
    by_class = classes.select("print", "doc").join(comp.withColumnRenamed("id", "doc"), "doc", "left").select("print", F.coalesce("component", "doc").alias("component"))
    out = described.select("doc", "n", "print").join(by_class, "print", "left")
    out = out.select(F.col("doc").alias(doc_id), F.col("n").alias("n_shingles"), F.coalesce("component", "doc").alias("component_id"))
    return out.withColumn("kept", F.col(doc_id) == F.col("component_id"))


def keep_one(docs: DataFrame, percent: int = 80) -> DataFrame:
    """`docs` without the documents that a near-duplicate (of `percent` % similarity or more) of smaller doc_id stands
    for; rows with a null doc_id stay."""
    name = fresh("gone", docs.columns)
    gone = near_duplicates(docs, percent=percent).where("not kept").select(F.col("doc_id").alias(name))
    return docs.join(gone, F.col("doc_id") == F.col(name), "left_anti")
