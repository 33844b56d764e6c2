"""Best-fit packing of tokenised documents, certified by dual-feasible-function bounds and repaired by exchange rounds."""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, cut, n_partitions

#: Pieces that a task packs at once, on average.
GROUP_PIECES = 25_000
#: Words that a worker remembers the ids of; the older half goes when it is full.
REMEMBERED = 250_000


def tokenizer_files() -> tuple[str, str]:
    """The byte-level BPE of the packing contract: its `tokenizers` file, and the same vocabulary as ranks."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


class Encoder:
    """Ids of texts under a byte-level BPE file of `tokenizers`, as little-endian unsigned 32-bit bytes.

    A blank between two characters that aren't white space always starts a new word of that tokenizer, and a line end
    between two such characters is one. So texts are split there and the words' ids remembered; a text with white space
    in any other form is encoded as a whole. Words not yet seen are encoded from `ranks`, the same vocabulary, when the
    caller has it (the result is the same, several times as fast).
    """

    def __init__(self, path: str, ranks: str | None = None) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.core = None
        if ranks:
            import public_tokenizers
            import tiktoken

            with open(ranks, "rb") as f:
                known = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.core = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=known, special_tokens={})
        self.young: dict[str, bytes | None] = {}
        self.old: dict[str, bytes | None] = {}

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32).tobytes()

    def word(self, key: str) -> bytes | None:
        """Ids of a word after a blank or, where it starts with one, a line end. None: the rule above doesn't hold."""
        if key in self.old:
            got = self.old[key]
        elif not key or key[-1].isspace() or (key[0].isspace() and (key[0] != "\n" or len(key) < 2 or key[1].isspace())):
            got = None
        else:
            piece = key if key[0] == "\n" else " " + key
            got = np.array(self.core.encode_ordinary(piece), np.uint32).tobytes() if self.core else self.whole(piece)
        if len(self.young) >= REMEMBERED:
            self.old, self.young = self.young, {}
        self.young[key] = got
        return got

    def __call__(self, text: str) -> bytes:
        if not text:
            return b""
        if any(x in text for x in self.special):
            return self.whole(text)
        words = text.replace("\n", " \n").split(" ")
        first, words = words[0], words[1:]
        if not first or first[0].isspace() or first[-1].isspace():
            return self.whole(text)
        got = list(map(self.young.get, words))
        if None in got:
            for i, x in enumerate(got):
                if x is None and (x := self.word(words[i])) is None:
                    return self.whole(text)
                got[i] = x
        head = np.array(self.core.encode_ordinary(first), np.uint32).tobytes() if self.core else self.whole(first)
        return head + b"".join(got)


_encoders: dict[tuple, Encoder] = {}


def encoder(path: str, ranks: str | None) -> Encoder:
    """One a worker and file: what it remembers serves later tasks too."""
    if (path, ranks) not in _encoders:
        _encoders[path, ranks] = Encoder(path, ranks)
    return _encoders[path, ranks]


def _cut_up(size: int, path: str, ranks: str | None, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path, ranks)
        tail = np.array([end], np.uint32).tobytes()
        for b in chunks(batches):
            rows = []
            for doc, copy, text in zip(*(b.column(c).to_pylist() for c in ("doc_id", "copy", "text")), strict=True):
                ids = encode(text or "") + tail
                n = len(ids) // 4
                first = n % size or size
                starts = [0, *range(first, n, size)]
                for k, (s, e) in enumerate(zip(starts, [*starts[1:], n], strict=True)):
                    rows.append((doc, copy, k, s, e - s, zlib.crc32(ids[4 * s : 4 * e])))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["doc_id", "copy", "piece", "start", "length", "ids_crc32"])

    return run


def lower_bound(lengths: np.ndarray, size: int) -> int:
    """Fewest bins that the lengths can need, by dual-feasible functions.

    The functions are the identity and, for each threshold t up to half a bin, the one that counts an item over size - t
    as a whole bin, one under t as nothing, and others by their length; then the one that rounds x * k / size down to
    multiples of 1 / (k - 1)-like steps for small k. Any packing needs at least the largest of the sums.
    """
    if not len(lengths):
        return 0
    count = np.bincount(lengths, minlength=size + 1).astype(np.int64)
    weight = count * np.arange(size + 1)
    n_above, w_upto = np.cumsum(count[::-1])[::-1], np.cumsum(weight)
    best = -(-int(weight.sum()) // size)
    for t in range(1, size // 2 + 1):
        over = int(n_above[size - t + 1])
        middle = int(w_upto[size - t] - w_upto[t - 1])
        best = max(best, over + -(-middle // size))
    x = np.arange(size + 1)
    for k in range(1, 21):  # u_k: x where (k + 1) x is a whole number of bins, else floor((k + 1) x) / k
        whole = (k + 1) * x % size == 0
        value = int((count * np.where(whole, k * x, (k + 1) * x // size * size)).sum())
        best = max(best, -(-value // (k * size)))
    return best


def best_fit_decreasing(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin of each item, offset in it, free room of each bin): longest first, each in the fullest bin that still takes it."""
    order = np.argsort(-lengths, kind="stable")
    bins, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    room: list[list[int]] = [[] for _ in range(size + 1)]  # bins by free room
    mask = 0  # bit r: some bin has r free
    free: list[int] = []
    for i, n in zip(order.tolist(), lengths[order].tolist(), strict=True):
        high = mask >> n
        if high:
            r = n + (high & -high).bit_length() - 1
            k = room[r].pop()
            if not room[r]:
                mask &= ~(1 << r)
        else:
            k, r = len(free), size
            free.append(size)
        bins[i], offset[i] = k, size - r
        free[k] = r - n
        room[r - n].append(k)
        mask |= 1 << (r - n)
    return bins, offset, np.array(free, np.int64)


def _packed(size: int, round_: int):
    """Packs each group (rows come sorted by group). Bins of a group that meets its bound, and full ones, are closed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, kept = None, []
        for b in batches:
            g = b.column("grp").to_numpy()
            cuts = np.flatnonzero(g[1:] != g[:-1]) + 1
            for a, e in zip([0, *cuts.tolist()], [*cuts.tolist(), len(g)], strict=True):
                if a == e:
                    continue
                if g[a] != now:
                    yield from pack(now, kept)
                    now, kept = int(g[a]), []
                kept.append(b.slice(a, e - a))
        yield from pack(now, kept)

    def pack(group: int | None, parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not parts:
            return
        t = pa.Table.from_batches(parts).combine_chunks()
        n = t.column("length").to_numpy()
        bins, offset, free = best_fit_decreasing(n, size)
        bound = lower_bound(n, size)
        open_ = (free > 0) if len(free) > bound else np.zeros(len(free), bool)
        cols = [t.column(c).combine_chunks() for c in ("doc_id", "copy", "piece", "start", "length", "ids_crc32")]
        cols += [pa.array(bins + (group << 24) + (round_ << 56)), pa.array(offset), pa.array(open_[bins]), pa.array(np.full(len(n), len(free) - bound, np.int64))]
        yield from pa.Table.from_arrays(cols, names=["doc_id", "copy", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "open", "gap"]).to_batches()

    return run


def pack(
    docs: DataFrame, size: int = 2048, tokenizer: str | None = None, ranks: str | None = None, end: int = 0, group: int = GROUP_PIECES, rounds: int = 4
) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) for each piece of each row's ids and the closing id `end`.

    Only documents over `size` are cut, the short piece first. A full piece is a sequence of its own. The others are
    dealt in groups of about `group` pieces by hash, packed best-fit decreasing, and held against the group's lower
    bound: a group that meets it is done, others keep their full bins and pass the rest on to the next round, where what
    is left of all groups is dealt anew in fewer groups. After `rounds` rounds, or when one group is left, the last
    packing stands. A null text is empty and so one piece of length 1. Rows that repeat are packed each.
    """
    spark = docs.sparkSession
    if tokenizer is None:
        tokenizer, ranks = tokenizer_files()
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("copy"), "text")
    kind = "doc_id long, copy long, piece int, start long, length long, ids_crc32 long"
    pieces = cut(docs.mapInArrow(_cut_up(size, tokenizer, ranks, end), kind), "pieces")
    full = pieces.where(F.col("length") == size)
    out = [full.select("doc_id", "piece", "start", "length", "ids_crc32", (F.monotonically_increasing_id() + F.lit(1 << 62)).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))]
    todo, left = pieces.where(F.col("length") < size), None
    for k in range(rounds):
        n = todo.count() if left is None else left
        groups = max(1, -(-n // group))
        dealt = todo.withColumn("grp", F.pmod(F.xxhash64("copy", "piece", F.lit(k)), F.lit(groups)))
        dealt = dealt.repartition(min(groups, n_partitions(spark)) if groups < n_partitions(spark) else groups, "grp").sortWithinPartitions("grp")
        got = cut(dealt.mapInArrow(_packed(size, k), f"{kind}, sequence_id long, offset long, open boolean, gap long"), "packed")
        left = got.where("open").count()
        last = groups == 1 or k == rounds - 1 or not left
        out.append((got if last else got.where("not open")).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"))
        if last:
            break
        todo = got.where("open").drop("sequence_id", "offset", "open", "gap")
    whole = out[0]
    for x in out[1:]:
        whole = whole.union(x)
    return whole
