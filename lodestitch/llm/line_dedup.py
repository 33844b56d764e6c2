"""Line dedup: exact reference counts of lines, and sharded cuckoo filters of the frequent ones in front of them."""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, cut, mix, n_partitions

EDGE = " \t\n\x0b\x0c\r"
_UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: Keys that one cuckoo filter holds on average.
SHARD_KEYS = 50_000
#: Tasks that lookups are dealt to, for each shuffle partition.
TASKS = 2


class CuckooFilter:
    """A cuckoo filter of 64-bit keys: buckets of four 16-bit fingerprints, either bucket of a key found from the other.

    Keys that find no place are kept whole in a stash, so no insertion is ever lost.
    """

    def __init__(self, capacity: int) -> None:
        self.slots = np.zeros((1 << max(3, (max(1, capacity) // 3).bit_length()), 4), np.uint16)
        self.stash: Counter[int] = Counter()

    @staticmethod
    def prints(keys: np.ndarray) -> np.ndarray:
        return ((mix(keys) >> np.uint64(40)) & np.uint64(0xFFFF)).astype(np.uint16) | np.uint16(1)

    def places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        last = np.uint64(len(self.slots) - 1)
        p = self.prints(keys)
        one = keys & last
        return p, one.astype(np.int64), (one ^ (mix(p.astype(np.uint64)) & last)).astype(np.int64)

    def other(self, place: int, p: int) -> int:
        return int(np.uint64(place) ^ (mix(np.array([p], np.uint64))[0] & np.uint64(len(self.slots) - 1)))

    def insert(self, key: int) -> None:
        p, a, b = (x[0] for x in self.places(np.array([key], np.uint64)))
        for at in (a, b):
            free = np.flatnonzero(self.slots[at] == 0)
            if len(free):
                self.slots[at, free[0]] = p
                return
        at, p, moved = int(a), int(p), []
        for k in range(200):
            slot = (at + k) % 4
            moved.append((at, slot, int(self.slots[at, slot])))
            self.slots[at, slot], p = p, int(self.slots[at, slot])
            at = self.other(at, p)
            free = np.flatnonzero(self.slots[at] == 0)
            if len(free):
                self.slots[at, free[0]] = p
                return
        for at, slot, was in reversed(moved):
            self.slots[at, slot] = was
        self.stash[int(key)] += 1

    def delete(self, key: int) -> bool:
        """Take out one copy of a key that was inserted."""
        if int(key) in self.stash:
            self.stash[int(key)] -= 1
            self.stash = +self.stash
            return True
        p, a, b = (x[0] for x in self.places(np.array([key], np.uint64)))
        for at in (a, b):
            held = np.flatnonzero(self.slots[at] == p)
            if len(held):
                self.slots[at, held[0]] = 0
                return True
        return False

    def contains(self, keys: np.ndarray) -> np.ndarray:
        p, a, b = self.places(keys)
        found = (self.slots[a] == p[:, None]).any(1) | (self.slots[b] == p[:, None]).any(1)
        return found | np.isin(keys, np.array(list(self.stash), np.uint64)) if self.stash else found

    def to_bytes(self) -> bytes:
        stash = np.array(sorted(self.stash.elements()), np.uint64)
        return np.array([len(self.slots), len(stash)], np.int64).tobytes() + self.slots.tobytes() + stash.tobytes()

    @classmethod
    def from_bytes(cls, x: bytes) -> CuckooFilter:
        n, _ = np.frombuffer(x, np.int64, 2)
        out = cls.__new__(cls)
        out.slots = np.frombuffer(x, np.uint16, n * 4, 16).reshape(n, 4).copy()
        out.stash = Counter(np.frombuffer(x, np.uint64, -1, 16 + n * 8).tolist())
        return out


def line_keys(text: str | None) -> list[bytes | None]:
    """A 16-byte digest of each line's key; None for a line whose key is empty."""
    out = []
    for line in (text or "").split("\n"):
        key = line.strip(EDGE).translate(_UPPER)
        out.append(hashlib.blake2b(key.encode("utf-8", "surrogatepass"), digest_size=16).digest() if key else None)
    return out


def _keys(positions: bool):
    """(hi, lo[, doc, h, line]): the keys of each document once, or of all its lines with their places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches):
            raw: list[bytes] = []
            at, place = [], []
            for i, text in enumerate(b.column("text").to_pylist()):
                keys = line_keys(text)
                if positions:
                    for k, x in enumerate(keys):
                        if x is not None:
                            raw.append(x)
                            at.append(i)
                            place.append(k)
                else:
                    raw += {x for x in keys if x is not None}
            pair = np.frombuffer(b"".join(raw), dtype=np.int64).reshape(-1, 2)
            cols, names = [pa.array(pair[:, 0]), pa.array(pair[:, 1])], ["hi", "lo"]
            if positions:
                at_ = pa.array(at, pa.int64())
                cols += [b.column("doc").take(at_), b.column("h").take(at_), pa.array(place, pa.int32())]
                names += ["doc", "h", "line"]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return run


def _texts(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.col(doc_id).cast("long").alias("doc"), F.xxhash64(F.col(text)).alias("h"), F.col(text).alias("text"))


class LineIndex:
    """Reference counts (hi, lo, n_docs) of all line keys, and the cuckoo filters (shard, blob) of those in `min_docs` or more.

    The counts are exact and decide; the filters only spare lookups. `insert` and `delete` give a new index; deleting
    the documents that were inserted brings back the counts, and filters that hold the same keys. Filters are changed in
    place as long as a shard holds between a quarter and twice the keys that it was laid out for on average, else all
    are dealt anew from the counts. Documents count by row.
    """

    def __init__(self, counts: DataFrame, filters: DataFrame, shards: int, min_docs: int) -> None:
        self.counts, self.filters, self.shards, self.min_docs = counts, filters, shards, min_docs

    @staticmethod
    def _count(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
        keys = docs.select(F.col(text).alias("text")).mapInArrow(_keys(False), "hi long, lo long")
        return keys.groupBy("hi", "lo").agg(F.count("*").alias("n_docs"))

    @classmethod
    def build(cls, docs: DataFrame, min_docs: int = 10, doc_id: str = "doc_id", text: str = "text") -> LineIndex:
        return cls._laid_out(cut(cls._count(docs, doc_id, text), "linecounts"), min_docs)

    @classmethod
    def _laid_out(cls, counts: DataFrame, min_docs: int) -> LineIndex:
        hot = counts.where(F.col("n_docs") >= min_docs)
        n = hot.count()
        shards = max(1, -(-n // SHARD_KEYS))
        filters = cls._apply(counts.sparkSession, None, hot.select("hi", "lo", F.lit(1).alias("sign")), shards, -(-n // shards))
        return cls(counts, filters, shards, min_docs)

    @staticmethod
    def _apply(spark, filters: DataFrame | None, changes: DataFrame, shards: int, keys: int) -> DataFrame:
        """The filters after the changes (hi, lo, sign); each shard is one group, laid out for twice `keys` keys."""
        rows = changes.select(F.pmod("hi", F.lit(shards)).alias("shard"), F.lit(1).alias("side"), "lo", "sign", F.lit(None).cast("binary").alias("blob"))
        if filters is not None:
            rows = rows.union(filters.select("shard", F.lit(0), F.lit(None).cast("long"), F.lit(None).cast("int"), "blob"))
        dealt = rows.repartition(n_partitions(spark), "shard").sortWithinPartitions("shard", "side")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, held = None, None
            of = lambda: pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([held.to_bytes()], pa.binary())], names=["shard", "blob"])
            for b in batches:
                for r in b.to_pylist():
                    if r["shard"] != now:
                        if held is not None:
                            yield of()
                        now, held = r["shard"], None
                    if r["side"] == 0:
                        held = CuckooFilter.from_bytes(r["blob"])
                        continue
                    held = held or CuckooFilter(2 * keys)
                    key = r["lo"] & 0xFFFFFFFFFFFFFFFF
                    held.insert(key) if r["sign"] > 0 else held.delete(key)
            if held is not None:
                yield of()

        return cut(dealt.mapInArrow(run, "shard long, blob binary"), "filters")

    def _changed(self, docs: DataFrame, sign: int, doc_id: str, text: str) -> LineIndex:
        delta = self._count(docs, doc_id, text)
        old, new = F.coalesce(self.counts["n_docs"], F.lit(0)), F.coalesce(delta["n_docs"], F.lit(0)) * sign
        both = self.counts.join(delta, ["hi", "lo"], "full").select("hi", "lo", old.alias("was"), F.greatest(old + new, F.lit(0)).alias("n_docs"))
        both = cut(both, "linecounts")
        least = self.min_docs
        counts = both.where("n_docs > 0").select("hi", "lo", "n_docs")
        is_hot, was_hot = F.col("n_docs") >= least, F.col("was") >= least
        n, old_n = both.agg(F.count_if(is_hot), F.count_if(was_hot)).first()
        shards = max(1, -(-n // SHARD_KEYS))
        if not old_n or n > 2 * old_n or not self.shards / 2 <= shards <= 2 * self.shards:
            return self._laid_out(counts, least)
        step = both.select("hi", "lo", (is_hot.cast("int") - was_hot.cast("int")).alias("sign")).where("sign <> 0")
        return LineIndex(counts, self._apply(docs.sparkSession, self.filters, step, self.shards, -(-n // self.shards)), self.shards, least)

    def insert(self, docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> LineIndex:
        return self._changed(docs, 1, doc_id, text)

    def delete(self, docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> LineIndex:
        return self._changed(docs, -1, doc_id, text)

    def dropped(self, docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
        """(doc, h, lines): the places of the lines to drop. The filters pass candidates, the counts confirm them."""
        # as many (shard, salt) keys as there are tasks: more partitions make more salts, so no shard's lookups pile up
        tasks = TASKS * n_partitions(docs.sparkSession)
        salts = max(1, -(-tasks // self.shards))
        seen = _texts(docs, doc_id, text).mapInArrow(_keys(True), "hi long, lo long, doc long, h long, line int")
        shard = F.pmod("hi", F.lit(self.shards)).alias("shard")
        salt = F.pmod(F.xxhash64("doc", "line"), F.lit(salts)).cast("int").alias("salt")
        none = F.lit(None)
        asked = seen.select(shard, salt, F.lit(1).alias("side"), "hi", "lo", "doc", "h", "line", none.cast("binary").alias("blob"))
        copies = self.filters.select("shard", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), F.lit(0).alias("side"), none.cast("long").alias("hi"), none.cast("long").alias("lo"), none.cast("long").alias("doc"), none.cast("long").alias("h"), none.cast("int").alias("line"), "blob")
        rows = copies.union(asked).repartition(n_partitions(docs.sparkSession), "shard", "salt").sortWithinPartitions("shard", "salt", "side")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, held = None, None
            for b in batches:
                shards, sides = b.column("shard").to_numpy(), b.column("side").to_numpy()
                salts = b.column("salt").to_numpy()
                bounds = np.flatnonzero((shards[1:] != shards[:-1]) | (salts[1:] != salts[:-1]) | (sides[1:] != sides[:-1])) + 1
                for a, e in zip([0, *bounds.tolist()], [*bounds.tolist(), len(sides)], strict=True):
                    if a == e:
                        continue
                    if (key := (int(shards[a]), int(salts[a]))) != now:
                        now, held = key, None
                    if sides[a] == 0:
                        held = CuckooFilter.from_bytes(b.column("blob")[a].as_py())
                    elif held is not None:
                        part = b.slice(a, e - a)
                        hit = held.contains(part.column("lo").to_numpy().view(np.uint64))
                        part = part.filter(pa.array(hit))
                        yield pa.RecordBatch.from_arrays([part.column(c) for c in ("hi", "lo", "doc", "h", "line")], names=["hi", "lo", "doc", "h", "line"])

        hits = rows.mapInArrow(run, "hi long, lo long, doc long, h long, line int")
        sure = hits.join(self.counts.where(F.col("n_docs") >= self.min_docs).select("hi", "lo"), ["hi", "lo"])
        return sure.groupBy("doc", "h").agg(F.collect_set("line").alias("lines"))


def _kept(digests: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches):
            out: list[tuple] = []
            for text, lines in zip(b.column("text").to_pylist(), b.column("lines").to_pylist(), strict=True):
                all_ = (text or "").split("\n")
                gone = set(lines or ())
                kept = "\n".join(x for i, x in enumerate(all_) if i not in gone) if gone else text
                out.append((len(all_), len(gone), hashlib.sha256((kept or "").encode("utf-8", "surrogatepass")).hexdigest() if digests else kept))
            n, gone, what = zip(*out, strict=True) if out else ((), (), ())
            cols = [b.column("row"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(what, pa.string())]
            yield pa.RecordBatch.from_arrays(cols, names=["row", "n_lines", "n_dropped", "result"])

    return run


def _worked(docs: DataFrame, index: LineIndex, row, kind: str, digests: bool) -> DataFrame:
    marks = index.dropped(docs).select(F.col("doc").alias("__doc"), F.col("h").alias("__h"), "lines")
    rows = docs.select(row.alias("row"), F.col("doc_id").cast("long").alias("__doc0"), F.xxhash64("text").alias("__h0"), "text")
    both = rows.join(marks, F.col("__doc0").eqNullSafe(F.col("__doc")) & (F.col("__h0") == F.col("__h")), "left")
    return both.select("row", "text", "lines").mapInArrow(_kept(digests), f"row {kind}, n_lines long, n_dropped long, result string")


def digest(docs: DataFrame, min_docs: int = 10) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_sha256) for each row. A null or empty text is one empty line, which always stays."""
    docs = docs.select("doc_id", "text")
    out = _worked(docs, LineIndex.build(docs, min_docs), F.col("doc_id").cast("long"), "long", True)
    return out.select(F.col("row").alias("doc_id"), "n_lines", "n_dropped", F.col("result").alias("kept_sha256"))


def dedup(docs: DataFrame, min_docs: int = 10) -> DataFrame:
    """`docs` without the lines found in `min_docs` documents or more; `n_chars` is counted anew where lines went. No row goes.

    A document that loses all its lines keeps an empty text; a null text stays null. Other columns stay as they are.
    """
    rest = [f for f in docs.schema.fields if f.name != "text"]
    row = F.struct(*(F.col(f"`{f.name}`") for f in rest))
    kind = f"struct<{','.join(f'`{f.name}`:{f.dataType.simpleString()}' for f in rest)}>"
    out = _worked(docs, LineIndex.build(docs, min_docs), row, kind, False)
    new = {c: F.col(f"row.`{c}`") if c != "text" else F.col("result") for c in docs.columns}
    lost = F.col("n_dropped") > 0
    if "n_chars" in new:
        new["n_chars"] = F.when(lost, F.length("result").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars"))
    return out.select(*(x.alias(c) for c, x in new.items()))
