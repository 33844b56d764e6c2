"""Substring dedup by recompression: rounds of naming runs and pairs give equal passages equal inner symbols."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, mix, n_partitions, text_bytes, window_hashes, word_hashes

ROUNDS = 4
FAR = 1 << 40
#: Windows that one row of the exchange carries at most, and the bits of a text's hash that tell rows of one doc_id apart.
CARRIED = 32
#: Repeated windows that a task remembers (16 bytes each); forgetting some only sends more rows.
REMEMBERED = 500_000
TEXT_BITS = 26
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _score(length: np.ndarray, name: np.ndarray) -> np.ndarray:
    """Longer symbols first, then by name; the value is the window's key, so it holds 58 bits of the name."""
    return (np.minimum(length, 63).astype(np.uint64) << np.uint64(58)) | (name >> np.uint64(6))


def _offer(best: np.ndarray, score: np.ndarray, low: np.ndarray, high: np.ndarray, width: int) -> None:
    """Offer each symbol to the windows that hold all that its naming depends on: words low to high."""
    fits = high - low <= width
    score, low, high = score[fits], low[fits], high[fits]
    first = np.maximum(high - width, 0)
    for t in range(width):
        on = first + t <= low
        if not on.any():
            break
        at = first[on] + t
        ok = at < len(best)
        np.maximum.at(best, at[ok], score[on][ok])


def window_keys(h: np.ndarray, row: np.ndarray, width: int, rounds: int = ROUNDS) -> np.ndarray:
    """For each run of `width` words the key of a symbol inside it: equal runs of words have equal keys, wherever they stand.

    A round gives each symbol a side by a hash of its name and the round, the same all over the corpus, and renames each
    left symbol followed by a right one as their pair; runs of one word are named too. So a symbol depends on its own
    words and, where it stayed single, on the neighbour that it could have joined: that is its support. A window's key is
    the longest symbol (then the largest name) whose support lies in it; without any, the word of the largest hash. All
    of this follows from the window's words alone.
    """
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    best = np.zeros(n, np.uint64)
    total = len(h)
    # runs of one word, each between two other words of its row
    change = np.ones(total + 1, bool)
    change[1:-1] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    at = np.flatnonzero(change)
    s, e = at[:-1], at[1:]
    long_ = e - s >= 2
    s, e = s[long_], e[long_]
    inner = (s > 0) & (e < total)
    s, e = s[inner], e[inner]
    inner = (row[s - 1] == row[s]) & (row[e] == row[s])
    s, e = s[inner], e[inner]
    _offer(best, _score(e - s, mix(h[s] * _M1 + (e - s).astype(np.uint64) * _M2)), s - 1, e + 1, width)
    # pairs, round by round
    name, s = h.copy(), np.arange(total)
    e = s + 1
    low, high = s.copy(), e.copy()
    for k in range(rounds):
        side = (mix(name + np.uint64((k + 1) * int(_M2) & 0xFFFFFFFFFFFFFFFF)) >> np.uint64(17)).astype(np.uint8) & 1
        m = len(name)
        r = row[s]
        pair = np.zeros(m, bool)
        pair[:-1] = (side[:-1] == 0) & (side[1:] == 1) & (r[1:] == r[:-1]) & (e[1:] - s[:-1] <= width)
        second = np.zeros(m, bool)
        second[1:] = pair[:-1]
        # what a single symbol depends on: the neighbour on the side that it could have joined
        left_low = np.full(m, -FAR)
        left_low[1:] = np.where(r[1:] == r[:-1], low[:-1], -FAR)
        right_high = np.full(m, FAR)
        right_high[:-1] = np.where(r[1:] == r[:-1], high[1:], FAR)
        single = ~pair & ~second
        new_low = np.where(single & (side == 1), np.minimum(low, left_low), low)
        new_high = np.where(single & (side == 0), np.maximum(high, right_high), high)
        i = np.flatnonzero(pair)
        name = name.copy()
        name[i] = mix(name[i] * _M1 + mix(name[i + 1] + _M2))
        e = e.copy()
        e[i] = e[i + 1]
        new_low[i] = np.minimum(low[i], low[i + 1])
        new_high[i] = np.maximum(high[i], high[i + 1])
        _offer(best, _score(e[i] - s[i], name[i]), new_low[i], new_high[i], width)
        keep = ~second
        name, s, e, low, high = name[keep], s[keep], e[keep], new_low[keep], new_high[keep]
    bare = np.flatnonzero(best == 0)
    if len(bare):
        word = np.zeros(len(bare), np.uint64)
        for t in range(width):
            word = np.maximum(word, h[bare + t])
        best[bare] = _score(np.ones(len(bare), np.int64), word)
    return best


def _anchored(width: int):
    """(key, doc, pos, windows): a row for each stretch of windows of one key, with 32 bits of each window's own hash.

    Windows that a smaller doc_id of the same chunk has too are settled at once, and so are those that a chunk before it
    in the task had more than once; they travel as rows without windows, dealt by hash. So of a passage that very many
    documents share, a task sends little more than the first, and its key's rows grow with tasks, not with documents.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, sent = np.zeros(0, np.uint64), np.zeros(0, np.int64)  # windows that repeated in a chunk, and the smallest doc sent
        for b in chunks(batches, most=5_000_000):
            h, first = word_hashes(*text_bytes(b.column("text")))
            n = len(h) - width + 1
            if n <= 0:
                continue
            row = np.repeat(np.arange(b.num_rows), np.diff(first))
            docs, text = b.column("doc").to_numpy(), b.column("h").to_numpy()
            key, own = window_keys(h, row, width), window_hashes(h, width)
            at = np.flatnonzero(row[:n] == row[width - 1 :])
            doc = docs[row[at]]
            order = np.lexsort((doc, own[at]))
            w = own[at][order]
            new = np.ones(len(w), bool)
            new[1:] = w[1:] != w[:-1]
            head = np.flatnonzero(new)
            size = np.diff(np.append(head, len(w)))
            low = doc[order][head]
            if len(common):
                k = np.minimum(np.searchsorted(common, w[head]), len(common) - 1)
                known = common[k] == w[head]
                low[known] = np.minimum(low[known], sent[k[known]])
            often = size > 1
            common, sent = _smallest(np.concatenate([common, w[head][often]]), np.concatenate([sent, low[often]]))
            if len(common) > REMEMBERED:  # the half of the smallest documents, which settle most
                keep = np.sort(np.argpartition(sent, REMEMBERED // 2)[: REMEMBERED // 2])
                common, sent = common[keep], sent[keep]
            least = np.repeat(low, size)
            settled = np.zeros(len(at), bool)
            settled[order] = doc[order] > least
            for part, done in ((at[~settled], False), (at[settled], True)):
                if not len(part):
                    continue
                # a stretch: windows that follow one another in a row, with one key (any key, once settled)
                cut = np.ones(len(part), bool)
                cut[1:] = (part[1:] != part[:-1] + 1) | (row[part[1:]] != row[part[:-1]])
                if not done:
                    cut[1:] |= key[part[1:]] != key[part[:-1]]
                begin = np.flatnonzero(cut)
                size = np.diff(np.append(begin, len(part)))
                # stretches of over CARRIED windows go as several
                times = -(-size // CARRIED)
                begin = np.repeat(begin, times) + CARRIED * (np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times))
                size = np.diff(np.append(begin, len(part)))
                head = part[begin]
                r = row[head]
                pos = ((head - first[r]).astype(np.int64) << 32) | (text[r] << 6) | size
                if done:
                    k = mix(head.astype(np.uint64) + docs[r].astype(np.uint64)).view(np.int64)
                    blob = pa.array([None] * len(head), pa.binary())
                else:
                    k = key[head].view(np.int64)
                    low = (own[part] & np.uint64(0xFFFFFFFF)).astype(np.uint32)
                    off = np.append(begin, len(part)).astype(np.int32) * 4
                    blob = pa.BinaryArray.from_buffers(pa.binary(), len(head), [None, pa.py_buffer(off.tobytes()), pa.py_buffer(low.tobytes())])
                yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(docs[r]), pa.array(pos), blob], names=["key", "doc", "pos", "windows"])

    return run


def _smallest(windows: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different windows in order, and the smallest doc of each."""
    order = np.lexsort((docs, windows))
    windows, docs = windows[order], docs[order]
    new = np.ones(len(windows), bool)
    new[1:] = windows[1:] != windows[:-1]
    return windows[new], docs[new]


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, h, start, mask): windows that a smaller doc_id has too. Rows come sorted by key and doc.

    Only the windows of the key at the end of a batch are remembered for the next, 12 bytes for each different one.
    """
    carried_key, seen, first = None, np.zeros(0, np.uint32), np.zeros(0, np.int64)
    for b in batches:
        if not b.num_rows:
            continue
        key, doc, pos = (b.column(c).to_numpy() for c in ("key", "doc", "pos"))
        size = (pos & 63).astype(np.int64)
        blank = ~np.asarray(b.column("windows").is_valid())
        mask = np.where(blank, (np.int64(1) << size) - 1, 0)
        live = np.flatnonzero(~blank)
        if len(live):
            n = size[live]
            col = b.column("windows").drop_null()
            off = np.frombuffer(col.buffers()[1], np.int32)[col.offset : col.offset + len(col) + 1]
            w = np.frombuffer(col.buffers()[2], np.uint8)[off[0] : off[-1]].view(np.uint32) if col.buffers()[2] is not None else np.zeros(0, np.uint32)
            who = np.repeat(live, n)
            place = np.arange(len(w)) - np.repeat(np.cumsum(n) - n, n)
            full = mix(key[who].view(np.uint64) + w.astype(np.uint64) * _M1)
            order = np.lexsort((doc[who], full))
            f = full[order]
            new = np.ones(len(f), bool)
            new[1:] = f[1:] != f[:-1]
            least = np.empty(len(w), np.int64)
            least[order] = np.repeat(doc[who][order][new], np.diff(np.append(np.flatnonzero(new), len(f))))
            if carried_key is not None and key[live[0]] == carried_key:
                mine = np.flatnonzero(key[who] == carried_key)
                at = np.minimum(np.searchsorted(seen, w[mine]), len(seen) - 1)
                known = seen[at] == w[mine]
                least[mine[known]] = np.minimum(least[mine[known]], first[at[known]])
            gone = doc[who] > least
            np.bitwise_or.at(mask, who[gone], np.int64(1) << place[gone])
            if key[live[-1]] != carried_key:
                carried_key, seen, first = key[live[-1]], np.zeros(0, np.uint32), np.zeros(0, np.int64)
            tail = np.flatnonzero(key[who] == carried_key)
            seen, first = _smallest(np.concatenate([seen, w[tail]]), np.concatenate([first, least[tail]]))
        on = mask != 0
        p = pos[on]
        yield pa.RecordBatch.from_arrays(
            [pa.array(doc[on]), pa.array((p >> 6) & ((1 << TEXT_BITS) - 1)), pa.array((p >> 32).astype(np.int32)), pa.array(mask[on])], names=["doc", "h", "start", "mask"]
        )


def _applied(width: int, digests: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches):
            out = []
            for text, starts, masks in zip(b.column("text").to_pylist(), b.column("starts").to_pylist(), b.column("masks").to_pylist(), strict=True):
                words = (text or "").encode("utf-8", "surrogatepass").split()
                if not starts:
                    out.append((len(words), 0, b" ".join(words)))
                    continue
                step = np.zeros(len(words) + width + 1 + CARRIED, np.int32)
                s, m = np.array(starts, np.int64), np.array(masks, np.int64)
                for t in range(CARRIED):
                    at = s[(m >> t) & 1 == 1] + t
                    np.add.at(step, at, 1)
                    np.add.at(step, at + width, -1)
                keep = np.cumsum(step)[: len(words)] == 0
                kept = [words[i] for i in np.flatnonzero(keep).tolist()]
                out.append((len(words), len(words) - len(kept), b" ".join(kept)))
            n, gone, kept = zip(*out, strict=True) if out else ((), (), ())
            what = [hashlib.sha256(x).hexdigest() for x in kept] if digests else [x.decode("utf-8", "surrogatepass") for x in kept]
            cols = [b.column("doc_id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(what, pa.string())]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_words", "n_removed", "result"])

    return run


NO_ID = (1 << 63) - 1


def removals(docs: DataFrame, width: int = 13) -> DataFrame:
    """(doc, h, start, mask): for windows of `width` words whose words also start in a document of smaller doc_id, where they start.

    h tells apart rows that share a doc_id; such rows don't remove one another's words. A null doc_id counts as the
    largest number there is.
    """
    spark = docs.sparkSession
    n = n_partitions(spark)
    anchors = docs.mapInArrow(_anchored(width), "key long, doc long, pos long, windows binary")
    return anchors.repartition(n, "key").sortWithinPartitions("key", "doc").mapInArrow(_settle, "doc long, h long, start int, mask long")


def dedup(docs: DataFrame, width: int = 13, digests: bool = False, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, result) for each row: result is the words that stay, joined by single blanks, or its SHA-256.

    Windows are judged on the input. A null or empty text has no words; texts of fewer than `width` words lose nothing.
    Other columns are left out. Words are compared by 64-bit hashes, windows by over 80 bits of two hashes.
    """
    h = F.pmod(F.xxhash64(F.col(text)), F.lit(1 << TEXT_BITS)).alias("h")
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID)).alias("doc"), h, F.col(text).alias("text"))
    marks = removals(rows.select("doc", "h", "text"), width).groupBy("doc", "h").agg(F.collect_list("start").alias("starts"), F.collect_list("mask").alias("masks"))
    both = rows.join(marks, ["doc", "h"], "left").select("doc_id", "text", "starts", "masks")
    return both.mapInArrow(_applied(width, digests), "doc_id long, n_words long, n_removed long, result string")


def digest(docs: DataFrame, width: int = 13) -> DataFrame:
    return dedup(docs, width, True).withColumnRenamed("result", "kept_sha256")
