"""SentencePiece encoding with seeded merge-dropout, and lossless decoding."""

from __future__ import annotations

import hashlib
import re
import zlib
from array import array
from collections import defaultdict
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import count as counter
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, mix

SPACE = "▁"
MASK64 = 0xFFFFFFFFFFFFFFFF
#: Marks before which a unit ends after a letter, where the model has no piece of a letter and then that mark.
MARKS = ".,;:!?"


def model_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


#: A unit that no text has; it stands for the mark itself in a text, which is written as its bytes.
MARK = "\n\n"
#: Characters of a unit whose boundaries fit in 64 bits, and candidate merges that a group of units has at most.
SHORT = 62
WIDTHS = (4, 8, 12, 16, 24, 32, 48, 64, 128, 256, 1024)
_PLACE, _SIZE, _UNIT = 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0x9E3779B97F4A7C15
_BASE = np.uint64(0xD6E8FEB86659FD93)


class DropoutEncoder:
    """BPE over a SentencePiece model's pieces, each candidate merge skipped with probability `dropout` by a keyed hash.

    The agenda holds the candidate merges, best piece first and leftmost among equals. Taking one, its keyed hash (of
    seed, text's key, place of the unit in the text, and place and length of the merge in the unit) decides whether it
    is skipped for good. So every occurrence of a word draws anew, and equal seeds and keys give equal segmentations on
    any machine. With a dropout of 0 the result is the model's own.

    `segment` works one agenda off. `encode_many` does the same for all units of many texts at once: a unit's agenda is
    the list of its substrings that are pieces, in the agenda's order, and its state the 64 bits of boundaries that are
    left; in each step every unit takes its first candidate that spans two neighbours. Units whose plain merges are all
    drawn as taken have the plain result; only the others are worked off one by one.
    """

    def __init__(self, path: str, dropout: float = 0.1, seed: int = 1) -> None:
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.id = {sp.id_to_piece(i): i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))}
        self.rank = {p: -sp.get_score(i) for p, i in self.id.items()}
        self.byte = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.text: list[bytes] = [b""] * n
        for p, i in self.id.items():
            self.text[i] = p.replace(SPACE, " ").encode()
        for b, i in enumerate(self.byte):
            self.text[i] = bytes([b])
        safe = "".join(m for m in MARKS if not any(x.isalpha() for p in self.id for x, y in zip(p, p[1:]) if y == m))
        #: A unit, which no piece reaches beyond: a run of blanks with what follows up to the next blank, line end or safe mark.
        ends = f"{SPACE}*[^{SPACE}\n{safe}]*[^\\W\\d_](?=[{safe}])|" if safe else ""
        self.units = re.compile(f"\n|{ends}{SPACE}*[^{SPACE}\n]+|{SPACE}+").findall
        self.limit = int(dropout * (1 << 32))
        self.seed = zlib.crc32(str(seed).encode()) * _UNIT & MASK64
        # pieces by length: their hashes in order, and ids in the order of ranks, so that equal ranks don't matter
        self.longest = max(map(len, self.id), default=1)
        by_size: dict[int, list[tuple[int, int]]] = {}
        for piece, i in self.id.items():
            h = 0
            for c in piece:
                h = (h * int(_BASE) + ord(c) + 1) & MASK64
            by_size.setdefault(len(piece), []).append((h, i))
        self.hashes = {k: (np.array([h for h, _ in sorted(x)], np.uint64), np.array([i for _, i in sorted(x)], np.int32)) for k, x in by_size.items()}
        self.seen = np.zeros(1 << 20, bool)  # a filter of the hashes, before they are looked up
        for x, _ in self.hashes.values():
            self.seen[mix(x) >> np.uint64(44)] = True
        levels = {r: k for k, r in enumerate(sorted(set(self.rank.values())))}
        self.ranks = np.zeros(n, np.int64)  # places in the order of ranks
        self.ranks[list(self.id.values())] = [levels[self.rank[p]] for p in self.id]

    def key(self, salt: int, place: int) -> int:
        """The hash key of the unit at a place of a text."""
        return int(mix(np.array([(salt ^ self.seed) + place * _UNIT & MASK64], np.uint64))[0])

    def skipped(self, key: int, place: int, size: int) -> bool:
        x = key + place * _PLACE + size * _SIZE & MASK64
        return int(mix(np.array([x], np.uint64))[0]) >> 32 < self.limit

    def segment(self, unit: str, key: int) -> list[str]:
        """The pieces of one unit, by its agenda."""
        parts, rank, limit = list(unit), self.rank.get, self.limit
        n = len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        agenda = [(r, i, 2) for i, both in enumerate(map(add, parts, parts[1:])) if (r := rank(both)) is not None]
        heapify(agenda)
        gone = set()
        while agenda:
            _, i, size = heappop(agenda)
            left = parts[i]
            j = after[i]
            if not left or j >= n or len(left) + len(parts[j]) != size or (i, size) in gone:
                continue
            if limit and self.skipped(key, i, size):
                gone.add((i, size))
                continue
            parts[i] = both = left + parts[j]
            parts[j] = ""
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                wide = both + parts[k]
                if (r := rank(wide)) is not None:
                    heappush(agenda, (r, i, len(wide)))
            if (h := before[i]) >= 0:
                wide = parts[h] + both
                if (r := rank(wide)) is not None:
                    heappush(agenda, (r, h, len(wide)))
        return [p for p in parts if p]

    def piece_ids(self, pieces: list[str]) -> list[int]:
        out: list[int] = []
        for p in pieces:
            if (i := self.id.get(p)) is not None:
                out.append(i)
            else:
                out += [self.byte[b] for b in p.encode("utf-8", "surrogatepass")]
        return out

    def units_of(self, text: str) -> list[str]:
        """The units of a text after one more blank, as the model has it; none for an empty text."""
        if not text:
            return []
        if SPACE not in text:
            return self.units((" " + text).replace(" ", SPACE))
        out: list[str] = []
        for k, part in enumerate((" " + text).split(SPACE)):
            out += [MARK] * (k > 0) + self.units(part.replace(" ", SPACE))
        return out

    def encode(self, text: str, salt: int = 0) -> bytes:
        """Ids as little-endian unsigned 32-bit bytes."""
        return self.encode_many([text], [salt])[0]

    def _pieces_at(self, code: np.ndarray, room: np.ndarray) -> np.ndarray:
        """characters x (longest + 1): the id of the piece of each length that begins there, -1 without; `room` is what is left
        of the unit from there."""
        out = np.full((len(code), self.longest + 1), -1, np.int32)
        h = np.zeros(len(code), np.uint64)
        live = np.arange(len(code))
        for size in range(1, self.longest + 1):
            live = live[room[live] >= size]
            if not len(live):
                break
            h[live] = h[live] * _BASE + code[live + size - 1] + np.uint64(1)
            if size in self.hashes:
                known, ids = self.hashes[size]
                x = h[live]
                on = np.flatnonzero(self.seen[mix(x) >> np.uint64(44)])
                at = np.minimum(np.searchsorted(known, x[on]), len(known) - 1)
                sure = known[at] == x[on]
                out[live[on[sure]], size] = ids[at[sure]]
        return out

    def _worked(self, rows: np.ndarray, full: np.ndarray, bound: np.ndarray, ends: np.ndarray, inner: np.ndarray, draw: np.ndarray, key: np.ndarray | None):
        """Boundaries of each row's unit once its agenda is empty; without keys nothing is skipped, and the merges come too.

        `rows` are units; candidates bound[u] to bound[u + 1] are those of unit u in the agenda's order.
        """
        left = full[rows].copy()
        size = np.diff(bound)[rows]
        taken: list[tuple[np.ndarray, np.ndarray]] = []
        lowest = 0
        for width in (*WIDTHS, int(size.max(initial=0))):
            group = np.flatnonzero((size > lowest) & (size <= width))
            lowest = max(lowest, width)
            for start in range(0, len(group), max(1, 2_000_000 // max(1, width))):
                mine = group[start : start + max(1, 2_000_000 // max(1, width))]
                at = bound[rows[mine]][:, None] + np.arange(min(width, int(size[mine].max())))
                open_ = at < bound[rows[mine] + 1][:, None]
                at = np.where(open_, at, 0)
                e, i = ends[at], inner[at]
                b = left[mine]
                live = np.arange(len(mine))
                while len(live):
                    x = b[live, None]
                    free = open_[live] & ((x & e[live]) == e[live])
                    free &= np.bitwise_count(x & i[live]) == 1
                    first = free.argmax(axis=1)
                    some = free[np.arange(len(live)), first]
                    live, first = live[some], first[some]
                    if key is None:
                        taken.append((mine[live], at[live, first]))
                        b[live] &= ~i[live, first]
                    else:
                        skip = mix(key[mine[live]] + draw[at[live, first]]) >> np.uint64(32) < np.uint64(self.limit)
                        open_[live[skip], first[skip]] = False
                        go = live[~skip]
                        b[go] &= ~i[go, first[~skip]]
                left[mine] = b
        return left, taken

    def encode_many(self, texts: list[str], salts: list[int]) -> list[bytes]:
        """The ids of each text, as little-endian unsigned 32-bit bytes, under its salt."""
        index: dict[str, int] = defaultdict(counter().__next__)  # units in the order in which they come first
        uids, count = array("i"), []
        for text in texts:
            own = self.units_of(text)
            uids.extend(map(index.__getitem__, own))
            count.append(len(own))
        uid = np.frombuffer(uids, np.int32) if len(uids) else np.zeros(0, np.int32)
        count = np.array(count, np.int64)
        if not len(uid):
            return [b""] * len(texts)
        place = np.arange(len(uid)) - np.repeat(np.cumsum(count) - count, count)
        salt = np.array([x & MASK64 for x in salts], np.uint64) ^ np.uint64(self.seed)
        key = mix(np.repeat(salt, count) + place.astype(np.uint64) * np.uint64(_UNIT))
        units = list(index)
        length = np.fromiter(map(len, units), np.int64, len(units))
        by_hand = (length > SHORT) | np.fromiter((u == MARK for u in units), bool, len(units))
        # the pieces that begin at each character of the short units
        n = np.where(by_hand, 0, length)
        start = np.concatenate([[0], np.cumsum(n)])
        code = np.frombuffer("".join([u for u, x in zip(units, by_hand.tolist(), strict=True) if not x]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        owner = np.repeat(np.arange(len(units)), n)
        local = np.arange(len(code)) - start[owner]
        pieces = self._pieces_at(code, n[owner] - local)
        # candidates in the agenda's order: by unit, rank and place
        at, size = np.nonzero(pieces[:, 2:] >= 0)
        size += 2
        who = owner[at]
        order = np.argsort((who << 32) | (self.ranks[pieces[at, size]] << 8) | local[at])  # places are under 64, ranks under 2**24
        at, size, who = at[order], size[order], who[order]
        bound = np.searchsorted(who, np.arange(len(units) + 1))
        lo, hi = local[at].astype(np.uint64), (local[at] + size).astype(np.uint64)
        one = np.uint64(1)
        ends, inner = (one << lo) | (one << hi), ((one << hi) - one) & ~((one << (lo + one)) - one)
        draw = lo * np.uint64(_PLACE) + size.astype(np.uint64) * np.uint64(_SIZE)
        full = (one << (n.astype(np.uint64) + one)) - one
        plain, taken = self._worked(np.arange(len(units)), full, bound, ends, inner, draw, None)
        again, drawn = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        if self.limit and taken:
            # the merges that make each unit's plain result: an occurrence that takes them all has it
            u, c = (np.concatenate(x) for x in zip(*taken, strict=True))
            order = np.argsort(u, kind="stable")
            u, c = u[order], c[order]
            first = np.searchsorted(u, np.arange(len(units) + 1))
            merges = np.diff(first)[uid]
            occ = np.repeat(np.arange(len(uid)), merges)
            which = c[np.repeat(first[uid] - np.cumsum(merges) + merges, merges) + np.arange(merges.sum())]
            skip = mix(key[occ] + draw[which]) >> np.uint64(32) < np.uint64(self.limit)
            again = np.flatnonzero(np.bincount(occ[skip], minlength=len(uid)))
            drawn = self._worked(uid[again], full, bound, ends, inner, draw, key[again])[0]
        # boundaries to ids, once a unit for plain results and once an occurrence for the others: a piece from each boundary to
        # the next, single characters that are none as their bytes
        of, state = np.concatenate([np.arange(len(units)), uid[again]]), np.concatenate([plain, drawn])
        bits = np.unpackbits(state.view(np.uint8).reshape(-1, 8), axis=1, count=int(n.max(initial=0)) + 1, bitorder="little")
        row, pos = np.nonzero(bits)
        inside = np.flatnonzero(row[1:] == row[:-1])
        row, pos, size = row[inside], pos[inside], pos[inside + 1] - pos[inside]
        char = start[of[row]] + pos
        ids = pieces[char, np.minimum(size, self.longest)]
        number = np.ones(len(ids), np.int64)
        lost = np.flatnonzero(ids < 0)
        spelled = {x: [self.byte[b] for b in chr(x).encode("utf-8", "surrogatepass")] for x in set(code[char[lost]].tolist())}
        number[lost] = [len(spelled[x]) for x in code[char[lost]].tolist()]
        held = np.bincount(row, number, minlength=len(of)).astype(np.int64)
        flat, first = np.repeat(ids, number).astype(np.uint32), np.cumsum(number) - number
        for k, x in zip(first[lost].tolist(), code[char[lost]].tolist(), strict=True):
            flat[k : k + len(spelled[x])] = spelled[x]
        # units by hand, one after the other, at the end
        hand = np.flatnonzero(by_hand[uid])
        written = []
        for o in hand.tolist():
            unit = units[uid[o]]
            written.append([self.byte[b] for b in SPACE.encode()] if unit == MARK else self.piece_ids(self.segment(unit, int(key[o]))))
        flat = np.concatenate([flat, *(np.array(x, np.uint32) for x in written)])
        held = np.concatenate([held, np.fromiter(map(len, written), np.int64, len(written))])
        # each occurrence's ids from where they are held
        source = uid.astype(np.int64)
        source[again] = len(units) + np.arange(len(again))
        source[hand] = len(of) + np.arange(len(hand))
        total = held[source]
        stop = np.cumsum(total)
        out = flat[np.repeat((np.cumsum(held) - held)[source] - stop + total, total) + np.arange(stop[-1])]
        stop = np.append(0, stop)[np.cumsum(count)]
        return [out[a:e].tobytes() for a, e in zip([0, *stop[:-1].tolist()], stop.tolist(), strict=True)]

    def decode(self, ids: bytes | np.ndarray) -> str:
        """The text that the ids spell, byte for byte, without the blank that `encode` put first."""
        ids = np.frombuffer(ids, np.uint32) if isinstance(ids, bytes) else ids
        return b"".join(map(self.text.__getitem__, ids.tolist())).decode("utf-8", "surrogatepass")[1:]


_encoders: dict[tuple, DropoutEncoder] = {}


def encoder(*args) -> DropoutEncoder:
    if args not in _encoders:
        _encoders[args] = DropoutEncoder(*args)
    return _encoders[args]


def _encoded(args: tuple, digests: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(*args)
        for b in chunks(batches, most=1_500_000):
            texts = b.column("text").to_pylist()
            ids = enc.encode_many([t or "" for t in texts], b.column("salt").to_pylist())
            if digests:
                back = [enc.decode(x) for x in ids]
                more = [
                    pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([zlib.crc32(x) for x in ids], pa.int64()),
                    pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in back], pa.string()),
                    pa.array([t == (u or "") for t, u in zip(back, texts, strict=True)], pa.bool_()),
                ]
                yield pa.RecordBatch.from_arrays([b.column("id"), *more], names=["doc_id", "n_pieces", "ids_crc32", "decoded_sha256", "lossless"])
            else:
                rows = [None if t is None else np.frombuffer(x, np.uint32).astype(np.int32) for t, x in zip(texts, ids, strict=True)]
                yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(rows, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return run


def _rows(docs: DataFrame, seed: int) -> DataFrame:
    """(id, text, salt): a row's key follows from its doc_id."""
    return docs.select(F.col("doc_id").cast("long").alias("id"), "text").select("id", "text", F.xxhash64(F.col("id"), F.lit(seed)).alias("salt"))


def encode(docs: DataFrame, dropout: float = 0.1, seed: int = 1, model: str | None = None) -> DataFrame:
    """(doc_id, ids) for each row; a null text has null ids, an empty one none. Rows that repeat get the same ids."""
    return _rows(docs, seed).mapInArrow(_encoded((model or model_file(), dropout, seed), False), "doc_id long, ids array<int>")


def decode(encoded: DataFrame, model: str | None = None) -> DataFrame:
    """(doc_id, text) from (doc_id, ids); null ids give a null text."""
    path = model or model_file()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, 0.0, 0)
        for b in batches:
            texts = [None if x is None else enc.decode(np.array(x, np.uint32)) for x in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def digest(docs: DataFrame, dropout: float = 0.1, seed: int = 1, model: str | None = None) -> DataFrame:
    """(doc_id, n_pieces, ids_crc32, decoded_sha256, lossless): each row's text encoded, and decoded again."""
    kind = "doc_id long, n_pieces long, ids_crc32 long, decoded_sha256 string, lossless boolean"
    return _rows(docs, seed).mapInArrow(_encoded((model or model_file(), dropout, seed), True), kind)
