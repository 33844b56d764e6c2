"""License scans: exact phrases by word, and fuzzy short notices by pigeonhole seeds and bounded-error matching."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, text_bytes

#: The base phrases and their labels.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
#: Short notices of the method: label, words, edits allowed (insertions, deletions, substitutions of characters).
NOTICES = (
    ("mit", "released under the mit license", 2),
    ("mit", "licensed under the mit license", 2),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy", 5),
    ("apache-2.0", "licensed under the apache license version 2 0", 3),
    ("bsd", "redistribution and use in source and binary forms with or without modification", 5),
    ("mpl", "subject to the terms of the mozilla public license", 4),
    ("gpl", "licensed under the gnu general public license", 3),
    ("gpl", "under the terms of the gnu general public license", 4),
    ("lgpl", "gnu lesser general public license", 2),
    ("agpl", "gnu affero general public license", 2),
    ("cc-by-nc", "licensed under cc by nc", 1),
    ("cc-by-sa", "licensed under cc by sa", 1),
    ("cc-by", "creative commons attribution", 2),
    ("public-domain", "dedicated to the public domain", 2),
    ("reserved", "all rights reserved", 1),
)

_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[65:91] = _WORD[97:123] = _WORD[128:] = True
#: A-Z lower-cased, other bytes that no word holds as spaces.
_PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if _WORD[c] else 32 for c in range(256))
_BASE_RE = tuple((p.split()[-1].encode(), re.compile(rb"(?<![^ ])" + rb" +".join(p.encode().split()) + rb"(?![^ ])"), label) for p, label in BASE)


def pieces(notice: str, edits: int) -> list[tuple[str, int]]:
    """The notice's words dealt in edits + 1 runs: (longest word of a run, its place in the notice).

    With at most `edits` edits one run at least is intact, and with it its longest word, though maybe not as a word of
    its own. Of all ways to deal the words
    the one whose shortest seed is longest is taken. A notice needs as many words as runs.
    """
    words = notice.split()

    @lru_cache(None)
    def best(start: int, runs: int) -> tuple[int, tuple[int, ...]]:
        """The shortest seed, and the seeds' words, of the best way to deal words[start:]."""
        if runs == 1:
            i = max(range(start, len(words)), key=lambda i: len(words[i]))
            return len(words[i]), (i,)
        ways = []
        for end in range(start + 1, len(words) - runs + 2):
            i = max(range(start, end), key=lambda i: len(words[i]))
            least, more = best(end, runs - 1)
            ways.append((min(least, len(words[i])), (i, *more)))
        return max(ways)

    if edits + 1 > len(words):
        raise ValueError(f"{notice!r} has fewer than {edits + 1} words")
    return [(words[i], len(" ".join(words[:i])) + (i > 0)) for i in best(0, edits + 1)[1]]


@lru_cache(1)
def machine(notices: tuple = NOTICES) -> tuple:
    """The automaton over all seeds (each with the notices and places it stands for), and the notices' bounded-error patterns."""
    seeds: dict[str, list] = {}
    for k, (_, words, edits) in enumerate(notices):
        for seed, at in pieces(words, edits):
            seeds.setdefault(seed, []).append((k, at))
    auto = ahocorasick.Automaton()
    for seed, uses in seeds.items():
        auto.add_word(seed, (len(seed), tuple(uses)))
    auto.make_automaton()
    return auto, [regex.compile(rf"(?b)(?:{words}){{e<={edits}}}") for _, words, edits in notices]


@lru_cache(50_000)
def verify(k: int, window: str) -> tuple[int, int, int] | None:
    """Start, end and edits of notice k's best match in a window with single spaces."""
    m = machine()[1][k].search(window)
    return (m.start(), m.end(), sum(m.fuzzy_counts)) if m else None


def scan_chunk(raw: np.ndarray, off: np.ndarray) -> list[tuple[int, list, list]]:
    """For each row: its number of words, the base places (word, label), and the method's spans (word, end, label, edits)."""
    n = len(raw)
    plain = raw.tobytes().translate(_PLAIN)
    inside = _WORD[raw]
    start = inside.copy()
    if n:
        start[1:] &= ~inside[:-1]
        edge = off[(off > 0) & (off < n)]
        start[edge] = inside[edge]
    starts = np.flatnonzero(start)
    first = np.searchsorted(starts, off)
    rows: list[tuple[int, list, list]] = [(int(b - a), [], []) for a, b in zip(first[:-1], first[1:], strict=True)]
    for last, pattern, label in _BASE_RE:
        at = plain.find(last)
        done = -1
        while at >= 0:
            row = int(np.searchsorted(off, at, side="right")) - 1
            if row != done:
                done = row
                for m in pattern.finditer(plain[off[row] : off[row + 1]]):
                    rows[row][1].append((int(np.searchsorted(starts, off[row] + m.start())) - int(first[row]), label))
            at = plain.find(last, int(off[row + 1]))
    auto, _ = machine()
    for end, (length, uses) in auto.iter(plain.decode("latin-1")):
        at = end - length + 1
        row = int(np.searchsorted(off, at, side="right")) - 1
        word = int(np.searchsorted(starts, at, side="right")) - 1  # a seed may lie inside a word
        for k, place in uses:
            label, words, edits = NOTICES[k]
            before = words[:place].count(" ") + edits + 1
            after = words[place:].count(" ") + edits + 2
            a, b = max(int(first[row]), word - before), min(int(first[row + 1]), word + after)
            stop = int(starts[b]) if b < int(first[row + 1]) else int(off[row + 1])
            # words begin and end at whole characters; a text's own bytes may still be no UTF-8
            window = " ".join(filter(None, plain[starts[a] : stop].decode("utf-8", "replace").split(" ")))
            if m := verify(k, window):
                s = a + window[: m[0]].count(" ") + (m[0] < len(window) and window[m[0]] == " ") - int(first[row])
                e = a + window[: m[1]].rstrip(" ").count(" ") + 1 - int(first[row])
                rows[row][2].append((s, e, label, m[2], len(words)))
    return rows


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in chunks(batches):
        out = []
        for n, base, more in scan_chunk(*text_bytes(b.column("text"))):
            places = [w for w, _ in base]
            best: dict[tuple, tuple] = {}
            for s, e, label, edits, size in sorted(more, key=lambda x: (x[3], x[1] - x[0], x)):
                best.setdefault((s, label), (s, e, label, edits, size))
            found = sorted(best.values())
            score = 1.0 if base else max((1 - x[3] / x[4] for x in found), default=0.0)
            labels = sorted({x for _, x in base} | {x[2] for x in found})
            out.append((
                n, len(base), min(places, default=None), max(places, default=None), ",".join(sorted({x for _, x in base})), ",".join(labels), score,
                [{"start": s, "end": e, "label": x, "edits": k} for s, e, x, k, _ in found],
            ))
        cols = list(zip(*out, strict=True)) if out else [[]] * 8
        span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("label", pa.string()), ("edits", pa.int32())]))
        kinds = (*[pa.int64()] * 4, pa.string(), pa.string(), pa.float64(), span)
        names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]
        yield pa.RecordBatch.from_arrays([b.column("id"), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], names=["doc_id", *names])


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans) for each row, whole texts.

    spans are the fuzzy notices found: first word, word after the last, label, edits. score is 1 with a base phrase,
    else the largest 1 - edits / length of a notice found, else 0. A null or empty text has no words, empty labels and
    score 0. Rows that repeat are scanned each; other columns are left out.
    """
    kind = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<start:int,end:int,label:string,edits:int>>"
    return docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text")).mapInArrow(_scan, kind)


def digest(docs: DataFrame) -> DataFrame:
    return scan(docs).withColumn("n_spans", F.size("spans").cast("long")).drop("spans")
