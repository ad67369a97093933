"""Periodic run detection over the words of whole texts, by recursive frequency splitting and a lag scan.

A run is a maximal stretch of consecutive words whose smallest period q (words q apart are equal) keeps it at least
``max(MIN_LENGTH, MIN_EXPONENT * q)`` words long.  Every word position inside such a run recurs at least
``MIN_EXPONENT`` times inside it (every q words), so a word that occurs fewer times than that in a segment of the text
can belong to no run there: it splits the segment.  Splitting is repeated on the parts, with counts taken anew in
each, until no part changes; parts shorter than MIN_LENGTH are dropped.  Only the surviving parts are scanned, lag by
lag: for lag q the stretches where word i equals word i + q give the period-q candidates.  Since a true run never
holds a splitting word, every run lies inside one surviving part and is maximal there, and the scan finds them all.

Cost: the splitting is linear in the words per round; the lag scan is quadratic in the length of a surviving part
(m * m / 3 word comparisons), which only texts made of a few frequent words reach.  One text is one step of a task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values of the contract: the word pattern, the shortest run and its least exponent.
WORD = regex.compile(r"[^\x20\x09-\x0D]+")
MIN_LENGTH = 24
MIN_EXPONENT = 3

EMPTY_SHA = hashlib.sha256(b"").hexdigest()

SCHEMA = (
    "n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string,"
    " n_words long, n_dropped long"
)


def word_ids(words: list[str]) -> np.ndarray:
    """Each word as the number of its first kind of occurrence: equal words, equal numbers."""
    seen: dict[str, int] = {}
    return np.fromiter((seen.setdefault(w, len(seen)) for w in words), dtype=np.int64, count=len(words))


def planted(words: list[str], h: int | None) -> list[str]:
    """The words with the contract's planted repetition: for h % 10 == 0, word i >= a becomes word a + (i - a) % p."""
    n = len(words)
    if h is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def surviving_segments(ids: np.ndarray, min_length: int = MIN_LENGTH, min_count: int = MIN_EXPONENT) -> list[tuple[int, int]]:
    """[start, end) of the parts left when words rarer than min_count in their part split it, repeated to stability."""
    n = len(ids)
    if n < min_length:
        return []
    alive = np.ones(n, dtype=bool)
    while True:
        # parts: maximal stretches of alive positions
        edge = np.flatnonzero(np.diff(np.concatenate(([False], alive, [False])).astype(np.int8)))
        starts, ends = edge[0::2], edge[1::2]
        long_enough = ends - starts >= min_length
        alive_next = np.zeros(n, dtype=bool)
        for s, e in zip(starts[long_enough], ends[long_enough]):
            alive_next[s:e] = True
        pos = np.flatnonzero(alive_next)
        if not len(pos):
            return []
        part = np.cumsum(np.concatenate(([1], np.diff(pos) != 1)))
        # occurrences of each (part, word) inside its part
        key = part * (int(ids.max()) + 1) + ids[pos]
        _, inverse, counts = np.unique(key, return_inverse=True, return_counts=True)
        rare = counts[inverse] < min_count
        alive_next[pos[rare]] = False
        if np.array_equal(alive_next, alive):
            break
        alive = alive_next
    edge = np.flatnonzero(np.diff(np.concatenate(([False], alive, [False])).astype(np.int8)))
    return [(int(s), int(e)) for s, e in zip(edge[0::2], edge[1::2]) if e - s >= min_length]


def _has_period(ids: np.ndarray, s: int, e: int, d: int) -> bool:
    return bool(np.array_equal(ids[s : e - d], ids[s + d : e]))


def lag_scan(ids: np.ndarray, s: int, e: int, min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs inside [s, e), scanning each lag q up to a third of the part."""
    found = []
    for q in range(1, (e - s) // min_exponent + 1):
        need = max(min_length, min_exponent * q) - q  # equal pairs in a row
        same = ids[s : e - q] == ids[s + q : e]
        edge = np.flatnonzero(np.diff(np.concatenate(([False], same, [False])).astype(np.int8)))
        for a, b in zip(edge[0::2], edge[1::2]):
            if b - a < need:
                continue
            start, end = s + int(a), s + int(b) + q
            # smallest period: a smaller one divides q (the stretch is longer than q plus it)
            if any(q % d == 0 and _has_period(ids, start, end, d) for d in range(1, q // 2 + 1)):
                continue
            found.append((start, end - start, q))
    return found


def runs(words: list[str]) -> list[tuple[int, int, int]]:
    """All runs of a word list as (start, length, period), ordered by start, then period."""
    ids = word_ids(words)
    out = [run for s, e in surviving_segments(ids) for run in lag_scan(ids, s, e)]
    return sorted(out, key=lambda r: (r[0], r[2]))


def describe(text: str | None, h: int | None) -> tuple:
    """The output columns for one text; null text has no words."""
    words = planted(WORD.findall(text or ""), h)
    found = runs(words)
    dropped = np.zeros(len(words), dtype=bool)
    for start, length, period in found:
        dropped[start + period : start + length] = True
    kept = " ".join(w for w, d in zip(words, dropped) if not d)
    digest = hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in found).encode()).hexdigest()
    # greatest exact length / period, compared as fractions; found is ordered by start, then period
    best = found[0] if found else None
    if found:
        for r in found[1:]:
            if r[1] * best[2] > best[1] * r[2]:
                best = r
    head = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None, None, None, None)
    return (len(found), *head, digest, hashlib.sha256(kept.encode()).hexdigest(), len(words), int(dropped.sum()))


def detect(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of docs: key, n_runs, the run of greatest exponent (start, length, period, exponent_milli; nulls if none),
    runs_sha256 (every run's ``start,length,period`` and a line feed, by start then period), collapsed_sha256 (the words
    not dropped, joined by one space), n_words, n_dropped.

    Null text: no words (n_runs 0, digests of the empty string).  Null key: nothing is planted.  Repeated rows give
    equal rows each; an empty table gives an empty result; other columns of docs, whatever their names, are not read.
    Ties of exponent go to the smallest start, then the smallest period.
    """
    slim = docs.select(
        F.col(key).alias("_key"),
        F.col(text).cast("string").alias("_text"),
        F.crc32(F.col(key).cast("string")).alias("_h"),
    )
    kind = slim.schema["_key"].dataType.simpleString()
    names = [c.split()[0] for c in SCHEMA.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, hashes = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            rows = [describe(t, h) for t, h in zip(texts, hashes)]
            columns = list(zip(*rows)) if rows else [[] for _ in names]
            arrays = [pa.array(c, pa.string() if n.endswith("sha256") else pa.int64()) for n, c in zip(names, columns)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=["_key", *names])

    return slim.mapInArrow(run, f"_key {kind}, {SCHEMA}").withColumnRenamed("_key", key)
