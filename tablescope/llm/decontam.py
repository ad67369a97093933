"""Benchmark decontamination: rare word n-grams as seeds, Smith-Waterman alignment as the verdict.

A seed is an n-gram of a test item that ordinary text would hardly contain: the product of its words' rates in the corpus
is small.  Rates come from all documents, and a passage that was copied a thousand times does not make its words common.
Around each seed the document's words are aligned with the item's; edited copies lose some of the score, unrelated text
that happens to share a seed loses nearly all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablescope.llm.common import text_groups, written
from tablescope.llm.jaccard import word_hashes

U = np.uint64
GRAM = 3
#: Expected occurrences per word of text from which an n-gram is no seed.
COMMON_RATE = 1e-6
#: Words of all items up to which items and seeds are sent to every task; larger sets are joined.
SENT_WORDS = 500_000
MATCH, MISMATCH, GAP = 2, -1, -1
#: Share of the score of a perfect copy, and aligned words (or the whole item), that make a contamination.
LEAST_SCORE, LEAST_WORDS = 0.5, 8

#: Letters and digits stay; ASCII marks and white space part words.
_TABLE = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
_WEIGHTS = [U(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def words_of(text: str) -> np.ndarray:
    """Hashes of the lower-cased words of a text."""
    return word_hashes(text.lower().encode("utf-8", "surrogatepass").translate(_TABLE))[0]


def grams_of(words: np.ndarray) -> np.ndarray:
    n = max(0, len(words) - GRAM + 1)
    out = np.zeros(n, U)
    for j in range(GRAM):
        out += words[j : j + n] * _WEIGHTS[j]
    return out ^ (out >> U(32))


def align(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """(score, end in item, end in text) of the best local alignment; ends are exclusive."""
    step = np.arange(len(text), dtype=np.int32) * -GAP
    above = np.zeros(len(text) + 1, np.int32)
    best = (0, 0, 0)
    for i, word in enumerate(item):
        row = np.maximum(above[:-1] + np.where(text == word, MATCH, MISMATCH), above[1:] + GAP)
        row = np.maximum(row, 0) + step
        row = np.maximum.accumulate(row) - step
        j = int(np.argmax(row))
        if row[j] > best[0]:
            best = (int(row[j]), i + 1, j + 1)
        above[1:] = row
    return best


def aligned(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int, int]:
    """(score, start, end in text, words in common) of the best local alignment."""
    score, item_end, end = align(item, text)
    if not score:
        return 0, 0, 0, 0
    _, item_back, back = align(item[:item_end][::-1], text[:end][::-1])
    a, b = item[item_end - item_back : item_end], text[end - back : end]
    kinds, n = np.unique(a, return_counts=True)
    inside, m = np.unique(b, return_counts=True)
    both, i, j = np.intersect1d(kinds, inside, return_indices=True)
    return score, end - back, end, int(np.minimum(n[i], m[j]).sum()) if len(both) else 0


class Matcher:
    """Items, their seeds, and the comparison of a text with the items that its seeds name."""

    def __init__(self, items: list[tuple[int, np.ndarray]], common: dict[int, float], floor: float):
        self.items = items
        grams, of, at = [np.zeros(0, U)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for k, (_, words) in enumerate(items):
            place = seed_places(words, common, floor)
            grams.append(grams_of(words)[place])
            of.append(np.full(len(place), k))
            at.append(place)
        grams, of, at = np.concatenate(grams), np.concatenate(of), np.concatenate(at)
        order = np.argsort(grams, kind="stable")
        self.grams, self.of, self.at = grams[order], of[order], at[order]
        self.bits = np.zeros(1 << 20, bool)
        self.bits[(self.grams >> U(44)).astype(np.int64)] = True

    def seeds_in(self, words: np.ndarray) -> Iterator[tuple[int, int]]:
        """(item, offset of the item's start in the text) for every seed."""
        grams = grams_of(words)
        maybe = np.flatnonzero(self.bits[(grams >> U(44)).astype(np.int64)])
        if not len(maybe):
            return
        low, high = np.searchsorted(self.grams, grams[maybe], "left"), np.searchsorted(self.grams, grams[maybe], "right")
        for i in np.flatnonzero(high > low).tolist():
            for s in range(int(low[i]), int(high[i])):
                yield int(self.of[s]), int(maybe[i] - self.at[s])

    def match(self, words: np.ndarray) -> list[tuple[int, float, int, int]]:
        """(item id, score, first word, end) of the best contamination by each item, in the order of the items."""
        windows: dict[int, list[int]] = {}
        for item, offset in self.seeds_in(words):
            windows.setdefault(item, []).append(offset)
        out = []
        for item in sorted(windows):
            found = best_of(self.items[item][1], words, windows[item])
            if found:
                out.append((self.items[item][0], *found))
        return out


def best_of(item: np.ndarray, words: np.ndarray, offsets: list[int]) -> tuple[float, int, int] | None:
    """The best alignment of the item in windows around the offsets, if it is a contamination."""
    n = len(item)
    pad = n // 2 + GRAM
    best: tuple[float, int, int] | None = None
    end = -1
    spans: list[list[int]] = []
    for a in sorted(set(offsets)):
        low, high = max(0, a - pad), min(len(words), a + n + pad)
        # windows that overlap are one, unless that makes them long: a long row of copies stays a row of windows
        if spans and low <= end and high - spans[-1][0] <= 4 * (n + 2 * pad):
            spans[-1][1] = max(spans[-1][1], high)
        else:
            spans.append([low, high])
        end = spans[-1][1]
    for low, high in spans:
        score, start, stop, common = aligned(item, words[low:high])
        share = score / (MATCH * n)
        if share >= LEAST_SCORE and common >= min(n, LEAST_WORDS) and (best is None or share > best[0]):
            best = (share, low + start, low + stop)
    return best


def seed_places(words: np.ndarray, rates: dict[int, float], floor: float) -> np.ndarray:
    """Where an item's seeds start: its n-grams with small expected rate, or else the rarer half of them."""
    n = max(0, len(words) - GRAM + 1)
    if not n:
        return np.zeros(0, np.int64)
    each = np.array([rates.get(int(w), floor) for w in words])
    rate = np.prod([each[j : j + n] for j in range(GRAM)], axis=0)
    rare = np.flatnonzero(rate <= COMMON_RATE)
    return rare if len(rare) else np.flatnonzero(rate <= np.median(rate))


def word_rates(docs: DataFrame, wanted: np.ndarray, text: str) -> tuple[dict[int, float], float]:
    """(rate per word of text, rate of a word that never occurs) of the wanted words over all documents."""
    wanted = np.unique(wanted)
    slots = np.zeros(1 << 20, bool)
    slots[(wanted >> U(44)).astype(np.int64)] = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, counts = 0, np.zeros(len(wanted), np.int64)
        for batch in batches:
            for _, texts in text_groups(batch.column(0)):
                words = words_of("\n".join(texts))
                total += len(words)
                words = words[slots[(words >> U(44)).astype(np.int64)]]
                at = np.minimum(np.searchsorted(wanted, words), max(0, len(wanted) - 1))
                if len(words):
                    counts += np.bincount(at[wanted[at] == words], minlength=len(wanted))
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array([-1, *some.tolist()], pa.int64()), pa.array([total, *counts[some].tolist()], pa.int64())], names=["w", "n"]
        )

    parts = docs.select(F.col(text).cast("string").alias("text")).mapInArrow(run, "w long, n long")
    # one row per wanted word: as many as the items have words, which the caller has checked
    found = {r["w"]: r["n"] for r in parts.groupBy("w").agg(F.sum("n").alias("n")).collect()}
    total = max(1, found.pop(-1, 0))
    return {int(wanted[w]): n / total for w, n in found.items()}, 1 / total


def matcher_for(docs: DataFrame, items: DataFrame, text: str, item_key: str, item_text: str) -> Matcher | None:
    """The matcher to send to all tasks, or None if the items are too many for that."""
    slim = items.where(F.col(item_text).isNotNull()).select(F.col(item_key).cast("long").alias("id"), F.col(item_text).cast("string").alias("text"))
    # an item has at most as many words as half its characters
    size = slim.agg(F.coalesce(F.sum(F.length("text") / 2 + 1), F.lit(0.0)).alias("n")).first()["n"]
    if size > SENT_WORDS:
        return None
    rows = sorted((r["id"] is None, r["id"] or 0, r["text"]) for r in slim.collect())
    sent = [(None if no else i, words_of(t)) for no, i, t in rows]
    rates, floor = word_rates(docs, np.concatenate([np.zeros(0, U), *(w for _, w in sent)]), text)
    return Matcher(sent, rates, floor)


PAIRS = "item_id long, score double, first_word int, end_word int"


def contaminated(
    docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """(key, item_id, score, first_word, end_word) for every document and test item that it holds a copy of.

    The score is the share of a perfect copy's alignment score.  Items with fewer than three words have no seed and are
    never found; null texts hold nothing.  Every row of docs is looked at on its own, so repeated rows repeat their
    results; an item that is there twice is found twice; other columns are not read.  Empty tables give an empty result.
    """
    slim = docs.select(F.col(key).alias("_key"), F.col(text).cast("string").alias("_text"))
    matcher = matcher_for(docs, items, text, item_key, item_text)
    if matcher is None:
        numbered = written(slim.select(F.monotonically_increasing_id().alias("row"), "_key", "_text"), "passages")
        return _joined(numbered, items, item_key, item_text).drop("row").withColumnRenamed("_key", key)
    kind = slim.schema["_key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in text_groups(batch.column(1)):
                rows = [(at + i, *m) for i, t in enumerate(texts) for m in matcher.match(words_of(t))]
                of, ids, score, first, end = zip(*rows, strict=True) if rows else ((),) * 5
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(of, pa.int64())), pa.array(ids, pa.int64()), pa.array(score, pa.float64()),
                        pa.array(first, pa.int32()), pa.array(end, pa.int32()),
                    ],
                    names=["_key", "item_id", "score", "first_word", "end_word"],
                )

    return slim.mapInArrow(run, f"_key {kind}, {PAIRS}").withColumnRenamed("_key", key)


def _joined(numbered: DataFrame, items: DataFrame, item_key: str, item_text: str) -> DataFrame:
    """The same for any number of items, with the number of each row of (row, _key, _text), which are written already.

    N-grams of both sides meet in a shuffle, texts follow the pairs found.
    """
    kind = numbered.schema["_key"].dataType.simpleString()
    test = items.where(F.col(item_text).isNotNull()).select(
        F.monotonically_increasing_id().alias("n"), F.col(item_key).cast("long").alias("id"), F.col(item_text).cast("string").alias("text")
    )
    test = written(test, "items")

    def words_with(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in text_groups(batch.column(1)):
                for i, t in enumerate(texts, at):
                    w = words_of(t).astype(np.int64)
                    ids = pa.array([batch.column(0)[i].as_py()] * len(w), pa.int64())
                    yield pa.RecordBatch.from_arrays([ids, pa.array(np.arange(len(w), dtype=np.int32)), pa.array(w)], names=["n", "at", "w"])

    def grams_with(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in text_groups(batch.column(1)):
                for i, t in enumerate(texts, at):
                    g = grams_of(words_of(t)).astype(np.int64)
                    ids = pa.array([batch.column(0)[i].as_py()] * len(g), pa.int64())
                    yield pa.RecordBatch.from_arrays([ids, pa.array(np.arange(len(g), dtype=np.int32)), pa.array(g)], names=["n", "at", "g"])

    words = test.select("n", "text").mapInArrow(words_with, "n long, at int, w long")
    corpus = numbered.select(F.col("row").alias("n"), "_text").mapInArrow(words_with, "n long, at int, w long")
    counts = corpus.groupBy("w").agg(F.count("*").alias("c"))
    total = max(1, counts.agg(F.sum("c").alias("c")).first()["c"] or 0)
    rates = words.select("w").distinct().join(counts, "w", "left").select("w", (F.coalesce("c", F.lit(1)) / total).alias("rate"))
    rated = words.join(rates, "w").groupBy("n").agg(F.sort_array(F.collect_list(F.struct("at", "w", "rate"))).alias("words"))

    def seeds_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n, words in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                w = np.array([x["w"] for x in words], np.int64).astype(U)
                place = seed_places(w, {x["w"] % (1 << 64): x["rate"] for x in words}, 1 / total)
                g = grams_of(w)[place].astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(g), pa.array([n] * len(g), pa.int64()), pa.array(place)], names=["g", "item", "place"])

    seeds = rated.mapInArrow(seeds_of, "g long, item long, place long")
    grams = numbered.select(F.col("row").alias("n"), "_text").mapInArrow(grams_with, "n long, at int, g long")
    met = grams.join(seeds, "g").groupBy("n", "item").agg(F.collect_set(F.col("at") - F.col("place")).alias("offsets"))
    both = (
        met.join(test.select(F.col("n").alias("item"), "id", F.col("text").alias("item_text")), "item")
        .join(numbered.withColumnRenamed("row", "n"), "n")
        .select("_key", "_text", "id", "item_text", "offsets", "n")
    )

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i in range(batch.num_rows):
                text, item, offsets = (batch.column(c)[i].as_py() for c in (1, 3, 4))
                found = best_of(words_of(item), words_of(text), offsets)
                if found:
                    rows.append((i, batch.column(2)[i].as_py(), *found))
            of, ids, score, first, end = zip(*rows, strict=True) if rows else ((),) * 5
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(5).take(pa.array(of, pa.int64())), batch.column(0).take(pa.array(of, pa.int64())),
                    pa.array(ids, pa.int64()), pa.array(score, pa.float64()), pa.array(first, pa.int32()), pa.array(end, pa.int32()),
                ],
                names=["row", "_key", "item_id", "score", "first_word", "end_word"],
            )

    return both.mapInArrow(judge, f"row long, _key {kind}, {PAIRS}")


def keep_clean(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, that hold no copy of a test item.  Every row is judged on its own."""
    matcher = matcher_for(docs, items, text, item_key, item_text)
    if matcher is None:
        # the row travels as one value, so that its columns may have any names
        whole = written(docs.select(F.monotonically_increasing_id().alias("row"), F.struct(*docs.columns).alias("doc")), "passages")
        numbered = whole.select("row", F.col("doc")[key].alias("_key"), F.col("doc")[text].cast("string").alias("_text"))
        found = _joined(numbered, items, item_key, item_text).select("row").distinct()
        kept = whole.join(found, "row", "left_anti")
        return kept.select(*[F.col("doc")[c].alias(c) for c in docs.columns])
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [not matcher.match(words_of(t)) for _, texts in text_groups(batch.column(at)) for t in texts]
            if keep:
                yield batch.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)
