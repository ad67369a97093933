"""Quality rules: gradient-boosted trees over document statistics, scored as flat numpy node arrays.

The trees are fitted on a bounded sample of labelled documents with monotonic constraints: more symbols, repeated lines,
repeated windows, capitals or exclamation marks never make a document better.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablescope.llm.common import text_groups

#: Labelled documents that the trees are fitted on, at most: those whose ids have the smallest hashes.
FIT_ROWS = 20_000

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: name and constraint (-1: the score never rises with it) of what the trees see
FEATURES = [
    ("log_words", 0), ("word_length", 0), ("symbols_per_word", -1), ("dup_line_share", -1), ("repeat_share", -1),
    ("capital_share", -1), ("digit_share", 0), ("distinct_share", 0), ("adjacent_share", -1), ("exclaim_per_word", -1),
    ("words_per_line", 0), ("stops_per_word", 0),
]

WINDOW = 5


def repeat_words(words: list[bytes]) -> int:
    """Words that lie in a window of five words which the text has twice or more."""
    windows = list(zip(words, words[1:], words[2:], words[3:], words[4:], strict=False))
    if len(set(windows)) == len(windows):
        return 0
    often = Counter(windows)
    covered = upto = 0
    for i, w in enumerate(windows):
        if often[w] > 1:
            covered += i + WINDOW - max(i, upto)
            upto = i + WINDOW
    return covered


def statistics(text: str) -> tuple[list[int], list[float]]:
    """(base counts, features) of one text.  Words are what stands between blanks and the control characters 9 to 13."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    without = lambda drop: len(raw) - len(raw.translate(None, drop))
    chars = len(text) - without(b" \t\n\x0b\x0c\r")
    symbols = without(b"#*$%&|<>")
    lines = [x for x in raw.split(b"\n") if x.strip()]
    dups = len(lines) - len(set(lines))
    repeats = repeat_words(words)
    per_word, per_char = 1 / max(n, 1), 1 / max(chars, 1)
    features = [
        float(np.log1p(n)), chars * per_word, symbols * per_word, dups / max(len(lines), 1), repeats * per_word,
        without(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ") * per_char, without(b"0123456789") * per_char, len(set(words)) * per_word,
        sum(map(eq, words, words[1:])) * per_word, raw.count(b"!") * per_word, n / max(len(lines), 1), without(b".,;:?") * per_word,
    ]
    return [n, chars, symbols, dups, repeats], features


def base_failed(n_words: int, n_repeat_words: int) -> bool:
    return n_words < 10 or 100 * n_repeat_words > 20 * n_words


@dataclass
class Trees:
    """All nodes of all trees in flat arrays; a leaf leads to itself."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    start: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        if not len(self.roots) or not len(x):
            return np.full(len(x), self.start)
        at = np.broadcast_to(self.roots, (len(x), len(self.roots)))
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            at = np.where(x[rows, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
        return self.start + self.value[at].sum(1)

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))


def fit_trees(
    x: np.ndarray, y: np.ndarray, signs: list[int], rounds: int = 60, depth: int = 3, rate: float = 0.2,
    bins: int = 64, least: float = 1.0,
) -> Trees:
    """Logistic boosting on histograms.  ``signs`` has -1, 0 or 1 by feature: the margin falls, is free or rises with it.

    Splits that break a sign are not taken, and values of a subtree stay on their side of the split's middle, so the sum
    of trees is monotone.  With one class only, there are no trees and the start value is that class.
    """
    share = np.clip(y.mean() if len(y) else 1.0, 1e-3, 1 - 1e-3)
    start = float(np.log(share / (1 - share)))
    nodes: list[list[float]] = []  # feature, threshold, left, right, value
    roots: list[int] = []
    if len(y) and 0 < y.sum() < len(y):
        cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins)[1:-1])) for f in range(x.shape[1])]
        binned = np.stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)], axis=1)
        margin = np.full(len(y), start)

        def leaf(g: float, h: float, low: float, high: float) -> float:
            return float(np.clip(-g / (h + least), low, high))

        for _ in range(rounds):
            p = 1 / (1 + np.exp(-margin))
            grad, hess = p - y, p * (1 - p)
            roots.append(len(nodes))
            nodes.append([0, 0.0, len(nodes), len(nodes), 0.0])
            open_nodes = [(roots[-1], np.arange(len(y)), -np.inf, np.inf, 0)]
            step = np.zeros(len(y))
            while open_nodes:
                node, rows, low, high, level = open_nodes.pop()
                g, h = grad[rows].sum(), hess[rows].sum()
                value = leaf(g, h, low, high)
                best = (1e-6, -1, 0, 0.0)
                for f in range(x.shape[1]) if level < depth else ():
                    k = len(cuts[f])
                    if not k:
                        continue
                    gl = np.cumsum(np.bincount(binned[rows, f], grad[rows], k + 1))[:-1]
                    hl = np.cumsum(np.bincount(binned[rows, f], hess[rows], k + 1))[:-1]
                    vl, vr = np.clip(-gl / (hl + least), low, high), np.clip(-(g - gl) / (h - hl + least), low, high)
                    gain = -(gl * vl + 0.5 * (hl + least) * vl**2) - ((g - gl) * vr + 0.5 * (h - hl + least) * vr**2)
                    gain = gain + (g * value + 0.5 * (h + least) * value**2)
                    gain[(signs[f] * (vr - vl) < 0) | (hl < 1e-3) | (h - hl < 1e-3)] = -np.inf
                    b = int(np.argmax(gain))
                    if gain[b] > best[0]:
                        best = (float(gain[b]), f, b, (vl[b] + vr[b]) / 2)
                _, f, b, middle = best
                if f < 0:
                    nodes[node][4] = rate * value
                    step[rows] = rate * value
                    continue
                goes_left = binned[rows, f] <= b
                children = []
                for side, rows_of in ((0, rows[goes_left]), (1, rows[~goes_left])):
                    lo, hi = low, high
                    if signs[f]:
                        if (signs[f] > 0) == (side == 0):
                            hi = min(hi, middle)
                        else:
                            lo = max(lo, middle)
                    children.append(len(nodes))
                    nodes.append([0, 0.0, len(nodes), len(nodes), 0.0])
                    open_nodes.append((children[-1], rows_of, lo, hi, level + 1))
                nodes[node] = [f, float(cuts[f][b]), *children, 0.0]
            margin += step
    flat = np.array(nodes).reshape(-1, 5)
    return Trees(
        flat[:, 0].astype(np.int32), flat[:, 1], flat[:, 2].astype(np.int32), flat[:, 3].astype(np.int32), flat[:, 4],
        np.array(roots, np.int32), depth, start,
    )


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", rows: int = FIT_ROWS) -> Trees:
    """Trees from labelled documents.  Labels are read whole, the ``rows`` of them with the smallest id hashes are used.

    At most ``rows`` ids are broadcast and as many rows of numbers come to the driver.  A document with several labels
    takes the smallest; labels without a document and null labels are left out.
    """
    given = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).cast("long").alias("_id")).agg(F.min(label).alias("_y"))
    sample = given.orderBy(F.xxhash64("_id"), "_id").limit(rows)
    texts = docs.select(F.col(key).cast("long").alias("_id"), F.col(text).cast("string").alias("_text"))
    chosen = texts.join(F.broadcast(sample), "_id").select("_text", F.col("_y").cast("double").alias("_y"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [statistics(batch.column(0)[i].as_py() or "")[1] for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.float64())), batch.column(1)], names=["x", "y"])

    got = chosen.mapInArrow(run, "x array<double>, y double").collect()
    # the order of the rows must not decide ties
    table = np.array(sorted([*r["x"], r["y"]] for r in got)).reshape(-1, len(FEATURES) + 1)
    return fit_trees(table[:, :-1], (table[:, -1] > 0).astype(float), [s for _, s in FEATURES])


def judged(texts: list[str], trees: Trees, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(base counts, base_failed, probability, kept) of some texts."""
    both = [statistics(t) for t in texts]
    base = np.array([b for b, _ in both], np.int64).reshape(-1, len(BASE))
    good = trees.probability(np.array([f for _, f in both]).reshape(-1, len(FEATURES)))
    failed = (base[:, 0] < 10) | (100 * base[:, 4] > 20 * base[:, 0])
    return base, failed, good, ~failed & (good >= least)


def quality(docs: DataFrame, trees: Trees, key: str = "doc_id", text: str = "text", least: float = 0.5) -> DataFrame:
    """Key, base counts, base_failed, score and kept of every document; kept is false if the base rules fail.

    Null and empty texts have no words and fail the base rules.  Every input row gives a row; other columns are not read.
    """
    slim = docs.select(F.col(key).alias("_key"), F.col(text).cast("string").alias("_text"))
    kind = slim.schema["_key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in text_groups(batch.column(1)):
                base, failed, good, kept = judged(texts, trees, least)
                columns = [*(pa.array(base[:, i]) for i in range(len(BASE))), pa.array(failed), pa.array(kept), pa.array(good)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(texts)), *columns], names=["_key", *BASE, "base_failed", "kept", "score"]
                )

    schema = ", ".join([f"_key {kind}", *(f"{c} long" for c in BASE), "base_failed boolean", "kept boolean", "score double"])
    return slim.mapInArrow(run, schema).withColumnRenamed("_key", key)


def keep_good(docs: DataFrame, trees: Trees, text: str = "text", least: float = 0.5) -> DataFrame:
    """The rows of ``docs``, with all their columns, that the rules keep."""
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [judged(texts, trees, least)[3] for _, texts in text_groups(batch.column(at))]
            if kept:
                yield batch.filter(pa.array(np.concatenate(kept)))

    return docs.mapInArrow(run, docs.schema)
