"""Similarity join on word shingles by T-occurrence search.

Texts with the same word sequence form one class.  Shingles that only one class has cannot be shared; a class whose shared
shingles are fewer than the overlap it needs is out.  The rest is an inverted index: with T the overlap that a class needs,
the T - 1 longest of its lists (less a few) are set aside, the short ones are merged with a heap, and what reaches the
reduced count is probed in the long ones by binary search (DivideSkip).  Lists follow one global order, from rare to
common, so only the short parts of both sides meet.

Hot groups: copies are one class from the start; a group of near copies is first linked to one central member per list,
so that only members that are still apart are searched, each in blocks of bounded size that answer all their queries and
give out links alone; shingles that many documents of a task have travel in blobs by task and are not gathered anywhere.
"""

from __future__ import annotations

import heapq
import itertools
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablescope.llm.common import parts_for, text_groups, written
from tablescope.llm.components import components

U = np.uint64
#: Shingles that a task holds before it deals them out.
FLUSH = 1_500_000
#: Documents of one flush from which a shingle is hot.
HOT = 64
#: Input bytes per index partition (more with larger executors), and entries of the inverted index of one block.
BYTES_EACH = 8 << 20
BLOCK_ENTRIES = 2_000_000
#: Occurrences in short lists that a pair must reach beyond the first.
EXTRA = 2
#: Stands for a null key, which comes after all others.
NO_KEY = (1 << 63) - 1

_BASE = 0x9E3779B97F4A7C15 | 1
_WEIGHTS = [0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB]
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
_POWERS: list[np.ndarray] = []


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(33))) * U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> U(29))) * U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U(32))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, 1 << 16)
        _POWERS[:] = [
            np.cumprod(np.concatenate([np.ones(1, U), np.full(size - 1, b, U)]), dtype=U)
            for b in (_BASE, pow(_BASE, -1, 1 << 64))
        ]
    return _POWERS[0], _POWERS[1]


def word_hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(hash, start) of every word of lower-cased bytes."""
    if len(raw) > 4_000_000:  # in pieces that end at white space
        hashes, starts, at = [], [], 0
        while at < len(raw):
            end = min(len(raw), at + 2_000_000)
            while end < len(raw) and not _IS_SPACE[raw[end]]:
                end += 1
            h, s = _word_hashes(raw[at:end])
            hashes.append(h)
            starts.append(s + at)
            at = end
        return np.concatenate(hashes), np.concatenate(starts)
    return _word_hashes(raw)


def _word_hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    b = np.frombuffer(raw, np.uint8)
    inside = np.concatenate([[False], ~_IS_SPACE[b], [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    up, down = _powers(len(b) + 1)
    sums = np.concatenate([np.zeros(1, U), np.cumsum((b.astype(U) + U(1)) * up[: len(b)], dtype=U)])
    return _mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(U)), starts


def shingle_sets(texts: list[str], words: int = 5) -> tuple[list[np.ndarray], list[int]]:
    """Per text: sorted distinct shingle hashes, and a hash of the whole word sequence (0 without words).

    A-Z are lower-cased; with fewer words than a shingle has the whole sequence is one shingle.
    """
    raws = [t.encode("utf-8", "surrogatepass").lower() for t in texts]
    joined = b"\n".join(raws) + b"\n"
    hashes, starts = word_hashes(joined)
    ends = np.cumsum(np.fromiter((len(r) + 1 for r in raws), np.int64, len(raws)))
    cuts = np.concatenate([[0], np.searchsorted(starts, ends)])
    k = words
    rolled = np.zeros(max(0, len(hashes) - k + 1), U)
    for j in range(k):
        rolled += hashes[j : j + len(rolled)] * U(_WEIGHTS[j % 5] + 2 * (j // 5))
    rolled = _mixed(rolled)
    sets, classes = [], []
    for i, raw in enumerate(raws):
        a, b = int(cuts[i]), int(cuts[i + 1])
        if a == b:
            sets.append(np.zeros(0, U))
            classes.append(0)
            continue
        if b - a < k:
            short = hashes[a:b] * np.array(_WEIGHTS * (k // 5 + 1), U)[: b - a]
            sets.append(_mixed(short.sum(dtype=U, keepdims=True) + U(b - a)))
        else:
            sets.append(np.unique(rolled[a : b - k + 1]))
        classes.append(xxhash.xxh3_64_intdigest(b" ".join(raw.split())) or 1)
    return sets, classes


def needed(n: np.ndarray | int, percent: int) -> np.ndarray | int:
    """Least overlap of a set of n with any set that it links to."""
    return -(-n * percent // 100)


# --- blobs: a table of classes and, per entry, the place in it, a shingle and a code of its frequency ---


def pack(classes: np.ndarray, shingles: np.ndarray, codes: np.ndarray | None = None) -> bytes:
    """Entries as bytes; shingles must be sorted when there are no codes."""
    names, place = np.unique(classes, return_inverse=True)
    wide = np.uint16 if len(names) <= 1 << 16 else np.uint32
    head = np.array([len(names), len(shingles), wide().itemsize, codes is not None], np.uint32)
    parts = [head.tobytes(), names.astype(U).tobytes(), place.astype(wide).tobytes()]
    if codes is None:
        high = (shingles >> U(32)).astype(np.uint32)
        parts += [np.diff(high, prepend=np.uint32(0)).astype(np.uint32).tobytes(), (shingles & U(0xFFFFFFFF)).astype(np.uint32).tobytes()]
    else:
        parts += [shingles.tobytes(), codes.astype(np.uint16).tobytes()]
    return b"".join(parts)


def unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    n_names, n, width, coded = np.frombuffer(blob, np.uint32, 4).tolist()
    at = 16
    names = np.frombuffer(blob, U, n_names, at)
    at += 8 * n_names
    place = np.frombuffer(blob, np.uint16 if width == 2 else np.uint32, n, at)
    at += width * n
    if coded:
        return names[place], np.frombuffer(blob, U, n, at), np.frombuffer(blob, np.uint16, n, at + 8 * n)
    high = np.cumsum(np.frombuffer(blob, np.uint32, n, at), dtype=np.uint32)
    low = np.frombuffer(blob, np.uint32, n, at + 4 * n)
    return names[place], (high.astype(U) << U(32)) | low, None


def code_of(df: np.ndarray) -> np.ndarray:
    """Document frequency on a fine logarithmic scale: the global order's first key."""
    return np.minimum(65_000, np.log2(df.astype(float)) * 256).astype(np.uint16)


def _place(values: np.ndarray, parts: int) -> np.ndarray:
    return ((values >> U(32)) * U(parts)) >> U(32)


# kinds of rows between the stages
DOC, ENTRIES, HOT_LIST, HOT_DF, OF_CLASS = range(5)
ROWS = "kind int, part int, id long, mark long, cls long, n int, blob binary"


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
    columns = list(zip(*rows, strict=True)) if rows else [[]] * 7
    return pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["kind", "part", "id", "mark", "cls", "n", "blob"]
    )


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _read_shingles(docs: DataFrame, key: str, text: str, words: int, parts: int) -> DataFrame:
    """One row per document, and the shingles of each class dealt out by range of the hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        held: list[np.ndarray] = []
        owners: list[int] = []

        def flush() -> pa.RecordBatch:
            shingles = np.concatenate(held)
            classes = np.repeat(np.array(owners, U), [len(x) for x in held])
            order = np.argsort(shingles)
            shingles, classes = shingles[order], classes[order]
            first = np.flatnonzero(np.concatenate([[True], shingles[1:] != shingles[:-1]]))
            size = np.diff(np.append(first, len(shingles)))
            out = []
            is_hot = np.repeat(size >= HOT, size)
            for a, n in zip(first[size >= HOT].tolist(), size[size >= HOT].tolist(), strict=True):
                h = int(shingles[a])
                out.append((HOT_LIST, (a + h) % parts, _signed(h), None, None, n, classes[a : a + n].tobytes()))
            shingles, classes = shingles[~is_hot], classes[~is_hot]
            ends = np.searchsorted(_place(shingles, parts), np.arange(parts + 1, dtype=U))
            for p in range(parts):
                a, b = int(ends[p]), int(ends[p + 1])
                if a < b:
                    out.append((ENTRIES, p, None, None, None, b - a, pack(classes[a:b], shingles[a:b])))
            held.clear()
            owners.clear()
            return _rows(out)

        size = 0
        for batch in batches:
            keys, marks = batch.column(0), batch.column(1)
            for at, texts in text_groups(batch.column(2)):
                sets, classes = shingle_sets(texts, words)
                rows = []
                for i, (s, c) in enumerate(zip(sets, classes, strict=True)):
                    # rows of documents only pass through: copies are spread by their place
                    rows.append((DOC, (c + at + i) % parts, keys[at + i].as_py(), marks[at + i].as_py(), _signed(c) if c else None, len(s), None))
                    if c and c not in seen:
                        seen.add(c)
                        held.append(s)
                        owners.append(c)
                        size += len(s)
                yield _rows(rows)
                if size >= FLUSH:
                    yield flush()
                    size = 0
        if held:
            yield flush()

    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    slim = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(NO_KEY)).alias("id"), F.xxhash64(whole).alias("mark"), whole.alias("text"))
    return slim.mapInArrow(run, ROWS)


def _count(rows: DataFrame, parts: int) -> DataFrame:
    """Of the entries those that two classes or more have, with their frequency, dealt out by class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blobs: list[bytes] = []
        hot: dict[int, int] = {}
        for batch in batches:
            kind = batch.column(0).to_numpy()
            for i in np.flatnonzero(kind == ENTRIES).tolist():
                blobs.append(batch.column(6)[i].as_py())
            for i in np.flatnonzero(kind == HOT_DF).tolist():
                h = batch.column(2)[i].as_py() % (1 << 64)
                hot[h] = hot.get(h, 0) + batch.column(5)[i].as_py()
            rest = batch.filter(pa.array((kind != ENTRIES) & (kind != HOT_DF)))
            if rest.num_rows:
                yield rest
        if not blobs and not hot:
            return
        both = [unpack(b)[:2] for b in blobs]
        blobs.clear()
        classes = np.concatenate([np.zeros(0, U), *(c for c, _ in both)])
        shingles = np.concatenate([np.zeros(0, U), *(s for _, s in both)])
        del both
        order = np.argsort(shingles)
        shingles, classes = shingles[order], classes[order]
        hot_names = np.array(sorted(hot), U)
        again = np.zeros(len(shingles), bool)
        if len(shingles):
            same = shingles[1:] == shingles[:-1]
            again[1:] |= same
            again[:-1] |= same
            again |= np.isin(shingles, hot_names)
        shingles, classes = shingles[again], classes[again]
        order = np.lexsort((classes, shingles))
        shingles, classes = shingles[order], classes[order]
        if len(shingles):  # a class that several tasks met counts once
            fresh = np.concatenate([[True], (shingles[1:] != shingles[:-1]) | (classes[1:] != classes[:-1])])
            shingles, classes = shingles[fresh], classes[fresh]
        names, place, df = np.unique(shingles, return_inverse=True, return_counts=True)
        hot_counts = np.array([hot[int(h)] for h in hot_names], np.int64)
        total = df.astype(np.int64)
        where = np.searchsorted(names, hot_names)
        met = np.zeros(len(hot_names), bool)
        if len(names):
            met = names[np.minimum(where, len(names) - 1)] == hot_names
        total[where[met]] += hot_counts[met]
        own = np.zeros(len(hot_names), np.int64)
        own[met] = df[where[met]]
        codes = code_of(hot_counts + own)
        out = [(HOT_DF, 0, _signed(int(h)), None, None, int(c), None) for h, c in zip(hot_names, codes, strict=True)]
        yield _rows(out)
        keep = total[place] >= 2
        shingles, classes, codes = shingles[keep], classes[keep], code_of(total[place[keep]])
        yield _rows(list(_by_class(classes, shingles, codes, parts)))

    return rows.repartition(parts, "part").mapInArrow(run, ROWS)


def _by_class(classes: np.ndarray, shingles: np.ndarray, codes: np.ndarray, parts: int) -> Iterator[tuple]:
    to = classes % U(parts)
    order = np.argsort(to, kind="stable")
    ends = np.searchsorted(to[order], np.arange(parts + 1, dtype=U))
    for p in range(parts):
        at = order[ends[p] : ends[p + 1]]
        if len(at):
            yield (OF_CLASS, p, None, None, None, len(at), pack(classes[at], shingles[at], codes[at]))


def _hot_entries(counted: DataFrame, parts: int) -> DataFrame:
    """Entries of hot shingles, whose lists stay in the blobs of the tasks that met them."""
    hot = counted.where(F.col("kind") == HOT_DF).select("id", F.col("n").alias("code"))
    lists = counted.where(F.col("kind") == HOT_LIST).select("id", "blob").join(hot, "id").select("id", "code", "blob")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            classes, shingles, codes = [np.zeros(0, U)], [np.zeros(0, U)], [np.zeros(0, np.uint16)]
            for i in range(batch.num_rows):
                c = np.frombuffer(batch.column(2)[i].as_py(), U)
                classes.append(c)
                shingles.append(np.full(len(c), batch.column(0)[i].as_py() % (1 << 64), U))
                codes.append(np.full(len(c), batch.column(1)[i].as_py(), np.uint16))
            yield _rows(list(_by_class(*map(np.concatenate, (classes, shingles, codes)), parts)))

    return lists.mapInArrow(run, ROWS)


def _survivors(counted: DataFrame, classes: DataFrame, parts: int, percent: int) -> DataFrame:
    """(cls, n, shared) of the classes with enough shared shingles; shared: their hashes from rare to common."""
    parted = classes.select(
        F.lit(DOC).alias("kind"), F.expr(f"cast(pmod(pmod(cls, {parts}) + if(cls < 0, {(1 << 64) % parts}, 0), {parts}) as int)").alias("part"),
        F.lit(None).cast("long").alias("id"), F.lit(None).cast("long").alias("mark"), "cls", "n", F.lit(None).cast("binary").alias("blob"),
    )
    entries = counted.where(F.col("kind") == OF_CLASS).unionByName(_hot_entries(counted, parts)).unionByName(parted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts_of: list[tuple] = []
        names, sizes = [], []
        for batch in batches:
            kind = batch.column(0).to_numpy()
            for i in np.flatnonzero(kind == OF_CLASS).tolist():
                parts_of.append(unpack(batch.column(6)[i].as_py()))
            docs = batch.filter(pa.array(kind == DOC))
            names.append(docs.column(4).to_numpy().astype(U))
            sizes.append(docs.column(5).to_numpy())
        if not parts_of:
            return
        cls, shingle, code = (np.concatenate(x) for x in zip(*parts_of, strict=True))
        parts_of.clear()
        known = np.concatenate(names)
        order = np.argsort(known)
        known, size = known[order], np.concatenate(sizes)[order]
        order = np.lexsort((shingle, code, cls))
        cls, shingle, code = cls[order], shingle[order], code[order]
        fresh = np.concatenate([[True], (cls[1:] != cls[:-1]) | (shingle[1:] != shingle[:-1])])
        cls, shingle = cls[fresh], shingle[fresh]
        first = np.flatnonzero(np.concatenate([[True], cls[1:] != cls[:-1]]))
        ends = np.append(first[1:], len(cls))
        n = size[np.searchsorted(known, cls[first])].astype(np.int64)
        keep = np.flatnonzero(ends - first >= needed(n, percent))
        for some in np.array_split(keep, max(1, len(keep) // 1000)):
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(cls[first[some]].astype(np.int64)), pa.array(n[some].astype(np.int32)),
                    pa.array([shingle[first[i] : ends[i]].tobytes() for i in some], pa.binary()),
                ],
                names=["cls", "n", "shared"],
            )

    return entries.repartition(parts, "part").mapInArrow(run, "cls long, n int, shared binary")


def _short_lists(survivors: DataFrame, percent: int, extra: int) -> DataFrame:
    """(h, cls, n, least, share) for the short lists of each class: all but the T - 1 - extra longest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            lists = [np.frombuffer(x, np.int64) for x in batch.column(2).to_pylist()]
            n = batch.column(1).to_numpy().astype(np.int64)
            shared = np.array([len(x) for x in lists])
            t = needed(n, percent)
            short = np.minimum(shared, shared - t + 1 + extra)
            for some in np.array_split(np.arange(len(lists)), max(1, int(short.sum()) // 100_000)):
                k = short[some]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate([np.zeros(0, np.int64), *(lists[i][: short[i]] for i in some)])),
                        pa.array(np.repeat(batch.column(0).to_numpy()[some], k)), pa.array(np.repeat(n[some], k).astype(np.int32)),
                        pa.array(np.repeat(np.minimum(t[some], 1 + extra), k).astype(np.int32)),
                        pa.array(np.repeat(shared[some] / n[some], k)),
                    ],
                    names=["h", "cls", "n", "least", "share"],
                )

    return survivors.mapInArrow(run, "h long, cls long, n int, least int, share double")


def _linked(pairs: DataFrame, survivors: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (a, b) whose sets reach the similarity: the long lists are probed by binary search."""
    a = survivors.select(F.col("cls").alias("a"), F.col("n").alias("na"), F.col("shared").alias("sa"))
    b = survivors.select(F.col("cls").alias("b"), F.col("n").alias("nb"), F.col("shared").alias("sb"))
    both = pairs.join(a, "a").join(b, "b").select("a", "b", "na", "nb", "sa", "sb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[int | None, np.ndarray] = (None, np.zeros(0, U))
        for batch in batches:
            good = []
            ids_a, ids_b, na, nb = (batch.column(i).to_numpy().tolist() for i in range(4))
            for i in range(batch.num_rows):
                if last[0] != ids_b[i]:
                    last = (ids_b[i], np.sort(np.frombuffer(batch.column(5)[i].as_py(), U)))
                probe = np.frombuffer(batch.column(4)[i].as_py(), U)
                inside = last[1]
                at = np.minimum(np.searchsorted(inside, probe), len(inside) - 1)
                overlap = int((inside[at] == probe).sum())
                good.append(100 * overlap >= percent * (na[i] + nb[i] - overlap))
            yield batch.filter(pa.array(good, pa.bool_())).select(["a", "b"])

    return both.mapInArrow(run, "a long, b long")


def divide_skip(lists: Iterable[np.ndarray], least: int) -> list[int]:
    """Ids that occur in at least ``least`` of the sorted lists, by a heap merge that skips.

    When the ids on top of the heap are too few, the smallest lists move on at once to the first id that could still
    reach the count, by binary search.
    """
    lists = [x for x in lists if len(x)]
    at = [0] * len(lists)
    heap = [(int(x[0]), k) for k, x in enumerate(lists)]
    heapq.heapify(heap)
    found = []
    while len(heap) >= least:
        top = heap[0][0]
        popped = []
        while heap and heap[0][0] == top:
            popped.append(heapq.heappop(heap)[1])
        if len(popped) >= least:
            found.append(top)
            target = None
        else:
            while len(popped) < least - 1 and heap:
                popped.append(heapq.heappop(heap)[1])
            target = heap[0][0] if heap else None
        for k in popped:
            if target is None:
                at[k] += 1
            else:
                at[k] += max(0 if int(lists[k][at[k]]) >= target else 1, int(np.searchsorted(lists[k][at[k] :], target)))
            if at[k] < len(lists[k]):
                heapq.heappush(heap, (int(lists[k][at[k]]), k))
    return found


def t_occurrence(query: np.ndarray, keys: np.ndarray, owners: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray]:
    """(owner, overlap) of the sets that share at least t of the query's elements.

    The inverted lists are slices of ``owners``, which is ordered by (keys, owners).  The longest lists, fewer than t, are
    set aside; ids that occur often enough in the short ones are probed in the long ones.
    """
    low, high = np.searchsorted(keys, query, "left"), np.searchsorted(keys, query, "right")
    met = np.flatnonzero(high > low)
    if len(met) < t:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    met = met[np.argsort((high - low)[met], kind="stable")]
    longest = int((high - low)[met[-1]])
    aside = min(t - 1, int(t / (0.0085 * np.log2(longest + 1) + 1)))
    lists = [owners[low[i] : high[i]] for i in met]
    short, long = lists[: len(lists) - aside], lists[len(lists) - aside :]
    found = np.array(divide_skip(short, t - aside), np.int64)
    if not len(found):
        return found, found
    overlap = np.zeros(len(found), np.int64)
    for ids in (*short, *long):
        at = np.minimum(np.searchsorted(ids, found), len(ids) - 1)
        overlap += ids[at] == found
    return found[overlap >= t], overlap[overlap >= t]


def _routes(short: DataFrame) -> DataFrame:
    """(cls, hub, sub): the blocks that may hold a partner of a class in another component.

    ``short`` has h, cls, least, comp, hub and sub.  In each list the members of the largest component need not ask: of
    two members in different components one is outside it.  A block must meet the class in as many of its short lists as
    a partner would.
    """
    in_list = short.groupBy("h", "comp").agg(F.count("*").alias("k"))
    largest = in_list.groupBy("h").agg(F.count("*").alias("comps"), F.max(F.struct("k", "comp")).alias("top"))
    mixed = largest.where("comps > 1").select("h", F.col("top.comp").alias("top"))
    open_lists = written(short.join(mixed, "h"), "open-lists")
    asking = open_lists.where("comp <> top").select("cls").distinct()
    wants = open_lists.join(asking, "cls").select("h", "cls", "least")
    posts = open_lists.select("h", "hub", "sub").distinct()
    met = wants.join(posts, "h").groupBy("cls", "hub", "sub").agg(F.count("*").alias("k"), F.min("least").alias("least"))
    return met.where("k >= least").select("cls", "hub", "sub")


def _searched(routes: DataFrame, homes: DataFrame, survivors: DataFrame, parts: int, percent: int) -> DataFrame:
    """Pairs (a, b) in different components that link: each block's index answers the queries sent to it.

    ``homes`` has cls, comp, hub and sub of every survivor.  A query is linked once with each component of a block.
    """
    used = routes.select("hub", "sub").distinct()
    indexed = homes.join(used, ["hub", "sub"]).withColumn("asks", F.lit(0))
    asked = routes.join(homes.select("cls", "comp"), "cls").withColumn("asks", F.lit(1))
    names = ["hub", "sub", "asks", "cls", "comp"]
    rows = indexed.select(*names).unionByName(asked.select(*names)).join(survivors, "cls").select(*names, "n", "shared")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[tuple]:
            for batch in batches:
                yield from zip(*(batch.column(i).to_pylist() for i in range(7)), strict=True)

        a: list[int] = []
        b: list[int] = []
        for _, block in itertools.groupby(each(), key=lambda r: r[:2]):
            ids, comps, sizes, sets = [], [], [], []
            keys = owners = None
            for _, _, asks, cls, comp, n, shared in block:
                shingles = np.frombuffer(shared, U)
                if not asks:
                    ids.append(cls)
                    comps.append(comp)
                    sizes.append(n)
                    sets.append(shingles)
                    continue
                if keys is None:
                    owners = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
                    keys = np.concatenate([np.zeros(0, U), *sets])
                    order = np.lexsort((owners, keys))
                    keys, owners = keys[order], owners[order]
                    sets.clear()
                linked = {comp}
                for x, overlap in zip(*t_occurrence(shingles, keys, owners, int(needed(n, percent))), strict=True):
                    if comps[x] not in linked and 100 * overlap >= percent * (n + sizes[x] - overlap):
                        linked.add(comps[x])
                        a.append(cls)
                        b.append(ids[x])
            if len(a) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
                a, b = [], []
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    dealt = rows.repartition(parts, "hub", "sub").sortWithinPartitions("hub", "sub", "asks")
    return dealt.mapInArrow(run, "a long, b long")


def _classes_and_roots(docs: DataFrame, key: str, text: str, words: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(key, mark, cls, n) of every row, and (cls, first, root) of every class; first is its least (key, mark)."""
    parts = parts_for(docs, BYTES_EACH)
    read = _read_shingles(docs, key, text, words, parts)
    # what a task knows of a hot shingle goes to the shingle's partition as a count, the list itself stays spread
    spread = read.withColumn(
        "both", F.when(F.col("kind") == HOT_LIST, F.array(F.lit(HOT_LIST), F.lit(HOT_DF))).otherwise(F.array("kind"))
    ).select(F.explode("both").alias("kind"), "part", "id", "mark", "cls", "n", "blob")
    high = F.shiftrightunsigned("id", 32)
    home = F.shiftrightunsigned(high * parts, 32).cast("int")
    is_df = F.col("kind") == HOT_DF
    spread = spread.withColumn("part", F.when(is_df, home).otherwise(F.col("part"))).withColumn(
        "blob", F.when(is_df, F.lit(None)).otherwise(F.col("blob"))
    )
    counted = written(_count(spread, parts), "shingles")
    base = counted.where(F.col("kind") == DOC).select(F.col("id").alias("_key"), F.col("mark").alias("_mark"), "cls", "n")
    classes = base.where(F.col("cls").isNotNull()).groupBy("cls").agg(F.min(F.struct("_key", "_mark")).alias("first"), F.min("n").alias("n"))
    survivors = written(_survivors(counted, classes, parts, percent), "survivors")
    short = written(_short_lists(survivors, percent, EXTRA), "short-lists")

    # one central member of each list first
    central = short.groupBy("h").agg(F.max(F.struct("share", "cls", "n")).alias("c")).select("h", F.col("c.cls").alias("a"), F.col("c.n").alias("na"))
    met = short.select("h", F.col("cls").alias("b"), F.col("n").alias("nb")).join(central, "h")
    star = written(met.groupBy("a", "b", "na", "nb").agg(F.count("*").alias("k")), "stars")
    tried = star.where(f"a <> b and least(na, nb) * 100 >= greatest(na, nb) * {percent}").select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")
    )
    sure = written(_linked(tried.distinct(), survivors, percent), "links")
    roots = components(sure).select(F.col("node").alias("cls"), F.col("root").alias("comp"))

    # then all that is still apart: classes live in blocks around the member that is central to most of their lists
    hubs = star.groupBy(F.col("b").alias("cls")).agg(F.max(F.struct("k", "a")).alias("h")).select("cls", F.col("h.a").alias("hub"))
    sized = survivors.select("cls", (F.length("shared") / 8).alias("w")).join(hubs, "cls")
    weight = sized.groupBy("hub").agg(F.ceil(F.sum("w") / BLOCK_ENTRIES).alias("subs"))
    homes = hubs.join(weight, "hub").join(roots, "cls", "left").select(
        "cls", F.coalesce("comp", "cls").alias("comp"), "hub", F.pmod(F.xxhash64("cls"), "subs").alias("sub")
    )
    homes = written(homes, "homes")
    routes = written(_routes(short.select("h", "cls", "least").join(homes, "cls")), "routes")
    rest = written(_searched(routes, homes, survivors, parts, percent), "links")
    whole = components(sure.unionByName(rest))

    of_class = classes.join(whole.select(F.col("node").alias("cls"), "root"), "cls", "left").select(
        "cls", "first", F.coalesce("root", "cls").alias("root")
    )
    return base, of_class


def join(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """Key, n_shingles and component_id (smallest key reachable by links, itself included) of every document.

    Two documents link when their sets of distinct word shingles have 100 * intersection >= percent * union.  Null,
    empty and wordless texts have no shingles and link with nothing.  Equal texts, also rows repeated whole, link; a null
    key counts as larger than any other, so component_id is null only where no linked document has a key.  Columns other
    than the two named are not read.  Texts and shingles are told apart by 64-bit hashes.

    Texts are read once; their shingles are shuffled once.
    """
    base, of_class = _classes_and_roots(docs, key, text, words, percent)
    least = of_class.groupBy("root").agg(F.min("first._key").alias("component_id"))
    of_class = of_class.join(least, "root").select("cls", "component_id")
    known = lambda c: F.when(c != NO_KEY, c)
    return base.join(of_class, "cls", "left").select(
        known(F.col("_key")).alias(key), F.col("n").cast("long").alias("n_shingles"),
        known(F.coalesce("component_id", "_key")).alias("component_id"),
    )


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs, with all their columns, that come first in their component, one row for each.

    First is the smallest key, for equal keys the smallest hash of the text; of rows repeated whole one stays.  Texts
    without words link with nothing and stay.
    """
    _, of_class = _classes_and_roots(docs, key, text, words, percent)
    first = of_class.groupBy("root").agg(F.min("first").alias("f")).select("f._key", "f._mark")
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    has_words = whole.rlike("[^\\x20\\x09-\\x0D]")
    # the row travels as one value, so that its columns may have any names
    named = docs.where(has_words).select(
        F.coalesce(F.col(key).cast("long"), F.lit(NO_KEY)).alias("_key"), F.xxhash64(whole).alias("_mark"), F.struct(*docs.columns).alias("row")
    )
    kept = named.join(first, ["_key", "_mark"]).dropDuplicates(["_key", "_mark"]).select("row.*")
    return kept.unionByName(docs.where(~has_words))
