"""Removal of long repeated byte strings by suffix sorting.

Every 100-byte window that also starts earlier is removed.  Windows meet through anchors: the 32-byte string with the least
hash in a window (the leftmost of equal ones) depends on the window alone, so equal windows have equal anchors, and
neighbouring windows mostly share one.  Anchors that occur once are dropped; the windows of the others are brought
together by anchor, runs of windows with equal text are drawn together, and where runs differ their suffixes are sorted
deep-shallow: multikey quicksort on eight-byte characters to a shallow depth, then blind tries for what is still tied.

Hot groups: equal texts are found by digest first and only the first of them takes part; anchors that a task meets twice
stay with the task, which tells the anchor's partition just that; equal runs of a task go on once.  An anchor that still
has many runs is not one group: its windows are dealt out by their bytes, equal ones of a task once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablescope.llm.common import parts_for, text_groups, written

U = np.uint64
GRAM = 32
#: Bytes of a step of vectorised work, and bits of a position in it.
STEP, POSITION_BITS = 400_000, 20
FLUSH = 300_000
BYTES_EACH = 8 << 20
#: Bytes that the multikey quicksort looks at before blind tries take over.
SHALLOW = 24
#: Bytes of runs that a task remembers to draw equal ones together.
HELD_BYTES = 16 << 20
#: Bytes of differing runs that are sorted at once.
SORTED_BYTES = 500_000
#: Runs of an anchor up to which they are brought together in one task; of larger anchors the windows are dealt out.
HOT_RUNS = 10_000
#: Stands for a null key, which comes after all others.
NO_KEY = (1 << 63) - 1

_BYTE = np.random.default_rng(100).integers(1, 1 << 63, 256, dtype=np.int64).astype(U)
_MULTIPLY = [U(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def gram_hashes(b: np.ndarray) -> np.ndarray:
    """A hash of the GRAM bytes from each position, by doubling."""
    h, width = _BYTE[b], 1
    for m in _MULTIPLY:
        h = h[:-width] * m + h[width:]
        width *= 2
    h ^= h >> U(31)
    h *= U(0xFF51AFD7ED558CCD)
    h ^= h >> U(33)
    return h


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    have = 1
    while have * 2 <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[: len(x) - (width - have)], x[width - have :]) if have < width else x


def anchors(raw: bytes, ends: np.ndarray, length: int, step: int = STEP) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, position, first window, last window) of the anchors of texts laid end to end; windows stay within a text.

    Work goes in steps of that many bytes; an anchor whose windows lie in two steps is still one entry, so that a text has
    the same entries wherever it lies.
    """
    b = np.frombuffer(raw, np.uint8)
    out: list[tuple[np.ndarray, ...]] = []
    step -= length
    for at in range(0, max(1, len(b) - length + 1), step):
        piece = b[at : at + step + length - 1]
        if len(piece) < length:
            break
        h = gram_hashes(piece)
        mask = U((1 << POSITION_BITS) - 1)
        least = sliding_min((h & ~mask) | np.arange(len(h), dtype=U), length - GRAM + 1)
        place = (least & mask).astype(np.int64)
        n = len(place)
        valid = np.ones(n, bool)
        for e in ends[np.searchsorted(ends, at, "right") : np.searchsorted(ends, at + n + length)].tolist():
            valid[max(0, e - at - length + 1) : max(0, e - at)] = False
        starts = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (valid[1:] != valid[:-1])]))
        stops = np.append(starts[1:], n) - 1
        good = valid[starts]
        starts, stops = starts[good], stops[good]
        x = place[starts]
        # least hashes are small numbers: mixed again, they are spread over all partitions
        name = h[x] * _MULTIPLY[0]
        name = (name ^ (name >> U(32))) * _MULTIPLY[1]
        out.append((name ^ (name >> U(29)), x + at, starts + at, stops + at))
    if not out:
        return np.zeros(0, U), *(np.zeros(0, np.int64) for _ in range(3))
    h, x, lo, hi = (np.concatenate(c) for c in zip(*out, strict=True))
    if not len(x):
        return h, x, lo, hi
    # windows of one anchor that adjoin are of one text
    first = np.flatnonzero(np.concatenate([[True], (x[1:] != x[:-1]) | (lo[1:] != hi[:-1] + 1)]))
    return h[first], x[first], lo[first], hi[np.append(first[1:], len(x)) - 1]


# --- sorting ---


class BlindTrie:
    """Orders strings of ``length`` bytes that begin alike.  Nodes keep only where and by which byte they branch."""

    def __init__(self, buf: bytes, length: int):
        self.buf, self.length = buf, length
        self.root: list | None = None  # leaf: [-1, starts]; branch: [depth, {byte: node}]

    def add(self, start: int) -> None:
        if self.root is None:
            self.root = [-1, [start]]
            return
        buf, node, path = self.buf, self.root, []
        while node[0] >= 0:  # down without looking at what is skipped
            path.append(node)
            node = node[1].get(buf[start + node[0]]) or next(iter(node[1].values()))
        other = node[1][0]
        a = int.from_bytes(buf[start : start + self.length])
        b = int.from_bytes(buf[other : other + self.length])
        if a == b:
            node[1].append(start)
            return
        depth = self.length - 1 - ((a ^ b).bit_length() - 1) // 8
        above, at = None, self.root
        while at[0] >= 0 and at[0] < depth:
            above, at = at, at[1][buf[start + at[0]]] if buf[start + at[0]] in at[1] else None
            if at is None:
                break
        leaf = [-1, [start]]
        if at is None:
            above[1][buf[start + above[0]]] = leaf
        elif at[0] == depth:
            at[1][buf[start + depth]] = leaf
        else:
            branch = [depth, {buf[other + depth]: at, buf[start + depth]: leaf}]
            if above is None:
                self.root = branch
            else:
                above[1][buf[start + above[0]]] = branch

    def groups(self) -> Iterator[list[int]]:
        """Starts of equal strings, in the order of the strings."""
        stack = [self.root] if self.root else []
        while stack:
            node = stack.pop()
            if node[0] < 0:
                yield node[1]
            else:
                stack += [node[1][k] for k in sorted(node[1], reverse=True)]


def sorted_groups(buf: bytes, starts: np.ndarray, length: int) -> Iterator[list[int]]:
    """Suffix starts in the order of their first ``length`` bytes, equal ones together.

    Multikey quicksort: sort by a character of eight bytes, then each group of equal ones by the next character, down to
    SHALLOW bytes.  Groups of two or more that are still together are ordered by a blind trie.
    """
    if not len(starts):
        return
    b = np.frombuffer(buf, np.uint8)
    order = np.arange(len(starts))
    group = np.zeros(len(starts), np.int64)
    tied = np.arange(len(starts))
    for depth in range(0, min(SHALLOW, length - 7), 8):
        at = starts[order[tied]] + depth
        char = np.zeros(len(at), U)
        for j in range(8):
            char = (char << U(8)) | b[at + j].astype(U)
        inner = np.lexsort((char, group[tied]))
        order[tied] = order[tied][inner]
        char = char[inner]
        fresh = np.ones(len(starts), bool)
        fresh[1:] = group[1:] != group[:-1]
        same = np.concatenate([[False], char[1:] == char[:-1]])
        fresh[tied] |= ~same
        group = np.cumsum(fresh) - 1
        size = np.bincount(group)
        tied = np.flatnonzero(size[group] > 1)
        if not len(tied):
            break
    first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    ordered = starts[order].tolist()
    for a, e in zip(first.tolist(), [*first[1:].tolist(), len(starts)], strict=True):
        if e - a == 1:
            yield ordered[a:e]
        else:
            trie = BlindTrie(buf, length)
            for s in ordered[a:e]:
                trie.add(s)
            yield from trie.groups()


def later_windows(runs: list[tuple[bytes, tuple]], length: int) -> list[np.ndarray]:
    """Per run (text, order): which of its windows also start in an earlier run or earlier in itself.

    A run of windows has the text from its first window's start to its last window's end; ``order`` is comparable and
    says which run starts earlier; places in a run go up.
    """
    ranked = sorted(range(len(runs)), key=lambda i: runs[i][1])
    buf = b"".join(runs[i][0] for i in ranked)  # so what starts earlier stands before
    sizes = np.array([len(runs[i][0]) for i in ranked])
    base = np.concatenate([[0], np.cumsum(sizes)])
    starts = np.concatenate([np.arange(base[i], base[i + 1] - length + 1) for i in range(len(runs))])
    later = np.zeros(len(buf), bool)
    for group in sorted_groups(buf, starts, length):
        if len(group) > 1:
            later[group] = True
            later[min(group)] = False
    out: list[np.ndarray] = [later[:0]] * len(runs)
    for k, i in enumerate(ranked):
        out[i] = later[base[k] : base[k + 1] - length + 1]
    return out


def spans(marks: np.ndarray, length: int) -> np.ndarray:
    """(start, end) rows of the maximal runs of bytes that marked window starts cover."""
    at = np.flatnonzero(marks)
    return joined_spans(np.stack([at, at + length], axis=1)) if len(at) else np.zeros((0, 2), np.int64)


def joined_spans(rows: np.ndarray) -> np.ndarray:
    """Maximal spans of (start, end) rows that overlap or touch."""
    if not len(rows):
        return rows.reshape(0, 2)
    rows = rows[np.argsort(rows[:, 0], kind="stable")]
    reach = np.maximum.accumulate(rows[:, 1])
    new = np.concatenate([[True], rows[1:, 0] > reach[:-1]])
    first = np.flatnonzero(new)
    return np.stack([rows[first, 0], np.append(reach[first[1:] - 1], reach[-1])], axis=1)


# --- the stages ---

ENTRIES, AGAIN, OF_DOC = range(3)
ROWS = "kind int, part int, high long, low long, blob binary"
ANCHOR = np.dtype([("x", "<u4"), ("back", "u1"), ("last", "u1"), ("hash", "<u8")])


def _batch(rows: list[tuple], schema: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, schema, strict=True)], names=[n for n, _ in schema])


ROW_TYPES = [("kind", pa.int32()), ("part", pa.int32()), ("high", pa.int64()), ("low", pa.int64()), ("blob", pa.binary())]


def _halves(digest: str) -> tuple[int, int]:
    """A digest of 32 hex digits as two signed numbers."""
    raw = bytes.fromhex(digest)
    return int.from_bytes(raw[:8], signed=True), int.from_bytes(raw[8:], signed=True)


def _of_docs(found: np.ndarray, doc: np.ndarray, names: np.ndarray) -> Iterator[tuple]:
    """One row per text, named by its digest, with its anchors."""
    if not len(doc):
        return
    order = np.argsort(doc, kind="stable")
    found, doc = found[order], doc[order]
    first = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
    for a, e in zip(first.tolist(), np.append(first[1:], len(doc)).tolist(), strict=True):
        high, low = names[doc[a]].tolist()
        yield (OF_DOC, low & 0x7FFFFFFF, high, low, found[a:e].tobytes())  # only passes through: any partition will do


def _find_anchors(texts: DataFrame, length: int, parts: int) -> DataFrame:
    """Anchors of (digest, text) dealt out by hash; those that a task meets twice go straight to their texts.

    A task looks at a text once, whichever of its rows it meets.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[str] = set()
        held: list[np.ndarray] = []
        owners: list[np.ndarray] = []
        names: list[tuple[int, int]] = []

        def flush() -> pa.RecordBatch:
            found, doc, ids = np.concatenate(held), np.concatenate(owners), np.array(names, np.int64)
            order = np.argsort(found["hash"], kind="stable")
            found, doc = found[order], doc[order]
            h = found["hash"]
            same = h[1:] == h[:-1]
            again = np.concatenate([[False], same]) | np.concatenate([same, [False]])
            out = list(_of_docs(found[again], doc[again], ids))
            place = ((h >> U(32)) * U(parts)) >> U(32)
            ends = np.searchsorted(place, np.arange(parts + 1, dtype=U))
            for p in range(parts):
                a, e = int(ends[p]), int(ends[p + 1])
                some, of = found[a:e], doc[a:e]
                twice = again[a:e]
                if twice.any():
                    out.append((AGAIN, p, None, None, np.unique(some["hash"][twice]).tobytes()))
                some, of = some[~twice], of[~twice]
                if len(some):
                    out.append((ENTRIES, p, None, None, _packed(some, of, ids)))
            held.clear()
            owners.clear()
            names.clear()
            return _batch(out, ROW_TYPES)

        size = 0
        for batch in batches:
            digests = batch.column(0).to_pylist()
            for at, texts in text_groups(batch.column(1)):
                raws = []
                for i, t in enumerate(texts, at):
                    fresh = digests[i] not in seen
                    raws.append(t.encode("utf-8", "surrogatepass") if fresh else b"")
                    seen.add(digests[i])
                ends = np.cumsum([len(r) for r in raws])
                h, x, lo, hi = anchors(b"".join(raws), ends, length, STEP)
                if not len(h):
                    continue
                doc = np.searchsorted(ends, x, "right")
                begin = np.concatenate([[0], ends[:-1]])[doc]
                found = np.zeros(len(h), ANCHOR)
                found["x"], found["back"], found["last"], found["hash"] = x - begin, x - lo, x - hi, h
                used, slot = np.unique(doc, return_inverse=True)
                owners.append(slot + len(names))
                names += [_halves(digests[at + d]) for d in used.tolist()]
                held.append(found)
                size += len(found)
                if size >= FLUSH:
                    yield flush()
                    size = 0
        if held:
            yield flush()

    return texts.mapInArrow(run, ROWS)


def _packed(some: np.ndarray, of: np.ndarray, ids: np.ndarray) -> bytes:
    """Anchors and the names of their texts as one blob."""
    used, slot = np.unique(of, return_inverse=True)
    head = np.array([len(used), len(some)], np.int64).tobytes()
    parts_of = [head, ids[used].tobytes(), slot.astype(np.uint32).tobytes()]
    return b"".join(parts_of + [np.ascontiguousarray(some[n]).tobytes() for n in ANCHOR.names])


def _unpacked(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchors, index of the text of each, names of the texts) of a packed blob."""
    k, n = np.frombuffer(blob, np.int64, 2).tolist()
    at = 16
    names = np.frombuffer(blob, np.int64, 2 * k, at).reshape(k, 2)
    at += 16 * k
    of = np.frombuffer(blob, np.uint32, n, at).astype(np.int64)
    at += 4 * n
    some = np.zeros(n, ANCHOR)
    for name in ANCHOR.names:
        some[name] = np.frombuffer(blob, ANCHOR[name], n, at)
        at += n * ANCHOR[name].itemsize
    return some, of, names


def _shared_anchors(dealt: DataFrame, parts: int) -> DataFrame:
    """(high, low, blob): the anchors of each text that occur twice or more anywhere, one row per text.

    A partition of anchors sends one row to each partition of texts, so that rows do not grow with texts times partitions.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, docs, names, again = [np.zeros(0, ANCHOR)], [np.zeros(0, np.int64)], [], [np.zeros(0, U)]
        passed, passed_of, passed_names = [np.zeros(0, ANCHOR)], [np.zeros(0, np.int64)], []
        n_names = 0
        for batch in batches:
            kind = batch.column(0).to_numpy()
            for i in range(batch.num_rows):
                blob = batch.column(4)[i].as_py()
                if kind[i] == AGAIN:
                    again.append(np.frombuffer(blob, U))
                elif kind[i] == OF_DOC:
                    passed.append(np.frombuffer(blob, ANCHOR))
                    passed_of.append(np.full(len(passed[-1]), len(passed_names), np.int64))
                    passed_names.append((batch.column(2)[i].as_py(), batch.column(3)[i].as_py()))
                else:
                    some, of, ids = _unpacked(blob)
                    found.append(some)
                    docs.append(of + n_names)
                    names.append(ids)
                    n_names += len(ids)
        some, of, ids = np.concatenate(passed), np.concatenate(passed_of), np.array(passed_names, np.int64).reshape(-1, 2)
        if n_names:
            everything, doc, whose = np.concatenate(found), np.concatenate(docs), np.concatenate(names)
            known = np.concatenate(again)

            def twice(order: np.ndarray) -> np.ndarray:
                h = everything["hash"][order]
                same = h[1:] == h[:-1]
                return order[np.concatenate([[False], same]) | np.concatenate([same, [False]]) | np.isin(h, known)]

            order = twice(np.argsort(everything["hash"], kind="stable"))
            if len(order):  # tasks that met copies of one text found the same anchors
                order = order[np.lexsort((everything["x"][order], whose[doc[order], 1], whose[doc[order], 0], everything["hash"][order]))]
                known_once, who = everything[order], whose[doc[order]]
                order = order[np.concatenate([[True], (known_once[1:] != known_once[:-1]) | (who[1:] != who[:-1]).any(axis=1)])]
                order = twice(order)
            some, of = np.concatenate([some, everything[order]]), np.concatenate([of, doc[order] + len(ids)])
            ids = np.concatenate([ids, whose])
        if not len(some):
            return
        place = (ids[of, 1] & 0x7FFFFFFF) % parts
        order = np.argsort(place, kind="stable")
        some, of, place = some[order], of[order], place[order]
        first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        for a, e in zip(first.tolist(), [*first[1:].tolist(), len(place)], strict=True):
            yield _batch([(int(place[a]), _packed(some[a:e], of[a:e], ids))], [ROW_TYPES[1], ROW_TYPES[4]])

    def by_text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, docs, names = [np.zeros(0, ANCHOR)], [np.zeros(0, np.int64)], [np.zeros((0, 2), np.int64)]
        n_names = 0
        for batch in batches:
            for blob in batch.column(1).to_pylist():
                some, of, ids = _unpacked(blob)
                found.append(some)
                docs.append(of + n_names)
                names.append(ids)
                n_names += len(ids)
        ids, slot = np.unique(np.concatenate(names), axis=0, return_inverse=True)
        rows = [r[2:] for r in _of_docs(np.concatenate(found), slot.reshape(-1)[np.concatenate(docs)], ids)]
        for a in range(0, len(rows), 10_000):
            yield _batch(rows[a : a + 10_000], ROW_TYPES[2:])

    met = dealt.repartition(parts, "part").mapInArrow(run, "part int, blob binary")
    return met.repartition(parts, "part").mapInArrow(by_text, "high long, low long, blob binary")


RUNS = "kind int, key long, mark long, anchor long, at int, back int, blob binary"
RUN_TYPES = [
    ("kind", pa.int32()), ("key", pa.int64()), ("mark", pa.int64()), ("anchor", pa.int64()), ("at", pa.int32()),
    ("back", pa.int32()), ("blob", pa.binary()),
]
TEXT, RUN, SPANS = range(3)


def _runs(texts: DataFrame, length: int) -> DataFrame:
    """Runs of windows at shared anchors, equal ones of a task once; of later equal ones the spans; and the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, tuple] = {}
        held_bytes = 0

        def forward() -> pa.RecordBatch:
            rows = [(RUN, *order[:2], anchor, order[2], back, content) for (anchor, back, content), order in held.items()]
            held.clear()
            return _batch(rows, RUN_TYPES)

        for batch in batches:
            keys, marks = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for i in range(batch.num_rows):
                raw = batch.column(2)[i].as_py().encode("utf-8", "surrogatepass")
                found = np.unique(np.frombuffer(batch.column(3)[i].as_py(), ANCHOR))
                key, mark = keys[i], marks[i]
                out = [(TEXT, key, mark, None, None, None, raw)]
                gone: dict[tuple, list] = {}
                signed = found["hash"].astype(np.int64).tolist()
                begin = (found["x"].astype(np.int64) - found["back"]).tolist()
                stop = (found["x"].astype(np.int64) - found["last"] + length).tolist()
                back = found["back"].tolist()
                for a, e, h, k in zip(begin, stop, signed, back, strict=True):
                    name = (h, k, raw[a:e])
                    order = (key, mark, a)
                    known = held.get(name)
                    if known is None:
                        held[name] = order
                        held_bytes += e - a + 200
                    else:
                        first, second = (known, order) if known < order else (order, known)
                        held[name] = first
                        gone.setdefault(second[:2], []).append((second[2], second[2] + e - a))
                for (k, m), rows in gone.items():
                    out.append((SPANS, k, m, None, None, None, joined_spans(np.array(rows, np.int64)).tobytes()))
                yield _batch(out, RUN_TYPES)
            if held_bytes > HELD_BYTES:
                yield forward()
                held_bytes = 0
        yield forward()

    return texts.mapInArrow(run, RUNS)


def _later_spans(runs: DataFrame, length: int, parts: int) -> DataFrame:
    """(key, mark, blob): spans of the windows that start earlier in another run of their anchor."""
    dealt = runs.where(F.col("kind") == RUN).select("anchor", "key", "mark", "at", "back", "blob")
    # one number per HOT_RUNS runs at most
    hot = [r["anchor"] for r in dealt.groupBy("anchor").count().where(F.col("count") > HOT_RUNS).select("anchor").collect()]
    many = F.broadcast(runs.sparkSession.createDataFrame([(h,) for h in hot], "anchor long"))
    hot_runs = dealt.join(many, "anchor", "left_semi") if hot else None
    dealt = dealt.join(many, "anchor", "left_anti") if hot else dealt

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carried: dict[tuple, tuple] = {}
        anchor_now = None
        ready: list[dict[tuple, tuple]] = []
        size = 0
        gone: dict[tuple, list] = {}

        def settle() -> pa.RecordBatch:
            work = [(content, order) for group in ready for (_, content), order in group.items()]
            if work:
                for (_, order), later in zip(work, later_windows(work, length), strict=True):
                    if later.any():
                        gone.setdefault(order[:2], []).append(spans(later, length) + order[2])
            ready.clear()
            rows = [(k, m, joined_spans(np.concatenate(s)).tobytes()) for (k, m), s in gone.items()]
            gone.clear()
            return _batch(rows, FOUND_TYPES)

        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(6)]
            for anchor, key, mark, at, back, content in zip(*columns, strict=True):
                if anchor != anchor_now:
                    if len(carried) > 1:
                        ready.append(carried)
                        size += sum(len(c) for _, c in carried)
                    carried, anchor_now = {}, anchor
                    if size > SORTED_BYTES:
                        yield settle()
                        size = 0
                order, name = (key, mark, at), (back, content)
                known = carried.get(name)
                if known is None:
                    carried[name] = order
                else:
                    first, second = (known, order) if known < order else (order, known)
                    carried[name] = first
                    gone.setdefault(second[:2], []).append(np.array([[second[2], second[2] + len(content)]], np.int64))
        if len(carried) > 1:
            ready.append(carried)
        yield settle()

    dealt = dealt.repartition(parts, "anchor").sortWithinPartitions("anchor")
    found = dealt.mapInArrow(run, FOUND)
    return found if hot_runs is None else found.unionByName(_later_of_hot(hot_runs, length, parts))


FOUND = "key long, mark long, blob binary"
FOUND_TYPES = [("key", pa.int64()), ("mark", pa.int64()), ("blob", pa.binary())]
WINDOWS = "key long, mark long, at int, blob binary, later boolean"
WINDOW_TYPES = [("key", pa.int64()), ("mark", pa.int64()), ("at", pa.int32()), ("blob", pa.binary()), ("later", pa.bool_())]


def _later_of_hot(runs: DataFrame, length: int, parts: int) -> DataFrame:
    """(key, mark, blob): spans of the windows of these runs that start earlier in another of them.

    A task passes on equal windows once, with the earliest start, and spans of the others.  What it passes on meets by the
    bytes of the window, in the order of the starts, and is looked at row by row.
    """

    def as_rows(gone: dict[tuple, list]) -> list[tuple]:
        rows = [(k, m, joined_spans(np.array([(a, a + length) for a in s], np.int64)).tobytes()) for (k, m), s in gone.items()]
        gone.clear()
        return rows

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, tuple] = {}
        gone: dict[tuple, list] = {}

        def forward() -> Iterator[pa.RecordBatch]:
            yield _batch([(k, m, None, blob, True) for k, m, blob in as_rows(gone)], WINDOW_TYPES)
            rows = [(*order, window, False) for window, order in held.items()]
            held.clear()
            for a in range(0, len(rows), 10_000):
                yield _batch(rows[a : a + 10_000], WINDOW_TYPES)

        size = 0
        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(4)]
            for key, mark, at, content in zip(*columns, strict=True):
                for j in range(len(content) - length + 1):
                    window, order = content[j : j + length], (key, mark, at + j)
                    known = held.setdefault(window, order)
                    if known is not order:
                        held[window] = min(known, order)
                        *text, start = max(known, order)
                        gone.setdefault(tuple(text), []).append(start)
                        size += 100
                    else:
                        size += length + 200
                if size > HELD_BYTES:
                    yield from forward()
                    size = 0
        yield from forward()

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None
        for batch in batches:
            rows: list[tuple] = []
            gone: dict[tuple, list] = {}
            columns = [batch.column(i).to_pylist() for i in range(5)]
            for key, mark, at, blob, later in zip(*columns, strict=True):
                if later:
                    rows.append((key, mark, blob))
                elif blob == before:
                    gone.setdefault((key, mark), []).append(at)
                else:
                    before = blob
            yield _batch(rows + as_rows(gone), FOUND_TYPES)

    windows = runs.select("key", "mark", "at", "blob").mapInArrow(deal, WINDOWS)
    place = F.when(F.col("later"), F.xxhash64("key", "mark")).otherwise(F.xxhash64("blob"))
    return windows.repartition(parts, place).sortWithinPartitions("blob", "key", "mark", "at").mapInArrow(judge, FOUND)


def _cut(texts: DataFrame, found: DataFrame, as_text: bool) -> DataFrame:
    """(key, mark, n_removed, n_spans, kept) of the texts that lose something; kept is the digest or text of what is left.

    As text, characters that lost some of their bytes are left out.
    """
    of_doc = found.groupBy("key", "mark").agg(F.collect_list("blob").alias("blobs"))
    both = texts.select("key", "mark", F.col("blob").alias("raw")).join(of_doc, ["key", "mark"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i in range(batch.num_rows):
                raw = batch.column(2)[i].as_py()
                gone = joined_spans(np.concatenate([np.frombuffer(b, np.int64).reshape(-1, 2) for b in batch.column(3)[i].as_py()]))
                kept, at = [], 0
                for a, e in gone.tolist():
                    kept.append(raw[at:a])
                    at = e
                kept.append(raw[at:])
                left = b"".join(kept)
                left = left.decode("utf-8", "ignore") if as_text else hashlib.sha256(left).hexdigest()
                rows.append((batch.column(0)[i].as_py(), batch.column(1)[i].as_py(), int((gone[:, 1] - gone[:, 0]).sum()), len(gone), left))
            yield _batch(rows, [("key", pa.int64()), ("mark", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.string())])

    return both.mapInArrow(run, "key long, mark long, n_removed long, n_spans long, kept string")


def _named(docs: DataFrame, key: str, text: str) -> list:
    """key (nulls last), mark (tells texts of one key apart), digest and text."""
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return [F.coalesce(F.col(key).cast("long"), F.lit(NO_KEY)).alias("key"), F.xxhash64(whole).alias("mark"), F.md5(whole).alias("digest"), whole.alias("text")]


def _judged(docs: DataFrame, key: str, text: str, length: int, as_text: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(facts of every key and text, the first row of each text, what is left of those that lose a part)."""
    parts = parts_for(docs, BYTES_EACH)
    named = docs.select(*_named(docs, key, text))
    facts = written(
        named.select(
            "key", "mark", "digest", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2(F.col("text").cast("binary"), 256).alias("sha256")
        )
        .groupBy("key", "mark", "digest", "n_bytes", "sha256")
        .agg(F.count("*").alias("times")),
        "texts",
    )
    firsts = facts.groupBy("digest").agg(F.min(F.struct("key", "mark")).alias("f")).select("digest", "f.key", "f.mark")
    # texts shorter than a window cannot repeat
    long = named.where(F.octet_length("text") >= length)
    shared = _shared_anchors(_find_anchors(long.select("digest", "text"), length, parts), parts)
    name = F.lower(F.concat(*[F.lpad(F.hex(c), 16, "0") for c in ("high", "low")]))
    of_doc = shared.select(name.alias("digest"), "blob").join(firsts, "digest").select("key", "mark", "blob")
    one = long.select("key", "mark", "text").join(of_doc, ["key", "mark"]).dropDuplicates(["key", "mark"]).select("key", "mark", "text", "blob")
    runs = written(_runs(one, length), "runs")
    local = runs.where(F.col("kind") == SPANS).select("key", "mark", "blob")
    found = local.unionByName(_later_spans(runs, length, parts))
    return facts, firsts, _cut(runs.where(F.col("kind") == TEXT), found, as_text)


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = 100) -> DataFrame:
    """Key, n_bytes, n_removed, n_spans and kept_sha256 of every document.

    Each byte that a ``length``-byte string covers which also starts earlier (a smaller key, or earlier in the text) is
    removed; strings are judged on the whole input.  Null text is empty.  A null key comes after all others; of rows with
    one key, texts are ordered by a hash, and of rows repeated whole the first stays.  Texts shorter than ``length`` are
    left alone, other columns are not read, an empty table gives an empty result.
    """
    facts, firsts, cut = _judged(docs, key, text, length, as_text=False)
    rows = facts.join(firsts.select("key", "mark", F.lit(True).alias("first")), ["key", "mark"], "left").join(cut, ["key", "mark"], "left")
    # rows repeated whole: the first of them is the one that may stay
    rows = rows.withColumn("nth", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))))
    lone = F.coalesce("first", F.lit(False)) & (F.col("nth") == 1)
    gone = ~lone & (F.col("n_bytes") >= length)
    none = F.lit(0).cast("long")
    return rows.select(
        F.when(F.col("key") != NO_KEY, F.col("key")).alias(key),
        "n_bytes",
        F.when(gone, F.col("n_bytes")).when(lone, F.coalesce("n_removed", none)).otherwise(none).alias("n_removed"),
        F.when(gone, F.lit(1).cast("long")).when(lone, F.coalesce("n_spans", none)).otherwise(none).alias("n_spans"),
        F.when(gone, F.lit(hashlib.sha256().hexdigest())).when(lone, F.coalesce("kept", "sha256")).otherwise(F.col("sha256")).alias("kept_sha256"),
    )


def cut_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", size: str = "n_chars", length: int = 100) -> DataFrame:
    """The rows of docs, with all their columns, after removal; rows of which nothing but white space is left go.

    ``size`` (if there is such a column) gets the new number of characters of texts that lose a part.
    """
    _, firsts, cut = _judged(docs, key, text, length, as_text=True)
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    is_long = F.octet_length(whole) >= length
    # the row travels as one value, so that its columns may have any names
    named = docs.where(is_long).select(
        F.coalesce(F.col(key).cast("long"), F.lit(NO_KEY)).alias("key"), F.xxhash64(whole).alias("mark"), F.struct(*docs.columns).alias("row")
    )
    both = named.join(firsts.select("key", "mark"), ["key", "mark"]).join(cut.select("key", "mark", "kept"), ["key", "mark"], "left")
    both = both.dropDuplicates(["key", "mark"]).where(F.col("kept").isNull() | F.col("kept").rlike(r"\S"))
    out = []
    for field in docs.schema.fields:
        value = F.col("row")[field.name]
        if field.name == text:
            value = F.coalesce("kept", value)
        elif field.name == size:
            value = F.when(F.col("kept").isNull(), value).otherwise(F.length("kept")).cast(field.dataType)
        out.append(value.alias(field.name))
    return both.select(*out).unionByName(docs.where(~is_long))
