"""Vector code compression: product codes by k-means over parts, assigned through anchors-hierarchy metric trees.

Vectors become integers (floor(256 x)) and are cut into PARTS equal consecutive parts; every part position has a
codebook of ENTRIES entries, started from that part of the vectors with the smallest keys.  Each round assigns every
part to the nearest entry of its codebook and moves each entry to the floor of the mean of its parts.

Assignment goes through a metric tree per task and part position, built middle-out as an anchors hierarchy: a set
of points gets about sqrt(n) anchors (each new anchor is the point farthest from the anchor that owns it, and takes
the points nearer to it), each anchor's points are built the same way below it, and the anchors are merged upwards,
the pair whose merged ball is smallest first.  Every ball caches the sum and count of its points.  A ball is visited
with the list of entries that may still be nearest to one of its points; an entry farther from the ball's pivot, less
the radius, than the best entry plus the radius is dropped, and the shorter list is inherited by the children.  Once
one entry is left, it owns the whole ball and takes the cached sum and count at once; only leaves with several
entries left compare their points one by one.  Each task sends one row per (part, entry, component) to a grouped sum,
so a round shuffles at most tasks x PARTS x ENTRIES x width rows, whatever the input's size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablescope.llm.common import written

#: Fixed values of the contract.
PARTS = 16
ENTRIES = 64
ROUNDS = 2
SCALE = 256
#: Points a leaf ball holds at most; bytes of input per task; labels that are sent to every task rather than joined.
LEAF = 16
TASK_BYTES = 32 << 20
BROADCAST_LABELS = 100_000


class Balls:
    """Anchors hierarchy over distinct integer points x (rows) with weights w."""

    def __init__(self, x: np.ndarray, w: np.ndarray):
        self.x, self.xf, self.w = x, x.astype(np.float64), w
        self.pivot, self.radius, self.sum, self.count, self.kids, self.points = [], [], [], [], [], []
        self.root = self._make(np.arange(len(x))) if len(x) else None

    def _node(self, kids: list[int], points: np.ndarray | None) -> int:
        if points is not None:
            s = (self.x[points] * self.w[points, None]).sum(axis=0)
            c = int(self.w[points].sum())
        else:
            s = sum(self.sum[k] for k in kids)
            c = sum(self.count[k] for k in kids)
        pivot = s / c
        if points is not None:
            r = float(np.sqrt(((self.xf[points] - pivot) ** 2).sum(axis=1)).max())
        else:
            r = max(float(np.sqrt(((self.pivot[k] - pivot) ** 2).sum())) + self.radius[k] for k in kids)
        self.pivot.append(pivot)
        self.radius.append(r * (1 + 1e-12) + 1e-9)
        self.sum.append(s)
        self.count.append(c)
        self.kids.append(kids)
        self.points.append(points)
        return len(self.pivot) - 1

    def _anchors(self, idx: np.ndarray) -> list[np.ndarray]:
        """About sqrt(n) anchors over idx, each with the points it owns."""
        pts = self.xf[idx]
        want = int(np.ceil(np.sqrt(len(idx))))
        first = int(np.argmax(((pts - pts.mean(axis=0)) ** 2).sum(axis=1)))
        owner = np.zeros(len(idx), dtype=np.int64)
        dist = np.sqrt(((pts - pts[first]) ** 2).sum(axis=1))
        for a in range(1, want):
            far = int(np.argmax(dist))
            if dist[far] <= 0:
                break
            d = np.sqrt(((pts - pts[far]) ** 2).sum(axis=1))
            steal = d < dist
            owner[steal], dist[steal] = a, d[steal]
        return [idx[owner == a] for a in np.unique(owner)]

    def _make(self, idx: np.ndarray) -> int:
        if len(idx) <= LEAF:
            return self._node([], idx)
        groups = self._anchors(idx)
        if len(groups) == 1:  # all points equal
            return self._node([], idx)
        nodes = [self._make(g) for g in groups]
        # middle-out: merge the pair whose merged ball is smallest until one is left
        while len(nodes) > 1:
            piv = np.array([self.pivot[n] for n in nodes])
            rad = np.array([self.radius[n] for n in nodes])
            cnt = np.array([self.count[n] for n in nodes], dtype=np.float64)
            merged = (piv[:, None, :] * cnt[:, None, None] + piv[None, :, :] * cnt[None, :, None]) / (
                cnt[:, None, None] + cnt[None, :, None]
            )
            reach_a = np.sqrt(((merged - piv[:, None, :]) ** 2).sum(axis=2)) + rad[:, None]
            reach_b = np.sqrt(((merged - piv[None, :, :]) ** 2).sum(axis=2)) + rad[None, :]
            size = np.maximum(reach_a, reach_b)
            np.fill_diagonal(size, np.inf)
            i, j = np.unravel_index(int(np.argmin(size)), size.shape)
            parent = self._node([nodes[i], nodes[j]], None)
            nodes = [n for t, n in enumerate(nodes) if t not in (i, j)] + [parent]
        return nodes[0]

    def assign(self, book: np.ndarray, per_point: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
        """Sums and counts per entry of book, and (if per_point) the entry of every point; ties to the lower entry."""
        sums = np.zeros(book.shape, dtype=np.int64)
        counts = np.zeros(len(book), dtype=np.int64)
        entry = np.full(len(self.x), -1, dtype=np.int64) if per_point else None
        if self.root is None:
            return sums, counts, entry
        bookf = book.astype(np.float64)
        stack = [(self.root, np.arange(len(book)))]
        while stack:
            node, cands = stack.pop()
            if len(cands) > 1:
                d = np.sqrt(((bookf[cands] - self.pivot[node]) ** 2).sum(axis=1))
                r = self.radius[node]
                cands = cands[d - r <= d.min() + r + 1e-9 * (1 + d.min())]
            if len(cands) == 1:  # the ball is wholly owned
                sums[cands[0]] += self.sum[node].astype(np.int64)
                counts[cands[0]] += self.count[node]
                if per_point:
                    for pts in self._points_below(node):
                        entry[pts] = cands[0]
                continue
            if self.points[node] is not None:
                pts = self.points[node]
                diff = self.x[pts][:, None, :] - book[cands][None, :, :]
                near = cands[np.argmin((diff * diff).sum(axis=2), axis=1)]  # cands ascend: ties to the lower entry
                np.add.at(sums, near, self.x[pts] * self.w[pts, None])
                np.add.at(counts, near, self.w[pts])
                if per_point:
                    entry[pts] = near
                continue
            stack.extend((k, cands) for k in self.kids[node])
        return sums, counts, entry

    def _points_below(self, node: int) -> Iterator[np.ndarray]:
        stack = [node]
        while stack:
            n = stack.pop()
            if self.points[n] is not None:
                yield self.points[n]
            else:
                stack.extend(self.kids[n])


def _matrix(batches: Iterator[pa.RecordBatch], width: int) -> tuple[list, list[pa.Array], np.ndarray]:
    keys, labels, rows = [], [], []
    for batch in batches:
        keys += batch.column(0).to_pylist()
        labels.append(batch.column(1))
        flat = batch.column(2).flatten().to_numpy(zero_copy_only=False)
        rows.append(np.asarray(flat, dtype=np.int64).reshape(batch.num_rows, width))
    return keys, labels, np.concatenate(rows) if rows else np.zeros((0, width), dtype=np.int64)


def _trees(q: np.ndarray, part: int, width: int) -> tuple[Balls, np.ndarray]:
    block = q[:, part * width : (part + 1) * width]
    distinct, inverse, weight = np.unique(block, axis=0, return_inverse=True, return_counts=True)
    return Balls(distinct, weight), inverse.reshape(-1)


def compress(
    df: DataFrame, key: str = "vec_id", vec: str = "embedding", label: str = "label", parts: int = PARTS,
    entries: int = ENTRIES, rounds: int = ROUNDS,
) -> DataFrame:
    """Per kept row: key, label, code (entry of each part as two hex digits, in part order), error (squared distances
    to the assigned entries, summed over parts), label_error (error summed over all rows of the same label, nulls
    together), codebooks_sha256 (the final entries' integer components by part, entry, position, ``,``-joined).

    Kept: rows whose vector is not null and has no null or non-finite component; zero vectors are kept.  The first
    codebooks come from the ``entries`` rows with the smallest keys (null keys last, ties by vector); with fewer rows the
    codebooks have fewer entries.  Repeated rows count once each.  Vectors of another length than the first kept one,
    or lengths that parts does not divide, raise ValueError.  An empty table (or none kept) gives no rows.  Other
    columns of df are not read.
    """
    spark = df.sparkSession
    v = F.col(vec)
    finite = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    kept = df.where(v.isNotNull() & finite).select(
        F.col(key).cast("long").alias("key"),
        F.col(label).alias("label"),
        F.transform(v, lambda c: F.floor(c.cast("double") * SCALE).cast("long")).alias("q"),
    )
    out_schema = f"{key} long, {label} {kept.schema['label'].dataType.simpleString()}, code string, error long, label_error long, codebooks_sha256 string"
    shape = kept.agg(F.count("*").alias("n"), F.min(F.size("q")).alias("lo"), F.max(F.size("q")).alias("hi")).first()
    if not shape.n:
        return spark.createDataFrame([], out_schema)
    if shape.lo != shape.hi or shape.lo % parts or not shape.lo:
        raise ValueError(f"vectors of {shape.lo} to {shape.hi} components cannot be cut into {parts} equal parts")
    width = shape.lo // parts
    first = kept.orderBy(F.col("key").asc_nulls_last(), "q").limit(entries).collect()  # bounded: entries rows
    book = np.array([r.q for r in first], dtype=np.int64).reshape(len(first), parts, width).transpose(1, 0, 2).copy()
    # tasks from the rows counted above (8 bytes a component), not from the file size that frames of rows lack
    tasks = int(max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-shape.n * (8 * shape.lo + 16) // TASK_BYTES)))
    data = written(kept.repartition(tasks, F.xxhash64("key", "q")), "codes-input")

    for _ in range(rounds):
        sums = data.mapInArrow(_partial(book, width), "part int, entry int, pos int, s long, c long")
        got = sums.groupBy("part", "entry", "pos").agg(F.sum("s").alias("s"), F.sum("c").alias("c")).collect()
        book = book.copy()
        total = np.zeros(book.shape, dtype=np.int64)
        count = np.zeros(book.shape[:2], dtype=np.int64)
        for r in got:  # at most parts x entries x width rows
            total[r.part, r.entry, r.pos] = r.s
            count[r.part, r.entry] = r.c
        used = count > 0
        book[used] = np.floor_divide(total[used], count[used][:, None])

    digest = hashlib.sha256(",".join(str(int(c)) for c in book.reshape(-1)).encode()).hexdigest()
    coded = data.mapInArrow(_final(book, width), f"key long, label {kept.schema['label'].dataType.simpleString()}, code string, error long")
    totals = coded.groupBy("label").agg(F.sum("error").alias("label_error"))
    if totals.count() <= BROADCAST_LABELS:
        joined = coded.join(F.broadcast(totals), coded.label.eqNullSafe(totals.label)).select(coded["*"], "label_error")
    else:  # many labels: a hot label is split over salts on the large side
        salts = 32
        big = coded.withColumn("_salt", F.pmod(F.xxhash64("key", "code"), F.lit(salts)))
        small = totals.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
        joined = big.join(small, big.label.eqNullSafe(small.label) & (big._salt == small._salt)).select(coded.columns + ["label_error"])
    return joined.select(
        F.col("key").alias(key), F.col("label").alias(label), "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256")
    )


def _partial(book: np.ndarray, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, _, q = _matrix(batches, book.shape[0] * width)
        if not len(q):
            return
        out = {"part": [], "entry": [], "pos": [], "s": [], "c": []}
        for part in range(book.shape[0]):
            balls, _ = _trees(q, part, width)
            sums, counts, _ = balls.assign(book[part], per_point=False)
            for e in np.flatnonzero(counts):
                for pos in range(width):
                    out["part"].append(part)
                    out["entry"].append(int(e))
                    out["pos"].append(pos)
                    out["s"].append(int(sums[e, pos]))
                    out["c"].append(int(counts[e]))
        yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("part", pa.int32()), ("entry", pa.int32()), ("pos", pa.int32()), ("s", pa.int64()), ("c", pa.int64())]))

    return run


def _final(book: np.ndarray, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, labels, q = _matrix(batches, book.shape[0] * width)
        if not len(q):
            return
        codes = np.zeros((len(q), book.shape[0]), dtype=np.int64)
        error = np.zeros(len(q), dtype=np.int64)
        for part in range(book.shape[0]):
            balls, inverse = _trees(q, part, width)
            _, _, entry = balls.assign(book[part], per_point=True)
            codes[:, part] = entry[inverse]
            diff = q[:, part * width : (part + 1) * width] - book[part][codes[:, part]]
            error += (diff * diff).sum(axis=1)
        text = ["".join(f"{c:02x}" for c in row) for row in codes.tolist()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(keys, pa.int64()), pa.concat_arrays(labels), pa.array(text, pa.string()), pa.array(error, pa.int64())],
            names=["key", "label", "code", "error"],
        )

    return run
