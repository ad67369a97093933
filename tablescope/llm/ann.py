"""Approximate nearest neighbours by a hierarchical k-means tree searched best bin first.

The tree is fitted on a bounded sample (FIT_ROWS rows with the smallest hashes of their keys): each node splits its
points by k-means into BRANCH children until a node holds at most LEAF_FIT of them.  Every valid row of the table is
then indexed: it descends the tree to the nearest child at each level and takes the leaf it reaches.  A query
traverses the tree best bin first: it descends to its nearest leaf and pushes every sibling passed on the way into a
priority queue keyed by the distance to that sibling's centre; further leaves come from the queue, nearest first.
How many leaves to visit is calibrated on the sample: the least number whose recall of the exact neighbours of
CALIBRATION queries reaches TARGET_RECALL.  A query widens its visits beyond that number until the visited leaves hold
at least k candidates other than itself (or all leaves are visited).

Queries meet the rows of the leaves they visit in blocks: a leaf's rows are dealt into blocks of at most BLOCK_ROWS
and its queries into blocks of at most QUERY_BLOCK, so a leaf that holds a large part of the table (copies of one
vector) is spread over many tasks.  Each block gives at most k rows per query; the best k of those are the result.
Distances are exact, in double precision, on the original vectors.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tablescope.llm.common import written

#: Rows of the bounded sample the tree is fitted on, and the calibration queries drawn from it.
FIT_ROWS = 8_192
CALIBRATION = 500
BRANCH = 16
LEAF_FIT = 128
KMEANS_STEPS = 10
TARGET_RECALL = 0.95
BLOCK_ROWS = 20_000
QUERY_BLOCK = 2_000
#: Stands for a null key in numpy; such rows sort after all others.
NULL_KEY = np.iinfo(np.int64).max


class Tree:
    """Flat arrays: centre of every node, its children (first, count) in ``kids``, leaf number or -1."""

    def __init__(self, centers: np.ndarray, first: np.ndarray, count: np.ndarray, kids: np.ndarray, leaf: np.ndarray):
        self.centers, self.first, self.count, self.kids, self.leaf = centers, first, count, kids, leaf
        self.n_leaves = int((leaf >= 0).sum())

    def children(self, node: int) -> np.ndarray:
        return self.kids[self.first[node] : self.first[node] + self.count[node]]

    def descend(self, x: np.ndarray) -> np.ndarray:
        """Leaf of each row of x by the nearest child at every level (ties: the first child)."""
        at = np.zeros(len(x), dtype=np.int64)
        while True:
            inner = self.leaf[at] < 0
            if not inner.any():
                return self.leaf[at]
            for node in np.unique(at[inner]):
                rows = np.flatnonzero(at == node)
                kids = self.children(node)
                d = sq_distances(x[rows], self.centers[kids])
                at[rows] = kids[np.argmin(d, axis=1)]

    def best_bin_first(self, q: np.ndarray) -> Iterator[int]:
        """Leaves in the order a best-bin-first traversal meets them."""
        queue = [(0.0, 0)]
        while queue:
            _, node = heapq.heappop(queue)
            while self.leaf[node] < 0:
                kids = self.children(node)
                d = sq_distances(q[None, :], self.centers[kids])[0]
                near = int(np.argmin(d))
                for i, kid in enumerate(kids):
                    if i != near:
                        heapq.heappush(queue, (float(d[i]), int(kid)))
                node = int(kids[near])
            yield int(self.leaf[node])


def sq_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared Euclidean distances of all rows of a to all rows of b, summed over the components in order."""
    out = np.zeros((len(a), len(b)))
    for j in range(a.shape[1]):
        out += (a[:, j, None] - b[None, :, j]) ** 2
    return out


def kmeans(x: np.ndarray, k: int, rnd: np.random.RandomState) -> np.ndarray:
    """Labels of k-means (k-means++ start, KMEANS_STEPS Lloyd steps)."""
    centers = [x[rnd.randint(len(x))]]
    for _ in range(1, k):
        d = sq_distances(x, np.array(centers)).min(axis=1)
        if d.sum() <= 0:
            break
        centers.append(x[rnd.choice(len(x), p=d / d.sum())])
    centers = np.array(centers)
    for _ in range(KMEANS_STEPS):
        labels = np.argmin(sq_distances(x, centers), axis=1)
        centers = np.array([x[labels == c].mean(axis=0) if (labels == c).any() else centers[c] for c in range(len(centers))])
    return np.argmin(sq_distances(x, centers), axis=1)


def fit(x: np.ndarray, branch: int = BRANCH, leaf_size: int = LEAF_FIT, seed: int = 0) -> Tree:
    """The tree of a sample; nodes with at most leaf_size points, or that k-means cannot split, are leaves."""
    rnd = np.random.RandomState(seed)
    centers, kids_of, leaf = [], [], []
    stack = [(None, np.arange(len(x)))]
    while stack:
        parent, idx = stack.pop()
        node = len(centers)
        centers.append(x[idx].mean(axis=0))
        kids_of.append([])
        leaf.append(-1)
        if parent is not None:
            kids_of[parent].append(node)
        labels = kmeans(x[idx], branch, rnd) if len(idx) > leaf_size else np.zeros(len(idx), dtype=int)
        groups = [idx[labels == c] for c in np.unique(labels)]
        if len(groups) < 2:
            leaf[node] = 0
            continue
        stack.extend((node, g) for g in reversed(groups))
    first, count, kids = [], [], []
    for ks in kids_of:
        first.append(len(kids))
        count.append(len(ks))
        kids.extend(ks)
    leaf = np.array(leaf)
    leaf[leaf >= 0] = np.arange((leaf >= 0).sum())
    return Tree(np.array(centers), np.array(first), np.array(count), np.array(kids, dtype=np.int64), leaf)


def exact_top(q: np.ndarray, q_keys: np.ndarray, x: np.ndarray, keys: np.ndarray, k: int) -> list[np.ndarray]:
    """For each query, indexes into x of its k nearest other rows (ties: smaller key)."""
    d = sq_distances(q, x)
    out = []
    for i in range(len(q)):
        ok = np.flatnonzero(keys != q_keys[i])
        order = np.lexsort((keys[ok], d[i, ok]))[:k]
        out.append(ok[order])
    return out


def calibrate(tree: Tree, x: np.ndarray, keys: np.ndarray, k: int, target: float = TARGET_RECALL) -> int:
    """Least number of leaves that best-bin-first visits for a recall of target on the sample's first queries."""
    if tree.n_leaves <= 1:
        return 1
    leaves = tree.descend(x)
    take = np.arange(min(CALIBRATION, len(x)))
    truth = exact_top(x[take], keys[take], x, keys, k)
    # rank of each leaf in each query's visiting order
    found = np.zeros(tree.n_leaves + 1)
    total = 0
    for i, want in zip(take, truth):
        rank = np.empty(tree.n_leaves, dtype=np.int64)
        for r, lf in enumerate(tree.best_bin_first(x[i])):
            rank[lf] = r
        np.add.at(found, rank[leaves[want]] + 1, 1)
        total += len(want)
    if not total:
        return 1
    recall = np.cumsum(found) / total
    return int(min(np.searchsorted(recall, target - 1e-12) or 1, tree.n_leaves))


def valid_rows(df: DataFrame, key: str, vec: str) -> DataFrame:
    """Rows whose vector is not null, not all zero, without null or non-finite components; vectors as doubles."""
    v = F.col(vec)
    finite = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    return df.select(F.col(key).alias("key"), v.cast("array<double>").alias("vec")).where(
        v.isNotNull() & finite & F.exists(v, lambda c: c != 0)
    )


def search(
    df: DataFrame,
    key: str = "vec_id",
    vec: str = "embedding",
    every: int = 100,
    k: int = 10,
    target: float = TARGET_RECALL,
) -> DataFrame:
    """The k nearest found of every query, nearest first: query_id, rank (from 1), vec_id, score (Euclidean distance).

    Queries: valid rows whose key is divisible by ``every``; candidates: every valid row whose key is not the query's
    (so repeated rows of the query's key are left out as well).  Valid: vector not null, not all zero, no null or
    non-finite component, of the dimension of the sample.  Null keys are candidates (sorted after all others on ties)
    and never queries.  Ties of distance go to the smaller key.  A query with fewer than k candidates gets them all;
    an empty table or one without valid rows gives no rows.  Other columns of df are not read.
    """
    spark = df.sparkSession
    rows = valid_rows(df, key, vec)
    sample = rows.orderBy(F.xxhash64("key"), "key").limit(FIT_ROWS).collect()
    empty = "query_id long, rank int, vec_id long, score double"
    if not sample:
        return spark.createDataFrame([], empty)
    dim = len(sample[0].vec)
    x = np.array([r.vec for r in sample if len(r.vec) == dim], dtype=np.float64)
    keys = np.array([NULL_KEY if r.key is None else r.key for r in sample if len(r.vec) == dim], dtype=np.int64)
    tree = fit(x)
    visits = calibrate(tree, x, keys, k, target)

    def index(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            v = np.array(part["vec"].tolist(), dtype=np.float64).reshape(len(part), dim)
            yield pd.DataFrame({"key": part["key"], "vec": part["vec"], "leaf": tree.descend(v) if len(part) else []})

    rows = rows.where(F.size("vec") == dim)
    indexed = written(rows.mapInPandas(index, "key long, vec array<double>, leaf long"), "ann-index")
    sizes = {r.leaf: r.n for r in indexed.groupBy("leaf").agg(F.count("*").alias("n")).collect()}  # one row a leaf

    def route(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for q_key, q_vec in zip(part["key"], part["vec"]):
                q = np.asarray(q_vec, dtype=np.float64)
                seen, held = 0, 0
                for lf in tree.best_bin_first(q):
                    out.append((q_key, lf))
                    seen += 1
                    held += sizes.get(lf, 0)
                    if seen >= visits and held > k:
                        break
            yield pd.DataFrame(out, columns=["query_id", "leaf"]) if out else pd.DataFrame({"query_id": [], "leaf": []})

    queries = indexed.where(F.col("key") % every == 0)
    routes = queries.select("key", "vec").mapInPandas(route, "query_id long, leaf long")
    asks = routes.join(queries.select(F.col("key").alias("query_id"), F.col("vec").alias("qvec")), "query_id")
    asked = {r.leaf: r.n for r in routes.groupBy("leaf").agg(F.count("*").alias("n")).collect()}
    blocks = spark.createDataFrame(
        [(lf, -(-n // BLOCK_ROWS), -(-asked.get(lf, 0) // QUERY_BLOCK) or 1) for lf, n in sizes.items()],
        "leaf long, n_cand long, n_ask long",
    )  # one row a leaf of the tree: bounded by the sample
    cands = (
        indexed.join(F.broadcast(blocks), "leaf")
        .withColumn("cb", F.pmod(F.xxhash64("key", "vec"), F.col("n_cand")))
        .withColumn("qb", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_ask") - 1)))
        .select("leaf", "cb", "qb", "key", "vec")
    )
    asks = (
        asks.join(F.broadcast(blocks), "leaf")
        .withColumn("qb", F.pmod(F.xxhash64("query_id"), F.col("n_ask")))
        .withColumn("cb", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_cand") - 1)))
        .select("leaf", "cb", "qb", "query_id", "qvec")
    )

    def nearest(ask: pd.DataFrame, cand: pd.DataFrame) -> pd.DataFrame:
        if not len(ask) or not len(cand):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        q = np.array(ask["qvec"].tolist(), dtype=np.float64).reshape(len(ask), dim)
        c = np.array(cand["vec"].tolist(), dtype=np.float64).reshape(len(cand), dim)
        ck = cand["key"].astype("Int64").fillna(NULL_KEY).to_numpy(dtype=np.int64)
        d = sq_distances(q, c)
        out_q, out_k, out_s = [], [], []
        for i, qk in enumerate(ask["query_id"].to_numpy(dtype=np.int64)):
            ok = np.flatnonzero(ck != qk)
            best = ok[np.lexsort((ck[ok], d[i, ok]))[:k]]
            out_q += [qk] * len(best)
            out_k += ck[best].tolist()
            out_s += np.sqrt(d[i, best]).tolist()
        keys_out = pd.array([None if v == NULL_KEY else v for v in out_k], dtype="Int64")
        return pd.DataFrame({"query_id": out_q, "vec_id": keys_out, "score": out_s})

    found = (
        asks.groupBy("leaf", "cb", "qb")
        .cogroup(cands.groupBy("leaf", "cb", "qb"))
        .applyInPandas(nearest, "query_id long, vec_id long, score double")
    )
    order = F.row_number().over(Window.partitionBy("query_id").orderBy("score", F.col("vec_id").asc_nulls_last()))
    return found.withColumn("rank", order).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")
