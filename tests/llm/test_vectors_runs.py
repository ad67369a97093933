"""Periodic runs against the definition, tree search against brute force, vector codes against plain k-means."""

from __future__ import annotations

import hashlib
import math
import random
import zlib

import numpy as np
import pytest

from tablescope.llm import ann, codes, periodic

from .cases import CLASHING, odd_rows


# ---- periodic runs ---------------------------------------------------------------------------------------------


def brute_runs(words: list[str]) -> list[tuple[int, int, int]]:
    """Every maximal stretch of period q whose smallest period is q and that is long enough, by the definition."""
    n, out = len(words), set()
    for q in range(1, n + 1):
        for s in range(n):
            if s > 0 and s - 1 + q < n and words[s - 1] == words[s - 1 + q]:
                continue
            e = s
            while e + q < n and words[e] == words[e + q]:
                e += 1
            length = e - s + q
            if s + length > n or length < max(24, 3 * q):
                continue
            stretch = words[s : s + length]
            smallest = next(d for d in range(1, length + 1) if all(stretch[i] == stretch[i + d] for i in range(length - d)))
            if smallest == q:
                out.add((s, length, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute_describe(text, doc_id):
    words = periodic.WORD.findall(text or "")
    h = None if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h is not None and h % 10 == 0 and words:
        g = h // 10
        a = g % len(words)
        p = 1 + (len(words) - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, len(words))]
    found = brute_runs(words)
    drop = set()
    for s, n, q in found:
        drop |= set(range(s + q, s + n))
    kept = " ".join(w for i, w in enumerate(words) if i not in drop)
    best = None
    for r in found:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    head = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (doc_id, len(found), *head, sha("".join(f"{s},{n},{q}\n" for s, n, q in found)), sha(kept))


def periodic_rows():
    rnd = random.Random(3)
    rows = [(i, t) for i, t in odd_rows() if t is None or len(t) < 3000]
    for i in range(40):
        unit = rnd.choices("abcde", k=rnd.choice([1, 2, 3, 5, 9, 12]))
        body = rnd.choices("abcdefg", k=rnd.randrange(0, 30)) + unit * rnd.randrange(2, 30) + unit[: rnd.randrange(len(unit))]
        body += rnd.choices("xyzab", k=rnd.randrange(0, 30))
        rows.append((100 + i, " ".join(body)))
    # ids whose crc32 ends in 0 get the planted repetition
    planted = [i for i in range(1000, 5000) if zlib.crc32(str(i).encode()) % 10 == 0][:8]
    rows += [(i, " ".join(rnd.choices("abcdefghijklmnop", k=rnd.randrange(5, 120)))) for i in planted]
    return rows


def test_runs_equal_the_definition(spark):
    rows = periodic_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    df = df.selectExpr("*", *[f"'c' AS `{c}`" for c in CLASHING])
    got = sorted((tuple(r) for r in periodic.detect(df).select(
        "doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256").collect()), key=repr)
    want = sorted((brute_describe(t, i) for i, t in rows), key=repr)
    assert got == want
    assert sum(r[1] > 0 for r in got) >= 20


def test_runs_splitting_keeps_every_run():
    rnd = random.Random(5)
    for _ in range(300):
        words = rnd.choices("abc", k=rnd.randrange(0, 90))
        if rnd.random() < 0.5:
            unit = rnd.choices("abcd", k=rnd.randrange(1, 8))
            cut = rnd.randrange(len(words) + 1)
            words = words[:cut] + unit * rnd.randrange(3, 12) + words[cut:]
        assert periodic.runs(words) == brute_runs(words)


def test_runs_edge_cases(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert periodic.detect(empty).count() == 0
    long_text = " ".join(["the", "cat"] * 20_000)
    row = periodic.describe(long_text, 1)
    assert row[:4] == (1, 0, 40_000, 2) and row[-1] == 40_000 - 2


# ---- nearest neighbours ------------------------------------------------------------------------------------------


def brute_knn(rows, every=100, k=10):
    ok = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v) and any(c != 0 for c in v)]
    keys = np.array([i for i, _ in ok])
    x = np.array([v for _, v in ok], dtype=np.float64)
    out = {}
    for j in np.flatnonzero(keys % every == 0):
        d = np.sqrt(((x - x[j]) ** 2).sum(1))
        cand = np.flatnonzero(keys != keys[j])
        best = cand[np.lexsort((keys[cand], d[cand]))[:k]]
        out[int(keys[j])] = [(int(keys[b]), float(d[b])) for b in best]
    return out


def vector_rows(n=3000, dim=16, seed=2):
    rnd = np.random.RandomState(seed)
    centers = rnd.normal(size=(20, dim))
    rows = [(i, (centers[i % 20] + 0.3 * rnd.normal(size=dim)).astype(np.float32).tolist()) for i in range(n)]
    rows += [(n + i, rows[7][1]) for i in range(300)]  # a large group of copies
    rows += [(n + 400, None), (n + 500, [0.0] * dim), (n + 600, [float("nan")] + [1.0] * (dim - 1)), (n + 700, [None] * dim)]
    return rows


def test_search_recall_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(ann, "FIT_ROWS", 1000)
    monkeypatch.setattr(ann, "BLOCK_ROWS", 200)
    monkeypatch.setattr(ann, "QUERY_BLOCK", 5)
    rows = vector_rows()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", *[f"'c' AS `{c}`" for c in CLASHING])
    got = {}
    for r in ann.search(df, every=100, k=10).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    want = brute_knn(rows)
    assert set(got) == set(want)
    hits = total = 0
    for q, w in want.items():
        g = sorted(got[q])
        assert [r for r, _, _ in g] == list(range(1, len(w) + 1))
        assert [s for _, _, s in g] == sorted(s for _, _, s in g)
        exact = dict(w)
        for _, v, s in g:  # every score is the true distance
            d = np.sqrt(((np.array(rows[v][1], dtype=np.float64) - np.array(rows[q][1], dtype=np.float64)) ** 2).sum()) if v < len(rows) else None
            assert d is None or abs(d - s) < 1e-12
        hits += len({v for _, v, _ in g} & set(exact))
        total += len(w)
    assert hits / total >= 0.9


def test_search_few_and_empty(spark):
    few = [(0, [1.0, 2.0]), (100, [1.0, 2.0]), (5, [3.0, 0.0]), (200, None), (300, [0.0, 0.0])]
    got = [tuple(r) for r in ann.search(spark.createDataFrame(few, "vec_id long, embedding array<float>")).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 100, 0.0), (0, 2, 5, math.sqrt(8)), (100, 1, 0, 0.0), (100, 2, 5, math.sqrt(8))]
    assert ann.search(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


# ---- vector codes --------------------------------------------------------------------------------------------------


def brute_codes(rows, parts, entries, rounds):
    """Plain Lloyd steps on the definition; repeated rows are rows of their own."""
    kept = [(i, lab, [math.floor(256 * float(c)) for c in v]) for i, v, lab in rows
            if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    width = len(kept[0][2]) // parts
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[2]))[:entries]
    book = [[q[p * width : (p + 1) * width] for _, _, q in first] for p in range(parts)]

    def near(p, part):
        d = [sum((a - b) ** 2 for a, b in zip(part, e)) for e in book[p]]
        return d.index(min(d)), min(d)

    for _ in range(rounds):
        new = [list(map(list, b)) for b in book]
        for p in range(parts):
            acc = {}
            for _, _, q in kept:
                part = q[p * width : (p + 1) * width]
                acc.setdefault(near(p, part)[0], []).append(part)
            for e, got in acc.items():
                new[p][e] = [sum(c) // len(got) for c in zip(*got)]
        book = new
    out, by_label = [], {}
    for i, lab, q in kept:
        found = [near(p, q[p * width : (p + 1) * width]) for p in range(parts)]
        out.append((i, "".join(f"{e:02x}" for e, _ in found), sum(d for _, d in found), lab))
        by_label[lab] = by_label.get(lab, 0) + out[-1][2]
    digest = hashlib.sha256(",".join(str(c) for b in book for e in b for c in e).encode()).hexdigest()
    return sorted((i, c, err, by_label[lab], digest) for i, c, err, lab in out)


def test_codes_equal_plain_kmeans(spark, monkeypatch):
    monkeypatch.setattr(codes, "LEAF", 3)
    rnd = np.random.RandomState(4)
    rows = [(i, (rnd.normal(size=8) * (1 + i % 3)).astype(np.float32).tolist(), int(i % 4) if i % 7 else None) for i in range(400)]
    rows += [(400 + i, rows[3][1], 1) for i in range(80)]  # copies
    rows += [(900, None, 1), (901, [float("inf")] + [0.0] * 7, 2), (902, [0.0] * 8, 2), (903, [None] * 8, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").selectExpr("*", *[f"'c' AS `{c}`" for c in CLASHING])
    got = sorted(tuple(r) for r in codes.compress(df, parts=4, entries=16, rounds=2).select(
        "vec_id", "code", "error", "label_error", "codebooks_sha256").collect())
    assert got == brute_codes(rows, 4, 16, 2)


def test_codes_few_rows_and_empty(spark):
    rows = [(5, [0.5, -0.5], 1), (3, [0.25, 0.25], 1), (3, [0.25, 0.25], None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = sorted(tuple(r) for r in codes.compress(df, parts=2, entries=64, rounds=2).select(
        "vec_id", "code", "error", "label_error", "codebooks_sha256").collect())
    assert got == brute_codes(rows, 2, 64, 2)
    assert codes.compress(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0
    with pytest.raises(ValueError):
        codes.compress(spark.createDataFrame([(1, [1.0, 2.0, 3.0], 1)], "vec_id long, embedding array<float>, label int"), parts=2)
