"""Similarity join and repeated strings against brute force."""

from __future__ import annotations

import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest

from tablescope.llm import jaccard, suffix
from tablescope.llm.components import components

from ..conftest import SF
from .cases import frame, got, odd_rows, prose


def shingles(text):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[j : j + 5]) for j in range(max(1, len(words) - 4))) if words else frozenset()


def linked(rows):
    """doc_id -> (size of the set, smallest id in its component), from all pairs that share a shingle."""
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    inverted = defaultdict(list)
    for i, s in sets.items():
        shared = defaultdict(int)
        for g in s:
            for j in inverted[g]:
                shared[j] += 1
            inverted[g].append(i)
        for j, k in shared.items():
            if 100 * k >= 80 * (len(s) + len(sets[j]) - k):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return sorted(((i, len(sets[i]), find(i)) for i in sets), key=repr)


@pytest.mark.parametrize("seed", [1, 2])
def test_join(spark, spread, seed):
    rows = prose(500, seed, copies=0.6)
    assert got(jaccard.join(frame(spark, rows)), "doc_id", "n_shingles", "component_id") == linked(rows)


def test_join_with_hot_shingles_and_small_blocks(spark, spread, monkeypatch):
    monkeypatch.setattr(jaccard, "HOT", 4)
    monkeypatch.setattr(jaccard, "FLUSH", 500)
    monkeypatch.setattr(jaccard, "BLOCK_ENTRIES", 60)
    rows = prose(400, 5, copies=0.8)
    assert got(jaccard.join(frame(spark, rows)), "doc_id", "n_shingles", "component_id") == linked(rows)


def test_join_on_the_given_documents(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    assert got(jaccard.join(df), "doc_id", "n_shingles", "component_id") == linked(rows)


def test_join_odd_rows(spark):
    found = got(jaccard.join(frame(spark, odd_rows())), "doc_id", "n_shingles", "component_id")
    assert len(found) == len(odd_rows())
    by_id = {i: (n, c) for i, n, c in found if i is not None}
    assert by_id[1] == (0, 1) and by_id[2] == (0, 2) and by_id[3] == (0, 3) and by_id[4] == (1, 4)
    assert by_id[5][1] == by_id[6][1] == by_id[-3][1] == -3
    assert (None, by_id[5][0], -3) in found and (None, 0, None) in found
    kept = got(jaccard.keep_one(frame(spark, odd_rows())), "doc_id")
    assert kept == sorted([(i,) for i in (1, 2, 3, 4, 7, 8, 9, 10, 11, 12, -3, None)], key=repr)


def test_empty_tables(spark):
    none = frame(spark, [])
    assert jaccard.join(none).count() == jaccard.keep_one(none).count() == 0
    assert suffix.remove_repeats(none).count() == suffix.cut_repeats(none).count() == 0


def test_divide_skip_and_probing():
    rnd = random.Random(3)
    for _ in range(60):
        sets = [sorted(rnd.sample(range(40), rnd.randint(1, 30))) for _ in range(12)]
        t = rnd.randint(1, 9)
        query = np.array(sorted(rnd.sample(range(40), rnd.randint(t, 30))), np.uint64)
        owners = np.repeat(np.arange(12), [len(s) for s in sets])
        keys = np.array([x for s in sets for x in s], np.uint64)
        order = np.lexsort((owners, keys))
        found = dict(zip(*map(np.ndarray.tolist, jaccard.t_occurrence(query, keys[order], owners[order], t))))
        expected = {i: len(set(s) & set(query.tolist())) for i, s in enumerate(sets)}
        assert found == {i: n for i, n in expected.items() if n >= t}


def test_components(spark):
    rnd = random.Random(4)
    pairs = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(40)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        if a != b:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    found = components(spark.createDataFrame(pairs, "a long, b long")).collect()
    groups = defaultdict(set)
    for r in found:
        groups[r.root].add(r.node)
    expected = defaultdict(set)
    for x in list(root):
        expected[find(x)].add(x)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, expected.values()))


def cut(rows, length=100):
    seen, out = set(), []
    for i, t in sorted(rows, key=lambda r: r[0]):
        raw = (t or "").encode()
        gone = np.zeros(len(raw), bool)
        for p in range(len(raw) - length + 1):
            w = raw[p : p + length]
            if w in seen:
                gone[p : p + length] = True
            seen.add(w)
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        left = np.frombuffer(raw, np.uint8)[~gone].tobytes()
        out.append((i, len(raw), int(gone.sum()), spans, hashlib.sha256(left).hexdigest()))
    return sorted(out, key=repr)


COLUMNS = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


@pytest.mark.parametrize("seed", [1, 2])
def test_repeats(spark, spread, seed):
    rows = prose(250, seed, copies=0.3) + [(1000, "a" * 99), (1001, "a" * 100), (1002, "a" * 350), (1003, "ab" * 300), (1004, "é" * 120), (1005, None)]
    assert got(suffix.remove_repeats(frame(spark, rows)), *COLUMNS) == cut(rows)


def test_repeats_on_the_given_documents(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    assert got(suffix.remove_repeats(df), *COLUMNS) == cut(rows)


def test_repeats_in_small_pieces(spark, spread, monkeypatch):
    for name, value in (("FLUSH", 40), ("HELD_BYTES", 2000), ("SORTED_BYTES", 3000), ("STEP", 2500)):
        monkeypatch.setattr(suffix, name, value)
    rows = prose(150, 9, copies=0.4)
    assert got(suffix.remove_repeats(frame(spark, rows)), *COLUMNS) == cut(rows)


def test_anchors_do_not_depend_on_steps():
    texts = [t.encode() for _, t in prose(40, 3)]
    ends = np.cumsum([len(t) for t in texts])
    whole = suffix.anchors(b"".join(texts), ends, 100, 1 << 20)
    for step in (150, 333, 2500):
        for a, b in zip(suffix.anchors(b"".join(texts), ends, 100, step), whole, strict=True):
            assert a.tolist() == b.tolist()


def test_copies_across_a_step(spark, spread, monkeypatch):
    """Copies of a text in several tasks, of which some lie across a step and some do not: the first keeps all bytes."""
    monkeypatch.setattr(suffix, "STEP", 400)
    rnd = random.Random(11)
    texts = [" ".join(f"{rnd.randrange(10**6)}" for _ in range(rnd.choice([20, 40, 70]))) for _ in range(20)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(100 + i, t) for i, t in enumerate(reversed(texts))]
    rows += [(200 + i, t) for i, t in enumerate(texts[7:] + texts[:7])]
    df = spark.createDataFrame(spark.sparkContext.parallelize(rows, 3), "doc_id long, text string")
    assert got(suffix.remove_repeats(df), *COLUMNS) == cut(rows)


@pytest.mark.parametrize("held", [16 << 20, 3000])
def test_a_hot_anchor_is_not_one_group(spark, spread, monkeypatch, held):
    """Lines and passages with another neighbourhood in every text: no task sorts more of their runs than allowed."""
    limit, sort = 30, suffix.later_windows

    def guarded(runs, length):
        if len(runs) > limit:
            raise ValueError(f"{len(runs)} runs at once")
        return sort(runs, length)

    monkeypatch.setattr(suffix, "later_windows", guarded)
    monkeypatch.setattr(suffix, "HOT_RUNS", limit, raising=False)
    monkeypatch.setattr(suffix, "SORTED_BYTES", 0)
    monkeypatch.setattr(suffix, "HELD_BYTES", held)
    rnd = random.Random(12)
    line, passage = ("".join(rnd.choices("abcdefgh ", k=k)) for k in (70, 260))
    rows = []
    for i in range(200):
        a, b = ("".join(rnd.choices("klmnop ", k=rnd.randrange(40, 130))) for _ in range(2))
        rows.append((i, a + (line if i % 3 else passage[rnd.randrange(60) :]) + b + (line * 2 if i % 7 == 0 else "")))
    rnd.shuffle(rows)
    df = spark.createDataFrame(spark.sparkContext.parallelize(rows, 3), "doc_id long, text string")
    assert got(suffix.remove_repeats(df), *COLUMNS) == cut(rows)


def test_repeats_odd_rows(spark):
    found = got(suffix.remove_repeats(frame(spark, odd_rows())), *COLUMNS)
    assert len(found) == len(odd_rows())
    left = [(i, n, k) for i, n, k, *_ in found if i in (5, 6, None)]
    whole = [x for x in left if x[1]]
    # the smallest key keeps its text; a repeated row and a null key lose theirs
    assert [k == 0 for i, n, k in whole if i == 5] == [True] and all(k == n for i, n, k in whole if i != 5)
    rows = {r.doc_id: r for r in suffix.cut_repeats(frame(spark, odd_rows())).collect()}
    assert rows[5].text == dict(odd_rows())[5] and 6 not in rows and rows[5].key == "c"


def test_cut_texts_stay_text(spark):
    a = "".join(chr(300 + i) for i in range(120))
    rows = [(1, a), (2, "x" + a + "y" * 3)]
    out = {r.doc_id: r for r in suffix.cut_repeats(spark.createDataFrame([(i, t, len(t)) for i, t in rows], "doc_id long, text string, n_chars long")).collect()}
    assert out[1].text == a and out[2].text == "xyyy" and out[2].n_chars == 4


@pytest.mark.parametrize("alphabet", [b"ab", b"abcd "])
def test_deep_shallow_order(alphabet):
    rnd = random.Random(2)
    buf = bytes(rnd.choice(alphabet) for _ in range(600)) * 2 + b"x" * 200
    starts = list(range(len(buf) - 64))
    rnd.shuffle(starts)
    groups = list(suffix.sorted_groups(buf, np.array(starts), 64))
    assert [buf[g[0] : g[0] + 64] for g in groups] == sorted({buf[s : s + 64] for s in starts})
    assert sorted(s for g in groups for s in g) == sorted(starts)
    assert all(len({buf[s : s + 64] for s in g}) == 1 for g in groups)


def test_partitions_follow_the_size_without_a_limit(spark, monkeypatch):
    from tablescope.llm import common

    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for tb in (1, 9, 100):
        monkeypatch.setattr(common, "input_bytes", lambda _df, tb=tb: tb << 40)
        assert common.parts_for(df, 8 << 20) == -(-(tb << 40) // (8 << 20))
    monkeypatch.undo()
    # a frame that no file backs has no known size: its rows are counted and measured
    rows = spark.createDataFrame([(i, "x" * 1000) for i in range(2000)], "doc_id long, text string")
    assert common.parts_for(rows, 100_000) == -(-2000 * 1008 // 100_000)
    assert common.parts_for(rows.limit(0), 100_000) == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_release_since_a_point_leaves_earlier_tables(spark):
    from tablescope.llm import common

    early = common.written(spark.createDataFrame([(1, "a")], "doc_id long, text string"), "early")
    point = common.mark()
    common.written(spark.createDataFrame([(2, "b")], "doc_id long, text string"), "late")
    common.release(spark, since=point)
    assert early.count() == 1 and common.mark() == point


def test_a_result_made_before_the_pipeline_survives_it(spark):
    import corpus_pipeline
    from tablescope.llm import jaccard

    from ..conftest import SF

    before = jaccard.join(spark.createDataFrame([(1, "a b c d e f"), (2, "a b c d e f"), (3, "x y")], "doc_id long, text string"))
    corpus_pipeline.run(spark, SF).count()
    assert sorted(tuple(r) for r in before.select("doc_id", "component_id").collect()) == [(1, 1), (2, 1), (3, 3)]


def test_shared_anchors_come_in_one_row_per_text(spark):
    """However many partitions the anchors are dealt over, and wherever a text's anchors meet others."""
    rng = random.Random(17)
    passages = [bytes(rng.choices(range(97, 123), k=300)).decode() for _ in range(12)]
    texts = ["".join(rng.sample(passages, 6)) + bytes(rng.choices(range(97, 123), k=50)).decode() for _ in range(30)]
    df = spark.createDataFrame([(hashlib.md5(t.encode()).hexdigest(), t) for t in texts], "digest string, text string").repartition(3)
    for parts in (1, 40):
        rows = suffix._shared_anchors(suffix._find_anchors(df, 100, parts), parts).collect()
        assert len(rows) == len({(r["high"], r["low"]) for r in rows}) == 30
