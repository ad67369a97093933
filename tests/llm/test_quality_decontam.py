"""Quality rules, decontamination, and the pipeline."""

from __future__ import annotations

import os
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tablescope.llm import decontam, quality
from tablescope.llm.common import release

from ..conftest import SF
from .cases import frame, got, odd_rows, prose
from .test_duplicates import cut, linked


def base(text):
    words = (text or "").encode().split()
    lines = [x for x in (text or "").split("\n") if x.encode().split()]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    often = Counter(windows)
    covered = {j for i, w in enumerate(windows) if often[w] > 1 for j in range(i, i + 5)}
    chars = sum(len(w.decode()) for w in words)
    symbols = sum((text or "").count(c) for c in "#*$%&|<>")
    failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
    return len(words), chars, symbols, len(lines) - len(set(lines)), len(covered), failed


def test_base_counts(spark):
    rows = odd_rows() + [(50, "a b c d e f\n\n a b c d e # |\nx\nx\n"), (51, "1 2 3 4 5 6 7 8 9 0 * 1 2 3 4 5\r\n\x0b")]
    trees = quality.fit_trees(np.zeros((0, len(quality.FEATURES))), np.zeros(0), [0] * len(quality.FEATURES))
    out = quality.quality(frame(spark, rows), trees)
    found = got(out, "doc_id", *quality.BASE, "base_failed")
    assert found == sorted([(i, *base(t)) for i, t in rows], key=repr)
    assert {r.kept for r in out.collect() if r.base_failed} == {False}
    kept = got(quality.keep_good(frame(spark, rows), trees), "doc_id", "text")
    assert kept == sorted([(i, t) for i, t in rows if not base(t)[5]], key=repr)


def test_trees_are_monotone():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(2000, 3))
    y = (np.sin(3 * x[:, 0]) + x[:, 1] + 0.3 * rng.normal(size=2000) > 0).astype(float)
    trees = quality.fit_trees(x, y, [0, -1, 1], rounds=30)
    for f, sign in ((1, -1), (2, 1)):
        low, high = x.copy(), x.copy()
        high[:, f] += rng.random(2000) * 2
        assert (sign * (trees.margin(high) - trees.margin(low)) >= -1e-12).all()
    free = quality.fit_trees(x, y, [0, 0, 0], rounds=60)
    assert ((free.probability(x) > 0.5) == y).mean() > 0.9
    assert quality.fit_trees(x, np.ones(2000), [0, 0, 0]).probability(x).min() > 0.9


def test_held_out_accuracy(spark):
    larger = f"{os.path.dirname(SF.rstrip('/'))}/sf0.01"  # the smallest tables have too few bad documents
    docs, labels = (spark.read.parquet(f"{larger}/{t}.parquet") for t in ("documents", "labels"))
    trees = quality.fit(docs, labels.where("doc_id % 2 = 0"))
    found = {r.doc_id: r for r in quality.quality(docs, trees).collect()}
    held = [(r.quality, found[r.doc_id]) for r in labels.where("doc_id % 2 = 1").collect() if r.doc_id in found]
    good = [f.score >= 0.5 for q, f in held if q]
    bad = [f.kept for q, f in held if not q]
    assert np.mean(good) >= 0.95 and np.mean(bad) <= 0.1


def test_fit_without_labels(spark):
    docs = frame(spark, prose(30))
    labels = spark.createDataFrame([(1, None, 0), (None, 1, 0), (999, 0, 0)], "doc_id long, quality int, toxic int")
    assert quality.quality(docs, quality.fit(docs, labels)).count() == 30


def items(spark):
    rnd = random.Random(5)
    words = [f"q{i}" for i in range(400)]
    rows = [(i, " ".join(rnd.choices(words, k=rnd.choice([12, 30, 50])))) for i in range(12)]
    return rows, spark.createDataFrame([*rows, (50, None), (51, "too short"), (52, "")], "item_id long, text string")


def dirty(rows):
    """(documents, expected pairs): exact, upper-cased and edited copies, and parts too small to count."""
    rnd = random.Random(6)
    plain = [t for _, t in prose(80, 8, copies=0)]
    docs, expected = [], set()
    for i, t in enumerate(plain):
        words = t.split()
        if i % 4 == 0:
            item, text = rows[i % len(rows)]
            copy = text.split()
            if i % 8 == 0:  # every seventh word is another
                copy = [w if k % 7 else "changed" for k, w in enumerate(copy)]
            if i % 12 == 0:
                copy = [w.upper() + "," for w in copy]
            if i % 20 == 0:
                copy.insert(len(copy) // 2, "inserted")
            words[rnd.randrange(len(words)) :] = copy
            expected.add((i, item))
        elif i % 4 == 1:
            words += rows[i % len(rows)][1].split()[:4]
        docs.append((i, " ".join(words)))
    return docs, expected


@pytest.mark.parametrize("sent", [decontam.SENT_WORDS, 0])
def test_contamination(spark, monkeypatch, sent):
    monkeypatch.setattr(decontam, "SENT_WORDS", sent)
    rows, table = items(spark)
    docs, expected = dirty(rows)
    df = frame(spark, [*docs, (900, None), (901, "")])
    found = decontam.contaminated(df, table)
    assert {(r.doc_id, r.item_id) for r in found.collect()} == expected
    kept = {r.doc_id for r in decontam.keep_clean(df, table).collect()}
    assert kept == {i for i, _ in docs} - {i for i, _ in expected} | {900, 901}
    assert decontam.contaminated(df, table.limit(0)).count() == 0
    assert decontam.contaminated(frame(spark, []), table).count() == 0
    assert decontam.contaminated(frame(spark, odd_rows()), table).count() == 0


@pytest.mark.parametrize("sent", [decontam.SENT_WORDS, 0])
def test_rows_that_share_a_key_are_judged_on_their_own(spark, monkeypatch, sent):
    monkeypatch.setattr(decontam, "SENT_WORDS", sent)
    rows, table = items(spark)
    copy = "before it " + rows[0][1] + " behind it"
    clean = [(None, "clean one"), (None, None), (7, "clean two"), (7, "clean two"), (8, "clean three")]
    df = frame(spark, [(None, copy), *clean, (7, copy), (7, copy)])
    kept = decontam.keep_clean(df, table)
    assert kept.columns == df.columns
    assert got(kept, "doc_id", "text", "row", "_key") == sorted([(*r, "c", "c") for r in clean], key=repr)
    assert got(decontam.contaminated(df, table), "doc_id", "item_id") == sorted([(None, 0), (7, 0), (7, 0)], key=repr)


def smith_waterman(a, b):
    best = 0
    h = np.zeros((len(a) + 1, len(b) + 1), int)
    for i in range(len(a)):
        for j in range(len(b)):
            s = decontam.MATCH if a[i] == b[j] else decontam.MISMATCH
            h[i + 1, j + 1] = max(0, h[i, j] + s, h[i, j + 1] + decontam.GAP, h[i + 1, j] + decontam.GAP)
            best = max(best, h[i + 1, j + 1])
    return best


def test_alignment_scores():
    rng = np.random.default_rng(3)
    for _ in range(60):
        a, b = (rng.integers(0, 6, rng.integers(1, 25)).astype(np.uint64) for _ in range(2))
        score, start, end, _ = decontam.aligned(a, b)
        assert score == smith_waterman(a, b)
        assert not score or smith_waterman(a, b[start:end]) == score


def test_given_benchmark(spark):
    """Every exact copy of an item is found."""
    docs, table = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    texts = {r.doc_id: " ".join(r.text.split()) for r in docs.collect()}
    exact = {(i, r.item_id) for r in table.collect() for i, t in texts.items() if " ".join(r.text.split()) in t}
    assert {(r.doc_id, r.item_id) for r in decontam.contaminated(docs, table).collect()} >= exact


def test_pipeline_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality rules", "n-gram Jaccard join", "suffix-array dedup", "benchmark decontamination", "BPE encoding and decoding"
    ]
    rows = {r.doc_id: r.text for r in docs.collect()}
    verdict = quality.quality(docs, quality.fit(docs, spark.read.parquet(f"{SF}/labels.parquet")))
    rows = {r.doc_id: rows[r.doc_id] for r in verdict.where("kept").collect()}
    rows = {i: rows[i] for i, _, c in linked(rows.items()) if i == c}
    seen = {}
    for i in sorted(rows):
        raw = rows[i].encode()
        gone = np.zeros(len(raw), bool)
        for p in range(len(raw) - 99):
            if seen.setdefault(raw[p : p + 100], (i, p)) != (i, p):
                gone[p : p + 100] = True
        rows[i] = np.frombuffer(raw, np.uint8)[~gone].tobytes().decode("utf-8", "ignore")
    rows = {i: t for i, t in rows.items() if t.strip()}
    dirty_ids = {r.doc_id for r in decontam.contaminated(spark.createDataFrame(list(rows.items()), "doc_id long, text string"), spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    rows = {i: t for i, t in rows.items() if i not in dirty_ids}
    stage = docs
    for _, f in corpus_pipeline.STAGES[:-1]:
        stage = f(spark, stage, SF)
        assert stage.columns == columns
        stage = spark.createDataFrame(stage.collect(), stage.schema)
    assert {r.doc_id: r.text for r in stage.collect()} == rows
    assert all(r.n_chars == len(r.text) for r in stage.collect())
    result = corpus_pipeline.run(spark, SF)
    assert {r.doc_id for r in result.collect()} == set(rows)
    assert result.agg(F.sum("n_tokens")).first()[0] > 0
    release(spark)


def test_stages_on_odd_rows(spark, tmp_path):
    for table in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{table}.parquet").write.parquet(f"{tmp_path}/{table}.parquet")
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for rows in (odd_rows(), []):
        stage = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], schema)
        for k, (_, f) in enumerate(corpus_pipeline.STAGES):
            f(spark, stage, str(tmp_path)).write.parquet(f"{tmp_path}/out{len(rows)}-{k}")
            stage = spark.read.parquet(f"{tmp_path}/out{len(rows)}-{k}")
        assert (stage.count() > 0) == bool(rows)
    assert cut([(1, "a")])[0][2] == 0
