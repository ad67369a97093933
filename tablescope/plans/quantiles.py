"""Exact quantiles (linear interpolation) of many columns at any size.

A sketch gives, per target, a bracket that must hold the wanted ranks; one more pass counts the rows below each bracket
and the values inside it, which are a few thousandths of the rows.  The answer is exact: the
counts prove that the ranks lie inside, and a bracket that fails the proof is widened and counted again.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from .ranges import running

ACCURACY = 10_000
BRACKET_ACCURACY = 2_000  # sketches of all tasks meet in one task, so they are kept small


def quantiles(
    df: DataFrame, columns: dict[str, Column], probs: list[float], method: str = "exact", counts: dict[str, int] | None = None
) -> dict[str, list[float | None]]:
    """Quantiles per column as driver values: len(columns) x len(probs) numbers.

    ``columns`` maps a name to a double expression in which missing values are null.
    ``method`` is ``exact`` or ``approx`` (a sketch).  ``counts`` gives the non-missing cells per column if they are known.
    """
    if method not in ("exact", "approx"):
        raise ValueError(f"unknown method {method!r}")
    if not columns:
        return {}
    values = df.select(*[expr.cast("double").alias(f"v{i}") for i, expr in enumerate(columns.values())])
    wanted = [float(p) for p in probs]
    if method == "approx":
        row = values.agg(*[F.percentile_approx(c, wanted, ACCURACY).alias(c) for c in values.columns]).first()
        return {name: list(row[f"v{i}"] or [None] * len(probs)) for i, name in enumerate(columns)}
    if counts is None:
        row = values.agg(*[F.count(c).alias(c) for c in values.columns]).first()
        filled = {i: row[f"v{i}"] for i in range(len(columns))}
    else:
        filled = {i: counts[name] for i, name in enumerate(columns)}
    found = _bracketed(values, filled, wanted)
    return {name: [found.get((i, j)) for j in range(len(probs))] for i, name in enumerate(columns)}


def _counted(cells: DataFrame) -> DataFrame:
    """(t, v, n): the cells of all columns with their counts; equal ones combine before the shuffle."""
    long = cells.unpivot([], cells.columns, "t", "v").where(F.col("v").isNotNull())
    return long.groupBy("t", "v").agg(F.count("*").alias("n"))


def _bracketed(values: DataFrame, counts: dict[int, int], probs: list[float]) -> dict[tuple[int, int], float]:
    result: dict[tuple[int, int], float] = {}
    pending = [(i, j) for i in counts if counts[i] for j in range(len(probs))]
    slack = 2.0 / BRACKET_ACCURACY
    while pending:
        touched = sorted({i for i, _ in pending})
        edges = {
            i: sorted({min(1.0, max(0.0, probs[j] + s)) for c, j in pending if c == i for s in (-slack, slack)})
            for i in touched
        }
        first = values.agg(
            *[
                a
                for i in touched
                for a in (
                    F.min(f"v{i}").alias(f"lo{i}"), F.max(f"v{i}").alias(f"hi{i}"),
                    F.percentile_approx(f"v{i}", edges[i], BRACKET_ACCURACY).alias(f"b{i}"),
                )
            ]
        ).first()
        brackets = {}
        for i, j in pending:
            low, high = (first[f"b{i}"][edges[i].index(min(1.0, max(0.0, probs[j] + s)))] for s in (-slack, slack))
            # At the ends the true minimum or maximum is used, so widening always ends.
            low = first[f"lo{i}"] if probs[j] - slack <= 0 else low
            high = first[f"hi{i}"] if probs[j] + slack >= 1 else high
            brackets[(i, j)] = (low, high)
        found = _pick(values, brackets, counts, probs)
        result.update(found)
        pending = [t for t in brackets if t not in found]
        slack = min(1.0, slack * 8)
    return result


def _pick(values, brackets, counts, probs) -> dict[tuple[int, int], float]:
    """Ranks inside each bracket; a target is absent when its bracket misses its ranks."""
    targets = {target: f"t{t}" for t, target in enumerate(brackets)}
    cells = []
    for (i, j), t in targets.items():
        low, high = brackets[(i, j)]
        v = F.col(f"v{i}")
        # Values below the bracket only count, so they fall together; those above it are dropped.
        cells.append(F.when(v < F.lit(low), F.lit(float("-inf"))).when(v <= F.lit(high), v).alias(t))
    counted = _counted(values.select(*cells))
    ranked = running(counted, [F.col("v")], {"upto": ("sum", F.col("n"))}, keys=["t"])
    found = _locate(ranked, targets, counts, probs)
    return {t: v for t, v in found.items() if v >= brackets[t][0]}


def _locate(ranked: DataFrame, targets: dict, counts, probs) -> dict[tuple[int, int], float]:
    """Interpolate between the values at the two ranks of each target (column, prob) -> its ``t``."""

    def ranks(i: int, j: int) -> tuple[int, int]:
        position = probs[j] * (counts[i] - 1)
        return math.floor(position), math.ceil(position)

    hit = F.lit(False)
    for t, k in sorted({(t, k) for (i, j), t in targets.items() for k in ranks(i, j)}):
        hit = hit | ((F.col("t") == t) & (F.col("upto") > k) & (F.col("upto") - F.col("n") <= k))
    # At most two rows per target.
    rows = ranked.where(hit).select("t", "v", "n", "upto").collect()
    answer = {}
    for (i, j), t in targets.items():
        pair = [
            next((r["v"] for r in rows if r["t"] == t and r["upto"] - r["n"] <= k < r["upto"]), None) for k in ranks(i, j)
        ]
        if None not in pair:
            part = probs[j] * (counts[i] - 1) - ranks(i, j)[0]
            answer[(i, j)] = pair[0] + part * (pair[1] - pair[0]) if pair[0] != pair[1] else pair[0]
    return answer
