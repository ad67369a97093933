"""Shape of one numeric column: two peaks, or a split into two modes."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import value_of
from ..plans.quantiles import quantiles
from .stats import approx_distinct

BINS = 64
SPLIT_BINS = 256
TAIL = 0.005
PEAK_SHARE = 0.10
VALLEY_SHARE = 0.5
MIN_ROWS = 640
MIN_DISTINCT = 20


def bin_of(value: Column, low: float, high: float, bins: int) -> Column:
    """Bin 0..bins-1 of equal width; the upper end belongs to the last bin."""
    width = F.floor((value - F.lit(low)) / F.lit(high - low) * bins)
    return F.least(width, F.lit(bins - 1).cast("long"))


def histogram(df: DataFrame, value: str | Column, low: float, high: float, bins: int) -> DataFrame:
    """(bin, n, total) of the values within [low, high]; empty bins are absent."""
    v = value_of(df, value)
    inside = df.select(v.alias("v")).where(F.col("v").between(low, high))
    return inside.groupBy(bin_of(F.col("v"), low, high, bins).alias("bin")).agg(
        F.count("*").alias("n"), F.sum("v").alias("total")
    )


def bimodality(df: DataFrame, value: str | Column, method: str = "exact") -> DataFrame:
    """Whether a column has two peaks, with moments and Sarle's coefficient for information.

    64 bins between the 0.5 and 99.5 percentiles, three-bin average; two local maxima of at least 10 % of
    the highest, with a valley between them of at most half the lower one.  Null for fewer than 640 rows or
    20 distinct values.
    """
    v = value_of(df, value)
    spark = df.sparkSession
    row = df.select(v.alias("v")).agg(
        F.count("v").alias("n"), approx_distinct(F.col("v")).alias("d"), F.skewness("v").alias("skew"), F.kurtosis("v").alias("kurt")
    ).first()
    n, distinct = row["n"], row["d"] or 0
    if n and distinct <= 10 * MIN_DISTINCT:
        # At most a few hundred values, so the set stays small.
        distinct = df.select(v.alias("v")).agg(F.size(F.collect_set("v")).alias("d")).first()["d"]
    skew, kurt = row["skew"], row["kurt"]
    sarle = None if kurt is None or skew is None or kurt + 3 == 0 else (skew * skew + 1) / (kurt + 3)
    verdict = peaks = low_peak = high_peak = None
    if n >= MIN_ROWS and distinct >= MIN_DISTINCT:
        low, high = quantiles(df, {"v": v}, [TAIL, 1 - TAIL], method)["v"]
        if high > low:
            # 64 numbers at most come to the driver.
            counts = {r["bin"]: r["n"] for r in histogram(df, v, low, high, BINS).collect()}
            verdict, peaks = _two_peaks([counts.get(i, 0) for i in range(BINS)])
            width = (high - low) / BINS
            if verdict:
                low_peak, high_peak = (low + (p + 0.5) * width for p in peaks)
    return spark.createDataFrame(
        [(n, skew, kurt, sarle, verdict, low_peak, high_peak)],
        "n long, skewness double, kurtosis double, sarle double, bimodal boolean, low_peak double, high_peak double",
    )


def _two_peaks(counts: list[int]) -> tuple[bool, tuple[int, int] | None]:
    """The two highest qualifying peaks of a small histogram."""
    last = len(counts) - 1
    smooth = [sum(counts[max(0, i - 1) : i + 2]) / len(counts[max(0, i - 1) : i + 2]) for i in range(len(counts))]
    top = max(smooth)
    maxima = [
        i
        for i in range(last + 1)
        if smooth[i] >= PEAK_SHARE * top
        and (i == 0 or smooth[i] > smooth[i - 1])
        and (i == last or smooth[i] >= smooth[i + 1])
    ]
    best = None
    for a, i in enumerate(maxima):
        for j in maxima[a + 1 :]:
            lower = min(smooth[i], smooth[j])
            if min(smooth[i : j + 1]) <= VALLEY_SHARE * lower and (best is None or lower > best[0]):
                best = (lower, (i, j))
    return best is not None, best[1] if best else None


def two_mode_split(df: DataFrame, value: str | Column, weight: str | Column | None = None) -> DataFrame:
    """Both sides of the split that best separates a column (between-class variance on 256 bins).

    Gives the centres, their share of rows and of ``weight`` (the column itself by default), and the gap.
    """
    v = value_of(df, value)
    w = v if weight is None else value_of(df, weight)
    pairs = df.select(v.alias("v"), w.alias("w")).where(F.col("v").isNotNull())
    ends = pairs.agg(F.min("v").alias("lo"), F.max("v").alias("hi")).first()
    schema = (
        "threshold double, low_n long, high_n long, low_center double, high_center double, low_volume_share double, "
        "high_volume_share double, low_value_share double, high_value_share double, gap double"
    )
    if ends["lo"] is None or ends["lo"] == ends["hi"]:
        return df.sparkSession.createDataFrame([], schema)
    low, high = ends["lo"], ends["hi"]
    bins = histogram(pairs, F.col("v"), low, high, SPLIT_BINS)
    # Windows over 256 rows.
    upto = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(F.lit(0))
    scored = (
        bins.withColumn("n0", F.sum("n").over(upto))
        .withColumn("s0", F.sum("total").over(upto))
        .withColumn("n1", F.sum("n").over(whole) - F.col("n0"))
        .withColumn("s1", F.sum("total").over(whole) - F.col("s0"))
        .where("n1 > 0")
        .withColumn("score", F.col("n0").cast("double") * F.col("n1") * F.pow(F.col("s0") / F.col("n0") - F.col("s1") / F.col("n1"), 2))
    )
    best = scored.orderBy(F.col("score").desc(), "bin").select("bin").first()["bin"]
    threshold = low + (best + 1) * (high - low) / SPLIT_BINS
    upper = bin_of(F.col("v"), low, high, SPLIT_BINS) > best
    row = pairs.agg(
        *[
            f.alias(a)
            for side, cond in (("low", ~upper), ("high", upper))
            for f, a in (
                (F.count_if(cond), f"{side}_n"),
                (F.avg(F.when(cond, F.col("v"))), f"{side}_center"),
                (F.sum(F.when(cond, F.col("w"))), f"{side}_w"),
            )
        ],
        F.count("*").alias("n"),
        F.sum("w").alias("w"),
    )
    return row.select(
        F.lit(threshold).alias("threshold"), "low_n", "high_n", "low_center", "high_center",
        (F.col("low_n") / F.col("n")).alias("low_volume_share"),
        (F.col("high_n") / F.col("n")).alias("high_volume_share"),
        F.try_divide(F.col("low_w"), F.col("w")).alias("low_value_share"),
        F.try_divide(F.col("high_w"), F.col("w")).alias("high_value_share"),
        (F.col("high_center") - F.col("low_center")).alias("gap"),
    )


def bimodality_of(df: DataFrame, values: dict[str, str | Column], method: str = "exact") -> DataFrame:
    """``bimodality`` of many columns at once: one row per label, with the same rules.

    The passes do not grow with the number of columns: one aggregate for counts, distinct estimates and moments, the
    quantile passes of all columns together, and one pass that counts the cells of all columns by (column, bin); a
    column with at most a few hundred distinct values (by the estimate) is counted by value there instead, which gives
    its exact distinct count and its histogram at once.
    """
    spark = df.sparkSession
    labels = list(values)
    cells = df.select(*[value_of(df, v).cast("double").alias(f"v{i}") for i, v in enumerate(values.values())])
    row = cells.agg(
        *[
            a
            for i in range(len(labels))
            for a in (
                F.count(f"v{i}").alias(f"n{i}"), approx_distinct(F.col(f"v{i}")).alias(f"d{i}"),
                F.skewness(f"v{i}").alias(f"s{i}"), F.kurtosis(f"v{i}").alias(f"k{i}"),
            )
        ]
    ).first()
    n = [row[f"n{i}"] for i in range(len(labels))]
    few = {i for i in range(len(labels)) if n[i] and (row[f"d{i}"] or 0) <= 10 * MIN_DISTINCT}
    enough = [i for i in range(len(labels)) if n[i] >= MIN_ROWS]
    ends = quantiles(cells, {f"v{i}": F.col(f"v{i}") for i in enough}, [TAIL, 1 - TAIL], method, {f"v{i}": n[i] for i in enough})
    spans = {i: tuple(ends[f"v{i}"]) for i in enough}
    # one pass: (column, bin) for most columns, (column, value) for the few-valued ones
    keys = []
    for i in range(len(labels)):
        v = F.col(f"v{i}")
        if i in few:
            keys.append(F.when(v.isNotNull(), F.struct(F.lit(i).alias("i"), F.lit(-1).cast("long").alias("bin"), v.alias("x"))))
        elif i in spans and spans[i][1] > spans[i][0]:
            low, high = spans[i]
            inside = v.between(low, high)
            keys.append(F.when(inside, F.struct(F.lit(i).alias("i"), bin_of(v, low, high, BINS).alias("bin"), F.lit(None).cast("double").alias("x"))))
    counted = {}
    if keys:
        exploded = cells.select(F.explode(F.array(*keys)).alias("c")).where(F.col("c").isNotNull()).select("c.*")
        for r in exploded.groupBy("i", "bin", "x").agg(F.count("*").alias("c")).collect():  # <= 64 or a few hundred rows a column
            counted.setdefault(r["i"], []).append((r["bin"], r["x"], r["c"]))
    out = []
    for i, label in enumerate(labels):
        distinct = len(counted.get(i, [])) if i in few else (row[f"d{i}"] or 0)
        skew, kurt = row[f"s{i}"], row[f"k{i}"]
        sarle = None if kurt is None or skew is None or kurt + 3 == 0 else (skew * skew + 1) / (kurt + 3)
        verdict = low_peak = high_peak = None
        if n[i] >= MIN_ROWS and distinct >= MIN_DISTINCT:
            low, high = spans[i]
            if high > low:
                hist = [0] * BINS
                for b, x, c in counted.get(i, []):
                    if i in few:
                        if low <= x <= high:
                            hist[min(int(math.floor((x - low) / (high - low) * BINS)), BINS - 1)] += c
                    else:
                        hist[b] += c
                verdict, peaks = _two_peaks(hist)
                if verdict:
                    width = (high - low) / BINS
                    low_peak, high_peak = (low + (p + 0.5) * width for p in peaks)
        out.append((label, n[i], skew, kurt, sarle, verdict, low_peak, high_peak))
    return spark.createDataFrame(
        out, "label string, n long, skewness double, kurtosis double, sarle double, bimodal boolean, low_peak double, high_peak double"
    )
