"""Segments and entities compared by cost, output, service and outcome."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import clean, col, required, value_of
from ..plans.quantiles import quantiles
from ..plans.ranges import By, running
from ..session import ensure_checkpoint_dir
from .profile import correlated_columns, correlations_of


def _per(df: DataFrame, key: str, **aggs: Column) -> DataFrame:
    required(df, key)
    k = clean(df, key)
    return df.where(k.isNotNull()).groupBy(k.alias("entity")).agg(*[a.alias(n) for n, a in aggs.items()])


def segment_efficiency(df: DataFrame, segment: str, output: str | Column, cost: str | Column) -> DataFrame:
    """Output per unit cost by segment; the most and least efficient and the most variable are marked."""
    out, spent = value_of(df, output), value_of(df, cost)
    # Columns in this order give both uses of the sums the same plan, so the rows are read once.
    per = _per(df, segment, output=F.sum(out), cost=F.sum(spent), variance=F.var_samp(out)).select(
        "entity", "output", "cost", F.try_divide(F.col("output"), F.col("cost")).alias("efficiency"), "variance"
    )
    ends = per.agg(
        F.struct(
            F.max_by("entity", F.struct("efficiency", "entity")).alias("best"),
            F.min_by("entity", F.when(F.col("efficiency").isNotNull(), F.struct("efficiency", "entity"))).alias("worst"),
            F.max_by("entity", F.struct("variance", "entity")).alias("varied"),
        ).alias("ends")
    ).scalar()
    return per.withColumn("ends", ends).select(
        F.col("entity").alias("segment"), "output", "cost", "efficiency", "variance",
        (F.col("entity") == F.col("ends.best")).alias("most_efficient"),
        (F.col("entity") == F.col("ends.worst")).alias("least_efficient"),
        (F.col("entity") == F.col("ends.varied")).alias("most_variable"),
    )


def risk_tiers(df: DataFrame, column: str, method: str = "exact") -> DataFrame:
    """Rows with ``risk_tier`` Low, Medium or High, cut at the terciles; missing stays null."""
    required(df, column)
    v = value_of(df, column)
    low, high = quantiles(df, {"v": v}, [1 / 3, 2 / 3], method)["v"]
    if low is None:
        return df.withColumn("risk_tier", F.lit(None).cast("string"))
    return df.withColumn(
        "risk_tier", F.when(v <= F.lit(low), "Low").when(v <= F.lit(high), "Medium").when(v.isNotNull(), "High")
    )


def outlier_groups(df: DataFrame, group: str, cost: Column, outcome: Column, sds: float = 2.0) -> DataFrame:
    """Groups whose cost is more than ``sds`` deviations above the mean of the groups without a better
    outcome, and costly groups with no outcome at all.  ``cost`` and ``outcome`` are aggregates."""
    per = _per(df, group, cost=cost, outcome=outcome)
    stats = per.agg(
        F.struct(
            F.avg("cost").alias("mean"), F.stddev_samp("cost").alias("sd"), F.avg("outcome").alias("outcome")
        ).alias("s")
    ).scalar()
    dear = F.col("cost") > F.col("s.mean") + sds * F.col("s.sd")
    return per.withColumn("s", stats).select(
        F.col("entity").alias("group"), "cost", "outcome",
        F.try_divide(F.col("cost") - F.col("s.mean"), F.col("s.sd")).alias("z"),
        F.coalesce(dear & (F.col("outcome") <= F.col("s.outcome")), F.lit(False)).alias("outlier"),
        F.coalesce((F.col("cost") > F.col("s.mean")) & (F.col("outcome") == 0), F.lit(False)).alias("zero_outcome"),
    )


def outcome_predictors(df: DataFrame, target: str, columns: list[str] | None = None) -> DataFrame:
    """Columns by strength of their correlation with the target."""
    required(df, target)
    names = [c for c in (columns or correlated_columns(df)) if c != target]
    found = correlations_of(df, [(c, target) for c in names])
    return found.select(F.col("col_x").alias("column"), "r", "n", F.abs("r").alias("strength")).orderBy(
        F.col("strength").desc_nulls_last(), "column"
    )


def on_time_rate(df: DataFrame, keys: list[str], promised: str, actual: str) -> DataFrame:
    """Share of rows on time and mean gap in days by keys, widest gap first."""
    required(df, *keys, promised, actual)
    gap = F.timestamp_diff("SECOND", col(promised), col(actual)) / 86400
    rows = df.where(col(promised).isNotNull() & col(actual).isNotNull())
    return (
        rows.groupBy(*keys)
        .agg(
            F.count("*").alias("n"),
            F.avg((col(actual) <= col(promised)).cast("int")).alias("on_time_rate"),
            F.avg(gap).alias("mean_gap_days"),
        )
        .orderBy(F.col("mean_gap_days").desc(), *keys)
    )


def efficiency_frontier(df: DataFrame, entity: str, cost: Column, service: Column) -> DataFrame:
    """Entities for which no other gives at least the service for at most the cost (and one of both strictly).

    Cheapest first, with the best service seen before: a running maximum over ranges of the entities.
    """
    per = _per(df, entity, cost=cost, service=service).where(F.col("cost").isNotNull() & F.col("service").isNotNull())
    best = F.struct(F.col("service"), (-F.col("cost")).alias("saving"))
    ranked = running(
        per,
        [By("cost"), By("service", True), By("entity")],
        {"best": ("max", best)},
        inclusive=False,
    )
    beaten = (F.col("best.service") > F.col("service")) | (
        (F.col("best.service") == F.col("service")) & (-F.col("best.saving") < F.col("cost"))
    )
    return ranked.select("entity", "cost", "service", (~F.coalesce(beaten, F.lit(False))).alias("on_frontier"))


def quadrants(
    df: DataFrame, entity: str, cost: Column, service: Column, volume: Column, method: str = "exact"
) -> DataFrame:
    """Entities against the medians: expensive and unreliable, or little used with high service."""
    ensure_checkpoint_dir(df.sparkSession)
    # Read several times below, and far smaller than the rows.
    per = _per(df, entity, cost=cost, service=service, volume=volume).checkpoint()
    names = ["cost", "service", "volume"]
    cuts = quantiles(per, {c: F.col(c).cast("double") for c in names}, [0.5], method)
    c, s, v = (F.lit(cuts[n][0]).cast("double") for n in names)
    return per.select(
        "entity", *names,
        F.coalesce((F.col("cost") > c) & (F.col("service") < s), F.lit(False)).alias("poor_value"),
        F.coalesce((F.col("volume") < v) & (F.col("service") > s), F.lit(False)).alias("underused"),
    )
