"""Variation, response to a rate, category over-indexing and seasonal spikes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import clean, col, required, value_of
from ..plans.quantiles import quantiles
from .profile import pearson


def volatility(df: DataFrame, columns: list[str], by: str | None = None) -> DataFrame:
    """Coefficient of variation std/mean per column, also per group."""
    required(df, *columns, *([by] if by else []))
    aggs = []
    for i, c in enumerate(columns):
        v = value_of(df, c)
        aggs += [F.avg(v).alias(f"a{i}"), F.stddev_samp(v).alias(f"s{i}")]
    cells = [
        F.struct(
            F.lit(c).alias("column"), F.col(f"a{i}").alias("mean"), F.col(f"s{i}").alias("std"),
            F.try_divide(F.col(f"s{i}"), F.col(f"a{i}")).alias("cv"),
        )
        for i, c in enumerate(columns)
    ]
    keys = [by] if by else []
    rows = df.where(clean(df, by).isNotNull()) if by else df
    return rows.groupBy(*keys).agg(*aggs).select(*keys, F.inline(F.array(*cells)))


def rate_tiers(
    df: DataFrame, rate: str | Column, volume: str | Column, net: str | Column, tiers: int | None = None
) -> DataFrame:
    """Rows, volume, net and net per row at each rate.

    A rate with many values is cut into ``tiers`` of about as many rows each, at its exact quantiles; a tier is named by
    its mean rate, and rate_low and rate_high are its ends.
    """
    rows = df.select(value_of(df, rate).alias("rate"), value_of(df, volume).alias("v"), value_of(df, net).alias("w")).where(
        F.col("rate").isNotNull()
    )
    sums = [
        F.count("*").alias("n"), F.sum("v").alias("volume"), F.sum("w").alias("net"),
        F.try_divide(F.sum("w"), F.count("*")).alias("net_per_row"),
    ]
    if tiers is None:
        return rows.groupBy("rate").agg(*sums)
    if tiers < 1:
        raise ValueError("tiers must be 1 or more")
    cuts = quantiles(rows, {"rate": F.col("rate").cast("double")}, [i / tiers for i in range(1, tiers)])["rate"] if tiers > 1 else []
    tier = F.lit(0)
    for cut in cuts:
        if cut is not None:
            tier = tier + F.when(F.col("rate") > F.lit(cut), 1).otherwise(0)
    ends = [F.avg("rate").alias("rate"), F.min("rate").alias("rate_low"), F.max("rate").alias("rate_high")]
    return rows.groupBy(tier.alias("tier")).agg(*ends, *sums)


def rate_response(
    df: DataFrame, rate: str | Column, volume: str | Column, net: str | Column, tiers: int | None = None, least_rows: int = 1
) -> DataFrame:
    """Correlation of a rate with volume and net, and the rate (or tier of rates) with most net per row.

    A tier needs ``least_rows`` rows to be the best.  ``inverted``: volume rises with the rate while net falls.
    """
    rows = df.select(value_of(df, rate).alias("r"), value_of(df, volume).alias("v"), value_of(df, net).alias("w"))
    corr = rows.agg(
        pearson(F.col("r"), F.col("v")).alias("r_volume"), pearson(F.col("r"), F.col("w")).alias("r_net")
    )
    best = (
        rate_tiers(df, rate, volume, net, tiers)
        .where(F.col("n") >= least_rows)
        .orderBy(F.col("net_per_row").desc(), "rate")
        .limit(1)
        .select(F.col("rate").alias("sweet_spot"), F.col("net_per_row").alias("best_net_per_row"))
    )
    one = corr.withColumn("_", F.lit(1)).join(best.withColumn("_", F.lit(1)), "_", "left").drop("_")
    return one.withColumn("inverted", F.coalesce((F.col("r_volume") > 0) & (F.col("r_net") < 0), F.lit(False)))


def category_overindex(df: DataFrame, segment: str, category: str, value: str | Column) -> DataFrame:
    """A category's share within a segment divided by its share overall; its overall share above one half
    is a dependency risk."""
    required(df, segment, category)
    cells = (
        df.where(clean(df, segment).isNotNull() & clean(df, category).isNotNull())
        .groupBy(col(segment).alias("segment"), col(category).alias("category"))
        .agg(F.sum(value_of(df, value)).cast("double").alias("value"))
    )
    # Further sums run on the sums, not on the rows.
    by_segment = cells.groupBy("segment").agg(F.sum("value").alias("segment_total"))
    by_category = cells.groupBy("category").agg(F.sum("value").alias("category_total"))
    total = cells.agg(F.sum("value").alias("t")).scalar()
    return (
        cells.join(by_segment, "segment")
        .join(by_category, "category")
        .withColumn("total", total)
        .withColumn("share", F.try_divide("value", "segment_total"))
        .withColumn("overall_share", F.try_divide("category_total", "total"))
        .select(
            "segment", "category", "value", "share", "overall_share",
            F.try_divide("share", "overall_share").alias("index"),
            F.coalesce(F.col("overall_share") > 0.5, F.lit(False)).alias("dependency_risk"),
        )
    )


def seasonal_spikes(df: DataFrame, ts: str, value: str | Column, sds: float = 2.0) -> DataFrame:
    """Totals by month; a spike is a month above mean + 2 sd of the months."""
    required(df, ts)
    months = (
        df.where(col(ts).isNotNull())
        .groupBy(F.trunc(col(ts).cast("date"), "month").alias("month"))
        .agg(F.sum(value_of(df, value)).cast("double").alias("total"))
    )
    stats = months.agg((F.avg("total") + sds * F.stddev_samp("total")).alias("limit")).scalar()
    return months.withColumn("limit", stats).withColumn("spike", F.coalesce(F.col("total") > F.col("limit"), F.lit(False)))
