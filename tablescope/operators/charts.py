"""Points of a small category chart."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import clean, col, required, value_of

#: Fixed value: points of a chart that is not told otherwise.
DEFAULT_POINTS = 7
_AGG = {"sum": F.sum, "avg": F.avg, "count": F.count, "min": F.min, "max": F.max}


def chart_points(
    df: DataFrame, label: str, value: str, agg: str = "sum", n: int = DEFAULT_POINTS, by: str = "value", chart: str = "chart"
) -> DataFrame:
    """At most n (label, value) points, largest first or in label order (``by="label"``).

    Points without a value are dropped after the cut, so they can leave fewer.
    """
    required(df, label)
    points = df.where(clean(df, label).isNotNull()).groupBy(col(label).cast("string").alias("label")).agg(
        _AGG[agg](value_of(df, value)).cast("double").alias("value")
    )
    order = [F.col("value").desc_nulls_last(), F.col("label")] if by == "value" else [F.col("label")]
    cut = points.orderBy(*order).limit(n).withColumn("ord", F.row_number().over(Window.orderBy(*order)))
    return cut.where(F.col("value").isNotNull()).select(F.lit(chart).alias("chart"), "ord", "label", "value")
