"""How much of a total a few entities hold."""

from __future__ import annotations

import math
from decimal import Decimal

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import clean, required, value_of
from ..plans.ranges import Layout, over_layout


def entity_totals(df: DataFrame, entity: str, value: str | Column) -> DataFrame:
    """(entity, value) sums; rows without entity are left out.  Sums combine before the shuffle."""
    required(df, entity)
    key = clean(df, entity)
    return df.where(key.isNotNull()).groupBy(key.alias("entity")).agg(F.coalesce(F.sum(value_of(df, value)), F.lit(0)).alias("value"))


def _part(total, share: float):
    return total * Decimal(str(share)) if isinstance(total, Decimal) else total * share


def pareto(df: DataFrame, entity: str, value: str | Column, goal: float = 0.8, top: float = 0.2) -> DataFrame:
    """The fewest entities that hold ``goal`` of the total, and the share of the top ``top`` of them."""
    ranked = Layout.of(entity_totals(df, entity, value))
    n, total = ranked.n, ranked.total
    k = k_top = held = None
    if n and total > 0:
        k = ranked.smallest_reaching(_part(total, goal))
        k_top = math.ceil(Decimal(str(top)) * n)
        held = float(ranked.top_sum(k_top)) / float(total)
    row = (
        n, None if total is None else float(total), goal, k, None if k is None else k / n, top, k_top, held,
        None if held is None else held >= goal,
    )
    return df.sparkSession.createDataFrame(
        [row],
        "n_entities long, total double, goal double, k long, k_share double, top double, k_top long, "
        "top_share double, concentrated boolean",
    )


def pareto_tiers(
    df: DataFrame, entity: str, value: str | Column, high: float = 0.8, mid: float = 0.95
) -> DataFrame:
    """Each entity's tier: High until ``high`` of the total is reached, then Mid until ``mid``, then Tail."""
    ranked = Layout.of(entity_totals(df, entity, value))
    total = F.lit(ranked.total)
    upto = over_layout(ranked.ranked, list(Layout.ORDER), {"upto": ("sum", F.col("value"))})
    # The entity that crosses a limit still belongs to the upper tier.
    before = upto.withColumn("before", F.col("upto") - F.col("value")).withColumn("total", total)
    return before.select(
        "entity",
        "value",
        F.try_divide(F.col("upto").cast("double"), F.col("total").cast("double")).alias("cum_share"),
        F.when(F.col("before") < F.col("total") * _limit(high), "High")
        .when(F.col("before") < F.col("total") * _limit(mid), "Mid")
        .otherwise("Tail")
        .alias("tier"),
    )


def _limit(share: float) -> Column:
    return F.lit(Decimal(str(share)))


def top_n_share(
    df: DataFrame, entity: str, value: str | Column, limits: dict[int, float] | None = None
) -> DataFrame:
    """Share of the n largest entities, flagged above a limit, for each n.

    Default limits: one entity 20 %, three 40 %, five 50 %.
    """
    limits = limits or {1: 0.2, 3: 0.4, 5: 0.5}
    totals = entity_totals(df, entity, value)
    most = max(limits)
    largest = totals.orderBy(F.col("value").desc(), "entity").limit(most)
    ordered = F.reverse(F.array_sort(F.collect_list(F.col("value").cast("double"))))
    total = totals.agg(F.sum("value").cast("double").alias("t")).scalar()
    cells = F.array(*[F.struct(F.lit(n).alias("n"), F.lit(x).alias("limit")) for n, x in sorted(limits.items())])
    return (
        largest.agg(ordered.alias("v"))  # at most max(n) values
        .withColumn("total", total)
        .select("v", "total", F.inline(cells))
        .withColumn("top_sum", F.aggregate(F.slice("v", F.lit(1), F.col("n")), F.lit(0.0), lambda a, x: a + x))
        .withColumn("share", F.try_divide("top_sum", "total"))
        .select("n", "top_sum", "total", "share", "limit", (F.col("share") > F.col("limit")).alias("flagged"))
    )


def top_fraction_share(
    df: DataFrame, entity: str, value: str | Column, fraction: float = 0.1, limit: float = 0.6
) -> DataFrame:
    """Share held by the top ``fraction`` of entities, flagged above ``limit``."""
    ranked = Layout.of(entity_totals(df, entity, value))
    n, total = ranked.n, ranked.total
    k = math.ceil(Decimal(str(fraction)) * n)
    share = float(ranked.top_sum(k)) / float(total) if n and total > 0 else None
    return df.sparkSession.createDataFrame(
        [(n, fraction, k, share, limit, None if share is None else share > limit)],
        "n_entities long, fraction double, k long, share double, limit double, flagged boolean",
    )


def top_rows_share(df: DataFrame, value: str | Column, n: int = 20) -> DataFrame:
    """Share of the n largest single values in the total."""
    v = value_of(df, value)
    values = df.select(v.alias("value")).where(F.col("value").isNotNull())
    total = values.agg(F.sum("value").cast("double").alias("t")).scalar()
    top = values.orderBy(F.col("value").desc()).limit(n).agg(F.count("*").alias("n"), F.sum("value").cast("double").alias("top_sum"))
    return top.withColumn("total", total).select("n", "top_sum", "total", F.try_divide("top_sum", "total").alias("share"))


def group_sum(df: DataFrame, by: str, value: str | Column) -> DataFrame:
    required(df, by)
    return df.where(clean(df, by).isNotNull()).groupBy(by).agg(F.sum(value_of(df, value)).alias("total"))
