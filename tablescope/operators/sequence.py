"""Recent form and streaks of entities over an order.

One entity may hold a large part of all rows, so no window ranges over a whole entity.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import clean, col, required, value_of
from ..plans.ranges import PART, range_layout


def recent_form(
    df: DataFrame, entity: str, order: list[str], metric: str | Column, n: int = 5, sds: float = 1.0
) -> DataFrame:
    """Mean of the last n rows beside the overall mean per entity; diverging beyond ``sds`` deviations.

    ``order`` must order an entity's rows completely.
    """
    required(df, entity, *order)
    key = clean(df, entity)
    rows = df.select(key.alias("entity"), *[col(c).alias(f"o{i}") for i, c in enumerate(order)], value_of(df, metric).alias("m"))
    rows = rows.where(F.col("entity").isNotNull() & F.col("m").isNotNull())
    # The rank filter runs inside each task before the shuffle, which then carries n rows per entity and task.
    newest = Window.partitionBy("entity").orderBy(*[F.col(f"o{i}").desc() for i in range(len(order))])
    recent = (
        rows.withColumn("k", F.row_number().over(newest))
        .where(F.col("k") <= n)
        .groupBy("entity")
        .agg(F.avg("m").alias("recent_mean"), F.count("*").alias("recent_n"))
    )
    overall = rows.groupBy("entity").agg(
        F.count("*").alias("n"), F.avg("m").alias("overall_mean"), F.stddev_samp("m").alias("sd")
    )
    return overall.join(recent, "entity").select(
        "entity", "n", "recent_n", "recent_mean", "overall_mean", "sd",
        F.coalesce(F.abs(F.col("recent_mean") - F.col("overall_mean")) > sds * F.col("sd"), F.lit(False)).alias("diverges"),
    )


def _runs(rows: DataFrame, n_order: int) -> DataFrame:
    """Maximal runs of equal ``hot`` per entity from rows (entity, o0.., hot, m).

    Rows are laid out in ranges of (entity, order).  Runs are found inside each range; only the first and last
    run of an entity in a range can go on in the next one, so only those are joined up.
    """
    order = [F.col(f"o{i}") for i in range(n_order)]
    laid = range_layout(rows, F.col("entity"), *order)
    inside = Window.partitionBy("entity", PART).orderBy(*order)
    marked = laid.withColumn("new", F.when(F.lag("hot").over(inside) == F.col("hot"), 0).otherwise(1)).withColumn(
        "island", F.sum("new").over(inside)
    )
    local = marked.groupBy("entity", PART, "island").agg(
        F.bool_or("hot").alias("hot"),
        F.min("o0").alias("first"),
        F.max("o0").alias("last"),
        F.count("*").alias("length"),
        F.sum("m").alias("total"),
    )
    edge = (F.col("island") == 1) | (F.col("island") == F.max("island").over(Window.partitionBy("entity", PART)))
    local = local.withColumn("edge", edge)
    along = Window.partitionBy("entity").orderBy(PART, "island")  # at most two rows per range
    goes_on = (F.lag("hot").over(along) == F.col("hot")) & (F.lag(PART).over(along) != F.col(PART))
    chained = (
        local.where("edge")
        .withColumn("new", F.when(goes_on, 0).otherwise(1))
        .withColumn("chain", F.sum("new").over(along))
        .groupBy("entity", "chain")
        .agg(
            F.bool_or("hot").alias("hot"),
            F.min("first").alias("first"),
            F.max("last").alias("last"),
            F.sum("length").alias("length"),
            F.sum("total").alias("total"),
        )
    )
    names = ["entity", "hot", "first", "last", "length", "total"]
    return local.where("not edge").select(*names).unionAll(chained.select(*names))


def streaks(
    df: DataFrame, entity: str, order: list[str], cond: Column, metric: str | Column | None = None
) -> DataFrame:
    """Every unbroken run of rows meeting ``cond`` per entity: its ends (of the first order column), length and
    metric total.  ``order`` must order an entity's rows completely."""
    required(df, entity, *order)
    m = F.lit(None).cast("double") if metric is None else value_of(df, metric)
    rows = df.select(
        clean(df, entity).alias("entity"),
        *[col(c).alias(f"o{i}") for i, c in enumerate(order)],
        F.coalesce(cond, F.lit(False)).alias("hot"),
        m.alias("m"),
    ).where(F.col("entity").isNotNull())
    return _runs(rows, len(order)).where("hot").select("entity", "first", "last", "length", "total")


def longest_streaks(df: DataFrame, entity: str, order: list[str], cond: Column) -> DataFrame:
    """Per entity with a streak: number of streaks and the longest (the earliest of equal ones)."""
    best = F.min(F.struct((-F.col("length")).alias("l"), "first", "last"))
    return (
        streaks(df, entity, order, cond)
        .groupBy("entity")
        .agg(F.count("*").alias("n_streaks"), best.alias("b"))
        .select("entity", "n_streaks", (-F.col("b.l")).alias("longest"), F.col("b.first").alias("first"), F.col("b.last").alias("last"))
    )


def false_peaks(
    df: DataFrame, entity: str, order: list[str], metric: str, max_share: float = 0.2, min_lift: float = 0.1
) -> DataFrame:
    """Entities whose mean is lifted by one short hot streak (rows above the entity's own mean).

    Flagged when the longest streak is at most ``max_share`` of the rows and the mean falls by more than
    ``min_lift`` of itself without it.
    """
    required(df, entity, metric, *order)
    rows = df.select(clean(df, entity).alias("entity"), *[col(c) for c in order], value_of(df, metric).alias("metric"))
    rows = rows.where(F.col("entity").isNotNull() & F.col("metric").isNotNull())
    per = rows.groupBy("entity").agg(F.count("*").alias("n"), F.avg("metric").alias("mean"), F.sum("metric").alias("sum"))
    with_mean = rows.join(per.select("entity", "mean"), "entity")
    found = streaks(with_mean, "entity", order, F.col("metric") > F.col("mean"), "metric")
    best = found.groupBy("entity").agg(F.min(F.struct((-F.col("length")).alias("l"), "first", "total")).alias("b"))
    rest = F.try_divide(F.col("sum") - F.col("b.total"), F.col("n") + F.col("b.l"))
    return (
        per.join(best, "entity")
        .select("entity", "n", "mean", (-F.col("b.l")).alias("streak"), rest.alias("mean_without"))
        .withColumn(
            "false_peak",
            F.coalesce(
                (F.col("streak") <= max_share * F.col("n"))
                & ((F.col("mean") - F.col("mean_without")) > min_lift * F.abs("mean")),
                F.lit(False),
            ),
        )
    )
