"""Findings that contradict what was expected."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import clean, col, required, value_of
from .profile import correlations_of, pearson

NOISE = 0.10


def direction_paradox(df: DataFrame, rules: list[tuple[str, str, int]], noise: float = NOISE) -> DataFrame:
    """Rules (x, y, expected sign) against the correlation in the data.

    A paradox is a correlation outside the noise band with the opposite sign.
    """
    expected = df.sparkSession.createDataFrame(rules, "col_x string, col_y string, expected_sign int")
    found = correlations_of(df, list(dict.fromkeys((x, y) for x, y, _ in rules)))
    return expected.join(found, ["col_x", "col_y"]).select(
        "col_x", "col_y", "expected_sign", "r", "n",
        F.coalesce((F.abs("r") >= noise) & (F.signum("r") != F.signum("expected_sign")), F.lit(False)).alias("paradox"),
    )


def segment_reversal(df: DataFrame, x: str | Column, y: str | Column, segment: str, noise: float = NOISE) -> DataFrame:
    """Correlation within each segment beside the overall one; reversed if the signs differ outside the noise."""
    required(df, segment)
    rows = df.select(col(segment).alias("segment"), value_of(df, x).alias("x"), value_of(df, y).alias("y"))
    both = F.col("x").isNotNull() & F.col("y").isNotNull()
    r = pearson(F.col("x"), F.col("y"))
    overall = rows.agg(r.alias("r")).scalar()
    parts = rows.where(F.col("segment").isNotNull()).groupBy("segment").agg(F.count_if(both).alias("n"), r.alias("r"))
    return parts.withColumn("overall_r", overall).withColumn(
        "reversed",
        F.coalesce(
            (F.abs("r") >= noise) & (F.abs("overall_r") >= noise) & (F.signum("r") != F.signum("overall_r")), F.lit(False)
        ),
    )


def rank_inversion(df: DataFrame, entity: str, volume: Column, quality: Column) -> DataFrame:
    """The entity with most volume and its place in quality.

    ``volume`` and ``quality`` are aggregate expressions, for example ``F.sum("qty")`` and ``F.avg("score")``; more is
    better in both.
    """
    required(df, entity)
    key = clean(df, entity)
    per = df.where(key.isNotNull()).groupBy(key.alias("entity")).agg(volume.alias("volume"), quality.alias("quality"))
    per = per.where(F.col("volume").isNotNull() & F.col("quality").isNotNull())
    # Most volume first, ties to the first entity.  Others are compared with the leader by name, so that its
    # own value, summed in another order, cannot count against it.
    leader = per.agg(F.min(F.struct((-F.col("volume")).alias("v"), "entity", "volume", "quality")).alias("lead")).scalar()
    other = F.col("entity") != F.col("lead.entity")
    places = per.withColumn("lead", leader).agg(
        F.any_value("lead").alias("lead"),
        F.count("*").alias("n_entities"),
        (F.count_if(other & (F.col("quality") > F.col("lead.quality"))) + 1).alias("quality_rank"),
        F.count_if(other & (F.col("quality") <= F.col("lead.quality"))).alias("not_better"),
    )
    return places.where("n_entities > 0").select(
        F.col("lead.entity").alias("leader"), "lead.volume", "lead.quality", "n_entities", "quality_rank",
        (F.col("quality_rank") > 1).alias("inverted"),
        ((F.col("not_better") == 0) & (F.col("quality_rank") > 1)).alias("worst"),
    )
