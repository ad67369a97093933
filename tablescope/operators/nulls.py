"""What missing values mean: gaps in mandatory columns, or events that did not happen."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import clean, col, present, required, value_of
from .profile import missing_report

LIMIT_PCT = 5.0
SMALL, SMALL_CLINICAL = 30, 50
# Name parts of columns that every row should fill, and of rare events.
MANDATORY_WORDS = [
    "price", "date", "quantity", "country", "age", "id", "balance", "height", "weight", "carrier", "origin",
    "destination", "diagnosis",
]
SPARSE_WORDS = [
    "medal", "default", "fraud", "bonus", "return", "injury", "promotion", "exception", "coupon", "discount",
    "award", "trophy", "title", "record", "delinquency", "claim", "writeoff", "readmission", "complication",
    "adverse", "icu", "mortality", "damage", "breach", "recall",
]


def null_taxonomy(
    df: DataFrame, mandatory: list[str] | None = None, sparse: list[str] | None = None, by_name: bool = True
) -> DataFrame:
    """Role of each column and what its missing values call for.

    Roles come from the arguments, else (``by_name``) from words in the column name.  A mandatory column with
    more than 5 % missing is a limitation; a sparse event is studied as a cohort and never is one.
    """
    mandatory, sparse = mandatory or [], sparse or []
    required(df, *mandatory, *sparse)
    words = F.split(F.lower("column"), "[^a-z0-9]+")
    role = F.when(F.col("column").isin(mandatory), "mandatory").when(F.col("column").isin(sparse), "sparse")
    if by_name:
        named = lambda ws: F.arrays_overlap(words, F.array(*[F.lit(w) for w in ws]))
        role = role.when(named(SPARSE_WORDS), "sparse").when(named(MANDATORY_WORDS), "mandatory")
    n = df.agg(F.count("*").alias("n")).scalar()
    report = missing_report(df).withColumn("n", n)
    pct = F.col("missing_count") * 100.0 / F.col("n")
    return report.withColumn("role", role.otherwise("unclassified")).select(
        "column", "missing_count", "missing_pct", "role",
        F.when((F.col("role") == "mandatory") & (pct > LIMIT_PCT), "limitation")
        .when((F.col("role") == "sparse") & (F.col("missing_count") > 0), "cohort")
        .otherwise("none")
        .alias("treatment"),
    )


def event_cohort(df: DataFrame, event: str, metrics: list[str]) -> DataFrame:
    """Rate of a sparse event over all rows, and each metric's mean with and without the event."""
    required(df, event, *metrics)
    hit = present(df, event)
    aggs = [F.count("*").alias("n_rows"), F.count_if(hit).alias("n_events")]
    for i, m in enumerate(metrics):
        v = value_of(df, m)
        aggs += [F.avg(F.when(hit, v)).alias(f"c{i}"), F.avg(F.when(~hit, v)).alias(f"r{i}")]
    cells = [
        F.struct(F.lit(m).alias("metric"), F.col(f"c{i}").alias("cohort_mean"), F.col(f"r{i}").alias("rest_mean"))
        for i, m in enumerate(metrics)
    ]
    return df.agg(*aggs).select(
        "n_rows", "n_events", F.try_divide("n_events", "n_rows").alias("event_rate"), F.inline(F.array(*cells))
    )


def segment_sample_flags(df: DataFrame, segment: str, clinical: bool = False) -> DataFrame:
    """Rows per segment; few rows make a limited sample, and in clinical data low confidence below 50."""
    required(df, segment)
    return (
        df.where(clean(df, segment).isNotNull())
        .groupBy(col(segment).alias("segment"))
        .agg(F.count("*").alias("n"))
        .select(
            "segment", "n",
            (F.col("n") < SMALL).alias("limited_sample"),
            (F.lit(clinical) & (F.col("n") < SMALL_CLINICAL)).alias("low_confidence"),
        )
    )
