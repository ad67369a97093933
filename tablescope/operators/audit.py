"""Grading of evidence and insights, and checking of claims against the profile."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..plans.quantiles import quantiles
from .nulls import LIMIT_PCT, MANDATORY_WORDS

NOISE = 0.10
# Fixed values: (strength, least |r|, least n), strongest first.
LADDER = [(1.0, 0.50, 200), (0.7, 0.35, 100), (0.4, 0.25, 50)]
WEAK, WEAK_N = 0.2, 30
CAUSAL, CAUSAL_CLINICAL, WARN_BELOW = 0.6, 0.7, 0.40
WEIGHTS = {"statistical_strength": 0.4, "novelty_score": 0.3, "decision_leverage": 0.3}
HIGH_VALUE, LOW_VALUE = 0.60, 0.30
FINDING_TYPES = [
    "id_column_misuse", "correlation_causation_error", "unsupported_claim", "missing_data_inflation",
    "outlier_misinterpretation", "redundancy", "weak_signal_overstatement", "missing_limitations",
]
# Fixed value: text for a report without rewrites.
NO_REWRITES = "Revise the report to address the Critic's findings."


def evidence_grade(correlations: DataFrame) -> DataFrame:
    """Strength of each correlation from |r| and n; below 0.10 it is noise."""
    size = F.abs("r")
    noise = F.coalesce(size < NOISE, F.lit(True))
    strength = F.when(noise, 0.0).when(F.col("n") < WEAK_N, WEAK)
    for value, least_r, least_n in LADDER:
        strength = strength.when((size > least_r) & (F.col("n") > least_n), value)
    return correlations.withColumn("strength", strength.otherwise(WEAK)).withColumn(
        "label", F.when(noise, "inconclusive (noise-level signal)").otherwise("signal")
    )


def wording_rule(correlations: DataFrame, clinical: bool = False) -> DataFrame:
    """Whether causal wording is allowed, and whether it would be worth a warning."""
    size = F.coalesce(F.abs("r"), F.lit(0.0))
    return correlations.withColumn("causal_allowed", size > (CAUSAL_CLINICAL if clinical else CAUSAL)).withColumn(
        "causal_warns", size < WARN_BELOW
    )


def insight_value(insights: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(scored, rejected): value score and tier; rows with a score outside [0, 1] are rejected."""
    valid = F.lit(True)
    for name in WEIGHTS:
        valid = valid & F.coalesce(F.col(name).between(0.0, 1.0), F.lit(False))
    score = sum((F.col(n) * F.lit(w) for n, w in WEIGHTS.items()), F.lit(0.0))
    # 0.60 and 0.30 themselves are moderate, so binary dust is rounded away before the test.
    scored = insights.where(valid).withColumn("value_score", F.round(score, 10)).withColumn(
        "value_tier",
        F.when(F.col("value_score") > HIGH_VALUE, "high_value")
        .when(F.col("value_score") < LOW_VALUE, "low_value")
        .otherwise("moderate_value"),
    )
    return scored, insights.where(~valid)


def overall_value(scored: DataFrame, report: str = "report", insight: str = "insight_id") -> DataFrame:
    """Mean value score and the low-value insights per report."""
    low = F.when(F.col("value_tier") == "low_value", F.col(insight))
    return scored.groupBy(report).agg(
        F.avg("value_score").alias("overall_value_score"),
        F.count("*").alias("n_insights"),
        F.array_sort(F.collect_list(low)).alias("low_value_insights"),
    )


def low_value_rows(scored: DataFrame, report: str = "report", insight: str = "insight_id") -> DataFrame:
    """The low-value insights as rows (report, insight_id, value_score): no list per report, whatever its size.
    ``overall_value`` gathers the same insights into a list for display."""
    return scored.where(F.col("value_tier") == "low_value").select(report, F.col(insight).alias("insight_id"), "value_score")


def clamp_scores(reports: DataFrame, findings: DataFrame, report: str = "report") -> DataFrame:
    """Make the score fit the verdict, in three ordered steps."""
    per = findings.groupBy(report).agg(
        F.bool_or(F.col("severity") == "block").alias("has_block"), F.count("*").alias("n_findings")
    )
    joined = reports.join(per, report, "left").withColumn("has_block", F.coalesce("has_block", F.lit(False))).withColumn(
        "n_findings", F.coalesce("n_findings", F.lit(0).cast("long"))
    )
    score = F.col("score")
    step1 = F.when(F.col("has_block") & (score > 0.3), 0.0).otherwise(score)
    step2 = F.when(~F.col("approved") & (step1 > 0.5), 0.4).otherwise(step1)
    step3 = F.when(F.col("approved") & (F.col("n_findings") > 0) & (step2 > 0.85), 0.85).otherwise(step2)
    return joined.withColumn("clamped_score", step3)


def profile_facts(profile) -> DataFrame:
    """A profile of tables in long form: (table, column, column2, metric, value)."""
    none = F.lit(None).cast("string")

    def unpivot(df: DataFrame, names: list[str]) -> DataFrame:
        cells = [F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value")) for n in names]
        return df.select("table", "column", none.alias("column2"), F.inline(F.array(*cells)))

    return (
        unpivot(profile.outliers, ["q1", "q3", "outlier_count", "outlier_pct"])
        .unionByName(unpivot(profile.missing, ["missing_count", "missing_pct"]))
        .unionByName(
            profile.correlations.select(
                "table", F.col("col_x").alias("column"), F.col("col_y").alias("column2"),
                F.lit("correlation").alias("metric"), F.col("r").alias("value"),
            )
        )
    )


def _ordered_pair(df: DataFrame) -> DataFrame:
    """Correlations are symmetric: put the smaller column name first."""
    swap = F.col("column2").isNotNull() & (F.col("column2") < F.col("column"))
    return df.withColumn("_a", F.when(swap, F.col("column2")).otherwise(F.col("column"))).withColumn(
        "_b", F.when(swap, F.col("column")).otherwise(F.col("column2"))
    )


def verify_claims(claims: DataFrame, facts: DataFrame, columns: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """Findings of claims that contradict the facts.

    ``claims`` (report, claim, table, column, column2, metric, value); ``columns`` is the columns table.  A claim
    about an id column, a reversed correlation sign, or a value off by more than the relative tolerance blocks.
    A claim without a fact to compare is a warning.  Profile facts and columns are of schema size.
    """
    ids = columns.where(F.col("category") == "id_like").select("table", F.col("column").alias("id_column")).distinct()
    f = _ordered_pair(facts.withColumnRenamed("value", "fact")).select("table", "_a", "_b", "metric", "fact")
    c = _ordered_pair(claims)
    matched = (
        c.join(
            f,
            (c["table"] == f["table"]) & (c["metric"] == f["metric"]) & (c["_a"] == f["_a"]) & c["_b"].eqNullSafe(f["_b"]),
            "left",
        )
        .select(*[c[x] for x in claims.columns], c["_a"], c["_b"], f["fact"])
    )
    for side in ("_a", "_b"):
        i = ids.select(F.col("table").alias("_t"), F.col("id_column").alias("_c"), F.lit(True).alias("id" + side))
        matched = matched.join(i, (F.col("table") == F.col("_t")) & (F.col(side) == F.col("_c")), "left").drop("_t", "_c")
    on_id = F.coalesce("id_a", F.lit(False)) | F.coalesce("id_b", F.lit(False))
    reversed_sign = (F.col("metric") == "correlation") & (F.signum("value") * F.signum("fact") < 0)
    off = F.abs(F.col("value") - F.col("fact")) > tolerance * F.greatest(F.abs("fact"), F.lit(1e-12))
    issue = (
        F.when(on_id, "id_misuse")
        .when(F.coalesce(reversed_sign, F.lit(False)), "direction_error")
        .when(F.coalesce(off, F.lit(False)), "hallucination")
        .when(F.col("fact").isNull(), "no_fact")
    )
    return (
        matched.withColumn("issue_type", issue)
        .where(F.col("issue_type").isNotNull())
        .withColumn(
            "finding_type",
            F.when(F.col("issue_type") == "id_misuse", "id_column_misuse")
            .when(F.col("issue_type") == "direction_error", "correlation_causation_error")
            .otherwise("unsupported_claim"),
        )
        .withColumn("severity", F.when(F.col("issue_type") == "no_fact", "warn").otherwise("block"))
        .select(*claims.columns, "fact", "issue_type", "finding_type", "severity")
    )


SMALL_SAMPLE = 30
#: What to do about each blocking issue.
FIXES = {
    "id_misuse": "leave out the key column",
    "direction_error": "state the direction that the data shows",
    "hallucination": "use the measured value",
}


def warn_findings(claims: DataFrame, facts: DataFrame) -> DataFrame:
    """Findings that warn and never block.

    ``claims`` has report, claim, table, column, column2, causal (whether its wording is causal) and n (the rows it rests
    on).  Causal wording on a correlation below 0.40, fewer than 30 rows, and a mandatory column (by its name) with gaps
    are one finding each; a claim can have several.  Facts are of schema size.
    """
    pairs = _ordered_pair(facts.where("metric = 'correlation'")).select("table", "_a", "_b", F.abs("value").alias("size"))
    gaps = facts.where("metric = 'missing_count' AND value > 0").select("table", F.col("column").alias("_c"), F.col("value").alias("gap"))
    c = _ordered_pair(claims)
    # k x k correlations for k columns: Spark broadcasts them only below its size limit (AQE measures them at run time)
    met = c.join(pairs, ["table", "_a", "_b"], "left").join(
        gaps, (c["table"] == gaps["table"]) & (c["column"] == gaps["_c"]), "left"
    ).select(*[c[x] for x in claims.columns], "size", "gap")
    words = F.split(F.lower("column"), "[^a-z0-9]+")
    mandatory = F.arrays_overlap(words, F.array(*[F.lit(w) for w in MANDATORY_WORDS]))
    issues = F.array(
        F.when(F.col("causal") & (F.col("size") < WARN_BELOW), F.struct(F.lit("causal_wording").alias("issue_type"), F.lit("correlation_causation_error").alias("finding_type"))),
        F.when(F.col("n") < SMALL_SAMPLE, F.struct(F.lit("small_sample").alias("issue_type"), F.lit("weak_signal_overstatement").alias("finding_type"))),
        F.when(mandatory & F.col("gap").isNotNull(), F.struct(F.lit("mandatory_gap").alias("issue_type"), F.lit("missing_data_inflation").alias("finding_type"))),
    )
    found = met.select(*claims.columns, F.explode(F.filter(issues, lambda x: x.isNotNull())).alias("f"))
    return found.select(*claims.columns, "f.issue_type", "f.finding_type", F.lit("warn").alias("severity"))


#: A claimed mean that values beyond the fences move by more than this share rests on outliers.
OUTLIER_SHIFT = 0.10
FENCE = 1.5


def fenced_means(df: DataFrame, columns: list[str], table: str) -> DataFrame:
    """Facts (table, column, column2, metric, value): each column's mean, its mean within the IQR fences
    (exact quartiles), and its share of missing cells; two passes for the quartiles and one aggregate for the rest."""
    cells = {c: F.col(c).cast("double") for c in columns}
    qs = quantiles(df, cells, [0.25, 0.75])
    aggs, facts = [], []
    for i, c in enumerate(columns):
        q1, q3 = qs[c]
        v = cells[c]
        inside = v if q1 is None else F.when(v.between(q1 - FENCE * (q3 - q1), q3 + FENCE * (q3 - q1)), v)
        aggs += [F.avg(v).alias(f"m{i}"), F.avg(inside).alias(f"f{i}"), (F.count_if(v.isNull()) / F.count("*")).alias(f"s{i}")]
    row = df.agg(*aggs).first()  # one row
    for i, c in enumerate(columns):
        facts += [(table, c, None, "mean", row[f"m{i}"]), (table, c, None, "mean_within_fences", row[f"f{i}"]), (table, c, None, "missing_share", row[f"s{i}"])]
    return df.sparkSession.createDataFrame(facts, "table string, column string, column2 string, metric string, value double")


def more_findings(claims: DataFrame, facts: DataFrame) -> DataFrame:
    """Warnings of the three remaining finding types, one row per (claim, issue).

    ``claims`` has report, claim, table, column, column2, metric and limited (whether the claim states a limitation;
    null: no).  ``redundancy``: a claim that says what an earlier claim of its report (smaller ``claim``) said, the same
    metric of the same columns (in either order).  ``outlier_misinterpretation``: a claimed mean of a column whose mean
    moves by more than OUTLIER_SHIFT of itself when values beyond the IQR fences are left out (facts ``mean`` and
    ``mean_within_fences``).  ``missing_limitations``: a claim on a column with more than LIMIT_PCT % missing cells
    (fact ``missing_share``) that states no limitation.  Facts are of schema size.
    """
    c = _ordered_pair(claims)
    same = Window.partitionBy("report", "table", "_a", "_b", "metric").orderBy("claim")
    c = c.withColumn("_nth", F.row_number().over(same))
    f = facts.groupBy("table", F.col("column").alias("_c")).agg(
        *[F.max(F.when(F.col("metric") == m, F.col("value"))).alias(m) for m in ("mean", "mean_within_fences", "missing_share")]
    )
    met = c.join(f, (c["table"] == f["table"]) & (c["column"] == f["_c"]), "left").select(
        *[c[x] for x in claims.columns], "_nth", "mean", "mean_within_fences", "missing_share"
    )
    shift = F.abs(F.col("mean") - F.col("mean_within_fences")) > OUTLIER_SHIFT * F.greatest(F.abs("mean_within_fences"), F.lit(1e-12))
    issues = F.array(
        F.when(F.col("_nth") > 1, F.struct(F.lit("repeated_claim").alias("issue_type"), F.lit("redundancy").alias("finding_type"))),
        F.when((F.col("metric") == "mean") & F.coalesce(shift, F.lit(False)),
               F.struct(F.lit("outlier_driven").alias("issue_type"), F.lit("outlier_misinterpretation").alias("finding_type"))),
        F.when((F.col("missing_share") * 100 > LIMIT_PCT) & ~F.coalesce(F.col("limited"), F.lit(False)),
               F.struct(F.lit("unstated_gap").alias("issue_type"), F.lit("missing_limitations").alias("finding_type"))),
    )
    found = met.select(*claims.columns, F.explode(F.filter(issues, lambda x: x.isNotNull())).alias("f"))
    return found.select(*claims.columns, "f.issue_type", "f.finding_type", F.lit("warn").alias("severity"))


def rewrites_from_findings(findings: DataFrame, report: str = "report", insight: str = "claim") -> DataFrame:
    """One rewrite per blocking finding, as rows (report, seq, insight_id, issue_type, fix_instruction)."""
    fix = F.coalesce(*[F.when(F.col("issue_type") == k, F.lit(v)) for k, v in FIXES.items()], F.lit("correct or drop the claim"))
    order = Window.partitionBy(report).orderBy(insight, "issue_type")
    return findings.where(F.col("severity") == "block").select(
        report, F.row_number().over(order).alias("seq"), F.col(insight).alias("insight_id"), "issue_type", fix.alias("fix_instruction")
    )


def verdicts(reports: DataFrame, findings: DataFrame, report: str = "report") -> DataFrame:
    """A report is approved unless one of its findings blocks."""
    per = findings.groupBy(report).agg(F.count_if(F.col("severity") == "block").alias("n_blocks"))
    return reports.join(per, report, "left").withColumn("n_blocks", F.coalesce("n_blocks", F.lit(0).cast("long"))).withColumn(
        "approved", F.col("n_blocks") == 0
    )


def rewrite_rows(reports: DataFrame, rewrites: DataFrame, report: str = "report", order: str = "seq") -> DataFrame:
    """(report, seq, line): the rewrites of each report, one row each; a report without any has its instructions, or
    else a fixed text, as its only line.  Nothing is gathered per report."""
    line = F.format_string("- [%s] (%s): %s", "insight_id", "issue_type", "fix_instruction")
    own = rewrites.select(report, F.col(order).alias("seq"), line.alias("line"))
    given: Column = F.col("revision_instructions") if "revision_instructions" in reports.columns else F.lit(None).cast("string")
    rest = F.coalesce(F.when(F.length(given) > 0, given), F.lit(NO_REWRITES))
    return reports.select(report, rest.alias("_rest")).join(own, report, "left").select(report, "seq", F.coalesce("line", "_rest").alias("line"))


def rewrite_list(reports: DataFrame, rewrites: DataFrame, report: str = "report", order: str = "seq") -> DataFrame:
    """The rewrites of each report as text, one line each; else its instructions, else a fixed text."""
    line = F.format_string("- [%s] (%s): %s", "insight_id", "issue_type", "fix_instruction")
    texts = rewrites.groupBy(report).agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("t")))), lambda s: s["t"]), "\n"
        ).alias("text")
    )
    given: Column = F.col("revision_instructions") if "revision_instructions" in reports.columns else F.lit(None).cast("string")
    return reports.join(texts, report, "left").select(
        report, F.coalesce("text", F.when(F.length(given) > 0, given), F.lit(NO_REWRITES)).alias("rewrites")
    )
