from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import functions as F

from tablescope.operators import audit, history as h, profile as p
from tablescope.operators.discover import columns_table
from tablescope.session import ensure_checkpoint_dir

from .discovery import CLASSIFIED
from .profiling import DOC_NUMBERS, FACTS, LABELLED, LINE_ALL, _corr, profiled
from .registry import pick, query, rnd
from .views import labelled, read, sql, tables


def _union(parts) -> str:
    return "\nUNION ALL ".join(parts)


# ---------------------------------------------------------------- evidence

CORR = _union(
    [_corr(sql("lineitem"), LINE_ALL, "'lineitem' AS \"table\", "), _corr(LABELLED, DOC_NUMBERS, "'docs' AS \"table\", ")]
)


def _corr_rows(spark, sf):
    line = p.correlations(read(spark, sf, "lineitem")).withColumn("table", F.lit("lineitem"))
    return line.unionByName(p.correlations(labelled(spark, sf)).withColumn("table", F.lit("docs")))


@query(
    "evidence_grade",
    f"""SELECT "table", col_x, col_y, n, r, CASE WHEN r IS NULL OR abs(r) < 0.1 THEN 0.0 WHEN n < 30 THEN 0.2 WHEN abs(r) > 0.5 AND n > 200 THEN 1.0
    WHEN abs(r) > 0.35 AND n > 100 THEN 0.7 WHEN abs(r) > 0.25 AND n > 50 THEN 0.4 ELSE 0.2 END::DOUBLE AS strength,
    CASE WHEN r IS NULL OR abs(r) < 0.1 THEN 'inconclusive (noise-level signal)' ELSE 'signal' END AS label FROM ({CORR})""",
)
def evidence_grade(spark, sf):
    return pick(audit.evidence_grade(_corr_rows(spark, sf)), "table", "col_x", "col_y", "n", "strength", "label", r=6)


@query(
    "wording_rule",
    f"""SELECT "table", col_x, col_y, coalesce(abs(r), 0) > 0.6 AS causal_allowed, coalesce(abs(r), 0) > 0.7 AS clinical_allowed,
    coalesce(abs(r), 0) < 0.4 AS causal_warns FROM ({CORR})""",
)
def wording_rule(spark, sf):
    rows = audit.wording_rule(_corr_rows(spark, sf), clinical=True).withColumnRenamed("causal_allowed", "clinical_allowed")
    return audit.wording_rule(rows).select("table", "col_x", "col_y", "causal_allowed", "clinical_allowed", "causal_warns")


# One insight per customer, one report per nation; a negative balance gives a score out of range.
INSIGHTS = """(SELECT c_nationkey AS report, 'i' || c_custkey AS insight_id, c_acctbal / 10000 AS statistical_strength,
 (c_custkey % 11) / 10.0::DOUBLE AS novelty_score, (c_custkey % 5) / 4.0::DOUBLE AS decision_leverage FROM customer)"""
SCORED = f"""(SELECT *, CASE WHEN value_score > 0.6 THEN 'high_value' WHEN value_score < 0.3 THEN 'low_value' ELSE 'moderate_value' END AS value_tier
 FROM (SELECT *, round(0.4 * statistical_strength + 0.3 * novelty_score + 0.3 * decision_leverage, 10) AS value_score FROM {INSIGHTS}
 WHERE statistical_strength BETWEEN 0 AND 1))"""


def _insights(spark, sf):
    k = F.col("cust_key")
    return read(spark, sf, "customer").select(
        F.col("nation_key").alias("report"),
        F.concat(F.lit("i"), k.cast("string")).alias("insight_id"),
        (F.col("acctbal") / 10000).alias("statistical_strength"),
        ((k % 11) / 10.0).alias("novelty_score"),
        ((k % 5) / 4.0).alias("decision_leverage"),
    )


@query("insight_value", f"SELECT report, insight_id, round(value_score, 6) AS value_score, value_tier FROM {SCORED}")
def insight_value(spark, sf):
    return pick(audit.insight_value(_insights(spark, sf))[0], "report", "insight_id", "value_tier", value_score=6)


@query("insight_rejects", f"SELECT report, insight_id FROM {INSIGHTS} WHERE NOT statistical_strength BETWEEN 0 AND 1")
def insight_rejects(spark, sf):
    return audit.insight_value(_insights(spark, sf))[1].select("report", "insight_id")


@query(
    "overall_value",
    f"""SELECT report, round(avg(value_score), 6) AS overall_value_score, count(*) AS n_insights,
    coalesce(string_agg(insight_id, ',' ORDER BY insight_id) FILTER (value_tier = 'low_value'), '') AS low_value_insights FROM {SCORED} GROUP BY report""",
)
def overall_value(spark, sf):
    df = audit.overall_value(audit.insight_value(_insights(spark, sf))[0])
    return df.select(
        "report", rnd("overall_value_score"), "n_insights", F.array_join("low_value_insights", ",").alias("low_value_insights")
    )



@query(
    "low_value_rows",
    f"""SELECT report, insight_id, round(value_score, 6) AS value_score FROM {SCORED} WHERE value_tier = 'low_value'""",
)
def low_value_rows(spark, sf):
    return audit.low_value_rows(audit.insight_value(_insights(spark, sf))[0]).select("report", "insight_id", rnd("value_score"))

# One report per order, one finding per line of it.
REPORTS = "(SELECT o_orderkey AS report, o_orderstatus = 'F' AS approved, (o_orderkey % 101) / 100.0::DOUBLE AS score FROM orders)"
# The types, written out: a wrong one in the library must show.
FINDING_TYPES = [
    "id_column_misuse", "correlation_causation_error", "unsupported_claim", "missing_data_inflation",
    "outlier_misinterpretation", "redundancy", "weak_signal_overstatement", "missing_limitations",
]
FINDINGS = "(SELECT l_orderkey AS report, CASE WHEN l_returnflag = 'R' THEN 'block' ELSE 'warn' END AS severity FROM lineitem)"


def _reports(spark, sf):
    return read(spark, sf, "orders").select(
        F.col("order_key").alias("report"),
        (F.col("orderstatus") == "F").alias("approved"),
        ((F.col("order_key") % 101) / 100.0).alias("score"),
        F.col("orderpriority").alias("schema_hash"),
        F.when(F.col("orderstatus") == "O", F.concat(F.lit("redo "), F.col("cust_key").cast("string"))).alias("revision_instructions"),
    )


def _findings(spark, sf):
    return read(spark, sf, "lineitem").select(
        F.col("order_key").alias("report"),
        F.when(F.col("returnflag") == "R", "block").otherwise("warn").alias("severity"),
        F.element_at(F.array(*[F.lit(t) for t in audit.FINDING_TYPES]), F.col("line_num")).alias("finding_type"),
        F.concat(F.lit("part_"), (F.col("part_key") % 50).cast("string")).alias("affected_insight"),
        F.concat(F.lit("supplier "), F.col("supp_key").cast("string")).alias("reason"),
        "line_num", "part_key", "supp_key", "linestatus",
    )


@query(
    "clamp_scores",
    f"""WITH f AS (SELECT report, bool_or(severity = 'block') AS b, count(*) AS n FROM {FINDINGS} GROUP BY report),
    a AS (SELECT r.*, coalesce(b, false) AS b, coalesce(n, 0) AS n FROM {REPORTS} r LEFT JOIN f USING (report)),
    s1 AS (SELECT *, CASE WHEN b AND score > 0.3 THEN 0.0 ELSE score END AS x FROM a),
    s2 AS (SELECT *, CASE WHEN NOT approved AND x > 0.5 THEN 0.4 ELSE x END AS y FROM s1)
    SELECT report, approved, n AS n_findings, round(CASE WHEN approved AND n > 0 AND y > 0.85 THEN 0.85 ELSE y END, 4) AS clamped_score FROM s2""",
)
def clamp_scores(spark, sf):
    df = audit.clamp_scores(_reports(spark, sf), _findings(spark, sf))
    return pick(df, "report", "approved", "n_findings", clamped_score=4)


# Each profiled fact is claimed with an error that depends on what it is.
CLAIMED = """CASE metric WHEN 'correlation' THEN CASE WHEN "column" < column2 THEN -value ELSE value END WHEN 'q1' THEN value * 1.005 WHEN 'q3' THEN value * 1.02
 WHEN 'missing_pct' THEN value + 1 ELSE value END"""
COLUMN_SQL = f"""(SELECT "table", "column", category FROM ({CLASSIFIED}) WHERE "table" = 'lineitem' UNION ALL
 SELECT 'docs', "column", category FROM ({CLASSIFIED}) WHERE "table" = 'documents' UNION ALL
 SELECT 'docs', "column", category FROM ({CLASSIFIED}) WHERE "table" = 'labels' AND "column" <> 'doc_id')"""
ID_SQL = f"""(SELECT "table", "column" FROM {COLUMN_SQL} WHERE category = 'id_like')"""
CLAIM_FINDINGS = f"""(SELECT * FROM (SELECT "table" AS report, claim, "column", column2, metric,
 CASE WHEN ("table", "column") IN (FROM {ID_SQL}) OR coalesce(("table", column2) IN (FROM {ID_SQL}), false) THEN 'id_misuse'
  WHEN metric = 'correlation' AND coalesce(sign(claimed) * sign(value) < 0, false) THEN 'direction_error'
  WHEN coalesce(abs(claimed - value) > 0.01 * greatest(abs(value), 1e-12), false) THEN 'hallucination' WHEN value IS NULL THEN 'no_fact' END AS issue_type
 FROM (SELECT *, "column" || '/' || coalesce(column2, '') || '/' || metric AS claim, {CLAIMED} AS claimed FROM ({FACTS}))) WHERE issue_type IS NOT NULL)"""


def _claims(spark, sf):
    facts = audit.profile_facts(profiled(spark, sf))
    v = F.col("value")
    claimed = (
        F.when(F.col("metric") == "correlation", F.when(F.col("column") < F.col("column2"), -v).otherwise(v))
        .when(F.col("metric") == "q1", v * 1.005)
        .when(F.col("metric") == "q3", v * 1.02)
        .when(F.col("metric") == "missing_pct", v + 1)
        .otherwise(v)
    )
    # Correlations are claimed with the columns the other way round.
    pair = F.col("column2").isNotNull()
    claims = facts.select(
        F.col("table").alias("report"),
        F.concat_ws("/", "column", F.coalesce("column2", F.lit("")), "metric").alias("claim"),
        "table",
        F.when(pair, F.col("column2")).otherwise(F.col("column")).alias("column"),
        F.when(pair, F.col("column")).alias("column2"),
        "metric", claimed.alias("value"),
    )
    ts = tables(spark, sf, "lineitem")
    ts["docs"] = labelled(spark, sf)
    return claims, facts, columns_table(ts, samples=0)


@query(
    "verify_claims",
    f"""SELECT report, claim, metric, issue_type, CASE issue_type WHEN 'id_misuse' THEN 'id_column_misuse' WHEN 'direction_error' THEN 'correlation_causation_error'
    ELSE 'unsupported_claim' END AS finding_type, CASE issue_type WHEN 'no_fact' THEN 'warn' ELSE 'block' END AS severity FROM {CLAIM_FINDINGS}""",
)
def verify_claims(spark, sf):
    return audit.verify_claims(*_claims(spark, sf)).select("report", "claim", "metric", "issue_type", "finding_type", "severity")


@query(
    "verdicts",
    f"SELECT report, count_if(issue_type <> 'no_fact') AS n_blocks, count_if(issue_type <> 'no_fact') = 0 AS approved FROM {CLAIM_FINDINGS} GROUP BY report",
)
def verdicts(spark, sf):
    claims, facts, columns = _claims(spark, sf)
    return audit.verdicts(claims.select("report").distinct(), audit.verify_claims(claims, facts, columns))


@query(
    "rewrites_from_findings",
    f"""SELECT report, row_number() OVER (PARTITION BY report ORDER BY claim, issue_type) AS seq, claim AS insight_id, issue_type,
    CASE issue_type WHEN 'id_misuse' THEN 'leave out the key column' WHEN 'direction_error' THEN 'state the direction that the data shows'
    ELSE 'use the measured value' END AS fix_instruction FROM {CLAIM_FINDINGS} WHERE issue_type <> 'no_fact'""",
)
def rewrites_from_findings(spark, sf):
    return audit.rewrites_from_findings(audit.verify_claims(*_claims(spark, sf)))


# Claims about quantities (which have gaps here) and discounts, with causal words in some reports.
_WARNED = """(SELECT l_orderkey AS report, l_linenumber AS line, CASE WHEN l_linenumber % 2 = 0 THEN 'quantity' ELSE 'discount' END AS "column",
 l_returnflag = 'R' AS causal, CAST(l_quantity AS BIGINT) AS n FROM lineitem)"""


@query(
    "warn_findings",
    f"""SELECT report, line, "column", 'causal_wording' AS issue_type, 'correlation_causation_error' AS finding_type, 'warn' AS severity FROM {_WARNED} WHERE causal
    UNION ALL SELECT report, line, "column", 'small_sample', 'weak_signal_overstatement', 'warn' FROM {_WARNED} WHERE n < 30
    UNION ALL SELECT report, line, "column", 'mandatory_gap', 'missing_data_inflation', 'warn' FROM {_WARNED} WHERE "column" = 'quantity'""",
)
def warn_findings(spark, sf):
    df = read(spark, sf, "lineitem")
    gaps = df.select(F.when(F.col("line_num") != 3, F.col("quantity")).alias("quantity"), "discount")
    table = F.lit("lineitem").alias("table")
    none = F.lit(None).cast("string")
    facts = p.pair_correlation(gaps, "quantity", "discount").select(
        table, F.col("col_x").alias("column"), F.col("col_y").alias("column2"), F.lit("correlation").alias("metric"), F.col("r").alias("value")
    ).unionByName(
        p.missing_report(gaps).select(
            table, "column", none.alias("column2"), F.lit("missing_count").alias("metric"), F.col("missing_count").cast("double").alias("value")
        )
    )
    even = F.col("line_num") % 2 == 0
    claims = df.select(
        F.col("order_key").alias("report"), F.col("line_num").alias("line"), table,
        F.when(even, "quantity").otherwise("discount").alias("column"), F.when(even, "discount").otherwise("quantity").alias("column2"),
        (F.col("returnflag") == "R").alias("causal"), F.col("quantity").cast("long").alias("n"),
    )
    return audit.warn_findings(claims, facts).select("report", "line", "column", "issue_type", "finding_type", "severity")


@query(
    "rewrite_rows",
    f"""SELECT o_orderkey AS report, CASE WHEN l_orderkey IS NOT NULL THEN l_linenumber END AS seq, CASE WHEN l_orderkey IS NOT NULL
    THEN '- [insight_' || l_linenumber || '] (id_misuse): drop part ' || l_partkey
    ELSE coalesce(CASE WHEN o_orderstatus = 'O' THEN 'redo ' || o_custkey END, '{audit.NO_REWRITES.replace("'", "''")}') END AS line
    FROM orders LEFT JOIN (SELECT * FROM lineitem WHERE l_returnflag = 'R') ON l_orderkey = o_orderkey""",
)
def rewrite_rows(spark, sf):
    rewrites = _findings(spark, sf).where("severity = 'block'").select(
        "report", F.col("line_num").alias("seq"), F.concat(F.lit("insight_"), F.col("line_num").cast("string")).alias("insight_id"),
        F.lit("id_misuse").alias("issue_type"), F.concat(F.lit("drop part "), F.col("part_key").cast("string")).alias("fix_instruction"),
    )
    return audit.rewrite_rows(_reports(spark, sf), rewrites)


@query(
    "rewrite_list",
    f"""WITH w AS (SELECT l_orderkey AS report, string_agg('- [insight_' || l_linenumber || '] (' || CASE l_linestatus WHEN 'F' THEN 'math_error' ELSE 'id_misuse' END ||
      '): drop part ' || l_partkey, chr(10) ORDER BY l_linenumber, l_partkey, l_suppkey) AS t FROM
      (SELECT * FROM lineitem WHERE l_returnflag = 'R') GROUP BY l_orderkey)
    SELECT o_orderkey AS report, coalesce(t, CASE WHEN o_orderstatus = 'O' THEN 'redo ' || o_custkey END, '{audit.NO_REWRITES.replace("'", "''")}') AS rewrites
    FROM orders LEFT JOIN w ON report = o_orderkey""",
)
def rewrite_list(spark, sf):
    rewrites = _findings(spark, sf).where("severity = 'block'").select(
        "report",
        F.struct("line_num", "part_key", "supp_key").alias("seq"),
        F.concat(F.lit("insight_"), F.col("line_num").cast("string")).alias("insight_id"),
        F.when(F.col("linestatus") == "F", "math_error").otherwise("id_misuse").alias("issue_type"),
        F.concat(F.lit("drop part "), F.col("part_key").cast("string")).alias("fix_instruction"),
    )
    return audit.rewrite_list(_reports(spark, sf), rewrites)


# ---------------------------------------------------------------- history

# Each event is a join record of one of the families; the first half of them is the stored history.
RECORD = """SELECT event_type AS schema_hash, 't' || user_id % 7 AS left_table, 't' || user_id % 5 AS right_table, 'k' || user_id % 3 AS on_column,
 CASE user_id % 2 WHEN 0 THEN 'inner' ELSE 'left' END AS join_type, 'r' || event_id AS result_name, event_id AS row_count, value AS score,
 ts AS created_at, ts AS last_seen_at, event_id AS seq FROM events"""
MERGED = f"""(SELECT schema_hash, left_table, right_table, on_column, join_type, arg_min(result_name, seq) AS result_name, arg_max(row_count, seq) AS row_count,
 arg_max(score, seq) AS score, arg_min(created_at, seq) AS created_at, arg_max(last_seen_at, seq) AS last_seen_at FROM ({RECORD}) GROUP BY ALL)"""


def _records(spark, sf):
    u = F.col("user_id")
    name = lambda prefix, m: F.concat(F.lit(prefix), (u % m).cast("string"))
    return read(spark, sf, "events").select(
        F.col("event_type").alias("schema_hash"), name("t", 7).alias("left_table"), name("t", 5).alias("right_table"),
        name("k", 3).alias("on_column"), F.when(u % 2 == 0, "inner").otherwise("left").alias("join_type"),
        F.concat(F.lit("r"), F.col("event_id").cast("string")).alias("result_name"), F.col("event_id").alias("row_count"),
        F.col("value").alias("score"), F.col("ts").alias("created_at"), F.col("ts").alias("last_seen_at"), F.col("event_id").alias("seq"),
    )


def _merged(spark, sf):
    rows = _records(spark, sf)
    empty = spark.createDataFrame([], h.SCHEMAS["joins"])
    middle = F.lit(datetime(2024, 1, 15)).cast("timestamp_ntz")
    old = h.merge_joins(empty, rows.where(F.col("created_at") < middle))
    return h.merge_joins(old, rows.where(F.col("created_at") >= middle))


@query("merge_joins", f"SELECT * FROM {MERGED}")
def merge_joins(spark, sf):
    return _merged(spark, sf)


@query("load_history", f"SELECT * FROM {MERGED} WHERE schema_hash = 'click'")
def load_history(spark, sf):
    return h.load_history({"joins": _merged(spark, sf)}, "click")["joins"]


@query(
    "prune_joins",
    f"""SELECT schema_hash, left_table, right_table, on_column, join_type, last_seen_at FROM {MERGED}
    WHERE NOT (schema_hash = 'click' AND last_seen_at < TIMESTAMP '2024-01-28 12:00:00')""",
)
def prune_joins(spark, sf):
    kept = h.prune_joins(_merged(spark, sf), "click", days=2, now=datetime(2024, 1, 30, 12))
    return kept.select(*h.JOIN_KEY, "last_seen_at")


@query(
    "merge_warnings",
    """SELECT event_type AS schema_hash, 'redundancy' AS finding_type, 'column_' || user_id % 20 AS affected, arg_min(props, event_id) AS reason,
    arg_min(CASE event_id % 3 WHEN 0 THEN 'block' ELSE 'warn' END, event_id) AS severity, count(*) AS times_seen, min(ts) AS first_seen_at, max(ts) AS last_seen_at
    FROM events WHERE event_id % 3 <> 0 OR user_id % 2 = 0 GROUP BY ALL""",
)
def merge_warnings(spark, sf):
    e = read(spark, sf, "events").select(
        F.col("event_type").alias("schema_hash"), F.lit("redundancy").alias("finding_type"),
        F.concat(F.lit("column_"), (F.col("user_id") % 20).cast("string")).alias("affected"), F.col("props").alias("reason"),
        F.when(F.col("event_id") % 3 == 0, "block").otherwise("warn").alias("severity"),
        (F.col("user_id") % 2 == 0).alias("approved"), F.col("ts").alias("last_seen_at"), F.col("event_id").alias("seq"),
    )
    empty = spark.createDataFrame([], h.SCHEMAS["warnings"])
    middle = F.lit(datetime(2024, 1, 15)).cast("timestamp_ntz")
    old = h.merge_warnings(empty, e.where(F.col("last_seen_at") < middle))
    return h.merge_warnings(old, e.where(F.col("last_seen_at") >= middle))


@query(
    "bump_runs",
    "SELECT event_type AS schema_hash, count(*) AS total_runs, max(ts) AS last_run_at FROM events GROUP BY ALL",
)
def bump_runs(spark, sf):
    runs = read(spark, sf, "events").select(F.col("event_type").alias("schema_hash"), F.col("ts").alias("last_run_at"))
    return h.bump_runs(spark.createDataFrame([], h.SCHEMAS["runs"]), runs)


@query(
    "findings_to_warnings",
    f"""SELECT o_orderpriority AS schema_hash, ({FINDING_TYPES!r})[l_linenumber] AS finding_type, 'part_' || l_partkey % 50 AS affected,
    'supplier ' || l_suppkey AS reason, CASE WHEN l_returnflag = 'R' THEN 'block' ELSE 'warn' END AS severity, o_orderstatus = 'F' AS approved
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
)
def findings_to_warnings(spark, sf):
    return h.findings_to_warnings(_reports(spark, sf), _findings(spark, sf))


@query(
    "stamp_scores",
    "SELECT l_orderkey AS report, l_linenumber AS step, (l_orderkey % 101) / 100.0::DOUBLE AS score FROM lineitem",
)
def stamp_scores(spark, sf):
    joins = read(spark, sf, "lineitem").select(F.col("order_key").alias("report"), F.col("line_num").alias("step"), F.lit(0.0).alias("score"))
    return h.stamp_scores(joins, _reports(spark, sf)).select("report", "step", "score")


# The store: events before and after the middle of January are two runs of each family.


def _store(spark, sf):
    ensure_checkpoint_dir(spark)
    store = h.HistoryStore(spark, f"{spark.sparkContext.getCheckpointDir()}/history-{uuid.uuid4().hex}")
    rows = _records(spark, sf)
    middle = F.lit(datetime(2024, 1, 15)).cast("timestamp_ntz")
    none = spark.createDataFrame([], h.SCHEMAS["warnings"]).select(
        "schema_hash", "finding_type", "affected", "reason", "severity", F.lit(False).alias("approved"), F.lit(0).cast("long").alias("seq")
    )
    for family in ("click", "view"):
        own = rows.where(F.col("schema_hash") == family)
        store.persist(family, own.where(F.col("created_at") < middle), none, datetime(2024, 1, 15))
        store.persist(family, own.where(F.col("created_at") >= middle), none, datetime(2024, 1, 30, 12))
    return store


# A record's last sight is the time of the last run that had it.
RAN = f"""(SELECT * REPLACE (CASE WHEN last_seen_at >= TIMESTAMP '2024-01-15' THEN TIMESTAMP '2024-01-30 12:00:00' ELSE TIMESTAMP '2024-01-15' END AS last_seen_at)
 FROM {MERGED})"""


@query("history_store", f"SELECT * FROM {RAN} WHERE schema_hash = 'click'")
def history_store(spark, sf):
    return _store(spark, sf).load("click")["joins"]


@query(
    "history_prune",
    f"""SELECT * FROM {RAN} WHERE schema_hash IN ('click', 'view') AND NOT (schema_hash = 'click' AND last_seen_at < TIMESTAMP '2024-01-28 12:00:00')""",
)
def history_prune(spark, sf):
    store = _store(spark, sf)
    store.prune("click", 2, datetime(2024, 1, 30, 12))
    return store.tables()["joins"]


# Two writers of one family: the second read the store before the first committed, loses the race for the version,
# folds its run into the first one's and commits after it.  Both runs count.
@query("history_two_writers", f"SELECT * FROM {RAN} WHERE schema_hash = 'click'")
def history_two_writers(spark, sf):
    ensure_checkpoint_dir(spark)
    store = h.HistoryStore(spark, f"{spark.sparkContext.getCheckpointDir()}/history-{uuid.uuid4().hex}")
    own = _records(spark, sf).where(F.col("schema_hash") == "click")
    middle = F.lit(datetime(2024, 1, 15)).cast("timestamp_ntz")
    none = spark.createDataFrame([], h.SCHEMAS["warnings"]).select(
        "schema_hash", "finding_type", "affected", "reason", "severity", F.lit(False).alias("approved"), F.lit(0).cast("long").alias("seq")
    )
    seen = store.version("click")  # both writers start from here
    store.persist("click", own.where(F.col("created_at") < middle), none, datetime(2024, 1, 15), read_version=seen)
    store.persist("click", own.where(F.col("created_at") >= middle), none, datetime(2024, 1, 30, 12), read_version=seen)
    return store.load("click")["joins"]


# The three remaining finding types on claims about lineitem: repeated claims, means that rest on outliers, gaps unstated.
_MORE_DATA = """(SELECT l_orderkey, l_linenumber, l_returnflag, CASE WHEN l_linenumber <> 3 THEN CAST(l_quantity AS DOUBLE) END AS quantity,
 CAST(l_extendedprice AS DOUBLE) AS extendedprice, CASE WHEN l_linenumber = 7 THEN 50 * CAST(l_extendedprice AS DOUBLE) ELSE CAST(l_extendedprice AS DOUBLE) END AS spiky
 FROM lineitem)"""
_MORE_COLUMN = "CASE l_linenumber % 3 WHEN 0 THEN 'quantity' WHEN 1 THEN 'extendedprice' ELSE 'spiky' END"


@query(
    "more_findings",
    f"""WITH d AS {_MORE_DATA},
u AS (SELECT 'quantity' AS col, quantity AS v FROM d UNION ALL SELECT 'extendedprice', extendedprice FROM d UNION ALL SELECT 'spiky', spiky FROM d),
q AS (SELECT col, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.75) AS q3, avg(v) AS m, count_if(v IS NULL) / count(*) AS s FROM u GROUP BY col),
f AS (SELECT q.col, any_value(q.m) AS m, any_value(q.s) AS s,
  avg(CASE WHEN u.v BETWEEN q.q1 - 1.5 * (q.q3 - q.q1) AND q.q3 + 1.5 * (q.q3 - q.q1) THEN u.v END) AS fm FROM q JOIN u ON q.col = u.col GROUP BY q.col),
c AS (SELECT l_orderkey AS report, l_linenumber AS claim, {_MORE_COLUMN} AS "column", l_returnflag = 'R' AS limited,
  row_number() OVER (PARTITION BY l_orderkey, {_MORE_COLUMN} ORDER BY l_linenumber) AS nth FROM d)
SELECT report, claim, "column", 'repeated_claim' AS issue_type, 'redundancy' AS finding_type, 'warn' AS severity FROM c WHERE nth > 1
UNION ALL SELECT report, claim, "column", 'outlier_driven', 'outlier_misinterpretation', 'warn' FROM c JOIN f ON c."column" = f.col
  WHERE abs(f.m - f.fm) > 0.1 * greatest(abs(f.fm), 1e-12)
UNION ALL SELECT report, claim, "column", 'unstated_gap', 'missing_limitations', 'warn' FROM c JOIN f ON c."column" = f.col
  WHERE f.s * 100 > 5 AND NOT coalesce(limited, false)""",
)
def more_findings(spark, sf):
    line = read(spark, sf, "lineitem")
    price = F.col("extendedprice").cast("double")
    data = line.select(
        "order_key", "line_num", "returnflag", F.when(F.col("line_num") != 3, F.col("quantity").cast("double")).alias("quantity"),
        price.alias("extendedprice"), F.when(F.col("line_num") == 7, price * 50).otherwise(price).alias("spiky"),
    )
    facts = audit.fenced_means(data, ["quantity", "extendedprice", "spiky"], "lineitem")
    which = F.when(F.col("line_num") % 3 == 0, "quantity").when(F.col("line_num") % 3 == 1, "extendedprice").otherwise("spiky")
    claims = data.select(
        F.col("order_key").alias("report"), F.col("line_num").alias("claim"), F.lit("lineitem").alias("table"), which.alias("column"),
        F.lit(None).cast("string").alias("column2"), F.lit("mean").alias("metric"), (F.col("returnflag") == "R").alias("limited"),
    )
    return audit.more_findings(claims, facts).select("report", "claim", "column", "issue_type", "finding_type", "severity")
