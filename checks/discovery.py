from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from tablescope import sources
from tablescope.functions import redact_credentials
from tablescope.operators import discover as d
from tablescope.operators import joins, profile
from tablescope.operators.charts import chart_points
from tablescope.operators.stats import nonfinite_scan
from tablescope.session import ensure_checkpoint_dir

from .registry import query, rnd
from .views import COLUMNS, OTHER, STAR, kind, plain, read, sql, tables

ALL = STAR + OTHER


def _union(parts) -> str:
    return "\nUNION ALL ".join(parts)


# ---------------------------------------------------------------- sources

ROW_COUNTS = _union(
    f"SELECT '{t}' AS \"table\", count(*) AS row_count, {len(COLUMNS[t])} AS n_columns FROM {t}" for t in ALL
)


@query("row_counts", ROW_COUNTS)
def row_counts(spark, sf):
    return sources.row_counts(tables(spark, sf))


@query("total_rows", f"SELECT CAST(sum(row_count) AS BIGINT) AS total_rows FROM ({ROW_COUNTS})")
def total_rows(spark, sf):
    return sources.total_rows(tables(spark, sf))


@query("table_set", ROW_COUNTS)
def table_set(spark, sf):
    return sources.row_counts(sources.load_table_set(spark, sf, "parquet", ALL))


@query("catalog_scan", ROW_COUNTS)
def catalog_scan(spark, sf):
    tables(spark, sf).register()
    found = sources.load_catalog(spark)
    return sources.row_counts({t: found[t] for t in ALL})


@query(
    "full_scan",
    f"SELECT orderstatus, count(*) AS n FROM {sql('orders')} GROUP BY ALL",
)
def full_scan(spark, sf):
    tables(spark, sf, "orders").register()
    return sources.full_scan(spark, "orders").groupBy("orderstatus").agg(F.count("*").alias("n"))


@query(
    "load_csv",
    """SELECT event_type, count(*) AS n, count(CASE WHEN user_id % 9 <> 0 THEN value END) AS n_values,
       round(sum(CASE WHEN user_id % 9 <> 0 THEN value END), 2) AS total, count(DISTINCT props) AS n_props,
       min(event_id) AS first_id, max(user_id) AS last_user FROM events GROUP BY ALL""",
)
def load_csv(spark, sf):
    # The events written as text with "N/A" cells, then read back.
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/csv/{os.path.basename(sf.rstrip('/'))}/events.csv"
    e = read(spark, sf, "events").withColumn(
        "value", F.when(F.col("user_id") % 9 != 0, F.col("value").cast("string")).otherwise("N/A")
    )
    e.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
    back = sources.load_csv(spark, path)["events"]
    return back.groupBy("event_type").agg(
        F.count("*").alias("n"), F.count("value").alias("n_values"), F.round(F.sum("value"), 2).alias("total"),
        F.count_distinct("props").alias("n_props"), F.min("event_id").alias("first_id"), F.max("user_id").alias("last_user"),
    )


@query("load_csv_parts", "SELECT n_nationkey AS nation_key, n_name AS name, n_regionkey AS region_key FROM nation")
def load_csv_parts(spark, sf):
    # Two parts of one folder whose headers name the columns in other orders: read by name, not by place.
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/csv/{os.path.basename(sf.rstrip('/'))}/{uuid.uuid4().hex}/nation.csv"
    nation = read(spark, sf, "nation")
    nation.where("nation_key < 12").select("nation_key", "name", "region_key").write.option("header", True).csv(path)
    nation.where("nation_key >= 12").select("region_key", "name", "nation_key").write.mode("append").option("header", True).csv(path)
    return sources.load_csv(spark, path)["nation"].select("nation_key", "name", "region_key")


@query("load_csv_text", "SELECT doc_id, md5(text) AS digest, length(text) AS n, n_chars FROM documents")
def load_csv_text(spark, sf):
    # Texts with line breaks, quotes and commas, written and read back.
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/csv/{os.path.basename(sf.rstrip('/'))}/documents.csv"
    writer = read(spark, sf, "documents").select("doc_id", "text", "n_chars").write.mode("overwrite").option("header", True)
    for name in ("ignoreLeadingWhiteSpace", "ignoreTrailingWhiteSpace"):
        writer = writer.option(name, False)
    writer.option("quoteAll", True).option("escape", '"').csv(path)
    back = sources.load_csv(spark, path)["documents"]
    return back.select("doc_id", F.md5("text").alias("digest"), F.length("text").cast("long").alias("n"), "n_chars")


@query(
    "missing_norm",
    """SELECT lang, count(*) AS n, count(nullif(source, 'src1')) AS n_source,
       count(CASE WHEN n_chars % 7 <> 0 THEN n_chars END) AS n_ratio FROM documents GROUP BY ALL""",
)
def missing_norm(spark, sf):
    docs = read(spark, sf, "documents").select(
        "lang", F.when(F.col("source") == "src1", "N/A").otherwise(F.col("source")).alias("source"),
        F.when(F.col("n_chars") % 7 == 0, float("nan")).otherwise(F.col("n_chars").cast("double")).alias("ratio"),
    )
    out = sources.missing_norm(docs, sources.tables.MISSING_TOKENS)
    return out.groupBy("lang").agg(
        F.count("*").alias("n"), F.count("source").alias("n_source"), F.count("ratio").alias("n_ratio")
    )


@query(
    "bounded_sample",
    f"""SELECT order_key, cust_key, orderstatus, totalprice FROM {sql('orders')}
    ORDER BY md5(CAST(order_key AS VARCHAR)), order_key LIMIT 500""",
)
def bounded_sample(spark, sf):
    return sources.bounded_sample(read(spark, sf, "orders"), 500, key=["order_key"]).select(
        "order_key", "cust_key", "orderstatus", "totalprice"
    )


@query(
    "semantic_sample",
    """SELECT event_id, user_id, event_type, round(value / 3, 4) AS value FROM events
    ORDER BY md5(CAST(event_id AS VARCHAR)), event_id LIMIT 5""",
)
def semantic_sample(spark, sf):
    e = read(spark, sf, "events").select("event_id", "user_id", "event_type", (F.col("value") / 3).alias("value"))
    return sources.semantic_sample(e, 5, key=["event_id"])


def _draws(table: str) -> str:
    parts = []
    for c in COLUMNS[table]:
        p = plain(c, table)
        draws = ", ".join(f"arg_min(v, substr(md5(v), {1 + 8 * i}, 8) || v)" for i in range(3))
        parts.append(
            f"SELECT '{p}' AS \"column\", array_to_string([{draws}], '|') AS sample_values "
            f"FROM (SELECT CAST({p} AS VARCHAR) AS v FROM {sql(table)})"
        )
    return _union(parts)


@query("column_samples", _draws("orders"))
def column_samples(spark, sf):
    return sources.column_samples(read(spark, sf, "orders"), 3, "md5").select(
        "column", F.array_join("sample_values", "|").alias("sample_values")
    )


@query(
    "redact_credentials",
    r"""SELECT page_id, regexp_replace(replace(url, '://', '://user:secret' || page_id || '@'),
    '(://[^:]+:)([^@]+)(@)', '\1***\3', 'g') AS url FROM pages""",
)
def redact(spark, sf):
    pages = read(spark, sf, "pages")
    url = F.replace(F.col("url"), F.lit("://"), F.concat(F.lit("://user:secret"), F.col("page_id").cast("string"), F.lit("@")))
    return pages.select("page_id", redact_credentials(url).alias("url"))


def _broken(column: str) -> str:
    return (
        f"CASE WHEN user_id % 50 = 0 THEN 'nan'::DOUBLE WHEN user_id % 77 = 1 THEN 'infinity'::DOUBLE "
        f"WHEN user_id % 91 = 1 THEN NULL ELSE {column} END"
    )


@query(
    "nonfinite_scan",
    _union(
        f"SELECT '{c}' AS \"column\", count_if(v IS NULL) AS null_count, count_if(isnan(v)) AS nan_count, "
        f"count_if(isinf(v)) AS inf_count, count_if(v IS NULL) + count_if(isnan(v)) + count_if(isinf(v)) = 0 AS citable "
        f"FROM (SELECT {e} AS v FROM events)"
        for c, e in (("value", "value"), ("ratio", _broken("value")), ("user_id", "user_id::DOUBLE"))
    ),
)
def nonfinite(spark, sf):
    u = F.col("user_id")
    ratio = (
        F.when(u % 50 == 0, float("nan")).when(u % 77 == 1, float("inf")).when(u % 91 == 1, None).otherwise(F.col("value"))
    )
    return nonfinite_scan(read(spark, sf, "events").select("value", ratio.alias("ratio"), "user_id"))


@query(
    "chart_points",
    """SELECT 'brand' AS chart, row_number() OVER (ORDER BY value DESC, label) AS ord, label, round(value, 2) AS value FROM
    (SELECT p_brand AS label, sum(p_retailprice) AS value FROM part GROUP BY ALL ORDER BY value DESC, label LIMIT 7)""",
)
def chart(spark, sf):
    return chart_points(read(spark, sf, "part"), "brand", "retailprice", chart="brand").select(
        "chart", "ord", "label", rnd("value", 2)
    )


# ---------------------------------------------------------------- columns

STATS = _union(
    f"SELECT '{t}' AS \"table\", {i} AS ordinal, '{plain(c, t)}' AS \"column\", '{kind(c)}' AS kind, {ALL.index(t)} AS pos, "
    f"count(*) AS n_rows, count(*) - count({c}) AS n_missing, "
    f"{'NULL::BIGINT' if kind(c) == 'array' else f'count(DISTINCT {c})'} AS n_distinct FROM {t}"
    for t in ALL
    for i, c in enumerate(COLUMNS[t])
)


def _suffix(suffixes) -> str:
    return "(" + " OR ".join(f"ends_with(lower(\"column\"), '{s}')" for s in suffixes) + ")"


_UNIQUE = "(kind IN ('integer', 'number') AND n_distinct / n_rows > 0.6 AND n_distinct > 50)"
# The rules' values, written out: a wrong one in the library must show.
ID_SUFFIXES = ["_id", "_key", "_code", "_num", "_no"]
STRONG_SUFFIXES = ["_id", "_key", "_code", "pk", "fk"]
CLASSIFIED = f"""SELECT *, CASE WHEN category = 'id_like' THEN CASE WHEN {_suffix(ID_SUFFIXES)} THEN 'name' ELSE 'uniqueness' END END AS id_evidence
FROM (SELECT *, CASE WHEN kind = 'array' THEN NULL WHEN kind = 'datetime' THEN 'datetime' WHEN {_suffix(ID_SUFFIXES)} OR {_UNIQUE} THEN 'id_like'
 WHEN kind IN ('integer', 'number') AND n_distinct < 20 THEN 'numeric_discrete'
 WHEN kind IN ('integer', 'number') THEN 'numeric_continuous'
 WHEN n_distinct < 15 THEN 'categorical_low_cardinality' WHEN n_distinct > 100 THEN 'free_text'
 ELSE 'categorical_high_cardinality' END AS category FROM ({STATS}))"""

CANDIDATES = f"""SELECT a."table" AS table_a, a."column" AS column_a, b."table" AS table_b, b."column" AS column_b,
CASE WHEN {_suffix(STRONG_SUFFIXES).replace('"column"', 'a."column"')} THEN 0.9 ELSE 0.7 END AS confidence
FROM ({CLASSIFIED}) a JOIN ({CLASSIFIED}) b ON lower(a."column") = lower(b."column") AND a.pos < b.pos
WHERE a.category IN ('id_like', 'numeric_discrete', 'categorical_low_cardinality')"""


@query(
    "column_stats",
    f'SELECT "table", ordinal, "column", n_rows, n_missing, n_distinct FROM ({STATS})',
)
def column_stats(spark, sf):
    return d.columns_table(tables(spark, sf), exact=True, samples=0).select(
        "table", "ordinal", "column", "n_rows", "n_missing", "n_distinct"
    )


@query("classify_columns", f'SELECT "table", "column", category, id_evidence FROM ({CLASSIFIED})')
def classify(spark, sf):
    return d.columns_table(tables(spark, sf)).select("table", "column", "category", "id_evidence")


@query("name_candidates", f"SELECT *, 'name_match' AS detection_method FROM ({CANDIDATES})")
def candidates(spark, sf):
    return d.name_candidates(d.columns_table(tables(spark, sf), samples=0))


def _pairs():
    for i, a in enumerate(ALL):
        for b in ALL[i + 1 :]:
            for ca in COLUMNS[a]:
                for cb in COLUMNS[b]:
                    if plain(ca, a) == plain(cb, b):
                        yield a, ca, b, cb


def _overlap_exact(a, ca, b, cb) -> str:
    return (
        f"SELECT '{a}' AS table_a, '{plain(ca, a)}' AS column_a, '{b}' AS table_b, '{plain(cb, b)}' AS column_b, "
        f"(SELECT count(*) FROM (SELECT {ca} FROM {a} INTERSECT SELECT {cb} FROM {b})) / "
        f"least(count(DISTINCT {ca}), (SELECT count(DISTINCT {cb}) FROM {b})) AS overlap_ratio, "
        f"(SELECT count(*) FROM (SELECT {ca} FROM {a} INTERSECT SELECT {cb} FROM {b})) / "
        f"(SELECT count(DISTINCT {cb}) FROM {b}) AS b_in_a_ratio, "
        f"count(DISTINCT {ca}) = count({ca}) AS ua, (SELECT count(DISTINCT {cb}) = count({cb}) FROM {b}) AS ub FROM {a}"
    )


def _overlap_sampled(a, ca, b, cb) -> str:
    def sample(t, c):
        return f"(SELECT v FROM (SELECT DISTINCT {c} AS v FROM {t} WHERE {c} IS NOT NULL) ORDER BY md5(CAST(v AS VARCHAR)), CAST(v AS VARCHAR) LIMIT 500)"

    def share(t, c, u, k):
        return f"(SELECT count_if(v IN (SELECT {k} FROM {u})) / count(*) FROM {sample(t, c)})"

    return (
        f"SELECT '{a}' AS table_a, '{plain(ca, a)}' AS column_a, '{b}' AS table_b, '{plain(cb, b)}' AS column_b, "
        f"CASE WHEN count(DISTINCT {ca}) <= (SELECT count(DISTINCT {cb}) FROM {b}) THEN {share(a, ca, b, cb)} "
        f"ELSE {share(b, cb, a, ca)} END AS overlap_ratio, {share(b, cb, a, ca)} AS b_in_a_ratio, "
        f"count(DISTINCT {ca}) = count({ca}) AS ua, (SELECT count(DISTINCT {cb}) = count({cb}) FROM {b}) AS ub FROM {a}"
    )


def _relationships(measure) -> str:
    return f"""WITH m AS (SELECT c.*, o.overlap_ratio, o.b_in_a_ratio, o.ua, o.ub FROM ({CANDIDATES}) c
  JOIN ({_union(measure(*p) for p in _pairs())}) o USING (table_a, column_a, table_b, column_b) WHERE overlap_ratio >= 0.15),
g AS (SELECT table_a, column_a, table_b, column_b, least(1.0, confidence + overlap_ratio * 0.15) AS confidence,
  'combined' AS detection_method, overlap_ratio, b_in_a_ratio,
  CASE WHEN ua AND NOT ub THEN 'one_to_many' WHEN NOT ua AND NOT ub THEN 'many_to_many' WHEN ua AND ub THEN 'one_to_one' ELSE 'unknown' END AS cardinality,
  CASE WHEN ua AND NOT ub THEN 'one_to_many' WHEN NOT ua AND NOT ub THEN 'many_to_many' WHEN ua AND ub THEN 'one_to_one' ELSE 'many_to_one' END AS cardinality_full,
  CASE WHEN b_in_a_ratio > 0.9 THEN 'inner' ELSE 'left' END AS join_hint FROM m)
SELECT table_a, column_a, table_b, column_b, round(confidence, 6) AS confidence, detection_method, round(overlap_ratio, 6) AS overlap_ratio,
 round(b_in_a_ratio, 6) AS b_in_a_ratio, cardinality, cardinality_full, join_hint,
 CASE WHEN confidence > 0.6 THEN format('{{}} {{}} JOIN {{}} ON {{}} (confidence: {{}}%)', table_a, upper(join_hint), table_b, column_a,
  CAST(round_even(confidence * 100, 0) AS INTEGER)) END AS suggestion FROM g"""


RELATION_COLUMNS = ["table_a", "column_a", "table_b", "column_b"]


def _tidy(df):
    return df.select(
        *RELATION_COLUMNS, rnd("confidence"), "detection_method", rnd("overlap_ratio"), rnd("b_in_a_ratio"),
        "cardinality", "cardinality_full", "join_hint", "suggestion",
    )


@query("relationships_exact", _relationships(_overlap_exact))
def relationships_exact(spark, sf):
    return _tidy(d.discover(tables(spark, sf), samples=0).relationships)


@query("relationships_sampled", _relationships(_overlap_sampled))
def relationships_sampled(spark, sf):
    return _tidy(d.discover(tables(spark, sf), method="sampled", samples=0).relationships)




@query(
    "suggested_joins",
    f"""SELECT suggestion, confidence FROM ({_relationships(_overlap_exact)}) WHERE confidence > 0.6""",
)
def suggestions(spark, sf):
    found = d.discover(tables(spark, sf), samples=0).suggestions
    return found.select("suggestion", rnd("confidence"))


PLAN = f"""SELECT row_number() OVER (ORDER BY CASE cardinality_full WHEN 'one_to_one' THEN 0 ELSE 1 END, confidence DESC, table_a, column_a, table_b) AS seq,
  table_a AS left_table, table_b AS right_table, column_a AS on_column, join_hint AS join_type, cardinality_full AS cardinality, confidence,
  table_a || '_' || table_b || '_' || column_a AS result_name FROM ({_relationships(_overlap_exact)})
  WHERE confidence > 0.6 AND column_a = column_b AND cardinality_full <> 'many_to_many'"""


@query("join_plan", PLAN)
def join_plan(spark, sf):
    found = d.discover(tables(spark, sf), samples=0).relationships
    return joins.join_plan(found.withColumn("confidence", F.round("confidence", 6)))


# A unique fractional number (a price) is a measure; other id-like columns are keys.
ROLES = f"""SELECT *, coalesce(id_evidence = 'uniqueness' AND kind = 'number', false) AS unique_measure,
 coalesce(category = 'id_like' AND NOT (id_evidence = 'uniqueness' AND kind = 'number'), false) AS is_key FROM ({CLASSIFIED})"""


@query(
    "auto_plans",
    f"""SELECT "table", bool_or(NOT is_key) AS should_profile,
    coalesce(string_agg("column", ',' ORDER BY ordinal) FILTER (is_key), '') AS id_like,
    coalesce(string_agg("column", ',' ORDER BY ordinal) FILTER (NOT is_key AND (category IN ('numeric_discrete', 'numeric_continuous') OR unique_measure)), '') AS corr_columns
    FROM ({ROLES}) GROUP BY "table\"""",
)
def auto_plans(spark, sf):
    plans = profile.plans_from(d.columns_table(tables(spark, sf), samples=0))
    rows = [(p.table, p.should_profile, ",".join(p.id_like), ",".join(p.corr_columns)) for p in plans]
    return spark.createDataFrame(rows, "`table` string, should_profile boolean, id_like string, corr_columns string")


@query(
    "auto_profile",
    f"""SELECT "table", "column", n_missing AS missing_count FROM ({ROLES}) WHERE NOT is_key""",
)
def auto_profile(spark, sf):
    ts = tables(spark, sf)
    found, _ = profile.profile_tables(ts, profile.plans_from(d.columns_table(ts, samples=0)))
    return found.missing.select("table", "column", "missing_count")


@query(
    "join_name_clash",
    """SELECT * FROM (VALUES (0, 'clash', 'skipped: the result would have columns that clash: name_x', NULL),
    (1, 'fine', 'done', (SELECT count(*) FROM customer))) t(step, result_name, status, row_count)""",
)
def join_name_clash(spark, sf):
    customer, nation = read(spark, sf, "customer"), read(spark, sf, "nation").select("nation_key", "name")
    ts = {"customer": customer.withColumn("name_x", F.col("mktsegment")), "plain": customer, "nation": nation}
    steps = [
        joins.JoinInstruction("customer", "nation", "nation_key", "left", "clash"),
        joins.JoinInstruction("plain", "nation", "nation_key", "left", "fine"),
    ]
    return joins.run_joins(ts, steps)[1].select("step", "result_name", "status", "row_count")


@query(
    "key_cardinality",
    """SELECT 'lineitem' AS table_a, 'order_key' AS column_a, 'orders' AS table_b, 'unknown' AS cardinality,
    'many_to_one' AS cardinality_full, round((SELECT count(DISTINCT l_orderkey) FROM lineitem) / (SELECT count(*) FROM orders), 6) AS b_in_a_ratio
    UNION ALL SELECT 'orders', 'cust_key', 'customer', 'unknown', 'many_to_one',
    round((SELECT count(DISTINCT o_custkey) FROM orders) / (SELECT count(*) FROM customer), 6)
    UNION ALL SELECT 'labels', 'doc_id', 'documents', 'one_to_one', 'one_to_one',
    round((SELECT count(DISTINCT doc_id) FROM labels) / (SELECT count(*) FROM documents), 6)""",
)
def cardinality(spark, sf):
    found = d.discover(tables(spark, sf, "lineitem", "orders", "customer", "labels", "documents"), samples=0)
    return found.relationships.select(
        "table_a", "column_a", "table_b", "cardinality", "cardinality_full", rnd("b_in_a_ratio")
    )


_NAMES = _union(f"SELECT '{t}' AS t, '{plain(c, t)}' AS c" for t in ALL for c in COLUMNS[t])


@query(
    "fingerprint",
    f"""SELECT substr(sha256('{{' || string_agg(e, ',' ORDER BY t) || '}}'), 1, 16) AS schema_hash FROM
    (SELECT t, '"' || t || '":[' || string_agg('"' || c || '"', ',' ORDER BY c) || ']' AS e FROM ({_NAMES}) GROUP BY t)""",
)
def fingerprint(spark, sf):
    return d.schema_fingerprint(d.schema_columns(tables(spark, sf)))


WORDS = {
    "RETAIL": ["price", "quantity", "discount", "category", "product", "order", "customer", "revenue", "sales", "orders",
               "products", "customers", "inventory", "categories", "discounts", "returns"],
    "FINANCE": ["amount", "balance", "transaction", "account", "portfolio", "payment", "interest", "risk", "transactions",
                "accounts", "portfolios", "assets", "ledger", "invoices", "payments"],
    "SPORTS": ["player", "team", "match", "score", "goal", "season", "league", "position", "stat", "players", "matches",
               "seasons", "stats", "teams", "leagues", "performance", "fixtures"],
    "HEALTHCARE": ["patient", "diagnosis", "treatment", "medication", "encounter", "provider", "claim", "patients",
                   "diagnoses", "treatments", "prescriptions", "encounters", "providers", "claims"],
    "LOGISTICS": ["shipment", "carrier", "route", "delivery", "warehouse", "freight", "tracking", "transit", "shipments",
                  "routes", "carriers", "warehouses", "deliveries"],
}
_WORDS = _union(f"SELECT '{k}' AS domain, '{w}' AS word" for k, ws in WORDS.items() for w in ws)


@query(
    "domain_tag",
    f"""WITH v AS (SELECT domain, count(*) AS votes FROM
      (SELECT DISTINCT unnest(string_split(lower(n), '_')) AS word FROM (SELECT t AS n FROM ({_NAMES}) UNION SELECT c FROM ({_NAMES})))
      JOIN ({_WORDS}) USING (word) GROUP BY domain), r AS (SELECT * FROM v WHERE votes = (SELECT max(votes) FROM v))
    SELECT CASE WHEN count(*) = 1 THEN max(domain) ELSE 'GENERAL' END AS domain, coalesce(max(votes), 0) AS votes FROM r""",
)
def domain(spark, sf):
    return d.domain_tag(d.schema_columns(tables(spark, sf)))


# Theta sketches per column, exact counts only where the error could change a verdict: the same relationships.
@query("relationships_sketch", _relationships(_overlap_exact))
def relationships_sketch(spark, sf):
    return _tidy(d.discover(tables(spark, sf), method="sketch", samples=0).relationships)
