from __future__ import annotations

from pyspark.sql import functions as F

from tablescope.operators import joins as j, profile as p
from tablescope.operators.stats import distinct_count

from .registry import pick, query, rnd
from .views import labelled, read, sql, tables

LABELLED = (
    "(SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, l.quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id))"
)
LINE_NUMBERS = ["line_num", "quantity", "extendedprice", "discount", "tax"]


def _union(parts) -> str:
    return "\nUNION ALL ".join(parts)


# ---------------------------------------------------------------- profile


def _quartiles(source, names) -> str:
    return _union(
        f"SELECT '{c}' AS \"column\", round(quantile_cont({c}, 0.25), 4) AS q1, round(quantile_cont({c}, 0.75), 4) AS q3 FROM {source}"
        for c in names
    )


@query("quartiles", _quartiles(sql("lineitem"), LINE_NUMBERS))
def quartiles(spark, sf):
    return pick(p.quartiles(read(spark, sf, "lineitem"), LINE_NUMBERS), "column", q1=4, q3=4)


@query("quartiles_bracket", _quartiles(sql("lineitem"), LINE_NUMBERS))
def quartiles_bracket(spark, sf):
    return pick(p.quartiles(read(spark, sf, "lineitem"), LINE_NUMBERS, "exact"), "column", q1=4, q3=4)


def _outliers(source, names, skip=True) -> str:
    return _union(
        f"""SELECT '{c}' AS "column", n_rows, round(q1, 2) AS q1, round(q3, 2) AS q3, round(lo, 4) AS lower, round(hi, 4) AS upper,
        n_out AS outlier_count, round(100.0 * n_out / n_rows, 2) AS outlier_pct,
        CASE WHEN 100.0 * n_out / n_rows > 10 THEN 'high' WHEN 100.0 * n_out / n_rows > 5 THEN 'medium' ELSE 'low' END AS severity,
        coalesce(samples, '') AS sample_values FROM (
          SELECT any_value(q1) AS q1, any_value(q3) AS q3, any_value(lo) AS lo, any_value(hi) AS hi, count(*) AS n_rows,
            count_if({c} < lo OR {c} > hi) AS n_out, count(DISTINCT {c}) AS d,
            array_to_string(list_transform(list_slice(list(round({c}, 2) ORDER BY greatest(lo - {c}, {c} - hi) DESC, {c})
              FILTER ({c} < lo OR {c} > hi), 1, 5), lambda x: CAST(x AS VARCHAR)), '|') AS samples
          FROM (SELECT {c}::DOUBLE AS {c} FROM {source}), (SELECT q1, q3, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM
            (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM {source}))) WHERE {'d >= 20' if skip else 'true'}"""
        for c in names
    )


def _tidy_outliers(df):
    samples = F.array_join(F.transform("sample_values", lambda v: F.round(v, 2).cast("string")), "|").alias("sample_values")
    return df.select(
        "column", "n_rows", "q1", "q3", rnd("lower", 4), rnd("upper", 4), "outlier_count", "outlier_pct", "severity", samples
    )


@query("outlier_report", _outliers(sql("lineitem"), LINE_NUMBERS))
def outlier_report(spark, sf):
    plan = p.TablePlan("lineitem", exclude=["order_key", "part_key", "supp_key"])
    return _tidy_outliers(p.outlier_report(p.drop_planned(read(spark, sf, "lineitem"), plan)))


@query("detect_outliers", _outliers("events", ["value"]))
def detect_outliers(spark, sf):
    return _tidy_outliers(p.detect_outliers(read(spark, sf, "events"), "value"))


@query("outlier_report_bracket", _outliers("documents", ["n_chars"], skip=False))
def outlier_report_bracket(spark, sf):
    return _tidy_outliers(p.outlier_report(read(spark, sf, "documents"), ["n_chars"], False, method="exact"))


DOC_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars", "quality", "toxic"]
MISSING = _union(
    f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS missing_count, round(100.0 * (count(*) - count({c})) / count(*), 2) AS missing_pct, "
    f"100.0 * (count(*) - count({c})) / count(*) > 50 AS critical FROM {LABELLED}"
    for c in DOC_COLUMNS
)


@query("missing_report", MISSING)
def missing_report(spark, sf):
    return p.missing_report(labelled(spark, sf))


@query(
    "missing_total",
    f"""SELECT CAST(sum(missing_count) AS BIGINT) AS total_missing,
    coalesce(string_agg("column", ',' ORDER BY "column") FILTER (critical), '') AS critical_columns FROM ({MISSING})""",
)
def missing_total(spark, sf):
    return p.missing_total(p.missing_report(labelled(spark, sf))).select(
        "total_missing", F.array_join("critical_columns", ",").alias("critical_columns")
    )


def _corr(source, names, extra="") -> str:
    return _union(
        f"SELECT {extra}'{a}' AS col_x, '{b}' AS col_y, round(corr({a}, {b}), 6) AS r, count(CASE WHEN {a} IS NOT NULL AND {b} IS NOT NULL THEN 1 END) AS n FROM {source}"
        for i, a in enumerate(names)
        for b in names[i + 1 :]
    )


LINE_ALL = ["order_key", "part_key", "supp_key", *LINE_NUMBERS]
DOC_NUMBERS = ["doc_id", "n_chars", "quality", "toxic"]


@query("correlations", _corr(sql("lineitem"), LINE_ALL))
def correlations(spark, sf):
    return pick(p.correlations(read(spark, sf, "lineitem")), "col_x", "col_y", "n", r=6)


@query("correlations_pairwise", _corr(LABELLED, DOC_NUMBERS))
def correlations_pairwise(spark, sf):
    return pick(p.correlations(labelled(spark, sf)), "col_x", "col_y", "n", r=6)


@query(
    "correlation_matrix",
    _union(
        f"SELECT '{a}' AS col_x, '{b}' AS col_y, round(corr({a}, {b}), 6) AS r, count(CASE WHEN {a} IS NOT NULL AND {b} IS NOT NULL THEN 1 END) AS n FROM {LABELLED}"
        for a in ("n_chars", "quality", "toxic")
        for b in ("n_chars", "quality", "toxic")
    ),
)
def correlation_matrix(spark, sf):
    plan = p.TablePlan("d", id_like=["doc_id"], corr_columns=["n_chars", "quality", "toxic", "doc_id"])
    df = p.drop_planned(labelled(spark, sf), plan)
    return pick(p.correlations(df, p.correlation_columns(df, plan), matrix=True), "col_x", "col_y", "n", r=6)


@query("pair_correlation", _corr("part", ["p_size", "p_retailprice"]).replace("'p_", "'"))
def pair_correlation(spark, sf):
    return pick(p.pair_correlation(read(spark, sf, "part"), "size", "retailprice"), "col_x", "col_y", "n", r=6)


def _facts(table, source, outlier_names, all_names, corr_names) -> str:
    parts = [
        f"""SELECT '{table}' AS "table", "column", NULL AS column2, unnest(['q1', 'q3', 'outlier_count', 'outlier_pct']) AS metric,
        unnest([q1, q3, outlier_count::DOUBLE, outlier_pct]) AS value FROM ({_outliers(source, outlier_names)})"""
    ]
    parts += [
        f"""SELECT '{table}' AS "table", '{c}' AS "column", NULL AS column2, unnest(['missing_count', 'missing_pct']) AS metric,
        unnest([(count(*) - count({c}))::DOUBLE, round(100.0 * (count(*) - count({c})) / count(*), 2)]) AS value FROM {source}"""
        for c in all_names
    ]
    parts += [
        f"""SELECT '{table}' AS "table", '{a}' AS "column", '{b}' AS column2, 'correlation' AS metric, corr({a}, {b}) AS value FROM {source}"""
        for i, a in enumerate(corr_names)
        for b in corr_names[i + 1 :]
    ]
    return _union(parts)


LINE_REST = [*LINE_NUMBERS, "returnflag", "linestatus", "shipdate"]
FACTS = _union(
    [
        _facts("lineitem", sql("lineitem"), LINE_NUMBERS, LINE_REST, ["quantity", "extendedprice", "discount"]),
        _facts("docs", LABELLED, ["doc_id", "n_chars", "quality", "toxic"], DOC_COLUMNS, DOC_NUMBERS),
    ]
)
PLANS = [
    p.TablePlan("lineitem", id_like=["order_key", "part_key", "supp_key"], corr_columns=["quantity", "extendedprice", "discount"]),
    p.TablePlan("docs"),
    p.TablePlan("events", should_profile=False),
    p.TablePlan("absent"),
]


def profiled(spark, sf):
    ts = tables(spark, sf, "lineitem", "events")
    ts["docs"] = labelled(spark, sf)
    return p.profile_tables(ts, PLANS)[0]


@query("profile_tables", f'SELECT "table", "column", column2, metric, round(value, 5) AS value FROM ({FACTS})')
def profile_tables(spark, sf):
    from tablescope.operators.audit import profile_facts

    return pick(profile_facts(profiled(spark, sf)), "table", "column", "column2", "metric", value=5)


@query(
    "profile_modes",
    f"""SELECT 'joined' AS mode, 'docs' AS "table", CAST(sum(missing_count) AS BIGINT) AS total_missing FROM ({MISSING})
    UNION ALL SELECT 'separate', 'lineitem', 0""",
)
def profile_modes(spark, sf):
    ts = tables(spark, sf, "lineitem")
    ts["docs"] = labelled(spark, sf)
    out = None
    for mode in ("joined", "separate"):
        part = p.profile_tables(ts, PLANS, results={"docs"}, mode=mode)[0].missing_total
        part = part.select(F.lit(mode).alias("mode"), "table", "total_missing")
        out = part if out is None else out.unionAll(part)
    return out


@query(
    "full_profile",
    f"""SELECT "column", outlier_count, outlier_pct, severity FROM ({_outliers(sql('orders'), ['order_key', 'cust_key', 'totalprice'])})""",
)
def full_profile(spark, sf):
    return p.full_profile(read(spark, sf, "orders")).outliers.select("column", "outlier_count", "outlier_pct", "severity")


@query(
    "subgroup_describe",
    _union(
        f"""SELECT '{c}' AS "column", count({c}) AS count, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std, min({c})::DOUBLE AS min,
        round(quantile_cont({c}, 0.25), 4) AS q25, round(quantile_cont({c}, 0.5), 4) AS q50, round(quantile_cont({c}, 0.75), 4) AS q75, max({c})::DOUBLE AS max
        FROM {sql('lineitem')} WHERE returnflag = 'R'"""
        for c in ("quantity", "extendedprice")
    ),
)
def subgroup_describe(spark, sf):
    df = p.subgroup_describe(read(spark, sf, "lineitem"), F.col("returnflag") == "R", ["quantity", "extendedprice"])
    return pick(df, "column", "count", "min", "max", mean=4, std=4, q25=4, q50=4, q75=4)


@query(
    "distinct_count",
    "SELECT count(*) AS n_rows, count(DISTINCT user_id) AS user_id, count(DISTINCT value) AS value, count(DISTINCT props) AS props FROM events",
)
def distinct(spark, sf):
    return distinct_count(read(spark, sf, "events"), "user_id", "value", "props")


# ---------------------------------------------------------------- joins

# Some keys are missing on both sides.
ORDERS = f"(SELECT * REPLACE (CASE WHEN order_key % 97 = 0 THEN NULL ELSE cust_key END AS cust_key) FROM {sql('orders')})"
CUSTOMER = f"(SELECT * REPLACE (CASE WHEN cust_key % 50 < 2 THEN NULL ELSE cust_key END AS cust_key) FROM {sql('customer')})"


def _sides(spark, sf):
    o = read(spark, sf, "orders").withColumn("cust_key", F.when(F.col("order_key") % 97 != 0, F.col("cust_key")))
    c = read(spark, sf, "customer").withColumn("cust_key", F.when(F.col("cust_key") % 50 >= 2, F.col("cust_key")))
    return o, c.withColumn("orderstatus", F.col("mktsegment"))


def _join_sql(how, null_keys="match", orders=ORDERS, customer=CUSTOMER) -> str:
    same = "IS NOT DISTINCT FROM" if null_keys == "match" else "="
    key = "coalesce(o.cust_key, c.cust_key)" if how == "FULL" else "o.cust_key"
    return f"""SELECT {key} AS cust_key, o.order_key, o.orderstatus AS orderstatus_x, c.name, c.mktsegment AS orderstatus_y
    FROM {orders} o {how} JOIN {customer} c ON o.cust_key {same} c.cust_key"""


def _tidy_join(df):
    return df.select("cust_key", "order_key", "orderstatus_x", "name", "orderstatus_y")


@query("join_inner", _join_sql("INNER"))
def join_inner(spark, sf):
    return _tidy_join(j.merge(*_sides(spark, sf), "cust_key", "inner"))


@query("join_left", _join_sql("LEFT"))
def join_left(spark, sf):
    return _tidy_join(j.merge(*_sides(spark, sf), "cust_key", "left"))


@query("join_outer", _join_sql("FULL"))
def join_outer(spark, sf):
    return _tidy_join(j.merge(*_sides(spark, sf), "cust_key", "outer"))


@query("join_drop_nulls", _join_sql("FULL", "drop"))
def join_drop_nulls(spark, sf):
    return _tidy_join(j.merge(*_sides(spark, sf), "cust_key", "outer", null_keys="drop"))


# A third of all orders belong to one customer, and keys are missing on both sides.
HOT_ORDERS = f"(SELECT * REPLACE (CASE WHEN order_key % 3 = 0 THEN 77 WHEN order_key % 97 = 1 THEN NULL ELSE cust_key END AS cust_key) FROM {sql('orders')})"


def _hot_sides(spark, sf):
    k = F.col("order_key")
    o = read(spark, sf, "orders").withColumn(
        "cust_key", F.when(k % 3 == 0, 77).when(k % 97 == 1, None).otherwise(F.col("cust_key"))
    )
    return o, _sides(spark, sf)[1]


def _hot(how, name, flip=False):
    if flip:
        sql_text = f"""SELECT {'coalesce(c.cust_key, o.cust_key)' if how == 'FULL' else 'c.cust_key'} AS cust_key, o.order_key, o.orderstatus AS orderstatus_x, c.name,
        c.mktsegment AS orderstatus_y FROM {CUSTOMER} c {how} JOIN {HOT_ORDERS} o ON o.cust_key IS NOT DISTINCT FROM c.cust_key"""
    else:
        sql_text = _join_sql(how, orders=HOT_ORDERS)

    @query(name, sql_text)
    def run(spark, sf):
        o, c = _hot_sides(spark, sf)
        kind = {"INNER": "inner", "LEFT": "left", "FULL": "outer"}[how]
        look = "auto" if kind == "outer" else "split"  # the sides are small enough to be broadcast, where that is possible
        if not flip:
            return _tidy_join(j.merge(o, c, "cust_key", kind, skew=look, rows_per_task=200))
        return j.merge(c, o, "cust_key", kind, skew=look, rows_per_task=200).select(
            "cust_key", "order_key", F.col("orderstatus_y").alias("orderstatus_x"), "name", F.col("orderstatus_x").alias("orderstatus_y")
        )

    return run


_hot("INNER", "join_inner_hot_key")
_hot("LEFT", "join_left_hot_key")
_hot("FULL", "join_outer_hot_key")
_hot("LEFT", "join_left_hot_right", flip=True)
_hot("FULL", "join_outer_hot_right", flip=True)

STEPS = [
    j.JoinInstruction("lineitem", "orders", "order_key", "left", "line_orders"),
    j.JoinInstruction("line_orders", "customer", "cust_key", "inner", "line_customers"),
    j.JoinInstruction("line_orders", "nowhere", "order_key", "inner", "x1"),
    j.JoinInstruction("orders", "customer", "name", "inner", "x2"),
    j.JoinInstruction("nation", "region", "region_key", "outer", "places"),
    j.JoinInstruction("nation", "named", "name", "inner", "x3"),
]


def _ran(spark, sf, count_rows):
    ts = tables(spark, sf, "lineitem", "orders", "customer", "nation", "region")
    ts["named"] = read(spark, sf, "region").select(F.col("region_key").alias("name"))
    return j.run_joins(ts, STEPS, count_rows=count_rows)


CHAIN = "lineitem LEFT JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey"


@query(
    "join_chain",
    f"""SELECT c_mktsegment AS mktsegment, o_orderpriority AS orderpriority, count(*) AS n,
    CAST(sum(l_extendedprice::DECIMAL(18,2)) AS DOUBLE) AS total FROM {CHAIN} GROUP BY ALL""",
)
def join_chain(spark, sf):
    out, _ = _ran(spark, sf, False)
    return out["line_customers"].groupBy("mktsegment", "orderpriority").agg(
        F.count("*").alias("n"), F.sum(F.col("extendedprice").cast("decimal(18,2)")).cast("double").alias("total")
    )


@query(
    "join_log",
    f"""SELECT * FROM (VALUES (0, 'line_orders', 'done', (SELECT count(*) FROM lineitem), 0), (1, 'line_customers', 'done', (SELECT count(*) FROM {CHAIN}), 0),
    (2, 'x1', 'skipped: no such table', NULL, NULL), (3, 'x2', 'skipped: no such column', NULL, NULL), (4, 'places', 'done', (SELECT count(*) FROM nation), 0),
    (5, 'x3', 'skipped: key ''name'' has incompatible types', NULL, NULL)) t(step, result_name, status, row_count, null_key_rows)""",
)
def join_log(spark, sf):
    return _ran(spark, sf, True)[1].select("step", "result_name", "status", "row_count", "null_key_rows")


@query(
    "zero_activity",
    f"SELECT order_key, totalprice FROM {sql('orders')} WHERE order_key NOT IN (SELECT l_orderkey FROM lineitem)",
)
def zero_activity(spark, sf):
    return j.zero_activity(read(spark, sf, "orders"), read(spark, sf, "lineitem"), "order_key").select("order_key", "totalprice")


@query(
    "zero_value",
    f"""SELECT order_key FROM {sql('orders')} LEFT JOIN (SELECT l_orderkey, sum(l_discount) AS d FROM lineitem GROUP BY ALL) ON l_orderkey = order_key
    WHERE coalesce(d, 0) = 0""",
)
def zero_value(spark, sf):
    return j.zero_activity(read(spark, sf, "orders"), read(spark, sf, "lineitem"), "order_key", "discount").select("order_key")


# Thousands of keys over the target: every order with more than four lines is spread.
@query(
    "join_many_hot_keys",
    """SELECT l.l_orderkey AS order_key, l.l_linenumber AS line_num, o.o_custkey AS cust_key, o.o_orderstatus AS orderstatus
    FROM lineitem l JOIN orders o ON l.l_orderkey IS NOT DISTINCT FROM o.o_orderkey""",
)
def join_many_hot_keys(spark, sf):
    lines = read(spark, sf, "lineitem").select("order_key", "line_num")
    orders = read(spark, sf, "orders").select("order_key", "cust_key", "orderstatus")
    return j.merge(lines, orders, "order_key", "inner", skew="split", rows_per_task=4)


# A side of key and text only, with a third of its rows on one key: the text tells its rows apart.
@query(
    "join_key_text_only",
    """SELECT d.doc_key, length(d.text) AS n_chars, l.quality
    FROM (SELECT CASE WHEN doc_id % 3 = 0 THEN 7 ELSE doc_id END AS doc_key, text FROM documents) d
    LEFT JOIN (SELECT doc_id AS doc_key, quality FROM labels) l ON d.doc_key IS NOT DISTINCT FROM l.doc_key""",
)
def join_key_text_only(spark, sf):
    docs = read(spark, sf, "documents")
    docs = docs.select(F.when(F.col("doc_id") % 3 == 0, F.lit(7).cast("long")).otherwise(F.col("doc_id")).alias("doc_key"), "text")
    labels = read(spark, sf, "labels").select(F.col("doc_id").alias("doc_key"), "quality")
    joined = j.merge(docs, labels, "doc_key", "left", skew="split", rows_per_task=20)
    return joined.select("doc_key", F.length("text").alias("n_chars"), "quality")


# Two hundred columns derived from lineitem, some missing where others are not: 19,900 pairs from one scan.
WIDE = 200


def _wide_expr(i: int) -> str:
    return f"CASE WHEN (l_orderkey + {i}) % 11 = 0 THEN NULL ELSE CAST((l_orderkey * {i + 3} + l_partkey * {i % 7 + 1}) % {50 + i} + l_quantity AS DOUBLE) END"


def _wide_sql() -> str:
    cells = ", ".join(
        f"{{'col_x': 'w{a}', 'col_y': 'w{b}', 'r': round(corr(w{a}, w{b}), 6), 'n': count(CASE WHEN w{a} IS NOT NULL AND w{b} IS NOT NULL THEN 1 END)}}"
        for a in range(WIDE)
        for b in range(a + 1, WIDE)
    )
    source = f"(SELECT {', '.join(f'{_wide_expr(i)} AS w{i}' for i in range(WIDE))} FROM lineitem)"
    return f"SELECT unnest(cells, recursive := true) FROM (SELECT [{cells}] AS cells FROM {source})"


@query("correlations_wide", _wide_sql())
def correlations_wide(spark, sf):
    raw = spark.read.parquet(f"{sf}/lineitem.parquet")
    df = raw.select(*[F.expr(_wide_expr(i)).alias(f"w{i}") for i in range(WIDE)])
    return pick(p.correlations(df), "col_x", "col_y", "n", r=6)
