from __future__ import annotations

from pyspark.sql import functions as F

from tablescope.operators import concentration as k, nulls, paradox, rates, segments, sequence, shape

from .profiling import LABELLED, LINE_ALL
from .registry import pick, query, rnd
from .views import labelled, read, sql


def _union(parts) -> str:
    return "\nUNION ALL ".join(parts)


def money():
    return F.col("totalprice").cast("decimal(18,2)")


BY_CUSTOMER = "SELECT o_custkey AS entity, sum(o_totalprice::DECIMAL(18,2)) AS value FROM orders GROUP BY ALL"
RANKED = f"""SELECT *, row_number() OVER (ORDER BY value DESC, entity) AS k, sum(value) OVER (ORDER BY value DESC, entity) AS upto,
 sum(value) OVER () AS total, count(*) OVER () AS n FROM ({BY_CUSTOMER})"""

# ---------------------------------------------------------------- concentration


@query(
    "pareto",
    f"""SELECT any_value(n) AS n_entities, any_value(total)::DOUBLE AS total, 0.8::DOUBLE AS goal, min(k) FILTER (upto >= 0.8 * total) AS k,
    round(min(k) FILTER (upto >= 0.8 * total) / any_value(n), 6) AS k_share, 0.2::DOUBLE AS top, CAST(ceil(0.2 * any_value(n)) AS BIGINT) AS k_top,
    round(max(upto) FILTER (k = ceil(0.2 * n))::DOUBLE / any_value(total)::DOUBLE, 6) AS top_share,
    max(upto) FILTER (k = ceil(0.2 * n))::DOUBLE / any_value(total)::DOUBLE >= 0.8 AS concentrated FROM ({RANKED})""",
)
def pareto(spark, sf):
    df = k.pareto(read(spark, sf, "orders"), "cust_key", money())
    return pick(df, "n_entities", "total", "goal", "k", "top", "k_top", "concentrated", k_share=6, top_share=6)


@query(
    "pareto_tiers",
    f"""SELECT entity, value::DOUBLE AS value, round((upto / total)::DOUBLE, 6) AS cum_share,
    CASE WHEN upto - value < 0.8 * total THEN 'High' WHEN upto - value < 0.95 * total THEN 'Mid' ELSE 'Tail' END AS tier FROM ({RANKED})""",
)
def pareto_tiers(spark, sf):
    df = k.pareto_tiers(read(spark, sf, "orders"), "cust_key", money())
    return df.select("entity", F.col("value").cast("double").alias("value"), rnd("cum_share"), "tier")


@query(
    "top_n_share",
    _union(
        f"""SELECT {n} AS n, round(sum(value) FILTER (k <= {n})::DOUBLE, 2) AS top_sum, any_value(total)::DOUBLE AS total,
        round(sum(value) FILTER (k <= {n})::DOUBLE / any_value(total)::DOUBLE, 6) AS share, {x}::DOUBLE AS "limit",
        sum(value) FILTER (k <= {n})::DOUBLE / any_value(total)::DOUBLE > {x} AS flagged FROM ({RANKED})"""
        for n, x in ((1, 0.2), (3, 0.4), (5, 0.5))
    ),
)
def top_n_share(spark, sf):
    df = k.top_n_share(read(spark, sf, "orders"), "cust_key", money())
    return pick(df, "n", "total", "limit", "flagged", top_sum=2, share=6)


@query(
    "top_n_share_category",
    """SELECT 1 AS n, round(max(v), 2) AS top_sum, round(sum(v), 2) AS total, round(max(v) / sum(v), 6) AS share, 0.15::DOUBLE AS "limit",
    max(v) / sum(v) > 0.15 AS flagged FROM (SELECT p_type, sum(p_retailprice) AS v FROM part GROUP BY ALL)""",
)
def top_n_share_category(spark, sf):
    df = k.top_n_share(read(spark, sf, "part"), "type", "retailprice", {1: 0.15})
    return pick(df, "n", "limit", "flagged", top_sum=2, total=2, share=6)


@query(
    "top_fraction_share",
    f"""SELECT any_value(n) AS n_entities, 0.1::DOUBLE AS fraction, CAST(ceil(0.1 * any_value(n)) AS BIGINT) AS k,
    round(max(upto) FILTER (k = ceil(0.1 * n))::DOUBLE / any_value(total)::DOUBLE, 6) AS share, 0.6::DOUBLE AS "limit",
    max(upto) FILTER (k = ceil(0.1 * n))::DOUBLE / any_value(total)::DOUBLE > 0.6 AS flagged FROM ({RANKED})""",
)
def top_fraction_share(spark, sf):
    df = k.top_fraction_share(read(spark, sf, "orders"), "cust_key", money())
    return pick(df, "n_entities", "fraction", "k", "limit", "flagged", share=6)


@query(
    "top_rows_share",
    """SELECT 20 AS n, round(sum(v) FILTER (r <= 20), 2) AS top_sum, round(sum(v), 2) AS total, round(sum(v) FILTER (r <= 20) / sum(v), 8) AS share
    FROM (SELECT l_extendedprice AS v, row_number() OVER (ORDER BY l_extendedprice DESC) AS r FROM lineitem)""",
)
def top_rows_share(spark, sf):
    return pick(k.top_rows_share(read(spark, sf, "lineitem"), "extendedprice"), "n", top_sum=2, total=2, share=8)


@query("group_sum", "SELECT o_orderpriority AS orderpriority, sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS total FROM orders GROUP BY ALL")
def group_sum(spark, sf):
    df = k.group_sum(read(spark, sf, "orders"), "orderpriority", money())
    return df.select("orderpriority", F.col("total").cast("double").alias("total"))


# ---------------------------------------------------------------- shape

SHIFTED = "CASE WHEN event_type IN ('click', 'view') THEN value + 300 ELSE value END"


def _bimodal(source: str, label: str) -> str:
    """``source`` gives a column v."""
    return f"""(WITH s AS (SELECT v FROM ({source})),
b AS (SELECT quantile_cont(v, 0.005) AS lo, quantile_cont(v, 0.995) AS hi, count(v) AS n, count(DISTINCT v) AS d, avg(v) AS m, stddev_pop(v) AS sp, kurtosis_pop(v) AS ku FROM s),
k AS (SELECT avg(pow((v - m) / sp, 3)) AS sk FROM s, b),
h AS (SELECT least(CAST(floor((v - lo) / (hi - lo) * 64) AS BIGINT), 63) AS bin, count(*) AS c FROM s, b WHERE v BETWEEN lo AND hi GROUP BY ALL),
f AS (SELECT i, coalesce(c, 0) AS c FROM generate_series(0, 63) g(i) LEFT JOIN h ON bin = i),
m AS (SELECT i, avg(c) OVER (ORDER BY i ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS y FROM f),
p AS (SELECT *, lag(y) OVER (ORDER BY i) AS before, lead(y) OVER (ORDER BY i) AS after, max(y) OVER () AS top FROM m),
x AS (SELECT i, y FROM p WHERE y >= 0.1 * top AND (before IS NULL OR y > before) AND (after IS NULL OR y >= after)),
q AS (SELECT a.i AS i, b.i AS j, least(a.y, b.y) AS low FROM x a JOIN x b ON a.i < b.i
  WHERE (SELECT min(y) FROM m WHERE m.i BETWEEN a.i AND b.i) <= 0.5 * least(a.y, b.y)),
w AS (SELECT * FROM q ORDER BY low DESC, i, j LIMIT 1)
SELECT '{label}' AS label, n, round(sk, 4) AS skewness, round(ku, 4) AS kurtosis, round((sk * sk + 1) / (ku + 3), 4) AS sarle,
 CASE WHEN n >= 640 AND d >= 20 THEN i IS NOT NULL END AS bimodal, round(lo + (i + 0.5) * ((hi - lo) / 64), 4) AS low_peak,
 round(lo + (j + 0.5) * ((hi - lo) / 64), 4) AS high_peak FROM b CROSS JOIN k LEFT JOIN w ON n >= 640 AND d >= 20)"""


@query(
    "bimodality",
    _union(
        [
            _bimodal(f"SELECT {SHIFTED} AS v FROM events", "shifted"),
            _bimodal("SELECT value AS v FROM events", "plain"),
            _bimodal("SELECT l_extendedprice AS v FROM lineitem", "extendedprice"),
            _bimodal("SELECT l_discount AS v FROM lineitem", "discount"),
        ]
    ),
)
def bimodality(spark, sf):
    e, line = read(spark, sf, "events"), read(spark, sf, "lineitem")
    shifted = F.when(F.col("event_type").isin("click", "view"), F.col("value") + 300).otherwise(F.col("value"))
    out = None
    for label, df, value in (
        ("shifted", e, shifted), ("plain", e, "value"), ("extendedprice", line, "extendedprice"), ("discount", line, "discount"),
    ):
        one = shape.bimodality(df, value).withColumn("label", F.lit(label))
        out = one if out is None else out.unionAll(one)
    return pick(out, "label", "n", "bimodal", skewness=4, kurtosis=4, sarle=4, low_peak=4, high_peak=4)


MEASURES = {"line_num": "l_linenumber", "quantity": "l_quantity", "extendedprice": "l_extendedprice", "discount": "l_discount", "tax": "l_tax"}


@query("bimodality_all", _union([_bimodal(f"SELECT {c} AS v FROM lineitem", label) for label, c in MEASURES.items()]))
def bimodality_all(spark, sf):
    out = shape.bimodality_of(read(spark, sf, "lineitem"), {label: label for label in MEASURES})
    return pick(out, "label", "n", "bimodal", skewness=4, kurtosis=4, sarle=4, low_peak=4, high_peak=4)

@query(
    "two_mode_split",
    f"""WITH s AS (SELECT {SHIFTED} AS v FROM events), e AS (SELECT min(v) AS lo, max(v) AS hi FROM s),
    t AS (SELECT v, least(CAST(floor((v - lo) / (hi - lo) * 256) AS BIGINT), 255) AS bin FROM s, e),
    h AS (SELECT bin, count(*) AS n, sum(v) AS total FROM t GROUP BY ALL),
    c AS (SELECT bin, sum(n) OVER (ORDER BY bin) AS n0, sum(total) OVER (ORDER BY bin) AS s0, sum(n) OVER () AS n, sum(total) OVER () AS s FROM h),
    b AS (SELECT bin AS cut FROM c WHERE n > n0 ORDER BY n0::DOUBLE * (n - n0)::DOUBLE * pow(s0 / n0 - (s - s0) / (n - n0), 2) DESC, bin LIMIT 1)
    SELECT round(any_value(lo + (cut + 1) * (hi - lo) / 256), 4) AS threshold, count_if(bin <= cut) AS low_n, count_if(bin > cut) AS high_n,
    round(avg(v) FILTER (bin <= cut), 4) AS low_center, round(avg(v) FILTER (bin > cut), 4) AS high_center,
    round(count_if(bin <= cut) / count(*), 6) AS low_volume_share, round(count_if(bin > cut) / count(*), 6) AS high_volume_share,
    round(sum(v) FILTER (bin <= cut) / sum(v), 6) AS low_value_share, round(sum(v) FILTER (bin > cut) / sum(v), 6) AS high_value_share,
    round(avg(v) FILTER (bin > cut) - avg(v) FILTER (bin <= cut), 4) AS gap FROM t, b, e""",
)
def two_mode_split(spark, sf):
    shifted = F.when(F.col("event_type").isin("click", "view"), F.col("value") + 300).otherwise(F.col("value"))
    df = shape.two_mode_split(read(spark, sf, "events"), shifted)
    return pick(
        df, "low_n", "high_n", threshold=4, low_center=4, high_center=4, low_volume_share=6, high_volume_share=6,
        low_value_share=6, high_value_share=6, gap=4,
    )


# ---------------------------------------------------------------- paradoxes

RULES = [("quantity", "extendedprice", -1), ("quantity", "discount", 1), ("extendedprice", "quantity", 1)]


@query(
    "direction_paradox",
    _union(
        f"""SELECT '{x}' AS col_x, '{y}' AS col_y, {s} AS expected_sign, round(corr({x}, {y}), 6) AS r, count(*) AS n,
        abs(corr({x}, {y})) >= 0.1 AND sign(corr({x}, {y})) <> {s} AS paradox FROM {sql('lineitem')}"""
        for x, y, s in RULES
    ),
)
def direction_paradox(spark, sf):
    df = paradox.direction_paradox(read(spark, sf, "lineitem"), RULES)
    return pick(df, "col_x", "col_y", "expected_sign", "n", "paradox", r=6)


# Prices fall with quantity inside a part size class, while larger classes have more of both.
MIXED = "l_partkey % 5 * 20000 - l_extendedprice / 10"


@query(
    "segment_reversal",
    f"""WITH s AS (SELECT l_partkey % 5 AS segment, l_quantity + l_partkey % 5 * 40 AS x, {MIXED} AS y FROM lineitem), o AS (SELECT corr(x, y) AS r FROM s)
    SELECT segment, count(*) AS n, round(corr(x, y), 6) AS r, round(any_value(o.r), 6) AS overall_r,
    abs(corr(x, y)) >= 0.1 AND abs(any_value(o.r)) >= 0.1 AND sign(corr(x, y)) <> sign(any_value(o.r)) AS reversed FROM s, o GROUP BY segment""",
)
def segment_reversal(spark, sf):
    line = read(spark, sf, "lineitem").withColumn("segment", F.col("part_key") % 5)
    x = F.col("quantity") + F.col("segment") * 40
    y = F.col("segment") * 20000 - F.col("extendedprice") / 10
    return pick(paradox.segment_reversal(line, x, y, "segment"), "segment", "n", "reversed", r=6, overall_r=6)


@query(
    "rank_inversion",
    """WITH p AS (SELECT l_suppkey AS entity, sum(l_quantity) AS volume, round(avg(l_discount), 8) AS quality FROM lineitem GROUP BY ALL),
    l AS (SELECT * FROM p ORDER BY volume DESC, entity LIMIT 1)
    SELECT l.entity AS leader, l.volume, l.quality, (SELECT count(*) FROM p) AS n_entities, (SELECT count(*) + 1 FROM p WHERE quality > l.quality) AS quality_rank,
    (SELECT count(*) FROM p WHERE quality > l.quality) > 0 AS inverted,
    (SELECT count(*) FROM p WHERE quality <= l.quality) = 1 AND (SELECT count(*) FROM p) > 1 AS worst FROM l""",
)
def rank_inversion(spark, sf):
    return paradox.rank_inversion(
        read(spark, sf, "lineitem"), "supp_key", F.sum("quantity"), F.round(F.avg("discount"), 8)
    )


# ---------------------------------------------------------------- rates


@query(
    "volatility",
    _union(
        f"SELECT '{c}' AS \"column\", round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, round(stddev_samp({c}) / avg({c}), 6) AS cv FROM {sql('lineitem')}"
        for c in ("quantity", "extendedprice", "discount")
    ),
)
def volatility(spark, sf):
    df = rates.volatility(read(spark, sf, "lineitem"), ["quantity", "extendedprice", "discount"])
    return pick(df, "column", mean=6, std=6, cv=6)


@query(
    "volatility_by",
    """SELECT event_type, 'value' AS "column", round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std,
    round(stddev_samp(value) / avg(value), 6) AS cv FROM events GROUP BY ALL""",
)
def volatility_by(spark, sf):
    return pick(rates.volatility(read(spark, sf, "events"), ["value"], "event_type"), "event_type", "column", mean=6, std=6, cv=6)


NET = "l_extendedprice * (1 - l_discount)"


def net():
    return F.col("extendedprice") * (1 - F.col("discount"))


@query(
    "rate_tiers",
    f"""SELECT l_discount AS rate, count(*) AS n, sum(l_quantity) AS volume, round(sum({NET}), 2) AS net, round(sum({NET}) / count(*), 4) AS net_per_row
    FROM lineitem GROUP BY ALL""",
)
def rate_tiers(spark, sf):
    return pick(rates.rate_tiers(read(spark, sf, "lineitem"), "discount", "quantity", net()), "rate", "n", "volume", net=2, net_per_row=4)


@query(
    "rate_tiers_cut",
    f"""WITH r AS (SELECT l_extendedprice / l_quantity AS rate, l_quantity AS v, {NET} AS w FROM lineitem),
    c AS (SELECT quantile_cont(rate, [0.2, 0.4, 0.6, 0.8]) AS q FROM r)
    SELECT (rate > q[1])::INT + (rate > q[2])::INT + (rate > q[3])::INT + (rate > q[4])::INT AS tier, count(*) AS n, round(min(rate), 6) AS rate_low,
    round(max(rate), 6) AS rate_high, round(sum(v), 2) AS volume, round(sum(w), 2) AS net FROM r, c GROUP BY ALL""",
)
def rate_tiers_cut(spark, sf):
    unit = F.col("extendedprice") / F.col("quantity")
    found = rates.rate_tiers(read(spark, sf, "lineitem"), unit, "quantity", net(), tiers=5)
    return pick(found, "tier", "n", rate_low=6, rate_high=6, volume=2, net=2)


@query(
    "rate_response",
    f"""WITH t AS (SELECT l_discount AS rate, sum({NET}) / count(*) AS per FROM lineitem GROUP BY ALL)
    SELECT round(corr(l_discount, l_quantity), 6) AS r_volume, round(corr(l_discount, {NET}), 6) AS r_net,
    (SELECT rate FROM t ORDER BY per DESC, rate LIMIT 1) AS sweet_spot, round((SELECT max(per) FROM t), 4) AS best_net_per_row,
    corr(l_discount, l_quantity) > 0 AND corr(l_discount, {NET}) < 0 AS inverted FROM lineitem""",
)
def rate_response(spark, sf):
    df = rates.rate_response(read(spark, sf, "lineitem"), "discount", "quantity", net())
    return pick(df, "sweet_spot", "inverted", r_volume=6, r_net=6, best_net_per_row=4)


@query(
    "category_overindex",
    """WITH c AS (SELECT c_mktsegment AS segment, o_orderpriority AS category, sum(o_totalprice) AS value FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL)
    SELECT segment, category, round(value, 2) AS value, round(value / sum(value) OVER (PARTITION BY segment), 6) AS share,
    round(sum(value) OVER (PARTITION BY category) / sum(value) OVER (), 6) AS overall_share,
    round((value / sum(value) OVER (PARTITION BY segment)) / (sum(value) OVER (PARTITION BY category) / sum(value) OVER ()), 6) AS index,
    sum(value) OVER (PARTITION BY category) / sum(value) OVER () > 0.5 AS dependency_risk FROM c""",
)
def category_overindex(spark, sf):
    o = read(spark, sf, "orders").join(read(spark, sf, "customer"), "cust_key")
    df = rates.category_overindex(o, "mktsegment", "orderpriority", "totalprice")
    return pick(df, "segment", "category", "dependency_risk", value=2, share=6, overall_share=6, index=6)


@query(
    "seasonal_spikes",
    """WITH m AS (SELECT date_trunc('month', l_shipdate)::DATE AS month, sum(l_extendedprice * CASE WHEN month(l_shipdate) = 12 THEN 3 ELSE 1 END) AS total FROM lineitem GROUP BY ALL)
    SELECT month, round(total, 2) AS total, round((SELECT avg(total) + 2 * stddev_samp(total) FROM m), 4) AS "limit",
    total > (SELECT avg(total) + 2 * stddev_samp(total) FROM m) AS spike FROM m""",
)
def seasonal_spikes(spark, sf):
    value = F.col("extendedprice") * F.when(F.month("shipdate") == 12, 3).otherwise(1)
    return pick(rates.seasonal_spikes(read(spark, sf, "lineitem"), "shipdate", value), "month", "spike", total=2, limit=4)


# ---------------------------------------------------------------- sequences


@query(
    "recent_form",
    """WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events)
    SELECT user_id AS entity, count(*) AS n, count_if(k <= 5) AS recent_n, round(avg(value) FILTER (k <= 5), 8) AS recent_mean, round(avg(value), 8) AS overall_mean,
    round(stddev_samp(value), 8) AS sd, coalesce(abs(avg(value) FILTER (k <= 5) - avg(value)) > stddev_samp(value), false) AS diverges FROM r GROUP BY user_id""",
)
def recent_form(spark, sf):
    df = sequence.recent_form(read(spark, sf, "events"), "user_id", ["ts", "event_id"], "value")
    return pick(df, "entity", "n", "recent_n", "diverges", recent_mean=8, overall_mean=8, sd=8)


def _streaks(entity: str) -> str:
    return f"""SELECT entity, min(ts) AS first, max(ts) AS last, count(*) AS length, round(sum(value), 2) AS total FROM
    (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY ts, event_id) - row_number() OVER (PARTITION BY entity, value > 40 ORDER BY ts, event_id) AS island
     FROM (SELECT *, {entity} AS entity FROM events)) WHERE value > 40 GROUP BY entity, island"""


@query("streaks", _streaks("user_id"))
def streaks(spark, sf):
    df = sequence.streaks(read(spark, sf, "events"), "user_id", ["ts", "event_id"], F.col("value") > 40, "value")
    return pick(df, "entity", "first", "last", "length", total=2)


# One entity holds a third of all rows.
@query("streaks_hot_entity", _streaks("CASE WHEN user_id % 3 = 0 THEN -1 ELSE user_id END"))
def streaks_hot(spark, sf):
    e = read(spark, sf, "events").withColumn("who", F.when(F.col("user_id") % 3 == 0, -1).otherwise(F.col("user_id")))
    df = sequence.streaks(e, "who", ["ts", "event_id"], F.col("value") > 40, "value")
    return pick(df, "entity", "first", "last", "length", total=2)


@query(
    "longest_streaks",
    f"""SELECT entity, count(*) AS n_streaks, max(length) AS longest, arg_min(first, (-length, first)) AS first, arg_min(last, (-length, first)) AS last
    FROM ({_streaks('user_id')}) GROUP BY entity""",
)
def longest_streaks(spark, sf):
    return sequence.longest_streaks(read(spark, sf, "events"), "user_id", ["ts", "event_id"], F.col("value") > 40)


@query(
    "false_peaks",
    """WITH m AS (SELECT *, avg(value) OVER (PARTITION BY user_id) AS mean FROM events),
    i AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - row_number() OVER (PARTITION BY user_id, value > mean ORDER BY ts, event_id) AS island FROM m),
    s AS (SELECT user_id, count(*) AS length, min(ts) AS first, sum(value) AS total FROM i WHERE value > mean GROUP BY user_id, island),
    b AS (SELECT user_id, max(length) AS length, arg_min(total, (-length, first)) AS total FROM s GROUP BY user_id),
    p AS (SELECT user_id, count(*) AS n, avg(value) AS mean, sum(value) AS sum FROM events GROUP BY user_id)
    SELECT user_id AS entity, n, round(mean, 8) AS mean, length AS streak, round((sum - total) / (n - length), 8) AS mean_without,
    length <= 0.2 * n AND mean - (sum - total) / (n - length) > 0.1 * abs(mean) AS false_peak FROM p JOIN b USING (user_id)""",
)
def false_peaks(spark, sf):
    df = sequence.false_peaks(read(spark, sf, "events"), "user_id", ["ts", "event_id"], "value")
    return pick(df, "entity", "n", "streak", "false_peak", mean=8, mean_without=8)


# ---------------------------------------------------------------- segments


@query(
    "segment_efficiency",
    """WITH p AS (SELECT l_suppkey AS segment, sum(l_quantity) AS output, sum(l_extendedprice) AS cost, var_samp(l_quantity) AS variance FROM lineitem GROUP BY ALL)
    SELECT segment, output, round(cost, 2) AS cost, round(output / cost, 10) AS efficiency, round(variance, 6) AS variance,
    segment = (SELECT segment FROM p ORDER BY output / cost DESC, segment DESC LIMIT 1) AS most_efficient,
    segment = (SELECT segment FROM p ORDER BY output / cost, segment LIMIT 1) AS least_efficient,
    segment = (SELECT segment FROM p ORDER BY variance DESC, segment DESC LIMIT 1) AS most_variable FROM p""",
)
def segment_efficiency(spark, sf):
    df = segments.segment_efficiency(read(spark, sf, "lineitem"), "supp_key", "quantity", "extendedprice")
    return pick(df, "segment", "output", "most_efficient", "least_efficient", "most_variable", cost=2, efficiency=10, variance=6)


@query(
    "risk_tiers",
    """WITH c AS (SELECT quantile_cont(o_totalprice, 1/3) AS a, quantile_cont(o_totalprice, 2/3) AS b FROM orders)
    SELECT CASE WHEN o_totalprice <= a THEN 'Low' WHEN o_totalprice <= b THEN 'Medium' ELSE 'High' END AS risk_tier, count(*) AS n,
    min(o_totalprice) AS low, max(o_totalprice) AS high FROM orders, c GROUP BY ALL""",
)
def risk_tiers(spark, sf):
    return segments.risk_tiers(read(spark, sf, "orders"), "totalprice").groupBy("risk_tier").agg(
        F.count("*").alias("n"), F.min("totalprice").alias("low"), F.max("totalprice").alias("high")
    )


OUTCOME = "sum(CASE WHEN l_returnflag = 'R' AND l_suppkey % 4 <> 0 THEN 1 ELSE 0 END)"


@query(
    "outlier_groups",
    f"""WITH p AS (SELECT l_suppkey AS "group", avg(l_extendedprice) AS cost, {OUTCOME}::DOUBLE AS outcome FROM lineitem GROUP BY ALL),
    s AS (SELECT avg(cost) AS m, stddev_samp(cost) AS sd, avg(outcome) AS o FROM p)
    SELECT "group", round(cost, 4) AS cost, outcome, round((cost - m) / sd, 6) AS z, cost > m + 2 * sd AND outcome <= o AS outlier, cost > m AND outcome = 0 AS zero_outcome FROM p, s""",
)
def outlier_groups(spark, sf):
    good = F.when((F.col("returnflag") == "R") & (F.col("supp_key") % 4 != 0), 1.0).otherwise(0.0)
    df = segments.outlier_groups(read(spark, sf, "lineitem"), "supp_key", F.avg("extendedprice"), F.sum(good))
    return pick(df, "group", "outcome", "outlier", "zero_outcome", cost=4, z=6)


@query(
    "outcome_predictors",
    _union(
        f"SELECT '{c}' AS \"column\", round(corr({c}, extendedprice), 6) AS r, count(*) AS n, round(abs(corr({c}, extendedprice)), 6) AS strength FROM {sql('lineitem')}"
        for c in LINE_ALL
        if c != "extendedprice"
    ),
)
def outcome_predictors(spark, sf):
    return pick(segments.outcome_predictors(read(spark, sf, "lineitem"), "extendedprice"), "column", "n", r=6, strength=6)


@query(
    "on_time_rate",
    """SELECT l_returnflag AS returnflag, o_orderpriority AS orderpriority, count(*) AS n, round(avg((l_shipdate <= o_orderdate + INTERVAL 60 DAY)::INT), 6) AS on_time_rate,
    round(avg((epoch(l_shipdate) - epoch(o_orderdate + INTERVAL 60 DAY)) / 86400), 4) AS mean_gap_days FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL""",
)
def on_time_rate(spark, sf):
    both = read(spark, sf, "lineitem").join(read(spark, sf, "orders"), "order_key")
    both = both.withColumn("promised", F.col("orderdate") + F.expr("INTERVAL 60 DAYS"))
    df = segments.on_time_rate(both, ["returnflag", "orderpriority"], "promised", "shipdate")
    return pick(df, "returnflag", "orderpriority", "n", on_time_rate=6, mean_gap_days=4)


# Exact sums, so that ties are ties on both sides.
PER_PART = """SELECT l_partkey AS entity, sum(l_extendedprice::DECIMAL(18,2))::DOUBLE AS cost, sum(l_discount::DECIMAL(18,2))::DOUBLE AS service,
sum(l_quantity) AS volume FROM lineitem GROUP BY ALL"""


def cost_service():
    return tuple(F.sum(F.col(c).cast("decimal(18,2)")).cast("double") for c in ("extendedprice", "discount"))


@query(
    "efficiency_frontier",
    f"""WITH p AS ({PER_PART}) SELECT entity, cost, service, NOT EXISTS (SELECT 1 FROM p q WHERE q.cost <= p.cost AND q.service >= p.service
    AND (q.cost < p.cost OR q.service > p.service)) AS on_frontier FROM p""",
)
def efficiency_frontier(spark, sf):
    return segments.efficiency_frontier(read(spark, sf, "lineitem"), "part_key", *cost_service())


@query(
    "quadrants",
    f"""WITH p AS ({PER_PART}), c AS (SELECT quantile_cont(cost, 0.5) AS c, quantile_cont(service, 0.5) AS s, quantile_cont(volume, 0.5) AS v FROM p)
    SELECT entity, cost, service, volume, cost > c AND service < s AS poor_value, volume < v AND service > s AS underused FROM p, c""",
)
def quadrants(spark, sf):
    return segments.quadrants(read(spark, sf, "lineitem"), "part_key", *cost_service(), F.sum("quantity"))


# ---------------------------------------------------------------- meaning of nulls


@query(
    "null_taxonomy",
    _union(
        f"""SELECT '{c}' AS "column", count(*) - count({c}) AS missing_count, round(100.0 * (count(*) - count({c})) / count(*), 2) AS missing_pct, '{role}' AS role,
        CASE WHEN '{role}' = 'mandatory' AND 100.0 * (count(*) - count({c})) / count(*) > 5 THEN 'limitation'
        WHEN '{role}' = 'sparse' AND count({c}) < count(*) THEN 'cohort' ELSE 'none' END AS treatment FROM {LABELLED}"""
        for c, role in (
            ("doc_id", "mandatory"), ("text", "unclassified"), ("lang", "unclassified"), ("source", "unclassified"),
            ("n_chars", "unclassified"), ("quality", "mandatory"), ("toxic", "sparse"),
        )
    ),
)
def null_taxonomy(spark, sf):
    return nulls.null_taxonomy(labelled(spark, sf), mandatory=["quality"], sparse=["toxic"])


@query(
    "event_cohort",
    f"""SELECT count(*) AS n_rows, count(quality) AS n_events, round(count(quality) / count(*), 6) AS event_rate, m AS metric,
    round(avg(v) FILTER (quality IS NOT NULL), 4) AS cohort_mean, round(avg(v) FILTER (quality IS NULL), 4) AS rest_mean FROM
    (SELECT quality, unnest(['n_chars', 'doc_id']) AS m, unnest([n_chars, doc_id]) AS v FROM {LABELLED}) GROUP BY m""",
)
def event_cohort(spark, sf):
    df = nulls.event_cohort(labelled(spark, sf), "quality", ["n_chars", "doc_id"])
    return pick(df, "n_rows", "n_events", "metric", event_rate=6, cohort_mean=4, rest_mean=4)


@query(
    "segment_sample_flags",
    "SELECT source AS segment, count(*) AS n, count(*) < 30 AS limited_sample, count(*) < 50 AS low_confidence FROM documents GROUP BY ALL",
)
def segment_sample_flags(spark, sf):
    return nulls.segment_sample_flags(read(spark, sf, "documents"), "source", clinical=True)
