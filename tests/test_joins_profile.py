from __future__ import annotations

import math
import random
from decimal import Decimal

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from tablescope.operators import joins as j, profile as p
from tablescope.plans import quantiles as q

HOWS = ["inner", "left", "outer"]


def as_rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def pandas_rows(left, right, how):
    merged = pd.DataFrame(left, columns=["k", "v"], dtype=object).merge(
        pd.DataFrame(right, columns=["k", "v"], dtype=object), on="k", how=how
    )
    return sorted((tuple(None if pd.isna(x) else x for x in r) for r in merged.itertuples(index=False)), key=str)


@pytest.mark.parametrize("how", HOWS)
@pytest.mark.parametrize("skew", ["off", "split"])
def test_merge_equals_pandas(spark, how, skew):
    rng = random.Random(5)
    hot = lambda n: [(7 if rng.random() < 0.4 else None if rng.random() < 0.2 else rng.randrange(30), i) for i in range(n)]
    for left, right in (
        (hot(200), [(i, -i) for i in range(5, 40)] + [(None, -1), (None, -2)]),
        ([(i, -i) for i in range(0, 20)], hot(150)),
        (hot(60), hot(60)),
        ([(1, 1)], [(2, 2), (None, 3)]),
    ):
        a, b = spark.createDataFrame(left, "k int, v int"), spark.createDataFrame(right, "k int, v int")
        got = j.merge(a, b, "k", how, skew=skew, rows_per_task=5)
        assert got.columns == ["k", "v_x", "v_y"]
        assert as_rows(got) == pandas_rows(left, right, how)


@pytest.mark.parametrize("how", HOWS)
def test_hot_keys_of_different_types(frame, how):
    """0.1 as double and as decimal is one key in SQL but not in Python."""
    a = frame("k double, x int", [0.1] * 20 + [0.3], list(range(21)))
    b = frame("k decimal(5,2), y int", [Decimal("0.10")] * 10 + [Decimal("0.20")], list(range(11)))
    assert as_rows(j.merge(a, b, "k", how, skew="split", rows_per_task=3)) == as_rows(j.merge(a, b, "k", how, skew="off"))


@pytest.mark.parametrize("skew", ["off", "split"])
def test_merge_drop_nulls(spark, skew):
    left, right = [(None, i) for i in range(50)] + [(1, 100)], [(None, i) for i in range(50)] + [(1, 200), (2, 300)]
    a, b = spark.createDataFrame(left, "k int, v int"), spark.createDataFrame(right, "k int, v int")
    assert as_rows(j.merge(a, b, "k", "inner", "drop", skew, 10)) == [(1, 100, 200)]
    assert j.merge(a, b, "k", "left", "drop", skew, 10).count() == 51
    assert j.merge(a, b, "k", "outer", "drop", skew).count() == 102


def test_nan_is_a_missing_key(frame):
    a = frame("k double, x int", [float("nan"), 1.0], [1, 2])
    b = frame("k double, y int", [None, 1.0], [3, 4])
    assert as_rows(j.merge(a, b, "k")) == sorted([(None, 1, 3), (1.0, 2, 4)], key=str)


def test_join_is_an_equi_join(frame, spark):
    a, b = frame("k int, x int", [1], [1]), frame("k int, y int", [1], [1])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for how in HOWS:
            plan = j.merge(a, b, "k", how)._jdf.queryExecution().executedPlan().toString()
            assert "SortMergeJoin" in plan and "NestedLoop" not in plan and "Cartesian" not in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_run_joins(frame):
    ts = {
        "o": frame("id int, c int, n string", [1, 2, 3], [1, 1, None], ["a", "b", "c"]),
        "c": frame("c int, n string", [1, None], ["x", "y"]),
        "t": frame("c string", ["1"]),
    }
    steps = [
        j.JoinInstruction("o", "c", "c", "left", "oc"),
        j.JoinInstruction("oc", "c", "c", "inner", "occ"),
        j.JoinInstruction("o", "none", "c", "left", "x"),
        j.JoinInstruction("o", "c", "id", "left", "x"),
        j.JoinInstruction("o", "t", "c", "left", "x"),
        j.JoinInstruction("o", "c", "c", "theta", "x"),
    ]
    out, log = j.run_joins(ts, steps)
    assert out["oc"].columns == ["id", "c", "n_x", "n_y"] and list(out) == ["o", "c", "t", "oc", "occ"]
    rows = log.orderBy("step").collect()
    assert [r["status"].split(":")[0] for r in rows] == ["done", "done"] + ["skipped"] * 4
    assert [r["row_count"] for r in rows[:2]] == [3, 3] and rows[0]["null_key_rows"] == 2


def test_zero_activity(frame):
    parents = frame("k int", [1, 2, 3, None])
    children = frame("k int, v double", [1, 1, 2, None], [5.0, -5.0, 1.0, 2.0])
    assert sorted(str(r["k"]) for r in j.zero_activity(parents, children, "k").collect()) == ["3", "None"]
    assert sorted(str(r["k"]) for r in j.zero_activity(parents, children, "k", "v").collect()) == ["1", "3", "None"]


# ------------------------------------------------------------------ profile


DELAYS = [12, 17, 15, -400, 19, 14, 13, 16, 18, 11, 15, 17, 14, 950, 16, 13]


@pytest.fixture
def parcels(frame):
    n = len(DELAYS)
    return frame(
        "delay int, weight double, service string, tip double",
        DELAYS, [0.5 * i * i for i in range(n)], [None, "slow"] + ["fast"] * (n - 2), [2.5, None, 0.5] + [float("nan")] * (n - 3),
    )


def test_outliers(parcels):
    row = p.detect_outliers(parcels, "delay").first()
    want = pd.Series(DELAYS)
    assert (row["q1"], row["q3"]) == (want.quantile(0.25), want.quantile(0.75))
    assert (row["outlier_count"], row["outlier_pct"], row["severity"]) == (2, 12.5, "high")
    assert sorted(row["sample_values"]) == [-400.0, 950.0]
    with pytest.raises(KeyError):
        p.detect_outliers(parcels, "absent")
    with pytest.raises(KeyError):
        p.quartiles(parcels, ["absent"])


@pytest.mark.parametrize("n_out, severity", [(5, "low"), (6, "medium"), (10, "medium"), (11, "high")])
def test_severity_at_thresholds(frame, n_out, severity):
    df = frame("x int", [1000 + i for i in range(n_out)] + [i % 30 for i in range(100 - n_out)])
    row = p.outlier_report(df).first()
    assert (row["outlier_count"], row["severity"], len(row["sample_values"])) == (n_out, severity, 5)
    assert row["sample_values"][0] == 1000 + n_out - 1


def test_discrete_columns_are_skipped(parcels, frame):
    assert p.outlier_report(parcels).count() == 0
    assert p.outlier_report(parcels, skip_discrete=False).count() == 3
    df = frame("a int, b int, flag boolean", [i % 19 for i in range(60)], [i % 20 for i in range(60)], [True] * 60)
    assert [r["column"] for r in p.outlier_report(df).collect()] == ["b"]


def test_empty_and_all_missing(spark, frame):
    empty = spark.createDataFrame([], "x double, y double")
    assert p.outlier_report(empty, skip_discrete=False).count() == 0
    assert [r["missing_count"] for r in p.missing_report(empty).collect()] == [0, 0]
    assert p.correlations(empty).first()["r"] is None
    row = p.outlier_report(frame("x double", [None, float("nan")]), skip_discrete=False).first()
    assert (row["n_rows"], row["q1"], row["outlier_count"]) == (2, None, 0)


def test_full_profile(parcels):
    profile = p.full_profile(parcels)
    missing = {r["column"]: r for r in profile.missing.collect()}
    assert (missing["tip"]["missing_pct"], missing["tip"]["critical"]) == (87.5, True)
    assert missing["service"]["missing_count"] == 1
    assert tuple(profile.missing_total.first()) == (15, ["tip"])
    assert profile.correlations.count() == 3


def test_half_missing_is_not_critical(frame):
    assert not p.missing_report(frame("x int", [1, None])).first()["critical"]


def test_correlations_equal_pandas(frame):
    rng = np.random.default_rng(1)
    n = 300
    x = rng.normal(1e6, 1, n)
    y = x * 2 + rng.normal(0, 1, n)
    z = np.where(rng.random(n) < 0.4, np.nan, -x)
    w = np.where(np.isnan(z), 5.0, np.nan)  # never together with z, constant
    flat = np.full(n, 1e9 + 0.1)
    flag = y > y.mean()
    df = frame(
        "x double, y double, z double, w double, flat double, flag boolean",
        *[[float(v) for v in c] for c in (x, y, z, w, flat)], [bool(v) for v in flag],
    )
    want = pd.DataFrame({"x": x, "y": y, "z": z, "w": w, "flat": flat, "flag": flag}).corr(numeric_only=True)
    got = {(r["col_x"], r["col_y"]): (r["r"], r["n"]) for r in p.correlations(df, matrix=True).collect()}
    assert len(got) == 36
    for (a, b), (r, n_both) in got.items():
        if "flat" in (a, b) or "w" in (a, b):
            assert r is None
        else:
            assert r == pytest.approx(want.loc[a, b], abs=1e-9)
    assert got["z", "w"][1] == 0 and got["x", "z"][1] == int((~np.isnan(z)).sum())


def test_correlation_blocks(frame, monkeypatch):
    monkeypatch.setattr(p, "PAIRS_PER_PASS", 4)
    rng = random.Random(3)
    data = {f"c{i}": [rng.random() for _ in range(50)] for i in range(5)}
    df = frame(", ".join(f"{c} double" for c in data), *data.values())
    want = pd.DataFrame(data).corr()
    rows = p.correlations(df).collect()
    assert len(rows) == 10 and all(r["r"] == pytest.approx(want.loc[r["col_x"], r["col_y"]]) for r in rows)


def test_decimal_counts_as_number(frame):
    df = frame("a decimal(10,2), b int", [Decimal(i) for i in range(5)], [2 * i for i in range(5)])
    assert p.correlations(df).first()["r"] == pytest.approx(1.0)


def test_plans(parcels):
    plan = p.TablePlan("t", id_like=["weight", "absent"], exclude=["service"], corr_columns=["delay", "weight"])
    df = p.drop_planned(parcels, plan)
    assert df.columns == ["delay", "tip"] and p.correlation_columns(df, plan) is None
    plans = [p.TablePlan("t"), p.TablePlan("j"), p.TablePlan("off", should_profile=False)]
    assert [x.table for x in p.active_plans(plans, {"j"}, "separate")] == ["t"]
    assert [x.table for x in p.active_plans(plans, {"j"}, "joined")] == ["j"]
    assert [x.table for x in p.active_plans(plans, {"j"}, "both")] == ["t", "j"]


def test_a_failing_table_does_not_stop_the_others(parcels, spark):
    bad = spark.range(1).select((F.lit(1) / F.col("id")).alias("x"))
    profile, failures = p.profile_tables({"good": parcels, "bad": bad}, [p.TablePlan("bad"), p.TablePlan("good"), p.TablePlan("gone")])
    assert sorted(failures) == ["bad", "gone"] and failures["gone"] == "no such table" and {r["table"] for r in profile.missing.collect()} == {"good"}


def test_subgroup(frame):
    df = frame("g string, v double", ["a"] * 4 + ["b"], [1.0, 2.0, 3.0, 10.0, 99.0])
    row = p.subgroup_describe(df, "g = 'a'", ["v"]).first()
    want = pd.Series([1.0, 2.0, 3.0, 10.0]).describe()
    assert [row[c] for c in ("count", "mean", "std", "min", "q25", "q50", "q75", "max")] == pytest.approx(list(want))


# ------------------------------------------------------------------ quantiles

VALUES = st.lists(st.one_of(st.none(), st.integers(-5, 5).map(float), st.floats(-1e6, 1e6)), min_size=1, max_size=60)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(VALUES, st.lists(st.floats(0, 1), min_size=1, max_size=3))
def test_quantiles_equal_pandas(spark, values, probs):
    df = spark.createDataFrame([(v,) for v in values], "x double")
    want = pd.Series(values, dtype=float).quantile(probs).tolist()
    for method in ("exact",):
        got = q.quantiles(df, {"x": F.col("x")}, probs, method)["x"]
        for g, w in zip(got, want):
            assert (g is None and math.isnan(w)) or g == pytest.approx(w, rel=1e-9, abs=1e-9)


@pytest.mark.parametrize("shape", ["uniform", "third_equal", "two_values"])
def test_brackets_over_many_partitions(spark, spread, shape):
    value = {
        "uniform": "xxhash64(id) / 1e15",
        "third_equal": "IF(id % 3 = 0, 7.0D, xxhash64(id) / 1e15)",
        "two_values": "IF(id % 2 = 0, 1.0D, 2.0D)",
    }[shape]
    df = spark.range(0, 30_000, 1, 6).select(F.expr(value).cast("double").alias("x"))
    want = df.toPandas()["x"].quantile([0, 0.25, 0.5, 0.75, 1]).tolist()
    assert q.quantiles(df, {"x": F.col("x")}, [0, 0.25, 0.5, 0.75, 1], "exact")["x"] == pytest.approx(want)


def test_failed_bracket_is_widened(spark, monkeypatch):
    df = spark.range(1000).select(F.col("id").cast("double").alias("x"))
    calls = []
    real = q._pick

    def miss_first(values, brackets, counts, probs):
        calls.append(dict(brackets))
        if len(calls) == 1:
            brackets = {t: (0.0, 1.0) for t in brackets}
        return real(values, brackets, counts, probs)

    monkeypatch.setattr(q, "_pick", miss_first)
    assert q.quantiles(df, {"x": F.col("x")}, [0.25, 0.75], "exact")["x"] == [249.75, 749.25]
    assert len(calls) == 2


# ------------------------------------------------------------------ keys, plans and arguments


def test_long_and_double_keys_meet_as_exact_numbers(frame):
    big = 9007199254740993
    a = frame("k long, x int", [big, 5, 7], [1, 2, 3])
    b = frame("k double, y int", [float(big - 1), 5.0, 0.1], [4, 5, 6])
    assert [(r["x"], r["y"]) for r in j.merge(a, b, "k").collect()] == [(2, 5)]
    small = frame("k decimal(12,6), z int", [Decimal("0.00001"), Decimal("0.1")], [1, 2])
    assert sorted(r["z"] for r in j.merge(frame("k double", [1e-5, 0.1, 0.3]), small, "k").collect()) == [1, 2]


def test_clashing_names_are_logged(frame):
    ts = {"l": frame("k int, a int, a_x int", [1], [2], [3]), "r": frame("k int, a int", [1], [4]), "s": frame("k int, b int", [1], [5])}
    steps = [j.JoinInstruction("l", "r", "k", "inner", "no"), j.JoinInstruction("l", "s", "k", "inner", "yes")]
    out, log = j.run_joins(ts, steps)
    assert [r["status"][:7] for r in log.orderBy("step").collect()] == ["skipped", "done"] and "no" not in out and out["yes"].count() == 1


def test_join_plan_follows_cardinality(spark):
    rows = [
        ("a", "k", "b", "k", 0.95, "many_to_many", "inner"), ("a", "k", "c", "k", 0.7, "one_to_many", "left"),
        ("a", "k", "d", "k", 0.65, "one_to_one", "inner"), ("a", "k", "e", "k", 0.9, "many_to_one", "unknown"),
        ("a", "k", "f", "k", 0.5, "one_to_one", "inner"), ("a", "k", "g", "q", 0.9, "one_to_one", "inner"), ("a", "k", "h", "k", 0.9, None, "unknown"),
    ]
    df = spark.createDataFrame(rows, "table_a string, column_a string, table_b string, column_b string, confidence double, cardinality_full string, join_hint string")
    assert [(i.right, i.how) for i in j.instructions_from(df)] == [("d", "inner"), ("e", "left"), ("c", "left")]
    assert [i.right for i in j.instructions_from(df, many_to_many=True)] == ["d", "e", "c", "b", "h"]


def test_nan_in_a_column_argument_is_missing(frame):
    from tablescope.operators.concentration import top_rows_share

    df = frame("v double", [5.0, float("nan"), 3.0, 2.0])
    by_name, by_column = (top_rows_share(df, x).collect() for x in ("v", F.col("v")))
    assert by_name == by_column


def test_chart_takes_as_many_points_as_asked(frame):
    from tablescope.operators.charts import chart_points

    df = frame("l string, v int", [f"x{i}" for i in range(30)], list(range(30)))
    assert chart_points(df, "l", "v").count() == 7 and chart_points(df, "l", "v", n=20).count() == 20


def test_quantiles_rank_no_whole_column_in_one_task(frame):
    df = frame("x double", [float(i % 97) for i in range(2000)])
    assert q.quantiles(df, {"x": F.col("x")}, [0.5])["x"] == [pd.Series([i % 97 for i in range(2000)]).quantile(0.5)]
    with pytest.raises(ValueError):
        q.quantiles(df, {"x": F.col("x")}, [0.5], "counted")


def test_hot_keys_are_exact_without_a_cap(spark):
    from tablescope.plans import skew

    rows = [(k % 700, f"t{k}") for k in range(700 * 6)] + [(5000 + k, "x") for k in range(3000)]
    df = spark.createDataFrame(rows, "k long, text string")
    got = {r["_hk"]: r["n"] for r in skew.hot_keys(df, F.col("k"), 4).collect()}
    assert got == {k: 6 for k in range(700)}
    assert skew.hot_keys(df, F.col("k"), 6).count() == 0


def test_largest_salt_within_target_with_key_and_text_only(spark):
    """A side whose only column besides the key is a text: the text spreads a hot key's rows, each place within target."""
    rows = [(7, f"text {i}") for i in range(5000)] + [(i, f"other {i}") for i in range(100, 200)]
    left = spark.createDataFrame(rows, "k long, text string")
    right = spark.createDataFrame([(7, 1), (3, 2)], "k long, v long")
    spread = j._Spread.plan(left, right, "k", F.col("k"), F.col("k"), "left", True, "split", 100)
    places = spread.left(left).groupBy("k", "_ls").count()
    assert places.where("k = 7").count() >= 50
    assert places.agg(F.max("count")).first()[0] <= 100
    joined = j.merge(left, right, "k", "left", skew="split", rows_per_task=100)
    assert joined.count() == 5100 and joined.where("k = 7 AND v = 1").count() == 5000


def test_many_pairs_come_from_one_scan_of_comoments(spark):
    """25 columns (300 pairs, more than one aggregate takes) with missing cells: pandas' pairwise r, one scan."""
    rnd = np.random.RandomState(3)
    data = rnd.normal(size=(400, 25)) * rnd.uniform(0.1, 100, size=25) + rnd.uniform(-50, 50, size=25)
    data[rnd.uniform(size=data.shape) < 0.2] = np.nan
    data[:, 7] = np.where(np.isnan(data[:, 7]), np.nan, 5.0)  # flat
    data[:200, 9] = np.nan
    data[200:, 10] = np.nan  # never beside column 9
    frame_ = pd.DataFrame(data, columns=[f"c{i}" for i in range(25)])
    df = spark.createDataFrame(frame_.astype(object).where(frame_.notna(), None), ", ".join(f"c{i} double" for i in range(25)))
    got = {(r["col_x"], r["col_y"]): (r["r"], r["n"]) for r in p.correlations(df).collect()}
    assert len(got) == 300
    want = frame_.corr(min_periods=1)
    for (x, y), (r, n) in got.items():
        both = frame_[[x, y]].dropna()
        assert n == len(both)
        expected = want.loc[x, y]
        if x == "c7" or y == "c7" or len(both) < 2 or np.isnan(expected):
            assert r is None
        else:
            assert r == pytest.approx(expected, abs=1e-9)
    plan = p.correlations(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and plan.count("Scan ExistingRDD") <= 2


def test_plans_keep_measures_and_leave_out_keys(spark):
    rows = [
        ("line", 0, 0, "l_orderkey", "integer", "numeric_continuous", None),
        ("line", 0, 1, "l_extendedprice", "number", "id_like", "uniqueness"),
        ("line", 0, 2, "l_quantity", "number", "numeric_discrete", None),
        ("line", 0, 3, "line_id", "integer", "id_like", "name"),
        ("line", 0, 4, "row_no", "integer", "id_like", "uniqueness"),
        ("orders", 1, 0, "o_orderkey", "integer", "id_like", "uniqueness"),
    ]
    columns = spark.createDataFrame(rows, "table string, pos int, ordinal int, column string, kind string, category string, id_evidence string")
    plans = {pl.table: pl for pl in p.plans_from(columns)}
    assert plans["line"].id_like == ["line_id", "row_no"]
    assert plans["line"].corr_columns == ["l_orderkey", "l_extendedprice", "l_quantity"]
    related = spark.createDataFrame([("line", "l_orderkey", "orders", "o_orderkey")], "table_a string, column_a string, table_b string, column_b string")
    plans = {pl.table: pl for pl in p.plans_from(columns, related)}
    assert plans["line"].id_like == ["l_orderkey", "line_id", "row_no"]
    assert plans["line"].corr_columns == ["l_extendedprice", "l_quantity"]
    assert plans["orders"].should_profile is False


@pytest.mark.parametrize("how", HOWS)
@pytest.mark.parametrize("skew", ["auto", "split"])
@pytest.mark.parametrize("null_keys", ["match", "drop"])
def test_keys_with_many_pairs_are_joined_in_cells(spark, monkeypatch, how, skew, null_keys):
    """Neither side's rows of a key are many, their product is; unmatched rows of other keys stay, whatever the way."""
    left = [(None if i % 3 == 0 else 7 if i % 3 == 1 else i, i) for i in range(90)] + [(4, 4)] * 3
    right = [(None if i % 2 == 0 else 7 if i % 5 == 0 else i, -i) for i in range(60)] + [(4, -4)] * 2
    a, b = spark.createDataFrame(left, "k int, v int"), spark.createDataFrame(right, "k long, v int")
    want = as_rows(j.merge(a, b, "k", how, null_keys, "off"))
    monkeypatch.setattr(j, "PAIRS_PER_TASK", 100)
    spread = j._Spread.plan(a, b.withColumnRenamed("k", "_rk"), "k", F.col("k"), F.col("_rk"), {"outer": "full"}.get(how, how), null_keys == "match", skew, 1000)
    assert {r["_hk"] for r in spread.heavy.collect()} == ({None, 7} if null_keys == "match" else {7})
    assert as_rows(j.merge(a, b, "k", how, null_keys, skew)) == want


def test_no_cell_takes_all_pairs_of_a_key(spark, monkeypatch):
    monkeypatch.setattr(j, "PAIRS_PER_TASK", 10_000)
    a = spark.range(2000).select(F.lit(None).cast("long").alias("k"), F.col("id").alias("x"))
    b = spark.range(500).select(F.lit(None).cast("long").alias("_rk"), F.col("id").alias("y"))
    spread = j._Spread.plan(a, b, "k", F.col("k"), F.col("_rk"), "full", True, "auto", 2_000_000)
    assert spread.hot is None and spread.rest(a, F.col("k")).count() == 0
    pairs = spread.pairs(a, b)
    cells = [r["count"] for r in pairs.groupBy("_ls").count().collect()]
    assert sum(cells) == 1_000_000 and len(cells) == 100 and max(cells) < 30_000
    assert pairs.select("x", "y").distinct().count() == 1_000_000


@pytest.mark.parametrize("broadcast", ["-1", "10485760"])
def test_cells_are_dealt_out_evenly(spark, monkeypatch, broadcast):
    """Cells of several keys: every partition takes as many, also after the join."""
    monkeypatch.setattr(j, "PAIRS_PER_TASK", 10_000)
    key = F.when(F.col("id") % 2 == 0, F.lit(7).cast("long"))
    a = spark.range(1000).select(key.alias("k"), F.col("id").alias("x"), F.lit("c").alias("_cell"))
    b = spark.range(500).select(key.alias("_rk"), F.col("id").alias("y"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    try:
        spread = j._Spread.plan(a, b, "k", F.col("k"), F.col("_rk"), "full", True, "auto", 2_000_000)
        for most in (2_000, 7):
            monkeypatch.setattr(j, "CELL_PARTS", most)
            pairs = spread.pairs(a, b)
            parts = [r["n"] for r in pairs.groupBy(F.spark_partition_id()).agg(F.count_distinct("_ls").alias("n")).collect()]
            assert sum(parts) == spread.cells == 30 and len(parts) == min(most, 30) and max(parts) == math.ceil(30 / len(parts))
            assert pairs.select("k", "x", "y", "_cell").distinct().count() == 2 * 500 * 250
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_many_pairs_need_no_pass_for_the_means(spark, monkeypatch):
    """Tasks whose values lie far apart, a column missing at first, a flat one: all from the one scan."""
    monkeypatch.setattr(p, "moments_from", lambda *_: pytest.fail("a pass for the means"))
    rnd = np.random.RandomState(4)
    data = rnd.normal(size=(400, 25)) + np.repeat([0, 1e6, -1e5, 3e7], 100)[:, None]
    data[:150, 3] = np.nan
    data[:, 5] = 0.1
    frame_ = pd.DataFrame(data, columns=[f"c{i}" for i in range(25)])
    rows = frame_.astype(object).where(frame_.notna(), None).values.tolist()
    df = spark.createDataFrame(spark.sparkContext.parallelize(rows, 4), ", ".join(f"c{i} double" for i in range(25)))
    got = {(r["col_x"], r["col_y"]): (r["r"], r["n"]) for r in p.correlations(df).collect()}
    want = frame_.corr()
    assert len(got) == 300
    for (x, y), (r, n) in got.items():
        assert n == len(frame_[[x, y]].dropna())
        assert r is None if "c5" in (x, y) else r == pytest.approx(want.loc[x, y], abs=1e-9)


def test_many_full_buckets_are_not_listed_one_by_one(spark, monkeypatch):
    """Tens of thousands of bucket numbers in a plan cost more than the count itself; then all keys are counted."""
    from tablescope.plans import skew

    df = spark.range(3000).select((F.col("id") % 500).alias("k"))
    monkeypatch.setattr(skew, "LISTED", 100)
    found = skew.hot_keys(df, F.col("k"), 4)
    assert " IN (" not in found._jdf.queryExecution().analyzed().toString() and " INSET " not in found._jdf.queryExecution().optimizedPlan().toString()
    assert {r["_hk"]: r["n"] for r in found.collect()} == {k: 6 for k in range(500)}
