from __future__ import annotations

import itertools
import random
from decimal import Decimal

import pandas as pd
import pytest
from pyspark.sql import Window, functions as F

from tablescope.operators import audit, concentration as k, nulls, paradox, rates, segments, sequence, shape
from tablescope.plans.ranges import PART, By, Layout, range_layout, running


def heavy(spark, n=3000):
    """Entity values of which a third are equal, with negative ones among them."""
    rng = random.Random(2)
    return [(i, 50 if rng.random() < 1 / 3 else rng.randrange(-20, 500)) for i in range(n)]


# ------------------------------------------------------------------ ranges


def test_running_over_many_partitions(spark, spread):
    rows = [(rng_i % 3 if rng_i % 2 else 0, rng_i, v) for rng_i, v in heavy(spark)]
    df = spark.createDataFrame(rows, "g int, i int, v long").repartition(6)
    out = running(df, [By("v", True), By("i")], {"s": ("sum", F.col("v")), "m": ("max", F.col("i"))}, keys=["g"])
    got = {(r["g"], r["i"]): (r["s"], r["m"]) for r in out.collect()}
    want = {}
    for g, part in itertools.groupby(sorted(rows, key=lambda r: (r[0], -r[2], r[1])), key=lambda r: r[0]):
        s, m = 0, -1
        for _, i, v in part:
            s, m = s + v, max(m, i)
            want[(g, i)] = (s, m)
    assert got == want
    plain = running(df, [By("v", True), By("i")], {"s": ("sum", F.col("v"))}, inclusive=False)
    acc, expect = None, {}
    for _, i, v in sorted(rows, key=lambda r: (-r[2], r[1])):
        expect[i] = acc
        acc = v if acc is None else acc + v
    assert {r["i"]: r["s"] for r in plain.collect()} == expect


@pytest.mark.parametrize("partitions", [1, 7])
def test_layout_cut_offs(spark, spread, partitions):
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    rows = heavy(spark)
    ranked = Layout.of(spark.createDataFrame(rows, "entity int, value long"))
    values = sorted((v for _, v in rows), reverse=True)
    sums = list(itertools.accumulate(values))
    assert (ranked.n, ranked.total) == (len(values), sums[-1])
    for n in (1, 2, 999, 1500, len(values)):
        assert ranked.top_sum(n) == sums[n - 1]
    for goal in (1, sums[0], sums[400], sums[-1], max(sums), max(sums) + 1):
        want = next((i + 1 for i, s in enumerate(sums) if s >= goal), None)
        assert ranked.smallest_reaching(goal) == want


def test_no_single_task_exchange(spark, spread):
    """Ranking all entities never brings them into one partition, and deals the rows once."""
    df = spark.createDataFrame(heavy(spark), "e int, v long")
    laid = range_layout(df, By("v", True), By("e"))
    inside = Window.partitionBy(PART).orderBy(F.col("v").desc(), "e")
    plan = laid.select("*", F.sum("v").over(inside).alias("s"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "shufflepartitionidpassthrough" in plan
    assert laid.select(PART).distinct().count() > 3
    # The stored running values meet the ranges' offsets, at most one row per range, sent to every task.
    tiers = k.pareto_tiers(df, "e", "v")._jdf.queryExecution().executedPlan().toString()
    lines = tiers.splitlines()
    assert "BroadcastHashJoin" in tiers
    # only partial totals (one row per task and range) are exchanged by range
    assert all("partial_" in lines[i + 1] for i, line in enumerate(lines) if "Exchange hashpartitioning" in line)
    assert sum("Exchange SinglePartition" in line for line in tiers.splitlines()) <= 1


# ------------------------------------------------------------------ concentration


def test_pareto(frame, spark, spread):
    df = frame("e string, v double", [*"aabcd", None], [50.0, 30.0, 10.0, 6.0, 4.0, 1000.0])
    row = k.pareto(df, "e", "v").first()
    assert (row["n_entities"], row["total"], row["k"], row["k_top"], row["top_share"], row["concentrated"]) == (4, 100.0, 1, 1, 0.8, True)
    tiers = {r["entity"]: r["tier"] for r in k.pareto_tiers(df, "e", "v").collect()}
    assert tiers == {"a": "High", "b": "Mid", "c": "Mid", "d": "Tail"}
    none = k.pareto(frame("e string, v double", ["a"], [-1.0]), "e", "v").first()
    assert none["k"] is None and none["concentrated"] is None


def test_decimal_pareto(frame):
    df = frame("e int, v decimal(18,2)", [1, 2, 3], [Decimal("0.70"), Decimal("0.10"), Decimal("0.20")])
    row = k.pareto(df, "e", F.col("v")).first()
    assert row["k"] == 2 and k.pareto(df, "e", F.col("v"), goal=0.9).first()["k"] == 2


def test_shares(frame):
    df = frame("e int, v double", [1, 2, 3, 4, 5, 6, 6], [30.0, 20.0, 10.0, 10.0, 10.0, 10.0, 10.0])
    got = {r["n"]: (r["top_sum"], r["flagged"]) for r in k.top_n_share(df, "e", "v").collect()}
    assert got == {1: (30.0, True), 3: (70.0, True), 5: (90.0, True)}
    row = k.top_fraction_share(df, "e", "v", 0.5, 0.7).first()
    assert (row["k"], row["share"], row["flagged"]) == (3, 0.7, False)
    assert k.top_rows_share(df, "v", 2).first()["share"] == 0.5


# ------------------------------------------------------------------ shape and paradox


def test_bimodality(spark):
    def of(expr, n=4000):
        return shape.bimodality(spark.range(n).select(F.expr(expr).alias("x")), "x").first()

    noise = "(pmod(xxhash64(id), 1000) + pmod(xxhash64(id, 1), 1000) + pmod(xxhash64(id, 2), 1000)) / 30D"
    two = of(f"{noise} + IF(id % 3 = 0, 300, 0)")
    assert two["bimodal"] and two["low_peak"] == pytest.approx(50, abs=15) and two["high_peak"] == pytest.approx(350, abs=15)
    assert of(noise)["bimodal"] is False
    assert of("CAST(id % 11 AS DOUBLE)")["bimodal"] is None  # too few values
    assert of(noise, 600)["bimodal"] is None  # too few rows
    assert of("1D")["sarle"] is None


def test_two_modes(spark):
    df = spark.range(3000).select(F.expr("pmod(xxhash64(id), 100) / 10D + IF(id % 3 = 0, 100, 0)").alias("x"))
    row = shape.two_mode_split(df, "x").first()
    assert (row["low_n"], row["high_n"]) == (2000, 1000) and row["gap"] == pytest.approx(100, abs=1)
    assert shape.two_mode_split(spark.range(3).select(F.lit(1.0).alias("x")), "x").count() == 0


def test_paradoxes(frame):
    df = frame("x int, y int, z int, s string", [1, 2, 3, 4], [4, 3, 2, 1], [1, 1, 1, 1], [*"aabb"])
    got = {(r["col_x"], r["col_y"]): r["paradox"] for r in paradox.direction_paradox(df, [("x", "y", 1), ("y", "x", -1), ("x", "z", 1)]).collect()}
    assert got == {("x", "y"): True, ("y", "x"): False, ("x", "z"): False}
    both = frame("x int, y int, s string", [1, 2, 11, 12], [12, 11, 22, 21], [*"aabb"])
    assert {r["segment"]: (round(r["r"], 6), r["reversed"]) for r in paradox.segment_reversal(both, "x", "y", "s").collect()} == {
        "a": (-1.0, True), "b": (-1.0, True)
    }


def test_rank_inversion(frame):
    df = frame("e string, v int, q int", [*"aabbc"], [5, 5, 3, 3, 1], [1, 1, 5, 5, 9])
    row = paradox.rank_inversion(df, "e", F.sum("v"), F.avg("q")).first()
    assert tuple(row) == ("a", 10, 1.0, 3, 3, True, True)
    assert paradox.rank_inversion(df.where("e = 'a'"), "e", F.sum("v"), F.avg("q")).first()["worst"] is False


def test_rates(frame):
    df = frame("r double, v double, n double", [0.0, 0.1, 0.2, None], [1.0, 2.0, 3.0, 9.0], [9.0, 5.0, 1.0, 9.0])
    row = rates.rate_response(df, "r", "v", "n").first()
    assert row["inverted"] and row["sweet_spot"] == 0.0 and row["r_volume"] == pytest.approx(1.0)
    cv = rates.volatility(df, ["v"]).first()
    assert cv["cv"] == pytest.approx(pd.Series([1, 2, 3, 9]).std() / 3.75)
    assert rates.volatility(frame("x double", [-1.0, 1.0]), ["x"]).first()["cv"] is None


# ------------------------------------------------------------------ sequences


@pytest.mark.parametrize("hot_share", [0.0, 0.4, 1.0])
def test_streaks_over_many_partitions(spark, spread, hot_share):
    rng = random.Random(8)
    state, rows = True, []
    for t in range(4000):
        if rng.random() < 0.02:
            state = not state
        rows.append((0 if rng.random() < hot_share else rng.randrange(1, 30), t, 1.0 if state else 0.0))
    df = spark.createDataFrame(rows, "e int, t int, v double").repartition(5)
    got = sorted(tuple(r) for r in sequence.streaks(df, "e", ["t"], F.col("v") > 0, "v").collect())
    want = []
    for e, part in itertools.groupby(sorted(rows), key=lambda r: r[0]):
        for hot, run in itertools.groupby(list(part), key=lambda r: r[2] > 0):
            run = list(run)
            if hot:
                want.append((e, run[0][1], run[-1][1], len(run), float(len(run))))
    assert got == sorted(want)


def test_recent_form(frame):
    df = frame("e string, t int, m double", ["a"] * 6 + [None], [1, 2, 3, 4, 5, 6, 7], [0.0, 0.0, 0.0, 0.0, 10.0, 10.0, 5.0])
    row = sequence.recent_form(df, "e", ["t"], "m", 2).first()
    assert (row["recent_mean"], row["n"], row["diverges"]) == (10.0, 6, True)


def test_false_peak(frame):
    values = [1.0] * 9 + [50.0]
    df = frame("e string, t int, m double", ["a"] * 10 + ["b"] * 10, list(range(20)), values + [float(i % 2) for i in range(10)])
    got = {r["entity"]: r["false_peak"] for r in sequence.false_peaks(df, "e", ["t"], "m").collect()}
    assert got["a"] is True


# ------------------------------------------------------------------ segments and nulls


@pytest.mark.parametrize("size", [40, 400])
def test_frontier(spark, spread, size):
    rng = random.Random(size)
    rows = [(i, rng.randrange(20), rng.randrange(20)) for i in range(size)]
    df = spark.createDataFrame(rows, "e int, c int, s int")
    got = {r["entity"]: r["on_frontier"] for r in segments.efficiency_frontier(df, "e", F.max("c"), F.max("s")).collect()}
    beats = lambda a, b: a[1] <= b[1] and a[2] >= b[2] and (a[1] < b[1] or a[2] > b[2])
    assert got == {b[0]: not any(beats(a, b) for a in rows) for b in rows}


def test_segments(frame):
    df = frame("s string, o double, c double", [*"aabbcc"], [1.0, 3.0, 9.0, 9.0, 0.0, 0.0], [1.0, 1.0, 2.0, 2.0, 30.0, 30.0])
    got = {r["segment"]: r for r in segments.segment_efficiency(df, "s", "o", "c").collect()}
    assert got["b"]["most_efficient"] and got["c"]["least_efficient"] and got["a"]["most_variable"]
    flagged = {r["group"]: (r["outlier"], r["zero_outcome"]) for r in segments.outlier_groups(df, "s", F.avg("c"), F.sum("o"), 1.0).collect()}
    assert flagged == {"a": (False, False), "b": (False, False), "c": (True, True)}
    tiers = segments.risk_tiers(frame("x int", [*range(1, 10), None]), "x").groupBy("risk_tier").count()
    assert {r[0]: r[1] for r in tiers.collect()} == {"Low": 3, "Medium": 3, "High": 3, None: 1}


def test_null_roles(frame):
    df = frame(
        "price double, medal string, lang string, age int, note string",
        [1.0] * 18 + [None, float("nan")], [None] * 19 + ["gold"], [None] * 20, [1] * 19 + [None], ["x"] * 20,
    )
    got = {r["column"]: (r["role"], r["treatment"]) for r in nulls.null_taxonomy(df, mandatory=["lang"]).collect()}
    assert got == {
        "price": ("mandatory", "limitation"), "medal": ("sparse", "cohort"), "lang": ("mandatory", "limitation"),
        "age": ("mandatory", "none"), "note": ("unclassified", "none"),
    }
    row = nulls.event_cohort(df, "medal", ["age"]).first()
    assert (row["event_rate"], row["cohort_mean"], row["rest_mean"]) == (0.05, None, 1.0)


def test_sample_flags(frame):
    df = frame("s string", ["a"] * 29 + ["b"] * 30 + ["c"] * 50)
    flags = lambda clinical: {r["segment"]: (r["limited_sample"], r["low_confidence"]) for r in nulls.segment_sample_flags(df, "s", clinical).collect()}  # noqa: E731,E501
    assert flags(True) == {"a": (True, True), "b": (False, True), "c": (False, False)}
    assert flags(False)["b"] == (False, False)


# ------------------------------------------------------------------ audit


@pytest.mark.parametrize(
    "r, n, strength",
    [
        (0.6, 201, 1.0), (-0.6, 201, 1.0), (0.6, 200, 0.7), (0.5, 300, 0.7), (0.4, 101, 0.7), (0.4, 100, 0.4), (0.3, 51, 0.4),
        (0.3, 50, 0.2), (0.2, 500, 0.2), (0.9, 29, 0.2), (0.09, 5000, 0.0), (None, 10, 0.0), (0.1, 500, 0.2),
    ],
)
def test_evidence(frame, r, n, strength):
    assert audit.evidence_grade(frame("r double, n long", [r], [n])).first()["strength"] == strength


def test_wording(frame):
    df = frame("r double", [0.65, -0.65, 0.6, 0.39, 0.4, 0.75, None])
    assert [r["causal_allowed"] for r in audit.wording_rule(df).collect()] == [True, True, False, False, False, True, False]
    assert [r["causal_allowed"] for r in audit.wording_rule(df, True).collect()] == [False] * 5 + [True, False]
    assert [r["causal_warns"] for r in audit.wording_rule(df).collect()] == [False, False, False, True, False, False, True]


def test_insight_value(frame):
    df = frame(
        "report int, insight_id string, statistical_strength double, novelty_score double, decision_leverage double",
        [1, 1, 1, 1, 2, 2], [*"abcdef"], [1.0, 0.6, 0.3, 0.0, 1.2, None], [1.0, 0.6, 0.3, 0.1, 0.5, 0.5], [1.0, 0.6, 0.3, 0.0, 0.5, 0.5],
    )
    scored, rejected = audit.insight_value(df)
    assert {r["insight_id"]: (r["value_score"], r["value_tier"]) for r in scored.collect()} == {
        "a": (1.0, "high_value"), "b": (0.6, "moderate_value"), "c": (0.3, "moderate_value"), "d": (0.03, "low_value")
    }
    assert sorted(r["insight_id"] for r in rejected.collect()) == ["e", "f"]
    row = audit.overall_value(scored).first()
    assert row["overall_value_score"] == pytest.approx(1.93 / 4) and row["low_value_insights"] == ["d"]


def test_clamps(spark):
    """Every mix of verdict and findings, with scores on a grid and just beside each limit."""
    grid = {round(limit + step, 3) for limit in (0.3, 0.5, 0.85) for step in (-0.013, 0.0, 0.013)} | {0.0, 0.117, 0.699, 1.0}
    mixes = [(), ("warn",), ("block",), ("warn", "warn"), ("warn", "block")]
    cases = [(ok, mix, score) for ok in (True, False) for mix in mixes for score in sorted(grid)]

    def rule(ok, mix, score):
        if "block" in mix and score > 0.3:
            return 0.0
        if not ok and score > 0.5:
            return 0.4
        return 0.85 if ok and mix and score > 0.85 else score

    reports = spark.createDataFrame([(i, ok, score) for i, (ok, _, score) in enumerate(cases)], "report int, approved boolean, score double")
    findings = spark.createDataFrame([(i, s) for i, (_, mix, _) in enumerate(cases) for s in mix], "report int, severity string")
    found = {r["report"]: r["clamped_score"] for r in audit.clamp_scores(reports, findings).collect()}
    assert found == {i: rule(*case) for i, case in enumerate(cases)}


def test_claims(spark):
    facts = spark.createDataFrame(
        [("t", "a", None, "q1", 10.0), ("t", "a", "b", "correlation", -0.5), ("t", "k_id", None, "q1", 1500.0)],
        "`table` string, column string, column2 string, metric string, value double",
    )
    columns = spark.createDataFrame([("t", "k_id", "id_like"), ("t", "a", "numeric_continuous")], "`table` string, column string, category string")
    claims = [
        (1, "right", "t", "a", None, "q1", 10.05), (1, "wrong", "t", "a", None, "q1", 12.0), (1, "sign", "t", "b", "a", "correlation", 0.5),
        (1, "id", "t", "k_id", None, "q1", 1500.0), (2, "unknown", "t", "a", None, "mean", 3.0), (2, "fine", "t", "b", "a", "correlation", -0.5),
    ]
    df = spark.createDataFrame(claims, "report int, claim string, `table` string, column string, column2 string, metric string, value double")
    found = audit.verify_claims(df, facts, columns)
    assert {(r["claim"], r["issue_type"], r["severity"]) for r in found.collect()} == {
        ("wrong", "hallucination", "block"), ("sign", "direction_error", "block"), ("id", "id_misuse", "block"), ("unknown", "no_fact", "warn")
    }
    reports = spark.createDataFrame([(1,), (2,), (3,)], "report int")
    assert {r["report"]: r["approved"] for r in audit.verdicts(reports, found).collect()} == {1: False, 2: True, 3: True}


def test_rewrites(spark):
    rewrites = spark.createDataFrame(
        [(1, 2, "insight_2", "id_misuse", "drop it"), (1, 1, "insight_1", "math_error", "redo")],
        "report int, seq int, insight_id string, issue_type string, fix_instruction string",
    )
    reports = spark.createDataFrame([(1, "x"), (2, "say it again"), (3, None)], "report int, revision_instructions string")
    assert {r["report"]: r["rewrites"] for r in audit.rewrite_list(reports, rewrites).collect()} == {
        1: "- [insight_1] (math_error): redo\n- [insight_2] (id_misuse): drop it", 2: "say it again", 3: audit.NO_REWRITES
    }


def test_bimodality_of_many_columns_equals_one_at_a_time(spark):
    from tablescope.operators import shape

    rnd = random.Random(5)
    rows = [
        (rnd.gauss(0, 1) + (8 if i % 2 else 0), float(rnd.randrange(25)), float(i % 5), rnd.gauss(3, 1) if i < 500 else None)
        for i in range(2000)
    ]
    df = spark.createDataFrame(rows, "two double, few double, five double, short double")
    names = ["two", "few", "five", "short"]
    got = {r["label"]: tuple(r)[1:] for r in shape.bimodality_of(df, {c: c for c in names}).collect()}
    for c in names:
        one = tuple(shape.bimodality(df, c).first())
        assert got[c] == pytest.approx(one, nan_ok=True) if None not in one else got[c] == one
    assert got["two"][4] is True and got["five"][4] is None and got["short"][4] is None


def test_low_value_insights_as_rows(spark):
    rows = [("r1", "a", 0.1, 0.1, 0.1), ("r1", "b", 0.9, 0.9, 0.9), ("r2", "c", 0.0, 0.0, 0.0)]
    names = list(audit.WEIGHTS)
    df = spark.createDataFrame(rows, "report string, insight_id string, " + ", ".join(f"{n} double" for n in names))
    scored, _ = audit.insight_value(df)
    got = sorted((r["report"], r["insight_id"]) for r in audit.low_value_rows(scored).collect())
    assert got == [("r1", "a"), ("r2", "c")]


def test_more_findings(spark):
    rows = [(float(v),) for v in list(range(1, 41)) + [5000.0]] + [(None,)] * 5
    data = spark.createDataFrame(rows, "x double").withColumn("y", F.lit(1.0))
    facts = audit.fenced_means(data, ["x", "y"], "t")
    claims = spark.createDataFrame(
        [("r", 1, "t", "x", None, "mean", True), ("r", 2, "t", "x", None, "mean", None), ("r", 3, "t", "y", None, "mean", False),
         ("s", 1, "t", "y", "x", "correlation", False), ("s", 2, "t", "x", "y", "correlation", False)],
        "report string, claim int, table string, column string, column2 string, metric string, limited boolean",
    )
    got = sorted((r["report"], r["claim"], r["finding_type"]) for r in audit.more_findings(claims, facts).collect())
    assert got == [
        ("r", 1, "outlier_misinterpretation"), ("r", 2, "missing_limitations"), ("r", 2, "outlier_misinterpretation"),
        ("r", 2, "redundancy"), ("s", 2, "missing_limitations"), ("s", 2, "redundancy"),
    ]
