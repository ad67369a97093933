from __future__ import annotations

import hashlib
import json
import random
from datetime import date, datetime, timedelta
from decimal import Decimal

import pytest

from tablescope.operators import discover as d
from tablescope.operators.stats import column_stats, distinct_count, nonfinite_scan


def category(df, exact=False):
    return {r["column"]: r["category"] for r in d.columns_table({"t": df}, exact).collect()}


@pytest.mark.parametrize("exact", [False, True])
def test_categories(frame, exact):
    """One table of parcels; per column what the rules make of its name, type and spread."""
    rows = range(240)
    columns = {
        "left_depot timestamp": ([datetime(2031, 5, 1, 6) + timedelta(hours=i // 8) for i in rows], "datetime"),
        "promised date": ([date(2031, 6, 1 + i // 12) for i in rows], "datetime"),
        "parcel_id long": ([7_000_000 + 13 * i for i in rows], "id_like"),
        "courier_key int": ([i % 6 for i in rows], "id_like"),
        "depot_code string": ([f"D{i % 9}" for i in rows], "id_like"),
        "shelf_num int": ([i % 17 for i in rows], "id_like"),
        "sealed boolean": ([i % 7 > 0 for i in rows], "numeric_discrete"),
        "stops int": ([i % 5 for i in rows], "numeric_discrete"),
        "weight decimal(8,3)": ([Decimal(i % 90) / 8 for i in rows], "numeric_continuous"),
        "service string": ([("slow", "fast", "same day")[i % 3] for i in rows], "categorical_low_cardinality"),
        "street string": ([f"street {i % 33}" for i in rows], "categorical_high_cardinality"),
        "remark string": ([f"remark {i}" for i in rows], "free_text"),
    }
    df = frame(", ".join(columns), *[values for values, _ in columns.values()])
    assert category(df, exact) == {name.split()[0]: kind for name, (_, kind) in columns.items()}


@pytest.mark.parametrize("exact", [False, True])
@pytest.mark.parametrize(
    "kind, distinct, rows, expected",
    [
        ("string", 14, 300, "categorical_low_cardinality"),
        ("string", 15, 300, "categorical_high_cardinality"),
        ("string", 100, 300, "categorical_high_cardinality"),
        ("string", 101, 300, "free_text"),
        ("int", 19, 300, "numeric_discrete"),
        ("int", 20, 300, "numeric_continuous"),
        ("int", 50, 60, "numeric_continuous"),
        ("int", 51, 60, "id_like"),
        ("int", 60, 100, "numeric_continuous"),  # ratio exactly 0.6
        ("int", 61, 100, "id_like"),
        ("double", 600, 1000, "numeric_continuous"),
        ("double", 601, 1000, "id_like"),
    ],
)
def test_thresholds(frame, kind, distinct, rows, expected, exact):
    make = {"string": str, "int": int, "double": float}[kind]
    assert category(frame(f"x {kind}", [make(i % distinct) for i in range(rows)]), exact) == {"x": expected}


def test_missing_is_not_a_value(frame):
    df = frame("x double, y int", [1.0, float("nan"), None, 1.0], [None, None, None, None])
    rows = {r["column"]: r for r in column_stats(df, exact=True).collect()}
    assert (rows["x"]["n_missing"], rows["x"]["n_distinct"]) == (2, 1)
    assert (rows["y"]["n_missing"], rows["y"]["n_distinct"]) == (4, 0)
    assert [r["n_distinct"] for r in column_stats(df).collect()] == [1, 0]


def test_empty_table(spark):
    df = spark.createDataFrame([], "x double, y string")
    assert category(df) == {"x": "numeric_discrete", "y": "categorical_low_cardinality"}


def test_nested_columns_have_no_category(spark):
    df = spark.sql("SELECT array(1, 2) AS a, map('k', 1) AS m, struct(1 AS f) AS s, 1 AS x")
    assert category(df) == {"a": None, "m": None, "s": None, "x": "numeric_discrete"}


def test_samples_are_values_of_the_column(frame):
    df = frame("a int, b string", list(range(50)), [None] * 49 + ["only"])
    rows = {r["column"]: r["sample_values"] for r in d.columns_table({"t": df}).collect()}
    assert len(rows["a"]) == 3 and set(rows["a"]) <= {str(i) for i in range(50)}
    assert set(rows["b"]) == {"only"}


def columns_of(spark, **tables):
    rows = [(t, pos, i, c, cat) for pos, (t, cs) in enumerate(tables.items()) for i, (c, cat) in enumerate(cs)]
    return spark.createDataFrame(rows, '`table` string, pos int, ordinal int, column string, category string')


def test_name_candidates(spark):
    def found(**tables):
        return [tuple(r)[:5] for r in d.name_candidates(columns_of(spark, **tables)).collect()]

    key, low, high, number, text = "id_like", "categorical_low_cardinality", "categorical_high_cardinality", "numeric_continuous", "free_text"
    parcels = [("depot_code", key), ("weight", number), ("remark", text), ("service", low)]
    depots = [("depot_code", key), ("weight", number), ("remark", text), ("service", low), ("roof", low)]
    assert sorted(found(parcels=parcels, depots=depots)) == [
        ("parcels", "depot_code", "depots", "depot_code", 0.9), ("parcels", "service", "depots", "service", 0.7)
    ]
    # one table alone and names that differ give nothing, three tables give each pair
    assert found(parcels=parcels) == found(parcels=parcels[:1], vans=[("van_code", key)]) == []
    chain = found(parcels=parcels[:1], depots=depots[:1], lanes=[("DEPOT_CODE", key)])
    assert [(a, b) for a, _, b, *_ in chain] == [("parcels", "depots"), ("parcels", "lanes"), ("depots", "lanes")]
    assert chain[-1][3] == "DEPOT_CODE"
    # only side a is tested
    assert found(a=[("street", high)], b=[("street", low)]) == [] and len(found(a=[("street", low)], b=[("street", high)])) == 1
    # of two names that are equal but for case the last one counts
    twice = [("Lane_Key", text), ("lane_key", key)]
    assert found(a=twice, b=[("LANE_KEY", key)])[0][1] == "lane_key"


def verify(spark, tables, *pairs, method="exact", k=500):
    cands = spark.createDataFrame(
        [(a, c, b, e, 0.9, "name_match") for a, c, b, e in pairs],
        "table_a string, column_a string, table_b string, column_b string, confidence double, detection_method string",
    )
    return d.verify_overlap(tables, cands, method, k).collect()


@pytest.mark.parametrize("method", ["exact", "sampled", "sketch"])
@pytest.mark.parametrize("common", [0, 8, 9, 30, 47, 48, 60])
@pytest.mark.parametrize("often", [(1, 1), (1, 3), (3, 1), (2, 2)])
def test_value_overlap(frame, spark, method, common, often):
    """60 keys on side a, 75 on side b; what comes out follows from the rules and the numbers."""
    a = [10_000 + 7 * i for i in range(60)]
    b = a[60 - common :] + [90_000 + i for i in range(75 - common)]
    ts = {"a": frame("k int", [*a, None] * often[0]), "b": frame("k int", b * often[1])}
    rows = verify(spark, ts, ("a", "k", "b", "k"), method=method)
    if common / 60 < 0.15:
        assert rows == []
        return
    full = {(1, 1): "one_to_one", (1, 3): "one_to_many", (3, 1): "many_to_one", (2, 2): "many_to_many"}[often]
    (row,) = rows
    assert row["cardinality_full"] == full and row["detection_method"] == "combined"
    assert row["cardinality"] == ("unknown" if full == "many_to_one" else full)
    assert row["overlap_ratio"] == pytest.approx(common / 60) and row["b_in_a_ratio"] == pytest.approx(common / 75)
    assert row["join_hint"] == ("inner" if common / 75 > 0.8 else "left")


def test_no_overlap_without_values(frame, spark):
    assert verify(spark, {"a": frame("k int", [None, None]), "b": frame("k int", [4, 5])}, ("a", "k", "b", "k")) == []


def test_overlap_across_types(frame, spark):
    ts = {
        "a": frame("k int", list(range(30))),
        "b": frame("k double", [float(i) for i in range(30)]),
        "c": frame("k decimal(12,2)", [Decimal(i) for i in range(30)]),
        "s": frame("k string", [str(i) for i in range(30)]),
    }
    rows = verify(spark, ts, ("a", "k", "b", "k"), ("a", "k", "c", "k"), ("a", "k", "s", "k"))
    assert [r["overlap_ratio"] for r in rows] == [1.0, 1.0, 1.0]


def test_long_keys_stay_exact(frame, spark):
    big = 2**60
    ts = {"a": frame("k long", [big + i for i in range(50)]), "b": frame("k long", [big + 50 + i for i in range(50)])}
    assert verify(spark, ts, ("a", "k", "b", "k")) == []


def test_absent_table_and_column(frame, spark):
    ts = {"a": frame("k int", [1, 2])}
    rows = verify(spark, ts, ("a", "k", "gone", "k"), ("a", "nope", "a", "k"))
    assert [(r["table_b"], r["detection_method"], r["confidence"], r["join_hint"], r["cardinality"]) for r in rows] == [
        ("gone", "name_match", 0.9, "unknown", "unknown")
    ]


def test_many_tables_share_a_key(frame, spark):
    """More tables than bits in a mask word."""
    n = 70
    ts = {f"t{i:02d}": frame("k int", [i, i + 1, i + 2]) for i in range(n)}
    rows = verify(spark, ts, *[("t00", "k", f"t{i:02d}", "k") for i in range(1, n)], ("t68", "k", "t69", "k"))
    got = {(r["table_a"], r["table_b"]): round(r["overlap_ratio"], 3) for r in rows}
    assert got == {("t00", "t01"): 0.667, ("t00", "t02"): 0.333, ("t68", "t69"): 0.667}


def test_discover(frame):
    customers = frame(
        "customer_id int, name string, region string", list(range(1, 51)), [f"n{i}" for i in range(50)], ["North", "South"] * 25
    )
    orders = frame(
        "order_id int, customer_id int, amount double",
        list(range(100, 200)), [i % 50 + 1 for i in range(100)], [10 + 4.9 * i for i in range(100)],
    )
    found = d.discover({"customers": customers, "orders": orders})
    assert [tuple(r) for r in found.tables.collect()] == [("customers", 50, 3), ("orders", 100, 3)]
    assert found.total_rows.first()[0] == 150
    (rel,) = found.relationships.collect()
    assert (rel["cardinality"], rel["join_hint"], rel["confidence"]) == ("one_to_many", "inner", 1.0)
    assert found.suggestions.first()["suggestion"] == "customers INNER JOIN orders ON customer_id (confidence: 100%)"


def reference_hash(tables):
    text = json.dumps({t: sorted(c) for t, c in sorted(tables.items())}, separators=(",", ":"), sort_keys=True)
    return hashlib.sha256(text.encode()).hexdigest()[:16]


@pytest.mark.parametrize(
    "tables",
    [
        {"orders": ["id", "amount", "customer_id"], "customers": ["id", "name", "region"]},
        {"customers": ["region", "name", "id"], "orders": ["customer_id", "id", "amount"]},
        {"empty": []},
        {'q"uo\\te\n': ["größe", "naïve\t", "表", "😀", "\x7f", "\x01", "a b"], "Z": ["_"]},
    ],
)
def test_fingerprint(spark, tables):
    rows = [(t, c) for t, cs in tables.items() for c in (cs or [None])]
    got = d.schema_fingerprint(spark.createDataFrame(rows, "`table` string, column string")).first()[0]
    assert got == reference_hash(tables)


def test_fingerprint_per_dataset(spark):
    rows = [("x", "t", "a"), ("x", "t", "b"), ("y", "t", "b"), ("y", "t", "a"), ("z", "t", "c")]
    df = d.schema_fingerprint(spark.createDataFrame(rows, "ds string, `table` string, column string"), "ds")
    got = {r["ds"]: r["schema_hash"] for r in df.collect()}
    assert got["x"] == got["y"] == reference_hash({"t": ["a", "b"]}) != got["z"]


def test_domain(spark):
    def tag(*names):
        return tuple(d.domain_tag(spark.createDataFrame([("t", n) for n in names], "`table` string, column string")).first())

    assert tag("patient_age", "diagnosis", "price") == ("HEALTHCARE", 2)
    assert tag("patient", "price") == ("GENERAL", 1)
    assert tag("x") == ("GENERAL", 0)


def test_nonfinite(frame):
    df = frame("x double, y int", [1.0, float("nan"), float("-inf"), None], [1, 2, 3, 4])
    assert [tuple(r) for r in nonfinite_scan(df).collect()] == [("x", 1, 1, 1, False), ("y", 0, 0, 0, True)]


def test_distinct_count(frame):
    df = frame("a int, b string", [1, 1, None], [None, None, None])
    assert distinct_count(df, "a", "b").first().asDict() == {"a": 1, "b": 0, "n_rows": 3}


def test_overlap_rows_do_not_grow_with_the_mixes(frame, spark):
    """Forty tables share a key in many mixes; one number per column and candidate comes back."""
    rng = random.Random(8)
    keys = [[k for k in range(200) if rng.random() < 0.6] for _ in range(40)]
    ts = {f"t{i}": frame("k int", ks) for i, ks in enumerate(keys)}
    cands = [
        {"table_a": f"t{i}", "column_a": "k", "table_b": f"t{j}", "column_b": "k"} for i in range(40) for j in range(i + 1, 40) if (i + j) % 7 == 0
    ]
    rows = spark.createDataFrame([tuple(c.values()) for c in cands], "table_a string, column_a string, table_b string, column_b string").collect()
    for c, found in d.key_overlap(ts, rows).items():
        a, b = (set(keys[int(c[x][1:])]) for x in ("table_a", "table_b"))
        assert found == (len(a), len(b), len(a & b))
    sides, place = d._sides(ts, rows)
    pairs = {}
    for c in rows:
        g, at = place[(c["table_a"], "k")]
        pairs.setdefault(g, []).append((at, place[(c["table_b"], "k")][1]))
    assert d.shared_values(ts, sides, pairs).count() == 40 + len(rows)


def test_samples_and_flags_of_a_discovery(frame):
    ts = {"a": frame("a_id int, v double", list(range(40)), [i / 3 for i in range(40)])}
    found = d.discover(ts)
    assert {n: df.count() for n, df in found.samples.items()} == {"a": 5}
    flags = {r["column"]: r["exact"] for r in d.columns_table(ts, exact=True).collect()}
    assert flags == {"a_id": True, "v": True} and {r["exact"] for r in found.columns.collect()} <= {True, False}


@pytest.mark.parametrize("shared", [0.1, 0.149, 0.151, 0.5, 0.899, 0.901, 1.0])
def test_sketch_verdicts_equal_exact_ones_beyond_the_nominal_entries(frame, spark, monkeypatch, shared):
    """With sketches of 256 entries and 3,000 keys a side, estimates carry error: verdicts still equal the exact ones."""
    monkeypatch.setattr(d, "SKETCH_LG", 8)
    n = 3000
    a = list(range(n))
    b = a[: int(shared * n)] + [10**6 + i for i in range(n - int(shared * n))]
    ts = {"a": frame("k long", a + a[:5]), "b": frame("k long", b)}
    exact = verify(spark, ts, ("a", "k", "b", "k"), method="exact")
    got = verify(spark, ts, ("a", "k", "b", "k"), method="sketch")
    verdict = lambda rows: [(r["cardinality_full"], r["join_hint"]) for r in rows]
    assert verdict(got) == verdict(exact)
    for g, e in zip(got, exact):
        assert abs(g["overlap_ratio"] - e["overlap_ratio"]) <= 3 * 2 / 16


def test_schema_columns_need_no_pass(frame, spark):
    ts = {"a": frame("k int, name string", [1, 2], ["x", "y"]), "b": frame("price double", [1.0])}
    from_schema = d.schema_fingerprint(d.schema_columns(ts)).first()[0]
    assert from_schema == d.schema_fingerprint(d.columns_table(ts, samples=0)).first()[0]
    assert [tuple(r) for r in d.schema_columns(ts).collect()] == [("a", 0, 0, "k", "integer"), ("a", 0, 1, "name", "text"), ("b", 1, 0, "price", "number")]
