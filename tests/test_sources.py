from __future__ import annotations

import pytest

from tablescope import sources
from tablescope.functions import redact_credentials
from tablescope.operators.charts import chart_points
from pyspark.sql import functions as F

from tablescope.operators.history import HistoryStore


def test_csv_types_and_missing(spark, tmp_path):
    path = tmp_path / "sales.csv"
    path.write_text(
        'A,B,C,D,E,F,G\n1,x,2023-01-01,1.5,true,9223372036854775807,\n2,"y, ""z""",2023-01-02,N/A,False,12,NA\n'
        ",NULL,2023-01-03,-inf,,99999999999999999999,nan\n"
    )
    (name, df), = sources.load_csv(spark, str(path)).items()
    assert name == "sales"
    assert dict(df.dtypes) == {"A": "bigint", "B": "string", "C": "string", "D": "double", "E": "boolean", "F": "string", "G": "double"}
    rows = [tuple(r) for r in df.collect()]
    assert rows[0] == (1, "x", "2023-01-01", 1.5, True, "9223372036854775807", None)
    assert rows[1] == (2, 'y, "z"', "2023-01-02", None, False, "12", None)
    assert rows[2][:2] == (None, None) and rows[2][3] == float("-inf") and rows[2][4] is None
    assert spark.table("sales").count() == 3


def test_csv_with_schema(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text("x,y\n1,NA\n2,b\n")
    df = sources.load_csv(spark, str(path), "x long, y string")["t"]
    assert [tuple(r) for r in df.collect()] == [(1, None), (2, "b")]


def test_table_set(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "b.parquet"))
    spark.range(4).write.parquet(str(tmp_path / "a"))
    (tmp_path / "notes.txt").write_text("no table")
    ts = sources.load_table_set(spark, str(tmp_path))
    assert list(ts) == ["a", "b"]
    assert [tuple(r) for r in sources.row_counts(ts).collect()] == [("a", 4, 1), ("b", 3, 1)]
    assert sources.total_rows(ts).first()[0] == 7
    assert list(sources.load_table_set(spark, str(tmp_path), tables=["b", "a"])) == ["b", "a"]
    with pytest.raises(FileNotFoundError):
        sources.load_table_set(spark, str(tmp_path), tables=["c"])


def test_catalog(spark):
    spark.range(5).createOrReplaceTempView("`order by`")
    found = sources.load_catalog(spark)
    assert found["order by"].count() == 5


def test_samples_do_not_depend_on_partitions(spark):
    df = spark.range(1000).selectExpr("id", "id / 3 AS x")
    first = sources.bounded_sample(df, 20).collect()
    assert len(first) == 20
    assert sources.bounded_sample(df.repartition(7), 20).collect() == first
    assert sources.column_samples(df).collect() == sources.column_samples(df.repartition(7)).collect()
    assert all(round(r["x"], 4) == r["x"] for r in sources.semantic_sample(df, 5).collect())
    assert sources.semantic_sample(df.limit(0)).count() == 0


@pytest.mark.parametrize("hashing", ["xxhash64", "md5"])
def test_column_samples_skip_missing(frame, hashing):
    df = frame("a double, b string", [1.0, float("nan"), None], [None, None, None])
    rows = {r["column"]: r["sample_values"] for r in sources.column_samples(df, 3, hashing).collect()}
    assert set(rows["a"]) == {"1.0"} and rows["b"] == []


def test_missing_norm(frame):
    df = sources.missing_norm(frame("a double, b string", [1.0, float("nan")], ["NA", "x"]), ["NA"])
    assert [tuple(r) for r in df.collect()] == [(1.0, None), (None, "x")]


def test_redact(frame):
    df = frame("u string", ["postgresql://me:pw@host/db", "http://plain/x", "sqlite:///f.db"])
    got = [r[0] for r in df.select(redact_credentials("u")).collect()]
    assert got == ["postgresql://me:***@host/db", "http://plain/x", "sqlite:///f.db"]


def test_chart_points(frame):
    df = frame("k string, v double", [*"abcdefghi", None], [1.0, 2.0, None, 4.0, 5.0, 6.0, 7.0, 8.0, 9.0, 99.0])
    assert [(r["ord"], r["label"], r["value"]) for r in chart_points(df, "k", "v").orderBy("ord").collect()] == [
        (1, "i", 9.0), (2, "h", 8.0), (3, "g", 7.0), (4, "f", 6.0), (5, "e", 5.0), (6, "d", 4.0), (7, "b", 2.0)
    ]
    # The point without a value is dropped after the cut to seven.
    assert [r["label"] for r in chart_points(df, "k", "v", by="label").orderBy("ord").collect()] == list("abdefg")


def test_history_store(spark, tmp_path):
    from datetime import datetime

    store = HistoryStore(spark, str(tmp_path / "memory"))
    family = "0123456789012345"  # digits only
    assert store.load(family)["joins"].count() == 0
    joins = lambda rows: spark.createDataFrame(
        rows,
        "schema_hash string, left_table string, right_table string, on_column string, join_type string, result_name string, "
        "row_count long, score double, created_at timestamp_ntz, last_seen_at timestamp_ntz, seq long",
    )
    warnings = lambda rows: spark.createDataFrame(
        rows, "schema_hash string, finding_type string, affected string, reason string, severity string, approved boolean, seq long"
    )
    t1, t2 = datetime(2024, 1, 1), datetime(2025, 3, 1)
    key = (family, "orders", "customers", "customer_id", "inner")
    w = (family, "redundancy", "loyalty_points")
    assert store.persist(family, joins([(*key, "first", 10, 0.5, t1, t1, 0)]), warnings([(*w, "why", "warn", False, 0), (family, "x", "y", "z", "block", False, 1)]), t1) == 1
    assert store.persist(family, joins([(*key, "second", 20, 0.82, t2, t2, 0)]), warnings([(*w, "other", "block", True, 0), (*w, "other", "warn", True, 1)]), t2) == 2
    store.persist("other", joins([]), warnings([]), t2)
    got = store.load(family)
    assert [tuple(r) for r in got["joins"].collect()] == [(*key, "first", 20, 0.82, t1, t2)]
    assert [tuple(r) for r in got["warnings"].collect()] == [(*w, "why", "warn", 3, t1, t2)]
    assert [tuple(r) for r in got["runs"].collect()] == [(family, 2, t2)]
    assert store.prune(family, 365, datetime(2025, 3, 2)) == 0
    assert store.prune(family, 10, datetime(2025, 3, 20)) == 1
    assert store.load(family)["joins"].count() == 0 and store.load("other")["runs"].first()["total_runs"] == 1


# ------------------------------------------------------------------ folders and files


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)
    return str(path)


def test_quoted_line_breaks_stay_in_their_cell(spark, tmp_path):
    path = write(tmp_path / "notes.csv", 'id,note\n1,"two\nlines, ""quoted"""\n2,plain\n3\n')
    rows = [tuple(r) for r in sources.load_csv(spark, path)["notes"].orderBy("id").collect()]
    assert rows == [(1, 'two\nlines, "quoted"'), (2, "plain"), (3, None)]
    given = sources.load_csv(spark, path, schema="id int, note string")["notes"]
    assert given.count() == 3 and given.dtypes == [("id", "int"), ("note", "string")]


@pytest.mark.parametrize("schema", [None, "id int, note string"])
def test_a_row_with_too_many_cells_is_an_error(spark, tmp_path, schema):
    path = write(tmp_path / "wide.csv", "id,note\n1,fine\n2,one,EXTRA\n")
    with pytest.raises(Exception, match="more cells"):
        sources.load_csv(spark, path, schema=schema)["wide"].collect()


def test_names_with_dots_and_other_entries(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "sales.v1"))
    spark.range(4).write.parquet(str(tmp_path / "orders.parquet"))
    write(tmp_path / "readme.txt", "x")
    write(tmp_path / "_SUCCESS", "")
    found = sources.load_table_set(spark, str(tmp_path))
    assert {n: df.count() for n, df in found.items()} == {"orders": 4, "sales.v1": 3} and found.skipped == ["readme.txt"]
    assert sources.full_scan(spark, "sales.v1").count() == 3
    assert sources.load_catalog(spark)["sales.v1"].count() == 3
    spark.catalog.dropTempView("`sales.v1`")
    spark.range(1).write.parquet(str(tmp_path / "orders"))
    with pytest.raises(ValueError, match="two paths"):
        sources.load_table_set(spark, str(tmp_path))


def test_options_reach_the_csv_reader(spark, tmp_path):
    write(tmp_path / "a.csv", "k,v\n1,x\n")
    found = sources.load_table_set(spark, str(tmp_path), "csv", schemas={"a": "k string, v string"}, multiline=False)
    assert found["a"].dtypes == [("k", "string"), ("v", "string")]


def test_two_writers_of_a_family(spark, tmp_path):
    store = HistoryStore(spark, str(tmp_path / "h"))
    store._fs.create(store._path(f"{store._home('f')}/current-1"), False).close()
    with pytest.raises(Exception, match="exists"):
        store._fs.create(store._path(f"{store._home('f')}/current-1"), False)


def test_a_writer_with_a_stale_version_folds_into_the_newer_one(spark, tmp_path):
    from datetime import datetime

    from tablescope.operators import history as h

    store = HistoryStore(spark, "file://" + str(tmp_path / "h"))
    warn = spark.createDataFrame([], h.SCHEMAS["warnings"]).select(
        "schema_hash", "finding_type", "affected", "reason", "severity", F.lit(False).alias("approved"), F.lit(0).cast("long").alias("seq")
    )

    def joins(table, at):
        rows = [("f", table, "b", "k", "inner", "r", 1, 0.0, at, at, 1)]
        return spark.createDataFrame(rows, h.SCHEMAS["joins"] + ", seq long")

    assert store.persist("f", joins("a1", datetime(2024, 1, 1)), warn, datetime(2024, 1, 1)) == 1
    stale = store.version("f")
    assert store.persist("f", joins("a2", datetime(2024, 1, 2)), warn, datetime(2024, 1, 2), read_version=stale) == 2
    # this writer read version 1 too: it loses version 2, folds into it and makes version 3
    assert store.persist("f", joins("a3", datetime(2024, 1, 3)), warn, datetime(2024, 1, 3), read_version=stale) == 3
    got = store.load("f")
    assert sorted(r.left_table for r in got["joins"].collect()) == ["a1", "a2", "a3"]
    assert [tuple(r) for r in got["runs"].select("total_runs").collect()] == [(3,)]
    # the version before stays readable, older ones and the loser's folder are gone
    assert sorted(r.left_table for r in store.load("f", 2)["joins"].collect()) == ["a1", "a2"]
    home = store._home("f")
    assert sorted(e for e in store._entries(home) if e.startswith("current-")) == ["current-2", "current-3"]
    assert len([e for e in store._entries(home) if e.startswith("attempt=")]) == 2
    assert store.families() == ["f"] and store.tables()["joins"].count() == 3


def test_csv_parts_are_read_by_their_headers(spark, tmp_path):
    folder = tmp_path / "t.csv"
    folder.mkdir()
    write(folder / "part-0.csv", "a,b\n1,x\n3,z\n")
    write(folder / "part-1.csv", "b,a\ny,2\n")
    write(folder / "part-2.csv", "a\n4\n")
    got = sources.load_csv(spark, str(folder))["t"]
    assert sorted(tuple(r) for r in got.collect()) == [(1, "x"), (2, "y"), (3, "z"), (4, None)]
    typed = sources.load_csv(spark, str(folder), schema="a long, b string")["t"]
    assert sorted(tuple(r) for r in typed.collect()) == [(1, "x"), (2, "y"), (3, "z"), (4, None)]
    write(folder / "part-3.csv", "a,c\n5,q\n")
    with pytest.raises(ValueError, match="c"):
        sources.load_csv(spark, str(folder))
