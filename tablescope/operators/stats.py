"""Per-column statistics: rows, missing, distinct, non-finite."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions import classifiable, clean, col, is_boolean, is_floating, is_integral, is_missing, is_number

# A category changes only at 15, 20, 51 and 101 values and at a ratio of 0.6, so only near those must an
# estimate be made exact; elsewhere it is five standard errors or more away.
CLOSE_COUNTS = [(12, 23), (45, 57), (91, 112)]
CLOSE_RATIO = (0.5, 0.7)
SKETCH_BITS = 12  # 4096 registers, relative error 1.6%

STATS_SCHEMA = (
    "ordinal int, column string, dtype string, n_rows long, n_missing long, n_distinct long, exact boolean"
)


@dataclass(frozen=True)
class ColumnStat:
    ordinal: int
    column: str
    dtype: str
    n_rows: int
    n_missing: int
    n_distinct: int | None
    exact: bool


def approx_distinct(value: Column) -> Column:
    """Distinct count by a sketch of the values' hashes; null is not counted."""
    hashed = F.when(value.isNotNull(), F.xxhash64(value))
    return F.hll_sketch_estimate(F.hll_sketch_agg(hashed, SKETCH_BITS))


def _comparable(df: DataFrame, name: str) -> tuple[str, Column]:
    """A type family and the column in it, so that many columns share one shuffle per family."""
    dtype, value = df.schema[name].dataType, clean(df, name)
    if is_integral(dtype) or is_boolean(dtype):
        return "long", value.cast("long")
    if is_floating(dtype):
        return "double", value.cast("double")
    if isinstance(dtype, T.StringType):
        # Long texts travel as their sha-256.
        return "string", F.when(F.length(value) > 64, F.sha2(value, 256)).otherwise(value)
    return dtype.simpleString(), value


def exact_distinct(df: DataFrame, names: list[str]) -> DataFrame:
    """(column, n_distinct) for many columns.

    Each column is a scan of its own that reads nothing else; equal values combine before the shuffle, and
    columns of one type family share it.
    """
    families: dict[str, list[DataFrame]] = {}
    for name in names:
        family, value = _comparable(df, name)
        cells = df.select(F.lit(name).alias("column"), value.alias("v")).where(F.col("v").isNotNull())
        families.setdefault(family, []).append(cells)
    return reduce(
        DataFrame.unionAll,
        [
            reduce(DataFrame.unionAll, parts).distinct().groupBy("column").agg(F.count("*").alias("n_distinct"))
            for parts in families.values()
        ],
    )


def measure(df: DataFrame, exact: bool = False, extra: dict[str, Column] | None = None) -> tuple[list[ColumnStat], dict]:
    """Statistics of every column as driver values, and ``extra`` aggregates from the same pass.

    Pass 1 is one aggregate over the table.  Distinct counts are estimates there; a second pass makes
    exact those that lie near a category threshold (or all, with ``exact``).
    """
    fields = df.schema.fields
    usable = [f.name for f in fields if classifiable(f.dataType)]
    aggs = [F.count("*").alias("n")]
    for i, f in enumerate(fields):
        aggs.append(F.count_if(is_missing(df, f.name)).alias(f"m{i}"))
        if f.name in usable and not exact:
            aggs.append(approx_distinct(clean(df, f.name)).alias(f"d{i}"))
    for name, agg in (extra or {}).items():
        aggs.append(agg.alias(name))
    row = df.agg(*aggs).first()
    n = row["n"]
    counts: dict[str, int] = {}
    sure: set[str] = set()
    if exact:
        counts = dict.fromkeys(usable, 0)
        if usable:
            counts.update({r["column"]: r["n_distinct"] for r in exact_distinct(df, usable).collect()})
        sure = set(usable)
    else:
        # An estimate can exceed the number of values there are.
        counts = {f.name: min(row[f"d{i}"] or 0, n - row[f"m{i}"]) for i, f in enumerate(fields) if f.name in usable}
        few = [c for c in usable if any(a <= counts[c] <= b for a, b in CLOSE_COUNTS)]
        ratio = [c for c in usable if c not in few and n and CLOSE_RATIO[0] <= counts[c] / n <= CLOSE_RATIO[1]]
        if few and n:
            # At most about a hundred values each, so the sets stay small.
            found = df.agg(*[F.size(F.collect_set(clean(df, c))).alias(f"c{i}") for i, c in enumerate(few)]).first()
            counts.update({c: found[f"c{i}"] for i, c in enumerate(few)})
        if ratio:
            counts.update({r["column"]: r["n_distinct"] for r in exact_distinct(df, ratio).collect()})
        sure = {*few, *ratio}
    stats = [
        ColumnStat(i, f.name, f.dataType.simpleString(), n, row[f"m{i}"], counts.get(f.name), f.name in sure)
        for i, f in enumerate(fields)
    ]
    return stats, {name: row[name] for name in (extra or {})}


def column_stats(df: DataFrame, exact: bool = False) -> DataFrame:
    """n_rows, n_missing and n_distinct (missing not counted) per column."""
    stats, _ = measure(df, exact)
    rows = [(s.ordinal, s.column, s.dtype, s.n_rows, s.n_missing, s.n_distinct, s.exact) for s in stats]
    return df.sparkSession.createDataFrame(rows, STATS_SCHEMA)


def distinct_count(df: DataFrame, *names: str) -> DataFrame:
    """One row with the exact distinct count of each named column and the row count."""
    counts = exact_distinct(df, list(names)).groupBy().pivot("column", list(names)).agg(F.first("n_distinct"))
    return counts.na.fill(0).withColumn("n_rows", df.agg(F.count("*").alias("n")).scalar())


def nonfinite_scan(df: DataFrame) -> DataFrame:
    """Null, NaN and infinite cells per column; ``citable`` only if there are none."""
    aggs, cells = [], []
    for i, f in enumerate(df.schema.fields):
        value = col(f.name)
        aggs.append(F.count_if(value.isNull()).alias(f"n{i}"))
        if is_floating(f.dataType):
            aggs.append(F.count_if(F.isnan(value)).alias(f"x{i}"))
            aggs.append(F.count_if(value.isin(float("inf"), float("-inf"))).alias(f"f{i}"))
        nan = F.col(f"x{i}") if is_floating(f.dataType) else F.lit(0).cast("long")
        inf = F.col(f"f{i}") if is_floating(f.dataType) else F.lit(0).cast("long")
        cells.append(
            F.struct(
                F.lit(f.name).alias("column"),
                F.col(f"n{i}").alias("null_count"),
                nan.alias("nan_count"),
                inf.alias("inf_count"),
                ((F.col(f"n{i}") + nan + inf) == 0).alias("citable"),
            )
        )
    return df.agg(*aggs).select(F.inline(F.array(*cells)))


def numeric_columns(df: DataFrame) -> list[str]:
    """Number columns (booleans are not among them)."""
    return [f.name for f in df.schema.fields if is_number(f.dataType)]


def discrete(stats: list[ColumnStat], limit: int = 20) -> set[str]:
    """Columns with fewer than ``limit`` distinct values, for which quartile fences mean nothing."""
    return {s.column for s in stats if s.n_distinct is not None and s.n_distinct < limit}
