"""Profiles: outliers by quartile fences, missing data, Pearson correlations."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import col, is_boolean, is_missing, is_number, required, value_of
from ..plans.quantiles import quantiles
from .stats import ColumnStat, discrete, measure, numeric_columns

FENCE = 1.5
PAIRS_PER_PASS = 200  # aggregates of one pass stay within code generation limits


@dataclass(frozen=True)
class TablePlan:
    """What to leave out and what to correlate for one table."""

    table: str
    should_profile: bool = True
    id_like: list[str] = field(default_factory=list)
    exclude: list[str] = field(default_factory=list)
    corr_columns: list[str] = field(default_factory=list)


@dataclass
class Profile:
    outliers: DataFrame
    missing: DataFrame
    missing_total: DataFrame
    correlations: DataFrame


def drop_planned(df: DataFrame, plan: TablePlan) -> DataFrame:
    gone = {*plan.id_like, *plan.exclude}
    return df.select(*[col(c) for c in df.columns if c not in gone])


def correlation_columns(df: DataFrame, plan: TablePlan) -> list[str] | None:
    """The planned correlation columns that remain; None (use all) if fewer than two."""
    chosen = [c for c in plan.corr_columns if c in df.columns]
    return chosen if len(chosen) >= 2 else None


# ------------------------------------------------------------------ quartiles and outliers


def quartiles(df: DataFrame, columns: list[str], method: str = "exact") -> DataFrame:
    """q1 and q3 per column by linear interpolation, missing values left out."""
    required(df, *columns)
    found = quantiles(df, {c: value_of(df, c) for c in columns}, [0.25, 0.75], method)
    rows = [(c, q[0], q[1]) for c, q in found.items()]
    return df.sparkSession.createDataFrame(rows, "column string, q1 double, q3 double")


def detect_outliers(df: DataFrame, column: str, method: str = "exact", samples: int = 5) -> DataFrame:
    required(df, column)
    return outlier_report(df, [column], method=method, samples=samples, skip_discrete=False)


def outlier_report(
    df: DataFrame,
    columns: list[str] | None = None,
    skip_discrete: bool = True,
    method: str = "exact",
    samples: int = 5,
    stats: list[ColumnStat] | None = None,
) -> DataFrame:
    """Values beyond the quartile fences, per numeric column; percent is of all rows.

    One pass for the quartiles of all columns, one for all counts.  An empty table gives no rows.
    """
    names = columns if columns is not None else numeric_columns(df)
    required(df, *names)
    if skip_discrete and names:
        stats = stats or measure(df.select(*[col(c) for c in names]))[0]
        names = [c for c in names if c not in discrete(stats)]
    filled = {s.column: s.n_rows - s.n_missing for s in stats or []}
    counts = {c: filled[c] for c in names} if filled.keys() >= set(names) else None
    found = quantiles(df, {c: value_of(df, c) for c in names}, [0.25, 0.75], method, counts)
    fences = {}
    for c, (q1, q3) in found.items():
        if q1 is not None:
            fences[c] = (q1, q3, q1 - FENCE * (q3 - q1), q3 + FENCE * (q3 - q1))
        else:
            fences[c] = (None, None, None, None)  # no value at all
    return _outlier_rows(df, fences, samples)


def outside(value: Column, lower: float | None, upper: float | None) -> Column:
    if lower is None:
        return F.lit(False)
    return (value < F.lit(lower)) | (value > F.lit(upper))


def _outlier_rows(df: DataFrame, fences: dict, samples: int) -> DataFrame:
    spark = df.sparkSession
    schema = (
        "column string, n_rows long, q1 double, q3 double, lower double, upper double, outlier_count long, "
        "outlier_pct double, severity string, sample_values array<double>"
    )
    if not fences:
        return spark.createDataFrame([], schema)
    values = {c: value_of(df, c) for c in fences}
    counted = df.agg(
        F.count("*").alias("n"),
        *[F.count_if(outside(values[c], f[2], f[3])).alias(f"o{i}") for i, (c, f) in enumerate(fences.items())],
    ).select(
        "n",
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(i).alias("i"), F.lit(c).alias("column"),
                        *[F.lit(x).cast("double").alias(n) for n, x in zip(("q1", "q3", "lower", "upper"), f)],
                        F.col(f"o{i}").alias("outlier_count"),
                    )
                    for i, (c, f) in enumerate(fences.items())
                ]
            )
        ),
    )
    cells = [
        F.when(
            outside(values[c], f[2], f[3]),
            F.struct(
                F.lit(i).alias("i"),
                values[c].alias("v"),
                F.greatest(F.lit(f[2]) - values[c], values[c] - F.lit(f[3])).alias("away"),
            ),
        )
        for i, (c, f) in enumerate(fences.items())
        if f[2] is not None
    ]
    pct = F.col("outlier_count") / F.col("n") * 100
    base = counted.where("n > 0").select(
        "i", "column", F.col("n").alias("n_rows"), F.round("q1", 2).alias("q1"), F.round("q3", 2).alias("q3"),
        "lower", "upper", "outlier_count", F.round(pct, 2).alias("outlier_pct"),
        F.when(pct > 10, "high").when(pct > 5, "medium").otherwise("low").alias("severity"),
    )
    if not cells or not samples:
        return base.withColumn("sample_values", F.array().cast("array<double>")).drop("i")
    # Only outlying cells are looked at; each task keeps its few farthest per column before the shuffle.
    far = Window.partitionBy("i").orderBy(F.col("away").desc(), "v")
    hit = reduce(lambda a, b: a | b, [outside(values[c], f[2], f[3]) for c, f in fences.items()])
    top = (
        df.where(hit)
        .select(F.explode(F.array(*cells)).alias("c"))
        .where("c IS NOT NULL")
        .select("c.*")
        .withColumn("r", F.row_number().over(far))
        .where(F.col("r") <= samples)
        .groupBy("i")
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "v"))), lambda s: s["v"]).alias("sample_values"))
    )
    return base.join(top, "i", "left").select(
        *[c for c in base.columns if c != "i"],
        F.coalesce("sample_values", F.array().cast("array<double>")).alias("sample_values"),
    )


# ------------------------------------------------------------------ missing data


def missing_report(df: DataFrame, stats: list[ColumnStat] | None = None) -> DataFrame:
    """Missing cells per column; ``critical`` when more than half are missing (before rounding).

    With ``stats`` of the table it is not read again.
    """
    if stats is None:
        row = df.agg(
            F.count("*").alias("n"), *[F.count_if(is_missing(df, c)).alias(f"m{i}") for i, c in enumerate(df.columns)]
        )
        cells = [F.struct(F.lit(c).alias("column"), F.col(f"m{i}").alias("missing_count")) for i, c in enumerate(df.columns)]
        counted = row.select("n", F.inline(F.array(*cells)))
    else:
        rows = [(s.n_rows, s.column, s.n_missing) for s in stats]
        counted = df.sparkSession.createDataFrame(rows, "n long, column string, missing_count long")
    pct = F.try_divide(F.col("missing_count").cast("double"), F.col("n").cast("double")) * 100
    return counted.select(
        "column", "missing_count", F.round(pct, 2).alias("missing_pct"), F.coalesce(pct > 50, F.lit(False)).alias("critical")
    )


def missing_total(report: DataFrame) -> DataFrame:
    return report.agg(
        F.sum("missing_count").alias("total_missing"),
        F.array_sort(F.collect_list(F.when(F.col("critical"), F.col("column")))).alias("critical_columns"),
    )


# ------------------------------------------------------------------ correlations


def correlated_columns(df: DataFrame) -> list[str]:
    """Numeric and boolean columns."""
    return [f.name for f in df.schema.fields if is_number(f.dataType) or is_boolean(f.dataType)]


def pearson(x: Column, y: Column) -> Column:
    """Pearson r of two columns over the rows that have both, as one aggregate expression.

    Null for fewer than two rows or a constant side.  ``F.corr`` raises on those in ANSI mode.
    """
    both = x.isNotNull() & y.isNotNull()
    px, py = F.when(both, x), F.when(both, y)
    return _ratio(F.covar_pop(px, py), F.var_pop(px), F.var_pop(py), F.min(px) == F.max(px), F.min(py) == F.max(py))


def _ratio(cov: Column, vx: Column, vy: Column, flat_x: Column, flat_y: Column) -> Column:
    r = F.try_divide(cov, F.sqrt(vx) * F.sqrt(vy))
    return F.when(~(flat_x | flat_y) & ~F.isnan(r), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r)))


@dataclass(frozen=True)
class Moments:
    """What one pass over a column tells the correlation pass."""

    missing: int
    mean: float | None
    flat: bool


def moment_aggregates(df: DataFrame, names: list[str]) -> dict[str, Column]:
    out = {}
    for i, c in enumerate(names):
        v = value_of(df, c)
        out.update({f"cm{i}": F.count_if(v.isNull()), f"ca{i}": F.avg(v), f"cf{i}": F.min(v) == F.max(v)})
    return out


def moments_from(names: list[str], row) -> dict[str, Moments]:
    return {c: Moments(row[f"cm{i}"], row[f"ca{i}"], row[f"cf{i}"] is not False) for i, c in enumerate(names)}


def _pairs_row(df: DataFrame, pairs: list[tuple[str, str]], known: dict[str, Moments]) -> DataFrame:
    """(col_x, col_y, r, n) of some pairs from one aggregate of plain sums of deviations from the means.

    Columns without missing values share their own sums over all their pairs.
    """
    names = sorted({c for p in pairs for c in p})
    at = {c: F.col(f"d{i}") for i, c in enumerate(names)}
    values = df.select(*[(value_of(df, c) - F.lit(known[c].mean)).alias(f"d{i}") for i, c in enumerate(names)])
    whole = {c for c in names if known[c].missing == 0}
    aggs = [F.count("*").alias("n")]
    for i, c in enumerate(names):
        if c in whole:
            aggs += [F.sum(at[c]).alias(f"s{i}"), F.sum(at[c] * at[c]).alias(f"q{i}")]
    cells = []
    for i, (x, y) in enumerate(pairs):
        dx, dy = at[x], at[y]
        aggs.append(F.sum(dx * dy).alias(f"p{i}"))
        if x in whole and y in whole:
            sx, qx, sy, qy = (F.col(f"{k}{names.index(c)}") for c in (x, y) for k in ("s", "q"))
            n, flat = F.col("n"), F.lit(known[x].flat or known[y].flat)
        else:
            px, py = F.when(dy.isNotNull(), dx), F.when(dx.isNotNull(), dy)
            aggs += [
                F.count_if(dx.isNotNull() & dy.isNotNull()).alias(f"n{i}"),
                F.sum(px).alias(f"sx{i}"), F.sum(px * px).alias(f"qx{i}"),
                F.sum(py).alias(f"sy{i}"), F.sum(py * py).alias(f"qy{i}"),
                F.coalesce((F.min(px) == F.max(px)) | (F.min(py) == F.max(py)), F.lit(True)).alias(f"f{i}"),
            ]
            sx, qx, sy, qy = (F.col(f"{k}{i}") for k in ("sx", "qx", "sy", "qy"))
            n, flat = F.col(f"n{i}"), F.col(f"f{i}")
        sums = {"n": n, "p": F.col(f"p{i}"), "sx": sx, "qx": qx, "sy": sy, "qy": qy, "flat": flat}
        cells.append(F.struct(F.lit(x).alias("col_x"), F.lit(y).alias("col_y"), *[v.alias(k) for k, v in sums.items()]))
    # One row per pair first, so that the formula is compiled once and not once per pair.
    rows = values.agg(*aggs).select(F.inline(F.array(*cells)))
    part = lambda q, a, b: F.try_divide(F.col(q), F.col("n")) - F.try_divide(F.col(a) * F.col(b), F.col("n") * F.col("n").cast("double"))  # noqa: E731,E501
    r = _ratio(part("p", "sx", "sy"), part("qx", "sx", "sx"), part("qy", "sy", "sy"), F.col("flat"), F.lit(False))
    return rows.select("col_x", "col_y", r.alias("r"), "n")


#: Rows of one step of the co-moment scan, and the most tasks that send their k x k sums on.
COMOMENT_ROWS = 4096
COMOMENT_BYTES = 8 << 30
#: A column whose variance on the rows shared with its partner is below this share of its mean square counts as flat.
FLAT_SHARE = 1e-12


def comoments(df: DataFrame, names: list[str]) -> DataFrame:
    """Pairwise-complete Pearson r of all pairs of ``names`` (both orders and the diagonal) from one scan.

    Each task multiplies its block of deviations (missing as 0) from its first block's means with the block of presence
    masks: per pair (a, b) the rows where both are present, the sums of a and of a squared over those rows, and the sum
    of products: four k x k matrices.  Each task sends row a of each (and the transposed sums), and per column its shift,
    count, sum, least and greatest value, to a grouped sum by a, which moves all sums to the means of the whole columns
    before it adds them.  So the work after the scan is k groups of (tasks x k) numbers, whatever the number of rows.
    Tasks are merged first (without a shuffle) so that at most COMOMENT_BYTES of partial sums travel.
    """
    import numpy as np
    import pandas as pd
    import pyarrow as pa

    k = len(names)
    values = df.select(*[value_of(df, c).cast("double").alias(f"d{i}") for i, c in enumerate(names)])
    pair_sums, column_sums = ("n", "sx", "sy", "qx", "qy", "p"), ("shift", "rows", "total", "least", "most")
    state = (len(pair_sums) + len(column_sums)) * k * k * 8
    tasks = max(1, min(values.rdd.getNumPartitions(), COMOMENT_BYTES // max(state, 1)))
    values = values.coalesce(tasks)

    def scan(batches):
        n = np.zeros((k, k)); s = np.zeros((k, k)); q = np.zeros((k, k)); p = np.zeros((k, k))  # noqa: E702
        shift, least, most = np.full(k, np.nan), np.full(k, np.inf), np.full(k, -np.inf)
        for batch in batches:
            for at in range(0, batch.num_rows, COMOMENT_ROWS):
                part = batch.slice(at, COMOMENT_ROWS)
                x = np.empty((k, part.num_rows))
                for i in range(k):
                    x[i] = part.column(i).to_numpy(zero_copy_only=False)
                m = ~np.isnan(x)
                least = np.fmin(least, np.fmin.reduce(x, axis=1))
                most = np.fmax(most, np.fmax.reduce(x, axis=1))
                mf = m.astype(np.float64)
                fresh = np.isnan(shift)
                if fresh.any():  # columns without a value so far
                    with np.errstate(divide="ignore", invalid="ignore"):
                        mean = np.where(m[fresh], x[fresh], 0.0).sum(axis=1) / m[fresh].sum(axis=1)
                    shift[fresh] = np.where(np.isinf(mean), 0.0, mean)
                with np.errstate(invalid="ignore"):
                    xz = np.where(m, x - shift[:, None], 0.0)
                    n += mf @ mf.T
                    s += xz @ mf.T
                    q += (xz * xz) @ mf.T
                    p += xz @ xz.T
        shift = np.where(np.isnan(shift), 0.0, shift)
        rows, total = np.diag(n), np.diag(s)
        found = {"n": n, "sx": s, "sy": s.T, "qx": q, "qy": q.T, "p": p}
        found |= {c: np.tile(v, (k, 1)) for c, v in zip(column_sums, (shift, rows, total, least, most), strict=True)}
        yield pa.RecordBatch.from_pydict(
            {"a": list(range(k)), **{c: list(v) for c, v in found.items()}},
            schema=pa.schema([("a", pa.int32())] + [(c, pa.list_(pa.float64())) for c in found]),
        )

    sums = values.mapInArrow(scan, ", ".join(["a int", *[f"{c} array<double>" for c in pair_sums + column_sums]]))

    def pairs_of(rows: pd.DataFrame) -> pd.DataFrame:
        a = int(rows["a"].iloc[0])
        of = {c: np.stack(rows[c].to_numpy()) for c in pair_sums + column_sums}
        with np.errstate(divide="ignore", invalid="ignore"):
            total = of["rows"].sum(axis=0)
            mean = (of["shift"] * of["rows"] + of["total"]).sum(axis=0) / total
            mean = np.where(np.isfinite(mean), mean, 0.0)
            dy = of["shift"] - mean  # what the deviations of a task still lack
            dx = dy[:, [a]]
            t = {
                "n": of["n"],
                "sx": of["sx"] + dx * of["n"],
                "sy": of["sy"] + dy * of["n"],
                "qx": of["qx"] + 2 * dx * of["sx"] + dx * dx * of["n"],
                "qy": of["qy"] + 2 * dy * of["sy"] + dy * dy * of["n"],
                "p": of["p"] + dx * of["sy"] + dy * of["sx"] + dx * dy * of["n"],
            }
            t = {c: v.sum(axis=0) for c, v in t.items()}
            n = t["n"]
            flat_known = ~(of["least"].min(axis=0) < of["most"].max(axis=0))
            cov = t["p"] / n - t["sx"] * t["sy"] / (n * n)
            vx = t["qx"] / n - t["sx"] * t["sx"] / (n * n)
            vy = t["qy"] / n - t["sy"] * t["sy"] / (n * n)
            r = cov / (np.sqrt(vx) * np.sqrt(vy))
            flat = (vx <= FLAT_SHARE * t["qx"] / n) | (vy <= FLAT_SHARE * t["qy"] / n) | flat_known[a] | flat_known
        ok = (n > 0) & ~flat & ~np.isnan(r)
        r = np.where(ok, np.clip(r, -1.0, 1.0), np.nan)
        out = pd.DataFrame({"col_x": names[a], "col_y": names, "r": r, "n": n.astype(np.int64)})
        out["r"] = out["r"].astype("object").where(ok, None)
        return out

    return sums.groupBy("a").applyInPandas(pairs_of, CORRELATIONS_SCHEMA)


CORRELATIONS_SCHEMA = "col_x string, col_y string, r double, n long"


def correlations_of(
    df: DataFrame, pairs: list[tuple[str, str]], known: dict[str, Moments] | None = None
) -> DataFrame:
    """Correlations of the given column pairs: a pass for the means, unless known, and one for the sums; one for many pairs."""
    if not pairs:
        return df.sparkSession.createDataFrame([], CORRELATIONS_SCHEMA)
    names = sorted({c for p in pairs for c in p})
    required(df, *names)
    if len(pairs) <= PAIRS_PER_PASS:
        if known is None:
            known = moments_from(names, df.agg(*[a.alias(k) for k, a in moment_aggregates(df, names).items()]).first())
        return _pairs_row(df, pairs, known)
    # more pairs than one aggregate takes: all of them, and the means, from one scan of co-moment blocks
    found = comoments(df, names)
    asked = df.sparkSession.createDataFrame(list(dict.fromkeys(pairs)), "col_x string, col_y string")  # the caller's list
    return found.join(F.broadcast(asked), ["col_x", "col_y"])


def correlations(
    df: DataFrame, columns: list[str] | None = None, matrix: bool = False, known: dict[str, Moments] | None = None
) -> DataFrame:
    """Pairwise-complete Pearson r of all numeric and boolean columns, and the row count of each pair.

    By default each pair once, in column order; ``matrix`` gives both orders and the diagonal.
    """
    usable = correlated_columns(df)
    names = usable if columns is None else [c for c in columns if c in usable]
    pairs = list(combinations(names, 2))
    if not matrix:
        return correlations_of(df, pairs, known)
    one = correlations_of(df, pairs + [(c, c) for c in names], known)
    flipped = one.where("col_x <> col_y").select(F.col("col_y").alias("col_x"), F.col("col_x").alias("col_y"), "r", "n")
    return one.withColumn("r", F.when((F.col("col_x") == F.col("col_y")) & F.col("r").isNotNull(), 1.0).otherwise(F.col("r"))).unionAll(flipped)


def pair_correlation(df: DataFrame, x: str, y: str) -> DataFrame:
    return correlations_of(df, [(x, y)])


# ------------------------------------------------------------------ whole profiles


def full_profile(
    df: DataFrame, skip_discrete: bool = True, corr_columns: list[str] | None = None, method: str = "exact"
) -> Profile:
    """Outliers, missing data and correlations of one table."""
    names = correlated_columns(df)
    stats, row = measure(df, extra=moment_aggregates(df, names))
    report = missing_report(df, stats)
    return Profile(
        outliers=outlier_report(df, skip_discrete=skip_discrete, method=method, stats=stats),
        missing=report,
        missing_total=missing_total(report),
        correlations=correlations(df, corr_columns, known=moments_from(names, row)),
    )


def plans_from(columns: DataFrame, relationships: DataFrame | None = None) -> list[TablePlan]:
    """A plan per table of a columns table (table, column, kind, category, id_evidence), by the evidence for each role.

    A column is a key when it is id-like by its name, when it is id-like by uniqueness and not a fractional number
    (a price or an amount can be unique and is still a measure), or when it is a side of a kept relationship.  Keys
    are not profiled; the number columns that are left are correlated; a table with nothing left is switched off.
    """
    found: dict[str, TablePlan] = {}
    rows = columns.orderBy("pos", "ordinal").select("table", "column", "kind", "category", "id_evidence").collect()  # bounded by the schema
    joined: set[tuple[str, str]] = set()
    if relationships is not None:
        for r in relationships.select("table_a", "column_a", "table_b", "column_b").collect():  # bounded by the schema
            joined |= {(r["table_a"], r["column_a"]), (r["table_b"], r["column_b"])}
    for name in dict.fromkeys(r["table"] for r in rows):
        own = [r for r in rows if r["table"] == name]

        def unique_measure(r) -> bool:
            return r["id_evidence"] == "uniqueness" and r["kind"] == "number"

        def is_key(r) -> bool:
            return (r["category"] == "id_like" and not unique_measure(r)) or (name, r["column"]) in joined

        keys = [r["column"] for r in own if is_key(r)]
        numbers = [
            r["column"] for r in own
            if not is_key(r) and (r["category"] in ("numeric_discrete", "numeric_continuous") or unique_measure(r))
        ]
        found[name] = TablePlan(name, should_profile=len(keys) < len(own), id_like=keys, corr_columns=numbers)
    return list(found.values())


def active_plans(plans: list[TablePlan], results: set[str] = frozenset(), mode: str = "both") -> list[TablePlan]:
    """Plans to run: ``separate`` keeps base tables, ``joined`` join results, ``both`` all."""
    keep = {
        "separate": lambda p: p.table not in results,
        "joined": lambda p: p.table in results,
        "both": lambda p: True,
    }[mode]
    return [p for p in plans if p.should_profile and keep(p)]


def profile_tables(
    tables: dict[str, DataFrame],
    plans: list[TablePlan],
    results: set[str] = frozenset(),
    mode: str = "both",
) -> tuple[Profile, dict[str, str]]:
    """Profiles of all planned tables with a ``table`` column, and the failures by table.

    A table that fails or is absent is left out, the others are kept.
    """
    active = active_plans(plans, results, mode)
    chosen = [p for p in active if p.table in tables]
    failures = {p.table: "no such table" for p in active if p.table not in tables}

    def one(plan: TablePlan):
        try:
            df = drop_planned(tables[plan.table], plan)
            return plan.table, full_profile(df, corr_columns=correlation_columns(df, plan)), None
        except Exception as problem:  # a bad table must not stop the others
            return plan.table, None, f"{type(problem).__name__}: {problem}"

    with ThreadPoolExecutor(max_workers=8) as pool:
        done = list(pool.map(one, chosen))
    good = [(t, p) for t, p, _ in done if p is not None]
    failures |= {t: why for t, _, why in done if why}
    if not good:
        raise ValueError(f"no table could be profiled: {failures}")

    def stacked(part: str) -> DataFrame:
        frames = [getattr(p, part).select(F.lit(t).alias("table"), "*") for t, p in good]
        return reduce(DataFrame.unionByName, frames)

    return Profile(*[stacked(p) for p in ("outliers", "missing", "missing_total", "correlations")]), failures


def subgroup_describe(df: DataFrame, where: Column | str, columns: list[str], method: str = "exact") -> DataFrame:
    """count, mean, std, min, quartiles and max of columns over the rows of a subgroup."""
    part = df.where(where)
    required(part, *columns)
    values = {c: value_of(part, c) for c in columns}
    found = quantiles(part, values, [0.25, 0.5, 0.75], method)
    aggs = []
    for i, c in enumerate(columns):
        v = values[c]
        aggs += [
            F.count(v).alias(f"n{i}"), F.avg(v).alias(f"a{i}"), F.stddev_samp(v).alias(f"s{i}"),
            F.min(v).alias(f"l{i}"), F.max(v).alias(f"h{i}"),
        ]
    cells = [
        F.struct(
            F.lit(c).alias("column"), F.col(f"n{i}").alias("count"), F.col(f"a{i}").alias("mean"),
            F.col(f"s{i}").alias("std"), F.col(f"l{i}").alias("min"),
            *[F.lit(q).cast("double").alias(n) for n, q in zip(("q25", "q50", "q75"), found[c])],
            F.col(f"h{i}").alias("max"),
        )
        for i, c in enumerate(columns)
    ]
    return part.agg(*aggs).select(F.inline(F.array(*cells)))
