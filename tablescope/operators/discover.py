"""Column categories and joins between tables, found from names and then checked on values."""

from __future__ import annotations

import math
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..functions import canonical_key, classifiable, clean, col, is_boolean, is_datetime, is_integral, is_number
from ..sources.tables import draw_values, sample_values, semantic_sample
from .stats import measure

# Fixed values.
ID_SUFFIXES = ["_id", "_key", "_code", "_num", "_no"]
STRONG_SUFFIXES = ["_id", "_key", "_code", "pk", "fk"]
JOINABLE = ["id_like", "numeric_discrete", "categorical_low_cardinality"]
BASE_STRONG, BASE_WEAK = 0.9, 0.7
MIN_OVERLAP = 0.15
INNER_SHARE = 0.9
OVERLAP_WEIGHT = 0.15
SUGGEST_ABOVE = 0.6

COLUMNS_SCHEMA = (
    "table string, pos int, ordinal int, column string, dtype string, kind string, n_rows long, n_missing long, "
    "n_distinct long, exact boolean, sample_values array<string>"
)


def kind_of(dtype: T.DataType) -> str | None:
    if not classifiable(dtype):
        return None
    if is_datetime(dtype):
        return "datetime"
    if is_number(dtype) or is_boolean(dtype):
        return "integer" if is_integral(dtype) or is_boolean(dtype) else "number"
    return "text"


def _ends_with(name: Column, suffixes: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.endswith(name, F.lit(s)) for s in suffixes])


def classify_columns(columns: DataFrame) -> DataFrame:
    """Add ``category`` and ``id_evidence`` to rows of (column, kind, n_rows, n_distinct)."""
    name = F.lower("column")
    named = _ends_with(name, ID_SUFFIXES)
    numeric = F.col("kind").isin("integer", "number")
    ratio = F.coalesce(F.try_divide(F.col("n_distinct").cast("double"), F.col("n_rows").cast("double")), F.lit(0.0))
    unique = numeric & (ratio > 0.6) & (F.col("n_distinct") > 50)
    category = (
        F.when(F.col("kind").isNull(), F.lit(None).cast("string"))
        .when(F.col("kind") == "datetime", "datetime")
        .when(named | unique, "id_like")
        .when(numeric & (F.col("n_distinct") < 20), "numeric_discrete")
        .when(numeric, "numeric_continuous")
        .when(F.col("n_distinct") < 15, "categorical_low_cardinality")
        .when(F.col("n_distinct") > 100, "free_text")
        .otherwise("categorical_high_cardinality")
    )
    return columns.withColumn("category", category).withColumn(
        "id_evidence",
        F.when(F.col("category") == "id_like", F.when(named, "name").otherwise("uniqueness")),
    )


def columns_table(tables: dict[str, DataFrame], exact: bool = False, samples: int = 3) -> DataFrame:
    """One classified row per column of every table.  Tables are measured side by side.

    ``exact`` in a row says whether its n_distinct was counted; others are estimates that lie far from every limit of
    the categories.  ``samples`` values come from independent draws, so one value can appear twice.
    """
    spark = next(iter(tables.values())).sparkSession

    def one(item):
        pos, (name, df) = item
        plain = [f.name for f in df.schema.fields if classifiable(f.dataType)]
        # the samples are drawn in the pass that measures
        draws = {f"s{i}": draw_values(df, c, samples) for i, c in enumerate(plain)} if samples else {}
        stats, found = measure(df, exact, draws)
        values = {c: [v for v in found[f"s{i}"] if v is not None] for i, c in enumerate(plain)} if samples else {}
        return [
            (
                name, pos, s.ordinal, s.column, s.dtype, kind_of(df.schema[s.column].dataType), s.n_rows,
                s.n_missing, s.n_distinct, s.exact, values.get(s.column, []),
            )
            for s in stats
        ]

    with ThreadPoolExecutor(max_workers=8) as pool:
        rows = [r for part in pool.map(one, enumerate(tables.items())) for r in part]
    # One small row per column: a single partition needs no shuffles later.
    return classify_columns(spark.createDataFrame(rows, COLUMNS_SCHEMA).coalesce(1))


def tables_table(columns: DataFrame) -> DataFrame:
    return columns.groupBy("pos", "table").agg(
        F.max("n_rows").alias("row_count"), F.count("*").cast("int").alias("n_columns")
    ).orderBy("pos").drop("pos")


def name_candidates(columns: DataFrame) -> DataFrame:
    """Column pairs of two tables with the same lower-cased name; side a must be joinable.

    Works on the columns table, whose size is that of the schema.  Pairs follow table order.
    """
    # Of two columns that are equal after lower-casing the last one stands for the name.
    last = columns.groupBy("table", "pos", F.lower("column").alias("name")).agg(
        F.max_by("column", "ordinal").alias("column"), F.max_by("category", "ordinal").alias("category")
    )
    a, b = last.alias("a"), last.alias("b")
    return (
        a.join(b, (F.col("a.name") == F.col("b.name")) & (F.col("a.pos") < F.col("b.pos")))
        .where(F.col("a.category").isin(JOINABLE))
        .orderBy("a.pos", "b.pos", "a.name")  # of schema size
        .select(
            F.col("a.table").alias("table_a"),
            F.col("a.column").alias("column_a"),
            F.col("b.table").alias("table_b"),
            F.col("b.column").alias("column_b"),
            F.when(_ends_with(F.col("a.name"), STRONG_SUFFIXES), BASE_STRONG).otherwise(BASE_WEAK).alias("confidence"),
            F.lit("name_match").alias("detection_method"),
        )
    )


@dataclass(frozen=True)
class _Side:
    """A column taking part in a candidate; ``group`` joins the columns compared with each other."""

    group: int
    index: int
    table: str
    column: str


WORD = 62  # tables per bit mask


def _sides(tables, candidates) -> tuple[list[_Side], dict]:
    """Columns of the candidates, grouped so that every candidate lies within one group."""
    parent: dict = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for c in candidates:
        parent[root((c["table_b"], c["column_b"]))] = root((c["table_a"], c["column_a"]))
    groups: dict = {}
    sides = {}
    for node in sorted(parent):
        members = groups.setdefault(root(node), [])
        members.append(node)
        sides[node] = (list(groups).index(root(node)), len(members) - 1)
    return [_Side(g, i, t, c) for (t, c), (g, i) in sides.items()], sides


def _values(tables, sides: list[_Side], integral: set[int]) -> DataFrame:
    """(g, i, v) cells of the sides: longs where a whole group is integer, else comparable text."""
    parts = []
    for s in sides:
        df = tables[s.table]
        value = col(s.column).cast("long") if s.group in integral else canonical_key(df, s.column)
        parts.append(df.select(F.lit(s.group).alias("g"), F.lit(s.index).alias("i"), value.alias("v")))
    return reduce(DataFrame.unionAll, parts).where(F.col("v").isNotNull())


def _integral_groups(tables, sides) -> set[int]:
    whole: dict[int, bool] = {}
    for s in sides:
        whole[s.group] = whole.get(s.group, True) and is_integral(tables[s.table].schema[s.column].dataType)
    return {g for g, ok in whole.items() if ok}


def shared_values(tables: dict[str, DataFrame], sides: list[_Side], pairs: dict[int, list[tuple[int, int]]]) -> DataFrame:
    """(g, counts): per group the distinct values of each column, then those that each asked pair of columns shares.

    One shuffle on (g, value).  The state per value is a bit mask of the columns it occurs in, so a value held by a third
    of all rows costs one row per task; the sums after it are one row per group and task, however the values mix.
    """
    integral = _integral_groups(tables, sides)
    width: dict[int, int] = {}
    for s in sides:
        width[s.group] = max(width.get(s.group, 0), s.index + 1)
    out = []
    for chosen in ([s for s in sides if s.group in integral], [s for s in sides if s.group not in integral]):
        if not chosen:
            continue
        groups = sorted({s.group for s in chosen})
        words = (max(width[g] for g in groups) - 1) // WORD + 1
        bits = [
            F.bit_or(
                F.when(
                    F.floor(F.col("i") / WORD) == w,
                    F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("i") % WORD).cast("int")),
                ).otherwise(F.lit(0).cast("long"))
            ).alias(f"w{w}")
            for w in range(words)
        ]
        by_value = _values(tables, chosen, integral).groupBy("g", "v").agg(*bits)
        # per group the (bit, bit) tests, as data: the plan does not grow with the number of candidates
        tests = {g: [(i, i) for i in range(width[g])] + pairs.get(g, []) for g in groups}
        rows = [(g, k, x, y) for g, all_of in tests.items() for k, (x, y) in enumerate(all_of)]
        tested = F.broadcast(by_value.sparkSession.createDataFrame(rows, "g int, k int, x int, y int"))  # one row per column and candidate

        def bit(at: str) -> Column:
            word = F.element_at(F.array(*[F.col(f"w{w}") for w in range(words)]), (F.floor(F.col(at) / WORD) + 1).cast("int"))
            return F.call_function("shiftright", word, (F.col(at) % WORD).cast("int")).bitwiseAND(F.lit(1).cast("long"))

        # values that occur in the same columns fall together first, within each task
        mixes = by_value.groupBy("g", *[f"w{w}" for w in range(words)]).agg(F.count("*").alias("n_values"))
        met = mixes.join(tested, "g").where((bit("x") == 1) & (bit("y") == 1))
        out.append(met.groupBy("g", "k").agg(F.sum("n_values").alias("n")))
    return reduce(DataFrame.unionAll, out)


def key_overlap(tables: dict[str, DataFrame], candidates: list) -> dict:
    """Exact distinct and shared counts per candidate, as driver values.

    Result: candidate -> (distinct_a, distinct_b, shared).
    """
    sides, place = _sides(tables, candidates)
    pairs: dict[int, list[tuple[int, int]]] = {}
    spots = {}
    for c in candidates:
        (g, ia), (_, ib) = place[(c["table_a"], c["column_a"])], place[(c["table_b"], c["column_b"])]
        members = pairs.setdefault(g, [])
        spots[c] = (g, ia, ib, len(members))
        members.append((ia, ib))
    width: dict[int, int] = {}
    for s in sides:
        width[s.group] = max(width.get(s.group, 0), s.index + 1)
    # one number per column and candidate
    counts = {(r["g"], r["k"]): r["n"] for r in shared_values(tables, sides, pairs).collect()}
    return {
        c: (counts.get((g, ia), 0), counts.get((g, ib), 0), counts.get((g, width[g] + k), 0)) for c, (g, ia, ib, k) in spots.items()
    }


def sampled_overlap(tables: dict[str, DataFrame], candidates: list, k: int = 500) -> tuple[dict, dict]:
    """Overlap from the k md5-smallest distinct values of one side, looked up in the whole other side.

    Sampling both sides would miss most matches.  Results: candidate -> {side a | b: (sample size, found)}, and
    (table, column) -> exact distinct count, since uniqueness cannot be read off a sample.
    """
    sides, place = _sides(tables, candidates)
    integral = _integral_groups(tables, sides)
    spark = tables[sides[0].table].sparkSession
    families = [c for c in ([s for s in sides if s.group in integral], [s for s in sides if s.group not in integral]) if c]
    # The k smallest per column are kept inside each task before they are brought together.
    least = Window.partitionBy("g", "i").orderBy(F.md5("v"), "v")
    picks, sizes = [], []
    for chosen in families:
        distinct = _values(tables, chosen, integral).distinct()
        sizes.append(distinct.groupBy("g", "i").agg(F.count("*").alias("n")))
        text = distinct.select("g", "i", F.col("v").cast("string").alias("v"))
        picks.append(text.withColumn("r", F.row_number().over(least)).where(F.col("r") <= k).select("g", "i", "v"))
    counts = {(r["g"], r["i"]): r["n"] for r in reduce(DataFrame.unionAll, sizes).collect()}
    # At most k values per column, whatever the tables' size.
    drawn = [tuple(r) for r in reduce(DataFrame.unionAll, picks).collect()]
    small = F.broadcast(spark.createDataFrame(drawn, "g int, sample int, v string"))
    probed = reduce(
        DataFrame.unionAll,
        [_values(tables, chosen, integral).select("g", "i", F.col("v").cast("string").alias("v")) for chosen in families],
    )
    hits = (
        probed.join(small, ["g", "v"])
        .where(F.col("i") != F.col("sample"))
        .select("g", "sample", "i", "v")
        .distinct()
        .groupBy("g", "sample", "i")
        .agg(F.count("*").alias("n"))
        .collect()
    )
    found = {(r["g"], r["sample"], r["i"]): r["n"] for r in hits}
    taken: dict = {}
    for g, i, _ in drawn:
        taken[(g, i)] = taken.get((g, i), 0) + 1
    out = {}
    for c in candidates:
        (g, ia), (_, ib) = place[(c["table_a"], c["column_a"])], place[(c["table_b"], c["column_b"])]
        out[c] = {
            "a": (taken.get((g, ia), 0), found.get((g, ia, ib), 0)),
            "b": (taken.get((g, ib), 0), found.get((g, ib, ia), 0)),
        }
    return out, {node: counts.get(at, 0) for node, at in place.items()}


#: Theta sketches of 2^SKETCH_LG nominal entries: exact below that many distinct values, about 1 / 2^(SKETCH_LG / 2) relative
#: error above it.  Candidates whose verdict the error could change are counted exactly.
SKETCH_LG = 14
#: Error bounds of the sketches, in standard errors.
SKETCH_SIGMAS = 3.0


def sketch_overlap(tables: dict[str, DataFrame], candidates: list, filled: dict, lg_k: int | None = None) -> dict:
    """Distinct and shared counts per candidate from theta sketches: candidate -> (distinct_a, distinct_b, shared).

    One theta sketch per column, built by partial aggregation (each task sends one sketch per column, no values are
    shuffled); intersections come from the sketches.  While a column has fewer distinct values than the sketch's
    nominal entries, its sketch holds them all and the counts are exact.  Beyond that, a verdict that lies within
    SKETCH_SIGMAS standard errors of a threshold (overlap 0.15, share of b in a 0.9, uniqueness) is settled by the exact
    count of those candidates alone (``key_overlap``).
    """
    lg_k = lg_k or SKETCH_LG
    sides, place = _sides(tables, candidates)
    integral = _integral_groups(tables, sides)
    spark = tables[sides[0].table].sparkSession
    families = [c for c in ([s for s in sides if s.group in integral], [s for s in sides if s.group not in integral]) if c]
    sketches = reduce(
        DataFrame.unionAll,
        [
            _values(tables, chosen, integral)
            .select("g", "i", (F.col("v") if chosen[0].group in integral else F.col("v").cast("string")).alias("v"))
            .groupBy("g", "i")
            .agg(F.theta_sketch_agg("v", lg_k).alias("s"))
            for chosen in families
        ],
    )  # one row per column
    pairs = [(c["table_a"], c["column_a"], c["table_b"], c["column_b"], *place[(c["table_a"], c["column_a"])], place[(c["table_b"], c["column_b"])][1])
             for c in candidates]
    asked = spark.createDataFrame(pairs, "ta string, ca string, tb string, cb string, g int, ia int, ib int")  # one row per candidate
    a, b = sketches.alias("a"), sketches.alias("b")
    measured = (
        asked.join(a, (F.col("a.g") == asked.g) & (F.col("a.i") == asked.ia), "left")
        .join(b, (F.col("b.g") == asked.g) & (F.col("b.i") == asked.ib), "left")
        .select(
            "ta", "ca", "tb", "cb",
            F.theta_sketch_estimate("a.s").alias("da"),
            F.theta_sketch_estimate("b.s").alias("db"),
            F.theta_sketch_estimate(F.theta_intersection("a.s", "b.s")).alias("both"),
            F.theta_sketch_estimate(F.theta_union("a.s", "b.s")).alias("union"),
        )
        .collect()
    )
    nominal = 1 << lg_k
    error = SKETCH_SIGMAS / math.sqrt(nominal)
    out, unsure = {}, []
    by_key = {(c["table_a"], c["column_a"], c["table_b"], c["column_b"]): c for c in candidates}
    for r in measured:
        c = by_key[(r["ta"], r["ca"], r["tb"], r["cb"])]
        da, db, both, union = (int(r[n] or 0) for n in ("da", "db", "both", "union"))
        out[c] = (da, db, both)
        if union < nominal:  # every sketch still holds all its values
            continue
        spread = error * union
        na, nb = filled[(c["table_a"], c["column_a"])], filled[(c["table_b"], c["column_b"])]

        def straddles(value: float, width: float, at: float) -> bool:
            return value - width <= at <= value + width

        least = max(min(da, db), 1)
        if (
            straddles(both / least, spread / least, MIN_OVERLAP)
            or straddles(both / max(db, 1), spread / max(db, 1), INNER_SHARE)
            or da >= na * (1 - error)
            or db >= nb * (1 - error)
        ):
            unsure.append(c)
    if unsure:
        out |= key_overlap(tables, unsure)
    return out


MEASURED_SCHEMA = (
    "table_a string, column_a string, table_b string, column_b string, base double, detection_method string, "
    "overlap_ratio double, b_in_a_ratio double, unique_a boolean, unique_b boolean"
)


def verify_overlap(
    tables: dict[str, DataFrame],
    candidates: DataFrame,
    method: str = "exact",
    k: int = 500,
    filled: dict[tuple[str, str], int] | None = None,
) -> DataFrame:
    """Check candidates on their values and grade them (the relationships table).

    A candidate whose table is absent passes unchanged; one whose column is absent or empty, or whose
    overlap is below 0.15, is dropped.  ``method`` is ``exact``, ``sketch`` (theta sketches, exact near thresholds) or ``sampled``; ``filled`` gives the non-missing cells
    per (table, column) if they are known already.
    """
    spark = candidates.sparkSession
    rows = candidates.collect()  # bounded by the schema
    known = [
        c for c in rows
        if c["table_a"] in tables and c["table_b"] in tables
        and c["column_a"] in tables[c["table_a"]].columns and c["column_b"] in tables[c["table_b"]].columns
    ]
    passed = [c for c in rows if c["table_a"] not in tables or c["table_b"] not in tables]
    measured = []
    if known:
        filled = filled or _filled(tables, known)
        exact = key_overlap(tables, known) if method == "exact" else sketch_overlap(tables, known, filled) if method == "sketch" else None
        drawn, distinct = sampled_overlap(tables, known, k) if method == "sampled" else (None, None)
        for c in known:
            na, nb = filled[(c["table_a"], c["column_a"])], filled[(c["table_b"], c["column_b"])]
            if not na or not nb:
                continue
            if exact:
                da, db, both = exact[c]
                overlap, b_in_a = both / min(da, db), both / db
            else:
                da, db = distinct[(c["table_a"], c["column_a"])], distinct[(c["table_b"], c["column_b"])]
                size, hit = drawn[c]["a" if da <= db else "b"]
                overlap = hit / size
                size_b, hit_b = drawn[c]["b"]
                b_in_a = hit_b / size_b
            measured.append(
                (c["table_a"], c["column_a"], c["table_b"], c["column_b"], c["confidence"], "combined",
                 overlap, b_in_a, da == na, db == nb)
            )
    measured += [
        (c["table_a"], c["column_a"], c["table_b"], c["column_b"], c["confidence"], c["detection_method"],
         None, None, None, None)
        for c in passed
    ]
    return grade(spark.createDataFrame(measured, MEASURED_SCHEMA).coalesce(1))


def _nodes(candidates) -> list[tuple[str, str]]:
    return sorted(
        {(c["table_a"], c["column_a"]) for c in candidates} | {(c["table_b"], c["column_b"]) for c in candidates}
    )


def _by_table(candidates) -> dict[str, list[str]]:
    out: dict[str, list[str]] = {}
    for table, column in _nodes(candidates):
        out.setdefault(table, []).append(column)
    return out


def _filled(tables, candidates) -> dict:
    """Non-missing cells per column, one aggregate per table."""
    parts = []
    for table, names in _by_table(candidates).items():
        df = tables[table]
        row = df.agg(*[F.count(clean(df, n)).alias(f"n{i}") for i, n in enumerate(names)])
        cells = [F.struct(F.lit(table).alias("t"), F.lit(n).alias("c"), F.col(f"n{i}").alias("n")) for i, n in enumerate(names)]
        parts.append(row.select(F.inline(F.array(*cells))))
    return {(r["t"], r["c"]): r["n"] for r in reduce(DataFrame.unionAll, parts).collect()}


def grade(measured: DataFrame) -> DataFrame:
    """Confidence, cardinality, join hint and suggestion text from measured overlaps."""
    ua, ub = F.col("unique_a"), F.col("unique_b")
    checked = F.col("overlap_ratio").isNotNull()
    return (
        measured.where(~checked | (F.col("overlap_ratio") >= MIN_OVERLAP))
        .withColumn(
            "confidence",
            F.when(checked, F.least(F.lit(1.0), F.col("base") + F.col("overlap_ratio") * OVERLAP_WEIGHT)).otherwise(F.col("base")),
        )
        .withColumn(
            "cardinality",
            F.when(ua & ~ub, "one_to_many")
            .when(~ua & ~ub, "many_to_many")
            .when(ua & ub, "one_to_one")
            .otherwise("unknown"),
        )
        .withColumn("cardinality_full", F.when(~ua & ub, "many_to_one").otherwise(F.col("cardinality")))
        .withColumn(
            "join_hint",
            F.when(F.col("b_in_a_ratio") > INNER_SHARE, "inner").when(checked, "left").otherwise("unknown"),
        )
        .withColumn("suggestion", F.when(F.col("confidence") > SUGGEST_ABOVE, suggestion_text()))
        .orderBy(F.col("confidence").desc(), "table_a", "column_a", "table_b", "column_b")
        .select(
            "table_a", "column_a", "table_b", "column_b", "confidence", "detection_method", "overlap_ratio",
            "b_in_a_ratio", "cardinality", "cardinality_full", "join_hint", "suggestion",
        )
    )


def suggestion_text() -> Column:
    return F.format_string(
        "%s %s JOIN %s ON %s (confidence: %s%%)",
        "table_a", F.upper("join_hint"), "table_b", "column_a",
        F.bround(F.col("confidence") * 100, 0).cast("int").cast("string"),
    )


def suggested_joins(relationships: DataFrame, above: float = SUGGEST_ABOVE) -> DataFrame:
    return relationships.where(F.col("confidence") > above).select(suggestion_text().alias("suggestion"), "confidence")


@dataclass
class Discovery:
    """What ``discover`` finds; ``samples`` has a few readable rows of each table, lazily."""

    tables: DataFrame
    columns: DataFrame
    relationships: DataFrame
    samples: dict[str, DataFrame]

    @property
    def total_rows(self) -> DataFrame:
        return self.tables.agg(F.sum("row_count").alias("total_rows"))

    @property
    def suggestions(self) -> DataFrame:
        return suggested_joins(self.relationships)


def discover(
    tables: dict[str, DataFrame], method: str = "exact", exact_stats: bool = False, samples: int = 3, k: int = 500
) -> Discovery:
    """Classify all columns, propose joins by name and check them on values."""
    columns = columns_table(tables, exact_stats, samples)
    filled = {(r["table"], r["column"]): r["n_rows"] - r["n_missing"] for r in columns.collect()}
    relationships = verify_overlap(tables, name_candidates(columns), method, k, filled)
    return Discovery(tables_table(columns), columns, relationships, {name: semantic_sample(df) for name, df in tables.items()})


# ---------------------------------------------------------------- fingerprint and domain


def _json_escape(text: Column) -> Column:
    """Text as it stands inside a JSON string with only ASCII characters."""

    def unit(code: Column) -> Column:
        return F.concat(F.lit("\\u"), F.lpad(F.lower(F.hex(code)), 4, "0"))

    def one(ch: Column) -> Column:
        code = F.ascii(ch).cast("long")
        over = code - 0x10000
        high = F.lit(0xD800).cast("long") + F.shiftright(over, 10)
        low = F.lit(0xDC00).cast("long") + over.bitwiseAND(F.lit(0x3FF).cast("long"))
        return (
            F.when(ch == '"', '\\"')
            .when(ch == "\\", "\\\\")
            .when(ch == "\n", "\\n")
            .when(ch == "\r", "\\r")
            .when(ch == "\t", "\\t")
            .when(ch == "\b", "\\b")
            .when(ch == "\f", "\\f")
            .when(code.between(32, 126), ch)
            .when(code > 0xFFFF, F.concat(unit(high), unit(low)))
            .otherwise(unit(code))
        )

    # By position, since splitting would part surrogate pairs.
    places = F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1)))
    return F.array_join(F.transform(places, lambda i: one(F.substr(text, i, F.lit(1)))), "")


def schema_columns(tables: dict[str, DataFrame]) -> DataFrame:
    """(table, pos, ordinal, column, kind) of every column, from the schemas alone: nothing is read.  A table without
    columns has a row with a null column.  Enough for ``schema_fingerprint`` and ``domain_tag``."""
    spark = next(iter(tables.values())).sparkSession
    rows = [
        (name, pos, i, f.name, kind_of(f.dataType))
        for pos, (name, df) in enumerate(tables.items())
        for i, f in enumerate(df.schema.fields)
    ] + [(name, pos, None, None, None) for pos, (name, df) in enumerate(tables.items()) if not df.schema.fields]
    return spark.createDataFrame(rows, "table string, pos int, ordinal int, column string, kind string")


def schema_fingerprint(columns: DataFrame, dataset: str | None = None) -> DataFrame:
    """16 hex digits naming a family of datasets with the same table and column names.

    Expects one row per column of (table, column); a table without columns has a row with a null column.
    ``dataset`` names a column that separates several datasets.
    """
    quoted = lambda c: F.concat(F.lit('"'), _json_escape(c), F.lit('"'))
    by = [dataset] if dataset else []
    per_table = columns.groupBy(*by, "table").agg(F.array_sort(F.collect_list("column")).alias("names"))
    entry = F.concat(
        quoted(F.col("table")),
        F.lit(":["),
        F.array_join(F.transform("names", quoted), ","),
        F.lit("]"),
    )
    listed = per_table.select(*by, F.struct("table", entry.alias("entry")).alias("e"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list("e")), lambda e: e["entry"]), ",")
    text = F.concat(F.lit("{"), body, F.lit("}"))
    return listed.groupBy(*by).agg(F.substring(F.sha2(text, 256), 1, 16).alias("schema_hash"))


# Words that point to a domain, first those of columns, then those of tables.
DOMAIN_WORDS = {
    "RETAIL": [
        "price", "quantity", "discount", "category", "product", "order", "customer", "revenue", "sales", "orders",
        "products", "customers", "inventory", "categories", "discounts", "returns",
    ],
    "FINANCE": [
        "amount", "balance", "transaction", "account", "portfolio", "payment", "interest", "risk", "transactions",
        "accounts", "portfolios", "assets", "ledger", "invoices", "payments",
    ],
    "SPORTS": [
        "player", "team", "match", "score", "goal", "season", "league", "position", "stat", "players", "matches",
        "seasons", "stats", "teams", "leagues", "performance", "fixtures",
    ],
    "HEALTHCARE": [
        "patient", "diagnosis", "treatment", "medication", "encounter", "provider", "claim", "patients", "diagnoses",
        "treatments", "prescriptions", "encounters", "providers", "claims",
    ],
    "LOGISTICS": [
        "shipment", "carrier", "route", "delivery", "warehouse", "freight", "tracking", "transit", "shipments",
        "routes", "carriers", "warehouses", "deliveries",
    ],
}


def domain_votes(columns: DataFrame) -> DataFrame:
    """Distinct words of table and column names found in each domain's word list."""
    spark = columns.sparkSession
    words = spark.createDataFrame(
        [(d, w) for d, words in DOMAIN_WORDS.items() for w in words], "domain string, word string"
    )
    names = columns.select(F.col("table").alias("name")).unionAll(columns.select("column"))
    tokens = (
        names.select(F.explode(F.split(F.lower("name"), "[^a-z0-9]+")).alias("word")).where("word <> ''").distinct()
    )
    return tokens.join(F.broadcast(words), "word").groupBy("domain").agg(F.count("*").alias("votes"))


def domain_tag(columns: DataFrame) -> DataFrame:
    """The domain with most votes; GENERAL when there is none or a tie."""
    votes = domain_votes(columns)
    # Six rows at most, so one task is enough.
    ranked = votes.withColumn("r", F.rank().over(Window.orderBy(F.col("votes").desc()))).where("r = 1")
    return ranked.agg(F.count("*").alias("n"), F.max("domain").alias("d"), F.max("votes").alias("votes")).select(
        F.when(F.col("n") == 1, F.col("d")).otherwise("GENERAL").alias("domain"),
        F.coalesce("votes", F.lit(0).cast("long")).alias("votes"),
    )
