"""Equi-joins on one shared column, with pandas' column naming and null-key rule."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..functions import canonical_key, clean, col, is_boolean, is_datetime, is_floating, is_number, required
from ..plans.skew import ROWS_PER_TASK, can_broadcast, hot_counts, spread_over
from ..session import ensure_checkpoint_dir
from ..sources.tables import TableSet

HOW = {"inner": "inner", "left": "left", "outer": "full", "full": "full"}


@dataclass(frozen=True)
class JoinInstruction:
    left: str
    right: str
    on: str
    how: str
    result: str


def _family(dtype: T.DataType) -> str:
    if is_number(dtype) or is_boolean(dtype):
        return "number"
    if is_datetime(dtype):
        return "datetime"
    return "text" if isinstance(dtype, T.StringType) else dtype.simpleString()


def merge(
    left: DataFrame,
    right: DataFrame,
    on: str,
    how: str = "inner",
    null_keys: str = "match",
    skew: str = "auto",
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Join on one column of both sides; other shared names get ``_x`` and ``_y``.

    ``null_keys="match"`` pairs missing keys with each other, ``"drop"`` never does.  Broadcast or sort-merge is
    Catalyst's choice.  Unless a side can be broadcast for this join type, keys with more than ``rows_per_task`` rows on
    a side are found first and spread, each over as many salts as its rows need; a key that is hot on both sides is
    spread on both (``skew="auto"``; ``"split"`` looks even where a side can be broadcast, ``"off"`` never).  Keys with
    more than PAIRS_PER_TASK pairs of rows (missing keys of both sides, often) are looked for unless ``"off"`` and
    joined on their own, in cells of about so many pairs.

    Keys of different number types meet as exact decimals.
    """
    if how not in HOW:
        raise ValueError(f"unknown join type {how!r}")
    required(left, on)
    required(right, on)
    if _family(left.schema[on].dataType) != _family(right.schema[on].dataType):
        raise TypeError(f"key '{on}' has incompatible types")
    shared = {c for c in left.columns if c in right.columns and c != on}
    names = [c + "_x" if c in shared else c for c in left.columns] + [c + "_y" if c in shared else c for c in right.columns if c != on]
    twice = sorted({c for c in names if names.count(c) > 1} | {c for c in names if c in INNER})
    if twice:
        raise ValueError(f"the result would have columns that clash: {', '.join(twice)}")
    lhs = left.select(*[(clean(left, c) if c == on else col(c)).alias(c + "_x" if c in shared else c) for c in left.columns])
    rhs = right.select(
        *[clean(right, c).alias("_rk") if c == on else col(c).alias(c + "_y" if c in shared else c) for c in right.columns]
    )
    out = [F.coalesce(col(on), F.col("_rk")).alias(on) if how in ("outer", "full") and c == on else col(c) for c in lhs.columns]
    out += [col(c) for c in rhs.columns if c != "_rk"]
    match = null_keys == "match"
    exact_l, exact_r = _comparable(lhs, on, rhs, "_rk")
    same = exact_l.eqNullSafe(exact_r) if match else exact_l == exact_r

    spread = _Spread.plan(lhs, rhs, on, exact_l, exact_r, HOW[how], match, skew, rows_per_task)
    if spread is None:
        return lhs.join(rhs, same, HOW[how]).select(*out)
    heavy = spread.pairs(lhs, rhs)
    if heavy is not None:  # these keys are on both sides: none of their rows is unmatched
        heavy = heavy.select(*out)
        lhs, rhs = spread.rest(lhs, exact_l), spread.rest(rhs, exact_r)
    if spread.hot is None:
        return lhs.join(rhs, same, HOW[how]).select(*out).unionAll(heavy)
    salted_l, salted_r = spread.left(lhs), spread.right(rhs)
    joined = salted_l.join(salted_r, same & (F.col("_ls") == F.col("_rs")), HOW[how])
    # A copied row that met nothing at one salt is not an unmatched row: its key was seen on the other side.
    if how != "inner":
        joined = joined.where(~(F.col("_rs").isNull() & F.col("_lc")))
    if how in ("outer", "full"):
        joined = joined.where(~(F.col("_ls").isNull() & F.col("_rc")))
    return joined.select(*out) if heavy is None else joined.select(*out).unionAll(heavy)


#: Names that a spread join uses inside.
INNER = {"_rk", "_ls", "_rs", "_lc", "_rc", "_hkey", "_hk", "_a", "_b", "_id"}


def _comparable(lhs: DataFrame, left: str, rhs: DataFrame, right: str) -> tuple[Column, Column]:
    """Both keys in a form in which they are equal only if their values are: never a long passed through double."""
    kinds = [lhs.schema[left].dataType, rhs.schema[right].dataType]
    numbers = [is_number(k) or is_boolean(k) for k in kinds]
    floats = [is_floating(k) for k in kinds]
    if kinds[0] == kinds[1] or not all(numbers) or all(floats) or not any(floats) and not any(isinstance(k, T.DecimalType) for k in kinds):
        return col(left), col(right)
    return canonical_key(lhs, left), canonical_key(rhs, right)


#: Hot keys of both sides together that are sent to every task; beyond that they are joined (AQE splits the hot side).
HOT_BROADCAST = 1_000_000
#: Pairs of rows of one key that a cell of the spread takes, and the most partitions that cells are dealt over.
PAIRS_PER_TASK = 8_000_000
CELL_PARTS = 2_000


@dataclass
class _Spread:
    """Hot keys with the places of their left rows (a) and of their right rows (b): a row of the left takes one of a
    places and goes to all b of them, a row of the right the other way round, so each pair meets once.

    ``hot`` holds (_hk, _a, _b) for every key with more than rows_per_task rows on a side, found exactly
    (``hot_counts``); each side learns its key's numbers by a join with it, so there is no limit on the number of keys.
    ``heavy`` holds (_hk, _a, _b, _id) for the keys with more than PAIRS_PER_TASK pairs: one row for so many rows of the
    result at most.  Their places follow from their pairs, so that copies stay a small part of the pairs; their cells are
    numbered through, each key's from its _id on, so that every partition gets as many."""

    hot: DataFrame | None
    small: bool
    left_key: Column
    right_key: Column
    match: bool
    heavy: DataFrame | None = None
    cells: int = 0

    @classmethod
    def plan(cls, left, right, on, left_key, right_key, how, match, skew, rows_per_task) -> "_Spread | None":
        if skew == "off":
            return None
        by_rows = None if skew == "auto" and can_broadcast(left, right, how) else rows_per_task
        counts = hot_counts([(left, left_key), (right, right_key)], by_rows, PAIRS_PER_TASK)
        if counts is None:
            return None
        l, r = F.col("_n0"), F.col("_n1")
        is_heavy = l.cast("double") * r > PAIRS_PER_TASK
        if not match:  # missing keys meet nothing
            is_heavy = is_heavy & F.col("_hk").isNotNull()
        limit = rows_per_task if by_rows is None else by_rows

        def places(n: Column, other: Column) -> Column:
            by_pairs = F.ceil(n / F.greatest(F.lit(float(PAIRS_PER_TASK**0.5)), PAIRS_PER_TASK / other))
            # more places for the sake of rows, as long as the other side's copies are fewer than these rows
            more = F.least(spread_over(n, limit), F.floor(n / other))
            return F.greatest(F.lit(1), by_pairs, more).cast("long")

        def over(n: Column) -> Column:
            return F.when(n > limit, spread_over(n, limit)).otherwise(1).cast("long")

        stored = counts.select(
            "_hk", is_heavy.alias("_heavy"),
            F.when(is_heavy, places(l, r)).otherwise(over(l)).alias("_a"), F.when(is_heavy, places(r, l)).otherwise(over(r)).alias("_b"),
        ).where(is_heavy if by_rows is None else F.lit(True)).cache()
        seen = stored.agg(
            F.count_if(~F.col("_heavy")).alias("hot"), F.count_if("_heavy").alias("heavy"),
            F.sum(F.when(F.col("_heavy"), F.col("_a") * F.col("_b"))).alias("cells"),
        ).first()  # at most rows / rows_per_task of each side
        if not seen["hot"] and not seen["heavy"]:
            stored.unpersist()
            return None
        hot = stored.where(~F.col("_heavy")).select("_hk", "_a", "_b") if seen["hot"] else None
        heavy = None
        if seen["heavy"]:
            before = Window.orderBy("_hk").rowsBetween(Window.unboundedPreceding, -1)
            heavy = stored.where("_heavy").select("_hk", "_a", "_b", F.coalesce(F.sum(F.col("_a") * F.col("_b")).over(before), F.lit(0)).alias("_id"))
        return cls(hot, seen["hot"] <= HOT_BROADCAST, left_key, right_key, match, heavy, seen["cells"] or 0)

    def pairs(self, left: DataFrame, right: DataFrame) -> DataFrame | None:
        """The inner join of the rows of heavy keys, by cell: its number stands for the key and gives the partition."""
        if self.heavy is None:
            return None
        parts = max(1, min(self.cells, CELL_PARTS))
        dealt = [(F.col(salt) % parts).cast("int") for salt in ("_ls", "_rs")]
        left = self._marked(left, self.heavy, self.left_key, 0, "_ls").repartitionById(parts, dealt[0])
        right = self._marked(right, self.heavy, self.right_key, 1, "_rs").repartitionById(parts, dealt[1])
        return left.join(right, (dealt[0] == dealt[1]) & (F.col("_ls") == F.col("_rs")))  # no other exchange

    def _marked(self, df: DataFrame, heavy: DataFrame, key: Column, side: int, salt: str) -> DataFrame:
        columns = df.columns
        marked = df.withColumn("_hkey", key).join(F.broadcast(heavy), F.col("_hkey").eqNullSafe(heavy["_hk"]))
        salts = self._salts(df, side, F.col("_a"), F.col("_b"))
        return marked.select(*map(col, columns), "_id", F.explode(salts).alias(salt)).select(
            *map(col, columns), (F.col("_id") + F.col(salt)).alias(salt)
        )

    def rest(self, df: DataFrame, key: Column) -> DataFrame:
        """The rows of other keys."""
        keys = F.broadcast(self.heavy.select("_hk"))
        return df.withColumn("_hkey", key).join(keys, F.col("_hkey").eqNullSafe(keys["_hk"]), "left_anti").drop("_hkey")

    def _salts(self, df: DataFrame, side: int, a: Column, b: Column, other: Column | None = None) -> Column:
        """The cells of a row: its own place at each of the other side's places (``other`` of them)."""
        own = a if side == 0 else b
        other = (b if side == 0 else a) if other is None else other
        # The place comes from the whole row but its key, so a task that runs again gives the same places, and rows of
        # one key that differ anywhere (also only in a text) fall apart.  Only rows of hot keys are hashed.
        kinds = {f.name: f.dataType for f in df.schema.fields}
        hashable = [col(c) for c, t in kinds.items() if not isinstance(t, T.MapType)]
        place = F.when(own > 1, F.pmod(F.xxhash64(F.lit(side), *hashable), own)).otherwise(F.lit(0)).cast("long")
        return F.transform(F.sequence(F.lit(0).cast("long"), other - 1), lambda c: place * b + c if side == 0 else c * b + place)

    def _salted(self, df: DataFrame, key: Column, side: int, salt: str, copied: str) -> DataFrame:
        columns = df.columns
        hot = F.broadcast(self.hot) if self.small else self.hot
        marked = df.withColumn("_hkey", key).join(hot, F.col("_hkey").eqNullSafe(hot["_hk"]), "left")
        a, b = F.coalesce(F.col("_a"), F.lit(1)), F.coalesce(F.col("_b"), F.lit(1))
        other = b if side == 0 else a
        if not self.match:  # missing keys meet nothing: no copies for them
            other = F.when(F.col("_hkey").isNull(), F.lit(1)).otherwise(other)
        salts = self._salts(df, side, a, b, other)
        return marked.select(*map(col, columns), (other > 1).alias(copied), F.explode(salts).alias(salt))

    def left(self, df: DataFrame) -> DataFrame:
        return self._salted(df, self.left_key, 0, "_ls", "_lc")

    def right(self, df: DataFrame) -> DataFrame:
        return self._salted(df, self.right_key, 1, "_rs", "_rc")


LOG_SCHEMA = (
    "step int, left_table string, right_table string, on_column string, join_type string, result_name string, "
    "status string, row_count long, null_key_rows long"
)


def run_joins(
    tables: dict[str, DataFrame],
    instructions: list[JoinInstruction],
    null_keys: str = "match",
    count_rows: bool = True,
    skew: str = "auto",
) -> tuple[TableSet, DataFrame]:
    """Run joins in order; a result can feed a later join.

    A step whose table or column is absent, whose key types do not fit or whose result would have two columns of one name
    is skipped and logged.  Returns all tables with the results added, and the log.  Results that a later step reads are
    stored in the checkpoint folder, so that no step runs twice.
    """
    out = TableSet(tables)
    spark = next(iter(tables.values())).sparkSession
    later = {name: max(i for i, x in enumerate(instructions) if name in (x.left, x.right)) for x in instructions for name in (x.left, x.right)}
    missing: dict[tuple[str, str], int] = {}

    def null_rows(name: str, on: str) -> int:
        if (name, on) not in missing:
            missing[name, on] = out[name].where(clean(out[name], on).isNull()).count()
        return missing[name, on]

    log = []
    for step, ins in enumerate(instructions):
        status, rows, nulls = "done", None, None
        if ins.left not in out or ins.right not in out:
            status = "skipped: no such table"
        elif ins.on not in out[ins.left].columns or ins.on not in out[ins.right].columns:
            status = "skipped: no such column"
        else:
            try:
                merged = merge(out[ins.left], out[ins.right], ins.on, ins.how, null_keys, skew)
            except (AnalysisException, TypeError, ValueError) as problem:
                status = f"skipped: {problem}"
            else:
                if later.get(ins.result, -1) > step:
                    merged = stage_table(merged)
                if count_rows:
                    rows = merged.count()
                    nulls = null_rows(ins.left, ins.on) + null_rows(ins.right, ins.on)
                out[ins.result] = merged
                missing = {k: n for k, n in missing.items() if k[0] != ins.result}
        log.append((step, ins.left, ins.right, ins.on, ins.how, ins.result, status, rows, nulls))
    return out, spark.createDataFrame(log, LOG_SCHEMA)


#: Characters that Parquet does not take in column names; a result with such names is checkpointed instead.
_PARQUET_ODD = set(" ,;{}()\n\t=")


def stage_table(df: DataFrame) -> DataFrame:
    """A join result that later steps read, stored once as Parquet in the checkpoint folder and read from there.

    Unlike a checkpoint of serialised rows, later steps read only the columns they use and their filters reach the
    files; the folder is the one all executors share, so a lost executor loses nothing.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    if any(_PARQUET_ODD & set(c) for c in df.columns):
        return df.checkpoint()
    path = f"{spark.sparkContext.getCheckpointDir().rstrip('/')}/stage-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


ORDER = {"one_to_one": 0, "one_to_many": 1, "many_to_one": 1, "many_to_many": 2}


def join_plan(relationships: DataFrame, above: float = 0.6, many_to_many: bool = False) -> DataFrame:
    """The joins that relationships suggest, in the order to run them: (seq, left_table, right_table, on_column,
    join_type, cardinality, confidence, result_name).

    Only pairs whose columns share one name; one_to_one first, then those with a unique side, each by confidence.  Many to
    many pairs multiply rows and come only when asked for.  The hint is the join type; where it is unknown, left.
    """
    full = F.coalesce("cardinality_full", F.lit("unknown"))
    rank = F.coalesce(*[F.when(full == k, F.lit(n)) for k, n in ORDER.items()], F.lit(3))
    rows = relationships.where((F.col("confidence") > above) & (F.col("column_a") == F.col("column_b")))
    if not many_to_many:
        # a pair that was never checked could be anything
        rows = rows.where(full.isin("one_to_one", "one_to_many", "many_to_one"))
    order = [rank, F.col("confidence").desc(), F.col("table_a"), F.col("column_a"), F.col("table_b")]
    return rows.select(
        F.row_number().over(Window.orderBy(*order)).alias("seq"),  # as many rows as the schema has pairs
        F.col("table_a").alias("left_table"), F.col("table_b").alias("right_table"), F.col("column_a").alias("on_column"),
        F.when(F.col("join_hint").isin("inner", "left"), F.col("join_hint")).otherwise("left").alias("join_type"),
        full.alias("cardinality"), "confidence",
        F.concat_ws("_", "table_a", "table_b", "column_a").alias("result_name"),
    )


def instructions_from(relationships: DataFrame, above: float = 0.6, many_to_many: bool = False) -> list[JoinInstruction]:
    """The steps of ``join_plan`` for ``run_joins``."""
    rows = join_plan(relationships, above, many_to_many).orderBy("seq").collect()  # bounded by the schema
    return [JoinInstruction(r["left_table"], r["right_table"], r["on_column"], r["join_type"], r["result_name"]) for r in rows]


def zero_activity(parents: DataFrame, children: DataFrame, on: str, value: str | None = None) -> DataFrame:
    """Parents without children, or (with ``value``) with a zero total.

    Children are summed per key before the join, so a hot key reaches it as one row.
    """
    required(parents, on)
    required(children, on)
    keyed = children.where(clean(children, on).isNotNull())
    if value is None:
        return parents.join(keyed.select(on).distinct(), on, "left_anti")
    required(children, value)
    busy = keyed.groupBy(on).agg(F.sum(clean(children, value)).alias("_total")).where(F.col("_total") != 0)
    return parents.join(busy.select(on), on, "left_anti")
