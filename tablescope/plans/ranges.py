"""Totally ordered work without a single-task window, in one exchange of the rows.

A window without ``partitionBy``, or with one hot key, runs in one task.  Here every row gets the number of the range
of (keys, order) it falls in, from boundaries drawn from a bounded sample (the SAMPLE_PER_RANGE x ranges rows with the
smallest hashes), and rows are dealt by that number (``repartitionById``): a hot key spreads over many ranges.  The
range number is a function of the row's values, so a task that runs again deals its rows the same way, and windows
over (range, keys) need no further exchange.  Running values are computed per range and stored; the totals of each
range give offsets.  Since ranges follow the order, a group that began in an earlier range can only be the first group
of a range: at most one offset row per range, which is sent to every task.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import ensure_checkpoint_dir

PART = "_part"
#: Sample rows per range from which the boundaries are drawn.
SAMPLE_PER_RANGE = 64


@dataclass(frozen=True)
class By:
    """One column of an order; ascending puts nulls first, descending last (Spark's defaults)."""

    column: Column | str
    descending: bool = False

    @property
    def col(self) -> Column:
        return F.col(self.column) if isinstance(self.column, str) else self.column

    @property
    def sort(self) -> Column:
        return self.col.desc() if self.descending else self.col.asc()


def _by(item) -> By:
    return item if isinstance(item, By) else By(item)


def _before(order: list[By], bound: tuple) -> Column:
    """Whether a row comes strictly before the boundary row in the order."""
    out = F.lit(False)
    for by, b in reversed(list(zip(order, bound))):
        c = by.col
        if b is None:
            before, equal = (c.isNotNull() if by.descending else F.lit(False)), c.isNull()
        else:
            before = F.coalesce(c > F.lit(b), F.lit(False)) if by.descending else c.isNull() | F.coalesce(c < F.lit(b), F.lit(False))
            equal = F.coalesce(c == F.lit(b), F.lit(False))
        out = before | (equal & out)
    return out


def _range_number(order: list[By], bounds: list[tuple], lo: int = 0, hi: int | None = None) -> Column:
    """Number of boundaries at or before the row, by binary search: a tree of comparisons of depth log2(ranges)."""
    hi = len(bounds) if hi is None else hi
    if lo == hi:
        return F.lit(lo)
    mid = (lo + hi) // 2
    return F.when(_before(order, bounds[mid]), _range_number(order, bounds, lo, mid)).otherwise(
        _range_number(order, bounds, mid + 1, hi)
    )


def range_layout(df: DataFrame, *order: Column | str | By, ranges: int | None = None) -> DataFrame:
    """``df`` dealt into ranges of ``order`` (one exchange) with the range number in column ``_part``."""
    spark = df.sparkSession
    by = [_by(o) for o in order]
    n = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [b.col.alias(f"_o{i}") for i, b in enumerate(by)]
    drawn = df.select(*keys).orderBy(F.xxhash64(*[F.col(f"_o{i}") for i in range(len(by))])).limit(SAMPLE_PER_RANGE * n)
    sample = drawn.orderBy(*[By(f"_o{i}", b.descending).sort for i, b in enumerate(by)]).collect()  # bounded
    bounds = []
    for r in range(1, n):
        row = tuple(sample[r * len(sample) // n]) if sample else None
        if row is not None and (not bounds or row != bounds[-1]):
            bounds.append(row)
    number = _range_number(by, bounds)
    return df.withColumn(PART, number).repartitionById(len(bounds) + 1, F.col(PART))


_FOLD = {"sum": F.sum, "max": F.max}


def running(
    df: DataFrame,
    order: list[Column | str | By],
    values: dict[str, tuple[str, Column]],
    keys: list[str] = (),
    inclusive: bool = True,
) -> DataFrame:
    """Add running aggregates over ``order`` (a total order) within each ``keys`` group.

    ``values`` maps an output name to ("sum" | "max", expression).  With ``inclusive=False`` the
    current row is left out, and the first row of a group gets null.
    """
    return over_layout(range_layout(df, *keys, *order), order, values, keys, inclusive)


def over_layout(
    laid: DataFrame,
    order: list[Column | str | By],
    values: dict[str, tuple[str, Column]],
    keys: list[str] = (),
    inclusive: bool = True,
) -> DataFrame:
    """``running`` on rows dealt into ranges of (keys, order) by ``range_layout``."""
    ensure_checkpoint_dir(laid.sparkSession)
    keys = list(keys)
    sorts = [_by(o).sort for o in order]
    end = 0 if inclusive else -1
    local = Window.partitionBy(PART, *keys).orderBy(*sorts).rowsBetween(Window.unboundedPreceding, end)
    # running values inside each range, with the range's own total per group; stored, so the rows are dealt once
    done = laid.select(
        *laid.columns,
        *[_FOLD[how](expr).over(local).alias(f"_l_{name}") for name, (how, expr) in values.items()],
        *[_FOLD[how](expr).over(Window.partitionBy(PART, *keys)).alias(f"_t_{name}") for name, (how, expr) in values.items()],
    ).checkpoint()
    totals = done.groupBy(*keys, PART).agg(*[F.first(f"_t_{name}").alias(f"_t_{name}") for name in values])
    before = Window.partitionBy(*keys).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(PART))
    offsets = totals.select(
        *keys, PART, first.alias("_first"),
        *[_FOLD[how](f"_t_{name}").over(before).alias(f"_o_{name}") for name, (how, _) in values.items()],
    ).where(F.col("_first") > 1)  # a group that began in an earlier range: at most one per range
    o = offsets.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col(PART).alias("_k_part"), *[f"_o_{name}" for name in values])
    match = F.col("_k_part") == F.col(PART)
    for k in keys:
        match = match & F.col(f"_k_{k}").eqNullSafe(F.col(k))
    joined = done.join(F.broadcast(o), match, "left")
    return joined.select(
        *[c for c in laid.columns if c != PART],
        *[_combine(how, F.col(f"_o_{name}"), F.col(f"_l_{name}")).alias(name) for name, (how, _) in values.items()],
    )


def _combine(how: str, offset: Column, local: Column) -> Column:
    if how == "max":
        return F.greatest(offset, local)
    return F.when(offset.isNull(), local).when(local.isNull(), offset).otherwise(offset + local)


@dataclass
class Layout:
    """Entities ranked by value (largest first, ties by entity), with cheap cut-offs.

    Only the range holding a cut-off is sorted; all others contribute their totals.
    """

    ranked: DataFrame  # entity, value, _part

    #: The order of ``ranked``.
    ORDER = (By("value", True), By("entity"))

    @classmethod
    def of(cls, totals: DataFrame, entity: str = "entity", value: str = "value") -> "Layout":
        """The totals are stored first: the layout reads them more than once, and they are far fewer than the rows."""
        ensure_checkpoint_dir(totals.sparkSession)
        kept = totals.select(F.col(entity).alias("entity"), F.col(value).alias("value")).checkpoint()
        return cls(range_layout(kept, *cls.ORDER))

    @cached_property
    def parts(self) -> list:
        """(range number, rows, total, total of positives): one row per shuffle partition."""
        value = F.col("value")
        rows = self.ranked.groupBy(PART).agg(
            F.count("*").alias("n"),
            F.sum(value).alias("total"),
            F.coalesce(F.sum(F.when(value > 0, value)), F.sum(value) * 0).alias("gain"),
        )
        return sorted((r[PART], r["n"], r["total"], r["gain"]) for r in rows.collect())

    @property
    def n(self) -> int:
        return sum(p[1] for p in self.parts)

    @property
    def total(self):
        return sum(p[2] for p in self.parts) if self.parts else None

    def _inside(self, part: int) -> DataFrame:
        order = Window.partitionBy(PART).orderBy(F.col("value").desc(), "entity")
        return (
            self.ranked.where(F.col(PART) == part)
            .withColumn("k", F.row_number().over(order))
            .withColumn("run", F.sum("value").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        )

    def top_sum(self, k: int):
        """Total of the ``k`` largest."""
        done, acc = 0, None
        for part, n, total, _ in self.parts:
            if done + n <= k:
                done, acc = done + n, total if acc is None else acc + total
                continue
            if k > done:
                rest = self._inside(part).where(F.col("k") == k - done).select("run").first()["run"]
                acc = rest if acc is None else acc + rest
            break
        return acc

    def smallest_reaching(self, goal):
        """Least k whose k largest sum to ``goal`` or more; None if never reached."""
        done, acc = 0, None
        for part, n, total, gain in self.parts:
            peak = gain if acc is None else acc + gain  # values fall, so positives come first
            if peak >= goal:
                rest = goal if acc is None else goal - acc
                hit = self._inside(part).where(F.col("run") >= F.lit(rest)).agg(F.min("k").alias("k")).first()["k"]
                if hit is not None:
                    return done + hit
            done, acc = done + n, total if acc is None else acc + total
        return None
