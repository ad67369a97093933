"""Finding hot join keys and how far to spread each of them."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

ROWS_PER_TASK = 2_000_000  # rows of one key that a task should take
BUCKETS = 1 << 16  # hash buckets of keys counted in the first pass; one number each comes back
LISTED = 1 << 12  # full buckets up to which the second pass reads only their rows; of more, it counts all keys


def size_estimate(df: DataFrame) -> int | None:
    """The optimizer's size estimate in bytes, None if the session does not expose it."""
    try:
        return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    except Exception:
        return None


def broadcast_limit(spark) -> int:
    text = spark.conf.get("spark.sql.autoBroadcastJoinThreshold", "10485760").strip().lower()
    units = {"b": 1, "k": 2**10, "kb": 2**10, "m": 2**20, "mb": 2**20, "g": 2**30, "gb": 2**30}
    digits = text.rstrip("abcdefghijklmnopqrstuvwxyz")
    return int(digits) * units.get(text[len(digits):], 1)


def can_broadcast(left: DataFrame, right: DataFrame, how: str) -> bool:
    """Whether Catalyst will send a whole side to every task for this join type, so that no key is gathered anywhere."""
    limit = broadcast_limit(left.sparkSession)
    sides = {"inner": (left, right), "left": (right,), "full": ()}[how]
    sizes = [size_estimate(side) for side in sides]
    return any(size is not None and size <= limit for size in sizes)


def hot_keys(df: DataFrame, key: Column, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Every key with more than rows_per_task rows, as rows (_hk, n): n its rows.  Exact and without a cap.

    First the rows of each of BUCKETS hash buckets of the key are counted (partial counts per task, BUCKETS numbers
    to the driver).  A key over the target lies in a bucket over it, so only rows of such buckets are counted by key,
    again with partial counts before the shuffle.  The result has at most rows / rows_per_task keys, whatever the
    table's size; null is one key.  The counts only steer how rows are spread: every row is joined whatever they say.
    """
    found = hot_counts([(df, key)], rows_per_task)
    return df.select(key.alias("_hk"), F.lit(0).cast("long").alias("n")).limit(0) if found is None else found.select("_hk", F.col("_n0").alias("n"))


def hot_counts(sides: list[tuple[DataFrame, Column]], rows_per_task: int | None, pairs: int | None = None) -> DataFrame | None:
    """``hot_keys`` of one or two frames with the rows of both (_hk, _n0, _n1), their buckets counted in one job.

    With ``pairs`` also every key whose rows of one side times those of the other are more.  Such a key lies in a
    bucket for which that holds.  None if no bucket is over a target; without ``rows_per_task`` only pairs count.
    """
    # one union first, so that keys of both sides have one type and one bucket
    keyed = reduce(DataFrame.unionAll, [df.select(key.alias("_hk"), F.lit(i).alias("_s")) for i, (df, key) in enumerate(sides)])
    keyed = keyed.withColumn("_b", F.pmod(F.xxhash64("_hk"), F.lit(BUCKETS)))
    rows = [F.count_if(F.col("_s") == i).alias(f"_n{i}") for i in range(2)]
    over = F.lit(False)
    if rows_per_task is not None:
        over = over | (F.col("_n0") > rows_per_task) | (F.col("_n1") > rows_per_task)
    if pairs is not None:
        over = over | (F.col("_n0").cast("double") * F.col("_n1") > pairs)
    full = [r["_b"] for r in keyed.groupBy("_b").agg(*rows).where(over).select("_b").collect()]  # <= BUCKETS
    if not full:
        return None
    if len(full) <= LISTED:
        keyed = keyed.where(F.col("_b").isin(full))
    return keyed.groupBy("_hk").agg(*rows).where(over)


def spread_over(rows: Column, rows_per_task: int) -> Column:
    """Places for a key's rows: each place aims at half the target, so that the spread of hashing stays within it."""
    return F.greatest(F.lit(1), F.ceil(rows * 2 / F.lit(rows_per_task))).cast("long")
