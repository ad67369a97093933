"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters of text that one step of vectorised work holds at a time; batches are cut to this before they are expanded.
STEP_CHARS = 1_000_000

_OWN: dict[str, str] = {}
_WRITTEN: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table. Python workers get the place of this package, in case it is not installed where they run."""
    root = str(Path(__file__).resolve().parents[2])
    paths = spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([root, *filter(None, paths)])
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Only a single-machine session without that setting gets a private one."""
    given = spark.conf.get("spark.checkpoint.dir", None)
    if given:
        return given.rstrip("/")
    context = spark.sparkContext
    if context.getCheckpointDir():
        return context.getCheckpointDir().rstrip("/")
    if not (context.master == "local" or context.master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if context.applicationId not in _OWN:
        _OWN[context.applicationId] = tempfile.mkdtemp(prefix="tablescope-")
    return "file://" + _OWN[context.applicationId]


def new_path(spark: SparkSession, name: str, lasting: bool = False) -> str:
    """A path of its own in the shared folder; release() deletes it unless it is lasting."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if not lasting:
        _WRITTEN.append(path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """The frame written as a Parquet table in the shared folder and read again: lineage ends there."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def mark() -> int:
    """A point in the list of written tables: ``release(spark, since=mark())`` later frees only what came after it."""
    return len(_WRITTEN)


def release(spark: SparkSession, since: int = 0) -> None:
    """Deletes the tables that this driver wrote to the shared folder after the point ``since`` (all by default).
    Results that still read them must be stored first; tables written before the point are left alone."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    while len(_WRITTEN) > since:
        path = jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
        path.getFileSystem(conf).delete(path, True)


def by_text(
    df: DataFrame, key: str, text: str, work: Callable[[], Callable[[list[str]], dict[str, list]]], schema: str
) -> DataFrame:
    """One output row per input row: ``key`` and the columns that work gives for its text (null: empty text).

    ``work()`` is called once per task and returns a function of a list of texts.  ``schema`` has the new columns.
    Texts come in groups of about STEP_CHARS characters, a longer text on its own.
    """
    slim = df.select(F.col(key).alias("_key"), F.col(text).cast("string").alias("_text"))
    kind = slim.schema["_key"].dataType.simpleString()
    out_schema = f"_key {kind}, {schema}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        act = work()
        for batch in batches:
            for at, texts in text_groups(batch.column(1)):
                found = act(texts)
                keys = batch.column(0).slice(at, len(texts))
                yield pa.RecordBatch.from_arrays([keys, *[as_array(v) for v in found.values()]], names=["_key", *found])

    return slim.mapInArrow(run, out_schema).withColumnRenamed("_key", key)


def as_array(values) -> pa.Array:
    return values if isinstance(values, pa.Array) else pa.array(values)


def text_groups(column: pa.Array, limit: int = STEP_CHARS) -> Iterator[tuple[int, list[str]]]:
    """(index of the first, texts) of consecutive texts with about limit characters together; null is empty."""
    start, group, size = 0, [], 0
    for i in range(len(column)):
        value = column[i].as_py() or ""
        if group and size + len(value) > limit:
            yield start, group
            start, group, size = i, [], 0
        group.append(value)
        size += len(value)
    if group:
        yield start, group


def input_bytes(df: DataFrame) -> int:
    """Spark's own estimate of the bytes that a frame reads."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


#: Rows of the bounded sample that measures the bytes of a row when Spark does not know a frame's size.
SIZE_SAMPLE_ROWS = 1000


def parts_for(df: DataFrame, bytes_each: int) -> int:
    """Partitions that take about bytes_each of the input each, and no fewer than the session's shuffle partitions.

    Spark's estimate is taken where it knows the size, however large.  Where it does not, the estimate is the session's
    default size (``spark.sql.defaultSizeInBytes``, as for frames that no file backs): then the rows are counted and
    the bytes of a row measured on a bounded sample (text and binary columns by their bytes, others 8 each).
    """
    spark = df.sparkSession
    set_to = int(spark.conf.get("spark.sql.shuffle.partitions"))
    unknown = int(spark.conf.get("spark.sql.defaultSizeInBytes", str((1 << 63) - 1)).rstrip("bB"))
    size = input_bytes(df)
    if size >= unknown:
        kinds = [(f.name, f.dataType.simpleString()) for f in df.schema.fields]
        widths = [F.coalesce(F.octet_length(F.col(n)), F.lit(0)) if t in ("string", "binary") else F.lit(8) for n, t in kinds]
        row = df.limit(SIZE_SAMPLE_ROWS).select(sum(widths, F.lit(0)).alias("w")).agg(F.avg("w").alias("w")).first()
        size = int(df.count() * (row["w"] or 0))
    return int(max(set_to, -(-size // bytes_each)))
