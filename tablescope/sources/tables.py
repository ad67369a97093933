"""Loading sets of tables, row counts and small repeatable samples."""

from __future__ import annotations

import csv
import io
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..functions import clean, col, is_floating

# The cell texts a CSV reader takes as missing.
MISSING_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]

_INTEGER = r"^\s*[+-]?[0-9]+\s*$"
_NUMBER = r"^\s*[+-]?(([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?|(?i:inf|infinity))\s*$"
_TRUTH = r"^(True|TRUE|true|False|FALSE|false)$"


class TableSet(dict):
    """Tables by name, in the given order.  Values are lazy DataFrames.

    ``skipped`` names what a loader found in a folder and did not read.
    """

    skipped: list[str] = []

    def register(self) -> "TableSet":
        """Make every table a temp view, so that ``spark.sql`` can use it."""
        for name, df in self.items():
            df.createOrReplaceTempView("`" + name.replace("`", "``") + "`")
        return self


def _stem(path: str) -> str:
    name = path.rstrip("/").rsplit("/", 1)[-1]
    return name.rsplit(".", 1)[0] if "." in name else name


def missing_norm(df: DataFrame, tokens: list[str] | None = None) -> DataFrame:
    """NaN becomes null; with ``tokens`` those texts in string columns become null too."""
    out = []
    for field in df.schema.fields:
        value = clean(df, field.name)
        if tokens is not None and isinstance(field.dataType, T.StringType):
            value = F.when(~value.isin(tokens), value)
        out.append(value.alias(field.name))
    return df.select(*out)


def _number_text(item: Column) -> Column:
    # Java spells infinity one way only.
    return F.regexp_replace(F.trim(item), "(?i)(?:infinity|inf)$", "Infinity").cast("double")


def _part_headers(spark: SparkSession, path: str) -> dict[tuple[str, ...], list[str]]:
    """The header line of each CSV part below path (or of the file), grouped: header -> parts, parts in name order.

    Only the first line of each part is read, on the driver, through the file system (compressed parts too).
    """
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(conf)
    if fs.getFileStatus(root).isDirectory():
        names = sorted(str(st.getPath().toString()) for st in fs.listStatus(root) if st.isFile())
        names = [n for n in names if not n.rsplit("/", 1)[-1].startswith(("_", "."))]
    else:
        names = [str(root.toString())]
    codecs = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf)
    found: dict[tuple[str, ...], list[str]] = {}
    for name in names:
        part = jvm.org.apache.hadoop.fs.Path(name)
        stream = fs.open(part)
        codec = codecs.getCodec(part)
        if codec is not None:
            stream = codec.createInputStream(stream)
        reader = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(stream, "UTF-8"))
        try:
            line = reader.readLine()
        finally:
            reader.close()
        if line is None:  # an empty part holds no rows
            continue
        header = tuple(next(csv.reader(io.StringIO(str(line).lstrip("\ufeff")), escapechar=None)))
        found.setdefault(header, []).append(name)
    return found


def _csv_rows(spark: SparkSession, path: str | list[str], schema: T.StructType | str | None, multiline: bool) -> DataFrame:
    """The cells of a CSV file or folder of parts; a row with more cells than the header (or schema) is an error, a
    shorter one ends in nulls.

    Parts are read by their own headers and put together by name: the first part's header (or the schema) gives the
    columns and their order, a part without some of them gives nulls there, and a part with a column that is not among
    them is an error.
    """
    if isinstance(path, str):
        headers = _part_headers(spark, path)
        if len(headers) > 1:
            first = next(iter(sorted(headers.items(), key=lambda kv: kv[1][0])))[0]
            given = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
            kinds = {f.name: f.dataType for f in given.fields} if given is not None else {c: T.StringType() for c in first}
            unknown = sorted({c for h in headers for c in h} - set(kinds))
            if unknown:
                raise ValueError(f"CSV parts below {path} have columns that the others lack: {', '.join(unknown)}")
            parts = []
            for header, files in headers.items():
                own = T.StructType([T.StructField(c, kinds[c]) for c in header])
                df = _csv_rows(spark, files, own, multiline)
                parts.append(df.select(*[col(c) if c in header else F.lit(None).cast(t).alias(c) for c, t in kinds.items()]))
            return reduce(DataFrame.unionByName, parts)
    reader = spark.read.option("header", True).option("escape", '"').option("multiLine", multiline)
    reader = reader.option("nullValue", "\u0001").option("emptyValue", "")
    if schema is None:
        schema = T.StructType([T.StructField(c, T.StringType()) for c in reader.csv(path).columns])
    elif isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    if not schema.fields:
        return reader.csv(path)
    names = [f.name for f in schema.fields]
    over = "_over"
    while over in names:
        over += "_"
    # one cell more than there may be: it stays null unless a row is too long
    df = reader.schema(T.StructType([*schema.fields, T.StructField(over, T.StringType())])).csv(path)
    extra = F.concat(F.lit("a row has more cells than there are columns, the first of them: "), col(over))
    fits = F.when(col(over).isNotNull(), F.raise_error(extra).cast("boolean")).otherwise(True)
    return df.where(fits).select(*[col(c) for c in names])


def load_csv(
    spark: SparkSession, path: str, schema: T.StructType | str | None = None, multiline: bool = True
) -> TableSet:
    """One CSV file (or folder of parts) as a table named by the file stem.

    Missing tokens become null before types are chosen, so a number column with "N/A" cells stays a
    number column.  Dates stay text.  Give ``schema`` to skip the pass that chooses types.  Quoted cells may hold line
    breaks; where no cell does, ``multiline=False`` lets Spark read one file in many tasks.
    """
    if schema is not None:
        return TableSet({_stem(path): missing_norm(_csv_rows(spark, path, schema, multiline), MISSING_TOKENS)}).register()
    raw = missing_norm(_csv_rows(spark, path, None, multiline), MISSING_TOKENS)
    if raw.columns:
        checks = []
        for i, name in enumerate(raw.columns):
            value = col(name)
            fits = F.trim(value).try_cast("long").isNotNull()
            whole = value.rlike(_INTEGER)
            # A whole number too long for 64 bits stays text: double would change it.
            kinds = {"i": whole & fits, "n": value.rlike(_NUMBER) & (~whole | fits), "b": value.rlike(_TRUTH)}
            for kind, holds in kinds.items():
                held = F.bool_and(F.when(value.isNotNull(), holds))
                checks.append(F.coalesce(held, F.lit(False)).alias(f"{kind}{i}"))
            checks.append(F.count(value).alias(f"c{i}"))
        seen = raw.agg(*checks).first()
        out = []
        for i, name in enumerate(raw.columns):
            value = col(name)
            if seen[f"c{i}"] == 0:
                value = value.cast("double")  # nothing but missing cells
            elif seen[f"i{i}"]:
                value = F.trim(value).cast("long")
            elif seen[f"n{i}"]:
                value = _number_text(value)
            elif seen[f"b{i}"]:
                value = F.lower(value).cast("boolean")
            out.append(value.alias(name))
        raw = raw.select(*out)
    return TableSet({_stem(path): raw}).register()


def load_table_set(
    spark: SparkSession,
    folder: str,
    fmt: str = "parquet",
    tables: list[str] | None = None,
    schemas: dict[str, T.StructType | str] | None = None,
    multiline: bool = True,
) -> TableSet:
    """Many tables below one folder, ``<name>.<fmt>`` files or folders and ``<name>/`` folders.

    Tables keep the order of ``tables``, else name order.  Two paths of one name are an error.  Hidden entries and job
    markers are left out, files of other kinds are named in ``skipped`` of the result.  ``schemas`` (by table) and
    ``multiline`` go to the CSV reader.
    """
    found: dict[str, str] = {}
    skipped = []
    for path, is_folder in _children(spark, folder):
        base = path.rstrip("/").rsplit("/", 1)[-1]
        if base.startswith(("_", ".")):
            continue
        if base.endswith("." + fmt):
            name = base[: -len(fmt) - 1]
        elif is_folder:
            name = base
        else:
            skipped.append(base)
            continue
        if name in found:
            raise ValueError(f"two paths of the table {name!r}: {found[name]} and {path}")
        found[name] = path
    names = tables if tables is not None else sorted(found)
    absent = [n for n in names if n not in found]
    if absent:
        raise FileNotFoundError(f"no table {absent} in {folder}")

    def load(name: str) -> DataFrame:
        if fmt == "csv":
            return next(iter(load_csv(spark, found[name], (schemas or {}).get(name), multiline).values()))
        return spark.read.format(fmt).load(found[name])

    # Schemas are read side by side.
    with ThreadPoolExecutor(max_workers=8) as pool:
        out = TableSet(zip(names, pool.map(load, names)))
    out.skipped = sorted(skipped)
    return out.register()


def _children(spark: SparkSession, folder: str) -> list[tuple[str, bool]]:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted((str(s.getPath()), bool(s.isDirectory())) for s in fs.listStatus(path))


def _quoted(parts: list[str]) -> str:
    return ".".join("`" + part.replace("`", "``") + "`" for part in parts)


def load_catalog(spark: SparkSession, database: str | None = None) -> TableSet:
    """All tables and views of a catalog database, lazily."""
    out = TableSet()
    for table in sorted(spark.catalog.listTables(database), key=lambda t: t.name):
        out[table.name] = full_scan(spark, [*(table.namespace or []), table.name])
    return out


def load_jdbc(spark: SparkSession, url: str, tables: list[str], **options: str) -> TableSet:
    """Tables of a database reached by JDBC (the driver jar comes from the session).

    Pass ``partitionColumn``, ``lowerBound``, ``upperBound`` and ``numPartitions`` in ``options`` to read
    in parallel; without them a table arrives in one partition.
    """
    out = TableSet()
    for table in tables:
        out[table] = spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()
    return out.register()


def full_scan(spark: SparkSession, table: str | list[str]) -> DataFrame:
    """A whole table.  Parts of a name come as a list; a text with dots is one name if there is such a table or view."""
    if isinstance(table, str):
        table = [table] if "." not in table or spark.catalog.tableExists(_quoted([table])) else table.split(".")
    return spark.table(_quoted(table))


def _sample_order(df: DataFrame, key: list[str] | None) -> list[Column]:
    if key:
        text = F.concat_ws("|", *[col(k).cast("string") for k in key])
        return [F.md5(text), *[col(k) for k in key]]
    plain = [c for c, t in ((f.name, f.dataType) for f in df.schema.fields) if not isinstance(t, (T.MapType, T.VariantType))]
    return [F.xxhash64(*[col(c) for c in plain])]


def bounded_sample(df: DataFrame, n: int = 500, key: list[str] | None = None) -> DataFrame:
    """``n`` rows chosen by hash: repeatable whatever the partitioning.

    Each task keeps its n smallest hashes only.  ``key`` names the columns to hash, by md5, when the same
    rows must be found by another system; by default the whole row is hashed.
    """
    return df.orderBy(*_sample_order(df, key)).limit(n)


def semantic_sample(df: DataFrame, n: int = 5, key: list[str] | None = None) -> DataFrame:
    """A small readable sample: as ``bounded_sample``, floats rounded to 4 places."""
    sample = bounded_sample(df, n, key)
    return sample.select(
        *[
            (F.round(col(f.name), 4) if is_floating(f.dataType) else col(f.name)).alias(f.name)
            for f in sample.schema.fields
        ]
    )


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Exact row count and number of columns per table."""
    parts = [
        df.agg(F.count("*").alias("row_count")).select(
            F.lit(name).alias("table"), "row_count", F.lit(len(df.columns)).alias("n_columns")
        )
        for name, df in tables.items()
    ]
    return reduce(DataFrame.unionAll, parts)


def total_rows(tables: dict[str, DataFrame]) -> DataFrame:
    return row_counts(tables).agg(F.sum("row_count").alias("total_rows"))


def as_text(df: DataFrame, name: str) -> Column:
    """The value as sample text; missing stays null."""
    return clean(df, name).cast("string")


def sample_values(df: DataFrame, name: str, k: int = 3, hashing: str = "xxhash64") -> Column:
    """An aggregate giving k non-missing values, each the value with the least of k hashes.

    The buffer is k values, so all columns can sample in one pass; a value can be drawn twice.
    """
    value = as_text(df, name)
    if hashing == "md5":
        if k > 4:
            raise ValueError("md5 gives at most 4 draws")
        digest = F.md5(value)
        draws = [
            F.min(F.when(value.isNotNull(), F.struct(F.substring(digest, 1 + 8 * i, 8).alias("h"), value.alias("v"))))
            for i in range(k)
        ]
        return F.array(*[d["v"] for d in draws])
    draws = [F.min_by(value, F.when(value.isNotNull(), F.xxhash64(F.lit(i), value))) for i in range(k)]
    return F.array(*draws)


def column_samples(df: DataFrame, k: int = 3, hashing: str = "xxhash64") -> DataFrame:
    """k non-missing example values per column, as strings."""
    names = [f.name for f in df.schema.fields if not isinstance(f.dataType, (T.MapType, T.ArrayType, T.StructType))]
    if not names:
        return df.sparkSession.createDataFrame([], "column string, sample_values array<string>")
    row = df.agg(*[sample_values(df, n, k, hashing).alias(f"s{i}") for i, n in enumerate(names)])
    cells = [
        F.struct(F.lit(n).alias("column"), F.filter(f"s{i}", lambda v: v.isNotNull()).alias("sample_values"))
        for i, n in enumerate(names)
    ]
    return row.select(F.inline(F.array(*cells)))


def draw_values(df: DataFrame, name: str, k: int = 3) -> Column:
    """An aggregate giving k non-missing values of a column as text, each the one with the least of k hashes.

    Hashes and buffers are of the column's own values, so numbers and dates stay numbers while the table is measured:
    only the k values drawn are turned into text, after the aggregate.  A value can be drawn twice.
    """
    value = clean(df, name)
    return F.array(*[F.min_by(value, F.when(value.isNotNull(), F.xxhash64(F.lit(i), value))).cast("string") for i in range(k)])
