"""Column-level building blocks: type tests, the missing-value notion, comparable keys.

"Missing" is null, or NaN in a float column.  Infinity is not missing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

_INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_FLOATING = (T.FloatType, T.DoubleType)
_DATETIME = (T.DateType, T.TimestampType, T.TimestampNTZType)
_NESTED = (T.ArrayType, T.MapType, T.StructType, T.VariantType, T.DayTimeIntervalType,
           T.YearMonthIntervalType, T.CalendarIntervalType, T.BinaryType)


def is_integral(dtype: T.DataType) -> bool:
    return isinstance(dtype, _INTEGRAL)


def is_floating(dtype: T.DataType) -> bool:
    return isinstance(dtype, _FLOATING)


def is_number(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.NumericType)


def is_boolean(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.BooleanType)


def is_datetime(dtype: T.DataType) -> bool:
    return isinstance(dtype, _DATETIME)


def classifiable(dtype: T.DataType) -> bool:
    """Arrays, maps, structs, binaries and intervals have no category."""
    return not isinstance(dtype, _NESTED)


def col(name: str) -> Column:
    """A column by its literal name, also when it holds dots or backticks."""
    return F.col("`" + name.replace("`", "``") + "`")


def required(df: DataFrame, *names: str) -> None:
    for name in names:
        if name not in df.columns:
            raise KeyError(f"Column '{name}' not found")


def is_missing(df: DataFrame, name: str) -> Column:
    if is_floating(df.schema[name].dataType):
        return col(name).isNull() | F.isnan(col(name))
    return col(name).isNull()


def present(df: DataFrame, name: str) -> Column:
    return ~is_missing(df, name)


def clean(df: DataFrame, name: str) -> Column:
    """The column with NaN turned into null; other types unchanged."""
    if is_floating(df.schema[name].dataType):
        return F.when(~F.isnan(col(name)), col(name))
    return col(name)


def value_of(df: DataFrame, item: str | Column) -> Column:
    """A metric argument: a column name (NaN becomes null, boolean 0/1, number double)
    or any Column (NaN becomes null there too)."""
    if isinstance(item, Column):
        return F.when(~F.isnan(item), item) if is_floating(df.select(item).schema[0].dataType) else item
    required(df, item)
    dtype = df.schema[item].dataType
    if is_boolean(dtype):
        return col(item).cast("int").cast("double")
    if isinstance(dtype, T.NumericType) and not isinstance(dtype, T.DoubleType):
        return clean(df, item).cast("double")
    return clean(df, item)


def canonical_key(df: DataFrame, name: str) -> Column:
    """A text form under which equal values of different numeric types are equal.

    1, 1.0 and decimal 1.00 all give "1"; a long is never passed through double.
    """
    dtype = df.schema[name].dataType
    value = clean(df, name)
    if isinstance(dtype, T.DecimalType):
        text = value.cast("string")
        if dtype.scale == 0:
            return text
        return F.regexp_replace(F.regexp_replace(text, r"0+$", ""), r"\.$", "")
    if is_floating(dtype):
        # Beyond 17 digits on either side a decimal cannot hold what the shortest form of a double says.
        whole = (value == F.floor(value)) & (F.abs(value) < F.lit(2.0**53))
        plain = F.abs(value).between(F.lit(1e-15), F.lit(1e15))
        text = value.cast("string").try_cast("decimal(38,18)").cast("string")
        tidy = F.regexp_replace(F.regexp_replace(text, r"0+$", ""), r"\.$", "")
        exact = tidy.cast("double") == value
        return F.when(whole, value.cast("long").cast("string")).when(plain & exact, tidy).otherwise(value.cast("string"))
    return value.cast("string")


# Fixed value: the password part of a connection address, user:password@host.
CREDENTIALS = r"(://[^:]+:)([^@]+)(@)"


def redact_credentials(item: str | Column) -> Column:
    return F.regexp_replace(col(item) if isinstance(item, str) else item, CREDENTIALS, "$1***$3")
