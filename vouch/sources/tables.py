"""Reading data tables and projecting away protected columns."""

from __future__ import annotations

from collections.abc import Iterable
from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vouch.functions import fixed
from vouch.sources.csv_records import has_line_breaks, read_records

_INTEGER_TEXT = r"\A\s*[+-]?\d{1,19}\s*\z"
_NUMBER_TEXT = r"\A\s*[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?\s*\z|\A\s*[+-]?(?i:inf|infinity)\s*\z"
_BOOLEAN_TEXT = r"\A(?:True|TRUE|true|False|FALSE|false)\z"


def quoted(name: str) -> str:
    """Column name quoted, so that dots and spaces in it are taken literally."""
    return "`" + name.replace("`", "``") + "`"


def column(name: str) -> Column:
    return F.col(quoted(name))


def read_table(
    spark: SparkSession, path: str, schema: T.StructType | None = None, *, multi_line: bool | None = None
) -> DataFrame:
    """Read a CSV or Parquet table; anything else is refused.  ``multi_line`` as in ``read_csv``."""
    suffix = PurePosixPath(path.rstrip("/")).suffix.lower()
    if suffix == ".parquet":
        return normalise(spark.read.parquet(path))
    if suffix == ".csv":
        return normalise(read_csv(spark, path, schema, multi_line=multi_line))
    raise ValueError(f"Unsupported file type: {suffix}")


def read_csv(
    spark: SparkSession, path: str, schema: T.StructType | None = None, *, multi_line: bool | None = None
) -> DataFrame:
    """Read a CSV with header.

    Values with line breaks are found in a first pass over the text; a file that has some is read
    by all tasks, see ``csv_records``.  ``multi_line=False`` makes them an error, ``True``
    leaves them to Spark's own reader, which takes one task per file.

    Without a schema the types are inferred in one aggregate pass over the
    text: whole numbers, numbers, booleans, otherwise text.  Dates stay text,
    and the usual missing-value texts become null.
    """
    spanning = multi_line is not True and has_line_breaks(spark, path)
    if spanning and multi_line is False:
        raise ValueError("A value holds a line break: read the file without multi_line=False")
    reader = spark.read.option("header", True).option("quote", '"').option("escape", '"').option("multiLine", bool(multi_line))
    if schema is not None:
        if not spanning:
            return reader.schema(schema).csv(path)
        texts = read_records(spark, path)
        return texts.select(*[column(c).try_cast(f.dataType).alias(f.name) for c, f in zip(texts.columns, schema.fields)])
    raw = read_records(spark, path) if spanning else reader.csv(path)
    present = {
        name: F.when(~column(name).isin(fixed.CSV_MISSING), column(name)) for name in raw.columns
    }
    tests = []
    for index, value in enumerate(present.values()):
        tests += [
            F.bool_and(F.when(
                value.isNotNull(), value.rlike(_INTEGER_TEXT) & value.try_cast("bigint").isNotNull(),
            )).alias(f"i{index}"),
            F.bool_and(value.rlike(_NUMBER_TEXT)).alias(f"d{index}"),
            F.bool_and(value.rlike(_BOOLEAN_TEXT)).alias(f"b{index}"),
            F.count(value).alias(f"n{index}"),
        ]
    if not tests:
        return raw
    seen = raw.agg(*tests).first()
    out = []
    for index, (name, value) in enumerate(present.items()):
        if seen[f"i{index}"]:
            value = value.try_cast("bigint")
        elif seen[f"d{index}"] or seen[f"n{index}"] == 0:
            value = value.try_cast("double")
        elif seen[f"b{index}"]:
            value = value.try_cast("boolean")
        out.append(value.alias(name))
    return raw.select(*out)


def normalise(df: DataFrame) -> DataFrame:
    """NaN becomes null and decimals become double; everything else passes through."""
    out = []
    for field in df.schema.fields:
        value = column(field.name)
        if isinstance(field.dataType, (T.FloatType, T.DoubleType)):
            value = F.when(~F.isnan(value), value).alias(field.name)
        elif isinstance(field.dataType, T.DecimalType):
            value = value.cast("double").alias(field.name)
        out.append(value)
    return df.select(*out)


def safe_projection(df: DataFrame, protected: Iterable[str]) -> DataFrame:
    """Drop the protected columns; the scan then never reads them."""
    hidden = set(protected)
    return df.select(*[column(name) for name in df.columns if name not in hidden])


def dtype_name(data_type: T.DataType) -> str:
    """Short type name used by the column catalogue."""
    names = {
        T.ByteType: "int8", T.ShortType: "int16", T.IntegerType: "int32", T.LongType: "int64",
        T.FloatType: "float32", T.DoubleType: "float64", T.BooleanType: "bool",
        T.StringType: "str", T.DateType: "date", T.TimestampType: "timestamp",
        T.TimestampNTZType: "timestamp",
    }
    for kind, name in names.items():
        if isinstance(data_type, kind):
            return name
    return data_type.simpleString()


def is_numeric(dtype: str) -> bool:
    return dtype.startswith(("int", "float")) or dtype == "bool"
