"""Validation and profile: one catalogue row per column.

Counts of every column come from one aggregate.  Distinct counts and top values
come from a value-frequency table, one per type family, so that no row is
multiplied through many ``count(distinct)`` branches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vouch.functions import fixed
from vouch.session import broadcast_if_small, materialise
from vouch.sources.tables import column, dtype_name, is_numeric

_FAMILIES = {"long": ("int8", "int16", "int32", "int64"), "double": ("float32", "float64")}


def _family(data_type: T.DataType) -> str:
    name = dtype_name(data_type)
    for family, members in _FAMILIES.items():
        if name in members:
            return family
    return "text"


def _as_text(field: T.StructField) -> Column:
    if isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType, T.VariantType)):
        return F.to_json(F.struct(column(field.name).alias("v")))
    return column(field.name).cast("string")


def _rows_of(structs: list[Column], frame: DataFrame) -> DataFrame:
    """One output row per struct of a one-row frame."""
    return frame.select(F.inline(F.array(*structs)))


def column_counts(df: DataFrame) -> DataFrame:
    """(ord, column, dtype, row_count, missing_count), one aggregate over the table."""
    totals = df.agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.count(column(f.name)).alias(f"c{i}") for i, f in enumerate(df.schema.fields)],
    )
    return _rows_of(
        [
            F.struct(
                F.lit(i).alias("ord"),
                F.lit(f.name).alias("column"),
                F.lit(dtype_name(f.dataType)).alias("dtype"),
                F.col("rows").alias("row_count"),
                (F.col("rows") - F.col(f"c{i}")).alias("missing_count"),
            )
            for i, f in enumerate(df.schema.fields)
        ],
        totals,
    )


def value_frequencies(df: DataFrame, family: str | None = None) -> dict[str, DataFrame]:
    """Per type family: (ord, value, n) over the non-null values of its columns."""
    groups: dict[str, list[tuple[int, T.StructField]]] = {}
    for index, field in enumerate(df.schema.fields):
        groups.setdefault(_family(field.dataType), []).append((index, field))
    out = {}
    for name, members in groups.items():
        if family is not None and name != family:
            continue
        cells = [
            F.struct(
                F.lit(i).alias("ord"),
                (column(f.name).cast(name) if name != "text" else _as_text(f)).alias("value"),
            )
            for i, f in members
        ]
        out[name] = (
            df.select(F.inline(F.array(*cells)))
            .filter(F.col("value").isNotNull())
            .groupBy("ord", "value")
            .agg(F.count(F.lit(1)).alias("n"))
        )
    return out


# Cells that a task folds at a time before they travel.
FOLDED_CELLS = 1 << 21


def folded_cells(batches: Iterator[pa.RecordBatch], most: int = FOLDED_CELLS) -> Iterator[pa.RecordBatch]:
    """(ord, a, b, n): equal cells (ord, a, b) of about ``most`` in a row put together, in memory that does not grow."""
    def fold() -> Iterator[pa.RecordBatch]:
        ord_, a, b = (np.concatenate(part) for part in zip(*held))
        at = np.argsort(a)
        ord_, a, b = ord_[at], a[at], b[at]
        first = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (ord_[1:] != ord_[:-1]))))
        columns = [ord_[first], a[first], b[first], np.diff(first, append=len(a))]
        for start in range(0, len(first), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(c[start:start + (1 << 16)]) for c in columns], ["ord", "a", "b", "n"])

    held: list[tuple[np.ndarray, ...]] = []
    for batch in batches:
        if batch.num_rows:
            held.append(tuple(c.to_numpy(zero_copy_only=False) for c in batch.columns))
        if sum(len(part[0]) for part in held) >= most:
            yield from fold()
            held = []
    if held:
        yield from fold()


def hashed_counts(df: DataFrame) -> DataFrame:
    """(ord, non_null, unique_count) of every column and, at ord -1, the number of rows, in one scan.

    Values go by two 64-bit hashes, so that long texts are not shuffled to be counted.  Before
    they travel, equal ones are put together in pieces of the scan and not in a table of all of its
    task's distinct values, which grows with the rows of a task.
    """
    cells = [F.struct(F.lit(-1).alias("ord"), F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"))]
    for i, field in enumerate(df.schema.fields):
        family = _family(field.dataType)
        value = column(field.name).cast(family) if family != "text" else _as_text(field)
        if family == "double":
            value = value + F.lit(0.0)  # -0.0 is 0.0
        cells.append(F.when(value.isNotNull(), F.struct(
            F.lit(i).alias("ord"), F.xxhash64(value).alias("a"), F.xxhash64(F.lit(1), value).alias("b"))))
    values = df.select(F.explode(F.array(*cells)).alias("v")).filter("v is not null").select("v.*")
    folded = values.mapInArrow(folded_cells, "ord int, a long, b long, n long").repartition("ord", "a", "b")
    return folded.groupBy("ord", "a", "b").agg(F.sum("n").alias("n")).groupBy("ord").agg(
        F.sum("n").alias("non_null"), F.count(F.lit(1)).alias("unique_count"))


def profile_columns(df: DataFrame) -> DataFrame:
    """Catalogue: ord, column, dtype, row_count, missing_count, missing_percentage, unique_count."""
    # One row per column of the schema from here on.
    found = hashed_counts(df).agg(F.map_from_entries(F.collect_list(
        F.struct("ord", F.struct("non_null", "unique_count")))).alias("m"))

    def counted(i: int, part: str) -> Column:
        return F.coalesce(F.col("m")[F.lit(i)][part], F.lit(0).cast("long"))

    rows = _rows_of([
        F.struct(
            F.lit(i).alias("ord"), F.lit(f.name).alias("column"), F.lit(dtype_name(f.dataType)).alias("dtype"),
            counted(-1, "non_null").alias("row_count"), (counted(-1, "non_null") - counted(i, "non_null")).alias("missing_count"),
            counted(i, "unique_count").alias("unique_count"))
        for i, f in enumerate(df.schema.fields)
    ], found)
    share = F.when(F.col("row_count") > 0, F.col("missing_count") / F.col("row_count") * 100)
    return rows.select(
        "ord", "column", "dtype", "row_count", "missing_count", F.bround(share, 2).alias("missing_percentage"), "unique_count")


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if is_numeric(dtype_name(f.dataType))]


def profile_numeric(df: DataFrame) -> DataFrame:
    """(column, min, max, mean, median, std) of numeric columns; all-null columns are left out."""
    from vouch.operators.describe import basic_statistics
    from vouch.operators.quantiles import medians

    names = numeric_columns(df)
    if not names:
        return df.sparkSession.createDataFrame([], "column string, min double, max double, mean double, median double, std double")
    basics = basic_statistics(df, names)
    return (
        basics.filter(F.col("count") > 0)
        .join(F.broadcast(medians(df, names)), "measure", "left")
        .select(
            F.col("measure").alias("column"), "min", "max",
            F.bround("mean", 4).alias("mean"), "median", F.bround("std", 4).alias("std"),
        )
    )


# Leading characters of a text that are counted with its hashes, to tell early which of many ties come first.
_START = 24


def top_values(df: DataFrame, k: int = fixed.TOP_VALUES) -> DataFrame:
    """(column, rank, value, n): the k most frequent values of each text column, ties by value.

    Texts are counted by 128 bits of hash, on the map side first, and do not travel for that.  The
    counts and the first characters say which hashes can be among the k; a second pass fetches
    their texts.  Should very many ties begin alike, that pass joins by hash instead of broadcasting.
    """
    texts = df.select(*[column(f.name) for f in df.schema.fields if isinstance(f.dataType, T.StringType)])
    if not texts.columns:
        return df.sparkSession.createDataFrame([], "column string, rank int, value string, n long")
    names = F.array(*[F.lit(c) for c in texts.columns])
    cells = F.array(*[F.struct(F.lit(i).alias("ord"), column(c).alias("value")) for i, c in enumerate(texts.columns)])
    value = F.col("value")
    hashed = texts.select(F.inline(cells)).filter(value.isNotNull()).select(
        "ord", F.xxhash64(value).alias("a"), F.xxhash64(F.lit(1), value).alias("b"), F.substring(value, 1, _START).alias("start"), "value")
    counts = materialise(hashed.groupBy("ord", "a", "b", "start").agg(F.count(F.lit(1)).alias("n")), "value-counts")
    # Spark keeps k rows per column and task before the shuffle (window group limit).
    ahead = Window.partitionBy("ord").orderBy(F.desc("n"), F.asc("start"))
    last = counts.withColumn("_rank", F.row_number().over(ahead)).filter(F.col("_rank") <= k).groupBy("ord").agg(
        F.max_by(F.struct("n", "start"), "_rank").alias("last"))  # one row per column
    chosen = counts.join(F.broadcast(last), "ord").filter(
        (F.col("n") > F.col("last.n")) | ((F.col("n") == F.col("last.n")) & (F.col("start") <= F.col("last.start")))).select("ord", "a", "b", "n")
    chosen = broadcast_if_small(materialise(chosen, "value-candidates"))
    found = hashed.select("ord", "a", "b", "value").join(chosen, ["ord", "a", "b"]).groupBy("ord", "a", "b", "n").agg(F.min("value").alias("value"))
    rank = F.row_number().over(Window.partitionBy("ord").orderBy(F.desc("n"), F.asc("value")))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select(F.element_at(names, F.col("ord") + 1).alias("column"), "rank", "value", "n")


def missing_values(df: DataFrame) -> DataFrame:
    """(column, missing_count) of the columns that have missing cells."""
    return column_counts(df).filter(F.col("missing_count") > 0).select("column", "missing_count")


def row_digest(df: DataFrame) -> Column:
    """256-bit digest of a whole row, nulls kept apart from every value."""
    cells = []
    for index, field in enumerate(df.schema.fields):
        value = column(field.name)
        if isinstance(field.dataType, (T.TimestampType, T.TimestampNTZType)):
            value = value.cast("string")  # JSON would cut the microseconds
        elif isinstance(field.dataType, (T.FloatType, T.DoubleType)):
            value = value + 0.0  # -0.0 equals 0.0
        cells.append(value.alias(f"c{index}"))
    return F.unhex(F.sha2(F.to_json(F.struct(*cells), {"ignoreNullFields": "false"}), 256))


def duplicate_rows(df: DataFrame) -> DataFrame:
    """One row: duplicate_rows = rows that repeat an earlier row.

    Rows are shuffled as 32-byte digests, counted map-side first, so neither
    wide rows nor one row repeated a billion times travel as they are.
    """
    copies = df.select(row_digest(df).alias("d")).groupBy("d").agg(F.count(F.lit(1)).alias("n"))
    return copies.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_rows"))


def validation_summary(df: DataFrame) -> DataFrame:
    """One row: valid, errors, warnings, row_count, column_count, column_names, missing map, duplicates."""
    names = df.columns
    repeated = [name for i, name in enumerate(names) if name in names[:i]]
    if repeated:
        # Counting needs unambiguous names; the verdict reports the originals.
        df = df.toDF(*[f"{name}_{i}" for i, name in enumerate(names)])
    counts = column_counts(df) if names else df.select(
        F.lit(None).cast("int").alias("ord"), F.lit(None).cast("string").alias("column"),
        F.lit(None).cast("string").alias("dtype"), F.lit(0).cast("long").alias("row_count"),
        F.lit(0).cast("long").alias("missing_count"),
    ).limit(0)
    entry = F.struct(F.col("column"), F.col("missing_count"))
    per_table = counts.agg(
        F.coalesce(F.max("row_count"), F.lit(0)).alias("row_count"),
        F.map_from_entries(
            F.array_sort(F.collect_list(F.when(F.col("missing_count") > 0, entry)))
        ).alias("missing_values"),
    )
    copies = duplicate_rows(df) if names else per_table.select(F.lit(0).cast("long").alias("duplicate_rows"))
    errors = F.array_compact(F.array(
        F.when(F.col("row_count") == 0, F.lit("Dataset contains no rows.")),
        F.when(F.lit(not names), F.lit("Dataset contains no columns.")),
        F.when(F.lit(bool(repeated)), F.lit(f"Duplicate column names found: {repeated}")),
    ))
    warnings = F.array_compact(F.array(
        F.when(F.size("missing_values") > 0, F.lit("Missing values detected.")),
        F.when(
            F.col("duplicate_rows") > 0,
            F.concat(F.col("duplicate_rows").cast("string"), F.lit(" duplicate rows detected.")),
        ),
    ))
    return (
        per_table.crossJoin(F.broadcast(copies))
        .withColumn("errors", errors)
        .withColumn("warnings", warnings)
        .select(
            (F.size("errors") == 0).alias("valid"), "errors", "warnings", "row_count",
            F.lit(len(names)).alias("column_count"),
            F.array(*[F.lit(n) for n in names]).cast("array<string>").alias("column_names"),
            "missing_values", "duplicate_rows",
        )
    )
