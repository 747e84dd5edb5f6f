"""Exact order statistics of many columns, per group, at any size.

A quartile here is the value at 0-based rank floor((n-1)q + 0.5); the median is
the mean of the two middle values.

Small groups: number the values of each group in order and pick the ranks.

Large groups: sorting would shuffle all their values, so the ranks are found by radix
selection.  A round counts values by bucket, on the map side first; running sums over the
counts say which bucket holds a rank.  A bucket of one value settles it, a small bucket is
sorted, a large one goes to the next round.  The buckets of the first round are 1024th parts of
powers of two; the next two rounds read the bit pattern of doubles, whose integer order is
that of the numbers, down to the last bit.  So every distribution ends there, and a
round has a bounded number of buckets per group.
Each group takes its own way: one dominant group does not put the others through rounds.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vouch.functions.numbers import order_key
from vouch.session import DEAL, GROUP_ROWS, broadcast_if_small, materialise
from vouch.sources.tables import column

# Cells (rows times columns) up to which all groups are sorted without counting them.
DIRECT_CELLS = 4_000_000
# Buckets per power of two in the first round; bits that remain unread after each further one.
FINENESS, ROUNDS = 1024, (21, 0)


def ranks(n: Column) -> dict[str, Column]:
    """0-based target ranks for a group of ``n`` values."""
    def nearest(q: float) -> Column:
        return F.floor((n - 1) * q + 0.5)

    return {
        "q1": nearest(0.25), "middle_low": F.floor((n - 1) / 2),
        "middle_high": F.ceil((n - 1) / 2), "q3": nearest(0.75),
    }


def long_form(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(by..., measure, value): one row per non-null cell, value as double."""
    cells = [F.struct(F.lit(c).alias("measure"), column(c).cast("double").alias("value")) for c in columns]
    return df.select(*by, F.inline(F.array(*cells))).filter(F.col("value").isNotNull())


def same_key(left: Column, right: Column, name: str) -> Column:
    return left == right if name == DEAL else left.eqNullSafe(right)


def null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join in which null keys meet; keeps the left keys."""
    renamed = right
    for key in keys:
        renamed = renamed.withColumnRenamed(key, f"_r_{key}")
    condition = F.lit(True)
    for key in keys:
        condition = condition & same_key(F.col(key), F.col(f"_r_{key}"), key)
    return left.join(renamed, condition, how).drop(*[f"_r_{key}" for key in keys])


def _pick(long: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The values at the target ranks, by sorting each group."""
    part = Window.partitionBy(*keys)
    placed = long.withColumn("_at", F.row_number().over(part.orderBy("value")) - 1).withColumn(
        "_total", F.count(F.lit(1)).over(part))
    found = placed.groupBy(*keys).agg(
        F.max("_total").alias("n"),
        *[
            F.max(F.when(F.col("_at") == rank, F.col("value"))).alias(name)
            for name, rank in ranks(F.col("_total")).items()
        ],
    )
    return _finish(found, keys)


def _pick_lists(df: DataFrame, columns: Sequence[str], by: Sequence[str]) -> DataFrame:
    """``_pick`` of groups that are small in all columns: sorted lists of their values, without expanded rows or windows."""
    lists = df.groupBy(*by).agg(*[F.sort_array(F.collect_list(column(c).cast("double"))).alias(f"_v{i}") for i, c in enumerate(columns)])
    cells = []
    for i, c in enumerate(columns):
        n = F.size(f"_v{i}").cast("long")
        cells.append(F.struct(F.lit(c).alias("measure"), n.alias("n"), *[
            F.get(f"_v{i}", rank.cast("int")).alias(name) for name, rank in ranks(n).items()]))
    return _finish(lists.select(*by, F.inline(F.array(*cells))).filter(F.col("n") > 0), [*by, "measure"])


def _finish(found: DataFrame, keys: Sequence[str]) -> DataFrame:
    return found.select(
        *keys, "n", "q1", ((F.col("middle_low") + F.col("middle_high")) / 2).alias("median"), "q3"
    )


def medians(
    df: DataFrame,
    columns: Sequence[str],
    by: Sequence[str] = (),
    *,
    rows: int | None = None,
    direct_cells: int = DIRECT_CELLS,
    group_rows: int = GROUP_ROWS,
) -> DataFrame:
    """(by..., measure, median), exact.

    Small inputs use the built-in exact median, whose state holds the distinct
    values of a group; larger ones take the way their group needs.
    """
    if rows is None:
        rows = df.count()
    if rows * len(columns) > direct_cells:
        return order_statistics(df, columns, by, rows=rows, direct_cells=direct_cells, group_rows=group_rows).select(*by, "measure", "median")
    middle = df.groupBy(*by).agg(*[
        F.median(column(c).cast("double")).alias(f"m{i}") for i, c in enumerate(columns)])
    return middle.select(*by, F.inline(F.array(*[
        F.struct(F.lit(c).alias("measure"), F.col(f"m{i}").alias("median")) for i, c in enumerate(columns)])))


def order_statistics(
    df: DataFrame,
    columns: Sequence[str],
    by: Sequence[str] = (),
    *,
    rows: int | None = None,
    direct_cells: int = DIRECT_CELLS,
    group_rows: int = GROUP_ROWS,
    fineness: int = FINENESS,
    rounds: Sequence[int] = ROUNDS,
    most: int | None = None,
) -> DataFrame:
    """(by..., measure, n, q1, median, q3), exact.

    ``rows`` saves counting the table when its size is known, ``most`` counting its
    groups when that of the largest is.  Groups may have null keys.
    """
    keys = [*by, "measure"]
    long = long_form(df, columns, by)
    if most is not None and most <= group_rows:
        return _pick_lists(df, columns, by)
    if rows is None:
        rows = df.count()
    if rows * len(columns) <= direct_cells:
        return _pick(long, keys)
    sizes = materialise(long.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")), "group-sizes")
    extent = sizes.agg(F.max("n").alias("most"), F.min("n").alias("least")).first()
    if extent["most"] is None or extent["most"] <= group_rows:
        return _pick(long, keys)
    if extent["least"] > group_rows:
        return _finish(select_ranks(long, keys, ranks, group_rows=group_rows, fineness=fineness, rounds=rounds), keys)
    large = sizes.filter(F.col("n") > group_rows).select(*keys, F.lit(True).alias("_large"))
    marked = null_safe(long, broadcast_if_small(large), keys, "left")
    found = select_ranks(marked.filter("_large").drop("_large"), keys, ranks, group_rows=group_rows, fineness=fineness, rounds=rounds)
    return _pick(marked.filter("_large is null").drop("_large"), keys).unionByName(_finish(found, keys))


def _coarse(value: Column, fineness: int) -> Column:
    """Bucket of a value: never smaller for a larger value, since logarithms are monotonic."""
    size = F.abs(value)
    part = F.floor(F.log2(size) * fineness) + 1100 * fineness
    part = F.when(size >= float("inf"), F.lit(3000 * fineness) + F.isnan(value).cast("int")).when(size == 0, F.lit(0)).otherwise(part).cast("long")
    return F.when(value < 0, -part).otherwise(part)


def select_ranks(
    long: DataFrame,
    keys: Sequence[str],
    targets: Callable[[Column], Mapping[str, Column]],
    *,
    group_rows: int = GROUP_ROWS,
    fineness: int = FINENESS,
    rounds: Sequence[int] = ROUNDS,
) -> DataFrame:
    """(keys..., n, one column per target): ``ranked_values`` with a column for each of a few targets."""
    names: list[str] = []

    def named(n: Column) -> Mapping[str, Column]:
        wanted = targets(n)
        names[:] = wanted
        return wanted

    found = ranked_values(long, keys, named, group_rows=group_rows, fineness=fineness, rounds=rounds)
    return found.groupBy(*keys).agg(
        F.max("n").alias("n"), *[F.max(F.when(F.col("target") == name, F.col("value"))).alias(name) for name in names])


def ranked_values(
    long: DataFrame,
    keys: Sequence[str],
    targets: Callable[[Column], Mapping[str, Column] | Column],
    *,
    group_rows: int = GROUP_ROWS,
    fineness: int = FINENESS,
    rounds: Sequence[int] = ROUNDS,
) -> DataFrame:
    """(keys..., n, target, rank, value): the values at the 0-based ranks that ``targets`` names for a group of n values.

    ``long`` has (keys..., value).  Round by round only the buckets that hold a rank are read on;
    a target whose rank is null is left out.  Many targets come as an array of (target, rank).
    """
    buckets = [_coarse(F.col("value"), fineness), *[F.shiftright(order_key(F.col("value")), left) for left in rounds]]
    settled: list[DataFrame] = []
    chosen: DataFrame | None = None
    path: list[str] = []  # the buckets of the rounds so far: one alone need not lie within that of the round before
    for number, bucket in enumerate(buckets):
        last = f"_b{number}"
        part = [*keys, *path]
        if chosen is None:
            counted = long.groupBy(*keys, bucket.alias(last))
        else:
            # only values in the buckets of the rounds before
            inside = null_safe(long.withColumns(dict(zip(path, buckets))), broadcast_if_small(chosen.select(*part, "_before", "n", "_ranks")), part)
            counted = inside.groupBy(*part, "_before", F.col("n").alias("_n"), "_ranks", bucket.alias(last))
        path.append(last)
        counted = counted.agg(F.count(F.lit(1)).alias("_size"), F.min("value").alias("_low"), F.max("value").alias("_high"))
        window = Window.partitionBy(*part)
        past = F.sum("_size").over(window.orderBy(last).rowsBetween(Window.unboundedPreceding, Window.currentRow))
        if chosen is None:
            counted = counted.withColumn("n", F.sum("_size").over(window)).withColumn("_past", past)
            ranked = targets(F.col("n"))
            if not isinstance(ranked, Column):
                ranked = F.array(*[F.struct(F.lit(name).alias("target"), rank.cast("long").alias("rank")) for name, rank in ranked.items()])
            counted = counted.withColumn("_ranks", ranked)
        else:
            counted = counted.withColumn("_past", past + F.col("_before")).withColumnRenamed("_n", "n").drop("_before")
        counted = counted.withColumn("_before", F.col("_past") - F.col("_size"))
        held = F.filter("_ranks", lambda t: (t["rank"] >= F.col("_before")) & (t["rank"] < F.col("_past")))
        chosen = materialise(counted.withColumn("_ranks", held).filter(F.size("_ranks") > 0).select(
            *keys, *path, "n", "_before", "_size", "_low", "_high", "_ranks"), "rank-buckets")
        one = F.col("_low") == F.col("_high")
        settled.append(chosen.filter(one).select(*keys, "n", F.inline("_ranks"), F.col("_low").alias("value")))
        small = chosen.filter(~one & (F.col("_size") <= group_rows))
        sizes = chosen.agg(F.count_if(~one & (F.col("_size") <= group_rows)).alias("small"), F.count_if(~one & (F.col("_size") > group_rows)).alias("large")).first()
        if sizes["small"]:
            found = null_safe(long.withColumns(dict(zip(path, buckets))), broadcast_if_small(small.select(
                *keys, *path, "n", "_before", "_ranks")), [*keys, *path])
            at = F.row_number().over(Window.partitionBy(*keys, *path).orderBy("value")) - 1 + F.col("_before")
            found = found.withColumn("_at", at).withColumn("_ranks", F.filter("_ranks", lambda t: t["rank"] == F.col("_at")))
            settled.append(found.filter(F.size("_ranks") > 0).select(*keys, "n", F.inline("_ranks"), "value"))
        if not sizes["large"]:
            break
        chosen = chosen.filter(~one & (F.col("_size") > group_rows))
    return reduce(DataFrame.unionByName, settled)
