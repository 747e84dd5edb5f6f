"""Exact row positions in a global order, and samples taken at fixed positions.

A global ``row_number`` would sort the whole table in one task.  Here, once a
group is too large for a window of its own, the rows are range-partitioned and sorted by Spark's own sort, numbered inside each
partition while they are written to the shared folder, and shifted by the
number of rows in the partitions before.  The written table keeps partition
numbers and contents in agreement for every later use.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vouch.functions import fixed
from vouch.operators.quantiles import null_safe, ranked_values
from vouch.session import broadcast_if_small, materialise
from vouch.sources.tables import column

# Rows of the largest group up to which one window per group is used.
DIRECT_ROWS = 200_000
_BUCKET_BITS = 33  # layout of monotonically_increasing_id


def row_fingerprint(df: DataFrame) -> Column:
    """64-bit hash of the whole row: an order that does not depend on the file layout."""
    return F.xxhash64(*[column(c) for c in df.columns])


def positions(
    df: DataFrame,
    order: Sequence[Column],
    keep: Mapping[str, Column],
    marks: Mapping[str, tuple[Column, Column | None]],
    by: Sequence[str] = (),
    *,
    unique: bool = False,
    direct_rows: int = DIRECT_ROWS,
) -> DataFrame:
    """Position of every row among the rows that satisfy each mark.

    ``order``   sort columns; ties are broken by the kept columns, and rows equal
                in all of these are exchangeable.
    ``keep``    columns of the result.
    ``marks``   name -> (condition, value or None) over the kept columns.  Rows
                are counted separately per condition.
    ``by``      groups; positions start at 0 in each.
    ``unique``  promise that ``order`` identifies a row.  Otherwise equal rows are
                first folded into one with a number of ``copies``, at every size, so
                that a row repeated many times stays one row.

    Returns by..., keep..., copies and for each mark: ``pos_<mark>`` (position of
    the first copy, null where the condition fails), ``n_<mark>`` (rows in the
    group) and ``mean_<mark>`` (mean of the mark's value over the group).

    When no group has more than ``direct_rows`` rows a window per group does it; the
    rows are the same either way.
    """
    sort_names = [f"_o{i}" for i in range(len(order))]
    narrow = df.select(
        *by, *[c.alias(n) for c, n in zip(order, sort_names)], *[c.alias(n) for n, c in keep.items()])
    largest = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    if unique:
        folded = narrow.withColumn("copies", F.lit(1).cast("long"))
    else:
        folded = narrow.groupBy(*narrow.columns).agg(F.count(F.lit(1)).alias("copies"))
    if largest <= direct_rows:
        return _placed_by_window(folded, [*sort_names, *keep], keep, marks, by)
    return _placed_by_sort(folded, sort_names, keep, marks, by)


def _counted(mark: tuple[Column, Column | None]) -> Column:
    """Copies of the row that count for the mark."""
    return F.when(mark[0], F.col("copies")).otherwise(F.lit(0))


def _weighted(mark: tuple[Column, Column | None]) -> Column:
    """Sum of the mark's value over the copies of the row."""
    if mark[1] is None:
        return F.lit(None).cast("double")
    return F.when(mark[0], F.col("copies") * mark[1].cast("double"))


def _finish(out: DataFrame, keep: Mapping[str, Column], marks: Mapping, by: Sequence[str]) -> DataFrame:
    return out.select(*by, *keep, "copies", *[
        c
        for m in marks
        for c in (
            (F.col(f"_at_{m}") - F.col(f"_first_{m}")).alias(f"pos_{m}"),
            F.col(f"n_{m}"),
            F.when(F.col(f"n_{m}") > 0, F.col(f"_s_{m}") / F.col(f"n_{m}")).alias(f"mean_{m}"),
        )
    ])


def _placed_by_window(
    narrow: DataFrame, order: Sequence[str], keep: Mapping[str, Column], marks: Mapping, by: Sequence[str]
) -> DataFrame:
    group = Window.partitionBy(*[F.col(c) for c in by])
    before = group.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = narrow.select("*", *[
        c
        for m, mark in marks.items()
        for c in (
            F.when(mark[0], F.coalesce(F.sum(_counted(mark)).over(before), F.lit(0))).alias(f"_at_{m}"),
            F.lit(0).alias(f"_first_{m}"),
            F.sum(_counted(mark)).over(group).alias(f"n_{m}"),
            F.sum(_weighted(mark)).over(group).alias(f"_s_{m}"),
        )
    ])
    return _finish(placed, keep, marks, by)


def _placed_by_sort(
    narrow: DataFrame, sort_names: Sequence[str], keep: Mapping[str, Column], marks: Mapping, by: Sequence[str]
) -> DataFrame:
    numbered = narrow.orderBy(*by, *sort_names, *keep).withColumn("_id", F.monotonically_increasing_id())
    table = materialise(numbered.drop(*sort_names), "ordered").withColumn(
        "_bucket", F.shiftright("_id", _BUCKET_BITS))
    totals = table.groupBy("_bucket").agg(
        *[F.sum(_counted(mark)).alias(f"_n_{m}") for m, mark in marks.items()],
        *[F.sum(_weighted(mark)).alias(f"_s_{m}") for m, mark in marks.items()],
    )
    # One row per sort partition: this window and broadcast stay at the size of
    # the shuffle partition count.
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_bucket", *[
        F.coalesce(F.sum(f"_n_{m}").over(before), F.lit(0)).alias(f"_off_{m}") for m in marks
    ])
    inside = Window.partitionBy("_bucket").orderBy("_id").rowsBetween(Window.unboundedPreceding, -1)
    placed = table.join(F.broadcast(offsets), "_bucket")
    placed = placed.select("*", *[
        F.when(
            mark[0], F.col(f"_off_{m}") + F.coalesce(F.sum(_counted(mark)).over(inside), F.lit(0)),
        ).alias(f"_at_{m}")
        for m, mark in marks.items()
    ])
    if by:
        firsts = placed.groupBy(*by).agg(
            *[F.min(f"_at_{m}").alias(f"_first_{m}") for m in marks],
            *[F.sum(_counted(mark)).alias(f"n_{m}") for m, mark in marks.items()],
            *[F.sum(_weighted(mark)).alias(f"_s_{m}") for m, mark in marks.items()],
        )
        out = null_safe(placed, broadcast_if_small(materialise(firsts, "group-starts")), by)
    else:
        whole = totals.agg(
            *[F.lit(0).alias(f"_first_{m}") for m in marks],
            *[F.sum(f"_n_{m}").alias(f"n_{m}") for m in marks],
            *[F.sum(f"_s_{m}").alias(f"_s_{m}") for m in marks],
        )
        out = placed.crossJoin(F.broadcast(whole))  # one row
    return _finish(out, keep, marks, by)


def sample_positions(
    placed: DataFrame, k: int, *, half_even: bool, position: str = "pos", total: str = "n"
) -> DataFrame:
    """Keep ``k`` evenly spaced positions of each group (all when it has at most ``k``).

    Adds ``sample_index``.  Sample i sits at i(n-1)/(k-1), rounded half to even or
    half up.  Each row finds its own sample numbers, so nothing is joined.
    """
    pos, n, copies = F.col(position), F.col(total), F.col("copies")

    def at(i: Column) -> Column:
        exact = i * (n - 1) / (k - 1)
        return F.rint(exact) if half_even else F.floor(exact + 0.5)

    def nearest(p: Column) -> Column:
        return F.rint(p * (k - 1) / (n - 1))

    whole = n <= k
    single = (copies == 1) & (at(nearest(pos)) == pos)
    last = pos + copies - 1
    low = F.when(whole, pos).otherwise(F.greatest(nearest(pos) - 1, F.lit(0)))
    high = F.when(whole, last).otherwise(F.least(nearest(last) + 1, F.lit(k - 1)))
    candidates = F.sequence(low.cast("int"), F.greatest(low, high).cast("int"))
    hits = F.filter(candidates, lambda i: whole | ((at(i) >= pos) & (at(i) <= last)))
    return placed.filter(whole | (copies > 1) | single).withColumn("sample_index", F.explode(hits))


def scatter_sample(
    df: DataFrame,
    pairs: Sequence[tuple[str, str]],
    order_by: Sequence[str] | None = None,
    by: Sequence[str] = (),
    *,
    unique: bool = False,
    k: int = fixed.SCATTER_POINTS,
    direct_rows: int = DIRECT_ROWS,
) -> DataFrame:
    """(by..., first, second, sample_index, x, y, total_points, displayed_points, sampled).

    Rows where both columns are present, in ``order_by`` order (row fingerprint
    by default), thinned to ``k`` points.  All pairs share one sort.  Beyond ``direct_rows``
    rows, one number or time that identifies a row needs no sort: only the ``k`` ranks are searched.
    """
    if unique and order_by and len(order_by) == 1 and _is_scale(df, order_by[0]):
        extent = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.max(F.abs(_scale(df, order_by[0]))).alias("top")).agg(F.max("n").alias("n"), F.max("top").alias("top")).first()
        if (extent["n"] or 0) > direct_rows and (extent["top"] or 0.0) < 2.0 ** 53:
            return _sampled_by_rank(df, pairs, order_by[0], by, k)
    order = [column(c) for c in order_by] if order_by else [row_fingerprint(df)]
    used = list(dict.fromkeys(c for pair in pairs for c in pair))
    at = {c: f"_c{i}" for i, c in enumerate(used)}
    marks = {
        str(i): (F.col(at[a]).isNotNull() & F.col(at[b]).isNotNull(), None) for i, (a, b) in enumerate(pairs)
    }
    placed = positions(
        df, order, {at[c]: column(c).cast("double") for c in used}, marks, by,
        unique=unique, direct_rows=direct_rows)
    cells = [
        F.struct(
            F.lit(a).alias("first"), F.lit(b).alias("second"), F.col(at[a]).alias("x"),
            F.col(at[b]).alias("y"), F.col(f"pos_{i}").alias("pos"), F.col(f"n_{i}").alias("n"),
        )
        for i, (a, b) in enumerate(pairs)
    ]
    long = placed.select(*by, "copies", F.inline(F.array(*cells))).filter(F.col("pos").isNotNull())
    return sample_positions(long, k, half_even=True).select(
        *by, "first", "second", "sample_index", "x", "y",
        F.col("n").alias("total_points"), F.least(F.col("n"), F.lit(k)).alias("displayed_points"),
        (F.col("n") > k).alias("sampled"),
    )


def _is_scale(df: DataFrame, name: str) -> bool:
    """Whether a column is a number or a time, which as a double keeps its order and, below 2**53, tells all values apart."""
    kind = next(f.dataType for f in df.schema.fields if f.name == name)
    return isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DateType, T.TimestampType))


def _scale(df: DataFrame, name: str) -> Column:
    kind = next(f.dataType for f in df.schema.fields if f.name == name)
    if isinstance(kind, T.DateType):
        return F.unix_date(column(name)).cast("double")
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(column(name)).cast("double")
    return column(name).cast("double")


def _sampled_by_rank(df: DataFrame, pairs: Sequence[tuple[str, str]], key: str, by: Sequence[str], k: int) -> DataFrame:
    """``scatter_sample`` by searching the ranks of the sample among the keys of each pair's rows."""
    cells = F.inline(F.array(*[
        F.struct(
            F.lit(i).alias("_pair"), F.when(column(a).isNotNull() & column(b).isNotNull(), _scale(df, key)).alias("value"),
            column(a).cast("double").alias("x"), column(b).cast("double").alias("y"))
        for i, (a, b) in enumerate(pairs)]))
    long = df.select(*by, cells).filter(F.col("value").isNotNull())
    keys = [*by, "_pair"]

    def wanted(n: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.struct(
            i.alias("target"), F.when(n > k, F.rint(i * (n - 1) / (k - 1))).when(i < n, i).cast("long").alias("rank")))

    found = materialise(ranked_values(long.select(*keys, "value"), keys, wanted), "sample-ranks")
    names = F.array(*[F.struct(F.lit(a).alias("first"), F.lit(b).alias("second")) for a, b in pairs])
    rows = null_safe(long, broadcast_if_small(found), [*keys, "value"]).withColumn("_names", F.element_at(names, F.col("_pair") + 1))
    return rows.select(
        *by, F.col("_names.first").alias("first"), F.col("_names.second").alias("second"), F.col("target").alias("sample_index"), "x", "y",
        F.col("n").alias("total_points"), F.least(F.col("n"), F.lit(k)).alias("displayed_points"), (F.col("n") > k).alias("sampled"))
