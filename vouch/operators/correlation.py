"""Pearson correlation of many column pairs in one aggregate."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vouch.functions import fixed
from vouch.functions.special import with_pearson_p
from vouch.operators.quantiles import null_safe
from vouch.session import materialise
from vouch.sources.tables import column


def pair_rows(df: DataFrame, pairs: Sequence[tuple[str, str]], by: Sequence[str] = ()) -> DataFrame:
    """(by..., first, second, x, y): one row per row and pair in which both columns are present."""
    cells = [
        F.struct(
            F.lit(i).alias("_pair"), column(a).cast("double").alias("x"), column(b).cast("double").alias("y"))
        for i, (a, b) in enumerate(pairs)
    ]
    return df.select(*by, F.inline(F.array(*cells))).filter(F.col("x").isNotNull() & F.col("y").isNotNull())


def _moments(df: DataFrame, pairs: Sequence[tuple[str, str]], by: Sequence[str]) -> DataFrame:
    """Incrementally updated moments of every pair, (by..., first, second, ...), pairs without rows included.

    Rows are expanded per pair instead of widening the aggregate: eight aggregates
    compile well, hundreds do not.  The expanded rows are folded map-side.
    """
    sums = [
        F.count("x").alias("sample_size"), F.var_pop("x").alias("_vx"), F.var_pop("y").alias("_vy"),
        F.covar_pop("x", "y").alias("_cxy"),
        ((F.min("x") < F.max("x")) & (F.min("y") < F.max("y"))).alias("_varies"),
    ]
    names = F.array(*[F.struct(
        F.lit(i).alias("_pair"), F.lit(a).alias("first"), F.lit(b).alias("second"),
    ) for i, (a, b) in enumerate(pairs)])
    if by:
        # Every row is a row of every pair, with both values or neither: no group is lost, and
        # none has to be put back by a join.
        both = [column(a).isNotNull() & column(b).isNotNull() for a, b in pairs]
        cells = [F.struct(
            F.lit(i).alias("_pair"), F.when(there, column(a).cast("double")).alias("x"), F.when(there, column(b).cast("double")).alias("y"))
            for i, ((a, b), there) in enumerate(zip(pairs, both))]
        totals = df.select(*by, F.inline(F.array(*cells))).groupBy(*by, "_pair").agg(*sums)
        pair = F.element_at(names, F.col("_pair") + 1)
        return totals.withColumns({"first": pair["first"], "second": pair["second"]}).drop("_pair")
    totals = pair_rows(df, pairs).groupBy("_pair").agg(*sums)
    every = df.sparkSession.range(1).select(F.inline(names))
    return null_safe(every, totals, ["_pair"], "left").drop("_pair").withColumn(
        "sample_size", F.coalesce("sample_size", F.lit(0)))


# Pairs from which on their moments are entries of matrix products instead of expanded rows.
WIDE = 64
# Share of a sum of squares below which a variance may be no more than rounding.
_DOUBTFUL = 1e-12
_SUMS = ("n", "x", "y", "xx", "yy", "xy")


def _matrix_moments(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """``_moments`` of many pairs of one table: a batch of rows is one matrix, with a mask of its missing cells.

    Products of matrix and mask hold the sums of all pairs over the rows where both are
    present, so a row costs a multiplication and not an expanded row per pair.  Columns are taken
    relative to their means; pairs whose variance comes out near nothing are computed the other way.
    """
    import numpy as np
    import pyarrow as pa

    names = list(dict.fromkeys(c for pair in pairs for c in pair))
    place = {c: i for i, c in enumerate(names)}
    first, second = (np.array([place[pair[k]] for pair in pairs]) for k in (0, 1))
    numbers = df.select(*[column(c).cast("double").alias(f"c{i}") for i, c in enumerate(names)])
    means = numbers.agg(*[F.avg(F.nanvl(c, F.lit(None).cast("double"))).alias(c) for c in numbers.columns]).first()
    centre = np.array([means[c] or 0.0 for c in numbers.columns])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(_SUMS), len(pairs)))
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.stack([c.to_numpy(zero_copy_only=False).astype(np.float64) for c in batch.columns], axis=1) - centre
            there = ~np.isnan(x)
            x[~there] = 0.0
            mask = there.astype(np.float64)
            sums, squares = x.T @ mask, (x * x).T @ mask
            for k, (matrix, i, j) in enumerate(((mask.T @ mask, first, second), (sums, first, second), (sums, second, first),
                                                (squares, first, second), (squares, second, first), (x.T @ x, first, second))):
                total[k] += matrix[i, j]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(pairs), dtype=np.int32)), *map(pa.array, total)], ["_pair", *_SUMS])

    made = numbers.mapInArrow(work, "_pair int, " + ", ".join(f"{c} double" for c in _SUMS))
    made = made.groupBy("_pair").agg(*[F.sum(c).alias(c) for c in _SUMS])
    n = F.col("n")

    def spread(square: str, one: str, two: str) -> Column:
        return F.try_divide(square, n) - F.try_divide(one, n) * F.try_divide(two, n)

    made = made.select("_pair", n.cast("long").alias("sample_size"), spread("xx", "x", "x").alias("_vx"), spread("yy", "y", "y").alias("_vy"),
                       spread("xy", "x", "y").alias("_cxy"), F.try_divide("xx", n).alias("_sx"), F.try_divide("yy", n).alias("_sy"))
    made = materialise(made, "pair-moments")
    doubtful = (F.col("sample_size") >= 2) & ((F.col("_vx") <= F.col("_sx") * _DOUBTFUL) | (F.col("_vy") <= F.col("_sy") * _DOUBTFUL))
    again = [pairs[r["_pair"]] for r in made.filter(doubtful).select("_pair").collect()]  # pairs of columns of one table
    listed = df.sparkSession.createDataFrame([(i, *pair) for i, pair in enumerate(pairs)], "_pair int, first string, second string")
    sound = listed.join(made.filter(~F.coalesce(doubtful, F.lit(False))), "_pair").select(
        "first", "second", "sample_size", "_vx", "_vy", "_cxy", F.lit(True).alias("_varies"))
    return sound.unionByName(_moments(df, again, ())) if again else sound


def correlations(df: DataFrame, pairs: Sequence[tuple[str, str]], by: Sequence[str] = ()) -> DataFrame:
    """(by..., first, second, correlation, p_value, sample_size, status, reason).

    Each pair uses the rows where both columns are present.
    """
    moments = _matrix_moments(df, pairs) if not by and len(pairs) >= WIDE else _moments(df, pairs, by)
    size = F.col("sample_size")
    scale = F.sqrt("_vx") * F.sqrt("_vy")
    usable = (size >= 2) & F.col("_varies") & (scale > 0)
    r = F.when(usable, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("_cxy") / scale)))
    tested = with_pearson_p(moments.withColumn("correlation", r), "p_value", "correlation", "sample_size")
    status = (
        F.when(size < 2, F.lit("insufficient_data"))
        .when(~usable, F.lit("insufficient_variation"))
        .otherwise(F.lit("completed"))
    )
    reason = F.when(size < 2, F.lit(fixed.REASONS["few_pairs"])).when(
        ~usable, F.lit(fixed.REASONS["no_variation"]))
    return tested.select(
        *by, "first", "second", "correlation", "p_value", "sample_size",
        status.alias("status"), reason.alias("reason"),
    )


def recomputed(df: DataFrame, pairs: Sequence[tuple[str, str]], by: Sequence[str] = ()) -> DataFrame:
    """``correlations`` from the regression of y on x, a second formulation for verification."""
    names = F.array(*[F.struct(F.lit(a).alias("first"), F.lit(b).alias("second")) for a, b in pairs])
    sums = pair_rows(df, pairs, by).groupBy(*by, "_pair").agg(
        F.count(F.lit(1)).alias("sample_size"), F.regr_r2("y", "x").alias("_r2"), F.regr_slope("y", "x").alias("_slope"),
        ((F.min("x") < F.max("x")) & (F.min("y") < F.max("y"))).alias("_varies"),
    )
    r = F.when(F.col("_varies") & (F.col("sample_size") >= 2), F.signum("_slope") * F.sqrt(F.least("_r2", F.lit(1.0))))
    tested = with_pearson_p(sums.withColumn("correlation", r), "p_value", "correlation", "sample_size")
    pair = F.element_at(names, F.col("_pair") + 1)
    return tested.select(
        *by, pair["first"].alias("first"), pair["second"].alias("second"), "correlation", "p_value", "sample_size",
        F.when(F.col("correlation").isNull(), F.lit("insufficient_variation")).otherwise(F.lit("completed")).alias("status"),
        F.lit(None).cast("string").alias("reason"))


def complete_pairs(df: DataFrame, pairs: Sequence[tuple[str, str]], by: Sequence[str] = ()) -> DataFrame:
    """(by..., first, second, total_points): rows in which both columns are present."""
    totals = df.groupBy(*by).agg(*[
        F.count(F.when(column(a).isNotNull() & column(b).isNotNull(), 1)).alias(f"n{i}")
        for i, (a, b) in enumerate(pairs)
    ])
    return totals.select(*by, F.inline(F.array(*[
        F.struct(F.lit(a).alias("first"), F.lit(b).alias("second"), F.col(f"n{i}").alias("total_points"))
        for i, (a, b) in enumerate(pairs)
    ])))


