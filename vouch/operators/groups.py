"""Group comparison: statistics per group and one-way analysis of variance."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vouch.functions import fixed
from vouch.functions.numbers import canonical, divide
from vouch.functions.special import with_f_tail
from vouch.operators import quantiles
from vouch.operators.quantiles import DIRECT_CELLS, GROUP_ROWS, null_safe
from vouch.session import broadcast_if_small, materialise
from vouch.sources.tables import column


def by_dimension(
    df: DataFrame, measures: Sequence[str], dimensions: Sequence[str], by: Sequence[str] = ()
) -> DataFrame:
    """(by..., measures..., dimension, key): one row per row and dimension, a single scan for all of them."""
    cells = [
        F.struct(F.lit(d).alias("dimension"), column(d).cast("string").alias("key")) for d in dimensions
    ]
    return df.select(*by, *[column(m) for m in measures], F.inline(F.array(*cells)))


def group_statistics(
    df: DataFrame,
    measures: Sequence[str],
    dimensions: Sequence[str],
    by: Sequence[str] = (),
    *,
    rows: int | None = None,
    medians: bool = True,
    direct_cells: int = DIRECT_CELLS,
    group_rows: int = GROUP_ROWS,
) -> DataFrame:
    """(by..., measure, dimension, key, count, mean, median, min, max, variance).

    Every measure by every dimension.  Groups are pre-aggregated before the
    shuffle, so a dominant key costs one row per task.  A null key is a group.
    The analysis of variance needs no ``medians``; without them the median is null.
    """
    long = by_dimension(df, measures, dimensions, by)
    keys = [*by, "dimension", "key"]
    totals = long.groupBy(*keys).agg(*[
        expression
        for i, name in enumerate(measures)
        for value in [column(name).cast("double")]
        for expression in (
            F.count(value).alias(f"n{i}"), F.avg(value).alias(f"a{i}"), F.min(value).alias(f"l{i}"),
            F.max(value).alias(f"h{i}"), F.var_samp(value).alias(f"v{i}"),
        )
    ])
    cells = [
        F.struct(
            F.lit(name).alias("measure"), F.col(f"n{i}").alias("count"), F.col(f"a{i}").alias("mean"),
            F.col(f"l{i}").alias("min"), F.col(f"h{i}").alias("max"), F.col(f"v{i}").alias("variance"),
        )
        for i, name in enumerate(measures)
    ]
    basics = totals.select(*keys, F.inline(F.array(*cells)))
    shape = [*by, "measure", "dimension", "key", "count", "mean", "median", "min", "max", "variance"]
    if not medians:
        return basics.withColumn("median", F.lit(None).cast("double")).select(*shape)
    cells_rows = None if rows is None else rows * len(dimensions)
    if cells_rows is None:
        cells_rows = df.count() * len(dimensions)
    middle = quantiles.medians(long, measures, keys, rows=cells_rows, direct_cells=direct_cells, group_rows=group_rows)
    return null_safe(basics, middle, [*keys, "measure"], "left").select(*shape)


def recounted(df: DataFrame, groups: DataFrame, measures: Sequence[str], dimensions: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """The statistics of ``groups`` from the rows again, for verification: sums of distances from the means that ``groups`` claims.

    Any distance serves as well as the mean, only with fewer digits, so a wrong table is found out
    and not believed: groups that it lacks, or whose mean or variance it has wrong, come out
    right.  The median is null.
    """
    keys = [*by, "dimension", "key"]
    claimed = groups.groupBy(*keys).agg(*[F.max(F.when(F.col("measure") == m, F.col("mean"))).alias(f"_m{i}") for i, m in enumerate(measures)])
    rows = by_dimension(df, measures, dimensions, by)
    rows = null_safe(rows, broadcast_if_small(materialise(claimed, "claimed-means")), keys, "left")
    rows = rows.select(*keys, *[c for i, m in enumerate(measures) for value in [column(m).cast("double")]
                                for c in (value.alias(f"_x{i}"), (value - F.coalesce(f"_m{i}", F.lit(0.0))).alias(f"_d{i}"), F.col(f"_m{i}"))])
    totals = rows.groupBy(*keys).agg(*[c for i in range(len(measures)) for c in (
        F.count(f"_x{i}").alias(f"n{i}"), F.sum(f"_d{i}").alias(f"s{i}"), F.sum(F.col(f"_d{i}") * F.col(f"_d{i}")).alias(f"q{i}"),
        F.coalesce(F.max(f"_m{i}"), F.lit(0.0)).alias(f"c{i}"), F.min(f"_x{i}").alias(f"l{i}"), F.max(f"_x{i}").alias(f"h{i}"))])
    cells = [
        F.struct(
            F.lit(m).alias("measure"), F.col(f"n{i}").alias("count"), (F.col(f"c{i}") + divide(F.col(f"s{i}"), F.col(f"n{i}"))).alias("mean"),
            F.lit(None).cast("double").alias("median"), F.col(f"l{i}").alias("min"), F.col(f"h{i}").alias("max"),
            F.greatest(divide(F.col(f"q{i}") - divide(F.col(f"s{i}") * F.col(f"s{i}"), F.col(f"n{i}")), F.col(f"n{i}") - 1), F.lit(0.0)).alias("variance"))
        for i, m in enumerate(measures)
    ]
    return totals.select(*keys, F.inline(F.array(*cells))).select(
        *by, "measure", "dimension", "key", "count", "mean", "median", "min", "max", F.when(F.col("count") > 1, F.col("variance")).alias("variance"))


def counterexamples(claims: DataFrame, groups: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by..., measure, dimension, key, mean, claim): groups above a claimed highest or below a claimed lowest mean.

    ``claims`` has highest_value and lowest_value per comparison.  A claim holds if it has no
    counterexample; means are compared in canonical digits.
    """
    found = null_safe(groups.filter(F.col("mean").isNotNull()), claims.select(*by, "measure", "dimension", "highest_value", "lowest_value"),
                      [*by, "measure", "dimension"])
    mean = canonical("mean")
    claim = F.when(mean > canonical("highest_value"), F.lit("highest")).when(mean < canonical("lowest_value"), F.lit("lowest"))
    return found.withColumn("claim", claim).filter(F.col("claim").isNotNull()).select(*by, "measure", "dimension", "key", "mean", "claim")


def anova(groups: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One-way ANOVA of every (measure, dimension) from the statistics of its groups.

    (by..., measure, dimension, groups, group_count, sample_size,
    minimum_group_size, smallest_count, test, status, statistic, p_value,
    p_value_underflow, reason).  A group with a null key counts as size 0.
    """
    keys = [*by, "measure", "dimension"]
    size = F.when(F.col("key").isNull(), F.lit(0)).otherwise(F.col("count"))
    sized = groups.withColumn("_size", size)
    usable = F.col("_size") >= 2
    centre = sized.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("groups"),
        F.count(F.when(usable, 1)).alias("group_count"),
        F.sum(F.when(usable, F.col("_size")).otherwise(F.lit(0))).alias("sample_size"),
        F.min("_size").alias("minimum_group_size"),
        F.min("count").alias("smallest_count"),
        (F.sum(F.when(usable, F.col("_size") * F.col("mean")))
         / F.sum(F.when(usable, F.col("_size")))).alias("_grand"),
    )
    # Second aggregate over the group table only, around the grand mean.
    spread = null_safe(sized.filter(usable), centre.select(*keys, "_grand"), keys).groupBy(*keys).agg(
        F.sum(F.col("_size") * (F.col("mean") - F.col("_grand")) * (F.col("mean") - F.col("_grand"))).alias("_ssb"),
        F.sum((F.col("_size") - 1) * F.col("variance")).alias("_ssw"),
        (F.min("mean") < F.max("mean")).alias("_differ"),
    )
    joined = null_safe(centre, spread, keys, "left")
    enough = F.col("minimum_group_size") >= fixed.MIN_GROUP_SIZE
    tested = enough & (F.col("group_count") >= 2)
    d1 = (F.col("group_count") - 1).cast("double")
    d2 = (F.col("sample_size") - F.col("group_count")).cast("double")
    statistic = F.when(tested, F.when(F.col("_ssw") > 0, (F.col("_ssb") / d1) / (F.col("_ssw") / d2)).when(
        F.col("_differ"), F.lit(float("inf"))))
    with_f = joined.select("*", statistic.alias("statistic"), d1.alias("_d1"), d2.alias("_d2"))
    result = with_f_tail(with_f, "p_value", "statistic", "_d1", "_d2")
    status = F.when(~enough, F.lit("insufficient_data")).when(tested, F.lit("completed")).otherwise(F.lit("no_test"))
    return result.select(
        *keys, "groups", "group_count", "sample_size", "minimum_group_size", "smallest_count",
        F.when(F.col("groups") >= 1, F.when(~enough | tested, F.lit("one_way_anova"))).alias("test"),
        status.alias("status"), "statistic", "p_value",
        F.when(F.col("p_value").isNotNull(), F.col("p_value") == 0).alias("p_value_underflow"),
        F.when(~enough, F.lit(fixed.REASONS["small_group"])).alias("reason"),
    )


def extremes(groups: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by..., measure, dimension, highest/lowest group and value); groups without values are ignored.

    Means are compared in canonical digits, so that equal means tie (and the
    first key wins) whatever order their values were added up in.
    """
    present = groups.filter(F.col("mean").isNotNull()).withColumn("_m", canonical("mean"))
    return present.groupBy(*by, "measure", "dimension").agg(
        F.min(F.struct((-F.col("_m")).alias("m"), "key", "mean")).alias("_high"),
        F.min(F.struct(F.col("_m").alias("m"), "key", "mean")).alias("_low"),
    ).select(
        *by, "measure", "dimension",
        F.col("_high.key").alias("highest_group"), F.col("_high.mean").alias("highest_value"),
        F.col("_low.key").alias("lowest_group"), F.col("_low.mean").alias("lowest_value"),
    )


def bar_groups(groups: DataFrame, by: Sequence[str] = (), limit: int = fixed.BAR_GROUPS) -> DataFrame:
    """Chart rows: all groups by mean descending, or the top and bottom half of ``limit``.

    (by..., measure, dimension, bar, label, mean, count, median, min, max,
    total_groups, displayed_groups, sampled)
    """
    keys = [*by, "measure", "dimension"]
    top, bottom = limit // 2, limit - limit // 2
    present = groups.filter(F.col("mean").isNotNull()).withColumn("_m", canonical("mean"))
    totals = present.groupBy(*keys).agg(F.count(F.lit(1)).alias("total_groups"))
    part = Window.partitionBy(*keys)
    # Both rankings keep at most ``limit`` rows per task before their shuffle.
    best = present.withColumn("_r", F.row_number().over(part.orderBy(F.desc("_m"), "key"))).filter(
        F.col("_r") <= limit)
    worst = present.withColumn("_r", F.row_number().over(part.orderBy("_m", F.desc("key")))).filter(
        F.col("_r") <= bottom)
    best = null_safe(best, totals, keys).filter((F.col("total_groups") <= limit) | (F.col("_r") <= top))
    worst = null_safe(worst, totals, keys).filter(F.col("total_groups") > limit).withColumn(
        "_r", F.lit(limit + 1) - F.col("_r"))
    return best.unionByName(worst).select(
        *keys, F.col("_r").alias("bar"), F.coalesce("key", F.lit("Missing")).alias("label"),
        "mean", "count", "median", "min", "max", "total_groups",
        F.least(F.col("total_groups"), F.lit(limit)).cast("long").alias("displayed_groups"),
        (F.col("total_groups") > limit).alias("sampled"),
    )
