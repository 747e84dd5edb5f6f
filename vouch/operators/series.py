"""Time series: ordered points, trend metrics, samples."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vouch.functions import fixed
from vouch.functions.numbers import canonical, clamp, divide, finite, percent_change
from vouch.functions.scores import trend_label
from vouch.operators.ordering import DIRECT_ROWS, positions, row_fingerprint, sample_positions
from vouch.operators.quantiles import null_safe
from vouch.session import GROUP_ROWS, broadcast_if_small, materialise, together
from vouch.sources.tables import column


def date_label(value: Column, data_type: T.DataType) -> Column:
    """ISO text of a date or timestamp; plain text of anything else."""
    if isinstance(data_type, T.DateType):
        return F.date_format(value, "yyyy-MM-dd")
    if isinstance(data_type, (T.TimestampType, T.TimestampNTZType)):
        whole = F.date_trunc("second", value) == value
        return F.when(whole, F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss")).otherwise(
            F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))
    if isinstance(data_type, (T.FloatType, T.DoubleType)):
        return value.cast("double").cast("string")
    return value.cast("string")


def series_points(
    df: DataFrame,
    measures: Sequence[str],
    date: str,
    order_by: Sequence[str] | None = None,
    by: Sequence[str] = (),
    *,
    unique: bool = False,
    direct_rows: int = DIRECT_ROWS,
) -> DataFrame:
    """(by..., measure, pos, date, value, copies, n, mean): points in date order, one sort for all measures.

    Equal rows are one point with their number as ``copies``, unless ``unique`` is given.

    Rows without date or finite value are left out per measure.  Rows of one date
    are ordered by ``order_by``, or by a fingerprint of the row when it is not
    given; ``unique`` says that date and ``order_by`` identify a row.
    """
    order = [column(date), *([column(c) for c in order_by] if order_by else [row_fingerprint(df)])]
    values = {f"_y{i}": finite(column(m)) for i, m in enumerate(measures)}
    marks = {str(i): (F.col(f"_y{i}").isNotNull(), F.col(f"_y{i}")) for i in range(len(measures))}
    present = df.filter(column(date).isNotNull())
    placed = positions(
        present, order, {"_date": column(date), **values}, marks, by, unique=unique, direct_rows=direct_rows)
    cells = [
        F.struct(
            F.lit(m).alias("measure"), F.col(f"pos_{i}").alias("pos"), F.col("_date").alias("date"),
            F.col(f"_y{i}").alias("value"), F.col("copies"), F.col(f"n_{i}").alias("n"),
            F.col(f"mean_{i}").alias("mean"),
        )
        for i, m in enumerate(measures)
    ]
    return placed.select(*by, F.inline(F.array(*cells))).filter(F.col("pos").isNotNull())


def sample_series(points: DataFrame, k: int = fixed.SERIES_POINTS) -> DataFrame:
    """Thin each series to ``k`` evenly spaced points, positions rounded half up."""
    return sample_positions(points, k, half_even=False)


def trend_metrics(points: DataFrame, date_name: str, by: Sequence[str] = ()) -> DataFrame:
    """Trend of each series of points over its positions 0..n-1, in one map-side combined aggregate.

    (by..., measure, date, status, sample_size, first/last/peak/trough date and
    value, changes, slope_per_observation, intercept, r_squared, trend_direction,
    trend_strength, moving_average_window, latest_moving_average)
    """
    n, value, copies, pos = F.col("n"), F.col("value"), F.col("copies"), F.col("pos")
    window = fixed.MOVING_AVERAGE_WINDOW
    # A block of copies covers pos .. pos+copies-1, so its middle stands for all of it.
    centred = pos + (copies - 1) / 2 - (n - 1) / 2
    shifted = value - F.col("mean")
    in_window = F.greatest(
        F.least(pos + copies, n) - F.greatest(pos, n - window), F.lit(0))
    before_last = (pos <= n - 2) & (pos + copies > n - 2)
    sums = points.groupBy(*by, "measure").agg(
        F.max(n).alias("sample_size"),
        F.max("mean").alias("_mean"),
        F.min(F.struct(pos, "date", value)).alias("_first"),
        F.max(F.struct(pos, "date", value)).alias("_last"),
        F.min(F.struct((-value).alias("_minus"), pos, "date")).alias("_peak"),
        F.min(F.struct(value, pos, "date")).alias("_trough"),
        F.max(F.when(before_last, value)).alias("_previous"),
        F.sum(value * in_window).alias("_recent"),
        F.sum(copies * centred * shifted).alias("_sxy"),
        F.sum(copies * shifted * shifted).alias("_syy"),
    )
    return _metrics(sums, date_name, points.schema["date"].dataType, by)


def series_moments(
    df: DataFrame,
    measures: Sequence[str],
    date: str,
    order_by: Sequence[str] | None = None,
    by: Sequence[str] = (),
    *,
    exact: bool = False,
    most: int | None = None,
    dealt: bool = False,
) -> DataFrame:
    """What the trend of each series needs to know, one row per series and part of one range sort.

    (by..., measure, part, n, low, zero, level, slope, spread, first/last date and value, peak,
    trough, recent values), with ``low`` the smallest row number of the series in the part.
    Rows of a series are neighbours in a part, so their positions are row numbers shifted by a
    constant that is known once the parts before are counted: nothing is numbered, written
    or shuffled a second time, and a part of any length is one row.  Where no run has more than
    GROUP_ROWS rows they are dealt by run instead of by range: a series is one part then.

    Rows are left out and ordered as in ``series_points``; rows equal in all sort columns are
    exchangeable and are dealt over the parts by the partition they come from.  Measures present
    in every row share a sort, the others share one of their present cells.

    A first pass finds the range of each series.  Values are taken relative to its lower
    end wherever a series lies far from zero for its range.  ``exact`` adds integer sums: values
    in 2^40ths of their range, summed as decimals, so neither the order of additions nor the
    distance from zero changes them.  ``most``, the size of the largest run where it is known,
    lets the first pass deal small runs too; ``dealt`` says that the table is written in buckets by run.
    """
    order = [column(date), *([column(c) for c in order_by] if order_by else [row_fingerprint(df)])]
    names = [f"_o{i}" for i in range(len(order))]
    values = {m: f"_y{i}" for i, m in enumerate(measures)}
    present = df.filter(column(date).isNotNull()).select(
        *by, *[c.alias(n) for c, n in zip(order, names)], column(date).alias("date"),
        *[finite(column(m)).alias(y) for m, y in values.items()])
    frames = present if most is None or dealt else together(present.select(*by, *values.values()), by, most)
    frames = frames.groupBy(*by).agg(F.count(F.lit(1)).alias("rows"), *[
        c for y in values.values() for c in (F.count(y).alias(f"n{y}"), F.min(y).alias(f"l{y}"), F.max(y).alias(f"h{y}"))])
    if by:
        frames = materialise(frames, "series-frames")
    far = [F.greatest(F.abs(f"l{y}"), F.abs(f"h{y}")) > _FAR * (F.col(f"h{y}") - F.col(f"l{y}")) for y in values.values()]
    known = frames.agg(
        F.sum("rows").alias("rows"), F.max("rows").alias("most"), F.max(reduce(Column.__or__, far)).alias("far"),
        *[c for y in values.values() for c in (F.sum(f"n{y}").alias(f"n{y}"), F.min(f"l{y}").alias(f"l{y}"), F.max(f"h{y}").alias(f"h{y}"))]).first()
    whole = [m for m, y in values.items() if known[f"n{y}"] == known["rows"]]
    gappy = [m for m in measures if m not in whole]
    framed = bool(by) and (exact or bool(known["far"]))
    near = bool(by) and known["most"] is not None and known["most"] <= GROUP_ROWS

    def ordered(rows: DataFrame, *order: str) -> DataFrame:
        """Sorted by ``by`` and ``order``: small series lie whole in one part, others are cut anywhere."""
        return rows.repartition(*by).sortWithinPartitions(*by, *order) if near else rows.orderBy(*by, *order)

    def cells(chosen: Sequence[str]) -> Column:
        return F.inline(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(values[m]).alias("value")) for m in chosen]))

    dealt = present.withColumn("_from", F.spark_partition_id())
    parts, folded = [], []
    if whole:
        # The date and measures that rows are ordered by travel once.
        carried = {values[m]: names[1 + list(order_by).index(m)] for m in whole if order_by and m in order_by}
        own = [values[m] for m in whole if values[m] not in carried]
        kept = dealt.select(*by, *names, *own, *([] if near else ["_from"]))
        if near and dealt:
            # Numbered by run, so that rows stay in their buckets.
            run = Window.partitionBy(*by)
            kept = kept.withColumn("_id", F.row_number().over(run.orderBy(*names, *own)).cast("long") - 1)
        else:
            kept = ordered(kept, *names, *own, *([] if near else ["_from"])).withColumn("_id", F.monotonically_increasing_id())
        kept = kept.withColumns({"date": F.col(names[0]), **{y: finite(F.col(name)) for y, name in carried.items()}})
        if near:
            ranges = [c for m in whole for c in (f"l{values[m]}", f"h{values[m]}")]
            rows = null_safe(kept, broadcast_if_small(frames.select(*by, *ranges)), by, "left") if framed else kept
            if dealt and not framed:
                rows = rows.withColumns({f"{end}{values[m]}": least_or_most(values[m]).over(run)
                                         for m in whole for end, least_or_most in (("l", F.min), ("h", F.max))})
            folded.append(_folded_whole(rows, by, {m: values[m] for m in whole}, framed, exact, dealt))
        else:
            parts.append(kept.select(*by, "date", "_id", cells(whole)))
    if gappy:
        kept = dealt.select(*by, *names, "date", "_from", cells(gappy)).filter(F.col("value").isNotNull())
        kept = ordered(kept, "measure", *names, "value", "_from").withColumn("_id", F.monotonically_increasing_id())
        parts.append(kept.select(*by, "date", "_id", "measure", "value"))
    for rows in parts:
        if framed:
            lists = [F.struct(F.lit(m).alias("measure"), F.col(f"l{y}").alias("zero"), F.col(f"h{y}").alias("top")) for m, y in values.items()]
            rows = null_safe(rows, broadcast_if_small(frames.select(*by, F.inline(F.array(*lists)))), [*by, "measure"], "left")
        else:
            zero, top = F.lit(0.0), F.lit(0.0)
            for m, y in values.items():  # one series per measure: its range is a literal
                if not by and known[f"l{y}"] is not None:
                    zero = F.when(F.col("measure") == m, F.lit(known[f"l{y}"])).otherwise(zero)
                    top = F.when(F.col("measure") == m, F.lit(known[f"h{y}"])).otherwise(top)
            rows = rows.withColumns({"zero": zero, "top": top})
        folded.append(_folded(rows, by, exact))
    return reduce(DataFrame.unionByName, folded)


_PART_BITS = 33  # layout of monotonically_increasing_id
_UNITS = 2.0 ** 40
# Distance from zero, in ranges, from which on values are taken relative to their range.
_FAR = 100


def _numbered(rows: DataFrame) -> DataFrame:
    return rows.withColumns({
        "part": F.shiftright("_id", _PART_BITS), "at": F.col("_id").bitwiseAND(F.lit((1 << _PART_BITS) - 1))})


def _sums(value: Column, zero: Column, top: Column, exact: bool, ends: tuple[Column, Column] | None = None) -> dict[str, Column]:
    """What one row of moments holds, as aggregates over the rows (date, at) of a series and part.

    With ``ends``, the smallest and largest value of the series and part in each of its rows, no
    aggregate compares records, so rows are folded by hash and not sorted.
    """
    at, up = F.col("at"), value - zero
    date, value = F.col("date"), value.alias("value")
    window = fixed.MOVING_AVERAGE_WINDOW
    sums = {
        "n": F.count(F.lit(1)), "low": F.min(at), "zero": F.max(zero), "top": F.max(top),
        "_base": F.regr_intercept(up, at), "slope": F.regr_slope(up, at), "spread": F.var_pop(up), "_least": F.min(up),
    }
    # row numbers of a series are neighbours, so the last few differ in their remainder
    if ends is None:
        sums |= {
            "first": F.min(F.struct(at, date, value)), "last": F.max(F.struct(at, date, value)),
            "peak": F.min(F.struct((-value).alias("minus"), at, date)), "trough": F.min(F.struct(value, at, date)),
            **{f"recent{k}": F.max(F.when(at % window == k, F.struct(at, value))) for k in range(window)}}
    else:
        at_least, at_most = (F.when(value == end, at) for end in ends)
        sums |= {
            "first": F.struct(F.min(at).alias("at"), F.min_by(date, at).alias("date"), F.min_by(value, at).alias("value")),
            "last": F.struct(F.max(at).alias("at"), F.max_by(date, at).alias("date"), F.max_by(value, at).alias("value")),
            "peak": F.struct((-F.max(value)).alias("minus"), F.min(at_most).alias("at"), F.min_by(date, at_most).alias("date")),
            "trough": F.struct(F.min(value).alias("value"), F.min(at_least).alias("at"), F.min_by(date, at_least).alias("date"))}
        for k in range(window):
            here = F.when(at % window == k, at)
            sums[f"recent{k}"] = F.when(F.max(here).isNotNull(), F.struct(F.max(here).alias("at"), F.max_by(value, here).alias("value")))
    if exact:
        scale = F.when(top > zero, F.lit(_UNITS) / (top - zero)).otherwise(F.lit(0.0))
        units = F.round(up * scale).cast("decimal(20,0)")
        sums |= {
            "units": F.sum(units.cast("decimal(38,0)")), "units_squared": F.sum((units * units).cast("decimal(38,0)")),
            "units_placed": F.sum((at.cast("decimal(12,0)") * units).cast("decimal(38,0)"))}
    return sums


def _levelled(folded: DataFrame) -> DataFrame:
    middle = F.col("low") + (F.col("n") - 1) / 2
    level = F.coalesce(F.col("_base") + F.col("slope") * middle, F.col("_least"))
    return folded.withColumn("level", level).withColumn("slope", F.coalesce("slope", F.lit(0.0))).drop("_base", "_least")


def _folded(rows: DataFrame, by: Sequence[str], exact: bool) -> DataFrame:
    """One row per series and part of the sorted ``rows`` (by..., measure, date, _id, value, zero, top)."""
    sums = _sums(F.col("value"), F.col("zero"), F.col("top"), exact)
    return _levelled(_numbered(rows).groupBy(*by, "measure", "part").agg(*[c.alias(name) for name, c in sums.items()]))


def _folded_whole(rows: DataFrame, by: Sequence[str], values: Mapping[str, str], framed: bool, exact: bool, ends: bool = False) -> DataFrame:
    """``_folded`` of series that lie whole in a part, with the measures side by side in (by..., date, _id, values...).

    Rows come in the order of ``by``, so they are folded as they come: neither expanded nor sorted again.
    ``framed`` rows carry the range of each series as l... and h...; ``ends`` says that others do too.
    """
    none = F.lit(0.0)
    sums = {m: _sums(F.col(y), *((F.col(f"l{y}"), F.col(f"h{y}")) if framed else (none, none)), exact, (F.col(f"l{y}"), F.col(f"h{y}")) if ends else None)
            for m, y in values.items()}
    folded = _numbered(rows).groupBy(*by).agg(F.max("part").alias("part"), *[
        c.alias(f"{name}_{i}") for i, found in enumerate(sums.values()) for name, c in found.items()])
    cells = [F.struct(F.lit(m).alias("measure"), *[F.col(f"{name}_{i}").alias(name) for name in found]) for i, (m, found) in enumerate(sums.items())]
    return _levelled(folded.select(*by, "part", F.inline(F.array(*cells))))


def trends(moments: DataFrame, date_name: str, by: Sequence[str] = (), *, exact: bool = False) -> DataFrame:
    """``trend_metrics`` from ``series_moments``: the moments of the parts are shifted to their places and combined.

    ``exact`` takes the integer sums instead of the running moments, the second formulation
    that verification uses.
    """
    keys = [*by, "measure"]
    series = Window.partitionBy(*keys)
    # A series has at most one row per sort partition.
    before = series.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    n = F.col("n")
    placed = moments.select(
        "*", F.coalesce(F.sum(n).over(before), F.lit(0)).alias("_start"), F.sum(n).over(series).alias("_n"),
        F.first("level").over(series.orderBy("part")).alias("_near"))
    placed = placed.withColumn("_shift", F.col("_start") - F.col("low"))
    placed = placed.withColumn("_mean", F.col("_near") + F.sum(n * (F.col("level") - F.col("_near"))).over(series) / F.col("_n"))
    total, shift, mean = F.col("_n"), F.col("_shift"), F.col("_mean")
    recent = F.filter(F.array(*[F.col(f"recent{k}") for k in range(fixed.MOVING_AVERAGE_WINDOW)]), lambda r: r.isNotNull())
    previous = F.filter(recent, lambda r: r["at"] + shift == total - 2)
    latest = F.filter(recent, lambda r: r["at"] + shift >= total - fixed.MOVING_AVERAGE_WINDOW)
    off_centre = F.col("_start") + (n - 1) / 2 - (total - 1) / 2
    off_mean = F.col("level") - mean
    within = (n.cast("double") * n - 1) / 12 * F.col("slope")
    sums = [
        F.max(total).alias("sample_size"), F.max(F.col("zero") + mean).alias("_mean"),
        F.min(F.struct((F.col("first.at") + shift).alias("pos"), F.col("first.date"), F.col("first.value"))).alias("_first"),
        F.max(F.struct((F.col("last.at") + shift).alias("pos"), F.col("last.date"), F.col("last.value"))).alias("_last"),
        F.min(F.struct(F.col("peak.minus").alias("_minus"), (F.col("peak.at") + shift).alias("pos"), F.col("peak.date"))).alias("_peak"),
        F.min(F.struct(F.col("trough.value"), (F.col("trough.at") + shift).alias("pos"), F.col("trough.date"))).alias("_trough"),
        F.max(F.get(previous, F.lit(0))["value"]).alias("_previous"),
        F.sum(F.aggregate(latest, F.lit(0.0), lambda total, r: total + r["value"])).alias("_recent"),
        F.sum(n * (within + off_centre * off_mean)).alias("_sxy"), F.sum(n * (F.col("spread") + off_mean * off_mean)).alias("_syy"),
    ]
    if exact:
        whole = "decimal(38,0)"
        sums += [
            F.sum("units").cast(whole).alias("_units"), F.sum("units_squared").cast(whole).alias("_squared"),
            F.sum((F.col("units_placed") + shift.cast("decimal(12,0)") * F.col("units")).cast(whole)).cast(whole).alias("_at_units"),
            F.max("zero").alias("_low"), F.max("top").alias("_high")]
    out = placed.groupBy(*keys).agg(*sums)
    if exact:
        # Around the mean in whole units, still exact; the rest of the mean is below one unit.
        out = out.selectExpr("*", "_units div sample_size as _m", "(_high - _low) / pow(2, 40) as _unit")
        out = out.withColumn("_rest", F.expr("cast(_units - cast(sample_size as decimal(20,0)) * _m as double)"))
        out = out.withColumns({
            "_syy": F.expr("(cast(_squared - 2 * cast(_m as decimal(20,0)) * _units + cast(sample_size as decimal(18,0)) * (cast(_m as decimal(18,0)) * _m) as double)"
                           " - _rest * _rest / sample_size) * _unit * _unit"),
            "_sxy": F.expr("(cast(_at_units - cast(_m as decimal(18,0)) * ((cast(sample_size as decimal(18,0)) * (sample_size - 1)) div 2) as double)"
                           " - _rest * ((sample_size - 1) / 2)) * _unit"),
            "_mean": F.expr("_low + cast(_units as double) / sample_size * _unit"),
        })
    return _metrics(out, date_name, moments.schema["first"].dataType["date"].dataType, by)


def _metrics(sums: DataFrame, date_name: str, date_type: T.DataType, by: Sequence[str]) -> DataFrame:
    window = fixed.MOVING_AVERAGE_WINDOW
    size = F.col("sample_size")
    sxx = size * (size.cast("double") * size - 1) / 12
    enough = size >= fixed.MIN_TREND_POINTS
    # In canonical digits, so that the order of additions cannot tip a class or a rounded figure.
    sums = sums.withColumn("_explained", clamp(divide(F.col("_sxy") * F.col("_sxy"), sxx * F.col("_syy"))))
    explained = canonical("_explained")
    # A slope whose share of the variation is below rounding noise is no slope.
    slope = F.when(explained > 1e-24, divide(F.col("_sxy"), sxx)).otherwise(F.lit(0.0))
    base = sums.select(
        *by, "measure", F.lit(date_name).alias("date"),
        F.when(enough, F.lit("completed")).otherwise(F.lit("insufficient_data")).alias("status"),
        F.when(~enough, F.lit(fixed.REASONS["short_series"])).alias("reason"),
        "sample_size", "_previous", "_mean",
        date_label(F.col("_first.date"), date_type).alias("first_date"),
        F.col("_first.value").alias("first_value"),
        date_label(F.col("_last.date"), date_type).alias("last_date"),
        F.col("_last.value").alias("last_value"),
        date_label(F.col("_peak.date"), date_type).alias("peak_date"),
        (-F.col("_peak._minus")).alias("peak_value"),
        date_label(F.col("_trough.date"), date_type).alias("trough_date"),
        F.col("_trough.value").alias("trough_value"),
        (F.col("_recent") / window).alias("latest_moving_average"),
        slope.alias("slope_per_observation"),
        F.when(F.col("_trough.value") == -F.col("_peak._minus"), F.lit(1.0))
        .otherwise(explained).alias("r_squared"),
    )
    change = F.col("last_value") - F.col("first_value")
    latest = F.col("last_value") - F.col("_previous")
    scale = F.greatest(F.abs("peak_value"), F.abs("trough_value"), F.lit(1.0))
    flat = F.abs(change) <= scale * 0.01
    detailed = base.select(
        "*",
        change.alias("absolute_change"),
        percent_change(change, F.col("first_value")).alias("percentage_change"),
        latest.alias("latest_period_change"),
        percent_change(latest, F.col("_previous")).alias("latest_period_percentage_change"),
        F.when(flat, F.lit("flat")).when(F.col("slope_per_observation") > 0, F.lit("rising"))
        .otherwise(F.lit("falling")).alias("trend_direction"),
        F.when(flat, F.lit("stable")).otherwise(trend_label(F.col("r_squared"))).alias("trend_strength"),
        (F.col("_mean") - F.col("slope_per_observation") * (F.col("sample_size") - 1) / 2).alias("intercept"),
        F.lit(window).alias("moving_average_window"),
    )
    identity = [*by, "measure", "date", "status", "reason", "sample_size"]
    metrics = [
        "first_date", "first_value", "last_date", "last_value", "absolute_change", "percentage_change",
        "latest_period_change", "latest_period_percentage_change", "trend_direction", "trend_strength",
        "slope_per_observation", "intercept", "r_squared", "peak_date", "peak_value", "trough_date",
        "trough_value", "moving_average_window", "latest_moving_average",
    ]
    # A series too short for a trend reports its size only.
    done = F.col("status") == "completed"
    return detailed.select(*identity, *[F.when(done, F.col(m)).alias(m) for m in metrics])


def moving_average(points: DataFrame, by: Sequence[str] = (), window: int = fixed.MOVING_AVERAGE_WINDOW) -> DataFrame:
    """Latest moving average of each series: mean of its last ``window`` values."""
    n, pos, copies = F.col("n"), F.col("pos"), F.col("copies")
    covered = F.greatest(F.least(pos + copies, n) - F.greatest(pos, n - window), F.lit(0))
    return (
        points.filter((n >= window) & (covered > 0))
        .groupBy(*by, "measure")
        .agg((F.sum(F.col("value") * covered) / window).alias("latest_moving_average"))
    )
