"""CSV records that span lines, read by all tasks.

A line either starts a record or lies inside a quoted value, which only the lines before it can
tell.  So each line is read as a function from the state before it to the state after it; there are
two states, hence four functions, and they compose: lines within their block of a file, then
blocks within their file.  Once every block knows its state, records are put together in parallel.
"""

from __future__ import annotations

import csv

from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

from vouch.session import broadcast_if_small, materialise


def _ends_inside(line: Column) -> Column:
    """Whether a line without doubled quotes that begins at the start of a field ends inside quotes.

    Quotes count at the start of a field only; ``5" pipe`` holds a plain one.
    """
    return F.regexp_replace(line, '(^|,)"[^"]*"', "$1x").rlike(r'(^|,)"[^"]*\z')


def line_effects(value: Column) -> tuple[Column, Column]:
    """(inside after the line if it starts outside, ... if it starts inside a quoted value)."""
    bare = F.replace(value, F.lit('""'), F.lit(""))
    closing = F.instr(bare, '"')
    rest = F.concat(F.lit("x"), F.substr(bare, closing + 1))
    return _ends_inside(bare), F.when(closing == 0, F.lit(True)).otherwise(_ends_inside(rest))


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, at, value): lines with the file block they come from and their order in it."""
    lines = spark.read.option("lineSep", "\n").text(path)
    return lines.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"), "value")


def has_line_breaks(spark: SparkSession, path: str) -> bool:
    """Whether a value holds a line break.  If no line ends inside quotes on its own, none starts inside."""
    value = F.col("value")
    return not spark.read.option("lineSep", "\n").text(path).filter(
        value.contains('"') & _ends_inside(F.replace(value, F.lit('""'), F.lit("")))).isEmpty()


def _states(df: DataFrame, window: WindowSpec, if_out: str, if_in: str) -> DataFrame:
    """Add before_out and before_in: the state before each row if the window starts outside or inside.

    A row either sets the state, keeps it or swaps it: the last setting row and the swaps since decide.
    """
    before = window.rowsBetween(Window.unboundedPreceding, -1)
    swaps = F.col(if_out) & ~F.col(if_in)
    df = df.withColumn("_swaps", F.coalesce(F.sum(swaps.cast("long")).over(before), F.lit(0)))
    setting = F.when(F.col(if_out) == F.col(if_in), F.struct(F.col(if_out).alias("state"), F.col("_swaps").alias("swaps")))
    df = df.withColumn("_set", F.last(setting, ignorenulls=True).over(before))
    known = F.col("_set.state") != ((F.col("_swaps") - F.col("_set.swaps")) % 2 == 1)
    odd = F.col("_swaps") % 2 == 1
    return df.withColumns({
        "before_out": F.when(F.col("_set").isNull(), odd).otherwise(known),
        "before_in": F.when(F.col("_set").isNull(), ~odd).otherwise(known),
    }).drop("_swaps", "_set")


def _after(before: str) -> Column:
    return F.when(F.col(before), F.col("if_in")).otherwise(F.col("if_out"))


def records(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, number, record): whole records; a file's header is number 1 of block 0.

    A record that spans lines is put together by one task, all others stay where they are.  A file
    that ends inside quotes is an error.
    """
    if_out, if_in = line_effects(F.col("value"))
    lines = text_lines(spark, path).withColumns({"if_out": if_out, "if_in": if_in})
    # A block is what one task scans, so its window is no larger than a scan.
    inside = Window.partitionBy("file", "block").orderBy("at")
    lines = _states(lines, inside, "if_out", "if_in")
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    lines = lines.select("*", *[
        F.sum((~F.col(b)).cast("long")).over(upto).alias(n) for b, n in (("before_out", "number_out"), ("before_in", "number_in"))])
    lines = materialise(lines, "csv-lines", "zstd")

    blocks = lines.groupBy("file", "block").agg(
        F.max_by(_after("before_out"), "at").alias("if_out"), F.max_by(_after("before_in"), "at").alias("if_in"),
        F.max("number_out").alias("number_out"), F.max("number_in").alias("number_in"))
    # One row per block of a file from here on.
    order = Window.partitionBy("file").orderBy("block")
    blocks = _states(blocks, order, "if_out", "if_in").withColumn("starts_inside", F.col("before_out"))
    number = F.when(F.col("starts_inside"), F.col("number_in")).otherwise(F.col("number_out"))
    carried = F.last(F.when(number > 0, F.struct("block", number.alias("number"))), ignorenulls=True)
    blocks = blocks.withColumn("open", carried.over(order.rowsBetween(Window.unboundedPreceding, -1))).withColumn("ends_inside", F.when(
        F.col("starts_inside"), F.col("if_in")).otherwise(F.col("if_out"))).withColumn("last", F.lead("block").over(order).isNull())
    blocks = materialise(blocks.select("file", "block", "starts_inside", "open", "ends_inside", "last"), "csv-blocks")
    unclosed = blocks.filter(F.col("last") & F.col("ends_inside")).select("file").first()
    if unclosed:
        raise ValueError(f"A quoted value is never closed in {unclosed['file']}")

    placed = lines.join(broadcast_if_small(blocks.select("file", "block", "starts_inside", "open")), ["file", "block"])
    own = F.when(F.col("starts_inside"), F.col("number_in")).otherwise(F.col("number_out"))
    placed = placed.select(
        "file", "at", "value", F.when(F.col("starts_inside"), F.col("before_in")).otherwise(F.col("before_out")).alias("inside"), "if_out", "if_in",
        F.when(own > 0, F.col("block")).otherwise(F.col("open.block")).alias("block"), F.when(own > 0, own).otherwise(F.col("open.number")).alias("number"),
        F.col("block").alias("place"))
    whole = ~F.col("inside") & ~F.col("if_out")
    single = placed.filter(whole).select("file", "block", "number", F.col("value").alias("record"))
    parts = F.array_sort(F.collect_list(F.struct("place", "at", "value")))
    spanning = placed.filter(~whole).groupBy("file", "block", "number").agg(
        F.array_join(F.transform(parts, lambda p: p["value"]), "\n").alias("record"))
    return single.unionByName(spanning).withColumn("record", F.regexp_replace("record", r"\r\z", ""))


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """The columns of a CSV with header as text, like Spark's reader but without a task per file."""
    found = materialise(records(spark, path), "csv-records", "zstd")
    heading = (F.col("block") == 0) & (F.col("number") == 1)
    first = found.filter(heading).orderBy("file").select("record").first()
    names = next(csv.reader([first["record"].removeprefix("﻿")], strict=False)) if first else []
    shape = ", ".join("`" + (n or f"_c{i}").replace("`", "``") + "` string" for i, n in enumerate(names))
    rows = found.filter(~heading & (F.trim("record") != ""))
    return rows.select(F.from_csv("record", shape, {"quote": '"', "escape": '"'}).alias("r")).select("r.*")
