"""Triage of a folder of uploaded files, one verdict row per file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vouch.functions import fixed
from vouch.sources.csv_records import line_effects

# --- fixed values: leading bytes per extension ---------------------------------
MAGIC = {"xlsx": "504B0304", "xls": "D0CF11E0A1B11AE1"}
EXTENSIONS = ["csv", "xlsx", "xls"]
# --------------------------------------------------------------------------------
_HEAD_ROWS = 11  # header and ten rows


def unsafe_name(name: Column) -> Column:
    """Problem with a file name, or null."""
    return (
        F.when(name.isNull() | (name == "") | name.contains("\x00"), F.lit("A valid filename is required."))
        .when(name.contains("/") | name.contains("\\") | name.isin(".", ".."), F.lit("Unsafe filename."))
        .when(F.length(name) > fixed.MAX_FILE_NAME, F.lit("Filename is too long."))
    )


def _cells(record: Column) -> Column:
    """Number of comma-separated cells, commas inside quotes not counted."""
    bare = F.regexp_replace(F.replace(record, F.lit('""'), F.lit("")), '(^|,)"[^"]*"', "$1")
    return F.length(bare) - F.length(F.replace(bare, F.lit(","), F.lit(""))) + 1


def _first_records(text: Column) -> Column:
    """(records, width, wide, open) of the first records of CSV text, folded over its lines.

    ``open`` holds the lines of a record that is not at its end, ``width`` is that of the header,
    ``wide`` tells of a record with more cells.  Once enough records are seen the state stays.
    """
    none = F.lit(None).cast("string")
    start = F.struct(F.lit(0).alias("records"), F.lit(None).cast("int").alias("width"), F.lit(False).alias("wide"), none.alias("open"))

    def read(state: Column, line: Column) -> Column:
        if_out, if_in = line_effects(line)
        begun = state["open"].isNotNull()
        record = F.when(begun, F.concat(state["open"], F.lit("\n"), line)).otherwise(line)
        cells = _cells(record)
        unfinished = F.when(begun, if_in).otherwise(if_out)

        def after(records: Column, width: Column, wide: Column, rest: Column) -> Column:
            return F.struct(records.alias("records"), width.alias("width"), wide.alias("wide"), rest.alias("open"))

        return (
            F.when(state["records"] >= _HEAD_ROWS, state)
            .when(unfinished, after(state["records"], state["width"], state["wide"], record))
            .when(F.trim(record) == "", after(state["records"], state["width"], state["wide"], none))
            .otherwise(after(state["records"] + 1, F.coalesce(state["width"], cells), state["wide"] | F.coalesce(cells > state["width"], F.lit(False)), none)))

    return F.aggregate(F.split(text, "\r?\n"), start, read)


# Bytes in which the first records mostly end; if they do not, all of the content is read.
_NEAR = 1 << 16


def csv_problem(content: Column) -> Column:
    """Problem with CSV bytes, or null: NUL among the first 8 bytes, nothing to read, rows wider than the header, a quote left open."""
    head = F.hex(F.substring(content, 1, 8))
    near = _first_records(F.regexp_replace(F.substring(content, 1, _NEAR).cast("string"), r"[^\n]*\z", ""))
    whole = _first_records(content.cast("string"))
    found = F.when((F.octet_length(content) > _NEAR) & (near["records"] >= _HEAD_ROWS), near).otherwise(whole)
    wrong = head.rlike("^(?:..)*00") | (found["records"] == 0) | found["wide"] | (found["open"].isNotNull() & (found["records"] < _HEAD_ROWS))
    return F.when(wrong, F.lit("The file content does not match its extension."))


def triage(spark: SparkSession, folder: str) -> DataFrame:
    """(path, name, length, accepted, reason) for every file below ``folder``.

    Contents are read only for files of an allowed type and size: both filters
    reach the file scan.  Spark's scans pass over empty files, so these come from the list of
    files, which Spark keeps on the driver anyway.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    plain = F.url_decode(F.replace(F.replace("uri", F.lit(":///"), F.lit(":/")), F.lit("+"), F.lit("%2B")))
    every = spark.createDataFrame([(p,) for p in files.inputFiles()], "uri string").select(plain.alias("path"))
    scanned = files.select("path", "length")
    empty = every.join(scanned, "path", "left_anti").withColumn("length", F.lit(0).cast("long"))

    def described(df: DataFrame) -> DataFrame:
        name = F.element_at(F.split(F.col("path"), "/"), -1)
        return df.withColumn("name", name).withColumn(
            "extension", F.lower(F.regexp_extract("name", r"\.([^.]+)$", 1)))

    reason = (
        F.when(unsafe_name(F.col("name")).isNotNull(), unsafe_name(F.col("name")))
        .when(~F.col("extension").isin(EXTENSIONS), F.lit("Only CSV and Excel files are supported."))
        .when(F.col("length") > fixed.MAX_UPLOAD_BYTES, F.lit("Upload exceeds the 25 MB size limit."))
    )
    listed = described(scanned.unionByName(empty)).withColumn("_reason", reason)
    head = F.hex(F.substring("content", 1, 8))
    content_problem = F.when(F.col("extension") == "csv", csv_problem(F.col("content")))
    for extension, magic in MAGIC.items():
        content_problem = content_problem.when(
            (F.col("extension") == extension) & ~head.startswith(magic),
            F.lit(f"The file content is not a valid {extension.upper()} workbook."))
    contents = files.filter(F.col("length") <= fixed.MAX_UPLOAD_BYTES).select("path", "content").unionByName(
        empty.select("path", F.lit(b"").alias("content")))
    read = described(contents).filter(F.col("extension").isin(EXTENSIONS))
    judged = read.select("path", content_problem.alias("_content"))
    return listed.join(judged, "path", "left").select(
        "path", "name", "length",
        F.coalesce("_reason", "_content").isNull().alias("accepted"),
        F.coalesce("_reason", "_content").alias("reason"),
    )
