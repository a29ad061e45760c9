"""CSV rows whose quoted fields may hold line breaks, read by many tasks a file.

A line taken alone cannot tell whether it begins inside a quoted field, but it can tell how it would end in either
case. Such answers compose: those of the lines give a block's, those of the blocks the state in which each block
begins, and so each line's. Lines that a break parts are put together again; all others stay rows as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

from ..operators.shared import stored

#: Within a line: outside quotes, in a quoted field, after a quote there that ends it or escapes the next, at the line's start.
OUTSIDE, INSIDE, AFTER_QUOTE, AT_START = range(4)


def ends_inside(line: Column, sep: str, start: int) -> Column:
    """Whether a line that begins in a state ends inside a quoted field.

    A quote opens a field only where the field begins, anywhere else outside it is a character.
    """

    def step(state: Column, before: Column) -> Column:
        opens = F.endswith(before, F.lit(sep)) | ((state == AT_START) & (before == ""))
        after = F.when((state == AFTER_QUOTE) & (before == ""), INSIDE).when(opens, INSIDE).otherwise(OUTSIDE)
        return F.when(state == INSIDE, AFTER_QUOTE).otherwise(after)

    pieces = F.split(line, '"')
    state = F.aggregate(F.slice(pieces, F.lit(1), F.size(pieces) - 1), F.lit(start), step)
    return F.when(F.contains(line, F.lit('"')), state == INSIDE).otherwise(F.lit(start == INSIDE))


def with_states(rows: DataFrame, span: WindowSpec) -> DataFrame:
    """rows, each with from_out and from_in (whether it ends inside, begun outside or inside), with after_out and after_in: the same
    for all of its span up to it. Rows that end alike either way fix the state, ones that exchange it are counted since."""
    flip = F.col("from_out") & ~F.col("from_in")
    fixed = F.when(F.col("from_out") == F.col("from_in"), F.col("from_out") != (F.col("flips_") % 2 == 1))
    rows = rows.withColumn("flips_", F.sum(flip.cast("int")).over(span)).withColumn("fixed_", F.last(fixed, ignorenulls=True).over(span))
    odd = F.col("flips_") % 2 == 1
    after = lambda start: F.coalesce("fixed_", F.lit(start)) != odd
    return rows.withColumns({"after_out": after(False), "after_in": after(True)}).drop("flips_", "fixed_")


def lines(spark: SparkSession, path: str, sep: str) -> DataFrame:
    """file, block (the byte where the split begins), at (the line's order in it), line, and how the line ends either way."""
    rows = spark.read.text(path, lineSep="\n").select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("line"))
    return rows.withColumns({"from_out": ends_inside(F.col("line"), sep, AT_START), "from_in": ends_inside(F.col("line"), sep, INSIDE)})


def counted(rows: DataFrame) -> DataFrame:
    """Lines with before_out and before_in, whether they begin inside for a block begun outside or inside, and at which row of the block."""
    order = Window.partitionBy("file", "block").orderBy("at")
    rows = with_states(rows, order.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumns({"before_out": F.lag("after_out", 1, False).over(order), "before_in": F.lag("after_in", 1, True).over(order)})
    begins = lambda c: F.sum((~F.col(c) & (F.rtrim(F.translate("line", "\r", " ")) != "")).cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumns({"rows_out": begins("before_out"), "rows_in": begins("before_in")})


def blocks(rows: DataFrame) -> DataFrame:
    """file, block, inside (the state in which it begins), rows_before (rows that begin in earlier blocks and files).

    There is a row for each split of a file, so the sum over all of them is one task's.
    """
    whole = rows.groupBy("file", "block").agg(F.max_by("after_out", "at").alias("from_out"), F.max_by("after_in", "at").alias("from_in"), F.max("rows_out").alias("n_out"), F.max("rows_in").alias("n_in"))
    order = Window.partitionBy("file").orderBy("block")
    whole = with_states(whole, order.rowsBetween(Window.unboundedPreceding, 0)).withColumn("inside", F.lag("after_out", 1, False).over(order))
    n = F.when(F.col("inside"), F.col("n_in")).otherwise(F.col("n_out"))
    return whole.select("file", "block", "inside", (F.sum(n).over(Window.orderBy("file", "block")) - n).alias("rows_before"))


def records(spark: SparkSession, path: str, sep: str) -> DataFrame:
    """file, number (the row's place over all files, from 0), record: the text of a row. Blank lines between rows are none.

    Only lines of rows that a break parts are gathered; a quote that is never closed makes the rest of its file one row.
    """
    marked = counted(lines(spark, path, sep))
    either = lambda name: F.when(F.col("inside"), F.col(f"{name}_in")).otherwise(F.col(f"{name}_out"))
    placed = marked.join(blocks(marked), ["file", "block"]).select("file", "block", "at", "line", either("before").alias("begun"), either("after").alias("open"), (F.col("rows_before") + either("rows") - 1).alias("number"))
    # Conditions on a row's fields may be asked before its place is known; a part of a row must not be parsed for them.
    alone = placed.where("not begun and not open").select("file", "number", F.when(~F.col("begun") & ~F.col("open"), F.col("line")).alias("record"))
    parts = placed.where("begun or open").groupBy("file", "number").agg(F.sort_array(F.collect_list(F.struct("block", "at", "line"))).alias("parts_"))
    joined = parts.select("file", "number", F.array_join(F.col("parts_.line"), "\n").alias("record"))
    rows = alone.where(F.rtrim(F.translate("record", "\r", " ")) != "").unionByName(joined)
    return rows.withColumn("record", F.regexp_replace("record", "\r$", ""))


def read(spark: SparkSession, path: str, sep: str) -> DataFrame:
    """The columns of the first file's header as strings, empty where missing, and row_idx in the order of files and rows, from 0. An empty file has none.

    Rows are parsed once and written to the shared folder, however often they are read later.

    Rows end in a line feed, or in one after a carriage return. Every file begins with a header. A row of another number of fields is an error.
    """
    names = spark.read.csv(path, sep=sep, header=True, multiLine=True, quote='"', escape='"').columns
    if not names:
        return spark.createDataFrame([], "row_idx long")
    rows = records(spark, path, sep)
    first = rows.groupBy("file").agg(F.min("number").alias("head_"))
    first = first.withColumn("heads_", F.row_number().over(Window.orderBy("head_")))
    body = rows.join(first, "file").where("number > head_")
    schema = ", ".join(f"c{i} string" for i in range(len(names)))
    options = {"sep": sep, "quote": '"', "escape": '"', "mode": "FAILFAST", "multiLine": "true", "maxCharsPerColumn": "-1"}
    parsed = body.select(F.from_csv(F.when(F.col("number") > F.col("head_"), F.col("record")), schema, options).alias("f_"), (F.col("number") - F.col("heads_")).alias("row_idx"))
    held = stored(parsed.select("row_idx", *(F.coalesce(F.col(f"f_.c{i}"), F.lit("")).alias(f"c{i}") for i in range(len(names)))))
    return held.select(*(F.col(f"c{i}").alias(name) for i, name in enumerate(names)), "row_idx")
