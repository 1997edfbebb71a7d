"""Text files as DataFrames."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_lines(spark: SparkSession, path: str, ordered: bool = False, keep_blank: bool = False) -> DataFrame:
    """Lines of text files.

    ``ordered=False``: one row per line, read in parallel splits (order does
    not matter, e.g. a corpus).  ``ordered=True``: (file, line_no, line) with
    the 0-based position of each line in its file, also read in splits: lines
    are counted in each block, and a prefix sum of the counts (one row a
    block) numbers them.  Blank lines are dropped unless ``keep_blank``, which
    also keeps the empty piece after a final newline (for that, files are read
    whole).  An empty file has no lines.
    """
    if not ordered:
        df = spark.read.text(path).select(F.col("value").alias("line"))
        return df if keep_blank else df.filter(F.trim(F.col("line")) != "")
    read = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("id"), "value")
    # a block's lines are consecutive rows of one task, so their ids are too
    blocks = read.groupBy("file", "block").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(F.col("file").alias("_f"), F.col("block").alias("_b"), "first",
                           F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    met = read.join(blocks, (F.col("file") == F.col("_f")) & (F.col("block") == F.col("_b")))
    df = met.select("file", (F.col("before") + F.col("id") - F.col("first")).alias("line_no"),
                    F.regexp_replace("value", "\r$", "").alias("line"))
    if not keep_blank:
        return df.filter(F.trim(F.col("line")) != "")
    # the last piece: one more line where a file ends in a newline, found from its last byte
    ends = spark.read.format("binaryFile").load(path).select(
        F.col("_metadata.file_path").alias("file"), (F.substring("content", -1, 1) == F.unhex(F.lit("0A"))).alias("ended"))
    n = df.groupBy("file").agg(F.count(F.lit(1)).alias("n"))
    last = ends.where("ended").join(n, "file", "left").select(
        "file", F.coalesce("n", F.lit(0)).cast("long").alias("line_no"), F.lit("").alias("line"))
    return df.unionByName(last)


def append_text(df: DataFrame, path: str, col: str | None = None, run: str | None = None) -> None:
    """Append one string column as text files (the reference appends to a file).

    Each run writes a folder of its own, which a repeated run of the same
    name replaces, so a job that is tried again leaves one copy.  Without a
    name each call is a run.
    """
    c = col or df.columns[0]
    df.select(F.col(c).cast("string")).write.mode("overwrite").text(f"{path.rstrip('/')}/run={run or uuid.uuid4().hex}")
