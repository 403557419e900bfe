"""Dates: mismatches, renaming by date, and their counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..functions.numbering import running_sum, with_block
from ..params import DEFAULTS
from ..storage import written

#: Fixed value: a file name that is a date already.
DATE_NAMED = r"^\d{8}_\d{6}(_\d+)?$"


def is_date_named(name: Column) -> Column:
    return X.stem(name).rlike(DATE_NAMED)


def date_mismatches(media: DataFrame, tolerance_s: float = DEFAULTS.date_tolerance_s) -> DataFrame:
    """Files whose time of change isn't the capture date of their tag or, without one, of their name (seconds)."""
    exif, name = X.exif_seconds(F.col("date_raw"), F.col("date_epoch")), X.name_seconds(F.col("filename"))
    rows = media.select("file_id", "path", (F.unix_micros(F.col("mtime").cast("timestamp")) / 1e6).alias("mtime_s"), F.coalesce(exif, name).alias("target_s"), F.when(exif.isNotNull(), "exif").otherwise("filename").alias("source"))
    return rows.where(F.abs(F.col("mtime_s") - F.col("target_s")) > tolerance_s)


def rename_plan(media: DataFrame) -> DataFrame:
    """New names by capture date; all files of a folder with the same date get a number, by file_id.

    Files of one folder and date, such as a camera's default, are numbered in blocks, and their count is that of the blocks.
    """
    rows = media.where(~is_date_named(F.col("filename"))).withColumn("_base", X.date_name(F.col("date_raw"))).where("_base is not null")
    rows = rows.select("file_id", "path", "filename", "directory", "_base")
    rows = written(with_block(rows, "file_id"), "dated")
    many = written(rows.groupBy("directory", "_base").agg(F.count("*").alias("_n")).where("_n > 1"), "dates")
    alone = rows.join(many, ["directory", "_base"], "left_anti").withColumn("_k", F.lit(None).cast("bigint"))
    more = running_sum(rows.join(many, ["directory", "_base"], "left_semi"), ["directory", "_base"], "_block", [F.col("file_id")], F.lit(1), "_k")
    rows = alone.unionByName(more.select(*alone.columns))
    new = F.concat("_base", F.when(F.col("_k").isNotNull(), F.concat(F.lit("_"), "_k")).otherwise(""), X.extension(F.col("filename")))
    return rows.select("file_id", "path", F.col("filename").alias("old_name"), new.alias("new_name"), F.concat("directory", F.lit("/"), new).alias("new_path"))


def rename_stats(media: DataFrame) -> DataFrame:
    """Renameable files, and those counted as named already: all others that have a date text."""
    can = ~is_date_named(F.col("filename")) & X.date_name(F.col("date_raw")).isNotNull()
    return media.agg(F.count_if(can).alias("renameable"), (F.count("*") - F.count_if(can) - F.count_if(F.col("date_raw").isNull())).alias("already_named"))


def date_stats(media: DataFrame, tolerance_s: float = DEFAULTS.date_tolerance_s) -> DataFrame:
    """How many files there are and how many of them have a mismatch, in one pass."""
    target = F.coalesce(X.exif_seconds(F.col("date_raw"), F.col("date_epoch")), X.name_seconds(F.col("filename")))
    wrong = F.abs(F.unix_micros(F.col("mtime").cast("timestamp")) / 1e6 - target) > tolerance_s
    return media.agg(F.count_if(wrong).alias("mismatches"), F.count("*").alias("total_checked"))
