"""Reading metadata dumps, listings and operation logs; writing catalogs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import versions
from ..functions import exprs as X
from ..operators.geo import merge_cache
from ..plans.ledger import SESSION_SCHEMA
from ..storage import exists, written
from .jsonarray import json_records
from .walk import walk

#: Tags of a metadata dump, all read as texts.
TAGS = "SourceFile FileName FileSize DateTimeOriginal CreateDate FileModifyDate GPSLatitude GPSLongitude Orientation ImageWidth ImageHeight CompressorID VideoCodecID CompressorName Duration Directory MIMEType".split()


def read_exif_json(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """Raw metadata rows of JSON dumps (arrays of objects), each read by as many tasks as Spark splits it into.

    A dump that isn't sound gives no rows at all, like an empty one; with `strict` off its sound records are kept.  Records
    without a SourceFile are left out.
    """
    schema = ", ".join(f"{t} string" for t in TAGS)
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    rows = json_records(spark, path).withColumn("_r", F.when(F.col("kind") == "record", F.from_json("value", f"{schema}, _corrupt string", options)))
    rows = written(rows.select("file", ((F.col("kind") == "broken") | F.col("_r._corrupt").isNotNull()).alias("_bad"), "_r.*"), "metadata")
    if strict:
        rows = rows.join(rows.where("_bad").select("file").distinct(), "file", "left_anti")
    return rows.where("not _bad and SourceFile is not null").select(*TAGS)


def listed(walked: DataFrame, extensions: tuple[str, ...]) -> DataFrame:
    """Files of a `walk` with one of the extensions: path, filename, extension, size, mtime, directory.

    Files whose own name begins with a dot are left out; case of extensions doesn't matter.
    """
    name, wanted = X.basename(F.col("path")), tuple(e.lower() if e.startswith(".") else f".{e.lower()}" for e in extensions)
    rows = walked.where("kind = 'file'").select("path", name.alias("filename"), X.extension(name).alias("extension"), "size", "mtime", X.parent(F.col("path")).alias("directory"))
    return rows.where(F.col("extension").isin(*wanted) & ~F.col("filename").startswith("."))


def scan_files(spark: SparkSession, base: str, extensions: tuple[str, ...]) -> DataFrame:
    """Files below a folder with one of the extensions; executors list, nothing is read.  See `walk` and `listed`."""
    return listed(walk(spark, base), extensions)


def read_operation_log(spark: SparkSession, path: str) -> DataFrame:
    """Sessions of a JSON log; a missing or broken log is an empty one."""
    if not exists(spark, path):
        return spark.createDataFrame([], SESSION_SCHEMA)
    rows = spark.read.schema(SESSION_SCHEMA + ", _corrupt string").option("multiLine", True).option("columnNameOfCorruptRecord", "_corrupt").json(path)
    return rows.where("_corrupt is null and session_id is not null").drop("_corrupt")


def write_operation_log(sessions: DataFrame, path: str) -> None:
    sessions.write.mode("overwrite").json(path)


CACHE_SCHEMA = "geo_key string, label string"


def load_cache(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """A version of a geocode cache, the newest unless one is named; empty if there is none."""
    return versions.read(spark, path, CACHE_SCHEMA, version)


def save_cache(cache: DataFrame, path: str) -> int:
    """Writes a new version beside the old ones, which readers may still use; returns its number."""
    return versions.replace(lambda _: cache.select("geo_key", "label"), path, CACHE_SCHEMA, cache.sparkSession)


def update_cache(found: DataFrame, path: str) -> int:
    """A new version with keys that the newest one lacks put in; of writers at the same time none loses a key."""
    return versions.replace(lambda old: merge_cache(old, found.select("geo_key", "label")), path, CACHE_SCHEMA, found.sparkSession)


def write_by_location(named: DataFrame, path: str) -> None:
    """Catalog rows with one folder per label."""
    named.write.mode("overwrite").partitionBy("label").parquet(path)
