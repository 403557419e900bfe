"""Building, cleaning and counting the media catalog."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..params import SCAN_PHOTO, SKIP_DIRS, SORT_HEIC, SORT_IMAGE, SORT_VIDEO, VIDEO


def normalize_media(raw: DataFrame) -> DataFrame:
    """Catalog rows of raw metadata rows, whose fields are texts named as metadata readers name them."""
    c = F.col
    name = X.falsy_chain(c("FileName"), X.basename(c("SourceFile")))
    return raw.select(
        *(x for x in ("file_id",) if x in raw.columns), c("SourceFile").alias("path"), name.alias("filename"), X.extension(name).alias("extension"),
        F.coalesce(c("FileSize").try_cast("bigint"), F.lit(0)).alias("size"), X.falsy_chain(c("DateTimeOriginal"), c("CreateDate"), c("FileModifyDate")).alias("date_raw"),
        c("GPSLatitude").try_cast("double").alias("gps_lat"), c("GPSLongitude").try_cast("double").alias("gps_lon"), c("Orientation").try_cast("int").alias("orientation"),
        c("ImageWidth").try_cast("int").alias("width"), c("ImageHeight").try_cast("int").alias("height"), X.falsy_chain(c("CompressorID"), c("VideoCodecID"), c("CompressorName")).alias("codec"),
        c("Duration").try_cast("double").alias("duration"), F.coalesce(c("Directory"), F.lit("")).alias("directory"), F.coalesce(c("MIMEType"), F.lit("")).alias("mime_type"),
    )


def media_kind(ext: Column, photo: tuple[str, ...] = SCAN_PHOTO, video: tuple[str, ...] = VIDEO) -> Column:
    return F.when(ext.isin(*photo), "photo").when(ext.isin(*video), "video").otherwise("other")


def sort_kind(ext: Column) -> Column:
    return F.when(ext.isin(*SORT_IMAGE), "image").when(ext.isin(*SORT_HEIC), "heic").when(ext.isin(*SORT_VIDEO), "video")


def cleanup_plan(media: DataFrame) -> DataFrame:
    """Junk files, empty files, and names whose extension should be lower case or .jpg."""
    name = F.col("filename")
    ext = F.regexp_replace(X.extension(name), r"^\.jpeg$", ".jpg")
    new = F.concat(X.stem(name), ext)
    problem = F.when(name == ".DS_Store", "junk").when(F.col("size") == 0, "empty").when(new != name, "extension")
    return media.select("file_id", "path", problem.alias("problem"), F.when(problem == "extension", new).alias("new_name")).where("problem is not null")


def has_gps() -> Column:
    return F.col("gps_lat").isNotNull() & F.col("gps_lon").isNotNull()


def without_gps(media: DataFrame) -> DataFrame:
    return media.where(~has_gps())


def catalog_stats(media: DataFrame) -> DataFrame:
    kind = media_kind(F.col("extension"))
    n = lambda cond: F.count_if(cond)
    return media.agg(F.count("*").alias("total_files"), F.coalesce(F.sum("size"), F.lit(0)).alias("total_size"), n(kind == "photo").alias("photo_count"), n(kind == "video").alias("video_count"), n(has_gps()).alias("with_gps"), n(~has_gps()).alias("without_gps"))


def skipped(folder: Column, skip: tuple[str, ...] = SKIP_DIRS) -> Column:
    return folder.isin(*skip) | folder.startswith(".")


def existing_locations(media: DataFrame) -> DataFrame:
    folder = X.basename(F.col("directory"))
    return media.select(folder.alias("location")).where(~skipped(F.col("location"))).distinct().orderBy("location")


def unknown_files(media: DataFrame, unknown_dir: str = "/library/Unknown") -> DataFrame:
    kind = sort_kind(F.col("extension"))
    rows = media.where((F.col("directory") == unknown_dir) & (F.col("size") > 0) & ~F.col("filename").startswith("."))
    return rows.select("file_id", F.col("filename").alias("name"), kind.alias("type"), F.col("extension").alias("ext")).where("type is not null").orderBy("name", "file_id")


def orientation_issues(media: DataFrame) -> DataFrame:
    """Photos, of the kinds that a scan counts as such, whose orientation isn't the plain one."""
    tag = F.col("orientation").cast("int")
    return media.where(F.col("extension").isin(*SCAN_PHOTO) & tag.isNotNull() & (tag != 1)).select("file_id", "path", tag.alias("current_orientation"), X.orientation_label(tag).alias("label"))
