"""Which videos to encode anew, and which pictures to turn."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..params import ALL_PHOTO, DEFAULTS, TRANSCODE_VIDEO, VIDEO
from .catalog import skipped


def transcode_candidates(media: DataFrame, base: str = DEFAULTS.base_dir, min_h264: int = DEFAULTS.min_h264_bytes, recompress: bool = False) -> DataFrame:
    codec = F.coalesce("codec", F.lit(""))
    video = F.col("extension").isin(*TRANSCODE_VIDEO) & (F.col("size") > 0)
    level = (X.parent(F.col("directory")) == base) & ~skipped(X.basename(F.col("directory")))
    anew = (codec != "hvc1") & ~((codec == "avc1") & (F.col("size") < min_h264))
    again = F.lit(recompress) & (codec == "hvc1") & (F.col("extension") == ".mov")
    return media.where(video & level & (anew | again)).select("file_id", "path", codec.alias("codec"), "size", F.concat(X.parent(F.col("path")), F.lit("/"), X.stem(F.col("filename")), F.lit(".mp4")).alias("new_path"))


def transcode_summary(candidates: DataFrame, results: DataFrame | None = None) -> DataFrame:
    """Videos and bytes; with `results` (file_id, new_size) what encoding saved."""
    if results is None:
        return candidates.agg(F.count("*").alias("videos"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))
    both = candidates.join(results, "file_id", "left")
    return both.agg(F.count("*").alias("videos"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"), F.count("new_size").alias("converted"), F.coalesce(F.sum(F.when(F.col("new_size").isNotNull(), F.col("size") - F.col("new_size"))), F.lit(0)).alias("saved_bytes"))


def orientation_detections(media: DataFrame, logits: DataFrame, least: float = DEFAULTS.rotation_confidence) -> DataFrame:
    """Files that a model finds turned: media with `logits` (file_id, logits) joined by file_id."""
    got = media.where(F.col("extension").isin(*ALL_PHOTO, *VIDEO)).join(logits, "file_id").withColumn("_d", X.decide(F.col("logits")))
    rows = got.select("file_id", "path", "extension", F.col("_d.rotation").alias("rotation"), F.col("_d.confidence").alias("confidence"))
    return rows.where((F.col("rotation") != 0) & (F.col("confidence") >= least)).withColumn("band", X.confidence_band(F.col("confidence"))).withColumn("high_select", F.col("confidence") >= 0.8)
