"""Screenshots, recordings, messaging images and document photos."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..params import ALL_PHOTO, CATEGORIES, DOCUMENT, MESSAGING, RECORDING, SCREENS, SCREENSHOT, VIDEO


def families(name: Column) -> dict[str, Column]:
    s = X.stem(name)
    return {"screenshot": X.any_pattern(s, SCREENSHOT), "recording": X.any_pattern(s, RECORDING), "messaging": X.any_pattern(s, MESSAGING), "document": X.any_pattern(s, DOCUMENT)}


def screen_sized() -> Column:
    both = [s for w, h in SCREENS for s in (f"{w}x{h}", f"{h}x{w}")]
    return F.concat_ws("x", "width", "height").isin(*both) & F.col("width").isNotNull() & F.col("height").isNotNull()


def screenshot_by_metadata() -> Column:
    return (F.col("extension") == ".png") & screen_sized() & F.col("gps_lat").isNull()


def classify_non_photos(media: DataFrame) -> DataFrame:
    """Files of the four categories, the first that fits; recordings are videos only and come first."""
    ext, f = F.col("extension"), families(F.col("filename"))
    # Categories and reasons.
    rules = [
        (ext.isin(*VIDEO) & f["recording"], "screen_recording", "Filename matches screen recording pattern"),
        (f["screenshot"], "screenshot", "Filename matches screenshot pattern"),
        (screenshot_by_metadata(), "screenshot", "PNG with screen resolution, no GPS data"),
        (f["messaging"], "messaging", "Filename matches messaging app pattern"),
        (f["document"], "document", "Filename matches document/scan pattern"),
    ]
    pick = F.lit(None)
    for cond, category, reason in rules[::-1]:
        pick = F.when(cond, F.struct(F.lit(category).alias("category"), F.lit(reason).alias("reason"))).otherwise(pick)
    rows = media.where(ext.isin(*ALL_PHOTO, *VIDEO)).withColumn("_p", pick)
    return rows.where("_p is not null").select(*media.columns, "_p.category", "_p.reason")


def non_photo_stats(classified: DataFrame) -> DataFrame:
    return classified.groupBy("category").agg(F.count("*").alias("count"), F.sum("size").alias("bytes"))


def validate_moves(requests: DataFrame, base: str) -> DataFrame:
    """Requests (file_id, path, category) that may be carried out, and why the others may not."""
    # Statuses.
    why = F.when(~F.col("category").isin(*CATEGORIES), "Invalid category").when(~X.path_within(F.col("path"), F.lit(base)), "Path outside base directory")
    return requests.select("file_id", "path", "category", F.coalesce(why, F.lit("ok")).alias("status"))
