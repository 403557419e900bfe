"""Places: geocoding by cached cells and a gazetteer, GPS back-fill, and counts by place."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..params import DEFAULTS, MEDIA
from ..storage import written
from .catalog import has_gps


def located(media: DataFrame) -> DataFrame:
    return media.where(has_gps()).withColumn("geo_key", X.geo_key(F.col("gps_lat"), F.col("gps_lon")))


def missing_gps(media: DataFrame) -> DataFrame:
    """Files without both coordinates."""
    return media.where(~has_gps())


def location_clusters(media: DataFrame) -> DataFrame:
    return located(media).groupBy("geo_key").agg(F.count("*").alias("files"))


def place_labels(places: DataFrame) -> DataFrame:
    c = F.col
    return places.select("place_id", "lat", "lon", X.location_label(c("city"), c("town"), c("county"), c("state"), c("country"), c("country_code")).alias("label"))


def geocode_cache(places: DataFrame) -> DataFrame:
    """geo_key, label: of each cell the place with the smallest id."""
    keyed = place_labels(places).withColumn("geo_key", X.geo_key(F.col("lat"), F.col("lon")))
    return keyed.groupBy("geo_key").agg(F.min_by("label", "place_id").alias("label"))


def merge_cache(old: DataFrame, new: DataFrame) -> DataFrame:
    """The cache with new keys put in; keys that it has stay."""
    return old.unionByName(new.join(old, "geo_key", "left_anti").dropDuplicates(["geo_key"]))


def geocode_lookup(clusters: DataFrame, cache: DataFrame) -> DataFrame:
    return clusters.join(cache, "geo_key", "left").select("geo_key", "files", "label", F.col("label").isNull().alias("missing"))


def geocode_work(lookup: DataFrame, rate_s: float = DEFAULTS.rate_limit_s) -> DataFrame:
    n = F.count_if("missing")
    return lookup.agg(F.count("*").alias("keys"), n.alias("to_query"), F.round(n * F.lit(rate_s), 1).alias("estimated_s"))


#: Cells a degree of each level, and places up to which a cell isn't split further.
SCALES, LEAF = (1, 8, 64, 512, 4096), 64

_EARTH_M = 6371000.0


def _row(lat: Column, scale: int) -> Column:
    return F.floor((lat + 90) * scale)


def _turned(lon: Column) -> Column:
    """Degrees east of the date line, from 0 to 360."""
    return F.pmod(lon + 180, F.lit(360.0))


def _cell(y: Column, x: Column, scale: int) -> Column:
    return y * (360 * scale) + x


def _box_distance(lat: Column, lon: Column, nearest: bool) -> Column:
    """A bound on the metres from a point to whatever lies in a box (_s, _n, _w, _e): a lower one, or else an upper one.

    The haversine grows with both differences, and with the cosine of the latitude.
    """
    c = F.col
    beside = lambda edge: F.least(F.abs(lon - edge), 360 - F.abs(lon - edge))
    cosines = F.cos(F.radians("_s")), F.cos(F.radians("_n"))
    if nearest:
        dy = F.greatest(c("_s") - lat, lat - c("_n"), F.lit(0.0))
        dx = F.when(lon.between(c("_w"), c("_e")), 0.0).otherwise(F.least(beside(c("_w")), beside(c("_e"))))
        wide = F.least(*cosines)
    else:
        dy = F.greatest(F.abs(lat - c("_s")), F.abs(lat - c("_n")))
        dx = F.least(F.greatest(F.abs(lon - c("_w")), F.abs(lon - c("_e"))), F.lit(180.0))
        wide = F.when((c("_s") <= 0) & (c("_n") >= 0), 1.0).otherwise(F.greatest(*cosines))
    h = F.pow(F.sin(F.radians(dy / 2)), 2) + F.cos(F.radians(lat)) * wide * F.pow(F.sin(F.radians(dx / 2)), 2)
    return 2 * _EARTH_M * F.asin(F.sqrt(F.least(F.greatest(h, F.lit(0.0)), F.lit(1.0))))


def _tree(spots: DataFrame, leaf: int) -> tuple[list[DataFrame], DataFrame]:
    """By level the cells that hold spots, with their bounds and whether they are split no further, and spots by such a cell."""
    nodes, held, left = [], [], spots
    for level, scale in enumerate(SCALES):
        cell = _cell(_row(F.col("lat"), scale), F.floor(F.col("_x") * scale), scale)
        left = left.withColumn("_cell", cell)
        last = F.lit(True) if level == len(SCALES) - 1 else F.count("*") <= leaf
        bounds = left.groupBy("_cell").agg(F.min("lat").alias("_s"), F.max("lat").alias("_n"), F.min("_x").alias("_w"), F.max("_x").alias("_e"), last.alias("_leaf"))
        nodes.append(written(bounds, "cells"))
        ends = nodes[-1].where("_leaf").select("_cell")
        held.append(left.join(ends, "_cell", "left_semi").withColumn("_level", F.lit(level)))
        if nodes[-1].where("not _leaf").limit(1).count() == 0:
            break
        left = left.join(ends, "_cell", "left_anti")
    return nodes, written(reduce(DataFrame.unionByName, held), "spots")


def nearest_place(keys: DataFrame, places: DataFrame, limit_m: float = 50_000.0, leaf: int = LEAF) -> DataFrame:
    """geo_key and the label of the nearest place within `limit_m`, else Unknown; equal distances go to the smaller id.

    Places lie in a tree of cells, split where they are many.  Each key starts with the cells of a degree around it and goes
    down level by level, by a join on cells, leaving out those that are further than the farthest corner of another one
    that it meets; so it meets a few places only, however many a town has.  Places without coordinates are never nearest;
    of places at one spot the smallest id counts.
    """
    at = keys.select("geo_key", F.split_part("geo_key", F.lit(","), F.lit(1)).cast("double").alias("_lat"), F.split_part("geo_key", F.lit(","), F.lit(2)).cast("double").alias("_lon")).withColumn("_at", _turned(F.col("_lon")))
    spots = place_labels(places).where("lat is not null and lon is not null").groupBy("lat", "lon").agg(F.min("place_id").alias("place_id"), F.min_by("label", "place_id").alias("label"))
    nodes, spots = _tree(written(spots.withColumn("_x", _turned(F.col("lon"))), "spots"), leaf)
    deg = limit_m / 111_000.0
    reach = int(-(-deg // 1))
    edge = F.abs("_lat") + deg
    across = F.when(edge >= 89, 180).otherwise(F.least(F.ceil(deg / F.cos(F.radians(edge))).cast("int"), F.lit(180)))
    around = at.withColumn("_y", F.explode(F.sequence(F.lit(-reach), F.lit(reach)))).withColumn("_dx", F.explode(F.sequence(-across, across)))
    x = F.pmod(F.floor("_at") + F.col("_dx"), F.lit(360))
    met = around.select("geo_key", "_lat", "_lon", "_at", _cell(_row(F.col("_lat"), 1) + F.col("_y"), x, 1).alias("_cell")).distinct()
    best, ends = F.min("_far").over(Window.partitionBy("geo_key")), []
    for level, cells in enumerate(nodes):
        if level:
            wide = 360 * SCALES[level]
            y, x = F.floor(F.col("_cell") / wide), F.col("_cell") % wide
            ratio = SCALES[level] // SCALES[level - 1]
            cells = cells.withColumn("_up", _cell(F.floor(y / ratio), F.floor(x / ratio), SCALES[level - 1]))
            met = met.drop("_s", "_n", "_w", "_e", "_leaf", "_near", "_far", "_cell").join(cells, "_up").drop("_up")
        else:
            met = met.join(cells, "_cell")
        met = met.withColumn("_near", _box_distance(F.col("_lat"), F.col("_at"), True)).withColumn("_far", _box_distance(F.col("_lat"), F.col("_at"), False))
        # A millimetre and a billionth for rounding.
        met = written(met.where(F.col("_near") <= limit_m + 1e-3).withColumn("_best", best).where(F.col("_near") <= F.col("_best") * (1 + 1e-9) + 1e-3).drop("_best"), "met")
        ends.append(met.where("_leaf").select("geo_key", "_lat", "_lon", "_cell", F.lit(level).alias("_level")))
        met = met.where("not _leaf").withColumn("_up", F.col("_cell"))
    d = X.haversine_m(F.col("_lat"), F.col("_lon"), F.col("lat"), F.col("lon"))
    found = reduce(DataFrame.unionByName, ends).join(spots, ["_level", "_cell"]).withColumn("_d", d).where(F.col("_d") <= limit_m)
    nearest = found.groupBy("geo_key").agg(F.min_by("label", F.struct("_d", "place_id")).alias("label"))
    return keys.select("geo_key").join(nearest, "geo_key", "left").select("geo_key", F.coalesce("label", F.lit("Unknown")).alias("label"))


def labelled(media: DataFrame, labels: DataFrame) -> DataFrame:
    """Each file with the label of its cell; Unknown without coordinates or label."""
    keyed = media.withColumn("geo_key", F.when(has_gps(), X.geo_key(F.col("gps_lat"), F.col("gps_lon"))))
    return keyed.join(labels, "geo_key", "left").withColumn("label", F.coalesce("label", F.lit("Unknown")))


def folder_summary(named: DataFrame, ref_compat: bool = False) -> DataFrame:
    """Files per label and in all.  With `ref_compat` Unknown counts files without coordinates only."""
    rows = named.where(~((F.col("label") == "Unknown") & has_gps())) if ref_compat else named
    return rows.rollup("label").agg(F.count("*").alias("files")).select(F.coalesce("label", F.lit("TOTAL")).alias("folder"), "files").orderBy(F.desc("files"), "folder")


def backfill_files(media: DataFrame, folder_gps: DataFrame, base: str = DEFAULTS.base_dir) -> DataFrame:
    """Files directly in a mapped folder, with that folder's coordinates; the mapping is a short configuration table."""
    inside = media.where((X.parent(F.col("directory")) == base) & (F.col("size") > 0) & F.col("extension").isin(*MEDIA))
    return inside.withColumn("folder", X.basename(F.col("directory"))).join(folder_gps, "folder")


def gps_backfill_plan(media: DataFrame, folder_gps: DataFrame) -> DataFrame:
    return backfill_files(media, folder_gps).where(~has_gps()).select("file_id", "path", "folder", F.col("lat").alias("new_lat"), F.col("lon").alias("new_lon"))


def unmapped_folders(media: DataFrame, folder_gps: DataFrame) -> DataFrame:
    there = media.select(X.basename(F.col("directory")).alias("folder")).distinct()
    return folder_gps.join(there, "folder", "left_anti").select("folder")


def gps_write_summary(media: DataFrame, folder_gps: DataFrame) -> DataFrame:
    rows = backfill_files(media, folder_gps).rollup("folder").agg(F.count_if(~has_gps()).alias("to_write"), F.count_if(has_gps()).alias("kept"))
    return rows.select(F.coalesce("folder", F.lit("TOTAL")).alias("folder"), "to_write", "kept", (F.col("to_write") == 0).alias("all_have"))


#: Roots up to which they become part of the filter; more of them are joined.
FEW_ROOTS = 200


def _few(roots: DataFrame) -> list[str] | None:
    """The roots in their order, or None if they are many."""
    rows = roots.orderBy("ord").limit(FEW_ROOTS + 1).collect()
    return [r["base_dir"] for r in rows] if len(rows) <= FEW_ROOTS else None


def _roots_above(media: DataFrame) -> DataFrame:
    return media.select("file_id", F.explode(X.ancestors(F.col("path"))).alias("base_dir"))


def assign_base(media: DataFrame, roots: DataFrame) -> DataFrame:
    """The first root (by ord) that a path is in, else its folder."""
    path = F.col("path")
    if (few := _few(roots)) is not None:
        return media.select("file_id", "path", F.coalesce(*(F.when(X.path_within(path, F.lit(b)), b) for b in few), X.parent(path)).alias("base_dir"))
    hit = _roots_above(media).join(roots, "base_dir").groupBy("file_id").agg(F.min_by("base_dir", "ord").alias("base_dir"))
    return media.select("file_id", "path").join(hit, "file_id", "left").select("file_id", "path", F.coalesce("base_dir", X.parent(path)).alias("base_dir"))


def access_filter(media: DataFrame, roots: DataFrame) -> DataFrame:
    """Files within any of the roots."""
    if (few := _few(roots)) is not None:
        return media.where(reduce(Column.__or__, (X.path_within(F.col("path"), F.lit(b)) for b in few), F.lit(False)))
    return media.join(_roots_above(media).join(roots, "base_dir", "left_semi").select("file_id"), "file_id", "left_semi")
