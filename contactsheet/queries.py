"""All registered queries of the catalog operators, and the same in SQL for DuckDB."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fixtures as fx
from . import versions
from .functions import exprs as X
from .operators import catalog, classify, dates, dedup, geo, similar, transcode
from .params import ALL_PHOTO, CATEGORIES, DOCUMENT, MEDIA, MESSAGING, RECORDING, SCAN_PHOTO, SCREENS, SCREENSHOT, SKIP_DIRS, VIDEO
from .plans import ledger, plan
from .sources import metadata
from .storage import shared_dir

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

C = F.col


def query(sql: str | None = None, *ctes: str) -> Callable[[Query], Query]:
    """Registers a query, with its SQL over the CTE `media` and further CTEs."""

    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = "with " + ", ".join((fx.MEDIA_SQL, *ctes)) + " " + sql if "media" in sql or ctes else sql
        return f

    return put


def _in(values: tuple[str, ...]) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def _any(column: str, patterns: tuple[str, ...]) -> str:
    return "(" + " or ".join(f"regexp_matches({column}, '(?i){p}')" for p in patterns) + ")"


SUFFIX = r"regexp_extract({0}, '^.+(\.[^.]+)$', 1)"
STEM = "substr({0}, 1, length({0}) - length(" + SUFFIX + "))"
BASE = "regexp_extract({0}, '[^/]*$')"
PARENT = "regexp_replace({0}, '/[^/]*$', '')"
NAME_STEM, NAME_SUFFIX = STEM.format("filename"), SUFFIX.format("filename")
EXIF_S = "coalesce(date_epoch, epoch(try_strptime(date_raw, ['%Y:%m:%d %H:%M:%S', '%Y-%m-%dT%H:%M:%S', '%Y-%m-%d %H:%M:%S'])))"
NAME_RE = r"(\d{4})[-_]?(\d{2})[-_]?(\d{2})[-_](\d{2})[-_]?(\d{2})[-_]?(\d{2})"
NAME_S = "epoch(try_strptime(" + " || ' ' || ".join(f"regexp_extract(filename, '{NAME_RE}', {i})" for i in range(1, 7)) + ", '%Y %m %d %H %M %S'))"
DATE_NAME = r"case when regexp_matches(split_part(date_raw, '+', 1), '^\d{4}:\d{2}:\d{2}\s+\d{2}:\d{2}:\d{2}') then regexp_replace(regexp_extract(split_part(date_raw, '+', 1), '^\d{4}:\d{2}:\d{2}\s+\d{2}:\d{2}:\d{2}'), '^(\d{4}):(\d{2}):(\d{2})\s+(\d{2}):(\d{2}):(\d{2})', '\1\2\3_\4\5\6') end"
LOCAL_S = r"epoch(try_strptime(regexp_extract(trim(date_raw), '^(\d{4}[:-]\d{2}[:-]\d{2}[ T]\d{2}:\d{2}:\d{2})([+-]\d{2}:?\d{2})?$', 1), ['%Y:%m:%d %H:%M:%S', '%Y-%m-%dT%H:%M:%S', '%Y-%m-%d %H:%M:%S']))"
ZONE = r"regexp_extract(trim(date_raw), '([+-]\d{2}:?\d{2})$', 1)"
UTC_S = f"case when regexp_matches(trim(date_raw), ':\\d{{2}}[+-]\\d{{2}}:?\\d{{2}}$') then ({LOCAL_S}) - (case when {ZONE}[1] = '+' then 1 else -1 end) * (substr({ZONE}, 2, 2)::int * 3600 + right({ZONE}, 2)::int * 60) end"
HAV = "2 * 6371000.0e0 * atan2(sqrt({x}), sqrt(1 - ({x})))"


def _hav(a: str, b: str, c: str, d: str) -> str:
    x = f"(pow(sin(radians({c} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin(radians({d} - {b}) / 2), 2))"
    return HAV.format(x=x)


QUALITY = "(coalesce(width, 0)::decimal(12,0) * coalesce(height, 0)::decimal(12,0) * coalesce(size, 0)::decimal(12,0))::decimal(38,0)"
HAS_GPS = "(gps_lat is not null and gps_lon is not null)"
GEO_KEY = "printf('%.2f,%.2f', gps_lat, gps_lon)"


# Catalog, scalar functions


@query(f"select file_id, path, coalesce(nullif(fn, ''), {BASE.format('path')}) filename, lower({SUFFIX.format("coalesce(nullif(fn, ''), " + BASE.format('path') + ')')}) extension, size, coalesce(nullif(d1, ''), nullif(d2, '')) date_raw, gps_lat, gps_lon, orientation, width, height, coalesce(nullif(c1, ''), c2) codec, null::double duration, directory, '' mime_type from raw", "raw as (select *, case when file_id%4=0 then '' when file_id%4=1 then null else filename end fn, case when file_id%3=0 then '' else date_raw end d1, date_raw d2, case when file_id%2=0 then '' end c1, codec c2 from media)")
def normalize_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    m, i, s = fx.media(spark, sf_dir), C("file_id"), lambda c: C(c).cast("string")
    none = F.lit(None).cast("string")
    raw = m.select(i, C("path").alias("SourceFile"), F.when(i % 4 == 0, "").when(i % 4 > 1, C("filename")).alias("FileName"), s("size").alias("FileSize"), F.when(i % 3 == 0, "").otherwise(C("date_raw")).alias("DateTimeOriginal"), C("date_raw").alias("CreateDate"), none.alias("FileModifyDate"), s("gps_lat").alias("GPSLatitude"), s("gps_lon").alias("GPSLongitude"), s("orientation").alias("Orientation"), s("width").alias("ImageWidth"), s("height").alias("ImageHeight"), F.when(i % 2 == 0, "").alias("CompressorID"), C("codec").alias("VideoCodecID"), none.alias("CompressorName"), none.alias("Duration"), C("directory").alias("Directory"), none.alias("MIMEType"))
    return catalog.normalize_media(raw)


@query("select file_id, case when starts_with(raw, '.') then lower(raw) else '.' || lower(raw) end ext from (select file_id, case file_id%3 when 0 then upper(extension) when 1 then substr(extension, 2) else extension end raw from media)")
def normalize_extensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, e = C("file_id"), C("extension")
    return fx.media(spark, sf_dir).select("file_id", X.normal_extension(F.when(i % 3 == 0, F.upper(e)).when(i % 3 == 1, F.substring(e, 2, 99)).otherwise(e)).alias("ext"))


@query(f"select extension, case when extension in {_in(SCAN_PHOTO)} then 'photo' when extension in {_in(VIDEO)} then 'video' else 'other' end scan_kind, extension in {_in(ALL_PHOTO)} is_photo, case when extension in ('.jpg', '.jpeg', '.png') then 'image' when extension = '.heic' then 'heic' when extension in ('.mov', '.mp4') then 'video' end sort_kind, count(*) files from media group by all")
def media_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = C("extension")
    return fx.media(spark, sf_dir).groupBy("extension").agg(F.count("*").alias("files")).select("extension", catalog.media_kind(e).alias("scan_kind"), e.isin(*ALL_PHOTO).alias("is_photo"), catalog.sort_kind(e).alias("sort_kind"), "files")


@query(f"select * from (select file_id, path, case when filename = '.DS_Store' then 'junk' when size = 0 then 'empty' when nn <> filename then 'extension' end problem, case when filename <> '.DS_Store' and size <> 0 and nn <> filename then nn end new_name from (select *, {NAME_STEM} || regexp_replace(lower({NAME_SUFFIX}), '^\\.jpeg$', '.jpg') nn from media)) where problem is not null")
def cleanup_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.cleanup_plan(fx.media(spark, sf_dir))


@query(f"select file_id, {BASE.format('path')} basename, {PARENT.format('path')} parent, {NAME_STEM} stem, {NAME_SUFFIX} suffix from media")
def path_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.media(spark, sf_dir).select("file_id", X.basename(C("path")).alias("basename"), X.parent(C("path")).alias("parent"), X.stem(C("filename")).alias("stem"), X.suffix(C("filename")).alias("suffix"))


@query(f"select file_id, {EXIF_S} exif_s, {NAME_S} name_s, {DATE_NAME} date_name, {LOCAL_S} local_s, {UTC_S} utc_s from media")
def date_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = C("date_raw")
    return fx.media(spark, sf_dir).select("file_id", X.exif_seconds(d, C("date_epoch")).alias("exif_s"), X.name_seconds(C("filename")).alias("name_s"), X.date_name(d).alias("date_name"), X.local_seconds(d).alias("local_s"), X.utc_seconds(d).alias("utc_s"))


@query(rf"select file_id, case when regexp_matches({NAME_STEM}, '^\d{{8}}_\d{{6}}') then regexp_replace(substr({NAME_STEM}, 1, 15), '^(....)(..)(..)_(..)(..)(..)$', '\1:\2:\3 \4:\5:\6') end exif_date from media")
def name_to_exif_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.media(spark, sf_dir).select("file_id", X.name_to_exif(C("filename")).alias("exif_date"))


@query(f"select file_id, round({_hav('gps_lat', 'gps_lon', 'lat2', 'lon2')}, 3) meters from (select file_id, gps_lat, gps_lon, lead(file_id) over w nxt, lead(gps_lat) over w lat2, lead(gps_lon) over w lon2 from media window w as (order by file_id)) where nxt = file_id + 1")
def haversine(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = fx.media(spark, sf_dir)
    b = m.select((C("file_id") - 1).alias("file_id"), C("gps_lat").alias("lat2"), C("gps_lon").alias("lon2"))
    return m.join(b, "file_id").select("file_id", F.round(X.haversine_m(C("gps_lat"), C("gps_lon"), C("lat2"), C("lon2")), 3).alias("meters"))


@query(f"select file_id, case when {HAS_GPS} then {GEO_KEY} end geo_key, abs(gps_lat) lat, case when gps_lat >= 0 then 'N' when gps_lat < 0 then 'S' end lat_ref, abs(gps_lon) lon, case when gps_lon >= 0 then 'E' when gps_lon < 0 then 'W' end lon_ref from media")
def gps_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = C("gps_lat"), C("gps_lon")
    return fx.media(spark, sf_dir).select("file_id", X.geo_key(a, b).alias("geo_key"), F.abs(a).alias("lat"), X.lat_ref(a).alias("lat_ref"), F.abs(b).alias("lon"), X.lon_ref(b).alias("lon_ref"))


@query("select file_id, (case when k then gps_lat end)::double lat, (case when k then gps_lon end)::double lon from (select *, file_id%5 > 0 and file_id%7 > 0 and abs(gps_lat) <= 90 and abs(gps_lon) <= 180 k from media)")
def parse_gps(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = C("file_id")
    text = F.when(i % 5 == 0, F.concat("gps_lat", F.lit(";"), "gps_lon")).otherwise(F.concat(F.lit(" "), "gps_lat", F.lit(", "), "gps_lon"))
    return fx.media(spark, sf_dir).select("file_id", X.parse_gps(text).alias("p")).select("file_id", "p.lat", "p.lon")


@query(f"select file_id, {QUALITY} quality, case when size >= 1000000000 then printf('%.1f GB', size / 1e9) when size >= 1000000 then printf('%.1f MB', size / 1e6) when size >= 1000 then printf('%.1f KB', size / 1e3) else size || ' B' end size_text, path = '/library/Japan_Tokyo' or starts_with(path, '/library/Japan_Tokyo/') within_base from media")
def size_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.media(spark, sf_dir).select("file_id", X.quality(C("width"), C("height"), C("size")).alias("quality"), X.format_size(C("size")).alias("size_text"), X.path_within(C("path"), F.lit("/library/Japan_Tokyo")).alias("within_base"))


@query("select file_id, hamming(phash_bits, bits2)::int distance, round(1 - hamming(phash_bits, bits2) / 64, 4) similarity from (select file_id, phash_bits, lead(file_id) over w nxt, lead(phash_bits) over w bits2 from media window w as (order by file_id)) where nxt = file_id + 1")
def hamming64(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = fx.media(spark, sf_dir).select("file_id", X.bits_to_long(C("phash_bits")).alias("h"))
    d = X.hamming64(C("h"), C("h2"))
    return m.join(m.select((C("file_id") - 1).alias("file_id"), C("h").alias("h2")), "file_id").select("file_id", d.alias("distance"), X.similarity64(d).alias("similarity"))


LABEL = "case when coalesce(country_code, '') = 'en' then n else coalesce(country, 'Unknown') || '_' || n end"
LABELS = "labels2 as (select place_id, lat, lon, " + LABEL + " label from (select *, coalesce(nullif(city, ''), nullif(town, ''), nullif(county, ''), nullif(state, ''), 'Unknown') n from places))"


@query("select place_id, label from labels2", fx.PLACES_SQL, LABELS)
def location_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geo.place_labels(fx.places(spark, sf_dir)).select("place_id", "label")


@query("select event_id, case when v <= 45 then 0 when v <= 135 then 90 when v <= 225 then 180 else 270 end rotation from (select event_id, (event_id * 37) % 360 v from events)")
def snap_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", X.snap_rotation((C("event_id") * 37) % 360).alias("rotation"))


@query("select event_id, case when event_id%4 < 3 then case when event_id%4 = 1 then 0 else (event_id%4 * 90)::int end end rotation, case when event_id%4 < 3 then case when event_id%4 = 1 then 0.0e0 else (event_id%10) / 10.0e0 end end confidence from events")
def model_reply(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = C("event_id")
    body = F.concat(F.lit('{"rotation": '), i % 4 * 90, F.lit(', "confidence": 0.'), i % 10, F.lit("}"))
    text = F.when(i % 4 == 0, body).when(i % 4 == 1, F.lit("{}")).when(i % 4 == 2, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).otherwise(F.lit("sorry"))
    got = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", X.model_reply(text).alias("r"))
    return got.select("event_id", "r.rotation", "r.confidence")


LOGITS = "logits as (select vec_id, list_transform(embedding[1:4], lambda x: x::double * 8) l from embeddings), decided as (select vec_id, ((list_position(l, list_max(l)) - 1) * 90)::int rotation, 1 / list_sum(list_transform(l, lambda x: exp(x - list_max(l)))) confidence from logits)"
BAND = "case when confidence >= 0.9 then 'High' when confidence >= 0.7 then 'Medium' else 'Low' end"


def _logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return e.select("vec_id", F.transform(F.slice("embedding", 1, 4), lambda x: x.cast("double") * 8).alias("logits"))


@query(f"select vec_id, rotation, round(confidence, 9) confidence, {BAND} band from decided", LOGITS)
def softmax_decide(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _logits(spark, sf_dir).select("vec_id", X.decide(C("logits")).alias("d"))
    return d.select("vec_id", "d.rotation", F.round("d.confidence", 9).alias("confidence"), X.confidence_band(C("d.confidence")).alias("band"))


# Filters and classification

LABELS_SQL = "case orientation when 2 then 'Mirrored horizontal' when 3 then 'Rotated 180°' when 4 then 'Mirrored vertical' when 5 then 'Mirrored horizontal & rotated 270° CW' when 6 then 'Rotated 90° CW' when 7 then 'Mirrored horizontal & rotated 90° CW' when 8 then 'Rotated 90° CCW' else 'Unknown (' || orientation || ')' end"


@query(f"select file_id, path, orientation current_orientation, {LABELS_SQL} label from media where extension in {_in(SCAN_PHOTO)} and orientation is not null and orientation <> 1")
def orientation_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.orientation_issues(fx.media(spark, sf_dir))


@query(f"select file_id, {HAS_GPS} has_gps from media")
def has_gps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.media(spark, sf_dir).select("file_id", catalog.has_gps().alias("has_gps"))


@query(rf"select file_id, regexp_matches({NAME_STEM}, '^\d{{8}}_\d{{6}}(_\d+)?$') named, {_any(NAME_STEM, SCREENSHOT)} screenshot, {_any(NAME_STEM, RECORDING)} recording, {_any(NAME_STEM, MESSAGING)} messaging, {_any(NAME_STEM, DOCUMENT)} document from media")
def name_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.media(spark, sf_dir).select("file_id", dates.is_date_named(C("filename")).alias("named"), *(c.alias(k) for k, c in classify.families(C("filename")).items()))


SCREEN_SQL = "(width, height) in (" + ", ".join(f"({a}, {b}), ({b}, {a})" for a, b in SCREENS) + ")"
BY_META = f"(extension = '.png' and coalesce({SCREEN_SQL}, false) and gps_lat is null)"
CLASSIFIED = f"""classified as (select * from (select *, case when extension in {_in(VIDEO)} and {_any(NAME_STEM, RECORDING)} then 'screen_recording' when {_any(NAME_STEM, SCREENSHOT)} or {BY_META} then 'screenshot' when {_any(NAME_STEM, MESSAGING)} then 'messaging' when {_any(NAME_STEM, DOCUMENT)} then 'document' end category,
 case when extension in {_in(VIDEO)} and {_any(NAME_STEM, RECORDING)} then 'Filename matches screen recording pattern' when {_any(NAME_STEM, SCREENSHOT)} then 'Filename matches screenshot pattern' when {BY_META} then 'PNG with screen resolution, no GPS data' when {_any(NAME_STEM, MESSAGING)} then 'Filename matches messaging app pattern' when {_any(NAME_STEM, DOCUMENT)} then 'Filename matches document/scan pattern' end reason
 from media where extension in {_in(ALL_PHOTO + VIDEO)}) where category is not null)"""


@query(f"select file_id from media where {BY_META}")
def screenshot_by_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.media(spark, sf_dir).where(classify.screenshot_by_metadata()).select("file_id")


@query("select file_id, path, category, reason from classified", CLASSIFIED)
def classify_non_photos(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify.classify_non_photos(fx.media(spark, sf_dir)).select("file_id", "path", "category", "reason")


MISMATCH = f"mismatch as (select * from (select file_id, path, epoch(mtime) mtime_s, coalesce({EXIF_S}, {NAME_S}) target_s, case when {EXIF_S} is not null then 'exif' else 'filename' end source from media) where abs(mtime_s - target_s) > 2)"


@query("select * from mismatch", MISMATCH)
def date_mismatches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dates.date_mismatches(fx.media(spark, sf_dir))


CODEC = "coalesce(codec, '')"
TRANSCODE = f"transcode as (select file_id, path, {CODEC} codec, size, {PARENT.format('path')} || '/' || {NAME_STEM} || '.mp4' new_path from media where extension in ('.mov', '.mp4') and size > 0 and {PARENT.format('directory')} = '/library' and {BASE.format('directory')} not in {_in(SKIP_DIRS)} and not starts_with({BASE.format('directory')}, '.') and {CODEC} <> 'hvc1' and not ({CODEC} = 'avc1' and size < 104857600))"


@query("select * from transcode", TRANSCODE)
def transcode_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transcode.transcode_candidates(fx.media(spark, sf_dir))


@query("select count(*) videos, sum(size)::bigint bytes, count(*) filter (file_id % 2 = 0) converted, (sum(case when file_id % 2 = 0 then size - size // 3 end))::bigint saved_bytes from transcode", TRANSCODE)
def transcode_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = transcode.transcode_candidates(fx.media(spark, sf_dir))
    return transcode.transcode_summary(rows, rows.where("file_id % 2 = 0").select("file_id", F.floor(C("size") / 3).alias("new_size")))


@query("select file_id, filename as name, case when extension in ('.jpg', '.jpeg', '.png') then 'image' when extension = '.heic' then 'heic' else 'video' end as type, extension ext from media where directory = '/library/Unknown' and size > 0 and extension in ('.jpg', '.jpeg', '.png', '.heic', '.mov', '.mp4')")
def unknown_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.unknown_files(fx.media(spark, sf_dir))


DETECTED = f"detected as (select file_id, path, extension, rotation, confidence, {BAND} band, confidence >= 0.8 high_select from media join decided on vec_id = file_id % (select count(*) from embeddings) where extension in {_in(ALL_PHOTO + VIDEO)} and rotation <> 0 and confidence >= 0.7)"


def _detected(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = fx.media(spark, sf_dir)
    vectors = _logits(spark, sf_dir)
    n = vectors.count()
    return transcode.orientation_detections(m, m.select("file_id", (C("file_id") % n).alias("vec_id")).join(vectors, "vec_id").select("file_id", "logits"))


@query("select file_id, path, rotation, round(confidence, 9) confidence, band, high_select from detected", LOGITS, DETECTED)
def orientation_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _detected(spark, sf_dir).select("file_id", "path", "rotation", F.round("confidence", 9).alias("confidence"), "band", "high_select")


@query("select file_id, path, rotation, case when extension in ('.jpg', '.jpeg') then 'jpeg' when extension in ('.heic', '.png', '.tiff', '.tif', '.webp', '.bmp') then 'pixels' when extension in " + _in(VIDEO) + " then 'video-metadata' else 'Unsupported format: ' || extension end strategy from detected", LOGITS, DETECTED)
def rotation_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan.rotation_plan(_detected(spark, sf_dir))


@query("select file_id, path, category, case when category not in ('screenshot', 'screen_recording', 'messaging', 'document') then 'Invalid category' when not starts_with(path, '/library/Japan_Tokyo/') then 'Path outside base directory' else 'ok' end status from (select file_id, path, case file_id%5 when 0 then 'screenshot' when 1 then 'screen_recording' when 2 then 'messaging' when 3 then 'document' else 'other' end category from media)")
def validate_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.element_at(F.array(*map(F.lit, (*CATEGORIES, "other"))), (C("file_id") % 5 + 1).cast("int"))
    return classify.validate_moves(fx.media(spark, sf_dir).withColumn("category", kind), "/library/Japan_Tokyo")


@query(f"select distinct directory from media where not ({BASE.format('directory')} in {_in(SKIP_DIRS)} or starts_with({BASE.format('directory')}, '.'))")
def skip_dirs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.media(spark, sf_dir).where(~catalog.skipped(X.basename(C("directory")))).select("directory").distinct()


# Similar shots

SHOTS = f"shots as (select file_id, gps_lat, gps_lon, size, width, height, {LOCAL_S} local_s, {UTC_S} utc_s, phash_bits from media where extension in {_in(ALL_PHOTO)})"
NEAR = "near as (select * from (select a.file_id a, b.file_id b, case when a.utc_s is not null and b.utc_s is not null then abs(a.utc_s - b.utc_s) else abs(a.local_s - b.local_s) end gap_s from shots a join shots b on a.file_id < b.file_id) where gap_s <= 10)"
EDGES = f"edges as (select n.a, n.b, hamming(x.phash_bits, y.phash_bits)::int distance, round(1 - hamming(x.phash_bits, y.phash_bits) / 64, 4) similarity from near n join shots x on x.file_id = n.a join shots y on y.file_id = n.b where not coalesce({_hav('x.gps_lat', 'x.gps_lon', 'y.gps_lat', 'y.gps_lon')} > 100, false) and hamming(x.phash_bits, y.phash_bits) <= 12)"
GROUPS = "both_ways as (select a, b from edges union all select b, a from edges), reach(n, l) as (select a, a from both_ways union select b, l from reach join both_ways on n = a), comp as (select n file_id, min(l) group_id from reach group by n)"
MEMBERS = f"members as (select c.group_id, s.*, {QUALITY} quality, row_number() over (partition by group_id order by local_s nulls last, s.file_id) - 1 place from comp c join shots s on s.file_id = c.file_id)"
SUMMARY = "summary as (select group_id, count(*) as \"count\", arg_max(file_id, (quality, -place)) keep_id, case when count(local_s) = count(*) and max(local_s) - min(local_s) <= 2 then 'burst' else 'similar' end reason, (sum(size) - arg_max(size, (quality, -place)))::bigint reclaimable_size from members group by group_id)"
SIMILAR = (SHOTS, NEAR, EDGES, GROUPS, MEMBERS, SUMMARY)


def _recursive(sql: str) -> str:
    # DuckDB 2.0 sometimes breaks down over a materialised CTE beside a recursive one.
    return sql.replace("with ", "with recursive ", 1).replace("as materialized (", "as (")


def _shots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar.shots(fx.media(spark, sf_dir))


def _members(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    photos = _shots(spark, sf_dir)
    return similar.similar_edges(photos), similar.group_members(similar.components(similar.linking_edges(photos)), photos)


@query("select file_id, row_number() over (order by local_s nulls last, file_id) place, local_s from shots", SHOTS)
def date_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar.date_places(fx.media(spark, sf_dir))


@query("select * from near", SHOTS, NEAR)
def time_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar.time_neighbors(_shots(spark, sf_dir))


@query(f"select n.a, n.b from near n join shots x on x.file_id = n.a join shots y on y.file_id = n.b where not coalesce({_hav('x.gps_lat', 'x.gps_lon', 'y.gps_lat', 'y.gps_lon')} > 100, false)", SHOTS, NEAR)
def geo_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar.near_in_place(_shots(spark, sf_dir))


@query("select * from edges", SHOTS, NEAR, EDGES)
def hamming_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar.similar_edges(_shots(spark, sf_dir))


@query("select distinct a file_id from (select a from edges union all select b from edges)", SHOTS, NEAR, EDGES)
def edge_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar.edge_nodes(similar.similar_edges(_shots(spark, sf_dir)))


@query("select * from comp", SHOTS, NEAR, EDGES, GROUPS)
def similar_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar.components(similar.linking_edges(_shots(spark, sf_dir)))


@query("select * from summary", *SIMILAR)
def similar_group_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar.group_summary(_members(spark, sf_dir)[1])


@query("select m.group_id, least(m.place, n.place)::int i, greatest(m.place, n.place)::int j, distance, similarity from edges join members m on m.file_id = a join members n on n.file_id = b", *SIMILAR[:5])
def similar_local_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar.local_edges(*_members(spark, sf_dir))


@query('select count(*) as "groups", sum("count")::bigint total, sum(reclaimable_size)::bigint reclaimable from summary', *SIMILAR)
def similar_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar.similar_stats(similar.group_summary(_members(spark, sf_dir)[1]))


@query('select group_id, "count", reclaimable_size from summary order by reclaimable_size desc, group_id limit 20', *SIMILAR)
def top_reclaimable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar.group_summary(_members(spark, sf_dir)[1]).select("group_id", "count", "reclaimable_size").orderBy(F.desc("reclaimable_size"), "group_id").limit(20)


@query("select group_id, arg_max(file_id, (quality, -place)) best from members group by group_id", *SIMILAR[:5])
def best_member(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _members(spark, sf_dir)[1].groupBy("group_id").agg(F.max_by("file_id", F.struct("quality", -C("place"))).alias("best"))


_ORDERS = {"first": "file_id", "largest": "size desc nulls last, file_id", "newest": "coalesce(date_raw, '') desc, file_id", "best": "quality desc nulls last, file_id"}


@query(" union all ".join(f"select '{k}' policy, group_id, x.file_id, case when row_number() over (partition by group_id order by {o.replace('file_id', 'x.file_id')}) = 1 then 'keep' else 'trash' end state from x" for k, o in _ORDERS.items()) + " union all select 'clear', group_id, file_id, 'neutral' from x", *SIMILAR[:5], "x as (select m.group_id, m.file_id, m.size, m.quality, media.date_raw from members m join media on media.file_id = m.file_id)")
def keep_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    from functools import reduce

    rows = _members(spark, sf_dir)[1].join(fx.media(spark, sf_dir).select("file_id", "date_raw"), "file_id")
    return reduce(DataFrame.unionByName, (dedup.keep_policy(rows, k).withColumn("policy", F.lit(k)) for k in (*_ORDERS, "clear")))


for _name in ("similar_groups", "similar_group_summary", "similar_local_edges", "similar_stats", "top_reclaimable", "best_member", "keep_policy"):
    SQL[_name] = _recursive(SQL[_name])

# Duplicates and counts

HASHED = "hashed as (select doc_id file_id, strlen(text) size, md5(text) hash from documents where strlen(text) > 0), dups as (select hash, count(*) as \"count\", min(size)::bigint size, min(file_id) first_id, (min(size) * (count(*) - 1))::bigint wasted_size from hashed group by hash having count(*) > 1)"


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(C("doc_id").alias("file_id"), C("text").alias("content"))


@query()
def exact_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.exact_duplicates(_files(spark, sf_dir), size=F.octet_length("content").cast("bigint"))


@query()
def duplicate_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.duplicate_members(_files(spark, sf_dir), size=F.octet_length("content").cast("bigint"))


@query()
def duplicate_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.duplicate_stats(exact_duplicates(spark, sf_dir))


SQL["exact_duplicates"] = f"with {HASHED} select * from dups"
SQL["duplicate_members"] = f'with {HASHED} select file_id, h.size::bigint size, hash, "count" from hashed h join dups using (hash)'
SQL["duplicate_stats"] = f'with {HASHED} select count(*) as "groups", coalesce(sum("count"), 0)::bigint total_duplicates, coalesce(sum(wasted_size), 0)::bigint wasted_size from dups'


def _listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metadata.scan_files(spark, fx.document_files(spark, sf_dir), (".txt",))


@query("select doc_id || '.txt' filename, '.txt' extension, strlen(text) size, (doc_id % 64)::varchar folder from documents where text is not null")
def scan_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _listing(spark, sf_dir).select("filename", "extension", "size", X.basename(C("directory")).alias("folder"))


@query(f'with {HASHED} select h.file_id, h.size::bigint size, hash, "count" from hashed h join dups using (hash)')
def file_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _listing(spark, sf_dir).select(F.regexp_extract("filename", r"^(\d+)", 1).cast("bigint").alias("file_id"), "path", "size")
    return dedup.file_duplicates(files).drop("path")


@query(f"select count(*) total_files, sum(size)::bigint total_size, count(*) filter (extension in {_in(SCAN_PHOTO)}) photo_count, count(*) filter (extension in {_in(VIDEO)}) video_count, count(*) filter {HAS_GPS} with_gps, count(*) filter (not {HAS_GPS}) without_gps from media")
def catalog_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.catalog_stats(fx.media(spark, sf_dir))


CAN = rf"(not regexp_matches({NAME_STEM}, '^\d{{8}}_\d{{6}}(_\d+)?$') and {DATE_NAME} is not null)"


@query(f"select count(*) filter {CAN} renameable, count(*) - count(*) filter {CAN} - count(*) filter (date_raw is null) already_named from media")
def rename_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dates.rename_stats(fx.media(spark, sf_dir))


@query(f"select count(*) issues from media where extension in {_in(SCAN_PHOTO)} and orientation is not null and orientation <> 1")
def orientation_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.orientation_issues(fx.media(spark, sf_dir)).agg(F.count("*").alias("issues"))


@query("select (select count(*) from mismatch) mismatches, (select count(*) from media) total_checked", MISMATCH)
def date_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dates.date_stats(fx.media(spark, sf_dir))


@query('select category, count(*) as "count", sum(size)::bigint bytes from classified group by category', CLASSIFIED)
def non_photo_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify.non_photo_stats(classify.classify_non_photos(fx.media(spark, sf_dir)))


@query(f"select distinct {BASE.format('directory')} as location from media where not ({BASE.format('directory')} in {_in(SKIP_DIRS)} or starts_with({BASE.format('directory')}, '.'))")
def existing_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.existing_locations(fx.media(spark, sf_dir))


# Renaming and targets

RENAMES = f"""renames as (select file_id, path, filename old_name, nn new_name, directory || '/' || nn new_path from (select *, base || case when count(*) over (partition by directory, base) > 1 then '_' || row_number() over (partition by directory, base order by file_id) else '' end || lower({NAME_SUFFIX}) nn from (select *, {DATE_NAME} base from media where {CAN})))"""


@query("select * from renames", RENAMES)
def rename_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dates.rename_plan(fx.media(spark, sf_dir))


RENAMED = f"""based as (select file_id, path, directory, filename, {DATE_NAME} base, {CAN} can from media),
planned as (select *, case when can then directory || '/' || base || case when count(*) over (partition by can, directory, base) > 1 then '_' || row_number() over (partition by can, directory, base order by file_id) else '' end || lower({NAME_SUFFIX}) end new_path from based),
names as (select file_id, path, new_path, unnest([path, new_path]) a_name, unnest([1, 0]) old from planned),
told as (select *, max(old) over (partition by a_name) there, count(*) filter (old = 0) over (partition by a_name) wanted from names where a_name is not null)"""


@query("select file_id, case when file_id%10=0 then path || '.gone' else path end path, new_path, case when file_id%10=0 then 'Source not found' when there = 1 or wanted > 1 then 'Target already exists' else 'ok' end status from told where old = 0", RENAMED)
def validate_renames(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = fx.media(spark, sf_dir)
    rows = dates.rename_plan(m).select("file_id", F.when(C("file_id") % 10 == 0, F.concat("path", F.lit(".gone"))).otherwise(C("path")).alias("path"), "new_path")
    return plan.validate_renames(rows, m)


def _targets(claims: str) -> tuple[str, ...]:
    """Target allocation over CTE `claims` (file_id, path, dest_dir, name): slots by counting free numbers."""
    number = r"'^(.*)_([1-9]\d{0,8})(\.[^.]+)?$'"
    return (
        f"claims as ({claims})",
        f"cl as (select *, dest_dir || '/' || name full_path, {STEM.format('name')} st, {SUFFIX.format('name')} ext from claims)",
        "rk as (select *, row_number() over (partition by dest_dir, name order by file_id) - 1 + (case when full_path in (select path from media) then 1 else 0 end) k from cl where path <> full_path)",
        "used as (select path p from media union select full_path from rk where k = 0)",
        f"nums as (select distinct {PARENT.format('p')} dest_dir, regexp_extract({BASE.format('p')}, {number}, 1) st, regexp_extract({BASE.format('p')}, {number}, 3) ext, try_cast(regexp_extract({BASE.format('p')}, {number}, 2) as int) t from used)",
        "gaps as (select *, t - row_number() over (partition by dest_dir, st, ext order by t) d from nums where t is not null)",
        "targets as (select file_id, path, dest_dir, name, full_path target from cl where path = full_path union all select file_id, path, dest_dir, name, full_path from rk where k = 0 union all select r.file_id, r.path, r.dest_dir, r.name, r.dest_dir || '/' || r.st || '_' || (r.k + (select count(*) from gaps g where g.dest_dir = r.dest_dir and g.st = r.st and g.ext = r.ext and g.d < r.k)) || r.ext from rk r where k > 0)",
    )


_CLAIMS = f"select file_id, path, directory dest_dir, case when file_id%3=0 then filename when file_id%3=1 then 'IMG' || {NAME_SUFFIX} else 'IMG_' || (file_id%40) || {NAME_SUFFIX} end as name from media"


def _claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    m, i, e = fx.media(spark, sf_dir), C("file_id"), X.suffix(C("filename"))
    name = F.when(i % 3 == 0, C("filename")).when(i % 3 == 1, F.concat(F.lit("IMG"), e)).otherwise(F.concat(F.lit("IMG_"), i % 40, e))
    return m.select("file_id", "path", C("directory").alias("dest_dir"), name.alias("name"))


@query("select * from targets", *_targets(_CLAIMS))
def allocate_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan.allocate_targets(_claims(spark, sf_dir), fx.media(spark, sf_dir))


@query()
def allocate_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan.allocate_targets(_claims(spark, sf_dir), fx.media(spark, sf_dir), ref_compat=True)


@query("select * from targets", CLASSIFIED, *_targets("select file_id, path, '/library/_non_photos/' || category dest_dir, filename as name from classified"))
def move_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = fx.media(spark, sf_dir)
    return plan.move_plan(classify.classify_non_photos(m), m)


# Places

CACHE = "geo_cache as (select printf('%.2f,%.2f', lat, lon) geo_key, arg_min(label, place_id) label from labels2 group by 1)"
CLUSTERS = f"clusters as (select {GEO_KEY} geo_key, count(*) files from media where {HAS_GPS} group by 1)"
NEAREST = f"nearest as (select geo_key, coalesce(arg_min(label, (d, place_id)) filter (d <= 50000), 'Unknown') label from (select geo_key, label, place_id, {_hav("split_part(geo_key, ',', 1)::double", "split_part(geo_key, ',', 2)::double", 'lat', 'lon')} d from clusters, labels2) group by geo_key)"
NAMED = f"named as (select m.*, coalesce(label, 'Unknown') label from media m left join nearest n on n.geo_key = case when {HAS_GPS} then {GEO_KEY} end)"
GEO = (fx.PLACES_SQL, LABELS, CLUSTERS, NEAREST, NAMED)


@query(f"select file_id, path from media where not {HAS_GPS}")
def missing_gps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geo.missing_gps(fx.media(spark, sf_dir)).select("file_id", "path")


@query(f"select file_id from media except select file_id from media where {HAS_GPS}")
def media_minus_gps(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = fx.media(spark, sf_dir)
    return m.select("file_id").exceptAll(m.where(catalog.has_gps()).select("file_id"))


@query("select * from clusters", CLUSTERS)
def location_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geo.location_clusters(fx.media(spark, sf_dir))


@query("select * from geo_cache", fx.PLACES_SQL, LABELS, CACHE)
def geocode_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    cache = geo.geocode_cache(fx.places(spark, sf_dir))
    return geo.merge_cache(cache.where("geo_key like '%0%'"), cache)


@query("select geo_key, files, label, label is null missing from clusters left join geo_cache using (geo_key)", fx.PLACES_SQL, LABELS, CACHE, CLUSTERS)
def geocode_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geo.geocode_lookup(geo.location_clusters(fx.media(spark, sf_dir)), geo.geocode_cache(fx.places(spark, sf_dir)))


@query("select count(*) keys, count(*) filter (label is null) to_query, round(count(*) filter (label is null) * 1.1e0, 1) estimated_s from clusters left join geo_cache using (geo_key)", fx.PLACES_SQL, LABELS, CACHE, CLUSTERS)
def geocode_work(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geo.geocode_work(geocode_lookup(spark, sf_dir))


def _nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geo.nearest_place(geo.location_clusters(fx.media(spark, sf_dir)), fx.places(spark, sf_dir))


def _named(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geo.labelled(fx.media(spark, sf_dir), _nearest(spark, sf_dir))


@query("select * from nearest", *GEO[:4])
def reverse_geocode_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nearest(spark, sf_dir)


@query("select coalesce(label, 'TOTAL') folder, count(*) files from named group by rollup(label)", *GEO)
def folder_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geo.folder_summary(_named(spark, sf_dir))


@query(f"select coalesce(label, 'TOTAL') folder, count(*) files from named where not (label = 'Unknown' and {HAS_GPS}) group by rollup(label)", *GEO)
def folder_summary_compat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geo.folder_summary(_named(spark, sf_dir), ref_compat=True)


@query("select * from targets", *GEO, *_targets("select file_id, path, '/library/' || label dest_dir, filename as name from named where '/library/' || label || '/' || filename <> path"))
def location_move_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan.location_move_plan(_named(spark, sf_dir), fx.media(spark, sf_dir))


BACKFILL = f"backfill as (select m.*, folder, lat, lon from media m join folder_gps on folder = {BASE.format('directory')} where {PARENT.format('directory')} = '/library' and size > 0 and extension in {_in(MEDIA)})"


@query(f"select file_id, path, folder, lat new_lat, lon new_lon from backfill where not {HAS_GPS}", fx.FOLDERS_SQL, BACKFILL)
def gps_backfill_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geo.gps_backfill_plan(fx.media(spark, sf_dir), fx.folder_gps(spark))


@query(f"select folder from folder_gps where folder not in (select {BASE.format('directory')} from media)", fx.FOLDERS_SQL)
def unmapped_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geo.unmapped_folders(fx.media(spark, sf_dir), fx.folder_gps(spark))


@query(f"select coalesce(folder, 'TOTAL') folder, count(*) filter (not {HAS_GPS}) to_write, count(*) filter {HAS_GPS} kept, count(*) filter (not {HAS_GPS}) = 0 all_have from backfill group by rollup(folder)", fx.FOLDERS_SQL, BACKFILL)
def gps_write_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geo.gps_write_summary(fx.media(spark, sf_dir), fx.folder_gps(spark))


@query(f"select file_id, path, coalesce((select arg_min(base_dir, ord) from roots where path = base_dir or starts_with(path, base_dir || '/')), {PARENT.format('path')}) base_dir from media", fx.ROOTS_SQL)
def assign_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geo.assign_base(fx.media(spark, sf_dir), fx.roots(spark))


@query("select file_id, path from media where starts_with(path, '/library/Japan_Tokyo/')")
def access_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geo.access_filter(fx.media(spark, sf_dir), fx.roots(spark).where("ord <> 1")).select("file_id", "path")


# Action plan

PLAN = f"""moves as (select file_id, path, path old_value, category new_value from classified where file_id%2=0),
plan as (select 0 place, 'move-nonphotos' op_key, * from moves
 union all select 1, 'rename-date', file_id, path, old_name, new_name from renames where file_id not in (select file_id from moves)
 union all select 999, 'fix-dates', file_id, path, cast(mtime_s::bigint as varchar), cast(target_s::bigint as varchar) from mismatch where file_id not in (select file_id from moves)
 union all select 999, 'orient-fix', file_id, path, cast(orientation as varchar), '1' from media where extension in {_in(SCAN_PHOTO)} and orientation is not null and orientation <> 1)"""
PLAN_CTES = (CLASSIFIED, RENAMES, MISMATCH, PLAN)


def _findings(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    m = fx.media(spark, sf_dir)
    moves = classify.classify_non_photos(m).where("file_id % 2 = 0").select("file_id", "path", C("path").alias("old_value"), C("category").alias("new_value"))
    renames = dates.rename_plan(m).select("file_id", "path", C("old_name").alias("old_value"), C("new_name").alias("new_value"))
    fixes = dates.date_mismatches(m).select("file_id", "path", C("mtime_s").cast("bigint").alias("old_value"), C("target_s").cast("bigint").alias("new_value"))
    turns = plan.orientation_reset_plan(catalog.orientation_issues(m))
    return {"move-nonphotos": moves, "rename-date": renames, "fix-dates": fixes, "orient-fix": turns}


def _plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan.build_plan(_findings(spark, sf_dir), {"non-photos", "rename", "dates", "orientation"}, order=("move-nonphotos", "rename-date"))


@query("select * from plan", *PLAN_CTES)
def build_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plan(spark, sf_dir)


FULL = """full_plan as (select 3 place, 'move-nonphotos' op_key, file_id, path, path old_value, category new_value from classified where file_id%2=0
 union all select 4, 'rename-date', file_id, path, old_name, new_name from renames where file_id not in (select file_id from moves)
 union all select 5, 'fix-dates', file_id, path, cast(mtime_s::bigint as varchar), cast(target_s::bigint as varchar) from mismatch where file_id not in (select file_id from moves)
 union all select 2, 'orient-fix', file_id, path, old_value, new_value from plan where op_key = 'orient-fix'
 union all select 0, 'dup-trash', file_id, '/in/' || file_id, hash, 'trash' from (select *, row_number() over (partition by hash order by file_id) k from hashed join dups using (hash)) where k > 1
 union all select 1, 'sim-trash', b.file_id, path, cast(group_id as varchar), 'trash' from (select *, row_number() over (partition by group_id order by quality desc nulls last, file_id) k from members) b join media using (file_id) where k > 1)"""


@query("select * from full_plan", *PLAN_CTES, *SIMILAR[:5], HASHED, FULL)
def build_full_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    m, files = fx.media(spark, sf_dir), duplicate_members(spark, sf_dir).withColumn("quality", F.lit(None).cast("bigint")).withColumn("date_raw", F.lit(None).cast("string"))
    copies = dedup.keep_policy(files, "first", group="hash").where("state = 'trash'").select("file_id", F.concat(F.lit("/in/"), "file_id").alias("path"), C("hash").alias("old_value"), F.lit("trash").alias("new_value"))
    shots = dedup.keep_policy(_members(spark, sf_dir)[1], "best").where("state = 'trash'").join(m.select("file_id", "path"), "file_id").select("file_id", "path", C("group_id").alias("old_value"), F.lit("trash").alias("new_value"))
    return plan.build_plan({"dup-trash": copies, "sim-trash": shots, **_findings(spark, sf_dir)}, set(plan.CATEGORY_OF.values()))


SQL["build_full_plan"] = _recursive(SQL["build_full_plan"])


@query("select op_key, count(*) files, sum(size)::bigint bytes from plan join media using (file_id) group by op_key", *PLAN_CTES)
def plan_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan.plan_summary(_plan(spark, sf_dir), fx.media(spark, sf_dir))


@query("select file_id, new_path from renames where file_id not in (select file_id from classified)", CLASSIFIED, RENAMES)
def plan_minus_moved(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = fx.media(spark, sf_dir)
    return plan.plan_minus_moved(dates.rename_plan(m), classify.classify_non_photos(m)).select("file_id", "new_path")


@query("select file_id request_id, case when file_id%9=0 then path || 'x' else path end path, case when file_id%9=0 then 'File not found' else 'ok' end status from media")
def resolve_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = fx.media(spark, sf_dir)
    return plan.resolve_sources(m.select(C("file_id").alias("request_id"), F.when(C("file_id") % 9 == 0, F.concat("path", F.lit("x"))).otherwise(C("path")).alias("path")), m)


@query("select op_key, count(*) filter (file_id%9<>0) success_count, count(*) filter (file_id%9=0) failed_count from plan group by op_key", *PLAN_CTES)
def action_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan.action_result(_plan(spark, sf_dir).withColumn("status", F.when(C("file_id") % 9 == 0, "File not found").otherwise("ok")))


@query("select op_key, file_id, path, file_id%9<>0 success, case when file_id%9=0 then 'File not found' end error from plan", *PLAN_CTES)
def action_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan.action_outcomes(_plan(spark, sf_dir).withColumn("status", F.when(C("file_id") % 9 == 0, "File not found").otherwise("ok")))


@query("select 'similar' category, state, count(*) files, sum(media.size)::bigint bytes from (select file_id, case when row_number() over (partition by group_id order by quality desc nulls last, file_id) = 1 then 'keep' else 'trash' end state from members) join media using (file_id) group by state", *SIMILAR[:5])
def review_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan.review_stats(dedup.keep_policy(_members(spark, sf_dir)[1], "best"), fx.media(spark, sf_dir), "similar")


SQL["review_stats"] = _recursive(SQL["review_stats"])


@query("select file_id, path, mtime_s old_s, case when file_id%10<>0 then floor(target_s) end new_s, case when file_id%10=0 then 'Invalid date' else 'ok' end status from mismatch", MISMATCH)
def date_fix_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = dates.date_mismatches(fx.media(spark, sf_dir))
    text = F.date_format(F.timestamp_seconds(F.floor("target_s")), "yyyy-MM-dd'T'HH:mm:ssXXX")
    return plan.date_fix_plan(rows.withColumn("target_date", F.when(C("file_id") % 10 == 0, "soon").otherwise(text)))


@query(f"select file_id, path, cast(orientation as varchar) old_value, '1' new_value from media where extension in {_in(SCAN_PHOTO)} and orientation is not null and orientation <> 1")
def orientation_reset_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan.orientation_reset_plan(catalog.orientation_issues(fx.media(spark, sf_dir)))


# Ledger

FLAT = 'flat as (select session_id, printf(\'2024-01-%02dT%02d:00:00\', session_id % 28 + 1, session_id % 24) as "timestamp", session_id % 5 = 0 undone, (row_number() over (partition by session_id order by file_id) - 1)::int pos, "type", file, old_value, new_value from ops)'


@query(f"select session_id, pos, \"type\", file, old_value, new_value, case \"type\" when 'TRASH' then 'Moved to trash: ' || {BASE.format('file')} when 'RENAME' then 'Renamed: ' || {BASE.format('old_value')} || ' -> ' || {BASE.format('new_value')} when 'MOVE' then 'Moved: ' || {BASE.format('old_value')} || ' -> ' || {BASE.format('new_value')} else case \"type\" when 'ORIENTATION' then 'Orientation' when 'DATE_FIX' then 'Date Fix' when 'GPS' then 'Gps' else 'Convert' end || ': ' || coalesce(old_value, 'none') || ' -> ' || coalesce(new_value, 'none') end detail from flat", fx.OPS_SQL, FLAT)
def ledger_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.ledger_append(fx.operations(spark, sf_dir))


@query("select * from flat", fx.OPS_SQL, FLAT)
def ledger_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.ledger_flatten(fx.sessions(spark, sf_dir)).drop("detail")


@query('select root, session_id, "timestamp", n operations, undone, (row_number() over (order by "timestamp" desc, root, session_id) - 1)::int as "index" from (select case when session_id%2=0 then \'/library\' else \'/lib\' end root, session_id, "timestamp", count(*)::int n, bool_or(undone) undone from flat group by all)', fx.OPS_SQL, FLAT)
def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = fx.sessions(spark, sf_dir).select("session_id", "timestamp", F.size("operations").alias("operations"), "undone")
    parts = (s.where(C("session_id") % 2 == k).withColumn("root", F.lit(r)) for k, r in ((0, "/library"), (1, "/lib")))
    return ledger.history(*parts)


UNDO = """case "type" when 'TRASH' then 'manual' when 'RENAME' then case when there then 'move back' else 'File not found' end when 'MOVE' then case when there then 'move back' else 'File not found' end
 when 'GPS' then case when o = '' then 'remove GPS' else 'restore GPS' end when 'ORIENTATION' then case when o = '' then 'No old value' else 'restore orientation' end
 when 'DATE_FIX' then case when o = '' then 'No old value' when there then 'restore date' else 'File not found' end when 'CONVERT' then case when there then 'trash converted' else 'File not found' end else 'Unknown operation type' end"""


UNDO_ROWS = "select session_id, (row_number() over (partition by session_id order by pos desc))::int step, pos, \"type\", src as \"source\", old_value target, @UNDO@ as \"action\", @UNDO@ in ('move back', 'remove GPS', 'restore GPS', 'restore orientation', 'restore date', 'trash converted') success, try_cast(split_part(nullif(case when \"type\" = 'GPS' then o end, ''), ',', 1) as double) lat, try_cast(split_part(nullif(case when \"type\" = 'GPS' then o end, ''), ',', 2) as double) lon from (select *, src in (select path from media) there, coalesce(old_value, '') o from (select *, case when \"type\" in ('RENAME', 'MOVE', 'CONVERT') then new_value else file end src from flat where not undone))"


@query(UNDO_ROWS.replace("@UNDO@", UNDO), fx.OPS_SQL, FLAT)
def undo_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.undo_plan(ledger.ledger_flatten(fx.sessions(spark, sf_dir)), fx.media(spark, sf_dir))


@query(UNDO_ROWS.replace("@UNDO@", UNDO.replace("when 'MOVE' then case when there then 'move back' else 'File not found' end", "")), fx.OPS_SQL, FLAT)
def undo_plan_compat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.undo_plan(ledger.ledger_flatten(fx.sessions(spark, sf_dir)), fx.media(spark, sf_dir), ref_compat=True)


@query("select session_id, undone or session_id = 1 undone, case when session_id = 1 then '2024-02-01T00:00:00' end undone_at from (select distinct session_id, undone from flat)", fx.OPS_SQL, FLAT)
def mark_undone(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.mark_undone(fx.sessions(spark, sf_dir), 1, "2024-02-01T00:00:00").select("session_id", "undone", "undone_at")


# Streams


RAW_DATE = "case when event_id%5 = 0 then null else strftime(ts, '%Y:%m:%d %H:%M:%S') end"


@query(f"select event_id file_id, '/in/' || user_id || '/' || event_type || '_' || event_id || '.JPG' path, event_type || '_' || event_id || '.JPG' filename, '.jpg' extension, case when event_id%4 = 0 then 0 else event_id * 10 end size, {RAW_DATE} date_raw, case when event_id%3 > 0 then (event_id%90)::double end gps_lat, case when event_id%3 > 0 then (event_id%180)::double end gps_lon, (event_id%9)::int orientation, '/in/' || user_id directory from events")
def ingest_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .streaming import streams

    i, none, text = C("event_id"), F.lit(None).cast("string"), lambda c: c.cast("string")
    folder, name = F.concat(F.lit("/in/"), "user_id"), F.concat("event_type", F.lit("_"), "event_id", F.lit(".JPG"))
    date = F.when(i % 5 != 0, F.date_format("ts", "yyyy:MM:dd HH:mm:ss"))
    raw = streams.read_events(spark, sf_dir).select(i.alias("file_id"), F.concat(folder, F.lit("/"), name).alias("SourceFile"), F.when(i % 2 == 0, "").alias("FileName"), F.when(i % 4 > 0, text(i * 10)).otherwise("large").alias("FileSize"), F.when(i % 7 == 0, date).alias("DateTimeOriginal"), date.alias("CreateDate"), none.alias("FileModifyDate"), F.when(i % 3 > 0, text(i % 90)).alias("GPSLatitude"), F.when(i % 3 > 0, text(i % 180)).alias("GPSLongitude"), text(i % 9).alias("Orientation"), *(none.alias(c) for c in ("ImageWidth", "ImageHeight", "CompressorID", "VideoCodecID", "CompressorName", "Duration", "MIMEType")), folder.alias("Directory"))
    rows = streams.run_available(streams.ingest(raw), shared_dir(spark))
    return rows.select("file_id", "path", "filename", "extension", "size", "date_raw", "gps_lat", "gps_lon", "orientation", "directory")


@query("select distinct md5(props) hash from events")
def dedup_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .streaming import streams

    files = streams.read_events(spark, sf_dir).withColumn("hash", F.md5("props"))
    return streams.run_available(streams.distinct_values(files, "hash").select("hash"), shared_dir(spark))


_KEY = "md5(user_id || ':' || event_type || ':' || (event_id % 50))"


@query(f"select distinct {_KEY} hash from events where {_KEY} not in (select {_KEY} from events where event_id % 3 = 0 and event_id % 50 < 20)")
def dedup_against_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .streaming import streams

    key = lambda rows: rows.select("event_id", F.md5(F.concat_ws(":", "user_id", "event_type", C("event_id") % 50)).alias("hash"))
    at = f"{shared_dir(spark)}/index-{uuid.uuid4().hex}"
    known = key(spark.read.parquet(f"{sf_dir}/events.parquet").where("event_id % 3 = 0 and event_id % 50 < 20"))
    before = streams.add_known(known, f"{at}/index", "hash")
    streams.dedup_against(key(streams.read_events(spark, sf_dir)), f"{at}/index", "hash", f"{at}/checkpoint").awaitTermination()
    schema = "event_id bigint, hash string"
    return streams.arrivals(spark, f"{at}/index", schema).join(versions.read(spark, f"{at}/index", schema, before), "hash", "left_anti").select("hash")


_SCANS = "select file_id, path || '#' || file_id path, size, file_id % 4 > 0 one, file_id % 5 > 0 two, size + 1 other, file_id % 7 = 0 odd from media"


@query(f"""select path, kind, case when kind = 'deleted' and odd and version = 3 then other when kind <> 'deleted' and version = 2 and odd then other else size end size, version from (
 select *, unnest([1, 2, 3]) version, unnest([case when one then 'added' end,
  case when one and not two then 'deleted' when two and not one then 'added' when one and two and odd then 'changed' end,
  case when not two then 'added' when odd then 'changed' end]) kind from ({_SCANS})) where kind is not null""")
def catalog_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .streaming import streams

    i, rows = C("file_id"), fx.media(spark, sf_dir).select("file_id", F.concat("path", F.lit("#"), "file_id").alias("path"), "size", "mtime")
    second = rows.where(i % 5 > 0).withColumn("size", F.when(i % 7 == 0, C("size") + 1).otherwise(C("size")))
    table = f"{shared_dir(spark)}/changes-{uuid.uuid4().hex}"
    for scan in (rows.where(i % 4 > 0), second, rows):
        streams.capture(scan, table)
    return versions.read(spark, table, streams.CHANGES).select("path", "kind", "size", C("at").alias("version"))


@query("select user_id, count(*) shots, min(us) start_us, max(us) end_us from (select *, sum(brk) over (partition by user_id order by us rows unbounded preceding) k from (select user_id, epoch_us(ts) us, case when epoch_us(ts) - lag(epoch_us(ts)) over (partition by user_id order by ts) <= 600000000 then 0 else 1 end brk from events)) group by user_id, k")
def burst_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .streaming import streams

    return streams.run_available(streams.burst_sessions(streams.read_events(spark, sf_dir), gap_s=600), shared_dir(spark), "complete")
