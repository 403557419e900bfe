"""A media catalog over the test tables `events` and `embeddings`, for Spark and, as SQL text, for DuckDB."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .sources import store
from .storage import exists, on_workers, shared_dir, written

_TEMPLATE = """
e as (select event_id id, user_id, date_trunc('hour', ts) hr from {events}),
v as (select vec_id, {bits} b from {embeddings}),
c as (select id, user_id, {cap} cap from e),
s as (select *, {f:cap|ymd} d8, {f:cap|hms} t6, {f:cap|exif} ex, {f:cap|day} dd, {f:cap|dash} td, {f:cap|dot} tp,
  case user_id%6 when 0 then 'Unknown' when 1 then 'Example City' when 2 then 'Japan_Tokyo' when 3 then 'France_Paris' when 4 then 'USA_NewYork' else '.previews' end album,
  case when id%24=23 then '.heif' when id%36=18 then '.bmp' else case id%12 when 5 then '.JPG' when 6 then '.jpeg' when 7 then '.heic' when 8 then '.png' when 9 then '.mov' when 10 then '.mp4' when 11 then '.txt' else '.jpg' end end ext from c),
f as (select *, case id%11 when 0 then concat('IMG_',id) when 1 then concat(d8,'_',t6) when 2 then concat('Screenshot_',d8,'-',t6) when 3 then concat('RPReplay_Final',id)
  when 4 then concat('IMG-',d8,'-WA',id) when 5 then concat('scan_',id) when 6 then concat('photo_',dd,'_',td) when 7 then concat('receipt ',id) when 8 then concat('DSC',id)
  when 9 then concat('Screen Recording ',dd,' at ',tp) else concat('mmexport',1705312000000+id) end stem from s),
media as {once}(select id file_id, concat('/library/',album,'/',stem,ext) path, concat(stem,ext) filename, lower(ext) extension,
 case when id%50=0 then cast(0 as bigint) else cast((1000+(id*7919)%5000000)*(case when id%12 in (9,10) then 100 else 1 end) as bigint) end size,
 case when id%13<=6 then ex when id%13<=8 then concat(ex,'+08:00') when id%13=9 then concat(dd,'T',{f:cap|clock}) when id%13=11 then 'bad' when id%13=12 then concat(dd,' ',{f:cap|clock}) else null end date_raw,
 case when id%26=10 then {epoch} else null end date_epoch,
 {mtime} mtime,
 case when id%7=0 then null else cast((user_id%8)*10 as double)+(id%40)*0.001e0+0.0003e0 end gps_lat,
 case when id%7=0 then null else cast((user_id%8)*15-60 as double)+(id%40)*0.001e0+0.0003e0 end gps_lon,
 cast(case when id%97=0 then 9 when id%9=0 then null else id%9 end as int) orientation,
 cast(case id%5 when 0 then 1170 when 1 then 1920 when 2 then 4032 when 4 then 640 else null end as int) width,
 cast(case id%5 when 0 then 2532 when 1 then 1080 when 2 then 3024 when 4 then 1136 else null end as int) height,
 case when id%12 in (9,10) then (case ({id_div_12})%3 when 0 then 'hvc1' when 1 then 'avc1' else 'ap4h' end) end codec,
 concat('/library/',album) directory,
 concat(translate(substr(v.b,1,cast((id%4)*5 as int)),'01','10'), substr(v.b,cast((id%4)*5+1 as int))) phash_bits, cap
 from (select *, ({id_div_4}) % {vectors} vec from f) f join v on v.vec_id = f.vec)"""

_FORMS = {
    "spark": {"ymd": "yyyyMMdd", "hms": "HHmmss", "exif": "yyyy:MM:dd HH:mm:ss", "day": "yyyy-MM-dd", "dash": "HH-mm-ss", "dot": "HH.mm.ss", "clock": "HH:mm:ss"},
    "duck": {"ymd": "%Y%m%d", "hms": "%H%M%S", "exif": "%Y:%m:%d %H:%M:%S", "day": "%Y-%m-%d", "dash": "%H-%M-%S", "dot": "%H.%M.%S", "clock": "%H:%M:%S"},
}


def _media(kind: str, events: str, embeddings: str, vectors: int | str) -> str:
    text, spark = _TEMPLATE, kind == "spark"
    for name, form in _FORMS[kind].items():
        text = text.replace(f"{{f:cap|{name}}}", f"{'date_format' if spark else 'strftime'}(cap,'{form}')")
    n, m = "cast(case when ({id_div_4})%3=0 then id%3 else (id*7)%60 end as int)", "cast(case when id%17<=5 then 0 when id%17<=9 then 2 when id%17<=13 then 3 else 86400 end as int)"
    put = {
        "cap": f"timestampadd(SECOND, {n}, hr)" if spark else f"(hr + to_seconds({n}))",
        "mtime": f"timestampadd(SECOND, {m}, cap)" if spark else f"(cap + to_seconds({m}))",
        "epoch": "cast(unix_timestamp(cap) as double)" if spark else "epoch(cap)::double",
        "bits": "array_join(transform(embedding, x -> case when x>0 then '1' else '0' end),'')" if spark else "array_to_string(list_transform(embedding, lambda x: case when x>0 then '1' else '0' end),'')",
        "once": "" if spark else "materialized ", "id_div_12": "id div 12" if spark else "id // 12", "events": events, "embeddings": embeddings, "vectors": str(vectors),
    }
    for name, value in put.items():
        text = text.replace(f"{{{name}}}", value)
    return text.replace("{id_div_4}", "id div 4" if spark else "id // 4")


#: CTEs for DuckDB: start a query with "with " + MEDIA_SQL.
MEDIA_SQL = _media("duck", "events", "embeddings", "(select count(*) from embeddings)")

PLACES_SQL = """
places as (select n_nationkey place_id, (n_nationkey%8)*10 + 0.02e0 + 0.01e0*(n_nationkey // 8) lat, (n_nationkey%8)*15 - 60 + 0.02e0 lon,
  case when n_nationkey%4=1 then '' else n_name end city, case when n_nationkey%4=1 then n_name || ' Town' end town, null::varchar county, null::varchar state,
  r_name country, lower(substr(r_name,1,2)) country_code from nation join region on n_regionkey = r_regionkey where n_nationkey % 8 <> 7)"""
FOLDERS_SQL = "folder_gps(folder, lat, lon) as (values ('Example City', 25.0330e0, 121.5654e0), ('Japan_Tokyo', 35.6762e0, 139.6503e0), ('France_Paris', 48.8566e0, 2.3522e0), ('USA_NewYork', 40.7128e0, -74.0060e0), ('Nowhere', 0e0, 0e0))"
ROOTS_SQL = "roots(ord, base_dir) as (values (0, '/library/Japan_Tokyo'), (1, '/library'), (2, '/lib'))"


_WRITTEN: dict[tuple[str, str], DataFrame] = {}
_FOLDERS: dict[tuple[str, str], str] = {}


def media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalog, derived from the tables once in each session and read back from the shared folder, as a catalog is."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _WRITTEN or not exists(spark, _WRITTEN[key].inputFiles()[0].rsplit("/", 1)[0]):
        _WRITTEN[key] = written(derived(spark, sf_dir), "catalog")
    return _WRITTEN[key]


def document_files(spark: SparkSession, sf_dir: str) -> str:
    """A folder with one file for each document that has a text, written by the executors once in each session."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _FOLDERS or not exists(spark, _FOLDERS[key]):
        on_workers(spark)
        at = f"{shared_dir(spark)}/files-{uuid.uuid4().hex}"

        def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                    store.put(f"{at}/{doc_id % 64}/{doc_id}.txt", text.encode())
                yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], ["n"])

        docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("text is not null and doc_id is not null").select("doc_id", "text")
        docs.mapInArrow(put, "n long").agg(F.sum("n")).collect()
        _FOLDERS[key] = at
    return _FOLDERS[key]


def derived(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").count()
    sql = _media("spark", f"parquet.`{sf_dir}/events.parquet`", f"parquet.`{sf_dir}/embeddings.parquet`", vectors)
    return spark.sql(f"with {sql} select * from media")


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, r = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("nation", "region"))
    k = F.col("n_nationkey")
    rows = n.join(r, n["n_regionkey"] == r["r_regionkey"]).where(k % 8 != 7)
    odd = k % 4 == 1
    return rows.select(
        k.alias("place_id"), ((k % 8) * 10 + F.lit(0.02) + F.lit(0.01) * F.floor(k / 8)).alias("lat"), ((k % 8) * 15 - 60 + F.lit(0.02)).alias("lon"), F.when(odd, "").otherwise(F.col("n_name")).alias("city"),
        F.when(odd, F.concat("n_name", F.lit(" Town"))).alias("town"), F.lit(None).cast("string").alias("county"), F.lit(None).cast("string").alias("state"), F.col("r_name").alias("country"), F.lower(F.substring("r_name", 1, 2)).alias("country_code"),
    )


def folder_gps(spark: SparkSession) -> DataFrame:
    rows = [("Example City", 25.0330, 121.5654), ("Japan_Tokyo", 35.6762, 139.6503), ("France_Paris", 48.8566, 2.3522), ("USA_NewYork", 40.7128, -74.0060), ("Nowhere", 0.0, 0.0)]
    return spark.createDataFrame(rows, "folder string, lat double, lon double")


def roots(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(0, "/library/Japan_Tokyo"), (1, "/library"), (2, "/lib")], "ord int, base_dir string")


OPS_SQL = """
ops as (select cast(file_id // 100 as int) session_id, file_id, case file_id%7 when 0 then 'TRASH' when 1 then 'RENAME' when 2 then 'ORIENTATION' when 3 then 'MOVE' when 4 then 'DATE_FIX' when 5 then 'GPS' else 'CONVERT' end "type", path file,
  case file_id%7 when 0 then null when 1 then directory || '/old_' || filename when 2 then cast(orientation as varchar) when 3 then '/library/in/' || filename when 4 then date_raw when 5 then case when file_id%2=0 then '1.5,2.5' end else null end old_value,
  case file_id%7 when 0 then null when 1 then path when 2 then '1' when 3 then path when 4 then 'x' when 5 then '3.5,4.5' else case when file_id%3=0 then path else path || '.mp4' end end new_value from media)"""


def operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operation rows made from the catalog: hundred files per session, seven types by turns."""
    m, t = media(spark, sf_dir), F.col("file_id") % 7
    kind = F.element_at(F.array(*(F.lit(x) for x in ("TRASH", "RENAME", "ORIENTATION", "MOVE", "DATE_FIX", "GPS", "CONVERT"))), (t + 1).cast("int"))
    old = F.when(t == 1, F.concat("directory", F.lit("/old_"), "filename")).when(t == 2, F.col("orientation").cast("string")).when(t == 3, F.concat(F.lit("/library/in/"), "filename")).when(t == 4, F.col("date_raw")).when((t == 5) & (F.col("file_id") % 2 == 0), "1.5,2.5")
    new = F.when(t.isin(1, 3), F.col("path")).when(t == 2, "1").when(t == 4, "x").when(t == 5, "3.5,4.5").when(t == 6, F.when(F.col("file_id") % 3 == 0, F.col("path")).otherwise(F.concat("path", F.lit(".mp4"))))
    return m.select(F.floor(F.col("file_id") / 100).cast("int").alias("session_id"), "file_id", kind.alias("type"), F.col("path").alias("file"), old.alias("old_value"), new.alias("new_value"))


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested sessions of these operations (a session holds what one user did at a time: a hundred here)."""
    ops = operations(spark, sf_dir)
    item = F.struct("file_id", "type", "file", "old_value", "new_value", F.lit("").alias("detail"))
    rows = ops.groupBy("session_id").agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: x.dropFields("file_id")).alias("operations"))
    s = F.col("session_id")
    return rows.select(s, F.format_string("2024-01-%02dT%02d:00:00", s % 28 + 1, s % 24).alias("timestamp"), "operations", (s % 5 == 0).alias("undone"), F.lit(None).cast("string").alias("undone_at"))
