"""Streaming forms: incremental ingest, de-duplication on arrival, and burst sessions."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import versions
from ..operators.catalog import normalize_media
from ..params import DEFAULTS
from ..storage import written

EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def read_events(spark: SparkSession, sf_dir: str, files: int = 4) -> DataFrame:
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files).parquet(f"{sf_dir}/events.parquet*").withColumn("ts", F.col("ts").cast("timestamp"))


def ingest(raw: DataFrame) -> DataFrame:
    """Catalog rows of arriving raw metadata rows, as in a batch."""
    return normalize_media(raw)


def distinct_values(events: DataFrame, key: str, late: str | None = None) -> DataFrame:
    """One row of each key; with `late`, state is forgotten after that time, and late rows are lost and keys may return."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key]) if late else events.dropDuplicates([key])


#: Folders that an index of digests is dealt to by a hash, so that a batch reads those it needs.
BUCKETS = 64


def _bucketed(rows: DataFrame, key: str) -> DataFrame:
    return rows.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int"))


def add_known(rows: DataFrame, index: str, key: str) -> int:
    """Puts rows of a catalog, one of each key, into an index before a stream begins; returns its version."""
    return versions.append(_bucketed(rows.dropDuplicates([key]), key), index, rows.sparkSession, by=("bucket",))


def arrivals(spark: SparkSession, index: str, schema: str) -> DataFrame:
    """All rows of an index."""
    return versions.read(spark, index, f"{schema}, bucket int").drop("bucket")


def dedup_batch(batch: DataFrame, turn: int, index: str, key: str, name: str) -> int:
    """Adds to an index one row of each key of a batch that it lacks: the version, or 0 if this turn was added before.

    Keys are compared with those of the folders that the batch needs only.  If another stream commits between, the batch is
    compared again, so a key is never there twice.
    """
    spark = batch.sparkSession
    if versions.manifest(spark, index, versions.latest(spark, index))["writers"].get(name, -1) >= turn:
        return 0
    rows = written(_bucketed(batch.dropDuplicates([key]), key), "arrived")
    needed = [r["bucket"] for r in rows.select("bucket").distinct().collect()]  # BUCKETS values at most
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)

    def fresh(version: int) -> DataFrame:
        known = versions.read(spark, index, schema, version).where(F.col("bucket").isin(needed)).select(key)
        return rows.join(known, key, "left_anti").select(rows.columns)

    return versions.append(fresh, index, spark, writer=name, turn=turn, by=("bucket",))


def dedup_against(stream: DataFrame, index: str, key: str, checkpoint: str, name: str = "stream"):
    """A stream's rows into an index, one of each key that neither the catalog nor any batch before had; state is the index.

    Each batch is committed with its number, so a restart in the middle of one adds nothing twice.  Null keys count as one
    key that is never known, so each batch adds one such row at most.
    """
    out = stream.writeStream.foreachBatch(lambda batch, turn: dedup_batch(batch, turn, index, key, name) and None)
    return out.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def compact(spark: SparkSession, index: str, schema: str) -> int:
    """One folder of rows instead of one a batch; streams may go on meanwhile."""
    return versions.replace(lambda rows: rows, index, f"{schema}, bucket int", spark, by=("bucket",))


def current(changes: DataFrame) -> DataFrame:
    """The files that are there after all changes (path, size, mtime, kind, at): of each path the last one, unless deleted."""
    last = changes.groupBy("path").agg(F.max_by(F.struct("size", "mtime", "kind"), "at").alias("r"))
    return last.where("r.kind <> 'deleted'").select("path", "r.size", "r.mtime")


def changes(known: DataFrame, listing: DataFrame, whole: bool = True) -> DataFrame:
    """path, size, mtime, kind of what a listing has added or changed (by size and mtime) against known files.

    If it is a whole one, files that it lacks are `deleted`; null paths are left out, of a path twice one row counts.
    """
    c, new = F.col, listing.where("path is not null").groupBy("path").agg(F.max(F.struct("size", "mtime")).alias("_new"))
    both = known.select("path", F.struct("size", "mtime").alias("_old")).join(new, "path", "full" if whole else "right")
    kind = F.when(c("_old").isNull(), "added").when(c("_new").isNull(), "deleted").when(~c("_old").eqNullSafe(c("_new")), "changed")
    rows = both.select("path", F.coalesce("_new", "_old").alias("_r"), kind.alias("kind")).where("kind is not null")
    return rows.select("path", "_r.size", "_r.mtime", "kind")


CHANGES = "path string, size long, mtime timestamp, kind string, at int"


def capture(listing: DataFrame, table: str, whole: bool = True, writer: str | None = None, turn: int = 0) -> int:
    """Adds to a versioned table what a listing changes, with the version as `at`; `current` of it is the catalog then.

    Rows of files that are as they were aren't written again.  `writer` and `turn` are those of a stream's batch.
    """
    spark = listing.sparkSession

    def changed(version: int) -> DataFrame:
        known = current(versions.read(spark, table, CHANGES, version))
        rows = changes(known, listing.select("path", F.col("size").cast("long").alias("size"), F.col("mtime").cast("timestamp").alias("mtime")), whole)
        return rows.withColumn("at", F.lit(version + 1).cast("int"))

    return versions.append(changed, table, spark, writer=writer, turn=turn)


def fold(spark: SparkSession, table: str) -> int:
    """A new version of such a table with one row a file that is there; the history before stays in older versions."""
    return versions.replace(lambda rows: current(rows).withColumn("kind", F.lit("added")).withColumn("at", F.lit(0).cast("int")), table, CHANGES, spark)


def burst_sessions(events: DataFrame, gap_s: int = DEFAULTS.burst_gap_s, late: str | None = None) -> DataFrame:
    """Chains of shots of an album whose gaps are at most `gap_s`.

    A stream without `late` keeps all sessions and runs in complete mode; with it, rows later than that are lost.
    """
    rows = events.withWatermark("ts", late) if events.isStreaming and late else events
    w = rows.groupBy(F.session_window("ts", f"{gap_s} seconds").alias("w"), "user_id").agg(F.count("*").alias("shots"), F.min("ts").alias("a"), F.max("ts").alias("b"))
    return w.select("user_id", "shots", F.unix_micros("a").alias("start_us"), F.unix_micros("b").alias("end_us"))


def run_available(df: DataFrame, where: str, mode: str = "append") -> DataFrame:
    """What the stream gives for all that is there now, from a table in `where`."""
    spark, at = df.sparkSession, f"{where.rstrip('/')}/stream-{uuid.uuid4().hex}"
    out = df.writeStream.outputMode(mode).option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True)
    if mode == "append":
        query = out.format("parquet").option("path", f"{at}/rows").start()
    else:
        query = out.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(f"{at}/rows")).start()
    query.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{at}/rows")
