"""Exact duplicates by content, and which copy to keep."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources import store
from ..storage import on_workers, written


def hashed(files: DataFrame, content: str = "content", size: Column | None = None) -> DataFrame:
    """file_id, size, hash of all files but empty ones.  Content is read and hashed where it lies; only this goes on."""
    rows = files.withColumn("size", size) if size is not None else files
    return rows.where(F.col("size") > 0).select("file_id", "size", F.md5(F.col(content)).alias("hash"))


def _groups(rows: DataFrame) -> DataFrame:
    return rows.groupBy("size", "hash").agg(F.count("*").alias("count"), F.min("file_id").alias("first_id")).where("count > 1")


def duplicate_members(files: DataFrame, content: str = "content", size: Column | None = None) -> DataFrame:
    """file_id, size, hash, count of all files whose size and content others have too."""
    rows = written(hashed(files, content, size), "hashed")
    return rows.join(_groups(rows).drop("first_id"), ["size", "hash"]).select("file_id", "size", "hash", "count")


def exact_duplicates(files: DataFrame, content: str = "content", size: Column | None = None) -> DataFrame:
    """hash, count, size, first_id and wasted bytes of each group of files with equal content."""
    return _groups(hashed(files, content, size)).select("hash", "count", "size", "first_id", (F.col("size") * (F.col("count") - 1)).alias("wasted_size"))


#: Bytes at either end of a file that its first digest is of, and bytes read at once.
ENDS, CHUNK = 4096, 1 << 20

_DIGESTS = pa.schema([("file_id", pa.int64()), ("path", pa.string()), ("size", pa.int64()), ("digest", pa.string()), ("whole", pa.bool_()), ("read_bytes", pa.int64()), ("error", pa.string())])


def _digest(path: str, size: int, whole: bool) -> tuple[str, bool, int]:
    """Digest of a file, or of its two ends, whether that was all of it, and the bytes that were read."""
    whole, n, md5 = whole or size <= 2 * ENDS, 0, hashlib.md5()
    with store.opened(path) as f:
        if whole:
            while part := f.read(CHUNK):
                md5.update(part)
                n += len(part)
        else:
            for at in (0, size - ENDS):
                f.seek(at)
                part = f.read(ENDS)
                md5.update(part)
                n += len(part)
    if whole and n != size:
        raise OSError(f"{n} bytes where the listing says {size}")
    return md5.hexdigest(), whole, n


def digests(files: DataFrame, whole: bool, at_once: int = 256) -> DataFrame:
    """file_id, path, size, digest, whole, read_bytes, error of files (file_id, path, size), opened where tasks run.

    With `whole` all bytes are read, else only the ends of files that are longer than both.  A file that can't be read, or
    that no longer has its size, has a null digest and an error.  Tasks have about `at_once` files each.
    """
    on_workers(files.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for file_id, path, size in zip(*(batch.column(c).to_pylist() for c in ("file_id", "path", "size"))):
                try:
                    out.append((file_id, path, size, *_digest(path, size, whole), None))
                except OSError as e:
                    out.append((file_id, path, size, None, None, 0, str(e)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out), _DIGESTS)], schema=_DIGESTS)

    rows = written(files.select("file_id", "path", "size"), "to-read")
    tasks = max(1, -(-rows.count() // at_once))
    return rows.repartition(tasks).mapInArrow(run, "file_id long, path string, size long, digest string, whole boolean, read_bytes long, error string")


def _shared(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows whose keys others have too.  Counts are written first, so that Spark can split the join where a key is hot."""
    many = written(rows.groupBy(*keys).count().where("count > 1").select(*keys), "shared")
    return rows.join(many, list(keys), "left_semi")


def file_hashes(listing: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Digests of the ends, then of the whole, of files (file_id, path, size) that may have a copy: two written tables.

    Files of a size that no other has are never opened, nor are empty ones; of the rest only the ends are read, and the
    whole of those alone whose size and ends others share.
    """
    nonempty = written(listing.where("size > 0").select("file_id", "path", "size"), "nonempty")
    ends = written(digests(_shared(nonempty, "size"), whole=False), "ends")
    alike = _shared(ends.where("digest is not null"), "size", "digest")
    return ends, written(alike.where("whole").unionByName(digests(alike.where("not whole"), whole=True)), "whole")


def file_duplicates(listing: DataFrame) -> DataFrame:
    """file_id, path, size, hash, count of all files whose whole content others have too; see `file_hashes`.

    Paths are opened by tasks; what can't be read has no copies.  Repeated rows of one path count as copies of each other,
    an empty listing gives no rows.
    """
    rows = file_hashes(listing)[1].where("digest is not null").select("file_id", "path", "size", F.col("digest").alias("hash"))
    groups = written(rows.groupBy("size", "hash").agg(F.count("*").alias("count")).where("count > 1"), "groups")
    return rows.join(groups, ["size", "hash"]).select("file_id", "path", "size", "hash", "count")


def duplicate_stats(groups: DataFrame) -> DataFrame:
    return groups.agg(F.count("*").alias("groups"), F.coalesce(F.sum("count"), F.lit(0)).alias("total_duplicates"), F.coalesce(F.sum("wasted_size"), F.lit(0)).alias("wasted_size"))


def keep_policy(members: DataFrame, policy: str, group: str = "group_id") -> DataFrame:
    """keep, trash or neutral for each member; members have file_id, size, date_raw, quality.

    Ties go to the smallest file_id; `newest` compares date texts, and without any date the first is kept.
    """
    first = F.col("file_id").asc()
    order = {"first": [first], "largest": [F.col("size").desc_nulls_last(), first], "newest": [F.coalesce("date_raw", F.lit("")).desc(), first], "best": [F.col("quality").desc_nulls_last(), first]}
    if policy == "clear":
        return members.select(group, "file_id", F.lit("neutral").alias("state"))
    if policy not in order:
        raise ValueError(f"unknown policy {policy}")
    rank = F.row_number().over(Window.partitionBy(group).orderBy(*order[policy]))
    return members.select(group, "file_id", F.when(rank == 1, "keep").otherwise("trash").alias("state"))
