"""Listing a tree of any size on the executors, in rounds over a table of what is still to be visited.

A round visits folders to list and files to look up, dealt evenly to tasks.  Each task goes on into the folders it finds
until it has seen so many entries for one item, and leaves the others to the next round, so a small tree takes one round,
a large one is soon dealt to all tasks, and a deep one takes a round for so many levels.  One folder of very many files is
read by one task, entry by entry, but their sizes and times are looked up by all tasks in the next round.  The driver
only counts what is left to visit.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import on_workers, shared_dir
from . import store

#: Entries that a task sees for one item before it leaves the folders it found to the next round, and of them those
#: whose sizes it looks up itself.
MOST_SEEN, MOST_LOOKED_UP = 4096, 4096
#: Folders, and files to look up, of one task.
ITEMS, LOOKED_UP = 64, 4096

_FOUND = pa.schema([("kind", pa.string()), ("path", pa.string()), ("size", pa.int64()), ("mtime_us", pa.int64()), ("error", pa.string())])


def _visit(kind: str, path: str, most_seen: int, most_looked_up: int) -> Iterator[tuple]:
    """Rows of one item: `file` with size and time, `error`, and what is left: `folder` to list, `unseen` file to look up."""

    def look_up(at: str) -> tuple:
        try:
            return "file", at, *store.size_and_time(at), None
        except OSError as e:
            return "error", at, None, None, str(e)

    if kind == "unseen":
        yield look_up(path)
        return
    seen, stack = 0, [path]
    while stack and seen < most_seen:
        folder = stack.pop()
        seen += 1
        try:
            for e in store.entries(folder):
                seen += 1
                try:
                    e.path.encode()
                except UnicodeEncodeError:
                    yield "error", ascii(e.path), None, None, "the name isn't UTF-8"
                    continue
                if e.kind == "folder":
                    # A folder of very many folders isn't kept here either.
                    if len(stack) < most_seen:
                        stack.append(e.path)
                    else:
                        yield "folder", e.path, None, None, None
                elif e.kind == "file":
                    yield look_up(e.path) if seen <= most_looked_up else ("unseen", e.path, None, None, None)
        except OSError as e:
            yield "error", folder, None, None, str(e)
    for folder in stack:
        yield "folder", folder, None, None, None


def _visits(most_seen: int, most_looked_up: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for batch in batches:
            for kind, path in zip(batch.column("kind").to_pylist(), batch.column("path").to_pylist()):
                for row in _visit(kind, path, most_seen, most_looked_up):
                    out.append(row)
                    if len(out) == 4096:
                        yield _batch(out)
                        out = []
        if out:
            yield _batch(out)

    return run


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), _FOUND)], schema=_FOUND)


def walk(spark: SparkSession, base: str, most_seen: int = MOST_SEEN, most_looked_up: int = MOST_LOOKED_UP, items: int = ITEMS) -> DataFrame:
    """kind, path, size, mtime, error of all that lies below a folder, at any depth: `file` and `error` rows.

    Links to files count as files with their target's size and time; links to folders aren't followed; broken links and
    special files are left out.  A folder that can't be read, a file that went away and a name that isn't UTF-8 are
    `error` rows, as is a base that isn't there.  Hidden folders are entered and empty files listed.  Each entry comes once.
    """
    on_workers(spark)
    at = f"{shared_dir(spark)}/walk-{uuid.uuid4().hex}"
    left, n, turn = spark.createDataFrame([("folder", base)], "kind string, path string"), {"folder": 1}, 0
    schema = "kind string, path string, size long, mtime_us long, error string"
    while n:
        tasks = max(-(-n.get("folder", 0) // items) + -(-n.get("unseen", 0) // LOOKED_UP), min(sum(n.values()), spark.sparkContext.defaultParallelism))
        left.repartition(tasks).mapInArrow(_visits(most_seen, most_looked_up), schema).write.parquet(f"{at}/round={turn}")
        left = spark.read.schema(schema).parquet(f"{at}/round={turn}").where("kind in ('folder', 'unseen')").select("kind", "path")
        n, turn = {r["kind"]: r["count"] for r in left.groupBy("kind").count().collect()}, turn + 1
    rows = spark.read.schema(f"{schema}, round int").parquet(at).where("kind in ('file', 'error')")
    return rows.select("kind", "path", "size", F.timestamp_micros("mtime_us").alias("mtime"), "error")


def problems(walked: DataFrame) -> DataFrame:
    """path and error of what couldn't be listed."""
    return walked.where("kind = 'error'").select("path", "error")
