"""The ledger of operations: sessions, their history, and undoing them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import versions
from ..functions import exprs as X
from ..functions.numbering import numbered, with_block

SESSION_SCHEMA = "session_id int, timestamp string, operations array<struct<type:string,file:string,old_value:string,new_value:string,detail:string>>, undone boolean, undone_at string"


def ledger_append(operations: DataFrame) -> DataFrame:
    """Operation rows (session_id, file_id, type, file, old_value, new_value) with position and a text of what was done."""
    c = F.col
    # Types and how they are told.
    move = F.concat(X.basename(c("old_value")), F.lit(" -> "), X.basename(c("new_value")))
    detail = (
        F.when(c("type") == "TRASH", F.concat(F.lit("Moved to trash: "), X.basename(c("file"))))
        .when(c("type") == "RENAME", F.concat(F.lit("Renamed: "), move))
        .when(c("type") == "MOVE", F.concat(F.lit("Moved: "), move))
        .otherwise(F.concat(F.initcap(F.lower(F.replace(c("type"), F.lit("_"), F.lit(" ")))), F.lit(": "), F.coalesce("old_value", F.lit("none")), F.lit(" -> "), F.coalesce("new_value", F.lit("none"))))
    )
    place = F.row_number().over(Window.partitionBy("session_id").orderBy("file_id")) - 1
    return operations.select("session_id", place.alias("pos"), "type", "file", "old_value", "new_value", detail.alias("detail"))


def ledger_flatten(sessions: DataFrame) -> DataFrame:
    """One row per operation of nested sessions, with its position."""
    rows = sessions.select("session_id", "timestamp", "undone", F.posexplode("operations").alias("pos", "op"))
    return rows.select("session_id", "timestamp", "undone", "pos", "op.*")


def history(*ledgers: DataFrame) -> DataFrame:
    """Sessions of all ledgers (root, session_id, timestamp, operations, undone), the newest first, with their index."""
    from functools import reduce

    rows = with_block(reduce(DataFrame.unionByName, ledgers), "session_id")
    at, root, block = F.col("timestamp"), F.col("root"), F.col("_block")
    rows = rows.withColumn("_day", F.substring(at, 1, 10)).withColumn("_minute", F.substring(at, 1, 16))
    levels = [{"_day": F.col("_day").desc()}, {"_minute": F.col("_minute").desc()}, {"timestamp": at.desc()}, {"root": root.asc(), "_block": block.asc()}]
    rows = numbered(rows, levels, [at.desc(), root.asc(), F.col("session_id").asc()], "index").drop("_day", "_minute", "_block")
    return rows.withColumn("index", (F.col("index") - 1).cast("int"))


def undo_plan(flat: DataFrame, media: DataFrame, ref_compat: bool = False) -> DataFrame:
    """The inverse of each operation of sessions that aren't undone, the last operation first.

    Trash needs a hand; a file that isn't where the operation left it fails.  Moves have an inverse unless `ref_compat`.
    """
    c = F.col
    rows = flat.where(~F.coalesce("undone", F.lit(False)))
    left_at = F.when(c("type").isin("RENAME", "MOVE", "CONVERT"), c("new_value")).otherwise(c("file"))
    known = media.select(F.col("path").alias("_at")).distinct().withColumn("_there", F.lit(True))
    rows = rows.withColumn("_at", left_at).join(known, "_at", "left").withColumn("_there", F.coalesce("_there", F.lit(False)))
    moved = ["RENAME"] if ref_compat else ["RENAME", "MOVE"]
    # Why an operation isn't undone.
    no_old = F.coalesce(c("old_value"), F.lit("")) == ""
    action = (
        F.when(c("type") == "TRASH", "manual")
        .when(c("type").isin(*moved), F.when(c("_there"), "move back").otherwise("File not found"))
        .when(c("type") == "GPS", F.when(no_old, "remove GPS").otherwise("restore GPS"))
        .when(c("type") == "ORIENTATION", F.when(no_old, "No old value").otherwise("restore orientation"))
        .when(c("type") == "DATE_FIX", F.when(no_old, "No old value").when(c("_there"), "restore date").otherwise("File not found"))
        .when(c("type") == "CONVERT", F.when(c("_there"), "trash converted").otherwise("File not found"))
        .otherwise("Unknown operation type")
    )
    good = action.isin("move back", "remove GPS", "restore GPS", "restore orientation", "restore date", "trash converted")
    back = X.parse_gps(F.when(action == "restore GPS", c("old_value")))
    step = F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("pos")))
    return rows.select("session_id", step.alias("step"), "pos", "type", c("_at").alias("source"), c("old_value").alias("target"), action.alias("action"), good.alias("success"), back["lat"].alias("lat"), back["lon"].alias("lon"))


def mark_undone(sessions: DataFrame, session_id: int, at: str) -> DataFrame:
    """The sessions with one marked; a session that is unknown or undone already is an error."""
    found = sessions.where(F.col("session_id") == session_id).select("undone").limit(1).collect()
    if not found:
        raise IndexError(f"session {session_id} is out of range")
    if found[0]["undone"]:
        raise ValueError(f"session {session_id} was undone already")
    hit = F.col("session_id") == session_id
    return sessions.withColumn("undone", hit | F.col("undone")).withColumn("undone_at", F.when(hit, F.lit(at)).otherwise(F.col("undone_at")))


_DONE_SCHEMA = "session_id int, timestamp string, operations array<struct<type:string,file:string,old_value:string,new_value:string,detail:string>>"
_UNDONE_SCHEMA = "session_id int, undone_at string"


def stored_sessions(spark: SparkSession, path: str) -> DataFrame:
    """All sessions of a ledger kept in versioned tables, with what was undone since."""
    done, undone = versions.read(spark, f"{path}/sessions", _DONE_SCHEMA), versions.read(spark, f"{path}/undone", _UNDONE_SCHEMA)
    return done.join(undone, "session_id", "left").select(*done.columns, F.col("undone_at").isNotNull().alias("undone"), "undone_at")


def record_session(spark: SparkSession, path: str, operations: DataFrame, at: str) -> int:
    """Adds one session of what a user did (pos, type, file, old_value, new_value, detail) and returns its number, from 0.

    Whoever else adds one at the same time, each gets a number of its own and none is lost.
    """
    item = F.struct("type", "file", "old_value", "new_value", "detail")
    nested = operations.agg(F.array_sort(F.collect_list(F.struct("pos", item.alias("op")))).alias("o")).select(F.transform("o", lambda x: x["op"]).alias("operations"))
    given = -1

    def next_one(version: int) -> DataFrame:
        nonlocal given
        last = versions.read(spark, f"{path}/sessions", _DONE_SCHEMA, version).agg(F.max("session_id")).head()[0]
        given = 0 if last is None else last + 1
        return nested.select(F.lit(given).cast("int").alias("session_id"), F.lit(at).alias("timestamp"), "operations")

    versions.append(next_one, f"{path}/sessions", spark)
    return given


def record_undone(spark: SparkSession, path: str, session_id: int, at: str) -> None:
    """Marks a stored session as undone; an error, as in `mark_undone`, if it is unknown or was undone, by anyone."""

    def marked(version: int) -> DataFrame:
        undone = versions.read(spark, f"{path}/undone", _UNDONE_SCHEMA, version)
        done = versions.read(spark, f"{path}/sessions", _DONE_SCHEMA).select("session_id")
        known = done.join(undone, "session_id", "left").select("session_id", "undone_at", F.col("undone_at").isNotNull().alias("undone"))
        return mark_undone(known, session_id, at).where(F.col("session_id") == session_id).select("session_id", "undone_at")

    versions.append(marked, f"{path}/undone", spark)
