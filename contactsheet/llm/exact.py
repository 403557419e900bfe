"""Exact de-duplication that splits off heavy hitters.  DataFrame functions only.

A Misra-Gries family sketch (Spark's `approx_top_k`, partial on the map side and merged) proposes frequent digests; it
tracks a fixed number of counters, so any digest with more than rows / `counters` copies is among them.  The proposed
digests are counted exactly, which needs one row per digest and task, and those that are frequent indeed are broadcast
(`heavy` rows at most) with their winner, so their rows are settled where they are read.  All other digests are shuffled
in the ordinary way: count and winner come from an aggregate that each task pre-aggregates and that is written, so that
both sides of the join in which they meet their rows come straight from a shuffle and Spark can split its large
partitions: what the sketch leaves can't fill a task either.  Where only the rows that stay are wanted, each task sends
its best one of a digest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, written

#: The characters that equality ignores: [\x20\x09-\x0D].
BLANKS = " \t\n\x0b\x0c\r"


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), BLANKS, "")


def _better() -> list[Column]:
    return [F.col("_points").desc(), F.col("doc_id").asc_nulls_last(), F.col("_row").asc()]


def _rank() -> Column:
    """Smaller is better: more code points, then the smaller doc_id (null last), then the row's place or hash."""
    return F.struct((-F.col("_points")).alias("p"), F.col("doc_id").isNull().alias("z"), F.col("doc_id").alias("d"), F.col("_row").alias("r"))


def _row_hash(rows: DataFrame) -> Column:
    """A hash of all columns; those with maps, which Spark doesn't hash, as JSON."""
    return F.xxhash64(*(F.to_json(F.struct(f.name)) if "map<" in f.dataType.simpleString() else F.col(f.name) for f in rows.schema))


def _winners(rows: DataFrame, heavy: int, counters: int, least: int) -> DataFrame:
    """Heavy digests with `_size` and `_best`, their count and winner: at most `heavy` rows."""
    top = rows.agg(F.expr(f"approx_top_k(_digest, {heavy}, {counters})").alias("t")).select(F.explode("t").alias("t"))
    named = F.broadcast(top.select(F.col("t.item").alias("_digest")))
    won = rows.join(named, "_digest", "left_semi").groupBy("_digest").agg(F.count("*").alias("_size"), F.min(_rank()).alias("_best"))
    return written(won.where(F.col("_size") >= least), "heavy")


def mark(docs: DataFrame, heavy: int = 256, counters: int = 4096, least: int = 64) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row.

    Null texts count as empty, so all null, empty and blank texts are one group.  Of equal texts the row with the most
    code points stays, then the smallest doc_id (null last); of rows that are equal in both just one is kept.  An empty
    table gives no rows; texts may be of any length; columns other than doc_id and text are not read.
    """
    rows = docs.select("doc_id", F.sha2(normalised(F.col("text")), 256).alias("_digest"), F.coalesce(F.length("text"), F.lit(0)).alias("_points"))
    rows = written(rows.withColumn("_row", F.monotonically_increasing_id()), "digests")
    both = rows.join(F.broadcast(_winners(rows, heavy, counters, least)), "_digest", "left")
    hot, cold = both.where("_size is not null"), both.where("_size is null").drop("_size", "_best")
    cold = cold.join(written(cold.groupBy("_digest").agg(F.count("*").alias("_size"), F.min(_rank()).alias("_best")), "cold"), "_digest")
    out = hot.unionByName(cold)
    return out.select("doc_id", F.col("_best.d").alias("keep_id"), F.col("_size").alias("group_size"), (F.col("_row") == F.col("_best.r")).alias("kept"), F.col("_digest").alias("text_sha256"))


def keep(docs: DataFrame, heavy: int = 256, counters: int = 4096, least: int = 64) -> DataFrame:
    """The rows of `docs` that stay, whole and with all columns; same rule as `mark`.

    Texts are shuffled once at most, and those of heavy digests not at all but for their winner.  Of rows that have the
    same doc_id and equally many code points the one with the smallest hash of all its columns stays.
    """
    names = docs.columns
    plain = docs.toDF(*(f"c{i}" for i in range(len(names))))  # a struct needs no other name of the caller's
    text, doc_id = (F.col(f"c{names.index(c)}") for c in ("text", "doc_id"))
    whole = plain.select(F.struct(*plain.columns).alias("_doc"), doc_id.alias("doc_id"), F.sha2(normalised(text), 256).alias("_digest"), F.coalesce(F.length(text), F.lit(0)).alias("_points"), _row_hash(plain).alias("_row"))
    small = written(whole.select("doc_id", "_digest", "_points", "_row"), "digests")
    both = whole.join(F.broadcast(_winners(small, heavy, counters, least)), "_digest", "left")
    tie = Window.partitionBy("_digest")
    best = F.col("_row") == F.col("_best.r")
    # Winners of heavy digests: one row each, or equal rows of one doc_id, of which a partial aggregate keeps one.
    hot = both.where(F.col("_size").isNotNull() & best).groupBy("_digest").agg(F.first("_doc").alias("_doc")).select("_doc.*")
    cold = both.where("_size is null")
    cold = cold.withColumn("_rank", F.row_number().over(tie.orderBy(*_better()))).where("_rank = 1").select("_doc.*")
    return hot.union(cold).toDF(*names)


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row of `documents`; see `mark`."""
    return mark(table(spark, sf_dir, "documents"))


OP3_SQL = r"""
with d as (
  select doc_id, coalesce(length(text), 0) points,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) text_sha256
  from documents)
select doc_id,
       first_value(doc_id) over (partition by text_sha256 order by points desc, doc_id nulls last) keep_id,
       count(*) over (partition by text_sha256) group_size,
       row_number() over (partition by text_sha256 order by points desc, doc_id nulls last) = 1 kept,
       text_sha256
from d
"""
