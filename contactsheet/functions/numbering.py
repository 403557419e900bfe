"""Row numbers over whole tables without a window over all rows: counts of buckets, running sums over those, and ranks within a bucket."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_block(rows: DataFrame, column: str, pieces: int = 1024) -> DataFrame:
    """`rows` with `_block`, which cuts a numeric column into pieces of about equally many rows, in its order.

    The cuts are approximate quantiles, so a few ids far from all others don't put the rest into one piece.  Null ids are
    in the first piece.
    """
    shares = ", ".join(repr(k / pieces) for k in range(1, pieces))
    cuts = rows.agg(F.expr(f"array_distinct(percentile_approx({column}, array({shares}), {10 * pieces}))").alias("_cuts"))
    # How many of the cuts, which are in order, a value reaches: found bit by bit.
    reached = f"""aggregate(sequence({(pieces - 1).bit_length() - 1}, 0, -1), 0, (n, b) -> if(
        n + shiftleft(1, b) <= size(_cuts) and get(_cuts, n + shiftleft(1, b) - 1) <= {column}, n + shiftleft(1, b), n))"""
    block = F.when(F.col(column).isNull() | F.col("_cuts").isNull(), 0).otherwise(F.expr(reached)).cast("bigint")
    return rows.crossJoin(F.broadcast(cuts)).withColumn("_block", block).drop("_cuts")


def numbered(rows: DataFrame, levels: list[dict[str, Column]], order: list[Column], name: str) -> DataFrame:
    """`rows` with their number from 1 in `order`, as bigint.

    `levels` are columns by which buckets nest, each with its direction, coarse ones first; all agree with `order`.
    A running sum looks at the buckets of one level within one bucket of the level above.
    """
    every = [c for level in levels for c in level]
    counts = rows.groupBy(*every).agg(F.count("*").alias("_n"))
    out = rows.withColumn("_rank", F.row_number().over(Window.partitionBy(*every).orderBy(*order)).cast("bigint"))
    above: list[str] = []
    for k, level in enumerate(levels):
        own = [*above, *level]
        before = F.sum("_n").over(Window.partitionBy(*above).orderBy(*level.values()).rowsBetween(Window.unboundedPreceding, -1))
        tier = counts.groupBy(*own).agg(F.sum("_n").alias("_n")).withColumn("_before", F.coalesce(before, F.lit(0)))
        tier = tier.select(*(F.col(c).alias(f"_{k}{c}") for c in own), F.col("_before").alias(f"_before{k}"))
        same = [F.col(c).eqNullSafe(F.col(f"_{k}{c}")) for c in own]
        out = out.join(tier, same).drop(*(f"_{k}{c}" for c in own))
        above = own
    total = sum((F.col(f"_before{k}") for k in range(len(levels))), F.col("_rank"))
    return out.withColumn(name, total).drop("_rank", *(f"_before{k}" for k in range(len(levels))))


def running_sum(rows: DataFrame, keys: list[str], block: str, order: list[Column], value: Column, name: str) -> DataFrame:
    """`rows` with the sum of `value` so far (its own too) among those of the same keys, by `block`, then `order`.

    No task holds more of a key than one block of it: running sums over blocks are of one row each.
    """
    rows = rows.withColumn("_value", value)
    sums = rows.groupBy(*keys, block).agg(F.sum("_value").alias("_sum"))
    before = F.sum("_sum").over(Window.partitionBy(*keys).orderBy(block)) - F.col("_sum")
    sums = sums.select(*(F.col(c).alias(f"_of_{c}") for c in (*keys, block)), before.alias("_before"))
    within = F.sum("_value").over(Window.partitionBy(*keys, block).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    out = rows.withColumn("_within", within).join(sums, [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in (*keys, block)])
    return out.withColumn(name, (F.col("_before") + F.col("_within")).cast("bigint")).drop("_value", "_within", "_before", *(f"_of_{c}" for c in (*keys, block)))
