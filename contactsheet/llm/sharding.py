"""Uniform shuffle into shards of exact size by a hypergeometric communication matrix.

Rows are listed once with the partition they were read in.  How many rows each group of partitions sends to each shard
is drawn from the multivariate hypergeometric law, group by group, which is the law of a uniform random dealing with
fixed shard sizes; the matrix is bounded by two parameters.  Within a group rows are permuted by a keyed hash and cut by
the group's row of the matrix (the exchange), and within a shard they are permuted again by another keyed hash.  Both
permutations are done in strips of the hash's range, as many as keep a strip at about `task_rows` rows, so no task holds
a whole group or shard.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, written


def matrix(rows: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """groups x shards counts with the given row sums; column sums are at most one apart, the first ones larger."""
    total = int(rows.sum())
    left = np.full(shards, total // shards, np.int64)
    left[: total % shards] += 1
    out = np.zeros((len(rows), shards), np.int64)
    rng = np.random.default_rng(seed)
    for g, n in enumerate(rows):
        # Marginals one after another: how many of this group's rows go to each shard, given what is left of each.
        need, rest = int(n), int(left.sum())
        for s in range(shards):
            if need == 0:
                break
            rest -= int(left[s])
            out[g, s] = need if rest == 0 else _draw(rng, int(left[s]), rest, need)
            need -= int(out[g, s])
        left -= out[g]
    return out


def _draw(rng: np.random.Generator, good: int, bad: int, sample: int) -> int:
    """How many good ones a sample of that size has.

    Neighbouring probabilities have a simple ratio, so they are built up from the mode to both sides, as far as a share
    of more than e**-70 of the largest is left, and one of them is drawn by inversion.  This holds for any population.
    """
    low, high = max(0, sample - bad), min(good, sample)
    if low == high:
        return low
    mode = min(max(int((good + 1) * (sample + 1) // (good + bad + 2)), low), high)
    share = good / (good + bad)
    spread = (sample * share * (1 - share) * (good + bad - sample) / (good + bad - 1)) ** 0.5
    reach = int(12 * spread) + 100
    low, high = max(low, mode - reach), min(high, mode + reach)
    k = np.arange(low, high, dtype=np.float64)
    ratio = np.log(good - k) + np.log(sample - k) - np.log(k + 1) - np.log(bad - sample + k + 1)  # of k + 1 to k
    weight = np.concatenate([[0.0], np.cumsum(ratio)])
    weight = np.exp(weight - weight.max())
    ends = np.cumsum(weight)
    return low + int(np.searchsorted(ends, rng.random() * ends[-1], side="right").clip(0, high - low))


def listed(docs: DataFrame, groups: int = 1024) -> DataFrame:
    """doc_id, size, text_crc32 of each row with `_group`, of the partition it was read in, and `_row`, its place."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text).cast("long") + 8).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    return written(rows.withColumn("_group", F.spark_partition_id() % groups).withColumn("_row", F.monotonically_increasing_id()), "listed")


def _strips(rows: int, task_rows: int) -> int:
    """A power of two."""
    return 1 << max(0, -(-rows // task_rows) - 1).bit_length()


def _strip(order: Column, strips: int) -> Column:
    """The rows whose hashes start with the same bits, so that strips follow one another as a whole."""
    return F.shiftrightunsigned(order, 64 - (strips.bit_length() - 1)).cast("int") if strips > 1 else F.lit(0)


def _ranked(rows: DataFrame, key: str, strips: int, name: str) -> tuple[DataFrame, DataFrame]:
    """`rows` with `name`, their place (from 0) by the unsigned `_order`, then `_row`, among those of the same `key`; how many each key has.

    The counts of (key, strip) are few: one for about `task_rows` rows, or one for each key.
    """
    cut = rows.withColumn("_strip", _strip(F.col("_order"), strips))
    sums = written(cut.groupBy(key, "_strip").agg(F.count("*").alias("_n")), "strips")
    before = sums.select(key, "_strip", (F.sum("_n").over(Window.partitionBy(key).orderBy("_strip")) - F.col("_n")).alias("_base"))
    # Within a strip the sign of the hash is the same unless the strip is the only one.
    inner = F.row_number().over(Window.partitionBy(key, "_strip").orderBy("_order", "_row")) - 1
    out = cut.withColumn("_in", inner).join(F.broadcast(before), [key, "_strip"]).withColumn(name, F.col("_base") + F.col("_in"))
    return out.drop("_strip", "_in", "_base"), sums.groupBy(key).agg(F.sum("_n").alias("count"))


def shuffle(docs: DataFrame, shards: int = 24, seed: int = 7, groups: int = 1024, task_rows: int = 1 << 20) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row.

    The law is `rows`: shard sizes are at most one apart, and each dealing with these sizes is equally likely.  Slots of
    a shard are 0, 1, ... without gaps.  Null texts have size 8.  Equal rows, null ids and equal texts are dealt one by
    one like others.  An empty table gives no rows; other columns are not read.
    """
    spark = docs.sparkSession
    rows = listed(docs, groups)
    total, largest = rows.groupBy("_group").count().agg(F.sum("count"), F.max("count")).head()
    if not total:
        return rows.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    ordered = rows.withColumn("_order", F.xxhash64("_row", F.lit(seed)))
    ranked, counts = _ranked(ordered, "_group", _strips(largest, task_rows), "_rank")
    counts = {r["_group"]: r["count"] for r in counts.collect()}  # at most `groups` rows
    names = sorted(counts)
    drawn = matrix(np.array([counts[g] for g in names], np.int64), shards, seed)
    ends = np.cumsum(drawn, axis=1)
    cells = [(g, s, int(ends[i, s] - drawn[i, s]), int(ends[i, s])) for i, g in enumerate(names) for s in range(shards) if drawn[i, s]]
    cells = spark.createDataFrame(cells, "_group int, shard int, _from long, _to long")  # at most groups x shards rows
    placed = ranked.join(F.broadcast(cells), "_group").where("_rank >= _from and _rank < _to")
    placed = placed.select("doc_id", "size", "text_crc32", "shard", F.xxhash64(F.lit(seed), "_row", F.lit("again")).alias("_order"), "_row")
    out, _ = _ranked(written(placed, "placed"), "shard", _strips(-(-total // shards), task_rows), "slot")
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row of `documents`; see `shuffle`."""
    return shuffle(table(spark, sf_dir, "documents"))
