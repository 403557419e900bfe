"""Best-fit packing of documents into sequences by a configuration linear program.

Pieces are known by their length alone: the program has one row per length (at most `capacity` of them, however many
documents there are) and one column per configuration, a multiset of lengths that fits a sequence.  Multiplicative
weights price the lengths: a length's price starts in proportion to it and falls exponentially with how far its demand
is covered.  A knapsack dynamic program finds the configurations that are worth most at these prices; many are taken in
a round, one around each of the lengths covered least.  By duality, the worth of all pieces divided by that of the best
configuration is a bound that no packing can go below, and the largest over all rounds is kept.  The fractional solution
is rounded down; what remains, less than a sequence for each configuration, is packed greedily, each sequence starting
with the longest remaining piece and filled as well as a subset-sum can.

Only the histogram (length x rank bucket) reaches the driver: a length has a bucket for each `task_rows` pieces, and up
to `spread` of them below that.  Pieces get their rank among those of the same length from their bucket's share and a
window within (length, bucket), so no task holds a length that a third of all pieces have, and look up the sequence that
this rank belongs to.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import automaton, tokenizer_path
from .common import frugal, on_workers, steps, table, written

Plan = list[tuple[dict[int, int], int]]
#: Bytes of text encoded at once: workers here come beside those of stages before, so memory counts more than repeated words.
PACK_BYTES = 4 << 20


def knapsack(price: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """best[w], the worth of the best multiset of total length w at most, and a length to take there (0: none).

    price[l] is the worth of a piece of length l; 0 or less is never taken.
    """
    lengths = np.flatnonzero(price > 0)
    best, take = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    worth = price[lengths]
    for w in range(1, capacity + 1):
        best[w], take[w] = best[w - 1], 0
        k = int(np.searchsorted(lengths, w, side="right"))
        if k:
            got = best[w - lengths[:k]] + worth[:k]
            j = int(got.argmax())
            if got[j] > best[w]:
                best[w], take[w] = got[j], lengths[j]
    return best, take


def _filled(take: np.ndarray, w: int) -> dict[int, int]:
    out: dict[int, int] = {}
    while w > 0:
        if (at := int(take[w])) == 0:
            w -= 1
        else:
            out[at] = out.get(at, 0) + 1
            w -= at
    return out


def fractional(demand: np.ndarray, capacity: int, rounds: int = 60, columns: int = 256, rate: float = 0.5) -> tuple[dict[tuple[tuple[int, int], ...], float], float]:
    """A fractional solution of the covering program, how often to use each configuration, and a bound on sequences.

    In each round the knapsack is solved at the present prices, and for each of the `columns` least covered lengths the
    best configuration that holds it is used as often as its scarcest length allows.
    """
    lengths = np.flatnonzero(demand)
    use: dict[tuple[tuple[int, int], ...], float] = {}
    if not len(lengths):
        return use, 0.0
    bound = 0.0
    cover = np.zeros(capacity + 1)
    for _ in range(rounds):
        low = cover[lengths].min()
        price = np.zeros(capacity + 1)
        # Worth by length as in any packing, scaled by the multiplicative weight exp(-rate * coverage).
        price[lengths] = lengths * np.exp(-rate * (cover[lengths] - low))
        best, take = knapsack(price, capacity)
        # Prices divided by the best configuration's worth are feasible for the dual program.
        bound = max(bound, float(price[lengths] @ demand[lengths]) / best[capacity])
        for first in lengths[np.argsort(cover[lengths], kind="stable")[:columns]]:
            config = _filled(take, capacity - int(first))
            config[int(first)] = config.get(int(first), 0) + 1
            times = min(demand[x] / k for x, k in config.items())
            key = tuple(sorted(config.items(), reverse=True))
            use[key] = use.get(key, 0.0) + times
            for x, k in config.items():
                cover[x] += k * times / demand[x]
    scale = float((cover[lengths] * lengths * demand[lengths]).sum() / (lengths * demand[lengths]).sum())
    return {c: x / scale for c, x in use.items()}, bound


def plan(demand: np.ndarray, capacity: int) -> Plan:
    """Configurations and how often each is used; together they hold exactly `demand[l]` pieces of each length l."""
    return bounded_plan(demand, capacity)[0]


def bounded_plan(demand: np.ndarray, capacity: int) -> tuple[Plan, float]:
    """The plan and the number of sequences that no plan can go below."""
    left = demand.astype(np.int64).copy()
    out: Plan = []
    use, bound = fractional(demand, capacity)
    for key, x in sorted(use.items(), key=lambda kx: -kx[1]):
        times = min([int(x), *(int(left[a] // k) for a, k in key)])
        if times > 0:
            out.append((dict(key), times))
            for a, k in key:
                left[a] -= k * times
    while len(rest := np.flatnonzero(left)):
        config = {int(rest[-1]): 1}
        gap = capacity - int(rest[-1])
        left[rest[-1]] -= 1
        for x in _best_fill(left, gap):
            config[x] = config.get(x, 0) + 1
            left[x] -= 1
        times = min(int(left[x] // k) for x, k in config.items())
        for x, k in config.items():
            left[x] -= k * times
        out.append((config, times + 1))
    return out, bound


def _best_fill(left: np.ndarray, gap: int) -> list[int]:
    """Available lengths, long ones first, whose sum is the largest that is at most `gap` (subset sums as bit sets)."""
    if gap <= 0:
        return []
    reach, mask, trail = 1, (1 << (gap + 1)) - 1, []
    for x in np.flatnonzero(left[: gap + 1])[::-1].tolist():
        for _ in range(min(int(left[x]), gap // x)):
            now = (reach | (reach << x)) & mask
            if now == reach:
                break
            trail.append((x, reach))
            reach = now
        if reach >> gap & 1:
            break
    best, out = reach.bit_length() - 1, []
    for x, before in reversed(trail):
        if not before >> best & 1:
            out.append(x)
            best -= x
    return out


def pieces(docs: DataFrame, path: str | None = None, capacity: int = 1024, end_id: int = 2) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: every document's ids with `end_id` behind them, cut where too long.

    A document of more than `capacity` ids is cut into pieces of just that many; its first piece may be shorter.
    """
    on_workers(docs.sparkSession)
    path = path or tokenizer_path()
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = automaton(path)
        for batch in steps(batches, most=PACK_BYTES):
            ids, bounds = a.encode(batch.column("text"))
            ids = ids.astype("<u4", copy=False)
            size = np.diff(bounds) + 1
            parts = -(-size // capacity)
            row = np.repeat(np.arange(len(size)), parts)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts)
            short = size - (parts - 1) * capacity
            start = np.where(piece == 0, 0, short[row] + (piece - 1) * capacity)
            length = np.where(piece == 0, short[row], capacity)
            begin = bounds[row] + start
            stop = np.minimum(begin + length, bounds[row + 1])
            last = piece == parts[row] - 1
            crc = [zlib.crc32(end, x) if z else x for x, z in ((zlib.crc32(ids[b:e]), z) for b, e, z in zip(begin.tolist(), stop.tolist(), last.tolist()))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", "text").mapInArrow(frugal(run), "doc_id long, piece int, start long, length long, ids_crc32 long")


def assign(cut: DataFrame, capacity: int = 1024, task_rows: int = 1 << 20, spread: int = 128) -> DataFrame:
    """`cut` (a table with `length`) with sequence_id and offset: no sequence beyond `capacity`, none with a gap."""
    spark = cut.sparkSession
    tagged = written(cut.withColumn("_tag", F.monotonically_increasing_id()), "pieces", small=True)
    many = np.zeros(capacity + 1, np.int64)
    for r in tagged.groupBy("length").count().collect():  # at most `capacity` rows
        many[r["length"]] = r["count"]
    buckets = np.maximum(-(-many // task_rows), np.minimum(spread, -(-many // 1024)))
    first = np.cumsum(buckets) - buckets
    grid = spark.createDataFrame([(int(x), int(buckets[x])) for x in np.flatnonzero(many)], "length long, _of int")
    tagged = tagged.join(F.broadcast(grid), "length").withColumn("_bucket", F.pmod(F.xxhash64("_tag"), F.col("_of")).cast("int")).drop("_of")
    share = np.zeros(int(buckets.sum()), np.int64)
    for r in tagged.groupBy("length", "_bucket").count().collect():  # about a row for each `task_rows` pieces, and `spread` for each length
        share[first[r["length"]] + r["_bucket"]] = r["count"]
    before = np.cumsum(share) - share
    before -= np.repeat(before[first[buckets > 0]], buckets[buckets > 0])
    keys, lows, copies, bases, offsets = [], [], [], [], []
    taken, sequences = np.zeros(capacity + 1, np.int64), 0
    for config, times in plan(many, capacity):
        at = 0
        for x, k in sorted(config.items(), reverse=True):
            keys.append((x << 44) + int(taken[x]))
            lows.append(int(taken[x])), copies.append(k), bases.append(sequences), offsets.append(at)
            taken[x] += k * times
            at += x * k
        sequences += times
    order = np.argsort(np.array(keys, np.int64), kind="stable")
    shared = spark.sparkContext.broadcast((first, before, *(np.array(x, np.int64)[order] for x in (keys, lows, copies, bases, offsets))))
    ranked = tagged.withColumn("_rank", F.row_number().over(Window.partitionBy("length", "_bucket").orderBy("_tag")))
    names = [c for c in cut.columns if c not in ("sequence_id", "offset")]
    schema = cut.select(names).withColumn("sequence_id", F.lit(0).cast("long")).withColumn("offset", F.lit(0).cast("long")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, before, keys, lows, copies, bases, offsets = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            length, bucket, rank = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "_bucket", "_rank"))
            rank = before[first[length] + bucket] + rank - 1
            i = np.searchsorted(keys, (length << 44) + rank, side="right") - 1
            q, k = rank - lows[i], copies[i]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(bases[i] + q // k), pa.array(offsets[i] + q % k * length)], [*names, "sequence_id", "offset"])

    return ranked.select(*names, "_bucket", "_rank").mapInArrow(run, schema)


def pack(docs: DataFrame, path: str | None = None, capacity: int = 1024, end_id: int = 2) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of every document.

    A null or empty text is the end id alone.  Repeated rows are packed as often as they occur; ties in length are told
    apart by the place of their rows in the written piece table, so no key can gather in one task.  An empty table gives
    no rows; columns other than doc_id and text are not read.
    """
    return assign(pieces(docs, path, capacity, end_id), capacity)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of `documents`; see `pack`."""
    return pack(table(spark, sf_dir, "documents"))
