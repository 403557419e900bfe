"""Nearest neighbours by randomly rotated one-bit codes.

Vectors fall into cells around centroids that are fitted on a bounded sample.  The rest behind its centroid is padded to
`bits` dimensions and rotated at random; a code keeps one bit per dimension, packed into words, with the rest's length
and the inner product of its direction with its code as correction scalars.  A query is rotated alike and quantised into
bit planes, so inner products are counts of common bits.  The distance to a code is then estimated without bias, and the
estimate's error is bounded with high probability by `sure` standard widths.

A query first meets the codes of its nearest cells; the exact distances of the best of them give a bound that its k-th
neighbour can't exceed.  Then it meets all cells that the bound can't exclude (no vector is farther from its centroid than
the cell's radius), and a vector stays a candidate unless its lower bound is above the bound or the block's own.
Candidates are ranked by their exact distance in double precision.  So only the codes' error bounds are a matter of
chance; where vectors form clusters most cells are excluded, and where they don't every query meets every code.

Queries meet codes in a grid of blocks of bounded size, so neither side is broadcast and no block grows with the data.
Equal vectors share one code; of each set of equal vectors only the smallest k + 1 ids can be among a query's k nearest
(ties go to smaller ids), so these are all that is carried.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import on_workers, table, written

#: Bit planes of a query's components.
PLANES = 6
#: Number of cells of one vector length at most; ids of cells are length * CELLS + number.
CELLS = 128


def usable(column: str) -> Column:
    """Neither null, empty nor zero, and all components there and finite."""
    v = F.col(column)
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.isNotNull() & (F.size(v) > 0) & ~F.coalesce(odd, F.lit(True)) & F.exists(v, lambda x: x != 0)


@lru_cache(maxsize=4)
def rotation(bits: int, seed: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(bits, bits)))
    return (q * np.sign(np.diag(r))).astype(np.float32)


def _distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x**2).sum(axis=1)[:, None] - 2 * x @ centroids.T + (centroids**2).sum(axis=1), 0))


def centroids(x: np.ndarray, most: int, turns: int = 8) -> np.ndarray:
    """Lloyd's centroids, one for about 32 vectors."""
    c = x[: max(1, min(most, len(x) // 32))].copy()
    for _ in range(turns):
        own = _distances(x, c).argmin(axis=1)
        size = np.bincount(own, minlength=len(c))
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        c = np.where(size[:, None] > 0, sums / np.maximum(size, 1)[:, None], c)
    return c


@dataclass
class Index:
    """`codes`: one row for each distinct usable vector: cell, group, ids (its smallest k + 1), vector, code, norm, fit.
    `cells`: their vectors and radius.  `models`: centroids by vector length."""

    codes: DataFrame
    cells: dict[int, tuple[int, float]]
    models: Broadcast


def _width(bits: int, dims: int) -> int:
    return -(-max(bits, dims) // 64) * 64


def _centroids(models: dict[int, np.ndarray], dims: int) -> np.ndarray:
    return models.get(dims, np.zeros((1, dims)))


def index(vectors: DataFrame, k: int, bits: int = 512, seed: int = 11, sample: int = 4096) -> Index:
    """Codes of all usable vectors.  Centroids are all that is fitted, on at most `sample` vectors (the smallest hashes);
    vectors of a length that isn't among them lie in one cell around zero."""
    spark = vectors.sparkSession
    on_workers(spark)
    good = vectors.where(usable("embedding") & F.col("vec_id").isNotNull()).select("vec_id", F.col("embedding").alias("vector"))
    kind = good.schema["vector"].dataType.simpleString()  # vectors travel as they are, and count in double precision
    ranked = good.withColumn("_r", F.row_number().over(Window.partitionBy("vector").orderBy("vec_id"))).where(F.col("_r") <= k + 1)
    sets = ranked.groupBy("vector").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    some = [np.asarray(v, np.float64) for v in good.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("vector").toPandas()["vector"]]
    lengths = sorted({len(v) for v in some})
    models = spark.sparkContext.broadcast({d: centroids(np.stack([v for v in some if len(v) == d]), CELLS) for d in lengths})

    def code(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            dims = b["vector"].map(len)
            for d in dims.unique().tolist():
                part = b[dims == d]
                v = np.stack(part["vector"].to_list()).astype(np.float64)
                c = _centroids(models.value, d)
                own = _distances(v, c).argmin(axis=1)
                rest, width = v - c[own], _width(bits, d)
                x = rest.astype(np.float32) @ rotation(width, seed)[:, :d].T
                norm = np.linalg.norm(rest, axis=1)
                fit = np.abs(x).sum(axis=1) / np.maximum(norm, 1e-30) / np.sqrt(width)
                packed = np.packbits(x > 0, axis=1, bitorder="little")
                yield pd.DataFrame({"cell": d * CELLS + own, "group": [i[0] for i in part["ids"]], "ids": part["ids"].to_list(), "vector": part["vector"].to_list(), "code": [r.tobytes() for r in packed], "norm": norm, "fit": np.where(norm > 0, fit, 1.0)})

    coded = written(sets.mapInPandas(code, f"cell long, group long, ids array<long>, vector {kind}, code binary, norm double, fit double"), "codes")
    # At most CELLS rows for each vector length.
    cells = {r["cell"]: (r["n"], r["far"]) for r in coded.groupBy("cell").agg(F.count("*").alias("n"), F.max("norm").alias("far")).collect()}
    return Index(coded, cells, models)


def common_bits(codes: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Inner products of the rows of `y` with codes read as +-1 (words x codes of packed bits), and a bound of the error
    that comes from reading each component of a row in `PLANES` bits."""
    n, bits = y.shape
    low = y.min(axis=1)
    step = np.maximum((y.max(axis=1) - low) / (2**PLANES - 1), 1e-30)
    level = np.rint((y - low[:, None]) / step[:, None]).astype(np.uint8)
    ones = np.bitwise_count(codes).sum(axis=0, dtype=np.int32)
    total = np.zeros((n, codes.shape[1]), np.int32)
    for j in range(PLANES):
        plane = np.packbits(level >> j & 1, axis=1, bitorder="little").view(np.uint64)
        for w in range(codes.shape[0]):
            total += np.bitwise_count(plane[:, w, None] & codes[w]).astype(np.int32) << j
    got = 2 * low[:, None] * ones - (low * bits)[:, None] + step[:, None] * (2 * total - level.sum(axis=1, dtype=np.int64)[:, None])
    return got, 4 * step * np.sqrt(bits / 12)


def search(vectors: DataFrame, queries: DataFrame, k: int = 10, bits: int = 512, seed: int = 11, sure: float = 2.5, first: int = 4, code_block: int = 32768, query_block: int = 1024) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest vectors (Euclidean) of every query, its own row apart.

    Ties go to the smaller vec_id; a query has all candidates if there are fewer than k.  Vectors that are null, empty,
    zero or hold null or non-finite components take no part, neither as candidates nor as queries, nor do null ids.
    Vectors are neighbours of those with as many components only.  A repeated id is a candidate with each of its vectors,
    and as a query the one with the least of them.  Empty tables give no rows; other columns are not read.
    """
    made = index(vectors, k, bits, seed)
    spark, models, cells = vectors.sparkSession, made.models, made.cells
    asked = queries.where(usable("embedding") & F.col("vec_id").isNotNull()).groupBy(F.col("vec_id").alias("query_id"))
    asked = written(asked.agg(F.min("embedding").alias("asked")), "queries")
    probe = f"query_id long, asked {asked.schema['asked'].dataType.simpleString()}, cell long, most double"

    def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The nearest cells of each query, `first` of them and more until they hold 8 * (k + 1) vectors; with `most`
        all that may hold a vector as near as that."""
        for b in batches:
            for d, part in b.groupby(b["asked"].map(len)):
                there = sorted(c for c in cells if c // CELLS == d)
                if not there:
                    continue
                size, far = (np.array([cells[c][i] for c in there]) for i in (0, 1))
                gap = _distances(np.stack(part["asked"].to_list()).astype(np.float64), _centroids(models.value, d)[[c % CELLS for c in there]])
                if "most" in part:
                    q, c = np.nonzero(gap * (1 - 1e-9) - far <= part["most"].to_numpy()[:, None] * (1 + 1e-9))
                else:
                    order = np.argsort(gap, axis=1, kind="stable")
                    before = np.cumsum(size[order], axis=1) - size[order]
                    q, c = np.nonzero((before < 8 * (k + 1)) | (np.arange(len(there)) < first))
                    c = order[q, c]
                most = part["most"].to_numpy()[q] if "most" in part else np.full(len(q), np.inf)
                yield pd.DataFrame({"query_id": part["query_id"].to_numpy()[q], "asked": [part["asked"].iat[i] for i in q], "cell": np.array(there)[c], "most": most})

    def meet(probes: DataFrame, best: int | None) -> DataFrame:
        """query_id, group, high: each block's `best` smallest upper bounds of each query, or without `best` all rows that may be nearer than both the query's `most` and the block's (k + 1)-th."""
        probes = written(probes, "probes")
        # At most a row for each cell: into how many blocks its codes and its queries are dealt.
        grid = [(r["cell"], -(-cells[r["cell"]][0] // code_block), -(-r["count"] // query_block)) for r in probes.groupBy("cell").count().collect()]
        grid = F.broadcast(spark.createDataFrame(grid, "cell long, down long, across long"))

        def block(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
            none = pd.DataFrame({"query_id": np.empty(0, np.int64), "group": np.empty(0, np.int64), "high": np.empty(0)})
            if not len(a) or not len(b):
                return none
            d, number = divmod(int(a["cell"].iat[0]), CELLS)
            turn, centre = rotation(_width(bits, d), seed)[:, :d].T, _centroids(models.value, d)[number]
            words = np.frombuffer(b"".join(a["code"]), np.uint64).reshape(len(a), -1).T.copy()
            wide = 64 * len(words)
            norm, fit, groups = a["norm"].to_numpy(), a["fit"].to_numpy(), a["group"].to_numpy()
            scale = 2 * norm / fit / np.sqrt(wide)
            doubt = sure * 2 * norm * np.sqrt(np.maximum(1 - fit**2, 0)) / fit / np.sqrt(max(1, wide - 1))
            out = [none]
            at_once = max(1, (1 << 20) // len(a))
            for s in range(0, len(b), at_once):
                part = b.iloc[s : s + at_once]
                rest = np.stack(part["asked"].to_list()).astype(np.float64) - centre
                length = np.linalg.norm(rest, axis=1)
                product, error = common_bits(words, rest.astype(np.float32) @ turn)
                square = norm**2 + (length**2)[:, None] - product * scale
                error = doubt * length[:, None] + error[:, None] * scale + 1e-6 * (norm + length[:, None]) ** 2  # and single precision
                high, kept = square + error, min(len(a), k + 1)
                smallest = np.argpartition(high, kept - 1, axis=1)[:, :kept]
                if best:
                    q, g = np.repeat(np.arange(len(part)), kept), smallest.ravel()
                else:
                    limit = np.take_along_axis(high, smallest, axis=1).max(axis=1) if len(a) > k else np.full(len(part), np.inf)
                    limit = np.minimum(limit, part["most"].to_numpy() ** 2 * (1 + 1e-9))
                    q, g = np.nonzero(square - error <= limit[:, None])
                out.append(pd.DataFrame({"query_id": part["query_id"].to_numpy()[q], "group": groups[g], "high": high[q, g]}))
            return pd.concat(out)

        numbers = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
        left = made.codes.select("cell", "group", "code", "norm", "fit").join(grid, "cell").withColumn("_c", F.pmod(F.xxhash64("group"), F.col("down"))).withColumn("_q", numbers("across")).drop("down", "across")
        right = probes.join(grid, "cell").withColumn("_q", F.pmod(F.xxhash64("query_id"), F.col("across"))).withColumn("_c", numbers("down")).drop("down", "across")
        keys = ("cell", "_q", "_c")
        return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(block, "query_id long, group long, high double")

    def scored(pairs: DataFrame) -> DataFrame:
        """query_id, vec_id, score of all ids of the groups of `pairs` but the query's own."""
        # Ids alone meet the codes' vectors; queries come last, which Spark broadcasts if they are few.
        pairs = pairs.join(made.codes.select("group", "ids", "vector"), "group").join(asked, "query_id")
        double = lambda c: F.col(c).cast("array<double>")
        score = F.sqrt(F.aggregate(F.zip_with(double("asked"), double("vector"), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))
        return pairs.select("query_id", score.alias("score"), F.explode("ids").alias("vec_id")).where("vec_id <> query_id")

    def ranked(rows: DataFrame, *order: str, most: int) -> DataFrame:
        return rows.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(F.col("rank") <= most)

    nearby = ranked(meet(asked.mapInPandas(near, probe), best=k + 1), "high", "group", most=k + 1)
    bound = ranked(scored(nearby.select("query_id", "group")), "score", "vec_id", most=k)
    bound = bound.groupBy("query_id").agg(F.when(F.count("*") == k, F.max("score")).otherwise(float("inf")).alias("most"))
    bounded = asked.join(bound, "query_id", "left").withColumn("most", F.coalesce("most", F.lit(float("inf"))))
    rows = scored(meet(bounded.mapInPandas(near, probe), best=None).select("query_id", "group"))
    return ranked(rows, "score", "vec_id", most=k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op7_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, rank, vec_id, score for every hundredth id of `embeddings` against all other rows; see `search`."""
    vectors = table(spark, sf_dir, "embeddings")
    return search(vectors, vectors.where(F.col("vec_id") % 100 == 0))


OP7_SQL = """
with v as (select vec_id, embedding::double[] e from embeddings
           where embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0
             and len(list_filter(embedding, lambda x: x <> 0)) > 0),
p as (select q.vec_id query_id, c.vec_id, list_distance(q.e, c.e) score from v q join v c on c.vec_id <> q.vec_id where q.vec_id % 100 = 0),
r as (select *, row_number() over (partition by query_id order by score, vec_id) rank from p)
select query_id, rank::integer rank, vec_id, score from r where rank <= 10
"""
