"""Near-duplicates by DartMinHash signatures, banded joins and exact verification.

Each weighted element (a shingle of five words; `signatures` takes any weights, near-duplicates weigh each shingle 1,
since their similarity is that of sets) is a region of that width and of unlimited time.  Hashed darts fall into the
region at rate 1 per unit of area; a dart carries a coordinate and its time, and each of a signature's coordinates keeps
its earliest dart, so two signatures agree in a coordinate with the probability of the weighted Jaccard similarity.
Darts are thrown cell by cell of time, only until all coordinates are expected to be hit, so the work per text is its
length plus a constant; texts that leave coordinates open throw on.

Equal word sequences are one node.  Bands of a signature are buckets.  In each bucket all nodes are compared with one
hub, the node of the smallest hash, so a group of near copies has few hubs in all its buckets and is settled in little
more comparisons than members; those left outside a bucket's largest component meet a few more hubs of it.  Where a bucket
still holds nodes of several components, the nodes outside its largest one meet all others: in buckets of at most `DIRECT` nodes one by one, in larger ones by an exact prefix filter
(two sets of that similarity share one of their rarest shingles), so no link that banding proposes is lost.
Comparisons are exact: Jaccard similarity of the two shingle sets of the whole texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import frugal, on_workers, steps, table, written
from .flat import Words, mix64

_U = np.uint64
#: 56 bands of 8: a pair of similarity 0.8 shares none with probability 3e-5, one of 0.9 with 3e-14; of 0.3 one with 4e-3.
ROWS, BANDS, SHINGLE, SIMILAR = 8, 56, 5, 0.8
#: Further hubs that nodes outside a bucket's largest component are compared with.
HUB_TURNS = 2
#: Nodes of a bucket up to which those outside its largest component are compared with all others directly.
DIRECT = 32
#: Parts into which the pairs of one node are split where texts are joined to them.
SALT = 64
#: Ratio of neighbouring classes of set sizes in the prefix filter.
SIZE_STEP = 1.03
_CELLS = np.concatenate([[0, 1 / 16, 1 / 8, 1 / 4, 1 / 2], np.arange(1.0, 4097.0)])


def _poisson(mean: float) -> np.ndarray:
    """The distribution function up to where it is 1 but for rounding, in units of 2**-64."""
    p, total, out, k = np.exp(-mean), 0.0, [], 0
    while total < 1 - 1e-15 and k < 40:
        total += p
        out.append(total)
        k += 1
        p *= mean / k
    return np.array([min(int(x * 2**64), 2**64 - 1) for x in out], _U)


_COUNTS = {w: _poisson(w) for w in (1 / 16, 1 / 8, 1 / 4, 1 / 2, 1.0)}


def shingles(words: Words, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all word shingles, and each document's first; a text of fewer words is one shingle."""
    h, docs = words.hashes(), words.docs
    n = np.diff(docs)
    many = np.where(n >= size, n - size + 1, np.minimum(n, 1))
    bounds = np.concatenate([[0], np.cumsum(many)])
    at = np.repeat(docs[:-1] - bounds[:-1], many) + np.arange(bounds[-1])
    stop = np.repeat(docs[1:], many)
    out = np.zeros(len(at), _U)
    for j in range(size):
        there = at + j < stop
        out[there] = out[there] * _U(0x9E3779B97F4A7C15) + h[at[there] + j] + _U(1)
    return mix64(out), bounds


def weighted_shingles(words: Words, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of each document's distinct word shingles, its first one, and how often each occurs."""
    got, bounds = shingles(words, size)
    parts = [np.unique(got[a:b], return_counts=True) for a, b in zip(bounds[:-1], bounds[1:])]
    many = np.array([len(x) for x, _ in parts])
    join = lambda k, t: np.concatenate([p[k] for p in parts]) if parts else np.empty(0, t)
    return join(0, _U), np.concatenate([[0], np.cumsum(many)]).astype(np.int64), join(1, np.int64)


def signatures(elements: np.ndarray, bounds: np.ndarray, size: int, weights: np.ndarray | None = None) -> np.ndarray:
    """documents x size identities of the earliest darts; rows of documents without elements are all ones.

    Coordinates that no dart reaches by time 4096, as in rows whose weights sum to little, hold a value of the row's own
    elements and weights: they agree with those of equal rows, and else with none.

    Without weights rows are sets: an element that occurs twice throws the same darts twice, so repetitions don't
    matter.  With weights (positive, elements of a row distinct) an element's region is as wide as its weight: one
    region of width 1 for each whole unit, and for what is left one of which the darts beyond its width miss.
    """
    docs = len(bounds) - 1
    n = np.diff(bounds)
    owner = np.repeat(np.arange(docs), n)
    total, width_of = n.astype(np.float64), None
    if weights is not None:
        weights = np.asarray(weights, np.float64)
        total = np.bincount(owner, weights, docs)
        units = np.ceil(weights).astype(np.int64)
        unit = np.arange(int(units.sum())) - np.repeat(np.cumsum(units) - units, units)
        owner, width_of = np.repeat(owner, units), np.minimum(np.repeat(weights, units) - unit, 1.0)
        elements = mix64(np.repeat(elements, units) + unit.astype(_U) * _U(0x9E3779B97F4A7C15))
    full = _U(2**64 - 1)
    out = np.full(docs * size, full)
    need = size * (np.log(size) + 2) / np.maximum(total, 1e-9)
    live, gone = n > 0, False
    for cell in count():
        begin, width = _CELLS[cell], _CELLS[cell + 1] - _CELLS[cell]
        late = live & (begin >= need)
        if late.any():
            rows = np.flatnonzero(late)
            rows = rows[(out.reshape(docs, size)[rows] != full).all(axis=1)]
            live[rows] = False
            gone = len(rows) > 0
        if not live.any():
            return out.reshape(docs, size)
        if cell + 2 >= len(_CELLS):
            return _closed(out.reshape(docs, size), live, owner, elements if width_of is None else elements ^ mix64(width_of.view(_U)))
        if gone:
            stay = live[owner]
            elements, owner, gone = elements[stay], owner[stay], False
            width_of = None if width_of is None else width_of[stay]
        own, doc, wide = elements, owner, width_of
        drawn = mix64(own ^ _U((0x9E3779B97F4A7C15 * (cell + 1)) % 2**64))
        for k, limit in enumerate(_COUNTS[width]):
            hit = np.flatnonzero(drawn > limit)
            if not len(hit):
                break
            drawn, own, doc, wide = drawn[hit], own[hit], doc[hit], None if wide is None else wide[hit]
            dart = mix64(own * _U(0xD6E8FEB86659FD93) + _U(cell * 64 + k + 1))
            place = ((dart >> _U(32)) * _U(size)) >> _U(32)
            # Time within the cell in 19 bits under the cell's number in 12; 33 bits tell darts apart.
            time = mix64(dart)
            mark = (_U(cell) << _U(52)) | (time >> _U(12))
            at = doc * size + place.astype(np.int64)
            if wide is not None:
                inside = (mix64(time) >> _U(11)) * 2.0**-53 < wide
                at, mark = at[inside], mark[inside]
            np.minimum.at(out, at, mark)


def _closed(out: np.ndarray, live: np.ndarray, owner: np.ndarray, elements: np.ndarray) -> np.ndarray:
    """Signatures of rows that are still live with a value of their own elements in each open coordinate."""
    rows, own_hash = np.flatnonzero(live), np.zeros(len(out), _U)
    np.add.at(own_hash, owner, mix64(elements))
    value = mix64(own_hash[rows, None] + np.arange(out.shape[1], dtype=_U) * _U(0x9E3779B97F4A7C15)) | _U(2**63)
    out[rows] = np.where(out[rows] == _U(2**64 - 1), np.minimum(value, _U(2**64 - 2)), out[rows])
    return out


def _digests(words: Words, texts: pa.Array) -> list[bytes]:
    """Of the sequence of words; of the text itself where it has none."""
    data, starts, ends = words.data, words.starts, words.starts + words.lengths
    out = []
    raw = texts.to_pylist() if (np.diff(words.docs) == 0).any() else None
    for d, (a, b) in enumerate(zip(words.docs[:-1].tolist(), words.docs[1:].tolist())):
        own = data[starts[a] : ends[b - 1]].tobytes() if b > a else b"\0" + (raw[d] or "").encode()
        out.append(hashlib.blake2b(own, digest_size=16).digest())
    return out


def signed(docs: DataFrame) -> DataFrame:
    """`docs` with `_node` (place of the row in this table), `_digest` and `_bands`, written out."""
    on_workers(docs.sparkSession)
    base = docs.withColumn("_node", F.monotonically_increasing_id())
    schema = base.withColumn("_digest", F.lit(b"")).withColumn("_bands", F.array().cast("array<long>")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, most=3 << 20):
            texts = batch.column("text")
            words = Words(texts)
            got, bounds = shingles(words)
            sig = signatures(got, bounds, ROWS * BANDS).reshape(-1, BANDS, ROWS)
            band = np.broadcast_to(np.arange(1, BANDS + 1, dtype=_U), sig.shape[:2]).copy()
            for j in range(ROWS):
                band = mix64(band * _U(0x9E3779B97F4A7C15) + sig[:, :, j])
            some = np.diff(bounds) > 0
            offsets = np.concatenate([[0], np.cumsum(some * BANDS)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(band[some].reshape(-1).view(np.int64)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(_digests(words, texts), pa.binary()), lists], [*batch.schema.names, "_digest", "_bands"])

    return written(base.mapInArrow(frugal(run), schema), "signed", small=True)


def similar_pairs(pairs: DataFrame, rows: DataFrame, least: float = SIMILAR) -> DataFrame:
    """Those of `pairs` (a, b) whose texts in `rows` (_node, text) have shingle sets of that similarity at least."""
    text = lambda k: rows.select(F.col("_node").alias(k), F.col("text").alias(f"_{k}"))
    # A hub may be `a` of a large share of all pairs: these are split into `SALT` parts, and its text goes to each in use.
    pairs = pairs.select("a", "b", F.pmod(F.xxhash64("b"), F.lit(SALT)).alias("salt"))
    parts = pairs.select("a", "salt").distinct().join(text("a"), "a")
    both = pairs.join(parts, ["a", "salt"]).join(text("b"), "b").select("a", "b", "_a", "_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, column="_a", most=2 << 20):
            (x, xb), (y, yb) = (shingles(Words(batch.column(c))) for c in ("_a", "_b"))
            good = np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                p, q = np.unique(x[xb[i] : xb[i + 1]]), np.unique(y[yb[i] : yb[i + 1]])
                if len(p) and len(q) and min(len(p), len(q)) >= least * max(len(p), len(q)):
                    common = len(p) + len(q) - len(np.unique(np.concatenate([p, q])))
                    good[i] = common >= least * (len(p) + len(q) - common)
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(good)) for c in ("a", "b")], ["a", "b"])

    return both.mapInArrow(frugal(run), "a long, b long")


def prefix_pairs(probe: DataFrame, index: DataFrame, rows: DataFrame, least: float = SIMILAR) -> DataFrame:
    """a, b (a < b): of `probe` x `index` (node, comp) a superset of the pairs of two components with that similarity.

    Shingles are ordered by the number of nodes of `index` that hold them, rarest first.  If sets of sizes n and m have
    similarity s, at least s / (1 + s) * (n + m) shingles are common, so the first common one is no later in either
    order than its size less that number.  Sizes fall into classes a few percent wide, and each node offers to each
    class only its shingles up to that place; nodes of one common source with many own shingles don't meet.
    `probe` must be part of `index`.
    """
    texts = rows.select(F.col("_node").alias("node"), "text").join(index.select("node"), "node", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, most=1 << 20):
            got, bounds = shingles(Words(batch.column("text")))
            sets = [np.unique(got[a:b]) for a, b in zip(bounds[:-1], bounds[1:])]
            owner = np.repeat(batch.column("node").to_numpy(), [len(x) for x in sets])
            yield pa.RecordBatch.from_arrays([pa.array(owner), pa.array(np.concatenate(sets).view(np.int64))], ["node", "token"])

    tokens = written(texts.mapInArrow(frugal(run), "node long, token long"), "tokens", small=True)
    often = tokens.groupBy("token").agg(F.count("*").alias("often"))
    ranked = tokens.join(often, "token").groupBy("node").agg(F.array_sort(F.collect_list(F.struct("often", "token"))).alias("t"))
    # What is known of a node joins its one row here, before its shingles become rows.
    roles = index.join(probe.select("node", F.lit(True).alias("asks")), "node", "left").groupBy("node", "comp").agg(F.max(F.coalesce("asks", F.lit(False))).alias("asks"))
    ranked = ranked.join(roles, "node")
    size, step = F.size("t"), float(np.log(SIZE_STEP))
    cls = lambda x: F.floor(F.log(x) / step + 1e-9)
    other = F.explode(F.sequence(cls(size * least) - 1, cls(size / least) + 1))
    offers = ranked.select("node", "comp", "asks", F.col("t.token").alias("t"), cls(size).alias("own"), other.alias("other"))
    smallest = F.exp(F.col("other") * step) * (1 - 1e-6)
    upto = F.floor(size - least / (1 + least) * (size + smallest) + 1e-6).cast("int") + 1
    offers = offers.withColumn("upto", upto).where("upto > 0").select("node", "comp", "asks", "own", "other", F.explode(F.slice("t", 1, F.col("upto"))).alias("token"))
    offers = written(offers, "offers")
    asked = offers.where("asks").select(F.col("node").alias("x"), F.col("comp").alias("cx"), F.col("own").alias("other"), F.col("other").alias("own"), "token")
    met = asked.join(offers, ["token", "own", "other"]).where("cx <> comp")
    return met.select(F.least("x", "node").alias("a"), F.greatest("x", "node").alias("b")).distinct()


def _ordered(pairs: DataFrame, x: str, y: str) -> DataFrame:
    """a, b: the node of the smaller hash first, which is a bucket's first hub wherever that is one of them."""
    swap = F.xxhash64(x) > F.xxhash64(y)
    return pairs.select(F.when(swap, F.col(y)).otherwise(F.col(x)).alias("a"), F.when(swap, F.col(x)).otherwise(F.col(y)).alias("b"))


def _moved(edges: DataFrame, place: DataFrame) -> DataFrame:
    """The edges (a, b) between the places (node, comp) of their ends, without those that lie in one place."""
    for k in ("a", "b"):
        edges = edges.join(place.select(F.col("node").alias(k), F.col("comp").alias(f"_{k}")), k)
    return _ordered(edges.where("_a <> _b"), "_a", "_b").distinct()


def components(edges: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """node, comp of every node in `edges` (a, b) and in `known`, the components before: comp is one of its nodes.

    In each turn every place moves to its neighbour of the smallest hash (drawn anew, itself included) and on to where
    that one moves; edges then run between the new places, and those inside one are dropped.  So edges get fewer by a
    share in each turn whatever the shape, and edges that come later only join the places known before.
    """
    ends = edges.where("a <> b").select(F.explode(F.array("a", "b")).alias("node")).distinct()
    label = (ends if known is None else ends.join(known, "node", "left_anti")).select("node", F.col("node").alias("comp"))
    label = written(label if known is None else label.union(known), "labels")
    live = written(_moved(edges, label) if known is not None else _ordered(edges.where("a <> b"), "a", "b").distinct(), "edges")
    for turn in count():
        if live.isEmpty():
            return label
        rank = lambda x: F.struct(F.xxhash64(x, F.lit(turn)).alias("h"), F.col(x).alias("node"))
        near = live.union(live.select("b", "a")).groupBy("a").agg(F.min(rank("b")).alias("near"))
        up = written(near.select(F.col("a").alias("node"), F.least("near", rank("a"))["node"].alias("up")), "moves")
        jump = written(up.join(up.select(F.col("node").alias("up"), F.col("up").alias("comp")), "up").select("node", "comp"), "moves")
        label = label.join(jump.select(F.col("node").alias("comp"), F.col("comp").alias("_to")), "comp", "left")
        label = written(label.select("node", F.coalesce("_to", "comp").alias("comp")), "labels")
        live = written(_moved(live, jump), "edges")


def _mixed(bucket: DataFrame, comp: DataFrame) -> DataFrame:
    """key, node, comp, top (the largest component), size of the buckets whose nodes are in several components."""
    placed = written(bucket.join(comp, "node", "left").select("key", "node", F.coalesce("comp", "node").alias("comp")), "placed")
    sizes = placed.groupBy("key", "comp").agg(F.count("*").alias("n"))
    mixed = sizes.groupBy("key").agg(F.count("*").alias("k"), F.sum("n").alias("size"), F.max(F.struct("n", "comp")).alias("top")).where("k > 1")
    return written(placed.join(written(mixed.select("key", F.col("top.comp").alias("top"), "size"), "mixed"), "key"), "inside")


def classes(rows: DataFrame) -> DataFrame:
    """node, comp for the nodes of `rows` (from `signed`) that are linked with others; `_digest` for all nodes.

    Returns one row per distinct word sequence: _digest, node (the first row that has it), comp.
    """
    first = F.min(F.struct(F.col("doc_id").isNull().alias("z"), F.col("doc_id").alias("d"), F.col("_node").alias("n")))
    nodes = written(rows.groupBy("_digest").agg(first.alias("f")).select("_digest", F.col("f.n").alias("node"), F.col("f.d").alias("first_id")), "nodes")
    bands = rows.join(nodes.select(F.col("node").alias("_node")), "_node", "left_semi").select(F.col("_node").alias("node"), F.explode("_bands").alias("key"))
    bands = written(bands, "bands")
    # The node of the smallest hash is the hub of all its buckets, so a group of near copies meets few hubs at first.
    hubs = bands.groupBy("key").agg(F.min(F.struct(F.xxhash64("node").alias("h"), "node")).alias("hub"), F.count("*").alias("n"))
    hubs = written(hubs.where("n > 1").select("key", F.col("hub.node").alias("hub")), "hubs")
    bucket = written(bands.join(hubs, "key").select("key", "hub", "node"), "buckets")
    texts = rows.select("_node", "text").join(bucket.select(F.col("node").alias("_node")).distinct(), "_node", "left_semi")
    texts = written(texts, "texts")
    tried = written(_ordered(bucket.where("node <> hub"), "hub", "node").distinct(), "pairs")
    links = written(similar_pairs(tried, texts), "links", small=True)
    comp = components(links)
    for turn in range(HUB_TURNS + 1):
        inside = _mixed(bucket, comp)
        outer = inside.where("comp <> top")
        if outer.limit(1).count() == 0:
            break
        if turn < HUB_TURNS:
            # Nodes outside a bucket's largest component against one node of it, another one each turn.
            draw = F.min(F.struct(F.xxhash64("node", "key", F.lit(turn)).alias("h"), "node"))
            other = written(inside.where("comp = top").groupBy("key").agg(draw.alias("hub")).select("key", F.col("hub.node").alias("y")), "hubs")
            cross = outer.select("key", F.col("node").alias("x")).join(other, "key")
        else:
            # And where that leaves several components, against all nodes of the others.
            small, large = F.col("size") <= DIRECT, F.col("size") > DIRECT
            some = outer.where(small).select("key", F.col("node").alias("x"), F.col("comp").alias("cx"))
            cross = some.join(inside.where(small).select("key", F.col("node").alias("y"), F.col("comp").alias("cy")), "key").where("cx <> cy")
        cross = cross.select("x", "y")
        if turn == HUB_TURNS:
            probe, index = (written(x.where(large).select("node", "comp").distinct(), "large") for x in (outer, inside))
            cross = cross.union(prefix_pairs(probe, index, texts))
        fresh = written(_ordered(cross, "x", "y").distinct().join(tried, ["a", "b"], "left_anti"), "pairs")
        more = written(similar_pairs(fresh, texts), "links", small=True)
        tried = tried.union(fresh)
        if more.limit(1).count():
            comp = components(more, comp)
    return nodes.join(comp, "node", "left").select("_digest", "node", "first_id", F.coalesce("comp", "node").alias("comp"))


def label(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """`signed(docs)` and, by `_node`, each row's class: class_id and whether it is the row that stays."""
    rows = signed(docs)
    nodes = written(classes(rows), "classes")
    best = nodes.groupBy("comp").agg(F.min(F.struct(F.col("first_id").isNull().alias("z"), F.col("first_id").alias("d"), F.col("node").alias("n"))).alias("f"))
    owners = written(nodes.join(best, "comp").select("_digest", F.col("f.d").alias("class_id"), F.col("f.n").alias("_stays")), "owners")
    named = rows.select("_node", "doc_id", "_digest").join(owners, "_digest")
    return rows, named.select("_node", "doc_id", "class_id", (F.col("_node") == F.col("_stays")).alias("kept"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, class_id (the smallest doc_id of its class), kept of every row.

    Two texts are linked if the sets of their shingles of five words (lower-case runs of letters, marks and digits; of
    fewer words, all of them) have a similarity of 0.8 or more; classes are the connected components.  Texts of equal
    word sequences are in one class; texts without words, null and empty ones too, only with equal texts (null counts
    as empty).  Just one row of a class is kept, also of repeated rows; null ids come last.  An empty table gives no
    rows; texts may be of any length; columns other than doc_id and text are not read.  Links are not counted: a class
    of many copies is settled by a few of its pairs, and all of them would be as many as the square of its size.
    """
    return label(docs.select("doc_id", "text"))[1].select("doc_id", "class_id", "kept")


def keep(docs: DataFrame) -> DataFrame:
    """The rows of `docs` that stay, one of each class, with all columns; same rule as `near_duplicates`.

    Columns may have any names: only doc_id and text are looked at.
    """
    names = docs.columns
    rows, named = label(docs.toDF(*(c if c in ("doc_id", "text") else f"c{i}" for i, c in enumerate(names))))
    return rows.join(named.where("kept").select("_node"), "_node", "left_semi").drop("_node", "_digest", "_bands").toDF(*names)


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, class_id, kept of every row of `documents`; see `near_duplicates`."""
    return near_duplicates(table(spark, sf_dir, "documents"))
