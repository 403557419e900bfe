"""Toxicity by a convolutional text classifier, trained in numpy.

A word's embedding is the sum of two rows of a hashed table, one for the word and one for its beginning, so inflected
and compound forms share evidence.  Filters of several widths run over the embeddings; each filter's largest answer in
the whole text (max pooling) feeds a logistic output.  Wide filters share one weight vector over their window, which
makes them cheap running sums and sensitive to dense use of mildly suspicious words.

The classifier is fitted on a bounded sample of labelled documents (`sample` of each class, those with the smallest
hashes), a part of which is kept aside to calibrate one threshold per language.  Languages are recognised from function
words of the text; the `lang` column is never read.  Scores are shifted so that 0.5 is the threshold everywhere.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import frugal, on_workers, release, steps, table
from .flat import Words, segment_hash

#: Frequent function words by language.
FUNCTION_WORDS = {
    "en": "the and of to in is that for it as was with be by on not this are have from at or an which they had his her you",
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie",
    "fr": "de la le et les des en un du une que est pour qui dans par plus pas au sur ne se ce il sont avec elle aux",
    "es": "de la que el en y a los del se las por un para con no una su al lo como más pero sus le ya o",
}
WIDTHS = (1, 2, 3)
WIDE = (12, 48)


@dataclass
class Model:
    """Parameters; `filters[w]`: (width, dims, n), `wide[w]`: (dims, n).  `shift`: threshold per language number."""

    bits: int = 18
    dims: int = 8
    each: int = 8
    seed: int = 3
    table: np.ndarray = field(default=None)  # type: ignore[assignment]
    filters: dict[int, np.ndarray] = field(default_factory=dict)
    wide: dict[int, np.ndarray] = field(default_factory=dict)
    bias: np.ndarray = field(default=None)  # type: ignore[assignment]
    out: np.ndarray = field(default=None)  # type: ignore[assignment]
    base: float = 0.0
    shift: np.ndarray = field(default_factory=lambda: np.zeros(len(FUNCTION_WORDS) + 1))
    slope: float = 1.0

    def __post_init__(self) -> None:
        if self.table is None:
            rng = np.random.default_rng(self.seed)
            self.table = rng.normal(0, 0.05, (1 << self.bits, self.dims)).astype(np.float32)
            for w in WIDTHS:
                self.filters[w] = rng.normal(0, 0.3, (w, self.dims, self.each)).astype(np.float32)
                self.filters[w][:, 0, : self.each // 2] = 1.0 / w
            for w in WIDE:
                self.wide[w] = rng.normal(0, 0.1, (self.dims, self.each)).astype(np.float32)
                self.wide[w][0, : self.each // 2] = 0.3
            n = self.each * (len(WIDTHS) + len(WIDE))
            self.bias, self.out = np.zeros(n, np.float32), np.full(n, 0.1, np.float32)


@dataclass
class Batch:
    """Table rows of each word (the word's and its beginning's), word offsets of the documents, and their languages."""

    one: np.ndarray
    two: np.ndarray
    docs: np.ndarray
    language: np.ndarray


_FUNCTION_HASHES: list[np.ndarray] = []


def _function_hashes() -> list[np.ndarray]:
    if not _FUNCTION_HASHES:
        for words in FUNCTION_WORDS.values():
            raw = [w.encode() for w in words.split()]
            size = np.array([len(w) for w in raw])
            _FUNCTION_HASHES.append(np.sort(segment_hash(np.frombuffer(b"".join(raw), np.uint8), np.cumsum(size) - size, size)))
    return _FUNCTION_HASHES


def read(texts: pa.Array, bits: int) -> Batch:
    words = Words(texts)
    full = words.hashes()
    head = words.hashes(most=6)
    shift = np.uint64(64 - bits)
    hits = np.zeros((len(words.docs) - 1, len(FUNCTION_WORDS) + 1), np.int64)
    hits[:, -1] = 0
    for k, known in enumerate(_function_hashes()):
        place = np.searchsorted(known, full)
        place[place == len(known)] = 0
        hits[:, k] = np.diff(np.concatenate([[0], np.cumsum(known[place] == full)])[words.docs])
    language = np.where(hits.max(axis=1) > 0, hits.argmax(axis=1), len(FUNCTION_WORDS))
    return Batch((full >> shift).astype(np.int64), (head * np.uint64(0x9E3779B97F4A7C15) >> shift).astype(np.int64), words.docs, language)


#: Words whose filter answers are held at once, so that no text is too long; windows reach beyond as far as they need.
STEP_WORDS = 1 << 16


def _answers(m: Model, e: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Filter answers at each word: rows of (words, filters).  Windows end at `stop`, the end of the word's document."""
    n = len(e)
    stop = np.minimum(stop, n)
    room = stop - np.arange(n)
    parts = []
    for w in WIDTHS:
        z = e @ m.filters[w][0]
        for j in range(1, w):
            more = e[j:] @ m.filters[w][j]
            more[room[: n - j] <= j] = 0
            z[: n - j] += more
        parts.append(z)
    for w in WIDE:
        run = np.concatenate([np.zeros((1, m.each)), np.cumsum(e @ m.wide[w], axis=0, dtype=np.float64)])
        parts.append((run[np.minimum(np.arange(n) + w, stop)] - run[:n]).astype(np.float32))
    return np.concatenate(parts, axis=1)


def _pooled(m: Model, b: Batch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Documents that have words, embeddings, answers and the largest answer of each filter."""
    e = m.table[b.one] + m.table[b.two]
    z = _answers(m, e, np.repeat(b.docs[1:], np.diff(b.docs)))
    there = np.flatnonzero(np.diff(b.docs))
    top = np.maximum.reduceat(z, b.docs[:-1][there], axis=0) if len(there) else np.zeros((0, z.shape[1]), np.float32)
    return there, e, z, top


def logits(m: Model, b: Batch) -> np.ndarray:
    size = np.diff(b.docs)
    stop, owner = np.repeat(b.docs[1:], size), np.repeat(np.arange(len(size)), size)
    top = np.full((len(size), len(m.out)), -np.inf, np.float32)
    for s in range(0, len(owner), STEP_WORDS):
        t = min(s + STEP_WORDS, len(owner))
        u = min(t + max(WIDTHS + WIDE) - 1, len(owner))
        z = _answers(m, m.table[b.one[s:u]] + m.table[b.two[s:u]], stop[s:u] - s)[: t - s]
        first = np.flatnonzero(np.diff(owner[s:t], prepend=-1))
        of = owner[s:t][first]
        top[of] = np.maximum(top[of], np.maximum.reduceat(z, first, axis=0))
    out = np.full(len(size), -1e3)
    there = np.flatnonzero(size)
    out[there] = np.maximum(top[there] + m.bias, 0) @ m.out + m.base
    return out


def scores(m: Model, b: Batch) -> np.ndarray:
    """0 to 1, and 0.5 just at the threshold of the text's language; a text without words scores 0."""
    z = (logits(m, b) - m.shift[b.language]) * m.slope
    return 1 / (1 + np.exp(-np.clip(z, -50, 50))) * (np.diff(b.docs) > 0)


def _groups(b: Batch, order: np.ndarray, docs: int, words: int) -> Iterator[np.ndarray]:
    """`order` in runs of at most `docs` documents and `words` words, a document at least."""
    ends = np.cumsum(np.diff(b.docs)[order])
    start = 0
    while start < len(order):
        done = int(ends[start - 1]) if start else 0
        stop = min(start + docs, max(start + 1, int(np.searchsorted(ends, done + words, side="right"))))
        yield order[start:stop]
        start = stop


def _part(b: Batch, rows: np.ndarray) -> Batch:
    size = np.diff(b.docs)[rows]
    docs = np.concatenate([[0], np.cumsum(size)])
    take = np.repeat(b.docs[rows] - docs[:-1], size) + np.arange(docs[-1])
    return Batch(b.one[take], b.two[take], docs, b.language[rows])


def _prior(m: Model, b: Batch, y: np.ndarray, evidence: float = 12.0) -> None:
    """First dimension of the table: the log odds of toxicity given the word, for words with enough evidence.

    Evidence is the documents that hold the word times the divergence of their share of toxic ones from the sample's;
    below the limit a rare word of a toxic document would count as much as a telling one.
    """
    p = y.mean()
    for name in ("one", "two"):
        n, yes = np.zeros(1 << m.bits), np.zeros(1 << m.bits)
        for group in _groups(b, np.arange(len(y)), len(y), 8 * STEP_WORDS):
            part = _part(b, group)
            doc = np.repeat(np.arange(len(group)), np.diff(part.docs))
            seen = np.unique(doc * np.int64(1 << m.bits) + getattr(part, name))
            at, of = seen & ((1 << m.bits) - 1), seen >> m.bits
            n += np.bincount(at, minlength=1 << m.bits)
            yes += np.bincount(at, y[group][of], 1 << m.bits)
        q = (yes + 0.5 * p) / (n + 0.5)
        divergence = q * np.log(q / p) + (1 - q) * np.log((1 - q) / (1 - p))
        odds = np.log(q / (1 - q)) - np.log(p / (1 - p))
        m.table[:, 0] += (0.5 * np.clip(odds, 0, 4) * (n * divergence >= evidence)).astype(np.float32)


def train(b: Batch, y: np.ndarray, epochs: int = 8, size: int = 64, rate: float = 0.01) -> Model:
    m = Model()
    rng = np.random.default_rng(m.seed)
    _prior(m, b, y)
    slices = {w: slice(i * m.each, (i + 1) * m.each) for i, w in enumerate((*WIDTHS, *WIDE))}
    state: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    step = 0

    def adam(name: str, value: np.ndarray, grad: np.ndarray) -> None:
        one, two = state.setdefault(name, (np.zeros_like(value), np.zeros_like(value)))
        one *= 0.9
        one += 0.1 * grad
        two *= 0.99
        two += 0.01 * grad * grad
        value -= rate * (one / (1 - 0.9**step)) / (np.sqrt(two / (1 - 0.99**step)) + 1e-8)

    base = np.array([0.0], np.float32)
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for rows in _groups(b, order, size, 2 * STEP_WORDS):
            step += 1
            part, target = _part(b, rows), y[rows]
            there, e, z, top = _pooled(m, part)
            if not len(there):
                continue
            active = np.maximum(top + m.bias, 0)
            error = ((1 / (1 + np.exp(-np.clip(active @ m.out + base[0], -30, 30)))) - target[there]) / len(there)
            back = error[:, None] * m.out * (active > 0)
            # The first place in each document where a filter's answer is its largest.
            spot = np.repeat(np.arange(len(there)), np.diff(part.docs)[there])
            hit_row, hit_filter = np.nonzero(z == top[spot])
            key = spot[hit_row] * z.shape[1] + hit_filter
            _, first = np.unique(key, return_index=True)
            at, fil, doc = hit_row[first], hit_filter[first], spot[hit_row[first]]
            stop = part.docs[1:][there][doc]
            grad_e: list[tuple[np.ndarray, np.ndarray]] = []
            for w in (*WIDTHS, *WIDE):
                own = (fil >= slices[w].start) & (fil < slices[w].stop)
                a, f, g, end = at[own], fil[own] - slices[w].start, back[doc[own], fil[own]], stop[own]
                live = g != 0
                a, f, g, end = a[live], f[live], g[live].astype(np.float32), end[live]
                if w in m.wide:
                    grad = np.zeros_like(m.wide[w])
                    count = np.minimum(end - a, w)
                    rep = np.repeat(np.arange(len(a)), count)
                    places = a[rep] + np.arange(len(rep)) - np.repeat(np.cumsum(count) - count, count)
                    np.add.at(grad.T, f[rep], g[rep, None] * e[places])
                    grad_e.append((places, g[rep, None] * m.wide[w].T[f[rep]]))
                    adam(f"wide{w}", m.wide[w], grad)
                    continue
                grad = np.zeros_like(m.filters[w])
                for j in range(w):
                    ok = a + j < end
                    np.add.at(grad[j].T, f[ok], g[ok, None] * e[a[ok] + j])
                    grad_e.append((a[ok] + j, g[ok, None] * m.filters[w][j].T[f[ok]]))
                adam(f"filter{w}", m.filters[w], grad)
            places, grads = np.concatenate([p for p, _ in grad_e]), np.concatenate([g for _, g in grad_e])
            for slots in (part.one[places], part.two[places]):
                np.add.at(m.table, slots, -0.5 * grads)  # plain descent: the table is large and touched sparsely
            adam("bias", m.bias, back.sum(axis=0).astype(np.float32))
            adam("out", m.out, (active.T @ error).astype(np.float32))
            adam("base", base, np.array([error.sum()], np.float32))
    m.base = float(base[0])
    return m


def _threshold(z: np.ndarray, y: np.ndarray, care: float = 3.0) -> float:
    """The middle of the widest gap among the best cuts: the share of toxic texts missed plus `care` times the share of
    clean ones hit is least."""
    order = np.argsort(z)
    z, y = z[order], y[order]
    missed, hit = y / max(1, y.sum()), (1 - y) / max(1, (1 - y).sum()) * care
    cost = hit.sum() + np.concatenate([[0.0], np.cumsum(missed - hit)])
    edges = np.concatenate([[z[0] - 1], (z[1:] + z[:-1]) / 2, [z[-1] + 1]])
    gap = np.concatenate([[0], z[1:] - z[:-1], [0]])
    return float(edges[np.where(cost <= cost.min() + 1e-9, gap, -1).argmax()])


def calibrate(m: Model, b: Batch, y: np.ndarray, least: int = 20) -> None:
    """One threshold per language, all languages' where fewer than `least` of either class are at hand."""
    z = logits(m, b)
    there = np.diff(b.docs) > 0
    if not there.any() or y[there].min() == y[there].max():
        return
    m.shift[:] = _threshold(z[there], y[there])
    for k in range(len(m.shift)):
        own = there & (b.language == k)
        if y[own].sum() >= least and (1 - y[own]).sum() >= least:
            m.shift[k] = _threshold(z[own], y[own])


#: Bytes of texts of each class that training reads at most.
SAMPLE_BYTES = 24 << 20


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text is divisible by 5; false for a null id, which training never reads either."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def training_texts(docs: DataFrame, labels: DataFrame, sample: int = 2500, most: int = SAMPLE_BYTES) -> DataFrame:
    """doc_id, text, toxic of at most `sample` labelled documents and `most` bytes of whole texts of each class.

    A document counts once, with the least of its texts.  Texts of more than a sixteenth of `most` are left out, and so
    are documents whose labels contradict each other, with labels other than 0 and 1, with a null id, and held-out ones.
    """
    usable = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    usable = usable.groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("_other")).where("toxic = _other").select("doc_id", "toxic")
    chosen = [usable.where(F.col("toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for label in (0, 1)]
    chosen = chosen[0].unionByName(chosen[1])  # at most 2 * sample rows
    once = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint")
    so_far = F.sum(size).over(Window.partitionBy("toxic").orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, 0))
    return once.where(size <= most // 16).withColumn("_bytes", so_far).where(F.col("_bytes") <= most).select("doc_id", "text", "toxic")


def featurised(texts: DataFrame, bits: int = Model.bits) -> DataFrame:
    """doc_id, toxic and, of each text, the table rows of its words as 32-bit integers (`one`, `two`) and its language.

    This is all that training needs, so neither texts nor the work of reading them reach the driver.
    """
    on_workers(texts.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, most=2 << 20):
            b = read(batch.column("text"), bits)
            one, two = (pa.array([x.astype("<i4").tobytes() for x in np.split(v, b.docs[1:-1])], pa.binary()) for v in (b.one, b.two))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), one, two, pa.array(b.language, pa.int32())], ["doc_id", "toxic", "one", "two", "language"])

    kinds = {f.name: f.dataType.simpleString() for f in texts.schema}
    return texts.mapInArrow(run, f"doc_id {kinds['doc_id']}, toxic {kinds['toxic']}, one binary, two binary, language int")


def fit(docs: DataFrame, labels: DataFrame, sample: int = 2500) -> Model | None:
    """A model from the sample that `training_texts` draws; None if it lacks either class."""
    rows = featurised(training_texts(docs, labels, sample)).toArrow().sort_by("doc_id")
    y = rows.column("toxic").to_numpy().astype(np.float64)
    if not len(y) or y.min() == y.max():
        return None
    one, two = ([np.frombuffer(x, "<i4") for x in rows.column(c).to_pylist()] for c in ("one", "two"))
    bounds = np.concatenate([[0], np.cumsum([len(x) for x in one])])
    batch = Batch(np.concatenate(one), np.concatenate(two), bounds, rows.column("language").to_numpy().astype(np.int64))
    del one, two, rows
    turn = np.random.default_rng(5).permutation(len(y))
    aside, used = np.sort(turn[: len(y) // 4]), np.sort(turn[len(y) // 4 :])
    if y[used].min() == y[used].max():
        aside = used = np.arange(len(y))
    m = train(_part(batch, used), y[used])
    calibrate(m, _part(batch, aside), y[aside])
    del batch
    release()  # what follows in this driver, other stages say, needs its memory
    return m


def score(docs: DataFrame, model: Model | None, threshold: float = 0.5) -> DataFrame:
    """`docs` with `score` double (0 to 1) and `predicted` int (1 if the score reaches `threshold`).

    Texts that are null, empty or without words score 0, as all do if there is no model.  Whole texts are read; repeated
    rows score alike; columns of the same names in the input are replaced, others stay.
    """
    spark = docs.sparkSession
    on_workers(spark)
    base = docs.drop("score", "predicted")
    schema = base.withColumn("score", F.lit(0.0)).withColumn("predicted", F.lit(0)).schema
    if model is None:
        return base.withColumn("score", F.lit(0.0)).withColumn("predicted", F.lit(int(threshold <= 0)))
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in steps(batches, most=2 << 20):
            s = scores(m, read(batch.column("text"), m.bits))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s), pa.array((s >= threshold).astype(np.int32))], [*batch.schema.names, "score", "predicted"])

    return base.mapInArrow(frugal(run), schema)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of `documents`; null, empty and wordless texts score 0."""
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"))
    scored = score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
