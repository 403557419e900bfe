"""Language identification in two levels: the family first, then linear support vector machines between its languages.

Texts are seen as counts of letter pairs, triples and quadruples (of bytes, lower case, words set off by a space), hashed
into a table.  Languages whose mean profiles are alike form a family: average linkage goes on while two groups are more
alike than languages are on average.  One machine a family (one in all for two) tells families apart, and within a family
one machine for every two languages votes.  They are trained by dual coordinate descent, without a constant term, so what
they decide doesn't depend on a text's length; a slope fitted on texts set aside turns their margins into probabilities.

Scoring gathers each gram's row of weights from the table and adds up rows by document, so a text of any length is read
whole in slices.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import frugal, on_workers, steps, table, written
from .flat import flat_bytes

BITS = 17
ORDERS = (2, 3, 4)
#: Stands before and after each text.
_EDGE = 1
_KEPT = np.arange(256, dtype=np.uint8)
_KEPT[:128] = 32
_KEPT[97:123] = np.arange(97, 123)

#: What a text without letters, or any text where no language was learned, is said to be in.
NONE = "und"


@dataclass
class Grams:
    """Table rows of all grams of a batch, by order, with 2**BITS where there is none, and where each text begins."""

    rows: list[np.ndarray]
    starts: np.ndarray


def grams(texts: pa.Array) -> Grams:
    data, bounds = flat_bytes(pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), "")))
    flat = np.insert(_KEPT[data], bounds, _EDGE)
    starts = bounds + np.arange(len(bounds))
    again = (flat == 32) & np.concatenate([[False], (flat[:-1] == 32) | (flat[:-1] == _EDGE)])
    starts = starts - np.concatenate([[0], np.cumsum(again)])[starts]
    flat = flat[~again]
    edge, code, rows = flat == _EDGE, flat.astype(np.uint64), []
    crossing = np.zeros(len(flat), bool)
    for n in range(2, max(ORDERS) + 1):
        # Grams that start at each place; those that would run over the end of a text or of all get no row.
        code = (code << np.uint64(8))[: len(flat) - n + 1] | flat[n - 1 :].astype(np.uint64)
        if n > 2:
            crossing = crossing[: len(code)] | edge[n - 2 : n - 2 + len(code)]
        else:
            crossing = edge[:-1] & edge[1:]
        if n in ORDERS:
            row = ((code + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - BITS)).astype(np.int64)
            row[crossing] = 1 << BITS
            rows.append(np.concatenate([row, np.full(len(flat) - len(row), 1 << BITS)]))
    return Grams(rows, starts)


@dataclass
class Model:
    """Languages by family, a column of weights for each machine, and the slopes of both levels."""

    families: list[list[str]]
    weights: np.ndarray  # (2**BITS + 1, machines), the last row empty
    pairs: list[tuple[int, int, int]] = field(default_factory=list)  # (family, language, language) of each later column
    slopes: tuple[float, float] = (1.0, 1.0)

    @property
    def family_columns(self) -> int:
        return 0 if len(self.families) < 2 else 1 if len(self.families) == 2 else len(self.families)


def margins(m: Model, g: Grams) -> np.ndarray:
    """Mean weight of each text's grams by machine; zeros for a text without grams."""
    total = np.zeros((len(g.rows[0]), m.weights.shape[1]), np.float32)
    there = np.zeros(len(g.rows[0]), np.int64)
    for row in g.rows:
        total += m.weights[row]
        there += row < 1 << BITS
    first = g.starts[:-1]
    if not len(first):
        return np.zeros((0, m.weights.shape[1]))
    return np.add.reduceat(total, first, axis=0, dtype=np.float64) / np.maximum(1, np.add.reduceat(there, first))[:, None]


def _chance(x: np.ndarray, slope: float) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(slope * x, -40, 40)))


def decide(m: Model, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Language (its place among all, family by family) and probability from margins: family first, then votes in it.

    Equal votes go to the greater sum of margins, then to the first language in order.
    """
    n, k = len(z), m.family_columns
    if k == 0:
        family, sure = np.zeros(n, np.int64), np.ones(n)
    elif k == 1:
        family, sure = (z[:, 0] < 0).astype(np.int64), _chance(np.abs(z[:, 0]), m.slopes[0])
    else:
        family = z[:, :k].argmax(axis=1)
        chance = _chance(z[:, :k], m.slopes[0])
        sure = chance.max(axis=1) / np.maximum(1e-12, chance.sum(axis=1))
    out, score, offset = np.zeros(n, np.int64), np.zeros(n), 0
    for f, languages in enumerate(m.families):
        own = np.flatnonzero(family == f)
        votes, sums, sides = (np.zeros((len(own), len(languages))) for _ in range(3))
        for column, (of, a, b) in enumerate(m.pairs, k):
            if of == f:
                x = z[own, column]
                votes[:, a] += x >= 0
                votes[:, b] += x < 0
                sums[:, a] += x
                sums[:, b] -= x
                p = _chance(x, m.slopes[1])
                sides[:, a] += p
                sides[:, b] += 1 - p
        best = np.lexsort((-np.tile(np.arange(len(languages)), (len(own), 1)), sums, votes), axis=1)[:, -1] if len(own) else np.zeros(0, np.int64)
        out[own] = offset + best
        inner = sides[np.arange(len(own)), best] / (len(languages) - 1) if len(languages) > 1 else np.ones(len(own))
        score[own] = sure[own] * inner
        offset += len(languages)
    return out, score


@dataclass
class Rows:
    """Sparse vectors: columns and values of each row."""

    columns: list[np.ndarray]
    values: list[np.ndarray]

    def part(self, chosen: np.ndarray) -> Rows:
        return Rows([self.columns[i] for i in chosen], [self.values[i] for i in chosen])


def machine(x: Rows, y: np.ndarray, cost: float = 10.0, epochs: int = 12, seed: int = 3) -> np.ndarray:
    """Weights of a linear support vector machine (squared hinge loss) by dual coordinate descent; y is 1 or -1.

    Classes count alike however many rows each has.
    """
    w, alpha = np.zeros((1 << BITS) + 1), np.zeros(len(y))
    share = np.where(y > 0, (y > 0).mean(), (y < 0).mean()) * 2
    damp = share / (2 * cost)
    norm = np.array([v @ v for v in x.values]) + damp
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(y)):
            c, v = x.columns[i], x.values[i]
            grad = y[i] * (w[c] @ v) - 1 + damp[i] * alpha[i]
            new = max(0.0, alpha[i] - grad / norm[i])
            if new != alpha[i]:
                w[c] += (new - alpha[i]) * y[i] * v
                alpha[i] = new
    return w


def grouped(names: list[str], profiles: np.ndarray) -> list[list[str]]:
    """Families of languages by average linkage of their profiles' cosines, while above the mean of all pairs."""
    unit = profiles / np.maximum(1e-12, np.linalg.norm(profiles, axis=1, keepdims=True))
    near = unit @ unit.T
    sets = [[i] for i in range(len(names))]
    mean = near[np.triu_indices(len(names), 1)].mean() if len(names) > 1 else 0.0
    while len(sets) > 1:
        best, a, b = max((near[np.ix_(sets[a], sets[b])].mean(), -a, -b) for a, b in combinations(range(len(sets)), 2))
        if best <= mean:
            break
        sets[-a] += sets.pop(-b)
    return sorted(sorted(names[i] for i in s) for s in sets)


def _slope(x: np.ndarray) -> float:
    """The slope under which right margins (positive where right) are likeliest, from a grid of powers of two."""
    if not len(x):
        return 1.0
    scale = max(1e-12, float(np.median(np.abs(x))))
    grid = [2.0**e / scale for e in range(-3, 4)]
    return min(grid, key=lambda s: float(np.log1p(np.exp(-np.clip(s * x, -40, 40))).mean()))


def train(x: Rows, langs: np.ndarray) -> Model:
    """A model from vectors of relative frequencies and their languages; every fourth row only serves to fit the slopes."""
    names = sorted(set(langs.tolist()))
    aside = np.random.default_rng(1).permutation(len(langs)) % 4 == 0
    used = np.flatnonzero(~aside | ~np.isin(langs, langs[~aside]))
    # Frequent grams would outweigh all others: columns are divided by the root of their mean, rows scaled to length 1.
    mean = np.full((1 << BITS) + 1, 1e-7)
    for i in used:
        mean[x.columns[i]] += x.values[i] / len(used)
    root = np.sqrt(mean)
    scaled = Rows(x.columns, [v / root[c] for c, v in zip(x.columns, x.values)])
    unit = Rows(x.columns, [v / max(1e-12, np.linalg.norm(v)) for v in scaled.values])
    profiles = np.zeros((len(names), (1 << BITS) + 1), np.float32)
    for i in used:
        profiles[names.index(langs[i]), unit.columns[i]] += unit.values[i]
    families = grouped(names, profiles)
    of = {lang: f for f, group in enumerate(families) for lang in group}
    family = np.array([of[lang] for lang in langs])
    m, columns = Model(families, np.zeros(0)), []
    for f in range(m.family_columns):
        columns.append(machine(unit.part(used), np.where(family[used] == f, 1.0, -1.0)))
    for f, group in enumerate(families):
        for a, b in combinations(range(len(group)), 2):
            own = used[np.isin(langs[used], (group[a], group[b]))]
            columns.append(machine(unit.part(own), np.where(langs[own] == group[a], 1.0, -1.0)))
            m.pairs.append((f, a, b))
    m.weights = np.stack([w / root for w in columns], axis=1).astype(np.float32) if columns else np.zeros(((1 << BITS) + 1, 0), np.float32)
    m.weights[-1] = 0
    z = np.array([x.values[i] @ m.weights[x.columns[i]] for i in np.flatnonzero(aside)]).reshape(int(aside.sum()), m.weights.shape[1])
    own_f, own_l = family[aside], langs[aside]
    right = [np.where(own_f == f, 1, -1) * z[:, f] for f in range(m.family_columns)]
    inner = [np.where(own_l == families[f][a], 1, -1)[k] * z[k, c] for c, (f, a, b) in enumerate(m.pairs, m.family_columns) for k in [np.isin(own_l, (families[f][a], families[f][b]))]]
    m.slopes = (_slope(np.concatenate(right) if right else np.zeros(0)), _slope(np.concatenate(inner) if inner else np.zeros(0)))
    return m


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text is 2 modulo 4; false for a null id, which training never reads either."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


#: Documents that training reads at most, spread evenly over languages (but 5 of each at least), and bytes of one of them.
SAMPLE, LONGEST = 1600, 1 << 17


def training_texts(docs: DataFrame, sample: int = SAMPLE, longest: int = LONGEST) -> DataFrame:
    """doc_id, lang, text of at most `sample` documents, as many of each language.

    Left out are held-out documents, null ids and languages, texts without a letter or of more than `longest` bytes, and
    documents of which rows name several languages.  Of a document's texts the least is taken.
    """
    size = F.octet_length("text")
    rows = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")) & (size <= longest) & F.col("text").rlike(r"\p{L}"))
    once = rows.groupBy("doc_id").agg(F.min("lang").alias("lang"), F.max("lang").alias("_other")).where("lang = _other").select("doc_id", "lang")
    counts = written(once.groupBy("lang").agg(F.count("*").alias("_n")), "languages")  # a row a language
    each = max(5, sample // max(1, counts.count()))
    # Hashes are even: a share that holds four times as many as wanted spares the window the rest of a common language.
    share = (F.xxhash64("doc_id") / 2.0**64 + 0.5) * F.col("_n") <= 4 * each
    once = once.join(F.broadcast(counts), "lang").where(share).drop("_n")
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id"))
    chosen = once.withColumn("_place", place).where(F.col("_place") <= each).drop("_place")
    return rows.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "lang").agg(F.min("text").alias("text"))


def featurised(texts: DataFrame) -> DataFrame:
    """lang and, of each text, table rows (32-bit integers) and relative frequencies (32-bit floats) of its grams."""
    on_workers(texts.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, most=1 << 20):
            g = grams(batch.column("text"))
            columns, values = [], []
            for s, e in zip(g.starts[:-1], g.starts[1:]):
                own, n = np.unique(np.concatenate([row[s:e] for row in g.rows]), return_counts=True)
                n = n[own < 1 << BITS].astype(np.float32)
                columns.append(own[own < 1 << BITS].astype("<i4").tobytes())
                values.append((n / max(1, n.sum())).astype("<f4").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("lang"), pa.array(columns, pa.binary()), pa.array(values, pa.binary())], ["doc_id", "lang", "columns", "values"])

    kinds = {f.name: f.dataType.simpleString() for f in texts.schema}
    return texts.mapInArrow(run, f"doc_id {kinds['doc_id']}, lang string, columns binary, values binary")


def fit(docs: DataFrame, sample: int = SAMPLE) -> Model | None:
    """A model from the sample that `training_texts` draws; None if it is empty."""
    rows = featurised(training_texts(docs, sample)).toArrow().sort_by([("lang", "ascending"), ("doc_id", "ascending")])
    if not rows.num_rows:
        return None
    x = Rows([np.frombuffer(c, "<i4").astype(np.int64) for c in rows.column("columns").to_pylist()], [np.frombuffer(v, "<f4").astype(np.float64) for v in rows.column("values").to_pylist()])
    return train(x, np.array(rows.column("lang").to_pylist()))


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """`docs` with `lang_pred` string and `score` double (0 to 1).

    A text that is null or has no letter is `und` with score 0, as are all without a model.  Whole texts are read, of any
    length; repeated rows get the same; columns of these names in the input are replaced, others stay.
    """
    spark = docs.sparkSession
    on_workers(spark)
    base = docs.drop("lang_pred", "score")
    schema = base.withColumn("lang_pred", F.lit("")).withColumn("score", F.lit(0.0)).schema
    if model is None:
        return base.withColumn("lang_pred", F.lit(NONE)).withColumn("score", F.lit(0.0))
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        names = np.array([lang for group in m.families for lang in group], object)
        for batch in steps(batches, most=1 << 20):
            text = batch.column("text")
            lettered = pc.fill_null(pc.match_substring_regex(text, r"\p{L}"), False).to_numpy(zero_copy_only=False)
            best, score = decide(m, margins(m, grams(text)))
            best = np.where(lettered, names[best], NONE)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(best, pa.string()), pa.array(np.where(lettered, score, 0.0))], [*batch.schema.names, "lang_pred", "score"])

    return base.mapInArrow(frugal(run), schema)


def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row of `documents`; see `identify`."""
    docs = table(spark, sf_dir, "documents")
    got = identify(docs.select("doc_id", "text"), fit(docs.select("doc_id", "text", "lang")))
    return got.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
