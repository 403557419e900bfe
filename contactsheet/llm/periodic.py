"""Periodic runs of words, seeded by minimizers at several scales.

Words of a batch of documents become numbers, the same within a document only, so that a repeat never spans documents.
The grams of 2, 4, 8... words get numbers from pairs of those of half the length, and only grams that occur twice in their
document go on, so long texts soon have few left.  At the scale of grams of k words, runs of periods in (k/2, k] are found:
every window of k/2 consecutive grams yields its least one (by scrambled number).  A run of at least four periods holds a
window and, one period on, the same window, so the same minimum comes again after exactly one period; and as k is no less
than the period, no equal gram lies between.  Equal neighbours among the minima at such a distance seed a run, which is
extended both ways by comparing words.  Periods too short for a scale are found by comparing each word with the one that
many places before.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import frugal, on_workers, steps, table
from .flat import mix64

#: A run has at least so many words, and so many times its period.
LEAST, TIMES = 6, 4
#: Periods up to this are found by direct comparison; the first scale has twice as many words.
DIRECT = 8


def _extended(words: np.ndarray, at: int, period: int, step: int = 256) -> tuple[int, int]:
    """Start and end of the longest stretch around `at` whose words equal those one period on, those included."""
    start, end = at, at
    while True:
        low = max(0, start - step)
        same = words[low:start] == words[low + period : start + period]
        wrong = np.flatnonzero(~same)
        start = low + int(wrong[-1]) + 1 if len(wrong) else low
        if len(wrong) or low == 0:
            break
    while True:
        high = min(len(words) - period, end + step)
        wrong = np.flatnonzero(words[end:high] != words[end + period : high + period])
        end = end + int(wrong[0]) if len(wrong) else high
        if len(wrong) or high == len(words) - period:
            break
    return start, end + period


def _short(words: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """Stretches of periods up to DIRECT, as (start, end, period)."""
    for q in range(1, min(DIRECT, len(words) - 1) + 1):
        same = np.concatenate([[False], words[q:] == words[:-q], [False]])
        edges = np.flatnonzero(same[1:] != same[:-1])
        starts, ends = edges[::2], edges[1::2] + q
        long = ends - starts >= max(LEAST, TIMES * q)
        for s, e in zip(starts[long].tolist(), ends[long].tolist()):
            yield s, e, q


def _minima(at: np.ndarray, value: np.ndarray, width: int) -> np.ndarray:
    """Indices of the least value, leftmost if equal, of each window of `width` (a power of two) places without a gap."""
    if len(value) < width:
        return np.empty(0, np.int64)
    least, index, size = value, np.arange(len(value)), 1
    while size < width:
        left, right = least[: len(least) - size], least[size:]
        index = np.where(right < left, index[size:], index[: len(index) - size])
        least, size = np.minimum(left, right), size * 2
    whole = at[width - 1 :] - at[: len(at) - width + 1] == width - 1
    return np.unique(index[whole])


def _seeds(at: np.ndarray, name: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and distances in (k/2, k] of equal neighbours among the minimizers of grams `name` at places `at`."""
    chosen = _minima(at, mix64(name), k // 2)
    place, own = at[chosen], name[chosen]
    order = np.lexsort((place, own))
    place, own = place[order], own[order]
    far = np.diff(place)
    good = (np.diff(own) == 0) & (far > k // 2) & (far <= k)
    return place[:-1][good], far[good]


def _doubled(at: np.ndarray, name: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and numbers of grams of 2k words that occur twice at least, from those of k words."""
    nxt = np.searchsorted(at, at + k)
    there = (nxt < len(at)) & (at[np.minimum(nxt, len(at) - 1)] == at + k)
    at, one, two = at[there], name[there], name[nxt[there]]
    return _repeated(at, one * (int(name.max(initial=0)) + 1) + two)


def _repeated(at: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places whose key occurs twice at least, with keys renumbered from 0."""
    order = np.argsort(key, kind="stable")
    ordered = key[order]
    fresh = np.concatenate([[True], ordered[1:] != ordered[:-1]]) if len(key) else np.empty(0, bool)
    number = np.cumsum(fresh) - 1
    many = np.bincount(number)[number] > 1 if len(key) else np.empty(0, bool)
    kept = order[many]
    back = np.argsort(kept)
    return at[kept[back]], number[many][back]


def runs(words: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs in an array of numbers, by start, then period.

    Numbers mustn't be so large that the square of their count overflows 64 bits.
    """
    found = set(_short(words))
    at, name = _repeated(np.arange(len(words)), words.astype(np.int64))
    k = 1
    while len(at):
        if k > DIRECT:
            places, far = _seeds(at, name, k)
            order = np.lexsort((places, far))
            done, period = -1, 0
            for place, q in zip(places[order].tolist(), far[order].tolist()):
                if q != period:
                    done, period = -1, q
                if place < done:
                    continue
                start, end = _extended(words, place, q)
                done = end - q
                if end - start >= max(LEAST, TIMES * q):
                    found.add((start, end, q))
        at, name = _doubled(at, name, k)
        k *= 2
    # A stretch of several periods has the multiples too, with the same ends: the smallest is its period.
    least: dict[tuple[int, int], int] = {}
    for start, end, q in found:
        least[start, end] = min(q, least.get((start, end), q))
    return sorted(((start, end - start, q) for (start, end), q in least.items()), key=lambda r: (r[0], r[2]))


def altered(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words after damage: from some place on, those of every tenth document repeat with a period that its id says."""
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    part = words[a : a + p]
    return words[:a] + (part * ((n - a) // p + 1))[: n - a]


_OUT = pa.schema([("doc_id", pa.int64()), ("n_runs", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64()), ("exponent_milli", pa.int64()), ("runs_sha256", pa.string()), ("collapsed_sha256", pa.string())])


def _row(doc_id: int | None, words: list[bytes], own: list[tuple[int, int, int]]) -> tuple:
    top = (None,) * 4
    for start, length, q in own:
        # In order of start and period, only a greater exponent replaces what was found.
        if top[0] is None or length * top[2] > top[1] * q:
            top = (start, length, q, 1000 * length // q)
    listed = hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in own).encode()).hexdigest()
    if own:
        change = np.zeros(len(words) + 1, np.int64)
        for s, n, q in own:
            change[s + q] += 1
            change[s + n] -= 1
        words = [w for w, out in zip(words, np.cumsum(change)[:-1].tolist()) if not out]
    return doc_id, len(own), *top, listed, hashlib.sha256(b" ".join(words)).hexdigest()


def _found(batches: Iterator[pa.RecordBatch], damage: bool) -> Iterator[pa.RecordBatch]:
    for batch in steps(batches):
        fresh, texts, numbers, bounds = count(), [], [], [0]
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
            words = (text or "").encode().split()  # of bytes: at [\x20\x09-\x0D] and nothing else
            texts.append(altered(words, doc_id) if damage else words)
            # Each document numbers its words anew, and one number that occurs once ends it.
            own = defaultdict(fresh.__next__)
            numbers.append(np.fromiter(map(own.__getitem__, texts[-1]), np.int64, len(texts[-1])))
            numbers.append(np.array([next(fresh)]))
            bounds.append(bounds[-1] + len(texts[-1]) + 1)
        mine: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        all_runs = runs(np.concatenate(numbers))
        for (start, length, q), k in zip(all_runs, np.searchsorted(bounds, [r[0] for r in all_runs], side="right") - 1):
            mine[k].append((start - bounds[k], length, q))
        rows = [_row(d, w, r) for d, w, r in zip(batch.column("doc_id").to_pylist(), texts, mine)]
        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), _OUT)], schema=_OUT)


def detect(docs: DataFrame, damage: bool = False) -> DataFrame:
    """doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256 of every document.

    A run is a stretch of words with a smallest period that it holds four times at least, six words at least, that can't be
    extended; start, length and period are of the run of the greatest exponent.  Collapsing drops every word of a run
    after its first period.  With `damage` every tenth document is made periodic first, as its id says; a null id isn't.
    Null, empty and blank texts have no runs and the hashes of nothing; repeated rows give repeated results, an empty table
    none; texts and words may be of any length; columns other than doc_id (a whole number) and text aren't read.
    """
    on_workers(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long"), "text")
    kinds = ", ".join(f"{f.name} {'string' if f.type == pa.string() else 'long'}" for f in _OUT)
    return rows.mapInArrow(frugal(lambda batches: _found(batches, damage)), kinds)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The runs of every row of `documents` after damage; see `detect`."""
    return detect(table(spark, sf_dir, "documents"), damage=True)
