"""Token ids in a compressed binary table: Re-Pair grammars with random access.

Documents are dealt by ranges of doc_id and sorted; each task makes blocks of about 12 MB of text, and each block is a
row of the file table: its rules, the expansion length of each rule, the compressed symbols and where each document
starts in them.  Re-Pair replaces the most frequent pairs of neighbouring symbols by new symbols, again and again.  Two
things make it fast enough for a corpus: many pairs are replaced in each pass, and the first passes work on the
block's distinct words weighted by how often they occur, where all pairs inside words are found; the passes over the
whole symbol row then only look for pairs across words.

A document's ids need its own symbols and the rules only (`read_ids`), and since expansion lengths are stored a slice
of them is found without expanding what lies before.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import count as forever

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import ENCODE_BYTES, Coded, automaton, tokenizer_path
from .common import frugal, on_workers, steps, table, written

#: One row per block.  rules: pairs of symbols, the k-th for symbol `terminals` + k; expansions: ids in each rule;
#: symbols: the compressed row; doc_symbols: symbols of each document; all little-endian unsigned 32-bit integers.
FILE_SCHEMA = "part int, block int, terminals int, doc_ids array<long>, doc_tokens array<long>, doc_symbols binary, rules binary, expansions binary, symbols binary"


#: Counters of pairs that share them by hash.
SLOT_BITS = 20
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _numbers(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x, "<u4").tobytes()


def _pass(symbols: np.ndarray, joined: np.ndarray, weight: np.ndarray | None, first: int, most: int, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One pass of Re-Pair: new symbols, which places remain, and the rules.

    joined[i]: whether place i and the next may be replaced together; weight: how often each place occurs.
    """
    none = np.empty((0, 2), np.int64)
    keep = np.ones(len(symbols), bool)
    at = np.flatnonzero(joined[:-1])
    if not len(at):
        return symbols, keep, none
    key = (symbols[at].astype(np.int64) << 32) | symbols[at + 1]
    # Pairs share counters by their hash first: what doesn't reach `least` even so isn't worth sorting.
    slot = (key.view(np.uint64) * _MIX >> np.uint64(64 - SLOT_BITS)).astype(np.int32)
    full = np.bincount(slot, None if weight is None else weight[at], 1 << SLOT_BITS) >= least
    likely = np.flatnonzero(full[slot])
    if not len(likely):
        return symbols, keep, none
    at, key = at[likely], key[likely]
    if weight is None:
        line = np.sort(key)
        edge = np.flatnonzero(np.concatenate([[True], line[1:] != line[:-1]]))
        pairs, count = line[edge], np.diff(np.append(edge, len(line)))
    else:
        order = np.argsort(key)
        line = key[order]
        edge = np.flatnonzero(np.concatenate([[True], line[1:] != line[:-1]]))
        pairs, count = line[edge], np.add.reduceat(weight[at][order], edge)
    good = np.flatnonzero(count >= least)
    if len(good) > most:
        good = good[np.argpartition(-count[good], most)[:most]]
    if not len(good):
        return symbols, keep, none
    chosen = np.sort(pairs[good])
    place = np.searchsorted(chosen, key)
    place[place == len(chosen)] = 0
    hit = chosen[place] == key
    spot, rule = at[hit], place[hit]
    # Of overlapping hits every second one is taken, from the left.
    fresh = np.concatenate([[True], spot[1:] != spot[:-1] + 1])
    run = np.maximum.accumulate(np.where(fresh, np.arange(len(spot)), 0))
    taken = (np.arange(len(spot)) - run) % 2 == 0
    spot, rule = spot[taken], rule[taken]
    out = symbols.copy()
    out[spot] = first + rule
    keep[spot + 1] = False
    return out, keep, np.stack([chosen >> 32, chosen & 0xFFFFFFFF], axis=1)


class Grammar:
    """Rules so far and how many ids each symbol stands for."""

    def __init__(self, terminals: int):
        self.terminals, self.rules, self.expansions = terminals, np.empty((0, 2), np.int64), np.empty(0, np.int64)

    def size(self, symbols: np.ndarray) -> np.ndarray:
        out = np.ones(len(symbols), np.int64)
        new = symbols >= self.terminals
        out[new] = self.expansions[symbols[new] - self.terminals]
        return out

    def add(self, rules: np.ndarray) -> None:
        more = self.size(rules[:, 0]) + self.size(rules[:, 1])
        self.rules, self.expansions = np.concatenate([self.rules, rules]), np.concatenate([self.expansions, more])

    @property
    def first(self) -> int:
        return self.terminals + len(self.rules)


def compress_rows(symbols: np.ndarray, bounds: np.ndarray, weight: np.ndarray | None, grammar: Grammar, passes: int | None, most: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Re-Pair over rows of symbols (row k is symbols[bounds[k]:bounds[k + 1]]; weight: how often it occurs).

    Without `passes` it goes on until no pair occurs `least` times.
    """
    for _ in forever() if passes is None else range(passes):
        if len(symbols) < 2:
            break
        joined = np.ones(len(symbols), bool)
        joined[bounds[1:][bounds[1:] > 0] - 1] = False
        each = None if weight is None else np.repeat(weight, np.diff(bounds))
        symbols, keep, rules = _pass(symbols, joined, each, grammar.first, most, least)
        if not len(rules):
            break
        grammar.add(rules)
        bounds = np.concatenate([[0], np.cumsum(keep)])[bounds]
        symbols = symbols[keep]
    return symbols, bounds


def compress(coded: Coded, terminals: int, end_id: int, word_passes: int = 4, passes: int | None = None, most: int = 4096, least: int = 16) -> tuple[Grammar, np.ndarray, np.ndarray, np.ndarray]:
    """Grammar, symbols, symbols of each document and ids of each document; every document ends with `end_id`."""
    grammar = Grammar(terminals)
    per = coded.count[coded.codes]
    tokens = np.diff(np.concatenate([[0], np.cumsum(per)])[coded.docs]) + 1
    weight = np.bincount(coded.codes, minlength=len(coded.count))
    flat, bounds = compress_rows(coded.flat.astype(np.int64), np.concatenate([[0], np.cumsum(coded.count)]), weight, grammar, word_passes, most, least)
    symbols, docs = Coded(coded.codes, coded.docs, flat.astype(np.int32), np.diff(bounds)).spread()
    symbols, docs = compress_rows(symbols, docs, None, grammar, passes, most, least)
    symbols = np.insert(symbols, docs[1:], end_id)
    return grammar, symbols, np.diff(docs) + 1, tokens


def write_ids(docs: DataFrame, path: str | None = None, end_id: int = 0) -> DataFrame:
    """The file table (FILE_SCHEMA) of all documents in ascending doc_id order, null ids first.

    Null texts count as empty: such a document is the end id alone.  Rows with the same doc_id follow each other in the
    order of their texts' hashes.  An empty table gives an empty file table; other columns are not read.
    """
    on_workers(docs.sparkSession)
    path = path or tokenizer_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = automaton(path)
        part = TaskContext.get().partitionId()
        for k, batch in enumerate(steps(_joined(batches), most=ENCODE_BYTES)):
            grammar, symbols, own, tokens = compress(a.coded(batch.column("text")), len(a.labels), end_id)
            one = [part, k, len(a.labels), batch.column("doc_id").to_pylist(), tokens.tolist(), _numbers(own), _numbers(grammar.rules), _numbers(grammar.expansions), _numbers(symbols)]
            kinds = [pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), *[pa.binary()] * 4]
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(one, kinds)], [f.split(" ")[0] for f in FILE_SCHEMA.split(", ")])

    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("_tie"))
    return keyed.repartitionByRange("doc_id", "_tie").sortWithinPartitions("doc_id", "_tie").select("doc_id", "text").mapInArrow(frugal(run), FILE_SCHEMA)


def _joined(batches: Iterator[pa.RecordBatch], most: int = ENCODE_BYTES) -> Iterator[pa.RecordBatch]:
    """Small Arrow batches put together up to about `most` bytes."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= most:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
    if any(b.num_rows for b in held):
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def expansions(terminals: int, rules: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ids of every symbol in a row, where each symbol's begin and how many they are."""
    length = np.concatenate([np.ones(terminals, np.int64), sizes])
    start = np.cumsum(length) - length
    flat = np.zeros(int(length.sum()), np.uint32)
    flat[:terminals] = np.arange(terminals)
    for k, (x, y) in enumerate(rules.tolist(), terminals):
        s, m = start[k], length[x]
        flat[s : s + m] = flat[start[x] : start[x] + m]
        flat[s + m : s + length[k]] = flat[start[y] : start[y] + length[y]]
    return flat, start, length


def _open(terminals: int, rules: bytes, sizes: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return expansions(terminals, np.frombuffer(rules, "<u4").reshape(-1, 2).astype(np.int64), np.frombuffer(sizes, "<u4").astype(np.int64))


def _spread(symbols: np.ndarray, flat: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    per = length[symbols]
    index = np.repeat(start[symbols] - (np.cumsum(per) - per), per)
    index += np.arange(len(index))
    return flat[index]


def read_ids(row: dict, doc: int, begin: int = 0, stop: int | None = None) -> np.ndarray:
    """Ids begin..stop of the block's document number `doc`; expands only the symbols that hold them."""
    flat, start, length = _open(row["terminals"], row["rules"], row["expansions"])
    own = np.frombuffer(row["doc_symbols"], "<u4").astype(np.int64)
    edge = np.concatenate([[0], np.cumsum(own)])
    symbols = np.frombuffer(row["symbols"], "<u4")[edge[doc] : edge[doc + 1]].astype(np.int64)
    ends = np.cumsum(length[symbols])
    stop = int(ends[-1]) if stop is None else min(stop, int(ends[-1]))
    if begin >= stop:
        return np.empty(0, np.uint32)
    a, b = int(np.searchsorted(ends, begin, side="right")), int(np.searchsorted(ends, stop)) + 1
    skipped = int(ends[a] - length[symbols[a]])
    return _spread(symbols[a:b], flat, start, length)[begin - skipped : stop - skipped]


def read_back(files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, from the file table alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                flat, start, length = _open(row["terminals"], row["rules"], row["expansions"])
                ids = _spread(np.frombuffer(row["symbols"], "<u4").astype(np.int64), flat, start, length).astype("<u4", copy=False)
                tokens = np.array(row["doc_tokens"], np.int64)
                ends = np.cumsum(tokens)
                crc = [zlib.crc32(ids[s:e]) for s, e in zip((ends - tokens).tolist(), ends.tolist())]
                n = len(tokens)
                yield pa.RecordBatch.from_arrays([pa.array([row["part"]] * n, pa.int32()), pa.array([row["block"]] * n, pa.int32()), pa.array(row["doc_ids"], pa.int64()), pa.array(ends - tokens), pa.array(tokens), pa.array(crc, pa.int64())], ["part", "block", "doc_id", "_within", "n_tokens", "ids_crc32"])

    size = F.aggregate("doc_tokens", F.lit(0).cast("long"), lambda a, x: a + x)
    blocks = files.select("part", "block", size.alias("_size"))
    # Ids before each part (one row per part) and before each block within its part.
    parts = blocks.groupBy("part").agg(F.sum("_size").alias("_all"))
    parts = parts.select("part", (F.sum("_all").over(Window.orderBy("part")) - F.col("_all")).alias("_base"))
    inner = F.sum("_size").over(Window.partitionBy("part").orderBy("block")) - F.col("_size")
    before = blocks.withColumn("_inner", inner).join(parts, "part").select("part", "block", (F.col("_base") + F.col("_inner")).alias("_before"))
    read = files.mapInArrow(frugal(run), "part int, block int, doc_id long, _within long, n_tokens long, ids_crc32 long")
    return read.join(before, ["part", "block"]).select("doc_id", (F.col("_before") + F.col("_within")).alias("start"), "n_tokens", "ids_crc32")


def op10_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every row of `documents`, read back from the file table; see `write_ids`."""
    return read_back(written(write_ids(table(spark, sf_dir, "documents")), "token-ids"))
