"""Records of JSON arrays of any size, read by as many tasks as Spark splits the file into.

Spark's text source, with `}` for the end of a line, splits a file anywhere and gives each split's pieces in order.  What
a split holds depends on whether it begins inside a string and how deep in brackets, which only all before it tells.  So
a first pass sums up each split for either case (whether it leaves strings as it found them, how the depth changes), the
few sums of a file are put together in order, and a second pass, which then knows where it is, cuts records out.  A record
that spans splits is put together from its parts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import on_workers, written

_DEPTH = np.zeros(256, np.int64)
_DEPTH[[ord("{"), ord("[")]] = 1
_DEPTH[[ord("}"), ord("]")]] = -1

#: Splits whose places (about 100 bytes each) are sent to all executors; those of more splits are joined by a shuffle.
MANY_SPLITS = 200_000


def pieces(spark: SparkSession, path: str) -> DataFrame:
    """file, at, size, value: texts up to a `}` each, in order within a split, which begins at byte `at` of a file."""
    rows = spark.read.option("lineSep", "}").option("recursiveFileLookup", True).text(path)
    return rows.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), F.col("_metadata.file_size").alias("size"), "value")


def _splits(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, Iterator[tuple[bytes, int]]]]:
    """The key columns of each split, and its bytes step by step with the number of pieces in each."""

    def parts() -> Iterator[tuple[tuple, bytes, int]]:
        for batch in batches:
            values, start = batch.column("value").to_pylist(), 0
            for key, own in groupby(zip(*(batch.column(c).to_pylist() for c in keys))):
                n = sum(1 for _ in own)
                yield key, ("}".join(values[start : start + n]) + "}").encode(), n
                start += n

    for key, own in groupby(parts(), lambda p: p[0]):
        yield key, ((text, n) for _, text, n in own)


def _quotes(data: np.ndarray) -> np.ndarray:
    """How many quotes that aren't escaped there are up to each byte.  No text begins behind a backslash."""
    quotes, slashes = data == ord('"'), data == ord("\\")
    if slashes.any():
        places = np.arange(len(data))
        run = places - np.maximum.accumulate(np.where(slashes, -1, places))  # of backslashes that end here
        quotes[1:] &= run[:-1] % 2 == 0
    return np.cumsum(quotes)


_SUMS = "file string, at long, size long, first string, bytes long, pieces long, odd boolean, deeper_0 long, lowest_0 long, deeper_1 long, lowest_1 long"
_PLACES = "file string, at long, inside boolean, depth long, base long, opened long, last boolean, cut boolean, balanced boolean"
_KINDS = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_()}


def _batch(ddl: str, rows: list[tuple]) -> pa.RecordBatch:
    fields = [(n, _KINDS[k]) for n, k in (x.split() for x in ddl.split(", "))]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, (_, k) in enumerate(fields)], [n for n, _ in fields])


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each split: its first character but white space, its length, whether it holds an odd number of quotes, and how
    the depth changes and how low it gets if the split begins outside (0) or inside (1) a string."""
    for (file, at, size), steps in _splits(batches, ["file", "at", "size"]):
        first, length, n, odd, deeper, lowest = "", 0, 0, 0, [0, 0], [0, 0]
        for text, count in steps:
            first = first or text.lstrip()[:1].decode("utf-8", "replace")
            length, n = length + len(text) - count, n + count
            data = np.frombuffer(text, np.uint8)
            quotes = _quotes(data)
            for begins in (0, 1):
                depth = deeper[begins] + np.cumsum(np.where((quotes + odd + begins) % 2 == 0, _DEPTH[data], 0))
                deeper[begins], lowest[begins] = int(depth[-1]), min(lowest[begins], int(depth.min()))
            odd = (odd + int(quotes[-1])) % 2
        yield _batch(_SUMS, [(file, at, size, first, length, n, bool(odd), deeper[0], lowest[0], deeper[1], lowest[1])])


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each split, from the sums of its file in order: what it begins as, the depth between records (`base`), in which
    split the record began that is open there, whether it is the last one, and then, whether its last `}` isn't in the file
    (`cut`) and whether all that was opened is closed."""
    for _, own in groupby((r for b in batches for r in b.to_pylist()), lambda r: r["file"]):
        own = list(own)
        base = int(own[0]["first"] == "[")
        cut = sum(r["bytes"] + r["pieces"] for r in own) != own[0]["size"]
        inside, depth, opened, out = False, 0, -1, []
        for k, r in enumerate(own):
            begins = int(inside)
            last = k == len(own) - 1
            out.append([r["file"], r["at"], inside, depth, base, opened, last, last and cut, True])
            if inside is False and depth <= base or depth + r[f"lowest_{begins}"] <= base:
                opened = r["at"]
            inside, depth = inside != r["odd"], depth + r[f"deeper_{begins}"]
        out[-1][-1] = not inside and depth + int(cut) == 0
        yield _batch(_PLACES, [tuple(r) for r in out])


_CUT = "file string, kind string, opened long, at long, value string"
_BEFORE = (re.compile(rb"\s*"), re.compile(rb"\s*\[\s*"))
_BETWEEN = (re.compile(rb"\s*"), re.compile(rb"\s*,\s*"))
_AFTER = (re.compile(rb"\s*"), re.compile(rb"\s*\]\s*"))
_EMPTY = (re.compile(rb"\s*"), re.compile(rb"\s*\[\s*\]\s*"))


def _cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of `kind` record, part (of a record over several splits) and broken, from the pieces of splits with their places."""
    keys = [x.split()[0] for x in _PLACES.split(", ")]
    for (file, at, inside, depth, base, opened, last, cut, balanced), steps in _splits(batches, keys):
        out: list[tuple] = [] if balanced else [(file, "broken", None, at, "unclosed")]
        held, gap, own, any_record, strings = [], [], depth <= base and not inside, at > 0, int(inside)
        in_record = not own
        ahead = next(steps)
        while ahead is not None:
            (text, _), ahead = ahead, next(steps, None)
            if cut and ahead is None:
                text = text[:-1]
            if not text:
                continue
            data = np.frombuffer(text, np.uint8)
            quotes = _quotes(data) + strings
            deep = depth + np.cumsum(np.where(quotes % 2 == 0, _DEPTH[data], 0))
            outside = quotes % 2 == 0
            starts = np.flatnonzero(outside & (data == ord("{")) & (deep == base + 1)).tolist()
            ends = np.flatnonzero(outside & (data == ord("}")) & (deep == base)).tolist()
            depth, strings, place = int(deep[-1]), int(quotes[-1]) % 2, 0
            events = sorted([(p, 0) for p in starts] + [(p + 1, 1) for p in ends])
            for p, closes in events:
                if closes and in_record:
                    held.append(text[place:p])
                    value = b"".join(held).decode("utf-8", "replace")
                    out.append((file, "record", None, at, value) if own else (file, "part", opened, at, value))
                    held, in_record, own, place = [], False, True, p
                elif not closes and not in_record:
                    gap.append(text[place:p])
                    if not (_BETWEEN if any_record else _BEFORE)[base].fullmatch(b"".join(gap)):
                        out.append((file, "broken", None, at, "stray text"))
                    gap, in_record, any_record, place = [], True, True, p
            (held if in_record else gap).append(text[place:])
            if len(out) >= 4096:
                yield _batch(_CUT, out)
                out = []
        if in_record:
            out.append((file, "part", at if own else opened, at, b"".join(held).decode("utf-8", "replace")))
        elif last and not (_AFTER if any_record else _EMPTY)[base].fullmatch(b"".join(gap)):
            out.append((file, "broken", None, at, "stray text"))
        if out:
            yield _batch(_CUT, out)


def json_records(spark: SparkSession, path: str) -> DataFrame:
    """file, kind, value: the text of each record (an object of a file's array) below a path, and `broken` rows.

    A file may hold an array of objects or objects one after the other.  `broken` rows tell of files with something else
    between their records or with brackets that don't match; whether a record itself is sound its reader must tell.
    """
    on_workers(spark)
    rows = pieces(spark, path)
    sums = written(rows.mapInArrow(_summed, _SUMS), "json-sums")
    places = written(sums.repartition("file").sortWithinPartitions("file", "at").mapInArrow(_placed, _PLACES), "json-places")
    if places.count() <= MANY_SPLITS:
        known = rows.drop("size").join(F.broadcast(places), ["file", "at"])
    else:
        known = rows.drop("size").withColumn("_n", F.monotonically_increasing_id()).join(places.hint("merge"), ["file", "at"]).repartition("file", "at").sortWithinPartitions("file", "at", "_n")
    cut = written(known.select("value", *(x.split()[0] for x in _PLACES.split(", "))).mapInArrow(_cut_out, _CUT), "json-records")
    parts = F.array_sort(F.collect_list(F.struct("at", "value")))
    spanning = cut.where("kind = 'part'").groupBy("file", "opened").agg(F.array_join(F.transform(parts, lambda p: p["value"]), "").alias("value"))
    return cut.where("kind <> 'part'").select("file", "kind", "value").unionByName(spanning.select("file", F.lit("record").alias("kind"), "value"))
