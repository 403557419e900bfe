"""Text as one flat byte array with document offsets, so that numpy sees a batch of documents at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_U = np.uint64


def flat_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and the offset of each text's start (one more at the end); null counts as empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    bounds = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    data = texts.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return whole[bounds[0] : bounds[-1]], bounds - bounds[0]


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit words (multiply and xor-shift)."""
    x = x.astype(_U, copy=True)
    x ^= x >> _U(32)
    x *= _U(0xD6E8FEB86659FD93)
    x ^= x >> _U(32)
    x *= _U(0xD6E8FEB86659FD93)
    x ^= x >> _U(32)
    return x


_TABLE = mix64(np.arange(1, 64 * 256 + 1, dtype=_U)).reshape(64, 256)


#: Bytes of segments that are hashed at once: the work needs some thirty times as much memory.
HASH_BYTES = 1 << 20


def segment_hash(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, most: int | None = None) -> np.ndarray:
    """Tabulation hash of byte segments; with `most`, of their first bytes only.  Segments aren't empty."""
    if most is not None:
        lengths = np.minimum(lengths, most)
    ends = np.cumsum(lengths)
    if len(ends) and ends[-1] > HASH_BYTES:
        edges = np.unique(np.searchsorted(ends, np.arange(0, ends[-1] + HASH_BYTES, HASH_BYTES)))
        edges = np.unique(np.concatenate([[0], edges, [len(ends)]]))
        return np.concatenate([_segment_hash(data, starts[a:b], lengths[a:b]) for a, b in zip(edges[:-1], edges[1:])])
    return _segment_hash(data, starts, lengths)


def _segment_hash(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    if not len(starts):
        return np.empty(0, _U)
    ends = np.cumsum(lengths)
    first = ends - lengths
    place = np.arange(ends[-1]) - np.repeat(first, lengths)
    got = _TABLE[place & 63, data[np.repeat(starts, lengths) + place]]
    if lengths.max() > 64:
        got *= (place >> 6).astype(_U) * _U(2) + _U(1)
    return mix64(np.add.reduceat(got, first) + lengths.astype(_U))


class Words:
    """Words of a batch of texts: lower-case runs of letters, marks and digits.

    `data` holds the normalised bytes, `starts`/`lengths` the words, `docs` the word offset of each document's start.
    """

    def __init__(self, texts: pa.Array):
        low = pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), ""))
        low = pc.replace_substring_regex(low, r"[^\p{L}\p{M}\p{N}]+", " ")
        self.data, bounds = flat_bytes(low)
        n = len(self.data)
        inside = self.data != 32
        before = np.empty(n, bool)
        if n:
            before[0] = False
            before[1:] = inside[:-1]
            before[bounds[:-1][bounds[:-1] < n]] = False
        after = np.empty(n, bool)
        if n:
            after[-1] = False
            after[:-1] = inside[1:]
            last = bounds[1:][bounds[1:] > 0] - 1
            after[last] = False
        self.starts = np.flatnonzero(inside & ~before)
        self.lengths = np.flatnonzero(inside & ~after) + 1 - self.starts
        self.docs = np.searchsorted(self.starts, bounds)

    def hashes(self, most: int | None = None) -> np.ndarray:
        return segment_hash(self.data, self.starts, self.lengths, most)
