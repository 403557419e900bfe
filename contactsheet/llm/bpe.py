"""Byte-level BPE by a deterministic tokenization automaton.

Compilation starts from the automaton with a single state that reads any byte and applies one *merge gadget* per
merge, in rank order.  The gadget of (u, v) -> w splits the state behind u, removes its arc v and adds an arc w
around both: w enters where u entered and goes on as v did at that moment.  So after all gadgets a state is known by
the token that was read last, and the arc from x to y is there exactly if no gadget of an earlier rank removed the
arc between the constituents that faced each other then.  The product therefore needs no 50,000 x 50,000 arc table:
it is kept factored, as the rank of each gadget (`pairs`) and the constituents that w inherits its arcs from (`left`,
`right`, `born`), and an arc is looked up by walking both constituents back through the ranks.

The automaton is deterministic in the sense that counts here: of all token paths that spell a word exactly one
exists, so the state behind each prefix is found from left to right by table transitions (`states`), for all words of
one length at once.  Decoding emits the arcs' labels, the tokens' bytes.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import frugal, on_workers, release, steps, table
from .flat import flat_bytes

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
#: Bytes of text whose words are looked up together: the more, the fewer distinct words in all.
ENCODE_BYTES = 8 << 20
#: Bytes of whole texts that are cut into words at once, and words whose ids are put in a row at once: either takes some
#: twenty times that memory.
CUT_BYTES, SPREAD_WORDS = 1 << 20, 1 << 17
#: Words beyond so many bytes are walked one by one.
LONG_WORD = 40


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Table:
    """An open-addressed table from 64-bit keys to small non-negative integers; -1 for what isn't there."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(10, int(len(keys) * 8).bit_length())
        self.shift, self.mask = _U(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.zeros(1 << bits, _U), np.full(1 << bits, -1, np.int32)
        self._put(keys, values)

    def _put(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Distinct keys that aren't there yet."""
        left, at = np.arange(len(keys)), self._slot(keys)
        while len(left):
            free = self.values[at] < 0
            _, one = np.unique(at, return_index=True)
            win = np.zeros(len(left), bool)
            win[one] = True
            win &= free
            self.keys[at[win]], self.values[at[win]] = keys[left[win]], values[left[win]]
            left, at = left[~win], (at[~win] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _BASE) >> self.shift).astype(np.int64)

    def __getitem__(self, keys: np.ndarray) -> np.ndarray:
        at = self._slot(keys)
        out = self.values[at]
        more = np.flatnonzero((out >= 0) & (self.keys[at] != keys))
        while len(more):
            at[more] = (at[more] + 1) & self.mask
            got = self.values[at[more]]
            out[more] = got
            more = more[(got >= 0) & (self.keys[at[more]] != keys[more])]
        return out


class Memo(Table):
    """A table that grows up to `most` entries; what comes later is answered but not kept."""

    def __init__(self, bits: int = 16, most: int = 1 << 21):
        self.most, self.used = most, 0
        self._empty(bits)

    def _empty(self, bits: int) -> None:
        self.bits, self.shift, self.mask = bits, _U(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.zeros(1 << bits, _U), np.full(1 << bits, -1, np.int8)

    def add(self, keys: np.ndarray, values: np.ndarray) -> None:
        if self.used + len(keys) > self.most:
            return
        if (self.used + len(keys)) * 3 > 1 << self.bits:
            full = self.values >= 0
            old = self.keys[full], self.values[full]
            self._empty(int((self.used + len(keys)) * 6).bit_length())
            self._put(*old)
        self._put(keys, values)
        self.used += len(keys)


def _byte_alphabet() -> dict[str, int]:
    """The printable stand-in of every byte in vocabulary files of this kind: itself if printable, else from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


@dataclass
class Coded:
    """`codes`: the word number of each pre-split word; `docs`: the offset of each text's first; `flat`, `count`: the
    ids of all distinct words in a row and how many each has."""

    codes: np.ndarray
    docs: np.ndarray
    flat: np.ndarray
    count: np.ndarray

    def spread(self) -> tuple[np.ndarray, np.ndarray]:
        per = self.count.astype(np.int32)[self.codes]
        ends = np.zeros(len(per) + 1, np.int64)
        np.cumsum(per, out=ends[1:])
        first, out = np.cumsum(self.count) - self.count, np.empty(int(ends[-1]), self.flat.dtype)
        for a in range(0, len(per), SPREAD_WORDS):
            b = min(a + SPREAD_WORDS, len(per))
            index = np.repeat(first[self.codes[a:b]] - ends[a:b], per[a:b])
            index += np.arange(ends[a], ends[b])
            out[ends[a] : ends[b]] = self.flat[index]
        return out, ends[self.docs]


class Automaton:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        spec = json.load(open(path, encoding="utf-8"))
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        self.special = {x["content"]: x["id"] for x in spec.get("added_tokens") or ()}
        # The library's rules for splitting, without its vocabulary.
        rules = {**spec, "model": {**spec["model"], "vocab": {}, "merges": []}, "added_tokens": [], "post_processor": None}
        self.presplit = Tokenizer.from_str(json.dumps(rules)).pre_tokenizer.pre_tokenize_str
        alphabet = _byte_alphabet()
        self.alphabet = alphabet
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.labels: list[bytes] = [b""] * size
        for word, i in vocab.items():
            self.labels[i] = bytes(alphabet[c] for c in word)
        for word, i in self.special.items():
            self.labels[i] = word.encode()
        self.left, self.right, self.born = (np.full(size, -1, np.int64) for _ in range(3))
        one, two, rank = [], [], []
        for r, m in enumerate(merges):
            a, b = m.split(" ") if isinstance(m, str) else m
            u, v, w = vocab[a], vocab[b], vocab[a + b]
            if self.born[w] < 0:
                self.left[w], self.right[w], self.born[w] = u, v, r
            one.append(u), two.append(v), rank.append(r)
        self.pairs = Table(self._pair(np.array(one), np.array(two)), np.array(rank, np.int32))
        known = [i for i in vocab.values() if len(self.labels[i]) == 1 or self.born[i] >= 0]
        self.length = np.array([len(x) for x in self.labels])
        self._compile(known)
        self.seen = Memo()
        self.alone: tuple = ()

    def _compile(self, known: list[int]) -> None:
        """`step`: the transition table over bytes whose states are the prefixes of labels, each standing for the
        longest prefix that the text read so far ends in; a prefix that is no beginning of a longer one goes on as the
        shorter prefix does that it ends in, so `row` gives it that one's row.  `longest`: of each state, the longest
        label the text ends in; `shorter`: of each label, the next shorter one that it ends in."""
        known = sorted(known, key=self.labels.__getitem__)
        size = np.array([len(self.labels[i]) for i in known])
        data = np.frombuffer(b"".join(self.labels[i] for i in known), np.uint8)
        start = np.cumsum(size) - size
        # One depth after another: neighbours in the sorted list share a prefix if they shared the shorter one and this byte.
        up, by, deep, own = [np.zeros(1, np.int32)], [np.zeros(1, np.int32)], [np.zeros(1, np.int32)], [np.full(1, -1, np.int32)]
        node, first = np.zeros(len(known), np.int32), 1
        for d in range(1, int(size.max()) + 1):
            at = np.flatnonzero(size >= d)
            letter = data[start[at] + d - 1].astype(np.int32)
            fresh = np.concatenate([[True], (node[at][1:] != node[at][:-1]) | (letter[1:] != letter[:-1])])
            up.append(node[at][fresh]), by.append(letter[fresh]), deep.append(np.full(int(fresh.sum()), d, np.int32))
            node[at] = first + np.cumsum(fresh) - 1
            label = np.full(len(up[-1]), -1, np.int32)
            ends = at[size[at] == d]
            label[node[ends] - first] = np.array(known, np.int32)[ends]
            own.append(label)
            first += len(label)
        up, by, deep, own = (np.concatenate(x) for x in (up, by, deep, own))
        inner = np.zeros(len(up), bool)
        inner[up] = True
        self.row = np.zeros(len(up), np.int32)
        self.row[inner] = np.arange(inner.sum())
        self.step = np.zeros((int(inner.sum()), 256), np.int32)
        self.longest = own.copy()
        self.shorter = np.full(len(self.labels), -1, np.int64)
        fail = np.zeros(len(up), np.int32)
        for d in range(1, int(deep.max()) + 1):
            at = np.flatnonzero(deep == d)
            fail[at] = self.step[self.row[fail[up[at]]], by[at]] if d > 1 else 0
            self.step[self.row[up[at]], by[at]] = at
            if d > 1:
                ends = at[own[at] >= 0]
                self.shorter[own[ends]] = self.longest[fail[ends]]
                none = at[own[at] < 0]
                self.longest[none] = self.longest[fail[none]]
            # The row of a state: as its fallback's, until its own children (of the next depth) are put in.
            more = at[inner[at]]
            self.step[self.row[more]] = self.step[self.row[fail[more]]]
            rest = at[~inner[at]]
            self.row[rest] = self.row[fail[rest]]

    @staticmethod
    def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (a.astype(_U) << _U(24)) | b.astype(_U)

    def arcs(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Whether the arc from state x with label y is there; arcs looked up once are kept in a table."""
        keys = self._pair(x, y)
        out = self.seen[keys]
        new = np.flatnonzero(out < 0)
        if len(new):
            fresh, back = np.unique(keys[new], return_inverse=True)
            got = self._survives((fresh >> _U(24)).astype(np.int64), (fresh & _U(0xFFFFFF)).astype(np.int64))
            self.seen.add(fresh, got)
            out[new] = got[back]
        return out > 0

    def _survives(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Whether the arc from state x with label y survived all gadgets."""
        there, at = np.ones(len(x), bool), np.arange(len(x))
        limit = np.full(len(x), np.iinfo(np.int64).max)
        while len(at):
            rank = self.pairs[self._pair(x, y)]
            gone = (rank >= 0) & (rank < limit)
            there[at[gone]] = False
            bx, by = self.born[x], self.born[y]
            on = ~gone & ((bx >= 0) | (by >= 0))
            at, x, y, bx, by = at[on], x[on], y[on], bx[on], by[on]
            # The younger of the two is taken back; merges run from left to right, hence of one rank the right one first.
            back = bx > by
            limit = np.where(back, bx, by + 1)
            x, y = np.where(back, self.right[x], x), np.where(back, y, self.left[y])
        return there

    def states(self, letters: np.ndarray) -> np.ndarray:
        """The state (token read last) behind each non-empty prefix of equally long words, as words x length."""
        n, length = letters.shape
        state = np.full((n, length + 1), -1, np.int64)
        read = np.zeros(n, np.int32)
        for i in range(1, length + 1):
            read = self.step[self.row[read], letters[:, i - 1]]
            token, at = self.longest[read].astype(np.int64), np.arange(n)
            while len(at):
                size = self.length[token]
                good = size == i
                more = np.flatnonzero(~good)
                good[more] = self.arcs(state[at[more], i - size[more]], token[more])
                state[at[good], i] = token[good]
                at, token = at[~good], self.shorter[token[~good]]
        return state

    def one_word(self, word: bytes) -> list[int]:
        """The ids of a word of any length, by the same transitions as `states`, one after another."""
        if not self.alone:
            spots = np.flatnonzero(self.pairs.values >= 0)
            self.alone = dict(zip(self.pairs.keys[spots].tolist(), self.pairs.values[spots].tolist())), self.left.tolist(), self.right.tolist(), self.born.tolist(), self.length.tolist(), self.shorter.tolist()
        ranks, left, right, born, length, shorter = self.alone
        step, row, longest = self.step, self.row, self.longest

        def arc(x: int, y: int) -> bool:
            limit = len(born) + len(ranks)
            while True:
                if ranks.get(x << 24 | y, limit) < limit:
                    return False
                bx, by = born[x], born[y]
                if bx < 0 and by < 0:
                    return True
                if bx > by:
                    x, limit = right[x], bx
                else:
                    y, limit = left[y], by + 1

        state, read = [-1], 0
        for i, b in enumerate(word, 1):
            read = int(step[row[read], b])
            token = int(longest[read])
            while length[token] < i and not arc(state[i - length[token]], token):
                token = shorter[token]
            state.append(token)
        out, i = [], len(word)
        while i:
            out.append(state[i])
            i -= length[state[i]]
        return out[::-1]

    def words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in a row, and how many each has."""
        bounds = np.frombuffer(words.buffers()[1], np.int64, len(words) + 1, words.offset * 8)
        data = np.frombuffer(words.buffers()[2], np.uint8) if words.buffers()[2] is not None else np.empty(0, np.uint8)
        size = np.diff(bounds)
        count = np.zeros(len(words), np.int64)
        found: list[tuple[np.ndarray, np.ndarray, int]] = []
        long: dict[int, list[int]] = {}
        order = np.argsort(size, kind="stable")
        edges = np.flatnonzero(np.diff(size[order], prepend=-1))
        for a, b in zip(edges, [*edges[1:], len(order)]):
            at, length = order[a:b], int(size[order[a]])
            if length == 0:
                continue
            if length > LONG_WORD:
                for w in at:
                    long[w] = self.one_word(data[bounds[w] : bounds[w + 1]].tobytes())
                    count[w] = len(long[w])
                continue
            state = self.states(data[bounds[at][:, None] + np.arange(length)])
            row, place, step = np.arange(len(at)), np.full(len(at), length), 0
            while len(row):
                token = state[row, place]
                found.append((at[row], token, step))
                place = place - self.length[token]
                count[at[row]] += 1
                row, place = row[place > 0], place[place > 0]
                step += 1
        ends = np.cumsum(count)
        flat = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint32)
        for at, token, step in found:
            flat[ends[at] - 1 - step] = token
        for w, ids in long.items():
            flat[ends[w] - len(ids) : ends[w]] = ids
        return flat, count

    def coded(self, texts: pa.Array) -> Coded:
        """All texts as a row of codes into a list of distinct pre-split words, which are encoded once each."""
        n = len(texts)
        plain, cuts, data, bounds = self._cut(texts)
        odd = np.flatnonzero(~plain)
        # Pre-split words of plain documents are slices of the batch's bytes; the others are split by the library's rule.
        ends = np.append(cuts[1:], len(data)) if len(cuts) else cuts
        own = np.diff(np.searchsorted(cuts, bounds))
        pieces: list[bytes | int] = []
        if len(odd):
            keep = np.repeat(plain, own)
            cuts, ends = cuts[keep], ends[keep]
            for d in odd:
                more = self._odd(bytes(data[bounds[d] : bounds[d + 1]]).decode())
                own[d] = len(more)
                pieces += more
        words = pa.concat_arrays([_slices(data, cuts, ends), pa.array([b"" if isinstance(x, int) else x for x in pieces], pa.large_binary())]).dictionary_encode()
        flat, count = self.words(words.dictionary)
        code = words.indices.to_numpy(zero_copy_only=False)
        if len(odd):
            # Behind the words follow the special tokens.  Plain documents come first so far, the others after them.
            special = sorted(self.special.values())
            fixed = np.array([special.index(x) if isinstance(x, int) else -1 for x in pieces], np.int32)
            code = code.copy()
            code[len(cuts) :][fixed >= 0] = len(count) + fixed[fixed >= 0]
            flat, count = np.append(flat, np.array(special, np.uint32)), np.append(count, np.ones(len(special), np.int64))
            place = np.zeros(n, np.int64)
            place[plain] = np.cumsum(own[plain]) - own[plain]
            place[odd] = len(cuts) + np.cumsum(own[odd]) - own[odd]
            total = np.cumsum(own)
            at = np.repeat(place - (total - own), own)
            at += np.arange(len(at))
            code = code[at]
        return Coded(code, np.concatenate([[0], np.cumsum(own)]), flat, count)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row as uint32, and the offset of each text's start (one more at the end)."""
        return self.coded(texts).spread()

    #: 0 white space, 1 letter (all bytes of characters beyond ASCII too), 2 digit, 3 other, 4 what plain documents lack.
    _KIND = np.array([0 if b in (9, 10, 11, 12, 13, 32) else 4 if b < 32 or b == 127 else 1 if chr(b).isalpha() and b < 128 else 2 if 48 <= b <= 57 else 3 if b < 128 else 1 if b < 192 or 195 <= b <= 201 else 4 for b in range(256)], np.int8)

    def _cut(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Which documents are plain (ASCII and Latin letters), and where words start in all of them."""
        data, bounds = flat_bytes(texts)
        plain, cuts, a = np.ones(len(texts), bool), [np.empty(0, np.int64)], 0
        while a < len(texts):
            b = max(a + 1, int(np.searchsorted(bounds, bounds[a] + CUT_BYTES, side="right")) - 1)
            plain[a:b], cut = self._cut_some(data[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a])
            cuts.append(cut + bounds[a])
            a = b
        for word in self.special:
            plain &= ~pc.match_substring(pc.fill_null(texts, ""), word).to_numpy(zero_copy_only=False)
        return plain, np.concatenate(cuts), data, bounds

    def _cut_some(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(data)
        if not n:
            return np.ones(len(bounds) - 1, bool), np.empty(0, np.int64)
        kind = self._KIND[data]
        bad = kind == 4
        lead = data == 195
        lead[-1] = False
        follow = np.empty(n, bool)
        follow[0], follow[1:] = False, lead[:-1]
        bad |= follow & ((data == 0x97) | (data == 0xB7))  # the signs × and ÷ are no letters
        first = bounds[:-1][bounds[:-1] < n]
        start, last = np.zeros(n, bool), np.zeros(n, bool)
        start[first] = True
        last[np.maximum(bounds[1:] - 1, 0)] = True
        white = kind == 0
        was_white, will_white = np.empty(n, bool), np.empty(n, bool)
        was_white[0], was_white[1:] = False, white[:-1]
        will_white[-1], will_white[:-1] = True, white[1:]
        was_kind = np.empty(n, np.int8)
        was_kind[0], was_kind[1:] = 0, kind[:-1]
        was_blank = np.empty(n, bool)
        was_blank[0], was_blank[1:] = False, data[:-1] == 32
        # A run of white space is one word but for its last character, which joins the word behind it if it is a blank.
        cut = np.where(white, ~was_white | (~will_white & ~last), np.where(was_white, ~was_blank, kind != was_kind))
        cut |= start
        self._contractions(data, cut, start)
        plain = np.ones(len(bounds) - 1, bool)
        if bad.any():
            plain[np.searchsorted(bounds, np.flatnonzero(bad), side="right") - 1] = False
        return plain, np.flatnonzero(cut)

    @staticmethod
    def _contractions(data: np.ndarray, cut: np.ndarray, start: np.ndarray) -> None:
        """'s 't 'm 'd 're 've 'll are words where a word starts with the apostrophe."""
        n = len(data)
        at = np.flatnonzero((data == 39) & cut)
        at = at[at + 1 < n]
        while len(at):
            one = data[at + 1]
            two = data[np.minimum(at + 2, n - 1)]
            short = np.isin(one, np.frombuffer(b"stmd", np.uint8)) & ~start[at + 1]
            long = ((two == 101) & ((one == 114) | (one == 118)) | (two == 108) & (one == 108)) & (at + 2 < n) & ~start[at + 1] & ~start[np.minimum(at + 2, n - 1)]
            cut[at[short] + 1] = False
            for k in (1, 2):
                cut[at[long] + k] = False
            after = np.concatenate([at[short] + 2, at[long] + 3])
            after = after[after < n]
            after = after[~np.isin(data[after], (9, 10, 11, 12, 13, 32))]
            at = after[(data[after] == 39) & ~cut[after]]
            cut[after] = True
            at = at[at + 1 < n]

    def _odd(self, text: str) -> list[bytes | int]:
        out: list[bytes | int] = []
        rest = text
        while rest:
            hits = [(p, -len(s), s) for s in self.special if (p := rest.find(s)) >= 0]
            at, _, name = min(hits) if hits else (len(rest), 0, "")
            if at:
                out += [bytes(self.alphabet[c] for c in w) for w, _ in self.presplit(rest[:at])]
            if name:
                out.append(self.special[name])
            rest = rest[at + len(name) :]
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        """The labels of the arcs, as UTF-8 with replacement characters where they make none."""
        return b"".join(map(self.labels.__getitem__, ids.tolist())).decode("utf-8", "replace").encode()


def _slices(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Byte slices as an Arrow array; without a copy if they follow one another."""
    if len(starts) and (starts[1:] == ends[:-1]).all():
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(np.append(starts, ends[-1]).astype(np.int64)), pa.py_buffer(data)])
    size = ends - starts
    bounds = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
    got = np.empty(int(bounds[-1]), np.uint8)
    for a in range(0, len(starts), SPREAD_WORDS):
        b = min(a + SPREAD_WORDS, len(starts))
        got[bounds[a] : bounds[b]] = data[np.repeat(starts[a:b] - bounds[a:b], size[a:b]) + np.arange(bounds[a], bounds[b])]
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(got)])


_AUTOMATA: dict[str, Automaton] = {}


def automaton(path: str) -> Automaton:
    """Compiled once in each Python worker."""
    if path not in _AUTOMATA:
        _AUTOMATA[path] = Automaton(path)
        release()  # the vocabulary as read
    return _AUTOMATA[path]


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """`docs` with `ids` array<int>: the token ids of the whole text.  Null texts count as empty; other columns stay.

    An `ids` column in the input is replaced; repeated rows give equal ids, an empty table no rows.
    """
    on_workers(docs.sparkSession)
    path = path or tokenizer_path()
    base = docs.drop("ids")
    schema = base.withColumn("ids", F.array().cast("array<int>")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = automaton(path)
        for batch in steps(batches, most=ENCODE_BYTES):
            ids, bounds = a.encode(batch.column("text"))
            lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], [*batch.schema.names, "ids"])

    return base.mapInArrow(frugal(run), schema)


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """`encoded` with `decoded` string, the text that its `ids` spell; null ids give an empty text."""
    on_workers(encoded.sparkSession)
    path = path or tokenizer_path()
    base = encoded.drop("decoded")
    schema = base.withColumn("decoded", F.lit("")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = automaton(path)
        for batch in batches:
            texts = [a.decode(np.asarray(x or (), np.int64)).decode() for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, "decoded"])

    return base.mapInArrow(frugal(run), schema)


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document: encoded, then decoded from the ids alone.

    A null or empty text has 0 tokens and the digests of nothing.  Repeated rows give repeated results, an empty table
    none; texts and words may be of any length; columns other than doc_id and text are not read.
    """
    on_workers(docs.sparkSession)
    path = path or tokenizer_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = automaton(path)
        decimal = [b"%d," % i for i in range(len(a.labels))]
        for batch in steps(batches, most=ENCODE_BYTES):
            ids, bounds = a.encode(batch.column("text"))
            one, two = [], []
            for s, e in zip(bounds[:-1], bounds[1:]):
                own = ids[s:e].tolist()
                one.append(hashlib.sha256(b"".join(map(decimal.__getitem__, own))[:-1]).hexdigest())
                two.append(hashlib.sha256(a.decode(ids[s:e])).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(bounds)), pa.array(one, pa.string()), pa.array(two, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(frugal(run), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row of `documents`; see `round_trip`."""
    return round_trip(table(spark, sf_dir, "documents"))
