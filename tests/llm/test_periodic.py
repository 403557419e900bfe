"""Periodic runs against a literal search over all periods."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np

from contactsheet.llm import periodic


def plain_runs(w):
    n, out = len(w), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j > i and j + q - i >= max(6, 4 * q):
                out.setdefault((i, j + q), q)
            i = j + 1
    return sorted(((s, e - s, q) for (s, e), q in out.items()), key=lambda r: (r[0], r[2]))


def expected(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(w), zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(w)
    drop = {i for s, m, q in runs for i in range(s + q, s + m)}
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2])) if runs else (None,) * 3
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    listed = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha(listed), sha(" ".join(x for i, x in enumerate(w) if i not in drop)))


def test_runs_of_random_words():
    rng = random.Random(1)
    for turn in range(400):
        w = []
        while len(w) < rng.randrange(1, 700):
            kind = rng.random()
            if kind < 0.5:
                part = [rng.randrange(rng.choice((1, 2, 3, 50))) for _ in range(rng.randrange(1, 90))]
                part = part * rng.randrange(1, 9) + part[: rng.randrange(len(part) + 1)]
            elif kind < 0.8 and w:
                s = rng.randrange(len(w))
                part = w[s : s + rng.randrange(1, 60)]
            else:
                part = [rng.randrange(1000) for _ in range(rng.randrange(1, 30))]
            w += part
        assert periodic.runs(np.array(w)) == plain_runs(w), turn
    for w in ([], [1], [1] * 5, [1] * 6, [1] * 5000, list(range(700)) * 4, list(range(700)) * 4 + [5], (list(range(699)) + [1]) * 9, [0, 1] * 3, [0, 1] * 4, [*range(9)] * 4, [*range(16)] * 4, [*range(17)] * 5, [*range(8)] * 4):
        assert periodic.runs(np.array(w, np.int64)) == plain_runs(w), w[:20]


def test_periods_of_nested_powers():
    a = [1]
    for k in range(2, 12):
        a = a + [k] + a  # ruler words, in which every period's minimum is somewhere else
    for w in (a * 4, a * 5 + a[:100], (a[:300] * 4 + [99]) * 4):
        assert periodic.runs(np.array(w)) == plain_runs(w)


def test_documents(spark):
    rng = random.Random(3)
    word = lambda n: f"w{rng.randrange(n)}"
    docs = [(i, "\t".join(word(rng.choice((2, 9, 400))) for _ in range(rng.randrange(0, 120)))) for i in range(400)]
    docs += [(1000, None), (1001, ""), (1002, " \n\t"), (1003, "é x " * 9 + " y"), (1004, "a b c d e f g h " * 90), (1005, "x " + "one\x1ctwo " * 7), (1006, "long " * 3000)]
    docs += [docs[7]]
    df = spark.createDataFrame([(*d, "mine", 3) for d in docs], "doc_id long, text string, n_runs string, start int").repartition(3)
    got = sorted(map(tuple, periodic.detect(df, damage=True).collect()), key=str)
    assert got == sorted((expected(*d) for d in docs), key=str)
    assert sum(r[1] > 0 for r in got) > 25
    one = periodic.detect(spark.createDataFrame([(None, "a b " * 4)], "doc_id long, text string"), damage=True).head()
    assert tuple(one)[:6] == (None, 1, 0, 8, 2, 4000)
    assert periodic.detect(df.limit(0)).count() == 0
