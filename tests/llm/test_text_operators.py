"""The operators over texts against brute force, on texts that are null, empty, long, equal and odd."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from contactsheet import storage
from contactsheet.llm import bpe, common, exact, grammar, minhash, packing, pii, sharding, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, _node long"


def frame(spark, texts, ids=None):
    """With columns whose names clash with the operators' own, and nulls in all others."""
    return spark.createDataFrame([(i, t, None, None, None, None, None) for i, t in zip(ids or range(len(texts)), texts)], SCHEMA)


def prose(rng, n, words=800):
    return " ".join(f"w{rng.randrange(words)}" for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    odd = [None, "", " ", "\n\n", "it's 'll we've'd", "<|endoftext|>x", "日本語 😀", "a\xa0b", "x" * 5000, "é" * 300, "12 3a4", "the the the"]
    return odd + [prose(rng, rng.randrange(1, 400)) for _ in range(40)] + [prose(rng, 20000)] + ["same text here"] * 25


def library_ids(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.tokenizer_path())
    return t, [t.encode(x or "", add_special_tokens=False).ids for x in texts]


def test_encoding_equals_the_library(spark, texts):
    t, want = library_ids(texts)
    got = {r["doc_id"]: r for r in bpe.round_trip(frame(spark, texts)).collect()}
    for i, ids in enumerate(want):
        assert got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    both = bpe.decode(bpe.encode(frame(spark, texts))).collect()
    assert all(r["decoded"] == (texts[r["doc_id"]] or "") for r in both)


def test_encoding_random_strings():
    rng = random.Random(1)
    some = ["".join(rng.choice("ab '\n\t!1é×日s") for _ in range(rng.randrange(30))) for _ in range(1500)]
    ids, bounds = bpe.automaton(bpe.tokenizer_path()).encode(pa.array(some))
    assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:])] == library_ids(some)[1]


def test_encoding_takes_a_few_times_the_memory_of_the_texts():
    import tracemalloc

    rng = random.Random(9)
    some = [prose(rng, 400) + "\n\n it's 12" for _ in range(3300)] + ["", None, "日本語 \x00"] + [prose(rng, 300000)]
    a, size = bpe.automaton(bpe.tokenizer_path()), sum(len(x or "") for x in some)
    texts = pa.array(some)
    a.encode(texts)  # what is kept of it comes first
    tracemalloc.start()
    ids, bounds = a.encode(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 20 * size
    want = library_ids(some[:20] + some[3290:])[1]
    assert [ids[bounds[i] : bounds[i + 1]].tolist() for i in [*range(20), *range(3290, len(some))]] == want


def test_workers_get_small_batches_of_long_rows(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key, None)
    rows = spark.range(0, 3000, 1, 1).select(F.repeat(F.lit("x"), 10000).alias("text"))

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], ["n", "size"])

    got = common.written(rows.mapInArrow(sizes, "n long, size long"), "sizes", small=True).collect()
    assert sum(r["n"] for r in got) == 3000
    assert max(r["size"] for r in got) < 2 * storage.BATCH_BYTES
    assert spark.conf.get(key, None) == before


def test_the_pipeline_scores_small_batches(spark, monkeypatch):
    docs = spark.range(0, 3000, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x "), 5000).alias("text"), F.lit(0).cast("long").alias("n_chars"))

    def sizes(batches):
        for b in batches:
            n = b.num_rows
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text"), pa.array([b.nbytes] * n), pa.array([0] * n, pa.int32())], ["doc_id", "text", "n_chars", "predicted"])

    monkeypatch.setattr(corpus_pipeline, "table", lambda *x: None)
    monkeypatch.setattr(corpus_pipeline.toxicity, "fit", lambda *x: None)
    monkeypatch.setattr(corpus_pipeline.toxicity, "score", lambda docs, model: docs.mapInArrow(sizes, "doc_id long, text string, n_chars long, predicted int"))
    got = corpus_pipeline.clean(spark, docs, "").agg(F.count("*").alias("n"), F.max("n_chars").alias("most")).first()
    assert got["n"] == 3000 and got["most"] < 2 * storage.BATCH_BYTES


def test_encoding_long_words_fast():
    import base64
    import time

    rng = random.Random(9)
    some = [base64.b64encode(rng.randbytes(60000)).decode(), "a" * 50000, "ab" * 30000, "-" * 5000, "".join(rng.choice("äöüß") for _ in range(20000)), "x1" * 3000]
    some += ["".join(rng.choice("thein") for _ in range(rng.randrange(41, 200))) for _ in range(50)]
    began = time.time()
    ids, bounds = bpe.automaton(bpe.tokenizer_path()).encode(pa.array(some))
    assert time.time() - began < 20
    assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:])] == library_ids(some)[1]


def test_packing(spark, texts):
    _, ids = library_ids(texts)
    rows = packing.pack(frame(spark, texts)).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    for i, own in enumerate(ids):
        own = own + [2]
        parts = sorted(by_doc[i], key=lambda r: r["piece"])
        assert [p["piece"] for p in parts] == list(range(len(parts))) and sum(p["length"] for p in parts) == len(own)
        assert len(parts) == -(-len(own) // 1024) and all(p["length"] == 1024 for p in parts[1:])
        for p in parts:
            assert p["ids_crc32"] == zlib.crc32(np.array(own[p["start"] : p["start"] + p["length"]], "<u4"))
    for spots in by_sequence.values():
        at = 0
        for offset, length in sorted(spots):
            assert offset == at
            at += length
        assert at <= 1024
    total = sum(len(x) + 1 for x in ids)
    assert len(by_sequence) <= -(-total // 1024) + 1


def test_packing_plan_is_near_the_bound():
    rng = np.random.default_rng(0)
    demand = np.bincount(np.minimum(rng.geometric(1 / 300, 20000), 1024), minlength=1025)
    made, bound = packing.bounded_plan(demand, 1024)
    got = np.zeros(1025, int)
    for config, times in made:
        assert sum(x * k for x, k in config.items()) <= 1024
        for x, k in config.items():
            got[x] += k * times
    assert (got == demand).all()
    assert np.ceil((np.arange(1025) * demand).sum() / 1024) - 1 <= bound <= sum(t for _, t in made) <= 1.01 * bound
    # Pieces of 400 go in pairs only, so the bound is half their number, not their tokens.
    pairs = np.zeros(1025, int)
    pairs[400], pairs[250] = 1000, 10
    made, bound = packing.bounded_plan(pairs, 1024)
    assert 490 <= bound <= 505 and sum(t for _, t in made) <= 1.02 * bound + 1
    assert packing.bounded_plan(np.zeros(1025, int), 1024) == ([], 0.0)


def test_a_length_in_many_buckets(spark):
    cut = spark.range(5000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, 1024).otherwise(F.col("id") % 97 + 1).alias("length"))
    for more in ({"task_rows": 50}, {}, {"spread": 1}):
        rows = packing.assign(cut, **more).collect()
        spots = defaultdict(list)
        for r in rows:
            spots[r["sequence_id"]].append((r["offset"], r["length"]))
        assert len(rows) == 5000 == len({(r["sequence_id"], r["offset"]) for r in rows})
        for own in spots.values():
            own.sort()
            assert own[0][0] == 0 and all(a + b == c for (a, b), (c, _) in zip(own, own[1:])) and sum(own[-1]) <= 1024


def test_grammar_files(spark, texts):
    _, ids = library_ids(texts)
    files = grammar.write_ids(frame(spark, texts))
    got = {r["doc_id"]: r for r in grammar.read_back(files).collect()}
    start = 0
    for i, own in enumerate(ids):
        own = own + [0]
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (start, len(own), zlib.crc32(np.array(own, "<u4")))
        start += len(own)
    packed = 0
    for row in files.collect():
        packed += len(row["symbols"]) + len(row["rules"]) + len(row["expansions"])
        for k, i in enumerate(row["doc_ids"]):
            own = ids[i] + [0]
            a, b = len(own) // 3, 2 * len(own) // 3 + 1
            assert grammar.read_ids(row.asDict(), k, a, b).tolist() == own[a:b]
    assert packed < 0.8 * 4 * start


def test_exact_dedup(spark, texts):
    cases = [*texts, "same  text\there", "sametexthere", None, "\x0b\x0c"]
    want = defaultdict(list)
    for i, t in enumerate(cases):
        want[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), i))
    for least in (2, 1000):
        got = {r["doc_id"]: r for r in exact.mark(frame(spark, cases), least=least).collect()}
        assert len(got) == len(cases)
        for key, group in want.items():
            stays = min(group)[1]
            for _, i in group:
                r = got[i]
                assert (r["keep_id"], r["group_size"], r["kept"]) == (stays, len(group), i == stays)
                assert r["text_sha256"] == hashlib.sha256(key.encode()).hexdigest()
        kept = exact.keep(frame(spark, cases), least=least)
        assert kept.columns == frame(spark, []).columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(min(g)[1] for g in want.values())


def test_repeated_rows_and_null_ids(spark):
    docs = frame(spark, ["a b c d e f"] * 4 + [None], [None, None, 5, 5, None])
    assert Counter(r["kept"] for r in exact.mark(docs, least=2).where("text_sha256 <> sha2('', 256)").collect()) == {True: 1, False: 3}
    assert exact.keep(docs, least=2).count() == exact.keep(docs, least=100).count() == 2
    assert Counter((r["class_id"], r["kept"]) for r in minhash.near_duplicates(docs).collect()) == {(5, True): 1, (5, False): 3, (None, True): 1}


def test_near_duplicates_equal_brute_force(spark):
    rng = random.Random(8)
    cases = [None, "", "", "!!", "one", "one", "One!", "a b c d", "x" * 3000]
    for _ in range(12):
        base = prose(rng, rng.randrange(30, 300), 10**6).split()
        for _ in range(rng.randrange(1, 9)):
            own = list(base)
            for _ in range(rng.randrange(0, 1 + len(own) // 30)):
                own[rng.randrange(len(own))] = f"z{rng.randrange(10**6)}"
            cases.append(" ".join(own))
    shared = prose(rng, 60, 10**6)
    cases += [f"{prose(rng, 90, 10**6)} {shared}" for _ in range(20)]

    def elements(t):
        w = re.findall(r"[^\W_]+", (t or "").lower())
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else None

    sets = [elements(t) for t in cases]
    comp = list(range(len(cases)))

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for i in range(len(cases)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if (a is None) != (b is None):
                continue
            if (cases[i] or "") == (cases[j] or "") if a is None else len(a & b) >= 0.8 * len(a | b):
                x, y = find(i), find(j)
                comp[max(x, y)] = min(x, y)
    got = {r["doc_id"]: r for r in minhash.near_duplicates(frame(spark, cases)).collect()}
    assert {i: got[i]["class_id"] for i in got} == {i: find(i) for i in range(len(cases))}
    assert all(r["kept"] == (i == r["class_id"]) for i, r in got.items())
    kept = minhash.keep(frame(spark, cases))
    assert kept.columns == frame(spark, []).columns and {r["doc_id"] for r in kept.collect()} == {find(i) for i in range(len(cases))}


def test_prefix_filter_keeps_every_similar_pair(spark):
    rng = random.Random(12)
    cases = ["one two", "one two three four five six"]
    for size in (12, 60, 150, 151, 155, 400):
        base = prose(rng, size, 10**6).split()
        for edits in [*range(12)] * 2:
            own = list(base)
            for _ in range(edits):
                own[rng.randrange(len(own))] = f"z{rng.randrange(10**6)}"
            cases.append(" ".join(own + prose(rng, rng.randrange(9), 10**6).split()))
    got, bounds = minhash.shingles(minhash.Words(pa.array(cases)))
    sets = [set(got[a:b].tolist()) for a, b in zip(bounds[:-1], bounds[1:])]
    comp = [rng.randrange(60) for _ in cases]
    rows = spark.createDataFrame(list(enumerate(cases)), "_node long, text string")
    index = spark.createDataFrame(list(enumerate(comp)), "node long, comp long")
    some = [i for i in range(len(cases)) if rng.random() < 0.7]
    pairs = minhash.prefix_pairs(index.where(F.col("node").isin(some)), index, rows)
    found = {(r["a"], r["b"]) for r in pairs.collect()}
    want = {(j, i) for i in range(len(cases)) for j in range(i) if comp[i] != comp[j] and {i, j} & set(some) and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])}
    assert want and want <= found and all(comp[a] != comp[b] for a, b in found)
    assert len(found) < len(cases) ** 2 / 20


@pytest.mark.parametrize("direct", [0, 1000])
def test_near_duplicates_with_small_and_large_buckets(spark, monkeypatch, direct):
    monkeypatch.setattr(minhash, "DIRECT", direct)
    monkeypatch.setattr(minhash, "HUB_TURNS", 0)
    test_near_duplicates_equal_brute_force(spark)


def test_signatures_estimate_similarity():
    rng = random.Random(0)
    base = [prose(rng, 300, 5000) for _ in range(60)]
    other = [" ".join(f"q{rng.randrange(10**6)}" if rng.random() < 0.04 else w for w in t.split()) for t in base]
    (x, xb), (y, yb) = (minhash.shingles(minhash.Words(pa.array(t))) for t in (base, other))
    exactly = np.array([len(set(x[xb[i] : xb[i + 1]]) & set(y[yb[i] : yb[i + 1]])) / len(set(x[xb[i] : xb[i + 1]]) | set(y[yb[i] : yb[i + 1]])) for i in range(60)])
    guess = (minhash.signatures(x, xb, 256) == minhash.signatures(y, yb, 256)).mean(axis=1)
    assert abs((guess - exactly).mean()) < 0.015 and (guess - exactly).std() < 0.05


def test_weighted_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(5)
    rows, exactly = [[], []], []
    for _ in range(80):
        a, b = ({int(k): float(w) for k, w in zip(rng.choice(60, 30, replace=False), rng.choice([0.25, 1, 1.5, 3, 7], 30))} for _ in range(2))
        for k in list(a)[:20]:
            b[k] = a[k] * float(rng.choice([1, 1, 0.5]))
        keys = set(a) | set(b)
        exactly.append(sum(min(a.get(k, 0), b.get(k, 0)) for k in keys) / sum(max(a.get(k, 0), b.get(k, 0)) for k in keys))
        rows[0].append(a), rows[1].append(b)
    made = []
    for side in rows:
        ids = np.array([k for r in side for k in r], np.uint64)
        made.append(minhash.signatures(minhash.mix64(ids + np.uint64(9)), np.cumsum([0, *map(len, side)]), 512, np.array([w for r in side for w in r.values()])))
    guess = (made[0] == made[1]).mean(axis=1)
    error = guess - np.array(exactly)
    assert abs(error.mean()) < 0.01 and error.std() < 0.035 and np.std(exactly) > 0.03
    words = minhash.Words(pa.array(["a b a b a b a b", None, "x"]))
    got, bounds, times = minhash.weighted_shingles(words)
    assert bounds.tolist() == [0, 2, 2, 3] and sorted(times[:2].tolist()) == [2, 2] and times[2] == 1


def test_columns_of_any_name_keep_their_values(spark):
    names = "doc_id long, text string, _node long, _digest long, _bands long, _row long, _doc long, comp long, c0 string, _points long, _rank long, _best long, _size long"
    rows = [(i, t, *range(77, 83), "x", *range(90, 94)) for i, t in enumerate(["a b c d e f g", "a b c  d e f g", None, "other words are here now"])]
    docs = spark.createDataFrame(rows, names)
    for kept, ids in ((exact.keep(docs), {1, 2, 3}), (exact.keep(docs, least=2), {1, 2, 3}), (minhash.keep(docs), {0, 2, 3})):
        assert kept.columns == docs.columns and {tuple(r) for r in kept.collect()} == {r for r in rows if r[0] in ids}


def test_sharding(spark, texts):
    docs = frame(spark, texts).repartition(7)
    rows = sharding.shuffle(docs, shards=5, groups=3, task_rows=4).collect()
    assert sorted(r["doc_id"] for r in rows) == list(range(len(texts)))
    sizes = Counter(r["shard"] for r in rows)
    assert len(sizes) == 5 and max(sizes.values()) - min(sizes.values()) <= 1
    for s in sizes:
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sizes[s]))
    for r in rows:
        data = (texts[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(data) + 8, zlib.crc32(data), "rows", None)


def test_matrix_has_exact_margins():
    rows = np.array([5, 0, 17, 1, 30])
    m = sharding.matrix(rows, 4, 1)
    assert (m.sum(axis=1) == rows).all() and sorted(m.sum(axis=0)) == [13, 13, 13, 14]


def test_every_dealing_is_equally_likely():
    # 2 and 3 rows of two groups to shards of 3 and 2: how many matrices there are, weighted by the dealings they stand for.
    from math import comb

    want = {k: comb(2, k) * comb(3, 3 - k) / comb(5, 3) for k in range(3)}
    seen = Counter(int(sharding.matrix(np.array([2, 3]), 2, seed)[0, 0]) for seed in range(4000))
    assert all(abs(seen[k] / 4000 - p) < 0.03 for k, p in want.items())


def test_draws_follow_the_law_at_any_size():
    rng = np.random.default_rng(6)
    for good, bad, sample in ((30, 70, 20), (5, 3, 6), (1, 10**6, 1000)):
        mine = np.array([sharding._draw(rng, good, bad, sample) for _ in range(4000)])
        other = np.random.default_rng(7).hypergeometric(good, bad, sample, 4000)
        assert abs(mine.mean() - other.mean()) < 0.1 and abs(mine.std() - other.std()) < 0.1
        assert mine.min() >= max(0, sample - bad) and mine.max() <= min(good, sample)
    good, bad, sample = 10**12, 23 * 10**12, 10**10
    big = np.array([sharding._draw(rng, good, bad, sample) for _ in range(300)], float)
    p = good / (good + bad)
    sigma = (sample * p * (1 - p)) ** 0.5
    assert abs(big.mean() - sample * p) < 4 * sigma / 300**0.5 and 0.85 < big.std() / sigma < 1.15
    rows = np.array([3 * 10**9, 10**9, 5])
    m = sharding.matrix(rows, 7, 2)
    assert (m.sum(axis=1) == rows).all() and m.sum(axis=0).max() - m.sum(axis=0).min() <= 1


def luhn(s):
    return sum(d if k % 2 == 0 else d * 2 - 9 * (d > 4) for k, d in enumerate(map(int, reversed(s)))) % 10 == 0


def test_pseudonyms(spark):
    t = ["4952935900253052 and 4952-9359-0025-3052", "9807915762804490", "2001-02-03, 03.02.2001, 2001-02-30", "+1 (017) 555-7713", "97.51.17.173 300.1.1.1", "GB82 WEST 1234 5698 7654 32", 'token = "b44e15e09fd311c3cf3163b66d5a9875b883d8ce"', "me.34@mail7.example.com", None, "", "plain", " 4952935900253052 a"]
    got = {r["doc_id"]: r["text"] for r in pii.pseudonymise(frame(spark, t)).collect()}
    a, b = got[0].split(" and ")
    assert a != t[0][:16] and luhn(a) and b == f"{a[:4]}-{a[4:8]}-{a[8:12]}-{a[12:]}" and a in got[11]
    assert got[1] == t[1] and [got[i] for i in (8, 9, 10)] == [None, "", "plain"]
    iso, dotted, bad = got[2].split(", ")
    assert iso != "2001-02-03" and "-".join(dotted.split(".")[::-1]) == iso and bad == "2001-02-30"
    assert re.fullmatch(r"\+1 \(\d{3}\) \d{3}-\d{4}", got[3]) and got[3] != t[3]
    assert re.fullmatch(r"(\d+\.){3}\d+ 300\.1\.1\.1", got[4]) and "97.51.17.173" not in got[4]
    assert re.fullmatch(r"GB\d\d WEST( \d{4}){3} \d\d", got[5]) and got[5] != t[5]
    assert re.fullmatch(r'token = "[0-9a-f]{40}"', got[6]) and got[6] != t[6] and "me.34" not in got[7]
    assert got[11].startswith(" ") and got[11].endswith(" a")


IBANS = ["DE89370400440532013000 I said", "DE89 3704 0044 0532 0130 00 BIC COBADEFF", "GB82 WEST 1234 5698 7654 32 USD", "REF AB12 GB82 WEST 1234 5698 7654 32 USD", "DE89 3704 0044 0532 0130 00 4111 1111 1111 1111 12/27"]
CARDS = ["4111 1111 1111 1111 12/27", "4111111111111111 123", "no 12 4111-1111-1111-1111 9", "41111111 11111111 12/27", "3782 822463 10005 1234", "AB12 4111 1111 1111 1111", "4111 1111 1111 1111 5500 0055 5555 5559", "1234567890123 2024-01-05"]


def test_pseudonyms_before_other_words(spark):
    got = {r["doc_id"]: r["text"] for r in pii.pseudonymise(frame(spark, [*IBANS, *CARDS, "DE89370400440532013000", "4111111111111111"])).collect()}
    code, card = got[len(IBANS) + len(CARDS)], got[len(IBANS) + len(CARDS) + 1]
    four = lambda x, by=" ": by.join(x[i : i + 4] for i in range(0, len(x), 4))
    assert [got[0], got[1]] == [f"{code} I said", f"{four(code)} BIC COBADEFF"] and got[4] == f"{four(code)} {four(card)} 12/27"
    assert re.fullmatch(r"GB\d\d WEST( \d{4}){3} \d\d USD", got[2]) and got[2] != IBANS[2] and got[3] == f"REF AB12 {got[2]}"
    c = {t: got[len(IBANS) + i] for i, t in enumerate(CARDS)}
    assert [c[t] for t in CARDS[:4]] == [f"{four(card)} 12/27", f"{card} 123", f"no 12 {four(card, '-')} 9", f"{card[:8]} {card[8:]} 12/27"]
    assert luhn(c[CARDS[4]][:-5].replace(" ", "")) and c[CARDS[4]].endswith(" 1234") and c[CARDS[4]] != CARDS[4]
    assert c[CARDS[5]] == f"AB12 {four(card)}" and c[CARDS[6]].startswith(four(card)) and not c[CARDS[6]].endswith("5559")
    assert c[CARDS[7]].startswith("1234567890123 ") and c[CARDS[7]] != CARDS[7]


def test_feistel_is_a_permutation(spark):
    n = F.col("id")
    p = pii.feistel(F.floor(n / 11), n % 11, F.lit(7), F.lit(11), F.lit("k"), "x")
    rows = spark.range(77).select(p.alias("p")).select("p.l", "p.r").distinct().collect()
    assert len(rows) == 77 and all(0 <= r["l"] < 7 and 0 <= r["r"] < 11 for r in rows)


def test_toxicity_held_out(spark):
    rng = random.Random(4)
    bad = {"en": "idiot moron scum".split(), "de": "depp trottel lump".split()}
    filler = {"en": "the and of to in is".split(), "de": "der die und in den von".split()}
    rows, labels = [], []
    for i in range(700):
        lang = "en" if i % 3 else "de"
        toxic = int(rng.random() < 0.3)
        w = [rng.choice(filler[lang]) if rng.random() < 0.4 else f"w{rng.randrange(3000)}" for _ in range(rng.randrange(5, 120))]
        for _ in range(toxic * rng.randrange(2, 6)):
            w.insert(rng.randrange(len(w)), rng.choice(bad[lang]))
        rows.append(" ".join(w))
        labels.append((i, None, toxic))
    docs = frame(spark, [*rows, None, ""])
    model = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = {r["doc_id"]: r for r in toxicity.score(docs, model).collect()}
    test = [i for i in range(700) if zlib.crc32(str(i).encode()) % 5 == 0]
    right = np.mean([got[i]["predicted"] == labels[i][2] for i in test])
    assert right > 0.93 and got[700]["score"] == got[701]["score"] == 0 and got[0].__fields__[:3] == ["doc_id", "text", "lang"]
    assert toxicity.fit(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int")) is None
    assert {r["score"] for r in toxicity.score(docs, None).collect()} == {0.0}


def test_empty_tables(spark):
    docs = frame(spark, [])
    for made in (bpe.round_trip(docs), exact.mark(docs), exact.keep(docs), minhash.near_duplicates(docs), packing.pack(docs), sharding.shuffle(docs), pii.pseudonymise(docs), grammar.read_back(grammar.write_ids(docs)), toxicity.score(docs, None)):
        assert made.count() == 0


def test_training_takes_each_document_once_and_bounded(spark):
    texts = [(i, f"text {i} " + "x" * 90) for i in range(40)] + [(7, "text 7 again")] * 500 + [(8, "y" * 5000)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    usable = labels.where(~toxicity.held_out(F.col("doc_id"))).count()
    every = toxicity.training_texts(docs, labels).collect()
    assert len(every) == len({r["doc_id"] for r in every}) == usable
    few = toxicity.training_texts(docs, labels, most=1700).collect()
    sizes = [sum(len(r["text"]) for r in few if r["toxic"] == k) for k in (0, 1)]
    assert 0 < min(sizes) <= max(sizes) <= 1700 and len(few) < usable and {(r["doc_id"], r["text"]) for r in few} <= set(texts)


def test_grammar_goes_on_until_no_pair_is_frequent():
    row = np.arange(64)
    coded = bpe.Coded(np.tile(row, 40).astype(np.int32), np.arange(0, 64 * 40 + 1, 64), np.arange(64, dtype=np.int32), np.ones(64, np.int64))
    made, symbols, own, tokens = grammar.compress(coded, 64, 0)
    assert own.tolist() == [2] * 40 and tokens.tolist() == [65] * 40
    flat, start, length = grammar.expansions(64, made.rules, made.expansions)
    assert (grammar._spread(symbols[:1], flat, start, length) == row).all()


def test_light_rows_agree_only_with_their_like():
    """Rows whose weights sum to so little that darts don't reach all coordinates."""
    one, two = np.arange(1, 11, dtype=np.uint64), np.arange(101, 111, dtype=np.uint64)
    for weight in (0.01, 0.001, 1e-6):
        got = minhash.signatures(np.concatenate([one, two, one]), np.array([0, 10, 20, 30]), 128, np.full(30, weight))
        assert (got[0] == got[1]).sum() == 0 and (got[0] == got[2]).all()
    other = minhash.signatures(np.concatenate([one, one]), np.array([0, 10, 20]), 128, np.repeat([0.001, 0.002], 10))
    assert (other[0] == other[1]).mean() < 0.7
    assert (minhash.signatures(one[:0], np.array([0, 0]), 16) == 2**64 - 1).all()


def test_exact_dedup_of_rows_with_columns_of_any_type(spark):
    rows = [(1, "a b", {"k": 1}, [{"x": 2}]), (2, "ab", {"k": 2}, None), (2, "ab", {"k": 3}, None), (3, None, None, [])]
    df = spark.createDataFrame(rows, "doc_id long, text string, _digest map<string,int>, _row array<map<string,int>>")
    assert sorted((r["doc_id"], r["text"]) for r in exact.keep(df).collect()) == [(1, "a b"), (3, None)]
    assert sorted(r["group_size"] for r in exact.mark(df).collect()) == [1, 3, 3, 3]
