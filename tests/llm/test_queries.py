"""Every registered query of the subpackage, and the whole pipeline, over small tables with odd rows and over empty ones."""

import hashlib
import random
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from contactsheet.llm import bpe, minhash, queries, toxicity

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long, _node long, _key string, score double"
CONVERSATIONS = "conv_id long, turn long, role string, text string, audit string"
LABELS = "doc_id long, quality int, toxic int"


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(2)
    word = lambda n=4000: f"w{rng.randrange(n)}"
    out = {}
    for i in range(160):
        own = [word() for _ in range(rng.randrange(20, 200))]
        if i % 4 == 0:
            for _ in range(6):
                own.insert(rng.randrange(len(own)), rng.choice(["vile", "scum", "filth"]))
        out[i] = " ".join(own)
    out[200], out[201], out[202], out[203] = None, "", " \t", out[1]
    out[204] = out[2].replace(" ", "  ")
    out[205] = " ".join([*out[3].split()[:-1], "other"])
    out[206] = "mail me at someone@mail.example.com or 4111 1111 1111 1111 " + out[5]
    out[207] = "long " * 30000
    return out


@pytest.fixture(scope="module")
def small(spark, texts, tmp_path_factory):
    at = tmp_path_factory.mktemp("small")
    rows = [(i, t, "en", "s", len(t) if t is not None else None, 7, "mine", 0.5) for i, t in texts.items()]
    rows += [rows[8], (None, "no id", None, None, None, 7, "mine", None), (None, None, None, None, None, None, None, None)]
    spark.createDataFrame(rows, DOCUMENTS).repartition(3).write.parquet(f"{at}/documents.parquet")
    labels = [(i, 1, int(i % 4 == 0)) for i in range(160)] + [(3, 1, 1), (None, 0, 1), (5, 0, None)]
    spark.createDataFrame(labels, LABELS).write.parquet(f"{at}/labels.parquet")
    pages = [(1, "u", "<article><p>One text &amp; more of it, as it is.</p></article>"), (2, None, None), (1, "u", ""), (None, "u", "<p>x")]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{at}/pages.parquet")
    vectors = [(i, [float(i % 7), float(i), 1.0], 0) for i in range(0, 320, 20)] + [(100, None, 1), (None, [1.0, 2.0, 3.0], 1)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").write.parquet(f"{at}/embeddings.parquet")
    talk = [(c, t, ("user", "assistant")[t % 2], f"Turn {t} of {c}.") for c in range(30) for t in range(4)] + [(None, None, None, None), (7, 2, "assistant", ""), (50, 1, "user", "long " * 9000)]
    spark.createDataFrame([(*r, "x") for r in talk], CONVERSATIONS).repartition(3).write.parquet(f"{at}/conversations.parquet")
    return str(at)


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("empty")
    for name, schema in (("documents", DOCUMENTS), ("labels", LABELS), ("pages", "page_id long, url string, html string"), ("embeddings", "vec_id long, embedding array<float>, label int"), ("conversations", CONVERSATIONS)):
        spark.createDataFrame([], schema).write.parquet(f"{at}/{name}.parquet")
    return str(at)


def test_queries_over_odd_rows(spark, small, texts):
    n = len(texts) + 3
    got = {name: query(spark, small).collect() for name, query in queries.QUERIES.items()}
    for name in ("op1_toxicity", "op2_bpe", "op3_exact_dedup", "op4_minhash", "op8_pii", "op9_sharding", "op10_token_ids", "op12_language_id", "op13_periodic_runs"):
        assert len(got[name]) == n, name
    one = {r["doc_id"]: r for r in got["op1_toxicity"]}
    assert all(r["held_out"] == (i is not None and zlib.crc32(str(i).encode()) % 5 == 0) and r["predicted"] == (r["score"] >= 0.5) for i, r in one.items())
    assert Counter(one[i]["predicted"] == (i % 4 == 0) for i in range(160) if one[i]["held_out"])[False] <= 2 and one[200]["score"] == one[201]["score"] == 0
    two = {r["doc_id"]: r for r in got["op2_bpe"]}
    assert two[200]["n_tokens"] == 0 and two[200]["decoded_sha256"] == hashlib.sha256(b"").hexdigest() and two[207]["decoded_sha256"] == hashlib.sha256(texts[207].encode()).hexdigest()
    three = {r["doc_id"]: r for r in got["op3_exact_dedup"]}
    assert (three[203]["keep_id"], three[2]["keep_id"], three[202]["group_size"]) == (1, 204, 4) and sum(r["kept"] for r in got["op3_exact_dedup"]) == n - 6
    eight = {r["doc_id"]: r for r in got["op8_pii"]}
    assert eight[206]["changed"] and "someone@" not in eight[206]["text"] and "4111 1111" not in eight[206]["text"] and eight[200]["text"] is None and sum(r["changed"] for r in eight.values()) == 1
    sizes = Counter(r["shard"] for r in got["op9_sharding"])
    assert max(sizes.values()) - min(sizes.values()) <= 1 and all(r["size"] == 8 for r in got["op9_sharding"] if r["doc_id"] == 200)
    ten = sorted(got["op10_token_ids"], key=lambda r: r["start"])
    assert [r["start"] for r in ten] == [sum(x["n_tokens"] for x in ten[:k]) for k in range(n)] and [r["doc_id"] for r in ten if r["doc_id"] is not None] == sorted([*texts, 8])
    six = {(r["page_id"], r["url"]): r["text"] for r in got["op6_main_text"] if r["page_id"] != 1}
    assert six[2, None] == "" and len(got["op6_main_text"]) == 4
    seven = [r for r in got["op7_nearest"] if r["query_id"] == 100]
    assert {r["query_id"] for r in got["op7_nearest"]} == {0, 100, 200, 300} and [r["rank"] for r in sorted(seven, key=lambda r: r["rank"])] == list(range(1, 11)) and min(r["score"] for r in seven) > 0
    eleven = {r["conv_id"]: r for r in got["op11_conversation_repair"]}
    assert len(got["op11_conversation_repair"]) == 32 and eleven.keys() == {*range(30), 50, None} and eleven[7]["blank"] >= 1
    twelve = {r["doc_id"]: r for r in got["op12_language_id"]}
    assert all(r["held_out"] == (i is not None and zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for i, r in twelve.items())
    assert {i for i, r in twelve.items() if r["lang_pred"] == "und"} >= {200, 201, 202} and twelve[1]["lang_pred"] == "en"
    thirteen = {r["doc_id"]: r for r in got["op13_periodic_runs"]}
    assert thirteen[200]["n_runs"] == 0 and thirteen[200]["collapsed_sha256"] == hashlib.sha256(b"").hexdigest()
    assert (thirteen[207]["n_runs"], thirteen[207]["period"], thirteen[207]["length"]) == (1, 1, 30000)


def test_queries_over_empty_tables(spark, empty):
    for name, query in queries.QUERIES.items():
        assert query(spark, empty).count() == 0, name
    assert corpus_pipeline.run(spark, empty).count() == 0


def test_pipeline_equals_its_stages_by_hand(spark, small, texts):
    pieces = corpus_pipeline.run(spark, small).collect()
    docs = spark.read.parquet(f"{small}/documents.parquet")
    model = toxicity.fit(docs, spark.read.parquet(f"{small}/labels.parquet"))
    clean = {r["doc_id"] for r in toxicity.score(docs, model).where("predicted = 0").collect()}
    # Of equal texts the one with the most code points, then the smallest id; of near ones the smallest id.
    groups = {}
    for i in clean - {None}:
        groups.setdefault("".join((texts[i] or "").split()), []).append((-len(texts[i] or ""), i))
    kept = {min(g)[1] for g in groups.values()}
    words = {i: (texts[i] or "").lower().split() for i in kept}
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, w in words.items() if w}
    for i in sorted(sets):
        if i in kept and any(j < i and j in kept and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) for j in sets):
            kept.discard(i)
    got = {r["doc_id"] for r in pieces}
    assert got - {None} == kept and 205 not in got and 203 not in got and {r["piece"] for r in pieces if r["doc_id"] == 207} != {0}
    fill = Counter()
    for r in pieces:
        fill[r["sequence_id"]] += r["length"]
    assert max(fill.values()) <= 1024
    names = [f.name for f in docs.schema]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, small)
        assert docs.columns == names, name
    assert {(r["_node"], r["_key"]) for r in docs.where("doc_id is not null").collect()} == {(7, "mine")}


def test_copies_with_a_hub_of_thousands(spark):
    base = [f"w{k}" for k in range(60)]
    rows = [(i, " ".join([*base[:-1], f"x{i % 40}"])) for i in range(1500)] + [(5000, " ".join(f"y{k}" for k in range(60)))]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {(r["class_id"], r["count"]) for r in got.groupBy("class_id").count().collect()} == {(0, 1500), (5000, 1)} and got.where("kept").count() == 2


def test_automaton_equals_successive_merge_gadgets(tmp_path):
    """An automaton built state by state from a short list of merges, against the factored one."""
    import json

    import numpy as np

    spec = json.load(open(bpe.tokenizer_path(), encoding="utf-8"))
    vocab, merges = spec["model"]["vocab"], [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"][:150]]
    short = {c: i for i, c in enumerate([*sorted(bpe._byte_alphabet()), *dict.fromkeys(a + b for a, b in merges)])}
    assert set(short) <= set(vocab)
    spec["model"] |= {"vocab": short, "merges": merges}
    spec["added_tokens"] = []
    (tmp_path / "short.json").write_text(json.dumps(spec), encoding="utf-8")
    made = bpe.Automaton(str(tmp_path / "short.json"))
    arcs = {0: {i: 0 for c, i in short.items() if len(c) == 1}}
    for a, b in merges:
        u, v, w = short[a], short[b], short[a + b]
        behind = {q: arcs[q][v] for q in {own[u] for own in arcs.values() if u in own} if v in arcs[q]}
        split = {q: len(arcs) + k for k, q in enumerate(sorted(behind))}
        for q, new in split.items():
            arcs[new] = {x: to for x, to in arcs[q].items() if x != v}
        for own in arcs.values():
            if own.get(u) in split:
                q = own[u]
                own[u], own[w] = split[q], behind[q]
    tokens = np.array(sorted(short.values()))
    reached, todo = {0}, [0]
    while todo:
        for to in arcs[todo.pop()].values():
            if to not in reached:
                reached.add(to), todo.append(to)
    for p in reached:
        for x, q in arcs[p].items():
            there = made.arcs(np.full(len(tokens), x), tokens)
            assert set(tokens[there].tolist()) == set(arcs[q]), (x, q)
    rng = random.Random(3)
    for _ in range(300):
        word = "".join(rng.choice("theinaro s") for _ in range(rng.randrange(1, 14)))
        at, spelled = 0, []
        for t in made.one_word(word.encode()):
            assert t in arcs[at]
            at = arcs[at][t]
            spelled.append(made.labels[t])
        assert b"".join(spelled) == word.encode()
