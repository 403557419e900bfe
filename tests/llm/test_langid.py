"""Language identification: grams against a literal count, decisions by hand-made weights, accuracy on languages made up here."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from contactsheet.llm import langid

SCHEMA = "doc_id long, text string, lang string, score string, lang_pred map<string,int>"


def plain_grams(text):
    kept = "".join(chr(c) if c >= 128 or 97 <= c <= 122 else " " for c in text.lower().encode())
    while "  " in kept:
        kept = kept.replace("  ", " ")
    body = ("\x01" + (kept[1:] if kept.startswith(" ") else kept) + "\x01").encode("latin-1")
    out = []
    for n in langid.ORDERS:
        for i in range(len(body) - n + 1):
            g = body[i : i + n]
            if 1 in g[1:-1] or (n == 2 and g == b"\x01\x01"):
                continue
            out.append((int.from_bytes(g, "big") + n) * 0x9E3779B97F4A7C15 % 2**64 >> (64 - langid.BITS))
    return sorted(out)


def test_grams():
    texts = ["The cat, sat", "", None, "Ä 12 ß", "  x  ", "a", "...", "Σίσυφος"]
    g = langid.grams(pa.array(texts, pa.string()))
    for k, text in enumerate(texts):
        own = np.sort(np.concatenate([row[g.starts[k] : g.starts[k + 1]] for row in g.rows]))
        assert own[own < 1 << langid.BITS].tolist() == plain_grams(text or ""), text
    assert langid.grams(pa.array([], pa.string())).starts.tolist() == [0]


def test_family_comes_first_and_votes_decide_within_it():
    m = langid.Model([["a", "b", "c"], ["x"]], np.zeros((1, 4), np.float32), [(0, 0, 1), (0, 0, 2), (0, 1, 2)])
    z = np.array([[1, 1, 1, 1], [1, -1, 1, 1], [1, -1, -1, -1], [-1, 1, 1, 1], [1, 2, -1, 1], [1, 1, -1, 1]], float)
    best, score = langid.decide(m, z)
    # In the last two rows each has one vote: the greater sum of margins, then the first.
    assert best.tolist() == [0, 1, 2, 3, 0, 0] and ((0 <= score) & (score <= 1)).all()


def test_families_join_the_alike():
    base = np.eye(6)
    profiles = np.array([base[0] + 0.3 * base[1], base[0] + 0.3 * base[2], base[3] + 0.2 * base[4], base[3] + 0.2 * base[5], base[5]])
    assert langid.grouped(["en", "de", "es", "it", "ja"], profiles) == [["de", "en"], ["es", "it"], ["ja"]]
    assert langid.grouped(["en"], profiles[:1]) == [["en"]]


def test_machine_parts_what_can_be_parted():
    rng = np.random.default_rng(2)
    y = np.where(rng.random(80) < 0.3, 1.0, -1.0)
    x = langid.Rows([np.array([0, 1, 2])] * 80, [np.array([v * 0.2, *rng.normal(size=2)]) for v in y])
    w = langid.machine(x, y, cost=100, epochs=200)
    assert all(v * (w[:3] @ a) > 0 for v, a in zip(y, x.values))


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(7)
    # Two families of syllables; languages of one differ in few of them.
    north, south = ["ver", "ung", "sch", "keit", "ein", "aus", "lich", "ge"], ["cion", "ado", "que", "las", "ero", "mente", "ia", "os"]
    own = {"aa": north + ["the", "ing"], "ab": north + ["der", "haft"], "ba": south + ["el", "ción"], "bb": south + ["le", "eau"], "ca": ["私", "は", "猫", "です", "本", "を"]}
    def text(lang, words):
        return " ".join("".join(rng.choice(own[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(words)).capitalize() + "."
    return [(i, text(lang := sorted(own)[i % 5], rng.choice((12, 60, 300))), lang) for i in range(400)]


def test_held_out_documents(spark, corpus):
    rows = [(*r, "mine", {"a": 1}) for r in corpus]
    rows += [(900, None, "aa", "", None), (901, "", "aa", "", None), (902, "12 -- 34", "ab", "", None), (903, corpus[0][1] * 400, None, "", None), (None, corpus[1][1], "ab", "", None)]
    df = spark.createDataFrame([*rows, rows[4]], SCHEMA).repartition(3)
    model = langid.fit(df)
    assert model.families == [["aa", "ab"], ["ba", "bb"], ["ca"]]
    got = {r["doc_id"]: r for r in langid.identify(df, model).collect()}
    want = {i: lang for i, _, lang in corpus}
    held = [i for i in want if zlib.crc32(str(i).encode()) % 4 == 2]
    assert len(held) > 60 and sum(got[i]["lang_pred"] == want[i] for i in held) / len(held) > 0.97
    assert all(got[i]["lang_pred"] == "und" for i in (900, 901, 902)) and got[903]["lang_pred"] == "aa"
    assert all(0 <= r["score"] <= 1 for r in got.values()) and got[0].asDict().keys() == {"doc_id", "text", "lang", "lang_pred", "score"}
    assert {r["doc_id"] for r in langid.training_texts(df).collect()} & {*held, None, 900, 901, 902, 903} == set()
    assert langid.training_texts(df, sample=50).groupBy("lang").count().where("count <> 10").count() == 0


def test_labels_of_held_out_documents_change_nothing(spark, corpus):
    held = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    one = spark.createDataFrame(corpus, "doc_id long, text string, lang string")
    two = spark.createDataFrame([(i, t, "zz" if held(i) else lang) for i, t, lang in corpus], one.schema)
    assert (langid.fit(one).weights == langid.fit(two).weights).all()


def test_one_language_none_and_no_rows(spark, corpus):
    df = spark.createDataFrame([r for r in corpus if r[2] == "ab"], "doc_id long, text string, lang string")
    assert {(r["lang_pred"], r["score"]) for r in langid.identify(df, langid.fit(df)).collect()} == {("ab", 1.0)}
    two = spark.createDataFrame([r for r in corpus if r[2] in ("aa", "ca")], df.schema)
    assert {r["lang_pred"] for r in langid.identify(two, langid.fit(two)).where("lang = 'ca'").collect()} == {"ca"}
    assert langid.fit(df.limit(0)) is None
    assert {r["lang_pred"] for r in langid.identify(df, None).collect()} == {"und"}
    assert langid.identify(df.limit(0), langid.fit(df)).count() == 0
