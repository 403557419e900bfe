"""Main text of pages, nearest neighbours, and the pipeline."""

import random

import numpy as np

import __spark_entry__ as entry
import corpus_pipeline
from contactsheet.llm import ann, html


def page(rng, i):
    text = lambda a, b: " ".join(f"word{rng.randrange(500)}" for _ in range(rng.randrange(a, b))) + "."
    body = [text(15, 60) for _ in range(rng.randrange(2, 6))]
    menu = "".join(f'<li><a href="/{k}">{text(1, 3)}</a></li>' for k in range(6))
    return f'<html><head><title>{text(2, 4)}</title><script>var x="<p>";</script></head><body><nav><ul>{menu}</ul></nav><div class="ad">{text(5, 9)}</div><article><h1>T{i} &amp; U</h1>{"".join(f"<p>{b}" for b in body)}</article><section class="comments"><p>{text(5, 20)}</p></section><footer>&copy; {text(3, 8)}</footer></body></html>', "\n".join([f"T{i} & U", *body])


def test_main_text(spark):
    rng = random.Random(0)
    made = [page(rng, i) for i in range(60)]
    pages = spark.createDataFrame([(i, None, h, "x") for i, (h, _) in enumerate(made)] + [(900, "u", None, "x"), (901, "u", "", "x"), (902, None, "a < b &lt; c", "x")], "page_id long, url string, html string, text string")
    model = html.fit(pages, layouts=300)
    got = {r["page_id"]: r for r in html.extract(pages, model).collect()}
    assert sum(got[i]["text"] == want for i, (_, want) in enumerate(made)) >= 57
    assert got[900]["text"] == got[901]["text"] == "" and all(r["n_chars"] == len(r["text"]) for r in got.values())
    assert html.extract(pages.limit(0), model).count() == 0


def runs(source):
    dom = html.Dom()
    html.parse(dom, 0, source)
    return [t for t in dom.text if t]


def test_silent_parts_end_where_they_should():
    assert runs("<html><head><title>t</title><meta a=b><body><article><p>one<p>two</article>") == ["one", "two"]
    assert runs("<head><style>a</style><script>x<y</script><p>one") == ["one"]
    assert runs('<svg class="i"/><p>one<p>two <svg/>three<svg><svg/><text>no</text></svg>') == ["one", "two three"]
    assert runs("<svg><svg><title>no</title></svg>no</svg><p>one") == ["one"] == runs("<svg><g>no<p>one")
    for tag in "button select canvas noscript template textarea iframe audio video map svg".split():
        assert runs(f"<{tag} a='b'>no<article><p>one</article><{tag}>no</{tag}>") == ["one"], tag
        assert runs(f"<div><{tag}>no<b>no</b></{tag}>one</div>") == ["one"], tag
    assert runs("<p>of <math><mi>x</mi><mo>=</mo><mn>2</mn></math> and <object>text</object>") == ["of x=2 and text"]
    assert runs("<p>one<script>var a = 1; <p>no") == ["one"] == runs("<p>one<!-- no <p>no") and runs("<p>one <button>two three") == ["one two three"]
    assert runs("<svg>" * 2000 + "<p>one") == ["one"]


def test_attributes_are_read_as_written():
    assert runs("<p title=it's>First text. Don't drop</p><p a='x > y'>two</p>") == ["First text. Don't drop", "two"]
    assert runs('<p title="open>one</p><p>two</p>') == ["one", "two"] and runs('<p a=">">one<p b = \'"\' c>two') == ["one", "two"]
    assert runs("<article data-part=\"intro\" data-part=1>one</article><p data-part=''>two") == ["one", "two"]
    dom = html.Dom()
    html.parse(dom, 0, '<div title="class=ad id=menu" data-class="nav"><p CLASS = comments>x</p></div><div data-part="1"/>y')
    assert dom.bad[1] == 0 and dom.talk[2] == 1 and set(dom.part) == {-1} and dom.text[-1] == "y"
    assert runs("<html><title>t</title><p>no head ends</p><iframe/>a<textarea>b<p>c") == ["no head ends", "a", "c"]
    assert runs("<p x=" + "'" * 9999 + ">one") == ["one"] and runs("<p " + "= " * 50000 + ">one") == ["one"]


def test_pages_that_name_parts_teach_nothing(spark):
    rng = random.Random(0)
    bare = [page(rng, i)[0] for i in range(30)]
    odd = [h.replace("<article>", '<article data-part="0">').replace("<footer>", '<footer data-part="intro">') for h in bare]
    models = [html.fit(spark.createDataFrame(list(enumerate(x)), "page_id long, html string").selectExpr("page_id", "cast(page_id as string) url", "html"), layouts=60) for x in (bare, odd)]
    assert all((getattr(models[0], k) == getattr(models[1], k)).all() for k in ("cut", "feature", "bin_", "leaf"))
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert html.extract(none, html.fit(none, layouts=30)).count() == 0


def test_decoding_is_the_best_of_all_choices():
    rng = np.random.default_rng(4)
    for _ in range(60):
        dom, n = html.Dom(), int(rng.integers(2, 13))
        for i in range(n):
            up = int(rng.integers(i)) if i else -1
            leaf = i > 0 and rng.random() < 0.5
            while up > 0 and dom.kind[up] == 0:
                up = dom.up[up]
            dom.node(0, up, 0 if leaf else html.KINDS["div"], text="x" * int(rng.integers(1, 40)) if leaf else "")
        odds = rng.normal(size=n)
        worth = [o * np.log2(1 + len(t)) if t else o for o, t in zip(odds, dom.text)]
        worth = [o if dom.kind[i] else w for i, (o, w) in enumerate(zip(odds, worth))]
        best = max(sum(worth[i] for i in range(n) if bits >> i & 1) for bits in range(1, 1 << n, 2) if all(not bits >> i & 1 or bits >> dom.up[i] & 1 for i in range(1, n)))
        kept = html.decode(dom, odds)
        assert kept[0] and all(kept[dom.up[i]] for i in range(1, n) if kept[i]) and abs(sum(w for w, k in zip(worth, kept) if k) - best) < 1e-9


def test_kept_nodes_have_kept_parents():
    rng = np.random.default_rng(1)
    dom = html.Dom()
    html.parse(dom, 0, "<div><p>one two</p><div><p>three</p>four</div></div><footer>five</footer>")
    for _ in range(50):
        kept = html.decode(dom, rng.normal(size=len(dom.up)))
        assert all(kept[u] for u, k in zip(dom.up, kept) if k and u >= 0)


def test_nearest_neighbours(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(12, 32)) * 2
    x = (centres[rng.integers(12, size=900)] + rng.normal(size=(900, 32))).astype(np.float32)
    x[100:160] = x[100]
    rows = [(i, v.tolist(), None) for i, v in enumerate(x)] + [(1000, None, 1), (1100, [0.0] * 32, 1), (1200, [float("nan")] * 32, 1), (1300, [None] + [1.0] * 31, 1), (1400, [], 1)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int")
    got = ann.search(vectors, vectors.where("vec_id % 20 = 0"), code_block=300, query_block=16).collect()
    y = x.astype(float)
    hits = 0
    for q in range(0, 900, 20):
        d = np.sqrt(((y - y[q]) ** 2).sum(axis=1))
        d[q] = np.inf
        want = np.lexsort((np.arange(900), d))[:10].tolist()
        own = sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == q)
        assert [k for k, _, _ in own] == list(range(1, 11)) and all(abs(s - d[v]) < 1e-9 for _, v, s in own)
        hits += len(set(want) & {v for _, v, _ in own})
    assert hits >= 0.98 * 450 and max(r["query_id"] for r in got) < 900
    few = vectors.where("vec_id < 3")
    assert ann.search(few, few).count() == 6 and ann.search(few.limit(0), few).count() == 0


def test_inner_products_come_from_packed_bits():
    rng = np.random.default_rng(3)
    bits, y = rng.random((50, 512)) > 0.5, rng.normal(size=(7, 512)).astype(np.float32)
    words = np.packbits(bits, axis=1, bitorder="little").view(np.uint64).T.copy()
    got, error = ann.common_bits(words, y)
    exact = y.astype(float) @ (bits * 2.0 - 1).T
    assert (np.abs(got - exact) <= error[:, None]).mean() > 0.999 and error.max() < 0.05 * np.abs(y).sum(axis=1).min()


def test_vectors_of_other_lengths_and_repeated_ids(spark):
    rng = np.random.default_rng(5)
    long, short = rng.normal(size=(40, 16)), rng.normal(size=(5, 3))
    rows = [(i, v.tolist()) for i, v in enumerate([*long, *short])] + [(0, long[0].tolist()), (3, [9.0] * 16), (None, long[1].tolist()), (50, [1.0] * 70)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = ann.search(vectors, vectors.where("vec_id % 20 = 0 or vec_id in (41, 50)"), k=4).collect()
    by = {q: [(r["rank"], r["vec_id"]) for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == q] for q in (0, 20, 40, 41, 50)}
    assert by[50] == [] and [len(by[q]) for q in (0, 20, 40, 41)] == [4] * 4
    for q, all_, first in ((0, long, 0), (20, long, 0), (41, short, 40)):
        d = np.sqrt(((all_ - all_[q - first]) ** 2).sum(axis=1))
        d[q - first] = np.inf
        assert [v for _, v in by[q]] == (np.argsort(d)[:4] + first).tolist()


def test_cells_far_away_are_not_met(spark, monkeypatch):
    rng = np.random.default_rng(6)
    x = (rng.normal(size=(20, 24)) * 50)[rng.integers(20, size=1500)] + rng.normal(size=(1500, 24))
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    met = []
    keep = ann.written
    monkeypatch.setattr(ann, "written", lambda df, name: (met.append(out.count()) if name == "probes" else None, out)[1] if (out := keep(df, name)) is not None else out)
    got = ann.search(vectors, vectors.where("vec_id % 10 = 0")).collect()
    cells = len(x) // 32
    assert len(got) == 1500 and met[1] < 0.4 * 150 * cells  # of all pairs of a query and a cell
    for q in range(0, 1500, 150):
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        d[q] = np.inf
        assert len(set(np.argsort(d)[:10]) & {r["vec_id"] for r in got if r["query_id"] == q}) >= 9


def test_pipeline_is_registered():
    assert entry.queries()["pipeline"] is corpus_pipeline.run
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact dedup", "near dedup", "pii", "packing"]


def test_pipeline_stages_keep_columns(spark):
    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names, n = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, sf_dir).toPandas(), docs.schema)
        assert docs.columns == names and 0 < docs.count() <= n
        n = docs.count()
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).select("doc_id").distinct().count() == n
