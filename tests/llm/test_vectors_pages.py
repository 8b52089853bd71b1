"""Vector search, page extraction and the pipeline."""

import random

import numpy as np
import pytest

from purseflow.llm import html_blocks, topk

pytest.importorskip("public_tokenizers")
VECTORS = "vec_id long, embedding array<float>, label int, ids string, part int, score int"


def naive_top(vectors, queries, k):
    """Rows (query, vec, score) in order, of distinct (id, vector) pairs."""
    out = []
    for q, v in queries:
        scored = sorted((-sum(a * b for a, b in zip(v, w)), c) for c, w in vectors if c != q)
        out += [(q, r, c, -s) for r, (s, c) in enumerate(scored[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("seed", range(3))
def test_top_k(spark, seed):
    rng = random.Random(seed)
    rows = [(i, [rng.gauss(0, 0.3) for _ in range(37)]) for i in range(300)]
    same = [rng.gauss(0, 0.3) for _ in range(37)]
    rows += [(1000 + i, same) for i in range(200)] + [(7, rows[7][1])]  # ties, and a repeated row
    bad = [(2000, None), (2050, [1.0, None]), (2100, [float("nan")]), (2150, [float("inf")]), (None, [1.0])]
    frame = spark.createDataFrame([(i, v, 0, "a", 1, 2) for i, v in rows + bad], VECTORS)
    vectors = topk.quantised(frame)
    f32 = lambda v: [float(np.float32(x)) for x in v]
    ints = sorted({(i, tuple(int(np.floor(256 * x)) for x in f32(v))) for i, v in rows})
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in topk.top_k(vectors, vectors.where("vec_id % 50 = 0"), 5, slices=3).collect())
    assert got == naive_top(ints, [x for x in ints if x[0] % 50 == 0], 5)


def test_top_k_awkward(spark):
    def run(rows, k=5):
        v = topk.quantised(spark.createDataFrame([(i, x, 0, "a", 1, 2) for i, x in rows], VECTORS))
        return sorted((r.query_id, r.rank, r.vec_id, r.score) for r in topk.top_k(v, v.where("vec_id % 50 = 0"), k).collect())

    assert run([]) == [] == run([(1, [1.0])]) == run([(50, [1.0])])
    assert run([(50, [1.0, 2.0]), (1, [1.0])]) == [(50, 1, 1, 65536)]
    assert run([(50, []), (1, [])]) == [(50, 1, 1, 0)]
    huge = run([(50, [3e38]), (1, [3e38]), (2, [-3e38]), (3, [1.0])])
    assert [r[2] for r in huge] == [1, 3, 2] and huge[0][3] == (1 << 63) - 1


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p><p>no";</script></head><body><nav><ul><li><a href="/x">Menu one</a></li><li><a>Menu two</a></li></ul></nav>
<!-- a <p>note</p> --><div class="ad">Buy {ad} now, it is good and cheap.</div><article><h1>{title}</h1>{body}</article><footer>&copy; site &middot; All rights reserved.</footer></body></html>"""


def pages(rng, n):
    words = "river stone cloud window letter garden paper summer mountain doctor music silver".split()
    text = lambda a, b: " ".join(rng.choice(words) for _ in range(rng.randrange(a, b))) + "."
    out = []
    for i in range(n):
        paras = [text(3, 40) for _ in range(rng.randrange(2, 9))]
        body = "".join(f"<p>{p}</p>" if rng.random() < 0.8 else f"<p><b>{p}<br>" for p in paras)
        title = text(2, 8)
        out.append((i, f"http://x/{i}", PAGE.format(ad=text(1, 5), title=title, body=body), "\n\n".join([title, *paras])))
    return out


def test_extraction(spark):
    rows = pages(random.Random(3), 160)
    extra = [(1000, "u", None, ""), (1001, "u", "", ""), (1002, None, "<p", ""), (None, "u", "<article><p>a &amp; b\n c&#233;&nbsp;d</article>", None), (1003, "u", "<div>" * 3000 + "deep", None), (1003, "u", "</p></b><p>x<table><tr><td>y", None)]
    frame = spark.createDataFrame([(i, u, h, "x", 1) for i, u, h, _ in rows + extra], "page_id long, url string, html string, text string, n_chars int")
    model = html_blocks.fit(frame)
    got = html_blocks.extract(frame, model).collect()
    assert len(got) == len(rows) + len(extra)
    by = {r.page_id: r for r in got}
    for r in got:
        assert r.n_chars == len(r.text)
    assert np.mean([by[i].text == want for i, _, _, want in rows]) > 0.95
    assert by[1000].text == by[1001].text == ""
    assert html_blocks.extract(frame.limit(0), model).count() == 0


def test_parser():
    text = lambda h: [b.text for b in html_blocks.parse(h)]
    assert text("<p>a &lt;b&gt;\n\tc<p>d<br>e<script>x<p></script><!-- <p> -->f</p>g") == ["a <b> c", "d ef", "g"]
    assert text("<head><title>t</title></head><select><option>o1<option>o2</select><a href='x>y'>l</a>") == ["o1", "o2", "l"]
    assert text("1 < 2 &amp; 3") == ["1 < 2 & 3"]
    link = html_blocks.parse("<ul><li><a href=x>menu</a></li></ul>")[0]
    assert link.linked == 4 and link.path.size == 2 and link.path.leaf == link.leaf == "li"


def test_parser_is_linear():
    import time

    for page in ("<div class='a'>x " * 60_000, "x</p></span>" * 85_000, "<div>" * 100_000 + "</p>" * 100_000, "<p><b>" * 90_000 + "</p>" * 90_000, "<a \"" * 200_000 + "x", "<p>x<a href=\"'>" * 60_000, "<" * 500_000):
        start = time.process_time()
        html_blocks.parse(page)
        assert time.process_time() - start < 5


OTHER = """<html><body><div id="hd"><a href=/>Home</a> <a href=/n>News</a></div><ul class="topnav"><li><a href=/a>One</a><li><a href=/b>Two</a></ul>
<div class="col-left"><h1>{title}</h1>{body}</div><div class="col-right"><p>{ad}</p></div><div class="disclaimer">Terms and privacy. {ad}</div></body></html>"""


def test_extraction_from_a_layout_that_training_has_not_seen(spark):
    """Measured: the share of the words that are the article's, found and among the found."""
    rng = random.Random(13)
    seen = pages(rng, 160)
    frame = spark.createDataFrame([(i, u, h) for i, u, h, _ in seen], "page_id long, url string, html string")
    model = html_blocks.fit(frame)
    text = lambda a, b: " ".join(f"w{rng.randrange(300)}" for _ in range(rng.randrange(a, b)))
    rows = []
    for i in range(60):
        paras = [text(25, 60) + "." for _ in range(rng.randrange(3, 8))]
        title = text(3, 8)
        rows.append((i, "u", OTHER.format(title=title, body="".join(f"<p>{p}</p>" for p in paras), ad=text(2, 6)), "\n\n".join([title, *paras])))
    got = {r.page_id: r.text for r in html_blocks.extract(spark.createDataFrame([r[:3] for r in rows], "page_id long, url string, html string"), model).collect()}
    found = sum(len(set(got[i].split("\n\n")) & set(want.split("\n\n"))) for i, _, _, want in rows)
    wanted, given = sum(len(w.split("\n\n")) for *_, w in rows), sum(len(x.split("\n\n")) for x in got.values() if x)
    print("blocks found", found / wanted, "of those given", found / given)
    assert found / wanted > 0.9 and found / given > 0.8


def test_lstm_gradient():
    rng = np.random.default_rng(1)
    model = html_blocks.Labeller.new()
    model.weights = {k: v.astype(np.float64) for k, v in model.weights.items()}
    x, mask = html_blocks._padded([rng.normal(size=(n, html_blocks.WIDTH)) for n in (4, 2, 5)])
    y = (rng.random(mask.shape) < 0.5).astype(float)

    def loss():
        p = model.forward(x, mask)[0]
        return -(np.where(mask, y * np.log(p) + (1 - y) * np.log(1 - p), 0)).sum() / mask.sum()

    g = model.gradients(x, mask, y)
    for name, w in model.weights.items():
        at = tuple(rng.integers(n) for n in w.shape)
        w[at] += 1e-4
        up = loss()
        w[at] -= 2e-4
        down = loss()
        w[at] += 1e-4
        assert abs((up - down) / 2e-4 - g[name][at]) < 2e-3


def test_pipeline(spark, tmp_path):
    """run() against its stages by brute force, on a small folder of tables."""
    import corpus_pipeline
    from tests.llm.test_documents import TOKENIZER, library, naive_components, naive_fingerprint, naive_lines, sentence

    assert TOKENIZER
    rng = random.Random(21)
    texts = ["\n".join(sentence(rng, rng.randrange(8, 30)) for _ in range(rng.randrange(1, 5))) for _ in range(120)]
    texts += rng.sample(texts, 15)  # copies
    item = sentence(rng, 30)
    texts += [sentence(rng, 20) + " " + item + " " + sentence(rng, 20)]
    texts += [" | ".join(w.upper() + "!!" for w in sentence(rng, 80).split()) for _ in range(60)]
    texts += ["", texts[0] + "\n" + texts[1]]
    docs = [(i, t) for i, t in enumerate(texts)]
    labels = [(i, int("!!" not in t), 0) for i, t in docs if t]
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    first = corpus_pipeline.STAGES[0][1](spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path))
    good = {r.doc_id: r.text for r in first.collect()}
    assert all("!!" not in t for t in good.values()) and len(good) >= 130
    lines = naive_lines(spark, sorted(good.items()))
    roots = naive_components({d: naive_fingerprint(t) for d, t in lines.items()})
    kept = {d: lines[d] for d, r in roots.items() if d == r and item not in lines[d]}
    t = library()
    got = {r.doc_id: r.ids for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert got == {d: t.encode(x, add_special_tokens=False).ids for d, x in kept.items()}
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "line_dedup", "near_dedup", "decontamination", "bpe"]
