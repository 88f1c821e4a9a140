"""Vectors and pages against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rowloom.llm import embedding_dedup, html_extract


def brute_vectors(rows, threshold=0.98):
    ids = [r[0] for r in rows]
    usable = [r[2] is not None and r[1] is not None and len(r[1]) > 0 and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1]) for r in rows]
    links, up = [0] * len(rows), list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if usable[a] and usable[b] and rows[a][2] == rows[b][2] and len(rows[a][1]) == len(rows[b][1]):
                x, y = np.array(rows[a][1], np.float32).astype(float), np.array(rows[b][1], np.float32).astype(float)
                if x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= threshold:
                    links[a] += 1
                    links[b] += 1
                    up[max(root(a), root(b))] = min(root(a), root(b))
    least = {}
    for k, i in enumerate(ids):
        least[root(k)] = min(least.get(root(k), i), i)
    return {i: (links[k], least[root(k)], least[root(k)] == i) for k, i in enumerate(ids)}


def test_near_vectors(spark, monkeypatch):
    draw = np.random.default_rng(3)
    base = draw.normal(size=(40, 16))
    rows = [[k, (base[k % 40] + draw.normal(0, draw.choice([0.02, 0.12]), 16)).tolist(), int(k % 40 > 20)] for k in range(240)]
    rows += [[300, None, 0], [301, [0.0] * 16, 0], [302, [1.0, None] * 8, 0], [303, [float("nan")] * 16, 0], [304, rows[0][1], None], [305, [], 0]]
    rows += [[306, rows[0][1], 0], [307, rows[0][1], 0], [308, [float("inf")] * 16, 0], [309, [1.0, 2.0], 0], [310, [2.0, 4.0], 0], [311, (np.array(rows[0][1]) * 1e-18).tolist(), 0]]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("n", F.lit("own"))
    want = brute_vectors(rows)
    for bucket, block in ((512, 2048), (4, 8)):
        # smaller buckets and blocks only deal the same pairs out differently
        monkeypatch.setattr(embedding_dedup, "BUCKET_ROWS", bucket)
        monkeypatch.setattr(embedding_dedup, "BLOCK_ROWS", block)
        found = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_vectors(frame, missed=1e-6).collect()}
        assert found == want
    assert embedding_dedup.near_vectors(frame.limit(0)).count() == 0


def test_recall_of_the_stretches():
    draw = np.random.default_rng(5)
    a = embedding_dedup.units(draw.normal(size=(4000, 64)))
    side = draw.normal(size=a.shape)
    side = embedding_dedup.units(side - (side * a).sum(axis=1, keepdims=True) * a)
    b = 0.98 * a + np.sqrt(1 - 0.98**2) * side  # pairs exactly at the threshold, the hardest ones
    bits, number = embedding_dedup.stretches(1_000_000, 0.98)
    met = (embedding_dedup.buckets(a, bits, number) == embedding_dedup.buckets(b, bits, number)).any(axis=1)
    assert bits >= 10 and met.mean() >= 0.99


def test_estimates_are_unbiased_and_bounds_hold():
    draw = np.random.default_rng(6)
    a, b = (embedding_dedup.units(draw.normal(size=(600, 64))) for _ in range(2))
    turn = embedding_dedup.rotation(64, 0)
    code = np.where(a @ turn >= 0, 1, -1) / 8
    correction = np.abs(a @ turn).sum(axis=1) / 8
    error = (code @ (b @ turn).T) / correction[:, None] - a @ b.T
    assert abs(error.mean()) < 0.005
    near = embedding_dedup.units(a + 0.02 * draw.normal(size=a.shape))
    want = set(zip(*np.nonzero(a @ near.T >= 0.98)))
    assert {(i, j) for x, y in embedding_dedup.block_links(a, near, 0.98) for i, j in zip(x.tolist(), y.tolist())} == want and want


PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style></head><body><div id="cookie-notice">Accept</div>
<header>Site</header><nav><ul><li><a href="/">Menu</a></li></ul></nav><div class="sidebar">Side</div><main><article>
<header><h1>Title &amp; more</h1></header><p>One<br>two <b>bo</b>ld&nbsp;&#233;<p>Three
 lines<ul><li>a<li>b</ul><table><tr><td>1<td>2</table><form>f<input></form><div class="ad">buy</div><aside>aside</aside>
<script>var x="</p><p>no";</script><!-- <p>no</p> --><p>1 < 2 &lt;b&gt;</p></article><section class="comments"><p>hi</p></section></main>
<footer>f</footer></body></html>"""


@pytest.mark.parametrize("source, want", [
    (PAGE, "Title & more One two bold é Three lines a b 1 2 1 < 2 <b>"),
    ("", ""), (None, ""), ("plain", "plain"), ("<p>a<div>b</div>c", "a b c"), ("<<<", "<<<"), ("<p", ""), ("<script>x", ""),
    ("<article></article><p>outside", "outside"), ("<div>" * 3000 + "deep", "deep"), ("a <!-- b", "a"), ("&amp;lt;", "&lt;"),
])
def test_main_text(spark, source, want):
    found = html_extract.main_texts(spark.createDataFrame([(1, "http://h/x", source)], "page_id long, url string, html string")).first()
    assert (found.text, found.n_chars) == (want, len(want))


def test_site_furniture_without_a_name_is_found(spark):
    page = "<body><div class='strip'><p>Same words everywhere</p></div><div class='text'><p>Own text {0}</p><p>and {0} more</p></div></body>"
    rows = [(k, f"https://Site.example/{k}", page.format("abcdefghijklmnop"[k])) for k in range(16)]
    rows += [(100, "https://lonely.example/", page.format("x")), (101, None, page.format("y")), (102, "https://site.example/c", rows[2][2])]
    rows += [(200 + k, "http://copies.example/", page.format("z")) for k in range(12)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("own"))
    found = {r.page_id: r.text for r in html_extract.main_texts(frame).collect()}
    assert found[3] == "Own text d and d more" and found[102] == found[2]
    assert found[100] == "Same words everywhere Own text x and x more"  # one page tells nothing
    assert found[201] == "Same words everywhere Own text z and z more"  # nor do copies of one page
    assert html_extract.main_texts(frame.limit(0)).count() == 0


def test_main_text_does_not_depend_on_the_size_of_the_host(spark):
    page = (
        "<body><div class='strip'><p>Same words everywhere</p></div><article><h2>Ingredients</h2><p>Own {0}</p><h2>Method</h2>"
        "<ul><li>{1}</li></ul><table><tr><td>yes</td><td>no</td></tr></table></article><div class='edge'><p>Ask {1}</p></div></body>"
    )
    plain = "<body><div class='strip'><p>Same words everywhere</p></div><div class='text'><p>Own {0}</p></div><div class='edge'><p>Ask {1}</p></div></body>"
    rows = []
    for m in (8, 100, 5000):
        for k in range(m):
            rows += [(len(rows), f"http://main{m}.example/{k}", page.format(k, "ab"[k % 2]))]
            rows += [(len(rows), f"http://plain{m}.example/{k}", plain.format(k, "ab"[k % 2]))]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = {r.url: r.text for r in html_extract.main_texts(frame).where("url rlike '/[0-7]$'").collect()}
    for m in (8, 100, 5000):
        for k in range(8):
            assert found[f"http://main{m}.example/{k}"] == f"Ingredients Own {k} Method {'ab'[k % 2]} yes no"
            assert found[f"http://plain{m}.example/{k}"] == f"Own {k} Ask {'ab'[k % 2]}"
