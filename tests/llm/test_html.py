import random

import numpy as np
import pytest

from tests.llm.hand_pages import MARK, PAGES
from tidefold.llm import html as h

SF = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def trained(spark):
    """A network fitted on 300 pages, and the pages it has not seen."""
    rows = spark.read.parquet(f"{SF}/pages.parquet").orderBy("page_id").collect()
    return h.fit_network(h.examples_of([r.html for r in rows[:300]])), [r.html for r in rows[300:]]


def texts(page):
    return [b.text for b in h.blocks(page)]


def test_blocks():
    assert texts("<p><b>A &amp; B\n  c<br>d<p>e&nbsp;&#233;</p>tail") == ["A & B c d", "e é", "tail"]
    assert texts("<title>t</title><script>var a='<p>x</p>'</script><style>p{}</style><!-- <p>y</p> -->z") == ["z"]
    assert texts("<ul><li>a<li>b<ul><li>c</ul></ul>d <i>e</i>f") == ["a", "b", "c", "d ef"]
    assert texts('<a title="x > y">link</a> 1 < 2 &lt;b&gt; <div class="q>unclosed') == ["link 1 < 2 <b>", "unclosed"]
    assert texts(None) == texts("") == texts("<br><p> \n</p>") == []
    assert h.blocks('<div class="side-bar"><p>x')[0].path == ("div", ".side", ".bar", "p")
    assert h.blocks("<p><b>x<p>y")[1].path == ("p",)
    assert texts("<" * 50_000 + "x")  # no quadratic time on broken markup
    assert texts('<a "' * 2_000)


def test_gradients_match_finite_differences(monkeypatch):
    rnd = np.random.default_rng(0)
    net = h.Network.fresh(1)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    pages = [rnd.random((n, h.WIDTH)).astype(np.float32) for n in (5, 2)]
    x, mask = h._padded(pages)
    y = (rnd.random(mask.shape) < 0.5).astype(np.float32)
    _, grad = net.gradients(x, mask, y)
    for k in net.p:
        for _ in range(3):
            at = tuple(rnd.integers(0, s) for s in net.p[k].shape)
            old, e = net.p[k][at], 1e-3
            net.p[k][at] = old + e
            up = net.gradients(x, mask, y)[0]
            net.p[k][at] = old - e
            down = net.gradients(x, mask, y)[0]
            net.p[k][at] = old
            assert abs((up - down) / (2 * e) - grad[k][at]) < 1e-3


def test_padding_and_batches_change_nothing(monkeypatch):
    rnd = np.random.default_rng(2)
    net = h.Network.fresh(0)
    pages = [rnd.random((n, h.WIDTH)).astype(np.float32) for n in (7, 0, 3, 50, 1)]
    together = net.score(pages)
    monkeypatch.setattr(h, "BATCH_BLOCKS", 1)
    assert all(np.allclose(a, b, atol=1e-5) for a, b in zip(together, net.score(pages)))


def test_held_out_pages(trained):
    net, held = trained
    want = ["\n".join(b.text for b, l in zip(bs, h.weak_labels(bs) or []) if l) for bs in map(h.blocks, held)]
    assert np.mean([a == b for a, b in zip(h.extract(net, held), want)]) > 0.995
    rnd, pool = random.Random(8), [b.text for p in held[:100] for b in h.blocks(p) if len(b.text.split()) > 3]
    for style in set(h.STYLES):
        made = [h.synthetic_page(pool, rnd, style) for _ in range(200)]
        scores = net.score([h.vectors(h.blocks(p)) for p, _ in made])
        assert all(len(s) == len(l) for (_, l), s in zip(made, scores))
        assert np.concatenate([(s >= 0.5) == np.array(l) for (_, l), s in zip(made, scores)]).mean() > 0.95, style


def test_hand_labelled_pages(trained):
    net, _ = trained
    right = []
    for page in PAGES:
        want = [b.text.startswith(MARK) for b in h.blocks(page)]
        scores = net.score([h.vectors(h.blocks(page.replace(MARK, "")))])[0]
        assert len(scores) == len(want) and any(want) and not all(want)
        right += list((scores >= 0.5) == want)
    assert len(PAGES) == 20 and np.mean(right) >= 0.9
    listing = h.extract(net, [PAGES[0].replace(MARK, "")])[0]
    assert "with open(path) as f: for line in f: print(line)" in listing and "Docs 2024" not in listing


def test_place_of_a_block():
    a, b, c, d = h.blocks("<div><p>x<p>y</div><div>z<span>!</span></div>w")
    assert a.inside[0] == b.inside[0] and a.inside != b.inside and len(c.inside) == 1 and c.inside != a.inside[:1] and d.inside == ()
    x = h.vectors([a, b, c, d])[:, -h.NUMBERS :]
    share = x[:, [9, 12, 15]]  # of the text, in the three innermost elements (the page itself, where there are fewer)
    assert np.allclose(share, np.array([[5, 2, 1], [5, 2, 1], [5, 5, 2], [5, 5, 5]]) / 5)


def test_query_and_edge_cases(spark):
    sf = "/root/testdata/sf0.001"
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    out = h.op2_html(spark, sf)
    assert out.count() == pages.count() and all(r.n_chars == len(r.text) for r in out.collect())
    one = pages.first()
    odd = spark.createDataFrame([(None, "u", one.html), (1, None, None), (2, "v", ""), (1, None, None)], "page_id long, url string, html string").selectExpr("*", "'x' AS text")
    net = h.train_labeller(odd)
    got = h.main_text(odd, net).collect()
    assert sorted(r.n_chars for r in got)[:3] == [0, 0, 0] and len(got) == 4
    assert h.main_text(odd, net).columns == ["page_id", "url", "text", "text_", "n_chars"]
    assert h.main_text(odd.limit(0), h.train_labeller(odd.limit(0))).count() == 0
