import html
import itertools
import random
import re

import numpy as np
import pytest

from vigilo.llm import html_text as h


def truth(page):
    inner = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    parts = [" ".join(html.unescape(re.sub(r"<[^>]+>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)>", inner)]
    return "\n".join(x for x in parts if x)


@pytest.fixture(scope="module")
def model(spark):
    return h.fit(spark.read.parquet("/root/testdata/sf0.01/pages.parquet"))


def test_pages_equal_their_articles(spark):
    pages = {r[0]: (r[1], r[2]) for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()}
    rows = h.op9(spark, "/root/testdata/sf0.01").collect()
    assert len(rows) == len(pages)
    assert all((r["url"], r["text"], r["n_chars"]) == (pages[r["page_id"]][0], t := truth(pages[r["page_id"]][1]), len(t)) for r in rows)


def test_other_designs_of_held_out_pages(spark, model):
    rnd = random.Random(2)
    right = total = 0
    for (page,) in spark.read.parquet("/root/testdata/sf0.1/pages.parquet").filter("page_id >= 1000").select("html").limit(100).collect():
        found = h.blocks(page)
        labels = h.marked(found)
        parts = [(b.own, b.text) for b, y in zip(found, labels, strict=True) if y]
        for design in h.DESIGNS:
            other, want = h.laid_out(parts, ["Nicht aulich, für sch.", "En la des et ou."], design, rnd)
            right += sum(a == b for a, b in zip(model.decode(other), want, strict=True))
            total += len(want)
    assert right / total > 0.98


def test_parts_of_a_page(model):
    page = """<html><head><title>T &amp; t</title><style>p{}</style></head><body><!-- <p>gone</p> --><nav><ul><li><a href=/>Home</a></li>
    <li><a href='/'>News</a></ul></nav><script>var a="<p>no</p>";</script><article><h1>A  title\n here</h1><p>First &lt;b&gt; para,
    with <b>bold<br>words</b> &copy;&nbsp;2&#48;.<p>Second paragraph stands here, a bit longer than the first one was.<form><p>Sign up</p><input name=q>
    <textarea>typed</textarea></form></article><aside><p>Related things</p></aside><div class=comments><h3>2 Comments</h3><p>Nice one!</p></div>
    <footer>&copy; us</footer>"""
    assert model.text(page) == ("A title here\nFirst <b> para, with bold words © 20.\n"
                                "Second paragraph stands here, a bit longer than the first one was.")


def test_edges(spark, model):
    rows = [(1, "u", None), (2, "u", ""), (3, None, "<p"), (4, "u", "<!-- open"), (5, "u", "<script>x"), (6, "u", "< < &bogus; <>"),
            (7, "u", "<article>" + "<div>" * 5000 + "<p>Deep inside, a sentence.</p>"), (7, "u", "<article>" + "<p>Word after word, again. " * 20000 + "</article>"),
            (None, "u", "<article><h1>Ä</h1><p>Ein Satz, der hier steht.</p></article>"), (9, "u", '<p class="' * 2000)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, text string")
    out = h.extract(df, model)
    got = {(r["page_id"], r["html"]): r["text"] for r in out.collect()}
    assert len(got) == len(rows) and out.columns == ["page_id", "url", "html", "text"]
    assert all(got[(k, x)] == "" for k, _, x in rows[:5])
    assert got[(None, rows[8][2])] == "Ä\nEin Satz, der hier steht."
    assert got[(7, rows[7][2])].count("\n") == 19999
    empty = df.filter("false")
    assert h.extract(empty, h.fit(empty)).count() == 0


def test_viterbi_and_gradient_equal_enumeration():
    rnd = np.random.default_rng(1)
    page = h.blocks("<body><nav><a>x</a></nav><h1>Title</h1><p>Some words, here.</p><p>More</p><footer>© z</footer>")
    w, t = rnd.normal(size=len(h.FEATURES)), rnd.normal(size=(2, 2))
    s = [w[f].sum() for f in h.features(page)]
    value = lambda y: sum(a * b for a, b in zip(s, y, strict=True)) + sum(t[a, b] for a, b in itertools.pairwise(y))
    best = max(itertools.product((0, 1), repeat=len(page)), key=value)
    assert h.Field(w, t).decode(page) == [bool(y) for y in best]
    labels = [0, 1, 1, 1, 0]
    before, after = (h.train([(page, labels)], rounds=n) for n in (0, 60))

    def likelihood(f):
        s = [f.weights[x].sum() for x in h.features(page)]
        value = lambda y: sum(a * b for a, b in zip(s, y, strict=True)) + sum(f.pairs[a, b] for a, b in itertools.pairwise(y))
        return value(labels) - np.logaddexp.reduce([value(y) for y in itertools.product((0, 1), repeat=len(page))])

    assert likelihood(after) > max(likelihood(before), -0.1)
