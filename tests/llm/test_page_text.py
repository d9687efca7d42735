import numpy as np
import pytest

from revspark.llm import page_text as P

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><p>no";</script></head><body>
<nav><ul><li><a href="/x">Home</a></li></ul></nav><!-- <p>hidden</p> --><div class="ad">Buy this</div>
<article><h1>Title &amp; more</h1><p><b>One   two&nbsp;three.<br><p>Fo<i>u</i>r &#233;t&eacute;</p><ul><li>li one<li>li two</ul></article>
<div class="comments"><p>First!</p></div><aside><p>Side</p></aside><form><label>Mail</label></form><footer>&copy; x</footer></body>"""


def test_blocks_of_broken_markup():
    got = P.blocks(PAGE)
    texts = [t for t, _, _ in got]
    assert texts == ["T", "Home", "Buy this", "Title & more", "One two three.", "Four été", "li one", "li two", "First!", "Side", "Mail", "© x"]
    assert [P.weak_label(p) for _, p, _ in got] == [0, 0, 0, 1, 1, 1, 1, 1, 0, 0, 0, 0]
    assert P.blocks("") == [] and [t for t, _, _ in P.blocks("plain < text")] == ["plain < text"]


def test_gradients_match_differences():
    rng = np.random.default_rng(0)
    m = P.BlockLabeller(5, hidden=3)
    for part in m.p.values():
        for k in part:
            part[k] = part[k].astype(np.float64)
    x, y = rng.normal(size=(4, 2, 5)), rng.integers(0, 2, (4, 2)).astype(float)
    mask = np.array([[1, 1], [1, 1], [1, 0], [1, 0]], dtype=bool)
    _, g = m.gradients(x, mask, y)
    for part, name in (("fw", "w"), ("fw", "u"), ("bw", "u"), ("bw", "b"), ("out", "w")):
        for at in list(np.ndindex(m.p[part][name].shape))[::7]:
            keep = m.p[part][name][at]
            m.p[part][name][at] = keep + 1e-5
            up, _ = m.gradients(x, mask, y)
            m.p[part][name][at] = keep - 1e-5
            down, _ = m.gradients(x, mask, y)
            m.p[part][name][at] = keep
            assert (up - down) / 2e-5 == pytest.approx(g[part][name][at], abs=1e-5)


@pytest.fixture(scope="module")
def pages(spark):
    return spark.read.parquet("/root/testdata/sf0.001/pages.parquet")


@pytest.fixture(scope="module")
def model(pages):
    return P.train(pages)


def test_articles_of_the_table(pages, model):
    for r in P.extract_text(pages, model, keep=["page_id"]).join(pages, pages.page_id == __import__("pyspark").sql.functions.col("row.page_id")).collect():
        own = r["html"][r["html"].find("<article>"):r["html"].find("</article>")]
        assert r["text"] == " ".join(t for t, _, _ in P.blocks(own))


def test_unseen_page_and_held_out_variants(pages, model):
    encode = P.Encoder()
    leaves = P.blocks(PAGE)
    assert " ".join(t for (t, _, _), k in zip(leaves, model.label([encode(leaves)])[0]) if k) == \
        "Title & more One two three. Four été li one li two"
    held = P.training_sequences([r["html"] for r in pages.limit(20).collect()], encode, variants=8, seed=77)
    wrong = sum((a != (y > 0)).sum() for a, (_, y) in zip(model.label([x for x, _ in held]), held))
    assert wrong / sum(len(y) for _, y in held) < 0.05


def test_awkward_pages(spark, model):
    rows = [(1, None), (2, ""), (None, PAGE), (3, "<article>" + "<p>a b</p>" * 5000 + "</article>"), (4, PAGE), (4, PAGE), (5, "<<<>>&&;")]
    df = spark.createDataFrame(rows, "page_id long, html string").selectExpr("*", "1 AS text", "2 AS row", "3 AS blocks")
    got = {}
    for r in P.extract_text(df, model).collect():
        got.setdefault(r["row"]["page_id"], []).append(r["text"])
    assert got[1] == [""] and got[2] == [""] and len(got[4]) == 2 and got[None] == got[4][:1]
    assert got[3] == [" ".join(["a b"] * 5000)]
    empty = df.limit(0)
    assert P.extract_text(empty, P.train(empty)).count() == 0


def test_training_pages_are_distinct_and_never_none(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(P, "training_sequences", lambda pages, encode: seen.append(pages) or [])
    rows = [(i, f"<p>page {i % 5}</p>") for i in range(500)] + [(1000, None), (1001, "")]
    df = spark.createDataFrame(rows, "page_id long, html string")
    for bound in (1, 4, 5, 50):
        P.train(df, bound=bound)
        assert len(seen[-1]) == len(set(seen[-1])) and 1 <= len(seen[-1]) <= bound
    assert len(seen[-1]) == 5


def read(model, page):
    leaves = P.blocks(page)
    return " ".join(t for (t, _, _), k in zip(leaves, P.label_pages(model, P.Encoder(model.known), [leaves])[0]) if k)


STORY = ["The flood of last spring left the lower town without power for nine days, and many have not come back.",
         "People who stayed say that the river had been rising for weeks, as nobody at the council would listen.",
         "A report is due in May. Until then the bridge stays closed, and the ferry runs twice a day.",
         "Repairs will cost about forty million, of which the county pays half."]


def test_names_that_only_hold_an_outer_word():
    assert P.name_tokens("sidebar") == ["n:sidebar"] and P.name_tokens("site-header") == ["n:site", "n:header"]
    assert P.name_tokens("social-science-article") == ["n:science", "n:article"] and P.name_tokens("no-sidebar") == ["n:no"]
    assert P.blocks('<html class="cookies"><body class="menu"><p>x') == [("x", ("t:html", "t:body", "t:p"), 0.0)]


@pytest.mark.parametrize("head,tail", [
    ('<body class="single no-sidebar"><article>', "</article>"),
    ('<html class="js cookies"><body class="header-fixed has-banner"><main>', "</main>"),
    ('<body><div class="social-science-article">', "</div>"),
    ('<body><div class="comment-section-free"><div class="storytext">', "</div></div>"),
    ("<body><div>", "</div>"),
    ('<body><table><tr><td class="xk3">', "</td></tr></table>")])
def test_articles_in_markup_not_trained_on(model, head, tail):
    story = "<h1>The flood</h1>" + "".join(f"<p>{p}</p>" for p in STORY)
    want = " ".join(["The flood", *STORY])
    assert read(model, f"{head}{story}{tail}") == want
    around = ('<div class="qz7"><a href="/a">Sport</a> <a href="/b">News</a> <a href="/c">Weather</a></div>',
              '<footer><p>All rights reserved</p></footer>')
    assert read(model, head.replace("<body", "<body data-x=1") + story + tail + around[1]) == want
    if "<div>" not in head:
        opened = head.split(">", head.count("<body") and head[:head.index("<body")].count(">") + 1)
        page = ">".join(opened[:-1]) + ">" + around[0] + opened[-1] + story + tail + around[1]
        assert read(model, page) == want, page[:120]


def test_long_pages_in_windows(model, monkeypatch):
    page = "<nav><a>Home</a></nav><article>" + "".join(f"<p>word{i} and more, of it.</p>" for i in range(500)) + "</article><footer>end</footer>"
    want = read(model, page)
    assert want.startswith("word0 ") and want.count("more") == 500
    monkeypatch.setattr(P, "LONG", 60)
    monkeypatch.setattr(P, "MARGIN", 20)
    assert read(model, page) == want


def test_time_in_proportion_to_the_page():
    import time
    for page in ("<a " * 300_000, "<b>" * 100_000 + "x", "<" * 500_000, "<!-- " * 200_000, '<a href="' * 100_000, "<p>x" * 100_000, "<a>x" * 50_000):
        began = time.process_time()
        P.blocks(page)
        assert time.process_time() - began < 10, page[:10]
