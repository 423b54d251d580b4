import html
import random
import re
import time

import numpy as np
import pytest
from brindle.llm import html_text as h


def article(page):
    inner = re.search(r"(?s)<article>(.*?)(?:</article>|\Z)", page)[1]
    blocks = (" ".join(html.unescape(re.sub(r"<[^>]+>", "", b)).split()) for b in re.split(r"</?(?:p|h1|br)>", inner))
    return "\n".join(b for b in blocks if b)


def test_pages_give_their_articles(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    got = h.extract_main_text(pages).collect()
    want = {r.page_id: article(r.html) for r in pages.collect()}
    assert {r.page_id: r.text for r in got} == want and all(r.n_chars == len(r.text) for r in got)


def test_held_out_layouts():
    r, same = random.Random(99), 0
    for _ in range(60):
        page = h.training_page(r)
        nodes = h.parse(page)
        want = h.text_of(nodes, np.array([True, *h._marked(page)]))
        same += h.main_text(page.replace(' data-main="1"', ""), h.trained()) == want
    assert same >= 54


def test_decoding_keeps_no_node_below_a_dropped_one():
    rng = np.random.default_rng(0)
    nodes = h.parse("<div><p>a<b>b</b></p><ul><li>c<li>d<a>e</a></ul></div><p>f" * 3)
    for _ in range(50):
        keep = h.kept_nodes(nodes, rng.normal(size=len(nodes)))
        assert all(keep[x.parent] for i, x in enumerate(nodes) if i and keep[i])


def test_edges(spark):
    rows = [(1, None, None), (2, "u", ""), (None, "u", "<article><p>one &amp; two</article>"), (2, "u", "no tags at all"), (3, "u", "<p" * 500), (4, "u", "<div>" * 3000 + "deep"), (5, "u", "<script>x<p>y</script><!-- <p>z -->")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = sorted((str(r.page_id), r.text) for r in h.extract_main_text(df).collect())
    assert len(got) == 7 and ("None", "one & two") in got and ("2", "") in got and ("2", "no tags at all") in got and ("5", "") in got
    assert h.extract_main_text(df.limit(0)).collect() == []


@pytest.mark.parametrize(
    "page",
    ["<a " * 300_000, "<a " * 300_000 + '">', "<!x " * 250_000, "<b>" * 150_000 + "<i></u>" * 80_000, "<p><div>" + "<b>" * 100_000 + "<h1></h1>" * 60_000, "<a " + "x" * 1_000_000 + ">", "<li>" * 200_000, "<a x='\"" * 150_000],
    ids=["open tags", "unclosed quote", "declarations", "end tags of nothing", "headings in inline", "long attribute", "items", "mixed quotes"],
)
def test_a_broken_megabyte_takes_seconds(page):
    began = time.perf_counter()
    h.main_text(page, h.trained())
    assert time.perf_counter() - began < 15


def test_an_article_inside_a_form_stays():
    body = "<nav><ul><li><a href='/'>Home</a></li><li><a href='/x'>More</a></li></ul></nav><article><h1>Title of it</h1>" + "<p>Some prose that goes on for a while, and then some more of it.</p>" * 6 + "</article><footer>&copy; us</footer>"
    plain, wrapped = (h.main_text(f"<html><head><title>t</title></head><body>{x}</body></html>", h.trained()) for x in (body, f"<form method=post action='/'>{body}</form>"))
    assert plain == wrapped and plain.startswith("Title of it\nSome prose") and plain.count("\n") == 6
    small = "<form class='search'><label>Search this</label><input name=q><button>Go</button></form>"
    assert h.main_text(f"<html><body>{small}{body}</body></html>", h.trained()) == plain
