"""The site style tree: what it removes alone, against hand-labelled pages and an independent reading; odd and huge pages."""

import html
import re
import time

import pytest

from tidemark.llm import htmltext

# Hand-labelled pages of one host: (article, its text). The boxes around it differ from page to page; no name or element tells them.
ARTICLES = [
    (
        "<h1>Rain</h1><p>It rained for days, and the river rose above the old stone bridge.</p><p>Nobody crossed until the water fell and the mill could be reached again.</p>",
        "Rain It rained for days, and the river rose above the old stone bridge. Nobody crossed until the water fell and the mill could be reached again.",
    ),
    (
        "<h1>Bread</h1><p>Flour, water &amp; salt make a dough that rises overnight in a cool room.</p><ul><li>Rest it</li><li>Bake it</li></ul><p>Let it cool for an hour before you cut it into slices.</p>",
        "Bread Flour, water & salt make a dough that rises overnight in a cool room. Rest it Bake it Let it cool for an hour before you cut it into slices.",
    ),
    (
        "<h1>Owls</h1><p>Owls hear a mouse under snow.</p><blockquote>They fly without a sound,</blockquote><p>as their feathers break the air.</p><p>So few see them, though they live near most villages of the valley.</p>",
        "Owls Owls hear a mouse under snow. They fly without a sound, as their feathers break the air. So few see them, though they live near most villages of the valley.",
    ),
    (
        "<h2>Clocks</h2><p>A clock of this kind loses a second a day, more in winter than in summer, as its oil grows thick.</p><table><tr><td>Monday</td><td>one</td></tr><tr><td>Tuesday</td><td>two</td></tr></table>",
        "Clocks A clock of this kind loses a second a day, more in winter than in summer, as its oil grows thick. Monday one Tuesday two",
    ),
    (
        "<h1>Maps</h1><p>Old maps show <b>islands</b> that were never there, and coasts that have since moved far inland, so sailors trusted them little.</p>",
        "Maps Old maps show islands that were never there, and coasts that have since moved far inland, so sailors trusted them little.",
    ),
]
BOXES = ["alpha beta", "gamma", "delta eps", "zeta", "eta theta"]


def page(i, body):
    return f"<html><body><div class='q'><ul><li><a href='/'>{BOXES[i]}</a></li></ul></div><div class='r'>Buy {BOXES[-i - 1]}</div><div class='s'>{body}</div><div class='t'>2026-01-0{i + 1}</div></body></html>"


def frame(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' as host", "1 as node", "2 as n", "3 as part", "4 as total")


def texts(df, **options):
    return {r.page_id: r.text for r in htmltext.main_text(df, **options).collect()}


@pytest.mark.parametrize("shared", [htmltext.SHARED, 0])
def test_tree_alone_on_labelled_pages(spark, shared):
    rows = [(i, "http://a.org/x", page(i, body)) for i, (body, _) in enumerate(ARTICLES)]
    want = {i: text for i, (_, text) in enumerate(ARTICLES)}
    assert texts(frame(spark, rows), names=False, shared=shared) == want
    assert texts(frame(spark, rows), shared=shared) == want
    # without other pages of the host there is nothing to learn from
    assert texts(frame(spark, rows[:1]), names=False, shared=shared)[0] != want[0]


def truth(text):
    """The only article of a test page, by patterns."""
    body = re.search(r"<article>(.*?)</article>", text, re.S)[1]
    body = re.sub(r"</?b>", "", re.sub(r"<!--.*?-->", "", body, flags=re.S))
    return " ".join(html.unescape(re.sub(r"<[a-z/][^>]*>", " ", body)).split())


def test_tree_alone_on_the_test_pages(spark, small):
    pages = spark.read.parquet(small.replace("sf0.001", "sf0.01") + "/pages.parquet")
    raw = {r.page_id: r.html for r in pages.collect()}
    alone, full = texts(pages, names=False), texts(pages)
    assert full == {i: truth(x) for i, x in raw.items()}
    # hosts of one or two pages have no tree
    assert sum(alone[i] != htmltext.extract(x, names=False) for i, x in raw.items()) > 0.8 * len(raw)
    assert sum(alone[i] == truth(x) for i, x in raw.items()) > 0.8 * len(raw)


def test_hot_host_in_parts(spark, monkeypatch):
    monkeypatch.setattr(htmltext, "PART_PAGES", 7)
    rows = [(i, "http://a.org/x", page(i % 5, ARTICLES[i % 5][0])) for i in range(60)] + [(100 + i, "http://b.org/", page(i, ARTICLES[i][0])) for i in range(5)] + [(200, None, None), (201, "http://[", "<p>z")]
    got = texts(frame(spark, rows), shared=0)
    assert got.pop(200) == "" and got.pop(201) == "z"
    assert got == {i: ARTICLES[i % 100 % 5][1] for i in got}


HUGE = {
    "nested": ("<div>" * 5000 + "x" + "</div>" * 5000, "x"),
    "never closed": ("<div>" * 100_000 + "x", "x"),
    "strange ends": ("<div>" * 50_000 + "</x>" * 50_000 + "y", "y"),
    "unclosed tags": ("<a " * 350_000, None),
    "unclosed blocks": ("a<div " * 200_000, None),
    "odd quotes": ("<a \"" * 250_000 + ">z", None),
    "odd quotes closed": ("<a '>\"" * 160_000 + ">z", None),
    "signs": ("<" * 500_000 + ">", None),
    "comments": ("b<!--" * 200_000, "b"),
    "scripts": ("c<script>" * 100_000, "c"),
    "mains in a form": ("<form>" * 2000 + "<main>a</main>" * 20_000, "a " * 19_999 + "a"),
    "paragraphs": ("<p>q" * 200_000, "q " * 199_999 + "q"),
}


@pytest.mark.parametrize("name", HUGE)
def test_huge_pages_take_linear_time(name):
    text, want = HUGE[name]
    began = time.perf_counter()
    got = htmltext.extract(text, {1: htmltext.Judgement({}, True, True, False, 9)})
    assert time.perf_counter() - began < 30
    assert want is None or got == want


def test_attributes_are_read_as_such():
    assert htmltext.extract('<div title="hidden class=ad">a</div><div data-role="ad">b</div><div CLASS=ad>c</div><div hidden>d</div><p>e') == "a b e"


def test_odd_rows(spark):
    df = frame(spark, [(None, "http://a.org", "<p>x"), (1, "http://a.org", "<p>x"), (1, "http://a.org", "<p>x"), (2, "", ""), (3, "http://a.org", "<p>" + "w " * 300_000)])
    got = sorted((str(r.page_id), r.url, r.n_chars) for r in htmltext.main_text(df).collect())
    assert got == [("1", "http://a.org", 1), ("1", "http://a.org", 1), ("2", "", 0), ("3", "http://a.org", 599_999), ("None", "http://a.org", 1)]
    assert htmltext.main_text(df.filter("false")).count() == htmltext.main_text(df.filter("false"), shared=0).count() == 0
