import random
import re
import time
from html import unescape

import numpy as np
import pytest

from fieldwarden.llm import html as H
from fieldwarden.llm import queries

LONG = "Several sentences of plain prose follow, one after another. They say little, but they are long enough. "
PAGE = f"""<!DOCTYPE html><html lang=en><head><meta charset=utf-8><title>Not text</title><style>p{{}}</style>
<script>if (1 < 2) document.write("<p>no</p>")</script></head><body class="home">
<header class="site-header"><div class=logo>The Site</div><nav><ul><li><a href=/a>Home</a></li><li><a href=/b>News</a></li></ul></nav></header>
<div id="cookie-banner"><p>We use cookies to improve things. {LONG}</p><button>Accept</button></div>
<main><article><h1>A &quot;fine&quot; title</h1>
<p>First   paragraph with <a href=/x>a link</a> &amp; <b>bold</b> text.
{LONG}<p>Second, unclosed paragraph. {LONG}<div class="advertisement"><p>Buy this now. {LONG}</p></div>
<ul><li>one item<li>another item</ul><blockquote>A quotation. {LONG}</blockquote><p>Caf&eacute; &#8212; end.</p></article></main>
<section id=comments><h2>Comments</h2><div class=comment><p>I disagree. {LONG}</p></div><div class=comment><p>I agree. {LONG}</p></div></section>
<aside class=sidebar><h3>Related</h3><ul><li><a href=/1>Other story</a></li></ul><p>{LONG}</p></aside>
<form action=/s><label>Search</label><input name=q></form><footer><p>&copy; 2020 Example. All rights reserved.</p></footer></body></html>"""
TEXT = [
    'A "fine" title', f"First paragraph with a link & bold text. {LONG.strip()}", f"Second, unclosed paragraph. {LONG.strip()}",
    "one item", "another item", f"A quotation. {LONG.strip()}", "Café — end.",
]


@pytest.fixture(scope="module")
def trees():
    return H.train()


def test_page_with_every_part(trees):
    assert H.texts([PAGE], trees)[0].split("\n") == TEXT


@pytest.mark.parametrize(
    ("page", "text"),
    [(None, ""), ("", ""), ("plain words\n only", "plain words only"), ("<p", ""), ("<article><h1>T</h1><p>x", "T\nx"), ("<body><article><p>a &am", "a &am"), ("<!-- all hidden", ""), ("<script>var a = '<p>x</p>'", "")],
)
def test_small_pages(trees, page, text):
    assert H.texts([page], trees) == [text]


PARAGRAPHS = "".join(f"<p>Paragraph {k}. {LONG}</p>" for k in range(4))


@pytest.mark.parametrize(
    ("inside", "lines"),
    [
        ("<p title=it's>One's text. </p><p>It's two.</p>", ["One's text.", "It's two."]),
        ('<p data-x="a>b" class=\'c>d\'>Some text.</p>', ["Some text."]),
        ("<p a='\"' b=\"'\" c=x\"y'z>Quotes.</p>", ["Quotes."]),
        ("<p>If <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>x=2</annotation></math> holds.</p>", ["If x=2 holds."]),
        ("Above the rule<hr>below it", ["Above the rule", "below it"]),
        ("<p>One<hr>two</p>", ["One", "two"]),
        ("<p>Hello <x-tip>brave</x-tip> <blink>new</blink> world</p>", ["Hello brave new world"]),
        ("<p>It took <output>5</output> of <meter value=1>nine</meter> <progress>steps</progress> <picture><source><img></picture> in all</p>", ["It took 5 of nine steps in all"]),
        ("<x-part> <p>Inside one.</p></x-part><x-part><p>Inside <x-tip>two</x-tip>.</p></x-part>", ["Inside one.", "Inside two."]),
        ("<p =a b==c / d>Odd attributes.</p/>", ["Odd attributes."]),
        ("<p><!--> not hidden --><!-- hidden --!>shown</p>", ["not hidden -->shown"]),
    ],
)
def test_tags_as_the_tokenizer_reads_them(trees, inside, lines):
    page = f"<html><body><nav><ul><li><a href=/a>Home</a></li></ul></nav><article>{PARAGRAPHS}{inside}{PARAGRAPHS}</article><footer>&copy; x</footer></body></html>"
    around = [f"Paragraph {k}. {LONG.strip()}" for k in range(4)]
    assert H.texts([page], trees)[0].split("\n") == [*around, *lines, *around]


def test_a_quote_that_nothing_closes(trees):
    page = f'<article><p>First. {LONG}</p><p class="a>Second. {LONG}</p><p>Third.</p></article>'
    assert H.texts([page], trees)[0].split("\n") == [f"First. {LONG.strip()}", f"Second. {LONG.strip()}", "Third."]


def test_a_very_long_page(trees):
    page = "<html><body><nav><a href=/>x</a></nav><article>" + f"<p>{LONG}</p>" * 20_000 + "</article></body></html>"
    assert H.texts([page], trees)[0] == "\n".join([LONG.strip()] * 20_000)


def test_text_does_not_depend_on_the_batch(trees):
    rng = random.Random(3)
    pages = [H.lesson(rng) for _ in range(30)] + [None, PAGE]
    assert H.texts(pages, trees) == [H.texts([p], trees)[0] for p in pages]


def test_new_lessons(trees):
    rng = random.Random(77)
    right = 0
    for _ in range(150):
        page = H.lesson(rng)
        root = H.read(page)
        found = H.blocks(root)[0]
        own = np.array([any(type(x) is str and H.ARTICLE in x for x in b.items) for b in found])
        right += H.texts([page], trees)[0] == "\n".join(H.lines(found, own))
    assert right >= 140, right


def test_decoding_is_the_best_consistent_choice():
    rng = np.random.default_rng(2)
    for _ in range(60):
        n = int(rng.integers(2, 9))
        parent = [-1] + [int(rng.integers(0, k)) for k in range(1, n)]
        depth = [0]
        for k in range(1, n):
            depth.append(depth[parent[k]] + 1)
        score = rng.normal(0, 2, n)
        score[0] = 0.0
        t = H.Table([None] * n, np.array(parent), np.array(depth), np.empty(0), np.array([0]))
        kept = H.decode(t, score)
        best = max(
            (sum(score[k] for k in range(1, n) if bits >> k & 1) for bits in range(1 << n) if all(not bits >> k & 1 or parent[k] == 0 or bits >> parent[k] & 1 for k in range(1, n))),
        )
        assert abs(sum(score[k] for k in range(1, n) if kept[k]) - best) < 1e-9
        assert all(not kept[k] or parent[k] == 0 or kept[parent[k]] for k in range(1, n))


def test_given_pages(spark):
    """These pages hold their text in one article element, whose lines plain patterns can read."""
    sf = "/root/testdata/sf0.01"
    got = {r.page_id: r for r in queries.op1_html_text(spark, sf).collect()}
    pages = spark.read.parquet(f"{sf}/pages.parquet").collect()
    assert len(got) == len(pages)
    for page in pages:
        inside = re.search(r"<article>(.*?)</article>", page.html, re.DOTALL)[1]
        want = [" ".join(unescape(re.sub(r"<[^>]*>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)>", inside)]
        assert got[page.page_id].text == "\n".join(x for x in want if x)
        assert got[page.page_id].n_chars == len(got[page.page_id].text) and got[page.page_id].url == page.url


def test_rows(spark, trees):
    pages = spark.createDataFrame([(1, "u", PAGE, "x"), (1, "u", PAGE, "x"), (2, None, None, "y")], "page_id long, url string, html string, text string")
    rows = H.extract(pages, trees).collect()
    assert sorted((r.page_id, r.n_chars) for r in rows) == [(1, len("\n".join(TEXT)))] * 2 + [(2, 0)]
    assert H.extract(pages.limit(0), trees).count() == 0


def test_deep_nesting_takes_no_longer_a_block(trees):
    deep = lambda n: "<html><body>" + "<div>" * n + "<p>Hello there, this is the one sentence of it.</p>" + "</div>" * n + "</body></html>"
    began = time.process_time()
    assert H.tabulate([deep(3), deep(50_000)]).parent.size == 4 + 50_002 + 1
    assert time.process_time() - began < 30
    assert H.texts([deep(3), "<p>x</p>", deep(40)], trees) == [H.texts([deep(k)], trees)[0] if k else H.texts(["<p>x</p>"], trees)[0] for k in (3, 0, 40)]
