from __future__ import annotations

import html
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from regatta.llm import html_blocks

TEXT = ("<h1>Fog at sea</h1><p>Ships waited outside the harbour until the afternoon, when the wind came up.</p>"
        "<p>Nobody was hurt.</p>")
PLAIN = "Fog at sea Ships waited outside the harbour until the afternoon, when the wind came up. Nobody was hurt."

# Pages that the tree has not seen, marked as the labelled table is.
HELD_OUT = [
 ("<div><a href='/'>Home</a> <a href='/s'>Shop</a></div><h1>Wool</h1><p>Shearing began on Monday in all the villages along the river.</p><p>It took a week.</p><div><a href='/m'>More from the river</a></div>","-+++-"),
 ("<nav><a href='/'>Start</a></nav><main><h1>Iron</h1><p>The forge was cold for the first time since the war, and the smith sat on the step.</p><p>He would not say why.</p></main><footer>All rights reserved by the smithy</footer>","-+++-"),
 ("<article><h2>Corn</h2><p>Rats had come in the night.</p><p>By morning a third of the store was gone, and what was left had to be thrown away too.</p><p>See <a href='r'>the report</a> of the county.</p></article><aside><p>Ask our farmers what they think about it</p></aside>","++++-"),
 ("<div class='ad'>Buy new boots now and pay for them in spring</div><div id='content'><p>The path was steep and nobody had walked it since the snow came down.</p><p>We met a fox.</p></div><div class='comments'><p>Lovely walk, I did it twice last year with my brother.</p></div>","-++-"),
 ("<article><h1>Tin</h1><p>Tin is soft, white and easy to melt, which is why the first smiths mixed it with copper.</p></article><a href='1'><div><h3>Copper</h3><p>of mines and men</p></div></a><a href='2'><div><h3>Lead</h3><p>the heavy sister</p></div></a>","++----"),
 ("<ul><li><a href='a'>News</a></li><li><a href='b'>Sport today</a></li></ul><p>The match was called off after an hour because of fog on the field.</p><p>A new date will be named next week by the two clubs and the league.</p><p><a href='c'>Other matches of the day</a></p>","--++-"),
 ("<section><h2>Ink</h2><p>Boil the bark for a day and a night.</p><p>Then strain it, add the iron salt, and let the jar stand where no light can reach it.</p></section><section><p><a href='1'>Paper</a></p><p><a href='2'>Pens for beginners</a></p></section>","+++--"),
 ("<body class='home no-sidebar'><div class='header'><p>The Old Mill Gazette</p></div><article class='post'><h1>Bells</h1><p>They rang at noon.</p></article><div class='related'><article><a href='1'>Clocks of the north</a></article><article><a href='2'>Towers</a></article></div>","-++--"),
]


@pytest.fixture(scope="module")
def tree():
    return html_blocks.fit_tree(*html_blocks.labelled_blocks())


def splits(tree):
    return [] if not isinstance(tree, tuple) else [html_blocks.FEATURES[tree[0]], *splits(tree[2]), *splits(tree[3])]


def test_link_density_decides_first(tree):
    assert splits(tree)[0] == "links" and {"words", "words_before", "words_after"} <= set(splits(tree))


def test_held_out_pages(tree):
    right = total = 0
    for page, signs in HELD_OUT:
        blocks = html_blocks.blocks_of(page)
        assert len(blocks) == len(signs)
        kept = html_blocks.is_article(tree, html_blocks.block_features(blocks))
        right += int((kept == np.array([s == "+" for s in signs])).sum())
        total += len(signs)
    assert total >= 40 and right / total >= 0.95


@pytest.mark.parametrize("page", [
    f"<body class='single-post no-sidebar'><article>{TEXT}</article>",
    f"<html class='js no-search'><body><article>{TEXT}</article></body></html>",
    f"<article class='post related-post'>{TEXT}</article>",
    f"<div class='page search'><article>{TEXT}</article></div>",
    f"<button>Menu<article>{TEXT}</article>",
    f"<svg><path><article>{TEXT}</article>",
    f"<select><option>One<article>{TEXT}</article>",
    f"<div><button>Menu</div><article>{TEXT}</article>",
    f"<div><template><div>a<template><p>in</p></template>b</div></template></div><article>{TEXT}</article>",
    f"<article><h1 title='it's'>Fog at sea</h1>{TEXT[19:]}</article>",
    f"<article>{TEXT}</article><a href='x'><div><h3>Another story</h3><p>of boats and people</p></div></a>",
    f"<article>{TEXT}</article><div class='comments'><article class='comment'><p>I was there on that day and "
    "saw the ships myself from the old pier.</p></article></div>",
    f"<nav><a href='/'>Home</a></nav><div class='content'>{TEXT}</div><footer>Imprint</footer>",
])
def test_articles_of_common_forms_stay_and_nothing_else(tree, page):
    assert html_blocks.main_text(page, tree) == PLAIN


def test_a_link_around_blocks_links_their_words():
    blocks = html_blocks.blocks_of("<a href='x'><div><h3>One</h3><p>two three</p></div></a><p>four <a>five</a></p>")
    assert [b.links for b in blocks] == [1.0, 1.0, 0.5]
    assert [b.links for b in html_blocks.blocks_of("<p><a href='x'>one</p><p>two</p>")] == [1.0, 0.0]


def test_tables_of_pages(spark, tree):
    long_page = "<article>" + "<p>word and another word</p>" * 20_000 + "</article>"
    rows = [(1, None), (2, ""), (None, f"<article>{TEXT}</article>"), (3, f"<article>{TEXT}</article>"),
            (3, f"<article>{TEXT}</article>"), (4, long_page)]
    pages = spark.createDataFrame(rows, "page_id long, html string").withColumns({"text": F.lit("x"), "words": F.lit(1)})
    got = [(r["page_id"], r["main"]) for r in html_blocks.extract(pages, to="main").collect()]
    want = [(1, ""), (2, ""), (None, PLAIN), (3, PLAIN), (3, PLAIN), (4, " ".join(["word and another word"] * 20_000))]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert html_blocks.extract(pages.limit(0), to="main").count() == 0


def test_given_pages_keep_their_articles(spark, sf_dir, tree):
    for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect():
        article = re.search("<article>(.*)</article>", r["html"], re.S)[1]
        plain = html.unescape(re.sub("<b>", "", re.sub("<(?:/?p|br|/?h1)>", " ", article)))
        assert html_blocks.main_text(r["html"], tree).split() == plain.split()
