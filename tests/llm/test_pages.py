"""Main text of pages marked by hand: what stands between « and » is the article, block by block."""

import re
import time

import pytest

from sparkassay.llm import html

LONG = "The committee met on Tuesday to go over the accounts of the past year, and found that most of the money had gone into repairs of the two bridges."
MORE = "Nobody in the valley had expected the river to rise so fast; by noon the mill stood in water, and the road to the station was closed to all traffic."
BRIEF = "It rained again."

SITES = {
    "newspaper": f"""<!doctype html><html><head><title>Bridges</title></head><body class="page-home"><header class="site-header"><a href="/">The Valley Times</a><p>Established in 1902</p></header>
        <nav class="main-nav"><ul><li><a href="/n">News</a><li><a href="/s">Sport</a></ul></nav>
        <main><article class="story"><h1>«Bridges repaired»</h1><p class="lead">«{LONG}»</p><p>«{MORE}»</p>%s<p>«{BRIEF}»</p></article>
        <aside class="related"><h3>Related stories</h3><ul><li><a href="/1">Mill burns down</a><li><a href="/2">Road closed</a></ul></aside></main>
        <footer><p>Copyright 2020 The Valley Times. All rights reserved.</p></footer></body></html>""",
    "weblog": f"""<html><body><div id="wrapper"><div id="masthead"><h1><a href="/">My blog</a></h1></div><div class="post hentry"><h2 class="entry-title">«On rain»</h2>
        <div class="entry-content"><p>«{LONG}»<p>«{MORE}»%s<ul><li>«{BRIEF}»<li>«And then it stopped.»</ul></div></div>
        <div id="comments"><h3>2 comments</h3><ol class="commentlist"><li class="comment"><p>I liked this very much, thank you for writing about the rain in such detail.</p></li><li class="comment"><p>Me too.</p></li></ol></div>
        <div id="sidebar"><div class="widget"><h4>Archive</h4><ul><li><a href="/5">May</a></li></ul></div></div><div id="footer">Powered by things</div></div></body></html>""",
    "plain": f"""<h1>«Notes»</h1><p>«{LONG}»</p>%s<p>«{MORE}»</p><footer>Last changed in June</footer>""",
    "manual": f"""<html><body><nav class="toc"><ul><li><a href="#a">Setup</a><li><a href="#b">Use</a></ul></nav><main role="main"><article><h1>«Setup»</h1><p>«{LONG}»</p><pre>«make install»</pre>%s
        <table><tr><th>«Option»</th><th>«Meaning»</th></tr><tr><td>«-v»</td><td>«{BRIEF}»</td></tr></table><h2>«Use»</h2><p>«{MORE}»</p></article></main><footer class="footer"><a href="/i">Imprint</a></footer></body></html>""",
    "recipe": f"""<html><body><div class="cookie-notice"><p>We use cookies to make this site better for you.</p><button>Accept</button></div><header><a href="/">Kitchen</a></header>
        <article class="xyzzy"><header><h1>«Bread»</h1></header><p>«{LONG}»</p>%s<h2>«Ingredients»</h2><ul><li>«Flour and some salt»</li><li>«Water, as warm as a hand»</li></ul><figure><img src="b.jpg"><figcaption>«The loaf»</figcaption></figure><p>«{MORE}»</p></article>
        <section class="newsletter"><form action="/s"><label>Mail</label><input name="m"><p>Get one recipe every week</p></form></section><footer>Kitchen Ltd</footer></body></html>""",
    "forum": f"""<html><body><ul class="breadcrumb"><li><a href="/">Home</a></li><li><a href="/f">Forum</a></li></ul><div class="content"><h1>«Question about bridges»</h1><div class="kq"><p>«{LONG}»</p>%s<p>«{MORE}»</p></div></div>
        <section class="replies"><h2>Replies</h2><div class="reply"><p>You should ask the council, they know about these bridges more than anyone here.</p></div></section></body></html>""",
    "essay": f"""<html><body><article><h1>«An essay»</h1><section><h2>«One»</h2><p>«{LONG}»</p></section><section><h2>«Two»</h2>%s<blockquote><p>«{MORE}»</p></blockquote><p>«{BRIEF}»</p></section></article></body></html>""",
}

INSERTS = {
    "nothing": "",
    "scripts": "<script>var a = '</p>';</script><script>track(1)</script>" * 3,
    "styles": "<style>p{margin:0}</style><noscript><img src=x>Turn scripts on</noscript>",
    "frames": "<iframe src='v'>no frames</iframe><svg><title>Mark</title><text>5</text></svg>",
    "controls": "<button>Share</button><select><option>Red<option>Blue</select><label>Size</label><textarea>type here</textarea>",
    "advert": '<div class="advertisement"><p>Buy our new boots now, they are light and they last.</p></div>',
    "hidden": '<p hidden>Not for you to see, this line here.</p><div style="display: none"><p>Nor is this.</p></div>',
    "details": "<details><summary>«How it was measured»</summary><p>«With a long rope and a good deal of patience.»</p></details>",
    "inline": f'<p>«It was <b>very</b> wet &amp; <span hidden>gone</span>cold<span class="sponsored">Buy boots</span> <em class="q">then</em>»</p>',
}


def _marked(page: str) -> tuple[str, str]:
    """The page without marks, and its article's text."""
    kept = [" ".join(re.sub(r"<(span (?:hidden|class=\"sponsored\")).*?</span>|<[^>]*>", "", t).replace("&amp;", "&").split()) for t in re.findall("«(.*?)»", page, re.S)]
    return re.sub("[«»]", "", page), "\n".join(kept)


@pytest.mark.parametrize("insert", INSERTS)
@pytest.mark.parametrize("site", SITES)
def test_marked_pages(site, insert):
    source, want = _marked(SITES[site] % INSERTS[insert])
    assert html.fitted().text(source) == want


@pytest.mark.parametrize("tag", ["<div>", "<p>", "<span hidden>", "<b class=ad>", "<li>", "<td>", "<ul><li>", "<p><button>"])
def test_depth_costs_no_more_than_length(tag):
    def took(n):
        began = time.process_time()
        html.Page(tag * n + "x" + "</div></b></td></i>" * n)
        return time.process_time() - began

    took(100)
    assert took(100_000) < 40 * took(10_000) + 1


def test_rows_of_pages(spark):
    page, want = _marked(SITES["essay"] % "")
    long = "<article>" + "<p>" + "A long line of words. " * 20 + "</p>" * 1
    rows = [(1, "u", page, "a"), (1, "u", page, "a"), (None, None, page, "b"), (2, "v", long + "<p>One more of them all here.</p>" * 20_000, "c"), (3, "w", None, "d")]
    got = html.main_text(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert sorted((r["page_id"] or 0, r["text"] if r["page_id"] != 2 else "") for r in got) == sorted([(1, want), (1, want), (0, want), (2, ""), (3, "")])
    (two,) = [r for r in got if r["page_id"] == 2]
    assert two["text"].count("\n") == 20_000 and two["n_chars"] == len(two["text"])
