import itertools

import numpy as np

from landloom.llm import html_crf as H


def test_blocks_decode_and_nest():
    page = """<!DOCTYPE html><html><head><title>T &amp; U</title><style>p{}</style></head><body><!-- <p>no</p> --><nav><a href="/x>y">menu</a></nav>
    <article><h1>Head&nbsp;line</h1><p>One<br>two &lt;3&#x21;<p>three <b>bold</b><script>var t="</p>";</script> end<div class=ad>buy</div></article>tail<textarea>no</textarea>"""
    got = [b.text for b in H.blocks(page)]
    assert got == ["T & U", "menu", "Head line", "One two <3!", "three bold end", "buy", "tail"]
    assert H.blocks("") == [] and [b.text for b in H.blocks("plain < text > & <")] == ["plain < text > & <"]
    assert [b.text for b in H.blocks("<p>a</div></p>b<script>never closed")] == ["a", "b"]


def test_viterbi_is_the_best_of_all_paths():
    rng = np.random.default_rng(0)
    f = H.Field(rng.normal(size=(len(H.FEATURES), 2)), rng.normal(size=(2, 2)))
    feats = [sorted(rng.choice(len(H.FEATURES), 5, replace=False).tolist()) for _ in range(8)]
    score = lambda ls: sum(f.emit[x, y].sum() for x, y in zip(feats, ls, strict=True)) + sum(f.move[a, b] for a, b in itertools.pairwise(ls))
    assert f.decode(feats) == list(max(itertools.product((0, 1), repeat=8), key=score))


def test_held_out_layouts():
    f = H.fit(H.layouts())
    pages = H.layouts(seed=9, copies=3)
    wrong = sum(k != b.label for p in pages for b, k in zip(p, f.decode([b.features for b in p]), strict=True))
    assert wrong / sum(map(len, pages)) < 0.02


def test_extract(spark):
    body = "<article><h1>A title</h1><p>The first paragraph of the article is long enough to be text.</p><div class='comments'><p>I am a reader and I say so.</p></div><p>The second paragraph is here, too, and says more.</p></article>"
    html = f"<html><body><nav><ul><li><a href='/'>Home</a></li></ul></nav><div class='cookie-notice'>We use cookies.</div>{body}<form><p>Sign up for news</p></form><footer>&copy; us</footer></body></html>"
    rows = [(1, "u", html, "x"), (2, None, None, "x"), (3, "v", "", "x"), (4, "w", "<p>" * 3000 + "x", "x"), (1, "u", html, "x"), (None, "z", html * 30, "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = H.extract(pages, H.train(pages)).collect()
    want = "A title\nThe first paragraph of the article is long enough to be text.\nThe second paragraph is here, too, and says more."
    assert len(got) == 6 and all(r.text == want for r in got if r.page_id == 1) and all(r.n_chars == len(r.text) for r in got)
    assert {r.text for r in got if r.page_id in (2, 3)} == {""}
    assert H.extract(pages.where("page_id < 0"), H.fit([])).count() == 0


def test_empty_svg_and_long_attributes():
    page = "<p>one</p><svg class='i' d=\"a/b>c\" /><math/><p>two</p><svg><p>drawn</p></svg><p>three</p>"
    assert [b.text for b in H.blocks(page)] == ["one", "two", "three"]
    long = f'<div data-x="{"y>" * 4000}" class="advert">buy</div><p>text</p>'
    buy, text = H.blocks(long)
    assert (buy.text, text.text) == ("buy", "text") and H.FEATURES["name:ad"] in buy.features
    assert H.FEATURES["name:ad"] in H.blocks('<div class="advert" title="open>buy')[0].features


def test_references_end_at_tags():
    assert [b.text for b in H.blocks("<p>AT&amp;T &am<b>p;</b> x</p>")] == ["AT&T &amp; x"]
    assert [b.text for b in H.blocks("<p>a &l<i>t;</i> b</p>")] == ["a &lt; b"]


# Pages in markup that the given layouts don't share, main blocks marked by hand with data-main.
WIKI = """<html><head><title>Harbour - Encyclopaedia</title></head><body class="skin-9"><div id="mw-page-base"></div><div id="mw-head"><ul><li><a href="/r">Read</a></li><li><a href="/e">Edit</a></li></ul></div>
<div id="content" class="mw-body"><h1 class="firstHeading" data-main>Harbour</h1><div class="mw-parser-output"><p data-main>A harbour is a sheltered body of water where ships, boats and barges can be moored.</p>
<div class="mw-toc-box"><ul><li><a href="#a">1 Artificial</a></li><li><a href="#b">2 Natural</a></li></ul></div><h2 data-main>Artificial harbours</h2><p data-main>Artificial harbours are frequently built for use as ports, and the oldest of them known is on the coast of the Red Sea.</p>
<ul data-main><li>It was built of stone, more than four thousand years ago.</li><li>Its jetty is still there at low tide.</li></ul><p data-main>Large ones need breakwaters, and are dredged every year to keep their depth.</p></div></div>
<div id="mw-panel"><h3>Tools</h3><ul><li><a href="/w">What links here</a></li><li><a href="/p">Printable version</a></li></ul></div><div id="catlinks"><a href="/c">Ports</a> | <a href="/c2">Coasts</a></div><footer><ul><li>This page was last edited in May.</li><li><a href="/about">About</a></li></ul></footer></body></html>"""
NEWS = """<html><head><title>Ferry returns | Daily</title></head><body><div class="l-top"><a href="/">Daily</a> <a href="/s">Sport</a> <a href="/w">Weather</a></div><div class="gdpr-layer"><p>We and our partners use cookies to make this site work.</p><button>OK</button></div>
<div class="l-wrap"><div class="c-story"><h1 data-main>Ferry returns after two years</h1><div class="c-story__by">By <a href="/j">J. Meyer</a></div><div class="c-story__text"><p data-main>The ferry between the two islands sailed again on Monday, after two years in dock.</p><p data-main>About two hundred people stood on the quay to see it leave, some of them since five in the morning.</p>
<div class="ad-slot-3">Advertisement</div><p data-main>"We have waited long enough," said the mayor.</p><blockquote data-main>The boat is older than most of those who sail on it, and nobody wants another.</blockquote><p data-main>The next repair is due in six years.</p></div></div>
<div class="l-rail"><h4>Most read</h4><ol><li><a href="/1">Bridge closed for the night</a></li><li><a href="/2">Rain until Friday, then sun</a></li></ol></div></div><div id="talkback" class="user-comments"><p>Great news, I have missed it so much all this time.</p><p>It was never on time anyway, was it?</p></div><div class="l-end">© Daily. All rights reserved.</div></body></html>"""
BLOG = """<!doctype html><html><body><header class="site-top"><h2><a href="/">Notes</a></h2></header><div class="wp-wrap"><div class="hentry"><h2 data-main>On planting trees in autumn</h2><p data-main>Autumn is the best time to plant a tree, as the soil is still warm and rain is near.</p><p data-main>Dig a hole twice as wide as the roots, and no deeper than they are long.</p><pre data-main>width = 2 * roots</pre><p data-main>Water it well. Then wait.</p>
<div class="sharedaddy share-row"><a href="#">Tweet</a><a href="#">Mail</a></div></div><div class="sidebar-box"><h3>Archives</h3><ul><li><a href="/5">May</a></li><li><a href="/6">June</a></li></ul></div><form class="search-form"><label>Search</label><input></form></div><div class="respond-area comments-area"><h3>2 replies</h3><div><p>Thank you, I will try that next week with an oak.</p></div></div><div class="site-info">Proudly made by hand</div></body></html>"""
SHOP = """<html><body><table class="hd"><tr><td><a href="/">Home</a></td><td><a href="/cart">Cart</a></td></tr></table><main><section class="pdp-copy"><h1 data-main>Oak table, round</h1><p data-main>This table is made of oak from the hills behind our workshop, and is oiled twice by hand.</p><h3 data-main>Care</h3><p data-main>Wipe it with a damp cloth. Oil it once a year, best in spring.</p><table data-main><tr><th>Height</th><td>75 cm</td></tr><tr><th>Width</th><td>110 cm</td></tr></table></section><aside class="promo">Buy two chairs, get the third for half the price this week.</aside></main><div class="newsletter-strip"><form><p>Sign up for our newsletter and be the first to know.</p><button>Go</button></form></div><footer>Imprint · Terms of use</footer></body></html>"""


def test_pages_of_other_makers():
    """Precision and recall per block on layouts and class names that the generator doesn't share."""
    f = H.fit(H.layouts())
    hits = kept = main = 0
    for page in (WIKI, NEWS, BLOG, SHOP):
        found = H.blocks(page)
        labels = f.decode([b.features for b in found])
        hits += sum(k and b.label for b, k in zip(found, labels, strict=True))
        kept, main = kept + sum(labels), main + sum(b.label for b in found)
    print("precision", hits / kept, "recall", hits / main, "of", main)
    assert hits / kept > 0.85 and hits / main > 0.85
