"""HTML extraction: marks, the site style tree against a brute-force tree, and its effect on the given pages."""

import math
import random

from tokenledger.llm import site_style as ss

PAGE = """<html><head><title>t</title><style>p{}</style><script>var a="</p>";</script></head><body><nav><li>menu</li></nav><div class="ad x">buy</div>
<article><h1>Head &amp; line</h1><p><b>First  bold<br><p>Two\n words&nbsp;here</p><ul><li>a<li>b</ul><div class="comments"><p>nice!</p></div></article><footer>&copy; x</footer></body>"""
PAGES = "page_id long, url string, html string, text string, n_chars string, host int, path int"


def frame(spark, rows):
    """Pages with extra columns whose names clash with those of results and helpers."""
    return spark.createDataFrame([(i, u, h, "old", "old", 1, 2) for i, u, h in rows], PAGES)


def test_extraction():
    assert ss.main_text(PAGE) == "Head & line\nFirst bold\nTwo words here\na\nb"
    assert ss.main_text(None) == "" and ss.main_text("<p") == "<p" and ss.main_text("a < b <p>c") == "a < b\nc"
    assert ss.main_text('<p title="a>b">x</p><p class=\'open>y') != ""
    assert ss.main_text("<div>" * 5000 + "deep") == "deep"


def test_very_deep_and_very_long_pages(spark):
    deep = "<div>" * 300 + "inner" + "<div class='ads'>buy</div>" + "</div>" * 300
    assert ss.main_text(f"<div><article><p>first</p>{deep}<p>last</p></article><p>outside</p></div>") == "first\ninner\nlast"
    assert ss.main_text("<div>" * 250 + "<nav>menu here</nav>text") == "text"
    assert ss.main_text("<div>" * 100_000 + "deep" + "</section>" * 100_000) == "deep"
    long = [f"word{i}" for i in range(60_000)]
    rows = [(1, "http://a.org/", "<p>" + " ".join(long)), (2, "http://a.org/b", "<div>" * 20_000 + "deep")]
    got = {r.page_id: r.text for r in ss.extract(frame(spark, rows)).collect()}
    assert got == {1: " ".join(long), 2: "deep"}


def test_words_that_say_more_and_headings_stay():
    page = (
        '<article><header><h1>T</h1></header><div class="article-header"><h2>Title</h2></div><p class="share-price">12</p><p>a <span class="ad">buy <span>x</span> now</span> b</p>'
        '<div class="cookie-notice">c</div><h2 class="header">H</h2><aside>side</aside><form>f</form><div role="navigation">n</div><div class="comment-list"><h3>Says</h3></div></article>')
    assert ss.main_text(page) == "T\nTitle\n12\na b\nH"


def test_unclosed_and_raw_elements():
    assert ss.main_text("<article><p>one</p><canvas><p>two</p></article>") == "one\ntwo"
    assert ss.main_text("<article><select><option>a<p>text</p></article><p>out") == "text"
    assert ss.main_text("<article><p>one <select><option>a</select> two <svg><title>t</title><path d='x'/></svg>three</p></article>") == "one two three"
    assert ss.main_text("<article>a <math><mi>x</mi><mo>=</mo><mn>1</mn></math> b</article>") == "a x=1 b"
    assert ss.main_text("<article><p>one</p><svg><g></article><article><p>two</p></article>") == "one\ntwo"
    assert ss.main_text("<article><p>one<script>if (a < b) { '</p>' }</script> two</p><style>p{}</article>") == "one two"


def test_menus_of_dishes_and_words_in_a_line():
    dishes = "<article><p>We serve</p><ul class='menu'><li>soup</li><li>fish</li></ul><ul class='menu'><li><a href='/x'>home</a></li></ul></article>"
    assert ss.main_text(dishes) == "We serve\nsoup\nfish"
    assert ss.main_text("<article><p>one <span class='share'>two</span> <span class='ad'>buy</span> three</p></article>") == "one two three"


def test_style_tree_removes_template_branches(spark):
    page = lambda i: f"<body><div class='top'>Welcome to our site</div><div class='txt'><p>story {i} of the day</p></div></body>"
    rows = [(i, f"http://host.com/{i}", page(i)) for i in range(12)] + [(50, "http://one.com/", page(50)), (51, None, page(51)), (52, "http://host.com/x", None), (3, "http://host.com/3", page(3))]
    got = ss.extract(frame(spark, rows)).collect()
    text = {r.page_id: r.text for r in got}
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    assert text[3] == "story 3 of the day" and text[50].startswith("Welcome") and text[51].startswith("Welcome") and text[52] == ""
    assert ss.extract(frame(spark, [])).count() == 0


def test_branches_inside_an_article_go_unless_they_are_unique(spark):
    page = lambda i: f"<article><h2>Summary</h2><p>story {i}</p><p>All rights reserved</p><div class='box'><div>More from us</div></div><div class='fact'>fact {i}</div></article>"
    got = {r.page_id: r.text for r in ss.extract(frame(spark, [(i, "http://host.com/", page(i)) for i in range(20)])).collect()}
    assert got[7] == "Summary\nstory 7\nAll rights reserved\nfact 7"


def test_copies_of_one_page_keep_their_text(spark):
    got = {r.text for r in ss.extract(frame(spark, [(i, "http://host.com/", "<div><div>the only story</div></div>") for i in range(9)])).collect()}
    assert got == {"the only story"}


# A style tree made the plain way: element objects, merged by labels, entropies by their definition.


def entropy(counts):
    n = sum(counts)
    return -sum(c / n * math.log(c / n) for c in counts)


def plain_tree(pages):
    """{labels: (pages, sequences of children by page, {text: {page: count}})} of (label, own texts, children) elements."""
    tree = {}

    def walk(page, element, above):
        label, texts, children = element
        path = (*above, label)
        seen, shapes, words = tree.setdefault(path, (set(), {}, {}))
        seen.add(page)
        order = [c[0] for i, c in enumerate(children) if not i or children[i - 1][0] != c[0]]
        shapes.setdefault(page, []).append(tuple(order))
        for t in texts:
            words.setdefault(t, {}).setdefault(page, 0)
            words[t][page] += 1
        for c in children:
            walk(page, c, path)

    for page, root in enumerate(pages):
        walk(page, root, ())
    return tree


def plain_kept(tree, root, low):
    def importance(element, above):
        """(importance, whether all of the branch is below low, texts that stay)."""
        label, texts, children = element
        path = (*above, label)
        seen, shapes, words = tree[path]
        m = math.log(len(seen))
        content = 1 - sum(entropy(w.values()) / m for w in words.values()) / len(words) if words else 0
        below = [importance(c, path) for c in children]
        if not children:
            own = content if texts else 0
        else:
            kinds = [tuple(map(tuple, s)) for s in shapes.values()]
            counts = [kinds.count(k) for k in set(kinds)]
            parts = [b[0] for b in below] + ([content] if texts else [])
            w = 0.9 ** len(counts)
            own = (1 - w) * entropy(counts) / m + w * sum(parts) / len(parts)
        gone = own < low and all(b[1] for b in below)
        return own, gone, ([] if gone else list(texts)) + [t for b in below for t in b[2]]

    return importance(root, ())[2]


def random_page(rng, i):
    pool = ["Home", "About us"]

    def element(depth):
        label = rng.choice(["div.a", "div.b", "div.c", "section.d"])
        if depth > 2 or rng.random() < 0.55:
            return label, [rng.choice(pool) if label in ("div.a", "div.b") else f"story {i} {rng.random():.6f}"], []
        return label, [], [element(depth + 1) for _ in range(rng.randint(1, 3))]

    return "body", [], [element(1) for _ in range(3)]


def html_of(element):
    label, texts, children = element
    tag, _, name = label.partition(".")
    attrs = f' class="{name}"' if name else ""
    return f"<{tag}{attrs}>{''.join(texts)}{''.join(map(html_of, children))}</{tag}>"


def test_tree_equals_brute_force(spark):
    rng = random.Random(5)
    pages = [random_page(rng, i) for i in range(90)]
    tree = plain_tree([("", [], [p]) for p in pages])
    known = {k: v for k, v in tree.items() if len(v[0]) >= 2}
    rows = [(i, "http://host.com/", html_of(p)) for i, p in enumerate(pages)]
    for most in (1000, 0):  # by broadcast, and by join
        got = {r.page_id: r for r in ss.extract(frame(spark, rows), low=0.7, least_pages=2, most_nodes=most).collect()}
        compared = changed = 0
        for i, p in enumerate(pages):
            def paths(e, above=()):
                yield (*above, e[0])
                for c in e[2]:
                    yield from paths(c, (*above, e[0]))

            if all(x in known for x in paths(("", [], [p]))):  # pages with a node of their own are judged otherwise
                want = plain_kept(known, ("", [], [p]), 0.7)
                every = plain_kept(known, ("", [], [p]), 0.0)
                if want:
                    assert sorted(got[i].text.split("\n")) == sorted(want)
                    compared += 1
                    changed += want != every
        assert compared >= 5 and changed >= 3


def test_the_tree_alone_and_the_marks_agree_on_given_pages(spark):
    """No given page's text changes by the tree, as all that it removes there is marked as well."""
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet").select("page_id", "url", "html").cache()
    marks = {r.page_id: ss.main_text(r.html) for r in pages.collect()}
    whole = {r.page_id: "\n".join(ss.Dom(r.html).text) for r in pages.collect()}
    tree = {r.page_id: r for r in ss.extract(pages, clean=False).collect()}
    full = {r.page_id: r.text for r in ss.extract(pages).collect()}
    changed = [i for i, r in tree.items() if r.text != whole[i]]
    assert len(changed) > 800 and sum(tree[i].text == marks[i] for i in changed) > 750  # without any clean-up the tree alone leaves the article
    assert full == marks  # what it leaves elsewhere is marked
    pages.unpersist()
