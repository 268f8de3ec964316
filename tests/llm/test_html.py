import random

import numpy as np
import pytest

from tidemark.llm import htmltext as ht


def text_of(page):
    return "\n\n".join(t for z, t in ht.blocks(page) if z == ht.ARTICLE)


def test_article_blocks():
    page = """<!DOCTYPE html><html><head><title>T &amp; x</title><style>p{}</style><script>var t="</p>";</script></head><body>
    <nav><ul><li><a href="/x">Menu</a></li></ul></nav><!-- c <p>no</p> --><div class="ad">Buy</div><article><header><h1>Title &lt;1&gt;</h1></header>
    <p><b>Open para <i>with</i>\n  white&nbsp;space<br><p>Next &#233;&#x263a; A&amp;B &amp</p><ul><li>one<li>two</ul><aside>side</aside>
    <form>mail <input> <button>go</button></form><div class="cookie-notice">we use</div><section id="comments"><p>reader</p></section>
    <script>if (a < b) { x("<p>") }</script><table><tr><td>c1<td>c2</table>tail</article><footer>&copy; me</footer></body>"""
    assert text_of(page).split("\n\n") == ["Title <1>", "Open para with white space", "Next é☺ A&B &", "one", "two", "c1", "c2", "tail"]


def test_odd_pages():
    assert ht.blocks(None) == [] and ht.blocks("") == [] and ht.blocks("<<<>>") != None  # noqa: E711
    assert text_of("<article><p>cut off in a tag <b cla") == "cut off in a tag"
    assert text_of("<article>" + "<div>" * 3000 + "deep" + "</div>" * 3000 + "</article>") == "deep"
    assert text_of("<main><p>a<article><p>b</article><p>c</main>d") == "a\n\nb\n\nc"
    assert text_of("<article><p>x</p><!-- open comment <p>y") == "x"
    assert text_of("<article>" + "word " * 50000 + "</article>") == ("word " * 50000).strip()


def test_furniture_by_whole_names_only():
    for page in ("<div class='layout has-sidebar'><article>a</article></div>", "<div id='no-sidebar'><main>a</main></div>",
                 "<article class='post comments-open'>a</article>", "<article><section id='share-prices'>a</section></article>",
                 "<div class='modal'><p>x</p><article>a</article></div>", "<form><nav>n</nav><main>a</main></form>",
                 "<div class='comments'><article>reader</article></div><article>a</article>",
                 "<article>a<div class='side-bar'><article>teaser</article></div></article>"):
        assert text_of(page) == "a", page
    for name in ("ad", "nav-menu", "cookie_notice", "x footer", "comment-list"):
        assert ht.blocks(f"<div class='{name}'>t</div>") == [(ht.FURNITURE, "t")], name


def test_attributes_by_quoted_value():
    assert text_of("<article>see <a title='the hidden cost' href=x>these words</a> <i data-x=\"class='ad'\">too</i></article>") == "see these words too"
    assert text_of("<article>a<p hidden>b</p><p title='x' HIDDEN=''>c</p></article>") == "a"


def test_unseen_elements_without_end():
    assert text_of("<html><head><title>t</title><meta charset=x><article>a</article>") == "a"
    assert ht.blocks("<head><title>t<body><p>a</p>") == [(ht.PLAIN, "a")]
    assert text_of("<article>a <svg viewBox='0 0 1 1'/> b <math/> c <svg><text>no</text></svg> d</article>") == "a b c d"
    assert text_of("<article>a <svg> b<p>c</article>") == "a b\n\nc"


def test_suffix_array_and_lcp():
    r = random.Random(1)
    for _ in range(30):
        s = [r.randrange(3) for _ in range(r.randint(1, 60))]
        sa = ht.suffix_array(np.array(s))
        assert list(sa) == sorted(range(len(s)), key=lambda i: s[i:])
        lcp = ht.lcp_array(np.array(s), sa)
        for i in range(1, len(s)):
            a, b = s[sa[i - 1]:], s[sa[i]:]
            k = 0
            while k < min(len(a), len(b)) and a[k] == b[k]:
                k += 1
            assert lcp[i] == k


def brute_covered(streams, run):
    flat = [(p, b, tuple(t)) for p, page in enumerate(streams) for b, t in enumerate(page)]
    out = {(p, b): [False] * len(t) for p, b, t in flat}
    for p, b, t in flat:
        for i in range(len(t)):
            for j in range(i + 1, len(t) + 1):
                if j - i < run and not (i == 0 and j == len(t)):
                    continue
                on = {q for q, _, u in flat if any(u[k:k + j - i] == t[i:j] for k in range(len(u) - (j - i) + 1))}
                if len(on) >= 2:
                    out[p, b][i:j] = [True] * (j - i)
    return [[out[p, b] for b in range(len(page))] for p, page in enumerate(streams)]


def test_covered_equals_brute_force():
    r = random.Random(2)
    for _ in range(25):
        streams = [[[r.choice("abcd") for _ in range(r.randint(1, 9))] for _ in range(r.randint(0, 3))] for _ in range(r.randint(1, 5))]
        for run in (2, 3, 5):
            assert [[m.tolist() for m in page] for page in ht.covered(streams, run)] == brute_covered(streams, run)


def frame(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_boilerplate_of_pages_without_article(spark):
    shell = "<body><div>Welcome to our site of many good things today</div><div>unique {} lines here for you {}</div><p>About us</p></body>"
    rows = [(i, f"http://h.example/{i}", shell.format(f"u{i} v{i} w{i}", f"x{i}")) for i in range(30)]
    rows += [(100, "http://other/1", "<p>Welcome to our site of many good things today</p>"), (101, None, None), (102, "x", ""), (0, rows[0][1], rows[0][2])]
    for size in (ht.BUCKET_TOKENS, 20):
        got = {}
        for r in ht.extract_text(frame(spark, rows), bucket_tokens=size).collect():
            got.setdefault(r["page_id"], []).append(r["text"])
        assert got[100] == ["Welcome to our site of many good things today"] and got[101] == [""] and got[102] == [""] and len(got[0]) == 2
        assert all(got[i] == [f"unique u{i} v{i} w{i} lines here for you x{i}"] for i in range(1, 30)) or size == 20


def test_buckets_never_change_the_result(spark, monkeypatch):
    r = random.Random(4)
    word = lambda: r.choice("abcdefghij") + r.choice("klmno")
    rare = [[word() for _ in range(r.randint(3, 12))] for _ in range(12)]
    streams = []
    for _ in range(60):
        page = [[word() for _ in range(r.randint(1, 14))] for _ in range(r.randint(1, 4))]
        for passage in r.sample(rare, 2):
            page.insert(r.randrange(len(page) + 1), passage if r.random() < 0.5 else [word(), *passage, word()])
        streams.append(page)
    streams += streams[:7]  # copies of a page
    html = lambda page: "".join(f"<p>{' '.join(b)}</p>" for b in page)
    rows = [(i, f"http://h.example/{i}", html(p)) for i, p in enumerate(streams)]
    want = {}
    for run in (4, ht.MIN_RUN):
        hits = brute_covered(streams[:60], run)
        for i, page in enumerate(streams):
            left = [" ".join(w for w, hit in zip(b, hits[i % 60][k], strict=True) if not hit) for k, b in enumerate(page)]
            want[run, i] = "\n\n".join(x for x in left if x)
    assert any(want.values())
    monkeypatch.setattr(ht, "BUCKET_PAGES", 7)
    for run, size in ((4, 40), (ht.MIN_RUN, 40), (ht.MIN_RUN, 100_000)):
        got = {x["page_id"]: x["text"] for x in ht.extract_text(frame(spark, rows), min_run=run, bucket_tokens=size).collect()}
        assert got == {i: want[run, i] for i in range(len(rows))}
    monkeypatch.setattr(ht, "BUCKET_PAGES", 512)
    assert got == {x["page_id"]: x["text"] for x in ht.extract_text(frame(spark, rows)).collect()}


def test_copies_of_a_page_keep_their_text(spark):
    page = "<p>Terms of use and a notice of all rights reserved here</p><p>body of page {} that only its copies repeat word by word</p>"
    rows = [(i, f"http://h.example/{i}", page.format(i % 3)) for i in range(30)] + [(99, "http://mirror/1", page.format(0)), (98, "http://mirror/2", page.format(0))]
    for size in (ht.BUCKET_TOKENS, 10):
        got = {r["page_id"]: r["text"] for r in ht.extract_text(frame(spark, rows), bucket_tokens=size).collect()}
        assert all(got[i] == f"body of page {i % 3}" for i in range(30)), got
        assert got[98] == got[99] and got[99].endswith("word by word")


def test_coverage_decides_plain_blocks_of_article_pages(spark):
    page = "<body><div>Our shop ships to every country of the world</div><p>lead {0}</p><article><p>art {0}</p><p>more</p></article><p>after {0}</p></body>"
    got = {r["page_id"]: r["text"] for r in ht.extract_text(frame(spark, [(i, f"http://h.example/{i}", page.format(f"n{i}")) for i in range(5)])).collect()}
    assert got == {i: f"lead n{i}\n\nart n{i}\n\nmore\n\nafter n{i}" for i in range(5)}


def test_query_keeps_whole_articles_sf0001(spark):
    import html as h
    import re

    from tidemark.llm.queries import op8_html

    sf = "/root/testdata/sf0.001"
    want = {}
    for r in spark.read.parquet(f"{sf}/pages.parquet").collect():
        body = re.search(r"(?s)<article>(.*)</article>", r["html"])[1]
        parts = [re.sub(r"\s+", " ", h.unescape(re.sub(r"<[^>]*>", "", x.replace("<br>", " ")))).strip() for x in re.split(r"</?(?:p|h1)>", body)]
        want[r["page_id"]] = "\n\n".join(x for x in parts if x)
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in op8_html(spark, sf).collect()}
    assert got == {k: (v, len(v)) for k, v in want.items()}


def test_empty_table(spark):
    assert ht.extract_text(frame(spark, [])).count() == 0


FURNITURE_NAMES = ["reader-comments", "user-comments", "article-comments", "comments-thread", "google-ads", "ad-300x250",
                   "gdpr-banner", "mega-menu", "author-promo", "taboola-widget", "story__related-items", "site_footer-2"]
CONTENT_NAMES = ["share-prices", "has-sidebar", "no-sidebar", "comments-open", "content-and-comments", "menu-free", "notice-period",
                 "widgetry", "advert-history-text", "elementor-widget"]


@pytest.mark.parametrize("attr", ["class", "id"])
@pytest.mark.parametrize("where", ["article", "beside"])
def test_compound_names_of_furniture(attr, where):
    def page(name):
        box = f'<div {attr}="{name}"><p>Inside the box.</p></div>'
        return f"<article><p>Before it.</p>{box}<p>After it.</p></article>" if where == "article" else f"<article><p>Text.</p></article>{box}"

    for name in FURNITURE_NAMES:
        assert (ht.FURNITURE, "Inside the box.") in ht.blocks(page(name)), name
    for name in CONTENT_NAMES:
        assert (ht.FURNITURE, "Inside the box.") not in ht.blocks(page(name)), name
    for name in [*CONTENT_NAMES, "page-menu", "mega-menu"]:  # a wrapper's name never hides the article inside
        assert (ht.ARTICLE, "Kept.") in ht.blocks(f'<div {attr}="{name}"><article><p>Kept.</p></article></div>'), name


def test_zero_width_characters_are_not_white_space():
    assert ht.blocks("<p>foo\u200bbar\ufeff \u00a0 baz</p>") == [(ht.PLAIN, "foo\u200bbar\ufeff baz")]


def test_coverage_tells_articles_without_their_tags(spark):
    """The pages of a test table without their article tags: what repeats goes, what the article said stays."""
    import re
    from collections import Counter

    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    want = {r["page_id"]: r["text"] for r in ht.extract_text(pages).collect()}
    bare = spark.createDataFrame([(r["page_id"], r["url"], re.sub(r"</?(?:article|main)\b[^>]*>", "", r["html"] or ""))
                                  for r in pages.collect()], "page_id long, url string, html string")
    kept = added = total = 0
    for r in ht.extract_text(bare).collect():
        a, b = Counter(want[r["page_id"]].split()), Counter(r["text"].split())
        kept, added, total = kept + (a & b).total(), added + (b - a).total(), total + a.total()
    assert total > 90_000 and kept >= 0.99 * total and added <= 0.005 * total


def test_shared_with_another_page_equals_a_walk():
    r = random.Random(6)
    for n in (0, 1, 2, 3, 50):
        for _ in range(40):
            lcp, pages = np.array([r.randrange(6) for _ in range(n)], np.int64), np.array([r.randrange(3) for _ in range(n)])
            want = [max((min(lcp[min(i, j) + 1:max(i, j) + 1]) for j in range(n) if pages[j] != pages[i]), default=0) for i in range(n)]
            assert ht._shared_with_another_page(lcp, pages).tolist() == want
