import html
import re

import pytest

from pagelantern.llm import html_text as h


def text(page, shared=()):
    return h.main_text(page, dict.fromkeys(shared, 9))


@pytest.mark.parametrize(
    "page, want",
    [
        (None, ""),
        ("", ""),
        ("plain &lt; text &amp more", "plain < text & more"),
        ("<nav>menu</nav><article><h1>T</h1><p>a <b>b</b>c<br>d<p>e</article><footer>f</footer>", "T a bc d e"),
        ("<article>x<script>if (a<b) {}</script><style>p{}</style><!-- c --></article>", "x"), ("<article>x<noscript>n</noscript>y</article>", "x y"),
        ("<div class='side-menu'>m</div><main><p>a</p><aside>s</aside><form>q</form><div class='share'>t</div></main>", "a"),
        ("<article><p>a</p><section class='comments'><article>reader</article></section></article>", "a"),
        ("<body class='no-header'><div id='cookie-notice'>ok?</div><p>one</p><p hidden>h</p><p>two", "one two"),
        ("<p title='a>b'>x</p><img alt='<p>z</p>'><p>y", "x y"),
        ("<article><p>unclosed <b>bold<br><p>next</p></article>", "unclosed bold next"),
        ("<article>a\n\t b&nbsp;c</article>", "a b c"),
        ("<ARTICLE>A</ARTICLE><div>out</div>", "A"),
        ("<header><h1>Site</h1></header><article><header><h1>T</h1></header>b</article>", "T b"),
        ("<article>a < b and <3 c</article>", "a < b and <3 c"),
    ],
)
def test_pages(page, want):
    assert text(page) == want


@pytest.mark.parametrize(
    "page, want",
    [
        ("<article class='review'><p>a film</p></article>", "a film"),
        ("<main id='product-review'><p>a pan</p></main>", "a pan"),
        ("<article><div class='entry-header'><h1>T</h1></div><p>b</p></article>", "T b"),
        ("<article class='x'><div class='article-header wide'>T</div><div class='has-sidebar'>s</div><div class='with-banner'>t</div></article>", "T s t"),
        ("<article><section class='related-work'>r</section><div class='search-results'>q</div></article>", "r q"),
        ("<article>a<div class='comment-list'>c</div><div class='header'>h</div><div class='has-sidebar sidebar'>s</div><div class='related-posts'>r</div></article>", "a"),
        ("<article>a</article><div id='comments'><article>reader</article></div>", "a"),
        ("<article>a<article class='comment'>reader</article></article>", "a"),
    ],
)
def test_class_words_do_not_take_article_text(page, want):
    assert text(page) == want


def test_shared_runs_go_and_unique_ones_stay(frame):
    menu, foot = "Home News Sport Weather Contact Login", "All about us since 1999 in town"
    page = lambda k: f"<div>{menu}</div><div><p>story {k} tells of number {k} and more of {k}</p></div><div>{foot}</div>"
    rows = [(k, f"https://a.example/{k}", page(k)) for k in range(6)] + [(9, "https://b.example/", page(9)), (10, None, None), (None, "x", ""), (3, "https://a.example/3", page(3))]
    got = h.extract(frame([(*r, "z") for r in rows], "page_id long, url string, html string, shared string")).collect()
    by = {r.page_id: r for r in got}
    assert len(got) == 10 and by[3].text == "story 3 tells of number 3 and more of 3" and by[3].n_chars == len(by[3].text)
    assert by[9].text.startswith("Home News") and by[9].text.endswith("town") and by[10].text == "" and by[None].text == ""
    assert h.extract(frame([], "page_id long, url string, html string")).count() == 0


def slow_text(page, pages, depth=6, least=5, share=0.5):
    """A page's text by comparing its windows with those of all pages (html) of its host."""
    read = [h.blocks(p) for p in pages]
    found = h.blocks(page)
    inside = lambda f: tuple(t for place, _, t in f if place == h.IN)
    if inside(found):
        articles = {inside(f) for f in read if inside(f)}
        holders = lambda t: sum(t in a for a in articles)
        gone = [t for t in inside(found) if len(t.split(" ")) >= depth and holders(t) >= max(least, share * len(articles))]
        return " ".join(inside(found) if 2 * sum(map(len, gone)) > sum(map(len, inside(found))) else [t for t in inside(found) if t not in gone])
    distinct = {tuple((place, t) for place, _, t in f): f for f in read}.values()
    windows = lambda tokens: [tuple((tokens + [None] * depth)[k : k + depth]) for k in range(len(tokens))]
    on = [{w for run in h.stretches(f) for w in windows([t for _, t in run])} for f in distinct]
    whole = sum(len(t.split(" ")) for place, _, t in found if place == h.OUT)
    for most in range(1, len(pages) + 1):
        out = []
        for run in h.stretches(found):
            tokens = [w for _, w in run]
            cover = {i for k, w in enumerate(windows(tokens)) if sum(w in o for o in on) > most for i in range(k, k + depth)}
            for block in dict.fromkeys(i for i, _ in run):
                place = [k for k, (i, _) in enumerate(run) if i == block][1:]
                if found[block][0] == h.OUT:
                    marks = "".join("x" if k in cover else "." for k in place)
                    gone = {i for m in re.finditer("x+", marks) if len(m[0]) >= depth or len(m[0]) == len(marks) for i in range(*m.span())}
                    out += [tokens[k] for i, k in enumerate(place) if i not in gone]
        if 10 * len(out) >= whole:
            return " ".join(out)


def test_equals_brute_force(frame):
    import random

    rng = random.Random(4)
    words = [rng.choice("abcdefgh") * rng.randint(1, 2) for _ in range(60)]
    said = lambda k: " ".join(rng.choice(["uno", "dos", "tres"]) + str(rng.randrange(900)) for _ in range(rng.randint(8, 30)))
    pages = [f"<p>{' '.join(words[rng.randrange(40) :][: rng.randint(8, 20)])} u{k} v{k}</p><div>{said(k)}</div>" for k in range(14)]
    sign = "Thanks for reading and come back to us soon"
    pages += [f"<div>{' '.join(words[:9])}</div><article><p>{said(k)}</p><p>{said(k)}</p><p>{sign}</p></article>" for k in range(16)]
    pages += [f"<article><p>{sign}</p></article>"]
    rows = frame([(k, "http://h.example/", p) for k, p in enumerate(pages)], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in h.extract(rows).collect()}
    assert got == {k: slow_text(p, pages) for k, p in enumerate(pages)}
    assert sum(sign in t for t in got.values()) == 1 and sum(len(t) for t in got.values()) < sum(len(h.main_text(p, {})) for p in pages)


def test_two_distinct_pages_suffice_and_copies_keep_their_text(frame):
    menu = "Start Events Places People Contact Imprint"
    story = lambda k: " ".join(f"w{k}x{i}" for i in range(40))
    one = [(k, "http://a.example/", f"<div>{menu}</div><p>{story(k)}</p>") for k in range(9)]
    copies = [(20 + k, "http://b.example/", f"<div>{menu}</div><p>{story(7)}</p>") for k in range(3)]
    repeated = [(30, "http://c.example/", f"<div>{menu}</div><p>{story(8)}</p>")] * 3
    near = [(40 + k, "http://d.example/", f"<div>{menu}</div><p>{' '.join(f'n{i}' for i in range(300))} on day {k}</p>") for k in range(2)]
    got = h.extract(frame(one + copies + repeated + near, "page_id long, url string, html string")).collect()
    by = {r.page_id: r.text for r in got}
    assert len(got) == 17 and all(by[k] == story(k) for k in range(9))
    assert all(story(7) in by[20 + k] for k in range(3)) and story(8) in by[30] and all("n299 on day" in by[40 + k] for k in range(2))


def test_both_ways_to_join_give_the_same(frame):
    pages = [(k, "http://a.example/", f"<div>Start Events Places People Contact Imprint</div><p>{' '.join(f'w{k}x{i}' for i in range(20))}</p>") for k in range(6)]
    rows = frame(pages, "page_id long, url string, html string")
    assert sorted(map(tuple, h.extract(rows).collect())) == sorted(map(tuple, h.extract(rows, sent=0).collect()))


def test_deep_markup():
    deep = "<span>" * 3000 + "<article><p>story</p></article><footer>foot</footer>"
    assert text(deep) == "story" and text("<b><article>" + "<i>" * 20000 + "a" + "</b>" * 20000 + "</article>") == "a"
    assert text("<p>one <b>two <i hidden>no</b> three</p>") == "one two three"


def test_method_decides_on_the_table_without_its_markup(spark, sf_dir):
    """The table's pages as plain divisions of a few hosts: what repeats goes only by the suffix array."""
    plain = r"</?(article|nav|footer|ul|li|a)\b[^>]*>|class=.ad."
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").selectExpr("page_id", "concat('http://h', page_id % 2, '.example/') as url", f"regexp_replace(html, r'{plain}', '') as html")
    off = {r.page_id: h.main_text(r.html, {}) for r in pages.collect()}
    got = {r.page_id: r.text for r in h.extract(pages).collect()}
    assert any(len(got[k]) < len(off[k]) for k in off) and all(len(got[k]) <= len(off[k]) for k in off)


def test_query_on_table(spark, sf_dir):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    for r in h.op7_html_text(spark, sf_dir).collect():
        article = re.search(r"<article>(.*?)</article>", pages[r.page_id], re.S)[1]
        assert r.text == " ".join(html.unescape(re.sub("<[^>]+>", " ", article)).split()) and r.n_chars == len(r.text)
