"""Page rules at their boundaries, and plans that stay native and keep html out of shuffles."""

import pytest
from pyspark.sql import functions as F

from pagelantern.operators import joined_rules, rules, site
from pagelantern.sources import features as fx
from pagelantern.sources import tables

SCHEMA = "page_id long, host string, url string, html string, status int, last_modified timestamp"


def page(head="", body="", url="https://a.example/x", lang=' lang="en"'):
    return f"<!DOCTYPE html><html{lang}><head>{head}</head><body>{body}</body></html>", url


def broken(spark, cases):
    rows = [(k, url.split("/")[2], url, html, 200, None) for k, (html, url) in enumerate(cases)]
    made = fx.page_features(spark.createDataFrame(rows, SCHEMA))
    out = {k: set() for k in range(len(cases))}
    for r in rules.page_findings(rules.rule_inputs(made)).collect():
        out[r.page_id].add(r.rule_id)
    return [out[k] for k in range(len(cases))]


def words(n):
    return " ".join(["word"] * n)


CASES = [
    ("T02", page("<title>" + "t" * 19 + "</title>"), page("<title>" + "t" * 20 + "</title>")),
    ("T02", page("<title>" + "t" * 71 + "</title>"), page("<title>" + "t" * 70 + "</title>")),
    ("T01", page("<title> </title>"), page("<title>x</title>")),
    ("T03", page(), page('<meta content="d" name="description">')),
    ("T04", page(f'<meta name="description" content="{"d" * 181}">'), page(f'<meta name="description" content="{"d" * 180}">')),
    ("T05", page('<link rel="canonical" href="https://b.example/x">'), page('<link rel="canonical" href="/x">')),
    ("T06", page(lang=""), page()),
    ("T14", page('<meta name="robots" content="NOINDEX">'), page('<meta name="robots" content="index">')),
    ("T16", page('<link href="/y" rel="canonical">'), page('<link rel="canonical" href="https://a.example/x/">')),
    ("T17", page(body="<h1>a</h1><h1>b</h1>"), page(body="<h1>a</h1>")),
    ("T18", page(body="<!-- <h1>a</h1> -->"), page(body="<h1>a</h1>")),
    ("S01", page('<script type="application/ld+json">{x</script>'), page('<script type="application/ld+json">{"@type":"Thing"}</script>')),
    ("S02", page('<script type="application/ld+json">{"@context":"https://schema.org","@type":"Thing"}</script>'), page('<script type="application/ld+json">[{"@graph":[{"@type":["Organization","X"]}]}]</script>')),
    ("S10", page('<script type="application/ld+json">{"@type":"Thing"}</script>'), page('<script type="application/ld+json">{"@context":"https://schema.org","@type":"Thing"}</script>')),
    ("S12", page(url="https://a.example/x/y"), page(url="https://a.example/x")),
    ("G05", page(body=f"<p>{words(133)}</p>"), page(body=f"<p>{words(134)}</p>")),
    ("G06", page(body=f"<p>{words(168)}</p>"), page(body=f"<p>{words(167)}</p>")),
    ("G07", page(body="<h2>a</h2><h2>What b?</h2><h2>c</h2>"), page(body="<h2>How a</h2><h2>What b</h2><h2>c</h2>")),
    ("G08", page(body=f"<h2>a</h2><p>{words(61)}</p>" * 3), page(body=f"<h2>a</h2><p>{words(60)}</p>" * 3)),
    ("G08", page(body=f"<h2>a</h2><p>{words(61)}</p>" * 3), page(body=f"<h2>a</h2><p>{words(61)}</p>" * 2)),
    ("G09", page(body=f"<p>{words(301)}</p>"), page(body=f"<p>{words(301)} 45 %</p>")),
    ("G12", page(body=words(800)), page(body=words(800) + "<blockquote>q</blockquote>")),
    ("G15", page(body="maybe perhaps maybe perhaps"), page(body="maybe perhaps maybe")),
    ("E01", page(url="http://a.example/"), page()),
    ("E03", page(body="<article>x</article>"), page('<meta name="author" content="J">', "<article>x</article>")),
    ("E10", page(body='<img src="a"><img src="b" alt=""><img src="c" alt="c">'), page(body='<img src="b" alt=""><img src="c" alt="c"><img src="d" alt="d">')),
    ("I05", page('<link rel="alternate" hreflang="fr_FR" href="/f">'), page('<link rel="alternate" hreflang="fr-FR" href="/f">')),
    ("I06", page('<link rel="alternate" hreflang="de" href="/d">'), page('<link rel="alternate" hreflang="en" href="/x/">')),
    ("P06", page(body='<a href="#/a">a</a><a href="/#/b">b</a><a href="#/c">c</a>'), page(body='<a href="#/a">a</a><a href="/#/b">b</a><a href="#c">c</a>')),
    ("P07", page(body="x" * 200), page(body="x" * 201)),
    ("P10", page(body='<img src="a">'), page(body='<img src="a" width="1" height="2">')),
    ("P13", page('<script src="a.js"></script>'), page('<script src="a.js" defer></script>')),
    ("O02", page(body='<a href="/p">same</a>' * 6), page(body='<a href="/p">same</a>' * 4 + '<a href="/q">else</a>' * 2)),
    ("O03", page(body='<a href="/p">read more</a>' * 2 + '<a href="/q">text</a>' * 6), page(body='<a href="/p">read more</a>' + '<a href="/q">text</a>' * 7)),
    ("C02", page(body='<img src="http://b.example/i.png">'), page(body='<img src="http://localhost/i.png">')),
    ("C05", page("<title>a</title><title>b</title>"), page("<title>a</title>")),
    ("C08", page(body='<nav><button onclick="a()">a</button><i role="button">b</i><button role="link">c</button></nav>'), page(body='<nav><i onclick="a()">a</i><i onclick="b()">b</i><i onclick="c()">c</i><a class="x" href="/c">c</a></nav>')),
    ("C08", page(body='<nav><i onclick="a()">a</i><i onclick="b()">b</i><i onclick="c()">c</i></nav>'), page(body="<nav><button>a</button><button>b</button><button>c</button></nav>")),
    ("C02", page('<script src="http://b.example/a.js"></script>'), page('<!-- <script src="http://b.example/a.js"></script> -->')),
    ("C07", page('<meta name="robots" content="noindex"><link rel="canonical" href="https://a.example/x/">'), page('<meta name="robots" content="noindex"><link rel="canonical" href="http://a.example/x">')),
    ("T12", page('<meta property="og:image" content="data:image/png;base64,x">'), page('<meta property="og:image" content="i/a:b.png">')),
    ("S10", page('<script type="application/ld+json">[{"@context":"https://schema.org","@type":"Thing"},{"@type":"Thing"}]</script>'), page('<script type="application/ld+json">[{"@context":"https://schema.org","@type":"Thing"}]</script>')),
    ("S11", page('<script type="application/ld+json">[{"@context":"http://schema.org"},{"@type":"Thing"}]</script>'), page('<script type="application/ld+json">{"@context":"https://schema.org","note":{"@context":"http://schema.org"}}</script>')),
    ("S14", page('<script type="application/ld+json">{"@type":"Article","image":{"url":"/a.png"}}</script>'), page('<script type="application/ld+json">{"@type":"Article","image":""}</script>')),
    ("N05", page('<script type="application/ld+json">{"@type":"WebSite","potentialAction":"x"}</script>'), page('<script type="application/ld+json">{"@type":"WebSite","potentialAction":[{"@type":"ReadAction"}]}</script>')),
    ("S06", page('<script type="application/ld+json">{"@type":"WebSite","potentialAction":[{"@type":"SearchAction"}]}</script>'), page('<script type="application/ld+json">{"@type":"WebSite","potentialAction":{"@type":"SearchAction"}}</script>')),
    ("E03", page('<script type="application/ld+json">{"@type":"Thing","author":"Jo"}</script>', "<article>x</article>"), page('<script type="application/ld+json">[{"@type":"Article"},{"@type":"TechArticle","author":"Jo"}]</script>', "<article>x</article>")),
    ("E06", page(body="<article>x</article>"), page(body="<article>Vérifié par Jo</article>")),
    ("E08", page(body="<article></article>" + '<a href="https://b.example/">https://b.example is here</a>' * 3), page(body="<article></article>" + '<a href="https://b.example/">see https://b.example</a>' * 3)),
    ("I06", page('<link rel="alternate" hreflang="en" href="/x?a=1">'), page('<link rel="alternate" hreflang="en" href="https://a.example/x//">')),
    ("I07", page('<link rel="alternate" hreflang="fil-PH" href="/x">', lang=' lang="fi"'), page('<link rel="alternate" hreflang="fil-PH" href="/x">', lang=' lang="fil"')),
    ("I01", page('<link rel="canonical" hreflang="en" href="/x">'), page('<link rel="alternate" hreflang="en" href="/x">')),
    ("P08", page(body='<img src="a.webp.png" srcset="a.webp 2x">'), page(body='<img srcset="a.webp 2x">')),
    ("P10", page(body='<img src="a" width="" height="2">'), page(body="<img src='a' width=1 height=2>")),
    ("O01", page(body='<a href="mailto:j@a.example">m</a>' * 4 + '<a href="/p">p</a>' * 6), page(body='<a href="#p">m</a>' * 4 + '<a href="./p">p</a>' * 6)),
]


@pytest.fixture(scope="module")
def outcome(spark):
    return broken(spark, [p for _, bad, good in CASES for p in (bad, good)])


@pytest.mark.parametrize("k", range(len(CASES)), ids=[c[0] for c in CASES])
def test_boundary(outcome, k):
    assert CASES[k][0] in outcome[2 * k] and CASES[k][0] not in outcome[2 * k + 1]


def test_odd_pages(spark):
    rows = [(1, "h", "https://h/", None, 200, None), (2, "", None, "<p>", None, None), (3, "h", "https://h/", "<a href='x'>" * 500, 200, None), (3, "h", "https://h/", "", 200, None)]
    made = fx.page_features(spark.createDataFrame(rows, SCHEMA))
    assert made.count() == 4
    assert rules.page_findings(rules.rule_inputs(made)).where("page_id = 1 and rule_id = 'T01'").count() == 1


def test_own_rules(spark):
    rows = [(1, "h", "https://h/", "<p>x</p>", 200, None)]
    made = fx.page_features(spark.createDataFrame(rows, SCHEMA))
    own = rules.Rule("X1", "own", "own-short", "low", "0.5", "quick", "words < 5")
    assert [r.rule_id for r in rules.page_findings(rules.rule_inputs(made), [own]).collect()] == ["X1"]


def test_plans_are_native_and_html_is_not_shuffled(spark, sf_dir):
    made = fx.page_features(tables.pages(spark, sf_dir))
    plan = rules.page_findings(rules.rule_inputs(made))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan
    assert not [line for line in plan.splitlines() if "Exchange" in line and "html#" in line]


def test_freshness(spark):
    said = lambda *pairs: '<script type="application/ld+json">{' + ",".join(f'"{k}":"{v}"' for k, v in pairs) + "}</script>"
    heads = [
        page(said(("dateModified", "2024-01-01")), '<time datetime="2024-05-30">x</time>', url="https://a.example/1"),
        page(said(("dateModified", "2024-01-01")), url="https://a.example/2"),
        page(said(("dateModified", "no date"), ("datePublished", "2024-06-10T12:00:00")), url="https://a.example/3"),
        page(url="https://a.example/4"),
    ]
    rows = [(k, "a.example", url, html, 200, None) for k, (html, url) in enumerate(heads, 1)]
    pages = spark.createDataFrame(rows, SCHEMA).withColumn("last_modified", F.expr("timestamp'2023-01-01'"))
    entries = spark.createDataFrame([("a.example", "https://a.example/1", "2024-05-28"), ("a.example", "https://a.example/2", "2024-03-01")], "host string, loc string, d string").select("host", "loc", F.to_timestamp("d").alias("lastmod"))
    got = joined_rules.freshness(rules.rule_inputs(fx.page_features(pages)), entries, "2024-06-15").collect()
    assert {(r.page_id, r.rule_id) for r in got} == {(2, "F02"), (2, "F06"), (3, "F03"), (4, "F01")}
    assert {r.page_id: r.age for r in got}[3] == 4


def test_entity_catalogue(spark):
    org = '<script type="application/ld+json">{"@type":"Organization"%s}</script>'
    made = [page(org % ',"name":"Acme Corp"'), page('<meta property="og:site_name" content="Acme — home">' + org % ""), page("<title>Other | Acme</title>" + org % ""), page(org % ',"name":"Acme","sameAs":"https://www.WikiData.org/wiki/Q1"')]
    rows = [(k, "a.example", url, html, 200, None) for k, (html, url) in enumerate(made)]
    catalog = spark.createDataFrame([("acme", "Q1", 1)], "label string, entity_id string, rank int")
    got = joined_rules.entity_rules(rules.rule_inputs(fx.page_features(spark.createDataFrame(rows, SCHEMA))), catalog).collect()
    assert {(r.page_id, r.rule_id) for r in got} == {(0, "N02"), (1, "N02"), (2, "N03")}


PARAGRAPHS = [
    ("<div><p>Menu one two</p></div><article><p>In the article.</p></article>", "In the article."),
    ("<div><p>Menu</p></div><p>Directly in the body</p>", "Directly in the body"),
    ("<div><p>Only in a <b>div</b></p></div>", "Only in a div"),
    ("<div><p>Menu</p><section><div><p>In a <i>section</i> of a div</p></div></section></div><p>later</p>", "In a section of a div"),
    ("<main><p> </p><p></p><div><p>Main, nested</p></div></main>", "Main, nested"),
    ("<header><p>Head</p></header><p>After the header<p>Next", "After the header"),
    ("<nav><ul><li><p>Listed</p></li><li>x</ul></nav><p>After an open item</p>", "After an open item"),
    ("<article><h1>No paragraph</h1></article><aside><p>Aside</p></aside><footer><p>Foot</p></footer>", "Aside"),
    ("<div><p>Cut by<div>a block</div></p></div>", "Cut by"),
    ("</div></article><p>Stray ends</p><div><p>no</p></div>", "Stray ends"),
    ("<MAIN><P CLASS='x'>Upper case</P></MAIN>", "Upper case"),
    ("<section></section><div><p>Behind a section</p></div><p>Body</p>", "Body"),
    ("<p>Said <br> in<br/>two lines</p>", "Said in two lines"),
    ("no paragraph", ""),
    ("", ""),
]


def test_first_paragraph_by_container(spark):
    rows = spark.createDataFrame([(k, html) for k, (html, _) in enumerate(PARAGRAPHS)], "k int, html string").select("k", fx.first_paragraph(F.col("html")).alias("p"))
    assert [(r.k, r.p) for r in rows.orderBy("k").collect()] == [(k, p) for k, (_, p) in enumerate(PARAGRAPHS)]


def test_paragraph_rules_read_the_main_text(spark):
    menu = "<div><p>Menu one two</p></div>"
    bodies = [f"{menu}<article><p>{words(n)}</p></article>" for n in (133, 134, 167, 168)] + [menu, "<main><p>short</p></main>", "<main></main>"]
    found = [b & {"G04", "G05", "G06"} for b in broken(spark, [page(body=b) for b in bodies])]
    assert found == [{"G05"}, set(), set(), {"G06"}, {"G05"}, {"G05"}, {"G04"}]


def ld(text):
    return f'<script type="application/ld+json">{text}</script>'


def test_structured_data_at_any_depth(spark):
    org = '{"@type":"Organization","name":"Deep"}'
    nested = org
    for k in range(12):
        nested = f'{{"@graph":[{nested}]}}' if k % 2 else f"[[{nested}]]"
    other = '{"@graph":{"@type":"Thing"},"@type":"HowTo"}'  # a graph that is no list is an object like any other
    heads = [ld(nested), ld(f"[{other},[[]],null,1,\"x\"]"), ld('{"@graph":[]}'), ld("[]") + ld("{broken"), ld(f'{{"@graph":[{{"@type":"Article"}},[{org},{{"@graph":[{{"@type":"Person"}}]}}]]}}'), ""]
    rows = [(k, "a.example", "https://a.example/x", page(head=h)[0], 200, None) for k, h in enumerate(heads)]
    made = fx.jsonld_facts(fx.page_features(spark.createDataFrame(rows, SCHEMA))).orderBy("page_id").select("n_objects", "n_broken", "types", "has_org", "org_name").collect()
    assert [tuple(r) for r in made] == [
        (1, 0, ["organization"], True, "Deep"),
        (1, 0, ["howto"], False, None),
        (0, 0, [], False, None),
        (0, 1, [], False, None),
        (3, 0, ["article", "organization", "person"], True, "Deep"),
        (0, 0, [], False, None),
    ]


def test_linked_nouns_are_found_in_link_texts(spark):
    nouns = ["Alpha", "Bravo", "Charlie", "Delta Echo", "Foxtrot"]
    body = "<p>" + ". And ".join(nouns) + '.</p><a href="/a">about alphas</a><a href="./b">delta echo</a><a href="https://b.example/">Bravo</a>'
    html, url = page(body=body)
    made = fx.page_features(spark.createDataFrame([(1, "a.example", url, html, 200, None)], SCHEMA)).select("n_nouns", "n_nouns_linked").first()
    assert made.n_nouns_linked == 2 and made.n_nouns >= 5


def test_freshness_reads_the_newest_of_an_entry_listed_again(spark):
    body = lambda d: f"<url><loc>https://a.example/x</loc><lastmod>{d}</lastmod></url><url><loc>https://a.example/y</loc><lastmod>{'2024-06-10' if d < '2024-02' else '2024-01-05'}</lastmod></url>"
    files = spark.createDataFrame([("a.example", "sitemap", body(d)) for d in ("2024-01-05", "2024-06-10")], "host string, kind string, body string").coalesce(1)
    rows = [(k, "a.example", f"https://a.example/{p}", page()[0], 200, None) for k, p in enumerate("xy")]
    pages = spark.createDataFrame(rows, SCHEMA).withColumn("last_modified", F.expr("timestamp'2023-01-01'"))
    got = joined_rules.freshness(rules.rule_inputs(fx.page_features(pages)), site.sitemap_entries(files), "2024-06-15")
    assert not got.where("rule_id in ('F01', 'F02')").collect()  # both pages' newest dates are five days old
