"""Reading the given tables and binding them to the audit's data model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table `name` of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df, dealt evenly over the cores if its scan would keep less than half of them busy.

    A table of a few row groups whose rows are dear to compute, as pages are, would else run on one core. Larger tables stay
    as they are scanned, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if 2 * df.rdd.getNumPartitions() < cores else df


#: Markup put before </head> and before </article>, by page_id, so that every rule has pages that break it and pages
#: that keep it. SQL text that Spark and the comparison engine both run.
HEAD = """'' || case when page_id % 2 = 0 then '<meta name="description" content="A page about ' || page_id || case when page_id % 8 = 0 then repeat(' long words', 20) else '' end || '">' else '' end
 || case when page_id % 3 = 0 then '<meta name="viewport" content="width=device-width">' else '' end
 || case when page_id % 5 = 0 then '<link rel="canonical" href="https://other.example.net/x">' when page_id % 5 = 1 then '<link rel="canonical" href="' || url || '">' when page_id % 5 = 2 then '<link rel="canonical" href="/canonical/' || page_id || '">' else '' end
 || case when page_id % 4 = 0 then '<link rel="icon" href="/favicon.ico">' else '' end
 || case when page_id % 6 = 0 then '<link rel="apple-touch-icon" href="/a.png">' else '' end
 || case when page_id % 3 <> 1 then '<meta property="og:title" content="T"><meta property="og:description" content="D"><meta property="og:url" content="' || url || '"><meta property="og:type" content="' || case when page_id % 2 = 0 then 'article' else 'website' end || '">' else '' end
 || case when page_id % 7 < 4 then '<meta property="og:image" content="' || case when page_id % 7 = 0 then 'data:image/png;base64,xx' else '/i.png' end || '">' else '' end
 || case when page_id % 9 < 5 then '<meta property="og:locale" content="fr_FR"><meta property="og:site_name" content="Brand' || page_id % 3 || ' Site">' else '' end
 || case when page_id % 4 < 2 then '<meta name="twitter:card" content="summary"><meta name="twitter:title" content="T">' else '' end
 || case when page_id % 11 = 0 then '<meta name="robots" content="noindex">' when page_id % 11 = 1 then '<meta name="robots" content="index, nofollow">' else '' end
 || case when page_id % 6 = 1 then '<meta name="author" content="Jo">' else '' end
 || case when page_id % 13 = 0 then '<title>Second title</title>' else '' end
 || case when page_id % 5 < 3 then '<link rel="alternate" hreflang="en" href="' || url || '"><link rel="alternate" hreflang="' || case when page_id % 10 = 0 then 'en' when page_id % 10 = 1 then 'x-default' when page_id % 10 = 2 then 'fr_FR' else 'de' end || '" href="/alt/' || page_id % 4 || '">' else '' end
 || case when page_id % 10 = 3 then '<script src="/block.js"></script>' when page_id % 10 = 4 then '<script src="/ok.js" defer></script>' else '' end
 || case when page_id % 10 = 5 then '<link rel="stylesheet" href="https://cdn.example.org/s.css"><link rel="preload" href="/f.woff2">' when page_id % 10 = 6 then '<link rel="preconnect" href="https://cdn.example.org"><link rel="stylesheet" href="https://cdn.example.org/s.css"><link rel="preload" as="font" href="/f.woff2">' else '' end
 || case when page_id % 4 = 0 then '<script type="application/ld+json">{"@context":"https://schema.org","@graph":[{"@type":"Organization","name":"Brand' || page_id % 3 || '","url":"https://b.example"' || case when page_id % 8 = 0 then ',"logo":"l.png","sameAs":["https://www.wikidata.org/wiki/Q1","https://en.wikipedia.org/wiki/B","https://a.example","https://b.example","https://c.example"]' else ',"sameAs":["https://a.example"]' end || '},{"@type":"WebSite","name":"B"' || case when page_id % 12 = 0 then ',"potentialAction":{"@type":"SearchAction"}' else '' end || '}]}</script>' else '' end
 || case when page_id % 4 = 1 then '<script type="application/ld+json">{"@context":"' || case when page_id % 8 = 1 then 'http' else 'https' end || '://schema.org","@type":["Article","' || case when page_id % 3 = 0 then 'FAQPage' else 'Thing' end || '"],"headline":"H","datePublished":"2024-0' || (1 + page_id % 9) || '-11","author":' || case when page_id % 3 = 1 then '"Jo"' else '{"@type":"Person","name":"Jo"}' end || ',"image":"' || case when page_id % 5 = 0 then '/rel.png' else 'https://i.example/a.png' end || '"}</script>' else '' end
 || case when page_id % 12 = 3 then '<script type="application/ld+json">{"@type": "Person", "name": "Jo"' || case when page_id % 24 = 3 then ', "jobTitle": "Editor", "sameAs": ["https://x.example"]' else '' end || '}</script>' else '' end
 || case when page_id % 16 = 11 then '<script type="application/ld+json">[[{"@graph":[{"@type":"BreadcrumbList"},{"@graph":[[{"@graph":[{"@graph":[{"@graph":[{"@type":"Organization","name":"Deep","url":"https://d.example"}]},{"@type":"Product"}]}]}]]}]}],{"@graph":{"@type":"HowTo"}}]</script>' else '' end
 || case when page_id % 9 = 7 then '<script type="application/ld+json">{broken</script>' else '' end"""

BODY = """'' || case when page_id % 3 = 0 then '<h2>What is it?</h2><p>It is short.</p><h2>Details of use</h2><p>' || repeat('many words ', 40) || '</p><h2>How to start</h2><ul><li>x</li></ul>' else '' end
 || case when page_id % 4 = 1 then '<img src="/a.jpg"><img src="/b.jpg" alt="b" width="1" height="2"><img src="/c.jpg"><img src="/d.jpg" alt=""><img src="/e.jpg" loading="lazy">' when page_id % 4 = 2 then '<img src="/a.webp" alt="a" width="3" height="3">' else '' end
 || case when page_id % 5 = 2 then '<blockquote>Said.</blockquote>' else '' end
 || case when page_id % 6 = 2 then '<a href="https://www.cdc.gov/x">study</a><a href="https://en.wikipedia.org/wiki/X">wiki</a><a href="https://shop.example.org/a" target="_blank">https://shop.example.org/a</a><a href="https://shop.example.org/b" target="_blank" rel="noopener">https://shop.example.org/b</a><a href="https://shop.example.org/c" target="_blank">https://shop.example.org/c</a>' when page_id % 6 = 3 then '<a href="https://p.example/1">one</a><a href="https://p.example/2">two</a><a href="https://p.example/3">three</a><a href="https://p.example/4">read more</a><a href="https://p.example/5">click here</a>' else '' end
 || case when page_id % 7 = 3 then '<a href="/about">About</a><a href="/contact">Contact us</a><a href="/legal">Legal</a><a href="/privacy">Privacy</a><a href="#main">Skip</a>' when page_id % 7 = 4 then '<a href="/pricing">Pricing</a><a href="/x">ici</a><a href="/y">read more</a>' else '' end
 || case when page_id % 8 = 5 then '<a href="#/a">A</a><a href="#/b">B</a><a href="/#/c">C</a>' else '' end
 || case when page_id % 9 = 4 then '<p>Perhaps it works, maybe not. It might be so, it seems to be, perhaps.</p>' else '' end
 || case when page_id % 9 = 5 then '<p>Over 45 % of 1200 clients agree. Reviewed by Jo.</p><time datetime="2024-05-01">May</time>' else '' end
 || case when page_id % 10 = 7 then '<nav><button onclick="a()">a</button><div role="button" onclick="b()">b</div><span onclick="x()">c</span><button>d</button></nav>' else '' end
 || case when page_id % 10 = 8 then '<img src="http://insecure.example/i.png" alt="i">' else '' end"""


#: Markup put before the first <article>: paragraphs outside the main text.
BEFORE = """'' || case when page_id % 6 = 1 then '<div class="menu"><p>Menu one two</p></div>' when page_id % 6 = 4 then '<header><p>Head</p></header><p></p><div><section><p>In a section.</p></section></div>' when page_id % 12 = 3 then '<p> <b>Directly</b> in the body </p>' else '' end"""


#: Some pages move to paths that others link to, some become copies, and some are very long, so that the rules on
#: broken trust pages, alternates, copies and long pages have cases. SQL text for both engines.
URL = """case when page_id % 34 = 0 then regexp_extract(url, '^(https?://[^/]+)', 1) || '/about' when page_id % 13 = 6 then regexp_extract(url, '^(https?://[^/]+)', 1) || '/alt/' || page_id % 4 else url end"""
HTML = """case when page_id % 9 = 8 then '<html><head><title>Copy</title></head><body><p>The same text on many pages.</p></body></html>' when page_id % 14 = 5 then '<html><head></head><body><p>' || repeat('long ', 3000) || '</p></body></html>' when page_id % 14 = 9 then '<html><head></head><body><p>bare</p></body></html>' else html end"""
MARKED = f"replace(replace(replace(html, '</head>', {HEAD} || '</head>'), '<article>', {BEFORE} || '<article>'), '</article>', {BODY} || '</article>')"
HOST = "regexp_extract(url, '^https?://([^/:?#]+)', 1)"


def pages(spark: SparkSession, sf_dir: str, enriched: bool = True) -> DataFrame:
    """page_id, host, url, html, status and last_modified: the pages table, with markup added if enriched.

    Every seventeenth page answers 404 and every nineteenth 301, as the table has no status of its own.
    """
    return bound_pages(spread(table(spark, sf_dir, "pages")), enriched)


def stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of a data folder as a stream of its files."""
    return spark.readStream.schema(table(spark, sf_dir, name).schema).parquet(f"{sf_dir}/{name}.parque[t]")  # a pattern, as a stream reads no single file


def bound_pages(made: DataFrame, enriched: bool = True) -> DataFrame:
    """Rows of the pages table, or of a stream of it, as the audit reads them."""
    if enriched:
        made = made.selectExpr("page_id", f"{URL} as url", f"{HTML} as html")
        made = made.withColumn("html", F.expr(MARKED))
    return made.select(
        "page_id",
        F.lower(F.regexp_extract("url", r"^https?://([^/:?#]+)", 1)).alias("host"),
        "url",
        "html",
        F.expr("case when page_id % 17 = 0 then 404 when page_id % 19 = 0 then 301 else 200 end").alias("status"),
        F.expr("timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, cast(page_id % 200 as int))").alias("last_modified"),
    )


#: The same pages as SQL for the comparison engine.
PAGES_SQL = f"""select page_id, lower({HOST}) as host, url,
 {MARKED} as html,
 case when page_id % 17 = 0 then 404 when page_id % 19 = 0 then 301 else 200 end as status,
 timestamp '2024-01-01 00:00:00' + to_days(cast(page_id % 200 as int)) as last_modified from (select page_id, {URL} as url, {HTML} as html from pages)"""


#: Site files by host, from the lowest page_id k of the host; a sitemap file for each page (a site may have many).
ROBOTS = """case when k % 5 = 0 then null when k % 5 = 1 then 'User-agent: *' || chr(10) || 'Disallow: /' || chr(10)
 when k % 5 = 2 then 'User-agent: GPTBot' || chr(10) || 'User-agent: CCBot # both' || chr(10) || 'Disallow: /' || chr(10) || chr(10) || 'User-agent: *' || chr(10) || 'Disallow: /fr' || chr(10) || 'Sitemap: https://' || host || '/sitemap.xml' || chr(10)
 when k % 5 = 3 then 'user-agent: *' || chr(10) || 'allow: /' || chr(10) || 'User-Agent: Bytespider' || chr(10) || 'User-Agent: YouBot' || chr(10) || 'User-Agent: cohere-ai' || chr(10) || 'Disallow: /' || chr(10)
 else 'User-agent: *' || chr(10) || 'Disallow:' || chr(10) end"""
LLMS = "case when k % 3 = 0 then '# Site' || chr(10) || '> About it' || chr(10) when k % 3 = 1 then 'plain text' end"
LLMS_FULL = "case when k % 6 = 0 then 'everything' end"
SITEMAP = "'<urlset><url><loc>' || url || '</loc>' || case when page_id % 3 < 2 then '<lastmod>2024-0' || cast(1 + page_id % 9 as string) || '-15</lastmod>' else '' end || '</url><url><loc>https://elsewhere.example/x</loc></url><url><loc>https://' || host || '/sub.xml</loc></url></urlset>'"


def site_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """host, kind (robots, sitemap, llms, llms_full) and body; a null body is an absent file."""
    p = table(spark, sf_dir, "pages").select("page_id", "url", F.lower(F.regexp_extract("url", r"^https?://([^/:?#]+)", 1)).alias("host"))
    kinds = [F.struct(F.lit(kind).alias("kind"), F.expr(sql).alias("body")) for kind, sql in (("robots", ROBOTS), ("llms", LLMS), ("llms_full", LLMS_FULL))]
    hosts = p.groupBy("host").agg(F.min("page_id").alias("k")).select("host", F.explode(F.array(*kinds)).alias("x")).select("host", "x.*")
    maps = p.where("page_id % 7 <> 0").select("host", F.lit("sitemap").alias("kind"), F.expr(SITEMAP).alias("body"))
    return hosts.unionByName(maps)


SITE_FILES_SQL = f"""hp as (select page_id, url, lower(regexp_extract(url, '^https?://([^/:?#]+)', 1)) as host from pages),
hk as (select host, min(page_id) as k from hp group by host),
sf as (select host, 'robots' as kind, {ROBOTS} as body from hk union all select host, 'llms', {LLMS} from hk union all select host, 'llms_full', {LLMS_FULL} from hk
 union all select host, 'sitemap', {SITEMAP} from hp where page_id % 7 <> 0)"""


def edges(spark: SparkSession, features: DataFrame) -> DataFrame:
    """Internal links of the pages, and links from a page to those of its host one, two and six ids on.

    The pages of the table link to none of each other, so the link graph needs these.
    """
    from pagelantern.operators import site

    base = features.select("page_id", "host", "path")
    near = base.withColumn("to", F.explode(F.array(F.col("page_id") + 1, F.col("page_id") + 2, F.col("page_id") + 6)))
    far = base.select(F.col("page_id").alias("to"), F.col("host").alias("to_host"), F.col("path").alias("dst_path"))
    made = near.join(far, "to").where("host = to_host and path <> dst_path and page_id % 5 <> 0")
    return site.link_edges(features).unionByName(made.select(F.col("page_id").alias("src_page"), "host", "dst_path")).distinct()
