"""Site-level operators: link graph, groups of pages, site files, and the rules that need more than one page.

Everything is keyed by host; html never reaches a shuffle, only what the features hold.
"""

from __future__ import annotations

import itertools
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagelantern.functions import text, urls

# Crawlers of answer engines; the first three count double.
BOTS = ["gptbot", "claudebot", "perplexitybot", "oai-searchbot", "chatgpt-user", "google-extended", "applebot-extended", "anthropic-ai", "meta-externalagent", "bytespider", "amazonbot", "cohere-ai", "youbot"]
PRIMARY = BOTS[:3]


def sitemap_entries(site_files: DataFrame) -> DataFrame:
    """host, loc and lastmod of every <url> in sitemaps (host, kind, body), without sub-sitemaps and other hosts' pages.

    A location that is listed several times is one entry with its newest date.
    """
    maps = site_files.where("kind = 'sitemap' and body is not null")
    blocks = maps.select("host", F.explode(F.regexp_extract_all("body", F.lit(r"(?is)<url>(.*?)</url>"), F.lit(1))).alias("b"))
    loc = F.trim(F.regexp_extract("b", r"(?is)<loc>\s*(.*?)\s*</loc>", 1))
    rows = blocks.select("host", loc.alias("loc"), text.date(F.regexp_extract("b", r"(?is)<lastmod>\s*(.*?)\s*</lastmod>", 1)).alias("lastmod"))
    rows = rows.where((urls.host(F.col("loc")) == F.col("host")) & ~F.lower("loc").endswith(".xml"))
    return rows.groupBy("host", "loc").agg(F.max("lastmod").alias("lastmod"))


def robots_rules(site_files: DataFrame) -> DataFrame:
    """host, agent, rule (allow or disallow) and path of every robots line, each for every agent of its group.

    Lines are numbered by host; an agent line after a rule starts a group. Comments and case do not matter.
    """
    robots = site_files.where("kind = 'robots' and body is not null")
    lines = robots.select("host", F.posexplode(F.split("body", r"\r?\n")).alias("n", "line"))
    lines = lines.withColumn("line", F.lower(F.trim(F.regexp_replace("line", "#.*$", ""))))
    kind = F.regexp_extract("line", r"^(user-agent|allow|disallow)\s*:", 1)
    lines = lines.withColumns({"kind": kind, "value": F.trim(F.regexp_replace("line", r"^[a-z-]+\s*:", ""))}).where("kind <> ''")
    w = Window.partitionBy("host").orderBy("n")  # a robots file is one row of site_files, bounded by its size
    agent = F.col("kind") == "user-agent"
    lines = lines.withColumn("starts", (agent & (F.coalesce(F.lag("kind").over(w), F.lit("")) != "user-agent")).cast("int"))
    lines = lines.withColumn("g", F.sum("starts").over(w))
    agents = lines.where(agent).select("host", "g", F.col("value").alias("agent"))
    said = lines.where(~agent).select("host", "g", F.col("kind").alias("rule"), F.col("value").alias("path"))
    return agents.join(said, ["host", "g"], "left").select("host", "agent", "rule", "path").distinct()


def blocked_bots(site_files: DataFrame, bots: list[str] = BOTS) -> DataFrame:
    """host and bot for each known crawler that the site keeps out: by its own group if it has one, else by `*`."""
    rules = robots_rules(site_files)
    whole = rules.groupBy("host", "agent").agg(F.bool_or((F.col("rule") == "disallow") & (F.col("path") == "/")).alias("closed"))
    hosts = whole.select("host").distinct().withColumn("bot", F.explode(F.lit(bots)))
    own = whole.withColumnsRenamed({"agent": "bot", "closed": "own"})
    rest = whole.where("agent = '*'").select("host", F.col("closed").alias("all"))
    out = hosts.join(own, ["host", "bot"], "left").join(rest, "host", "left")
    return out.where(F.coalesce("own", "all", F.lit(False))).select("host", "bot")


def bot_penalty(site_files: DataFrame) -> DataFrame:
    """host, blocked, points and severity of the answer-engine crawler rule: 2 for a main crawler, 1 for others, 6 at most."""
    main = F.count_if(F.col("bot").isin(PRIMARY))
    out = blocked_bots(site_files).groupBy("host").agg(F.count("*").alias("blocked"), main.alias("main"))
    points = F.least(F.lit(6), F.col("blocked") + F.col("main")).cast("double")
    severity = F.when(F.col("main") > 0, "critical").when(F.col("blocked") >= 3, "high").otherwise("medium")
    return out.select("host", "blocked", points.alias("points"), severity.alias("severity"))


def disallowed(paths: DataFrame, site_files: DataFrame) -> DataFrame:
    """paths (host, path) that robots' `*` group forbids by prefix; the rules are few for each host and joined by it."""
    rules = robots_rules(site_files).where("agent = '*' and rule = 'disallow' and path <> ''").select("host", F.col("path").alias("prefix"))
    return paths.join(rules, "host").where(F.col("path").startswith(F.col("prefix"))).select("host", "path").distinct()


def link_edges(features: DataFrame) -> DataFrame:
    """src_page, host and dst_path of internal links, distinct, without links of a page to itself."""
    links = features.select(F.col("page_id").alias("src_page"), "host", "path", F.explode("dst_paths").alias("dst_path"))
    return links.where("dst_path <> path").select("src_page", "host", "dst_path").distinct()


def frontier(edges: DataFrame, site_files: DataFrame) -> DataFrame:
    """The edges that a crawl may follow: to no asset, and to no path that robots' `*` group forbids."""
    worth = edges.where(urls.crawlable(F.col("dst_path")))
    barred = disallowed(worth.select("host", F.col("dst_path").alias("path")).distinct(), site_files)
    return worth.join(barred.withColumnRenamed("path", "dst_path"), ["host", "dst_path"], "left_anti")


def inbound_counts(pages: DataFrame, edges: DataFrame) -> DataFrame:
    """page_id, host, path and inbound (distinct pages that link to it, zero if none)."""
    counts = edges.groupBy("host", F.col("dst_path").alias("path")).agg(F.count("*").alias("inbound"))
    return pages.join(counts, ["host", "path"], "left").select("page_id", "host", "path", F.coalesce("inbound", F.lit(0)).alias("inbound"))


def orphan_pages(pages: DataFrame, edges: DataFrame) -> DataFrame:
    """Pages that no other page of the host links to; home pages are none."""
    linked = edges.select("host", F.col("dst_path").alias("path"))
    return pages.where("path <> '/'").join(linked, ["host", "path"], "left_anti").select("page_id", "host", "path")


def broken_links(pages: DataFrame, edges: DataFrame) -> DataFrame:
    """host, src_page, dst_path and status of links to pages that answer 3xx, 4xx or 5xx.

    Where several pages have a path, a link to it leads to each status that they answer with.
    """
    bad = pages.where("status >= 300").select("host", F.col("path").alias("dst_path"), "status").distinct()
    return edges.join(bad, ["host", "dst_path"]).select("host", "src_page", "dst_path", "status")


def clusters(counts: DataFrame, least: int = 4) -> DataFrame:
    """host, cluster (first path segment), pages, inbound and top_share (of the best linked page), of pages of depth 2 or more."""
    parts = F.filter(F.split("path", "/"), lambda s: s != "")
    rows = counts.withColumn("parts", parts).where(F.size("parts") >= 2).withColumn("cluster", F.get("parts", 0))
    out = rows.groupBy("host", "cluster").agg(F.count("*").alias("pages"), F.sum("inbound").alias("inbound"), F.max("inbound").alias("top"))
    share = F.round(F.col("top") / F.nullif(F.col("inbound"), F.lit(0)), 4)
    return out.where(F.col("pages") >= least).select("host", "cluster", "pages", "inbound", share.alias("top_share"))


def cluster_samples(pages: DataFrame, least: int = 4, k: int = 5) -> DataFrame:
    """host, cluster, pages and sample (the k first paths) of clusters; a cluster's paths are cut to k before they are joined."""
    deep = pages.where(F.size(F.filter(F.split("path", "/"), lambda s: s != "")) >= 2).select("host", first_segment(F.col("path")).alias("cluster"), "path")
    w = Window.partitionBy("host", "cluster")
    placed = deep.withColumns({"pages": F.count("*").over(w), "at": F.row_number().over(w.orderBy("path"))}).where((F.col("pages") >= least) & (F.col("at") <= k))
    return placed.groupBy("host", "cluster", "pages").agg(F.array_join(F.array_sort(F.collect_list("path")), " ").alias("sample"))


def capped_pages(pages: DataFrame, caps: dict[str, int]) -> DataFrame:
    """mode, host, page_id and place: the pages of a host that an audit of a mode takes, by page_id, up to the mode's cap."""
    most = F.col("place") <= F.try_element_at(F.create_map(*(F.lit(x) for kv in caps.items() for x in kv)), F.col("mode"))
    placed = pages.withColumn("place", F.row_number().over(Window.partitionBy("host").orderBy("page_id"))).where(F.col("place") <= max(caps.values()))
    return placed.withColumn("mode", F.explode(F.lit(list(caps)))).where(most).select("mode", "host", "page_id", "place")


def homes(pages: DataFrame) -> DataFrame:
    """host and page_id of each host's home: the page with path /, else the lowest page_id."""
    return pages.groupBy("host").agg(F.min_by("page_id", F.struct((F.col("path") != "/").cast("int"), "page_id")).alias("page_id"))


def first_segment(path: Column) -> Column:
    return F.get(F.filter(F.split(path, "/"), lambda s: s != ""), 0)


def cluster_coverage(pages: DataFrame, edges: DataFrame, least: int = 4) -> DataFrame:
    """host, clusters and how many of them the home links into, by first path segment."""
    deep = pages.where(F.size(F.filter(F.split("path", "/"), lambda s: s != "")) >= 2)
    found = deep.groupBy("host", first_segment(F.col("path")).alias("cluster")).count().where(F.col("count") >= least)
    home = homes(pages).select("host", F.col("page_id").alias("src_page"))
    linked = edges.join(home, ["host", "src_page"], "left_semi").select("host", first_segment(F.col("dst_path")).alias("cluster"), F.lit(1).alias("hit")).distinct()
    return found.join(linked, ["host", "cluster"], "left").groupBy("host").agg(F.count("*").alias("clusters"), F.count("hit").alias("linked"))


def pillars(pages: DataFrame, edges: DataFrame, least_words: int = 3000) -> DataFrame:
    """host, pillars (long pages) and isolated: no page links to any of them."""
    counts = inbound_counts(pages, edges).select("page_id", "inbound")
    long = pages.where(F.col("words") >= least_words).join(counts, "page_id")
    return long.groupBy("host").agg(F.count("*").alias("pillars"), F.bool_and(F.col("inbound") == 0).alias("isolated"))


def trust_broken(pages: DataFrame) -> DataFrame:
    """page_id, dst_path and status of links to about, contact, legal or privacy pages that answer 400 or more."""
    words = "about|a-propos|qui-sommes|equipe|contact|mentions|legal|privacy|confidentialite"
    links = pages.select("page_id", "host", "url", F.explode("links").alias("a")).where(F.lower(F.concat_ws(" ", "a.href", "a.text")).rlike(words))
    links = links.select("page_id", "host", urls.internal_path(F.col("a.href"), F.col("url")).alias("dst_path")).distinct()
    bad = pages.where("status >= 400").groupBy("host", F.col("path").alias("dst_path")).agg(F.max("status").alias("status"))
    return links.join(bad, ["host", "dst_path"]).select("page_id", "dst_path", "status")


def repeated(features: DataFrame, column: Column, least_pages: int = 5, least: int = 3) -> DataFrame:
    """host, value and n of what `least` or more pages of a host share, on hosts of more than `least_pages` pages."""
    counts = features.select("host", column.alias("value")).where("value is not null and value <> ''").groupBy("host", "value").count()
    big = features.groupBy("host").count().where(F.col("count") > least_pages).select("host")
    return counts.where(F.col("count") >= least).join(big, "host", "left_semi").select("host", "value", F.col("count").alias("n"))


def hreflang_asymmetric(features: DataFrame) -> DataFrame:
    """host, src_path, dst_path of alternates in the corpus that do not link back."""
    alt = features.select("host", "path", "url", F.explode("hreflangs").alias("x")).where("lower(x.lang) <> 'x-default'").select("host", "path", "url", "x.href")
    alt = alt.withColumn("full", urls.resolve(F.col("href"), F.col("url")))
    edges = alt.select("host", F.col("path").alias("src"), urls.host(F.col("full")).alias("dst_host"), urls.path(F.col("full")).alias("dst")).where("dst_host = host and src <> dst").select("host", "src", "dst").distinct()
    known = features.select("host", F.col("path").alias("dst")).distinct()
    back = edges.select("host", F.col("src").alias("dst"), F.col("dst").alias("src"))
    return edges.join(known, ["host", "dst"], "left_semi").join(back, ["host", "src", "dst"], "left_anti").select("host", F.col("src").alias("src_path"), F.col("dst").alias("dst_path"))


def host_facts(inputs: DataFrame) -> DataFrame:
    """What site rules ask of a host's pages: counts and shares, one row a host."""
    return inputs.groupBy("host").agg(
        F.count("*").alias("pages"),
        F.count_if(F.col("words") < 300).alias("thin"),
        F.count_if(F.col("robots").contains("noindex")).alias("noindex"),
        F.count_if("has_breadcrumb").alias("breadcrumb"),
        F.count_if(F.col("status").between(300, 399)).alias("redirects"),
        F.count_if(F.col("status") >= 400).alias("errors"),
    )


def page_link_findings(pages: DataFrame, broken_trust: DataFrame, asymmetric: DataFrame) -> DataFrame:
    """page_id, rule_id, phase, severity, points and n of the page rules that need other pages: E09 and I09.

    pages: page_id, host, path; broken_trust: trust_broken; asymmetric: hreflang_asymmetric.
    """
    trust = broken_trust.groupBy("page_id").agg(F.count("*").alias("n"))
    trust = trust.select("page_id", F.lit("E09").alias("rule_id"), F.lit("eeat").alias("phase"), F.lit("high").alias("severity"), F.lit(1.0).alias("points"), "n")
    alone = asymmetric.groupBy("host", F.col("src_path").alias("path")).agg(F.count("*").alias("n")).join(pages.select("page_id", "host", "path"), ["host", "path"])
    alone = alone.select("page_id", F.lit("I09").alias("rule_id"), F.lit("international").alias("phase"), F.lit("high").alias("severity"), F.lit(2.0).alias("points"), "n")
    return trust.unionByName(alone)


def sitemap_ages(entries: DataFrame, as_of: str, days: int = 180) -> DataFrame:
    """host, listed, dated and recent: the entries of a host's sitemaps, those with a date, and those of the last `days`."""
    recent = F.col("lastmod") >= F.expr(f"timestamp'{as_of}' - interval {days} days")
    return entries.groupBy("host").agg(F.count("*").alias("listed"), F.count("lastmod").alias("dated"), F.count_if(recent).alias("recent"))


def site_findings(pages: DataFrame, edges: DataFrame, files: DataFrame, as_of: str) -> DataFrame:
    """host, rule_id, phase, severity, points of the site rules.

    pages: page_id, host, path, status, title, h1_count, words, robots, has_breadcrumb, content_hash; edges: link_edges;
    files: host, kind, body, of which a host may have many of a kind. Every part is one row a host before they meet.
    """
    has = lambda kind, test: F.bool_or((F.col("kind") == kind) & F.expr(test))
    kinds = files.where("body is not null").groupBy("host").agg(
        *(has(k, "true").alias(k) for k in ("robots", "sitemap", "llms_full")),
        has("robots", r"body rlike r'(?i)user-agent:\s*\*\s*\n(allow:[^\n]*\n)*disallow:\s*/\s*(\n|$)'").alias("robots_closed"),
        has("robots", r"body rlike r'(?im)^\s*sitemap\s*:'").alias("robots_map"),
        has("sitemap", r"body rlike r'(?i)<url>|<sitemap>'").alias("sitemap_filled"),
        has("llms", "body <> ''").alias("llms"),
        has("llms", r"body rlike r'(?m)^# ' and body rlike r'(?m)^> '").alias("llms_formed"),
    )
    lonely = orphan_pages(pages, edges)
    bare = pages.select("page_id", ((F.col("title") == "") & (F.col("h1_count") == 0)).alias("bare"))
    lonely = lonely.join(bare, "page_id").groupBy("host").agg(F.count("*").alias("orphans"), F.count_if("bare").alias("bare_orphans"))
    flat = clusters(inbound_counts(pages, edges)).where("inbound > 0").groupBy("host").agg(F.count_if(F.col("top_share") < 0.3).alias("flat"))
    penalties = bot_penalty(files).select("host", F.col("points").alias("bot_points"), F.col("severity").alias("bot_severity"))
    same = repeated(pages, F.lower("title")).groupBy("host").agg(F.max("n").alias("same_title"))
    copied = repeated(pages, F.col("content_hash")).groupBy("host").agg(F.max("n").alias("same_text"))
    wide = host_facts(pages)
    for part in (kinds, penalties, lonely, same, copied, flat, pillars(pages, edges), cluster_coverage(pages, edges), sitemap_ages(sitemap_entries(files), as_of)):
        wide = wide.join(part, "host", "left")
    wide = wide.na.fill(False, ["robots", "sitemap", "llms", "llms_full", "robots_closed", "robots_map", "sitemap_filled", "llms_formed"])
    rules = [
        ("T20", "technical", "'medium'", "1", "not robots"),
        ("T21", "technical", "'critical'", "3", "robots_closed"),
        ("T22", "technical", "'low'", "0.5", "robots and sitemap and not robots_map"),
        ("T23", "technical", "'medium'", "1", "pages > 1 and noindex > 0"),
        ("T24", "technical", "'medium'", "2", "not sitemap"),
        ("T25", "technical", "'low'", "1", "sitemap and not sitemap_filled"),
        ("S17", "structured_data", "'low'", "0.5", "pages > 10 and breadcrumb < 0.5 * pages"),
        ("G01", "geo", "'high'", "4", "not llms"),
        ("G02", "geo", "'low'", "1", "llms and not llms_formed"),
        ("G03", "geo", "bot_severity", "bot_points", "bot_points > 0"),
        ("G14", "geo", "'info'", "0", "llms and not llms_full"),
        ("F04", "freshness", "'medium'", "1", "listed >= 10 and dated >= 5 and recent < 0.3 * dated"),
        ("F05", "freshness", "'low'", "1", "same_text >= 3"),
        ("O06", "topical", "'info'", "0", "pages > 50"),
        ("O07", "topical", "'medium'", "1", "pages > 5 and orphans >= 0.2 * pages"),
        ("O08", "topical", "'medium'", "1", "pages > 5 and thin >= 0.5 * pages"),
        ("O09", "topical", "'medium'", "0.5", "isolated"),
        ("O10", "topical", "'low'", "0", "bare_orphans >= 3"),
        ("O11", "topical", "'low'", "0.5", "flat > 0"),
        ("O12", "topical", "'low'", "0.5", "clusters >= 2 and linked < 0.5 * clusters"),
        ("C11", "common_mistakes", "'medium'", "0.5", "same_title >= 3"),
    ]
    made = [F.expr(f"case when {when} then named_struct('rule_id', '{i}', 'phase', '{p}', 'severity', {s}, 'points', cast({pts} as double)) end") for i, p, s, pts, when in rules]
    return wide.select("host", F.explode(F.array_compact(F.array(*made))).alias("f")).select("host", "f.*")


def reachable(pages: DataFrame, edges: DataFrame, cut, most: int | None = None) -> DataFrame:
    """page_id and depth of all pages that links reach from each host's home, breadth first, at any depth.

    The home is the page with path /, else the lowest page_id of the host. most: at most so many pages of a host, in the order
    of depth, then page_id; a host that has them is followed no further. cut: writes a frame and returns it without its lineage.

    Each round adds pages or is the last, and writes only the pages that it adds: those seen are the fronts so far.
    """
    known = pages.select("page_id", "host", "path")
    hops = cut(edges.join(known.select("host", F.col("path").alias("dst_path"), F.col("page_id").alias("dst")), ["host", "dst_path"]).select("src_page", "dst", "host").distinct())
    fronts = [cut(homes(pages).select("page_id", "host", F.lit(0).alias("depth")))]
    for depth in itertools.count(1):
        seen = reduce(DataFrame.unionByName, fronts)
        step = fronts[-1].select(F.col("page_id").alias("src_page")).join(hops, "src_page").select(F.col("dst").alias("page_id"), "host").distinct()
        step = step.join(seen.select("page_id"), "page_id", "left_anti")
        if most is not None:
            place = F.row_number().over(Window.partitionBy("host").orderBy("page_id"))
            left = seen.groupBy("host").agg((F.lit(most) - F.count("*")).alias("left"))
            step = step.withColumn("place", place).where(F.col("place") <= most).join(left, "host").where(F.col("place") <= F.col("left"))
        front = cut(step.select("page_id", "host", F.lit(depth).alias("depth")))
        if front.isEmpty():
            return seen.select("page_id", "depth")
        fronts.append(front)
