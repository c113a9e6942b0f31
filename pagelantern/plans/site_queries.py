"""Named queries over sites: files, link graph, groups of pages and site rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelantern.operators import site
from pagelantern.operators.checkpoint import cut
from pagelantern.plans import page_queries, page_sql
from pagelantern.sources import tables
from pagelantern.sources.tables import SITE_FILES_SQL


AS_OF = "2024-12-01"
SLIM = ["page_id", "host", "url", "path", "status", "title", "h1_count", "content_hash", "words", "robots", "has_breadcrumb", "dst_paths"]


def _slim(spark, sf_dir):
    """What rules over several pages need: html is read once, written slim, and never read again."""
    return cut(page_queries.inputs(spark, sf_dir).select(*SLIM))


def _graph(made):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        pages = _slim(spark, sf_dir)
        return made(pages, tables.edges(spark, pages))

    return query


def _linked(made, *columns):
    """Queries over the features themselves: the columns named besides those of a page's place."""
    return lambda s, d: made(cut(page_queries.features(s, d).select("page_id", "host", "url", "path", "status", *columns)))


def _site_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, files = _slim(spark, sf_dir), cut(tables.site_files(spark, sf_dir))
    return site.site_findings(pages, tables.edges(spark, pages), files, AS_OF)


def _reachable(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, files = _slim(spark, sf_dir), tables.site_files(spark, sf_dir)
    return site.reachable(pages, site.frontier(tables.edges(spark, pages), files), cut)


QUERIES = {
    "sitemap_entries": lambda s, d: site.sitemap_entries(tables.site_files(s, d)),
    "robots_rules": lambda s, d: site.robots_rules(tables.site_files(s, d)),
    "robots_bots": lambda s, d: site.blocked_bots(tables.site_files(s, d)),
    "bot_penalty": lambda s, d: site.bot_penalty(tables.site_files(s, d)),
    "robots_disallowed": lambda s, d: site.disallowed(_slim(s, d).select("host", "path"), tables.site_files(s, d)),
    "link_edges": _graph(lambda p, e: e),
    "inbound_links": _graph(site.inbound_counts),
    "orphans": _graph(site.orphan_pages),
    "broken_links": _graph(site.broken_links),
    "link_reachability": _reachable,
    "cluster_coverage": _graph(site.cluster_coverage),
    "pillars": _graph(site.pillars),
    "trust_broken": _linked(site.trust_broken, "links"),
    "clusters": _graph(lambda p, e: site.clusters(site.inbound_counts(p, e))),
    "dup_titles": lambda s, d: site.repeated(_slim(s, d), F.lower("title"), least=2),
    "dup_content": lambda s, d: site.repeated(_slim(s, d), F.col("content_hash"), least=2),
    "hreflang_asymmetric": _linked(site.hreflang_asymmetric, "hreflangs"),
    "rules_page_links": _linked(lambda p: site.page_link_findings(p, site.trust_broken(p), site.hreflang_asymmetric(p)), "links", "hreflangs"),
    "sitemap_ages": lambda s, d: site.sitemap_ages(site.sitemap_entries(tables.site_files(s, d)), AS_OF),
    "host_facts": lambda s, d: site.host_facts(page_queries.inputs(s, d)),
    "rules_site": _site_rules,
}

_EDGES = f"""l as (select page_id, host, url, path, unnest(links).href as href from f),
l2 as (select page_id, host, path, {page_sql.internal_path('href')} as dst_path from l),
e as (select distinct page_id as src_page, host, dst_path from l2 where dst_path is not null and dst_path <> path
 union select a.page_id, a.host, b.path from f a join f b on a.host = b.host and b.page_id - a.page_id in (1, 2, 6) and a.path <> b.path and a.page_id % 5 <> 0),
ic as (select f.page_id, f.host, f.path, (select count(*) from e where e.host = f.host and e.dst_path = f.path) as inbound from f)"""
_F = f"with {page_sql.FEATURES}, {_EDGES} "
_REPEAT = "select host, {0} as value, count(*) as n from f where {0} <> '' and host in (select host from f group by host having count(*) > 5) group by host, {0} having count(*) >= {1}"
_ROBOTS = f"""{SITE_FILES_SQL},
rl as (select host, unnest(list_transform(range(1, len(string_split(body, chr(10))) + 1), lambda n: {{'n': n, 'line': lower(trim(regexp_replace(string_split(body, chr(10))[n], '#.*$', '')))}}), recursive := true) from sf where kind = 'robots' and body is not null),
rk as (select host, n, regexp_extract(line, '^(user-agent|allow|disallow)\\s*:', 1) as kind, trim(regexp_replace(line, '^[a-z-]+\\s*:', '')) as value from rl),
rg as (select *, case when kind = 'user-agent' and coalesce(lag(kind) over (partition by host order by n), '') <> 'user-agent' then 1 else 0 end as starts from rk where kind <> ''),
rh as (select *, sum(starts) over (partition by host order by n) as g from rg),
rr as (select distinct a.host, a.value as agent, s.kind as rule, s.value as path from rh a left join rh s on a.host = s.host and a.g = s.g and s.kind <> 'user-agent' where a.kind = 'user-agent'),
rw as (select host, agent, bool_or(rule = 'disallow' and path = '/') as closed from rr group by host, agent),
bb as (select h.host, b.bot from (select distinct host from rw) h, (select unnest([{', '.join(f"'{b}'" for b in site.BOTS)}]) as bot) b
 left join rw o on o.host = h.host and o.agent = b.bot left join rw r on r.host = h.host and r.agent = '*' where coalesce(o.closed, r.closed, false)),
bp as (select host, count(*) as blocked, cast(least(6, count(*) + count(*) filter (bot in ('gptbot', 'claudebot', 'perplexitybot'))) as double) as points,
 case when count(*) filter (bot in ('gptbot', 'claudebot', 'perplexitybot')) > 0 then 'critical' when count(*) >= 3 then 'high' else 'medium' end as severity from bb group by host)"""
_HOST = "select host, count(*) as pages, count(*) filter (words < 300) as thin, count(*) filter (robots like '%noindex%') as noindex, count(*) filter (has_breadcrumb) as breadcrumb, count(*) filter (status between 300 and 399) as redirects, count(*) filter (status >= 400) as errors from i group by host"
_ORPHAN = "select page_id, host, path from ic where inbound = 0 and path <> '/'"
_SITE_RULES = [
    ("T20", "technical", "'medium'", "1", "robots is null"),
    ("T21", "technical", "'critical'", "3", "regexp_matches(robots, '(?i)user-agent:\\s*\\*\\s*\\n(allow:[^\\n]*\\n)*disallow:\\s*/\\s*(\\n|$)')"),
    ("T22", "technical", "'low'", "0.5", "robots is not null and maps > 0 and not regexp_matches(robots, '(?im)^\\s*sitemap\\s*:')"),
    ("T23", "technical", "'medium'", "1", "pages > 1 and noindex > 0"),
    ("T24", "technical", "'medium'", "2", "coalesce(maps, 0) = 0"),
    ("T25", "technical", "'low'", "1", "maps > 0 and maps_filled = 0"),
    ("S17", "structured_data", "'low'", "0.5", "pages > 10 and breadcrumb < 0.5 * pages"),
    ("G01", "geo", "'high'", "4", "coalesce(llms, '') = ''"),
    ("G02", "geo", "'low'", "1", "llms <> '' and not (regexp_matches(llms, '(?m)^# ') and regexp_matches(llms, '(?m)^> '))"),
    ("G03", "geo", "bot_severity", "bot_points", "bot_points > 0"),
    ("G14", "geo", "'info'", "0", "llms <> '' and llms_full is null"),
    ("F04", "freshness", "'medium'", "1", "listed >= 10 and dated >= 5 and recent / dated < 0.3"),
    ("F05", "freshness", "'low'", "1", "same_text >= 3"),
    ("O06", "topical", "'info'", "0", "pages > 50"),
    ("O07", "topical", "'medium'", "1", "pages > 5 and orphans >= 0.2 * pages"),
    ("O08", "topical", "'medium'", "1", "pages > 5 and thin >= 0.5 * pages"),
    ("O09", "topical", "'medium'", "0.5", "pillars > 0 and pillars_linked = 0"),
    ("O10", "topical", "'low'", "0", "bare_orphans >= 3"),
    ("O11", "topical", "'low'", "0.5", "flat >= 1"),
    ("O12", "topical", "'low'", "0.5", "clusters >= 2 and linked / clusters < 0.5"),
    ("C11", "common_mistakes", "'medium'", "0.5", "same_title >= 3"),
]
_CLUSTERS = """hm as (select host, arg_min(page_id, (case when path = '/' then 0 else 1 end) * 1000000000000 + page_id) as page_id from f group by host),
      cl as (select host, string_split(path, '/')[2] as cluster from f where len(string_split(path, '/')) >= 3 group by all having count(*) >= 4),
      lk as (select distinct e.host, string_split(dst_path, '/')[2] as cluster from e join hm on e.host = hm.host and e.src_page = hm.page_id),
      cc as (select cl.host, count(*) as clusters, count(lk.cluster) as linked from cl left join lk on cl.host = lk.host and cl.cluster = lk.cluster group by cl.host)"""
_MAP_ENTRIES = f"""sb as (select host, unnest(regexp_extract_all(body, '(?is)<url>(.*?)</url>', 1)) as b from sf where kind = 'sitemap'),
      se as (select host, trim(regexp_extract(b, '(?is)<loc>\\s*(.*?)\\s*</loc>', 1)) as loc, try_cast(regexp_extract(b, '(?is)<lastmod>\\s*(\\d{{4}}.*?)\\s*</lastmod>', 1) as timestamp) as lastmod from sb),
      sg as (select host, loc, max(lastmod) as lastmod from se where {page_sql.host('loc')} = host and lower(loc) not like '%.xml' group by host, loc),
      sa as (select host, count(*) as listed, count(lastmod) as dated, count(*) filter (lastmod >= timestamp '{AS_OF}' - interval 180 day) as recent from sg group by host)"""
_SITE = f"""with {page_sql.FEATURES}, {_EDGES}, {page_sql.FACTS}, {page_sql.INPUTS}, {_ROBOTS}, {_CLUSTERS}, {_MAP_ENTRIES}, hf as ({_HOST}),
kd as (select host, {', '.join(f"max(body) filter (kind = '{k}') as {k}" for k in ('robots', 'llms', 'llms_full'))}, count(body) filter (kind = 'sitemap') as maps, count(*) filter (kind = 'sitemap' and regexp_matches(body, '(?i)<url>|<sitemap>')) as maps_filled from sf group by host),
ox as (select ic.host, count(*) as orphans, count(*) filter (f.title = '' and f.h1_count = 0) as bare_orphans from ic join f using (page_id) where ic.inbound = 0 and ic.path <> '/' group by ic.host),
fl as (select host, count(*) filter (top < 0.3 * total) as flat from (select host, max(inbound) as top, sum(inbound) as total from ic where len(string_split(path, '/')) >= 3 group by host, string_split(path, '/')[2] having count(*) >= 4 and sum(inbound) > 0) group by host),
pl as (select f.host, count(*) as pillars, count(*) filter (ic.inbound > 0) as pillars_linked from f join ic using (page_id) where f.words >= 3000 group by f.host),
wd as (select hf.*, kd.* exclude (host), bp.points as bot_points, bp.severity as bot_severity, orphans, bare_orphans, flat, pillars, pillars_linked, clusters, linked, listed, dated, recent,
 (select max(n) from ({_REPEAT.format('lower(title)', 3)}) x where x.host = hf.host) as same_title,
 (select max(n) from ({_REPEAT.format('content_hash', 3)}) x where x.host = hf.host) as same_text
 from hf left join kd using (host) left join bp using (host) left join ox using (host) left join fl using (host) left join pl using (host) left join cc using (host) left join sa using (host))
""" + " union all ".join(f"select host, '{i}' as rule_id, '{p}' as phase, {s} as severity, cast({pts} as double) as points from wd where {when}" for i, p, s, pts, when in _SITE_RULES)

_TRUST = f"""{page_sql.FEATURES}, tl as (select page_id, host, url, unnest(links, recursive := true) from f), tt as (select distinct page_id, host, {page_sql.internal_path('href')} as dst from tl where regexp_matches(lower(href) || ' ' || text, 'about|a-propos|qui-sommes|equipe|contact|mentions|legal|privacy|confidentialite')),
      tb as (select tt.page_id, tt.dst as dst_path, max(f.status) as status from tt join f on f.host = tt.host and f.path = tt.dst where f.status >= 400 group by all)"""
_ASYM = f"""ah as (select host, path, url, unnest(hreflangs) as x from f), al as (select host, path, url, x.href as href from ah where lower(x.lang) <> 'x-default'),
      ae as (select distinct host, path as src, {page_sql.path(page_sql.resolve('href'))} as dst from al where {page_sql.host(page_sql.resolve('href'))} = host),
      ax as (select a.host, a.src as src_path, a.dst as dst_path from ae a where a.src <> a.dst and exists (select 1 from f where f.host = a.host and f.path = a.dst)
      and not exists (select 1 from ae b where b.host = a.host and b.src = a.dst and b.dst = a.src))"""
SQL = {
    "sitemap_entries": f"with {SITE_FILES_SQL}, {_MAP_ENTRIES} select * from sg",
    "sitemap_ages": f"with {SITE_FILES_SQL}, {_MAP_ENTRIES} select * from sa",
    "robots_rules": f"with {_ROBOTS} select * from rr",
    "robots_bots": f"with {_ROBOTS} select * from bb",
    "bot_penalty": f"with {_ROBOTS} select * from bp",
    "robots_disallowed": f"with {page_sql.FEATURES}, {_ROBOTS} select distinct f.host, f.path from f join rr on f.host = rr.host and rr.agent = '*' and rr.rule = 'disallow' and rr.path <> '' where starts_with(f.path, rr.path)",
    "link_edges": _F + "select * from e",
    "inbound_links": _F + "select * from ic",
    "orphans": _F + _ORPHAN,
    "broken_links": _F + "select distinct e.host, e.src_page, e.dst_path, f.status from e join f on e.host = f.host and e.dst_path = f.path where f.status >= 300",
    "link_reachability": f"with recursive {page_sql.FEATURES}, {_EDGES}, {_ROBOTS}" + """, hm as (select host, arg_min(page_id, (case when path = '/' then 0 else 1 end) * 1000000000000 + page_id) as page_id from f group by host),
      ok as (select * from e where not regexp_matches(dst_path, '(?i)\\.(png|jpe?g|gif|svg|webp|avif|ico|css|js|pdf|zip|mp4|mp3|woff2?|ttf|xml|json)([?#]|$)') and not exists (select 1 from rr where rr.host = e.host and rr.agent = '*' and rr.rule = 'disallow' and rr.path <> '' and starts_with(e.dst_path, rr.path))),
      hop as (select distinct ok.src_page, f.page_id as dst from ok join f on ok.host = f.host and ok.dst_path = f.path),
      rc as (select page_id, 0 as depth from hm union select hop.dst, depth + 1 from rc join hop on hop.src_page = rc.page_id where depth < 60)
      select page_id, min(depth) as depth from rc group by page_id""",
    "cluster_coverage": _F + f", {_CLUSTERS} select * from cc",
    "pillars": _F + "select f.host, count(*) as pillars, bool_and(ic.inbound = 0) as isolated from f join ic on f.page_id = ic.page_id where f.words >= 3000 group by f.host",
    "trust_broken": "with " + _TRUST + " select * from tb",
    "clusters": _F + "select host, string_split(path, '/')[2] as cluster, count(*) as pages, cast(sum(inbound) as bigint) as inbound, round(max(inbound) / nullif(sum(inbound), 0), 4) as top_share from ic where len(string_split(path, '/')) >= 3 group by all having count(*) >= 4",
    "dup_titles": f"with {page_sql.FEATURES} {_REPEAT.format('lower(title)', 2)}",
    "dup_content": f"with {page_sql.FEATURES} {_REPEAT.format('content_hash', 2)}",
    "hreflang_asymmetric": f"with {page_sql.FEATURES}, {_ASYM} select * from ax",
    "rules_page_links": "with " + _TRUST + ", " + _ASYM + """ select page_id, 'E09' as rule_id, 'eeat' as phase, 'high' as severity, 1.0::double as points, count(*) as n from tb group by page_id
      union all select f.page_id, 'I09', 'international', 'high', 2.0::double, count(*) from ax join f on f.host = ax.host and f.path = ax.src_path group by f.page_id""",
    "host_facts": f"with {page_sql.FEATURES}, {page_sql.FACTS}, {page_sql.INPUTS} {_HOST}",
    "rules_site": _SITE,
}
