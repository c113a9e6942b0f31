"""Named queries: rules over two tables, citations, texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagelantern.functions import text, urls
from pagelantern.operators import citations, history, joined_rules, sinks, site
from pagelantern.plans import page_queries, page_sql, site_queries
from pagelantern.sources import features as fx
from pagelantern.sources import history as src
from pagelantern.sources import tables

AS_OF = "2024-06-15"
JSON = """concat('{"record":{"metrics":{"largest_contentful_paint":{"percentiles":{"p75":"', cast(1500 + page_id % 40 * 100 as string), '"}}', case when page_id % 4 = 0 then '' else concat(',"interaction_to_next_paint":{"percentiles":{"p75":', cast(100 + page_id % 9 * 60 as string), '}}') end, ',"cumulative_layout_shift":{"percentiles":{"p75":"0.', cast(page_id % 4 as string), '"}}}}}')"""
CATALOG = "('brand1', 'Q1', 2), ('brand1', 'Q9', 1), ('brand2', 'Q2', 1)"
HOOK_EVENTS = "case s_suppkey % 3 when 0 then 'audit.completed' when 1 then 'audit.failed, audit.completed' else 'other' end"
SITES = "case when conv_id % 3 = 0 then ' See https://www.alpha.example/x?y=1 and http://beta.example.' when conv_id % 3 = 1 then ' Per alpha.example, and https://gamma.example:8080/z' else ' See notalpha.example for more' end"
RAW = f"""'{{"output":[{{"type":"message","content":[{{"text":"Answer ' || cast(conv_id as string) || {SITES} || '","annotations":[{{"url":"https://delta.example/' || cast(turn as string) || '"}}]}}]}},{{"type":"search","results":[{{"url":"https://Alpha.example/s"}}]}}]}}'"""


#: The texts with terms in every kind of place.
CASED = """text || ' google, Open AI (json-ld) `seo html` <code>lcp</code> see https://google.com/seo/geo. i.a. HTTP and https' || chr(10) || 'googlebot;ai overview' """


def _metrics(s, d):
    pages = tables.table(s, d, "pages").where("page_id % 6 <> 0")
    return joined_rules.worst_metrics(joined_rules.parse_metrics(pages.select("url", F.expr(JSON).alias("json"))))


def _catalog(s):
    return s.sql(f"select * from values {CATALOG} as c(label, entity_id, rank)")


def _answers(s, d):
    c = tables.table(s, d, "conversations").where("role = 'assistant'")
    return citations.parse_responses(c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("answer_id"), F.expr(RAW).alias("raw")))


def _flags(s, d):
    return citations.flags(_answers(s, d), "alpha.example")


QUERIES = {
    "rules_freshness": lambda s, d: joined_rules.freshness(page_queries.inputs(s, d), site.sitemap_entries(tables.site_files(s, d)), AS_OF),
    "rules_field_metrics": lambda s, d: joined_rules.field_metric_rules(tables.table(s, d, "pages"), _metrics(s, d)),
    "field_metric_p75": lambda s, d: _metrics(s, d).agg(F.count("lcp").alias("pages"), F.expr("percentile(lcp, 0.75)").alias("lcp"), F.expr("percentile(inp, 0.75)").alias("inp")),
    "rules_entity_catalog": lambda s, d: joined_rules.entity_rules(page_queries.inputs(s, d), _catalog(s)),
    "brand_coherence": lambda s, d: joined_rules.brand_roots(page_queries.inputs(s, d)),
    "rules_link_status": site_queries._graph(lambda p, e: joined_rules.link_status_rules(site.broken_links(p, e))),
    "citation_answers": lambda s, d: _answers(s, d).select("answer_id", "response_text", F.array_join(F.array_sort("citation_urls"), " ").alias("urls"), citations.truncated(F.col("response_text"), 12).alias("short")),
    "citation_flags": lambda s, d: _flags(s, d).select("answer_id", "is_cited", F.array_join("competitors", " ").alias("competitors")),
    "citation_rate": lambda s, d: _flags(s, d).groupBy((F.col("answer_id") % 10).alias("day")).agg(F.count("*").alias("answers"), F.count_if("is_cited").alias("cited"), F.round(F.count_if("is_cited") / F.count("*"), 6).alias("rate")),
    "competitor_rank": lambda s, d: citations.competitor_ranking(_flags(s, d)),
    "query_tool_grid": lambda s, d: citations.grid(tables.table(s, d, "benchmark").select("item_id"), ["search", "chat", "assistant"]),
    "domain_normalise": lambda s, d: tables.table(s, d, "pages").select("page_id", urls.domain(F.col("url")).alias("domain"), urls.domain(F.expr("'WWW.' || upper(url)")).alias("upper"), urls.domain(F.lit("localhost")).alias("none")),
    "url_resolve": lambda s, d: tables.table(s, d, "pages").select("page_id", *(urls.resolve(F.lit(h), F.col("url")).alias(n) for n, h in {"rooted": "/a/b", "relative": "c.html", "query": "?q=1", "fragment": "#f", "scheme": "//h.example/x", "absolute": "https://z.example/", "empty": ""}.items()), urls.internal_path(F.lit("/a/b/?x#y"), F.col("url")).alias("path")),
    "url_guard": lambda s, d: tables.table(s, d, "pages").select("page_id", urls.unsafe_reason(F.expr("case page_id % 8 when 0 then url when 1 then 'ftp://a.example/' when 2 then 'http://localhost/x' when 3 then 'http://10.' || page_id % 256 || '.0.1/' when 4 then 'http://172.' || page_id % 64 || '.0.1/' when 5 then 'http://8.8.' || page_id % 256 || '.8/' when 6 then 'http://[::1]/' else 'https://db.internal/' end")).alias("reason")),
    "term_canonical_casing": lambda s, d: tables.table(s, d, "documents").select("doc_id", F.sha2(text.canonical_casing(F.expr(CASED)), 256).alias("fixed")),
    "hedging_density": lambda s, d: tables.table(s, d, "documents").select("doc_id", text.words(F.col("text")).alias("words"), F.regexp_count("text", F.lit(fx.HEDGING)).alias("hedges"), F.col("text").rlike(fx.EVIDENCE).alias("evidence")),
    "outbox": lambda s, d: sinks.outbox(src.audits(s, d).where("status = 'completed'"), tables.table(s, d, "supplier").selectExpr("cast(s_nationkey as bigint) as org_id", "s_suppkey as hook_id", f"{HOOK_EVENTS} as events"), "audit.completed"),
    "upsert_latest": lambda s, d: history.upsert(src.audits(s, d).select("audit_id", "score"), src.findings(s, d).groupBy("audit_id").agg(F.max("points").alias("score")), ["audit_id"]),
}

_I = f"{page_sql.FEATURES}, {page_sql.FACTS}, {page_sql.INPUTS}"
_ANS = f"""raw as (select conv_id * 1000 + turn as answer_id, 'Answer ' || cast(conv_id as varchar) || {SITES} as response_text, ['https://delta.example/' || cast(turn as varchar), 'https://Alpha.example/s'] as urls from conversations where role = 'assistant'),
dm as (select answer_id, response_text, unnest(regexp_extract_all(response_text, 'https?://[^\\s"''<>)\\]]+') || urls) as u from raw),
dn as (select distinct answer_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(trim(u)), '^[a-z][a-z0-9+.-]*://', ''), '[/?#].*$', ''), ':\\d+$', ''), '^www\\.', '') as d from dm),
fl as (select answer_id, bool_or(d = 'alpha.example') or max(regexp_matches(lower(response_text), '(^|[^a-z0-9_.-])alpha\\.example([^a-z0-9_-]|$)')) as is_cited, coalesce(string_agg(d, ' ' order by d) filter (d <> 'alpha.example'), '') as competitors from raw join dn using (answer_id) where d like '%.%' group by answer_id)"""
_DOM = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(trim({0})), '^[a-z][a-z0-9+.-]*://', ''), '[/?#].*$', ''), ':\\d+$', ''), '^www\\.', '')"
_RULE_UNION = lambda keys, rel, rules: " union all ".join(f"select {keys}, '{i}' as rule_id, {s} as severity, cast({p} as double) as points from {rel} where {w}" for i, s, p, w in rules)
_NOW, _DAYS = f"timestamp '{AS_OF}'", lambda a, b: f"cast(floor((epoch({a}) - epoch({b})) / 86400) as bigint)"
_SAID_FRESHNESS = [("F01", "'medium'", "1.5", "coalesce(ld_date, t, map_date) is null"), ("F02", "if(page_kind = 'landing', 'medium', 'low')", "if(page_kind in ('blog', 'evergreen'), 1, 2)", "age >= tolerance + 1"), ("F03", "'medium'", "1.5", "ld_age <= 29 and http_age >= 181"), ("F06", "'low'", "1", "gap not between -30 and 30")]
_SAID_METRICS = [("P01", "'high'", "3", "lcp > 4000"), ("P02", "'medium'", "2", "lcp > 2500 and not lcp > 4000"), ("P03", "'high'", "3", "inp > 500"), ("P04", "'medium'", "2", "inp > 200 and not inp > 500"), ("P05", "if(cls > 0.25, 'high', 'medium')", "2", "cls > 0.1")]
_GUARD = "case page_id % 8 when 0 then url when 1 then 'ftp://a.example/' when 2 then 'http://localhost/x' when 3 then 'http://10.' || page_id % 256 || '.0.1/' when 4 then 'http://172.' || page_id % 64 || '.0.1/' when 5 then 'http://8.8.' || page_id % 256 || '.8/' when 6 then 'http://[::1]/' else 'https://db.internal/' end"
_MX = "mx as (select url, max(1500 + page_id % 40 * 100.0) as lcp, max(case when page_id % 4 = 0 then null else 100 + page_id % 9 * 60.0 end) as inp, max(page_id % 4 / 10.0) as cls from pages where page_id % 6 <> 0 group by url)"
_PROT = page_sql._s(r"`[^`]+`|<code>[^<]+</code>|https?://[^\s<>\"')]+")


def _casing(x: str) -> str:
    """Terms of the texts, by the comparison engine: its patterns have no look-ahead, so http is set apart."""
    for pattern, term in text.TERMS:
        x = f"regexp_replace({x}, {page_sql._s(pattern.split('(?!')[0])}, '{term}', 'g')"
    return x


SQL = {
    "rules_freshness": f"""with {_I}, {tables.SITE_FILES_SQL}, {site_queries._MAP_ENTRIES},
      sm as (select host, {page_sql.path('loc')} as path, max(lastmod) as map_date from sg group by all),
      tx as (select page_id, unnest(regexp_extract_all(clean, '(?is)<time[^>]*\\sdatetime=["'']([^"'']*)["'']', 1)) as x from c),
      tm as (select page_id, max(try_cast(x as timestamp)) filter (regexp_matches(x, '^\\s*\\d{{4}}')) as t from tx group by page_id),
      k as (select i.page_id, case when is_editorial then case when guide_heading then 'evergreen' else 'blog' end when regexp_matches(url, '(?i)/(product|produit|shop|boutique|feature|pricing|tarifs)/') then 'product' else 'landing' end as page_kind, ld_date, map_date, i.last_modified, tm.t from i left join sm using (host, path) left join tm on tm.page_id = i.page_id),
      n as (select *, greatest(ld_date, t, map_date) as newest from k),
      z as (select *, {_DAYS(_NOW, 'newest')} as age, {_DAYS(_NOW, 'ld_date')} as ld_age, {_DAYS(_NOW, 'last_modified')} as http_age, {_DAYS('greatest(ld_date, t)', 'map_date')} as gap, case page_kind when 'blog' then 90 when 'evergreen' then 365 else 30 end as tolerance from n)
      {_RULE_UNION('page_id, page_kind, age', 'z', _SAID_FRESHNESS)}""",
    "rules_field_metrics": f"with {_MX}, z as (select page_id, mx.* from pages left join mx using (url)) {_RULE_UNION('page_id', 'z', _SAID_METRICS)}",
    "field_metric_p75": f"with {_MX} select count(lcp) as pages, cast(quantile_cont(lcp, 0.75) as double) as lcp, cast(quantile_cont(inp, 0.75) as double) as inp from mx",
    "rules_entity_catalog": f"with {_I}, cat as (select label, arg_min(entity_id, rank) as entity_id from (values {CATALOG}) c(label, entity_id, rank) group by label), z as (select page_id, entity_id from i left join cat on cat.label = lower(string_split_regex(coalesce(org_name, nullif(og_site_name, ''), title), '[\\s|·—-]')[1]) where has_org and not org_wikidata) select page_id, entity_id, case when entity_id is null then 'N03' else 'N02' end as rule_id, case when entity_id is null then 'medium' else 'high' end as severity, 2.0::double as points from z",
    "brand_coherence": f"with {_I}, z as (select page_id, list_sort(list_distinct(list_filter(list_transform(list_filter([org_name, nullif(og_site_name, ''), nullif(title, '')], lambda x: x is not null), lambda x: string_split_regex(lower(trim(x)), '[\\s|·—-]')[1]), lambda r: length(r) >= 3))) as r from i) select page_id, array_to_string(r, ',') as roots from z where len(r) > 1",
    "rules_link_status": site_queries._F + ", br as (select distinct e.host, e.src_page, e.dst_path, f.status from e join f on e.host = f.host and e.dst_path = f.path where f.status >= 300), z as (select src_page, count(*) filter (status >= 400) as broken, count(*) filter (status between 300 and 399) as redirected from br group by src_page) " + _RULE_UNION("src_page, broken, redirected", "z", [("C10", "'high'", "1", "broken > 0"), ("C09", "'medium'", "0.5", "redirected >= 2")]),
    "citation_answers": f"with {_ANS} select answer_id, response_text, array_to_string(list_sort(urls), ' ') as urls, case when length(response_text) > 12 then substring(response_text, 1, 12) || '…' else response_text end as short from raw",
    "citation_flags": f"with {_ANS} select * from fl",
    "citation_rate": f"with {_ANS} select answer_id % 10 as day, count(*) as answers, count(*) filter (is_cited) as cited, round(count(*) filter (is_cited) / count(*), 6) as rate from fl group by all",
    "competitor_rank": f"with {_ANS} select d as domain, count(*) as answers from dn where d <> 'alpha.example' and d like '%.%' group by d order by answers desc, d limit 10",
    "query_tool_grid": "select item_id, tool from benchmark, (values ('search'), ('chat'), ('assistant')) t(tool)",
    "domain_normalise": f"select page_id, {_DOM.format('url')} as domain, case when {_DOM.format("'WWW.' || upper(url)")} like '%.%' then {_DOM.format("'WWW.' || upper(url)")} end as upper, cast(null as varchar) as none from pages",
    "url_resolve": "select page_id, " + ", ".join(f"{page_sql.resolve(repr(h))} as {n}" for n, h in {"rooted": "/a/b", "relative": "c.html", "query": "?q=1", "fragment": "#f", "scheme": "//h.example/x", "absolute": "https://z.example/", "empty": ""}.items()) + ", '/a/b' as path from pages",
    "url_guard": f"with g as (select page_id, {_GUARD} as u from pages) select page_id, case when page_id % 8 = 1 then 'scheme' when page_id % 8 in (2, 7) then 'blocked host' when page_id % 8 in (3, 6) then 'private address' when page_id % 8 = 4 and page_id % 64 between 16 and 31 then 'private address' end as reason from g",
    "hedging_density": f"select doc_id, len(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '')) as words, len(regexp_extract_all(text, {page_sql._s(fx.HEDGING)})) as hedges, regexp_matches(text, {page_sql._s(fx.EVIDENCE)}) as evidence from documents",
    "term_canonical_casing": f"select doc_id, sha256(list_reduce(list_transform(list_zip(string_split_regex(x, {_PROT}), regexp_extract_all(x, {_PROT})), lambda z: {_casing('z[1]')} || coalesce(z[2], '')), lambda p, q: p || q)) as fixed from (select doc_id, {CASED} as x from documents)",
    "outbox": f"with {src.CTES} select audit_id, s_suppkey as hook_id from a join supplier on s_nationkey = org_id where status = 'completed' and s_suppkey % 3 < 2",
    "upsert_latest": f"with {src.CTES} select coalesce(a.audit_id, m.audit_id) as audit_id, coalesce(m.top, a.score) as score from a full join (select audit_id, max(points) as top from fd group by audit_id) m on m.audit_id = a.audit_id",
}
