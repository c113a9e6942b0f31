"""Named queries: report tables, access paths, sinks, code repositories."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagelantern.operators import codebase, history, scoring, sinks, site
from pagelantern.operators.checkpoint import cut, scratch
from pagelantern.plans import history_queries as hq
from pagelantern.plans import joined_queries, page_queries, page_sql, site_queries
from pagelantern.sources import code, tables
from pagelantern.sources import history as src

_a, _f, _ps, _runs, _orgs = hq._a, hq._f, hq._ps, hq._runs, hq._orgs
CAPS = {"flash": 3, "standard": 20, "full": 50}
SKIPPED = "audit_id % 3 = 0 and phase in ('topical', 'performance', 'common_mistakes', 'international', 'freshness', 'eeat', 'entity', 'geo')"
STATUS = "case (audit_id + length(phase)) % 4 when 0 then 'completed' when 1 then 'skipped' when 2 then 'running' else 'failed' end"


def _members(s, d):
    return tables.table(s, d, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_nationkey").cast("bigint").alias("org_id"), F.col("c_name").alias("name"), F.concat(F.lower("c_name"), F.lit("@x.example")).alias("email"), (F.col("c_acctbal") >= 0).alias("active"))


def _results(s, d):
    return _ps(s, d).withColumn("status", F.expr(STATUS)).select("audit_id", "phase", "score", "status")


def _bench(s, d):
    """Benchmarks of some of an organization's users' audits, too few or too many at times, with none or several references."""
    rows = _a(s, d).selectExpr("org_id * 100 + user_id % 60 as benchmark_id", "audit_id", "target", "concat('https://', target, case when audit_id % 29 = 0 then repeat('x', 2048) else '' end) as url", "case when audit_id % 31 = 0 then '' else target end as label", "audit_id % 3 = 0 as is_reference")
    return rows.unionByName(rows.where("audit_id % 11 = 0").withColumn("audit_id", -F.col("audit_id")))


def _sink(s, d):
    with scratch(s, "findings") as folder:
        sinks.append_findings(_f(s, d).where("severity in ('critical', 'high')"), folder)
        sinks.append_findings(_f(s, d).where("severity not in ('critical', 'high')"), folder)
        return cut(s.read.parquet(folder).groupBy("phase", "severity").agg(F.count("*").alias("findings"), scoring.round1(F.sum("points")).alias("points")))


def _phase_upsert(s, d):
    rows = _results(s, d).withColumn("version", F.lit(1))
    newer = rows.where("status in ('running', 'failed')").withColumns({"status": F.lit("completed"), "version": F.lit(2)})
    return sinks.merged_results(rows, newer.unionByName(newer)).groupBy("phase", "status", "version").agg(F.count("*").alias("rows"))


def _listed(rows, by, order, value, name):
    """A group's values in order, joined by commas; groups are an audit's findings or an organization's few rows."""
    item = F.struct(*(F.col(c).alias(f"o{k}") if isinstance(c, str) else c.alias(f"o{k}") for k, c in enumerate(order)), F.col(value).cast("string").alias("value"))
    return rows.groupBy(by).agg(F.array_join(F.transform(F.sort_array(F.collect_list(item)), lambda x: x["value"]), ",").alias(name))


def audit_detail(s, d):
    """Every audit with its findings, the dearest first, and its phases in the order of the rubric."""
    found = _listed(_f(s, d), "audit_id", [-F.col("points"), "n"], "n", "findings")
    phases = _listed(_ps(s, d).join(F.broadcast(src.rubric(s).select("phase", "phase_order")), "phase"), "audit_id", ["phase_order"], "phase", "phases")  # the rubric is ten rows
    out = _a(s, d).join(found, "audit_id", "left").join(phases, "audit_id", "left")
    return out.select("audit_id", "status", "phases", F.coalesce("findings", F.lit("")).alias("findings"))


def org_audits(s, d, orgs=None, most=200):
    """Each organization's `most` newest audits (of some organizations, if told)."""
    rows = _a(s, d) if orgs is None else _a(s, d).where(F.col("org_id").isin(orgs))
    return scoring.placed(rows, ["org_id"], [F.desc("created_at"), "audit_id"], most).select("org_id", "place", "audit_id", "created_at")


def org_detail(s, d, month="1996-03-01"):
    """Every organization with its members, its 20 newest audits and its use of a month."""
    members = _members(s, d).groupBy("org_id").agg(F.count("*").alias("members"))
    latest = _listed(org_audits(s, d, most=20), "org_id", ["place"], "audit_id", "latest")
    used = history.usage_by_month(_a(s, d)).where(F.col("month") == F.lit(month).cast("timestamp")).select("org_id", F.col("audits").alias("month"))
    out = _orgs(s, d).join(members, "org_id", "left").join(latest, "org_id", "left").join(used, "org_id", "left")
    return out.select("org_id", "name", F.coalesce("members", F.lit(0)).alias("members"), F.coalesce("latest", F.lit("")).alias("latest"), F.coalesce("month", F.lit(0)).alias("month"))


def users_memberships(s, d):
    """Every user with the organizations that the user belongs to: up to three for an active user, none for others."""
    users = _members(s, d)
    held = users.where("active").select("user_id", F.explode(F.expr("transform(sequence(0, cast(user_id % 3 as int)), k -> (org_id + 7 * k) % 25)")).alias("org_id"))
    held = held.join(_orgs(s, d).select("org_id", F.col("name").alias("org"), "plan"), "org_id").groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("org", "plan"))).alias("orgs"))
    text = F.array_join(F.transform("orgs", lambda x: F.concat_ws("/", x["org"], x["plan"])), ",")
    return users.select("user_id", "name").join(held, "user_id", "left").select("user_id", "name", F.size(F.coalesce("orgs", F.array())).alias("n"), F.coalesce(text, F.lit("")).alias("orgs"))


def usage_page(s, d, as_of="1996-03-10 00:00:00"):
    """Every organization's use of the month against its limit, and its ten newest audits."""
    newest = org_audits(s, d, most=10).groupBy("org_id").agg(F.count("*").alias("latest"), F.min("created_at").alias("since"))
    return history.quota(_a(s, d), _orgs(s, d), as_of).join(newest, "org_id", "left").select("org_id", "used", "monthly", "latest", "since")


def coverage_ratios(s, d):
    """Each host's shares of pages with breadcrumbs, of thin pages, and of recent entries in its sitemaps."""
    ages = site.sitemap_ages(site.sitemap_entries(tables.site_files(s, d)), site_queries.AS_OF)
    share = lambda a, b: F.round(F.col(a) / F.nullif(F.col(b), F.lit(0)), 6)
    out = site.host_facts(page_queries.inputs(s, d)).join(ages, "host", "left")
    return out.select("host", share("breadcrumb", "pages").alias("breadcrumb"), share("thin", "pages").alias("thin"), share("recent", "dated").alias("recent"))


QUERIES = {
    "quick_wins": lambda s, d: scoring.quick_wins(_f(s, d)).select("audit_id", "place", "n", "points", "subject"),
    "merged_recommendations": lambda s, d: scoring.deduplicated(_f(s, d)).select("audit_id", "subject", "n", "recommendation"),
    "flash_teaser": lambda s, d: scoring.teaser(_f(s, d), chars=20).select("audit_id", "rank", "n", "recommendation"),
    "content_gaps": lambda s, d: scoring.content_gaps(_f(s, d)).select("audit_id", "place", "n", "brief"),
    "top_hotspots": lambda s, d: scoring.top_hotspots(_f(s, d)),
    "strengths": lambda s, d: scoring.strengths(_ps(s, d)),
    "score_shares": lambda s, d: scoring.score_shares(_ps(s, d)),
    "score_table": lambda s, d: scoring.score_table(_ps(s, d)),
    "radar_rows": lambda s, d: scoring.radar(_ps(s, d), _ps(s, d).where(SKIPPED).select("audit_id", "phase")).select("audit_id", "phase", "score", "axes"),
    "audience_views": lambda s, d: scoring.audience(_f(s, d)).groupBy("audit_id", "audience").agg(F.count("*").alias("findings"), scoring.round1(F.sum("points")).alias("points")),
    "phase_delta_order": lambda s, d: history.ordered_deltas(history.phase_deltas(_ps(s, d), _runs(s, d))).where("by_size <= 3 or by_fall <= 3").select("audit_id", "phase", "delta", "by_size", "by_fall"),
    "drift_report": lambda s, d: history.drift_report(history.drift(_runs(s, d), 60.0), history.phase_deltas(_ps(s, d), _runs(s, d))),
    "benchmark_rows": lambda s, d: history.benchmark_rows(_bench(s, d), _a(s, d), _ps(s, d)),
    "benchmark_validation": lambda s, d: history.validated_benchmarks(_bench(s, d)),
    "domain_validation": lambda s, d: tables.table(s, d, "pages").select("page_id", history.valid_domain(F.expr("case page_id % 4 when 0 then url when 1 then 'localhost' when 2 then 'a-' || page_id || '.example' else repeat('a', 60) || '.fr' end")).alias("valid")),
    "due_with_plan": lambda s, d: history.due_with_plan(hq._schedules(s, d), _orgs(s, d), _a(s, d), hq.AS_OF).select("schedule_id", "org_id", "plan", "mode", "previous_id"),
    "phases_left": lambda s, d: sinks.phases_left(_a(s, d), src.rubric(s), _results(s, d)).groupBy("audit_id").agg(F.count("*").alias("left")),
    "phase_progress": lambda s, d: _results(s, d).groupBy("audit_id").agg(F.round(F.count_if(F.col("status").isin("completed", "skipped", "failed")) / F.count("*"), 4).alias("progress")),
    "phase_seeding": lambda s, d: sinks.seeded(_a(s, d), src.rubric(s), _results(s, d).where("status in ('completed', 'skipped')")).groupBy("phase", "status").agg(F.count("*").alias("rows")),
    "phase_upsert": _phase_upsert,
    "findings_sink": _sink,
    "audit_completion": lambda s, d: sinks.completions(_ps(s, d)),
    "audit_in_org": lambda s, d: history.audits_in_org(_a(s, d), _a(s, d).selectExpr("audit_id", "case when mode = 'full' then org_id else org_id + 1 end as org_id")).select("audit_id", "org_id", "target", "status", "score"),
    "org_audits": org_audits,
    "findings_by_points": lambda s, d: scoring.placed(_f(s, d), ["audit_id"], [F.desc("points"), "n"], 10**9).select("audit_id", "place", "n"),
    "audit_detail": audit_detail,
    "org_detail": org_detail,
    "users_memberships": users_memberships,
    "member_exists": lambda s, d: _members(s, d).join(_members(s, d).where("not active").select("email"), "email", "left_semi").select("user_id", "org_id"),
    "usage_page": usage_page,
    "citation_page": lambda s, d: history.page(joined_queries._flags(s, d).where("is_cited"), [F.desc("answer_id")], 5, 20).select("answer_id", "is_cited", "total"),
    "coverage_ratios": coverage_ratios,
    "cluster_samples": site_queries._graph(lambda p, e: site.cluster_samples(p)),
    "subpage_cap": lambda s, d: site.capped_pages(tables.pages(s, d).select("page_id", "host"), CAPS),
    "missing_fields": lambda s, d: page_queries.inputs(s, d).where("article_missing > 0").select("page_id", "article_missing", "article_gaps"),
    "metric_strings": lambda s, d: page_queries.features(s, d).select("page_id", F.format_string("%d car.", F.length("title")).alias("title"), F.format_string("%d/%d", "n_no_alt", "n_imgs").alias("alt"), F.concat(F.floor(F.col("h2_questions") / F.nullif(F.col("h2_count"), F.lit(0)) * 100 + 0.5).cast("string"), F.lit(" %")).alias("questions")),
    "labelled_findings": lambda s, d: _f(s, d).join(F.broadcast(s.createDataFrame(list(scoring.LABELS.items()), "severity string, label string")), "severity").groupBy("severity", "label").agg(F.count("*").alias("findings")),
    "code_findings": lambda s, d: codebase.code_findings(code.code_files(s, d)),
    "code_stacks": lambda s, d: codebase.stacks(codebase.roles(code.code_files(s, d))).select("repo", "stack", "ssr", "router"),
    "code_roles": lambda s, d: codebase.roles(code.code_files(s, d)).select("repo", *(F.sha2(F.coalesce(r, F.lit("")), 256).alias(r) for r in codebase.ROLES)),
}

C, PS, RUNS, ORGS = f"with {src.CTES}", f"with {hq._PS}", hq._RUNS, hq._ORGS
_MEMBERS = "mb as (select c_custkey as user_id, cast(c_nationkey as bigint) as org_id, c_name as name, lower(c_name) || '@x.example' as email, c_acctbal >= 0 as active from customer)"
_RES = f"rs as (select *, {STATUS} as status from ps)"
_BENCH = """b0 as (select org_id * 100 + user_id % 60 as benchmark_id, audit_id, target, 'https://' || target || case when audit_id % 29 = 0 then repeat('x', 2048) else '' end as url, case when audit_id % 31 = 0 then '' else target end as label, audit_id % 3 = 0 as is_reference from a),
bu as (select * from b0 union all select benchmark_id, -audit_id, target, url, label, is_reference from b0 where audit_id % 11 = 0)"""
_DEDUP = f"""dd as (select audit_id, {hq._SUB} as subject, list_reduce(list({{'n': n, 'points': points, 'w': {hq._W}, 'rec': trim(recommendation)}} order by n), lambda p, q: {{
 'n': case when q.points > p.points or (q.points = p.points and q.w > p.w) then q.n else p.n end, 'points': greatest(p.points, q.points), 'w': case when q.points > p.points or (q.points = p.points and q.w > p.w) then q.w else p.w end,
 'rec': case when contains(lower(p.rec), lower(q.rec)) or contains(lower(q.rec), lower(p.rec)) then case when q.points > p.points or (q.points = p.points and q.w > p.w) then q.rec else p.rec end
  when q.points > p.points or (q.points = p.points and q.w > p.w) then q.rec || chr(10) || '- ' || p.rec else p.rec || chr(10) || '- ' || q.rec end}}) as x from FROM_ROWS group by all)"""
_ROLE = lambda paths: "coalesce(" + ", ".join(f"max(content) filter (path = '{p}')" for p in paths) + ")"
_CODE = f"""{code.CODE_SQL}, cr as (select repo, {_ROLE(['package.json'])} as package, {_ROLE(['app/layout.tsx', 'src/app/layout.tsx', 'pages/_document.tsx'])} as layout, {_ROLE(['app/page.tsx', 'pages/index.tsx'])} as page, {_ROLE(['index.html', 'dist/index.html'])} as html, {_ROLE(['public/robots.txt', 'robots.txt'])} as robots, {_ROLE(['public/sitemap.xml'])} as sitemap, {_ROLE(['public/llms.txt'])} as llms,
 bool_or(lower(path) = 'app/layout.tsx') as has_app, bool_or(path like 'pages/%') as has_pages, bool_or(lower(path) like '%router.tsx') as has_router, bool_or(path = 'index.html') as has_index from cf group by repo),
cs as (select *, case when package like '%"next"%' then case when has_pages and not has_app then 'next-pages' else 'next-app' end when package like '%"nuxt"%' then 'nuxt' when package like '%@remix%' then 'remix' when package like '%"astro"%' then 'astro' when package like '%"react"%' then 'react-spa' when has_index and (package is null or package not like '%"vue"%') then 'static' else 'other' end as stack from cr)"""
_CODE_RULES = [
    ("K01", "high", "1", "not (regexp_matches(lt || chr(10) || ht, '\\btitle\\s*:\\s*[''\"`{]') or regexp_matches(ht, '(?i)<title>[^<]+</title>'))"),
    ("K02", "medium", "1", "not (regexp_matches(lt || chr(10) || ht, '\\bdescription\\s*:\\s*[''\"`{]') or regexp_matches(ht, '(?i)<meta name=.description'))"),
    ("K03", "medium", "1", "stack = 'static' and not regexp_matches(ht, '(?i)<meta name=.viewport')"),
    ("K04", "low", "1", "not (regexp_matches(lt || ht, '(?i)<html lang=.[a-z]') or regexp_matches(lt, '\\blang: *[''\"`][a-z]'))"),
    ("K05", "medium", "3 - og", "og < 3"),
    ("K06", "medium", "1", "coalesce(robots, '') = ''"),
    ("K07", "medium", "2", "coalesce(sitemap, '') = ''"),
    ("K08", "critical", "5", "len(objs) = 0"),
    ("K09", "critical", "3", "not list_contains(kinds, 'organization')"),
    ("K10", "medium", "2", "not list_contains(kinds, 'website')"),
    ("K11", "low", "1", "len(objs) > 0 and len(kinds) < 3"),
    ("K12", "high", "4", "coalesce(llms, '') = ''"),
    ("K13", "low", "1", "llms <> '' and not (regexp_matches(llms, '(^|\\n)# +[^ ]') and regexp_matches(llms, '(^|\\n)> +[^ ]'))"),
    ("K14", "critical", "least(6, 2 * shut)", "shut > 0"),
    ("K15", "medium", "2", "stack = 'static' and len(list_filter(string_split_regex(coalesce(regexp_extract(ht, '(?s)<p>(.*?)</p>', 1), ''), '\\s+'), lambda w: w <> '')) < 100"),
    ("K16", "low", "1", "lt <> '' and not regexp_matches(lt, 'description *:')"),
]
# of a robots file the group of a crawler counts, else that of all; the bound files have one group of one rule
_CODE_FIND = f"""{_CODE}, cx as (select *, coalesce(layout, '') as lt, coalesce(html, '') as ht, lower(regexp_extract(robots, '(?i)user-agent: *([^\\n]*)', 1)) as agent, regexp_extract(robots, '(?i)disallow: *([^\\n]*)', 1) as path_shut from cs),
cy as (select *, list_filter(regexp_extract_all(lt || ht, '(?is)<script[^>]*ld.json[^>]*>(.*?)</script>', 1), lambda b: json_valid(b)) || list_filter(regexp_extract_all(lt || coalesce(page, '') || ht, '(?s)JSON\\.stringify\\(\\s*(\\{{.*?\\}})\\s*\\)', 1), lambda b: contains(b, 'schema.org')) as blocks,
 case when path_shut <> '/' then 0 when agent = '*' then {len(codebase.BOTS)} when agent in ({", ".join(repr(b) for b in codebase.BOTS)}) then 1 else 0 end as shut,
 least(1, len(regexp_extract_all(lt, 'openGraph: *\\{{[^}}]*title *:')) + len(regexp_extract_all(ht, 'og:title'))) + least(1, len(regexp_extract_all(lt, 'openGraph: *\\{{[^}}]*description *:')) + len(regexp_extract_all(ht, 'og:description'))) + least(1, len(regexp_extract_all(lt, 'openGraph: *\\{{[^}}]*images? *:')) + len(regexp_extract_all(ht, 'og:image'))) as og from cx),
c1 as (select *, flatten(list_transform(blocks, lambda b: case when json_type(json_extract(b, '$."@graph"')) = 'ARRAY' then json_extract(b, '$."@graph"[*]') else [b::json] end)) as objs from cy),
cz as (select *, list_distinct(flatten(list_transform(objs, lambda o: case when json_type(json_extract(o, '$."@type"')) = 'ARRAY' then list_transform(json_extract_string(o, '$."@type"[*]'), lambda t: lower(t)) else [lower(json_extract_string(o, '$."@type"'))] end))) as kinds from c1)
""" + " union all ".join(f"select repo, '{i}' as rule_id, '{s}' as severity, cast({p} as double) as points from cz where {w}" for i, s, p, w in _CODE_RULES)
SQL = {
    "quick_wins": f"{C}, {_DEDUP.replace("FROM_ROWS", "(select * from fd where effort = 'quick' and severity <> 'info')")}, z as (select audit_id, row_number() over (partition by audit_id order by x.points desc, x.n) as place, x.n as n, x.points as points, subject from dd) select * from z where place <= 10",
    "merged_recommendations": f"{C}, {_DEDUP.replace("FROM_ROWS", "fd")} select audit_id, subject, x.n as n, x.rec as recommendation from dd",
    "flash_teaser": f"{C} select audit_id, rank, n, case when length(recommendation) > 20 then recommendation[1:20] || '…' else recommendation end as recommendation from ({hq._TOPQ.format('select * from fd')}) where rank <= 5",
    "content_gaps": f"{C}, g as (select *, row_number() over (partition by audit_id, title order by points desc, n) as k_ from fd where phase in ('topical', 'freshness')), z as (select *, row_number() over (partition by audit_id order by points desc, n) as place from g where k_ = 1) select audit_id, place, n, 'Phase: ' || phase || chr(10) || 'Problem: ' || title || chr(10) || 'Recommendation: ' || recommendation as brief from z where place <= 3",
    "top_hotspots": f"{C}, h as (select audit_id, url, count(*) as findings, count(distinct phase) as phases, floor(sum(points) * 10 + 0.5) / 10 as points from fd group by audit_id, url having count(*) >= 3 and count(distinct phase) >= 2), z as (select *, row_number() over (partition by audit_id order by points desc, url) as place, count(*) over (partition by audit_id) as spots from h) select * exclude (spots) from z where spots >= 2 and place <= 5",
    "strengths": f"{PS}, z as (select audit_id, phase, round(score / score_max, 6) as ratio from ps where score / score_max >= 0.7), y as (select *, row_number() over (partition by audit_id order by ratio desc, phase) as place from z) select * from y where place <= 5",
    "score_shares": f"{PS} select audit_id, phase, round(score_max / 100.0, 6) as share, round(score / score_max, 6) as ratio, case when score >= 0.75 * score_max then 'good' when score >= 0.5 * score_max then 'ok' when score >= 0.3 * score_max then 'warn' else 'bad' end as bar from ps",
    "score_table": f"{PS}, z as (select audit_id, phase, score, score_max from ps union all select audit_id, 'total', floor(sum(score) * 10 + 0.5) / 10, sum(score_max) from ps group by audit_id) select *, cast(floor(score / score_max * 100 + 0.5) as bigint) as percent from z",
    "radar_rows": f"{PS}, z as (select audit_id, phase, score, count(*) over (partition by audit_id) as axes from ps where not ({SKIPPED})) select * from z where axes >= 3",
    "audience_views": f"{C} select audit_id, case when phase in ('geo', 'eeat', 'entity', 'freshness', 'international') then 'marketing' else 'technical' end as audience, count(*) as findings, floor(sum(points) * 10 + 0.5) / 10 as points from fd group by all",
    "phase_delta_order": f"{PS}, {RUNS}, {hq._DELTA}, z as (select audit_id, phase, delta, row_number() over (partition by audit_id order by abs(delta) desc, phase) as by_size, row_number() over (partition by audit_id order by delta, phase) as by_fall from pdl) select * from z where by_size <= 3 or by_fall <= 3",
    "drift_report": f"{PS}, {RUNS}, {hq._DELTA}, z as (select audit_id, string_agg(phase || ' ' || printf('%.1f', delta), ', ' order by delta, phase) as phases from pdl where delta < 0 group by audit_id) select pr.audit_id, pr.delta, coalesce(phases, '') as phases from pr left join z using (audit_id) where pr.delta <= -60",
    "benchmark_rows": f"{PS}, {_BENCH} select benchmark_id, bu.target, is_reference, bu.audit_id, a.status, ps.phase, ps.score from bu left join a on a.audit_id = bu.audit_id left join ps on ps.audit_id = bu.audit_id",
    "benchmark_validation": f"{C}, {_BENCH} select benchmark_id, count(*) as n, case when count(*) < 2 then 'too few' when count(*) > 5 then 'too many' when count(*) filter (is_reference) <> 1 then 'reference' when max(length(url)) > 2048 then 'url' when min(length(label)) = 0 then 'label' end as reason from bu group by benchmark_id",
    "domain_validation": "with z as (select page_id, string_split(case page_id % 4 when 0 then url when 1 then 'localhost' when 2 then 'a-' || page_id || '.example' else repeat('a', 60) || '.fr' end, '.') as parts from pages) select page_id, len(parts) > 1 and length(parts[1]) between 1 and 63 and trim(parts[1], '-') = parts[1] and translate(lower(parts[1]), 'abcdefghijklmnopqrstuvwxyz0123456789-', '') = '' and len(list_filter(parts[2:], lambda x: length(x) < 2 or translate(lower(x), 'abcdefghijklmnopqrstuvwxyz', '') <> '')) = 0 and list_sum(list_transform(parts, lambda x: length(x) + 1)) <= 254 as valid from z",
    "due_with_plan": f"{C}, {ORGS}, s as (select c_custkey as schedule_id, cast(c_nationkey as bigint) as org_id, timestamp '2024-01-01' + to_days(cast(c_custkey % 30 as int)) as next_run_at from customer where c_acctbal > 0), t as (select * from s where next_run_at <= timestamp '2024-01-15' order by next_run_at, schedule_id limit 20) select schedule_id, org_id, plan, case when plan = 'free' then 'flash' else 'full' end as mode, (select audit_id from a where a.org_id = t.org_id and status = 'completed' order by created_at desc, audit_id desc limit 1) as previous_id from t left join og using (org_id)",
    "phases_left": f"{PS}, {_RES} select audit_id, count(*) as \"left\" from rs where status not in ('completed', 'skipped') group by audit_id",
    "phase_progress": f"{PS}, {_RES} select audit_id, round(count(*) filter (status <> 'running') / count(*), 4) as progress from rs group by audit_id",
    "phase_seeding": f"{PS}, {_RES} select phase, case when status in ('completed', 'skipped') then status else 'pending' end as status, count(*) as rows from rs group by all",
    "phase_upsert": f"{PS}, {_RES} select phase, case when status in ('running', 'failed') then 'completed' else status end as status, case when status in ('running', 'failed') then 2 else 1 end as version, count(*) as rows from rs group by all",
    "findings_sink": f"{C} select phase, severity, count(*) as findings, floor(sum(floor(points * 10 + 0.5) / 10) * 10 + 0.5) / 10 as points from fd group by all",
    "audit_completion": f"{PS} select audit_id, 'completed' as status, floor(sum(score) / sum(score_max) * 100 * 10 + 0.5) / 10 as total, string_agg(phase || '=' || printf('%.1f', score), ',' order by phase) as breakdown from ps group by audit_id",
    "audit_in_org": f"{C} select audit_id, org_id, target, status, score from a where mode = 'full'",
    "org_audits": f"{C} select org_id, place, audit_id, created_at from (select *, row_number() over (partition by org_id order by created_at desc, audit_id) as place from a) where place <= 200",
    "findings_by_points": f"{C} select audit_id, row_number() over (partition by audit_id order by points desc, n) as place, n from fd",
    "audit_detail": f"{PS} select audit_id, status, (select string_agg(phase, ',' order by phase_order) from ru) as phases, coalesce((select string_agg(cast(n as varchar), ',' order by points desc, n) from fd where fd.audit_id = a.audit_id), '') as findings from a",
    "org_detail": f"{C}, {ORGS}, {_MEMBERS}, l as (select *, row_number() over (partition by org_id order by created_at desc, audit_id) as k from a) select org_id, name, (select count(*) from mb where mb.org_id = og.org_id) as members, coalesce((select string_agg(cast(audit_id as varchar), ',' order by k) from l where l.org_id = og.org_id and k <= 20), '') as latest, (select count(*) from a where a.org_id = og.org_id and status <> 'failed' and created_at >= timestamp '1996-03-01' and created_at < timestamp '1996-04-01') as month from og",
    "users_memberships": f"with {ORGS}, {_MEMBERS}, hl as (select user_id, og.name || '/' || plan as said from (select user_id, (org_id + 7 * k) % 25 as org_id from mb, range(3) r(k) where active and k <= user_id % 3) join og using (org_id)) select user_id, mb.name, cast(count(said) as int) as n, coalesce(string_agg(said, ',' order by said), '') as orgs from mb left join hl using (user_id) group by all",
    "member_exists": f"with {_MEMBERS} select user_id, org_id from mb where email in (select email from mb where not active)",
    "usage_page": f"{C}, {ORGS}, l as (select *, row_number() over (partition by org_id order by created_at desc, audit_id) as k from a) select org_id, (select count(*) from a where a.org_id = og.org_id and date_trunc('month', created_at) = timestamp '1996-03-01') as used, monthly, count(audit_id) as latest, min(created_at) as since from og left join (select * from l where k <= 10) l using (org_id) group by org_id, monthly",
    "citation_page": f"with {joined_queries._ANS} select answer_id, is_cited, count(*) over () as total from fl where is_cited order by answer_id desc limit 20 offset 5",
    "coverage_ratios": f"with {page_sql.FEATURES}, {page_sql.FACTS}, {page_sql.INPUTS}, {tables.SITE_FILES_SQL}, {site_queries._MAP_ENTRIES} select host, round(count(*) filter (has_breadcrumb) / count(*), 6) as breadcrumb, round(count(*) filter (words < 300) / count(*), 6) as thin, round(max(recent) / nullif(max(dated), 0), 6) as recent from i left join sa using (host) group by host",
    "cluster_samples": site_queries._F + ", cq as (select host, string_split(path, '/')[2] as cluster, path, count(*) over (partition by host, string_split(path, '/')[2]) as pages, row_number() over (partition by host, string_split(path, '/')[2] order by path) as k_ from f where len(string_split(path, '/')) >= 3) select host, cluster, pages, string_agg(path, ' ' order by path) as sample from cq where pages >= 4 and k_ <= 5 group by all",
    "subpage_cap": f"with p as ({tables.PAGES_SQL}), z as (select page_id, host, row_number() over (partition by host order by page_id) as place from p) select mode, host, page_id, place from z, (values ('flash', 3), ('standard', 20), ('full', 50)) m(mode, cap) where place <= cap",
    "missing_fields": f"with {page_sql.FEATURES}, {page_sql.FACTS}, {page_sql.INPUTS} select page_id, article_missing, article_gaps from i where article_missing > 0",
    "metric_strings": f"with {page_sql.FEATURES} select page_id, length(title) || ' car.' as title, n_no_alt || '/' || n_imgs as alt, case when h2_count > 0 then cast(floor(h2_questions / h2_count * 100 + 0.5) as bigint) || ' %' end as questions from f",
    "labelled_findings": f"{C} select severity, case severity when 'critical' then 'Critique' when 'high' then 'Élevé' when 'medium' then 'Moyen' when 'low' then 'Faible' else 'Info' end as label, count(*) as findings from fd group by all",
    "code_findings": f"with {_CODE_FIND}",
    "code_stacks": f"with {_CODE} select repo, stack, stack in ('next-app', 'next-pages', 'nuxt', 'remix', 'astro') as ssr, case when stack = 'react-spa' then case when has_router and package like '%\"vite\"%' then 'hash' else 'history' end end as router from cs",
    "code_roles": f"with {_CODE} select repo, " + ", ".join(f"sha256(coalesce({r}, '')) as {r}" for r in codebase.ROLES) + " from cs",
}
