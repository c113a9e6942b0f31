"""Named queries over audit history: scores, reports, comparison, usage."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagelantern.operators import history, scoring, synthesis
from pagelantern.sources import history as src

AS_OF = "2024-01-15 00:00:00"


def _a(s, d):
    return src.audits(s, d)


def _f(s, d):
    return src.findings(s, d)


def _ps(s, d):
    return scoring.phase_scores(_a(s, d), _f(s, d), src.rubric(s))


def _runs(s, d):
    return history.previous_runs(_a(s, d))


def _orgs(s, d):
    n = s.read.parquet(f"{d}/nation.parquet")
    return n.selectExpr("cast(n_nationkey as bigint) as org_id", "n_name as name", "case n_regionkey % 3 when 0 then 'free' when 1 then 'pro' else 'agency' end as plan", "case n_regionkey % 3 when 0 then 5 when 1 then 50 else 500 end as monthly")


def _schedules(s, d):
    return s.read.parquet(f"{d}/customer.parquet").selectExpr("c_custkey as schedule_id", "c_nationkey as org_id", "timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, cast(c_custkey % 30 as int)) as next_run_at", "c_acctbal > 0 as active", "case c_custkey % 3 when 0 then 'daily' when 1 then 'weekly' else 'monthly' end as frequency")


_TOP = ["audit_id", "rank", "n", "phase", "severity", "points"]
QUERIES = {
    "phase_scores": _ps,
    "audit_scores": lambda s, d: scoring.audit_scores(_ps(s, d)),
    "score_levels": lambda s, d: scoring.audit_scores(_ps(s, d)).groupBy(scoring.level(F.col("total")).alias("level")).agg(F.count("*").alias("audits")),
    "score_breakdown": lambda s, d: scoring.breakdown(_ps(s, d)).select("audit_id", F.expr("array_join(transform(array_sort(map_entries(breakdown)), e -> concat(e.key, '=', cast(cast(round(e.value * 10) as bigint) as string))), ',')").alias("breakdown")),
    "mode_scores": lambda s, d: scoring.mode_scores(_ps(s, d)),
    "severity_counts": lambda s, d: scoring.severity_counts(_f(s, d)),
    "kpis": lambda s, d: scoring.kpis(_f(s, d)),
    "hotspots": lambda s, d: scoring.hotspots(_f(s, d)),
    "top_issues": lambda s, d: scoring.top(scoring.deduplicated(_f(s, d).where("severity <> 'info' and points > 0")), 5).select(*_TOP, "subject", "merged"),
    "top_critical": lambda s, d: scoring.top(_f(s, d).where("severity in ('critical', 'high')"), 3).select(*_TOP),
    "semantic_dedup": lambda s, d: scoring.deduplicated(_f(s, d)).select("audit_id", "subject", "n", "points", "merged"),
    "roadmap": lambda s, d: scoring.roadmap(_f(s, d)).select("audit_id", "effort", "place", "n", "points"),
    "sprint_totals": lambda s, d: scoring.roadmap(_f(s, d)).groupBy("audit_id", "effort").agg(scoring.round1(F.sum("points")).alias("points")),
    "strengths_weaknesses": lambda s, d: scoring.extremes(_ps(s, d)),
    "weak_phases": lambda s, d: scoring.weak_phases(_ps(s, d)),
    "severity_rollup": lambda s, d: scoring.rollup(_a(s, d), _f(s, d)),
    "synthesis": lambda s, d: synthesis.synthesis(_a(s, d), _f(s, d), _ps(s, d)),
    "previous_run": _runs,
    "phase_delta": lambda s, d: history.phase_deltas(_ps(s, d), _runs(s, d)),
    "finding_delta": lambda s, d: history.finding_deltas(_f(s, d), _runs(s, d)),
    "drift": lambda s, d: history.drift(_runs(s, d)),
    "drift_alerts_24h": lambda s, d: history.suppressed_alerts(_runs(s, d)),
    "benchmark_pivot": lambda s, d: history.benchmark(_ps(s, d), _a(s, d), ["flash", "full", "standard"]),
    "benchmark_status": lambda s, d: history.benchmark_status(_a(s, d)),
    "usage_month": lambda s, d: history.usage_by_month(_a(s, d)),
    "usage_by_day": lambda s, d: history.usage_by_day(_a(s, d)),
    "quota_decision": lambda s, d: history.quota(_a(s, d), _orgs(s, d), "1996-03-10 00:00:00"),
    "due_schedules": lambda s, d: history.due(_schedules(s, d), AS_OF).select("schedule_id", "org_id", "next_run_at", history.next_run(F.col("next_run_at"), F.col("frequency")).alias("then_at")),
    "sliding_rate": lambda s, d: history.sliding_rate(src.requests(s, d)),
    "status_counts": lambda s, d: _a(s, d).groupBy("org_id").agg(F.count("*").alias("audits"), F.count_if(F.col("status") == "completed").alias("done"), F.round(F.count_if(F.col("status") == "completed") / F.count("*"), 6).alias("share")),
    "org_members": lambda s, d: _orgs(s, d).join(s.read.parquet(f"{d}/customer.parquet").groupBy(F.col("c_nationkey").cast("bigint").alias("org_id")).agg(F.count("*").alias("members")), "org_id", "left").select("org_id", "name", "plan", F.coalesce("members", F.lit(0)).alias("members")),
    "plan_counts": lambda s, d: _orgs(s, d).groupBy("plan").agg(F.count("*").alias("orgs")),
    "platform_totals": lambda s, d: s.createDataFrame([], "kind string, n bigint").unionByName(_orgs(s, d).agg(F.count("*").alias("n")).select(F.lit("orgs").alias("kind"), "n")).unionByName(_a(s, d).agg(F.count("*").alias("n")).select(F.lit("audits").alias("kind"), "n")).unionByName(s.read.parquet(f"{d}/customer.parquet").agg(F.count("*").alias("n")).select(F.lit("users").alias("kind"), "n")),
    "admin_audits": lambda s, d: _a(s, d).join(_orgs(s, d), "org_id").join(s.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("user_id"), "c_name"), "user_id").select("audit_id", "name", "plan", "c_name", "status", "score", "created_at").orderBy(F.desc("created_at"), "audit_id").limit(100),
    "audit_page": lambda s, d: history.page(_a(s, d).where("status = 'completed' and org_id = 7"), [F.desc("score"), "audit_id"], 10, 20).select("audit_id", "score", "created_at", "total"),
    "member_search": lambda s, d: s.read.parquet(f"{d}/customer.parquet").where(F.col("c_name").ilike("%00012%") | F.lower("c_mktsegment").contains("build")).select("c_custkey", "c_name", "c_mktsegment"),
}

_PS = f"""{src.CTES}, lo as (select audit_id, phase, sum(points) as lost from fd group by all),
ps as (select a.audit_id, ru.phase, floor(greatest(0.0, score_max - coalesce(lost, 0.0)) * 10 + 0.5) / 10 as score, score_max from a cross join ru left join lo on lo.audit_id = a.audit_id and lo.phase = ru.phase)"""
_T = "select audit_id, floor(sum(score) / nullif(sum(score_max), 0) * 100 * 10 + 0.5) / 10 as total from ps group by audit_id"
_RUNS = """pv as (select *, lag(audit_id) over w as previous_id, lag(score) over w as previous_score from a where status = 'completed' window w as (partition by org_id, target order by created_at, audit_id)),
pr as (select audit_id, org_id, target, created_at, previous_id, score, previous_score, floor((score - previous_score) * 10 + 0.5) / 10 as delta from pv where previous_id is not null)"""
_W = "case severity when 'critical' then 5 when 'high' then 4 when 'medium' then 3 when 'low' then 2 when 'info' then 1 else 0 end"
#: What each recommendation of the bound findings is about.
_SUB = """case recommendation when 'Add a canonical link' then 'canonical' when 'Fix the canonical URL' then 'canonical' when 'Publish llms.txt and llms-full.txt' then 'llms-full.txt' when 'Declare the sitemap.xml' then 'sitemap.xml' when 'Fill the Open Graph title' then 'og-meta' when 'Reduce LCP' then 'web-vital-lcp' when 'Link to Wikidata' then 'wikidata'
 when 'Corriger la chaîne de redirections' then 'redirect-chain' when 'Ajouter datePublished' then 'datepublished' when 'Compléter le schéma Organization de la page' then 'schema-organization' when 'Contenu mixte à corriger' then 'mixed-content' else 'rewrite the text' end"""
_DD = f"select * from (select *, {_SUB} as subject, count(*) over (partition by audit_id, {_SUB}) as merged, row_number() over (partition by audit_id, {_SUB} order by points desc, {_W} desc, n) as place_ from {{}}) where place_ = 1"
_TOPQ = f"select *, row_number() over (partition by audit_id order by {_W} desc, points desc, n) as rank from ({{}})"
_ROAD = "select * from (select *, row_number() over (partition by audit_id, effort order by points desc, n) as place from fd where severity <> 'info' and points > 0) where place <= case effort when 'heavy' then 4 else 5 end"
_ORGS = "og as (select cast(n_nationkey as bigint) as org_id, n_name as name, case n_regionkey % 3 when 0 then 'free' when 1 then 'pro' else 'agency' end as plan, case n_regionkey % 3 when 0 then 5 when 1 then 50 else 500 end as monthly from nation)"
_C, _FLASH, _STD = f"with {src.CTES} ", ", ".join(f"'{p}'" for p in scoring.MODES["flash"]), ", ".join(f"'{p}'" for p in scoring.MODES["standard"])
# every phase of both runs is there: the scores of a run are joined one to one
_DELTA = "pdl as (select pr.audit_id, x.phase, x.score as score, y.score as previous, floor((x.score - y.score) * 10 + 0.5) / 10 as delta from pr join ps x on x.audit_id = pr.audit_id join ps y on y.audit_id = pr.previous_id and y.phase = x.phase)"
SQL = {
    "phase_scores": f"with {_PS} select * from ps",
    "audit_scores": f"with {_PS} {_T}",
    "score_levels": f"with {_PS} select case when total >= 80 then 'excellent' when total >= 60 then 'good' when total >= 40 then 'fair' else 'poor' end as level, count(*) as audits from ({_T}) group by all",
    "score_breakdown": f"with {_PS} select audit_id, string_agg(phase || '=' || cast(cast(round(score * 10) as bigint) as varchar), ',' order by phase) as breakdown from ps group by audit_id",
    "mode_scores": f"with {_PS} select audit_id, mode, floor(sum(score) / sum(score_max) * 100 * 10 + 0.5) / 10 as total from ps, (values ('full'), ('standard'), ('flash')) m(mode) where mode = 'full' or (mode = 'standard' and phase in ({_STD})) or (mode = 'flash' and phase in ({_FLASH})) group by audit_id, mode",
    "severity_counts": _C + "select audit_id, " + ", ".join(f"count(*) filter (severity = '{s}') as {s}" for s in scoring.SEVERITY) + " from fd group by audit_id",
    "kpis": _C + """select audit_id, count(*) filter (severity = 'critical') as critical, count(*) filter (severity = 'high') as high, count(*) filter (effort = 'quick' and points >= 0.5) as quick_wins,
      floor(coalesce(sum(points) filter (effort = 'quick' and points >= 0.5), 0) * 10 + 0.5) / 10 as quick_points,
      cast(floor(coalesce(sum(points) filter (severity <> 'info'), 0) * 0.4 + 0.5) as bigint) as gain_low, cast(floor(coalesce(sum(points) filter (severity <> 'info'), 0) * 0.8 + 0.5) as bigint) as gain_high from fd group by audit_id""",
    "hotspots": _C + "select audit_id, url, count(*) as findings, count(distinct phase) as phases, floor(sum(points) * 10 + 0.5) / 10 as points from fd group by audit_id, url having count(*) >= 3 and count(distinct phase) >= 2",
    "top_issues": _C + f"select audit_id, rank, n, phase, severity, points, subject, merged from ({_TOPQ.format(_DD.format("(select * from fd where severity <> 'info' and points > 0)"))}) where rank <= 5",
    "top_critical": _C + f"select audit_id, rank, n, phase, severity, points from ({_TOPQ.format("select * from fd where severity in ('critical', 'high')")}) where rank <= 3",
    "semantic_dedup": _C + f"select audit_id, subject, n, points, merged from ({_DD.format('fd')})",
    "roadmap": _C + f"select audit_id, effort, place, n, points from ({_ROAD})",
    "sprint_totals": _C + f"select audit_id, effort, floor(sum(points) * 10 + 0.5) / 10 as points from ({_ROAD}) group by all",
    "strengths_weaknesses": f"with {_PS}, r as (select audit_id, phase, round(score / score_max, 6) as ratio from ps), x as (select *, row_number() over (partition by audit_id order by ratio desc, phase) as best, row_number() over (partition by audit_id order by ratio, phase) as worst from r) select * from x where best <= 3 or worst <= 3",
    "weak_phases": f"with {_PS} select audit_id, count(*) as weak, string_agg(phase, ',' order by phase) as phases from ps where score < 0.5 * score_max group by audit_id having count(*) >= 3",
    "severity_rollup": _C + "select org_id, phase, severity, count(*) as findings, floor(sum(points) * 10 + 0.5) / 10 as points from fd join a using (audit_id) group by rollup (org_id, phase, severity)",
    "synthesis": f"""with {_PS}, h as (select audit_id, count(*) as hot from (select audit_id, url from fd group by audit_id, url having count(*) >= 3 and count(distinct phase) >= 2) group by audit_id),
      k as (select audit_id, count(*) as weak from ps where score < 0.5 * score_max group by audit_id),
      g as (select audit_id, count(*) filter (severity in ('critical', 'high')) as grave, count(*) filter (effort = 'quick' and points >= 0.5) as quick, count(*) as n from fd group by audit_id),
      w as (select a.audit_id, coalesce(grave, 0) as grave, coalesce(quick, 0) as quick, coalesce(n, 0) as n, coalesce(hot, 0) as hot, coalesce(weak, 0) as weak from a left join g using (audit_id) left join h using (audit_id) left join k using (audit_id))
      select audit_id, 'Y01' as rule_id, 'critical' as severity, grave as metric from w where grave >= 1 union all select audit_id, 'Y02', 'info', quick from w where quick >= 3
      union all select audit_id, 'Y03', 'high', hot from w where hot >= 1 union all select audit_id, 'Y04', 'high', weak from w where weak >= 3 union all select audit_id, 'Y05', 'info', n from w""",
    "previous_run": _C + f", {_RUNS} select * from pr",
    "phase_delta": f"with {_PS}, z as (select a.audit_id, phase, ps.score as score, lag(ps.score) over w as previous from ps join a on a.audit_id = ps.audit_id where status = 'completed' window w as (partition by org_id, target, phase order by created_at, a.audit_id)) select *, floor((score - previous) * 10 + 0.5) / 10 as delta from z where previous is not null",
    "drift_alerts_24h": _C.replace("with ", "with recursive ", 1) + f""", {_RUNS}, al as (select *, row_number() over (partition by org_id, target order by created_at, audit_id) as k from pr where delta <= -10),
      nx as (select x.org_id, x.target, x.k, min(y.k) as nxt from al x left join al y on x.org_id = y.org_id and x.target = y.target and y.created_at >= x.created_at + interval 24 hour group by all),
      wk as (select org_id, target, k, nxt from nx where k = 1 union all select nx.org_id, nx.target, nx.k, nx.nxt from wk join nx on nx.org_id = wk.org_id and nx.target = wk.target and nx.k = wk.nxt)
      select org_id, target, audit_id, created_at, delta from al join (select org_id, target, k from wk) using (org_id, target, k)""",
    "finding_delta": _C + f", {_RUNS}, k as (select distinct audit_id, phase || ':' || case when recommendation = 'Rewrite the text' then 't:' || lower(title) else {_SUB} end || ':' || url as key from fd), x as (select pr.audit_id, key, 1 as here from pr join k on k.audit_id = pr.audit_id), y as (select pr.audit_id, key, 1 as there from pr join k on k.audit_id = pr.previous_id) select audit_id, key, case when here is null then 'resolved' when there is null then 'introduced' else 'persistent' end as change from x full join y using (audit_id, key)",
    "drift": _C + f", {_RUNS} select * from pr where delta <= -10",
    "benchmark_pivot": f"with {_PS}, m as (select phase, mode, round(avg(ps.score), 6) as s from ps join a using (audit_id) group by all), w as (select phase, {', '.join(f"max(s) filter (mode = '{x}') as {x}" for x in ('flash', 'full', 'standard'))} from m group by phase) select *, greatest(flash, \"full\", standard) as best, least(flash, \"full\", standard) as worst from w".replace("as full,", 'as "full",'),
    "benchmark_status": _C + "select target, bool_and(status in ('completed', 'failed')) as finished, bool_or(status = 'completed') as usable from a group by target",
    "usage_month": _C + "select org_id, cast(date_trunc('month', created_at) as timestamp) as month, count(*) as audits from a where status <> 'failed' group by all",
    "usage_by_day": _C + "select org_id, cast(created_at as date) as day, count(*) as audits from a group by all",
    "quota_decision": _C + f", {_ORGS}, u as (select org_id, count(*) filter (date_trunc('month', created_at) = timestamp '1996-03-01') as used, count(*) filter (status in ('queued', 'running')) as open from a group by org_id) select org_id, plan, monthly, coalesce(used, 0) as used, coalesce(open, 0) as open, case when coalesce(used, 0) >= monthly then 'quota' when coalesce(open, 0) >= 3 then 'busy' else 'allowed' end as decision from og left join u using (org_id)",
    "due_schedules": "with s as (select c_custkey as schedule_id, c_nationkey as org_id, timestamp '2024-01-01' + to_days(cast(c_custkey % 30 as int)) as next_run_at, c_acctbal > 0 as active, c_custkey % 3 as k from customer) select schedule_id, org_id, next_run_at, case k when 0 then next_run_at + interval 1 day when 1 then next_run_at + interval 7 day else next_run_at + interval 1 month end as then_at from s where active and next_run_at <= timestamp '2024-01-15' order by next_run_at, schedule_id limit 20",
    "sliding_rate": _C + "select event_id, org_id, count(*) over (partition by org_id order by ts range between interval 1 hour preceding and current row) as n, count(*) over (partition by org_id order by ts range between interval 1 hour preceding and current row) <= 3 as allowed from rq",
    "status_counts": _C + "select org_id, count(*) as audits, count(*) filter (status = 'completed') as done, round(count(*) filter (status = 'completed') / count(*), 6) as share from a group by org_id",
    "org_members": f"with {_ORGS} select org_id, name, plan, count(c_custkey) as members from og left join customer on c_nationkey = org_id group by all",
    "plan_counts": f"with {_ORGS} select plan, count(*) as orgs from og group by plan",
    "platform_totals": "select 'orgs' as kind, count(*) as n from nation union all select 'audits', count(*) from orders union all select 'users', count(*) from customer",
    "admin_audits": _C + f", {_ORGS} select audit_id, name, plan, c_name, status, score, created_at from a join og using (org_id) join customer on c_custkey = user_id order by created_at desc, audit_id limit 100",
    "audit_page": _C + "select audit_id, score, created_at, count(*) over () as total from a where status = 'completed' and org_id = 7 order by score desc, audit_id limit 20 offset 10",
    "member_search": "select c_custkey, c_name, c_mktsegment from customer where c_name ilike '%00012%' or lower(c_mktsegment) like '%build%'",
}
