"""The streaming jobs over the given tables: batch twins of the windows, and runs over all files that are there."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagelantern.operators.checkpoint import cut, scratch
from pagelantern.plans import history_queries, page_sql
from pagelantern.sources.tables import HTML, bound_pages, stream, table
from pagelantern.streaming import jobs

STATUS = "case when event_id % 7 = 0 and user_id % 3 <> 0 then 'completed' else 'started' end"
TS = "timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, cast(page_id as int))"
_STATE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _run(rows):
    """A query that runs a stream over what is there, in a session of its own: state with timers needs its own store setting."""

    def query(s, d):
        own = s.newSession()
        own.conf.set(*_STATE)
        with scratch(s, "streams") as folder:
            return cut(jobs.run_available(rows(own, d), folder))

    return query


def _events(s, d):
    return stream(s, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def _upsert(s, d):
    with scratch(s, "latest") as folder:
        rows = stream(s, d, "events").select("user_id", F.struct("ts", "event_id").alias("at"), "event_id", "value")
        jobs.upsert_batches(rows, f"{folder}/rows", ["user_id"], "at", f"{folder}/state").awaitTermination()
        return cut(jobs.latest_version(s, f"{folder}/rows").select("user_id", "event_id", "value"))


QUERIES = {
    "st_counts_by_day": lambda s, d: jobs.counts_by_day(table(s, d, "events")),
    "st_sliding_counts": lambda s, d: jobs.sliding_counts(table(s, d, "events")),
    "st_sessions": lambda s, d: jobs.sessions(table(s, d, "events")),
    "st_audit": _run(lambda s, d: jobs.continuous_audit(bound_pages(stream(s, d, "pages"))).select("page_id", "rule_id", "points")),
    "st_drift_alerts": _run(lambda s, d: jobs.drift_alerts(_events(s, d).select(F.col("user_id").alias("schedule_id"), "ts", F.round("value", 2).alias("score")))),
    "st_first_copies": _run(lambda s, d: jobs.first_copies(bound_pages(stream(s, d, "pages").withColumn("html", F.expr(HTML)), enriched=False).select("host", F.sha2("html", 256).alias("content_hash"), F.expr(TS).alias("ts"))).select("host", "content_hash")),
    "st_stalled_runs": _run(lambda s, d: jobs.stalled_runs(_events(s, d).select(F.col("user_id").alias("run_id"), "ts", F.expr(STATUS).alias("status")))),
    "st_with_plan": _run(lambda s, d: jobs.with_plan(_events(s, d).select("event_id", (F.col("user_id") % 25).alias("org_id")), history_queries._orgs(s, d).select("org_id", "plan"))),
    "st_upsert": _upsert,
}
SQL = {
    "st_counts_by_day": "select date_trunc('day', ts)::timestamp as day, event_type, count(*) as n, round(sum(value), 4) as value from events group by all",
    "st_sliding_counts": "select time_bucket(interval 10 minute, ts) - to_minutes(cast(10 * k as int)) as start, user_id, count(*) as n from events, range(6) r(k) group by all",
    "st_sessions": "with o as (select *, case when ts - lag(ts) over (partition by user_id order by ts) <= interval 30 minute then 0 else 1 end as s from events), g as (select *, sum(s) over (partition by user_id order by ts rows unbounded preceding) as k from o) select user_id, min(ts) as start, max(ts) + interval 30 minute as \"end\", count(*) as n from g group by user_id, k",
    "st_audit": f"with {page_sql.FINDINGS} select page_id, rule_id, points from fi",
    "st_drift_alerts": """with recursive r as (select user_id, ts, round(value, 2) as score, round(value, 2) - lag(round(value, 2)) over (partition by user_id order by ts) as delta from events),
      al as (select *, row_number() over (partition by user_id order by ts) as k from r where delta <= -10),
      nx as (select x.user_id, x.k, min(y.k) as nxt from al x left join al y on y.user_id = x.user_id and y.ts >= x.ts + interval 24 hour group by all),
      wk as (select user_id, k, nxt from nx where k = 1 union all select nx.user_id, nx.k, nx.nxt from wk join nx on nx.user_id = wk.user_id and nx.k = wk.nxt)
      select user_id as schedule_id, ts as at, score, round(delta, 4) as delta from al join (select user_id, k from wk) using (user_id, k)""",
    "st_first_copies": f"select distinct lower(regexp_extract(url, '^https?://([^/:?#]+)', 1)) as host, sha256({HTML}) as content_hash from pages",
    "st_stalled_runs": "with e as (select user_id, ts, event_id % 7 = 0 and user_id % 3 <> 0 as done from events) select user_id as run_id, max(ts) as started_at from e group by user_id having not bool_or(done) and max(ts) + interval 6 minute <= (select max(ts) - interval 1 minute from e)",
    "st_with_plan": "select event_id, user_id % 25 as org_id, case n_regionkey % 3 when 0 then 'free' when 1 then 'pro' else 'agency' end as plan from events join nation on n_nationkey = user_id % 25",
    "st_upsert": "select user_id, arg_max(event_id, (ts, event_id)) as event_id, arg_max(value, (ts, event_id)) as value from events group by user_id",
}
