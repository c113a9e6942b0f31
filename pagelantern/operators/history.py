"""Run-over-run comparison, drift, benchmarks, usage and quotas from audits (audit_id, org_id, target, status, mode, score, created_at)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagelantern.operators.scoring import round1, with_subject


def previous_runs(audits: DataFrame) -> DataFrame:
    """audit_id, previous_id, score, previous_score and delta of completed audits that have an earlier one of org and target."""
    w = Window.partitionBy("org_id", "target").orderBy("created_at", "audit_id")
    done = audits.where("status = 'completed'").withColumns({"previous_id": F.lag("audit_id").over(w), "previous_score": F.lag("score").over(w)})
    out = done.where("previous_id is not null")
    return out.select("audit_id", "org_id", "target", "created_at", "previous_id", "score", "previous_score", round1(F.col("score") - F.col("previous_score")).alias("delta"))


def days_between(a, b):
    """Whole days between two times, rounded, whichever is earlier; null if one is."""
    seconds = F.abs(F.unix_micros(a.cast("timestamp")) - F.unix_micros(b.cast("timestamp"))) / 1e6
    return F.floor(seconds / 86400 + 0.5).cast("long")


def run_gaps(audits: DataFrame) -> DataFrame:
    """audit_id, previous_id and days: how long after the run before it each compared run was made."""
    runs, at = previous_runs(audits), audits.select(F.col("audit_id").alias("previous_id"), F.col("created_at").alias("before"))
    return runs.join(at, "previous_id").select("audit_id", "previous_id", days_between(F.col("created_at"), F.col("before")).alias("days"))


def phase_deltas(scores: DataFrame, runs: DataFrame) -> DataFrame:
    """audit_id, phase, score, previous and delta; a phase that one run lacks counts as zero there."""
    now = scores.join(runs.select("audit_id", "previous_id"), "audit_id").select("audit_id", "phase", "score")
    before = runs.select(F.col("audit_id").alias("of"), F.col("previous_id").alias("audit_id")).join(scores, "audit_id").select(F.col("of").alias("audit_id"), "phase", F.col("score").alias("previous"))
    both = now.join(before, ["audit_id", "phase"], "full")
    zero = both.withColumns({"score": F.coalesce("score", F.lit(0.0)), "previous": F.coalesce("previous", F.lit(0.0))})
    return zero.withColumn("delta", round1(F.col("score") - F.col("previous")))


def with_key(findings: DataFrame) -> DataFrame:
    """findings with key: phase, subject (else title) and URL, what makes a finding the same in two runs, however it is worded."""
    about = F.coalesce("subject", F.concat(F.lit("t:"), F.substring(F.lower("title"), 1, 60)))
    return with_subject(findings).withColumn("key", F.concat_ws(":", "phase", about, F.coalesce("url", F.lit(""))))


def finding_deltas(findings: DataFrame, runs: DataFrame) -> DataFrame:
    """audit_id, key and change (introduced, resolved, persistent) against the previous run."""
    # a run's findings are its own and, a second time, those before of the run that follows it: one join, then one aggregation
    own = runs.select("audit_id", F.lit(True).alias("now"), F.col("audit_id").alias("of"))
    roles = own.unionByName(runs.select(F.col("previous_id").alias("audit_id"), F.lit(False).alias("now"), F.col("audit_id").alias("of")))
    told = with_key(findings).select("audit_id", "key").join(roles, "audit_id").groupBy(F.col("of").alias("audit_id"), "key")
    seen = told.agg(F.bool_or("now").alias("here"), F.bool_or(~F.col("now")).alias("there"))
    change = F.when(~F.col("here"), "resolved").when(~F.col("there"), "introduced").otherwise("persistent")
    return seen.select("audit_id", "key", change.alias("change"))


def ordered_deltas(deltas: DataFrame) -> DataFrame:
    """deltas with their place in the audit by size and by fall."""
    by = lambda *cols: F.row_number().over(Window.partitionBy("audit_id").orderBy(*cols, "phase"))
    return deltas.withColumns({"by_size": by(F.desc(F.abs("delta"))), "by_fall": by("delta")})


def drift_report(alerts: DataFrame, deltas: DataFrame) -> DataFrame:
    """audit_id, delta and the phases that fell, the worst first, of each drift alert."""
    fell = deltas.where("delta < 0").groupBy("audit_id").agg(F.sort_array(F.collect_list(F.struct("delta", "phase"))).alias("fell"))  # ten phases at most
    names = F.array_join(F.transform("fell", lambda x: F.concat_ws(" ", x["phase"], F.format_number(x["delta"], 1))), ", ")
    return alerts.join(fell, "audit_id", "left").select("audit_id", "delta", F.coalesce(names, F.lit("")).alias("phases"))


def benchmark_rows(urls: DataFrame, audits: DataFrame, scores: DataFrame) -> DataFrame:
    """benchmark_id, target, is_reference, audit_id, phase and score; a URL without an audit stays with nulls."""
    runs = scores.join(audits.select("audit_id", "status"), "audit_id")
    return urls.join(runs, "audit_id", "left").select("benchmark_id", "target", "is_reference", "audit_id", "status", "phase", "score")


def validated_benchmarks(urls: DataFrame) -> DataFrame:
    """benchmark_id, n and reason (null if valid) of benchmarks (benchmark_id, url, label, is_reference): 2 to 5 URLs, one of them the reference."""
    g = urls.groupBy("benchmark_id").agg(F.count("*").alias("n"), F.count_if("is_reference").alias("references"), F.bool_or(~F.col("url").rlike("^https?://") | (F.length("url") > 2048)).alias("bad_url"), F.bool_or(~F.length("label").between(1, 100)).alias("bad_label"))
    reason = F.when(F.col("n") < 2, "too few").when(F.col("n") > 5, "too many").when(F.col("references") != 1, "reference").when(F.col("bad_url"), "url").when(F.col("bad_label"), "label")
    return g.select("benchmark_id", "n", reason.alias("reason"))


def audits_in_org(audits: DataFrame, asked: DataFrame) -> DataFrame:
    """Audits that are asked for (audit_id, org_id) by the organization that owns them."""
    return audits.join(asked.distinct(), ["audit_id", "org_id"], "left_semi")


def valid_domain(domain):
    """Whether a text is a domain name of at most 253 characters."""
    return domain.rlike(r"^[a-zA-Z0-9]([a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?(\.[a-zA-Z]{2,})+$") & (F.length(domain) <= 253)


def due_with_plan(schedules: DataFrame, orgs: DataFrame, audits: DataFrame, as_of: str, n: int = 20) -> DataFrame:
    """Due schedules with the mode that their organization's plan allows and the organization's latest completed audit."""
    last = audits.where("status = 'completed'").groupBy("org_id").agg(F.max_by("audit_id", F.struct("created_at", "audit_id")).alias("previous_id"))
    rows = due(schedules, as_of, n).join(orgs.select("org_id", "plan"), "org_id", "left").join(last, "org_id", "left")
    return rows.withColumn("mode", F.when(F.col("plan") == "free", "flash").otherwise("full"))


def drift(runs: DataFrame, threshold: float = 10.0) -> DataFrame:
    """Runs whose score fell by the threshold or more."""
    return runs.where(F.col("delta") <= -threshold)


def suppressed_alerts(runs: DataFrame, threshold: float = 10.0, hours: int = 24) -> DataFrame:
    """Drift alerts, at most one in `hours` for an org and target; a suppressed alert does not restart the clock.

    Whether an alert counts depends on the one before it, so each target's alerts are walked in order, as a stream: Spark
    sorts them, with spilling, and a task holds one batch, however many alerts a target has. An alert without a time
    comes last, and counts only as the first of its target.
    """
    import pandas as pd

    def walk(batches):
        last, gap = None, pd.Timedelta(hours=hours)
        for rows in batches:
            keep = []
            for first, at in zip(rows["first"], rows["created_at"]):
                keep.append(bool(first or at - last >= gap))
                last = at if keep[-1] else last
            yield rows[keep].drop(columns="first")

    alerts = drift(runs, threshold).select("org_id", "target", "audit_id", "created_at", "delta")
    order = Window.partitionBy("org_id", "target").orderBy(F.asc_nulls_last("created_at"), "audit_id")
    return alerts.withColumn("first", F.row_number().over(order) == 1).mapInPandas(walk, alerts.schema)


def benchmark(scores: DataFrame, audits: DataFrame, labels: list[str]) -> DataFrame:
    """phase and, for each label (mode), the mean score, with the best and worst of them."""
    joined = scores.join(audits.select("audit_id", "mode"), "audit_id")
    wide = joined.groupBy("phase").pivot("mode", labels).agg(F.round(F.avg("score"), 6))
    return wide.withColumns({"best": F.greatest(*labels), "worst": F.least(*labels)})


def benchmark_status(audits: DataFrame) -> DataFrame:
    """target, finished (no run is open) and usable (some run completed)."""
    return audits.groupBy("target").agg(F.bool_and(F.col("status").isin("completed", "failed")).alias("finished"), F.bool_or(F.col("status") == "completed").alias("usable"))


def usage_by_month(audits: DataFrame) -> DataFrame:
    return audits.where("status <> 'failed'").groupBy("org_id", F.date_trunc("month", "created_at").alias("month")).agg(F.count("*").alias("audits"))


def usage_by_day(audits: DataFrame) -> DataFrame:
    return audits.groupBy("org_id", F.to_date("created_at").alias("day")).agg(F.count("*").alias("audits"))


def quota(audits: DataFrame, orgs: DataFrame, as_of: str, open_limit: int = 3) -> DataFrame:
    """org_id, used (this month), running, monthly limit and decision for every organization (org_id, plan, monthly)."""
    month = F.date_trunc("month", F.lit(as_of).cast("timestamp"))
    counts = audits.groupBy("org_id").agg(F.count_if(F.date_trunc("month", "created_at") == month).alias("used"), F.count_if(F.col("status").isin("queued", "running")).alias("open"))
    out = orgs.join(counts, "org_id", "left").na.fill(0, ["used", "open"])
    decision = F.when(F.col("used") >= F.col("monthly"), "quota").when(F.col("open") >= open_limit, "busy").otherwise("allowed")
    return out.select("org_id", "plan", "monthly", "used", "open", decision.alias("decision"))


def due(schedules: DataFrame, as_of: str, n: int = 20) -> DataFrame:
    """The n schedules longest due (schedule_id, org_id, next_run_at, active)."""
    return schedules.where(F.col("active") & (F.col("next_run_at") <= F.lit(as_of).cast("timestamp"))).orderBy("next_run_at", "schedule_id").limit(n)


def next_run(at, frequency):
    """The following run: a day, a week or a month later (the last day of a shorter month)."""
    return F.when(frequency == "daily", at + F.expr("interval 1 day")).when(frequency == "weekly", at + F.expr("interval 7 days")).otherwise(F.add_months(at, 1).cast("timestamp"))


def page(rows: DataFrame, order: list, offset: int, limit: int) -> DataFrame:
    """A page of rows in order, with the total number of rows."""
    total = rows.agg(F.count("*").alias("total"))
    return rows.orderBy(*order).offset(offset).limit(limit).crossJoin(F.broadcast(total))  # the total is one row


def pages_by(rows: DataFrame, by: str, order: list, size: int) -> DataFrame:
    """rows with the page of its group that each lies on (from 1), its place, and the group's total, for all groups at once."""
    total = rows.groupBy(by).agg(F.count("*").alias("total"))
    placed = rows.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(*order)))
    return placed.join(total, by).withColumn("page", F.ceil(F.col("place") / size).cast("int"))


def newest(rows: DataFrame, by: str, order: list) -> DataFrame:
    """rows with their place in their group, the newest first."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(*order)))


def sliding_rate(requests: DataFrame, limit: int = 3) -> DataFrame:
    """event_id, org_id, n (requests of the org in the hour up to this one) and allowed.

    A request also counts in the clock hour after its own, so a window never spans more than two hours of an organization.
    """
    hour = F.date_trunc("hour", "ts")
    both = F.array(F.struct(hour.alias("hour"), F.lit(True).alias("own")), F.struct((hour + F.expr("interval 1 hour")).alias("hour"), F.lit(False).alias("own")))
    spread = requests.select("event_id", "org_id", "ts", F.explode(both).alias("x")).select("event_id", "org_id", "ts", "x.*")
    w = Window.partitionBy("org_id", "hour").orderBy(F.unix_micros(F.col("ts").cast("timestamp"))).rangeBetween(-3_600_000_000, 0)
    return spread.withColumn("n", F.count("*").over(w)).where("own").select("event_id", "org_id", "n").withColumn("allowed", F.col("n") <= limit)


def upsert(old: DataFrame, new: DataFrame, keys: list[str], keep_old: bool = False) -> DataFrame:
    """Rows of both, one for each key: the new one, or the old one if keep_old."""
    first, second = (old, new) if keep_old else (new, old)
    return first.unionByName(second.join(first, keys, "left_anti"))
