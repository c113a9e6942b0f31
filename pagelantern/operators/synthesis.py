"""Findings over findings: what an audit's other findings amount to."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelantern.operators import scoring


def synthesis(audits: DataFrame, findings: DataFrame, scores: DataFrame) -> DataFrame:
    """audit_id, rule_id, severity and metric of the five unscored rules: grave findings, quick wins, hot URLs, weak phases, breakdown."""
    f = findings.groupBy("audit_id").agg(
        F.count_if(F.col("severity").isin("critical", "high")).alias("grave"),
        F.count_if((F.col("effort") == "quick") & (F.col("points") >= 0.5)).alias("quick"),
        F.count("*").alias("n"),
    )
    hot = scoring.hotspots(findings).groupBy("audit_id").agg(F.count("*").alias("hot"))
    weak = scores.where("score < 0.5 * score_max").groupBy("audit_id").agg(F.count("*").alias("weak"))
    wide = audits.select("audit_id").join(f, "audit_id", "left").join(hot, "audit_id", "left").join(weak, "audit_id", "left").na.fill(0)
    rules = [("Y01", "critical", "grave", "grave >= 1"), ("Y02", "info", "quick", "quick >= 3"), ("Y03", "high", "hot", "hot >= 1"), ("Y04", "high", "weak", "weak >= 3"), ("Y05", "info", "n", "true")]
    made = [F.expr(f"case when {when} then named_struct('rule_id', '{i}', 'severity', '{s}', 'metric', {m}) end") for i, s, m, when in rules]
    return wide.select("audit_id", F.explode(F.array_compact(F.array(*made))).alias("r")).select("audit_id", "r.*")
