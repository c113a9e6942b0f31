"""The audit for users of SQL: views of pages and findings, and table functions over them, all planned by Spark itself."""

from __future__ import annotations

from pyspark.sql import DataFrame

from pagelantern.operators import rules, scoring
from pagelantern.sources import features as fx

#: Table functions: name, parameters, and the query that they return.
FUNCTIONS = {
    "findings_of": ("asked STRING", "SELECT * FROM page_findings WHERE phase = asked OR asked = 'all'"),
    "findings_at_least": ("asked STRING", f"SELECT * FROM page_findings WHERE {{weight_severity}} >= {{weight_asked}}"),
    "worst_pages": ("most INT", "SELECT host, url, findings, points FROM (SELECT *, row_number() OVER (PARTITION BY host ORDER BY points DESC, url) AS place FROM (SELECT host, url, count(*) AS findings, round(sum(points), 1) AS points FROM page_findings GROUP BY host, url)) WHERE place <= most"),
}
FINDING = "page_id BIGINT, host STRING, url STRING, rule_id STRING, phase STRING, category STRING, severity STRING, points DOUBLE, effort STRING"
RETURNS = {"findings_of": FINDING, "findings_at_least": FINDING, "worst_pages": "host STRING, url STRING, findings BIGINT, points DOUBLE"}


def _weight(column: str) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{s}' THEN {w}" for s, w in scoring.SEVERITY.items()) + " ELSE 0 END"


def register(pages: DataFrame) -> None:
    """Registers in the session of pages (page_id, host, url, html, status, last_modified):

    views `page_features` and `page_findings`, and the table functions `findings_of(phase)` ('all': every phase),
    `findings_at_least(severity)` and `worst_pages(n)` (the n pages of each host that lose most). A function is a view with
    parameters: its filters reach the rules, and what a query does not ask for is not computed.
    """
    spark, features = pages.sparkSession, fx.page_features(pages)
    features.createOrReplaceTempView("page_features")
    columns = [c.split(" ")[0] for c in FINDING.split(", ")]
    rules.page_findings(rules.rule_inputs(features)).select(*columns).createOrReplaceTempView("page_findings")
    for name, (parameters, body) in FUNCTIONS.items():
        body = body.format(weight_severity=_weight("severity"), weight_asked=_weight("asked"))
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS TABLE ({RETURNS[name]}) RETURN {body}")
