"""Audit history bound to the given tables: orders are audits, line items their findings, nations organizations.

Columns are SQL text that Spark and the comparison engine both run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelantern.operators.rules import PHASES
from pagelantern.sources.tables import table

_PHASE = "case l_partkey % 10 " + " ".join(f"when {k} then '{p}'" for k, (p, _) in enumerate(PHASES)) + " end"
_MAX = "case phase " + " ".join(f"when '{p}' then cast({m} as double)" for p, m in PHASES) + " end"
RUBRIC = ", ".join(f"('{p}', {k}, cast({m} as double))" for k, (p, m) in enumerate(PHASES))

AUDITS = [
    "o_orderkey as audit_id", "o_custkey % 25 as org_id", "o_custkey as user_id", "concat('site', cast(o_custkey % 200 as string), '.example') as target",
    "case o_orderstatus when 'F' then 'completed' when 'O' then 'queued' else 'running' end as status",
    "case o_orderkey % 3 when 0 then 'flash' when 1 then 'standard' else 'full' end as mode",
    "round(o_totalprice - 100.0 * floor(o_totalprice / 100.0), 1) as score", "o_orderdate as created_at",
]
FINDINGS = [
    "l_orderkey as audit_id", "cast(l_linenumber as bigint) * 1000000000 + l_partkey * 1000 + l_suppkey as n", f"{_PHASE} as phase",
    "case when l_quantity < 5 then 'critical' when l_quantity < 15 then 'high' when l_quantity < 28 then 'medium' when l_quantity < 43 then 'low' else 'info' end as severity",
    "case l_returnflag when 'A' then 'quick' when 'N' then 'medium' else 'heavy' end as effort",
    "floor(l_discount * 100 + 0.5) * (1 + l_linenumber % 3) / 4 as points", "concat('/p', cast(l_suppkey % 4 as string)) as url",
    "concat('Check ', cast(l_partkey % 40 as string)) as title",
    "case l_partkey % 12 when 0 then 'Add a canonical link' when 1 then 'Publish llms.txt and llms-full.txt' when 2 then 'Declare the sitemap.xml' when 3 then 'Fill the Open Graph title' when 4 then 'Reduce LCP' when 5 then 'Link to Wikidata' when 6 then 'Corriger la chaîne de redirections' when 7 then 'Ajouter datePublished' when 8 then 'Compléter le schéma Organization de la page' when 9 then 'Contenu mixte à corriger' when 10 then 'Fix the canonical URL' else 'Rewrite the text' end as recommendation",
]
REQUESTS = ["event_id", "user_id as org_id", "ts", "event_type as status", "value as score"]


def audits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr(*AUDITS)


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr(*FINDINGS)


def store(audits_: DataFrame, findings_: DataFrame, folder: str, parts: int = 32) -> None:
    """Writes audits and their findings under a folder in partitions by the hash of their organization.

    Findings get their audit's org_id, so a tenant's reads open its partition of both tables and nothing else.
    """
    part = F.pmod(F.xxhash64("org_id"), F.lit(parts)).cast("int").alias("part")
    owned = findings_.join(audits_.select("audit_id", "org_id"), "audit_id")
    for name, rows in (("audits", audits_), ("findings", owned)):
        # each partition goes to several tasks, so that one large tenant is no single task
        dealt = rows.select("*", part).withColumn("deal_", F.pmod(F.xxhash64("audit_id"), F.lit(4)))
        dealt.repartition("part", "deal_").drop("deal_").write.mode("overwrite").partitionBy("part").parquet(f"{folder}/{name}")


def of_orgs(spark: SparkSession, folder: str, name: str, orgs: list[int], parts: int = 32) -> DataFrame:
    """The stored rows of some organizations: partitions are chosen when the query is planned, by the ids' hashes."""
    wanted = spark.createDataFrame([(o,) for o in orgs], "org_id long").select(F.pmod(F.xxhash64("org_id"), F.lit(parts)).cast("int").alias("part"))
    chosen = sorted({r["part"] for r in wanted.collect()})
    return spark.read.parquet(f"{folder}/{name}").where(F.col("part").isin(chosen) & F.col("org_id").isin(list(orgs))).drop("part")


def of_plan(spark: SparkSession, folder: str, name: str, orgs: DataFrame, parts: int = 32) -> DataFrame:
    """The stored rows of the organizations in a table (org_id, ...), with its columns: partitions are pruned while the query runs."""
    asked = orgs.withColumn("part", F.pmod(F.xxhash64("org_id"), F.lit(parts)).cast("int"))
    return spark.read.parquet(f"{folder}/{name}").join(asked, ["part", "org_id"]).drop("part")


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(*REQUESTS)


def rubric(spark: SparkSession) -> DataFrame:
    return spark.sql(f"select * from values {RUBRIC} as r(phase, phase_order, score_max)")


CTES = f"""a as (select {', '.join(AUDITS)} from orders), fd as (select {', '.join(FINDINGS)} from lineitem),
rq as (select {', '.join(REQUESTS)} from events), ru as (select * from (values {RUBRIC}) r(phase, phase_order, score_max))"""
