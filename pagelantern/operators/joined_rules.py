"""Page rules that need a second table: freshness, field metrics, entity catalogue, link status."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagelantern.functions import text, urls
from pagelantern.operators import rules


def _broken(df: DataFrame, keys: list[str], rules: list[tuple]) -> DataFrame:
    """A row for each rule (id, severity, points, predicate) that a row of df breaks."""
    made = [F.expr(f"case when {when} then named_struct('rule_id', '{i}', 'severity', {s}, 'points', cast({p} as double)) end") for i, s, p, when in rules]
    return df.select(*keys, F.explode(F.array_compact(F.array(*made))).alias("f")).select(*keys, "f.*")


FRESHNESS = [
    ("F01", "'medium'", "1.5", "newest is null"),
    ("F02", "case when page_kind = 'landing' then 'medium' else 'low' end", "case when page_kind in ('landing', 'product') then 2 else 1 end", "age > tolerance"),
    ("F03", "'medium'", "1.5", "ld_age < 30 and http_age > 180"),
    ("F06", "'low'", "1", "abs(gap) > 30"),
]


def freshness(inputs: DataFrame, entries: DataFrame, as_of: str) -> DataFrame:
    """page_id, kind, newest date, age in days and the freshness rules broken; entries: sitemap_entries.

    A page's dates are those of its structured data, its time elements and its sitemap entry (by path). Ages are whole
    days of 24 hours up to `as_of`; F06 compares the entry with the newest date of the page itself.
    """
    maps = entries.select("host", urls.path(F.col("loc")).alias("path"), "lastmod").groupBy("host", "path").agg(F.max("lastmod").alias("map_date"))
    p = inputs.select("page_id", "host", "path", "page_kind", "ld_date", "times", "last_modified").join(maps, ["host", "path"], "left")
    times = F.array_max(F.transform("times", text.date))
    days = lambda a, b: F.floor((F.unix_timestamp(a) - F.unix_timestamp(b)) / 86400)
    now = F.lit(as_of).cast("timestamp")
    p = p.withColumn("said", F.greatest("ld_date", times)).withColumn("newest", F.greatest("said", "map_date"))
    p = p.withColumns({"age": days(now, F.col("newest")), "ld_age": days(now, F.col("ld_date")), "http_age": days(now, F.col("last_modified")), "gap": days(F.col("said"), F.col("map_date"))})
    p = p.withColumn("tolerance", F.expr("case page_kind when 'blog' then 90 when 'evergreen' then 365 else 30 end"))
    return _broken(p, ["page_id", "page_kind", "age"], FRESHNESS)


METRICS = [
    ("P01", "'high'", "3", "lcp > 4000"),
    ("P02", "'medium'", "2", "lcp > 2500 and lcp <= 4000"),
    ("P03", "'high'", "3", "inp > 500"),
    ("P04", "'medium'", "2", "inp > 200 and inp <= 500"),
    ("P05", "case when cls > 0.25 then 'high' else 'medium' end", "2", "cls > 0.1"),
]


def parse_metrics(records: DataFrame) -> DataFrame:
    """url, lcp, inp and cls of JSON records (url, json); p75 values may be numbers or strings, and metrics may miss."""
    value = lambda k: F.expr(f"try_cast(get_json_object(json, '$.record.metrics.{k}.percentiles.p75') as double)")
    return records.select("url", value("largest_contentful_paint").alias("lcp"), value("interaction_to_next_paint").alias("inp"), value("cumulative_layout_shift").alias("cls"))


def worst_metrics(metrics: DataFrame) -> DataFrame:
    """One row a url: of several records the worst value of each metric."""
    return metrics.groupBy("url").agg(*(F.max(m).alias(m) for m in ("lcp", "inp", "cls")))


def field_metric_rules(pages: DataFrame, metrics: DataFrame) -> DataFrame:
    """page_id and the field-data rules broken, for pages that have metrics."""
    return _broken(pages.select("page_id", "url").join(metrics, "url", "left"), ["page_id"], METRICS)


def entity_rules(inputs: DataFrame, catalog: DataFrame) -> DataFrame:
    """page_id, entity and the entity rules N02 and N03; catalog (label, entity_id, rank): the first hit of a label counts."""
    first = catalog.withColumn("at", F.row_number().over(Window.partitionBy("label").orderBy("rank"))).where("at = 1")
    named = F.coalesce("org_name", F.nullif("og_site_name", F.lit("")), "title")
    brand = F.lower(F.regexp_replace(named, r"(?s)[\s|·—-].*$", ""))  # the first word of the first name there is
    p = inputs.where("has_org and not org_wikidata").select("page_id", brand.alias("label"))
    joined = p.join(first.select("label", "entity_id"), "label", "left")
    return _broken(joined, ["page_id", "entity_id"], [("N02", "'high'", "2", "entity_id is not null"), ("N03", "'medium'", "2", "entity_id is null")])


def brand_roots(inputs: DataFrame) -> DataFrame:
    """page_id and roots of pages whose brand names start with different words: what rule N01 finds."""
    return inputs.select("page_id", rules.brand_roots().alias("r")).where(F.size("r") > 1).select("page_id", F.array_join("r", ",").alias("roots"))


def link_status_rules(broken: DataFrame) -> DataFrame:
    """src_page with broken (status 400 and over) and redirected links: rules C10 (from one) and C09 (from two)."""
    out = broken.groupBy("src_page").agg(F.count_if(F.col("status") >= 400).alias("broken"), F.count_if(F.col("status").between(300, 399)).alias("redirected"))
    return _broken(out, ["src_page", "broken", "redirected"], [("C10", "'high'", "1", "broken > 0"), ("C09", "'medium'", "0.5", "redirected >= 2")])
