"""Named queries over page features and page rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelantern.operators import rules
from pagelantern.plans import page_sql
from pagelantern.sources import features as fx
from pagelantern.sources import tables

GROUPS = {
    "feat_head": ["title", "title_count", "description", "canonical", "html_lang", "viewport", "has_charset", "has_icon", "has_touch_icon", "robots", "meta_author"],
    "feat_social": ["og_title", "og_description", "og_image", "og_url", "og_type", "og_locale", "og_site_name", "tw_card", "tw_title", "tw_description", "tw_image"],
    "feat_headings": ["h1_count", "h1", "h2_count", "h2_questions", "h2_unanswered", "guide_heading"],
    "feat_text": ["first_paragraph_words", "words", "body_chars", "html_bytes", "content_hash", "has_evidence", "hedges", "citable", "semantic", "has_article", "has_noscript", "has_time", "has_review"],
    "feat_links": ["n_links", "n_internal", "n_internal_text", "n_external", "n_authority", "n_generic", "n_bare", "n_hash_routes", "n_blank", "n_blank_open", "n_trust_missing", "has_skip", "has_policy", "is_saas", "n_nouns", "n_nouns_linked"],
    "feat_images": ["n_imgs", "n_no_alt", "n_modern", "n_lazy", "n_unsized"],
    "feat_hreflang": ["n_hreflang", "n_hreflang_distinct", "has_x_default", "n_hreflang_bad"],
    "feat_resources": ["n_insecure", "n_blocking", "has_preconnect", "has_far_style", "has_woff2", "has_font_preload", "has_js_nav"],
    "url_parts": ["path", "depth"],
}


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.page_features(tables.pages(spark, sf_dir))


def inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.rule_inputs(features(spark, sf_dir))


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.page_findings(inputs(spark, sf_dir))


def _group(columns):
    return lambda spark, sf_dir: features(spark, sf_dir).select("page_id", *columns)


def _phase(phase):
    return lambda spark, sf_dir: rules.page_findings(inputs(spark, sf_dir), [r for r in rules.RULES if r.phase == phase]).select("page_id", "rule_id", "category", "severity", "points", "effort")


JSONLD = ["n_objects", "n_broken", "n_types", "has_org", "org_missing", "org_same_as", "org_wikidata", "org_name", "has_search", "has_article_type", "article_missing", "article_author", "author_text", "image_relative", "has_person", "person_missing", "has_dates", "n_no_context", "n_http_context"]

QUERIES = {name: _group(columns) for name, columns in GROUPS.items()}
QUERIES["feat_jsonld"] = lambda spark, sf_dir: inputs(spark, sf_dir).select("page_id", *JSONLD)
QUERIES |= {f"rules_{phase}": _phase(phase) for phase, _ in rules.PHASES if any(r.phase == phase for r in rules.RULES)}
QUERIES["rules_counts"] = lambda spark, sf_dir: findings(spark, sf_dir).groupBy("rule_id", "phase", "severity").agg(F.count("*").alias("pages"), F.round(F.sum("points"), 1).alias("points"))

SQL = {name: f"with {page_sql.FEATURES} select page_id, {', '.join(columns)} from f" for name, columns in GROUPS.items()}
SQL["feat_jsonld"] = f"with {page_sql.FEATURES}, {page_sql.FACTS}, {page_sql.INPUTS} select page_id, {', '.join(JSONLD)} from i"
SQL |= {f"rules_{phase}": f"with {page_sql.FINDINGS} select page_id, rule_id, category, severity, points, effort from fi where phase = '{phase}'" for phase, _ in rules.PHASES if any(r.phase == phase for r in rules.RULES)}
SQL["rules_counts"] = f"with {page_sql.FINDINGS} select rule_id, phase, severity, count(*) as pages, round(sum(points), 1) as points from fi group by all"
