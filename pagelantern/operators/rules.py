"""The catalogue of page rules, evaluated for all pages in one narrow pass.

A rule is a predicate and points, both SQL over the columns of rule_inputs. Points and
categories are fixed values of the audit; a user adds rules of their own to the list that `page_findings` takes.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelantern.functions import urls
from pagelantern.sources import features as fx


class Rule(NamedTuple):
    id: str
    phase: str
    category: str
    severity: str
    points: str
    effort: str
    when: str


#: Points a phase can lose, in the order phases run.
PHASES = [("technical", 12.0), ("structured_data", 15.0), ("geo", 18.0), ("entity", 10.0), ("eeat", 10.0), ("freshness", 8.0), ("international", 8.0), ("performance", 8.0), ("topical", 6.0), ("common_mistakes", 5.0)]


def _rules(phase: str, lines: str) -> list[Rule]:
    rows = [[x.strip() for x in line.split("|", 5)] for line in lines.strip().splitlines()]
    return [Rule(i, phase, c, s, p, e, w) for i, c, s, p, e, w in rows]


RULES: list[Rule] = [
    *_rules("technical", """
T01 | technical-title | high | 1 | quick | title = ''
T02 | technical-title | medium | 2 | quick | title <> '' and (length(title) < 20 or length(title) > 70)
T03 | technical-meta | medium | 1 | quick | description = ''
T04 | technical-meta | low | 1 | quick | length(description) > 180
T05 | technical-canonical | high | 2 | medium | canonical <> '' and canonical_host <> host
T06 | technical-lang | low | 1 | quick | html_lang = ''
T07 | technical-viewport | medium | 1 | quick | viewport = ''
T08 | technical-charset | low | 0.5 | quick | not has_charset
T09 | technical-icons | low | 0.5 | quick | not has_icon
T10 | technical-icons | info | 0.5 | quick | not has_touch_icon
T11a | technical-og | medium | 1 | quick | og_title = ''
T11b | technical-og | medium | 1 | quick | og_description = ''
T11c | technical-og | medium | 1 | quick | og_image = ''
T11d | technical-og | medium | 1 | quick | og_url = ''
T11e | technical-og | medium | 1 | quick | og_type = ''
T12 | technical-og | low | 1 | quick | og_image <> '' and not image_web
T13a | technical-twitter | low | 0.5 | quick | tw_card = ''
T13b | technical-twitter | low | 0.5 | quick | tw_title = ''
T13c | technical-twitter | low | 0.5 | quick | tw_description = ''
T13d | technical-twitter | low | 0.5 | quick | tw_image = ''
T14 | technical-meta-robots | critical | 3 | quick | robots like '%noindex%'
T15 | technical-meta-robots | medium | 1 | quick | robots like '%nofollow%' and robots not like '%noindex%'
T16 | technical-canonical-self | low | 0.5 | quick | canonical <> '' and canonical_host = host and canonical_bare <> url_bare
T17 | technical-h1 | low | 0.5 | quick | h1_count > 1
T18 | technical-h1 | medium | 1 | quick | h1_count = 0
T19 | technical-html-size | low | 0.5 | medium | html_bytes > 500000
"""),
    *_rules("structured_data", """
S01 | schema-syntax | high | 2 | quick | n_broken > 0
S02 | schema-organization | critical | 3 | medium | not has_org
S03 | schema-organization | medium | org_missing | quick | has_org and org_missing > 0
S04 | schema-sameas | high | 3 | medium | has_org and org_same_as = 0
S05 | schema-sameas | medium | 2 | medium | has_org and org_same_as between 1 and 4
S06 | schema-website | medium | 2 | quick | not has_search
S07 | schema-article | high | 3 | medium | article_like and not has_article_type
S08 | schema-article | medium | least(3.5, 0.5 * article_missing) | quick | has_article_type and article_missing > 0
S09 | schema-stacking | low | 1 | medium | n_objects > 0 and n_types < 3
S10 | schema-context | medium | 1 | quick | n_no_context > 0
S11 | schema-context | low | 0.5 | quick | n_http_context > 0
S12 | schema-breadcrumb | medium | 1 | quick | depth >= 2 and not has_breadcrumb
S13 | schema-article-author-stringly | low | 0.5 | quick | author_text
S14 | schema-article-image | low | 0.5 | quick | image_relative
S15 | schema-webapp | medium | 1 | medium | is_saas and not has_webapp
S16 | schema-product | medium | 1 | medium | product_url and not has_product and not has_article_type
S18 | schema-faqpage | info | 0 | quick | has_faq
S19 | schema-none | critical | 0 | medium | n_objects = 0 and n_broken = 0
"""),
    *_rules("geo", """
G04 | geo-semantic | high | 2 | medium | first_paragraph_words = 0
G05 | geo-semantic | medium | 2 | medium | first_paragraph_words between 1 and 133
G06 | geo-semantic | low | 1 | quick | first_paragraph_words > 167
G07 | geo-answer-blocks | medium | 1 | medium | h2_count >= 3 and h2_questions < 0.6 * h2_count
G08 | geo-answer-blocks | low | 0.5 | medium | h2_count >= 3 and h2_unanswered > 0.5 * h2_count
G09 | geo-evidence | low | 1 | medium | body_words > 300 and not has_evidence
G10 | geo-faqpage-schema | medium | 1 | medium | h2_questions > 0 and not has_faq and not has_qa
G11 | geo-howto-schema | low | 0.5 | medium | guide_url and not has_howto
G12 | geo-citable-content | low | 0.5 | quick | body_words >= 800 and citable = 0
G13 | geo-semantic-html | medium | 1 | medium | body_words >= 400 and semantic = 0
G15 | geo-tone | info | 0 | medium | hedges >= 4
"""),
    *_rules("entity", """
N01 | entity-brand-coherence | high | 2 | quick | n_brand_roots > 1
N04 | entity-wikipedia | low | 1 | heavy | has_org and org_same_as > 0 and not org_wikipedia
N05 | entity-searchaction | low | 1 | quick | not has_action
N06 | entity-linking | low | 1 | medium | n_nouns >= 15 and n_nouns_linked < 0.3 * n_nouns
"""),
    *_rules("eeat", """
E01 | eeat-https | critical | 3 | medium | url not like 'https://%'
E02 | eeat-trust-pages | medium | 0.5 * n_trust_missing | medium | n_trust_missing > 0
E03 | eeat-author | medium | 1 | quick | is_editorial and meta_author = '' and not article_author
E04 | eeat-person-schema | low | 1 | medium | is_editorial and not has_person
E05 | eeat-person-shallow | low | 0.5 | quick | is_editorial and has_person and person_missing >= 2
E06 | eeat-review-policy | low | 0.5 | medium | is_editorial and not has_review and not has_policy
E07 | eeat-citations | low | 1 | medium | is_editorial and n_external < 3
E08 | eeat-bare-urls | low | 0.5 | quick | is_editorial and n_external >= 3 and n_bare >= 3 and n_bare > 0.5 * n_external
E10 | eeat-a11y-alt | medium | 0.5 | quick | n_imgs >= 3 and (n_no_alt >= 3 or n_no_alt > 0.2 * n_imgs)
E11 | eeat-a11y-skiplink | low | 0.5 | quick | not has_skip
E12 | eeat-dates | low | 1 | quick | is_editorial and not has_time and not has_dates
"""),
    *_rules("international", """
I01 | international-single-lang | info | 0 | quick | n_hreflang = 0
I02 | international-x-default | medium | 1 | quick | n_hreflang > 0 and not has_x_default
I03 | international-og-locale | low | 0.5 | quick | n_hreflang > 0 and og_locale = ''
I04 | international-hreflang-dup | medium | 1 | quick | n_hreflang > n_hreflang_distinct
I05 | international-format | high | 1 | quick | n_hreflang_bad > 0
I06 | international-self-ref | high | 2 | quick | n_hreflang > 0 and self_lang = ''
I07 | international-html-lang | medium | 1 | quick | n_hreflang > 0 and self_lang <> '' and html_lang <> '' and split_part(lower(self_lang), '-', 1) not in ('x', split_part(lower(html_lang), '-', 1))
I08 | international-html-lang-missing | low | 0.5 | quick | n_hreflang > 0 and html_lang = ''
I10 | international-url-strategy | info | 0 | heavy | n_hreflang > 0 and cctld
"""),
    *_rules("performance", """
P06 | performance-hashrouter | critical | 3 | heavy | n_hash_routes >= 3
P07 | performance-ssr | high | 2 | heavy | body_chars <= 200 and not has_noscript
P08 | performance-images-format | low | 0.5 | medium | n_imgs > 0 and n_modern = 0
P09 | performance-lazy-loading | low | 0.5 | quick | n_imgs >= 4 and n_lazy = 0
P10 | performance-cls | medium | 1 | quick | n_imgs > 0 and n_unsized > 0.3 * n_imgs
P11 | performance-preconnect | low | 0.5 | quick | has_far_style and not has_preconnect
P12 | performance-font-preload | low | 0.5 | quick | has_woff2 and not has_font_preload
P13 | performance-scripts | medium | 0.5 | quick | n_blocking > 0
"""),
    *_rules("topical", """
O01 | topical-linking-ratio | low | 1 | medium | n_links >= 10 and n_links - n_internal_text > 0.5 * n_internal_text
O02 | topical-anchor-overopt | medium | 1 | medium | n_internal_text >= 6 and top_text > 0.8 * n_internal_text
O03 | topical-anchor-generic | medium | 1 | medium | n_links >= 8 and n_generic > 0.2 * n_links
O04 | topical-pillar-hint | low | 0.5 | heavy | h1_count > 0 and words >= 2000 and n_internal_text < 5
O05 | topical-authority-outbound | low | 0.5 | quick | n_external >= 5 and n_authority = 0
"""),
    *_rules("common_mistakes", """
C01 | common-noindex | critical | 2 | quick | robots like '%noindex%' and not admin_url
C02 | common-mixed-content | high | 1 | quick | url like 'https://%' and n_insecure > 0
C03 | common-noopener | low | 0.5 | quick | n_blank >= 3 and n_blank_open > 0.3 * n_blank
C04 | common-canonical | medium | 1 | medium | canonical <> '' and canonical_host = host and canonical_loose <> url_loose
C05 | common-duplicate-title | medium | 0.5 | quick | title_count > 1
C06 | common-img-alt | medium | 0.5 | medium | n_imgs >= 5 and n_no_alt > 0.3 * n_imgs
C07 | common-noindex-canonical | high | 1 | quick | robots like '%noindex%' and canonical <> '' and regexp_replace(canonical_url, '/+$', '') = regexp_replace(url, '/+$', '')
C08 | common-js-only-nav | medium | 1 | medium | has_js_nav
"""),
]


def brand_roots() -> Column:
    """The first words, of three letters or more, that the brand's names (organization, site name, title) start with."""
    names = F.array_compact(F.array("org_name", F.nullif("og_site_name", F.lit("")), F.nullif("title", F.lit(""))))
    return F.array_sort(F.array_distinct(F.filter(F.transform(names, lambda n: F.get(F.split(F.lower(F.trim(n)), r"[\s|·—-]"), 0)), lambda r: F.length(r) >= 3)))


def rule_inputs(features: DataFrame) -> DataFrame:
    """page_features with the facts of its structured data and what only rules need; no shuffle."""
    wide = fx.jsonld_facts(features)
    has = lambda *names: F.arrays_overlap("types", F.lit(list(names)))
    strip = lambda c: F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "/+$", ""), r"\?.*$", ""), "#.*$", "")
    loose = lambda c: F.regexp_replace(F.regexp_replace(c, "^https?://", ""), "/$", "")
    return wide.withColumns(
        {
            "n_types": F.size("types"),
            "n_brand_roots": F.size(brand_roots()),
            "has_breadcrumb": has("breadcrumblist"),
            "has_webapp": has("webapplication", "softwareapplication"),
            "has_product": has("product", "offer"),
            "has_faq": has("faqpage"),
            "has_qa": has("qapage"),
            "has_howto": has("howto"),
            "article_like": F.col("is_editorial") | F.col("og_type").rlike("(?i)article"),
            "product_url": F.col("url").rlike("(?i)/(product|produit|item|article|shop)/"),
            "guide_url": F.col("url").rlike(r"(?i)/(guide|tutoriel|comment|how[- ]to|step|instructions)\b"),
            "admin_url": F.col("url").rlike(r"/(admin|dashboard|login|auth)\b"),
            "cctld": F.col("host").rlike(r"\.(fr|de|es|it|uk|be|ch|nl|pt|pl|jp|cn|br|ca)$"),
            "canonical_host": F.regexp_extract(F.lower(F.coalesce("canonical_url", F.lit(""))), r"^https?://([^/:?#]+)", 1),
            "canonical_bare": strip(F.coalesce("canonical_url", F.lit(""))),
            "url_bare": strip(F.col("url")),
            "canonical_loose": loose(F.coalesce("canonical_url", F.lit(""))),
            "url_loose": loose(F.col("url")),
            "self_lang": F.coalesce("self_lang", F.lit("")),
            "top_text": F.coalesce("top_text", F.lit(0)),
            "image_web": urls.resolve(F.col("og_image"), F.col("url")).rlike("(?i)^https?://"),
        }
    )


def page_findings(inputs: DataFrame, rules: list[Rule] = RULES) -> DataFrame:
    """A row for every rule that a page breaks: page_id, host, url and the rule's columns. inputs: rule_inputs."""
    broken = [
        F.expr(f"case when {r.when} then named_struct('rule_id', '{r.id}', 'phase', '{r.phase}', 'category', '{r.category}', 'severity', '{r.severity}', 'points', cast({r.points} as double), 'effort', '{r.effort}') end")
        for r in rules
    ]
    return inputs.select("page_id", "host", "url", F.explode(F.array_compact(F.array(*broken))).alias("f")).select("page_id", "host", "url", "f.*")
