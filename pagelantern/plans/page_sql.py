"""The page features and rules again, as SQL for the comparison engine."""

from __future__ import annotations

from pagelantern.sources import features as fx
from pagelantern.sources.tables import PAGES_SQL

Q = "[\"'']"
NQ = "[^\"'']"


def _s(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def attr(tag: str, name: str) -> str:
    return f"coalesce(regexp_extract({tag}, '(?is)\\s{name}={Q}({NQ}*){Q}', 1), '')"


def squeeze(x: str) -> str:
    return f"trim(regexp_replace(regexp_replace({x}, '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g'))"


def meta(name: str) -> str:
    return f"trim({attr(f"list_filter(metas, lambda m: regexp_matches(m, '(?i)\\s(name|property)={Q}{name}{Q}'))[1]", 'content')})"


def rel(name: str) -> str:
    return f"list_filter(link_tags, lambda t: regexp_matches(t, '(?i)\\srel={Q}{name}{Q}'))"


def tags(x: str, name: str) -> str:
    return f"regexp_extract_all({x}, '(?is)<{name}(?:\\s[^>]*)?>')"


def inner(x: str, name: str) -> str:
    return f"list_transform(regexp_extract_all({x}, '(?is)<{name}(?:\\s[^>]*)?>(.*?)</{name}>', 1), lambda y: {squeeze('y')})"


def n(array: str, test: str) -> str:
    return f"len(list_filter({array}, lambda x: {test}))"


def host(u: str) -> str:
    return f"lower(regexp_extract({u}, '^https?://([^/:?#]+)', 1))"


def origin(u: str) -> str:
    return f"lower(regexp_extract({u}, '^(https?://[^/?#]+)', 1))"


def path(u: str) -> str:
    bare = f"regexp_replace(regexp_replace(regexp_replace({u}, '^https?://[^/?#]*', ''), '[?#].*$', ''), '/+$', '')"
    return f"(case when {bare} = '' then '/' else {bare} end)"


def resolve(h: str, b: str = "url") -> str:
    bare = f"regexp_replace({b}, '[?#].*$', '')"
    folder = f"(case when length(regexp_replace({bare}, '^https?://[^/]*', '')) = 0 then {bare} || '/' else regexp_replace({bare}, '/[^/]*$', '/') end)"
    return f"""(case when regexp_matches({h}, '^[A-Za-z][A-Za-z0-9+.-]*:') then {h} when {h} like '//%' then regexp_extract({b}, '^(https?:)', 1) || {h}
      when {h} like '/%' then {origin(b)} || {h} when {h} like '?%' then {bare} || {h} when {h} like '#%' then regexp_replace({b}, '#.*$', '') || {h}
      when {h} = '' then {b} else {folder} || regexp_replace({h}, '^(\\./)+', '') end)"""


def internal_path(h: str) -> str:
    return f"(case when length({h}) > 0 and not regexp_matches({h}, '(?i)^(#|mailto:|tel:|javascript:)') and {origin(resolve(h))} = {origin('url')} then {path(resolve(h))} end)"


EXTERNAL = f"(x.href like 'http%' and {host('x.href')} <> host)"
INTERNAL = f"({internal_path('x.href')} is not null)"
WORDS = "len(list_filter(string_split({}, ' '), lambda w: w <> ''))"
LETTERS = "len(list_filter(string_split({}, ' '), lambda w: regexp_matches(w, '[A-Za-z0-9_À-ɏ]')))"
TRUST = " + ".join(f"(case when len(list_filter(links, lambda x: regexp_matches(lower(x.href), '{'|'.join(w)}') or regexp_matches(x.text, '{'|'.join(w)}'))) > 0 then 0 else 1 end)" for w in fx.TRUST)
KEPT = f"(x.href <> '' and x.text <> '' and (x.href[1] in ('/', '.') or {host(resolve('x.href'))} = host))"
GENERIC = ", ".join(f"'{g}'" for g in fx.GENERIC)

NOUNS = "list_filter(list_distinct(list_transform(regexp_extract_all(body_text, '\\b[A-Z][a-zà-ÿ]{2,}(?:\\s[A-Z][a-zà-ÿ]{2,})?\\b'), lambda y: lower(y))), lambda y: y not in ('le', 'la', 'les', 'un', 'une', 'des', 'de', 'du', 'the'))"
COLUMNS = {
    "path": path("url"),
    "title": f"coalesce({squeeze('titles[1]')}, '')",
    "title_count": "len(titles)",
    "description": meta("description"),
    "canonical": f"trim({attr(rel('canonical') + '[1]', 'href')})",
    "html_lang": attr(f"{tags('clean', 'html')}[1]", "lang"),
    "viewport": meta("viewport"),
    "has_charset": f"len(list_filter(metas, lambda m: regexp_matches(m, '(?i)\\scharset=|http-equiv={Q}content-type{Q}'))) > 0",
    "has_icon": f"len(list_filter(link_tags, lambda t: regexp_matches(t, '(?i)\\srel={Q}(shortcut )?icon{Q}'))) > 0",
    "has_touch_icon": f"len({rel('apple-touch-icon')}) > 0",
    **{f"og_{k}": meta(f"og:{k}") for k in ("title", "description", "image", "url", "type", "locale", "site_name")},
    **{f"tw_{k}": meta(f"twitter:{k}") for k in ("card", "title", "description", "image")},
    "robots": f"lower({meta('robots')})",
    "meta_author": meta("author"),
    "h1_count": "len(h1s)",
    "h1": "coalesce(h1s[1], '')",
    "h2_count": "len(h2s)",
    "h2_questions": n("h2s", f"regexp_matches(x, {_s(fx.QUESTION)})"),
    "h2_unanswered": n("sections[2:]", f"{LETTERS.format(squeeze("regexp_extract(x, '(?is)</h2>.*?<p(?:\\s[^>]*)?>(.*?)</p>', 1)"))} not between 1 and 60"),
    "first_paragraph_words": n("string_split(coalesce(first_paragraph, ''), ' ')", "regexp_matches(x, '[A-Za-z0-9_À-ɏ]')"),
    "words": WORDS.format("body_text"),
    "body_words": LETTERS.format("body_text"),
    "body_chars": "length(body_text)",
    "html_bytes": "octet_length(encode(html))",
    "content_hash": "sha256(lower(body_text))",
    "has_evidence": f"regexp_matches(body_text, {_s(fx.EVIDENCE)})",
    "hedges": f"len(regexp_extract_all(body_text, {_s(fx.HEDGING)}))",
    "citable": "len(regexp_extract_all(clean, '(?i)<(blockquote|q|cite)[\\s>]'))",
    "semantic": "len(regexp_extract_all(clean, '(?i)<(article|section|main|nav|aside|header|footer)[\\s>]'))",
    "has_article": "regexp_matches(clean, '(?i)<article[\\s>]')",
    "has_noscript": "regexp_matches(clean, '(?i)<noscript[\\s>]')",
    "has_time": "regexp_matches(clean, '(?i)<time[^>]*\\sdatetime=')",
    "has_review": "regexp_matches(lower(body_text), '\\breviewed\\s+by\\b|\\brelu\\s+par\\b|\\bvérifié\\s+par\\b|\\bfact[- ]check')",
    "n_links": "len(list_filter(links, lambda x: x.href <> '' and x.text <> ''))",
    "n_internal": n("links", INTERNAL),
    "n_internal_text": n("links", KEPT),
    "n_external": n("links", EXTERNAL),
    "n_authority": n("links", f"{EXTERNAL} and regexp_matches({host('x.href')}, {_s(fx.AUTHORITY)})"),
    "n_generic": n("links", f"x.href <> '' and x.text <> '' and len(list_filter([{GENERIC}], lambda g: x.text = g or ends_with(x.text, ' ' || g))) > 0"),
    "n_bare": n("links", "x.href like 'http%' and (x.text like 'http://%' or x.text like 'https://%')"),
    "top_text": f"list_max(list_transform(list_transform(list_filter(links, lambda x: {KEPT}), lambda x: x.text), lambda t: len(list_filter(links, lambda x: x.text = t and {KEPT}))))",
    "n_nouns": f"len({NOUNS})",
    "n_nouns_linked": f"len(list_filter({NOUNS}, lambda n: len(list_filter(links, lambda x: regexp_matches(x.href, '^[/.]') and contains(x.text, n))) > 0))",
    "n_hash_routes": n("links", "regexp_matches(x.href, '^/?#/\\w')"),
    "n_blank": n("links", f"{EXTERNAL} and lower(x.target) = '_blank'"),
    "n_blank_open": n("links", f"{EXTERNAL} and lower(x.target) = '_blank' and not regexp_matches(x.rel, '(?i)noopener')"),
    "n_trust_missing": TRUST,
    "has_skip": "len(list_filter(links, lambda x: x.href in ('#main', '#main-content', '#contenu-principal') or (x.href like '#%' and regexp_matches(x.text, '\\b(skip|aller|contenu|main)\\b')))) > 0",
    "has_policy": "len(list_filter(links, lambda x: regexp_matches(x.href || ' ' || x.text, '(?i)editorial[- ]?policy|methodology|politique[- ]?éditoriale|m[ée]thodologie|charte éditoriale'))) > 0",
    "is_saas": f"len(list_filter(links, lambda x: regexp_matches(x.href, {_s(fx.SAAS_PATH)}))) > 0 or regexp_matches(substring(body_text, 1, 3000), {_s(fx.SAAS_WORDS)})",
    "n_imgs": "len(img_tags)",
    "n_no_alt": n("img_tags", "not regexp_matches(x, '(?i)\\salt=')"),
    "n_modern": n("img_tags", f"regexp_matches(case when regexp_matches(x, '(?i)\\ssrc=') then {attr('x', 'src')} else {attr('x', 'srcset')} end || ' ', '(?i)\\.(webp|avif)[?\\s]')"),
    "n_lazy": n("img_tags", f"lower({attr('x', 'loading')}) = 'lazy'"),
    "n_unsized": n("img_tags", "not (regexp_matches(x, '(?i)\\swidth=[\"'']?[0-9a-z%.]') and regexp_matches(x, '(?i)\\sheight=[\"'']?[0-9a-z%.]'))"),
    "n_hreflang": "len(hreflangs)",
    "n_hreflang_distinct": "len(list_distinct(list_transform(hreflangs, lambda x: lower(x.lang))))",
    "has_x_default": "len(list_filter(hreflangs, lambda x: lower(x.lang) = 'x-default')) > 0",
    "n_hreflang_bad": n("hreflangs", "not regexp_matches(x.lang, '^(x-default|[a-z]{2,3}(-([A-Z]{2}|Hans|Hant|Latn|Cyrl))?)$')"),
    "self_lang": f"coalesce(list_transform(list_filter(hreflangs, lambda x: rtrim({resolve('x.href')}, '/') = rtrim(url, '/')), lambda x: x.lang)[1], '')",
    "n_insecure": f"len(list_filter(regexp_extract_all(clean, '(?i)\\s(?:src|href)={Q}(http://[^\"'']*)', 1) || regexp_extract_all(regexp_replace(html, '(?s)<!--.*?-->', ' ', 'g'), '(?is)<script\\s[^>]*?src={Q}(http://[^\"'']*)', 1), lambda u: u not like 'http://localhost%'))",
    "n_blocking": "len(list_filter(regexp_extract_all(head, '(?is)<script\\s[^>]*\\ssrc=[^>]*>|<script\\ssrc=[^>]*>'), lambda x: not regexp_matches(x, '(?i)\\s(async|defer)')))",
    "has_preconnect": f"len({rel('preconnect')}) > 0",
    "has_far_style": f"len(list_filter(link_tags, lambda x: regexp_matches(x, '(?i)rel={Q}stylesheet{Q}') and regexp_matches(x, '(?i)href={Q}http'))) > 0",
    "has_woff2": "len(list_filter(link_tags, lambda x: regexp_matches(x, '(?i)href=[^>]*\\.woff2'))) > 0",
    "has_font_preload": f"len(list_filter(link_tags, lambda x: regexp_matches(x, '(?i)rel={Q}preload{Q}') and regexp_matches(x, '(?i)as={Q}font{Q}'))) > 0",
    "has_js_nav": "len(list_filter(regexp_extract_all(clean, '(?is)<nav[\\s>].*?</nav>'), lambda x: not regexp_matches(x, '(?i)<a\\s[^>]*href=') and len(list_filter(regexp_extract_all(x, '<[a-zA-Z][^>]*>'), lambda y: regexp_matches(y, '(?i)\\sonclick=|\\srole=.button|^<button[^>]*\\srole=.link'))) >= 3)) > 0",
    "depth": f"len(list_filter(string_split({path('url')}, '/'), lambda s: s <> ''))",
    "guide_heading": "len(list_filter(h1s || h2s, lambda h: regexp_matches(h, '(?i)guide|tutoriel|comment'))) > 0",
}

# Tags at which a paragraph ends, as the page's main text is told: its first paragraph lies in main, article or section or directly in the body.
_BLOCK = r"(?is)</?(?:main|article|section|div|nav|header|footer|aside|ul|ol|dl|table|form|figure|figcaption|blockquote|details|summary|fieldset|address|menu|dialog|hgroup|center|pre|p|h[1-6]|hr|body)(?:\s[^>]*)?/?>"

FEATURES = f"""p as ({PAGES_SQL}),
c as (select *, regexp_replace(html, '(?is)<!--.*?-->|<script\\b[^>]*>.*?</script>|<style\\b[^>]*>.*?</style>', ' ', 'g') as clean from p),
t as (select *, regexp_extract(html, '(?is)<head[^>]*>(.*?)</head>', 1) as head, regexp_extract(clean, '(?is)<body[^>]*>(.*)', 1) as body,
  {tags('clean', 'meta')} as metas, {tags('clean', 'link')} as link_tags, {tags('clean', 'img')} as img_tags,
  list_transform(regexp_extract_all(clean, '(?is)<a\\s[^>]*>.*?</a>'), lambda a: {{'tag': a, 'start': regexp_extract(a, '(?is)^(<a\\s[^>]*>)', 1)}}) as anchors,
  regexp_extract_all(clean, '(?is)<title[^>]*>(.*?)</title>', 1) as titles, {inner('clean', 'h1')} as h1s,
  list_filter({inner('clean', 'h2')}, lambda h: h <> '') as h2s, string_split_regex(clean, '(?i)<h2(?:\\s[^>]*)?>') as sections,
  list_filter(list_transform(regexp_extract_all(html, '(?is)<script[^>]*type={Q}application/ld\\+json{Q}[^>]*>(.*?)</script>', 1), lambda b: trim(b)), lambda b: b <> '') as jsonld from c),
u as (select *, list_transform(anchors, lambda x: {{'href': {attr('x.start', 'href')}, 'text': lower({squeeze('x.tag')}), 'rel': {attr('x.start', 'rel')}, 'target': {attr('x.start', 'target')}}}) as links,
  list_filter(list_transform(list_filter(link_tags, lambda t: lower({attr('t', 'rel')}) = 'alternate'), lambda t: {{'lang': {attr('t', 'hreflang')}, 'href': {attr('t', 'href')}}}), lambda x: x.lang <> '' and x.href <> '') as hreflangs,
  {squeeze('body')} as body_text from t),
pt as (select page_id, tg, tx, unnest(range(1, len(tg) + 1)) as k from (select page_id, regexp_extract_all(body, {_s(_BLOCK)}) as tg, string_split_regex(body, {_s(_BLOCK)}) as tx from t)),
pr as (select page_id, k, lower(regexp_extract(tg[k], '^</?([A-Za-z0-9]+)', 1)) as tag, case when starts_with(tg[k], '</') then -1 else 1 end as way, {squeeze('tx[k + 1]')} as said from pt),
pw as (select *, sum(case when tag in ('main', 'article', 'section') then way else 0 end) over (partition by page_id order by k) as inside,
  sum(case when tag in ('p', 'hr', 'body') or regexp_matches(tag, '^h[1-6]$') then 0 else way end) over (partition by page_id order by k) as open from pr),
pg as (select page_id, arg_min(said, (case when inside > 0 or open = 0 then 0 else 1 end, k)) as first_paragraph from pw where tag = 'p' and way = 1 and said <> '' group by page_id),
f as (select page_id, host, url, status, last_modified, links, hreflangs, jsonld, {', '.join(f'{e} as {k}' for k, e in COLUMNS.items())} from u left join pg using (page_id))"""

def _get(o: str, field: str) -> str:
    return f"json_extract({o}, '$.\"{field}\"')"


def _str(x: str) -> str:
    return f"case when json_type({x}) = 'VARCHAR' then json_extract_string({x}, '$') end"


def _named(o: str, field: str) -> str:
    x = _get(o, field)
    return f"nullif(case when json_type({x}) = 'VARCHAR' then json_extract_string({x}, '$') when json_type({x}) <> 'OBJECT' then null when {_get(x, 'name')} is not null then {_str(_get(x, 'name'))} else {_str(_get(x, 'url'))} end, '')"


def _holds(o: str, field: str) -> str:
    return f"coalesce({_get(o, field)}::varchar not in ('null', 'false', '0', '\"\"'), false)"


def _list(x: str) -> str:
    return f"(case when json_type({x}) = 'ARRAY' then json_extract_string({x}, '$[*]') when json_type({x}) = 'VARCHAR' then [json_extract_string({x}, '$')] else [] end)"


def _missing(o: str, test, *fields: str) -> str:
    return "(" + " + ".join(f"(case when {test(o, f)} then 0 else 1 end)" for f in fields) + ")"


_TYPES = lambda o: f"list_transform({_list(_get(o, '@type'))}, lambda t: lower(t))"
_FIRST = lambda t: f"list_filter(os, lambda o: list_contains({_TYPES('o')}, '{t}'))[1]"
_TYPE = lambda *names: "(" + " or ".join(f"list_contains(types, '{t}')" for t in names) + ")"
SAME = _list(_get("org", "sameAs"))

#: What stands in a JSON array or in an object's @graph list, null for other values.
_KIDS = "(case when json_type(node) = 'ARRAY' then json_extract(node, '$[*]') when json_type(json_extract(node, '$.\"@graph\"')) = 'ARRAY' then json_extract(node, '$.\"@graph\"[*]') end)"

FACTS = f"""v as (select page_id, list_filter(jsonld, lambda x: json_valid(x)) as good, len(list_filter(jsonld, lambda x: not json_valid(x))) as n_broken from f),
vr as (select *, list_filter(flatten(list_transform(good, lambda r: case when json_type(r) = 'ARRAY' then json_extract(r, '$[*]') else [r::json] end)), lambda r: json_type(r) in ('OBJECT', 'ARRAY')) as roots from v),
ov as (with recursive nd as (
    select page_id, [k] as route, good[k]::json as node from (select page_id, good, unnest(range(1, len(good) + 1)) as k from v)
    union all select page_id, list_append(route, j), kids[j] from (select page_id, route, kids, unnest(range(1, len(kids) + 1)) as j from (select page_id, route, {_KIDS} as kids from nd)))
  select page_id, list(node order by route) as os from nd where json_type(node) = 'OBJECT' and {_KIDS} is null group by page_id),
o1 as (select page_id, n_broken, len(list_filter(roots, lambda r: not {_holds('r', '@context')})) as n_no_context, len(list_filter(roots, lambda r: coalesce({_str(_get('r', '@context'))} like 'http://%', false))) as n_http_context, coalesce(os, []) as os from vr left join ov using (page_id)),
o2 as (select *, {_FIRST('organization')} as org, {_FIRST('website')} as site, coalesce({_FIRST('article')}, {_FIRST('blogposting')}, {_FIRST('newsarticle')}) as art, {_FIRST('person')} as person from o1),
g as (select page_id, n_broken, len(os) as n_objects, list_distinct(flatten(list_transform(os, lambda o: {_TYPES('o')}))) as types,
  org is not null as has_org, site is not null as has_site, art is not null as has_article_type, person is not null as has_person,
  case when org is null then 0 else {_missing('org', lambda o, f: f"{_named(o, f)} is not null", 'name', 'url', 'logo')} end as org_missing,
  case when org is null then 0 else len({SAME}) end as org_same_as,
  len(list_filter({SAME}, lambda x: lower(x) like '%wikidata.org%')) > 0 as org_wikidata, len(list_filter({SAME}, lambda x: lower(x) like '%wikipedia.org%')) > 0 as org_wikipedia,
  {_named('org', 'name')} as org_name,
  len(list_filter({_list("json_extract(site, '$.potentialAction.\"@type\"')")}, lambda x: lower(x) like '%searchaction%')) > 0 as has_search,
  coalesce(json_type({_get('site', 'potentialAction')}) in ('OBJECT', 'ARRAY'), false) as has_action, n_no_context, n_http_context,
  case when art is null then 0 else {_missing('art', _holds, 'headline', 'author', 'datePublished', 'dateModified', 'image', 'publisher', 'mainEntityOfPage')} end as article_missing,
  array_to_string(list_filter(['headline', 'datePublished', 'dateModified', 'author', 'publisher', 'image', 'mainEntityOfPage'], lambda n: coalesce(json_extract(art, '$.' || n)::varchar in ('null', 'false', '0', '\"\"'), true)), ',') as article_gaps,
  len(list_filter(os, lambda o: {_holds('o', 'author')} and len(list_filter({_TYPES('o')}, lambda t: t like '%article%' or t like '%blogposting%')) > 0)) > 0 as article_author, coalesce(json_type({_get('art', 'author')}) = 'VARCHAR', false) as author_text,
  coalesce(not regexp_matches(nullif(coalesce({_str(_get('art', 'image'))}, {_str("json_extract(art, '$.image.url')")}), ''), '(?i)^https?://'), false) as image_relative,
  case when person is null then 0 else {_missing('person', _holds, 'jobTitle', 'knowsAbout')} + (case when len({_list(_get('person', 'sameAs'))}) = 0 then 1 else 0 end) end as person_missing,
  len(list_filter(os, lambda o: {_holds('o', 'datePublished')} or {_holds('o', 'dateModified')})) > 0 as has_dates,
  list_max(list_transform(os, lambda o: coalesce(try_cast({_str(_get('o', 'dateModified'))} as timestamp), try_cast({_str(_get('o', 'datePublished'))} as timestamp)))) as ld_date from o2)"""

_STRIP = lambda c: f"regexp_replace(regexp_replace(regexp_replace({c}, '/+$', ''), '\\?.*$', ''), '#.*$', '')"
_LOOSE = lambda c: f"regexp_replace(regexp_replace({c}, '^https?://', ''), '/$', '')"
_CANON = f"(case when canonical <> '' then {resolve('canonical')} else '' end)"

INPUTS = f"""w as (select f.* exclude (top_text), coalesce(top_text, 0) as top_text, f.has_article or regexp_matches(f.url, {_s(fx.EDITORIAL)}) as is_editorial, g.* exclude (page_id),
  {_CANON} as canonical_url from f join g using (page_id)),
i as (select *, len(types) as n_types, len(list_distinct(list_filter(list_transform(list_filter([org_name, nullif(og_site_name, ''), nullif(title, '')], lambda x: x is not null), lambda x: string_split_regex(lower(trim(x)), '[\\s|·—-]')[1]), lambda r: length(r) >= 3))) as n_brand_roots, {', '.join(f"{_TYPE(*t)} as {k}" for k, t in {'has_breadcrumb': ['breadcrumblist'], 'has_webapp': ['webapplication', 'softwareapplication'], 'has_product': ['product', 'offer'], 'has_faq': ['faqpage'], 'has_qa': ['qapage'], 'has_howto': ['howto']}.items())},
  is_editorial or regexp_matches(og_type, '(?i)article') as article_like,
  regexp_matches(url, '(?i)/(product|produit|item|article|shop)/') as product_url,
  regexp_matches(url, '(?i)/(guide|tutoriel|comment|how[- ]to|step|instructions)\\b') as guide_url,
  regexp_matches(url, '/(admin|dashboard|login|auth)\\b') as admin_url,
  regexp_matches(host, '\\.(fr|de|es|it|uk|be|ch|nl|pt|pl|jp|cn|br|ca)$') as cctld,
  regexp_extract(lower(canonical_url), '^https?://([^/:?#]+)', 1) as canonical_host,
  {_STRIP('canonical_url')} as canonical_bare, {_STRIP('url')} as url_bare, {_LOOSE('canonical_url')} as canonical_loose, {_LOOSE('url')} as url_loose from w)"""

# The page rules once more, told from the audit's description and not from operators.rules: what a page loses, and where.
# Of each phase: rule, severity, points, effort, category, condition.
_SAID = {
    "technical": """
T01 high 1 quick technical-title: length(title) = 0
T02 medium 2 quick technical-title: length(title) between 1 and 19 or length(title) >= 71
T03 medium 1 quick technical-meta: length(description) = 0
T04 low 1 quick technical-meta: length(description) >= 181
T05 high 2 medium technical-canonical: length(canonical) > 0 and not canonical_host = host
T06 low 1 quick technical-lang: length(html_lang) = 0
T07 medium 1 quick technical-viewport: length(viewport) = 0
T08 low 0.5 quick technical-charset: has_charset = false
T09 low 0.5 quick technical-icons: has_icon = false
T10 info 0.5 quick technical-icons: has_touch_icon = false
T11a medium 1 quick technical-og: length(og_title) = 0
T11b medium 1 quick technical-og: length(og_description) = 0
T11c medium 1 quick technical-og: length(og_image) = 0
T11d medium 1 quick technical-og: length(og_url) = 0
T11e medium 1 quick technical-og: length(og_type) = 0
T12 low 1 quick technical-og: length(og_image) > 0 and not regexp_matches(OGIMAGE, '(?i)^https?:')
T13a low 0.5 quick technical-twitter: length(tw_card) = 0
T13b low 0.5 quick technical-twitter: length(tw_title) = 0
T13c low 0.5 quick technical-twitter: length(tw_description) = 0
T13d low 0.5 quick technical-twitter: length(tw_image) = 0
T14 critical 3 quick technical-meta-robots: contains(robots, 'noindex')
T15 medium 1 quick technical-meta-robots: contains(robots, 'nofollow') and not contains(robots, 'noindex')
T16 low 0.5 quick technical-canonical-self: length(canonical) > 0 and canonical_host = host and not canonical_bare = url_bare
T17 low 0.5 quick technical-h1: h1_count >= 2
T18 medium 1 quick technical-h1: h1_count < 1
T19 low 0.5 medium technical-html-size: html_bytes >= 500001
""",
    "structured_data": """
S01 high 2 quick schema-syntax: n_broken >= 1
S02 critical 3 medium schema-organization: not list_contains(types, 'organization')
S03 medium org_missing quick schema-organization: list_contains(types, 'organization') and org_missing >= 1
S04 high 3 medium schema-sameas: list_contains(types, 'organization') and org_same_as = 0
S05 medium 2 medium schema-sameas: org_same_as in (1, 2, 3, 4)
S06 medium 2 quick schema-website: not (has_site and has_search)
S07 high 3 medium schema-article: article_like and len(list_intersect(types, ['article', 'blogposting', 'newsarticle'])) = 0
S08 medium case when article_missing >= 7 then 3.5 else article_missing / 2.0 end quick schema-article: article_missing >= 1
S09 low 1 medium schema-stacking: n_objects >= 1 and len(types) <= 2
S10 medium 1 quick schema-context: n_no_context >= 1
S11 low 0.5 quick schema-context: n_http_context >= 1
S12 medium 1 quick schema-breadcrumb: depth > 1 and not list_contains(types, 'breadcrumblist')
S13 low 0.5 quick schema-article-author-stringly: author_text
S14 low 0.5 quick schema-article-image: image_relative
S15 medium 1 medium schema-webapp: is_saas and len(list_intersect(types, ['webapplication', 'softwareapplication'])) = 0
S16 medium 1 medium schema-product: product_url and len(list_intersect(types, ['product', 'offer', 'article', 'blogposting', 'newsarticle'])) = 0
S18 info 0 quick schema-faqpage: list_contains(types, 'faqpage')
S19 critical 0 medium schema-none: n_objects + n_broken = 0
""",
    "geo": """
G04 high 2 medium geo-semantic: first_paragraph_words < 1
G05 medium 2 medium geo-semantic: first_paragraph_words >= 1 and first_paragraph_words < 134
G06 low 1 quick geo-semantic: first_paragraph_words >= 168
G07 medium 1 medium geo-answer-blocks: h2_count >= 3 and h2_questions / h2_count < 0.6
G08 low 0.5 medium geo-answer-blocks: h2_count >= 3 and 2 * h2_unanswered > h2_count
G09 low 1 medium geo-evidence: body_words >= 301 and has_evidence = false
G10 medium 1 medium geo-faqpage-schema: h2_questions >= 1 and len(list_intersect(types, ['faqpage', 'qapage'])) = 0
G11 low 0.5 medium geo-howto-schema: guide_url and not list_contains(types, 'howto')
G12 low 0.5 quick geo-citable-content: body_words > 799 and citable < 1
G13 medium 1 medium geo-semantic-html: body_words > 399 and semantic < 1
G15 info 0 medium geo-tone: hedges > 3
""",
    "entity": """
N01 high 2 quick entity-brand-coherence: n_brand_roots >= 2
N04 low 1 heavy entity-wikipedia: org_same_as >= 1 and not org_wikipedia
N05 low 1 quick entity-searchaction: not (has_site and has_action)
N06 low 1 medium entity-linking: n_nouns > 14 and n_nouns_linked / n_nouns < 0.3
""",
    "eeat": """
E01 critical 3 medium eeat-https: not starts_with(url, 'https://')
E02 medium n_trust_missing / 2.0 medium eeat-trust-pages: n_trust_missing >= 1
E03 medium 1 quick eeat-author: is_editorial and not (length(meta_author) > 0 or article_author)
E04 low 1 medium eeat-person-schema: is_editorial and not list_contains(types, 'person')
E05 low 0.5 quick eeat-person-shallow: is_editorial and list_contains(types, 'person') and person_missing in (2, 3)
E06 low 0.5 medium eeat-review-policy: is_editorial and not (has_review or has_policy)
E07 low 1 medium eeat-citations: is_editorial and n_external in (0, 1, 2)
E08 low 0.5 quick eeat-bare-urls: is_editorial and n_external > 2 and n_bare > 2 and n_bare / n_external > 0.5
E10 medium 0.5 quick eeat-a11y-alt: n_imgs > 2 and (n_no_alt > 2 or n_no_alt / n_imgs > 0.2)
E11 low 0.5 quick eeat-a11y-skiplink: has_skip = false
E12 low 1 quick eeat-dates: is_editorial and not (has_time or has_dates)
""",
    "international": """
I01 info 0 quick international-single-lang: len(hreflangs) = 0
I02 medium 1 quick international-x-default: len(hreflangs) >= 1 and not has_x_default
I03 low 0.5 quick international-og-locale: len(hreflangs) >= 1 and length(og_locale) = 0
I04 medium 1 quick international-hreflang-dup: n_hreflang_distinct < len(hreflangs)
I05 high 1 quick international-format: n_hreflang_bad >= 1
I06 high 2 quick international-self-ref: len(hreflangs) >= 1 and length(self_lang) = 0
I07 medium 1 quick international-html-lang: length(self_lang) > 0 and length(html_lang) > 0 and lower(string_split(self_lang, '-')[1]) <> 'x' and lower(string_split(self_lang, '-')[1]) <> lower(string_split(html_lang, '-')[1])
I08 low 0.5 quick international-html-lang-missing: len(hreflangs) >= 1 and length(html_lang) = 0
I10 info 0 heavy international-url-strategy: len(hreflangs) >= 1 and cctld
""",
    "performance": """
P06 critical 3 heavy performance-hashrouter: n_hash_routes > 2
P07 high 2 heavy performance-ssr: body_chars < 201 and has_noscript = false
P08 low 0.5 medium performance-images-format: n_imgs >= 1 and n_modern = 0
P09 low 0.5 quick performance-lazy-loading: n_imgs > 3 and n_lazy = 0
P10 medium 1 quick performance-cls: n_imgs >= 1 and n_unsized / n_imgs > 0.3
P11 low 0.5 quick performance-preconnect: has_far_style and has_preconnect = false
P12 low 0.5 quick performance-font-preload: has_woff2 and has_font_preload = false
P13 medium 0.5 quick performance-scripts: n_blocking >= 1
""",
    "topical": """
O01 low 1 medium topical-linking-ratio: n_links > 9 and 2 * (n_links - n_internal_text) > n_internal_text
O02 medium 1 medium topical-anchor-overopt: n_internal_text > 5 and top_text / n_internal_text > 0.8
O03 medium 1 medium topical-anchor-generic: n_links > 7 and n_generic / n_links > 0.2
O04 low 0.5 heavy topical-pillar-hint: h1_count >= 1 and words > 1999 and n_internal_text < 5
O05 low 0.5 quick topical-authority-outbound: n_external > 4 and n_authority = 0
""",
    "common_mistakes": """
C01 critical 2 quick common-noindex: contains(robots, 'noindex') and admin_url = false
C02 high 1 quick common-mixed-content: starts_with(url, 'https://') and n_insecure >= 1
C03 low 0.5 quick common-noopener: n_blank > 2 and n_blank_open / n_blank > 0.3
C04 medium 1 medium common-canonical: length(canonical) > 0 and canonical_host = host and not canonical_loose = url_loose
C05 medium 0.5 quick common-duplicate-title: title_count >= 2
C06 medium 0.5 medium common-img-alt: n_imgs > 4 and n_no_alt / n_imgs > 0.3
C07 high 1 quick common-noindex-canonical: contains(robots, 'noindex') and length(canonical) > 0 and rtrim(canonical_url, '/') = rtrim(url, '/')
C08 medium 1 medium common-js-only-nav: has_js_nav
""",
}


def _said(phase: str, line: str) -> str:
    head, when = line.replace("OGIMAGE", resolve("og_image")).split(": ", 1)
    (rule, severity, *points), (effort, category) = head.split()[:-2], head.split()[-2:]
    return f"select page_id, host, url, '{rule}' as rule_id, '{phase}' as phase, '{category}' as category, '{severity}' as severity, cast({' '.join(points)} as double) as points, '{effort}' as effort from i where {when}"


_RULES = " union all ".join(_said(phase, line) for phase, lines in _SAID.items() for line in lines.strip().splitlines())
#: CTEs that end in fi, the findings of all page rules.
FINDINGS = f"{FEATURES}, {FACTS}, {INPUTS}, fi as ({_RULES})"
