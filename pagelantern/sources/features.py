"""Page features as columns: html to one row a page, by native expressions only.

HTML is read without a DOM: `clean` is the html without comments, scripts and styles; a tag's text is what stands up to
its end tag, without tags, white space collapsed. Structured data is read from the html as it is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelantern.functions import text, urls

# Hosts of authorities, generic link texts, hedging phrases, quantified evidence, question openings, editorial and product paths and words.
AUTHORITY = r"(?i)\.gov(\.[a-z]{2})?$|\.edu(\.[a-z]{2})?$|(^|\.)(wikipedia\.org|wikidata\.org|britannica\.com|who\.int|europa\.eu|insee\.fr|nature\.com|sciencedirect\.com|nih\.gov|ieee\.org|acm\.org)$"
GENERIC = ["ici", "cliquez", "cliquez ici", "voir plus", "en savoir plus", "lire la suite", "click here", "read more", "learn more", "more"]
HEDGING = r"(?i)\b(peut[- ]être|il semble que|pourrait être|possiblement|probablement|il est possible que|maybe|perhaps|might be|seems to be)\b"
EVIDENCE = r"(?i)\b\d+\s*%|\b\d{2,}\s*(?:utilisateurs|clients|entreprises|employé|euros|€|\$|dollars|millions|milliards)"
QUESTION = r"(?i)\?$|^(qu[iemo]|comment|pourquoi|où|quand|quel|quelle|quels|quelles|que|what|how|why|when|where|which|who|is|are|do|does|can)([^A-Za-z0-9_]|$)"
EDITORIAL = r"(?i)/(blog|article|post|news|actualit|journal)/"
SAAS_PATH = r"(?i)/(pricing|tarif[fs]?|plans?|features?|fonctionnalit|dashboard|signup|register|trial|essai)\b"
SAAS_WORDS = r"(?i)\b(free trial|essai gratuit|abonnement|subscription|sign up|créer un compte|pricing)\b"
# Fixed values of the rules on proper nouns and trust pages.
WORD_END = "(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"  # a border of words of ASCII letters, as in URLs
NOUN = rf"(?<![A-Za-z0-9_])[A-Z][a-zà-ÿ]{{2,}}(?:\s[A-Z][a-zà-ÿ]{{2,}})?{WORD_END}"
NO_NOUNS = ["le", "la", "les", "un", "une", "des", "de", "du", "the"]
TRUST = [["about", "a-propos", "qui-sommes", "equipe"], ["contact"], ["mentions", "legal", "legales"], ["privacy", "confidentialite"]]


def squeeze(text):
    """Text without tags, white space collapsed, trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, "<[^>]*>", " "), r"\s+", " "))


def attr(tag, name: str):
    """Value of a quoted attribute of a tag, '' if absent."""
    return F.regexp_extract(tag, rf"""(?is)\s{name}=["']([^"']*)["']""", 1)


def tags(html, name: str):
    """Start tags of an element."""
    return F.regexp_extract_all(html, F.lit(rf"(?is)<{name}(?:\s[^>]*)?>"), F.lit(0))


def inner(html, name: str):
    """Squeezed texts of an element's occurrences."""
    return F.transform(F.regexp_extract_all(html, F.lit(rf"(?is)<{name}(?:\s[^>]*)?>(.*?)</{name}>"), F.lit(1)), squeeze)


def meta(name: str):
    """Content of the first meta tag of a name or property, '' if absent."""
    first = F.filter("metas", lambda m: m.rlike(rf"""(?i)\s(name|property)=["']{name}["']"""))
    return F.trim(F.coalesce(attr(F.get(first, 0), "content"), F.lit("")))


#: A tag that says how wide (high) it is; a tag in a menu that a script follows.
SIZED = r"""(?i)\s{}=["']?[^"'\s>]"""
JS_LINK = r"""(?is)<[a-z][^>]*\s(?:onclick\s*=|role=["']?button\b)[^>]*>|<button[^>]*\srole=["']?link\b"""


def link_tag(rel: str):
    return F.filter("link_tags", lambda t: t.rlike(rf"""(?i)\srel=["']{rel}["']"""))


def count(array, test):
    return F.size(F.filter(array, test))


def longest_run(items):
    """The length of the longest run of equal items of a sorted array of strings, 0 if it is empty."""
    start = F.struct(F.lit(None).cast("string").alias("last"), F.lit(0).alias("run"), F.lit(0).alias("most"))

    def step(at, x):
        run = F.when(at["last"] == x, at["run"] + 1).otherwise(1)
        return F.struct(x.alias("last"), run.alias("run"), F.greatest(at["most"], run).alias("most"))

    return F.aggregate(items, start, step, lambda at: at["most"])


#: Elements that end a paragraph and that are closed by a tag of their own; those whose paragraphs are the page's text; tags that end a paragraph.
CONTAINERS = "main|article|section|div|nav|header|footer|aside|ul|ol|dl|table|form|figure|figcaption|blockquote|details|summary|fieldset|address|menu|dialog|hgroup|center|pre"
TEXT_CONTAINERS = ["main", "article", "section"]
BLOCK_TAG = rf"(?is)</?(?:{CONTAINERS}|p|h[1-6]|hr|body)(?:\s[^>]*)?/?>"


def bound(value, use):
    """use(value) with value as a lambda variable, so that it is computed once however often use reads it."""
    return F.get(F.transform(F.array(value), use), 0)


def first_paragraph(body):
    """The first paragraph with text in main, article or section or directly in the body, else the first one anywhere, else ''.

    The body is cut at the tags that end a paragraph, so a paragraph's text is what follows its start tag. One walk over these
    tags counts which elements are open.
    """
    names = F.transform(F.regexp_extract_all(body, F.lit(BLOCK_TAG), F.lit(0)), lambda t: F.struct(F.lower(F.regexp_extract(t, r"^</?([A-Za-z0-9]+)", 1)).alias("name"), t.startswith("</").alias("ends")))
    texts = F.split(body, BLOCK_TAG)
    tags_ = F.zip_with(names, F.slice(texts, F.lit(2), F.greatest(F.size(texts) - 1, F.lit(0))), lambda n, t: F.struct(n["name"].alias("name"), n["ends"].alias("ends"), t.alias("text")))
    state = lambda inside, depth, good, other: F.struct(inside.alias("inside"), depth.alias("depth"), good.alias("good"), other.alias("other"))
    none = F.lit(None).cast("string")

    def step(at, t):
        move = F.when(t["ends"], -1).otherwise(1)
        text = F.when((t["name"] == "p") & ~t["ends"], F.nullif(squeeze(t["text"]), F.lit("")))
        own = F.greatest(F.lit(0), at["inside"] + F.when(t["name"].isin(TEXT_CONTAINERS), move).otherwise(0))
        open_ = F.greatest(F.lit(0), at["depth"] + F.when(t["name"].rlike(f"^({CONTAINERS})$"), move).otherwise(0))
        good = F.when((at["inside"] > 0) | (at["depth"] == 0), text)
        nxt = state(own, open_, good, F.coalesce(at["other"], text))
        return F.when(at["good"].isNotNull(), at).otherwise(nxt)

    return F.aggregate(tags_, state(F.lit(0), F.lit(0), none, none), step, lambda at: F.coalesce(at["good"], at["other"], F.lit("")))


def page_features(pages: DataFrame) -> DataFrame:
    """One row of features for each page (page_id, host, url, html, status, last_modified).

    A null html counts as empty. Arrays that later steps explode are kept (links, imgs, hreflangs, jsonld);
    the html itself is not.
    """
    p = pages.withColumn("html", F.coalesce("html", F.lit("")))
    p = p.withColumn("clean", F.regexp_replace("html", r"(?is)<!--.*?-->|<script\b[^>]*>.*?</script>|<style\b[^>]*>.*?</style>", " "))
    p = p.withColumns(
        {
            "head": F.regexp_extract("html", r"(?is)<head[^>]*>(.*?)</head>", 1),
            "body": F.regexp_extract("clean", r"(?is)<body[^>]*>(.*)", 1),
            "metas": tags(F.col("clean"), "meta"),
            "link_tags": tags(F.col("clean"), "link"),
            "script_tags": F.regexp_extract_all(F.regexp_replace("html", "(?s)<!--.*?-->", " "), F.lit(r"(?is)<script\s[^>]*>"), F.lit(0)),
            "anchor_tags": F.regexp_extract_all("clean", F.lit(r"(?is)<a\s[^>]*>.*?</a>"), F.lit(0)),
            "imgs": F.transform(
                tags(F.col("clean"), "img"),
                lambda t: F.struct(attr(t, "src").alias("src"), t.rlike(r"(?i)\salt=").alias("has_alt"), attr(t, "alt").alias("alt"), (t.rlike(SIZED.format("width")) & t.rlike(SIZED.format("height"))).alias("sized"), F.when(t.rlike(r"(?i)\ssrc="), attr(t, "src")).otherwise(attr(t, "srcset")).rlike(r"(?i)\.(webp|avif)(\?|$|\s)").alias("modern"), attr(t, "loading").alias("loading")),
            ),
            "titles": F.regexp_extract_all("clean", F.lit(r"(?is)<title[^>]*>(.*?)</title>"), F.lit(1)),
            "h1s": inner(F.col("clean"), "h1"),
            "h2s": F.filter(inner(F.col("clean"), "h2"), lambda h: h != ""),
            "sections": F.split("clean", r"(?i)<h2(?:\s[^>]*)?>"),
            "jsonld": F.filter(F.transform(F.regexp_extract_all("html", F.lit(r"""(?is)<script[^>]*type=["']application/ld\+json["'][^>]*>(.*?)</script>"""), F.lit(1)), lambda b: F.trim(b)), lambda b: b != ""),
        }
    )
    p = p.withColumns(
        {
            "links": F.transform(
                F.transform("anchor_tags", lambda a: F.struct(a.alias("tag"), F.regexp_extract(a, r"(?is)^(<a\s[^>]*>)", 1).alias("start"))),
                lambda x: F.struct(attr(x["start"], "href").alias("href"), F.lower(squeeze(x["tag"])).alias("text"), attr(x["start"], "rel").alias("rel"), attr(x["start"], "target").alias("target")),
            ),
            "hreflangs": F.filter(F.transform(link_tag("alternate"), lambda t: F.struct(attr(t, "hreflang").alias("lang"), attr(t, "href").alias("href"))), lambda x: (x["lang"] != "") & (x["href"] != "")),
            "body_text": squeeze(F.col("body")),
            "first_paragraph": first_paragraph(F.col("body")),
        }
    )
    word = lambda text: count(F.split(text, " "), lambda w: w != "")
    letters = lambda text: count(F.split(text, " "), lambda w: w.rlike(r"[A-Za-z0-9_\u00C0-\u024F]"))
    here, base = F.col("host"), F.col("url")
    external = lambda a: a["href"].startswith("http") & (urls.host(a["href"]) != here)
    internal = lambda a: urls.internal_path(a["href"], base).isNotNull()
    both = F.filter("links", lambda a: (a["href"] != "") & (a["text"] != ""))
    # links with a text that stay on the site: rooted, dotted, or of its host once resolved (fragments too)
    kept = lambda a: a["href"].rlike("^[/.]") | (urls.host(urls.resolve(a["href"], base)) == here)
    texts = F.transform(F.filter(both, kept), lambda a: a["text"])
    blank = F.filter("links", lambda a: external(a) & (F.lower(a["target"]) == "_blank"))
    canonical = F.trim(F.coalesce(attr(F.get(link_tag("canonical"), 0), "href"), F.lit("")))
    nouns = F.array_except(F.array_distinct(F.transform(F.regexp_extract_all("body_text", F.lit(NOUN), F.lit(0)), F.lower)), F.lit(NO_NOUNS))
    linked_texts = F.array_join(F.transform(F.filter("links", lambda a: a["href"].rlike(r"^[/.]")), lambda a: a["text"]), "\n")
    linked = lambda x: F.struct(F.size(x["nouns"]).alias("n"), F.size(F.filter(x["nouns"], x["texts"].contains)).alias("linked"))
    noun_counts = bound(F.struct(nouns.alias("nouns"), linked_texts.alias("texts")), linked)
    # an answer is a paragraph of 1 to 60 words after the heading and before the next
    answer = lambda s: squeeze(F.regexp_extract(s, r"(?is)</h2>.*?<p(?:\s[^>]*)?>(.*?)</p>", 1))
    out = {
        "path": urls.path(base),
        "title": F.coalesce(squeeze(F.get("titles", 0)), F.lit("")),
        "title_count": F.size("titles"),
        "description": meta("description"),
        "canonical": canonical,
        "canonical_url": F.when(canonical != "", urls.resolve(canonical, base)),
        "html_lang": F.coalesce(attr(F.get(tags(F.col("clean"), "html"), 0), "lang"), F.lit("")),
        "viewport": meta("viewport"),
        "has_charset": F.exists("metas", lambda m: m.rlike(r"""(?i)\scharset=|http-equiv=["']content-type["']""")),
        "has_icon": F.exists("link_tags", lambda t: t.rlike(r"""(?i)\srel=["'](shortcut )?icon["']""")),
        "has_touch_icon": F.size(link_tag("apple-touch-icon")) > 0,
        **{f"og_{k}": meta(f"og:{k}") for k in ("title", "description", "image", "url", "type", "locale", "site_name")},
        **{f"tw_{k}": meta(f"twitter:{k}") for k in ("card", "title", "description", "image")},
        "robots": F.lower(meta("robots")),
        "meta_author": meta("author"),
        "h1_count": F.size("h1s"),
        "h1": F.coalesce(F.get("h1s", 0), F.lit("")),
        "h2_count": F.size("h2s"),
        "h2_questions": count("h2s", lambda h: h.rlike(QUESTION)),
        "h2_unanswered": count(F.slice("sections", F.lit(2), F.size("sections")), lambda s: ~letters(answer(s)).between(1, 60)),
        "first_paragraph_words": letters(F.col("first_paragraph")),
        "body_words": letters(F.col("body_text")),
        "words": word(F.col("body_text")),
        "body_chars": F.length("body_text"),
        "html_bytes": F.octet_length("html"),
        "content_hash": F.sha2(F.lower("body_text"), 256),
        "has_evidence": F.col("body_text").rlike(EVIDENCE),
        "hedges": F.regexp_count("body_text", F.lit(HEDGING)),
        "citable": F.regexp_count("clean", F.lit(r"(?i)<(blockquote|q|cite)[\s>]")),
        "semantic": F.regexp_count("clean", F.lit(r"(?i)<(article|section|main|nav|aside|header|footer)[\s>]")),
        "has_article": F.col("clean").rlike(r"(?i)<article[\s>]"),
        "has_noscript": F.col("clean").rlike(r"(?i)<noscript[\s>]"),
        "has_time": F.col("clean").rlike(r"(?i)<time[^>]*\sdatetime="),
        "has_review": F.lower("body_text").rlike(r"\breviewed\s+by\b|\brelu\s+par\b|\bvérifié\s+par\b|\bfact[- ]check"),
        "n_nouns": noun_counts["n"],
        "n_nouns_linked": noun_counts["linked"],
        "dst_paths": F.array_distinct(F.array_compact(F.transform("links", lambda a: urls.internal_path(a["href"], base)))),
        "n_links": F.size(both),
        "n_internal": count("links", internal),
        "n_internal_text": F.size(texts),
        "n_external": count("links", external),
        "n_authority": count("links", lambda a: external(a) & urls.host(a["href"]).rlike(AUTHORITY)),
        "n_generic": count(both, lambda a: a["text"].rlike(rf"(^|\s)({'|'.join(GENERIC)})$")),
        "n_bare": count("links", lambda a: a["href"].startswith("http") & a["text"].rlike("^https?://")),
        "top_text": longest_run(F.array_sort(texts)),
        "n_hash_routes": count("links", lambda a: a["href"].rlike(r"^/?#/\w")),
        "n_blank": F.size(blank),
        "n_blank_open": count(blank, lambda a: ~a["rel"].rlike("(?i)noopener")),
        "n_trust_missing": sum((F.when(F.exists("links", lambda a: F.lower(a["href"]).rlike("|".join(w)) | a["text"].rlike("|".join(w))), 0).otherwise(1) for w in TRUST), F.lit(0)),
        "has_skip": F.exists("links", lambda a: a["href"].isin("#main", "#main-content", "#contenu-principal") | (a["href"].startswith("#") & a["text"].rlike(r"\b(skip|aller|contenu|main)\b"))),
        "has_policy": F.exists("links", lambda a: F.concat_ws(" ", a["href"], a["text"]).rlike(r"(?i)editorial[- ]?policy|methodology|politique[- ]?éditoriale|m[ée]thodologie|charte éditoriale")),
        "is_saas": F.exists("links", lambda a: a["href"].rlike(SAAS_PATH)) | F.substring("body_text", 1, 3000).rlike(SAAS_WORDS),
        "n_imgs": F.size("imgs"),
        "n_no_alt": count("imgs", lambda i: ~i["has_alt"]),
        "n_modern": count("imgs", lambda i: i["modern"]),
        "n_lazy": count("imgs", lambda i: F.lower(i["loading"]) == "lazy"),
        "n_unsized": count("imgs", lambda i: ~i["sized"]),
        "n_hreflang": F.size("hreflangs"),
        "n_hreflang_distinct": F.size(F.array_distinct(F.transform("hreflangs", lambda x: F.lower(x["lang"])))),
        "has_x_default": F.exists("hreflangs", lambda x: F.lower(x["lang"]) == "x-default"),
        "n_hreflang_bad": count("hreflangs", lambda x: ~x["lang"].rlike(r"^(x-default|[a-z]{2,3}(-([A-Z]{2}|Hans|Hant|Latn|Cyrl))?)$")),
        "self_lang": F.get(F.transform(F.filter("hreflangs", lambda x: F.regexp_replace(urls.resolve(x["href"], base), "/+$", "") == F.regexp_replace(base, "/+$", "")), lambda x: x["lang"]), 0),
        "n_insecure": F.regexp_count("clean", F.lit(r"""(?i)\s(src|href)=["']http://(?!localhost)""")) + count("script_tags", lambda t: t.rlike(r"""(?i)\ssrc=["']http://(?!localhost)""")),
        "n_blocking": F.size(F.filter(F.regexp_extract_all("head", F.lit(r"(?is)<script\s[^>]*\ssrc=[^>]*>|<script\ssrc=[^>]*>"), F.lit(0)), lambda t: ~t.rlike(r"(?i)\s(async|defer)"))),
        "has_preconnect": F.size(link_tag("preconnect")) > 0,
        "has_far_style": F.exists("link_tags", lambda t: t.rlike(r"""(?i)rel=["']stylesheet["']""") & t.rlike(r"""(?i)href=["']http""")),
        "has_woff2": F.exists("link_tags", lambda t: t.rlike(r"(?i)href=[^>]*\.woff2")),
        "has_font_preload": F.exists("link_tags", lambda t: t.rlike(r"""(?i)rel=["']preload["']""") & t.rlike(r"""(?i)as=["']font["']""")),
        "has_js_nav": F.exists(F.regexp_extract_all("clean", F.lit(r"(?is)<nav[\s>].*?</nav>"), F.lit(0)), lambda n: ~n.rlike(r"(?i)<a\s[^>]*href=") & (F.regexp_count(n, F.lit(JS_LINK)) >= 3)),
        "depth": count(F.split(urls.path(base), "/"), lambda s: s != ""),
        "guide_heading": F.exists(F.concat("h1s", "h2s"), lambda h: h.rlike("(?i)guide|tutoriel|comment")),
        "times": F.regexp_extract_all("clean", F.lit(r"""(?is)<time[^>]*\sdatetime=["']([^"']*)["']"""), F.lit(1)),
    }
    made = p.select("page_id", "host", "url", "status", "last_modified", *(c.alias(n) for n, c in out.items()), "links", "imgs", "hreflangs", "jsonld", "h2s")
    return made.withColumns(
        {
            "is_editorial": F.col("url").rlike(EDITORIAL) | F.col("has_article"),
            "page_kind": F.expr(rf"case when url rlike r'{EDITORIAL}' or has_article then case when guide_heading then 'evergreen' else 'blog' end when url rlike r'(?i)/(product|produit|shop|boutique|feature|pricing|tarifs)/' then 'product' else 'landing' end"),
        }
    )


def _at(field: str) -> str:
    return f"try_variant_get(v, r'$[\"{field}\"]', 'variant')"


def _text(x: str) -> str:
    """A variant's string, null if it is none."""
    return f"case when schema_of_variant({x}) = 'STRING' then try_variant_get({x}, '$', 'string') end"


def _named(field: str) -> str:
    """A field that is a string, or an object's name, or without one its url; null if empty."""
    x = _at(field)
    inner = lambda k: f"try_variant_get({x}, r'$[\"{k}\"]', 'variant')"
    return f"nullif(case when schema_of_variant({x}) = 'STRING' then {_text(x)} when {inner('name')} is not null then {_text(inner('name'))} else {_text(inner('url'))} end, '')"


def _holds(field: str) -> str:
    """Whether a field has a value: not null, false, zero or the empty string."""
    x = _at(field)
    return f"coalesce(case when schema_of_variant({x}) like 'OBJECT%' or schema_of_variant({x}) like 'ARRAY%' then true else try_variant_get({x}, '$', 'string') not in ('', 'false', '0') end, false)"


def _list(x: str) -> str:
    """A string or an array's strings."""
    return f"array_compact(case when schema_of_variant({x}) like 'ARRAY%' then try_variant_get({x}, '$', 'array<string>') else array({_text(x)}) end)"


# What an article of structured data should state.
ARTICLE = ["headline", "datePublished", "dateModified", "author", "publisher", "image", "mainEntityOfPage"]
#: An object of structured data as the rules see it: SQL over a variant v.
OBJECT = {
    "types": f"transform({_list(_at('@type'))}, t -> lower(t))",
    "name": _named("name"),
    "same_as": _list(_at("sameAs")),
    "n_org_missing": " + ".join(f"int({_named(f)} is null)" for f in ("name", "url", "logo")),
    "article_gaps": "array_except(array(" + ", ".join(f"'{f}'" for f in ARTICLE) + "), array_compact(array(" + ", ".join(f"if({_holds(f)}, '{f}', null)" for f in ARTICLE) + ")))",
    "n_person_missing": f"int(not {_holds('jobTitle')}) + int(size({_list(_at('sameAs'))}) = 0) + int(not {_holds('knowsAbout')})",
    "search": f"exists({_list("try_variant_get(v, r'$.potentialAction[\"@type\"]', 'variant')")}, t -> lower(t) like '%searchaction%')",
    "action": f"coalesce(schema_of_variant({_at('potentialAction')}) like 'OBJECT%' or schema_of_variant({_at('potentialAction')}) like 'ARRAY%', false)",
    "author": _holds("author"),
    "author_text": f"coalesce(schema_of_variant({_at('author')}) = 'STRING', false)",
    "image": f"nullif(coalesce({_text(_at('image'))}, {_text("try_variant_get(v, '$.image.url', 'variant')")}), '')",
    "published": _text(_at("datePublished")),
    "modified": _text(_at("dateModified")),
    "dated": f"{_holds('datePublished')} or {_holds('dateModified')}",
}


def jsonld_facts(features: DataFrame) -> DataFrame:
    """features with columns of its structured data (jsonld), computed inside the row: no second scan and no join.

    Arrays and @graph lists are opened until none is left, at any depth. Of several objects of a type the first counts. Blocks
    that do not parse are counted in n_broken. A page without structured data has zeros, false and an empty list of types.
    """
    # a level is opened a step, and each level has a bracket of its own in the text; steps after the last level do nothing
    closed = "(schema_of_variant(v) like 'ARRAY%' or (schema_of_variant(v) like 'OBJECT%' and coalesce(schema_of_variant(try_variant_get(v, r'$[\"@graph\"]', 'variant')) like 'ARRAY%', false)))"
    opened = "flatten(transform(s.items, v -> coalesce(try_variant_get(v, '$', 'array<variant>'), try_variant_get(v, r'$[\"@graph\"]', 'array<variant>'), array(v))))"
    state = f"transform(array({{0}}), x -> named_struct('items', x, 'more', exists(x, v -> {closed})))[0]"
    levels = "sequence(1, aggregate(jsonld, 1, (n, b) -> n + regexp_count(b, r'\\[')))"
    f = features.withColumn("parsed", F.expr("transform(jsonld, b -> try_parse_json(b))"))
    f = f.withColumn("n_broken", F.expr("size(filter(parsed, v -> v is null))"))
    f = f.withColumn("parsed", F.expr("filter(parsed, v -> v is not null)"))
    roots = "filter(flatten(transform(parsed, v -> coalesce(try_variant_get(v, '$', 'array<variant>'), array(v)))), v -> schema_of_variant(v) like 'OBJECT%' or schema_of_variant(v) like 'ARRAY%')"
    f = f.withColumns({"n_no_context": F.expr(f"size(filter({roots}, v -> not {_holds('@context')}))"), "n_http_context": F.expr(f"size(filter({roots}, v -> coalesce({_text(_at('@context'))} like 'http://%', false)))")})
    f = f.withColumn("parsed", F.expr(f"aggregate({levels}, {state.format('parsed')}, (s, k) -> if(s.more, {state.format(opened)}, s), s -> s.items)"))
    fields = ", ".join(f"'{k}', {e}" for k, e in OBJECT.items())
    f = f.withColumn("objects", F.expr(f"transform(filter(parsed, v -> schema_of_variant(v) like 'OBJECT%'), v -> named_struct({fields}))")).drop("parsed")
    first = lambda *names: F.coalesce(*(F.get(F.filter("objects", lambda o: F.array_contains(o["types"], n)), 0) for n in names))
    f = f.withColumns({"org": first("organization"), "site": first("website"), "article": first("article", "blogposting", "newsarticle"), "person": first("person")})
    said = lambda c, field, default: F.coalesce(F.col(f"{c}.{field}"), F.lit(default))
    same = lambda host: F.coalesce(F.exists("org.same_as", lambda s: F.lower(s).contains(host)), F.lit(False))
    dates = F.transform("objects", lambda o: F.coalesce(text.date(o["modified"]), text.date(o["published"])))
    facts = {
        "n_objects": F.size("objects"),
        "types": F.array_sort(F.array_distinct(F.flatten(F.transform("objects", lambda o: o["types"])))),
        "has_org": F.col("org").isNotNull(),
        "org_missing": said("org", "n_org_missing", 0),
        "org_same_as": F.coalesce(F.size("org.same_as"), F.lit(0)),
        "org_wikidata": same("wikidata.org"),
        "org_wikipedia": same("wikipedia.org"),
        "org_name": F.col("org.name"),
        "has_site": F.col("site").isNotNull(),
        "has_search": said("site", "search", False),
        "has_action": said("site", "action", False),
        "has_article_type": F.col("article").isNotNull(),
        "article_missing": F.coalesce(F.size("article.article_gaps"), F.lit(0)),
        "article_gaps": F.array_join("article.article_gaps", ","),
        "article_author": F.exists("objects", lambda o: o["author"] & F.exists(o["types"], lambda t: t.rlike("article|blogposting"))),
        "author_text": said("article", "author_text", False),
        "image_relative": F.coalesce(~F.col("article.image").rlike("(?i)^https?://"), F.lit(False)),
        "has_person": F.col("person").isNotNull(),
        "person_missing": said("person", "n_person_missing", 0),
        "has_dates": F.exists("objects", lambda o: o["dated"]),
        "ld_date": F.array_max(dates),
    }
    return f.withColumns(facts).drop("objects", "org", "site", "article", "person")
