"""Audits of code repositories: roles of files, stacks, and the rules that source files can show."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelantern.operators import site
from pagelantern.operators.joined_rules import _broken
from pagelantern.sources import features as fx

# The paths that may have a role, the first that exists counts; crawlers that code audits ask for.
ROLES = {
    "package": ["package.json"],
    "layout": ["app/layout.tsx", "app/layout.jsx", "app/layout.js", "src/app/layout.tsx", "src/app/layout.jsx", "pages/_document.tsx", "pages/_document.jsx", "pages/_document.js"],
    "page": ["app/page.tsx", "app/page.jsx", "app/page.js", "src/app/page.tsx", "pages/index.tsx", "pages/index.jsx", "pages/index.js"],
    "html": ["index.html", "public/index.html", "dist/index.html", "build/index.html"],
    "robots": ["public/robots.txt", "robots.txt", "app/robots.ts", "app/robots.tsx", "app/robots.js", "src/app/robots.ts"],
    "sitemap": ["public/sitemap.xml", "sitemap.xml", "app/sitemap.ts", "app/sitemap.tsx", "app/sitemap.js", "src/app/sitemap.ts"],
    "llms": ["public/llms.txt", "llms.txt", "app/llms.txt"],
}
BOTS = ["gptbot", "oai-searchbot", "chatgpt-user", "claudebot", "perplexitybot", "google-extended"]
SCRIPT = r"""(?is)<script[^>]*type=["']application/ld\+json["'][^>]*>(.*?)</script>"""
STRINGIFY = r"(?s)JSON\.stringify\(\s*(\{.*?\})\s*\)"


def roles(files: DataFrame) -> DataFrame:
    """repo, one column for each role (the content of the first file of the role's list), and what its paths tell.

    files: repo, path, content. Both are read in one aggregation by repository.
    """
    path = F.lower("path")
    ranked = {r: F.coalesce(*(F.when(F.col("path") == p, k) for k, p in enumerate(ps))) for r, ps in ROLES.items()}
    firsts = (F.min_by(F.when(at.isNotNull(), F.col("content")), F.when(F.col("content").isNotNull(), at)).alias(r) for r, at in ranked.items())
    return files.groupBy("repo").agg(
        *firsts,
        F.bool_or(path.startswith("app/layout.") | path.isin("app/page.tsx", "app/page.jsx")).alias("has_app"),
        F.bool_or(path.startswith("pages/")).alias("has_pages"),
        F.bool_or(path.contains("hashrouter") | path.endswith("router.tsx") | path.endswith("router.ts")).alias("has_router"),
        F.bool_or(path == "index.html").alias("has_index"),
    )


def stacks(snapshot: DataFrame) -> DataFrame:
    """snapshot (roles) with stack, ssr and router, by package.json's dependencies and the repository's paths."""
    keys = lambda k: f"coalesce(map_keys(from_json(get_json_object(package, '$.{k}'), 'map<string,string>')), cast(array() as array<string>))"
    s = snapshot.withColumn("deps", F.expr(f"array_union({keys('dependencies')}, {keys('devDependencies')})"))
    stack = """case when array_contains(deps, 'next') then if(has_pages and not has_app, 'next-pages', 'next-app')
      when arrays_overlap(deps, array('nuxt', 'nuxt3')) then 'nuxt' when arrays_overlap(deps, array('@remix-run/react', '@remix-run/node')) then 'remix'
      when array_contains(deps, 'astro') then 'astro' when array_contains(deps, 'react') then 'react-spa'
      when has_index and not arrays_overlap(deps, array('vue', 'svelte')) then 'static' else 'other' end"""
    s = s.withColumn("stack", F.expr(stack))
    router = F.when((F.col("stack") == "react-spa") & F.array_contains("deps", "vite") & F.col("has_router"), "hash").when(F.col("stack") == "react-spa", "history")
    return s.withColumns({"ssr": F.col("stack").isin("next-app", "next-pages", "nuxt", "remix", "astro"), "router": router}).drop("deps")


def jsonld_sources(snapshot: DataFrame) -> DataFrame:
    """snapshot with jsonld: the blocks in script tags, and in JSON.stringify calls that name schema.org as context."""
    blocks = lambda c: F.concat(
        F.transform(F.regexp_extract_all(c, F.lit(SCRIPT), F.lit(1)), F.trim),
        F.filter(F.regexp_extract_all(c, F.lit(STRINGIFY), F.lit(1)), lambda b: b.rlike(r"""(?i)['"]@context['"]\s*:\s*['"]https?://schema\.org""")),
    )
    return snapshot.withColumn("jsonld", F.concat(*(blocks(F.coalesce(c, F.lit(""))) for c in ("layout", "page", "html"))))


RULES = [
    ("K01", "'high'", "1", r"""not (head rlike r'\btitle\s*:\s*[\x27"`{]' or html rlike r'(?i)<title>[^<]+</title>')"""),
    ("K02", "'medium'", "1", r"""not (head rlike r'\bdescription\s*:\s*[\x27"`{]' or html rlike r'(?i)<meta\s+name=["\x27]description["\x27]')"""),
    ("K03", "'medium'", "1", r"""stack = 'static' and not html rlike r'(?i)<meta\s+name=["\x27]viewport["\x27]'"""),
    ("K04", "'low'", "1", r"""not (head rlike r'(?i)<html\s+lang=["\x27][\w-]+' or layout rlike r'\blang:\s*[\x27"`][\w-]+')"""),
    ("K05", "'medium'", "3 - og", "og < 3"),
    ("K06", "'medium'", "1", "no_robots"),
    ("K07", "'medium'", "2", "no_sitemap"),
    ("K08", "'critical'", "5", "n_objects = 0"),
    ("K09", "'critical'", "3", "not array_contains(types, 'organization')"),
    ("K10", "'medium'", "2", "not array_contains(types, 'website')"),
    ("K11", "'low'", "1", "n_objects > 0 and size(types) < 3"),
    ("K12", "'high'", "4", "llms = ''"),
    ("K13", "'low'", "1", r"llms <> '' and not (llms rlike r'(?m)^#\s+\S' and llms rlike r'(?m)^>\s+\S')"),
    ("K15", "'medium'", "2", "stack = 'static' and first_words < 100"),
    ("K16", "'low'", "1", r"layout <> '' and not layout rlike r'description\s*:'"),
]
#: The rule on crawlers that robots keeps out.
BOT_RULES = [("K14", "'critical'", "least(6, 2 * bots)", "bots > 0")]


def code_findings(files: DataFrame) -> DataFrame:
    """repo, rule_id, severity and points of the code rules that a repository breaks. A null content counts as absent."""
    return snapshot_findings(roles(files))


def snapshot_findings(snapshot: DataFrame) -> DataFrame:
    """The code findings of a snapshot (roles), which is read more than once. Contents are never shuffled: robots are judged beside them."""
    s = stacks(snapshot)
    closed = site.blocked_bots(s.select(F.col("repo").alias("host"), F.lit("robots").alias("kind"), F.col("robots").alias("body")), BOTS)
    bots = closed.groupBy(F.col("host").alias("repo")).agg(F.count("*").alias("bots"))
    s = s.withColumns({"no_robots": F.coalesce("robots", F.lit("")) == "", "no_sitemap": F.coalesce("sitemap", F.lit("")) == ""}).na.fill("", ["layout", "page", "html", "llms"])
    head = F.concat("layout", F.lit("\n"), "html")
    og = lambda word, name: (F.col("head").rlike(rf"\bopenGraph\s*:[\s\S]*?\b{word}\s*:") | F.col("html").rlike(rf"""(?i)<meta[^>]*property=["']og:{name}["']""")).cast("int")
    para = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_extract("html", r"(?is)<p(?:\s[^>]*)?>(.*?)</p>", 1), "<[^>]*>", ""), r"\s+", " "))
    s = s.withColumn("head", head)
    s = s.withColumns({"og": og("title", "title") + og("description", "description") + og("images?", "image"), "first_words": F.size(F.filter(F.split(para, " "), lambda w: w != ""))})
    return _broken(fx.jsonld_facts(jsonld_sources(s)), ["repo"], RULES).unionByName(_broken(bots, ["repo"], BOT_RULES))
