"""Code repositories bound to the documents table: each document is a repository of a few files that hold its text.

SQL text that Spark and the comparison engine both run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelantern.sources.tables import table

_LD = """'<script type="application/ld+json">{"@context":"https://schema.org","@graph":[{"@type":"' || case doc_id % 4 when 0 then 'Organization' when 1 then 'WebSite' else 'Thing' end || '"},{"@type":["Person","' || case when doc_id % 5 = 0 then 'WebSite' else 'Article' end || '"]}]}</script>'"""
#: Path, whether a document's repository has it, and its content.
FILES = [
    ("'package.json'", "doc_id % 4 < 3", """'{"dependencies":{' || case doc_id % 6 when 0 then '"next":"14","react":"18"' when 1 then '"nuxt":"3"' when 2 then '"react":"18"' when 3 then '"astro":"4"' when 4 then '"vue":"3"' else '"@remix-run/node":"2"' end || '},"devDependencies":{"vite":"5"}}'"""),
    ("'app/layout.tsx'", "doc_id % 3 = 0", "'export const metadata = { ' || case when doc_id % 2 = 0 then 'title: \"T\", ' else '' end || case when doc_id % 5 < 2 then 'description: \"D\", ' else '' end || case when doc_id % 7 = 0 then 'openGraph: { title: \"a\", description: \"b\", images: [] }' else '' end || '};' || case when doc_id % 4 = 1 then '<html lang=\"en\">' else '' end"),
    ("'src/app/layout.tsx'", "doc_id % 3 = 0", "'never read'"),
    ("'pages/index.tsx'", "doc_id % 9 = 0", "'JSON.stringify({\"@context\": \"https://schema.org\", \"@type\": \"Organization\"}) JSON.stringify({ other: 1 })'"),
    ("'pages/_document.tsx'", "doc_id % 9 = 1", "'<Html lang=\"fr\">' || case when doc_id % 2 = 0 then ' description: \"d\"' else '' end"),
    ("'src/Router.tsx'", "doc_id % 4 = 2", "'routes'"),
    ("'index.html'", "doc_id % 3 = 1", f"'<html' || case when doc_id % 2 = 0 then ' lang=\"en\"' else '' end || '><head>' || case when doc_id % 5 = 0 then '<title>T</title><meta name=\"description\" content=\"d\"><meta name=\"viewport\" content=\"w\">' else '' end || case when doc_id % 8 = 0 then '<meta property=\"og:title\" content=\"t\">' else '' end || '</head><body><p>' || coalesce(text, '') || '</p>' || case when doc_id % 7 < 3 then {_LD} when doc_id % 7 = 3 then '<script type=\"application/ld+json\">{{broken</script>' else '' end || '</body></html>'"),
    ("'dist/index.html'", "doc_id % 3 = 1", "'never read'"),
    ("'public/robots.txt'", "doc_id % 2 = 0", "'User-agent: ' || case doc_id % 5 when 0 then 'GPTBot' when 1 then '*' else 'Other' end || chr(10) || 'Disallow: ' || case when doc_id % 3 < 2 then '/' else '/x' end"),
    ("'robots.txt'", "doc_id % 5 = 0", "'User-agent: *' || chr(10) || 'Disallow:'"),
    ("'public/sitemap.xml'", "doc_id % 4 = 1", "'<urlset></urlset>'"),
    ("'public/llms.txt'", "doc_id % 5 < 3", "case doc_id % 5 when 0 then '# Site' || chr(10) || '> About' when 1 then '# Site' else 'plain' end"),
]


def code_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """repo, path and content of every file."""
    files = [F.when(F.expr(has), F.struct(F.expr(path).alias("path"), F.expr(content).alias("content"))) for path, has, content in FILES]
    docs = table(spark, sf_dir, "documents").where("doc_id is not null")
    return docs.select(F.col("doc_id").alias("repo"), F.explode(F.array_compact(F.array(*files))).alias("f")).select("repo", "f.*")


CODE_SQL = "cf as (" + " union all ".join(f"select doc_id as repo, {path} as path, {content} as content from documents where {has}" for path, has, content in FILES) + ")"
