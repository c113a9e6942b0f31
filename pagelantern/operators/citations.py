"""Citations in answers of answer engines: parsing responses, flags, rates, rankings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelantern.functions import urls

RESPONSE = "struct<output:array<struct<type:string,content:array<struct<text:string,annotations:array<struct<url:string>>>>,results:array<struct<url:string>>>>>"


def parse_responses(raw: DataFrame) -> DataFrame:
    """answer_id, response_text and citation_urls of JSON responses (answer_id, raw): texts joined, annotations and search results."""
    r = raw.withColumn("r", F.from_json("raw", RESPONSE))
    content = F.flatten(F.transform("r.output", lambda o: F.coalesce(o["content"], F.expr("array()"))))
    cited = F.flatten(F.transform(content, lambda c: F.coalesce(c["annotations"]["url"], F.array().cast("array<string>"))))
    found = F.flatten(F.transform("r.output", lambda o: F.coalesce(o["results"]["url"], F.array().cast("array<string>"))))
    return r.select("answer_id", F.array_join(F.transform(content, lambda c: c["text"]), "\n").alias("response_text"), F.array_distinct(F.concat(F.coalesce(cited, F.array().cast("array<string>")), F.coalesce(found, F.array().cast("array<string>")))).alias("citation_urls"))


def domains(text: Column, cited: Column) -> Column:
    """Distinct domains of the URLs in a text and of a list of URLs."""
    found = F.regexp_extract_all(text, F.lit(r"https?://[^\s\"'<>)\]]+"), F.lit(0))
    return F.array_distinct(F.array_compact(F.transform(F.concat(found, cited), urls.domain)))


def mentioned(text: Column, domain: str) -> Column:
    """Whether a domain stands in a text as a whole, in any case."""
    return F.lower(text).rlike("(^|[^a-z0-9_.-])" + domain.lower().replace(".", r"\.") + "([^a-z0-9_-]|$)")


def flags(answers: DataFrame, domain: str) -> DataFrame:
    """answer_id, is_cited and competitors (all other domains) of answers (answer_id, response_text, citation_urls)."""
    a = answers.withColumn("all", domains(F.col("response_text"), F.col("citation_urls")))
    cited = F.array_contains("all", domain) | mentioned(F.col("response_text"), domain)
    return a.select("answer_id", cited.alias("is_cited"), F.array_sort(F.array_remove("all", domain)).alias("competitors"))


def competitor_ranking(flagged: DataFrame, n: int = 10) -> DataFrame:
    """domain and answers of the n domains that most answers cite."""
    return flagged.select(F.explode("competitors").alias("domain")).groupBy("domain").agg(F.count("*").alias("answers")).orderBy(F.desc("answers"), "domain").limit(n)


def truncated(text: Column, most: int) -> Column:
    """A text cut to `most` characters, with an ellipsis if it was longer."""
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("…"))).otherwise(text)


def grid(queries: DataFrame, tools: list[str]) -> DataFrame:
    """Every query for every tool; tools are a short list."""
    return queries.withColumn("tool", F.explode(F.lit(tools)))
