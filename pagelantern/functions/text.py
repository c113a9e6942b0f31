"""Text functions as columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# How known terms are written, in the order in which they are set.
TERMS = [
    (r"(?i)\bchatgpt\b", "ChatGPT"), (r"(?i)\bgpt-?4o?\b", "GPT-4"), (r"(?i)\bopen\s*ai\b", "OpenAI"), (r"(?i)\banthropic\b", "Anthropic"), (r"(?i)\bperplexity\b", "Perplexity"), (r"(?i)\bgemini\b", "Gemini"), (r"(?i)\bcopilot\b", "Copilot"),
    (r"(?i)\bbing\b", "Bing"), (r"(?i)\bclaude\b", "Claude"), (r"\bgoogle\b", "Google"), (r"(?i)\bgooglebot\b", "Googlebot"), (r"(?i)\bgptbot\b", "GPTBot"), (r"(?i)\bclaudebot\b", "ClaudeBot"), (r"(?i)\bperplexitybot\b", "PerplexityBot"),
    (r"(?i)\bi\.?a\b", "IA"), (r"(?i)\bai\s+overviews?\b", "AI Overviews"), (r"(?i)\bseo\b", "SEO"), (r"(?i)\bgeo\b", "GEO"), (r"(?i)\be-?e-?a-?t\b", "E-E-A-T"), (r"(?i)\bcwv\b", "CWV"), (r"(?i)\blcp\b", "LCP"), (r"(?i)\binp\b", "INP"), (r"(?i)\bcls\b", "CLS"),
    (r"(?i)\btbt\b", "TBT"), (r"(?i)\bfcp\b", "FCP"), (r"(?i)\bttfb\b", "TTFB"), (r"(?i)\bserp\b", "SERP"), (r"(?i)\bhtml\b", "HTML"), (r"(?i)\bjson-?ld\b", "JSON-LD"), (r"(?i)\bhttp\b(?!s|://|/\w|\w)", "HTTP"), (r"(?i)\bhttps\b(?!://|/\w|\w)", "HTTPS"),
    (r"(?i)\bwikipedia\b", "Wikipedia"), (r"(?i)\bwikidata\b", "Wikidata"), (r"(?i)\bahrefs\b", "Ahrefs"), (r"(?i)\bsemrush\b", "Semrush"), (r"(?i)\bsurfer\s*seo\b", "Surfer SEO"), (r"(?i)\bmoz\b", "Moz"), (r"(?i)\bschema\.org\b", "Schema.org"),
]
PROTECTED = r"(`[^`]+`|<code>[^<]+</code>|https?://[^\s<>\"')]+)"


def canonical_casing(text: Column, terms=TERMS) -> Column:
    """Known terms in their usual case, as words of ASCII letters; code in backquotes or <code> and URLs stay as they are."""
    free = F.split(text, PROTECTED)
    kept = F.regexp_extract_all(text, F.lit(PROTECTED), F.lit(1))

    known = F.array(*(F.struct(F.lit(needle(p)).alias("needle"), F.lit(ascii_borders(p)).alias("pattern"), F.lit(term).alias("term")) for p, term in terms))

    def fixed(s):
        # terms whose letters are not in the piece are passed over by a plain search, without their patterns
        there = F.filter(known, lambda t: F.contains(s["low"], t["needle"]))
        return F.aggregate(there, s["x"], lambda x, t: F.regexp_replace(x, t["pattern"], t["term"]))

    pieces = F.transform(free, lambda x: F.struct(x.alias("x"), F.lower(x).alias("low")))
    return F.array_join(F.flatten(F.zip_with(F.transform(pieces, fixed), kept, lambda a, b: F.array(a, F.coalesce(b, F.lit(""))))), "")


def date(said: Column) -> Column:
    """The time stamp of a text that begins with a year; null for others, as Spark reads times of day and words ('now') as of today."""
    return F.when(said.rlike(r"^\s*[+-]?\d{4}"), F.try_to_timestamp(said))


def needle(pattern: str) -> str:
    """The longest run of letters that every match of a pattern holds, in lower case; empty for a pattern with groups or classes.

    Replacing a term by its usual form keeps its letters in order, so what a text lacks at first it lacks after other terms too.
    """
    plain = re.sub(r"\(\?![^()]*\)|\(\?i\)|\\b", " ", pattern)
    if re.search(r"[|(\[{]", plain):
        return ""
    sure = re.sub(r"\\?.[?*]", " ", plain)
    return max(re.findall("[a-z]+", re.sub(r"\\[a-zA-Z]", " ", sure).lower()), key=len, default="")


def ascii_borders(pattern: str) -> str:
    """A pattern whose borders of words are those of ASCII letters, digits and the underscore."""
    start, end = "(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])", "(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])"
    first, *rest = pattern.split(r"\b")
    return first + "".join((start if k % 2 == 0 else end) + part for k, part in enumerate(rest))


def words(text: Column) -> Column:
    """Number of words, split at white space."""
    return F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))
