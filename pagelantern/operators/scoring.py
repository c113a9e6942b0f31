"""Scores, priorities and report tables from findings (audit_id, n, phase, severity, effort, points, url, title, recommendation)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Order of severities; phases of each mode; subjects by pattern, the first match counts; letters without accents; labels of severities, phases, efforts and levels; phases by audience.
SEVERITY = {"critical": 5, "high": 4, "medium": 3, "low": 2, "info": 1}
MODES = {"flash": ["technical", "structured_data", "geo", "eeat"], "standard": ["technical", "structured_data", "geo", "entity", "eeat", "freshness", "international", "performance"]}
SUBJECTS = [
    ("llms-full.txt", r"\bllms-full\.txt\b"),
    ("llms.txt", r"\bllms\.txt\b"),
    ("robots.txt", r"\brobots\.txt\b"),
    ("sitemap.xml", r"\bsitemap(\.xml)?\b"),
    ("datepublished", r"\bdate\s*published\b|\bdate de publication\b"),
    ("datemodified", r"\bdate\s*modified\b|\bdate de modification\b"),
    ("sameas", r"\bsame\s*as\b"),
    ("canonical", r"\bcanonical\b"),
    ("hreflang", r"\bhreflang\b"),
    ("noindex", r"\bnoindex\b"),
    ("og-meta", r"\bopen\s*graph\b|\bog\s(?:title|description|image|url|type|locale)\b"),
    ("twitter-cards", r"\btwitter\s*cards?\b|\btwitter\s(?:title|description|image)\b"),
    ("meta-description", r"\b(?:meta\s*)?description\s*(?:manquante?|absente?|vide)\b|\bdescription\s*non renseign"),
    ("title-tag", r"\btitle\s*(?:manquant|absent|vide)\b|\bbalise\s*title\b"),
    ("favicon", r"\bfavicon\b"),
    ("schema-organization", r"\bschema\s*organization\b|\borganization\s*(?:schema|json-?ld)\b"),
    ("schema-website", r"\bschema\s*website\b|\bwebsite\s*(?:schema|json-?ld)\b"),
    ("schema-article", r"\bschema\s*article\b|\barticle\s*(?:schema|json-?ld)\b|\bblogposting\b"),
    ("schema-person", r"\bschema\s*person\b|\bperson\s*(?:schema|json-?ld)\b"),
    ("schema-breadcrumb", r"\bbreadcrumb(?:list)?\b|\bfil\s*d.ariane\b"),
    ("schema-product", r"\bschema\s*product\b|\bproduct\s*(?:schema|json-?ld)\b"),
    ("schema-faqpage", r"\bfaqpage\b|\bschema\s*faq\b"),
    ("schema-howto", r"\bschema\s*howto\b|\bhow-?to\s*(?:schema|json-?ld)\b"),
    ("web-vital-lcp", r"\blcp\b|\blargest\s*contentful\s*paint\b"),
    ("web-vital-inp", r"\binp\b|\binteraction\s*to\s*next\s*paint\b"),
    ("web-vital-cls", r"\bcls\b|\bcumulative\s*layout\s*shift\b"),
    ("mixed-content", r"\bmixed\s*content\b|\bcontenu\s*mixte\b"),
    ("redirect-chain", r"\bredirect\s*chain\b|\bchaines?\s*de\s*redirections?\b"),
    ("wikidata", r"\bwikidata\b"),
    ("wikipedia", r"\bwikipedia\b"),
]
ACCENTS = ("àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy")
LABELS = {"critical": "Critique", "high": "Élevé", "medium": "Moyen", "low": "Faible", "info": "Info"}
PHASE_LABELS = {
    "technical": "SEO technique",
    "structured_data": "Données structurées",
    "geo": "Visibilité IA (GEO)",
    "entity": "Identité de marque (Entity)",
    "eeat": "Crédibilité (E-E-A-T)",
    "freshness": "Fraîcheur du contenu",
    "international": "International (hreflang)",
    "performance": "Performance (Core Web Vitals)",
    "topical": "Autorité thématique",
    "common_mistakes": "Erreurs courantes",
    "synthesis": "Synthèse",
}
EFFORT_LABELS = {"quick": "Rapide (< 1 h)", "medium": "Moyen (< 1 jour)", "heavy": "Lourd (> 1 jour)"}
LEVEL_LABELS = {"excellent": "Excellent", "good": "Bon", "fair": "À améliorer", "poor": "Critique"}
AUDIENCES = {"technical": ["technical", "structured_data", "performance", "topical", "common_mistakes"], "marketing": ["geo", "eeat", "entity", "freshness", "international"]}


def round1(x: Column) -> Column:
    """To one decimal, halves up."""
    return F.floor(x * 10 + 0.5) / 10


def weight(severity: Column) -> Column:
    """A severity's rank, 0 for an unknown one."""
    return F.coalesce(*(F.when(severity == s, w) for s, w in SEVERITY.items()), F.lit(0))


def input_bytes(df: DataFrame) -> int:
    """The bytes of the tables that df reads, as its plan states them; tables of unknown size, such as lists of rows, count as none."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(leaves.apply(k).stats().sizeInBytes()) for k in range(leaves.size())]
    return sum(x for x in sizes if x < 1 << 62)


def dealt(df: DataFrame, *keys: str, each: int = 8 << 20) -> DataFrame:
    """df by the hash of keys over the session's shuffle partitions, or one for `each` bytes that df reads if these are more.

    So a task's share does not grow with the tables. Aggregations and joins by these keys need no other shuffle. Where a map side's
    aggregation finds little to merge, this spares its memory, and adaptive execution leaves partitions as they are, where it would
    join them by their compressed size.
    """
    return df.repartition(max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-input_bytes(df) // each)), *keys)


def phase_scores(audits: DataFrame, findings: DataFrame, rubric: DataFrame) -> DataFrame:
    """audit_id, phase, score and score_max for every phase of every audit: the maximum less the points lost, never below zero."""
    # an audit's losses are one map of its phases, so the rows of all phases of all audits are never shuffled or sorted
    lost = dealt(findings.where("phase is not null").select("audit_id", "phase", "points"), "audit_id").groupBy("audit_id", "phase").agg(F.sum("points").alias("lost"))
    lost = lost.groupBy("audit_id").agg(F.map_from_entries(F.collect_list(F.struct("phase", "lost"))).alias("lost"))
    every = audits.select("audit_id").join(lost, "audit_id", "left").crossJoin(F.broadcast(rubric))  # the rubric is ten rows
    left = F.col("score_max") - F.coalesce(F.try_element_at("lost", F.col("phase")), F.lit(0.0))
    return every.select("audit_id", "phase", round1(F.greatest(F.lit(0.0), left)).alias("score"), "score_max")


def audit_scores(scores: DataFrame) -> DataFrame:
    """audit_id and total, out of 100."""
    return scores.groupBy("audit_id").agg(round1(F.sum("score") / F.nullif(F.sum("score_max"), F.lit(0.0)) * 100).alias("total"))


def mode_scores(scores: DataFrame) -> DataFrame:
    """audit_id, mode and total for each mode's phases (full: all)."""
    def total(mode, of):
        share = F.sum(F.when(of, F.col("score"))) / F.sum(F.when(of, F.col("score_max")))
        return F.struct(F.lit(mode).alias("mode"), F.count_if(of).alias("n"), round1(share * 100).alias("total"))

    totals = [total("full", F.lit(True))] + [total(m, F.col("phase").isin(ps)) for m, ps in MODES.items()]
    out = scores.groupBy("audit_id").agg(F.array(*totals).alias("x")).select("audit_id", F.explode("x").alias("x")).select("audit_id", "x.*")
    return out.where("n > 0").drop("n")


def breakdown(scores: DataFrame) -> DataFrame:
    """audit_id and breakdown, a map from phase to score."""
    return scores.groupBy("audit_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("phase", "score")))).alias("breakdown"))


def severity_counts(findings: DataFrame) -> DataFrame:
    return findings.groupBy("audit_id").agg(*(F.count_if(F.col("severity") == s).alias(s) for s in SEVERITY))


def kpis(findings: DataFrame) -> DataFrame:
    """audit_id, critical, high, quick wins (and their points) and what fixing could gain, low and high estimate."""
    quick = (F.col("effort") == "quick") & (F.col("points") >= 0.5)
    open_points = F.sum(F.when(F.col("severity") != "info", F.col("points")).otherwise(0.0))
    return findings.groupBy("audit_id").agg(
        F.count_if(F.col("severity") == "critical").alias("critical"),
        F.count_if(F.col("severity") == "high").alias("high"),
        F.count_if(quick).alias("quick_wins"),
        round1(F.sum(F.when(quick, F.col("points")).otherwise(0.0))).alias("quick_points"),
        F.floor(open_points * 0.4 + 0.5).alias("gain_low"),
        F.floor(open_points * 0.8 + 0.5).alias("gain_high"),
    )


def hotspots(findings: DataFrame) -> DataFrame:
    """audit_id, url, findings, phases and points of URLs with three or more findings of two or more phases."""
    findings = dealt(findings.select("audit_id", "url", "phase", "points"), "audit_id", "url")
    out = findings.groupBy("audit_id", "url").agg(F.count("*").alias("findings"), F.count_distinct("phase").alias("phases"), round1(F.sum("points")).alias("points"))
    return out.where("findings >= 3 and phases >= 2")


def top(findings: DataFrame, k: int, by: str = "audit_id") -> DataFrame:
    """The k gravest findings of each audit, by severity, points, then arrival."""
    w = Window.partitionBy(by).orderBy(F.desc("w"), F.desc("points"), "n")
    return findings.withColumn("w", weight(F.col("severity"))).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).drop("w")


def subject(text: Column) -> Column:
    """What a finding is about, by the first pattern that its text, in lower case without accents and marks, matches; else null."""
    plain = F.trim(F.regexp_replace(F.regexp_replace(F.translate(F.lower(text), *ACCENTS), r"[^A-Za-z0-9_\s.-]", " "), r"\s+", " "))
    return F.coalesce(*(F.when(plain.rlike(p), s) for s, p in SUBJECTS))


def with_subject(findings: DataFrame) -> DataFrame:
    """findings with their subject, null if no pattern matches.

    Findings repeat the texts of their rules, so each distinct title and recommendation is read once and joined back; a text
    that very many findings share is dealt over several tasks by adaptive skew handling. Nulls are a text of their own.
    """
    text = F.concat_ws("\u0001", F.coalesce("title", F.lit("\u0002")), F.coalesce("recommendation", F.lit("\u0002")))
    f = findings.withColumn("text_", text)
    known = f.groupBy("text_").agg(F.first(F.concat_ws(" ", "title", "recommendation")).alias("said_")).select("text_", subject(F.col("said_")).alias("subject"))
    return f.join(known, "text_", "left").drop("text_")


def deduplicated(findings: DataFrame) -> DataFrame:
    """Of findings of an audit on one subject (else one recommendation) the strongest, with the number merged.

    Findings are merged in the order of arrival: the one with more points, then the graver, then the earlier stays, and
    the other's recommendation is added to it unless one holds the other. One audit's findings on a subject are one group.
    """
    key = F.coalesce("subject", F.substring(F.lower(F.trim("recommendation")), 1, 80))
    fields = ["n", "points", "w", "phase", "severity", "effort", "url", "title"]
    f = with_subject(findings).withColumns({"subject": key, "w": weight(F.col("severity"))})
    item = F.struct(*fields, F.trim("recommendation").alias("recommendation"))
    groups = f.groupBy("audit_id", "subject").agg(F.sort_array(F.collect_list(item)).alias("items"))

    def merge(a, b):
        later = (b["points"] > a["points"]) | ((b["points"] == a["points"]) & (b["w"] > a["w"]))
        pick = lambda x, y, k: F.when(later, y[k]).otherwise(x[k])
        own, other = pick(a, b, "recommendation"), pick(b, a, "recommendation")
        same = F.lower(own).contains(F.lower(other)) | F.lower(other).contains(F.lower(own))
        return F.struct(*(pick(a, b, k).alias(k) for k in fields), F.when(same, own).otherwise(F.concat(own, F.lit("\n- "), other)).alias("recommendation"))

    at = F.aggregate(F.slice("items", F.lit(2), F.size("items")), F.get("items", 0), merge)
    return groups.select("audit_id", "subject", F.size("items").cast("long").alias("merged"), at.alias("at")).select("audit_id", "subject", "merged", "at.*").drop("w")


def placed(df: DataFrame, by: list[str], order: list, k: int) -> DataFrame:
    """The k first rows of each group, with their place."""
    return df.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("place") <= k)


def quick_wins(findings: DataFrame, k: int = 10) -> DataFrame:
    """The k dearest quick findings of each audit, after merging."""
    return placed(deduplicated(findings.where("effort = 'quick' and severity <> 'info'")), ["audit_id"], [F.desc("points"), "n"], k)


def teaser(findings: DataFrame, k: int = 5, chars: int = 40) -> DataFrame:
    """The k gravest findings of each audit with recommendations cut to `chars`."""
    cut = F.when(F.length("recommendation") > chars, F.concat(F.substring("recommendation", 1, chars), F.lit("…"))).otherwise(F.col("recommendation"))
    return top(findings, k).withColumn("recommendation", cut)


def content_gaps(findings: DataFrame, k: int = 3) -> DataFrame:
    """The k dearest findings on topics and freshness of each audit, one for each title, with the brief's text."""
    w = Window.partitionBy("audit_id", "title").orderBy(F.desc("points"), "n")
    first = findings.where("phase in ('topical', 'freshness')").withColumn("at", F.row_number().over(w)).where("at = 1").drop("at")
    brief = F.concat(F.lit("Phase: "), "phase", F.lit("\nProblem: "), "title", F.lit("\nRecommendation: "), "recommendation")
    return placed(first, ["audit_id"], [F.desc("points"), "n"], k).withColumn("brief", brief)


def top_hotspots(findings: DataFrame, k: int = 5) -> DataFrame:
    """The k dearest hotspots of each audit that has two or more."""
    place = F.row_number().over(Window.partitionBy("audit_id").orderBy(F.desc("points"), "url"))
    # spots are counted after the places, in whose order the rows of an audit already are: one sort for both
    some = hotspots(findings).withColumn("place", place).withColumn("spots", F.count("*").over(Window.partitionBy("audit_id")))
    return some.where((F.col("spots") >= 2) & (F.col("place") <= k)).drop("spots")


def strengths(scores: DataFrame, k: int = 5, least: float = 0.7) -> DataFrame:
    """The k best phases of each audit with `least` of their points or more."""
    s = scores.where("score_max > 0").withColumn("ratio", F.round(F.col("score") / F.col("score_max"), 6)).where(F.col("ratio") >= least)
    return placed(s, ["audit_id"], [F.desc("ratio"), "phase"], k).select("audit_id", "phase", "ratio", "place")


def bar(ratio: Column) -> Column:
    return F.when(ratio >= 0.75, "good").when(ratio >= 0.5, "ok").when(ratio >= 0.3, "warn").otherwise("bad")


def score_shares(scores: DataFrame) -> DataFrame:
    """audit_id, phase, share of the audit's points that the phase may give, ratio and bar of what it gave."""
    whole = F.sum("score_max").over(Window.partitionBy("audit_id"))
    ratio = F.col("score") / F.col("score_max")
    return scores.select("audit_id", "phase", F.round(F.col("score_max") / whole, 6).alias("share"), F.round(ratio, 6).alias("ratio"), bar(ratio).alias("bar"))


def score_table(scores: DataFrame) -> DataFrame:
    """audit_id, phase, score, score_max and percent for every phase, and a row `total` for every audit."""
    total = scores.groupBy("audit_id").agg(round1(F.sum("score")).alias("score"), F.sum("score_max").alias("score_max")).select("audit_id", F.lit("total").alias("phase"), "score", "score_max")
    rows = scores.select("audit_id", "phase", "score", "score_max")
    return rows.unionByName(total).withColumn("percent", F.when(F.col("score_max") > 0, F.floor(F.col("score") / F.col("score_max") * 100 + 0.5)))


def radar(scores: DataFrame, skipped: DataFrame) -> DataFrame:
    """The phases of an audit that were not skipped (audit_id, phase), for audits with three or more."""
    live = scores.where("score_max > 0 and score is not null").join(skipped, ["audit_id", "phase"], "left_anti")
    return live.withColumn("axes", F.count("*").over(Window.partitionBy("audit_id"))).where("axes >= 3")


def audience(findings: DataFrame) -> DataFrame:
    """findings with the audience whose phases they belong to."""
    return findings.withColumn("audience", F.coalesce(*(F.when(F.col("phase").isin(ps), a) for a, ps in AUDIENCES.items())))


def roadmap(findings: DataFrame) -> DataFrame:
    """The plan by effort: five quick, five medium and four heavy findings of each audit, the dearest first."""
    w = Window.partitionBy("audit_id", "effort").orderBy(F.desc("points"), "n")
    most = F.when(F.col("effort") == "heavy", 4).otherwise(5)
    return findings.where("severity <> 'info' and points > 0").withColumn("place", F.row_number().over(w)).where(F.col("place") <= most)


def extremes(scores: DataFrame, k: int = 3) -> DataFrame:
    """Best and worst k phases of each audit by score ratio."""
    s = scores.withColumn("ratio", F.round(F.col("score") / F.col("score_max"), 6))
    best = F.row_number().over(Window.partitionBy("audit_id").orderBy(F.desc("ratio"), "phase"))
    worst = F.row_number().over(Window.partitionBy("audit_id").orderBy("ratio", "phase"))
    return s.withColumns({"best": best, "worst": worst}).where((F.col("best") <= k) | (F.col("worst") <= k)).select("audit_id", "phase", "ratio", "best", "worst")


def weak_phases(scores: DataFrame) -> DataFrame:
    """Audits with three or more phases under half of their points, with the phases' names."""
    weak = scores.where("score < 0.5 * score_max").groupBy("audit_id").agg(F.count("*").alias("weak"), F.array_join(F.array_sort(F.collect_list("phase")), ",").alias("phases"))
    return weak.where("weak >= 3")


def rollup(audits: DataFrame, findings: DataFrame) -> DataFrame:
    """Findings and points by organization, phase and severity, with totals at every level."""
    joined = findings.join(audits.select("audit_id", "org_id"), "audit_id")
    return joined.rollup("org_id", "phase", "severity").agg(F.count("*").alias("findings"), round1(F.sum("points")).alias("points"))


def level(score: Column) -> Column:
    return F.when(score >= 80, "excellent").when(score >= 60, "good").when(score >= 40, "fair").otherwise("poor")


def label(key: Column, labels: dict[str, str]) -> Column:
    """A key's label; a key without one stands for itself."""
    return F.coalesce(*(F.when(key == k, v) for k, v in labels.items()), key)


def labelled(findings: DataFrame) -> DataFrame:
    """findings with the labels of their severity, phase and effort."""
    names = {"severity": LABELS, "phase": PHASE_LABELS, "effort": EFFORT_LABELS}
    return findings.withColumns({f"{c}_label": label(F.col(c), known) for c, known in names.items()})


def executive(audits: DataFrame, findings: DataFrame, scores: DataFrame, skipped: DataFrame) -> DataFrame:
    """What a report's summary states, one row an audit: rounded score, level, findings, grave ones, best and worst phase.

    Phases that an audit skipped (audit_id, phase) are neither best nor worst; one without points to give counts as no worst and
    no best one. Of equal ratios the phase that comes first in the rubric (phase_order, in scores) is named.
    """
    whole = audit_scores(scores).select("audit_id", F.floor(F.col("total") + 0.5).cast("long").alias("score"))
    live = scores.where("phase <> 'synthesis'").join(skipped, ["audit_id", "phase"], "left_anti")
    ratio = lambda empty: F.when(F.col("score_max") > 0, F.coalesce("score", F.lit(0.0)) / F.col("score_max")).otherwise(empty)
    ends = live.groupBy("audit_id").agg(
        F.min_by("phase", F.struct(ratio(1.0), "phase_order")).alias("worst"),
        F.min_by("phase", F.struct(-ratio(0.0), "phase_order")).alias("best"),
    )
    real = findings.where("phase <> 'synthesis'").groupBy("audit_id").agg(F.count("*").alias("findings"), F.count_if(F.col("severity").isin("critical", "high")).alias("grave"))
    out = audits.select("audit_id", "target").join(whole, "audit_id", "left").join(real, "audit_id", "left").join(ends, "audit_id", "left").na.fill(0, ["score", "findings", "grave"])
    named = {"level": label(level(F.col("score")), LEVEL_LABELS), "worst": label(F.col("worst"), PHASE_LABELS), "best": label(F.col("best"), PHASE_LABELS)}
    return out.withColumns(named).select("audit_id", "target", "score", "level", "findings", "grave", "best", "worst")
