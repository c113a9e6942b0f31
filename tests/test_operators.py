"""Functions and operators on small cases, and the queries against their SQL on the smallest tables."""

import math
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from pagelantern.functions import text, urls
from pagelantern.operators import citations, codebase, history, joined_rules, scoring, sinks, site
from pagelantern.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "null"
    return f"{v:.9g}" if isinstance(v, float) else str(v)


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_equals_sql(spark, sf_dir, duck, name):
    df = registry.QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = sorted(tuple(map(norm, r)) for r in df.select(*(F.col(f"`{c}`") for c in columns)).collect())
    said = duck.execute(registry.SQL[name])
    names = [d[0] for d in said.description]
    assert sorted(names) == columns
    assert got or "sf0.001" in sf_dir, "a query without rows compares nothing"
    assert got == sorted(tuple(norm(r[names.index(c)]) for c in columns) for r in said.fetchall())


def one(spark, column, *values):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], "x string").select(column).collect()]


def test_urls(spark):
    x, base = F.col("x"), F.lit("https://a.example/dir/page?q=1#f")
    assert one(spark, urls.resolve(x, base), "", "b", "./b", "/b", "//c.example/d", "?z", "#g", "mailto:j@a") == ["https://a.example/dir/page?q=1#f", "https://a.example/dir/b", "https://a.example/dir/b", "https://a.example/b", "https://c.example/d", "https://a.example/dir/page?z", "https://a.example/dir/page?q=1#g", "mailto:j@a"]
    assert one(spark, urls.internal_path(x, base), "/b/", "https://b.example/", "#x", "mailto:j", "/") == ["/b", None, None, None, "/"]
    assert one(spark, urls.domain(x), "HTTPS://www.A.example:80/x", "localhost", None) == ["a.example", None, None]
    assert one(spark, urls.unsafe_reason(x), "https://a.example/", "http://192.168.1.1/", "http://172.32.0.1/", "http://[fe80::1]/", "file:///x", None, "http://u@127.0.0.1/") == [None, "private address", None, "private address", "scheme", "scheme", "private address"]
    assert one(spark, urls.crawlable(x), "/a", "/a.pdf", "#a", "tel:1") == [True, False, False, False]


def test_text(spark):
    assert one(spark, text.canonical_casing(F.col("x")), "the seo of google\n(google), and `json-ld` at https://x.example/google", "open ai <code>html</code>\nhtml.", "") == ["the SEO of Google\n(Google), and `json-ld` at https://x.example/google", "OpenAI <code>html</code>\nHTML.", ""]


def test_robots(spark):
    body = "# c\nUser-agent: *\nDisallow: /x # y\n\nUser-Agent: GPTBot\nuser-agent: ClaudeBot\nAllow: /a\nDisallow: /\nUser-agent: YouBot\nDisallow:\n"
    files = spark.createDataFrame([("h", "robots", body), ("g", "robots", None), ("k", "robots", "user-agent: *\ndisallow: /")], "host string, kind string, body string")
    got = site.blocked_bots(files).groupBy("host").agg(F.array_sort(F.collect_list("bot")).alias("b")).collect()
    assert {r.host: r.b for r in got} == {"h": ["claudebot", "gptbot"], "k": sorted(site.BOTS)}
    paths = spark.createDataFrame([("h", "/x/1"), ("h", "/y"), ("z", "/x")], "host string, path string")
    assert [(r.host, r.path) for r in site.disallowed(paths, files).collect()] == [("h", "/x/1")]


def test_reachable(spark):
    pages = spark.createDataFrame([(k, "h", "/" if k == 5 else f"/p{k}") for k in range(1, 8)], "page_id long, host string, path string")
    edges = spark.createDataFrame([(5, "h", "/p1"), (1, "h", "/p2"), (2, "h", "/"), (2, "h", "/p3"), (6, "h", "/p7")], "src_page long, host string, dst_path string")
    from pagelantern.operators.checkpoint import cut

    assert {r.page_id: r.depth for r in site.reachable(pages, edges, cut).collect()} == {5: 0, 1: 1, 2: 2, 3: 3}


def test_reachable_at_any_depth(spark):
    pages = spark.createDataFrame([(k, "h", f"/p{k}") for k in range(27)], "page_id long, host string, path string")
    edges = spark.createDataFrame([(k, "h", f"/p{k + 1}") for k in range(25)], "src_page long, host string, dst_path string")
    from pagelantern.operators.checkpoint import cut

    assert {r.page_id: r.depth for r in site.reachable(pages, edges, cut).collect()} == {k: k for k in range(26)}


def test_suppressed_alerts(spark):
    import datetime as dt

    t = lambda h: dt.datetime(2024, 1, 1) + dt.timedelta(hours=h)
    runs = spark.createDataFrame([(1, "a", k, t(h), -15.0) for k, h in enumerate((0, 20, 25, 40, 49))], "org_id long, target string, audit_id long, created_at timestamp, delta double")
    assert sorted(r.audit_id for r in history.suppressed_alerts(runs).collect()) == [0, 2, 4]


def test_a_target_of_many_alerts_is_walked_in_batches(spark):
    hour = lambda k: f"timestamp '2024-01-01' + make_interval(0, 0, 0, 0, {k})"
    rows = spark.sql(f"select if(id % 3 = 0, null, id % 3) as org_id, 'x' as target, id as audit_id, {hour('cast(id as int)')} as created_at, -20.0d as delta from range(600)")
    rows = rows.unionByName(spark.sql("select 9L as org_id, k as target, id as audit_id, if(id = 1000, null, timestamp '2024-01-01') as created_at, -20.0d as delta from values ('a', 1000L), ('a', 1001L), ('b', 1000L) as t(k, id)"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = history.suppressed_alerts(rows).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(r.audit_id for r in got if r.target == "x") == sorted(k + d for k in range(0, 600, 24) for d in range(3))
    assert {r.org_id for r in got if r.target == "x"} == {None, 1, 2}
    assert sorted((r.target, r.audit_id) for r in got if r.org_id == 9) == [("a", 1001), ("b", 1000)]
    assert not history.suppressed_alerts(rows.where("false")).collect()


def test_next_run(spark):
    rows = spark.createDataFrame([("2024-01-31 00:00:00", f) for f in ("daily", "weekly", "monthly")], "a string, f string")
    got = rows.select(history.next_run(F.to_timestamp("a"), F.col("f")).cast("string")).collect()
    assert [r[0][:10] for r in got] == ["2024-02-01", "2024-02-07", "2024-02-29"]


def test_citations(spark):
    raw = '{"output":[{"content":[{"text":"see a.example","annotations":[{"url":"https://www.b.example/x"}]},{"text":null,"annotations":null}]},{"results":[{"url":"http://c.example"}]}]}'
    rows = spark.createDataFrame([(1, raw), (2, "{}"), (3, "not json"), (4, None)], "answer_id long, raw string")
    got = {r.answer_id: r for r in citations.flags(citations.parse_responses(rows), "a.example").collect()}
    assert got[1].is_cited and got[1].competitors == ["b.example", "c.example"]


def test_code_rules(spark):
    files = [("r1", "package.json", '{"dependencies":{"next":"14","react":"18"}}'), ("r1", "app/layout.tsx", "export const metadata = { title: 'T', description: 'D', openGraph: { title: 'a', description: 'b', image: 'c' } }; <html lang='en'> <script type='application/ld+json'>{\"@type\":\"Organization\"}</script>"), ("r1", "public/robots.txt", "User-agent: GPTBot\nDisallow: /\n"), ("r2", "index.html", "<html><head></head><p>few words</p></html>"), ("r2", "public/index.html", "other"), ("r3", "README.md", None)]
    frame = spark.createDataFrame(files, "repo string, path string, content string")
    snapshot = codebase.roles(frame)
    assert {r.repo: r.stack for r in codebase.stacks(snapshot).collect()} == {"r1": "next-app", "r2": "static", "r3": "other"}
    got = {}
    for r in codebase.code_findings(frame).collect():
        got.setdefault(r.repo, {})[r.rule_id] = r.points
    assert got["r1"] == {"K07": 2.0, "K10": 2.0, "K11": 1.0, "K12": 4.0, "K14": 2.0}
    assert {"K01", "K02", "K03", "K04", "K05", "K06", "K07", "K08", "K09", "K10", "K12", "K15"} == set(got["r2"])


def test_upsert(spark):
    old, new = (spark.createDataFrame(r, "k long, v string") for r in ([(1, "a"), (2, "b")], [(2, "c"), (3, "d")]))
    assert sorted(map(tuple, history.upsert(old, new, ["k"]).collect())) == [(1, "a"), (2, "c"), (3, "d")]
    assert sorted(map(tuple, history.upsert(old, new, ["k"], keep_old=True).collect())) == [(1, "a"), (2, "b"), (3, "d")]


def findings(spark, rows):
    return spark.createDataFrame([("a", n, "p", sev, "quick", pts, url, title, rec) for n, (sev, pts, url, title, rec) in enumerate(rows)], "audit_id string, n long, phase string, severity string, effort string, points double, url string, title string, recommendation string")


def test_subjects(spark):
    texts = ["llms-full.txt manquant", "un llms.txt", "Ajouter datePublished", "Chaînes de redirection", "schéma organization", "Largest Contentful Paint", "rien de tel", "Mise en cache"]
    assert one(spark, scoring.subject(F.col("x")), *texts) == ["llms-full.txt", "llms.txt", "datepublished", "redirect-chain", "schema-organization", "web-vital-lcp", None, None]


def test_merging_keeps_the_stronger_and_adds_other_texts(spark):
    rows = [("low", 1.0, "u", "canonical a", "Fix it"), ("high", 2.0, "u", "canonical b", "Point to itself"), ("low", 2.0, "u", "canonical c", "point to ITSELF"), ("low", 1.0, "u", "other", "Same text"), ("low", 1.0, "u", "more", "same text ")]
    got = {r.subject: r for r in scoring.deduplicated(findings(spark, rows)).collect()}
    assert got["canonical"].n == 1 and got["canonical"].recommendation == "Point to itself\n- Fix it" and got["canonical"].merged == 3
    assert got["same text"].n == 3 and got["same text"].recommendation == "Same text" and len(got) == 2


def test_retitled_findings_are_the_same(spark):
    runs = spark.createDataFrame([("b", "a")], "audit_id string, previous_id string")
    old = findings(spark, [("low", 1.0, "/x", "Canonical absent", "r"), ("low", 1.0, "/y", "Canonical absent", "r"), ("low", 1.0, None, "Plain", "r")])
    new = findings(spark, [("low", 1.0, "/x", "No canonical link", "r"), ("low", 1.0, "/z", "hreflang", "r")]).withColumn("audit_id", F.lit("b"))
    got = sorted((r.key, r.change) for r in history.finding_deltas(old.unionByName(new), runs).collect())
    assert got == [("p:canonical:/x", "persistent"), ("p:canonical:/y", "resolved"), ("p:hreflang:/z", "introduced"), ("p:t:plain:", "resolved")]


def test_one_scan_of_pages(spark, sf_dir):
    plan = registry.QUERIES["rules_counts"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1


def test_many_sitemap_files_of_a_host(spark):
    pages = spark.createDataFrame([(k, "h", f"/p{k}", 200, "", 0, 3500, "", False, f"c{k}") for k in range(6)], "page_id long, host string, path string, status int, title string, h1_count int, words int, robots string, has_breadcrumb boolean, content_hash string")
    edges = spark.createDataFrame([], "src_page long, host string, dst_path string")
    files = spark.createDataFrame([("h", "sitemap", "zzz"), ("h", "sitemap", "<url><loc>https://h/p1</loc></url>"), ("h", "robots", "User-agent: *")], "host string, kind string, body string")
    got = {r.rule_id for r in site.site_findings(pages, edges, files, "2024-01-01").collect()}
    assert {"T22", "O07", "O09", "O10", "G01"} <= got and not {"T24", "T25", "O08"} & got


def shared_path(spark):
    """Pages of which three have one path, with two statuses, and a page that links to it."""
    pages = spark.createDataFrame([(1, "h", "/", 200), (2, "h", "/x", 404), (3, "h", "/x", 301), (4, "h", "/x", 404)], "page_id long, host string, path string, status int")
    return pages, spark.createDataFrame([(1, "h", "/x")], "src_page long, host string, dst_path string")


def test_links_lead_to_every_status_of_a_path(spark):
    assert sorted(tuple(r) for r in site.broken_links(*shared_path(spark)).collect()) == [("h", 1, "/x", 301), ("h", 1, "/x", 404)]


def test_link_status_counts_every_status_of_a_path(spark):
    got = joined_rules.link_status_rules(site.broken_links(*shared_path(spark))).collect()
    assert [(r.src_page, r.broken, r.redirected, r.rule_id) for r in got] == [(1, 1, 1, "C10")]


@pytest.fixture(scope="module")
def copies(spark, tmp_path_factory):
    """A folder whose pages table has several pages of a URL, none of which is worst in all metrics."""
    folder = str(tmp_path_factory.mktemp("copies"))
    spark.createDataFrame([(k, "https://a.example/x", "") for k in (5, 38, 39, 79, 8)], "page_id long, url string, html string").coalesce(1).write.parquet(f"{folder}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{folder}/pages.parquet/*.parquet'")
    return folder, con


def test_field_percentiles_count_the_worst_of_copies(spark, copies):
    assert [tuple(r) for r in registry.QUERIES["field_metric_p75"](spark, copies[0]).collect()] == copies[1].execute(registry.SQL["field_metric_p75"]).fetchall() == [(1, 5400.0, 520.0)]


def test_field_rules_count_the_worst_of_copies(spark, copies):
    rows = registry.QUERIES["rules_field_metrics"](spark, copies[0]).select("page_id", "rule_id", "severity", "points").collect()
    assert sorted(tuple(r) for r in rows) == sorted(copies[1].execute(registry.SQL["rules_field_metrics"]).fetchall())
    assert {(r.rule_id, r.severity) for r in rows if r.page_id == 8} == {("P01", "high"), ("P03", "high"), ("P05", "high")}


def listed_again(spark):
    """Sitemap files that list two locations twice, one with its newest date first and one with it last, and one without date."""
    url = "<url><loc>https://h/%s</loc>%s</url>"
    date = "<lastmod>2024-%s-01</lastmod>"
    bodies = [url % ("a", date % "06") + url % ("b", date % "01"), url % ("a", date % "01") + url % ("b", date % "06"), url % ("a", "") + url % ("b", "")]
    return site.sitemap_entries(spark.createDataFrame([("h", "sitemap", b) for b in bodies], "host string, kind string, body string").coalesce(1))


def test_entries_listed_again_have_their_newest_date(spark):
    assert sorted((r.loc, str(r.lastmod)[:10]) for r in listed_again(spark).collect()) == [("https://h/a", "2024-06-01"), ("https://h/b", "2024-06-01")]


def test_ages_count_the_newest_date_of_an_entry(spark):
    assert [tuple(r) for r in site.sitemap_ages(listed_again(spark), "2024-07-01").collect()] == [("h", 2, 2, 2)]


def test_entries_are_read_without_white_space_and_times_of_day(spark, tmp_path):
    urls_ = [(1, "https://a.example/x "), (3, "https://a.example/x"), (4, "https://a.example/y\n")]
    spark.createDataFrame([(k, u, "") for k, u in urls_], "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    for name in ("sitemap_entries", "sitemap_ages"):
        got = registry.QUERIES[name](spark, str(tmp_path))
        said = con.execute(registry.SQL[name])
        assert sorted(map(tuple, got.select(*(d[0] for d in said.description)).collect())) == sorted(said.fetchall())
    assert [(r.listed, r.dated) for r in got.collect()] == [(2, 2)]
    url = "<url><loc>\n https://h/%s </loc><lastmod>%s</lastmod></url>"
    body = "".join(url % x for x in (("a", "10:00"), ("b", "now"), ("c", "2024"), ("d", " 2024-06-01T10:00:00Z")))
    entries = site.sitemap_entries(spark.createDataFrame([("h", "sitemap", body)], "host string, kind string, body string"))
    assert sorted((r.loc, str(r.lastmod)) for r in entries.collect()) == [("https://h/a", "None"), ("https://h/b", "None"), ("https://h/c", "2024-01-01 00:00:00"), ("https://h/d", "2024-06-01 10:00:00")]


def test_freshness_reads_all_dates_that_a_page_says(spark, tmp_path):
    body = lambda *times: "<html><head></head><body>" + "".join(times) + "</body></html>"
    time = lambda t, q='"': f"<time class=x datetime={q}{t}{q}>t</time>"
    made = [
        (1, "https://a.example/map.xml", body()),  # no entry of the sitemap
        (70, "https://a.example/b", body(time("2023-01-01"), time("2024-06-10", "'"))),
        (7, "https://a.example/c", body(f"<!-- {time('2024-06-10')} -->", time("2023-01-01").upper())),
        (14, "https://a.example/d", body(time("10:00"), time("now"))),
        (2, "https://a.example/e ", body(time("2024-06-01"))),
    ]
    spark.createDataFrame(made, "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    said = con.execute(registry.SQL["rules_freshness"])
    got = registry.QUERIES["rules_freshness"](spark, str(tmp_path)).select(*(d[0] for d in said.description)).collect()
    assert sorted(map(norm, map(tuple, got))) == sorted(map(norm, said.fetchall()))
    assert {(r.page_id, r.rule_id) for r in got if r.rule_id in ("F01", "F02")} == {(1, "F02"), (7, "F02"), (14, "F01")}


def test_outbox_keeps_audits_of_an_organization_together(spark):
    audits = spark.range(400).selectExpr("id as audit_id", "if(id = 399, null, id % 5) as org_id").repartition(8)
    hooks = spark.createDataFrame([(o, 10 * o + h, e) for o in range(6) for h, e in enumerate(("a", "b, a ", "ab", "b"))], "org_id long, hook_id long, events string")
    got = sinks.outbox(audits, hooks, "a").select("*", F.spark_partition_id().alias("part")).collect()
    assert sorted((r.audit_id, r.hook_id) for r in got) == sorted((k, 10 * (k % 5) + h) for k in range(399) for h in (0, 1))
    orgs = {(r.part, r.audit_id % 5) for r in got}
    assert len(orgs) <= 5 + 4 - 1  # ranges of organizations over four partitions
    assert len({p for p, _ in orgs}) > 1


def test_outbox_is_written_small_whatever_the_number_of_hooks(spark, tmp_path):
    audits, hooks = spark.range(4_000_000).where("id < 400").selectExpr("id as audit_id", "id div 200 as org_id"), spark.range(19_202).selectExpr("id as hook_id", "id % 2 as org_id", "'a' as events")
    sinks.outbox(audits, hooks, "a").write.parquet(str(tmp_path / "o"))
    got = spark.read.parquet(str(tmp_path / "o"))
    assert got.count() == got.distinct().count() == 400 * 9601 and got.where("audit_id div 200 = hook_id % 2").count() == 400 * 9601
    assert sum(x.stat().st_size for x in (tmp_path / "o").glob("*.parquet")) < 0.5 * 400 * 9601


def test_outbox_keeps_nulls_and_repeated_rows(spark, monkeypatch):
    monkeypatch.setattr(sinks, "AUDITS", 3)
    monkeypatch.setattr(sinks, "HOOKS", 2)
    audits = spark.createDataFrame([(1, 1), (1, 1), (None, 1), (2, 1), (3, 1), (4, 2), (5, None), (6, 3)], "audit_id long, org_id long")
    hooks = spark.createDataFrame([(1, 10, "a"), (1, 10, "a"), (1, None, "a"), (1, 11, "b, a"), (1, 12, "b"), (2, 20, "a"), (None, 30, "a"), (2, 21, None)], "org_id long, hook_id long, events string")
    out = sinks.outbox(audits, hooks, "a")
    want = [(a, h) for a in (1, 1, None, 2, 3) for h in (10, 10, None, 11)] + [(4, 20)]
    assert sorted(map(str, map(tuple, out.collect()))) == sorted(map(str, want))
    # the rows of a block of audits are made one by one: generated code would hold them all
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "isFinalPlan=true" in plan and "- Generate explode(transform(held" in plan


def scored(spark):
    audits = spark.createDataFrame([(1,), (2,), (None,)], "audit_id long")
    rubric = spark.createDataFrame([("geo", 10.0), ("topical", 5.0)], "phase string, score_max double")
    findings = spark.createDataFrame([(1, "geo", 2.5), (1, "geo", 1.0), (1, "topical", 9.0), (1, None, 1.0), (1, "else", 1.0), (3, "geo", 1.0)], "audit_id long, phase string, points double")
    return scoring.phase_scores(audits, findings, rubric)


def test_scores_of_phases_are_not_shuffled(spark):
    scores = scored(spark)
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, scores.collect()), key=key) == [(1, "geo", 6.5, 10.0), (1, "topical", 0.0, 5.0), (2, "geo", 10.0, 10.0), (2, "topical", 5.0, 5.0), (None, "geo", 10.0, 10.0), (None, "topical", 5.0, 5.0)]
    modes = scoring.mode_scores(scores)
    assert sorted(map(tuple, modes.where("audit_id = 1").collect())) == [(1, "flash", 65.0), (1, "full", 43.3), (1, "standard", 65.0)]
    assert scoring.mode_scores(scores.where("phase = 'topical' and audit_id = 2")).collect() == [(2, "full", 100.0)]
    exchanges = [x for x in modes._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning" in x]
    assert exchanges and not [x for x in exchanges if "phase" in x or "mode" in x]


def spotted(spark):
    rows = [(1, u, p, 1.0) for u in ("/a", "/b") for p in ("geo", "geo", "eeat")] + [(1, "/c", "geo", 1.0)] * 3 + [(2, "/a", p, 2.0) for p in ("geo", "eeat", None)]
    return spark.createDataFrame(rows, "audit_id long, url string, phase string, points double")


def shuffles(df):
    return df.select("*")._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_hotspots_take_one_shuffle(spark):
    found = scoring.hotspots(spotted(spark))
    assert sorted(map(tuple, found.collect())) == [(1, "/a", 3, 2, 3.0), (1, "/b", 3, 2, 3.0), (2, "/a", 3, 2, 6.0)]
    assert shuffles(found) == 1


def test_top_hotspots_shuffle_findings_once(spark):
    found = scoring.top_hotspots(spotted(spark))
    assert sorted((r.audit_id, r.url, r.place) for r in found.collect()) == [(1, "/a", 1), (1, "/b", 2)]
    assert shuffles(found) == 2  # the findings, and the hotspots by their audit


def test_findings_are_dealt_by_the_size_of_their_tables(spark, tmp_path, monkeypatch):
    spotted(spark).coalesce(1).write.parquet(str(tmp_path / "f"))
    read = lambda: spark.read.parquet(str(tmp_path / "f"))
    size = sum(x.stat().st_size for x in (tmp_path / "f").glob("*.parquet"))
    assert scoring.input_bytes(read()) == size
    assert scoring.input_bytes(read().join(read().select("audit_id"), "audit_id")) == 2 * size  # and no product
    assert scoring.input_bytes(spotted(spark)) == 0  # a list of rows
    assert scoring.dealt(read(), "audit_id").rdd.getNumPartitions() == 4  # the session's
    assert scoring.dealt(read(), "audit_id", each=-(-size // 9)).rdd.getNumPartitions() == 9
    monkeypatch.setattr(scoring, "input_bytes", lambda df: 80 << 20)
    found = scoring.top_hotspots(read())
    assert sorted((r.audit_id, r.url, r.place) for r in found.collect()) == [(1, "/a", 1), (1, "/b", 2)]
    assert re.search(r"hashpartitioning\(audit_id#\d+L, url#\d+, 10\)", found._jdf.queryExecution().executedPlan().toString())


def test_hotspots_are_placed_and_counted_along_one_sort(spark):
    assert scoring.top_hotspots(spotted(spark)).select("*")._jdf.queryExecution().executedPlan().toString().count("Sort [audit_id") == 1


def test_terms_are_searched_by_letters_they_all_have(spark):
    assert [text.needle(p) for p in (r"(?i)\bgpt-?4o?\b", r"(?i)\bai\s+overviews?\b", r"(?i)\bhttp\b(?!s|://|/\w|\w)", r"(?i)\b(a|b)cd\b", r"[ab]cd")] == ["gpt", "overview", "http", "", ""]
    said = "Gpt4O and CHAT gpt, OPEN  ai; GOOGLE google schema.ORG e-eat I.A. ai Overview İhttp `seo` seo"
    want = "GPT-4 and CHAT gpt, OpenAI; GOOGLE Google Schema.org E-E-A-T IA. AI Overviews İHTTP `seo` SEO"
    got = one(spark, text.canonical_casing(F.col("x")), said, "", None)
    assert got == [want, "", None]
    plan = spark.range(1).select(text.canonical_casing(F.col("id").cast("string")).alias("x"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("regexp_replace(") <= 2  # one for all terms
