"""Files, stored tables, streams with late rows, SQL functions and pruned history on small cases."""

import datetime as dt
import os
import threading

import pytest
from pyspark.sql import functions as F

from pagelantern.functions import urls
from pagelantern.operators import checkpoint, codebase, history, scoring, sinks, site
from pagelantern.operators.checkpoint import scratch
from pagelantern.operators.keyed_store import KeyedStore
from pagelantern.plans import history_queries, registry, sql_surface
from pagelantern.sources import code, files, tables
from pagelantern.sources import history as src
from pagelantern.streaming import jobs

T0 = dt.datetime(2024, 1, 1)


def put(folder, **contents):
    for path, content in contents.items():
        at = os.path.join(folder, path)
        os.makedirs(os.path.dirname(at), exist_ok=True)
        with open(at, "wb") as out:
            out.write(content)


def test_repositories_are_read_from_folders(spark, tmp_path):
    put(tmp_path, **{
        "r 1/package.json": b'{"dependencies":{"next":"1"}}', "r 1/app/layout.tsx": "é title: 't'".encode(), "r 1/public/robots.txt": b"\xff\xfe", "r 1/robots.txt": b"\xef\xbb\xbfUser-agent: *",
        "r 1/deep/a/b/c/d/e/f/g/in.txt": b"x", "r 1/deep/a/b/c/d/e/f/g/h/out.txt": b"x", "r 1/src/main.ts": b"never opened", "r 1/pages/_document.js": b"<Html>", "r2/pages/_document.tsx": b"z" * 60, "r2/pages/_app.tsx": b"no role",
        "r2/index.html": b"<p>x</p>", "r2/public/llms.txt": b"", "r2/dist/index.html": b"y" * 100, "loose.txt": b"of no repository",
    })
    got = {(r.repo, r.path): r.content for r in files.repository_files(spark, str(tmp_path), most=50).collect()}
    assert got[("r 1", "app/layout.tsx")] == "é title: 't'" and got[("r2", "index.html")] == "<p>x</p>"
    assert got[("r 1", "robots.txt")] == "User-agent: *"  # without the mark
    assert got[("r 1", "public/robots.txt")] is None and got[("r2", "dist/index.html")] is None and got[("r 1", "src/main.ts")] is None
    assert got[("r 1", "pages/_document.js")] == "<Html>" and got[("r2", "pages/_document.tsx")] is None
    assert len(files.repository_files(spark, str(tmp_path), hidden=False).collect()) == 8
    assert ("r 1", "deep/a/b/c/d/e/f/g/in.txt") in got and not any(p.endswith("out.txt") for _, p in got) and len(got) == 10 and ("r2", "public/llms.txt") not in got


def test_many_small_files_are_no_parts_of_a_scan(spark, tmp_path):
    put(tmp_path, **{f"r{k}/{p}": b"x" for k in range(40) for p in ("index.html", "pages/_document.tsx", ".git/index.html", "src/a.ts")})
    read = files.repository_files(spark, str(tmp_path))
    assert "binaryFile" not in read._jdf.queryExecution().executedPlan().toString()  # one of 4 MB each, as Spark counts
    assert sorted((r.repo, r.path, r.content) for r in read.collect()) == sorted((f"r{k}", p, c) for k in range(40) for p, c in (("index.html", "x"), ("pages/_document.tsx", "x"), ("src/a.ts", None)))
    some = spark.createDataFrame([("r1",), ("r2",), ("none",), ("r1",)], "owner string")
    assert {r.repo for r in files.repository_files(spark, str(tmp_path), owners=some).collect()} == {"r1", "r2"}
    files.remove_tree(some, str(tmp_path))
    assert sorted(os.listdir(tmp_path)) == sorted(f"r{k}" for k in range(40) if k not in (1, 2))


def standing(folder):
    """The files of repositories that stand below a folder."""
    return [os.path.join(at, f) for at, _, found in os.walk(folder) for f in found if "/repositories-" in at]


@pytest.mark.parametrize("name", ["files_code_roles", "files_code_findings"])
def test_few_files_of_repositories_stand_at_a_time(spark, sf_dir, name):
    shared, most, done = checkpoint.shared_folder(spark).removeprefix("file:"), [0], threading.Event()

    def watch():
        while not done.wait(0.005):
            most[0] = max(most[0], len(standing(shared)))

    watcher = threading.Thread(target=watch)
    watcher.start()
    try:
        registry.QUERIES[name](spark, sf_dir).count()
    finally:
        done.set()
        watcher.join()
    assert 0 < most[0] <= 4 * len(code.FILES)  # a repository for each task that runs, of 200
    assert not standing(shared)


def test_written_repositories_are_read_as_those_in_a_folder(spark, tmp_path):
    rows = [
        ("a", "robots.txt", b"\xef\xbb\xbfUser-agent: *"), ("a", "app/layout.tsx", "é".encode()), ("a", "src/x/main.ts", b"never opened"), ("a", "llms.txt", b""), ("a", "public/robots.txt", b"\xff"), ("a", "package.json", None),
        ("b", "app", b"a file where others have a folder"), ("b", "src/x", b"y"), ("b", "pages/_document.tsx", b"z"), ("b", "pages/_app.tsx", b"hidden"), ("b", ".git/config", b"hidden"),
        ("c", "app/layout.tsx", b"l" * 60), ("c", "1/2/3/4/5/6/7/8/in", b"x"), ("c", "1/2/3/4/5/6/7/8/9/out", b"x"), ("c", "src/x/index.html", b"x"), ("c d", "index.html", b"<p>"), (".e", "index.html", b"x"),
    ]
    df = spark.createDataFrame(rows, "owner string, path string, content binary").repartition(5)
    key = lambda r: (r.repo, r.path, r.content)
    files.write_tree(df.where("path <> 'package.json'"), f"{tmp_path}/t")
    want = sorted(map(key, files.repository_files(spark, f"{tmp_path}/t", most=50).collect()), key=str)
    with pytest.MonkeyPatch.context() as m:
        m.setattr(files, "dealt", lambda rows, owner: rows.coalesce(1))  # one task, which keeps the folders of one for the next
        for kept in (0, 64):
            got = files.written_and_read(df, f"{tmp_path}/w", most=50, kept=kept)
            assert sorted(map(key, got.collect()), key=str) == want
    assert len(want) == 11 and ("b", "app", None) in want and ("a", "robots.txt", "User-agent: *") in want and ("c", "app/layout.tsx", None) in want
    assert sorted(map(key, files.written_and_read(df.unionAll(df), f"{tmp_path}/w", most=50).collect()), key=str) == want  # each path once
    nulls = spark.createDataFrame([(None, "a", b"x"), ("a", None, b"x"), ("a", "b", None)], df.schema)
    assert files.written_and_read(nulls, f"{tmp_path}/w").collect() == []
    assert [f for _, _, found in os.walk(f"{tmp_path}/w") for f in found] == []


def test_contents_of_repositories_are_not_shuffled_for_their_findings(spark):
    snapshot = codebase.roles(spark.createDataFrame([("r", "index.html", "<p>")], "repo string, path string, content string"))
    plan = codebase.snapshot_findings(snapshot)._jdf.queryExecution().optimizedPlan()
    assert plan.nodeName() == "Union" and "Join" not in plan.children().head().toString()


def test_paths_alone_open_no_file(spark, tmp_path):
    put(tmp_path, **{"r/a.txt": b"x" * 1000})
    plan = files.tree(spark, str(tmp_path)).select("owner", "path")._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan


def test_site_files_are_read_from_folders(spark, tmp_path):
    put(tmp_path, **{"a.example/robots.txt": b"User-agent: *", "a.example/llms.txt": b"\xc3\x28", "A.example/sub/sitemap.xml": b"no", "b.example/llms-full.txt": b"all"})
    hosts = spark.createDataFrame([("a.example",), ("b.example",), ("c.example",), ("a.example",)], "host string")
    got = {(r.host, r.kind): r.body for r in files.site_files(spark, str(tmp_path), hosts).collect()}
    assert len(got) == 12
    assert {k: v for k, v in got.items() if v is not None} == {("a.example", "robots"): "User-agent: *", ("b.example", "llms_full"): "all"}


def test_written_trees_are_read_back(spark, tmp_path):
    rows = [("a", "x/y.txt", "ü".encode()), ("a", "z.bin", b"\x00\xff"), ("b", "n.txt", None), ("b", "x y", b"")]
    df = spark.createDataFrame(rows, "owner string, path string, content binary").repartition(3)
    for _ in range(2):  # a repeated task writes the same again
        files.write_tree(df, f"{tmp_path}/t")
    assert sorted((r.owner, r.path, bytes(r.content)) for r in files.tree(spark, f"{tmp_path}/t").collect()) == sorted((o, p, c) for o, p, c in rows if c)


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


SCHEMA = "k long, at long, v string"


def test_merges_touch_only_their_buckets(spark, tmp_path):
    store = KeyedStore(spark, f"{tmp_path}/s", ["k"], "at", buckets=8)
    assert store.read() is None and store.versions() == []
    store.merge(spark.createDataFrame([(k, 1, "old") for k in range(100)], SCHEMA), 0)
    touched = store.merge(spark.createDataFrame([(3, 2, "new"), (3, 0, "late"), (500, 1, "more")], SCHEMA), 1)
    assert 1 <= len(touched) <= 2
    assert sorted(b for b, v in store.manifest(1).items() if v == 1) == touched and len(store.manifest(1)) == 8
    written = {d for d in os.listdir(f"{tmp_path}/s/data/v=1") if d.startswith("bucket=")}
    assert written == {f"bucket={b}" for b in touched}
    assert rows_of(store.read()) == sorted([(k, 1, "old") for k in range(100) if k != 3] + [(3, 2, "new"), (500, 1, "more")])
    assert rows_of(store.read(0)) == [(k, 1, "old") for k in range(100)]  # the commit before is still whole
    opened = store.read()._jdf.inputFiles()
    assert len(opened) == 8  # one file a bucket


def test_repeated_and_broken_merges(spark, tmp_path):
    store = KeyedStore(spark, f"{tmp_path}/s", ["k"], "at", buckets=4)
    first, second = spark.createDataFrame([(k, 1, "a") for k in range(20)], SCHEMA), spark.createDataFrame([(k, 2, "b") for k in range(5)], SCHEMA)
    store.merge(first, 0)
    # a merge that wrote files and no commit: readers do not see it, and the same merge later succeeds
    first.withColumn("v", F.lit("broken")).withColumn("bucket", F.lit(0)).write.partitionBy("bucket").parquet(f"{tmp_path}/s/data/v=1")
    assert {r.v for r in store.read().collect()} == {"a"}
    store.merge(second, 1)
    want = sorted([(k, 2, "b") for k in range(5)] + [(k, 1, "a") for k in range(5, 20)])
    assert rows_of(store.read()) == want
    store.merge(second, 1)  # the same again
    assert rows_of(store.read()) == want and store.versions() == [0, 1]


def test_old_versions_are_cleaned(spark, tmp_path):
    store = KeyedStore(spark, f"{tmp_path}/s", ["k"], "at", buckets=4, keep=2)
    for n in range(6):
        store.merge(spark.createDataFrame([(n % 3, n, f"v{n}")], SCHEMA), n)
    assert store.versions() == [4, 5]
    assert rows_of(store.read()) == [(0, 3, "v3"), (1, 4, "v4"), (2, 5, "v5")]
    held = sum(len([b for b in os.listdir(f"{tmp_path}/s/data/{v}") if b.startswith("bucket=")]) for v in os.listdir(f"{tmp_path}/s/data"))
    assert held <= 4 + 1  # the last commit's buckets, and one that only the commit before names
    store.merge(spark.createDataFrame([], SCHEMA), 6)  # an empty merge is a commit
    assert rows_of(store.read()) == [(0, 3, "v3"), (1, 4, "v4"), (2, 5, "v5")]


def test_null_keys_and_ties(spark, tmp_path):
    store = KeyedStore(spark, f"{tmp_path}/s", ["k"], "at", buckets=4)
    store.merge(spark.createDataFrame([(None, 1, "a"), (1, None, "b")], SCHEMA), 0)
    store.merge(spark.createDataFrame([(None, 1, "same order, new row"), (1, 5, "c")], SCHEMA), 1)
    assert sorted(map(str, (tuple(r) for r in store.read().collect()))) == sorted(map(str, [(None, 1, "same order, new row"), (1, 5, "c")]))


def test_results_are_stored_by_version(spark, tmp_path):
    schema = "audit_id long, phase string, score double, status string, version int"
    old = [(a, p, 1.0, "running", 1) for a in range(6) for p in ("geo", "eeat")]
    sinks.store_results(spark.createDataFrame(old, schema), f"{tmp_path}/r", 0, 4)
    sinks.store_results(spark.createDataFrame([(2, "geo", 3.0, "completed", 2), (2, "geo", 9.0, "running", 1)], schema), f"{tmp_path}/r", 1, 4)
    got = sinks.results_store(spark, f"{tmp_path}/r", 4).read().select(*(c.split(" ")[0] for c in schema.split(", ")))
    assert rows_of(got) == sorted([r for r in old if r[:2] != (2, "geo")] + [(2, "geo", 3.0, "completed", 2)])


def late_events(spark, folder, rows):
    """rows of (batch, id, hours, user) as a stream of micro-batches."""
    df = spark.createDataFrame([(b, i, T0 + dt.timedelta(hours=h), u, "x", 1.0) for b, i, h, u in rows], "arrival int, event_id long, ts timestamp, user_id long, event_type string, value double")
    return jobs.arriving(df, folder, "arrival", files=1)


def test_rows_behind_the_watermark_are_dropped(spark, tmp_path):
    rows = [(0, 1, 1, 1), (1, 2, 100, 1), (2, 4, 101, 1), (3, 3, 2, 1), (3, 5, 60, 1), (4, 6, 300, 1)]
    out = jobs.run_available(jobs.counts_by_day(late_events(spark, f"{tmp_path}/in", rows), "2 days"), str(tmp_path))
    # a mark counts from the batch after the next: after batch 1 it is 52 h, so in batch 3 event 3 (day 0) comes too late and
    # event 5 (day 2, which ends at 72 h) does not; day 12 is still open
    assert sorted((r.day, r.n) for r in out.collect()) == [(T0, 1), (T0 + dt.timedelta(days=2), 1), (T0 + dt.timedelta(days=4), 2)]


def test_windows_and_sessions_close_once(spark, tmp_path):
    rows = [(0, 1, 0, 1), (0, 2, 0.2, 1), (1, 3, 48, 1), (2, 5, 49, 2), (3, 4, 0.3, 1), (3, 6, 96, 3)]
    out = jobs.run_available(jobs.sessions(late_events(spark, f"{tmp_path}/in", rows)), f"{tmp_path}/s")
    m = dt.timedelta(minutes=1)
    assert sorted((r.user_id, r.start, r.n) for r in out.collect()) == [(1, T0, 2), (1, T0 + 48 * 60 * m, 1), (2, T0 + 49 * 60 * m, 1)]
    out = jobs.run_available(jobs.sliding_counts(late_events(spark, f"{tmp_path}/in2", rows)), f"{tmp_path}/w")
    got = {(r.start, r.user_id): r.n for r in out.collect()}
    assert got[(T0, 1)] == 2 and got[(T0 - 50 * m, 1)] == 1 and got[(T0 + 49 * 60 * m, 2)] == 1 and not any(u == 3 for _, u in got)


def test_state_is_evicted(spark, tmp_path):
    stream = late_events(spark, f"{tmp_path}/in", [(k, k, 24 * k, 1) for k in range(8)])
    query = jobs.counts_by_day(stream, "1 day").writeStream.outputMode("append").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).format("memory").queryName("evicted").start()
    query.awaitTermination()
    state = [p["stateOperators"][0] for p in query.recentProgress if p["stateOperators"]]
    assert max(s["numRowsTotal"] for s in state) <= 4 and sum(s["numRowsRemoved"] for s in state) >= 6


def test_sql_functions_equal_the_rules(spark, sf_dir):
    sql_surface.register(tables.pages(spark, sf_dir))
    every = spark.sql("SELECT page_id, rule_id FROM findings_of('all')").count()
    by_phase = {r.phase: r.n for r in spark.sql("SELECT phase, count(*) AS n FROM page_findings GROUP BY phase").collect()}
    assert every == sum(by_phase.values()) and spark.sql("SELECT * FROM findings_of('geo')").count() == by_phase["geo"]
    grave = {r.severity for r in spark.sql("SELECT DISTINCT severity FROM findings_at_least('high')").collect()}
    assert grave == {"critical", "high"}
    assert spark.sql("SELECT host, count(*) AS n FROM worst_pages(2) GROUP BY host HAVING n > 2").isEmpty()
    joined = spark.sql("SELECT f.rule_id, p.title FROM page_features p, LATERAL (SELECT * FROM findings_of('geo') g WHERE g.page_id = p.page_id) f WHERE p.h1_count = 0")
    assert joined.count() >= 0
    assert "Python" not in spark.sql("SELECT * FROM findings_of('geo')")._jdf.queryExecution().executedPlan().toString()


def test_history_is_pruned_by_organization(spark, sf_dir):
    audits, findings = history_queries._a(spark, sf_dir), history_queries._f(spark, sf_dir)
    with scratch(spark, "history") as folder:
        src.store(audits, findings, folder)
        some = src.of_orgs(spark, folder, "audits", [3, 7])
        assert rows_of(some.select("audit_id", "org_id")) == rows_of(audits.where("org_id in (3, 7)").select("audit_id", "org_id"))
        plan = some._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: [" in plan and "part#" in plan.split("PartitionFilters: [")[1].split("]")[0]
        whole = spark.read.parquet(f"{folder}/audits")
        parts = {r.part for r in whole.select("part").distinct().collect()}
        read = lambda df: {f.split("part=")[1].split("/")[0] for f in df.select(F.input_file_name().alias("f")).distinct().toPandas()["f"]}
        assert len(read(some)) <= 2 < len(parts)
        orgs = spark.createDataFrame([(3, "x"), (7, "x"), (8, "y")], "org_id long, plan string").where("plan = 'x'")
        found = src.of_plan(spark, folder, "findings", orgs)
        assert "dynamicpruning" in found._jdf.queryExecution().executedPlan().toString().lower()
        want = findings.join(audits.where("org_id in (3, 7)").select("audit_id"), "audit_id")
        assert found.count() == want.count()


def crawl(spark):
    """A site whose home links to 20 pages that link to 20 more, and a chain of 6 on another host."""
    wide = [(0, "a", "/")] + [(k, "a", f"/p{k}") for k in range(1, 41)]
    chain = [(100 + k, "b", f"/c{k}" if k else "/") for k in range(7)]
    edges = [(0, "a", f"/p{k}") for k in range(1, 21)] + [(k, "a", f"/p{k + 20}") for k in range(1, 21)] + [(5, "a", "/")] + [(100 + k, "b", f"/c{k + 1}") for k in range(6)]
    return spark.createDataFrame(wide + chain, "page_id long, host string, path string"), spark.createDataFrame(edges, "src_page long, host string, dst_path string")


@pytest.mark.parametrize("most", [None, 1, 3, 25, 1000])
def test_crawls_stop_at_their_budget(spark, most):
    pages, edges = crawl(spark)
    written = []

    def cut(df):
        df = df.checkpoint()
        written.append(df)
        return df

    got = sorted((r.page_id, r.depth) for r in site.reachable(pages, edges, cut, most).collect())
    a = [(0, 0)] + [(k, 1) for k in range(1, 21)] + [(k, 2) for k in range(21, 41)]
    b = [(100 + k, k) for k in range(7)]
    assert got == sorted(a[:most] + b[:most])
    fronts = sum(df.count() for df in written if "depth" in df.columns)
    assert fronts == len(got)  # each page is written once


def test_urls_of_a_crawl(spark):
    base = F.lit("https://a.example/dir/page?q=1#f")
    told = {"/b/": "https://a.example/b", "": "https://a.example/dir/page?q=1", "#x": "https://a.example/dir/page?q=1", "https://b.example": "https://b.example/", "https://b.example?x=/": "https://b.example/?x=/", "/": "https://a.example/", "c/?d=/": "https://a.example/dir/c?d=/"}
    got = spark.createDataFrame([(h,) for h in told], "h string").select(urls.crawl_form(F.col("h"), base)).collect()
    assert [r[0] for r in got] == list(told.values())


def test_days_between_runs(spark):
    rows = [(T0, T0 + dt.timedelta(hours=35)), (T0 + dt.timedelta(hours=36), T0), (T0, None), (T0, T0)]
    got = spark.createDataFrame(rows, "a timestamp, b timestamp").select(history.days_between(F.col("a"), F.col("b"))).collect()
    assert [r[0] for r in got] == [1, 2, None, 0]


def test_subjects_are_read_once_a_text(spark):
    rows = [(1, "Fix", "Add a canonical link"), (2, None, "Declare the sitemap.xml"), (3, "llms.txt", None), (4, None, None), (5, "Fix", "Add a canonical link"), (6, "", "x")]
    got = {r.n: r.subject for r in scoring.with_subject(spark.createDataFrame(rows, "n int, title string, recommendation string")).collect()}
    assert got == {1: "canonical", 2: "sitemap.xml", 3: "llms.txt", 4: None, 5: "canonical", 6: None}


def test_report_facts(spark):
    audits = spark.createDataFrame([(1, "a.example"), (2, "b.example"), (3, "c.example")], "audit_id long, target string")
    findings = spark.createDataFrame([(1, "geo", "high"), (1, "geo", "info"), (1, "synthesis", "critical"), (2, "geo", "low")], "audit_id long, phase string, severity string")
    scores = spark.createDataFrame([(1, "geo", 5.0, 10.0, 2), (1, "eeat", 10.0, 10.0, 1), (1, "topical", 0.0, 10.0, 3), (2, "geo", 0.0, 0.0, 2), (2, "eeat", 9.0, 10.0, 1)], "audit_id long, phase string, score double, score_max double, phase_order int")
    skipped = spark.createDataFrame([(1, "topical")], "audit_id long, phase string")
    got = {r.audit_id: tuple(r)[1:] for r in scoring.executive(audits, findings, scores, skipped).collect()}
    assert got[1] == ("a.example", 50, "À améliorer", 2, 1, "Crédibilité (E-E-A-T)", "Visibilité IA (GEO)")
    assert got[2] == ("b.example", 90, "Excellent", 1, 0, "Crédibilité (E-E-A-T)", "Crédibilité (E-E-A-T)")
    assert got[3][:5] == ("c.example", 0, "Critique", 0, 0)


def test_a_large_bucket_is_several_files(spark, tmp_path):
    store = KeyedStore(spark, f"{tmp_path}/s", ["k"], "at", buckets=2, suited=20)
    store.merge(spark.createDataFrame([(k, 1, "old") for k in range(400)], SCHEMA), 0)
    first = len(store.read()._jdf.inputFiles())
    store.merge(spark.createDataFrame([(k, 2, "new") for k in range(0, 400, 2)], SCHEMA), 1)
    assert rows_of(store.read()) == [(k, 1 + (k + 1) % 2, "old" if k % 2 else "new") for k in range(400)]
    assert first > 10 and len(store.read()._jdf.inputFiles()) > 10
