import datetime as dt

from pyspark.sql import functions as F

from pagelantern.operators import rules
from pagelantern.sources import features as fx
from pagelantern.sources import tables
from pagelantern.streaming import jobs

T0 = dt.datetime(2024, 1, 1)


def _split(df, folder, n, by):
    """df in n files in the order of a column, as a stream would get it."""
    for k, part in enumerate(range(n)):
        df.where(f"ntile = {part + 1}").drop("ntile").coalesce(1).write.mode("append").parquet(folder)


def _stream(spark, df, folder, n=3, by="ts"):
    from pyspark.sql import Window

    _split(df.withColumn("ntile", F.ntile(n).over(Window.orderBy(by))), folder, n, by)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(folder)


def rows(df):
    return sorted(map(str, (r.asDict() for r in df.collect())))


def test_counts_by_day_equal_batch(spark, sf_dir, tmp_path):
    events = tables.table(spark, sf_dir, "events")
    stream = _stream(spark, events, f"{tmp_path}/in")
    got = jobs.run_available(jobs.counts_by_day(stream), str(tmp_path), "complete")
    assert rows(got) == rows(jobs.counts_by_day(events))


def test_sliding_counts_equal_batch(spark, sf_dir, tmp_path):
    events = tables.table(spark, sf_dir, "events").limit(300)
    stream = _stream(spark, events, f"{tmp_path}/in")
    got = jobs.run_available(jobs.sliding_counts(stream), str(tmp_path), "complete")
    assert rows(got) == rows(jobs.sliding_counts(events))


def test_continuous_audit_equals_batch(spark, sf_dir, tmp_path):
    pages = tables.pages(spark, sf_dir)
    stream = _stream(spark, pages, f"{tmp_path}/in", by="page_id")
    got = jobs.run_available(jobs.continuous_audit(stream), str(tmp_path)).select("page_id", "rule_id", "points")
    made = fx.page_features(pages)
    want = rules.page_findings(rules.rule_inputs(made))
    assert rows(got) == rows(want.select("page_id", "rule_id", "points"))


def test_first_copies(spark, tmp_path):
    data = [("h", "a", T0), ("h", "b", T0), ("h", "a", T0 + dt.timedelta(hours=1)), ("g", "a", T0 + dt.timedelta(hours=2))]
    stream = _stream(spark, spark.createDataFrame(data, "host string, content_hash string, ts timestamp"), f"{tmp_path}/in", 2)
    got = jobs.run_available(jobs.first_copies(stream), str(tmp_path))
    assert sorted((r.host, r.content_hash) for r in got.collect()) == [("g", "a"), ("h", "a"), ("h", "b")]


def test_drift_alerts_suppress_for_a_day(spark, tmp_path):
    hours = [(0, 90.0), (1, 70.0), (2, 50.0), (24, 49.0), (26, 30.0)]
    data = [(1, T0 + dt.timedelta(hours=h), s) for h, s in hours] + [(2, T0, 50.0), (2, T0 + dt.timedelta(hours=3), 45.0)]
    stream = _stream(spark, spark.createDataFrame(data, "schedule_id long, ts timestamp, score double"), f"{tmp_path}/in", 2)
    got = jobs.run_available(jobs.drift_alerts(stream), str(tmp_path))
    assert sorted((r.schedule_id, r.at, r.delta) for r in got.collect()) == [(1, T0 + dt.timedelta(hours=1), -20.0), (1, T0 + dt.timedelta(hours=26), -19.0)]


def test_upsert_keeps_latest(spark, tmp_path):
    data = [(1, T0, "queued"), (1, T0 + dt.timedelta(1), "completed"), (2, T0, "queued")]
    stream = _stream(spark, spark.createDataFrame(data, "id long, ts timestamp, status string"), f"{tmp_path}/in", 2)
    jobs.upsert_batches(stream, f"{tmp_path}/out", ["id"], "ts", f"{tmp_path}/state").awaitTermination()
    last = jobs.latest_version(spark, f"{tmp_path}/out")
    assert sorted((r.id, r.status) for r in last.collect()) == [(1, "completed"), (2, "queued")]


def test_stalled_runs(spark, tmp_path):
    m = lambda k: T0 + dt.timedelta(minutes=k)
    data = [(1, m(0), "started"), (2, m(1), "started"), (2, m(3), "completed"), (3, m(30), "started"), (4, m(31), "started"), (5, m(60), "started")]
    stream = _stream(spark, spark.createDataFrame(data, "run_id long, ts timestamp, status string"), f"{tmp_path}/in", 3)
    got = jobs.run_available(jobs.stalled_runs(stream), str(tmp_path))
    assert 1 in {r.run_id for r in got.collect()} and 2 not in {r.run_id for r in got.collect()}
