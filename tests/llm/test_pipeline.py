import re

import corpus_pipeline as p
from pagelantern.llm import bpe, simhash


def test_stages_on_table(spark, sf_dir, tmp_path):
    docs, sizes = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in p.STAGES:
        before = docs
        stage(spark, docs, sf_dir).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        sizes.append(docs.count())
        if name != p.STAGES[-1][0]:
            assert docs.columns == p.COLUMNS
        if name == "simhash_near_dedup":
            fps = [simhash.fingerprint(r.text) for r in docs.collect()]
            assert len(set(fps)) == len(fps) and all((a ^ b).bit_count() > 3 for k, a in enumerate(fps) for b in fps[:k])
        if name == "secret_scan":
            assert before.count() == docs.count()
            assert not [r for r in docs.collect() if re.search("AKIA[A-Z0-9]{12}|[0-9a-f]{32}|password=[0-9a-f]{8}", r.text)]
        last = before
    assert sizes[0] == 200 and sizes[1] <= sizes[0]
    texts = {r.doc_id: r.text for r in last.collect()}
    coder = bpe.tokenizer(bpe.tokenizer_path())
    assert all(coder.decode(r.ids) == texts[r.doc_id] and r.n_tokens == len(r.ids) for r in docs.collect())


def test_run_and_odd_rows(spark, tmp_path):
    rows = [(1, "the same words are here now", "en", "s", 27), (2, "the same words are here now", None, None, None), (3, None, "en", "s", 0), (4, "", "en", "s", 0), (None, "quite other words stand there", "en", "t", 1), (5, "12 34", "en", "s", 5)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = p.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in got} <= {1, None}
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/none/documents.parquet")
    assert p.run(spark, f"{tmp_path}/none").count() == 0


def test_one_document_of_each_group_stays(spark):
    a, b, c, d, e = (" ".join(f"{w}{k}" for k in range(9)) for w in ("alpha", "beta", "gamma", "delta", "eps"))
    rows = [(None, a), (None, b), (None, b), (7, c), (7, d), (None, c), (3, d), (9, e), (9, e)]
    docs = spark.createDataFrame([(k, text, "en", None if k else "s", n) for n, (k, text) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long")
    got = p.near_duplicates(spark, docs.repartition(3), "").collect()
    assert sorted((str(r.doc_id), r.text) for r in got) == sorted([("None", a), ("None", b), ("7", c), ("3", d), ("9", e)])


def test_texts_that_share_an_id_both_stay(spark):
    rows = [(7, "one two three four five six seven", "en", "s", 1), (7, "quite other words stand here for once", "en", "s", 1)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.text for r in p.near_duplicates(spark, docs, "").collect()) == sorted({r[1] for r in rows})
