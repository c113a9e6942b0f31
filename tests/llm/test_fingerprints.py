import hashlib
import re
import time

from pyspark.sql import functions as F

from pagelantern.llm import fingerprints as fp
from pagelantern.llm.common import table


def shingles(text):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", text or "") if x]
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def test_small_texts_are_exact(frame):
    texts = [None, "", "one", "a b c d e f g", "a b c d e f h", "a b c d e f g a b c d e", " ".join(map(str, range(60)))]
    rows = frame([(i, j, texts[i], texts[j]) for i in range(len(texts)) for j in range(len(texts))], "i int, j int, a string, b string")
    marks = rows.select("i", "j", fp.sketch(F.col("a")).alias("a"), fp.sketch(F.col("b")).alias("b"))
    for r in marks.select("i", "j", fp.resemblance(F.col("a"), F.col("b")).alias("r"), fp.containment(F.col("a"), F.col("b")).alias("c"), fp.distinct_shingles(F.col("a")).alias("n")).collect():
        a, b = shingles(texts[r.i]), shingles(texts[r.j])
        assert r.n == len(a) and abs(r.r - (len(a & b) / len(a | b) if a | b else 1)) < 1e-9 and abs(r.c - (len(a & b) / len(a) if a else 1)) < 1e-9


def test_sketches_merge_and_estimate(frame):
    one, two = " ".join(f"w{k}" for k in range(3000)), " ".join(f"w{k}" for k in range(1500, 4500))
    r = frame([(one, two)], "a string, b string").select(
        fp.resemblance(fp.sketch(F.col("a")), fp.sketch(F.col("b"))).alias("r"),
        fp.distinct_shingles(fp.sketch(F.col("a"))).alias("n"),
        (fp.merged(fp.sketch(F.col("a")), fp.sketch(F.col("b"))) == fp.sketch(F.concat_ws(" ", "a", "b"))).alias("same"),
    ).first()
    assert abs(r.r - 1 / 3) < 0.2 and abs(r.n / 2996 - 1) < 0.4


def test_next_document(frame):
    for n in (1, 2, 7, 300):
        ids = [k * k % 1009 for k in range(n)]
        ids = sorted(set(ids))
        docs = frame([(i, f"t{i}") for i in ids], "doc_id long, text string")
        got = {r.doc_id: r.next_doc_id for r in fp.with_next(docs, each=20).collect()}
        assert got == {i: ids[k - 1] for k, i in enumerate(ids)}


def test_next_with_nulls_and_repeats(frame):
    docs = frame([(None, "n"), (3, "a"), (3, "a"), (1, None)], "doc_id long, text string")
    got = fp.with_next(docs, each=1).collect()
    assert len(got) == 4 and sorted([(str(r.doc_id), str(r.next_doc_id)) for r in got]) == [("1", "None"), ("3", "1"), ("3", "3"), ("None", "3")]
    assert fp.with_next(frame([], docs.schema)).count() == 0


def test_next_with_hot_ids(frame):
    """Ids and nulls that many rows share are cut by the hash: one cycle through all rows, ids descending, nulls last."""
    rows = [(5, f"a{k}") for k in range(120)] + [(None, f"n{k}") for k in range(90)] + [(k, f"b{k}") for k in range(40)]
    got = fp.with_next(frame(rows, "doc_id long, text string"), each=10).collect()
    follows = {(r.doc_id, r.text): (r.next_doc_id, r.next_text) for r in got}
    assert len(got) == len(rows) and sorted(map(str, follows)) == sorted(map(str, follows.values())) == sorted(map(str, rows))
    at, order = (39, "b39"), []
    while len(order) < len(rows):
        order.append(at[0])
        at = follows[at]
    assert at == (39, "b39") and order == sorted((k for k, _ in rows if k is not None), reverse=True) + [None] * 90


def test_time_does_not_follow_the_number_of_ranges(spark):
    """The ranges' bounds are constants of the plan, not arrays that every row reads."""
    docs = spark.range(40_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), F.col("id").cast("string")).alias("text"))
    took = {}
    for many in (20, 20, 2000):  # the first run compiles
        out = fp.with_next(docs, each=40_000 // many)
        began = time.time()
        assert out.agg(F.sum("next_doc_id")).first()[0] == 40_000 * 39_999 // 2
        took[many] = time.time() - began
        assert "split(" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert took[2000] < 4 * took[20] + 3


def slow_sketch(text):
    """The bottom k of a text's shingle hashes, with the hash library's own XXH64 chained as Spark does."""
    import ctypes

    import xxhash

    signed = lambda h: ctypes.c_int64(h).value
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", text or "") if x]
    if not w:
        return []
    hashes = set()
    for group in [w[k : k + fp.WORDS] for k in range(len(w) - fp.WORDS + 1)] or [[" ".join(w)]]:
        seed = 42
        for x in group:
            seed = xxhash.xxh64_intdigest(x.encode(), seed)
        hashes.add(signed(seed))
    return sorted(hashes)[: fp.K]


def test_query_equals_brute_force(spark, tmp_path):
    """The query on null and empty texts, repeated rows and ids, and extra columns, against plain Python."""
    texts = ["", None, "one", "a b c d e f g", "é ü\u00a0x \t y z w v u", " ".join(f"w{k}" for k in range(400)), "a b c d e f g"]
    rows = [(k, t, "x") for k, t in enumerate(texts)] + [(None, "null id " * 5, "x"), (3, "a b c d e f g", "x"), (3, "a b c d e f g", "x")]
    spark.createDataFrame(rows, "doc_id long, text string, fingerprint string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = fp.op5_fingerprints(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    digits = lambda t: "".join(f"{h & (2**64 - 1):016x}" for h in slow_sketch(t))

    def near(a, b):
        a, b = slow_sketch(a), slow_sketch(b)
        both = sorted({*a, *b})[: fp.K]
        return sum(h in a and h in b for h in both) / len(both) if both else 1.0

    order = sorted((r for r in rows if r[0] is not None), key=lambda r: -r[0]) + [rows[7]]
    want = []
    for k, (i, text, _) in enumerate(order):
        text, nxt = text or "", order[(k + 1) % len(order)][1] or ""
        cut = len(text) // 3
        edited = text[: len(text) - cut] + nxt[:cut]
        want.append((str(i), len(text), hashlib.sha256(edited.encode()).hexdigest(), digits(text), digits(edited), round(near(text, edited), 9), round(near(text, nxt), 9)))
    assert sorted((str(r.doc_id), r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, round(r.near_edited, 9), round(r.near_next, 9)) for r in got) == sorted(want)


def test_query_on_table(spark, sf_dir):
    docs = {r.doc_id: r.text or "" for r in table(spark, sf_dir, "documents").collect()}
    order = sorted(docs, reverse=True)
    rows = fp.op5_fingerprints(spark, sf_dir).collect()
    assert len(rows) == len(docs)
    by_text = {}
    for r in rows:
        text, nxt = docs[r.doc_id], docs[order[(order.index(r.doc_id) + 1) % len(order)]]
        k = len(text) // 3
        edited = text[: len(text) - k] + nxt[:k]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        a, b, c = shingles(text), shingles(edited), shingles(nxt)
        assert abs(r.near_edited - len(a & b) / len(a | b)) < 0.35 and abs(r.near_next - len(a & c) / len(a | c)) < 0.35
        assert by_text.setdefault(text, r.fingerprint) == r.fingerprint
