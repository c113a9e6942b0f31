import hashlib
import math

from pagelantern.llm import mixing


def poisson(mean, u):
    k, p = 0, math.exp(-mean)
    c = p
    while c < u:
        k += 1
        p *= mean / k
        c += p
    return k


def unit(doc, j, seed="mix"):
    return int(hashlib.md5(f"{seed}:{doc}:{j}".encode()).hexdigest()[:13], 16) / 2**52


def test_counts_equal_inverted_poisson(frame):
    rows = [(k, "x" * 10, "big" if k % 3 else f"s{k % 9}") for k in range(400)]
    docs = frame([(*r, None) for r in rows], "doc_id long, text string, source string, rate string")
    chars = {}
    for _, t, s in rows:
        chars[s] = chars.get(s, 0) + len(t)
    for weights in (None, {"big": 1.0, "s0": 3.0}, {"s3": 1.0}):
        w = {s: math.sqrt(c) if weights is None else weights.get(s, 0.0) for s, c in chars.items()}
        rate = {s: w[s] / sum(w.values()) * sum(chars.values()) / c for s, c in chars.items()}
        got = {}
        for r in mixing.poisson_mix(docs, weights).collect():
            got[r.doc_id] = got.get(r.doc_id, 0) + 1
            assert r.copy_no <= r.n_copies
        want = {k: poisson(rate[s], unit(k, 1)) for k, _, s in rows if rate[s] > 0}
        assert got == {k: n for k, n in want.items() if n}


def test_shares_meet_the_weights(frame):
    docs = frame([(k, "word " * (1 + k % 20), "a" if k % 10 else "b") for k in range(6000)], "doc_id long, text string, source string")
    chars = {}
    for r in mixing.poisson_mix(docs, {"a": 1.0, "b": 1.0}).collect():
        chars[r.source] = chars.get(r.source, 0) + len(r.text)
    assert abs(chars["b"] / chars["a"] - 1) < 0.1


def test_large_rates_are_split(frame):
    docs = frame([(k, "x", "rare" if k < 3 else "y") for k in range(3000)], "doc_id long, text string, source string")
    n = mixing.poisson_mix(docs, {"rare": 1.0}).groupBy("doc_id").count().collect()
    assert len(n) == 3 and all(abs(r["count"] - 1000) < 200 for r in n)


def test_nulls_and_empty(frame):
    rows = [(1, None, "e"), (2, "", "e"), (None, "abc", None), (None, "abc", None), (5, "abc", "s")]
    docs = frame(rows, "doc_id long, text string, source string")
    assert {r.source for r in mixing.poisson_mix(docs, seed="k").collect()} <= {None, "s"}
    assert mixing.poisson_mix(frame([], docs.schema)).count() == 0


def test_plan_is_native(spark, sf_dir):
    plan = mixing.op2_poisson_mix(spark, sf_dir)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_a_very_long_text_stays_whole(frame):
    long = "word " * 400_000
    docs = frame([(1, long, "a"), *((k, "word " * 40, "b") for k in range(2, 2002))], "doc_id long, text string, source string")
    kept = [r.text for r in mixing.poisson_mix(docs, {"a": 3.0, "b": 1.0}).collect() if r.source == "a"]
    assert kept and set(kept) == {long}
