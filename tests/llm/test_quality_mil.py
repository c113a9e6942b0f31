import math
import tracemalloc
import zlib

import numpy as np

from pagelantern.llm import quality_mil as qm


def slow_score(model, text):
    """The forward pass again, passage by passage, with plain numbers for gates, attention and the mean."""
    p, total, weights = model.p, np.zeros(len(model.p["c"])), 0.0
    text = (text or "").replace("\0", " ")
    for part in [text[k : k + qm.PASSAGE] for k in range(0, len(text), qm.PASSAGE)] or [""]:
        x = (qm.features(qm.passages([part])[0])[0] - model.mean) / model.scale
        h = [math.tanh(sum(x * p["w1"][:, j]) + p["b1"][j]) for j in range(len(p["b1"]))]
        e = 0.0
        for j in range(len(p["w"])):
            t = math.tanh(sum(a * b for a, b in zip(h, p["v"][:, j])) + p["bv"][j])
            e += p["w"][j] * t / (1 + math.exp(-sum(a * b for a, b in zip(h, p["u"][:, j])) - p["bu"][j]))
        weights += math.exp(e)
        total += math.exp(e) * np.array(h)
    return 1 / (1 + math.exp(-(sum(total / weights * p["c"]) + p["c0"])))


def slow_features(part):
    """Shares counted with dictionaries."""
    kind = qm.kinds()
    n = max(1, len(part))
    single, pairs = np.zeros(qm.BINS), np.zeros(qm.KINDS**2)
    for c in part:
        single[ord(c) if ord(c) < 128 else 128 + ord(c) % 32] += 1
    for a, b in zip(part, part[1:] + "\0" if len(part) < qm.PASSAGE else part[1:]):
        pairs[kind[ord(a)] * qm.KINDS + kind[ord(b)]] += 1
    grams = [part[k : k + qm.GRAM] for k in range(len(part) - qm.GRAM + 1)]
    spaces = sum(kind[ord(c)] in (5, 6) for c in part)
    more = [len(set(grams)) / max(1, len(grams)), n / qm.PASSAGE, math.log1p(n / (spaces + 1)) / 4]
    return np.r_[np.sqrt(single / n), np.sqrt(pairs / n), more]


def trained(seed=0):
    rng = np.random.default_rng(seed)
    texts = ["the cat sat on the mat and saw a dog. " * int(k) for k in rng.integers(1, 60, 80)]
    texts += ["the cat sat on the mat. " * int(a) + "BUY!! NOW!! " * int(b) for a, b in zip(rng.integers(0, 60, 80), rng.integers(60, 99, 80))]
    y = np.r_[np.ones(80), np.zeros(80)]
    return qm.fit([qm.features(qm.passages([t])[0]) for t in texts], y, epochs=20, batch=16), texts, y


def test_features_equal_slow_ones():
    for part in ("", "a", "Hello, World! 12\n(ok) Ünï", "ab" * 256, "x y " * 100, "漢字 かな " * 9):
        assert np.allclose(qm.features(qm.passages([part])[0])[0], slow_features(part), atol=1e-5), part
    codes, bag = qm.passages([None, "a" * 513, "", "b" * 512])
    assert bag.tolist() == [0, 1, 1, 2, 3] and (codes > 0).sum(1).tolist() == [0, 512, 1, 0, 512]


def test_gradient_equals_differences():
    rng = np.random.default_rng(1)
    x, many, y = rng.normal(size=(9, 6)).astype(np.float32), np.array([1, 3, 5]), np.array([1.0, 0.0, 1.0])
    model = qm.Attention(np.zeros(6), np.ones(6), units=4, gates=3)
    for k in model.p:
        model.p[k] = rng.normal(size=np.shape(model.p[k]))
    _, g = model.gradient(x, many, y)
    for k in model.p:
        base = np.array(model.p[k], dtype=float)
        for at in np.ndindex(base.shape) if base.ndim else [()]:
            ends = []
            for d in (1e-5, -1e-5):
                moved = base.copy()
                moved[at] += d
                model.p[k] = moved
                ends.append(model.gradient(x, many, y)[0])
            model.p[k] = base
            assert abs((ends[0] - ends[1]) / 2e-5 - np.asarray(g[k])[at]) < 1e-6, (k, at)


def test_scores_equal_slow_ones_and_find_the_bad_passages():
    model, texts, y = trained()
    assert np.mean((model.scores(texts) >= 0.5) == y) > 0.97
    odd = [None, "", "short", "the cat " * 300 + "BUY!! NOW!! " * 90, "漢字" * 900]
    assert np.allclose(model.scores(odd), [slow_score(model, t) for t in odd], atol=1e-6)


def test_a_long_text_is_scored_in_slices():
    model, _, _ = trained()
    text = "the cat sat on the mat. " * 400_000
    tracemalloc.start()
    assert 0 <= model.scores([text])[0] <= 1
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 12 * len(text) + 60e6


def test_edge_cases(frame):
    docs = [(k, "the cat sat on the mat and saw a dog. " * (k % 7 + 1), "x") for k in range(60)] + [(100 + k, "BUY!! NOW!! " * (k % 5 + 9), "x") for k in range(60)]
    docs += [(3, "the cat sat on the mat and saw a dog. ", "x")] * 5 + [(None, "BUY!! NOW!! BUY!! NOW!!", "x"), (900, None, "x"), (901, "", "x"), (902, "the cat sat on a dog. " * 90_000, "x")]
    labels = [(k, 1, 0) for k in range(60)] + [(100 + k, 0, 0) for k in range(60)] + [(1, 1, 0), (2, None, 0), (None, 0, 0), (4, 7, 0), (5000, 1, 0)]
    docs, labels = frame(docs, "doc_id long, text string, score string"), frame(labels, "doc_id long, quality int, toxic int")
    model = qm.learn(docs, labels)
    rows = qm.score(docs, model).collect()
    assert len(rows) == 129 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    got = {r.doc_id: r.predicted for r in rows}
    assert got[None] == 0 and got[902] == 1 and all(got[k] == (k < 100) for k in [*range(60), *range(100, 160)])
    empty = frame([], "doc_id long, text string")
    assert qm.score(empty, model).collect() == [] and qm.learn(empty, labels) is None
    assert {(r.score, r.predicted) for r in qm.score(docs, None).collect()} == {(0.5, 1)}
    small = qm.learn(docs, labels, sample=5)
    assert small is not None


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    rows = qm.op12_quality(spark, folder).collect()
    assert len(rows) == spark.read.parquet(f"{folder}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    held = [(r.score, truth[r.doc_id]) for r in rows if r.held_out and truth.get(r.doc_id) is not None]
    good, bad = [s for s, q in held if q == 1], [s for s, q in held if q == 0]
    auc = np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])
    assert np.mean([(s >= 0.5) == q for s, q in held]) > 0.95 and auc > 0.95
