import tracemalloc
import zlib
from collections import Counter

import numpy as np

from pagelantern.llm import language_id as lid


def slow_grams(text):
    words = "".join(c if c.isalpha() else " " for c in text.lower()).split()
    padded = "\0" + "\0".join(words) + "\0"
    return [[padded[i : i + n] for i in range(len(padded) - n + 1) if "\0" not in padded[i : i + n][1 : n - 1] and (n > 1 or padded[i] != "\0")] for n in range(1, lid.ORDERS + 1)]


def joined(parts):
    parts = list(parts)
    return [np.concatenate([p[n] for p in parts]) for n in range(lid.ORDERS)] if parts else [np.empty(0, np.uint64)] * lid.ORDERS


def test_ngrams_equal_slow_ones():
    for text in ("a", "The cat, the DOG!", "Übung macht  den Meister 12 mal", "x-y"):
        for each in (1, 2, 3, 7, 1000):
            seen = {}
            for fast, want in zip(joined(lid.grams(text, each)), slow_grams(text)):
                assert len(fast) == len(want)
                for h, g in zip(fast.tolist(), want):
                    assert seen.setdefault(h, g) == g
            assert len(set(seen.values())) == len(seen)
    assert not list(lid.grams("12 !")) and not list(lid.grams(None))


def test_long_texts_are_read_in_slices():
    model = lid.LanguageFilter(["x"], np.concatenate(joined(lid.grams("long words"))), np.zeros(len(np.concatenate(joined(lid.grams("long words")))), dtype=np.int64))
    tracemalloc.start()
    assert model.predict("long words " * 700_000) == ("x", 1.0)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 600e6


def test_predictions_equal_those_of_plain_sets(spark, sf_dir):
    """Learning and deciding again with counted strings and exact sets, in plain Python."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    rows = [r for r in docs.collect() if r.text and r.lang]
    seen = {}
    for r in rows:
        for n, gs in enumerate(slow_grams(r.text)):
            seen.setdefault((r.lang, n), Counter()).update(gs)
    rates = {}
    for (lang, n), counts in seen.items():
        for g, c in counts.items():
            if (rate := c / sum(counts.values())) >= 2e-5:
                rates.setdefault((n, g), {})[lang] = rate
    owners = {k: {lang for lang, r in x.items() if r >= 0.5 * max(x.values())} for k, x in rates.items()}
    model, same = lid.learn(docs), []
    for r in rows[:60]:
        gs = [(n, g) for n, x in enumerate(slow_grams(r.text)) for g in x]
        shares = {lang: sum(lang in owners.get(k, ()) for k in gs) / len(gs) for lang in model.languages}
        found = model.shares(r.text)
        assert max(abs(found[i] - shares[lang]) for i, lang in enumerate(model.languages)) < 0.02
        same.append(model.predict(r.text)[0] == max(model.languages, key=shares.get))
    assert np.mean(same) > 0.95


def test_filter_has_all_and_few_others():
    rng = np.random.default_rng(2)
    hashes = rng.integers(0, 2**63, 30000).astype(np.uint64)
    f = lid.LanguageFilter([f"l{k}" for k in range(70)], hashes, np.arange(30000) % 70)
    masks = None
    for places in f._places(hashes):
        masks = f.masks[places] if masks is None else masks & f.masks[places]
    k = np.arange(30000) % 70
    assert (masks[np.arange(30000), k // 64] >> (k % 64).astype(np.uint64) & np.uint64(1)).all()
    assert f.false.max() < 0.01


def test_edge_cases(frame):
    rows = [(k, "the cat and the dog sat " * 3, "en") for k in range(20)] + [(100 + k, "der hund und die katze sind da " * 3, "de") for k in range(20)]
    model = lid.learn(frame([*rows, (None, "x", "en"), (7, None, "en"), (8, "y", None)], "doc_id long, text string, lang string"))
    docs = frame([(1, None, "q"), (2, "", "q"), (3, "12 %", None), (None, "The DOG", ""), (5, "katze " * 50000, "")], "doc_id long, text string, score string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in lid.identify(docs, model).collect()}
    assert got[1] == got[2] == got[3] == ("und", 0.0) and got[None][0] == "en" and got[5][0] == "de" and 0 <= got[5][1] <= 1
    none = lid.learn(frame([], "doc_id long, text string, lang string"))
    assert {r.lang_pred for r in lid.identify(docs, none).collect()} == {"und"}


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = lid.op9_language_id(spark, folder).collect()
    assert len(rows) == len(truth) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    held = [r for r in rows if r.held_out]
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.98
