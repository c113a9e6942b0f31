import re

import numpy as np
import pytest
import xxhash

from pagelantern.llm import simhash
from pagelantern.llm.components import components
from pagelantern.llm.common import table


def plain_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    shingles = [" ".join(w[k : k + 3]) for k in range(max(1, len(w) - 2))] if w else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(fps, budget=3):
    """The smallest index each index reaches."""
    root = list(range(len(fps)))
    for _ in fps:
        new = [min(root[j] for j in range(len(fps)) if (fps[i] ^ fps[j]).bit_count() <= budget) for i in range(len(fps))]
        if new == root:
            break
        root = new
    return root


@pytest.mark.parametrize("text", ["", None, " \t\n", "One", "one two", "A b C", "É à the THE the THE the", "x " * 500, "a b c d e f g " * 3, "Straße ß K ſ z \x0b q"])
def test_fingerprint_is_as_defined(text):
    assert simhash.fingerprint(text) == plain_fingerprint(text)


@pytest.mark.parametrize("leaves", [4, 4096])
def test_groups_equal_brute_force(frame, leaves):
    rng = np.random.default_rng(3)
    base = [int(x) for x in rng.integers(0, 2**63, 40)]
    fps = base + [b ^ sum(1 << int(k) for k in rng.choice(64, rng.integers(1, 6), replace=False)) for b in base for _ in range(4)] + [base[0]] * 3
    want = brute(fps)
    rows = sorted(set(fps))
    classes = frame([(int(np.uint64(f).view(np.int64)), fps.index(f)) for f in rows], "fp long, rep long")
    got = {r.v: r.c for r in components(simhash.trie_links(classes, leaves=leaves)).collect()}
    assert {i: got.get(fps.index(fps[i]), fps.index(fps[i])) for i in range(len(fps))} == dict(enumerate(want))


def test_edge_cases(frame):
    rows = [(1, None, "z"), (2, "", "z"), (3, "a b c d", None), (3, "a b c d", None), (None, "a b c d", None), (None, "else where is it", "q"), (9, "w " * 30000 + "end", "")]
    docs = frame(rows, "doc_id long, text string, fingerprint string")
    got = sorted(((r.doc_id, r.component_id) for r in simhash.simhash_groups(docs).collect()), key=str)
    assert got == sorted([(1, 1), (2, 1), (3, 3), (3, 3), (None, 3), (None, None), (9, 9)], key=str)
    assert simhash.simhash_groups(frame([], docs.schema)).count() == 0


def test_links_lead_through_rows_without_an_id(frame):
    """A text whose fingerprint is within the budget of two others' that are not within it of each other, with and without an id."""
    rng, texts = np.random.default_rng(8), {}
    words = [f"w{k}" for k in range(900)]
    for _ in range(400):  # edits of one long text, some of whose fingerprints lie near each other
        t = list(words)
        for k in rng.choice(900, int(rng.integers(1, 5)), replace=False):
            t[k] = f"x{rng.integers(0, 9999)}"
        texts.setdefault(simhash.fingerprint(" ".join(t)), " ".join(t))
    near = lambda a, b: 0 < (a ^ b).bit_count() <= 3
    bridge = next((a, m, b) for m in texts for a in texts for b in texts if near(a, m) and near(m, b) and (a ^ b).bit_count() > 3)
    leaf = next((a, m) for a in texts for m in texts if near(a, m))
    for ids, want in (((1, 9, 2), [1, 1, 1]), ((1, None, 2), [1, 1, 1]), ((5, None, 2), [2, 2, 2]), ((None, None, 2), [2, 2, 2]), ((None, None, None), [None] * 3)):
        rows = simhash.simhash_groups(frame([(i, texts[f]) for i, f in zip(ids, bridge)], "doc_id long, text string")).collect()
        assert sorted((r.component_id for r in rows), key=str) == want, ids
    rows = simhash.simhash_groups(frame([(1, texts[leaf[0]]), (None, texts[leaf[1]])], "doc_id long, text string")).collect()
    assert [r.component_id for r in rows] == [1, 1]


def test_query_on_table(spark, sf_dir):
    docs = {r.doc_id: r.text for r in table(spark, sf_dir, "documents").collect()}
    rows = simhash.op3_simhash(spark, sf_dir).collect()
    assert {r.doc_id: r.fingerprint for r in rows} == {i: f"{simhash.fingerprint(t):016x}" for i, t in docs.items()}
    ids = sorted(docs)
    want = brute([simhash.fingerprint(docs[i]) for i in ids])
    assert {r.doc_id: r.component_id for r in rows} == {i: ids[w] for i, w in zip(ids, want)}
