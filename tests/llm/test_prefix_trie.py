import hashlib
import random
import zlib

import duckdb
import numpy as np
import pytest

from pagelantern.llm import prefix_trie as pt

SCHEMA = "conv_id long, turn long, role string, text string, base long, key string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def slow(rows):
    """The contract in plain Python: rows of (conv_id, turn, role, text)."""
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()
            own.setdefault(c, []).append(((turn is not None, turn or 0), digest, role, text))
    own = {c: [(r, t) for _, _, r, t in sorted(x)] for c, x in own.items()}
    made = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (abs(c) % 5 if c >= 0 else -(abs(c) % 5))
        made[c] = own.get(base, [])[:h] + own[c][h:]
    members = {}
    for c, x in made.items():
        for d in range(len(x) + 1):
            members.setdefault(tuple(x[:d]), []).append(c)
    kids = {p: [] for p in members}
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in kids[p]) or 1
        saved[p] = sum(saved[k] for k in kids[p]) + ((len(members[p]) - 1) * len(p[-1][1].encode()) if p else 0)
    out = []
    for p, m in members.items():
        ends = ",".join(str(c) for c in sorted(c for c in m if len(made[c]) == len(p)))
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids[p]), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def found(df, each):
    nodes = pt.trie_nodes(pt.rebuilt(pt.turn_sequences(df)), each)
    return sorted((tuple(r) for r in nodes.select(*COLUMNS).collect()), key=str)


def made_rows(seed, convs=300, alphabet=4, longest=12):
    rng, rows = random.Random(seed), []
    for c in range(-20, convs):
        for turn in range(rng.choice([0, 1, 3, 5, longest])):
            x = rng.choice([0, 0, 0, rng.randrange(alphabet)])
            rows.append((c, turn, ["user", "assistant", None, ""][x % 4], [f"text {x} ü", None, "", "z" * 3000][x % 4], 1, "k"))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed,each", [(1, 200_000), (2, 30), (3, 7)])
def test_equals_plain_python(spark, frame, seed, each):
    rows = made_rows(seed)
    assert found(frame(rows, SCHEMA), each) == slow([r[:4] for r in rows])


def test_hot_prefix_copies_and_long_conversation(spark, frame):
    rows = [(c, t, "user", "same") for c in range(0, 3000, 5) for t in range(3)]  # copies
    rows += [(c, t, "user", "same" if t < 4 else f"{c}") for c in range(3000, 4500, 5) for t in range(5)]  # a hot prefix
    rows += [(5000, t, "user", "same") for t in range(700)] + [(5005, t, "user", "same" if t < 650 else "x") for t in range(700)]
    assert found(frame([(*r, 0, "") for r in rows], SCHEMA), 100) == slow(rows)


def test_ties_nulls_repeats_and_absent_bases(spark, frame):
    rows = [(7, None, "user", "first"), (7, 3, "b", "x"), (7, 3, "a", "x"), (7, 3, "a", "x"), (None, 1, "user", "left out"), (None, 1, "user", "left out")]
    rows += [(5, 1, None, None), (11, 1, "", ""), (13, 0, "user", "0"), (-3, 0, "user", "n"), (2**62, 0, "user", "big")]
    assert found(frame([(*r, 0, "") for r in rows], SCHEMA), 200_000) == slow(rows)
    assert found(frame([], SCHEMA), 200_000) == []


def test_double_array_holds_its_sequences_and_no_others():
    rng = np.random.default_rng(5)
    seqs = sorted({tuple(rng.integers(0, 40, rng.integers(0, 9)).tolist()) for _ in range(2000)} | {tuple(range(k)) for k in range(30)})
    lens = np.array([len(s) for s in seqs])
    trie = pt.DoubleArray(np.array([x for s in seqs for x in s], np.int64), lens)
    nodes, slots = {s[:d] for s in seqs for d in range(len(s) + 1)}, {0}
    for at, where in trie.walk():
        slots |= set(where.tolist())
    assert len(slots) == len(nodes) == int((trie.check >= 0).sum()) and trie.top < 3 * len(nodes)
    for s in seqs[:200]:  # a child that no sequence has is no slot
        state = 0
        for x in s:
            state = int(trie.base[state]) + x
        other = next(x for x in range(40, 80))
        to = int(trie.base[state]) + other
        assert s + (other,) in nodes or not (0 < to < len(trie.check) and trie.check[to] == state)


def test_query_equals_its_sql(spark):
    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"create view conversations as select * from '{folder}/conversations.parquet'")
    want = con.sql(f"select {', '.join(COLUMNS)} from ({pt.SQL})").fetchall()
    got = [tuple(r) for r in pt.op11_prefix_trie(spark, folder).select(*COLUMNS).collect()]
    assert sorted(got, key=str) == sorted(want, key=str) and len(got) > 30
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert sorted(got, key=str) == slow(rows)
