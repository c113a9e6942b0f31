import math

import duckdb
import numpy as np
import pytest

from pagelantern.llm import hard_negatives as hn

SCHEMA = "vec_id long, embedding array<float>, label int, score long, anchor string"


def slow(rows):
    """The contract in plain Python: rows of (vec_id, vector, label)."""
    kept = []
    for i, v, label in rows:
        if i is None or v is None or label is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        kept.append((i, (label + 1) % 10 if i % 7 == 0 else label, [math.floor(256 * float(np.float32(x))) for x in v]))
    out = []
    for n, (i, label, v) in enumerate(kept):
        if i % 100:
            continue
        scored = [(-sum(x * y for x, y in zip(v, w)), j, m) for k, (j, m, w) in enumerate(kept) if k != n]
        for ps, pid, _ in sorted(x for x in scored if x[2] == label)[:5]:
            far = sorted((s, j) for s, j, m in scored if m != label and 30 * -ps <= 100 * -s <= 90 * -ps)[:10]
            out += [(i, pid, r, j, -ps, -s) for r, (s, j) in enumerate(far, 1)]
    return sorted(out)


def found(df, **more):
    label = "case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label"
    vectors = hn.integer_vectors(df.selectExpr("vec_id", "embedding", label, "score", "anchor"))
    return sorted(tuple(r) for r in hn.mine(vectors, vectors.where("vec_id % 100 = 0"), **more).collect())


def test_strassen_equals_plain_products():
    rng = np.random.default_rng(1)
    for m, k, n in [(1, 1, 1), (33, 64, 100), (70, 17, 65), (512, 64, 300), (129, 255, 130), (40, 3, 50)]:
        a, b = rng.integers(-(2**24), 2**24, (m, k)), rng.integers(-(2**24), 2**24, (k, n))
        assert (hn.strassen(a, b, 8) == a @ b).all() and hn.strassen(a, b).dtype == np.int64
    big = np.array([[2**62, 2**62], [1, -(2**62)]])
    assert (hn.strassen(np.kron(big, np.eye(20, dtype=np.int64)), np.eye(40, dtype=np.int64), 4) == np.kron(big, np.eye(20, dtype=np.int64))).all()


@pytest.mark.parametrize("blocks", [(2048, 8192), (3, 50)])
def test_equals_plain_python(spark, frame, blocks):
    rng = np.random.default_rng(3)
    rows = [(int(i), [float(x) for x in rng.normal(0.3, 0.4, 9)], int(rng.integers(0, 4))) for i in range(0, 1200, 3)]
    want = slow(rows)
    assert found(frame([(*r, 0, "") for r in rows], SCHEMA), blocks=blocks) == want and len(want) > 40


def test_ties_repeats_hot_label_and_copies(spark, frame):
    rng = np.random.default_rng(4)
    rows = [(i, [0.5, 0.25, 0.0], 3) for i in range(0, 900, 2)]  # a hot label, one vector
    rows += [(i, [float(x) for x in rng.integers(0, 3, 3) / 4], i % 3) for i in range(1, 500, 2)]  # many equal scores
    rows += [(200, [0.5, 0.25, 0.0], 3)] * 3 + [(100, [0.75, 0.5, 0.25], 3), (100, [0.75, 0.5, 0.25], 1)]
    assert found(frame([(*r, 0, "") for r in rows], SCHEMA), blocks=(2, 60)) == slow(rows)


def test_nulls_lengths_and_empty_tables(spark, frame):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 1.0], 1), (100, [], 1), (200, [nan, 1.0], 1), (300, [1.0, None], 1), (400, [inf], 1), (500, None, 1), (600, [1.0], None), (None, [1.0], 1)]
    rows += [(1, [1.0], 1), (2, [0.5, 0.2, 9.0], 2), (3, [-1.0], 2), (4, [0.5], 3), (7, [1.0, 0.1], 9), (1000, [-1.0, -1.0], 2)]
    got = found(frame([(*r, 0, "") for r in rows], SCHEMA))
    assert got == slow(rows) and got
    assert found(frame([], SCHEMA)) == []
    assert found(frame([(1, [1.0], 1, 0, "")], SCHEMA)) == []


def test_scores_beyond_64_bits_are_refused(spark, frame):
    with pytest.raises(ValueError, match="64 bits"):
        hn.integer_vectors(frame([(1, [1e30], 1, 0, "")], SCHEMA))


def test_query_equals_its_sql(spark):
    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from '{folder}/embeddings.parquet'")
    want = sorted(con.sql(hn.SQL).fetchall())
    assert sorted(tuple(r) for r in hn.op13_hard_negatives(spark, folder).collect()) == want and want
