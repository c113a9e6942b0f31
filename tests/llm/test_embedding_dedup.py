import numpy as np

from pagelantern.llm import embedding_dedup
from pagelantern.llm.common import table


def brute(ids, vectors, threshold=0.95):
    ok = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(x != 0 for x in v) for v in vectors]
    unit = [np.array(v, float) / np.linalg.norm(np.array(v, float)) if k else None for v, k in zip(vectors, ok)]
    near = lambda i, j: i != j and ok[i] and ok[j] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= threshold
    links = [[j for j in range(len(ids)) if near(i, j)] for i in range(len(ids))]
    label = list(ids)
    for _ in ids:
        label = [min([label[i], *(label[j] for j in links[i])]) for i in range(len(ids))]
    return {i: (len(k), c) for i, k, c in zip(ids, links, label)}


def test_equal_brute_force(frame):
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((12, 16))
    rows = [c + rng.standard_normal(16) * s for c in centres for s in (0, 0.05, 0.1, 0.2, 0.3, 0.6)] + [centres[0]] * 5 + list(rng.standard_normal((60, 16)))
    rows = [[float(np.float32(x)) for x in r] for r in rows]
    rows += [None, [], [0.0] * 16, [float("nan")] * 16, [float("inf")] + [1.0] * 15, [None] + [1.0] * 15, rows[0][:8], rows[1][:8], [x * 2 for x in rows[0]]]
    ids = list(range(7, 7 + len(rows)))
    vectors = frame(list(zip(ids, rows)), "vec_id long, embedding array<float>")
    got = embedding_dedup.near_vectors(vectors, window=8, block=4).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == brute(ids, rows)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)


def test_empty_and_null_ids(frame):
    schema = "vec_id long, embedding array<double>, n_links string"
    assert embedding_dedup.near_vectors(frame([], schema)).count() == 0
    got = embedding_dedup.near_vectors(frame([(None, [1.0, 2.0], "x"), (3, [1.0, 2.0], None), (3, [1.0, 2.0], None)], schema)).collect()
    assert sorted([(str(r.vec_id), r.n_links, r.component_id, r.kept) for r in got], key=str) == [("3", 1, 3, True), ("3", 1, 3, True), ("None", 0, None, False)]


def test_passes_grow_with_the_logarithm():
    few, many = (embedding_dedup.passes_for(n, 0.95, 256, 1e-5) for n in (50_000, 1_000_000_000))
    assert embedding_dedup.passes_for(100, 0.95, 256, 1e-5) == 1 < few < many < 200


def test_query_on_table(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").collect()
    got = embedding_dedup.op1_embedding_dedup(spark, sf_dir).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == brute([r.vec_id for r in rows], [r.embedding for r in rows])


def test_pairs_in_a_dense_cloud_are_found(frame):
    rng = np.random.default_rng(2)
    turned = lambda v, cosine: cosine * v + np.sqrt(1 - cosine**2) * aside(v)

    def aside(v):
        r = rng.standard_normal(len(v))
        r -= (r @ v) * v
        return r / np.linalg.norm(r)

    centre = aside(np.eye(64)[0])
    cloud = [turned(centre, 0.9**0.5) for _ in range(1500)]
    rows = np.array(cloud + [turned(v, 0.955) for v in cloud[:300]])
    near = rows @ rows.T >= 0.95
    got = embedding_dedup.near_vectors(frame([(k, v.tolist()) for k, v in enumerate(rows)], "vec_id long, embedding array<double>"), window=16).collect()
    assert {r.vec_id: r.n_links for r in got} == dict(enumerate((near.sum(1) - 1).tolist()))
    assert sum(r.n_links > 0 for r in got) >= 600 and sum(not r.kept for r in got) >= 300


def test_many_dense_clouds_are_swept_by_cell(frame):
    rng = np.random.default_rng(3)
    unit = lambda v: v / np.linalg.norm(v, axis=-1, keepdims=True)
    centres = unit(rng.standard_normal((40, 64)))
    cloud = unit(centres[np.arange(2000) % 40] + 0.33 * unit(rng.standard_normal((2000, 64))))
    rows = np.r_[cloud, unit(cloud[:300] + 0.3 * unit(rng.standard_normal((300, 64))))]
    near = rows @ rows.T >= 0.95
    got = embedding_dedup.near_vectors(frame([(k, v.tolist()) for k, v in enumerate(rows)], "vec_id long, embedding array<double>"), window=16, block=64).collect()
    assert {r.vec_id: r.n_links for r in got} == dict(enumerate((near.sum(1) - 1).tolist()))
