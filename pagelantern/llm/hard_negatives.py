"""Hard negatives by Strassen products of int64 anchor and candidate tiles.

Vectors are integers, a score is an inner product. Anchors and candidates are dealt into blocks by hash; each pair of blocks
is a task's group. A task cuts its pair into tiles, pads them with zeros to even sides at each halving and multiplies
them by Strassen's recursion: seven products of half the side in place of eight. All of it is int64, so sums are exact.

Two passes. The first meets only rows of one label, in blocks of a label, and keeps for each anchor a heap of its best rows.
The second meets all rows and keeps a heap for each window of scores, one window for each positive of the anchor. Heaps
of different blocks merge by taking the best of both: a window function, which cuts them on the map side first.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagelantern.llm.common import cut, release, table

LEAF, TILE = 16, 512


def strassen(a: np.ndarray, b: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """The exact product of two int64 matrices, as long as its entries fit in 64 bits (sums on the way may wrap)."""
    m, k, n = a.shape[0], a.shape[1], b.shape[1]
    if min(m, k, n) <= leaf:
        return a @ b
    if m % 2 or k % 2:
        a = np.pad(a, ((0, m % 2), (0, k % 2)))
    if k % 2 or n % 2:
        b = np.pad(b, ((0, k % 2), (0, n % 2)))
    h, i, j = a.shape[0] // 2, a.shape[1] // 2, b.shape[1] // 2
    a11, a12, a21, a22 = a[:h, :i], a[:h, i:], a[h:, :i], a[h:, i:]
    b11, b12, b21, b22 = b[:i, :j], b[:i, j:], b[i:, :j], b[i:, j:]
    p1 = strassen(a11 + a22, b11 + b22, leaf)
    p2 = strassen(a21 + a22, b11, leaf)
    p3 = strassen(a11, b12 - b22, leaf)
    p4 = strassen(a22, b21 - b11, leaf)
    p5 = strassen(a11 + a12, b22, leaf)
    p6 = strassen(a21 - a11, b11 + b12, leaf)
    p7 = strassen(a12 - a22, b21 + b22, leaf)
    c = np.empty((2 * h, 2 * j), np.int64)
    c[:h, :j], c[:h, j:] = p1 + p4 - p5 + p7, p3 + p5
    c[h:, :j], c[h:, j:] = p2 + p4, p1 - p2 + p3 + p6
    return c[:m, :n]


def integer_vectors(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id, label and v, the vector's components x as floor(scale * x).

    Rows with a null vec_id, label or vector, or with a null or non-finite component, are left out. Vectors may differ
    in length: the shorter one of two counts as filled up with zeros. Other columns are ignored; repeated rows are rows.
    Raises if a score times 100 could leave 64 bits.
    """
    x = F.col("embedding")
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = vectors.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & x.isNotNull() & F.coalesce(fine, F.lit(False)))
    scaled = F.transform(x, lambda c: F.floor(c.cast("double") * scale))
    top, width = rows.agg(F.max(F.array_max(F.transform(x, lambda c: F.abs(c.cast("double")) * scale))), F.max(F.size(x))).first()
    if top is not None and (top + 1) ** 2 * width * 100 >= 2.0**63:
        raise ValueError(f"scores of {width} components of up to {top:.3g} do not fit in 64 bits")
    return rows.select("vec_id", F.col("label").cast("long").alias("label"), scaled.alias("v"))


def _matrix(vectors: pd.Series, width: int) -> np.ndarray:
    lens = vectors.map(len).to_numpy(np.int64)
    flat = np.concatenate([*vectors, np.empty(0, np.int64)]).astype(np.int64)
    out = np.zeros((len(lens), width), np.int64)
    row = np.repeat(np.arange(len(lens)), lens)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(lens) - lens, lens)] = flat
    return out


def _tiles(left: pd.DataFrame, right: pd.DataFrame):
    """Yields (first row of left, scores, first row of right) for tiles of both."""
    width = max(left["v"].map(len).max(), right["v"].map(len).max())
    a, b = _matrix(left["v"], width), _matrix(right["v"], width)
    for i in range(0, len(a), TILE):
        for j in range(0, len(b), TILE):
            yield i, strassen(a[i : i + TILE], b[j : j + TILE].T), j


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Indices of the k highest scores, equal ones by the smaller id."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores >= least)
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], -scores[at]))][:k]


class Heaps:
    """The k best (score, id) of each key, grown tile by tile."""

    def __init__(self, k: int):
        self.k, self.held = k, {}

    def add(self, key, scores: np.ndarray, ids: np.ndarray) -> None:
        at = _best(scores, ids, self.k)
        scores, ids = scores[at], ids[at]
        if key in self.held:
            scores, ids = (np.r_[x, y] for x, y in zip(self.held[key], (scores, ids)))
            at = _best(scores, ids, self.k)
            scores, ids = scores[at], ids[at]
        self.held[key] = scores, ids

    def rows(self):
        for key, (scores, ids) in self.held.items():
            for s, i in zip(scores.tolist(), ids.tolist()):
                yield key, s, i


def _pairs(anchors: DataFrame, rows: DataFrame, sizes: DataFrame, by: list[str]):
    """Both sides dealt into blocks inside `by`: a row is repeated for each block of the other side.

    sizes: `by`, a_blocks and c_blocks, the numbers of blocks of anchors and rows.
    """
    if by:
        anchors, rows = (x.join(sizes, by) for x in (anchors, rows))
    else:
        a, c = sizes.first()
        anchors, rows = (x.withColumns({"a_blocks": F.lit(a), "c_blocks": F.lit(c)}) for x in (anchors, rows))
    own = lambda key, many: F.pmod(F.xxhash64(*key), F.col(many)).cast("int")
    all_ = lambda many: F.explode(F.sequence(F.lit(0), F.col(many) - 1))
    anchors = anchors.withColumn("a", own(["anchor"], "a_blocks")).withColumn("c", all_("c_blocks"))
    rows = rows.withColumn("c", own(["row"], "c_blocks")).withColumn("a", all_("a_blocks"))
    fresh = lambda df: df.select(*(F.col(c).alias(c) for c in df.columns if c not in ("a_blocks", "c_blocks")))
    return fresh(anchors), fresh(rows)  # columns of their own, as both sides come from the same rows


def mine(
    vectors: DataFrame,
    anchors: DataFrame,
    positives: int = 5,
    negatives: int = 10,
    low: int = 30,
    high: int = 90,
    blocks: tuple[int, int] = (2048, 8192),
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    vectors, anchors: vec_id, label and v (integer arrays) as integer_vectors gives them; anchors are rows of vectors. An
    anchor's positives are its first `positives` other rows of its label, by score, equal ones by the smaller vec_id. For
    each anchor and positive come the first `negatives` rows of other labels whose score, times 100, lies between low and
    high times the positive's. A pair without any has no row; a positive score below zero has none by the rule itself.

    Rows are told apart by nothing but their values: of equal rows each is a row, and each equal anchor gives its
    rows again. Work grows with anchors times rows; a group is at most about one block of each, whatever the label.
    """
    vectors = cut(vectors.withColumn("row", F.monotonically_increasing_id()))  # equal rows go to different blocks
    # equal anchors are answered once
    anchors = anchors.groupBy("vec_id", "label", "v").agg(F.count("*").alias("copies"))
    anchors = cut(anchors.withColumn("anchor", F.sha2(F.concat_ws(":", "vec_id", "label", F.array_join("v", ",")), 256)))
    a_each, c_each = blocks
    count = lambda df, name: df.groupBy("label").agg(F.count("*").alias(name))
    blocked = lambda n, each: F.greatest(F.ceil(F.col(n) / each), F.lit(1)).cast("int")
    sizes = cut(count(anchors, "n_a").join(count(vectors, "n_c"), "label"))
    by_label = sizes.select("label", blocked("n_a", a_each).alias("a_blocks"), blocked("n_c", c_each).alias("c_blocks"))

    def first(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        heaps, ids = Heaps(positives + 1), right["vec_id"].to_numpy()
        if len(left) and len(right):
            for i, scores, j in _tiles(left, right):
                for r, row in enumerate(scores):
                    heaps.add(i + r, row, ids[j : j + TILE])
        names = left["anchor"].to_list()
        out = pd.DataFrame([(names[k], s, i) for k, s, i in heaps.rows()], columns=["anchor", "score", "vec_id"])
        release()
        return out

    a, c = _pairs(anchors.select("anchor", "label", "v"), vectors, by_label, ["label"])
    near = a.groupBy("label", "a", "c").cogroup(c.groupBy("label", "a", "c")).applyInPandas(first, "anchor string, score long, vec_id long")
    order = [F.desc("score"), "vec_id"]
    near = near.withColumn("n", F.row_number().over(Window.partitionBy("anchor").orderBy(*order))).where(F.col("n") <= positives + 1)
    self_score = F.aggregate("v", F.lit(0).cast("long"), lambda s, x: s + x * x)
    near = near.join(anchors.select("anchor", F.col("vec_id").alias("anchor_id"), "copies", self_score.alias("own")), "anchor")
    # one row of those that equal the anchor is the anchor itself; if none is among the first, it comes after them
    same = (F.col("vec_id") == F.col("anchor_id")) & (F.col("score") == F.col("own"))
    near = near.withColumn("self", F.min(F.when(same, F.col("n"))).over(Window.partitionBy("anchor")))
    near = near.where("n <> coalesce(self, -1)").withColumn("place", F.col("n") - F.when(F.col("self") < F.col("n"), 1).otherwise(0))
    near = cut(near.where(F.col("place") <= positives).select("anchor", "anchor_id", "copies", "place", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")))

    windows = near.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("place", "positive_score"))).alias("w"))
    windows = windows.select("anchor", F.col("w.place").alias("places"), F.col("w.positive_score").alias("scores"))
    asked = cut(anchors.select("anchor", "label", "v").join(windows, "anchor"))

    def second(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        heaps, ids, labels = Heaps(negatives), right["vec_id"].to_numpy(), right["label"].to_numpy()
        if len(left) and len(right):
            own, bounds = left["label"].to_numpy(), [list(zip(p, s)) for p, s in zip(left["places"], left["scores"])]
            for i, scores, j in _tiles(left, right):
                there, kinds = ids[j : j + TILE], labels[j : j + TILE]
                for r, row in enumerate(scores):
                    other = kinds != own[i + r]
                    for place, score in bounds[i + r]:
                        at = np.flatnonzero((100 * row >= low * score) & (100 * row <= high * score) & other)
                        if len(at):
                            heaps.add((i + r, place), row[at], there[at])
        names = left["anchor"].to_list()
        out = pd.DataFrame([(names[k], p, s, i) for (k, p), s, i in heaps.rows()], columns=["anchor", "place", "score", "vec_id"])
        release()
        return out

    whole = sizes.agg(F.sum("n_a")).first()[0] or 0, vectors.count()
    whole = anchors.sparkSession.createDataFrame([tuple(max(1, -(-n // e)) for n, e in zip(whole, blocks))], "a_blocks int, c_blocks int")
    a, c = _pairs(asked, vectors, whole, [])
    far = a.groupBy("a", "c").cogroup(c.groupBy("a", "c")).applyInPandas(second, "anchor string, place int, score long, vec_id long")
    far = far.withColumn("rank", F.row_number().over(Window.partitionBy("anchor", "place").orderBy(*order))).where(F.col("rank") <= negatives)
    out = far.join(near, ["anchor", "place"]).withColumn("copy", F.explode(F.expr("sequence(1L, copies)")))
    return out.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives for the rows whose vec_id is divisible by 100; a label is raised by one (mod 10) where vec_id is divisible by 7."""
    rows = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = integer_vectors(rows.withColumn("label", label))
    return mine(vectors, vectors.where("vec_id % 100 = 0"))


SQL = """
with vectors as (
  select row_number() over () as r, vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
    list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as v
  from embeddings
  where vec_id is not null and label is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scored as (
  select a.r as a, a.vec_id as anchor_id, c.vec_id, c.label <> a.label as other,
    list_sum(list_transform(list_zip(a.v, c.v), lambda z: z[1] * z[2]))::bigint as score
  from vectors a, vectors c where a.vec_id % 100 = 0 and a.r <> c.r),
positives as (
  select a, anchor_id, vec_id as positive_id, score, row_number() over (partition by a order by score desc, vec_id) as place
  from scored where not other),
negatives as (
  select p.a, p.place, p.anchor_id, p.positive_id, p.score as positive_score, s.vec_id as negative_id, s.score as negative_score,
    row_number() over (partition by p.a, p.place order by s.score desc, s.vec_id) as rank
  from positives p join scored s on s.a = p.a and s.other and 100 * s.score between 30 * p.score and 90 * p.score
  where p.place <= 5)
select anchor_id, positive_id, rank::int as rank, negative_id, positive_score, negative_score from negatives where rank <= 10
"""
