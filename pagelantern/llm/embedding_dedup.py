"""Near-duplicate vectors by sorted projection passes.

A pass hashes every vector with `BITS` random hyperplanes, concatenates the sign bits and orders all vectors by
them (a range shuffle). A vector is compared with the `window` vectors before it in this order, by cosine in double
precision; pairs at or above the threshold are links. The links of all passes are united and their connected
components taken. Two vectors at the threshold share their first d bits, their cell, with probability
(1 - angle / pi) ** d. d = log2(vectors / window) bits, rounded up, leave about a window of evenly spread vectors, so
the number of passes follows from the number of vectors and the `miss` that is accepted for a pair: about 20 passes
for 50,000 vectors, 100 for a billion.

The miss must not depend on how the vectors lie. A cell of at most window + 1 vectors is compared in full by the
windows. Cells with more are counted, and all pairs inside each are compared in blocks; where the cells of all passes
overlap so much that this takes more products than all pairs of the vectors in them, those are compared once instead.
So a pair that shares its cell in any pass is compared, in a dense cloud of vectors too.

Links exist inside components only, so the windows need to find enough links to connect a group, not all of
them: afterwards each component is compared in full, in blocks of about `block` vectors, every pair of blocks in a
task of its own, which returns counts and no pairs. Exact copies are compared once and counted with their number.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelantern.llm.common import bucket, cut, dealt, table
from pagelantern.llm.components import components
from pagelantern.llm.simhash import forest

BITS = 62
USABLE = """vec_id is not null and embedding is not null and size(embedding) > 0
 and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('Infinity'))
 and exists(embedding, x -> x <> 0)"""


def cell_bits(vectors: int, window: int) -> int:
    """Leading bits of a key that name its cell: so many that an even spread leaves a window of vectors or fewer."""
    return min(BITS, max(0, math.ceil(math.log2(max(vectors, 1) / window))))


def passes_for(vectors: int, threshold: float, window: int, miss: float) -> int:
    """Passes after which a pair at the threshold was in no common cell with probability `miss` at most."""
    together = (1 - math.acos(threshold) / math.pi) ** cell_bits(vectors, window)
    return 1 if together >= 1 else math.ceil(math.log(miss) / math.log1p(-together))


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1, in double precision."""
    rows = rows.astype(np.float64)
    rows /= np.abs(rows).max(1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(1, keepdims=True))


def _matrix(blobs) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), dtype=np.float64).reshape(len(blobs), -1)


def _band(x: np.ndarray, new: int, window: int, threshold: float):
    """Yields the links (i, j) of rows from `new` on with the at most `window` rows before each."""
    for s in range(new, len(x), window):
        e, lo = min(len(x), s + window), max(0, s - window)
        i, j = np.nonzero(x[s:e] @ x[lo:e].T >= threshold)
        i, j = i + s, j + lo
        ok = (j < i) & (i - j <= window)
        yield i[ok], j[ok]


def _edges(x, ids, new, window, threshold) -> pd.DataFrame:
    root = forest(len(x), _band(x, new, window, threshold))
    at = np.flatnonzero(root != np.arange(len(x)))
    return pd.DataFrame({"a": ids[at], "b": ids[root[at]]})


def _keys(part: pd.DataFrame, dim: int, passes: int, planes: dict, seed: int):
    """Yields each pass with the keys of a batch's vectors of one length. planes: those made so far."""
    x = _matrix(part["x"])
    for p in range(passes):
        if (p, dim) not in planes:
            planes[p, dim] = np.random.default_rng([seed, p, dim]).standard_normal((dim, BITS))
        yield p, (x @ planes[p, dim] > 0) @ (1 << np.arange(BITS - 1, -1, -1, dtype=np.int64))


def window_links(classes: DataFrame, threshold: float, window: int, miss: float, seed: int) -> DataFrame:
    """Edges a, b (class ids) found in the windows of all passes. classes: rep, x (unit vector as bytes), dim."""
    n = classes.count()
    passes = passes_for(n, threshold, window, miss)

    def keyed(batches):
        planes = {}
        for b in batches:
            for dim, part in b.groupby("dim"):
                for p, key in _keys(part, dim, passes, planes, seed):
                    yield pd.DataFrame({"pass": p, "dim": dim, "key": key, "rep": part["rep"].to_numpy(), "x": part["x"].to_numpy()})

    def swept(batches):
        at, head, group, x, ids, blobs = TaskContext.get().partitionId(), 0, None, None, None, None
        for b in batches:
            for g, part in b.groupby(["pass", "dim"], sort=True):
                if g != group:
                    group, x, ids, blobs = g, np.empty((0, g[1])), np.empty(0, np.int64), np.empty(0, object)
                    head = 0
                new = len(x)
                x, ids, blobs = np.r_[x, _matrix(part["x"])], np.r_[ids, part["rep"].to_numpy()], np.r_[blobs, part["x"].to_numpy()]
                yield _edges(x, ids, new, window, threshold).assign(seam=-1, p=-1, dim=-1, at=0, x=None)
                if head < window:
                    yield _seam(at - 1, group, ids[new:][: window - head], blobs[new:][: window - head], head + window)
                    head += len(part)
                x, ids, blobs = x[-window:], ids[-window:], blobs[-window:]
        if group is not None:
            yield _seam(at, group, ids, blobs)

    def _seam(seam, group, ids, blobs, start=0):
        return pd.DataFrame({"a": ids, "b": ids, "seam": seam, "p": group[0], "dim": group[1], "at": np.arange(len(ids)) + start, "x": blobs})

    def seamed(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("at")
        new = int((part["at"] < window).sum())
        return _edges(_matrix(part["x"]), part["a"].to_numpy(), new, window, threshold) if 0 < new < len(part) else pd.DataFrame({"a": [], "b": []}, dtype="int64")

    order = ["pass", "dim", "key", "rep"]
    rows = classes.select("rep", "x", "dim").mapInPandas(keyed, "pass int, dim int, key long, rep long, x binary")
    rows = rows.repartitionByRange(dealt(n * passes, 20_000, 16), *order).sortWithinPartitions(*order)
    found = cut(rows.mapInPandas(swept, "a long, b long, seam int, p int, dim int, at int, x binary"))
    seams = found.where("seam >= 0").groupBy("seam", "p", "dim").applyInPandas(seamed, "a long, b long")
    return found.where("seam = -1 and x is null").select("a", "b").union(seams)


def blocked(members: DataFrame, block: int) -> DataFrame:
    """members (c, rep, x, dim, any others) once for every pair lo, hi of blocks of their group c that they belong to.

    own is the row's block, task the bucket in which a pair of blocks meets.
    """
    sizes = cut(members.groupBy("c").count())
    work = sizes.select(F.sum(F.col("count") * F.ceil(F.col("count") / block))).first()[0] or 0
    rows = members.join(sizes.select("c", F.ceil(F.col("count") / block).cast("int").alias("blocks")), "c")
    rows = rows.withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.withColumn("lo", F.least("own", "other")).withColumn("hi", F.greatest("own", "other"))
    return rows.withColumn("task", bucket(dealt(work, 2 * block), "c", "lo", "hi"))


def crowded_links(classes: DataFrame, threshold: float, window: int, miss: float, block: int, seed: int) -> DataFrame | None:
    """Edges a, b of the pairs that share a cell with more vectors than the windows compare in full; None without such cells."""
    n = classes.count()
    passes, shift = passes_for(n, threshold, window, miss), BITS - cell_bits(n, window)

    def counted(batches):
        planes = {}
        for b in batches:
            for dim, part in b.groupby("dim"):
                for p, key in _keys(part, dim, passes, planes, seed):
                    cell, size = np.unique(key >> shift, return_counts=True)
                    yield pd.DataFrame({"pass": p, "dim": dim, "cell": cell, "size": size})

    def celled(batches):
        planes = {}
        for b in batches:
            for dim, part in b.groupby("dim"):
                for p, key in _keys(part, dim, passes, planes, seed):
                    yield pd.DataFrame({"pass": p, "dim": dim, "cell": key >> shift, "rep": part["rep"].to_numpy()})

    source = classes.select("rep", "x", "dim")
    sizes = source.mapInPandas(counted, "pass int, dim int, cell long, size long").groupBy("pass", "dim", "cell").agg(F.sum("size").alias("size"))
    crowded = cut(sizes.where(F.col("size") > window + 1))
    by_cell = crowded.select(F.sum(F.col("size").cast("double") * F.col("size"))).first()[0]
    if by_cell is None:
        return None
    held = source.mapInPandas(celled, "pass int, dim int, cell long, rep long").join(crowded.drop("size"), ["pass", "dim", "cell"])
    held = cut(held.select(F.xxhash64("pass", "dim", "cell").alias("c"), "rep", "dim"))
    everyone = cut(held.select("rep", "dim").distinct())
    at_once = everyone.groupBy("dim").count().select(F.sum(F.col("count").cast("double") * F.col("count"))).first()[0]
    chosen = everyone.select(F.col("dim").cast("long").alias("c"), "rep") if at_once <= by_cell else held.select("c", "rep")
    rows = blocked(chosen.join(classes.select("rep", "x", "dim"), "rep"), block)

    def pairs(part: pd.DataFrame) -> pd.DataFrame:
        out = []
        for (_, lo, hi, _), g in part.groupby(["c", "lo", "hi", "dim"]):
            own = (g["own"] == lo).to_numpy()
            at, to = np.flatnonzero(own), np.flatnonzero(~own) if lo != hi else np.flatnonzero(own)
            x, ids = _matrix(g["x"]), g["rep"].to_numpy()

            def near():
                for s in range(0, len(at), 1024):
                    i, j = np.nonzero(x[at[s : s + 1024]] @ x[to].T >= threshold)
                    yield at[s + i], to[j]

            root = forest(len(g), near())
            linked = np.flatnonzero(root != np.arange(len(g)))
            out.append(pd.DataFrame({"a": ids[linked], "b": ids[root[linked]]}))
        return pd.concat(out) if out else pd.DataFrame({"a": [], "b": []}, dtype="int64")

    return rows.select("task", "c", "lo", "hi", "own", "rep", "x", "dim").groupBy("task").applyInPandas(pairs, "a long, b long")


def full_links(members: DataFrame, threshold: float, block: int) -> DataFrame:
    """rep and links, the other vectors that a class links with. members: c (component), rep, n (copies), x, dim."""
    rows = blocked(members, block)

    def count(part: pd.DataFrame) -> pd.DataFrame:
        out = []
        for (_, lo, hi, _), g in part.groupby(["c", "lo", "hi", "dim"]):
            own = (g["own"] == lo).to_numpy()
            a, b = g[own], g[~own] if lo != hi else g[own]
            if not len(a) or not len(b):
                continue
            near = _matrix(a["x"]) @ _matrix(b["x"]).T >= threshold
            if lo == hi:
                np.fill_diagonal(near, False)
            else:
                out.append(pd.DataFrame({"rep": b["rep"], "links": near.T.astype(np.int64) @ a["n"].to_numpy()}))
            out.append(pd.DataFrame({"rep": a["rep"], "links": near.astype(np.int64) @ b["n"].to_numpy()}))
        return pd.concat(out) if out else pd.DataFrame({"rep": [], "links": []}, dtype="int64")

    rows = rows.select("task", "c", "lo", "hi", "own", "rep", "n", "x", "dim")
    return rows.groupBy("task").applyInPandas(count, "rep long, links long").groupBy("rep").agg(F.sum("links").alias("links"))


def near_vectors(vectors: DataFrame, threshold: float = 0.95, window: int = 256, miss: float = 1e-5, block: int = 1024, seed: int = 11) -> DataFrame:
    """vec_id, n_links, component_id and kept for every row of vectors (vec_id, embedding).

    n_links counts the other rows whose cosine with this one is at least the threshold. component_id is the
    smallest vec_id that links reach; kept says that it is the row's own. A vector that is null, empty, zero or holds
    null or non-finite components, or whose vec_id is null, links with nothing; vectors of different lengths do not
    link. Repeated rows count as vectors of their own. Extra columns are ignored; an empty table gives no rows.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    ready = rows.where(USABLE).withColumns({"h": F.xxhash64("embedding"), "h2": F.xxhash64(F.lit(1), "embedding")})
    classes = ready.groupBy("h", "h2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"), F.first("embedding").alias("embedding"))

    def scaled(batches):
        for b in batches:
            dims = b["embedding"].map(len)
            blobs = pd.Series(index=b.index, dtype=object)
            for _, g in b.groupby(dims):
                for i, row in zip(g.index, unit(np.stack(g["embedding"].to_numpy()))):
                    blobs[i] = row.tobytes()
            yield b.assign(x=blobs, dim=dims)[["h", "h2", "rep", "n", "x", "dim"]]

    classes = cut(classes.mapInPandas(scaled, "h long, h2 long, rep long, n long, x binary, dim int"))
    edges = window_links(classes, threshold, window, miss, seed)
    crowded = crowded_links(classes, threshold, window, miss, block, seed)
    groups = components(edges if crowded is None else edges.union(crowded))
    members = classes.join(groups, classes.rep == groups.v).select("c", "rep", "n", "x", "dim")
    linked = cut(full_links(members, threshold, block))
    found = classes.drop("x", "dim").join(groups, classes.rep == groups.v, "left").drop("v")
    found = found.join(linked, "rep", "left").select("h", "h2", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("c", "rep").alias("c"))
    keyed = rows.select("vec_id", *(F.when(F.expr(USABLE), h).alias(k) for k, h in (("h", F.xxhash64("embedding")), ("h2", F.xxhash64(F.lit(1), "embedding")))))
    out = keyed.join(found, ["h", "h2"], "left").select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("c", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate vectors of the whole embeddings table."""
    return near_vectors(table(spark, sf_dir, "embeddings"))
