"""SimHash fingerprints and near-duplicate groups by a binary trie self-join.

Fingerprints. A text's A-Z are lower-cased, its words are `[^\\x20\\x09-\\x0D]+`, its shingles are runs of three
words joined by a space (fewer words: the whole sequence), repeats included. A shingle's hash is XXH64 with seed
42 of its UTF-8 bytes. A bit is 1 if it is set in more than half of the hashes. A text that is null, empty or all
white space has fingerprint zero and links like any other.

Links. Two fingerprints link if at most `budget` bits differ. Distinct fingerprints only are compared: copies
share one. Of budget + 1 equal blocks of the 64 bits two linked fingerprints agree in one at least, so each
fingerprint goes under budget + 1 roots, one for each block, and only a root's own leaves are joined: the trie's
first levels are then an equality, which Spark's shuffle deals out. Below a root the trie is joined with itself
level by level: a pair of nodes stands for two ranges of the sorted fingerprints, each level adds the differing
bit, and a pair whose differing bits exceed the budget is pruned with everything below it. A root with more leaves
than `leaves` is dealt into several tries by hash, and every pair of those is joined in a task of its own, so no
task holds an unbounded group. Each task reports the links it found as a spanning forest, not as all pairs.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelantern.llm.common import bucket, cut, dealt, release, table, unhex_long
from pagelantern.llm.components import components

BITS = 64


def fingerprint(text: str | None, words: int = 3) -> int:
    """The 64-bit SimHash of a text, unsigned."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return 0
    if len(parts) <= words:
        return xxhash.xxh64_intdigest(b" ".join(parts), 42)
    whole, hash_of = b" ".join(parts), xxhash.xxh64_intdigest
    ends = np.cumsum([len(p) + 1 for p in parts])
    starts = [0, *ends[: len(parts) - words].tolist()]
    stops = (ends[words - 1 :] - 1).tolist()
    hashes = np.array([hash_of(whole[i:j], 42) for i, j in zip(starts, stops)], dtype="<u8")
    ones = np.zeros(BITS, dtype=np.int64)
    for k in range(0, len(hashes), 65536):
        ones += np.unpackbits(hashes[k : k + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits((2 * ones > len(hashes)).astype(np.uint8), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long, for every row of docs."""

    def of(batches):
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "fp": np.array([fingerprint(t) for t in b["text"]], dtype=np.uint64).view(np.int64)})
        release()

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInPandas(of, f"doc_id {kind}, fp long")


def join_tries(fps: np.ndarray, left: np.ndarray, right: np.ndarray, budget: int, bits: int, chunk: int = 1 << 17):
    """Yields (i, j) arrays of the linked leaves of pairs of tries.

    fps: uint64, ascending inside each trie, of which the low `bits` bits differ inside a trie. left, right: (n, 2)
    ranges of fps, the n pairs of tries to join; equal ranges join a trie with itself. At most about `chunk` node
    pairs are expanded at a time; what remains waits on a stack, so memory does not grow with the pairs.
    """
    same = (left == right).all(1)
    stack = [(bits, left[:, 0], left[:, 1], right[:, 0], right[:, 1], np.zeros(len(left), dtype=np.int8), same)]
    while stack:
        depth, a0, a1, b0, b1, errs, same = stack.pop()
        if len(a0) > chunk:
            half = len(a0) // 2
            stack += [(depth, *(x[half:] for x in (a0, a1, b0, b1, errs, same))), (depth, *(x[:half] for x in (a0, a1, b0, b1, errs, same)))]
            continue
        small = (a1 - a0) * (b1 - b0) <= 16
        if small.any():  # few leaves: compare them at once
            yield from _leaves(fps, *(x[small] for x in (a0, a1, b0, b1, same)), budget, bits)
            a0, a1, b0, b1, errs, same = (x[~small] for x in (a0, a1, b0, b1, errs, same))
        if not len(a0):
            continue
        depth -= 1
        am, bm = _split(fps, a0, a1, depth), _split(fps, b0, b1, depth)
        kids = [(a0, am, b0, bm, 0, same), (am, a1, bm, b1, 0, same), (a0, am, bm, b1, 1, np.zeros_like(same))]
        kids.append((am[~same], a1[~same], b0[~same], bm[~same], 1, np.zeros((~same).sum(), dtype=bool)))
        rows = []
        for k, (p, q, r, s, more, again) in enumerate(kids):
            e = (errs[~same] if k == 3 else errs) + np.int8(more)
            keep = (q > p) & (s > r) & (e <= budget) & ~(again & (q - p < 2))
            rows.append([x[keep] for x in (p, q, r, s, e, again)])
        nxt = [np.concatenate(x) for x in zip(*rows)]
        if len(nxt[0]):
            stack.append((depth, *nxt))


def _split(fps, lo, hi, depth):
    """For each range of leaves that agree above bit `depth`, where that bit turns from 0 to 1."""
    bit, lo, hi = np.uint64(1 << depth), lo.copy(), hi.copy()
    while (open_ := lo < hi).any():
        mid = (lo + hi) >> 1
        one = (fps[np.minimum(mid, len(fps) - 1)] & bit) > 0
        hi = np.where(open_ & one, mid, hi)
        lo = np.where(open_ & ~one, mid + 1, lo)
    return lo


def _leaves(fps, a0, a1, b0, b1, same, budget, bits):
    n, m = a1 - a0, b1 - b0
    total = n * m
    at = np.repeat(np.arange(len(n)), total)
    k = np.arange(total.sum()) - np.repeat(np.cumsum(total) - total, total)
    i, j = a0[at] + k // m[at], b0[at] + k % m[at]
    ok = (~same[at] | (i < j)) & (np.bitwise_count(fps[i] ^ fps[j]) <= budget)
    yield i[ok], j[ok]


def forest(n: int, pairs) -> np.ndarray:
    """For each of n vertices the smallest vertex that the pairs of arrays (i, j) connect it with."""
    root = np.arange(n)
    for i, j in pairs:
        while True:
            ri, rj = root[i], root[j]
            differ = ri != rj
            if not differ.any():
                break
            i, j, ri, rj = i[differ], j[differ], ri[differ], rj[differ]
            np.minimum.at(root, np.maximum(ri, rj), np.minimum(ri, rj))
            while (nxt := root[root]).tobytes() != root.tobytes():
                root = nxt
    return root


def trie_links(classes: DataFrame, budget: int = 3, leaves: int = 4096) -> DataFrame:
    """Edges a, b (class ids) that connect all classes whose fingerprints differ in at most `budget` bits.

    classes: fp (distinct) and rep, a class id. The edges are a spanning forest of each task's links.
    """
    width, n = BITS // (budget + 1), classes.count()
    turned = lambda k: F.expr(f"fp" if not k else f"(shiftleft(fp, {k * width}) | shiftrightunsigned(fp, {BITS - k * width}))")
    rows = classes.select("rep", F.explode(F.array(*(F.struct(F.lit(k).alias("turn"), turned(k).alias("fp")) for k in range(budget + 1)))).alias("x"))
    rows = rows.select("rep", "x.*").withColumn("root", F.expr(f"shiftrightunsigned(fp, {BITS - width})"))
    crowded = rows.groupBy("turn", "root").count().where(F.col("count") > leaves)
    crowded = cut(crowded.select("turn", "root", F.ceil(F.col("count") / leaves).cast("int").alias("tries")))
    rows = rows.join(crowded, ["turn", "root"], "left").withColumn("tries", F.coalesce("tries", F.lit(1)))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("fp"), F.col("tries")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tries") - 1)))
    rows = rows.withColumn("lo", F.least("own", "other")).withColumn("hi", F.greatest("own", "other"))
    rows = rows.withColumn("task", bucket(dealt(n * (budget + 1), 2 * leaves), "turn", "root", "lo", "hi"))

    def join(part: pd.DataFrame) -> pd.DataFrame:
        keys = part[["turn", "root", "lo", "hi", "own"]].to_numpy()
        fps = part["fp"].to_numpy().view(np.uint64)
        order = np.lexsort((fps, *keys.T[::-1]))
        keys, fps, reps = keys[order], fps[order], part["rep"].to_numpy()[order]
        new = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(1)]) if len(keys) else np.zeros(0, int)
        spans = np.c_[new, np.r_[new[1:], len(keys)]]
        heads = keys[new]
        alone = heads[:, 2] == heads[:, 3]
        first = np.flatnonzero(~alone[:-1] & (heads[:-1, :4] == heads[1:, :4]).all(1)) if len(heads) > 1 else np.zeros(0, int)
        left, right = np.r_[spans[alone], spans[first]], np.r_[spans[alone], spans[first + 1]]
        root = forest(len(fps), join_tries(fps, left, right, budget, BITS - width))
        linked = np.flatnonzero(root != np.arange(len(root)))
        return pd.DataFrame({"a": reps[linked], "b": reps[root[linked]]})

    return rows.select("task", "turn", "root", "lo", "hi", "own", "fp", "rep").groupBy("task").applyInPandas(join, "a long, b long")


def simhash_groups(docs: DataFrame, budget: int = 3, leaves: int = 4096) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id for every row of docs.

    component_id is the smallest doc_id that links of at most `budget` bits reach, the document's own included.
    Extra columns are ignored. A row whose doc_id is null takes part like any other: links lead through it, and it gets its
    group's component_id, null if the group has no doc_id at all. An empty table gives no rows.
    """
    prints = cut(fingerprints(docs))
    classes = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("first")))  # a class is its fingerprint, whatever its ids
    linked = components(trie_links(classes.select("fp", F.col("fp").alias("rep")), budget, leaves))
    groups = cut(classes.join(linked, classes.fp == linked.v, "left").select("fp", "first", F.coalesce("c", "fp").alias("group")))
    smallest = groups.groupBy("group").agg(F.min("first").alias("component_id"))
    groups = groups.join(smallest, "group").select("fp", "component_id")
    return prints.join(groups, "fp", "left").select("doc_id", unhex_long("fp").alias("fingerprint"), "component_id")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash groups of the whole documents table."""
    return simhash_groups(table(spark, sf_dir, "documents"))
