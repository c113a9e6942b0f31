"""Document fingerprints: bottom-k sketches of word shingle hashes, with DataFrame functions only.

A sketch is the ascending array of the k smallest distinct 64-bit hashes of a text's five-word shingles (a text of
fewer words has one shingle, a text without words none). Sketches merge: that of the shingles of several parts
is the bottom k of the parts' sketches together. They estimate resemblance, containment and the number of
distinct shingles; up to k distinct shingles all three are exact.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagelantern.llm.common import table

K, WORDS = 64, 5


def sketch(text: Column, k: int = K, words: int = WORDS) -> Column:
    """The sketch of a text; null counts as empty."""
    parts = F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")

    def hashes(w):
        long = F.transform(F.sequence(F.lit(0), F.size(w) - words), lambda i: F.xxhash64(*(F.get(w, i + j) for j in range(words))))
        return F.when(F.size(w) == 0, F.array().cast("array<bigint>")).when(F.size(w) < words, F.array(F.xxhash64(F.array_join(w, " ")))).otherwise(long)

    # the words are bound as a lambda variable, so that they are split once and not once a shingle
    return F.slice(F.sort_array(F.array_distinct(F.element_at(F.transform(F.array(parts), hashes), 1))), 1, k)


def merged(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of two parts' shingles together."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard likeness of two texts' shingles; 1 if neither has any."""
    both = lambda u: F.size(F.array_intersect(F.array_intersect(u, a), b)) / F.size(u)
    return F.element_at(F.transform(F.array(merged(a, b, k)), lambda u: F.when(F.size(u) == 0, 1.0).otherwise(both(u))), 1)


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles."""
    place = (F.element_at(a, k).cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / place)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b has too; 1 if a has none."""
    shared = resemblance(a, b, k) * distinct_shingles(merged(a, b, k), k)
    return F.when(F.size(a) == 0, 1.0).otherwise(F.least(F.lit(1.0), shared / distinct_shingles(a, k)))


def digits(a: Column) -> Column:
    """A sketch as hex digits, 16 for each hash."""
    return F.array_join(F.transform(a, lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")), "")


def _array(values, kind: str) -> Column:
    """A literal array: told as one text, which Spark reads once, when it plans (a cast of literals is constant, a lambda is not)."""
    told = ",".join("null" if v is None else str(v) for v in values)
    return F.split(F.lit(told), ",").try_cast(f"array<{kind}>") if values else F.array().cast(f"array<{kind}>")


def _below(x: Column, values: list) -> Column:
    """How many of the ascending values are below x: a binary search."""
    many, ascending = len(values), _array(values, "bigint")
    start = F.struct(F.lit(0).alias("lo"), F.lit(many).alias("hi"))

    def step(a, _):
        mid = F.floor((a["lo"] + a["hi"]) / 2).cast("int")
        up = F.get(ascending, mid) < x
        open_ = a["lo"] < a["hi"]
        return F.struct(F.when(open_ & up, mid + 1).otherwise(a["lo"]).alias("lo"), F.when(open_ & ~up, mid).otherwise(a["hi"]).alias("hi"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(max(1, many.bit_length() + 1))), start, step, lambda a: a["lo"])


def with_next(docs: DataFrame, each: int = 2000, most: int = 50_000, tie: list[str] | None = None) -> DataFrame:
    """docs (doc_id, and any columns) with next_<column> of the document next by descending doc_id, cyclically.

    Rows with equal ids follow each other by a hash of the columns `tie` (default: all); null ids come last. The ids are cut
    into ranges of about `each` rows (of more, if there were more than `most` ranges) at ids of the table, found by
    approximate percentiles; an id that has several percentiles, and the null ids, are cut further by the hash. A
    row finds its range by binary search. The first row of a range is also given to the range that it follows, so one
    window for each range, and one shuffle, suffice. Of the ranges the driver knows bounds and first rows' ids and hashes, which
    the plan holds as constants, so a row's cost does not follow the number of ranges.
    """
    tie = tie or [c for c in docs.columns if c != "doc_id"]
    docs = docs.withColumn("hash_", F.xxhash64("doc_id", *tie))
    n, nulls = docs.agg(F.count("*"), F.count_if(F.col("doc_id").isNull())).first()
    many = max(1, min(most, -(-(n - nulls) // each)))
    edges = []
    if many > 1:
        shares = ",".join(f"{(i + 1) / many:.9f}" for i in range(many - 1))
        edges = docs.agg(F.expr(f"percentile_approx(doc_id, array({shares}), {10 * many + 1000})")).first()[0] or []
    seen = Counter(edges)
    ids, start, parts, at = sorted(seen), [], [], max(1, min(most, -(-nulls // each)))
    for i in ids:  # ids over the last bound and up to i; an id with several percentiles has ranges of its own
        start.append(at)
        parts.append(seen[i] if seen[i] > 1 else 0)
        at += 1 + parts[-1]
    place = _below(F.col("doc_id"), ids)
    spread = lambda k: F.least(k - 1, F.floor((F.col("hash_") / F.lit(2.0**64) + 0.5) * k)).cast("int")
    heavy = F.coalesce(F.get(_array(parts, "int"), F.col("place_")), F.lit(0))
    first = F.coalesce(F.get(_array(start, "int"), F.col("place_")), F.lit(at))
    is_edge = F.coalesce(F.get(_array(ids, "bigint"), F.col("place_")) == F.col("doc_id"), F.lit(False))
    own = F.when(F.col("doc_id").isNull(), spread(F.lit(max(1, min(most, -(-nulls // each)))))).when((heavy > 0) & is_edge, first + 1 + spread(heavy)).otherwise(first)
    docs = docs.withColumn("place_", place).withColumn("range_", own).drop("place_")
    tops = {r["range_"]: r["top"] for r in docs.groupBy("range_").agg(F.max(F.struct("doc_id", "hash_")).alias("top")).collect()}
    there = sorted(tops)
    after = dict(zip(there, [*there[1:], *there[:1]]))  # the range whose last row is followed by this range's first
    size = there[-1] + 1 if there else 0
    told = lambda f, kind: F.get(_array([f(r) if r in tops else None for r in range(size)], kind), F.col("range_"))
    is_top = F.col("hash_").eqNullSafe(told(lambda r: tops[r]["hash_"], "bigint")) & F.col("doc_id").eqNullSafe(told(lambda r: tops[r]["doc_id"], "bigint"))
    here = F.struct("range_", F.lit(False).alias("ghost_"))
    ghost = F.when(is_top, F.struct(told(after.__getitem__, "int").alias("range_"), F.lit(True).alias("ghost_")))
    columns = [c for c in docs.columns if c not in ("hash_", "range_")]
    dealt = docs.withColumn("at_", F.explode(F.array_compact(F.array(here, ghost)))).select(*columns, "hash_", "at_.*")
    order = Window.partitionBy("range_").orderBy("ghost_", F.desc_nulls_last("doc_id"), F.desc("hash_"))
    out = dealt.select(*columns, "ghost_", *(F.lead(c).over(order).alias(f"next_{c}") for c in columns))
    return out.where("not ghost_").drop("ghost_")


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts, and their likeness to these and to the next document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    docs = docs.withColumn("mark", sketch(F.col("text")))
    pairs = with_next(docs, tie=["text"]).withColumn("n", F.length("text")).withColumn("cut", F.floor(F.col("n") / 3).cast("int"))
    edited = F.concat(F.expr("substring(text, 1, n - cut)"), F.expr("substring(next_text, 1, cut)"))
    pairs = pairs.select("doc_id", "n", "mark", "next_mark", edited.alias("edited"))
    pairs = pairs.select("*", sketch(F.col("edited")).alias("edited_mark"))
    near = lambda other: F.element_at(F.transform(F.array(F.col(other)), lambda b: resemblance(F.col("mark"), b)), 1)
    return pairs.select(
        "doc_id",
        F.col("n").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        digits(F.col("mark")).alias("fingerprint"),
        digits(F.col("edited_mark")).alias("edited_fingerprint"),
        near("edited_mark").alias("near_edited"),
        near("next_mark").alias("near_next"),
        distinct_shingles(F.col("mark")).alias("n_shingles"),
    )
