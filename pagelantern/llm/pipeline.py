"""The stages of a training corpus, each an operator of this subpackage over all that the stage before kept.

A stage takes documents (doc_id, text, lang, source, n_chars, in any order; other columns are left out) and all but the last
return these columns. Null texts count as empty; rows without an id and rows that share one are documents of their own.
"""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from pagelantern.llm import bpe, language_id, mixing, secret_scan, simhash
from pagelantern.llm.common import added, cut, remove, shared_folder
from pagelantern.llm.components import components

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a language (null, empty, or no letter) and writes the others' predicted one into lang.

    The filter learns from rows that have an id, a text and a lang; without any such row all documents are dropped.
    """
    said = language_id.identify(docs.select(*COLUMNS), language_id.learn(docs))
    return said.where(F.col("lang_pred") != language_id.UNKNOWN).withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps exactly one document of each SimHash group: the one with the smallest id (null last), then row hash.

    Groups are those of the fingerprints, whatever the ids: documents without an id, or with the same one, whose texts
    do not link are in groups of their own and all stay. Texts without a word share fingerprint zero and are one group.
    """
    docs, nulls = docs.select(*COLUMNS), [F.col(c).isNull() for c in COLUMNS]  # nulls alone do not change a hash
    docs = docs.withColumns({"h": F.xxhash64(*COLUMNS, *nulls), "h2": F.xxhash64(F.lit(1), *COLUMNS, *nulls)})
    texts = docs.select("doc_id", "h", "h2", F.col("text").alias("fp"))

    def of(batch):
        return [np.array([simhash.fingerprint(t) for t in batch], dtype=np.uint64).view(np.int64).tolist()]

    prints = cut(added(texts, "fp", of, {"fp": LongType()}))
    classes = cut(prints.select("fp", F.col("fp").alias("rep")).distinct())
    linked = components(simhash.trie_links(classes))
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "h", "h2")).alias("first")
    kept = prints.join(linked, prints.fp == linked.v, "left").groupBy(F.coalesce("c", "fp").alias("group")).agg(first)
    kept = kept.select("first.h", "first.h2")
    return docs.join(kept, ["h", "h2"], "left_semi").dropDuplicates(["h", "h2"]).select(*COLUMNS)  # rows of equal hashes are copies


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces every secret in the texts, of the fixed patterns and of the field, by a mark; n_chars follows.

    Every row stays; a null text stays null, with null n_chars.
    """
    scanned = secret_scan.scan(docs.select(*COLUMNS), secret_scan.learn(docs.select(*COLUMNS)), mark="[secret]")
    return scanned.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or drops documents so that sources share the mix by the square roots of their sizes; shuffles them.

    Rows with equal ids draw equal counts, null ids as one id; a null source is a source; one without any text is left out.
    """
    return mixing.poisson_mix(docs.select(*COLUMNS)).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids (ids, n_tokens) in place of the texts; a null or empty text has no ids. Every row stays."""
    coded = bpe.encode(docs.select(*COLUMNS), bpe.tokenizer_path()).drop("text")
    return coded.withColumn("n_tokens", F.size("ids").cast("long"))


STAGES = [
    ("language_id", languages),
    ("simhash_near_dedup", near_duplicates),
    ("secret_scan", secrets),
    ("source_mixing", mix),
    ("bpe_encoding", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each written as Parquet to the shared folder and read again.

    A stage's files are removed when the next one's are written; the last one's stay, as the result reads them.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder, before = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}", None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            remove(spark, before)
        before = f"{folder}/{name}"
    return docs
