"""Language ID by bit-sliced Bloom filters of character n-grams.

Learning. N-grams of 1 to `ORDERS` letters, word ends included, are counted for each language over a sample of
labelled documents, at most about `sample` of each language, chosen by a hash of the id. An n-gram belongs to a
language if its rate there is at least `least_rate` and at least `near` times its highest rate in any language. As the
rates of an order add up to 1, a language has at most 1 / least_rate n-grams of an order: that bounds what is collected
and broadcast, whatever the size of the corpus.

The filter is an array of bit masks, a bit for each language: an n-gram sets its languages' bits at `HASHES`
places, and the AND of the masks at its places has the bits of all languages that contain it, or seem to. For
a document the masks of all its n-grams are counted for each language; the share that a language would get by
false positives alone, from how full its slice is, is taken off, and the largest corrected share decides.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

from pagelantern.llm.common import added, release, table

ORDERS, HASHES = 5, 4
SLICE = 1 << 18
UNKNOWN = "und"
STEPS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)


@lru_cache(1)
def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)


def code_points(text: str | None) -> np.ndarray:
    """The letters of a text in lower case as code points, with one 0 for what is between words and at both ends; empty without letters."""
    codes = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    is_letter = letters()[codes]
    if not is_letter.any():
        return np.empty(0, np.uint32)
    codes = np.r_[np.uint32(0), np.where(is_letter, codes, np.uint32(0)), np.uint32(0)]
    return codes[np.r_[True, (codes[1:] > 0) | (codes[:-1] > 0)]]


def grams(text: str | None, each: int = SLICE) -> Iterator[list[np.ndarray]]:
    """For each slice of `each` places of a text, for each order the hashes of the n-grams that start there, repeats included.

    A word's ends count as letters. Slices overlap by what an n-gram spans, so they hold each n-gram once, and memory
    beyond the text's own code points is that of a slice, however long the text is.
    """
    whole = code_points(text)
    for first in range(0, len(whole), each):
        codes = whole[first : first + each + ORDERS - 1].astype(np.uint64)
        gaps = np.r_[0, np.cumsum(codes == 0)]
        out, h = [], np.zeros(len(codes), np.uint64)
        with np.errstate(over="ignore"):
            for n in range(1, ORDERS + 1):
                h = h[: max(0, len(codes) - n + 1)] + (codes[n - 1 :] + np.uint64(1)) * STEPS[n - 1]
                inside = gaps[n - 1 : len(codes)] - gaps[1 : len(codes) - n + 2] if n > 2 else np.zeros(len(h), int)
                ok = (inside == 0) & (codes[: len(h)] > 0) if n == 1 else inside == 0
                own = ok[:each]
                x = (h[:each][own] ^ np.uint64(n)) * STEPS[0]
                x = (x ^ (x >> np.uint64(29))) * STEPS[1]
                out.append(x ^ (x >> np.uint64(32)))
        yield out


class LanguageFilter:
    """Bit-sliced Bloom filters of the languages' n-grams."""

    def __init__(self, languages: list[str], hashes: np.ndarray, owners: np.ndarray):
        """hashes[i] is an n-gram of languages[owners[i]]."""
        self.languages, words = languages, max(1, -(-len(languages) // 64))
        self.bits = max(10, int(np.ceil(np.log2(max(1, len(np.unique(hashes))) * 10))))
        self.masks = np.zeros((1 << self.bits, words), dtype=np.uint64)
        bit = np.left_shift(np.uint64(1), (owners % 64).astype(np.uint64))
        for places in self._places(hashes):
            np.bitwise_or.at(self.masks, (places, owners // 64), bit)
        full = np.array([np.count_nonzero(self.masks[:, i // 64] >> np.uint64(i % 64) & np.uint64(1)) for i in range(len(languages))])
        self.false = (full / (1 << self.bits)) ** HASHES

    def _places(self, hashes: np.ndarray):
        step, at = (hashes >> np.uint64(32)) | np.uint64(1), hashes
        with np.errstate(over="ignore"):
            for _ in range(HASHES):
                yield at & np.uint64((1 << self.bits) - 1)
                at = at + step

    def shares(self, text: str | None) -> np.ndarray | None:
        """For each language the corrected share of the text's n-grams; None without letters."""
        total, counts = 0, np.zeros(len(self.languages), dtype=np.int64)
        for part in grams(text):
            hashes, found = np.concatenate(part), None
            for places in self._places(hashes):
                masks = self.masks[places]
                found = masks if found is None else found & masks
            total += len(hashes)
            for i in range(len(self.languages)):
                counts[i] += np.count_nonzero(found[:, i // 64] >> np.uint64(i % 64) & np.uint64(1))
        return np.maximum(0, (counts / total - self.false) / (1 - self.false)) if total else None

    def predict(self, text: str | None) -> tuple[str, float]:
        shares = self.shares(text) if self.languages else None
        if shares is None:
            return UNKNOWN, 0.0
        best, total = int(shares.argmax()), shares.sum()
        return self.languages[best], float(shares[best] / total) if total > 0 else 0.0


def learn(labelled: DataFrame, sample: int = 4000, least_rate: float = 2e-5, near: float = 0.5, most: int = 2_500_000) -> LanguageFilter:
    """A filter from labelled (doc_id, text, lang). Rows with a null id, text or lang are left out.

    With many languages least_rate is raised so that the n-grams of all of them, which the driver collects, are `most` at most.

    Languages are ordered by their number of documents, then by name; the first of equals wins a tie.
    """
    labelled = labelled.select("doc_id", "text", "lang").where("doc_id is not null and text is not null and lang is not null")
    sizes = sorted(((r["lang"], r["count"]) for r in labelled.groupBy("lang").count().collect()), key=lambda x: (-x[1], x[0]))
    names = [lang for lang, _ in sizes]
    if not names:
        return LanguageFilter([], np.empty(0, np.uint64), np.empty(0, np.int64))
    least_rate = max(least_rate, len(names) * ORDERS / most)
    part = F.create_map(*(F.lit(x) for lang, n in sizes for x in (lang, min(1.0, sample / n))))
    chosen = labelled.where(F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 20)) < F.try_element_at(part, F.col("lang")) * (1 << 20))

    def count(batches):
        held: dict[str, list[list[np.ndarray]]] = {}
        size: dict[str, int] = {}
        for b in batches:
            for lang, text in zip(b["lang"], b["text"]):
                for part in grams(text):
                    held.setdefault(lang, []).append(part)
                    size[lang] = size.get(lang, 0) + len(part[0])
                    if size[lang] >= 500_000:  # letters, of about 40 bytes of hashes each
                        yield summed(lang, held.pop(lang))
                        size[lang] = 0
        for lang, rows in held.items():
            yield summed(lang, rows)
        held.clear()
        release()

    def summed(lang, rows) -> pd.DataFrame:
        out = []
        for n in range(ORDERS):
            h, c = np.unique(np.concatenate([r[n] for r in rows]), return_counts=True)
            out.append(pd.DataFrame({"lang": lang, "n": n, "gram": h.view(np.int64), "seen": c}))
        return pd.concat(out)

    seen = chosen.mapInPandas(count, "lang string, n int, gram long, seen long").groupBy("lang", "n", "gram").agg(F.sum("seen").alias("seen"))
    seen = seen.persist()
    whole = seen.groupBy("lang", "n").agg(F.sum("seen").alias("all"))
    rates = seen.join(F.broadcast(whole), ["lang", "n"]).select("lang", "n", "gram", (F.col("seen") / F.col("all")).alias("rate")).where(F.col("rate") >= least_rate)
    top = rates.groupBy("n", "gram").agg(F.max("rate").alias("top"), F.collect_list(F.struct("lang", "rate")).alias("x"))
    kept = top.select("gram", F.transform(F.filter("x", lambda x: x["rate"] >= near * F.col("top")), lambda x: x["lang"]).alias("langs")).toPandas()
    seen.unpersist()
    index = {lang: i for i, lang in enumerate(names)}
    hashes = np.repeat(kept["gram"].to_numpy(np.int64).view(np.uint64), kept["langs"].map(len).to_numpy(np.int64))
    owners = np.array([index[x] for langs in kept["langs"] for x in langs], dtype=np.int64)
    return LanguageFilter(names, hashes, owners)


def identify(docs: DataFrame, model: LanguageFilter) -> DataFrame:
    """docs with lang_pred and score, from the whole text alone.

    lang_pred is a learned language, or `und` with score 0 if the text is null or has no letter (or nothing was
    learned). score is the winner's part of all corrected shares. Other columns, nulls and repeated rows stay.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def of(texts):
        return zip(*(sent.value.predict(t) for t in texts))

    return added(docs, "text", of, {"lang_pred": StringType(), "score": DoubleType()})


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from those whose crc32(doc_id) mod 3 is not 1."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    fold = F.crc32(F.col("doc_id").cast("string")) % 3
    model = learn(docs.where(fold != 1))
    held = docs.select("doc_id", F.coalesce(fold == 1, F.lit(False)).alias("held_out"), "text")
    return identify(held, model).drop("text")
