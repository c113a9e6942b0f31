"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages of `PASSAGE` code points, all of its text. A passage is encoded from its own characters alone:
how often each character, and each pair of neighbouring kinds of character (lower case, upper case, digit, mark, symbol,
...), occurs, and how much of it repeats. A layer of tanh units turns that into the passage's representation. Gated
attention, w . (tanh(V h) * sigmoid(U h)), weighs the passages; the weighted mean of their representations is the document's,
and one logistic unit scores it. Layer, gates and unit are learned together from labels of whole documents: no passage has
a label.

Weights are exponentials that are summed while slices of passages go by, so a long text takes the memory of a slice.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType

from pagelantern.llm.common import added, release, table

PASSAGE, SLICE, GRAM = 512, 1024, 8
KINDS, BINS = 11, 160
FEATURES = BINS + KINDS * KINDS + 3
PAD = 0


@lru_cache(1)
def kinds() -> np.ndarray:
    """The kind of each code point: 0 none, 1 lower case, 2 upper case, 3 other letter, 4 digit, 5 space, 6 line break, 7 sentence mark, 8 quote or bracket, 9 symbol, 10 other."""
    out = np.full(0x110000, 10, np.int64)
    text = [chr(i) for i in range(0x110000)]
    out[[i for i, c in enumerate(text) if c.isalpha()]] = 3
    out[[i for i, c in enumerate(text) if c.islower()]] = 1
    out[[i for i, c in enumerate(text) if c.isupper()]] = 2
    out[[i for i, c in enumerate(text) if c.isdigit()]] = 4
    out[[i for i, c in enumerate(text) if c.isspace()]] = 5
    for chars, kind in (("\n\r", 6), (".,;:!?", 7), ("\"'()[]{}", 8), ("#$%&*+-/<=>@\\^_`|~", 9)):
        out[[ord(c) for c in chars]] = kind
    out[PAD] = 0
    return out


def passages(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """All passages of the texts as rows of code points filled up with 0, and the text of each; an empty text has one empty passage."""
    rows, many = [], []
    for t in texts:
        codes = np.frombuffer((t or "").replace("\0", " ").encode("utf-32-le", "surrogatepass"), np.uint32)
        n = max(1, -(-len(codes) // PASSAGE))
        whole = np.zeros(n * PASSAGE, np.uint32)
        whole[: len(codes)] = codes
        rows.append(whole.reshape(n, PASSAGE))
        many.append(n)
    return np.concatenate(rows), np.repeat(np.arange(len(texts)), many)


def features(codes: np.ndarray) -> np.ndarray:
    """The features of each passage (row of code points): square roots of shares, which tame frequent characters."""
    n, kind = len(codes), kinds()[codes]
    length = np.maximum((codes > 0).sum(1), 1)
    row = np.arange(n)[:, None]
    char = np.where(codes < 128, codes, 128 + codes % 32).astype(np.int64)
    single = np.bincount((row * BINS + char).ravel(), minlength=n * BINS).reshape(n, BINS).astype(np.float32)
    single[:, PAD] = 0
    pairs = np.bincount((row * KINDS * KINDS + kind[:, :-1] * KINDS + kind[:, 1:]).ravel(), minlength=n * KINDS * KINDS).reshape(n, -1).astype(np.float32)
    pairs[:, :KINDS] = 0
    gram = np.zeros((n, PASSAGE - GRAM + 1), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(GRAM):
            gram = gram * np.uint64(0x9E3779B97F4A7C15) + codes[:, k : PASSAGE - GRAM + 1 + k]
    gram[codes[:, GRAM - 1 :] == 0] = 0  # it would reach over the end
    gram.sort(1)
    new = ((gram[:, 1:] != gram[:, :-1]) & (gram[:, 1:] > 0)).sum(1) + (gram[:, 0] > 0)
    grams = np.maximum(length - GRAM + 1, 1)
    spaces = (kind == 5).sum(1) + (kind == 6).sum(1)
    more = np.c_[new / grams, length / PASSAGE, np.log1p(length / (spaces + 1)) / 4]
    return np.c_[np.sqrt(single / length[:, None]), np.sqrt(pairs / length[:, None]), more].astype(np.float32)


class Attention:
    """Gated attention over encoded passages, and the score of their weighted mean."""

    SHAPES = {"w1": ("f", "d"), "b1": ("d",), "v": ("d", "g"), "bv": ("g",), "u": ("d", "g"), "bu": ("g",), "w": ("g",), "c": ("d",), "c0": ()}

    def __init__(self, mean: np.ndarray, scale: np.ndarray, units: int = 24, gates: int = 12, seed: int = 7):
        size, rng = {"f": len(mean), "d": units, "g": gates}, np.random.default_rng(seed)
        self.mean, self.scale = mean.astype(np.float32), scale.astype(np.float32)
        shapes = {k: tuple(size[x] for x in s) for k, s in self.SHAPES.items()}
        self.p = {k: (rng.normal(0, 1 / np.sqrt(s[0]), s) if len(s) > 1 else np.zeros(s)).astype(np.float64) for k, s in shapes.items()}

    def encode(self, x: np.ndarray):
        """Representations of passages and their attention before normalization, with the gates' two halves."""
        p = self.p
        h = np.tanh(((x - self.mean) / self.scale) @ p["w1"] + p["b1"])
        t, s = np.tanh(h @ p["v"] + p["bv"]), 1 / (1 + np.exp(-(h @ p["u"] + p["bu"])))
        return h, t, s, np.exp(np.clip((t * s) @ p["w"], -60, 60))

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """The score of each text, from all its passages."""
        codes, bag = passages(texts)
        weight, total = np.zeros(len(texts)), np.zeros((len(texts), len(self.p["c"])))
        for k in range(0, len(codes), SLICE):
            h, _, _, a = self.encode(features(codes[k : k + SLICE]))
            np.add.at(weight, bag[k : k + SLICE], a)
            np.add.at(total, bag[k : k + SLICE], a[:, None] * h)
        z = (total / weight[:, None]) @ self.p["c"] + self.p["c0"]
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))

    def gradient(self, x: np.ndarray, many: np.ndarray, y: np.ndarray):
        """Mean log loss of documents and its gradient. x: the documents' passages one after another; many: how many each has."""
        p, starts, bag = self.p, np.r_[0, np.cumsum(many)[:-1]], np.repeat(np.arange(len(many)), many)
        xs = (x - self.mean) / self.scale
        h, t, s, a = self.encode(x)
        a = a / np.add.reduceat(a, starts)[bag]
        z = np.add.reduceat(a[:, None] * h, starts)
        score = 1 / (1 + np.exp(-np.clip(z @ p["c"] + p["c0"], -500, 500)))
        loss = -np.mean(y * np.log(score + 1e-12) + (1 - y) * np.log(1 - score + 1e-12))
        dz = ((score - y) / len(y))[:, None] * p["c"]
        g = {"c": z.T @ ((score - y) / len(y)), "c0": np.mean(score - y)}
        da = (h * dz[bag]).sum(1)
        de = a * (da - np.add.reduceat(a * da, starts)[bag])
        g["w"] = (t * s).T @ de
        dt, ds = de[:, None] * p["w"] * s * (1 - t * t), de[:, None] * p["w"] * t * s * (1 - s)
        g |= {"v": h.T @ dt, "bv": dt.sum(0), "u": h.T @ ds, "bu": ds.sum(0)}
        dh = (a[:, None] * dz[bag] + dt @ p["v"].T + ds @ p["u"].T) * (1 - h * h)
        return loss, g | {"w1": xs.T @ dh, "b1": dh.sum(0)}


def fit(bags: list[np.ndarray], labels: np.ndarray, epochs: int = 14, batch: int = 128, rate: float = 0.01, decay: float = 1e-4, seed: int = 7) -> Attention:
    """An attention model fitted to documents (features of their passages) and labels 0 or 1 by Adam."""
    whole = np.concatenate(bags)
    model, rng = Attention(whole.mean(0), whole.std(0) + 0.02, seed=seed), np.random.default_rng(seed)
    first, second = ({k: np.zeros_like(v) for k, v in model.p.items()} for _ in range(2))
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(bags))
        for at in (order[k : k + batch] for k in range(0, len(order), batch)):
            _, g = model.gradient(np.concatenate([bags[i] for i in at]), np.array([len(bags[i]) for i in at]), labels[at])
            step += 1
            for k in model.p:
                d = g[k] + decay * model.p[k] * (k in ("w1", "v", "u", "c"))
                first[k], second[k] = 0.9 * first[k] + 0.1 * d, 0.999 * second[k] + 0.001 * d * d
                model.p[k] = model.p[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return model


def learn(docs: DataFrame, labels: DataFrame, sample: int = 3000, bag: int = 32) -> Attention | None:
    """A model from documents (doc_id, text) and labels (doc_id, quality); None without a labelled document.

    Labels other than 0 and 1, null ids and null labels are left out; a null text is an empty one. Of each label at most
    `sample` ids are drawn, by a hash, and of an id one row; of a document whose passages are more than `bag`, `bag` at
    even distances are learned from. So the driver gets at most 2 * sample * bag passages' features, whatever the corpus.
    """
    named = labels.where("doc_id is not null and quality in (0, 1)").select("doc_id", F.col("quality").cast("int").alias("quality")).distinct()
    sizes = {r["quality"]: r["count"] for r in named.groupBy("quality").count().collect()}
    share = lambda q: F.lit(min(1.0, 2 * sample / sizes.get(q, 1)))
    place = F.pmod(F.xxhash64("doc_id", F.lit("quality")), F.lit(1 << 30))
    named = named.withColumn("h", place).where(F.col("h") <= F.when(F.col("quality") == 0, share(0)).otherwise(share(1)) * (1 << 30))
    drawn = named.withColumn("n", F.row_number().over(Window.partitionBy("quality").orderBy("h", "doc_id"))).where(F.col("n") <= sample)
    ids = docs.sparkSession.createDataFrame([(r["doc_id"], r["quality"]) for r in drawn.collect()], "doc_id long, quality int")
    rows = docs.where("doc_id is not null").select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(ids), "doc_id")  # at most 2 * sample ids
    rows = rows.groupBy("doc_id", "quality").agg(F.min_by("text", F.struct(F.xxhash64("text"), F.length("text"))).alias("text"))

    def encoded(batches):
        for b in batches:
            out = []
            for t in b["text"]:
                codes, _ = passages([t])
                out.append(features(codes[np.unique(np.linspace(0, len(codes) - 1, min(bag, len(codes))).astype(np.int64))]).tobytes())
            yield b[["doc_id", "quality"]].assign(x=out)
        release()

    one = rows.mapInPandas(encoded, "doc_id long, quality int, x binary")
    got = one.orderBy("doc_id", "quality").toPandas()
    if not len(got):
        return None
    bags = [np.frombuffer(x, np.float32).reshape(-1, FEATURES) for x in got["x"]]
    return fit(bags, got["quality"].to_numpy(np.float64))


def score(docs: DataFrame, model: Attention | None) -> DataFrame:
    """docs with score (0 to 1, higher: label 1 likelier) and predicted (1 if score >= 0.5), from the whole text alone.

    A null text counts as empty; an empty text has one empty passage, and a score. Without a model all scores are 0.5. Other
    columns, nulls and repeated rows stay; columns named score or predicted are replaced.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def of(texts):
        s = sent.value.scores(texts) if sent.value and texts else np.full(len(texts), 0.5)
        return s, (s >= 0.5).astype(np.int32)

    return added(docs, "text", of, {"score": DoubleType(), "predicted": IntegerType()}, each=1 << 20)


def op12_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality score of every document, learned from labels of those whose crc32(doc_id) mod 3 is not 1."""
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    fold = F.crc32(F.col("doc_id").cast("string")) % 3
    model = learn(docs.where(fold != 1), labels.where(fold != 1))
    return score(docs.withColumn("held_out", F.coalesce(fold == 1, F.lit(False))), model).drop("text")
