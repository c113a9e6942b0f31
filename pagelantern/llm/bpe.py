"""Byte-level BPE encoding and decoding by a prefix-sharing trie traversal.

A text is cut into words as byte-level BPE does. The distinct words of a batch, sorted, are the leaves of a trie in
depth-first order: going from one word to the next, only the nodes below their common prefix are new. A node's state
is the last token of the encoding of its prefix. It is the one token ending there that starts at the root, or whose
neighbour, the last token at the node where it starts, it may follow: no merge across their border would have come
before the merges that made them. So a node's encoding is that of an earlier node and one more token, and the
encoding of a shared prefix is computed once. The tokens that end at a node are found by a second trie, of
the vocabulary's tokens read backwards.

Most words of a text are cut at single spaces, so texts are cut there first, and only pieces that were not met before
into words. Pieces and words stay, with the bytes of their ids, in a cache for later batches of the same task. It is bounded
by bytes, and long pieces, of which texts without spaces consist, are not kept.
"""

from __future__ import annotations

import gc
import json
import re
import unicodedata
from array import array
from contextlib import contextmanager
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType

from pagelantern.llm.common import added, table

CACHED_BYTES, KEPT_CHARS = 96 << 20, 48  # words and pieces are kept up to so many bytes in all, and no longer one
CACHED_PAIRS = 400_000
TOKEN = -1  # where a node of `tails` holds the token that ends the walk
SPACE = r"\t-\r\x20\x85\xa0" + "".join(map(chr, [0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def _words(letter: str, number: str) -> str:
    """The pattern that byte-level BPE cuts texts with."""
    return rf"'s|'t|'re|'ve|'m|'ll|'d|\x20?[{letter}]+|\x20?[{number}]+|\x20?[^{SPACE}{letter}{number}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"


@lru_cache(1)
def splitters():
    """Finders of words: one for texts below U+0250, which the faster library can do, and one for all."""
    kinds = {k: "".join(rf"\u{i:04x}" for i in range(0x250) if unicodedata.category(chr(i))[0] == k) for k in "LN"}
    return re.compile(_words(kinds["L"], kinds["N"])).findall, regex.compile(_words(r"\p{L}", r"\p{N}")).findall, re.compile("[\u0250-\U0010ffff]").search


@lru_cache(1)
def runs():
    """Runs of two or more white space characters."""
    return re.compile(f"[{SPACE}]{{2,}}")


def pieces(text: str) -> list[str]:
    """A text cut before single spaces and around longer white space, where words always end.

    A single space starts the word after it. Of a longer run of white space all but the last character, or all at the end
    of the text, is a word.
    """
    mark = next(c for c in map(chr, range(0xFDD0, 0x10FFFF)) if c not in text)
    cut = lambda x: x.replace(" ", mark + " ").split(mark)
    out, at = [], 0
    for m in runs().finditer(text):
        start, end = m.span()
        end -= end < len(text)
        out += cut(text[at:start])
        out.append(text[start:end])
        at = end
    return out + cut(text[at:]) if out else cut(text)


class Tokenizer:
    """The vocabulary, merges and added tokens of a tokenizers JSON file, and encodings of words by trie."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, kind = spec["model"], spec.get("pre_tokenizer") or {}
        if model["type"] != "BPE" or kind.get("type") != "ByteLevel" or kind.get("add_prefix_space") or spec.get("normalizer"):
            raise ValueError("only byte-level BPE without a normalizer or prefix space")
        if any(t.get(k) for t in spec.get("added_tokens", []) for k in ("single_word", "lstrip", "rstrip")):
            raise ValueError("only added tokens that match wherever they stand, without white space around them")
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in printable]
        byte_of = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}
        as_bytes = lambda s: bytes(byte_of[c] for c in s)
        added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.id_of = {as_bytes(s): i for s, i in model["vocab"].items() if s not in added}
        self.bytes_of = [b""] * (1 + max([*model["vocab"].values(), *added.values()]))
        for b, i in self.id_of.items():
            self.bytes_of[i] = b
        for s, i in added.items():
            self.bytes_of[i] = s.encode()
        self.added = added
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")").split if added else None
        self.rank, self.made = {}, [-1] * len(self.bytes_of)
        self.parts = [(-1, -1)] * len(self.bytes_of)
        for r, pair in enumerate(model["merges"]):
            a, b = map(as_bytes, pair.split(" ") if isinstance(pair, str) else pair)
            i, j, k = self.id_of[a], self.id_of[b], self.id_of[a + b]
            self.rank[i, j], self.made[k], self.parts[k] = r, r, (i, j)
        self.tails: dict = {}  # tokens by their bytes from the last to the first
        for b, i in self.id_of.items():
            node = self.tails
            for x in reversed(b):
                node = node.setdefault(x, {})
            node[TOKEN] = i
        self.follows: dict[tuple[int, int], bool] = {}
        self.alone: dict[int, bool] = {}
        self.known: dict[str, bytes] = {"": b""}
        self.held = 0  # about how many bytes the cache of words and pieces takes

    def may_follow(self, x: int, y: int) -> bool:
        """Whether BPE leaves the border between tokens x and y, by undoing their merges, the latest first."""
        key, limit = (x, y), len(self.rank)
        if (said := self.follows.get(key)) is not None:
            return said
        said = None
        while said is None:
            across = self.rank.get((x, y), limit)
            if across < limit:
                said = False
            elif self.made[x] > self.made[y]:
                limit, x = self.made[x], self.parts[x][1]
            elif self.made[y] >= 0:
                limit, y = self.made[y] + 1, self.parts[y][0]
            else:
                said = True
        if len(self.follows) > CACHED_PAIRS:
            self.follows.clear()
        self.follows[key] = said
        return said

    def stands(self, token: int) -> bool:
        """Whether the token's own bytes are encoded as that token, by merging them as BPE is defined."""
        if (said := self.alone.get(token)) is None:
            ids = [self.id_of[bytes([b])] for b in self.bytes_of[token]]
            while len(ids) > 1:
                rank, at = min((self.rank.get(pair, len(self.rank)), k) for k, pair in enumerate(zip(ids, ids[1:])))
                if rank == len(self.rank):
                    break
                ids[at : at + 2] = [self.id_of[self.bytes_of[ids[at]] + self.bytes_of[ids[at + 1]]]]
            said = self.alone[token] = ids == [token]
        return said

    def learn(self, words) -> None:
        """Adds the encodings of words to the cache, by one depth-first walk of their trie."""
        tails, may, said = self.tails, self.may_follow, self.follows.get
        path, last, start = b"", [-1], [0]  # by depth: the node's last token and the depth where that starts
        for raw, word in sorted((w.encode("utf-8", "surrogatepass"), w) for w in words):
            shared, most = 0, min(len(path), len(raw))
            while shared < most and path[shared] == raw[shared]:
                shared += 1
            del last[shared + 1 :], start[shared + 1 :]
            for end in range(shared + 1, len(raw) + 1):
                found, at, node = [], end, tails
                while at and (node := node.get(raw[at - 1])):
                    at -= 1
                    if TOKEN in node:
                        found.append((at, node[TOKEN]))
                for at, token in reversed(found):  # the longest first
                    if at:
                        if (ok := said((last[at], token))) is None:
                            ok = may(last[at], token)
                    else:
                        ok = self.stands(token)
                    if ok:
                        last.append(token)
                        start.append(at)
                        break
            path, ids, end = raw, [], len(raw)
            while end:
                ids.append(last[end])
                end = start[end]
            self.known[word] = array("i", ids[::-1]).tobytes()

    def encode(self, texts) -> list[np.ndarray]:
        """The ids of each text; None counts as empty."""
        fast, whole, wide = splitters()
        cut = []
        for text in texts:
            parts = []
            for k, part in enumerate(self.cut(text) if self.cut and text else [text or ""]):
                parts += [part] if k % 2 else pieces(part)
            cut.append(parts)
        if self.held > CACHED_BYTES:
            self.known, self.held = {"": b""}, 0
        new = set(chain.from_iterable(cut)).difference(self.known)
        for s in new & self.added.keys():
            self.known[s] = array("i", [self.added[s]]).tobytes()
        words, several = set(), {}
        for piece in new - self.added.keys():
            if piece[1:].isalpha() and (piece[0] == " " or piece[0].isalpha()):
                words.add(piece)
            else:
                several[piece] = said = (whole if wide(piece) else fast)(piece)
                words.update(said)
        fresh = words.difference(self.known)
        self.learn(fresh)
        known = self.known.__getitem__
        for piece, said in several.items():
            self.known[piece] = b"".join(map(known, said))
        out = [np.frombuffer(b"".join(map(known, parts)), dtype=np.int32) for parts in cut]
        for s in chain(fresh, several.keys() - fresh):
            if len(s) > KEPT_CHARS:  # texts without spaces are made of long pieces that hardly come again
                del self.known[s]
            else:
                self.held += 150 + 8 * len(s)
        return out

    def forget(self) -> None:
        """Empties the caches."""
        self.known, self.held, self.follows = {"": b""}, 0, {}

    def decode(self, ids) -> str:
        """The text of a list of ids; bytes that are not UTF-8 become U+FFFD."""
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(2)
def tokenizer(path: str) -> Tokenizer:
    return Tokenizer(path)


@contextmanager
def no_collection():
    """Without cyclic garbage collection: the many small tuples and lists of an encoding hold no cycles."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()


def encode(docs: DataFrame, path: str, text_col: str = "text", out: str = "ids", decoded: str | None = None) -> DataFrame:
    """docs with the array of a text's token ids as column `out`, and if asked the ids' text as column `decoded`.

    path: a tokenizers JSON file that every executor has. A null text counts as empty and gives an empty array;
    every text is encoded whole. All other columns stay as they are, nulls and repeated rows too; a column named
    like a new one is replaced.
    """

    def of(texts):
        coder = tokenizer(path)
        with no_collection():
            ids = coder.encode(texts)
            ends = np.cumsum([0, *map(len, ids)], dtype=np.int64).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids)))
            return [lists, [coder.decode(x.tolist()) for x in ids]] if decoded else [lists]

    forget = lambda: tokenizer(path).forget()
    return added(docs, text_col, of, {out: ArrayType(IntegerType())} | ({decoded: StringType()} if decoded else {}), done=forget)


def decode(docs: DataFrame, path: str, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """docs with the text of its token ids as column `out`; null ids give null."""

    def of(rows):
        return [[None if x is None else tokenizer(path).decode(x) for x in rows]]

    return added(docs, ids_col, of, {out: StringType()})


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """Where the installed tokenizer file of this name is."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the decoded text of every document."""
    path = tokenizer_path()
    coded = encode(table(spark, sf_dir, "documents").select("doc_id", "text"), path, decoded="decoded")
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
