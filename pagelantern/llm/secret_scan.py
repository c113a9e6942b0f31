"""Secret scans: fixed patterns and a linear-chain conditional random field.

Base spans come from three patterns, each matched leftmost and without overlaps; a span is the whole match, from its
first to after its last code point. The field adds spans: it tags every token of a text as secret begin (B), inside (I)
or outside (O) from the token's shape, the neighbouring tokens and features of the whole file, and Viterbi finds the
best tags. It is trained on token windows around the base spans of a bounded sample of documents (labels by the
patterns), on windows elsewhere in them, and on generated lines of common forms of secrets and of harmless numbers.

Tagging is exact but skips what cannot matter: a token can only be non-O in the best tagging if some interval that
holds it gains by not being O even with the most that transitions could add. Sums and extrema over a text find
those tokens at once; Viterbi runs on them alone, as all others are O in the best tagging.
"""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from pagelantern.llm.common import added, table

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex", "crf")
#: A run of letters, digits and +/.- is a token (a long one with the = that end base64), and so is any other mark.
TOKEN = re.compile(r"[\w+/.\-]+(?:(?==)(?<=[\w+/.\-]{16})={1,2}(?![\w=]))?|[^\w\s+/.\-]")
O, B, I = range(3)  # noqa: E741
SIZE = 1 << 13  # feature slots
AROUND = (-2, -1, 0, 1)  # positions of the tokens whose features count
CACHED_TOKENS = 400_000


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind) of the fixed patterns, kind as an index of KINDS, in order of start and kind."""
    out = []
    if "=" in text or ":" in text:
        out += [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    out += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], s[2]))


def value_spans(text: str) -> list[tuple[int, int]]:
    """The secret values alone in the base spans: what the field learns to tag."""
    out = [m.span(2) for m in ASSIGN.finditer(text) if len(m[2]) >= 8] if "=" in text or ":" in text else []
    out += [m.span() for m in ACCESS.finditer(text) if len(m[0]) >= 16] if "AKIA" in text else []
    return sorted(out + [m.span() for m in HEX.finditer(text)])


def slot(name: str) -> int:
    return zlib.crc32(name.encode("utf-8", "surrogatepass")) % SIZE


HINTS = ("pass", "secret", "token", "key", "pwd", "auth", "credential", "bearer", "login", "sig")
PREFIXES = ("AKIA", "ASIA", "ghp_", "gho_", "ghs_", "sk-", "sk_", "pk_", "rk_", "xox", "eyJ", "AIza", "glpat-", "npm_", "hf_", "SG.", "dop_v1_", "shpat_")


TOLD = re.compile("|".join([*HINTS, *("^" + re.escape(x) for x in PREFIXES)]), re.I)


def token_features(token: str, words: frozenset[str]) -> list[str]:
    """Names of what a token shows: length, character classes, shape, variety, and the token itself if it is one of words."""
    n, low = len(token), token.lower()
    digits, upper, lower = (sum(map(f, token)) for f in (str.isdigit, str.isupper, str.islower))
    kinds = re.sub(r"(.)\1+", r"\1", "".join("9" if c.isdigit() else "A" if c.isupper() else "a" if c.islower() else "u" if c.isalpha() else c for c in token[:64]))
    out = [f"len{n}" if n < 9 else f"len>{n // 4}", f"classes{digits > 0:d}{upper > 0:d}{lower > 0:d}", f"digits{4 * digits // n}", f"turns{min(12, len(kinds))}"]
    out.append(f"variety{8 * len(set(token)) // min(n, 16)}" if n > 7 else "short")
    if n > 7 and digits and re.fullmatch(r"[0-9a-fA-F]+", token):
        out.append("hex")
    if len(kinds) < 5:
        out.append("shape" + kinds)
    if low in words:
        out.append("word" + low)
    if any(h in low for h in HINTS):
        out.append("hint")
    if token.startswith(PREFIXES):
        out.append("prefix")
    return out


def kind_of(token: str, words: frozenset[str]):
    """A key that tokens with the same features share: what a plain word is like, any other token itself."""
    if token.isalpha() and (token.islower() or token.istitle()) and token.lower() not in words and not TOLD.search(token):
        return len(token), token.islower(), len(set(token)) if len(token) > 7 else 0
    return token


def file_features(text: str, tokens: int) -> list[int]:
    """Slots of what the whole text shows: its length, assignments and structure."""
    marks = sum(map(text.count, "={}\"$|"))
    return [slot(f"file:length{min(6, tokens.bit_length() // 3)}"), slot(f"file:marks{min(9, 60 * marks // max(tokens, 1))}"), slot(f"file:assigns{' = ' in text:d}{'{' in text:d}")]


def labelled_tokens(text: str, spans) -> list[tuple[str, int, int, int]]:
    """(token, start, end, tag) of a text whose secret values are spans."""
    out, k, spans = [], 0, sorted(spans)
    for m in TOKEN.finditer(text):
        s, e = m.span()
        while k < len(spans) and spans[k][1] <= s:
            k += 1
        inside = k < len(spans) and spans[k][0] < e and s < spans[k][1]
        out.append((m[0], s, e, O if not inside else I if out and out[-1][1] >= spans[k][0] and out[-1][3] != O else B))
    return out


def windows(text: str, reach: int = 10, each: int = 8) -> list[tuple[list[str], list[int], list[int]]]:
    """Training windows of a text: around secret values, `each` at most, drawn by hash, and one elsewhere. (tokens, tags, file slots)."""
    tokens = labelled_tokens(text, value_spans(text))
    about = file_features(text, len(tokens))
    at = sorted((i for i, t in enumerate(tokens) if t[3] == B), key=lambda i: zlib.crc32(f"{i} {tokens[i][0]}".encode("utf-8", "surrogatepass")))[:each]
    at += [zlib.crc32(text.encode("utf-8", "surrogatepass")) % len(tokens)] if tokens else []
    cut = [tokens[max(0, i - reach) : i + reach] for i in at]
    return [([t[0] for t in c], [t[3] for t in c], about) for c in cut]


LOW, HIGH, DIGIT = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
#: Lines that lead to a secret, that lead to a plain value, and endings of plain addresses.
LEADS = ["Authorization: Bearer ", "pwd = ", "pwd: ", "PWD=", "key: ", "credentials ", "private_key=", "auth_token: '", "", "", "client_secret -> ", "access key ", "aws_secret_access_key = ", "passphrase: ", "login pass ", "DB_PASS=", "the key is ", "use ", "x-auth: ", "signature="]
PLAIN_LEADS = ["on ", "call ", "number ", "", "", "see ", "token of ", "the key ", "id: ", "x = ", "color: ", "version ", "ref ", "the password ", "mail ", "order ", "file "]


def secret_value(rng: random.Random) -> str:
    """A made-up secret of a common form."""
    pick = lambda chars, k: "".join(rng.choice(chars) for _ in range(k))
    every = LOW + HIGH + DIGIT
    forms = [
        lambda: pick("0123456789abcdef", rng.choice([20, 24, 28, 31])), lambda: pick("0123456789ABCDEF", rng.choice([32, 40, 64])),
        lambda: pick(every, rng.randint(20, 44)), lambda: pick(every + "+/", 40), lambda: pick(every + "+/", 40),
        lambda: rng.choice(["ghp_", "gho_", "npm_", "hf_"]) + pick(every, 36), lambda: rng.choice(["sk-", "glpat-", "AIza"]) + pick(every + "_-", rng.randint(20, 40)),
        lambda: rng.choice(["sk_live_", "pk_live_", "rk_test_"]) + pick(every, 24), lambda: f"xox{rng.choice('bpa')}-{pick(DIGIT, 12)}-{pick(DIGIT, 12)}-{pick(every, 24)}",
        lambda: f"eyJ{pick(every, 17)}.eyJ{pick(every, 40)}.{pick(every + '_-', 43)}", lambda: f"SG.{pick(every, 22)}.{pick(every, 43)}",
    ]
    return rng.choice(forms)()


def secret_phrase(rng: random.Random) -> str:
    """A made-up password with letters of several kinds and marks, as people write them."""
    word = "".join(rng.choice(LOW) for _ in range(rng.randint(4, 8)))
    word = word.replace("o", "0").replace("e", "3").replace("i", "1").capitalize() if rng.random() < 0.7 else word.capitalize() + str(rng.randint(10, 9999))
    return word + rng.choice("&!#%*$^") + "".join(rng.choice(LOW + DIGIT) for _ in range(rng.randint(3, 7)))


def secret_block(rng: random.Random) -> tuple[str, str, str]:
    """What leads to a made-up private key in lines of base64, its lines, and what ends it."""
    kind = rng.choice(["", "RSA ", "EC ", "OPENSSH ", "ENCRYPTED ", "DSA "])
    body = "".join(rng.choice(LOW + HIGH + DIGIT + "+/") for _ in range(rng.randint(90, 420)))
    wide = rng.choice([64, 64, 70, 76])
    lines = "\n".join(body[k : k + wide] for k in range(0, len(body), wide)) + rng.choice(["", "=", "=="])
    return f"-----BEGIN {kind}PRIVATE KEY-----\n", lines, f"\n-----END {kind}PRIVATE KEY-----"


def secret_words(rng: random.Random) -> tuple[str, str]:
    """What leads to a made-up passphrase or key of groups, and it: forms that only their lead tells from plain ones."""
    pick = lambda chars, k: "".join(rng.choice(chars) for _ in range(k))
    if rng.random() < 0.5:
        return rng.choice(["pass: ", "password is ", "passphrase: ", "pwd=", "login pass: ", "PASS = "]), pick(LOW, rng.randint(14, 30))
    chars, size = rng.choice([(HIGH + DIGIT, 5), (HIGH + DIGIT, 4), (LOW + DIGIT, 4), (LOW + DIGIT, 6)])
    return rng.choice(["license key: ", "activation key = ", "serial: ", "client_secret: ", "client id: ", "key="]), "-".join(pick(chars, size) for _ in range(rng.randint(3, 6)))


def plain_value(rng: random.Random) -> str:
    """A made-up value that is no secret."""
    pick = lambda chars, k: "".join(rng.choice(chars) for _ in range(k))
    forms = [
        lambda: pick(DIGIT, rng.randint(1, 19)), lambda: f"{rng.randint(1990, 2030)}-0{rng.randint(1, 9)}-1{rng.randint(0, 9)}", lambda: pick(LOW, rng.randint(10, 40)), lambda: pick(LOW, rng.randint(2, 9)).capitalize(),
        lambda: pick(HIGH, rng.randint(2, 24)), lambda: f"{pick(DIGIT, 3)}.{pick(DIGIT, 2)}", lambda: f"{pick(LOW, 6)}.{pick(DIGIT, 2)}@{pick(LOW, 5)}{pick(DIGIT, 1)}.example.com", lambda: f"www.{pick(LOW, 8)}.org/{pick(LOW, 6)}/{pick(DIGIT, 4)}",
        lambda: f"{pick(LOW, 5)}_{pick(LOW, 6)}_{pick(LOW, 4)}", lambda: f"{pick(LOW, 4)}{pick(HIGH, 1)}{pick(LOW, 6)}{pick(HIGH, 1)}{pick(LOW, 5)}", lambda: f"v{pick(DIGIT, 1)}.{pick(DIGIT, 2)}.{pick(DIGIT, 1)}-rc{pick(DIGIT, 1)}", lambda: "#" + pick("0123456789abcdef", 6),
        lambda: f"+{pick(DIGIT, 2)} {pick(DIGIT, 3)} {pick(DIGIT, 7)}", lambda: f"{pick(DIGIT, 3)}.{pick(DIGIT, 2)}.{pick(DIGIT, 3)}.{pick(DIGIT, 1)}", lambda: f"{pick(LOW, 6)}-{pick(LOW, 4)}-{pick(LOW, 7)}", lambda: f"{pick(HIGH, 2)}{pick(DIGIT, 2)} {pick(DIGIT, 4)} {pick(DIGIT, 4)}",
        lambda: f"{pick(LOW, 8)}.{rng.choice(['txt', 'py', 'html'])}", lambda: f"{pick(HIGH, 3)}-{pick(DIGIT, 5)}", lambda: pick(LOW, rng.randint(3, 9)) + rng.choice(["!!", "###", "&&&", "%%%", "***", "$$$"]),
    ]
    return rng.choice(forms)()


def generated(seed: int = 5, n: int = 3000, leads=LEADS, real=()) -> list[tuple[list[str], list[int], list[int]]]:
    """Training windows of made-up secrets, and of numbers, dates and names that are none, in the windows `real` of real texts.

    The windows around a made-up secret and around a plain value are alike, so only the value and what leads to it tell.
    Without real windows, made-up words are around.
    """
    rng, out = random.Random(seed), []
    for i in range(n):
        tail = ""
        if real:
            around, tags, about = real[rng.randrange(len(real))]
        else:
            around = ["".join(rng.choice(LOW) for _ in range(rng.randint(2, 9))) for _ in range(12)]
            tags, about = [O] * 12, file_features("", rng.choice([20, 100, 400, 2000]))
        if i % 2:
            value, lead = secret_value(rng), rng.choice(leads)
            if i % 6 == 1:
                value, lead = secret_phrase(rng), rng.choice([x for x in leads if x.strip()[-1:] in ("=", ":")])
            elif i % 12 == 3:
                lead, value = secret_words(rng)
            elif i % 12 == 9:
                lead, value, tail = secret_block(rng)
        else:
            value, lead = plain_value(rng), rng.choice(PLAIN_LEADS)
        made = labelled_tokens(lead + value + tail, [(len(lead), len(lead) + len(value))] if i % 2 else [])
        at = rng.randrange(len(around) + 1)
        first, last = max(0, at - 10), at + 10
        out.append(([*around[first:at], *(t[0] for t in made), *around[at:last]], [*tags[first:at], *(t[3] for t in made), *tags[at:last]], about))
    return out


@dataclass
class Field:
    """A linear-chain conditional random field over the tags O, B and I."""

    weight: np.ndarray = field(default_factory=lambda: np.zeros((len(AROUND) + 1, SIZE, 3)))  # the last is for the file
    step: np.ndarray = field(default_factory=lambda: np.zeros((3, 3)))
    words: frozenset[str] = frozenset()

    def __post_init__(self):
        self.index: dict[str, int] = {}
        self.rows: dict = {}
        self.parts = np.empty((0, len(AROUND) * 3), dtype=np.float32)
        self.by_slot = np.ascontiguousarray(self.weight[: len(AROUND)].transpose(1, 0, 2).reshape(SIZE, -1), dtype=np.float32)

    def __getstate__(self):
        return self.weight, self.step, self.words

    def __setstate__(self, state):
        self.weight, self.step, self.words = state
        self.__post_init__()

    def forget(self) -> None:
        """Empties the cache."""
        self.index, self.rows, self.parts = {}, {}, self.parts[:0].copy()

    def meet(self, tokens) -> None:
        """Adds tokens' parts in the scores of themselves and of their neighbours to the cache."""
        if len(self.index) > CACHED_TOKENS:
            self.forget()
        new = set(tokens).difference(self.index)
        if not new:
            return
        keys = {t: kind_of(t, self.words) for t in new}
        first = {k: t for t, k in keys.items() if k not in self.rows}  # one token of each new kind stands for all
        if first:
            own, at = [slots(t, self.words) for t in first.values()], len(self.rows)
            self.rows.update(zip(first, range(at, at + len(first))))
            if len(self.rows) > len(self.parts):
                self.parts = np.concatenate([self.parts[:at], np.empty((len(first) + max(1024, at // 2), self.by_slot.shape[1]), dtype=np.float32)])
            starts = np.cumsum([0, *map(len, own)])[:-1]
            self.parts[at : at + len(first)] = np.add.reduceat(self.by_slot[np.fromiter(chain.from_iterable(own), dtype=np.int64)], starts)
        self.index.update((t, self.rows[k]) for t, k in keys.items())

    def scores(self, tokens: list[str], about: list[int]) -> np.ndarray:
        """(tokens, 3) scores of the tags."""
        self.meet(tokens)
        parts = self.parts[np.fromiter(map(self.index.__getitem__, tokens), dtype=np.int64, count=len(tokens))]
        out = np.tile(self.weight[-1, about].sum(0), (len(tokens), 1))
        for k, d in enumerate(AROUND):
            part = parts[:, 3 * k : 3 * k + 3]
            if d <= 0:
                out[-d:] += part[: len(tokens) + d]
            else:
                out[:-d] += part[d:]
        return out

    def tags(self, tokens: list[str], about: list[int]) -> np.ndarray:
        """The best tags of a text's tokens."""
        out = np.zeros(len(tokens), dtype=np.int8)
        if not tokens:
            return out
        score, step = self.scores(tokens, about), self.step
        most = max(0.0, max(step[i, j] - step[O, O] for i in range(3) for j in range(3) if (i, j) != (O, I)))
        total = np.cumsum(np.maximum(score[:, B], score[:, I]) - score[:, O] + 2 * most)
        best = np.maximum.accumulate(total[::-1])[::-1] - np.minimum.accumulate(np.r_[0, total[:-1]])
        hot = np.flatnonzero(best >= 0)
        for run in np.split(hot, np.flatnonzero(np.diff(hot) > 1) + 1) if len(hot) else []:
            out[run] = self.viterbi(score[run])
        return out

    def viterbi(self, score: np.ndarray) -> list[int]:
        """The best tags of tokens between others that are O."""
        s, at, back = self.step, [0.0, -1e30, -1e30], []
        for e in score.tolist():
            new, frm = [], []
            for j in range(3):
                options = [at[i] + s[i, j] if (i, j) != (O, I) else -1e30 for i in range(3)]
                i = max(range(3), key=options.__getitem__)
                new.append(options[i] + e[j])
                frm.append(i)
            at = new
            back.append(frm)
        at = [a + s[i, O] for i, a in enumerate(at)]
        tag, out = max(range(3), key=at.__getitem__), []
        for frm in reversed(back):
            out.append(tag)
            tag = frm[tag]
        return out[::-1]


def slots(token: str, words: frozenset[str]) -> list[int]:
    return [slot(name) for name in token_features(token, words)]


def train(examples, epochs: int = 6, batch: int = 200, rate: float = 0.3, decay: float = 1e-5, least: int = 3) -> Field:
    """A field fitted to windows (tokens, tags, file slots) by the likelihood of their tags, with AdaGrad over batches.

    A word is a feature if `least` tokens are it.
    """
    examples = [x for x in examples if x[0]]
    random.Random(1).shuffle(examples)
    n, long = len(examples), max(len(x[0]) for x in examples)
    often = Counter(t.lower() for x in examples for t in x[0] if len(t) < 13)
    words = frozenset(w for w, k in often.items() if k >= least)
    told = {t: slots(t, words) for t in {t for x in examples for t in x[0]}}
    tag, live = np.zeros((n, long), dtype=np.int64), np.zeros((n, long), dtype=bool)
    place, feature, group, ends = [], [], [], [0]
    for r, (tokens, tags, about) in enumerate(examples):
        tag[r, : len(tags)], live[r, : len(tags)] = tags, True
        for c in range(len(tokens)):
            for k, d in enumerate(AROUND):
                if 0 <= c + d < len(tokens):
                    own = told[tokens[c + d]]
                    place += [r * long + c] * len(own)
                    feature += own
                    group += [k] * len(own)
            place += [r * long + c] * len(about)
            feature += about
            group += [len(AROUND)] * len(about)
        ends.append(len(place))
    place, at = np.array(place), np.array(group) * SIZE + np.array(feature)
    used, at = np.unique(at, return_inverse=True)
    w, seen = np.zeros((len(used), 3)), np.full((len(used), 3), 1e-4)
    step, seen_step = np.zeros((3, 3)), np.full((3, 3), 1e-4)
    barred = np.zeros((3, 3))
    barred[O, I] = -1e9
    soft = lambda x, axis: (m := x.max(axis, keepdims=True)).squeeze(axis) + np.log(np.exp(x - m).sum(axis))
    for first in list(range(0, n, batch)) * epochs:
        last = min(n, first + batch)
        here, fs = last - first, slice(ends[first], ends[last])
        where, what, alive, gold = place[fs] - first * long, at[fs], live[first:last], np.eye(3)[tag[first:last]] * live[first:last, :, None]
        both = alive[:, 1:] & alive[:, :-1]
        score = np.stack([np.bincount(where, w[what, j], here * long) for j in range(3)], -1).reshape(here, long, 3)
        score[:, 0, I] -= 1e9
        move = step + barred
        a, b = np.zeros((here, long, 3)), np.zeros((here, long, 3))
        a[:, 0] = score[:, 0]
        for c in range(1, long):
            a[:, c] = np.where(alive[:, c, None], soft(a[:, c - 1, :, None] + move, 1) + score[:, c], a[:, c - 1])
        for c in range(long - 2, -1, -1):
            b[:, c] = np.where(alive[:, c + 1, None], soft(move + (score[:, c + 1] + b[:, c + 1])[:, None], 2), 0)
        z = soft(a[:, -1], 1)
        wrong = np.exp(a + b - z[:, None, None]) * alive[..., None] - gold
        flow = np.exp(a[:, :-1, :, None] + move + (score[:, 1:] + b[:, 1:])[:, :, None] - z[:, None, None, None]) * both[..., None, None]
        pairs = np.einsum("rci,rcj->ij", gold[:, :-1] * both[..., None], gold[:, 1:])
        grad = np.stack([np.bincount(what, wrong.reshape(-1, 3)[where, j], len(used)) for j in range(3)], -1) / here + decay * w
        turn = (flow.sum((0, 1)) - pairs) / here + decay * step
        seen, seen_step = seen + grad**2, seen_step + turn**2
        w -= rate * grad / np.sqrt(seen)
        step -= rate * turn / np.sqrt(seen_step)
    weight = np.zeros((len(AROUND) + 1, SIZE, 3))
    weight.reshape(-1, 3)[used] = w
    return Field(weight, step, words)


def learn(docs: DataFrame, sample: int = 6000, secrets: int = 1500, plain: int = 3000) -> Field:
    """A field trained on windows of a bounded sample of documents and on generated lines.

    Documents are drawn by a hash of their row, about `sample` of them, so copies of a text with ids of their own are drawn
    one by one. Of their distinct windows `secrets` with and `plain` without a secret at most come to the driver, those
    of the lowest hashes. Null texts are left out.
    """
    rows = docs.where("text is not null")
    part = min(1.0, sample / max(1, rows.count()))
    drawn = rows.where(F.pmod(F.xxhash64(*rows.columns, F.lit("secrets")), F.lit(1 << 20)) < int(part * (1 << 20))).select("text")
    kind = ArrayType(StructType([StructField("tokens", ArrayType(StringType())), StructField("tags", ArrayType(IntegerType())), StructField("about", ArrayType(IntegerType()))]))

    def of(batch):
        return [[[dict(zip(("tokens", "tags", "about"), w)) for w in windows(t)] for t in batch]]

    found = added(drawn, "text", of, {"windows": kind}).select(F.explode("windows").alias("w")).select("w.*")
    found = found.withColumns({"h": F.xxhash64("tokens", "tags"), "secret": F.array_contains("tags", B)}).dropDuplicates(["h"]).persist()
    taken = [r for few, is_secret in ((secrets, "secret"), (plain, "not secret")) for r in found.where(is_secret).orderBy("h").limit(few).collect()]
    found.unpersist()
    real = [(list(r["tokens"]), list(r["tags"]), list(r["about"])) for r in taken]
    return train(real + generated(real=[x for x in real if B not in x[1]]))


def spans(text: str | None, model: Field) -> list[tuple[int, int, int]]:
    """(start, end, kind) of all secrets of a text. A span of the field that overlaps a base span is not repeated."""
    text = text or ""
    base = base_spans(text)
    tokens = TOKEN.findall(text)
    tags = model.tags(tokens, file_features(text, len(tokens)))
    if not tags.any():
        return base
    more, at = [], 0
    for m, tag in zip(TOKEN.finditer(text), tags):
        if tag == B:
            more.append([m.start(), m.end()])
        elif tag == I and more:
            more[-1][1] = m.end()
    out = list(base)
    for s, e in more:
        while at < len(base) and base[at][1] <= s and all(x[1] <= s for x in base[at : at + 3]):
            at += 1
        if not any(b < e and s < t for b, t, _ in base[max(0, at - 3) :][:64]):
            out.append((s, e, 3))
    return sorted(out, key=lambda x: (x[0], x[2]))


def redacted(text: str | None, found, mark: str) -> str | None:
    """A text with `mark` in place of every span; overlapping spans are replaced as one."""
    if not text or not found:
        return text
    parts, at = [], 0
    for start, end, _ in found:
        if start >= at:
            parts += [text[at:start], mark]
        at = max(at, end)
    return "".join([*parts, text[at:]])


def scan(docs: DataFrame, model: Field, mark: str | None = None) -> DataFrame:
    """docs with `spans`: an array of start, end (code points, end exclusive) and kind of every secret of the whole text.

    If mark is given, the text has it in place of every span. A null text counts as empty. Other columns, nulls
    and repeated rows stay; a column named spans is replaced.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kind = ArrayType(StructType([StructField("start", IntegerType()), StructField("end", IntegerType()), StructField("kind", StringType())]))

    def of(texts):
        found = [spans(t, sent.value) for t in texts]
        out = [[{"start": s, "end": e, "kind": KINDS[k]} for s, e, k in f] for f in found]
        return [out] if mark is None else [out, [redacted(t, f, mark) for t, f in zip(texts, found)]]

    fields = {"spans": kind} if mark is None else {"spans": kind, "text": StringType()}
    return added(docs, "text", of, fields, done=lambda: sent.value.forget())


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = scan(docs, learn(docs)).drop("text")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    text = lambda col: F.array_join(F.transform(col, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    return found.select(
        "doc_id",
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(text(F.filter("spans", lambda s: s["kind"] != "crf")), 256).alias("base_sha256"),
        text(F.col("spans")).alias("spans"),
    )
