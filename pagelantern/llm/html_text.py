"""Main text of web pages by a host's suffix array, with markup as further evidence.

A page is read into blocks, the texts between block-level tags, each inside or outside the page's article (`article`,
`main`, role main or a usual content class) and marked or not as menu, header, footer, sidebar, notice, advert, form,
script or reader comments by its elements, roles, classes and ids.

The pages' token streams (words, and a token for each block's place) are concatenated for each host, and their suffixes
grouped by their first `depth` tokens. That is what the host's suffix array tells to this depth: suffixes with a common
prefix lie together, and how many pages they are of is counted. It is an index of pieces of `depth` tokens and no
sorted array: the order of the groups, and common prefixes longer than `depth`, are never computed, since a substring of that length or more
is on several pages just if each of its pieces of `depth` tokens is, so the cover is the same as a full sort's. Suffixes meet
by the hash of host and prefix, and what is shared goes back to the pages by a join, so no host is gathered in one task.

Two rules read the array; copies of a page (equal in all visible text), or of an article, count as one page in it:
- Outside articles what two distinct pages share is boilerplate and goes; unique runs stay. A page of which less than `own`
  (a tenth) would stay is a near copy: then only what more pages share goes, by the lowest number that leaves that much.
- Inside an article a whole block is boilerplate if `share` (half) of the host's distinct articles hold it, `least` (5) at
  least: a standing notice, a sign-off. If such blocks are more than half of an article, it is a copy and stays whole.

Markup decides what no repetition shows: adverts, forms or comments that a host shows once go, and text in the article
that other pages quote stays.
"""

from __future__ import annotations

import html
import re
import uuid

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, LongType, StringType

from pagelantern.llm.common import added, cut, remove, shared_folder, table

# Fixed values of HTML: elements that start a line of their own, have no end tag, hold raw text, or hold no article text.
BLOCK = set("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead title tr ul".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title xmp iframe noembed noframes".split())
ASIDE = set("script style noscript template svg iframe object canvas audio video head nav footer aside form button select textarea dialog menu".split())
WALLS = set("html body article main section nav footer aside header form table td th".split())
# Class and id words that usually mark what is not article text, and what is.
OFF = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|sponsor\w*|promo\w*|banner|nav\w*|menu\w*|sidebar|footer|header|masthead|breadcrumbs?|cookies?|consent|gdpr|notices?|notification|popup|modal|newsletter|subscribe|subscription|signup|share|sharing|social|related|recommend\w*|comments?|comment-\w+|disqus|replies|respond|login|search|widgets?|pagination|pager|toolbar|skip\w*|copyright|disclaimer)(?:$|[\s_-])", re.I)
COMMENT = re.compile(r"(?:^|\s)(?:comments?|replies|reply|review)(?:$|[\s_-])", re.I)
# Inside an article: states of an element, sections of papers and result lists, and an article's own header and comments' counts are its text.
PLAIN = re.compile(r"(?:^|(?<=\s))(?:(?:has|with|no|without)[_-]\S+|related-work|search-results|\S+[_-](?:header|comments?|replies|respond|comment-\w+))(?=$|\s)", re.I)
THREAD = re.compile(r"(?:^|\s)(?:comments?|comment-?list|comments-area|replies|respond|disqus_thread)(?:$|\s)", re.I)
ON = re.compile(r"(?:^|\s)(?:article-?(?:body|content|text)|post-?(?:body|content)|entry-?content|story-?(?:body|content)|main-?content)(?:$|\s)", re.I)
ROLES_OFF = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "menu", "menubar"}
TAG = re.compile(r"""<!--.*?(?:--!?>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)""", re.S)
ATTR = re.compile(r"""([^\s=/"'<>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
WHITE = re.compile(r"\s+")
IN, OFFSIDE, OUT = 0, 1, 2  # a block's place: in the article, marked as something else, neither


def attributes(text: str) -> dict[str, str]:
    out = {}
    for name, value in ATTR.findall(text):
        out.setdefault(name.lower(), value.strip("\"'"))
    return out


def _places(tag: str, raw: str, off: bool, inside: bool) -> tuple[bool, bool]:
    """Whether an element is not article text, and whether it is in the article, from what its parent is."""
    attr = attributes(raw) if "=" in raw or "hidden" in raw else {}
    names = f"{attr.get('class', '')} {attr.get('id', '')}".strip()
    role = attr.get("role", "").lower()
    hidden = "hidden" in attr or attr.get("aria-hidden") == "true" or "display:none" in attr.get("style", "").replace(" ", "").lower()
    if tag in ("article", "main") or role in ("main", "article"):
        comment = inside and bool(COMMENT.search(names))  # an outermost one only in a thread of comments
        return off == 2 or comment or hidden or bool(off and inside), True
    if tag in ASIDE or role in ROLES_OFF or hidden or (tag == "header" and not inside):
        return 2, inside
    if tag not in ("html", "body") and not inside and names and THREAD.search(names):
        return 2, inside
    if off or tag in ("html", "body"):
        return off, inside
    if names and ON.search(names) or attr.get("itemprop", "").lower() == "articlebody":
        return off, True
    return (1 if names and OFF.search(PLAIN.sub("", names) if inside else names) else 0), inside


def blocks(page: str | None) -> list[tuple[int, str, str]]:
    """(place, path, text) of a page's blocks in order. path names the block's enclosing element.

    Character references are decoded, white space inside a block is one space, blocks without text are left out.
    """
    page, out, at, text = page or "", [], 0, []
    stack = [("", 0, False, "")]  # name, not article text (2: by its element), in the article, class
    opened: dict[str, list[int]] = {}  # where in the stack the elements of a name are
    walls: list[int] = []

    def flush():
        if text:
            said = WHITE.sub(" ", html.unescape("".join(text))).strip()
            if said:
                name, off, inside, kind = stack[-1]
                out.append((OFFSIDE if off else IN if inside else OUT, f"{name}.{kind}", said))
            text.clear()

    def pop():
        opened[stack.pop()[0]].pop()
        if walls and walls[-1] == len(stack):
            walls.pop()

    while at < len(page):
        m = TAG.search(page, at)
        if not m:
            text.append(page[at:])
            break
        if m.start() > at:
            text.append(page[at : m.start()])
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        if tag == "br":
            text.append(" ")
            continue
        closing, raw = m[1] or m[4], m[3] or m[6] or ""
        if tag in BLOCK:
            flush()
        if closing:
            places = opened.get(tag)
            if places and (tag in WALLS or not walls or walls[-1] <= places[-1]):
                first, above = places[-1], stack[places[-1] - 1]
                if (bool(stack[-1][1]), stack[-1][2]) != (bool(above[1]), above[2]):
                    flush()
                while len(stack) > first:
                    pop()
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        if tag in VOID or raw.endswith("/") and tag not in BLOCK:
            continue
        if tag in ("p", "li", "dt", "dd", "option", "tr", "td", "th") and stack[-1][0] == tag:
            pop()
        _, off, inside, kind = stack[-1]
        new_off, new_inside = _places(tag, raw, off, inside)
        if (bool(new_off), new_inside) != (bool(off), inside):
            flush()
        opened.setdefault(tag, []).append(len(stack))
        if tag in WALLS:
            walls.append(len(stack))
        stack.append((tag, new_off, new_inside, attributes(raw).get("class", "") if "class" in raw else kind))
    flush()
    return out


def stretches(found: list[tuple[int, str, str]]):
    """Runs of blocks outside the article: lists of (block number, token) with a token for each block's place."""
    run = []
    for i, (place, path, text) in enumerate(found):
        if place == IN:
            if run:
                yield run
            run = []
        else:
            run += [(i, "<" + path), *((i, w) for w in text.split(" "))]
    if run:
        yield run


def prefixes(run, depth: int) -> np.ndarray:
    """For each suffix of a run of tokens the hash of its first `depth` tokens; shorter ends are padded."""
    one = np.array([xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass")) for _, w in run] + [1] * (depth - 1), dtype=np.uint64)
    h = np.zeros(len(run), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(depth):
            h = (h ^ one[k : k + len(run)]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(31)
    return h.view(np.int64)


def long_blocks(found: list[tuple[int, str, str]], depth: int) -> list[tuple[int, int]]:
    """(block number, hash) of the article's blocks of `depth` words or more: suffixes that start and end with a block."""
    return [(i, xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"), 7) - (1 << 63)) for i, (place, _, text) in enumerate(found) if place == IN and text.count(" ") >= depth - 1]


def read_page(page: str | None, depth: int) -> dict:
    """What the suffix array needs of a page: its prefixes, its article's long blocks, and a hash of all text and of the article."""
    found = blocks(page)
    outside = np.unique(np.concatenate([np.empty(0, np.int64), *(prefixes(r, depth) for r in stretches(found))]))
    inside = np.unique(np.array([h for _, h in long_blocks(found, depth)], dtype=np.int64))
    of = lambda texts: xxhash.xxh64_intdigest("\0".join(texts).encode("utf-8", "surrogatepass"), 9) - (1 << 63)
    return {"outside": outside, "inside": inside, "key": of(f"{place}{text}" for place, _, text in found), "article": of(text for place, _, text in found if place == IN), "has_article": any(place == IN for place, _, _ in found)}


def article_text(found: list[tuple[int, str, str]], shared: dict[int, int], depth: int) -> str | None:
    """The text of a page's article without standing blocks; None if it has no article."""
    inside = [i for i, (place, _, _) in enumerate(found) if place == IN]
    gone = {i for i, h in long_blocks(found, depth) if h in shared} if shared else set()
    if 2 * sum(len(found[i][2]) for i in gone) > sum(len(found[i][2]) for i in inside):
        gone = set()
    return " ".join(found[i][2] for i in inside if i not in gone) if inside else None


def uncovered(words: list[str], covered: np.ndarray, depth: int) -> list[str]:
    """The words of a block that are not shared. A shorter run than `depth`, unless it is the whole block, comes from a neighbour's and stays."""
    edges = np.flatnonzero(np.diff(np.r_[False, covered, False]))
    keep = np.ones(len(words), dtype=bool)
    for a, b in zip(edges[::2], edges[1::2]):
        if b - a >= depth or b - a == len(words):
            keep[a:b] = False
    return [w for w, k in zip(words, keep) if k]


def unique_text(found: list[tuple[int, str, str]], shared: dict[int, int], depth: int, own: float = 0.1) -> str:
    """The runs of a page without an article that no other page shares. shared: on how many distinct pages a suffix is."""
    runs = [(run, np.array([shared.get(h, 1) for h in prefixes(run, depth).tolist()])) for run in stretches(found)]
    whole = sum(len(text.split(" ")) for place, _, text in found if place == OUT)
    words: list[str] = []
    for most in [1, *sorted({int(n) for _, counts in runs for n in counts if n > 1})]:  # what is on more pages goes
        words = []
        for run, counts in runs:
            covered = np.zeros(len(run) + depth, dtype=bool)
            for k in np.flatnonzero(counts > most).tolist():
                covered[k : k + depth] = True
            starts = [k for k in range(len(run)) if k == 0 or run[k - 1][0] != run[k][0]]
            for k, end in zip(starts, [*starts[1:], len(run)]):
                if found[run[k][0]][0] == OUT:
                    words += uncovered([w for _, w in run[k + 1 : end]], covered[k + 1 : end], depth)  # without the token of the block's place
        if len(words) >= own * whole:
            break
    return " ".join(words)


def main_text(page: str | None, shared: dict[int, int], depth: int = 6) -> str:
    """A page's main text, given which of its suffixes and blocks are the host's, and on how many distinct pages."""
    found = blocks(page)
    article = article_text(found, shared, depth)
    return unique_text(found, shared, depth) if article is None else article


def extract(pages: DataFrame, depth: int = 6, least: int = 5, share: float = 0.5, sent: int = 1 << 20) -> DataFrame:
    """page_id, url, text, n_chars and n_shared of every page (page_id, url, html).

    A null html counts as empty; an empty page, or one without article text, has text ''. A page whose url is null or
    has no host shares the host ''. Repeated rows stay, and count as one page. n_shared is the number of suffixes and blocks
    of a page's text that are the host's. What is shared goes to all executors up to `sent` suffixes in all, beyond
    that the pages are shuffled to it. Extra columns are ignored.
    """
    spark = pages.sparkSession
    base = pages.select("page_id", "url", "html", F.xxhash64("page_id", "url", "html").alias("page"))
    host = F.xxhash64(F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1)))
    fields = {"outside": ArrayType(LongType()), "inside": ArrayType(LongType()), "key": LongType(), "article": LongType(), "has_article": BooleanType()}

    def read(rows):
        made = [read_page(x, depth) for x in rows]
        return [[r[k] for r in made] for k in fields]

    # hashes alone are written: pages are parsed again for their text, which is cheaper than keeping all texts in between
    folder = f"{shared_folder(spark)}/suffixes-{uuid.uuid4().hex}"
    added(base.select("page", host.alias("host"), "html"), "html", read, fields).drop("html").write.parquet(folder)
    seen = spark.read.parquet(folder)
    counts = lambda rows: rows.groupBy("host", "suffix").agg(F.count("*").cast("int").alias("n"))
    common = counts(seen.dropDuplicates(["host", "key"]).select("host", F.explode("outside").alias("suffix"))).where("n > 1")
    articles = seen.where("has_article").select("host", "article", "inside").dropDuplicates(["host", "article"])
    hosts = articles.groupBy("host").agg(F.count("*").alias("articles"))
    standing = counts(articles.select("host", F.explode("inside").alias("suffix"))).where(F.col("n") >= least)
    standing = standing.join(hosts, "host").where(F.col("n") >= share * F.col("articles")).drop("articles")
    hits = seen.where("not has_article").select("page", "host", F.explode("outside").alias("suffix")).join(common, ["host", "suffix"])
    hits = hits.unionByName(seen.select("page", "host", F.explode("inside").alias("suffix")).join(standing, ["host", "suffix"]))
    hits = cut(hits.groupBy("page").agg(F.collect_set(F.struct("suffix", "n")).alias("shared")))
    remove(spark, folder)
    few = (hits.agg(F.sum(F.size("shared") + 4)).first()[0] or 0) <= sent
    joined = base.join(F.broadcast(hits) if few else hits, "page", "left").select("page_id", "url", F.struct("html", "shared").alias("row"))

    def write(rows):
        text = [main_text(r["html"], {x["suffix"]: x["n"] for x in r["shared"] or ()}, depth) for r in rows]
        return [text, [len(r["shared"] or ()) for r in rows]]

    out = added(joined, "row", write, {"text": StringType(), "n_shared": LongType()}).drop("row")
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "n_shared")


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return extract(table(spark, sf_dir, "pages"))
