"""URL functions as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def host(url: Column) -> Column:
    """Lower-case host of an absolute http(s) URL, '' if there is none."""
    return F.lower(F.regexp_extract(url, r"^https?://([^/:?#]+)", 1))


def origin(url: Column) -> Column:
    """Scheme, host and port."""
    return F.lower(F.regexp_extract(url, r"^(https?://[^/?#]+)", 1))


def path(url: Column) -> Column:
    """Path of an absolute URL without query, fragment and trailing slashes; '/' for the root."""
    bare = F.regexp_replace(F.regexp_replace(url, r"^https?://[^/?#]*", ""), r"[?#].*$", "")
    bare = F.regexp_replace(bare, "/+$", "")
    return F.when(bare == "", "/").otherwise(bare)


def resolve(href: Column, base: Column) -> Column:
    """href made absolute against base: absolute, scheme-relative, rooted, query, fragment and relative forms."""
    bare = F.regexp_replace(base, r"[?#].*$", "")
    folder = F.when(F.length(F.regexp_replace(bare, r"^https?://[^/]*", "")) == 0, F.concat(bare, F.lit("/"))).otherwise(F.regexp_replace(bare, "/[^/]*$", "/"))
    return (
        F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), href)
        .when(href.startswith("//"), F.concat(F.regexp_extract(base, r"^(https?:)", 1), href))
        .when(href.startswith("/"), F.concat(origin(base), href))
        .when(href.startswith("?"), F.concat(bare, href))
        .when(href.startswith("#"), F.concat(F.regexp_replace(base, "#.*$", ""), href))
        .when(href == "", base)
        .otherwise(F.concat(folder, F.regexp_replace(href, r"^(\./)+", "")))
    )


def internal_path(href: Column, base: Column) -> Column:
    """Path of a link that stays on base's origin; null for fragments, mail, telephone and script links."""
    full = resolve(href, base)
    usable = (F.length(href) > 0) & ~href.rlike(r"(?i)^(#|mailto:|tel:|javascript:)")
    return F.when(usable & (origin(full) == origin(base)), path(full))


def crawl_form(href: Column, base: Column) -> Column:
    """The URL that a link leads to, as a crawl tells pages apart: absolute, without fragment, its path without a last slash (but /)."""
    full = F.regexp_replace(resolve(href, base), "#.*$", "")
    rooted = F.regexp_replace(full, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?]+)(\?|$)", "$1/$2")
    return F.regexp_replace(rooted, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?]+/[^?]*[^/?])/(\?|$)", "$1$2")


def crawlable(href: Column) -> Column:
    """Whether a link is worth following: no fragment, mail or telephone link, and no asset."""
    asset = r"(?i)\.(png|jpe?g|gif|svg|webp|avif|ico|css|js|pdf|zip|mp4|mp3|woff2?|ttf|xml|json)([?#]|$)"
    return ~href.rlike(r"(?i)^(#|mailto:|tel:|javascript:)") & ~href.rlike(asset)


def domain(text: Column) -> Column:
    """A domain in normal form: no scheme, www, port or path, lower case; null if it has no dot."""
    d = F.lower(F.trim(text))
    for pattern in (r"^[a-z][a-z0-9+.-]*://", r"[/?#].*$", r":\d+$", r"^www\."):
        d = F.regexp_replace(d, pattern, "")
    return F.when(d.contains("."), d)


def unsafe_reason(url: Column) -> Column:
    """Why a URL must not be fetched (scheme, blocked host, private or reserved address), null if it may."""
    h = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^@/?#]*@)?(\[[^\]]*\]|[^/:?#]*)", 1))
    quads = F.split(h, r"\.")
    is_ip = h.rlike(r"^\d{1,3}(\.\d{1,3}){3}$")
    part = lambda k: F.get(quads, k).try_cast("int")
    a, b = part(0), part(1)
    private = (
        a.isin(0, 10, 127) | (a >= 224) | ((a == 169) & (b == 254)) | ((a == 172) & b.between(16, 31)) | ((a == 192) & b.isin(168, 0))
        | ((a == 100) & b.between(64, 127)) | ((a == 198) & b.isin(18, 19))
    )
    return (
        F.when(url.isNull() | ~F.coalesce(url, F.lit("")).rlike(r"(?i)^https?://"), "scheme")
        .when(h == "", "no host")
        .when(h.isin("localhost", "metadata.google.internal", "metadata") | h.rlike(r"\.(localhost|local|internal|lan|home|corp)$"), "blocked host")
        .when(is_ip & private, "private address")
        .when(h.startswith("[") & h.rlike(r"^\[(::1?|f[cd][0-9a-f:]*|fe[89ab][0-9a-f:]*|::ffff:.*)\]$"), "private address")
    )
