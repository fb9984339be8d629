"""URL functions: Column expressions for absolute URLs, and a resolver for any reference.

The Column forms are exact for absolute http(s) URLs whose parts need no re-encoding;
`resolve` (Arrow-batched as `resolve_udf`) handles relative references and encoding.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from urllib.parse import quote

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from silkpage.config import EXCLUDED_PATHS, SECOND_LEVEL, TRACKING_PARAMS

URL_RE = r"^([a-zA-Z][a-zA-Z0-9+.\-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?(#.*)?$"


def _part(url: Column, k: int) -> Column:
    return F.regexp_extract(url, URL_RE, k)


def is_absolute(url: Column) -> Column:
    return F.coalesce(url.rlike(URL_RE), F.lit(False))


def scheme_of(url: Column) -> Column:
    return F.lower(_part(url, 1))


def host_of(url: Column) -> Column:
    """Lower-cased host without credentials and port; null for what is no absolute URL."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(_part(url, 2)), r"^[^@]*@", ""), r":\d+$", "")
    return F.when(is_absolute(url), plain)


def path_of(url: Column) -> Column:
    p = _part(url, 3)
    return F.when(is_absolute(url), F.when(p == "", "/").otherwise(p))


def query_of(url: Column) -> Column:
    return F.regexp_replace(_part(url, 4), r"^\?", "")


def origin_of(url: Column) -> Column:
    return F.concat(scheme_of(url), F.lit("://"), F.lower(_part(url, 2)))


def normalize_url(url: Column) -> Column:
    """Without fragment, tracking parameters, index page, doubled and trailing slashes."""
    pairs = F.filter(F.split(query_of(url), "&"), lambda p: (p != "") & ~F.regexp_extract(p, r"^([^=]*)", 1).isin(*TRACKING_PARAMS))
    query = F.array_join(pairs, "&")
    path = F.regexp_replace(F.regexp_replace(path_of(url), r"(?i)/index\.html?$", "/"), r"/{2,}", "/")
    bare = F.when((query == "") & (path != "/"), F.regexp_replace(path, r"/$", "")).otherwise(path)
    return F.when(is_absolute(url), F.concat(origin_of(url), bare, F.when(query == "", "").otherwise(F.concat(F.lit("?"), query))))


def _slug(path: Column, size: int, empty: str, blank: str) -> Column:
    base = F.regexp_replace(path, r"^/|/$", "")
    base = F.when(base == "", empty).otherwise(base)
    cut = F.substring(F.regexp_replace(F.regexp_replace(F.lower(base), r"[^a-z0-9]+", "-"), r"^-+|-+$", ""), 1, size)
    return F.when(cut == "", blank).otherwise(cut)


def slug_base(url: Column) -> Column:
    return _slug(path_of(url), 60, "home", "page")


def scan_slug_base(url: Column) -> Column:
    return F.coalesce(_slug(path_of(url), 50, "home", "home"), F.lit("page"))


def politeness_key(url: Column) -> Column:
    """The last two labels of the host, three below a two-label suffix; else the input."""
    host = host_of(url)
    labels = F.split(host, r"\.")
    two = F.array_join(F.slice(labels, -2, 2), ".")
    long = F.when(two.isin(*SECOND_LEVEL), F.array_join(F.slice(labels, -3, 3), ".")).otherwise(two)
    return F.coalesce(F.when(F.size(labels) <= 2, host).when(host.isNotNull(), long), url)


def norm_path(url: Column) -> Column:
    return F.coalesce(F.concat(F.regexp_replace(host_of(url), r"^www\.", ""), F.regexp_replace(path_of(url), "/$", "")), url)


def slug_from_url(url: Column) -> Column:
    bare = F.regexp_replace(F.regexp_replace(host_of(url), r"^www\.", ""), r"(?i)[^a-z0-9]+", "-")
    return F.coalesce(F.regexp_replace(bare, r"^-+|-+$", ""), F.substring(F.regexp_replace(url, r"(?i)[^a-z0-9]+", "-"), 1, 60))


def only_ext(src: Column) -> Column:
    """Lower-cased text after the last dot, before ? and #; all of it where there is no dot."""
    return F.lower(F.substring_index(F.substring_index(F.substring_index(src, "?", 1), "#", 1), ".", -1))


def host_allowed(url: Column, domains: Sequence[str]) -> Column:
    return F.coalesce(host_of(url).isin(*[d.lower() for d in domains]), F.lit(False)) if domains else F.lit(False)


def path_excluded(url: Column, patterns: Sequence[str] = EXCLUDED_PATHS) -> Column:
    """Lower-cased prefix match; what is no URL counts as excluded."""
    hit = F.lit(False)
    for p in patterns:
        hit = hit | F.lower(path_of(url)).startswith(p.lower())
    return F.coalesce(hit, F.lit(True))


def robots_blocked(url: Column, disallow: Column) -> Column:
    """Case-sensitive prefix match against an array of paths; what is no URL is not blocked."""
    return F.coalesce(F.exists(disallow, lambda d: path_of(url).startswith(d)), F.lit(False))


def link_type(href: Column, origin: Column) -> Column:
    return (
        F.when(href.startswith("mailto:"), "email").when(href.startswith("tel:"), "phone").when(~href.startswith(origin), "external").otherwise("internal")
    )


def link_tier(region: Column) -> Column:
    return F.when(region.isin("header", "navigation", "footer"), 0).otherwise(1)


# ------------------------------------------------------------- any reference

_ABSOLUTE = re.compile(r"^([a-zA-Z][a-zA-Z0-9+.\-]*):(.*)$", re.S)
_DEFAULT_PORT = {"http": "80", "https": "443"}
_PATH_SAFE = "!$&'()*+,-./:;=@_~%|[]^\\"


def _encode(s: str, safe: str) -> str:
    return "".join(c if c.isascii() and (c.isalnum() or c in safe) else quote(c, safe="") for c in s)


def _dots(path: str) -> str:
    out: list[str] = []
    parts = path.split("/")
    for i, p in enumerate(parts):
        last = i == len(parts) - 1
        low = p.lower().replace("%2e", ".")
        if low == "..":
            if len(out) > 1:
                out.pop()
            if last:
                out.append("")
        elif low == ".":
            if last:
                out.append("")
        else:
            out.append(p)
    return "/".join(out)


def resolve(ref: str | None, base: str | None = None) -> str | None:
    """An absolute, canonical URL for a reference, or null where there is none."""
    if ref is None:
        return None
    ref = re.sub(r"[\t\n\r]", "", ref.strip("".join(map(chr, range(33)))))
    m = _ABSOLUTE.match(ref)
    if m and m[1].lower() not in _DEFAULT_PORT:
        return m[1].lower() + ":" + _encode(m[2], _PATH_SAFE + "?#")
    if m:
        scheme, rest = m[1].lower(), m[2].replace("\\", "/").lstrip("/")
        rest = "//" + rest
    else:
        if base is None:
            return None
        b = re.match(URL_RE, base)
        if not b:
            return None
        scheme = b[1].lower()
        body, _, frag = ref.partition("#")
        frag = "#" + frag if "#" in ref else ""
        body, _, query = body.partition("?")
        query = "?" + query if "?" in ref.partition("#")[0] else ""
        body = body.replace("\\", "/")
        if body.startswith("//"):
            rest = body + query + frag
        elif body.startswith("/"):
            rest = "//" + b[2] + body + query + frag
        elif body:
            rest = "//" + b[2] + (b[3].rpartition("/")[0] + "/" if "/" in b[3] else "/") + body + query + frag
        elif query:
            rest = "//" + b[2] + b[3] + query + frag
        else:
            rest = "//" + b[2] + b[3] + (b[4] or "") + frag
    m = re.match(r"^//([^/?#]*)([^?#]*)(\?[^#]*)?(#.*)?$", rest, re.S)
    if not m:
        return None
    creds, at, host = m[1].rpartition("@")
    host = host.lower()
    name, colon, port = host.rpartition(":") if re.search(r":\d*$", host) else (host, "", "")
    try:
        name = name if name.isascii() else name.encode("idna").decode()
    except UnicodeError:
        return None
    if not name or re.search(r"[\s<>^|%]", name) or (colon and port and int(port) > 65535):
        return None
    if port and port != _DEFAULT_PORT[scheme]:
        name += ":" + str(int(port))
    path = _dots(_encode(m[2] or "/", _PATH_SAFE))
    query = _encode(m[3] or "", _PATH_SAFE + "?")
    frag = _encode(m[4] or "", _PATH_SAFE + "?#")
    return f"{scheme}://{creds + at}{name}{path if path.startswith('/') else '/' + path}{query}{frag}"


def normalize(raw: str | None, base: str | None = None) -> str | None:
    """normalize_url for any reference."""
    u = resolve(raw, base)
    m = re.match(URL_RE, u) if u else None
    if not m:
        return None
    pairs = [p for p in (m[4] or "")[1:].split("&") if p and p.partition("=")[0] not in TRACKING_PARAMS]
    path = re.sub(r"/{2,}", "/", re.sub(r"/index\.html?$", "/", m[3] or "/", flags=re.I))
    if pairs:
        return f"{m[1]}://{m[2]}{path}?{'&'.join(pairs)}"
    return f"{m[1]}://{m[2]}{path[:-1] if path.endswith('/') and path != '/' else path}"


@F.pandas_udf(T.StringType())
def resolve_udf(ref: pd.Series, base: pd.Series) -> pd.Series:
    return pd.Series([resolve(r, b) for r, b in zip(ref, base, strict=True)], dtype=object)


@F.pandas_udf(T.StringType())
def normalize_udf(ref: pd.Series, base: pd.Series) -> pd.Series:
    return pd.Series([normalize(r, b) for r, b in zip(ref, base, strict=True)], dtype=object)
