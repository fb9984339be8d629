"""Addresses, guards, retries and errors as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from silkpage.config import BACKOFF_MS, CONTENT_TYPES, RETRY_CAP_MS, WALL_CLOCK_MS
from silkpage.functions.urls import host_of, is_absolute, scheme_of

V4 = r"^(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(\.(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)){3}$"
V6 = r"^[0-9a-fA-F:.]*:[0-9a-fA-F:.]*$"


def _v4_reason(ip: Column) -> Column:
    o = F.split(ip, r"\.")
    a, b = F.get(o, F.lit(0)).try_cast("int"), F.get(o, F.lit(1)).try_cast("int")
    return F.when(
        ip.rlike(V4),
        F.when(a == 0, "unspecified/this-network (0.0.0.0/8)")
        .when(a == 10, "private (10.0.0.0/8)")
        .when(a == 127, "loopback (127.0.0.0/8)")
        .when((a == 169) & (b == 254), "link-local, incl. cloud metadata (169.254.0.0/16)")
        .when((a == 172) & b.between(16, 31), "private (172.16.0.0/12)")
        .when((a == 192) & (b == 168), "private (192.168.0.0/16)")
        .when((a == 192) & (b == 0), "IETF protocol assignments (192.0.0.0/16)")
        .when((a == 100) & b.between(64, 127), "CGNAT (100.64.0.0/10)")
        .when(a >= 224, "multicast/reserved (224.0.0.0/4, 240.0.0.0/4)"),
    )


def _hex(x: Column) -> Column:
    return F.conv(x, 16, 10).try_cast("int")


def ip_block_reason(ip: Column) -> Column:
    """Why an address must not be fetched; null if it may. Mapped addresses are judged as
    the IPv4 address that they hold, dotted or in hexadecimal."""
    low = F.lower(ip)
    dotted = F.regexp_extract(low, r"^::ffff:(\d+\.\d+\.\d+\.\d+)$", 1)
    hi, lo = F.regexp_extract(low, r"^::ffff:([0-9a-f]{1,4}):([0-9a-f]{1,4})$", 1), F.regexp_extract(low, r"^::ffff:([0-9a-f]{1,4}):([0-9a-f]{1,4})$", 2)
    h, l2 = _hex(hi), _hex(lo)
    as_v4 = F.concat_ws(".", *[x.cast("int").cast("string") for x in (F.floor(h / 256), h % 256, F.floor(l2 / 256), l2 % 256)])
    mapped = F.when(dotted != "", dotted).when(hi != "", as_v4)
    head = _hex(F.regexp_extract(low, r"^([0-9a-f]*):", 1))
    v6 = (
        F.when(mapped.isNotNull(), F.concat(F.lit("IPv4-mapped "), _v4_reason(mapped)))
        .when(low == "::", "unspecified (::)")
        .when(low == "::1", "loopback (::1)")
        .when(head.bitwiseAND(0xFE00) == 0xFC00, "unique local address (fc00::/7)")
        .when(head.bitwiseAND(0xFFC0) == 0xFE80, "link-local (fe80::/10)")
        .when(head.bitwiseAND(0xFF00) == 0xFF00, "multicast (ff00::/8)")
    )
    return F.coalesce(_v4_reason(ip), F.when(ip.rlike(V6), v6))


def bare_host(url: Column) -> Column:
    return F.regexp_replace(host_of(url), r"^\[|\]$", "")


def url_guard(url: Column) -> Column:
    """The code why a URL may not be submitted, null if it may: scheme, credentials,
    private literal address, name without a dot or under .local."""
    any_scheme = F.coalesce(url.rlike(r"^[a-zA-Z][a-zA-Z0-9+.\-]*:"), F.lit(False))
    host = bare_host(url)
    is_ip = host.rlike(V4) | host.rlike(V6)
    creds = F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.\-]*://([^/?#@]*)@", 1)
    scheme = F.lower(F.regexp_extract(url, r"^([a-zA-Z][a-zA-Z0-9+.\-]*):", 1))
    return (
        F.when(~any_scheme, "url_invalid")
        .when(~scheme.isin("http", "https"), "url_scheme_blocked")
        .when(~is_absolute(url) | (host == ""), "url_invalid")
        .when(creds != "", "url_credentials_blocked")
        .when(is_ip & ip_block_reason(host).isNotNull(), "url_private_address")
        .when(~is_ip & (~host.contains(".") | host.endswith(".local")), "url_non_public_host")
    )


def retry_after_ms(header: Column, fallback: Column, now: Column, cap: int = RETRY_CAP_MS) -> Column:
    """Milliseconds that a 429 asks for: seconds or an HTTP date; else the fallback; capped."""
    secs = F.when(F.trim(header) == "", 0.0).otherwise(F.trim(header).try_cast("double")) * 1000
    date = F.try_to_timestamp(F.regexp_replace(header, r"^\w{3}, ", ""), F.lit("dd MMM yyyy HH:mm:ss z"))
    asked = F.coalesce(secs.cast("bigint"), F.unix_millis(date) - F.unix_millis(now))
    usable = header.isNotNull() & (header != "") & (asked >= 0)
    return F.least(F.when(usable, asked).otherwise(fallback), F.lit(cap)).cast("bigint")


def backoff_ms(attempt: Column, base: int = BACKOFF_MS) -> Column:
    return (F.lit(base) * F.pow(F.lit(2), attempt)).cast("bigint")


def fetch_error(code: Column, message: Column, name: Column) -> Column:
    code, message, name = (F.coalesce(c, F.lit("")) for c in (code, message, name))
    return (
        F.when(F.concat(code, F.lit(" "), message).rlike("(?i)CERT|certificate|altname|self.signed|UNABLE_TO_VERIFY"), "cert_error")
        .when(code.rlike("(?i)ENOTFOUND|EAI_AGAIN"), "dns_error")
        .when(code.rlike("(?i)ECONNREFUSED"), "connection_refused")
        .when(code.rlike("(?i)ECONNRESET|EPIPE"), "connection_reset")
        .when(message.rlike("(?i)abort") | name.isin("AbortError", "TimeoutError"), "timeout")
        .otherwise("error")
    )


def content_type(path: Column) -> Column:
    name = F.substring_index(path, "/", -1)
    ext = F.lower(F.regexp_extract(name, r"^.+(\.[^.]*)$", 1))
    out = F.when(F.lit(False), "")
    for k, v in CONTENT_TYPES.items():
        out = out.when(ext == k, v)
    return out.otherwise("application/octet-stream")


def http_status(kind: Column) -> Column:
    """Status of an error by its kind."""
    return F.when(kind.isin("validation", "blocked_url", "body_not_json"), 400).when(kind == "body_too_large", 413).otherwise(500)


def wall_clock_ms(kind: Column) -> Column:
    return F.when(kind == "scan", WALL_CLOCK_MS["scan"]).when(kind == "shot", WALL_CLOCK_MS["shot"]).otherwise(WALL_CLOCK_MS["crawl"])


def job_id(ms: Column, random_hex: Column) -> Column:
    """Sortable id: base-36 milliseconds, nine wide, and ten hexadecimal digits."""
    return F.concat(F.lpad(F.lower(F.conv(ms.cast("string"), 10, 36)), 9, "0"), F.lit("-"), F.substring(random_hex, 1, 10))
