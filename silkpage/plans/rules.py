"""Queries over rule inputs (probes, jobs, requests, ...), with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from silkpage import config as K
from silkpage.functions import net as N
from silkpage.functions import urls as U
from silkpage.operators import crawl as C
from silkpage.operators import jobs as J
from silkpage.operators import parity as P
from silkpage.operators import scan as S
from silkpage.operators import validate as V
from silkpage.plans import fixtures as X
from silkpage.plans.pages import _IN, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def add(name: str, sql: str, *fixtures: X.Fixture):
    """Register a query on fixtures (given as DataFrames) and its SQL on the same rows."""

    def put(f):
        QUERIES[name] = lambda spark, sf_dir: f(*[x.df(spark) for x in fixtures]) if fixtures else f(spark, sf_dir)
        if sql:
            head = ", ".join(x.sql for x in fixtures)
            SQL[name] = (f"WITH RECURSIVE {head}" + (", " if sql.lstrip().startswith("%") else " ") + sql.lstrip().lstrip("%")) if fixtures else sql
        return f

    return put


V4 = r"^(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(\.(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)){3}$"


def _v4_sql(ip: str) -> str:
    a, b = f"TRY_CAST(split_part({ip}, '.', 1) AS INT)", f"TRY_CAST(split_part({ip}, '.', 2) AS INT)"
    return f"""CASE WHEN NOT regexp_matches({ip}, '{V4}') THEN NULL WHEN {a} = 0 THEN 'unspecified/this-network (0.0.0.0/8)' WHEN {a} = 10 THEN 'private (10.0.0.0/8)'
 WHEN {a} = 127 THEN 'loopback (127.0.0.0/8)' WHEN {a} = 169 AND {b} = 254 THEN 'link-local, incl. cloud metadata (169.254.0.0/16)' WHEN {a} = 172 AND {b} BETWEEN 16 AND 31 THEN 'private (172.16.0.0/12)'
 WHEN {a} = 192 AND {b} = 168 THEN 'private (192.168.0.0/16)' WHEN {a} = 192 AND {b} = 0 THEN 'IETF protocol assignments (192.0.0.0/16)' WHEN {a} = 100 AND {b} BETWEEN 64 AND 127 THEN 'CGNAT (100.64.0.0/10)'
 WHEN {a} >= 224 THEN 'multicast/reserved (224.0.0.0/4, 240.0.0.0/4)' END"""


def _ip_sql(ip: str) -> str:
    low = f"lower({ip})"
    hx = lambda e: f"TRY_CAST('0x' || {e} AS INT)"
    h = hx(f"regexp_extract({low}, '^::ffff:([0-9a-f]{{1,4}}):([0-9a-f]{{1,4}})$', 1)")
    l2 = hx(f"regexp_extract({low}, '^::ffff:([0-9a-f]{{1,4}}):([0-9a-f]{{1,4}})$', 2)")
    mapped = rf"""CASE WHEN regexp_matches({low}, '^::ffff:\d+\.\d+\.\d+\.\d+$') THEN substr({low}, 8)
 WHEN regexp_matches({low}, '^::ffff:[0-9a-f]{{1,4}}:[0-9a-f]{{1,4}}$') THEN ({h} // 256)::VARCHAR || '.' || ({h} % 256)::VARCHAR || '.' || ({l2} // 256)::VARCHAR || '.' || ({l2} % 256)::VARCHAR END"""
    head = hx(f"regexp_extract({low}, '^([0-9a-f]*):', 1)")
    return f"""coalesce({_v4_sql(ip)}, CASE WHEN NOT regexp_matches({ip}, '^[0-9a-fA-F:.]*:[0-9a-fA-F:.]*$') THEN NULL
 WHEN ({mapped}) IS NOT NULL THEN 'IPv4-mapped ' || ({_v4_sql(f"({mapped})")}) WHEN {low} = '::' THEN 'unspecified (::)' WHEN {low} = '::1' THEN 'loopback (::1)'
 WHEN ({head} & 65024) = 64512 THEN 'unique local address (fc00::/7)' WHEN ({head} & 65472) = 65152 THEN 'link-local (fe80::/10)' WHEN ({head} & 65280) = 65280 THEN 'multicast (ff00::/8)' END)"""


_HOST = r"regexp_replace(regexp_replace(regexp_replace(lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.\-]*://([^/?#]*)', 1)), '^[^@]*@', ''), ':\d+$', ''), '^\[|\]$', '', 'g')"


@add("ip_guard", f"SELECT ip, {_ip_sql('ip')} AS reason FROM guard_ips", X.GUARD_IPS)
def ip_guard(ips):
    return ips.select("ip", N.ip_block_reason(F.col("ip")).alias("reason"))


@add(
    "url_guard",
    rf"""%g AS (SELECT url, {_HOST} AS host, lower(regexp_extract(url, '^([a-zA-Z][a-zA-Z0-9+.\-]*):', 1)) AS scheme FROM guard_urls),
f AS (SELECT *, regexp_matches(host, '{V4}') OR regexp_matches(host, '^[0-9a-fA-F:.]*:[0-9a-fA-F:.]*$') AS is_ip, {_ip_sql("host")} AS why FROM g)
SELECT url, CASE WHEN NOT regexp_matches(url, '^[a-zA-Z][a-zA-Z0-9+.\-]*:') THEN 'url_invalid' WHEN scheme NOT IN ('http', 'https') THEN 'url_scheme_blocked' WHEN host = '' THEN 'url_invalid'
 WHEN regexp_matches(url, '^[a-zA-Z]+://[^/?#@]+@') THEN 'url_credentials_blocked' WHEN is_ip AND why IS NOT NULL THEN 'url_private_address'
 WHEN NOT is_ip AND (NOT contains(host, '.') OR host LIKE '%.local') THEN 'url_non_public_host' END AS code FROM f""",
    X.GUARD_URLS,
)
def url_guard(urls):
    return urls.select("url", N.url_guard(F.col("url")).alias("code"))


@add(
    "dns_guard",
    f"SELECT h.host, CASE WHEN count(address) = 0 THEN 'url_dns_failed' WHEN bool_or(({_ip_sql('address')}) IS NOT NULL) THEN 'url_private_address' END AS code FROM dns_hosts h LEFT JOIN dns_answers a ON h.host = a.host GROUP BY h.host",
    X.DNS_HOSTS,
    X.DNS_ANSWERS,
)
def dns_guard(hosts, answers):
    blocked = F.bool_or(N.ip_block_reason(F.col("address")).isNotNull())
    return hosts.join(answers, "host", "left").groupBy("host").agg(F.when(F.count("address") == 0, "url_dns_failed").when(blocked, "url_private_address").alias("code"))


@add(
    "retry_after",
    r"""%d AS (SELECT *, coalesce((TRY_CAST(CASE WHEN trim(header) = '' THEN '0' ELSE trim(header) END AS DOUBLE) * 1000)::BIGINT,
  epoch_ms(TRY_STRPTIME(regexp_replace(header, '^\w{3}, ', ''), '%d %b %Y %H:%M:%S GMT')) - epoch_ms(now)) AS asked FROM retry)
SELECT header, fallback_ms, least(CASE WHEN header IS NOT NULL AND header <> '' AND asked >= 0 THEN asked ELSE fallback_ms END, 60000) AS wait_ms FROM d""",
    X.RETRY,
)
def retry_after(rows):
    return rows.select("header", "fallback_ms", N.retry_after_ms(F.col("header"), F.col("fallback_ms"), F.col("now")).alias("wait_ms"))


@add("backoff", "SELECT range::INT AS attempt, (2000 * pow(2, range))::BIGINT AS wait_ms FROM range(0, 6)")
def backoff(spark, sf_dir):
    return spark.range(6).select(F.col("id").cast("int").alias("attempt"), N.backoff_ms(F.col("id")).alias("wait_ms"))


@add(
    "fetch_error",
    r"""SELECT code, message, name, CASE WHEN regexp_matches(coalesce(code, '') || ' ' || coalesce(message, ''), '(?i)CERT|certificate|altname|self.signed|UNABLE_TO_VERIFY') THEN 'cert_error'
 WHEN regexp_matches(coalesce(code, ''), '(?i)ENOTFOUND|EAI_AGAIN') THEN 'dns_error' WHEN regexp_matches(coalesce(code, ''), '(?i)ECONNREFUSED') THEN 'connection_refused'
 WHEN regexp_matches(coalesce(code, ''), '(?i)ECONNRESET|EPIPE') THEN 'connection_reset' WHEN regexp_matches(coalesce(message, ''), '(?i)abort') OR name IN ('AbortError', 'TimeoutError') THEN 'timeout' ELSE 'error' END AS kind FROM fetch_errors""",
    X.FETCH_ERRORS,
)
def fetch_error(rows):
    return rows.select("code", "message", "name", N.fetch_error(F.col("code"), F.col("message"), F.col("name")).alias("kind"))


@add(
    "content_type",
    "SELECT path, CASE lower(regexp_extract(regexp_extract(path, '[^/]*$'), '^.+(\\.[^.]*)$', 1)) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in K.CONTENT_TYPES.items()) + " ELSE 'application/octet-stream' END AS content_type FROM paths",
    X.PATHS,
)
def content_type(rows):
    return rows.select("path", N.content_type(F.col("path")).alias("content_type"))


@add("error_status", "SELECT kind, CASE WHEN kind IN ('validation', 'blocked_url', 'body_not_json') THEN 400 WHEN kind = 'body_too_large' THEN 413 ELSE 500 END AS status, CASE kind WHEN 'scan' THEN 3600000 WHEN 'shot' THEN 120000 ELSE 900000 END AS wall_ms FROM (VALUES ('validation'), ('blocked_url'), ('body_too_large'), ('body_not_json'), ('other'), ('scan'), ('shot')) t(kind)")
def error_status(spark, sf_dir):
    rows = spark.createDataFrame([(k,) for k in ("validation", "blocked_url", "body_too_large", "body_not_json", "other", "scan", "shot")], "kind string")
    return rows.select("kind", N.http_status(F.col("kind")).alias("status"), N.wall_clock_ms(F.col("kind")).alias("wall_ms"))


@add("job_ids", "SELECT range AS ms, lpad(lower(to_base(range, 36)), 9, '0') || '-' || substr(md5(range::VARCHAR), 1, 10) AS job_id FROM range(1700000000000, 1700000000050)")
def job_ids(spark, sf_dir):
    ms = F.col("id")
    return spark.range(1700000000000, 1700000000050).select(ms.alias("ms"), N.job_id(ms, F.md5(ms.cast("string"))).alias("job_id"))


_ROBOTS_SQL = r"""%l0 AS (SELECT origin, unnest(range(len(string_split(replace(body, chr(13), ''), chr(10))))) AS n, trim(unnest(string_split(replace(body, chr(13), ''), chr(10)))) AS line FROM robots),
l1 AS (SELECT *, lower(trim(split_part(line, ':', 1))) AS k, CASE WHEN contains(line, ':') THEN trim(substr(line, strpos(line, ':') + 1)) ELSE '' END AS v FROM l0 WHERE line <> '' AND line NOT LIKE '#%'),
l2 AS (SELECT *, last_value(CASE WHEN k = 'user-agent' THEN v END IGNORE NULLS) OVER (PARTITION BY origin ORDER BY n) AS agent FROM l1),
rr AS (SELECT origin, n::INT AS n, k AS kind, v AS value FROM l2 WHERE k = 'sitemap' OR (k = 'disallow' AND agent = '*' AND v <> ''))"""


@add("robots_rules", _ROBOTS_SQL + " SELECT * FROM rr", X.ROBOTS)
def robots_rules(robots):
    return C.robots_lines(robots)


@add(
    "robots_block",
    _ROBOTS_SQL + r""", p AS (SELECT origin, url, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path FROM robot_urls)
SELECT p.url, coalesce(bool_or(kind = 'disallow' AND p.path <> '' AND starts_with(p.path, value)), false) AS blocked FROM p LEFT JOIN rr ON p.origin = rr.origin GROUP BY p.url""",
    X.ROBOTS,
    X.ROBOT_URLS,
)
def robots_block(robots, urls):
    rules = C.robots_lines(robots).filter("kind = 'disallow'").groupBy("origin").agg(F.collect_list("value").alias("rules"))
    none = F.array().cast("array<string>")
    return urls.join(rules, "origin", "left").select("url", U.robots_blocked(F.col("url"), F.coalesce("rules", none)).alias("blocked"))


@add(
    "sitemap_walk",
    r"""%w(site, url, depth) AS (SELECT site, url, 0 FROM sitemap_roots UNION SELECT w.site, trim(unnest(regexp_extract_all(m.xml, '(?i)<loc>\s*([^<]+?)\s*</loc>', 1))), depth + 1
 FROM w JOIN sitemaps m ON w.url = m.url WHERE depth < 3 AND regexp_matches(m.xml, '(?i)<sitemapindex'))
SELECT DISTINCT site, unnest(regexp_extract_all(m.xml, '(?i)<loc>\s*([^<]+?)\s*</loc>', 1)) AS loc FROM (SELECT DISTINCT site, url FROM w) w JOIN sitemaps m ON w.url = m.url WHERE NOT regexp_matches(m.xml, '(?i)<sitemapindex')""",
    X.SITEMAP_ROOTS,
    X.SITEMAPS,
)
def sitemap_walk(roots, maps):
    return C.walk_sitemaps(roots, maps)


@add(
    "sitemap_seed",
    "SELECT DISTINCT url FROM (SELECT 'http://x/1' AS url UNION ALL SELECT unnest(regexp_extract_all(xml, '(?i)<loc>\\s*([^<]+?)\\s*</loc>', 1)) FROM sitemaps WHERE NOT regexp_matches(xml, '(?i)<sitemapindex'))",
    X.SITEMAPS,
)
def sitemap_seed(maps):
    locs = maps.filter(~C.is_sitemap_index(F.col("xml"))).select(F.explode(C.sitemap_locs(F.col("xml"))).alias("url"))
    return locs.union(locs.sparkSession.createDataFrame([("http://x/1",)], "url string")).distinct()


_FOLLOW_SQL = """%mv AS (SELECT *, coalesce(status BETWEEN 300 AND 399 AND location IS NOT NULL AND error IS NULL, false) AS moves FROM hops),
en AS (SELECT *, coalesce(max(CASE WHEN moves THEN 0 ELSE 1 END) OVER (PARTITION BY site, scheme ORDER BY hop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ended FROM mv),
lastp AS (SELECT *, count(*) OVER (PARTITION BY site, scheme) AS n_hops, row_number() OVER (PARTITION BY site, scheme ORDER BY hop DESC) AS rn FROM en WHERE ended = 0 AND hop <= 5),
fo AS (SELECT site, scheme, CASE WHEN moves THEN 'too_many_redirects' ELSE error END AS error, CASE WHEN moves THEN location ELSE url END AS final_url,
  CASE WHEN moves OR error IS NOT NULL THEN 0 ELSE status END AS final_status, n_hops FROM lastp WHERE rn = 1),
fr AS (SELECT site, scheme, error IS NULL AND final_status > 0 AND final_status < 500 AS ok, final_url, final_status, n_hops, error FROM fo)"""


@add("redirect_resolve", _FOLLOW_SQL + " SELECT * FROM fr", X.HOPS)
def redirect_resolve(hops):
    return S.follow(hops)


@add(
    "preflight",
    _FOLLOW_SQL
    + """, pf AS (SELECT site, max(ok) FILTER (scheme = 'http') AS http_ok, max(final_url) FILTER (scheme = 'http') AS hu, max(error) FILTER (scheme = 'http') AS http_error,
  max(ok) FILTER (scheme = 'https') AS https_ok, max(final_url) FILTER (scheme = 'https') AS su, max(error) FILTER (scheme = 'https') AS https_error FROM fr GROUP BY site)
SELECT site, coalesce(http_ok AND lower(hu) LIKE 'https:%', false) AS http_lands_on_https, CASE WHEN https_ok THEN su WHEN http_ok THEN hu END AS browse_url,
  NOT (coalesce(https_ok, false) OR coalesce(http_ok, false)) AS dead, http_error, https_error FROM pf""",
    X.HOPS,
)
def preflight(hops):
    return S.preflight(hops)


_ANALYTIC = " OR ".join(f"contains(host, '{a}')" for a in K.ANALYTICS_HOSTS)


@add(
    "network_rollup",
    rf"""%r AS (SELECT *, regexp_replace(lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#]*)', 1)), ':\d+$', '') AS host FROM requests),
s AS (SELECT *, ({_ANALYTIC}) AS an, row_number() OVER (PARTITION BY site, host ORDER BY seq) AS sighting FROM r),
x AS (SELECT site, seq, 'analytics' AS kind, host AS value FROM s WHERE an AND sighting = 1
 UNION ALL SELECT site, min(seq), 'third_party', host FROM s WHERE NOT (an AND sighting = 1) AND NOT contains(host, site) GROUP BY site, host
 UNION ALL SELECT site, seq, 'mixed', substr(url, 1, 300) FROM s WHERE page_https AND url LIKE 'http://%' AND url NOT LIKE 'http://localhost%'
 UNION ALL SELECT site, seq, 'failed', substr(url, 1, 300) FROM s WHERE failure IS NOT NULL),
y AS (SELECT *, row_number() OVER (PARTITION BY site, kind ORDER BY seq, value) AS n FROM x)
SELECT site, kind, n::INT AS n, value FROM y WHERE n <= CASE kind WHEN 'third_party' THEN 25 WHEN 'mixed' THEN 20 WHEN 'failed' THEN 30 ELSE 1000000 END""",
    X.REQUESTS,
)
def network_rollup(requests):
    return S.network_rollup(requests)


_KEY = r"regexp_replace(regexp_replace(lower(regexp_extract({0}, '^[a-z]+://([^/?#]*)', 1)), '^www\.', '') || CASE WHEN regexp_extract({0}, '^[a-z]+://[^/?#]*([^?#]*)', 1) = '' THEN '/' ELSE regexp_extract({0}, '^[a-z]+://[^/?#]*([^?#]*)', 1) END, '/$', '')"
_GROUPS = [g for g, _ in K.PAGE_PATTERNS]


@add(
    "key_pages",
    rf"""%r AS (SELECT l.site, ord, href, {_KEY.format("href")} AS key, {_KEY.format("browse_url")} AS home, regexp_extract(href, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path FROM site_links l JOIN site_browse b ON l.site = b.site WHERE type = 'internal'),
k AS (SELECT * FROM r WHERE key <> home AND split_part(key, '/', 1) = split_part(home, '/', 1) AND NOT regexp_matches(path, '(?i)\.(pdf|jpg|jpeg|png|gif|zip|docx?)$')),
g1 AS (SELECT site, arg_min(key, ord) AS key, arg_min(href, ord) AS href FROM k WHERE regexp_matches(path, '(?i){K.PAGE_PATTERNS[0][1]}') GROUP BY site),
g2 AS (SELECT site, arg_min(key, ord) AS key, arg_min(href, ord) AS href FROM k WHERE regexp_matches(path, '(?i){K.PAGE_PATTERNS[1][1]}') AND NOT EXISTS (SELECT 1 FROM g1 WHERE g1.site = k.site AND g1.key = k.key) GROUP BY site),
g3 AS (SELECT site, arg_min(key, ord) AS key, arg_min(href, ord) AS href FROM k WHERE regexp_matches(path, '(?i){K.PAGE_PATTERNS[2][1]}') AND NOT EXISTS (SELECT 1 FROM (SELECT * FROM g1 UNION ALL SELECT * FROM g2) c WHERE c.site = k.site AND c.key = k.key) GROUP BY site)
SELECT site, '{_GROUPS[0]}' AS grp, href FROM g1 UNION ALL SELECT site, '{_GROUPS[1]}', href FROM g2 UNION ALL SELECT site, '{_GROUPS[2]}', href FROM g3""",
    X.SITE_LINKS,
    X.SITE_BROWSE,
)
def key_pages(links, browse):
    return S.key_pages(links, browse)


_CAND = r"""%c AS (SELECT *, lower(coalesce(nullif(slug, ''), nullif(id, ''), regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)), ':\d+$', ''), '^www\.', ''), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'))) AS site_id FROM candidates),
cd AS (SELECT ord, url, site_id, name FROM (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY ord) AS rn FROM c) WHERE rn = 1)"""


@add("scan_candidates", _CAND + " SELECT * FROM cd", X.CANDIDATES)
def scan_candidates(cands):
    return S.candidates(cands).select("ord", "url", "site_id", "name")


@add("scan_resume", _CAND + " SELECT ord, site_id FROM cd WHERE site_id NOT IN (SELECT id FROM scan_sites WHERE outcome IN ('ok', 'dead', 'blocked'))", X.CANDIDATES, X.SCAN_SITES)
def scan_resume(cands, done):
    return S.to_scan(S.candidates(cands), done).select("ord", "site_id")


@add("scan_outcomes", "SELECT coalesce(outcome, 'incomplete') AS outcome, count(*) AS n, sum(coalesce(pages, 0))::BIGINT AS pages FROM scan_sites GROUP BY 1", X.SCAN_SITES)
def scan_outcomes(sites):
    return S.rollup(sites)


@add(
    "site_outcome",
    "SELECT site, CASE WHEN error IS NOT NULL THEN 'error' WHEN refused IS NOT NULL THEN refused WHEN robots THEN 'robots_disallow' WHEN dead THEN 'dead' WHEN regexp_matches(title, '(?i)just a moment|attention required|checking your browser') THEN 'blocked' WHEN home_failed THEN 'timeout' ELSE 'ok' END AS outcome FROM outcomes",
    X.OUTCOMES,
)
def site_outcome(rows):
    return rows.select("site", S.outcome(*[F.col(c) for c in ("refused", "robots", "dead", "title", "home_failed", "error")]).alias("outcome"))


@add(
    "mobile_metrics",
    """%k AS (SELECT *, CASE WHEN kind = 'element' AND width > 0 AND right_px > client_width + 8 AND ord <= 3000 THEN 'over' WHEN kind = 'text' AND length(text) >= 3 AND width > 0 AND height > 0 THEN 'text'
 WHEN kind = 'tap' AND top <= inner_height AND width > 0 AND height > 0 THEN 'tap' END AS c FROM boxes),
n AS (SELECT *, row_number() OVER (PARTITION BY site, c ORDER BY ord) AS n FROM k),
m AS (SELECT * FROM n WHERE c IS NOT NULL AND n <= CASE c WHEN 'over' THEN 10 WHEN 'text' THEN 200 ELSE 60 END),
p AS (SELECT site, greatest(0, max(scroll_width) - max(client_width)) AS overflow_px FROM boxes GROUP BY site)
SELECT p.site, overflow_px, count(*) FILTER (c = 'over') AS overflowing, count(*) FILTER (c = 'text') AS text_sampled, count(*) FILTER (c = 'text' AND font_px < 12) AS tiny_text,
 count(*) FILTER (c = 'tap') AS taps, count(*) FILTER (c = 'tap' AND (width < 40 OR height < 24)) AS small_taps FROM p LEFT JOIN m ON p.site = m.site GROUP BY p.site, overflow_px""",
    X.BOXES,
)
def mobile_metrics(boxes):
    return S.mobile_metrics(boxes)


@add("favicon", "SELECT site, n_icons > 0 AS dom_link, CASE WHEN n_icons > 0 THEN -1 ELSE ico_status END AS ico_status FROM favicon", X.FAVICON)
def favicon(rows):
    has = F.col("n_icons") > 0
    return rows.select("site", has.alias("dom_link"), F.when(has, -1).otherwise(F.col("ico_status")).alias("ico_status"))


@add("site_budget", "SELECT site, n, took_ms, started_ms FROM (SELECT *, coalesce(sum(took_ms) OVER (PARTITION BY site ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS started_ms FROM budget_steps) WHERE started_ms <= 90000", X.BUDGET_STEPS)
def site_budget(steps):
    return S.within_budget(steps, F.lit(90000))


@add("job_list", "SELECT job_id, kind, status FROM (SELECT * FROM jobs WHERE job_id < 'b1' ORDER BY job_id DESC LIMIT 6) WHERE kind = 'crawl'", X.JOBS)
def job_list(jobs):
    return J.job_list(jobs, kind="crawl", limit=6, cursor="b1").select("job_id", "kind", "status")


@add("job_claim", "SELECT job_id FROM (SELECT job_id FROM jobs WHERE status = 'queued' ORDER BY job_id DESC LIMIT 50) ORDER BY job_id LIMIT 1", X.JOBS)
def job_claim(jobs):
    return J.claim(jobs).select("job_id")


@add(
    "job_dedup",
    """%s AS (SELECT * FROM jobs ORDER BY job_id DESC LIMIT 200)
SELECT request_id, max(job_id) AS job_id FROM job_requests r JOIN s ON r.spec_hash = s.spec_hash WHERE status IN ('queued', 'running')
 OR (status = 'succeeded' AND epoch_ms(now) - epoch_ms(coalesce(finished_at, created_at)) <= 900000) GROUP BY request_id""",
    X.JOBS,
    X.JOB_REQUESTS,
)
def job_dedup(jobs, requests):
    return J.duplicates(requests, jobs)


@add("job_ttl", "SELECT job_id FROM jobs WHERE status IN ('succeeded', 'failed', 'cancelled', 'expired') AND TIMESTAMP '2024-02-01 01:00:00' - coalesce(finished_at, created_at) >= INTERVAL 14 DAY", X.JOBS)
def job_ttl(jobs):
    return J.expired(jobs, F.lit("2024-02-01 01:00:00").cast("timestamp"))


@add(
    "job_pressure",
    """%t AS (SELECT job_id, bytes, coalesce(sum(bytes) OVER (ORDER BY coalesce(finished_at, created_at), job_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS freed
 FROM jobs WHERE status IN ('succeeded', 'failed', 'cancelled', 'expired'))
SELECT job_id, bytes FROM t WHERE freed = 0 OR (8800 - freed) * 100.0 / 10000 >= 80""",
    X.JOBS,
)
def job_pressure(jobs):
    return J.pressure(jobs, 8800, 10000)


@add("job_recover", "SELECT job_id, CASE WHEN attempt < 2 THEN 'requeued' ELSE 'failed' END AS action FROM jobs WHERE status = 'queued' OR (status = 'running' AND NOT coalesce(alive AND pid IS NOT NULL, false))", X.JOBS)
def job_recover(jobs):
    return J.recover(jobs)


@add(
    "job_outcome",
    """SELECT job_id, CASE WHEN cancelled THEN 'cancelled' WHEN oversized OR timed_out THEN 'failed' WHEN exit_code = 0 THEN 'succeeded' WHEN exit_code = 3 THEN 'cancelled' ELSE 'failed' END AS status,
 CASE WHEN cancelled THEN NULL WHEN oversized THEN 'artefact_cap_exceeded' WHEN timed_out THEN 'wall_clock_exceeded' WHEN exit_code = 0 THEN NULL WHEN exit_code = 3 THEN coalesce(error_code, 'aborted') ELSE coalesce(error_code, 'worker_failed') END AS code FROM ends""",
    X.ENDS,
)
def job_outcome(rows):
    status, code = J.final_state(*[F.col(c) for c in ("cancelled", "oversized", "timed_out", "exit_code", "error_code")])
    return rows.select("job_id", status.alias("status"), code.alias("code"))


@add(
    "job_view",
    "SELECT job_id, kind, status, '/scrape-runs/' || job_id || '/' AS artefacts, '/scrape/' || kind || 's/' || job_id AS self, attempt, epoch_ms(created_at) AS created_ms FROM jobs",
    X.JOBS,
)
def job_view(jobs):
    return J.job_view(jobs).select("job_id", "kind", "status", "artefacts", "self", "attempt", F.unix_millis("created_at").alias("created_ms"))


@add("job_health", "SELECT least(count(*) FILTER (status = 'queued'), 200) AS queued, count(*) FILTER (status = 'running') AS active, count(*) FILTER (status NOT IN ('queued', 'running')) AS ended FROM jobs", X.JOBS)
def job_health(jobs):
    return jobs.agg(F.least(F.count_if(F.col("status") == "queued"), F.lit(200)).alias("queued"), F.count_if(F.col("status") == "running").alias("active"), F.count_if(~F.col("status").isin("queued", "running")).alias("ended"))


@add("job_remove", "SELECT job_id FROM jobs WHERE job_id NOT IN (SELECT job_id FROM job_deletes)", X.JOBS, X.JOB_DELETES)
def job_remove(jobs, deletes):
    return jobs.join(deletes, "job_id", "left_anti").select("job_id")


@add(
    "progress_fold",
    """%e AS (SELECT job_id, seq, unnest(json_keys(TRY_CAST(payload AS JSON))) AS key, TRY_CAST(payload AS JSON) AS p FROM worker_events WHERE type = 'progress')
SELECT job_id, key, arg_max(p ->> key, seq) AS value FROM e WHERE key <> 'type' GROUP BY job_id, key""",
    X.EVENTS,
)
def progress_fold(events):
    return J.progress(events)


@add(
    "progress_throttle",
    """%o AS (SELECT job_id, at_ms, row_number() OVER (PARTITION BY job_id ORDER BY at_ms) AS n FROM worker_events WHERE type = 'progress'),
f(job_id, n, last_ms, flush) AS (SELECT job_id, n, at_ms, true FROM o WHERE n = 1 UNION ALL SELECT o.job_id, o.n, CASE WHEN at_ms - last_ms > 1500 THEN at_ms ELSE last_ms END, at_ms - last_ms > 1500 FROM f JOIN o ON o.job_id = f.job_id AND o.n = f.n + 1)
SELECT job_id, last_ms AS at_ms FROM f WHERE flush""",
    X.EVENTS,
)
def progress_throttle(events):
    return J.throttle(events)


_POLITE = """WITH RECURSIVE q AS (SELECT user_id AS key, event_id AS id, epoch_us(ts) // 1000 AS at_ms, (event_id % 5) * 100 AS took_ms FROM events),
c AS (SELECT *, coalesce(sum(took_ms + 800) OVER (PARTITION BY key ORDER BY at_ms, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c FROM q)
SELECT key, id, at_ms, took_ms, (c + max(at_ms - c) OVER (PARTITION BY key ORDER BY at_ms, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))::BIGINT AS start_ms FROM c"""


@add("politeness_schedule", _POLITE)
def politeness_schedule(spark, sf_dir):
    ts = F.unix_millis(F.col("ts").cast("timestamp"))
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("id"), ts.alias("at_ms"), ((F.col("event_id") % 5) * 100).alias("took_ms"))
    return J.politeness(e).select("key", "id", "at_ms", "took_ms", F.col("start_ms").cast("bigint").alias("start_ms"))


def _t(path: str) -> str:
    return f"json_type(j, '$.{path}')"


def _is(path: str, *kinds: str) -> str:
    return f"coalesce({_t(path)}, 'NULL') IN {_IN(kinds)}"


def _e(cond: str, code: str, field: str) -> str:
    return f"WHEN {cond} THEN '{code}|{field}'"


def _text_sql(f: str, required: bool = False) -> str:
    out = _e(_is(f, "NULL"), "field_required", f) if required else ""
    return f"{out} {_e(f'NOT {_is(f, 'NULL')} AND ({_t(f)} <> {chr(39)}VARCHAR{chr(39)} OR trim(j ->> {chr(39)}$.{f}{chr(39)}) = {chr(39)}{chr(39)})', 'field_invalid', f)}"


def _int_sql(f: str, low: int, high: int) -> str:
    n = f"TRY_CAST(j ->> '$.{f}' AS DOUBLE)"
    num = _is(f, "UBIGINT", "BIGINT", "DOUBLE")
    return " ".join(
        (_e(f"NOT {_is(f, 'NULL')} AND (NOT {num} OR {n} <> floor({n}))", "field_invalid", f), _e(f"{num} AND {n} < {low}", "field_out_of_range", f), _e(f"{num} AND {n} > {high}", "field_exceeds_ceiling", f))
    )


def _bool_sql(f: str) -> str:
    return _e(f"NOT {_is(f, 'NULL')} AND {_t(f)} <> 'BOOLEAN'", "field_invalid", f)


def _strings_sql(f: str, most: int) -> str:
    arr = f"json_extract(j, '$.{f}[*]')"
    return " ".join(
        (
            _e(f"NOT {_is(f, 'NULL')} AND ({_t(f)} <> 'ARRAY' OR len(list_filter({arr}, lambda x: json_type(x) <> 'VARCHAR')) > 0)", "field_invalid", f),
            _e(f"{_t(f)} = 'ARRAY' AND len({arr}) > {most}", "field_out_of_range", f),
        )
    )


def _whole_sql(t: str, fields: tuple[str, ...], rules: str) -> str:
    keys = f"list_filter(json_keys(j), lambda k: k NOT IN {_IN(fields)})"
    return f"""%b AS (SELECT id, CASE WHEN trim(body) = '' THEN '{{}}' ELSE body END AS t FROM {t}), v AS (SELECT id, t, TRY_CAST(t AS JSON) AS j FROM b),
e AS (SELECT id, CASE WHEN j IS NULL THEN 'body_not_json' WHEN json_type(j) <> 'OBJECT' THEN 'body_invalid' WHEN len({keys}) > 0 THEN 'unknown_field|' || {keys}[1] {rules} END AS x FROM v)
SELECT id, nullif(split_part(x, '|', 1), '') AS code, nullif(split_part(x, '|', 2), '') AS field FROM e"""


_ROBOTS_OFF = _e("j ->> '$.respectRobotsTxt' = 'false' AND json_type(j, '$.respectRobotsTxt') = 'BOOLEAN'", "robots_override_forbidden", "respectRobotsTxt")


@add(
    "validate_crawl",
    _whole_sql(
        "crawl_bodies",
        V.CRAWL_FIELDS,
        " ".join(
            (
                _text_sql("rootUrl", True), _int_sql("maxPages", 1, 200), _int_sql("crawlDepth", 0, 6), _int_sql("timeoutMs", 1000, 120000), _bool_sql("respectRobotsTxt"), _bool_sql("captureDesktop"),
                _bool_sql("captureMobile"), _ROBOTS_OFF, _strings_sql("excludedPathPatterns", 100), _strings_sql("allowedDomains", 20),
                _e(f"NOT {_is('navWaitUntil', 'NULL')} AND (j ->> '$.navWaitUntil') NOT IN {_IN(V.NAV_WAIT)}", "field_invalid", "navWaitUntil"), _text_sql("businessCategoryHint"), _text_sql("targetMarket"),
            )
        ),
    ),
    X.CRAWL_BODIES,
)
def validate_crawl(rows):
    return V.validate_crawl(rows).select("id", "code", "field")


_C = "json_extract(j, '$.candidates[*]')"
_CURL = "CASE WHEN json_type(c) = 'VARCHAR' THEN c ->> '$' WHEN json_type(c, '$.url') = 'VARCHAR' THEN c ->> '$.url' END"
_CBAD = f"""list_filter(list_transform({_C}, lambda c, i: CASE WHEN coalesce(trim({_CURL}), '') = '' THEN 'field_invalid|candidates[' || (i - 1) || '].url'
 WHEN json_type(c) = 'OBJECT' AND json_exists(c, '$.name') AND json_type(c, '$.name') <> 'VARCHAR' THEN 'field_invalid|candidates[' || (i - 1) || '].name'
 WHEN json_type(c) = 'OBJECT' AND json_exists(c, '$.slug') AND NOT regexp_matches(c ->> '$.slug', '(?i)^[a-z0-9-]+$') THEN 'field_invalid|candidates[' || (i - 1) || '].slug'
 WHEN json_type(c) = 'OBJECT' AND len(list_filter(json_keys(c), lambda k: k NOT IN ('url', 'name', 'slug', 'id'))) > 0 THEN 'unknown_field|candidates[' || (i - 1) || '].' || list_filter(json_keys(c), lambda k: k NOT IN ('url', 'name', 'slug', 'id'))[1] END), lambda e: e IS NOT NULL)"""


@add(
    "validate_scan",
    _whole_sql(
        "scan_bodies",
        V.SCAN_FIELDS,
        " ".join(
            (
                _e(f"{_t('candidates')} IS NULL OR {_t('candidates')} <> 'ARRAY' OR len({_C}) = 0", "field_required", "candidates"), _e(f"len({_C}) > 500", "field_exceeds_ceiling", "candidates"),
                f"WHEN len({_CBAD}) > 0 THEN {_CBAD}[1]", _int_sql("concurrency", 1, 8), _int_sql("maxPagesPerSite", 1, 10), _int_sql("siteBudgetMs", 10000, 300000), _bool_sql("force"), _bool_sql("respectRobotsTxt"), _ROBOTS_OFF,
            )
        ),
    ),
    X.SCAN_BODIES,
)
def validate_scan(rows):
    return V.validate_scan(rows).select("id", "code", "field")


@add("submit_gate", "SELECT request_id, kind, CASE WHEN kind = 'scan' THEN bool_or(blocked IS NULL) ELSE bool_and(blocked IS NULL) END AS accepted FROM submitted GROUP BY request_id, kind", X.SUBMITTED)
def submit_gate(rows):
    return V.submit_gate(rows)


@add(
    "parity_fields",
    f"SELECT coalesce(b.site, a.site) AS site, coalesce(b.field, a.field) AS field, b.value AS was, a.value AS now FROM head_before b FULL JOIN head_after a ON a.site = b.site AND a.field = b.field WHERE coalesce(b.field, a.field) IN {_IN(P.FIELDS)} AND a.value IS DISTINCT FROM b.value",
    X.HEAD_BEFORE,
    X.HEAD_AFTER,
)
def parity_fields(before, after):
    return P.changed_fields(before, after)


@add(
    "parity_sets",
    "SELECT site, slug, 'missing' AS change FROM (SELECT * FROM pages_before EXCEPT SELECT * FROM pages_after) UNION ALL SELECT site, slug, 'unexpected' FROM (SELECT * FROM pages_after EXCEPT SELECT * FROM pages_before)",
    X.PAGES_BEFORE,
    X.PAGES_AFTER,
)
def parity_sets(before, after):
    return P.slug_sets(before, after)


@add(
    "parity_reasons",
    """%b AS (SELECT site, string_agg(DISTINCT reason, ',' ORDER BY reason) AS was FROM skips_before GROUP BY site), a AS (SELECT site, string_agg(DISTINCT reason, ',' ORDER BY reason) AS now FROM skips_after GROUP BY site)
SELECT coalesce(b.site, a.site) AS site, coalesce(was, '') AS was, coalesce(now, '') AS now FROM b FULL JOIN a ON a.site = b.site WHERE coalesce(was, '') <> coalesce(now, '')""",
    X.SKIPS_BEFORE,
    X.SKIPS_AFTER,
)
def parity_reasons(before, after):
    return P.reason_sets(before, after)


@add(
    "parity_counts",
    """%j AS (SELECT b.site, b.slug, b.key, b.n AS was, a.n AS now FROM counts_before b JOIN counts_after a ON a.site = b.site AND a.slug = b.slug AND a.key = b.key),
l AS (SELECT *, CASE WHEN was > 0 AND now = 0 THEN 'fail' WHEN CASE WHEN was = 0 THEN now <> 0 ELSE abs(now - was) / was > 0.15 END THEN 'warn' END AS level FROM j) SELECT * FROM l WHERE level IS NOT NULL""",
    X.COUNTS_BEFORE,
    X.COUNTS_AFTER,
)
def parity_counts(before, after):
    return P.count_drift(before, after)


_WRITTEN = """['accessibility-tree.json', 'blocks.json', 'buttons.json', 'content.html', 'forms.json', 'headings.json', 'images.json', 'links.json', 'metadata.json', 'readable.md', 'structured-data.json', 'visible-text.json']"""


@add(
    "parity_files",
    f"SELECT p.site, p.slug, f.file FROM pages_before p CROSS JOIN (SELECT unnest({_WRITTEN}) AS file) f WHERE NOT EXISTS (SELECT 1 FROM files_after x WHERE x.site = p.site AND x.slug = p.slug AND x.file = f.file)",
    X.PAGES_BEFORE,
    X.FILES_AFTER,
)
def parity_files(pages, files):
    return P.missing_files(pages, files, K.PER_PAGE_FILES)


@add(
    "parity_assets",
    """%b AS (SELECT site, count(*) AS was FROM assets_before GROUP BY site), a AS (SELECT site, count(*) AS now, bool_or(role IS NOT NULL) AS has_role FROM assets_after GROUP BY site),
j AS (SELECT coalesce(b.site, a.site) AS site, coalesce(was, 0) AS was, coalesce(now, 0) AS now, coalesce(has_role, false) AS has_role FROM b FULL JOIN a ON a.site = b.site)
SELECT site, was, now, has_role, CASE WHEN has_role OR (was > 0 AND now = 0) THEN 'fail' WHEN CASE WHEN was = 0 THEN now <> 0 ELSE abs(now - was) / was > 0.15 END THEN 'warn' ELSE 'ok' END AS level FROM j""",
    X.ASSETS_BEFORE,
    X.ASSETS_AFTER,
)
def parity_assets(before, after):
    return P.asset_check(before, after)
