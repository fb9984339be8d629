"""Queries over records of crawls, scans and jobs, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from silkpage.operators import records as R
from silkpage.plans.fixtures import Fixture
from silkpage.plans.rules import _HOST, V4, _ip_sql

QUERIES: dict = {}
SQL: dict[str, str] = {}


def add(name: str, sql: str, *fixtures: Fixture):
    def put(f):
        QUERIES[name] = lambda spark, sf_dir: f(*[x.df(spark) for x in fixtures])
        head = ", ".join(x.sql for x in fixtures)
        SQL[name] = f"WITH {head}" + (", " if sql.startswith("%") else " ") + sql.lstrip("%")
        return f

    return put


SPECS = Fixture(
    "specs",
    "id string, site string, root_url string, max_pages int, crawl_depth int, allowed_domains array<string>",
    (
        ("a", "a.com", "https://www.a.com/x", None, None, None), ("b", "b.org", "http://b.org", 7, 0, []), ("c", "c.net", "https://c.net/", 900, 2, ["c.net", "img.c.net"]),
        ("d", None, None, 5, None, ["x.com"]), ("e", None, "", None, None, None), ("f", "f.com", "https://shop.F.com:8080/p", None, 6, None),
    ),
)
_SPECS = rf"""sp AS (SELECT *, regexp_replace({_HOST.replace("url", "root_url", 1)}, '^www\.', '') AS bare, coalesce(root_url, '') = '' AS bad FROM specs),
cs AS (SELECT id, site, CASE WHEN bad THEN 'spec_invalid' END AS error, root_url, coalesce(max_pages, 50) AS max_pages, coalesce(crawl_depth, 3) AS crawl_depth,
 CASE WHEN len(allowed_domains) > 0 THEN array_to_string(allowed_domains, ',') WHEN NOT bad THEN bare || ',www.' || bare END AS allowed_domains FROM sp)"""


@add("crawl_spec", "%" + _SPECS + " SELECT id, error, root_url, max_pages, crawl_depth, allowed_domains FROM cs", SPECS)
def crawl_spec(specs):
    return R.crawl_specs(specs).withColumn("allowed_domains", F.array_join("allowed_domains", ","))


PROBES = Fixture(
    "probes",
    "url string, head_status int, head_error string, get_status int, get_error string",
    (
        ("https://a.com/1", 200, None, None, None), ("https://a.com/2", 405, None, 200, None), ("https://a.com/3", 403, None, None, "timeout"), ("https://a.com/4", 501, None, None, "dns_error"),
        ("https://a.com/5", None, "timeout", None, None), ("https://a.com/6", None, "connection_reset", 200, None), ("https://a.com/7", 404, None, 200, None), ("https://b.com/1", 500, None, None, None),
    ),
)
SAMPLE = Fixture(
    "sampled_links",
    "site string, n int, href string",
    tuple(("a", k, f"https://a.com/{k}") for k in (7, 1, 2, 3, 4, 5, 6)) + (("b", 1, "https://b.com/1"), ("b", 2, "https://b.com/unprobed"), ("c", 1, "https://c.com/none")),
)
_HEAD = """h AS (SELECT *, CASE WHEN head_error = 'timeout' THEN -1 WHEN head_error IS NOT NULL THEN 0 ELSE head_status END AS hs,
 CASE WHEN get_error = 'timeout' THEN -1 WHEN get_error IS NOT NULL THEN 0 ELSE get_status END AS gs FROM probes), hd AS (SELECT url, CASE WHEN hs IN (403, 405, 501) THEN gs ELSE hs END AS status FROM h)"""


@add("head_check", "%" + _HEAD + " SELECT * FROM hd", PROBES)
def head_check(probes):
    return R.head_status(probes).select("url", "status")


_CHECKS = "lc AS (SELECT site, count(*) AS sampled, count(*) FILTER (status <= 0 OR status >= 400) AS broken, string_agg(status || ' ' || href, ',' ORDER BY n) AS checks FROM sampled_links JOIN hd ON href = url GROUP BY site)"


@add("link_checks", f"%{_HEAD}, {_CHECKS} SELECT * FROM lc", PROBES, SAMPLE)
def link_checks(probes, sample):
    return R.link_checks(sample, probes)


HEADERS = Fixture(
    "raw_headers",
    "site string, raw string",
    (
        ("a", '{"content-type":"text/html","server":"nginx","x-powered-by":"","cache-control":"no-store"}'), ("b", '{"last-modified":"Mon, 01 Jan 2024 00:00:00 GMT","strict-transport-security":"max-age=63072000"}'),
        ("c", "{}"), ("d", None),
    ),
)
_NAMES = ("content-type", "last-modified", "server", "x-powered-by", "strict-transport-security")


@add("header_pick", "SELECT site, " + ", ".join(f"""nullif(raw ->> '$."{h}"', '') AS {h.replace("-", "_")}""" for h in _NAMES) + " FROM raw_headers", HEADERS)
def header_pick(rows):
    return R.response_headers(rows.select("site", F.from_json("raw", "map<string,string>").alias("headers")))


SOURCES = Fixture(
    "page_sources",
    "page_id bigint, served string, rendered string, snapshot string, tree string",
    ((1, "<p>a</p>", "<p>b</p>", None, "t1"), (2, "", "<p>c</p>", "s2", "t2"), (3, None, "<p>d</p>", "s3", None), (4, None, None, None, None), (3_000_000_000, "<i>x</i>", None, None, "t")),
)


@add("page_source", "SELECT page_id, coalesce(nullif(served, ''), rendered) AS html, coalesce(snapshot, tree) AS accessibility FROM page_sources", SOURCES)
def page_source(rows):
    return R.page_source(rows)


TIMES = Fixture("nav_times", "page_id bigint, start double, response_end double, dom_end double, load_end double", ((1, 0.0, 120.5, 300.49, 800.5), (2, 10.25, 10.75, 99.0, 0.0), (3, 5.0, 4.5, 5.0, 5.5)))


@add(
    "nav_timing",
    "SELECT page_id, floor(response_end - start + 0.5)::BIGINT AS response_ms, floor(dom_end - start + 0.5)::BIGINT AS dom_content_loaded_ms, CASE WHEN load_end > 0 THEN floor(load_end - start + 0.5)::BIGINT END::VARCHAR AS load_ms FROM nav_times",
    TIMES,
)
def nav_timing(rows):
    return R.timing(rows).withColumn("load_ms", F.col("load_ms").cast("string"))  # null before the load


HOMES = Fixture(
    "homes",
    "site string, home_ok boolean, blocked boolean, browse_url string, http_ok boolean, http_final_url string",
    (
        ("a", False, False, "https://a.com/", True, "http://a.com/"), ("b", True, False, "https://b.com/", True, "http://b.com/"), ("c", False, True, "https://c.com/", True, "http://c.com/"),
        ("d", False, False, "HTTPS://d.com/", True, "https://d.com/"), ("e", False, False, "https://e.com/", None, None), ("f", False, False, "http://f.com/", True, "http://f.com/"), ("g", False, False, "HTTPS://g.com/", True, "HTTP://g.com/x"),
    ),
)


@add(
    "browse_fallback",
    """%f AS (SELECT *, coalesce(NOT home_ok AND NOT blocked AND regexp_matches(browse_url, '(?i)^https:') AND http_ok AND regexp_matches(http_final_url, '(?i)^http:'), false) AS falls_back FROM homes)
SELECT site, falls_back, CASE WHEN falls_back THEN http_final_url ELSE browse_url END AS browse_url FROM f""",
    HOMES,
)
def browse_fallback(rows):
    return R.fallback_to_http(rows)


GATE_URLS = Fixture(
    "gate_urls",
    "url string",
    tuple((u,) for u in ("https://ok.com/a", "https://mixed.com/", "https://gone.com/", "https://empty.com/", "http://10.1.2.3/", "http://8.8.8.8/x", "ftp://ok.com/", "https://intranet/", "http://[2001:db8::1]/p", "https://u:p@ok.com/")),
)
ANSWERS = Fixture("gate_answers", "host string, address string", (("ok.com", "93.184.216.34"), ("mixed.com", "93.184.216.34"), ("mixed.com", "::1"), ("gone.com", None), ("intranet", "93.184.216.34")))


@add(
    "navigable",
    rf"""%g AS (SELECT url, {_HOST} AS host, lower(regexp_extract(url, '^([a-zA-Z][a-zA-Z0-9+.\-]*):', 1)) AS scheme FROM gate_urls),
fm AS (SELECT *, regexp_matches(host, '{V4}') OR regexp_matches(host, '^[0-9a-fA-F:.]*:[0-9a-fA-F:.]*$') AS is_ip, {_ip_sql("host")} AS why FROM g),
dn AS (SELECT host, bool_or(({_ip_sql("address")}) IS NOT NULL) AS private, count(address) AS n FROM gate_answers GROUP BY host)
SELECT url, CASE WHEN scheme NOT IN ('http', 'https') THEN 'url_scheme_blocked' WHEN regexp_matches(url, '^[a-zA-Z]+://[^/?#@]+@') THEN 'url_credentials_blocked' WHEN is_ip AND why IS NOT NULL THEN 'url_private_address'
 WHEN NOT is_ip AND (NOT contains(fm.host, '.') OR fm.host LIKE '%.local') THEN 'url_non_public_host' WHEN NOT is_ip AND coalesce(n, 0) = 0 THEN 'url_dns_failed' WHEN NOT is_ip AND private THEN 'url_private_address' END AS code
FROM fm LEFT JOIN dn ON fm.host = dn.host""",
    GATE_URLS,
    ANSWERS,
)
def navigable(urls, answers):
    return R.navigable(urls, answers)


IMAGES = Fixture("image_counts", "page_id bigint, status int, n_dom int, n_meta int", ((1, 200, 0, 2), (2, 404, 0, 2), (3, 200, 1, 2), (4, 200, 0, 0), (5, None, 0, 3)))


@add("image_fallback", "SELECT page_id, coalesce(status = 200 AND n_dom = 0 AND n_meta > 0, false) AS from_metadata_only FROM image_counts", IMAGES)
def image_fallback(rows):
    return R.image_flags(rows)


TAPS = Fixture("button_boxes", "page_id bigint, ord int, top double, viewport int", ((1, 0, 10.0, 768), (1, 1, 768.0, 768), (2, 0, 767.9, 768), (2, 1, -5.0, 768)))


@add("button_position", "SELECT page_id, ord, CASE WHEN top < viewport THEN 'above_fold' ELSE 'below_fold' END AS position FROM button_boxes", TAPS)
def button_position(rows):
    return R.button_position(rows)


BLOCKS = Fixture("local_blocks", "page_id bigint, local_id string", ((1, "block.000"), (1, "block.001"), (2, "block.000"), (9, "block.000")))
SLUGS = Fixture(
    "page_entries",
    "page_id bigint, site string, slug string, final_url string, canonical_url string, title string, status int, depth int, desktop boolean, mobile boolean, raw_counts string",
    (
        (1, "a.com", "home", "https://a.com/", "", "Home", 200, 0, True, True, '{"links":3,"images":null}'), (2, "a.com", "about", "https://a.com/about?x", "https://a.com/about", None, 404, 1, True, False, '{"links":0}'),
        (3, "b.org", "home", "http://b.org/", None, "B", 200, 0, False, False, "{}"),
    ),
)


@add("block_ids", "SELECT page_id, slug || '.' || local_id AS id, final_url AS source_url FROM local_blocks JOIN page_entries USING (page_id)", BLOCKS, SLUGS)
def block_ids(blocks, slugs):
    return R.block_ids(blocks, slugs)


@add(
    "screenshot_paths",
    "SELECT page_id, CASE WHEN desktop THEN 'pages/' || slug || '/screenshot-desktop.png' END AS screenshot_desktop, CASE WHEN mobile THEN 'pages/' || slug || '/screenshot-mobile.png' END AS screenshot_mobile FROM page_entries",
    SLUGS,
)
def screenshot_paths(pages):
    return R.screenshots(pages)


@add(
    "page_records",
    """%ck AS (SELECT page_id, unnest(json_keys(raw_counts::JSON)) AS k, raw_counts FROM page_entries), cc AS (SELECT page_id, string_agg('"' || k || '":"' || (raw_counts::JSON ->> k) || '"', ',') AS c FROM ck WHERE (raw_counts::JSON ->> k) IS NOT NULL GROUP BY page_id)
SELECT site, slug, final_url, coalesce(nullif(canonical_url, ''), final_url) AS canonical_url, title, status, depth, '{' || coalesce(c, '') || '}' AS counts FROM page_entries LEFT JOIN cc USING (page_id)""",
    SLUGS,
)
def page_records(pages):
    return R.page_records(pages.withColumn("counts", F.from_json("raw_counts", "map<string,string>")))


WIDE = Fixture(
    "wide_boxes",
    "site string, ord int, tag string, dom_id string, class string, width double, right_px double, client_width int",
    (
        ("a", 0, "DIV", "main", "x y", 500.5, 500.5, 390), ("a", 1, "IMG", None, " hero  big wide ", 420.25, 398.5, 390), ("a", 2, "P", None, None, 10.0, 398.0, 390), ("a", 3, "SPAN", "", "", 1.0, 450.49, 390),
        ("a", 4, "B", None, None, 0.0, 900.0, 390), ("a", 3001, "I", None, None, 5.0, 900.0, 390),
    ) + tuple(("b", k, "LI", None, f"c{k}", 9.5, 500.0 + k, 390) for k in range(14)),
)


@add(
    "overflowing",
    r"""%w AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY ord) AS k, regexp_split_to_array(trim(coalesce(class, '')), '\s+') AS cl FROM wide_boxes WHERE ord <= 3000 AND width > 0 AND right_px > client_width + 8)
SELECT site, k::INT AS n, substr(lower(tag) || CASE WHEN coalesce(dom_id, '') <> '' THEN '#' || dom_id WHEN trim(coalesce(class, '')) <> '' THEN '.' || array_to_string(cl[1:2], '.') ELSE '' END, 1, 120) AS selector,
 floor(right_px + 0.5)::BIGINT AS right_px, floor(width + 0.5)::BIGINT AS width FROM w WHERE k <= 10""",
    WIDE,
)
def overflowing(boxes):
    return R.overflowing(boxes)


FONTS = Fixture("body_fonts", "site string, font_size string", (("a", "16px"), ("b", "13.5px"), ("c", "0px"), ("d", ""), ("e", None), ("f", " .9rem"), ("g", "large")))


@add("body_font", r"SELECT site, nullif(TRY_CAST(nullif(regexp_extract(font_size, '^\s*([+-]?(?:\d+\.?\d*|\.\d+))', 1), '') AS DOUBLE), 0) AS body_font_px FROM body_fonts", FONTS)
def body_font(rows):
    return R.body_font(rows)


CALLS = Fixture(
    "calls",
    "method string, path string",
    tuple(
        (m, p)
        for m, p in (
            ("GET", "/health"), ("POST", "/health"), ("POST", "/scrape/crawls"), ("GET", "/crawls?limit=5"), ("PUT", "/crawls"), ("GET", "/scans/abc"), ("DELETE", "/scrape/scans/abc"), ("POST", "/scans/abc"),
            ("GET", "/crawls/abc/log"), ("DELETE", "/crawls/abc/log"), ("GET", "/crawls/abc/artefacts/pages/home"), ("GET", "/crawls/abc/other"), ("GET", "/shots"), ("GET", "/scrapes"), ("GET", "/"), ("GET", "/scrape"), ("GET", "/scraped/crawls"),
        )
    ),
)


@add(
    "route",
    r"""%p AS (SELECT method, path, list_filter(string_split(regexp_replace(regexp_replace(path, '[?#].*$', ''), '^/scrape(/|$)', '\1'), '/'), lambda x: x <> '') AS s FROM calls),
k AS (SELECT *, CASE s[1] WHEN 'crawls' THEN 'crawl' WHEN 'scans' THEN 'scan' WHEN 'shots' THEN 'shot' END AS kind FROM p)
SELECT method, path, kind, CASE WHEN kind IS NOT NULL THEN s[2] END AS job_id, CASE WHEN s[1] = 'health' AND method = 'GET' THEN 200 WHEN kind IS NULL THEN 404 WHEN kind = 'shot' THEN 501
 WHEN s[2] IS NULL THEN CASE WHEN method NOT IN ('POST', 'GET') THEN 405 ELSE 200 END WHEN s[3] IN ('log', 'artefacts') AND method = 'GET' THEN 200 WHEN s[3] IS NOT NULL THEN 404 WHEN method NOT IN ('GET', 'DELETE') THEN 405 ELSE 200 END::INT AS status FROM k""",
    CALLS,
)
def route(calls):
    return R.routed(calls)


DISKS = Fixture("disks", "host string, used bigint, total bigint", (("a", 425, 1000), ("b", 12_345, 100_000), ("c", 1, 0), ("d", 999, 1000)))


@add("disk_health", "SELECT host, round(CASE WHEN total > 0 THEN 100.0::DOUBLE * used / total END, 1) AS disk_used_pct FROM disks", DISKS)
def disk_health(rows):
    return R.disk_health(rows)


_ERR = '{"type":"error","error":{"code":"%s"}}'
EVENTS = Fixture(
    "state_events",
    "job_id string, seq bigint, type string, payload string",
    (
        ("ok", 1, "start", None), ("ok", 2, "progress", "{}"), ("ok", 3, "result", "{}"), ("ok", 4, "exit", '{"exit":0}'),
        ("aborted", 1, "error", _ERR % "aborted"), ("aborted", 2, "exit", '{"exit":3}'), ("bare abort", 1, "start", None), ("bare abort", 2, "exit", '{"exit":3}'),
        ("crash after result", 1, "result", "{}"), ("crash after result", 2, "exit", '{"exit":1}'), ("two errors", 1, "error", _ERR % "e1"), ("two errors", 2, "error", _ERR % "e2"), ("two errors", 3, "exit", '{"exit":1}'),
        ("error, then well", 1, "error", _ERR % "e1"), ("error, then well", 2, "exit", '{"exit":0}'), ("oversize", 1, "timeout", None), ("oversize", 2, "oversize", None), ("oversize", 3, "error", _ERR % "x"), ("oversize", 4, "exit", '{"exit":0}'),
        ("timeout", 1, "timeout", None), ("timeout", 2, "exit", '{"exit":3}'), ("cancel", 1, "start", None), ("cancel", 2, "cancel", None), ("cancel", 3, "error", _ERR % "late"), ("cancel", 4, "exit", '{"exit":0}'),
        ("killed", 1, "start", None), ("killed", 2, "exit", '{"signal":"SIGKILL"}'), ("running", 1, "start", None), ("running", 2, "error", _ERR % "noted"), ("waiting", 1, "log", "text"),
    ),
)


@add(
    "job_states",
    """%en AS (SELECT job_id, min(seq) AS at, arg_min(type, seq) AS kind, arg_min(payload, seq) AS body FROM state_events WHERE type IN ('cancel', 'exit') GROUP BY job_id),
ev AS (SELECT e.*, en.at, en.kind, TRY_CAST(TRY_CAST(en.body AS JSON) ->> '$.exit' AS INT) AS code, TRY_CAST(e.payload AS JSON) ->> '$.error.code' AS err FROM state_events e LEFT JOIN en USING (job_id) WHERE en.at IS NULL OR e.seq <= en.at),
g AS (SELECT job_id, any_value(kind) AS kind, coalesce(any_value(code), 1) AS code, bool_or(type IN ('start', 'progress', 'result', 'error')) AS ran, bool_or(type = 'oversize') AS big, bool_or(type = 'timeout') AS late,
 arg_max(err, seq) FILTER (type = 'error' AND err IS NOT NULL) AS err FROM ev GROUP BY job_id)
SELECT job_id, CASE WHEN kind IS NULL THEN CASE WHEN ran THEN 'running' ELSE 'queued' END WHEN kind = 'cancel' THEN 'cancelled' WHEN big OR late THEN 'failed' WHEN code = 0 THEN 'succeeded' WHEN code = 3 THEN 'cancelled' ELSE 'failed' END AS status,
 CASE WHEN kind IS NULL OR kind = 'cancel' THEN NULL WHEN big THEN 'artefact_cap_exceeded' WHEN late THEN 'wall_clock_exceeded' WHEN code = 0 THEN NULL WHEN code = 3 THEN coalesce(err, 'aborted') ELSE coalesce(err, 'worker_failed') END AS code FROM g""",
    EVENTS,
)
def job_states(events):
    return R.job_states(events)


JOBS = Fixture("some_jobs", "job_id string, status string", (("j1", "running"), ("j2", "queued"), ("j3", "succeeded"), ("j4", "cancelled"), ("j5", "failed")))
DELETES = Fixture("deletes", "job_id string", (("j1",), ("j2",), ("j3",), ("j9",), ("j1",)))
FILES = Fixture("job_files", "job_id string, path string", (("j1", "crawl.json"), ("j1", "logs/crawl.log"), ("j4", "crawl.json"), ("j5", "x.txt")))


@add(
    "job_delete",
    "SELECT DISTINCT d.job_id, CASE WHEN status IS NULL THEN 404 ELSE 200 END AS answer, coalesce(status = 'running', false) AS was_running, CASE WHEN status IN ('queued', 'running') THEN 'cancelled' ELSE status END AS last_status FROM deletes d LEFT JOIN some_jobs USING (job_id)",
    JOBS,
    DELETES,
)
def job_delete(jobs, deletes):
    return R.delete_jobs(jobs, deletes)


@add("job_artefacts_left", "SELECT job_id, path FROM job_files WHERE job_id NOT IN (SELECT job_id FROM deletes)", JOBS, FILES, DELETES)
def job_artefacts_left(jobs, files, deletes):
    return R.remove_jobs(jobs, files, deletes)[1]


@add("job_next_cursor", "SELECT CASE WHEN count(*) = 3 THEN min(job_id) END AS next_cursor FROM (SELECT * FROM some_jobs WHERE job_id < 'j5' ORDER BY job_id DESC LIMIT 3)", JOBS)
def job_next_cursor(jobs):
    from silkpage.operators.jobs import job_list

    return R.job_page(job_list(jobs, limit=3, cursor="j5"), 3)


LIMITS = Fixture("limits", "n int", ((None,), (0,), (1,), (50,), (199,), (200,), (5000,)))


@add("job_page_limit", "SELECT n::VARCHAR AS n, least(coalesce(nullif(n, 0), 50), 200)::INT AS page FROM limits", LIMITS)
def job_page_limit(rows):
    from silkpage.operators.jobs import page_limit

    return rows.select(F.col("n").cast("string").alias("n"), page_limit(F.col("n")).cast("int").alias("page"))


SAMPLES = Fixture("size_samples", "job_id string, kind string, at_ms bigint, bytes bigint", (("a", "crawl", 1000, 5), ("a", "crawl", 31_000, 2_147_483_649), ("a", "crawl", 61_000, 3_000_000_000), ("b", "scan", 3_600_001, 2_147_483_648), ("c", "shot", 120_001, 1), ("c", "shot", 120_000, 0)))


@add("over_cap", "SELECT job_id, min(at_ms) AS at_ms FROM size_samples WHERE bytes > 2147483648 GROUP BY job_id", SAMPLES)
def over_cap(rows):
    from silkpage.operators.jobs import over_cap as over

    return over(rows)


@add("over_budget", "SELECT job_id, at_ms, at_ms > CASE kind WHEN 'scan' THEN 3600000 WHEN 'shot' THEN 120000 ELSE 900000 END AS over FROM size_samples", SAMPLES)
def over_budget(rows):
    from silkpage.operators.jobs import over_budget as over

    return rows.select("job_id", "at_ms", over(F.col("kind"), F.col("at_ms")).alias("over"))


FOUND = Fixture("crawl_found", "site string, discovered bigint, errors int, assets int, robots boolean, sitemap boolean", (("a.com", 5, 1, 2, True, False), ("c.net", None, None, None, None, True)))
SKIPS = Fixture("crawl_skips", "site string, url string, reason string", (("a.com", "u1", "robots"), ("a.com", "u2", "offsite"), ("f.com", "u3", "limit")))


@add(
    "crawl_records",
    "%" + _SPECS + """ SELECT site, '0.1' AS schema_version, root_url, allowed_domains, least(max_pages, 200) AS max_pages, coalesce(discovered, 0) AS discovered, coalesce(p.n, 0) AS pages_crawled, coalesce(s.n, 0) AS pages_skipped,
 coalesce(errors, 0)::BIGINT AS errors, coalesce(assets, 0)::BIGINT AS assets, coalesce(robots, false) AS robots_found, coalesce(sitemap, false) AS sitemap_found FROM cs LEFT JOIN (SELECT site, count(*) AS n FROM page_entries GROUP BY site) p USING (site)
 LEFT JOIN (SELECT site, count(*) AS n FROM crawl_skips GROUP BY site) s USING (site) LEFT JOIN crawl_found USING (site) WHERE error IS NULL""",
    SPECS,
    SLUGS,
    SKIPS,
    FOUND,
)
def crawl_records(specs, pages, skips, found):
    return R.crawl_records(R.crawl_specs(specs).join(specs.select("id", "site"), "id"), pages, skips, found)


SITE_PROBES = Fixture("site_probes", "site string, browse_url string, dead boolean", (("a", "https://a.com/", False), ("b", None, True), ("c", "https://c.com/", False)))
FAILURES = Fixture("failures", "site string, seq int, stage string, error string", (("a", 2, "capture", "late"), ("a", 1, "desktop", "nav"), ("b", 1, "capture", "x")))
ICONS = Fixture("icons", "site string, dom_link boolean, ico_status int", (("a", False, 404), ("c", True, None)))
NETWORK = Fixture("network_rows", "site string, kind string, n int, value string", (("a", "analytics", 1, "h"), ("a", "failed", 1, "u"), ("a", "failed", 2, "v"), ("c", "third_party", 1, "t")))


@add(
    "site_records",
    f"""%{_HEAD}, {_CHECKS}, ff AS (SELECT site, arg_min(stage, seq) AS stage, arg_min(error, seq) AS error FROM failures GROUP BY site),
nn AS (SELECT site, count(*) FILTER (kind = 'analytics') AS n_analytics, count(*) FILTER (kind = 'third_party') AS n_third_party, count(*) FILTER (kind = 'mixed') AS n_mixed, count(*) FILTER (kind = 'failed') AS n_failed FROM network_rows GROUP BY site)
SELECT p.site, browse_url, CASE WHEN dead THEN 'preflight' ELSE stage END AS stage, CASE WHEN dead THEN 'dead' ELSE error END AS error, dom_link, ico_status::VARCHAR AS ico_status, coalesce(sampled, 0) AS sampled, coalesce(broken, 0) AS broken, coalesce(n_analytics, 0) AS n_analytics,
 coalesce(n_third_party, 0) AS n_third_party, coalesce(n_mixed, 0) AS n_mixed, coalesce(n_failed, 0) AS n_failed FROM site_probes p LEFT JOIN ff ON ff.site = p.site LEFT JOIN icons i ON i.site = p.site LEFT JOIN lc ON lc.site = p.site LEFT JOIN nn ON nn.site = p.site""",
    SITE_PROBES,
    FAILURES,
    ICONS,
    PROBES,
    SAMPLE,
    NETWORK,
)
def site_records(probes, failures, icons, head, sample, network):
    return R.site_records(probes, failures, icons, R.link_checks(sample, head), network).withColumn("ico_status", F.col("ico_status").cast("string"))


MAPS = Fixture("field_maps", "id bigint, raw string", ((1, '{"a":"1","b":null}'), (2, "{}"), (3, '{"c":"x"}'), (4, '{"d":null}')))


@add(
    "stripped",
    """SELECT id, coalesce(string_agg(k || '=' || v, ',' ORDER BY k), '') AS fields FROM (SELECT id, unnest(CASE WHEN len(json_keys(raw::JSON)) = 0 THEN [NULL] ELSE json_keys(raw::JSON) END) AS k, raw::JSON ->> k AS v FROM field_maps) GROUP BY id""",
    MAPS,
)
def stripped(rows):
    kept = R.stripped(F.from_json("raw", "map<string,string>"))
    pairs = F.transform(F.array_sort(F.map_entries(kept)), lambda e: F.concat_ws("=", e.getField("key"), e.getField("value")))
    return rows.select("id", F.array_join(pairs, ",").alias("fields"))


@add(
    "event_lines",
    """SELECT job_id, seq, job_id AS back_job, seq AS back_seq, type AS back_type, payload AS back_payload FROM state_events""",
    EVENTS,
)
def event_lines(events):
    """What the written lines give when they are read again."""
    from silkpage.streaming.worker_events import parse_events

    back = parse_events(R.event_lines(events.withColumn("at_ms", F.lit(1).cast("bigint"))))
    return back.select("job_id", "seq", F.col("job_id").alias("back_job"), F.col("seq").alias("back_seq"), F.col("type").alias("back_type"), F.col("payload").alias("back_payload"))

