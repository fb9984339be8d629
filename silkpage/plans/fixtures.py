"""Small tables that stand in for what the engine takes as input (probes, jobs, requests),
written once for both engines."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

_SQL_TYPES = {"string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "boolean": "BOOLEAN", "double": "DOUBLE", "timestamp": "TIMESTAMP", "array<string>": "VARCHAR[]"}


def _literal(v, kind: str) -> str:
    if v is None:
        return f"CAST(NULL AS {_SQL_TYPES[kind]})"
    if isinstance(v, bool):
        return str(v).lower()
    if isinstance(v, (int, float)):
        return f"CAST({v} AS {_SQL_TYPES[kind]})"
    if isinstance(v, list):
        return "CAST([" + ", ".join(_literal(x, "string") for x in v) + "] AS VARCHAR[])"
    body = str(v).replace("'", "''").replace("\n", "' || chr(10) || '").replace("\r", "' || chr(13) || '")
    return f"CAST('{body}' AS {_SQL_TYPES[kind]})" if kind == "timestamp" else f"('{body}')"


@dataclass(frozen=True)
class Fixture:
    name: str
    schema: str  # Spark DDL
    rows: tuple

    @property
    def columns(self) -> list[tuple[str, str]]:
        return [tuple(c.strip().split(" ", 1)) for c in self.schema.split(",")]

    def df(self, spark: SparkSession) -> DataFrame:
        times = [i for i, (_, k) in enumerate(self.columns) if k == "timestamp"]
        rows = [tuple(dt.datetime.fromisoformat(v).replace(tzinfo=dt.timezone.utc) if i in times and v is not None else v for i, v in enumerate(r)) for r in self.rows]
        return spark.createDataFrame(rows, self.schema)

    @property
    def sql(self) -> str:
        """A common table expression of this name."""
        kinds = [k for _, k in self.columns]
        rows = ",\n".join("(" + ", ".join(_literal(v, k) for v, k in zip(r, kinds, strict=True)) + ")" for r in self.rows)
        return f"{self.name}({', '.join(n for n, _ in self.columns)}) AS (VALUES {rows})"


GUARD_URLS = Fixture(
    "guard_urls",
    "url string",
    tuple(
        (u,)
        for u in (
            "file:///etc/passwd", "ftp://example.com/x", "gopher://example.com/", "http://127.0.0.1/", "http://169.254.169.254/latest", "http://192.168.1.1/",
            "http://10.0.0.5:8080/x", "https://172.16.4.2/", "http://100.64.0.1/", "http://0.0.0.0/", "http://[::1]/", "http://[fd00::1]/", "http://[fe80::1]/",
            "https://user:pw@example.com/", "http://intranet/", "http://printer.local/", "https://example.com/a", "http://example.org", "https://sub.example.co.uk/p?q=1",
            "not a url", "http://8.8.8.8/", "http://[2001:db8::1]/", "http://172.32.0.1/",
        )
    ),
)
GUARD_IPS = Fixture(
    "guard_ips",
    "ip string",
    tuple(
        (i,)
        for i in (
            "::ffff:127.0.0.1", "::ffff:8.8.8.8", "172.15.0.1", "172.16.0.0", "172.31.255.255", "172.32.0.0", "100.63.255.255", "100.64.0.0", "100.127.1.1",
            "100.128.0.0", "192.0.5.1", "192.1.0.1", "223.255.255.255", "224.0.0.1", "255.255.255.255", "::", "::1", "fc00::1", "fdff::1", "fe80::1", "febf::1",
            "fec0::1", "ff02::1", "2001:db8::1", "8.8.8.8", "10.1.2.3", "0.1.2.3", "169.254.1.1", "169.253.1.1", "example.com", "::ffff:7f00:1", "::ffff:808:808",
        )
    ),
)
DNS_HOSTS = Fixture("dns_hosts", "host string", (("private.test",), ("mixed.test",), ("public.test",), ("absent.test",)))
DNS_ANSWERS = Fixture(
    "dns_answers",
    "host string, address string",
    (("private.test", "10.0.0.1"), ("mixed.test", "93.184.216.34"), ("mixed.test", "127.0.0.1"), ("public.test", "93.184.216.34"), ("public.test", "2606:2800:220:1::1")),
)
RETRY = Fixture(
    "retry",
    "header string, fallback_ms bigint, now timestamp",
    tuple(
        (h, f, "2024-03-01 12:00:00")
        for h, f in (
            ("5", 2000), ("0", 2000), (None, 2000), ("", 2000), ("soon", 4000), ("Fri, 01 Mar 2024 12:00:10 GMT", 2000), ("Fri, 01 Mar 2024 11:59:00 GMT", 3000),
            ("86400", 2000), (None, 90000), ("-5", 1000), ("1.5", 2000),
        )
    ),
)
FETCH_ERRORS = Fixture(
    "fetch_errors",
    "code string, message string, name string",
    (
        ("CERT_HAS_EXPIRED", "x", None), ("", "self signed certificate", None), ("ENOTFOUND", "x", None), ("EAI_AGAIN", None, None), ("ECONNREFUSED", "", None),
        ("ECONNRESET", "", None), ("EPIPE", "", None), ("", "The operation was aborted", None), (None, "x", "TimeoutError"), (None, None, None), ("X", "other", "Error"),
    ),
)
PATHS = Fixture("paths", "path string", tuple((p,) for p in ("a/b.json", "README.md", "x.HTML", "s.xml", "l.log", "t.txt", "i.png", "i.JPG", "i.jpeg", "w.webp", "noext", ".json", "a.b/c", "z.tar.gz")))
ROBOTS = Fixture(
    "robots",
    "origin string, body string",
    (
        ("https://a.example", "User-agent: *\nDisallow: /private\nDisallow:\n# no\nSitemap: https://a.example/s.xml\nUser-agent: x\nDisallow: /x\n"),
        ("https://b.example", "Sitemap: https://b.example/s.xml\r\nUser-agent: a\r\nUser-agent: *\r\nDisallow: /Tmp\r\n"),
        ("https://c.example", "User-agent: *\nUser-agent: z\nDisallow: /hidden"),
        ("https://d.example", ""),
    ),
)
ROBOT_URLS = Fixture(
    "robot_urls",
    "origin string, url string",
    (
        ("https://a.example", "https://a.example/private/1"), ("https://a.example", "https://a.example/x"), ("https://b.example", "https://b.example/Tmp"),
        ("https://b.example", "https://b.example/tmp"), ("https://c.example", "https://c.example/hidden"), ("https://a.example", "bad"),
    ),
)
SITEMAP_ROOTS = Fixture("sitemap_roots", "site string, url string", (("s1", "http://s/i"), ("s2", "http://s/u2"), ("s3", "http://s/none"), ("s4", "http://s/d0")))
SITEMAPS = Fixture(
    "sitemaps",
    "url string, xml string",
    (
        ("http://s/i", "<sitemapindex><sitemap><loc> http://s/u1 </loc></sitemap><sitemap><loc>http://s/u2</loc></sitemap><loc>http://s/i</loc></sitemapindex>"),
        ("http://s/u1", "<urlset><url><loc>http://x/1</loc></url><url><LOC>http://x/2</LOC></url></urlset>"),
        ("http://s/u2", "<urlset><url><loc>http://x/2</loc></url><url><loc>http://x/3</loc></url></urlset>"),
        ("http://s/d0", "<sitemapindex><loc>http://s/d1</loc></sitemapindex>"), ("http://s/d1", "<sitemapindex><loc>http://s/d2</loc></sitemapindex>"),
        ("http://s/d2", "<sitemapindex><loc>http://s/d3</loc><loc>http://s/u1</loc></sitemapindex>"), ("http://s/d3", "<sitemapindex><loc>http://s/d4</loc></sitemapindex>"),
        ("http://s/d4", "<urlset><loc>http://x/deep</loc></urlset>"),
    ),
)
HOPS = Fixture(
    "hops",
    "site string, scheme string, hop int, url string, status int, location string, error string",
    (
        ("a.test", "https", 0, "https://a.test", 200, None, None), ("a.test", "http", 0, "http://a.test", 301, "https://a.test/", None), ("a.test", "http", 1, "https://a.test/", 200, None, None),
        ("b.test", "http", 0, "http://b.test", 200, None, None), ("b.test", "https", 0, "https://b.test", None, None, "cert_error"),
        ("c.test", "http", 0, "http://c.test", None, None, "dns_error"), ("c.test", "https", 0, "https://c.test", 503, None, None),
        ("d.test", "https", 0, "https://d.test", 404, None, None), ("d.test", "http", 0, "http://d.test", 302, None, None),
        *[("e.test", "https", k, f"https://e.test/{k}", 302, f"https://e.test/{k + 1}", None) for k in range(7)], ("e.test", "http", 0, "http://e.test", None, None, "timeout"),
    ),
)
REQUESTS = Fixture(
    "requests",
    "site string, seq bigint, page_https boolean, url string, type string, failure string",
    (
        ("a.test", 1, True, "https://www.google-analytics.com/x", "script", None), ("a.test", 2, True, "https://www.google-analytics.com/y", "script", None),
        ("a.test", 3, True, "http://cdn.test/i.png", "image", None), ("a.test", 4, True, "http://localhost/z", "fetch", "net::ERR"), ("a.test", 5, True, "https://www.a.test/s.js", "script", None),
        ("b.test", 1, False, "http://plain.test/", "document", None), ("b.test", 2, False, "https://matomo.b.test/m.js", "script", "net::ERR_ABORTED"),
        *[("b.test", 10 + k, False, f"https://t{k:02d}.third.test/p", "image", None) for k in range(28)],
    ),
)
CANDIDATES = Fixture(
    "candidates",
    "ord int, url string, slug string, id string, name string",
    (
        (0, "https://www.Alpha.example/x", None, None, "A"), (1, "https://alpha.example/", None, "ALPHA-EXAMPLE", "B"), (2, "https://b.example", "Bee", None, None),
        (3, "https://c.example", "bee", "other", None), (4, "https://d.example", "", "D", None), (5, "https://e-e.example:8443/p", None, None, None),
    ),
)
SCAN_SITES = Fixture(
    "scan_sites",
    "id string, url string, status string, outcome string, pages int, error string",
    (
        ("alpha-example", "https://a", "done", "ok", 4, None), ("bee", "https://b", "done", "timeout", 1, None), ("d", "https://d", "done", "dead", 0, None),
        ("x1", "https://x", "done", "blocked", 0, None), ("x2", "https://x", "done", "error", None, "boom"), ("x3", "https://x", "done", "refused", 0, None),
        ("x4", "https://x", "done", "robots_disallow", 0, None), ("x5", "https://x", "scanning", None, None, None), ("x6", "https://x", "done", "ok", 2, None),
    ),
)
SITE_BROWSE = Fixture("site_browse", "site string, browse_url string", (("a", "https://www.a.test/"), ("b", "https://b.test/home"), ("c", "https://c.test")))
SITE_LINKS = Fixture(
    "site_links",
    "site string, ord int, href string, type string",
    (
        ("a", 0, "https://a.test/", "internal"), ("a", 1, "https://a.test/team", "internal"), ("a", 2, "https://www.a.test/contact-us/", "internal"), ("a", 3, "https://a.test/contact.pdf", "internal"),
        ("a", 4, "https://a.test/services", "internal"), ("a", 5, "https://x.test/about", "external"), ("b", 0, "https://b.test/contact-team", "internal"), ("b", 1, "https://b.test/contact-team/", "internal"),
        ("b", 2, "https://b.test/staff", "internal"), ("c", 0, "https://c.test/tax", "internal"), ("c", 1, "mailto:a@c.test", "email"), ("c", 2, "https://c.test/SERVICES", "internal"),
    ),
)
BOXES = Fixture(
    "boxes",
    "site string, ord int, kind string, text string, width double, height double, top double, right_px double, font_px double, client_width int, scroll_width int, inner_height int",
    (
        ("a", 0, "element", None, 500.0, 20.0, 0.0, 500.0, None, 390, 460, 844), ("a", 1, "element", None, 300.0, 20.0, 0.0, 398.0, None, 390, 460, 844),
        ("a", 2, "text", "abc", 10.0, 10.0, 0.0, 10.0, 11.5, 390, 460, 844), ("a", 3, "text", "ab", 10.0, 10.0, 0.0, 10.0, 9.0, 390, 460, 844), ("a", 4, "text", "abcd", 10.0, 10.0, 0.0, 10.0, 16.0, 390, 460, 844),
        ("a", 5, "tap", None, 39.0, 30.0, 10.0, 0.0, None, 390, 460, 844), ("a", 6, "tap", None, 50.0, 24.0, 844.0, 0.0, None, 390, 460, 844), ("a", 7, "tap", None, 50.0, 20.0, 900.0, 0.0, None, 390, 460, 844),
        ("b", 0, "text", "xyz", 0.0, 10.0, 0.0, 0.0, 8.0, 390, 390, 844),
    ),
)
FAVICON = Fixture("favicon", "site string, n_icons int, ico_status int", (("a", 1, None), ("b", 0, 200), ("c", 0, 404)))
OUTCOMES = Fixture(
    "outcomes",
    "site string, refused string, robots boolean, dead boolean, title string, home_failed boolean, error string",
    (
        ("a", None, False, False, "Home", False, None), ("b", "refused", False, False, None, False, None), ("c", None, True, True, None, False, None), ("d", None, False, True, None, False, None),
        ("e", None, False, False, "Just a moment...", False, None), ("f", None, False, False, "Attention Required! | X", True, None), ("g", None, False, False, None, True, None),
        ("h", None, False, False, "x", False, "boom"),
    ),
)
BUDGET_STEPS = Fixture("budget_steps", "site string, n int, took_ms bigint", (("a", 1, 40000), ("a", 2, 50000), ("a", 3, 10), ("a", 4, 10), ("b", 1, 90001), ("b", 2, 5)))
JOBS = Fixture(
    "jobs",
    "job_id string, kind string, spec string, spec_hash string, status string, created_at timestamp, started_at timestamp, finished_at timestamp, attempt int, pid bigint, alive boolean, bytes bigint",
    (
        ("a1", "crawl", "{}", "h1", "succeeded", "2024-01-01 00:00:00", "2024-01-01 00:00:01", "2024-01-01 00:05:00", 1, None, None, 500),
        ("a2", "crawl", "{}", "h2", "failed", "2024-01-02 00:00:00", "2024-01-02 00:00:01", "2024-01-02 00:05:00", 1, None, None, 300),
        ("a3", "scan", "{}", "h3", "cancelled", "2024-01-03 00:00:00", None, None, 0, None, None, 0),
        ("a4", "crawl", "{}", "h1", "queued", "2024-02-01 00:00:00", None, None, 0, None, None, 0),
        ("a5", "scan", "{}", "h4", "queued", "2024-02-01 00:01:00", None, None, 2, None, None, 0),
        ("a6", "crawl", "{}", "h5", "running", "2024-02-01 00:02:00", "2024-02-01 00:02:01", None, 1, 10, True, 900),
        ("a7", "crawl", "{}", "h6", "running", "2024-02-01 00:03:00", "2024-02-01 00:03:01", None, 1, 11, False, 100),
        ("a8", "crawl", "{}", "h7", "running", "2024-02-01 00:04:00", "2024-02-01 00:04:01", None, 2, None, None, 100),
        ("a9", "crawl", "{}", "h8", "succeeded", "2024-02-01 00:05:00", "2024-02-01 00:05:01", "2024-02-01 00:10:00", 1, None, None, 250),
        ("b1", "scan", "{}", "h8", "succeeded", "2024-02-01 00:06:00", "2024-02-01 00:06:01", "2024-02-01 00:09:00", 1, None, None, 250),
    ),
)
JOB_REQUESTS = Fixture(
    "job_requests",
    "request_id string, spec_hash string, now timestamp",
    (
        ("r1", "h1", "2024-02-01 00:30:00"), ("r2", "h8", "2024-02-01 00:25:00"), ("r3", "h8", "2024-02-01 00:25:01"), ("r4", "h5", "2024-03-01 00:00:00"), ("r5", "h2", "2024-01-02 00:06:00"),
        ("r6", "h9", "2024-02-01 00:00:00"), ("r7", "h8", "2024-02-01 00:24:00"),
    ),
)
ENDS = Fixture(
    "ends",
    "job_id string, cancelled boolean, oversized boolean, timed_out boolean, exit_code int, error_code string",
    (
        ("a", True, True, False, 0, None), ("b", False, True, True, 0, None), ("c", False, False, True, 1, "x"), ("d", False, False, False, 0, "x"), ("e", False, False, False, 3, None),
        ("f", False, False, False, 3, "stopped"), ("g", False, False, False, 1, None), ("h", False, False, False, 1, "oom"), ("i", False, False, False, None, None),
    ),
)
EVENTS = Fixture(
    "worker_events",
    "job_id string, seq bigint, at_ms bigint, type string, payload string",
    (
        ("j1", 1, 1700000000000, "progress", '{"type":"progress","pagesCrawled":"0","currentUrl":"u0"}'), ("j1", 2, 1700000001000, "progress", '{"type":"progress","pagesCrawled":"1"}'),
        ("j1", 3, 1700000001501, "progress", '{"type":"progress","pagesCrawled":"2","currentUrl":"u2"}'), ("j1", 4, 1700000003001, "progress", '{"type":"progress","pagesCrawled":"3"}'),
        ("j1", 5, 1700000003100, "log", "not json"), ("j1", 6, 1700000003500, "progress", '{"type":"progress","pagesCrawled":"4"}'), ("j1", 7, 1700000004000, "result", '{"type":"result"}'),
        ("j2", 1, 1700000000000, "progress", '{"type":"progress","sitesDone":"1"}'), ("j2", 2, 1700000009000, "error", '{"type":"error"}'),
    ),
)
CRAWL_BODIES = Fixture(
    "crawl_bodies",
    "id int, body string",
    tuple(
        enumerate(
            (
                '{"rootUrl":"https://a.test"}', "{}", "", '{"rootUrl":" "}', '{"rootUrl":"https://a.test","maxpages":5}', '{"rootUrl":"https://a.test","maxPages":100000}',
                '{"rootUrl":"https://a.test","maxPages":0}', '{"rootUrl":"https://a.test","maxPages":"5"}', '{"rootUrl":"https://a.test","maxPages":2.5}',
                '{"rootUrl":"https://a.test","respectRobotsTxt":false}', '{"rootUrl":"https://a.test","respectRobotsTxt":true}', "{bad", "[1]", "7",
                '{"rootUrl":"https://a.test","crawlDepth":7}', '{"rootUrl":"https://a.test","crawlDepth":0}', '{"rootUrl":"https://a.test","timeoutMs":999}',
                '{"rootUrl":"https://a.test","captureMobile":1}', '{"rootUrl":"https://a.test","allowedDomains":["a",1]}', '{"rootUrl":"https://a.test","excludedPathPatterns":"x"}',
                '{"rootUrl":"https://a.test","navWaitUntil":"never"}', '{"rootUrl":"https://a.test","navWaitUntil":null}', '{"rootUrl":"https://a.test","targetMarket":""}',
                '{"rootUrl":5}', '{"rootUrl":"https://a.test","allowedDomains":["1","2","3","4","5","6","7","8","9","10","11","12","13","14","15","16","17","18","19","20","21"]}',
            )
        )
    ),
)
SCAN_BODIES = Fixture(
    "scan_bodies",
    "id int, body string",
    tuple(
        enumerate(
            (
                '{"candidates":["https://a.test"]}', '{"candidates":[]}', "{}", '{"candidates":"x"}', '{"candidates":[{"url":"https://a.test","slug":"../../etc"}]}',
                '{"candidates":[{"url":"https://a.test","slug":"ok-1","id":"z"}]}', '{"candidates":["https://a.test"," "]}', '{"candidates":[{"url":"https://a.test","name":5}]}',
                '{"candidates":[{"url":"https://a.test","foo":1}]}', '{"candidates":["https://a.test"],"concurrency":9}', '{"candidates":["https://a.test"],"force":"yes"}',
                '{"candidates":["https://a.test"],"respectRobotsTxt":false}', '{"candidates":["https://a.test"],"siteBudgetMs":9999}', '{"candidates":["https://a.test"],"x":1}',
                '{"candidates":[7]}', '{"candidates":[' + ",".join(['"https://a.test"'] * 501) + "]}", '{"candidates":["https://a.test"],"maxPagesPerSite":10}',
            )
        )
    ),
)
SUBMITTED = Fixture(
    "submitted",
    "request_id string, kind string, blocked string",
    (("r1", "crawl", None), ("r2", "crawl", "url_private_address"), ("r3", "scan", "url_private_address"), ("r3", "scan", None), ("r4", "scan", "url_invalid"), ("r4", "scan", "url_private_address")),
)


def _header(**changes) -> tuple:
    base = {
        "schemaVersion": "0.1", "rootUrl": "https://a.test", "allowedDomains": "a.test,www.a.test", "maxPages": "50", "robotsTxtFound": "true", "sitemapXmlFound": "true",
        "captureMobile": "true", "captureDesktop": "true", "pagesCrawled": "12",
    }
    return tuple(("a", k, v) for k, v in (base | changes).items())


HEAD_BEFORE = Fixture("head_before", "site string, field string, value string", _header())
HEAD_AFTER = Fixture("head_after", "site string, field string, value string", _header(pagesCrawled="11", sitemapXmlFound="false", crawlDate="x"))
PAGES_BEFORE = Fixture("pages_before", "site string, slug string", (("a", "home"), ("a", "about"), ("a", "team")))
PAGES_AFTER = Fixture("pages_after", "site string, slug string", (("a", "home"), ("a", "about"), ("a", "news")))
SKIPS_BEFORE = Fixture("skips_before", "site string, reason string", (("a", "offsite"), ("a", "offsite"), ("b", "non_html")))
SKIPS_AFTER = Fixture("skips_after", "site string, reason string", (("a", "offsite"), ("a", "rate_limited"), ("b", "non_html"), ("c", "offsite")))
COUNTS_BEFORE = Fixture("counts_before", "site string, slug string, key string, n bigint", (("a", "home", "links", 20), ("a", "home", "images", 5), ("a", "home", "forms", 0), ("a", "about", "links", 100), ("a", "gone", "links", 3)))
COUNTS_AFTER = Fixture("counts_after", "site string, slug string, key string, n bigint", (("a", "home", "links", 23), ("a", "home", "images", 0), ("a", "home", "forms", 2), ("a", "about", "links", 116)))
FILES_AFTER = Fixture("files_after", "site string, slug string, file string", tuple(("a", s, f) for s in ("home", "about") for f in ("links.json", "images.json", "headings.json", "readable.md", "accessibility-tree.json")))
ASSETS_BEFORE = Fixture("assets_before", "site string, id string, role string", tuple((s, f"i{k}", None) for s, n in (("a", 10), ("b", 3), ("c", 2)) for k in range(n)))
ASSETS_AFTER = Fixture("assets_after", "site string, id string, role string", (*[("a", f"i{k}", None) for k in range(8)], ("c", "i0", "logo"), ("c", "i1", None)))

HTML_PAGES = Fixture(
    "html_pages",
    "page_id bigint, url string, html string",
    (
        (
            1, "https://a.test/team",
            '<html><head><meta property="og:image" content="/og.jpg"><script type="application/ld+json">{"@type":"ImageObject","url":"/ld.jpg","name":"Org"}</script></head><body><h2>Team</h2>'
            '<img src="/jo.jpg" alt="Jo"><img src="/al.png" alt=""><img src="/jo.jpg" alt="again"><form method="post" action="/send"><input name="mail"><input type="hidden" name="k"><textarea name="msg"></textarea></form>'
            "<button>Send</button><button></button></body></html>",
        ),
        (
            2, "https://a.test/news",
            '<html><head><meta property="og:image" content="https://cdn.test/n.jpg"><script type="application/ld+json">{bad</script><script type="litespeed/javascript">x</script></head><body><p>News</p><form action="/q"><input name="q"></form>'
            "<button>Search</button><button>More</button></body></html>",
        ),
        (3, "https://b.test/", '<html><body><img src="/jo.jpg" alt="B"><p>none</p></body></html>'),
        (4, "https://b.test/empty", ""),
    ),
)
JOB_DELETES = Fixture("job_deletes", "job_id string", (("a1",), ("a9",), ("no such job",)))
