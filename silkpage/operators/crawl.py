"""Crawl rules: the frontier gate, frontier simulation over a captured link graph,
robots and sitemap parsing, slugs and crawl totals.

The frontier of one site is a sequential fold (a page's links decide what is fetched
next), bounded by max_pages and the site's own link graph; sites run in parallel.
"""

from __future__ import annotations

import heapq
import itertools
import re
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from silkpage.config import BACKOFF_MS, CRAWL, EXCLUDED_PATHS, RETRIES, RETRY_CAP_MS
from silkpage.functions.urls import URL_RE, host_allowed, normalize, path_excluded, robots_blocked


def gate(url: Column, depth: Column, domains: Sequence[str], disallow: Column, guard: Column, excluded: Sequence[str] = EXCLUDED_PATHS, max_depth: int = CRAWL["depth"]) -> Column:
    """Why a URL is skipped, in this order; null if it may be fetched."""
    return (
        F.when(~host_allowed(url, domains), "offsite")
        .when(path_excluded(url, excluded), "excluded_path")
        .when(robots_blocked(url, disallow), "robots_disallow")
        .when(depth > max_depth, "depth_exceeded")
        .otherwise(guard)
    )


def robots_lines(robots: DataFrame) -> DataFrame:
    """origin, n, kind (disallow or sitemap), value of what applies to every agent.

    Each agent line decides for the lines after it; sitemaps count anywhere."""
    lines = robots.select("origin", F.posexplode(F.split(F.coalesce("body", F.lit("")), r"\r?\n")).alias("n", "raw"))
    line = F.trim(F.regexp_replace("raw", r"^\s+|\s+$", ""))
    lines = lines.withColumn("line", line).filter("line <> '' and not startswith(line, '#')")
    key = F.lower(F.trim(F.regexp_extract("line", r"^([^:]*)", 1)))
    value = F.trim(F.regexp_extract("line", r"^[^:]*:(.*)$", 1))
    lines = lines.withColumns({"k": key, "value": value})
    agent = F.last(F.when(F.col("k") == "user-agent", F.col("value")), ignorenulls=True)
    # One robots file is one short text, so its lines fit one task.
    lines = lines.withColumn("agent", agent.over(Window.partitionBy("origin").orderBy("n")))
    keep = (F.col("k") == "sitemap") | (F.col("k") == "disallow") & (F.col("agent") == "*") & (F.col("value") != "")
    return lines.filter(keep).select("origin", "n", F.col("k").alias("kind"), "value")


LOC = r"(?i)<loc>\s*([^<]+?)\s*</loc>"


def sitemap_locs(xml: Column) -> Column:
    return F.regexp_extract_all(xml, F.lit(LOC), F.lit(1))


def is_sitemap_index(xml: Column) -> Column:
    return xml.rlike("(?i)<sitemapindex")


def walk_sitemaps(roots: DataFrame, fetched: DataFrame, max_depth: int = 3) -> DataFrame:
    """Distinct (site, loc) found from roots(site, url) in fetched(url, xml): indexes lead to
    their children, down to max_depth; a sitemap is read once a site."""
    frontier, seen, out = roots.select("site", "url").distinct(), None, None
    pages = fetched.select("url", "xml")
    for _ in range(max_depth + 1):
        got = frontier.join(pages, "url").select("site", "url", is_sitemap_index(F.col("xml")).alias("index"), F.explode(sitemap_locs(F.col("xml"))).alias("loc"))
        found = got.filter("not index").select("site", "loc")
        out = found if out is None else out.union(found)
        seen = frontier if seen is None else seen.union(frontier)
        frontier = got.filter("index").select("site", F.col("loc").alias("url")).distinct().join(seen, ["site", "url"], "left_anti")
    return out.distinct()


def unique_slugs(pages: DataFrame, base: str = "base", order: Sequence[str] = ("site", "seq")) -> DataFrame:
    """pages with slug: base, base-1, ... the first that its site has not used, in order.

    Pages of one base are numbered by a window, which is right unless a base looks like a
    made-up slug (it ends in a number and what stands before it is a base of the site too).
    Only bases that are linked in this way are folded in order, as one group of a site and
    the stem that they share; a site's other pages need no common task. Null bases have no
    slug; of equal seq the smaller base goes first."""
    site, seq = order
    named = F.coalesce(F.col(site).cast("string"), F.lit("\x00"))  # a null site is one of its own
    keys = pages.select(named.alias(site), F.col(seq).cast("bigint").alias(seq), base).filter(F.col(base).isNotNull())
    stem = F.regexp_replace(base, r"(-[0-9]+)+$", "")
    bases = keys.select(site, base, stem.alias("stem")).distinct()
    several = bases.groupBy(site, "stem").agg((F.count(F.lit(1)) > 1).alias("linked"))
    keys = keys.withColumn("stem", stem).join(several, [site, "stem"])
    n = F.row_number().over(Window.partitionBy(site, base).orderBy(seq)) - 1
    plain = keys.filter("not linked").withColumn("slug", F.when(n == 0, F.col(base)).otherwise(F.concat_ws("-", base, n))).select(site, seq, base, "slug")
    schema = f"{site} string, {seq} bigint, {base} string, slug string"

    def fold(group: pa.Table) -> pa.Table:
        used: set[str] = set()
        following: dict[str, int] = {}  # base -> the next number to try
        rows = sorted(zip(group.column(seq).to_pylist(), group.column(base).to_pylist(), group.column(site).to_pylist(), strict=True), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        out = []
        for _, b, _s in rows:
            slug, k = b, following.get(b, 1)
            while slug in used:
                slug, k = f"{b}-{k}", k + 1
            following[b] = k
            used.add(slug)
            out.append(slug)
        return pa.table({site: pa.array([r[2] for r in rows], pa.string()), seq: pa.array([r[0] for r in rows], pa.int64()), base: pa.array([r[1] for r in rows], pa.string()), "slug": pa.array(out, pa.string())})

    folded = keys.filter("linked").select(site, seq, base, "stem").groupBy(site, "stem").applyInArrow(fold, schema)
    slugs = plain.union(folded).toDF("__site", "__seq", "__base", "slug")
    on = (named == F.col("__site")) & F.col(seq).cast("bigint").eqNullSafe(F.col("__seq")) & (F.col(base) == F.col("__base"))
    return pages.join(slugs, on, "left").drop("__site", "__seq", "__base")


class Frontier:
    """URLs waiting for one site: lowest tier first, first in first out inside a tier.
    A URL found again at a better tier goes to that tier's end."""

    def __init__(self):
        self.heap: list[tuple[int, int, str]] = []
        self.entry: dict[str, list] = {}  # url -> [tier, depth, ticket]
        self.tickets = itertools.count()

    def push(self, url: str, depth: int, tier: int) -> None:
        ticket = next(self.tickets)
        self.entry[url] = [tier, depth, ticket]
        heapq.heappush(self.heap, (tier, ticket, url))

    def offer(self, url: str, depth: int, tier: int) -> bool:
        """Whether the URL was waiting; improves it if so."""
        have = self.entry.get(url)
        if have is None:
            return False
        if tier < have[0]:
            have[0], have[2] = tier, next(self.tickets)
            heapq.heappush(self.heap, (tier, have[2], url))
        have[1] = min(have[1], depth)
        return True

    def pop(self) -> tuple[str, int, int] | None:
        while self.heap:
            tier, ticket, url = heapq.heappop(self.heap)
            have = self.entry.get(url)
            if have is not None and have[2] == ticket:
                del self.entry[url]
                return url, have[1], tier
        return None


def _host(url: str | None) -> str:
    m = re.match(URL_RE, url or "")
    return re.sub(r":\d+$", "", m[2].lower().rpartition("@")[2]) if m else ""


def _path(url: str) -> str:
    m = re.match(URL_RE, url)
    return (m[3] or "/") if m else ""


CRAWL_OUT = "site string, kind string, seq int, url string, final_url string, depth int, tier int, status int, reason string, attempts int, delays array<bigint>"


def simulate(graph: DataFrame, specs: DataFrame, max_pages: int = CRAWL["max_pages"], max_depth: int = CRAWL["depth"], excluded: Sequence[str] = EXCLUDED_PATHS) -> DataFrame:
    """Pages, skips and left-over totals of each site's crawl, in order.

    graph: site, url, final_url, status, content_type, retry_after (seconds, null: none),
    links array<struct<href, appears_in>>; a URL that answers 429 has one row for each
    answer, by `attempt`. specs: site, root, domains, disallow, sitemap arrays of strings.
    """

    def run(spec: pa.Table, pages: pa.Table) -> pa.Table:
        out: list[tuple] = []
        answers: dict[str, list[dict]] = {}
        for r in sorted(pages.to_pylist(), key=lambda r: r.get("attempt") or 0):
            answers.setdefault(r["url"], []).append(r)
        for s in spec.to_pylist():
            allowed = {d.lower() for d in s["domains"]}
            frontier, queued, done, tries = Frontier(), set(), {}, {}
            start = normalize(s["root"])
            frontier.push(start, 0, 0)
            queued.add(start)
            for u in s["sitemap"]:
                if _host(u) in allowed and u not in queued:
                    frontier.push(u, 1, 2)
                    queued.add(u)
            discovered, seq = len(queued), 0
            delays: dict[str, list[int]] = {}

            def skip(url, reason, depth, tier, final=None, attempts=None, site=s["site"], delays=delays):
                out.append((site, "skip", len(out), url, final, depth, tier, None, reason, attempts, delays.get(url)))

            while len(done) < max_pages and (entry := frontier.pop()):
                url, depth, tier = entry
                if url in done:
                    continue
                if _host(url) not in allowed:
                    skip(url, "offsite", depth, tier)
                elif any(_path(url).lower().startswith(p.lower()) for p in excluded):
                    skip(url, "excluded_path", depth, tier)
                elif any(_path(url).startswith(d) for d in s["disallow"]):
                    skip(url, "robots_disallow", depth, tier)
                elif depth > max_depth:
                    skip(url, "depth_exceeded", depth, tier)
                else:
                    got = answers.get(url)
                    if not got:
                        out.append((s["site"], "error", len(out), url, None, depth, tier, 0, "no_answer", None, None))
                        continue
                    attempt = tries.get(url, 0)
                    r = got[min(attempt, len(got) - 1)]
                    final = normalize(r["final_url"] or url)
                    if _host(final) not in allowed:
                        skip(url, "offsite_redirect", depth, tier, final)
                    elif r["status"] == 429:
                        if attempt >= RETRIES:
                            skip(url, "rate_limited", depth, tier, None, attempt)
                        else:
                            tries[url] = attempt + 1
                            asked = r["retry_after"]
                            wait = asked * 1000 if asked is not None and asked >= 0 else BACKOFF_MS * 2**attempt
                            delays.setdefault(url, []).append(min(wait, RETRY_CAP_MS))
                            frontier.push(url, depth, tier)
                    elif r["content_type"] and "html" not in r["content_type"]:
                        skip(url, "non_html", depth, tier)
                    else:
                        done[url] = True
                        out.append((s["site"], "page", seq, url, final, depth, tier, r["status"], None, tries.get(url, 0), delays.get(url)))
                        seq += 1
                        if depth < max_depth:
                            for link in r["links"] or ():
                                n = normalize(link["href"], final)
                                if not n or n in done or _host(n) not in allowed:
                                    continue
                                better = 0 if link["appears_in"] in ("header", "navigation", "footer") else 1
                                if frontier.offer(n, depth + 1, better) or n in queued:
                                    continue
                                queued.add(n)
                                discovered += 1
                                frontier.push(n, depth + 1, better)
            out.append((s["site"], "total", discovered, s["root"], None, None, None, None, None, None, None))
        kinds = [pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.list_(pa.int64())]
        names = [c.split()[0] for c in CRAWL_OUT.split(", ")]
        cols = list(zip(*out, strict=True)) if out else [()] * len(names)
        return pa.table({n: pa.array(c, k) for n, c, k in zip(names, cols, kinds, strict=True)})

    return specs.groupBy("site").cogroup(graph.groupBy("site")).applyInArrow(run, CRAWL_OUT)
