"""Batch-scan rules over probe, link, network and layout inputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from silkpage.config import ANALYTICS_HOSTS, LINK_SAMPLE, PAGE_PATTERNS
from silkpage.functions.urls import host_of, norm_path, path_of, slug_from_url

TERMINAL = ("ok", "dead", "blocked")
MAX_HOPS = 5
CHALLENGE = r"(?i)just a moment|attention required|checking your browser"
DOCUMENT_LINK = r"(?i)\.(pdf|jpg|jpeg|png|gif|zip|docx?)$"
STATIC_LINK = r"(?i)\.(jpg|jpeg|png|gif|css|js|ico|svg|woff2?)(\?|$)"


def candidates(df: DataFrame) -> DataFrame:
    """First of each lower-cased id (slug, id, or made from the URL); keeps ord."""
    key = F.lower(F.coalesce(F.nullif(F.col("slug"), F.lit("")), F.nullif(F.col("id"), F.lit("")), slug_from_url(F.col("url"))))
    first = Window.partitionBy("site_id").orderBy("ord")
    return df.withColumn("site_id", key).withColumn("rn", F.row_number().over(first)).filter("rn = 1").drop("rn")


def to_scan(cands: DataFrame, done: DataFrame, force: bool = False) -> DataFrame:
    """Candidates without a final outcome; all of them under force."""
    settled = done.filter(F.col("outcome").isin(*TERMINAL)).select(F.col("id").alias("site_id"))
    return cands if force else cands.join(settled, "site_id", "left_anti")


def follow(hops: DataFrame) -> DataFrame:
    """site, scheme, ok, final_url, final_status, n_hops, error from request records in order.

    A redirect leads on, at most MAX_HOPS times; the first other answer or error ends it."""
    w = Window.partitionBy("site", "scheme").orderBy("hop")
    moves = F.col("status").between(300, 399) & F.col("location").isNotNull() & F.col("error").isNull()
    rows = hops.withColumn("moves", F.coalesce(moves, F.lit(False)))
    ended = F.coalesce(F.max(F.when(~F.col("moves"), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("ended", ended).filter((F.col("ended") == 0) & (F.col("hop") <= MAX_HOPS))
    last = rows.groupBy("site", "scheme").agg(
        F.max_by(F.struct("url", "status", "location", "error", "moves"), "hop").alias("l"), F.count(F.lit(1)).alias("n_hops")
    )
    too_many = F.col("l.moves")
    error = F.when(too_many, "too_many_redirects").otherwise(F.col("l.error"))
    status = F.when(error.isNull(), F.col("l.status")).otherwise(0)
    return last.select(
        "site",
        "scheme",
        (error.isNull() & (status > 0) & (status < 500)).alias("ok"),
        F.when(too_many, F.col("l.location")).otherwise(F.col("l.url")).alias("final_url"),
        status.alias("final_status"),
        "n_hops",
        error.alias("error"),
    )


def preflight(hops: DataFrame) -> DataFrame:
    """One row a site: both probes merged, https first."""
    p = follow(hops)
    side = lambda s, c: F.max(F.when(F.col("scheme") == s, F.col(c)))
    g = p.groupBy("site").agg(*[side(s, c).alias(f"{s}_{c}") for s in ("http", "https") for c in ("ok", "final_url", "error")])
    browse = F.when(F.col("https_ok"), F.col("https_final_url")).when(F.col("http_ok"), F.col("http_final_url"))
    lands = F.coalesce(F.col("http_ok") & F.lower("http_final_url").startswith("https:"), F.lit(False))
    return g.select("site", lands.alias("http_lands_on_https"), browse.alias("browse_url"), browse.isNull().alias("dead"), "http_error", "https_error")


def outcome(refused: Column, robots: Column, dead: Column, title: Column, home_failed: Column, error: Column) -> Column:
    """A site's outcome: the first that applies."""
    return (
        F.when(error.isNotNull(), "error")
        .when(refused.isNotNull(), refused)
        .when(robots, "robots_disallow")
        .when(dead, "dead")
        .when(title.rlike(CHALLENGE), "blocked")
        .when(home_failed, "timeout")
        .otherwise("ok")
    )


def network_rollup(requests: DataFrame, analytics: tuple[str, ...] = ANALYTICS_HOSTS) -> DataFrame:
    """site, kind (analytics, third_party, mixed, failed), n, value in first-seen order.

    A repeated request to an analytics host counts as third party too: only its first
    sighting is taken by the analytics list."""
    rows = requests.withColumn("host", host_of(F.col("url")))
    is_analytics = F.lit(False)
    for a in analytics:
        is_analytics = is_analytics | F.col("host").contains(a)
    rows = rows.withColumn("is_analytics", is_analytics)
    by_host = Window.partitionBy("site", "host").orderBy("seq")
    rows = rows.withColumn("sighting", F.row_number().over(by_host))
    hosts = rows.filter("host is not null")
    seen = hosts.filter("is_analytics and sighting = 1").select("site", "seq", F.lit("analytics").alias("kind"), F.col("host").alias("value"))
    rest = hosts.filter("not (is_analytics and sighting = 1) and not contains(host, site)")
    third = rest.groupBy("site", F.col("host").alias("value")).agg(F.min("seq").alias("seq")).select("site", "seq", F.lit("third_party").alias("kind"), "value")
    mixed = rows.filter("page_https and startswith(url, 'http://') and not startswith(url, 'http://localhost')").select(
        "site", "seq", F.lit("mixed").alias("kind"), F.substring("url", 1, 300).alias("value")
    )
    failed = rows.filter("failure is not null").select("site", "seq", F.lit("failed").alias("kind"), F.substring("url", 1, 300).alias("value"))
    caps = {"third_party": 25, "mixed": 20, "failed": 30}
    every = seen.union(third).union(mixed).union(failed).withColumn("n", F.row_number().over(Window.partitionBy("site", "kind").orderBy("seq", "value")))
    cap = F.lit(2**31 - 1)
    for k, v in caps.items():
        cap = F.when(F.col("kind") == k, v).otherwise(cap)
    return every.filter(F.col("n") <= cap).select("site", "kind", "n", "value")


def key_pages(links: DataFrame, browse: DataFrame, max_extra: int = 3) -> DataFrame:
    """site, grp, href: for each pattern in order of priority, the first internal page of the
    site that it matches and that is not chosen yet; at most max_extra."""
    bare = F.regexp_replace(host_of(F.col("href")), r"^www\.", "")
    home = F.regexp_replace(host_of(F.col("browse_url")), r"^www\.", "")
    rows = links.join(browse, "site").withColumns({"key": norm_path(F.col("href")), "home": norm_path(F.col("browse_url")), "path": path_of(F.col("href"))})
    rows = rows.filter((F.col("type") == "internal") & (bare == home) & ~F.col("path").rlike(DOCUMENT_LINK) & (F.col("key") != F.col("home")))
    chosen = None
    for group, pattern in PAGE_PATTERNS:
        left = rows if chosen is None else rows.join(chosen.select("site", "key"), ["site", "key"], "left_anti")
        hit = left.filter(F.col("path").rlike(f"(?i){pattern}")).groupBy("site").agg(F.min_by(F.struct("key", "href"), "ord").alias("b"))
        hit = hit.select("site", F.lit(group).alias("grp"), F.col("b.key").alias("key"), F.col("b.href").alias("href"))
        if chosen is not None:
            full = chosen.groupBy("site").count().filter(F.col("count") >= max_extra).select("site")
            hit = hit.join(full, "site", "left_anti")
        chosen = hit if chosen is None else chosen.union(hit)
    return chosen.select("site", "grp", "href")


def link_sample(links: DataFrame, by: str = "page_id", size: int = LINK_SAMPLE) -> DataFrame:
    """First `size` different internal links of each page that are no static files."""
    inner = links.filter((F.col("type") == "internal") & ~F.col("href").rlike(STATIC_LINK))
    firsts = inner.groupBy(by, "href").agg(F.min("ord").alias("ord"))
    n = F.row_number().over(Window.partitionBy(by).orderBy("ord"))
    return firsts.withColumn("n", n).filter(F.col("n") <= size).select(by, "n", "href")


def mobile_metrics(boxes: DataFrame) -> DataFrame:
    """Tallies of a page's layout records: element boxes, sampled text and tap targets."""
    over = (F.col("kind") == "element") & (F.col("width") > 0) & (F.col("right_px") > F.col("client_width") + 8)
    text = (F.col("kind") == "text") & (F.char_length("text") >= 3) & (F.col("width") > 0) & (F.col("height") > 0)
    tap = (F.col("kind") == "tap") & (F.col("top") <= F.col("inner_height")) & (F.col("width") > 0) & (F.col("height") > 0)
    kind = F.when(over & (F.col("ord") <= 3000), "over").when(text, "text").when(tap, "tap")
    rows = boxes.withColumn("counts", kind).filter("counts is not null")
    rows = rows.withColumn("n", F.row_number().over(Window.partitionBy("site", "counts").orderBy("ord")))
    cap = F.when(F.col("counts") == "over", 10).when(F.col("counts") == "text", 200).otherwise(60)
    rows = rows.filter(F.col("n") <= cap)
    got = rows.groupBy("site").agg(
        F.count_if(F.col("counts") == "over").alias("overflowing"),
        F.count_if(F.col("counts") == "text").alias("text_sampled"),
        F.count_if((F.col("counts") == "text") & (F.col("font_px") < 12)).alias("tiny_text"),
        F.count_if(F.col("counts") == "tap").alias("taps"),
        F.count_if((F.col("counts") == "tap") & ((F.col("width") < 40) | (F.col("height") < 24))).alias("small_taps"),
    )
    page = boxes.groupBy("site").agg(F.greatest(F.lit(0), F.max("scroll_width") - F.max("client_width")).alias("overflow_px"))
    return page.join(got, "site", "left").na.fill(0)


def rollup(sites: DataFrame) -> DataFrame:
    """Sites by outcome; one left without any counts as incomplete."""
    return sites.groupBy(F.coalesce("outcome", F.lit("incomplete")).alias("outcome")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("pages", F.lit(0))).alias("pages"))


def within_budget(steps: DataFrame, budget: Column) -> DataFrame:
    """Steps of each site that begin before its time is used up."""
    w = Window.partitionBy("site").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    return steps.withColumn("started_ms", F.coalesce(F.sum("took_ms").over(w), F.lit(0))).filter(F.col("started_ms") <= budget)
