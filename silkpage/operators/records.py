"""Records of crawls, scans and jobs that are put together from several inputs.

Defined cases, unless a function says otherwise: null inputs give null results; empty
tables give empty results; repeated rows are judged each; of rows that tie, the smallest
value of the remaining columns counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from silkpage.config import CRAWL, MAX_PAGES_CEILING, OVERFLOW_LIMIT, RESPONSE_HEADERS
from silkpage.functions.net import ip_block_reason, url_guard
from silkpage.functions.text import round_half_up
from silkpage.functions.urls import host_of

RETRY_WITH_GET = (403, 405, 501)
KINDS = {"crawls": "crawl", "scans": "scan", "shots": "shot"}


def _filled(c: str) -> Column:
    return F.nullif(F.col(c), F.lit(""))


def crawl_specs(specs: DataFrame, max_pages: int = CRAWL["max_pages"], depth: int = CRAWL["depth"]) -> DataFrame:
    """specs (id, root_url, max_pages, crawl_depth, allowed_domains) with what is not given
    filled in. Without domains the root's host counts, with and without www.; without a
    root the spec is invalid."""
    bare = F.regexp_replace(host_of(F.col("root_url")), r"^www\.", "")
    given = F.coalesce(F.size("allowed_domains"), F.lit(0)) > 0
    bad = _filled("root_url").isNull()
    return specs.select(
        "id",
        F.when(bad, "spec_invalid").alias("error"),
        "root_url",
        F.coalesce("max_pages", F.lit(max_pages)).alias("max_pages"),
        F.coalesce("crawl_depth", F.lit(depth)).alias("crawl_depth"),
        F.when(given, F.col("allowed_domains")).when(~bad, F.array(bare, F.concat(F.lit("www."), bare))).alias("allowed_domains"),
    )


def head_status(probes: DataFrame) -> DataFrame:
    """probes (url, head_status, head_error, get_status, get_error) with status: that of HEAD,
    or of GET where HEAD is refused; -1 after a time-out, 0 after another error."""
    one = lambda m: F.when(F.col(f"{m}_error") == "timeout", -1).when(F.col(f"{m}_error").isNotNull(), 0).otherwise(F.col(f"{m}_status"))
    return probes.withColumn("status", F.when(one("head").isin(*RETRY_WITH_GET), one("get")).otherwise(one("head")))


def link_checks(sample: DataFrame, probes: DataFrame) -> DataFrame:
    """Of sampled links (site, n, href): how many were probed, their statuses in order and
    how many are broken. A sample is a few links a site; one that was not probed is left out."""
    status = head_status(probes).select(F.col("url").alias("href"), "status")
    rows = sample.join(status, "href")
    checks = F.array_sort(F.collect_list(F.struct("n", F.col("href").alias("url"), "status")))
    text = F.array_join(F.transform(checks, lambda c: F.concat_ws(" ", c.getField("status").cast("string"), c.getField("url"))), ",")
    broken = (F.col("status") <= 0) | (F.col("status") >= 400)
    return rows.groupBy("site").agg(F.count(F.lit(1)).alias("sampled"), F.count_if(broken).alias("broken"), text.alias("checks"))


def response_headers(rows: DataFrame) -> DataFrame:
    """The headers that are kept, of rows (site, headers: map); empty ones are null."""
    name = lambda h: h.replace("-", "_")
    return rows.select("site", *[F.nullif(F.col("headers")[h], F.lit("")).alias(name(h)) for h in RESPONSE_HEADERS])


def page_source(rows: DataFrame) -> DataFrame:
    """The served HTML, else the rendered one; the snapshot of accessibility, else the tree."""
    return rows.select("page_id", F.coalesce(_filled("served"), F.col("rendered")).alias("html"), F.coalesce("snapshot", "tree").alias("accessibility"))


def timing(rows: DataFrame) -> DataFrame:
    """Milliseconds from the start of a navigation, halves up; no load time before the load."""
    since = lambda c: round_half_up(F.col(c) - F.col("start")).cast("bigint")
    return rows.select("page_id", since("response_end").alias("response_ms"), since("dom_end").alias("dom_content_loaded_ms"), F.when(F.col("load_end") > 0, since("load_end")).alias("load_ms"))


def fallback_to_http(rows: DataFrame) -> DataFrame:
    """Whether a site whose home page failed over https is opened once more over http."""
    again = ~F.col("home_ok") & ~F.col("blocked") & F.col("browse_url").rlike("(?i)^https:") & F.col("http_ok") & F.col("http_final_url").rlike("(?i)^http:")
    again = F.coalesce(again, F.lit(False))
    return rows.select("site", again.alias("falls_back"), F.when(again, F.col("http_final_url")).otherwise(F.col("browse_url")).alias("browse_url"))


def navigable(urls: DataFrame, answers: DataFrame) -> DataFrame:
    """url, code: why it must not be opened: its form first, then what its name resolves to.
    answers (host, address): a literal address needs none."""
    rows = urls.select("url", url_guard(F.col("url")).alias("form"), F.regexp_replace(host_of(F.col("url")), r"^\[|\]$", "").alias("host"))
    bad = answers.groupBy("host").agg(F.bool_or(ip_block_reason(F.col("address")).isNotNull()).alias("private"), F.count("address").alias("n"))
    literal = F.col("host").rlike(r"^[0-9.]+$|:")
    resolved = F.when(literal, F.lit(None)).when(F.coalesce("n", F.lit(0)) == 0, "url_dns_failed").when(F.col("private"), "url_private_address")
    return rows.join(bad, "host", "left").select("url", F.coalesce("form", resolved).alias("code"))


def image_flags(pages: DataFrame) -> DataFrame:
    """Whether all images of a page that answered 200 come from its metadata."""
    only = (F.col("status") == 200) & (F.col("n_dom") == 0) & (F.col("n_meta") > 0)
    return pages.select("page_id", F.coalesce(only, F.lit(False)).alias("from_metadata_only"))


def button_position(boxes: DataFrame) -> DataFrame:
    """Of buttons (page_id, ord, top, viewport): above or below the fold."""
    return boxes.select("page_id", "ord", F.when(F.col("top") < F.col("viewport"), "above_fold").otherwise("below_fold").alias("position"))


def block_ids(blocks: DataFrame, slugs: DataFrame) -> DataFrame:
    """Blocks (page_id, local_id) with the id that is written and the page they are from;
    slugs (page_id, slug, final_url)."""
    return blocks.join(slugs, "page_id").select("page_id", F.concat_ws(".", "slug", "local_id").alias("id"), F.col("final_url").alias("source_url"))


def screenshots(pages: DataFrame) -> DataFrame:
    """Paths of a page's screenshots below the crawl's folder; null where none is taken."""
    path = lambda d: F.when(F.col(d), F.concat(F.lit("pages/"), "slug", F.lit(f"/screenshot-{d}.png"))).alias(f"screenshot_{d}")
    return pages.select("page_id", path("desktop"), path("mobile"))


def overflowing(boxes: DataFrame, most: int = OVERFLOW_LIMIT, scanned: int = 3000) -> DataFrame:
    """The first elements of a page that stick out to the right: selector, right, width."""
    classes = F.filter(F.split(F.trim(F.coalesce("class", F.lit(""))), r"\s+"), lambda c: c != F.lit(""))
    mark = F.when(F.coalesce(_filled("dom_id"), F.lit("")) != "", F.concat(F.lit("#"), "dom_id")).when(F.size(classes) > 0, F.concat(F.lit("."), F.array_join(F.slice(classes, 1, 2), ".")))
    out = boxes.filter((F.col("ord") <= scanned) & (F.col("width") > 0) & (F.col("right_px") > F.col("client_width") + 8))
    n = F.row_number().over(Window.partitionBy("site").orderBy("ord"))
    half_up = lambda c: round_half_up(F.col(c)).cast("bigint")
    out = out.withColumn("n", n).filter(F.col("n") <= most)
    selector = F.substring(F.concat(F.lower("tag"), F.coalesce(mark, F.lit(""))), 1, 120)
    return out.select("site", "n", selector.alias("selector"), half_up("right_px").alias("right_px"), half_up("width").alias("width"))


def body_font(rows: DataFrame) -> DataFrame:
    """The number at the start of a CSS size; null without one, and for 0."""
    size = F.regexp_extract("font_size", r"^\s*([+-]?(?:\d+\.?\d*|\.\d+))", 1).try_cast("double")
    return rows.select("site", F.nullif(size, F.lit(0.0)).alias("body_font_px"))


def stripped(fields: Column) -> Column:
    """A map without the keys that have no value."""
    return F.map_filter(fields, lambda k, v: v.isNotNull())


def routed(requests: DataFrame) -> DataFrame:
    """method, path with what is asked for: kind, job and status: 404 no such route, 405
    no such method, 501 a kind that is not built, 200 where it is served."""
    path = F.coalesce(_filled("bare"), F.lit("/"))
    parts = F.filter(F.split(path, "/"), lambda p: p != F.lit(""))
    rows = requests.withColumn("bare", F.regexp_replace(F.regexp_replace("path", r"[?#].*$", ""), r"^/scrape(?=/|$)", "")).withColumn("p", parts)
    first, job, sub = (F.get("p", F.lit(i)) for i in range(3))
    kind = F.lit(None).cast("string")
    for name, k in KINDS.items():
        kind = F.when(first == name, k).otherwise(kind)
    method = F.col("method")
    status = (
        F.when((first == "health") & (method == "GET"), 200)
        .when(kind.isNull(), 404)
        .when(kind == "shot", 501)
        .when(job.isNull(), F.when(~method.isin("POST", "GET"), 405).otherwise(200))
        .when(sub.isin("log", "artefacts") & (method == "GET"), 200)
        .when(sub.isNotNull(), 404)
        .when(~method.isin("GET", "DELETE"), 405)
        .otherwise(200)
    )
    return rows.select("method", "path", kind.alias("kind"), F.when(kind.isNotNull(), job).alias("job_id"), status.cast("int").alias("status"))


def disk_health(usage: DataFrame) -> DataFrame:
    """Used space in percent with one decimal; null without a size."""
    return usage.select("host", F.round(F.when(F.col("total") > 0, F.lit(100.0) * F.col("used") / F.col("total")), 1).alias("disk_used_pct"))


def job_states(events: DataFrame) -> DataFrame:
    """The state of each job after its worker events (job_id, seq, type, payload).

    A result or an error is only a note: the first exit or cancellation decides, and what
    comes after it is ignored. The order of reasons is that of jobs.final_state."""
    from silkpage.operators.jobs import final_state

    ends = events.filter(F.col("type").isin("cancel", "exit")).groupBy("job_id").agg(F.min(F.struct("seq", "type", "payload")).alias("end"))
    rows = events.join(ends, "job_id", "left").filter(F.col("end").isNull() | (F.col("seq") <= F.col("end.seq")))
    code = F.get_json_object("payload", "$.error.code")
    did = lambda *kinds: F.bool_or(F.col("type").isin(*kinds))
    got = rows.groupBy("job_id").agg(
        F.first("end").alias("end"),
        did("start", "progress", "result", "error").alias("ran"),
        did("oversize").alias("oversized"),
        did("timeout").alias("timed_out"),
        F.max_by(code, F.when(code.isNotNull() & (F.col("type") == "error"), F.col("seq"))).alias("code"),
    )
    exit_code = F.get_json_object("end.payload", "$.exit").try_cast("int")
    cancelled = F.coalesce(F.col("end.type") == "cancel", F.lit(False))
    status, error = final_state(cancelled, F.col("oversized"), F.col("timed_out"), F.coalesce(exit_code, F.lit(1)), F.col("code"))
    open_ = F.col("end").isNull()
    return got.select("job_id", F.when(open_, F.when(F.col("ran"), "running").otherwise("queued")).otherwise(status).alias("status"), F.when(~open_, error).alias("code"))


def delete_jobs(jobs: DataFrame, requests: DataFrame) -> DataFrame:
    """What each request to delete a job answers: 404 for an unknown one; a running or queued
    job is cancelled first. The record goes in every case (remove_jobs)."""
    known = jobs.select("job_id", "status").withColumn("known", F.lit(True))
    rows = requests.select("job_id").distinct().join(known, "job_id", "left")
    cancels = F.col("status").isin("queued", "running")
    return rows.select(
        "job_id",
        F.when(F.col("known"), 200).otherwise(404).alias("answer"),
        F.coalesce(F.col("status") == "running", F.lit(False)).alias("was_running"),
        F.when(cancels, "cancelled").otherwise(F.col("status")).alias("last_status"),
    )


def remove_jobs(jobs: DataFrame, artefacts: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Job records and artefact files (job_id, path) without those of the deleted jobs."""
    gone = requests.select("job_id").distinct()
    return jobs.join(gone, "job_id", "left_anti"), artefacts.join(gone, "job_id", "left_anti")


def job_page(jobs: DataFrame, limit: int) -> DataFrame:
    """next_cursor of a page of jobs (job_list without a kind): its last id if it is full."""
    return jobs.agg(F.when(F.count(F.lit(1)) == limit, F.min("job_id")).alias("next_cursor"))


def crawl_records(specs: DataFrame, pages: DataFrame, skips: DataFrame, found: DataFrame, ceiling: int = MAX_PAGES_CEILING) -> DataFrame:
    """One row a crawl: its source, limits, totals and what was found beside the pages.

    specs: crawl_specs() with site; pages and skips: one row each with site; found: site,
    discovered, errors, assets, robots, sitemap."""
    count = lambda d, n: d.groupBy("site").agg(F.count(F.lit(1)).alias(n))
    rows = specs.filter("error is null").join(count(pages, "pages_crawled"), "site", "left").join(count(skips, "pages_skipped"), "site", "left").join(found, "site", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c)
    no = lambda c, n: F.coalesce(F.col(c), F.lit(False)).alias(n)
    return rows.select(
        "site", F.lit("0.1").alias("schema_version"), "root_url", F.array_join("allowed_domains", ",").alias("allowed_domains"), F.least("max_pages", F.lit(ceiling)).alias("max_pages"),
        zero("discovered"), zero("pages_crawled"), zero("pages_skipped"), zero("errors"), zero("assets"), no("robots", "robots_found"), no("sitemap", "sitemap_found"),
    )


def page_records(pages: DataFrame) -> DataFrame:
    """The page entries of a crawl's result: what the index keeps of each page."""
    canonical = F.coalesce(_filled("canonical_url"), F.col("final_url"))
    return pages.select("site", "slug", "final_url", canonical.alias("canonical_url"), "title", "status", "depth", F.to_json(stripped(F.col("counts"))).alias("counts"))


def site_records(probes: DataFrame, failures: DataFrame, icons: DataFrame, checks: DataFrame, network: DataFrame) -> DataFrame:
    """What a scan keeps of each site, one row: probe (site, browse_url, dead), the first
    failure (site, seq, stage, error), favicon (site, dom_link, ico_status), link checks
    (site, sampled, broken), and how many entries its network log has of each kind.

    A dead site has a failure of stage preflight, whatever else was noted."""
    first = failures.groupBy("site").agg(F.min(F.struct("seq", "stage", "error")).alias("f")).select("site", "f.stage", "f.error")
    kinds = ("analytics", "third_party", "mixed", "failed")
    net = network.groupBy("site").agg(*[F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in kinds])
    rows = probes
    for part in (first, icons, checks, net):
        rows = rows.join(part, "site", "left")
    return rows.select(
        "site", "browse_url", F.when(F.col("dead"), "preflight").otherwise(F.col("stage")).alias("stage"), F.when(F.col("dead"), "dead").otherwise(F.col("error")).alias("error"),
        "dom_link", "ico_status", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("sampled", "broken")], *[F.coalesce(f"n_{k}", F.lit(0)).alias(f"n_{k}") for k in kinds],
    )


def event_lines(events: DataFrame) -> DataFrame:
    """Worker events as lines of JSON (column value), for a text sink."""
    return events.select(F.to_json(F.struct("job_id", "seq", "at_ms", "type", "payload")).alias("value"))
