"""Queries over the captured pages and documents, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from silkpage.config import CRAWL, EXCLUDED_PATHS, LINK_SAMPLE, SECOND_LEVEL, TRACKING_PARAMS
from silkpage.functions import text as T
from silkpage.functions import urls as U
from silkpage.operators import crawl as C
from silkpage.operators import extract as X
from silkpage.operators import scan as S


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages")


def parsed(spark: SparkSession, sf_dir: str, *members: str, caps: dict = X.SCAN) -> DataFrame:
    return X.extract(pages(spark, sf_dir), caps, members)


QUERIES: dict = {}
SQL: dict[str, str] = {}

#: The parts of an absolute URL, for DuckDB.
PARTS = r"""
u AS (SELECT *, lower(regexp_extract(url, '^([a-zA-Z][a-zA-Z0-9+.\-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?(#.*)?$', 1)) AS scheme,
  lower(regexp_extract(url, '^([a-zA-Z][a-zA-Z0-9+.\-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?(#.*)?$', 2)) AS auth,
  CASE WHEN regexp_extract(url, '^([a-zA-Z][a-zA-Z0-9+.\-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?(#.*)?$', 3) = '' THEN '/'
    ELSE regexp_extract(url, '^([a-zA-Z][a-zA-Z0-9+.\-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?(#.*)?$', 3) END AS path,
  regexp_replace(regexp_extract(url, '^([a-zA-Z][a-zA-Z0-9+.\-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?(#.*)?$', 4), '^\?', '') AS query FROM pages),
h AS (SELECT *, regexp_replace(regexp_replace(auth, '^[^@]*@', ''), ':\d+$', '') AS host FROM u)"""
_IN = lambda xs: "(" + ", ".join(f"'{x}'" for x in xs) + ")"
NORMAL = rf"""
q AS (SELECT *, array_to_string(list_filter(string_split(query, '&'), lambda p: p <> '' AND regexp_extract(p, '^([^=]*)', 1) NOT IN {_IN(TRACKING_PARAMS)}), '&') AS kept,
  regexp_replace(regexp_replace(path, '(?i)/index\.html?$', '/'), '/{{2,}}', '/', 'g') AS p2 FROM h),
n AS (SELECT *, scheme || '://' || auth || CASE WHEN kept = '' AND p2 <> '/' THEN regexp_replace(p2, '/$', '') ELSE p2 END
  || CASE WHEN kept = '' THEN '' ELSE '?' || kept END AS normalized FROM q)"""
POLITE = f"""CASE WHEN len(string_split(host, '.')) <= 2 THEN host
  WHEN array_to_string(string_split(host, '.')[-2:], '.') IN {_IN(SECOND_LEVEL)} THEN array_to_string(string_split(host, '.')[-3:], '.')
  ELSE array_to_string(string_split(host, '.')[-2:], '.') END"""


def _slug_sql(size: int, blank: str) -> str:
    base = "CASE WHEN regexp_replace(path, '^/|/$', '', 'g') = '' THEN 'home' ELSE regexp_replace(path, '^/|/$', '', 'g') END"
    cut = f"substr(regexp_replace(regexp_replace(lower({base}), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, {size})"
    return f"CASE WHEN {cut} = '' THEN '{blank}' ELSE {cut} END"


def add(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put


@add("url_normalize", f"WITH {PARTS}, {NORMAL} SELECT page_id, normalized FROM n")
def url_normalize(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", U.normalize_url(F.col("url")).alias("normalized"))


@add("url_normalize_any", f"WITH {PARTS}, {NORMAL} SELECT page_id, normalized FROM n")
def url_normalize_any(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", U.normalize_udf(F.col("url"), F.col("url")).alias("normalized"))


@add("url_slug_base", f"WITH {PARTS} SELECT page_id, {_slug_sql(60, 'page')} AS slug FROM h")
def url_slug_base(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", U.slug_base(F.col("url")).alias("slug"))


@add("scan_slug_base", f"WITH {PARTS} SELECT page_id, {_slug_sql(50, 'home')} AS slug FROM h")
def scan_slug_base(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", U.scan_slug_base(F.col("url")).alias("slug"))


@add("norm_path", rf"WITH {PARTS} SELECT page_id, regexp_replace(host, '^www\.', '') || regexp_replace(path, '/$', '') AS norm FROM h")
def norm_path(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", U.norm_path(F.col("url")).alias("norm"))


@add("site_ids", rf"WITH {PARTS} SELECT page_id, regexp_replace(regexp_replace(regexp_replace(host, '^www\.', ''), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS site_id, lower(split_part(split_part(split_part(url, '?', 1), '#', 1), '.', -1)) AS ext FROM h")
def site_ids(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", U.slug_from_url(F.col("url")).alias("site_id"), U.only_ext(F.col("url")).alias("ext"))


@add("politeness_rollup", f"WITH {PARTS} SELECT {POLITE} AS politeness_key, count(*) AS n_pages, count(DISTINCT host) AS n_hosts FROM h GROUP BY 1")
def politeness_rollup(spark, sf_dir):
    rows = pages(spark, sf_dir).select(U.politeness_key(F.col("url")).alias("politeness_key"), U.host_of(F.col("url")).alias("host"))
    return rows.groupBy("politeness_key").agg(F.count(F.lit(1)).alias("n_pages"), F.countDistinct("host").alias("n_hosts"))


#: Anchors of the navigation, for DuckDB: the pages have none elsewhere.
_UNESC = lambda x: f"replace(replace(replace(replace({x}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&amp;', '&')"
ANCHORS = rf"""
a0 AS (SELECT page_id, url, html, regexp_extract_all(html, '<a href="([^"]*)">', 1) AS hrefs, regexp_extract_all(html, '<a href="[^"]*">([^<]*)</a>', 1) AS texts FROM pages),
a AS (SELECT page_id, url, unnest(range(len(hrefs))) AS ord, unnest(hrefs) AS raw, unnest(texts) AS txt FROM a0),
l AS (SELECT page_id, url, ord::INTEGER AS ord, {_UNESC('raw')} AS raw_href, trim({_UNESC('txt')}) AS text,
  CASE WHEN raw LIKE 'mailto:%' THEN 'email' WHEN raw LIKE 'tel:%' THEN 'phone' WHEN raw LIKE '/%' THEN 'internal' ELSE 'external' END AS type, 'navigation' AS appears_in FROM a)"""
CLEAN = r"^/[A-Za-z0-9/_-]*$"


@add(
    "page_links",
    rf"""WITH {ANCHORS} SELECT page_id, ord, substr(text, 1, 160) AS text, raw_href,
  CASE WHEN regexp_matches(raw_href, '{CLEAN}') THEN regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) || raw_href END AS clean_href, type, appears_in, 0 AS tier FROM l""",
)
def page_links(spark, sf_dir):
    ls = X.links(parsed(spark, sf_dir, "links"))
    return ls.select("page_id", "ord", "text", "raw_href", F.when(F.col("raw_href").rlike(CLEAN), F.col("href")).alias("clean_href"), "type", "appears_in", "tier")


@add("page_headings", rf"""WITH g AS (SELECT page_id, regexp_extract_all(html, '<h([1-6])>[^<]*</h[1-6]>', 1) AS ls, regexp_extract_all(html, '<h[1-6]>([^<]*)</h[1-6]>', 1) AS ts FROM pages),
  f AS (SELECT page_id, unnest(ls)::INTEGER AS level, unnest(ts) AS t FROM g) SELECT page_id, level, substr(trim({_UNESC('t')}), 1, 300) AS text FROM f WHERE trim(t) <> ''""")
def page_headings(spark, sf_dir):
    return X.child(parsed(spark, sf_dir, "headings"), "headings").select("page_id", "level", "text")


@add("page_metadata", rf"""SELECT page_id, trim(regexp_replace({_UNESC("regexp_extract(html, '<title>([^<]*)</title>', 1)")}, '\s+', ' ', 'g')) AS title, regexp_extract(html, '<html lang="([^"]*)"', 1) AS lang,
  CAST(NULL AS VARCHAR) AS description, url AS canonical_or_url, 0 AS n_icons FROM pages""")
def page_metadata(spark, sf_dir):
    m = F.col("metadata")
    return parsed(spark, sf_dir, "metadata").select(
        "page_id", m["title"].alias("title"), m["lang"].alias("lang"), m["description"].alias("description"),
        F.coalesce(F.nullif(m["canonical"], F.lit("")), F.col("url")).alias("canonical_or_url"), F.size(m["icons"]).alias("n_icons"),
    )


@add("page_counts", r"""SELECT page_id, len(regexp_extract_all(html, '<h[1-6]>[^<]')) AS headings, len(regexp_extract_all(html, '<a href')) AS links, 0::BIGINT AS images, 0::BIGINT AS forms,
  len(regexp_extract_all(html, '<(nav|article|footer)>')) AS blocks, 0::BIGINT AS structured_data FROM pages""")
def page_counts(spark, sf_dir):
    return parsed(spark, sf_dir, "headings", "links", "images", "forms", "blocks", "json_ld", caps=X.FULL).select("page_id", *X.counts())


@add("link_tiers", f"WITH {ANCHORS} SELECT type, 0 AS tier, count(*) AS n, count(DISTINCT page_id) AS n_pages FROM l GROUP BY type")
def link_tiers(spark, sf_dir):
    return X.links(parsed(spark, sf_dir, "links")).groupBy("type", "tier").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("page_id").alias("n_pages"))


@add("link_sample", rf"""WITH {ANCHORS}, i AS (SELECT page_id, raw_href, min(ord) AS ord FROM l WHERE type = 'internal' AND NOT regexp_matches(raw_href, '(?i)\.(jpg|jpeg|png|gif|css|js|ico|svg|woff2?)(\?|$)') GROUP BY ALL),
  r AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY ord) AS n FROM i) SELECT page_id, n::INTEGER AS n, raw_href FROM r WHERE n <= {LINK_SAMPLE}""")
def link_sample(spark, sf_dir):
    ls = X.links(parsed(spark, sf_dir, "links")).select("page_id", "ord", "type", F.col("raw_href").alias("href"))
    return S.link_sample(ls).withColumnRenamed("href", "raw_href")


ALLOWED = ("www.cheap-pills.example.com", "spam-farm.example.org", "m.ththth.example.net", "therha.example.com")
DISALLOW = ("/en/7", "/fr")


@add(
    "crawl_gate",
    f"""WITH {PARTS} SELECT page_id, CASE WHEN host NOT IN {_IN(ALLOWED)} THEN 'offsite'
  WHEN {" OR ".join(f"starts_with(lower(path), '{p}')" for p in EXCLUDED_PATHS)} THEN 'excluded_path'
  WHEN {" OR ".join(f"starts_with(path, '{p}')" for p in DISALLOW)} THEN 'robots_disallow'
  WHEN page_id % 5 > {CRAWL["depth"]} THEN 'depth_exceeded' END AS reason FROM h""",
)
def crawl_gate(spark, sf_dir):
    rules = F.array(*[F.lit(d) for d in DISALLOW])
    reason = C.gate(F.col("url"), F.col("page_id") % 5, ALLOWED, rules, F.lit(None).cast("string"))
    return pages(spark, sf_dir).select("page_id", reason.alias("reason"))


@add(
    "site_link_inventory",
    f"""WITH {PARTS}, {ANCHORS}, s AS (SELECT page_id, {POLITE} AS site FROM h),
  c AS (SELECT site, count(*) AS n_pages FROM s GROUP BY site),
  k AS (SELECT site, count(*) AS n_links, count(DISTINCT raw_href) AS n_targets, count(*) FILTER (type = 'internal') AS n_internal FROM l JOIN s USING (page_id) GROUP BY site)
SELECT c.site, n_pages, coalesce(n_links, 0) AS n_links, coalesce(n_targets, 0) AS n_targets, coalesce(n_internal, 0) AS n_internal, coalesce(n_links, 0) AS tier0, 0::BIGINT AS tier1 FROM c LEFT JOIN k USING (site)""",
)
def site_link_inventory(spark, sf_dir):
    x = parsed(spark, sf_dir, "links").select("page_id", "url", "links").withColumn("site", U.politeness_key(F.col("url")))
    rows = x.select("site", "page_id", F.explode_outer("links").alias("l"))
    tier = U.link_tier(F.col("l.appears_in"))
    some = F.col("l").isNotNull()
    return rows.groupBy("site").agg(
        F.countDistinct("page_id").alias("n_pages"),
        F.count("l").alias("n_links"),
        F.countDistinct("l.raw_href").alias("n_targets"),
        F.count_if(F.col("l.type") == "internal").alias("n_internal"),
        F.count_if(some & (tier == 0)).alias("tier0"),
        F.count_if(some & (tier == 1)).alias("tier1"),
    )


@add(
    "site_totals",
    f"""WITH {PARTS}, g AS (SELECT {POLITE} AS site, page_id, url, {" OR ".join(f"starts_with(path, '{p}')" for p in DISALLOW)} AS skip FROM h)
SELECT site, count(*) AS discovered, count(*) FILTER (NOT skip) AS crawled, count(*) FILTER (skip) AS skipped, bool_or(skip) AS any_skip FROM g GROUP BY site""",
)
def site_totals(spark, sf_dir):
    rules = F.array(*[F.lit(d) for d in DISALLOW])
    skip = U.robots_blocked(F.col("url"), rules)
    rows = pages(spark, sf_dir).select(U.politeness_key(F.col("url")).alias("site"), skip.alias("skip"))
    return rows.groupBy("site").agg(
        F.count(F.lit(1)).alias("discovered"), F.count_if(~F.col("skip")).alias("crawled"), F.count_if("skip").alias("skipped"), F.bool_or("skip").alias("any_skip")
    )


@add("text_clamp", r"SELECT doc_id, substr(trim(regexp_replace(coalesce(text, ''), '[\t-\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]+', ' ', 'g')), 1, 240) AS clamped FROM documents")
def text_clamp(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.clamp(F.col("text"), 240).alias("clamped"))


@add("text_hash", "SELECT doc_id, 'sha256:' || sha256(coalesce(text, '')) AS hash FROM documents")
def text_hash(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.text_hash(F.col("text")).alias("hash"))


@add("readable_collapse", r"SELECT doc_id, sha256(regexp_replace(replace(text, '. ', chr(10) || chr(10) || chr(10) || chr(10)), '\n{3,}', chr(10) || chr(10), 'g')) AS hash FROM documents")
def readable_collapse(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(T.collapse_newlines(F.replace("text", F.lit(". "), F.lit("\n\n\n\n"))), 256).alias("hash"))


@add("text_duplicates", "SELECT sha256(coalesce(text, '')) AS hash, count(*) AS n, min(doc_id) AS first_doc FROM documents GROUP BY 1 HAVING count(*) > 1")
def text_duplicates(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.sha2(F.coalesce("text", F.lit("")), 256).alias("hash"), "doc_id")
    return d.groupBy("hash").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_doc")).filter("n > 1")


@add("visible_text", None)
def visible_text(spark, sf_dir):
    return X.child(parsed(spark, sf_dir, "visible_text"), "visible_text").select("page_id", "page_order", "text", "selector", "region")


@add("dom_blocks", r"""WITH b AS (SELECT page_id, unnest(regexp_extract_all(html, '<(nav|article|footer)>', 1)) AS tag, unnest(range(len(regexp_extract_all(html, '<(nav|article|footer)>')))) AS k,
  len(regexp_extract_all(html, '<a href')) AS n FROM pages)
SELECT page_id, 'block.' || lpad((k + 1)::VARCHAR, 3, '0') AS local_id, tag, CASE WHEN tag = 'nav' THEN n ELSE 0 END::BIGINT AS n_links, CASE tag WHEN 'nav' THEN 'navigation' WHEN 'footer' THEN 'footer' ELSE 'body' END AS region FROM b""")
def dom_blocks(spark, sf_dir):
    b = X.child(parsed(spark, sf_dir, "blocks", caps=X.FULL), "blocks")
    return b.select("page_id", "local_id", "tag", F.size("links").cast("long").alias("n_links"), "region")


@add("page_readable", None)
def page_readable(spark, sf_dir):
    x = parsed(spark, sf_dir, "metadata", "readable", "content_html", caps=X.FULL)
    md = T.readable_md(F.col("metadata.title"), F.col("url"), F.col("readable"))
    return x.select("page_id", T.text_hash(F.col("readable")).alias("text_hash"), F.char_length("readable").alias("n_chars"), F.char_length("content_html").alias("n_html"), md.alias("markdown"))


@add("ax_tree", None)
def ax_tree(spark, sf_dir):
    return parsed(spark, sf_dir, "ax", caps=X.FULL).select("page_id", "ax", F.get_json_object("ax", "$.role").alias("role"))


@add("page_slugs", f"""WITH {PARTS}, s AS (SELECT page_id, {POLITE} AS site, {_slug_sql(60, 'page')} AS base FROM h),
  r AS (SELECT *, row_number() OVER (PARTITION BY site, base ORDER BY page_id) AS n FROM s)
SELECT page_id, site, CASE WHEN n = 1 THEN base ELSE base || '-' || (n - 1) END AS slug FROM r""")
def page_slugs(spark, sf_dir):
    p = pages(spark, sf_dir).select("page_id", U.politeness_key(F.col("url")).alias("site"), U.slug_base(F.col("url")).alias("base"))
    return C.unique_slugs(p.withColumn("seq", F.col("page_id").cast("bigint"))).select("page_id", "site", "slug")


@add("asset_inventory", None)
def asset_inventory(spark, sf_dir):
    x = parsed(spark, sf_dir, "images", caps=X.FULL)
    images = X.child(x, "images").drop("url")
    p = pages(spark, sf_dir).select("page_id", U.politeness_key(F.col("url")).alias("site"), F.col("page_id").cast("bigint").alias("seq"), U.slug_base(F.col("url")).alias("slug"), F.col("url").alias("final_url"))
    return X.assets(images, p)


@add("crawl_simulate", None)
def crawl_simulate(spark, sf_dir):
    """Each site's pages as its link graph: a site's n-th page leads to its next ones."""
    site = U.politeness_key(F.col("url"))
    p = pages(spark, sf_dir).select(site.alias("site"), "page_id", U.normalize_url(F.col("url")).alias("url"), U.host_of(F.col("url")).alias("host"))
    w = Window.partitionBy("site").orderBy("page_id")
    nxt = F.array(*[F.struct(F.lead("url", k).over(w).alias("href"), F.lit("navigation" if k == 1 else "body").alias("appears_in")) for k in (1, 2, 3)])
    graph = p.withColumn("links", F.filter(nxt, lambda x: x.getField("href").isNotNull())).select(
        "site", "url", F.col("url").alias("final_url"), F.lit(0).alias("attempt"), F.lit(200).alias("status"), F.lit("text/html").alias("content_type"), F.lit(None).cast("int").alias("retry_after"), "links"
    )
    specs = p.groupBy("site").agg(F.min_by("url", "page_id").alias("root"), F.collect_set("host").alias("domains")).withColumns(
        {"disallow": F.array(*[F.lit(d) for d in DISALLOW]), "sitemap": F.array().cast("array<string>")}
    )
    return C.simulate(graph, specs)
