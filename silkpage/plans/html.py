"""Queries of the extractors that the captured pages at hand have no elements for."""

from __future__ import annotations

from pyspark.sql import functions as F

from silkpage.functions import urls as U
from silkpage.operators import extract as X
from silkpage.plans import fixtures

QUERIES: dict = {}
SQL: dict[str, str] = {}
_ORIGIN = "regexp_extract(url, '^([a-z]+://[^/]*)', 1)"
_ABS = f"CASE WHEN v LIKE '/%' THEN {_ORIGIN} || v ELSE v END"


def add(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = lambda spark, sf_dir: f(X.extract(fixtures.HTML_PAGES.df(spark)))
        if sql:
            SQL[name] = f"WITH {fixtures.HTML_PAGES.sql}{sql}"
        return f

    return put


_IMAGES = f""", i AS (SELECT page_id, url, unnest(regexp_extract_all(html, '<img src="([^"]*)"', 1)) AS v, unnest(regexp_extract_all(html, '<img src="[^"]*" alt="([^"]*)"', 1)) AS alt,
  unnest(range(len(regexp_extract_all(html, '<img src="([^"]*)"')))) AS k FROM html_pages),
d AS (SELECT page_id, {_ABS} AS src, arg_min(alt, k) AS alt, min(k) AS k FROM i GROUP BY ALL)"""


@add("dom_images", _IMAGES + " SELECT page_id, src, alt, 'img' AS source, 'body' AS region FROM d")
def dom_images(x):
    return X.child(x, "images").select("page_id", "src", "alt", "source", "region")


@add(
    "dom_forms",
    """, f AS (SELECT page_id, unnest(regexp_extract_all(html, '<form[^>]*>.*?</form>')) AS f FROM html_pages)
SELECT page_id, CASE WHEN regexp_extract(f, 'method="([a-z]*)"', 1) = '' THEN 'GET' ELSE upper(regexp_extract(f, 'method="([a-z]*)"', 1)) END AS method, regexp_extract(f, 'action="([^"]*)"', 1) AS action,
  len(regexp_extract_all(f, '<(input|textarea)')) - len(regexp_extract_all(f, 'type="hidden"')) AS n_fields FROM f""",
)
def dom_forms(x):
    return X.child(x, "forms").select("page_id", "method", "action", F.size("fields").cast("long").alias("n_fields"))


@add("dom_buttons", ", b AS (SELECT page_id, unnest(regexp_extract_all(html, '<button>([^<]*)</button>', 1)) AS text FROM html_pages) SELECT page_id, text FROM b WHERE text <> ''")
def dom_buttons(x):
    return X.child(x, "buttons").select("page_id", "text")


@add(
    "json_ld",
    """, j AS (SELECT page_id, unnest(regexp_extract_all(html, '<script type="application/ld[+]json">(.*?)</script>', 1)) AS t FROM html_pages)
SELECT page_id, TRY_CAST(t AS JSON) ->> '$."@type"' AS type, TRY_CAST(t AS JSON) ->> '$.name' AS name FROM j WHERE TRY_CAST(t AS JSON) IS NOT NULL""",
)
def json_ld(x):
    docs = x.select("page_id", F.explode("json_ld").alias("t")).withColumn("v", F.try_parse_json("t"))
    return docs.select("page_id", F.try_variant_get("v", "$['@type']", "string").alias("type"), F.try_variant_get("v", "$.name", "string").alias("name"))


_META = f""", m AS (SELECT page_id, url, regexp_extract(html, '<meta property="og:image" content="([^"]*)"', 1) AS v FROM html_pages
 UNION ALL SELECT page_id, url, regexp_extract(html, '"ImageObject","url":"([^"]*)"', 1) FROM html_pages), mi AS (SELECT page_id, {_ABS} AS src FROM m WHERE v <> '')"""


@add("meta_images", _META + " SELECT page_id, src FROM mi")
def meta_images(x):
    return X.child(x, "meta_images").select("page_id", "src")


@add(
    "all_images",
    _IMAGES + _META + " SELECT page_id, src, 'img' AS source FROM d UNION ALL SELECT page_id, src, 'metadata' FROM mi WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.page_id = mi.page_id AND d.src = mi.src)",
)
def all_images(x):
    dom = X.child(x, "images").select("page_id", "src", "source")
    meta = X.child(x, "meta_images").select("page_id", "src", F.lit("metadata").alias("source"))
    return dom.unionByName(meta.join(dom.select("page_id", "src"), ["page_id", "src"], "left_anti"))


@add(
    "image_flags",
    _IMAGES + _META + """ SELECT page_id, (SELECT count(*) FROM d WHERE d.page_id = p.page_id) = 0 AND (SELECT count(*) FROM mi WHERE mi.page_id = p.page_id) > 0 AS from_metadata_only,
  html LIKE '%litespeed/javascript%' AS delayed_js FROM html_pages p""",
)
def image_flags(x):
    return x.select("page_id", ((F.size("images") == 0) & (F.size("meta_images") > 0)).alias("from_metadata_only"), F.col("delayed_js"))


@add(
    "asset_rollup",
    _IMAGES + f""", s AS (SELECT d.*, {_ORIGIN} AS site FROM d JOIN html_pages USING (page_id)), g AS (SELECT site, src, arg_min(alt, page_id * 1000 + k) AS alt, min(page_id * 1000 + k) AS pos, count(*) AS n_pages FROM s GROUP BY site, src)
SELECT site, 'asset.image.' || lpad((row_number() OVER (PARTITION BY site ORDER BY pos))::VARCHAR, 3, '0') AS id, src AS source_url, lower(split_part(src, '.', -1)) AS ext, alt, n_pages FROM g""",
)
def asset_rollup(x):
    pages = x.select("page_id", U.origin_of(F.col("url")).alias("site"), F.col("page_id").cast("bigint").alias("seq"), U.slug_base(F.col("url")).alias("slug"), F.col("url").alias("final_url"))
    a = X.assets(X.child(x, "images").drop("url"), pages)
    return a.select("site", "id", "source_url", "ext", "alt", F.size("appears_on").cast("long").alias("n_pages"))
