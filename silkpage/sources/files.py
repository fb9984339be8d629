"""File sources and sinks of captures: JSON records, baselines, manifests, artefacts."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from silkpage import config as K

JOB = (
    "job_id string, kind string, spec string, spec_hash string, status string, created_at timestamp, started_at timestamp, finished_at timestamp, "
    "attempt int, pid bigint, progress map<string,string>, result string, error struct<code:string,message:string>, artefact_path string"
)
SITE = "id string, name string, url string, status string, outcome string, pages int, error string, started_at timestamp, finished_at timestamp"


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of a fixed schema below a path or pattern; a missing folder gives none, a broken record is left out."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def read_jobs(spark: SparkSession, root: str) -> DataFrame:
    """Job records; ids of another shape are left out."""
    return read_json(spark, root, JOB).filter(F.col("job_id").rlike("(?i)^[a-z0-9-]+$"))


def read_sites(spark: SparkSession, path: str) -> DataFrame:
    return read_json(spark, path, SITE)


def manifest(spark: SparkSession, root: str) -> DataFrame:
    """path (relative), bytes of every file below root, by name; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", F.col("length").alias("bytes"))
    top = F.regexp_replace(F.lit(root.rstrip("/")), r"^[a-z]+:/*", "/")
    return files.select(F.regexp_replace(F.expr("substring_index(path, ':', -1)"), F.concat(F.lit("^/*"), F.regexp_replace(top, "^/*", ""), F.lit("/")), "").alias("path"), "bytes").orderBy("path")


def directory_bytes(files: DataFrame) -> DataFrame:
    return files.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"))


def is_contained(path: Column) -> Column:
    """Whether an artefact path, decoded, stays inside its root."""
    parts = F.split(F.coalesce(F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), path), r"[/\\]+")
    depth = F.aggregate(
        parts,
        F.struct(F.lit(0).alias("d"), F.lit(0).alias("low")),
        lambda a, p: F.struct(
            (a.getField("d") + F.when(p == "..", -1).when(p.isin("", "."), 0).otherwise(1)).alias("d"),
            F.least(a.getField("low"), a.getField("d") + F.when(p == "..", -1).otherwise(0)).alias("low"),
        ),
    )
    return depth.getField("low") >= 0


def write_children(extracted: DataFrame, root: str, site: Column) -> None:
    """Every child table of parsed pages as Parquet, partitioned by site. Pages are parsed
    once and written; the child tables are cut from that table, so nothing is shuffled."""
    columns = ("headings", "links", "images", "forms", "buttons", "visible_text", "blocks")
    kept = extracted.withColumn("site", site)
    kept.select("page_id", "site", "url", "metadata", "json_ld", "readable", "content_html", "ax", *columns).write.mode("overwrite").partitionBy("site").parquet(f"{root}/pages")
    pages = extracted.sparkSession.read.parquet(f"{root}/pages")
    for name in columns:
        rows = pages.select("site", "page_id", "url", F.posexplode(name).alias("ord", "r")).select("site", "page_id", "url", "ord", "r.*")
        rows.write.mode("overwrite").partitionBy("site").parquet(f"{root}/{name}")


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """The lines of a job's log in one row (column text); '' where there is none yet."""
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(there):
        return spark.createDataFrame([("",)], "text string")
    return spark.read.text(path, wholetext=True).withColumnRenamed("value", "text")


def write_lines(lines: DataFrame, path: str) -> None:
    """Log lines or worker events (column value) as text files, replaced as a whole."""
    lines.select("value").write.mode("overwrite").text(path)


def sitemap_xml(pages: DataFrame) -> DataFrame:
    """site, xml: the crawled URLs of each site in order, escaped. A crawl has at most the
    page ceiling of URLs."""
    loc = F.replace(F.replace(F.replace("final_url", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    line = F.concat(F.lit("  <url><loc>"), loc, F.lit("</loc></url>"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("seq", line.alias("line")))), lambda x: x.getField("line"))
    head = '<?xml version="1.0" encoding="UTF-8"?>\n<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">\n'
    return pages.groupBy("site").agg(F.concat(F.lit(head), F.array_join(lines, "\n"), F.lit("\n</urlset>\n")).alias("xml"))


def crawl_index(pages: DataFrame, skips: DataFrame, errors: DataFrame) -> DataFrame:
    """One row a site: totals and flags of a crawl."""
    count = lambda d, n: d.groupBy("site").agg(F.count(F.lit(1)).alias(n))
    out = count(pages, "pages_crawled").join(count(skips, "pages_skipped"), "site", "full_outer").join(count(errors, "errors"), "site", "full_outer")
    return out.na.fill(0).withColumn("schema_version", F.lit("0.1"))


def upsert_sites(old: DataFrame, new: DataFrame) -> DataFrame:
    """Batch record after a run: new rows replace old ones of their id."""
    return old.join(new.select("id"), "id", "left_anti").unionByName(new, allowMissingColumns=True)


@dataclass(frozen=True)
class Settings:
    """Numbers of a deployment, each overridden by an environment variable SILKPAGE_<NAME>."""

    max_pages: int = K.CRAWL["max_pages"]
    crawl_depth: int = K.CRAWL["depth"]
    dedup_window_ms: int = K.DEDUP_WINDOW_MS
    ttl_ms: int = K.TTL_MS
    high_water_pct: float = K.HIGH_WATER_PCT
    polite_interval_ms: int = K.POLITE_INTERVAL_MS
    link_sample: int = K.LINK_SAMPLE
    max_candidates: int = K.MAX_CANDIDATES
    artefact_cap: int = K.ARTEFACT_CAP

    @classmethod
    def load(cls, env: dict[str, str] | None = None) -> Settings:
        env = dict(os.environ) if env is None else env
        given = {f.name: type(f.default)(env[k]) for f in fields(cls) if (k := f"SILKPAGE_{f.name.upper()}") in env}
        return cls(**given)
