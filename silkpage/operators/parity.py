"""Baseline-versus-current comparison of crawls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOLERANCE = 0.15
FIELDS = ("schemaVersion", "rootUrl", "allowedDomains", "maxPages", "robotsTxtFound", "sitemapXmlFound", "captureMobile", "captureDesktop", "pagesCrawled")


def near(actual: Column, expected: Column, tolerance: float = TOLERANCE) -> Column:
    return F.when(expected == 0, actual == 0).otherwise(F.abs(actual - expected) / expected <= tolerance)


def changed_fields(before: DataFrame, after: DataFrame) -> DataFrame:
    """site, field, was, now of the header fields (site, field, value) that differ."""
    b, a = before.select("site", "field", F.col("value").alias("was")), after.select("site", "field", F.col("value").alias("now"))
    return b.join(a, ["site", "field"], "full_outer").filter(F.col("field").isin(*FIELDS) & ~F.col("was").eqNullSafe(F.col("now")))


def slug_sets(before: DataFrame, after: DataFrame) -> DataFrame:
    """site, slug, change: pages of only one side."""
    b, a = before.select("site", "slug").distinct(), after.select("site", "slug").distinct()
    gone = b.join(a, ["site", "slug"], "left_anti").withColumn("change", F.lit("missing"))
    return gone.union(a.join(b, ["site", "slug"], "left_anti").withColumn("change", F.lit("unexpected")))


def reason_sets(before: DataFrame, after: DataFrame) -> DataFrame:
    """site, was, now: sorted skip reasons where they differ."""
    some = lambda d, n: d.groupBy("site").agg(F.array_join(F.array_sort(F.collect_set("reason")), ",").alias(n))
    both = some(before, "was").join(some(after, "now"), "site", "full_outer").na.fill("", ["was", "now"])
    return both.filter("was <> now")


def count_drift(before: DataFrame, after: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """site, slug, key, was, now, level: fail where a count fell to 0, else warn beyond tolerance.
    Inputs: site, slug, key, n."""
    b, a = before.withColumnRenamed("n", "was"), after.withColumnRenamed("n", "now")
    rows = b.join(a, ["site", "slug", "key"])
    level = F.when((F.col("was") > 0) & (F.col("now") == 0), "fail").when(~near(F.col("now"), F.col("was"), tolerance), "warn")
    return rows.withColumn("level", level).filter("level is not null")


def missing_files(pages: DataFrame, files: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """site, slug, file: expected artefacts (a fixed list) that a page lacks."""
    wanted = pages.select("site", "slug", F.explode(F.array(*[F.lit(n) for n in names])).alias("file"))
    return wanted.join(files, ["site", "slug", "file"], "left_anti")


def asset_check(before: DataFrame, after: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """site, was, now, level, has_role of the asset manifests (site, id, role)."""
    b = before.groupBy("site").agg(F.count(F.lit(1)).alias("was"))
    a = after.groupBy("site").agg(F.count(F.lit(1)).alias("now"), F.bool_or(F.col("role").isNotNull()).alias("has_role"))
    rows = b.join(a, "site", "full_outer").na.fill(0, ["was", "now"]).na.fill(False, ["has_role"])
    level = F.when(F.col("has_role") | (F.col("was") > 0) & (F.col("now") == 0), "fail").when(~near(F.col("now"), F.col("was"), tolerance), "warn").otherwise("ok")
    return rows.withColumn("level", level)
