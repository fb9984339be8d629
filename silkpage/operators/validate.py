"""Request validation over JSON bodies: the first error, in the fixed order of the fields.

Each body gets (code, field), both null where it is valid. Types are read from a VARIANT,
so one parse serves all rules; bodies over MAX_BODY bytes and bodies that are no JSON have
their own codes. An empty body counts as {}.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from silkpage.config import MAX_CANDIDATES, MAX_PAGES_CEILING

MAX_BODY = 1_000_000
CRAWL_FIELDS = (
    "rootUrl", "maxPages", "crawlDepth", "respectRobotsTxt", "captureDesktop", "captureMobile", "excludedPathPatterns",
    "timeoutMs", "navWaitUntil", "businessCategoryHint", "targetMarket", "allowedDomains",
)
SCAN_FIELDS = ("candidates", "concurrency", "maxPagesPerSite", "siteBudgetMs", "respectRobotsTxt", "force")
NAV_WAIT = ("load", "domcontentloaded", "networkidle", "commit")


class Body:
    """Column expressions over one parsed body."""

    def __init__(self, v: Column, text: Column):
        self.v, self.text = v, text

    def kind(self, field: str) -> Column:
        """STRING, BIGINT, ... or null where the field is absent or null."""
        k = F.schema_of_variant(F.variant_get(self.v, f"$.{field}", "variant"))
        return F.nullif(k, F.lit("VOID"))

    def string(self, field: str) -> Column:
        return F.try_variant_get(self.v, f"$.{field}", "string")

    def number(self, field: str) -> Column:
        return F.try_variant_get(self.v, f"$.{field}", "double")

    @staticmethod
    def error(when: Column, code: str, field: str | Column) -> Column:
        name = F.lit(field) if isinstance(field, str) else field
        return F.when(when, F.struct(F.lit(code).alias("code"), name.alias("field")))

    def text_field(self, field: str, required: bool = False) -> list[Column]:
        k = self.kind(field)
        out = [self.error(k.isNull(), "field_required", field)] if required else []
        blank = F.coalesce(F.trim(self.string(field)) == "", F.lit(True))
        return [*out, self.error(k.isNotNull() & ((k != "STRING") | blank), "field_invalid", field)]

    def int_field(self, field: str, low: int, high: int) -> list[Column]:
        k, n = self.kind(field), self.number(field)
        number = k.isin("BIGINT", "DOUBLE") | k.startswith("DECIMAL")
        return [
            self.error(k.isNotNull() & (~number | (n != F.floor(n))), "field_invalid", field),
            self.error(number & (n < low), "field_out_of_range", field),
            self.error(number & (n > high), "field_exceeds_ceiling", field),
        ]

    def bool_field(self, field: str) -> list[Column]:
        k = self.kind(field)
        return [self.error(k.isNotNull() & (k != "BOOLEAN"), "field_invalid", field)]

    def strings_field(self, field: str, most: int) -> list[Column]:
        k = self.kind(field)
        items = F.try_variant_get(self.v, f"$.{field}", "array<variant>")
        other = F.exists(items, lambda x: F.schema_of_variant(x) != "STRING")
        return [
            self.error(k.isNotNull() & (items.isNull() | other), "field_invalid", field),
            self.error(F.size(items) > most, "field_out_of_range", field),
        ]

    def robots(self, allow: bool) -> list[Column]:
        off = (self.kind("respectRobotsTxt") == "BOOLEAN") & ~F.try_variant_get(self.v, "$.respectRobotsTxt", "boolean")
        return [] if allow else [self.error(F.coalesce(off, F.lit(False)), "robots_override_forbidden", "respectRobotsTxt")]

    def unknown(self, fields: tuple[str, ...]) -> Column:
        odd = F.filter(F.json_object_keys(self.text), lambda k: ~k.isin(*fields))
        return self.error(F.size(odd) > 0, "unknown_field", F.get(odd, 0))


def _checked(df: DataFrame, body: str, rules) -> DataFrame:
    text = F.when(F.coalesce(F.trim(body), F.lit("")) == "", "{}").otherwise(F.col(body))
    df = df.withColumns({"__text": text}).withColumn("__v", F.try_parse_json("__text"))
    b = Body(F.col("__v"), F.col("__text"))
    whole = [
        b.error(F.octet_length(F.col(body)) > MAX_BODY, "body_too_large", F.lit(None).cast("string")),
        b.error(F.col("__v").isNull(), "body_not_json", F.lit(None).cast("string")),
        b.error(~F.schema_of_variant("__v").startswith("OBJECT"), "body_invalid", F.lit(None).cast("string")),
    ]
    first = F.coalesce(*whole, *rules(b))
    return df.withColumn("__e", first).withColumns({"code": F.col("__e.code"), "field": F.col("__e.field")}).drop("__text", "__v", "__e")


def validate_crawl(df: DataFrame, body: str = "body", max_pages: int = MAX_PAGES_CEILING, allow_robots_override: bool = False) -> DataFrame:
    def rules(b: Body) -> list[Column]:
        return [
            b.unknown(CRAWL_FIELDS),
            *b.text_field("rootUrl", required=True),
            *b.int_field("maxPages", 1, max_pages),
            *b.int_field("crawlDepth", 0, 6),
            *b.int_field("timeoutMs", 1000, 120_000),
            *b.bool_field("respectRobotsTxt"),
            *b.bool_field("captureDesktop"),
            *b.bool_field("captureMobile"),
            *b.robots(allow_robots_override),
            *b.strings_field("excludedPathPatterns", 100),
            *b.strings_field("allowedDomains", 20),
            b.error(b.kind("navWaitUntil").isNotNull() & ~F.coalesce(b.string("navWaitUntil").isin(*NAV_WAIT), F.lit(False)), "field_invalid", "navWaitUntil"),
            *b.text_field("businessCategoryHint"),
            *b.text_field("targetMarket"),
        ]

    return _checked(df, body, rules)


def validate_scan(df: DataFrame, body: str = "body", max_candidates: int = MAX_CANDIDATES, allow_robots_override: bool = False) -> DataFrame:
    def rules(b: Body) -> list[Column]:
        items = F.try_variant_get(b.v, "$.candidates", "array<variant>")
        is_object = lambda c: F.schema_of_variant(c).startswith("OBJECT")
        get = lambda c, f, t: F.try_variant_get(c, f"$.{f}", t)
        url = lambda c: F.when(F.schema_of_variant(c) == "STRING", F.try_variant_get(c, "$", "string")).when(
            is_object(c) & (F.schema_of_variant(F.variant_get(c, "$.url", "variant")) == "STRING"), get(c, "url", "string")
        )
        kind = lambda c, f: F.when(is_object(c), F.schema_of_variant(F.variant_get(c, f"$.{f}", "variant")))
        odd = lambda c: F.filter(F.json_object_keys(F.to_json(c)), lambda k: ~k.isin("url", "name", "slug", "id"))

        def wrong(c: Column, i: Column) -> Column:
            at = lambda f: F.concat(F.lit("candidates["), i.cast("string"), F.lit(f"].{f}"))
            none = F.coalesce(F.trim(url(c)) == "", F.lit(True))
            return F.coalesce(
                b.error(none, "field_invalid", at("url")),
                b.error(kind(c, "name").isNotNull() & (kind(c, "name") != "STRING"), "field_invalid", at("name")),
                b.error(
                    kind(c, "slug").isNotNull() & ~F.coalesce((kind(c, "slug") == "STRING") & get(c, "slug", "string").rlike("(?i)^[a-z0-9-]+$"), F.lit(False)), "field_invalid", at("slug")
                ),
                F.when(is_object(c) & (F.size(odd(c)) > 0), F.struct(F.lit("unknown_field").alias("code"), F.concat(at(""), F.get(odd(c), 0)).alias("field"))),
            )

        errors = F.filter(F.transform(items, wrong), lambda e: e.isNotNull())
        return [
            b.unknown(SCAN_FIELDS),
            b.error(items.isNull() | (F.size(items) == 0), "field_required", "candidates"),
            b.error(F.size(items) > max_candidates, "field_exceeds_ceiling", "candidates"),
            F.get(errors, 0),
            *b.int_field("concurrency", 1, 8),
            *b.int_field("maxPagesPerSite", 1, 10),
            *b.int_field("siteBudgetMs", 10_000, 300_000),
            *b.bool_field("force"),
            *b.bool_field("respectRobotsTxt"),
            *b.robots(allow_robots_override),
        ]

    return _checked(df, body, rules)


def submit_gate(urls: DataFrame) -> DataFrame:
    """request_id, accepted: a scan is refused only if none of its URLs may be fetched.
    urls: request_id, kind, blocked (code or null)."""
    free = F.col("blocked").isNull()
    return urls.groupBy("request_id", "kind").agg(F.bool_or(free).alias("any_free"), F.bool_and(free).alias("all_free")).select(
        "request_id", "kind", F.when(F.col("kind") == "scan", F.col("any_free")).otherwise(F.col("all_free")).alias("accepted")
    )


__all__ = ["submit_gate", "validate_crawl", "validate_scan"]
