"""Job steps, slugs, sinks and empty tables of the record operators."""

import pytest
from pyspark.sql import functions as F
from silkpage.operators import crawl as C
from silkpage.operators import records as R
from silkpage.sources import files
from silkpage.streaming import worker_events as W


def fold(*events):
    status, code = "queued", None
    for kind, body in events:
        status, _, code = W.advance(status, {}, code, kind, body)
    return status, code


@pytest.mark.parametrize(
    ("events", "want"),
    [
        ([("error", {"error": {"code": "aborted"}}), ("exit", {"exit": 3})], ("cancelled", "aborted")),
        ([("result", {}), ("exit", {"exit": 1})], ("failed", "worker_failed")),
        ([("result", {})], ("running", None)),
        ([("error", {"error": {"code": "x"}}), ("exit", {"exit": 0})], ("succeeded", None)),
        ([("timeout", {}), ("oversize", {}), ("error", {"error": {"code": "x"}}), ("exit", {"exit": 0})], ("failed", "artefact_cap_exceeded")),
        ([("oversize", {}), ("timeout", {}), ("exit", {"exit": 3})], ("failed", "artefact_cap_exceeded")),
        ([("cancel", {}), ("exit", {"exit": 0})], ("cancelled", None)),
        ([("error", {"error": "text"}), ("exit", {})], ("failed", "worker_failed")),
    ],
)
def test_the_exit_decides(events, want):
    assert fold(*events) == want


def test_slugs_of_long_ids_null_bases_and_made_up_names(spark):
    big = 3_000_000_000
    rows = [("s", big + k, b) for k, b in enumerate(["a", "a", "a-1", "a", "b", "b", None, "a-1-1", "a-1", "c-2"])] + [("t", 1, "a"), (None, 1, "a"), (None, 2, "a")]
    got = {(r.site, r.seq): r.slug for r in C.unique_slugs(spark.createDataFrame(rows, "site string, seq bigint, base string")).collect()}
    used, want = {}, {}
    for site, seq, base in rows:
        slug, k = base, 1
        while base is not None and slug in used.setdefault(site, set()):
            slug, k = f"{base}-{k}", k + 1
        used.setdefault(site, set()).add(slug)
        want[(site, seq)] = slug
    assert got == want


def test_child_tables_and_logs(spark, tmp_path):
    from silkpage.operators import extract as X

    html = "<html><body><h1>T</h1><nav><a href='/a'>A</a></nav><img src='/i.png'></body></html>"
    pages = spark.createDataFrame([(1, "https://a.com/x", html), (2, "https://b.com/", html), (3, "https://b.com/", None)], "page_id bigint, url string, html string")
    files.write_children(X.extract(pages, X.FULL), str(tmp_path / "out"), F.element_at(F.split("url", "/"), 3))
    links = spark.read.parquet(str(tmp_path / "out/links"))
    assert {(r.page_id, r.site, r.href) for r in links.collect()} == {(1, "a.com", "https://a.com/a"), (2, "b.com", "https://b.com/a")}
    assert files.read_log(spark, str(tmp_path / "none.log")).first().text == ""
    files.write_lines(spark.createDataFrame([("one",), ("two",)], "value string").coalesce(1), str(tmp_path / "log"))
    assert files.read_log(spark, str(tmp_path / "log")).first().text == "one\ntwo\n"


def test_empty_tables(spark):
    none = lambda schema: spark.createDataFrame([], schema)
    events = none("job_id string, seq bigint, type string, payload string")
    jobs, ids = none("job_id string, status string"), none("job_id string")
    assert R.job_states(events).count() == 0 and R.delete_jobs(jobs, ids).count() == 0
    assert R.crawl_specs(none("id string, root_url string, max_pages int, crawl_depth int, allowed_domains array<string>")).count() == 0
    assert R.routed(none("method string, path string")).count() == 0
    assert R.job_page(jobs, 3).first().next_cursor is None
