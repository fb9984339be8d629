import json
import random

from pyspark.sql import functions as F
from silkpage.operators import crawl as C
from silkpage.operators import jobs as J
from silkpage.sources import files
from silkpage.streaming import worker_events as W

GRAPH = "site string, url string, final_url string, attempt int, status int, content_type string, retry_after int, links array<struct<href:string,appears_in:string>>"
SPEC = "site string, root string, domains array<string>, disallow array<string>, sitemap array<string>"


def crawl(spark, pages, sitemap=(), disallow=(), **more):
    rows = [("s", u, f, a, st, ct, ra, [(h, r) for h, r in ls]) for u, f, a, st, ct, ra, ls in pages]
    spec = [("s", "https://a.test/", ["a.test"], list(disallow), list(sitemap))]
    got = C.simulate(spark.createDataFrame(rows, GRAPH), spark.createDataFrame(spec, SPEC), **more).collect()
    order = [r.url for r in sorted((r for r in got if r.kind == "page"), key=lambda r: r.seq)]
    return order, {r.url: r for r in got if r.kind == "skip"}, got


def ok(url, *links):
    return (url, url, 0, 200, "text/html", None, links)


def test_navigation_before_body_and_sitemap(spark):
    a = "https://a.test"
    order, skips, got = crawl(
        spark,
        [ok(f"{a}/", (f"{a}/body", "main"), (f"{a}/nav", "navigation"), (f"{a}/map2", "footer"), ("https://b.test/", "main")), ok(f"{a}/nav", (f"{a}/map1", "main")), ok(f"{a}/body"), ok(f"{a}/map1"), ok(f"{a}/map2")],
        sitemap=[f"{a}/map1", f"{a}/map2"],
    )
    assert order == [f"{a}/", f"{a}/nav", f"{a}/map2", f"{a}/body", f"{a}/map1"]
    assert next(r.seq for r in got if r.kind == "total") == 5 and not skips


def test_skips_backoff_and_limit(spark):
    a = "https://a.test"
    pages = [
        ok(f"{a}/", *[(f"{a}/{p}", "main") for p in ("cart/x", "no/1", "pdf", "away", "busy", "late", "ok")]),
        (f"{a}/pdf", f"{a}/pdf", 0, 200, "application/pdf", None, []),
        (f"{a}/away", "https://b.test/", 0, 200, "text/html", None, []),
        *[(f"{a}/busy", f"{a}/busy", k, 429, "", 90 if k == 0 else None, []) for k in range(4)],
        (f"{a}/late", f"{a}/late", 0, 429, "", None, []),
        (f"{a}/late", f"{a}/late", 1, 200, "text/html", None, []),
        ok(f"{a}/ok"),
    ]
    order, skips, got = crawl(spark, pages, disallow=["/no"])
    assert order == [f"{a}/", f"{a}/ok", f"{a}/late"]
    reasons = {u.removeprefix(a): r.reason for u, r in skips.items()}
    assert reasons == {"/cart/x": "excluded_path", "/no/1": "robots_disallow", "/pdf": "non_html", "/away": "offsite_redirect", "/busy": "rate_limited"}
    assert skips[f"{a}/busy"].attempts == 3 and skips[f"{a}/busy"].delays == [60000, 4000, 8000]
    assert crawl(spark, pages, max_pages=1)[0] == [f"{a}/"]


def test_unique_slugs(spark):
    df = spark.createDataFrame([("s", 0, "a"), ("s", 1, "a"), ("s", 2, "a-1"), ("s", 3, "a"), ("t", 0, "a")], "site string, seq int, base string")
    got = {(r.site, r.seq): r.slug for r in C.unique_slugs(df).collect()}
    assert got == {("s", 0): "a", ("s", 1): "a-1", ("s", 2): "a-1-1", ("s", 3): "a-2", ("t", 0): "a"}


def test_politeness_against_a_fold(spark):
    rng = random.Random(1)
    rows = [(k, i, rng.randint(0, 400_000), rng.choice([0, 100, 5000])) for i in range(300) for k in ("x", "y")]
    got = {(r.key, r.id): r.start_ms for r in J.politeness(spark.createDataFrame(rows, "key string, id int, at_ms bigint, took_ms bigint"), chunk_ms=20_000).collect()}
    for k in ("x", "y"):
        free = None
        for _, i, at, took in sorted((r for r in rows if r[0] == k), key=lambda r: (r[2], r[1])):
            start = at if free is None else max(at, free)
            assert got[(k, i)] == start
            free = start + took + 800


def test_spec_hash(spark):
    df = spark.createDataFrame([("crawl", '{"a":1,"b":[1,2]}'), ("crawl", '{"b":[1,2],"a":1}'), ("crawl", '{"a":1,"b":[2,1]}'), ("scan", '{"a":1,"b":[1,2]}'), ("x", "{bad"), ("x", None)], "k string, s string")
    h = [r[0] for r in df.select(J.spec_hash(F.col("k"), F.col("s"))).collect()]
    assert h[0] == h[1] and len({*h[:4]}) == 3 and len(h[0]) == 32 and h[4] is None and h[5] is not None


def test_containment(spark):
    df = spark.createDataFrame([("a/b.json",), ("../x",), ("a/../../x",), ("a/..",), ("%2e%2e/x",), ("a/%",)], "p string")
    assert [r[0] for r in df.select(files.is_contained(F.col("p"))).collect()] == [True, False, False, True, False, True]


def test_sources_and_sinks(spark, tmp_path):
    root = tmp_path / "jobs"
    (root / "j1").mkdir(parents=True)
    (root / "j1" / "job.json").write_text(json.dumps({"job_id": "j1", "kind": "crawl", "status": "queued"}))
    assert [(r.job_id, r.status) for r in files.read_jobs(spark, f"{root}/*/").collect()] == [("j1", "queued")]
    assert files.read_jobs(spark, str(tmp_path / "none")).count() == 0
    m = files.manifest(spark, str(root))
    assert [(r.path, r.bytes > 0) for r in m.collect()] == [("j1/job.json", True)]
    assert files.directory_bytes(m).first()[0] == m.first().bytes
    pages = spark.createDataFrame([("s", 1, "https://a/?x=1&y=2"), ("s", 0, "https://a/")], "site string, seq int, final_url string")
    xml = files.sitemap_xml(pages).first().xml
    assert xml.index("<loc>https://a/</loc>") < xml.index("x=1&amp;y=2")
    assert files.Settings.load({"SILKPAGE_MAX_PAGES": "7"}).max_pages == 7


def test_stream_of_worker_events(spark, tmp_path):
    src, out = tmp_path / "in", tmp_path / "out"
    src.mkdir()
    lines = [
        {"job_id": "a", "seq": 1, "at_ms": 1, "type": "progress", "payload": '{"type":"progress","n":1}'},
        {"job_id": "a", "seq": 2, "at_ms": 2, "type": "progress", "payload": '{"n":2,"u":"x"}'},
        {"job_id": "b", "seq": 1, "at_ms": 1, "type": "cancel", "payload": None},
        {"job_id": "b", "seq": 2, "at_ms": 1, "type": "result", "payload": "{}"},
    ]
    (src / "1.ndjson").write_text("noise\n" + "\n".join(map(json.dumps, lines)))
    for n in (1, 2):
        if n == 2:
            (src / "2.ndjson").write_text(json.dumps({"job_id": "a", "seq": 3, "at_ms": 3, "type": "exit", "payload": '{"exit":0}'}))
        q = W.job_states(W.read_events(spark, str(src))).writeStream.outputMode("update").foreachBatch(W.upsert(str(out))).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination(120)
    got = {r.job_id: (r.status, json.loads(r.progress), r.code) for r in spark.read.parquet(str(out / "v=1")).collect()}
    assert got == {"a": ("succeeded", {"n": 2, "u": "x"}, None), "b": ("cancelled", {}, None)}


def test_job_steps():
    assert W.advance("queued", {}, None, "start", {})[0] == "running"
    assert W.advance("running", {}, None, "exit", {"exit": 3}) == ("cancelled", {}, "aborted")
    assert W.advance("running", {}, "oom", "exit", {"exit": 1}) == ("failed", {}, "oom")
    assert W.advance("cancelled", {}, None, "result", {})[0] == "cancelled"
