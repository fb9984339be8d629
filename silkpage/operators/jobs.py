"""Job-lifecycle analytics over job records and worker events."""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from silkpage.config import ARTEFACT_CAP, DEDUP_WINDOW_MS, FLUSH_MS, HIGH_WATER_PCT, HYSTERESIS_PCT, POLITE_INTERVAL_MS, RECOVERY_ATTEMPTS, TTL_MS
from silkpage.functions.net import wall_clock_ms

ENDED = ("succeeded", "failed", "cancelled", "expired")


def newest_first(jobs: DataFrame, limit: int) -> DataFrame:
    """The newest `limit` jobs: ids sort by time. A report's limit, planned as a top-k."""
    return jobs.orderBy(F.desc("job_id")).limit(limit)


def page_limit(limit: Column) -> Column:
    """min(limit or 50, 200)."""
    return F.least(F.coalesce(F.nullif(limit, F.lit(0)), F.lit(50)), F.lit(200))


def job_list(jobs: DataFrame, status: str | None = None, kind: str | None = None, limit: int = 50, cursor: str | None = None) -> DataFrame:
    """A page of jobs, newest first, after the cursor (one that no job has: from the start).
    The kind is filtered after the limit, so a page can be short."""
    rows = jobs
    if cursor is not None:
        known = jobs.filter(F.col("job_id") == cursor).select(F.lit(True).alias("known")).limit(1)
        rows = rows.join(known, how="left").filter(F.col("known").isNull() | (F.col("job_id") < cursor)).drop("known")
    if status:
        rows = rows.filter(F.col("status") == status)
    page = newest_first(rows, limit)
    return page.filter(F.col("kind") == kind) if kind else page


def claim(jobs: DataFrame, window: int | None = 50) -> DataFrame:
    """The oldest of the newest `window` queued jobs (None: of all)."""
    queued = jobs.filter("status = 'queued'")
    queued = newest_first(queued, window) if window else queued
    return queued.orderBy("job_id").limit(1)


def duplicates(requests: DataFrame, jobs: DataFrame, window_ms: int = DEDUP_WINDOW_MS, newest: int | None = 200) -> DataFrame:
    """request_id, job_id: the newest job of the same hash that is in flight, or ended well
    no longer than window_ms before the request's `now`."""
    seen = newest_first(jobs, newest) if newest else jobs
    end = F.coalesce("finished_at", "created_at")
    age = F.unix_millis("now") - F.unix_millis(end)
    usable = F.col("status").isin("queued", "running") | (F.col("status") == "succeeded") & (age <= window_ms)
    hit = requests.join(seen, "spec_hash").filter(usable)
    return hit.groupBy("request_id").agg(F.max("job_id").alias("job_id"))


def expired(jobs: DataFrame, now: Column, ttl_ms: int = TTL_MS, newest: int | None = 1000) -> DataFrame:
    seen = newest_first(jobs, newest) if newest else jobs
    age = F.unix_millis(now) - F.unix_millis(F.coalesce("finished_at", "created_at"))
    return seen.filter(F.col("status").isin(*ENDED) & (age >= ttl_ms)).select("job_id")


def pressure(jobs: DataFrame, used_bytes: float, disk_bytes: float, high: float = HIGH_WATER_PCT, hysteresis: float = HYSTERESIS_PCT, newest: int = 1000) -> DataFrame:
    """Ended jobs to remove, oldest first, until usage is below the mark less hysteresis.

    The examined jobs are at most `newest`, so one running sum holds them."""
    seen = newest_first(jobs, newest).filter(F.col("status").isin(*ENDED))
    order = Window.orderBy(F.coalesce("finished_at", "created_at"), "job_id").rowsBetween(Window.unboundedPreceding, -1)
    rows = seen.withColumn("freed_before", F.coalesce(F.sum("bytes").over(order), F.lit(0)))
    over = F.lit(100.0 * used_bytes / disk_bytes >= high)
    pct = (F.lit(used_bytes) - F.col("freed_before")) * 100.0 / disk_bytes
    return rows.filter(over & ((F.col("freed_before") == 0) | (pct >= high - hysteresis))).select("job_id", "bytes")


def recover(jobs: DataFrame, max_attempts: int = RECOVERY_ATTEMPTS) -> DataFrame:
    """What a restart does with jobs that run without a process, or wait."""
    alive = F.col("alive") & F.col("pid").isNotNull()
    lost = jobs.filter((F.col("status") == "queued") | (F.col("status") == "running") & ~F.coalesce(alive, F.lit(False)))
    return lost.select("job_id", F.when(F.col("attempt") < max_attempts, "requeued").otherwise("failed").alias("action"))


def final_state(cancelled: Column, oversized: Column, timed_out: Column, exit_code: Column, error_code: Column) -> tuple[Column, Column]:
    """(status, error code) of an ended worker; an explicit cancellation comes first."""
    status = F.when(cancelled, "cancelled").when(oversized | timed_out, "failed").when(exit_code == 0, "succeeded").when(exit_code == 3, "cancelled").otherwise("failed")
    code = (
        F.when(cancelled, F.lit(None))
        .when(oversized, "artefact_cap_exceeded")
        .when(timed_out, "wall_clock_exceeded")
        .when(exit_code == 0, F.lit(None))
        .when(exit_code == 3, F.coalesce(error_code, F.lit("aborted")))
        .otherwise(F.coalesce(error_code, F.lit("worker_failed")))
    )
    return status, code


def over_budget(kind: Column, ran_ms: Column) -> Column:
    return ran_ms > wall_clock_ms(kind)


def over_cap(samples: DataFrame, cap: int = ARTEFACT_CAP) -> DataFrame:
    """First size sample of each job above the cap."""
    return samples.filter(F.col("bytes") > cap).groupBy("job_id").agg(F.min("at_ms").alias("at_ms"))


def progress(events: DataFrame) -> DataFrame:
    """Last value of each key of a job's progress events: job_id, key, value. Lines that are
    no JSON are left out."""
    rows = events.withColumn("p", F.from_json("payload", "map<string,string>")).filter("p is not null and type = 'progress'")
    flat = rows.select("job_id", "seq", F.explode("p").alias("key", "value")).filter("value is not null and key <> 'type'")
    return flat.groupBy("job_id", "key").agg(F.max_by("value", "seq").alias("value"))


def throttle(events: DataFrame, gap_ms: int = FLUSH_MS) -> DataFrame:
    """job_id, at_ms of the progress events that are flushed: the first, then each that comes
    more than gap_ms after the last flush. One job's events are one worker's output, at most
    its wall clock long, and are folded in order."""
    start = F.struct(F.lit(0).cast("bigint").alias("last"), F.array().cast("array<bigint>").alias("out"))
    times = F.sort_array(F.collect_list("at_ms"))

    def step(a: Column, t: Column) -> Column:
        flush = t - a.getField("last") > gap_ms
        return F.struct(
            F.when(flush, t).otherwise(a.getField("last")).alias("last"),
            F.when(flush, F.array_append(a.getField("out"), t)).otherwise(a.getField("out")).alias("out"),
        )

    g = events.filter("type = 'progress'").groupBy("job_id").agg(times.alias("t"))
    return g.select("job_id", F.explode(F.aggregate("t", start, step, lambda a: a.getField("out"))).alias("at_ms"))


def job_view(jobs: DataFrame) -> DataFrame:
    """The public shape: no process number, no hash; with links."""
    return jobs.select(
        "job_id", "kind", "status", "spec", "created_at", "started_at", "finished_at", "attempt",
        F.concat(F.lit("/scrape-runs/"), "job_id", F.lit("/")).alias("artefacts"),
        F.concat(F.lit("/scrape/"), "kind", F.lit("s/"), "job_id").alias("self"),
    )


def politeness(requests: DataFrame, interval_ms: int = POLITE_INTERVAL_MS, chunk_ms: int = 86_400_000) -> DataFrame:
    """requests (key, id, at_ms, took_ms) with start_ms: first come, first served for each
    key, one at a time, interval_ms after the one before ended.

    start_i = C_i + max over j <= i of (at_j - C_j), C_i the sum of (took + interval) before
    i. A key is cut into chunks of time: sums and maxima inside a chunk, then over the few
    chunks of a key, so that no task needs all requests of one key."""
    rows = requests.withColumns({"chunk": F.floor(F.col("at_ms") / chunk_ms), "step": F.col("took_ms") + interval_ms})
    inside = Window.partitionBy("key", "chunk").orderBy("at_ms", "id")
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("c", F.coalesce(F.sum("step").over(before), F.lit(0)))
    rows = rows.withColumn("m", F.max(F.col("at_ms") - F.col("c")).over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    chunks = rows.groupBy("key", "chunk").agg(F.sum("step").alias("total"), F.max(F.col("at_ms") - F.col("c")).alias("top"))
    earlier = Window.partitionBy("key").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    chunks = chunks.withColumn("base", F.coalesce(F.sum("total").over(earlier), F.lit(0)))
    chunks = chunks.withColumn("carried", F.max(F.col("top") - F.col("base")).over(earlier)).select("key", "chunk", "base", "carried")
    best = F.greatest(F.col("m") - F.col("base"), F.coalesce("carried", F.col("m") - F.col("base")))
    return rows.join(chunks, ["key", "chunk"]).withColumn("start_ms", F.col("base") + F.col("c") + best).drop("chunk", "step", "c", "m", "base", "carried")


def canonical_hash(kind: str, spec: str | None) -> str | None:
    """32 hexadecimal digits of the spec with sorted keys; order in arrays counts."""
    try:
        body = json.loads(spec) if spec is not None else None
    except ValueError:
        return None
    text = json.dumps({"kind": kind, "spec": body}, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    return hashlib.sha256(text.encode()).hexdigest()[:32]


@F.pandas_udf(T.StringType())
def spec_hash(kind: pd.Series, spec: pd.Series) -> pd.Series:
    return pd.Series([canonical_hash(k, s) for k, s in zip(kind, spec, strict=True)], dtype=object)
