"""Worker events as a stream: NDJSON lines in, job states out.

A line that is no JSON is dropped, as a library that writes to the worker's output must
not break a job. The state of a job is kept by transformWithStateInPandas on the RocksDB
store: last value of each progress key, the noted error code, and the terminal state once
it is known; an explicit cancellation is never overwritten. Batches are exact re-runs after a failure
through the query's checkpoint.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
EVENT = "job_id string, seq bigint, at_ms bigint, type string, payload string"
OUT = "job_id string, seq bigint, status string, progress string, code string"
TERMINAL = ("succeeded", "failed", "cancelled")
#: Codes of jobs that were stopped, the one for size first, and the events that say so.
STOPPED = ("artefact_cap_exceeded", "wall_clock_exceeded")
STOPS = {"oversize": STOPPED[0], "timeout": STOPPED[1]}


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """The stream of events of NDJSON files in a folder."""
    lines = spark.readStream.format("text").load(path)
    return parse_events(lines)


def parse_events(lines: DataFrame) -> DataFrame:
    """Events of text lines (column value); other lines are dropped."""
    return lines.withColumn("e", F.from_json("value", EVENT)).filter("e.job_id is not null and e.type is not null").select("e.*")


def advance(status: str, progress: dict, code: str | None, kind: str, body: dict) -> tuple[str, dict, str | None]:
    """One step of a job: queued, running, then one terminal state.

    Results and errors are notes (code: the last error's); only a cancellation or the exit
    ends a job. A job stopped for its size or its time has failed whatever its exit says."""
    if status in TERMINAL:
        return status, progress, code
    if kind == "cancel":
        return "cancelled", progress, None
    if kind == "exit":
        exit_code = body.get("exit")
        if code in STOPPED:
            return "failed", progress, code
        if exit_code == 0:
            return "succeeded", progress, None
        return ("cancelled", progress, code or "aborted") if exit_code == 3 else ("failed", progress, code or "worker_failed")
    if kind in STOPS:
        return status, progress, code if code == STOPPED[0] else STOPS[kind]
    if kind not in ("start", "progress", "result", "error"):
        return status, progress, code
    if kind == "progress":
        progress = progress | {k: v for k, v in body.items() if k != "type" and v is not None}
    if kind == "error" and code not in STOPPED:
        error = body.get("error")
        code = (error.get("code") if isinstance(error, dict) else None) or code
    return "running", progress, code


class JobStates(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("job", T.StructType([T.StructField("status", T.StringType()), T.StructField("progress", T.StringType()), T.StructField("code", T.StringType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        status, progress, code = "queued", {}, None
        if self.state.exists():
            status, text, code = self.state.get()
            progress = json.loads(text)
        events = pd.concat(list(rows)).sort_values("seq")
        for e in events.itertuples():
            try:
                body = json.loads(e.payload) if e.payload else {}
            except ValueError:
                body = {}
            status, progress, code = advance(status, progress, code, e.type, body if isinstance(body, dict) else {})
        text = json.dumps(progress, sort_keys=True)
        self.state.update((status, text, code))
        yield pd.DataFrame({"job_id": [key[0]], "seq": [int(events["seq"].max())], "status": [status], "progress": [text], "code": [code]})

    def close(self) -> None:
        pass


def job_states(events: DataFrame) -> DataFrame:
    """The state of each job after each batch that has events of it."""
    return events.groupBy("job_id").transformWithStateInPandas(
        JobStates(), outputStructType=T._parse_datatype_string(OUT), outputMode="Update", timeMode="None"
    )


def upsert(path: str):
    """A foreachBatch sink that keeps the last state of each job in Parquet, one version a
    batch; a batch that runs again writes the same version again."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        last = batch.groupBy("job_id").agg(F.max_by(F.struct("seq", "status", "progress", "code"), "seq").alias("s")).select("job_id", "s.*")
        fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/v={number - 1}")
        if number and fs_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(fs_path):
            old = spark.read.parquet(f"{path}/v={number - 1}")
            last = old.join(last.select("job_id"), "job_id", "left_anti").unionByName(last)
        last.write.mode("overwrite").parquet(f"{path}/v={number}")

    return write
