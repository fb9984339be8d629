"""Helpers shared by the training-data operators: tables, shared storage, text units."""

from __future__ import annotations

import atexit
import ctypes
import gc
import shutil
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of all contracts here: space and the controls 9 to 13.
WORD_SPLIT = r"[\x20\x09-\x0D]+"

_own_dirs: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir), or, where
    the session names none and runs on one machine (tests), a temporary one set here.
    A cluster without a named folder is an error: each machine would write its own disk."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        app = spark.sparkContext.applicationId
        named = _own_dirs.get(app)
        if not named:
            named = _own_dirs[app] = tempfile.mkdtemp(prefix="silkpage-")
            atexit.register(shutil.rmtree, named, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def release() -> None:
    """Give what a Python worker has freed back to the system: workers are kept for later
    stages, and their idle memory counts against the executor's."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def tidy(f):
    """An Arrow function of batches that releases memory at its end."""

    def batched(batches):
        try:
            yield from f(batches)
        finally:
            gc.collect()
            release()

    return batched


def tidy_group(f):
    """The same of a key and its group, or of a key and two groups (tidy_groups)."""

    def grouped(key: tuple, group: pa.Table) -> pa.Table:
        try:
            return f(key, group)
        finally:
            release()

    return grouped


def tidy_groups(f):
    def cogrouped(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        try:
            return f(key, left, right)
        finally:
            release()

    return cogrouped


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session may have ended
        pass


#: Spark deletes a plan's shuffle files when its result is written, not when the driver
#: happens to collect garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, name: str, compression: str = "zstd", keep: bool = True) -> DataFrame:
    """Cut the lineage: write df as Parquet in the shared folder and read it again; the
    shuffle files of the write go with it. The table lives until the driver process ends
    (or drop_table, if asked)."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/silkpage/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", compression).parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    if keep:
        atexit.register(_remove, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._silkpage_path = path
    return out


def drop_table(df: DataFrame) -> None:
    """Delete a table made by materialize() that no later plan reads."""
    _remove(df.sparkSession, df._silkpage_path)


def words(text: Column) -> Column:
    """Array of the maximal runs without white space; null gives an empty array."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), WORD_SPLIT), lambda w: w != F.lit(""))


def doc_order_key(df: DataFrame, cols: list[str]) -> list[Column]:
    return [F.col(c).asc_nulls_first() for c in cols]


def fold_words(text: Column) -> Column:
    """Lower-case A-Z only, white-space runs become one space, ends trimmed; null: ''."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    low = F.translate(F.coalesce(text, F.lit("")), upper, upper.lower())
    return F.trim(F.regexp_replace(low, WORD_SPLIT, " "))
