"""Sharding by weighted rendezvous hashing (native: DataFrame functions only).

Every (record key, shard) pair gets a pseudo-random score -w / ln(u), u in (0, 1)
from xxhash64; the record goes to its best shard. A shard's share is in proportion
to its weight, a record's place depends on nothing but its key and the shards, and
a new shard takes records only into itself.

Defined cases: a null key is a key of its own (all null keys share a shard); equal
keys share a shard; empty tables give empty results; input columns are kept unless
they have the name of a result column, which replaces them. Weights must be > 0.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

N_SHARDS = 40


def rendezvous(key: Column, weights: Sequence[float], seed: int = 17) -> Column:
    """Array of the scores of all shards for a key; pick() takes the best of the first n."""

    if not weights or min(weights) <= 0:
        raise ValueError("weights must be positive")
    w = F.array(*[F.lit(float(x)) for x in weights])
    safe = F.coalesce(key.cast("string"), F.lit("\x00null"))

    def score(i: Column) -> Column:
        bits = F.shiftrightunsigned(F.xxhash64(safe, i, F.lit(seed)), 11)
        u = (bits.cast("double") + 0.5) / F.lit(float(1 << 53))
        return F.struct((-F.element_at(w, i + 1) / F.ln(u)).alias("s"), (-i).alias("i"))

    return F.transform(F.sequence(F.lit(0), F.lit(len(weights) - 1)), score)


def pick(scores: Column, n: int) -> Column:
    """The best of the first n shards; on equal scores the lower number."""
    return F.coalesce((-F.array_max(F.slice(scores, 1, n)).getField("i")).cast("int"), F.lit(0))


def assign(df: DataFrame, key: str, weights: Sequence[float], grown_by: float | None = None) -> DataFrame:
    """df with shard (int), and grown_shard when one more shard of weight grown_by is added."""
    all_w = list(weights) + ([grown_by] if grown_by else [])
    out = df.withColumn("__scores", rendezvous(F.col(key), all_w)).withColumn("shard", pick(F.col("__scores"), len(weights)))
    if grown_by:
        out = out.withColumn("grown_shard", pick(F.col("__scores"), len(all_w)))
    return out.drop("__scores")


def with_slots(df: DataFrame, shard: str, order: Sequence[str], buckets: int = 256) -> DataFrame:
    """df with slot (long): 0, 1, ... without gaps in each shard.

    A shard holds a fixed share of all rows, too many for one task, so rows are
    counted in `buckets` hashed slices of each shard; a slice's rows are numbered
    in one task, after the slices before it. Rows equal in all `order` columns are
    interchangeable.
    """
    bucket = F.coalesce(F.pmod(F.xxhash64(*[F.col(c) for c in order]), F.lit(buckets)).cast("int"), F.lit(0))  # never null: the join then adds no filter
    df = df.withColumn("__bucket", bucket)
    counts = df.groupBy(F.col(shard).alias("__s"), F.col("__bucket").alias("__b")).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy("__s").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("__s", "__b", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    within = Window.partitionBy(shard, "__bucket").orderBy(*[F.col(c) for c in order])
    numbered = df.withColumn("__row", F.row_number().over(within))
    return (
        numbered.join(starts, (F.col(shard) == F.col("__s")) & (F.col("__bucket") == F.col("__b")))
        .withColumn("slot", F.col("__start") + F.col("__row") - 1)
        .drop("__bucket", "__b", "__s", "__n", "__start", "__row")
    )


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents into 40 shards of weight 1; law `key`. text_crc32 of a null text is null's: 0."""
    body = F.coalesce(F.col("text"), F.lit(""))
    docs = table(spark, sf_dir, "documents").select(
        "doc_id",
        (F.octet_length(body) + 16).cast("long").alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
    )
    placed = assign(docs, "doc_id", [1.0] * N_SHARDS, grown_by=1.0)
    return with_slots(placed, "shard", ["doc_id", "text_crc32", "size"]).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard"
    )
