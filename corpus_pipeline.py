"""The corpus pipeline: STAGES over `documents`, each written as Parquet before the next.

Every stage works on all that the one before kept. Rows are documents with doc_id, text,
lang, source and n_chars; the last stage gives their tokens.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from silkpage.llm import bpe, mixing, near_dup, suffix_dedup, toxicity
from silkpage.llm.common import materialize, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Share of the tokens that the mix takes, each document once at most.
MIX_SHARE = 0.8


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a score under 0.5; the model is learned from the labelled ones here."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model, COLUMNS).filter("score < 0.5").select(*COLUMNS)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: five-word shingles, similarity 0.8."""
    kept = near_dup.near_duplicates(docs, shingle=5, percent=80).filter("kept").select(F.col("doc_id").alias("kept_id"))
    return docs.join(kept, F.col("doc_id").eqNullSafe(F.col("kept_id")), "left_semi").select(*COLUMNS)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of 50 bytes or more that smaller doc_ids have too."""
    cut = suffix_dedup.remove_repeats(docs, keep=["lang", "source"])
    return cut.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", F.coalesce(F.char_length("kept_text"), F.lit(0)).cast("long").alias("n_chars"))


def to_target_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix by domain, language and source, without repetition."""
    return mixing.mix(docs, budget_share=MIX_SHARE, weights=mixing.target_weights(), max_epochs=1).select(*COLUMNS)


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids and their digests."""
    return bpe.encode_decode(docs, bpe.vocabulary_path(), with_ids=True).select("doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dup", one_of_each_group),
    ("suffix_dedup", cut_repeats),
    ("mixing", to_target_mix),
    ("bpe", to_tokens),
]

#: Hashes, learned scores and tokenizers are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
