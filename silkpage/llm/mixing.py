"""Mixing sources to target weights by hierarchical budgeting.

Leaves are (domain, lang, source). A budget of tokens is split among domains, in each
domain among its languages, in each language among its sources, in proportion to the
weights. A node cannot take more than its documents give in `max_epochs` passes; what
is short is split among its siblings that still have room, in proportion to their
weights, and only what they cannot take goes back to the parent's siblings.

A leaf's budget is filled by whole passes (epochs) and a prefix of one more: each
epoch orders the leaf's documents by a seeded hash, and the prefix takes documents until
the next one would start at or beyond the remaining budget. Prefix sums are made in two
steps: tokens are added up in hash slices of each leaf, so that only the one slice where
the budget ends is ordered row by row, however large the leaf.

The table of leaves (a few numbers a leaf) is planned on the driver; more than
`max_leaves` leaves raise an error. Everything else stays in Spark.

Defined cases: tokens are runs without white space, a null text has none; documents
without tokens belong to every full pass, and to a prefix like others; null domain,
lang or source are values of their own; rows of one doc_id with different texts are
ordered by a hash of the text, so that the mix does not depend on the order of the input;
rows equal in doc_id and text are alike, and it does not matter which of them is taken;
zero weights take nothing; names not in a weight table weigh 1. ANY in a weight path is
every name, a null one too; a path without it goes before.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, words

#: In a path of a weight table: every name.
ANY = ...
SLICES = 4096
SEED = 7
#: The mix of the registered query: share of all tokens; target weights by domain, by
#: language in every domain, and by source in every language.
SHARE = 0.6
DOMAIN_WEIGHTS = {"src": 0.7, "src1": 0.3}
LANG_WEIGHTS = {"en": 0.55, "de": 0.2, "fr": 0.15, "es": 0.1}
SOURCE_WEIGHTS = {"src0": 3.0, "src1": 2.0, "src10": 2.0}


def split(budget: float, weights: Mapping, room: Mapping) -> dict:
    """budget over the keys in proportion to weights, none above its room; what a full
    key cannot take is split anew among the others."""
    given = dict.fromkeys(weights, 0.0)
    active = {k for k in weights if weights[k] > 0 and room[k] > 0}
    left = min(budget, sum(room[k] for k in active))
    while active and left > 1e-9:
        total = sum(weights[k] for k in active)
        full = {k for k in active if given[k] + left * weights[k] / total >= room[k]}
        if not full:
            for k in active:
                given[k] += left * weights[k] / total
            break
        for k in full:
            left -= room[k] - given[k]
            given[k] = room[k]
        active -= full
    return given


def weight(path: tuple, weights: Mapping[tuple, float]) -> float:
    """The weight of a node: its own, else that of its name in every parent, else 1."""
    return weights.get(path, weights.get((*[ANY] * (len(path) - 1), path[-1]), 1.0))


def plan(leaves: Mapping[tuple, float], budget: float, weights: Mapping[tuple, float]) -> dict[tuple, float]:
    """Budget of each leaf path. leaves: path -> room; weights: path or its beginning -> weight.

    Levels are split from the root; a node's room is what its leaves can give."""

    def go(prefix: tuple, budget: float, members: list[tuple]) -> dict[tuple, float]:
        if members == [prefix]:
            return {prefix: budget}
        children: dict[tuple, list[tuple]] = {}
        for m in sorted(members, key=str):
            children.setdefault(m[: len(prefix) + 1], []).append(m)
        shares = split(budget, {c: weight(c, weights) for c in children}, {c: sum(leaves[m] for m in ms) for c, ms in children.items()})
        out: dict[tuple, float] = {}
        for c, ms in children.items():
            out |= go(c, shares[c], ms)
        return out

    return go((), budget, list(leaves)) if leaves else {}


def domain_of(source: Column) -> Column:
    """The domain of a source: its name without the last digit (tens of numbered sources)."""
    return F.regexp_replace(source, r"\d$", "")


def _order(doc_id: Column, text_hash: Column, epoch: Column, seed: int) -> Column:
    """53-bit order of a document in an epoch."""
    return F.shiftrightunsigned(F.xxhash64(F.coalesce(doc_id.cast("string"), F.lit("\x00")), text_hash, epoch, F.lit(seed)), 11)


def mix(
    docs: DataFrame,
    budget_share: float = SHARE,
    weights: Mapping[tuple, float] | None = None,
    max_epochs: int = 2,
    seed: int = SEED,
    domain: Column | None = None,
    doc_id: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    source: str = "source",
    max_leaves: int = 100_000,
) -> DataFrame:
    """docs with __domain, __tokens, __full (whole epochs) and __copies (times selected);
    rows of no copy are left out."""
    rows = docs.withColumns(
        {
            "__domain": domain if domain is not None else domain_of(F.col(source)),
            "__tokens": F.size(words(F.col(text))).cast("long"),
            "__hash": F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit(""))),
            "__lang": F.col(lang),
            "__source": F.col(source),
        }
    )
    leaf = ["__domain", "__lang", "__source"]
    sums = rows.select(*leaf, "__tokens").groupBy(*leaf).agg(F.sum("__tokens").alias("tokens")).limit(max_leaves + 1).collect()
    if len(sums) > max_leaves:
        raise ValueError(f"more than {max_leaves} leaves")
    have = {(r["__domain"], r["__lang"], r["__source"]): float(r["tokens"] or 0) for r in sums}
    given = plan({k: v * max_epochs for k, v in have.items()}, budget_share * sum(have.values()), weights or {})
    plans = []
    for k, v in have.items():
        full = min(int(given[k] // v), max_epochs) if v else (1 if given[k] or not sum(have.values()) else 0)
        plans.append((*k, full, int(round(given[k] - full * v)) if full < max_epochs else 0))
    spark = docs.sparkSession
    planned = spark.createDataFrame(plans, "__domain string, __lang string, __source string, __full int, __rest bigint")
    on = F.lit(True)
    for c in leaf:
        on = on & rows[c].eqNullSafe(planned[c])
    # The plan has one short row a leaf, at most max_leaves; Spark broadcasts it while it is small.
    rows = rows.join(planned, on, "left").select(rows["*"], F.coalesce("__full", F.lit(0)).alias("__full"), F.coalesce("__rest", F.lit(0)).alias("__rest"))
    rows = rows.withColumn("__at", _order(F.col(doc_id), F.col("__hash"), F.col("__full"), seed))
    rows = rows.withColumn("__slice", F.floor(F.col("__at") / F.lit(float(1 << 53) / SLICES)).cast("int"))
    slices = rows.filter("__rest > 0").groupBy(*leaf, "__slice").agg(F.sum("__tokens").alias("__in"), F.max("__rest").alias("__rest"))
    before = Window.partitionBy(*leaf).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = slices.withColumn("__before", F.coalesce(F.sum("__in").over(before), F.lit(0)))
    # Where the budget ends: slices before it are taken, those behind are not.
    edge = slices.filter("__before < __rest and __before + __in >= __rest").groupBy(*leaf).agg(F.min(F.struct("__slice", "__before")).alias("__e"))
    edge = edge.select(*[F.col(c).alias(f"{c}_e") for c in leaf], F.col("__e.__slice").alias("__edge"), F.col("__e.__before").alias("__edge_before"))
    on = F.lit(True)
    for c in leaf:
        on = on & rows[c].eqNullSafe(edge[f"{c}_e"])
    rows = rows.join(edge, on, "left").drop(*[f"{c}_e" for c in leaf])
    has = F.col("__rest") > 0
    inside = has & (F.col("__edge").isNull() | (F.col("__slice") < F.col("__edge")))
    sure = rows.filter(F.coalesce(~(has & (F.col("__slice") == F.col("__edge"))), F.lit(True))).withColumn("__more", F.when(inside, 1).otherwise(0))
    w = Window.partitionBy(*leaf).orderBy("__at", doc_id, "__hash").rowsBetween(Window.unboundedPreceding, -1)
    open_ = rows.filter(has & (F.col("__slice") == F.col("__edge"))).withColumn("__sum", F.coalesce(F.sum("__tokens").over(w), F.lit(0)) + F.col("__edge_before"))
    open_ = open_.withColumn("__more", F.when(F.col("__sum") < F.col("__rest"), 1).otherwise(0)).drop("__sum")
    done = sure.unionByName(open_).withColumn("__copies", F.col("__full") + F.col("__more"))
    return done.filter("__copies > 0").drop("__rest", "__at", "__slice", "__edge", "__edge_before", "__more", "__lang", "__source", "__hash")


def lang_weights(domain=ANY) -> dict[tuple, float]:
    """The target weights by language, in one domain or in every one."""
    return {(domain, k): v for k, v in LANG_WEIGHTS.items()}


def target_weights() -> dict[tuple, float]:
    """The target weights of all three levels."""
    return {(k,): v for k, v in DOMAIN_WEIGHTS.items()} | lang_weights() | {(ANY, ANY, k): v for k, v in SOURCE_WEIGHTS.items()}


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"), weights=target_weights())
    return mixed.select(
        "doc_id", F.col("__domain").alias("domain"), "lang", "source", F.col("__tokens").alias("n_tokens"), F.col("__full").alias("full_epochs"), F.col("__copies").alias("copies")
    )
