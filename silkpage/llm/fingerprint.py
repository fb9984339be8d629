"""Document fingerprints as invertible Bloom lookup sketches (native: DataFrame functions only).

A text is cut into paragraphs: lines, and in a line single sentences. What runs on for
more than LONG characters without a sentence mark is cut where its characters say so,
so that equal passages get equal cuts wherever they stand: between two words of which the
second begins as the first ends, else between two equal characters, else after MOST. Each
different paragraph has a 64-bit digest whose low 16 bits check the others. A sketch has
three subtables of CELLS cells (count, XOR of digests); a digest goes to one cell of each.
Counts tell how large a retry must be; checks and places tell which cells hold one digest.

Two versions are compared by their sketches: cells are subtracted, a cell that
holds one digest gives it up, its digest is taken out of its other cells, and so on
until nothing is left: all digests that only one version has. Where cells remain, the
sketches were too small. Then larger ones are made, of as many blocks of such cells as the
failed difference calls for (the squares of its counts estimate how many digests differ),
a digest's own bits naming its block. Each block is subtracted and peeled by itself, and
one that fails is made again four times as large, until its digests' bits are used up: the
work grows with the digests, whatever the length of a text.

likeness = shared / all digests of both versions (two empty texts: 1).

Defined cases: a null text is an empty one, with no paragraphs; equal texts have equal
fingerprints; repeated paragraphs count once. Three or more differing digests that agree
in all bits that name blocks (probability below 1e-18 a pair of texts) would count without
being peeled. Of the next document: descending doc_id,
null last, equal ids by text; the first follows the last; a single row is its own next.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

#: Cells of a subtable, and differing digests that a block of three of them is made for.
CELL_BITS = 3
CELLS, LOAD = 1 << CELL_BITS, 10
#: Of a digest's bits: the check, the places in the three subtables, the block.
CHECK_BITS = 16
BLOCK_AT = CHECK_BITS + 3 * CELL_BITS
#: Enough rounds to empty a block, and enough enlargements to use up all block bits.
ROUNDS, GROWTHS = 3 * CELLS, (64 - BLOCK_AT + 1) // 2
#: Ranges of doc_id in which neighbours meet.
RANGE_ROWS, LEAST_RANGES, MOST_RANGES = 50_000, 1024, 1 << 16
MARKS = ".!?。！？｡؟۔।॥։።…"
#: Characters of a run that stays whole, and the least and most of a part of longer ones.
LONG, LEAST, MOST = 160, 40, 400
#: Where sentences and lines end, and the parts of a long one.
SENTENCES = rf"\n|(?<=[{MARKS}])(?![{MARKS}\n])"
PARTS = rf"(?s).{{{LEAST},{MOST}}}?(\S)[ \t]+(?=\1)|.{{{LEAST},{MOST}}}?(\S)(?=\2)|.{{1,{MOST}}}"


def digests(text: Column) -> Column:
    """Sorted different digests of a text's paragraphs."""

    def digest(p: Column) -> Column:
        high = F.xxhash64(p).bitwiseAND(F.lit(~0xFFFF))
        return high.bitwiseOR(_check(high))

    pieces = F.transform(F.split(F.coalesce(text, F.lit("")), SENTENCES), lambda p: F.trim(p))
    cut = F.transform(pieces, lambda p: F.when(F.char_length(p) <= LONG, F.array(p)).otherwise(F.transform(F.regexp_extract_all(p, F.lit(PARTS), F.lit(0)), lambda x: F.trim(x))))
    return F.sort_array(F.array_distinct(F.transform(F.filter(F.flatten(cut), lambda p: p != F.lit("")), digest)))


def _check(x: Column) -> Column:
    return F.pmod(F.hash(F.shiftrightunsigned(x, 16)), F.lit(65536)).cast("bigint")


def _mask(sub: int) -> int:
    return (CELLS - 1) << (CHECK_BITS + CELL_BITS * sub)


def _cells(sub: int) -> Column:
    """The bits of a digest that name the cells of a subtable."""
    return F.array(*[F.lit(i << (CHECK_BITS + CELL_BITS * sub)).cast("bigint") for i in range(CELLS)])


def _own(d: Column, sub: int, cell: Column) -> Column:
    """The digests whose place in a subtable is this one of _cells()."""
    return F.filter(d, lambda x: x.bitwiseAND(F.lit(_mask(sub))) == cell)


def _bits(x: Column, at: Column, n: Column) -> Column:
    """The number that a digest's bits from `at` on name, modulo a power of two."""
    return F.call_function("shiftrightunsigned", x, at).bitwiseAND(n - 1)


def _into(start: Column, d: Column, sub: int, cell: Column) -> Column:
    """start XOR the digests of this cell of a subtable."""
    here = lambda x: x.bitwiseAND(F.lit(_mask(sub))) == cell
    return F.aggregate(d, start, lambda k, x: F.when(here(x), k.bitwiseXOR(x)).otherwise(k))


def build(d: Column) -> Column:
    """The XORs of the cells, subtable after subtable, of the digests d."""
    table_of = lambda sub: F.transform(_cells(sub), lambda v: _into(F.lit(0).cast("bigint"), d, sub, v))
    return F.concat(*[table_of(sub) for sub in range(3)])


def counts(d: Column) -> Column:
    """The counts of the cells."""
    table_of = lambda sub: F.transform(_cells(sub), lambda v: F.size(_own(d, sub, v)))
    return F.concat(*[table_of(sub) for sub in range(3)])


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x.bitwiseXOR(y))


def peel(cells: Column) -> Column:
    """Number of digests recovered from a difference of sketches, null if cells remain.

    A cell holds one digest if its check is right and its place is this cell. What passes
    by chance (an XOR of several, 1 in 2**16) is put into its other cells, so that these
    stay full or give it up again; either way the result is null and the sketch too small."""

    def pure(c: Column) -> Column:
        """The different digests that cells give up."""
        one = lambda sub: lambda x, v: F.when((x.bitwiseAND(F.lit(_mask(sub))) == v) & (x != 0) & (x.bitwiseAND(F.lit(0xFFFF)) == _check(x)), x)
        of = lambda sub: F.zip_with(F.slice(c, sub * CELLS + 1, CELLS), _cells(sub), one(sub))
        return F.array_distinct(F.filter(F.concat(*[of(sub) for sub in range(3)]), lambda x: x.isNotNull()))

    def without(c: Column, ones: Column) -> Column:
        """Cells after these digests are taken out of the three cells of each."""
        of = lambda sub: F.zip_with(F.slice(c, sub * CELLS + 1, CELLS), _cells(sub), lambda x, v: _into(x, ones, sub, v))
        return F.concat(*[of(sub) for sub in range(3)])

    def step(state: Column, _: Column) -> Column:
        c, found = state.getField("c"), state.getField("found")

        def go(ones: Column) -> Column:
            end = F.struct(c.alias("c"), found.alias("found"), F.lit(False).alias("more"))
            return F.when(F.size(ones) == 0, end).otherwise(F.struct(without(c, ones).alias("c"), F.concat(found, ones).alias("found"), F.lit(True).alias("more")))

        return F.when(state.getField("more"), _let(pure(c), go)).otherwise(state)

    start = F.struct(cells.alias("c"), F.array().cast("array<bigint>").alias("found"), F.lit(True).alias("more"))

    def verdict(state: Column) -> Column:
        left, found = F.exists(state.getField("c"), lambda x: x != 0), state.getField("found")
        return F.when(~left & (F.size(found) == F.size(F.array_distinct(found))), F.size(found))

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step, verdict)


def _let(value: Column, f) -> Column:
    """f(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _deal(d: Column, blocks: Column) -> Column:
    """The digests of each block; a power of two of them, dealt in two steps so that a
    block is not compared with every digest."""
    at = F.lit(BLOCK_AT)

    def by(outer: Column) -> Column:
        inside = lambda j: lambda ds: F.transform(F.sequence(j, blocks - 1, outer), lambda v: F.filter(ds, lambda x: _bits(x, at, blocks) == v))
        some = lambda j: _let(F.filter(d, lambda x: _bits(x, at, outer) == j), inside(j))
        return F.flatten(F.transform(F.sequence(F.lit(0).cast("bigint"), outer - 1), some))

    return _let(F.pow(F.lit(2), F.ceil(F.log2(blocks) / 2)).cast("bigint"), by)


def _both(a: Column, b: Column) -> Column:
    return F.struct(a.alias("a"), b.alias("b"))


def larger(a: Column, b: Column, more: Column) -> Column:
    """Number of the digests that differ, by sketches of many blocks; more: by how much the
    counts of the single blocks differ."""
    squares = F.aggregate(more, F.lit(0).cast("bigint"), lambda n, x: n + x.cast("bigint") * x) / 3
    wanted = F.greatest(F.least(squares, F.size(a) + F.size(b)) / LOAD, F.lit(4))

    def all_blocks(blocks: Column) -> Column:
        start = F.struct(
            F.zip_with(_deal(a, blocks), _deal(b, blocks), _both).alias("open"),
            F.lit(0).cast("bigint").alias("found"),
            (F.lit(BLOCK_AT) + F.log2(blocks).cast("int")).alias("at"),
        )

        def grow(state: Column, _: Column) -> Column:
            tried = lambda p: F.struct(p.alias("p"), peel(subtract(build(p.getField("a")), build(p.getField("b")))).alias("f"))

            def four(p: Column) -> Column:
                part = lambda ds, i: F.filter(ds, lambda x: _bits(x, state.getField("at"), F.lit(4)) == i)
                return F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: _both(part(p.getField("p").getField("a"), i), part(p.getField("p").getField("b"), i)))

            def judged(results: Column) -> Column:
                return F.struct(
                    F.flatten(F.transform(F.filter(results, lambda r: r.getField("f").isNull()), four)).alias("open"),
                    F.aggregate(results, state.getField("found"), lambda n, r: n + F.coalesce(r.getField("f"), F.lit(0))).alias("found"),
                    (state.getField("at") + 2).alias("at"),
                )

            return F.when(F.size(state.getField("open")) == 0, state).otherwise(_let(F.transform(state.getField("open"), tried), judged))

        rest = lambda s: F.aggregate(s.getField("open"), s.getField("found"), lambda n, p: n + F.size(p.getField("a")) + F.size(p.getField("b")))
        return F.aggregate(F.sequence(F.lit(1), F.lit(GROWTHS)), start, grow, rest)

    return _let(F.pow(F.lit(2), F.ceil(F.log2(wanted))).cast("bigint"), all_blocks)


def as_text(n: Column, held: Column, cells: Column) -> Column:
    """The fingerprint: number of digests, then each cell's count and XOR in hexadecimal."""
    return F.concat(n.cast("string"), F.lit(":"), F.array_join(F.zip_with(held, cells, lambda n, k: F.concat_ws(".", n.cast("string"), F.lower(F.hex(k)))), ","))


def with_sketch(df: DataFrame, *digests_of: str) -> DataFrame:
    """df with n_* and k_*, counts and XORs of the single blocks of columns of digests."""
    return df.withColumns({f"{x}_{d}": f(F.col(d)) for d in digests_of for x, f in (("n", counts), ("k", build))})


def with_likeness(df: DataFrame, a: str, b: str, out: str) -> DataFrame:
    """df with out: likeness of two columns of digests that with_sketch() was given."""
    df = df.withColumns({"__cells": subtract(F.col(f"k_{a}"), F.col(f"k_{b}")), "__more": F.zip_with(f"n_{a}", f"n_{b}", lambda x, y: x - y)})
    df = df.withColumn("__found", peel(F.col("__cells")).cast("bigint"))
    df = df.withColumn("__found", F.when(F.col("__found").isNull(), larger(F.col(a), F.col(b), F.col("__more"))).otherwise(F.col("__found")))
    both = F.size(a) + F.size(b)
    return df.withColumn(out, F.when(both == 0, 1.0).otherwise((both - F.col("__found")) / (both + F.col("__found"))).cast("double")).drop("__found", "__cells", "__more")


def with_next(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", slices: int | None = None, carry: list[dict[str, Column]] | None = None) -> DataFrame:
    """docs (doc_id, text, the columns `carry` computed step by step) with next_text and next_*,
    those of the next row in descending doc_id.

    Rows are dealt to ranges of doc_id at quantiles, so that neighbours meet without one
    order of all rows; each range ends with a copy of the first row of the next one (at
    most `slices` rows, known from the ranges' largest ids). Without `slices` there is a
    range for about RANGE_ROWS rows, between LEAST_RANGES and MOST_RANGES of them."""
    small = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    slices = slices or min(MOST_RANGES, max(LEAST_RANGES, small.count() // RANGE_ROWS))
    side = int(slices**0.5)
    quantiles = [k / (side * side) for k in range(1, side * side)]
    at = small.filter("doc_id is not null").approxQuantile("doc_id", quantiles, 1 / (8 * side * side)) or [0.0]
    fine = sorted({int(x) for x in at})
    coarse = fine[::side]
    groups = F.array(*[F.array(*[F.lit(x) for x in fine[k * side : (k + 1) * side]]) for k in range(len(coarse))])
    tops = F.array(*[F.lit(x) for x in coarse])
    # The range's number: bounds below the id, counted in the coarse ones, then in one group.
    g = F.size(F.filter(tops, lambda b: b <= F.col("doc_id")))
    inner = F.size(F.filter(F.get(groups, F.col("__g") - 1), lambda b: b <= F.col("doc_id")))
    ranged = small.withColumn("__g", g).withColumn(
        "__range", F.when(F.col("doc_id").isNull(), -1).when(F.col("__g") == 0, 0).otherwise((F.col("__g") - 1) * side + inner)
    ).drop("__g")
    tops_of = ranged.groupBy("__range").agg(F.max("doc_id").alias("first")).orderBy(F.desc("__range")).collect()
    follow = [(r["__range"], tops_of[(k + 1) % len(tops_of)]["first"]) for k, r in enumerate(tops_of)]
    firsts = docs.sparkSession.createDataFrame(follow, "__range int, __first bigint")
    copies = small.join(F.broadcast(firsts), small.doc_id.eqNullSafe(firsts["__first"])).select("doc_id", "text", "__range", F.lit(1).alias("__copy"))
    rows = ranged.select("doc_id", "text", "__range", F.lit(0).alias("__copy")).union(copies)
    for step in carry or []:
        rows = rows.withColumns(step)
    carried = [c for step in carry or [] for c in step]
    order = Window.partitionBy("__range").orderBy("__copy", F.col("doc_id").desc_nulls_last(), "text")
    lead = {"next_text": F.lead(F.coalesce("text", F.lit(""))).over(order)} | {f"next_{c}": F.lead(c).over(order) for c in carried}
    return rows.withColumns(lead).filter("__copy = 0").select("doc_id", "text", *carried, *lead)


def op8_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.coalesce("text", F.lit(""))
    near = with_next(table(spark, sf_dir, "documents"), carry=[{"da": digests(F.col("text"))}, {"n_da": counts(F.col("da")), "k_da": build(F.col("da"))}]).withColumns({"text": body, "next_text": F.coalesce("next_text", F.lit(""))})
    near = near.withColumn("n_chars", F.char_length("text").cast("long"))
    k = F.floor(F.col("n_chars") / 3).cast("int")
    near = near.withColumn("edited", F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - k), F.substring("next_text", F.lit(1), k)))
    near = near.withColumns({"de": digests(F.col("edited")), "edited_sha256": F.sha2(F.encode("edited", "UTF-8"), 256)})
    near = near.select("doc_id", "n_chars", "edited_sha256", "da", "n_da", "k_da", "de", *[F.col(f"next_{c}").alias(c.replace("da", "dn")) for c in ("da", "n_da", "k_da")])
    near = with_sketch(near, "de")
    near = near.withColumns({"fingerprint": as_text(F.size("da"), F.col("n_da"), F.col("k_da")), "edited_fingerprint": as_text(F.size("de"), F.col("n_de"), F.col("k_de"))})
    near = with_likeness(with_likeness(near, "da", "de", "near_edited"), "da", "dn", "near_next")
    return near.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
