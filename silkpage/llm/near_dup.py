"""MinHash near-duplicates with odd sketches.

1. One Arrow pass: the n-word shingle set of each whole text as 64-bit
   hashes, `BANDS` x `ROWS` MinHash values, their band keys, and two odd sketches.
   In the first each (position, MinHash value) flips one bit of a 1024-bit map, so the
   XOR of two maps counts how many samples differ and high similarities are told apart
   sharply. In the second each shingle flips one bit of a map of 2 to 4 bits a shingle
   (larger maps fold to smaller ones): its XOR never has more bits than the two sets
   have different shingles, so it excludes pairs for certain.
2. Texts of equal word sequences form one class; only class representatives go on.
3. Documents that share a band key are candidates. A bucket is never expanded into all
   pairs: first every class is tested against the hub of its best bucket (the class
   with most copies), links are joined into components, then only pairs of different
   components in a bucket are compared, on odd sketches in blocks of bounded size; of
   those each class first tests its closest member of every other component, and in the
   last round all that are left. A bucket with more than WIDE rows outside its largest
   component is split by shingles: of each row's set in the order of rarity among such
   rows, the first ones, so many that two sets of the similarity asked share one of them.
   So comparisons stay in proportion to rows and no pair is lost, whatever the size of a
   bucket; what is wide even then is compared in blocks as it is.
4. Candidates within the sketch limit are confirmed on the full shingle sets.

Two sets of Jaccard similarity 0.8 share no band with probability (1 - 0.8^5)^40 =
1.3e-7; they exceed the first sketch's limit with one under 1e-8; links between less similar
sets are rejected exactly.

Defined cases: words are runs without white space, A-Z lower-cased; fewer words than a
shingle give the whole sequence as one; null, empty and blank texts have no set and are
linked with nothing; rows that share a doc_id count as one document, linked where any of
its texts is; a null doc_id gives
a null component and is kept; repeated rows are kept as rows. An empty table gives an
empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_table, materialize, table, tidy, tidy_group
from .components import components

#: The least similarity that the bands and the sketch limit below find.
PERCENT = 80
BANDS, ROWS = 40, 5
SKETCH_BITS = 1024
#: Differing bits allowed: 74 expected at similarity 0.8, standard deviation below 11.
SKETCH_LIMIT = 140
#: Rows of one block in the comparison inside a bucket.
BLOCK = 1024
#: Rows outside a bucket's largest component up to which the bucket is not split.
WIDE = 16 * BLOCK
#: Rows that one call compares, about: several buckets together.
GROUP_ROWS = 10_000
#: Remembered word hashes of one Python worker; full, it starts anew.
MEMORY = 200_000

U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    """The finisher of splitmix64."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class Shingler:
    """Distinct shingle hashes of texts, words hashed once."""

    def __init__(self, size: int):
        self.size, self.known = size, {}

    def _hashes(self, ws: list[bytes]) -> np.ndarray:
        known = self.known
        try:
            return np.fromiter(map(known.__getitem__, ws), np.uint64, len(ws))
        except KeyError:
            if len(known) > MEMORY:
                known.clear()
            for w in ws:
                if w not in known:
                    known[w] = int.from_bytes(hashlib.blake2b(w, digest_size=8).digest(), "little")
            return np.fromiter(map(known.__getitem__, ws), np.uint64, len(ws))

    def __call__(self, text: str | None) -> tuple[np.ndarray, list[bytes]]:
        ws = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII space only
        if not ws:
            return np.empty(0, np.uint64), ws
        h = self._hashes(ws)
        n = min(self.size, len(h))
        out = h[: len(h) - n + 1].copy()
        for i in range(1, n):
            out = _mix(out) * U(0x9E3779B97F4A7C15) + h[i : len(h) - n + 1 + i]
        return np.unique(_mix(out + U(n))), ws


def _rows(batch: pa.RecordBatch) -> Iterator[tuple]:
    return zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)


def _permutations() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240229)
    k = BANDS * ROWS
    return rng.integers(0, 2**31, k, dtype=np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 2**32, k, dtype=np.uint32)


def _min_hashes(s: np.ndarray, mul: np.ndarray, add: np.ndarray) -> np.ndarray:
    """MinHash values of a set: the smallest of x * a + b modulo 2**32 for each (a, b)."""
    x = (s >> U(32)).astype(np.uint32)
    low = np.full(len(mul), 2**32 - 1, np.uint32)
    for i in range(0, len(x), 1024):  # what one step holds stays in the processor's cache
        part = x[None, i : i + 1024]
        for k in range(0, len(mul), 20):
            low[k : k + 20] = np.minimum(low[k : k + 20], (part * mul[k : k + 20, None] + add[k : k + 20, None]).min(axis=1))
    return low.astype(np.uint64)


def _parity(places: np.ndarray, bits: int) -> np.ndarray:
    """The odd sketch: bit p is set if an odd number of places is p. As bytes."""
    return np.packbits((np.bincount(places.astype(np.int64), minlength=bits) & 1).astype(np.uint8), bitorder="little")


def _set_bits(n: int) -> int:
    return 1 << max(9, (2 * n - 1).bit_length())


def _fold(m: np.ndarray, size: int) -> np.ndarray:
    """A parity map of places modulo a smaller power of two."""
    while len(m) > size:
        m = m[: len(m) // 2] ^ m[len(m) // 2 :]
    return m


def _signer(shingle: int):
    @tidy
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets, (mul, add) = Shingler(shingle), _permutations()
        place = np.arange(BANDS * ROWS, dtype=np.uint64) * U(0x9E3779B97F4A7C15)
        band_seed = _mix(np.arange(1, BANDS + 1, dtype=np.uint64))
        for big in batches:
            for at in range(0, big.num_rows, 500):
                ids, norms, sizes, bands, sketches, maps = [], [], [], [], [], []
                for doc_id, text in _rows(big.slice(at, 500)):
                    s, ws = sets(text)
                    ids.append(doc_id)
                    sizes.append(len(s))
                    if not len(s) or doc_id is None:
                        norms.append(None), bands.append(None), sketches.append(None), maps.append(None)
                        continue
                    low = _mix(_min_hashes(s, mul, add) + U(1))
                    key = band_seed.copy()
                    for r in range(ROWS):
                        key = _mix(key * U(31) + low[r::ROWS])
                    norms.append(hashlib.blake2b(b" ".join(ws), digest_size=16).digest())
                    bands.append(key.view(np.int64))
                    sketches.append(_parity(_mix(low + place) % U(SKETCH_BITS), SKETCH_BITS).view(np.int64))
                    maps.append(_parity(s & U(_set_bits(len(s)) - 1), _set_bits(len(s))).tobytes())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids, pa.int64()),
                        pa.array(norms, pa.binary()),
                        pa.array(sizes, pa.int64()),
                        pa.array(bands, pa.list_(pa.int64())),
                        pa.array(sketches, pa.list_(pa.int64())),
                        pa.array(maps, pa.binary()),
                    ],
                    ["doc_id", "norm", "n_shingles", "bands", "sketch", "map"],
                )

    return sign


def _setter(shingle: int):
    @tidy
    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = Shingler(shingle)
        for big in batches:
            for at in range(0, big.num_rows, 500):
                part = big.slice(at, 500)
                found = [sets(t)[0].view(np.int64) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.list_(pa.int64()))], ["node", "shingles"])

    return sets_of


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the similarity."""
    one = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa")), "a")
    two = one.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb")), "b")
    both = F.size(F.array_intersect("sa", "sb"))
    return two.filter(100 * both >= percent * (F.size("sa") + F.size("sb") - both)).select("a", "b")


def _possible(i: int, others: np.ndarray, sizes: np.ndarray, maps: list[np.ndarray], percent: int) -> np.ndarray:
    """Which of the others can reach the similarity with i, by the maps of their sets.

    100 * both >= percent * (a + b - both) leaves at most (100 - percent) / (100 + percent)
    of a + b shingles in one set only, and the maps differ in no more bits than that."""
    ok = np.zeros(len(others), bool)
    for k, j in enumerate(others.tolist()):
        size = min(len(maps[i]), len(maps[j]))
        differ = int(np.bitwise_count(_fold(maps[i], size) ^ _fold(maps[j], size)).sum())
        ok[k] = (100 + percent) * differ <= (100 - percent) * int(sizes[i] + sizes[j])
    return ok


def _compare(best_only: bool, percent: int):
    def bucket(node, comp, sizes, bits, maps, left, right):
        li, ri = np.flatnonzero(left), np.flatnonzero(right)
        for i in li.tolist():
            o = ri[comp[ri] != comp[i]]
            o = o[(100 * np.minimum(sizes[o], sizes[i]) >= percent * np.maximum(sizes[o], sizes[i]))]
            if not len(o):
                continue
            d = np.bitwise_count(bits[o] ^ bits[i]).sum(axis=1)
            near = d <= SKETCH_LIMIT
            o, d = o[near], d[near]
            fine = _possible(i, o, sizes, maps, percent)
            o, d = o[fine], d[fine]
            if best_only and len(o) > 1:  # the closest of each component
                order = np.lexsort((node[o], d, comp[o]))
                o = o[order]
                o = o[np.r_[True, comp[o][1:] != comp[o][:-1]]]
            if len(o):
                yield np.full(len(o), node[i]), node[o]

    @tidy_group
    def compare(key: tuple, group: pa.Table) -> pa.Table:
        """Pairs of different components in each (key, i, j) of a group of them."""
        group = group.combine_chunks()
        task = _mix(group.column("key").to_numpy().view(np.uint64)) + group.column("i").to_numpy().astype(np.uint64) * U(1 << 20) + group.column("j").to_numpy().astype(np.uint64)
        order = np.argsort(task, kind="stable")
        task = task[order]
        node, comp, sizes, left, right = (group.column(c).to_numpy()[order] for c in ("node", "comp", "n_shingles", "in_left", "in_right"))
        flat = group.column("sketch").combine_chunks()
        bits = flat.flatten().to_numpy().view(np.uint64).reshape(len(order), -1)[order]
        maps = [np.frombuffer(b, np.uint64) for b in group.column("map").take(pa.array(order)).to_pylist()]
        edges = np.r_[np.flatnonzero(np.r_[True, task[1:] != task[:-1]]), len(task)]
        found = []
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            m = slice(a, b)
            found += bucket(node[m], comp[m], sizes[m], bits[m], maps[m], left[m], right[m])
        if not found:
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        a, b = (np.concatenate(x) for x in zip(*found, strict=True))
        pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
        return pa.table({"a": pairs[0], "b": pairs[1]})

    return compare


def _open_buckets(rows: DataFrame) -> DataFrame:
    """key, main (the component with most rows there), n_major (its rows) and n_minor (the
    others') of the buckets that have several components; counted in two steps, as one
    bucket may hold a third of all rows."""
    per = rows.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("n"))
    per = per.groupBy("key").agg(F.count(F.lit(1)).alias("comps"), F.sum("n").alias("n"), F.max("n").alias("n_major"), F.max_by("comp", "n").alias("main"))
    return per.filter("comps > 1").select("key", "main", "n_major", (F.col("n") - F.col("n_major")).alias("n_minor"))


def _split(rows: DataFrame, buckets: DataFrame, bands: DataFrame, wide: int) -> DataFrame:
    """rows, those of wide buckets under two keys: the bucket's and each of the row's in
    `bands`. Two wide buckets make one key of both, not two."""
    is_wide = F.col("n_minor") > wide
    plain = rows.join(buckets.filter(~is_wide).select("key"), "key", "left_semi")
    crowded = rows.join(buckets.filter(is_wide).select("key"), "key").groupBy("node").agg(F.min("comp").alias("comp"), F.collect_list("key").alias("wide"))
    both = crowded.join(bands, "node").select("node", "comp", "wide", "bands", F.explode("wide").alias("first"))
    both = both.select("node", "comp", "wide", "first", F.explode("bands").alias("second"))
    both = both.filter((F.col("first") < F.col("second")) | ((F.col("first") > F.col("second")) & ~F.array_contains("wide", F.col("second"))))
    return plain.select("key", "node", "comp").union(both.select(F.xxhash64("first", "second").alias("key"), "node", "comp"))


def _prefixes(sets: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """node, bands: the shingles of which two sets of these nodes share one if they reach the
    similarity. Of m shingles they have percent * m / 100 or more in common; so, in any one
    order of all shingles, the first that they share is among the others and the next one of
    each. The rarest come first; those that only one set has are counted and left out."""
    mine = sets.join(nodes, "node", "left_semi").withColumn("own", F.xxhash64("shingles")).dropDuplicates(["node", "own"])
    each = mine.select("node", "own", F.size("shingles").alias("m"), F.explode("shingles").alias("s"))
    shared = each.groupBy("s").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    found = each.join(shared, "s").groupBy("node", "own", "m").agg(F.sort_array(F.collect_list(F.struct("n", "s"))).alias("found"))
    first = F.expr(f"(100 - {percent}) * m div 100 + 1 - (m - size(found))").cast("int")
    keys = found.withColumn("first", first).filter("first > 0").select("node", F.slice("found", 1, F.col("first")).getField("s").alias("keys"))
    return keys.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("keys"))).alias("bands"))


def _tasks(members: DataFrame, comps: DataFrame, spread: DataFrame, bands: DataFrame, wide: int) -> DataFrame:
    """The rows to compare, with their task (key, i, j) and its side.

    members: key, node. The rows of a bucket's largest component are only compared with
    the others; both kinds are cut into blocks of about BLOCK rows.
    """
    rows = members.select("key", "node").join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    rows = materialize(rows.select("key", "node", "comp"), "bucket-rows")
    buckets = materialize(_open_buckets(rows), "open-buckets")
    if not buckets.filter(F.col("n_minor") > wide).isEmpty():
        rows = materialize(_split(rows, buckets, bands, wide), "split-rows")
        buckets = materialize(_open_buckets(rows), "split-buckets")
    rows = rows.join(buckets, "key").withColumns(
        {
            "minor": F.col("comp") != F.col("main"),
            "mb": F.ceil(F.col("n_minor") / BLOCK).cast("int"),
            "jb": F.ceil(F.col("n_major") / BLOCK).cast("int"),
            "h": F.xxhash64("node"),
        }
    )
    rows = materialize(rows.join(spread, "node"), "open-rows")
    # A task (i, j): minor block i against minor block j (j < mb) or major block j - mb.
    minor = rows.filter("minor").withColumn("own", F.pmod("h", "mb").cast("int"))
    left = minor.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("mb") + F.col("jb") - 1))).withColumn("i", F.col("own"))
    right = minor.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("mb") - 1))).withColumn("j", F.col("own"))
    major = rows.filter(~F.col("minor")).withColumn("j", F.col("mb") + F.pmod("h", "jb").cast("int")).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("mb") - 1)))
    cols = ["key", "i", "j", "node", "comp", "n_shingles", "sketch", "map"]
    yes, no = F.lit(True), F.lit(False)
    return (
        left.select(*cols, yes.alias("in_left"), no.alias("in_right"))
        .union(right.select(*cols, no.alias("in_left"), yes.alias("in_right")))
        .union(major.select(*cols, no.alias("in_left"), yes.alias("in_right")))
    )


def _across(members: DataFrame, comps: DataFrame, spread: DataFrame, bands: DataFrame, best_only: bool, percent: int, wide: int) -> DataFrame:
    """Candidate pairs inside buckets between different components."""
    work = _tasks(members, comps, spread, bands, wide)
    groups = max(64, work.count() // GROUP_ROWS)
    task = F.pmod(F.xxhash64("key", "i", "j"), F.lit(groups)).alias("task")
    return work.groupBy(task).applyInArrow(_compare(best_only, percent), "a bigint, b bigint").distinct()


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text", wide: int = WIDE) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id and kept.

    The bands and the sketch limit are made for PERCENT; lower similarities raise."""
    if percent < PERCENT:
        raise ValueError(f"percent must be {PERCENT} or more: bands and sketches would miss less similar pairs")
    plain = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    sig = materialize(
        plain.mapInArrow(_signer(shingle), "doc_id bigint, norm binary, n_shingles bigint, bands array<bigint>, sketch array<bigint>, map binary"), "signatures"
    )
    # Classes of equal word sequences, represented by their smallest doc_id.
    first = sig.filter("norm is not null").groupBy("norm").agg(F.min(F.struct("doc_id", "n_shingles", "bands", "sketch", "map")).alias("f"), F.count(F.lit(1)).alias("copies"))
    classes = materialize(first.select("norm", F.col("f.doc_id").alias("node"), "copies", "f.n_shingles", "f.bands", "f.sketch", "f.map"), "classes")
    banded = classes.select("node", "copies", F.explode("bands").alias("key"))
    buckets = banded.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max_by("node", "copies").alias("hub"), F.max("copies").alias("hub_copies"))
    members = materialize(banded.join(buckets.filter("n > 1"), "key").select("key", "node", "hub", "hub_copies"), "bucket-members")
    nodes = members.select("node").distinct()
    sets = materialize(plain.join(nodes, plain.doc_id == nodes.node, "left_semi").mapInArrow(_setter(shingle), "node bigint, shingles array<bigint>"), "shingles")
    spread = classes.select("node", "n_shingles", "sketch", "map")

    hubs = members.filter("node <> hub").groupBy("node").agg(F.max_by("hub", "hub_copies").alias("b")).select(F.col("node").alias("a"), "b")
    small = classes.select("node", "sketch")
    odd = hubs.join(small.toDF("a", "ka"), "a").join(small.toDF("b", "kb"), "b").filter(_sketch_distance("ka", "kb") <= SKETCH_LIMIT).select("a", "b")
    links = materialize(_confirm(odd, sets, percent), "links-hub")
    comps = materialize(components(links), "components")
    large = members.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > wide)
    prefixes = _prefixes(sets, members.join(large, "key", "left_semi").select("node").distinct(), percent)  # read where a bucket is wide
    for best_only in (True, False):
        pairs = _across(members, comps, spread, prefixes, best_only, percent, wide)
        more = materialize(_confirm(pairs, sets, percent), "links-more")
        links = links.union(more)
        if not more.isEmpty():
            comps = materialize(components(links), "components")
    drop_table(sets)

    of_class = classes.select("norm", "node").join(comps, "node", "left").select("norm", F.coalesce("comp", "node").alias("component_id"))
    return (
        sig.select("doc_id", "n_shingles", "norm")
        .join(of_class, "norm", "left")
        .select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )


def _sketch_distance(a: str, b: str):
    """Differing bits of two sketches."""
    bits = F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    return F.aggregate(bits, F.lit(0), lambda n, x: n + x)


def op3_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), shingle=2, percent=80)
