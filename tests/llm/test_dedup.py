"""Near duplicates, components and repeated byte strings against brute force."""

import hashlib
import random
import sys

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from silkpage.llm import near_dup as N
from silkpage.llm import suffix_dedup as D
from silkpage.llm.components import components


def shingles(text, n):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()


def brute_components(rows, n, percent=80):
    sets = [(i, shingles(t, n)) for i, t in rows]
    parent = {i: i for i, _ in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            (i, s), (j, t) = sets[a], sets[b]
            if s and t and 100 * len(s & t) >= percent * len(s | t):
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    return [(i, len(s), root(i)) for i, s in sets]


@pytest.mark.parametrize("n", [2, 5])
def test_near_duplicates(spark, docs, n):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in N.near_duplicates(docs, shingle=n).collect())
    assert got == sorted(brute_components(rows, n))


def test_family_of_near_copies(spark):
    """A family in which links chain: components must join what no single hub links."""
    rng = random.Random(2)
    words = [f"w{i}" for i in range(120)]
    rows, text = [], list(words)
    for k in range(60):
        rows.append((k, " ".join(text)))
        text[rng.randrange(120)] = f"v{k}"
    rows += [(100 + k, " ".join(words)) for k in range(5)] + [(200, "unlike all the others"), (201, None), (202, "")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in N.near_duplicates(df, shingle=2).collect())
    assert got == sorted((i, n, c, i == c) for i, n, c in brute_components(rows, 2))


def test_wide_buckets_are_split(spark, docs):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in N.near_duplicates(docs, shingle=2, wide=0).collect())
    assert got == sorted(brute_components(rows, 2))


def test_wide_buckets_lose_no_pair_of_one_band(spark, monkeypatch):
    """Rows that have one band key in common and no other: the links are the same whether
    their bucket is split or not."""
    rng = random.Random(12)
    rows = []
    for _ in range(25):
        text = [f"w{rng.randrange(400)}" for _ in range(40)]
        for _ in range(rng.randint(1, 3)):
            rows.append((len(rows), " ".join(text)))
            text[rng.randrange(40)] = f"v{rng.randrange(400)}"
    rows += [(len(rows) + k, "the one with the most copies") for k in range(3)]
    signer = N._signer

    def one_band(shingle):
        sign = signer(shingle)

        def signed(batches):
            for b in sign(batches):
                ids = b.column("doc_id").to_pylist()
                bands = pa.array([[7, *range(1000 + 100 * i, 1039 + 100 * i)] for i in ids], pa.list_(pa.int64()))
                yield b.set_column(b.schema.get_field_index("bands"), "bands", bands)

        return signed

    monkeypatch.setattr(N, "_signer", one_band)
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    want = sorted(brute_components(rows, 2))
    assert len({c for _, _, c in want}) < len(rows) - 10
    for wide in (0, 10**6):
        assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in N.near_duplicates(df, shingle=2, wide=wide).collect()) == want


@pytest.mark.parametrize("per_group", [1, 4])
def test_compared_rows_of_one_band_key_grow_linearly(spark, per_group):
    """Unlinked classes that all share one band key; every per_group of them a second one."""

    def compared(n):
        nodes = spark.range(n).select(F.col("id").alias("node"))
        spread = nodes.select("node", F.lit(9).cast("long").alias("n_shingles"), F.array(F.lit(0).cast("long")).alias("sketch"), F.lit(b"").alias("map"))
        own = F.transform(F.sequence(F.lit(1), F.lit(38)), lambda b: F.xxhash64("node", b))
        bands = nodes.select("node", F.concat(F.array(F.lit(7).cast("long"), F.floor(F.col("node") / per_group) + 100), own).alias("bands"))
        none = spark.createDataFrame([], "node bigint, comp bigint")
        work = N._tasks(nodes.select(F.lit(7).cast("long").alias("key"), "node"), none, spread, bands, 1_000)
        return work.count()

    small, large = compared(5_000), compared(20_000)
    # Of four classes one is the main component: three in two left blocks each, three right, one major.
    assert small == {1: 0, 4: 10 * 5_000 // 4}[per_group] and large == 4 * small


def test_near_edges(edge, nothing):
    got = N.near_duplicates(edge, shingle=2).collect()
    assert len(got) == edge.count()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    assert by[5][0].component_id == 4 and {r.component_id for r in by[6]} == {6} and len(by[6]) == 3
    assert by[None][0].component_id is None and by[None][0].kept
    assert by[0][0].n_shingles == 0 and by[1][0].component_id == 1
    assert N.near_duplicates(nothing).count() == 0


def test_a_doc_id_of_several_texts_is_linked_by_any_of_them(spark):
    rng = random.Random(7)
    text = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(40))
    a, b, c = text(), text(), text()
    rows = [(1, a), (1, b), (2, b + " more"), (3, a + " more"), (4, c), (0, c + " more"), (5, text())]
    got = {(r.doc_id, r.component_id) for r in N.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), shingle=2).collect()}
    assert got == {(1, 1), (2, 1), (3, 1), (4, 0), (0, 0), (5, 5)}


@pytest.mark.parametrize("percent", [0, 50, 79])
def test_percent_outside_the_bounds_is_refused(edge, percent):
    with pytest.raises(ValueError):
        N.near_duplicates(edge, percent=percent)


def test_odd_sketch_bounds():
    rng = np.random.default_rng(1)
    for n in (40, 400, 5000):
        a = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
        b = np.concatenate([a[: int(n * 0.9)], rng.integers(0, 2**64, n // 10, dtype=np.uint64)])
        maps = [N._parity(x & np.uint64(N._set_bits(len(x)) - 1), N._set_bits(len(x))).view(np.uint64) for x in (a, b)]
        size = min(map(len, maps))
        differ = np.bitwise_count(N._fold(maps[0], size) ^ N._fold(maps[1], size)).sum()
        assert differ <= len(np.setxor1d(a, b))
        mul, add = N._permutations()
        both = [N._min_hashes(np.sort(x), mul, add) for x in (a, b)]
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        assert abs((both[0] == both[1]).mean() - true) < 0.12


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(0, 40)] + [(1000, k) for k in range(2000, 2080)] + [(rng.randrange(5000, 5200), rng.randrange(5000, 5200)) for _ in range(150)] + [(7, 7)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    got = {r.node: r.comp for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {x: root(x) for x in parent}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def brute_spans(rows, length=50):
    first = {}
    for i, t in sorted((i, t) for i, t in rows if i is not None):
        b = (t or "").encode()
        for p in range(len(b) - length + 1):
            first.setdefault(b[p : p + length], i)
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1) if i is not None else ():
            if first.get(b[p : p + length], i) < i:
                gone[p : p + length] = b"\1" * length
        runs = sum(1 for k in range(len(b)) if gone[k] and (not k or not gone[k - 1]))
        out.append((i, len(b), sum(gone), runs, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return sorted(out, key=str)


def test_op6(spark, sf, docs):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in D.op6_suffix_dedup(spark, sf).collect()), key=str)
    assert got == brute_spans(rows)


def test_hot_minimizers_are_split(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdef") for _ in range(rng.randint(1, 6)))
    passage = " ".join(word() for _ in range(25))
    rows = [(k, " ".join(word() for _ in range(rng.randint(0, 20))) + passage[rng.randrange(8) :] + word()) for k in range(80)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    for hot in (0, 1, 10**6):
        got = sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in D.remove_repeats(df, hot=hot).collect()), key=str)
        assert got == brute_spans(rows)


def test_every_string_has_its_minimizer():
    rng = np.random.default_rng(8)
    for letters in (2, 20):
        text = rng.integers(97, 97 + letters, 3_000).astype(np.uint8)
        ends = np.repeat([1_300, 1_340, 3_000], [1_300, 40, 1_660])
        hasher = D.Hasher()
        hasher.load(text)
        p, lo, strings = D.minimizers(hasher, text, ends, 50, 20)
        owned = np.concatenate([np.arange(a, a + n) for a, n in zip(lo.tolist(), strings.tolist(), strict=True)])
        at = np.arange(len(text))
        assert (np.unique(owned) == at[ends - at >= 50]).all()
        assert (lo <= p).all() and (p + 20 <= lo + 50).all() and (strings <= 31).all()
        assert letters == 2 or len(owned) == len(np.unique(owned))


def test_crowds_do_not_grow_with_the_input():
    """A common minimizer is split the same way at 0.5, 6 and 30 GB, and repeats within one
    document are no crowd: each hot occurrence is cut into its strings."""
    assert min(D._crowd(n * 10**8, D.HOT) for n in (5, 60, 300, 10**5)) >= D.CROWD
    line = "a line that one document has very often, word for word. "
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2], pa.int64()), pa.array([5, 6], pa.int64()), pa.array([line * 200, "other " + line])], ["doc_id", "fp", "text"])
    assert not any(b.column("hot")[0].as_py() for b in D._gather(64, 50, 20, 20)(iter([batch])))


def test_pipeline_stage_at_6_gb_splits_only_what_is_common():
    """A sentence that 40 documents of one chunk share goes through blocks, however large the
    input of the stage is."""
    rng = random.Random(13)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9)))
    sentence = " ".join(word() for _ in range(12))
    texts = [" ".join([*(word() for _ in range(12)), sentence, *(word() for _ in range(12))]) for _ in range(40)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(40), pa.int64()), pa.array(range(40), pa.int64()), pa.array(texts)], ["doc_id", "fp", "text"])
    for limit, hot in ((10, True), (D._crowd(6 * 10**9, D.HOT), False), (D._crowd(30 * 10**9, D.HOT), False)):
        assert any(b.column("hot")[0].as_py() for b in D._gather(64, 50, 20, limit)(iter([batch]))) == hot


def test_cost_of_a_stage_does_not_grow_with_buckets_and_parts():
    """Chunks times buckets and buckets times parts grow with the square of the input: neither
    may cost a Python call each."""
    rng = random.Random(14)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9)))
    shared = [" ".join(word() for _ in range(12)) for _ in range(30)]
    texts = [" ".join(x for _ in range(12) for x in (word(), rng.choice(shared))) for _ in range(300)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(300), pa.int64()), pa.array(range(300), pa.int64()), pa.array(texts)], ["doc_id", "fp", "text"])

    def calls(f):
        n = 0

        def count(frame, event, arg):
            nonlocal n
            n += event == "call"

        sys.setprofile(count)
        try:
            out = f()
        finally:
            sys.setprofile(None)
        return n, out

    few, _ = calls(lambda: list(D._gather(64, 50, 20, 64)(iter([batch]))))
    many, out = calls(lambda: list(D._gather(4_000, 50, 20, 64)(iter([batch]))))
    assert sum(b.num_rows for b in out) > 2_000 and many < 1.2 * few
    group = pa.Table.from_batches(D._gather(1, 50, 20, 64)(iter([batch])))
    meet = lambda parts: D._meet(parts, 50, 20, D.HOT)((pa.scalar(0, pa.int32()),), group)
    few, _ = calls(lambda: meet(7))
    many, out = calls(lambda: meet(5_003))
    assert out.num_rows > 400 and many < 1.2 * few


def test_packed_cells():
    rng = np.random.default_rng(15)
    for docs in ((0, 1), (-(2**63), 2**63 - 1), (5, 5 + 2**20)):
        cells = np.sort(rng.integers(0, 9, 200))
        doc = rng.integers(*docs, 200, endpoint=True)
        others = [rng.integers(0, 2**bits, 200, dtype=np.uint64) for bits in (32, 1, 63)]
        first, packed = D.pack(cells, doc, *others)
        small = D.pack(np.zeros(1, np.int64), np.array([3]), *np.zeros((3, 1), np.uint64))[1]
        both = pa.concat_tables([pa.table(packed), pa.table(small)])
        got = D.unpack(both, 4)
        assert len(first) == len(np.unique(cells))
        for x, y, extra in zip(got, (doc, *others), (3, 0, 0, 0), strict=True):
            assert (x == np.r_[np.array([extra], x.dtype), y.astype(x.dtype)]).all()


def test_op6_edges(edge, nothing):
    rows = [(r.doc_id, r.text) for r in edge.collect()]
    out = D.remove_repeats(edge, keep=["lang"]).collect()
    got = sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in out), key=str)
    assert got == brute_spans(rows)
    assert all(r.kept_text is not None for r in out if r.doc_id != 0) and D.remove_repeats(nothing).count() == 0


def test_periodic_and_shared_texts(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("äbcdé") for _ in range(rng.randint(1, 6)))
    passages = [" ".join(word() for _ in range(30)) for _ in range(4)]
    rows = [(k, " ".join(rng.choice(passages) if rng.random() < 0.4 else word() for _ in range(rng.randint(1, 30)))) for k in range(60)]
    rows += [(100 + k, ("ab" * 40)[k : 60 + k]) for k in range(6)] + [(200, "z" * 500), (201, "z" * 49), (202, "z" * 50), (203, "y" + "z" * 60)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in D.remove_repeats(df).collect()), key=str)
    assert got == brute_spans(rows)


def test_repeat_groups_are_the_maximal_repeats():
    rng = random.Random(6)
    for _ in range(150):
        strings = [bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 14))) for _ in range(rng.randint(1, 5))]
        subs = {}
        for i, s in enumerate(strings):
            for a in range(len(s)):
                for b in range(a + 3, len(s) + 1):
                    subs.setdefault(s[a:b], []).append((i, a))
        want = set()
        for u, at in subs.items():
            left = {strings[i][a - 1] if a else ("start", i) for i, a in at}
            right = {strings[i][a + len(u)] if a + len(u) < len(strings[i]) else ("end", i) for i, a in at}
            if len(at) > 1 and len(left) > 1 and len(right) > 1:
                want.add((len(u), tuple(sorted(at))))
        assert {(n, tuple(sorted(zip(w.tolist(), o.tolist(), strict=True)))) for n, w, o in D.repeat_groups(strings, 3)} == want
