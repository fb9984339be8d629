"""Sharding, line quality, license scans and fingerprints."""

import hashlib
import random
import re
import textwrap
import zlib

import numpy as np
import pytest
from tests.conftest import same
from silkpage.llm import fingerprint as P
from silkpage.llm import license_scan as L
from silkpage.llm import line_quality as Q
from silkpage.llm import sharding as S
from pyspark.sql import functions as F


def test_op1(spark, sf):
    got = S.op1_sharding(spark, sf).toPandas()
    docs = spark.read.parquet(f"{sf}/documents.parquet").toPandas().set_index("doc_id").text
    assert len(got) == len(docs) and set(got["law"]) == {"key"} and got["shard"].between(0, 39).all()
    for r in got.itertuples():
        t = docs[r.doc_id].encode()
        assert (r.size, r.text_crc32) == (len(t) + 16, zlib.crc32(t))
    moved = got[got["shard"] != got.grown_shard]
    assert (moved.grown_shard == 40).all() and 0 < len(moved) < len(got) / 10
    for _, g in got.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))


def test_weights(spark):
    ids = spark.range(20_000)
    got = S.assign(ids, "id", [1.0, 3.0, 4.0]).groupBy("shard").count().collect()
    share = {r["shard"]: r["count"] / 20_000 for r in got}
    assert all(abs(share[k] - w) < 0.02 for k, w in enumerate((0.125, 0.375, 0.5)))
    with pytest.raises(ValueError):
        S.assign(ids, "id", [1.0, 0.0])


def test_sharding_edges(edge, nothing):
    placed = S.with_slots(S.assign(edge, "doc_id", [1.0] * 4), "shard", ["doc_id", "text"], buckets=8)
    rows = placed.collect()
    assert len(rows) == edge.count() and len({r["shard"] for r in rows if r.doc_id == 6}) == 1
    by = {}
    for r in rows:
        by.setdefault(r["shard"], []).append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    assert S.with_slots(S.assign(nothing, "doc_id", [1.0] * 4), "shard", ["doc_id"]).count() == 0


def test_op2_sql(spark, sf, oracle):
    same(Q.op2_line_quality(spark, sf).toPandas(), oracle.sql(Q.SQL_OP2).df())


def brute_repeats(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    seen, covered = {}, set()
    for i in range(len(w) - 2):
        seen.setdefault(tuple(w[i : i + 3]), []).append(i)
    for at in seen.values():
        if len(at) > 1:
            covered |= {i + k for i in at for k in range(3)}
    return len(w), len(covered)


def test_op2_edges(spark, edge, nothing):
    long = "\n".join(" ".join(f"w{(i * 7 + j) % 90}" for j in range(9)) for i in range(60))  # many repeated windows
    extra = spark.createDataFrame([(100, long)], "doc_id bigint, text string")
    for df in (edge, extra):
        for r in Q.clean_lines(df).select("text", "n_words", "n_repeat_words", "kept", "clean_text", "n_lines_removed").collect():
            assert (r.n_words, r.n_repeat_words) == brute_repeats(r.text)
            if r.text is None:
                assert r.clean_text == "" and not r.kept
    one = Q.clean_lines(edge.filter("doc_id = 17")).first()
    assert one.clean_text == "Good line here." and one.n_lines_removed == 2
    assert Q.clean_lines(nothing).count() == 0


def pieces(t):
    out = set()
    for p in re.split(P.SENTENCES, t):
        p = p.strip(" ")
        out |= {p} if len(p) <= P.LONG else {m[0].strip(" ") for m in re.finditer(P.PARTS, p)}
    return out - {""}


def likeness(a, b):
    a, b = pieces(a), pieces(b)
    return 1.0 if not a | b else len(a & b) / len(a | b)


def test_op8(spark, sf):
    got = P.op8_fingerprint(spark, sf).toPandas().sort_values("doc_id", ascending=False)
    texts = list(spark.read.parquet(f"{sf}/documents.parquet").toPandas().sort_values("doc_id", ascending=False).text)
    prints = {}
    for i, r in enumerate(got.itertuples()):
        t, nxt = texts[i], texts[(i + 1) % len(texts)]
        k = len(t) // 3
        edited = t[: len(t) - k] + nxt[:k]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert abs(r.near_edited - likeness(t, edited)) < 1e-9 and abs(r.near_next - likeness(t, nxt)) < 1e-9
        assert prints.setdefault(t, r.fingerprint) == r.fingerprint


def test_next_and_edges(spark, edge, nothing):
    rows = P.with_next(edge, slices=16).collect()
    assert len(rows) == edge.count()
    key = lambda r: (r.doc_id is not None, r.doc_id or 0)
    ids = sorted({key(r) for r in rows}, reverse=True)
    first_of = {k: sorted((r.text is not None, r.text or "") for r in rows if key(r) == k)[0][1] for k in ids}
    for a, b in zip(ids, [*ids[1:], ids[0]], strict=True):
        assert any((r.next_text or "") == first_of[b] for r in rows if key(r) == a)
    assert P.with_next(nothing).count() == 0
    alone = P.with_next(spark.createDataFrame([(1, "x")], "doc_id bigint, text string")).first()
    assert alone.next_text == "x"


def test_an_edit_leaves_the_rest_of_a_text_alike(spark):
    """One line of sentences, of other scripts' sentences, without any mark, without spaces."""
    rng = random.Random(4)
    word = lambda a: "".join(rng.choice(a) for _ in range(rng.randint(2, 7)))
    run = lambda n, a="abcdefgh": " ".join(word(a) for _ in range(n))
    kanji = "".join(map(chr, range(0x4E00, 0x4E40)))
    made = {
        "sentences": lambda: " ".join(run(9) + "." for _ in range(6)),
        "other marks": lambda: "。".join(word(kanji) * 3 for _ in range(9)),
        "no marks": lambda: run(300),
        "no spaces": lambda: "".join(word(kanji) for _ in range(600)),
        "astral": lambda: run(300, "😀😁😂😃😄abc"),
    }
    rows = []
    for name, make in made.items():
        t, other = make(), make()
        rows += [(name, t, t[: len(t) * 2 // 3] + other[: len(t) // 3]), (name + ", moved", t, "new words " + t)]
    df = spark.createDataFrame(rows, "name string, a string, b string").withColumns({"da": P.digests(F.col("a")), "db": P.digests(F.col("b"))})
    for r in df.collect():
        a, b = set(r.da), set(r.db)
        assert len(a & b) / len(a | b) == likeness(r.a, r.b) and likeness(r.a, r.b) > 0.3, r.name
        assert "".join(re.split(P.SENTENCES, r.a)) == r.a == "".join(m[0] for m in re.finditer(P.PARTS, r.a))


def test_retries_with_more_and_more_blocks(spark):
    a, b = "\n".join(f"line {i} of a" for i in range(900)), "\n".join(f"line {i} of b" for i in range(900)) + "\nshared"
    df = spark.createDataFrame([(a, b), (a, a), ("", "x"), ("", "")], "a string, b string")
    df = df.withColumns({"da": P.digests(F.col("a")), "db": P.digests(F.col("b"))})
    got = [r.l for r in P.with_likeness(P.with_sketch(df, "da", "db"), "da", "db", "l").select("l").collect()]
    assert got == [likeness(a, b), 1.0, 0.0, 1.0]


def test_op5(spark, sf):
    lines = {"cc-by-nc": "Licensed under CC BY-NC 4.0.", "gpl": "GNU General Public License, version 3", "apache": "Apache License, Version 2", "mit": "MIT License", "proprietary": "All rights reserved"}
    texts = spark.read.parquet(f"{sf}/documents.parquet").toPandas().set_index("doc_id").text
    for r in L.op5_license_scan(spark, sf).collect():
        assert r.licenses == ",".join(sorted(k for k, v in lines.items() if v in texts[r.doc_id]))


def test_license_edges(spark, edge, nothing, docs):
    model = L.train(docs)
    got = {(r.doc_id, r.text): r.license_hits for r in L.scan(edge, model).collect()}
    assert {h.family for h in got[(19, "Licensed under the Apache License, Version 2.0.")] if h.confirmed} == {"apache"}
    assert got[(0, None)] is None and L.scan(nothing, model).count() == 0
    unseen = [
        ("This file is licensed under the GNU Lesser General Public License", "lgpl"), ("Code is available, licensed under the MIT License. See LICENSE.", "mit"),
        ("You must have a license to drive in this state.", None), ("My rights were reserved by all of them.", None),
    ]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(unseen)], "doc_id bigint, text string")
    for r in L.scan(df, model).orderBy("doc_id").collect():
        sure = {h.family for h in r.license_hits or [] if h.confirmed}
        assert sure == ({unseen[r.doc_id][1]} if unseen[r.doc_id][1] else set())


def test_frequent_license_lines_keep_their_features(spark):
    """Wordings without cue words, whole and wrapped, in every other text of the corpus."""
    free = {"cc0": L.WORDINGS["cc0"][1:], "unlicense": L.WORDINGS["unlicense"]}
    assert not any(re.search(L.CUES, s) for ss in free.values() for s in ss)
    rng = random.Random(3)
    plain = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(9))
    wrapped = [line for ss in L.WORDINGS.values() for s in ss for width in (40, 60, 72) for line in textwrap.wrap(s, width)]
    texts = [f"{plain()}\n{rng.choice([s for ss in free.values() for s in ss])} {plain().split()[0]}\n{rng.choice(wrapped)}" if k % 2 else plain() for k in range(600)]
    model = L.train(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"))
    asked = [(name, s) for name, ss in L.WORDINGS.items() for s in ss]
    df = spark.createDataFrame([(i, f"{plain()}\n{s}\n{plain()}") for i, (_, s) in enumerate(asked)], "doc_id bigint, text string")
    for r in L.scan(df, model).collect():
        assert asked[r.doc_id][0] in {h.family for h in r.license_hits or [] if h.confirmed}, asked[r.doc_id]


def test_no_python_in_native_plans(spark, sf):
    for f in (S.op1_sharding, Q.op2_line_quality, P.op8_fingerprint, L.op5_license_scan):
        plan = f(spark, sf)._jdf.queryExecution().toString()
        assert not re.search("Python|Pandas|Arrow", plan)


def test_softmax_is_calibrated_on_kept_out_wordings(docs):
    model = L.train(docs)
    assert model["held_out_loss"] < 0.9 and np.isfinite(model["temperature"])
    assert model["held_out_unknown"] > 0.5


def test_license_scan_against_a_plain_classifier(spark, docs):
    """The same judgement in plain Python: hashes by Spark, sums and comparisons by hand."""
    model = L.train(docs)
    rng = random.Random(5)
    lines = [s for ss in L.WORDINGS.values() for s in ss] + list(L.LOOKALIKES) + [" ".join(rng.sample("the mit license gnu public software is provided free copy code of warranty all rights".split(), 7)) for _ in range(60)]
    got = {r.i: r.license_hits for r in L.scan(spark.createDataFrame(list(enumerate(lines)), "i int, text string"), model).collect()}
    weights, n = dict(model["features"]), len(model["families"])
    for i, grams in enumerate(L._hashed(spark, lines)):
        found = [g for g in set(grams) if g in weights]
        if not found:
            assert not got[i]
            continue
        z = np.array(model["intercepts"]) + sum(np.array(weights[g]) for g in found)
        e = np.exp((z - z.max()) / model["temperature"])
        best, p = int(z.argmax()), 1 / e.sum()
        sure = best != n - 1 and p >= L.CONFIDENCE
        alike = max([len(set(g) & set(grams)) / max(1, min(len(set(g)), len(set(grams)))) for f, g in model["wordings"] if f == best], default=0.0)
        (hit,) = got[i]
        assert hit.family == (model["families"][best] if sure else L.UNKNOWN) and abs(hit.probability - p) < 1e-6
        assert hit.confirmed == (sure and alike >= L.SIMILARITY)
