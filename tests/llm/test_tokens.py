"""BPE, token files, mixing, toxicity and the pipeline."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from silkpage.llm import bpe as B
from silkpage.llm import mixing as M
from silkpage.llm import token_file as T
from silkpage.llm import toxicity as X
from pyspark.sql import functions as F

tokenizers = pytest.importorskip("tokenizers")
PATH = B.vocabulary_path()
LIBRARY = tokenizers.Tokenizer.from_file(PATH)
BODY = open(PATH, encoding="utf-8").read()
VOCABULARY = B.Vocabulary(BODY)
LEXICON = B.Transducer.compile((w, VOCABULARY.merge(w)) for w in sorted({w.encode() for w in "the of and in été über don t".split()}))
CODEC = B.Codec(VOCABULARY, B.in_memory_map(LEXICON))
ODD = "aBc déÉ'stSRE 12３ \n\t\x0b\x1c\x1f\x85\xa0　Σσςİıß́̈ｆ한国日😀👍🏽‍!?*-_<|>.,\r\x00ﬁǅ٣क्षि"


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from([*ODD, "'s", "'LL", "<|endoftext|>", "<|startoftext|>", "the ", "été"]), max_size=16))
def test_encodes_as_the_library(parts):
    s = "".join(parts)
    ids = LIBRARY.encode(s, add_special_tokens=False).ids
    assert CODEC.encode(s) == ids
    assert CODEC.decode(ids) == LIBRARY.decode(ids, skip_special_tokens=False)
    got, n = ENCODER(pa.array(["x", s, None, s]), 1)
    assert got.tolist() == [*expect("x"), 1, *ids, 1, 1, *ids, 1] and n.tolist() == [2, len(ids) + 1, 1, len(ids) + 1]


ENCODER = T.PieceEncoder(BODY)


def test_transducer_is_minimal_and_exact():
    words = sorted({f"{a}{b}{c}".encode() for a in "abc" for b in ("x", "yy", "") for c in ("ing", "ed", "s")})
    t = B.in_memory_map(B.Transducer.compile((w, [k, k + 1]) for k, w in enumerate(words)))
    assert t.numbers(words).tolist() == list(range(len(words)))
    assert [t.output(k) for k in range(len(words))] == [[k, k + 1] for k in range(len(words))]
    assert t.numbers([b"", b"ax", b"axings", b"zz", b"\xff"]).tolist() == [-1] * 5
    assert len(t.finals) < 14  # suffixes are shared
    empty = B.in_memory_map(B.Transducer.compile([]))
    assert empty.numbers([b"a"]).tolist() == [-1]


def test_misra_gries_keeps_frequent(monkeypatch):
    monkeypatch.setattr(B, "COUNTERS", 3)
    assert set(B._thin(B.Counter({"a": 9, "b": 7, "c": 5, "d": 2, "e": 1}))) == {"a", "b", "c"}


def expect(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


def test_op4(spark, edge, nothing, docs):
    for df in (edge, docs):
        texts = {}
        for r in df.select("doc_id", "text").collect():
            texts.setdefault(r.doc_id, []).append(expect(r.text))
        for r in B.encode_decode(df, PATH, with_ids=True).collect():
            ids = next(i for i in texts[r.doc_id] if i == list(r.ids))
            back = LIBRARY.decode(ids, skip_special_tokens=False)
            assert (r.n_tokens, r.decoded) == (len(ids), back)
            assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest() and r.decoded_sha256 == hashlib.sha256(back.encode()).hexdigest()
    assert B.encode_decode(nothing, PATH).count() == 0


@pytest.mark.parametrize("n", [0, 1, 127, 128, 129, 5000])
@pytest.mark.parametrize("top", [1, 2, 300, 49408, 2**32 - 1])
def test_blocks_round_trip(n, top):
    rng = np.random.default_rng(n)
    ids = rng.integers(0, top, n).astype(np.uint32)
    ids[rng.integers(0, max(1, n), n // 20)] = top - 1
    s = T.Segment(T.encode_blocks(ids))
    assert (s.all() == ids).all() and all((s.block(k) == ids[128 * k : 128 * k + 128]).all() for k in range(s.blocks))


def test_blocks_patch_outliers():
    ids = np.full(1280, 5, np.uint32)
    ids[::100] = 40000
    s = T.Segment(T.encode_blocks(ids))
    assert set(s.widths) == {0} and s.counts.sum() == 13 and (s.all() == ids).all()
    with pytest.raises(ValueError):
        T.Segment(b"nope" * 8)


def test_op7(spark, sf, docs, edge, nothing):
    rows = sorted((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect())
    got = sorted(tuple(r) for r in T.op7_token_file(spark, sf).collect())
    start, want = 0, []
    for i, t in rows:
        ids = [*expect(t), 1]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got == want
    ends = sorted((r.start, r.start + r.n_tokens) for r in T.read_tokens(T.write_tokens(edge, PATH)).collect())
    assert len(ends) == edge.count() and ends[0][0] == 0 and all(a[1] == b[0] for a, b in zip(ends, ends[1:], strict=False))
    assert T.read_tokens(T.write_tokens(nothing, PATH)).count() == 0


def test_small_segments(spark, docs, monkeypatch):
    want = sorted(tuple(r) for r in T.read_tokens(T.write_tokens(docs, PATH)).collect())
    tokens = T.write_tokens(docs.repartition(3), PATH)
    assert sorted(tuple(r) for r in T.read_tokens(tokens).collect()) == want


def test_water_filling():
    assert M.split(10, {"a": 1, "b": 1, "c": 2}, {"a": 1, "b": 9, "c": 9}) == {"a": 1, "b": 3.0, "c": 6.0}
    assert M.split(100, {"a": 1, "b": 0}, {"a": 5, "b": 5}) == {"a": 5, "b": 0.0}
    assert M.split(5, {}, {}) == {}


def test_siblings_before_ancestors():
    leaves = {("d", "en", "s1"): 10, ("d", "en", "s2"): 100, ("d", "de", "s1"): 100}
    got = M.plan(leaves, 80, {("d", "en"): 0.75, ("d", "de"): 0.25})
    assert got == {("d", "en", "s1"): 10, ("d", "en", "s2"): 50.0, ("d", "de", "s1"): 20.0}
    got = M.plan(leaves, 160, {("d", "en"): 0.9, ("d", "de"): 0.1})
    assert got[("d", "en", "s1")] + got[("d", "en", "s2")] == 110 and got[("d", "de", "s1")] == 50


def test_language_targets_hold_in_every_domain(spark):
    names = ["src1", "web7", "books", None]
    leaves = {(d, k, d): 1000.0 for d in names for k in M.LANG_WEIGHTS}
    got = M.plan(leaves, 400, M.lang_weights())
    assert all(abs(got[(d, k, d)] - 100 * w) < 1e-6 for d in names for k, w in M.LANG_WEIGHTS.items())
    assert M.plan(leaves, 400, M.lang_weights() | {("books", "en"): 0.0})[("books", "en", "books")] == 0
    rows = [(i, "one two three four", k, d) for i, (d, k) in enumerate((d, k) for d in names for k in M.LANG_WEIGHTS for _ in range(100))]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    taken = {}
    for r in M.mix(df, budget_share=0.25, weights=M.lang_weights(), max_epochs=1).collect():
        taken[(r.source, r.lang)] = taken.get((r.source, r.lang), 0) + r["__copies"]
    assert taken == {(d, k): round(100 * w) for d in names for k, w in M.LANG_WEIGHTS.items()}


def brute_mix(rows, budgets, seed_order, epochs):
    """Copies of each document, leaf by leaf, in the seeded order."""
    out = {}
    for leaf, budget in budgets.items():
        mine = [r for r in rows if r[1] == leaf]
        total = sum(r[2] for r in mine)
        full = min(int(budget // total), epochs) if total else 0
        rest = int(round(budget - full * total)) if full < epochs else 0
        used = 0
        for r in sorted(mine, key=lambda r: seed_order[(r[0], full)]):
            out[r[0]] = full + (1 if rest > 0 and used < rest else 0)
            used += r[2]
    return {k: v for k, v in out.items() if v}


def test_op9_against_brute_force(spark, docs):
    rows = [(r.doc_id, (re.sub(r"\d$", "", r.source), r.lang, r.source), len(r.text.split())) for r in docs.collect()]
    have = {}
    for _, leaf, n in rows:
        have[leaf] = have.get(leaf, 0) + n
    budgets = M.plan({k: 2 * v for k, v in have.items()}, M.SHARE * sum(have.values()), M.target_weights())
    assert len({leaf[0] for leaf in have}) > 1 and any(budgets[k] > 1.999 * v for k, v in have.items())  # several domains, a leaf that runs short
    order = {}
    for e in range(3):
        for r in docs.select("doc_id", M._order(F.col("doc_id"), F.xxhash64("text"), F.lit(e), M.SEED).alias("o")).collect():
            order[(r.doc_id, e)] = (r.o, r.doc_id)
    got = {r.doc_id: r["__copies"] for r in M.mix(docs, weights=M.target_weights()).collect()}
    assert got == brute_mix(rows, budgets, order, 2)


def test_the_mix_does_not_depend_on_the_order_of_rows(spark):
    rng = random.Random(1)
    rows = [(k % 7, " ".join(rng.choice("abcd") for _ in range(rng.randint(1, 30))), "en", "src1") for k in range(60)]
    found = set()
    for _ in range(3):
        rng.shuffle(rows)
        mixed = M.mix(spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string"), budget_share=0.4, max_epochs=1).collect()
        found.add(tuple(sorted((r.doc_id, r.text) for r in mixed)))
    assert len(found) == 1


def test_mix_edges(edge, nothing):
    got = M.mix(edge, budget_share=1.0, max_epochs=1).collect()
    assert len(got) == edge.count()
    assert M.mix(nothing).count() == 0
    with pytest.raises(ValueError):
        M.mix(edge, max_leaves=1)


def test_op10(spark, docs, edge, nothing):
    rng = random.Random(8)
    bad = ["idiot", "scum", "moron", "pathetic"]
    rows, labels = [], []
    for k in range(900):
        ws = ["".join(rng.choice("abcdefg") for _ in range(rng.randint(2, 6))) for _ in range(60)]
        toxic = k % 5 == 0
        if toxic:
            for w in rng.sample(bad, 2):
                ws[rng.randrange(60)] = w
        if k % 20 == 0:
            ws[3] = "fliblek" + rng.choice(["a", "en", "o"])  # a stem only the labels tell of
            ws[9] = "fliblek" + rng.choice(["er", "is", "u"])
            toxic = True
        rows.append((k, " ".join(ws)))
        labels.append((k, int(toxic)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    lab = spark.createDataFrame(labels, "doc_id bigint, toxic int")
    model = X.fit(df, lab)
    got = {r.doc_id: r.score for r in X.score(df, model, ["doc_id"]).collect()}
    held = [k for k, _ in labels if zlib.crc32(str(k).encode()) % 5 == 0]
    right = sum((got[k] >= 0.5) == bool(labels[k][1]) for k in held)
    assert right / len(held) > 0.97
    scored = X.score(edge.drop("score"), model, ["doc_id"])
    assert scored.count() == edge.count() and scored.filter("score is null or score < 0 or score > 1").count() == 0
    assert X.score(nothing.drop("score"), model, ["doc_id"]).count() == 0
    none = X.fit(df, lab.filter("false"))
    ranked = {r.doc_id: r.score for r in X.score(df, none, ["doc_id"]).collect()}
    assert ranked[5] > 0.5 > ranked[1]


def test_shouting_counts_the_whole_text():
    for t in ("Ab" * 500, "aB" * 500, "ABc" * 500, "Abc" * 500, "ÄÖß" * 500, "äöÜ" * 500, ("Q" + "z" * 9) * 1000, "日本" * 500, "Ⅷ1 " * 500, "\ud800A" * 400):
        upper, letters = sum(map(str.isupper, t)), sum(map(str.isalpha, t))
        assert X.upper_and_letters(t) == (upper, letters)
        assert (X.STYLE[0] in X.style_features(t, [])) == (upper > 0.5 * letters > 0), t[:6]


def test_held_out_is_never_learned(spark):
    rows = [(k, "plain words here") for k in range(40)]
    lab = [(k, 1 if zlib.crc32(str(k).encode()) % 5 == 0 else 0) for k in range(40)]
    model = X.fit(spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(lab, "doc_id bigint, toxic int"))
    assert all(r.score < 0.5 for r in X.score(spark.createDataFrame(rows, "doc_id bigint, text string"), model, ["doc_id"]).collect())


def test_label_model_discounts_correlated_voters():
    rng = np.random.default_rng(0)
    y = rng.random(3000) < 0.2
    one = (rng.random(3000) < np.where(y, 0.6, 0.01)).astype(float)
    others = [(rng.random(3000) < np.where(y, 0.5, 0.02)).astype(float) for _ in range(3)]  # without labels, two kinds of votes alone tell nothing
    votes = np.stack([one, one, one, *others], axis=1)
    m = X.LabelModel()
    m.posterior(votes)
    assert m.correlations[0, 1] > 0.9 and m.correlations[0, 3] < 0.3 and (m.accuracies > 0.8).all()


def test_label_model_estimates_rates_without_labels():
    """Independent voters: their true rates are found from agreement alone."""
    rng = np.random.default_rng(2)
    y = rng.random(8000) < 0.15
    on1, on0 = np.array([0.5, 0.4, 0.6, 0.3, 0.5, 0.45]), np.array([0.002, 0.004, 0.001, 0.003, 0.002, 0.005])
    votes = (rng.random((8000, 6)) < np.where(y[:, None], on1, on0)).astype(float)
    m = X.LabelModel()
    p = m.posterior(votes)
    assert np.abs(m.on1 - on1).max() < 0.06 and np.abs(m.on0 - on0).max() < 0.02 and abs(m.prior - 0.15) < 0.02
    assert ((p > 0.5) == y).mean() > 0.97 and ((p > 0.5) != y).any()


def test_posteriors_are_not_the_labels_and_scores_are_the_model_s(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf}/{x}.parquet") for x in ("documents", "labels"))
    model = X.fit(docs, labels)
    assert 0 < model["differs"] < 0.1  # of some seventy labelled rows
    assert all(len({X.family(f) for f in fs}) == 1 for fs in model["voters"].values())
    weight = dict(zip(model["names"], model["weights"], strict=True))
    for r in X.op10_toxicity(spark, sf).join(docs.select("doc_id", "text"), "doc_id").collect():
        words = set(re.findall(r"[^\W\d_]+", (r.text or "").lower()))
        stems = {}
        for w in words:
            for f in [w, *[w[:n] + "~" for n in X.PREFIXES if len(w) >= n]]:
                stems[f] = stems.get(f, 0) + 1
        has = {f + (str(k) if k > 1 else "") for f, n in stems.items() for k in (1, 2, 3) if n >= k}
        has |= set(X.style_features(r.text or "", re.findall(r"[^\W\d_]+", (r.text or "").lower())))
        z = model["intercept"] + sum(w for f, w in weight.items() if f in has and abs(w) > 1e-6)
        assert abs(r.score - 1 / (1 + np.exp(-z))) < 1e-9 and r.predicted == int(r.score >= 0.5)


def test_pipeline_stages(spark, sf, docs):
    import corpus_pipeline as C

    cols = ["doc_id", "text", "lang", "source", "n_chars"]
    current = docs
    for k, (name, stage) in enumerate(C.STAGES):
        before = current.count()
        current = stage(spark, current, sf)
        assert name == ["toxicity", "near_dup", "suffix_dedup", "mixing", "bpe"][k]
        if k < 4:
            assert sorted(current.columns) == sorted(cols) and 0 < current.count() <= before
    ids = current.first()
    assert ids.n_tokens == len(ids.ids)
    assert C.run(spark, sf).count() == current.count()


def test_pipeline_on_edge_rows_and_nothing(spark, sf, edge, nothing):
    """Every stage takes nulls, empty and repeated texts, clashing columns and no rows."""
    import corpus_pipeline as C
    from silkpage.llm.common import materialize

    kept = {}
    for docs in (edge, nothing):
        current = docs
        for name, stage in C.STAGES:
            before = current.count()
            current = materialize(stage(spark, current, sf), f"edge-{name}")
            kept[name] = (before, current.count())
            assert kept[name][1] <= before
            if name != "bpe":
                assert sorted(current.columns) == ["doc_id", "lang", "n_chars", "source", "text"]
        if docs is edge:
            assert kept["near_dup"][1] < kept["near_dup"][0] and kept["bpe"][1] > 0
            assert all(r.n_tokens == len(r.ids) for r in current.collect())
    assert current.count() == 0
