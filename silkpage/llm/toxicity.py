"""Toxicity by weak supervision.

1. Features: a text's lower-cased words, word beginnings of PREFIXES letters (stems
   stay when endings change), and those that two or three different words begin with. From at most SAMPLE labelled rows outside the
   held-out fifth, the FEATURES of most evidence for either label are kept.
2. Voters: families of features that speak for toxicity (forms of one stem, at most
   VOTERS families), the fixed lexicon below and a pattern of insults. A voter votes or
   abstains. The labels choose the voters, and are used for nothing else.
3. A generative label model estimates from the votes alone, by expectation and
   maximisation, how often texts are toxic and how often each voter votes on toxic and on
   other texts: voters that agree beyond chance confirm each other. What they share beyond
   the hidden label (residual correlation) is measured, correlated votes are discounted,
   and the model is fitted again.
4. A logistic regression over the features learns the posterior labels. It alone scores.

Labels, lang, source and doc_id are no input of a score; every text is scored as a whole.

Defined cases: null and empty texts have no features and get the score of the
intercept; several labels of one doc_id count as toxic if one does; null labels are
ignored; without labelled rows of both kinds, or where no votes agree, the fixed lexicon
alone decides; repeated rows are scored each.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, tidy

#: Bounds of what the model is fitted on: labelled rows, features, voters.
SAMPLE, FEATURES, VOTERS = 15_000, 3_000, 150
PREFIXES = (4, 5, 6, 7, 8)
#: Share of toxic texts among those with a chosen feature or family, at least; what the label model
#: believes of it beforehand, and how much that weighs.
CHOSEN, RIGHT, BELIEF = 0.9, 0.9, 0.5
#: Remembered words of one Python worker; full, it starts anew.
MEMORY = 150_000
#: Common insults.
LEXICON = (
    "bastard", "clown", "creep", "disgusting", "dumb", "fool", "freak", "garbage", "idiot", "imbecile", "jerk", "loser",
    "moron", "pathetic", "pig", "retard", "scum", "stupid", "trash", "ugly", "useless", "vermin", "worthless",
)
STYLE = ("~shouting", "~exclaiming", "~insulting_you")
WORD = re.compile(r"[^\W\d_]+")
ASCII = bytes(range(128))
UPPER = bytes(range(65, 91))
LETTERS = UPPER + bytes(range(97, 123))


def word_features(word: str) -> list[str]:
    return [word, *[word[:n] + "~" for n in PREFIXES if len(word) >= n]]


def upper_and_letters(text: str) -> tuple[int, int]:
    """Upper-case characters and letters of the whole text; those of ASCII are counted as bytes."""
    raw = text.encode("utf-8", "surrogatepass")
    rest = raw.translate(None, ASCII).decode("utf-8", "surrogatepass")
    upper, letters = (len(raw) - len(raw.translate(None, kind)) for kind in (UPPER, LETTERS))
    return upper + sum(map(str.isupper, rest)), letters + sum(map(str.isalpha, rest))


def style_features(text: str, words: list[str]) -> list[str]:
    out = []
    if len(text) > 40:
        upper, letters = upper_and_letters(text)
        if upper > 0.5 * letters > 0:
            out.append(STYLE[0])
    if text.count("!") * 20 > len(words) > 0:
        out.append(STYLE[1])
    if re.search(r"\byou(?:'re| are)? (?:an? )?(?:" + "|".join(LEXICON) + r")\b", text, re.I):
        out.append(STYLE[2])
    return out


def held_out(doc_id: Column, folds: int = 5) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 0, F.lit(False))


class Features:
    """Numbers of the known features in a text."""

    def __init__(self, names: list[str]):
        self.at = {n: i for i, n in enumerate(names)}
        #: Features of words that are known themselves or as shared by several words.
        self.parts = {n.rstrip("23") for n in names}
        self.words: dict[str, tuple[int, ...]] = {}

    def _of_word(self, w: str) -> tuple[str, ...]:
        if len(self.words) > MEMORY:
            self.words.clear()
        got = self.words[w] = tuple([f for f in word_features(w) if f in self.parts])
        return got

    def __call__(self, text: str | None) -> list[int]:
        if not text:
            return []
        words = WORD.findall(text.lower())
        get, seen, at = self.words.get, {}, self.at
        for w in set(words):
            fs = get(w)
            if fs is None:
                fs = self._of_word(w)
            for f in fs:
                seen[f] = seen.get(f, 0) + 1
        names = [f"{f}{k}" if k > 1 else f for f, n in seen.items() for k in range(1, min(n, 3) + 1)]
        return sorted([at[f] for f in names + style_features(text, words) if f in at])


@tidy
def _all_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(feature, toxic) of every different feature of each labelled text."""
    for big in batches:
        for k in range(0, big.num_rows, 200):
            part = big.slice(k, 200)
            names, toxic = [], []
            for text, y in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                words = WORD.findall((text or "").lower())
                seen = Counter(f for w in set(words) for f in word_features(w))
                found = [f"{f}{k}" if k > 1 else f for f, n in seen.items() for k in range(1, min(n, 3) + 1)]
                found += style_features(text or "", words)
                names += found
                toxic += [y] * len(found)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(toxic, pa.int32())], ["feature", "toxic"])


def _known_features(names):
    @tidy
    def known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features(names.value)
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([features(t) for t in b.column(0).to_pylist()], pa.list_(pa.int32())), b.column(1)], ["found", "toxic"])

    return known


class LabelModel:
    """Hidden label, voters with a rate of voting for each label, discounts for correlated
    voters. No label is seen.

    An abstention says nothing; a vote counts by the logarithm of its two rates, divided
    among the correlated voters that vote on the same text. A chosen voter is believed to be
    right in RIGHT of its votes; that belief weighs BELIEF times what its votes show."""

    def __init__(self, rounds: int = 30):
        self.rounds = rounds

    def _fit(self, votes: np.ndarray, p: np.ndarray, same: np.ndarray) -> np.ndarray:
        share = votes / (1 + votes @ same)  # a vote's part in what its correlated voters say
        n = votes.sum(axis=0)
        for _ in range(self.rounds):
            n1 = p @ votes.any(axis=1)  # a text without votes is no sign of toxic ones
            n0 = len(p) - n1
            self.prior = min(0.5, (n1 + 1.0) / (len(p) + 2.0))
            right = (p @ votes + BELIEF * RIGHT * n) / (1 + BELIEF)
            self.on1, self.on0 = (right + 0.5) / (n1 + 1.0), (n - right + 0.5) / (n0 + 1.0)
            says = np.maximum(np.log(self.on1 / self.on0), 0)  # a voter votes for toxicity, or is no voter
            z = np.log(self.prior / (1 - self.prior)) + share @ says
            p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        return p

    @staticmethod
    def _correlated(rest: np.ndarray) -> np.ndarray:
        spread = rest.std(axis=0) + 1e-9
        out = (rest - rest.mean(axis=0)).T @ (rest - rest.mean(axis=0)) / len(rest) / np.outer(spread, spread)
        np.fill_diagonal(out, 0)
        return np.abs(out)

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """P(toxic) of each row of the 0/1 matrix of votes."""
        same = self._correlated(votes)
        p = self._fit(votes, np.where(votes.any(axis=1), RIGHT, 0.02), same * (same > 0.6))
        self.correlations = self._correlated(votes - (p[:, None] * self.on1 + (1 - p[:, None]) * self.on0))
        p = self._fit(votes, p, self.correlations * (self.correlations > 0.3))
        self.accuracies = self.prior * self.on1 + (1 - self.prior) * (1 - self.on0)
        return p


def _shown(bad: float, n: float) -> float:
    """Share of toxic texts that n texts, bad of them toxic, show: one clean one is added."""
    return float(bad) / (float(n) + 1.0)


def family(feature: str) -> str:
    """What the forms of one stem have in common: its first letters."""
    return feature if feature in STYLE else feature.rstrip("23").rstrip("~")[: PREFIXES[0]]


def logistic(found: list[list[int]], n_features: int, y: np.ndarray, steps: int = 400, rate: float = 0.05, l2: float = 3e-4) -> tuple[np.ndarray, float]:
    """Weights and intercept for soft labels; both kinds weigh the same."""
    row = np.repeat(np.arange(len(found)), [len(f) for f in found])
    col = np.fromiter((i for f in found for i in f), np.int64, len(row))
    weight = np.where(y > 0.5, 0.5 / max(1.0, (y > 0.5).sum()), 0.5 / max(1.0, (y <= 0.5).sum()))
    w, b = np.zeros(n_features), 0.0
    m, v, mb, vb = np.zeros(n_features), np.zeros(n_features), 0.0, 0.0
    for t in range(1, steps + 1):
        z = np.bincount(row, w[col], len(found)) + b
        err = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * weight
        g = np.bincount(col, err[row], n_features) + l2 * w
        gb = err.sum()
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        scale = rate * np.sqrt(1 - 0.999**t) / (1 - 0.9**t)
        w -= scale * m / (np.sqrt(v) + 1e-8)
        b -= scale * mb / (np.sqrt(vb) + 1e-8)
    return w, float(b)


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> dict:
    """The scoring model: names, weights, intercept; with the label model's estimates, and
    differs: the share of training rows whose posterior is not what their label says."""
    sc = docs.sparkSession.sparkContext
    usable = labels.filter(F.col("toxic").isNotNull() & F.col(doc_id).isNotNull() & ~held_out(F.col(doc_id)))
    one = usable.groupBy(F.col(doc_id).alias("__id")).agg(F.max(F.col("toxic").cast("int")).alias("__toxic"))
    chosen = one.orderBy(F.xxhash64("__id"), "__id").limit(sample)  # at most `sample` rows of 12 bytes: small enough to broadcast
    train = docs.select(F.col(doc_id).alias("__doc"), F.col(text).cast("string").alias("__text")).join(F.broadcast(chosen), F.col("__doc") == F.col("__id"))
    train = train.select("__text", "__toxic")
    counts = train.mapInArrow(_all_features, "feature string, toxic int").groupBy("feature").agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("bad"))
    kinds = {r["__toxic"]: r["count"] for r in train.groupBy("__toxic").count().collect()}
    n1, n0 = kinds.get(1, 0), kinds.get(0, 0)
    names, mined, voters = [*LEXICON, *STYLE], {}, {family(f): [f] for f in (*LEXICON, *STYLE[2:])}
    if n1 and n0:
        odds = F.ln(((F.col("bad") + 0.5) / (n1 + 1)) / ((F.col("n") - F.col("bad") + 0.5) / (n0 + 1)))
        best = counts.filter(F.col("n") >= 4).withColumn("odds", odds).withColumn("evidence", F.abs("odds") * F.sqrt("n"))
        rows = best.orderBy(F.desc("evidence"), "feature").limit(FEATURES).select("feature", "bad", "n").collect()
        names += [r.feature for r in rows if r.feature not in names]
        for r in rows:
            if _shown(r.bad, r.n) >= CHOSEN:
                mined.setdefault(family(r.feature), []).append(r.feature)
    rows = train.mapInArrow(_known_features(sc.broadcast(names)), "found array<int>, toxic int").collect()
    found, said = [r.found for r in rows], np.array([r.toxic for r in rows], float)
    at = {n: i for i, n in enumerate(names)}
    has = np.zeros((max(1, len(found)), len(names)), bool)
    for k, f in enumerate(found):
        has[k, f] = True
    for k in list(mined)[:VOTERS]:
        speaks = has[:, [at[f] for f in voters.get(k, [])]].any(axis=1)
        for f in mined[k]:  # forms of a stem join its voter as long as it stays as sure
            more = speaks | has[:, at[f]]
            if _shown(said @ more, more.sum()) >= CHOSEN:
                speaks = more
                voters.setdefault(k, []).append(f)
    votes = np.stack([has[:, [at[f] for f in fs]].any(axis=1) for fs in voters.values()], axis=1).astype(float)
    model = LabelModel()
    y = model.posterior(votes)[: len(found)]
    if len(found) and n1 and n0 and y.max(initial=0) > 0.5 > y.min(initial=1):
        weights, intercept = logistic(found, len(names), y)
    else:
        weights, intercept = np.array([4.0 if n in LEXICON or n == STYLE[2] else 0.0 for n in names]), -2.0
    differs = float(((y > 0.5) != (said > 0)).mean()) if len(found) else 0.0
    return {"names": names, "weights": weights, "intercept": intercept, "voters": voters, "differs": differs, "accuracies": getattr(model, "accuracies", None), "correlations": getattr(model, "correlations", None)}


def _scorer(model):
    @tidy
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, weights, intercept = model.value
        features = Features(names)
        for big in batches:
            for k in range(0, big.num_rows, 500):
                part = big.slice(k, 500)
                z = np.array([intercept + weights[f].sum() if (f := features(t)) else intercept for t in part.column(part.num_columns - 1).to_pylist()], np.float64)
                p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(p, pa.float64())], [*part.schema.names[:-1], "score"])

    return score


def score(docs: DataFrame, model: dict, keep: list[str], text: str = "text") -> DataFrame:
    """The columns `keep` of docs and score (0 to 1)."""
    sc = docs.sparkSession.sparkContext
    used = np.flatnonzero(np.abs(model["weights"]) > 1e-6)
    small = sc.broadcast(([model["names"][i] for i in used], model["weights"][used], model["intercept"]))
    named = docs.select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate(keep)], F.col(text).cast("string").alias("__text"))
    kinds = ", ".join(f"__k{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(keep))
    out = named.mapInArrow(_scorer(small), f"{kinds}, score double" if kinds else "score double")
    return out.withColumnsRenamed({f"__k{i}": c for i, c in enumerate(keep)})


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"))
    return score(docs, model, ["doc_id"]).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
