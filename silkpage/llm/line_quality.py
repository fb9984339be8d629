"""Line-first cleaning (native: DataFrame functions only).

Each line is judged on its own by three rules; failing lines are removed, and a
document that loses more than `max_lost_pct` of its words, or keeps fewer than
`min_words`, is rejected. Before that stand the base rules of the contract: too
few words, or too many words inside repeated three-word windows.

Line rules (a line without words is neutral and stays):
  punctuation  runs of marks instead of sentences: "!!" for every fifth word or
               more, or symbols [#*$%&<>] as many as a third of the words or more
  navigation   three or more | separators, making up at least one per six words,
               or a menu of at least three » or • items
  boilerplate  one of the fixed phrases below

Everything is one scan: arrays and higher-order functions inside the row, no
shuffle. Repeated windows are found by sorting (64-bit hash, position) pairs of
each text; only equal hashes of different words in the same text could count too
many (chance n^2 / 2^65 for n words).

Defined cases: a null text is an empty one, without words, and fails the base
rules; repeated rows are judged each; other columns are kept by clean_lines().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, words

SYMBOLS = "#*$%&|<>"
#: Phrases of page furniture, in lower case, of the corpus' four languages.
BOILERPLATE = (
    "all rights reserved",
    "accept cookies",
    "click here",
    "cookie policy",
    "enable javascript",
    "lorem ipsum",
    "privacy policy",
    "sign up for our newsletter",
    "terms of use",
    "use of cookies",
    "alle rechte vorbehalten",
    "cookies akzeptieren",
    "datenschutzbestimmungen",
    "hier klicken",
    "newsletter abonnieren",
    "accepter les cookies",
    "cliquez ici",
    "mentions légales",
    "tous droits réservés",
    "aceptar cookies",
    "haga clic aquí",
    "política de privacidad",
    "todos los derechos reservados",
)
MIN_WORDS = 50
MAX_REPEAT_PCT = 50
MAX_LOST_PCT = 30


def _hashed(ws: Column) -> Column:
    """The 64-bit hashes of the three-word windows, in order."""
    n = F.size(ws)
    none = F.array().cast("array<bigint>")
    win = F.transform(F.sequence(F.lit(0), F.greatest(n - 3, F.lit(0))), lambda i: F.xxhash64(F.get(ws, i), F.get(ws, i + 1), F.get(ws, i + 2)))
    return F.when(n < 3, none).otherwise(win)


def _repeated_at(h: Column, s: Column) -> Column:
    """Ascending positions of repeated windows; h: hashes, s: h sorted."""
    pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    again = F.zip_with(pairs, F.transform(s, lambda x, k: (x == F.get(s, k - 1)) | (x == F.get(s, k + 1))), lambda p, a: F.when(a, p.getField("i")))
    return F.sort_array(F.filter(again, lambda i: i.isNotNull()))


def _covered(at: Column) -> Column:
    """Words inside the windows at these ascending positions."""
    start = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(-9).alias("last"))
    return F.aggregate(
        at,
        start,
        lambda a, p: F.struct((a.getField("n") + F.least(F.lit(3), p - a.getField("last"))).alias("n"), p.alias("last")),
        lambda a: a.getField("n"),
    )


def _n(text: Column, chars: str) -> Column:
    """How often ASCII characters occur: what replacing each shortens."""
    total = F.lit(0)
    for c in chars:
        total = total + (F.octet_length(text) - F.octet_length(F.replace(text, F.lit(c), F.lit("")))) / len(c.encode())
    return total.cast("long")


def _any(text: Column, parts: tuple[str, ...] | str) -> Column:
    found = F.lit(False)
    for p in parts:
        found = found | F.contains(text, F.lit(p))
    return found


def line_marks(line: Column) -> Column:
    """What the rules need of one line, computed once."""
    return F.struct(
        line.alias("line"),
        F.size(words(line)).alias("n"),
        ((F.octet_length(line) - F.octet_length(F.replace(line, F.lit("!!"), F.lit("")))) / 2).cast("long").alias("bangs"),
        _n(line, "#*$%&<>").alias("symbols"),
        _n(line, "|").alias("bars"),
        _n(line, "»•").alias("dots"),
        _any(F.lower(line), BOILERPLATE).alias("phrase"),
    )


def line_fails(m: Column) -> Column:
    """Whether a line (its line_marks) fails one of the three rules."""
    g = m.getField
    punctuation = (g("bangs") * 5 >= g("n")) & (g("bangs") > 0) | (g("symbols") * 3 >= g("n")) & (g("symbols") > 0)
    navigation = (g("bars") >= 3) & (g("bars") * 6 >= g("n")) | (g("dots") >= 3)
    return (g("n") > 0) & (punctuation | navigation | g("phrase"))


def clean_lines(df: DataFrame, text: str = "text", min_words: int = MIN_WORDS, max_repeat_pct: int = MAX_REPEAT_PCT, max_lost_pct: int = MAX_LOST_PCT) -> DataFrame:
    """df with clean_text and the counts n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, n_lines_removed, n_words_lost (long), base_failed and kept."""
    body = F.coalesce(F.col(text), F.lit(""))
    ws, h, s, marks = (F.col(f"__{x}") for x in ("words", "h", "s", "marks"))
    step = df.withColumn("__words", words(F.col(text))).withColumns(
        {
            "__h": _hashed(ws),
            "n_words": F.size(ws).cast("long"),
            "word_chars": F.char_length(F.array_join(ws, "")).cast("long"),
            "n_symbols": _n(body, SYMBOLS),
            "__worded": F.filter(F.split(body, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")),
        }
    )
    # A text without any of the marks has no failing line; only the others' lines are looked at.
    suspect = (F.col("n_symbols") > 0) | _any(body, ("!!", "»", "•")) | _any(F.lower(body), BOILERPLATE)
    step = step.withColumns(
        {
            "__s": F.when(F.size(F.array_distinct(h)) < F.size(h), F.sort_array(h)),
            "__marks": F.when(suspect, F.transform(F.split(body, "\n", -1), line_marks)),
            "n_dup_lines": (F.size("__worded") - F.size(F.array_distinct("__worded"))).cast("long"),
        }
    ).withColumns(
        {
            "__good": F.filter(marks, lambda m: ~line_fails(m)),
        }
    )
    good_n = F.aggregate(F.col("__good"), F.lit(0).cast("bigint"), lambda a, m: a + m.getField("n"))
    clean = F.array_join(F.transform(F.col("__good"), lambda m: m.getField("line")), "\n")
    step = step.withColumns(
        {
            "n_repeat_words": F.coalesce(_covered(F.when(s.isNotNull(), _repeated_at(h, s))), F.lit(0).cast("bigint")),
            "n_lines_removed": F.when(marks.isNull(), F.lit(0)).otherwise(F.size(marks) - F.size("__good")).cast("long"),
            "n_words_lost": F.when(marks.isNull(), F.lit(0)).otherwise(F.col("n_words") - good_n).cast("long"),
            "clean_text": F.when(marks.isNull(), body).otherwise(clean),
        }
    )
    base = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_pct * F.col("n_words"))
    enough = (100 * F.col("n_words_lost") <= max_lost_pct * F.col("n_words")) & (F.col("n_words") - F.col("n_words_lost") >= min_words)
    return step.withColumns({"base_failed": base, "kept": ~base & enough}).drop("__words", "__h", "__s", "__worded", "__marks", "__good")


def op2_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return clean_lines(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines_removed", "n_words_lost"
    )


SQL_OP2 = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
win AS (SELECT doc_id, i, ws[i] AS a, ws[i+1] AS b, ws[i+2] AS c
        FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 3)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS k FROM win) WHERE k > 1),
cov AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM rep) GROUP BY doc_id),
ln AS (SELECT doc_id, l, len(regexp_extract_all(l, '[^\x20\x09-\x0D]+')) AS n,
         (length(l) - length(replace(l, '!!', ''))) // 2 AS bangs,
         len(regexp_extract_all(l, '[#*$%&<>]')) AS sy, len(regexp_extract_all(l, '[|]')) AS bars,
         len(regexp_extract_all(l, '[»•]')) AS dots
       FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM d)),
lj AS (SELECT *, n > 0 AND ((bangs * 5 >= n AND bangs > 0) OR (sy * 3 >= n AND sy > 0)
         OR (bars >= 3 AND bars * 6 >= n) OR dots >= 3
         OR regexp_matches(lower(l), '{"|".join(BOILERPLATE)}')) AS bad FROM ln),
la AS (SELECT doc_id, count(*) FILTER (n > 0) - count(DISTINCT l) FILTER (n > 0) AS n_dup_lines,
         count(*) FILTER (bad) AS n_lines_removed, coalesce(sum(n) FILTER (bad), 0)::BIGINT AS n_words_lost
       FROM lj GROUP BY doc_id),
f AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words,
        length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
        len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
        n_dup_lines::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words, n_lines_removed::BIGINT AS n_lines_removed, n_words_lost
      FROM w LEFT JOIN cov USING (doc_id) LEFT JOIN la USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words)
    AND 100 * n_words_lost <= {MAX_LOST_PCT} * n_words AND n_words - n_words_lost >= {MIN_WORDS} AS kept,
  n_lines_removed, n_words_lost
FROM f
"""
