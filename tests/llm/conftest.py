import random

import pytest

EDGE_SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, shard int, slot long, score double, kept boolean, bucket int, part int, norm string, h long"


def edge_rows():
    """Nulls, empty and blank texts, long ones, ties, repeated rows, odd characters."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7)))
    sentence = lambda n: " ".join(word() for _ in range(n)).capitalize() + "."
    passage = sentence(30)
    base = [sentence(12) for _ in range(8)]
    near = " ".join(base).split()
    near[40] = "changed"
    texts = [
        None, "", "   \n\t", "one", "one two", "ONE Two", " ".join(base), " ".join(base), " ".join(near), "\n".join(base), passage + " tail", "head " + passage, passage, passage,
        "Été à la plage. Ça va, l’été! 日本語のテキスト 😀 <|endoftext|> d'accord 's", "x" * 200, ("spam spam spam spam " * 40).strip(), "a | b | c | d\nGood line here.\nAll rights reserved.",
        "\n".join(sentence(9) for _ in range(400)), "Licensed under the Apache License, Version 2.0.", "\x1c\x1d odd \x85 spaces\xa0here", "é ΣΑΣ İ",
    ]
    rows = [(k, t, rng.choice(["en", "de", None]), rng.choice(["src0", "src1", None]), len(t or "")) for k, t in enumerate(texts)]
    rows += [rows[6], rows[6], (3, "other text for a used id", "en", "src0", 3), (None, "no id here", "en", "src0", 3), (-5, passage + " tail", None, None, None)]
    return [(*r, 1, 2, 0.5, True, 3, 4, "n", 9) for r in rows]


@pytest.fixture(scope="session")
def edge(spark):
    return spark.createDataFrame(edge_rows(), EDGE_SCHEMA)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], EDGE_SCHEMA)


@pytest.fixture(scope="session")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")
