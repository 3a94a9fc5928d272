"""Small tables with what every operator must take: nulls, empty and long texts, ties, repeated rows, clashing columns."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SYLLABLES = {"en": ["th", "re", "on", "er", "an", "ti", "st", "ou", "ing"], "fr": ["é", "eau", "ou", "ai", "ç", "que", "ment", "è"]}


def prose(seed, n, lang="en"):
    rng = random.Random(seed)
    words = ["".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 4))) for _ in range(n)]
    for i in range(9, n, 10):
        words[i] += "."
    return " ".join(words).replace(". ", ".\n")


def odd_rows():
    """Rows that no operator may trip over."""
    return [
        (1, None, None, None, None),
        (2, "", "en", "a", 0),
        (3, " \n\t ", "en", None, 4),
        (None, "no id here but words", "en", "a", 20),
        (4, "x", None, "a", 1),
        (5, "word " * 30_000, "en", "a", 150_000),
        (6, "a" * 5_000 + "é🙂\x00 <|endoftext|> </s> ▁", "en", "a", 5_000),
        (7, prose(1, 80), "en", "a", 1),
        (7, prose(1, 80), "en", "a", 1),
    ]


def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS)
