"""Small inputs with every odd case, and brute-force helpers."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, word string, class binary, id int, h long, k0 string, label int"


def documents(spark, texts, langs=None, ids=None):
    """Documents with extra columns whose names clash with those inside the operators."""
    ids = ids or list(range(len(texts)))
    langs = langs or ["en"] * len(texts)
    rows = [(i, t, g, "s", None, "w", b"c", 1, 2, "k", 3) for i, t, g in zip(ids, texts, langs, strict=True)]
    return spark.createDataFrame(rows, SCHEMA)


def prose(rng: random.Random, n: int) -> list[str]:
    parts = ["an", "the", "re", "ion", "st", "in", "ouv", "er", "tha", "lo", "mi", "ke"]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(1, 4))) for _ in range(n)]


ODD = [
    None,
    "",
    " \n\t ",
    "One. two, THREE don't we'll <|endoftext|>x <|ENDOFTEXT|> ",
    "é é́ ǅ İ ß ﬁ Ω 日本語 👍🏽  nb sp \x1c\x0b",
    "  lead and  double \n lines\r\nend ",
    "a",
    "12 3.4 ½ Ⅷ ... !?",
]
