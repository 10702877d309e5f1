import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, kept string, mark string, row string"
WORDS = {
    "en": "the of and that hen thin ing ation with erst onth whea".split(),
    "de": "und die der einung keit ver schaft licher ach zu wäre übung".split(),
}


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Documents with nulls, empty and long texts, ties, repeated rows and clashing columns."""
    draw = random.Random(3)

    def text(lang, n):
        return " ".join(draw.choice(WORDS[lang]) + draw.choice(["", "a", "ing", "er", "x", "7"]) for _ in range(n))

    shared = text("en", 60)
    base = [
        (1, None), (2, ""), (3, " \t\n "), (4, "one"), (5, "a b"), (6, "!!! 123 ..."), (7, shared), (8, text("en", 30) + " " + shared),
        (9, shared + "\n" + text("en", 25)), (10, shared), (11, "Same Word " * 300), (12, "word " * 100), (13, text("de", 200)),
        (14, text("en", 5000)), (15, shared.upper()), (16, text("en", 19)), (17, "  " + text("de", 40) + "\r\n\x0b" + shared + "  "),
        (None, shared), (None, None), (20, text("en", 80)), (20, text("en", 80)), (21, "twin rows " + text("en", 40)), (22, "naïve Éa b ß"),
    ]
    rows = [(i, t, "en" if k % 3 else "de", None if k % 5 == 0 else "s", None, "kept", "mark", "row") for k, (i, t) in enumerate(base)]
    rows.append(rows[-2])  # a row that is there twice
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
