"""Small tables with every odd case: nulls, empty and long texts, repeated rows, clashing column names."""

from __future__ import annotations

import random

import pytest

FIELDS = "doc_id long, text string, lang string, source string, n_chars long, n_words long, kept boolean, _v string, _n int, k1 int, h long, found string"


def rows_of(pairs):
    """(doc_id, text, lang, source) with the clashing columns filled in."""
    return [(i, t, lang, source, None if t is None else len(t), -1, None, "x", 7, 7, 7, "y") for i, t, lang, source in pairs]


def prose(seed: int, words: int, lang: str = "en") -> str:
    r = random.Random(seed)
    stop = {"en": ["the", "of", "and", "to"], "fr": ["le", "les", "et", "que"]}[lang]
    parts = {"en": ["th", "er", "on", "ing", "wh", "ea"], "fr": ["é", "eau", "oi", "ç", "eux", "ment"]}[lang]
    out = [r.choice(stop) if r.random() < 0.25 else "".join(r.choice(parts) for _ in range(r.randint(1, 4))) for _ in range(words)]
    return " ".join(w + ("\n" if i % 17 == 16 else "") for i, w in enumerate(out))


@pytest.fixture(scope="session")
def odd(spark):
    """A DataFrame of odd documents; two rows are repeated whole, two share an id but not the text."""
    shared = "This very line stands in more than five documents here, ok."
    base = prose(1, 120)
    pairs = [
        (1, None, "en", "a"), (2, "", "en", "a"), (3, " \t\n\x0b\x0c\r ", "en", None), (4, "word", None, "a"), (None, base, "en", "a"), (None, None, None, None),
        (5, base, "en", "a"), (6, base, "en", "b"), (6, base, "en", "b"), (7, prose(2, 60), "en", "b"), (7, prose(3, 60, "fr"), "fr", "b"),
        (8, base.replace("the", "thee", 1), "en", "a"), (9, "É É é MiXeD ÉA Case\nÉ É é MiXeD ÉA Case\n" * 3, "fr", "c"), (10, "x" * 5000, "en", "a"),
        (11, "a b c d e f g " * 400, "en", "a"), (12, "1 2 3\n\n\n1 2 3\n1 2 3", "en", "a"), (13, "😀 漢字 " * 20 + "end", "en", "a"),
    ]
    pairs += [(20 + i, f"{prose(30 + i, 40)}\n {shared.upper() if i % 2 else shared}\t\nlast {i}", "en", "a") for i in range(6)]
    pairs += [(40 + i, prose(60 + i, 80, "fr" if i % 2 else "en"), "fr" if i % 2 else "en", "s" + str(i % 3)) for i in range(12)]
    return spark.createDataFrame(rows_of(pairs), FIELDS).repartition(4)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], FIELDS)
