import random

import pytest

#: Columns that operators might use names of for themselves.
EXTRA = ["copies", "key", "line", "cid", "score", "threshold", "keep", "u", "v", "w", "c", "n", "cell", "settled", "fraction", "__id", "__gone", "__copy", "__key", "__bad", "__copies", "__lang", "n_replaced", "toxic"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make(spark):
    """make(texts or rows): a documents table, with clashing extra columns if asked for."""

    def build(rows, extra=False):
        full = []
        for i, r in enumerate(rows):
            doc_id, text, lang, source = r if isinstance(r, tuple) else (i, r, "en", f"s{i % 3}")
            full.append((doc_id, text, lang, source, None if text is None else len(text)))
        df = spark.createDataFrame(full, SCHEMA)
        if extra:
            for c in EXTRA:
                df = df.selectExpr("*", f"'own {c}' as `{c}`")
        return df

    return build


ODD = [(None, "a null id with some words here", "en", "s0"), (1, None, "en", "s0"), (2, "", None, None), (3, " \n\t ", "en", "s1"), (4, "one", "en", "s1"), (5, "same words in both rows today", "de", "s1"), (5, "same words in both rows today", "de", "s1"), (5, "other words in this row today", "de", "s2"), (6, "x" * 200_000 + " " + "word " * 50_000, "en", "s2")]


@pytest.fixture
def odd(make):
    """Nulls in every column, empty, blank and very long texts, repeated rows and ids, and clashing columns."""
    return make(ODD, extra=True)


@pytest.fixture(scope="session")
def prose():
    """prose(n, seed): n texts of made-up words."""

    def build(n, seed=0, low=20, high=120):
        r = random.Random(seed)
        words = ["".join(r.choice("bdfglmnprst") + r.choice("aeiou") for _ in range(r.randint(1, 4))) for _ in range(400)]
        return [" ".join(r.choice(words[: 40 if r.random() < 0.6 else 400]) for _ in range(r.randint(low, high))) for _ in range(n)]

    return build
