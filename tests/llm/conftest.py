import random

import pytest

DDL = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark):
    """Makes a documents table of texts (or (doc_id, text) pairs)."""

    def make(texts, first=0):
        rows = [t if isinstance(t, tuple) else (k + first, t) for k, t in enumerate(texts)]
        return spark.createDataFrame([(i, t, "en", None, None if t is None else len(t)) for i, t in rows], DDL).repartition(3)

    return make


@pytest.fixture(scope="session")
def prose():
    """Texts from a small vocabulary, by seed and length."""

    def make(seed, words, lines=1):
        rng = random.Random(seed)
        word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 5)))
        return "\n".join(" ".join(word() for _ in range(words)) for _ in range(lines))

    return make
