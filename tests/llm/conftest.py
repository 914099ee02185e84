import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def frame(spark):
    """Documents from texts, numbered from 0, or from (doc_id, text)."""

    def make(rows, parts=3):
        rows = [r if isinstance(r, tuple) else (i, r) for i, r in enumerate(rows)]
        full = [(i, t, "en", "src", len(t or "")) for i, t in rows]
        return spark.createDataFrame(full, SCHEMA).repartition(parts) if full else spark.createDataFrame([], SCHEMA)

    return make


def words(r, n, size=40):
    return [r.choice("abcdefgh") + str(r.randrange(size)) for _ in range(n)]


@pytest.fixture(scope="session")
def corpus():
    """Texts with copies, near copies, shared passages, runs, blanks of all kinds and odd characters."""
    r = random.Random(5)
    passage = " ".join(words(r, 60, 1000))
    base = words(r, 70, 1000)
    texts = [" ".join(words(r, r.randrange(1, 90))) for _ in range(30)]
    texts += [f"{' '.join(words(r, 15))} {passage} {' '.join(words(r, r.randrange(20)))}" for _ in range(12)]
    for n in range(24):
        near = list(base)
        for _ in range(n % 8):
            near[r.randrange(len(near))] = r.choice("xyz") + str(r.randrange(10**6))
        texts.append(" ".join(near))
    texts += [texts[3]] * 4 + [texts[40]] * 3
    texts += ["a a a " * 40, "a b " * 50, "a b " * 47, "", None, " \t\n", "one", "one", "éa ß x y", "\x1c\x00 \x0b z"]
    texts += ["Ünïcode ÀB ab 12 " * 30, "Same Line.\nSame line.\n" * 9, "!?", passage.upper()]
    texts.append(" ".join(words(r, 30_000, 10**6)))
    return texts


@pytest.fixture(scope="session")
def odd_rows():
    """Repeated rows, repeated and missing ids."""
    text = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi"
    return [(1, text), (1, text), (2, text), (2, "other"), (None, text), (None, None), (3, None), (3, ""), (4, "solo")]
