import random

import pytest

DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def words(rng: random.Random, n: int, base: int = 4000) -> list[str]:
    return [f"w{rng.randrange(base)}{rng.choice('abcdeö')}" for _ in range(n)]


def corpus(seed: int = 1, n: int = 60) -> list[tuple]:
    """Documents with exact and near copies, shared passages, nulls, empty, short and long texts."""
    rng = random.Random(seed)
    passage = words(rng, 70)
    texts: list = [None, "", "   \n\t ", "one", "one two three four", "x" * 50_000, " ".join(words(rng, 6000))]
    while len(texts) < n:
        kind = rng.randrange(6)
        if kind == 0 and len(texts) > 8:
            texts.append(rng.choice(texts))
        elif kind == 1:
            w = (rng.choice([t for t in texts if t and 20 < len(t.split()) < 1000] or [" ".join(words(rng, 90))])).split()
            w[rng.randrange(len(w))] = "changed"
            texts.append(" ".join(w))
        elif kind == 2:
            texts.append(" ".join(words(rng, rng.randrange(40)) + passage + words(rng, rng.randrange(40))))
        else:
            texts.append("\n".join(" ".join(words(rng, rng.randrange(1, 40))) for _ in range(rng.randrange(1, 9))))
    return [(i, t, rng.choice(("en", "de")), f"src{i % 3}", len(t or "")) for i, t in enumerate(texts)]


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(corpus(), DOCUMENTS)


@pytest.fixture(scope="session")
def odd(spark):
    """Null ids, repeated rows, and columns whose names clash with those the operators use."""
    rows = [(None, "a b c d e f g", "en"), (None, "a b c d e f g", "en"), (3, "same same", "de"), (3, "same same", "de"), (4, None, None), (5, "", "en"), (-7, "a b c d e f g", "fr")]
    return spark.createDataFrame([(*r, "x", 1, 2, b"z", [1], 5) for r in rows], "doc_id bigint, text string, lang string, grp string, bucket int, node int, set_key binary, spans array<int>, fold int")


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCUMENTS)
