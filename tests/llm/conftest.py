import random

import pytest

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, "
    # Names that operators use for columns of their own.
    "salt int, th string, score double, sha_ string, key_ long, part int, digest string, node long"
)


def corpus():
    """Small texts with copies, near copies, passages, nulls, empty, very long and odd texts, repeated rows."""
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdeé ñü".replace(" ", "")) for _ in range(rng.randint(1, 7))) for _ in range(400)]
    say = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    base, passage = say(300), say(70)
    words = base.split()
    near = []
    for k in range(12):
        copy = list(words)
        for _ in range(k):
            copy[rng.randrange(len(copy))] = f"x{k}y"
        near.append(" ".join(copy))
    texts = [
        None, "", "", " \t\n", "one", "ONE", "one two", "One  Two three four", "A b c d e", "a B C D E", base, base.upper(), base, *near,
        say(40) + " " + passage + "\n" + say(40), passage, say(30) + "\n" + passage, "ab" * 300, "ab" * 301, say(30_000), "é" * 5000, "\x00\x1f z ",
        *(say(rng.randint(1, 60)) for _ in range(40)),
    ]
    rows = [(k, t, "en", "s", None if k % 7 == 0 else len(t or "")) for k, t in enumerate(texts)]
    rows += [(None, base, None, None, None), (None, None, "en", "s", 3), (5, "ONE", "en", "s", 3), (10, base, "en", "s", 9), (3, say(50), "x", "y", 1)]
    return [(*r, 1, "t", 0.5, "s", 2, 3, "d", 4) for r in rows]


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
