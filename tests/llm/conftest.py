import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, key string"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "s", "ed", "X", "é"]) for _ in range(n))


@pytest.fixture(scope="session")
def rows():
    """Documents with copies, near copies, nulls, empty and long texts, repeated rows, and a column named `key`."""
    rng = random.Random(3)
    texts = [prose(rng, rng.randint(1, 120)) for _ in range(40)]
    base = prose(rng, 60)
    texts += [base, base, base.replace("alpha", "ALPHA", 1), base + " tail", " ".join(base.split()[:-1]), base.replace(" ", "\n\t", 3)]
    long = prose(rng, 4000)
    texts += [long, long + " end", None, "", " \t\n", "one", "one", "ONE", "a b c", "aaaa" * 300, "aaaa" * 300 + "b", "ab " * 400]
    passage = prose(rng, 90)
    texts += [prose(rng, 20) + " " + passage + " " + prose(rng, 20) for _ in range(5)]
    out = [(i, t, "en", None if i % 11 == 0 else f"src{i % 4}", len(t or ""), f"k{i}") for i, t in enumerate(texts)]
    return [*out, (None, "no id here at all", None, None, None, None), out[3], out[3]]


@pytest.fixture(scope="session")
def documents(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
