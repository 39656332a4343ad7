import random

import pytest

WORDS = "the of and in to alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho".split()


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randint(0, 400)) for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """Documents with every oddity: nulls, empty and blank texts, copies, near copies, repeats, a long text."""
    rng = random.Random(11)
    base = [sentence(rng, 80) for _ in range(12)]
    passage = sentence(rng, 60)
    rows = [(k, t, "s" + str(k % 3)) for k, t in enumerate(base)]
    rows += [
        (20, base[0], "s0"),
        (21, base[0].replace(" ", "\t\n "), "s1"),
        (22, base[1] + " tail", None),
        (23, base[2].replace(" ", "  ", 1).upper(), "s1"),
        (24, None, "s0"),
        (25, "", None),
        (26, " \t\n\x0b\x0c\r ", "s2"),
        (27, "one", "s2"),
        (28, "é ß 中文 🙂 <|endoftext|> </s>[INST] \\ \x00 \x1c\x85　", "s2"),
        (29, sentence(rng, 9) + " " + passage + " " + sentence(rng, 12), "s1"),
        (30, sentence(rng, 5) + "\n" + passage + "\n" + sentence(rng, 7), "s2"),
        (31, "x" * 30_000 + " " + "a b c " * 4000, "s0"),
        (32, base[3], "s0"),
        (32, base[3], "s0"),
        (None, base[4], "s1"),
        (None, None, None),
    ]
    return rows


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    """The same rows as a table, with columns whose names clash with what operators add."""
    df = spark.createDataFrame(odd_rows, "doc_id long, text string, source string")
    return df.selectExpr("*", "1 AS size", "'x' AS kept", "2 AS _fp", "3 AS keep_id", "0 AS n_words", "'y' AS component_id").repartition(3)


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
