import random

import pytest

FIELDS = "doc_id bigint, text string, lang string, source string, n_chars bigint, h string, n int, node int, size int, score string, rate string, word string, copies int, __h int"


def syllables(rng, words):
    return " ".join("".join(rng.choice(["an", "be", "co", "du", "el", "fi", "go"]) for _ in range(rng.randint(1, 3))) for _ in range(words))


@pytest.fixture(scope="session")
def rows():
    """Texts with nulls, blanks, copies, near copies, ties and one long text."""
    rng = random.Random(3)
    texts = [None, "", "  \t\n ", "one", "ONE", "É mit ß", "released under the MIT license. x", "licensed under the Apache License, Version 2.0.", "a cc by-nc 4.0 b", "cc by"]
    long = syllables(rng, 30_000)
    texts += [long, long.replace(" ", "\n", 1), long + " more"]
    for _ in range(25):
        base = syllables(rng, rng.randint(30, 120)).split()
        texts.append(" ".join(base))
        for _ in range(rng.randint(0, 3)):
            other = list(base)
            for _ in range(rng.randint(0, 6)):
                other[rng.randrange(len(other))] = "zz" + str(rng.randrange(9))
            texts.append(("  " if rng.random() < 0.5 else " ").join(other) + rng.choice(["", "\n", " The end.\nIt is!"]))
    out = [(i, t, "en", rng.choice(["s1", "s2", "s2", "é", None]), 0, "x", 1, 2, 3, "y", "z", "w", 4, 5) for i, t in enumerate(texts)]
    out.append((out[20][0], out[20][1], *out[20][2:]))  # a row repeated whole
    out.append((None, "no id here", *out[0][2:]))
    return out


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, FIELDS).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], FIELDS)
