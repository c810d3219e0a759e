import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, `KEY` string, part int, `name` string"


def make_documents(spark, seed=3, n=80):
    """Documents with nulls, empty and long texts, copies, shared passages, ties and clashing columns."""
    rng = random.Random(seed)
    vocabulary = ["the", "Wörter", "und", "x", "Ärger", "it's", "naïve", "Żółw"] + [f"w{i}" for i in range(150)]
    passage = [rng.choice(vocabulary) for _ in range(80)]
    rows = []
    for i in range(n):
        size = rng.choice([0, 1, 5, 49, 50, 51, 90, 200, 400])
        words = [rng.choice(vocabulary) for _ in range(size)]
        if rng.random() < 0.4:
            at = rng.randrange(len(words) + 1)
            a = rng.randrange(20)
            words[at:at] = passage[a : a + rng.choice([30, 50, 60])]
        if rng.random() < 0.2:
            words += ["again"] * 120
        text = "".join(w + rng.choice([" ", "  ", "\n", ". ", "\t"]) for w in words)
        rows.append((3 * i, text, rng.choice(["en", "de", None]), rng.choice(["a", "b", None]), len(text)))
    rows += [(1000, rows[7][1], "en", "a", 0), (1001, rows[7][1], None, "b", None), (1002, rows[7][1] + " x", "de", "c", 1)]
    rows += [(1003, None, None, None, None), (1004, "", "en", "a", 0), (1005, " \n\t ", "en", "d", 0)]
    rows += [(1006, "the und " * 3000, "en", "a", 0), (1007, "y z q " * 60, "en", "a", 0)]
    rows += [(1008, rows[9][1], "en", "a", 0)] * 2 + [(1008, "other text with the same id " * 15, "en", "a", 0)]
    rows += [(None, rows[9][1], "en", None, 0), (None, None, None, None, None)]
    rng.shuffle(rows)
    return rows, spark.createDataFrame([(*r, "k", 1, "n") for r in rows], SCHEMA).repartition(5)


@pytest.fixture(scope="session")
def documents(spark):
    return make_documents(spark)


@pytest.fixture(scope="session")
def no_documents(spark):
    return spark.createDataFrame([], SCHEMA)
