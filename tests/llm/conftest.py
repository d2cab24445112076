import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, extra string"


def words(rng, n, vocabulary=4000):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


@pytest.fixture(scope="session")
def corpus(spark):
    """(rows, DataFrame): plain, copied, nearly copied, empty, null, blank, short, very long and odd texts; a repeated row; an extra column."""
    rng = random.Random(5)
    texts = [" ".join(words(rng, rng.randrange(1, 200))) for _ in range(60)]
    base = words(rng, 120)
    for k in range(12):  # near copies: one word changed
        mine = list(base)
        mine[k * 9] = f"x{k}"
        texts.append(" ".join(mine))
    texts += [texts[3]] * 5 + ["", None, " \t\n", "one", "one two", "One TWO", "É é ñ ß", "á <|endoftext|> don't 12345 !!'s", "\n".join(["line one", "line two", "line three", "own"]), "\n".join(["first", "line one", "line two", "line three"])]
    texts.append(" ".join(words(rng, 30_000, 20_000)))
    rows = [(i, t, ["en", "de", None][i % 3], f"src{i % 4}", "x") for i, t in enumerate(texts)]
    rows.append(rows[7])  # the same row again
    return rows, spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
