import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, x_key string, x_text string, c0 int, length bigint, piece map<string,string>"
WORDS = ["alpha", "bravo", "charlie", "delta", "echo", "foxtrot", "golf", "hotel", "india", "juliet", "kilo", "lima", "mike", "november", "oscar", "papa"]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n))


def messy_rows():
    """Nulls in any column, empty and long texts, ties, repeated rows, copies and near copies."""
    rng = random.Random(11)
    base = [prose(rng, rng.randrange(6, 120)) for _ in range(30)]
    texts = [*base, *base[:6], None, None, "", "", "   \n", "123 456", "é", "日本語のテキスト", "one two", "one two", prose(rng, 30_000)]
    for t in base[6:16]:
        words = t.split(" ")
        words[rng.randrange(len(words))] = "changed"
        texts.append(" ".join(words))
    rows = [(k, t, ["en", "de", None][k % 3], ["a", "b", None, "Z"][k % 4], None if t is None else len(t), "x", "y", k, 5, None) for k, t in enumerate(texts)]
    rows += [(None, base[0], "en", "a", 3, "x", None, None, None, {"k": "v"})] * 3
    rows += [(7, base[7], "de", "b", 1, None, None, None, None, None)] * 2
    rows += [(7, base[8], None, None, 1, None, None, None, None, None)]
    return rows


@pytest.fixture(scope="session")
def messy(spark):
    return spark.createDataFrame(messy_rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
