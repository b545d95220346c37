import random

import pytest

WORDS = "the of and rain Ferry 42 anchor, blue über naïve x7 river stone letter quiet harbour lantern".split()


def sentence(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + (str(r.randint(0, 99)) if r.random() < 0.2 else "") for _ in range(n))


def edge_rows():
    """doc_id, text: nulls, empty and very long texts, ties, repeated rows, copies and near copies."""
    rows = [(k, sentence(k, 5 + 37 * k % 300)) for k in range(60)]
    rows += [(100 + k, sentence(3, 5 + 37 * 3 % 300)) for k in range(5)]  # exact copies of 3
    rows += [(110 + k, sentence(7, 259) + f" tail{k}") for k in range(4)]  # near copies
    rows += [(200, None), (201, ""), (202, "   \n\t "), (203, "one"), (203, "one"), (203, "another text under the same id"), (None, sentence(3, 116)), (None, "no id at all")]
    rows += [(204, sentence(9, 30_000)), (205, "x" * 50_000), (206, "7 " * 5_000), (207, "a\n\nb  c \n d"), (208, "<|endoftext|> x")]
    return rows


@pytest.fixture(scope="session")
def edge(spark):
    df = spark.createDataFrame([(i, t, 1, "k", 2, t) for i, t in edge_rows()], "doc_id long, text string, row int, part string, fp int, line string")
    return df.repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
