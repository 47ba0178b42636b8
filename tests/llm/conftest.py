import random

import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("_id", T.StringType()), T.StructField("spans", T.LongType()), T.StructField("_row", T.LongType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


def sentence(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def corpus(seed=1, n=120):
    """Texts with exact copies, near copies, shared passages and lines, odd characters, nulls, blanks and a long one."""
    rng = random.Random(seed)
    passage = sentence(rng, 60)
    lines = [sentence(rng, 6) for _ in range(5)]
    rows = []
    for i in range(n):
        kind = i % 8
        text = "\n".join(sentence(rng, rng.randrange(3, 30)) for _ in range(rng.randrange(1, 8)))
        if kind == 1 and rows:
            text = rng.choice(rows)[1]
        if kind == 2:
            words = (rng.choice(rows)[1] or "x y z").split(" ")
            for _ in range(max(1, len(words) // 60)):
                words[rng.randrange(len(words))] = "changed"
            text = " ".join(words)
        if kind == 3:
            text += " " + passage + " " + sentence(rng, 10)
        if kind == 4:
            text = text + "\n" + "\n".join(lines) + "\n\n  \n" + text.split("\n")[0]
        if kind == 5:
            text = "É ñ\t\x0bß  " + text + " 中文 a<|endoftext|>b 😀"
        rows.append((i, text))
    rows += [(n, None), (n + 1, ""), (n + 2, " \n\t "), (n + 3, "one"), (n + 4, "one"), (None, "one"), (n + 5, " ".join(["loop loop"] * 500)), (n + 6, rows[0][1]), (n + 6, rows[0][1]), (n + 7, sentence(rng, 20_000))]
    return rows


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, "x", 7, 8, f"s{k % 3}", None) for k, (i, t) in enumerate(rows)], DOCS).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)
