import random

import pytest


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls, empty, short, long and repeated texts, and columns whose names clash with the operators' own."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("aeinorst") for _ in range(rng.randint(1, 7)))
    base = [word() for _ in range(120)]
    near = [*base[:60], "changed", *base[61:]]
    rows = [
        (1, " ".join(base), "a"), (2, " ".join(near), "b"), (3, " ".join(base), None), (4, None, "a"), (5, "", None), (6, " \t\n ", "a"), (None, "only me", "b"), (None, None, None),
        (7, "one two three", "a"), (8, "One  TWO three", "b"), (9, " ".join(word() for _ in range(30_000)), "b"), (10, "x" * 50_000, "c"), (10, "x" * 50_000, "c"), (11, "é ü ﬁ 日本 ▁ \x00 <s>", "c"),
        (12, "a b c d e " * 40, "c"), (13, "line one here\nline one here\n\nline two", "a"), (14, " ".join(reversed(base)), "a"), (10, "other text with the same id", "a"),
    ]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    from pyspark.sql import functions as F

    for name in ("size", "label", "kept", "node", "n_words", "target", "row_number", "bundle", "key", "box", "times", "turn", "n", "spans", "at", "__key", "__spans", "__copy", "__text", "a`b.c"):
        df = df.withColumn(name, F.lit("clash"))
    return df


@pytest.fixture(scope="session")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark, sf):
    return spark.read.parquet(f"{sf}/labels.parquet")
