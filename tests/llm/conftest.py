import random

import pytest


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="session")
def corpus():
    """Rows (doc_id, text): copies, near copies, shared passages, empty and null texts, odd white space, repeated rows."""
    rng = random.Random(5)
    rows, passage = [], words(rng, 60)
    for i in range(60):
        rows.append((i, words(rng, rng.randrange(1, 120))))
    for i in range(60, 75):
        rows.append((i, words(rng, 30) + "  \n" + passage + "\t" + words(rng, 20)))
    for i in range(75, 90):
        base = rows[i - 75][1].split()
        if len(base) > 4:
            base[len(base) // 2] = "changed"
        rows.append((i, " ".join(base)))
    rows += [(90 + i, rows[i][1]) for i in range(10)]
    rows += [(101, ""), (102, None), (103, "one"), (104, "é ü " * 80), (105, "a" * 900), (106, "Üb　er x\x0by\x1fz"), (107, rows[3][1]), (107, rows[3][1]), (None, rows[4][1]), (None, None)]
    return rows


@pytest.fixture(scope="session")
def docs(spark, corpus):
    from pyspark.sql import functions as F

    return spark.createDataFrame(corpus, "doc_id long, text string").withColumn("lang", F.lit("en")).withColumn("source", F.lit("s")).withColumn("n_chars", F.length("text").cast("long")).withColumn("block", F.lit(None).cast("string")).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
