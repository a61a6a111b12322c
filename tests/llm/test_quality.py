import random

import numpy as np
from pyspark.sql import functions as F

from weftline.llm import quality as Q


def text(rng, good, n):
    words = ["".join(rng.choice(["th", "er", "on", "an", "re"]) for _ in range(rng.randrange(1, 4))) for _ in range(n)]
    return " ".join(words) if good else rng.choice([" ".join(w.upper() + "!!" for w in words), " | ".join(words), " ".join([words[0]] * n)])


def test_held_out_accuracy_and_calibration(spark):
    rng = random.Random(1)
    rows = [(i, text(rng, i % 4 > 0, rng.randrange(20, 80)), int(i % 4 > 0)) for i in range(900)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2], 0) for r in rows], "doc_id long, quality int, toxic int")
    model = Q.fit(docs, labels)
    got = {r.doc_id: r for r in Q.score(docs, model).collect()}
    held = [r for r in rows if got[r[0]].held_out]
    assert 150 < len(held) < 300
    assert np.mean([got[r[0]].predicted == r[2] for r in held]) > 0.97
    assert np.mean([(got[r[0]].score - r[2]) ** 2 for r in held]) < 0.03
    kept = {r.doc_id for r in Q.keep_good(docs, model).collect()}
    assert kept == {i for i, r in got.items() if r.predicted}


def test_labels_of_the_held_out_fold_are_not_used(spark):
    rng = random.Random(2)
    docs = spark.createDataFrame([(i, text(rng, i % 2, 30)) for i in range(200)], "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    turned = labels.withColumn("quality", F.when(Q.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = ({r.doc_id: r.score for r in Q.score(docs, Q.fit(docs, x)).collect()} for x in (labels, turned))
    assert all(abs(a[i] - b[i]) < 1e-4 for i in a)


def test_odd_rows(spark, docs, corpus, nothing):
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 0), (None, 1), (3, None)], "doc_id long, quality int")
    model = Q.fit(docs, labels)
    rows = Q.score(docs, model).collect()
    assert len(rows) == len(corpus) and all(r.score == 0.5 and r.predicted == 0 for r in rows)
    assert Q.score(nothing, Q.fit(nothing, labels)).count() == 0
    assert Q.features(np.zeros(0, np.uint8), np.zeros(3, np.int64), np.stack([Q.index_vectors()] * 2)).tolist() == np.zeros((2, Q.POOLED + 6)).tolist()
    assert Q.keep_good(docs, model).count() == len(corpus)
    repeated = docs.unionByName(docs).unionByName(docs)
    assert Q.score(repeated, Q.fit(repeated, labels.unionByName(labels))).count() == 3 * len(corpus)


def test_whole_words_count():
    """Words that differ after their first bytes have rows of their own, and a stem in common."""
    raw = b"information informal informational Information INFORMATION 2024 2025 ... !!"
    words, stems, doc = Q.tokens_of(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
    assert len(words) == 9 and len(set(words.tolist())) == 9
    assert len(set(stems[:3].tolist())) == 1 and stems[3] != stems[0] and stems[5] == stems[6]


def test_pooled_vectors_alone_tell_most(spark):
    """The measures beside the vectors are not what decides."""
    rng = random.Random(3)
    rows = [(text(rng, i % 2, 50).encode(), i % 2) for i in range(600)]
    ends = lambda part: np.concatenate([[0], np.cumsum([len(t) for t, _ in part])]).astype(np.int64)
    data = lambda part: np.frombuffer(b"".join(t for t, _ in part), np.uint8)
    table = Q.context_sums(data(rows[:400]), ends(rows[:400]), Q.index_vectors())
    table /= np.linalg.norm(table, axis=2, keepdims=True) + 1e-6
    x = Q.features(data(rows), ends(rows), table)[:, : Q.POOLED]
    y = np.array([label for _, label in rows], float)
    network = Q.TwoLayer(x[:400], y[:400])
    assert np.mean((network.scores(x[400:]) > 0.5) == (y[400:] > 0)) > 0.9
