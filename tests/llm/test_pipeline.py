import random

import corpus_pipeline
import pytest
import sentencepiece
from pyspark.sql import functions as F

from weftline.llm.piece_tokens import DEFAULT_MODEL
from weftline.session import checkpointed


def prose(rng, n):
    return " ".join("".join(rng.choice(["th", "er", "on", "an", "re", "in"]) for _ in range(rng.randrange(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng, out = random.Random(12), tmp_path_factory.mktemp("pipeline")
    items = [(k, prose(rng, 25)) for k in range(5)]
    rows = [(i, prose(rng, 60) if i % 5 else " ".join(w.upper() + "!!" for w in prose(rng, 60).split())) for i in range(400)]
    near = rows[1][1].split()
    near[30] = "changed"
    rows += [(400, rows[1][1]), (401, " ".join(near)), (402, prose(rng, 50) + " " + items[2][1] + " " + prose(rng, 20)), (403, prose(rng, 40) + " password=abcdef0123 " + prose(rng, 20)), (404, items[3][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").select("doc_id", "text", F.lit("en").alias("lang"), F.lit("s").alias("source"), F.length("text").cast("long").alias("n_chars"))
    docs.write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{out}/benchmark.parquet")
    spark.createDataFrame([(i, int(i % 5 > 0), 0) for i in range(400)], "doc_id long, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    return str(out), dict(rows), items


def test_stages_one_by_one(spark, tables):
    sf_dir, rows, items = tables
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = checkpointed(stage(spark, docs, sf_dir))
        assert docs.columns == columns
        kept[name] = {r.doc_id: r for r in docs.collect()}
    assert {i for i in range(400) if i % 5} <= kept["quality classifier"].keys() and not {i for i in range(0, 400, 5)} & kept["quality classifier"].keys()
    assert kept["quality classifier"].keys() - kept["n-gram Jaccard join"].keys() == {400, 401}
    clean = kept["benchmark decontamination"]
    assert kept["n-gram Jaccard join"].keys() - clean.keys() == {404}
    assert items[2][1] not in clean[402].text and clean[402].n_chars == len(clean[402].text)
    assert all(r.text == rows[i] for i, r in clean.items() if i != 402)
    safe = kept["secret scans"]
    assert safe.keys() == clean.keys() and "abcdef0123" not in safe[403].text and "password=<assign>" in safe[403].text
    assert all(safe[i].text == clean[i].text for i in clean if i != 403)
    library = sentencepiece.SentencePieceProcessor(model_file=DEFAULT_MODEL)
    encoded = {r.doc_id: r for r in corpus_pipeline.run(spark, sf_dir).collect()}
    assert encoded.keys() == safe.keys()
    assert all(r.ids == library.encode(safe[i].text) and r.round_trip for i, r in encoded.items())
