import zlib
from collections import defaultdict

from pyspark.sql import functions as F

from weftline.llm.sharding import kd_shards, op6_sharding, with_slots


def test_sizes_are_near_equal_and_slots_gapless(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.expr("repeat('x', cast(pmod(id * 7919, 300) as int))").alias("text"), F.when(F.col("id") % 3 > 0, "hot").alias("source"), F.lit("en").alias("lang"))
    rows = with_slots(kd_shards(docs, n_shards=40), 4000).collect()
    sizes, slots = defaultdict(int), defaultdict(list)
    for r in rows:
        sizes[r.shard] += r["size"]
        slots[r.shard].append(r.slot)
    assert len(rows) == 4000 and sorted(sizes) == list(range(40))
    assert max(sizes.values()) < 1.06 * min(sizes.values())
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())


def test_one_hot_text_is_cut(spark):
    docs = spark.range(1000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 700, "same text").otherwise(F.concat(F.lit("t"), "id")).alias("text"), F.lit(None).cast("string").alias("source"), F.lit(None).cast("string").alias("lang"))
    sizes = [r[1] for r in kd_shards(docs, n_shards=8).groupBy("shard").agg(F.sum("size")).collect()]
    assert len(sizes) == 8 and max(sizes) < 1.1 * min(sizes)


def test_odd_rows(docs, corpus, nothing):
    rows = kd_shards(docs, target_bytes=2000).collect()
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(((r.doc_id, r["size"], r.text_crc32) for r in rows), key=key) == sorted(((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in corpus), key=key)
    assert with_slots(kd_shards(nothing, n_shards=40), 0).count() == 0


def test_large_rows_among_small_ones(spark):
    """Sizes from some bytes to half a shard; repeated rows; the query's own columns, law and slots."""
    docs = spark.range(1500).select((F.col("id") % 1400).alias("doc_id"), F.expr("repeat('x', cast(pow(1.006, pmod(id * 7919, 1500)) as int))").alias("text"), (F.col("id") % 5).cast("string").alias("source"), F.lit("en").alias("lang"))
    rows = with_slots(kd_shards(docs, n_shards=40), 1500).collect()
    total = sum(r["size"] for r in rows)
    sizes, slots = defaultdict(int), defaultdict(list)
    for r in rows:
        sizes[r.shard] += r["size"]
        slots[r.shard].append(r.slot)
    assert len(rows) == 1500 and len(sizes) == 40
    assert max(sizes.values()) < 1.03 * total / 40 and min(sizes.values()) > 0.97 * total / 40, (total / 40, sorted(sizes.values()))
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())


def test_query(spark, tmp_path):
    rows = [(i, "text " * (i % 50), "s", "en") for i in range(300)] + [(7, "again", "s", "en"), (None, None, None, None), (7, "again", "s", "en")]
    spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = op6_sharding(spark, str(tmp_path)).collect()
    assert sorted((str(r.doc_id), r["size"], r.text_crc32) for r in got) == sorted((str(i), len(t or "") + 16, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    assert {r.law for r in got} == {"bytes"} and {r.grown_shard for r in got} == {None} and {r.shard for r in got} == set(range(40))
