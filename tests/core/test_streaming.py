import random
from datetime import datetime, timedelta

import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weftline.operators import health
from weftline.operators.windows import distinct_revisions
from weftline.streaming import folds

START = datetime(2026, 1, 1)


def facts(n=300, seed=1):
    rng = random.Random(seed)
    kinds = ["ok", "needs_js", "moved", "http_error", "blocked", "unreachable", "other"]
    rows = [(rng.randrange(8), START + timedelta(seconds=rng.randrange(900_000)), rng.choice(["http", "browser"]), rng.choice(kinds)) for _ in range(n)]
    return [(*r, f"site{r[0]}" if r[3] == "moved" else None) for r in rows]


SCHEMA = "domain_id long, at timestamp, capability string, class string, moved_to string"


def run(spark, stream, path, rows, schema, split=4):
    """Feed shuffled rows as several files and keep the last row of each key."""
    for k in range(split):
        spark.createDataFrame(rows[k::split], schema).coalesce(1).write.mode("append").parquet(f"{path}/in")
    out, name = [], f"q{abs(hash(str(path))) % 10**9}"
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    q = stream(source).writeStream.outputMode("update").foreachBatch(lambda df, i: out.append((i, df.collect()))).option("checkpointLocation", f"{path}/c").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination()
    return [r for _, rows in sorted(out, key=lambda x: x[0]) for r in rows]


def test_profiles_equal_the_batch_form(spark, tmp_path):
    last = {r.domain_id: r for r in run(spark, folds.profiles, tmp_path, facts(), SCHEMA)}
    batch = {r.domain_id: r for r in health.profiles(spark.createDataFrame(facts(), SCHEMA)).collect()}
    assert last.keys() == batch.keys()
    for k, r in batch.items():
        assert r.facts == last[k].facts and r.moved_to == last[k].moved_to
        for c in folds._SUMS:
            assert r[c] == pytest.approx(last[k][c], abs=1e-9)


@settings(max_examples=40, deadline=None)
@given(st.permutations(range(12)))
def test_fold_does_not_depend_on_order(order):
    rows = pd.DataFrame([(f[1].timestamp(), *f[2:]) for f in facts(12, 7)], columns=["t", "capability", "class", "moved_to"])
    one, two = folds.fold(None, rows), folds.fold(None, rows.iloc[list(order)])
    assert [x for x in one if isinstance(x, str)] == [x for x in two if isinstance(x, str)]
    assert all(a == pytest.approx(b, rel=1e-9, abs=1e-12) for a, b in zip(one, two, strict=True) if isinstance(a, float))


def test_duplicates_and_sightings(spark, tmp_path):
    rng = random.Random(5)
    rows = [(f"e{i % 50}", f"u{i % 50 % 7}", f"r{i % 50 % 3}", START + timedelta(minutes=i % 50)) for i in range(120)]
    rng.shuffle(rows)
    schema = "event_id string, url_id string, revision_id string, at timestamp"
    kept = run(spark, lambda s: folds.once(s, "event_id", "at"), tmp_path / "a", rows, schema)
    assert sorted(r.event_id for r in kept) == sorted({r[0] for r in rows})
    seen = {(r.url_id, r.revision_id): r for r in run(spark, folds.revision_sightings, tmp_path / "b", rows, schema)}
    batch = distinct_revisions(spark.createDataFrame(rows, schema), ["url_id"], "revision_id", "at").withColumn("a", F.col("first_seen").cast("double")).withColumn("b", F.col("last_seen").cast("double")).collect()
    assert {(r.url_id, r.revision_id): (r.a, r.b, r.sightings) for r in batch} == {k: (r.first_seen, r.last_seen, r.sightings) for k, r in seen.items()}


def test_backoff_and_upsert(spark, tmp_path):
    rows = [(1, START, None), (1, START + timedelta(minutes=5), None), (1, START + timedelta(hours=3), 500.0), (2, START, None)]
    last = {r.domain_id: r for r in run(spark, folds.rate_limit_backoff, tmp_path / "x", rows, "domain_id long, at timestamp, retry_after double", split=1)}
    assert (last[1].strikes, last[1].wait_s, last[2].strikes, last[2].wait_s) == (1, 500.0, 1, 30.0)
    write, read = folds.upsert_latest(str(tmp_path / "t"), ["k"], "v")
    for i, data in enumerate([[("a", 1, "x"), ("b", 5, "y")], [("a", 3, "z"), ("b", 2, "w")]]):
        for _ in range(2):  # a batch that is run again changes nothing
            write(spark.createDataFrame(data, "k string, v int, s string"), i)
    assert {tuple(r) for r in read(spark).collect()} == {("a", 3, "z"), ("b", 5, "y")}
