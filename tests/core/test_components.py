import random

from weftline.operators.components import connected_components


def brute(edges):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            a, b = sorted((find(a), find(b)))
            root[b] = a
    return {x: find(x) for x in root}


def test_equals_union_find(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(100, 160)] + [(rng.randrange(300, 500), rng.randrange(300, 500)) for _ in range(90)] + [(7, k) for k in range(8, 40)] + [(1, 1), (None, 3), (2, 1)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == brute(edges)


def test_no_edges(spark):
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_query_takes_all_rows(spark, tmp_path):
    """Edges of all quantities link."""
    from weftline.plans.operator_queries import QUERIES

    rng = random.Random(9)
    rows = [(rng.randrange(80), rng.randrange(60), float(rng.randrange(1, 51))) for _ in range(70)]
    spark.createDataFrame(rows, "l_partkey long, l_suppkey long, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = {r.node: r.component for r in QUERIES["connected_components"](spark, str(tmp_path)).collect()}
    assert got == brute([(a, b + 1_000_000_000) for a, b, _ in rows])


def test_sort_keeps_all_rows(spark, tmp_path):
    from weftline.plans.operator_queries import QUERIES

    rows = [(k, None if k % 9 == 0 else float(k * 37 % 101)) for k in range(120)]
    spark.createDataFrame(rows, "event_id long, value double").write.parquet(f"{tmp_path}/events.parquet")
    cut = [(k, v if v is not None and v > 50 else None) for k, v in rows]
    assert [tuple(r) for r in QUERIES["sort_nulls_last"](spark, str(tmp_path)).collect()] == sorted(cut, key=lambda r: (r[1] is None, r[1] or 0, r[0]))
