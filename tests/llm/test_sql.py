from pathlib import Path

import duckdb
import pytest

from weftline.llm import registry

DATA = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def odd_tables(spark, corpus, tmp_path_factory):
    """The shared corpus of odd rows, and items with nulls, repeats and clashing columns."""
    out = tmp_path_factory.mktemp("odd")
    spark.createDataFrame(corpus, "doc_id long, text string").coalesce(2).write.parquet(f"{out}/documents.parquet")
    items = [(1, corpus[3][1]), (2, " ".join(corpus[70][1].split()[40:52])), (3, "ONE"), (3, "one"), (None, "w1 w2"), (4, None), (5, "")]
    spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string").coalesce(1).write.parquet(f"{out}/benchmark.parquet")
    return str(out)


@pytest.mark.parametrize("name", sorted(registry.oracles()))
@pytest.mark.parametrize("tables", ["own", "driver"])
def test_equals_sql(spark, odd_tables, name, tables):
    if tables == "driver" and not DATA.exists():
        pytest.skip("no tables here")
    sf_dir = odd_tables if tables == "own" else str(DATA)
    con = duckdb.connect()
    for table in ("documents", "benchmark"):
        path = f"{sf_dir}/{table}.parquet"
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{path}{'/*.parquet' if Path(path).is_dir() else ''}'")
    want = con.execute(registry.oracles()[name])
    columns = [d[0] for d in want.description]
    got = registry.query(name)(spark, sf_dir)
    assert sorted(got.columns) == sorted(columns)
    assert sorted(map(str, (tuple(r) for r in got.select(*columns).collect()))) == sorted(map(str, want.fetchall()))


def test_every_query_is_there():
    assert all(callable(registry.query(name)) for name in registry.MODULES) and registry.oracles().keys() <= registry.MODULES.keys()
