import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from weftline.sources.export import current, export, revisions
from weftline.sources.mappers import map_rows
from weftline.sources.view import ExportView, write_tsv


def ref(url):
    return {"url": url, "url_id": "url_" + "0" * 31 + str(len(url) % 10), "domain_id": "dom_" + "1" * 32}


def attempt(i, **more):
    return json.dumps({"fetch_attempt_id": f"att_{i}", "requested": ref(f"https://www.a.example/{i}"), "capability": "http", "finished_at": f"2026-06-0{1 + i % 4}T12:00:00Z", "outcome": "response", "http_status": 200, "bytes_received": 10 * i} | more)


def extract(i, links):
    return json.dumps({"page": ref(f"https://a.example/{i}"), "page_version_id": f"pgv_{i}", "links": links, "media": [], "stats": {"text_chars": 5, "truncated": ["links"]}})


@pytest.fixture(scope="module")
def raw(spark):
    attempts = [(f"att_{i}", attempt(i)) for i in range(6)] + [("att_0", attempt(0)), ("x", "{not json"), ("y", json.dumps({"fetch_attempt_id": "y"})), ("z", None)]
    links = [{"target": ref("https://b.example/x"), "relation": "anchor", "nofollow": True}, {"target": ref("https://cdn.a.example/y"), "relation": "iframe"}]
    extracts = [("pgv_1", datetime(2026, 6, 1), extract(1, links)), ("pgv_2", datetime(2026, 6, 2), extract(2, [{"target": {"url": None}, "relation": "anchor"}])), ("pgv_3", None, extract(3, []))]
    domains = [("1" * 32, "A.Example.", datetime(2026, 6, 1)), ("2" * 32, "", None)]
    return {
        "fetch_attempts": spark.createDataFrame(attempts, "fetch_attempt_id string, doc string"),
        "page_extracts": spark.createDataFrame(extracts, "page_version_id string, observed_at timestamp, doc string"),
        "domains": spark.createDataFrame(domains, "domain_id string, host string, first_seen timestamp"),
    }


NAMES = ["fetch_attempts", "page_extracts", "page_links", "domains", "matches"]


def test_rejects_have_reasons(raw):
    good, bad = map_rows("fetch_attempts", raw["fetch_attempts"])
    assert good.count() == 7
    assert sorted(r.reject_reason for r in bad.collect()) == ["doc is not a JSON object", "doc is null", "missing requested.url_id"]
    links, refused = map_rows("page_links", raw["page_extracts"])
    assert [(r.ordinal, r.target_site, r.cross_site, r.nofollow) for r in links.orderBy("ordinal").collect()] == [(0, "b.example", True, True), (1, "a.example", False, False)]
    assert [r.reject_reason for r in refused.collect()] == ["bad element of links"]


def test_publish_read_and_validate(spark, raw, tmp_path):
    root = str(tmp_path)
    first = export(spark, raw, root, NAMES, until=datetime(2026, 6, 4))
    counts = {k: tuple(v.get(c) for c in ("source_rows", "rejected", "out_of_window", "duplicates", "written")) for k, v in first["datasets"].items()}
    assert counts == {"fetch_attempts": (10, 3, 1, 1, 5), "page_extracts": (3, 0, 0, 0, 3), "page_links": (3, 1, 0, 0, 2), "domains": (2, 1, 0, 0, 1), "matches": (None,) * 5}
    assert first["status"] == "published" and export(spark, raw, root, NAMES, until=datetime(2026, 6, 4))["status"] == "unchanged"
    view = ExportView(spark, root, check_hashes=True)
    assert view.validate() == [] and view.missing == {"matches": "no table matches_by_content"}
    assert [tuple(r) for r in view.sql("SELECT date, count(*) AS n FROM page_extracts WHERE text_chars = :n GROUP BY ALL ORDER BY date", n=5).collect()] == [("2026-06-01", 1), ("2026-06-02", 1), ("unknown", 1)]
    with pytest.raises(LookupError):
        view.table("matches")
    second = export(spark, raw, root, NAMES)
    assert revisions(root) == ["rev-0001", "rev-0002"] and current(root).name == second["revision"] == "rev-0002"
    write_tsv(view.table("domains"), str(tmp_path / "out"))
    assert spark.read.csv(str(tmp_path / "out"), sep="\t", header=True).first().host == "a.example"


def test_conflicts_and_damage_are_refused(spark, raw, tmp_path):
    other = raw["fetch_attempts"].unionByName(spark.createDataFrame([("att_0", attempt(0, outcome="timeout"))], "fetch_attempt_id string, doc string"))
    with pytest.raises(ValueError, match="different rows"):
        export(spark, {"fetch_attempts": other}, str(tmp_path), ["fetch_attempts"])
    assert revisions(tmp_path) == []
    export(spark, raw, str(tmp_path), ["domains"])
    file = next((tmp_path / "rev-0001").rglob("*.parquet"))
    file.write_bytes(file.read_bytes()[:-1])
    with pytest.raises(FileNotFoundError):
        ExportView(spark, str(tmp_path))


def test_digest_ignores_order(spark):
    from weftline.operators.aggregates import content_digest

    a = spark.range(50).select("id", F.when(F.col("id") % 7 > 0, F.col("id").cast("string")).alias("s"))
    assert content_digest(a, ["id", "s"]).first() == content_digest(a.orderBy(F.desc("id")).repartition(5), ["id", "s"]).first()
    assert content_digest(a, ["id", "s"]).first() != content_digest(a.where("id > 0"), ["id", "s"]).first()
