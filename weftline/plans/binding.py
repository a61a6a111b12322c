"""The driver's tables read as the catalog's datasets.

``DATASETS`` holds one SELECT for each dataset over the driver's tables, in the SQL that Spark and DuckDB share. Spark
queries run library operators over ``view(spark, dir).table(name)``; SQL for the same results starts with ``ctes(...)``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "pages", "documents", "labels", "embeddings", "benchmark", "conversations")

_HOST = "lower(regexp_extract(url, '^https?://([^/?#:]+)', 1))"

DATASETS: dict[str, str] = {
    "urls": f"""SELECT concat('url_', CAST(page_id AS STRING)) AS url_id, url, concat('dom_', {_HOST}) AS domain_id, {_HOST} AS host,
        CASE WHEN page_id % 17 = 0 THEN NULL ELSE {_HOST} END AS site FROM pages""",
    "domains": f"SELECT DISTINCT concat('dom_', {_HOST}) AS domain_id, {_HOST} AS host, {_HOST} AS site FROM pages",
    "fetch_attempts": """SELECT concat('att_', CAST(event_id AS STRING)) AS fetch_attempt_id, concat('dom_', CAST(user_id AS STRING)) AS domain_id,
        concat('site', CAST(user_id AS STRING)) AS site, CASE WHEN event_id % 3 = 0 THEN 'browser' ELSE 'http' END AS capability,
        CASE event_type WHEN 'click' THEN 'response' WHEN 'view' THEN 'response' WHEN 'error' THEN 'timeout' WHEN 'signup' THEN 'blocked' ELSE 'dns_failure' END AS outcome,
        CASE event_type WHEN 'click' THEN 200 WHEN 'view' THEN CASE WHEN event_id % 5 = 0 THEN 404 ELSE 200 END ELSE NULL END AS http_status,
        CAST(floor(value * 100) AS BIGINT) AS bytes_received, ts AS finished_at, substr(CAST(ts AS STRING), 1, 10) AS date FROM events""",
    "page_observations": """SELECT concat('obs_', CAST(l_orderkey AS STRING), '_', CAST(l_linenumber AS STRING)) AS observation_id,
        concat('url_', CAST(l_orderkey % 300 AS STRING)) AS url_id, concat('h', CAST(l_suppkey % 40 AS STRING), '.example.com') AS site,
        concat('url_', CAST(l_orderkey % 290 AS STRING)) AS final_url_id, concat('https://h', CAST(l_partkey % 40 AS STRING), '.example.com/', CAST(l_orderkey % 290 AS STRING)) AS final_url,
        CASE WHEN l_partkey % 41 = 0 THEN NULL ELSE concat('h', CAST(l_partkey % 40 AS STRING), '.example.com') END AS final_site,
        CASE l_returnflag WHEN 'R' THEN 404 WHEN 'A' THEN 301 ELSE 200 END AS http_status, l_shipdate AS observed_at,
        CASE WHEN l_linenumber = 7 THEN 'unknown' ELSE substr(CAST(l_shipdate AS STRING), 1, 10) END AS date,
        concat('pgv_', CAST(l_orderkey % 400 AS STRING)) AS page_version_id FROM lineitem""",
    "page_extracts": f"""SELECT concat('pgv_', CAST(page_id AS STRING)) AS page_version_id, concat('url_', CAST(page_id % 200 AS STRING)) AS url_id, url, {_HOST} AS site,
        CAST(length(html) AS INT) AS text_chars, CASE WHEN page_id % 4 = 0 THEN 'article' WHEN page_id % 4 = 1 THEN 'website' ELSE NULL END AS og_type,
        regexp_extract(html, 'lang="([a-z]+)"', 1) AS lang, CAST(page_id % 9 AS INT) AS truncations, concat('s', CAST(page_id % 6 AS STRING)) AS hash_structural FROM pages""",
    "page_media_refs": """SELECT concat('pgv_', CAST(l_orderkey % 400 AS STRING)) AS page_version_id, CAST(l_linenumber AS INT) AS ordinal,
        concat('url_', CAST(l_orderkey % 300 AS STRING)) AS url_id, concat('h', CAST(l_suppkey % 40 AS STRING), '.example.com') AS site,
        concat('https://cdn', CAST(l_partkey % 7 AS STRING), '.example.net/', CAST(l_partkey AS STRING)) AS locator_url,
        concat('cdn', CAST(l_partkey % 7 AS STRING), '.example.net') AS locator_site, l_shipdate AS observed_at,
        CASE l_returnflag WHEN 'N' THEN 'video' WHEN 'A' THEN 'audio' ELSE 'image' END AS kind, CASE l_linestatus WHEN 'O' THEN 'element' ELSE 'script' END AS method FROM lineitem""",
    "page_links": """SELECT concat('pgv_', CAST(o_orderkey AS STRING)) AS page_version_id, CAST(0 AS INT) AS ordinal, concat('url_', CAST(o_orderkey % 250 AS STRING)) AS url_id,
        concat('h', CAST(o_custkey % 40 AS STRING), '.example.com') AS site,
        CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE concat('h', CAST(o_orderkey % 40 AS STRING), '.example.com') END AS target_site,
        CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_custkey % 40 <> o_orderkey % 40 END AS cross_site,
        CASE WHEN o_orderstatus = 'F' THEN 'anchor' ELSE 'iframe' END AS relation, o_orderdate AS observed_at FROM orders""",
    "media": "SELECT concat('med_', CAST(p_partkey AS STRING)) AS media_id, concat('https://cdn', CAST(p_partkey % 7 AS STRING), '.example.net/', CAST(p_partkey AS STRING)) AS locator_url, concat('cdn', CAST(p_partkey % 7 AS STRING), '.example.net') AS locator_site FROM part",
    "media_observations": """SELECT concat('obs_', CAST(l_orderkey AS STRING), '_', CAST(l_linenumber AS STRING)) AS page_observation_id, concat('med_', CAST(l_partkey AS STRING)) AS media_id,
        l_shipdate AS observed_at, concat('https://h', CAST(l_suppkey % 40 AS STRING), '.example.com/', CAST(l_orderkey % 300 AS STRING)) AS page_url,
        concat('url_', CAST(l_orderkey % 300 AS STRING)) AS page_url_id, CASE WHEN l_suppkey % 23 = 0 THEN NULL ELSE concat('h', CAST(l_suppkey % 40 AS STRING), '.example.com') END AS page_site,
        CASE l_returnflag WHEN 'N' THEN 'ok' WHEN 'A' THEN 'forbidden' ELSE 'gone' END AS probe_status,
        CASE WHEN l_partkey % 7 = 0 THEN NULL ELSE concat('cnt_', CAST(l_partkey AS STRING)) END AS content_id, 'sha256' AS content_scheme FROM lineitem""",
    "targets": "SELECT concat('tgt_', CAST(c_custkey AS STRING)) AS target_id, c_name AS title, CASE WHEN c_acctbal > 8000 THEN 1 ELSE 0 END AS retired FROM customer WHERE c_acctbal > 0",
    "matches": """SELECT concat('mat_', CAST(o_orderkey AS STRING)) AS match_id, concat('cnt_', CAST(o_custkey AS STRING)) AS content_id, concat('tgt_', CAST(o_custkey AS STRING)) AS target_id,
        CASE o_orderstatus WHEN 'F' THEN 'confirmed' WHEN 'O' THEN 'probable' ELSE 'rejected' END AS verdict, CAST(o_orderkey % 100 AS DOUBLE) / 100 AS confidence, o_orderdate AS decided_at FROM orders""",
    "evidence_candidates": """SELECT concat('evd_', CAST(o_orderkey AS STRING)) AS evidence_id, concat('mat_', CAST(o_orderkey AS STRING)) AS match_id, concat('tgt_', CAST(o_custkey AS STRING)) AS target_id,
        CASE WHEN o_orderpriority < '3' THEN 'complete' ELSE 'partial' END AS status, o_orderdate AS collected_at FROM orders""",
    "evidence_sources": """SELECT concat('evd_', CAST(l_orderkey AS STRING)) AS evidence_id, CAST(l_linenumber AS INT) AS ordinal, concat('url_', CAST(l_partkey % 300 AS STRING)) AS page_url_id,
        CASE l_linestatus WHEN 'O' THEN 'observed' ELSE 'co-occurrence' END AS basis, l_shipdate AS sighted_at FROM lineitem""",
    "evidence_versions": """SELECT concat('evd_', CAST(l_orderkey AS STRING)) AS evidence_id, CAST(l_linenumber AS INT) AS version,
        CASE (l_orderkey + l_linenumber) % 4 WHEN 0 THEN 'final' WHEN 1 THEN 'draft' ELSE 'void' END AS status FROM lineitem""",
    "campaigns": """SELECT concat('camp_', CAST(c_nationkey AS STRING)) AS campaign_id, concat('tgt_', CAST(c_custkey AS STRING)) AS target_id, n_name AS name,
        CASE WHEN c_nationkey % 2 = 0 THEN CAST('1995-06-01' AS TIMESTAMP) ELSE NULL END AS since FROM customer JOIN nation ON c_nationkey = n_nationkey""",
}


def ctes(*names: str) -> str:
    """A WITH clause of datasets for DuckDB, in which the driver's tables are views."""
    return "WITH " + ",\n".join(f"{n} AS ({DATASETS[n]})" for n in names)


class TableView:
    """Datasets of one directory of driver tables as DataFrames; columns that a query does not use are never read."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self.available = set(DATASETS)

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def table(self, name: str) -> DataFrame:
        query = DATASETS[name]
        used = [t for t in TABLES if f" {t} " in f"{query} " or f" {t}\n" in query]
        # brackets of the SQL's own are doubled: the formatter reads them
        text = query.replace("{", "{{").replace("}", "}}")
        for t in used:
            for word in ("FROM", "JOIN"):
                text = text.replace(f"{word} {t} ", f"{word} {{{t}}} ")
                if text.endswith(f"{word} {t}"):
                    text = text[: -len(t)] + f"{{{t}}}"
        return self.spark.sql(text, **{t: self.raw(t) for t in used})

    def sql(self, query: str, *names: str) -> DataFrame:
        """A query over datasets named in braces."""
        return self.spark.sql(query, **{n: self.table(n) for n in names})
