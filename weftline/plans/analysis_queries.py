"""Decisions, media and evidence state, rules, extraction and clusters over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions import urls as U
from weftline.functions.extraction import extract_page
from weftline.operators import cluster as C
from weftline.operators import decisions as D
from weftline.operators import rules as R
from weftline.plans.binding import TableView, ctes


def _t(spark, sf_dir, name) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _attempts(spark, sf_dir):
    rows = TableView(spark, sf_dir).table("fetch_attempts").select(F.when((F.col("outcome") == "response") & (F.col("http_status") >= 400), "http_error").when(F.col("outcome") == "response", "ok").otherwise(F.col("outcome")).alias("o"), F.col("http_status").alias("s"), F.col("capability").alias("q"))
    d = rows.select(D.attempt_decision(F.col("o"), F.col("s"), F.col("q"), F.lit(False)).alias("d"))
    return d.groupBy("d.operation", "d.reason").agg(F.count(F.lit(1)).alias("n"))


def _encode(spark, sf_dir):
    seen = TableView(spark, sf_dir).table("media_observations").select("content_id", "media_id", F.col("observed_at").alias("at"))
    claimed = _t(spark, sf_dir, "supplier").select(F.concat(F.lit("cnt_"), F.pmod("s_suppkey", F.lit(20)).cast("string")).alias("content_id")).distinct()
    ready = _t(spark, sf_dir, "nation").select(F.concat(F.lit("cnt_"), (F.col("n_nationkey") + 30).cast("string")).alias("content_id"))
    return D.encode_requests(seen, claimed, ready).select("content_id", "media_id", F.col("at").cast("string").alias("at"))


def _representations(spark, sf_dir):
    rows = _t(spark, sf_dir, "lineitem").select(F.pmod("l_partkey", F.lit(500)).alias("content_id"), F.col("l_linestatus").alias("spec_key"), F.when((F.col("l_returnflag") == "R") & (F.col("l_quantity") > 48), "ready").when(F.col("l_returnflag") == "A", "failed").otherwise("requested").alias("kind"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("attempt"), F.col("l_orderkey").cast("string").alias("failure"), (F.col("l_quantity") > 25).alias("retryable"), F.col("l_shipdate").alias("at"))
    return D.representation_status(rows).select("content_id", "spec_key", "state", "failure")


def _targets(spark, sf_dir):
    rows = _t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("target_id"), F.col("o_orderkey").alias("version"), F.col("o_orderpriority").alias("doc"), F.when(F.col("o_orderstatus") == "P", F.col("o_orderdate")).alias("retired_at"))
    return D.target_state(rows).select("target_id", "doc", "version", F.col("retired_at").cast("string").alias("retired_at"))


def _sources(spark, sf_dir):
    rows = _t(spark, sf_dir, "lineitem").select(F.pmod("l_suppkey", F.lit(50)).alias("match_id"), F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey").alias("page_observation_id"), F.col("l_partkey").alias("media_id"), F.when(F.col("l_quantity") >= 50, "content_verified").otherwise("locator").alias("basis"), F.col("l_shipdate").alias("sighted_at"))
    return D.evidence_sources(rows, 5).select("match_id", "ordinal", "page_observation_id", "basis", "sources_total")


def _versions(spark, sf_dir):
    v = TableView(spark, sf_dir)
    new = v.table("evidence_candidates").select("evidence_id", F.col("status").alias("digest")).distinct()
    old = v.table("evidence_versions").select("evidence_id", "version", F.when(F.col("status") == "final", "complete").otherwise(F.col("status")).alias("manifest_digest")).distinct()
    return D.version_plan(new, old)


def _rules(spark):
    rules, _ = R.parse_list(["||spam-farm.example.org^", "||cheap-pills.example.com^", "@@||blog.example.com^", "?utm_source=", "*/es/*$document", "|https://m."], "easylist", "ad")
    return R.ruleset(spark, [*rules, R.rule("operator", "host", "example.net", "content", action="allow"), R.rule("built_in", "host_label", "blog", "navigation")])


def _decisions(spark, sf_dir):
    pages = _t(spark, sf_dir, "pages").select(F.col("page_id").alias("input_id"), F.lit("link").alias("context"), "url", U.host(F.col("url")).alias("host"), F.lit("document").alias("resource_type"), F.lit(None).cast("string").alias("source_host"), F.lit(None).cast("boolean").alias("third_party"))
    return R.decide(pages, _rules(spark)).select("input_id", "classification", "action", "candidates")


def _extracts(spark, sf_dir):
    pages = _t(spark, sf_dir, "pages").select("page_id", extract_page("url", "html").alias("e"))
    return pages.select("page_id", F.size("e.links").alias("links"), F.size("e.media").alias("media"), "e.title", "e.lang", "e.text_chars", "e.elements", "e.hash_link_set", "e.hash_structural")


def _clusters(spark, sf_dir):
    v = TableView(spark, sf_dir)
    extracts = v.table("page_extracts").withColumn("observed_at", F.lit("2024-01-01"))
    pages = C.page_features(extracts, v.table("page_links"), v.table("page_media_refs")).withColumn("template", F.coalesce(U.url_shape("url")["template"], F.lit("{unparsable}")))
    tokens = C.site_tokens(pages, C.Params(min_pages=2))
    clustered, pairs = C.cluster(tokens, C.Params(min_pages=2))
    return C.assignments(clustered, pairs)


QUERIES: dict = {"attempt_decisions": _attempts, "media_encode_requests": _encode, "media_representations": _representations, "target_states": _targets, "evidence_ranked_sources": _sources, "evidence_version_plans": _versions, "rule_decisions": _decisions, "page_extraction": _extracts, "site_clusters": _clusters}

ORACLES: dict[str, str] = {
    "attempt_decisions": ctes("fetch_attempts") + """, r AS (SELECT CASE WHEN outcome = 'response' AND http_status >= 400 THEN 'http_error' WHEN outcome = 'response' THEN 'ok' ELSE outcome END AS o, http_status AS s FROM fetch_attempts)
      SELECT CASE WHEN o IN ('timeout', 'dns_failure') OR (o = 'http_error' AND (s >= 500 OR s IN (408, 429))) THEN 'fail' ELSE 'complete' END AS operation, CASE WHEN o = 'http_error' THEN 'http_' || s ELSE o END AS reason, count(*) AS n FROM r GROUP BY ALL""",
    "media_encode_requests": ctes("media_observations") + """ SELECT content_id, f.m AS media_id, CAST(f.t AS VARCHAR) AS at FROM (SELECT content_id, min({'t': observed_at, 'm': media_id}) AS f FROM media_observations WHERE content_id IS NOT NULL GROUP BY 1)
      WHERE content_id NOT IN (SELECT 'cnt_' || (s_suppkey % 20) FROM supplier) AND content_id NOT IN (SELECT 'cnt_' || (n_nationkey + 30) FROM nation)""",
    "media_representations": """WITH e AS (SELECT l_partkey % 500 AS content_id, l_linestatus AS spec_key, CASE WHEN l_returnflag = 'R' AND l_quantity > 48 THEN 'ready' WHEN l_returnflag = 'A' THEN 'failed' ELSE 'requested' END AS kind, l_orderkey * 10 + l_linenumber AS attempt, CAST(l_orderkey AS VARCHAR) AS failure FROM lineitem)
      SELECT content_id, spec_key, CASE WHEN bool_or(kind = 'ready') THEN 'ready' WHEN bool_or(kind = 'failed') THEN 'failed' ELSE 'requested' END AS state, CASE WHEN NOT bool_or(kind = 'ready') THEN max({'a': attempt, 'f': failure}) FILTER (WHERE kind = 'failed').f END AS failure FROM e GROUP BY 1, 2""",
    "target_states": "SELECT o_custkey AS target_id, arg_max(o_orderpriority, o_orderkey) AS doc, max(o_orderkey) AS version, CAST(min(o_orderdate) FILTER (WHERE o_orderstatus = 'P') AS VARCHAR) AS retired_at FROM orders GROUP BY 1",
    "evidence_ranked_sources": """SELECT match_id, CAST(r - 1 AS INTEGER) AS ordinal, page_observation_id, basis, sources_total FROM (SELECT *, row_number() OVER (PARTITION BY match_id ORDER BY basis <> 'content_verified', l_shipdate DESC, page_observation_id, l_partkey) AS r, count(*) OVER (PARTITION BY match_id) AS sources_total
      FROM (SELECT l_suppkey % 50 AS match_id, l_orderkey || '-' || l_linenumber || '-' || l_partkey AS page_observation_id, CASE WHEN l_quantity >= 50 THEN 'content_verified' ELSE 'locator' END AS basis, l_shipdate, l_partkey FROM lineitem)) WHERE r <= 5""",
    "evidence_version_plans": ctes("evidence_candidates", "evidence_versions") + """, c AS (SELECT DISTINCT evidence_id, status AS digest FROM evidence_candidates), n AS (SELECT evidence_id, max({'v': version, 'd': CASE WHEN status = 'final' THEN 'complete' ELSE status END}) AS m FROM evidence_versions GROUP BY 1)
      SELECT evidence_id, CASE WHEN m IS NULL THEN 'first' WHEN m.d = digest THEN 'idempotent' ELSE 'supersede' END AS plan, CAST(CASE WHEN m.d = digest THEN m.v ELSE coalesce(m.v, 0) + 1 END AS INTEGER) AS version, CASE WHEN m IS NOT NULL AND m.d <> digest THEN m.v END AS supersedes FROM c LEFT JOIN n USING (evidence_id)""",
}
