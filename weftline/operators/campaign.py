"""Statistics of campaigns in long form (campaign_id, measure, key, value), each record counted once."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCHEMA = ("campaign_id", "measure", "key", "value")


def months(since: Column, until: Column) -> Column:
    """First days of the months from ``since`` to ``until``, both included; empty if ``until`` lies before."""
    first, last = F.trunc(since, "month"), F.trunc(until, "month")
    return F.when(first <= last, F.sequence(first, last, F.expr("interval 1 month"))).otherwise(F.array().cast("array<date>"))


def _counted(rows: DataFrame, total: str, by: str | None = None, column: str | None = None) -> DataFrame:
    """A total of each campaign's rows, and their numbers by a column; a null there counts in the total alone."""
    if by is None:
        return rows.groupBy("campaign_id").agg(F.count(F.lit(1)).alias("value")).select("campaign_id", F.lit(total).alias("measure"), F.lit(None).cast("string").alias("key"), "value")
    each = rows.groupBy("campaign_id", F.col(column).cast("string").alias("_k")).agg(F.count(F.lit(1)).alias("_n"))
    kinds = F.array(F.struct(F.lit(total).alias("measure"), F.lit(None).cast("string").alias("key")), F.when(F.col("_k").isNotNull(), F.struct(F.lit(by).alias("measure"), F.col("_k").alias("key"))))
    spread = each.select("campaign_id", F.explode(F.filter(kinds, lambda x: x.isNotNull())).alias("_m"), "_n")
    return spread.groupBy("campaign_id", "_m").agg(F.sum("_n").alias("value")).select("campaign_id", "_m.measure", "_m.key", "value")


def statistics(campaigns: DataFrame, targets: DataFrame, matches: DataFrame, candidates: DataFrame, versions: DataFrame, sources: DataFrame, until: Column) -> DataFrame:
    """Counts of each campaign's targets, matches, evidence and sources.

    Campaigns: campaign_id, target_id, since (null: from the start). Matches count from the month of ``since`` to ``until``,
    each match_id once with its latest decision. A candidate's status is that of its latest collection, a finished one's that
    of its highest version. Sources count once by (page_url_id, ordinal), a page once, with the site that sorts last."""
    own = campaigns.where("target_id is not null").groupBy("campaign_id", "target_id").agg(F.min("since").alias("since"))
    known = targets.select(F.col("target_id").alias("_t")).where("_t is not null").distinct()
    listed = own.join(known, F.col("target_id") == F.col("_t"), "left").withColumn("_known", F.when(F.col("_t").isNull(), "not_in_projection").otherwise("registered"))
    inside = lambda at: (F.col(at) <= until) & (F.col("since").isNull() | (F.col(at) >= F.trunc("since", "month")))
    latest = lambda rows, key, at, value: rows.groupBy("campaign_id", key).agg(F.max(F.struct(at, value))[value].alias(value))
    met = latest(matches.join(own, "target_id").where(inside("decided_at")), "match_id", "decided_at", "verdict")
    held = candidates.join(own, "target_id").where(inside("collected_at"))
    evidence = held.groupBy("campaign_id", "evidence_id").agg(F.max(F.struct("collected_at", "status", "match_id")).alias("_e")).select("campaign_id", "evidence_id", "_e.status", "_e.match_id")
    newest = versions.groupBy("evidence_id").agg(F.max(F.struct("version", "status"))["status"].alias("_final"), F.count_distinct("version").alias("_versions"))
    finished = evidence.join(newest, "evidence_id")
    replaced = finished.groupBy("campaign_id").agg(F.sum(F.col("_versions") - 1).alias("value")).select("campaign_id", F.lit("superseded_versions").alias("measure"), F.lit(None).cast("string").alias("key"), "value")
    seen = sources.join(evidence.select("campaign_id", "evidence_id"), "evidence_id")
    records = seen.groupBy("campaign_id", "page_url_id", "ordinal").agg(F.max(F.struct("basis", "site")).alias("_s")).select("campaign_id", "page_url_id", "_s.*")
    pages = records.groupBy("campaign_id", "page_url_id").agg(F.max("site").alias("site"))
    parts = [
        _counted(listed, "targets", "targets_by_state", "_known"),
        _counted(met, "matches", "matches_by_verdict", "verdict"),
        _counted(met.join(evidence.select("campaign_id", "match_id").distinct(), ["campaign_id", "match_id"], "left_anti"), "matches_without_candidate"),
        _counted(evidence, "candidates", "candidates_by_status", "status"),
        _counted(finished, "finalized", "finalized_by_status", "_final"),
        replaced,
        _counted(records, "source_records", "sources_by_basis", "basis"),
        _counted(pages, "pages", "pages_by_domain", "site"),
    ]
    return reduce(DataFrame.unionByName, parts).select(*SCHEMA)
