"""Feedback of matches on sources: decayed value, boosts, capability, and priorities."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DAY = 86400.0


@dataclass(frozen=True)
class Policy:
    """Fixed values of the feedback rules."""

    tau: float = 14 * DAY
    saturation: float = 2.0
    max_source_boost: int = 15
    max_pattern_boost: int = 5
    max_total_boost: int = 20
    neutral_value: float = 0.05
    min_pattern_support: int = 2
    probable_weight: float = 0.5
    active_weight: float = 1.0
    unknown_weight: float = 0.5
    retired_weight: float = 0.1
    min_capability_evidence: float = 1.0
    explore_percent: int = 20
    max_age: float = 90 * DAY


def strength(now: Column, p: Policy = Policy()) -> Column:
    """Decayed strength of one row (decided_at, confidence, verdict); the future counts as fresh."""
    age = now.cast("timestamp").cast("double") - F.col("decided_at").cast("timestamp").cast("double")
    sure = F.when(F.isnan("confidence") | F.col("confidence").isNull(), 0.0).otherwise(F.least(F.greatest(F.col("confidence"), F.lit(0.0)), F.lit(1.0)))
    weight = F.when(F.col("verdict") == "confirmed", 1.0).otherwise(p.probable_weight)
    return F.when(age > p.max_age, 0.0).otherwise(sure * weight * F.exp(-F.greatest(age, F.lit(0.0)) / p.tau))


def values(evidence: DataFrame, keys: list[str], p: Policy = Policy()) -> DataFrame:
    """Value of each key: the best strength of every target, weighted by the target's relevance (``_s``, ``relevance``)."""
    weight = F.when(F.col("relevance") == "active", p.active_weight).when(F.col("relevance") == "retired", p.retired_weight).otherwise(p.unknown_weight)
    best = evidence.groupBy(*keys, "target_id").agg(F.max("_s").alias("_s"), F.max(weight).alias("_w"))
    return best.groupBy(*keys).agg(F.sum(F.col("_w") * F.col("_s")).alias("value"), F.count(F.lit(1)).alias("targets"))


def _boost(value: Column, most: int, p: Policy) -> Column:
    return F.bround(most * F.when(value < p.neutral_value, 0.0).otherwise(1 - F.exp(-value / p.saturation))).cast("int")


def assess_sources(evidence: DataFrame, now: Column, p: Policy = Policy()) -> DataFrame:
    """Value, boost, targets and matches of each domain."""
    rows = evidence.withColumn("_s", strength(now, p))
    counts = rows.groupBy("domain_id").agg(F.countDistinct("match_id").alias("matches"), F.max("decided_at").alias("last_match_at"))
    return values(rows, ["domain_id"], p).join(counts, "domain_id").withColumn("boost", _boost(F.col("value"), p.max_source_boost, p))


def assess_patterns(evidence: DataFrame, now: Column, p: Policy = Policy()) -> DataFrame:
    """Boost of each URL template of a domain that enough different pages support."""
    rows = evidence.where("template is not null").withColumn("_s", strength(now, p))
    support = rows.groupBy("domain_id", "template").agg(F.countDistinct("page_observation_id").alias("support")).where(F.col("support") >= p.min_pattern_support)
    return values(rows, ["domain_id", "template"], p).join(support, ["domain_id", "template"]).withColumn("boost", _boost(F.col("value"), p.max_pattern_boost, p)).where("boost > 0")


def capability_weights(evidence: DataFrame, now: Column, p: Policy = Policy()) -> DataFrame:
    """Decayed strength by capability: the best of each page, summed."""
    rows = evidence.where("capability is not null").withColumn("_s", strength(now, p))
    pages = rows.groupBy("domain_id", "capability", "page_observation_id").agg(F.max("_s").alias("_s"))
    return pages.groupBy("domain_id").agg(*[F.coalesce(F.sum(F.when(F.col("capability") == c, F.col("_s"))), F.lit(0.0)).alias(c) for c in ("http", "browser")])


def prefers_browser(http: Column, browser: Column, explore: Column, p: Policy = Policy()) -> Column:
    return (browser >= p.min_capability_evidence) & ~(http >= 0.25 * browser) & ~explore


def priority(base: Column, source_boost: Column, pattern_boost: Column, p: Policy = Policy()) -> Column:
    """Base and bounded boosts, from 0 to 100."""
    total = F.least(F.coalesce(source_boost, F.lit(0)) + F.coalesce(pattern_boost, F.lit(0)), F.lit(p.max_total_boost))
    return F.least(F.greatest(base + total, F.lit(0)), F.lit(100))
