"""Reconciliation ledger: every source event of an edge should have its effect within a time of grace."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def edge_results(sources: DataFrame, effects: DataFrame, now: Column, grace_seconds: float, started: Column) -> DataFrame:
    """One row for each edge of sources (edge, key, observed) and effects (edge, key, at, effect).

    Both sides are brought to one row a key before they meet, so copies of an event never multiply."""
    secs = lambda c: c.cast("timestamp").cast("double")
    a = sources.groupBy("edge", "key").agg(F.min("observed").alias("_first"))
    b = effects.groupBy("edge", "key").agg(F.max("at").alias("_last"), F.countDistinct("effect").alias("_effects"))
    both = a.join(b, ["edge", "key"], "full")
    has_a, has_b = F.col("_first").isNotNull(), F.col("_effects").isNotNull()
    age = secs(now) - secs(F.col("_first"))
    late = has_a & ~has_b & (age > grace_seconds)
    return both.groupBy("edge").agg(
        F.count_if(has_a).alias("sources"),
        F.count_if(has_a & has_b).alias("satisfied"),
        F.count_if(has_a & ~has_b & (age <= grace_seconds)).alias("pending"),
        F.count_if(late).alias("unaccounted"),
        F.max(F.when(late, age)).alias("oldest_unaccounted_s"),
        F.count_if(~has_a & has_b & (F.col("_last") >= started)).alias("orphans"),
        F.count_if(F.col("_effects") > 1).alias("duplicate_effects"),
    )


def redeliveries(events: DataFrame) -> DataFrame:
    """Deliveries beyond the first of each event, by type; only types that have some."""
    per_event = events.groupBy("event_type", "event_id").agg((F.count(F.lit(1)) - 1).alias("_more"))
    return per_event.groupBy("event_type").agg(F.sum("_more").alias("redelivered")).where("redelivered > 0")


def stage_counts(events: DataFrame) -> DataFrame:
    return events.select("event_type", "event_id").distinct().groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
