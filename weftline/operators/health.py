"""Source health: facts of attempts, decayed weights of each source, state and advice.

A profile is a sum of exp(-(T - t) / tau) over a source's facts, T being its last fact: addition in any order gives the
same, so the batch form is one aggregation with map-side combine, and the streaming form (``streaming.folds``) keeps
the same numbers as state.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HOUR, DAY = 3600.0, 86400.0
CLASSES = ("ok", "moved", "http_error", "blocked", "unreachable")


@dataclass(frozen=True)
class Policy:
    """Fixed values of the health rules, in seconds and shares."""

    tau: float = 24 * HOUR
    tau_cap: float = 7 * DAY
    evidence_n: int = 3
    evidence_within: float = 12 * HOUR
    dominance: float = 0.8
    active_window: float = 24 * HOUR
    probe_min: float = 6 * HOUR
    probe_max: float = 7 * DAY
    probe_age_fraction: float = 0.25
    http_retest: float = 7 * DAY

    def evidence(self, tau: float) -> float:
        return 1 + (self.evidence_n - 1) * math.exp(-self.evidence_within / tau)


def classify(outcome: Column, http_status: Column, detail: Column, requested_site: Column, landed_site: Column) -> Column:
    """(class, moved_to) of one attempt."""
    code = F.regexp_extract(F.coalesce(detail, F.lit("")), "(?:^|;)outcome=([^;]*)", 1)
    moved = landed_site.isNotNull() & requested_site.isNotNull() & (landed_site != requested_site)
    failed = outcome.isin("timeout", "dns_failure", "connection_failure", "tls_failure")
    answered = (outcome == "response") & http_status.isNotNull()
    kind = (
        F.when(moved, "moved")
        .when(outcome == "blocked", "blocked")
        .when(failed & code.isin("redirect_error", "invalid_response"), "other")
        .when(failed, "unreachable")
        .when(answered & (code == "needs_js"), "needs_js")
        .when(answered & (http_status.between(200, 299) | (http_status == 304)), "ok")
        .when(answered & (http_status >= 400), "http_error")
        .otherwise("other")
    )
    return F.struct(kind.alias("class"), F.when(moved, landed_site).alias("moved_to"))


def profiles(facts: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """One profile for each domain of facts (domain_id, at, capability, class, moved_to)."""
    seconds = F.col("at").cast("timestamp").cast("double")
    last = facts.groupBy("domain_id").agg(F.max(seconds).alias("_last"))
    aged = facts.withColumn("_t", seconds).join(last, "domain_id").withColumn("_w", F.exp((F.col("_t") - F.col("_last")) / policy.tau)).withColumn("_c", F.exp((F.col("_t") - F.col("_last")) / policy.tau_cap))
    health = F.when(F.col("class") == "needs_js", "ok").otherwise(F.col("class"))
    http, answered = F.col("capability") == "http", F.col("class").isin("ok", "needs_js")
    total = lambda weight, where: F.coalesce(F.sum(F.when(where, F.col(weight))), F.lit(0.0))
    return aged.groupBy("domain_id").agg(
        F.max("at").alias("ref_at"),
        *[total("_w", health == c).alias(f"w_{c}") for c in CLASSES],
        total("_c", http & (F.col("class") == "ok")).alias("http_ok"),
        total("_c", http & (F.col("class") == "needs_js")).alias("http_needs_js"),
        total("_c", (F.col("capability") == "browser") & answered).alias("browser_ok"),
        F.count(F.lit(1)).alias("facts"),
        F.min("at").alias("first_seen"),
        F.max(F.when(answered, F.col("at"))).alias("last_ok"),
        F.max("at").alias("last_attempt"),
        F.max(F.when(http, F.col("at"))).alias("last_http_attempt"),
        F.max(F.when(F.col("moved_to").isNotNull(), F.struct("at", "moved_to")))["moved_to"].alias("moved_to"),
    )


def assess(profile: DataFrame, now: Column, policy: Policy = Policy()) -> DataFrame:
    """State of each profile at an instant, with decayed weights, capability, and when to probe next."""
    secs = lambda c: c.cast("timestamp").cast("double")
    age = F.greatest(F.lit(0.0), secs(now) - secs(F.col("ref_at")))
    rows = profile.withColumns({f"w_{c}": F.col(f"w_{c}") * F.exp(-age / policy.tau) for c in CLASSES})
    rows = rows.withColumns({c: F.col(c) * F.exp(-age / policy.tau_cap) for c in ("http_ok", "http_needs_js", "browser_ok")}).withColumn("_cap", F.exp(-age / policy.tau_cap))
    total = sum((F.col(f"w_{c}") for c in CLASSES), F.lit(0.0))
    state = F.when(secs(now) - secs(F.col("last_ok")) <= policy.active_window, "active")
    for c, name in (("moved", "moved"), ("blocked", "blocked"), ("unreachable", "unreachable"), ("http_error", "error")):
        state = state.when((F.col(f"w_{c}") >= policy.evidence(policy.tau)) & (F.col(f"w_{c}") >= policy.dominance * total), name)
    browser = (F.col("http_needs_js") >= policy.evidence(policy.tau_cap)) & (F.col("http_needs_js") >= F.col("http_ok")) & (F.col("browser_ok") >= F.col("_cap")) & (secs(now) - secs(F.col("last_http_attempt")) < policy.http_retest)
    wait = F.least(F.greatest((secs(now) - secs(F.coalesce("last_ok", "first_seen"))) * policy.probe_age_fraction, F.lit(policy.probe_min)), F.lit(policy.probe_max))
    rows = rows.withColumn("state", state.otherwise("degraded")).withColumn("capability", F.when(browser, "browser").otherwise("http")).withColumn("_due", secs(F.col("last_attempt")) + wait)
    negative = F.col("state").isin("moved", "blocked", "unreachable", "error")
    return rows.withColumn("probe", negative & (secs(now) >= F.col("_due"))).withColumn("admit", ~negative | F.col("probe")).withColumn("next_probe_at", F.when(negative, F.timestamp_micros((F.col("_due") * 1e6).cast("long")))).drop("_cap", "_due")
