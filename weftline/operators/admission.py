"""Admission of URLs: what happens to each candidate, which links of an event become candidates, and advice about a
source that may be stale.

Everything is joins on keys and ordered conditions. The queue that takes a URL is another component: ``decide`` says what
to offer it, ``settle`` reads its answers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.operators.windows import visit_windows

# The reason that the queue is told for each origin, results of the queue that mean a new task.
REASON = {"seed": "seed", "search": "search", "link": "discovered", "leaf": "discovered"}
NEW = ("ready", "scheduled")
NEGATIVE = ("moved", "blocked", "unreachable", "error")


def _seconds(at: Column) -> Column:
    return at.cast("timestamp").cast("double")


def decide(candidates: DataFrame, states: DataFrame, now: Column, revisit_seconds: float, priority: dict[str, int]) -> DataFrame:
    """One row for each URL offered: ``outcome`` where it is settled already, else null with the queue, priority and
    reason to offer it with.

    Candidates: url_id, position, origin, host, valid, action, rule_id, ruleset, advised_admit and advised_capability
    (null without advice), boosted (null without feedback), wanted_capability. The last candidate of a URL counts. States:
    url_id, last_admitted_at, last_action, last_rule_id, last_ruleset. ``recorded`` says whether the decision is written:
    a block only where the last one was another.
    """
    rest = [c for c in candidates.columns if c != "url_id"]
    one = candidates.groupBy("url_id").agg(F.max(F.struct("position", *[c for c in rest if c != "position"])).alias("_c")).select("url_id", "_c.*")
    rows = one.join(states.select("url_id", "last_admitted_at", "last_action", "last_rule_id", "last_ruleset"), "url_id", "left")
    onion = F.col("host").endswith(".onion")
    recent = F.coalesce(_seconds(now) - _seconds(F.col("last_admitted_at")) < revisit_seconds, F.lit(False))
    deferred = ~onion & F.coalesce(~F.col("advised_admit"), F.lit(False))
    outcome = F.when(~F.col("valid"), "invalid").when(F.col("action") == "block", "blocked").when(recent, "recent").when(deferred, "source_deferred")
    informed = F.col("advised_admit").isNotNull()
    browser = F.coalesce(informed & (F.col("advised_capability") == "browser"), F.lit(False)) | F.coalesce(~informed & (F.col("wanted_capability") == "browser"), F.lit(False))
    base = F.coalesce(*[F.when(F.col("origin") == o, F.lit(p)) for o, p in priority.items()])
    reason = F.coalesce(*[F.when(F.col("origin") == o, F.lit(r)) for o, r in REASON.items()])
    changed = ~(F.col("last_action").eqNullSafe(F.col("action")) & F.col("last_rule_id").eqNullSafe(F.col("rule_id")) & F.col("last_ruleset").eqNullSafe(F.col("ruleset")))
    open_ = outcome.isNull()
    return rows.select(
        "url_id", "origin", "action", outcome.alias("outcome"),
        F.when(open_, F.when(onion, "tor").when(browser, "browser").otherwise("http")).alias("queue"),
        F.when(open_, F.when(F.col("boosted").between(0, 100), F.col("boosted")).otherwise(base)).alias("priority"),
        F.when(open_, reason).alias("reason"),
        F.coalesce((outcome == "blocked") & changed, F.lit(False)).alias("recorded"),
    )


def settle(decided: DataFrame, answers: DataFrame) -> DataFrame:
    """Outcomes of all URLs once the queue has answered (url_id, result): admitted, merged or rejected_full for those
    offered. A URL without an answer was not taken."""
    rows = decided.join(answers.select("url_id", "result"), "url_id", "left")
    offered = F.when(F.col("result").isNull() | (F.col("result") == "rejected"), "rejected_full").when(F.col("result").isin(*NEW), "admitted").otherwise("merged")
    outcome = F.coalesce("outcome", offered)
    return rows.select("url_id", "origin", outcome.alias("outcome"), "queue", "priority", "reason", (F.col("recorded") | outcome.isin("admitted", "merged")).alias("recorded"))


def link_events(events: DataFrame, rooted: DataFrame, blocked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(results, candidates) of link events (event_id, observation_id, page_site, links: url_id, site, relation).

    An event of an observation in ``blocked`` (observation_id), whose redirects a rule forbids, is ``redirect_blocked``; one
    of a page outside the ``rooted`` sites is ``leaf_page`` and is not expanded; any other is ``admitted``, and its links are
    candidates: ``link`` inside rooted sites, ``leaf`` outside."""
    sites = rooted.select(F.col("site").alias("_site")).where("_site is not null").distinct()
    stopped = blocked.select(F.col("observation_id").alias("_stopped")).where("_stopped is not null").distinct()
    found = events.join(stopped, F.col("observation_id") == F.col("_stopped"), "left").join(sites, F.col("page_site") == F.col("_site"), "left")
    result = F.when(F.col("_stopped").isNotNull(), "redirect_blocked").when(F.col("_site").isNull(), "leaf_page").otherwise("admitted")
    judged = found.withColumn("result", result).drop("_stopped", "_site")
    links = judged.where("result = 'admitted'").select("event_id", "observation_id", F.posexplode("links").alias("position", "_l")).select("event_id", "observation_id", "position", "_l.*")
    origin = F.when(F.col("_site").isNotNull(), "link").otherwise("leaf")
    candidates = links.join(sites, F.col("site") == F.col("_site"), "left").withColumn("origin", origin).drop("_site")
    return judged.select("event_id", "result"), candidates


def redirect_blocked(hops: DataFrame) -> DataFrame:
    """Observations (observation_id, action of each hop) of which some hop is blocked."""
    return hops.groupBy("observation_id").agg(F.bool_or(F.col("action") == "block").alias("_b")).where("_b").select("observation_id")


def negative_states(assessed: DataFrame, everything: bool = False) -> DataFrame:
    """Sources in a negative state with what holds for them; the reader orders by state and id."""
    rows = assessed if everything else assessed.where(F.col("state").isin(*NEGATIVE))
    return rows.select("domain_id", "state", "admit", "capability", "moved_to")


def snapshot_fallback(now: Column, loaded_at: Column, through_at: Column, policy: Column, wanted: str, max_age: float, max_lag: float) -> Column:
    """Why a snapshot cannot be used for advice, null if it can: missing, too old, of another policy, or behind."""
    return (
        F.when(loaded_at.isNull(), "unavailable")
        .when(_seconds(now) - _seconds(loaded_at) > max_age, "snapshot_stale")
        .when(through_at.isNull() | policy.isNull(), "unavailable")
        .when(policy != wanted, "policy_mismatch")
        .when(_seconds(now) - _seconds(through_at) > max_lag, "projection_stale")
    )


def granted_probes(asked: DataFrame, every: float) -> DataFrame:
    """The probes that are granted (domain_id, at) of those asked for: a source gets its first, then none until ``every``
    seconds have gone since the last one granted. That is a source's visit windows, whose starts are the grants."""
    return visit_windows(asked.where("at is not null"), ["domain_id"], "at", every).select("domain_id", F.col("started_at").alias("at"))
