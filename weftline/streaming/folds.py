"""Stateful streaming forms of the folds. Each has a batch twin; the tests hold one against the other.

Nothing here drops late rows: folds are commutative and keep their reference time as state, so no watermark is needed
where completeness matters. Duplicates are dropped by key within a horizon of event time.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from weftline.operators import health

CAPS = ("http_ok", "http_needs_js", "browser_ok")
_SUMS = [f"w_{c}" for c in health.CLASSES] + list(CAPS)
STATE = "ref double, " + ", ".join(f"{c} double" for c in _SUMS) + ", facts long, first_seen double, last_ok double, last_http double, moved_at double, moved_to string"
PROFILE = "domain_id long, ref double, " + ", ".join(f"{c} double" for c in _SUMS) + ", facts long, first_seen double, last_ok double, last_http double, moved_to string"


def fold(state: tuple | None, facts: pd.DataFrame, policy: health.Policy = health.Policy()) -> tuple:
    """A profile with more facts (t, capability, class, moved_to) in it, in any order."""
    names = [x.split()[0] for x in STATE.split(", ")]
    s = dict(zip(names, state, strict=True)) if state else dict.fromkeys(names) | dict.fromkeys([*_SUMS], 0.0) | {"facts": 0, "ref": facts["t"].iloc[0]}
    later = lambda a, b: b if a is None else max(a, b)
    for t, cap, kind, moved in facts[["t", "capability", "class", "moved_to"]].itertuples(index=False):
        if t > s["ref"]:
            for c in _SUMS:
                s[c] *= math.exp((s["ref"] - t) / (policy.tau_cap if c in CAPS else policy.tau))
            s["ref"] = t
        weight = lambda tau: math.exp((t - s["ref"]) / tau)  # noqa: B023, E731
        known = "ok" if kind == "needs_js" else kind
        if known in health.CLASSES:
            s[f"w_{known}"] += weight(policy.tau)
        if cap == "http" and kind in ("ok", "needs_js"):
            s[f"http_{kind}"] += weight(policy.tau_cap)
        if cap == "browser" and kind in ("ok", "needs_js"):
            s["browser_ok"] += weight(policy.tau_cap)
        s["facts"] += 1
        s["first_seen"] = t if s["first_seen"] is None else min(s["first_seen"], t)
        if kind in ("ok", "needs_js"):
            s["last_ok"] = later(s["last_ok"], t)
        if cap == "http":
            s["last_http"] = later(s["last_http"], t)
        if moved is not None and moved == moved and (s["moved_at"] is None or (t, moved) > (s["moved_at"], s["moved_to"])):
            s["moved_at"], s["moved_to"] = t, moved
    return tuple(s[n] for n in names)


def profiles(facts: DataFrame) -> DataFrame:
    """A stream of profiles, one row for each domain and micro-batch in which it has facts (domain_id, at, ...)."""
    names = [x.split()[0] for x in STATE.split(", ")]
    shown = [x.split()[0] for x in PROFILE.split(", ")]

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        value = state.get if state.exists else None
        for frame in frames:
            value = fold(value, frame)
        state.update(value)
        row = dict(zip(names, value, strict=True)) | {"domain_id": key[0]}
        yield pd.DataFrame([[row[n] for n in shown]], columns=shown)

    timed = facts.withColumn("t", F.col("at").cast("timestamp").cast("double"))
    return timed.groupBy("domain_id").applyInPandasWithState(run, PROFILE, STATE, "update", GroupStateTimeout.NoTimeout)


def once(events: DataFrame, key: str, at: str, horizon: str = "14 days") -> DataFrame:
    """Each event once: later copies within the horizon of event time are dropped."""
    return events.withWatermark(at, horizon).dropDuplicatesWithinWatermark([key])


SIGHTING = "url_id string, revision_id string, first_seen double, last_seen double, sightings long, changed boolean"


def revision_sightings(observations: DataFrame) -> DataFrame:
    """First and last sighting of each revision of a URL (url_id, revision_id, at); ``changed`` on its first row, unless
    it is the URL's first revision."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known = dict(zip(*[list(x) for x in state.get], strict=True)) if state.exists else {}
        seen = {k: tuple(map(float, v.split("|"))) for k, v in known.items()}
        touched, fresh = {}, set()
        for frame in frames:
            for revision, t in frame[["revision_id", "t"]].itertuples(index=False):
                if revision not in seen:
                    if seen:
                        fresh.add(revision)
                    seen[revision] = (t, t, 0)
                a, b, n = seen[revision]
                seen[revision] = touched[revision] = (min(a, t), max(b, t), n + 1)
        state.update((list(seen), ["|".join(map(repr, v)) for v in seen.values()]))
        rows = [(key[0], r, a, b, int(n), r in fresh) for r, (a, b, n) in touched.items()]
        yield pd.DataFrame(rows, columns=[x.split()[0] for x in SIGHTING.split(", ")])

    timed = observations.withColumn("t", F.col("at").cast("timestamp").cast("double"))
    return timed.groupBy("url_id").applyInPandasWithState(run, SIGHTING, "revisions array<string>, times array<string>", "update", GroupStateTimeout.NoTimeout)


BACKOFF = "domain_id long, strikes int, wait_s double, until double"


def rate_limit_backoff(refusals: DataFrame, base: float = 30.0, cap: float = 3600.0, window: float = 1800.0) -> DataFrame:
    """Back-off of each domain after refusals (domain_id, at, retry_after): strikes inside a window double the wait."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        strikes, last, until = state.get if state.exists else (0, -math.inf, 0.0)
        wait = 0.0
        for frame in frames:
            for t, asked in frame.sort_values("t")[["t", "retry_after"]].itertuples(index=False):
                strikes = strikes + 1 if t - last <= window else 1
                wait = min(cap, max(base * 2 ** (strikes - 1), asked if asked == asked else 0.0))
                last, until = t, max(until, t + wait)
        state.update((strikes, last, until))
        yield pd.DataFrame([(key[0], strikes, wait, until)], columns=[x.split()[0] for x in BACKOFF.split(", ")])

    timed = refusals.withColumn("t", F.col("at").cast("timestamp").cast("double"))
    return timed.groupBy("domain_id").applyInPandasWithState(run, BACKOFF, "strikes int, last double, until double", "update", GroupStateTimeout.NoTimeout)


def unaccounted(sources: DataFrame, effects: DataFrame, grace: str = "1 hour") -> DataFrame:
    """Sources (key, at) left without an effect (key, at) for the time of grace, as they fall due; an outer stream join."""
    a = sources.withWatermark("at", grace).alias("a")
    b = effects.select(F.col("key").alias("_k"), F.col("at").alias("_t")).withWatermark("_t", grace)
    joined = a.join(b, F.expr(f"key = _k and _t >= at - interval {grace} and _t <= at + interval {grace}"), "left_outer")
    return joined.where("_k is null").select("key", "at")


def upsert_latest(target: str, keys: list[str], at: str):
    """A ``foreachBatch`` sink that appends each micro-batch once, named by its id; ``read_latest`` gives the newest rows."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    def read_latest(spark) -> DataFrame:
        rows = spark.read.parquet(target).drop("batch")
        rest = [c for c in rows.columns if c not in keys]
        return rows.groupBy(*keys).agg(F.max(F.struct(at, *[c for c in rest if c != at])).alias("_r")).select(*keys, "_r.*")

    return write, read_latest
