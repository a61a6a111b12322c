"""Decision functions of fetching, media and evidence as Column expressions and joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def attempt_decision(outcome: Column, status: Column, queue: Column, offline: Column) -> Column:
    """(operation, reason, next_queue, consumes_attempt) of a fetch outcome."""
    retry = status.isin(408, 429)
    ambiguous = outcome.isin("timeout", "dns_failure", "connection_failure")
    code = lambda prefix: F.concat(F.lit(prefix + "_"), F.coalesce(status, F.lit(0)).cast("string"))
    one = lambda op, reason, queue=None, uses=True: F.struct(F.lit(op).alias("operation"), reason.alias("reason"), F.lit(queue).cast("string").alias("next_queue"), F.lit(uses).alias("consumes_attempt"))
    return (
        F.when(outcome.isin("cancelled", "proxy_unavailable"), one("defer", outcome, uses=False))
        .when(ambiguous & offline, one("defer", F.lit("local_network_offline"), uses=False))
        .when(ambiguous | outcome.isin("tls_failure", "invalid_response", "truncated"), one("fail", outcome))
        .when((outcome == "needs_js") & (queue == "http"), one("fail", outcome, "browser"))
        .when((outcome == "blocked") & retry, one("fail", code("blocked")))
        .when((outcome == "http_error") & ((status >= 500) | retry), one("fail", code("http")))
        .when(outcome == "http_error", one("complete", code("http")))
        .otherwise(one("complete", outcome))
    )


def retry_after(value: Column, now: Column) -> Column:
    """Seconds of a Retry-After header, given in seconds or as an HTTP date; null if it is neither."""
    text = F.trim(value)
    when = F.try_to_timestamp(F.regexp_replace(text, "^[A-Za-z]{3}, ", ""), F.lit("dd MMM yyyy HH:mm:ss 'GMT'"))
    return F.when(text.rlike(r"^\d{1,15}$"), text.try_cast("double")).when(when.isNotNull(), F.greatest(F.lit(0.0), when.cast("double") - now.cast("timestamp").cast("double")))


def archival(observation_id: Column, new_revision: Column, high_value: Column, candidate: Column, sample_rate: float) -> Column:
    """(keep, reason): sampling takes the id's own bits, so every host decides alike."""
    tail = F.conv(F.substring(F.regexp_replace(observation_id, "^.*_", ""), -15, 15), 16, 10).cast("decimal(20,0)")
    sampled = F.pmod(tail, F.lit(10000)) < round(sample_rate * 10000)
    reason = F.when(candidate, "evidence_candidate").when(new_revision & high_value, "high_value_change").when(new_revision, "new_revision").when(sampled, "sampled").otherwise("sampled_out")
    return F.struct((reason != "sampled_out").alias("keep"), reason.alias("reason"))


def probe_status(outcome: Column, status: Column, is_media: Column, is_manifest: Column, unsafe: Column) -> Column:
    return (
        F.when(unsafe, "forbidden").when((outcome == "media") & is_media, "probed").when(status.isin(401, 403) | outcome.isin("blocked", "captcha"), "forbidden")
        .when((outcome == "http_error") | outcome.isin("timeout", "dns_failure", "connection_failure", "tls_failure"), "unreachable").when((outcome == "ok") & is_manifest, "probed").otherwise("not_media")
    )


def latest_media(probes: DataFrame, hashes: DataFrame) -> DataFrame:
    """Of each medium: newest probe, newest hash attempt, newest good hash, and the content that holds now: the good hash
    of the same validators as the newest probe. Probes: media_id, at, status, kind, is_media, validators; hashes:
    media_id, at, outcome, validators, content_id."""
    p = probes.groupBy("media_id").agg(F.max(F.struct("at", "status", "kind", "is_media", "validators")).alias("probe"))
    good = F.when(F.col("outcome") == "ok", F.struct("at", "validators", "content_id"))
    h = hashes.groupBy("media_id").agg(F.max(F.struct("at", "outcome", "validators")).alias("hash"), F.max(good).alias("ok_hash"))
    rows = p.join(h, "media_id", "left")
    current = (F.col("probe.status") == "probed") & F.col("ok_hash.validators").eqNullSafe(F.col("probe.validators")) & F.col("ok_hash").isNotNull()
    hashable = (F.col("probe.status") == "probed") & (F.col("probe.kind").isin("video", "audio") | ((F.col("probe.kind") == "unknown") & F.col("probe.is_media")))
    return rows.withColumn("content_id", F.when(current, F.col("ok_hash.content_id"))).withColumn("hashable", F.coalesce(hashable, F.lit(False)))


def hash_due(now: Column, rehash_seconds: float) -> Column:
    """Whether a medium of ``latest_media`` should be hashed: never hashed, changed, or failed (or unverifiable) long ago."""
    age = now.cast("timestamp").cast("double") - F.col("hash.at").cast("timestamp").cast("double")
    changed = F.col("hash").isNull() | ~F.col("hash.validators").eqNullSafe(F.col("probe.validators"))
    retry = ((F.col("hash.outcome") != "ok") | F.col("probe.validators").isNull()) & (age >= rehash_seconds)
    return F.col("hashable") & (changed | F.coalesce(retry, F.lit(False)))


def encode_requests(contents: DataFrame, claims: DataFrame, ready: DataFrame) -> DataFrame:
    """Contents to encode: one request each, none that is claimed or ready."""
    return contents.where("content_id is not null").groupBy("content_id").agg(F.min(F.struct("at", "media_id")).alias("_f")).join(claims, "content_id", "left_anti").join(ready, "content_id", "left_anti").select("content_id", "_f.media_id", "_f.at")


def representation_status(events: DataFrame) -> DataFrame:
    """State of each (content_id, spec_key): ready beats failed, the failure of the highest attempt, else requested."""
    failed = F.when(F.col("kind") == "failed", F.struct("attempt", "failure", "retryable"))
    rows = events.groupBy("content_id", "spec_key").agg(F.max(F.col("kind") == "ready").alias("_ready"), F.max(failed).alias("_f"), F.min(F.when(F.col("kind") == "requested", F.col("at"))).alias("requested_at"))
    return rows.select("content_id", "spec_key", F.when(F.col("_ready"), "ready").when(F.col("_f").isNotNull(), "failed").otherwise("requested").alias("state"), F.when(~F.col("_ready"), F.col("_f.failure")).alias("failure"), F.when(~F.col("_ready"), F.col("_f.retryable")).alias("retryable"), "requested_at")


def target_state(versions: DataFrame) -> DataFrame:
    """The highest version's document of each target and its earliest retirement."""
    return versions.groupBy("target_id").agg(F.max_by("doc", "version").alias("doc"), F.max("version").alias("version"), F.min("retired_at").alias("retired_at"))


def evidence_sources(sightings: DataFrame, most: int) -> DataFrame:
    """The first ``most`` sources of each match: verified ones first, then the newest, then by id; and how many there are."""
    w = Window.partitionBy("match_id")
    ranked = sightings.withColumn("_r", F.row_number().over(w.orderBy((F.col("basis") != "content_verified").cast("int"), F.desc("sighted_at"), "page_observation_id", "media_id"))).withColumn("sources_total", F.count(F.lit(1)).over(w))
    return ranked.where(F.col("_r") <= most).withColumn("ordinal", F.col("_r") - 1).drop("_r")


def evidence_gaps(matches: DataFrame, sources: DataFrame) -> DataFrame:
    """(match_id, code, subject) of what is missing for each match (match_id, verdict)."""
    sums = sources.groupBy("match_id").agg(F.count(F.lit(1)).alias("n"), F.max("sources_total").alias("total"), F.max(F.col("basis") == "content_verified").alias("sure"))
    rows = matches.join(sums, "match_id", "left")
    whole = F.filter(F.array(F.when(F.col("n").isNull(), "unattributed"), F.when(~F.col("sure"), "ambiguous_attribution"), F.when(F.col("total") > F.col("n"), "sources_truncated"), F.when(F.col("verdict") != "confirmed", "verdict_not_confirmed")), lambda c: c.isNotNull())
    each = F.filter(F.when(~F.col("observation_present"), F.array(F.lit("page_observation_missing"))).otherwise(F.array(F.when(F.col("snapshot").isNull(), "snapshot_not_archived"), F.when(F.col("worker").isNull(), "fetch_attempt_missing"))), lambda c: c.isNotNull())
    return rows.select("match_id", F.explode(whole).alias("code"), F.lit(None).cast("string").alias("subject")).unionByName(sources.select("match_id", F.explode(each).alias("code"), F.col("page_observation_id").alias("subject"))).distinct()


def validation(checks: DataFrame) -> DataFrame:
    """complete, partial or rejected, by the worst check (evidence_id, outcome of ok, gap or mismatch)."""
    worst = F.max(F.when(F.col("outcome") == "mismatch", 2).when(F.col("outcome") == "gap", 1).otherwise(0))
    return checks.groupBy("evidence_id").agg(worst.alias("_w")).select("evidence_id", F.element_at(F.array(F.lit("complete"), F.lit("partial"), F.lit("rejected")), F.col("_w") + 1).alias("verdict"))


def version_plan(candidates: DataFrame, versions: DataFrame) -> DataFrame:
    """first, idempotent or supersede for each candidate (evidence_id, digest) against its finished versions."""
    newest = versions.groupBy("evidence_id").agg(F.max(F.struct("version", "manifest_digest")).alias("_v"))
    plan = F.when(F.col("_v").isNull(), "first").when(F.col("_v.manifest_digest") == F.col("digest"), "idempotent").otherwise("supersede")
    version = F.when(plan == "idempotent", F.col("_v.version")).otherwise(F.coalesce(F.col("_v.version"), F.lit(0)) + 1)
    return candidates.join(newest, "evidence_id", "left").select("evidence_id", plan.alias("plan"), version.alias("version"), F.when(plan == "supersede", F.col("_v.version")).alias("supersedes"))


def candidate_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """created, updated, unchanged or frozen (finished and different) for each collected dossier."""
    o = old.select("evidence_id", F.col("digest").alias("_d"), F.col("status").alias("_s"))
    state = F.when(F.col("_d").isNull(), "created").when(F.col("_d") == F.col("digest"), "unchanged").when(F.col("_s") == "finalized", "frozen").otherwise("updated")
    return new.join(o, "evidence_id", "left").select("evidence_id", state.alias("change"))


def backup_differences(manifest: DataFrame, listing: DataFrame, references: DataFrame) -> DataFrame:
    """(path, problem): missing, mismatched and unexpected files, and references to files that are not there."""
    both = manifest.select("path", F.col("sha256").alias("want")).join(listing.select("path", F.col("sha256").alias("have")), "path", "full")
    problem = F.when(F.col("have").isNull(), "missing").when(F.col("want").isNull(), "unexpected").when(F.col("want") != F.col("have"), "mismatched")
    dangling = references.select("path").distinct().join(listing, "path", "left_anti").select("path", F.lit("dangling").alias("problem"))
    return both.select("path", problem.alias("problem")).where("problem is not null").unionByName(dangling)


def verdict(criteria: DataFrame) -> DataFrame:
    """The run's verdict: the worst status of its criteria (run, criterion, status); a required one left out is no pass."""
    rank = F.when(F.col("status") == "fail", 3).when(F.col("status") == "incomplete", 2).when(F.col("status") == "warn", 1).otherwise(0)
    names = F.array(*[F.lit(x) for x in ("pass", "pass_with_warnings", "incomplete", "fail")])
    return criteria.groupBy("run").agg(F.max(rank).alias("_w"), F.array_sort(F.collect_list(F.when(rank == 3, F.col("criterion")))).alias("failed")).select("run", F.element_at(names, F.col("_w") + 1).alias("verdict"), "failed")
