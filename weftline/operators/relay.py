"""Outbox relay, stream retention, and what follows a match or a media reference: projections and observations.

An outbox row has a shard and the minute (bucket) in which it was written. A relay has one checkpoint a shard: the first
bucket that may still hold unpublished rows. Its decisions are joins of rows with that small table of shards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bucket_of(at: Column) -> Column:
    return F.floor(F.unix_seconds(at.cast("timestamp")) / 60).cast("long")


def scan(checkpoints: DataFrame, earliest: Column, now: Column, settle_seconds: float, full: bool) -> DataFrame:
    """(shard, first, last, checkpoint) of one cycle: the buckets to read and the checkpoint after it.

    A full scan reads from the checkpoint and moves it past every settled bucket; a hot one reads the current bucket and the
    one before, and moves nothing. A shard without a checkpoint (null) starts at ``earliest``."""
    current, settled = bucket_of(now), F.floor((F.unix_seconds(now.cast("timestamp")) - settle_seconds) / 60).cast("long")
    held = F.coalesce(F.col("checkpoint"), earliest)
    first = held if full else F.greatest(held, current - 1)
    return checkpoints.select("shard", first.alias("first"), current.alias("last"), (F.greatest(held, settled) if full else held).alias("checkpoint"))


def due(rows: DataFrame, ranges: DataFrame) -> DataFrame:
    """Unpublished rows (shard, bucket, published_at) in the buckets to read; ``ranges`` has one row a shard."""
    r = ranges.select(F.col("shard").alias("_s"), "first", "last")
    return rows.join(r, F.col("shard") == F.col("_s")).where(F.col("published_at").isNull() & F.col("bucket").between(F.col("first"), F.col("last"))).select(*rows.columns)


def late(rows: DataFrame, checkpoints: DataFrame, since: Column) -> DataFrame:
    """Unpublished rows behind the checkpoints, back to ``since``: those a relay will not come back to by itself."""
    c = checkpoints.where("checkpoint is not null").select(F.col("shard").alias("_s"), F.col("checkpoint").alias("_c"))
    return rows.join(c, F.col("shard") == F.col("_s")).where(F.col("published_at").isNull() & (F.col("bucket") >= bucket_of(since)) & (F.col("bucket") < F.col("_c"))).select(*rows.columns)


def replay(rows: DataFrame, since: Column, until: Column) -> DataFrame:
    """All rows of the buckets from ``since`` to ``until``, published or not."""
    return rows.where(F.col("bucket").between(bucket_of(since), bucket_of(until)))


def trim_floor(groups: DataFrame) -> DataFrame:
    """(stream, floor_ms, floor_seq): the oldest entry that a group of each stream still needs: its oldest pending one, else
    the one after the last delivered. Entry ids are ``ms-seq``; streams without groups have no row."""
    part = lambda c, k: F.coalesce(F.split(F.col(c), "-").getItem(k).try_cast("long"), F.lit(0))
    pending = (F.col("pending") > 0) & F.col("oldest_pending_id").isNotNull()
    own = F.when(pending, F.struct(part("oldest_pending_id", 0).alias("ms"), part("oldest_pending_id", 1).alias("seq")))
    needed = own.otherwise(F.struct(part("last_delivered_id", 0).alias("ms"), (part("last_delivered_id", 1) + 1).alias("seq")))
    return groups.groupBy("stream").agg(F.min(needed).alias("_f")).select("stream", F.col("_f.ms").alias("floor_ms"), F.col("_f.seq").alias("floor_seq"))


def generation_rows(rows: DataFrame, state: DataFrame) -> DataFrame:
    """Projection rows of the reader's present generation; rows of others, left by a rebuild, are not seen."""
    return rows.join(state.select("reader", "generation"), ["reader", "generation"], "left_semi")


def needs_rebuild(state: DataFrame, retained_from: Column, policy: Column) -> DataFrame:
    """(reader, reason) of readers whose projection starts anew: asked for, of another policy, or with buckets lost before
    they were read. Others have no row."""
    reason = F.when(F.col("requested"), "requested").when(~F.col("policy").eqNullSafe(policy), "policy").when(F.col("next_bucket") < retained_from, "gap")
    return state.select("reader", reason.alias("reason")).where("reason is not null")


def match_projection(matches: DataFrame, *keys: str) -> DataFrame:
    """Matches by ``keys`` and month (match_id, decided_at, domains, ...), the latest decision of each match; ``domain_id`` as
    a key makes one row for each of a match's source domains."""
    rows = matches.withColumn("month", F.date_format(F.trunc("decided_at", "month"), "yyyy-MM"))
    if "domain_id" in keys:
        rows = rows.withColumn("domain_id", F.explode(F.array_distinct("domains")))
    rest = [c for c in rows.columns if c not in {*keys, "month", "match_id", "decided_at", "domains"}]
    newest = F.max(F.struct("decided_at", *rest)).alias("_m")
    return rows.groupBy(*keys, "month", "match_id").agg(newest).select(*keys, "month", "match_id", "_m.*")


def media_observations(references: DataFrame, latest: DataFrame, claimed: DataFrame) -> DataFrame:
    """One observation for each page observation and medium: the reference that comes first, with what the medium's latest
    probe says. Those claimed already and committed are ``replayed``, claimed ones without a commit ``resumed``.

    References: page_observation_id, media_id, position, kind; latest: media_id, status, content_id; claimed:
    page_observation_id, media_id, committed."""
    first = references.where("media_id is not null").groupBy("page_observation_id", "media_id").agg(F.min(F.struct("position", "kind")).alias("_r"))
    rows = first.join(latest.select("media_id", "status", "content_id"), "media_id", "left").join(claimed.select("page_observation_id", "media_id", "committed"), ["page_observation_id", "media_id"], "left")
    result = F.when(F.col("committed").isNull(), "claimed").when(F.col("committed"), "replayed").otherwise("resumed")
    return rows.select("page_observation_id", "media_id", F.col("_r.position").alias("position"), F.col("_r.kind").alias("kind"), F.coalesce("status", F.lit("unprobed")).alias("status"), "content_id", result.alias("result"))
