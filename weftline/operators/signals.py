"""Metrics: samples of a Prometheus text page, selectors over them, and alerts that hold for some time.

Everything is Column expressions; an alert is one window over the buckets of a series.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_SAMPLE = r"^([A-Za-z_:][A-Za-z0-9_:]*)(\{.*\})?\s+(\S+)(\s+\S+)?\s*$"
_SELECTOR = re.compile(r"([A-Za-z_:][A-Za-z0-9_:]*)(?:\{(.*)\})?")


def samples(lines: DataFrame, line: str) -> DataFrame:
    """(name, labels, value) of each sample line; comments, empty lines and lines of another form are left out."""
    text = F.trim(F.col(line))
    names = F.regexp_extract_all(F.regexp_extract(text, _SAMPLE, 2), F.lit(r'(\w+)="((?:[^"\\]|\\.)*)"'), F.lit(1))
    values = F.regexp_extract_all(F.regexp_extract(text, _SAMPLE, 2), F.lit(r'(\w+)="((?:[^"\\]|\\.)*)"'), F.lit(2))
    raw = F.regexp_extract(text, _SAMPLE, 3)
    value = F.when(raw.isin("+Inf", "Inf"), F.lit(float("inf"))).when(raw == "-Inf", F.lit(float("-inf"))).otherwise(raw.try_cast("double"))
    kept = lines.where(~text.startswith("#") & text.rlike(_SAMPLE))
    return kept.select(F.regexp_extract(text, _SAMPLE, 1).alias("name"), F.map_from_arrays(names, values).alias("labels"), value.alias("value")).where("value is not null")


def matches(selector: str) -> Column:
    """Whether a sample is meant by ``name{label="value",...}``."""
    form = _SELECTOR.fullmatch(selector.strip())
    if form is None:
        raise ValueError(f"bad selector {selector!r}")
    out = F.col("name") == form[1]
    for label, value in re.findall(r'(\w+)="([^"]*)"', form[2] or ""):
        out &= F.coalesce(F.col("labels")[label] == value, F.lit(False))
    return out


def selected(found: DataFrame, selector: str) -> DataFrame:
    """One row with ``value``: the sum of the samples meant, null if there are none; ``a / b`` is a ratio, null over 0."""
    sums = [F.sum(F.when(matches(part), F.col("value"))) for part in selector.split(" / ", 1)]
    value = sums[0] if len(sums) == 1 else F.when(sums[1] != 0, sums[0] / sums[1])
    return found.agg(value.alias("value"))


def alerts(rows: DataFrame, keys: list[str], bucket: str, condition: Column, periods: int) -> DataFrame:
    """(keys, started, firing_from, buckets): runs of ``periods`` neighbouring buckets or more in which a condition holds.
    A bucket without a row ends a run."""
    series = Window.partitionBy(*keys).orderBy(bucket)
    held = rows.where(condition).select(*keys, bucket).distinct()
    runs = held.withColumn("_run", F.col(bucket) - F.row_number().over(series)).groupBy(*keys, "_run").agg(F.min(bucket).alias("started"), F.count(F.lit(1)).alias("buckets"))
    return runs.where(F.col("buckets") >= periods).select(*keys, "started", (F.col("started") + periods - 1).alias("firing_from"), "buckets")


def settled(rows: DataFrame, at: str, now: Column, settle_seconds: int = 600, through: Column | None = None) -> DataFrame:
    """(bucket, facts) of the minutes that are settled: those that ended ``settle_seconds`` before ``now`` or earlier, and
    after the bucket ``through`` which a checkpoint has, so that every minute is folded exactly once."""
    minute = F.floor(F.unix_seconds(F.col(at).cast("timestamp")) / 60).cast("long")
    ready_until = F.floor((F.unix_seconds(now.cast("timestamp")) - settle_seconds) / 60)
    found = rows.where(F.col(at).isNotNull()).select(minute.alias("bucket")).where(F.col("bucket") < ready_until)
    if through is not None:
        found = found.where(F.col("bucket") > through)
    return found.groupBy("bucket").agg(F.count(F.lit(1)).alias("facts"))
