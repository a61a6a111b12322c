"""Aggregates: digests, dominant values, medians, histograms, rank quantiles, slopes, deltas, quality measures."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def content_digest(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(rows, d0..d3): count and exclusive or of the MD5 of every row's text, 32 bits a column. Order does not matter.

    The text of a row is its columns cast to strings, nulls marked, joined by a unit separator: no engine's JSON."""
    text = F.concat_ws("\x1f", *[F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("~")) for c in columns])
    hashed = rows.select(F.md5(text).alias("_h"))
    parts = [F.coalesce(F.bit_xor(F.conv(F.substring("_h", 8 * k + 1, 8), 16, 10).cast("long")), F.lit(0).cast("long")).alias(f"d{k}") for k in range(4)]
    return hashed.agg(F.count(F.lit(1)).alias("rows"), *parts)


def dominant(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The most frequent non-null value of each key, the least on ties."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(*keys).agg(F.min(F.struct((-F.col("n")).alias("_n"), F.col(value).alias("value"))).alias("_top")).select(*keys, F.col("_top.value").alias("value"), (-F.col("_top._n")).alias("n"))


def merged_history(rows: DataFrame, keys: list[str], at: str, payload: str) -> DataFrame:
    """First and last time of each key with the payload seen then; the least payload on ties."""
    return rows.groupBy(*keys).agg(F.min(F.struct(at, payload)).alias("_a"), F.max(F.struct(F.col(at).alias("_t"))).alias("_b"), F.min(F.struct((-F.col(at).cast("timestamp").cast("double")).alias("_t"), F.col(payload).alias("_p"))).alias("_c"), F.count(F.lit(1)).alias("sightings")).select(*keys, F.col(f"_a.{at}").alias("first_seen"), F.col(f"_a.{payload}").alias("first_value"), F.col("_b._t").alias("last_seen"), F.col("_c._p").alias("last_value"), "sightings")


def histogram(rows: DataFrame, value: str, edges: list[float]) -> DataFrame:
    """Counts between edges, lower edge included; below the first edge is bucket 0."""
    bucket = F.lit(0)
    for k, edge in enumerate(edges):
        bucket = F.when(F.col(value) >= edge, k + 1).otherwise(bucket)
    return rows.where(F.col(value).isNotNull()).groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def rank_quantiles(rows: DataFrame, keys: list[str], value: str, shares: list[float]) -> DataFrame:
    """Values at index int(share * n) of the sorted values of each key, the last one at most; no interpolation."""
    w = Window.partitionBy(*keys)
    ranked = rows.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("_v"), (F.row_number().over(w.orderBy(value)) - 1).alias("_i"), F.count(F.lit(1)).over(w).alias("_n"))
    at = lambda s: F.least(F.floor(F.lit(s) * F.col("_n")), F.col("_n") - 1)
    return ranked.groupBy(*keys).agg(*[F.max(F.when(F.col("_i") == at(s), F.col("_v"))).alias(f"p{round(s * 100)}") for s in shares])


def slope_per_hour(rows: DataFrame, keys: list[str], at: str, value: str) -> DataFrame:
    """Least-squares slope of a value over hours; null for one time only."""
    origin = rows.groupBy(*keys).agg(F.min(at).alias("_t0"))
    hours = (F.col(at).cast("timestamp").cast("double") - F.col("_t0").cast("timestamp").cast("double")) / 3600
    return rows.join(origin, keys).groupBy(*keys).agg(F.regr_slope(F.col(value), hours).alias("slope"), F.count(value).alias("points"))


def growth_ratio(rows: DataFrame, keys: list[str], at: list[str], value: str) -> DataFrame:
    """(mean of the last tenth - mean of the first tenth) / |median|, at least one point in a tenth, 1 for a median of 0."""
    w = Window.partitionBy(*keys)
    ranked = rows.select(*keys, F.col(value).alias("_v"), F.row_number().over(w.orderBy(*at)).alias("_i"), F.count(F.lit(1)).over(w).alias("_n")).withColumn("_k", F.greatest(F.floor(F.col("_n") / 10), F.lit(1)))
    sums = ranked.groupBy(*keys).agg(F.avg(F.when(F.col("_i") <= F.col("_k"), F.col("_v"))).alias("_head"), F.avg(F.when(F.col("_i") > F.col("_n") - F.col("_k"), F.col("_v"))).alias("_tail"), F.abs(F.median("_v")).alias("_m"))
    return sums.select(*keys, ((F.col("_tail") - F.col("_head")) / F.when(F.col("_m") == 0, 1.0).otherwise(F.col("_m"))).alias("growth"))


def counter_delta(rows: DataFrame, keys: list[str], at: str, value: str) -> DataFrame:
    """Last minus first value; the greater value last and the lesser first on equal times."""
    return rows.groupBy(*keys).agg((F.max(F.struct(at, value))[value] - F.min(F.struct(at, value))[value]).alias("delta"), F.count(F.lit(1)).alias("samples"))


def hourly_delta(rows: DataFrame, keys: list[str], at: str, value: str) -> DataFrame:
    return counter_delta(rows.withColumn("hour", F.date_format(F.date_trunc("hour", at), "yyyy-MM-dd HH")), [*keys, "hour"], at, value)


def sampling_gaps(rows: DataFrame, keys: list[str], at: str, longest_seconds: float) -> DataFrame:
    """Neighbouring samples that lie further apart than allowed."""
    w = Window.partitionBy(*keys).orderBy(at)
    gaps = rows.select(*keys, at, (F.col(at).cast("timestamp").cast("double") - F.lag(at).over(w).cast("timestamp").cast("double")).alias("seconds"))
    return gaps.where(F.col("seconds") > longest_seconds)


def confusion(rows: DataFrame, truth: str, guess: str, classes: list[str]) -> DataFrame:
    """Counts of each truth (rows) by guess (columns)."""
    return rows.groupBy(truth).agg(*[F.count_if(F.col(guess) == c).alias(f"as_{c}") for c in classes])


def precision_recall(rows: DataFrame, truth, guess) -> DataFrame:
    """Of boolean columns: counts, precision, recall and F1, null where undefined."""
    c = rows.agg(F.count_if(truth & guess).alias("tp"), F.count_if(~truth & guess).alias("fp"), F.count_if(truth & ~guess).alias("fn"))
    share = lambda a, b: F.when(b > 0, F.round(a / b, 6))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return c.select("tp", "fp", "fn", share(tp, tp + fp).alias("precision"), share(tp, tp + fn).alias("recall"), share(2 * tp, 2 * tp + fp + fn).alias("f1"))


def rate(numerator, denominator):
    """A share as a column; null for a zero denominator."""
    return F.when(denominator != 0, F.round(numerator / denominator, 6))
