"""Window operators: latest rows, neighbours, visit windows, revisions, runs, top rows of a group."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def latest_per_key(rows: DataFrame, keys: list[str], at: str, *ties: str) -> DataFrame:
    """The newest row of each key: null times last, then the least tie columns.

    An aggregate, not a window: rows of a key are combined before the shuffle, so a hot key costs one row a task."""
    newest = rows.groupBy(*keys).agg(F.max(F.struct(F.col(at).isNotNull().alias("_has"), F.col(at).alias("_at"))).alias("_top")).select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "_top")
    same = rows.withColumn("_own", F.struct(F.col(at).isNotNull().alias("_has"), F.col(at).alias("_at"))).join(newest, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]).where(F.col("_own").eqNullSafe(F.col("_top"))).select(*rows.columns)
    rest = [c for c in rows.columns if c not in {*keys, *ties}]
    return same.groupBy(*keys).agg(F.min(F.struct(*ties, *rest)).alias("_row")).select(*keys, "_row.*").select(*rows.columns)


def top_k(rows: DataFrame, keys: list[str], k: int, *order) -> DataFrame:
    """The first ``k`` rows of each key, with their rank from 1."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)


def transitions(rows: DataFrame, keys: list[str], at: list[str], value: str) -> DataFrame:
    """Each row with its predecessor's value, from the second row of a key on."""
    w = Window.partitionBy(*keys).orderBy(*at)
    return rows.withColumn(f"previous_{value}", F.lag(value).over(w)).withColumn("_n", F.row_number().over(w)).where("_n > 1").drop("_n")


def visit_windows(rows: DataFrame, keys: list[str], at: str, gap_seconds: float) -> DataFrame:
    """Windows of visits: a new one opens ``gap_seconds`` or more after the start of the current one.

    The gap counts from the window's start, not from the last visit, so this is a fold over the ordered times and no
    session window: each key's sorted times are read once, and the next window's start is found by bisection."""
    seconds = F.col(at).cast("timestamp").cast("double").alias("_t")
    key_fields = [rows.select(*keys).schema[k] for k in keys]
    schema = T.StructType([*key_fields, T.StructField("window_index", T.IntegerType()), T.StructField("_start", T.DoubleType()), T.StructField("visits", T.IntegerType())])

    def fold(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        times = np.sort(frame["_t"].dropna().to_numpy())
        starts = [0] if len(times) else []
        while starts and (to := int(np.searchsorted(times, times[starts[-1]] + gap_seconds))) < len(times):
            starts.append(max(to, starts[-1] + 1))
        visits = np.diff([*starts, len(times)]) if starts else np.zeros(0, int)
        out = pd.DataFrame({"window_index": np.arange(len(starts)), "_start": times[starts], "visits": visits})
        for k, (name, value) in enumerate(zip(keys, key, strict=True)):
            out.insert(k, name, [value] * len(out))
        return out

    folded = rows.select(*keys, seconds).groupBy(*keys).applyInPandas(fold, schema)
    return folded.select(*keys, "window_index", F.timestamp_micros((F.col("_start") * 1e6).cast("long")).alias("started_at"), "visits")


def first_appearance(rows: DataFrame, keys: list[str], member: str, index: str) -> DataFrame:
    """For each key and member, the first index at which it was there: it is new exactly then."""
    return rows.groupBy(*keys, member).agg(F.min(index).alias("first_index"))


def distinct_revisions(rows: DataFrame, keys: list[str], revision: str, at: str) -> DataFrame:
    """Revisions of a key in order of first sighting, each with the one before it."""
    first = rows.groupBy(*keys, revision).agg(F.min(at).alias("first_seen"), F.max(at).alias("last_seen"), F.count(F.lit(1)).alias("sightings"))
    w = Window.partitionBy(*keys).orderBy("first_seen", revision)
    return first.withColumn("previous_revision", F.lag(revision).over(w)).withColumn("ordinal", F.row_number().over(w))


def down_runs(rows: DataFrame, keys: list[str], at: str, is_down, interval_seconds: float) -> DataFrame:
    """Runs of consecutive down samples: start, samples, and seconds until the next up sample (or last sample plus one
    interval), at least one interval."""
    w = Window.partitionBy(*keys).orderBy(at)
    marked = rows.withColumn("_down", is_down).withColumn("_run", F.sum(F.when(F.col("_down"), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_next", F.lead(at).over(w))
    runs = marked.where("_down").groupBy(*keys, "_run").agg(F.min(at).alias("started"), F.max(at).alias("ended"), F.max("_next").alias("_up"), F.count(F.lit(1)).alias("samples"), F.count_if(F.col("_next").isNull()).alias("_open"))
    seconds = lambda a, b: F.col(b).cast("timestamp").cast("double") - F.col(a).cast("timestamp").cast("double")
    length = F.when(F.col("_open") > 0, seconds("started", "ended") + interval_seconds).otherwise(seconds("started", "_up"))
    return runs.select(*keys, "started", "samples", F.greatest(length, F.lit(float(interval_seconds))).alias("seconds"))


def share_of_group(rows: DataFrame, group: list[str], part: list[str]) -> DataFrame:
    counts = rows.groupBy(*group, *part).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy(*group)), 6))
