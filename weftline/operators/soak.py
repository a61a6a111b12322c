"""Long runs judged by criteria: duration, continuity, clock, metrics, samples, outages; trends of series."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.operators.windows import down_runs

PASS, FAIL, OPEN = "pass", "fail", "inconclusive"


@dataclass(frozen=True)
class Limits:
    """Limits that somebody decided; where one is None the criterion stays open once it would matter."""

    interruptions: int | None = None
    interruption_seconds: float | None = None
    coverage: float | None = None
    outage_seconds: float | None = None


def _status(bad: Column, decided: bool = True) -> Column:
    return F.when(bad, FAIL if decided else OPEN).otherwise(PASS)


def criteria(runs: DataFrame, events: DataFrame, samples: DataFrame, required: list[str], up: Column, interval_seconds: float, limits: Limits = Limits()) -> DataFrame:
    """(run, criterion, status). Runs: run, started_at, required_seconds, phase; events: run, kind, at, gap_seconds;
    samples: run, series, at, value; ``required`` names series. ``up`` marks the samples of up series."""
    secs = lambda c: c.cast("timestamp").cast("double")
    marks = events.groupBy("run").agg(
        F.max(F.when(F.col("kind") == "completed", secs(F.col("at")))).alias("_done"), F.count_if(F.col("kind") == "interruption").alias("_breaks"),
        F.max(F.when(F.col("kind") == "interruption", F.col("gap_seconds"))).alias("_longest"), F.count_if(F.col("kind") == "clock_anomaly").alias("_clock"))
    spans = samples.groupBy("run").agg((F.max(secs(F.col("at"))) - F.min(secs(F.col("at")))).alias("_span"), F.count_distinct("at").alias("_samples"))
    present = samples.where(F.col("value").isNotNull() & F.col("series").isin(required)).groupBy("run", "series").agg(F.count_distinct("at").alias("_n"))
    wanted = runs.select("run", F.explode(F.lit(required).cast("array<string>")).alias("series")).join(present, ["run", "series"], "left").join(spans.select("run", "_samples"), "run", "left")
    share = F.coalesce(F.col("_n") / F.col("_samples"), F.lit(0.0))
    cover = wanted.groupBy("run").agg(F.min(share).alias("_cover"))
    down = down_runs(samples.where(up & F.col("value").isNotNull()), ["run", "series"], "at", F.col("value") < 0.5, interval_seconds).groupBy("run").agg(F.max("seconds").alias("_outage"))
    watched = samples.where(up).groupBy("run").agg(F.lit(True).alias("_watched"))
    rows = reduce(lambda a, b: a.join(b, "run", "left"), [marks, spans, cover, down, watched], runs)
    lasted = F.coalesce(F.col("_done") - secs(F.col("started_at")), F.col("_span"), F.lit(0.0))
    breaks = F.coalesce("_breaks", F.lit(0))
    decided = limits.interruptions is not None and limits.interruption_seconds is not None
    broken = (breaks > limits.interruptions) | (F.col("_longest") > limits.interruption_seconds) if decided else breaks > 0
    gaps = F.lit(True) if limits.coverage is None else F.col("_cover") < limits.coverage
    outage = F.coalesce("_outage", F.lit(0.0))
    too_long = outage > (limits.outage_seconds or 0.0)
    found = {
        "DURATION": _status(~((F.col("phase") == "completed") & (lasted >= F.col("required_seconds") * 0.999))),
        "CONTINUITY": _status(F.coalesce(broken & (breaks > 0), F.lit(False)), decided),
        "CLOCK": _status(F.coalesce("_clock", F.lit(0)) > 0, False),
        "METRICS": F.when(F.col("_cover").isNull() | (F.col("_cover") == 0) | ((F.col("_cover") < 1) & gaps), OPEN).otherwise(PASS),
        "SAMPLES": _status(F.coalesce("_samples", F.lit(0)) == 0, False),
        "OUTAGE": F.when(F.col("_watched").isNull(), OPEN).otherwise(_status(too_long, limits.outage_seconds is not None)),
    }
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("criterion"), v.alias("status")) for k, v in found.items()]))
    return rows.select("run", each.alias("_c")).select("run", "_c.*")


def trends(samples: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, points, slope_per_hour, growth): least squares over hours since the first sample, null for one instant, and the
    mean of the last tenth less that of the first over the size of the median (1 for 0). A series is sorted by one task."""
    hours = F.col("at").cast("timestamp").cast("double") / 3600
    rows = samples.where("value is not null and not isnan(value) and abs(value) < double('infinity')")
    first = rows.groupBy(*keys).agg(F.min(hours).alias("_first"), F.count(F.lit(1)).alias("points"), F.median("value").alias("_median"))
    w = Window.partitionBy(*keys).orderBy("at", "value")
    placed = rows.withColumn("_h", hours).withColumn("_k", F.row_number().over(w)).join(first, keys)
    tenth = F.greatest(F.lit(1), F.floor(F.col("points") / 10))
    head, tail = F.avg(F.when(F.col("_k") <= tenth, F.col("value"))), F.avg(F.when(F.col("_k") > F.col("points") - tenth, F.col("value")))
    base = F.when(F.any_value("_median") == 0, F.lit(1.0)).otherwise(F.abs(F.any_value("_median")))
    return placed.groupBy(*keys, "points").agg(F.regr_slope("value", F.col("_h") - F.col("_first")).alias("slope_per_hour"), ((tail - head) / base).alias("growth"))


def replay_tallies(attempts: DataFrame, *keys: str) -> DataFrame:
    """What a policy would have done to attempts (seconds, class, capability, admit, probe, advised): suppressed, executed and
    probed ones, answers lost, seconds saved, fetches that another first capability had saved or cost."""
    admitted, answered = F.col("admit"), F.col("class").isin("ok", "needs_js")
    browser = admitted & (F.col("advised") == "browser") & (F.col("capability") == "http")
    saved = F.coalesce(F.sum(F.when(~admitted, F.col("seconds"))), F.lit(0.0))
    share = lambda a, b: F.when(b > 0, F.round(a / b, 4))
    n, gone, lost = F.count(F.lit(1)), F.count_if(~admitted), F.count_if(~admitted & answered)
    return attempts.groupBy(*keys).agg(
        n.alias("attempts"), F.count_if(admitted).alias("executed"), gone.alias("suppressed"), F.count_if(admitted & F.col("probe")).alias("probes"), lost.alias("lost_answered"),
        F.count_if(browser & (F.col("class") == "needs_js")).alias("http_saved"), F.count_if(browser & (F.col("class") == "ok")).alias("browser_unneeded"),
        share(gone, n).alias("suppressed_share"), share(saved, F.sum("seconds")).alias("seconds_saved_share"), share(lost, gone).alias("lost_share"),
    )
