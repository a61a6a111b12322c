"""Page text, blacklists, metrics, alerts and settled minutes over the driver's tables, with SQL for the same results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions import text as X
from weftline.operators import signals as S

NOW = "2024-01-30 00:00:00"


def _q(name, fn):
    return lambda spark, sf_dir: fn(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def _titles(pages: DataFrame) -> DataFrame:
    title = X.folded(F.regexp_extract("html", "(?is)<title>(.*?)</title>", 1))
    return pages.select("page_id", F.explode(X.title_segments(title)).alias("segment")).groupBy("segment").agg(F.count(F.lit(1)).alias("pages"))


def _blacklist(pages: DataFrame) -> DataFrame:
    """Every URL is a line; each host once with its lines, rejected lines under a null."""
    return pages.select(X.listed_host(F.col("url")).alias("host"), "page_id").groupBy("host").agg(F.count(F.lit(1)).alias("lines"), F.min("page_id").alias("first_line"))


def _samples(events: DataFrame) -> DataFrame:
    """Events written as a metrics page, read back, and summed by selectors."""
    line = F.concat(F.lit('events_total{type="'), "event_type", F.lit('",user="'), F.col("user_id").cast("string"), F.lit('"} '), F.col("event_id").cast("string"))
    found = S.samples(events.select(F.explode(F.array(line, F.lit("# HELP events_total x"), F.lit(""))).alias("line")), "line")
    picks = ['events_total{type="error"}', 'events_total{type="click",user="3"}', 'events_total{type="none"}', 'events_total{type="error"} / events_total']
    out = [S.selected(found, p).select(F.lit(p).alias("selector"), F.round("value", 6).alias("value")) for p in picks]
    return out[0].union(out[1]).union(out[2]).union(out[3])


def _alerts(events: DataFrame) -> DataFrame:
    """Hours in which over a quarter of an event type's rows have a large value, two hours in a row."""
    hour = F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 3600).cast("long")
    hourly = events.groupBy("event_type", hour.alias("hour")).agg(F.count_if(F.col("value") > 50).alias("large"), F.count(F.lit(1)).alias("n"))
    return S.alerts(hourly, ["event_type"], "hour", F.col("large") * 4 > F.col("n"), 2)


QUERIES: dict = {
    "title_segments": _q("pages", _titles),
    "document_scripts": _q("documents", lambda d: d.select("lang", X.dominant_script("text").alias("script")).groupBy("lang", "script").agg(F.count(F.lit(1)).alias("n"))),
    "blacklist_hosts": _q("pages", _blacklist),
    "metric_selectors": _q("events", _samples),
    "metric_alerts": _q("events", _alerts),
    "settled_minutes": _q("events", lambda e: S.settled(e, "ts", F.lit(NOW), 600, F.lit(28_401_120))),
}

_SUM = lambda where: f"(SELECT sum(event_id) FROM events WHERE {where})"
ORACLES: dict[str, str] = {
    "title_segments": r"""SELECT segment, count(*) AS pages FROM (SELECT page_id, unnest(regexp_split_to_array(trim(replace(lower(regexp_extract(html, '(?is)<title>(.*?)</title>', 1)), 'ß', 'ss')), '\s+[-|–—:·»]+\s+|\s*\|\s*')) AS segment FROM pages) WHERE segment <> '' GROUP BY segment""",
    "blacklist_hosts": """SELECT host, count(*) AS lines, min(page_id) AS first_line FROM (SELECT page_id, nullif(lower(regexp_extract(url, '^[a-z]+://([^/?:]+)', 1)), '') AS host FROM pages) GROUP BY host""",
    "metric_selectors": f"""SELECT unnest(['events_total{{type="error"}}', 'events_total{{type="click",user="3"}}', 'events_total{{type="none"}}', 'events_total{{type="error"}} / events_total']) AS selector,
      unnest([{_SUM("event_type = 'error'")}::DOUBLE, {_SUM("event_type = 'click' AND user_id = 3")}::DOUBLE, NULL, round({_SUM("event_type = 'error'")} / {_SUM('true')}, 6)]) AS value""",
    "metric_alerts": """WITH h AS (SELECT event_type, CAST(floor(epoch(ts) / 3600) AS BIGINT) AS hour FROM events GROUP BY 1, 2 HAVING 4 * count(*) FILTER (WHERE value > 50) > count(*)),
      m AS (SELECT event_type, hour, sum(step) OVER (PARTITION BY event_type ORDER BY hour) AS run FROM (SELECT *, CASE WHEN lag(hour) OVER (PARTITION BY event_type ORDER BY hour) = hour - 1 THEN 0 ELSE 1 END AS step FROM h))
      SELECT event_type, min(hour) AS started, min(hour) + 1 AS firing_from, count(*) AS buckets FROM m GROUP BY event_type, run HAVING count(*) >= 2""",
    "settled_minutes": f"SELECT CAST(floor(epoch(ts) / 60) AS BIGINT) AS bucket, count(*) AS facts FROM events WHERE ts < TIMESTAMP '{NOW}' - INTERVAL 10 MINUTE AND epoch(ts) >= 60 * 28401121 GROUP BY 1",
}
