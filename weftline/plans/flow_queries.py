"""Admission, link events, relay, projections, campaigns, long runs and segments over the driver's tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.operators import admission as A
from weftline.operators import campaign as C
from weftline.operators import relay as R
from weftline.operators import soak as K
from weftline.plans.binding import TableView, ctes
from weftline.sources import segments as G

NOW = "1999-01-01 00:00:00"
EVENTS_NOW = "2024-01-30 00:00:00"
PRIORITY = {"seed": 80, "search": 60, "link": 50, "leaf": 30}


def _t(spark, sf_dir, name) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- admission: orders are offers of URLs, customers what is known about some of them ---------------------------------

_CANDIDATES = """SELECT concat('url_', CAST(o_custkey * 4 + o_orderkey % 4 AS STRING)) AS url_id, o_orderkey AS position,
    CASE o_orderkey % 4 WHEN 0 THEN 'seed' WHEN 1 THEN 'search' WHEN 2 THEN 'link' ELSE 'leaf' END AS origin,
    concat('h', CAST(o_custkey % 40 AS STRING), CASE WHEN o_custkey % 11 = 0 THEN '.onion' ELSE '.example.com' END) AS host, o_orderkey % 17 <> 0 AS valid,
    CASE WHEN o_orderkey % 6 = 0 THEN 'block' ELSE 'allow' END AS action, concat('r', CAST(o_orderkey % 3 AS STRING)) AS rule_id, 'a' AS ruleset,
    CASE WHEN o_custkey % 3 = 0 THEN NULL ELSE o_custkey % 7 <> 0 END AS advised_admit, CASE WHEN o_custkey % 3 = 0 THEN NULL WHEN o_custkey % 5 = 0 THEN 'browser' ELSE 'http' END AS advised_capability,
    CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE CAST(o_orderkey % 120 AS INT) END AS boosted, CASE WHEN o_orderkey % 8 = 1 THEN 'browser' ELSE 'http' END AS wanted_capability FROM {orders}"""
_STATES = """SELECT concat('url_', CAST(c_custkey * 4 + c_custkey % 4 AS STRING)) AS url_id, TIMESTAMP '1998-12-31 00:00:00' - CAST(c_custkey % 20 AS INT) * INTERVAL '1' DAY AS last_admitted_at,
    CASE WHEN c_custkey % 2 = 0 THEN 'block' ELSE 'allow' END AS last_action, 'r0' AS last_rule_id, 'a' AS last_ruleset FROM {customer}"""


def _admission(spark, sf_dir) -> DataFrame:
    offers = spark.sql(_CANDIDATES, orders=_t(spark, sf_dir, "orders"))
    states = spark.sql(_STATES, customer=_t(spark, sf_dir, "customer"))
    decided = A.decide(offers, states, F.lit(NOW), 7 * 86400.0, PRIORITY)
    number = F.substring_index("url_id", "_", -1).cast("long") % 5
    answers = decided.where("outcome is null").select("url_id", F.when(number == 0, "ready").when(number == 1, "scheduled").when(number == 2, "merged").when(number == 3, "rejected").alias("result"))
    return A.settle(decided, answers.where("result is not null"))


_ADMISSION = f"""WITH c AS ({_CANDIDATES.format(orders="orders")}), s AS ({_STATES.format(customer="customer")}),
  one AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY url_id ORDER BY position DESC) = 1),
  d AS (SELECT one.*, host LIKE '%.onion' AS onion, last_action, last_rule_id,
    CASE WHEN NOT valid THEN 'invalid' WHEN action = 'block' THEN 'blocked' WHEN last_admitted_at > TIMESTAMP '{NOW}' - INTERVAL 7 DAY THEN 'recent'
      WHEN host NOT LIKE '%.onion' AND advised_admit = false THEN 'source_deferred' END AS before,
    CASE CAST(substr(one.url_id, 5) AS BIGINT) % 5 WHEN 0 THEN 'admitted' WHEN 1 THEN 'admitted' WHEN 2 THEN 'merged' ELSE 'rejected_full' END AS after FROM one LEFT JOIN s ON one.url_id = s.url_id)
  SELECT url_id, origin, coalesce(before, after) AS outcome,
    CASE WHEN before IS NULL THEN CASE WHEN onion THEN 'tor' WHEN advised_admit IS NOT NULL AND advised_capability = 'browser' THEN 'browser' WHEN advised_admit IS NULL AND wanted_capability = 'browser' THEN 'browser' ELSE 'http' END END AS queue,
    CASE WHEN before IS NULL THEN CASE WHEN boosted <= 100 THEN boosted ELSE CASE origin WHEN 'seed' THEN 80 WHEN 'search' THEN 60 WHEN 'link' THEN 50 ELSE 30 END END END AS priority,
    CASE WHEN before IS NULL THEN CASE origin WHEN 'link' THEN 'discovered' WHEN 'leaf' THEN 'discovered' ELSE origin END END AS reason,
    CASE WHEN before IS NULL THEN after <> 'rejected_full' ELSE before = 'blocked' AND (last_action IS DISTINCT FROM 'block' OR last_rule_id IS DISTINCT FROM rule_id) END AS recorded FROM d"""


# --- link events: orders with two links each; the redirect hops of an order are its lines --------------------------------

def _links(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    orders, lines = _t(spark, sf_dir, "orders"), _t(spark, sf_dir, "lineitem")
    site = lambda n: F.concat(F.lit("h"), n.cast("string"))
    link = lambda n, rel: F.struct(n.cast("string").alias("url_id"), site(n % 30).alias("site"), F.lit(rel).alias("relation"))
    events = orders.select(F.col("o_orderkey").alias("event_id"), F.col("o_orderkey").alias("observation_id"), site(F.col("o_custkey") % 20).alias("page_site"), F.array(link(F.col("o_custkey"), "anchor"), link(F.col("o_orderkey"), "iframe")).alias("links"))
    hops = lines.select(F.col("l_orderkey").alias("observation_id"), F.when((F.col("l_linenumber") == 7) & (F.col("l_quantity") > 25), "block").otherwise("allow").alias("action"))
    rooted = _t(spark, sf_dir, "nation").select(site(F.col("n_nationkey") % 12).alias("site"))
    return A.link_events(events, rooted, A.redirect_blocked(hops))


_EVENTS = """e AS (SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber = 7 AND l_quantity > 25) THEN 'redirect_blocked'
    WHEN o_custkey % 20 >= 12 THEN 'leaf_page' ELSE 'admitted' END AS result FROM orders)"""
_LINK_CANDIDATES = f"""WITH {_EVENTS}, l AS (SELECT o_orderkey AS event_id, 0 AS position, o_custkey AS n, 'anchor' AS relation FROM e WHERE result = 'admitted'
    UNION ALL SELECT o_orderkey, 1, o_orderkey, 'iframe' FROM e WHERE result = 'admitted')
  SELECT event_id, position, CAST(n AS VARCHAR) AS url_id, relation, CASE WHEN n % 30 < 12 THEN 'link' ELSE 'leaf' END AS origin FROM l"""


# --- relay: events are outbox rows in 32 shards, errors and sign-ups not published yet ------------------------------------

_OUTBOX = "shard AS (SELECT DISTINCT user_id % 32 AS shard FROM events), r AS (SELECT event_id, user_id % 32 AS shard, CAST(floor(epoch(ts) / 60) AS BIGINT) AS bucket, event_type IN ('error', 'signup') AS waits FROM events)"
_FIRST = 28_401_120  # the bucket of 2024-01-01 00:00


def _outbox(spark, sf_dir):
    rows = _t(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 32).alias("shard"), R.bucket_of(F.col("ts")).alias("bucket"), F.when(~F.col("event_type").isin("error", "signup"), F.col("ts")).alias("published_at"))
    return rows, rows.select("shard").distinct().withColumn("checkpoint", F.when(F.col("shard") % 5 != 0, F.lit(_FIRST) + F.col("shard") * 600))


def _relay(spark, sf_dir) -> DataFrame:
    """For each shard: rows of a full cycle and its new checkpoint, of a hot one, of a late sweep, of a replayed hour."""
    rows, held = _outbox(spark, sf_dir)
    now, since = F.lit(EVENTS_NOW), F.lit("2024-01-01 00:00:00")
    full, hot = (R.scan(held, F.lit(_FIRST).cast("long"), now, 600, x) for x in (True, False))
    kinds = {"full": R.due(rows, full), "hot": R.due(rows, hot), "late": R.late(rows, held, since), "replay": R.replay(rows, F.lit("2024-01-05 10:00:00"), F.lit("2024-01-05 10:59:30"))}
    out = full.select("shard", F.lit("checkpoint").alias("kind"), F.col("checkpoint").alias("n"))
    for kind, found in kinds.items():
        out = out.unionByName(found.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).withColumn("kind", F.lit(kind)))
    return out


def _held(column: str) -> str:
    return f"(CASE WHEN {column} % 5 <> 0 THEN {_FIRST} + {column} * 600 ELSE {_FIRST} END)"


_RELAY = f"""WITH {_OUTBOX}, n AS (SELECT CAST(epoch(TIMESTAMP '{EVENTS_NOW}') / 60 AS BIGINT) AS now)
  SELECT shard, 'checkpoint' AS kind, greatest({_held("shard")}, now - 10) AS n FROM shard, n
  UNION ALL SELECT shard, 'full', count(*) FROM r, n WHERE waits AND bucket BETWEEN {_held("shard")} AND now GROUP BY 1
  UNION ALL SELECT shard, 'hot', count(*) FROM r, n WHERE waits AND bucket BETWEEN greatest({_held("shard")}, now - 1) AND now GROUP BY 1
  UNION ALL SELECT shard, 'late', count(*) FROM r WHERE waits AND shard % 5 <> 0 AND bucket >= {_FIRST} AND bucket < {_held("shard")} GROUP BY 1
  UNION ALL SELECT shard, 'replay', count(*) FROM r WHERE bucket BETWEEN {_FIRST} + 4 * 1440 + 600 AND {_FIRST} + 4 * 1440 + 659 GROUP BY 1"""


def _floors(spark, sf_dir) -> DataFrame:
    """Users are the consumer groups of an event type's stream; entries are named by second and id."""
    e = _t(spark, sf_dir, "events").withColumn("_id", F.struct(F.unix_seconds(F.col("ts").cast("timestamp")).alias("s"), F.col("event_id")))
    name = lambda c: F.concat(c["s"].cast("string"), F.lit("-"), c["event_id"].cast("string"))
    waits = F.col("value") > 150
    groups = e.groupBy(F.col("event_type").alias("stream"), "user_id").agg(name(F.max("_id")).alias("last_delivered_id"), F.count_if(waits).alias("pending"), name(F.min(F.when(waits, F.col("_id")))).alias("oldest_pending_id"))
    return R.trim_floor(groups)


_FLOORS = """WITH g AS (SELECT event_type, user_id, max((CAST(floor(epoch(ts)) AS BIGINT), event_id)) AS last, min((CAST(floor(epoch(ts)) AS BIGINT), event_id)) FILTER (WHERE value > 150) AS waits FROM events GROUP BY 1, 2),
  n AS (SELECT event_type, CASE WHEN waits IS NULL THEN {'ms': last[1], 'seq': last[2] + 1} ELSE {'ms': waits[1], 'seq': waits[2]} END AS f FROM g)
  SELECT event_type AS stream, min(f).ms AS floor_ms, min(f).seq AS floor_seq FROM n GROUP BY 1"""


# --- matches, media, campaigns ------------------------------------------------------------------------------------------

def _matches_by_domain(spark, sf_dir) -> DataFrame:
    o = _t(spark, sf_dir, "orders")
    domain = lambda k: F.concat(F.lit("dom_"), k.cast("string"))
    rows = o.select((F.col("o_orderkey") % 900).alias("match_id"), F.col("o_orderdate").alias("decided_at"), F.array(domain(F.col("o_orderkey") % 3), domain(F.col("o_orderkey") % 900 % 2)).alias("domains"), F.col("o_orderkey").alias("decision"), F.col("o_orderstatus").alias("verdict"))
    return R.match_projection(rows, "domain_id")


def _media(spark, sf_dir) -> DataFrame:
    lines, parts, orders = (_t(spark, sf_dir, n) for n in ("lineitem", "part", "orders"))
    refs = lines.select(F.col("l_orderkey").alias("page_observation_id"), (F.col("l_partkey") % 40).alias("media_id"), F.col("l_linenumber").alias("position"), F.col("l_returnflag").alias("kind"))
    latest = parts.where("p_partkey between 1 and 37").select(F.col("p_partkey").alias("media_id"), F.when(F.col("p_partkey") % 3 == 0, "unreachable").otherwise("probed").alias("status"), F.when(F.col("p_partkey") % 3 != 0, F.col("p_partkey")).alias("content_id"))
    claimed = orders.where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("page_observation_id"), (F.col("o_custkey") % 40).alias("media_id"), (F.col("o_orderkey") % 4 == 0).alias("committed"))
    return R.media_observations(refs, latest, claimed).groupBy("kind", "status", "result").agg(F.count(F.lit(1)).alias("n"), F.sum("position").alias("positions"), F.count("content_id").alias("contents"))


_MEDIA = """WITH f AS (SELECT l_orderkey, l_partkey % 40 AS m, min({'p': l_linenumber, 'k': l_returnflag}) AS r FROM lineitem GROUP BY 1, 2),
  rows AS (SELECT r, CASE WHEN m BETWEEN 1 AND 37 THEN CASE WHEN m % 3 = 0 THEN 'unreachable' ELSE 'probed' END ELSE 'unprobed' END AS status, CASE WHEN m BETWEEN 1 AND 37 AND m % 3 <> 0 THEN m END AS content,
    CASE WHEN o_orderkey IS NULL THEN 'claimed' WHEN o_orderkey % 4 = 0 THEN 'replayed' ELSE 'resumed' END AS result FROM f LEFT JOIN orders ON o_orderkey = l_orderkey AND o_orderkey % 2 = 0 AND o_custkey % 40 = m)
  SELECT r.k AS kind, status, result, count(*) AS n, sum(r.p) AS positions, count(content) AS contents FROM rows GROUP BY 1, 2, 3"""
_CAMPAIGN_SETS = ("campaigns", "targets", "matches", "evidence_candidates", "evidence_versions", "evidence_sources")


def _campaign(spark, sf_dir) -> DataFrame:
    v = TableView(spark, sf_dir)
    campaigns, targets, matches, candidates, versions, sources = (v.table(n) for n in _CAMPAIGN_SETS)
    sites = sources.withColumn("site", F.concat(F.lit("h"), (F.substring_index("page_url_id", "_", -1).cast("long") % 40).cast("string")))
    return C.statistics(campaigns, targets, matches, candidates, versions, sites, F.lit(NOW).cast("timestamp"))


_CAMPAIGN = ctes(*_CAMPAIGN_SETS) + f""", own AS (SELECT campaign_id, target_id, date_trunc('month', min(since)) AS since FROM campaigns GROUP BY 1, 2),
  listed AS (SELECT campaign_id, CASE WHEN target_id IN (SELECT target_id FROM targets) THEN 'registered' ELSE 'not_in_projection' END AS k FROM own),
  met AS (SELECT DISTINCT campaign_id, match_id, verdict FROM matches JOIN own USING (target_id) WHERE decided_at <= TIMESTAMP '{NOW}' AND (since IS NULL OR decided_at >= since)),
  ev AS (SELECT DISTINCT campaign_id, evidence_id, match_id, status FROM evidence_candidates JOIN own USING (target_id) WHERE collected_at <= TIMESTAMP '{NOW}' AND (since IS NULL OR collected_at >= since)),
  newest AS (SELECT evidence_id, max({{'v': version, 's': status}}).s AS final, count(DISTINCT version) AS n FROM evidence_versions GROUP BY 1),
  fin AS (SELECT campaign_id, final, n FROM ev JOIN newest USING (evidence_id)),
  rec AS (SELECT campaign_id, page_url_id, ordinal, max(basis) AS basis, 'h' || (CAST(substr(page_url_id, 5) AS BIGINT) % 40) AS site FROM evidence_sources JOIN ev USING (evidence_id) GROUP BY 1, 2, 3),
  pg AS (SELECT DISTINCT campaign_id, page_url_id, site FROM rec)
  SELECT campaign_id, 'targets' AS measure, NULL AS key, count(*) AS value FROM listed GROUP BY 1 UNION ALL SELECT campaign_id, 'targets_by_state', k, count(*) FROM listed GROUP BY 1, 3
  UNION ALL SELECT campaign_id, 'matches', NULL, count(*) FROM met GROUP BY 1 UNION ALL SELECT campaign_id, 'matches_by_verdict', verdict, count(*) FROM met GROUP BY 1, 3
  UNION ALL SELECT campaign_id, 'matches_without_candidate', NULL, count(*) FROM met WHERE (campaign_id, match_id) NOT IN (SELECT (campaign_id, match_id) FROM ev) GROUP BY 1
  UNION ALL SELECT campaign_id, 'candidates', NULL, count(*) FROM ev GROUP BY 1 UNION ALL SELECT campaign_id, 'candidates_by_status', status, count(*) FROM ev GROUP BY 1, 3
  UNION ALL SELECT campaign_id, 'finalized', NULL, count(*) FROM fin GROUP BY 1 UNION ALL SELECT campaign_id, 'finalized_by_status', final, count(*) FROM fin GROUP BY 1, 3
  UNION ALL SELECT campaign_id, 'superseded_versions', NULL, sum(n - 1) FROM fin GROUP BY 1
  UNION ALL SELECT campaign_id, 'source_records', NULL, count(*) FROM rec GROUP BY 1 UNION ALL SELECT campaign_id, 'sources_by_basis', basis, count(*) FROM rec GROUP BY 1, 3
  UNION ALL SELECT campaign_id, 'pages', NULL, count(*) FROM pg GROUP BY 1 UNION ALL SELECT campaign_id, 'pages_by_domain', site, count(*) FROM pg GROUP BY 1, 3"""


# --- long runs, replay, snapshots, segments ------------------------------------------------------------------------------

def _tallies(spark, sf_dir) -> DataFrame:
    e = _t(spark, sf_dir, "events")
    kind = F.when(F.col("event_type") == "click", "ok").when(F.col("event_type") == "view", "needs_js").otherwise("unreachable")
    rows = e.select("user_id", F.col("value").alias("seconds"), kind.alias("class"), F.when(F.col("event_id") % 2 == 0, "http").otherwise("browser").alias("capability"), (F.col("event_id") % 3 != 0).alias("admit"), (F.col("event_id") % 7 == 0).alias("probe"), F.when(F.col("event_id") % 5 == 0, "browser").otherwise("http").alias("advised"))
    return K.replay_tallies(rows, "user_id")


_TALLIES = """WITH e AS (SELECT *, event_id % 3 <> 0 AS admit, event_id % 3 <> 0 AND event_id % 5 = 0 AND event_id % 2 = 0 AS shift FROM events)
  SELECT user_id, count(*) AS attempts, count(*) FILTER (WHERE admit) AS executed, count(*) FILTER (WHERE NOT admit) AS suppressed, count(*) FILTER (WHERE admit AND event_id % 7 = 0) AS probes,
    count(*) FILTER (WHERE NOT admit AND event_type IN ('click', 'view')) AS lost_answered, count(*) FILTER (WHERE shift AND event_type = 'view') AS http_saved, count(*) FILTER (WHERE shift AND event_type = 'click') AS browser_unneeded,
    round(count(*) FILTER (WHERE NOT admit) / count(*), 4) AS suppressed_share, CASE WHEN sum(value) > 0 THEN round(coalesce(sum(value) FILTER (WHERE NOT admit), 0) / sum(value), 4) END AS seconds_saved_share,
    CASE WHEN count(*) FILTER (WHERE NOT admit) > 0 THEN round(count(*) FILTER (WHERE NOT admit AND event_type IN ('click', 'view')) / count(*) FILTER (WHERE NOT admit), 4) END AS lost_share FROM e GROUP BY 1"""


def _trends(spark, sf_dir) -> DataFrame:
    rows = _t(spark, sf_dir, "events").select("event_type", F.col("ts").alias("at"), "value")
    return K.trends(rows, ["event_type"]).select("event_type", "points", F.round("slope_per_hour", 6).alias("slope_per_hour"), F.round("growth", 6).alias("growth"))


_TRENDS = """WITH k AS (SELECT event_type, value, epoch(ts) / 3600 AS h, row_number() OVER (PARTITION BY event_type ORDER BY ts, value) AS k, count(*) OVER (PARTITION BY event_type) AS n FROM events),
  z AS (SELECT event_type, n, h - min(h) OVER (PARTITION BY event_type) AS h, value, k, greatest(1, n // 10) AS t FROM k)
  SELECT event_type, n AS points, round(regr_slope(value, h), 6) AS slope_per_hour, round((avg(value) FILTER (WHERE k > n - t) - avg(value) FILTER (WHERE k <= t)) / CASE WHEN median(value) = 0 THEN 1 ELSE abs(median(value)) END, 6) AS growth FROM z GROUP BY 1, 2"""


def _criteria(spark, sf_dir) -> DataFrame:
    """Users are runs: errors interrupt, purchases complete, sign-ups are clock anomalies, views sample a series."""
    e = _t(spark, sf_dir, "events")
    runs = e.groupBy(F.col("user_id").alias("run")).agg(F.min("ts").alias("started_at"), F.max_by("event_type", F.struct("ts", "event_id")).alias("_t")).select("run", "started_at", F.lit(20 * 86400.0).alias("required_seconds"), F.when(F.col("_t") == "purchase", "completed").otherwise("running").alias("phase"))
    kind = F.when(F.col("event_type") == "error", "interruption").when(F.col("event_type") == "purchase", "completed").when(F.col("event_type") == "signup", "clock_anomaly")
    marks = e.select(F.col("user_id").alias("run"), kind.alias("kind"), F.col("ts").alias("at"), F.col("value").alias("gap_seconds")).where("kind is not null")
    samples = e.where("event_type in ('view', 'click')").select(F.col("user_id").alias("run"), F.col("event_type").alias("series"), F.col("ts").alias("at"), F.col("value"))
    return K.criteria(runs, marks, samples, ["view"], F.col("series") == "none", 60.0, K.Limits(interruptions=3, interruption_seconds=200.0, coverage=0.5))


_CRITERIA = """WITH r AS (SELECT user_id AS run, min(ts) AS s, arg_max(event_type, {'t': ts, 'e': event_id}) AS last, max(ts) FILTER (WHERE event_type = 'purchase') AS done,
    count(*) FILTER (WHERE event_type = 'error') AS breaks, max(value) FILTER (WHERE event_type = 'error') AS longest, count(*) FILTER (WHERE event_type = 'signup') AS clock,
    count(DISTINCT ts) FILTER (WHERE event_type IN ('view', 'click')) AS n, count(DISTINCT ts) FILTER (WHERE event_type = 'view') AS views FROM events GROUP BY 1)
  SELECT run, 'DURATION' AS criterion, CASE WHEN last = 'purchase' AND epoch(done) - epoch(s) >= 20 * 86400 * 0.999 THEN 'pass' ELSE 'fail' END AS status FROM r
  UNION ALL SELECT run, 'CONTINUITY', CASE WHEN breaks > 3 OR longest > 200 THEN 'fail' ELSE 'pass' END FROM r
  UNION ALL SELECT run, 'CLOCK', CASE WHEN clock > 0 THEN 'inconclusive' ELSE 'pass' END FROM r
  UNION ALL SELECT run, 'METRICS', CASE WHEN n = 0 OR views = 0 OR views < 0.5 * n THEN 'inconclusive' ELSE 'pass' END FROM r
  UNION ALL SELECT run, 'SAMPLES', CASE WHEN n = 0 THEN 'inconclusive' ELSE 'pass' END FROM r UNION ALL SELECT run, 'OUTAGE', 'inconclusive' FROM r"""


def _snapshots(spark, sf_dir) -> DataFrame:
    c = _t(spark, sf_dir, "customer")
    at = lambda days: F.lit(NOW).cast("timestamp") - F.make_dt_interval(days=(F.col("c_custkey") % days).cast("int"))
    loaded, through = F.when(F.col("c_custkey") % 9 != 0, at(6)), F.when(F.col("c_custkey") % 10 != 0, at(8))
    policy = F.when(F.col("c_custkey") % 4 == 0, "p1").otherwise("p2")
    why = A.snapshot_fallback(F.lit(NOW), loaded, through, policy, "p2", 4 * 86400.0, 5 * 86400.0)
    return c.select(F.coalesce(why, F.lit("informed")).alias("state")).groupBy("state").agg(F.count(F.lit(1)).alias("n"))


def _segments(spark, sf_dir) -> DataFrame:
    """Orders scanned segment by segment, counted again in one pass; segments, rows and drift in all."""
    of = 8
    source = G.TableSource("tables", {"orders": (_t(spark, sf_dir, "orders"), ["o_orderkey"])})
    scans = [source.scan("orders", ["o_orderkey"], k, of).agg(F.count(F.lit(1)).alias("rows")).select(F.lit(k).alias("segment"), "rows") for k in range(of)]
    scanned = scans[0]
    for s in scans[1:]:
        scanned = scanned.unionByName(s)
    return G.drift(scanned, source.counts("orders", of), of).agg(F.count(F.lit(1)).alias("segments"), F.sum("scanned").alias("scanned"), F.sum(F.abs("delta")).alias("drift"))


QUERIES: dict = {
    "admission_outcomes": _admission,
    "link_event_results": lambda spark, sf_dir: _links(spark, sf_dir)[0],
    "link_event_candidates": lambda spark, sf_dir: _links(spark, sf_dir)[1].select("event_id", "position", "url_id", "relation", "origin"),
    "probe_grants": lambda spark, sf_dir: A.granted_probes(_t(spark, sf_dir, "events").select(F.col("user_id").alias("domain_id"), F.col("ts").alias("at")), 6 * 3600.0).groupBy("domain_id").agg(F.count(F.lit(1)).alias("grants")),
    "snapshot_fallbacks": _snapshots,
    "relay_cycle": _relay,
    "stream_trim_floor": _floors,
    "match_projection_domain": _matches_by_domain,
    "media_observation_claims": _media,
    "campaign_statistics": _campaign,
    "replay_tallies": _tallies,
    "series_trends": _trends,
    "soak_criteria": _criteria,
    "segment_drift": _segments,
}

ORACLES: dict[str, str] = {
    "admission_outcomes": _ADMISSION,
    "link_event_results": f"WITH {_EVENTS} SELECT o_orderkey AS event_id, result FROM e",
    "link_event_candidates": _LINK_CANDIDATES,
    "snapshot_fallbacks": """SELECT CASE WHEN c_custkey % 9 = 0 THEN 'unavailable' WHEN c_custkey % 6 > 4 THEN 'snapshot_stale' WHEN c_custkey % 10 = 0 THEN 'unavailable' WHEN c_custkey % 4 = 0 THEN 'policy_mismatch'
      WHEN c_custkey % 8 > 5 THEN 'projection_stale' ELSE 'informed' END AS state, count(*) AS n FROM customer GROUP BY 1""",
    "relay_cycle": _RELAY,
    "stream_trim_floor": _FLOORS,
    "match_projection_domain": """WITH m AS (SELECT DISTINCT o_orderkey % 900 AS match_id, o_orderdate AS decided_at, o_orderkey AS decision, o_orderstatus AS verdict, unnest(['dom_' || (o_orderkey % 3), 'dom_' || (o_orderkey % 900 % 2)]) AS domain_id FROM orders)
      SELECT domain_id, strftime(decided_at, '%Y-%m') AS month, match_id, decided_at, decision, verdict FROM m QUALIFY row_number() OVER (PARTITION BY domain_id, strftime(decided_at, '%Y-%m'), match_id ORDER BY decided_at DESC, decision DESC) = 1""",
    "media_observation_claims": _MEDIA,
    "campaign_statistics": _CAMPAIGN,
    "replay_tallies": _TALLIES,
    "series_trends": _TRENDS,
    "soak_criteria": _CRITERIA,
    "segment_drift": "SELECT 8 AS segments, count(*) AS scanned, 0 AS drift FROM orders",
}
