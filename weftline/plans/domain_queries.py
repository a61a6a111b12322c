"""URL functions, identities, source health, feedback and ledger over the driver's tables, with SQL where it can be said."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions import identity as I
from weftline.functions import urls as U
from weftline.operators import feedback, health, ledger
from weftline.operators import joins as J

NOW = "2024-01-30 00:00:00"


def _t(spark, sf_dir, name) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _q(name, fn):
    return lambda spark, sf_dir: fn(_t(spark, sf_dir, name))


def _q2(a, b, fn):
    return lambda spark, sf_dir: fn(_t(spark, sf_dir, a), _t(spark, sf_dir, b))


def _now():
    return F.lit(NOW).cast("timestamp")


def _facts(events: DataFrame) -> DataFrame:
    """Events as facts: views and clicks answer, errors are unreachable, sign-ups blocked; some clicks move."""
    moved = F.when((F.col("event_type") == "click") & (F.col("event_id") % 13 == 0), F.concat(F.lit("site"), (F.col("event_id") % 5).cast("string")))
    kind = F.when(moved.isNotNull(), "moved").when(F.col("event_type") == "click", "ok").when(F.col("event_type") == "view", F.when(F.col("event_id") % 4 == 0, "needs_js").otherwise("ok")).when(F.col("event_type") == "error", "unreachable").when(F.col("event_type") == "signup", "blocked").otherwise("http_error")
    return events.select(F.col("user_id").alias("domain_id"), F.col("ts").alias("at"), F.when(F.col("event_id") % 3 == 0, "browser").otherwise("http").alias("capability"), kind.alias("class"), moved.alias("moved_to"))


_FACTS = """facts AS (SELECT user_id AS domain_id, epoch(ts) AS t, CASE WHEN event_id % 3 = 0 THEN 'browser' ELSE 'http' END AS capability,
  CASE WHEN event_type = 'click' AND event_id % 13 = 0 THEN 'moved' WHEN event_type = 'click' THEN 'ok' WHEN event_type = 'view' THEN CASE WHEN event_id % 4 = 0 THEN 'needs_js' ELSE 'ok' END
  WHEN event_type = 'error' THEN 'unreachable' WHEN event_type = 'signup' THEN 'blocked' ELSE 'http_error' END AS class,
  CASE WHEN event_type = 'click' AND event_id % 13 = 0 THEN 'site' || (event_id % 5) END AS moved_to FROM events),
  aged AS (SELECT *, exp((t - last) / 86400.0) AS w, exp((t - last) / 604800.0) AS c FROM (SELECT *, max(t) OVER (PARTITION BY domain_id) AS last FROM facts)),
  p AS (SELECT domain_id, max(t) AS ref, """ + ", ".join(f"coalesce(sum(w) FILTER (WHERE CASE WHEN class = 'needs_js' THEN 'ok' ELSE class END = '{k}'), 0) AS w_{k}" for k in health.CLASSES) + """,
  coalesce(sum(c) FILTER (WHERE capability = 'http' AND class = 'ok'), 0) AS http_ok, coalesce(sum(c) FILTER (WHERE capability = 'http' AND class = 'needs_js'), 0) AS http_needs_js,
  coalesce(sum(c) FILTER (WHERE capability = 'browser' AND class IN ('ok', 'needs_js')), 0) AS browser_ok, count(*) AS facts, min(t) AS first_seen, max(t) FILTER (WHERE class IN ('ok', 'needs_js')) AS last_ok,
  max(t) FILTER (WHERE capability = 'http') AS last_http, max({'t': t, 'm': moved_to}) FILTER (WHERE moved_to IS NOT NULL).m AS moved_to FROM aged GROUP BY 1)"""
_POLICY = health.Policy()
_WEIGHTS = [f"w_{k}" for k in health.CLASSES]


def _profiles(events):
    return health.profiles(_facts(events)).select("domain_id", *[F.round(c, 6).alias(c) for c in (*_WEIGHTS, "http_ok", "http_needs_js", "browser_ok")], "facts", "moved_to")


def _assessment(events):
    rows = health.assess(health.profiles(_facts(events)), _now())
    return rows.select("domain_id", "state", "capability", "probe", "admit", *[F.round(c, 5).alias(c) for c in _WEIGHTS])


def _evidence(orders: DataFrame) -> DataFrame:
    return orders.select(F.pmod("o_custkey", F.lit(40)).alias("domain_id"), F.col("o_orderkey").alias("match_id"), F.pmod("o_orderkey", F.lit(120)).alias("page_observation_id"), F.pmod("o_custkey", F.lit(90)).alias("target_id"),
        F.col("o_orderdate").alias("decided_at"), (F.pmod("o_orderkey", F.lit(100)) / 100.0).alias("confidence"), F.when(F.col("o_orderstatus") == "F", "confirmed").otherwise("probable").alias("verdict"),
        F.concat(F.lit("/t"), F.pmod("o_orderkey", F.lit(3)).cast("string")).alias("template"), F.when(F.pmod("o_orderkey", F.lit(4)) == 0, "browser").otherwise("http").alias("capability"),
        F.when(F.pmod("o_custkey", F.lit(90)) % 3 == 0, "retired").when(F.pmod("o_custkey", F.lit(90)) % 3 == 1, "active").otherwise("unknown").alias("relevance"))


_FNOW = "1998-08-01 00:00:00"
_EVIDENCE = f"""e AS (SELECT o_custkey % 40 AS domain_id, o_orderkey AS match_id, o_orderkey % 120 AS page_observation_id, o_custkey % 90 AS target_id, '/t' || (o_orderkey % 3) AS template, CASE WHEN o_orderkey % 4 = 0 THEN 'browser' ELSE 'http' END AS capability,
  CASE o_custkey % 90 % 3 WHEN 0 THEN 0.1 WHEN 1 THEN 1.0 ELSE 0.5 END AS w, CASE WHEN age > 7776000 THEN 0 ELSE (o_orderkey % 100) / 100.0 * CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.5 END * exp(-greatest(age, 0) / 1209600.0) END AS s
  FROM (SELECT *, epoch(TIMESTAMP '{_FNOW}') - epoch(o_orderdate) AS age FROM orders))"""
_VALUE = lambda keys: f"SELECT {keys}, sum(w * s) AS value, count(*) AS targets FROM (SELECT {keys}, target_id, max(s) AS s, max(w) AS w FROM e GROUP BY ALL) GROUP BY ALL"


def _ledger(orders, lineitem):
    sources = orders.select(F.lit("order_has_line").alias("edge"), F.col("o_orderkey").alias("key"), F.col("o_orderdate").alias("observed")).unionByName(orders.select(F.lit("customer_has_return"), F.col("o_custkey"), "o_orderdate").toDF("edge", "key", "observed"))
    effects = lineitem.where("l_orderkey % 7 > 0").select(F.lit("order_has_line").alias("edge"), F.col("l_orderkey").alias("key"), F.col("l_shipdate").alias("at"), F.col("l_linestatus").alias("effect"))
    effects = effects.unionByName(lineitem.where("l_returnflag = 'R'").select(F.lit("customer_has_return"), F.col("l_partkey"), "l_shipdate", "l_returnflag").toDF("edge", "key", "at", "effect"))
    rows = ledger.edge_results(sources, effects, F.lit("1998-08-01").cast("timestamp"), 365 * 86400.0, F.lit("1996-01-01").cast("timestamp"))
    return rows.withColumn("oldest_unaccounted_s", F.round("oldest_unaccounted_s", 3))


_RULES = [("r1", "host", "example.com", "CONTENT"), ("r2", "host", "example.org", "AD"), ("r3", "host", "spam-farm.example.org", "TRACKER"), ("r4", "host", "cheap-pills.example.com", "AD"), ("r5", "label", "blog", "NAVIGATION"), ("r6", "label", "m", "PLAYER")]


def _rule_join(pages: DataFrame) -> DataFrame:
    """Host-suffix and label rules by an index join: a host's suffixes and labels meet the rules' keys."""
    rules = pages.sparkSession.createDataFrame(_RULES, "rule_id string, kind string, pattern string, classification string")
    labels = F.split("host", "[.]")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.struct(F.lit("host").alias("kind"), F.array_join(F.slice(labels, k, F.size(labels)), ".").alias("pattern")))
    own = F.transform(F.array_distinct(F.slice(labels, 1, F.size(labels) - 1)), lambda x: F.struct(F.lit("label").alias("kind"), x.alias("pattern")))
    keys = pages.select("page_id", U.host(F.col("url")).alias("host")).select("page_id", F.explode(F.concat(suffixes, own)).alias("_k")).select("page_id", "_k.kind", "_k.pattern")
    return keys.join(F.broadcast(rules), ["kind", "pattern"]).select("page_id", "rule_id", "classification")


def _links(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(r'<a href="([^"]*)"'), F.lit(1))).alias("ordinal", "href"))


_HOST = "lower(regexp_extract(url, '^https?://([^/?#:]+)', 1))"

QUERIES: dict = {
    "url_host_site": _q("pages", lambda p: p.select("page_id", U.host(F.col("url")).alias("host"), U.site(F.col("url")).alias("site"), U.is_third_party(U.host(F.col("url")), F.lit("a.example.com")).alias("third_party"), U.path_extension(F.col("url")).alias("extension"), U.spelling_key(F.col("url")).alias("spelling"), U.display_url(F.col("url")).alias("shown"))),
    "url_canonical": _q("pages", lambda p: p.select("page_id", U.canonical_url("url").alias("canonical"))),
    "url_templates": _q("pages", lambda p: p.select("page_id", U.url_shape("url").alias("s")).groupBy("s.template", "s.structural").agg(F.count(F.lit(1)).alias("n"))),
    "derived_ids": _q("pages", lambda p: p.select("page_id", I.derived_id("url", F.col("url")).alias("url_id"), I.digest(F.col("html").cast("binary")).alias("body_digest"))),
    "wire_ids": _q("orders", lambda o: o.select("o_orderkey", I.wire_id("match", F.md5(F.col("o_orderkey").cast("string"))).alias("match_id"), I.wire_id("match", F.col("o_orderpriority")).alias("malformed"))),
    "media_kinds": _q("part", lambda p: p.select("p_partkey", U.media_kind(F.concat(F.lit("https://cdn.example/"), "p_partkey", F.element_at(F.array(F.lit(".mp4"), F.lit(".m3u8?x=1"), F.lit(".JPG"), F.lit("/"), F.lit(".ogg#a")), (F.pmod("p_partkey", F.lit(5)) + 1).cast("int"))), F.when(F.pmod("p_partkey", F.lit(4)) == 0, "Video/mp4; a=b")).alias("kind"))),
    "json_paths": _q("events", lambda e: e.select("event_id", F.from_json("props", "k int")["k"].alias("k"), F.get_json_object("props", "$.missing").alias("missing"))),
    "time_buckets": _q("events", lambda e: e.select("event_id", F.date_format("ts", "yyyyMMdd").alias("day"), F.date_format("ts", "yyyy-MM").alias("month"), F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 60).alias("minute"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("iso"))),
    "page_link_fanout": _q("pages", _links),
    "page_links_per_page": _q("pages", lambda p: _links(p).groupBy("page_id").agg(F.count(F.lit(1)).alias("links"), F.countDistinct("href").alias("distinct_links"))),
    "source_profiles": _q("events", _profiles),
    "source_assessment": _q("events", _assessment),
    "feedback_sources": _q("orders", lambda o: feedback.assess_sources(_evidence(o), F.lit(_FNOW).cast("timestamp")).select("domain_id", F.round("value", 6).alias("value"), "targets", "matches", "boost")),
    "feedback_patterns": _q("orders", lambda o: feedback.assess_patterns(_evidence(o), F.lit(_FNOW).cast("timestamp")).select("domain_id", "template", F.round("value", 6).alias("value"), "support", "boost")),
    "feedback_capability": _q("orders", lambda o: feedback.capability_weights(_evidence(o), F.lit(_FNOW).cast("timestamp")).select("domain_id", F.round("http", 6).alias("http"), F.round("browser", 6).alias("browser"))),
    "ledger_edges": _q2("orders", "lineitem", _ledger),
    "ledger_redeliveries": _q("lineitem", lambda r: ledger.redeliveries(r.select(F.col("l_returnflag").alias("event_type"), F.col("l_orderkey").alias("event_id")))),
    "ledger_stages": _q("lineitem", lambda r: ledger.stage_counts(r.select(F.col("l_returnflag").alias("event_type"), F.col("l_orderkey").alias("event_id")))),
    "rule_index_join": _q("pages", _rule_join),
    "unlabelled_documents": _q2("documents", "labels", lambda d, x: J.not_in(d.select("doc_id", "lang"), "doc_id", x, "doc_id")),
}

_SITE = lambda h: f"CASE WHEN len(string_split({h}, '.')) <= 2 THEN {h} ELSE array_to_string(string_split({h}, '.')[-2:], '.') END"
ORACLES: dict[str, str] = {
    "url_host_site": f"""SELECT page_id, h AS host, {_SITE('h')} AS site, {_SITE('h')} <> 'example.com' AS third_party, CASE WHEN x <> '' THEN x END AS extension, rtrim(regexp_replace(lower(url), '^https?://(www\\.)?', ''), '/') AS spelling,
      regexp_replace(regexp_replace(url, '^([A-Za-z]+://)[^/?#@]*@', '\\1'), '([?&](access_token|api_key|apikey|auth|key|password|secret|session|sid|sig|signature|token)=)[^&#]*', '\\1***', 'gi') AS shown
      FROM (SELECT *, {_HOST} AS h, lower(regexp_extract(url, '^[^?#]*/[^/?#]*\\.([A-Za-z0-9]{{1,8}})([?#]|$)', 1)) AS x FROM pages)""",
    "derived_ids": """SELECT page_id, 'url_' || substr(h, 1, 12) || '8' || substr(h, 14, 3) || CASE WHEN substr(h, 17, 1) IN ('0', '4', '8', 'c') THEN '8' WHEN substr(h, 17, 1) IN ('1', '5', '9', 'd') THEN '9' WHEN substr(h, 17, 1) IN ('2', '6', 'a', 'e') THEN 'a' ELSE 'b' END || substr(h, 18, 15) AS url_id, 'sha256:' || sha256(html) AS body_digest
      FROM (SELECT *, sha256('3:url' || strlen(url) || ':' || url) AS h FROM pages)""",
    "wire_ids": "SELECT o_orderkey, 'mat_' || md5(CAST(o_orderkey AS VARCHAR)) AS match_id, CAST(NULL AS VARCHAR) AS malformed FROM orders",
    "media_kinds": "SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN 'video' ELSE CASE p_partkey % 5 WHEN 0 THEN 'video' WHEN 1 THEN 'manifest' WHEN 2 THEN 'image' WHEN 3 THEN NULL ELSE 'audio' END END AS kind FROM part",
    "json_paths": "SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k, json_extract_string(props, '$.missing') AS missing FROM events",
    "time_buckets": "SELECT event_id, strftime(ts, '%Y%m%d') AS day, strftime(ts, '%Y-%m') AS month, CAST(floor(epoch(ts) / 60) AS BIGINT) AS minute, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS iso FROM events",
    "page_link_fanout": """SELECT page_id, CAST(i - 1 AS INTEGER) AS ordinal, l[i] AS href FROM (SELECT page_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT page_id, regexp_extract_all(html, '<a href="([^"]*)"', 1) AS l FROM pages))""",
    "page_links_per_page": """SELECT page_id, count(*) AS links, count(DISTINCT href) AS distinct_links FROM (SELECT page_id, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS href FROM pages) GROUP BY 1""",
    "source_profiles": f"WITH {_FACTS} SELECT domain_id, {', '.join(f'round({c}, 6) AS {c}' for c in (*_WEIGHTS, 'http_ok', 'http_needs_js', 'browser_ok'))}, facts, moved_to FROM p",
    "source_assessment": f"""WITH {_FACTS}, d AS (SELECT domain_id, {', '.join(f'{c} * exp(-greatest(0, n - ref) / 86400.0) AS {c}' for c in _WEIGHTS)}, exp(-greatest(0, n - ref) / 604800.0) AS f, http_ok, http_needs_js, browser_ok, n, last_ok, first_seen, ref, last_http FROM (SELECT *, epoch(TIMESTAMP '{NOW}') AS n FROM p)),
      s AS (SELECT *, CASE WHEN n - last_ok <= 86400 THEN 'active' {' '.join(f"WHEN w_{k} >= {_POLICY.evidence(_POLICY.tau)!r} AND w_{k} >= 0.8 * ({' + '.join(_WEIGHTS)}) THEN '{name}'" for k, name in (('moved', 'moved'), ('blocked', 'blocked'), ('unreachable', 'unreachable'), ('http_error', 'error')))} ELSE 'degraded' END AS state,
      CASE WHEN http_needs_js * f >= {_POLICY.evidence(_POLICY.tau_cap)!r} AND http_needs_js >= http_ok AND browser_ok * f >= f AND n - last_http < 604800 THEN 'browser' ELSE 'http' END AS capability, ref + least(greatest((n - coalesce(last_ok, first_seen)) * 0.25, 21600), 604800) AS due FROM d)
      SELECT domain_id, state, capability, state NOT IN ('active', 'degraded') AND n >= due AS probe, state IN ('active', 'degraded') OR n >= due AS admit, {', '.join(f'round({c}, 5) AS {c}' for c in _WEIGHTS)} FROM s""",
    "feedback_sources": f"WITH {_EVIDENCE}, v AS ({_VALUE('domain_id')}), m AS (SELECT domain_id, count(DISTINCT match_id) AS matches FROM e GROUP BY 1) SELECT domain_id, round(value, 6) AS value, targets, matches, CAST(round_even(15 * CASE WHEN value < 0.05 THEN 0 ELSE 1 - exp(-value / 2.0) END, 0) AS INTEGER) AS boost FROM v JOIN m USING (domain_id)",
    "feedback_patterns": f"WITH {_EVIDENCE}, v AS ({_VALUE('domain_id, template')}), m AS (SELECT domain_id, template, count(DISTINCT page_observation_id) AS support FROM e GROUP BY 1, 2 HAVING count(DISTINCT page_observation_id) >= 2) SELECT * FROM (SELECT domain_id, template, round(value, 6) AS value, support, CAST(round_even(5 * CASE WHEN value < 0.05 THEN 0 ELSE 1 - exp(-value / 2.0) END, 0) AS INTEGER) AS boost FROM v JOIN m USING (domain_id, template)) WHERE boost > 0",
    "feedback_capability": f"WITH {_EVIDENCE}, b AS (SELECT domain_id, capability, page_observation_id, max(s) AS s FROM e GROUP BY ALL) SELECT domain_id, round(coalesce(sum(s) FILTER (WHERE capability = 'http'), 0), 6) AS http, round(coalesce(sum(s) FILTER (WHERE capability = 'browser'), 0), 6) AS browser FROM b GROUP BY 1",
    "ledger_edges": """WITH f AS (SELECT 'order_has_line' AS edge, o_orderkey AS key, o_orderdate AS observed FROM orders UNION ALL SELECT 'customer_has_return', o_custkey, o_orderdate FROM orders),
      t AS (SELECT 'order_has_line' AS edge, l_orderkey AS key, l_shipdate AS at, l_linestatus AS effect FROM lineitem WHERE l_orderkey % 7 > 0 UNION ALL SELECT 'customer_has_return', l_partkey, l_shipdate, l_returnflag FROM lineitem WHERE l_returnflag = 'R'),
      o AS (SELECT f.edge, f.key, min(f.observed) AS first FROM f WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.edge = f.edge AND t.key = f.key) GROUP BY 1, 2), ag AS (SELECT *, epoch(TIMESTAMP '1998-08-01') - epoch(first) AS age FROM o)
      SELECT e.edge, (SELECT count(DISTINCT key) FROM f WHERE f.edge = e.edge) AS sources, (SELECT count(DISTINCT key) FROM f WHERE f.edge = e.edge AND EXISTS (SELECT 1 FROM t WHERE t.edge = f.edge AND t.key = f.key)) AS satisfied,
      (SELECT count(*) FROM ag WHERE ag.edge = e.edge AND age <= 31536000) AS pending, (SELECT count(*) FROM ag WHERE ag.edge = e.edge AND age > 31536000) AS unaccounted, (SELECT round(max(age), 3) FROM ag WHERE ag.edge = e.edge AND age > 31536000) AS oldest_unaccounted_s,
      (SELECT count(DISTINCT key) FROM t WHERE t.edge = e.edge AND t.at >= TIMESTAMP '1996-01-01' AND NOT EXISTS (SELECT 1 FROM f WHERE f.edge = t.edge AND f.key = t.key)) AS orphans,
      (SELECT count(*) FROM (SELECT key FROM t WHERE t.edge = e.edge GROUP BY key HAVING count(DISTINCT effect) > 1)) AS duplicate_effects FROM (SELECT DISTINCT edge FROM f) e""",
    "ledger_redeliveries": "SELECT event_type, CAST(sum(n - 1) AS BIGINT) AS redelivered FROM (SELECT l_returnflag AS event_type, l_orderkey, count(*) AS n FROM lineitem GROUP BY 1, 2) GROUP BY 1 HAVING sum(n - 1) > 0",
    "ledger_stages": "SELECT l_returnflag AS event_type, count(DISTINCT l_orderkey) AS n FROM lineitem GROUP BY 1",
    "rule_index_join": f"""WITH r(rule_id, kind, pattern, classification) AS (VALUES {', '.join(map(str, _RULES))}), p AS (SELECT page_id, {_HOST} AS h FROM pages)
      SELECT page_id, rule_id, classification FROM p JOIN r ON (kind = 'host' AND (h = pattern OR h LIKE '%.' || pattern)) OR (kind = 'label' AND list_contains(string_split(h, '.')[1:-2], pattern))""",
    "unlabelled_documents": "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
}
