import random

from pyspark.sql import functions as F

from weftline.operators import decisions as D
from weftline.streaming.frontier import LOG, Frontier, Settings, simulate


def test_random_operations_keep_the_rules():
    for seed in range(15):
        rng, now = random.Random(seed), 0.0
        f = Frontier(Settings(interval=rng.choice([0, 2.0]), in_flight=rng.choice([0, 1, 2]), lease=5, max_attempts=2, dead_max=3))
        claimed, done = {}, 0
        for _ in range(300):
            now += rng.random() * 3
            op = rng.choice(["admit"] * 3 + ["claim"] * 4 + ["complete", "fail", "defer", "recover", "heartbeat"])
            key, token = rng.choice(list(claimed.items())) if claimed else ("?", "?")
            if op == "admit":
                f.admit(now, f"u{rng.randrange(40)}", f"d{rng.randrange(5)}", rng.choice(["http", "browser"]), rng.randrange(100), now + rng.choice([0, 0, 9]))
            elif op == "claim":
                before = {k for k, t in f.tasks.items() if t.state == "leased"}
                if got := f.claim(now, rng.choice(["http", "browser"]), t := str(now)):
                    assert got not in before
                    claimed[got] = t
            elif op == "recover":
                f.recover(now)
            elif op == "defer":
                f.defer(now, key, token, 4)
            else:
                done += getattr(f, op)(now, key, token) == "completed"
            assert f.violations(now) == []
        assert done


def test_priority_politeness_and_recovery():
    f = Frontier(Settings(interval=10, lease=5, max_attempts=2, backoff_base=7))
    assert [f.admit(0, k, d, "http", p) for k, d, p in (("a", "x", 1), ("b", "x", 9), ("c", "y", 5))] == ["ready"] * 3
    assert f.admit(0, "a", "x", "http", 0) == "duplicate" and f.admit(0, "a", "x", "http", 3) == "merged"
    assert [f.claim(0, "http", "t") for _ in range(3)] == ["b", "c", None]
    assert f.complete(1, "b", "wrong") == "stale" and f.complete(1, "b", "t") == "completed"
    assert f.claim(10, "http", "t2") == "a"
    assert f.recover(6) == (1, 0) and f.tasks["c"].due == 13
    assert f.claim(20, "http", "t3") == "c" and f.fail(21, "c", "t3") == "exhausted"
    assert f.defer(14, "a", "t2", 3) == "deferred" and f.tasks["a"].attempts == 0


def test_log_replay(spark):
    rows = [("n1", 1, 0.0, "admit", "a", "x", "http", 5, None, None), ("n1", 2, 1.0, "claim", None, None, "http", None, "t", None), ("n1", 3, 2.0, "complete", "a", None, None, None, "t", None), ("n2", 1, 0.0, "claim", None, None, "http", None, "t", None)]
    got = simulate(spark.createDataFrame(rows, LOG)).orderBy("namespace", "seq").collect()
    assert [(r.namespace, r.key, r.result) for r in got] == [("n1", "a", "ready"), ("n1", "a", "claimed"), ("n1", "a", "completed"), ("n2", None, "none")]


def test_attempts_and_headers(spark):
    rows = spark.createDataFrame([("timeout", None, "http", True), ("timeout", None, "http", False), ("needs_js", 200, "http", False), ("needs_js", 200, "browser", False), ("http_error", 503, "http", False), ("http_error", 404, "http", False), ("blocked", 429, "http", False), ("ok", 200, "http", False)], "o string, s int, q string, off boolean")
    got = [tuple(r[0]) for r in rows.select(D.attempt_decision(F.col("o"), F.col("s"), F.col("q"), F.col("off"))).collect()]
    assert got == [("defer", "local_network_offline", None, False), ("fail", "timeout", None, True), ("fail", "needs_js", "browser", True), ("complete", "needs_js", None, True), ("fail", "http_503", None, True), ("complete", "http_404", None, True), ("fail", "blocked_429", None, True), ("complete", "ok", None, True)]
    heads = spark.createDataFrame([("120",), ("Wed, 21 Oct 2026 07:28:00 GMT",), ("soon",), (None,)], "v string")
    assert [r[0] for r in heads.select(D.retry_after(F.col("v"), F.lit("2026-10-21 07:27:00"))).collect()] == [120.0, 60.0, None, None]


def test_media_and_evidence(spark):
    probes = spark.createDataFrame([("m1", 1, "probed", "video", True, "v1"), ("m1", 2, "probed", "video", True, "v2"), ("m2", 1, "probed", "audio", True, None), ("m3", 1, "forbidden", "video", True, "v")], "media_id string, at int, status string, kind string, is_media boolean, validators string").withColumn("at", F.timestamp_seconds("at"))
    hashes = spark.createDataFrame([("m1", 1, "ok", "v1", "c1"), ("m2", 1, "ok", None, "c2")], "media_id string, at int, outcome string, validators string, content_id string").withColumn("at", F.timestamp_seconds("at"))
    latest = D.latest_media(probes, hashes)
    assert {r.media_id: (r.content_id, r.due) for r in latest.withColumn("due", D.hash_due(F.timestamp_seconds(F.lit(50)), 100)).collect()} == {"m1": (None, True), "m2": ("c2", False), "m3": (None, False)}
    reps = spark.createDataFrame([("c", "s", "requested", 0, None, None, 1), ("c", "s", "failed", 1, "x", True, 2), ("c", "s", "failed", 2, "y", False, 3), ("d", "s", "failed", 1, "x", True, 2), ("d", "s", "ready", 2, None, None, 4)], "content_id string, spec_key string, kind string, attempt int, failure string, retryable boolean, at int")
    assert {(r.content_id, r.state, r.failure) for r in D.representation_status(reps).collect()} == {("c", "failed", "y"), ("d", "ready", None)}
    sightings = spark.createDataFrame([("t", "o1", "m", "locator", 5, True, "s", "w"), ("t", "o2", "m", "content_verified", 1, True, None, "w"), ("t", "o3", "m", "locator", 9, False, None, None)], "match_id string, page_observation_id string, media_id string, basis string, sighted_at int, observation_present boolean, snapshot string, worker string")
    sources = D.evidence_sources(sightings, 2)
    assert [(r.ordinal, r.page_observation_id) for r in sources.orderBy("ordinal").collect()] == [(0, "o2"), (1, "o3")]
    matches = spark.createDataFrame([("t", "probable"), ("u", "confirmed")], "match_id string, verdict string")
    assert {tuple(r) for r in D.evidence_gaps(matches, sources).collect()} == {("t", "sources_truncated", None), ("t", "verdict_not_confirmed", None), ("t", "snapshot_not_archived", "o2"), ("t", "page_observation_missing", "o3"), ("u", "unattributed", None)}
    plans = D.version_plan(spark.createDataFrame([("a", "d1"), ("b", "d2"), ("c", "d3")], "evidence_id string, digest string"), spark.createDataFrame([("b", 1, "d2"), ("c", 1, "x"), ("c", 2, "y")], "evidence_id string, version int, manifest_digest string"))
    assert {tuple(r) for r in plans.collect()} == {("a", "first", 1, None), ("b", "idempotent", 1, None), ("c", "supersede", 3, 2)}
    assert [tuple(r) for r in D.verdict(spark.createDataFrame([("r", "a", "pass"), ("r", "b", "fail")], "run string, criterion string, status string")).collect()] == [("r", "fail", ["b"])]
