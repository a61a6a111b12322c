from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from weftline.operators import admission as A
from weftline.operators import campaign as C
from weftline.operators import relay as R
from weftline.operators import soak as K
from weftline.sources import segments as G

T0 = datetime(2024, 1, 1)
CANDIDATE = "url_id string, position int, origin string, host string, valid boolean, action string, rule_id string, ruleset string, advised_admit boolean, advised_capability string, boosted int, wanted_capability string"
STATE = "url_id string, last_admitted_at timestamp, last_action string, last_rule_id string, last_ruleset string"


def _offers(spark, rows, states=()):
    base = dict(position=0, origin="link", host="a.example", valid=True, action="allow", rule_id=None, ruleset="s", advised_admit=None, advised_capability=None, boosted=None, wanted_capability=None)
    names = [f.split()[0] for f in CANDIDATE.split(", ")]
    offers = spark.createDataFrame([tuple((base | r)[n] for n in names) for r in rows], CANDIDATE)
    return A.decide(offers, spark.createDataFrame(list(states), STATE), F.lit("2024-01-02 00:00:00"), 86400.0, {"seed": 80, "search": 60, "link": 50, "leaf": 30})


def test_admission_in_order(spark):
    rows = [
        {"url_id": "bad", "valid": False, "action": "block"},
        {"url_id": "blocked", "action": "block", "rule_id": "r"},
        {"url_id": "blocked_again", "action": "block", "rule_id": "r"},
        {"url_id": "recent"}, {"url_id": "old"},
        {"url_id": "deferred", "advised_admit": False},
        {"url_id": "onion", "host": "x.onion", "advised_admit": False, "wanted_capability": "browser"},
        {"url_id": "advised", "advised_admit": True, "advised_capability": "browser"},
        {"url_id": "informed", "advised_admit": True, "advised_capability": "http", "wanted_capability": "browser"},
        {"url_id": "wanted", "wanted_capability": "browser", "boosted": 101},
        {"url_id": "twice", "position": 1, "origin": "leaf"}, {"url_id": "twice", "position": 2, "origin": "seed", "boosted": 0},
    ]
    states = [("blocked_again", None, "block", "r", "s"), ("recent", T0 + timedelta(hours=1), "allow", None, "s"), ("old", T0, "allow", None, "s")]
    got = {r.url_id: (r.outcome, r.queue, r.priority, r.reason, r.recorded) for r in _offers(spark, rows, states).collect()}
    assert got == {
        "bad": ("invalid", None, None, None, False), "blocked": ("blocked", None, None, None, True), "blocked_again": ("blocked", None, None, None, False),
        "recent": ("recent", None, None, None, False), "old": (None, "http", 50, "discovered", False), "deferred": ("source_deferred", None, None, None, False),
        "onion": (None, "tor", 50, "discovered", False), "advised": (None, "browser", 50, "discovered", False), "informed": (None, "http", 50, "discovered", False),
        "wanted": (None, "browser", 50, "discovered", False), "twice": (None, "http", 0, "seed", False),
    }


def test_the_queue_settles(spark):
    decided = _offers(spark, [{"url_id": u} for u in "abcd"] + [{"url_id": "e", "action": "block"}])
    answers = spark.createDataFrame([("a", "ready"), ("b", "merged"), ("c", "rejected")], "url_id string, result string")
    assert {r.url_id: (r.outcome, r.recorded) for r in A.settle(decided, answers).collect()} == {"a": ("admitted", True), "b": ("merged", True), "c": ("rejected_full", False), "d": ("rejected_full", False), "e": ("blocked", True)}


def test_link_events(spark):
    events = spark.createDataFrame([(1, "o1", "in", [("u", "in", "anchor"), ("v", "out", "anchor"), ("w", None, "iframe")]), (2, "o2", "out", [("u", "in", "anchor")]), (3, "o3", "in", [("u", "in", "anchor")]), (4, None, None, []), (5, None, "in", None)],
        "event_id int, observation_id string, page_site string, links array<struct<url_id string, site string, relation string>>")
    hops = spark.createDataFrame([("o3", "allow"), ("o3", "block"), ("o1", "allow")], "observation_id string, action string")
    results, links = A.link_events(events, spark.createDataFrame([("in",), ("in",), (None,)], "site string"), A.redirect_blocked(hops))
    assert {tuple(r) for r in results.collect()} == {(1, "admitted"), (2, "leaf_page"), (3, "redirect_blocked"), (4, "leaf_page"), (5, "admitted")}
    assert {(r.event_id, r.position, r.url_id, r.origin) for r in links.collect()} == {(1, 0, "u", "link"), (1, 1, "v", "leaf"), (1, 2, "w", "leaf")}


def test_probe_grants_follow_the_last_grant(spark):
    asked = spark.createDataFrame([("d", T0 + timedelta(seconds=s)) for s in (0, 50, 99, 130, 150, 229, 231)] + [("e", None)], "domain_id string, at timestamp")
    assert sorted((r.at - T0).seconds for r in A.granted_probes(asked, 100.0).collect()) == [0, 130, 231]


def test_relay_scans(spark):
    held = spark.createDataFrame([(0, None), (1, 100), (2, 119)], "shard int, checkpoint long")
    now = F.timestamp_seconds(F.lit(120 * 60 + 5))
    scans = lambda full: {r.shard: tuple(r)[1:] for r in R.scan(held, F.lit(90).cast("long"), now, 600, full).collect()}
    assert scans(True) == {0: (90, 120, 110), 1: (100, 120, 110), 2: (119, 120, 119)}
    assert scans(False) == {0: (119, 120, 90), 1: (119, 120, 100), 2: (119, 120, 119)}
    rows = spark.createDataFrame([(1, 99, None), (1, 100, T0), (1, 105, None), (1, 120, None), (0, 80, None), (2, 118, None)], "shard int, bucket long, published_at timestamp")
    due = R.due(rows, R.scan(held, F.lit(90).cast("long"), now, 600, True))
    assert {(r.shard, r.bucket) for r in due.collect()} == {(1, 105), (1, 120)}
    late = R.late(rows, held, F.timestamp_seconds(F.lit(0)))
    assert {(r.shard, r.bucket) for r in late.collect()} == {(1, 99), (2, 118)}
    assert R.replay(rows, F.timestamp_seconds(F.lit(100 * 60)), F.timestamp_seconds(F.lit(105 * 60 + 59))).count() == 2


def test_floors_and_generations(spark):
    groups = spark.createDataFrame([("s", "9-9", 0, None), ("s", "10-0", 2, "8-11"), ("t", "10-2", 0, None), ("t", "9-5", 1, None)], "stream string, last_delivered_id string, pending int, oldest_pending_id string")
    assert {tuple(r) for r in R.trim_floor(groups).collect()} == {("s", 8, 11), ("t", 9, 6)}
    state = spark.createDataFrame([("a", 2, 50, "p", False), ("b", 1, 5, "p", False), ("c", 1, 50, "q", False), ("d", 1, 5, None, True)], "reader string, generation int, next_bucket long, policy string, requested boolean")
    assert {tuple(r) for r in R.needs_rebuild(state, F.lit(10), F.lit("p")).collect()} == {("b", "gap"), ("c", "policy"), ("d", "requested")}
    rows = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("z", 1, "n")], "reader string, generation int, v string")
    assert [r.v for r in R.generation_rows(rows, state).collect()] == ["y"]


def test_match_projection_and_media(spark):
    rows = spark.createDataFrame([("m", T0, ["a", "a", "b"], 1), ("m", T0 + timedelta(days=1), ["a"], 2), ("m", T0 + timedelta(days=40), ["a"], 3), ("n", T0, [], 4)], "match_id string, decided_at timestamp, domains array<string>, v int")
    assert {(r.domain_id, r.month, r.match_id, r.v) for r in R.match_projection(rows, "domain_id").collect()} == {("a", "2024-01", "m", 2), ("b", "2024-01", "m", 1), ("a", "2024-02", "m", 3)}
    refs = spark.createDataFrame([("o", "x", 2, "video"), ("o", "x", 1, "audio"), ("o", "y", 3, "video"), ("p", "x", 1, "video"), ("p", None, 2, "video")], "page_observation_id string, media_id string, position int, kind string")
    latest = spark.createDataFrame([("x", "probed", "c")], "media_id string, status string, content_id string")
    claimed = spark.createDataFrame([("o", "x", True), ("p", "x", False)], "page_observation_id string, media_id string, committed boolean")
    assert {tuple(r) for r in R.media_observations(refs, latest, claimed).collect()} == {("o", "x", 1, "audio", "probed", "c", "replayed"), ("o", "y", 3, "video", "unprobed", None, "claimed"), ("p", "x", 1, "video", "probed", "c", "resumed")}


def test_months(spark):
    got = spark.range(1).select(C.months(F.lit("2023-11-30").cast("date"), F.lit("2024-01-01").cast("date")), C.months(F.lit("2024-02-01").cast("date"), F.lit("2024-01-31").cast("date"))).first()
    assert [d.isoformat() for d in got[0]] == ["2023-11-01", "2023-12-01", "2024-01-01"] and got[1] == []


def test_criteria(spark):
    at = lambda h: T0 + timedelta(hours=h)
    runs = spark.createDataFrame([("good", T0, 3600.0, "completed"), ("bad", T0, 3600.0, "running"), ("none", T0, 3600.0, "completed")], "run string, started_at timestamp, required_seconds double, phase string")
    marks = spark.createDataFrame([("good", "completed", at(1), None), ("bad", "interruption", at(0), 700.0), ("bad", "clock_anomaly", at(0), None)], "run string, kind string, at timestamp, gap_seconds double")
    values = [("good", s, at(h), 1.0) for s in ("up", "x") for h in (0, 1)] + [("bad", "up", at(0), 0.0), ("bad", "up", at(2), 1.0), ("bad", "x", at(2), 1.0)]
    samples = spark.createDataFrame(values, "run string, series string, at timestamp, value double")
    judge = lambda limits: {(r.run, r.criterion): r.status for r in K.criteria(runs, marks, samples, ["x"], F.col("series") == "up", 60.0, limits).collect()}
    found, names = judge(K.Limits(5, 600.0, 0.9, 3600.0)), ("DURATION", "CONTINUITY", "CLOCK", "METRICS", "SAMPLES", "OUTAGE")
    assert [found["good", n] for n in names] == ["pass"] * 6
    assert [found["bad", n] for n in names] == ["fail", "fail", "inconclusive", "inconclusive", "pass", "fail"]
    assert [found["none", n] for n in names] == ["fail", "pass", "pass", "inconclusive", "inconclusive", "inconclusive"]
    open_ = judge(K.Limits())
    assert (open_["bad", "CONTINUITY"], open_["bad", "OUTAGE"]) == ("inconclusive", "inconclusive")


def test_trends(spark):
    rows = [("a", T0 + timedelta(hours=h), 2.0 * h) for h in range(21)] + [("a", T0, None), ("b", T0, 4.0), ("c", T0, 0.0), ("c", T0 + timedelta(hours=1), 0.0), ("d", T0, float("nan"))]
    got = {r.k: (r.points, r.slope_per_hour, r.growth) for r in K.trends(spark.createDataFrame(rows, "k string, at timestamp, value double"), ["k"]).collect()}
    assert got["a"] == (21, pytest.approx(2.0), pytest.approx((39 - 1) / 20)) and got["b"] == (1, None, 0.0) and got["c"][1:] == (0.0, 0.0) and "d" not in got


def test_segments(spark):
    ranges = G.token_ranges(7)
    assert ranges[0][0] == -(1 << 63) and ranges[-1][1] == (1 << 63) - 1 and all(a[1] == b[0] for a, b in zip(ranges, ranges[1:], strict=False))
    tables = {"t": (spark.createDataFrame([(k, None if k % 3 else "x") for k in range(100)], "k long, v string"), ["k", "v"])}
    failures = []

    def fault(table, segment):
        if segment == 2 and len(failures) < 2:
            failures.append(segment)
            raise OSError("lost")

    source, waits = G.TableSource("s", tables, fault), []
    read = [G.read_with_retry(source, "t", ["k"], k, 4, 3, waits.append) for k in range(4)]
    rows = [[r.k for r in df.collect()] for df in read]
    assert sorted(sum(rows, [])) == list(range(100)) and all(rows) and waits == [1, 2]
    assert source.available("t") and not source.available("u")
    scanned = spark.createDataFrame([(k, len(x) - (k == 1)) for k, x in enumerate(rows)], "segment int, rows long")
    assert {r.segment: r.delta for r in G.drift(scanned, source.counts("t", 4), 4).collect()} == {0: 0, 1: 1, 2: 0, 3: 0}
    done = spark.createDataFrame([(0, 1, True), (1, 1, False), (1, 2, True), (3, 3, False)], "segment int, attempts int, ok boolean")
    assert {r.segment for r in G.unfinished(done, 4).collect()} == {2, 3}
    failures[:] = []
    with pytest.raises(OSError):
        G.read_with_retry(source, "t", ["k"], 2, 4, 1, waits.append)
