from pyspark.sql import functions as F

from weftline.functions import text as X
from weftline.operators import signals as S
from weftline.sources import lines as L


def test_hosts_of_lists(spark):
    want = {" HTTPS://Ads.Example/x?y ": "ads.example", "a.b:8080/c": "a.b", "..x.example.": "x.example", "10.0.0.1": "10.0.0.1", "2001:db8::1": "2001:db8::1", "nohost": None, "a_b.example": None, "": None, "-a.example": None, "x.example?z=1/2": "x.example"}
    got = spark.createDataFrame([(k,) for k in want], "line string").select("line", X.listed_host(F.col("line")).alias("host")).collect()
    assert {r.line: r.host for r in got} == want


def test_titles_and_scripts(spark):
    rows = spark.createDataFrame([("Film A - Site | Home", ["site"]), (" ＦＩＬＭ — Straße ", []), ("a-b", []), (None, [])], "t string, b array<string>")
    got = [(list(r[0]), r[1]) for r in rows.select(X.title_segments(X.folded("t")), X.title_core(X.folded("t"), F.col("b"))).collect()]
    assert got == [(["film a", "site", "home"], "film a home"), (["film", "strasse"], "film strasse"), (["a-b"], "a-b"), ([], "")]
    assert X.script_of("abcd где") == "LATIN" and X.script_of("ab где") == "CYRILLIC" and X.script_of("ab вг") == "CYRILLIC" and X.script_of("1 2") is None


def test_metrics_page(spark):
    page = ["# TYPE a counter", 'a{x="1",y="q\\"z"} 3', 'a{x="2"} 4.5 1700000000', "b +Inf", "b{} 1", "c NaNN", "", "not a sample line at all"]
    found = S.samples(spark.createDataFrame([(p,) for p in page], "line string"), "line")
    assert {(r.name, tuple(sorted(r.labels.items())), r.value) for r in found.collect()} == {("a", (("x", "1"), ("y", 'q\\"z')), 3.0), ("a", (("x", "2"),), 4.5), ("b", (), float("inf")), ("b", (), 1.0)}
    value = lambda s: S.selected(found, s).first()[0]
    assert (value("a"), value('a{x="2"}'), value('a{z="1"}'), value('a{x="1"} / a{x="2"}'), value("a / d")) == (7.5, 4.5, None, 3 / 4.5, None)


def test_alert_runs(spark):
    rows = spark.createDataFrame([("p", h, h not in (3, 9)) for h in (1, 2, 3, 4, 5, 6, 9, 11, 12)] + [("q", 1, True)], "k string, h long, bad boolean")
    assert {tuple(r) for r in S.alerts(rows, ["k"], "h", F.col("bad"), 2).collect()} == {("p", 1, 2, 2), ("p", 4, 5, 3), ("p", 11, 12, 2)}


def test_settled_minutes_are_folded_once(spark):
    rows = spark.createDataFrame([(s,) for s in (0, 59, 60, 100, 180, 239, 240, 900)], "s long").select(F.timestamp_seconds("s").alias("at"))
    now = lambda s: F.timestamp_seconds(F.lit(s))
    first = {tuple(r) for r in S.settled(rows, "at", now(720), 600).collect()}
    then = {tuple(r) for r in S.settled(rows, "at", now(840), 600, F.lit(1)).collect()}
    assert first == {(0, 2), (1, 2)} and then == {(3, 2)}


def test_lines_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a", None), (2, None, [1, 2])], "k long, t string, v array<int>")
    L.write_lines(rows, f"{tmp_path}/out")
    assert list((tmp_path / "out").glob("*.gz"))
    back = L.read_lines(spark, f"{tmp_path}/out", rows.schema)
    assert {(r.k, r.t, tuple(r.v or ())) for r in back.collect()} == {(1, "a", ()), (2, None, (1, 2))} and back.where(f"{L.REJECT} is not null").count() == 0
    (tmp_path / "bad.json").write_text('{"k": 1}\n\nnot json\n{"k": "x"}\n')
    bad = L.read_lines(spark, f"{tmp_path}/bad.json", "k long")
    assert sorted((r.k or 0, r[L.REJECT] or "") for r in bad.collect()) == [(0, "not json"), (0, '{"k": "x"}'), (1, "")]
