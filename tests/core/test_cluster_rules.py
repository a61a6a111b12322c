import random
import re

import pytest
from pyspark.sql import functions as F

from weftline.operators import rules as R
from weftline.operators.cluster import Params, assignments, cluster, page_features, site_tokens, summaries, template_groups


def density(sets, least, samples):
    names = sorted(sets)
    sim = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    near = {a: [b for b in names if a != b and sim(a, b) >= least] for a in names}
    core = {a for a in names if len(near[a]) + 1 >= samples}
    label = {}
    for a in names:
        if a in core and a not in label:
            todo = [a]
            while todo:
                x = todo.pop()
                if x not in label:
                    label[x] = a
                    todo += [b for b in near[x] if b in core]
    for a in names:
        if a not in core:
            label[a] = min((label[b] for b in near[a] if b in core), default=None)
    return {a: (a in core, label[a]) for a in names}


def test_clusters_equal_a_plain_search(spark):
    rng = random.Random(3)
    sets = {f"s{i:03}": {f"t{rng.randrange(8) + 6 * (i % 5)}" for _ in range(rng.randrange(1, 9))} for i in range(60)} | {"zz": {"alone"}}
    tokens = spark.createDataFrame([(a, t) for a, s in sets.items() for t in s], "site string, token string")
    rows, pairs = cluster(tokens, Params(min_similarity=0.5, min_samples=3))
    assert {r.site: (r.core, r.label) for r in rows.collect()} == density(sets, 0.5, 3)
    done = {r.site: r for r in assignments(rows, pairs).collect()}
    assert done["zz"].nearest_site == "s000" and done["zz"].nearest_similarity == 0
    sums = summaries(assignments(rows, pairs), tokens, pairs).collect()
    assert sum(r.members for r in sums) == sum(v[1] is not None for v in density(sets, 0.5, 3).values())


def test_site_features(spark):
    extracts = spark.createDataFrame([(f"u{i}", f"v{i}", "a.example", f"https://a.example/x/{i}", "article", "en-GB", 100 * i, "h1", f"2026-01-0{i}") for i in range(1, 5)] + [("u1", "v0", "a.example", "https://a.example/x/1", "old", "de", 1, "h0", "2025-01-01")], "url_id string, page_version_id string, site string, url string, og_type string, lang string, text_chars int, hash_structural string, observed_at string")
    links = spark.createDataFrame([("v1", "anchor", "a.example", "a.example"), ("v1", "anchor", "b.example", "a.example")], "page_version_id string, relation string, target_site string, site string")
    media = spark.createDataFrame([("v2", "video", "element")], "page_version_id string, kind string, method string")
    pages = page_features(extracts, links, media).withColumn("template", F.lit("/x/{num}"))
    assert pages.count() == 4
    assert {r.token for r in site_tokens(pages).collect()} == {"tpl:/x/{num}", "og:article", "lang:en", "mkind:video", "mmethod:element", "text:2^7", "anchors:0", "media_pages:q2", "internal_links:q3", "struct_reuse:q4"}
    assert [tuple(r) for r in template_groups(pages).collect()] == [("a.example", "/x/{num}", 4, 1.0, 1, 1.0)]


RULES = [
    R.rule("easylist", "host", "ads.example", "ad"),
    R.rule("easylist", "url_pattern", "||cdn.example/banner*.gif", "ad", types=["image"]),
    R.rule("easylist", "url_pattern", "/track?id=", "tracker", party="third"),
    R.rule("easylist", "host", "good.ads.example", "ad", exception=True),
    R.rule("easylist", "host", "bad.good.ads.example", "ad", important=True),
    R.rule("operator", "host", "op.example", "content", action="allow"),
    R.rule("built_in", "host_label", "player", "player"),
    R.rule("built_in", "path", "shop.example/cart", "navigation", contexts=["link"]),
    R.rule("v1_blacklist", "host", "op.example", "ad", 0.4),
    R.rule("easylist", "url_pattern", "a*z", "ad", domains=["src.example"], not_domains=["no.src.example"]),
]


def plain(inp, rules):
    """All rules against one input, one by one."""
    n = dict(zip(("id", "context", "url", "host", "type", "source", "third"), inp, strict=True))
    inside = lambda h, ds: any(h == d or h.endswith("." + d) for d in ds)
    out = []
    for r in rules:
        f = dict(zip([x.split()[0] for x in re.split(", (?=[a-z_]+ )", R.SCHEMA)], r, strict=True))
        path = re.match("^[^:]+://[^/?#]*([^?#]*)", n["url"])[1] or "/"
        hit = {"host": lambda: inside(n["host"], [f["pattern"]]), "host_label": lambda: f["pattern"] in n["host"].split(".")[:-1], "path": lambda: inside(n["host"], f["keys"]) and path.startswith(f["prefix"]), "url_pattern": lambda: re.search(f["regex"], n["url"].lower())}[f["kind"]]()
        ok = n["context"] in f["contexts"] and (not f["types"] or n["type"] in f["types"]) and n["type"] not in f["not_types"] and (f["party"] == "any" or n["third"] is not None and n["third"] == (f["party"] == "third"))
        ok = ok and (not f["domains"] if n["source"] is None else not inside(n["source"], f["not_domains"]) and (not f["domains"] or inside(n["source"], f["domains"])))
        if hit and ok:
            out.append(f["rule_id"])
    return sorted(out)


INPUTS = [
    (1, "request", "https://x.ads.example/a", "x.ads.example", "script", "src.example", True), (2, "request", "https://good.ads.example/a", "good.ads.example", "image", None, None),
    (3, "request", "https://bad.good.ads.example/", "bad.good.ads.example", "image", None, None), (4, "request", "https://cdn.example/banner12.gif?x", "cdn.example", "image", "a.example", True),
    (5, "request", "https://cdn.example/banner12.gif", "cdn.example", "script", "a.example", True), (6, "link", "https://op.example/", "op.example", "document", None, None),
    (7, "request", "https://t.example/track?id=5", "t.example", "other", "z.example", True), (8, "request", "https://t.example/track?id=5", "t.example", "other", "t.example", False),
    (9, "link", "https://player.shop.example/cart/1", "player.shop.example", "document", None, None), (10, "link", "https://shop.example/cart?q", "shop.example", "document", None, None),
    (11, "request", "https://q.example/a/b/z", "q.example", "other", "x.src.example", True), (12, "request", "https://q.example/a/b/z", "q.example", "other", "no.src.example", True), (13, "link", "https://nothing.test/", "nothing.test", "document", None, None),
]


def test_index_join_equals_all_rules(spark):
    inputs = spark.createDataFrame(INPUTS, "input_id int, context string, url string, host string, resource_type string, source_host string, third_party boolean")
    rules = R.ruleset(spark, RULES)
    got = {i: [] for i, *_ in INPUTS}
    for r in R.matches(inputs, rules).select("input_id", "rule_id").collect():
        got[r.input_id].append(r.rule_id)
    assert {k: sorted(v) for k, v in got.items()} == {i[0]: plain(i, RULES) for i in INPUTS}
    made = {r.input_id: (r.classification, r.action) for r in R.decide(inputs, rules).collect()}
    assert made == {1: ("ad", "block"), 2: ("unknown", "allow"), 3: ("ad", "block"), 4: ("ad", "block"), 5: ("unknown", "allow"), 6: ("content", "allow"), 7: ("tracker", "block"), 8: ("unknown", "allow"), 9: ("navigation", "classify"), 10: ("navigation", "classify"), 11: ("ad", "block"), 12: ("unknown", "allow"), 13: ("unknown", "allow")}


def test_filter_lists():
    rules, skipped = R.parse_list(["! comment", "||ads.example^", "@@||ok.example^$script,domain=a.example|~b.example", "x##.banner", "/re/", "/path/ad*$third-party,~image", "||y^$popup"], "easylist", "ad")
    assert [(r[2], r[3], r[7]) for r in rules] == [("host", "ads.example", False), ("host", "ok.example", True), ("url_pattern", "/path/ad*", False)]
    assert skipped == {"cosmetic": 1, "regex": 1, "popup_only": 1}
    made = {x: R.list_rule(x, "ublock", "ad") for x in ("/ad/*", "/ad/*$popup,script", "/ad/*$~script", "@@||x.example^$important,css", "||x.example^$from=a.example")}
    column = lambda line, name: made[line][[x.split()[0] for x in re.split(", (?=[a-z_]+ )", R.SCHEMA)].index(name)]
    assert column("/ad/*", "not_types") == ["document", "popup"] and column("/ad/*$popup,script", "not_types") == [] and column("/ad/*$~script", "not_types") == ["document", "popup", "script"]
    assert not column("@@||x.example^$important,css", "important") and column("@@||x.example^$important,css", "types") == ["stylesheet"] and column("||x.example^$from=a.example", "domains") == ["a.example"]
    for line, category in {"@@||x.example^$document": "page_exception", "@@$domain=a.example": "page_exception", "||x.example^$domain=a.*": "option:domain_entity_or_invalid", "*": "match_all", "a|b": "invalid_pattern", "x##+js(a)": "scriptlet", "x$rewrite=a": "option:rewrite"}.items():
        with pytest.raises(R.Unsupported, match=re.escape(category)):
            R.list_rule(line, "ublock", "ad")
    with pytest.raises(ValueError):
        R.pattern_regex("*")
