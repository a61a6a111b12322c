import hashlib
import uuid

import pytest
from pyspark.sql import functions as F

from weftline.functions import extraction as X
from weftline.functions import identity as I
from weftline.functions import urls as U
from weftline.operators import pages as P


@pytest.mark.parametrize(
    "raw, want",
    [
        ("HTTP://Example.COM:80/a/../b/./c?q=%7ea b#f", "http://example.com/b/c?q=~a%20b"), ("https://example.com", "https://example.com/"), ("https://münchen.example/ü", "https://xn--mnchen-3ya.example/%C3%BC"),
        ("https://u:p@x.example/", None), ("ftp://x.example/", None), ("https://[::1]:8443/", "https://[::1]:8443/"), ("https://a..b/", None), ("https://x.example/..", "https://x.example/"), ("", None), (None, None), ("https://x.example/%2f%zz", "https://x.example/%2F%25zz"), ("https://x.example:/a//b/?", "https://x.example/a//b/"), ("http://@x.example/", None), ("https://x.example:99999/", None), ("https://x.example:8443/a?b#c", "https://x.example:8443/a?b"), ("https://x.\nexample/a\tb", "https://x.example/ab"), ("https://[zz]/", None), ("https:///a", None), ("https://x.example/a/./..//c/.", "https://x.example//c/"),
    ],
)
def test_canonical(raw, want):
    assert U.canonical(raw) == want
    assert want is None or U.canonical(want) == want


@pytest.mark.parametrize(
    "url, template, structural",
    [("https://x.example/", "/", True), ("https://x.example/2024/05/07/some-post", "/{year}/{mm}/{dd}/{slug}", False), ("https://x.example/en/tag/abc?page=2&utm=1", "/{lang}/tag/{slug}?page", True), ("https://x.example/movie/lens-2017/", "/{slug}/{slug}-{year}/", False), ("https://x.example/item/42", "/{slug}/{num}", True), ("https://x.example/a/b/c/d/e/f/g", "/{slug}/{slug}/{slug}/{slug}/{slug}/{slug}/{slug}", False), ("https://x.example/a.html", "/{slug}.html", False)],
)
def test_templates(url, template, structural):
    s = U.shape(url)
    assert (s["template"], s["structural"]) == (template, structural)
    assert U.shape("mailto:x") is None


@pytest.mark.parametrize(
    "path, template, words",
    [
        ("/1999/12/31/", "/{year}/{mm}/{dd}/", ""), ("/1949/12", "/{num}/{num}", ""), ("/2040", "/{num}", ""), ("/2024/13", "/{year}/{num}", ""), ("/2024/02/30.html", "/{year}/{mm}/{num}.html", ""), ("/2024.html", "/{year}.html", ""),
        ("/author/some-name/", "/author/{slug}/", "some name"), ("/index/list", "/{slug}/{slug}", "index list"), ("/feed/amp/wp-json", "/feed/amp/wp-json", ""), ("/ta/x", "/{lang}/{slug}", "x"), ("/x/ta", "/{slug}/{slug}", "x ta"),
        ("/wp-login.php?a=b", "/{slug}.php", "wp login"), ("/a.tar", "/{slug}", "a tar"), ("/page.html", "/page.html", ""), ("/old-film-1950.html", "/{slug}-{year}.html", "old film 1950"), ("/x?updated-max=1&term=&pg=2&p=3", "/{slug}?term&updated-max", "x"), ("/a%2Db/%FF", "/{slug}/{slug}", "a b \ufffd"), ("/-", "/{slug}", ""),
    ],
)
def test_template_values(path, template, words):
    s = U.shape("https://x.example" + path)
    assert (s["template"], s["slug_text"]) == (template, words)


def test_columns(spark):
    rows = spark.createDataFrame([("https://A.B.co.uk.:8080/x.MP4?y#z", "b.co.uk"), ("http://[2001:db8::1]/", None), ("https://10.0.0.1/a", "10.0.0.2"), ("nothing", "x.example")], "url string, source string")
    got = [tuple(r) for r in rows.select(U.host(F.col("url")), U.site(F.col("url")), U.is_third_party(U.host(F.col("url")), F.col("source")), U.media_kind(F.col("url"), F.lit(None).cast("string"))).collect()]
    assert got == [("a.b.co.uk", "b.co.uk", False, "video"), ("2001:db8::1", "2001:db8::1", None, None), ("10.0.0.1", "10.0.0.1", True, None), (None, None, None, None)]
    for namespace, tag in ((None, "url"), ("some", "some/url/v1")):
        framed = "".join(f"{len(x.encode())}:{x}" for x in (tag, "https://ü.example/"))
        value = uuid.UUID(bytes=hashlib.sha256(framed.encode()).digest()[:16])
        want = f"{value.hex[:12]}8{value.hex[13:16]}{(int(value.hex[16], 16) & 3 | 8):x}{value.hex[17:]}"
        assert spark.range(1).select(I.derived_id("url", F.lit("https://ü.example/"), namespace=namespace)).first()[0] == f"url_{want}"



HTML = """<!doctype html><html lang="en"><head><title> A  page </title><base href="/dir/"><link rel="canonical" href="/c"><meta property="og:type" content="article"><meta http-equiv="refresh" content="5; url=/next">
<script>var u = "https:\\/\\/cdn.example\\/v.m3u8?a=1";</script></head><body><nav><a href="one">One  <b>more</b></a></nav><a href="one">again</a><a href="mailto:x">m</a><a href="#f">f</a><a href="https://x.example/p" rel="nofollow">self</a>
<p hidden>not shown</p><video src="v.mp4"><source src="v.webm" type="video/webm"></video><img src="i.png"><iframe src="//f.example/e"></iframe><p>Shown text</body>"""


def test_extraction(spark):
    page = X.extract("https://x.example/p", HTML)
    assert [(x["url"], x["relation"], x["anchor_text"]) for x in page["links"]] == [("https://x.example/next", "meta_refresh", ""), ("https://x.example/dir/one", "anchor", "One moreagain"), ("https://f.example/e", "iframe", "")]
    assert {(x["url"], x["kind"], x["method"]) for x in page["media"]} == {("https://cdn.example/v.m3u8?a=1", "manifest", "script"), ("https://x.example/dir/v.mp4", "video", "element"), ("https://x.example/dir/v.webm", "video", "source"), ("https://x.example/dir/i.png", "image", "element")}
    assert (page["title"], page["lang"], page["canonical"], page["og_type"]) == ("A page", "en", "https://x.example/c", "article")
    assert page["dropped"] == {"scheme:mailto": 1, "self": 1}
    assert X.extract("https://x.example/p", None)["links"] == [] and X.extract("", "<a href=x>")["links"] == []
    got = spark.createDataFrame([("https://x.example/p", HTML), ("https://x.example/q", None)], "url string, html string").select(X.extract_page("url", "html").alias("e")).select("e.text_chars", F.size("e.links"), "e.hash_link_set").collect()
    assert got[0][1] == 3 and got[1][0] == 0 and got[0][2] == page["hash_link_set"]


def test_large_page_is_whole():
    body = "".join(f'<a href="/l{i}">x</a>' for i in range(3000)) + "".join(f'<img src="/i{i}.png">' for i in range(600)) + "<p></p>" * 50_000 + '<a href="/last">x</a>'
    page = X.extract("https://x.example/p", f"<body>{body}</body>")
    assert (len(page["links"]), len(page["media"]), page["truncated"]) == (3001, 600, [])
    assert page["elements"] == 53_602 and page["links"][-1]["url"] == "https://x.example/last"


def test_response_and_body_kinds(spark):
    rows = spark.createDataFrame([(200, "<div class=g-recaptcha>", "text/html"), (403, "Access Denied", "text/html"), (500, "x", ""), (200, "Please enable JavaScript", ""), (200, "fine", "video/mp4")], "status int, body string, kind string")
    assert [r[0] for r in rows.select(X.response_state(F.col("status"), F.col("body"))).collect()] == ["captcha", "blocked", "http_error", "needs_js", "ok"]
    assert [r[0] for r in rows.select(X.body_kind(F.col("kind"), F.encode("body", "UTF-8"))).collect()] == ["html", "html", "other", "other", "video"]


def test_site_profile_and_kinds(spark):
    host = "s.example"
    pages = [(host, f"https://{host}/", "Home", None, False, 500)] + [(host, f"https://{host}/film/title-{i}", f"Watch film {i}", "video.movie", False, 300) for i in range(8)] + [(host, f"https://{host}/about", "About us", None, False, 50), (host, f"https://{host}/pills/x-{1}", "cheap pills", None, False, 300)]
    links = [(host, f"https://{host}/", f"https://{host}/film/title-{i}", f"film {i}") for i in range(12)] + [(host, f"https://{host}/film/title-{i}", f"https://{host}/about", "about") for i in range(8)]
    p = spark.createDataFrame(pages, "host string, url string, title string, og_type string, published boolean, text_chars int")
    li = spark.createDataFrame(links, "host string, url string, target string, anchor string")
    words = (P.vocabulary(["film", "watch"]), P.vocabulary(["pills"]), P.vocabulary(["about", "contact"]))
    templates = P.site_templates(p, li, *words[:2])
    assert {(r.template, r.role) for r in templates.collect()} == {("/{slug}/{slug}", "content")}
    got = {r.url.rsplit("/", 1)[1]: (r.kind, r.relevance) for r in P.page_kinds(p, li, templates, *words).collect()}
    assert got[""] == ("hub", "relevant") and got["title-3"] == ("detail", "relevant") and got["about"][0] == "other" and got["x-1"] == ("detail", "spam")
