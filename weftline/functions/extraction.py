"""Extraction of one HTML page: links, media, metadata and hashes, in a single walk inside an Arrow UDF.

The tree is Python's own parser's event stream: no implied elements are added, so hashes over the tree carry their own
version tag. Everything that depends on markup alone (links, media, metadata) is read from attributes as they stand.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.functions.urls import AUDIO, IMAGE, MANIFEST, VIDEO, canonical

VERSION = "extract/1"
# The reference's own limits of links, media and elements; the depth only limits the number written into the shape.
MAX_ELEMENTS, MAX_DEPTH, MAX_LINKS, MAX_MEDIA = 200_000, 400, 10_000, 1_000
# Elements without an end tag, elements whose text is not shown, and boilerplate containers.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
SILENT = frozenset("script style noscript template head title".split())
BOILERPLATE = frozenset("nav header footer aside".split())
#: The order in which methods of finding a medium win over each other.
METHODS = ("element", "source", "embed", "meta", "link", "script")
_MEDIA_URL = re.compile(r"https?:(?:\\?/){2}[^\s\"'<>\\]+(?:\\/[^\s\"'<>\\]+)*?\.(?:" + "|".join((*VIDEO, *AUDIO, *MANIFEST)) + r")\b[^\s\"'<>\\]*", re.I)
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


def _kind(url: str, declared: str | None) -> str | None:
    kind = (declared or "").split(";")[0].strip().lower()
    if kind in ("application/vnd.apple.mpegurl", "application/x-mpegurl", "application/dash+xml"):
        return "manifest"
    for name in ("video", "audio", "image"):
        if kind.startswith(name + "/"):
            return name
    m = re.search(r"\.([A-Za-z0-9]{1,8})$", url.split("#")[0].split("?")[0])
    ext = m[1].lower() if m else ""
    return next((n for n, group in (("manifest", MANIFEST), ("video", VIDEO), ("audio", AUDIO), ("image", IMAGE)) if ext in group), None)


class Page(HTMLParser):
    def __init__(self, url: str):
        super().__init__(convert_charrefs=True)
        self.url = self.base = url
        self.own = canonical(url)
        self.links: dict[tuple, dict] = {}
        self.media: dict[str, dict] = {}
        self.meta: dict[str, str] = {}
        self.dropped: Counter = Counter()
        self.truncated: set[str] = set()
        self.open: list[tuple[str, bool, bool]] = []  # tag, hidden, boilerplate
        self.text: list[str] = []
        self.shape: list[str] = []
        self.body_shape = hashlib.sha256()
        self.elements = 0
        self.anchor: dict | None = None
        self.title: list[str] | None = None
        self.script: list[str] | None = None

    def _resolve(self, raw: str | None) -> str | None:
        raw = re.sub(r"[\t\r\n]", "", (raw or "").strip())
        scheme = re.match(r"([a-zA-Z][a-zA-Z0-9+.-]*):", raw)
        if not raw or raw.startswith("#"):
            return None
        if scheme and scheme[1].lower() not in ("http", "https"):
            self.dropped[f"scheme:{scheme[1].lower()}"] += 1
            return None
        try:
            out = canonical(urljoin(self.base, raw))
        except ValueError:
            out = None
        if out is None:
            self.dropped["malformed"] += 1
        return out

    def _link(self, raw: str | None, relation: str, rel: str = "") -> dict | None:
        url = self._resolve(raw)
        if url is None:
            return None
        if url == self.own and relation != "canonical":
            self.dropped["self"] += 1
            return None
        if (url, relation) in self.links:
            return self.links[url, relation]
        if len(self.links) >= MAX_LINKS:
            self.truncated.add("links")
            return None
        self.links[url, relation] = {"url": url, "relation": relation, "anchor_text": "", "nofollow": "nofollow" in rel.lower().split()}
        return self.links[url, relation]

    def _medium(self, raw: str | None, method: str, declared: str | None = None, kind: str | None = None) -> None:
        url = self._resolve(raw)
        if url is None or (kind := _kind(url, declared) or kind) is None:
            return
        have = self.media.get(url)
        if have is None and len(self.media) >= MAX_MEDIA:
            self.truncated.add("media")
        elif have is None or METHODS.index(method) < METHODS.index(have["method"]):
            self.media[url] = {"url": url, "kind": kind, "method": method, "declared_type": declared}

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in reversed(attrs)}
        self.elements += 1
        if self.elements > MAX_ELEMENTS:
            self.truncated.add("elements")
            return
        hidden = (self.open[-1][1] if self.open else False) or "hidden" in a or bool(_HIDDEN.search(a.get("style", "")))
        boiler = (self.open[-1][2] if self.open else False) or tag in BOILERPLATE
        if tag not in VOID:
            if len(self.open) >= MAX_DEPTH:
                self.truncated.add("depth")
            else:
                self.open.append((tag, hidden or tag in SILENT, boiler))
        if not boiler:
            self.body_shape.update(f"{len(self.open)}<{tag}>".encode())
        if tag == "base" and a.get("href") and self.base == self.url:
            self.base = urljoin(self.url, a["href"].strip())
        elif tag in ("a", "area"):
            self.anchor = self._link(a.get("href"), "anchor", a.get("rel", "")) if a.get("href") else None
        elif tag in ("iframe", "frame"):
            self._link(a.get("src"), "iframe")
        elif tag == "link":
            rel = a.get("rel", "").lower().split()
            if "canonical" in rel and (url := self._resolve(a.get("href"))):
                self.meta.setdefault("canonical", url)
            elif rel and a.get("href") and not {"stylesheet", "icon", "preconnect", "dns-prefetch"} & set(rel):
                self._link(a["href"], "other")
        elif tag == "meta":
            name = (a.get("property") or a.get("name") or "").lower()
            if a.get("http-equiv", "").lower() == "refresh" and (m := re.search(r"url\s*=\s*['\"]?([^'\"]+)", a.get("content", ""), re.I)):
                self._link(m[1], "meta_refresh")
            elif name in ("og:video", "og:video:url", "og:audio", "twitter:player:stream"):
                self._medium(a.get("content"), "meta", kind="audio" if "audio" in name else "video")
            elif name:
                self.meta.setdefault(name, a.get("content", "").strip())
        elif tag in ("video", "audio"):
            self._medium(a.get("src"), "element", a.get("type"), tag)
            if a.get("poster"):
                self._medium(a["poster"], "element", kind="image")
        elif tag == "source":
            parent = next((t for t, *_ in reversed(self.open) if t in ("video", "audio", "picture")), None)
            self._medium(a.get("src"), "source", a.get("type"), parent if parent != "picture" else "image")
        elif tag == "img":
            self._medium(a.get("src"), "element", kind="image")
        elif tag == "embed":
            self._medium(a.get("src"), "embed", a.get("type"))
        elif tag == "object":
            self._medium(a.get("data"), "embed", a.get("type"))
        elif tag == "html":
            self.meta.setdefault("lang", a.get("lang", "").strip())
        elif tag == "title" and "title" not in self.meta:
            self.title = []
        elif tag == "script":
            self.script = []

    def handle_endtag(self, tag):
        if tag in ("a", "area"):
            self.anchor = None
        if tag == "title" and self.title is not None:
            self.meta["title"], self.title = " ".join("".join(self.title).split()), None
        if tag == "script" and self.script is not None:
            for m in _MEDIA_URL.finditer("".join(self.script)):
                self._medium(m[0].replace("\\/", "/"), "script")
            self.script = None
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] == tag:
                del self.open[k:]
                break

    def handle_data(self, data):
        if self.title is not None:
            self.title.append(data)
        if self.script is not None:
            self.script.append(data)
        if self.open and (self.open[-1][1] or self.open[-1][0] in SILENT):
            return
        if self.anchor is not None and len(self.anchor["anchor_text"]) < 500:
            self.anchor["anchor_text"] += data
        self.text.append(data)


def _digest(text: str) -> str:
    return "sha256:" + hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def extract(url: str, html: str | None) -> dict:
    """Everything that one page says. Null or broken markup gives an empty page, never an error."""
    page = Page(url)
    page.feed(html or "")
    page.close()
    text = " ".join("".join(page.text).split())
    links = [x | {"anchor_text": " ".join(x["anchor_text"].split())} for x in page.links.values()]
    media = list(page.media.values())
    m = page.meta
    return {
        "links": links, "media": media, "title": m.get("title"), "lang": m.get("lang") or None, "canonical": m.get("canonical"), "og_title": m.get("og:title"), "og_type": m.get("og:type"),
        "published_at": m.get("article:published_time"), "modified_at": m.get("article:modified_time"), "robots": m.get("robots"), "text_chars": len(text), "elements": page.elements, "truncated": sorted(page.truncated), "dropped": dict(page.dropped),
        "hash_raw": _digest(html or ""), "hash_visible_text": _digest(f"{VERSION}\n{text}"), "hash_link_set": _digest("\n".join(sorted({x["url"] for x in links}))), "hash_media_set": _digest("\n".join(sorted({x["url"] for x in media}))), "hash_structural": "sha256:" + page.body_shape.hexdigest(),
        "hash_normalized": _digest(f"{VERSION}\n{text}\n" + "\n".join(sorted({x["url"] for x in links} | {x["url"] for x in media}))),
    }


_TEXT, _INT = T.StringType(), T.IntegerType()
_LINK = T.StructType([T.StructField("url", _TEXT), T.StructField("relation", _TEXT), T.StructField("anchor_text", _TEXT), T.StructField("nofollow", T.BooleanType())])
_MEDIUM = T.StructType([T.StructField(n, _TEXT) for n in ("url", "kind", "method", "declared_type")])
EXTRACT = T.StructType(
    [T.StructField("links", T.ArrayType(_LINK)), T.StructField("media", T.ArrayType(_MEDIUM))]
    + [T.StructField(n, _TEXT) for n in ("title", "lang", "canonical", "og_title", "og_type", "published_at", "modified_at", "robots")]
    + [T.StructField("text_chars", _INT), T.StructField("elements", _INT), T.StructField("truncated", T.ArrayType(_TEXT)), T.StructField("dropped", T.MapType(_TEXT, _INT))]
    + [T.StructField(f"hash_{n}", _TEXT) for n in ("raw", "visible_text", "link_set", "media_set", "structural", "normalized")]
)


@F.pandas_udf(EXTRACT)
def extract_page(url: pd.Series, html: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([extract(u or "", h) for u, h in zip(url, html, strict=True)], columns=EXTRACT.names)


def response_state(status, body):
    """ok, needs_js, captcha, blocked or http_error, by markers of a page that asks for something else than a reader."""
    text = F.lower(F.substring(F.coalesce(body, F.lit("")), 1, 65536))
    has = lambda *words: F.greatest(*[text.contains(w).cast("int") for w in (*words, words[0])]) == 1
    return F.when(has("g-recaptcha", "h-captcha", "cf-turnstile"), "captcha").when(has("access denied", "request blocked", "you have been blocked"), "blocked").when(status >= 400, "http_error").when(has("enable javascript", "javascript is required", "please turn on javascript") & (F.length(text) < 20000), "needs_js").otherwise("ok")


def body_kind(content_type, head):
    """html, manifest, video, audio, image or other, by declared type and the first bytes."""
    kind, start = F.lower(F.regexp_extract(F.coalesce(content_type, F.lit("")), r"^\s*([^;\s]+)", 1)), F.lower(F.ltrim(F.decode(F.substring(head, 1, 64), "ISO-8859-1")))
    return (
        F.when(start.startswith("#extm3u"), "manifest").when(F.hex(F.substring(head, 5, 4)) == "66747970", "video").when(F.hex(F.substring(head, 1, 4)) == "1A45DFA3", "video").when(start.startswith("oggs") | start.startswith("id3"), "audio")
        .when(start.startswith("<!doctype html") | start.startswith("<html") | kind.isin("text/html", "application/xhtml+xml"), "html").when(kind.startswith("video/"), "video").when(kind.startswith("audio/"), "audio").when(kind.startswith("image/"), "image").otherwise("other")
    )
