"""Raw source tables to typed datasets, with a reject channel.

A mapper is a projection of Column expressions: JSON documents are parsed once by an explicit schema, required facts
that are missing or malformed give a reject reason, nothing is repaired. Of a fan-out, one bad element rejects the whole
source row, so the reason is found before the elements are exploded.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions import identity as I
from weftline.functions import urls as U
from weftline.sources.catalog import CATALOG

_REF = "struct<url:string,url_id:string,domain_id:string>"
DOCS = {
    "fetch_attempts": f"fetch_attempt_id string, requested {_REF}, capability string, worker string, started_at string, finished_at string, outcome string, http_status string, final {_REF}, redirects array<struct<location:{_REF},status:int>>, bytes_received string, detail string",
    "page_observations": f"observation_id string, fetch_attempt_id string, requested {_REF}, final {_REF}, redirects array<struct<location:{_REF},status:int>>, capability string, observed_at string, http_status string, content_type string, body_digest string, body_size string, page_version_id string, snapshot struct<uri:string>",
    "page_extracts": f"extractor string, page {_REF}, page_version_id string, normalization string, revision_id string, hashes struct<raw:string,normalized:string,visible_text:string,link_set:string,media_set:string,structural:string>, links array<struct<target:{_REF},relation:string,anchor_text:string,nofollow:boolean>>, media array<struct<locator:{_REF},kind:string,method:string,declared_type:string>>, metadata struct<title:string,lang:string,og_type:string,published_at:string,modified_at:string>, stats struct<elements:string,text_chars:string,truncated:array<string>>",
    "media": f"media_id string, locator {_REF}, kind string",
    "media_observations": f"media struct<media_id:string,locator:{_REF},kind:string>, page_observation_id string, page {_REF}, page_version_id string, observed_at string, probe_status string, content struct<scheme:string,digest:string,content_id:string>, hints struct<content_length:string,media_type:string,duration_seconds:double>",
    "targets": "ref struct<target_id:string,version:string>, title string, kind string, release_year string, registered_at string",
    "matches_by_content": "match_id string, content_id string, representation_id string, target struct<target_id:string,version:string>, target_representation_id string, technique struct<name:string,version:string>, verdict string, confidence double, segments array<struct<duration_seconds:double>>, decided_at string",
    "evidence_candidates": "match struct<verdict:string,confidence:double,content_id:string>, media array<string>, sources array<struct<page_observation_id:string,media_id:string,basis:string,sighted_at:string,page_url:string,page_version_id:string,observation_present:boolean,snapshot:string>>, sources_total string, gaps array<struct<code:string>>",
}


@dataclass
class Mapping:
    """What a mapper says of one source row: required columns by path, values, and elements of a fan-out."""

    values: dict[str, Column]
    required: dict[str, Column]
    elements: str | None = None  # array to explode; values may use ``_e`` and ``_i``
    bad_element: Callable[[Column], Column] | None = None


def _time(c: Column) -> Column:
    """A timestamp or ISO-8601 text; without a zone it is UTC; null if it is none."""
    return F.try_to_timestamp(c.cast("string"))


def _int(c: Column, kind: str = "int") -> Column:
    return F.expr("null") if c is None else c.try_cast(kind)


def _url(prefix: str, url: Column) -> dict[str, Column]:
    return {f"{prefix}host": U.host(url), f"{prefix}site": U.site(url)}


def _size(c: Column) -> Column:
    return F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0))


def _mapping(name: str) -> Mapping:
    c, d = F.col, (lambda path: F.col(f"_d.{path}"))
    if name == "fetch_attempts":
        return Mapping(
            {"fetch_attempt_id": d("fetch_attempt_id"), "url_id": d("requested.url_id"), "url": d("requested.url"), "domain_id": d("requested.domain_id"), **_url("", d("requested.url")), "capability": d("capability"), "worker": d("worker"), "started_at": _time(d("started_at")), "finished_at": _time(d("finished_at")), "outcome": d("outcome"), "http_status": _int(d("http_status")), "final_url_id": d("final.url_id"), "final_url": d("final.url"), "redirect_count": _size(d("redirects")), "bytes_received": _int(d("bytes_received"), "long"), "detail": d("detail")},
            {p: d(p) for p in ("fetch_attempt_id", "requested.url_id", "requested.url", "requested.domain_id", "capability", "outcome")} | {"finished_at": _time(d("finished_at"))},
        )
    if name == "page_observations":
        return Mapping(
            {"observation_id": d("observation_id"), "fetch_attempt_id": d("fetch_attempt_id"), "url_id": d("requested.url_id"), "url": d("requested.url"), "domain_id": d("requested.domain_id"), **_url("", d("requested.url")), "final_url_id": d("final.url_id"), "final_url": d("final.url"), **_url("final_", d("final.url")), "capability": d("capability"), "observed_at": _time(d("observed_at")), "http_status": _int(d("http_status")), "content_type": d("content_type"), "body_digest": d("body_digest"), "body_size": _int(d("body_size"), "long"), "page_version_id": d("page_version_id"), "redirect_count": _size(d("redirects")), "redirect_urls": F.coalesce(F.transform(d("redirects"), lambda r: r["location"]["url"]), F.array().cast("array<string>")), "snapshot_uri": d("snapshot.uri")},
            {p: d(p) for p in ("observation_id", "requested.url_id", "requested.url", "requested.domain_id", "final.url_id", "final.url", "capability", "body_digest", "page_version_id")} | {"observed_at": _time(d("observed_at")), "http_status": _int(d("http_status")), "redirects": F.when(~F.coalesce(F.exists(d("redirects"), lambda r: r["location"]["url"].isNull()), F.lit(False)), F.lit("ok"))},
        )
    base = {"page_version_id": d("page_version_id"), "url_id": d("page.url_id"), **_url("", d("page.url")), "observed_at": c("observed_at").cast("timestamp")} if name in ("page_extracts", "page_links", "page_media_refs") else {}
    needed = {p: d(p) for p in ("page_version_id", "page.url_id", "page.url")} if base else {}
    if name == "page_extracts":
        hashes = {f"hash_{h}": d(f"hashes.{h}") for h in ("raw", "normalized", "visible_text", "link_set", "media_set", "structural")}
        return Mapping({**base, "url": d("page.url"), "domain_id": d("page.domain_id"), "extractor": d("extractor"), "normalization": d("normalization"), "revision_id": d("revision_id"), **hashes, "title": d("metadata.title"), "lang": d("metadata.lang"), "og_type": d("metadata.og_type"), "published_at": _time(d("metadata.published_at")), "modified_at": _time(d("metadata.modified_at")), "text_chars": _int(d("stats.text_chars")), "elements": _int(d("stats.elements")), "link_count": _size(d("links")), "media_count": _size(d("media")), "truncated": F.coalesce(d("stats.truncated"), F.array().cast("array<string>"))}, needed | {"page.domain_id": d("page.domain_id")})
    if name == "page_links":
        target = _url("target_", c("_e.target.url"))
        return Mapping({**base, "ordinal": c("_i"), "target_url": c("_e.target.url"), "target_url_id": c("_e.target.url_id"), "target_domain_id": c("_e.target.domain_id"), **target, "relation": c("_e.relation"), "nofollow": F.coalesce(c("_e.nofollow"), F.lit(False)), "anchor_text": c("_e.anchor_text"), "cross_site": base["site"] != target["target_site"]}, needed, "_d.links", lambda e: e["target"]["url"].isNull() | e["target"]["url_id"].isNull() | e["relation"].isNull())
    if name == "page_media_refs":
        return Mapping({**base, "ordinal": c("_i"), "locator_url": c("_e.locator.url"), "locator_url_id": c("_e.locator.url_id"), **_url("locator_", c("_e.locator.url")), "kind": c("_e.kind"), "method": c("_e.method"), "declared_type": c("_e.declared_type")}, needed, "_d.media", lambda e: e["locator"]["url"].isNull())
    if name == "urls":
        return Mapping({"url_id": I.wire_id("url", c("url_id")), "url": c("url"), "domain_id": I.wire_id("domain", c("domain_id")), **_url("", c("url")), **{k: c(k).cast("timestamp") for k in ("first_seen", "last_observed_at")}, "last_status": c("last_status").cast("int")}, {"url": c("url"), "url_id": I.wire_id("url", c("url_id"))})
    if name == "domains":
        host = F.lower(F.regexp_replace("host", "[.]+$", ""))
        return Mapping({"domain_id": I.wire_id("domain", c("domain_id")), "host": host, "site": U.registrable(host), "first_seen": c("first_seen").cast("timestamp")}, {"host": F.nullif(host, F.lit("")), "domain_id": I.wire_id("domain", c("domain_id"))})
    if name == "page_revisions":
        return Mapping({"url_id": I.wire_id("url", c("url_id")), "revision_id": I.wire_id("page_revision", c("revision_id")), **{k: c(k) for k in ("normalization", "normalized_digest")}, **{k: c(k).cast("timestamp") for k in ("first_seen", "last_seen")}, **{f"{w}_observation_id": I.wire_id("observation", c(f"{w}_observation_id")) for w in ("first", "last")}, **{f"{w}_page_version_id": I.wire_id("page_version", c(f"{w}_page_version_id")) for w in ("first", "last")}}, {"url_id": I.wire_id("url", c("url_id")), "revision_id": I.wire_id("page_revision", c("revision_id"))})
    if name == "media":
        return Mapping({"media_id": I.wire_id("media", c("media_id")), "locator_url": d("locator.url"), "locator_url_id": d("locator.url_id"), **_url("locator_", d("locator.url")), "kind": F.coalesce(c("kind"), d("kind")), **{k: c(k).cast("timestamp") for k in ("first_seen", "last_seen")}}, {"locator.url": d("locator.url"), "media_id": I.wire_id("media", c("media_id"))})
    if name == "media_observations":
        return Mapping({"page_observation_id": d("page_observation_id"), "media_id": d("media.media_id"), "observed_at": _time(d("observed_at")), "page_url": d("page.url"), "page_url_id": d("page.url_id"), **_url("page_", d("page.url")), "page_version_id": d("page_version_id"), "locator_url": d("media.locator.url"), **_url("locator_", d("media.locator.url")), "media_kind": d("media.kind"), "probe_status": d("probe_status"), "content_id": d("content.content_id"), "content_scheme": d("content.scheme"), "content_digest": d("content.digest"), "hint_media_type": d("hints.media_type"), "hint_content_length": _int(d("hints.content_length"), "long"), "hint_duration_seconds": d("hints.duration_seconds")}, {p: d(p) for p in ("page_observation_id", "media.media_id", "page.url", "page.url_id", "page_version_id", "media.locator.url", "probe_status")} | {"observed_at": _time(d("observed_at"))})
    if name == "targets":
        return Mapping({"target_id": d("ref.target_id"), "version": _int(d("ref.version")), "title": d("title"), "kind": d("kind"), "release_year": _int(d("release_year")), "registered_at": _time(d("registered_at")), "retired_at": c("retired_at").cast("timestamp"), "retire_reason": c("retire_reason")}, {"ref.target_id": d("ref.target_id"), "ref.version": _int(d("ref.version"))})
    if name == "matches":
        return Mapping({**{k: d(k) for k in ("content_id", "match_id", "verdict", "confidence", "representation_id", "target_representation_id")}, "target_id": d("target.target_id"), "target_version": _int(d("target.version")), "technique_name": d("technique.name"), "technique_version": d("technique.version"), "segment_count": _size(d("segments")), "aligned_seconds": F.coalesce(F.aggregate(d("segments"), F.lit(0.0), lambda a, s: a + F.coalesce(s["duration_seconds"], F.lit(0.0))), F.lit(0.0)), "decided_at": _time(d("decided_at"))}, {p: d(p) for p in ("content_id", "match_id", "target.target_id", "verdict", "confidence")} | {"target.version": _int(d("target.version")), "decided_at": _time(d("decided_at"))})
    if name in ("evidence_candidates", "evidence_sources"):
        ids = {"evidence_id": I.wire_id("evidence", c("evidence_id")), "match_id": I.wire_id("match", c("match_id")), "target_id": I.wire_id("target", c("target_id")), "collected_at": c("collected_at").cast("timestamp")}
        if name == "evidence_sources":
            return Mapping({**ids, "ordinal": c("_i"), **{k: c(f"_e.{k}") for k in ("page_observation_id", "media_id", "page_url", "page_version_id", "basis")}, "page_url_id": I.derived_id("url", c("_e.page_url")), **_url("page_", c("_e.page_url")), "observation_present": F.coalesce(c("_e.observation_present"), F.lit(False)), "sighted_at": _time(c("_e.sighted_at")), "has_snapshot": c("_e.snapshot").isNotNull()}, {"evidence_id": ids["evidence_id"]}, "_d.sources", lambda e: e["page_url"].isNull() | U.host(e["page_url"]).isNull() | e["page_observation_id"].isNull() | e["media_id"].isNull() | e["basis"].isNull())
        sound = c("validation").isNull() | (c("validation") == "") | F.get_json_object("validation", "$").isNotNull()
        return Mapping({**ids, "status": c("status"), "revision": c("revision").cast("int"), **{k: c(k).cast("timestamp") for k in ("updated_at", "validated_at")}, "validation_outcome": F.get_json_object("validation", "$.outcome"), "verdict": d("match.verdict"), "confidence": d("match.confidence"), "content_id": d("match.content_id"), "gap_codes": F.array_sort(F.array_distinct(F.transform(F.coalesce(d("gaps"), F.array().cast("array<struct<code:string>>")), lambda g: F.coalesce(g["code"], F.lit("None"))))), "sources_total": _int(d("sources_total")), "sources_recorded": _size(d("sources")), "media_count": _size(d("media"))}, {"evidence_id": ids["evidence_id"], "validation": F.when(sound, F.lit("ok"))})
    if name == "evidence_versions":
        return Mapping({"evidence_id": I.wire_id("evidence", c("evidence_id")), **{k: c(k).cast("int") for k in ("version", "supersedes")}, **{k: c(k) for k in ("status", "manifest_uri", "manifest_digest")}, "manifest_size": c("manifest_size").cast("long"), "finalized_at": c("finalized_at").cast("timestamp")}, {"evidence_id": I.wire_id("evidence", c("evidence_id"))})
    if name == "campaigns":
        return Mapping({"campaign_id": c("campaign_id"), "target_id": I.wire_id("target", c("target_id")), "name": c("name"), **{k: c(k).cast("timestamp") for k in ("since", "created_at", "added_at")}}, {"campaign_id": c("campaign_id"), "target_id": I.wire_id("target", c("target_id"))})
    return Mapping({"domain_id": I.wire_id("domain", c("domain_id")), "generation": c("generation").cast("int"), "policy": c("policy"), "through_bucket": c("through_bucket").cast("long"), "updated_at": c("updated_at").cast("timestamp"), "profile_json": c("profile")}, {"domain_id": I.wire_id("domain", c("domain_id")), "profile": F.when(c("profile").isNull() | F.get_json_object("profile", "$").isNotNull(), F.lit("ok"))})


def map_rows(name: str, raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows of the dataset, rejected source rows with ``reject_reason``) of one raw table."""
    dataset, m = CATALOG[name], _mapping(name)
    rows = raw
    reason = F.lit(None).cast("string")
    if dataset.source in DOCS:
        # the corrupt column tells text that is no JSON object from an object without known fields
        rows = raw.withColumn("_d", F.from_json("doc", DOCS[dataset.source] + ", _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"}))
        reason = F.when(F.col("doc").isNull(), "doc is null").when(F.col("_d").isNull() | F.col("_d._corrupt").isNotNull(), "doc is not a JSON object")
    for path, value in m.required.items():
        reason = F.coalesce(reason, F.when(value.isNull(), f"missing {path}"))
    if m.elements:
        reason = F.coalesce(reason, F.when(F.coalesce(F.exists(m.elements, m.bad_element), F.lit(False)), f"bad element of {m.elements[3:]}"))
    rows = rows.withColumn("_reason", reason)
    good, bad = rows.where("_reason is null"), rows.where("_reason is not null")
    if m.elements:
        good = good.select("*", F.posexplode(m.elements).alias("_i", "_e"))
    return good.select(*[m.values[n].cast(f.dataType).alias(n) for (n, _), f in zip(dataset.columns, dataset.schema, strict=True)]), bad.select(*raw.columns, F.col("_reason").alias("reject_reason"))
