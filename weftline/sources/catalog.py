"""The typed dataset catalog: columns, keys, time columns, sort orders and source tables, in one place and versioned."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

SCHEMA_VERSION = 1
_TYPES = {"s": T.StringType(), "i": T.IntegerType(), "l": T.LongType(), "d": T.DoubleType(), "b": T.BooleanType(), "t": T.TimestampType(), "a": T.ArrayType(T.StringType())}


@dataclass(frozen=True)
class Dataset:
    """``columns``: names by type letter; ``at``: the time column of windows and date partitions, if there is one."""

    name: str
    source: str
    columns: tuple[tuple[str, str], ...]
    key: tuple[str, ...]
    at: str | None
    sort: tuple[str, ...]
    fanout: bool = False
    version: int = SCHEMA_VERSION

    @property
    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(n, _TYPES[t]) for n, t in self.columns])


def _columns(text: str) -> tuple[tuple[str, str], ...]:
    return tuple((n, t) for part in text.split() for n, _, t in [part.partition(":")])


_URL = "url_id:s url:s domain_id:s host:s site:s "
_ALL = [
    Dataset("fetch_attempts", "fetch_attempts", _columns("fetch_attempt_id:s " + _URL + "capability:s worker:s started_at:t finished_at:t outcome:s http_status:i final_url_id:s final_url:s redirect_count:i bytes_received:l detail:s"), ("fetch_attempt_id",), "finished_at", ("site", "finished_at", "fetch_attempt_id")),
    Dataset("page_observations", "page_observations", _columns("observation_id:s fetch_attempt_id:s " + _URL + "final_url_id:s final_url:s final_host:s final_site:s capability:s observed_at:t http_status:i content_type:s body_digest:s body_size:l page_version_id:s redirect_count:i redirect_urls:a snapshot_uri:s"), ("observation_id",), "observed_at", ("site", "observed_at", "observation_id")),
    Dataset("page_extracts", "page_extracts", _columns("page_version_id:s url_id:s url:s domain_id:s host:s site:s observed_at:t extractor:s normalization:s revision_id:s hash_raw:s hash_normalized:s hash_visible_text:s hash_link_set:s hash_media_set:s hash_structural:s title:s lang:s og_type:s published_at:t modified_at:t text_chars:i elements:i link_count:i media_count:i truncated:a"), ("page_version_id",), "observed_at", ("site", "observed_at", "page_version_id")),
    Dataset("page_links", "page_extracts", _columns("page_version_id:s ordinal:i url_id:s host:s site:s observed_at:t target_url:s target_url_id:s target_domain_id:s target_host:s target_site:s relation:s nofollow:b anchor_text:s cross_site:b"), ("page_version_id", "ordinal"), "observed_at", ("site", "page_version_id", "ordinal"), True),
    Dataset("page_media_refs", "page_extracts", _columns("page_version_id:s ordinal:i url_id:s host:s site:s observed_at:t locator_url:s locator_url_id:s locator_host:s locator_site:s kind:s method:s declared_type:s"), ("page_version_id", "ordinal"), "observed_at", ("site", "page_version_id", "ordinal"), True),
    Dataset("urls", "url_state", _columns(_URL + "first_seen:t last_observed_at:t last_status:i"), ("url_id",), "first_seen", ("site", "first_seen", "url_id")),
    Dataset("domains", "domains", _columns("domain_id:s host:s site:s first_seen:t"), ("domain_id",), None, ("site", "host")),
    Dataset("page_revisions", "page_revisions_by_url", _columns("url_id:s revision_id:s normalization:s normalized_digest:s first_seen:t first_observation_id:s first_page_version_id:s last_seen:t last_observation_id:s last_page_version_id:s"), ("url_id", "revision_id"), "first_seen", ("url_id", "first_seen", "revision_id")),
    Dataset("media", "media", _columns("media_id:s locator_url:s locator_url_id:s locator_host:s locator_site:s kind:s first_seen:t last_seen:t"), ("media_id",), "first_seen", ("locator_site", "first_seen", "media_id")),
    Dataset("media_observations", "media_observations", _columns("page_observation_id:s media_id:s observed_at:t page_url:s page_url_id:s page_host:s page_site:s page_version_id:s locator_url:s locator_host:s locator_site:s media_kind:s probe_status:s content_id:s content_scheme:s content_digest:s hint_media_type:s hint_content_length:l hint_duration_seconds:d"), ("page_observation_id", "media_id"), "observed_at", ("page_site", "observed_at", "page_observation_id", "media_id")),
    Dataset("targets", "targets", _columns("target_id:s version:i title:s kind:s release_year:i registered_at:t retired_at:t retire_reason:s"), ("target_id",), None, ("target_id",)),
    Dataset("matches", "matches_by_content", _columns("content_id:s match_id:s target_id:s target_version:i verdict:s confidence:d technique_name:s technique_version:s representation_id:s target_representation_id:s segment_count:i aligned_seconds:d decided_at:t"), ("content_id", "match_id"), "decided_at", ("target_id", "decided_at", "match_id")),
    Dataset("evidence_candidates", "evidence_candidates", _columns("evidence_id:s match_id:s target_id:s status:s revision:i collected_at:t updated_at:t validated_at:t validation_outcome:s verdict:s confidence:d content_id:s gap_codes:a sources_total:i sources_recorded:i media_count:i"), ("evidence_id",), "collected_at", ("target_id", "collected_at", "evidence_id")),
    Dataset("evidence_sources", "evidence_candidates", _columns("evidence_id:s ordinal:i match_id:s target_id:s collected_at:t page_observation_id:s media_id:s page_url:s page_url_id:s page_host:s page_site:s page_version_id:s basis:s observation_present:b sighted_at:t has_snapshot:b"), ("evidence_id", "ordinal"), "collected_at", ("page_site", "evidence_id", "ordinal"), True),
    Dataset("evidence_versions", "evidence_versions", _columns("evidence_id:s version:i status:s manifest_uri:s manifest_digest:s manifest_size:l finalized_at:t supersedes:i"), ("evidence_id", "version"), "finalized_at", ("evidence_id", "version")),
    Dataset("campaigns", "evidence_campaigns", _columns("campaign_id:s target_id:s name:s since:t created_at:t added_at:t"), ("campaign_id", "target_id"), None, ("campaign_id", "target_id")),
    Dataset("source_profiles", "intel_source_profiles", _columns("domain_id:s generation:i policy:s through_bucket:l updated_at:t profile_json:s"), ("domain_id",), None, ("domain_id",)),
]
CATALOG: dict[str, Dataset] = {d.name: d for d in _ALL}
SOURCES: dict[str, list[str]] = {}
for _d in _ALL:
    SOURCES.setdefault(_d.source, []).append(_d.name)
