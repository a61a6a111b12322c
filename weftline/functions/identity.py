"""Identities as Column expressions: derived ids, wire ids, digests."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Prefixes of the id types.
PREFIXES = {"domain": "dom", "url": "url", "page_version": "pgv", "page_revision": "pgr", "media": "med", "content": "cnt", "representation": "rep", "match": "mat", "target": "tgt", "evidence": "evd", "observation": "obs"}


def derived_uuid(*parts: Column) -> Column:
    """32 hex digits of a version 8 UUID over SHA-256 of the parts, each with its length in bytes in front."""
    framed = F.concat(*[F.concat(F.octet_length(p).cast("string"), F.lit(":"), p) for p in parts])
    h = F.sha2(framed, 256)
    variant = F.conv(F.substring(h, 17, 1), 16, 10).cast("int")
    return F.concat(F.substring(h, 1, 12), F.lit("8"), F.substring(h, 14, 3), F.lower(F.hex(variant.bitwiseAND(3).bitwiseOR(8))), F.substring(h, 18, 15))


def derived_id(kind: str, *parts: Column, namespace: str | None = None) -> Column:
    """``<prefix>_<uuid>``. The first part hashed is a tag: the kind, or ``<namespace>/<kind>/v1`` for ids that have to
    equal those of a system that names its tags so."""
    tag = f"{namespace}/{kind.replace('_', '-')}/v1" if namespace else kind
    return F.concat(F.lit(PREFIXES[kind] + "_"), derived_uuid(F.lit(tag), *parts))


def wire_id(kind: str, value: Column) -> Column:
    """A stored UUID, dashed or not or already prefixed, as a typed id; null if it is none."""
    prefix = PREFIXES[kind]
    plain = F.lower(F.regexp_replace(F.regexp_replace(value.cast("string"), f"^{prefix}_", ""), "-", ""))
    return F.when(plain.rlike("^[0-9a-f]{32}$"), F.concat(F.lit(prefix + "_"), plain))


def digest(data: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(data, 256))


def idempotency_key(event_type: Column, version: Column, *values: Column) -> Column:
    """Type, major version and the values by which an event is the same."""
    return F.to_json(F.array(event_type, F.split(version, "[.]")[0], *[F.coalesce(v.cast("string"), F.lit("")) for v in values]))
