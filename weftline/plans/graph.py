"""The derived graph: aggregated edges with stable ids, nodes, and integrity checks."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SAMPLE = 5


@dataclass(frozen=True)
class EdgeType:
    """One aggregated edge type over one dataset. Expressions are SQL over its columns."""

    name: str
    dataset: str
    src: str
    dst: str
    key: str
    where: str = "true"
    at: str | None = None
    pages: str | None = None
    status: str | None = None
    confidence: str | None = None


_sorted_names = lambda c: f"array_join(array_sort(collect_set({c})), ',')"
EDGES = [
    EdgeType("site_links_to", "page_links", "concat('site:', site)", "concat('site:', target_site)", "concat(page_version_id, '#', ordinal)", "cross_site", "observed_at", "url_id"),
    EdgeType("site_redirects_to", "page_observations", "concat('site:', site)", "concat('site:', final_site)", "observation_id", "site <> final_site", "observed_at", "url_id"),
    EdgeType("site_embeds_media_from", "page_media_refs", "concat('site:', site)", "concat('site:', locator_site)", "concat(page_version_id, '#', ordinal)", "site <> locator_site", "observed_at", "url_id"),
    EdgeType("page_has_media", "media_observations", "concat('page:', page_url_id)", "concat('media:', media_id)", "page_observation_id", at="observed_at", status=_sorted_names("probe_status")),
    EdgeType("media_has_content", "media_observations", "concat('media:', media_id)", "concat('content:', content_id)", "page_observation_id", "content_id is not null", "observed_at", "page_url_id"),
    EdgeType("match_of_content", "matches", "concat('match:', match_id)", "concat('content:', content_id)", "match_id", at="decided_at", status="max(verdict)", confidence="max(confidence)"),
    EdgeType("match_for_target", "matches", "concat('match:', match_id)", "concat('target:', target_id)", "match_id", at="decided_at", status="max(verdict)", confidence="max(confidence)"),
    EdgeType("evidence_of_match", "evidence_candidates", "concat('evidence:', evidence_id)", "concat('match:', match_id)", "evidence_id", at="collected_at", status="max(status)"),
    EdgeType("evidence_attributes_page", "evidence_sources", "concat('evidence:', evidence_id)", "concat('page:', page_url_id)", "concat(evidence_id, '#', ordinal)", at="sighted_at", status=_sorted_names("basis")),
]


def _identified(rows: DataFrame, name: str, dataset: str, directed: bool) -> DataFrame:
    key = F.concat_ws("|", F.lit(name), "src", "dst", F.lit(""))
    return rows.select(F.substring(F.sha2(key, 256), 1, 32).alias("edge_id"), F.lit(name).alias("edge_type"), "src", "dst", F.lit(directed).alias("directed"), "weight", "distinct_pages", "status", "confidence", "first_at", "last_at", F.lit(dataset).alias("source_dataset"), "source_keys")


def edges_of(view, e: EdgeType) -> DataFrame:
    """Edges of one type: weight, distinct pages, first and last time, and the five least source keys.

    The keys come from one row for each distinct key and edge, of which a ranked window keeps ``SAMPLE``: Spark filters ranks
    before the shuffle too, so no list grows with a hot edge."""
    rows = view.table(e.dataset).where(e.where)
    ends = rows.select(F.expr(e.src).alias("src"), F.expr(e.dst).alias("dst"), F.expr(e.key).alias("_key"), *[F.col(c) for c in rows.columns])
    sums = ends.groupBy("src", "dst").agg(
        F.count(F.lit(1)).alias("weight"),
        (F.countDistinct(e.pages) if e.pages else F.max(F.lit(None).cast("long"))).alias("distinct_pages"),
        (F.expr(e.status) if e.status else F.max(F.lit(None).cast("string"))).alias("status"),
        (F.expr(e.confidence) if e.confidence else F.max(F.lit(None).cast("double"))).alias("confidence"),
        (F.min(e.at) if e.at else F.max(F.lit(None).cast("timestamp"))).cast("timestamp").alias("first_at"),
        (F.max(e.at) if e.at else F.max(F.lit(None).cast("timestamp"))).cast("timestamp").alias("last_at"),
    )
    return _identified(sums.join(_least_keys(ends), ["src", "dst"]), e.name, e.dataset, True)


def _least_keys(ends: DataFrame) -> DataFrame:
    """(src, dst, source_keys): the ``SAMPLE`` least keys of each edge."""
    first = Window.partitionBy("src", "dst").orderBy("_key")
    ranked = ends.select("src", "dst", "_key").distinct().withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= SAMPLE)
    return ranked.groupBy("src", "dst").agg(F.array_sort(F.collect_list("_key")).alias("source_keys"))


def shared_content(view) -> DataFrame:
    """Pairs of sites (src < dst) on which the same content was seen."""
    s = view.table("media_observations").where("content_id is not null and page_site is not null").select(F.col("page_site").alias("site"), "content_id").distinct()
    pairs = s.alias("a").join(s.alias("b"), (F.col("a.content_id") == F.col("b.content_id")) & (F.col("a.site") < F.col("b.site")))
    ends = pairs.select(F.concat(F.lit("site:"), "a.site").alias("src"), F.concat(F.lit("site:"), "b.site").alias("dst"), F.col("a.content_id").alias("_key"))
    rows = ends.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("weight")).join(_least_keys(ends), ["src", "dst"])
    for name, kind in (("distinct_pages", "long"), ("status", "string"), ("confidence", "double"), ("first_at", "timestamp"), ("last_at", "timestamp")):
        rows = rows.withColumn(name, F.lit(None).cast(kind))
    return _identified(rows, "site_shares_content", "media_observations", False)


def edges(view) -> DataFrame:
    """All edge types whose dataset is available."""
    parts = [edges_of(view, e) for e in EDGES if e.dataset in view.available]
    if "media_observations" in view.available:
        parts.append(shared_content(view))
    return reduce(DataFrame.unionByName, parts)


KNOWN = [
    ("urls", "concat('page:', url_id)", "url", "site"),
    ("page_observations", "concat('page:', final_url_id)", "final_url", "final_site"),
    ("media", "concat('media:', media_id)", "locator_url", "locator_site"),
    ("domains", "concat('site:', site)", "site", "site"),
    ("media", "concat('site:', locator_site)", "locator_site", "locator_site"),
    ("targets", "concat('target:', target_id)", "title", "cast(null as string)"),
    ("matches", "concat('match:', match_id)", "verdict", "cast(null as string)"),
    ("evidence_candidates", "concat('evidence:', evidence_id)", "status", "cast(null as string)"),
    ("media_observations", "concat('content:', content_id)", "content_scheme", "cast(null as string)"),
]


def nodes(view, all_edges: DataFrame) -> DataFrame:
    """Every end of an edge with type, natural id, and what the datasets know of it; least label and site on ties."""
    ends = all_edges.select(F.col("src").alias("node_id")).union(all_edges.select("dst")).distinct()
    known = reduce(DataFrame.unionByName, [view.table(d).select(F.expr(i).alias("node_id"), F.expr(label).alias("label"), F.expr(site).alias("site")).where("node_id is not null") for d, i, label, site in KNOWN if d in view.available])
    facts = known.groupBy("node_id").agg(F.min("label").alias("label"), F.min("site").alias("site"), F.lit(True).alias("_known"))
    return ends.join(facts, "node_id", "left").select("node_id", F.substring_index("node_id", ":", 1).alias("node_type"), F.expr("substring(node_id, instr(node_id, ':') + 1)").alias("natural_id"), "label", "site", F.coalesce("_known", F.lit(False)).alias("known"))


def integrity(all_edges: DataFrame, all_nodes: DataFrame) -> DataFrame:
    """Checks that hold for a sound graph; every count is 0."""
    ids = all_nodes.select("node_id")
    checks = {
        "duplicate edge ids": all_edges.groupBy("edge_id").count().where("count > 1"),
        "edges with a missing end": all_edges.where("src is null or dst is null or src like '%:' or dst like '%:'"),
        "sources without a node": all_edges.join(ids, all_edges.src == ids.node_id, "left_anti"),
        "destinations without a node": all_edges.join(ids, all_edges.dst == ids.node_id, "left_anti"),
        "nodes without an edge": ids.join(all_edges.select(F.col("src").alias("node_id")).union(all_edges.select("dst")), "node_id", "left_anti"),
    }
    return reduce(DataFrame.unionByName, [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("check_name"), "n") for k, df in checks.items()])


def statistics(all_edges: DataFrame) -> DataFrame:
    return all_edges.groupBy("edge_type").agg(F.count(F.lit(1)).alias("edges"), F.sum("weight").alias("weight"))
