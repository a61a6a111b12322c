"""Clusters of sites by the structure of their pages: token sets, Jaccard similarity, density clusters.

Pages to tokens and tokens to similar pairs are joins and aggregates. Density clustering needs no driver loop: core sites
are those with enough neighbours, clusters are the components of core sites, border sites take the cluster of their
first core neighbour.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.operators.aggregates import dominant
from weftline.operators.components import connected_components
from weftline.operators.joins import jaccard_pairs
from weftline.operators.windows import latest_per_key
from weftline.session import checkpointed


@dataclass(frozen=True)
class Params:
    min_pages: int = 3
    min_similarity: float = 0.6
    min_samples: int = 2
    template_min_share: float = 0.1
    max_sites: int = 100_000

    def __post_init__(self):
        if not 0 < self.min_similarity <= 1 or self.min_samples < 1 or self.min_pages < 1:
            raise ValueError("bad cluster parameters")


def page_features(extracts: DataFrame, links: DataFrame, media: DataFrame) -> DataFrame:
    """The latest extract of each URL with counts of anchors and lists of media kinds and methods."""
    latest = latest_per_key(extracts.where("site is not null").select("url_id", "page_version_id", "site", "url", "og_type", "lang", "text_chars", "hash_structural", "observed_at"), ["url_id"], "observed_at", "page_version_id")
    anchors = links.where("relation = 'anchor'").groupBy("page_version_id").agg(F.count(F.lit(1)).alias("anchors"), F.count_if(F.col("target_site") == F.col("site")).alias("same_site"))
    kinds = media.where("kind is not null").groupBy("page_version_id").agg(F.array_sort(F.collect_set("kind")).alias("kinds"), F.array_sort(F.collect_set("method")).alias("methods"))
    rows = latest.join(anchors, "page_version_id", "left").join(kinds, "page_version_id", "left")
    none = F.array().cast("array<string>")
    return rows.select("site", "url", "og_type", "lang", "text_chars", F.coalesce("anchors", F.lit(0)).alias("anchors"), F.coalesce("same_site", F.lit(0)).alias("same_site"), F.coalesce("kinds", none).alias("kinds"), F.coalesce("methods", none).alias("methods"), "hash_structural")


def log_bucket(value: Column) -> Column:
    return F.when(value > 0, F.concat(F.lit("2^"), F.floor(F.log2(value)).cast("string"))).otherwise("0")


def quarter(part: Column, whole: Column) -> Column:
    return F.when((whole == 0) | (part == 0), "0").otherwise(F.concat(F.lit("q"), F.least(F.lit(4), F.floor(4 * part / whole) + 1).cast("string")))


def site_tokens(pages: DataFrame, params: Params = Params()) -> DataFrame:
    """(site, token) of sites with enough pages; ``pages`` has a ``template`` column, too."""
    n = pages.groupBy("site").agg(F.count(F.lit(1)).alias("n"), F.median(F.coalesce("text_chars", F.lit(0))).alias("text"), F.median("anchors").alias("links"), F.count_if(F.size("kinds") > 0).alias("with_media"), F.sum("anchors").alias("all_links"), F.sum("same_site").alias("own_links")).where(F.col("n") >= params.min_pages)
    rows = pages.join(n.select("site", "n"), "site")

    def shares(values: DataFrame, prefix: str, least: Column) -> DataFrame:
        counts = values.groupBy("site", "n", "v").agg(F.count(F.lit(1)).alias("c"))
        return counts.where(F.col("c") >= least).select("site", F.concat(F.lit(prefix), "v").alias("token"))

    floor = F.greatest(F.lit(2), F.ceil(F.lit(params.template_min_share) * F.col("n")))
    parts = [
        shares(rows.select("site", "n", F.col("template").alias("v")), "tpl:", floor),
        shares(rows.select("site", "n", F.explode("kinds").alias("v")), "mkind:", F.ceil(F.col("n") / 10)),
        shares(rows.select("site", "n", F.explode("methods").alias("v")), "mmethod:", F.ceil(F.col("n") / 10)),
    ]
    for prefix, value in (("og:", F.col("og_type")), ("lang:", F.nullif(F.lower(F.split("lang", "-")[0]), F.lit("")))):
        top = dominant(rows.select("site", value.alias("v")), ["site"], "v").withColumnRenamed("n", "c").join(n.select("site", "n"), "site")
        parts.append(top.where("c * 5 >= n").select("site", F.concat(F.lit(prefix), "value").alias("token")))
    reuse = dominant(rows, ["site"], "hash_structural").withColumnRenamed("n", "c")
    facts = n.join(reuse.select("site", "c"), "site", "left")
    one = [F.concat(F.lit("text:"), log_bucket(F.col("text"))), F.concat(F.lit("anchors:"), log_bucket(F.col("links"))), F.concat(F.lit("media_pages:"), quarter(F.col("with_media"), F.col("n"))), F.concat(F.lit("internal_links:"), quarter(F.col("own_links"), F.col("all_links"))), F.concat(F.lit("struct_reuse:"), quarter(F.coalesce("c", F.lit(0)), F.col("n")))]
    parts.append(facts.select("site", F.explode(F.array(*one)).alias("token")))
    return reduce(DataFrame.unionByName, parts).distinct()


def template_groups(pages: DataFrame) -> DataFrame:
    """Templates of each site: pages, share, different structures, and the share of the most frequent one."""
    counts = pages.groupBy("site", "template").agg(F.count(F.lit(1)).alias("pages"), F.countDistinct("hash_structural").alias("distinct_structural_hashes"))
    top = dominant(pages, ["site", "template"], "hash_structural").select("site", "template", F.col("n").alias("_top"))
    total = F.sum("pages").over(Window.partitionBy("site"))
    return counts.join(top, ["site", "template"], "left").select("site", "template", "pages", F.round(F.col("pages") / total, 6).alias("site_share"), "distinct_structural_hashes", F.round(F.coalesce("_top", F.lit(0)) / F.col("pages"), 6).alias("dominant_structural_share"))


def cluster(tokens: DataFrame, params: Params = Params()) -> tuple[DataFrame, DataFrame]:
    """(site, core, label) and the similar pairs (a, b, similarity). Labels are the least core site; null is noise."""
    tokens = checkpointed(tokens)
    sites = tokens.select("site").distinct()
    if sites.count() > params.max_sites:
        raise ValueError(f"more than {params.max_sites} sites")
    pairs = checkpointed(jaccard_pairs(tokens, "site", "token", 1e-12))
    near = pairs.where(F.col("similarity") >= params.min_similarity)
    both = near.select("a", "b").unionByName(near.select(F.col("b").alias("a"), F.col("a").alias("b")))
    degree = both.groupBy("a").agg(F.count(F.lit(1)).alias("d"))
    core = sites.join(degree, sites.site == degree.a, "left").where(F.coalesce("d", F.lit(0)) + 1 >= params.min_samples).select("site")
    linked = both.join(core.select(F.col("site").alias("a")), "a", "left_semi").join(core.select(F.col("site").alias("b")), "b", "left_semi")
    parts = connected_components(linked.where("a < b"))
    labels = core.join(parts, core.site == parts.node, "left").select("site", F.coalesce("component", "site").alias("label"))
    border = both.join(core.select(F.col("site").alias("a")), "a", "left_anti").join(labels.select(F.col("site").alias("b"), "label"), "b").groupBy(F.col("a").alias("site")).agg(F.min("label").alias("label"))
    rows = labels.withColumn("core", F.lit(True)).unionByName(border.withColumn("core", F.lit(False)))
    return checkpointed(sites.join(rows, "site", "left").select("site", F.coalesce("core", F.lit(False)).alias("core"), "label")), pairs


def assignments(clustered: DataFrame, pairs: DataFrame) -> DataFrame:
    """Each site with its cluster's id and its nearest site; a site without a common token gets the first other one at 0."""
    members = clustered.where("label is not null").groupBy("label").agg(F.array_join(F.array_sort(F.collect_list("site")), "\n").alias("_m")).select("label", F.concat(F.lit("c-"), F.substring(F.sha2("_m", 256), 1, 12)).alias("cluster_id"))
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "similarity"))
    nearest = both.groupBy(F.col("a").alias("site")).agg(F.min(F.struct((-F.col("similarity")).alias("s"), F.col("b").alias("n"))).alias("_n"))
    firsts = [r.site for r in clustered.select("site").orderBy("site").limit(2).collect()] + [None, None]
    other = F.when(F.col("site") == F.lit(firsts[0]), F.lit(firsts[1])).otherwise(F.lit(firsts[0]))
    rows = clustered.join(members, "label", "left").join(nearest, "site", "left")
    return rows.select("site", "core", "cluster_id", F.coalesce("_n.n", other).alias("nearest_site"), F.round(F.coalesce(-F.col("_n.s"), F.lit(0.0)), 6).alias("nearest_similarity"))


def summaries(assigned: DataFrame, tokens: DataFrame, pairs: DataFrame) -> DataFrame:
    """Of each cluster: members, tokens of four fifths of them, mean and least similarity of its pairs."""
    own = assigned.where("cluster_id is not null").select("site", "cluster_id")
    sizes = own.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("members"))
    common = tokens.join(own, "site").groupBy("cluster_id", "token").agg(F.count(F.lit(1)).alias("c")).join(sizes, "cluster_id").where("c * 5 >= members * 4").groupBy("cluster_id").agg(F.array_sort(F.collect_list("token")).alias("features"))
    inside = pairs.join(own.select(F.col("site").alias("a"), F.col("cluster_id").alias("ca")), "a").join(own.select(F.col("site").alias("b"), F.col("cluster_id").alias("cb")), "b").where("ca = cb")
    stats = inside.groupBy(F.col("ca").alias("cluster_id")).agg(F.sum("similarity").alias("_s"), F.count(F.lit(1)).alias("_k"), F.min("similarity").alias("_low"))
    n_pairs = F.col("members") * (F.col("members") - 1) / 2
    rows = sizes.join(common, "cluster_id", "left").join(stats, "cluster_id", "left")
    # pairs without a common token are not listed; they count as 0
    return rows.select("cluster_id", "members", "features", F.when(n_pairs > 0, F.round(F.coalesce("_s", F.lit(0.0)) / n_pairs, 6)).alias("mean_similarity"), F.when(n_pairs > 0, F.round(F.when(F.col("_k") == n_pairs, F.col("_low")).otherwise(0.0), 6)).alias("min_similarity"))
