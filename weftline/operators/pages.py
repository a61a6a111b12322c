"""Page intelligence: templates of a site and their roles, page kinds, relevance.

A site's profile is joins and aggregates over (host, url); vocabularies are parameters. Caps choose by hash, so results
do not depend on the order of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.urls import url_shape
from weftline.operators.sampling import bounded_by_hash

CONTENT_SHARE, MINOR_SHARE, BOILERPLATE_SHARE = 0.5, 0.2, 0.5
MIN_SUPPORT, MAX_TEMPLATES, MAX_PAGES, MIN_BOILERPLATE_PAGES = 2, 32, 1000, 5
HUB_LINKS, STRONG_LINKS, HUB_EVIDENCE, MIN_TEXT = 10, 10, 3, 200


def vocabulary(words: list[str]) -> str:
    """One expression for a word list: Latin words as whole words, others anywhere."""
    parts = [rf"\b{w}\b" if w.isascii() else w for w in sorted(words)]
    return "(?iu)(" + "|".join(parts) + ")" if parts else "(?!)"


def role(structural: Column, support: Column, content: Column, spam: Column, listed: Column) -> Column:
    c, s, li = content / support, spam / support, listed / support
    return F.when(structural, "listing").when((c >= MINOR_SHARE) & (s >= MINOR_SHARE), "mixed").when(((c >= CONTENT_SHARE) | (li >= CONTENT_SHARE)) & (s < MINOR_SHARE), "content").when(s >= MINOR_SHARE, "spam").otherwise("unknown")


def boilerplate_links(links: DataFrame) -> DataFrame:
    """(host, target) that half of a site's pages link to, of sites with enough pages; ``links``: host, url, target."""
    pages = links.groupBy("host").agg(F.countDistinct("url").alias("n"))
    counts = links.groupBy("host", "target").agg(F.countDistinct("url").alias("c"))
    return counts.join(pages, "host").where((F.col("n") >= MIN_BOILERPLATE_PAGES) & (F.col("c") >= F.greatest(F.lit(BOILERPLATE_SHARE) * F.col("n"), F.lit(2)))).select("host", "target")


def site_templates(pages: DataFrame, links: DataFrame, content: str, spam: str) -> DataFrame:
    """Templates of each host over its pages (host, url, title) and link targets (host, url, target, anchor)."""
    chosen = bounded_by_hash(pages.dropDuplicates(["host", "url"]), ["host"], "url", MAX_PAGES)
    own = links.join(chosen.select("host", "url"), ["host", "url"], "left_semi")
    boiler = boilerplate_links(own)
    listing = chosen.select("host", "url", url_shape("url").alias("s")).where("s.structural").select("host", "url")
    listed = own.join(listing, ["host", "url"], "left_semi").join(boiler, ["host", "target"], "left_anti").select("host", F.col("target").alias("url")).distinct().withColumn("_listed", F.lit(1))
    words = chosen.select("host", "url", F.col("title").alias("words"), F.lit(0).alias("_o")).unionByName(own.select("host", F.col("target").alias("url"), F.col("anchor").alias("words"), F.lit(1).alias("_o")))
    urls = words.groupBy("host", "url").agg(F.min(F.struct("_o", "words"))["words"].alias("words")).join(listed, ["host", "url"], "left").withColumn("s", url_shape("url")).where("s is not null")
    said = F.concat_ws(" ", "words", "s.slug_text")
    marked = urls.select("host", "s.template", "s.structural", said.rlike(content).alias("c"), said.rlike(spam).alias("p"), F.coalesce("_listed", F.lit(0)).alias("l"))
    stats = marked.groupBy("host", "template").agg(F.max("structural").alias("structural"), F.count(F.lit(1)).alias("support"), F.count_if(F.col("c") & ~F.col("p")).alias("content"), F.count_if("p").alias("spam"), F.sum("l").alias("listed")).where(F.col("support") >= MIN_SUPPORT)
    ranked = stats.withColumn("_r", F.row_number().over(Window.partitionBy("host").orderBy(F.desc("support"), "template"))).where(F.col("_r") <= MAX_TEMPLATES).drop("_r")
    return ranked.withColumn("role", role(F.col("structural"), F.col("support"), F.col("content"), F.col("spam"), F.col("listed")))


def page_kinds(pages: DataFrame, links: DataFrame, templates: DataFrame, content: str, spam: str, utility: str) -> DataFrame:
    """Kind (hub, detail, other), relevance (relevant, spam, unknown) and counts of each page (host, url, title,
    og_type, published, text_chars)."""
    boiler = boilerplate_links(links)
    roles = templates.select("host", "template", F.col("role").alias("_role"), ((F.col("role") == "mixed") | ((F.col("role") == "content") & (F.col("content") >= CONTENT_SHARE * F.col("support")))).alias("_pattern"))
    targets = links.dropDuplicates(["host", "url", "target"]).join(boiler, ["host", "target"], "left_anti").withColumn("s", url_shape("target")).withColumn("template", F.col("s.template")).join(roles, ["host", "template"], "left")
    said = F.concat_ws(" ", "anchor", "s.slug_text")
    good, bad = said.rlike(content), said.rlike(spam) | F.coalesce(F.col("_role") == "spam", F.lit(False)) | (F.coalesce("_pattern", F.lit(False)) & ~said.rlike(content))
    counts = targets.groupBy("host", "url").agg(F.count(F.lit(1)).alias("own_links"), F.count_if(F.col("_role").isin("content", "mixed") & ~bad).alias("own_content_links"), F.count_if(good & ~bad).alias("_pos"), F.count_if(bad).alias("_neg"))
    rows = pages.withColumn("s", url_shape("url")).withColumn("template", F.col("s.template")).join(roles, ["host", "template"], "left").join(counts, ["host", "url"], "left").fillna(0, ["own_links", "own_content_links", "_pos", "_neg"])
    title = F.coalesce("title", F.lit(""))
    page_said = F.concat_ws(" ", title, F.coalesce("s.slug_text", F.lit("")))
    item, marker = page_said.rlike(content), F.coalesce("s.structural", F.lit(False)) & (~F.coalesce("s.root", F.lit(False)) | (F.col("own_links") > 0))
    words = F.size(F.filter(F.split(title, r"\s+"), lambda w: w != ""))
    in_content = F.coalesce(F.col("_role").isin("content", "mixed"), F.lit(False))
    kind = (
        F.when(F.col("s").isNull(), "other").when((F.col("own_links") == 0) & (F.col("text_chars") < MIN_TEXT), "other")
        .when((F.col("own_links") >= HUB_LINKS) & item & ~marker & (F.coalesce("_role", F.lit("")) != "listing") & (F.col("own_content_links") < STRONG_LINKS), "detail")
        .when((F.col("own_links") >= HUB_LINKS) | marker, "hub").when((words <= 3) & title.rlike(utility) & ~item, "other")
        .when(in_content | item | F.coalesce(F.col("og_type").isin("article", "video.movie", "video.episode", "music.album"), F.lit(False)) | F.coalesce("published", F.lit(False)) | (F.col("text_chars") >= MIN_TEXT), "detail").otherwise("other")
    )
    hub = F.col("kind") == "hub"
    positive = item.cast("int") + F.coalesce(F.col("_role") == "content", F.lit(False)).cast("int") + (hub & (F.col("_pos") >= HUB_EVIDENCE) & (F.col("_pos") >= 2 * F.col("_neg"))).cast("int") + (hub & (F.col("own_content_links") >= HUB_EVIDENCE) & (F.col("own_content_links") >= 2 * F.col("_neg"))).cast("int")
    negative = page_said.rlike(spam).cast("int") + F.coalesce(F.col("_role") == "spam", F.lit(False)).cast("int") + (F.coalesce("_pattern", F.lit(False)) & (F.col("kind") == "detail") & ~item).cast("int") + (hub & (F.col("_neg") >= HUB_EVIDENCE) & (F.col("_neg") >= 2 * F.col("_pos")) & ~((F.col("_pos") >= HUB_EVIDENCE) & (F.col("_pos") >= 2 * F.col("_neg")))).cast("int")
    p, n = F.col("positive"), F.col("negative")
    relevance = F.when((n >= 2) | ((n > 0) & (p == 0)), "spam").when(((p >= 2) & (n == 0)) | ((p >= 3) & (n == 1)), "relevant").otherwise("unknown")
    return rows.withColumn("kind", kind).withColumn("positive", positive).withColumn("negative", negative).select("host", "url", "template", F.col("_role").alias("template_role"), "kind", "own_links", "own_content_links", "positive", "negative", relevance.alias("relevance"))
