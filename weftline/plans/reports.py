"""Fixed questions over a view of datasets: site overview, data quality, campaign and source reports.

A view is anything with ``table(name)`` and ``available`` (names). A section whose inputs are missing is left out and
the report is marked incomplete; only a report's own key dataset is required.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UNKNOWN_SITE = "(unknown site)"
OK = "http_status between 200 and 299"


def site_overview(view) -> DataFrame:
    """Of each site: pages discovered, fetched, fetched well, parsed, and media discovered. Sites that are null in
    several inputs stay separate rows, as a full join leaves them."""
    parts = [
        view.table("urls").groupBy("site").agg(F.count(F.lit(1)).alias("discovered")),
        view.table("page_observations").groupBy(F.col("final_site").alias("site")).agg(F.countDistinct("final_url_id").alias("fetched"), F.expr(f"count(distinct final_url_id) filter (where {OK})").alias("fetched_ok")),
        view.table("page_extracts").groupBy("site").agg(F.countDistinct("url_id").alias("parsed")),
        view.table("page_media_refs").groupBy("site").agg(F.countDistinct("locator_url").alias("media_discovered")),
    ]
    joined = reduce(lambda a, b: a.join(b, "site", "full"), parts)
    counts = ("discovered", "fetched", "fetched_ok", "parsed", "media_discovered")
    return joined.select(F.coalesce("site", F.lit(UNKNOWN_SITE)).alias("site"), *[F.coalesce(c, F.lit(0)).alias(c) for c in counts]).orderBy(F.desc("discovered"), "site")


def fetch_outcomes_by_day(view) -> DataFrame:
    rows = view.table("fetch_attempts").groupBy("date", "capability", "outcome").agg(F.count(F.lit(1)).alias("attempts"), F.countDistinct("site").alias("sites"), F.round(F.avg("bytes_received")).alias("avg_bytes"))
    return rows.orderBy("date", "capability", F.desc("attempts"))


def matched_content_pages(view) -> DataFrame:
    """Pages on which the content of each match was seen."""
    seen = view.table("media_observations").select("content_id", "page_site", "page_url", F.date_format("observed_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("observed_at"))
    rows = view.table("matches").join(seen, "content_id", "left").join(view.table("targets").select("target_id", "title"), "target_id", "left")
    return rows.select("target_id", "title", "match_id", "verdict", "confidence", "page_site", "page_url", "observed_at")


def data_quality(view) -> DataFrame:
    """Rows that lack facts on which reports rely."""
    observations, extracts = view.table("page_observations"), view.table("page_extracts")
    # NOT IN of SQL: a null on the right leaves nothing, a null on the left is not counted
    missing = observations.where("page_version_id is not null").join(extracts.select("page_version_id").distinct(), "page_version_id", "left_anti").crossJoin(extracts.agg(F.count_if(F.col("page_version_id").isNull()).alias("nulls"))).where("nulls = 0")
    checks = {
        "urls without site": view.table("urls").where("site is null"),
        "observations in unknown date": observations.where("date = 'unknown'"),
        "observations without extract": missing,
        "media observations without content id": view.table("media_observations").where("content_id is null"),
        "extracts with truncation": extracts.where("truncations > 0"),
    }
    return reduce(DataFrame.unionByName, [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("check_name"), "n") for k, df in checks.items()])


#: metric -> (dataset, column of the site, aggregate)
SITE_METRICS = {
    "urls_discovered": ("urls", "site", "count(*)"),
    "fetch_attempts": ("fetch_attempts", "site", "count(*)"),
    "attempts_response": ("fetch_attempts", "site", "count_if(outcome = 'response')"),
    "observations": ("page_observations", "final_site", "count(*)"),
    "observations_ok": ("page_observations", "final_site", f"count_if({OK})"),
    "pages_fetched_ok": ("page_observations", "final_site", f"count(distinct final_url_id) filter (where {OK})"),
    "pages_parsed": ("page_extracts", "site", "count(distinct url_id)"),
    "page_versions_parsed": ("page_extracts", "site", "count(*)"),
    "media_discovered": ("page_media_refs", "site", "count(distinct locator_url)"),
    "media_observed": ("media_observations", "page_site", "count(distinct media_id)"),
    "media_identified": ("media_observations", "page_site", "count(distinct content_id)"),
}


def source_report(view) -> DataFrame:
    """All metrics of each site; 0 where a site is absent, null for all where the dataset is not available. One
    aggregation for each dataset, then one over the long form: no chain of joins."""
    by_dataset: dict[tuple[str, str], list[str]] = {}
    for metric, (dataset, site, _) in SITE_METRICS.items():
        by_dataset.setdefault((dataset, site), []).append(metric)
    parts = []
    for (dataset, site), metrics in by_dataset.items():
        if dataset in view.available:
            one = view.table(dataset).groupBy(F.coalesce(site, F.lit(UNKNOWN_SITE)).alias("site")).agg(*[F.expr(SITE_METRICS[m][2]).alias(m) for m in metrics])
            parts.append(one.select("site", F.explode(F.create_map(*[x for m in metrics for x in (F.lit(m), F.col(m).cast("long"))])).alias("metric", "value")))
    if not parts:
        raise LookupError("no dataset of the source report is available")
    rows = reduce(DataFrame.unionByName, parts)
    have = {m for (dataset, _), ms in by_dataset.items() if dataset in view.available for m in ms}
    return rows.groupBy("site").agg(*[(F.coalesce(F.sum(F.when(F.col("metric") == m, F.col("value"))), F.lit(0)) if m in have else F.lit(None).cast("long")).alias(m) for m in SITE_METRICS])


def source_totals(view) -> DataFrame:
    """Sums of the sites' values (not distinct counts over all sites)."""
    return source_report(view).agg(F.count(F.lit(1)).alias("sites"), *[F.sum(m).alias(m) for m in SITE_METRICS])


class Campaign:
    """Tables of one campaign; each report section is a DataFrame."""

    def __init__(self, view, campaign_id: str):
        self.view = view
        members = view.table("campaigns").where(F.col("campaign_id") == campaign_id)
        first = members.orderBy("target_id").select("name", "since").first()
        if first is None:
            raise LookupError(f"no campaign {campaign_id!r}")
        self.name, self.since = first
        self.members = members
        self.targets = members.select("target_id").distinct()

    def matches(self) -> DataFrame:
        rows = self.view.table("matches").join(self.targets, "target_id").select("match_id", "content_id", "target_id", "verdict", "confidence", "decided_at").distinct()
        return rows if self.since is None else rows.where(F.col("decided_at") >= F.lit(self.since))

    def sightings(self) -> DataFrame:
        return self.view.table("media_observations").join(self.matches().select("content_id").distinct(), "content_id", "left_semi")

    def candidates(self) -> DataFrame:
        return self.view.table("evidence_candidates").join(self.targets, "target_id", "left_semi")

    def versions(self) -> DataFrame:
        return self.view.table("evidence_versions").join(self.candidates().select("evidence_id"), "evidence_id")

    def by_target(self) -> DataFrame:
        return self.matches().groupBy("target_id").agg(F.count(F.lit(1)).alias("reported"), F.count_if(F.col("verdict") == "confirmed").alias("confirmed"))

    def by_day(self) -> DataFrame:
        return self.matches().groupBy(F.date_format("decided_at", "yyyy-MM-dd").alias("date")).agg(F.count(F.lit(1)).alias("reported"), F.count_if(F.col("verdict") == "confirmed").alias("confirmed"))

    def pages_per_site(self) -> DataFrame:
        return self.sightings().groupBy(F.coalesce("page_site", F.lit(UNKNOWN_SITE)).alias("site")).agg(F.countDistinct("page_url_id").alias("pages"))

    def latest_status(self) -> DataFrame:
        return self.versions().groupBy("evidence_id").agg(F.max_by("status", "version").alias("status")).groupBy("status").agg(F.count(F.lit(1)).alias("n"))

    def superseded(self) -> DataFrame:
        newest = self.view.table("evidence_versions").groupBy("evidence_id").agg(F.max("version").alias("newest"))
        return self.versions().join(newest, "evidence_id").where("version < newest")

    def summary(self) -> DataFrame:
        """(metric, value): all counts of the report in one long table."""
        view, m = self.view, self.matches()
        one = lambda df, **values: df.agg(*[v.alias(k) for k, v in values.items()]).select(F.explode(F.create_map(*[x for k in values for x in (F.lit(k), F.col(k).cast("long"))])).alias("metric", "value"))
        n = F.count(F.lit(1))
        parts = [one(self.members, targets_in_campaign=n)]
        if "targets" in view.available:
            parts.append(one(view.table("targets").join(self.targets, "target_id"), targets_in_projection=n, targets_retired=F.count_if(F.col("retired") == 1)))
        if "matches" in view.available:
            parts.append(one(m, matches_reported=n, matches_confirmed=F.count_if(F.col("verdict") == "confirmed"), distinct_contents=F.countDistinct("content_id")))
            if "media_observations" in view.available:
                s = self.sightings()
                parts.append(one(s, media=F.countDistinct("media_id"), observations=n, pages=F.countDistinct("page_url_id"), sites=F.countDistinct(F.coalesce("page_site", F.lit(UNKNOWN_SITE)))))
                parts.append(one(m.join(s.select("content_id").distinct(), "content_id", "left_anti"), matches_without_observed_content=n))
        if "evidence_candidates" in view.available:
            parts.append(one(self.candidates(), candidates=n))
            parts.append(one(self.candidates().join(m.select("match_id"), "match_id", "left_semi"), matches_with_candidate=F.countDistinct("match_id")))
            if "evidence_versions" in view.available:
                parts.append(one(self.versions(), finalized_packages=F.countDistinct("evidence_id")))
                parts.append(one(self.superseded(), superseded_versions=n))
        return reduce(DataFrame.unionByName, parts)


def rate(numerator: int, denominator: int) -> dict:
    """A share to six digits; no value for a zero denominator."""
    return {"numerator": numerator, "denominator": denominator, "value": round(numerator / denominator, 6) if denominator else None}


def campaign_report(view, campaign_id: str) -> dict:
    """The report as nested values; only aggregates reach the driver."""
    c = Campaign(view, campaign_id)
    totals = {r.metric: r.value for r in c.summary().collect()}
    needed = ("targets", "matches", "media_observations", "evidence_candidates", "evidence_versions")
    missing = sorted(n for n in needed if n not in view.available)
    rows = lambda df, *keys: [r.asDict() for r in df.orderBy(*keys).collect()]
    report = {"campaign_id": campaign_id, "name": c.name, "since": c.since and c.since.isoformat(), "complete": not missing, "incomplete_reasons": missing, "totals": totals, "rates": {}}
    if "matches" in view.available:
        report |= {"by_target": rows(c.by_target(), "target_id"), "by_day": rows(c.by_day(), "date")}
        if "matches_with_candidate" in totals:
            report["rates"]["candidate_coverage"] = rate(totals["matches_with_candidate"], totals["matches_reported"])
    if "finalized_packages" in totals:
        report["rates"]["finalized_share"] = rate(totals["finalized_packages"], totals["candidates"])
    return report


def to_markdown(report: dict) -> str:
    """A report's numbers as Markdown tables."""
    lines = [f"# Campaign {report['campaign_id']}: {report['name']}", "", "| metric | value |", "|---|---|"]
    lines += [f"| {k} | {v} |" for k, v in sorted(report["totals"].items())]
    lines += [f"| {k} | {v['numerator']}/{v['denominator']} |" for k, v in sorted(report["rates"].items())]
    if not report["complete"]:
        lines += ["", f"Not complete: {', '.join(report['incomplete_reasons'])}"]
    return "\n".join(lines) + "\n"
