"""Times the headline queries over $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

from weftline import registry
from weftline.session import local_session

HEADLINE = ["site_overview", "source_report", "campaign_summary", "graph_nodes", "graph_shared_content", "matched_content_pages", "source_profiles", "source_assessment", "feedback_sources", "ledger_edges", "rule_index_join", "url_templates", "window_visits", "window_latest_per_key", "join_as_of", "join_within_interval", "join_token_jaccard", "connected_components", "aggregate_rank_quantiles", "aggregate_digest"]


def report(seconds: dict[str, float], sf_dir: str, left: list[str]) -> str:
    out = {"metric": "headline queries, total of best of two runs", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": Path(sf_dir).name}
    return json.dumps(out | ({"not_run": left} if left else {}))


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    budget = float(os.environ.get("BENCH_SECONDS", "900"))
    spark = local_session(cpus, int(cpus) if cpus.isdigit() else 8, "bench")
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()
    seconds: dict[str, float] = {}
    names, start = sys.argv[1:] or HEADLINE, time.perf_counter()
    for k, name in enumerate(names):
        if time.perf_counter() - start > budget:  # what is left is named in the result
            break
        for _ in range(2):  # the second run has compiled code
            began = time.perf_counter()
            registry.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            seconds[name] = round(min(seconds.get(name, float("inf")), time.perf_counter() - began), 3)
        print(f"{k + 1} of {len(names)} {name} {seconds[name]}", file=sys.stderr, flush=True)
    spark.stop()
    print(report(seconds, sf_dir, [n for n in names if n not in seconds]))


if __name__ == "__main__":
    main()
