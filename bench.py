"""Headline queries on local cores; prints one JSON line with seconds per query."""

from __future__ import annotations

import json
import os
import sys
import time

from fjordquant.catalog import ENTRIES
from fjordquant.session import local_session

HEADLINE = [
    "session_panel", "adaptive_bands", "technical_recommendation", "trailing_twelve_months",
    "annual_ratios", "industry_stats", "industry_quantiles", "peer_comparison", "universe_as_of",
    "valuation_by_month", "scores_by_month", "portfolio_returns", "news_company_matches",
    "risk_keyword_hits",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cores, "bench")
    ENTRIES["session_panel"].run(spark, folder).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in names:
        t0 = time.perf_counter()
        ENTRIES[name].run(spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - t0, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
