"""Headline timings as one JSON line.

``build_*`` entries time the stages that turn the raw tables into stored facts and
rollups; the other entries time serving queries over them, executed in full.
"""

from __future__ import annotations

import json
import os
import sys
import time

from holdfast.plans.catalog import CATALOG, comparable
from holdfast.plans.warehouse import sample_warehouse
from holdfast.session import local_session

SERVED = (
    "top_institutions", "top_securities", "overview", "rank_institutions", "rank_securities", "institution_snapshot",
    "institution_allocation", "institution_history", "institution_holdings", "behavior_metrics", "security_identity",
    "security_snapshot", "security_history", "security_holders", "same_issuer", "relationship_identity",
    "relationship_history", "relationship_stats", "compare_institution", "institution_movers", "compare_security",
    "security_movers", "activity_explorer", "sic_division_agg", "sic_industry_agg", "global_search",
    "analytics_holdings", "holding_variant", "portfolio_weight", "period_changes", "domain_audit",
)


def main() -> int:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, int(cpus) if cpus.isdigit() else 8)
    spark.range(1000).selectExpr("sum(id)").collect()  # start the executor threads
    warehouse = sample_warehouse(spark, sf_dir)
    timings: dict[str, float] = {}

    def timed(name: str, action) -> None:
        started = time.perf_counter()
        action()
        timings[name] = round(time.perf_counter() - started, 3)

    timed("load_raw", warehouse.build_inputs)
    timed("build_dimensions_and_filings", warehouse.build_dimensions_and_filings)
    timed("build_facts", warehouse.build_facts)
    for name in SERVED:
        timed(name, lambda: comparable(CATALOG[name](warehouse)).write.format("noop").mode("overwrite").save())
    spark.stop()
    line = {
        "metric": "total_seconds", "value": round(sum(timings.values()), 3), "unit": "sec", "queries": timings,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }
    print(json.dumps(line))
    return 0


if __name__ == "__main__":
    sys.exit(main())
