"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from tessera.plans import catalogue
from tessera.session import session

HEADLINE = "q1 high_card_group high_card_minmax q6 q3 join_high_card scan_agg_full four_table_join join_where_filter join_fact_key join_multi_key_dim".split()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = session(int(os.environ.get("BENCH_CPUS", "8")), "bench", "16g")
    queries = catalogue.queries()
    times = {}
    for name in HEADLINE:
        runs = []
        for _ in range(4):
            began = time.perf_counter()
            queries[name](spark, sf_dir).toArrow()
            runs.append(time.perf_counter() - began)
        times[name] = round(min(runs[1:]), 4)
    print(json.dumps({"metric": "sum of the headline queries, each the best of 3 after one warm-up", "value": round(sum(times.values()), 4), "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir).removeprefix("sf")}))


if __name__ == "__main__":
    main()
