"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "query_chemsys", "query_subsystem", "search", "catalogue_stats", "sibling_search",
    "parse_entry", "cif_loops", "merge_positions", "close_contacts", "slaved_orbits",
    "neighbor_pairs", "connectivity_audit", "connected_components", "charge_gate", "largest_remainder",
    "random_decorations", "distribution", "distribution_shape", "rank_correlation", "ledger_last_status",
    "record_flags", "assemble_record", "hull_candidates", "energy_above_hull",
]

#: seconds up to which a query is run a second time
WARM_BELOW = 12


def main() -> None:
    from mineralis.plans import all_queries
    from mineralis.session import local_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    shared = tempfile.mkdtemp(prefix="bench-")   # one machine: any folder is shared
    spark = local_session(cpus, int(cpus) if cpus.isdigit() else 8, **{"spark.checkpoint.dir": shared})
    fns = all_queries()
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()   # start executors and warm the file cache
    times, warm = {}, {}

    def run(name, into):
        start = time.time()
        fns[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        into[name] = round(time.time() - start, 3)
        print(f"{name} {into[name]}", file=sys.stderr, flush=True)

    for name in HEADLINE:
        run(name, times)
    for name in HEADLINE:
        if times[name] < WARM_BELOW:   # the slow ones are not dominated by compilation
            run(name, warm)
    spark.stop()
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "warm": warm, "sf": os.path.basename(sf_dir.rstrip("/")).replace("sf", ""), "cpus": cpus}))


if __name__ == "__main__":
    main()
