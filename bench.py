"""Times the headline queries: BENCH_SF_DIR (data), BENCH_CPUS (local threads). Prints one JSON line."""

from __future__ import annotations

import json
import os
import time
from pathlib import Path

from recollex.plans import stored
from recollex.plans.catalogue import QUERIES
from recollex.session import session

HEADLINE = (
    "hybrid_search_topk vector_cosine_topk bm25_topk merge_pairs_jaccard injection_scan_labels pii_scan_types forgetting_decisions "
    "access_density_trend kg_snapshot_asof kg_entity_upsert kg_triples_extract entity_connectivity connections write_burst_flags stream_session kb_search"
).split()


def main() -> None:
    data = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = session(f"local[{cpus}]", **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "8g", "spark.ui.enabled": "false", "spark.sql.files.maxPartitionBytes": "2m"})
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["kg_stats"](spark, data).collect()  # starts the JVM's code paths
    took = {}
    began = time.perf_counter()  # what the retrieval queries read; once for all of them
    stored.index_of(spark, data)
    stored.features_of(spark, data)
    took["index_build"] = round(time.perf_counter() - began, 3)
    for name in HEADLINE:
        began = time.perf_counter()
        QUERIES[name](spark, data).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": Path(data).name.removeprefix("sf")}))


if __name__ == "__main__":
    main()
