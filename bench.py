"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one line of JSON."""

import json
import os
import time

from pyspark.sql import SparkSession

from edgeloom.plans import catalogue

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
NAMES = ["stack_clustering", "edges_canonical", "edge_classify", "vertex_degree", "triangle_count", "clustering_coefficient", "clustering_last_touch", "common_neighbors", "adjacency_asof", "running_triangles", "batch_stats", "affected_vertices", "shuffle_profile", "set_union", "run_stack"]


def main() -> None:
    spark = SparkSession.builder.master(f"local[{CPUS}]").appName("bench").config("spark.sql.shuffle.partitions", CPUS).config("spark.driver.memory", "12g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    queries = catalogue.queries()
    began = time.perf_counter()
    queries["edges_canonical"](spark, SF_DIR).write.format("noop").mode("overwrite").save()
    took = {"ingest": round(time.perf_counter() - began, 3)}
    for name in NAMES:
        queries[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()  # compiles
        began = time.perf_counter()
        queries[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(SF_DIR.rstrip("/"))}))


if __name__ == "__main__":
    main()
