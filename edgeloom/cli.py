"""python -m edgeloom.cli -fname=FILE [-batch=1000] [-nodes=1] [-processes=1]: analyses of a binary edge file.

-fname comes first. -nodes is the number of parts that vertices, and so all exchanges, are dealt to; -processes is the number
of cores where Spark has no master yet. Prints what was counted and how fast, over all edges and over the tail of the
stream.
"""

from __future__ import annotations

import sys
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edgeloom.model import TAIL
from edgeloom.operators import batches
from edgeloom.plans.stack import CLUSTERING, DEGREE, TRIANGLES, Stack
from edgeloom.sources import graphs
from edgeloom.sources.shared import materialise, new_path
from edgeloom.streaming.replay import Replay


def arguments(argv: list[str]) -> dict[str, str | int]:
    if not argv or not argv[0].startswith("-fname="):
        raise SystemExit(__doc__)
    out: dict[str, str | int] = {"fname": argv[0].partition("=")[2], "batch": 1000, "nodes": 1, "processes": 1}
    for a in argv[1:]:
        name, _, value = a.lstrip("-").partition("=")
        if name not in ("batch", "nodes", "processes") or not value.isdigit() or not int(value):
            raise SystemExit(f"{a} is not understood\n{__doc__}")
        out[name] = int(value)
    return out


def report(edges: DataFrame, batch: int, tail: int = TAIL) -> dict[str, float]:
    """What was counted, and the rates: edges a second over all of the stream and over its tail, which is a batch on what
    the head left."""
    spark = edges.sparkSession
    began = time.perf_counter()
    n = edges.count()
    cut = max(0, batches.tail_threshold(n, tail, batch))
    state = Replay(spark, new_path(spark, "report"), Stack(DEGREE, TRIANGLES, CLUSTERING))
    state.batch(edges.where(F.col("pos") < cut), 0)
    half = time.perf_counter()
    state.batch(edges.where(F.col("pos") >= cut), 1)
    done = time.perf_counter()
    total = state.results().agg(F.count("*").alias("vertices"), (F.coalesce(F.sum("triangles"), F.lit(0)) / 3).cast("long").alias("triangles")).first()
    return {"edges": n, "batches": -(-n // batch), "vertices": total["vertices"], "triangles": total["triangles"], "computation": done - began, "rate": n / (done - began), "tail": n - cut, "tail_rate": (n - cut) / (done - half)}


def main(argv: list[str]) -> None:
    own = arguments(argv)
    began = time.perf_counter()
    builder = SparkSession.builder.appName("edgeloom").config("spark.sql.shuffle.partitions", own["nodes"])
    if int(own["processes"]) > 1 and SparkSession.getActiveSession() is None:
        builder = builder.master(f"local[{own['processes']}]")
    spark = builder.getOrCreate()
    edges = materialise(graphs.read_binary(spark, str(own["fname"])), "edges")
    r = report(edges, int(own["batch"]))
    took = time.perf_counter() - began
    print(f"Edges: {r['edges']}\nBatches: {r['batches']}\nVertices: {r['vertices']}\nTriangles: {r['triangles']}")
    print(f"Seconds: {took:.2f}\nEdges a second: {r['edges'] / took:.0f}\nSeconds of computation: {r['computation']:.2f}\nEdges a second of computation: {r['rate']:.0f}\nEdges a second over the last {r['tail']}: {r['tail_rate']:.0f}")


if __name__ == "__main__":
    main(sys.argv[1:])
