"""Schemas of the graph tables. Vertex ids and all results are 64-bit."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Input in arrival order; pos is dense and starts at 0.
EDGES = "pos long, src long, dst long"
#: The simple graph: u < v, pos of the first arrival.
CANONICAL = "u long, v long, pos long"
RESULTS = "vid long, degree long, triangles long"
AFFECTED = "batch_id long, vid long"
#: Edges of a batch, workers, and the last edges that the tail rate is measured on, unless told otherwise.
BATCH, NODES, TAIL = 1000, 4, 80000


def empty(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)
