"""Batches of arrival, the state after each, and how work is dealt to workers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from edgeloom.functions.values import div
from edgeloom.model import BATCH, NODES, TAIL
from edgeloom.operators import graph as G

#: Batches of one block of a running sum.
RUN_BATCHES = 1 << 6


def batch_of(pos: Column, size: int = BATCH) -> Column:
    return div(pos, F.lit(size)).cast("long")


def batch_stats(edges: DataFrame, size: int = BATCH) -> DataFrame:
    c = G.canonical(edges)
    closed = G.triangles(c).groupBy(batch_of(F.col("done_pos"), size).alias("batch_id")).agg(F.count("*").alias("t"))
    new = c.groupBy(batch_of(F.col("pos"), size).alias("batch_id")).agg(F.count("*").alias("new_edges"))
    seen = edges.groupBy(batch_of(F.col("pos"), size).alias("batch_id")).agg(F.count("*").alias("input_edges"), F.sum((F.col("src") == F.col("dst")).cast("long")).alias("self_loops"))
    both = seen.join(new, "batch_id", "left").join(closed, "batch_id", "left")
    fresh, t = (F.coalesce(x, F.lit(0)).cast("long") for x in ("new_edges", "t"))
    return both.select("batch_id", "input_edges", fresh.alias("new_edges"), (F.col("input_edges") - fresh - F.col("self_loops")).alias("duplicates"), "self_loops", t.alias("new_triangles"))


def changes(c: DataFrame, size: int = BATCH) -> DataFrame:
    """(batch_id, vid, d_degree, d_triangles): a row for each vertex that a batch affects."""
    d = G.symmetric(c).select(batch_of(F.col("pos"), size).alias("batch_id"), "vid", F.lit(1).alias("d"), F.lit(0).alias("t"))
    t = G.corners(G.triangles(c)).select(batch_of(F.col("pos"), size).alias("batch_id"), "vid", F.lit(0).alias("d"), F.lit(1).alias("t"))
    return d.union(t).groupBy("batch_id", "vid").agg(F.sum("d").alias("d_degree"), F.sum("t").alias("d_triangles"))


def state_of(rows: DataFrame, name: str, size: int = BATCH) -> DataFrame:
    """(vid, pos), a row for each increment -> (batch_id, vid, value) of one result, for vertices whose result a batch changes."""
    own = rows.select("vid", batch_of(F.col("pos"), size).alias("pos"), F.lit(1).cast("long").alias(name))
    return G.running_sums(own, [name], RUN_BATCHES).select(F.col("pos").alias("batch_id"), "vid", F.col(name).alias("value"))


def states(c: DataFrame, size: int = BATCH) -> DataFrame:
    """(batch_id, vid, d_degree, d_triangles, degree, triangles): results of affected vertices after the batch.

    A hub is affected by nearly every batch; its running sums go by blocks of batches (graph.running_sums()).
    """
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    d = G.symmetric(c).select("vid", batch_of(F.col("pos"), size).alias("pos"), one.alias("degree"), none.alias("triangles"))
    t = G.corners(G.held_triangles(c)).select("vid", batch_of(F.col("pos"), size).alias("pos"), none.alias("degree"), one.alias("triangles"))
    return G.running_sums(d.union(t), ["degree", "triangles"], RUN_BATCHES).withColumnRenamed("pos", "batch_id").select("batch_id", "vid", "d_degree", "d_triangles", "degree", "triangles")


def first_affected(c: DataFrame, most: int, per_node: bool, nodes: int = NODES) -> DataFrame:
    """The first affected vertices of each batch, or of each batch and worker."""
    rows = states(c).withColumn("node", node_of(F.col("vid"), nodes))
    place = F.row_number().over(Window.partitionBy("batch_id", *(["node"] if per_node else [])).orderBy("vid"))
    return rows.withColumn("k", place).where(F.col("k") <= most).select("batch_id", *(["node"] if per_node else []), "vid", "degree", "triangles")


def tail_threshold(edges: int, tail: int = TAIL, size: int = BATCH) -> int:
    """The position from which the tail rate is measured: `tail` edges from the end, down to a border of batches. It is
    negative for streams shorter than the tail."""
    return edges - tail - (edges - tail) % size


def node_of(vid: Column, nodes: int = NODES) -> Column:
    return F.pmod(vid, F.lit(nodes)).cast("long")


def local_of(vid: Column, nodes: int = NODES) -> Column:
    return div(vid - node_of(vid, nodes), F.lit(nodes)).cast("long")


def partitioned(vertices: DataFrame, nodes: int = NODES) -> DataFrame:
    n, k = node_of(F.col("vid"), nodes), local_of(F.col("vid"), nodes)
    return vertices.select("vid", n.alias("node"), k.alias("local_idx"), (n + nodes * k).cast("long").alias("roundtrip"))


def owners(c: DataFrame, nodes: int = NODES) -> DataFrame:
    """The worker that starts each edge: its ends are ordered by (worker, local index); the low bits pick a side."""
    n, k = {x: node_of(F.col(x), nodes) for x in "uv"}, {x: local_of(F.col(x), nodes) for x in "uv"}
    low = F.least(n["u"], n["v"])
    even = k["u"].bitwiseXOR(k["v"]).bitwiseAND(F.lit(1)) == 0
    return c.select("u", "v", "pos", n["u"].alias("node_u"), n["v"].alias("node_v"), F.when(even, F.greatest(n["u"], n["v"])).otherwise(low).alias("start_node"))


def shuffle_profile(c: DataFrame, nodes: int = NODES) -> DataFrame:
    """Triangle increments that leave the worker which found them."""
    own = owners(c, nodes).select("pos", F.col("start_node").alias("from_node"))
    sent = G.corners(G.triangles(c)).join(own, "pos").select("from_node", node_of(F.col("vid"), nodes).alias("to_node"), batch_of(F.col("pos")).alias("batch_id"))
    return sent.where("from_node <> to_node").groupBy("from_node", "to_node", "batch_id").agg(F.count("*").alias("increments"))
