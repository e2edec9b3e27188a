"""Neighbourhoods of both ends of each edge, looked up in memory: no row that holds one is dealt.

Neighbourhoods (vid, nbrs, values) are written in buckets of MOST_HELD elements, about. Edges are dealt by the buckets of both
ends, as pairs of ids; a Python worker holds the two buckets it is at and hands out rows with both neighbourhoods.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgeloom.sources.shared import arrow_place, materialise, new_path, ship

#: Elements of a bucket (16 bytes each), and of the rows that are handed out at once.
MOST_HELD, ELEMENTS = 4_000_000, 1 << 19
_held: dict[str, tuple] = {}


def _bucket(path: str, keep: str) -> tuple:
    """Vertices (sorted), where their neighbourhoods start and end, neighbours and values."""
    if path not in _held:
        import pyarrow.parquet as pq

        for other in [p for p in _held if p != keep]:
            del _held[other]
        system, root = arrow_place(path)
        table = pq.read_table(root, filesystem=system, columns=["vid", "nbrs", "values"], partitioning=None).combine_chunks()
        vid = table.column("vid").to_numpy()
        sizes = table.column("nbrs").combine_chunks().value_lengths().to_numpy().astype(np.int64)
        nbrs, values = (table.column(x).combine_chunks().flatten().to_numpy() for x in ("nbrs", "values"))
        order, ends = np.argsort(vid), np.cumsum(sizes)
        _held[path] = vid[order], (ends - sizes)[order], ends[order], nbrs, values
    return _held[path]


def _lists(held: tuple, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Is each id there, and where does its neighbourhood start and end?"""
    vid, starts, ends = held[:3]
    k = np.minimum(np.searchsorted(vid, ids), max(len(vid) - 1, 0))
    return (vid[k] == ids if len(vid) else np.zeros(len(ids), bool)), starts[k], ends[k]


def _taken(held: tuple, start: np.ndarray, end: np.ndarray) -> list[pa.Array]:
    n = end - start
    offsets = np.concatenate([[0], np.cumsum(n)])
    at = np.arange(offsets[-1]) - np.repeat(offsets[:-1] - start, n)
    return [pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(x[at])) for x in held[3:5]]


def attach(place: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(u, v, bu, bv) -> (u, v, a, da, b, db)."""
    for batch in batches:
        u, v, bu, bv = (c.to_numpy() for c in batch.columns)
        cells = np.flatnonzero(np.concatenate([[True], (bu[1:] != bu[:-1]) | (bv[1:] != bv[:-1]), [True]])) if len(u) else np.empty(0, np.int64)
        for lo, hi in zip(cells[:-1], cells[1:], strict=True):
            names = [f"{place}/b={b[lo]}" for b in (bu, bv)]
            one, two = _bucket(names[0], names[1]), _bucket(names[1], names[0])
            has_a, a0, a1 = _lists(one, u[lo:hi])
            has_b, b0, b1 = _lists(two, v[lo:hi])
            both = np.flatnonzero(has_a & has_b)
            total = np.concatenate([[0], np.cumsum((a1 - a0 + b1 - b0)[both])])
            at = 0
            while at < len(both):
                stop = max(at + 1, int(np.searchsorted(total, total[at] + ELEMENTS, "right")) - 1)
                own = both[at:stop]
                columns = [pa.array(u[lo:hi][own]), pa.array(v[lo:hi][own]), *_taken(one, a0[own], a1[own]), *_taken(two, b0[own], b1[own])]
                yield pa.RecordBatch.from_arrays(columns, ["u", "v", "a", "da", "b", "db"])
                at = stop


def both(edges: DataFrame, rows: DataFrame, widest: int) -> DataFrame:
    """edges (u, v), rows (vid, nbr, value) -> (u, v, a, da, b, db): the ends' neighbours, ascending, and their values, for
    edges both ends of which have `widest` neighbours at most."""
    spark = edges.sparkSession
    ship(spark)
    own = rows.groupBy("vid").agg(F.sort_array(F.collect_list(F.struct("nbr", "value"))).alias("e")).where(F.size("e") <= widest)
    lists = materialise(own.select("vid", F.col("e.nbr").alias("nbrs"), F.col("e.value").alias("values")), "neighbourhoods")
    n = max(1, -(-(lists.agg(F.sum(F.size("nbrs"))).first()[0] or 0) // MOST_HELD))
    of = lambda x: F.pmod(F.xxhash64(x), F.lit(n))
    place = new_path(spark, "neighbourhood-buckets")
    lists.withColumn("b", of("vid")).repartition("b").write.partitionBy("b").option("compression", "zstd").parquet(place)
    have = spark.read.parquet(place).select("b").distinct() if not lists.isEmpty() else None
    if have is None:
        return spark.createDataFrame([], "u long, v long, a array<long>, da array<long>, b array<long>, db array<long>")
    there = [r["b"] for r in have.collect()]
    # at least as many parts as there are cores; a part meets a bucket once
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), n)
    dealt = edges.select("u", "v", of("u").alias("bu"), of("v").alias("bv")).where(F.col("bu").isin(there) & F.col("bv").isin(there))
    return dealt.repartition(parts, "bu", "bv", F.pmod(F.xxhash64("u", "v"), F.lit(parts))).sortWithinPartitions("bu", "bv").mapInArrow(partial(attach, place), "u long, v long, a array<long>, da array<long>, b array<long>, db array<long>")
