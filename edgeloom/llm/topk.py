"""Exact top-k search by no-random-access aggregation.

For a query q, dimension d is a list of all vectors sorted by q[d] * c[d]. Lists are read from their best end, block by
block, and never looked up by id. After each block a vector's score lies between a lower bound (what was read, plus each
unread list's worst value) and an upper bound (plus the value that list has come to). The bar is the best lower bound of a
k-th vector seen so far; it is carried from block to block and from table to table. A vector whose upper bound is below
the bar can't qualify and is dropped; so is, at once, everything not met yet, as soon as the sum of the values that lists
have come to is below it. A query stops reading when few vectors are left or the lists end; their scores are resolved
and ranked. Ties go to the smaller id, so a bound that equals the bar is kept. Blocks of a batch of queries are read
together: what is known of a component is the same for all queries that read a list from one end, so their bounds are
matrix products over the vectors that some query of the batch still needs.

Vectors lie in tables of about TILE of them, by length (norm), the longest first; each table knows its lists' two ends.
Before anything is sent, every query gets a first bar from the BAR longest vectors, a table of fixed size, and is dealt
only to the tables of which the lists' ends don't rule out that a vector reaches the bar. Vectors are copied only for
tables that more than QUERIES of them reach.

Defined cases: vectors that are null or hold null or non-finite components take no part, nor do rows without an id;
components of MOST or more after scaling end the job with an error (scores would not fit 64 bits); rows that repeat an
id count once, with the least vector; vectors of fewer dimensions count as zero beyond, those without dimensions score
zero; equal scores rank by id; an empty table gives no rows; further columns are ignored. There are no texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from edgeloom.llm.common import materialise, new_path, ship, tidy
from edgeloom.sources.shared import arrow_place

#: Vectors of a table, queries of a group, vectors of the first bar, queries of a batch.
TILE, QUERIES, BAR, BATCH = 16384, 2048, 4096, 128
#: Blocks in which lists are read, and the share of vectors at which a query is resolved.
BLOCKS, FEW = 8, 1 / 64
MOST = 1 << 24
LOW = np.iinfo(np.int64).min


class SortedLists:
    """All dimensions of a set of vectors as sorted lists. entries: how many list entries all queries have read."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[order], np.ascontiguousarray(vectors[order])
        by = np.argsort(self.vectors, axis=0, kind="stable")
        self.values = np.take_along_axis(self.vectors, by, axis=0)
        self.rank = np.empty(by.shape, np.int32)
        np.put_along_axis(self.rank, by, np.arange(len(ids), dtype=np.int32)[:, None], axis=0)
        self.entries = 0

    def bounds(self, depth: int, some: np.ndarray) -> tuple[np.ndarray, ...]:
        """What is known of every component of some vectors after `depth` entries of each list: lower and upper from the
        top end, then from the bottom end (there for negative weights, so the greater component is the lower bound)."""
        n, c, rank = len(self.ids), self.vectors[some], self.rank[some]
        top, bottom = rank >= n - depth, rank < depth
        return np.where(top, c, self.values[0]), np.where(top, c, self.values[n - depth]), np.where(bottom, c, self.values[-1]), np.where(bottom, c, self.values[depth - 1])

    def top(self, queries: np.ndarray, own: np.ndarray, bars: np.ndarray, k: int) -> list[list[tuple[int, int]]]:
        """For each query the (id, score) of its k best, without its own id, as far as they reach its bar."""
        n = len(self.ids)
        # products are exact in doubles below 2**53; larger ones are counted in integers
        most = float(np.abs(queries).max(initial=0)) * float(np.abs(self.vectors).max(initial=0)) * max(1, queries.shape[1])
        kind = np.float64 if most < 2**53 else np.int64
        q = queries.astype(kind)
        up, down = np.maximum(q, 0), np.minimum(q, 0)
        alive = self.ids[None, :] != own[:, None]
        bars, open_ = bars.astype(kind), np.arange(len(q))
        for block in range(1, BLOCKS):
            depth = n * block // BLOCKS
            open_ = open_[alive[open_].sum(axis=1) > max(k, n * FEW)]
            if depth < 1 or not len(open_):
                continue
            self.entries += depth * q.shape[1] * len(open_) if block == 1 else (depth - n * (block - 1) // BLOCKS) * q.shape[1] * len(open_)
            some = np.flatnonzero(alive[open_].any(axis=0))
            low_top, high_top, low_bottom, high_bottom = (x.astype(kind) for x in self.bounds(depth, some))
            mine = alive[np.ix_(open_, some)]
            if len(some) > k:
                lower = up[open_] @ low_top.T + down[open_] @ low_bottom.T
                lower[~mine] = LOW
                bars[open_] = np.maximum(bars[open_], np.partition(lower, len(some) - k, axis=1)[:, len(some) - k])
            mine &= up[open_] @ high_top.T + down[open_] @ high_bottom.T >= bars[open_][:, None]
            alive[np.ix_(open_, some)] = mine
        return [self._resolve(np.flatnonzero(a), v, k) for a, v in zip(alive, q, strict=True)]

    def _resolve(self, alive: np.ndarray, q: np.ndarray, k: int) -> list[tuple[int, int]]:
        """Final scores of the vectors that may qualify."""
        score = (self.vectors[alive] @ q) if q.dtype == np.int64 else (self._exact(alive) @ q)
        if len(score) > k:
            edge = np.partition(score, len(score) - k)[len(score) - k]
            alive, score = alive[score >= edge], score[score >= edge]
        best = np.lexsort((self.ids[alive], -score))[:k]
        return [(int(self.ids[alive[i]]), int(score[i])) for i in best]

    def _exact(self, alive: np.ndarray) -> np.ndarray:
        if not hasattr(self, "_doubles"):
            self._doubles = self.vectors.astype(np.float64)
        return self._doubles if len(alive) == len(self.ids) else self._doubles[alive]


def _matrix(column, width: int) -> np.ndarray:
    out = np.zeros((len(column), width), np.int64)
    for i, v in enumerate(column):
        own = v.values.to_numpy(zero_copy_only=False)
        out[i, : len(own)] = own
    return out


def first_bars(queries: np.ndarray, own: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int) -> np.ndarray:
    """Each query's k-th best score among a few vectors, without its own id; LOW if they are fewer."""
    if len(ids) <= k:
        return np.full(len(own), LOW)
    out = []
    for i in range(0, len(own), BATCH):
        scores = queries[i : i + BATCH] @ vectors.T
        scores[ids[None, :] == own[i : i + BATCH, None]] = LOW
        out.append(np.partition(scores, len(ids) - k, axis=1)[:, len(ids) - k])
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def reaches(queries: np.ndarray, bars: np.ndarray, top: np.ndarray, bottom: np.ndarray) -> np.ndarray:
    """For each query and table: may a vector between the table's list ends reach the bar?"""
    return np.maximum(queries, 0) @ top.T + np.minimum(queries, 0) @ bottom.T >= bars[:, None]


def _dealt(places: dict[str, str], k: int, width: int):
    """(id, v) of queries -> (x, id, v, bar) for the tables x that they have to meet. places: folders of two written
    tables, the longest vectors (id, v) and the tables' ends (x, top, bottom)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.parquet as pq

        def read(name: str) -> pa.Table:
            system, root = arrow_place(places[name])
            return pq.read_table(root, filesystem=system)

        longest, ends = read("longest"), read("ends").sort_by("x")
        ids, vectors = longest.column("id").to_numpy(), _matrix(longest.column("v"), width)
        top, bottom = _matrix(ends.column("top"), width), _matrix(ends.column("bottom"), width)
        numbers = ends.column("x").to_numpy()
        for batch in batches:
            own, q = batch.column(0).to_numpy(), _matrix(batch.column(1), width)
            bars = first_bars(q, own, ids, vectors, k)
            at, to = np.nonzero(reaches(q, bars, top, bottom))
            yield pa.RecordBatch.from_arrays([pa.array(numbers[to], pa.int32()), pa.array(own[at], pa.int64()), batch.column(1).take(pa.array(at)), pa.array(bars[at], pa.int64())], ["x", "id", "v", "bar"])
        tidy()

    return work


def top_k(vectors: DataFrame, every: int = 50, k: int = 5, scale: int = 256) -> DataFrame:
    """The k best of all other rows for each row whose vec_id is divisible by `every`: query_id, rank, vec_id, score.

    Components are floor(scale * x); the score is the inner product.
    """
    spark = vectors.sparkSession
    ship(spark)
    scaled = lambda x: x.cast("double") * scale
    too_large = F.raise_error(F.lit(f"a component is {MOST} or more after scaling")).cast("long")
    whole = F.transform("embedding", lambda x: F.when(F.abs(scaled(x)) < MOST, F.floor(scaled(x))).otherwise(too_large))
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    rows = vectors.where(F.col("embedding").isNotNull() & F.col("vec_id").isNotNull() & ~F.coalesce(bad, F.lit(True)))
    rows = rows.select(F.col("vec_id").cast("bigint").alias("id"), whole.alias("v")).groupBy("id").agg(F.min("v").alias("v"))
    length = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x)
    rows = rows.withColumn("length", length)
    n = vectors.count()
    across, down = max(1, -(-n // TILE)), max(1, -(-n // every // QUERIES))
    tables = materialise(rows.repartitionByRange(across, F.desc("length"), "id").withColumn("x", F.spark_partition_id()), "topk-vectors")
    width = max(1, tables.agg(F.max(F.size("v"))).first()[0] or 1)

    places = {"longest": new_path(spark, "topk-longest"), "ends": new_path(spark, "topk-ends")}
    tables.orderBy(F.desc("length"), "id").limit(BAR).select("id", "v").write.parquet(places["longest"])
    # components that a shorter vector lacks are zero
    padded = F.concat("v", F.array_repeat(F.lit(0).cast("long"), F.lit(width) - F.size("v")))
    parts = tables.select("x", F.posexplode(padded).alias("d", "c")).groupBy("x", "d").agg(F.max("c").alias("top"), F.min("c").alias("bottom"))
    ends = parts.groupBy("x").agg(F.sort_array(F.collect_list(F.struct("d", "top", "bottom"))).alias("e"))
    ends.select("x", F.col("e.top").alias("top"), F.col("e.bottom").alias("bottom")).write.parquet(places["ends"])

    asked = tables.where(F.col("id") % every == 0).select("id", "v").mapInArrow(_dealt(places, k, width), "x int, id long, v array<bigint>, bar long")
    asked = materialise(asked.withColumn("y", F.pmod(F.xxhash64("id"), F.lit(down)).cast("int")), "topk-asked")
    needed = asked.select(F.col("x").alias("to"), F.col("y").alias("group")).distinct()
    left = tables.join(needed, F.col("x") == F.col("to")).select("to", "group", "id", "v")

    def tile(own: pa.Table, asked: pa.Table) -> pa.Table:
        out: list[tuple[int, int, int]] = []
        if own.num_rows and asked.num_rows:
            lists = SortedLists(own.column("id").to_numpy(), _matrix(own.column("v"), width))
            ids, vectors, bars = asked.column("id").to_numpy(), _matrix(asked.column("v"), width), asked.column("bar").to_numpy()
            for i in range(0, len(ids), BATCH):
                best = lists.top(vectors[i : i + BATCH], ids[i : i + BATCH], bars[i : i + BATCH], k)
                out += [(int(q), v, s) for q, own in zip(ids[i : i + BATCH], best, strict=True) for v, s in own]
        return pa.table([pa.array([r[c] for r in out], pa.int64()) for c in range(3)], ["query_id", "vec_id", "score"])

    best = left.groupBy("to", "group").cogroup(asked.groupBy("x", "y")).applyInArrow(tile, "query_id long, vec_id long, score long")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def oracle(every: int = 50, k: int = 5, scale: int = 256) -> str:
    """The same by brute force, in DuckDB SQL."""
    return f"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor({scale} * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score FROM v q, v c WHERE q.vec_id % {every} = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= {k}
"""
