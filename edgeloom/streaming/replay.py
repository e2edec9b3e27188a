"""Edges as a stream: each micro-batch extends the graph and the results of a stack of analyses.

State is three append-only tables below one path: edges, sums of deltas (vid, result, value) and puts (vid, result, at,
step, value), all by batch. A batch that runs again overwrites its own partitions and sees earlier batches only, so results
are right under at-least-once delivery. A result is the sum of its deltas, or its latest put.

A batch looks at the old edges of its own vertices and of what lies between them, no others: while the batch's vertices
are few (MOST_VERTICES) they are sent to the scans of the old edges, so the old graph is read, but neither dealt nor
sorted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edgeloom.operators import graph as G
from edgeloom.plans.stack import BEFORE, DEGREE, TRIANGLES, Stack, Surroundings, opposite
from edgeloom.sources.shared import materialise

EDGE = "pos long, src long, dst long, batch_id long"
SUM, PUT = "vid long, result string, value long, batch_id long", "vid long, result string, at long, step int, value long, batch_id long"
MOST_VERTICES = 1_000_000
#: Edges of an input file that replay() writes, about.
FILE_EDGES = 1_000_000


class Replay:
    def __init__(self, spark: SparkSession, path: str, stack: Stack | None = None):
        self.spark, self.path = spark, path
        self.stack = stack or Stack(DEGREE, TRIANGLES)

    def _read(self, name: str, schema: str, before: int | None = None) -> DataFrame:
        try:
            df = self.spark.read.schema(schema).parquet(f"{self.path}/{name}")
        except Exception as e:  # nothing is written yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], schema)
        return df if before is None else df.where(F.col("batch_id") < before)

    def batch(self, edges: DataFrame, batch_id: int) -> None:
        """Adds one micro-batch of (pos, src, dst)."""
        ends = lambda df: df.select(F.explode(F.array("src", "dst")).alias("vid")).distinct()
        old = self._read("edges", EDGE, batch_id).select("pos", "src", "dst")
        batch = materialise(edges.where("src <> dst").select("pos", "src", "dst"), "batch")
        touched = materialise(ends(batch), "batch-vertices")
        few = F.broadcast if touched.count() <= MOST_VERTICES else (lambda df: df)

        keyed = lambda df: df.select(F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v"), F.struct("pos", "src", "dst").alias("e"))
        mine = old.join(few(touched.select(F.col("vid").alias("src"))), "src", "left_semi").join(few(touched.select(F.col("vid").alias("dst"))), "dst", "left_semi")
        first = keyed(batch).groupBy("u", "v").agg(F.min("e").alias("e"))
        self._write(first.join(keyed(mine).select("u", "v"), ["u", "v"], "left_anti").select("e.*"), "edges", batch_id)
        new = self.spark.read.schema("pos long, src long, dst long").parquet(f"{self.path}/edges/batch_id={batch_id}")

        sides = F.array(F.struct(F.col("src").alias("vid"), F.col("dst").alias("nbr")), F.struct(F.col("dst").alias("vid"), F.col("src").alias("nbr")))
        # what came with earlier batches was there before, whatever its position
        every = old.withColumn("pos", F.lit(BEFORE).cast("long")).unionByName(new)
        known = every.select(F.explode(sides).alias("e"), "pos").select("e.vid", "e.nbr", F.col("pos").alias("arrived"))
        earlier = self._read("sums", SUM, batch_id).groupBy("vid", "result").agg(F.sum("value").alias("value"))
        near = materialise(known.join(few(touched), "vid", "left_semi"), "batch-neighbours")

        def closed() -> DataFrame:
            """Neighbours of both ends, before the edge: triangles of the edges that touch the batch, closed by one of its own."""
            c = materialise(near.groupBy(F.least("vid", "nbr").alias("u"), F.greatest("vid", "nbr").alias("v")).agg(F.min("arrived").alias("pos")), "batch-graph")
            t = G.triangles(c).where(F.col("done_pos") > BEFORE).withColumnRenamed("done_pos", "pos").join(new, "pos")
            return materialise(opposite(t), "batch-closed")

        # loops over other vertices than the edge's ends need all neighbours
        deep = any(s.over is not None and s.over.of is not None and not s.over.end for s in self.stack.steps) or any(t.loop.of is not None and not t.loop.end for _, e in self.stack.programs for t in e.totals.values())
        deltas, puts = self.stack.compiled(Surroundings(new, known if deep else near, closed, earlier))
        self._write(deltas.groupBy("vid", "result").agg(F.sum("delta").alias("value")), "sums", batch_id)
        last = puts.groupBy("vid", "result").agg(F.max(F.struct(F.col("pos").alias("at"), "step", "value")).alias("p"))
        self._write(last.select("vid", "result", "p.*"), "puts", batch_id)

    def _write(self, df: DataFrame, name: str, batch_id: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.path}/{name}/batch_id={batch_id}")

    def results(self) -> DataFrame:
        """vid and a column for each analysis."""
        sums = self._read("sums", SUM).groupBy("vid", "result").agg(F.sum("value").alias("value"))
        last = self._read("puts", PUT).groupBy("vid", "result").agg(F.max_by("value", F.struct("batch_id", "at", "step")).alias("value"))
        vertices = self._read("edges", EDGE).select(F.explode(F.array("src", "dst")).alias("vid")).distinct()
        return self.stack.table(vertices, sums, last)

    def affected(self) -> DataFrame:
        both = self._read("sums", SUM).select("batch_id", "vid").union(self._read("puts", PUT).select("batch_id", "vid"))
        return both.distinct()

    def run(self, stream: DataFrame, checkpoint: str) -> None:
        """Feeds all that a streaming DataFrame of (pos, src, dst) has now."""
        query = stream.writeStream.foreachBatch(lambda df, k: self.batch(df, k)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()


def _files(spark: SparkSession, path: str) -> int:
    own = spark._jvm.org.apache.hadoop.fs.Path(path)
    return sum(f.getPath().getName().endswith(".parquet") for f in own.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(own))


def replay(edges: DataFrame, path: str, batches: int = 3, stack: Stack | None = None) -> DataFrame:
    """Writes the edges as files, batch after batch in order of arrival, and streams them, a batch's files a micro-batch."""
    spark = edges.sparkSession
    n = edges.count()
    files = max(1, n // batches // FILE_EDGES)
    for k in range(batches):
        own = (F.col("pos") >= n * k // batches) & (F.col("pos") < n * (k + 1) // batches)
        edges.where(own).repartitionByRange(files, "pos").sortWithinPartitions("pos").write.mode("append").parquet(f"{path}/input")
        if (written := _files(spark, f"{path}/input")) != files * (k + 1):
            raise RuntimeError(f"{written} files after batch {k} instead of {files * (k + 1)}")
    stream = spark.readStream.schema("pos long, src long, dst long").option("maxFilesPerTrigger", files).parquet(f"{path}/input")
    state = Replay(spark, path, stack)
    state.run(stream, f"{path}/progress")
    return state.results()
