"""Edge streams: from tables, flat arrays, binary files and generators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from edgeloom.functions.values import div
from edgeloom.sources.shared import materialise, qualified, ship

_ingested: dict[tuple[str, str, str, str], DataFrame] = {}


def with_positions(df: DataFrame, order: list[str]) -> DataFrame:
    """Adds pos, dense from 0 in the given total order, without sorting in one task.

    Rows are range-sorted and written with their place in their partition; what stands before each partition is
    summed over the partitions.
    """
    placed = materialise(df.orderBy(*order).withColumn("m", F.monotonically_increasing_id()), "ordered")
    part = F.shiftright("m", 33)
    sizes = {r["p"]: r["n"] for r in placed.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()}
    before, rows = 0, []
    for p in sorted(sizes):
        rows.append((p, before))
        before += sizes[p]
    starts = df.sparkSession.createDataFrame(rows, "p long, before long")
    # a row for each partition of the sort
    return placed.withColumn("p", part).join(F.broadcast(starts), "p").withColumn("pos", F.col("before") + F.col("m").bitwiseAND(F.lit((1 << 33) - 1))).drop("m", "p", "before")


def _state(spark: SparkSession, path: str) -> str:
    """Names, sizes and times of a table's files: another string once the table is written again."""
    own = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = own.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(own)
    return " ".join(sorted(f"{f.getPath().getName()}:{f.getLen()}:{f.getModificationTime()}" for f in files))


def ingest(spark: SparkSession, sf_dir: str, name: str, build, table: str = "lineitem") -> DataFrame:
    """Builds an edge table once an application, directory and state of the table's files."""
    key = (spark.sparkContext.applicationId, sf_dir, name, _state(spark, f"{sf_dir}/{table}.parquet"))
    if key not in _ingested:
        _ingested[key] = materialise(build(), name)
    return _ingested[key]


PS_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


def part_supplier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G_ps with attributes: pos, src (part), dst (supplier), quantity."""

    def build() -> DataFrame:
        rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(*PS_ORDER, "l_quantity")
        return with_positions(rows, [*PS_ORDER, "l_quantity"]).select("pos", F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"), F.col("l_quantity").alias("quantity"))

    return ingest(spark, sf_dir, "G_ps", build)


def user_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G_ev: from each event's user to the next event's user: pos, src, dst."""

    def build() -> DataFrame:
        rows = with_positions(spark.read.parquet(f"{sf_dir}/events.parquet").select("ts", "event_id", "user_id"), ["ts", "event_id"])
        here = rows.select("pos", F.col("user_id").alias("src"))
        after = rows.select((F.col("pos") - 1).alias("pos"), F.col("user_id").alias("dst"))
        return here.join(after, "pos").select("pos", "src", "dst")

    return ingest(spark, sf_dir, "G_ev", build, "events")


def pairs_from_flat(flat: DataFrame) -> DataFrame:
    """(arr) of x, y, x, y ... -> (pos, src, dst); an odd last element is dropped. Rows hold one batch each."""
    pairs = F.transform(F.sequence(F.lit(0), F.floor(F.size("arr") / 2).cast("int") - 1), lambda i: F.struct(F.get("arr", 2 * i).alias("src"), F.get("arr", 2 * i + 1).alias("dst")))
    return flat.where(F.size("arr") > 1).select(F.posexplode(pairs).alias("pos", "e")).select(F.col("pos").cast("long").alias("pos"), "e.src", "e.dst")


def rectangle(spark: SparkSession, rows: int, cols: int) -> DataFrame:
    """Grid with horizontal, vertical and diagonal edges; a vertex is i * cols + j."""
    cells = spark.range(rows * cols).select(F.col("id").alias("src"), grid_row(F.col("id"), cols).alias("i"), grid_col(F.col("id"), cols).alias("j"))
    steps = F.array(*[F.struct(F.lit(di).alias("di"), F.lit(dj).alias("dj")) for di, dj in ((0, 1), (1, 0), (1, 1))])
    moved = cells.withColumn("s", F.explode(steps)).where((F.col("i") + F.col("s.di") < rows) & (F.col("j") + F.col("s.dj") < cols))
    return moved.select("src", grid_id(F.col("i") + F.col("s.di"), F.col("j") + F.col("s.dj"), cols).alias("dst"))


def complete(spark: SparkSession, n: int, ordered: bool = False) -> DataFrame:
    """All pairs i < j of n vertices; ordered: all n * n pairs, loops included. The n * n pairs are the result itself."""
    pairs = spark.range(n * n).select(grid_row(F.col("id"), n).alias("src"), grid_col(F.col("id"), n).alias("dst"))
    return pairs if ordered else pairs.where("src < dst")


def grid_id(i: Column, j: Column, cols: int) -> Column:
    return (i * cols + j).cast("long")


def grid_row(vid: Column, cols: int) -> Column:
    return div(vid, F.lit(cols)).cast("long")


def grid_col(vid: Column, cols: int) -> Column:
    return F.pmod(vid, F.lit(cols)).cast("long")


def read_binary(spark: SparkSession, path: str) -> DataFrame:
    """Records of two little-endian 64-bit ids: (pos, src, dst), pos by place in the files, in order of their paths.

    Files are read as fixed-length records, so one large file is many tasks, and each task decodes its records as arrays.
    A record that a file's end cuts off is an error there; binary_edge_count() counts whole records.
    """
    import numpy as np
    import pyarrow as pa

    ship(spark)
    files = spark.read.format("binaryFile").load(qualified(spark, path)).select("path", (F.col("length") - F.col("length") % 16).alias("size")).where("size > 0").orderBy("path")
    names = [r["path"] for r in files.collect()]  # the files of a folder, as Spark itself lists them on the driver
    if not names:
        return spark.createDataFrame([], "pos long, src long, dst long")
    raw = spark.sparkContext.binaryRecords(",".join(names), 16)

    def decode(k: int, records):
        import itertools

        records = iter(records)
        while held := list(itertools.islice(records, 1 << 16)):
            ids = np.frombuffer(b"".join(held), "<i8").reshape(-1, 2)
            batch = pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(ids[:, 0])), pa.array(np.ascontiguousarray(ids[:, 1]))], ["src", "dst"])
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, batch.schema) as out:
                out.write_batch(batch)
            yield k, sink.getvalue().to_pybytes()

    def opened(batches):
        for b in batches:
            for part, order, data in zip(b.column(0), b.column(1), b.column(2), strict=True):
                own = pa.ipc.open_stream(data.as_py()).read_all().combine_chunks().to_batches()[0]
                n = own.num_rows
                place = pa.array(np.full(n, part.as_py(), np.int64)), pa.array(np.full(n, order.as_py(), np.int64)), pa.array(np.arange(n, dtype=np.int64))
                yield pa.RecordBatch.from_arrays([*place, own.column(0), own.column(1)], ["part", "block", "k", "src", "dst"])

    blocks = raw.mapPartitionsWithIndex(lambda k, records: ((k, i, data) for i, (_, data) in enumerate(decode(k, records))))
    packed = spark.createDataFrame(blocks, "part long, block long, data binary")
    rows = materialise(packed.mapInArrow(opened, "part long, block long, k long, src long, dst long"), "records")
    # what stands before each block: a row for each block of 65536 records
    sizes = rows.groupBy("part", "block").agg(F.count("*").alias("n"))
    placed = with_positions(sizes, ["part", "block"])
    before = running_total(placed, "n")
    return rows.join(before, ["part", "block"]).select((F.col("before") + F.col("k")).alias("pos"), "src", "dst")


def running_total(placed: DataFrame, size: str, run: int = 1 << 12) -> DataFrame:
    """Rows with a dense pos -> the same and `before`, the sum of `size` of all earlier rows, block by block of positions."""
    rows = placed.withColumn("_b", F.floor(F.col("pos") / run))
    totals = rows.groupBy("_b").agg(F.sum(size).alias("_t"))
    # a row for each block of positions
    carried = totals.select("_b", F.coalesce(F.sum("_t").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    own = F.coalesce(F.sum(size).over(Window.partitionBy("_b").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("_own", own).join(carried, "_b").withColumn("before", F.col("_own") + F.col("_before")).drop("_b", "_own", "_before", "pos", size)


def binary_edge_count(spark: SparkSession, path: str) -> DataFrame:
    """Whole records in the files, from their lengths alone."""
    return spark.read.format("binaryFile").load(qualified(spark, path)).select(F.floor(F.col("length") / 16).alias("n")).agg(F.sum("n").cast("long").alias("n"))
