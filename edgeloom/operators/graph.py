"""The simple graph of an edge stream, and what is counted on it.

Self-loops never count; of equal undirected edges the first arrival does. Triangles are found on edges oriented from
lower to higher (degree, id), which bounds the wedges of hubs.
"""

from __future__ import annotations

import weakref
from functools import partial, reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from edgeloom.functions.values import div
from edgeloom.operators import closing
from edgeloom.sources.shared import materialise, new_path, path_of, ship


def canonical(edges: DataFrame) -> DataFrame:
    """(pos, src, dst) -> (u, v, pos): u < v, first arrival."""
    return edges.where("src <> dst").groupBy(F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v")).agg(F.min("pos").alias("pos"))


def classify(edges: DataFrame) -> DataFrame:
    """pos, src, dst, status: self_loop, duplicate or new."""
    keyed = edges.select("pos", "src", "dst", F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v"))
    first = canonical(edges).withColumnRenamed("pos", "first")
    status = F.when(F.col("src") == F.col("dst"), "self_loop").when(F.col("pos") > F.col("first"), "duplicate").otherwise("new")
    return keyed.join(first, ["u", "v"], "left").select("pos", "src", "dst", status.alias("status"))


def symmetric(c: DataFrame) -> DataFrame:
    """(vid, nbr, pos), both directions, from one pass over the edges."""
    both = F.array(F.struct(F.col("u").alias("vid"), F.col("v").alias("nbr")), F.struct(F.col("v").alias("vid"), F.col("u").alias("nbr")))
    return c.select(F.explode(both).alias("e"), "pos").select("e.vid", "e.nbr", "pos")


def degree(c: DataFrame) -> DataFrame:
    return symmetric(c).groupBy("vid").agg(F.count("*").alias("degree"))


#: The lists of each simple graph that was asked for triangles, and the folders of its closing edges.
_oriented: weakref.WeakKeyDictionary[DataFrame, tuple[DataFrame, list[str]]] = weakref.WeakKeyDictionary()


def oriented(c: DataFrame) -> tuple[DataFrame, list[str]]:
    """(s, ts, ps): each vertex with its targets of higher (degree, id), ascending, and their edges' positions; and where the
    edges lie that may close a wedge, bucket by bucket. Written once for each table c."""
    if c not in _oriented:
        spark = c.sparkSession
        # a row for each vertex: hashed, so the edges need no sort
        d = degree(c).hint("shuffle_hash")
        ranked = c.join(d.select(F.col("vid").alias("u"), F.col("degree").alias("du")), "u").join(d.select(F.col("vid").alias("v"), F.col("degree").alias("dv")), "v")
        up = (F.col("du") < F.col("dv")) | ((F.col("du") == F.col("dv")) & (F.col("u") < F.col("v")))
        edges = ranked.select(F.when(up, F.col("u")).otherwise(F.col("v")).alias("s"), F.when(up, F.col("v")).otherwise(F.col("u")).alias("t"), "pos")
        packed = edges.groupBy("s").agg(F.array_sort(F.collect_list(F.struct("t", "pos"))).alias("e"))
        lists = materialise(packed.select("s", F.col("e.t").alias("ts"), F.col("e.pos").alias("ps")), "oriented")
        # both ends of a closing edge are targets
        targets = lists.select(F.explode("ts").alias("s")).distinct()
        third = lists.join(targets, "s", "left_semi").select("s", F.explode(F.arrays_zip("ts", "ps")).alias("e"))
        third = materialise(third.select(F.least("s", "e.ts").alias("t1"), F.greatest("s", "e.ts").alias("t2"), F.col("e.ps").alias("p3")), "closing")
        n = -(-third.count() // closing.MOST_HELD)
        place = path_of(third)
        if n > 1:
            place = new_path(spark, "closing-buckets")
            third.withColumn("b", F.pmod(F.xxhash64("t1"), F.lit(n))).repartition("b").write.partitionBy("b").option("compression", "zstd").parquet(place)
        _oriented[c] = lists, [place] if n == 1 else [f"{place}/b={k}" for k in range(n)]
    return _oriented[c]


def triangles(c: DataFrame) -> DataFrame:
    """(p, q, r, done_pos): p < q < r, done_pos of the edge that closes it.

    A vertex has few targets (at most the square root of twice the edges), so its pairs of targets, the wedges, are few; the
    edge between two targets closes a triangle. closing.close() looks it up where the list is.
    """
    return _from_wedges(c, closing.close, closing.FOUND)


def _from_wedges(c: DataFrame, work, schema: str) -> DataFrame:
    """work over the lists, once for each bucket of closing edges."""
    lists, places = oriented(c)
    ship(c.sparkSession)
    found = [lists.where(F.size("ts") > 1).mapInArrow(partial(work, place), schema) for place in places]
    return reduce(DataFrame.union, found) if found else c.sparkSession.createDataFrame([], schema)


#: Triangles that were written because they are read more than once.
_held: weakref.WeakKeyDictionary[DataFrame, DataFrame] = weakref.WeakKeyDictionary()


def held_triangles(c: DataFrame) -> DataFrame:
    """triangles(), written once for each table c."""
    if c not in _held:
        _held[c] = materialise(triangles(c), "triangles")
    return _held[c]


def corners(t: DataFrame) -> DataFrame:
    """(vid, pos), a row for each corner of each triangle."""
    return t.select(F.explode(F.array("p", "q", "r")).alias("vid"), F.col("done_pos").alias("pos"))


def triangle_count(c: DataFrame) -> DataFrame:
    found = corners(triangles(c)).groupBy("vid").agg(F.count("*").alias("triangles"))
    return degree(c).join(found, "vid", "left").select("vid", "degree", F.coalesce("triangles", F.lit(0)).cast("long").alias("triangles"))


def coefficient(deg: Column, tri: Column) -> Column:
    """Whole number of at most 50; null below two neighbours."""
    return F.when(deg > 1, div(tri * 100, F.when(deg > 1, deg * (deg - 1)))).cast("long")


def clustering(c: DataFrame) -> DataFrame:
    return triangle_count(c).withColumn("cc", coefficient(F.col("degree"), F.col("triangles")))


def clustering_last_touch(c: DataFrame) -> DataFrame:
    """The coefficient as it was written when an edge of the vertex arrived last."""
    own = symmetric(c).groupBy("vid").agg(F.count("*").alias("degree"), F.max("pos").alias("last"))
    seen = corners(triangles(c)).join(own, "vid").where("pos <= last").groupBy("vid").agg(F.count("*").alias("t"))
    return own.join(seen, "vid", "left").select("vid", coefficient(F.col("degree"), F.coalesce("t", F.lit(0))).alias("cc"))


def by_edge(t: DataFrame) -> DataFrame:
    """(u, v, nbr): a common neighbour of the edge's ends, a row for each side of each triangle."""
    sides = F.array(*[F.struct(F.col(a).alias("u"), F.col(b).alias("v"), F.col(n).alias("nbr")) for a, b, n in (("p", "q", "r"), ("p", "r", "q"), ("q", "r", "p"))])
    return t.select(F.explode(sides).alias("e")).select("e.*")


def common_neighbours(c: DataFrame) -> DataFrame:
    """u, v, n_common, acc (sum of the common neighbours' ids) of each edge."""
    # every side is an edge of c, so both meet in one sum and not in a join
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")
    rows = c.select("u", "v", "pos", zero.alias("n"), zero.alias("s")).union(_from_wedges(c, closing.sides, closing.SIDES).select("u", "v", none, "n", "s"))
    return rows.groupBy("u", "v").agg(F.max("pos").alias("pos"), F.sum("n").alias("n_common"), F.sum("s").alias("acc"))


def edge_triangle_delta(c: DataFrame) -> DataFrame:
    """Common neighbours of each edge's ends when it arrived: triangles that it closed."""
    closed = triangles(c).groupBy(F.col("done_pos").alias("pos")).agg(F.count("*").alias("n"))
    return c.join(closed, "pos", "left").select("pos", "u", "v", F.coalesce("n", F.lit(0)).cast("long").alias("n_common"))


#: Positions of one block of a running sum, and rows from which a vertex is summed in blocks.
RUN = 1 << 16
#: Vertices that are summed in blocks: any other has at most a thousandth of the rows.
HUBS = 1000


def running_sums(deltas: DataFrame, names: list[str], size: int | None = None, unique: bool = False) -> DataFrame:
    """(vid, pos, a column for each name) -> a row for each vid and pos: the columns summed there as d_<name>, and <name>,
    their sums up to there.

    Rows are dealt once, by vertex. Those of hubs are dealt and summed by blocks of `size` positions, and only a block's
    total is carried. deltas is read twice, so it should lie in a table. unique: it has one row for each vid and pos.
    """
    size = size or RUN
    many = deltas.groupBy("vid").agg(F.count("*").alias("n")).where(F.col("n") > RUN).orderBy(F.desc("n"), "vid").limit(HUBS)
    hubs = [r["vid"] for r in many.collect()]
    block = F.when(F.col("vid").isin(hubs), F.floor(F.col("pos") / F.lit(size))).otherwise(0) if hubs else F.lit(0)
    keys = ["vid", "block"] if hubs else ["vid"]
    rows = deltas.withColumn("block", block.cast("long")).repartition(*keys)
    if unique:
        rows = rows.select(*keys, "pos", *[F.col(n).alias(f"d_{n}") for n in names])
    else:
        rows = rows.groupBy(*keys, "pos").agg(*[F.sum(n).alias(f"d_{n}") for n in names])
    own = Window.partitionBy(*keys).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    out = rows.select("*", *[F.sum(f"d_{n}").over(own).cast("long").alias(n) for n in names])
    if hubs:
        totals = deltas.where(F.col("vid").isin(hubs)).groupBy("vid", block.cast("long").alias("block")).agg(*[F.sum(n).alias(n) for n in names])
        earlier = Window.partitionBy("vid").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
        carried = totals.select("vid", "block", *[F.sum(n).over(earlier).alias(f"b_{n}") for n in names])
        out = out.join(carried, keys, "left").select("vid", "pos", *[f"d_{n}" for n in names], *[(F.col(n) + F.coalesce(f"b_{n}", F.lit(0))).cast("long").alias(n) for n in names])
    return out.select("vid", "pos", *[f"d_{n}" for n in names], *names)


def running_sum(deltas: DataFrame, size: int | None = None, unique: bool = False) -> DataFrame:
    """(vid, pos, delta) -> (vid, pos, value), inclusive, a row for each vid and pos."""
    return running_sums(deltas.withColumnRenamed("delta", "value"), ["value"], size, unique).select("vid", "pos", "value")


def running_degree(c: DataFrame) -> DataFrame:
    return running_sum(symmetric(c).select("vid", "pos", F.lit(1).cast("long").alias("delta")), unique=True)


def running_triangles(c: DataFrame) -> DataFrame:
    return running_sum(corners(held_triangles(c)).select("vid", "pos", F.lit(1).cast("long").alias("delta")))


def adjacency_asof(c: DataFrame) -> DataFrame:
    """Neighbours that each edge's ends had strictly before it."""
    run = running_degree(c)
    a, b = run.select(F.col("vid").alias("u"), "pos", (F.col("value") - 1).alias("deg_u")), run.select(F.col("vid").alias("v"), "pos", (F.col("value") - 1).alias("deg_v"))
    return c.join(a, ["u", "pos"]).join(b, ["v", "pos"]).select("pos", "u", "v", "deg_u", "deg_v")
