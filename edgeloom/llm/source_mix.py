"""Mixing sources to target weights by Pareto order sampling, in DataFrame functions only.

Targets. Sources in code-point order (null last) weigh `weights`, repeating, and share all words; a target stops at
`most` times its source's words, and what is over is shared again by weight until none is above: target =
min(most * words, level * weight). The level is found by sharing again and again; each round is one sum over the
sources, however many there are.

Inclusion. Documents are not equal: a source's documents are wanted in proportion to their `priority`, a column of
the caller's choice, or, without one, to size / (size + HALF), so that scraps of a few words are repeated less than
whole texts. A document's expected number of copies is min(most, level * priority), with the source's own level such that
the source meets its target. It is taken floor(expected) times for certain, and the rest of the expectation is
its inclusion probability p in an order sample of fixed size, in words: documents are ranked by random odds divided by
inclusion odds, (u / (1 - u)) / (p / (1 - p)), and taken in that order until the source's words are used up. So
priorities are met in expectation and targets exactly; the document at the border is taken in part (cut) or by rounding
(whole documents only).

Priorities count by CLASSES steps to a factor of 2, from 2**-LOWEST to 2**LOWEST, so a source has a bounded number of
classes and the levels follow from sums by (source, class).

The border is found by a radix select: words are summed by (source, 1024 ranges of the rank), then, in the border
range alone, by 1024 finer ranges, and only the rows of the border cell, about a millionth of a source, are sorted.
So a source that holds a third of all rows needs no large window, nor are its rows dealt by source: the classes that
hold a thousandth of the rows or more, which are a thousand at most, are broadcast.

Random numbers are hashes of (doc_id, text, seed), so reruns agree.

Defined cases: a null text has size 0 and is taken 0 words; a null source is a source of its own; a source without
words has target 0; a priority that is null, not a positive number or not a number at all counts as 1; rows that
repeat a doc_id are documents of their own, told apart by their texts; rows that repeat both have the same rank, and one
of them, no matter which, may be taken more often than the others; very long texts are documents like others (one at
the border is cut, or rounded); an empty table gives no rows; further columns are ignored by mix(), whatever their
names are, and kept by mixed_documents().
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from edgeloom.llm.common import column, discard, join_per_key, materialise, whole_row, words_of
from edgeloom.sources.graphs import with_positions

RANGES = 1024
#: Words of a document that is wanted half as much as a very long one.
HALF = 100
CLASSES, LOWEST = 4, 10


def targets(sums: DataFrame, weights: Sequence[float], most: float) -> DataFrame:
    """A row for each source of sums (source, source_size), each once: source, source_size, target."""
    placed = with_positions(sums, [F.col("source").asc_nulls_last()])
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("pos") % len(weights) + 1).cast("int"))
    rows = materialise(placed.select("source", "source_size", weight.alias("weight"), (F.col("source_size") * float(most)).alias("full")), "mix-sources")
    total = float(rows.agg(F.sum("source_size")).first()[0] or 0)
    level, closed = 0.0, None
    while True:
        over = F.lit(level) * F.col("weight") > F.col("full")
        now = rows.agg(F.count(F.when(over, 1)), F.sum(F.when(over, F.col("full"))), F.sum(F.when(~over, F.col("weight")))).first()
        if closed == now[0] or not now[2]:
            break
        closed, level = now[0], (total - (now[1] or 0.0)) / now[2]
    return rows.select("source", "source_size", F.least(F.col("full"), F.lit(level) * F.col("weight")).alias("target"))


def _classes(sized: DataFrame, weights: Sequence[float], most: float) -> DataFrame:
    """A row for each (source, class) of sized: key, n_rows, source_size, target, whole, p, goal (the source's words beyond
    whole copies)."""
    classes = materialise(sized.groupBy("key", "source", "class").agg(F.count("*").alias("n_rows"), F.sum("size").alias("words")), "mix-classes")
    goals = targets(classes.groupBy("source").agg(F.sum("words").alias("source_size")), weights, most)
    rows = classes.join(goals.withColumnRenamed("source", "own"), F.col("source").eqNullSafe(F.col("own"))).drop("own")
    # a source's level: classes of the highest priority reach `most` first; a source has 2 * LOWEST * CLASSES + 1 classes at most
    rows = rows.withColumn("priority", F.pow(F.lit(2.0), F.col("class") / CLASSES))
    order = Window.partitionBy("source").orderBy(F.desc("class"))
    before = F.coalesce(F.sum(F.col("words") * float(most)).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum(F.col("words") * F.col("priority")).over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    rows = rows.withColumn("level", (F.col("target") - before) / F.when(left > 0, left))
    every = Window.partitionBy("source")
    level = F.min(F.when(F.col("level") * F.col("priority") <= float(most), F.struct(-F.col("class"), F.col("level").alias("level")))).over(every)["level"]
    expected = F.when(F.col("words") > 0, F.coalesce(F.least(F.lit(float(most)), level * F.col("priority")), F.lit(float(most)))).otherwise(0.0)
    rows = rows.withColumn("expected", expected).withColumn("whole", F.floor(F.col("expected") + 1e-9))
    p = F.greatest(F.lit(0.0), F.least(F.lit(1 - 1e-9), F.col("expected") - F.col("whole")))
    goal = F.round(F.col("target") - F.sum(F.col("whole") * F.col("words")).over(every)).cast("long")
    out = rows.select("key", "source", "n_rows", "source_size", "target", "whole", F.when(p > 1e-9, p).otherwise(0.0).alias("p"), goal.alias("goal"))
    return materialise(out, "mix-goals")


def _border(cells: DataFrame, place: str, goal: Column) -> DataFrame:
    """The range in which a source's running sum of words reaches its goal: own (the source), <place>, words before it."""
    run = F.sum("words").over(Window.partitionBy("source").orderBy(place))
    reach = cells.withColumn("run", run).where((F.col("run") > goal) & (F.col("run") - F.col("words") <= goal))
    return reach.groupBy(F.col("source").alias("own")).agg(F.min(place).alias(place), F.min(F.col("run") - F.col("words")).alias("before"))


def _ranked(sized: DataFrame, classes: DataFrame) -> DataFrame:
    """sized with what its class tells, and y, the rank r as r / (1 + r), in RANGES ranges (r1) and finer ones (r2)."""
    u, p = F.col("u"), F.col("p")
    # r = (u / (1 - u)) / (p / (1 - p)); without p there is no rank
    y = F.when(p > 0, u * (1 - p) / (u * (1 - p) + p * (1 - u)))
    out = join_per_key(sized, classes.drop("source"), "key", "n_rows").withColumn("y", y)
    return out.withColumn("r1", F.floor(F.col("y") * RANGES)).withColumn("r2", F.floor(F.col("y") * RANGES * RANGES))


def _mixed(docs: DataFrame, keep: list[Column], weights: Sequence[float], most: float, seed: int, cut: bool, priority: str | None) -> DataFrame:
    text = F.col("text").cast("string")
    size = F.size(words_of(text)).cast("long")
    given = F.lit(1.0) if priority is None else column(priority).try_cast("double")
    sized = docs.select(*keep, "doc_id", F.col("source").cast("string").alias("source"), size.alias("size"), F.xxhash64(text).alias("tie"), given.alias("given"))
    wanted = F.col("size") / (F.col("size") + float(HALF)) if priority is None else F.when((F.col("given") > 0) & (F.col("given") < float("inf")), F.col("given")).otherwise(1.0)
    step = F.round(F.log2(F.when(wanted > 0, wanted)) * CLASSES)
    place = F.coalesce(F.greatest(F.lit(-LOWEST * CLASSES), F.least(F.lit(LOWEST * CLASSES), step)).cast("int"), F.lit(-LOWEST * CLASSES))
    u = (F.pmod(F.xxhash64("doc_id", "tie", F.lit(seed)), F.lit(2**52)) + 0.5) / float(2**52)
    key = F.concat(place.cast("string"), F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")))
    sized = materialise(sized.select("*", place.alias("class"), u.alias("u"), key.alias("key")).drop("given"), "mix-sizes")

    classes = _classes(sized, weights, most)
    by_range = _ranked(sized, classes).where("y is not null").groupBy("source", "r1", "goal").agg(F.sum("size").alias("words"))
    coarse = _border(by_range, "r1", F.col("goal"))
    known = classes.join(coarse, F.col("source").eqNullSafe(F.col("own")), "left").select(classes["*"], F.col("r1").alias("b1"), F.coalesce("before", F.lit(0)).alias("before1"))
    known = materialise(known, "mix-coarse")
    cells = _ranked(sized, known).where("r1 = b1").groupBy("source", "r2", "goal", "before1").agg(F.sum("size").alias("words"))
    fine = _border(cells, "r2", F.col("goal") - F.col("before1"))
    done = known.join(fine, F.col("source").eqNullSafe(F.col("own")), "left").select(known["*"], F.col("r2").alias("b2"), F.coalesce("before", F.lit(0)).alias("before2"))
    done = materialise(done, "mix-fine")
    discard(classes, known)

    full = _ranked(sized, done)
    in_cell = F.coalesce((F.col("r1") == F.col("b1")) & (F.col("r2") == F.col("b2")), F.lit(False))
    # a source without a border cell is taken whole, as far as its goal goes
    inside = F.coalesce((F.col("r1") < F.col("b1")) | (F.col("r1") == F.col("b1")) & (F.col("r2") < F.col("b2")), F.col("goal") > 0)
    sure = full.where(~in_cell).withColumn("extra", F.when(inside & F.col("y").isNotNull(), F.col("size")).otherwise(0))
    run = F.sum("size").over(Window.partitionBy("source").orderBy("y", "doc_id", "tie").rowsBetween(Window.unboundedPreceding, -1))
    room = F.col("goal") - F.col("before1") - F.col("before2") - F.coalesce(run, F.lit(0))
    border = full.where(in_cell).withColumn("extra", F.greatest(F.lit(0), F.least(F.col("size"), room)))
    out = sure.unionByName(border)
    more = F.when(F.col("size") == 0, 0).when(2 * F.col("extra") >= F.col("size"), 1).otherwise(0)
    copies = (F.col("whole") + more).cast("long")
    taken = (F.col("whole") * F.col("size") + F.col("extra")).cast("long") if cut else copies * F.col("size")
    return out.withColumns({"taken": taken, "copies": copies})


def mix(docs: DataFrame, weights: Sequence[float] = (1, 2, 3), most: float = 3.0, seed: int = 17, cut: bool = True, priority: str | None = None) -> DataFrame:
    """What the mix takes of each document: doc_id, source, size, source_size, target, taken (words), copies, p.

    copies: whole copies, the border document's rounded; p: the inclusion probability beyond certain copies. Without cut,
    taken is copies * size. priority: the column by which documents are wanted, if any.
    """
    out = _mixed(docs, [], weights, most, seed, cut, priority)
    return out.select("doc_id", "source", "size", "source_size", "target", "taken", "copies", "p")


def mixed_documents(docs: DataFrame, weights: Sequence[float] = (1, 2, 3), most: float = 3.0, seed: int = 17, priority: str | None = None) -> DataFrame:
    """The documents, each as often as the mix takes it, whole, with all their columns. A row travels with its size, so
    no join by its values is needed."""
    plan = _mixed(docs, [whole_row(docs).alias("row")], weights, most, seed, False, priority).where("copies > 0")
    return plan.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("row.*")
