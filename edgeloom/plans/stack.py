"""Analyses as programs: what happens for every accepted edge, compiled to one DataFrame plan.

A program is written against an Edge and records steps; nothing runs until the stack is compiled:

    def body(edge):
        both = edge.common()                                   # every common neighbour
        edge.increment("triangles", both.vertex, 1, over=both)
        edge.increment("triangles", edge.start, both.count())
        edge.increment("triangles", edge.end, both.count())
    triangles = Analysis("triangles", body)

What a program can say:

* `edge.start`, `edge.end`, and any arithmetic on columns; Python's own names are a program's locals, `edge.local()` makes
  one that can be assigned within a condition;
* `edge.neighbours(vertex)`: the neighbours that any vertex had before this edge; a loop over them has neighbours in turn;
  `edge.common()`: two such loops that meet in one vertex, as one join;
* `loop.count()`, `loop.total(value)`: what a local that a loop adds to holds afterwards; a value like any other;
* `edge.get(result, vertex)`: a required analysis' result as it stands at this point of the program;
* `edge.increment(result, vertex, delta, over=loop)`, `edge.put(result, vertex, value, over=loop)`: the last put stays;
* `edge.when(condition, then, otherwise)`.

A step becomes rows (pos, vid, result, delta), a put rows (pos, vid, result, step, value). Steps over the same rows share
one pass: their deltas are an array that is exploded once. A loop becomes an equi-join on the vertex, with the as-of
condition "arrived before this edge" as a residual; a loop over the ends' neighbours that only counts becomes a running
sum, so a hub doesn't make the square of its degree. A get becomes a running sum of the required result's deltas and the
questions asked of it. Results are sums of deltas, so partial sums are combined before the shuffle.

The same program runs over a whole stream (run) or over one batch on what earlier batches left (see streaming.replay):
Surroundings tells where edges, neighbours, triangles and earlier results come from.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edgeloom.functions.values import div
from edgeloom.operators import graph as G
from edgeloom.sources.shared import materialise

Value = Column | int
#: Where a batch's questions find the results of earlier batches.
BEFORE = -1
NO_DELTAS, NO_PUTS = "pos long, vid long, result string, delta long", "pos long, vid long, result string, step int, value long"


def _column(x: Value) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


@dataclass(frozen=True)
class Loop:
    """Vertices that an edge's program visits: column `name` of its rows. of: whose neighbours they are (None: common ones)."""

    name: str
    of: Column | None
    end: str | None = None
    outer: Loop | None = None
    condition: Column | None = None

    @property
    def vertex(self) -> Column:
        return F.col(self.name)

    def where(self, condition: Column) -> Loop:
        return Loop(self.name, self.of, self.end, self.outer, condition if self.condition is None else self.condition & condition)

    def neighbours(self) -> Loop:
        """The neighbours, before this edge, of every vertex of this loop."""
        return Loop(f"{self.name}_n", self.vertex, None, self)

    def count(self) -> Total:
        return Total(self, 1)

    def total(self, value: Value) -> Total:
        return Total(self, value)

    def __str__(self) -> str:
        return "common neighbours" if self.of is None else f"neighbours of {self.end or self.of}"


@dataclass(frozen=True)
class Total:
    """The sum of a value over a loop."""

    loop: Loop
    value: Value


@dataclass(frozen=True)
class Get:
    """A question: the result at a vertex, as column `name`."""

    name: str
    result: str
    vertex: Column


@dataclass
class Step:
    result: str
    target: Column
    value: Column
    put: bool
    over: Loop | None
    condition: Column | None
    constant: int | None = None


class Local:
    """A value that may be assigned, also within a condition; outside of it the old one stays."""

    def __init__(self, edge: Edge, value: Value):
        self._edge, self.value = edge, _column(value)

    def set(self, value: Value) -> None:
        condition = self._edge._condition()
        self.value = _column(value) if condition is None else F.when(condition, _column(value)).otherwise(self.value)


@dataclass
class Edge:
    """One accepted edge, in arrival order of its ends."""

    steps: list[Step] = field(default_factory=list)
    totals: dict[str, Total] = field(default_factory=dict)
    gets: list[Get] = field(default_factory=list)
    prefix: str = "x"
    _conditions: list[Column] = field(default_factory=list)
    start = property(lambda self: F.col("src"))
    end = property(lambda self: F.col("dst"))

    def neighbours(self, of: str | Column) -> Loop:
        """Neighbours that a vertex (`start`, `end` or any value) had before this edge."""
        if isinstance(of, str):
            if of not in ("start", "end"):
                raise ValueError("neighbours of start, end or a vertex value")
            return Loop("nbr", F.col("src" if of == "start" else "dst"), of)
        return Loop("nbr", of)

    def common(self) -> Loop:
        return Loop("nbr", None)

    def local(self, value: Value) -> Local:
        return Local(self, value)

    def value(self, x: Value | Total) -> Column:
        """A total as a value that conditions and arithmetic can use."""
        if not isinstance(x, Total):
            return _column(x)
        name = f"{self.prefix}_total{len(self.totals)}"
        self.totals[name] = x
        return F.coalesce(F.col(name), F.lit(0))

    def get(self, result: str, vertex: Column) -> Column:
        """A required result at a vertex of the edge, 0 where it has none yet."""
        self.gets.append(Get(f"{self.prefix}_get{len(self.gets)}", result, vertex))
        return F.coalesce(F.col(self.gets[-1].name), F.lit(0))

    def _condition(self) -> Column | None:
        return reduce(lambda a, b: a & b, self._conditions) if self._conditions else None

    def _step(self, result: str, target: Column | Loop, value: Value | Total, put: bool, over: Loop | None) -> None:
        if isinstance(target, Loop):
            target, over = target.vertex, target
        if over is not None and isinstance(value, Total):
            raise ValueError("a loop's total is known only after the loop")
        self.steps.append(Step(result, target, self.value(value), put, over, self._condition(), value if isinstance(value, int) else None))

    def increment(self, result: str, target: Column | Loop, delta: Value | Total, over: Loop | None = None) -> None:
        """Adds to the result of a vertex; over: for each vertex of a loop (a loop as target: to each of its vertices)."""
        self._step(result, target, delta, False, over)

    def put(self, result: str, target: Column | Loop, value: Value | Total, over: Loop | None = None) -> None:
        """Sets the result of a vertex; the latest edge's last step stays."""
        self._step(result, target, value, True, over)

    def when(self, condition: Column, then: Callable[[Edge], None], otherwise: Callable[[Edge], None] | None = None) -> None:
        for c, body in ((condition, then), (~condition, otherwise)):
            if body:
                self._conditions.append(c)
                body(self)
                self._conditions.pop()


@dataclass(frozen=True)
class Analysis:
    """on_edge records a program; put maps final results to a value. requires: analyses that must be enabled too."""

    name: str
    on_edge: Callable[[Edge], None] | None = None
    put: Callable[[dict[str, Column]], Column] | None = None
    requires: tuple[str, ...] = ()


@dataclass
class Surroundings:
    """What programs see. edges (pos, src, dst): accepted, to be worked off; known (vid, nbr, arrived): neighbours by all
    edges so far, these included; closed (pos, src, dst, nbr): their common neighbours before them; earlier (vid, result,
    value): results of earlier batches, None if there are none."""

    edges: DataFrame
    known: DataFrame
    closed: Callable[[], DataFrame]
    earlier: DataFrame | None = None


def opposite(t: DataFrame) -> DataFrame:
    """Triangles (p, q, r) with the edge (pos, src, dst) that closes each -> (pos, src, dst, nbr), the third corner."""
    third = [F.when((F.col(x) != F.col("src")) & (F.col(x) != F.col("dst")), F.col(x)) for x in "pqr"]
    return t.select("pos", "src", "dst", F.coalesce(*third).alias("nbr"))


def surroundings(edges: DataFrame) -> Surroundings:
    """Those of a whole stream (pos, src, dst). The simple graph is written once; every step reads it."""
    keyed = edges.where("src <> dst").groupBy(F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v")).agg(F.min(F.struct("pos", "src", "dst")).alias("e"))
    c = materialise(keyed.select("u", "v", "e.*"), "simple-graph")
    accepted = c.select("pos", "src", "dst")
    known = G.symmetric(c).select("vid", "nbr", F.col("pos").alias("arrived"))

    def closed() -> DataFrame:
        t = G.triangles(c.select("u", "v", "pos")).withColumnRenamed("done_pos", "pos").join(accepted, "pos")
        return materialise(opposite(t), "closed")

    return Surroundings(accepted, known, closed)


class Stack:
    """Enabled analyses, in an order in which requirements come first."""

    def __init__(self, *analyses: Analysis):
        names = [a.name for a in analyses]
        if len(set(names)) < len(names):
            raise ValueError("an analysis is enabled twice")
        left, self.analyses = list(analyses), []
        for a in analyses:
            if missing := set(a.requires) - set(names):
                raise ValueError(f"{a.name} requires {', '.join(sorted(missing))}")
        while left:
            ready = [a for a in left if set(a.requires) <= {x.name for x in self.analyses}]
            if not ready:
                raise ValueError("requirements go in a circle")
            self.analyses += ready
            left = [a for a in left if a not in ready]
        self.programs: list[tuple[Analysis, Edge]] = []
        for i, a in enumerate(self.analyses):
            if a.on_edge:
                a.on_edge(edge := Edge(prefix=f"x{i}"))
                if other := {s.result for s in edge.steps} - {a.name, *a.requires}:
                    raise ValueError(f"{a.name} writes {', '.join(sorted(other))} without requiring it")
                if other := {g.result for g in edge.gets} - set(a.requires):
                    raise ValueError(f"{a.name} reads {', '.join(sorted(other))} without requiring it")
                self.programs.append((a, edge))
        self.steps = [s for _, edge in self.programs for s in edge.steps]
        self.counted = list(dict.fromkeys(s.result for s in self.steps if not s.put))
        self.written = list(dict.fromkeys(s.result for s in self.steps if s.put))
        if both := set(self.counted) & set(self.written):
            raise ValueError(f"{', '.join(sorted(both))} is both put and incremented")
        self.asked = asked = {g.result for _, edge in self.programs for g in edge.gets}
        if late := asked & set(self.written):
            raise ValueError(f"{', '.join(sorted(late))} is put, and only sums can be read within a program")
        for i, (a, edge) in enumerate(self.programs):
            for g in edge.gets:
                if any(s.result == g.result for _, later in self.programs[i:] for s in later.steps):
                    raise ValueError(f"{a.name} reads {g.result}, which it or a later analysis changes")

    def explain(self) -> str:
        """The recorded program."""
        lines = []
        for s in self.steps:
            where = f" if {s.condition}" if s.condition is not None else ""
            each = f" for each of {s.over}" if s.over is not None else ""
            lines.append(f"{s.result}[{s.target}] {':=' if s.put else '+='} {s.value}{each}{where}")
        return "\n".join(lines + [f"{a.name} := f({', '.join(a.requires)})" for a in self.analyses if a.put])

    def compiled(self, around: Surroundings) -> tuple[DataFrame, DataFrame]:
        """Deltas (pos, vid, result, delta) and puts (pos, vid, result, step, value) of the edges."""
        spark = around.edges.sparkSession
        deltas: list[DataFrame] = []
        puts: list[DataFrame] = []
        closed: list[DataFrame] = []

        def rows(loop: Loop | None, base: DataFrame) -> DataFrame:
            """The rows of a loop within the rows of base, which has a row for each edge."""
            if loop is None:
                return base
            if loop.of is None:
                if not closed:
                    closed.append(around.closed())
                more = [c for c in base.columns if c not in ("pos", "src", "dst")]
                out = closed[0].join(base.select("pos", *more), "pos") if more else closed[0]
                out = out.withColumnRenamed("nbr", loop.name)
            else:
                outer = rows(loop.outer, base)
                known = around.known.select(F.col("vid").alias("_vid"), F.col("nbr").alias(loop.name), "arrived")
                out = outer.join(known, (loop.of == F.col("_vid")) & (F.col("arrived") < F.col("pos"))).drop("_vid", "arrived")
            return out if loop.condition is None else out.where(loop.condition)

        def counted(loop: Loop, base: DataFrame) -> DataFrame | None:
            """(pos, n) of a loop over an end's neighbours that only counts them, or those that meet a condition on themselves."""
            if loop.end is None or loop.outer is not None or around.earlier is not None:
                return None
            counts = F.lit(1)
            if loop.condition is not None:
                try:  # does the condition know the neighbour only?
                    around.known.select(F.col("nbr").alias(loop.name)).where(loop.condition).schema  # noqa: B018
                except AnalysisException:
                    return None
                counts = F.when(loop.condition, 1).otherwise(0)
            own = around.known.withColumnRenamed("nbr", loop.name).select("vid", F.col("arrived").alias("pos"), counts.cast("long").alias("n"))
            run = G.running_sums(own, ["n"], unique=True)
            before = run.select(F.col("vid").alias("_vid"), F.col("pos").alias("_pos"), (F.col("n") - F.col("d_n")).alias("n")).where("n > 0")
            return base.join(before, (loop.of == F.col("_vid")) & (F.col("pos") == F.col("_pos"))).select("pos", "n")

        def passed(loop: Loop) -> DataFrame:
            """(pos, vid, n) for a loop over an end's neighbours: each neighbour is met by the n edges that come to the end
            after it; pos: its own arrival."""
            comes = around.edges.select(loop.of.alias("vid"), "pos", F.lit(1).cast("long").alias("delta"))
            asked = around.known.select("vid", F.col("arrived").alias("pos"), F.lit(0).cast("long").alias("delta"))
            run = G.running_sum(comes.union(asked))
            until = run.select(F.col("vid").alias("_vid"), F.col("pos").alias("_pos"), "value")
            out = around.known.join(until, (F.col("vid") == F.col("_vid")) & (F.col("arrived") == F.col("_pos")))
            return out.join(comes.groupBy("vid").agg(F.count("*").alias("all")), "vid").select(F.col("arrived").alias("pos"), F.col("nbr").alias("vid"), (F.col("all") - F.col("value")).alias("n")).where("n > 0")

        def plain(s: Step) -> bool:
            """Does a step only add a constant to an end's neighbours, and nothing asks when?"""
            return not s.put and s.over is not None and s.over.end is not None and s.over.outer is None and s.over.condition is None and s.condition is None and s.constant is not None and s.result not in self.asked and str(s.target) == str(s.over.vertex) and around.earlier is None

        def answers(edge: Edge, base: DataFrame) -> DataFrame:
            """(pos, a column for each get): one pass of running sums for all questions of a program."""
            sides = {str(g.vertex): (f"_at{i}", g.vertex) for i, g in enumerate(edge.gets)}
            sums = {r: f"_sum{i}" for i, r in enumerate(dict.fromkeys(g.result for g in edge.gets))}
            flags, zero = [name for name, _ in sides.values()], F.lit(0).cast("long")
            nothing = [zero.alias(x) for x in flags]
            asked = F.array(*[F.struct(v.cast("long").alias("vid"), *[F.lit(int(x == name)).cast("long").alias(x) for x in flags]) for name, v in sides.values()])
            every = [base.select("pos", F.explode(asked).alias("q")).select("q.vid", "pos", *[zero.alias(x) for x in sums.values()], *[F.col(f"q.{x}").alias(x) for x in flags])]
            told = [(d, F.col("pos"), F.col("delta")) for d in deltas]
            if around.earlier is not None:
                told.append((around.earlier, F.lit(BEFORE).cast("long"), F.col("value")))
            for d, pos, value in told:
                every.append(d.where(F.col("result").isin(*sums)).select("vid", pos.alias("pos"), *[F.when(F.col("result") == r, value).otherwise(zero).alias(x) for r, x in sums.items()], *nothing))
            run = G.running_sums(materialise(reduce(DataFrame.unionByName, every), "asked"), [*sums.values(), *flags])
            here = run.where(reduce(lambda a, b: a | b, [F.col(f"d_{x}") > 0 for x in flags]))
            return here.groupBy("pos").agg(*[F.max(F.when(F.col(f"d_{sides[str(g.vertex)][0]}") > 0, F.col(sums[g.result]))).alias(g.name) for g in edge.gets])

        for number, (_, edge) in enumerate(self.programs):
            base = around.edges
            for s in filter(plain, edge.steps):
                deltas.append(passed(s.over).select("pos", "vid", F.lit(s.result).alias("result"), (F.col("n") * s.constant).alias("delta")))
            if edge.gets:
                base = base.join(answers(edge, base), "pos", "left")
            for name, total in edge.totals.items():
                n = counted(total.loop, base) if isinstance(total.value, int) else None
                if n is not None:
                    sums = n.select("pos", (F.col("n") * total.value).alias(name))
                else:
                    sums = rows(total.loop, base).groupBy("pos").agg(F.sum(_column(total.value).cast("long")).alias(name))
                base = base.join(sums, "pos", "left")
            # steps over the same rows are one pass
            groups: dict[str, list[tuple[int, Step]]] = {}
            for k, s in ((k, s) for k, s in enumerate(edge.steps) if not plain(s)):
                groups.setdefault(str(s.over and (s.over.name, str(s.over), str(s.over.condition), str(s.over.outer))), []).append((k, s))
            for some in groups.values():
                source = rows(some[0][1].over, base)
                for put in (False, True):
                    own = [F.struct(F.lit(number * 1000 + k).alias("step"), s.target.cast("long").alias("vid"), F.lit(s.result).alias("result"), F.when(F.lit(True) if s.condition is None else s.condition, s.value.cast("long")).alias("value")) for k, s in some if s.put == put]
                    if not own:
                        continue
                    out = source.select("pos", F.explode(F.array(*own)).alias("s")).select("pos", "s.vid", "s.result", "s.step", "s.value").where("value is not null")
                    (puts if put else deltas).append(out if put else out.select("pos", "vid", "result", F.col("value").alias("delta")).where("delta <> 0"))
        empty = lambda schema: spark.createDataFrame([], schema)
        return reduce(DataFrame.unionByName, deltas) if deltas else empty(NO_DELTAS), reduce(DataFrame.unionByName, puts) if puts else empty(NO_PUTS)

    def deltas(self, edges: DataFrame) -> DataFrame:
        """(pos, vid, result, delta) of a stream of edges (pos, src, dst)."""
        return self.compiled(surroundings(edges))[0]

    def table(self, vertices: DataFrame, sums: DataFrame, last: DataFrame) -> DataFrame:
        """vid and a column for each analysis. sums (vid, result, value): of deltas; last: the puts that stayed."""
        out = vertices
        for rows, names in ((sums, self.counted), (last, self.written)):
            if names:
                wide = rows.groupBy("vid").agg(*[F.sum(F.when(F.col("result") == r, F.col("value"))).cast("long").alias(r) for r in names])
                out = out.join(wide, "vid", "left")
        out = out.select("vid", *[F.coalesce(r, F.lit(0)).cast("long").alias(r) for r in self.counted], *self.written)
        for a in self.analyses:
            if a.put:
                out = out.withColumn(a.name, a.put({r: F.col(r) for r in a.requires}))
        return out

    def run(self, edges: DataFrame) -> DataFrame:
        """vid and a column for each analysis, for every vertex of the simple graph: sums (0 at least), what was put (null
        if nothing was), and values of final results."""
        around = surroundings(edges)
        deltas, puts = self.compiled(around)
        sums = deltas.groupBy("vid", "result").agg(F.sum("delta").alias("value"))
        last = puts.groupBy("vid", "result").agg(F.max_by("value", F.struct("pos", "step")).alias("value"))
        return self.table(around.known.select("vid").distinct(), sums, last)


def _degree(edge: Edge) -> None:
    edge.increment("degree", edge.start, 1)
    edge.increment("degree", edge.end, 1)


def _triangles(edge: Edge) -> None:
    both = edge.common()
    edge.increment("triangles", both.vertex, 1, over=both)
    found = edge.value(both.count())
    edge.increment("triangles", edge.start, found)
    edge.increment("triangles", edge.end, found)


def _touched(edge: Edge) -> None:
    for vertex in (edge.start, edge.end):
        degree, triangles = edge.get("degree", vertex), edge.get("triangles", vertex)
        ways = edge.local(degree * (degree - 1))
        edge.when(ways.value > 0, lambda e, v=vertex, t=triangles, w=ways: e.put("cc_touched", v, div(t * 100, F.when(w.value > 0, w.value))))


DEGREE = Analysis("degree", _degree)
TRIANGLES = Analysis("triangles", _triangles)
CLUSTERING = Analysis("cc", put=lambda r: G.coefficient(r["degree"], r["triangles"]), requires=("degree", "triangles"))
#: The coefficient of both ends as every edge leaves it; it isn't renewed when a triangle closes opposite a vertex.
TOUCHED = Analysis("cc_touched", _touched, requires=("degree", "triangles"))
