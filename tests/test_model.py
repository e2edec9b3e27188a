"""The set-based operators against a sequential model of arrival, edge by edge."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from edgeloom import cli, model
from edgeloom.functions import values as V
from edgeloom.operators import batches as B
from edgeloom.operators import graph as G
from edgeloom.plans.stack import CLUSTERING, DEGREE, TOUCHED, TRIANGLES, Analysis, Stack
from edgeloom.sources import graphs as S
from edgeloom.streaming.replay import Replay


def arrive(edges, size):
    """Degree, triangles and last-touch coefficient, affected vertices by batch."""
    near, deg, tri, cc, affected = defaultdict(set), defaultdict(int), defaultdict(int), {}, set()
    for k, (a, b) in enumerate(edges):
        if a == b or b in near[a]:
            continue
        both = near[a] & near[b]
        for v in (a, b):
            deg[v] += 1
            tri[v] += len(both)
        for v in both:
            tri[v] += 1
        for v in (a, b):
            cc[v] = tri[v] * 100 // (deg[v] * (deg[v] - 1)) if deg[v] > 1 else None
        affected |= {(k // size, v) for v in (a, b, *both)}
        near[a].add(b)
        near[b].add(a)
    return dict(deg), {v: tri[v] for v in deg}, cc, affected


def frame(spark, edges):
    return spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(edges)], model.EDGES)


def results(df, *names):
    return [{r.vid: r[n] for r in df.collect()} for n in names]


CASES = [[], [(7, 7)], [(1, 2), (2, 1), (1, 2)], [(0, 1), (1, 2), (0, 2)], [(0, 2**40), (2**40, 5), (5, 0), (5, 5)]] + [[(r.randrange(12), r.randrange(12)) for _ in range(60)] for r in map(random.Random, range(3))]


@pytest.mark.parametrize("edges", CASES, ids=range(len(CASES)))
def test_like_the_sequential_model(spark, edges, monkeypatch):
    monkeypatch.setattr(G, "RUN", 16)
    deg, tri, cc, affected = arrive(edges, 10)
    c = G.canonical(frame(spark, edges))
    assert results(G.triangle_count(c), "degree", "triangles") == [deg, tri]
    assert results(G.clustering_last_touch(c), "cc") == [cc]
    assert {(r.batch_id, r.vid) for r in B.changes(c, 10).collect()} == affected
    found = Stack(CLUSTERING, TOUCHED, TRIANGLES, DEGREE).run(frame(spark, edges)).collect()
    assert [{r.vid: r[n] for r in found} for n in ("degree", "triangles", "cc_touched")] == [deg, tri, cc]
    runs = defaultdict(dict)
    for r in G.running_degree(c).collect():
        runs[r.vid][r.pos] = r.value
    assert all([v for _, v in sorted(x.items())] == list(range(1, deg[vid] + 1)) for vid, x in runs.items())


def test_a_batch_that_runs_again_changes_nothing(spark, tmp_path):
    edges = CASES[-1]
    deg, tri, _, affected = arrive(edges, 20)
    state = Replay(spark, str(tmp_path))
    rows = frame(spark, edges)
    for k in (0, 1, 1, 2, 2):
        state.batch(rows.where((F.col("pos") >= 20 * k) & (F.col("pos") < 20 * k + 20)), k)
    got = [{r.vid: r[n] for r in state.results().collect()} for n in ("degree", "triangles")]
    assert got == [deg, tri]
    assert {(r.batch_id, r.vid) for r in state.affected().collect()} == affected


def test_generators(spark):
    c = G.canonical(S.rectangle(spark, 4, 5).withColumn("pos", F.monotonically_increasing_id()))
    deg, tri = results(G.triangle_count(c), "degree", "triangles")
    assert len(deg) == 20 and sum(tri.values()) == 3 * 24 and (deg[6], tri[6]) == (6, 6) and (deg[0], tri[0], tri[4]) == (3, 2, 1)
    assert S.complete(spark, 6).count() == 15 and S.complete(spark, 6, True).count() == 36


def test_floor_div(spark):
    pairs = [(-7, 2), (7, -2), (7, 2), (-7, -2), (6, 3), (-6, 3), (5, 0), (0, 4), (2**62, 3), (-(2**62), 3)]
    df = spark.createDataFrame(pairs, "a long, b long").select("a", "b", V.floor_div(F.col("a"), F.col("b")).alias("q"))
    assert all(r.q == (r.a // r.b if r.b else None) for r in df.collect())


def test_set_and_map_functions(spark):
    df = spark.range(1).select(F.array(*map(F.lit, (1, 3, 5))).alias("a"), F.array(*map(F.lit, (3, 4, 5, 6))).alias("b"))
    a, b = F.col("a"), F.col("b")
    m, n = V.map_from_set(a, F.lit(10)), V.map_from_set(b, F.lit(1))
    add = lambda x, y: x + y
    r = df.select(
        V.set_union(a, b).alias("u"), V.set_intersection(a, b).alias("i"), V.set_difference(a, b).alias("d"), V.is_subset(a, b).alias("s"), V.is_proper_subset(F.array(F.lit(3)), a).alias("p"),
        V.insert(a, F.lit(2)).alias("ins"), V.delete(a, F.lit(3)).alias("del"), V.split(a, F.lit(3)).alias("sp"), V.fold(a, F.lit(0), add).alias("f"), V.map_union_with(m, n, add).alias("mu"),
        V.map_intersection_with(m, n, add).alias("mi"), V.map_difference(m, n).alias("md"), V.map_adjust(m, F.lit(3), lambda x: x * 2).alias("ma"), V.map_insert_with(m, F.lit(3), F.lit(7), lambda new, old: new - old).alias("mw"), V.find_with_default(m, F.lit(9), F.lit(0)).alias("fd"),
    ).first()
    assert (r.u, r.i, r.d, r.s, r.p) == ([1, 3, 4, 5, 6], [3, 5], [1], False, True)
    assert (r.ins, r["del"], r.sp.below, r.sp.found, r.sp.above, r.f) == ([1, 2, 3, 5], [1, 5], [1], True, [5], 9)
    assert (r.mu, r.mi, r.md) == ({1: 10, 3: 11, 5: 11, 4: 1, 6: 1}, {3: 11, 5: 11}, {1: 10})
    assert (r.ma, r.mw, r.fd) == ({1: 10, 3: 20, 5: 10}, {1: 10, 3: -3, 5: 10}, 0)


def test_stack_refuses_what_it_cannot_run():
    with pytest.raises(ValueError, match="requires degree"):
        Stack(CLUSTERING, TRIANGLES)
    with pytest.raises(ValueError, match="circle"):
        Stack(Analysis("a", requires=("b",)), Analysis("b", requires=("a",)))
    with pytest.raises(ValueError, match="without requiring"):
        Stack(Analysis("a", lambda e: e.increment("b", e.start, 1)))
    with pytest.raises(ValueError, match="twice"):
        Stack(DEGREE, DEGREE)
    with pytest.raises(ValueError, match="both put and incremented"):
        Stack(Analysis("a", lambda e: (e.put("a", e.start, 1), e.increment("a", e.end, 1))))
    with pytest.raises(ValueError, match="reads degree without"):
        Stack(DEGREE, Analysis("a", lambda e: e.put("a", e.start, e.get("degree", e.start))))
    with pytest.raises(ValueError, match="later analysis changes"):
        Stack(DEGREE, Analysis("a", lambda e: e.put("a", e.start, e.get("degree", e.start)), requires=("degree",)), Analysis("b", lambda e: e.increment("degree", e.start, 1), requires=("a", "degree")))
    assert "for each of common neighbours" in Stack(DEGREE, TRIANGLES).explain()


def test_arguments():
    assert cli.arguments(["-fname=x", "-batch=5"]) == {"fname": "x", "batch": 5, "nodes": 1, "processes": 1}
    for bad in ([], ["-batch=5"], ["-fname=x", "-batch=no"], ["-fname=x", "-other=1"]):
        with pytest.raises(SystemExit):
            cli.arguments(bad)


def test_a_stack_batch_by_batch(spark, tmp_path):
    edges = CASES[-1]
    deg, tri, cc, affected = arrive(edges, 20)
    stack = Stack(TOUCHED, TRIANGLES, DEGREE, Analysis("met", lambda e: e.increment("met", e.neighbours("start"), 1)))
    state = Replay(spark, str(tmp_path), stack)
    rows = frame(spark, edges)
    for k in (0, 1, 1, 2):
        state.batch(rows.where((F.col("pos") >= 20 * k) & (F.col("pos") < 20 * k + 20)), k)
    found = state.results().collect()
    assert [{r.vid: r[n] for r in found} for n in ("degree", "triangles", "cc_touched")] == [deg, tri, cc]
    assert {r.vid: r.met for r in found} == {r.vid: r.met for r in stack.run(rows).collect()}


def test_programs_with_loops_locals_and_conditions(spark):
    edges = CASES[-2]

    def body(e):
        near = e.neighbours("end")
        small = e.local(0)
        e.when(e.value(near.count()) < 3, lambda e: small.set(1))
        e.increment("a", e.start, small.value)
        of = e.neighbours(e.start + 1)
        e.increment("a", of.vertex, of.vertex, over=of)
        two = near.where(near.vertex != e.start).neighbours()
        e.put("b", two.vertex, e.start * 100 + e.end, over=two)

    got = Stack(Analysis("a", lambda e: body(e), requires=("b",)), Analysis("b")).run(frame(spark, edges)).collect()
    near, a, b = defaultdict(set), defaultdict(int), {}
    for x, y in edges:
        if x == y or y in near[x]:
            continue
        a[x] += len(near[y]) < 3
        for v in near[x + 1] if x + 1 in near else ():
            a[v] += v
        for v in near[y] - {x}:
            for w in near[v]:
                b[w] = x * 100 + y
        near[x].add(y)
        near[y].add(x)
    assert {r.vid: r.a for r in got} == {v: a[v] for v in near if near[v]}
    assert {r.vid: r.b for r in got} == {v: b.get(v) for v in near if near[v]}


def test_stack_plan_has_few_scans(spark):
    plan = Stack(CLUSTERING, TRIANGLES, DEGREE).run(frame(spark, CASES[-1]))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") <= 14 and plan.count("Exchange hashpartitioning") <= 16


def test_library_of_sets_and_maps(spark):
    df = spark.range(1).select(F.array(*map(F.lit, (1, 3, 5))).alias("a"), F.array(*map(F.lit, (3, 4))).alias("b"), F.from_json(F.lit('{"3": 30, "1": 10, "5": 50}'), "map<string,bigint>").alias("raw"))
    df = df.select("a", "b", F.map_from_entries(F.transform(F.map_entries("raw"), lambda e: F.struct(e["key"].cast("int").alias("key"), e["value"].alias("value")))).alias("m"))
    a, m, three, nine = F.col("a"), F.col("m"), F.lit(3), F.lit(9)
    rows = F.array(*[F.struct(F.lit(k).alias("key"), F.lit(v).cast("long").alias("value")) for k, v in ((5, 1), (3, 2), (5, 3))])
    is_two = lambda x: F.when(x.isNull(), F.lit(2).cast("long"))
    add = lambda x, y: x + y
    r = df.select(
        V.partition(a, lambda x: x > 2).alias("part"), V.min_view(a).alias("mn"), V.max_view(a).alias("mx"), V.delete_min(a).alias("dmin"), V.delete_max(F.array().cast("array<int>")).alias("dmax"), V.set_map(a, lambda x: x % 2).alias("img"),
        V.unions(F.array(a, F.col("b"))).alias("us"), V.compare(a, F.col("b")).alias("cmp"), V.show_set(a).alias("show"), V.show_map(m).alias("showm"), V.from_list(rows).alias("fl"), V.from_list_with(rows, lambda n, o: n * 10 + o).alias("flw"),
        V.map_maybe(m, lambda k, v: F.when(v > 10, v + k)).alias("maybe"), V.map_either(m, lambda k, v: k < 3, lambda k, v: v, lambda k, v: -v).alias("either"), V.map_partition(m, lambda k, v: v > 10).alias("mp"), V.split_lookup(m, three).alias("sl"),
        V.map_insert(m, nine, F.lit(90).cast("long")).alias("mi"), V.insert_lookup_with(m, three, F.lit(1).cast("long"), add).alias("il"), V.alter(m, nine, is_two).alias("al"), V.alter(m, three, is_two).alias("al2"), V.update(m, three, lambda v: F.when(v > 99, v)).alias("up"),
        V.update_lookup(m, three, lambda v: v + 1).alias("ul"), V.map_difference_with(m, V.map_from_set(F.col("b"), F.lit(7).cast("long")), lambda x, y: F.when(x > 99, x)).alias("dw"), V.is_submap(V.map_delete(m, three), m).alias("sub"), V.is_proper_submap(m, m).alias("psub"),
        V.map_min_view(m).alias("mmin"), V.map_max_view(m).alias("mmax"), V.map_accum(m, F.lit(0).cast("long"), lambda s, k, v: (s + v, s)).alias("acc"), V.map_fold(m, F.lit("").cast("string"), lambda s, k, v: F.concat(s, k.cast("string"))).alias("fold"),
        V.keys_set(m).alias("ks"), V.unions_with(F.array(m, m, m), add).alias("uw"), V.union_with_set_value(m, F.col("b"), F.lit(1).cast("long"), add).alias("usv"), V.subtract_all(m, F.col("b")).alias("sa"), V.map_values(m, lambda k, v: v - k).alias("mv"), V.lookup(m, nine).alias("lk"),
    ).first()
    assert (list(r.part.yes), list(r.part.no), r.mn.first, r.mn.rest, r.mx.first, r.dmin, r.dmax, r.img) == ([3, 5], [1], 1, [3, 5], 5, [3, 5], [], [1])
    assert (r.us, r["cmp"], r.show, r.showm) == ([1, 3, 4, 5], -1, "fromList [1,3,5]", "fromList [(1,10),(3,30),(5,50)]")
    assert (r.fl, r.flw, r.maybe) == ({3: 2, 5: 3}, {5: 31, 3: 2}, {3: 33, 5: 55})
    assert (r.either.left, r.either.right, r.mp.yes, r.mp.no) == ({1: 10}, {3: -30, 5: -50}, {3: 30, 5: 50}, {1: 10})
    assert (r.sl.below, r.sl.found, r.sl.above) == ({1: 10}, 30, {5: 50})
    assert (r.mi[9], r.il.old, r.il["map"][3], r.al[9], r.al2, r.up) == (90, 30, 31, 2, {1: 10, 5: 50}, {1: 10, 5: 50})
    assert (r.ul.value, r.ul["map"][3], r.dw, r.sub, r.psub) == (31, 31, {1: 10, 5: 50}, True, False)
    assert (r.mmin.first.key, r.mmin.rest, r.mmax.first.key, r.acc.state, r.acc["map"], r.fold) == (1, {3: 30, 5: 50}, 5, 90, {1: 0, 3: 10, 5: 40}, "135")
    assert (r.ks, r.uw, r.usv, r.sa, r.mv, r.lk) == ([1, 3, 5], {1: 30, 3: 90, 5: 150}, {1: 10, 3: 31, 5: 50, 4: 1}, {1: 10, 5: 50}, {1: 9, 3: 27, 5: 45}, None)


def test_binary_files_in_several_parts(spark, tmp_path):
    import struct

    want = []
    for f in range(3):
        own = [(f * 1000 + k, -k) for k in range(70000 if f == 1 else 5)]
        (tmp_path / f"{f}.bin").write_bytes(b"".join(struct.pack("<qq", *e) for e in own))
        want += own
    got = sorted((r.pos, r.src, r.dst) for r in S.read_binary(spark, str(tmp_path)).collect())
    assert got == [(k, *e) for k, e in enumerate(want)]
    assert S.binary_edge_count(spark, str(tmp_path)).first().n == len(want)


def test_report(spark, capsys):
    r = cli.report(frame(spark, CASES[-1]), batch=10, tail=25)
    deg, tri, _, _ = arrive(CASES[-1], 10)
    assert (r["edges"], r["batches"], r["vertices"], r["triangles"], r["tail"]) == (60, 6, len(deg), sum(tri.values()) // 3, 30)
    assert B.tail_threshold(100, 80000) == -80000 and B.tail_threshold(123456) == 43000


def test_a_rewritten_table_is_read_again(spark, tmp_path):
    made = []
    for n in (3, 5):
        spark.range(n).write.mode("overwrite").parquet(f"{tmp_path}/lineitem.parquet")
        made.append(S.ingest(spark, str(tmp_path), "x", lambda n=n: spark.range(n)).count())
    assert made == [3, 5]


def test_shared_folder_is_asked_for_off_local_mode(spark, monkeypatch):
    from edgeloom.sources import shared

    assert shared.new_path(spark, "x").startswith("file:/")
    monkeypatch.setattr(shared, "is_local", lambda s: False)
    monkeypatch.setattr(shared, "_configured", lambda s: None)
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared.shared_dir(spark)


def test_tables_are_deleted(spark):
    import os

    from edgeloom.sources import shared

    table = shared.materialise(spark.range(3), "gone")
    path = shared._written[table].removeprefix("file:")
    assert os.path.isdir(path)
    shared.discard(table)
    assert not os.path.exists(path)


def test_wedges_are_not_dealt_and_closed_in_buckets(spark, monkeypatch):
    from edgeloom.operators import closing

    monkeypatch.setattr(closing, "MOST_HELD", 7)
    r = random.Random(5)
    # ids whose hashed keys need all 64 bits, and a hub
    ids = [0, -3, 2**40, 2**62, *range(5, 30)]
    edges = [(r.choice(ids), r.choice(ids)) for _ in range(150)] + [(2**62, v) for v in ids]
    deg, tri, _, affected = arrive(edges, 10)
    c = G.canonical(frame(spark, edges))
    assert len(G.oriented(c)[1]) > 2
    assert results(G.triangle_count(c), "degree", "triangles") == [deg, tri]
    plan = G.triangles(c)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


@pytest.mark.parametrize("run", [3, 1000])
def test_running_sums_of_a_hub_and_of_repeated_rows(spark, monkeypatch, run):
    monkeypatch.setattr(G, "RUN", run)
    r = random.Random(6)
    rows = [(v, r.randrange(40), r.randrange(5), 1) for v in (1, 1, 1, 1, 1, 2, 3) for _ in range(5)] + [(4, 7, 2, 1)]
    want = []
    for vid, pos in sorted({x[:2] for x in rows}):
        own, upto = ([x[2:] for x in rows if x[0] == vid and (x[1] == pos or below and x[1] < pos)] for below in (False, True))
        want.append((vid, pos, *map(sum, zip(*own, strict=True)), *map(sum, zip(*upto, strict=True))))
    got = G.running_sums(spark.createDataFrame(rows, "vid long, pos long, a long, b long"), ["a", "b"])
    assert sorted(tuple(x) for x in got.collect()) == want
    if run == 1000:  # one exchange without hubs
        assert got._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].count("Exchange") == 1


def test_states_of_batches_take_only_what_they_need(spark):
    edges = CASES[-1]
    c = G.canonical(frame(spark, edges))
    degree = B.state_of(G.symmetric(c), "degree", 10)
    assert "closing" not in degree._jdf.queryExecution().executedPlan().toString() and c not in G._oriented
    near = {}
    for k in range(6):
        deg, tri, _, affected = arrive(edges[: 10 * k + 10], 10)
        near |= {(b, v): (deg[v], tri[v]) for b, v in affected if b == k}
    got = {(r.batch_id, r.vid): r for r in B.states(c, 10).collect()}
    assert {x: (r.degree, r.triangles) for x, r in got.items()} == near
    assert {(r.batch_id, r.vid): r.value for r in degree.collect()} == {x: r.degree for x, r in got.items() if r.d_degree}


def test_questions_share_a_pass_and_conditional_counts_make_no_rows(spark, tmp_path):
    from edgeloom.plans.stack import surroundings

    edges = frame(spark, CASES[-1])
    asked = Stack(TOUCHED, TRIANGLES, DEGREE)
    puts = asked.compiled(surroundings(edges))[1]
    assert puts._jdf.queryExecution().optimizedPlan().toString().count("Window") == 1

    def body(e):
        even = e.neighbours("end")
        e.increment("busy", e.start, e.value(even.where(even.vertex % 2 == 0).count()))

    stack = Stack(Analysis("busy", body))
    assert "arrived#" not in "".join(x for x in stack.deltas(edges)._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Join" in x)
    near, want = defaultdict(set), defaultdict(int)
    for a, b in CASES[-1]:
        if a != b and b not in near[a]:
            want[a] += sum(v % 2 == 0 for v in near[b])
            near[a].add(b)
            near[b].add(a)
    assert {r.vid: r.busy for r in stack.run(edges).collect()} == {v: want[v] for v in near if near[v]}


def test_replay_writes_a_batch_in_several_files(spark, tmp_path, monkeypatch):
    from edgeloom.streaming import replay as R

    monkeypatch.setattr(R, "FILE_EDGES", 20)
    edges = CASES[-1] * 3
    deg, tri, cc, _ = arrive(edges, 10)
    found = R.replay(frame(spark, edges), str(tmp_path), stack=Stack(TOUCHED, TRIANGLES, DEGREE)).collect()
    assert len(list((tmp_path / "input").glob("*.parquet"))) == 9 and len(list((tmp_path / "edges").glob("batch_id=*"))) == 3
    assert [{r.vid: r[n] for r in found} for n in ("degree", "triangles", "cc_touched")] == [deg, tri, cc]


def test_neighbourhoods_are_looked_up_in_buckets_and_not_dealt(spark, monkeypatch):
    from edgeloom.operators import ends

    monkeypatch.setattr(ends, "MOST_HELD", 9)
    monkeypatch.setattr(ends, "ELEMENTS", 5)
    c = G.canonical(frame(spark, CASES[-1]))
    rows = G.symmetric(c).select("vid", "nbr", (F.col("nbr") * 10).alias("value"))
    near = defaultdict(list)
    for r in sorted(rows.collect()):
        near[r.vid].append(r.nbr)
    widest = sorted(map(len, near.values()))[-2]
    found = ends.both(c, rows, widest)
    want = {(r.u, r.v): (near[r.u], near[r.v]) for r in c.collect() if max(len(near[r.u]), len(near[r.v])) <= widest}
    assert {(r.u, r.v): (r.a, r.b) for r in found.collect()} == want
    assert all(r.da == [10 * x for x in r.a] and r.db == [10 * x for x in r.b] for r in found.collect())
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
    assert ends.both(c.limit(0), rows.limit(0), widest).count() == 0


@pytest.mark.parametrize("pairs", [5, 1 << 18])
def test_common_neighbours_are_summed_where_lists_lie(spark, monkeypatch, pairs):
    from edgeloom.operators import closing

    monkeypatch.setattr(closing, "MOST_HELD", 7)
    monkeypatch.setattr(closing, "PAIRS", pairs)
    r = random.Random(8)
    # one graph whose sums of ids need more than a block may add up by itself
    for ids in (range(-4, 24), [-3, 2**60 + 5, 2**60 + 6, *range(5, 30)]):
        c = G.canonical(frame(spark, [(r.choice(ids), r.choice(ids)) for _ in range(200)]))
        near = defaultdict(set)
        rows = [tuple(x) for x in c.select("u", "v", "pos").collect()]
        for u, v, _ in rows:
            near[u].add(v)
            near[v].add(u)
        found = G.common_neighbours(c)
        want = sorted((u, v, pos, len(near[u] & near[v]), sum(near[u] & near[v])) for u, v, pos in rows)
        assert sorted(map(tuple, found.select("u", "v", "pos", "n_common", "acc").collect())) == want and any(x[3] for x in want)
        assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
    assert G.common_neighbours(c.limit(0)).count() == 0
