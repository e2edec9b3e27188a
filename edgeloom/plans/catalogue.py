"""The queries over the graphs that the tables hold, and their SQL for DuckDB.

Queries are over the part-supplier graph unless said otherwise; set and map functions and `*_ev` use the graph of
consecutive users.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from edgeloom.functions import values as V
from edgeloom.model import BATCH, NODES, TAIL
from edgeloom.operators import batches as B
from edgeloom.operators import ends
from edgeloom.operators import graph as G
from edgeloom.plans.stack import CLUSTERING, DEGREE, TOUCHED, TRIANGLES, Analysis, Edge, Stack
from edgeloom.sources import graphs as S
from edgeloom.sources.shared import arrow_place, new_path, ship
from edgeloom.streaming.replay import replay

ROWS, COLS, COMPLETE = 40, 50, 30

PS = """e AS (SELECT row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity) - 1 AS pos, l_partkey AS a, l_suppkey AS b, l_quantity AS quantity FROM lineitem)"""
EV = """ev0 AS (SELECT row_number() OVER (ORDER BY ts, event_id) - 1 AS pos, user_id AS a, lead(user_id) OVER (ORDER BY ts, event_id) AS b FROM events),
e AS (SELECT pos, a, b FROM ev0 WHERE b IS NOT NULL)"""
CORE = """c AS (SELECT least(a, b) AS u, greatest(a, b) AS v, min(pos) AS pos FROM e WHERE a <> b GROUP BY 1, 2),
adj AS (SELECT u AS vid, v AS nbr, pos FROM c UNION ALL SELECT v, u, pos FROM c),
d AS (SELECT vid, count(*) AS deg, max(pos) AS lastpos FROM adj GROUP BY 1)"""
TRI = """t AS (SELECT x.u AS p, x.v AS q, y.v AS r, greatest(x.pos, y.pos, z.pos) AS done FROM c x JOIN c y ON x.u = y.u AND x.v < y.v JOIN c z ON z.u = x.v AND z.v = y.v),
tv AS (SELECT p AS vid, done FROM t UNION ALL SELECT q, done FROM t UNION ALL SELECT r, done FROM t),
tc AS (SELECT vid, count(*) AS tri FROM tv GROUP BY 1),
side AS (SELECT p AS u, q AS v, r AS nbr FROM t UNION ALL SELECT p, r, q FROM t UNION ALL SELECT q, r, p FROM t),
cn AS (SELECT u, v, count(*) AS n, sum(nbr) AS s FROM side GROUP BY 1, 2)"""
STATE = f"""ch AS (SELECT batch_id, vid, sum(dd) AS dd, sum(dt) AS dt FROM (SELECT pos // {BATCH} AS batch_id, vid, 1 AS dd, 0 AS dt FROM adj UNION ALL SELECT done // {BATCH}, vid, 0, 1 FROM tv) GROUP BY 1, 2),
st AS (SELECT *, sum(dd) OVER w AS degree, sum(dt) OVER w AS triangles FROM ch WINDOW w AS (PARTITION BY vid ORDER BY batch_id))"""

_found: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {}


def query(sql: str):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        _found[f.__name__] = (f, sql)
        return f

    return add


def _ps(spark, sf):
    return S.part_supplier(spark, sf).select("pos", "src", "dst")


def _c(spark, sf):
    return S.ingest(spark, sf, "C_ps", lambda: G.canonical(_ps(spark, sf)))


def _cev(spark, sf):
    return S.ingest(spark, sf, "C_ev", lambda: G.canonical(S.user_sequence(spark, sf)), "events")


def with_(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


@query(with_(PS, CORE) + "SELECT u, v, pos FROM c")
def edges_canonical(spark, sf):
    return G.canonical(_ps(spark, sf))


@query(with_(PS, CORE) + "SELECT vid, nbr FROM adj")
def edges_symmetric(spark, sf):
    return G.symmetric(_c(spark, sf)).select("vid", "nbr")


@query(with_(PS, CORE) + "SELECT e.pos, a AS src, b AS dst, CASE WHEN a = b THEN 'self_loop' WHEN e.pos > c.pos THEN 'duplicate' ELSE 'new' END AS status FROM e LEFT JOIN c ON c.u = least(a, b) AND c.v = greatest(a, b) AND a <> b")
def edge_classify(spark, sf):
    return G.classify(_ps(spark, sf))


@query(with_(PS, CORE) + "SELECT vid AS u, vid + 1 AS v, EXISTS (SELECT 1 FROM c WHERE c.u = d.vid AND c.v = d.vid + 1) AS found FROM d")
def edge_exists(spark, sf):
    c = _c(spark, sf)
    probe = G.degree(c).select(F.col("vid").alias("u"), (F.col("vid") + 1).alias("v"))
    return probe.join(c.select("u", "v", F.lit(True).alias("hit")), ["u", "v"], "left").select("u", "v", F.col("hit").isNotNull().alias("found"))


@query(with_(PS, CORE) + "SELECT vid, count(*) AS n_nbrs, min(nbr) AS min_nbr, max(nbr) AS max_nbr FROM adj GROUP BY vid")
def neighbor_sets(spark, sf):
    return G.symmetric(_c(spark, sf)).groupBy("vid").agg(F.count("*").alias("n_nbrs"), F.min("nbr").alias("min_nbr"), F.max("nbr").alias("max_nbr"))


@query(with_(PS, CORE) + "SELECT vid, deg AS degree FROM d")
def vertex_degree(spark, sf):
    return G.degree(_c(spark, sf))


@query(with_(PS, CORE, TRI) + "SELECT p, q, r, done AS done_pos FROM t")
def triangle_list(spark, sf):
    return G.triangles(_c(spark, sf))


@query(with_(PS, CORE, TRI) + "SELECT d.vid, CAST(coalesce(tri, 0) AS BIGINT) AS triangles FROM d LEFT JOIN tc ON tc.vid = d.vid")
def triangle_count(spark, sf):
    return G.triangle_count(_c(spark, sf)).select("vid", "triangles")


@query(with_(PS, CORE, TRI) + "SELECT (SELECT count(*) FROM c) AS edges, (SELECT count(*) FROM t) AS triangles")
def triangle_total(spark, sf):
    c = _c(spark, sf)
    both = c.select(F.lit(1).alias("e"), F.lit(0).alias("t")).union(G.triangles(c).select(F.lit(0), F.lit(1)))
    return both.agg(F.coalesce(F.sum("e"), F.lit(0)).cast("long").alias("edges"), F.coalesce(F.sum("t"), F.lit(0)).cast("long").alias("triangles"))


CC = "CASE WHEN deg > 1 THEN CAST((coalesce(tri, 0) * 100) // (deg * (deg - 1)) AS BIGINT) END AS cc"


@query(with_(PS, CORE, TRI) + f"SELECT d.vid, deg AS degree, CAST(coalesce(tri, 0) AS BIGINT) AS triangles, {CC} FROM d LEFT JOIN tc ON tc.vid = d.vid")
def clustering_coefficient(spark, sf):
    return G.clustering(_c(spark, sf))


@query(with_(EV, CORE, TRI) + f"SELECT d.vid, deg AS degree, CAST(coalesce(tri, 0) AS BIGINT) AS triangles, {CC} FROM d LEFT JOIN tc ON tc.vid = d.vid")
def clustering_coefficient_ev(spark, sf):
    return G.clustering(_cev(spark, sf))


@query(with_(PS, CORE, TRI) + f"SELECT d.vid, {CC} FROM d LEFT JOIN (SELECT tv.vid, count(*) AS tri FROM tv JOIN d ON d.vid = tv.vid WHERE done <= lastpos GROUP BY 1) s ON s.vid = d.vid")
def clustering_last_touch(spark, sf):
    return G.clustering_last_touch(_c(spark, sf))


@query(with_(PS, CORE, TRI) + "SELECT c.u, c.v, CAST(coalesce(n, 0) AS BIGINT) AS n_common FROM c LEFT JOIN cn ON cn.u = c.u AND cn.v = c.v")
def common_neighbors(spark, sf):
    return G.common_neighbours(_c(spark, sf)).select("u", "v", "n_common")


@query(with_(PS, CORE, TRI) + "SELECT c.pos, c.u, c.v, CAST(coalesce(n, 0) AS BIGINT) AS n_common FROM c LEFT JOIN (SELECT done, count(*) AS n FROM t GROUP BY 1) s ON s.done = c.pos")
def edge_triangle_delta(spark, sf):
    return G.edge_triangle_delta(_c(spark, sf))


@query(with_(PS, CORE) + "SELECT c.pos, c.u, c.v, x.k AS deg_u, y.k AS deg_v FROM c JOIN (SELECT vid, pos, row_number() OVER (PARTITION BY vid ORDER BY pos) - 1 AS k FROM adj) x ON x.vid = c.u AND x.pos = c.pos JOIN (SELECT vid, pos, row_number() OVER (PARTITION BY vid ORDER BY pos) - 1 AS k FROM adj) y ON y.vid = c.v AND y.pos = c.pos")
def adjacency_asof(spark, sf):
    return G.adjacency_asof(_c(spark, sf))


@query(with_(PS, CORE) + "SELECT vid, pos, row_number() OVER (PARTITION BY vid ORDER BY pos) AS value FROM adj")
def running_degree(spark, sf):
    return G.running_degree(_c(spark, sf))


@query(with_(PS, CORE, TRI) + "SELECT vid, done AS pos, CAST(sum(n) OVER (PARTITION BY vid ORDER BY done) AS BIGINT) AS value FROM (SELECT vid, done, count(*) AS n FROM tv GROUP BY 1, 2)")
def running_triangles(spark, sf):
    return G.running_triangles(_c(spark, sf))


@query(with_(PS) + f"SELECT pos, pos // {BATCH} AS batch_id FROM e")
def batch_assign(spark, sf):
    return _ps(spark, sf).select("pos", B.batch_of(F.col("pos")).alias("batch_id"))


@query(with_(PS, CORE, TRI) + f"""SELECT i.batch_id, i.n AS input_edges, CAST(coalesce(k.n, 0) AS BIGINT) AS new_edges, CAST(i.n - coalesce(k.n, 0) - i.loops AS BIGINT) AS duplicates, CAST(i.loops AS BIGINT) AS self_loops, CAST(coalesce(z.n, 0) AS BIGINT) AS new_triangles
FROM (SELECT pos // {BATCH} AS batch_id, count(*) AS n, count(*) FILTER (a = b) AS loops FROM e GROUP BY 1) i LEFT JOIN (SELECT pos // {BATCH} AS batch_id, count(*) AS n FROM c GROUP BY 1) k ON k.batch_id = i.batch_id LEFT JOIN (SELECT done // {BATCH} AS batch_id, count(*) AS n FROM t GROUP BY 1) z ON z.batch_id = i.batch_id""")
def batch_stats(spark, sf):
    return B.batch_stats(_ps(spark, sf))


@query(with_(PS, CORE, TRI, STATE) + "SELECT batch_id, vid, CAST(degree AS BIGINT) AS value FROM st WHERE dd > 0")
def degree_by_batch(spark, sf):
    return B.state_of(G.symmetric(_c(spark, sf)), "degree")


@query(with_(PS, CORE, TRI, STATE) + "SELECT batch_id, vid, CAST(triangles AS BIGINT) AS value FROM st WHERE dt > 0")
def triangles_by_batch(spark, sf):
    return B.state_of(G.corners(G.held_triangles(_c(spark, sf))), "triangles")


@query(with_(PS, CORE, TRI, STATE) + "SELECT batch_id, vid FROM ch")
def affected_vertices(spark, sf):
    return B.changes(_c(spark, sf)).select("batch_id", "vid")


@query(with_(PS, CORE, TRI, STATE) + "SELECT batch_id, vid, CAST(degree AS BIGINT) AS degree, CAST(triangles AS BIGINT) AS triangles FROM st QUALIFY row_number() OVER (PARTITION BY batch_id ORDER BY vid) <= 10")
def affected_topk(spark, sf):
    return B.first_affected(_c(spark, sf), 10, per_node=False)


@query(with_(PS, CORE, TRI, STATE) + f"SELECT batch_id, vid % {NODES} AS node, vid, CAST(degree AS BIGINT) AS degree, CAST(triangles AS BIGINT) AS triangles FROM st QUALIFY row_number() OVER (PARTITION BY batch_id, vid % {NODES} ORDER BY vid) <= 100")
def affected_per_node(spark, sf):
    return B.first_affected(_c(spark, sf), 100, per_node=True)


#: tail_stats measures a shorter tail, so that small tables have a head too.
SHORT_TAIL = 20000


def _threshold_sql(tail: int) -> str:
    return f"((n - {tail}) - (((n - {tail}) % {BATCH}) + {BATCH}) % {BATCH})"


@query(with_(PS) + f"SELECT n AS edges, {_threshold_sql(TAIL)} AS threshold FROM (SELECT count(*) AS n FROM e)")
def tail_threshold(spark, sf):
    n = F.col("edges") - TAIL
    return _ps(spark, sf).agg(F.count("*").alias("edges")).withColumn("threshold", n - F.pmod(n, F.lit(BATCH)))


@query(with_(PS, CORE) + f"SELECT CASE WHEN e.pos >= h THEN 'tail' ELSE 'head' END AS segment, count(*) AS edges, count(c.pos) AS new_edges FROM e LEFT JOIN c ON c.pos = e.pos, (SELECT {_threshold_sql(SHORT_TAIL)} AS h FROM (SELECT count(*) AS n FROM e)) GROUP BY 1")
def tail_stats(spark, sf):
    edges = _ps(spark, sf)
    cut = B.tail_threshold(edges.count(), SHORT_TAIL)
    rows = edges.select("pos").join(_c(spark, sf).select("pos", F.lit(1).alias("new")), "pos", "left")
    return rows.groupBy(F.when(F.col("pos") >= cut, "tail").otherwise("head").alias("segment")).agg(F.count("*").alias("edges"), F.count("new").alias("new_edges"))


@query(with_(PS, CORE) + f"SELECT vid, vid % {NODES} AS node, vid // {NODES} AS local_idx, vid AS roundtrip FROM d")
def vertex_partition(spark, sf):
    return B.partitioned(G.degree(_c(spark, sf)))


OWN = f"""o AS (SELECT u, v, pos, u % {NODES} AS node_u, v % {NODES} AS node_v, CASE WHEN u % {NODES} = v % {NODES} THEN u % {NODES} WHEN xor(u // {NODES}, v // {NODES}) & 1 = 0 THEN greatest(u % {NODES}, v % {NODES}) ELSE least(u % {NODES}, v % {NODES}) END AS start_node FROM c)"""


@query(with_(PS, CORE, OWN) + "SELECT u, v, node_u, node_v, start_node FROM o")
def edge_owner(spark, sf):
    return B.owners(_c(spark, sf)).drop("pos")


@query(with_(PS, CORE, TRI, OWN) + f"SELECT start_node AS from_node, vid % {NODES} AS to_node, done // {BATCH} AS batch_id, count(*) AS increments FROM tv JOIN o ON o.pos = tv.done WHERE start_node <> vid % {NODES} GROUP BY 1, 2, 3")
def shuffle_profile(spark, sf):
    return B.shuffle_profile(_c(spark, sf))


def _sets(spark, sf, degrees: bool = False) -> DataFrame:
    """u, v and what set functions need, from joins: no neighbourhood is gathered in a row. degrees: with the sum of the
    neighbours' degrees."""
    c = _cev(spark, sf)
    own = G.symmetric(c).groupBy("vid").agg(F.count("*").alias("n"), F.min("nbr").alias("least"), F.max("nbr").alias("most"), F.sum("nbr").alias("total"))
    if degrees:
        d = G.degree(c).hint("shuffle_hash").select(F.col("vid").alias("nbr"), "degree")
        own = own.join(G.symmetric(c).join(d, "nbr").groupBy("vid").agg(F.sum("degree").alias("s")), "vid")
    # a row for each vertex: hashed, so the edges need no sort
    a, b = (own.select(*[F.col(x).alias(f"{x}_{s}" if x != "vid" else s) for x in own.columns]).hint("shuffle_hash") for s in "uv")
    return G.common_neighbours(c).join(a, "u").join(b, "v")


NB = "nb AS (SELECT vid, list_sort(list(nbr)) AS s FROM adj GROUP BY 1), uv AS (SELECT c.u, c.v, x.s AS a, y.s AS b FROM c JOIN nb x ON x.vid = c.u JOIN nb y ON y.vid = c.v)"


@query(with_(EV, CORE, NB) + "SELECT u, v, CAST(len(list_distinct(list_concat(a, b))) AS BIGINT) AS n FROM uv")
def neighbor_union(spark, sf):
    return _sets(spark, sf).select("u", "v", (F.col("n_u") + F.col("n_v") - F.col("n_common")).alias("n"))


@query(with_(EV, CORE, NB) + "SELECT u, v, CAST(len(list_distinct(list_concat(a, b))) AS BIGINT) AS n, least(list_min(a), list_min(b)) AS least, greatest(list_max(a), list_max(b)) AS most FROM uv")
def set_union(spark, sf):
    return _sets(spark, sf).select("u", "v", (F.col("n_u") + F.col("n_v") - F.col("n_common")).alias("n"), F.least("least_u", "least_v").alias("least"), F.greatest("most_u", "most_v").alias("most"))


@query(with_(EV, CORE, NB) + "SELECT u, v, CAST(len(list_intersect(a, b)) AS BIGINT) AS n, CAST(coalesce(list_sum(list_intersect(a, b)), 0) AS BIGINT) AS total FROM uv")
def set_intersect(spark, sf):
    return _sets(spark, sf).select("u", "v", F.col("n_common").alias("n"), F.col("acc").alias("total"))


@query(with_(EV, CORE, NB) + "SELECT u, v, CAST(len(list_filter(a, lambda x: NOT list_contains(b, x))) AS BIGINT) AS n FROM uv")
def set_difference(spark, sf):
    return _sets(spark, sf).select("u", "v", (F.col("n_u") - F.col("n_common")).alias("n"))


@query(with_(EV, CORE, NB) + "SELECT u, v, list_has_all(list_append(b, v), a) AS closed FROM uv")
def set_subset(spark, sf):
    # is N(u) within N(v) and v itself?
    return _sets(spark, sf).select("u", "v", (F.col("n_common") + 1 == F.col("n_u")).alias("closed"))


def _neighbourhoods(spark, sf) -> DataFrame:
    """u, v, a, b: both ends' neighbourhoods as ascending sets, up to WIDEST elements each; larger ones are not for arrays."""
    c = _cev(spark, sf)
    return ends.both(c, G.symmetric(c).select("vid", "nbr", F.lit(0).cast("long").alias("value")), WIDEST).select("u", "v", "a", "b")


#: Elements of a set that is held in a row.
WIDEST = 100_000
SHOWN = "array_to_string(list_transform({0}, lambda x: CAST(x AS VARCHAR)), ',')"


def _shown(a) :
    return F.array_join(F.transform(a, lambda x: x.cast("string")), ",")


@query(with_(EV, CORE, NB) + f"SELECT u, v, {SHOWN.format('list_sort(list_distinct(list_concat(a, b)))')} AS either, {SHOWN.format('list_sort(list_intersect(a, b))')} AS both, {SHOWN.format('list_filter(a, lambda x: NOT list_contains(b, x))')} AS only_a FROM uv")
def set_elements(spark, sf):
    # the sets themselves, as text
    a, b = F.col("a"), F.col("b")
    return _neighbourhoods(spark, sf).select("u", "v", _shown(V.set_union(a, b)).alias("either"), _shown(V.set_intersection(a, b)).alias("both"), _shown(V.set_difference(a, b)).alias("only_a"))


@query(with_(EV, CORE, NB) + f"SELECT u, v, {SHOWN.format('list_filter(a, lambda x: x < v)')} AS below, list_contains(a, v) AS found, {SHOWN.format('list_filter(a, lambda x: x > v)')} AS above, {SHOWN.format('list_filter(b, lambda x: x % 2 = 0)')} AS even, {SHOWN.format('list_filter(b, lambda x: x % 2 <> 0)')} AS odd FROM uv")
def set_split(spark, sf):
    # N(u) split at v, N(v) by parity
    parts = _neighbourhoods(spark, sf).select("u", "v", V.split(F.col("a"), F.col("v")).alias("s"), V.partition(F.col("b"), lambda x: x % 2 == 0).alias("p"))
    return parts.select("u", "v", _shown(F.col("s.below")).alias("below"), F.col("s.found").alias("found"), _shown(F.col("s.above")).alias("above"), _shown(F.col("p.yes")).alias("even"), _shown(F.col("p.no")).alias("odd"))


@query(with_(EV, CORE, NB) + f"SELECT u, v, {SHOWN.format('list_sort(list_append(a, -1))')} AS with_one, {SHOWN.format('list_filter(a, lambda x: x <> v)')} AS without_v, list_min(a) AS first, {SHOWN.format('a[2:]')} AS rest, {SHOWN.format('list_sort(list_distinct(list_transform(a, lambda x: x % 10)))')} AS digits, CASE WHEN a < b THEN -1 WHEN a = b THEN 0 ELSE 1 END AS compared FROM uv")
def set_updates(spark, sf):
    a = F.col("a")
    rows = _neighbourhoods(spark, sf).withColumn("m", V.min_view(a))
    return rows.select("u", "v", _shown(V.insert(a, F.lit(-1).cast("long"))).alias("with_one"), _shown(V.delete(a, F.col("v"))).alias("without_v"), F.col("m.first").alias("first"), _shown(F.col("m.rest")).alias("rest"), _shown(V.set_map(a, lambda x: x % 10)).alias("digits"), V.compare(a, F.col("b")).alias("compared"))


def _maps(spark, sf) -> DataFrame:
    """u, v, a, b: maps from each neighbour to its degree."""
    c = _cev(spark, sf)
    rows = G.symmetric(c).join(G.degree(c).select(F.col("vid").alias("nbr"), "degree"), "nbr")
    return ends.both(c, rows.select("vid", "nbr", F.col("degree").alias("value")), WIDEST).select("u", "v", F.map_from_arrays("a", "da").alias("a"), F.map_from_arrays("b", "db").alias("b"))


MAPS = """mp AS (SELECT adj.vid, list({'k': nbr, 'd': d.deg} ORDER BY nbr) AS m FROM adj JOIN d ON d.vid = adj.nbr GROUP BY 1),
ab AS (SELECT c.u, c.v, x.m AS a, y.m AS b FROM c JOIN mp x ON x.vid = c.u JOIN mp y ON y.vid = c.v),
en AS (SELECT u, v, unnest(a).k AS k, unnest(a).d AS x, NULL AS y FROM ab UNION ALL SELECT u, v, unnest(b).k, NULL, unnest(b).d FROM ab),
j AS (SELECT u, v, k, max(x) AS x, max(y) AS y FROM en GROUP BY 1, 2, 3)"""


def _map_sql(value: str, where: str) -> str:
    return f"coalesce(string_agg(CASE WHEN {where} THEN k || ':' || ({value}) END, ',' ORDER BY k), '')"


def _map_shown(m) :
    return F.array_join(F.transform(V.entries(m), lambda e: F.concat_ws(":", e["key"].cast("string"), e["value"].cast("string"))), ",")


@query(with_(EV, CORE, MAPS) + f"SELECT u, v, {_map_sql('coalesce(x, 0) + coalesce(y, 0)', 'true')} AS either, {_map_sql('x * y', 'x IS NOT NULL AND y IS NOT NULL')} AS both, {_map_sql('x', 'y IS NULL')} AS only_a, {_map_sql('CASE WHEN y IS NULL THEN x ELSE x - y END', 'x IS NOT NULL AND (y IS NULL OR x > y)')} AS less FROM j GROUP BY u, v")
def map_combine(spark, sf):
    # the maps meet once: union, intersection and both differences are read off their common entries
    rows = _maps(spark, sf).select("u", "v", V.met(F.col("a"), F.col("b")).alias("z"))

    def shown(condition, value):
        kept = F.filter("z", lambda e: condition(e["value"]["x"], e["value"]["y"]))
        return F.array_join(F.transform(kept, lambda e: F.concat_ws(":", e["key"].cast("string"), value(e["value"]["x"], e["value"]["y"]).cast("string"))), ",")

    return rows.select(
        "u", "v", shown(lambda x, y: F.lit(True), lambda x, y: F.coalesce(x + y, x, y)).alias("either"), shown(lambda x, y: x.isNotNull() & y.isNotNull(), lambda x, y: x * y).alias("both"),
        shown(lambda x, y: y.isNull(), lambda x, y: x).alias("only_a"), shown(lambda x, y: x.isNotNull() & (y.isNull() | (x > y)), lambda x, y: F.when(y.isNull(), x).otherwise(x - y)).alias("less"),
    )


@query(with_(EV, CORE, MAPS) + f"SELECT u, v, {_map_sql('x', 'x IS NOT NULL AND k < v')} AS below, max(CASE WHEN k = v THEN x END) AS found, {_map_sql('x', 'x IS NOT NULL AND k > v')} AS above, {_map_sql('x + 1', 'x % 2 = 0')} AS even, {_map_sql('CASE WHEN k = v THEN 2 * x ELSE x END', 'x IS NOT NULL')} AS altered, {_map_sql('x', 'x IS NOT NULL AND k <> v')} AS deleted, min(CASE WHEN x IS NOT NULL THEN k END) AS first_key FROM j GROUP BY u, v")
def map_updates(spark, sf):
    a, v = F.col("a"), F.col("v")
    rows = _maps(spark, sf).select("u", "v", "a", V.split_lookup(a, v).alias("s"), V.map_min_view(a).alias("m"))
    maybe = V.map_maybe(a, lambda k, x: F.when(x % 2 == 0, x + 1))
    return rows.select("u", "v", _map_shown(F.col("s.below")).alias("below"), F.col("s.found").alias("found"), _map_shown(F.col("s.above")).alias("above"), _map_shown(maybe).alias("even"), _map_shown(V.alter(a, v, lambda x: x * 2)).alias("altered"), _map_shown(V.map_delete(a, v)).alias("deleted"), F.col("m.first.key").alias("first_key"))


@query(with_(EV, CORE, NB) + "SELECT u, v, list_min(a) AS min_u, list_max(a) AS max_u, list_min(b) AS min_v, list_max(b) AS max_v FROM uv")
def set_minmax(spark, sf):
    return _sets(spark, sf).select("u", "v", F.col("least_u").alias("min_u"), F.col("most_u").alias("max_u"), F.col("least_v").alias("min_v"), F.col("most_v").alias("max_v"))


@query(with_(EV, CORE, NB) + "SELECT u, v, CAST(len(list_filter(a, lambda x: x < v)) AS BIGINT) AS below, list_contains(a, v) AS found, CAST(len(list_filter(a, lambda x: x > v)) AS BIGINT) AS above FROM uv")
def set_partition(spark, sf):
    # N(u) split at v
    rows = G.symmetric(_cev(spark, sf)).select("vid", "nbr")
    place = F.row_number().over(Window.partitionBy("vid").orderBy("nbr")).cast("long")
    n = rows.groupBy("vid").agg(F.count("*").alias("n"))
    ranked = rows.withColumn("k", place).where("vid < nbr").join(n, "vid")
    return ranked.select(F.col("vid").alias("u"), F.col("nbr").alias("v"), (F.col("k") - 1).alias("below"), F.lit(True).alias("found"), (F.col("n") - F.col("k")).alias("above"))


@query(with_(EV, CORE) + "SELECT vid, CAST(sum(nbr) AS BIGINT) AS total FROM adj GROUP BY vid")
def set_fold(spark, sf):
    return G.symmetric(_cev(spark, sf)).groupBy("vid").agg(F.sum("nbr").alias("total"))


@query(with_(EV, CORE, TRI) + "SELECT c.u, c.v, x.deg + y.deg - CAST(coalesce(cn.n, 0) AS BIGINT) AS n_keys, CAST(x.s + y.s AS BIGINT) AS total FROM c JOIN (SELECT adj.vid, any_value(d0.deg) AS deg, sum(d.deg) AS s FROM adj JOIN d ON d.vid = adj.nbr JOIN d d0 ON d0.vid = adj.vid GROUP BY 1) x ON x.vid = c.u JOIN (SELECT adj.vid, any_value(d0.deg) AS deg, sum(d.deg) AS s FROM adj JOIN d ON d.vid = adj.nbr JOIN d d0 ON d0.vid = adj.vid GROUP BY 1) y ON y.vid = c.v LEFT JOIN cn ON cn.u = c.u AND cn.v = c.v")
def map_union_with(spark, sf):
    # maps {neighbour: its degree} of both ends, added where both have a key
    return _sets(spark, sf, degrees=True).select("u", "v", (F.col("n_u") + F.col("n_v") - F.col("n_common")).alias("n_keys"), (F.col("s_u") + F.col("s_v")).alias("total"))


@query(with_(EV, CORE) + "SELECT vid, deg AS n_keys, CAST(7 * deg AS BIGINT) AS total FROM d")
def map_from_set(spark, sf):
    return G.symmetric(_cev(spark, sf)).groupBy("vid").agg(F.count("*").alias("n_keys"), F.sum(F.lit(7).cast("long")).alias("total"))


@query(with_(PS) + "SELECT pos, a - 1000 + (b - 20) AS add, a - 1000 - (b - 20) AS sub, (a - 1000) * (b - 20) AS mul, CASE WHEN b <> 20 THEN CAST(floor((a - 1000) / CAST(b - 20 AS DOUBLE)) AS BIGINT) END AS floor_div, a - 1000 = b - 20 AS eq, a - 1000 <> b - 20 AS ne, 1000 - a AS neg, NOT (a - 1000 = b - 20) AS not_eq FROM e")
def value_ops(spark, sf):
    x, y = F.col("src") - 1000, F.col("dst") - 20
    return _ps(spark, sf).select("pos", (x + y).alias("add"), (x - y).alias("sub"), (x * y).alias("mul"), V.floor_div(x, y).alias("floor_div"), (x == y).alias("eq"), (x != y).alias("ne"), (-x).alias("neg"), (~(x == y)).alias("not_eq"))


@query(with_(PS, CORE, TRI) + "SELECT c.u, c.v, CAST(coalesce(s, 0) AS BIGINT) AS acc FROM c LEFT JOIN cn ON cn.u = c.u AND cn.v = c.v")
def local_accumulate(spark, sf):
    return G.common_neighbours(_c(spark, sf)).select("u", "v", "acc")


@query(with_(PS, CORE) + "SELECT adj.vid, CAST(sum(d.deg) AS BIGINT) AS nbr_degree_sum FROM adj JOIN d ON d.vid = adj.nbr GROUP BY 1")
def on_edges(spark, sf):
    c = _c(spark, sf)
    d = G.degree(c).select(F.col("vid").alias("nbr"), "degree")
    return G.symmetric(c).join(d, "nbr").groupBy("vid").agg(F.sum("degree").alias("nbr_degree_sum"))


@query(with_(EV, CORE, TRI) + f"SELECT d.vid, deg AS degree, CAST(coalesce(tri, 0) AS BIGINT) AS triangles, {CC}_touched FROM d LEFT JOIN (SELECT tv.vid, count(*) AS tri_seen FROM tv JOIN d ON d.vid = tv.vid WHERE done <= lastpos GROUP BY 1) s ON s.vid = d.vid LEFT JOIN tc ON tc.vid = d.vid".replace("coalesce(tri, 0) * 100", "coalesce(tri_seen, 0) * 100"))
def stack_clustering(spark, sf):
    # the coefficient as a program that reads results and sets its own
    return Stack(TOUCHED, TRIANGLES, DEGREE).run(S.user_sequence(spark, sf).select("pos", "src", "dst"))


@query(with_(EV, CORE, TRI) + f"SELECT d.vid, deg AS degree, CAST(coalesce(tri, 0) AS BIGINT) AS triangles, {CC}_touched FROM d LEFT JOIN (SELECT tv.vid, count(*) AS tri_seen FROM tv JOIN d ON d.vid = tv.vid WHERE done <= lastpos GROUP BY 1) s ON s.vid = d.vid LEFT JOIN tc ON tc.vid = d.vid".replace("coalesce(tri, 0) * 100", "coalesce(tri_seen, 0) * 100"))
def stream_clustering(spark, sf):
    # the same program, batch by batch
    return replay(S.user_sequence(spark, sf).select("pos", "src", "dst"), new_path(spark, "replay"), stack=Stack(TOUCHED, TRIANGLES, DEGREE))


@query(with_(PS, CORE) + "SELECT d.vid, CAST(coalesce(n, 0) AS BIGINT) AS reached FROM d LEFT JOIN (SELECT y.nbr AS vid, count(*) AS n FROM c JOIN e ON e.pos = c.pos JOIN adj x ON x.vid = e.b AND x.pos < c.pos JOIN adj y ON y.vid = x.nbr AND y.pos < c.pos WHERE e.pos < 4000 GROUP BY 1) s ON s.vid = d.vid")
def stack_nested_loops(spark, sf):
    # two steps from the end of each of the first edges, along edges that were there before
    def body(edge: Edge) -> None:
        loop = edge.neighbours("end").where(F.col("pos") < 4000).neighbours()
        edge.increment("reached", loop.vertex, 1, over=loop)

    return Stack(Analysis("reached", body)).run(_ps(spark, sf))


@query(with_(PS, CORE) + "SELECT d.vid, CAST(coalesce(n, 0) AS BIGINT) AS busy FROM d LEFT JOIN (SELECT e.a AS vid, sum(k) AS n FROM (SELECT c.pos, count(x.nbr) AS k FROM c JOIN e ON e.pos = c.pos LEFT JOIN adj x ON x.vid = e.b AND x.pos < c.pos AND x.nbr % 2 = 0 GROUP BY 1) t JOIN e ON e.pos = t.pos WHERE k > 3 GROUP BY 1) s ON s.vid = d.vid")
def stack_locals(spark, sf):
    # a local that a loop counts up, used in a condition and as a value
    def body(edge: Edge) -> None:
        even = edge.neighbours("end")
        n = edge.local(edge.value(even.where(even.vertex % 2 == 0).count()))
        edge.when(n.value > 3, lambda e: e.increment("busy", e.start, n.value))

    return Stack(Analysis("busy", body)).run(_ps(spark, sf))


@query(with_(PS, CORE) + "SELECT vid, CAST(sum(CASE WHEN (vid + nbr) % 2 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS value FROM adj GROUP BY 1")
def cond_increment(spark, sf):
    def body(edge: Edge) -> None:
        def both(e: Edge) -> None:
            e.increment("value", e.start, 1)
            e.increment("value", e.end, 1)

        edge.when((edge.start + edge.end) % 2 == 0, both)

    return Stack(Analysis("value", body)).run(_ps(spark, sf))


@query(with_(PS, CORE, TRI) + f"SELECT d.vid, deg AS degree, CAST(coalesce(tri, 0) AS BIGINT) AS triangles, {CC} FROM d LEFT JOIN tc ON tc.vid = d.vid")
def run_stack(spark, sf):
    return Stack(CLUSTERING, TRIANGLES, DEGREE).run(_ps(spark, sf))


@query(with_(PS, CORE) + "SELECT d.vid, CAST(coalesce(n, 0) AS BIGINT) AS met FROM d LEFT JOIN (SELECT x.nbr AS vid, count(*) AS n FROM e JOIN c ON c.pos = e.pos JOIN adj x ON x.vid = e.a AND x.pos < e.pos GROUP BY 1) s ON s.vid = d.vid")
def stack_neighbour_loop(spark, sf):
    # each accepted edge tells the neighbours that its start had before
    return Stack(Analysis("met", lambda edge: edge.increment("met", edge.neighbours("start"), 1))).run(_ps(spark, sf))


@query(f"WITH x AS (SELECT i, j FROM range({ROWS}) a(i), range({COLS}) b(j)) SELECT i * {COLS} + j AS src, i * {COLS} + j + 1 AS dst FROM x WHERE j + 1 < {COLS} UNION ALL SELECT i * {COLS} + j, (i + 1) * {COLS} + j FROM x WHERE i + 1 < {ROWS} UNION ALL SELECT i * {COLS} + j, (i + 1) * {COLS} + j + 1 FROM x WHERE i + 1 < {ROWS} AND j + 1 < {COLS}")
def gen_rectangle(spark, sf):
    return S.rectangle(spark, ROWS, COLS)


@query(f"SELECT CAST(f = 1 AS BOOLEAN) AS ordered, i AS src, j AS dst FROM range({COMPLETE}) a(i), range({COMPLETE}) b(j), range(2) c(f) WHERE f = 1 OR i < j")
def gen_complete(spark, sf):
    return S.complete(spark, COMPLETE, True).select(F.lit(True).alias("ordered"), "src", "dst").union(S.complete(spark, COMPLETE).select(F.lit(False), "src", "dst"))


@query(f"SELECT i, j, i * {COLS} + j AS vid FROM range({ROWS}) a(i), range({COLS}) b(j)")
def grid_encode(spark, sf):
    cells = spark.range(ROWS).select(F.col("id").alias("i"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(COLS - 1).cast("long"))).alias("j"))
    return cells.withColumn("vid", S.grid_id(F.col("i"), F.col("j"), COLS))


@query(f"SELECT vid, vid // {COLS} AS i, vid % {COLS} AS j FROM range({ROWS * COLS}) a(vid)")
def grid_decode(spark, sf):
    return spark.range(ROWS * COLS).select(F.col("id").alias("vid"), S.grid_row(F.col("id"), COLS).alias("i"), S.grid_col(F.col("id"), COLS).alias("j"))


@query("SELECT k AS pos, 2 * k * 3 AS src, (2 * k + 1) * 3 AS dst FROM range(50) a(k)")
def pairs_from_flat(spark, sf):
    # 101 elements: the last one has no partner
    return S.pairs_from_flat(spark.range(1).select(F.transform(F.sequence(F.lit(0).cast("long"), F.lit(100).cast("long")), lambda x: x * 3).alias("arr")))


@query(with_(PS) + "SELECT pos AS eid, quantity AS attr FROM e")
def attr_roundtrip(spark, sf):
    # the attribute as a whole number, as an encoder would store it, and back
    coded = S.part_supplier(spark, sf).select("pos", F.round(F.col("quantity") * 100).cast("long").alias("code"))
    return coded.select(F.col("pos").alias("eid"), (F.col("code") / 100).alias("attr"))


@query(with_(PS, CORE, TRI) + "SELECT d.vid, deg AS degree, CAST(coalesce(tri, 0) AS BIGINT) AS triangles FROM d LEFT JOIN tc ON tc.vid = d.vid")
def stream_replay(spark, sf):
    return replay(_ps(spark, sf), new_path(spark, "replay"))


def _binary(spark, sf) -> str:
    """The graph's edges as a binary file: 16 bytes an edge, written by one task for each file."""
    ship(spark)
    path = new_path(spark, "binary")

    def write(batches):
        import numpy as np
        import pandas as pd
        from pyspark import TaskContext

        system, root = arrow_place(path)
        system.create_dir(root, recursive=True)
        n = 0
        with system.open_output_stream(f"{root}/edges-{TaskContext.get().partitionId():05d}.bin") as f:
            for b in batches:
                f.write(np.column_stack([b["src"], b["dst"]]).astype("<i8").tobytes())
                n += len(b)
        yield pd.DataFrame({"n": [n]})

    _ps(spark, sf).repartitionByRange("pos").sortWithinPartitions("pos").select("src", "dst").mapInPandas(write, "n long").agg(F.sum("n")).first()
    return path


@query(with_(PS) + "SELECT pos, a AS src, b AS dst FROM e")
def read_edges_binary(spark, sf):
    return S.read_binary(spark, _binary(spark, sf))


@query(with_(PS) + "SELECT count(*) AS n FROM e")
def edge_count(spark, sf):
    return S.binary_edge_count(spark, _binary(spark, sf))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, (f, _) in _found.items()}


def oracle_sql() -> dict[str, str]:
    return {k: sql for k, (_, sql) in _found.items()}
