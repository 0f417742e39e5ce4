"""Time and space joins, graphs, grids, clusters over the stand-in tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from orrery.functions import geometry as G
from orrery.functions.vectors import cosine
from orrery.operators import asof, cells as cell_tables, cluster, graph, raster, spatial
from orrery.plans.queries_relational import EDGES, PTS, VEC, points, r6, similar_edges, vecs
from orrery.plans.tables import Tables, query

STAMPS = "st AS (SELECT event_id, event_type, user_id, floor(epoch(ts))::BIGINT AS ts FROM events)"


def stamps(t: Tables) -> DataFrame:
    ts = F.unix_timestamp(F.col("ts").cast("timestamp")).cast("long")
    return t.events.select("event_id", "event_type", "user_id", ts.alias("ts"))


def nearest_sql(kind: str, name: str, source: str, by: str = "") -> str:
    """The nearest stamp of a type for each row of ``source``, the earlier of equals, by a window over the union."""
    key = f"PARTITION BY {by} " if by else ""
    col = f"{by}, " if by else ""
    return (
        f"{name}_u AS (SELECT {col}event_id, ts, 1 AS side, NULL::BIGINT AS v FROM {source} UNION ALL SELECT {col}NULL, ts, 0, min(event_id) FROM st WHERE event_type = '{kind}' GROUP BY ALL), "
        f"{name}_w AS (SELECT *, last_value(CASE WHEN side = 0 THEN {{'t': ts, 'v': v}} END IGNORE NULLS) OVER ({key}ORDER BY ts, side ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS b, "
        f"first_value(CASE WHEN side = 0 THEN {{'t': ts, 'v': v}} END IGNORE NULLS) OVER ({key}ORDER BY ts, side DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS a FROM {name}_u), "
        f"{name} AS (SELECT {col}event_id, ts, CASE WHEN a IS NULL OR ts - b.t <= a.t - ts THEN b ELSE a END AS m FROM {name}_w WHERE side = 1)"
    )


@query("j1_asof_nearest", f"WITH {STAMPS}, lidar AS (SELECT * FROM st WHERE event_type = 'view'), {nearest_sql('click', 'c1', 'lidar')}, {nearest_sql('purchase', 'c2', 'lidar')}, {nearest_sql('signup', 'po', 'lidar')} SELECT c1.event_id, c1.m.v AS click, c2.m.v AS purchase, po.m.v AS signup FROM c1 JOIN c2 ON c1.event_id = c2.event_id JOIN po ON c1.event_id = po.event_id WHERE abs(c1.m.t - c1.ts) <= 600 AND abs(c2.m.t - c1.ts) <= 600 AND abs(po.m.t - c1.ts) <= 600")
def j1(t: Tables) -> DataFrame:
    st = stamps(t)
    kind = lambda k: st.where(F.col("event_type") == k)
    streams = {k: kind(k).select("ts", F.col("event_id").alias("id")) for k in ("click", "purchase", "signup")}
    out = asof.align(kind("view").select("event_id", "ts"), streams, "ts", "id", 600)
    return out.select("event_id", *[F.col(f"{k}_id").alias(k) for k in streams])


@query("j2_nearest_transform", f"WITH {STAMPS}, img AS (SELECT * FROM st WHERE event_type = 'click'), {nearest_sql('view', 'nv', 'img', 'user_id')} SELECT event_id, m.v AS transform, abs(m.t - ts)::BIGINT AS gap FROM nv WHERE m IS NOT NULL")
def j2(t: Tables) -> DataFrame:
    st = stamps(t)
    out = asof.nearest_asof(st.where("event_type = 'click'").select("user_id", "event_id", "ts"), st.where("event_type = 'view'").select("user_id", "ts", F.col("event_id").alias("id")), "ts", "id", by=["user_id"])
    return out.select("event_id", F.col("match_id").alias("transform"), F.col("gap").cast("long").alias("gap"))


CLOUD = f"{PTS}, scan AS (SELECT * FROM pts WHERE event_id % 50 = 0), cloud AS (SELECT * FROM pts WHERE event_id % 50 <> 0)"
D3 = "round((s.x - c.x) * (s.x - c.x) + (s.y - c.y) * (s.y - c.y) + (s.z - c.z) * (s.z - c.z), 9)"


def scan_and_cloud(t: Tables) -> tuple[DataFrame, DataFrame]:
    p = points(t)
    return p.where("event_id % 50 = 0").select(F.col("event_id").alias("pt"), "x", "y", "z"), p.where("event_id % 50 <> 0").select(F.col("event_id").alias("gidx"), "x", "y", "z")


@query("j3_nn", f"WITH {CLOUD} SELECT s.event_id AS pt, round(min((s.x - c.x) * (s.x - c.x) + (s.y - c.y) * (s.y - c.y) + (s.z - c.z) * (s.z - c.z)), 6) AS d2, arg_min(c.event_id, ((s.x - c.x) * (s.x - c.x) + (s.y - c.y) * (s.y - c.y) + (s.z - c.z) * (s.z - c.z), c.event_id)) AS gidx FROM scan s, cloud c GROUP BY 1")
def j3(t: Tables) -> DataFrame:
    scan, cloud = scan_and_cloud(t)
    return spatial.nearest(scan, cloud, "pt", "gidx", ["x", "y", "z"]).select("pt", F.round("d2", 6).alias("d2"), "gidx")


@query("j5_knn_coalesce", f"WITH {CLOUD}, r AS (SELECT s.event_id AS pt, c.event_id AS gidx, row_number() OVER (PARTITION BY s.event_id ORDER BY (s.x - c.x) * (s.x - c.x) + (s.y - c.y) * (s.y - c.y), c.event_id) AS rk FROM scan s, cloud c), k AS (SELECT *, gidx % 61 = 0 AS near, gidx % 7 = 0 AS close FROM r WHERE rk <= 50) SELECT pt, coalesce(arg_min(gidx * 10, rk) FILTER (near), arg_max(gidx * 10 + 1, rk) FILTER (close)) AS img FROM k GROUP BY pt")
def j5(t: Tables) -> DataFrame:
    scan, cloud = scan_and_cloud(t)
    ranked = spatial.nearest(scan, cloud, "pt", "gidx", ["x", "y"], k=50)
    within = cloud.where("gidx % 61 = 0").select("gidx", F.array(F.col("gidx") * 10).alias("imgs"))
    closest = cloud.where("gidx % 7 = 0").select("gidx", (F.col("gidx") * 10 + 1).alias("img"))
    return spatial.images_of_nearest(ranked, within, closest, "pt", "gidx", strict=False).select("pt", F.col("imgs")[0].alias("img"))


@query("j6_radius3d", f"WITH {CLOUD} SELECT DISTINCT c.event_id AS gidx FROM scan s JOIN cloud c ON {D3} <= 9")
def j6(t: Tables) -> DataFrame:
    scan, cloud = scan_and_cloud(t)
    return spatial.radius_join(scan, cloud, 3.0, ["x", "y", "z"], digits=9).select("r.gidx").distinct()


@query("j7_radius2d", f"WITH {CLOUD} SELECT s.event_id AS pt, count(*) AS n FROM scan s JOIN cloud c ON round((s.x - c.x) * (s.x - c.x) + (s.y - c.y) * (s.y - c.y), 9) <= 4 GROUP BY 1")
def j7(t: Tables) -> DataFrame:
    scan, cloud = scan_and_cloud(t)
    return spatial.radius_join(scan, cloud, 2.0, ["x", "y"], digits=9).groupBy("l.pt").agg(F.count("*").alias("n"))


PLACES = f"{VEC}, pl AS (SELECT vec_id AS id, label, (vec_id * 37 % 101)::DOUBLE AS x, (vec_id * 53 % 97)::DOUBLE AS y, e FROM vec)"


def at_of(key: str) -> list[Column]:
    return [(F.col(key) * a % m).cast("double").alias(d) for d, a, m in (("x", 37, 101), ("y", 53, 97))]


def places(t: Tables) -> DataFrame:
    """(id, label, x, y, emb): segments laid out as places."""
    return vecs(t).select(F.col("vec_id").alias("id"), "label", *at_of("vec_id"), "emb")


@query("j4_nearest_place", f"WITH {PLACES}, {PTS}, o AS (SELECT event_id, x, y FROM pts) SELECT o.event_id, arg_min(pl.id, ((o.x - pl.x) * (o.x - pl.x) + (o.y - pl.y) * (o.y - pl.y), pl.id)) AS place FROM o, pl GROUP BY 1")
def j4(t: Tables) -> DataFrame:
    objects = points(t).select("event_id", "x", "y")
    return spatial.nearest(objects, places(t), "event_id", "id", ["x", "y"]).select("event_id", F.col("id").alias("place"))


@query("j17_closest_between_components", f"WITH {PLACES}, p AS (SELECT * FROM pl) SELECT c, d, src, dst FROM (SELECT a.label AS c, round(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)), 6) AS d, least(a.id, b.id) AS src, greatest(a.id, b.id) AS dst, row_number() OVER (PARTITION BY a.label ORDER BY (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y), least(a.id, b.id), greatest(a.id, b.id)) AS r FROM p a JOIN p b ON a.label <> b.label) WHERE r = 1")
def j17(t: Tables) -> DataFrame:
    p = places(t).select("id", "label", "x", "y")
    near = spatial.nearest(p, p.withColumnRenamed("id", "other"), "id", "other", ["x", "y"], apart="label").join(p.select("id", "label"), "id")
    best = near.groupBy(F.col("label").alias("c")).agg(F.min(F.struct("d2", F.least("id", "other").alias("src"), F.greatest("id", "other").alias("dst"))).alias("m"))
    return best.select("c", F.round(F.sqrt("m.d2"), 6).alias("d"), "m.src", "m.dst")


@query("j18_cross_class_nearest", f"WITH {PLACES}, q AS (SELECT a.id, b.id AS other, b.label, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS d FROM pl a JOIN pl b ON a.label <> b.label) SELECT id, arg_min(other, (d, label, other)) AS other FROM q GROUP BY id HAVING min(d) < 6")
def j18(t: Tables) -> DataFrame:
    p = places(t).drop("emb")
    pairs = spatial.radius_join(p, p, 6.0, ["x", "y"]).where("l.label <> r.label AND d2 < 36")
    best = pairs.groupBy("l.id").agg(F.min(F.struct("d2", "r.label", F.col("r.id").alias("other"))).alias("m"))
    return best.select("id", "m.other")


@query("j19_associate", f"WITH {PLACES} SELECT a.id AS id1, arg_min(b.id, ((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y), b.id)) AS id2 FROM pl a, pl b WHERE a.id % 2 = 0 AND b.id % 2 = 1 GROUP BY 1")
def j19(t: Tables) -> DataFrame:
    p = places(t)
    return spatial.nearest(p.where("id % 2 = 0").withColumnRenamed("id", "id1"), p.where("id % 2 = 1").withColumnRenamed("id", "id2"), "id1", "id2", ["x", "y"]).select("id1", "id2")


@query("j20_associate_level", f"WITH {PLACES} SELECT a.id AS id1, arg_min(b.id, ((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y), b.id)) AS id2 FROM pl a JOIN pl b ON a.label = b.label WHERE a.id % 2 = 0 AND b.id % 2 = 1 GROUP BY 1")
def j20(t: Tables) -> DataFrame:
    p = places(t)
    return spatial.nearest(p.where("id % 2 = 0").withColumnRenamed("id", "id1"), p.where("id % 2 = 1").withColumnRenamed("id", "id2"), "id1", "id2", ["x", "y"], by=["label"]).select("id1", "id2")


@query("j22_rectangle", f"WITH {PLACES}, b AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM pl WHERE id IN (3, 11, 29, 47)) SELECT id FROM pl, b WHERE x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1")
def j22(t: Tables) -> DataFrame:
    p = places(t)
    b = p.where(F.col("id").isin(3, 11, 29, 47)).agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    return p.join(F.broadcast(b), F.lit(True)).where("x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1").select("id")


CORNERS = [(10.5, 12.5), (80.5, 20.5), (70.5, 85.5), (20.5, 60.5)]


def _crossings() -> str:
    parts = []
    for (ax, ay), (bx, by) in zip(CORNERS, [*CORNERS[1:], CORNERS[0]]):
        parts.append(f"(CASE WHEN ({ay} > y) <> ({by} > y) AND x < ({bx} - {ax}) * (y - {ay}) / ({by} - {ay}) + {ax} THEN 1 ELSE 0 END)")
    return " + ".join(parts)


@query("j23_polygon", f"WITH {PLACES} SELECT id FROM pl WHERE ({_crossings()}) % 2 = 1")
def j23(t: Tables) -> DataFrame:
    return places(t).where(G.in_polygon(F.col("x"), F.col("y"), CORNERS)).select("id")


# --- graph ---------------------------------------------------------------------------


GRAPH_EDGES = EDGES.replace("> 0.3)", "> 0.42)")


def sparse_edges(t: Tables) -> DataFrame:
    return similar_edges(t, 0.42)


COMPONENTS = ", u AS (SELECT src, dst FROM edges UNION SELECT dst, src FROM edges), reach(id, root) AS (SELECT DISTINCT src, src FROM u UNION SELECT u.dst, reach.root FROM reach JOIN u ON u.src = reach.id)"


@query("g2_components", f"WITH RECURSIVE {GRAPH_EDGES}{COMPONENTS} SELECT id, min(root) AS component FROM reach GROUP BY id")
def g2(t: Tables) -> DataFrame:
    return graph.components(sparse_edges(t))


@query("g4_largest", f"WITH RECURSIVE {GRAPH_EDGES}{COMPONENTS}, c AS (SELECT vec_id AS id, coalesce((SELECT min(root) FROM reach WHERE reach.id = vec_id), vec_id) AS component FROM vec), z AS (SELECT component, count(*) AS size FROM c GROUP BY 1), top AS (SELECT *, row_number() OVER (ORDER BY size DESC, component) AS r FROM z) SELECT c.id, c.component, size FROM c JOIN top ON c.component = top.component WHERE r <= 2")
def g4(t: Tables) -> DataFrame:
    return graph.largest(vecs(t).select(F.col("vec_id").alias("id")), sparse_edges(t).select("src", "dst"), 2).select("id", "component", "size")


@query("g3_bridge")
def g3(t: Tables) -> DataFrame:
    p = places(t).select("id", "x", "y", "emb")
    edges = similar_edges(t, 0.35).select("src", "dst")
    return graph.bridge(p, edges, ["x", "y"], 1.0, "emb").select("src", "dst", F.round("weight", 4).alias("weight"))


@query("g5_shortest_path", f"WITH RECURSIVE {EDGES}, w AS (SELECT src, dst, round(1.5 - c, 9) AS w FROM edges UNION ALL SELECT dst, src, round(1.5 - c, 9) FROM edges), far(id, cost, hops) AS (SELECT 0::BIGINT, 0.0::DOUBLE, 0 UNION SELECT w.dst, round(far.cost + w.w, 9), hops + 1 FROM far JOIN w ON far.id = w.src WHERE hops < 4) SELECT round(min(cost), 6) AS cost FROM far WHERE id = 100")
def g5(t: Tables) -> DataFrame:
    e = similar_edges(t).select("src", "dst", F.round(1.5 - F.col("c"), 9).alias("weight"))
    path = graph.shortest_path(e, 0, 100)
    return path.agg(F.round(F.max("cost"), 6).alias("cost"))


TREE = "tree AS (SELECT 10000000 + n_nationkey AS id, 3 AS level, NULL::BIGINT AS up FROM nation UNION ALL SELECT c_custkey, 2, 10000000 + c_nationkey FROM customer UNION ALL SELECT 20000000 + o_orderkey, 1, o_custkey FROM orders)"


def tree(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, level) and edges of nation (3) - customer (2) - order (1)."""
    nodes = t.nation.select((F.col("n_nationkey") + 10_000_000).cast("long").alias("id"), F.lit(3).alias("level"))
    nodes = nodes.unionByName(t.customer.select(F.col("c_custkey").alias("id"), F.lit(2).alias("level"))).unionByName(t.orders.select((F.col("o_orderkey") + 20_000_000).alias("id"), F.lit(1).alias("level")))
    edges = t.customer.select(F.col("c_custkey").alias("src"), (F.col("c_nationkey") + 10_000_000).cast("long").alias("dst"))
    return nodes, edges.unionByName(t.orders.select((F.col("o_orderkey") + 20_000_000).alias("src"), F.col("o_custkey").alias("dst")))


@query("g6_descend", "SELECT (10000000 + c_nationkey)::BIGINT AS root, count(*) AS n, sum(o_orderkey)::BIGINT AS total FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_nationkey < 5 GROUP BY 1")
def g6(t: Tables) -> DataFrame:
    nodes, edges = tree(t)
    roots = nodes.where("id BETWEEN 10000000 AND 10000004").select(F.col("id").alias("root"))
    return graph.descend(nodes, edges, roots).groupBy("root").agg(F.count("*").alias("n"), F.sum(F.col("id") - 20_000_000).alias("total"))


@query("g7_bottom_regions", "SELECT DISTINCT (10000000 + c_nationkey)::BIGINT AS root, c_custkey AS id FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_nationkey < 5")
def g7(t: Tables) -> DataFrame:
    nodes, edges = tree(t)
    return graph.bottom_regions(nodes, edges, nodes.where("id BETWEEN 10000000 AND 10000004").select(F.col("id").alias("root")))


@query("g8_children", "SELECT o_custkey AS region, count(*) AS n FROM orders GROUP BY 1")
def g8(t: Tables) -> DataFrame:
    nodes, edges = tree(t)
    return graph.children(nodes, edges).groupBy("region").agg(F.count("*").alias("n"))


@query("g9_attach_objects", f"WITH {PLACES}, {PTS}, o AS (SELECT event_id, x, y, z FROM pts WHERE event_id % 100 = 1), m AS (SELECT max(id) AS top FROM pl), a AS (SELECT o.event_id, arg_min(pl.id, ((o.x - pl.x) * (o.x - pl.x) + (o.y - pl.y) * (o.y - pl.y), pl.id)) AS place FROM o, pl GROUP BY 1) SELECT (top + row_number() OVER (ORDER BY event_id))::BIGINT AS id, place FROM a, m")
def g9(t: Tables) -> DataFrame:
    from orrery.plans.scene import attach_objects

    objects = points(t).where("event_id % 100 = 1").select(F.col("event_id").alias("obj"), "x", "y", "z")
    nodes = places(t).select("id", F.lit(1).alias("level"), "x", "y")
    return attach_objects(nodes, objects)[1].select(F.col("src").alias("id"), F.col("dst").alias("place"))


@query("g11_root", "SELECT label AS src, 1000 AS dst, round(sqrt((x - mx) * (x - mx) + (y - my) * (y - my)), 6) AS w FROM (SELECT label, avg(vec_id * 37 % 101) AS x, avg(vec_id * 53 % 97) AS y FROM embeddings GROUP BY 1), (SELECT avg(x) AS mx, avg(y) AS my FROM (SELECT avg(vec_id * 37 % 101) AS x, avg(vec_id * 53 % 97) AS y FROM embeddings GROUP BY label))")
def g11(t: Tables) -> DataFrame:
    regions = places(t).groupBy("label").agg(F.avg("x").alias("x"), F.avg("y").alias("y"))
    root = regions.agg(F.avg("x").alias("mx"), F.avg("y").alias("my"))
    d = F.sqrt((F.col("x") - F.col("mx")) ** 2 + (F.col("y") - F.col("my")) ** 2)
    return regions.join(F.broadcast(root), F.lit(True)).select(F.col("label").alias("src"), F.lit(1000).alias("dst"), F.round(d, 6).alias("w"))


@query("g12_parent_wiring", "SELECT DISTINCT c_nationkey::INT AS label, n_regionkey::INT AS parent FROM customer JOIN nation ON c_nationkey = n_nationkey")
def g12(t: Tables) -> DataFrame:
    return t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_nationkey").alias("label"), F.col("n_regionkey").alias("parent")).distinct()


# --- grids ------------------------------------------------------------------------------


@query("r1_occupancy", "WITH b AS (SELECT min(value) AS x0, max(value) AS x1, min(user_id) AS y0, max(user_id) AS y1 FROM events) SELECT DISTINCT event_type, least(floor((user_id - y0) / 4.0), greatest(ceil((y1 - y0) / 4.0) - 1, 0))::BIGINT AS y, least(floor((value - x0) / 4.0), greatest(ceil((x1 - x0) / 4.0) - 1, 0))::BIGINT AS x FROM events, b")
def r1(t: Tables) -> DataFrame:
    return raster.occupancy(points(t), "event_type", 4.0)


CELLS = "cells AS (SELECT DISTINCT (event_id % 2)::BIGINT AS g, floor(user_id / 6)::BIGINT AS y, floor(value / 6)::BIGINT AS x FROM events)"


def cells(t: Tables) -> DataFrame:
    return t.events.select((F.col("event_id") % 2).alias("g"), F.floor(F.col("user_id") / 6).cast("long").alias("y"), F.floor(F.col("value") / 6).cast("long").alias("x")).distinct()


OFF = "off AS (SELECT a.dy, b.dx FROM (VALUES (-1), (0), (1)) a(dy), (VALUES (-1), (0), (1)) b(dx))"


@query("r2_opening", f"WITH {CELLS}, {OFF}, e AS (SELECT g, y + dy AS y, x + dx AS x FROM cells, off GROUP BY ALL HAVING count(*) = 9) SELECT DISTINCT g, (y + dy)::BIGINT AS y, (x + dx)::BIGINT AS x FROM e, off")
def r2(t: Tables) -> DataFrame:
    return raster.opening(cells(t), "g")


@query("r3_distance", f"WITH {CELLS}, b AS (SELECT g, min(y) - 1 AS y0, max(y) + 1 AS y1, min(x) - 1 AS x0, max(x) + 1 AS x1 FROM cells GROUP BY g), f AS (SELECT g, unnest(range(y0, y1 + 1)) AS y, x0, x1 FROM b), gr AS (SELECT g, y, unnest(range(x0, x1 + 1)) AS x FROM f), o AS (SELECT gr.* FROM gr ANTI JOIN cells c ON gr.g = c.g AND gr.y = c.y AND gr.x = c.x) SELECT c.g, c.y, c.x, round(min(sqrt((c.y - o.y) * (c.y - o.y) + (c.x - o.x) * (c.x - o.x))), 6) AS dist FROM cells c JOIN o ON c.g = o.g GROUP BY 1, 2, 3")
def r3(t: Tables) -> DataFrame:
    return cell_tables.distances(cells(t), "g").select("g", "y", "x", F.round("dist", 6).alias("dist"))


@query("r12_skeleton")
def r12(t: Tables) -> DataFrame:
    return raster.skeleton(cells(t), "g").select("g", "y", "x", "id", "is_edge", F.round("dist", 6).alias("dist"))


@query("r13_neighbor_counts", f"WITH {CELLS}, i AS (SELECT g, y, x, (y // 5) * 100 + x // 5 AS id, (y + x) % 2 = 0 AS is_edge FROM cells), s AS (SELECT * FROM (VALUES (0, -1), (0, 1), (-1, 0), (1, 0)) v(dy, dx)), m AS (SELECT a.g, a.id AS own, b.id AS other FROM i a, s, i b WHERE a.is_edge AND b.g = a.g AND b.y = a.y + dy AND b.x = a.x + dx AND a.id <> b.id), c AS (SELECT g, id, count(*) AS n FROM (SELECT g, unnest([own, other]) AS id FROM m) GROUP BY 1, 2) SELECT g, id::BIGINT AS id, coalesce(n, 0)::BIGINT AS n FROM (SELECT DISTINCT g, id FROM i) LEFT JOIN c USING (g, id)")
def r13(t: Tables) -> DataFrame:
    ids = cells(t).withColumn("id", (F.floor(F.col("y") / 5) * 100 + F.floor(F.col("x") / 5)).cast("long")).withColumn("is_edge", (F.col("y") + F.col("x")) % 2 == 0)
    return raster.neighbour_counts(ids, "g")


@query("r14_touching", f"WITH {CELLS}, i AS (SELECT g, y, x, (y // 5) * 100 + x // 5 AS id, (y + x) % 2 = 0 AS is_edge FROM cells), s AS (SELECT * FROM (VALUES (0, -1), (0, 1), (-1, 0), (1, 0)) v(dy, dx)) SELECT DISTINCT a.g, least(a.id, b.id)::BIGINT AS src, greatest(a.id, b.id)::BIGINT AS dst FROM i a, s, i b WHERE a.is_edge AND b.g = a.g AND b.y = a.y + dy AND b.x = a.x + dx AND a.id <> b.id")
def r14(t: Tables) -> DataFrame:
    ids = cells(t).withColumn("id", (F.floor(F.col("y") / 5) * 100 + F.floor(F.col("x") / 5)).cast("long")).withColumn("is_edge", (F.col("y") + F.col("x")) % 2 == 0)
    return raster.touching(ids, "g")


@query("r15_grid_to_world", f"WITH {CELLS} SELECT g, y AS row, x AS col, round((60 - y) * 0.4 + 2.5, 6) AS wy, round(x * 0.4 - 1.5, 6) AS wx FROM cells")
def r15(t: Tables) -> DataFrame:
    return cells(t).select("g", F.col("y").alias("row"), F.col("x").alias("col"), F.round((60 - F.col("y")) * 0.4 + 2.5, 6).alias("wy"), F.round(F.col("x") * 0.4 - 1.5, 6).alias("wx"))


# --- clusters -----------------------------------------------------------------------------


DB_POINTS = "p AS (SELECT event_id AS id, round(value, 3) AS x, user_id::DOUBLE AS y FROM events)"


@query("c2_dbscan", f"WITH RECURSIVE {DB_POINTS}, pr AS (SELECT a.id AS a, b.id AS b FROM p a JOIN p b ON (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 1.0), core AS (SELECT a FROM pr GROUP BY a HAVING count(*) >= 4), l AS (SELECT a, b FROM pr WHERE a IN (SELECT a FROM core) AND b IN (SELECT a FROM core)), reach(id, root) AS (SELECT a, a FROM core UNION SELECT l.b, reach.root FROM reach JOIN l ON l.a = reach.id), lab AS (SELECT id, min(root) AS c FROM reach GROUP BY id), bd AS (SELECT pr.a, min(lab.c) AS c FROM pr JOIN lab ON pr.b = lab.id GROUP BY 1) SELECT p.id, coalesce(lab.c, bd.c, -1) AS cluster FROM p LEFT JOIN lab ON lab.id = p.id LEFT JOIN bd ON bd.a = p.id")
def c2(t: Tables) -> DataFrame:
    p = t.events.select(F.col("event_id").alias("id"), F.round("value", 3).alias("x"), F.col("user_id").cast("double").alias("y"))
    return cluster.dbscan(p, "id", ["x", "y"], 1.0, 4).fillna(-1, ["cluster"])


@query("c1_mask_cluster")
def c1(t: Tables) -> DataFrame:
    p = t.events.select("event_type", F.col("event_id").alias("id"), "value", F.col("user_id").cast("double").alias("y"))
    return cluster.largest_cluster(p, "event_type", "id", ["value", "y"], 2.0, 4)


def scenes(t: Tables) -> DataFrame:
    return places(t).withColumn("scene", F.col("label") % 3)


@query("c3_linkage")
def c3(t: Tables) -> DataFrame:
    return cluster.linkage_of(scenes(t), "scene", "id", ["x", "y"], "emb", 5.0).select("scene", "step", "a", "b", F.round("distance", 4).alias("distance"), "size")


@query("c5_cut")
def c5(t: Tables) -> DataFrame:
    return cluster.layers_of(scenes(t), "scene", "id", ["x", "y"], "emb", 5.0, levels=3)


@query("c7_spectral")
def c7(t: Tables) -> DataFrame:
    return cluster.spectral_of(scenes(t), "scene", "id", ["x", "y"], "emb", 5.0, 400.0, 0.9)


@query("c10_aib")
def c10(t: Tables) -> DataFrame:
    from orrery.plans.queries_relational import scored

    s = scored(t, F.col("vec_id") < 5).groupBy(F.lit(0).alias("scene"), F.col("vec_id").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("q", "c"))), lambda x: x["c"]).alias("scores"))
    e = similar_edges(t, 0.25).select(F.lit(0).alias("scene"), "src", "dst")
    return cluster.bottleneck_of(s, e, "scene", 0.15, 2)


# --- streams, in batch form ------------------------------------------------------------------


@query("t6_best_frame", f"WITH {STAMPS}, lidar AS (SELECT DISTINCT ts FROM st WHERE event_type = 'view'), c AS (SELECT DISTINCT ts, event_type FROM st), n AS (SELECT l.ts, k.kind, b.ts AS t0 FROM lidar l CROSS JOIN (VALUES ('click'), ('purchase')) k(kind) ASOF LEFT JOIN c b ON b.event_type = k.kind AND b.ts <= l.ts), m AS (SELECT n.ts, n.kind, least(coalesce(n.ts - t0, 1e18), coalesce(a.ts - n.ts, 1e18)) AS gap FROM n ASOF LEFT JOIN c a ON a.event_type = n.kind AND a.ts >= n.ts), x AS (SELECT ts, max(gap) AS skew FROM m GROUP BY ts) SELECT ts, skew::BIGINT AS skew FROM x WHERE skew <= 900 ORDER BY skew, ts LIMIT 1")
def t6(t: Tables) -> DataFrame:
    from orrery.streaming.frames import best_of_buffer

    st = stamps(t)
    side = lambda k: st.where(F.col("event_type") == k).select("ts", F.col("ts").alias("stamp"))
    return best_of_buffer(st.where("event_type = 'view'").select("ts").distinct(), {k: side(k) for k in ("click", "purchase")}, 900).select("ts", F.col("skew").cast("long").alias("skew"))


@query("t7_incremental_counts", "SELECT user_id AS gidx, (event_id % 5)::BIGINT AS clip_id, count(*) AS cnt FROM events GROUP BY ALL")
def t7(t: Tables) -> DataFrame:
    """Counts of a stream that reads the events in one go, kept per batch and summed."""
    from orrery.operators.lineage import shared_dir
    from orrery.streaming.frames import incremental_counts, total_counts

    root = shared_dir(t.spark)
    t.events.select(F.col("user_id").alias("gidx"), (F.col("event_id") % 5).alias("clip_id")).repartition(4).write.parquet(f"{root}/in")
    stream = t.spark.readStream.schema("gidx long, clip_id long").option("maxFilesPerTrigger", 2).parquet(f"{root}/in")
    incremental_counts(stream, f"{root}/out", f"{root}/state").awaitTermination()
    return total_counts(t.spark, f"{root}/out")
