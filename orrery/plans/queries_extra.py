"""Saved scenes, streams and single expressions over the stand-in tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from orrery.functions import geometry as G, providers
from orrery.functions.vectors import cosine, euclid
from orrery.operators import aggregates as A, boxes, cells, cluster, evaluate as E, graph, raster, spatial
from orrery.operators.lineage import shared_dir, staged
from orrery.plans.queries_composed import GREEDY, OVERLAP, box_tables
from orrery.plans.queries_relational import CNT, EDGES, PTS, REGION, SCORED, VEC, counts, points, r6, scored, similar_edges, vecs
from orrery.plans.queries_spatial import CLOUD, PLACES, STAMPS, places, scan_and_cloud, stamps
from orrery.plans.tables import Tables, query
from orrery.sources import scene_files as S
from orrery.streaming import frames as T

# --- files and saved scenes ----------------------------------------------------------


@query("s4_synced_frames", "SELECT a.o_orderkey AS frame, l_linenumber::INT AS cam, round(o_totalprice, 2) AS scan, round(l_quantity, 2) AS image, c_acctbal AS shift FROM orders a JOIN lineitem ON l_orderkey = o_orderkey JOIN customer ON c_custkey = o_custkey")
def s4(t: Tables) -> DataFrame:
    """Orders as frames, their lines as images of cameras, their customers as transforms."""
    frames = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_orderkey").alias("frame"), F.col("o_orderkey").alias("lidar_ts"), F.col("l_linenumber").alias("cam"), F.monotonically_increasing_id().alias("image_ts"), "l_quantity", F.col("o_custkey").alias("transform_ts"))
    frames = staged(frames)  # line numbers repeat within an order: the stamp is the row's own
    images = frames.select("cam", "image_ts", F.col("l_quantity").alias("image"))
    transforms = frames.select("cam", "transform_ts").distinct().join(t.customer, F.col("transform_ts") == F.col("c_custkey")).select("cam", "transform_ts", F.col("c_acctbal").alias("shift"))
    out = S.synced_frames(frames.drop("l_quantity"), t.orders.select(F.col("o_orderkey").alias("lidar_ts"), F.col("o_totalprice").alias("scan")), images, transforms)
    return out.select("frame", F.col("cam").cast("int").alias("cam"), F.round("scan", 2).alias("scan"), F.round("image", 2).alias("image"), "shift")


@query("s6_resume_newest", "SELECT l_partkey AS gidx, l_suppkey AS clip_id, count(*) + 10 AS cnt, 10 AS itr FROM lineitem GROUP BY 1, 2")
def s6(t: Tables) -> DataFrame:
    """Counts saved at three iterations; the newest comes back."""
    folder = shared_dir(t.spark)
    for i in (1, 2, 10):
        S.save_iteration({"counts": counts(t).withColumn("cnt", F.col("cnt") + i)}, folder, i)
    itr, tables = S.load_iteration(t.spark, folder, ["counts"])
    return tables["counts"].select("gidx", "clip_id", "cnt", F.lit(itr).alias("itr"))


@query("s11_scene_round_trip", f"WITH {EDGES} SELECT src, dst, c AS weight, '0.3' AS above FROM edges")
def s11(t: Tables) -> DataFrame:
    """A scene and its parameters, saved and loaded."""
    folder = shared_dir(t.spark)
    S.save_scene({"nodes": vecs(t), "edges": similar_edges(t)}, {"above": 0.3}, folder)
    scene, params = S.load_scene(t.spark, folder)
    return scene["edges"].join(scene["nodes"].select(F.col("vec_id").alias("src")), "src").select("src", "dst", F.col("c").alias("weight"), F.lit(params["above"]).alias("above"))


@query("s12_scenes", "SELECT 'all' AS scene, label, count(*) AS n FROM embeddings GROUP BY 2 UNION ALL SELECT 'even', label, count(*) FROM embeddings WHERE vec_id % 2 = 0 GROUP BY 2")
def s12(t: Tables) -> DataFrame:
    folders = {name: shared_dir(t.spark) for name in ("all", "even")}
    for name, nodes in (("all", vecs(t)), ("even", vecs(t).where("vec_id % 2 = 0"))):
        S.save_scene({"nodes": nodes}, {}, folders[name])
    return S.load_scenes(t.spark, folders).groupBy("scene", "label").agg(F.count("*").alias("n"))


@query("s14_class_names", "SELECT vec_id, name FROM embeddings JOIN (VALUES (0, 'road'), (1, 'grass'), (2, 'water')) c(label, name) USING (label)")
def s14(t: Tables) -> DataFrame:
    names = S.class_names(t.spark, {0: ("road", (90, 90, 90)), 1: ("grass", (0, 200, 0)), 2: ("water", (0, 0, 200))})
    return vecs(t).join(F.broadcast(names), "label").select("vec_id", "name")


@query("s15_image_lists", "SELECT user_id % 3 AS cam, event_id, row_number() OVER (PARTITION BY user_id % 3 ORDER BY epoch_us(ts), event_id) AS place FROM events")
def s15(t: Tables) -> DataFrame:
    """Each camera's images by the stamp in their names."""
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    files = t.events.select("event_id", F.concat(F.lit("d/cam"), (F.col("user_id") % 3 + 1).cast("string"), F.lit("_img_"), F.floor(micros / 1_000_000).cast("string"), F.lit("."), F.lpad((micros % 1_000_000).cast("string"), 6, "0"), F.lit(".jpg")).alias("path"))
    cam, ts = S.camera_and_stamp(F.col("path"))
    order = W.partitionBy("cam").orderBy("stamp", "event_id")
    return files.select("event_id", cam.cast("long").alias("cam"), S.trailing_stamp(F.col("path")).alias("stamp")).withColumn("place", F.row_number().over(order).cast("long")).select("cam", "event_id", "place")


# --- points, vectors, expressions ------------------------------------------------------


@query("p2_into_camera", f"WITH {PTS} SELECT event_id, round(-y + 0.5, 6) + 0.0 AS u, round(-z + 1.25, 6) + 0.0 AS v, round(x - 2, 6) + 0.0 AS w FROM pts")
def p2(t: Tables) -> DataFrame:
    c = G.rigid([[0.0, -1.0, 0.0], [0.0, 0.0, -1.0], [1.0, 0.0, 0.0]], [0.5, 1.25, -2.0], [F.col("x"), F.col("y"), F.col("z")])
    return points(t).select("event_id", *[r6(v).alias(n) for n, v in zip("uvw", c)])


@query("p5_into_the_map", f"WITH {PTS}, q AS (SELECT event_id, x, y, z, (event_id % 7) / 10.0::DOUBLE AS a, (event_id % 5) / 10.0::DOUBLE AS b FROM pts), n AS (SELECT *, 2 / (a * a + b * b + 1) AS s FROM q) SELECT event_id, round((1 - s * (b * b + a * a) + s * a * a) * x + s * a * b * y + s * b * z + 1, 5) + 0.0 AS gx, round(s * a * b * x + (1 - s * a * a) * y - s * a * z + 2, 5) + 0.0 AS gy FROM n")
def p5(t: Tables) -> DataFrame:
    """By each row's own quaternion (a, b, 0, 1)."""
    a, b = (F.col("event_id") % 7) / 10.0, (F.col("event_id") % 5) / 10.0
    g = G.rigid(G.quaternion(a, b, F.lit(0.0), F.lit(1.0)), [1.0, 2.0, 3.0], [F.col("x"), F.col("y"), F.col("z")])
    return points(t).select("event_id", (F.round(g[0], 5) + F.lit(0.0)).alias("gx"), (F.round(g[1], 5) + F.lit(0.0)).alias("gy"))


@query("p9_semantic_split", f"WITH {CNT} SELECT p_partkey AS gidx, p_partkey IN (SELECT gidx FROM cnt WHERE n > 1) AS semantic FROM part")
def p9(t: Tables) -> DataFrame:
    pts, seen = t.part.select(F.col("p_partkey").alias("gidx")), counts(t).where("cnt > 1").select("gidx")
    return pts.join(seen, "gidx", "left_semi").withColumn("semantic", F.lit(True)).unionByName(pts.join(seen, "gidx", "left_anti").withColumn("semantic", F.lit(False)))


@query("p18_zero_votes", "SELECT p_size AS cluster, round(avg(s), 6) AS score FROM (SELECT p_size, CASE WHEN p_size % 3 = 0 THEN 0 ELSE p_retailprice END AS s FROM part) GROUP BY 1 HAVING avg(s) <> 0")
def p18(t: Tables) -> DataFrame:
    members = t.part.select(F.col("p_size").alias("cluster"), F.lit(0).cast("long").alias("task_idx"), F.array(F.when(F.col("p_size") % 3 == 0, 0.0).otherwise(F.col("p_retailprice"))).alias("scores"))
    return A.majority_vote(members, "cluster", "task_idx", "scores").where("top_score <> 0").select("cluster", F.round("top_score", 6).alias("score"))


@query("a9_medoid_vectors", f"WITH {CNT}, {VEC}, x AS (SELECT gidx, clip_id, n, e FROM cnt JOIN vec ON clip_id = vec_id), s AS (SELECT a.gidx, a.clip_id, round(sum(b.n * list_cosine_similarity(a.e, b.e)), 9) AS s FROM x a JOIN x b ON a.gidx = b.gidx GROUP BY 1, 2), m AS (SELECT gidx, arg_max(clip_id, (s, -clip_id)) AS clip_id FROM s GROUP BY 1) SELECT gidx, round(e[1], 6) + 0.0 AS first_dim, round(e[64], 6) + 0.0 AS last_dim FROM m JOIN vec ON clip_id = vec_id")
def a9(t: Tables) -> DataFrame:
    from orrery.plans.scene import point_vectors

    v = point_vectors({"counts": counts(t), "segments": vecs(t).select(F.col("vec_id").alias("clip_id"), "emb")}, "medoid")
    return v.select("gidx", r6(F.col("emb")[0]).alias("first_dim"), r6(F.col("emb")[63]).alias("last_dim"))


@query("a14_image_means", f"WITH {VEC.replace('label FROM', '(vec_id % 25)::INT AS label FROM')}, {REGION} SELECT label AS node, pos::BIGINT AS pos, round(v, 6) + 0.0 AS v FROM reg")
def a14(t: Tables) -> DataFrame:
    mean = A.weighted_mean(vecs(t).withColumn("node", (F.col("vec_id") % 25).cast("int")), "node", "emb")
    return mean.select("node", F.posexplode("emb").alias("pos", "v")).select("node", F.col("pos").cast("long").alias("pos"), r6(F.col("v")).alias("v"))


@query("w1_argmax", f"WITH {SCORED} SELECT vec_id, arg_max(q, (c, -q))::BIGINT AS q FROM s GROUP BY 1")
def w1(t: Tables) -> DataFrame:
    rows = scored(t, F.col("vec_id") < 8).groupBy("vec_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("q", "c"))), lambda x: x["c"]).alias("scores"))
    return rows.select("vec_id", (F.array_position("scores", F.array_max("scores")) - 1).cast("long").alias("q"))


@query("w6_order_by_distance", f"WITH {PLACES} SELECT id, row_number() OVER (PARTITION BY label ORDER BY x * x + y * y, id) AS place FROM pl")
def w6(t: Tables) -> DataFrame:
    far = euclid((F.col("x"), F.lit(0.0)), (F.col("y"), F.lit(0.0)))
    return places(t).withColumn("d", far).select("id", F.row_number().over(W.partitionBy("label").orderBy("d", "id")).cast("long").alias("place"))


@query("w8_fifty_nearest", f"WITH {CLOUD}, d AS (SELECT s.event_id AS pt, c.event_id AS gidx, (s.x - c.x) * (s.x - c.x) + (s.y - c.y) * (s.y - c.y) AS d2 FROM scan s, cloud c) SELECT pt, gidx, rank FROM (SELECT *, row_number() OVER (PARTITION BY pt ORDER BY d2, gidx) AS rank FROM d) WHERE rank <= 50")
def w8(t: Tables) -> DataFrame:
    scan, cloud = scan_and_cloud(t)
    return spatial.nearest(scan, cloud, "pt", "gidx", ["x", "y"], k=50).select("pt", "gidx", "rank")


@query("w11_largest_component", "WITH RECURSIVE e AS (SELECT DISTINCT n_nationkey::BIGINT AS a, (25 + n_regionkey)::BIGINT AS b FROM nation WHERE n_nationkey < 20), u AS (SELECT * FROM e UNION SELECT b, a FROM e), r(id, other) AS (SELECT a, b FROM u UNION SELECT r.id, u.b FROM r JOIN u ON r.other = u.a), c AS (SELECT id, least(id, min(other)) AS component FROM r GROUP BY 1), s AS (SELECT component, count(*) AS size FROM c GROUP BY 1) SELECT c.id, component, size FROM c JOIN s USING (component) QUALIFY dense_rank() OVER (ORDER BY size DESC, component) = 1")
def w11(t: Tables) -> DataFrame:
    edges = t.nation.where("n_nationkey < 20").select(F.col("n_nationkey").cast("long").alias("src"), (F.lit(25) + F.col("n_regionkey")).cast("long").alias("dst"))
    nodes = edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    return graph.largest(nodes, edges, 1).select("id", "component", "size")


@query("u2_matched_points", "SELECT DISTINCT l_partkey AS gidx FROM lineitem WHERE l_quantity > 49 OR l_discount > 0.09")
def u2(t: Tables) -> DataFrame:
    at = lambda c: t.lineitem.where(c).select(F.col("l_partkey").alias("gidx"))
    return at("l_quantity > 49").unionByName(at("l_discount > 0.09")).distinct()


@query("f1_cosine", f"WITH {VEC} SELECT a.vec_id, round(list_cosine_similarity(a.e, b.e), 9) AS c FROM vec a JOIN vec b ON b.vec_id = a.vec_id + 1")
def f1(t: Tables) -> DataFrame:
    b = vecs(t).select((F.col("vec_id") - 1).alias("vec_id"), F.col("emb").alias("other"))
    return vecs(t).join(b, "vec_id").select("vec_id", F.round(cosine(F.col("emb"), F.col("other")), 9).alias("c"))


@query("f3_euclid", f"WITH {PTS} SELECT event_id, round(sqrt((x - 1) * (x - 1) + (y - 2) * (y - 2) + (z - 3) * (z - 3)), 6) AS d FROM pts")
def f3(t: Tables) -> DataFrame:
    return points(t).select("event_id", F.round(euclid((F.col("x"), F.lit(1.0)), (F.col("y"), F.lit(2.0)), (F.col("z"), F.lit(3.0))), 6).alias("d"))


@query("f8_merge_cost", "WITH p AS (SELECT p_partkey, (p_size % 9 + 1) / 10.0::DOUBLE AS a, (p_partkey % 9 + 1) / 10.0::DOUBLE AS b, 0.25 AS wa, 0.5 AS wb FROM part), m AS (SELECT *, (wa * a + wb * b) / 0.75 AS c FROM p), h AS (SELECT *, -(c * log2(c) + (1 - c) * log2(1 - c)) AS hc, -(a * log2(a) + (1 - a) * log2(1 - a)) AS ha, -(b * log2(b) + (1 - b) * log2(1 - b)) AS hb FROM (SELECT p_partkey, a, b, wa, wb, CASE WHEN c = 1 THEN 0.9999999 ELSE c END AS c FROM m)) SELECT p_partkey, round(0.75 * (hc - (wa * ha + wb * hb) / 0.75), 6) + 0.0 AS cost FROM h")
def f8(t: Tables) -> DataFrame:
    """(p1 + p2) times the divergence of two classes of the conditional distributions."""
    two = lambda p: F.array(p, 1.0 - p)
    a, b = (F.col("p_size") % 9 + 1) / 10.0, (F.col("p_partkey") % 9 + 1) / 10.0
    return t.part.select("p_partkey", r6(F.lit(0.75) * G.jensen_shannon(two(a), two(b), F.lit(0.25) / 0.75, F.lit(0.5) / 0.75)).alias("cost"))


@query("f12_moved_nodes", f"WITH {PLACES} SELECT id, round(-y + 3, 6) + 0.0 AS x, round(x - 4, 6) + 0.0 AS y FROM pl")
def f12(t: Tables) -> DataFrame:
    """Plan positions lifted to z = 0, moved, and z dropped."""
    g = G.rigid([[0.0, -1.0, 0.0], [1.0, 0.0, 0.0], [0.0, 0.0, 1.0]], [3.0, -4.0, 7.0], [F.col("x"), F.col("y"), F.lit(0.0)])
    return places(t).select("id", r6(g[0]).alias("x"), r6(g[1]).alias("y"))


@query("f14_half_extents", "WITH p AS (SELECT p_partkey, (p_size + 10)::DOUBLE AS wx, (p_partkey % 7 + 20)::DOUBLE AS wy, (p_size % 3)::DOUBLE AS wz FROM part) SELECT p_partkey, round(greatest((0.8 * wx - 0.6 * wy) / 0.28, 0), 5) + 0.0 AS hx, round(greatest((0.8 * wy - 0.6 * wx) / 0.28, 0), 5) + 0.0 AS hy, round(wz, 5) + 0.0 AS hz FROM p")
def f14(t: Tables) -> DataFrame:
    import numpy as np
    import pandas as pd

    r = np.array([[0.8, -0.6, 0.0], [0.6, 0.8, 0.0], [0.0, 0.0, 1.0]])

    def solve(batches):
        for pdf in batches:
            h = np.array([boxes.half_extents(w, r) for w in pdf[["wx", "wy", "wz"]].to_numpy()]).reshape(-1, 3)
            yield pd.DataFrame({"p_partkey": pdf["p_partkey"], "hx": h[:, 0], "hy": h[:, 1], "hz": h[:, 2]})

    world = t.part.select("p_partkey", (F.col("p_size") + 10).cast("double").alias("wx"), (F.col("p_partkey") % 7 + 20).cast("double").alias("wy"), (F.col("p_size") % 3).cast("double").alias("wz"))
    out = world.mapInPandas(solve, "p_partkey long, hx double, hy double, hz double")
    return out.select("p_partkey", *[(F.round(c, 5) + F.lit(0.0)).alias(c) for c in ("hx", "hy", "hz")])


@query("f18_box_edges", "SELECT p_partkey, 12::BIGINT AS n, round(4.0 * (p_size + 1 + p_partkey % 5 + 2 + 3), 6)::DOUBLE AS length FROM part")
def f18(t: Tables) -> DataFrame:
    import numpy as np
    import pandas as pd

    r = np.array([[0.8, -0.6, 0.0], [0.6, 0.8, 0.0], [0.0, 0.0, 1.0]])

    def solve(batches):
        for pdf in batches:
            signs = boxes.corners(np.zeros(3), np.ones(3), np.eye(3))[[3, 1, 4, 0, 7, 6, 2, 5]]
            c = (signs * pdf[["ex", "ey", "ez"]].to_numpy()[:, None]) @ r.T
            sides = boxes.edge_marks(c)
            yield pd.DataFrame({"p_partkey": pdf["p_partkey"], "n": sides.sum(1), "length": (boxes.pair_lengths(c) * sides).sum(1)})

    extents = t.part.select("p_partkey", (F.col("p_size") + 1).cast("double").alias("ex"), (F.col("p_partkey") % 5 + 2).cast("double").alias("ey"), F.lit(3.0).alias("ez"))
    return extents.mapInPandas(solve, "p_partkey long, n long, length double").select("p_partkey", "n", F.round("length", 6).alias("length"))


@query("f22_math", "SELECT event_id, floor(value)::BIGINT AS lo, ceil(value)::BIGINT AS hi, round_even(value, 0)::DOUBLE AS even, round(greatest(10, least(value, 60)), 6) AS clipped, round(log2(value + 1), 6) AS bits FROM events")
def f22(t: Tables) -> DataFrame:
    v = F.col("value")
    return t.events.select("event_id", F.floor(v).cast("long").alias("lo"), F.ceil(v).cast("long").alias("hi"), F.rint(v).alias("even"), F.round(F.greatest(F.lit(10.0), F.least(v, F.lit(60.0))), 6).alias("clipped"), F.round(F.log2(v + 1), 6).alias("bits"))


@query("f23_maps", "WITH c AS (SELECT l_partkey AS gidx, l_linenumber AS k, count(*) AS n FROM lineitem GROUP BY 1, 2) SELECT gidx, count(*) AS n_keys, coalesce(max(n) FILTER (k = 7), 0)::BIGINT AS of_seven, arg_max(k, (n, -k))::INT AS most FROM c GROUP BY 1")
def f23(t: Tables) -> DataFrame:
    c = t.lineitem.groupBy(F.col("l_partkey").alias("gidx"), F.col("l_linenumber").alias("k")).agg(F.count("*").alias("n"))
    m = c.groupBy("gidx").agg(F.map_from_entries(F.collect_list(F.struct("k", "n"))).alias("m"))
    at = F.array_sort(F.map_entries("m"))
    most = F.element_at(at, F.array_position(F.transform(at, lambda e: e["value"]), F.array_max(F.map_values("m"))).cast("int"))["key"]
    return m.select("gidx", F.size("m").cast("long").alias("n_keys"), F.coalesce(F.try_element_at("m", F.lit(7)), F.lit(0)).cast("long").alias("of_seven"), most.cast("int").alias("most"))


@query("f25_world_frames", f"WITH {PTS} SELECT event_id, round(y + 5, 6) + 0.0 AS sx, round(-x - 10, 6) + 0.0 AS sy, round(x + 5, 6) + 0.0 AS dx, round(y - 27, 6) + 0.0 AS dy, round(z + 8.49, 6) + 0.0 AS z FROM pts")
def f25(t: Tables) -> DataFrame:
    p = [F.col("x"), F.col("y"), F.col("z")]
    s, d = G.to_world("sparse", p), G.to_world("dense", p)
    return points(t).select("event_id", r6(s[0]).alias("sx"), r6(s[1]).alias("sy"), r6(d[0]).alias("dx"), r6(d[1]).alias("dy"), r6(d[2]).alias("z"))


@query("g13_degrees", f"WITH {EDGES}, d AS (SELECT unnest([src, dst]) AS id FROM edges) SELECT id, count(*) AS degree FROM d GROUP BY 1")
def g13(t: Tables) -> DataFrame:
    return graph.degrees(similar_edges(t))


@query("g14_weight_matrix", f"WITH {PLACES} SELECT a.label AS scene, a.id AS src, b.id AS dst, CASE WHEN a.id = b.id THEN 0 ELSE round(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) + 1 - least(list_cosine_similarity(a.e, b.e), 1), 6) END AS weight FROM pl a JOIN pl b ON a.label = b.label")
def g14(t: Tables) -> DataFrame:
    """Each scene's dense matrix as rows, its diagonal 0; labels are the scenes."""
    out = cluster.weight_rows(places(t).where("label IS NOT NULL"), "label", "id", ["x", "y"], "emb", 1.0)
    return out.select(F.col("label").alias("scene"), "src", "dst", F.round("weight", 6).alias("weight"))


@query("m1_looked_up", f"WITH {VEC} SELECT s_suppkey, round(e[1], 6) + 0.0 AS first_dim FROM supplier LEFT JOIN vec ON vec_id = s_suppkey * 11")
def m1(t: Tables) -> DataFrame:
    """Results of a model as a table; inputs that are not in it get null."""
    known = vecs(t).select(F.col("vec_id").alias("input"), "emb")
    return providers.looked_up(t.supplier.select("s_suppkey", (F.col("s_suppkey") * 11).alias("input")), known, "input").select("s_suppkey", r6(F.col("emb")[0]).alias("first_dim"))


#: Cells that few events fall in are obstacles; of each cell of the grid the nearest obstacle, the lower one of equals.
NEAREST = "free AS (SELECT (event_id % 2)::BIGINT AS g, floor(user_id / 6)::BIGINT AS y, floor(value / 6)::BIGINT AS x FROM events WHERE (floor(user_id / 6) * 7 + floor(value / 6) * 3) % 11 <> 0 GROUP BY ALL), bd AS (SELECT g, min(y) - 1 AS y0, max(y) + 1 AS y1, min(x) - 1 AS x0, max(x) + 1 AS x1 FROM free GROUP BY g), gy AS (SELECT g, unnest(range(y0, y1 + 1)) AS y, x0, x1 FROM bd), gr AS (SELECT g, y, unnest(range(x0, x1 + 1)) AS x FROM gy), ob AS (SELECT gr.* FROM gr ANTI JOIN free USING (g, y, x)), nr AS (SELECT gr.g, gr.y, gr.x, min((gr.y - ob.y) ** 2 + (gr.x - ob.x) ** 2) AS d2, arg_min({'y': ob.y, 'x': ob.x}, ((gr.y - ob.y) ** 2 + (gr.x - ob.x) ** 2, ob.y, ob.x)) AS o FROM gr JOIN ob USING (g) GROUP BY 1, 2, 3)"


@query("r4_middle_lines", f"WITH {NEAREST}, st AS (SELECT * FROM (VALUES (0, 1), (1, 0), (1, 1), (1, -1)) v(dy, dx)), pr AS (SELECT a.g, a.y AS ay, a.x AS ax, b.y AS byy, b.x AS bx, (a.y - b.o.y) ** 2 + (a.x - b.o.x) ** 2 AS ca, (b.y - a.o.y) ** 2 + (b.x - a.o.x) ** 2 AS cb FROM nr a, st, nr b WHERE b.g = a.g AND b.y = a.y + dy AND b.x = a.x + dx AND (a.d2 > 1 OR b.d2 > 1) AND (abs(a.o.y - b.o.y) > 1 OR abs(a.o.x - b.o.x) > 1)) SELECT g, ay AS y, ax AS x FROM pr WHERE ca <= cb UNION SELECT g, byy, bx FROM pr WHERE cb <= ca")
def r4(t: Tables) -> DataFrame:
    y, x = F.floor(F.col("user_id") / 6), F.floor(F.col("value") / 6)
    free = t.events.where((y * 7 + x * 3) % 11 != 0).select((F.col("event_id") % 2).alias("g"), y.cast("long").alias("y"), x.cast("long").alias("x")).distinct()
    return cells.middle_lines(free, "g")


# --- evaluations -----------------------------------------------------------------------


@query("e10_sampled_overlap", f"WITH {OVERLAP} SELECT task, gt, pred, TRUE AS near FROM ov WHERE i > 1e-3")
def e10(t: Tables) -> DataFrame:
    """The sampled overlap of every two boxes of a task that meet lies near the exact one."""
    truth, found = box_tables(t)
    return boxes.overlaps(truth, found, "task", boxed=False, sampled=True).select("task", "gt", "pred", (F.abs(F.col("sampled") - F.col("iou")) < 0.03).alias("near"))


@query("e2_micro_totals", f"WITH {SCORED} SELECT count(*) FILTER (c > 0.2 AND label = q) AS tp, count(*) FILTER (c > 0.2 AND label <> q) AS fp, count(*) FILTER (c <= 0.2 AND label = q) AS fn FROM s")
def e2(t: Tables) -> DataFrame:
    s = scored(t, F.col("vec_id") < 8)
    per = E.confusion(s.where("c > 0.2"), s.where("label = q"), ["q", "vec_id"], ["q"])
    return per.agg(*[F.sum(c).cast("long").alias(c) for c in ("tp", "fp", "fn")])


@query("e6_box_precision", f"WITH RECURSIVE {GREEDY}, m AS (SELECT rk.* FROM fin JOIN rk ON rk.task = fin.task AND rk.gt = fin.gt AND rk.pred = fin.pred), n AS (SELECT count(*) AS n FROM bx WHERE id % 2 = 1), s AS (SELECT count(*) FILTER (gin) / (SELECT n FROM n) AS p, count(*) FILTER (gin) / (SELECT count(*) FROM bx WHERE id % 2 = 0) AS r, count(*) FILTER (gin AND pin) / (SELECT n FROM n) AS strict FROM m) SELECT round(p, 6) AS relaxed, round(strict, 6) AS strict, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f1 FROM s")
def e6(t: Tables) -> DataFrame:
    """Shares of the found boxes that match, and F1 of the relaxed one with the relaxed accuracy."""
    truth, found = box_tables(t)
    pairs = staged(boxes.matched(truth, found, "task"))
    precision = E.box_precision(pairs, found)
    both = precision.crossJoin(E.box_scores(pairs, truth).select(F.col("relaxed").alias("r")))  # a row each
    return both.select(F.round("relaxed", 6).alias("relaxed"), F.round("strict", 6).alias("strict"), F.round(E.f1(F.col("relaxed"), F.col("r")), 6).alias("f1"))


@query("e15_growth", "SELECT o_orderpriority AS dataset, count(*) AS n_nodes, round(sum(o_totalprice) / 1e6, 4) AS size_mb, round(count(*) / count(DISTINCT o_custkey), 6) AS nodes_per_area FROM orders GROUP BY 1")
def e15(t: Tables) -> DataFrame:
    runs = t.orders.groupBy(F.col("o_orderpriority").alias("dataset")).agg(F.count("*").alias("n_nodes"), (F.sum("o_totalprice") / 1e6).alias("size_mb"), F.countDistinct("o_custkey").alias("a"), F.lit(1).alias("cameras"), F.lit(2.0).alias("length"))
    return E.growth(runs, F.col("a")).select("dataset", "n_nodes", F.round("size_mb", 4).alias("size_mb"), F.round("nodes_per_area", 6).alias("nodes_per_area"))


# --- streams -----------------------------------------------------------------------------


def as_stream(t: Tables, rows: DataFrame, files: int, per_tick: int = 1) -> tuple[DataFrame, str]:
    """The rows as a folder of files that is read as a stream, and a folder for its results."""
    root = shared_dir(t.spark)
    rows.repartition(files).write.parquet(f"{root}/in")
    return T.source(t.spark, f"{root}/in", rows.schema.simpleString()[7:-1].replace(":", " "), per_tick), root


@query("t1_replay_and_save", "SELECT event_id, user_id, event_type FROM events")
def t1(t: Tables) -> DataFrame:
    """A folder replayed two files a tick, every row saved on arrival."""
    stream, root = as_stream(t, t.events.select("event_id", "user_id", "event_type"), 5, 2)
    T.save_on_arrival(stream, f"{root}/out", f"{root}/state").awaitTermination()
    return t.spark.read.parquet(f"{root}/out").select("event_id", "user_id", "event_type")


@query("t3_latest_pose", "SELECT event_id, (SELECT arg_max(value, event_id) FROM events WHERE event_type = 'signup') AS pose FROM events WHERE event_type = 'view'")
def t3(t: Tables) -> DataFrame:
    poses = t.events.where("event_type = 'signup'").select(F.col("event_id").alias("ts"), "value")
    return T.with_latest(t.events.where("event_type = 'view'").select("event_id"), poses).select("event_id", F.col("pose.value").alias("pose"))


@query("t5_tick_buffers", f"WITH {STAMPS}, v AS (SELECT DISTINCT ts FROM st WHERE event_type = 'view'), c AS (SELECT DISTINCT ts FROM st WHERE event_type = 'click'), b AS (SELECT v.ts, c.ts AS t0 FROM v ASOF LEFT JOIN c ON c.ts <= v.ts), g AS (SELECT b.ts, least(coalesce(b.ts - t0, 1e18), coalesce(c.ts - b.ts, 1e18)) AS gap FROM b ASOF LEFT JOIN c ON c.ts >= b.ts) SELECT ts, gap::BIGINT AS skew FROM g WHERE gap <= 900 ORDER BY gap, ts LIMIT 1")
def t5(t: Tables) -> DataFrame:
    """T5, T6 as a stream of one tick: the buffer's best scan."""
    rows = stamps(t).where("event_type IN ('view', 'click')").select(F.when(F.col("event_type") == "view", "lidar").otherwise("click").alias("stream"), "ts").distinct()
    stream, root = as_stream(t, rows, 1)
    T.aligned_ticks(stream, ("click",), 900, lambda best, tick: best.write.mode("overwrite").parquet(f"{root}/out/tick={tick}"), f"{root}/state").awaitTermination()
    return t.spark.read.parquet(f"{root}/out").select("ts", F.col("skew").cast("long").alias("skew"))


@query("t8_resumed_counts", "SELECT user_id AS gidx, (event_id % 5)::BIGINT AS clip_id, count(*) AS cnt FROM events GROUP BY ALL")
def t8(t: Tables) -> DataFrame:
    """A stream that stops, gets more input and resumes where it was; nothing counts twice."""
    rows = t.events.select(F.col("user_id").alias("gidx"), (F.col("event_id") % 5).alias("clip_id"), "event_id")
    stream, root = as_stream(t, rows.where("event_id % 2 = 0").drop("event_id"), 2)
    T.incremental_counts(stream, f"{root}/out", f"{root}/state").awaitTermination()
    rows.where("event_id % 2 = 1").drop("event_id").repartition(3).write.mode("append").parquet(f"{root}/in")
    again = T.source(t.spark, f"{root}/in", "gidx long, clip_id long")
    T.incremental_counts(again, f"{root}/out", f"{root}/state").awaitTermination()
    return T.total_counts(t.spark, f"{root}/out")


@query("t10_running_length", "WITH d AS (SELECT user_id, event_id, value, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events) SELECT user_id, round(sum(coalesce(abs(value - p), 0)), 4) AS length FROM d GROUP BY 1")
def t10(t: Tables) -> DataFrame:
    """The stateful sum over a stream of positions; its last value for each key."""
    rows = t.events.select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("x"), F.lit(0.0).alias("y"))
    stream, root = as_stream(t, rows, 1)
    T.running_length(stream, "user_id", order=["event_id"]).writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start().awaitTermination()
    return t.spark.read.parquet(f"{root}/out").groupBy("user_id").agg(F.round(F.max("length"), 4).alias("length"))
