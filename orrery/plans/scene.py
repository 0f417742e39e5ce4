"""The three kinds of question over a scene: objects, regions, paths (Q1-Q14); and how its layers are built.

A scene is a dict of DataFrames: ``points`` (gidx, x, y, z), ``counts`` (gidx,
clip_id, cnt), ``segments`` (clip_id, emb), ``nodes`` (id, level, x, y, emb,
surface) and ``edges`` (src, dst, weight).  Queries are (q_idx, emb), the surface
classes first, then tasks; a query is a handful of rows and their number is
checked before they go to every task.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from orrery.functions.geometry import surface_cost
from orrery.functions.vectors import cosine, edge_weight
from orrery.operators import aggregates as A, boxes, cluster, graph, groups, similarity, spatial
from orrery.operators.lineage import numbered

QUERY_ROWS = 10_000


@dataclass(frozen=True)
class Params:
    """Thresholds of object and region questions; names of methods as in METHODS."""

    n_surface: int = 0
    alpha: float = 0.25
    trim: float = 0.2
    radius: float = 0.5
    eps: float = 1.0
    min_samples: int = 4
    zone_radius: float = 10.0
    bounds: tuple[tuple[float, float], ...] = ((-1e9, 1e9),) * 3
    k: int = 3
    offset: int = 0


# --- vectors of points ---------------------------------------------------------------


def point_vectors(scene: dict[str, DataFrame], how: str, trim: float = 0.2) -> DataFrame:
    """(gidx, emb) of every point that shows a segment."""
    shown = (scene["counts"], scene["segments"], "gidx", "clip_id", "emb", "cnt")
    if how == "avg":
        return groups.weighted_means(*shown)
    if how == "medoid":
        return groups.medoids(*shown).join(scene["segments"], "clip_id").select("gidx", "emb")
    if how == "trim":
        return groups.trimmed_means(*shown, trim).where("emb IS NOT NULL")
    if how == "geomedian":
        return groups.geometric_medians(*shown)
    if how == "max":
        return A.mode(scene["counts"], "gidx", "clip_id", "cnt").join(scene["segments"], "clip_id").select("gidx", "emb")
    raise ValueError(f"no way {how!r} to summarise segments")


def with_scores(rows: DataFrame, queries: DataFrame) -> DataFrame:
    """Rows with ``scores``, their cosines to all queries in order of q_idx.

    The queries become one row of arrays, so scoring is a projection: no shuffle and
    no row for each pair.
    """
    n = queries.limit(QUERY_ROWS + 1).count()
    if n > QUERY_ROWS:
        raise ValueError(f"more than {QUERY_ROWS} queries at once")
    one = queries.agg(F.transform(F.array_sort(F.collect_list(F.struct("q_idx", "emb"))), lambda q: q["emb"]).alias("_queries"))
    return rows.join(F.broadcast(one), F.lit(True)).withColumn("scores", F.transform("_queries", lambda q: F.round(cosine(F.col("emb"), q), 9))).drop("_queries")


def relevant(rows: DataFrame, queries: DataFrame, n_surface: int, alpha: float) -> DataFrame:
    """Rows whose best query is a task and exceeds alpha, with ``task_idx`` (from 0) and the tasks' ``scores``."""
    scored = with_scores(rows, queries).withColumn("top", F.array_max("scores"))
    best = F.array_position("scores", F.col("top")) - 1
    out = scored.where((best >= n_surface) & (F.col("top") > alpha)).withColumn("task_idx", (best - n_surface).cast("long"))
    return out.withColumn("scores", F.slice("scores", n_surface + 1, F.size("scores") - n_surface))


def tasks_only(queries: DataFrame, n_surface: int) -> DataFrame:
    return queries.where(F.col("q_idx") >= n_surface).withColumn("q_idx", F.col("q_idx") - n_surface)


# --- regions and places ----------------------------------------------------------------


def node_scores(nodes: DataFrame, tasks: DataFrame) -> DataFrame:
    """(id, level, task_idx, score)"""
    scored = with_scores(nodes.where("emb IS NOT NULL"), tasks)
    return scored.select("id", "level", F.posexplode("scores").alias("task_idx", "score")).withColumn("task_idx", F.col("task_idx").cast("long"))


def chosen_regions(scene: dict[str, DataFrame], tasks: DataFrame, alpha: float) -> DataFrame:
    """(task_idx, id): bottom regions below the task's regions above alpha in the layer of its best region (all of that layer if none)."""
    scores = node_scores(scene["nodes"].where("level > 1"), tasks)
    best = scores.groupBy("task_idx").agg(F.max(F.struct("score", (-F.col("id")).alias("neg"), "level")).alias("b")).select("task_idx", F.col("b.level").alias("level"))
    layer = scores.join(best, ["task_idx", "level"]).withColumn("good", F.col("score") > alpha)
    start = layer.withColumn("any", F.max("good").over(W.partitionBy("task_idx"))).where("good OR NOT any").select("task_idx", F.col("id").alias("root"))
    below = graph.bottom_regions(scene["nodes"], scene["edges"], start.select("root").distinct())
    return start.join(below, "root").select("task_idx", "id").distinct()


def chosen_places(scene: dict[str, DataFrame], regions: DataFrame, tasks: DataFrame, alpha: float) -> DataFrame:
    """(task_idx, id): the regions' places above alpha; all of them for a task that has none."""
    kids = regions.join(graph.children(scene["nodes"], scene["edges"]), F.col("id") == F.col("region")).select("task_idx", F.col("place").alias("id")).distinct()
    scores = node_scores(scene["nodes"].where("level = 1"), tasks).select("task_idx", "id", "score")
    rated = kids.join(scores, ["task_idx", "id"], "left").withColumn("good", F.coalesce(F.col("score") > alpha, F.lit(False)))
    return rated.withColumn("any", F.max("good").over(W.partitionBy("task_idx"))).where("good OR NOT any").select("task_idx", "id")


def zones(scene: dict[str, DataFrame], places: DataFrame, radius: float) -> DataFrame:
    """(task_idx, gidx): points within ``radius`` (in plan) of a task's places."""
    near = places.join(scene["nodes"].select("id", "x", "y"), "id").select("task_idx", "id", "x", "y")
    cloud = scene["points"].select("gidx", "x", "y")
    spots = spatial.radius_join(near.select("task_idx", "x", "y").distinct(), cloud.select("x", "y").distinct(), radius, ["x", "y"]).select("l.task_idx", "r.x", "r.y").distinct()
    return cloud.join(spots, ["x", "y"]).select("task_idx", "gidx").distinct()


# --- objects ----------------------------------------------------------------------------


def objects_of(scene: dict[str, DataFrame], hits: DataFrame, p: Params) -> DataFrame:
    """Q7: boxes of the density clusters around the matched points ``hits`` (gidx, task_idx, scores).

    (object, task_idx, top_score, scores, n_points, box columns); empty if nothing matched.
    """
    cloud = scene["points"].select("gidx", "x", "y", "z")
    at = ["x", "y", "z"]
    hit = cloud.join(hits.select("gidx"), "gidx", "left_semi").select(*at).distinct()  # positions meet: copies at one of them are around together
    around = cloud.join(spatial.radius_join(hit, cloud.select(*at).distinct(), p.radius, at).select("r.*").distinct(), at, "left_semi").distinct().select("gidx", *at)
    label = cluster.dbscan(around, "gidx", ["x", "y", "z"], p.eps, p.min_samples).where("cluster IS NOT NULL")
    members = around.join(label, "gidx")
    large = members.groupBy("cluster").agg(F.count("*").alias("n_points")).where("n_points >= 4")
    votes = A.majority_vote(members.join(hits, "gidx").select("cluster", "task_idx", "scores"), "cluster", "task_idx", "scores").where("top_score <> 0")
    box = boxes.cluster_boxes(members, "cluster")
    out = votes.join(large, "cluster").join(box, "cluster")
    for c, (lo, hi) in zip(("cx", "cy", "cz"), p.bounds):
        out = out.where(F.col(c).between(lo, hi))
    return out.select(F.col("cluster").alias("object"), (F.col("task_idx") + p.offset).alias("task_idx"), "top_score", "scores", "n_points", *("cx", "cy", "cz", "ex", "ey", "ez", "r"))


def matched_points(scene: dict[str, DataFrame], queries: DataFrame, method: str, p: Params) -> DataFrame:
    """Q1-Q6: (gidx, task_idx, scores) of the points that a method finds relevant."""
    layered, how = method.startswith("3dsg_"), method.split("_", 1)[1]
    found = relevant(point_vectors(scene, how, p.trim), queries, p.n_surface, p.alpha).select("gidx", "task_idx", "scores")
    if not layered:
        return found
    tasks = tasks_only(queries, p.n_surface)
    zone = zones(scene, chosen_places(scene, chosen_regions(scene, tasks, p.alpha), tasks, p.alpha), p.zone_radius)
    if how == "max":  # J15: any zone will do
        return found.join(zone.select("gidx").distinct(), "gidx", "left_semi")
    over = found.select("gidx", F.posexplode("scores").alias("t", "s")).where(F.col("s") > p.alpha).select("gidx", F.col("t").cast("long").alias("task_idx"))
    return found.join(over.join(zone, ["gidx", "task_idx"], "left_semi").select("gidx").distinct(), "gidx", "left_semi")


METHODS: dict[str, str] = {m: m for m in ("ms_avg", "ms_max", "ms_medoid", "ms_trim", "ms_geomedian", "3dsg_avg", "3dsg_max")} | {"3dsg": "3dsg_avg"}


def predict_objects(scene: dict[str, DataFrame], queries: DataFrame, method: str = "ms_avg", params: Params = Params()) -> DataFrame:
    """Q1-Q7: objects relevant to each task."""
    if method not in METHODS:
        raise ValueError(f"method must be one of {sorted(METHODS)}, not {method!r}")
    return objects_of(scene, matched_points(scene, queries, METHODS[method], params), params)


def attach_objects(nodes: DataFrame, objects: DataFrame, key: str = "obj") -> tuple[DataFrame, DataFrame]:
    """Object nodes (level 0, ids after the largest) and an edge without weight from each to its nearest place (in plan)."""
    top = nodes.agg(F.max("id").alias("top"))
    ids = numbered(objects, key, "_n").join(F.broadcast(top), F.lit(True)).withColumn("id", F.col("top") + F.col("_n")).drop("top", "_n")
    near = spatial.nearest(ids.select(F.col("id").alias("src"), "x", "y"), nodes.where("level = 1").select(F.col("id").alias("dst"), "x", "y"), "src", "dst", ["x", "y"])
    return ids.select("id", F.lit(0).alias("level"), "x", "y", "z"), near.select("src", "dst", F.lit(None).cast("double").alias("weight"))


# --- regions ------------------------------------------------------------------------------


def top_regions(scene: dict[str, DataFrame], tasks: DataFrame, k: int) -> DataFrame:
    """(task_idx, root): each task's k best regions of any layer, ties to the least id; all if there are fewer."""
    scores = node_scores(scene["nodes"].where("level > 1"), tasks)
    rank = F.row_number().over(W.partitionBy("task_idx").orderBy(F.desc("score"), "id"))
    return scores.withColumn("r", rank).where(F.col("r") <= k).select("task_idx", F.col("id").alias("root"))


def _below(scene: dict[str, DataFrame], roots: DataFrame) -> DataFrame:
    down = graph.descend(scene["nodes"], scene["edges"], roots.select("root").distinct())
    return roots.join(down, "root").select("task_idx", F.col("id").alias("place_id")).distinct()


def _above(scene: dict[str, DataFrame], tasks: DataFrame, places: DataFrame, alpha: float) -> DataFrame:
    scores = node_scores(scene["nodes"].where("level = 1"), tasks).where(F.col("score") > alpha)
    return places.join(scores.select("task_idx", F.col("id").alias("place_id")), ["task_idx", "place_id"], "left_semi")


def regions_max(scene: dict[str, DataFrame], tasks: DataFrame, p: Params) -> DataFrame:
    """Q8"""
    return _below(scene, top_regions(scene, tasks, p.k))


def regions_thresh(scene: dict[str, DataFrame], tasks: DataFrame, p: Params) -> DataFrame:
    """Q9a"""
    roots = node_scores(scene["nodes"].where("level > 1"), tasks).where(F.col("score") > p.alpha).select("task_idx", F.col("id").alias("root"))
    return _above(scene, tasks, _below(scene, roots), p.alpha)


def regions_mix(scene: dict[str, DataFrame], tasks: DataFrame, p: Params) -> DataFrame:
    """Q9b"""
    return _above(scene, tasks, regions_max(scene, tasks, p), p.alpha)


def regions_aib(scene: dict[str, DataFrame], tasks: DataFrame, p: Params, expand: bool = False) -> DataFrame:
    """Q10: representatives of the bottleneck's clusters; their members with ``expand``."""
    places = with_scores(scene["nodes"].where("level = 1"), tasks).select(F.lit(0).alias("scene"), "id", "scores")
    ids = places.select("id")
    inner = graph.subgraph(scene["edges"], ids).select(F.lit(0).alias("scene"), "src", "dst")
    return cluster.bottleneck_of(places, inner, "scene", p.alpha, p.k, expand).drop("scene")


REGION_METHODS: dict[str, Callable[[dict[str, DataFrame], DataFrame, Params], DataFrame]] = {"max": regions_max, "thresh": regions_thresh, "mix": regions_mix, "aib": regions_aib}


def predict_regions(scene: dict[str, DataFrame], tasks: DataFrame, method: str = "max", params: Params = Params()) -> DataFrame:
    """Q8-Q10: (task_idx, place_id); later calls of a session shift tasks by ``params.offset``."""
    if method not in REGION_METHODS:
        raise ValueError(f"method must be one of {sorted(REGION_METHODS)}, not {method!r}")
    return REGION_METHODS[method](scene, tasks, params).withColumn("task_idx", F.col("task_idx") + params.offset)


# --- paths --------------------------------------------------------------------------------


@dataclass(frozen=True)
class Preferences:
    preferred: Sequence[int] = ()
    forbidden: Sequence[int] = ()
    penalties: dict[int, float] = field(default_factory=dict)


def best_place(scene: dict[str, DataFrame], queries: DataFrame, method: str, params: Params) -> int:
    """The place nearest to the object of the largest top score above 0; an error if there is none."""
    found = predict_objects(scene, queries, method, params).where("top_score > 0").orderBy(F.desc("top_score"), "object").select(F.lit(0).alias("obj"), F.col("cx").alias("x"), F.col("cy").alias("y")).limit(1)
    places = scene["nodes"].where("level = 1").select("id", "x", "y")
    row = spatial.nearest(found, places, "obj", "id", ["x", "y"]).first()
    if row is None:
        raise ValueError("no object found for the query")
    return row["id"]


def plan_path(scene: dict[str, DataFrame], queries: DataFrame, preferences: Preferences = Preferences(), method: str = "ms_avg", params: Params = Params(), start: int | None = None) -> DataFrame:
    """Q11-Q14: (seq, node, cost) from the start to the place of the destination query.

    With two task queries the first names the start; with one the start is ``start``
    or the first place.  Ways over forbidden surfaces are not taken: a goal that has
    no other gives no rows.
    """
    n_tasks = tasks_only(queries, params.n_surface).count()
    if n_tasks == 2:
        last = params.n_surface + 1
        start = best_place(scene, queries.where(F.col("q_idx") != last), method, params)
        queries = queries.where(F.col("q_idx") != last - 1).withColumn("q_idx", F.when(F.col("q_idx") == last, last - 1).otherwise(F.col("q_idx")))
    elif start is None:
        start = scene["nodes"].where("level = 1").agg(F.min("id")).first()[0]
    goal = best_place(scene, queries, method, params)
    return graph.shortest_path(weighed_edges(scene, preferences), start, goal)


def weighed_edges(scene: dict[str, DataFrame], preferences: Preferences) -> DataFrame:
    """F5 on the edges between places."""
    surface = lambda end: scene["nodes"].where("level = 1").select(F.col("id").alias(end), F.coalesce("surface", F.lit(-1)).alias(f"s_{end}"))
    e = scene["edges"].join(surface("src"), "src").join(surface("dst"), "dst")
    cost: Column = surface_cost(F.col("weight"), F.col("s_src"), F.col("s_dst"), list(preferences.preferred), list(preferences.forbidden), dict(preferences.penalties))
    return e.select("src", "dst", cost.alias("weight"))


# --- building -----------------------------------------------------------------------------


def place_edges(places: DataFrame, links: DataFrame, gamma: float = 1.0) -> DataFrame:
    """G1: links (src, dst) between places with their weight F4."""
    end = lambda e: places.select(F.col("id").alias(e), F.col("x").alias(f"x_{e}"), F.col("y").alias(f"y_{e}"), F.col("emb").alias(f"e_{e}"))
    joined = graph.undirected(links).join(end("src"), "src").join(end("dst"), "dst")
    gap = F.sqrt((F.col("x_src") - F.col("x_dst")) ** 2 + (F.col("y_src") - F.col("y_dst")) ** 2)
    return joined.select("src", "dst", edge_weight(gap, cosine(F.col("e_src"), F.col("e_dst")), gamma).alias("weight"))


def similar_place_edges(places: DataFrame, vector: str, above: float, gamma: float = 1.0) -> DataFrame:
    """G1: (src, dst, weight F4) of every two places whose cosine, rounded, exceeds ``above``; positions go along with the vectors, so no edge is joined with its ends."""
    e = similarity.similar_pairs(places, "id", vector, above, carry=("x", "y"), raw=True)
    gap = F.sqrt((F.col("x_src") - F.col("x_dst")) ** 2 + (F.col("y_src") - F.col("y_dst")) ** 2)
    return e.select("src", "dst", edge_weight(gap, F.col("cosine"), gamma).alias("weight"))


def with_regions(places: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Region nodes and edges over ``places`` (id, x, y, emb) from ``labels`` (id, layer, label).

    Region ids follow the places'; level is layer + 2; position and vector are means.
    """
    top = places.agg(F.max("id").alias("top"))
    member = labels.join(places, "id")
    ids = labels.select("layer", "label").distinct().join(F.broadcast(top), F.lit(True)).withColumn("region", F.col("top") + F.row_number().over(W.orderBy("layer", "label"))).drop("top")
    member = member.join(ids, ["layer", "label"])
    at = member.groupBy("region", "layer").agg(F.avg("x").alias("x"), F.avg("y").alias("y"))
    nodes = at.join(A.weighted_mean(member, "region", "emb"), "region").select(F.col("region").alias("id"), (F.col("layer") + 2).cast("int").alias("level"), "x", "y", "emb")
    low = member.where("layer = 0").select(F.col("id").alias("src"), F.col("region").alias("dst"))
    up = member.select("id", "layer", "region")
    wired = up.alias("a").join(up.alias("b"), (F.col("a.id") == F.col("b.id")) & (F.col("a.layer") + 1 == F.col("b.layer"))).select(F.col("a.region").alias("src"), F.col("b.region").alias("dst")).distinct()
    return nodes, low.unionByName(wired)
