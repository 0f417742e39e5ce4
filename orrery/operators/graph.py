"""Graph operators over edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from orrery.operators.lineage import staged


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("h")).first()  # no sum: it overflows from 16 million edges on
    return row["n"], row["h"] or 0


def components(edges: DataFrame, src: str = "src", dst: str = "dst", rounds: int = 60) -> DataFrame:
    """(id, component) of every id on an edge; a component is named by its least id.

    Alternating large stars and small stars: each round hangs every node's
    neighbours on the least of them, so chains halve and hubs are met by a
    partial minimum first.  Self edges keep their node; null ends are dropped.
    """
    plain = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u IS NOT NULL AND v IS NOT NULL")
    nodes = staged(plain.select(F.explode(F.array("u", "v")).alias("id")).distinct())
    now = staged(plain.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = None
    for _ in range(rounds):
        state = _state(now)
        if state == before or state[0] == 0:
            break
        before = state
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # written, so that the join is of two plain exchanges, or a broadcast while it is small, and a hub's edges can be split
        least = staged(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        now = staged(small.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    else:
        raise RuntimeError(f"components still change after {rounds} rounds")
    return nodes.join(now.select(F.col("u").alias("id"), "v"), "id", "left").select("id", F.coalesce("v", "id").alias("component"))


def largest(nodes: DataFrame, edges: DataFrame, n: int = 1, key: str = "id") -> DataFrame:
    """The nodes of the n largest components, ties to the least component; nodes without edges are components of one."""
    from pyspark.sql import Window as W

    placed = nodes.join(components(edges).withColumnRenamed("id", key), key, "left").withColumn("component", F.coalesce("component", key))
    sizes = placed.groupBy("component").agg(F.count("*").alias("size"))
    top = sizes.withColumn("rank", F.row_number().over(W.orderBy(F.desc("size"), "component"))).where(F.col("rank") <= n)
    return placed.join(top.select("component", "size"), "component")


def bridge(nodes: DataFrame, edges: DataFrame, dims: list[str], gamma: float = 1.0, vector: str | None = None, factor: float = 100.0, rounds: int = 32) -> DataFrame:
    """Edges (src, dst, weight) that join all components.

    In rounds, each component adds its nearest link to another one (least distance,
    then ids), doubles dropped, at ``factor`` times the edge weight, until one is
    left; components at least halve.
    """
    from orrery.functions.vectors import cosine, edge_weight

    links = edges.select("src", "dst")
    added = None
    for _ in range(rounds):
        placed = staged(nodes.join(components(links), "id", "left").withColumn("component", F.coalesce("component", "id")))
        if placed.select("component").distinct().limit(2).count() < 2:
            break
        from orrery.operators.spatial import nearest

        other = placed.withColumnRenamed("id", "other").select("other", "component", *dims)
        best = nearest(placed.select("id", "component", *dims), other, "id", "other", dims, apart="component").join(placed.select("id", "component"), "id")
        best = best.groupBy("component").agg(F.min(F.struct("d2", F.least("id", "other").alias("src"), F.greatest("id", "other").alias("dst"))).alias("m"))
        new = best.select("m.src", "m.dst", F.sqrt("m.d2").alias("d")).distinct()
        if vector:
            u = nodes.select(F.col("id").alias("src"), F.col(vector).alias("_u"))
            v = nodes.select(F.col("id").alias("dst"), F.col(vector).alias("_v"))
            new = new.join(u, "src").join(v, "dst").select("src", "dst", (factor * edge_weight(F.col("d"), cosine(F.col("_u"), F.col("_v")), gamma)).alias("weight"))
        else:
            new = new.select("src", "dst", (factor * F.col("d")).alias("weight"))
        new = staged(new)
        added = new if added is None else added.unionByName(new)
        links = links.unionByName(new.select("src", "dst"))
    else:
        raise RuntimeError(f"components are still apart after {rounds} rounds")
    return added if added is not None else edges.select("src", "dst", F.lit(0.0).alias("weight")).limit(0)


def shortest_path(edges: DataFrame, start: int, goal: int, weight: str = "weight", rounds: int = 10_000) -> DataFrame:
    """(seq, node, cost) along the cheapest way from start to goal, both directions of an edge alike; empty if there is none.

    Relaxation from the frontier: a round offers its neighbours only what the last
    round improved, as long as that costs less than the goal so far.  Edges of infinite weight are not taken.  Ties go to the smaller
    parent.
    """
    spark = edges.sparkSession
    both = edges.select("src", "dst", F.col(weight).cast("double").alias("w")).where(F.col("w").isNotNull() & (F.col("w") < float("inf")))
    both = staged(both.unionByName(both.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w")).groupBy("src", "dst").agg(F.min("w").alias("w")))
    schema = "node long, cost double, parent long"
    known = spark.createDataFrame([(start, 0.0, None)], schema)
    frontier, best = known, None
    for _ in range(rounds):
        offers = frontier.join(both, frontier["node"] == both["src"]).groupBy("dst").agg(F.min(F.struct((F.col("cost") + F.col("w")).alias("cost"), F.col("node").alias("parent"))).alias("o"))
        offers = offers.select(F.col("dst").alias("node"), F.col("o.cost").alias("new"), F.col("o.parent").alias("via"))
        better = offers.join(known, "node", "left").where(F.col("cost").isNull() | (F.col("new") < F.col("cost"))).select("node", F.col("new").alias("cost"), F.col("via").alias("parent"))
        frontier = staged(better if best is None else better.where(F.col("cost") < best))  # what costs as much as the goal leads nowhere
        if frontier.isEmpty():
            break
        reached = frontier.where(F.col("node") == goal).first()
        best = reached["cost"] if reached else best
        known = staged(known.join(frontier, "node", "left_anti").unionByName(frontier))
    else:
        raise RuntimeError(f"ways are still getting cheaper after {rounds} rounds")
    steps, at = [], goal
    row = known.where(F.col("node") == at).first()
    while row is not None:  # the path itself, one row a step
        steps.append((row["node"], row["cost"]))
        row = known.where(F.col("node") == row["parent"]).first() if row["parent"] is not None else None
    steps.reverse()
    return spark.createDataFrame([(i, n, c) for i, (n, c) in enumerate(steps)], "seq long, node long, cost double")


def _downward(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(src, dst, above, below) of the edges, either way, from nodes above level 1.

    Those are met first: they are written and few, so edges between places, by far
    the most, are dropped before any shuffle.
    """
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    upper = staged(nodes.where("level > 1").select(F.col("id").alias("src"), F.col("level").alias("above")))
    return both.join(upper, "src").join(nodes.select(F.col("id").alias("dst"), F.col("level").alias("below")), "dst")


def closure(nodes: DataFrame, edges: DataFrame, depth: int = 16) -> DataFrame:
    """(root, id, level) of everything below each node, by edges to lower levels down to level 1."""
    steps = staged(_downward(nodes, edges).where("below >= 1 AND below < above").select("src", "dst", "below").distinct())
    now = steps.select(F.col("src").alias("root"), F.col("dst").alias("id"), F.col("below").alias("level"))
    out = now
    for _ in range(depth):
        now = staged(now.join(steps, now["id"] == steps["src"]).select("root", F.col("dst").alias("id"), F.col("below").alias("level")).distinct())
        if now.isEmpty():
            break
        out = out.unionByName(now)
    else:
        raise RuntimeError(f"the graph is more than {depth} levels deep")
    return out.distinct()


def descend(nodes: DataFrame, edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(root, id) of the places (level 1) below each root; a place is its own."""
    below = closure(nodes, edges).where("level = 1").select("root", "id")
    own = roots.join(nodes.where("level = 1").select(F.col("id").alias("root")), "root", "left_semi").select("root", F.col("root").alias("id"))
    return roots.join(below, "root").select("root", "id").unionByName(own).distinct()


def bottom_regions(nodes: DataFrame, edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(root, id) of the regions at or below each root that have a place for a neighbour, not passing below one."""
    steps = staged(_downward(nodes, edges))
    ends = steps.where("below = 1 AND above > 1").select(F.col("src").alias("id")).distinct()
    now, found = roots.select("root", F.col("root").alias("id")), None
    for _ in range(16):
        hit = now.join(ends, "id", "left_semi")
        found = hit if found is None else found.unionByName(hit)
        rest = now.join(ends, "id", "left_anti")
        now = staged(rest.join(steps.where("below >= 2 AND below < above"), rest["id"] == steps["src"]).select("root", F.col("dst").alias("id")).distinct())
        if now.isEmpty():
            break
    else:
        raise RuntimeError("regions are more than 16 levels deep")
    return found.select("root", "id").distinct()


def children(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(region, place) of every region's neighbours of level 1."""
    return _downward(nodes, edges).where("below = 1").select(F.col("src").alias("region"), F.col("dst").alias("place")).distinct()


def subgraph(edges: DataFrame, chosen: DataFrame) -> DataFrame:
    """U4: the edges with both ends among ``chosen`` (id)."""
    ids = chosen.select("id").distinct()
    return edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")


def undirected(edges: DataFrame) -> DataFrame:
    """Each unordered pair once, no self edges."""
    return edges.where("src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()


def degrees(edges: DataFrame) -> DataFrame:
    """G13"""
    return edges.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))


# --- contraction (G10) --------------------------------------------------------------


def cheapest_apart(edges: DataFrame, weight: str = "weight") -> DataFrame:
    """The edges that are the cheapest at both their ends, ties to the least (src, dst): no two of them meet.

    A sequential choice of the cheapest edge would take each of them before anything
    that touches it, so a round of them equals that choice wherever edges are apart.
    """
    own = F.struct(F.col(weight), F.col("src"), F.col("dst"))
    ends = edges.select(F.explode(F.array("src", "dst")).alias("id"), own.alias("e"))
    best = ends.groupBy("id").agg(F.min("e").alias("e"))
    return best.groupBy("e").agg(F.count("*").alias("n")).where("n = 2").select("e.src", "e.dst", F.col(f"e.{weight}").alias(weight))


def contracted(edges: DataFrame, chosen: DataFrame, weight: str = "weight", resum: str = "sum") -> DataFrame:
    """The edge table after the chosen edges' greater ends became their lesser ends: no self edges, parallel edges one with the sum (or min, max) of their weights."""
    into = chosen.select(F.greatest("src", "dst").alias("_from"), F.least("src", "dst").alias("_to"))
    out = edges.select("src", "dst", weight)
    for end in ("src", "dst"):
        out = out.join(into.withColumnsRenamed({"_from": end}), end, "left").withColumn(end, F.coalesce("_to", end)).drop("_to")
    out = out.where("src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), weight)
    return out.groupBy("src", "dst").agg(getattr(F, resum)(weight).alias(weight))


def contract(edges: DataFrame, weight: str = "weight", most: float = float("inf"), resum: str = "sum", rounds: int = 1_000) -> tuple[DataFrame, DataFrame]:
    """((id, parent) of every node on an edge, the edges left) after contracting in rounds what costs at most ``most``.

    Every round contracts the edges that are cheapest at both ends; at least the
    cheapest edge of all is one of them, and merged nodes' edges are summed anew.  A
    node is named by the least id merged into it; self edges and null ends are
    dropped.
    """
    edges = edges.where("src IS NOT NULL AND dst IS NOT NULL")
    now = edges.where("src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), weight)
    now = staged(now.groupBy("src", "dst").agg(getattr(F, resum)(weight).alias(weight)))
    parents = staged(edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct().withColumn("parent", F.col("id")))
    for _ in range(rounds):
        chosen = staged(cheapest_apart(now, weight).where(F.col(weight) <= most))
        if chosen.isEmpty():
            return parents, now
        into = chosen.select(F.greatest("src", "dst").alias("parent"), F.least("src", "dst").alias("_to"))
        parents = staged(parents.join(into, "parent", "left").select("id", F.coalesce("_to", "parent").alias("parent")))
        now = staged(contracted(now, chosen, weight, resum))
    raise RuntimeError(f"edges were still contracted after {rounds} rounds")
