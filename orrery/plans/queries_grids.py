"""Distance maps and territories as cell tables over the stand-in tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from orrery.operators import cells
from orrery.operators.lineage import staged
from orrery.plans.tables import Tables, query

#: Cells that few events fall in are obstacles; the grids are those of even and odd events.
FREE = "free AS (SELECT (event_id % 2)::BIGINT AS g, floor(user_id / 6)::BIGINT AS y, floor(value / 6)::BIGINT AS x FROM events WHERE (floor(user_id / 6) * 7 + floor(value / 6) * 3) % 11 <> 0 GROUP BY ALL)"
GRID = f"{FREE}, bd AS (SELECT g, min(y) - 1 AS y0, max(y) + 1 AS y1, min(x) - 1 AS x0, max(x) + 1 AS x1 FROM free GROUP BY g), gy AS (SELECT g, unnest(range(y0, y1 + 1)) AS y, x0, x1 FROM bd), gr AS (SELECT g, y, unnest(range(x0, x1 + 1)) AS x FROM gy)"
#: ``now`` (g, y, x, obst) to the nearest obstacle of every cell, the lower one of equals.
NEAREST = "SELECT a.g, a.y, a.x, (min((a.y - o.y) ** 2 + (a.x - o.x) ** 2))::BIGINT AS d2, arg_min(o.y, ((a.y - o.y) ** 2 + (a.x - o.x) ** 2, o.y, o.x)) AS oy, arg_min(o.x, ((a.y - o.y) ** 2 + (a.x - o.x) ** 2, o.y, o.x)) AS ox FROM now a JOIN now o ON o.g = a.g AND o.obst GROUP BY 1, 2, 3"


def free_cells(t: Tables) -> DataFrame:
    y, x = F.floor(F.col("user_id") / 6).cast("long"), F.floor(F.col("value") / 6).cast("long")
    return t.events.where((y * 7 + x * 3) % 11 != 0).select((F.col("event_id") % 2).alias("g"), y.alias("y"), x.alias("x")).distinct()


@query("r6_updated_distances", f"WITH {GRID}, was AS (SELECT gr.*, free.g IS NULL AS obst FROM gr LEFT JOIN free USING (g, y, x)), now AS (SELECT g, y, x, CASE WHEN (y * 5 + x * 3) % 13 = 0 THEN NOT obst ELSE obst END AS obst FROM was) {NEAREST}")
def r6(t: Tables) -> DataFrame:
    """A thirteenth of the cells turn from free to obstacle or back; rows that no change reaches stay."""
    grid = cells.grid_of(free_cells(t), "g")
    known = staged(cells.distance_cells(grid, "g"))
    turned = known.where((F.col("y") * 5 + F.col("x") * 3) % 13 == 0).select("g", "y", "x", (~F.col("obst")).alias("obst"))
    after, _ = cells.updated(known, turned, "g")
    return after.select("g", "y", "x", "d2", "oy", "ox")


@query("r7_combined_maps", f"WITH {GRID}, now AS (SELECT gr.*, free.g IS NULL AND (gr.g, gr.y, gr.x) NOT IN (SELECT (1 - g, y, x) FROM free) AS obst FROM gr LEFT JOIN free USING (g, y, x)) {NEAREST}")
def r7(t: Tables) -> DataFrame:
    """Each grid with the cells freed that are free in the other one."""
    known = staged(cells.distance_cells(cells.grid_of(free_cells(t), "g"), "g"))
    after, _ = cells.combined(known, known.withColumn("g", 1 - F.col("g")), "g")
    return after.select("g", "y", "x", "d2", "oy", "ox")


@query("r11_territories", f"""
WITH RECURSIVE {FREE}, c AS (SELECT g, y, x, (y * 5 + x * 3) % 17 = 0 AS node FROM free), nd AS (SELECT g, y, x, row_number() OVER (PARTITION BY g ORDER BY y, x) AS id FROM c WHERE node),
r(g, y, x, id, steps) USING KEY (g, y, x) AS (
  SELECT g, y, x, id, 0::BIGINT FROM nd
  UNION
  SELECT c.g, c.y, c.x, min(r.id), any_value(r.steps) + 1 FROM r, (VALUES (0, 1), (1, 0), (0, -1), (-1, 0)) v(dy, dx), c
  WHERE c.g = r.g AND c.y = r.y + dy AND c.x = r.x + dx AND NOT c.node AND NOT EXISTS (SELECT 1 FROM recurring.r q WHERE q.g = c.g AND q.y = c.y AND q.x = c.x) GROUP BY c.g, c.y, c.x)
SELECT c.g, c.y, c.x, r.id, r.steps FROM c LEFT JOIN r USING (g, y, x)
""")
def r11(t: Tables) -> DataFrame:
    """Free cells as edges, every seventeenth or so a node; each cell's node by steps."""
    rows = free_cells(t).withColumn("is_edge", (F.col("y") * 5 + F.col("x") * 3) % 17 != 0)
    return cells.territories(rows, "g").select("g", "y", "x", "id", "steps")


# --- contraction and tight boxes ------------------------------------------------------------

LINKS = "l AS (SELECT least(l_partkey, l_suppkey) AS src, greatest(l_partkey, l_suppkey) AS dst, sum(round(l_quantity)::BIGINT)::BIGINT AS weight FROM lineitem WHERE l_partkey <> l_suppkey GROUP BY 1, 2)"


@query("g10_contracted", f"""
WITH {LINKS}, en AS (SELECT unnest([src, dst]) AS id, weight, src, dst FROM l),
be AS (SELECT id, arg_min({{'src': src, 'dst': dst}}, (weight, src, dst)) AS e FROM en GROUP BY id),
ch AS (SELECT e.src AS src, e.dst AS dst FROM be GROUP BY 1, 2 HAVING count(*) = 2),
re AS (SELECT coalesce(a.src, l.src) AS p, coalesce(b.src, l.dst) AS q, weight FROM l LEFT JOIN ch a ON a.dst = l.src LEFT JOIN ch b ON b.dst = l.dst)
SELECT least(p, q) AS src, greatest(p, q) AS dst, sum(weight)::BIGINT AS weight FROM re WHERE p <> q GROUP BY 1, 2
""")
def g10(t: Tables) -> DataFrame:
    """One round over the links of parts and suppliers by quantity: edges cheapest at both ends go, parallel ones are summed."""
    from orrery.operators import graph

    links = t.lineitem.where("l_partkey <> l_suppkey").groupBy(F.least("l_partkey", "l_suppkey").alias("src"), F.greatest("l_partkey", "l_suppkey").alias("dst")).agg(F.sum(F.round("l_quantity").cast("long")).alias("weight"))
    links = staged(links)
    return graph.contracted(links, staged(graph.cheapest_apart(links)))


@query("e9_tight_boxes", """
WITH p AS (SELECT c_nationkey AS nation, (c_custkey * 7919 % 1000)::DOUBLE AS x, (c_custkey * 104729 % 997)::DOUBLE AS y, c_acctbal AS z FROM customer),
d AS (SELECT DISTINCT a.nation, (b.x - a.x) / sqrt((b.x - a.x) ** 2 + (b.y - a.y) ** 2) AS c, (b.y - a.y) / sqrt((b.x - a.x) ** 2 + (b.y - a.y) ** 2) AS s FROM p a JOIN p b ON a.nation = b.nation AND (a.x < b.x OR (a.x = b.x AND a.y < b.y))),
r AS (SELECT d.nation, d.c, d.s, (max(x * c + y * s) - min(x * c + y * s)) * (max(y * c - x * s) - min(y * c - x * s)) AS area FROM d JOIN p ON p.nation = d.nation GROUP BY 1, 2, 3),
z AS (SELECT nation, count(*) AS n, min(z) AS low, max(z) - min(z) AS height FROM p GROUP BY 1)
SELECT z.nation, z.n, round((SELECT min(area) FROM r WHERE r.nation = z.nation) / 1e4, 4) AS area, round(z.low, 4) AS low, round(z.height, 4) AS height FROM z
""")
def e9(t: Tables) -> DataFrame:
    """Customers as points of their nations' objects: the least upright boxes, and the height of the ground they stand on."""
    from orrery.operators import hulls

    key = F.col("c_custkey")
    points = t.customer.select(F.col("c_nationkey").alias("nation"), (key * 7919 % 1000).cast("double").alias("x"), (key * 104729 % 997).cast("double").alias("y"), F.col("c_acctbal").alias("z"))
    centre, _ = hulls.ground_plane()
    return hulls.tight_boxes(points, "nation").select("nation", "n", F.round(F.col("ex") * F.col("ey") / 1e4, 4).alias("area"), F.round(centre[2], 4).alias("low"), F.round("ez", 4).alias("height"))
