"""Points and polygons: which zone covers a point, which zone a zone lies in, convex hulls."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthline.functions import geo
from hearthline.operators.latest import top_per_key

#: Zone levels from the most particular.
ZONE_LEVELS = ["zone", "municipality", "region"]


def _cut(zones: DataFrame, groups: tuple[str, ...], size: float) -> DataFrame:
    """(groups, zone_id, cell, border) for the grid cells that a zone touches: border where an edge's box meets the cell, else the cell lies inside."""
    boxed = zones.select(*groups, F.col("id").alias("zone_id"), "rings", F.explode(geo.cells_of(geo.bounds(F.col("rings")), size)).alias("cell"))
    x, y = F.col("cell.i") * size, F.col("cell.j") * size
    slack = size * 1e-6
    meets = lambda e: (F.least(e["x1"], e["x2"]) <= x + size + slack) & (F.greatest(e["x1"], e["x2"]) >= x - slack) & (F.least(e["y1"], e["y2"]) <= y + size + slack) & (F.greatest(e["y1"], e["y2"]) >= y - slack)
    border = F.exists(F.col("rings"), lambda ring: F.exists(geo.edges(ring), meets))
    return boxed.select(*groups, "zone_id", "cell", border.alias("border"), geo.in_polygon(x + size / 2, y + size / 2, F.col("rings")).alias("inside")).where("border or inside").drop("inside")


def covering_pairs(points: DataFrame, zones: DataFrame, key: str, size: float = 0.1, groups: list[str] = ("country",)) -> DataFrame:
    """(key, zone_id, level, area) for each point (lng, lat) and zone (id, level, rings) that covers it.

    Zones are cut up by grid cells, points fall in one cell. What meets in a cell are ids; a cell inside a zone settles its points, and only pairs in a border cell fetch the zone's rings and are tested exactly.
    """
    cut = _cut(zones, tuple(groups), size)
    here = points.where("lat is not null and lng is not null").select(*groups, key, F.col("lng").cast("double").alias("x"), F.col("lat").cast("double").alias("y")).withColumn("cell", geo.cell_of(F.col("x"), F.col("y"), size))
    met = here.join(cut, [*groups, "cell"])
    facts = zones.select(F.col("id").alias("zone_id"), "level", geo.polygon_area(F.col("rings")).alias("area"))
    shapes = zones.select(F.col("id").alias("zone_id"), "rings", geo.bounds(F.col("rings")).alias("box"))
    box = F.col("x").between(F.col("box.x1"), F.col("box.x2")) & F.col("y").between(F.col("box.y1"), F.col("box.y2"))
    tested = met.where("border").join(shapes, "zone_id").where(box & geo.in_polygon(F.col("x"), F.col("y"), F.col("rings")))
    return met.where("not border").select(key, "zone_id").unionByName(tested.select(key, "zone_id")).join(facts, "zone_id").select(key, "zone_id", "level", "area")


def assign_zones(points: DataFrame, zones: DataFrame, key: str = "id", size: float = 0.1) -> DataFrame:
    """key, zone_id for every point: the most particular level, then the smallest area, then the smallest id; null outside all."""
    level = F.array_position(F.array(*map(F.lit, ZONE_LEVELS)), F.col("level"))
    best = top_per_key(covering_pairs(points, zones, key, size), [key], [level.asc(), F.asc("area"), F.asc("zone_id")]).select(key, "zone_id")
    return points.select(key).join(best, key, "left")


def reassign(objects: DataFrame, zones: DataFrame, size: float = 0.1) -> tuple[DataFrame, DataFrame]:
    """(objects with new zone_id and zone_dirty = false, one-row report): only dirty or unassigned, non-terminal objects are looked at."""
    due = (F.col("zone_dirty") | F.col("zone_id").isNull()) & ~F.col("zone_terminal")
    found = assign_zones(objects.where(due), zones, "id", size).withColumnRenamed("zone_id", "new_zone")
    joined = objects.join(found.withColumn("looked", F.lit(True)), "id", "left").withColumn("looked", F.coalesce("looked", F.lit(False)))
    has_point = F.col("lat").isNotNull() & F.col("lng").isNotNull()
    report = joined.agg(
        F.count_if(has_point).alias("with_geom"), F.count_if(~has_point).alias("no_geom"),
        F.count_if(F.col("looked") & ~F.col("zone_id").eqNullSafe(F.col("new_zone")) & F.col("new_zone").isNotNull()).alias("changed"),
        F.count_if(F.col("looked") & F.col("zone_id").isNotNull() & F.col("new_zone").isNull()).alias("cleared"),
        F.count_if(has_point & F.when(F.col("looked"), F.col("new_zone").isNull()).otherwise(F.col("zone_id").isNull())).alias("uncovered"))
    zone, dirty = F.when(F.col("looked"), F.col("new_zone")).otherwise(F.col("zone_id")), F.col("zone_dirty") & ~F.col("looked")
    return joined.select(*[zone.alias(c) if c == "zone_id" else dirty.alias(c) if c == "zone_dirty" else F.col(c) for c in objects.columns]), report


def cell_index(objects: DataFrame, size: float = 0.1) -> DataFrame:
    """(country, cell, id): which objects lie in a cell; to be written, and kept up as objects come and move."""
    return objects.where("lat is not null and lng is not null").select("country", geo.cell_of(F.col("lng").cast("double"), F.col("lat").cast("double"), size).alias("cell"), "id")


def touched_by_zones(objects: DataFrame, index: DataFrame, before: DataFrame, after: DataFrame, size: float = 0.1) -> DataFrame:
    """objects with zone_dirty where a zone has come, gone or changed (rings or level) in a cell of theirs, by its shape before or after; index is their cell_index. Other objects keep their flag, and no polygon is tested against them."""
    shape = lambda zones, when: zones.select("country", "id", F.xxhash64("level", F.to_json("rings")).alias(when))
    changed = shape(before, "was").join(shape(after, "now"), ["country", "id"], "full").where(~F.col("was").eqNullSafe(F.col("now"))).select("country", "id")
    cells = before.select("country", "id", "rings").unionByName(after.select("country", "id", "rings")).join(changed, ["country", "id"], "left_semi").select("country", F.explode(geo.cells_of(geo.bounds(F.col("rings")), size)).alias("cell")).distinct()
    hit = index.join(cells, ["country", "cell"], "left_semi").select(F.col("id").alias("__hit")).distinct()
    joined = objects.join(hit, objects["id"] == hit["__hit"], "left")
    return joined.select(*[(objects["zone_dirty"] | F.col("__hit").isNotNull()).alias(c) if c == "zone_dirty" else objects[c] for c in objects.columns])


def link_parents(zones: DataFrame, size: float = 0.5) -> DataFrame:
    """id, parent_id: the smallest zone of the next level up that covers a point inside the zone; null if none does. A point meets zones of that level only, not the many of its own that share its cell."""
    above = {"zone": "municipality", "municipality": "region"}
    inside = zones.where(F.col("level").isin(list(above))).select("country", "id", "level", geo.inner_point(F.col("rings")).alias("p")).select("country", F.col("id").alias("child"), F.col("level").alias("of"), F.col("p.x").alias("lng"), F.col("p.y").alias("lat"))
    wanted = F.when(F.col("of") == "zone", "municipality").otherwise("region")
    pairs = covering_pairs(inside.withColumn("level", wanted), zones.where(F.col("level").isin(list(above.values()))), "child", size, ("country", "level"))
    best = top_per_key(pairs, ["child"], [F.asc("area"), F.asc("zone_id")])
    return zones.select("id").join(best.select(F.col("child").alias("id"), F.col("zone_id").alias("parent_id")), "id", "left")


def hull_of(points: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """Convex hull, counter-clockwise, by a monotone chain."""
    points = sorted(set(points))
    if len(points) < 3:
        return points
    turn = lambda o, a, b: (a[0] - o[0]) * (b[1] - o[1]) - (a[1] - o[1]) * (b[0] - o[0])

    def half(seq: Iterator[tuple[float, float]]) -> list[tuple[float, float]]:
        out: list[tuple[float, float]] = []
        for p in seq:
            while len(out) > 1 and turn(out[-2], out[-1], p) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    return half(iter(points)) + half(reversed(points))


def convex_hull(points: DataFrame, x: str = "lng", y: str = "lat", tree: int = 16) -> DataFrame:
    """(x, y) corners of the hull of all points: hulls of batches are merged in two levels, with a shuffle before each, so that no level narrows the one before."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple[float, float]] = []
        for part in batches:
            held = hull_of(held + list(zip(part["x"], part["y"])))
        yield pd.DataFrame(held, columns=["x", "y"])

    schema = "x double, y double"
    level = points.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).where("x is not null and y is not null").mapInPandas(run, schema)
    return level.repartition(tree).mapInPandas(run, schema).repartition(1).mapInPandas(run, schema)


def outside_hull(points: DataFrame, hull: list[tuple[float, float]], x: str = "lng", y: str = "lat") -> DataFrame:
    """points with a flag outside: right of some edge of the hull (corners counter-clockwise, as convex_hull gives them)."""
    out = F.lit(False)
    for (x1, y1), (x2, y2) in zip(hull, hull[1:] + hull[:1]):
        out = out | ((x2 - x1) * (F.col(y) - y1) - (y2 - y1) * (F.col(x) - x1) < 0)
    return points.withColumn("outside", out)


def ring_polygons(borders: list[tuple[float, float, float, float]]) -> list[list[list[tuple[float, float]]]]:
    """Polygons, each an outer ring and its holes, of border edges that have the inside on their left. Rings are closed, have no corner on a straight line, start at their least corner and come in order of it.

    Where borders touch in a corner, a walk turns as far left as it can, so that polygons which meet in a point stay apart.
    """
    after: dict[tuple[float, float], list[tuple[float, float]]] = {}
    for x1, y1, x2, y2 in sorted(borders):
        after.setdefault((x1, y1), []).append((x2, y2))
    rings = []
    while after:
        first = min(after)
        at, ring, heading = first, [], None
        while True:
            ways = after[at]
            turn = lambda p: 0.0 if heading is None else (math.atan2(p[1] - at[1], p[0] - at[0]) - heading + 3 * math.pi) % (2 * math.pi)  # noqa: B023, E731
            way = max(ways, key=turn)
            ways.remove(way)
            if not ways:
                del after[at]
            ring.append(at)
            heading, at = math.atan2(way[1] - at[1], way[0] - at[0]), way
            if at == first:
                break
        cross = lambda a, b, c: (b[0] - a[0]) * (c[1] - b[1]) - (b[1] - a[1]) * (c[0] - b[0])
        ring = [b for a, b, c in zip([ring[-1], *ring], ring, [*ring[1:], ring[0]]) if cross(a, b, c)]
        k = ring.index(min(ring))
        rings.append([*ring[k:], *ring[:k], ring[k]])
    size = lambda r: sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(r, r[1:])) / 2
    outer = sorted((r for r in rings if size(r) > 0), key=lambda r: r[0])
    polygons = [[r] for r in outer]
    for hole in sorted((r for r in rings if size(r) < 0), key=lambda r: r[0]):
        (hx, hy), (nx, ny) = hole[0], hole[1]
        x, y = (hx + nx) / 2, (hy + ny) / 2
        around = [p for p in polygons if sum((a[1] > y) != (b[1] > y) and x < (b[0] - a[0]) * (y - a[1]) / (b[1] - a[1]) + a[0] for a, b in zip(p[0], p[0][1:])) % 2]
        min(around, key=lambda p: size(p[0])).append(hole)
    return polygons


def dissolved(zones: DataFrame, group: str, size: float = 0.1) -> DataFrame:
    """group and polygons (array of polygons, each an array of rings): the union of each group's zones (group, rings), which may touch and don't overlap.

    Edges are cut where another zone's corner lies on them; what two zones share then comes once in each direction and cancels in a sum that every task begins on its own. Only borders of the unions are left, which are as long as the
    result's own rings; a task per group walks them. Coordinates are compared exactly.
    """
    signed = F.transform("rings", lambda r: F.struct(r.alias("r"), F.aggregate(geo.edges(r), F.lit(0.0), lambda s, e: s + e["x1"] * e["y2"] - e["x2"] * e["y1"]).alias("area")))
    # the outer ring goes round to the left, holes to the right
    turned = F.transform(signed, lambda r, i: F.when((r["area"] > 0) == (i == 0), r["r"]).otherwise(F.reverse(r["r"])))
    lines = zones.select(group, F.explode(F.flatten(F.transform(turned, geo.edges))).alias("e")).select(group, "e.*").where("x1 <> x2 or y1 <> y2")
    box = F.struct(F.least("x1", "x2").alias("x1"), F.least("y1", "y2").alias("y1"), F.greatest("x1", "x2").alias("x2"), F.greatest("y1", "y2").alias("y2"))
    ends = lines.select(group, F.col("x1").alias("px"), F.col("y1").alias("py")).distinct().withColumn("cell", geo.cell_of(F.col("px"), F.col("py"), size))
    inside = (F.col("px").between(F.least("x1", "x2"), F.greatest("x1", "x2")) & F.col("py").between(F.least("y1", "y2"), F.greatest("y1", "y2")) & ((F.col("x2") - F.col("x1")) * (F.col("py") - F.col("y1")) == (F.col("y2") - F.col("y1")) * (F.col("px") - F.col("x1"))))
    on = lines.distinct().withColumn("cell", F.explode(geo.cells_of(box, size))).join(ends, [group, "cell"]).where(inside).groupBy(group, "x1", "y1", "x2", "y2").agg(
        F.array_sort(F.collect_set(F.struct(((F.col("px") - F.col("x1")) * (F.col("x2") - F.col("x1")) + (F.col("py") - F.col("y1")) * (F.col("y2") - F.col("y1"))).alias("at"), F.col("px").alias("x"), F.col("py").alias("y")))).alias("on"))
    parts = lines.join(on, [group, "x1", "y1", "x2", "y2"]).select(group, F.explode(F.zip_with(F.slice("on", 1, F.size("on") - 1), F.slice("on", 2, F.size("on") - 1), lambda a, b: F.struct(a["x"].alias("x1"), a["y"].alias("y1"), b["x"].alias("x2"), b["y"].alias("y2")))).alias("e")).select(group, "e.*")
    forward = (F.col("x1") < F.col("x2")) | ((F.col("x1") == F.col("x2")) & (F.col("y1") < F.col("y2")))
    one = lambda a, b: F.when(forward, F.struct(F.col(f"x{a}").alias("x"), F.col(f"y{a}").alias("y"))).otherwise(F.struct(F.col(f"x{b}").alias("x"), F.col(f"y{b}").alias("y")))
    left = parts.groupBy(group, one(1, 2).alias("a"), one(2, 1).alias("b")).agg(F.sum(F.when(forward, 1).otherwise(-1)).alias("n")).where("n <> 0")
    kind = dict(zones.dtypes)[group]

    def walk(rows: pd.DataFrame) -> pd.DataFrame:
        borders = [(*(a if n > 0 else b), *(b if n > 0 else a)) for a, b, n in zip(zip(rows["ax"], rows["ay"]), zip(rows["bx"], rows["by"]), rows["n"])]
        rings = [[[{"x": x, "y": y} for x, y in ring] for ring in polygon] for polygon in ring_polygons(borders)]
        return pd.DataFrame({group: [rows[group].iloc[0]], "polygons": [rings]})

    flat = left.select(group, F.col("a.x").alias("ax"), F.col("a.y").alias("ay"), F.col("b.x").alias("bx"), F.col("b.y").alias("by"), "n")
    return flat.groupBy(group).applyInPandas(walk, f"{group} {kind}, polygons array<array<array<struct<x:double,y:double>>>>")
