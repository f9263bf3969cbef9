"""Points, boxes and polygons as columns. A polygon is an array of rings, a ring an array of struct(x, y); the first ring is the outer one."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0
#: Levels of how exact a position is, from the roughest.
LEVELS = ["zone", "postcode", "municipality", "street", "building"]
#: Map zoom at least -> level; the first that fits.
ZOOM_LEVELS = [(16, "street"), (13, "municipality"), (1, "postcode")]
TYPE_LEVELS = {
    "building": "house building premises address".split(),
    "street": "road street footway pedestrian pathway residential living_street tertiary secondary primary unclassified service track cycleway path".split(),
    "municipality": "city town village suburb hamlet city_district borough".split(),
    "postcode": "postcode postal_code".split(),
}
FAR_KM = 50.0


def haversine_km(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    half = lambda a, b: F.pow(F.sin(F.radians(b - a) / 2), 2)
    a = half(lat1, lat2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half(lng1, lng2)
    return 2 * EARTH_KM * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def in_box(lng: Column, lat: Column, box: tuple[float, float, float, float]) -> Column:
    return lng.between(box[0], box[2]) & lat.between(box[1], box[3])


def parse_box(text: str) -> tuple[float, float, float, float]:
    """"minLng,minLat,maxLng,maxLat" checked; ValueError says what is wrong."""
    try:
        box = tuple(float(p) for p in text.split(","))
    except ValueError:
        raise ValueError("bbox: every coordinate must be a number") from None
    if len(box) != 4:
        raise ValueError("bbox: minLng,minLat,maxLng,maxLat")
    if box[0] > box[2] or box[1] > box[3]:
        raise ValueError("bbox: minLng > maxLng or minLat > maxLat")
    if box[0] < -180 or box[2] > 180 or box[1] < -90 or box[3] > 90:
        raise ValueError("bbox: out of range")
    return box


def check_zoom(zoom: int, box: tuple[float, float, float, float] | None = None, widest: float = 20, from_zoom: int = 10) -> int:
    if not 0 <= zoom <= 22:
        raise ValueError("zoom: 0..22")
    if box and zoom < from_zoom and max(box[2] - box[0], box[3] - box[1]) > widest:
        raise ValueError(f"bbox: wider than {widest} degrees below zoom {from_zoom}")
    return zoom


def cell_size(zoom: int) -> float:
    return 360.0 / 2**zoom / 8


def snapped(value: Column, size: float) -> Column:
    """The number of the nearest grid node, halves to even: exact as a key, unlike the coordinate."""
    return F.rint(value / size).cast("long")


def level_rank(level: Column) -> Column:
    return F.coalesce(F.array_position(F.array(*map(F.lit, LEVELS)), level) - 1, F.lit(-1))


def zoom_level(zoom: Column, levels: list[tuple[int, str]] = ZOOM_LEVELS) -> Column:
    out = F.lit(None).cast("string")
    for least, level in reversed(levels):
        out = F.when(zoom >= least, level).otherwise(out)
    return out


def type_level(kind: Column, levels: dict[str, list[str]] = TYPE_LEVELS) -> Column:
    out = F.lit(None).cast("string")
    for level, kinds in levels.items():
        out = F.when(kind.isin(kinds), level).otherwise(out)
    return out


def resolve_position(lat: Column, lng: Column, level: Column, zoom: Column, geo_lat: Column, geo_lng: Column, geo_type: Column, has_place: Column, has_street: Column, threshold: str = "street") -> Column:
    """struct(lat, lng, level, source): a source's point, or a geocoder's where that is better and not far from it.

    A point at the threshold stays. Below it the geocoder counts only if asked for a street, at the threshold, and within 50 km.
    """
    known = lat.isNotNull() & lng.isNotNull()
    own = F.coalesce(level, zoom_level(zoom))
    found = geo_lat.isNotNull() & geo_lng.isNotNull()
    theirs = type_level(geo_type)
    least = F.lit(LEVELS.index(threshold))
    asks = has_place & (~known | has_street)
    close = ~known | ((haversine_km(lat, lng, geo_lat, geo_lng) <= FAR_KM) & (level_rank(theirs) >= least))
    take = found & asks & close & ~(known & (level_rank(own) >= least))
    pick = lambda a, b: F.when(take, a).when(known, b)
    return F.struct(pick(geo_lat, lat).alias("lat"), pick(geo_lng, lng).alias("lng"), pick(theirs, own).alias("level"), pick(F.lit("geocoder"), F.lit("source")).alias("source"))


def edges(ring: Column) -> Column:
    return F.zip_with(ring, F.concat(F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1)), lambda a, b: F.struct(a["x"].alias("x1"), a["y"].alias("y1"), b["x"].alias("x2"), b["y"].alias("y2")))


def in_ring(x: Column, y: Column, ring: Column) -> Column:
    """Ray casting; an edge belongs to the lower side, so a shared border belongs to one of two neighbours."""
    crossed = F.filter(edges(ring), lambda e: ((e["y1"] > y) != (e["y2"] > y)) & (x < (e["x2"] - e["x1"]) * (y - e["y1"]) / F.nullif(e["y2"] - e["y1"], F.lit(0.0)) + e["x1"]))
    return F.size(crossed) % 2 == 1


def in_polygon(x: Column, y: Column, rings: Column) -> Column:
    """Inside the outer ring and in no hole."""
    return in_ring(x, y, F.element_at(rings, 1)) & ~F.exists(F.slice(rings, 2, F.greatest(F.size(rings) - 1, F.lit(0))), lambda hole: in_ring(x, y, hole))


def ring_area(ring: Column) -> Column:
    twice = F.aggregate(edges(ring), F.lit(0.0), lambda s, e: s + e["x1"] * e["y2"] - e["x2"] * e["y1"])
    return F.abs(twice) / 2


def polygon_area(rings: Column) -> Column:
    """In square degrees, holes taken off."""
    return F.aggregate(F.slice(rings, 2, F.greatest(F.size(rings) - 1, F.lit(0))), ring_area(F.element_at(rings, 1)), lambda s, hole: s - ring_area(hole))


def bounds(rings: Column) -> Column:
    outer = F.element_at(rings, 1)
    xs, ys = F.transform(outer, lambda p: p["x"]), F.transform(outer, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("x1"), F.array_min(ys).alias("y1"), F.array_max(xs).alias("x2"), F.array_max(ys).alias("y2"))


def inner_point(rings: Column) -> Column:
    """A point inside the polygon: on the level line through the middle of its height, the middle of the widest stretch inside."""
    box = bounds(rings)
    y = (box["y1"] + box["y2"]) / 2
    crossings = F.array_sort(F.flatten(F.transform(rings, lambda ring: F.transform(F.filter(edges(ring), lambda e: (e["y1"] > y) != (e["y2"] > y)), lambda e: (e["x2"] - e["x1"]) * (y - e["y1"]) / (e["y2"] - e["y1"]) + e["x1"]))))
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.size(crossings) - 1, F.lit(1)), F.lit(2)), lambda i: F.struct((F.try_element_at(crossings, i + 1) - F.try_element_at(crossings, i)).alias("w"), ((F.try_element_at(crossings, i + 1) + F.try_element_at(crossings, i)) / 2).alias("x")))
    return F.struct(F.array_max(pairs)["x"].alias("x"), y.alias("y"))


def cells_of(box: Column, size: float) -> Column:
    """The grid cells that a box touches, as struct(i, j)."""
    span = lambda lo, hi: F.sequence(F.floor(lo / size), F.floor(hi / size))
    return F.flatten(F.transform(span(box["x1"], box["x2"]), lambda i: F.transform(span(box["y1"], box["y2"]), lambda j: F.struct(i.alias("i"), j.alias("j")))))


def cell_of(x: Column, y: Column, size: float) -> Column:
    return F.struct(F.floor(x / size).alias("i"), F.floor(y / size).alias("j"))


def _kept(xy: list[tuple[float, float]], tolerance: float) -> list[int]:
    """Positions that a Douglas-Peucker pass keeps; an explicit stack, so long lines don't recurse."""
    keep, todo = {0, len(xy) - 1}, [(0, len(xy) - 1)]
    while todo:
        a, b = todo.pop()
        (x1, y1), (x2, y2) = xy[a], xy[b]
        dx, dy = x2 - x1, y2 - y1
        length = (dx * dx + dy * dy) ** 0.5
        far, at = 0.0, -1
        for i in range(a + 1, b):
            x, y = xy[i]
            d = abs(dx * (y1 - y) - (x1 - x) * dy) / length if length else ((x - x1) ** 2 + (y - y1) ** 2) ** 0.5
            if d > far:
                far, at = d, i
        if far > tolerance:
            keep.add(at)
            todo += [(a, at), (at, b)]
    return sorted(keep)


def simplified(ring: Column, tolerance: float) -> Column:
    """The ring with points nearer than tolerance to the line through their neighbours left out."""
    @F.pandas_udf("array<struct<x:double,y:double>>")
    def run(rings: pd.Series) -> pd.Series:
        out = []
        for points in rings:
            xy = [(p["x"], p["y"]) for p in points] if points is not None else []
            out.append([{"x": xy[i][0], "y": xy[i][1]} for i in _kept(xy, tolerance)] if len(xy) > 2 else [{"x": x, "y": y} for x, y in xy])
        return pd.Series(out, dtype=object)

    return run(ring)


def geojson(rings: Column) -> Column:
    """A Polygon geometry as JSON text."""
    return F.to_json(F.struct(F.lit("Polygon").alias("type"), F.transform(rings, lambda r: F.transform(r, lambda p: F.array(p["x"], p["y"]))).alias("coordinates")))


#: Fixed values of the WGS 84 spheroid: half the equator's diameter in metres, and its eccentricity.
EQUATOR_M, ECCENTRICITY = 6378137.0, 0.0818191908426215


def _zonal(lat: Column) -> Column:
    """Twice the area of the spheroid between the equator and a latitude, per radian of longitude and square of the equator's radius."""
    e, s = ECCENTRICITY, F.sin(F.radians(lat))
    return (1 - e * e) * (s / (1 - e * e * s * s) - F.log((1 - e * s) / (1 + e * s)) / (2 * e))


def spheroid_area(rings: Column) -> Column:
    """Square metres of a polygon on the spheroid, holes taken off. Edges are straight on an equal-area map, so boxes of meridians and parallels are exact; rings don't cross the date line."""
    twice = lambda ring: F.aggregate(edges(ring), F.lit(0.0), lambda s, e: s + F.radians(e["x2"] - e["x1"]) * (_zonal(e["y1"]) + _zonal(e["y2"])) / 2)
    areas = F.transform(rings, lambda ring: F.abs(twice(ring)) * (EQUATOR_M * EQUATOR_M / 2))
    return F.aggregate(F.slice(areas, 2, F.greatest(F.size(areas) - 1, F.lit(0))), F.element_at(areas, 1), lambda s, hole: s - hole)


def _number(v: Column) -> Column:
    return F.regexp_replace(v.cast("string"), r"\.0$", "")


def wkt(polygons: Column) -> Column:
    """Well-known text of an array of polygons, each an array of closed rings: POLYGON, or MULTIPOLYGON where there are several."""
    ring = lambda r: F.concat(F.lit("("), F.array_join(F.transform(r, lambda p: F.concat_ws(" ", _number(p["x"]), _number(p["y"]))), ","), F.lit(")"))
    text = F.transform(polygons, lambda rings: F.concat(F.lit("("), F.array_join(F.transform(rings, ring), ","), F.lit(")")))
    return F.when(F.size(polygons) == 1, F.concat(F.lit("POLYGON"), text[0])).when(F.size(polygons) > 1, F.concat(F.lit("MULTIPOLYGON("), F.array_join(text, ","), F.lit(")")))
