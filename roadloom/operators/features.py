"""Features made of ways, clipping of lines, search areas and checks on building data."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadloom.functions import geo
from roadloom.functions.frames import small, stored
from roadloom.operators import grid, shapes, spatial

RELATION = "id bigint, type string, tags map<string,string>, members array<struct<type:string,ref:bigint,role:string,geometry:array<struct<lat:double,lon:double>>>>"


def way_rings(ways: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, geometry): WKT of the closed ways (id, refs) with at least four places, from the coordinates (id, lon, lat) of their nodes.

    A way with an unknown node has no ring. The points of one way are gathered: a bounded thing.
    """
    closed = ways.filter("size(refs) >= 4 and refs[0] = element_at(refs, -1)")
    steps = closed.select(F.col("id").alias("way"), F.size("refs").alias("n"), F.posexplode("refs").alias("pos", "id"))
    placed = steps.join(nodes.select("id", "lon", "lat").filter("lon is not null and lat is not null"), "id")
    points = placed.groupBy("way", "n").agg(F.array_sort(F.collect_list(F.struct("pos", F.concat_ws(" ", F.col("lon").cast("string"), F.col("lat").cast("string")).alias("p")))).alias("ps")).filter("size(ps) = n")
    return points.select(F.col("way").alias("id"), F.concat(F.lit("POLYGON (("), F.array_join(F.transform("ps", lambda p: p["p"]), ", "), F.lit("))")).alias("geometry"))


def tagged_within(features: DataFrame, region: DataFrame, key: str, least: int = 1) -> DataFrame:
    """Features (city, id, x, y, tags) with the tag that stand in the region (region_id, city, geometry). ValueError if fewer than `least`."""
    own = features.filter(F.try_element_at("tags", F.lit(key)).isNotNull())
    inside = spatial.in_regions(own, region, point_id="id").select(F.col("point_id").alias("id")).distinct()
    found = own.join(inside, "id", "left_semi")
    if found.limit(least).count() < least:
        raise ValueError(f"fewer than {least} features tagged {key} in the region")
    return found


def relation_members(responses: DataFrame, column: str = "value") -> DataFrame:
    """(relation_id, tags, role, way_no, pos, lon, lat) of saved relation answers in JSON, ready for shapes.relation_polygons()."""
    r = responses.select(F.from_json(column, RELATION).alias("r")).select(F.col("r.id").alias("relation_id"), F.col("r.tags").alias("tags"), F.posexplode("r.members").alias("way_no", "m")).filter("m.type = 'way' and m.geometry is not null")
    return r.select("relation_id", "tags", F.coalesce(F.nullif(F.col("m.role"), F.lit("")), F.lit("outer")).alias("role"), "way_no", F.posexplode("m.geometry").alias("pos", "g")).select("relation_id", "tags", "role", "way_no", "pos", "g.lon", "g.lat")


def clipped_lines(lines: DataFrame, boxes: DataFrame) -> DataFrame:
    """Lines (city, ax, ay, bx, by, ...) cut to the boxes (city, lx, ly, hx, hy) of their city, by the parameters where they enter and leave.

    Lines that only touch a box in a point are left out. All in column expressions.
    """
    both = lines.join(boxes, "city")
    dx, dy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    zero = F.lit(0.0)

    def enter_leave(d, start, lo, hi):  # noqa: ANN001, ANN202
        inside = (start >= lo) & (start <= hi)
        t0, t1 = F.try_divide(lo - start, d), F.try_divide(hi - start, d)
        return F.when(d != 0, F.least(t0, t1)).when(inside, zero).otherwise(F.lit(2.0)), F.when(d != 0, F.greatest(t0, t1)).when(inside, F.lit(1.0)).otherwise(F.lit(-1.0))

    ex, lx = enter_leave(dx, F.col("ax"), F.col("lx"), F.col("hx"))
    ey, ly = enter_leave(dy, F.col("ay"), F.col("ly"), F.col("hy"))
    cut = both.withColumn("t0", F.greatest(zero, ex, ey)).withColumn("t1", F.least(F.lit(1.0), lx, ly)).filter("t0 < t1")
    at = lambda t: (F.col("ax") + F.col(t) * dx, F.col("ay") + F.col(t) * dy)
    (x0, y0), (x1, y1) = at("t0"), at("t1")
    kept = [c for c in lines.columns if c not in ("ax", "ay", "bx", "by")]
    return cut.select(*kept, x0.alias("ax"), y0.alias("ay"), x1.alias("bx"), y1.alias("by"))


def circle_wkt(x: float, y: float, radius: float, quarter: int = 16) -> str:
    """A circle as a polygon of 4 * quarter corners."""
    a = np.arange(4 * quarter + 1) * (np.pi / 2 / quarter)
    return "POLYGON ((" + ", ".join(f"{px!r} {py!r}" for px, py in zip((x + radius * np.cos(a)).tolist(), (y + radius * np.sin(a)).tolist())) + "))"


def search_cells(centers: DataFrame, radius: float, cell: float = grid.CELL_M) -> DataFrame:
    """(city, cx, cy, cell_area_m2): the cells that the circle about each centre (city, x, y) meets, with the area of the meeting."""

    def draw(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"city": f["city"], "polygon_id": 0, "geometry": [circle_wkt(float(x), float(y), radius) for x, y in zip(f["x"], f["y"])]})

    circles = centers.filter("x is not null and y is not null").select("city", "x", "y").mapInPandas(draw, "city string, polygon_id bigint, geometry string")
    return grid.overlay(circles, cell).select("city", "cx", "cy", F.col("area_m2").alias("cell_area_m2"))


def cells_touched(polygons: DataFrame, cells: DataFrame, cell: float = grid.CELL_M) -> DataFrame:
    """Per city how many of the cells (city, cx, cy) a polygon (city, polygon_id, geometry) covers some part of."""
    hit = grid.overlay(polygons, cell).select("city", "cx", "cy").distinct()
    return cells.select("city", "cx", "cy").distinct().join(hit, ["city", "cx", "cy"]).groupBy("city").agg(F.count("*").alias("n_cells"))


def built_area_within(covered: DataFrame, extent: DataFrame) -> DataFrame:
    """(city, built_up_km2): area of buildings in the cells (city, grid_id) of an extent."""
    return covered.join(extent.select("city", "grid_id"), ["city", "grid_id"], "left_semi").groupBy("city").agg((F.sum("building_area_m2") / 1e6).alias("built_up_km2"))


def check_place(buildings: DataFrame, centers: DataFrame, most_km: float = 100.0) -> DataFrame:
    """(city, distance_km) of the area-weighted centre of buildings (city, x, y, area_m2) from the city's centre. ValueError beyond most_km."""
    mean = buildings.groupBy("city").agg((F.sum(F.col("x") * F.col("area_m2")) / F.nullif(F.sum("area_m2"), F.lit(0.0))).alias("mx"), (F.sum(F.col("y") * F.col("area_m2")) / F.nullif(F.sum("area_m2"), F.lit(0.0))).alias("my"))
    out = mean.join(centers, "city").select("city", (F.hypot(F.col("mx") - F.col("x"), F.col("my") - F.col("y")) / 1000).alias("distance_km"))
    far = out.filter((F.col("distance_km") > most_km) | F.col("distance_km").isNull()).limit(100).collect()
    if far:
        raise ValueError("buildings far from their city: " + ", ".join(f"{r.city} ({r.distance_km} km)" for r in far))
    return out


def reference_value(reference: DataFrame, metric: str) -> tuple[float, float]:
    """(lo, hi) of one metric of scoring.reference_bounds(); ValueError lists the metrics there are."""
    row = reference.filter(F.col("metric") == metric).first()
    if row is None:
        raise ValueError(f"no {metric} among {sorted(r.metric for r in reference.select('metric').limit(1000).collect())}")
    return row.lo, row.hi


def load_buildings(raw: DataFrame, centers: DataFrame, zones: DataFrame, most_km: float = 100.0) -> DataFrame:
    """(city, polygon_id, geometry, area_m2) of buildings (city, polygon_id, geometry in degrees): cleaned, projected to the
    UTM zone of their city (zones: city, srid) and checked to lie near its centre (centers: city, x, y in metres).

    Null, empty, unreadable and non-areal geometries and those of unknown cities are left out. ValueError for a city whose
    buildings lie more than most_km away from its centre, or that has none left.
    """
    held = shapes.cleaned(raw.select("city", F.col("polygon_id").cast("bigint").alias("polygon_id"), "geometry"))
    rows = shapes.corners(held, "polygon_id").join(small(zones.select("city", "srid")), "city")
    x, y = geo.to_utm(F.col("x"), F.col("y"), F.col("srid"))
    metres = shapes.from_corners(rows.select("id", "city", "part", "ring", "pos", x.alias("x"), y.alias("y")))
    sizes = shapes.measures(metres, "id").select("id", "area_m2", F.col("centroid_x").alias("x"), F.col("centroid_y").alias("y"))
    out = stored(metres.join(sizes, "id"))
    check_place(out, centers, most_km)
    return out.select("city", F.col("id").alias("polygon_id"), "geometry", "area_m2")
