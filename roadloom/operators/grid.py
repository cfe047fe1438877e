"""Regular grids: cells, coverage by polygons, neighbours, components of cells, and the extents built from them.

A cell is (row, col) on the lattice of a cell size from a per-city origin; its geometry is implied. Rows count from the
south, columns from the west; grid_id = row * n_cols + col.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roadloom.functions.frames import small
from roadloom.functions.defaults import BUILT_UP, CELL_M, COMBINE_KM, LEAST_CORE_KM2, MOST_CELLS, SEARCH_RADIUS_M
from roadloom.functions.geo import cell_gap
from roadloom.functions.polygons import parse_polygons, ring_area
from roadloom.operators.network import components
from roadloom.operators.shapes import to_wkt



def bounds(points: DataFrame, cell: float = CELL_M) -> DataFrame:
    """city, x0, y0 (lattice corner), n_rows, n_cols of located points."""
    b = points.filter("x is not null and y is not null and not isnan(x) and not isnan(y)").groupBy("city").agg(F.min("x").alias("lx"), F.max("x").alias("hx"), F.min("y").alias("ly"), F.max("y").alias("hy"))
    x0, y0 = F.floor(F.col("lx") / cell) * F.lit(cell), F.floor(F.col("ly") / cell) * F.lit(cell)
    count = lambda hi, lo: F.greatest(F.lit(1), F.ceil(F.col(hi) / cell) - F.floor(F.col(lo) / cell)).cast("int")
    return b.select("city", x0.cast("double").alias("x0"), y0.cast("double").alias("y0"), count("hy", "ly").alias("n_rows"), count("hx", "lx").alias("n_cols"))


def full_grid(limits: DataFrame, cell: float = CELL_M, most_cells: int = MOST_CELLS) -> DataFrame:
    """Every cell of every city, empty ones too. ValueError if a city has more than most_cells."""
    too = limits.filter(F.col("n_rows").cast("bigint") * F.col("n_cols") > most_cells).select("city").limit(1).collect()
    if too:
        raise ValueError(f"the grid of {too[0].city} has more than {most_cells} cells")
    rows = limits.select("*", F.explode(F.sequence(F.lit(0), F.col("n_rows") - 1)).alias("row"))
    cells = rows.select("*", F.explode(F.sequence(F.lit(0), F.col("n_cols") - 1)).alias("col"))
    return cells.select("city", (F.col("row").cast("bigint") * F.col("n_cols") + F.col("col")).alias("grid_id"), "row", "col", F.lit(cell * cell).alias("cell_area_m2"), (F.col("x0") + (F.col("col") + 0.5) * cell).alias("center_x"), (F.col("y0") + (F.col("row") + 0.5) * cell).alias("center_y"))


def clip_to_box(ring: np.ndarray, x0: float, y0: float, x1: float, y1: float) -> np.ndarray:
    """Sutherland-Hodgman: the ring within an axis-parallel box (degenerate bridges carry no area)."""
    for axis, limit, keep_above in ((0, x0, True), (0, x1, False), (1, y0, True), (1, y1, False)):
        if not len(ring):
            break
        inside = ring[:, axis] >= limit if keep_above else ring[:, axis] <= limit
        if inside.all():
            continue
        nxt, nin = np.roll(ring, -1, axis=0), np.roll(inside, -1)
        crosses = inside != nin
        t = np.divide(limit - ring[:, axis], nxt[:, axis] - ring[:, axis], out=np.zeros(len(ring)), where=crosses)
        cut = ring + t[:, None] * (nxt - ring)
        cut[:, axis] = limit
        out = []
        for k in range(len(ring)):
            if inside[k]:
                out.append(ring[k])
            if crosses[k]:
                out.append(cut[k])
        ring = np.asarray(out).reshape(-1, 2)
    return ring


def box_area(parts: list, x0: float, y0: float, x1: float, y1: float) -> float:
    """Area of polygon parts within a box, holes subtracted."""
    total = 0.0
    for part in parts:
        for k, ring in enumerate(part):
            r = clip_to_box(ring, x0, y0, x1, y1)
            if len(r) >= 3:
                x, y = (r - r[0]).T
                area = abs(0.5 * float(np.sum(x * np.roll(y, -1) - np.roll(x, -1) * y)))
                total += area if k == 0 else -area
    return total


def overlay(polygons: DataFrame, cell: float = CELL_M) -> DataFrame:
    """(city, polygon_id, cx, cy, area_m2): area of each polygon (city, polygon_id, geometry text) in each absolute cell it meets.

    Every polygon is cut into its own cells where it stands; cells then meet by equality. Overlaps between polygons are
    not dissolved. Only parts of positive area count; null, empty and non-areal geometries meet no cell.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for city, pid, text in f.itertuples(index=False):
                parts = parse_polygons(text)
                if not parts:
                    continue
                outer = np.concatenate([p[0] for p in parts])
                cx0, cy0 = np.floor(outer.min(axis=0) / cell).astype(int)
                cx1, cy1 = np.floor(outer.max(axis=0) / cell).astype(int)
                for part in parts:
                    for cy in range(cy0, cy1 + 1):
                        strip = [clip_to_box(r, -np.inf, cy * cell, np.inf, (cy + 1) * cell) for r in part]
                        if len(strip[0]) < 3:
                            continue
                        a, b = np.floor(strip[0][:, 0].min() / cell).astype(int), np.floor(strip[0][:, 0].max() / cell).astype(int)
                        for cx in range(max(a, cx0), min(b, cx1) + 1):
                            area = box_area([strip], cx * cell, cy * cell, (cx + 1) * cell, (cy + 1) * cell)
                            if area > 1e-9:
                                rows.append((city, pid, cx, cy, area))
            yield pd.DataFrame(rows, columns=["city", "polygon_id", "cx", "cy", "area_m2"])

    wanted = polygons.filter("geometry is not null and city is not null").select("city", F.col("polygon_id").cast("bigint"), "geometry")
    pieces = wanted.mapInPandas(run, "city string, polygon_id bigint, cx int, cy int, area_m2 double")
    return pieces.groupBy("city", "polygon_id", "cx", "cy").agg(F.sum("area_m2").alias("area_m2"))


def rectangle_overlay(boxes: DataFrame, cell: float = CELL_M) -> DataFrame:
    """overlay() of axis-parallel rectangles (city, polygon_id, lx, ly, hx, hy) in closed form, all inside the JVM."""
    last = lambda hi: F.ceil(F.col(hi) / cell).cast("int") - 1
    first = lambda lo: F.floor(F.col(lo) / cell).cast("int")
    ok = boxes.filter("hx > lx and hy > ly")
    cells = ok.select("*", F.explode(F.sequence(first("lx"), last("hx"))).alias("cx")).select("*", F.explode(F.sequence(first("ly"), last("hy"))).alias("cy"))
    side = lambda lo, hi, c: F.least(F.col(hi), (F.col(c) + 1) * F.lit(cell)) - F.greatest(F.col(lo), F.col(c) * F.lit(cell))
    return cells.select("city", "polygon_id", "cx", "cy", (side("lx", "hx", "cx") * side("ly", "hy", "cy")).alias("area_m2")).filter("area_m2 > 0")


def coverage(pieces: DataFrame, limits: DataFrame, cell: float = CELL_M, built_up: float = BUILT_UP) -> DataFrame:
    """Every cell of the grid with the area covered, the share of it (clipped to 0..1) and whether it is built up."""
    origin = limits.select("city", F.round(F.col("x0") / cell).cast("int").alias("ox"), F.round(F.col("y0") / cell).cast("int").alias("oy"))
    held = pieces.groupBy("city", "cx", "cy").agg(F.sum("area_m2").alias("building_area_m2")).join(small(origin), "city").select("city", (F.col("cy") - F.col("oy")).alias("row"), (F.col("cx") - F.col("ox")).alias("col"), "building_area_m2")
    share = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("building_area_m2") / F.col("cell_area_m2")))
    out = full_grid(limits, cell).join(held, ["city", "row", "col"], "left").na.fill(0.0, ["building_area_m2"]).withColumn("building_coverage", share)
    return out.withColumn("built_up", F.col("building_coverage") >= built_up)


_OFFSETS = [(dr, dc) for dr in (-1, 0, 1) for dc in (-1, 0, 1) if (dr, dc) != (0, 0)]


def neighbours(cells: DataFrame, eight: bool = True) -> DataFrame:
    """(city, lo, hi): grid ids of touching cells of the table (by 8 or by 4 neighbours), each pair once."""
    offsets = [o for o in _OFFSETS if o > (0, 0) and (eight or 0 in o)]
    steps = F.explode(F.array(*[F.struct((F.col("row") + r).alias("row"), (F.col("col") + c).alias("col")) for r, c in offsets]))
    ahead = cells.select("city", F.col("grid_id").alias("a"), steps.alias("s")).select("city", "a", "s.row", "s.col")
    both = ahead.join(cells.select("city", "row", "col", F.col("grid_id").alias("b")), ["city", "row", "col"])
    return both.select("city", F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi"))


def cell_components(cells: DataFrame, eight: bool = True) -> DataFrame:
    """cells with component_id, the smallest grid_id of their component."""
    labels = components(neighbours(cells, eight), cells.select("city", F.col("grid_id").alias("node_id")))
    return cells.join(labels.select("city", F.col("node_id").alias("grid_id"), F.col("component").alias("component_id")), ["city", "grid_id"])


def component_table(built: DataFrame) -> DataFrame:
    """Per component: cells, areas, mean and median coverage, centroid."""
    return built.groupBy("city", "component_id").agg(
        F.count("*").alias("cell_count"),
        (F.sum("cell_area_m2") / 1e6).alias("component_area_km2"),
        F.sum("building_area_m2").alias("building_area_m2"),
        F.avg("building_coverage").alias("mean_building_coverage"),
        F.median("building_coverage").alias("median_building_coverage"),
        F.avg("center_x").alias("centroid_x"),
        F.avg("center_y").alias("centroid_y"),
    )


def primary_component(table: DataFrame, centers: DataFrame) -> DataFrame:
    """Per city the component whose centroid is nearest to the centre (city, x, y); ties go to more cells, then to the smaller id."""
    d = F.hypot(F.col("centroid_x") - F.col("x"), F.col("centroid_y") - F.col("y")) / 1000
    near = table.join(small(centers), "city").withColumn("distance_to_center_km", d)
    return near.groupBy("city").agg(F.min_by("component_id", F.struct("distance_to_center_km", -F.col("cell_count"), "component_id")).alias("component_id"), F.min("distance_to_center_km").alias("distance_to_center_km"))


def nearest(table: DataFrame, centers: DataFrame, most: int) -> DataFrame:
    """component_table() with the distance of each component's centroid to its city's centre, the nearest `most` of each city by place."""
    d = F.hypot(F.col("centroid_x") - F.col("x"), F.col("centroid_y") - F.col("y")) / 1000
    place = F.row_number().over(Window.partitionBy("city").orderBy("distance_to_center_km", F.desc("cell_count"), "component_id"))
    return table.join(centers, "city").withColumn("distance_to_center_km", d).drop("x", "y").withColumn("place", place).filter(F.col("place") <= most)


def gaps_to(built: DataFrame, primary: DataFrame, most_km: float = 1.0, cell: float = CELL_M) -> DataFrame:
    """(city, component_id, gap_km) of the other components within most_km of the primary one.

    Cells meet in blocks as wide as the reach, so no component is compared with every other.
    """
    reach = int(most_km * 1000 // cell) + 1
    mine = built.join(small(primary.select("city", "component_id")), ["city", "component_id"], "left_semi").select("city", F.col("row").alias("r"), F.col("col").alias("c"))
    other = built.join(small(primary.select("city", "component_id")), ["city", "component_id"], "left_anti").select("city", "component_id", "row", "col")
    block = lambda c: F.floor(F.col(c) / reach)
    spread_ = mine.select("*", F.explode(F.array(*[F.struct((block("r") + a).alias("br"), (block("c") + b).alias("bc")) for a in (-1, 0, 1) for b in (-1, 0, 1)])).alias("k")).select("city", "r", "c", "k.br", "k.bc")
    both = other.withColumn("br", block("row")).withColumn("bc", block("col")).join(spread_, ["city", "br", "bc"])
    gap = cell_gap(F.col("row") - F.col("r"), F.col("col") - F.col("c"), cell) / 1000
    return both.groupBy("city", "component_id").agg(F.min(gap).alias("gap_km")).filter(F.col("gap_km") <= most_km)


def component_gaps(built: DataFrame, most_km: float = 1.0, cell: float = CELL_M) -> DataFrame:
    """(city, component_a, component_b, gap_km) of all component pairs within most_km, a below b."""
    reach = int(most_km * 1000 // cell) + 1
    block = lambda c: F.floor(F.col(c) / reach)
    a = built.select("city", F.col("component_id").alias("component_a"), F.col("row").alias("ra"), F.col("col").alias("ca")).withColumn("br", block("ra")).withColumn("bc", block("ca"))
    b = built.select("city", F.col("component_id").alias("component_b"), F.col("row").alias("rb"), F.col("col").alias("cb")).select("*", F.explode(F.array(*[F.struct((block("rb") + i).alias("br"), (block("cb") + j).alias("bc")) for i in (-1, 0, 1) for j in (-1, 0, 1)])).alias("k")).select("city", "component_b", "rb", "cb", "k.br", "k.bc")
    gap = cell_gap(F.col("ra") - F.col("rb"), F.col("ca") - F.col("cb"), cell) / 1000
    return a.join(b, ["city", "br", "bc"]).filter("component_a < component_b").groupBy("city", "component_a", "component_b").agg(F.min(gap).alias("gap_km")).filter(F.col("gap_km") <= most_km)


def selected_components(built: DataFrame, centers: DataFrame, combine_km: float = COMBINE_KM) -> DataFrame:
    """(city, component_id, gap_km): the primary component (gap 0) and those within combine_km of it (not of each other)."""
    primary = primary_component(component_table(built), centers)
    return primary.select("city", "component_id", F.lit(0.0).alias("gap_km")).unionByName(gaps_to(built, primary, combine_km))


def extent_cells(built: DataFrame, selected: DataFrame) -> DataFrame:
    return built.join(selected.select("city", "component_id"), ["city", "component_id"], "left_semi")


def city_extent(built: DataFrame, centers: DataFrame, combine_km: float = COMBINE_KM) -> DataFrame:
    """One row per city: primary component, the selected ids, cells, area, distance of the extent's centroid to the centre."""
    chosen = selected_components(built, centers, combine_km)
    ids = chosen.groupBy("city").agg(F.array_join(F.array_sort(F.collect_set("component_id")), ",").alias("selected_component_ids"), F.count("*").alias("n_components"))
    own = extent_cells(built, chosen).groupBy("city").agg(F.count("*").alias("extent_cells"), (F.sum("cell_area_m2") / 1e6).alias("extent_area_km2"), F.avg("center_x").alias("ex"), F.avg("center_y").alias("ey"))
    d = F.hypot(F.col("ex") - F.col("x"), F.col("ey") - F.col("y")) / 1000
    primary = primary_component(component_table(built), centers).select("city", "component_id")
    return primary.join(ids, "city").join(own, "city").join(centers, "city").select("city", "component_id", "selected_component_ids", "n_components", "extent_cells", "extent_area_km2", d.alias("distance_to_city_center_km"))


def urban_core(extent: DataFrame, share: float = 0.75) -> DataFrame:
    """Cells of the extent at or above the coverage quantile of their city; the whole extent where none is."""
    threshold = extent.groupBy("city").agg(F.percentile("building_coverage", share).alias("core_threshold"))
    marked = extent.join(small(threshold), "city").withColumn("core", F.col("building_coverage") >= F.col("core_threshold"))
    any_core = marked.groupBy("city").agg(F.bool_or("core").alias("any_core"))
    return marked.join(small(any_core), "city").filter("core or not any_core").drop("core", "any_core")


def core_support(covered: DataFrame, core_floor: float = 0.02, core_share: float = 0.75, support_floor: float = 0.01, support_share: float = 0.5) -> DataFrame:
    """Alternative flags per cell: core and support by quantiles of the positive coverages, support never above core."""
    some = F.when(F.col("building_coverage") > 0, F.col("building_coverage"))
    cut = covered.groupBy("city").agg(F.percentile(some, core_share).alias("q_core"), F.percentile(some, support_share).alias("q_support"))
    core = F.greatest(F.lit(core_floor), F.coalesce("q_core", F.lit(core_floor)))
    support = F.least(core, F.greatest(F.lit(support_floor), F.coalesce("q_support", F.lit(support_floor))))
    both = covered.join(small(cut.select("city", core.alias("core_threshold"), support.alias("support_threshold"))), "city")
    return both.withColumn("core", F.col("building_coverage") >= F.col("core_threshold")).withColumn("support", F.col("building_coverage") >= F.col("support_threshold"))


def alternative_extent(covered: DataFrame, centers: DataFrame, radius_m: float = SEARCH_RADIUS_M, least_core_km2: float = LEAST_CORE_KM2) -> DataFrame:
    """The component of support cells within the search circle with most core cells (then most cells), if its core is large enough."""
    near = covered.join(small(centers), "city").filter(F.hypot(F.col("center_x") - F.col("x"), F.col("center_y") - F.col("y")) <= radius_m).drop("x", "y")
    parts = cell_components(core_support(near).filter("support"))
    sums = parts.groupBy("city", "component_id").agg(F.count_if("core").alias("core_count"), F.count("*").alias("cell_count"), (F.sum(F.when(F.col("core"), F.col("cell_area_m2")).otherwise(0.0)) / 1e6).alias("core_area_km2"))
    rank = F.row_number().over(Window.partitionBy("city").orderBy(F.desc("core_count"), F.desc("cell_count"), "component_id"))
    return sums.withColumn("r", rank).filter("r = 1").drop("r").filter(F.col("core_area_km2") >= least_core_km2)


def extent_report(covered: DataFrame, extent: DataFrame, core: DataFrame) -> DataFrame:
    """One row per city: counts and areas of grid, built-up cells, extent and core, and the extent's mean and median coverage."""
    g = covered.groupBy("city").agg(F.count("*").alias("grid_cells"), F.count_if("built_up").alias("built_up_cells"), (F.sum("building_area_m2") / 1e6).alias("building_area_km2"))
    e = extent.groupBy("city").agg(F.count("*").alias("extent_cells"), (F.sum("cell_area_m2") / 1e6).alias("extent_area_km2"), F.avg("building_coverage").alias("mean_coverage"), F.median("building_coverage").alias("median_coverage"))
    c = core.groupBy("city").agg(F.count("*").alias("core_cells"), (F.sum("cell_area_m2") / 1e6).alias("core_area_km2"), F.min("core_threshold").alias("core_threshold"))
    return g.join(e, "city", "left").join(c, "city", "left").na.fill(0, ["extent_cells", "core_cells"])


def outline(cells: DataFrame, cell: float = CELL_M) -> DataFrame:
    """(city, ax, ay, bx, by): the unit edges on the border of the union of cells; edges shared by two cells cancel."""
    side = lambda a, b, c, d: F.struct((F.col("col") + a).alias("ax"), (F.col("row") + b).alias("ay"), (F.col("col") + c).alias("bx"), (F.col("row") + d).alias("by"))
    edges = cells.select("city", F.explode(F.array(side(0, 0, 1, 0), side(0, 1, 1, 1), side(0, 0, 0, 1), side(1, 0, 1, 1))).alias("e")).groupBy("city", "e").count().filter("count = 1")
    return edges.select("city", *[(F.col(f"e.{k}") * F.lit(cell)).alias(k) for k in ("ax", "ay", "bx", "by")])


def trace(rows: np.ndarray, cols: np.ndarray) -> list[list[np.ndarray]]:
    """The union of cells as polygons (outer ring, holes) in units of cells; cells that touch at a corner only stay apart.

    Border edges run with the cells on their left; at a corner where two rings meet, a walk keeps to its own cell.
    """
    held = set(zip(rows.tolist(), cols.tolist()))
    out: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for r, c in held:
        for (dr, dc), (a, b) in (((-1, 0), ((c, r), (c + 1, r))), ((0, 1), ((c + 1, r), (c + 1, r + 1))), ((1, 0), ((c + 1, r + 1), (c, r + 1))), ((0, -1), ((c, r + 1), (c, r)))):
            if (r + dr, c + dc) not in held:
                out.setdefault(a, []).append(b)
    rings = []
    while out:
        start = min(out)
        at, ahead, ring = start, None, []
        while True:
            choices = out[at]
            # a left turn has the largest cross product with the direction so far
            k = 0 if ahead is None else max(range(len(choices)), key=lambda i: ahead[0] * (choices[i][1] - at[1]) - ahead[1] * (choices[i][0] - at[0]))
            to = choices.pop(k)
            if not choices:
                del out[at]
            step = (to[0] - at[0], to[1] - at[1])
            if step != ahead:
                ring.append(at)
            at, ahead = to, step
            if at == start and (at not in out or len(ring) > 3):
                break
        rings.append(np.asarray(ring, dtype=float))
    area = [ring_area(r) for r in rings]
    outer = sorted((k for k in range(len(rings)) if area[k] > 0), key=lambda k: area[k])
    parts = {k: [rings[k]] for k in outer}
    for k, ring in enumerate(rings):
        if area[k] < 0:
            (ax, ay), (bx, by) = ring[0], ring[1]
            d = np.hypot(bx - ax, by - ay)
            p = (ax + (bx - ax) / d / 2 - (by - ay) / d / 2, ay + (by - ay) / d / 2 + (bx - ax) / d / 2)  # the middle of a cell beside the hole
            parts[next(j for j in outer if in_ring(rings[j], p))].append(ring)
    return [parts[k] for k in sorted(outer, key=lambda k: rings[k][0].tolist())]


def in_ring(ring: np.ndarray, p: tuple[float, float]) -> bool:
    """p, on no border, is inside the ring."""
    (ax, ay), (bx, by) = ring.T, np.roll(ring, -1, axis=0).T
    cut = (ay > p[1]) != (by > p[1])
    at = ax[cut] + (p[1] - ay[cut]) * (bx[cut] - ax[cut]) / (by[cut] - ay[cut])
    return bool(np.count_nonzero(at > p[0]) % 2)


def dissolved(cells: DataFrame, limits: DataFrame, cell: float = CELL_M) -> DataFrame:
    """(city, geometry): the union of each city's cells (city, row, col) as a multipolygon in WKT, from the origins in limits.

    A city's cells are gathered; full_grid() has bounded their number.
    """

    def run(own: pd.DataFrame) -> pd.DataFrame:
        x0, y0 = own["x0"].iloc[0], own["y0"].iloc[0]
        parts = [[np.array([x0, y0]) + cell * r for r in part] for part in trace(own["row"].to_numpy(), own["col"].to_numpy())]
        return pd.DataFrame({"city": own["city"].iloc[:1], "geometry": [to_wkt(parts)]})

    placed = cells.select("city", "row", "col").distinct().join(small(limits.select("city", "x0", "y0")), "city")
    return placed.groupBy("city").applyInPandas(run, "city string, geometry string")
