"""Geometry operators: measures of polygons, hulls, simplification, repair, rings from ways, clipping, distances to roads.

Geometries are texts (WKT or GeoJSON) or, where points suffice, rows of coordinates. What a kernel in Python does, it
does per row or per small group; everything over pairs of tables is an equi-join on tiles.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadloom.functions.frames import small, stored
from roadloom.functions.geo import distance_to_segment
from roadloom.functions.polygons import Polygon, crossings, is_simple, parse_polygons, polygon_area, ring_area, untangled


def centroid(parts: list[Polygon]) -> tuple[float, float] | None:
    total = sx = sy = 0.0
    for part in parts:
        for k, ring in enumerate(part):
            o = ring[0]
            x, y = (ring - o).T
            cross = x * np.roll(y, -1) - np.roll(x, -1) * y
            a = float(cross.sum()) / 2
            if a:
                sign = (1 if k == 0 else -1) * (1 if a > 0 else -1)
                sx += sign * (float(((x + np.roll(x, -1)) * cross).sum()) / 6 + o[0] * a)
                sy += sign * (float(((y + np.roll(y, -1)) * cross).sum()) / 6 + o[1] * a)
                total += sign * a
    return (sx / total, sy / total) if total else None


def to_wkt(parts: list[Polygon]) -> str:
    ring = lambda r: "(" + ", ".join(f"{x!r} {y!r}" for x, y in np.vstack([r, r[:1]]).tolist()) + ")"
    return "MULTIPOLYGON (" + ", ".join("(" + ", ".join(map(ring, p)) + ")" for p in parts) + ")" if parts else "MULTIPOLYGON EMPTY"


def repaired(parts: list[Polygon]) -> list[Polygon]:
    """Outer rings counterclockwise, holes clockwise, repeated corners and spikes dropped, parts and holes without area left out.

    A part that no triangulation covers (its rings cross) is untangled: its even-odd inside, in parts whose rings don't cross.
    """
    out = []
    for part in _tidied(parts):
        out += [part] if is_simple(part) else _tidied(untangled(part))
    return out


def _tidied(parts: list[Polygon]) -> list[Polygon]:
    out = []
    for part in parts:
        rings = []
        for k, ring in enumerate(part):
            points = ring.tolist()
            changed = True
            while changed and len(points) >= 3:
                changed = False
                for i in range(len(points)):
                    a, b, c = points[i - 1], points[i], points[(i + 1) % len(points)]
                    turn = (b[0] - a[0]) * (c[1] - b[1]) - (b[1] - a[1]) * (c[0] - b[0])
                    back = (b[0] - a[0]) * (c[0] - b[0]) + (b[1] - a[1]) * (c[1] - b[1])
                    if a == b or turn == 0 and back < 0:
                        del points[i]
                        changed = True
                        break
            if len(points) < 3 or ring_area(np.asarray(points)) == 0 and not crossings([np.asarray(points)]):
                if k == 0:
                    break
                continue
            r = np.asarray(points)
            rings.append(r[::-1] if (ring_area(r) > 0) != (k == 0) else r)
        if rings:
            out.append(rings)
    return out


def simplify_line(points: np.ndarray, tolerance: float) -> np.ndarray:
    """Douglas-Peucker over an open line, without recursion."""
    keep = np.zeros(len(points), dtype=bool)
    keep[[0, -1]] = True
    todo = [(0, len(points) - 1)]
    while todo:
        a, b = todo.pop()
        if b - a < 2:
            continue
        p, q, own = points[a], points[b], points[a + 1 : b]
        d = q - p
        size = float(d @ d)
        t = np.clip(((own - p) @ d) / size, 0, 1) if size else np.zeros(len(own))
        far = np.hypot(*(own - p - t[:, None] * d).T)
        k = int(np.argmax(far))
        if far[k] > tolerance:
            keep[a + 1 + k] = True
            todo += [(a, a + 1 + k), (a + 1 + k, b)]
    return points[keep]


def simplified(parts: list[Polygon], tolerance: float) -> list[Polygon]:
    """Every ring simplified between its first corner and the one farthest from it; rings that collapse are left out."""
    out = []
    for part in parts:
        rings = []
        for k, ring in enumerate(part):
            far = int(np.argmax(np.hypot(*(ring - ring[0]).T)))
            closed = np.vstack([ring, ring[:1]])
            r = np.vstack([simplify_line(closed[: far + 1], tolerance)[:-1], simplify_line(closed[far:], tolerance)[:-1]])
            if len(r) >= 3 and ring_area(r) != 0:
                rings.append(r)
            elif k == 0:
                break
        if rings:
            out.append(rings)
    return out


MEASURES = "id bigint, parts int, holes int, corners int, area_m2 double, centroid_x double, centroid_y double, min_x double, min_y double, max_x double, max_y double"


def measures(regions: DataFrame, region_id: str = "region_id", geometry: str = "geometry") -> DataFrame:
    """Parts, holes, corners, area, centroid and bounds of every geometry that has an area."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for i, text in f.itertuples(index=False):
                parts = repaired(parse_polygons(text))
                if parts:
                    c = centroid(parts) or (None, None)
                    outer = np.concatenate([p[0] for p in parts])
                    rows.append((i, len(parts), sum(len(p) - 1 for p in parts), sum(len(r) for p in parts for r in p), sum(map(polygon_area, parts)), *c, *outer.min(axis=0), *outer.max(axis=0)))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in MEASURES.split(", ")])

    return regions.select(F.col(region_id).cast("bigint").alias("id"), geometry).filter(F.col(geometry).isNotNull()).mapInPandas(run, MEASURES)


def cleaned(regions: DataFrame, geometry: str = "geometry", tolerance: float = 0.0) -> DataFrame:
    """Rows with an areal geometry, repaired and (with a tolerance) simplified, as WKT; all others are left out."""

    def fix(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            parts = repaired(parse_polygons(t))
            parts = simplified(parts, tolerance) if tolerance > 0 else parts
            out.append(to_wkt(parts) if parts else None)
        return pd.Series(out, index=texts.index, dtype=object)

    fix.__annotations__ = {"texts": pd.Series, "return": pd.Series}
    wkt = F.pandas_udf(fix, "string").asNondeterministic()
    return regions.withColumn(geometry, wkt(F.col(geometry))).filter(F.col(geometry).isNotNull())


def hull(points: np.ndarray) -> np.ndarray:
    """Convex hull by the monotone chain, counterclockwise, without corners on its sides."""
    p = np.unique(points, axis=0)
    if len(p) <= 2:
        return p

    def half(own: np.ndarray) -> list:
        out: list = []
        for q in own.tolist():
            while len(out) >= 2 and (out[-1][0] - out[-2][0]) * (q[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (q[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(q)
        return out

    return np.asarray(half(p)[:-1] + half(p[::-1])[:-1])


def convex_hulls(points: DataFrame, group: str = "city") -> DataFrame:
    """Per group: corners, area and the hull as WKT of its located points.

    Three rounds: every batch of points is reduced to its own hull where it lies, those hulls in 64 parts per group, and what
    is left of them to the hull: nothing but corners of hulls is gathered.
    """
    located = points.filter("x is not null and y is not null and not isnan(x) and not isnan(y)").filter(F.col(group).isNotNull()).select(F.col(group).alias("grp"), "x", "y")

    def reduce(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for g, own in f.groupby("grp"):
                h = hull(own[["x", "y"]].to_numpy())
                yield pd.DataFrame({"grp": g, "x": h[:, 0], "y": h[:, 1]})

    def finish(own: pd.DataFrame) -> pd.DataFrame:
        h = hull(own[["x", "y"]].to_numpy())
        area = abs(ring_area(h)) if len(h) >= 3 else 0.0
        return pd.DataFrame([(own["grp"].iloc[0], len(h), area, to_wkt([[h]]) if len(h) >= 3 else None)], columns=[group, "corners", "area_m2", "geometry"])

    corner = "grp string, x double, y double"
    parts = located.mapInPandas(reduce, corner).groupBy("grp", F.pmod(F.xxhash64("x", "y"), F.lit(64)).alias("part"))
    return parts.applyInPandas(lambda own: next(reduce([own])), corner).groupBy("grp").applyInPandas(finish, f"{group} string, corners int, area_m2 double, geometry string")


def rings_of(ways: list[list[tuple[float, float]]]) -> list[list[tuple[float, float]]]:
    """Closed rings from unordered, unoriented ways whose ends agree to seven decimals.

    The ways are the edges of a graph over their rounded ends. Where every end has an even number of ways, its edges fall
    into closed trails, and each trail is cut into rings wherever it comes back to an end it has passed. A way that is closed
    by itself is a ring. ValueError if some end has an odd number of ways (a ring stays open) or a ring has under four points.
    """
    key = lambda p: (round(p[0], 7), round(p[1], 7))
    ways = [w for w in ways if len(w) >= 2]
    ends = [(key(w[0]), key(w[-1])) for w in ways]
    at: dict[tuple, list[int]] = {}
    for k, pair in enumerate(ends):
        for end in pair:
            at.setdefault(end, []).append(k)
    if any(len(own) % 2 for own in at.values()):
        raise ValueError("a ring stays open")
    unused, rings = set(range(len(ways))), []
    for first in range(len(ways)):
        if first not in unused:
            continue
        trail: list[tuple[tuple, int]] = []  # (end a way was entered at, the way)
        seen = {ends[first][0]: 0}
        here = ends[first][0]
        while True:
            way = next((k for k in at[here] if k in unused), None)
            if way is None:
                break
            unused.discard(way)
            trail.append((here, way))
            here = ends[way][1] if ends[way][0] == here else ends[way][0]
            if here in seen:
                back = seen[here]
                ring = _joined_ways([(ways[k] if ends[k][0] == entered else ways[k][::-1]) for entered, k in trail[back:]])
                if len(ring) < 4:
                    raise ValueError("a ring has fewer than four points")
                rings.append(ring)
                for entered, _ in trail[back + 1 :]:
                    seen.pop(entered, None)
                del trail[back:]
            else:
                seen[here] = len(trail)
    return rings


def _joined_ways(run: list[list[tuple[float, float]]]) -> list[tuple[float, float]]:
    """The points of ways that follow each other, without the repeated ends between them."""
    return [p for k, way in enumerate(run) for p in (way[1:] if k else way)]


def _inside(ring: np.ndarray, p: np.ndarray) -> bool:
    x, y = p
    a, b = ring, np.roll(ring, -1, axis=0)
    cut = (a[:, 1] > y) != (b[:, 1] > y)
    with np.errstate(divide="ignore", invalid="ignore"):
        at = (b[:, 0] - a[:, 0]) * (y - a[:, 1]) / (b[:, 1] - a[:, 1]) + a[:, 0]
    return bool(np.count_nonzero(cut & (x < at)) % 2)


def assemble(outer: list[list[tuple]], inner: list[list[tuple]]) -> list[Polygon]:
    """Polygons from outer and inner ways: each hole goes to the smallest outer ring that holds it. ValueError if none does."""
    parts = [[np.asarray(r, dtype=float)[:-1]] for r in rings_of(outer)]
    by_size = sorted(parts, key=lambda part: abs(ring_area(part[0])))
    for r in rings_of(inner) if inner else []:
        hole = np.asarray(r, dtype=float)[:-1]
        held = next((part for part in by_size if all(_inside(part[0], p) or (part[0] == p).all(axis=1).any() for p in hole)), None)
        if held is None:
            raise ValueError("a hole lies in no outer ring")
        held.append(hole)
    return parts


BOUNDARY = "relation_id bigint, geometry string, area_deg2 double, bbox string, problem string"


def relation_polygons(members: DataFrame) -> DataFrame:
    """One row per relation of (relation_id, role, way_no, pos, lon, lat): its polygon as WKT, or the problem that prevents it.

    The members of one relation are gathered in one task; a relation is a bounded thing (a few thousand points).
    """

    def run(own: pd.DataFrame) -> pd.DataFrame:
        ways: dict[str, dict] = {"outer": {}, "inner": {}}
        for r in own.sort_values(["way_no", "pos"]).itertuples():
            role = "inner" if r.role == "inner" else "outer"
            ways[role].setdefault(r.way_no, []).append((r.lon, r.lat))
        rid = int(own["relation_id"].iloc[0])
        try:
            parts = repaired(assemble(list(ways["outer"].values()), list(ways["inner"].values())))
        except ValueError as e:
            return pd.DataFrame([(rid, None, None, None, str(e))], columns=[c.split()[0] for c in BOUNDARY.split(", ")])
        p = np.concatenate([part[0] for part in parts]) if parts else np.zeros((1, 2))
        box = ", ".join(f"{v:.8f}" for v in (*p.min(axis=0), *p.max(axis=0)))
        return pd.DataFrame([(rid, to_wkt(parts), sum(map(polygon_area, parts)), box, None)], columns=[c.split()[0] for c in BOUNDARY.split(", ")])

    return members.groupBy("relation_id").applyInPandas(run, BOUNDARY)


# Kinds of administrative boundaries by level, and the tags that make a boundary of level 8 a municipal one.
KIND_OF_LEVEL = {4: "STATE_OR_UT", 5: "DISTRICT", 6: "SUBDISTRICT", 7: "METROPOLITAN_AREA"}
MUNICIPAL_LEVEL, MUNICIPAL, OTHER_KIND, UNKNOWN_KIND = 8, "MUNICIPAL_OR_CITY_BOUNDARY", "OTHER_ADMINISTRATIVE", "UNKNOWN"
MUNICIPAL_GOVERNMENTS = ("municipality", "municipal corporation", "municipal_corporation", "city council", "city_council", "municipal council", "municipal_council")
MUNICIPAL_PLACES = ("city", "town", "municipality")


def administrative_kind(tags: Column) -> tuple[Column, Column]:
    """(kind, reason) of a boundary relation by its tags (a map of texts).

    Levels 4 to 7 have one kind each; level 8 is municipal only if its government or its place says so, and unknown otherwise;
    whole numbers outside 4 to 8 are another administrative kind. Relations that are no administrative boundary and levels
    that are no whole number are unknown.
    """
    raw = lambda k: F.coalesce(F.try_element_at(tags, F.lit(k)), F.lit(""))
    plain = lambda k: F.lower(F.regexp_replace(raw(k), r"^\s+|\s+$", ""))
    level = F.when(plain("admin_level").rlike(r"^[+-]?\d+$"), plain("admin_level").try_cast("int"))
    admin = F.lower(raw("boundary")) == "administrative"
    urban = plain("government").isin(*MUNICIPAL_GOVERNMENTS) | plain("place").isin(*MUNICIPAL_PLACES)
    known = F.create_map(*[x for k, v in KIND_OF_LEVEL.items() for x in (F.lit(k), F.lit(v))])
    municipal = level == MUNICIPAL_LEVEL
    kind = F.when(~admin | level.isNull(), UNKNOWN_KIND).when(level.isin(*KIND_OF_LEVEL), F.try_element_at(known, level)).when(municipal & urban, MUNICIPAL).when(municipal, UNKNOWN_KIND).otherwise(OTHER_KIND)
    reason = (
        F.when(~admin, "not tagged as an administrative boundary")
        .when(level.isNull(), "admin_level is missing or no number")
        .when(level.isin(*KIND_OF_LEVEL), F.concat(F.lit("by admin_level "), level.cast("string")))
        .when(municipal & urban, "admin_level 8 with a municipal government or place tag")
        .when(municipal, "admin_level 8 without a municipal government or place tag")
        .otherwise(F.concat(F.lit("admin_level "), level.cast("string"), F.lit(" is outside 4 to 8")))
    )
    return kind, reason


def _tile(c: str, width: float) -> Column:
    return F.floor(F.col(c) / width)


def near_roads(points: DataFrame, roads: DataFrame, within: float, keep: tuple[str, ...] = ("point_id",)) -> DataFrame:
    """(city, *keep, d): distance of each point (city, keep, x, y) to the nearest road (city, ax, ay, bx, by) up to `within`.

    Roads are spread over the tiles (twice as wide as `within`) that their boxes, widened by it, meet; points stand in one tile.
    """
    w = max(2 * within, 1.0)
    lo = lambda a, b: F.least(F.col(a), F.col(b))
    hi = lambda a, b: F.greatest(F.col(a), F.col(b))
    box = roads.filter("ax is not null and ay is not null and bx is not null and by is not null").select("city", "ax", "ay", "bx", "by", lo("ax", "bx").alias("lx"), hi("ax", "bx").alias("hx"), lo("ay", "by").alias("ly"), hi("ay", "by").alias("hy"))
    tiles = box.select("*", F.explode(F.sequence(F.floor((F.col("lx") - within) / w), F.floor((F.col("hx") + within) / w))).alias("tx")).select("city", "ax", "ay", "bx", "by", "tx", F.explode(F.sequence(F.floor((F.col("ly") - within) / w), F.floor((F.col("hy") + within) / w))).alias("ty"))
    both = points.withColumn("tx", _tile("x", w)).withColumn("ty", _tile("y", w)).join(tiles, ["city", "tx", "ty"])
    d = distance_to_segment(F.col("x"), F.col("y"), F.col("ax"), F.col("ay"), F.col("bx"), F.col("by"))
    return both.select("city", *keep, d.alias("d")).filter(F.col("d") <= within).groupBy("city", *keep).agg(F.min("d").alias("d"))


def _inside_row(part: Polygon, xs: np.ndarray, y: float) -> np.ndarray:
    """Which of the places (xs, y) lie within the part by the even-odd rule, its border left out."""
    odd, border = np.zeros(len(xs), bool), np.zeros(len(xs), bool)
    for ring in part:
        (x0, y0), (x1, y1) = ring.T, np.roll(ring, -1, axis=0).T
        for k in np.flatnonzero((np.minimum(y0, y1) <= y) & (y <= np.maximum(y0, y1))):
            if y0[k] == y1[k]:
                border |= (xs >= min(x0[k], x1[k])) & (xs <= max(x0[k], x1[k]))
                continue
            cut = x0[k] + (y - y0[k]) * (x1[k] - x0[k]) / (y1[k] - y0[k])
            border |= np.abs(xs - cut) <= 1e-9
            if (y0[k] > y) != (y1[k] > y):
                odd ^= cut > xs
    return odd & ~border


EXTENT_POINT = "city string, place string, point_id bigint, x double, y double"


def extent_lattice(regions: DataFrame, step: float = 500.0, start: float = 0.0) -> DataFrame:
    """Points every `step` metres within each whole region (region_id, city, geometry), from `start` beyond its box's lower left corner.

    `city` of the result is the region's id, so that points meet the roads of their region only; `place` is the city. A
    region that holds no point is stood for by its centroid. Regions without area give no points. Made row by row.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for rid, city, text in zip(batch["region_id"], batch["city"], batch["geometry"]):
                parts = parse_polygons(text)
                middle = centroid(parts)
                if middle is None:
                    continue
                corners = np.concatenate([part[0] for part in parts])
                (lx, ly), (hx, hy) = corners.min(axis=0), corners.max(axis=0)
                xs = lx + start + step * np.arange(max(0, math.floor((hx - lx - start) / step)) + 1)
                held, none = [], True
                for j in range(max(0, math.floor((hy - ly - start) / step)) + 1):
                    y = ly + start + step * j
                    own = np.flatnonzero(np.any([_inside_row(part, xs, y) for part in parts], axis=0))
                    if len(own):
                        held.append(pd.DataFrame({"city": str(rid), "place": city, "point_id": j * len(xs) + own, "x": xs[own], "y": y}))
                    if len(held) >= 256:
                        none = False
                        yield pd.concat(held)
                        held = []
                if held:
                    yield pd.concat(held)
                elif none:
                    yield pd.DataFrame({"city": [str(rid)], "place": [city], "point_id": [0], "x": [middle[0]], "y": [middle[1]]})

    return regions.filter("region_id is not null and city is not null and geometry is not null").select("region_id", "city", "geometry").mapInPandas(run, EXTENT_POINT)


def clipped_to_regions(roads: DataFrame, triangles: DataFrame, tile: float = 2000.0) -> DataFrame:
    """(city, ax, ay, bx, by) with the region's id as city: the parts of the roads (city, ax, ay, bx, by) within each region
    of their city, border included, cut at the region's triangles (spatial.triangles). An equi-join on tiles, in the JVM."""
    at = lambda c: F.floor(c / tile)
    spans = lambda df, lx, hx, ly, hy: df.withColumn("tx", F.explode(F.sequence(at(lx), at(hx)))).withColumn("ty", F.explode(F.sequence(at(ly), at(hy))))
    c = F.col
    r = spans(roads.filter("ax is not null and ay is not null and bx is not null and by is not null").select("city", "ax", "ay", "bx", "by"), F.least("ax", "bx"), F.greatest("ax", "bx"), F.least("ay", "by"), F.greatest("ay", "by"))
    turn = (c("x1") - c("x0")) * (c("y2") - c("y0")) - (c("y1") - c("y0")) * (c("x2") - c("x0"))
    t = triangles.select("*", F.signum(turn).alias("s")).filter("s <> 0").withColumnRenamed("grp", "city")
    t = spans(t, F.least("x0", "x1", "x2"), F.greatest("x0", "x1", "x2"), F.least("y0", "y1", "y2"), F.greatest("y0", "y1", "y2"))
    cut = r.join(t, ["city", "tx", "ty"]).filter("least(ax, bx) <= greatest(x0, x1, x2) and greatest(ax, bx) >= least(x0, x1, x2) and least(ay, by) <= greatest(y0, y1, y2) and greatest(ay, by) >= least(y0, y1, y2)")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            (ax, ay), (dx, dy) = (b["ax"].to_numpy(), b["ay"].to_numpy()), ((b["bx"] - b["ax"]).to_numpy(), (b["by"] - b["ay"]).to_numpy())
            sign, t0, t1 = b["s"].to_numpy(), np.zeros(len(b)), np.ones(len(b))
            for k in range(3):
                px, py, qx, qy = (b[f"{v}{n % 3}"].to_numpy() for n in (k, k + 1) for v in "xy")
                fa = sign * ((qx - px) * (ay - py) - (qy - py) * (ax - px))
                fb = sign * ((qx - px) * (ay + dy - py) - (qy - py) * (ax + dx - px))
                at = fa / np.where(fa == fb, 1.0, fa - fb)
                t0 = np.where((fa < 0) & (fb < 0), 2.0, np.where(fa < 0, np.maximum(t0, at), t0))
                t1 = np.where((fb < 0) & (fa >= 0), np.minimum(t1, at), t1)
            held = t0 <= t1
            yield pd.DataFrame({"city": b["region_id"].astype(str), "ax": ax + t0 * dx, "ay": ay + t0 * dy, "bx": ax + t1 * dx, "by": ay + t1 * dy})[held]

    return cut.select("region_id", "ax", "ay", "bx", "by", "s", *[f"{v}{k}" for k in range(3) for v in "xy"]).mapInPandas(run, "city string, ax double, ay double, bx double, by double").distinct()


def nearest_roads(points: DataFrame, roads: DataFrame, reach: float = 500.0, keep: tuple[str, ...] = ("point_id",)) -> DataFrame:
    """(city, *keep, d): the exact distance of every point (city, keep, x, y) to the nearest road, however far; d is null where a
    city has no road.

    Points that find no road within reach are searched again with doubled reach. From the second round on, the roads stand in
    cells of an eighth of the reach, and only cells whose box may hold the nearest road are opened: per point a bounded number
    of boxes is looked at, and the roads of a few.
    """
    points = stored(points)
    roads = stored(roads.filter("ax is not null and ay is not null and bx is not null and by is not null"))
    done = stored(near_roads(points, roads, reach, keep))
    pending = stored(points.join(small(roads.select("city").distinct()), "city", "left_semi").join(done, ["city", *keep], "left_anti"))
    found = [done]
    while not pending.isEmpty():
        reach *= 2
        found.append(stored(_near_by_cells(pending, roads, reach, keep)))
        pending = stored(pending.join(found[-1], ["city", *keep], "left_anti"))
    all_found = found[0]
    for more in found[1:]:
        all_found = all_found.unionByName(more)
    return points.select("city", *keep).join(all_found, ["city", *keep], "left")


def _near_by_cells(points: DataFrame, roads: DataFrame, within: float, keep: tuple[str, ...]) -> DataFrame:
    """near_roads() by way of the boxes of cells of roads."""
    c, w, side = F.col, 2 * within, within / 8
    held = roads.withColumn("cx", F.floor((c("ax") + c("bx")) / 2 / side)).withColumn("cy", F.floor((c("ay") + c("by")) / 2 / side))
    low, high = lambda a, b: F.min(F.least(a, b)), lambda a, b: F.max(F.greatest(a, b))
    boxes = held.groupBy("city", "cx", "cy").agg(low("ax", "bx").alias("lx"), high("ax", "bx").alias("hx"), low("ay", "by").alias("ly"), high("ay", "by").alias("hy"))
    span = lambda a, b: F.explode(F.sequence(F.floor((c(a) - within) / w), F.floor((c(b) + within) / w)))
    tiles = boxes.withColumn("tx", span("lx", "hx")).withColumn("ty", span("ly", "hy"))
    gap = lambda v, a, b: F.greatest(c(a) - c(v), c(v) - c(b), F.lit(0.0))
    far = lambda v, a, b: F.greatest(F.abs(c(v) - c(a)), F.abs(c(v) - c(b)))
    meet = points.withColumn("tx", _tile("x", w)).withColumn("ty", _tile("y", w)).join(tiles, ["city", "tx", "ty"])
    meet = meet.select("city", *keep, "x", "y", "cx", "cy", F.hypot(gap("x", "lx", "hx"), gap("y", "ly", "hy")).alias("least_d"), F.hypot(far("x", "lx", "hx"), far("y", "ly", "hy")).alias("most_d")).filter(c("least_d") <= within)
    # A cell is opened if its box is no farther than the farthest corner of the best box: a road is surely that near.
    best = meet.groupBy("city", *keep, "x", "y").agg(F.min("most_d").alias("u"), F.collect_list(F.struct("least_d", "cx", "cy")).alias("near"))
    opened = best.select("city", *keep, "x", "y", F.explode(F.filter("near", lambda b: b["least_d"] <= c("u") * (1 + 1e-12))).alias("b")).select("city", *keep, "x", "y", "b.cx", "b.cy")
    d = distance_to_segment(c("x"), c("y"), c("ax"), c("ay"), c("bx"), c("by"))
    return opened.join(held, ["city", "cx", "cy"]).select("city", *keep, d.alias("d")).filter(c("d") <= within).groupBy("city", *keep).agg(F.min("d").alias("d"))


def lattice(cells: DataFrame, step: float, cell: float = 500.0) -> DataFrame:
    """Points every `step` metres (cell centres of a finer grid) of grid cells (city, grid_id, center_x, center_y)."""
    n = max(1, int(round(cell / step)))
    offset = lambda k: (F.col(k) + 0.5) * F.lit(cell / n) - F.lit(cell / 2)
    i = cells.select("city", "grid_id", "center_x", "center_y", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("i")).select("*", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("j"))
    return i.select("city", (F.col("grid_id") * (n * n) + F.col("j") * n + F.col("i")).alias("point_id"), (F.col("center_x") + offset("i")).alias("x"), (F.col("center_y") + offset("j")).alias("y"))


def buffer_coverage(points: DataFrame, roads: DataFrame, widths: tuple[float, ...] = (50.0, 100.0, 250.0)) -> DataFrame:
    """Per city and width: the share of lattice points within that distance of a road.

    This estimates the area share of the union of road buffers; its resolution is the lattice step.
    """
    d = near_roads(points, roads, max(widths))
    total = points.groupBy("city").agg(F.count("*").alias("n_points"))
    hits = d.groupBy("city").agg(*[F.count_if(F.col("d") <= w).alias(f"w{k}") for k, w in enumerate(widths)])
    both = total.join(hits, "city", "left").na.fill(0)
    rows = F.explode(F.array(*[F.struct(F.lit(w).alias("width_m"), (100 * F.col(f"w{k}") / F.col("n_points")).alias("covered_pct")) for k, w in enumerate(widths)])).alias("r")
    return both.select("city", "n_points", rows).select("city", "r.width_m", "n_points", "r.covered_pct")


def distance_thresholds(distances: DataFrame, total: DataFrame, limits: tuple[float, ...] = (100.0, 250.0, 500.0)) -> DataFrame:
    """Per city: mean, median and 90th percentile of the distances there are, and the share of all points within each limit."""
    stats = distances.groupBy("city").agg(F.avg("d").alias("mean_d"), F.median("d").alias("median_d"), F.percentile("d", 0.9).alias("p90_d"), *[F.count_if(F.col("d") <= w).alias(f"n{int(w)}") for w in limits])
    both = total.groupBy("city").agg(F.count("*").alias("n_points")).join(stats, "city", "left").na.fill(0, [f"n{int(w)}" for w in limits])
    return both.select("city", "n_points", "mean_d", "median_d", "p90_d", *[(100 * F.col(f"n{int(w)}") / F.col("n_points")).alias(f"within_{int(w)}m_pct") for w in limits])


def great_circle_m(lon_a: float, lat_a: float, lon_b: float, lat_b: float, radius: float = 6371000.0) -> float:
    p, q = math.radians(lat_a), math.radians(lat_b)
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(lon_b - lon_a) / 2) ** 2
    return 2 * radius * math.asin(math.sqrt(h))


CORNER = "id bigint, city string, part int, ring int, pos int, x double, y double"


def corners(regions: DataFrame, region_id: str = "region_id", group: str = "city", geometry: str = "geometry") -> DataFrame:
    """One row per corner of every areal geometry: id, city, part, ring (0 the outer one), pos, x, y. Rings are open."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(i, c, k, j, n, float(x), float(y)) for i, c, text in batch.itertuples(index=False) for k, part in enumerate(parse_polygons(text)) for j, ring in enumerate(part) for n, (x, y) in enumerate(ring)]
            yield pd.DataFrame(rows, columns=[f.split()[0] for f in CORNER.split(", ")])

    return regions.select(F.col(region_id).cast("bigint"), F.col(group).cast("string"), F.col(geometry).cast("string")).filter(F.col(geometry).isNotNull()).mapInPandas(run, CORNER)


def from_corners(rows: DataFrame) -> DataFrame:
    """(id, city, geometry): corners() put together as WKT. The corners of one geometry are gathered: a bounded thing."""
    number = lambda c: F.col(c).cast("string")
    ring = rows.groupBy("id", "city", "part", "ring").agg(F.array_sort(F.collect_list(F.struct("pos", F.concat_ws(" ", number("x"), number("y")).alias("p")))).alias("ps"))
    points = F.transform("ps", lambda p: p["p"])
    closed = F.concat(F.lit("("), F.array_join(F.concat(points, F.slice(points, 1, 1)), ", "), F.lit(")"))
    part = ring.select("id", "city", "part", F.struct("ring", closed.alias("t")).alias("r")).groupBy("id", "city", "part").agg(F.array_sort(F.collect_list("r")).alias("rs"))
    text = F.concat(F.lit("("), F.array_join(F.transform("rs", lambda r: r["t"]), ", "), F.lit(")"))
    whole = part.select("id", "city", F.struct("part", text.alias("t")).alias("p")).groupBy("id", "city").agg(F.array_sort(F.collect_list("p")).alias("ps"))
    return whole.select("id", "city", F.concat(F.lit("MULTIPOLYGON ("), F.array_join(F.transform("ps", lambda p: p["t"]), ", "), F.lit(")")).alias("geometry"))
