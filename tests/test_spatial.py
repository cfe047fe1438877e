import json
import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from roadloom.functions import polygons as P
from roadloom.operators import blocks, shapes, spatial

SQUARE = "POLYGON ((0 0, 10 0, 10 10, 0 10, 0 0), (2 2, 2 4, 4 4, 4 2, 2 2))"


def even_odd(parts, x, y):
    held = False
    for part in parts:
        inside = False
        for r in part:
            for (ax, ay), (bx, by) in zip(r, np.roll(r, -1, axis=0)):
                inside ^= (ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax
        held |= inside
    return held


@pytest.mark.parametrize("text", [None, "", " ", "POINT (1 2)", "MULTIPOLYGON EMPTY", "nonsense", "{}", '{"type": "Point", "coordinates": [1, 2]}', "POLYGON ((0 0, 1 1))", "POLYGON ((0 0, 1 1, 0 0))", "{broken"])
def test_no_polygon(text):
    assert len(P.region_triangles(text)) == 0


def test_notations_agree():
    texts = [SQUARE, SQUARE.lower().replace("polygon (", "Polygon("), "MULTIPOLYGON (" + SQUARE[8:] + ")", '{"type": "Polygon", "coordinates": [[[0,0],[0,10],[10,10],[10,0],[0,0]],[[2,2],[4,2],[4,4],[2,4],[2,2]]]}']
    for t in texts:
        assert sum(map(P.polygon_area, P.parse_polygons(t))) == 96
        assert math.isclose(sum(abs(P.ring_area(x)) for x in P.region_triangles(t)), 96)


def test_borders_and_holes():
    h = P.Hierarchy(P.region_triangles(SQUARE))
    x, y = np.array([0.0, 5, 3, 2, 10, 10.0000001, 5, 1]), np.array([0.0, 5, 3, 3, 10, 5, 0, 1])
    assert set(h.hits(x, y)[0].tolist()) == {0, 1, 3, 4, 6, 7}


def test_crossing_rings_follow_even_odd():
    bow = "POLYGON ((0 0, 10 10, 10 0, 0 10, 0 0))"
    h = P.Hierarchy(P.region_triangles(bow))
    assert set(h.hits(np.array([1.0, 9, 5, 5]), np.array([5.0, 5, 1, 9]))[0].tolist()) == {0, 1}


def star(seed, corners, holes):
    rnd = random.Random(seed)
    angles = sorted(rnd.uniform(0, 2 * math.pi) for _ in range(corners))
    ring = [(round(100 * rnd.uniform(0.4, 1) * math.cos(a), 2), round(100 * rnd.uniform(0.4, 1) * math.sin(a), 2)) for a in angles]
    ring = [(round(r * math.cos(a), 2), round(r * math.sin(a), 2)) for a, r in ((a, 100 * rnd.uniform(0.4, 1)) for a in angles)]
    inner = [[(cx - 3, cy - 3), (cx + 3, cy - 2), (cx + 1, cy + 3)][:: rnd.choice([1, -1])] for cx, cy in ((-15, -10), (12, 8), (0, -20))[:holes]]
    return [[*r, r[0]] for r in [ring[:: rnd.choice([1, -1])], *inner]]


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.integers(12, 60), st.integers(0, 3))
def test_triangles_match_ray_casting(seed, corners, holes):
    text = json.dumps({"type": "Polygon", "coordinates": star(seed, corners, holes)})
    parts = P.parse_polygons(text)
    rnd = random.Random(seed)
    x, y = np.array([[rnd.uniform(-100, 100) for _ in range(300)] for _ in range(2)])
    got = set(P.Hierarchy(P.region_triangles(text), leaf=3).hits(x, y)[0].tolist())
    assert got == {k for k in range(300) if even_odd(parts, x[k], y[k])}


def test_exact_orientation():
    a = np.array([1e17, 0.1, 0.5])
    assert P.orientation(0.1, 0.1, 0.3, 0.3, 0.2, 0.2) in (-1, 0, 1)
    assert P.orientation(a, a, 2 * a, 2 * a, 3 * a, 3 * a).tolist() == [1.0 * (s > 0) - (s < 0) for s in [(2 * v - v) * (3 * v - v) - (2 * v - v) * (3 * v - v) for v in a]]
    assert P.orientation(0.0, 0.0, 1.0, 0.0, 0.5, 5e-324) == 1


NODES = "node_id bigint, city string, x double, y double, loaded_at int"


def brute_near(rows, d):
    p = sorted({(c, i, x, y) for i, c, x, y, _ in rows if c is not None and x is not None and y is not None and not math.isnan(x) and not math.isnan(y)})
    return {(min(a[1], b[1]), max(a[1], b[1])) for k, a in enumerate(p) for b in p[k + 1 :] if a[0] == b[0] and a[1] != b[1] and math.hypot(a[2] - b[2], a[3] - b[3]) <= d + 1e-8}


def test_near_against_brute_force(spark):
    rnd = random.Random(3)
    rows = [(i, rnd.choice(["A", "B", None]), round(rnd.uniform(-60, 60), 2), round(rnd.uniform(-60, 60), 2), 0) for i in range(300)]
    rows += [(900, "A", None, 1.0, 0), (901, "A", float("nan"), 1.0, 0), (902, "A", 10.0, 10.0, 0), (902, "A", 10.0, 10.0, 1), (903, "A", 10.0, 10.0, 0), (904, "A", 16.0, 18.0, 0), (905, "A", 20.0, 10.0, 0)]
    got = {tuple(r) for r in spatial.near(spark.createDataFrame(rows, NODES), 10.0).collect()}
    assert got == brute_near(rows, 10.0)
    assert {(902, 903), (902, 904), (902, 905)} <= got
    assert {tuple(r) for r in spatial.near(spark.createDataFrame(rows, NODES), 0.0).collect()} == brute_near(rows, 0.0)
    assert spatial.near(spark.createDataFrame([], NODES), 10.0).collect() == []


def test_regions_by_blocks_of_any_size(spark):
    rnd = random.Random(4)
    rows = [(i, rnd.choice("AB"), rnd.uniform(-110, 110), rnd.uniform(-110, 110), 0) for i in range(400)] + [(990, "A", None, 0.0, 0), (991, None, 0.0, 0.0, 0)]
    regions = [(1, "A", json.dumps({"type": "Polygon", "coordinates": star(1, 40, 2)})), (2, "B", json.dumps({"type": "MultiPolygon", "coordinates": [star(2, 30, 1), star(2, 30, 1)]})), (3, "A", None), (4, "A", "POINT (1 1)"), (5, None, SQUARE)]
    n, r = spark.createDataFrame(rows, NODES), spark.createDataFrame(regions, "region_id bigint, city string, geometry string")
    want = {(rid, i) for rid, c, g in regions if c for i, city, x, y, _ in rows if city == c and x is not None and even_odd(P.parse_polygons(g), x, y)}
    assert {tuple(t) for t in spatial.in_regions(n, r).collect()} == want
    assert {tuple(t) for t in spatial.in_regions(n, r, block=3, most_points=5).collect()} == want
    assert spatial.in_regions(n, r.limit(0)).collect() == [] and spatial.in_regions(n.limit(0), r).collect() == []


def test_shapes(spark):
    ways = [[(0, 0), (5, 0)], [(5, 5), (0, 5)], [(5, 0), (5, 5)], [(0, 0), (0, 5)]]
    ring = shapes.rings_of(ways)
    assert len(ring) == 1 and ring[0][0] == ring[0][-1] and len(ring[0]) == 5
    with pytest.raises(ValueError, match="open"):
        shapes.rings_of(ways[:3])
    parts = shapes.assemble(ways, [[(1, 1), (2, 1), (2, 2), (1, 1)]])
    assert P.polygon_area(parts[0]) == 24.5
    with pytest.raises(ValueError, match="no outer ring"):
        shapes.assemble(ways, [[(8, 8), (9, 8), (9, 9), (8, 8)]])
    inside = [[(1, 1), (4, 1), (4, 4), (1, 4), (1, 1)]]
    assert [len(p) for p in shapes.assemble(ways + inside, [[(2, 2), (3, 2), (3, 3), (2, 2)]])] == [1, 2]  # the smallest ring holds the hole
    eight = [[(0, 0), (1, 0)], [(1, 0), (1, 1), (0, 0)], [(0, 0), (-1, 0), (-1, -1)], [(0, 0), (-1, -1)]]
    assert sorted(len(r) for r in shapes.rings_of(eight)) == [4, 4]
    with pytest.raises(ValueError, match="four"):
        shapes.rings_of([[(0, 0), (1, 1)], [(1, 1), (0, 0)]])
    assert np.allclose(shapes.centroid(P.parse_polygons("POLYGON ((0 0, 4 0, 4 2, 0 2, 0 0))")), (2, 1))
    spike = shapes.repaired(P.parse_polygons("POLYGON ((0 0, 4 0, 9 0, 4 0, 4 4, 0 4, 0 0))"))
    assert P.polygon_area(spike[0]) == 16 and len(spike[0][0]) == 4
    line = np.array([(0, 0), (1, 0.1), (2, -0.1), (3, 5), (4, 6), (5, 7), (6, 8.1), (7, 9), (8, 9), (9, 9)], dtype=float)
    assert len(shapes.simplify_line(line, 1.0)) == 5 and len(shapes.simplify_line(line, 0.0)) == 8
    assert len(shapes.hull(np.array([(0, 0), (4, 0), (4, 4), (0, 4), (2, 2), (2, 0)], dtype=float))) == 4
    assert blocks.cut_vertices(np.array([1, 2, 3, 3, 4]), np.array([2, 3, 1, 4, 5])) == ({3, 4}, {(3, 4), (4, 5)})
    members = spark.createDataFrame([(1, "outer", w, p, float(x), float(y)) for w, way in enumerate(ways) for p, (x, y) in enumerate(way)] + [(2, "outer", 0, p, float(p), 0.0) for p in range(3)], "relation_id bigint, role string, way_no int, pos int, lon double, lat double")
    got = {r.relation_id: r for r in shapes.relation_polygons(members).collect()}
    assert got[1].area_deg2 == 25 and got[1].bbox.startswith("0.00000000, 0.00000000, 5.0") and got[2].problem


def test_extent_points_have_exact_distances_however_far(spark):
    rnd = random.Random(7)
    outline = "POLYGON ((0 0, 40000 0, 40000 9000, 20000 9000, 20000 3000, 0 3000, 0 0), (30000 4000, 33000 4000, 33000 7000, 30000 7000, 30000 4000))"
    regions = spark.createDataFrame([(1, "A", outline), (2, "A", "POLYGON ((0 0, 300 0, 300 300, 0 300, 0 0))"), (3, "B", "POLYGON ((0 0, 900 0, 900 900, 0 900, 0 0))"), (4, "A", None), (5, "A", "POINT (1 1)")], "region_id bigint, city string, geometry string")
    lines = [("A", x, y, x + rnd.uniform(-90, 90), y + rnd.uniform(-90, 90)) for x, y in ((rnd.uniform(300, 2000), rnd.uniform(200, 2800)) for _ in range(200))] + [("A", 10000.0, 5000.0, 10000.0, 2000.0)]
    roads = spark.createDataFrame(lines, "city string, ax double, ay double, bx double, by double")
    points = {(r.city, r.x, r.y): r.point_id for r in shapes.extent_lattice(regions).collect()}
    hole = lambda x, y: 30000 <= x <= 33000 and 4000 <= y <= 7000
    grid = [(500.0 * i, 500.0 * j) for i in range(81) for j in range(19)]
    want = {("1", x, y) for x, y in grid if 0 < x < 40000 and 0 < y < 9000 and (y < 3000 or x > 20000) and not hole(x, y)}
    assert set(points) == want | {("2", 150.0, 150.0), ("3", 500.0, 500.0)}
    inner = shapes.clipped_to_regions(roads, spatial.triangles(regions))
    assert max(r.ay for r in inner.filter("city = '1' and ax = 10000").collect()) <= 3000
    got = {(r.city, r.point_id): r.d for r in shapes.nearest_roads(shapes.extent_lattice(regions), inner).collect()}
    assert len(got) == len(points) and got["3", points["3", 500.0, 500.0]] is None
    clipped = [*lines[:-1], ("A", 10000.0, 3000.0, 10000.0, 2000.0)]

    def brute(x, y):
        def one(ax, ay, bx, by):
            dx, dy = bx - ax, by - ay
            t = min(1.0, max(0.0, ((x - ax) * dx + (y - ay) * dy) / (dx * dx + dy * dy)))
            return math.hypot(x - ax - t * dx, y - ay - t * dy)

        return min(one(*r[1:]) for r in clipped)

    assert all(math.isclose(got[c, k], brute(x, y), abs_tol=1e-6) for (c, x, y), k in points.items() if c == "1")
    assert max(d for d in got.values() if d is not None) > 25_000


def test_administrative_kinds(spark):
    cases = [
        ({"boundary": "Administrative", "admin_level": "4"}, "STATE_OR_UT"),
        ({"boundary": "administrative", "admin_level": " 5", "place": "city"}, "DISTRICT"),
        ({"boundary": "administrative", "admin_level": "6", "government": "municipality"}, "SUBDISTRICT"),
        ({"boundary": "administrative", "admin_level": "7"}, "METROPOLITAN_AREA"),
        ({"boundary": "administrative", "admin_level": "8", "government": " Municipal Corporation "}, "MUNICIPAL_OR_CITY_BOUNDARY"),
        ({"boundary": "administrative", "admin_level": "8", "place": "Town"}, "MUNICIPAL_OR_CITY_BOUNDARY"),
        ({"boundary": "administrative", "admin_level": "8", "name": "Some Corporation"}, "UNKNOWN"),
        ({"boundary": "administrative", "admin_level": "3"}, "OTHER_ADMINISTRATIVE"),
        ({"boundary": "administrative", "admin_level": "9", "place": "city"}, "OTHER_ADMINISTRATIVE"),
        ({"boundary": "administrative", "admin_level": "8.0"}, "UNKNOWN"),
        ({"boundary": "administrative"}, "UNKNOWN"),
        ({"boundary": "postal", "admin_level": "4"}, "UNKNOWN"),
    ]
    df = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(cases)], "k int, tags map<string,string>")
    kind, reason = shapes.administrative_kind(df.tags)
    got = {r.k: r for r in df.select("k", kind.alias("kind"), reason.alias("reason")).collect()}
    assert [got[k].kind for k in range(len(cases))] == [w for _, w in cases] and all(r.reason for r in got.values())


def test_crossing_rings_are_untangled():
    bow = shapes.repaired(P.parse_polygons("POLYGON ((0 0, 4 4, 4 0, 0 4, 0 0))"))
    assert sorted(P.polygon_area(p) for p in bow) == [4, 4]
    rnd = np.random.default_rng(2)
    for _ in range(40):
        part = [rnd.uniform(0, 10, (int(rnd.integers(4, 9)), 2))]
        want = sum(abs(P.ring_area(t)) for t in P.trapezoids(part))
        got = shapes.repaired([part])
        assert np.isclose(sum(map(P.polygon_area, got)), want) and all(map(P.is_simple, got))
    holed = P.parse_polygons("POLYGON ((0 0, 9 0, 9 9, 0 9, 0 0), (2 2, 4 2, 4 4, 2 4, 2 2))")
    assert shapes.repaired(holed)[0][0].tolist() == holed[0][0].tolist() and P.polygon_area(shapes.repaired(holed)[0]) == 77


def test_dissolved_cells(spark):
    from roadloom.operators import grid

    held = [(0, 0), (0, 1), (0, 2), (1, 0), (1, 2), (2, 0), (2, 1), (2, 2), (3, 3), (7, 7)]
    parts = grid.trace(*(np.array(v) for v in zip(*held)))
    assert [len(p) for p in parts] == [2, 1, 1] and sum(map(P.polygon_area, parts)) == len(held)
    cells = spark.createDataFrame([("A", r, c) for r, c in held] * 2 + [("B", 0, 0)], "city string, row int, col int")
    limits = spark.createDataFrame([("A", 1000.0, 2000.0), ("B", 0.0, 0.0)], "city string, x0 double, y0 double")
    got = {r.city: P.parse_polygons(r.geometry) for r in grid.dissolved(cells, limits).collect()}
    assert sum(map(P.polygon_area, got["A"])) == len(held) * 250_000 and got["A"][0][0].min(axis=0).tolist() == [1000.0, 2000.0]
    assert grid.dissolved(cells.limit(0), limits).collect() == []
