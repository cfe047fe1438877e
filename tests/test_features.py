import math
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from roadloom.operators import features, scoring, shapes
from roadloom.sources import pbf


def number(v):
    out = b""
    while True:
        out += bytes([v & 127 | (128 if v > 127 else 0)])
        v >>= 7
        if not v:
            return out


def zigzag(v):
    return v * 2 if v >= 0 else -v * 2 - 1


def field(n, v):
    return number(n << 3) + number(v) if isinstance(v, int) else number(n << 3 | 2) + number(len(v)) + v


def deltas(values):
    return b"".join(number(zigzag(b - a)) for a, b in zip([0, *values], values))


def block(kind, data, zipped=True):
    blob = field(2, len(data)) + field(3, zlib.compress(data)) if zipped else field(1, data)
    head = field(1, kind) + field(3, len(blob))
    return struct.pack(">I", len(head)) + head + blob


def sample():
    table = field(1, b"".join(field(1, s) for s in (b"", b"highway", b"stop", b"building", b"yes", "näme".encode(), b"outer")))
    ids, lats, lons = [10, 12, 11, 2**40], [10_000_000, -250_000_000, 0, 5], [-1, 2, 730_000_000, 0]
    dense = field(2, field(1, deltas(ids)) + field(8, deltas(lats)) + field(9, deltas(lons)) + field(10, bytes([1, 2, 0, 0, 3, 4, 1, 5, 0, 0])))
    node = field(1, field(1, zigzag(-7)) + field(2, bytes([1])) + field(3, bytes([2])) + field(8, zigzag(-30)) + field(9, zigzag(40)))
    way = field(3, field(1, 77) + field(2, bytes([3])) + field(3, bytes([4])) + field(8, deltas([10, 12, 11, 10])))
    relation = field(4, field(1, 5) + field(2, bytes([1])) + field(3, bytes([5])) + field(8, bytes([6, 0])) + field(9, deltas([77, 10])) + field(10, bytes([1, 0])))
    first = table + field(2, dense) + field(2, node + way)
    second = table + field(2, relation) + field(17, 1000) + field(19, 3_000_000_000)
    return block(b"OSMHeader", b"") + block(b"OSMData", first) + block(b"OSMData", second, zipped=False)


def test_pbf(spark, tmp_path):
    (tmp_path / "x.pbf").write_bytes(sample())
    df = pbf.read_pbf(spark, str(tmp_path / "x.pbf"))
    rows = {(r.kind, r.id): r for r in df.collect()}
    assert set(rows) == {("node", k) for k in (10, 12, 11, 2**40, -7)} | {("way", 77), ("relation", 5)}
    assert rows["node", 10].lat == pytest.approx(1.0) and rows["node", 12].lat == pytest.approx(-25.0) and rows["node", 11].lon == pytest.approx(73.0) and rows["node", -7].lat == pytest.approx(-3e-6)
    assert rows["node", 10].tags == {"highway": "stop"} and rows["node", 12].tags == {} and rows["node", 11].tags == {"building": "yes", "highway": "näme"}
    assert rows["way", 77].refs == [10, 12, 11, 10] and rows["way", 77].tags == {"building": "yes"}
    assert [tuple(m) for m in rows["relation", 5].members] == [("way", 77, "outer"), ("node", 10, "")]
    assert {(r.kind, r.id) for r in pbf.within(df, 72.0, -1.0, 74.0, 1.0).collect()} == {("node", 11), ("way", 77), ("relation", 5)}
    ring = features.way_rings(df.filter("kind = 'way'"), df.filter("kind = 'node'")).collect()
    assert len(ring) == 1 and ring[0].geometry.startswith("POLYGON ((") and ring[0].geometry.count(",") == 3


def test_packed_numbers():
    values = [0, 1, 127, 128, 300, 2**31, 2**62, 5]
    assert pbf.packed(b"".join(map(number, values))).tolist() == values
    signed = [0, -1, 5, -(2**40), 2**62 - 1]
    assert pbf.packed(b"".join(number(zigzag(v)) for v in signed), True).tolist() == signed and pbf.packed(b"").tolist() == []


def test_lines_in_boxes(spark):
    box = spark.createDataFrame([("A", 0.0, 0.0, 10.0, 10.0)], "city string, lx double, ly double, hx double, hy double")
    rows = [("A", 1, -5.0, 5.0, 15.0, 5.0), ("A", 2, 2.0, 2.0, 3.0, 9.0), ("A", 3, -5.0, -5.0, -1.0, 20.0), ("A", 4, 5.0, -10.0, 5.0, 30.0), ("A", 5, -5.0, 5.0, 5.0, 15.0), ("A", 6, 20.0, 5.0, 20.0, 6.0), ("A", 7, -2.0, 0.0, 2.0, 8.0), ("B", 8, 1.0, 1.0, 2.0, 2.0)]
    got = {r.k: (r.ax, r.ay, r.bx, r.by) for r in features.clipped_lines(spark.createDataFrame(rows, "city string, k int, ax double, ay double, bx double, by double"), box).collect()}
    assert got == {1: (0, 5, 10, 5), 2: (2, 2, 3, 9), 4: (5, 0, 5, 10), 7: (0, 4, 2, 8)}


def test_search_area(spark):
    centers = spark.createDataFrame([("A", 100.0, 250.0), ("B", None, 1.0)], "city string, x double, y double")
    cells = features.search_cells(centers, 1500.0)
    total = cells.agg(F.sum("cell_area_m2")).first()[0]
    assert math.isclose(total, 0.5 * 64 * 1500**2 * math.sin(2 * math.pi / 64), rel_tol=1e-9) and cells.agg(F.max("cell_area_m2")).first()[0] == pytest.approx(250000)
    land = spark.createDataFrame([("A", 1, "POLYGON ((10 10, 600 10, 600 600, 10 600, 10 10))"), ("A", 2, "POLYGON ((0 0, 9 0, 9 9, 0 0))")], "city string, polygon_id bigint, geometry string")
    assert features.cells_touched(land, cells).first().n_cells == 4


def test_places_and_references(spark):
    b = spark.createDataFrame([("A", 0.0, 0.0, 1.0), ("A", 10.0, 0.0, 3.0)], "city string, x double, y double, area_m2 double")
    c = spark.createDataFrame([("A", 7.5, 1000.0)], "city string, x double, y double")
    assert features.check_place(b, c).first().distance_km == 1.0
    with pytest.raises(ValueError, match="far from"):
        features.check_place(b, c, 0.5)
    bounds = scoring.reference_bounds(spark.createDataFrame([("circuity", 1.0, 2.0)], "metric string, minimum_reference_value double, maximum_reference_value double"))
    assert features.reference_value(bounds, "circuity") == (1.0, 2.0)
    with pytest.raises(ValueError, match="circuity"):
        features.reference_value(bounds, "x")
    points = spark.createDataFrame([("A", 1, 1.0, 1.0, {"building": "yes"}), ("A", 2, 50.0, 1.0, {"building": "yes"}), ("A", 3, 1.0, 1.0, {"x": "y"})], "city string, id bigint, x double, y double, tags map<string,string>")
    region = spark.createDataFrame([(1, "A", "POLYGON ((0 0, 9 0, 9 9, 0 9, 0 0))")], "region_id bigint, city string, geometry string")
    assert [r.id for r in features.tagged_within(points, region, "building").collect()] == [1]
    with pytest.raises(ValueError, match="fewer than 1"):
        features.tagged_within(points, region, "landuse")


def test_saved_relations(spark):
    text = '{"id": 3, "type": "relation", "tags": {"admin_level": "8"}, "members": [{"type": "way", "ref": 1, "role": "outer", "geometry": [{"lat": 0, "lon": 0}, {"lat": 0, "lon": 4}, {"lat": 4, "lon": 4}]}, {"type": "node", "ref": 9, "role": "label"}, {"type": "way", "ref": 2, "role": "", "geometry": [{"lat": 4, "lon": 4}, {"lat": 0, "lon": 0}]}]}'
    members = features.relation_members(spark.createDataFrame([(text,)], "value string"))
    got = shapes.relation_polygons(members.drop("tags")).first()
    assert got.relation_id == 3 and got.area_deg2 == 8 and got.problem is None
    assert np.isclose(features.circle_wkt(0, 0, 1).count(","), 64)


def test_pbf_written_and_cut_by_a_polygon(spark, tmp_path):
    rows = [("node", k, 10.0 + k / 100, 70.0 + k / 50, {"highway": "stop"} if k == 3 else None, None) for k in range(20)] + [("way", 100 + k, None, None, {"building": "yes", "name": f"ä{k}"}, [k, k + 1, k + 2]) for k in range(0, 18, 4)]
    df = spark.createDataFrame(rows, "kind string, id bigint, lat double, lon double, tags map<string,string>, refs array<bigint>").repartition(3)
    paths = pbf.write_pbf(df, str(tmp_path / "out"), block=4)
    back = pbf.read_pbf(spark, *paths)
    got = {(r.kind, r.id): r for r in back.collect()}
    assert len(got) == len(rows) and got["way", 104].refs == [4, 5, 6] and got["way", 104].tags == {"building": "yes", "name": "ä4"} and got["node", 3].tags == {"highway": "stop"}
    assert all(abs(got["node", k].lat - (10 + k / 100)) < 1e-7 and abs(got["node", k].lon - (70 + k / 50)) < 1e-7 for k in range(20))
    region = spark.createDataFrame([(1, "POLYGON ((69.99 9.99, 70.05 9.99, 70.05 10.03, 69.99 10.03, 69.99 9.99))")], "region_id bigint, geometry string")
    cut = {(r.kind, r.id) for r in pbf.within_regions(back, region).collect()}
    assert cut == {("node", 0), ("node", 1), ("node", 2), ("way", 100)}


def test_query_servers_fail_over(spark):
    from roadloom.sources import overpass

    asked, slept = [], []
    answer = '{"elements": [{"type": "relation", "id": 7, "tags": {"boundary": "administrative"}, "members": [{"type": "way", "ref": 1, "role": "outer", "geometry": [{"lat": 0, "lon": 0}, {"lat": 0, "lon": 1}, {"lat": 1, "lon": 1}, {"lat": 0, "lon": 0}]}]}]}'

    def transport(endpoint, query):
        asked.append((endpoint, query))
        if endpoint == "bad" or len(asked) == 3:
            raise OSError("no route")
        return answer

    got = overpass.relations(spark, [7], ["bad", "good"], transport, tries=2, pause=5.0, sleep=slept.append)
    assert [e for e, _ in asked] == ["bad", "bad", "good", "good"] and slept == [5.0, 10.0, 5.0] and "relation(7)" in asked[0][1]
    assert shapes.relation_polygons(got).first().area_deg2 == 0.5
    with pytest.raises(ConnectionError, match="bad, try 2"):
        overpass.fetched("q", ["bad"], transport)
    assert overpass.area_query([(1.0, 2.0), (3.0, 4.0)], {"building": None, "landuse": "farm"}) == '[out:json][timeout:300];(nwr["building"](poly:"2.0 1.0 4.0 3.0");nwr["landuse"="farm"](poly:"2.0 1.0 4.0 3.0"););out geom;'


def test_building_load(spark):
    from roadloom.operators import features as f

    square = lambda lon, lat, s=0.001: f"POLYGON (({lon} {lat}, {lon + s} {lat}, {lon + s} {lat + s}, {lon} {lat + s}, {lon} {lat}))"
    raw = spark.createDataFrame([("A", 1, square(75.0, 20.0)), ("A", 2, None), ("A", 3, "POINT (75 20)"), ("A", 4, "POLYGON ((75 20, 75 20, 75 20))"), (None, 5, square(75.0, 20.0)), ("Z", 6, square(75.0, 20.0))], "city string, polygon_id bigint, geometry string")
    centers = spark.createDataFrame([("A", 500000.0, 2211500.0)], "city string, x double, y double")
    zones = spark.createDataFrame([("A", 32643)], "city string, srid int")
    rows = f.load_buildings(raw, centers, zones).collect()
    assert [(r.city, r.polygon_id) for r in rows] == [("A", 1)] and abs(rows[0].area_m2 - 111.32 * 0.9997 * 111.32 * math.cos(math.radians(20.0005))) < 120
    with pytest.raises(ValueError, match="far"):
        f.load_buildings(raw, centers.withColumn("y", F.lit(0.0)), zones)
