import os
import shutil

import pytest
from pyspark.sql import functions as F

from roadloom import cli
from roadloom.functions.frames import keep_columns
from roadloom.operators import network
from roadloom.sources import files

OSM = """<?xml version="1.0"?><osm>
<node id="1" lat="0.0" lon="0.0"/><node id="2" lat="0.0" lon="0.001"><tag k="highway" v="stop"/></node><node id="3" lat="0.0" lon="0.002"/><node id="4" lat="1" lon="1"/>
<way id="10"><nd ref="1"/><nd ref="2"/><nd ref="3"/><tag k="highway" v="primary"/><tag k="oneway" v="yes"/></way>
<way id="11"><nd ref="3"/><nd ref="1"/><tag k="highway" v="service"/></way>
<way id="12"><nd ref="1"/><nd ref="4"/><tag k="building" v="yes"/></way>
<way id="13"><nd ref="4"/><nd ref="3"/><tag k="highway" v="path"/><tag k="oneway" v="-1"/></way>
<relation id="20"><member type="way" ref="10" role="outer"/><tag k="boundary" v="administrative"/></relation></osm>"""


def test_osm(spark, tmp_path):
    (tmp_path / "x.osm").write_text(OSM)
    nodes, ways, relations = files.read_osm(spark, str(tmp_path / "x.osm"))
    assert nodes.count() == 4 and ways.count() == 4 and relations.first().member[0]._role == "outer"
    assert files.tagged(ways, "building").count() == 1 and files.tagged(ways, "highway", ["path"]).count() == 1
    edges = files.road_edges(ways, nodes, "A")
    got = {(r.u, r.v): (r.highway, r.length) for r in edges.collect()}
    assert set(got) == {(1, 2), (2, 3), (3, 1), (1, 3), (3, 4)} and abs(got[1, 2][1] - 111.19) < 0.01


def test_geojson(spark, tmp_path):
    (tmp_path / "e.geojson").write_text('{"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {"city": "A", "n": 3}, "geometry": {"type": "Polygon", "coordinates": [[[0, 0], [2, 0], [2, 2], [0, 2], [0, 0]]]}}, {"type": "Feature", "properties": {}, "geometry": null}]}')
    rows = files.read_geojson(spark, str(tmp_path / "e.geojson")).collect()
    from roadloom.functions.polygons import parse_polygons, polygon_area

    assert rows[0].properties == {"city": "A", "n": "3"} and polygon_area(parse_polygons(rows[0].geometry)[0]) == 4 and rows[1].geometry is None
    n = spark.createDataFrame([("A", 1, 0.0, 0.0), ("A", 2, 3.0, 4.0), ("A", 3, None, 0.0)], "city string, node_id bigint, x double, y double")
    files.write_collection(files.point_features(n), str(tmp_path / "points"))
    back = files.read_geojson(spark, str(tmp_path / "points")).collect()
    assert len(back) == 2 and back[1].properties["node_id"] in ("1", "2")
    e = spark.createDataFrame([("A", 1, 2), ("A", 1, 1), ("A", 1, 3)], "city string, u bigint, v bigint")
    files.write_features(files.line_features(network.with_ends(e, n)), str(tmp_path / "lines"))
    assert [r.value for r in spark.read.text(str(tmp_path / "lines")).collect()] == ['{"type":"Feature","properties":{"city":"A","u":1,"v":2},"geometry":{"type":"LineString","coordinates":[[0.0,0.0],[3.0,4.0]]}}']


def test_graphml_round_trip(spark, tmp_path):
    n = spark.createDataFrame([("A", 1, 0.5, 0.0), ("A", 2, None, 4.0)], "city string, node_id bigint, x double, y double")
    e = spark.createDataFrame([("A", 1, 2, 0, 7.25, "a & <b>"), ("A", 2, 1, 1, None, None)], "city string, u bigint, v bigint, edge_key int, length double, highway string")
    files.write_graphml(n, e, str(tmp_path / "g"))
    n2, e2 = files.graph_tables(*files.read_graphml(spark, str(tmp_path / "g")), "A")
    key = lambda df: sorted(map(repr, (tuple(r) for r in df.collect())))
    assert key(n2) == key(n) and key(e2) == key(e)


def test_csv_and_reuse(spark, tmp_path):
    (tmp_path / "s.csv").write_text("﻿city , score\nA, 1.5\nB,x\n")
    assert [tuple(r) for r in files.read_csv(spark, str(tmp_path / "s.csv"), "city string, score double").collect()] == [("A", 1.5), ("B", None)]
    calls = []

    def make():
        calls.append(1)
        return spark.range(3)

    path = str(tmp_path / "kept")
    assert files.reused(spark, path, make).count() == files.reused(spark, path, make).count() == 3 and len(calls) == 1
    files.reused(spark, path, make, force=True)
    assert len(calls) == 2


def test_preflight(spark):
    have = spark.createDataFrame([("A",), ("B",)], "city string")
    assert files.preflight(have, have.filter("city = 'A'"), have.limit(0), ["A", "B"]) == ["B: no edges", "A: no extent", "B: no extent"]


def test_clashing_columns(spark):
    df = spark.createDataFrame([(1, 2, 3)], "pos int, Pos_in int, v int")
    assert df.select(*keep_columns(df, df.columns, ["pos", "VALUE"])).columns == ["pos_in", "Pos_in_in", "v"]


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="the test tables aren't here")
def test_programme(spark, tmp_path):
    tables, out = "/root/testdata/sf0.001", str(tmp_path / "out")
    assert cli.main(["run", tables, out]) == 0
    index = files.read_csv(spark, f"{out}/reports/index")
    assert index.count() == 5
    scores = spark.read.json(f"{out}/reports/scores")
    assert scores.filter("score < -1e-9 or score > 100.000001").count() == 0 and scores.select("metric").distinct().count() == 11
    shutil.rmtree(f"{out}/all/6_composite")
    assert cli.main(["run", tables, out, "--from-step", "6"]) == 0
    assert cli.main(["evaluate", tables, out, "--city", "Pune"]) == 0
    text = spark.read.text(f"{out}/reports/evaluation_pune_text").first().value
    assert text.startswith("The index of Pune is ")
    assert cli.main(["validate-seeds", tables, out, "--seeds", "2", "--city", "Pune"]) == 0
    assert files.read_csv(spark, f"{out}/reports/seed_runs").filter(F.col("city") == "Pune").count() == 2
    assert cli.main(["run", tables, out, "--city", "Nowhere"]) == 1
