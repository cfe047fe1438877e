import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from roadloom.operators import grid, scoring
from roadloom.streaming import cells as streaming


def values(spark, rows):
    return spark.createDataFrame(rows, "city string, metric string, value double")


def test_min_max_directions_and_degenerate_ranges(spark):
    rows = [(c, m, v) for m in ("node_density", "circuity", "hierarchy_clarity") for c, v in (("A", 1.0), ("B", 2.0), ("C", 4.0))]
    s = {(r.city, r.metric): r.score for r in scoring.normalised(values(spark, rows)).collect()}
    assert s["A", "node_density"] == 0 and s["C", "node_density"] == 100 and math.isclose(s["B", "circuity"], 200 / 3) and s["A", "circuity"] == 100
    x = lambda lo, hi, t: spark.range(1).select(scoring.degenerate(F.lit(lo), F.lit(hi), t)).first()[0]
    assert x(1.0, 1.0 + 9e-6, "low") and not x(1.0, 1.0 + 9e-6, "relative") and x(1.0, 1 + 1e-10, "relative") and not x(1.0, 1.001, "high")
    flat = scoring.normalised(values(spark, [("A", "node_density", 3.0), ("B", "node_density", 3.0)])).collect()
    assert {r.score for r in flat} == {50.0}


def test_missing_values(spark):
    nan = float("nan")
    rows = [("A", "node_density", nan), ("B", "node_density", 1.0), ("C", "node_density", 2.0), ("A", "hierarchy_clarity", nan), ("B", "hierarchy_clarity", 1.0), ("C", "hierarchy_clarity", 2.0)]
    s = {(r.city, r.metric): r.score for r in scoring.normalised(values(spark, rows)).collect()}
    assert all(s[c, "node_density"] is None for c in "ABC")  # one NaN spoils this pillar's range
    assert s["A", "hierarchy_clarity"] is None and s["B", "hierarchy_clarity"] == 0 and s["C", "hierarchy_clarity"] == 100
    p = {r.city: r for r in scoring.pillar_scores(scoring.normalised(values(spark, [*rows, ("B", "link_density", 1.0), ("C", "link_density", 3.0)]))).collect()}
    assert p["B"].connectivity_score == 0 and p["C"].connectivity_score == 100 and p["C"].efficiency_score is None


def index(spark, scores):
    return scoring.composite(spark.createDataFrame([(c, float(a), float(b), float(h)) for c, a, b, h in scores], "city string, connectivity_score double, efficiency_score double, hierarchy_score double"))


def test_composite_tiers_and_wording(spark):
    i = index(spark, [("A", 90, 90, 90), ("B", 50, 50, 50), ("C", 50, 50, 50), ("D", 50, 50, 50), ("E", 10, 10, 10)])
    assert {r.city: r.tier for r in scoring.tiers(i).collect()} == {"A": "Tier 1", "B": "Tier 2", "C": "Tier 2", "D": "Tier 2", "E": "Tier 3"}
    ref = scoring.reference_range(i).first()
    assert ref.index_mean == 50 and math.isclose(ref.index_sd, math.sqrt(640)) and math.isclose(ref.index_sample_sd, math.sqrt(800)) and ref.n_cities == 5
    two = index(spark, [("A", 60, 60, 60), ("B", 40, 40, 40)])
    assert {r.tier for r in scoring.tiers(two).collect()} == {"Tier 2"}  # the bounds belong to the range
    text = {r.city: r for r in scoring.interpretation(i, scoring.reference_range(i)).collect()}
    assert text["A"].position == "above the reference range" and text["A"].mean_side == "above" and text["B"].mean_side == "equal to" and text["B"].connectivity_side == "close to the reference mean"
    assert text["E"].summary.startswith("The index of E is 10.00, below the reference range (24.70 to 75.30) and below the mean of 50.00; connectivity is 10.00, below the reference mean (50.00)")
    flags = scoring.validation(index(spark, [("A", 90, 101, 90)]), ["B"]).first()
    assert flags.all_pillars_present and not flags.all_pillars_0_100 and flags.index_0_100 and not flags.city_expected


def test_joining_and_checking(spark):
    a = spark.createDataFrame([("A", 1.0), ("B", 2.0)], "city string, connectivity_score double")
    b = spark.createDataFrame([("B", 3.0), ("C", 4.0)], "city string, efficiency_score double")
    assert {(r.city, r.connectivity_score, r.efficiency_score) for r in scoring.merged(a, b).collect()} == {("A", 1.0, None), ("B", 2.0, 3.0), ("C", None, 4.0)}
    with pytest.raises(ValueError, match="twice"):
        scoring.merged(a.union(a), b)
    with pytest.raises(ValueError, match="1 outside"):
        scoring.check_scores(spark.createDataFrame([("A", 101.0)], "city string, s double"), "s")
    saved = spark.createDataFrame([(" A ", " 12.5"), ("B", "x")], "`﻿City` string, `Efficiency Score Corrected` string")
    assert [tuple(r) for r in scoring.score_column(saved, "efficiency").collect()] == [("A", 12.5), ("B", None)]
    with pytest.raises(ValueError, match="none of"):
        scoring.resolve(["x"], ["city"])


def test_saved_references(spark):
    rows = scoring.normalised(values(spark, [("A", "circuity", 1.0), ("B", "circuity", 3.0)]))
    by_metric = scoring.normalization_reference(rows)
    by_city = spark.createDataFrame([("A", 1.0), ("B", 3.0)], "city string, circuity double")
    for reference in (by_metric, by_city):
        got = scoring.evaluated(values(spark, [("X", "circuity", 5.0)]), scoring.reference_bounds(reference)).first()
        assert got.score == -100  # beyond the range, not clipped
    with pytest.raises(ValueError, match="neither"):
        scoring.reference_bounds(spark.createDataFrame([(1,)], "a int"))


def cells(spark, where, coverage=None):
    rows = [("A", r * 100 + c, r, c, 250000.0, 100.0, float((coverage or {}).get((r, c), 0.5)), True, (c + 0.5) * 500, (r + 0.5) * 500) for r, c in where]
    return spark.createDataFrame(rows, "city string, grid_id bigint, row int, col int, cell_area_m2 double, building_area_m2 double, building_coverage double, built_up boolean, center_x double, center_y double")


SHAPE = [(0, 0), (1, 0), (1, 1), (2, 2), (2, 5), (6, 0), (2, 9)]


def test_cell_components(spark):
    eight = {(r.row, r.col): r.component_id for r in grid.cell_components(cells(spark, SHAPE)).collect()}
    assert eight == {(0, 0): 0, (1, 0): 0, (1, 1): 0, (2, 2): 0, (2, 5): 205, (6, 0): 600, (2, 9): 209}
    four = {(r.row, r.col): r.component_id for r in grid.cell_components(cells(spark, SHAPE), eight=False).collect()}
    assert four[2, 2] == 202 and four[1, 1] == 0


def test_extent_selection(spark):
    built = grid.cell_components(cells(spark, SHAPE))
    centers = spark.createDataFrame([("A", 0.0, 0.0)], "city string, x double, y double")
    e = grid.city_extent(built, centers).first()
    # (2, 5) is 2 cells from (2, 2): exactly 1 km and in; (6, 0) is 4 cells away; (2, 9) is near (2, 5) only
    assert e.component_id == 0 and e.selected_component_ids == "0,205" and e.extent_cells == 5 and e.extent_area_km2 == 1.25
    gaps = {(r.component_a, r.component_b): r.gap_km for r in grid.component_gaps(built, 2.0).collect()}
    assert gaps == {(0, 205): 1.0, (205, 209): 1.5, (0, 600): math.hypot(3, 1) / 2}
    assert grid.primary_component(grid.component_table(built), centers.withColumn("x", F.lit(5000.0)).withColumn("y", F.lit(1250.0))).first().component_id == 209
    border = grid.outline(cells(spark, [(0, 0), (0, 1)])).collect()
    assert len(border) == 6


def test_core_and_support(spark):
    cov = {(0, k): 0.01 * (k + 1) for k in range(8)}
    table = cells(spark, list(cov), cov)
    core = grid.urban_core(table).collect()
    assert len(core) == 2 and math.isclose(core[0].core_threshold, np.quantile(list(cov.values()), 0.75))
    flags = grid.core_support(table).collect()
    assert sum(r.core for r in flags) == 2 and sum(r.support for r in flags) == 4


def test_grid_and_coverage(spark):
    points = spark.createDataFrame([("A", -1.0, 10.0), ("A", 1001.0, 499.0), ("A", None, 1.0)], "city string, x double, y double")
    limits = grid.bounds(points)
    assert tuple(limits.first()) == ("A", -500.0, 0.0, 1, 4)
    full = grid.full_grid(limits).collect()
    assert [r.grid_id for r in sorted(full, key=lambda r: r.grid_id)] == [0, 1, 2, 3]
    with pytest.raises(ValueError, match="more than 3"):
        grid.full_grid(limits, most_cells=3)
    boxes = spark.createDataFrame([("A", 1, -100.0, 100.0, 100.0, 200.0), ("A", 2, 0.0, 100.0, 100.0, 200.0), ("A", 3, 5.0, 5.0, 5.0, 9.0)], "city string, polygon_id bigint, lx double, ly double, hx double, hy double")
    c = {r.col: r for r in grid.coverage(grid.rectangle_overlay(boxes), limits).collect()}
    assert c[0].building_area_m2 == 10000 and c[1].building_area_m2 == 20000 and c[2].building_area_m2 == 0 and c[1].built_up and not c[2].built_up
    ring = lambda x0, y0, x1, y1: [[x0, y0], [x1, y0], [x1, y1], [x0, y1], [x0, y0]]
    texts = [("A", 1, json.dumps({"type": "Polygon", "coordinates": [ring(-100, 100, 100, 200)]})), ("A", 2, json.dumps({"type": "Polygon", "coordinates": [ring(0, 100, 100, 200)]})), ("A", 4, None), ("A", 5, "POINT (1 1)")]
    polygons = spark.createDataFrame(texts, "city string, polygon_id bigint, geometry string")
    same = lambda df: sorted((r.polygon_id, r.cx, r.cy, round(r.area_m2, 6)) for r in df.collect())
    assert same(grid.overlay(polygons)) == same(grid.rectangle_overlay(boxes))


def test_overlay_of_a_holed_polygon_keeps_its_area(spark):
    text = "POLYGON ((13 7, 2900 350, 1800 2600, 120 1900, 13 7), (600 600, 700 1500, 1500 1300, 1300 700, 600 600))"
    pieces = grid.overlay(spark.createDataFrame([("A", 1, text)], "city string, polygon_id bigint, geometry string"))
    from roadloom.functions.polygons import parse_polygons, polygon_area

    assert math.isclose(pieces.agg(F.sum("area_m2")).first()[0], polygon_area(parse_polygons(text)[0]), rel_tol=1e-12)


def test_streamed_coverage(spark, tmp_path):
    boxes = spark.createDataFrame([("A", k, 10.0 * k, 0.0, 10.0 * k + 20, 30.0) for k in range(200)], streaming.BOX)
    boxes.repartition(3).write.parquet(str(tmp_path / "in"))
    got = streaming.ingest(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state"), files_per_batch=1)
    want = grid.rectangle_overlay(boxes).groupBy("city", "cx", "cy").agg(F.sum("area_m2").alias("building_area_m2"))
    key = lambda df: sorted((r.city, r.cx, r.cy, round(r.building_area_m2, 6)) for r in df.collect())
    assert key(got) == key(want)
    again = streaming.ingest(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state"))
    assert key(again) == key(want)  # files seen before aren't counted twice
