"""Queries that write and read each format, load buildings, audit boundaries, and compare networks with extents."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadloom import pillars
from roadloom.functions import defaults, geo, texts
from roadloom.functions.frames import located, removed, shared_folder, small, stored, table
from roadloom.functions.stats import t_quantile
from roadloom.operators import features, grid, metrics, network, paths, sampling, scoring, shapes
from roadloom.plans import network as plans
from roadloom.sources import files, pbf


def _passed(spark: SparkSession, write: Callable[[str], None], read: Callable[[str], DataFrame]) -> DataFrame:
    """What read() makes of the folder that write() fills; the folder is removed."""
    place = f"{shared_folder(spark)}/files-{uuid.uuid4().hex}"
    write(place)
    out = stored(read(place))
    removed(spark, place)
    return out


def _r(c: str, places: int = 6):
    return F.round(F.col(c), places).alias(c)


def _degrees():
    """Made-up positions in degrees by node id; the tables have none."""
    k = F.col("node_id")
    return F.lit(70.0) + F.pmod(k, F.lit(2000)) / 100, F.lit(10.0) + F.pmod(k, F.lit(1777)) / 100


# --- formats -----------------------------------------------------------------------------------------------------------


def geojson_points(spark, d):
    read = _passed(spark, lambda p: files.write_features(files.point_features(plans.nodes(spark, d)), p), lambda p: files.read_features(spark, p))
    at = F.from_json(F.get_json_object("geometry", "$.coordinates"), "array<double>")
    return read.select(F.col("properties")["city"].alias("city"), F.col("properties")["node_id"].cast("bigint").alias("node_id"), F.round(at[0], 3).alias("x"), F.round(at[1], 3).alias("y"))


def geojson_lines(spark, d):
    lines = network.with_ends(plans.edges(spark, d), plans.nodes(spark, d))
    read = _passed(spark, lambda p: files.write_features(files.line_features(lines), p), lambda p: files.read_features(spark, p))
    at = F.from_json(F.get_json_object("geometry", "$.coordinates"), "array<array<double>>")
    a = read.select(F.col("properties")["city"].alias("city"), at.alias("p"))
    return a.groupBy("city").agg(F.count("*").alias("n_lines"), F.round(F.sum(F.hypot(F.col("p")[1][0] - F.col("p")[0][0], F.col("p")[1][1] - F.col("p")[0][1])), 2).alias("straight_m"))


def _extent(spark, d) -> tuple[DataFrame, DataFrame]:
    """(all cells with their coverage, cells of the extents)."""
    covered = stored(plans._covered(spark, d))
    built = stored(grid.cell_components(covered.filter("built_up")))
    return covered, stored(grid.extent_cells(built, grid.selected_components(built, plans._centers(spark, d))))


def extent_polygon(spark, d):
    """The extents' outlines, written and read as a feature collection."""
    outlines = grid.dissolved(_extent(spark, d)[1], plans._limits(spark, d))
    read = _passed(spark, lambda p: files.write_collection(files.region_features(outlines), p), lambda p: files.read_geojson(spark, p))
    keyed = read.select(F.col("properties")["city"].alias("city"), F.xxhash64(F.col("properties")["city"]).alias("region_id"), "geometry")
    m = shapes.measures(keyed).withColumnRenamed("id", "region_id")
    return m.join(keyed.select("region_id", "city"), "region_id").select("city", "parts", "holes", _r("area_m2", 1), _r("min_x", 2), _r("max_y", 2))


def graphml_edges(spark, d):
    n, e = plans.nodes(spark, d), plans.edges(spark, d)
    plain = e.withColumn("highway", F.when(F.col("highway").rlike("^[a-z_]+$"), F.col("highway")))
    read = lambda p: files.graph_tables(*files.read_graphml(spark, p), "all")[1]
    return _passed(spark, lambda p: files.write_graphml(n, plain, p), read).select("u", "v", "edge_key", _r("length", 3), "highway")


def osm_roads(spark, d):
    """Road edges of OSM XML made of the nodes and edges, a third of the ways one-way and a third one-way against their direction."""
    lon, lat = _degrees()
    number = lambda c: c.cast("string")
    n = plans.nodes(spark, d).select("node_id").distinct().select(F.concat(F.lit('<node id="'), number(F.col("node_id")), F.lit('" lat="'), number(lat), F.lit('" lon="'), number(lon), F.lit('"/>')).alias("value"))
    way = F.when(F.pmod("edge_id", F.lit(3)) == 0, '<tag k="oneway" v="yes"/>').when(F.pmod("edge_id", F.lit(3)) == 1, '<tag k="oneway" v="-1"/>').otherwise("")
    e = plans.edges(spark, d).filter(F.col("highway").rlike("^[a-z_]+$")).select(F.concat(F.lit('<way id="'), number(F.col("edge_id")), F.lit('"><nd ref="'), number(F.col("u")), F.lit('"/><nd ref="'), number(F.col("v")), F.lit('"/><tag k="highway" v="'), F.col("highway"), F.lit('"/>'), way, F.lit("</way>")).alias("value"))

    def read(place: str) -> DataFrame:
        nodes, ways, _ = files.read_osm(spark, place)
        return files.road_edges(ways, nodes, "all")

    return _passed(spark, lambda p: files.write_osm(n.unionByName(e), p), read).select("way_id", "u", "v", _r("length", 3), "highway")


def pbf_extract(spark, d):
    """PBF files of nodes and tagged ways, cut by a polygon: what is left of each kind, and the ways tagged primary among it."""
    place = f"{shared_folder(spark)}/pbf-{uuid.uuid4().hex}"
    if not place.startswith(("file:", "/")):
        raise ValueError("PBF files need a shared folder that is mounted")
    path = "/" + place.removeprefix("file:").lstrip("/")
    lon, lat = _degrees()
    none = F.lit(None)
    n = plans.nodes(spark, d).select("node_id").distinct().select(F.lit("node").alias("kind"), F.col("node_id").alias("id"), lat.alias("lat"), lon.alias("lon"), none.cast("map<string,string>").alias("tags"), none.cast("array<bigint>").alias("refs"))
    e = plans.edges(spark, d).filter(F.col("highway").rlike("^[a-z_]+$")).select(F.lit("way").alias("kind"), F.col("edge_id").alias("id"), none.cast("double").alias("lat"), none.cast("double").alias("lon"), F.create_map(F.lit("highway"), F.col("highway")).alias("tags"), F.array("u", "v").alias("refs"))
    paths_ = pbf.write_pbf(n.unionByName(e), path)
    region = spark.createDataFrame([(1, "POLYGON ((72.003 12.001, 82.007 13.002, 77.001 24.003, 72.003 12.001))")], "region_id bigint, geometry string")
    held = stored(pbf.within_regions(stored(pbf.read_pbf(spark, *paths_)), region))
    removed(spark, place)
    return held.groupBy("kind").agg(F.count("*").alias("n"), F.count_if(F.col("tags")["highway"] == "primary").alias("n_primary"))


def csv_nodes(spark, d):
    kind = "city string, node_id bigint, x double, y double"
    return _passed(spark, lambda p: files.write_csv(plans.nodes(spark, d), p, single=False), lambda p: files.read_csv(spark, p, kind)).select("city", "node_id", _r("x", 3), _r("y", 3))


def json_report(spark, d):
    return _passed(spark, lambda p: files.write_json(plans.road_class_shares(spark, d), p), lambda p: spark.read.schema("city string, road_class string, length double, n_edges bigint").json(p))


def text_report(spark, d):
    return _passed(spark, lambda p: files.write_text(plans.interpretation(spark, d), p, "summary"), lambda p: spark.read.text(p)).select(F.col("value").alias("summary"))


def reused_degrees(spark, d):
    """A kept table: made once, read the second time, made anew when forced."""
    made = []

    def make() -> DataFrame:
        made.append(1)
        return plans.degree(spark, d)

    def read(place: str) -> DataFrame:
        files.reused(spark, place, make)
        return files.reused(spark, place, make, force=True).withColumn("times_made", F.lit(len(made)))

    return _passed(spark, lambda p: files.reused(spark, p, make).limit(0).collect(), read)


def preflight_problems(spark, d):
    """All that a run over the known cities and one unknown would lack."""
    n = table(spark, d, "nodes", "city", "x", "y")
    found = files.preflight(n, table(spark, d, "edges", "city", "length"), table(spark, d, "city_extents", "city"), [*files.known_cities(n), "Nowhere"])
    return spark.createDataFrame([(f,) for f in found], "problem string")


def graph_problems(spark, d):
    return network.problems(plans.nodes(spark, d), plans.edges(spark, d))


def city_sets(spark, d):
    """What a table without one city lacks of the whole one."""
    n = plans.nodes(spark, d).select("city")
    return spark.createDataFrame([(f,) for f in scoring.same_cities(n, n.filter("city <> 'Pune'"))], "problem string")


# --- geometry ----------------------------------------------------------------------------------------------------------


def polygon_repair(spark, d):
    """Measures of the regions as repaired texts."""
    m = shapes.measures(shapes.cleaned(table(spark, d, "city_extents", "region_id", "geometry")))
    return m.select(F.col("id").alias("region_id"), "parts", "holes", _r("area_m2", 1))


def _relations(spark, d) -> DataFrame:
    """The rings of the regions as ways of four points, every other one turned round, in an order by hash."""
    c = shapes.corners(table(spark, d, "city_extents", "region_id", "city", "geometry"))
    last = c.groupBy("id", "part", "ring").agg(F.max("pos").alias("last"))
    closed = c.join(last, ["id", "part", "ring"]).withColumn("pos", F.explode(F.when(F.col("pos") == 0, F.array(F.col("pos"), F.col("last") + 1)).otherwise(F.array("pos"))))
    own, before = F.floor(F.col("pos") / 3), F.floor(F.col("pos") / 3) - 1
    step = F.when((F.col("pos") % 3 == 0) & (F.col("pos") > 0), F.when(F.col("pos") > F.col("last"), F.array(before)).otherwise(F.array(before, own))).otherwise(F.array(own))
    ways = closed.withColumn("way", F.explode(step))
    turned = F.when(F.pmod("way", F.lit(2)) == 1, -F.col("pos")).otherwise(F.col("pos"))
    return ways.select(F.col("id").alias("relation_id"), F.when(F.col("ring") == 0, "outer").otherwise("inner").alias("role"), F.xxhash64("part", "ring", "way").alias("way_no"), turned.alias("pos"), F.col("x").alias("lon"), F.col("y").alias("lat"))


def relation_rings(spark, d):
    return shapes.relation_polygons(_relations(spark, d)).select("relation_id", F.round("area_deg2", 1).alias("area"), "problem")


def boundary_audit(spark, d):
    """Every boundary relation with its kind by tags, area and box."""
    made = shapes.relation_polygons(_relations(spark, d))
    k = F.col("relation_id")
    tags = F.create_map(F.lit("boundary"), F.lit("administrative"), F.lit("admin_level"), (F.pmod(k, F.lit(7)) + 3).cast("string"), F.lit("place"), F.when(F.pmod(k, F.lit(2)) == 0, "city").otherwise(""))
    kind, _ = shapes.administrative_kind(tags)
    return made.select("relation_id", kind.alias("kind"), F.round(F.col("area_deg2") / 1e6, 4).alias("area_km2"), "bbox", "problem")


def line_clip(spark, d):
    """Roads cut to the middle half of their city's extent of nodes each way."""
    n = plans.nodes(spark, d)
    roads = network.with_ends(plans.multigraph(spark, d), n, "lo", "hi").filter("ax is not null and ay is not null and bx is not null and by is not null").select("city", "ax", "ay", "bx", "by")
    size = n.filter(located()).groupBy("city").agg(*[f(c).alias(f"{m}{c}") for c in "xy" for m, f in (("l", F.min), ("h", F.max))])
    part = lambda a, b, t: (F.col(a) + (F.col(b) - F.col(a)) * t)
    boxes = size.select("city", part("lx", "hx", 0.25).alias("lx"), part("ly", "hy", 0.25).alias("ly"), part("lx", "hx", 0.75).alias("hx"), part("ly", "hy", 0.75).alias("hy"))
    cut = features.clipped_lines(roads, small(boxes))
    return cut.groupBy("city").agg(F.count("*").alias("n_lines"), F.round(F.sum(F.hypot(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay"))), 2).alias("length_m"))


def coordinate_kind(spark, d):
    """Whether coordinates look like degrees: those of the nodes, and made-up degrees."""
    lon, lat = _degrees()
    n = plans.nodes(spark, d).filter(located()).select("city", "x", "y", lon.alias("lon"), lat.alias("lat"))
    look = lambda x, y: geo.looks_geographic(F.min(x), F.max(x), F.min(y), F.max(y))
    return n.groupBy("city").agg(look("x", "y").alias("nodes_in_degrees"), look("lon", "lat").alias("made_in_degrees"))


def _wkt(spark, d) -> DataFrame:
    """The footprints as WKT."""
    at = lambda x, y: F.concat(F.col(x).cast("string"), F.lit(" "), F.col(y).cast("string"))
    ring = F.concat_ws(", ", at("lx", "ly"), at("hx", "ly"), at("hx", "hy"), at("lx", "hy"), at("lx", "ly"))
    return plans.footprints(spark, d).select("city", "polygon_id", F.concat(F.lit("POLYGON (("), ring, F.lit("))")).alias("geometry"))


def building_load(spark, d):
    """Footprints given in degrees, cleaned, projected back and measured."""
    f = plans.footprints(spark, d).withColumn("srid", plans._srid())
    sides = F.explode(F.array(*[F.struct(F.lit(k).alias("pos"), F.col(x).alias("x"), F.col(y).alias("y")) for k, (x, y) in enumerate((("lx", "ly"), ("hx", "ly"), ("hx", "hy"), ("lx", "hy")))]))
    c = f.select("city", "polygon_id", "srid", sides.alias("c"))
    lon, lat = geo.from_utm(F.col("c.x"), F.col("c.y"), F.col("srid"))
    raw = shapes.from_corners(c.select(F.col("polygon_id").alias("id"), "city", F.lit(0).alias("part"), F.lit(0).alias("ring"), "c.pos", lon.alias("x"), lat.alias("y"))).withColumnRenamed("id", "polygon_id")
    zones = spark.createDataFrame(list(plans.SRID.items()), "city string, srid int")
    dirt = spark.createDataFrame([("Pune", -1, None), ("Pune", -2, "POINT (1 2)"), ("Pune", -3, "POLYGON EMPTY")], "city string, polygon_id bigint, geometry string")
    made = features.load_buildings(raw.select("city", "polygon_id", "geometry").unionByName(dirt), plans._centers(spark, d), zones)
    return made.groupBy("city").agg(F.count("*").alias("n_buildings"), F.round(F.sum("area_m2") / 1e6, 6).alias("area_km2"))


def building_place(spark, d):
    """Distance of the buildings' area-weighted centre to their city's centre."""
    f = plans.footprints(spark, d)
    b = f.select("city", ((F.col("lx") + F.col("hx")) / 2).alias("x"), ((F.col("ly") + F.col("hy")) / 2).alias("y"), ((F.col("hx") - F.col("lx")) * (F.col("hy") - F.col("ly"))).alias("area_m2"))
    return features.check_place(b, plans._centers(spark, d)).select("city", _r("distance_km"))


def landuse_cells(spark, d):
    """How many built-up cells a land-use polygon touches: every third footprint stands for one."""
    f = _wkt(spark, d).filter(F.pmod("polygon_id", F.lit(3)) == 0)
    limits = plans._limits(spark, d).select("city", F.round(F.col("x0") / 500).cast("int").alias("ox"), F.round(F.col("y0") / 500).cast("int").alias("oy"))
    built = plans._covered(spark, d).filter("built_up").join(small(limits), "city").select("city", (F.col("col") + F.col("ox")).alias("cx"), (F.col("row") + F.col("oy")).alias("cy"))
    return features.cells_touched(f, built)


def built_within(spark, d):
    covered, extent = _extent(spark, d)
    return features.built_area_within(covered, extent).select("city", _r("built_up_km2"))


def extent_densities(spark, d):
    """Nodes and links of each city per km2 of its extent and of what is built there, and its hull against the extent."""
    covered, extent = _extent(spark, d)
    n, m = plans.nodes(spark, d), plans.multigraph(spark, d)
    size = extent.groupBy("city").agg((F.sum("cell_area_m2") / 1e6).alias("extent_km2"))
    hull = shapes.convex_hulls(n).select("city", (F.col("area_m2") / 1e6).alias("hull_km2"))
    made = metrics.extent_densities(n, m, size, features.built_area_within(covered, extent), hull)
    return made.select("city", *[_r(c) for c in made.columns if c != "city"])


def nearest_components(spark, d):
    """The thirty components of built-up cells nearest to each city's centre."""
    return grid.nearest(grid.component_table(stored(plans._built(spark, d))), plans._centers(spark, d), 30).select("city", "place", "component_id", "cell_count", _r("distance_to_center_km"))


# --- graph -------------------------------------------------------------------------------------------------------------


def graph_simplify_directed(spark, d):
    return network.simplified_directed(plans.edges(spark, d)).select("city", "u", "v", _r("length"), "n_segments")


def closeness_full(spark, d):
    """Mean closeness over the whole graph of each city instead of its largest component."""
    n, m = stored(plans.nodes(spark, d)), stored(plans.multigraph(spark, d))
    sizes = plans._sizes(n)
    c = metrics.closeness(paths.hop_sums(m, sampling.first_n(n, sizes)), sizes)
    return c.groupBy("city").agg(F.count("*").alias("n"), F.round(F.avg("closeness"), 9).alias("closeness"))


def closeness_simple(spark, d):
    """Closeness of up to 1,000 nodes of the simple graph."""
    n = stored(plans.nodes(spark, d))
    simple = stored(network.simple_graph(plans.multigraph(spark, d)))
    sizes = sampling.populations(n, lambda k: min(k, 1000))
    c = metrics.closeness(paths.hop_sums(simple, sampling.first_n(n, sizes)), sizes)
    return c.groupBy("city").agg(F.count("*").alias("n"), F.round(F.avg("closeness"), 9).alias("closeness"), F.round(F.coalesce(F.stddev_samp("closeness"), F.lit(0.0)), 9).alias("sd"))


def betweenness_sources(spark, d):
    return pillars.betweenness_sample(plans.nodes(spark, d))


def student_t(spark, d):
    return spark.createDataFrame([(k, round(t_quantile(1 - (1 - defaults.CONFIDENCE) / 2, k), 9)) for k in range(1, 201)], "freedom int, t double")


def seed_spread(spark, d):
    """How the estimates of closeness under several seeds spread."""
    runs = plans.multiseed(spark, d)
    return runs.groupBy("city").agg(F.count("*").alias("runs"), F.round(F.avg("estimate"), 8).alias("mean_estimate"), F.round(F.coalesce(F.stddev_samp("estimate"), F.lit(0.0)), 8).alias("sd_estimate"))


# --- scores ------------------------------------------------------------------------------------------------------------


def metric_reference(spark, d):
    """The saved range of one metric by its name."""
    lo, hi = features.reference_value(scoring.reference_bounds(scoring.normalization_reference(plans._index(spark, d)[1])), "node_density")
    return spark.createDataFrame([("node_density", round(lo, 6), round(hi, 6))], "metric string, lo double, hi double")


def reference_layouts(spark, d):
    """The same ranges from a reference by metric and from one by city."""
    v = plans._metric_table(spark, d)
    wide = v.groupBy("city").pivot("metric", [m for m in scoring.METRICS]).agg(F.first("value")).withColumnRenamed("city", "City")
    tall = scoring.normalization_reference(scoring.normalised(v))
    both = [scoring.reference_bounds(r).filter("lo is not null").select(F.lit(k).alias("layout"), "metric", _r("lo"), _r("hi")) for k, r in (("city", wide), ("metric", tall))]
    return both[0].unionByName(both[1])


def city_evaluation(spark, d):
    """Every city measured against the saved ranges of all."""
    v = plans._metric_table(spark, d)
    bounds = scoring.reference_bounds(scoring.normalization_reference(scoring.normalised(v)))
    return scoring.evaluated(v, bounds).select("city", "metric", _r("score"))


def reference_choice(spark, d):
    """The range a city is read against: a saved file if there is one, else made from the final scores."""
    index = stored(plans._index(spark, d)[0])
    saved = _passed(spark, lambda p: files.write_csv(scoring.reference_range(index), p), lambda p: files.read_csv(spark, p))
    rows = [scoring.interpretation_reference(s, i).select(F.lit(k).alias("origin"), "*") for k, s, i in (("file", saved, None), ("scores", None, index))]
    both = rows[0].unionByName(rows[1])
    return both.select("origin", *[_r(c) for c in both.columns if c != "origin"])


def pillar_import(spark, d):
    """Pillar scores from a CSV file whose headers are written freely, resolved, coerced and checked."""
    p = stored(plans.pillar_scores(spark, d))
    odd = p.select(F.col("city").alias("﻿ CITY "), F.concat(F.lit(" "), F.col("connectivity_score").cast("string")).alias("Connectivity Score"))
    read = _passed(spark, lambda w: files.write_csv(odd, w), lambda w: files.read_csv(spark, w))
    city, score = scoring.resolve(read.columns, ["city"]), scoring.resolve(read.columns, ["connectivity_score_corrected", "connectivity score"])
    out = read.select(F.trim(F.col(f"`{city}`")).alias("city"), F.trim(F.col(f"`{score}`")).try_cast("double").alias("connectivity_score"))
    scoring.check_scores(out, "connectivity_score")
    return out


def city_listing(spark, d):
    order = scoring.city_order(F.col("city"))
    return plans._index(spark, d)[0].select(order.alias("city_order"), "city", texts.slug(F.col("city")).alias("slug"), _r("index_score")).orderBy("city_order", "city")


def loading_delays(spark, d):
    """How long after its observation each edge was loaded, in words."""
    e = table(spark, d, "edges", "edge_id", "observed_at", "loaded_at").filter("observed_at is not null and loaded_at >= observed_at")
    seconds = F.floor((F.unix_micros("loaded_at") - F.unix_micros("observed_at")) / 1_000_000).cast("double")
    return e.select("edge_id", texts.duration(seconds).alias("delay"))


_QUERIES = (
    geojson_points, geojson_lines, extent_polygon, graphml_edges, osm_roads, pbf_extract, csv_nodes, json_report, text_report, reused_degrees, preflight_problems, graph_problems, city_sets,
    polygon_repair, relation_rings, boundary_audit, line_clip, coordinate_kind, building_load, building_place, landuse_cells, built_within, extent_densities, nearest_components,
    graph_simplify_directed, closeness_full, closeness_simple, betweenness_sources, student_t, seed_spread,
    metric_reference, reference_layouts, city_evaluation, reference_choice, pillar_import, city_listing, loading_delays,
)


def queries() -> dict:
    return {f.__name__: f for f in _QUERIES}


def oracle_sql() -> dict[str, str]:
    from roadloom.plans.storage_sql import ORACLE

    return ORACLE
