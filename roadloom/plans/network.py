"""Queries over the road-network operators, with SQL for all that SQL expresses."""

from __future__ import annotations

import functools
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadloom import pillars
from roadloom.functions import geo
from roadloom.functions.defaults import SEED
from roadloom.functions.frames import located, removed, shared_folder, small, spread, stored, table
from roadloom.functions.stats import pilot_size
from roadloom.operators import blocks, features, grid, metrics, network, paths, sampling, scoring, shapes, spatial
from roadloom.streaming import cells as streaming



def nodes(spark: SparkSession, d: str) -> DataFrame:
    return network.clean_nodes(table(spark, d, "nodes", "city", "node_id", "x", "y"))


def edges(spark: SparkSession, d: str) -> DataFrame:
    return network.clean_edges(table(spark, d, "edges", "edge_id", "city", "u", "v", "edge_key", "length", "highway", "loaded_at"), nodes(spark, d))


def multigraph(spark: SparkSession, d: str) -> DataFrame:
    return network.undirected(edges(spark, d))


def labels(spark: SparkSession, d: str) -> DataFrame:
    return network.components(multigraph(spark, d), nodes(spark, d))


def areas(spark: SparkSession, d: str) -> DataFrame:
    """City areas by the 500 m cells that hold nodes."""
    cell = F.struct(F.floor(F.col("x") / grid.CELL_M), F.floor(F.col("y") / grid.CELL_M))
    return nodes(spark, d).filter("x is not null and y is not null").groupBy("city").agg((F.countDistinct(cell) * 0.25).alias("area_km2"))


def _r(c: str, places: int = 6):
    return F.round(F.col(c), places).alias(c)


# --- graph -------------------------------------------------------------------------------------------------------------


def edges_directed(spark, d):
    return edges(spark, d).select("city", "u", "v", "edge_key", "length", "highway")


def edges_undirected(spark, d):
    return multigraph(spark, d).select("city", "lo", "hi", "edge_key", "length")


def selfloop_filter(spark, d):
    raw = table(spark, d, "edges", "city", "u", "v")
    return raw.groupBy("city").agg(F.count_if(F.col("u") == F.col("v")).alias("loops"), F.count_if(F.col("u") != F.col("v")).alias("kept"))


def edges_min_length(spark, d):
    return network.simple_graph(multigraph(spark, d))


def degree(spark, d):
    return network.degrees(multigraph(spark, d), nodes(spark, d))


def degree_histogram(spark, d):
    return degree(spark, d).groupBy("city", "degree").agg(F.count("*").alias("n_nodes"))


def degree_shares(spark, d):
    share = lambda c, name: F.round(100 * F.count_if(c) / F.count("*"), 6).alias(name)
    g = F.col("degree")
    return degree(spark, d).groupBy("city").agg(share(g == 1, "degree_1_pct"), share(g == 2, "degree_2_pct"), share(g >= 3, "degree_3plus_pct"), share(g >= 4, "degree_4plus_pct"))


def handshake_check(spark, d):
    out = metrics.densities(multigraph(spark, d), nodes(spark, d), areas(spark, d))
    return out.select("city", "degree_sum", "n_links", "degree_edge_check")


def components(spark, d):
    return labels(spark, d)


def component_sizes_topk(spark, d):
    return network.component_sizes(labels(spark, d)).orderBy(F.desc("n_nodes"), "city", "component").limit(20)


def lcc_nodes(spark, d):
    return network.within_largest(labels(spark, d))


def network_summary(spark, d):
    n, e = nodes(spark, d), edges(spark, d)
    m = network.undirected(e)
    return network.summary(e, m, n, network.components(m, n)).select("city", "number_of_nodes", "number_of_edges", "number_of_links", "connected_components", _r("average_node_degree"), _r("total_road_length_m", 3), _r("total_road_length_km"))


def _density(m, n, a):
    return metrics.densities(m, n, a).select("city", "n_nodes", "n_links", "area_km2", _r("node_density"), _r("link_density"), _r("average_degree"))


def density_full_population(spark, d):
    return _density(multigraph(spark, d), nodes(spark, d), areas(spark, d))


def node_link_density(spark, d):
    n, m = nodes(spark, d), multigraph(spark, d)
    members = network.within_largest(network.components(m, n))
    return _density(network.induced(m, members), members, areas(spark, d))


def full_vs_lcc(spark, d):
    n, m, a = nodes(spark, d), multigraph(spark, d), areas(spark, d)
    members = stored(network.within_largest(network.components(m, n)))
    full, part = metrics.densities(m, n, a), metrics.densities(network.induced(m, members), members, a)
    names = ["n_nodes", "n_links", "node_density", "link_density", "average_degree"]
    both = full.select("city", *[F.col(c).cast("double").alias(f"full_{c}") for c in names]).join(part.select("city", *[F.col(c).cast("double").alias(f"part_{c}") for c in names]), "city")
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("measure"), F.col(f"full_{c}").alias("full_value"), F.col(f"part_{c}").alias("lcc_value")) for c in names])).alias("r")
    pct = F.round(F.try_divide(100 * F.abs(F.col("r.lcc_value") - F.col("r.full_value")), F.abs(F.col("r.full_value"))), 6)
    return both.select("city", rows).select("city", "r.measure", F.round("r.full_value", 6).alias("full_value"), F.round("r.lcc_value", 6).alias("lcc_value"), pct.alias("pct_difference"))


def graph_simplify(spark, d):
    m = multigraph(spark, d)
    return network.simplified(network.simple_graph(m), nodes(spark, d)).select("city", "lo", "hi", _r("length"), "n_segments")


def truncate_graph(spark, d):
    """Edges with an end in the western half of their city's extent of nodes."""
    n = nodes(spark, d).filter(located())
    mid = n.groupBy("city").agg(((F.min("x") + F.max("x")) / 2).alias("mx"))
    inside = n.join(small(mid), "city").filter("x < mx").select("city", "node_id")
    return network.truncated(edges(spark, d), inside).select("city", "u", "v", "edge_key")


def articulation_bridges(spark, d):
    """b is the other end of a bridge, and a again for an articulation point."""
    return blocks.weak_points(multigraph(spark, d)).withColumn("b", F.coalesce("b", "a"))


# --- paths and measures ------------------------------------------------------------------------------------------------


def _lcc(spark, d):
    return pillars.largest(nodes(spark, d), stored(multigraph(spark, d)))


def _sizes(members: DataFrame) -> DataFrame:
    return sampling.populations(members, lambda n: pilot_size(n))


def pilot_sample(spark, d):
    return sampling.pilot(nodes(spark, d))


def hop_distances(spark, d):
    return paths.hop_distances(multigraph(spark, d), sampling.pilot(nodes(spark, d)))


def closeness(spark, d):
    members, m = _lcc(spark, d)
    sizes = _sizes(members)
    return metrics.closeness(paths.hop_sums(m, sampling.first_n(members, sizes)), sizes).select("city", "source", _r("closeness", 9))


def closeness_mean(spark, d):
    members, m = _lcc(spark, d)
    sizes = _sizes(members)
    return metrics.closeness(paths.hop_sums(m, sampling.first_n(members, sizes)), sizes).groupBy("city").agg(F.count("*").alias("n"), F.round(F.avg("closeness"), 9).alias("closeness"))


def _priced(spark, d):
    """The simple graph of the edges that have a length, kept: the size check and the batches both read it."""
    return stored(network.simple_graph(multigraph(spark, d), None))


def weighted_distances(spark, d):
    return paths.path_lengths(_priced(spark, d), sampling.pilot(nodes(spark, d))).select("city", "source", "target", _r("d"))


def efficiency_sources(spark, d):
    n = stored(nodes(spark, d))
    sizes = _sizes(n)
    sums = paths.path_sums(_priced(spark, d), sampling.first_n(n, sizes), n)
    return metrics.efficiency(sums, sizes).select("city", "source", _r("global_efficiency", 9), _r("average_shortest_path", 4), _r("circuity"))


def efficiency_mean(spark, d):
    n = stored(nodes(spark, d))
    sizes = _sizes(n)
    e = metrics.efficiency(paths.path_sums(_priced(spark, d), sampling.first_n(n, sizes), n), sizes)
    return e.groupBy("city").agg(F.round(F.avg("global_efficiency"), 9).alias("global_efficiency"), F.round(F.avg("average_shortest_path"), 4).alias("average_shortest_path"), F.round(F.avg("circuity"), 6).alias("circuity"))


def edge_circuity(spark, d):
    return metrics.edge_circuity(multigraph(spark, d), nodes(spark, d)).select("city", _r("average_edge_circuity"), "n_edges")


def gamma_index(spark, d):
    return metrics.gamma(multigraph(spark, d), nodes(spark, d)).select("city", _r("gamma_index", 9))


def rcrc(spark, d):
    n, m = nodes(spark, d), multigraph(spark, d)
    return metrics.rcrc(metrics.gamma(m, n), metrics.edge_circuity(m, n)).select("city", _r("gamma_index", 9), _r("average_edge_circuity"), _r("rcrc", 9))


def road_class_parse(spark, d):
    raw = table(spark, d, "edges", "highway").filter("highway is not null").groupBy("highway").agg(F.count("*").alias("n_edges"))
    return raw.select("highway", metrics.road_class(F.col("highway")).alias("road_class"), "n_edges")


def road_class_shares(spark, d):
    return metrics.class_lengths(multigraph(spark, d)).select("city", "road_class", _r("length", 3), "n_edges")


def road_class_entropy(spark, d):
    return metrics.class_entropy(metrics.class_lengths(multigraph(spark, d))).select("city", _r("class_entropy", 9))


def _betweenness(spark, d):
    n, simple = stored(nodes(spark, d)), stored(network.simple_graph(multigraph(spark, d)))
    return pillars.betweenness(n, simple), simple


def edge_betweenness(spark, d):
    return _betweenness(spark, d)[0].select("city", "lo", "hi", _r("betweenness", 12))


def betweenness_p90(spark, d):
    return metrics.betweenness_p90(_betweenness(spark, d)[0]).select("city", _r("betweenness_p90", 12), "n_edges")


def hierarchy_clarity(spark, d):
    return metrics.hierarchy_clarity(*_betweenness(spark, d)).select("city", "n", _r("rho", 9))


def spearman_length_class(spark, d):
    simple = network.simple_graph(multigraph(spark, d))
    ranked = simple.withColumn("importance", -metrics.rank_of(metrics.road_class(F.col("highway")))).filter("importance is not null")
    return metrics.rank_correlation(ranked, "importance", "length").select("city", "n", _r("rho", 9))


# --- sampling and inference --------------------------------------------------------------------------------------------


def required_n(spark, d):
    """Adaptive closeness: pilot, required and final sample with its confidence interval."""
    return pillars.closeness(*_lcc(spark, d)).select("city", "metric", "population", "pilot_size", "sample_size", "n_finite", _r("estimate", 9), _r("standard_error", 12), _r("ci_lower", 9), _r("ci_upper", 9), _r("relative_margin", 9))


def ci_fpc(spark, d):
    """Mean, deviation and standard error with finite population correction of the pilot's closeness."""
    members, m = _lcc(spark, d)
    sizes = _sizes(members)
    c = metrics.closeness(paths.hop_sums(m, sampling.first_n(members, sizes)), sizes)
    s = c.groupBy("city").agg(F.count("*").alias("n"), F.avg("closeness").alias("mean"), F.coalesce(F.stddev_samp("closeness"), F.lit(0.0)).alias("sd")).join(small(sizes.select("city", "population")), "city")
    fpc = F.sqrt((F.col("population") - F.col("n")) / (F.col("population") - 1))
    return s.select("city", "population", "n", F.round("mean", 9).alias("mean"), F.round("sd", 9).alias("sd"), F.round(F.when(F.col("n") > 1, F.col("sd") / F.sqrt("n") * fpc), 12).alias("standard_error"))


def multiseed(spark, d):
    """The pilot estimate of closeness under several seeds, one row per seed and city."""
    members, m = _lcc(spark, d)
    sizes = _sizes(members)
    out = None
    for run, seed in enumerate((SEED, SEED + 1, SEED + 2), 1):
        c = metrics.closeness(paths.hop_sums(m, sampling.first_n(members, sizes, seed)), sizes).groupBy("city").agg(F.count("*").alias("sample_size"), F.round(F.avg("closeness"), 9).alias("estimate"))
        c = c.select("city", F.lit(run).alias("run"), F.lit(seed).alias("seed"), "sample_size", "estimate")
        out = c if out is None else out.unionByName(c)
    return out


def random_sample(spark, d):
    """10,000 located nodes, the first by hash: the sample that a distance plot draws."""
    return nodes(spark, d).filter(located()).orderBy(sampling.order_hash(F.col("node_id"), SEED), "node_id").limit(10_000).select("city", "node_id")


# --- scores ------------------------------------------------------------------------------------------------------------


def _metric_table(spark, d):
    """city, metric, value of the measures that need no paths."""
    n, m = nodes(spark, d), stored(multigraph(spark, d))
    dens = metrics.densities(m, n, areas(spark, d)).select("city", "node_density", "link_density", "average_degree")
    ratio = metrics.rcrc(metrics.gamma(m, n), metrics.edge_circuity(m, n)).select("city", "rcrc")
    entropy = metrics.class_entropy(metrics.class_lengths(m)).withColumnRenamed("class_entropy", "hierarchy_road_class_distribution")
    wide = dens.join(ratio, "city").join(entropy, "city")
    return stored(scoring.long_form(wide, [c for c in wide.columns if c != "city"]))


def _index(spark, d):
    scores = scoring.normalised(_metric_table(spark, d))
    return scoring.composite(scoring.pillar_scores(scores)), scores


def minmax_scores(spark, d):
    return scoring.normalised(_metric_table(spark, d)).select("city", "pillar", "metric", _r("value"), _r("score"))


def minmax_down(spark, d):
    """The same measures read as costs."""
    v = _metric_table(spark, d)
    span = v.groupBy("metric").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    return v.join(small(span), "metric").select("city", "metric", F.round(scoring.scaled(F.col("value"), F.col("lo"), F.col("hi"), -1, "high"), 6).alias("score"))


def minmax_degenerate(spark, d):
    """Each value in ranges about as wide as the three tests of a degenerate range allow: their verdicts differ."""
    v, x = _metric_table(spark, d).filter("value > 0"), F.col("value")
    out = []
    for width in (0.0, 5e-10, 9e-6, 1.1e-5, 1e-3):
        hi = x * (1 + width)
        out.append(v.select("city", "metric", F.lit(width).alias("width"), *[F.round(scoring.scaled(x, x, hi, 1, t), 3).alias(f"score_{t}") for t in ("low", "high", "relative")]))
    return functools.reduce(DataFrame.unionByName, out)


def pillar_scores(spark, d):
    return _index(spark, d)[0].select("city", *[_r(f"{p}_score") for p in scoring.PILLARS])


def composite(spark, d):
    return _index(spark, d)[0].select("city", _r("index_score"), "arithmetic_ok")


def pillar_merge(spark, d):
    """Full outer join of three pillar tables."""
    p = stored(_index(spark, d)[0])
    parts = [p.select("city", f"{x}_score") for x in scoring.PILLARS]
    return scoring.merged(*parts).select("city", *[_r(f"{x}_score") for x in scoring.PILLARS])


def validation_flags(spark, d):
    return scoring.validation(_index(spark, d)[0])


def reference_range(spark, d):
    r = scoring.reference_range(_index(spark, d)[0])
    return r.select("n_cities", *[_r(c) for c in r.columns if c != "n_cities"])


def tiers(spark, d):
    return scoring.tiers(stored(_index(spark, d)[0])).select("city", _r("index_score"), "tier")


def normalization_reference(spark, d):
    r = scoring.normalization_reference(_index(spark, d)[1])
    return r.select("metric", _r("minimum_reference_value"), _r("maximum_reference_value"), "direction")


def evaluate_vs_reference(spark, d):
    """Every city against the range of the others alone: scores beyond 0 and 100 stay."""
    v = _metric_table(spark, d)
    specs = scoring.metric_specs(spark).select("metric", "direction")
    span = scoring.ranges_of_others(v).join(small(specs), "metric")
    return span.select("city", "metric", F.round(scoring.scaled(F.col("value"), F.col("lo"), F.col("hi"), F.col("direction"), "low"), 6).alias("score"))


def interpretation(spark, d):
    index = stored(_index(spark, d)[0])
    return scoring.interpretation(index, scoring.reference_range(index)).select("city", "position", "mean_side", *[f"{p}_side" for p in scoring.PILLARS], "summary")


def _all_scores(spark, d):
    """The whole programme: sampled closeness, efficiency and betweenness with all other measures, scored."""
    n, m = stored(nodes(spark, d)), stored(multigraph(spark, d))
    simple = stored(network.simple_graph(m))
    between = stored(pillars.betweenness(n, simple))
    return pillars.scores(pillars.connectivity(*pillars.largest(n, m), areas(spark, d)), pillars.efficiency(n, m), pillars.hierarchy(m, simple, between))


def index_metrics(spark, d):
    """All eleven measures of every city with their scores."""
    return _all_scores(spark, d).select("city", "pillar", "metric", _r("value", 9), _r("score"))


def city_index(spark, d):
    """The composite of all eleven measures."""
    return pillars.index(_all_scores(spark, d)).select("city", *[_r(f"{p}_score") for p in scoring.PILLARS], _r("index_score"))


# --- grid and extents --------------------------------------------------------------------------------------------------


def footprints(spark, d):
    """A square building around every located node, of a side that its id gives; the driver's tables have no buildings."""
    side = 30 + F.pmod(F.col("node_id"), F.lit(150))
    half = side / 2
    return nodes(spark, d).filter(located()).select("city", F.col("node_id").alias("polygon_id"), (F.col("x") - half).alias("lx"), (F.col("y") - half).alias("ly"), (F.col("x") + half).alias("hx"), (F.col("y") + half).alias("hy"))


def _limits(spark, d):
    f = footprints(spark, d)
    return grid.bounds(f.select("city", F.explode(F.array(F.struct(F.col("lx").alias("x"), F.col("ly").alias("y")), F.struct(F.col("hx").alias("x"), F.col("hy").alias("y")))).alias("p")).select("city", "p.x", "p.y"))


def _covered(spark, d):
    return grid.coverage(grid.rectangle_overlay(footprints(spark, d)), stored(_limits(spark, d)))


def _built(spark, d):
    return grid.cell_components(stored(_covered(spark, d).filter("built_up")))


def _centers(spark, d):
    return nodes(spark, d).filter(located()).groupBy("city").agg(F.median("x").alias("x"), F.median("y").alias("y"))


def grid_cells(spark, d):
    return grid.full_grid(_limits(spark, d)).groupBy("city").agg(F.count("*").alias("n_cells"), F.max("grid_id").alias("last_id"), F.max("row").alias("last_row"), F.max("col").alias("last_col"), F.round(F.min("center_x"), 3).alias("first_x"), F.round(F.min("center_y"), 3).alias("first_y"))


def coverage(spark, d):
    return _covered(spark, d).filter("building_area_m2 > 0").select("city", "grid_id", "row", "col", _r("building_area_m2", 3), _r("building_coverage"))


def built_up(spark, d):
    return _covered(spark, d).groupBy("city").agg(F.count("*").alias("n_cells"), F.count_if("built_up").alias("n_built_up"), F.round(F.sum("building_area_m2"), 2).alias("building_area_m2"))


def coverage_describe(spark, d):
    c = F.col("building_coverage")
    q = lambda p, n: F.round(F.percentile(c, p), 9).alias(n)
    return _covered(spark, d).filter("building_coverage > 0").groupBy("city").agg(F.count("*").alias("n"), F.round(F.avg(c), 9).alias("mean"), F.round(F.stddev_samp(c), 9).alias("sd"), F.round(F.min(c), 9).alias("least"), q(0.25, "q25"), q(0.5, "q50"), q(0.75, "q75"), F.round(F.max(c), 9).alias("most"))


def cell_components(spark, d):
    return _built(spark, d).select("city", "grid_id", "component_id")


def component_stats(spark, d):
    return grid.component_table(_built(spark, d)).select("city", "component_id", "cell_count", "component_area_km2", _r("building_area_m2", 2), _r("mean_building_coverage"), _r("median_building_coverage"), _r("centroid_x", 3), _r("centroid_y", 3))


def component_gaps(spark, d):
    return grid.component_gaps(stored(_built(spark, d))).select("city", "component_a", "component_b", _r("gap_km"))


def extent_selection(spark, d):
    built = stored(_built(spark, d))
    return grid.city_extent(built, _centers(spark, d)).select("city", "component_id", "selected_component_ids", "n_components", "extent_cells", "extent_area_km2", _r("distance_to_city_center_km"))


def urban_core(spark, d):
    built = stored(_built(spark, d))
    return grid.urban_core(grid.extent_cells(built, grid.selected_components(built, _centers(spark, d)))).select("city", "grid_id", _r("building_coverage"), _r("core_threshold"))


def extent_report(spark, d):
    covered = stored(_covered(spark, d))
    built = stored(grid.cell_components(covered.filter("built_up")))
    extent = stored(grid.extent_cells(built, grid.selected_components(built, _centers(spark, d))))
    r = grid.extent_report(covered, extent, grid.urban_core(extent))
    whole = {"city", "grid_cells", "built_up_cells", "extent_cells", "core_cells"}
    return r.select(*[c if c in whole else _r(c) for c in r.columns])


def alt_core_support(spark, d):
    c = grid.core_support(_covered(spark, d))
    return c.groupBy("city").agg(F.round(F.max("core_threshold"), 9).alias("core_threshold"), F.round(F.max("support_threshold"), 9).alias("support_threshold"), F.count_if("core").alias("n_core"), F.count_if("support").alias("n_support"))


def alternative_extent(spark, d):
    return grid.alternative_extent(stored(_covered(spark, d)), _centers(spark, d)).select("city", "component_id", "core_count", "cell_count", "core_area_km2")


def extent_outline(spark, d):
    built = stored(_built(spark, d))
    border = grid.outline(grid.extent_cells(built, grid.selected_components(built, _centers(spark, d))))
    return border.groupBy("city").agg(F.count("*").alias("n_edges"), F.sum(F.abs(F.col("bx") - F.col("ax")) + F.abs(F.col("by") - F.col("ay"))).alias("perimeter_m"))


# --- geometry ----------------------------------------------------------------------------------------------------------

# The UTM zone of each city, as an EPSG code.
SRID = {"Chandigarh": 32643, "Jaipur": 32643, "Pune": 32643, "Kolkata": 32645, "Ranipet": 32644}


def _srid():
    """The zone of the row's city; a city without a known zone fails the job rather than being left out."""
    zone = F.try_element_at(F.create_map(*[x for c, s in SRID.items() for x in (F.lit(c), F.lit(s))]), F.col("city"))
    return F.coalesce(zone, F.raise_error(F.concat(F.lit("no UTM zone is known for "), F.col("city"))).cast("int"))


def utm_inverse(spark, d):
    lon, lat = geo.from_utm(F.col("x"), F.col("y"), F.col("srid"))
    return nodes(spark, d).filter(located()).withColumn("srid", _srid()).select("city", "node_id", F.round(lon, 7).alias("lon"), F.round(lat, 7).alias("lat"))


def utm_round_trip(spark, d):
    """Largest error in metres of going to degrees and back, in millimetres rounded."""
    lon, lat = geo.from_utm(F.col("x"), F.col("y"), F.col("srid"))
    n = nodes(spark, d).filter(located()).withColumn("srid", _srid()).select("city", "x", "y", "srid", lon.alias("lon"), lat.alias("lat"))
    ux, uy = geo.to_utm(F.col("lon"), F.col("lat"), F.col("srid"))
    return n.groupBy("city").agg(F.count("*").alias("n"), F.round(F.max(F.hypot(ux - F.col("x"), uy - F.col("y"))), 3).alias("worst_m"))


def mercator_project(spark, d):
    lon, lat = F.lit(70.0) + F.pmod(F.col("node_id"), F.lit(2000)) / 100, F.lit(10.0) + F.pmod(F.col("node_id"), F.lit(1777)) / 100
    mx, my = geo.to_mercator(lon, lat)
    return nodes(spark, d).select("city", "node_id", F.round(mx, 3).alias("mx"), F.round(my, 3).alias("my"), geo.utm_srid(lon, lat).alias("srid"))


def local_metres(spark, d):
    lon, lat = F.lit(70.0) + F.pmod(F.col("node_id"), F.lit(2000)) / 100, F.lit(10.0) + F.pmod(F.col("node_id"), F.lit(1777)) / 100
    n = nodes(spark, d).select("city", "node_id", lon.alias("lon"), lat.alias("lat"))
    mean = n.groupBy("city").agg(F.avg("lon").alias("mlon"), F.avg("lat").alias("mlat"))
    lx, ly = geo.to_local_metres(F.col("lon"), F.col("lat"), F.col("mlon"), F.col("mlat"))
    return n.join(small(mean), "city").select("city", "node_id", F.round(lx, 3).alias("lx"), F.round(ly, 3).alias("ly"))


def extraction_envelope(spark, d):
    """Squares of 50 km about the centres, in degrees."""
    c = _centers(spark, d).withColumn("srid", _srid())
    lon, lat = geo.from_utm(F.col("x"), F.col("y"), F.col("srid"))
    west, south, east, north = geo.envelope(lon, lat)
    return c.select("city", F.round(west, 7).alias("west"), F.round(south, 7).alias("south"), F.round(east, 7).alias("east"), F.round(north, 7).alias("north"))


def polygon_area(spark, d):
    m = shapes.measures(table(spark, d, "city_extents", "region_id", "geometry"))
    return m.select(F.col("id").alias("region_id"), "parts", "holes", _r("area_m2", 1), _r("min_x", 2), _r("min_y", 2), _r("max_x", 2), _r("max_y", 2))


def polygon_overlay(spark, d):
    """Area of every region as the sum of its pieces in 500 m cells."""
    e = table(spark, d, "city_extents", "region_id", "city", "geometry").withColumnRenamed("region_id", "polygon_id")
    return grid.overlay(spread(e)).groupBy("polygon_id").agg(F.round(F.sum("area_m2"), 1).alias("area_m2")).withColumnRenamed("polygon_id", "region_id")


def polygon_clean(spark, d):
    return shapes.cleaned(table(spark, d, "city_extents", "region_id", "city", "geometry"), tolerance=50.0)


def search_area(spark, d):
    """Cells that a circle of 15 km about each centre meets, and their area within it."""
    c = features.search_cells(_centers(spark, d), 15_000.0)
    return c.groupBy("city").agg(F.count("*").alias("n_cells"), F.round(F.sum("cell_area_m2"), 0).alias("area_m2"))


def convex_hull(spark, d):
    return shapes.convex_hulls(nodes(spark, d)).select("city", "corners", _r("area_m2", 2))


def admin_classify(spark, d):
    """Boundary relations made of order rows: level (one in ten none), government and place by their keys."""
    o = table(spark, d, "orders", "o_orderkey", "o_custkey")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    level = F.when(F.pmod(c, F.lit(10)) == 1, "none").otherwise((F.pmod(k, F.lit(8)) + 2).cast("string"))
    kinds = F.create_map(F.lit("admin_level"), level, F.lit("boundary"), F.when(F.pmod(c, F.lit(10)) == 0, "postal").otherwise("administrative"), F.lit("place"), F.when(F.pmod(k, F.lit(3)) == 0, "Town").otherwise("hamlet"), F.lit("government"), F.when(F.pmod(k, F.lit(5)) == 0, " City_Council").otherwise(""))
    kind, reason = shapes.administrative_kind(kinds)
    return o.select("o_orderkey", kind.alias("kind"), reason.alias("reason"))


def _roads(spark, d):
    return network.with_ends(multigraph(spark, d), nodes(spark, d), "lo", "hi").select("city", "ax", "ay", "bx", "by")


def _lattice(spark, d, step=500.0):
    """Sample points of the cells that hold nodes."""
    n = nodes(spark, d).filter(located())
    cells = n.select("city", F.floor(F.col("x") / 500).alias("cx"), F.floor(F.col("y") / 500).alias("cy")).distinct()
    full = cells.select("city", (F.col("cy") * 100000 + F.col("cx")).alias("grid_id"), ((F.col("cx") + 0.5) * 500).alias("center_x"), ((F.col("cy") + 0.5) * 500).alias("center_y"))
    return shapes.lattice(full, step)


def road_distance_lattice(spark, d):
    return shapes.near_roads(_lattice(spark, d), _roads(spark, d), 500.0).select("city", "point_id", _r("d", 3))


def distance_thresholds(spark, d):
    p = stored(_lattice(spark, d))
    t = shapes.distance_thresholds(shapes.near_roads(p, _roads(spark, d), 500.0), p)
    return t.select("city", "n_points", *[_r(c, 4) for c in t.columns if c not in ("city", "n_points")])


def buffer_coverage(spark, d):
    return shapes.buffer_coverage(stored(_lattice(spark, d, 125.0)), _roads(spark, d)).select("city", "width_m", "n_points", _r("covered_pct"))


def _extents(spark, d):
    return spread(table(spark, d, "city_extents", "region_id", "city", "geometry"))


def _extent_roads(spark, d):
    """The parts of the roads within each region, under the region's id."""
    return shapes.clipped_to_regions(_roads(spark, d), spatial.triangles(_extents(spark, d)))


def _extent_distances(spark, d):
    return shapes.nearest_roads(shapes.extent_lattice(_extents(spark, d)), _extent_roads(spark, d), keep=("place", "point_id"))


def extent_road_distance(spark, d):
    """Exact distance of every 500 m point of each whole extent to the nearest road within it; null if it holds none."""
    return _extent_distances(spark, d).select(F.col("city").cast("bigint").alias("region_id"), F.col("place").alias("city"), "point_id", _r("d", 3))


def extent_distance_thresholds(spark, d):
    p = stored(_extent_distances(spark, d))
    t = shapes.distance_thresholds(p.filter("d is not null"), p)
    return t.select(F.col("city").cast("bigint").alias("region_id"), "n_points", *[_r(c, 4) for c in t.columns if c not in ("city", "n_points")])


def extent_buffer_coverage(spark, d):
    """Share of each whole extent within a distance of its roads, by points every 125 m."""
    p = stored(shapes.extent_lattice(_extents(spark, d), 125.0, 62.5))
    return shapes.buffer_coverage(p, stored(_extent_roads(spark, d))).select(F.col("city").cast("bigint").alias("region_id"), "width_m", "n_points", _r("covered_pct"))


def winners(spark, d):
    return scoring.winners(scoring.normalised(_metric_table(spark, d))).select("metric", "city", _r("score"))


# --- streams -----------------------------------------------------------------------------------------------------------


def streamed_coverage(spark, d):
    """Covered area per cell of the footprints, arriving as files in micro-batches."""
    place = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    footprints(spark, d).repartition(4).write.parquet(f"{place}/in")
    got = stored(streaming.ingest(spark, f"{place}/in", f"{place}/out", f"{place}/state", files_per_batch=2))
    removed(spark, place)
    return got.select("city", "cx", "cy", _r("building_area_m2", 3))


def loading_windows(spark, d):
    """Edges per city and week of loading, as a stream would count them."""
    return streaming.windowed_counts(table(spark, d, "edges", "city", "loaded_at"), every="7 days")


_PLAIN = (
    edges_directed, edges_undirected, selfloop_filter, edges_min_length, degree, degree_histogram, degree_shares, handshake_check, components, component_sizes_topk, lcc_nodes, network_summary,
    density_full_population, node_link_density, full_vs_lcc, graph_simplify, truncate_graph, articulation_bridges, pilot_sample, hop_distances, closeness, closeness_mean, weighted_distances,
    efficiency_sources, efficiency_mean, edge_circuity, gamma_index, rcrc, road_class_parse, road_class_shares, road_class_entropy, edge_betweenness, betweenness_p90, hierarchy_clarity,
    spearman_length_class, required_n, ci_fpc, multiseed, random_sample, minmax_scores, minmax_down, minmax_degenerate, pillar_scores, composite, pillar_merge, validation_flags, reference_range,
    tiers, normalization_reference, evaluate_vs_reference, interpretation, index_metrics, city_index, grid_cells, coverage, built_up, coverage_describe, cell_components, component_stats, component_gaps,
    extent_selection, urban_core, extent_report, alt_core_support, alternative_extent, extent_outline, utm_inverse, utm_round_trip, mercator_project, local_metres, extraction_envelope,
    polygon_area, polygon_overlay, polygon_clean, convex_hull, admin_classify, road_distance_lattice, distance_thresholds, buffer_coverage, winners,
    extent_road_distance, extent_distance_thresholds, extent_buffer_coverage,
    search_area, streamed_coverage, loading_windows,
)


def queries() -> dict:
    return {f.__name__: f for f in _PLAIN}


def oracle_sql() -> dict[str, str]:
    from roadloom.plans import graph_sql, network_sql

    return {**network_sql.ORACLE, **graph_sql.ORACLE}
