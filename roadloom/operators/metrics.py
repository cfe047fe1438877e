"""Measures of road networks per city: densities, closeness, efficiency, circuity, class entropy, hierarchy clarity."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadloom.functions.frames import small
from roadloom.functions import defaults
from roadloom.operators import network, paths, ranks
from roadloom.operators.multivalue import Segmenter

# The road classes of the hierarchy and their ranks; two classes share the last rank. Links count as their class.
RANKS = {"motorway": 1, "trunk": 2, "primary": 3, "secondary": 4, "tertiary": 5, "unclassified": 6, "residential": 7, "living_street": 8, "service": 8}
LINKED = ("motorway", "trunk", "primary", "secondary", "tertiary")


def plain_class(value: Column) -> Column:
    """Lower case, trimmed, a link as the class it links to; null for classes outside the hierarchy."""
    v = F.lower(F.regexp_replace(value, r"^[\s\u00a0]+|[\s\u00a0]+$", ""))
    v = F.regexp_replace(v, f"^({'|'.join(LINKED)})_link$", "$1")
    return F.when(v.isin(*RANKS), v)


def rank_of(name: Column) -> Column:
    return F.create_map(*[x for k, r in RANKS.items() for x in (F.lit(k), F.lit(r))])[name]


def road_class(highway: Column) -> Column:
    """The highest class among the values of a highway field (first named of equal rank); null if none is known.

    Fields of one bare word never leave the JVM; only texts that look like lists are split in Python.
    """
    listed = highway.rlike(r"[,;|/+&\n\r\t、；，｜\[\]{}()\"']")

    def highest(texts: pd.Series) -> pd.Series:
        seg = Segmenter()
        codes, distinct = pd.factorize(texts)
        done = [_highest_of(seg.split(t)) for t in distinct]
        return pd.Series([done[c] if c >= 0 else None for c in codes], index=texts.index, dtype=object)

    highest.__annotations__ = {"texts": pd.Series, "return": pd.Series}
    several = F.pandas_udf(highest, "string").asNondeterministic()
    return F.when(listed, several(F.when(listed, highway))).otherwise(plain_class(highway))


def _highest_of(values: list[str]) -> str | None:
    """The value of smallest rank, the first of equal ones; links as the class they link to."""
    names = [n[:-5] if n.endswith("_link") and n[:-5] in LINKED else n for n in (v.strip().lower() for v in values)]
    return min((n for n in names if n in RANKS), key=RANKS.get, default=None)


def densities(multigraph: DataFrame, nodes: DataFrame, areas: DataFrame) -> DataFrame:
    """Per city over the given population: counts, node and link density per km2, average degree, handshake check."""
    n = nodes.groupBy("city").agg(F.count("*").alias("n_nodes"))
    e = multigraph.groupBy("city").agg(F.count("*").alias("n_links"))
    d = network.degrees(multigraph, nodes).groupBy("city").agg(F.sum("degree").alias("degree_sum"))
    out = n.join(e, "city", "left").join(d, "city", "left").join(areas, "city", "left").na.fill(0, ["n_links", "degree_sum"])
    return out.select("city", "n_nodes", "n_links", "area_km2", F.try_divide("n_nodes", "area_km2").alias("node_density"), F.try_divide("n_links", "area_km2").alias("link_density"), F.try_divide("degree_sum", "n_nodes").alias("average_degree"), "degree_sum", (F.col("degree_sum") == 2 * F.col("n_links")).alias("degree_edge_check"))


def extent_densities(nodes: DataFrame, multigraph: DataFrame, extents: DataFrame, built: DataFrame, hulls: DataFrame) -> DataFrame:
    """Per city: nodes and links per km2 of the extent (city, extent_km2) and of the built-up area in it (city, built_up_km2; null
    where there is none), and the hull of the nodes (city, hull_km2) in per cent of the extent."""
    n = nodes.groupBy("city").agg(F.count("*").alias("n"))
    e = multigraph.groupBy("city").agg(F.count("*").alias("e"))
    both = n.join(e, "city", "left").na.fill(0, ["e"]).join(extents, "city").join(built, "city", "left").join(hulls, "city", "left")
    per = lambda c, area, name: F.when(F.col(area) > 0, F.col(c) / F.col(area)).alias(name)
    return both.select("city", per("n", "extent_km2", "nodes_per_extent_km2"), per("e", "extent_km2", "links_per_extent_km2"), per("n", "built_up_km2", "nodes_per_built_km2"), per("e", "built_up_km2", "links_per_built_km2"), "hull_km2", F.when(F.col("extent_km2") > 0, 100 * F.col("hull_km2") / F.col("extent_km2")).alias("hull_pct"))


def closeness(sums: DataFrame, populations: DataFrame) -> DataFrame:
    """Wasserman-Faust closeness of each source. sums: city, source, reachable (the source counts), total_hops."""
    r, s, n = F.col("reachable"), F.col("total_hops"), F.col("population")
    value = F.when((r <= 1) | (s <= 0), 0.0).otherwise((r - 1) / s * ((r - 1) / (n - 1)))
    return sums.join(small(populations.select("city", "population")), "city").select("city", "source", value.alias("closeness"))


def efficiency(sums: DataFrame, populations: DataFrame) -> DataFrame:
    """Per source: global efficiency over all other nodes, mean path length and mean circuity over the reachable ones (null without any)."""
    n = F.col("population")
    return sums.join(small(populations.select("city", "population")), "city").select(
        "city",
        "source",
        F.when(n > 1, F.coalesce("sum_inverse", F.lit(0.0)) / (n - 1)).otherwise(0.0).alias("global_efficiency"),
        F.when(F.col("reachable") > 0, F.col("sum_d") / F.col("reachable")).alias("average_shortest_path"),
        F.when(F.col("n_ratio") > 0, F.col("sum_ratio") / F.col("n_ratio")).alias("circuity"),
    )


def edge_circuity(multigraph: DataFrame, nodes: DataFrame) -> DataFrame:
    """Per city the mean of length over straight line of all edges with both, the straight line being positive."""
    straight = F.hypot(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay"))
    ratio = F.when((straight > 0) & F.col("length").isNotNull(), F.col("length") / straight)
    return network.with_ends(multigraph, nodes).groupBy("city").agg(F.avg(ratio).alias("average_edge_circuity"), F.count(ratio).alias("n_edges"))


def gamma(multigraph: DataFrame, nodes: DataFrame) -> DataFrame:
    n = nodes.groupBy("city").agg(F.count("*").alias("v"))
    e = multigraph.groupBy("city").agg(F.count("*").alias("e"))
    value = F.when(F.col("v") > 2, F.coalesce("e", F.lit(0)) / (3 * (F.col("v") - 2))).otherwise(0.0)
    return n.join(e, "city", "left").select("city", value.alias("gamma_index"))


def rcrc(gammas: DataFrame, circuities: DataFrame) -> DataFrame:
    value = F.when(F.col("average_edge_circuity") > 0, F.col("gamma_index") / F.col("average_edge_circuity")).otherwise(0.0)
    return gammas.join(circuities, "city", "left").select("city", "gamma_index", "average_edge_circuity", value.alias("rcrc"))


def class_lengths(multigraph: DataFrame, missing: float = 1.0) -> DataFrame:
    """(city, road_class, length, n_edges) over the edges of a known class; an edge without length counts `missing`."""
    classed = multigraph.withColumn("road_class", road_class(F.col("highway"))).filter("road_class is not null")
    return classed.groupBy("city", "road_class").agg(F.sum(F.coalesce("length", F.lit(missing))).alias("length"), F.count("*").alias("n_edges"))


def class_entropy(lengths: DataFrame) -> DataFrame:
    """Shannon entropy of the length shares over the log of the number of classes; null without length, NaN with a class of none."""
    total = F.sum("length").over(Window.partitionBy("city"))
    p = F.col("length") / F.col("total")
    part = F.when(F.col("length") == 0, F.lit(float("nan"))).otherwise(p * F.log(p))
    shares = lengths.withColumn("total", total)
    return shares.groupBy("city").agg(F.when(F.max("total") > 0, -F.sum(part) / math.log(len(RANKS))).alias("class_entropy"))


def rank_correlation(pairs: DataFrame, x: str, y: str, key: str = "city") -> DataFrame:
    """Spearman's rho with average ranks; null under three rows or without spread.

    Ranks come from counts of distinct values in range partitions (ranks.cumulated), so no group is ordered in one task.
    """
    both = pairs.join(ranks.average_ranks(pairs, x, "rx", key), [key, x]).join(ranks.average_ranks(pairs, y, "ry", key), [key, y])
    sums = both.groupBy(key).agg(F.count("*").alias("n"), F.covar_pop("rx", "ry").alias("c"), F.stddev_pop("rx").alias("sx"), F.stddev_pop("ry").alias("sy"))
    return sums.select(key, "n", F.when((F.col("n") >= 3) & (F.col("sx") > 0) & (F.col("sy") > 0), F.col("c") / (F.col("sx") * F.col("sy"))).alias("rho"))


def hierarchy_clarity(betweenness: DataFrame, simple: DataFrame) -> DataFrame:
    """Rank correlation of importance (minus class rank) and betweenness over the edges of a known class.

    Betweenness is compared to twelve decimals, so that ranks don't depend on the order in which its parts were added.
    """
    ranked = simple.withColumn("importance", -rank_of(road_class(F.col("highway")))).filter("importance is not null").select("city", "lo", "hi", "importance")
    return rank_correlation(betweenness.withColumn("betweenness", F.round("betweenness", 12)).join(ranked, ["city", "lo", "hi"]), "importance", "betweenness")


def betweenness_p90(betweenness: DataFrame) -> DataFrame:
    return ranks.quantile(betweenness, "betweenness", 0.9, "betweenness_p90").withColumnRenamed("n", "n_edges")


def betweenness_sources(population: int, fraction: float = defaults.BETWEENNESS_FRACTION, least: int = defaults.LEAST_SOURCES, most: int = defaults.MOST_SOURCES) -> int:
    return min(population, min(most, max(least, math.ceil(fraction * population))))


def sweep(pairs: DataFrame, nodes: DataFrame, populations: DataFrame):
    """sources -> the three efficiency measures per source, for sampling.adaptive()."""
    return lambda sources: efficiency(paths.path_sums(pairs, sources, nodes), populations)
