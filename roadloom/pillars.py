"""The programme by pillars: tables of nodes and links in, one row of measures per city out.

nodes: city, node_id, x, y (network.clean_nodes). links: the undirected multigraph (network.undirected). areas: city, area_km2.
Tables that are read several times should be stored or written first; sizes and precision come from functions.defaults.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadloom.functions.frames import stored
from roadloom.functions.stats import pilot_size
from roadloom.operators import metrics, network, paths, sampling, scoring

EFFICIENCY = ("global_efficiency", "average_shortest_path", "circuity")


def largest(nodes: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, links) of each city's largest component."""
    members = stored(network.within_largest(stored(network.components(links, nodes))))
    return members, stored(network.induced(links, members))


def closeness_measure(members: DataFrame, links: DataFrame):  # noqa: ANN201
    """sources -> closeness of each, for sampling.adaptive()."""
    sizes = sampling.populations(members, pilot_size)
    return lambda sources: metrics.closeness(paths.hop_sums(links, sources), sizes)


def closeness(members: DataFrame, links: DataFrame, seed: int = sampling.SEED) -> DataFrame:
    """The adaptive estimate of mean closeness per city with its interval."""
    return sampling.adaptive(members, closeness_measure(members, links), ["closeness"], seed=seed)


def connectivity(members: DataFrame, links: DataFrame, areas: DataFrame) -> DataFrame:
    """Densities and average degree over the given population, and its closeness with the sample's size and interval."""
    near = closeness(members, links).select("city", F.col("estimate").alias("closeness_centrality"), "sample_size", "relative_margin", "ci_lower", "ci_upper")
    return metrics.densities(links, members, areas).join(near, "city", "left")


def efficiency_estimates(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """The adaptive estimates of the three measures of path lengths per city with their intervals."""
    sizes = sampling.populations(nodes, pilot_size)
    return sampling.adaptive(nodes, metrics.sweep(stored(network.simple_graph(links, None)), nodes, sizes), list(EFFICIENCY), rule="critical")


def efficiency(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """Global efficiency, average shortest path, circuity and the ratio of gamma index to edge circuity."""
    found = efficiency_estimates(nodes, links).groupBy("city").pivot("metric", list(EFFICIENCY)).agg(F.first("estimate"))
    return metrics.rcrc(metrics.gamma(links, nodes), metrics.edge_circuity(links, nodes)).join(found, "city", "left")


def betweenness_sample(nodes: DataFrame) -> DataFrame:
    """The sources of betweenness per city."""
    return sampling.first_n(nodes, sampling.populations(nodes, metrics.betweenness_sources))


def betweenness(nodes: DataFrame, simple: DataFrame) -> DataFrame:
    return paths.edge_betweenness(simple, betweenness_sample(nodes), nodes)


def hierarchy(links: DataFrame, simple: DataFrame, between: DataFrame) -> DataFrame:
    """90th percentile of edge betweenness, entropy of road classes, rank correlation of class and betweenness."""
    p90 = metrics.betweenness_p90(between).select("city", F.col("betweenness_p90").alias("hierarchy_betweenness_centrality"))
    entropy = metrics.class_entropy(metrics.class_lengths(links)).withColumnRenamed("class_entropy", "hierarchy_road_class_distribution")
    clarity = metrics.hierarchy_clarity(between, simple).select("city", F.col("rho").alias("hierarchy_clarity"))
    return p90.join(entropy, "city", "left").join(clarity, "city", "left")


def scores(connected: DataFrame, efficient: DataFrame, ordered: DataFrame) -> DataFrame:
    """city, pillar, metric, value, lo, hi, score of all eleven measures."""
    wide = connected.join(efficient, "city", "full_outer").join(ordered, "city", "full_outer")
    return scoring.normalised(scoring.long_form(stored(wide.select("city", *scoring.METRICS)), list(scoring.METRICS)))


def index(scored: DataFrame) -> DataFrame:
    """The pillar scores and their composite."""
    return scoring.composite(scoring.pillar_scores(scored))
