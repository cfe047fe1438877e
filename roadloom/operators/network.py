"""Road graphs as node and edge tables, every operator keyed by city.

nodes: city, node_id, x, y (null where unknown). edges: city, u, v, edge_key, length, highway.
The canonical order of nodes is their id, the canonical id of a component its smallest node id.
Nothing is gathered on the driver; loops cut their lineage by checkpoint().
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roadloom.functions.frames import located, stored


def clean_nodes(raw: DataFrame) -> DataFrame:
    """One row per (city, node): repeated deliveries collapse, NaN coordinates are unknown."""
    known = lambda c: F.min(F.when(~F.isnan(c), F.col(c))).alias(c)
    return raw.filter("city is not null and node_id is not null").groupBy("city", "node_id").agg(known("x"), known("y"))


def clean_edges(raw: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row per (city, u, v, edge_key), the one loaded last; a missing city is that of the start node; no self-loops.

    length is null where it is missing, NaN, zero or negative.
    """
    home = nodes.select(F.col("city").alias("home"), F.col("node_id").alias("u"))
    lost = raw.filter("city is null").join(home, "u").select("edge_id", F.col("home").alias("city"), "u", "v", "edge_key", "length", "highway", "loaded_at")
    kept = raw.filter("city is not null").select(*lost.columns)
    good = F.when((F.col("length") > 0) & ~F.isnan("length"), F.col("length")).alias("length")
    last = F.max_by(F.struct(good, "highway", "edge_id"), F.struct("loaded_at", "edge_id")).alias("last")
    return kept.unionByName(lost).filter("u <> v").groupBy("city", "u", "v", "edge_key").agg(last).select("city", "u", "v", "edge_key", "last.length", "last.highway", "last.edge_id")


def undirected(edges: DataFrame) -> DataFrame:
    """The undirected multigraph: of each unordered pair all parallel edges of one direction stay, from the smaller id if there are any.

    Adds lo, hi; the direction is decided per pair, so a hub's many pairs spread over all tasks.
    """
    pair = edges.withColumn("lo", F.least("u", "v")).withColumn("hi", F.greatest("u", "v")).withColumn("back", (F.col("u") > F.col("v")).cast("int"))
    first = F.min("back").over(Window.partitionBy("city", "lo", "hi"))
    return pair.withColumn("first", first).filter("back = first").drop("first", "back")


def simple_graph(multigraph: DataFrame, missing: float | None = 1.0) -> DataFrame:
    """One edge per pair, of the smallest length (then the smallest edge_id, whose class it keeps).

    missing: the length of edges without one; None leaves those edges out.
    """
    length = F.coalesce("length", F.lit(missing)) if missing is not None else F.col("length")
    priced = multigraph.withColumn("length", length).filter("length is not null")
    best = F.min(F.struct("length", "edge_id", "highway")).alias("best")
    return priced.groupBy("city", "lo", "hi").agg(best).select("city", "lo", "hi", "best.length", "best.highway")


def symmetric(pairs: DataFrame, *carried: str) -> DataFrame:
    """Both directions of every pair as (city, a, b)."""
    return pairs.select("city", F.col("lo").alias("a"), F.col("hi").alias("b"), *carried).union(pairs.select("city", F.col("hi").alias("a"), F.col("lo").alias("b"), *carried))


def degrees(multigraph: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """Incident edges of each node, parallel ones counted each; with nodes, those without edges have 0."""
    ends = multigraph.select("city", F.explode(F.array("lo", "hi")).alias("node_id")).groupBy("city", "node_id").agg(F.count("*").alias("degree"))
    return ends if nodes is None else nodes.select("city", "node_id").join(ends, ["city", "node_id"], "left").na.fill(0, ["degree"])


def joined_labels(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids, smallest id of the component of each), over the ids that occur."""
    ids = np.unique(np.concatenate([lo, hi]))
    a, b = np.searchsorted(ids, lo), np.searchsorted(ids, hi)
    top = np.arange(len(ids))
    while True:
        ra, rb = top[a], top[b]
        apart = ra != rb
        if not apart.any():
            return ids, ids[top]
        a, b = a[apart], b[apart]
        np.minimum.at(top, np.maximum(ra, rb)[apart], np.minimum(ra, rb)[apart])
        while True:
            up = top[top]
            if (up == top).all():
                break
            top = up


#: Pairs of one group that one task may hold: three columns of numbers, some 200 MB with their copies.
MOST_PAIRS = 5_000_000


def components(pairs: DataFrame, nodes: DataFrame, most_rounds: int = 64, most_pairs: int = MOST_PAIRS) -> DataFrame:
    """(city, node_id, component): connected components.

    If no city has more than most_pairs pairs (they are counted first), each city's pairs are joined in one task. Otherwise
    labels hook and jump over the whole table: each round hooks a node and its label's owner to the smallest label around it
    and then follows the labels one step, which takes a number of rounds logarithmic in the diameter. Labels are stored
    after each round.
    """
    pairs = stored(pairs.select("city", "lo", "hi"))
    most = pairs.groupBy("city").count().agg(F.max("count")).first()[0] or 0
    if most <= most_pairs:

        def join(own: pa.Table) -> pa.Table:
            ids, top = joined_labels(own.column("lo").to_numpy(), own.column("hi").to_numpy())
            return pa.table({"city": pa.array([own.column("city")[0].as_py()] * len(ids), pa.string()), "node_id": pa.array(ids, pa.int64()), "component": pa.array(top, pa.int64())})

        found = pairs.select(F.col("city").cast("string"), "lo", "hi").groupBy("city").applyInArrow(join, "city string, node_id bigint, component bigint")
        return nodes.select("city", "node_id").join(found, ["city", "node_id"], "left").select("city", "node_id", F.coalesce("component", "node_id").alias("component"))
    both = stored(symmetric(pairs.distinct()))
    labels = nodes.select("city", "node_id", F.col("node_id").alias("label"))
    near = both.groupBy("city", "a").agg(F.min("b").alias("m"))
    labels = stored(labels.join(near, [labels.city == near.city, labels.node_id == near.a], "left").select(labels.city, "node_id", F.least("label", "m").alias("label")))
    for _ in range(most_rounds):
        la, lb = labels.select("city", F.col("node_id").alias("a"), F.col("label").alias("la")), labels.select("city", F.col("node_id").alias("b"), F.col("label").alias("lb"))
        seen = both.join(la, ["city", "a"]).join(lb, ["city", "b"]).filter("la <> lb")
        hooks = seen.filter("lb < la").select("city", F.explode(F.array("a", "la")).alias("node_id"), "lb").groupBy("city", "node_id").agg(F.min("lb").alias("m"))
        hooked = labels.join(hooks, ["city", "node_id"], "left").select("city", "node_id", F.least("label", "m").alias("label"), F.col("m").isNotNull().alias("moved"))
        hooked = stored(hooked)
        owner = hooked.select("city", F.col("node_id").alias("label"), F.col("label").alias("above"))
        labels = stored(hooked.join(owner, ["city", "label"]).select("city", "node_id", F.col("above").alias("label")))
        if hooked.filter("moved").isEmpty():
            break
    else:
        raise RuntimeError(f"the labels still move after {most_rounds} rounds")
    # every label now is constant within a component; chains of labels are followed to their end
    while True:
        owner = labels.select("city", F.col("node_id").alias("label"), F.col("label").alias("above"))
        up = labels.join(owner, ["city", "label"])
        if up.filter("above <> label").isEmpty():
            return labels.select("city", "node_id", F.col("label").alias("component"))
        labels = stored(up.select("city", "node_id", F.col("above").alias("label")))


def component_sizes(labels: DataFrame) -> DataFrame:
    return labels.groupBy("city", "component").agg(F.count("*").alias("n_nodes"))


def largest(labels: DataFrame) -> DataFrame:
    """(city, component, n_nodes) of the component of most nodes; of equal ones that of the smallest id."""
    return component_sizes(labels).groupBy("city").agg(F.min_by(F.struct("component", "n_nodes"), F.struct(-F.col("n_nodes"), "component")).alias("c")).select("city", "c.component", "c.n_nodes")


def within_largest(labels: DataFrame) -> DataFrame:
    """(city, node_id) of the largest component's nodes."""
    best = largest(labels).select("city", "component")  # a row per city; whether to send it to all is left to its measured size
    return labels.join(best, ["city", "component"], "left_semi").select("city", "node_id")


def induced(multigraph: DataFrame, members: DataFrame) -> DataFrame:
    """Edges whose lower end (hence both, for a component) is among the members."""
    return multigraph.join(members.select("city", F.col("node_id").alias("lo")), ["city", "lo"], "left_semi")


def truncated(edges: DataFrame, inside: DataFrame) -> DataFrame:
    """Edges with at least one end inside: outside nodes next to an inside node stay."""
    mark = inside.select("city", "node_id").distinct()
    u = edges.join(mark.select("city", F.col("node_id").alias("u"), F.lit(True).alias("in_u")), ["city", "u"], "left")
    both = u.join(mark.select("city", F.col("node_id").alias("v"), F.lit(True).alias("in_v")), ["city", "v"], "left")
    return both.filter("in_u or in_v").drop("in_u", "in_v")


def with_ends(edges: DataFrame, nodes: DataFrame, a: str = "u", b: str = "v") -> DataFrame:
    """Edges with the coordinates of both ends (ax, ay, bx, by)."""
    first = nodes.select("city", F.col("node_id").alias(a), F.col("x").alias("ax"), F.col("y").alias("ay"))
    second = nodes.select("city", F.col("node_id").alias(b), F.col("x").alias("bx"), F.col("y").alias("by"))
    return edges.join(first, ["city", a], "left").join(second, ["city", b], "left")


def simplified(pairs: DataFrame, nodes: DataFrame, most_rounds: int = 64) -> DataFrame:
    """Chains of nodes with exactly two neighbours merged into single edges (city, lo, hi, length, n_segments).

    Every chain gets a label by components() over its inner nodes alone, so chains of any length take few rounds. A ring
    without an end stays as one loop at its smallest node. Missing lengths count 0 in the sum.
    """
    both = symmetric(pairs.select("city", "lo", "hi").distinct())
    around = both.groupBy("city", "a").agg(F.countDistinct("b").alias("n"))
    inner = stored(around.filter("n = 2").select("city", F.col("a").alias("node_id")))
    lo_in = inner.select("city", F.col("node_id").alias("lo"), F.lit(True).alias("lo_in"))
    hi_in = inner.select("city", F.col("node_id").alias("hi"), F.lit(True).alias("hi_in"))
    marked = pairs.join(lo_in, ["city", "lo"], "left").join(hi_in, ["city", "hi"], "left").na.fill(False, ["lo_in", "hi_in"])
    chains = components(marked.filter("lo_in and hi_in"), inner, most_rounds)
    part = chains.select("city", F.col("node_id").alias("lo"), F.col("component").alias("c_lo")), chains.select("city", F.col("node_id").alias("hi"), F.col("component").alias("c_hi"))
    owned = marked.join(part[0], ["city", "lo"], "left").join(part[1], ["city", "hi"], "left")
    chain = F.coalesce("c_lo", "c_hi")
    merged = owned.filter("lo_in or hi_in").withColumn("chain", chain)
    ends = F.array_compact(F.array(F.when(~F.col("lo_in"), F.col("lo")), F.when(~F.col("hi_in"), F.col("hi"))))
    whole = merged.groupBy("city", "chain").agg(F.array_sort(F.flatten(F.collect_list(ends))).alias("ends"), F.sum(F.coalesce("length", F.lit(0.0))).alias("length"), F.count("*").alias("n_segments"))
    first, last = F.when(F.size("ends") > 0, F.col("ends")[0]).otherwise(F.col("chain")), F.when(F.size("ends") > 1, F.col("ends")[1]).otherwise(F.when(F.size("ends") > 0, F.col("ends")[0]).otherwise(F.col("chain")))
    chained = whole.select("city", first.alias("lo"), last.alias("hi"), "length", F.col("n_segments"))
    plain = owned.filter("not lo_in and not hi_in").select("city", "lo", "hi", "length", F.lit(1).cast("bigint").alias("n_segments"))
    return plain.unionByName(chained)


def simplified_directed(edges: DataFrame) -> DataFrame:
    """(city, u, v, length, n_segments): directed chains merged into single edges, one-way streets kept one-way.

    A node goes if it has exactly two neighbours and is passed through in one direction (an edge in, an edge out) or in both
    (two and two). The edges of a chain in one direction are labelled as a component of a graph whose nodes are the edges, so
    chains of any length take few rounds. Of parallel edges the shortest counts. A ring without an end stays as one loop at
    its smallest node. Missing lengths count 0 in the sum.
    """
    one = stored(edges.groupBy("city", "u", "v").agg(F.min("length").alias("length")).withColumn("node_id", F.monotonically_increasing_id()))
    ends = one.select("city", F.col("u").alias("n"), F.col("v").alias("m"), F.lit(1).alias("out")).unionByName(one.select("city", F.col("v").alias("n"), F.col("u").alias("m"), F.lit(0).alias("out")))
    around = ends.groupBy("city", "n").agg(F.countDistinct("m").alias("near"), F.sum("out").alias("leave"), F.sum(1 - F.col("out")).alias("come"))
    inner = around.filter("near = 2 and leave = come and leave in (1, 2)").select("city", "n")
    come = one.join(inner.withColumnRenamed("n", "v"), ["city", "v"], "left_semi").select("city", F.col("v").alias("at"), F.col("u").alias("before"), F.col("node_id").alias("lo"))
    leave = one.select("city", F.col("u").alias("at"), F.col("v").alias("after"), F.col("node_id").alias("hi"))
    steps = come.join(leave, ["city", "at"]).filter("before <> after").select("city", "lo", "hi")
    label = components(steps, one.select("city", "node_id"))
    mark = lambda end: inner.select("city", F.col("n").alias(end), F.lit(True).alias(f"{end}_in"))
    owned = one.join(mark("u"), ["city", "u"], "left").join(mark("v"), ["city", "v"], "left").join(label, ["city", "node_id"])
    first, last = F.max(F.when(F.col("u_in").isNull(), F.col("u"))), F.max(F.when(F.col("v_in").isNull(), F.col("v")))
    whole = owned.groupBy("city", "component").agg(first.alias("first"), last.alias("last"), F.min("u").alias("least"), F.sum(F.coalesce("length", F.lit(0.0))).alias("length"), F.count("*").alias("n_segments"))
    return whole.select("city", F.coalesce("first", "least").alias("u"), F.coalesce("last", "least").alias("v"), "length", "n_segments")


def problems(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(city, problem, n) of what would spoil a run, however many kinds there are: nodes without a position, edges without a
    length, edges with an unknown end, cities without edges."""
    place = nodes.filter(~located()).groupBy("city").agg(F.count("*").alias("n")).select("city", F.lit("nodes without a position").alias("problem"), "n")
    length = edges.filter("length is null").groupBy("city").agg(F.count("*").alias("n")).select("city", F.lit("edges without a length").alias("problem"), "n")
    known = nodes.select("city", "node_id", F.lit(True).alias("there"))
    ends = edges.select("city", "edge_id", F.explode(F.array("u", "v")).alias("node_id")).join(known, ["city", "node_id"], "left")
    lost = ends.filter("there is null").groupBy("city").agg(F.countDistinct("edge_id").alias("n")).select("city", F.lit("edges with an unknown end").alias("problem"), "n")
    none = nodes.select("city").distinct().join(edges.select("city").distinct(), "city", "left_anti").select("city", F.lit("no edges").alias("problem"), F.lit(1).cast("bigint").alias("n"))
    return place.unionByName(length).unionByName(lost).unionByName(none)


def summary(edges: DataFrame, multigraph: DataFrame, nodes: DataFrame, labels: DataFrame) -> DataFrame:
    """Per city: nodes, directed edges, links, components, degrees and total length."""
    n = nodes.groupBy("city").agg(F.count("*").alias("number_of_nodes"))
    e = edges.groupBy("city").agg(F.count("*").alias("number_of_edges"), F.sum("length").alias("total_road_length_m"))
    m = multigraph.groupBy("city").agg(F.count("*").alias("number_of_links"))
    c = labels.groupBy("city").agg(F.countDistinct("component").alias("connected_components"))
    out = n.join(e, "city", "left").join(m, "city", "left").join(c, "city", "left").na.fill(0, ["number_of_edges", "number_of_links"])
    return out.withColumn("average_node_degree", 2 * F.col("number_of_links") / F.col("number_of_nodes")).withColumn("total_road_length_km", F.col("total_road_length_m") / 1000)
