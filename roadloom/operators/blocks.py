"""Articulation points and bridges of road graphs."""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadloom.functions.frames import stored
from roadloom.operators import network, paths

#: Pairs of a city whose search one task holds: Python's sets and lists of them take about 1 GB.
MOST_PAIRS = 1_000_000


def cut_vertices(lo: np.ndarray, hi: np.ndarray) -> tuple[set[int], set[tuple[int, int]]]:
    """(articulation points, bridges) of a simple graph, by lowlinks without recursion."""
    near: dict[int, list[int]] = {}
    for a, b in zip(lo.tolist(), hi.tolist()):
        near.setdefault(a, []).append(b)
        near.setdefault(b, []).append(a)
    seen: dict[int, int] = {}
    low: dict[int, int] = {}
    points, bridges = set(), set()
    for root in sorted(near):
        if root in seen:
            continue
        seen[root] = low[root] = len(seen)
        stack, kids = [(root, None, iter(near[root]))], 0
        while stack:
            k, parent, rest = stack[-1]
            for j in rest:
                if j == parent:
                    continue
                if j in seen:
                    low[k] = min(low[k], seen[j])
                    continue
                seen[j] = low[j] = len(seen)
                kids += k == root
                stack.append((j, k, iter(near[j])))
                break
            else:
                stack.pop()
                if parent is not None:
                    low[parent] = min(low[parent], low[k])
                    if low[k] > seen[parent]:
                        bridges.add((min(parent, k), max(parent, k)))
                    if parent != root and low[k] >= seen[parent]:
                        points.add(parent)
        if kids > 1:
            points.add(root)
    return points, bridges


WEAK = "city string, kind string, a bigint, b bigint"


def weak_points(pairs: DataFrame, most_pairs: int = MOST_PAIRS) -> DataFrame:
    """(city, kind, a, b): articulation points (b null) and bridges of each city's simple graph.

    If no city has more than most_pairs pairs (they are counted first), each city is searched in one task, otherwise all are
    searched by joins.
    """
    plain = stored(pairs.select("city", "lo", "hi").distinct())
    if not paths.fits(plain, most_pairs):
        return _joined_weak_points(plain)

    def run(own: pd.DataFrame) -> pd.DataFrame:
        points, bridges = cut_vertices(own["lo"].to_numpy(), own["hi"].to_numpy())
        city = own["city"].iloc[0]
        rows = [(city, "articulation", p, None) for p in sorted(points)] + [(city, "bridge", a, b) for a, b in sorted(bridges)]
        return pd.DataFrame(rows, columns=["city", "kind", "a", "b"]).astype({"b": "Int64"})

    return plain.groupBy("city").applyInPandas(run, WEAK)


def _joined_weak_points(pairs: DataFrame) -> DataFrame:
    """By the blocks of the graph: the tree edges on the cycle that any other edge closes over a breadth-first tree are in one
    block with it, and blocks that share a tree edge are one. A tree edge on no such cycle is a bridge, a node with tree edges
    of several blocks an articulation point. Every round is a join; rounds are as many as the tree is deep.

    A tree edge goes by its lower end, its child.
    """
    c = F.col
    nodes = stored(pairs.select("city", F.explode(F.array("lo", "hi")).alias("node_id")).distinct())
    roots = network.components(pairs, nodes).select("city", F.col("component").alias("node_id")).distinct()
    depth = stored(paths.hop_distances(pairs, roots, most_edges=0).select("city", F.col("target").alias("node"), "hops"))
    both = network.symmetric(pairs)
    at = lambda n, h: depth.select("city", c("node").alias(n), c("hops").alias(h))
    up = stored(both.join(at("a", "ha"), ["city", "a"]).join(at("b", "hb"), ["city", "b"]).filter("hb = ha - 1").groupBy("city", c("a").alias("node")).agg(F.min("b").alias("parent")))
    tree = up.select("city", F.least("node", "parent").alias("lo"), F.greatest("node", "parent").alias("hi"))
    climbing = pairs.join(tree, ["city", "lo", "hi"], "left_anti").join(at("lo", "dx"), ["city", "lo"]).join(at("hi", "dy"), ["city", "hi"]).select("city", "lo", "hi", c("lo").alias("x"), c("hi").alias("y"), "dx", "dy")
    climbing, covered = stored(climbing), []
    while not climbing.isEmpty():
        left, right = c("dx") >= c("dy"), c("dy") >= c("dx")
        step = F.explode(F.array_compact(F.array(F.when(left, c("x")), F.when(right, c("y"))))).alias("child")
        covered.append(stored(climbing.select("city", "lo", "hi", step)))
        over = lambda n, p: up.select("city", c("node").alias(n), c("parent").alias(p))
        moved = climbing.join(over("x", "px"), ["city", "x"], "left").join(over("y", "py"), ["city", "y"], "left")
        climbing = stored(moved.select("city", "lo", "hi", F.when(left, c("px")).otherwise(c("x")).alias("x"), F.when(right, c("py")).otherwise(c("y")).alias("y"), F.when(left, c("dx") - 1).otherwise(c("dx")).alias("dx"), F.when(right, c("dy") - 1).otherwise(c("dy")).alias("dy")).filter("x <> y"))
    cover = functools.reduce(DataFrame.unionByName, covered) if covered else pairs.select("city", "lo", "hi", c("lo").alias("child")).limit(0)
    first = cover.groupBy("city", "lo", "hi").agg(F.min("child").alias("first"))
    joined = cover.join(first, ["city", "lo", "hi"]).filter("child <> first").select("city", F.least("child", "first").alias("lo"), F.greatest("child", "first").alias("hi")).distinct()
    block = network.components(joined, up.select("city", c("node").alias("node_id"))).select("city", c("node_id").alias("node"), "component")
    ends = up.join(block, ["city", "node"]).select("city", F.explode(F.array("node", "parent")).alias("a"), "component")
    points = ends.groupBy("city", "a").agg(F.countDistinct("component").alias("n")).filter("n > 1").select("city", F.lit("articulation").alias("kind"), "a", F.lit(None).cast("bigint").alias("b"))
    alone = up.join(cover.select("city", c("child").alias("node")).distinct(), ["city", "node"], "left_anti")
    return points.unionByName(alone.select("city", F.lit("bridge").alias("kind"), F.least("node", "parent").alias("a"), F.greatest("node", "parent").alias("b")))
