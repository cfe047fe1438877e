"""Points near other points, and points in regions.

near(): a grid of cells twice the distance wide; a point is at home in its cell and a guest in those cells to the
right and above that it could reach, so each pair meets in exactly one cell of one equi-join, all inside the JVM.

in_regions(): every polygon is triangulated by ear clipping and the triangles are laid out in blocks along a space-filling
curve. A hierarchy over the blocks' boxes (whose number is bounded whatever the input) names the blocks that may hold a
point; block by block, a hierarchy over its triangles names the candidates, which are tested exactly. A region that holds a
point by several triangles (a shared border) counts once. There is one way for every size.

Defined results:
* points with null or NaN coordinates don't count; rows that repeat an id at one place count once;
* one id at several places is near another id if any of its places is;
* distances compare inclusively, with 1e-8 m for the rounding of decimal coordinates to doubles;
* points on a region's border, a hole's border included, are in it;
* null, empty, unreadable and non-areal geometries hold nothing; parts whose rings cross count by the even-odd rule;
* null groups (cities) match nothing; empty frames give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadloom.functions.frames import located, spread, stored
from roadloom.functions.polygons import Boxes, Hierarchy, region_triangles

SLACK = 1e-8


def _rows(points: DataFrame, point_id: str, group: str, x: str, y: str) -> DataFrame:
    return points.select(F.col(group).alias("grp"), F.col(point_id).cast("bigint").alias("pid"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).filter(located() & F.col("grp").isNotNull() & F.col("pid").isNotNull())


def places(points: DataFrame, point_id: str = "node_id", group: str = "city", x: str = "x", y: str = "y") -> DataFrame:
    """Distinct located (group, id, x, y)."""
    return _rows(points, point_id, group, x, y).distinct()


def near(points: DataFrame, distance: float, point_id: str = "node_id", group: str = "city", x: str = "x", y: str = "y") -> DataFrame:
    """(id_a, id_b), id_a < id_b, of the ids of one group at most `distance` apart."""
    if not distance >= 0:
        raise ValueError("distance must be 0 or more")
    width = 2.0 * max(distance, 1e-6)
    reach = width / 2 + SLACK
    p = places(points, point_id, group, x, y).select("grp", "pid", "x", "y", F.floor(F.col("x") / width).alias("cx"), F.floor(F.col("y") / width).alias("cy"))
    right, left, up = (F.col("cx") + 1) * width - F.col("x") <= reach, F.col("x") - F.col("cx") * width <= reach, (F.col("cy") + 1) * width - F.col("y") <= reach
    cell = lambda dx, dy, when: F.when(when, F.struct((F.col("cx") + dx).alias("cx"), (F.col("cy") + dy).alias("cy"), F.lit(dx != 0 or dy != 0).alias("guest")))
    guests = p.select("grp", "pid", "x", "y", F.explode(F.array_compact(F.array(cell(0, 0, F.lit(True)), cell(1, 0, right), cell(0, 1, up), cell(1, 1, right & up), cell(-1, 1, left & up)))).alias("c")).select("grp", "c.cx", "c.cy", F.col("c.guest").alias("guest"), F.col("pid").alias("pid_b"), F.col("x").alias("xb"), F.col("y").alias("yb"))
    close = (F.col("x") - F.col("xb")) * (F.col("x") - F.col("xb")) + (F.col("y") - F.col("yb")) * (F.col("y") - F.col("yb")) <= (distance + SLACK) ** 2
    meet = p.join(guests, ["grp", "cx", "cy"]).filter((F.col("guest") | (F.col("pid") < F.col("pid_b"))) & (F.col("pid") != F.col("pid_b")) & close)
    return meet.select(F.least("pid", "pid_b").alias("id_a"), F.greatest("pid", "pid_b").alias("id_b")).distinct()


TRIANGLE = "region_id bigint, grp string, x0 double, y0 double, x1 double, y1 double, x2 double, y2 double"


def triangles(regions: DataFrame, region_id: str = "region_id", group: str = "city", geometry: str = "geometry") -> DataFrame:
    """One row per triangle of every region."""
    rows = regions.select(F.col(region_id).cast("bigint").alias("r"), F.col(group).cast("string").alias("g"), F.col(geometry).cast("string").alias("t")).filter("r is not null and g is not null and t is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["region_id", "grp", "x0", "y0", "x1", "y1", "x2", "y2"]
        for batch in batches:
            for r, g, t in zip(*(batch.column(k).to_pylist() for k in range(3))):
                flat = region_triangles(t).reshape(-1, 6)
                yield pa.RecordBatch.from_arrays([pa.array([r] * len(flat), pa.int64()), pa.array([g] * len(flat), pa.string()), *(pa.array(flat[:, k], pa.float64()) for k in range(6))], names=names)

    return rows.mapInArrow(run, TRIANGLE)


#: Triangles of a block, and the most blocks there are: beyond their product blocks grow instead, so that the hierarchy over
#: blocks (40 bytes each) stays within 1 MB. Points that one task tests against a block.
BLOCK, MOST_BLOCKS, MOST_POINTS = 4096, 16_384, 200_000


def _curve(c: Column, least: Column, most: Column) -> Column:
    """c as 16 bits within its range, spread out to every second bit."""
    v = F.floor(F.when(most > least, (c - least) / (most - least)).otherwise(0.0) * 65535).cast("bigint")
    for shift, mask in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
        v = v.bitwiseOR(F.shiftleft(v, shift)).bitwiseAND(F.lit(mask))
    return v


def blocks(t: DataFrame, block: int = BLOCK, most_blocks: int = MOST_BLOCKS) -> DataFrame:
    """triangles() with the block of each, stored: runs of about `block` triangles by group and place along a Morton curve."""
    t = stored(t)
    n = min(most_blocks, max(1, -(-t.count() // block)))
    size = t.groupBy("grp").agg(F.min("x0").alias("ax"), F.max("x0").alias("bx"), F.min("y0").alias("ay"), F.max("y0").alias("by"))
    code = _curve(F.col("x0"), F.col("ax"), F.col("bx")).bitwiseOR(F.shiftleft(_curve(F.col("y0"), F.col("ay"), F.col("by")), 1))
    placed = t.join(size, "grp").select(*t.columns, code.alias("z"))
    return stored(placed.repartitionByRange(n, "grp", "z", "region_id", "x1", "y1").withColumn("block", F.spark_partition_id()).drop("z"))


def in_regions(points: DataFrame, regions: DataFrame, point_id: str = "node_id", region_id: str = "region_id", group: str = "city", x: str = "x", y: str = "y", geometry: str = "geometry", block: int = BLOCK, most_points: int = MOST_POINTS) -> DataFrame:
    """(region_id, point_id) of the points within the regions of their group."""
    p = places(points, point_id, group, x, y).select(F.col("grp").cast("string").alias("grp"), "pid", "x", "y")
    t = blocks(triangles(regions, region_id, group, geometry), block)
    low, high = lambda v: F.min(F.least(*[f"{v}{k}" for k in range(3)])), lambda v: F.max(F.greatest(*[f"{v}{k}" for k in range(3)]))
    boxes = t.groupBy("block").agg(F.min("grp").alias("g0"), F.max("grp").alias("g1"), low("x").alias("lx"), low("y").alias("ly"), high("x").alias("hx"), high("y").alias("hy")).limit(MOST_BLOCKS + 1).toPandas()
    if len(boxes) > MOST_BLOCKS:
        raise ValueError("more blocks of triangles than the hierarchy over them may hold")
    shared = p.sparkSession.sparkContext.broadcast(boxes)
    asked = candidates_by_block(p, shared)
    raw = candidates_by_block(_rows(points, point_id, group, x, y).select(F.col("grp").cast("string").alias("grp"), "pid", "x", "y"), shared)  # with repeats: enough for a bound
    load = F.broadcast(stored(raw.groupBy("block").agg(F.ceil(F.count("*") / most_points).cast("int").alias("parts"))))  # a row per block, so at most MOST_BLOCKS
    place = F.pmod(F.xxhash64("pid", "x", "y"), F.col("parts")).cast("int").alias("part")
    a = asked.join(load, "block").select("block", place, "grp", "pid", "x", "y")
    b = t.join(load, "block").select("*", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")).drop("parts")

    def run(asked: pa.Table, held: pa.Table) -> pa.Table:
        out: list[np.ndarray] = [np.empty((2, 0), dtype=np.int64)]
        if asked.num_rows and held.num_rows:
            groups, own = (np.asarray(v.column("grp").to_pylist(), dtype=object) for v in (asked, held))
            ids, xs, ys = (asked.column(c).to_numpy() for c in ("pid", "x", "y"))
            regions, corners = held.column("region_id").to_numpy(), np.stack([held.column(f"{v}{k}").to_numpy() for k in range(3) for v in "xy"], axis=1).reshape(-1, 3, 2)
            for g in dict.fromkeys(own.tolist()):
                mine, theirs = np.flatnonzero(groups == g), np.flatnonzero(own == g)
                point, triangle = Hierarchy(corners[theirs]).hits(xs[mine], ys[mine])
                out.append(np.unique(np.stack([regions[theirs][triangle], ids[mine][point]]), axis=1))
        pairs = np.concatenate(out, axis=1)
        return pa.table({"region_id": pa.array(pairs[0]), "point_id": pa.array(pairs[1])})

    return a.groupBy("block", "part").cogroup(b.groupBy("block", "part")).applyInArrow(run, "region_id bigint, point_id bigint").distinct()


def candidates_by_block(p: DataFrame, shared) -> DataFrame:  # noqa: ANN001
    """(block, grp, pid, x, y) of the points (grp, pid, x, y) and the blocks whose group range and box hold them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        boxes = shared.value
        number, g0, g1 = boxes["block"].to_numpy(), boxes["g0"].to_numpy(dtype=object), boxes["g1"].to_numpy(dtype=object)
        trees: dict[str, tuple[np.ndarray, Boxes]] = {}
        for batch in batches:
            groups = np.asarray(batch.column(0).to_pylist(), dtype=object)
            xs, ys = (batch.column(k).to_numpy() for k in (2, 3))
            point, block = [np.empty(0, dtype=np.int64)], [np.empty(0, dtype=np.int64)]
            for g in dict.fromkeys(groups.tolist()):
                if g not in trees:
                    if len(trees) >= 1000:
                        trees.clear()
                    near = np.flatnonzero((g0 <= g) & (g1 >= g)) if len(boxes) else np.empty(0, dtype=np.int64)
                    trees[g] = near, Boxes(boxes[["lx", "ly"]].to_numpy(float)[near], boxes[["hx", "hy"]].to_numpy(float)[near])
                near, tree = trees[g]
                own = np.flatnonzero(groups == g)
                a, b = tree.candidates(xs[own], ys[own])
                point.append(own[a])
                block.append(number[near[b]].astype(np.int64))
            at = pa.array(np.concatenate(point))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(block).astype(np.int32)), *(batch.column(k).take(at) for k in range(4))], names=["block", "grp", "pid", "x", "y"])

    return p.mapInArrow(run, "block int, grp string, pid bigint, x double, y double")


def found(nodes: DataFrame, regions: DataFrame, distance: float = 10.0) -> DataFrame:
    """kind, id_a, id_b: the near pairs and the (region, node) pairs."""
    close = near(nodes, distance).select(F.lit("near").alias("kind"), "id_a", "id_b")
    held = in_regions(spread(nodes), regions).select(F.lit("in").alias("kind"), F.col("region_id").alias("id_a"), F.col("point_id").alias("id_b"))
    return close.unionByName(held)
