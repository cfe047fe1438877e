"""Readers and writers: GeoJSON, OSM XML, GraphML, CSV, JSON and text, with reuse of what is there already."""

from __future__ import annotations

import functools
import operator
import os
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from roadloom.functions.frames import few, located

GEOJSON = "type string, features array<struct<type:string,properties:map<string,string>,geometry:struct<type:string,coordinates:string>>>"
OSM_NODE = "_id bigint, _lat double, _lon double, tag array<struct<_k:string,_v:string>>"
OSM_WAY = "_id bigint, nd array<struct<_ref:bigint>>, tag array<struct<_k:string,_v:string>>"
OSM_RELATION = "_id bigint, member array<struct<_type:string,_ref:bigint,_role:string>>, tag array<struct<_k:string,_v:string>>"
MOST_KEYS = MOST_CITIES = 10_000
_DATA = "array<struct<_key:string,_VALUE:string>>"


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    """One row per feature: properties as a map of texts, geometry as GeoJSON text (null where there is none)."""
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", GEOJSON).alias("c"))
    geometry = F.when(F.col("f.geometry.type").isNotNull(), F.concat(F.lit('{"type": "'), F.col("f.geometry.type"), F.lit('", "coordinates": '), F.col("f.geometry.coordinates"), F.lit("}")))
    return whole.select(F.posexplode("c.features").alias("feature_no", "f")).select("feature_no", F.col("f.properties").alias("properties"), geometry.alias("geometry"))


def feature(geometry_type: str, coordinates: Column, **properties: Column) -> Column:
    """One GeoJSON feature as text."""
    body = F.struct(F.lit("Feature").alias("type"), F.struct(*[v.alias(k) for k, v in properties.items()]).alias("properties"), F.struct(F.lit(geometry_type).alias("type"), coordinates.alias("coordinates")).alias("geometry"))
    return F.to_json(body)


def write_features(features: DataFrame, path: str) -> None:
    """Newline-delimited GeoJSON features (one per row, in as many files as there are partitions)."""
    features.select(F.col(features.columns[0]).alias("value")).write.mode("overwrite").text(path)


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """Features written by write_features(), one per line: properties as a map of texts, geometry as GeoJSON text. Any size."""
    kind = "properties map<string,string>, geometry struct<type:string,coordinates:string>"
    f = spark.read.text(path).select(F.from_json("value", kind).alias("f"))
    geometry = F.when(F.col("f.geometry.type").isNotNull(), F.concat(F.lit('{"type": "'), F.col("f.geometry.type"), F.lit('", "coordinates": '), F.col("f.geometry.coordinates"), F.lit("}")))
    return f.select(F.col("f.properties").alias("properties"), geometry.alias("geometry"))


def region_features(regions: DataFrame) -> DataFrame:
    """Features of regions (city, geometry as WKT); the texts are rewritten, not parsed."""
    body = F.regexp_replace("geometry", r"(-?[0-9][0-9.eE+-]*) (-?[0-9][0-9.eE+-]*)", "[$1, $2]")
    body = F.translate(F.regexp_replace(body, r"^[A-Z ]+", ""), "()", "[]")
    kind = F.when(F.startswith("geometry", F.lit("MULTI")), "MultiPolygon").otherwise("Polygon")
    return regions.filter("geometry is not null and geometry not like '%EMPTY'").select(F.concat(F.lit('{"type": "Feature", "properties": '), F.to_json(F.struct("city")), F.lit(', "geometry": {"type": "'), kind, F.lit('", "coordinates": '), body, F.lit("}}")).alias("value"))


def write_collection(features: DataFrame, path: str) -> None:
    """A single FeatureCollection file, for small results that other tools read."""
    one = features.select(F.collect_list(F.col(features.columns[0])).alias("f")).select(F.concat(F.lit('{"type": "FeatureCollection", "features": ['), F.array_join("f", ", "), F.lit("]}")).alias("value"))
    one.coalesce(1).write.mode("overwrite").text(path)


def point_features(nodes: DataFrame) -> DataFrame:
    return nodes.filter(located()).select(feature("Point", F.array("x", "y"), city=F.col("city"), node_id=F.col("node_id")).alias("value"))


def line_features(edges_with_ends: DataFrame) -> DataFrame:
    """Straight lines between the ends of edges; coincident or unknown ends have none."""
    ok = edges_with_ends.filter("ax is not null and ay is not null and bx is not null and by is not null and (ax <> bx or ay <> by)")
    return ok.select(feature("LineString", F.array(F.array("ax", "ay"), F.array("bx", "by")), city=F.col("city"), u=F.col("u"), v=F.col("v")).alias("value"))


def read_osm(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, ways, relations) of OSM XML files, which Spark splits by element."""
    rows = lambda tag, schema: spark.read.format("xml").option("rowTag", tag).schema(schema).load(path)
    return rows("node", OSM_NODE), rows("way", OSM_WAY), rows("relation", OSM_RELATION)


def write_osm(elements: DataFrame, path: str) -> None:
    """OSM XML files of elements (value: the text of a node, way or relation), one per partition, each complete by itself."""

    def framed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield pd.DataFrame({"value": ['<?xml version="1.0" encoding="UTF-8"?><osm version="0.6">']})
        yield from batches
        yield pd.DataFrame({"value": ["</osm>"]})

    elements.select("value").mapInPandas(framed, "value string").write.mode("overwrite").text(path)


def tag_value(tags: Column, key: str) -> Column:
    """Of array<struct<_k,_v>>: the value of the first tag of that key."""
    hit = F.filter(tags, lambda t: t["_k"] == key)
    return F.try_element_at(hit, F.lit(1))["_v"]


def tagged(elements: DataFrame, key: str, values: list[str] | None = None) -> DataFrame:
    """Elements with the tag (of one of the values)."""
    v = tag_value(F.col("tag"), key)
    return elements.filter(v.isin(values) if values else v.isNotNull())


def road_edges(ways: DataFrame, nodes: DataFrame, city: str) -> DataFrame:
    """Directed edges (city, u, v, edge_key, length, highway) of the ways tagged highway; one-way ways only in their direction."""
    roads = tagged(ways, "highway").select(F.col("_id").alias("way_id"), "nd", tag_value(F.col("tag"), "highway").alias("highway"), F.lower(F.coalesce(tag_value(F.col("tag"), "oneway"), F.lit("no"))).alias("oneway"))
    steps = roads.select("way_id", "highway", "oneway", F.explode(F.arrays_zip(F.slice("nd._ref", F.lit(1), F.size("nd") - 1).alias("u"), F.slice("nd._ref", F.lit(2), F.size("nd") - 1).alias("v"))).alias("s")).select("way_id", "highway", "oneway", "s.u", "s.v")
    back = steps.filter("oneway not in ('yes', 'true', '1')").select("way_id", "highway", "oneway", F.col("v").alias("u"), F.col("u").alias("v"))
    both = steps.filter("oneway <> '-1'").unionByName(back)
    at = lambda end, n: nodes.select(F.col("_id").alias(end), F.col("_lon").alias(f"{n}_lon"), F.col("_lat").alias(f"{n}_lat"))
    priced = both.join(at("u", "a"), "u").join(at("v", "b"), "v")
    h = F.pow(F.sin(F.radians(F.col("b_lat") - F.col("a_lat")) / 2), 2) + F.cos(F.radians("a_lat")) * F.cos(F.radians("b_lat")) * F.pow(F.sin(F.radians(F.col("b_lon") - F.col("a_lon")) / 2), 2)
    length = 2 * 6371000.0 * F.asin(F.sqrt(h))
    return priced.select(F.lit(city).alias("city"), "u", "v", F.lit(0).alias("edge_key"), length.alias("length"), "highway", "way_id")


def read_graphml(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) with their data as maps from attribute name to text."""
    load = lambda tag, schema: spark.read.format("xml").option("rowTag", tag).schema(schema).load(path)
    keys = load("key", "_id string, `_attr.name` string, _for string").select(F.col("_id").alias("k"), F.col("`_attr.name`").alias("name"))
    held = keys.limit(MOST_KEYS + 1).collect()  # one row per attribute of the format
    if len(held) > MOST_KEYS:
        raise ValueError(f"more than {MOST_KEYS} attributes are declared: no GraphML of a road network")
    names = {r.k: r.name for r in held}
    pairs = [x for k, v in names.items() for x in (F.lit(k), F.lit(v))]
    named = (lambda c: F.create_map(*pairs)[c]) if pairs else (lambda c: c)
    data = F.map_from_entries(F.transform("data", lambda d: F.struct(F.coalesce(named(d["_key"]), d["_key"]).alias("key"), d["_VALUE"].alias("value"))))
    nodes = load("node", f"_id bigint, data {_DATA}").select(F.col("_id").alias("node_id"), data.alias("data"))
    edges = load("edge", f"_source bigint, _target bigint, data {_DATA}").select(F.col("_source").alias("u"), F.col("_target").alias("v"), data.alias("data"))
    return nodes, edges


def graph_tables(nodes: DataFrame, edges: DataFrame, city: str) -> tuple[DataFrame, DataFrame]:
    """Typed node and edge tables of read_graphml()."""
    n = nodes.select(F.lit(city).alias("city"), "node_id", F.col("data")["x"].try_cast("double").alias("x"), F.col("data")["y"].try_cast("double").alias("y"))
    e = edges.select(F.lit(city).alias("city"), "u", "v", F.coalesce(F.col("data")["key"].try_cast("int"), F.lit(0)).alias("edge_key"), F.col("data")["length"].try_cast("double").alias("length"), F.col("data")["highway"].alias("highway"))
    return n, e


def write_graphml(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """GraphML files, one per city (in folders city=...), written in parallel: nodes first, then edges."""
    safe = lambda c: F.replace(F.replace(F.replace(c.cast("string"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    cell = lambda k, c: F.when(c.isNotNull(), F.concat(F.lit(f'<data key="{k}">'), safe(c), F.lit("</data>"))).otherwise("")
    n = nodes.select("city", F.lit(1).alias("o"), F.concat(F.lit('<node id="'), F.col("node_id"), F.lit('">'), cell("x", F.col("x")), cell("y", F.col("y")), F.lit("</node>")).alias("value"))
    e = edges.select("city", F.lit(2).alias("o"), F.concat(F.lit('<edge source="'), F.col("u"), F.lit('" target="'), F.col("v"), F.lit('">'), cell("key", F.col("edge_key")), cell("length", F.col("length")), cell("highway", F.col("highway")), F.lit("</edge>")).alias("value"))
    head = '<?xml version="1.0" encoding="UTF-8"?><graphml xmlns="http://graphml.graphdrawing.org/xmlns">' + "".join(f'<key id="{k}" for="{f}" attr.name="{k}" attr.type="string"/>' for k, f in (("x", "node"), ("y", "node"), ("key", "edge"), ("length", "edge"), ("highway", "edge"))) + '<graph edgedefault="directed">'
    frame = F.explode(F.array(F.struct(F.lit(0).alias("o"), F.lit(head).alias("value")), F.struct(F.lit(3).alias("o"), F.lit("</graph></graphml>").alias("value")))).alias("f")
    ends = n.select("city").union(e.select("city")).distinct().select("city", frame).select("city", "f.o", "f.value")
    n.unionByName(e).unionByName(ends).repartition("city").sortWithinPartitions("city", "o").select("city", "value").write.mode("overwrite").partitionBy("city").text(path)


def read_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """CSV with a header; outer blanks and byte-order marks of the header don't count. With a schema, columns are cast to it by name."""
    df = spark.read.csv(path, header=True)
    df = df.toDF(*[c.strip().lstrip("﻿").strip() for c in df.columns])
    if schema is None:
        return df
    wanted = [f.strip().rsplit(" ", 1) for f in schema.split(",")]
    return df.select(*[F.trim(F.col(f"`{n}`")).try_cast(t).alias(n) for n, t in wanted])


def write_csv(df: DataFrame, path: str, single: bool = True) -> None:
    """CSV with a header; nulls are empty cells. single: one file, for small reports."""
    (df.coalesce(1) if single else df).write.mode("overwrite").csv(path, header=True)


def write_json(df: DataFrame, path: str) -> None:
    df.coalesce(1).write.mode("overwrite").json(path)


def write_text(df: DataFrame, path: str, column: str) -> None:
    df.coalesce(1).select(F.col(column).alias("value")).write.mode("overwrite").text(path)


def finished(spark: SparkSession, path: str) -> bool:
    """A table was written at path to its end."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(spark._jvm.org.apache.hadoop.fs.Path(os.path.join(path, "_SUCCESS")))


def reused(spark: SparkSession, path: str, make: Callable[[], DataFrame], force: bool = False) -> DataFrame:
    """The finished table at path, made first if it isn't there (or anew with force)."""
    if force or not finished(spark, path):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def known_cities(nodes: DataFrame) -> list[str]:
    """The cities there are. ValueError beyond MOST_CITIES: name them then."""
    rows = nodes.filter("city is not null").select("city").distinct().limit(MOST_CITIES + 1).collect()
    if len(rows) > MOST_CITIES:
        raise ValueError(f"more than {MOST_CITIES} cities: name those to run")
    return sorted(r.city for r in rows)


def preflight(nodes: DataFrame, edges: DataFrame, extents: DataFrame, cities: list[str]) -> list[str]:
    """All that would spoil a full run, none of it hiding another: cities without nodes, edges or an extent, and cities none of
    whose nodes has a position or none of whose edges a length."""
    problems = []
    checks = {"nodes": (nodes, ("x", "y"), "no node with a position"), "edges": (edges, ("length",), "no edge with a length"), "extent": (extents, (), "")}
    for what, (df, needed, empty) in checks.items():
        usable = functools.reduce(operator.and_, [F.col(c).isNotNull() & ~F.isnan(c) for c in needed if c in df.columns], F.lit(True))
        have = {r.city: r.n for r in few(df.filter(F.col("city").isin(cities)).groupBy("city").agg(F.count_if(usable).alias("n")))}
        problems += [f"{c}: no {what}" if c not in have else f"{c}: {empty}" for c in cities if not have.get(c)]
    return problems
