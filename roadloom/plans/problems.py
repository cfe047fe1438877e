"""Queries over the record-cleaning operators of the core: nested records, neighbourhoods, packed fields, drifting files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadloom.functions.frames import spread, table
from roadloom.operators import drift, multivalue, shred, spatial

NEAR_M = 10.0


def class_names(spark: SparkSession, sf_dir: str) -> list[str]:
    """The reference list of whole values; a fixed table of a few dozen rows (more than 100,000 are refused)."""
    rows = table(spark, sf_dir, "highway_classes", "highway", "label").limit(100_001).collect()
    if len(rows) > 100_000:
        raise ValueError("the reference list is too long for an automaton in every worker")
    return sorted({v for r in rows for v in (r.highway, r.label) if v})


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shred.element_children(table(spark, sf_dir, "osm_xml", "extract_id", "payload"))


def p1_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shred.elements(table(spark, sf_dir, "osm_xml", "extract_id", "payload")).withColumn("attributes", F.to_json("attributes"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.found(table(spark, sf_dir, "nodes", "node_id", "city", "x", "y"), table(spark, sf_dir, "city_extents", "region_id", "city", "geometry"), NEAR_M)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = table(spark, sf_dir, "edges", "edge_id", "highway")
    return multivalue.explode_values(edges, "highway", class_names(spark, sf_dir), keep=["edge_id"], least=2, value_name="highway_value")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift.schema_changes(table(spark, sf_dir, "score_files", "series_id", "dataset", "run_no", "content"))


def p5_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "score_files", "series_id", "dataset", "run_no", "content")
    out = drift.fused_schema(files)
    return out.withColumn("headers", F.array_join("headers", "; "))


def p5_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "score_files", "series_id", "dataset", "run_no", "content")
    return drift.consistent_table(files).withColumn("fields", F.to_json("fields"))


def queries() -> dict:
    return {f.__name__: f for f in (p1_found, p1_elements, p2_found, p3_found, p5_found, p5_schema, p5_table)}


_RINGS = """
WITH ring AS (
  SELECT region_id, city, unnest(CASE WHEN geometry LIKE '{%' THEN regexp_extract_all(geometry, '\\[(\\[[^\\[\\]]*\\](?:, ?\\[[^\\[\\]]*\\])+)\\]', 1)
                                      ELSE regexp_extract_all(geometry, '\\(([^()]+,[^()]+)\\)', 1) END) AS r
  FROM city_extents WHERE geometry IS NOT NULL),
flat AS (SELECT row_number() OVER () AS ring_id, region_id, city, regexp_extract_all(r, '-?[0-9.]+') AS v FROM ring),
seg AS (SELECT region_id, city, CAST(v[2*i-1] AS DOUBLE) ax, CAST(v[2*i] AS DOUBLE) ay, CAST(v[2*i+1] AS DOUBLE) bx, CAST(v[2*i+2] AS DOUBLE) by1
        FROM (SELECT region_id, city, v, unnest(range(1, len(v) // 2)) AS i FROM flat)),
p AS (SELECT DISTINCT city, node_id, x, y FROM nodes WHERE x IS NOT NULL AND y IS NOT NULL AND NOT isnan(x) AND NOT isnan(y)),
cellular AS (SELECT *, CAST(floor(x / 10) AS BIGINT) cx, CAST(floor(y / 10) AS BIGINT) cy FROM p),
around AS (SELECT city, node_id, x, y, cx + dx AS cx, cy + dy AS cy FROM cellular, (VALUES (-1), (0), (1)) a(dx), (VALUES (-1), (0), (1)) b(dy))
SELECT DISTINCT 'near' AS kind, least(a.node_id, b.node_id) AS id_a, greatest(a.node_id, b.node_id) AS id_b
FROM cellular a JOIN around b ON a.city = b.city AND a.cx = b.cx AND a.cy = b.cy AND a.node_id < b.node_id
WHERE (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 100.0000002
UNION ALL
SELECT DISTINCT 'in', region_id, node_id FROM (
  SELECT s.region_id, p.node_id, p.x, p.y FROM seg s JOIN p ON s.city = p.city
  WHERE (s.ay > p.y) <> (s.by1 > p.y) AND p.x < (s.bx - s.ax) * (p.y - s.ay) / (s.by1 - s.ay) + s.ax
  GROUP BY s.region_id, p.node_id, p.x, p.y HAVING count(*) % 2 = 1)
"""

_CUT, _BLANKS = r",;|/+&\n\r\t、；，｜", "' \t\r\n' || chr(160)"
_PEEL = r"'(?s)^(?:\[(.*)\]|\((.*)\)|\{(.*)\})$', '\1\2\3'"
# No entry of the reference list holds a delimiter, so plain cutting gives the values; quoted ones are matched whole.
_PACKED = rf"""
WITH t AS (SELECT DISTINCT highway, trim(highway, {_BLANKS}) AS c FROM edges WHERE regexp_matches(highway, '[{_CUT}]')),
bare AS (SELECT highway, trim(regexp_replace(trim(regexp_replace(c, {_PEEL}), {_BLANKS}), {_PEEL}), {_BLANKS}) AS c FROM t),
raw AS (SELECT highway, regexp_extract_all(c, '\s*"(?:[^"]|"")*"\s*(?:[{_CUT}]|$)|\s*''(?:[^'']|'''')*''\s*(?:[{_CUT}]|$)|[^{_CUT}]+') AS p FROM bare),
cut AS (SELECT highway, list_filter(list_transform(p, lambda v: CASE WHEN regexp_matches(v, '(?s)^\s*(?:"(?:[^"]|"")*"|''(?:[^'']|'''')*'')\s*[{_CUT}]?$')
    THEN trim(replace(replace(regexp_extract(v, '(?s)^\s*["''](.*)["'']\s*[{_CUT}]?$', 1), '""', '"'), '''''', ''''), {_BLANKS}) ELSE trim(v, {_BLANKS}) END), lambda v: v <> '') AS p FROM raw)
SELECT edge_id, CAST(i AS INT) AS pos, p[i] AS highway_value FROM (SELECT edge_id, p, unnest(range(1, len(p) + 1)) AS i FROM edges JOIN cut USING (highway) WHERE len(p) >= 2)
"""


def oracle_sql() -> dict[str, str]:
    return {"p2_found": _RINGS, "p3_found": _PACKED}
