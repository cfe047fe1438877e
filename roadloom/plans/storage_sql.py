"""SQL of the queries in plans.storage."""

from __future__ import annotations

from roadloom.operators.scoring import CITY_ORDER
from roadloom.plans import graph_sql as g
from roadloom.plans import network_sql as q

_HAV = "2 * 6371000.0 * asin(sqrt(pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2)))"
_LL = f"ll AS (SELECT DISTINCT node_id, CAST({q._LL[0]} AS DOUBLE) AS lon, CAST({q._LL[1]} AS DOUBLE) AS lat FROM nd)"
_ENDS = "e AS (SELECT ed.city, sqrt(pow(b.x - a.x, 2) + pow(b.y - a.y, 2)) AS s FROM ed JOIN nd a ON a.city = ed.city AND a.node_id = ed.u JOIN nd b ON b.city = ed.city AND b.node_id = ed.v WHERE a.x IS NOT NULL AND a.y IS NOT NULL AND b.x IS NOT NULL AND b.y IS NOT NULL AND (a.x <> b.x OR a.y <> b.y))"
_DIRECTED = """de AS (SELECT city, u, v, min(length) AS length, row_number() OVER (ORDER BY city, u, v) AS id FROM ed GROUP BY city, u, v),
nb AS (SELECT city, u AS n, v AS m, 1 AS o FROM de UNION ALL SELECT city, v, u, 0 FROM de),
inn AS (SELECT city, n FROM nb GROUP BY city, n HAVING count(DISTINCT m) = 2 AND sum(o) = sum(1 - o) AND sum(o) IN (1, 2)),
lnk AS (SELECT a.city, a.id AS x, b.id AS y FROM de a JOIN inn i ON i.city = a.city AND i.n = a.v JOIN de b ON b.city = a.city AND b.u = a.v AND b.v <> a.u),
lsym AS (SELECT city, x, y FROM lnk UNION SELECT city, y, x FROM lnk),
lc(city, id, label) USING KEY (city, id) AS (
  SELECT city, id, id FROM de
  UNION
  SELECT s.city, s.y, min(c.label) FROM lc c JOIN lsym s ON s.city = c.city AND s.x = c.id
  JOIN recurring.lc r ON r.city = s.city AND r.id = s.y WHERE c.label < r.label GROUP BY s.city, s.y),
own AS (SELECT de.*, label, a.n IS NOT NULL AS ui, b.n IS NOT NULL AS vi FROM de JOIN lc USING (city, id) LEFT JOIN inn a ON a.city = de.city AND a.n = de.u LEFT JOIN inn b ON b.city = de.city AND b.n = de.v)"""
_BUILT = f"{q._GRIDREC},\n{q._EXTENT}"
_FOUR = """sides AS (SELECT e.city, count(*) FILTER (f.city IS NOT NULL) AS n FROM ext e LEFT JOIN ext f ON f.city = e.city AND ((f.row = e.row + 1 AND f.col = e.col) OR (f.row = e.row AND f.col = e.col + 1)) GROUP BY e.city),
squares AS (SELECT a.city, count(*) AS n FROM ext a JOIN ext b ON b.city = a.city AND b.row = a.row + 1 AND b.col = a.col JOIN ext c ON c.city = a.city AND c.row = a.row AND c.col = a.col + 1 JOIN ext d ON d.city = a.city AND d.row = a.row + 1 AND d.col = a.col + 1 GROUP BY a.city),
fadj AS (SELECT a.city, a.grid_id AS a, b.grid_id AS b FROM ext a JOIN ext b ON a.city = b.city AND abs(a.row - b.row) + abs(a.col - b.col) = 1),
four(city, grid_id, label) USING KEY (city, grid_id) AS (
  SELECT city, grid_id, grid_id FROM ext
  UNION
  SELECT s.city, s.b, min(c.label) FROM four c JOIN fadj s ON s.city = c.city AND s.a = c.grid_id
  JOIN recurring.four r ON r.city = s.city AND r.grid_id = s.b WHERE c.label < r.label GROUP BY s.city, s.b),
pieces AS (SELECT city, count(DISTINCT label) AS n FROM four GROUP BY city)"""
_KIND = "CASE relation_id % 7 + 3 WHEN 4 THEN 'STATE_OR_UT' WHEN 5 THEN 'DISTRICT' WHEN 6 THEN 'SUBDISTRICT' WHEN 7 THEN 'METROPOLITAN_AREA' WHEN 8 THEN CASE WHEN relation_id % 2 = 0 THEN 'MUNICIPAL_OR_CITY_BOUNDARY' ELSE 'UNKNOWN' END ELSE 'OTHER_ADMINISTRATIVE' END"
_RANGE = "round(m, 6) AS index_mean, round(s, 6) AS index_sd, round(m - s, 6) AS reference_lower, round(m + s, 6) AS reference_upper, round(cm, 6) AS connectivity_mean, round(em, 6) AS efficiency_mean, round(hm, 6) AS hierarchy_mean FROM ref"
_IN = "((82.007 - 72.003) * (lat - 12.001) - (13.002 - 12.001) * (lon - 72.003) >= 0 AND (77.001 - 82.007) * (lat - 13.002) - (24.003 - 13.002) * (lon - 82.007) >= 0 AND (72.003 - 77.001) * (lat - 24.003) - (12.001 - 24.003) * (lon - 77.001) >= 0)"
_CLIP = """mid AS (SELECT city, min(x) AS lx, max(x) AS hx, min(y) AS ly, max(y) AS hy FROM nd WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY city),
box AS (SELECT city, lx + (hx - lx) * 0.25 AS lx, ly + (hy - ly) * 0.25 AS ly, lx + (hx - lx) * 0.75 AS hx, ly + (hy - ly) * 0.75 AS hy FROM mid),
tt AS (SELECT r.city, bx - ax AS dx, by1 - ay AS dy,
  CASE WHEN bx <> ax THEN least((lx - ax) / (bx - ax), (hx - ax) / (bx - ax)) WHEN ax BETWEEN lx AND hx THEN 0 ELSE 2 END AS ex, CASE WHEN bx <> ax THEN greatest((lx - ax) / (bx - ax), (hx - ax) / (bx - ax)) WHEN ax BETWEEN lx AND hx THEN 1 ELSE -1 END AS qx,
  CASE WHEN by1 <> ay THEN least((ly - ay) / (by1 - ay), (hy - ay) / (by1 - ay)) WHEN ay BETWEEN ly AND hy THEN 0 ELSE 2 END AS ey, CASE WHEN by1 <> ay THEN greatest((ly - ay) / (by1 - ay), (hy - ay) / (by1 - ay)) WHEN ay BETWEEN ly AND hy THEN 1 ELSE -1 END AS qy FROM road r JOIN box USING (city)),
cut AS (SELECT city, (least(1, qx, qy) - greatest(0, ex, ey)) * sqrt(dx * dx + dy * dy) AS l FROM tt WHERE greatest(0, ex, ey) < least(1, qx, qy))"""
_ORDER = " ".join(f"WHEN '{c}' THEN {k}" for k, c in enumerate(CITY_ORDER, 1))


def _close(sources: str, graph: str, population: str) -> str:
    return f"""{q._hops(sources, graph, 'fb')}, pop AS (SELECT city, count(*) AS n FROM {population} GROUP BY city),
cl AS (SELECT b.city, source, CASE WHEN sum(hops) > 0 THEN (count(*) - 1) / sum(hops) * ((count(*) - 1) / any_value(n - 1.0)) ELSE 0 END AS c FROM fb b JOIN pop USING (city) GROUP BY b.city, source)"""


ORACLE = {
    "geojson_points": f"WITH {q._NODES} SELECT city, node_id, round(x, 3) AS x, round(y, 3) AS y FROM nd WHERE x IS NOT NULL AND y IS NOT NULL",
    "geojson_lines": f"{q._WITH}, {_ENDS} SELECT city, count(*) AS n_lines, round(sum(s), 2) AS straight_m FROM e GROUP BY city",
    "extent_polygon": f"{_BUILT},\n{_FOUR} SELECT e.city, CAST(any_value(p.n) AS INT) AS parts, CAST(any_value(p.n) - count(*) + any_value(s.n) - coalesce(any_value(k.n), 0) AS INT) AS holes, CAST(count(*) * 250000 AS DOUBLE) AS area_m2, round(CAST(min(e.center_x) - 250 AS DOUBLE), 2) AS min_x, round(CAST(max(e.center_y) + 250 AS DOUBLE), 2) AS max_y FROM ext e JOIN pieces p USING (city) JOIN sides s USING (city) LEFT JOIN squares k USING (city) GROUP BY e.city",
    "graphml_edges": f"{q._WITH} SELECT u, v, edge_key, round(length, 3) AS length, CASE WHEN regexp_full_match(highway, '[a-z_]+') THEN highway END AS highway FROM ed",
    "osm_roads": f"{q._WITH}, {_LL}, w AS (SELECT edge_id, u, v, highway, edge_id % 3 AS k FROM ed WHERE regexp_full_match(highway, '[a-z_]+')), s AS (SELECT edge_id, u, v, highway FROM w WHERE k <> 1 UNION ALL SELECT edge_id, v, u, highway FROM w WHERE k <> 0) SELECT edge_id AS way_id, s.u, s.v, round({_HAV}, 3) AS length, highway FROM s JOIN ll a ON a.node_id = s.u JOIN ll b ON b.node_id = s.v",
    "pbf_extract": f"{q._WITH}, {_LL}, hit AS (SELECT node_id FROM ll WHERE {_IN}), w AS (SELECT edge_id, highway FROM ed WHERE regexp_full_match(highway, '[a-z_]+') AND (u IN (SELECT node_id FROM hit) OR v IN (SELECT node_id FROM hit))) SELECT 'node' AS kind, count(*) AS n, CAST(0 AS BIGINT) AS n_primary FROM hit HAVING count(*) > 0 UNION ALL SELECT 'way', count(*), count(*) FILTER (highway = 'primary') FROM w HAVING count(*) > 0",
    "csv_nodes": f"WITH {q._NODES} SELECT city, node_id, round(x, 3) AS x, round(y, 3) AS y FROM nd",
    "json_report": q.ORACLE["road_class_shares"],
    "text_report": f"SELECT summary FROM ({q.ORACLE['interpretation']})",
    "reused_degrees": f"SELECT *, 2 AS times_made FROM ({q.ORACLE['degree']})",
    "preflight_problems": """WITH want AS (SELECT DISTINCT city FROM nodes WHERE city IS NOT NULL UNION SELECT 'Nowhere')
SELECT city || CASE WHEN city IN (SELECT city FROM nodes WHERE city IS NOT NULL) THEN ': no node with a position' ELSE ': no nodes' END AS problem FROM want WHERE city NOT IN (SELECT city FROM nodes WHERE city IS NOT NULL AND x IS NOT NULL AND y IS NOT NULL AND NOT isnan(x) AND NOT isnan(y))
UNION ALL SELECT city || CASE WHEN city IN (SELECT city FROM edges WHERE city IS NOT NULL) THEN ': no edge with a length' ELSE ': no edges' END FROM want WHERE city NOT IN (SELECT city FROM edges WHERE city IS NOT NULL AND length IS NOT NULL AND NOT isnan(length))
UNION ALL SELECT city || ': no extent' FROM want WHERE city NOT IN (SELECT city FROM city_extents WHERE city IS NOT NULL)""",
    "graph_problems": f"""{q._WITH} SELECT city, 'nodes without a position' AS problem, count(*) AS n FROM nd WHERE x IS NULL OR y IS NULL GROUP BY city
UNION ALL SELECT city, 'edges without a length', count(*) FROM ed WHERE length IS NULL GROUP BY city
UNION ALL SELECT ed.city, 'edges with an unknown end', count(*) FROM ed LEFT JOIN nd a ON a.city = ed.city AND a.node_id = ed.u LEFT JOIN nd b ON b.city = ed.city AND b.node_id = ed.v WHERE a.node_id IS NULL OR b.node_id IS NULL GROUP BY ed.city
UNION ALL SELECT DISTINCT city, 'no edges', CAST(1 AS BIGINT) FROM nd WHERE city NOT IN (SELECT city FROM ed)""",
    "city_sets": "SELECT DISTINCT 'table 2: no ' || city AS problem FROM nodes WHERE city = 'Pune'",
    "polygon_repair": f"WITH {q._AREAS} SELECT region_id, CAST(count(*) FILTER (is_outer) AS INT) AS parts, CAST(count(*) FILTER (NOT is_outer) AS INT) AS holes, round(sum(CASE WHEN is_outer THEN a ELSE -a END), 1) AS area_m2 FROM ra GROUP BY region_id",
    "relation_rings": f"WITH {q._AREAS} SELECT region_id AS relation_id, round(sum(CASE WHEN is_outer THEN a ELSE -a END), 1) AS area, CAST(NULL AS VARCHAR) AS problem FROM ra GROUP BY region_id",
    "boundary_audit": f"WITH {q._AREAS}, r AS (SELECT region_id AS relation_id, sum(CASE WHEN is_outer THEN a ELSE -a END) AS a, min(lx) FILTER (is_outer) AS lx, min(ly) FILTER (is_outer) AS ly, max(hx) FILTER (is_outer) AS hx, max(hy) FILTER (is_outer) AS hy FROM ra GROUP BY region_id) SELECT relation_id, {_KIND} AS kind, round(a / 1e6, 4) AS area_km2, printf('%.8f, %.8f, %.8f, %.8f', lx, ly, hx, hy) AS bbox, CAST(NULL AS VARCHAR) AS problem FROM r",
    "line_clip": f"{q._WITH}, {q._ROADS}, {_CLIP} SELECT city, count(*) AS n_lines, round(sum(l), 2) AS length_m FROM cut GROUP BY city",
    "coordinate_kind": f"WITH {q._NODES} SELECT city, min(x) >= -180 AND max(x) <= 180 AND min(y) >= -90 AND max(y) <= 90 AS nodes_in_degrees, true AS made_in_degrees FROM nd WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY city",
    "building_load": f"WITH {q._NODES}, zone(city, srid) AS (VALUES {q._ZONES}) SELECT city, count(*) AS n_buildings, round(sum(pow(30 + node_id % 150, 2)) / 1e6, 6) AS area_km2 FROM nd JOIN zone USING (city) WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY city",
    "building_place": f"WITH {q._NODES}, w AS (SELECT city, x, y, pow(30 + node_id % 150, 2) AS a FROM nd WHERE x IS NOT NULL AND y IS NOT NULL) SELECT city, round(sqrt(pow(sum(x * a) / sum(a) - quantile_cont(x, 0.5), 2) + pow(sum(y * a) / sum(a) - quantile_cont(y, 0.5), 2)) / 1000, 6) AS distance_km FROM w GROUP BY city",
    "landuse_cells": f"{q._GRID}, third AS (SELECT DISTINCT city, cx, cy FROM fy WHERE node_id % 3 = 0 AND (least(hx, (cx + 1) * 500) - greatest(lx, cx * 500)) * (least(hy, (cy + 1) * 500) - greatest(ly, cy * 500)) > 1e-9) SELECT t.city, count(*) AS n_cells FROM third t JOIN lim l USING (city) JOIN bu ON bu.city = t.city AND bu.row = t.cy - l.oy AND bu.col = t.cx - l.ox GROUP BY t.city",
    "built_within": f"{_BUILT} SELECT city, round(sum(area) / 1e6, 6) AS built_up_km2 FROM ext GROUP BY city",
    "extent_densities": f"WITH RECURSIVE {q._BASE},\n{q._FOOT},\n{q._CELLCC},\n{q._EXTENT},\n{g._HULL}, a AS (SELECT city, count(*) * 0.25 AS k, sum(area) / 1e6 AS b FROM ext GROUP BY city), n AS (SELECT city, count(*) AS n FROM nd GROUP BY city), m AS (SELECT city, count(*) AS e FROM mu GROUP BY city) SELECT city, round(CAST(n / k AS DOUBLE), 6) AS nodes_per_extent_km2, round(CAST(e / k AS DOUBLE), 6) AS links_per_extent_km2, round(n / b, 6) AS nodes_per_built_km2, round(e / b, 6) AS links_per_built_km2, round(h.area / 1e6, 6) AS hull_km2, round(CAST(100 * h.area / 1e6 / k AS DOUBLE), 6) AS hull_pct FROM a JOIN n USING (city) JOIN m USING (city) JOIN hulls h USING (city)",
    "nearest_components": f"{q._GRIDREC},\n{q._EXTENT}, o AS (SELECT t.city, component_id, n, sqrt((mx - x) * (mx - x) + (my - y) * (my - y)) / 1000 AS dist FROM tab t JOIN ctr USING (city)), p AS (SELECT *, row_number() OVER (PARTITION BY city ORDER BY dist, n DESC, component_id) AS place FROM o) SELECT city, CAST(place AS INT) AS place, component_id, n AS cell_count, round(dist, 6) AS distance_to_center_km FROM p WHERE place <= 30",
    "graph_simplify_directed": f"WITH RECURSIVE {q._BASE},\n{_DIRECTED} SELECT city, coalesce(max(u) FILTER (NOT ui), min(u)) AS u, coalesce(max(v) FILTER (NOT vi), min(u)) AS v, round(sum(coalesce(length, 0)), 6) AS length, count(*) AS n_segments FROM own GROUP BY city, label",
    "closeness_full": f"{q._REC},\n{q._pilot('nd')},\n{_close('src', 'sym', 'nd')} SELECT city, count(*) AS n, round(avg(c), 9) AS closeness FROM cl GROUP BY city",
    "closeness_simple": f"{q._REC},\nsrc AS (SELECT city, node_id FROM ({g.ranked('nd')}) WHERE r <= 1000),\n{_close('src', 'sym', 'nd')} SELECT city, count(*) AS n, round(avg(c), 9) AS closeness, round(coalesce(stddev_samp(c), 0), 9) AS sd FROM cl GROUP BY city",
    "betweenness_sources": f"WITH {q._NODES} SELECT city, node_id FROM ({g.ranked('nd')}) WHERE r <= least(population, least(500, greatest(100, ceil(0.005 * population))))",
    "student_t": f"WITH RECURSIVE many AS (SELECT 200 AS n),\n{g._T.replace('range(1, (SELECT max(n) FROM many))', 'range(1, 201)')} SELECT CAST(f AS INT) AS freedom, round(t, 9) AS t FROM crit",
    "seed_spread": f"SELECT city, count(*) AS runs, round(avg(estimate), 8) AS mean_estimate, round(coalesce(stddev_samp(estimate), 0), 8) AS sd_estimate FROM ({q.ORACLE['multiseed']}) GROUP BY city",
    "metric_reference": f"WITH {q._METRICS} SELECT metric, round(min(lo), 6) AS lo, round(max(hi), 6) AS hi FROM scored WHERE metric = 'node_density' GROUP BY metric",
    "reference_layouts": f"WITH {q._METRICS}, b AS (SELECT metric, round(min(lo), 6) AS lo, round(max(hi), 6) AS hi FROM scored GROUP BY metric) SELECT layout, b.* FROM b, (VALUES ('city'), ('metric')) l(layout)",
    "city_evaluation": f"WITH {q._METRICS} SELECT city, metric, round(CASE WHEN abs(hi - lo) <= 1e-8 + 1e-5 * abs(lo) THEN 50.0 ELSE 100 * (value - lo) / (hi - lo) END, 6) AS score FROM scored",
    "reference_choice": f"WITH {q._METRICS} SELECT 'file' AS origin, {_RANGE} UNION ALL SELECT 'scores', {_RANGE}",
    "pillar_import": f"WITH {q._METRICS} SELECT city, round(c, 6) AS connectivity_score FROM pil",
    "city_listing": f"WITH {q._METRICS} SELECT CAST(CASE city {_ORDER} ELSE {len(CITY_ORDER) + 1} END AS INT) AS city_order, city, lower(city) AS slug, round(i, 6) AS index_score FROM idx",
    "loading_delays": """WITH s AS (SELECT edge_id, CAST(floor((epoch_us(loaded_at) - epoch_us(observed_at)) / 1000000) AS BIGINT) AS s FROM edges WHERE observed_at IS NOT NULL AND loaded_at >= observed_at)
SELECT edge_id, CASE WHEN s < 60 THEN printf('%d.00s', s) WHEN s < 3600 THEN printf('%dm %d.00s', s // 60, s % 60) ELSE printf('%dh %dm %d.00s', s // 3600, s // 60 % 60, s % 60) END AS delay FROM s""",
}
