"""The same queries in SQL, over the tables as views. Row orders and engines differ, so measures are rounded on both sides."""

from __future__ import annotations

from roadloom.functions import geo
from roadloom.operators.metrics import LINKED, RANKS
from roadloom.plans.network import SEED, SRID

_NODES = """nd AS (
  SELECT city, node_id, min(CASE WHEN NOT isnan(x) THEN x END) AS x, min(CASE WHEN NOT isnan(y) THEN y END) AS y
  FROM nodes WHERE city IS NOT NULL AND node_id IS NOT NULL GROUP BY city, node_id)"""
_EDGES = """er AS (
  SELECT coalesce(e.city, n.city) AS city, e.u, e.v, e.edge_key, CASE WHEN e.length > 0 AND NOT isnan(e.length) THEN e.length END AS length, e.highway, e.edge_id, e.loaded_at
  FROM edges e LEFT JOIN nd n ON e.city IS NULL AND n.node_id = e.u WHERE e.u <> e.v),
ed AS (SELECT * FROM er WHERE city IS NOT NULL QUALIFY row_number() OVER (PARTITION BY city, u, v, edge_key ORDER BY loaded_at DESC, edge_id DESC) = 1),
mu AS (
  SELECT *, least(u, v) AS lo, greatest(u, v) AS hi FROM ed
  QUALIFY CAST(u > v AS INT) = min(CAST(u > v AS INT)) OVER (PARTITION BY city, least(u, v), greatest(u, v)))"""
_BASE = f"{_NODES},\n{_EDGES}"
_SYM = "sym AS (SELECT DISTINCT city, lo AS a, hi AS b FROM mu UNION SELECT DISTINCT city, hi, lo FROM mu)"
_COMPONENTS = """cc(city, node_id, component) USING KEY (city, node_id) AS (
  SELECT city, node_id, node_id FROM nd
  UNION
  SELECT s.city, s.b, min(c.component) FROM cc c JOIN sym s ON s.city = c.city AND s.a = c.node_id
  JOIN recurring.cc r ON r.city = s.city AND r.node_id = s.b WHERE c.component < r.component GROUP BY s.city, s.b)"""
_LCC = """size AS (SELECT city, component, count(*) AS n_nodes FROM cc GROUP BY city, component),
best AS (SELECT city, component FROM size QUALIFY row_number() OVER (PARTITION BY city ORDER BY n_nodes DESC, component) = 1),
lcc AS (SELECT cc.city, cc.node_id FROM cc JOIN best USING (city, component)),
lmu AS (SELECT mu.* FROM mu JOIN lcc ON lcc.city = mu.city AND lcc.node_id = mu.lo)"""
_AREA = "area AS (SELECT city, count(DISTINCT (CAST(floor(x / 500) AS BIGINT), CAST(floor(y / 500) AS BIGINT))) * CAST(0.25 AS DOUBLE) AS area_km2 FROM nd WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY city)"
_WITH, _REC = f"WITH {_BASE}", f"WITH RECURSIVE {_BASE},\n{_SYM}"


def _hash(c: str, seed: int = SEED) -> str:
    once = f"((({c}) % 2147483648) * 1103515245 + {12345 + 7919 * seed}) % 2147483648"
    turned = f"(({once}) % 65536) * 32768 + ({once}) // 65536"
    return f"(({turned}) * 1103515245 + 12345) % 2147483648"


def _pilot(source: str, name: str = "src", seed: int = SEED) -> str:
    return f"""{name} AS (SELECT city, node_id FROM (SELECT city, node_id, count(*) OVER (PARTITION BY city) AS population,
  row_number() OVER (PARTITION BY city ORDER BY {_hash('node_id', seed)}, node_id) AS r FROM {source}) WHERE r <= least(greatest(2, ceil(0.02 * population)), population))"""


_SIMPLE = "simple AS (SELECT city, lo, hi, coalesce(length, 1.0) AS length, highway FROM mu QUALIFY row_number() OVER (PARTITION BY city, lo, hi ORDER BY coalesce(length, 1.0), edge_id) = 1)"
_PRICED = "priced AS (SELECT city, lo, hi, min(length) AS length FROM mu WHERE length IS NOT NULL GROUP BY city, lo, hi)"


def _hops(sources: str = "src", graph: str = "sym", name: str = "bfs") -> str:
    return f"""{name}(city, source, target, hops) USING KEY (city, source, target) AS (
  SELECT city, node_id, node_id, CAST(0 AS BIGINT) FROM {sources}
  UNION
  SELECT f.city, f.source, s.b, min(f.hops) + 1 FROM {name} f JOIN {graph} s ON s.city = f.city AND s.a = f.target
  LEFT JOIN recurring.{name} r ON r.city = f.city AND r.source = f.source AND r.target = s.b WHERE r.target IS NULL GROUP BY f.city, f.source, s.b)"""


_WEIGHTED = """wsym AS (SELECT city, lo AS a, hi AS b, length FROM priced UNION ALL SELECT city, hi, lo, length FROM priced),
dij(city, source, target, d) USING KEY (city, source, target) AS (
  SELECT city, node_id, node_id, CAST(0 AS DOUBLE) FROM src
  UNION
  SELECT f.city, f.source, s.b, min(f.d + s.length) FROM dij f JOIN wsym s ON s.city = f.city AND s.a = f.target
  LEFT JOIN recurring.dij r ON r.city = f.city AND r.source = f.source AND r.target = s.b
  GROUP BY f.city, f.source, s.b, r.d HAVING r.d IS NULL OR min(f.d + s.length) < r.d)"""

_TRIM = "' \t\r\n[]{}()\"''' || chr(160)"
_PIECES = "regexp_extract_all(regexp_replace(trim(highway, ' \t\r\n' || chr(160)), '(?s)^[\\[({](.*)[\\])}]$', '\\1'), ' *\"(?:[^\"]|\"\")*\"| *''[^'']*''|[^,;|/+&\\n\\r\\t、；，｜]+')"
_VALUES = f"list_transform({_PIECES}, lambda p: regexp_replace(lower(trim(p, {_TRIM})), '^({'|'.join(LINKED)})_link$', '\\1'))"
_NAMES = ", ".join(f"('{k}', {r})" for k, r in RANKS.items())
# of classes of one rank the first named wins: the smallest rank, then the earliest place
_CLASS = f"""cls(road_class, rank) AS (VALUES {_NAMES}),
texts AS (SELECT DISTINCT highway FROM edges WHERE highway IS NOT NULL),
parts AS (SELECT highway, unnest({_VALUES}) AS v, generate_subscripts({_VALUES}, 1) AS i FROM texts),
classed AS (SELECT highway, cls.road_class, rank FROM parts JOIN cls ON v = cls.road_class QUALIFY row_number() OVER (PARTITION BY highway ORDER BY rank, i) = 1)"""
_LENGTHS = f"{_CLASS},\nlen AS (SELECT city, road_class, sum(coalesce(length, 1.0)) AS length, count(*) AS n_edges FROM mu JOIN classed USING (highway) GROUP BY city, road_class)"
_ENTROPY = "ent AS (SELECT city, -sum(p * ln(p)) / ln(9) AS class_entropy FROM (SELECT city, length / sum(length) OVER (PARTITION BY city) AS p FROM len) GROUP BY city)"
_DENS = """dens AS (SELECT n.city, n.n_nodes, coalesce(e.n_links, 0) AS n_links, a.area_km2 FROM (SELECT city, count(*) AS n_nodes FROM nd GROUP BY city) n
  LEFT JOIN (SELECT city, count(*) AS n_links FROM mu GROUP BY city) e USING (city) LEFT JOIN area a USING (city))"""
_LDENS = _DENS.replace("dens AS", "ldens AS").replace("FROM nd", "FROM lcc").replace("FROM mu", "FROM lmu")
_CIRC = """ends AS (SELECT mu.*, hypot_(b.x - a.x, b.y - a.y) AS straight FROM mu LEFT JOIN nd a ON a.city = mu.city AND a.node_id = mu.lo LEFT JOIN nd b ON b.city = mu.city AND b.node_id = mu.hi),
circ AS (SELECT city, avg(CASE WHEN straight > 0 AND length IS NOT NULL THEN length / straight END) AS average_edge_circuity, count(CASE WHEN straight > 0 AND length IS NOT NULL THEN 1 END) AS n_edges FROM ends GROUP BY city)""".replace("hypot_(b.x - a.x, b.y - a.y)", "sqrt((b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y))")
_GAMMA = "gam AS (SELECT city, CASE WHEN n_nodes > 2 THEN n_links / (3.0 * (n_nodes - 2)) ELSE 0.0 END AS gamma_index FROM dens)"
_RCRC = "rc AS (SELECT city, gamma_index, average_edge_circuity, CASE WHEN average_edge_circuity > 0 THEN gamma_index / average_edge_circuity ELSE 0.0 END AS rcrc FROM gam LEFT JOIN circ USING (city))"
_METRICS = f"""{_BASE},
{_AREA},
{_DENS},
{_GAMMA},
{_CIRC},
{_RCRC},
{_LENGTHS},
{_ENTROPY},
vals AS (
  SELECT city, 'node_density' AS metric, 'connectivity' AS pillar, n_nodes / area_km2 AS value FROM dens
  UNION ALL SELECT city, 'link_density', 'connectivity', n_links / area_km2 FROM dens
  UNION ALL SELECT city, 'average_degree', 'connectivity', 2.0 * n_links / n_nodes FROM dens
  UNION ALL SELECT city, 'rcrc', 'efficiency', rcrc FROM rc
  UNION ALL SELECT city, 'hierarchy_road_class_distribution', 'hierarchy', class_entropy FROM ent),
scored AS (SELECT *, CASE WHEN abs(hi - lo) <= CASE pillar WHEN 'connectivity' THEN 1e-8 + 1e-5 * abs(lo) WHEN 'efficiency' THEN 1e-8 + 1e-5 * abs(hi) ELSE 1e-9 * greatest(abs(hi), abs(lo)) END THEN 50.0 ELSE 100 * (value - lo) / (hi - lo) END AS score
  FROM (SELECT *, min(value) OVER (PARTITION BY metric) AS lo, max(value) OVER (PARTITION BY metric) AS hi FROM vals)),
pil AS (SELECT city, avg(score) FILTER (pillar = 'connectivity') AS c, avg(score) FILTER (pillar = 'efficiency') AS e, avg(score) FILTER (pillar = 'hierarchy') AS h FROM scored GROUP BY city),
idx AS (SELECT *, (c + e + h) / 3 AS i FROM pil),
ref AS (SELECT count(i) AS n_cities, avg(i) AS m, stddev_pop(i) AS s, stddev_samp(i) AS ss, avg(c) AS cm, avg(e) AS em, avg(h) AS hm FROM idx)"""

_FOOT = """foot AS (SELECT city, node_id, x - (30 + node_id % 150) / 2.0 AS lx, y - (30 + node_id % 150) / 2.0 AS ly, x + (30 + node_id % 150) / 2.0 AS hx, y + (30 + node_id % 150) / 2.0 AS hy
  FROM nd WHERE x IS NOT NULL AND y IS NOT NULL),
lim AS (SELECT city, CAST(floor(min(lx) / 500) AS BIGINT) AS ox, CAST(floor(min(ly) / 500) AS BIGINT) AS oy, CAST(ceil(max(hy) / 500) - floor(min(ly) / 500) AS BIGINT) AS n_rows, CAST(ceil(max(hx) / 500) - floor(min(lx) / 500) AS BIGINT) AS n_cols FROM foot GROUP BY city),
fx AS (SELECT *, unnest(range(CAST(floor(lx / 500) AS BIGINT), CAST(ceil(hx / 500) AS BIGINT))) AS cx FROM foot),
fy AS (SELECT *, unnest(range(CAST(floor(ly / 500) AS BIGINT), CAST(ceil(hy / 500) AS BIGINT))) AS cy FROM fx),
held AS (SELECT city, cx, cy, sum((least(hx, (cx + 1) * 500) - greatest(lx, cx * 500)) * (least(hy, (cy + 1) * 500) - greatest(ly, cy * 500))) AS area FROM fy GROUP BY city, cx, cy),
cov AS (SELECT h.city, h.cy - l.oy AS row, h.cx - l.ox AS col, (h.cy - l.oy) * l.n_cols + h.cx - l.ox AS grid_id, (h.cx + 0.5) * 500 AS center_x, (h.cy + 0.5) * 500 AS center_y, area, least(1.0, greatest(0.0, area / 250000)) AS c FROM held h JOIN lim l USING (city)),
bu AS (SELECT * FROM cov WHERE c >= 0.005)"""
_CELLCC = """adj AS (SELECT a.city, a.grid_id AS a, b.grid_id AS b FROM bu a JOIN bu b ON a.city = b.city AND abs(a.row - b.row) <= 1 AND abs(a.col - b.col) <= 1 AND a.grid_id <> b.grid_id),
cc(city, grid_id, component_id) USING KEY (city, grid_id) AS (
  SELECT city, grid_id, grid_id FROM bu
  UNION
  SELECT s.city, s.b, min(c.component_id) FROM cc c JOIN adj s ON s.city = c.city AND s.a = c.grid_id
  JOIN recurring.cc r ON r.city = s.city AND r.grid_id = s.b WHERE c.component_id < r.component_id GROUP BY s.city, s.b),
built AS (SELECT bu.*, cc.component_id FROM bu JOIN cc USING (city, grid_id))"""
_GAP = "500 * sqrt(pow(greatest(abs(a.row - b.row) - 1, 0), 2) + pow(greatest(abs(a.col - b.col) - 1, 0), 2)) / 1000"
_EXTENT = f"""ctr AS (SELECT city, quantile_cont(x, 0.5) AS x, quantile_cont(y, 0.5) AS y FROM nd WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY city),
tab AS (SELECT city, component_id, count(*) AS n, avg(center_x) AS mx, avg(center_y) AS my FROM built GROUP BY city, component_id),
prim AS (SELECT t.city, component_id FROM tab t JOIN ctr USING (city) QUALIFY row_number() OVER (PARTITION BY t.city ORDER BY sqrt((mx - x) * (mx - x) + (my - y) * (my - y)), n DESC, component_id) = 1),
sel AS (SELECT DISTINCT b.city, b.component_id FROM built b JOIN prim p USING (city) JOIN built a ON a.city = p.city AND a.component_id = p.component_id WHERE {_GAP} <= 1.0),
ext AS (SELECT built.* FROM built JOIN sel USING (city, component_id)),
thr AS (SELECT city, quantile_cont(c, 0.75) AS t FROM ext GROUP BY city),
core AS (SELECT ext.*, t FROM ext JOIN thr USING (city) WHERE c >= t)"""
_GRID, _GRIDREC = f"WITH {_NODES},\n{_FOOT}", f"WITH RECURSIVE {_NODES},\n{_FOOT},\n{_CELLCC}"

_LL = "70.0 + (node_id % 2000) / 100.0", "10.0 + (node_id % 1777) / 100.0"


def _inverse() -> tuple[str, str]:
    k = geo.UTM_SCALE * geo._RECTIFYING
    xi0, eta0 = f"(y / {k!r})", f"((x - 500000.0) / {k!r})"
    xi = xi0 + "".join(f" - ({b!r}) * sin({2 * j} * {xi0}) * cosh({2 * j} * {eta0})" for j, b in enumerate(geo._BETA, 1))
    eta = eta0 + "".join(f" - ({b!r}) * cos({2 * j} * {xi0}) * sinh({2 * j} * {eta0})" for j, b in enumerate(geo._BETA, 1))
    return xi, eta


_XI, _ETA = _inverse()
_ZONES = ", ".join(f"('{c}', {s})" for c, s in SRID.items())
_DELTAS = "".join(f" + ({d!r}) * sin({2 * j} * chi)" for j, d in enumerate(geo._DELTA, 1))


def _degrees(source: str) -> str:
    """Rows of source (city, x, y, ...) with lon and lat."""
    return f"""zone(city, srid) AS (VALUES {_ZONES}),
u1 AS (SELECT s.*, srid, {_XI} AS xi, {_ETA} AS eta FROM {source} s JOIN zone USING (city)),
u2 AS (SELECT *, asin(sin(xi) / cosh(eta)) AS chi FROM u1),
deg AS (SELECT *, degrees(radians((srid % 100) * 6 - 183.0) + atan2(sinh(eta), cos(xi))) AS lon, degrees(chi{_DELTAS}) AS lat FROM u2)"""


_AREAS = """shape AS (SELECT region_id, CASE WHEN geometry LIKE '{%' THEN replace(replace(regexp_replace(geometry, '\\[ *(-?[0-9.]+), *(-?[0-9.]+) *\\]', '\\1 \\2', 'g'), '[', '('), ']', ')') ELSE geometry END AS g FROM city_extents WHERE geometry IS NOT NULL),
ring AS (SELECT region_id, unnest(regexp_extract_all(g, '(\\( *)?\\(([^()]+,[^()]+)\\)', 0)) AS r FROM shape),
pts AS (SELECT row_number() OVER () AS k, region_id, r LIKE '((%' OR r LIKE '( (%' AS is_outer, list_transform(regexp_extract_all(r, '-?[0-9.]+'), lambda v: CAST(v AS DOUBLE)) AS v FROM ring),
seg AS (SELECT k, region_id, is_outer, v[1] AS x0, v[2] AS y0, v[2*i-1] AS ax, v[2*i] AS ay, v[2*i+1] AS bx, v[2*i+2] AS by1 FROM (SELECT *, unnest(range(1, len(v) // 2)) AS i FROM pts)),
ra AS (SELECT k, region_id, is_outer, abs(sum((ax - x0) * (by1 - y0) - (bx - x0) * (ay - y0)) / 2) AS a, min(ax) AS lx, min(ay) AS ly, max(ax) AS hx, max(ay) AS hy FROM seg GROUP BY k, region_id, is_outer)"""

_ROADS = "road AS (SELECT mu.city, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS by1 FROM mu JOIN nd a ON a.city = mu.city AND a.node_id = mu.lo JOIN nd b ON b.city = mu.city AND b.node_id = mu.hi WHERE a.x IS NOT NULL AND a.y IS NOT NULL AND b.x IS NOT NULL AND b.y IS NOT NULL)"


def _near(step: float, within: float) -> str:
    n = int(500 / step)
    return f"""cells AS (SELECT DISTINCT city, CAST(floor(x / 500) AS BIGINT) AS cx, CAST(floor(y / 500) AS BIGINT) AS cy FROM nd WHERE x IS NOT NULL AND y IS NOT NULL),
pt AS (SELECT city, (cy * 100000 + cx) * {n * n} + j * {n} + i AS point_id, cx * 500 + (i + 0.5) * {500 / n} AS x, cy * 500 + (j + 0.5) * {500 / n} AS y FROM cells, range({n}) a(i), range({n}) b(j)),
{_ROADS},
hit AS (SELECT p.city, p.point_id, p.x, p.y, ax, ay, bx - ax AS dx, by1 - ay AS dy FROM pt p JOIN road r ON p.city = r.city
  WHERE p.x BETWEEN least(ax, bx) - {within} AND greatest(ax, bx) + {within} AND p.y BETWEEN least(ay, by1) - {within} AND greatest(ay, by1) + {within}),
hit2 AS (SELECT *, CASE WHEN dx * dx + dy * dy > 0 THEN least(1.0, greatest(0.0, ((x - ax) * dx + (y - ay) * dy) / (dx * dx + dy * dy))) ELSE 0.0 END AS t FROM hit),
dist AS (SELECT city, point_id, min(sqrt(pow(x - ax - t * dx, 2) + pow(y - ay - t * dy, 2))) AS d FROM hit2 GROUP BY city, point_id HAVING min(sqrt(pow(x - ax - t * dx, 2) + pow(y - ay - t * dy, 2))) <= {within})"""


_SIDE = lambda v, m: f"CASE WHEN {v} - {m} > 0.05 * greatest(abs({m}), 1.0) THEN 'above the reference mean' WHEN {v} - {m} < -0.05 * greatest(abs({m}), 1.0) THEN 'below the reference mean' ELSE 'close to the reference mean' END"
_POS = "CASE WHEN i < m - s THEN 'below the reference range' WHEN i > m + s THEN 'above the reference range' ELSE 'within the reference range' END"
_MEANSIDE = "CASE WHEN i > m THEN 'above' WHEN i < m THEN 'below' ELSE 'equal to' END"
_D = "CAST(node_id AS BIGINT)"

ORACLE = {
    "edges_directed": f"{_WITH} SELECT city, u, v, edge_key, length, highway FROM ed",
    "edges_undirected": f"{_WITH} SELECT city, lo, hi, edge_key, length FROM mu",
    "selfloop_filter": "SELECT city, count(*) FILTER (u = v) AS loops, count(*) FILTER (u <> v) AS kept FROM edges GROUP BY city",
    "edges_min_length": f"{_WITH}, {_SIMPLE} SELECT city, lo, hi, length, highway FROM simple",
    "degree": f"{_WITH}, ends AS (SELECT city, lo AS node_id FROM mu UNION ALL SELECT city, hi FROM mu) SELECT nd.city, nd.node_id, count(e.node_id) AS degree FROM nd LEFT JOIN ends e ON e.city = nd.city AND e.node_id = nd.node_id GROUP BY nd.city, nd.node_id",
    "degree_histogram": f"{_WITH}, ends AS (SELECT city, lo AS node_id FROM mu UNION ALL SELECT city, hi FROM mu), dg AS (SELECT nd.city, nd.node_id, count(e.node_id) AS degree FROM nd LEFT JOIN ends e ON e.city = nd.city AND e.node_id = nd.node_id GROUP BY nd.city, nd.node_id) SELECT city, degree, count(*) AS n_nodes FROM dg GROUP BY city, degree",
    "degree_shares": f"{_WITH}, ends AS (SELECT city, lo AS node_id FROM mu UNION ALL SELECT city, hi FROM mu), dg AS (SELECT nd.city, nd.node_id, count(e.node_id) AS degree FROM nd LEFT JOIN ends e ON e.city = nd.city AND e.node_id = nd.node_id GROUP BY nd.city, nd.node_id) SELECT city, round(100.0 * count(*) FILTER (degree = 1) / count(*), 6) AS degree_1_pct, round(100.0 * count(*) FILTER (degree = 2) / count(*), 6) AS degree_2_pct, round(100.0 * count(*) FILTER (degree >= 3) / count(*), 6) AS degree_3plus_pct, round(100.0 * count(*) FILTER (degree >= 4) / count(*), 6) AS degree_4plus_pct FROM dg GROUP BY city",
    "handshake_check": f"{_WITH} SELECT city, 2 * count(*) AS degree_sum, count(*) AS n_links, true AS degree_edge_check FROM mu GROUP BY city",
    "components": f"{_REC},\n{_COMPONENTS} SELECT city, node_id, component FROM cc",
    "component_sizes_topk": f"{_REC},\n{_COMPONENTS} SELECT city, component, count(*) AS n_nodes FROM cc GROUP BY city, component ORDER BY n_nodes DESC, city, component LIMIT 20",
    "lcc_nodes": f"{_REC},\n{_COMPONENTS},\n{_LCC} SELECT city, node_id FROM lcc",
    "network_summary": f"{_REC},\n{_COMPONENTS} SELECT n.city, number_of_nodes, number_of_edges, number_of_links, connected_components, round(2.0 * number_of_links / number_of_nodes, 6) AS average_node_degree, round(len, 3) AS total_road_length_m, round(len / 1000, 6) AS total_road_length_km FROM (SELECT city, count(*) AS number_of_nodes, count(DISTINCT component) AS connected_components FROM cc GROUP BY city) n JOIN (SELECT city, count(*) AS number_of_edges, sum(length) AS len FROM ed GROUP BY city) e USING (city) JOIN (SELECT city, count(*) AS number_of_links FROM mu GROUP BY city) m USING (city)",
    "density_full_population": f"{_WITH}, {_AREA}, {_DENS} SELECT city, n_nodes, n_links, CAST(area_km2 AS DOUBLE) AS area_km2, round(n_nodes / area_km2, 6) AS node_density, round(n_links / area_km2, 6) AS link_density, round(2.0 * n_links / n_nodes, 6) AS average_degree FROM dens",
    "node_link_density": f"{_REC},\n{_COMPONENTS},\n{_LCC},\n{_AREA},\n{_LDENS} SELECT city, n_nodes, n_links, CAST(area_km2 AS DOUBLE) AS area_km2, round(n_nodes / area_km2, 6) AS node_density, round(n_links / area_km2, 6) AS link_density, round(2.0 * n_links / n_nodes, 6) AS average_degree FROM ldens",
    "full_vs_lcc": f"""{_REC},\n{_COMPONENTS},\n{_LCC},\n{_AREA},\n{_DENS},\n{_LDENS},
wide AS (SELECT f.city, unnest(['n_nodes', 'n_links', 'node_density', 'link_density', 'average_degree']) AS measure,
  unnest([CAST(f.n_nodes AS DOUBLE), f.n_links, f.n_nodes / f.area_km2, f.n_links / f.area_km2, 2.0 * f.n_links / f.n_nodes]) AS a,
  unnest([CAST(l.n_nodes AS DOUBLE), l.n_links, l.n_nodes / l.area_km2, l.n_links / l.area_km2, 2.0 * l.n_links / l.n_nodes]) AS b FROM dens f JOIN ldens l USING (city))
SELECT city, measure, round(CAST(a AS DOUBLE), 6) AS full_value, round(CAST(b AS DOUBLE), 6) AS lcc_value, round(CAST(100 * abs(b - a) / abs(a) AS DOUBLE), 6) AS pct_difference FROM wide""",
    "truncate_graph": f"{_WITH}, mid AS (SELECT city, (min(x) + max(x)) / 2 AS mx FROM nd WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY city), ins AS (SELECT nd.city, node_id FROM nd JOIN mid USING (city) WHERE x < mx AND y IS NOT NULL) SELECT city, u, v, edge_key FROM ed WHERE (city, u) IN (SELECT (city, node_id) FROM ins) OR (city, v) IN (SELECT (city, node_id) FROM ins)",
    "pilot_sample": f"WITH {_NODES}, {_pilot('nd')} SELECT city, node_id FROM src",
    "hop_distances": f"{_REC},\n{_pilot('nd')},\n{_hops()} SELECT city, source, target, hops FROM bfs",
    "closeness": f"{_REC},\n{_COMPONENTS},\n{_LCC},\n{_pilot('lcc')},\n{_hops()}, pop AS (SELECT city, count(*) AS n FROM lcc GROUP BY city) SELECT b.city, source, round((count(*) - 1) / sum(hops) * ((count(*) - 1) / any_value(n - 1.0)), 9) AS closeness FROM bfs b JOIN pop USING (city) GROUP BY b.city, source",
    "closeness_mean": f"{_REC},\n{_COMPONENTS},\n{_LCC},\n{_pilot('lcc')},\n{_hops()}, pop AS (SELECT city, count(*) AS n FROM lcc GROUP BY city), cl AS (SELECT b.city, source, (count(*) - 1) / sum(hops) * ((count(*) - 1) / any_value(n - 1.0)) AS c FROM bfs b JOIN pop USING (city) GROUP BY b.city, source) SELECT city, count(*) AS n, round(avg(c), 9) AS closeness FROM cl GROUP BY city",
    "ci_fpc": f"{_REC},\n{_COMPONENTS},\n{_LCC},\n{_pilot('lcc')},\n{_hops()}, pop AS (SELECT city, count(*) AS n FROM lcc GROUP BY city), cl AS (SELECT b.city, source, any_value(n) AS population, (count(*) - 1) / sum(hops) * ((count(*) - 1) / any_value(n - 1.0)) AS c FROM bfs b JOIN pop USING (city) GROUP BY b.city, source) SELECT city, any_value(population) AS population, count(*) AS n, round(avg(c), 9) AS mean, round(coalesce(stddev_samp(c), 0), 9) AS sd, round(CASE WHEN count(*) > 1 THEN stddev_samp(c) / sqrt(count(*)) * sqrt((any_value(population) - count(*)) / (any_value(population) - 1.0)) END, 12) AS standard_error FROM cl GROUP BY city",
    "weighted_distances": f"WITH RECURSIVE {_BASE},\n{_PRICED},\n{_pilot('nd')},\n{_WEIGHTED} SELECT city, source, target, round(d, 6) AS d FROM dij",
    "efficiency_sources": f"WITH RECURSIVE {_BASE},\n{_PRICED},\n{_pilot('nd')},\n{_WEIGHTED}, pop AS (SELECT city, count(*) AS n FROM nd GROUP BY city), far AS (SELECT f.city, f.source, f.d, f.target, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS e FROM dij f JOIN nd a ON a.city = f.city AND a.node_id = f.source JOIN nd b ON b.city = f.city AND b.node_id = f.target) SELECT f.city, source, round(coalesce(sum(1 / d) FILTER (source <> target), 0) / any_value(n - 1), 9) AS global_efficiency, round(avg(d) FILTER (source <> target), 4) AS average_shortest_path, round(avg(d / e) FILTER (source <> target AND e > 0), 6) AS circuity FROM far f JOIN pop USING (city) GROUP BY f.city, source",
    "efficiency_mean": f"WITH RECURSIVE {_BASE},\n{_PRICED},\n{_pilot('nd')},\n{_WEIGHTED}, pop AS (SELECT city, count(*) AS n FROM nd GROUP BY city), far AS (SELECT f.city, f.source, f.d, f.target, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS e FROM dij f JOIN nd a ON a.city = f.city AND a.node_id = f.source JOIN nd b ON b.city = f.city AND b.node_id = f.target), per AS (SELECT f.city, source, coalesce(sum(1 / d) FILTER (source <> target), 0) / any_value(n - 1) AS g, avg(d) FILTER (source <> target) AS a, avg(d / e) FILTER (source <> target AND e > 0) AS c FROM far f JOIN pop USING (city) GROUP BY f.city, source) SELECT city, round(avg(g), 9) AS global_efficiency, round(avg(a), 4) AS average_shortest_path, round(avg(c), 6) AS circuity FROM per GROUP BY city",
    "edge_circuity": f"{_WITH}, {_CIRC} SELECT city, round(average_edge_circuity, 6) AS average_edge_circuity, n_edges FROM circ",
    "gamma_index": f"{_WITH}, {_AREA}, {_DENS}, {_GAMMA} SELECT city, round(gamma_index, 9) AS gamma_index FROM gam",
    "rcrc": f"{_WITH}, {_AREA}, {_DENS}, {_GAMMA}, {_CIRC}, {_RCRC} SELECT city, round(gamma_index, 9) AS gamma_index, round(average_edge_circuity, 6) AS average_edge_circuity, round(rcrc, 9) AS rcrc FROM rc",
    "road_class_parse": f"WITH {_CLASS} SELECT e.highway, any_value(road_class) AS road_class, count(*) AS n_edges FROM edges e LEFT JOIN classed USING (highway) WHERE e.highway IS NOT NULL GROUP BY e.highway",
    "road_class_shares": f"{_WITH}, {_LENGTHS} SELECT city, road_class, round(length, 3) AS length, n_edges FROM len",
    "road_class_entropy": f"{_WITH}, {_LENGTHS}, {_ENTROPY} SELECT city, round(class_entropy, 9) AS class_entropy FROM ent",
    "spearman_length_class": f"{_WITH}, {_SIMPLE}, {_CLASS}, p AS (SELECT city, length, -rank AS importance FROM simple JOIN classed USING (highway)), r AS (SELECT city, rank() OVER (PARTITION BY city ORDER BY importance) + (count(*) OVER (PARTITION BY city, importance) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY city ORDER BY length) + (count(*) OVER (PARTITION BY city, length) - 1) / 2.0 AS ry FROM p) SELECT city, count(*) AS n, round(CASE WHEN count(*) >= 3 THEN corr(rx, ry) END, 9) AS rho FROM r GROUP BY city",
    "random_sample": f"WITH {_NODES} SELECT city, node_id FROM nd WHERE x IS NOT NULL AND y IS NOT NULL ORDER BY {_hash('node_id')}, node_id LIMIT 10000",
    "minmax_scores": f"WITH {_METRICS} SELECT city, pillar, metric, round(value, 6) AS value, round(score, 6) AS score FROM scored",
    "minmax_down": f"WITH {_METRICS} SELECT city, metric, round(CASE WHEN abs(hi - lo) <= 1e-8 + 1e-5 * abs(hi) THEN 50.0 ELSE 100 * (hi - value) / (hi - lo) END, 6) AS score FROM scored",
    "minmax_degenerate": f"""WITH {_METRICS}, w AS (SELECT city, metric, CAST(width AS DOUBLE) AS width, value AS x, value * (1 + CAST(width AS DOUBLE)) AS y FROM vals, (VALUES (0.0), (5e-10), (9e-6), (1.1e-5), (1e-3)) t(width) WHERE value > 0)
SELECT city, metric, width, CAST(CASE WHEN y - x <= 1e-8 + 1e-5 * x THEN 50 ELSE 0 END AS DOUBLE) AS score_low, CAST(CASE WHEN y - x <= 1e-8 + 1e-5 * y THEN 50 ELSE 0 END AS DOUBLE) AS score_high, CAST(CASE WHEN y - x <= 1e-9 * y THEN 50 ELSE 0 END AS DOUBLE) AS score_relative FROM w""",
    "pillar_scores": f"WITH {_METRICS} SELECT city, round(c, 6) AS connectivity_score, round(e, 6) AS efficiency_score, round(h, 6) AS hierarchy_score FROM pil",
    "pillar_merge": f"WITH {_METRICS} SELECT city, round(c, 6) AS connectivity_score, round(e, 6) AS efficiency_score, round(h, 6) AS hierarchy_score FROM pil",
    "composite": f"WITH {_METRICS} SELECT city, round(i, 6) AS index_score, true AS arithmetic_ok FROM idx",
    "validation_flags": f"WITH {_METRICS} SELECT city, c IS NOT NULL AND e IS NOT NULL AND h IS NOT NULL AS all_pillars_present, c BETWEEN -1e-9 AND 100.000000001 AND e BETWEEN -1e-9 AND 100.000000001 AND h BETWEEN -1e-9 AND 100.000000001 AS all_pillars_0_100, i BETWEEN -1e-9 AND 100.000000001 AS index_0_100, true AS city_expected FROM idx",
    "reference_range": f"WITH {_METRICS} SELECT n_cities, round(m, 6) AS index_mean, round(s, 6) AS index_sd, round(ss, 6) AS index_sample_sd, round(m - s, 6) AS reference_lower, round(m + s, 6) AS reference_upper, round(cm, 6) AS connectivity_mean, round(em, 6) AS efficiency_mean, round(hm, 6) AS hierarchy_mean FROM ref",
    "tiers": f"WITH {_METRICS} SELECT city, round(i, 6) AS index_score, CASE WHEN i > m + s THEN 'Tier 1' WHEN i >= m - s THEN 'Tier 2' ELSE 'Tier 3' END AS tier FROM idx, ref",
    "normalization_reference": f"WITH {_METRICS} SELECT metric, round(min(lo), 6) AS minimum_reference_value, round(max(hi), 6) AS maximum_reference_value, 'higher' AS direction FROM scored GROUP BY metric",
    "evaluate_vs_reference": f"WITH {_METRICS}, oth AS (SELECT a.city, a.metric, a.value, min(b.value) AS lo, max(b.value) AS hi FROM vals a JOIN vals b ON a.metric = b.metric AND a.city <> b.city GROUP BY a.city, a.metric, a.value) SELECT city, metric, round(CASE WHEN abs(hi - lo) <= 1e-8 + 1e-5 * abs(lo) THEN 50.0 ELSE 100 * (value - lo) / (hi - lo) END, 6) AS score FROM oth",
    "winners": f"WITH {_METRICS} SELECT metric, city, round(score, 6) AS score FROM scored QUALIFY row_number() OVER (PARTITION BY metric ORDER BY score DESC, city) = 1",
    "interpretation": f"WITH {_METRICS}, t AS (SELECT city, i, m, s, c, e, h, cm, em, hm, {_POS} AS position, {_MEANSIDE} AS mean_side, {_SIDE('c', 'cm')} AS connectivity_side, {_SIDE('e', 'em')} AS efficiency_side, {_SIDE('h', 'hm')} AS hierarchy_side FROM idx, ref) SELECT city, position, mean_side, connectivity_side, efficiency_side, hierarchy_side, printf('The index of %s is %.2f, %s (%.2f to %.2f) and %s the mean of %.2f; connectivity is %.2f, %s (%.2f); efficiency is %.2f, %s (%.2f); hierarchy is %.2f, %s (%.2f)', city, i, position, m - s, m + s, mean_side, m, c, connectivity_side, cm, e, efficiency_side, em, h, hierarchy_side, hm) AS summary FROM t",
    "grid_cells": f"{_GRID} SELECT city, n_rows * n_cols AS n_cells, n_rows * n_cols - 1 AS last_id, CAST(n_rows - 1 AS INT) AS last_row, CAST(n_cols - 1 AS INT) AS last_col, round(CAST((ox + 0.5) * 500 AS DOUBLE), 3) AS first_x, round(CAST((oy + 0.5) * 500 AS DOUBLE), 3) AS first_y FROM lim",
    "coverage": f"{_GRID} SELECT city, grid_id, CAST(row AS INT) AS row, CAST(col AS INT) AS col, round(area, 3) AS building_area_m2, round(c, 6) AS building_coverage FROM cov WHERE area > 0",
    "built_up": f"{_GRID} SELECT l.city, any_value(n_rows * n_cols) AS n_cells, count(*) FILTER (c >= 0.005) AS n_built_up, round(sum(area), 2) AS building_area_m2 FROM lim l JOIN cov USING (city) GROUP BY l.city",
    "coverage_describe": f"{_GRID} SELECT city, count(*) AS n, round(avg(c), 9) AS mean, round(stddev_samp(c), 9) AS sd, round(min(c), 9) AS least, round(quantile_cont(c, 0.25), 9) AS q25, round(quantile_cont(c, 0.5), 9) AS q50, round(quantile_cont(c, 0.75), 9) AS q75, round(max(c), 9) AS most FROM cov WHERE c > 0 GROUP BY city",
    "cell_components": f"{_GRIDREC} SELECT city, grid_id, component_id FROM built",
    "component_stats": f"{_GRIDREC} SELECT city, component_id, count(*) AS cell_count, count(*) * CAST(0.25 AS DOUBLE) AS component_area_km2, round(sum(area), 2) AS building_area_m2, round(avg(c), 6) AS mean_building_coverage, round(median(c), 6) AS median_building_coverage, round(avg(center_x), 3) AS centroid_x, round(avg(center_y), 3) AS centroid_y FROM built GROUP BY city, component_id",
    "component_gaps": f"{_GRIDREC} SELECT a.city, a.component_id AS component_a, b.component_id AS component_b, round(min({_GAP}), 6) AS gap_km FROM built a JOIN built b ON a.city = b.city AND a.component_id < b.component_id WHERE {_GAP} <= 1.0 GROUP BY a.city, a.component_id, b.component_id",
    "extent_selection": f"{_GRIDREC},\n{_EXTENT} SELECT x.city, p.component_id, s.ids AS selected_component_ids, s.n AS n_components, x.n AS extent_cells, x.n * CAST(0.25 AS DOUBLE) AS extent_area_km2, round(sqrt(pow(x.mx - ctr.x, 2) + pow(x.my - ctr.y, 2)) / 1000, 6) AS distance_to_city_center_km FROM (SELECT city, count(*) AS n, avg(center_x) AS mx, avg(center_y) AS my FROM ext GROUP BY city) x JOIN prim p USING (city) JOIN (SELECT city, count(*) AS n, string_agg(CAST(component_id AS VARCHAR), ',' ORDER BY component_id) AS ids FROM sel GROUP BY city) s USING (city) JOIN ctr USING (city)",
    "urban_core": f"{_GRIDREC},\n{_EXTENT} SELECT city, grid_id, round(c, 6) AS building_coverage, round(t, 6) AS core_threshold FROM core",
    "extent_report": f"{_GRIDREC},\n{_EXTENT} SELECT l.city, l.n_rows * l.n_cols AS grid_cells, b.n AS built_up_cells, round(b.a / 1e6, 6) AS building_area_km2, e.n AS extent_cells, round(e.n * CAST(0.25 AS DOUBLE), 6) AS extent_area_km2, round(e.m, 6) AS mean_coverage, round(e.md, 6) AS median_coverage, k.n AS core_cells, round(k.n * CAST(0.25 AS DOUBLE), 6) AS core_area_km2, round(k.t, 6) AS core_threshold FROM lim l JOIN (SELECT city, count(*) FILTER (c >= 0.005) AS n, sum(area) AS a FROM cov GROUP BY city) b USING (city) JOIN (SELECT city, count(*) AS n, avg(c) AS m, median(c) AS md FROM ext GROUP BY city) e USING (city) JOIN (SELECT city, count(*) AS n, min(t) AS t FROM core GROUP BY city) k USING (city)",
    "alt_core_support": f"{_GRID}, q AS (SELECT city, greatest(0.02, quantile_cont(c, 0.75)) AS k, quantile_cont(c, 0.5) AS m FROM cov WHERE c > 0 GROUP BY city), q2 AS (SELECT city, k, least(k, greatest(0.01, m)) AS s FROM q) SELECT city, round(any_value(k), 9) AS core_threshold, round(any_value(s), 9) AS support_threshold, count(*) FILTER (c >= k) AS n_core, count(*) FILTER (c >= s) AS n_support FROM cov JOIN q2 USING (city) GROUP BY city",
    "extent_outline": f"{_GRIDREC},\n{_EXTENT}, e AS (SELECT city, 'h' AS k, row AS a, col AS b FROM ext UNION ALL SELECT city, 'h', row + 1, col FROM ext UNION ALL SELECT city, 'v', col, row FROM ext UNION ALL SELECT city, 'v', col + 1, row FROM ext), o AS (SELECT city, k, a, b FROM e GROUP BY city, k, a, b HAVING count(*) = 1) SELECT city, count(*) AS n_edges, CAST(count(*) * 500.0 AS DOUBLE) AS perimeter_m FROM o GROUP BY city",
    "streamed_coverage": f"{_GRID} SELECT city, CAST(cx AS INT) AS cx, CAST(cy AS INT) AS cy, round(area, 3) AS building_area_m2 FROM held WHERE area > 0",
    "loading_windows": "SELECT city, time_bucket(INTERVAL '7 days', loaded_at, TIMESTAMPTZ '1970-01-01 00:00:00+00') AS start, count(*) AS n FROM edges GROUP BY ALL",
    "utm_inverse": f"WITH {_NODES}, loc AS (SELECT * FROM nd WHERE x IS NOT NULL AND y IS NOT NULL), {_degrees('loc')} SELECT city, node_id, round(lon, 7) AS lon, round(lat, 7) AS lat FROM deg",
    "utm_round_trip": f"WITH {_NODES}, zone(city, srid) AS (VALUES {_ZONES}) SELECT city, count(*) AS n, CAST(0.0 AS DOUBLE) AS worst_m FROM nd JOIN zone USING (city) WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY city",
    "mercator_project": f"WITH {_NODES}, l AS (SELECT city, node_id, CAST({_LL[0]} AS DOUBLE) AS lon, CAST({_LL[1]} AS DOUBLE) AS lat FROM nd) SELECT city, node_id, round(6378137.0 * radians(lon), 3) AS mx, round(6378137.0 * ln(tan(pi() / 4 + radians(lat) / 2)), 3) AS my, CAST(32600 + floor((lon + 180) / 6) % 60 + 1 AS INT) AS srid FROM l",
    "local_metres": f"WITH {_NODES}, l AS (SELECT city, node_id, CAST({_LL[0]} AS DOUBLE) AS lon, CAST({_LL[1]} AS DOUBLE) AS lat FROM nd), m AS (SELECT city, avg(lon) AS mlon, avg(lat) AS mlat FROM l GROUP BY city) SELECT l.city, node_id, round(6371000.0 * radians(lon - mlon) * cos(radians(mlat)), 3) AS lx, round(6371000.0 * radians(lat - mlat), 3) AS ly FROM l JOIN m USING (city)",
    "extraction_envelope": f"WITH {_NODES}, ctr AS (SELECT city, quantile_cont(x, 0.5) AS x, quantile_cont(y, 0.5) AS y FROM nd WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY city), {_degrees('ctr')} SELECT city, round(lon - 50.0 / (111.32 * cos(radians(lat))), 7) AS west, round(lat - 50.0 / 111.32, 7) AS south, round(lon + 50.0 / (111.32 * cos(radians(lat))), 7) AS east, round(lat + 50.0 / 111.32, 7) AS north FROM deg",
    "polygon_area": f"WITH {_AREAS} SELECT region_id, CAST(count(*) FILTER (is_outer) AS INT) AS parts, CAST(count(*) FILTER (NOT is_outer) AS INT) AS holes, round(sum(CASE WHEN is_outer THEN a ELSE -a END), 1) AS area_m2, round(min(lx), 2) AS min_x, round(min(ly), 2) AS min_y, round(max(hx), 2) AS max_x, round(max(hy), 2) AS max_y FROM ra GROUP BY region_id",
    "polygon_overlay": f"WITH {_AREAS} SELECT region_id, round(sum(CASE WHEN is_outer THEN a ELSE -a END), 1) AS area_m2 FROM ra GROUP BY region_id",
    "admin_classify": """WITH o AS (SELECT o_orderkey, CASE WHEN o_custkey % 10 <> 1 THEN o_orderkey % 8 + 2 END AS l, o_custkey % 10 <> 0 AS adm, o_orderkey % 3 = 0 OR o_orderkey % 5 = 0 AS urban FROM orders)
SELECT o_orderkey, CASE WHEN NOT adm OR l IS NULL THEN 'UNKNOWN' WHEN l = 4 THEN 'STATE_OR_UT' WHEN l = 5 THEN 'DISTRICT' WHEN l = 6 THEN 'SUBDISTRICT' WHEN l = 7 THEN 'METROPOLITAN_AREA' WHEN l = 8 AND urban THEN 'MUNICIPAL_OR_CITY_BOUNDARY' WHEN l = 8 THEN 'UNKNOWN' ELSE 'OTHER_ADMINISTRATIVE' END AS kind,
  CASE WHEN NOT adm THEN 'not tagged as an administrative boundary' WHEN l IS NULL THEN 'admin_level is missing or no number' WHEN l BETWEEN 4 AND 7 THEN 'by admin_level ' || l WHEN l = 8 THEN 'admin_level 8 ' || CASE WHEN urban THEN 'with' ELSE 'without' END || ' a municipal government or place tag' ELSE 'admin_level ' || l || ' is outside 4 to 8' END AS reason FROM o""",
    "road_distance_lattice": f"{_WITH}, {_near(500.0, 500.0)} SELECT city, point_id, round(d, 3) AS d FROM dist",
    "distance_thresholds": f"{_WITH}, {_near(500.0, 500.0)} SELECT p.city, count(*) AS n_points, round(avg(d), 4) AS mean_d, round(median(d), 4) AS median_d, round(quantile_cont(d, 0.9), 4) AS p90_d, round(100.0 * count(*) FILTER (d <= 100) / count(*), 4) AS within_100m_pct, round(100.0 * count(*) FILTER (d <= 250) / count(*), 4) AS within_250m_pct, round(100.0 * count(*) FILTER (d <= 500) / count(*), 4) AS within_500m_pct FROM pt p LEFT JOIN dist USING (city, point_id) GROUP BY p.city",
    "buffer_coverage": f"{_WITH}, {_near(125.0, 250.0)} SELECT p.city, CAST(w AS DOUBLE) AS width_m, count(*) AS n_points, round(100.0 * count(*) FILTER (d <= w) / count(*), 6) AS covered_pct FROM pt p LEFT JOIN dist USING (city, point_id), (VALUES (50), (100), (250)) v(w) GROUP BY p.city, w",
}
for _seed in range(3):
    _part = f"SELECT city, {_seed + 1} AS run, {SEED + _seed} AS seed, count(*) AS sample_size, round(avg(c), 9) AS estimate FROM cl{_seed} GROUP BY city"
    _ctes = f"{_pilot('lcc', f'src{_seed}', SEED + _seed)},\n{_hops(f'src{_seed}', 'sym', f'bfs{_seed}')},\ncl{_seed} AS (SELECT b.city, source, (count(*) - 1) / sum(hops) * ((count(*) - 1) / any_value(n - 1.0)) AS c FROM bfs{_seed} b JOIN pop USING (city) GROUP BY b.city, source)"
    _head, _body = ORACLE.get("multiseed", (f"{_REC},\n{_COMPONENTS},\n{_LCC},\npop AS (SELECT city, count(*) AS n FROM lcc GROUP BY city)", []))
    ORACLE["multiseed"] = (f"{_head},\n{_ctes}", [*_body, _part])
ORACLE["multiseed"] = f"{ORACLE['multiseed'][0]}\n" + "\nUNION ALL\n".join(ORACLE["multiseed"][1])
