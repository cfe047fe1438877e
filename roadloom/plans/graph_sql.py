"""SQL of the iterative graph and geometry queries: recursive where the operators loop, by other algorithms where SQL has better ones."""

from __future__ import annotations

from roadloom.functions import defaults
from roadloom.plans import network_sql as q
from roadloom.plans.network import SEED


def weighted(sources: str, graph: str, name: str) -> str:
    """Distances from the sources over a table graph(city, lo, hi, length), with its symmetric form {name}_sym."""
    return f"""{name}_sym AS (SELECT city, lo AS a, hi AS b, length FROM {graph} UNION ALL SELECT city, hi, lo, length FROM {graph}),
{name}(city, source, target, d) USING KEY (city, source, target) AS (
  SELECT city, node_id, node_id, CAST(0 AS DOUBLE) FROM {sources}
  UNION
  SELECT f.city, f.source, s.b, min(f.d + s.length) FROM {name} f JOIN {name}_sym s ON s.city = f.city AND s.a = f.target
  LEFT JOIN recurring.{name} r ON r.city = f.city AND r.source = f.source AND r.target = s.b
  GROUP BY f.city, f.source, s.b, r.d HAVING r.d IS NULL OR min(f.d + s.length) < r.d)"""


def ranked(source: str, seed: int = SEED) -> str:
    """The nodes of source with their place in the sampling order and their city's population."""
    return f"SELECT city, node_id, count(*) OVER (PARTITION BY city) AS population, row_number() OVER (PARTITION BY city ORDER BY {q._hash('node_id', seed)}, node_id) AS r FROM {source}"


# Path counts run forwards and dependencies backwards along the edges of shortest paths, a step at a time; what arrives at a
# node by several steps is summed up afterwards, as both are linear.
_BETWEEN = f"""bsrc AS (SELECT city, node_id FROM ({ranked('nd')}) WHERE r <= least(population, least(500, greatest(100, ceil(0.005 * population))))),
{weighted('bsrc', 'simple', 'bd')},
spe AS (SELECT d.city, d.source, d.target AS u, s.b AS v FROM bd d JOIN bd_sym s ON s.city = d.city AND s.a = d.target JOIN bd e ON e.city = d.city AND e.source = d.source AND e.target = s.b WHERE d.d + s.length = e.d AND d.d < e.d),
walk(city, source, node, k, c) AS (
  SELECT city, node_id, node_id, 0, CAST(1 AS DOUBLE) FROM bsrc
  UNION ALL
  SELECT w.city, w.source, p.v, w.k + 1, sum(w.c) FROM walk w JOIN spe p ON p.city = w.city AND p.source = w.source AND p.u = w.node GROUP BY w.city, w.source, p.v, w.k),
sigma AS (SELECT city, source, node, sum(c) AS s FROM walk GROUP BY city, source, node),
part AS (SELECT p.*, a.s / b.s AS share FROM spe p JOIN sigma a ON a.city = p.city AND a.source = p.source AND a.node = p.u JOIN sigma b ON b.city = p.city AND b.source = p.source AND b.node = p.v),
back(city, source, node, k, f) AS (
  SELECT city, source, target, 0, CAST(1 AS DOUBLE) FROM bd WHERE source <> target
  UNION ALL
  SELECT b.city, b.source, p.u, b.k + 1, sum(b.f * p.share) FROM back b JOIN part p ON p.city = b.city AND p.source = b.source AND p.v = b.node GROUP BY b.city, b.source, p.u, b.k),
flow AS (SELECT city, source, node, sum(f) AS f FROM back GROUP BY city, source, node),
used AS (SELECT p.city, least(u, v) AS lo, greatest(u, v) AS hi, sum(f.f * p.share) AS share FROM flow f JOIN part p ON p.city = f.city AND p.source = f.source AND p.v = f.node GROUP BY p.city, least(u, v), greatest(u, v)),
many AS (SELECT city, count(*) AS n FROM nd GROUP BY city),
picked AS (SELECT city, count(*) AS k FROM bsrc GROUP BY city),
btw AS (SELECT city, lo, hi, coalesce(share, 0) / (k * greatest(1, n - 1)) AS betweenness, highway FROM simple LEFT JOIN used USING (city, lo, hi) JOIN many USING (city) JOIN picked USING (city))"""
_CLARITY = """cp AS (SELECT city, -rank AS importance, round(betweenness, 12) AS betweenness FROM btw JOIN classed USING (highway)),
cr AS (SELECT city, rank() OVER (PARTITION BY city ORDER BY importance) + (count(*) OVER (PARTITION BY city, importance) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY city ORDER BY betweenness) + (count(*) OVER (PARTITION BY city, betweenness) - 1) / 2.0 AS ry FROM cp),
clarity AS (SELECT city, count(*) AS n, CASE WHEN count(*) >= 3 THEN corr(rx, ry) END AS rho FROM cr GROUP BY city)"""

# Chains: inner nodes have two neighbours; a chain's label is its smallest inner node.
_SIMPLIFY = """ssym AS (SELECT city, lo AS a, hi AS b FROM simple UNION ALL SELECT city, hi, lo FROM simple),
inn AS (SELECT city, a AS node_id FROM ssym GROUP BY city, a HAVING count(*) = 2),
isym AS (SELECT s.* FROM ssym s JOIN inn x ON x.city = s.city AND x.node_id = s.a JOIN inn y ON y.city = s.city AND y.node_id = s.b),
ic(city, node_id, chain) USING KEY (city, node_id) AS (
  SELECT city, node_id, node_id FROM inn
  UNION
  SELECT s.city, s.b, min(c.chain) FROM ic c JOIN isym s ON s.city = c.city AND s.a = c.node_id
  JOIN recurring.ic r ON r.city = s.city AND r.node_id = s.b WHERE c.chain < r.chain GROUP BY s.city, s.b),
owned AS (SELECT s.*, a.chain AS ca, b.chain AS cb FROM simple s LEFT JOIN ic a ON a.city = s.city AND a.node_id = s.lo LEFT JOIN ic b ON b.city = s.city AND b.node_id = s.hi),
merged AS (SELECT city, coalesce(ca, cb) AS chain, sum(length) AS length, count(*) AS n_segments, list_sort(list_filter(flatten(list([CASE WHEN ca IS NULL THEN lo END, CASE WHEN cb IS NULL THEN hi END])), lambda e: e IS NOT NULL)) AS ends FROM owned WHERE ca IS NOT NULL OR cb IS NOT NULL GROUP BY city, coalesce(ca, cb)),
simplified AS (
  SELECT city, lo, hi, length, CAST(1 AS BIGINT) AS n_segments FROM owned WHERE ca IS NULL AND cb IS NULL
  UNION ALL SELECT city, coalesce(ends[1], chain), coalesce(ends[2], ends[1], chain), length, n_segments FROM merged)"""

# Blocks of a graph: a breadth-first tree, and the tree edges on the cycle that each other edge closes belong together.
_BLOCKS = f"""pairs AS (SELECT DISTINCT city, lo, hi FROM mu),
root AS (SELECT DISTINCT city, component AS node_id FROM cc),
{q._hops('root', 'sym', 'tree')},
depth AS (SELECT city, target AS node, hops FROM tree),
up AS (SELECT d.city, d.node, min(s.a) AS parent, any_value(d.hops) AS hops FROM depth d JOIN sym s ON s.city = d.city AND s.b = d.node JOIN depth p ON p.city = d.city AND p.node = s.a AND p.hops = d.hops - 1 GROUP BY d.city, d.node),
other AS (SELECT p.* FROM pairs p LEFT JOIN up a ON a.city = p.city AND a.node = p.lo AND a.parent = p.hi LEFT JOIN up b ON b.city = p.city AND b.node = p.hi AND b.parent = p.lo WHERE a.node IS NULL AND b.node IS NULL),
climb(city, lo, hi, x, y, dx, dy) AS (
  SELECT o.city, o.lo, o.hi, o.lo, o.hi, a.hops, b.hops FROM other o JOIN depth a ON a.city = o.city AND a.node = o.lo JOIN depth b ON b.city = o.city AND b.node = o.hi
  UNION ALL
  SELECT c.city, c.lo, c.hi, CASE WHEN dx >= dy THEN a.parent ELSE x END, CASE WHEN dy >= dx THEN b.parent ELSE y END, CASE WHEN dx >= dy THEN dx - 1 ELSE dx END, CASE WHEN dy >= dx THEN dy - 1 ELSE dy END
  FROM climb c LEFT JOIN up a ON a.city = c.city AND a.node = c.x LEFT JOIN up b ON b.city = c.city AND b.node = c.y WHERE c.x <> c.y),
covers AS (SELECT city, lo, hi, x AS child FROM climb WHERE x <> y AND dx >= dy UNION ALL SELECT city, lo, hi, y FROM climb WHERE x <> y AND dy >= dx),
firsts AS (SELECT city, lo, hi, min(child) AS m FROM covers GROUP BY city, lo, hi),
bsym AS (SELECT c.city, c.child AS a, f.m AS b FROM covers c JOIN firsts f USING (city, lo, hi) UNION SELECT c.city, f.m, c.child FROM covers c JOIN firsts f USING (city, lo, hi)),
blk(city, child, block) USING KEY (city, child) AS (
  SELECT city, node, node FROM up
  UNION
  SELECT s.city, s.b, min(c.block) FROM blk c JOIN bsym s ON s.city = c.city AND s.a = c.child
  JOIN recurring.blk r ON r.city = s.city AND r.child = s.b WHERE c.block < r.block GROUP BY s.city, s.b),
touch AS (SELECT b.city, u.node, b.block FROM blk b JOIN up u ON u.city = b.city AND u.node = b.child UNION SELECT b.city, u.parent, b.block FROM blk b JOIN up u ON u.city = b.city AND u.node = b.child),
weak AS (
  SELECT city, 'articulation' AS kind, node AS a, CAST(NULL AS BIGINT) AS b FROM touch GROUP BY city, node HAVING count(*) > 1
  UNION ALL SELECT u.city, 'bridge', least(u.node, u.parent), greatest(u.node, u.parent) FROM up u LEFT JOIN (SELECT DISTINCT city, child FROM covers) c ON c.city = u.city AND c.child = u.node WHERE c.child IS NULL)"""

# Hulls by wrapping: from the leftmost point, each step turns as little as it can.
_HULL = """loc AS (SELECT DISTINCT city, x, y FROM nd WHERE x IS NOT NULL AND y IS NOT NULL),
begin AS (SELECT city, min({'x': x, 'y': y}) AS p FROM loc GROUP BY city),
wrap(city, k, x, y, ux, uy) AS (
  SELECT city, 0, p.x, p.y, CAST(0 AS DOUBLE), CAST(-1 AS DOUBLE) FROM begin
  UNION ALL
  SELECT city, k + 1, n.x, n.y, n.x - px, n.y - py FROM (
    SELECT w.city, w.k, any_value(w.x) AS px, any_value(w.y) AS py, arg_min({'x': l.x, 'y': l.y}, {'turn': round(CASE WHEN t < 0 THEN t + 2 * pi() ELSE t END, 12), 'near': -d}) AS n
    FROM (SELECT w.city, w.k, w.x, w.y, l.x AS lx, l.y AS ly, atan2(w.ux * (l.y - w.y) - w.uy * (l.x - w.x), w.ux * (l.x - w.x) + w.uy * (l.y - w.y)) AS t, (l.x - w.x) * (l.x - w.x) + (l.y - w.y) * (l.y - w.y) AS d FROM wrap w JOIN loc l ON l.city = w.city AND (l.x <> w.x OR l.y <> w.y)) w, (SELECT w.lx AS x, w.ly AS y) l
    GROUP BY w.city, w.k) s JOIN begin b USING (city) WHERE k = 0 OR px <> b.p.x OR py <> b.p.y),
turned AS (SELECT city, k, x, y, lead(x) OVER o AS nx, lead(y) OVER o AS ny, first_value(x) OVER o AS ox, first_value(y) OVER o AS oy FROM wrap WINDOW o AS (PARTITION BY city ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
hulls AS (SELECT city, CAST(count(*) AS INT) AS corners, abs(sum((x - ox) * (ny - oy) - (nx - ox) * (y - oy))) / 2 AS area FROM turned WHERE nx IS NOT NULL GROUP BY city)"""

# The circle has 64 corners; in each row of cells it spans one run of columns, as it is convex.
_SEARCH = """ctr AS (SELECT city, quantile_cont(x, 0.5) AS x, quantile_cont(y, 0.5) AS y FROM nd WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY city),
corner AS (SELECT city, i, x + 15000.0 * cos(i * pi() / 32) AS x, y + 15000.0 * sin(i * pi() / 32) AS y FROM ctr, range(64) r(i)),
side AS (SELECT a.city, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS by1 FROM corner a JOIN corner b ON b.city = a.city AND b.i = (a.i + 1) % 64),
strip AS (SELECT city, unnest(range(CAST(floor(min(y) / 500) AS BIGINT), CAST(ceil(max(y) / 500) AS BIGINT))) AS cy FROM corner GROUP BY city),
span AS (
  SELECT s.city, s.cy, c.x FROM strip s JOIN corner c ON c.city = s.city AND c.y BETWEEN s.cy * 500 AND (s.cy + 1) * 500
  UNION ALL SELECT s.city, s.cy, e.ax + (h.v - e.ay) / (e.by1 - e.ay) * (e.bx - e.ax) FROM strip s, (SELECT unnest([0, 1]) AS up) u, LATERAL (SELECT (s.cy + u.up) * 500.0 AS v) h, side e WHERE e.city = s.city AND least(e.ay, e.by1) <= h.v AND greatest(e.ay, e.by1) >= h.v AND e.ay <> e.by1),
runs AS (SELECT city, cy, ceil(max(x) / 500) - floor(min(x) / 500) AS n FROM span GROUP BY city, cy)"""

# Support cells within 15 km of the centre, by quantiles of what is covered there.
_ALTERNATIVE = f"""ctr AS (SELECT city, quantile_cont(x, 0.5) AS x, quantile_cont(y, 0.5) AS y FROM nd WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY city),
near AS (SELECT cov.* FROM cov JOIN ctr USING (city) WHERE sqrt(pow(center_x - x, 2) + pow(center_y - y, 2)) <= 15000),
cut AS (SELECT city, greatest(0.02, quantile_cont(c, 0.75)) AS k, quantile_cont(c, 0.5) AS m FROM near WHERE c > 0 GROUP BY city),
sup AS (SELECT near.*, c >= k AS core FROM near JOIN cut USING (city) WHERE c >= least(k, greatest(0.01, m))),
sadj AS (SELECT a.city, a.grid_id AS a, b.grid_id AS b FROM sup a JOIN sup b ON a.city = b.city AND abs(a.row - b.row) <= 1 AND abs(a.col - b.col) <= 1 AND a.grid_id <> b.grid_id),
sc(city, grid_id, component_id) USING KEY (city, grid_id) AS (
  SELECT city, grid_id, grid_id FROM sup
  UNION
  SELECT s.city, s.b, min(c.component_id) FROM sc c JOIN sadj s ON s.city = c.city AND s.a = c.grid_id
  JOIN recurring.sc r ON r.city = s.city AND r.grid_id = s.b WHERE c.component_id < r.component_id GROUP BY s.city, s.b),
parts AS (SELECT city, component_id, count(*) FILTER (core) AS core_count, count(*) AS cell_count, count(*) FILTER (core) * CAST(0.25 AS DOUBLE) AS core_area_km2 FROM sup JOIN sc USING (city, grid_id) GROUP BY city, component_id)"""

#: Student's t by bisection over its finite series for whole degrees of freedom, for as many of them as nodes of a city.
_T = f"""freedom AS (SELECT unnest(range(1, (SELECT max(n) FROM many))) AS f),
factor AS (SELECT k, CASE WHEN k = 0 THEN 0 ELSE ln((2 * k - 1) / (2.0 * k)) END AS e, CASE WHEN k = 0 THEN 0 ELSE ln(2.0 * k / (2 * k + 1)) END AS o FROM (SELECT unnest(range(0, (SELECT max(n) // 2 + 2 FROM many))) AS k)),
series AS (SELECT list(ce ORDER BY k) AS e, list(co ORDER BY k) AS o FROM (SELECT k, exp(sum(e) OVER (ORDER BY k)) AS ce, exp(sum(o) OVER (ORDER BY k)) AS co FROM factor)),
tq(f, lo, hi, i) AS (
  SELECT f, CAST(1.9 AS DOUBLE), CAST(13 AS DOUBLE), 0 FROM freedom
  UNION ALL
  SELECT f, CASE WHEN inside < {defaults.CONFIDENCE} THEN mid ELSE lo END, CASE WHEN inside < {defaults.CONFIDENCE} THEN hi ELSE mid END, i + 1 FROM (
    SELECT f, lo, hi, i, mid, CASE WHEN f = 1 THEN 2 / pi() * a WHEN f % 2 = 0 THEN sin(a) * list_sum(list_transform(range(0, f // 2), lambda k: e[k + 1] * pow(cos(a), 2 * k)))
      ELSE 2 / pi() * (a + sin(a) * cos(a) * list_sum(list_transform(range(0, (f - 1) // 2), lambda k: o[k + 1] * pow(cos(a), 2 * k)))) END AS inside
    FROM (SELECT f, lo, hi, i, (lo + hi) / 2 AS mid, atan((lo + hi) / 2 / sqrt(f)) AS a, e, o FROM tq, series WHERE i < 50))),
crit AS (SELECT f, (lo + hi) / 2 AS t FROM tq WHERE i = 50)"""


def _needed(n: str, mean: str, sd: str, t: str) -> str:
    h, s = f"(abs({mean}) * {defaults.PRECISION})", f"({t} * {sd})"
    return f"CAST(ceil({n} * {s} * {s} / (({n} - 1) * {h} * {h} + {s} * {s})) AS BIGINT)"


# The pilot, the size that the precision needs (a fixed point over the size), and the whole sample.
_CLOSE = f"""many AS (SELECT city, count(*) AS n FROM nd GROUP BY city),
{_T},
lord AS ({ranked('lcc')}),
lpilot AS (SELECT city, node_id FROM lord WHERE r <= least(greatest(2, ceil({defaults.PILOT_FRACTION} * population)), population)),
{q._hops('lpilot', 'sym', 'ph')},
lpop AS (SELECT city, count(*) AS n FROM lcc GROUP BY city),
pc AS (SELECT b.city, source, CASE WHEN sum(hops) > 0 THEN (count(*) - 1) / sum(hops) * ((count(*) - 1) / any_value(n - 1.0)) ELSE 0 END AS c FROM ph b JOIN lpop USING (city) GROUP BY b.city, source),
pst AS (SELECT city, any_value(n) AS population, count(*) AS pilot, avg(c) AS mean, coalesce(stddev_samp(c), 0) AS sd FROM pc JOIN lpop USING (city) GROUP BY city),
fix(city, n, i) AS (
  SELECT city, least(greatest(pilot, {_needed('population', 'mean', 'sd', 't')}), population), 0 FROM pst JOIN crit ON f = greatest(pilot - 1, 1) WHERE abs(mean) > 0 AND sd > 0
  UNION ALL
  SELECT fix.city, least(greatest(pilot, {_needed('population', 'mean', 'sd', 't')}), population), i + 1 FROM fix JOIN pst USING (city) JOIN crit ON f = greatest(fix.n - 1, 1) WHERE i < 20),
wanted AS (SELECT pst.city, population, pilot, coalesce(last.n, CASE WHEN abs(mean) > 0 THEN pilot ELSE population END) AS n FROM pst LEFT JOIN (SELECT city, arg_max(n, i) AS n FROM fix GROUP BY city) last USING (city)),
lsrc AS (SELECT lord.city, node_id FROM lord JOIN wanted USING (city) WHERE r <= n),
{q._hops('lsrc', 'sym', 'fh')},
fc AS (SELECT b.city, source, CASE WHEN sum(hops) > 0 THEN (count(*) - 1) / sum(hops) * ((count(*) - 1) / any_value(n - 1.0)) ELSE 0 END AS c FROM fh b JOIN lpop USING (city) GROUP BY b.city, source),
fst AS (SELECT w.city, w.population, w.pilot, w.n, count(*) AS finite, avg(c) AS mean, coalesce(stddev_samp(c), 0) AS sd FROM fc JOIN wanted w USING (city) GROUP BY w.city, w.population, w.pilot, w.n),
close AS (SELECT fst.*, sd / sqrt(finite) * sqrt((population - finite) / (population - 1.0)) AS se, t * sd / sqrt(finite) * sqrt((population - finite) / (population - 1.0)) AS margin FROM fst JOIN crit ON f = finite - 1)"""



def _efficiency(sources: str, name: str) -> str:
    """Per source the three measures of path lengths."""
    return f"""{weighted(sources, 'priced', f'{name}d')},
{name}far AS (SELECT f.city, f.source, f.d, f.target, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS e FROM {name}d f JOIN nd a ON a.city = f.city AND a.node_id = f.source JOIN nd b ON b.city = f.city AND b.node_id = f.target),
{name} AS (SELECT f.city, source, coalesce(sum(1 / d) FILTER (source <> target), 0) / any_value(n - 1) AS global_efficiency, avg(d) FILTER (source <> target) AS average_shortest_path, avg(d / e) FILTER (source <> target AND e > 0) AS circuity FROM {name}far f JOIN many USING (city) GROUP BY f.city, source)"""


_THREE = ("global_efficiency", "average_shortest_path", "circuity")
# The size for three measures at once is a fixed point over the critical value, and the largest of them counts.
_SWEPT = f"""nord AS ({ranked('nd')}),
npilot AS (SELECT city, node_id FROM nord WHERE r <= least(greatest(2, ceil({defaults.PILOT_FRACTION} * population)), population)),
npop AS (SELECT city, count(*) AS pilot FROM npilot GROUP BY city),
{_efficiency('npilot', 'pe')},
pl AS ({' UNION ALL '.join(f"SELECT city, '{c}' AS metric, {c} AS v FROM pe" for c in _THREE)}),
pm AS (SELECT pl.city, metric, n AS population, pilot, count(v) AS finite, avg(v) AS mean, coalesce(stddev_samp(v), 0) AS sd FROM pl JOIN many USING (city) JOIN npop USING (city) GROUP BY pl.city, metric, n, pilot),
efix(city, metric, n, t, i) AS (
  SELECT city, metric, pilot, t, 0 FROM pm JOIN crit ON f = greatest(pilot - 1, 1) WHERE finite >= 2 AND abs(mean) > 0 AND sd > 0
  UNION ALL
  SELECT s.city, s.metric, s.n, c.t, i + 1 FROM (SELECT efix.city, efix.metric, i, least(greatest(pilot, {_needed('population', 'mean', 'sd', 'efix.t')}), population) AS n FROM efix JOIN pm ON pm.city = efix.city AND pm.metric = efix.metric WHERE i < 20) s JOIN crit c ON c.f = greatest(s.n - 1, 1)),
esize AS (SELECT pm.city, max(CASE WHEN finite < 2 THEN population ELSE coalesce(last.n, pilot) END) AS n FROM pm LEFT JOIN (SELECT city, metric, arg_max(n, i) AS n FROM efix GROUP BY city, metric) last ON last.city = pm.city AND last.metric = pm.metric GROUP BY pm.city),
esrc AS (SELECT nord.city, node_id FROM nord JOIN esize USING (city) WHERE r <= n),
{_efficiency('esrc', 'fe')},
swept AS (SELECT city, avg(global_efficiency) AS g, avg(average_shortest_path) AS a, avg(circuity) AS c FROM fe GROUP BY city)"""
_ALL = f"""vals AS (
  SELECT city, 'node_density' AS metric, 'connectivity' AS pillar, 1 AS up, n_nodes / area_km2 AS value FROM ldens
  UNION ALL SELECT city, 'link_density', 'connectivity', 1, n_links / area_km2 FROM ldens
  UNION ALL SELECT city, 'average_degree', 'connectivity', 1, 2.0 * n_links / n_nodes FROM ldens
  UNION ALL SELECT city, 'closeness_centrality', 'connectivity', 1, mean FROM close
  UNION ALL SELECT city, 'global_efficiency', 'efficiency', 1, g FROM swept
  UNION ALL SELECT city, 'average_shortest_path', 'efficiency', -1, a FROM swept
  UNION ALL SELECT city, 'circuity', 'efficiency', -1, c FROM swept
  UNION ALL SELECT city, 'rcrc', 'efficiency', 1, rcrc FROM rc
  UNION ALL SELECT city, 'hierarchy_betweenness_centrality', 'hierarchy', 1, quantile_cont(betweenness, 0.9) FROM btw GROUP BY city
  UNION ALL SELECT city, 'hierarchy_road_class_distribution', 'hierarchy', 1, class_entropy FROM ent
  UNION ALL SELECT city, 'hierarchy_clarity', 'hierarchy', 1, rho FROM clarity),
{q._METRICS[q._METRICS.index('scored AS'):].replace('100 * (value - lo) / (hi - lo)', 'CASE WHEN up > 0 THEN 100 * (value - lo) / (hi - lo) ELSE 100 * (hi - value) / (hi - lo) END')}"""
_INDEX = ",\n".join((q._REC, q._COMPONENTS, q._LCC, q._AREA, q._DENS, q._LDENS, q._GAMMA, q._CIRC, q._RCRC, q._SIMPLE, q._PRICED, q._LENGTHS, q._ENTROPY, _CLOSE, _SWEPT, _BETWEEN.replace("many AS (SELECT city, count(*) AS n FROM nd GROUP BY city),\n", ""), _CLARITY, _ALL))

_BLOCKS_HEAD = f"{q._REC},\n{q._COMPONENTS}"
ORACLE = {
    "graph_simplify": f"{q._REC},\n{q._SIMPLE},\n{_SIMPLIFY} SELECT city, lo, hi, round(length, 6) AS length, n_segments FROM simplified",
    "articulation_bridges": f"{_BLOCKS_HEAD},\n{_BLOCKS} SELECT city, kind, a, coalesce(b, a) AS b FROM weak",
    "edge_betweenness": f"{q._REC},\n{q._SIMPLE},\n{_BETWEEN} SELECT city, lo, hi, round(betweenness, 12) AS betweenness FROM btw",
    "betweenness_p90": f"{q._REC},\n{q._SIMPLE},\n{_BETWEEN} SELECT city, round(quantile_cont(betweenness, 0.9), 12) AS betweenness_p90, count(*) AS n_edges FROM btw GROUP BY city",
    "hierarchy_clarity": f"{q._REC},\n{q._SIMPLE},\n{q._CLASS},\n{_BETWEEN},\n{_CLARITY} SELECT city, n, round(rho, 9) AS rho FROM clarity",
    "required_n": f"""{q._REC},\n{q._COMPONENTS},\n{q._LCC},\n{_CLOSE}
SELECT city, 'closeness' AS metric, population, pilot AS pilot_size, n AS sample_size, finite AS n_finite, round(mean, 9) AS estimate, round(se, 12) AS standard_error, round(mean - margin, 9) AS ci_lower, round(mean + margin, 9) AS ci_upper, round(margin / abs(mean), 9) AS relative_margin FROM close""",
    "convex_hull": f"WITH RECURSIVE {q._NODES},\n{_HULL} SELECT city, corners, round(area, 2) AS area_m2 FROM hulls",
    "search_area": f"WITH {q._NODES},\n{_SEARCH} SELECT city, CAST(sum(n) AS BIGINT) AS n_cells, round(32 * 15000.0 * 15000.0 * sin(pi() / 32), 0) AS area_m2 FROM runs GROUP BY city",
    "alternative_extent": f"WITH RECURSIVE {q._NODES},\n{q._FOOT},\n{_ALTERNATIVE} SELECT city, component_id, core_count, cell_count, core_area_km2 FROM parts QUALIFY row_number() OVER (PARTITION BY city ORDER BY core_count DESC, cell_count DESC, component_id) = 1 AND core_area_km2 >= {defaults.LEAST_CORE_KM2}",
    "index_metrics": f"{_INDEX} SELECT city, pillar, metric, round(value, 9) AS value, round(score, 6) AS score FROM scored",
    "city_index": f"{_INDEX} SELECT city, round(c, 6) AS connectivity_score, round(e, 6) AS efficiency_score, round(h, 6) AS hierarchy_score, round(i, 6) AS index_score FROM idx",
}
