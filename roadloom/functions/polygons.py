"""Polygons from text, their triangulation by ear clipping, exact tests, and a bounding-volume hierarchy over triangles."""

from __future__ import annotations

import json
import math
import re
from fractions import Fraction

import numpy as np

Ring = np.ndarray
Polygon = list[Ring]

_NUMBER = r"[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?"


def parse_polygons(text: str | None) -> list[Polygon]:
    """The parts of a POLYGON or MULTIPOLYGON in WKT (any case and spacing) or GeoJSON, each an outer ring and its holes.

    Null, empty, unreadable and non-areal geometries give no parts; rings of fewer than three distinct points are left
    out, and a part without an outer ring with them. Rings are returned open (no repeated end) whichever way they run.
    """
    if not text or not text.strip():
        return []
    text = text.strip()
    try:
        raw = _geojson(json.loads(text)) if text[0] == "{" else _wkt(text)
    except (ValueError, KeyError, TypeError, IndexError):
        return []
    out = []
    for part in raw:
        rings = [r for r in map(_open_ring, part)]
        if rings and rings[0] is not None:
            out.append([r for r in rings if r is not None])
    return out


def _geojson(o: dict) -> list:
    if o.get("type") == "Feature":
        o = o["geometry"]
    if o["type"] == "Polygon":
        return [o["coordinates"]]
    if o["type"] == "MultiPolygon":
        return o["coordinates"]
    if o["type"] == "GeometryCollection":
        return [p for g in o["geometries"] for p in _geojson(g)]
    return []


def _wkt(text: str) -> list:
    head = re.match(r"\s*(?:SRID\s*=\s*\d+\s*;)?\s*([A-Za-z]+)\s*(?:[ZM]{1,2}\s*)?(?=\(|EMPTY)", text, re.I)
    if not head or re.search(r"EMPTY\s*$", text, re.I):
        return []
    kind, body = head[1].upper(), text[head.end() :]
    if kind not in ("POLYGON", "MULTIPOLYGON"):
        return []
    base, depth, parts, ring = 1 if kind == "POLYGON" else 2, 0, [], ""
    if kind == "POLYGON":
        parts.append([])
    for token in re.finditer(r"[()]|[^()]+", body):
        t = token[0]
        if t == "(":
            depth += 1
            if kind == "MULTIPOLYGON" and depth == 2:
                parts.append([])
            ring = ""
        elif t == ")":
            if depth == base + 1 and ring:
                parts[-1].append([[float(v) for v in re.findall(_NUMBER, p)[:2]] for p in ring.split(",")])
            ring = ""
            depth -= 1
        else:
            ring = t
    return parts


def _open_ring(points: list) -> Ring | None:
    ring = np.asarray([p[:2] for p in points], dtype=float).reshape(-1, 2)
    if not np.isfinite(ring).all():
        return None
    if len(ring):
        ring = ring[np.r_[True, (ring[1:] != ring[:-1]).any(axis=1)]]
    while len(ring) > 1 and (ring[0] == ring[-1]).all():
        ring = ring[:-1]
    return ring if len(ring) >= 3 else None


def ring_area(ring: Ring) -> float:
    """Signed shoelace area."""
    x, y = (ring - ring[0]).T
    return 0.5 * float(np.sum(x * np.roll(y, -1) - np.roll(x, -1) * y))


def polygon_area(part: Polygon) -> float:
    return abs(ring_area(part[0])) - sum(abs(ring_area(h)) for h in part[1:])


def orientation(ax, ay, bx, by, cx, cy) -> np.ndarray:
    """Sign of the turn a, b, c: exact for every double (a float filter, then rationals for the few it can't decide)."""
    ax, ay, bx, by, cx, cy = np.broadcast_arrays(*(np.asarray(v, dtype=float) for v in (ax, ay, bx, by, cx, cy)))
    left, right = (ax - cx) * (by - cy), (ay - cy) * (bx - cx)
    det = left - right
    sign = np.array(np.sign(det))
    unsure = np.abs(det) <= 3.4e-16 * (np.abs(left) + np.abs(right))
    if unsure.any():
        for k in zip(*np.nonzero(unsure)) if unsure.ndim else [()]:
            a, b, c, d, e, f = (Fraction(float(v[k])) for v in (ax, ay, bx, by, cx, cy))
            exact = (a - e) * (d - f) - (b - f) * (c - e)
            sign[k] = (exact > 0) - (exact < 0)
    return sign


def _turn(a, b, c) -> float:
    """Float turn, exact where it is near zero."""
    left, right = (a[0] - c[0]) * (b[1] - c[1]), (a[1] - c[1]) * (b[0] - c[0])
    det = left - right
    if abs(det) > 3.4e-16 * (abs(left) + abs(right)):
        return det
    f = [Fraction(v) for v in (*a, *b, *c)]
    exact = (f[0] - f[4]) * (f[3] - f[5]) - (f[1] - f[5]) * (f[2] - f[4])
    return (exact > 0) - (exact < 0)


def _bridge(outer: list, holes: list[list]) -> list:
    """One ring with every hole joined to it by a double edge (rightmost hole first, to the nearest visible corner)."""
    for hole in sorted(holes, key=lambda h: -max(p[0] for p in h)):
        start = max(range(len(hole)), key=lambda i: (hole[i][0], hole[i][1]))
        m = hole[start]
        edges = list(zip(outer, outer[1:] + outer[:1])) + list(zip(hole, hole[1:] + hole[:1]))
        for k in sorted(range(len(outer)), key=lambda i: (outer[i][0] - m[0]) ** 2 + (outer[i][1] - m[1]) ** 2):
            p = outer[k]
            if not any(_cross(m, p, a, b) for a, b in edges) and _in_cone(outer, k, m):
                break
        else:
            raise ValueError("a hole sees no corner of its ring")
        turned = hole[start:] + hole[: start + 1]
        outer = outer[: k + 1] + turned + outer[k:]
    return outer


def _in_cone(ring: list, k: int, q) -> bool:
    """The segment from corner k to q starts on the inner side (the ring runs counterclockwise)."""
    before, at, after = ring[k - 1], ring[k], ring[(k + 1) % len(ring)]
    if _turn(before, at, after) >= 0:
        return _turn(at, q, before) > 0 and _turn(q, at, after) > 0 if _turn(before, at, after) > 0 else _turn(before, at, q) > 0
    return not (_turn(at, q, after) >= 0 and _turn(q, at, before) >= 0)


def _cross(p, q, a, b) -> bool:
    """Segments p-q and a-b meet other than in a common end."""
    if a in (p, q) or b in (p, q):
        other = b if a in (p, q) else a
        return other not in (p, q) and _turn(p, q, other) == 0 and min(p[0], q[0]) <= other[0] <= max(p[0], q[0]) and min(p[1], q[1]) <= other[1] <= max(p[1], q[1])
    s, t, u, v = _turn(p, q, a), _turn(p, q, b), _turn(a, b, p), _turn(a, b, q)
    if s == t == 0:
        return max(min(p[0], q[0]), min(a[0], b[0])) <= min(max(p[0], q[0]), max(a[0], b[0])) and max(min(p[1], q[1]), min(a[1], b[1])) <= min(max(p[1], q[1]), max(a[1], b[1]))
    return (s > 0) != (t > 0) and (u > 0) != (v > 0) or s == 0 and u * v < 0 or t == 0 and u * v < 0 or u == 0 and s * t < 0 or v == 0 and s * t < 0


def triangulate(part: Polygon) -> np.ndarray:
    """Triangles (n, 3, 2) that cover the part, holes left out, by ear clipping. ValueError if its rings cross."""
    outer = [tuple(p) for p in part[0].tolist()]
    if ring_area(part[0]) < 0:
        outer.reverse()
    holes = []
    for h in part[1:]:
        hole = [tuple(p) for p in h.tolist()]
        if ring_area(h) > 0:
            hole.reverse()
        holes.append(hole)
    ring = _bridge(outer, holes) if holes else outer
    triangles, ring = [], list(ring)
    k = idle = 0
    while len(ring) > 3:
        n = len(ring)
        if idle > n:
            raise ValueError("no ear is left: the rings cross")
        k %= n
        a, b, c = ring[k - 1], ring[k], ring[(k + 1) % n]
        turn = _turn(a, b, c)
        if turn == 0 and (a == c or (b[0] - a[0]) * (c[0] - b[0]) + (b[1] - a[1]) * (c[1] - b[1]) >= 0 or n > 3 and idle >= n // 2):
            ring.pop(k)  # a straight corner or a spike covers nothing
            k, idle = k - 1, 0
            continue
        if turn > 0 and not _holds_corner(ring, a, b, c):
            triangles.append((a, b, c))
            ring.pop(k)
            k, idle = k - 1, 0
            continue
        k, idle = k + 1, idle + 1
    if len(ring) == 3 and _turn(*ring) != 0:
        triangles.append(tuple(ring))
    out = np.asarray(triangles, dtype=float).reshape(-1, 3, 2)
    covered = float(sum(abs(ring_area(t)) for t in out))
    if not math.isclose(covered, polygon_area(part), rel_tol=1e-9, abs_tol=1e-6):
        raise ValueError("the triangles don't cover the part once: the rings cross")
    return out


def _holds_corner(ring: list, a, b, c) -> bool:
    """A corner other than a, b, c lies in the triangle (its border included)."""
    p = np.asarray(ring)
    near = (p[:, 0] >= min(a[0], b[0], c[0])) & (p[:, 0] <= max(a[0], b[0], c[0])) & (p[:, 1] >= min(a[1], b[1], c[1])) & (p[:, 1] <= max(a[1], b[1], c[1]))
    for q in map(tuple, p[near].tolist()):
        if q not in (a, b, c) and _turn(a, b, q) >= 0 and _turn(b, c, q) >= 0 and _turn(c, a, q) >= 0:
            return True
    return False


def trapezoids(part: Polygon) -> np.ndarray:
    """Triangles of the even-odd inside of a part whose rings cross: slabs between all corner and crossing heights."""
    edges = [(a, b) for r in part for a, b in zip(map(tuple, r.tolist()), map(tuple, np.roll(r, -1, axis=0).tolist())) if a[1] != b[1]]
    heights = {p[1] for e in edges for p in e}
    for i, (a, b) in enumerate(edges):
        for c, d in edges[i + 1 :]:
            den = (b[0] - a[0]) * (d[1] - c[1]) - (b[1] - a[1]) * (d[0] - c[0])
            if den:
                t = ((c[0] - a[0]) * (d[1] - c[1]) - (c[1] - a[1]) * (d[0] - c[0])) / den
                if 0 < t < 1:
                    heights.add(a[1] + t * (b[1] - a[1]))
    out, ys = [], sorted(heights)
    at = lambda e, y: e[0][0] + (y - e[0][1]) / (e[1][1] - e[0][1]) * (e[1][0] - e[0][0])
    for lo, hi in zip(ys, ys[1:]):
        mid = (lo + hi) / 2
        own = sorted((e for e in edges if min(e[0][1], e[1][1]) < mid < max(e[0][1], e[1][1])), key=lambda e: at(e, mid))
        for e, f in zip(own[::2], own[1::2]):
            p, q, r, s = (at(e, lo), lo), (at(f, lo), lo), (at(f, hi), hi), (at(e, hi), hi)
            out += [(p, q, r), (p, r, s)]
    return np.asarray(out, dtype=float).reshape(-1, 3, 2)


def crossings(part: Polygon) -> dict[int, list[tuple[float, tuple]]]:
    """Edge (counted over all rings) -> (place along it, point) of every point where it meets another edge other than in a common corner."""
    a = np.concatenate(part)
    b = np.concatenate([np.roll(r, -1, axis=0) for r in part])
    d, found = b - a, {}
    low, high = np.minimum(a, b), np.maximum(a, b)
    for i in range(len(a) - 1):
        near = i + 1 + np.flatnonzero((low[i + 1 :] <= high[i]).all(axis=1) & (high[i + 1 :] >= low[i]).all(axis=1))
        den = d[i, 0] * d[near, 1] - d[i, 1] * d[near, 0]
        near, den = near[den != 0], den[den != 0]
        off = a[near] - a[i]
        t, u = (off[:, 0] * d[near, 1] - off[:, 1] * d[near, 0]) / den, (off[:, 0] * d[i, 1] - off[:, 1] * d[i, 0]) / den
        for k in np.flatnonzero((t >= 0) & (t <= 1) & (u >= 0) & (u <= 1)):
            m, own, other = int(near[k]), float(t[k]), float(u[k])
            ends = {tuple(v.tolist()) for v in (a[i], b[i])} & {tuple(v.tolist()) for v in (a[m], b[m])}
            if ends:
                continue  # a common corner
            point = a[i] if own == 0 else b[i] if own == 1 else a[m] if other == 0 else b[m] if other == 1 else a[i] + own * d[i]
            found.setdefault(i, []).append((own, tuple(point.tolist())))
            found.setdefault(m, []).append((other, tuple(point.tolist())))
    return found


def untangled(part: Polygon) -> list[Polygon]:
    """The even-odd inside of a part whose rings may cross, as parts whose rings don't.

    All rings are cut where they meet; each closed walk falls into simple loops at the points it comes back to, and loops are
    outer rings or holes by how many others hold them. Where the loops so found don't enclose the even-odd area (loops that
    cross each other) or touch in a way no triangulation follows, the part comes as its triangles.
    """
    area = float(sum(abs(ring_area(t)) for t in trapezoids(part)))
    loops, cuts, first = [], crossings(part), 0
    for ring in part:
        walk = [p for k, corner in enumerate(map(tuple, ring.tolist()), first) for p in (corner, *(q for _, q in sorted(cuts.get(k, ())) if q != corner))]
        first += len(ring)
        path: list[tuple] = []
        place: dict[tuple, int] = {}
        for p in [*walk, walk[0]]:
            if p in place:
                loop = path[place[p] :]
                if len(loop) >= 3 and ring_area(np.asarray(loop)) != 0:
                    loops.append(np.asarray(loop))
                for q in path[place[p] + 1 :]:
                    del place[q]
                del path[place[p] + 1 :]
            else:
                place[p] = len(path)
                path.append(p)
    loops.sort(key=lambda r: -abs(ring_area(r)))
    inner = [_inner_point(r) for r in loops]
    depth = [sum(j != k and abs(ring_area(r)) > abs(ring_area(loops[k])) and bool(_odd(r, inner[k])) for j, r in enumerate(loops)) for k in range(len(loops))]
    parts: dict[int, Polygon] = {}
    for k, ring in enumerate(loops):
        if depth[k] % 2 == 0:
            parts[k] = [ring]
        else:
            owner = max((j for j in parts if _odd(loops[j], inner[k])), key=lambda j: depth[j], default=None)
            if owner is not None:
                parts[owner].append(ring)
    made = list(parts.values())
    if math.isclose(sum(map(polygon_area, made)), area, rel_tol=1e-9, abs_tol=1e-6) and all(map(is_simple, made)):
        return made
    return [[t] for t in trapezoids(part) if ring_area(t) != 0]


def is_simple(part: Polygon) -> bool:
    """Its rings don't cross, and a triangulation covers it."""
    if crossings(part):
        return False
    try:
        triangulate(part)
    except ValueError:
        return False
    return True


def _odd(ring: Ring, p: tuple[float, float]) -> bool:
    (ax, ay), (bx, by) = ring.T, np.roll(ring, -1, axis=0).T
    cut = (ay > p[1]) != (by > p[1])
    return bool(np.count_nonzero(ax[cut] + (p[1] - ay[cut]) * (bx[cut] - ax[cut]) / (by[cut] - ay[cut]) > p[0]) % 2)


def _inner_point(ring: Ring) -> tuple[float, float]:
    """A point within a simple ring: in the middle of the widest stretch halfway between its two lowest heights."""
    ys = np.unique(ring[:, 1])
    best = (-1.0, (0.0, 0.0))
    for lo, hi in zip(ys[:-1][:8], ys[1:][:8]):
        y = (lo + hi) / 2
        (ax, ay), (bx, by) = ring.T, np.roll(ring, -1, axis=0).T
        cut = (ay > y) != (by > y)
        xs = np.sort(ax[cut] + (y - ay[cut]) * (bx[cut] - ax[cut]) / (by[cut] - ay[cut]))
        for l, r in zip(xs[::2], xs[1::2]):
            best = max(best, (float((r - l) * (hi - lo)), (float((l + r) / 2), float(y))))
    return best[1]


def region_triangles(text: str | None) -> np.ndarray:
    """All triangles of a geometry text; parts whose rings cross count by the even-odd rule."""
    found = []
    for part in parse_polygons(text):
        try:
            found.append(trapezoids(part) if crossings(part) else triangulate(part))
        except ValueError:
            found.append(trapezoids(part))
    return np.concatenate(found) if found else np.empty((0, 3, 2))


def in_triangles(x: np.ndarray, y: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Elementwise: point (x, y) in triangle t (n, 3, 2), its border included. Exact."""
    s1 = orientation(t[:, 0, 0], t[:, 0, 1], t[:, 1, 0], t[:, 1, 1], x, y)
    s2 = orientation(t[:, 1, 0], t[:, 1, 1], t[:, 2, 0], t[:, 2, 1], x, y)
    s3 = orientation(t[:, 2, 0], t[:, 2, 1], t[:, 0, 0], t[:, 0, 1], x, y)
    return ((s1 >= 0) & (s2 >= 0) & (s3 >= 0)) | ((s1 <= 0) & (s2 <= 0) & (s3 <= 0))


class Boxes:
    """A bounding-volume hierarchy over boxes (low, high: n x 2): halves by the median centre along the longer axis down to small leaves."""

    def __init__(self, low: np.ndarray, high: np.ndarray, leaf: int = 8):
        self.low, self.high = low.reshape(-1, 2), high.reshape(-1, 2)
        self.bounds: list[tuple] = []
        self.kids: list[tuple[int, int] | None] = []
        self.items: list[np.ndarray | None] = []
        centre = (self.low + self.high) / 2
        todo = [(np.arange(len(self.low)), -1, 0)] if len(self.low) else []
        while todo:
            own, parent, side = todo.pop()
            me = len(self.bounds)
            if parent >= 0:
                pair = self.kids[parent]
                self.kids[parent] = (me, pair[1]) if side == 0 else (pair[0], me)
            lo, hi = self.low[own].min(axis=0), self.high[own].max(axis=0)
            self.bounds.append((lo[0], lo[1], hi[0], hi[1]))
            if len(own) <= leaf:
                self.kids.append(None)
                self.items.append(own)
                continue
            axis = int(np.argmax(centre[own].max(axis=0) - centre[own].min(axis=0)))
            order = own[np.argsort(centre[own, axis], kind="stable")]
            self.kids.append((-1, -1))
            self.items.append(None)
            todo += [(order[: len(order) // 2], me, 0), (order[len(order) // 2 :], me, 1)]

    def candidates(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(point, box) of all points in boxes, borders included."""
        points, found = [], []
        todo = [(0, np.arange(len(x)))] if self.bounds else []
        while todo:
            node, own = todo.pop()
            x0, y0, x1, y1 = self.bounds[node]
            px, py = x[own], y[own]
            own = own[(px >= x0) & (px <= x1) & (py >= y0) & (py <= y1)]
            if not len(own):
                continue
            if self.kids[node] is not None:
                todo += [(k, own) for k in self.kids[node]]
                continue
            items = self.items[node]
            p, t = np.repeat(own, len(items)), np.tile(items, len(own))
            near = (x[p] >= self.low[t, 0]) & (x[p] <= self.high[t, 0]) & (y[p] >= self.low[t, 1]) & (y[p] <= self.high[t, 1])
            points.append(p[near])
            found.append(t[near])
        none = np.empty(0, dtype=np.int64)
        return (np.concatenate(points), np.concatenate(found)) if points else (none, none)


class Hierarchy(Boxes):
    """A bounding-volume hierarchy over triangles (n, 3, 2)."""

    def __init__(self, triangles: np.ndarray, leaf: int = 8):
        super().__init__(triangles.min(axis=1) if len(triangles) else np.empty((0, 2)), triangles.max(axis=1) if len(triangles) else np.empty((0, 2)), leaf)
        self.triangles = triangles

    def hits(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(point, triangle) pairs of all points in triangles."""
        p, t = self.candidates(x, y)
        inside = in_triangles(x[p], y[p], self.triangles[t])
        return p[inside], t[inside]
