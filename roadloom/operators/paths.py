"""Shortest paths from sampled sources.

The adjacency of each city is built once and written to the shared folder; batches of its sources are tasks that read it
there (no copies in a shuffle, no driver, no broadcast) and run a numpy breadth-first search or a bucketed shortest-path search.
Only sums per source leave the task unless the distances themselves are wanted; hop distances leave it piece by piece and are
never stored, in an order that columnar files hold in a fraction of a byte a row. A city must fit one task, which is checked:
beyond `most_edges` edges hop distances run as a frontier join, weighted ones as a relaxing join, and betweenness as joins
along the shortest-path edges, round by round.
"""

from __future__ import annotations

import bisect
import functools
import itertools
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadloom.functions import defaults
from roadloom.functions.frames import few, removed, removed_at_exit, shared_folder, shared_rows, small, stored
from roadloom.operators.network import symmetric

#: Edges of a city that one task holds: their adjacency takes some 120 MB, building it about four times that.
MOST_EDGES = 5_000_000


class Csr:
    """Symmetric adjacency over the ids that occur, in ascending order of id."""

    def __init__(self, lo: np.ndarray, hi: np.ndarray, length: np.ndarray | None = None):
        self.ids = np.unique(np.concatenate([lo, hi]))
        a, b = np.searchsorted(self.ids, lo), np.searchsorted(self.ids, hi)
        src, dst = np.concatenate([a, b]), np.concatenate([b, a])
        order = np.lexsort((dst, src))
        self.start = np.zeros(len(self.ids) + 1, dtype=np.int64)
        np.cumsum(np.bincount(src, minlength=len(self.ids)), out=self.start[1:])
        self.to = dst[order].astype(np.int32)
        self.w = None if length is None else np.concatenate([length, length])[order]
        self.x = self.y = self.sources = None

    @classmethod
    def of(cls, parts: dict[str, np.ndarray]) -> Csr:
        """A graph of its arrays."""
        g = cls.__new__(cls)
        g.ids, g.start, g.to, g.w, g.x, g.y, g.sources = (parts.get(k) for k in ("ids", "start", "to", "w", "x", "y", "sources"))
        return g

    @functools.cached_property
    def tail(self) -> np.ndarray:
        """The start of every directed edge."""
        return np.repeat(np.arange(len(self.ids)), np.diff(self.start))

    def places(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(indexes of those of the ids that have edges, the ids that have none)."""
        at = np.minimum(np.searchsorted(self.ids, ids), max(0, len(self.ids) - 1))
        there = self.ids[at] == ids if len(self.ids) else np.zeros(len(ids), dtype=bool)
        return at[there], ids[~there]

    def hops(self, source: int) -> np.ndarray:
        """Hops from a node index, -1 where unreachable."""
        dist = np.full(len(self.ids), -1, dtype=np.int64)
        dist[source] = 0
        front, level = np.asarray([source]), 0
        while len(front):
            level += 1
            sizes = self.start[front + 1] - self.start[front]
            at = np.repeat(self.start[front] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
            found = self.to[at]
            front = np.unique(found[dist[found] < 0])
            dist[front] = level
        return dist

    @functools.cached_property
    def landmark_hops(self) -> np.ndarray:
        """Hops from the node with the most edges."""
        return self.hops(int(np.argmax(np.diff(self.start))))

    def hops_at(self, sources: np.ndarray, targets: np.ndarray) -> np.ndarray:
        """Hops from up to 64 node indexes, a column each, to the node indexes of targets, a row each; -1 where unreachable.

        All sources at once, a bit each: a level costs the edges around what it reaches, at most all of them.
        """
        n, out = len(self.ids), np.full((len(targets), len(sources)), -1, dtype=np.int16)
        row, mark = np.full(n, -1, dtype=np.int32), np.empty(n, dtype=np.int64)
        row[targets] = np.arange(len(targets))
        seen, held = np.zeros(n, dtype="<u8"), np.zeros(n, dtype="<u8")
        np.bitwise_or.at(seen, sources, np.uint64(1) << np.arange(len(sources), dtype=np.uint64))
        every, degree = np.bitwise_or.reduce(seen), np.diff(self.start)
        at, level = np.unique(sources), 0
        new = seen[at]
        while len(at):
            if level > np.iinfo(out.dtype).max:
                out = out.astype(np.int32)
            inside = row[at]
            ours = new[inside >= 0]
            inside = inside[inside >= 0]
            for k in range(0, len(ours), 2**14):
                bits = np.unpackbits(ours[k : k + 2**14].view(np.uint8).reshape(-1, 8), axis=1, count=len(sources), bitorder="little")
                own = out[inside[k : k + 2**14]]
                np.copyto(own, level, where=bits.view(bool))
                out[inside[k : k + 2**14]] = own
            level += 1
            if 4 * int(degree[at].sum()) < len(self.to):  # from those just reached to those around them
                which, edge = self.edges_of(at)
                to = self.to[edge]
                np.bitwise_or.at(held, to, new[which])
                mark[to] = np.arange(len(to))
                near = to[mark[to] == np.arange(len(to))]
                got = held[near] & ~seen[near]
                held[near] = 0
            else:  # from those not reached by all to those around them
                near = np.flatnonzero(seen != every)
                held[at] = new
                around = self.to if 2 * len(near) > n else self.to[self.edges_of(near)[1]]
                near = np.arange(n) if 2 * len(near) > n else near
                got = np.bitwise_or.reduceat(held[around], np.cumsum(degree[near]) - degree[near]) & ~seen[near] if len(near) else np.empty(0, dtype="<u8")  # every node has an edge
                held[at] = 0
            at, new = near[got != 0], got[got != 0]
            seen[at] |= new
        return out

    def edges_of(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position in at, position in to) of all edges out of the nodes at."""
        sizes = self.start[at + 1] - self.start[at]
        which = np.repeat(np.arange(len(at)), sizes)
        return which, np.repeat(self.start[at] - np.cumsum(sizes) + sizes, sizes) + np.arange(len(which))

    def distances(self, sources: np.ndarray) -> np.ndarray:
        """Distances from node indexes, one row each, inf where unreachable: bucket by bucket of path length, all sources at once.

        A node is settled once no shorter sum of lengths along a path exists, so the result is that of Dijkstra's algorithm.
        """
        n, k = len(self.ids), len(sources)
        d = np.full(k * n, np.inf)
        waiting = np.arange(k) * n + sources
        d[waiting] = 0.0
        width = 4.0 * float(self.w.mean()) if len(self.w) else 1.0
        limit = width
        while len(waiting):
            near = d[waiting] <= limit
            now, later = waiting[near], [waiting[~near]]
            while len(now):
                node = now % n
                which, edge = self.edges_of(node)
                target = (now - node)[which] + self.to[edge]
                far = d[now][which] + self.w[edge]
                better = far < d[target]
                target, far = target[better], far[better]
                np.minimum.at(d, target, far)
                target = np.unique(target)
                close = d[target] <= limit
                now = target[close]
                later.append(target[~close])
            waiting = np.unique(np.concatenate(later))
            waiting = waiting[d[waiting] > limit]  # the others were reached and settled within this bucket
            limit = max(limit + width, float(d[waiting].min()) + width) if len(waiting) else limit
        return d.reshape(k, n)

    def rows(self, sources: np.ndarray, most: int = 4_000_000):
        """(source index, distances) one by one, as many at once as fit in `most` cells."""
        step = max(1, most // max(1, len(self.ids)))
        for a in range(0, len(sources), step):
            yield from zip(sources[a : a + step].tolist(), self.distances(sources[a : a + step]))


def batched(sources: DataFrame, size: int) -> DataFrame:
    """sources (city, node_id) in batches of about `size` per city, by hash."""
    n = sources.groupBy("city").agg(F.greatest(F.lit(1), F.ceil(F.count("*") / size)).cast("int").alias("batches"))
    return sources.join(small(n), "city").withColumn("batch", F.pmod(F.xxhash64("node_id"), F.col("batches")).cast("int"))


_KINDS = {"ids": np.int64, "start": np.int64, "to": np.int32, "w": np.float64, "x": np.float64, "y": np.float64}
_BLOB, _PIECE = "slot bigint, city string, kind string, seq int, data binary", 2**24


def _blobs(slot: int, city: str, parts: dict[str, np.ndarray]) -> pa.Table:
    rows = [(slot, city, kind, k, data[a : a + _PIECE]) for kind, v in parts.items() for data in (v.tobytes(),) for k, a in enumerate(range(0, max(1, len(data)), _PIECE))]
    kinds = (pa.int64(), pa.string(), pa.string(), pa.int32(), pa.binary())
    return pa.table([pa.array(c, t) for c, t in zip(zip(*rows), kinds, strict=True)], names=[f.split()[0] for f in _BLOB.split(", ")])


def _write_graphs(pairs: DataFrame, where: str, nodes: DataFrame | None, sources: DataFrame | None = None) -> None:
    """The adjacency of every city under where/slot=..., with the positions of its nodes and its sources if they are given."""
    slot = F.xxhash64("city").alias("slot")

    def build(own: pa.Table) -> pa.Table:
        g = Csr(own.column("lo").to_numpy(), own.column("hi").to_numpy(), own.column("length").to_numpy() if "length" in own.column_names else None)
        parts = {"ids": g.ids, "start": g.start, "to": g.to} | ({} if g.w is None else {"w": g.w})
        return _blobs(own.column("slot")[0].as_py(), own.column("city")[0].as_py(), parts)

    made = pairs.select(slot, F.col("city").cast("string").alias("city"), *[c for c in pairs.columns if c != "city"]).groupBy("slot", "city").applyInArrow(build, _BLOB)
    if nodes is not None:

        def place(own: pa.Table) -> pa.Table:
            own = own.sort_by("node_id")
            parts = {"nodes": own.column("node_id").to_numpy()} | {c: own.column(c).to_numpy(zero_copy_only=False) for c in "xy"}
            return _blobs(own.column("slot")[0].as_py(), own.column("city")[0].as_py(), {k: v.astype(np.float64) if k in "xy" else v for k, v in parts.items()})

        made = made.unionByName(nodes.select(slot, F.col("city").cast("string").alias("city"), "node_id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).groupBy("slot", "city").applyInArrow(place, _BLOB))
    if sources is not None:

        def start(own: pa.Table) -> pa.Table:
            return _blobs(own.column("slot")[0].as_py(), own.column("city")[0].as_py(), {"sources": np.sort(own.column("node_id").to_numpy())})

        made = made.unionByName(sources.select(slot, F.col("city").cast("string").alias("city"), F.col("node_id").cast("bigint").alias("node_id")).groupBy("slot", "city").applyInArrow(start, _BLOB))
    made.write.partitionBy("slot").parquet(where)


@functools.lru_cache(maxsize=1)
def _read_graph(where: str, slot: int, city: str) -> Csr:
    """A city's graph, kept in the worker for the next batch. x and y, if any, are those of the graph's nodes."""
    rows = shared_rows(f"{where}/slot={slot}", "city", "kind", "seq", "data")
    held: dict[str, list] = {}
    for c, kind, seq, data in zip(*(rows.column(k).to_pylist() for k in ("city", "kind", "seq", "data"))) if rows is not None else ():
        if c == city:
            held.setdefault(kind, []).append((seq, data))
    parts = {kind: np.frombuffer(b"".join(d for _, d in sorted(pieces, key=lambda p: p[0])), dtype=_KINDS.get(kind, np.int64)) for kind, pieces in held.items()}
    parts = {"ids": np.empty(0, dtype=np.int64), "start": np.zeros(1, dtype=np.int64), "to": np.empty(0, dtype=np.int32), "w": np.empty(0)} | parts
    if "nodes" in parts:
        at = np.minimum(np.searchsorted(parts["nodes"], parts["ids"]), len(parts["nodes"]) - 1)
        known = parts["nodes"][at] == parts["ids"]
        parts |= {c: np.where(known, parts[c][at], np.nan) for c in "xy"}
    elif "x" not in parts:
        parts |= {c: np.full(len(parts["ids"]), np.nan) for c in "xy"}
    return Csr.of(parts)


def per_batch(pairs: DataFrame, sources: DataFrame, kernel: Callable[[Csr, str, np.ndarray], Iterable[tuple] | pd.DataFrame], schema: str, size: int, nodes: DataFrame | None = None, finish: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """finish(kernel(graph of a city, the city, one batch of its sources) for all batches of all cities), stored."""
    spark, names = pairs.sparkSession, _names(schema)
    where = f"{shared_folder(spark)}/graphs-{uuid.uuid4().hex}"
    _write_graphs(pairs, where, nodes)

    def run(own: pd.DataFrame) -> pd.DataFrame:
        city = own["city"].iloc[0]
        made = kernel(_read_graph(where, int(own["slot"].iloc[0]), city), city, own["node_id"].to_numpy())
        return made if isinstance(made, pd.DataFrame) else pd.DataFrame(made, columns=names)

    s = batched(sources, size).select(F.xxhash64("city").alias("slot"), F.col("city").cast("string").alias("city"), "batch", "node_id").repartition(_partitions(spark), "city", "batch")
    out = stored(finish(s.groupBy("city", "batch").applyInPandas(run, schema)))
    removed(spark, where)
    return out


#: Rows that leave a task at once where rows are many per source: some 3 MB. Rows of a task at most, but for one word of sources.
PIECE_ROWS, TASK_ROWS = 2**16, 2**26
#: Targets of a task at most: as many as Parquet's dictionary of a column holds (1 MB) before it writes every value out.
#: Pairs of sources and targets whose hops a task holds at once, but for one batch of sources: 67 MB, twice that beyond 32,767 hops.
BLOCK_TARGETS, TILE_PAIRS = 2**17, 2**25


def per_block(pairs: DataFrame, sources: DataFrame, schema: str, size: int) -> DataFrame:
    """schema (city, source, target, hops) of all reachable pairs, computed as it is read: nothing is shuffled or stored.

    A task searches from some sources of a city and gives the rows of a block of its nodes, target by target, each with as many
    batches of `size` sources as it holds at once. Nodes and sources are taken by their hops from the city's landmark, so that rows that follow each other are alike: the
    columns of a file are short runs of few values. The adjacency it reads stays until the application ends.
    """
    spark, names = pairs.sparkSession, _names(schema)
    where = f"{shared_folder(spark)}/graphs-{uuid.uuid4().hex}"
    _write_graphs(pairs, where, None, sources)
    removed_at_exit(spark, where)
    count = lambda kind: F.sum(F.when(F.col("kind") == kind, F.octet_length("data") / 8).otherwise(0)).cast("bigint").alias(kind)
    cities = few(spark.read.schema(_BLOB).parquet(where).filter("kind in ('ids', 'sources')").groupBy("slot", "city").agg(count("ids"), count("sources")).filter("sources > 0").orderBy("slot", "city"))
    most = max(1, min(TASK_ROWS, sum(r.ids * r.sources for r in cities) // (2 * _partitions(spark))))
    dealt = []  # slot, city, blocks of its nodes, parts of its sources
    for r in cities:
        blocks = max(1, -(-r.ids // BLOCK_TARGETS))
        dealt.append((r.slot, r.city, blocks, -(-r.sources // max(64, most * blocks // max(1, r.ids) // size * size))))
    ends = list(itertools.accumulate(blocks * parts for _, _, blocks, parts in dealt))

    def rows(city: str, own: np.ndarray, targets: np.ndarray, hops: np.ndarray) -> Iterator[pa.RecordBatch]:
        step = max(1, PIECE_ROWS // len(own))
        for a in range(0, len(targets), step):
            d = hops[a : a + step]
            there = np.flatnonzero(d.ravel() >= 0)
            if len(there):
                columns = [np.tile(own, len(d))[there], np.repeat(targets[a : a + step], len(own))[there], d.ravel()[there].astype(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(city), len(there)), *map(pa.array, columns)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for task in itertools.chain.from_iterable(b.column(0).to_pylist() for b in batches):
            k = bisect.bisect_right(ends, task)
            slot, city, blocks, parts = dealt[k]
            block, part = divmod(task - (ends[k] - blocks * parts), parts)
            g = _read_graph(where, slot, city)
            at, alone = g.places(g.sources)
            if block == 0:
                for s in _share(alone, part, parts):
                    yield from rows(city, np.asarray([s]), np.asarray([s]), np.zeros((1, 1), dtype=np.int32))
            if len(at):
                far = g.landmark_hops
                at = _share(at[np.argsort(far[at], kind="stable")], part, parts)
                targets = _share(np.argsort(far, kind="stable"), block, blocks)
                step = max(size, TILE_PAIRS // len(targets) // size * size)
                for a in range(0, len(at), step):
                    own = at[a : a + step]
                    hops = np.empty((len(targets), len(own)), dtype=np.int16)
                    for w in range(0, len(own), 64):
                        some = g.hops_at(own[w : w + 64], targets)
                        hops = hops.astype(np.promote_types(hops.dtype, some.dtype), copy=False)
                        hops[:, w : w + 64] = some
                    yield from rows(city, g.ids[own], g.ids[targets], hops)

    n = ends[-1] if ends else 0
    return spark.range(0, n, 1, max(1, n)).mapInArrow(run, schema)


def _share(values: np.ndarray, k: int, n: int) -> np.ndarray:
    """The k-th of n parts of about equal length."""
    return values[k * len(values) // n : (k + 1) * len(values) // n]


def _partitions(spark: SparkSession) -> int:
    """As many as asked for: few bytes of sources make much work here, and AQE would put all batches in one task."""
    return max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(",")]


def fits(pairs: DataFrame, most_edges: int = MOST_EDGES) -> bool:
    """Every city's graph fits one task."""
    top = pairs.groupBy("city").count().agg(F.max("count")).first()[0]
    return (top or 0) <= most_edges


HOPS = "city string, source bigint, target bigint, hops bigint"


def hop_distances(pairs: DataFrame, sources: DataFrame, size: int = defaults.CLOSENESS_BATCH, most_edges: int = MOST_EDGES) -> DataFrame:
    """(city, source, target, hops) of the reachable pairs, the source itself included."""
    plain = pairs.select("city", "lo", "hi")  # parallel edges don't change a search
    if not fits(plain, most_edges):
        return _joined(symmetric(plain.distinct().withColumn("w", F.lit(1).cast("bigint")), "w"), sources).withColumnRenamed("d", "hops")

    return per_block(plain, sources, HOPS, size)


LENGTHS = "city string, source bigint, target bigint, d double"


def path_lengths(pairs: DataFrame, sources: DataFrame, size: int = 64, most_edges: int = MOST_EDGES) -> DataFrame:
    """(city, source, target, d) of the reachable pairs, the source itself included."""
    if not fits(pairs, most_edges):
        return _joined(symmetric(pairs.withColumnRenamed("length", "w"), "w"), sources)

    def kernel(g: Csr, city: str, own: np.ndarray) -> pd.DataFrame:
        at, alone = g.places(own)
        parts = [pd.DataFrame({"city": city, "source": alone, "target": alone, "d": 0.0})]
        for k, d in g.rows(at):
            ok = np.isfinite(d)
            parts.append(pd.DataFrame({"city": city, "source": g.ids[k], "target": g.ids[ok], "d": d[ok]}))
        return pd.concat(parts)

    return per_batch(pairs.select("city", "lo", "hi", "length"), sources, kernel, LENGTHS, size)


def _joined(both: DataFrame, sources: DataFrame, most_rounds: int = 100_000) -> DataFrame:
    """Distances by joins: each round relaxes the edges out of what improved, and stores the result."""
    best = stored(sources.select("city", F.col("node_id").alias("source"), F.col("node_id").alias("target"), F.lit(0).cast(both.schema["w"].dataType).alias("d"), F.lit(True).alias("fresh")))
    for _ in range(most_rounds):
        step = best.filter("fresh").join(both, [best.city == both.city, best.target == both.a]).select(best.city, "source", F.col("b").alias("target"), (F.col("d") + F.col("w")).alias("d"), F.lit(True).alias("fresh"))
        best = stored(best.withColumn("fresh", F.lit(False)).unionByName(step).groupBy("city", "source", "target").agg(F.min(F.struct("d", "fresh")).alias("m")).select("city", "source", "target", "m.d", "m.fresh"))
        if best.filter("fresh").isEmpty():
            return best.select("city", "source", "target", "d")
    raise RuntimeError(f"distances still shrink after {most_rounds} rounds")


CLOSENESS = "city string, source bigint, reachable bigint, total_hops bigint"


def hop_sums(pairs: DataFrame, sources: DataFrame, size: int = defaults.CLOSENESS_BATCH, most_edges: int = MOST_EDGES) -> DataFrame:
    """(city, source, reachable, total_hops): all that closeness needs of a breadth-first search."""
    plain = pairs.select("city", "lo", "hi")  # parallel edges don't change a search
    if not fits(plain, most_edges):
        return hop_distances(plain, sources, size, most_edges).groupBy("city", "source").agg(F.count("*").alias("reachable"), F.sum("hops").alias("total_hops"))

    def kernel(g: Csr, city: str, own: np.ndarray) -> list[tuple]:
        at, alone = g.places(own)
        rows = [(city, s, 1, 0) for s in alone.tolist()]
        for k in at.tolist():
            d = g.hops(k)
            rows.append((city, int(g.ids[k]), int((d >= 0).sum()), int(d[d > 0].sum())))
        return rows

    return per_batch(plain, sources, kernel, CLOSENESS, size)


SWEEP = "city string, source bigint, reachable bigint, sum_d double, sum_inverse double, sum_ratio double, n_ratio bigint"


def path_sums(pairs: DataFrame, sources: DataFrame, nodes: DataFrame, size: int = defaults.EFFICIENCY_BATCH, most_edges: int = MOST_EDGES) -> DataFrame:
    """One weighted sweep per source for all three efficiency measures: reachable others, sums of d, 1/d and d/straight line."""
    if not fits(pairs, most_edges) or not fits(nodes, most_edges):
        a, b = nodes.select("city", F.col("node_id").alias("source"), F.col("x").alias("sx"), F.col("y").alias("sy")), nodes.select("city", F.col("node_id").alias("target"), "x", "y")
        straight = F.hypot(F.col("x") - F.col("sx"), F.col("y") - F.col("sy"))
        far = path_lengths(pairs, sources, size, most_edges).join(a, ["city", "source"]).join(b, ["city", "target"])
        other, seen = F.col("source") != F.col("target"), straight > 0
        return far.groupBy("city", "source").agg(F.count_if(other).alias("reachable"), F.sum(F.when(other, F.col("d"))).alias("sum_d"), F.sum(F.when(other, 1 / F.col("d"))).alias("sum_inverse"), F.sum(F.when(other & seen, F.col("d") / straight)).alias("sum_ratio"), F.count_if(other & seen).alias("n_ratio"))

    def kernel(g: Csr, city: str, own: np.ndarray) -> list[tuple]:
        at, alone = g.places(own)
        rows = [(city, s, 0, 0.0, 0.0, 0.0, 0) for s in alone.tolist()]
        for k, d in g.rows(at):
            ok = np.isfinite(d)
            ok[k] = False
            straight = np.hypot(g.x[ok] - g.x[k], g.y[ok] - g.y[k])
            seen = straight > 0
            rows.append((city, int(g.ids[k]), int(ok.sum()), float(d[ok].sum()), float((1 / d[ok]).sum()), float((d[ok][seen] / straight[seen]).sum()), int(seen.sum())))
        return rows

    return per_batch(pairs.select("city", "lo", "hi", "length"), sources, kernel, SWEEP, size, nodes)


PARTIAL = "city string, lo bigint, hi bigint, share double"


def edge_betweenness(pairs: DataFrame, sources: DataFrame, nodes: DataFrame, size: int = defaults.BETWEENNESS_BATCH, most_edges: int = MOST_EDGES) -> DataFrame:
    """(city, lo, hi, betweenness): weighted edge betweenness from the sources, normalised over ordered pairs; 0 for unused edges.

    Each source's dependencies are accumulated by Brandes' algorithm within one task; Spark adds the partial sums.
    """

    def kernel(g: Csr, city: str, own: np.ndarray) -> pd.DataFrame:
        total = np.zeros(len(g.to))
        for k, d in g.rows(g.places(own)[0]):
            add_dependencies(g, k, d, total)
        used = np.flatnonzero(total)
        a, b = g.ids[g.tail[used]], g.ids[g.to[used]]
        return pd.DataFrame({"city": city, "lo": np.minimum(a, b), "hi": np.maximum(a, b), "share": total[used]})

    summed = lambda df: df.groupBy("city", "lo", "hi").agg(F.sum("share").alias("share"))
    parts = per_batch(pairs.select("city", "lo", "hi", "length"), sources, kernel, PARTIAL, size, finish=summed) if fits(pairs, most_edges) else summed(_joined_shares(pairs, sources, size, most_edges))
    n = nodes.groupBy("city").agg(F.count("*").alias("n")).join(sources.groupBy("city").agg(F.count("*").alias("k")), "city")
    full = pairs.select("city", "lo", "hi").join(parts, ["city", "lo", "hi"], "left").join(small(n), "city")
    return full.select("city", "lo", "hi", (F.coalesce("share", F.lit(0.0)) / (F.col("k") * F.greatest(F.lit(1), F.col("n") - 1))).alias("betweenness"))


def _joined_shares(pairs: DataFrame, sources: DataFrame, size: int, most_edges: int) -> DataFrame:
    """PARTIAL by joins: path counts forwards and dependencies backwards along the shortest-path edges, a step a round.

    Both are linear, so what reaches a node by paths of different numbers of edges is summed afterwards.
    """
    key = ["city", "source"]
    far = stored(path_lengths(pairs, sources, size, most_edges))
    end = lambda n, d: far.select(*key, F.col("target").alias(n), F.col("d").alias(d))
    both = symmetric(pairs.withColumnRenamed("length", "w"), "w")
    on = stored(end("a", "da").join(both, ["city", "a"]).join(end("b", "db"), [*key, "b"]).filter("da + w = db and da < db").select(*key, F.col("a").alias("u"), F.col("b").alias("v")))
    front = sources.select("city", F.col("node_id").alias("source"), F.col("node_id").alias("u"), F.lit(1.0).alias("c"))
    reached = [front]
    while not front.isEmpty():
        front = stored(front.join(on, [*key, "u"]).groupBy(*key, F.col("v").alias("u")).agg(F.sum("c").alias("c")))
        reached.append(front)
    paths_ = stored(functools.reduce(DataFrame.unionByName, reached).groupBy(*key, "u").agg(F.sum("c").alias("c")))
    share = stored(on.join(paths_, [*key, "u"]).join(paths_.select(*key, F.col("u").alias("v"), F.col("c").alias("cv")), [*key, "v"]).select(*key, "u", "v", (F.col("c") / F.col("cv")).alias("part")))
    front, flows = far.filter("source <> target").select(*key, F.col("target").alias("v"), F.lit(1.0).alias("f")), []
    while not front.isEmpty():
        flow = stored(front.join(share, [*key, "v"]).select(*key, "u", "v", (F.col("f") * F.col("part")).alias("f")))
        flows.append(flow)
        front = flow.groupBy(*key, F.col("u").alias("v")).agg(F.sum("f").alias("f"))
    if not flows:
        return pairs.sparkSession.createDataFrame([], PARTIAL)
    return functools.reduce(DataFrame.unionByName, flows).select("city", F.least("u", "v").alias("lo"), F.greatest("u", "v").alias("hi"), F.col("f").alias("share"))


def add_dependencies(g: Csr, source: int, dist: np.ndarray, total: np.ndarray) -> None:
    """Adds to total, per directed edge, the source's dependency on it (Brandes).

    The shortest-path edges (those whose length is exactly the difference they bridge) form an acyclic graph, which is
    walked front by front: path counts forwards, dependencies backwards.
    """
    ahead, behind = dist[g.tail], dist[g.to]
    on = np.flatnonzero((ahead + g.w == behind) & (ahead < behind) & np.isfinite(ahead))
    u, v = g.tail[on], g.to[on]
    first = np.searchsorted(u, np.arange(len(g.ids) + 1))
    left = np.bincount(v, minlength=len(g.ids))
    sigma, flow = np.zeros(len(g.ids)), np.zeros(len(g.ids))
    sigma[source] = 1.0
    front, fronts = np.asarray([source]), []
    while len(front):
        sizes = first[front + 1] - first[front]
        edge = np.repeat(first[front] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        fronts.append(edge)
        np.add.at(sigma, v[edge], sigma[u[edge]])
        np.subtract.at(left, v[edge], 1)
        reached = np.unique(v[edge])
        front = reached[left[reached] == 0]
    for edge in reversed(fronts):
        c = sigma[u[edge]] / sigma[v[edge]] * (1.0 + flow[v[edge]])
        np.add.at(flow, u[edge], c)
        total[on[edge]] += c
