"""OpenStreetMap PBF extracts as tables.

A PBF file is a chain of independently compressed blocks. Their places are listed once by reading only the block heads;
the list is spread over the cluster and every task reads and decodes its own blocks, so the file must lie where all
executors can open it. Packed numbers are decoded with numpy. Blocks of unknown kinds and compressions other than raw
and zlib are refused by name.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadloom.operators.spatial import in_regions

ELEMENT = "kind string, id bigint, lat double, lon double, tags map<string,string>, refs array<bigint>, members array<struct<type:string,ref:bigint,role:string>>"


def varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        b = data[at]
        at += 1
        value |= (b & 127) << shift
        if b < 128:
            return value, at
        shift += 7


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, number or bytes) of a message."""
    at = 0
    while at < len(data):
        key, at = varint(data, at)
        number, wire = key >> 3, key & 7
        if wire == 0:
            value, at = varint(data, at)
        elif wire == 2:
            size, at = varint(data, at)
            value, at = data[at : at + size], at + size
        elif wire == 5:
            value, at = data[at : at + 4], at + 4
        elif wire == 1:
            value, at = data[at : at + 8], at + 8
        else:
            raise ValueError(f"wire type {wire}")
        yield number, value


def packed(data: bytes, signed: bool = False, delta: bool = False) -> np.ndarray:
    """The numbers of a packed field."""
    if not data:
        return np.empty(0, dtype=np.int64)
    b = np.frombuffer(data, dtype=np.uint8)
    last = b < 128
    start = np.flatnonzero(np.r_[True, last[:-1]])
    place = np.arange(len(b)) - np.repeat(start, np.diff(np.r_[start, len(b)]))
    parts = (b & 127).astype(np.uint64) << (7 * place).astype(np.uint64)
    out = np.add.reduceat(parts, start)
    if signed:
        out = (out >> np.uint64(1)) ^ (np.uint64(0) - (out & np.uint64(1)))
    out = out.view(np.int64)
    return np.cumsum(out) if delta else out


def block_places(path: str) -> list[tuple[str, int, int]]:
    """(path, offset, size) of the data blocks."""
    out, size = [], os.path.getsize(path)
    with open(path, "rb") as f:
        while f.tell() < size:
            head = dict(fields(f.read(struct.unpack(">I", f.read(4))[0])))
            if head[1] == b"OSMData":
                out.append((path, f.tell(), head[3]))
            f.seek(head[3], 1)
    return out


def _unpacked(blob: bytes) -> bytes:
    parts = dict(fields(blob))
    if 1 in parts:
        return parts[1]
    if 3 in parts:
        return zlib.decompress(parts[3])
    raise ValueError(f"compression of field {sorted(k for k in parts if k != 2)} isn't supported")


def elements(blob: bytes) -> Iterator[tuple]:
    """The rows of a data block."""
    table: list[str] = []
    groups, grain, lat0, lon0 = [], 100, 0, 0
    for number, value in fields(_unpacked(blob)):
        if number == 1:
            table = [v.decode("utf-8", "replace") for _, v in fields(value)]
        elif number == 2:
            groups.append(value)
        elif number == 17:
            grain = value
        elif number in (19, 20):
            value -= (value >> 63) << 64
            lat0, lon0 = (value, lon0) if number == 19 else (lat0, value)
    degrees = lambda v, o: 1e-9 * (o + grain * v)
    for group in groups:
        for number, value in fields(group):
            own = {}
            for k, v in fields(value):
                own[k] = v
            tags = dict(zip((table[i] for i in packed(own.get(2, b""))), (table[i] for i in packed(own.get(3, b""))))) if number != 2 else {}
            if number == 1:
                zigzag = lambda v: (v >> 1) ^ -(v & 1)
                yield "node", zigzag(own[1]), degrees(zigzag(own[8]), lat0), degrees(zigzag(own[9]), lon0), tags, None, None
            elif number == 2:
                ids, lats, lons = (packed(own.get(k, b""), True, True) for k in (1, 8, 9))
                pairs, at = packed(own.get(10, b"")).tolist(), 0
                for i, la, lo in zip(ids.tolist(), degrees(lats, lat0).tolist(), degrees(lons, lon0).tolist()):
                    mine = {}
                    while at < len(pairs) and pairs[at]:
                        mine[table[pairs[at]]] = table[pairs[at + 1]]
                        at += 2
                    at += 1
                    yield "node", i, la, lo, mine, None, None
            elif number == 3:
                yield "way", own[1], None, None, tags, packed(own.get(8, b""), True, True).tolist(), None
            elif number == 4:
                kinds = ("node", "way", "relation")
                members = [{"type": kinds[t], "ref": r, "role": table[s]} for s, r, t in zip(packed(own.get(8, b"")).tolist(), packed(own.get(9, b""), True, True).tolist(), packed(own.get(10, b"")).tolist())]
                yield "relation", own[1], None, None, tags, None, members


def read_pbf(spark: SparkSession, *paths: str) -> DataFrame:
    """One row per node, way and relation: kind, id, lat, lon, tags, refs (of ways), members (of relations)."""
    places = [p for path in paths for p in block_places(path)]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for path, offset, size in f.itertuples(index=False):
                with open(path, "rb") as file:
                    file.seek(offset)
                    yield pd.DataFrame(list(elements(file.read(size))), columns=["kind", "id", "lat", "lon", "tags", "refs", "members"])

    index = spark.createDataFrame(places, "path string, offset bigint, size bigint")
    return index.repartition(max(1, min(len(places), 10_000)), "offset").mapInPandas(run, ELEMENT)


def within(rows: DataFrame, west: float, south: float, east: float, north: float) -> DataFrame:
    """The nodes in a box, the ways with a node in it, and the relations with such a node or way."""
    return extracted(rows, rows.filter(f"kind = 'node' and lon between {west} and {east} and lat between {south} and {north}"))


def within_regions(rows: DataFrame, regions: DataFrame) -> DataFrame:
    """within() for polygons (region_id, geometry in degrees): all that has a node in any of them, borders included."""
    nodes = rows.filter("kind = 'node'")
    inside = in_regions(nodes.select("id", "lon", "lat", F.lit("").alias("city")), regions.withColumn("city", F.lit("")), point_id="id", x="lon", y="lat").select(F.col("point_id").alias("id")).distinct()
    return extracted(rows, nodes.join(inside, "id", "left_semi"))


def extracted(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """The given nodes, the ways with one of them, and the relations with such a node or way."""
    steps = rows.filter("kind = 'way'").select("id", F.explode("refs").alias("ref"))
    ways = rows.filter("kind = 'way'").join(steps.join(nodes.select(F.col("id").alias("ref")), "ref", "left_semi").select("id").distinct(), "id", "left_semi")
    held = nodes.select(F.lit("node").alias("type"), F.col("id").alias("ref")).unionByName(ways.select(F.lit("way").alias("type"), F.col("id").alias("ref")))
    parts = rows.filter("kind = 'relation'").select("id", F.explode("members").alias("m")).select("id", "m.type", "m.ref")
    relations = rows.filter("kind = 'relation'").join(parts.join(held, ["type", "ref"], "left_semi").select("id").distinct(), "id", "left_semi")
    return nodes.select(rows.columns).unionByName(ways.select(rows.columns)).unionByName(relations.select(rows.columns))


def _number(v: int) -> bytes:
    out = bytearray()
    while True:
        out.append(v & 127 | (128 if v > 127 else 0))
        v >>= 7
        if not v:
            return bytes(out)


def _field(n: int, v: int | bytes) -> bytes:
    return _number(n << 3) + _number(v) if isinstance(v, int) else _number(n << 3 | 2) + _number(len(v)) + v


def _deltas(values: list[int]) -> bytes:
    return b"".join(_number(d * 2 if d >= 0 else -d * 2 - 1) for d in (b - a for a, b in zip([0, *values], values)))


def encoded(nodes: list[tuple], ways: list[tuple]) -> bytes:
    """A data block of nodes (id, lat, lon, tags) and ways (id, refs, tags), positions to 1e-7 degrees."""
    place: dict[str, int] = {"": 0}
    at = lambda t: place.setdefault(t, len(place))
    pairs = b"".join(b"".join(_number(at(k)) + _number(at(v)) for k, v in (tags or {}).items()) + b"\0" for *_, tags in nodes)
    dense = _field(1, _deltas([n[0] for n in nodes])) + _field(8, _deltas([round(n[1] * 1e7) for n in nodes])) + _field(9, _deltas([round(n[2] * 1e7) for n in nodes])) + _field(10, pairs)
    body = b"".join(_field(3, _field(1, i) + _field(2, b"".join(_number(at(k)) for k in tags or {})) + _field(3, b"".join(_number(at(v)) for v in (tags or {}).values())) + _field(8, _deltas(refs))) for i, refs, tags in ways)
    table = _field(1, b"".join(_field(1, t.encode()) for t in place))
    return table + (_field(2, _field(2, dense)) if nodes else b"") + (_field(2, body) if ways else b"")


def _block(kind: bytes, data: bytes) -> bytes:
    blob = _field(2, len(data)) + _field(3, zlib.compress(data))
    head = _field(1, kind) + _field(3, len(blob))
    return struct.pack(">I", len(head)) + head + blob


def write_pbf(rows: DataFrame, folder: str, block: int = 8000) -> list[str]:
    """Nodes and ways as PBF files, one per partition, each complete by itself; returns their paths. The folder must be one that
    all executors share. A task that runs again replaces its own file."""
    os.makedirs(folder, exist_ok=True)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        path = f"{folder}/part-{TaskContext.get().partitionId():05d}.osm.pbf"
        fresh = f"{path}.{TaskContext.get().taskAttemptId()}"
        with open(fresh, "wb") as out:
            out.write(_block(b"OSMHeader", b""))
            for f in frames:
                for k in range(0, len(f), block):
                    own = f.iloc[k : k + block]
                    tags = [dict(t) if t is not None else {} for t in own["tags"]]
                    made = list(zip(own["kind"], own["id"], own["lat"], own["lon"], own["refs"], tags))
                    out.write(_block(b"OSMData", encoded([(int(i), la, lo, t) for kind, i, la, lo, _, t in made if kind == "node"], [(int(i), [int(r) for r in refs], t) for kind, i, _, _, refs, t in made if kind == "way"])))
        os.replace(fresh, path)
        yield pd.DataFrame({"path": [path]})

    return sorted(r.path for r in rows.select("kind", "id", "lat", "lon", "tags", "refs").mapInPandas(run, "path string").collect())
