"""Deeply nested records as flat tables: columnar shredding with repetition and definition levels.

Every element of an XML payload is a repeated field, every attribute an optional leaf. shred() turns each payload
into one column per leaf path ("osm/way/nd/@ref"), each entry with
* its repetition level: the depth of the innermost element of the path that started anew (0: a new record),
* its definition level: how many elements of the path exist, plus one if the attribute itself does,
* its value (null where the definition level says so).
tables() rebuilds one flat table per repeated ancestor from the level sequences alone: a running count over the
repetition levels numbers the parents and the children within each parent.

Defined results:
* null, empty and not well-formed payloads (cut-off ones too) have no columns, hence no rows;
* comments, processing instructions and CDATA marks are no children; attribute values are decoded by XML rules;
* the same record sent twice gives its rows twice (keys differ); equal siblings keep their own positions;
* an empty frame gives an empty frame; payloads of any length and nesting depth are handled whole
  (nothing recurses); every payload is independent, so nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from xml.parsers import expat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from roadloom.functions.frames import keep_columns, spread

COLUMN = "array<struct<path:string,reps:array<int>,defs:array<int>,vals:array<string>>>"
Column = tuple[list[int], list[int], list[str | None]]


class _Path:
    """A node of the union of all paths in one record: children by name, and the elements on it in document order."""

    __slots__ = ("name", "kids", "attrs", "parent")

    def __init__(self, name: str, parent: _Path | None):
        self.name, self.kids, self.attrs, self.parent = name, {}, {}, parent


def parse(payload: str | None) -> tuple[_Path, list[tuple]] | None:
    """The paths of a record and its elements as (path, children by path name, attributes); None if it isn't well-formed."""
    if not payload:
        return None
    top = _Path("", None)
    root = (top, {}, {})
    stack = [root]

    def start(name: str, attrs: dict) -> None:
        path, kids, _ = stack[-1]
        own = path.kids.get(name)
        if own is None:
            own = path.kids[name] = _Path(name, path)
        element = (own, {}, attrs)
        kids.setdefault(name, []).append(element)
        for a in attrs:
            own.attrs[a] = None
        stack.append(element)

    parser = expat.ParserCreate("utf-8")
    parser.StartElementHandler, parser.EndElementHandler = start, lambda _: stack.pop()
    try:
        parser.Parse(payload.encode("utf-8"), True)
    except (expat.ExpatError, UnicodeEncodeError):
        return None
    return top, root


def shred(payload: str | None, wanted: Callable[[str, str], bool] | None = None) -> dict[str, Column]:
    """Leaf path -> (repetition levels, definition levels, values). wanted(element path, attribute): which leaves to make."""
    parsed = parse(payload)
    if parsed is None:
        return {}
    top, root = parsed
    out: dict[str, Column] = {}
    # entries of a path: (repetition level, definition level, element or None)
    todo = [("", top, 0, [(0, 0, root)])]
    while todo:
        at, path, depth, entries = todo.pop()
        if at and (wanted is None or wanted(at, "")):  # an unnamed leaf, so that elements without attributes have levels too
            out[f"{at}/@"] = ([e[0] for e in entries], [e[1] for e in entries], [None] * len(entries))
        for a in path.attrs:
            if wanted is None or wanted(at, a):
                out[f"{at}/@{a}"] = ([e[0] for e in entries], [e[1] + (e[2] is not None and a in e[2][2]) for e in entries], [e[2][2].get(a) if e[2] is not None else None for e in entries])
        for name, kid in path.kids.items():
            below: list[tuple] = []
            for rep, level, element in entries:
                found = element[1].get(name) if element is not None else None
                if found:
                    below.append((rep, depth + 1, found[0]))
                    below.extend((depth + 1, depth + 1, x) for x in found[1:])
                else:
                    below.append((rep, level, None))
            todo.append((f"{at}/{name}" if at else name, kid, depth + 1, below))
    return out


def rebuild(columns: dict[str, Column], ancestor: str, child: str | None = None) -> dict[str, np.ndarray]:
    """The flat table of a repeated ancestor (or of a repeated child of it), from the level sequences alone.

    Rows are the instances that exist. parent: running number of the ancestor among the instances on its path;
    for a child also pos, its position from 1 among its siblings of that path within the parent (one list per level
    below the ancestor); then one array per attribute. The columns of one path align, as their levels are equal.
    """
    target = f"{ancestor}/{child}" if child else ancestor
    leaves = {p[len(target) + 2 :]: c for p, c in columns.items() if p.startswith(f"{target}/@")}
    if not leaves:
        return {}
    reps, defs, _ = next(iter(leaves.values()))
    rep = np.asarray(reps, dtype=np.int64)
    depth_a, depth_t = ancestor.count("/") + 1, target.count("/") + 1
    deep = np.max([np.asarray(c[1], dtype=np.int64) for c in leaves.values()], axis=0)
    # an ancestor instance starts where the repetition level reaches its depth or above, if it exists
    starts = (rep <= depth_a) & (deep >= depth_a)
    table = {"parent": np.cumsum(starts) - 1}
    exists = deep >= depth_t
    for level in range(depth_a + 1, depth_t + 1):
        opens = (rep <= level) & (deep >= level)
        count = np.cumsum(opens)
        resets = np.flatnonzero(rep < level)  # a new sibling list begins
        first = np.searchsorted(resets, np.arange(len(rep)), side="right") - 1
        before = np.where(resets[first] > 0, count[resets[first] - 1], 0)
        table[f"pos{level - depth_a}"] = count - before
    for name, (_, _, values) in leaves.items():
        table[name] = np.asarray(values, dtype=object)
    return {k: v[exists] for k, v in table.items()}


def paths_of(columns: dict[str, Column], name: str) -> list[str]:
    """The element paths in columns that end in name, at any depth."""
    return sorted({p for leaf in columns for p in (leaf.rpartition("/@")[0],) if p.rpartition("/")[2] == name})


def shredded(df: DataFrame, payload: str, wanted: Callable[[str, str], bool] | None = None, *, keep: Iterable[str] | None = None, column: str = "columns") -> DataFrame:
    """df with payload replaced by its columns (leaf path, repetition levels, definition levels, values)."""
    carried = keep_columns(df, keep if keep is not None else [c for c in df.columns if c != payload], (column, "__payload"))
    rows = spread(df).select(*carried, df[f"`{payload}`"].cast("string").alias("__payload"))
    names = [c for c in rows.columns if c != "__payload"]
    schema = T.StructType([*(rows.schema[c] for c in names), T.StructField(column, T._parse_datatype_string(COLUMN))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("path", pa.string()), ("reps", pa.list_(pa.int32())), ("defs", pa.list_(pa.int32())), ("vals", pa.list_(pa.string()))]))
        for batch in batches:
            for part in _slices(batch, 256):
                cells = [[{"path": p, "reps": r, "defs": d, "vals": v} for p, (r, d, v) in shred(x, wanted).items()] for x in part.column("__payload").to_pylist()]
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), pa.array(cells, kind)], names=[*names, column])

    return rows.mapInArrow(run, schema)


def _slices(batch: pa.RecordBatch, size: int) -> Iterator[pa.RecordBatch]:
    for k in range(0, batch.num_rows, size):
        yield batch.slice(k, size)


CHILDREN = ("nd", "tag", "member", "member/nd")
#: What makes a child's key, by its path below the record.
KEYS = {"nd": ("", ("ref",)), "tag": ("=", ("k", "v")), "member": (":", ("type", "ref", "role")), "member/nd": (",", ("lat", "lon"))}
RECORDS = ("node", "way", "relation")


def _road_leaves(at: str, attr: str) -> bool:
    """The leaves that the child tables of the map records need (projection pushed into the shredding)."""
    steps = at.split("/")
    if steps[-1] in RECORDS:
        return attr in ("", "id")
    for child, (_, attrs) in KEYS.items():
        own = child.split("/")
        if len(steps) > len(own) and steps[-len(own) :] == own and steps[-len(own) - 1] in RECORDS:
            return not attr or attr in attrs
    return False


def _elements(shredding: dict[str, Column], tagged: str | None) -> Iterator[tuple[str, str | None, str, str]]:
    """(kind, id, child path, child key) of the children of every record; tagged: only records with a tag of that k."""
    for kind in RECORDS:
        for path in paths_of(shredding, kind):
            head = rebuild(shredding, path)
            ids = dict(zip(head["parent"].tolist(), head["id"].tolist())) if "id" in head else {}
            tags = rebuild(shredding, path, "tag")
            chosen = None
            if tagged is not None:
                if not tags or "k" not in tags:
                    continue
                chosen = set(tags["parent"][tags["k"] == tagged].tolist())
                if not chosen:
                    continue
            for child in CHILDREN:
                rows = tags if child == "tag" else rebuild(shredding, path, child)
                if not rows:
                    continue
                glue, attrs = KEYS[child]
                blank = [None] * len(rows["parent"])
                cells = [rows[a].tolist() if a in rows else blank for a in attrs]
                names = child.split("/")
                for k, parent in enumerate(rows["parent"].tolist()):
                    if chosen is None or parent in chosen:
                        where = "/".join(f"{n}[{rows[f'pos{i + 1}'][k]}]" for i, n in enumerate(names))
                        yield kind, ids.get(parent), where, glue.join(c[k] or "" for c in cells)


def _bigint(text: str | None) -> int | None:
    try:
        value = int(text) if text is not None else None
    except ValueError:
        return None
    return value if value is not None and -(2**63) <= value < 2**63 else None


def _tables(df: DataFrame, payload: str, key: str, fields: list[T.StructField], kinds: list[pa.DataType], wanted: Callable[[str, str], bool], make: Callable[[dict[str, Column]], Iterable[tuple]]) -> DataFrame:
    """key and the fields of every row that make() rebuilds from the columns of a payload, which don't leave the task."""
    schema = T.StructType([T.StructField(key, df.schema[key].dataType), *fields])
    rows = spread(df).select(df[f"`{key}`"].alias("__key"), df[f"`{payload}`"].cast("string").alias("__doc"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch, 256):
                origin: list[int] = []
                out: list[tuple] = []
                for row, doc in enumerate(part.column(1)):
                    made = list(dict.fromkeys(make(shred(doc.as_py(), wanted))))
                    origin.extend([row] * len(made))
                    out += made
                cells = zip(*out) if out else [()] * len(kinds)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(origin, pa.int64())), *(pa.array(c, k) for c, k in zip(cells, kinds, strict=True))], names=schema.names)

    return rows.mapInArrow(run, schema)


def element_children(df: DataFrame, payload: str = "payload", key: str = "extract_id", tagged: str | None = "highway") -> DataFrame:
    """Child rows (key, parent_kind, parent_id, child_path, child_key) of the node, way and relation elements at any depth.

    tagged: only elements with a tag child of exactly that k; None: all. The shredded columns are rebuilt into one table
    per repeated ancestor and child; repeated elements of one id give distinct rows once. An element without a whole
    number as id has a null parent_id; a missing attribute counts as empty in child_key.
    """
    fields = [T.StructField("parent_kind", T.StringType()), T.StructField("parent_id", T.LongType()), T.StructField("child_path", T.StringType()), T.StructField("child_key", T.StringType())]
    make = lambda columns: ((kind, _bigint(i), path, child) for kind, i, path, child in _elements(columns, tagged))
    return _tables(df, payload, key, fields, [pa.string(), pa.int64(), pa.string(), pa.string()], _road_leaves, make)


def elements(df: DataFrame, payload: str = "payload", key: str = "extract_id") -> DataFrame:
    """One row per distinct node, way or relation with its attributes: (key, kind, id, path, attributes map), document paths kept."""

    def make(columns: dict[str, Column]) -> Iterator[tuple]:
        for name in RECORDS:
            for path in paths_of(columns, name):
                rows = rebuild(columns, path)
                attrs = [a for a in rows if a not in ("parent", "")]
                for k in range(len(rows["parent"])):
                    held = tuple((a, rows[a][k]) for a in attrs if rows[a][k] is not None)
                    yield name, _bigint(dict(held).get("id")), path, held

    fields = [T.StructField("kind", T.StringType()), T.StructField("id", T.LongType()), T.StructField("path", T.StringType()), T.StructField("attributes", T.MapType(T.StringType(), T.StringType()))]
    return _tables(df, payload, key, fields, [pa.string(), pa.int64(), pa.string(), pa.map_(pa.string(), pa.string())], lambda at, _: at.rpartition("/")[2] in RECORDS, make)
