"""Schemas that drift between files: tagged-union inference.

1. linked(): every column of every run becomes a typed branch, with the header of the run before that it goes on from. A
   column that goes and one that comes in the same run are one measure under a new header if their values agree on the
   rows that both runs share.
2. fused(): the parallel schemas of a series are fused into one union. Its paths are the chains of links (found by pointer
   jumping, whatever their length), and each path keeps the alternatives (header, type) it had, run by run.
3. schema_changes(): all changes are read off the union: a path that appears or ends, or whose alternative differs from that
   of the run before in its header or its type.
4. consistent_table(), fused_schema(): cells split into typed branches (boolean, integer, decimal, text) beside one canonical
   number, per measure; paths of different series are one measure if their first headers are linked.

Defined results:
* null, empty and header-less contents have no columns; a file that arrived twice counts once (of differing contents
  under one run number the smallest counts, by text order);
* headers compare without outer white space and byte-order marks, with case; of equal headers in one file the first counts;
* rows of blanks only are left out; short rows are filled with blanks, longer ones cut to the header;
* a column of blanks only has no type; missing runs give no comparison across the gap, paths start anew after it;
* null series, dataset or run numbers give no rows; an empty frame gives empty results.
"""

from __future__ import annotations

import csv
import functools
import io
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roadloom.functions.frames import stored

BLANK = frozenset({"", "na", "nan", "null"})
SEPARATORS = ",;\t|"
_INTEGER, _DECIMAL = re.compile(r"[+-]?\d+"), re.compile(r"[+-]?(?:\d+\.\d*|\.\d+|\d+(?=[eE]))(?:[eE][+-]?\d+)?")
_THOUSANDS = re.compile(r"[+-]?\d{1,3}(?:,\d{3})+")
_MEASURE = re.compile(r"([+-]?(?:\d[\d,]*\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)\s*(%|[A-Za-z]{1,5}\d?)?")
TYPES = ("boolean", "integer", "decimal", "text")


def read_csv(content: str | None) -> tuple[list[str], list[list[str]]]:
    """(headers, rows) of a delimited text in any of the known separators."""
    if not content:
        return [], []
    content = content.replace("\x00", "").lstrip("﻿")
    csv.field_size_limit(2**31 - 1)
    lines = content.lstrip("\r\n")
    if not lines.strip():
        return [], []
    head = lines.splitlines()[0]
    best: tuple = ()
    for k, sep in enumerate(SEPARATORS):
        width = len(next(csv.reader([head], delimiter=sep, skipinitialspace=True), []))
        best = max(best, (width, -k, sep))
    rows = [r for r in csv.reader(io.StringIO(lines, newline=""), delimiter=best[2], skipinitialspace=True) if any(c.strip() for c in r)]
    if not rows:
        return [], []
    names = [h.strip().strip("﻿").strip() for h in rows[0]]
    first = {n: k for k, n in reversed(list(enumerate(names))) if n}
    own = sorted(first.values())
    return [names[k] for k in own], [[(r[k].strip() if k < len(r) else "") for k in own] for r in rows[1:]]


def blank(cell: str) -> bool:
    return cell.strip().lower() in BLANK


def type_of(cells: list[str]) -> str | None:
    """boolean, integer, decimal or text over the trimmed non-blank cells; None if all are blank."""
    cells = [c.strip() for c in cells if not blank(c)]
    if not cells:
        return None
    if all(c.lower() in ("true", "false") for c in cells):
        return "boolean"
    if all(_INTEGER.fullmatch(c) for c in cells):
        return "integer"
    return "decimal" if all(_INTEGER.fullmatch(c) or _DECIMAL.fullmatch(c) for c in cells) else "text"


def canonical(cells: list[str]) -> list[float | None]:
    """The number each cell means, whatever branch it is in: a unit or per cent sign after it aside, with decimal commas and thousands commas told apart over the whole column."""
    found = [None if blank(c) else _MEASURE.fullmatch(c.strip()) for c in cells]
    commas = [m[1] for m in found if m and "," in m[1]]
    grouped = bool(commas) and all(_THOUSANDS.fullmatch(c) for c in commas)
    out: list[float | None] = []
    for c, m in zip(cells, found):
        if c.strip().lower() in ("true", "false"):
            out.append(float(c.strip().lower() == "true"))
        elif m:
            digits = m[1].replace(",", "") if grouped or m[1].count(",") > 1 or "." in m[1] else m[1].replace(",", ".")
            try:
                out.append(float(digits))
            except ValueError:
                out.append(None)
        else:
            out.append(None)
    return out


def _words(header: str) -> list[str]:
    return [w.lower() for w in re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+", header.replace("_", " "))]


def name_likeness(a: str, b: str) -> float:
    """1 for the same words in another notation, else the share of common words or common three-letter starts."""
    u, v = _words(a), _words(b)
    if "".join(u) == "".join(v):
        return 1.0
    x, y = {w[:4] for w in u}, {w[:4] for w in v}
    return len(x & y) / len(x | y) if x | y else 0.0


def _close(a: float, b: float, within: float) -> bool:
    return abs(a - b) <= within * max(abs(a), abs(b)) + 1e-12


class _File:
    def __init__(self, content: str | None):
        self.names, self.rows = read_csv(content)
        self.cells = {n: [r[k] for r in self.rows] for k, n in enumerate(self.names)}
        self.types = {n: type_of(c) for n, c in self.cells.items()}
        self.numbers = {n: canonical(c) for n, c in self.cells.items()}


#: Rows of b that agree with a row in a column are listed one by one up to this number; beyond it the column is crowded for that row, and both meet by what rows have in common there (_match).
BAND = 64


def _candidates(a: _File, b: _File, within: float, crowded: dict[str, list[int]] | None = None) -> dict[tuple[int, int], float]:
    """(row of a, row of b) -> how much their common columns agree, of the rows that agree in any; columns where more than BAND
    rows of b agree with a row of a don't count for that row, which goes to crowded, by column.

    Rows meet by an index of each column of b, not pair by pair, so that long files stay linear.
    """
    agree: dict[tuple[int, int], float] = {}
    for n in a.names:
        if n not in b.cells:
            continue
        numbers = sorted((y, j) for j, y in enumerate(b.numbers[n]) if y is not None)
        texts: dict[str, list[int]] = {}
        for j, cell in enumerate(b.cells[n]):
            if not blank(cell):
                texts.setdefault(cell.strip().lower(), []).append(j)
        told = _told(a, n)
        for i, (x, cell) in enumerate(zip(a.numbers[n], a.cells[n], strict=True)):
            first = last = 0
            if x is not None:
                lo, hi = sorted((x * (1 - within), x / (1 - within)))
                first, last = bisect_left(numbers, (lo - 2e-12, -1)), bisect_right(numbers, (hi + 2e-12, len(b.rows)))
            held = texts.get(cell.strip().lower(), ()) if not blank(cell) else ()
            if held and x is not None and b.numbers[n][held[0]] is not None:
                held = ()  # numbers on both sides (a text's number is the same in all rows): they have met as such
            if max(last - first, len(held)) > BAND:
                if crowded is not None:
                    crowded.setdefault(n, []).append(i)
                continue
            for y, j in numbers[first:last]:
                if _close(x, y, within):
                    agree[i, j] = agree.get((i, j), 0.0) + _weight(x)
            for j in held:
                agree[i, j] = agree.get((i, j), 0.0) + told
    return agree


def _weight(x: float) -> float:
    return 1.0 if x not in (0.0, 1.0) else 0.05


def _told(a: _File, name: str) -> float:
    return 1.0 if len(set(map(str.lower, a.cells[name]))) > 1 else 0.05


class _Column:
    """A common column as arrays: by how much rows of a and of b agree in it."""

    def __init__(self, a: _File, b: _File, name: str, within: float, crowded: list[int]):
        self.within, self.told = within, _told(a, name)
        self.x, self.y = (np.array([np.nan if v is None else v for v in f.numbers[name]], dtype=float) for f in (a, b))
        ids: dict[str, int] = {}
        self.p, self.q = (np.array([-1 if blank(c) else ids.setdefault(c.strip().lower(), len(ids)) for c in f.cells[name]], dtype=np.int64) for f in (a, b))
        self.crowded = np.zeros(len(self.x), dtype=bool)
        self.crowded[crowded] = True

    def agree(self, i: np.ndarray | int, j: np.ndarray) -> np.ndarray:
        x, y, p = self.x[i], self.y[j], self.p[i]
        with np.errstate(invalid="ignore", over="ignore"):
            near = (np.abs(x - y) <= self.within * np.maximum(np.abs(x), np.abs(y)) + 1e-12) & np.isfinite(x) & np.isfinite(y)
        same = (p == self.q[j]) & (p >= 0) & (np.isnan(x) | np.isnan(y))
        return np.where(near, np.where((x == 0.0) | (x == 1.0), 0.05, 1.0), np.where(same, self.told, 0.0))

    def apart(self) -> np.ndarray:
        """A number per row of b, the same for equal cells, -1 for those that no crowded row agrees with."""
        rows = np.flatnonzero(self.crowded)
        _, j = np.unique(self.q, return_index=True)
        met_ids = np.zeros(self.q.max(initial=0) + 1, dtype=bool)
        for i in rows[np.unique(self.p[rows], return_index=True)[1]].tolist():
            met_ids[self.q[j[self.agree(i, j) > 0]]] = True
        return np.where((self.q >= 0) & met_ids[self.q], self.q, -1)


def _classes(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(a row of each class, the class of each row) of the rows that are equal in all columns."""
    _, first, own = np.unique(np.stack(rows, axis=1), axis=0, return_index=True, return_inverse=True)
    return first, own.reshape(-1)


def _shared_rows(a: _File, b: _File, within: float) -> list[tuple[int, int]]:
    """Rows of both files that are the same record: matched by how many of the common columns agree, then by how near their
    places are. All rows that agree in any column may meet, however many hold a value."""
    crowded: dict[str, list[int]] = {}
    agree = _candidates(a, b, within, crowded)
    if crowded:
        return _match(a, b, within, list(agree), crowded)
    taken_a: set[int] = set()
    taken_b: set[int] = set()
    pairs = []
    for _, _, i, j in sorted((-agree, abs(i - j), i, j) for (i, j), agree in agree.items()):
        if i not in taken_a and j not in taken_b:
            taken_a.add(i)
            taken_b.add(j)
            pairs.append((i, j))
    return pairs


def _match(a: _File, b: _File, within: float, listed: list[tuple[int, int]], crowded: dict[str, list[int]]) -> list[tuple[int, int]]:
    """The matching of _shared_rows() where columns are crowded, without a list of all pairs.

    Rows of a with the same cells in their crowded columns are one class, and so are rows of b with the same cells there: two
    rows that aren't listed agree as their classes do. Agreements are gone through from the highest. At each, the nearest two
    rows of matching classes are neighbours among the rows left, so every row offers only the nearest row on either side, and
    nothing beyond the next row of its own class, which would be nearer. Memory stays linear in the rows; time does in the
    product of the rows of one file and the classes of the other, at most.
    """
    columns = [_Column(a, b, n, within, crowded.get(n, [])) for n in a.names if n in b.cells]
    i, j = (np.array([pair[k] for pair in listed], dtype=np.int64) for k in (0, 1))
    total = np.zeros(len(listed))
    for c in columns:
        total += c.agree(i, j)
    order = np.lexsort((j, i, np.abs(i - j), -total))
    listed = list(zip(total[order].tolist(), i[order].tolist(), j[order].tolist()))

    full = [c for c in columns if c.crowded.any()]
    apart = [c.apart() for c in full]
    some_a, class_a = _classes([np.where(c.crowded, c.p, -1) for c in full])
    some_b, class_b = _classes(apart)
    free_a, free_b, left_b = np.ones(len(class_a), dtype=bool), np.ones(len(class_b), dtype=bool), np.bincount(class_b)

    @functools.lru_cache(maxsize=max(1, 4_000_000 // len(some_b)))
    def score(k: int) -> np.ndarray:
        """How much class k of a agrees with each of b."""
        out, row = np.zeros(len(some_b)), some_a[k]
        for c, own in zip(full, apart):
            if c.crowded[row]:
                out += np.where(own[some_b] >= 0, c.agree(row, some_b), 0.0)
        return out

    before, after = np.full(len(class_a), -1), np.full(len(class_a), len(class_a) + len(class_b))  # the next rows left of the class
    by_class = np.lexsort((np.arange(len(class_a)), class_a))
    beside = class_a[by_class[1:]] == class_a[by_class[:-1]]
    before[by_class[1:][beside]], after[by_class[:-1][beside]] = by_class[:-1][beside], by_class[1:][beside]

    def nearest(i: int, start: int, right: bool, level: float) -> int | None:
        """The first row of b left from start on, short of the next row of i's class, that agrees with i as the level says."""
        end, wide = (min(int(after[i]), len(class_b)), 64) if right else (int(before[i]), 64)
        while start < end if right else start > end:
            stop = min(start + wide, end) if right else max(start - wide, end)
            at = slice(start, stop) if right else slice(stop + 1, start + 1)
            found = np.flatnonzero(free_b[at] & (score(int(class_a[i]))[class_b[at]] == level))
            if len(found):
                return at.start + int(found[0 if right else -1])
            start, wide = stop, 2 * wide
        return None

    pairs, at = [], 0
    rows_of, waiting = np.split(by_class, np.flatnonzero(~beside) + 1), []

    def put_back(k: int) -> None:
        top = np.max(score(k)[left_b > 0], initial=0.0)
        if top > 0 and free_a[rows_of[k]].any():
            heappush(waiting, (-float(top), k))

    for k in range(len(some_a)):
        put_back(k)
    while waiting or at < len(listed):
        level = max(-waiting[0][0] if waiting else 0.0, listed[at][0] if at < len(listed) else 0.0)
        heap: list[tuple] = []
        while at < len(listed) and listed[at][0] == level:
            _, i, j = listed[at]
            heap.append((abs(i - j), i, j, None))
            at += 1
        active = []
        while waiting and -waiting[0][0] == level:
            _, k = heappop(waiting)
            if np.max(score(k)[left_b > 0], initial=0.0) == level:
                active.append(k)
            else:
                put_back(k)
        heapify(heap)

        def offer(i: int, start: int, right: bool) -> None:
            j = nearest(i, start, right, level)
            if j is not None:
                heappush(heap, (abs(i - j), i, j, right))

        for k in active:
            for i in rows_of[k][free_a[rows_of[k]]].tolist():
                offer(i, i, True)
                offer(i, min(i, len(class_b)) - 1, False)
        on = set(active)
        while heap:
            _, i, j, right = heappop(heap)
            if not free_a[i]:
                continue
            if not free_b[j]:
                if right is not None:
                    offer(i, j + 1 if right else j - 1, right)
                continue
            free_a[i] = free_b[j] = False
            left_b[class_b[j]] -= 1
            pairs.append((i, j))
            left, next_ = int(before[i]), int(after[i])
            if left >= 0:
                after[left] = next_
            if next_ < len(class_a):
                before[next_] = left
            if int(class_a[i]) in on:
                if left >= 0:
                    offer(left, i, True)
                if next_ < len(class_a):
                    offer(next_, min(i, len(class_b) - 1), False)
        for k in active:
            put_back(k)
    return pairs


def _agreement(a: _File, b: _File, old: str, new: str, rows: list[tuple[int, int]], within: float) -> float | None:
    """Share of the shared rows in which the two columns mean the same value; None if no row can tell."""
    told = same = 0
    for i, j in rows:
        p, q = a.cells[old][i], b.cells[new][j]
        if blank(p) or blank(q):
            continue
        told += 1
        x, y = a.numbers[old][i], b.numbers[new][j]
        if x is not None and y is not None:
            same += _close(x, y, within)
        else:
            same += p.strip().lower() == q.strip().lower()
    return same / told if told else None


def renames(a: _File, b: _File, within: float = 0.04) -> list[tuple[str, str]]:
    """(old header, new header) of the measures that go on under another header."""
    gone, come = [n for n in a.names if n not in b.cells], [n for n in b.names if n not in a.cells]
    if not gone or not come:
        return []
    rows = _shared_rows(a, b, within)
    kept = [n for n in a.names if n in b.cells]
    scored = []
    for old in gone:
        for new in come:
            likeness = name_likeness(old, new)
            agree = _agreement(a, b, old, new, rows, within)
            numeric = any(v is not None for v in a.numbers[old]) and any(v is not None for v in b.numbers[new])
            place = _same_place(a, b, old, new)
            same_layout = 2 * len(kept) >= min(len(a.names), len(b.names)) and _key_like(a, old) == _key_like(b, new)
            score = 0.0
            if agree is not None and numeric and agree < 0.6 and (likeness > 0 or place) and {a.types[old], b.types[new]} == {"integer", "decimal"}:
                score = 0.6 * _rounded(a, b, old, new, rows) + 0.3 * likeness
            if score > 0.5:
                pass
            elif agree is not None and numeric:
                score = agree + 0.3 * likeness + 0.1 * place if agree >= 0.6 or likeness == 1.0 and agree >= 0.3 else 0.0
            elif a.types[old] == b.types[new] == "text" and not any(v is not None for v in a.numbers[old] + b.numbers[new]):
                texts, other = {c.strip().lower() for c in a.cells[old] if not blank(c)}, {c.strip().lower() for c in b.cells[new] if not blank(c)}
                alike = max(agree or 0.0, len(texts & other) / max(1, min(len(texts), len(other))), _kind(texts, other) if same_layout else 0.0)
                score = alike + 0.3 * likeness + 0.1 * place if alike >= 0.5 else 0.0
            elif same_layout and _key_like(a, old) and "integer" in (a.types[old], b.types[new]) and "text" in (a.types[old], b.types[new]) and likeness > 0:
                score = 0.5 + 0.3 * likeness  # names of the rows that became codes, or the other way round
            elif likeness == 1.0 and (kept or len(gone) == 1):
                score = 0.9 + 0.1 * place  # blank, or of another kind now: only the name can tell
            elif agree is None and not numeric and place and likeness >= 0.3 and None in (a.types[old], b.types[new]):
                score = 0.5
            if score > 0:
                scored.append((-score, a.names.index(old), b.names.index(new), old, new))
    out: dict[str, str] = {}
    for _, _, _, old, new in sorted(scored):
        if old not in out and new not in out.values():
            out[old] = new
    return list(out.items())


def _kind(u: set[str], v: set[str]) -> float:
    """Whether two sets of texts look like one kind: all paths, or all free remarks of a few words."""
    path = lambda s: bool(s) and all("/" in t for t in s)
    free = lambda s: bool(s) and all("/" not in t and not re.fullmatch(r"[\w-]+\d[\w-]*", t) for t in s)
    return 0.6 if path(u) and path(v) else 0.5 if free(u) and free(v) else 0.0


def _rounded(a: _File, b: _File, old: str, new: str, rows: list[tuple[int, int]]) -> bool:
    """One column is the other one rounded to whole numbers."""
    told = [(x, y) for i, j in rows if (x := a.numbers[old][i]) is not None and (y := b.numbers[new][j]) is not None]
    return bool(told) and all(abs(x - y) <= 0.5 + 0.04 * max(abs(x), abs(y)) for x, y in told)


def _key_like(file: _File, name: str) -> bool:
    """Hardly a value twice: the column names its rows (a file's doubled rows aside)."""
    rows = {tuple(c.lower() for c in r) for r in file.rows}
    k = file.names.index(name)
    held = [r[k] for r in rows if not blank(r[k])]
    return len(held) >= 3 and len(set(held)) == len(held)


def _same_place(a: _File, b: _File, old: str, new: str) -> bool:
    """Between the same neighbours, or at the same end."""
    i, j = a.names.index(old), b.names.index(new)
    before = i > 0 and j > 0 and a.names[i - 1] == b.names[j - 1]
    after = i + 1 < len(a.names) and j + 1 < len(b.names) and a.names[i + 1] == b.names[j + 1]
    return before or after or i == j


def links(previous: str | None, current: str | None, compared: bool) -> list[tuple[str | None, str | None, str | None]]:
    """(header, type, header in the run before) of the columns of a run; header and type are None for a column that ends."""
    b = _File(current)
    if not compared:
        return [(n, b.types[n], None) for n in b.names]
    a = _File(previous)
    renamed = {new: old for old, new in renames(a, b)}
    out: list[tuple] = [(n, b.types[n], n if n in a.cells else renamed.get(n)) for n in b.names]
    held = {before for _, _, before in out}
    return out + [(None, None, n) for n in a.names if n not in held]


def _runs(files: DataFrame) -> DataFrame:
    """One row per series, dataset and run, whatever was sent twice."""
    ok = F.col("series_id").isNotNull() & F.col("dataset").isNotNull() & F.col("run_no").isNotNull()
    return files.filter(ok).groupBy("series_id", "dataset", "run_no").agg(F.min("content").alias("content"))


RUN = ("series_id", "dataset", "run_no")


def linked(files: DataFrame) -> DataFrame:
    """series_id, dataset, run_no, name, tag, before, compared: the typed branches of every run, see links().

    compared: the run before is there. One aggregation and one equi-join on (series, dataset, run): no series is ever
    gathered in one task.
    """
    runs = _runs(files)
    last = runs.select("series_id", "dataset", (F.col("run_no") + 1).cast(runs.schema["run_no"].dataType).alias("run_no"), F.col("content").alias("previous"), F.lit(True).alias("compared"))
    both = runs.join(last, list(RUN), "left").select(*RUN, "previous", "content", F.coalesce("compared", F.lit(False)).alias("compared"))
    kind = T.StructType([*(both.schema[c] for c in RUN), *(T.StructField(n, T.StringType()) for n in ("name", "tag", "before")), T.StructField("compared", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            origin, out = [], ([], [], [])
            for k, pair in enumerate(zip(*(batch.column(c).to_pylist() for c in (3, 4, 5)))):
                for branch in links(*pair):
                    origin.append(k)
                    for o, v in zip(out, branch, strict=True):
                        o.append(v)
            at = pa.array(origin, pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(at) for k in range(3)), *(pa.array(o, pa.string()) for o in out), batch.column(5).take(at)], names=kind.names)

    return both.mapInArrow(run, kind)


def fused(files: DataFrame) -> DataFrame:
    """The union of every series' schemas: series_id, dataset, first_run, first_name (the path), run_no, name, tag, compared.

    A row is the alternative that a path has in a run; name is null in the run a path has ended by. The path of a branch is
    where its links start. Every round doubles the length of what is linked, so chains of n runs take log2(n) rounds.
    """
    start = F.col("before").isNull()
    rows = linked(files).select(*RUN, "name", "tag", "compared", F.when(start, F.col("run_no")).otherwise(F.col("run_no") - 1).alias("first_run"), F.when(start, F.col("name")).otherwise(F.col("before")).alias("first_name"), start.alias("settled"))
    rows = stored(rows)
    key = ["series_id", "dataset", "first_run", "first_name"]
    while not rows.filter(~F.col("settled")).isEmpty():
        up = rows.filter("name is not null").select("series_id", "dataset", F.col("run_no").alias("first_run"), F.col("name").alias("first_name"), F.col("first_run").alias("up_run"), F.col("first_name").alias("up_name"), F.col("settled").alias("up_settled"))
        jumped = rows.filter(~F.col("settled")).join(up, key).select(*RUN, "name", "tag", "compared", F.col("up_run").alias("first_run"), F.col("up_name").alias("first_name"), F.col("up_settled").alias("settled"))
        rows = stored(rows.filter("settled").unionByName(jumped))
    return rows.drop("settled")


def schema_changes(files: DataFrame, union: DataFrame | None = None) -> DataFrame:
    """series_id, dataset, run_no, change_kind, old_name, new_name of every run against the run before it, read off fused()."""
    union = fused(files) if union is None else union
    path = ["series_id", "dataset", "first_run", "first_name"]
    before = union.filter("name is not null").select(*path, (F.col("run_no") + 1).cast(union.schema["run_no"].dataType).alias("run_no"), F.col("name").alias("old_name"), F.col("tag").alias("old_tag"))
    both = union.join(before, [*path, "run_no"], "left")
    old, new = F.col("old_name"), F.col("name")
    kind = F.when(old.isNull() & new.isNotNull() & F.col("compared"), "added").when(old.isNotNull() & new.isNull(), "removed").when(old != new, "renamed")
    change = lambda k: F.struct(k.alias("change_kind"), F.coalesce(old, F.lit("")).alias("old_name"), F.coalesce(new, F.lit("")).alias("new_name"))
    told = F.array(F.when(kind.isNotNull(), change(kind)), F.when(F.col("tag") != F.col("old_tag"), change(F.lit("type_changed"))))
    return both.select(*RUN, F.explode(F.array_compact(told)).alias("c")).select(*RUN, "c.*")


CELL = "series_id bigint, dataset string, run_no int, row_no int, name string, tag string, as_boolean boolean, as_integer bigint, as_decimal double, as_text string, canonical double"


def cells(files: DataFrame) -> DataFrame:
    """Every non-blank cell of every run as a tagged union: its column's type as the tag, the branch of that type, and the canonical number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(11)]
            for s, d, r, content in zip(*(batch.column(k).to_pylist() for k in range(4))):
                file = _File(content)
                for name in file.names:
                    tag = file.types[name]
                    for k, (cell, number) in enumerate(zip(file.cells[name], file.numbers[name])):
                        if blank(cell):
                            continue
                        whole = int(cell) if tag == "integer" and -(2**63) <= int(cell) < 2**63 else None
                        for o, v in zip(out, (s, d, r, k, name, tag, cell.lower() == "true" if tag == "boolean" else None, whole, float(cell) if tag == "decimal" else None, cell if tag == "text" else None, number), strict=True):
                            o.append(v)
            kinds = (pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.bool_(), pa.int64(), pa.float64(), pa.string(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(o, t) for o, t in zip(out, kinds, strict=True)], names=[f.split()[0] for f in CELL.split(", ")])

    return _runs(files).select(F.col("series_id").cast("bigint"), F.col("dataset").cast("string"), F.col("run_no").cast("int"), "content").mapInArrow(run, CELL)


def measures(union: DataFrame, most_names: int = 10_000) -> dict[tuple[str, str], str]:
    """(dataset, header) -> the measure it belongs to: headers that follow each other on the paths of the dataset.

    It only names alike the paths of different series (see measured()); within a series a path holds all its headers. A link
    counts if it is found in at least a twentieth of the renames of its old header, so that one mistaken pair doesn't fuse two
    measures. Header names are schema, not data: more than most_names links is an error, not a collect.
    """
    path = ["series_id", "dataset", "first_run", "first_name"]
    before = union.filter("name is not null").select(*path, (F.col("run_no") + 1).alias("run_no"), F.col("name").alias("old_name"))
    renamed = union.filter("name is not null").join(before, [*path, "run_no"]).filter("name <> old_name")
    found = renamed.groupBy("dataset", "old_name", F.col("name").alias("new_name")).agg(F.count("*").alias("n")).limit(most_names + 1).collect()
    if len(found) > most_names:
        raise ValueError(f"more than {most_names} distinct renames: the files aren't of a few datasets")
    total: dict[tuple, int] = {}
    for r in found:
        total[r.dataset, r.old_name] = total.get((r.dataset, r.old_name), 0) + r.n
    parent: dict[tuple, tuple] = {}

    def top(k: tuple) -> tuple:
        while parent.get(k, k) != k:
            k = parent[k]
        return k

    for r in sorted(found, key=lambda r: (-r.n, r.old_name, r.new_name)):
        if 20 * r.n >= total[r.dataset, r.old_name]:
            a, b = top((r.dataset, r.old_name)), top((r.dataset, r.new_name))
            if a != b:
                keep, drop = sorted((a, b), key=lambda k: (len(_words(k[1])) < 2, k[1] != k[1].lower(), -len(k[1]), k[1]))
                parent[drop] = keep
                parent.setdefault(keep, keep)
    return {k: top(k)[1] for k in parent}


def measured(files: DataFrame, union: DataFrame) -> DataFrame:
    """cells() with the measure of each: that of its path's first header; measures() links the first headers of different
    paths. If two columns of one file meet in one measure, the one named like it (else the first by name) has it, and the
    other is kept and reported as `measure [header]`."""
    named = files.sparkSession.createDataFrame([(d, n, m) for (d, n), m in measures(union).items()], "dataset string, first_name string, measure string")
    file = list(RUN)
    meant = union.filter("name is not null").join(F.broadcast(named), ["dataset", "first_name"], "left").withColumn("measure", F.coalesce("measure", "first_name"))
    place = F.row_number().over(Window.partitionBy(*file, "measure").orderBy(F.col("name") != F.col("measure"), "name"))
    own = meant.withColumn("place", place).select(*file, "name", F.when(F.col("place") == 1, F.col("measure")).otherwise(F.concat("measure", F.lit(" ["), "name", F.lit("]"))).alias("measure"))
    return cells(files).join(own, [*file, "name"])


def consistent_table(files: DataFrame, union: DataFrame | None = None) -> DataFrame:
    """One row per row of every run, in one schema per dataset: series_id, dataset, run_no, row_no and a map from measure to
    its tagged union (tag, typed branches, canonical number). fused_schema() lists the measures and their alternatives."""
    union = fused(files) if union is None else union
    branches = F.struct("tag", "as_boolean", "as_integer", "as_decimal", "as_text", "canonical")
    cell = measured(files, union).select(*RUN, "row_no", F.struct("measure", branches.alias("u")).alias("cell"))
    return cell.groupBy(*RUN, "row_no").agg(F.map_from_entries(F.sort_array(F.collect_list("cell"))).alias("fields"))


def fused_schema(files: DataFrame, union: DataFrame | None = None) -> DataFrame:
    """Per dataset and measure: its headers, the type alternatives that appeared, and the run each alternative first appeared in."""
    cell = measured(files, fused(files) if union is None else union)
    return cell.groupBy("dataset", "measure", "tag").agg(F.array_sort(F.collect_set("name")).alias("headers"), F.count("*").alias("n_cells"), F.min("run_no").alias("first_run"))
