"""Long exact spans shared between documents, found through sketched and exactly grouped windows.

A window is any stretch of `least` characters; a character is shared if a window that covers it stands verbatim in
another document. Windows are not handled one by one: runs of neighbouring windows with the same minimizer (the
smallest hash of the `gram`-character grams in the window) form a segment, and equal windows always lie in segments of
the same minimizer.

1. Sketch: each partition counts its documents' distinct minimizers in a count-min sketch of saturating counters, which has
   LOAD counters for each minimizer expected, however large the input is. The sketch exists in ranges of counters only:
   partitions send what they touched to its ranges, where they are merged, and each range answers every partition about the
   counters it asked for. Merged, the sketch never underestimates how many documents hold a minimizer.
2. Second pass: only segments whose minimizer is estimated in two or more documents leave their partition, with a
   128-bit hash of their whole stretch. Grouped exactly, a stretch held by two documents settles all its windows. The answers
   lie in the shared folder, a file per partition; a counter that a file doesn't know counts as repeated, so that a changed
   partitioning costs time and loses nothing.
3. The segments left over that share their minimizer with another document (the edges of passages) are compared window
   by window: every distinct stretch of such a minimizer is expanded to its window hashes, and these are grouped.
4. Neighbouring shared windows are joined to maximal runs, in each document by itself.

All groups are reduced to the smallest and the largest document id on the map side; no group is gathered, and no pairs
are made, so a passage held by a third of all documents costs as many rows as it has occurrences.

Defined results: null texts and texts shorter than `least` share nothing; a stretch repeated within one document only
isn't shared; rows that repeat a document id are one document; null ids are left out; equal texts are shared from end to
end; ties don't arise. Positions count Unicode characters. Texts of any length are used whole.
"""

from __future__ import annotations

import math
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roadloom.functions.frames import removed, shared_folder, spread, stored

LEAST, GRAM = 200, 100
#: Counters per expected minimizer and row of the sketch, and its rows: about one in seventy single minimizers passes.
LOAD, ROWS = 8, 2
_CHUNK = 2**16

_A, _B = np.uint64(0x9E3779B97F4A7C15 | 1), np.uint64(0xD6E8FEB86659FD93 | 1)
_ODD = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection that scatters (the finalizer of splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * _ODD[0]
    h = (h ^ (h >> np.uint64(27))) * _ODD[1]
    return h ^ (h >> np.uint64(31))


class Powers:
    """Powers of an odd base and of its inverse, mod 2^64, grown as texts need them."""

    def __init__(self, base: np.uint64):
        self.base, self.inverse = base, np.uint64(pow(int(base), -1, 2**64))
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) <= n:
            size = max(n + 1, 2 * len(self.up))
            self.up, self.down = (np.multiply.accumulate(np.r_[np.uint64(1), np.full(size - 1, b, dtype=np.uint64)]) for b in (self.base, self.inverse))
        return self.up[: n + 1], self.down[: n + 1]


_POWERS = {"a": Powers(_A), "b": Powers(_B)}


def prefix_sums(points: np.ndarray, base: str = "a") -> np.ndarray:
    """S with hash(i, j) = (S[j] - S[i]) * base^j."""
    _, down = _POWERS[base].to(len(points))
    out = np.zeros(len(points) + 1, dtype=np.uint64)
    np.cumsum((mix(points.astype(np.uint64) + np.uint64(0x632BE59BD9B4E019)) * down[1:]), out=out[1:])
    return out


def stretch_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray, base: str = "a") -> np.ndarray:
    """Hashes of the stretches [start, end); the same characters and length give the same hash wherever they stand."""
    up, _ = _POWERS[base].to(len(sums) - 1)
    return (sums[end] - sums[start]) * up[end]


def window_minima(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every `width` neighbouring values."""
    n = len(values) - width + 1
    if n <= 0:
        return values[:0]
    pad = -len(values) % width
    blocks = np.concatenate([values, np.full(pad, np.iinfo(values.dtype).max, dtype=values.dtype)]).reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")


def segments(points: np.ndarray, least: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first window, number of windows, minimizer, prefix sums) of the runs of windows with one minimizer."""
    none = np.empty(0, dtype=np.int64)
    if len(points) < least:
        return none, none, none.astype(np.uint64), none.astype(np.uint64)
    sums = prefix_sums(points)
    at = np.arange(len(points) - gram + 1)
    lows = window_minima(mix(stretch_hash(sums, at, at + gram)), least - gram + 1)
    first = np.flatnonzero(np.r_[True, lows[1:] != lows[:-1]])
    return first, np.diff(np.r_[first, len(lows)]), lows[first], sums


class Sketch:
    """A count-min sketch whose counters stop at two, of which only the touched ones are kept and sent."""

    def __init__(self, counters: int, rows: int = ROWS):
        self.counters, self.rows = counters, rows
        self.once: list[np.ndarray] = [np.empty(0, dtype=np.int64)] * rows
        self.more: list[np.ndarray] = [np.empty(0, dtype=np.int64)] * rows
        self.waiting: list[np.ndarray] = []
        self.size = 0

    @staticmethod
    def places(keys: np.ndarray, row: int, counters: int) -> np.ndarray:
        return (mix(keys + np.uint64((row + 1) * int(_A) % 2**64)) % np.uint64(counters)).astype(np.int64)

    def add(self, keys: np.ndarray) -> None:
        self.waiting.append(keys)
        self.size += len(keys)
        if self.size > 2_000_000:
            self.settle()

    def settle(self) -> None:
        if not self.waiting:
            return
        keys = np.concatenate(self.waiting)
        self.waiting, self.size = [], 0
        for r in range(self.rows):
            at, count = np.unique(self.places(keys, r, self.counters), return_counts=True)
            again = np.intersect1d(at, self.once[r], assume_unique=True)
            self.more[r] = np.union1d(self.more[r], np.concatenate([at[count > 1], again]))
            self.once[r] = np.union1d(self.once[r], at)

    def chunks(self) -> Iterator[tuple[int, bytes, bytes]]:
        """(chunk number, offsets of the counters touched, offsets of those at two) of the chunks with any."""
        self.settle()
        per_row = -(-self.counters // _CHUNK)
        for r in range(self.rows):
            for chunk in np.unique(self.once[r] // _CHUNK).tolist():
                lo, hi = chunk * _CHUNK, (chunk + 1) * _CHUNK
                cut = [(a[np.searchsorted(a, lo) : np.searchsorted(a, hi)] - lo).astype("<u2").tobytes() for a in (self.once[r], self.more[r])]
                yield r * per_row + chunk, *cut


def _texts(documents: DataFrame, doc_id: str, text: str) -> DataFrame:
    ok = documents[f"`{doc_id}`"].isNotNull() & documents[f"`{text}`"].isNotNull()
    return spread(documents.filter(ok).select(documents[f"`{doc_id}`"].cast("bigint").alias("doc"), documents[f"`{text}`"].cast("string").alias("text")))


def counters_for(texts: DataFrame, least: int, gram: int, load: int = LOAD) -> int:
    """A power of two of at least `load` counters for each minimizer that texts of this size have (two for each window width)."""
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return 2 ** max(16, math.ceil(math.log2(max(1, load * 2 * size / (least - gram + 2)))))


ASKED, ANSWER = "part int, chunk bigint, once binary, more binary", "part int, chunk bigint, once binary, bits binary"


def _table(columns: list, schema: str) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary()}
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


def sketch_answers(texts: DataFrame, least: int, gram: int, counters: int, rows: int) -> DataFrame:
    """Per partition of texts and range of counters: those it touched, and a bit for each that has reached two in the merged sketch."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, part = Sketch(counters, rows), TaskContext.get().partitionId()
        for batch in batches:
            for x in batch.column(1):
                own.add(np.unique(segments(code_points(x.as_py()), least, gram)[2]))
        out: list[tuple] = []
        for touched in own.chunks():
            out.append((part, *touched))
            if len(out) == 4096:
                yield _table(list(zip(*out)), ASKED)
                out = []
        if out:
            yield _table(list(zip(*out)), ASKED)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, held = None, []

        def answers() -> pa.RecordBatch:
            counts = np.zeros(_CHUNK, dtype=np.uint8)
            touched = [np.frombuffer(a, dtype="<u2") for _, a, _ in held]
            for a, (_, _, b) in zip(touched, held):
                counts[a] = np.minimum(2, counts[a] + 1)
                counts[np.frombuffer(b, dtype="<u2")] = 2
            return _table([[p for p, _, _ in held], [chunk] * len(held), [a for _, a, _ in held], [np.packbits(counts[a] >= 2).tobytes() for a in touched]], ANSWER)

        for batch in batches:
            for part, own, once, more in zip(*(batch.column(k).to_pylist() for k in range(4))):
                if own != chunk:
                    if held:
                        yield answers()
                    chunk, held = own, []
                held.append((part, once, more))
        if held:
            yield answers()

    return texts.mapInArrow(sketch, ASKED).repartition("chunk").sortWithinPartitions("chunk").mapInArrow(merge, ANSWER)


def _own_answers(where: str, part: int, counters: int, rows: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per row of the sketch: (counters that the partition touched, ascending; whether each has reached two)."""
    system, root = (fs.LocalFileSystem(), re.sub("^file:/*", "/", where)) if re.match("file:|/", where) else fs.FileSystem.from_uri(where)
    folder, per_row = f"{root}/part={part}", -(-counters // _CHUNK)
    found: list[tuple[list, list]] = [([], []) for _ in range(rows)]
    if system.get_file_info(folder).type == fs.FileType.Directory:
        table = pq.read_table(folder, filesystem=system, partitioning=None, columns=["chunk", "once", "bits"]).sort_by("chunk")
        for chunk, once, bits in zip(*(table.column(c).to_pylist() for c in ("chunk", "once", "bits"))):
            at = np.frombuffer(once, dtype="<u2").astype(np.int64)
            touched, twice = found[chunk // per_row]
            touched.append(at + chunk % per_row * _CHUNK)
            twice.append(np.unpackbits(np.frombuffer(bits, dtype=np.uint8), count=len(at)).astype(bool))
    return [(np.concatenate(t), np.concatenate(b)) if t else (np.empty(0, dtype=np.int64), np.empty(0, dtype=bool)) for t, b in found]


def _repeated(answers: list[tuple[np.ndarray, np.ndarray]], keys: np.ndarray, counters: int) -> np.ndarray:
    """Whether the sketch estimates two documents or more for each key; a counter without an answer counts as repeated."""
    out = np.ones(len(keys), dtype=bool)
    for r, (touched, twice) in enumerate(answers):
        if len(touched):
            place = Sketch.places(keys, r, counters)
            at = np.minimum(np.searchsorted(touched, place), len(touched) - 1)
            out &= twice[at] | (touched[at] != place)
    return out


SEGMENT = "low bigint, hash_a bigint, hash_b bigint, doc bigint, first int, n int"


def candidate_segments(texts: DataFrame, answers: str, counters: int, least: int = LEAST, gram: int = GRAM, rows: int = ROWS) -> DataFrame:
    """Segments whose minimizer the sketch estimates in two or more documents, with the hash of their whole stretch.

    answers: the folder of sketch_answers(), by partition.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _own_answers(answers, TaskContext.get().partitionId(), counters, rows)
        for batch in batches:
            out: list[list[np.ndarray]] = [[] for _ in range(6)]
            for doc, x in zip(batch.column(0).to_pylist(), batch.column(1)):
                points = code_points(x.as_py())
                first, n, low, sums = segments(points, least, gram)
                kept = np.flatnonzero(_repeated(known, low, counters))
                if len(kept):
                    first, n, end = first[kept], n[kept], first[kept] + n[kept] + least - 1
                    hashes = [mix(stretch_hash(s, first, end, b) + n.astype(np.uint64)) for s, b in ((sums, "a"), (prefix_sums(points, "b"), "b"))]
                    for o, v in zip(out, (low[kept], *hashes, np.full(len(kept), doc), first, n), strict=True):
                        o.append(v)
            kinds = (np.int64, np.int64, np.int64, np.int64, np.int32, np.int32)
            yield pa.RecordBatch.from_arrays([pa.array((np.concatenate(o) if o else np.empty(0)).astype(np.uint64).view(np.int64) if k == np.int64 else (np.concatenate(o) if o else np.empty(0)).astype(k)) for o, k in zip(out, kinds, strict=True)], names=[f.split()[0] for f in SEGMENT.split(", ")])

    return texts.mapInArrow(run, SEGMENT)


SLICE = "doc bigint, first int, n int, d0 bigint, d1 bigint, own boolean, piece string"


def _slices(texts: DataFrame, wanted: DataFrame, least: int) -> DataFrame:
    """The wanted segments (doc, first, n, d0, d1, own) with their stretches of text."""
    per_doc = wanted.groupBy("doc").agg(F.collect_list(F.struct("first", "n", "d0", "d1", "own")).alias("list"))  # bounded by the document's own segments
    both = texts.join(per_doc, "doc").select("doc", "text", "list")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in SLICE.split(", ")]
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.string())
        for batch in batches:
            rows = []
            for doc, x, items in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                text = x.as_py()
                for i in items:
                    end = i["first"] + i["n"] + least - 1
                    if end <= len(text):  # a second text under one id may be shorter: it is no place of this segment
                        rows.append((doc, i["first"], i["n"], i["d0"], i["d1"], i["own"], text[i["first"] : end]))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 7, kinds)], names=names)

    return both.mapInArrow(run, SLICE)


def _windows(slices: DataFrame, least: int, places: bool) -> DataFrame:
    """The windows of the slices by their hashes: (wa, wb, doc, pos) of the own ones, or else (wa, wb, d0, d1) of all."""
    schema = "wa bigint, wb bigint, doc bigint, pos int" if places else "wa bigint, wb bigint, d0 bigint, d1 bigint"
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            points = [code_points(x.as_py()) for x in batch.column(6)]
            n = batch.column(2).to_numpy()
            size = n + least - 1
            start = np.cumsum(size) - size
            at = np.repeat(start, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            whole = np.concatenate(points)
            hashes = [pa.array(mix(stretch_hash(prefix_sums(whole, b), at, at + least, b)).view(np.int64)) for b in "ab"]
            repeat = lambda k: np.repeat(batch.column(k).to_numpy(), n)
            if places:
                rest = [pa.array(repeat(0)), pa.array((repeat(1) + at - np.repeat(start, n)).astype(np.int32))]
            else:
                rest = [pa.array(repeat(3)), pa.array(repeat(4))]
            yield pa.RecordBatch.from_arrays([*hashes, *rest], names=names)

    return (slices.filter("own") if places else slices).mapInArrow(run, schema)


def shared_windows(documents: DataFrame, least: int = LEAST, gram: int | None = None, doc_id: str = "doc_id", text: str = "text", counters: int | None = None, rows: int = ROWS) -> DataFrame:
    """(doc, first, n): runs of windows that stand in another document as well. Runs may touch, not overlap in their windows."""
    gram = min(GRAM, max(1, least // 2)) if gram is None else gram
    texts = _texts(documents, doc_id, text)
    counters = counters or counters_for(texts, least, gram)
    spark = texts.sparkSession
    where = f"{shared_folder(spark)}/sketch-{uuid.uuid4().hex}"
    sketch_answers(texts, least, gram, counters, rows).repartition("part").sortWithinPartitions("part", "chunk").write.partitionBy("part").parquet(where)
    found = stored(candidate_segments(texts, where, counters, least, gram, rows).distinct())
    removed(spark, where)
    key = ["low", "hash_a", "hash_b"]
    stretch = found.groupBy(*key).agg(F.min("doc").alias("d0"), F.max("doc").alias("d1"), F.min_by(F.struct("first", "n"), "doc").alias("at"))
    settled = found.join(stretch.filter("d0 < d1").select(*key), key, "left_semi").select("doc", "first", "n")
    mixed = stretch.groupBy("low").agg(F.min("d0").alias("lo"), F.max("d1").alias("hi"), F.max(F.col("d0") == F.col("d1")).alias("open")).filter("lo < hi and open").select("low")
    unsettled = stretch.join(mixed, "low")
    single = found.join(unsettled.filter("d0 = d1").select(*key), key, "left_semi").select("doc", "first", "n", F.col("doc").alias("d0"), F.col("doc").alias("d1"), F.lit(True).alias("own"))
    known = unsettled.filter("d0 < d1").select(F.col("d0").alias("doc"), "at.first", "at.n", "d0", "d1", F.lit(False).alias("own"))
    slices = stored(_slices(texts, single.unionByName(known), least))
    # merge: sizes are estimated from before the expansion into windows, so a broadcast here would have no proven bound
    twice = _windows(slices, least, False).groupBy("wa", "wb").agg(F.min("d0").alias("lo"), F.max("d1").alias("hi")).filter("lo < hi").select("wa", "wb")
    edges = _windows(slices, least, True).join(twice.hint("merge"), ["wa", "wb"], "left_semi").select("doc", F.col("pos").alias("first"), F.lit(1).alias("n"))
    return settled.unionByName(edges)


def shared_spans(documents: DataFrame, least: int = LEAST, **options) -> DataFrame:
    """doc_id, span_start, span_chars of every maximal run of characters that lie in a shared window."""
    runs = shared_windows(documents, least, **options).select("doc", F.col("first").cast("bigint").alias("start"), (F.col("first") + F.col("n") + (least - 1)).cast("bigint").alias("end"))
    order = Window.partitionBy("doc").orderBy("start", "end")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = runs.withColumn("fresh", F.when(before.isNull() | (F.col("start") > before), 1).otherwise(0))
    island = fresh.withColumn("island", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    spans = island.groupBy("doc", "island").agg(F.min("start").alias("span_start"), F.max("end").alias("end"))
    return spans.select(F.col("doc").alias("doc_id"), "span_start", (F.col("end") - F.col("span_start")).alias("span_chars"))


def shared_amounts(documents: DataFrame, least: int = LEAST, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """doc_id, n_chars, shared_chars, n_spans, shared_share of every document, those that share nothing included."""
    sizes = documents.filter(documents[f"`{doc_id}`"].isNotNull()).groupBy(documents[f"`{doc_id}`"].cast("bigint").alias("doc_id")).agg(F.max(F.length(documents[f"`{text}`"])).cast("bigint").alias("n_chars"))
    spans = shared_spans(documents, least, doc_id=doc_id, text=text, **options).groupBy("doc_id").agg(F.sum("span_chars").alias("shared_chars"), F.count("*").alias("n_spans"))
    both = sizes.join(spans, "doc_id", "left").na.fill(0, ["n_chars", "shared_chars", "n_spans"])
    return both.withColumn("shared_share", F.when(F.col("n_chars") > 0, F.col("shared_chars") / F.col("n_chars")).otherwise(0.0))
