"""Filling fixed-capacity containers with documents: vector bin packing by the dot-product heuristic.

A document asks for tokens, one segment and its loss-bearing tokens (those of the diff, which a model is trained to
produce; head and message are the prompt). A container holds up to its capacity of tokens, segments_per * capacity
segments and loss_share * capacity loss-bearing tokens. Each container is opened with the largest item left and then
takes, again and again, the fitting item whose demand has the largest dot product with what is left of it.

Documents larger than the capacity are split into pieces, each as long as both limits allow; all others stay whole. The
three limits hold in every container but for one kind: a document that fits the capacity, hence may not be split, and yet
bears more loss than the limit. It has a container to itself, and report() counts these.

Only (id, tokens, loss) of each document move: they are spread over blocks of about `block` documents by a hash, so the
containers are the same on any cluster. A container never mixes two blocks (the price is less than one part-filled
container per block and capacity); a block that grows beyond `block` documents (equal ids) is cut, and streamed, not gathered.

Defined results: null and empty texts have no tokens and are in no container; repeated rows are documents of their own;
a null document id is carried as null; an empty frame gives no containers; texts of any length are used whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadloom.functions.frames import small, spread, stored
from roadloom.llm.tokens import VOCABULARY, counts

PLACED = "spec_id int, container_id bigint, position int, doc_id bigint, piece int, token_start bigint, n_tokens bigint, n_loss bigint"
_DIFF = "\ndiff --git "
_SALT = "containers"


def pack(tokens: np.ndarray, loss: np.ndarray, capacity: int, most_loss: int, most_segments: int) -> list[list[int]]:
    """Items by container. Items must not exceed the capacity; one over the loss limit is placed alone."""
    order = np.argsort(tokens, kind="stable")
    t, p = tokens[order].astype(np.int64), loss[order].astype(np.int64)
    # an item's demand in parts of the container, the segment included
    dt, dp, ds = t / capacity, p / max(1, most_loss), 1.0 / most_segments
    alive = np.ones(len(t), dtype=bool)
    left, out = len(t), []
    top = len(t) - 1
    while left:
        while not alive[top]:
            top -= 1
        alive[top] = False
        left -= 1
        own = [int(order[top])]
        rt, rp, rs = capacity - t[top], most_loss - p[top], most_segments - 1
        while left and rt > 0 and rp >= 0 and rs > 0:
            k = int(np.searchsorted(t, rt, side="right"))
            if k == 0:
                break
            score = dt[:k] * (rt / capacity) + dp[:k] * (rp / max(1, most_loss)) + ds * (rs / most_segments)
            score[~alive[:k] | (p[:k] > rp)] = -1.0
            best = int(np.argmax(score))
            if score[best] < 0:
                break
            alive[best] = False
            left -= 1
            own.append(int(order[best]))
            rt, rp, rs = rt - t[best], rp - p[best], rs - 1
            if left > 64 and left < len(t) // 2:  # forget what is placed
                order, t, p, dt, dp = order[alive], t[alive], p[alive], dt[alive], dp[alive]
                alive = np.ones(len(t), dtype=bool)
                top = len(t) - 1
        out.append(own)
    return out


def pieces(tokens: np.ndarray, loss: np.ndarray, capacity: int, most_loss: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, piece from 0, first token, tokens, loss-bearing tokens): documents beyond the capacity in pieces.

    The loss-bearing tokens are the last ones of a document, so its first piece to reach them may hold the prompt before
    them too; a piece ends where the capacity or the loss limit is used up.
    """
    prompt = tokens - loss
    whole = tokens <= capacity
    # pieces of prompt only, then one that goes on into the loss, then pieces of loss only
    before = np.where(whole, 0, prompt // capacity)
    left = prompt - before * capacity
    mixed = np.where(whole, tokens, np.minimum(tokens - before * capacity, np.minimum(capacity, left + most_loss)))
    rest = tokens - before * capacity - mixed
    after = -(-rest // min(capacity, most_loss))
    n = np.where(tokens > 0, before + (mixed > 0) + after, 0)
    doc = np.repeat(np.arange(len(tokens)), n)
    piece = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
    b, m, step = before[doc], mixed[doc], min(capacity, most_loss)
    late = piece - b - (m > 0)
    start = np.where(piece <= b, piece * capacity, b * capacity + m + late * step)
    size = np.where(piece < b, capacity, np.where((piece == b) & (m > 0), m, np.minimum(step, tokens[doc] - start)))
    return doc, piece, start, size, np.clip(start + size - np.maximum(start, prompt[doc]), 0, size)


SIZED = "doc_id bigint, n_tokens bigint, n_loss bigint"


def sized(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, tokens and loss-bearing tokens of every document that has tokens. Texts are encoded where they are read."""
    rows = spread(documents.select(documents[f"`{doc_id}`"].cast("bigint").alias("doc_id"), documents[f"`{text}`"].cast("string").alias("text")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            size = counts(texts, vocabulary)
            head = counts([t[: t.find(_DIFF) + 1] if t and _DIFF in t else t for t in texts], vocabulary)
            held = np.flatnonzero(size > 0)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(held)), pa.array(size[held]), pa.array(np.maximum(0, size - head)[held])], names=["doc_id", "n_tokens", "n_loss"])

    return rows.mapInArrow(run, SIZED)


def limits(capacity: int, loss_share: float, segments_per: float) -> tuple[int, int]:
    """(loss-bearing tokens, segments) that a container of the capacity may hold."""
    return max(1, int(loss_share * capacity)), max(1, int(segments_per * capacity))


LOSS_SHARE, SEGMENTS_PER = 0.9, 1 / 32


def containers(
    documents: DataFrame,
    capacities: list[tuple[int, int]],
    doc_id: str = "doc_id",
    text: str = "text",
    vocabulary: str = VOCABULARY,
    loss_share: float = LOSS_SHARE,
    segments_per: float = SEGMENTS_PER,
    block: int = 4096,
) -> DataFrame:
    """Every (piece of a) document with the container and position it has under each (spec_id, capacity in tokens)."""
    specs = [(int(s), int(c)) for s, c in capacities if s is not None and c is not None and c > 0]
    held = stored(sized(documents, doc_id, text, vocabulary))
    blocks = max(1, -(-held.count() // block))
    rows = held.select(F.pmod(F.xxhash64(F.lit(_SALT), "doc_id"), F.lit(blocks)).alias("block"), "doc_id", "n_tokens", "n_loss")
    tasks = min(blocks, max(2 * held.sparkSession.sparkContext.defaultParallelism, int(held.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    rows = rows.repartition(tasks, "block").sortWithinPartitions("block", "doc_id", "n_tokens", "n_loss")

    def place(ids: np.ndarray | list, tokens: np.ndarray, loss: np.ndarray, base: list[int]) -> Iterator[pa.RecordBatch]:
        for at, (spec, capacity) in enumerate(specs):
            most_loss, most_segments = limits(capacity, loss_share, segments_per)
            doc, piece, start, size, bears = pieces(tokens, loss, capacity, most_loss)
            groups = pack(size, bears, capacity, most_loss, most_segments)
            item = np.asarray([k for g in groups for k in g], dtype=np.int64)
            lengths = np.asarray([len(g) for g in groups], dtype=np.int64)
            number = base[at] + np.repeat(np.arange(len(groups)), lengths)
            position = np.arange(len(item)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            base[at] += len(groups)
            arrays = [pa.array(np.full(len(item), spec, dtype=np.int32)), pa.array(number), pa.array(position.astype(np.int32)), pa.array([ids[d] for d in doc[item].tolist()], pa.int64()), pa.array(piece[item].astype(np.int32)), pa.array(start[item]), pa.array(size[item]), pa.array(bears[item])]
            yield pa.RecordBatch.from_arrays(arrays, names=[f.split()[0] for f in PLACED.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, base = None, [0] * len(specs)
        waiting: list[pa.RecordBatch] = []
        count = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal count
            if count:
                t = pa.Table.from_batches(waiting)
                yield from place(t.column(1).to_pylist(), t.column(2).to_numpy(), t.column(3).to_numpy(), base)
            waiting.clear()
            count = 0

        for batch in batches:
            key = batch.column(0).to_numpy()
            cuts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]).tolist() if len(key) else []
            for a, b in zip(cuts, cuts[1:] + [len(key)]):
                if key[a] != own:
                    yield from flush()
                    own, base = int(key[a]), [int(key[a]) << 32] * len(specs)  # a container's number holds its block
                while a < b:
                    take = min(b - a, block - count)
                    waiting.append(batch.slice(a, take))
                    a, count = a + take, count + take
                    if count == block:
                        yield from flush()
        yield from flush()

    return rows.mapInArrow(run, PLACED)


def report(placed: DataFrame, sizes: DataFrame, loss_share: float = LOSS_SHARE, segments_per: float = SEGMENTS_PER) -> DataFrame:
    """Per container size (sizes: spec_id, capacity_tokens): containers used and the fewest possible by each limit, the share of
    tokens filled, and the containers beyond each limit; unsplittable are those beyond the loss limit with one whole document."""
    each = placed.groupBy("spec_id", "container_id").agg(F.sum("n_tokens").alias("t"), F.sum("n_loss").alias("l"), F.count("*").alias("s"), F.count_if(F.col("piece") > 0).alias("c"))
    c = F.col("capacity_tokens")
    most_loss, most_segments = F.greatest(F.lit(1), F.floor(F.lit(loss_share) * c)), F.greatest(F.lit(1), F.floor(F.lit(segments_per) * c))
    over_loss = F.col("l") > most_loss
    both = each.join(small(sizes.select("spec_id", "capacity_tokens"), 1_000), "spec_id")
    out = both.groupBy("spec_id", "capacity_tokens").agg(
        F.count("*").alias("containers"),
        F.sum("t").alias("tokens"),
        F.sum("l").alias("loss_tokens"),
        F.sum("c").alias("cuts"),
        F.count_if(F.col("t") > c).alias("over_tokens"),
        F.count_if(F.col("s") > most_segments).alias("over_segments"),
        F.count_if(over_loss & (F.col("s") > 1)).alias("over_loss"),
        F.count_if(over_loss & (F.col("s") == 1)).alias("unsplittable"),
    )
    fewest = F.greatest(F.ceil(F.col("tokens") / c), F.ceil(F.col("loss_tokens") / most_loss))
    return out.withColumn("fewest", fewest).withColumn("filled", F.col("tokens") / F.col("containers") / c)
