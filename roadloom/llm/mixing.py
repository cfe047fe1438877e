"""Mixing sources to target weights.

Tokens are summed per source, a repetition rate per source follows from them, and each document is emitted floor(rate)
times plus once more with the probability of the fraction, by a hash of its id and a seed. Without a wanted total the
mixture is the largest at which every source that has documents meets its share within its cap on repeats; with one,
a source that would need more repeats than its cap is drawn at the cap and its shortfall goes to the others in
proportion, which the report shows.

Defined results: sources without a target, null sources and targets that are null or not positive are not drawn; a
target without documents is reported with nothing drawn, the other shares being scaled to sum 1; null and empty texts
have no tokens and are drawn with the rest of their source; repeated rows are documents of their own; equal ids get
equal draws; an empty frame draws nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadloom.functions.frames import few, small, spread, stored
from roadloom.llm.tokens import VOCABULARY, token_count

SEED = 42
MOST_SOURCES = 100_000


def sized(documents: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, source, n_tokens of every document, kept: the sums and the drawing both read it."""
    rows = spread(documents.select("doc_id", "source", "text"))
    return stored(rows.select("doc_id", "source", token_count(F.col("text"), vocabulary).alias("n_tokens")))


def rates(tokens: dict[str, int], targets: dict[str, tuple[float, int]], total: float | None = None) -> dict[str, float]:
    """Source -> how often each of its documents is to be used, on average."""
    live = {s: share for s, (share, cap) in targets.items() if tokens.get(s, 0) > 0 and share > 0 and cap > 0}
    whole = sum(live.values())
    if not whole:
        return {}
    if total is None:
        total = min(tokens[s] * targets[s][1] / (share / whole) for s, share in live.items())
    out: dict[str, float] = {}
    left, free = float(total), dict(live)
    while free:
        weight = sum(free.values())
        full = [s for s in free if left * free[s] / weight > tokens[s] * targets[s][1] * (1 + 1e-12)]
        if not full:
            out |= {s: min(left * share / weight / tokens[s], targets[s][1]) for s, share in free.items()}
            break
        for s in full:
            out[s] = float(targets[s][1])
            left -= tokens[s] * targets[s][1]
            del free[s]
    return out


def _plan(held: DataFrame, targets: DataFrame, total: float | None) -> DataFrame:
    """Per source: target, cap, documents, tokens and rate. One row per source is bounded by the table of targets."""
    wanted = targets.filter("source is not null and target_share > 0 and max_repeats > 0").groupBy("source").agg(F.sum("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    sums = held.join(small(wanted.select("source"), MOST_SOURCES), "source").groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
    rows = few(wanted.join(sums, "source", "left"), MOST_SOURCES)
    rate = rates({r.source: r.n_tokens or 0 for r in rows}, {r.source: (r.target_share, r.max_repeats) for r in rows}, total)
    plan = [(r.source, r.target_share, r.max_repeats, r.n_docs or 0, r.n_tokens or 0, rate.get(r.source, 0.0)) for r in rows]
    return held.sparkSession.createDataFrame(plan, "source string, target_share double, max_repeats int, source_docs bigint, source_tokens bigint, rate double")


def drawn(held: DataFrame, targets: DataFrame, total: float | None = None, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """(documents with their number of copies, plan per source)."""
    plan = _plan(held, targets, total)
    chance = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("doc_id")), 11) / F.lit(float(2**53))
    whole = F.floor("rate").cast("int")
    copies = whole + (chance < F.col("rate") - whole).cast("int")
    both = held.join(small(plan.select("source", "rate"), MOST_SOURCES), "source")
    return both.select("doc_id", "source", "n_tokens", copies.alias("copies")).filter("copies > 0"), plan


def mixture(held: DataFrame, targets: DataFrame, total: float | None = None, seed: int = SEED) -> DataFrame:
    """One row per use of a document: doc_id, source, copy_no from 1, n_tokens."""
    chosen, _ = drawn(held, targets, total, seed)
    return chosen.select("doc_id", "source", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy_no"), "n_tokens")


def shares(held: DataFrame, targets: DataFrame, total: float | None = None, seed: int = SEED) -> DataFrame:
    """Per target: what was wanted and what the drawing really reached."""
    chosen, plan = drawn(held, targets, total, seed)
    got = chosen.groupBy("source").agg(F.count("*").alias("docs_used"), F.sum("copies").alias("uses"), F.max("copies").alias("most_copies"), F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens"))
    both = plan.join(got, "source", "left").na.fill(0, ["docs_used", "uses", "most_copies", "tokens"])
    whole = both.agg(F.sum("tokens").alias("all_tokens"))
    return both.join(small(whole, 1)).withColumn("actual_share", F.when(F.col("all_tokens") > 0, F.col("tokens") / F.col("all_tokens")).otherwise(0.0)).drop("all_tokens")
