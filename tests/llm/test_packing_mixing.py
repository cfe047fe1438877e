import os

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from roadloom.llm import mixing, packing, tokens

needs_vocabulary = pytest.mark.skipif(not os.path.exists(tokens.VOCABULARY), reason="no vocabulary file here")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 100), st.floats(0, 1)), max_size=150), st.integers(1, 8), st.floats(0.2, 1))
def test_every_limit_holds(items, most_segments, share):
    t = np.asarray([a for a, _ in items], dtype=np.int64)
    p = np.asarray([int(a * b) for a, b in items], dtype=np.int64)
    most_loss = max(1, int(share * 100))
    bins = packing.pack(t, p, 100, most_loss, most_segments)
    assert sorted(k for b in bins for k in b) == list(range(len(items)))
    for b in bins:
        assert t[b].sum() <= 100 and len(b) <= most_segments and (p[b].sum() <= most_loss or len(b) == 1)


def test_packing_wastes_little():
    rnd = np.random.default_rng(1)
    t = rnd.integers(1, 1000, 4000)
    bins = packing.pack(t, t // 2, 1024, 900, 64)
    assert t.sum() / (len(bins) * 1024) > 0.99


@given(st.lists(st.tuples(st.integers(0, 500), st.floats(0, 1)), max_size=30), st.integers(1, 120), st.floats(0.2, 1))
def test_pieces_cover_documents_and_keep_both_limits(items, capacity, share):
    t = np.asarray([a for a, _ in items], dtype=np.int64)
    p = np.asarray([int(a * b) for a, b in items], dtype=np.int64)
    most_loss = max(1, int(share * capacity))
    doc, piece, start, size, loss = packing.pieces(t, p, capacity, most_loss)
    assert (size > 0).all() and (size <= capacity).all()
    for k in range(len(t)):
        own = doc == k
        assert size[own].sum() == t[k] and loss[own].sum() == p[k]
        assert start[own].tolist() == (np.cumsum(size[own]) - size[own]).tolist() and piece[own].tolist() == list(range(own.sum()))
        if t[k] > capacity:
            assert (loss[own] <= most_loss).all()
        else:
            assert own.sum() == (t[k] > 0)


DOCS = "doc_id bigint, text string, source string, spec_id int"


@needs_vocabulary
def test_containers(spark):
    text = "commit\n    message here\ndiff --git a/x b/x\n+" + "added line of code\n+" * 20
    rows = [(k, text[: 20 + 7 * k], "s", 1) for k in range(60)] + [(100, text * 30, "s", 1), (101, None, "s", 1), (102, "", "s", 1), (None, "lost id", "s", 1), (5, text[:55], "s", 1)]
    df = spark.createDataFrame(rows, DOCS)
    got = packing.containers(df, [(1, 64), (2, 256)], block=32).collect()
    size = {k: int(n) for k, n in zip((r[0] for r in rows), tokens.counts([r[1] for r in rows]))}
    for spec, capacity in ((1, 64), (2, 256)):
        own = [r for r in got if r.spec_id == spec]
        held: dict = {}
        for r in own:
            held.setdefault(r.container_id, []).append(r)
        assert all(sum(r.n_tokens for r in b) <= capacity and sorted(r.position for r in b) == list(range(len(b))) for b in held.values())
        for k in range(60):
            mine = [r for r in own if r.doc_id == k]
            copies = 2 if k == 5 else 1
            assert sum(r.n_tokens for r in mine) == copies * size[k] and (size[k] > capacity or len(mine) == copies)
        assert sum(r.n_tokens for r in own if r.doc_id == 100) == size[100]
        assert not [r for r in own if r.doc_id in (101, 102)] and [r for r in own if r.doc_id is None]
        assert all(sum(r.n_loss for r in b) <= int(0.9 * capacity) or len(b) == 1 and b[0].piece == 0 and size[b[0].doc_id] <= capacity for b in held.values())
    sizes = spark.createDataFrame([(1, 64), (2, 256)], "spec_id int, capacity_tokens int")
    for r in packing.report(spark.createDataFrame(got), sizes).collect():
        assert r.over_tokens == r.over_segments == r.over_loss == 0 and r.containers >= r.fewest and 0 < r.filled <= 1
    again = packing.containers(df.repartition(7), [(1, 64), (2, 256)], block=32).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    assert packing.containers(df.limit(0), [(1, 64)]).collect() == [] and packing.containers(df, []).collect() == []


@needs_vocabulary
def test_tokenizers_agree_on_round_trips():
    for name in ("byte_bpe_50k.tiktoken", "byte_bpe_50k.json", "piece_bpe_32k.model"):
        path = os.path.join(os.path.dirname(tokens.VOCABULARY), name)
        assert tokens.counts(["some text <|endoftext|>", None, ""], path).tolist()[1:] == [0, 0]
    base = os.path.dirname(tokens.VOCABULARY)
    texts = ["def f(x):\n    return x\n\n\n", "naïve 東京 \t\n x", "<|endoftext|>", "it's 12345"]
    assert tokens.counts(texts, f"{base}/byte_bpe_50k.tiktoken").tolist() == tokens.counts(texts, f"{base}/byte_bpe_50k.json").tolist()


def test_rates():
    have = {"a": 1000, "b": 100, "c": 0}
    want = {"a": (0.5, 1), "b": (0.4, 3), "c": (0.1, 2)}
    r = mixing.rates(have, want)  # b allows 300 tokens as 4/9 of the whole: 675 in all, 375 of them from a
    assert r == pytest.approx({"a": 0.375, "b": 3.0})
    assert mixing.rates(have, want, 90) == pytest.approx({"a": 0.05, "b": 0.4})
    assert mixing.rates(have, want, 10_000) == {"a": 1.0, "b": 3.0}  # all there is
    assert mixing.rates(have, want, 900) == pytest.approx({"a": 0.6, "b": 3.0})  # b's shortfall goes to a
    assert mixing.rates({}, want) == {}


HELD = "doc_id bigint, source string, n_tokens bigint"


def test_mixture(spark):
    held = spark.createDataFrame([(k, "a", 10) for k in range(4000)] + [(10_000 + k, "b", 5) for k in range(300)] + [(20_000, None, 7), (20_001, "z", 7)], HELD)
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.4, 3), ("c", 0.1, 2), (None, 0.3, 1), ("d", None, 1)], "source string, target_share double, max_repeats int")
    got = {r.source: r for r in mixing.shares(held, targets).collect()}
    assert set(got) == {"a", "b", "c"} and got["c"].tokens == 0 and got["c"].actual_share == 0
    assert got["b"].uses == 900 and got["b"].most_copies == 3 and abs(got["a"].actual_share - 5 / 9) < 0.02
    rows = [tuple(r) for r in mixing.mixture(held, targets).collect()]
    assert len(rows) == len(set(rows)) == got["a"].uses + 900 and {s for _, s, _, _ in rows} == {"a", "b"}
    assert rows and sorted(rows) == sorted(tuple(r) for r in mixing.mixture(held, targets).collect())
    assert sorted(rows) != sorted(tuple(r) for r in mixing.mixture(held, targets, seed=7).collect())
    half = {r.source: r for r in mixing.shares(held, targets, total=1000).collect()}
    assert abs(half["a"].tokens + half["b"].tokens - 1000) < 250
    assert mixing.mixture(held.limit(0), targets).collect() == [] and mixing.mixture(held, targets.limit(0)).collect() == []


@needs_vocabulary
def test_sized(spark):
    df = spark.createDataFrame([(1, "two words", "a", 0), (2, None, "a", 0), (3, "", None, 0)], DOCS)
    assert sorted(tuple(r) for r in mixing.sized(df).collect()) == [(1, "a", 2), (2, "a", 0), (3, None, 0)]
