import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from roadloom.llm import spans

SMALL = {"counters": 2**17, "rows": 2}


def brute(rows, least):
    held: dict[str, set] = {}
    for d, t in rows:
        if d is not None and t is not None:
            for k in range(len(t) - least + 1):
                held.setdefault(t[k : k + least], set()).add(d)
    out = set()
    marks: dict = {}
    for d, t in rows:
        if d is not None and t is not None:
            m = marks.setdefault(d, set())
            for k in range(len(t) - least + 1):
                if len(held[t[k : k + least]]) > 1:
                    m.update(range(k, k + least))
    for d, m in marks.items():
        for k in sorted(m):
            if k - 1 not in m:
                end = k
                while end in m:
                    end += 1
                out.add((d, k, end - k))
    return out


def found(spark, rows, least=20):
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    return {tuple(r) for r in spans.shared_spans(df, least, **SMALL).collect()}


def passages(seed, alphabet, documents):
    rnd = random.Random(seed)
    word = lambda n: "".join(rnd.choice(alphabet) for _ in range(n))
    pool = [word(rnd.choice([15, 19, 20, 21, 40, 90])) for _ in range(6)]
    rows = []
    for d in range(documents):
        rows.append((d, "".join(rnd.choice(pool) if rnd.random() < 0.5 else word(rnd.randint(0, 30)) for _ in range(rnd.randint(0, 7)))))
    return rows


def test_against_brute_force(spark):
    for seed, alphabet in ((1, "abcdefghij"), (2, "ab"), (3, "aé東😀"), (4, "a")):
        rows = passages(seed, alphabet, 40)
        assert found(spark, rows) == brute(rows, 20), seed


def test_defined_cases(spark):
    t = "".join(random.Random(9).choice("abcdefgh") for _ in range(100))
    rows = [(1, t), (2, "x" + t[:60]), (3, t[30:50]), (4, t[30:49]), (5, None), (6, ""), (None, t), (7, "q" * 200), (8, "zz" + t), (8, "zz" + t)]
    got = found(spark, rows)
    assert got == brute(rows, 20)
    assert (1, 0, 100) in got and (2, 1, 60) in got and (3, 0, 20) in got and not {d for d, _, _ in got} & {4, 5, 6, 7}
    assert found(spark, [(1, t + "!" + t)]) == set()  # only within one document
    assert found(spark, [(k, t) for k in range(50)]) == {(k, 0, 100) for k in range(50)}
    assert found(spark, []) == set() and found(spark, [(1, "short"), (2, "short")]) == set()


def test_a_saturated_sketch_loses_nothing(spark):
    rows = passages(5, "abcdefghij", 40)
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert {tuple(r) for r in spans.shared_spans(df, 20, counters=64, rows=1).collect()} == brute(rows, 20)


def test_amounts(spark):
    t = "".join(random.Random(8).choice("abcdefgh") for _ in range(50))
    df = spark.createDataFrame([(1, t), (2, t + "x" * 50), (3, None), (4, "alone")], "doc_id bigint, text string")
    got = {r.doc_id: (r.n_chars, r.shared_chars, r.n_spans, r.shared_share) for r in spans.shared_amounts(df, 20, **SMALL).collect()}
    assert got == {1: (50, 50, 1, 1.0), 2: (100, 50, 1, 0.5), 3: (0, 0, 0, 0.0), 4: (5, 0, 0, 0.0)}


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 5), min_size=1, max_size=80), st.integers(1, 20))
def test_window_minima(values, width):
    v = np.asarray(values, dtype=np.uint64)
    assert spans.window_minima(v, width).tolist() == [min(values[k : k + width]) for k in range(len(values) - width + 1)]


@settings(max_examples=50, deadline=None)
@given(st.text(alphabet="ab😀é", min_size=30, max_size=120), st.integers(1, 25))
def test_equal_stretches_have_equal_hashes(text, size):
    p = spans.code_points(text)
    at = np.arange(len(p) - size + 1)
    for base in "ab":
        h = spans.stretch_hash(spans.prefix_sums(p, base), at, at + size, base)
        same: dict = {}
        for k in at.tolist():
            same.setdefault(text[k : k + size], set()).add(int(h[k]))
        assert all(len(s) == 1 for s in same.values()) and len({min(s) for s in same.values()}) == len(same)


def test_sketch_never_underestimates():
    rnd = np.random.default_rng(3)
    keys = rnd.integers(0, 2**63, 3000).astype(np.uint64)
    s = spans.Sketch(2**12, 2)
    for part in (keys, keys[:1000], keys[500:600]):
        s.add(part)
    bits = np.zeros((2, 2**16), dtype=bool)
    for c, _, more in s.chunks():
        bits[c, np.frombuffer(more, dtype="<u2")] = True
    for r in range(2):
        assert bits[r, spans.Sketch.places(keys[:1000], r, 2**12)].all()


def test_the_sketch_grows_with_the_texts_and_stays_selective(spark, tmp_path):
    rnd = random.Random(11)
    word = lambda n: "".join(rnd.choice("abcdefghijklmnop") for _ in range(n))
    common = word(300)
    rows = [(k, word(1500) + (common if k % 50 == 0 else "")) for k in range(400)]
    texts = spans._texts(spark.createDataFrame(rows, "doc_id bigint, text string"), "doc_id", "text").repartition(3)
    counters = spans.counters_for(texts, 40, 20)
    assert counters >= 8 * sum(len(spans.segments(spans.code_points(t), 40, 20)[0]) for _, t in rows)
    assert spans.counters_for(texts.union(texts).union(texts), 40, 20) > counters

    def passed(frame, size):
        where = str(tmp_path / f"s{size}-{frame.rdd.getNumPartitions()}")
        spans.sketch_answers(texts, 40, 20, size, 2).write.partitionBy("part").mode("overwrite").parquet(where)
        return {(r.doc, r["first"], r.n) for r in spans.candidate_segments(frame, where, size, 40, 20).collect()}

    every = {(k, int(a), int(b)) for k, t in rows for a, b in zip(*spans.segments(spans.code_points(t), 40, 20)[:2])}
    few = passed(texts, counters)
    assert len(few) < 0.06 * len(every) and few < every
    assert len(passed(texts, 2**8)) > 0.9 * len(every)  # of a size that doesn't grow nothing would be left of the filter
    assert few <= passed(texts.repartition(5), counters) <= every  # other partitions than the sketch's: more pass, none is lost
