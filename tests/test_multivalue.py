import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from roadloom.operators.multivalue import DELIMITERS, Segmenter, explode_values, values_column

CASES = [
    (None, []), ("", []), ("   ", []), ("[]", []), ("['']", []), ('""', []), (";", []), ("[[]]", []),
    ("['primary', 'secondary']", ["primary", "secondary"]), ("{a,b}", ["a", "b"]), ("('a', 'x (old)')", ["a", "x (old)"]), ('["a","b"]', ["a", "b"]),
    ("a;b , c|d/e+f&g\nh\r\ni\tj、k；l", list("abcdefghijkl")), (" ;a; ;b,", ["a", "b"]), ("a;a", ["a", "a"]),
    ('"the ""new"" way";x', ['the "new" way', "x"]), ('x,"y (east; closed)"', ["x", "y (east; closed)"]), ("'a';'b'", ["a", "b"]), ("it's, b", ["it's", "b"]),
    ('"a, b', ['"a', "b"]), ('"a"b, c', ['"a"b', "c"]), ("old (a)", ["old (a)"]), ("(a) b (c)", ["(a) b (c)"]), ("\xa0a\xa0;b", ["a", "b"]), ('" a ", b', ["a", "b"]),
]


@pytest.mark.parametrize(("text", "values"), CASES)
def test_cases(text, values):
    assert Segmenter().split(text) == values


def test_dictionary_protects_delimiters():
    s = Segmenter(["Farm, forest or track", "primary", "a/b", "a"])
    assert s.split("primary, farm, Forest or Track; x") == ["primary", "farm, Forest or Track", "x"]
    assert s.split("a/b/a") == ["a/b", "a"]
    assert s.split("xa/b") == ["xa", "b"]  # only whole values count
    assert s.split('"farm", forest or track') == ["farm", "forest or track"]
    assert Segmenter(["a,b", "b,c,d"]).split("a,b,c,d") == ["a", "b,c,d"]  # fewest unknown pieces, then fewest pieces


plain = st.text(alphabet="abcxyz _-.é", min_size=1, max_size=8).map(str.strip).filter(bool)
quoted = st.text(alphabet='ab;,|" ', min_size=1, max_size=8).map(str.strip).filter(lambda v: v.strip('"') and not v.startswith('"') and not v.endswith('"'))


@given(st.lists(st.tuples(st.booleans(), plain, quoted), min_size=1, max_size=6), st.sampled_from(list(DELIMITERS)), st.sampled_from(["", "[]", "{}", "()"]))
def test_round_trip(items, delimiter, bracket):
    values = [q if use else p for use, p, q in items]
    text = delimiter.join('"' + q.replace('"', '""') + '"' if use else p for use, p, q in items)
    assert Segmenter().split(bracket[:1] + text + bracket[1:]) == values


def test_long_text():
    assert len(Segmenter(["a,b"]).split(",".join(["a", "b", "c"] * 30_000))) == 60_000


def test_frame(spark):
    df = spark.createDataFrame([(1, "a;b", "p"), (1, "a;b", "p"), (2, None, "q"), (3, "a", None), (4, "", "r")], "edge_id bigint, highway string, pos string")
    got = sorted(map(tuple, explode_values(df, "highway", least=2).collect()))
    assert got == sorted([(1, "a;b", "p", 1, "a"), (1, "a;b", "p", 2, "b")] * 2)
    assert explode_values(df, "highway").columns == ["edge_id", "highway", "pos_in", "pos", "value"]
    assert explode_values(df, "highway").count() == 5
    assert explode_values(df.limit(0), "highway", least=2).collect() == []
    assert [r.n for r in df.select(F.size(values_column(F.col("highway"))).alias("n")).collect()] == [2, 2, 0, 1, 0]


def test_frame_with_guarded_values(spark):
    df = spark.createDataFrame([(1, "bus, guided; bus"), (2, "Bus, Guided"), (3, "guided, bus")], "edge_id bigint, highway string")
    got = sorted(map(tuple, explode_values(df, "highway", ["bus, guided", "bus"], keep=["edge_id"], least=2).collect()))
    assert got == [(1, 1, "bus, guided"), (1, 2, "bus"), (3, 1, "guided"), (3, 2, "bus")]
