import pytest
from hypothesis import given
from hypothesis import strategies as st

from roadloom.llm import repair

ENTRIES = [("motorway", "Access-controlled motorway"), ("trunk", "Trunk route"), ("primary", "Primary arterial"), ("residential", "Residential street"), ("living_street", "Shared living street"), ("motorway_link", "Motorway ramp"), ("primary_link", "Primary ramp"), ("track", "Farm or forest track"), ("path", "Multi-use path"), ("steps", "Flight of steps"), ("cycleway", "Bicycle cycleway"), ("construction", "Under construction")]

CASES = {
    "motorway": ["Motorway", " motorwya", "m0t0rway", "rnotorway", "mоtоrway", "Access controlled motorway", "motorway (old)", "type motorway", "highway=motorway", "hw:Motorway", "motorw."],
    "motorway_link": ["motorway link", "MotorwayLink", "ramp motorway", "motrway_lnk", "Motorway-link rd"],
    "primary": ["primáry", "Prímary arteríal", "primary artrial", "PRMARY"],
    "primary_link": ["primary ramp", "primay_link", "primaryramp"],
    "residential": ["residential st", "street residential", "r3sidentia1", "residentailstreet", "residenti"],
    "living_street": ["living street", "livings treet", "shared living stret"],
    "track": ["farm or forest track", "old track", "tarck"],
    "trunk": ["trnuk", "trunkroute", "trunk rd."],
    "path": ["pth", "multi-use pah"],
    "cycleway": ["bicyclec ycleway"],
    "construction": ["under constuction", "constructi"],
    repair.UNMATCHED: ["tank farm", "building", "kiln", "???", "x17", "dam wall", "unknown", "lank", "street"],
}


def test_cases(spark):
    texts = {t: e for e, own in CASES.items() for t in own}
    df = spark.createDataFrame([(t,) for t in [*texts, *texts, None, "", "  "]], "v string")
    got = {r.text: r.entry for r in repair.map_values(df, "v", repair.Reference(ENTRIES)).collect()}
    assert got == texts


def test_empty_sides(spark):
    df = spark.createDataFrame([("motorway",)], "v string")
    assert [tuple(r) for r in repair.map_values(df, "v", repair.Reference([])).collect()] == [("motorway", repair.UNMATCHED, 0.0)]
    assert repair.map_values(df.limit(0), "v", repair.Reference(ENTRIES)).collect() == []
    long = spark.createDataFrame([("x" * 5000,), ("motorway " * 2000,)], "v string")
    assert len(repair.map_values(long, "v", repair.Reference(ENTRIES)).collect()) == 2


def test_ties_take_the_smaller_name():
    r = repair.Reference([("b", "same words"), ("a", "same words")])
    assert repair.rank(["same", "words"], {"same": [("same", 1.0)], "words": [("words", 1.0)], "samewords": [("samewords", 1.0)]}, r, 0.5)[0] == "a"


def brute_osa(a, b):
    d = {(i, 0): i for i in range(len(a) + 1)} | {(0, j): j for j in range(len(b) + 1)}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


words = st.text(alphabet="abc", max_size=7)


@given(words, words, st.integers(0, 3))
def test_distance(a, b, most):
    assert repair.osa(a, b, most) == min(brute_osa(a, b), most + 1)


@given(words, words, st.integers(0, 2))
def test_deletion_neighbourhoods_lose_no_pair(a, b, most):
    if brute_osa(a, b) <= most:
        assert repair.deletions(a, most) & repair.deletions(b, most)


@pytest.mark.parametrize(("text", "folded"), [("PRIMÁRY", "primary"), ("ѕtерѕ", "steps"), ("Straße", "strasse"), ("ＴＲＡＣＫ", "track"), ("", "")])
def test_folding(text, folded):
    assert repair.fold(text) == folded
