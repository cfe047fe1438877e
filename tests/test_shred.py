import xml.etree.ElementTree as ET

from hypothesis import given, settings
from hypothesis import strategies as st

from roadloom.operators import shred
from roadloom.operators.shred import RECORDS

SAMPLE = """<?xml version='1.0' encoding='UTF-8'?>
<osm><layer><way id="7"><nd ref="1"/><!-- <tag k="highway" v="no"/> --><tag v="a &amp; b" k="name"/><nd ref="2"/><tag k='highway' v='path'/></way></layer>
<node id="1" lat="1" lon="2"><tag k="highway:note" v="x"/></node>
<relation id="9"><member type="way" ref="7" role=""><nd lat="1.5" lon="2.50"/><nd lon="3" lat="4"/></member><member ref="8" type="node"/><tag k="highway" v="&#34;"/></relation></osm>"""


def children(payload, tagged="highway"):
    return set(shred._elements(shred.shred(payload, shred._road_leaves), tagged))


def brute(payload, tagged="highway"):
    try:
        root = ET.fromstring(payload)
    except ET.ParseError:
        return set()
    out = set()
    for e in root.iter():
        if e.tag not in RECORDS or tagged is not None and not any(t.get("k") == tagged for t in e.findall("tag")):
            continue
        for kind in ("nd", "tag", "member"):
            for i, c in enumerate(e.findall(kind), 1):
                key = {"nd": lambda: c.get("ref", ""), "tag": lambda: f"{c.get('k', '')}={c.get('v', '')}", "member": lambda: ":".join(c.get(a, "") for a in ("type", "ref", "role"))}[kind]()
                out.add((e.tag, e.get("id"), f"{kind}[{i}]", key))
                for j, x in enumerate(c.findall("nd") if kind == "member" else [], 1):
                    out.add((e.tag, e.get("id"), f"member[{i}]/nd[{j}]", f"{x.get('lat', '')},{x.get('lon', '')}"))
    return out


def test_sample():
    got = children(SAMPLE)
    assert got == brute(SAMPLE)
    assert ("way", "7", "nd[2]", "2") in got and ("way", "7", "tag[1]", "name=a & b") in got
    assert ("relation", "9", "member[1]/nd[2]", "4,3") in got and ("relation", "9", "member[2]", "node:8:") in got
    assert not any(kind == "node" for kind, *_ in got)


def test_broken_payloads_give_nothing():
    for bad in (None, "", "   ", "text", SAMPLE[:-20], "<osm><way id='1'></osm>", "<a/><b/>", "<a x='1' x='2'/>", "<a>&nope;</a>", "\ud800<a/>"):
        assert shred.shred(bad) == {}


def test_levels_of_the_classic_record():
    columns = shred.shred("<d><n><c x='1'/><c x='2'/></n><n/><n><c/></n></d>")
    assert columns["d/n/c/@x"] == ([0, 3, 2, 2], [4, 4, 2, 3], ["1", "2", None, None])
    table = shred.rebuild(columns, "d/n", "c")
    assert table["parent"].tolist() == [0, 0, 2] and table["pos1"].tolist() == [1, 2, 1] and table["x"].tolist() == ["1", "2", None]


def test_deep_nesting_does_not_recurse():
    deep = "<a>" * 3000 + "<way id='1'><tag k='highway' v='x'/></way>" + "</a>" * 3000
    assert children(deep) == {("way", "1", "tag[1]", "highway=x")}


names = st.sampled_from(["way", "node", "relation", "nd", "tag", "member", "x"])
trees = st.recursive(st.tuples(names, st.dictionaries(st.sampled_from(["id", "ref", "k", "v", "type", "role", "lat", "lon"]), st.sampled_from(["1", "highway", "", "a<b", '"q"']), max_size=3), st.just([])), lambda kids: st.tuples(names, st.dictionaries(st.sampled_from(["id", "k"]), st.sampled_from(["2", "highway"]), max_size=2), st.lists(kids, max_size=4)), max_leaves=25)


def build(tree):
    e = ET.Element(tree[0], tree[1])
    for kid in tree[2]:
        e.append(build(kid))
    return e


@settings(max_examples=150, deadline=None)
@given(trees)
def test_against_brute_force(tree):
    payload = ET.tostring(build(tree), encoding="unicode")
    assert children(payload) == brute(payload)
    assert children(payload, None) == brute(payload, None)


@settings(max_examples=100, deadline=None)
@given(trees)
def test_every_attribute_is_in_one_column(tree):
    root = build(tree)
    columns = shred.shred(ET.tostring(root, encoding="unicode"))
    assert sum(v is not None for _, _, vals in columns.values() for v in vals) == sum(len(e.attrib) for e in root.iter())
    assert all(len(r) == len(d) == len(v) for r, d, v in columns.values())


def test_frame(spark):
    df = spark.createDataFrame([(1, SAMPLE, "x"), (1, SAMPLE, "y"), (2, None, "z"), (3, "<osm", "z")], "extract_id bigint, payload string, columns string")
    got = [tuple(r) for r in shred.element_children(df).collect()]
    assert {g[1:] for g in got} == {(k, int(i), p, c) for k, i, p, c in brute(SAMPLE)} and len(got) == 2 * len(set(got))
    assert shred.element_children(df.limit(0)).collect() == []
    wide = shred.shredded(df, "payload")
    assert wide.columns == ["extract_id", "columns_in", "columns"]
    kinds = shred.elements(df.limit(1)).collect()
    assert {(r.kind, r.id) for r in kinds} == {("way", 7), ("node", 1), ("relation", 9)}
    assert next(r for r in kinds if r.kind == "node").attributes == {"id": "1", "lat": "1", "lon": "2"}
