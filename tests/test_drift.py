import random

import pytest

from roadloom.operators import drift


def csv_text(*rows):
    return "\n".join(rows) + "\n"


BASE = csv_text("city,number_of_nodes,node_density,remarks", "A,100,1.5,ok", "B,200,2.5,low sample", "C,300,3.5,ok")


@pytest.mark.parametrize(
    ("cells", "kind"),
    [(["True", "false", ""], "boolean"), (["1", "-2", "+3", "NA"], "integer"), (["1", "2.5"], "decimal"), (["1e5", ".5", "5."], "decimal"), (["1,5"], "text"), (["", "nan", "NULL"], None), (["1", "x"], "text"), (["true", "1"], "text"), ([], None)],
)
def test_types(cells, kind):
    assert drift.type_of(cells) == kind


def test_reading():
    names, rows = drift.read_csv('﻿"city" ; "a ""q"""\r\nX;"1;2"\r\n\r\n;\r\nY\r\n')
    assert names == ["city", 'a "q"'] and rows == [["X", "1;2"], ["Y", ""]]
    assert drift.read_csv(None) == drift.read_csv("") == drift.read_csv(" \n") == ([], [])
    assert drift.read_csv("a|b\n1|2\n")[0] == ["a", "b"] and drift.read_csv("a,a,b\n1,2,3\n") == (["a", "b"], [["1", "3"]])
    assert drift.read_csv("only\n1\n") == (["only"], [["1"]])


def test_canonical_numbers():
    assert drift.canonical(["12.5%", "3 pcs", "NA", "True", "x"]) == [12.5, 3.0, None, 1.0, None]
    assert drift.canonical(["1,030", "2,500"]) == [1030.0, 2500.0] and drift.canonical(["1,5", "2,25"]) == [1.5, 2.25]


def changes(spark, previous, current):
    files = spark.createDataFrame([(1, "d", 1, previous), (1, "d", 2, current)], "series_id bigint, dataset string, run_no int, content string")
    return [(r.change_kind, r.old_name, r.new_name) for r in drift.schema_changes(files).collect()]


def test_no_change(spark):
    assert changes(spark, BASE, BASE) == []
    shuffled = csv_text("remarks;node_density;city; number_of_nodes", "ok;1.51;A;101", "low;2.49;B;199")
    assert changes(spark, BASE, shuffled) == []


def test_changes(spark):
    later = csv_text('"CITY","n_nodes","node_density","comment_text","extra"', '"a","101","1.51%","ok","7"', '"b","199","2.49%","ok","8"', '"c","301","3.52%","low sample","9"')
    assert set(changes(spark, BASE, later)) == {("renamed", "city", "CITY"), ("renamed", "number_of_nodes", "n_nodes"), ("renamed", "remarks", "comment_text"), ("added", "", "extra"), ("type_changed", "node_density", "node_density")}


def test_removed_and_added_are_not_a_rename(spark):
    later = csv_text("city,number_of_nodes,remarks,execution_time", "A,100,ok,77.5", "B,200,ok,12.25", "C,300,ok,99.5")
    assert set(changes(spark, BASE, later)) == {("removed", "node_density", ""), ("added", "", "execution_time")}


def test_pivoted_layout_has_no_renames(spark):
    later = csv_text("metric,minimum_reference_value,maximum_reference_value", "number_of_nodes,100,300", "node_density,1.5,3.5")
    assert {k for k, _, _ in changes(spark, BASE, later)} == {"added", "removed"}


def test_blank_columns_have_no_type_change(spark):
    assert changes(spark, BASE, BASE.replace("1.5", "NA").replace("2.5", "").replace("3.5", "nan")) == []


def test_empty_sides(spark):
    assert {k for k, _, _ in changes(spark, None, BASE)} == {"added"} and {k for k, _, _ in changes(spark, BASE, "")} == {"removed"}


FILES = "series_id bigint, dataset string, run_no int, content string, tag string"


def test_frames(spark):
    second = BASE.replace("node_density", "nodes_per_km2").replace("1.5", "1.51")
    rows = [(1, "d", 1, BASE, "x"), (1, "d", 2, second, "x"), (1, "d", 2, second, "again"), (1, "d", 4, BASE, "gap"), (None, "d", 1, BASE, ""), (2, "d", 1, None, ""), (1, "e", 2, "a\n1\n", "")]
    files = spark.createDataFrame(rows, FILES)
    got = [tuple(r) for r in drift.schema_changes(files).collect()]
    assert got == [(1, "d", 2, "renamed", "node_density", "nodes_per_km2")]
    assert drift.schema_changes(files.limit(0)).collect() == []
    table = {(r.series_id, r.run_no, r.row_no): r.fields for r in drift.consistent_table(files).collect() if r.dataset == "d"}
    measure = next(k for k in table[1, 1, 0] if "dens" in k or "km2" in k)
    assert table[1, 2, 0][measure].as_decimal == 1.51 and table[1, 1, 1][measure].canonical == 2.5 and table[1, 1, 0]["city"].as_text == "A"
    fused = {(r.dataset, r.measure, r.tag): r for r in drift.fused_schema(files).collect()}
    assert set(fused["d", measure, "decimal"].headers) == {"node_density", "nodes_per_km2"}


def test_rare_renames_hold_in_their_series_and_no_cell_is_lost(spark):
    file = lambda header, *v: csv_text(f"city,{header}", *(f"{c},{x}" for c, x in zip("ABC", v)))
    rows = [r for s in range(30) for r in ((s, "d", 1, file("a", 11, 22, 33)), (s, "d", 2, file("b", 11, 22, 33)))]
    rows += [(50, "d", 1, file("a", 11, 22, 33)), (50, "d", 2, file("c", 11, 22, 33)), (70, "d", 1, csv_text("a,b", "5,6")), (80, "d", 1, csv_text("c", "8"))]
    files = spark.createDataFrame(rows, "series_id bigint, dataset string, run_no int, content string")
    assert {(r.old_name, r.new_name) for r in drift.schema_changes(files).collect()} == {("a", "b"), ("a", "c")}
    table = {(r.series_id, r.run_no, r.row_no): {k: v.as_integer for k, v in r.fields.items() if k != "city"} for r in drift.consistent_table(files).collect()}
    a = next(iter(table[0, 2, 0]))
    assert table[50, 1, 0] == {a: 11} and table[50, 2, 0] == {a: 11} and table[80, 1, 0] == {"c": 8}
    assert sorted(v for v in table[70, 1, 0].values()) == [5, 6]
    assert sum(r.n_cells for r in drift.fused_schema(files).collect()) == 62 * 6 + 3


def test_long_chains_are_one_path_with_all_alternatives(spark):
    rows = [(1, "d", k, csv_text(f"city,h{k}", *(f"{c},{x}{'.5' if k % 3 == 0 else ''}" for c, x in zip("ABCD", (110, 220, 330, 440))))) for k in range(1, 12)]
    union = drift.fused(spark.createDataFrame(rows, "series_id bigint, dataset string, run_no int, content string")).collect()
    assert {(r.first_run, r.first_name) for r in union} == {(1, "city"), (1, "h1")}
    assert sorted((r.run_no, r.name, r.tag) for r in union if r.first_name == "h1") == [(k, f"h{k}", "decimal" if k % 3 == 0 else "integer") for k in range(1, 12)]


def test_rows_meet_by_value_in_linear_time():
    a = csv_text("city,kind,old", *(f"c{k},x,{k + 10}" for k in range(3000)))
    b = csv_text("city,kind,new", *(f"c{k},x,{k + 10}" for k in range(2999, -1, -1)))
    one, other = drift._File(a), drift._File(b)
    assert len(drift._candidates(one, other, 0.04)) < 3000 * 2 * drift.BAND
    assert drift.renames(one, other) == [("old", "new")]


def greedy(a, b, within=0.04):
    """The matching of _shared_rows() over all pairs of rows, one by one."""
    agree = {}
    for n in a.names:
        if n in b.cells:
            told = 1.0 if len(set(map(str.lower, a.cells[n]))) > 1 else 0.05
            for i, (x, p) in enumerate(zip(a.numbers[n], a.cells[n])):
                for j, (y, q) in enumerate(zip(b.numbers[n], b.cells[n])):
                    if x is not None and y is not None:
                        same = drift._close(x, y, within) * (1.0 if x not in (0.0, 1.0) else 0.05)
                    else:
                        same = (not drift.blank(p) and p.strip().lower() == q.strip().lower()) * told
                    if same:
                        agree[i, j] = agree.get((i, j), 0.0) + same
    pairs, left, right = [], set(), set()
    for _, _, i, j in sorted((-v, abs(i - j), i, j) for (i, j), v in agree.items()):
        if i not in left and j not in right:
            left.add(i)
            right.add(j)
            pairs.append((i, j))
    return pairs


@pytest.mark.parametrize("seed", range(8))
def test_rows_meet_exactly_however_many_hold_a_value(seed):
    rnd = random.Random(seed)
    kinds = ["", "x", "X ", "y", "5", "5%", "NA", "true", "0"]
    column = [lambda: rnd.choice(kinds), lambda: rnd.choice("abc"), lambda: "same", lambda: f"{rnd.uniform(90, 110):.2f}", lambda: str(rnd.randint(-2, 2)), lambda: f"k{rnd.randint(0, 400)}", lambda: rnd.choice(["7", "u"]) if rnd.random() < 0.8 else f"{rnd.randint(0, 10**6)}"]
    chosen = rnd.sample(column, rnd.randint(1, 5))
    file = lambda n: drift._File(csv_text(",".join(["id", *(f"c{k}" for k in range(len(chosen)))]), *(",".join([f"r{rnd.random()}", *(f() for f in chosen)]) for _ in range(n))))
    a, b = file(rnd.randint(20, 260)), file(rnd.randint(150, 260))
    assert drift._shared_rows(a, b, 0.04) == greedy(a, b)


def test_a_row_meets_its_like_beyond_any_band():
    rows = [f"{'xy'[k % 2]},{k % 5 + 2},{'pq'[k % 3 == 0]}" for k in range(400)]
    odd = "z,9,q"  # agrees in one crowded value with the rows near it, in all with one far away
    a, b = drift._File(csv_text("kind,level,state", odd, *rows, *["z,9,p"] * 80)), drift._File(csv_text("kind,level,state", *rows, *["z,9,p"] * 80, odd))
    assert (0, 480) in drift._shared_rows(a, b, 0.04)
    assert drift._shared_rows(a, b, 0.04) == greedy(a, b)
